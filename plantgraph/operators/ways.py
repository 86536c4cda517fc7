"""Paths between two nodes by counting and unranking, without walking them one by one.

A sequential search takes the out-edges of a node in edge order and goes down before it goes on. In a
graph without a cycle everything it does can be counted from the far end: for each node the paths to
the target (P), the edges a full search from there inspects (C) and how deep it gets without meeting
the target (H), level by level in reverse order. Summed over the edges before an edge, P gives the
number of paths before those that take the edge, and C the steps made before it is taken; along a
path both add up. So the first k paths, and the steps after which each is found, follow from a join a
step, in which a prefix is kept only while its rank is below k and its steps are within the budget:
never more than k prefixes, however many paths there are.

What ends the sequential search ends this one at the same path: the budget of inspected edges (of any
kind), the first node met at the greatest length, and a further edge after the last path asked for.
P and C are cut off at the bounds that are asked for, so they never overflow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..errors import PlantError
from ..plans.steps import Rounds
from ..topology import Topology
from . import traverse as tr
from .adjacency import among

PATHS = "path_index long, edges array<string>, nodes array<string>"
MANY = 1 << 40
#: pairs of groups of names that are looked at
GROUPS = 1_000


@dataclass
class Tally:
    """``nodes`` (node, paths, cost, height, n_all), ``edges`` out of them in order (src, edge_id, dst, pos,
    rank_before, cost_before, later, paths, height), of which paths is null where the kind is another."""

    nodes: DataFrame
    edges: DataFrame

    def of(self, node: str):
        return self.nodes.where(F.col("node") == node).first()


def _capped(x: Column, cap: int) -> Column:
    return F.least(x, F.lit(cap))


def shallow(t: Topology, kind: str, length: int) -> bool:
    """Whether it is plain that no walk over a kind has ``length`` edges. Nodes are thrown together by their
    names without the digits at the end; a walk leads over a walk of such groups, so where those have no
    cycle, no walk is longer than theirs. False only says that this does not tell."""
    group = {x: F.expr(f"trim(TRAILING '0123456789' FROM {x})").alias(x) for x in ("src", "dst")}
    pairs = [tuple(r) for r in t.links(kind).select(group["src"], group["dst"]).distinct().limit(GROUPS + 1).collect()]
    if len(pairs) > GROUPS:
        return False
    for _ in range(length - 1):  # each time what is left can go on for one edge more
        into = {src for src, _ in pairs}
        pairs = [p for p in pairs if p[1] in into]
    return not pairs


def tally(t: Topology, rounds: Rounds, a: str, b: str, kind: str, paths: int | None, search: int | None, only_paths: bool = False) -> Tally | None:
    """P, C and H of everything a search from a over a kind can meet before b; None if it has a cycle. With
    ``only_paths`` of what leads to b, which is enough to list all paths where no bound can end the search."""
    cap_paths, cap_cost = (MANY if x is None else x + 1 for x in (paths, search))
    seed = t.spark.createDataFrame([(a, a)], "key string, node string")
    above = None
    if only_paths:
        above = rounds.keep(tr.closure(t, t.spark.createDataFrame([(b, b)], "key string, node string"), (kind,), False).select("node"))
    met = rounds.keep(tr.closure(t, seed, (kind,), True, within=above, stop=b).select("node"))
    out = among(t.edges_resolved.where(F.col("src").isNotNull() & (F.col("src") != b)), "src", met)
    if only_paths:
        out = among(out.where(F.col("kind") == kind), "dst", met)
    follow = (F.col("kind") == kind) & F.col("dst").isNotNull()
    out = rounds.keep(out.select("src", "edge_id", "dst", follow.alias("follow"), F.row_number().over(Window.partitionBy("src").orderBy("edge_id")).cast("long").alias("pos")))
    degree = out.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_all"), F.count_if("follow").alias("n_follow"))
    base = rounds.keep(met.join(degree, "node", "left").na.fill(0))
    state = ["node", "paths", "cost", "height"]
    is_b = F.col("node") == b
    level = base.where(is_b | (F.col("n_follow") == 0)).select("node", is_b.cast("long").alias("paths"), F.when(is_b, 0).otherwise(_capped(F.col("n_all"), cap_cost)).cast("long").alias("cost"), F.when(is_b, -1).otherwise(0).alias("height"))
    level = rounds.keep(level)
    levels, pending, decided = [level], None, level.count()
    ways = out.where("follow").select("src", F.col("dst").alias("node"))
    while True:
        own = ways.join(level, "node").groupBy("src").agg(F.count("*").alias("n"), F.sum("paths").alias("paths"), F.sum("cost").alias("cost"), F.max("height").alias("height"))
        if pending is not None:
            own = own.unionByName(pending).groupBy("src").agg(*(f(c).alias(c) for f, c in ((F.sum, "n"), (F.sum, "paths"), (F.sum, "cost"), (F.max, "height"))))
        own = own.select("src", "n", *(_capped(F.col(c), cap).alias(c) for c, cap in (("paths", cap_paths), ("cost", cap_cost))), "height")
        merged = rounds.keep(own.join(base.withColumnRenamed("node", "src"), "src"))
        level = merged.where("n = n_follow").select(F.col("src").alias("node"), "paths", _capped(F.col("cost") + F.col("n_all"), cap_cost).alias("cost"), (F.col("height") + 1).alias("height"))
        new = level.count()
        if not new:
            break
        decided += new
        levels.append(level)
        pending = merged.where("n < n_follow").select("src", "n", "paths", "cost", "height")
    if decided < base.count():
        return None
    every = levels[0].select(*state)
    for x in levels[1:]:
        every = every.union(x.select(*state))
    nodes = rounds.keep(every.join(base.select("node", "n_all"), "node"))
    order = Window.partitionBy("src").orderBy("edge_id")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    told = out.join(nodes.select(F.col("node").alias("dst"), "paths", "cost", "height"), "dst", "left")
    told = told.select("src", "edge_id", "dst", "pos", *(F.when(F.col("follow"), F.col(c)).alias(c) for c in ("paths", "cost", "height")))
    last = F.max(F.when(F.col("paths").isNotNull(), F.col("pos"))).over(Window.partitionBy("src"))
    told = told.select("src", "edge_id", "dst", "pos", "paths", "height", F.coalesce(F.sum("paths").over(before), F.lit(0)).alias("rank_before"), (F.col("pos") + F.coalesce(F.sum("cost").over(before), F.lit(0))).alias("cost_before"), (last > F.col("pos")).alias("later"))
    return Tally(nodes, rounds.keep(told))


def _first_too_deep(own: Tally, a: str, b: str, length: int) -> tuple[int, int]:
    """Rank and steps of the least walk that reaches ``length`` edges without meeting b."""
    node, rank, cost = a, 0, 0
    for depth in range(length):
        step = own.edges.where((F.col("src") == node) & (F.col("dst") != b) & (F.col("height") >= length - depth - 1)).orderBy("edge_id").first()
        node, rank, cost = step.dst, rank + step.rank_before, cost + step.cost_before
    return rank, cost


def unrank(t: Topology, rounds: Rounds, own: Tally, a: str, b: str, most: int | None, search: int | None, length: int) -> DataFrame:
    """(path_index, edges, nodes, later, cost) of the first ``most`` paths that are found within the budget;
    later: a further edge would be tried after the path."""
    ways = own.edges.where("paths > 0").select("src", "edge_id", "dst", "rank_before", "cost_before", F.col("later").alias("more"))
    open_ = t.spark.createDataFrame([([], [a], a, 0, False, 0)], "edges array<string>, nodes array<string>, node string, path_index long, later boolean, cost long")
    done = []
    for _ in range(length):
        step = open_.join(ways, open_.node == ways.src)
        step = step.select(F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.col("dst").alias("node"), (F.col("path_index") + F.col("rank_before")).alias("path_index"), (F.col("later") | F.col("more")).alias("later"), (F.col("cost") + F.col("cost_before")).alias("cost"))
        if most is not None:
            step = step.where(F.col("path_index") < most)
        if search is not None:
            step = step.where(F.col("cost") <= search)
        step = rounds.keep(step)
        done.append(step.where(F.col("node") == b))
        open_ = step.where(F.col("node") != b)
        if open_.isEmpty():
            break
    found = done[0] if done else open_.limit(0)
    for x in done[1:]:
        found = found.union(x)
    return found.select("path_index", "edges", "nodes", "later", "cost")


def first_paths(t: Topology, a: str, b: str, kind: str, most: int | None, search: int | None, length: int) -> tuple[DataFrame, bool]:
    """(path_index, edges, nodes) of the paths from a to b that a search in edge order finds before a
    bound ends it, and whether one did."""
    none = t.spark.createDataFrame([], PATHS)
    if a == b:
        return none, False
    if most == 0:
        return none, True
    rounds = Rounds(t.spark, "ways")
    own = tally(t, rounds, a, b, kind, most, search, only_paths=most is None and search is None and shallow(t, kind, length))
    if own is None:
        return simple_paths(t, a, b, kind, most, length)
    total = own.of(a)
    if most is None and total.paths >= MANY:
        raise PlantError("limit_exceeded", "there are too many paths to list")
    cut = (search is not None and total.cost > search) or total.height >= length
    bound = most
    if total.height >= length:
        rank, _ = _first_too_deep(own, a, b, length)
        bound = rank if most is None else min(most, rank)
    found = rounds.keep(unrank(t, rounds, own, a, b, bound, search, length))
    if most is not None and not cut:
        last = found.where(F.col("path_index") == most - 1).select("later").first()
        cut = last is not None and (total.paths > most or last.later)
    return found.select("path_index", "edges", "nodes"), cut


def between(t: Topology, a: str, b: str, kind: str) -> DataFrame:
    """Edges of a kind on some way from a to b."""
    one = t.spark.createDataFrame([(a, a)], "key string, node string")
    two = t.spark.createDataFrame([(b, b)], "key string, node string")
    both = tr.closure(t, one, (kind,), True, within=tr.closure(t, two, (kind,), False).select("node"))
    # what a reaches among the nodes that reach b; a itself only if it does
    edges = among(among(t.of_kind(kind), "src", both), "dst", both)
    return edges.select("edge_id", "from_node", "from_port", "to_node", "to_port", "src", "dst")


def simple_paths(t: Topology, a: str, b: str, kind: str, most: int | None, length: int) -> tuple[DataFrame, bool]:
    """The same for a graph with a cycle between the nodes, which only a draft can have: simple paths
    extended an edge a round. A path repeats a node at some point or not, which no count tells, so
    all are extended before the first are taken; the budget of steps does not apply."""
    rounds = Rounds(t.spark, "paths")
    edges = rounds.keep(between(t, a, b, kind).select("edge_id", "src", "dst"))
    open_ = t.spark.createDataFrame([([], [a])], "edges array<string>, nodes array<string>")
    done, cut = [], False
    for _ in range(length):
        step = open_.join(edges, F.element_at("nodes", -1) == F.col("src")).where("NOT array_contains(nodes, dst)")
        step = rounds.keep(step.select(F.array_append("edges", F.col("edge_id")).alias("edges"), F.array_append("nodes", F.col("dst")).alias("nodes")))
        done.append(step.where(F.element_at("nodes", -1) == b))
        open_ = step.where(F.element_at("nodes", -1) != b)
        if open_.isEmpty():
            break
    else:
        cut = True
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    if most is not None:
        found = rounds.keep(found.orderBy("edges").limit(most + 1))
        if found.count() > most:
            found, cut = found.orderBy("edges").limit(most), True
    return numbered(t, found), cut


def numbered(t: Topology, paths: DataFrame) -> DataFrame:
    """path_index in lexicographic order of the edges, without bringing all paths to one task."""
    rounds = Rounds(t.spark, "numbered")
    own = rounds.keep(paths.orderBy("edges").select("edges", "nodes", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("at")))
    sizes = sorted((r.part, r["count"], r.low) for r in own.groupBy("part").agg(F.count("*").alias("count"), F.min("at").alias("low")).toLocalIterator())
    base, total = [], 0
    for part, n, low in sizes:
        base.append((part, total - low))
        total += n
    return own.join(F.broadcast(t.spark.createDataFrame(base, "part int, shift long")), "part").select((F.col("at") + F.col("shift")).alias("path_index"), "edges", "nodes")


def way_back(t: Topology, a: str, b: str, kind: str, search: int | None, length: int) -> tuple[DataFrame, bool]:
    """(path_index, edges, nodes): the first way from a to b that a search finds that never opens a node
    twice, if any; and whether a bound kept it from one. In a graph without a cycle that is the least way: rank 0.

    The search inspects every edge up to the one it takes at each node of the way, and all edges
    of what it met before that leads nowhere, each once. A way longer than ``length`` is not
    given, and not replaced by a later, shorter one."""
    none = t.spark.createDataFrame([], PATHS)
    if a == b:
        return t.spark.createDataFrame([(0, [], [a])], PATHS), False
    search = None if search is None else max(1, search)
    rounds = Rounds(t.spark, "back")
    own = tally(t, rounds, a, b, kind, 1, None)
    if own is None:
        return _winding(t, rounds, a, b, kind, length)
    if not own.of(a).paths:
        steps = own.nodes.where(F.col("node") != b).agg(F.sum("n_all")).first()[0]
        return none, own.of(a).height > length or (search is not None and steps > search)
    found = rounds.keep(unrank(t, rounds, own, a, b, 1, None, length).select("path_index", "edges", "nodes"))
    if found.isEmpty():
        return none, True
    if search is not None:
        taken = found.select(F.explode("edges").alias("edge_id")).join(own.edges, "edge_id").select("src", F.col("pos").alias("at"))
        tried = own.edges.join(taken, "src").where("pos < at AND paths = 0").select(F.lit("").alias("key"), F.col("dst").alias("node"))
        lost = tr.closure(t, tried, (kind,), True).join(own.nodes, "node").agg(F.coalesce(F.sum("n_all"), F.lit(0))).first()[0]
        if taken.agg(F.sum("at")).first()[0] + lost > search:
            return none, True
    return found, False


def _winding(t: Topology, rounds: Rounds, a: str, b: str, kind: str, length: int) -> tuple[DataFrame, bool]:
    """The least way through a graph with cycles: at each node the first edge from which b can still be
    reached without a node of the way so far. Each step asks anew what reaches b past those."""
    none = t.spark.createDataFrame([], PATHS)
    edges = rounds.keep(between(t, a, b, kind).select("edge_id", "src", "dst"))
    nodes, taken = [a], []
    while nodes[-1] != b:
        if len(taken) == length:
            return none, True
        free = edges.where(~F.col("src").isin(nodes[:-1]) & ~F.col("dst").isin(nodes))
        reach = frontier = t.spark.createDataFrame([(b,)], "dst string")
        while True:
            frontier = rounds.keep(free.where(F.col("src") != nodes[-1]).join(frontier, "dst", "left_semi").select(F.col("src").alias("dst")).distinct().join(reach, "dst", "left_anti"))
            if frontier.isEmpty():
                break
            reach = reach.union(frontier)
        step = free.where(F.col("src") == nodes[-1]).join(reach, "dst", "left_semi").orderBy("edge_id").first()
        if step is None:
            return none, False
        taken.append(step.edge_id)
        nodes.append(step.dst)
    return t.spark.createDataFrame([(0, taken, nodes)], PATHS), False
