"""Iterative primitives: breadth-first levels, keyed closures, source sets, dominators, components.

Each round is one equi-join of a frontier with a bucketed edge layout, a grouped minimum and an
anti-join with what is known, kept as a table. Ties fall as in a sorted breadth-first search: the least parent,
then the least edge.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..plans.steps import Rounds
from ..topology import Topology
from .adjacency import Along, among, entering, names_of

ROW = "node string, depth int, parent string, via_edge string, entered_port string"


@dataclass
class Result:
    """Rows of an answer, whether a bound cut it short, and what it claims."""

    rows: DataFrame
    truncated: bool = False
    claim: str = "structurally_possible"


def layout(edges: DataFrame, forward: bool) -> DataFrame:
    """(here, there, edge_id, port): edges as they are followed; port is where there is entered."""
    a, b, port = ("src", "dst", "to_port") if forward else ("dst", "src", "from_port")
    told = [F.col(f"{x}_{k}").alias(f"{y}_{k}") for x, y in ((a, "here"), (b, "there")) for k in ("group", "key") if f"{x}_{k}" in edges.columns]
    return edges.select(F.col(a).alias("here"), F.col(b).alias("there"), "edge_id", F.col(port).alias("port"), *told)


def breadth_first(t: Topology, origin: str, kinds: tuple[str, ...], forward: bool, depth: int | None = None, most: int | None = None) -> tuple[DataFrame, bool]:
    """Levels from origin, which is left out: (node, depth, parent, via_edge, entered_port), and
    whether more nodes would follow: beyond ``most``, or beyond a level reached at ``depth``."""
    rounds = Rounds(t.spark, "bfs")
    along = Along(rounds, layout(t.links(*kinds), forward))
    depth = t.limits.depth if depth is None else depth
    known = t.spark.createDataFrame([(origin, 0, None, None, None)], ROW)
    frontier, levels, level, total = known.select("node"), [], 0, 0
    truncated = depth == 0
    while depth is None or level < depth:
        level += 1
        seen = reduce(DataFrame.union, [known, *levels]).select("node")
        step = along.follow(frontier).groupBy(F.col("there").alias("node")).agg(F.min(F.struct(F.col("here").alias("parent"), "edge_id", "port")).alias("w"))
        step = step.join(seen, "node", "left_anti").select("node", F.lit(level).alias("depth"), "w.parent", F.col("w.edge_id").alias("via_edge"), F.col("w.port").alias("entered_port"))
        step = rounds.keep(step)
        n = step.count()
        if not n:
            break
        if most is not None and total + n > most:
            levels.append(rounds.keep(step.orderBy("parent", "via_edge").limit(most - total)))
            rounds.drop(step)
            truncated = True
            break
        total += n
        levels.append(step)
        frontier = step.select("node")
    else:
        truncated = True
    along.drop()
    return _levels(t, levels), truncated


def _levels(t: Topology, levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, levels) if levels else t.spark.createDataFrame([], ROW)


def closure(t: Topology, seeds: DataFrame, kinds: tuple[str, ...], forward: bool, within: DataFrame | None = None, stop: str | None = None) -> DataFrame:
    """(key, node): all nodes each key's seeds (key, node) reach, seeds included. ``within``: only nodes
    of this table (node). ``stop``: nothing is followed beyond this node."""
    rounds = Rounds(t.spark, "closure")
    along = layout(t.links(*kinds), forward).drop("edge_id", "port")
    if stop is not None:
        along = along.where(F.col("here") != stop)
    if within is not None:
        along = entering(rounds, along, within)
    along = Along(rounds, along)
    known = rounds.keep(seeds.select("key", "node").distinct())
    levels, frontier = [known], known
    while True:
        step = along.follow(frontier).select("key", F.col("there").alias("node"))
        step = rounds.keep(step.distinct().join(reduce(DataFrame.union, levels), ["key", "node"], "left_anti"))
        if step.isEmpty():
            along.drop()
            rounds.drop(step)
            return reduce(DataFrame.union, levels)
        levels.append(step)
        frontier = step


def hosts(t: Topology, members: DataFrame) -> DataFrame:
    """(key, node): a pump (node) is replaced by the host of its first pumps edge, or left out."""
    pump = t.edges_resolved.where("kind = 'pumps' AND dst IS NOT NULL").groupBy("dst").agg(F.min(F.struct("edge_id", "src")).alias("first"))
    kinds = among(t.nodes.select(F.col("node_id").alias("node"), "kind"), "node", members)
    joined = members.join(kinds, "node").join(pump.select(F.col("dst").alias("node"), F.col("first.src").alias("host")), "node", "left")
    return joined.select("key", F.expr("CASE WHEN kind = 'pump' THEN host ELSE node END").alias("node")).where("node IS NOT NULL")


# -- sets as bits --------------------------------------------------------------------------------
#: bits of one word of a set; a set has a row for each word that is not empty
WORD = 63


def numbered(rounds: Rounds, nodes: DataFrame) -> DataFrame:
    """(node, word, bit): a place for each node (distinct) in sets of them, in the nodes' order. Each
    range partition counts for itself, so no task sees all nodes; words of different partitions differ."""
    at = F.monotonically_increasing_id()
    part, i = F.shiftright(at, 33), at.bitwiseAND(F.lit((1 << 33) - 1))
    placed = nodes.orderBy("node").select("node", (part * (1 << 28) + F.floor(i / WORD)).alias("word"), (i % WORD).cast("int").alias("bit"))
    return rounds.keep(placed)


def as_bits(placed: DataFrame) -> DataFrame:
    """(node, word, bits): each node with itself in its set."""
    return placed.select("node", "word", F.expr("shiftleft(1L, bit)").alias("bits"))


def decoded(placed: DataFrame, sets: DataFrame) -> DataFrame:
    """(word, bits, names) of each different word of sets (word, bits): the nodes it stands for."""
    each = sets.select("word", "bits").distinct().select("word", "bits", F.explode(F.expr(f"filter(sequence(0, {WORD - 1}), b -> (shiftright(bits, b) & 1L) = 1L)")).alias("bit"))
    return each.join(placed.withColumnRenamed("node", "name"), ["word", "bit"]).groupBy("word", "bits").agg(F.array_sort(F.collect_list("name")).alias("names"))


def spread(t: Topology, rounds: Rounds, seeds: DataFrame, kinds: tuple[str, ...], forward: bool, wanted: DataFrame, inside: DataFrame) -> DataFrame:
    """(node, word, bits) of the nodes ``wanted`` (node): the union of the sets of all seeds (node, word, bits)
    that reach each. A node is a row a word, however many seeds reach it, and only bits that are new
    to it go on. Only nodes ``inside`` (node) are entered: all that lie between seeds and wanted."""
    along = Along(rounds, entering(rounds, layout(t.links(*kinds), forward).drop("edge_id", "port").where("here <> there"), inside))
    known = new = rounds.keep(seeds.groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    while True:
        step = along.follow(new).groupBy(F.col("there").alias("node"), "word").agg(F.bit_or("bits").alias("bits"))
        have = known.select("node", "word", F.col("bits").alias("have"))
        step = step.join(have, ["node", "word"], "left").select("node", "word", F.expr("bits & ~coalesce(have, 0L)").alias("bits")).where("bits <> 0")
        new = rounds.keep(step)
        if new.isEmpty():
            break
        known = rounds.keep(known.union(new).groupBy("node", "word").agg(F.bit_or("bits").alias("bits")))
    along.drop()
    return rounds.keep(known.join(wanted.select("node").distinct(), "node", "left_semi"))


def source_bits(t: Topology, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The origins from which supplies reach each of the nodes (node), as (node, word, bits), and the
    origins' places (node, word, bit)."""
    rounds = Rounds(t.spark, "source-bits")
    above = rounds.keep(closure(t, nodes.select(F.lit("").alias("key"), "node"), ("supplies",), False).select("node").distinct())
    placed = numbered(rounds, t.origins_among(above))
    sets = spread(t, rounds, as_bits(placed), ("supplies",), True, nodes, above)
    rounds.drop_all_but(placed, sets)
    return sets, placed


def source_sets(t: Topology, members: DataFrame, pumps: bool = True) -> DataFrame:
    """(key, source) for members (key, node): the origins from which supplies reach each. Sets of members
    are followed up or sets of origins down, whichever are fewer; the answer is the same."""
    rounds = Rounds(t.spark, "sources")
    start = rounds.keep((hosts(t, members) if pumps else members).select("key", "node").distinct())
    nodes = start.select("node").distinct()
    few = names_of(nodes, "node")
    if few is not None and len(few) <= WORD:  # their ancestors one by one
        up = rounds.keep(closure(t, nodes.select(F.col("node").alias("key"), "node"), ("supplies",), False))
        pairs = up.join(t.origins_among(up), "node").select(F.col("node").alias("source"), F.col("key").alias("node"))
        return rounds.keep(start.join(pairs, "node").select("key", "source"))
    above = rounds.keep(closure(t, nodes.select(F.lit("").alias("key"), "node"), ("supplies",), False).select("node").distinct())
    origins = rounds.keep(t.origins_among(above))
    if nodes.count() > origins.count():
        placed = numbered(rounds, origins)
        sets = spread(t, rounds, as_bits(placed), ("supplies",), True, nodes, above)
        names = decoded(placed, sets)
        return start.join(sets, "node").join(names, ["word", "bits"]).select("key", F.explode("names").alias("source"))
    placed = numbered(rounds, nodes)
    sets = spread(t, rounds, as_bits(placed), ("supplies",), False, origins, above)
    pairs = sets.join(decoded(placed, sets), ["word", "bits"]).select(F.col("node").alias("source"), F.explode("names").alias("node"))
    return start.join(pairs, "node").select("key", "source")


def dominators(t: Topology, origins: DataFrame, inside: DataFrame) -> DataFrame:
    """(node, by): the nodes through which every supply way from origins (node) to a node of ``inside``
    passes, itself included. A node is decided when all before it are, so each round decides the next
    topological level; what lies on a cycle or behind one is left to ``_behind_cycles``."""
    rounds = Rounds(t.spark, "dominators")
    seeds = origins.select(F.lit("").alias("key"), "node")
    reached = rounds.keep(closure(t, seeds, ("supplies",), True, within=inside).select("node"))
    e = layout(t.links("supplies"), True).where("here <> there")
    e = among(among(e, "here", reached), "there", reached).select("here", "there").distinct()
    e = rounds.keep(e.join(e.groupBy("there").agg(F.count("*").alias("n")), "there"))
    known = rounds.keep(reached.join(e.select(F.col("there").alias("node")), "node", "left_anti").select("node", F.col("node").alias("by")))
    levels, left = [known], e
    while True:
        every = reduce(DataFrame.union, levels)
        pairs = left.join(every, left.here == every.node).groupBy("there", "by", "n").agg(F.count("*").alias("m"), F.sum(F.expr("CASE WHEN here = by THEN 1 ELSE 0 END")).alias("own"))
        ready = pairs.groupBy("there", "n").agg(F.sum("own").alias("done")).where("done = n").select("there")
        step = pairs.where("m = n").join(ready, "there", "left_semi").select(F.col("there").alias("node"), "by").union(ready.select("there", "there"))
        step = rounds.keep(step)
        if step.isEmpty():
            return every if left.isEmpty() else every.union(_behind_cycles(rounds, every, left))
        levels.append(step)
        left = rounds.keep(left.join(step.where("node = by").select(F.col("node").alias("there")), "there", "left_anti"))


def _behind_cycles(rounds: Rounds, decided: DataFrame, left: DataFrame) -> DataFrame:
    """(node, by) of the nodes that the edges ``left`` (here, there, n) lead into. What dominates a node
    lies on every way to it, so it lies on one: the sets start from the nodes of one breadth-first way
    and lose, round by round, what does not dominate all nodes before, until nothing changes."""
    found = None
    frontier = decided
    while True:
        first = left.join(frontier.where("node = by").select(F.col("node").alias("here")), "here", "left_semi").groupBy("there").agg(F.min("here").alias("here"))
        if found is not None:
            first = first.join(found.where("node = by").select(F.col("node").alias("there")), "there", "left_anti")
        step = first.join(frontier.withColumnRenamed("node", "here"), "here").select(F.col("there").alias("node"), "by").union(first.select("there", "there"))
        frontier = rounds.keep(step)
        if frontier.isEmpty():
            break
        found = frontier if found is None else rounds.keep(found.union(frontier))
    n = found.count()
    while True:
        pairs = left.join(decided.union(found), left.here == F.col("node")).groupBy("there", "by", "n").agg(F.count("*").alias("m")).where("m = n").select(F.col("there").alias("node"), "by")
        less = rounds.keep(found.where("node = by").union(found.where("node <> by").join(pairs, ["node", "by"], "left_semi")))
        m = less.count()
        if m == n:
            return less
        found, n = less, m


#: rows of edges for a task, about, and edges of a node that are not brought together
ROWS, HUB = 1_000_000, 100_000


def _dealt(t: Topology, rows: int) -> int:
    """Partitions for so many rows: no fewer than the session has, and none much above ``ROWS``."""
    return max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // ROWS))


def _beside(e: DataFrame, on: str, least: DataFrame, n: int) -> DataFrame:
    """e with the m of least (on, m, n) at its column, null where there is none. Hubs, at most two for every
    ``HUB`` edges, are broadcast, so that their edges stay where they are."""
    hubs = F.broadcast(least.where(f"n > {HUB}").select(on, "m"))
    few = least.where(f"n <= {HUB}").select(on, "m")
    if hubs.isEmpty():
        return e.repartition(n, on).join(few.repartition(n, on), on, "left")
    rest = e.join(hubs.select(on), on, "left_anti")
    return e.join(hubs, on).unionByName(rest.repartition(n, on).join(few.repartition(n, on), on, "left"))


def _to_roots(rounds: Rounds, picks: DataFrame) -> DataFrame:
    """(node, m, n): each node of picks (node, m, n) with the end of its chain of picks as m. Chains are
    doubled among the nodes that were picked; those that nobody picked follow once."""
    ends = picks.where("m <> node").select(F.col("m").alias("node")).distinct()
    inner = rounds.keep(picks.join(ends, "node", "left_semi").select("node", "m"))
    while True:
        over = inner.where("m <> node").select(F.col("node").alias("m"), F.col("m").alias("next"))
        step = rounds.keep(inner.join(over, "m", "left").select("node", F.coalesce("next", "m").alias("m"), F.col("next").isNotNull().alias("moved")))
        rounds.drop(inner)
        inner = step
        if step.where("moved").isEmpty():
            break
    roots = rounds.keep(picks.join(inner.select(F.col("node").alias("m"), F.col("m").alias("root")), "m", "left").select("node", F.coalesce("root", "m").alias("m"), "n"))
    rounds.drop(inner, picks)
    return roots


def components(t: Topology, links: DataFrame) -> DataFrame:
    """(node, label): the component of each node that a link (a, b) to another touches, named by its least node.
    Nodes are of any type with an order. Each round every node picks its least neighbour, if that is less than itself,
    chains of picks become one node, and the links between different ones are left. A node that picks none either
    takes others in or has a smaller neighbour in the next round, so at most half are left after two."""
    rounds = Rounds(t.spark, "components")
    e = rounds.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    maps = []
    while rows := e.count():
        n = _dealt(t, rows)
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).repartition(n, "u")  # no task keeps a sum for all nodes it reads
        least = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("node")).alias("m"), F.count("*").alias("n"))
        roots = _to_roots(rounds, rounds.keep(least))
        maps.append(roots)
        between = _beside(e, "u", roots.withColumnRenamed("node", "u"), n).select(F.col("m").alias("u"), "v")
        between = _beside(between, "v", roots.withColumnRenamed("node", "v"), n).select("u", F.col("m").alias("v"))
        between = between.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
        e, last = rounds.keep(between), e
        rounds.drop(last)
    if not maps:
        return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
    last = maps.pop().select("node", "m")
    while maps:
        last = rounds.keep(maps.pop().select("node", F.col("m").alias("x")).join(last.withColumnRenamed("node", "x"), "x", "left").select("node", F.coalesce("m", "x").alias("m")))
    return last.withColumnRenamed("m", "label")


def supplier(column: str = "kind"):
    return F.col(column).isin(*schema.SUPPLIERS)
