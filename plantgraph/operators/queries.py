"""The structural queries. Each returns DataFrames; nothing claims more than declared structure."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..errors import PlantError
from ..plans.steps import Rounds
from ..topology import Topology
from . import routes, ways
from . import traverse as tr
from .adjacency import among
from .traverse import Result

POSSIBLE, IMPOSSIBLE = "structurally_possible", "structurally_impossible"


def _reach(t: Topology, name: str, forward: bool, depth: int | None, most: int | None) -> Result:
    node, _ = t.resolve(name)
    most = t.limits.results if most is None else most
    rows, cut = tr.breadth_first(t, node, ("supplies",), forward, depth, most)
    rows = rows.select("node", "depth", "parent", "via_edge", "entered_port")
    return Result(rows, cut, IMPOSSIBLE if rows.isEmpty() else POSSIBLE)


def upstream_of(t: Topology, name: str, depth: int | None = None, most: int | None = None) -> Result:
    """Everything that can supply the node; discovery order is (depth, parent, via_edge)."""
    return _reach(t, name, False, depth, most)


def downstream_of(t: Topology, name: str, depth: int | None = None, most: int | None = None) -> Result:
    """Everything the node can supply."""
    return _reach(t, name, True, depth, most)


def sources_serving(t: Topology, name: str) -> DataFrame:
    """(node): the structural sources of a node; of a pump, those of the element that hosts it."""
    node, _ = t.resolve(name)
    seed = t.spark.createDataFrame([(node, node)], "key string, node string")
    return tr.source_sets(t, seed).select(F.col("source").alias("node")).orderBy("node")


# -- paths ---------------------------------------------------------------------------------------
def _exclusive(t: Topology) -> DataFrame:
    """(group_id, node, port) of changeovers of which one member at most can be in use."""
    one = t.changeovers.where("max_concurrent = 1").select("changeover_id")
    return t.changeover_members.join(one, "changeover_id").select("changeover_id", "node", "port")


def _touched(t: Topology, paths: DataFrame) -> DataFrame:
    """(path_index, changeover_id, node, port): a row for each time a path touches such a member,
    by endpoint as it is spelled."""
    if not {"changeovers", "changeover_members"} <= t.tables.keys():
        return t.spark.createDataFrame([], "path_index long, changeover_id string, node string, port string")
    steps = Rounds(t.spark, "steps").keep(paths.select("path_index", F.explode("edges").alias("edge_id")))
    e = among(t.edges, "edge_id", steps, "edge_id").select("edge_id", F.explode(F.array(F.struct(F.col("from_node").alias("node"), F.col("from_port").alias("port")), F.struct(F.col("to_node").alias("node"), F.col("to_port").alias("port")))).alias("end")).select("edge_id", "end.node", "end.port")
    return steps.join(e, "edge_id").join(_exclusive(t), ["node", "port"]).select("path_index", "changeover_id", "node", "port")


def possible_supply_paths(t: Topology, a: str, b: str, most: int | None = None, depth: int | None = None, search: int | None = None) -> tuple[Result, DataFrame, DataFrame]:
    """Paths (path_index, edges, nodes, passes_pump_host, crosses_changeover, origin_source_count);
    pairs of paths that exclude each other, one row for each witness (first, second, changeover_id,
    first_node, second_node); and the sources that reach b. Bounds of number, length and inspected
    edges end the search as they end a sequential one: see ``ways``."""
    (a, _), (b, _) = t.resolve(a), t.resolve(b)
    most, length, search = _bounds(t, most, depth, search)
    paths, cut = ways.first_paths(t, a, b, "supplies", most, search, length)
    touched = Rounds(t.spark, "touched").keep(_touched(t, paths))
    pumped = _pumped(t, paths)
    sources = tr.source_sets(t, t.spark.createDataFrame([(a, a)], "key string, node string"), pumps=False)
    n = sources.count()
    rows = paths.join(pumped.withColumn("p", F.lit(True)), "path_index", "left").join(touched.select("path_index").distinct().withColumn("c", F.lit(True)), "path_index", "left")
    rows = rows.select("path_index", "edges", "nodes", F.coalesce("p", F.lit(False)).alias("passes_pump_host"), F.coalesce("c", F.lit(False)).alias("crosses_changeover"), F.lit(n).cast("long").alias("origin_source_count"))
    x, y = touched.alias("x"), touched.alias("y")
    pairs = x.join(y, (F.col("x.changeover_id") == F.col("y.changeover_id")) & (F.col("x.path_index") < F.col("y.path_index")) & ((F.col("x.node") != F.col("y.node")) | (F.col("x.port") != F.col("y.port"))))
    pairs = pairs.select(F.col("x.path_index").alias("first"), F.col("y.path_index").alias("second"), F.col("x.changeover_id").alias("changeover_id"), F.col("x.node").alias("first_node"), F.col("y.node").alias("second_node"))
    into = tr.source_sets(t, t.spark.createDataFrame([(b, b)], "key string, node string")).select(F.col("source").alias("node"))
    return Result(rows, cut, IMPOSSIBLE if rows.isEmpty() else POSSIBLE), pairs, into


def _bounds(t: Topology, most: int | None, depth: int | None, search: int | None) -> tuple[int | None, int, int | None]:
    """The bounds of a search for paths: those given, else those of the topology."""
    own = t.limits
    depth = own.depth if depth is None else depth
    return own.paths if most is None else most, own.path_length if depth is None else min(depth, own.path_length), own.search if search is None else search


def _pumped(t: Topology, paths: DataFrame) -> DataFrame:
    """(path_index) of paths over a node that hosts a pump."""
    own = Rounds(t.spark, "pumped").keep(paths.select("path_index", F.explode("nodes").alias("node")))
    hosts = among(t.edges_resolved.where("kind = 'pumps' AND src IS NOT NULL"), "src", own).select(F.col("src").alias("node")).distinct()
    return own.join(hosts, "node", "left_semi").select("path_index").distinct()


def possible_circuits(t: Topology, a: str, b: str, most: int | None = None, depth: int | None = None, search: int | None = None) -> Result:
    """Supply paths with the way back over returns edges that a search finds first; nothing if there is none."""
    (a, _), (b, _) = t.resolve(a), t.resolve(b)
    supply, _, _ = possible_supply_paths(t, a, b, most, depth, search)
    _, length, search = _bounds(t, most, depth, search)
    back, cut = ways.way_back(t, b, a, "returns", search, length)
    crossing = not _touched(t, back).isEmpty()
    rows = supply.rows.crossJoin(F.broadcast(back.select(F.col("edges").alias("return_edges"), F.col("nodes").alias("return_nodes"))))  # one row at most
    rows = rows.withColumn("crosses_changeover", F.col("crosses_changeover") | F.lit(crossing))
    found = not supply.rows.isEmpty()
    return Result(rows if a != b else rows.limit(0), supply.truncated or (found and cut), IMPOSSIBLE if rows.isEmpty() else POSSIBLE)


def independent_supply_paths(t: Topology, a: str, b: str, most: int | None = None, search: int | None = None) -> Result:
    """Edge-disjoint supply routes as a greedy search finds them: (path_index, edges, nodes,
    passes_pump_host, origin_source_count)."""
    (a, _), (b, _) = t.resolve(a), t.resolve(b)
    most, _, search = _bounds(t, most, None, search)
    routes_, cut = routes.greedy(t, a, b, most, search)
    n = tr.source_sets(t, t.spark.createDataFrame([(a, a)], "key string, node string"), pumps=False).count()
    rows = routes_.join(_pumped(t, routes_).withColumn("p", F.lit(True)), "path_index", "left")
    rows = rows.select("path_index", "edges", "nodes", F.coalesce("p", F.lit(False)).alias("passes_pump_host"), F.lit(n).cast("long").alias("origin_source_count"))
    return Result(rows, cut, IMPOSSIBLE if routes_.isEmpty() else POSSIBLE)


def max_disjoint_supply_paths(t: Topology, a: str, b: str) -> DataFrame:
    """(routes): the greatest number of edge-disjoint supply routes; never less than the greedy one."""
    (a, _), (b, _) = t.resolve(a), t.resolve(b)
    return t.spark.createDataFrame([(routes.greatest(t, a, b),)], "routes long")


# -- dependencies --------------------------------------------------------------------------------
def _subjects(t: Topology, names: list[str]) -> DataFrame:
    if not names:
        raise PlantError("empty_input", "at least one subject is needed")
    if len(names) > t.limits.subjects:
        raise PlantError("limit_exceeded", "too many subjects")
    return t.spark.createDataFrame([(n, n) for n in sorted({t.resolve(x)[0] for x in names})], "key string, node string")


def common_dependencies(t: Topology, names: list[str]) -> DataFrame:
    """(node): what is upstream of every subject, the subjects left out."""
    seeds = _subjects(t, names)
    n = seeds.count()
    reach = tr.closure(t, seeds, ("supplies",), False).where("key <> node")
    both = reach.groupBy("node").agg(F.count("*").alias("n")).where(F.col("n") == n).select("node")
    return both.join(seeds.select("node"), "node", "left_anti")


def single_points(t: Topology, names: list[str]) -> DataFrame:
    """(node, subject, disconnects_all, is_structural_source): ancestors without which a subject is
    reached from no other origin: its dominators in the ancestors' subgraph, and all candidates of a
    subject that no origin reaches."""
    rounds = Rounds(t.spark, "points")
    seeds = _subjects(t, names)
    up = rounds.keep(tr.closure(t, seeds, ("supplies",), False))
    inside = rounds.keep(up.select("node").distinct())
    candidates = rounds.keep(up.where("key <> node").select(F.col("node").alias("key")).distinct())
    origins = rounds.keep(t.origins_among(inside))
    kinds = t.nodes.where(F.col("kind").isin(*{*schema.SUPPLIERS, *schema.CONSUMERS})).select(F.col("node_id").alias("subject"))
    subjects = seeds.select(F.col("node").alias("subject")).join(kinds, "subject", "left_semi")
    probed = candidates.join(F.broadcast(subjects), F.col("key") != F.col("subject"))  # limits.subjects rows at most
    by = tr.dominators(t, origins, inside)
    reached = by.where("node = by").select(F.col("node").alias("subject"))
    lost = probed.join(by.select(F.col("by").alias("key"), F.col("node").alias("subject")), ["key", "subject"], "left_semi").union(probed.join(reached, "subject", "left_anti").select("key", "subject"))
    lost = rounds.keep(lost)
    total = probed.groupBy("key").agg(F.count("*").alias("probed"))
    counts = lost.groupBy("key").agg(F.count("*").alias("lost")).join(total, "key").select("key", (F.col("lost") == F.col("probed")).alias("disconnects_all"))
    source = origins.select(F.col("node").alias("key"), F.lit(True).alias("s"))
    out = lost.join(counts, "key").join(source, "key", "left")
    return out.select(F.col("key").alias("node"), "subject", "disconnects_all", F.coalesce("s", F.lit(False)).alias("is_structural_source"))


# -- redundancy ----------------------------------------------------------------------------------
def redundancy_membership(t: Topology, name: str) -> DataFrame:
    """(group_id, member_index, declared) of members spelled with the node's own id."""
    node, _ = t.resolve(name)
    return t.group_members.where(F.col("node") == node).select("group_id", "member_index", "declared").orderBy("group_id", "member_index")


def redundancy_report(t: Topology, group_ids: list[str] | None = None) -> DataFrame:
    """A row for each group: members with their sources, sources that two or more share, members
    that are a source of another, repeated failure domains, and the verdict."""
    groups, members = t.groups, t.group_members
    if group_ids is not None:
        groups, members = groups.where(F.col("group_id").isin(*group_ids)), members.where(F.col("group_id").isin(*group_ids))
    rounds = Rounds(t.spark, "groups")
    named = members.join(among(t.lookup, "name", members).select(F.col("name").alias("node"), "node_id"), "node", "left")
    key = F.concat_ws("\t", "group_id", F.col("member_index").cast("string"))
    keyed = rounds.keep(named.select("group_id", "member_index", "declared", "failure_domain", "node_id", key.alias("key")))
    sources = rounds.keep(tr.source_sets(t, keyed.where("node_id IS NOT NULL").select("key", F.col("node_id").alias("node"))).join(keyed.select("key", "group_id", "member_index", "node_id"), "key"))
    shared = sources.groupBy("group_id", "source").agg(F.count_distinct("member_index").alias("n")).where("n >= 2").groupBy("group_id").agg(F.array_sort(F.collect_list("source")).alias("shared_sources"))
    unsourced = keyed.join(sources.select("key").distinct(), "key", "left_anti").groupBy("group_id").agg(F.count("*").alias("unsourced"))
    own = keyed.select("group_id", F.col("node_id").alias("source")).distinct()
    ancestors = sources.where("source <> node_id").join(own, ["group_id", "source"]).groupBy("group_id").agg(F.array_sort(F.collect_set("source")).alias("ancestor_members"))
    domains = keyed.where("failure_domain IS NOT NULL").groupBy("group_id", F.col("failure_domain.identity").alias("domain")).agg(F.count("*").alias("n")).where("n > 1")
    domains = domains.groupBy("group_id").agg(F.array_sort(F.flatten(F.collect_list(F.expr("array_repeat(domain, cast(n - 1 as int))")))).alias("duplicate_failure_domains"))
    count = keyed.groupBy("group_id").agg(F.count("*").alias("members"))
    out = groups.select("group_id", "scheme", "scope", "require_distinct_failure_domains", "require_independent_sources")
    for part in (count, shared, ancestors, domains, unsourced):
        out = out.join(part, "group_id", "left")
    empty = F.array().cast("array<string>")
    out = out.withColumns({"members": F.coalesce("members", F.lit(0)), **{c: F.coalesce(c, empty) for c in ("shared_sources", "ancestor_members", "duplicate_failure_domains")}})
    holds = (F.col("members") > 0) & F.col("unsourced").isNull()
    holds &= ~F.col("require_distinct_failure_domains") | (F.size("duplicate_failure_domains") == 0)
    holds &= ~F.col("require_independent_sources") | (F.size("shared_sources") == 0)
    flagged = F.col("require_distinct_failure_domains") | F.col("require_independent_sources")
    verdict = F.when(F.col("members") == 0, "independence_unproven").when(~holds, "declaration_violated").when(flagged, "declaration_consistent").otherwise("independence_unproven")
    return out.select("group_id", "scheme", "scope", F.col("members").cast("long").alias("members"), "shared_sources", "ancestor_members", "duplicate_failure_domains", holds.alias("independence_holds"), verdict.alias("verdict"))


def redundancy_group_report(t: Topology, group_id: str) -> DataFrame:
    out = redundancy_report(t, [group_id])
    if out.isEmpty():
        raise PlantError("not_found", "no group has this name", group_id)
    return out


def structurally_mutually_exclusive(t: Topology, group_id: str, a: tuple[str, str], b: tuple[str, str]) -> bool:
    """Whether two (node, port) members of a changeover can never be in use together."""
    own = {(r.node, r.port) for r in _exclusive(t).where(F.col("changeover_id") == group_id).toLocalIterator()}
    return a != b and {a, b} <= own


def mutually_exclusive(t: Topology, asked: DataFrame) -> DataFrame:
    """asked (changeover_id, a_node, a_port, b_node, b_port) with never_together: whether the two are
    different members of a changeover of which one at most can be in use."""
    own = _exclusive(t).distinct()
    key = ["changeover_id"]
    for x in "ab":
        own_x = own.select("changeover_id", F.col("node").alias(f"{x}_node"), F.col("port").alias(f"{x}_port"), F.lit(True).alias(f"_{x}"))
        asked = asked.join(own_x, [*key, f"{x}_node", f"{x}_port"], "left")
    apart = (F.col("a_node") != F.col("b_node")) | (F.col("a_port") != F.col("b_port"))
    return asked.select("changeover_id", "a_node", "a_port", "b_node", "b_port", (F.coalesce("_a", F.lit(False)) & F.coalesce("_b", F.lit(False)) & apart).alias("never_together"))


# -- service -------------------------------------------------------------------------------------
def sink_reports(t: Topology, names: list[str] | None = None) -> DataFrame:
    """(sink, feeders, sources, shared_sources, verdict) of sinks: direct feeders in edge order."""
    sinks = t.nodes.where("kind = 'cooling_sink'").select(F.col("node_id").alias("sink"))
    if names is not None:
        for n in names:
            node, kind = t.resolve(n)
            if kind != "cooling_sink":
                raise PlantError("invalid_argument", "not a cooling sink", node)
        sinks = sinks.where(F.col("sink").isin(*[t.resolve(n)[0] for n in names]))
    rounds = Rounds(t.spark, "sinks")
    feeds = rounds.keep(among(t.edges_resolved.where("kind = 'supplies' AND dst IS NOT NULL"), "dst", sinks, "sink").select(F.col("dst").alias("sink"), "edge_id", F.col("src").alias("feeder")))
    sets, placed = tr.source_bits(t, feeds.where("feeder IS NOT NULL").select(F.col("feeder").alias("node")))
    # a sink's feeders are listed in its answer; so are their sets: all bits, and those met twice
    per = feeds.join(sets.withColumnRenamed("node", "feeder"), "feeder").groupBy("sink", "word").agg(F.collect_list("bits").alias("own"))
    both = F.expr("aggregate(own, named_struct('once', 0L, 'twice', 0L), (x, b) -> named_struct('once', x.once | b, 'twice', x.twice | (x.once & b)))")
    per = per.select("sink", "word", both.alias("x")).select("sink", "word", F.col("x.once").alias("bits"), F.col("x.twice").alias("twice"))
    per = rounds.keep(per)
    names = rounds.keep(tr.decoded(placed, per.select("word", "bits").union(per.where("twice <> 0").select("word", "twice"))))
    shared = per.join(names.withColumnRenamed("names", "all"), ["word", "bits"]).join(names.select("word", F.col("bits").alias("twice"), F.col("names").alias("some")), ["word", "twice"], "left")
    shared = shared.groupBy("sink").agg(F.array_sort(F.flatten(F.collect_list("all"))).alias("sources"), F.array_sort(F.flatten(F.collect_list("some"))).alias("shared_sources"))
    listed = feeds.groupBy("sink").agg(F.transform(F.array_sort(F.collect_list(F.struct("edge_id", "feeder"))), lambda x: x.feeder).alias("feeders"))
    out = sinks.join(listed, "sink", "left").join(shared, "sink", "left")
    empty = F.array().cast("array<string>")
    verdict = F.when(F.col("feeders").isNull(), "no_structural_feed").when(F.size("feeders") == 1, "single_feed").when(F.size(F.coalesce("shared_sources", empty)) > 0, "multiple_feeds_sharing_dependency").otherwise("multiple_independent_feeds")
    return out.select("sink", *(F.coalesce(c, empty).alias(c) for c in ("feeders", "sources", "shared_sources")), verdict.alias("verdict"))


def sink_service_report(t: Topology, name: str) -> DataFrame:
    return sink_reports(t, [name])


def zone_reports(t: Topology, names: list[str] | None = None) -> DataFrame:
    """(zone, serving, sinks, air_handlers, groups, verdict) of thermal zones."""
    zones = t.nodes.where("kind = 'thermal_zone'").select(F.col("node_id").alias("zone"))
    if names is not None:
        for n in names:
            node, kind = t.resolve(n)
            if kind != "thermal_zone":
                raise PlantError("invalid_argument", "not a thermal zone", node)
        zones = zones.where(F.col("zone").isin(*[t.resolve(n)[0] for n in names]))
    serving = t.of_kind("serves").select(F.col("dst").alias("zone"), F.col("src").alias("node")).distinct()
    inside = t.of_kind("contains").select(F.col("src").alias("zone"), F.col("dst").alias("node")).distinct().join(t.nodes.select(F.col("node_id").alias("node"), "kind"), "node")
    air = inside.where("kind IN ('crah', 'crac')").select("zone", "node")
    touching = serving.union(air).distinct().join(t.group_members.select("node", "group_id"), "node").groupBy("zone").agg(F.array_sort(F.collect_set("group_id")).alias("groups"))
    parts = [serving.groupBy("zone").agg(F.array_sort(F.collect_set("node")).alias("serving")), inside.where("kind = 'cooling_sink'").groupBy("zone").agg(F.array_sort(F.collect_set("node")).alias("sinks")), air.groupBy("zone").agg(F.array_sort(F.collect_set("node")).alias("air_handlers")), touching]
    out = zones
    for p in parts:
        out = out.join(p, "zone", "left")
    served, filled = F.col("serving").isNotNull(), F.col("sinks").isNotNull()
    verdict = F.when(served & filled, "served").when(filled, "no_serving_element").when(served, "no_contained_sink").otherwise("unpopulated")
    empty = F.array().cast("array<string>")
    return out.select("zone", *(F.coalesce(c, empty).alias(c) for c in ("serving", "sinks", "air_handlers", "groups")), verdict.alias("verdict"))


def zone_report(t: Topology, name: str) -> DataFrame:
    return zone_reports(t, [name])


@dataclass
class Blast:
    affected: Result
    sinks: DataFrame
    zones: DataFrame
    peers: DataFrame | None


def blast_radius(t: Topology, name: str, include_containment_peers: bool = False, depth: int | None = None, most: int | None = None) -> Blast:
    """What is downstream of a node, the sinks and zones among it or served by it, and, if asked
    for, its container, the container's other contents and its own."""
    node, _ = t.resolve(name)
    reach = _reach(t, node, True, depth, most)
    every = reach.rows.select("node").union(t.spark.createDataFrame([(node,)], "node string"))
    kinds = t.nodes.select(F.col("node_id").alias("node"), "kind")
    served = t.of_kind("serves").join(every.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("dst").alias("node"))
    hit = reach.rows.select("node").union(served).distinct().join(kinds, "node")
    sinks = reach.rows.select("node").join(kinds.where("kind = 'cooling_sink'"), "node", "left_semi").orderBy("node")
    zones = hit.where("kind = 'thermal_zone'").select("node").orderBy("node")
    peers = None
    if include_containment_peers:
        holds = t.of_kind("contains").select("src", "dst")
        above = holds.where(F.col("dst") == node).select(F.col("src").alias("node"), F.lit("contains_origin").alias("relation"))
        siblings = holds.join(above.select(F.col("node").alias("src")), "src", "left_semi").where(F.col("dst") != node).select(F.col("dst").alias("node"), F.lit("sibling").alias("relation"))
        below = holds.where(F.col("src") == node).select(F.col("dst").alias("node"), F.lit("contained_by_origin").alias("relation"))
        peers = above.union(siblings).union(below).distinct().orderBy("node", "relation")
    return Blast(reach, sinks, zones, peers)


def connected_components(t: Topology) -> DataFrame:
    """(node, component, isolated): components over edges of all kinds, named by their least member;
    nodes that no edge touches are isolated."""
    numbers = t.numbers()
    nodes, ends = numbers or (t.nodes.select("node_id", F.col("node_id").alias("id")), t.ends().select(F.col("src").alias("a"), F.col("dst").alias("b")))
    rounds = Rounds(t.spark, "named")
    label = tr.components(t, ends).select(F.col("node").alias("id"), "label")
    alone = ends.where("coalesce(a = b, true)").select(F.explode(F.array("a", "b")).alias("id")).where("id IS NOT NULL").distinct()
    of = nodes.join(label, "id", "left").join(alone.withColumn("x", F.lit(True)), "id", "left").select("node_id", "label", F.expr("label IS NULL AND x IS NULL").alias("isolated"))
    if numbers is None:
        return of.select(F.col("node_id").alias("node"), F.coalesce("label", "node_id").alias("component"), "isolated")
    of = rounds.keep(of)
    least = rounds.keep(of.where("label IS NOT NULL").groupBy("label").agg(F.min("node_id").alias("component")))
    return of.join(least, "label", "left").select(F.col("node_id").alias("node"), F.coalesce("component", "node_id").alias("component"), "isolated")
