"""Registered queries of cycles, bounded searches, routes and the reports' rarer answers.

Their graphs are made from the tables' keys by one SQL text that Spark and DuckDB both run; the answers'
SQL is worked out by another way than the engine's: transitive closures instead of peeling, lists of
all walks instead of counts, cuts instead of flows, or rules over the keys.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators import cycles, validate
from ..operators import diff as diffs
from ..operators import queries as q
from ..sources import canonical, generator
from ..topology import Header, Topology, ref
from . import projection as pj
from .graph_queries import ORACLES, PLANT, SINK, SOURCE, joined, register
from .rule_queries import issues, name, rules, union

LOOP = name("loop:s", "s_suppkey")

# -- cycles --------------------------------------------------------------------------------------
#: suppliers of a nation in a row: its edges are of one kind; the loops of some nations form a ring with
#: chords, those of the others a star; the first loop of a nation leads to that of the next of its kind
_RANKED = "SELECT s_suppkey AS k, s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS r, count(*) OVER (PARTITION BY s_nationkey) AS size FROM supplier"
_KIND = "CASE a.n % 4 WHEN 0 THEN 'supplies' WHEN 1 THEN 'returns' WHEN 2 THEN 'contains' ELSE 'depends_on' END"
_RING = "a.n % 8 < 4"


def _tangled_edge(letter: str, where: str) -> str:
    return f"SELECT concat('{letter}-', CAST(a.k AS VARCHAR(20)), '-', CAST(b.k AS VARCHAR(20))) AS edge_id, {_KIND} AS kind, {name('loop:s', 'a.k')} AS src, {name('loop:s', 'b.k')} AS dst FROM ranked a JOIN ranked b ON {where}"


TANGLED = union([_tangled_edge("g", f"a.n = b.n AND {_RING} AND b.r = (a.r + 1) % a.size"), _tangled_edge("g", f"a.n = b.n AND NOT {_RING} AND a.r = 0 AND b.r > 0"), _tangled_edge("h", f"a.n = b.n AND {_RING} AND b.r = a.r - 1 AND a.k % 3 = 0"), _tangled_edge("b", "a.n + 4 = b.n AND a.r = 0 AND b.r = 0")])
#: The rules that forbid cycles, over which kinds.
CHECKS = {"supply": ("supplies",), "return": ("returns",), "containment": ("contains",), "dependency": ("depends_on", "contains")}


def tangled(spark: SparkSession, sf_dir: str) -> Topology:
    spark.read.parquet(f"{sf_dir}/supplier.parquet").createOrReplaceTempView("supplier")
    edges = spark.sql(f"WITH ranked AS ({_RANKED}) {TANGLED}").select("edge_id", "kind", F.col("src").alias("from_node"), F.lit("terminal").alias("from_port"), F.col("dst").alias("to_node"), F.lit("terminal").alias("to_port"))
    none = {f.name: F.lit(None).cast(f.dataType) for f in schema.NODES.fields}
    nodes = spark.sql(f"SELECT {LOOP} AS node_id FROM supplier").withColumns({k: v for k, v in none.items() if k != "node_id"} | {"kind": F.lit("cooling_loop"), "subkind": F.lit("primary")}).select(*schema.NODES.fieldNames())
    t = Topology(spark, {"nodes": nodes, "edges": edges}, Header(facility=ref("facility", "dc-1", 7), producer="projection", origin="imported"), schema.UNBOUNDED)
    t._made["canonical"] = True
    return t


_CHECKED = union([f"SELECT '{c}' AS rule, edge_id, src, dst FROM e WHERE kind IN ({', '.join(map(repr, kinds))})" for c, kinds in CHECKS.items()])


@register(f"""WITH ranked AS ({_RANKED}), rings AS (SELECT a.n, min({name('loop:s', 'a.k')}) AS component FROM ranked a WHERE {_RING} GROUP BY a.n)
SELECT x.rule, {name('loop:s', 'a.k')} AS node, component FROM ranked a JOIN rings ON rings.n = a.n JOIN (SELECT 'supply' AS rule, 0 AS m UNION ALL SELECT 'return', 1 UNION ALL SELECT 'containment', 2 UNION ALL SELECT 'dependency', 2 UNION ALL SELECT 'dependency', 3) x ON x.m = a.n % 4""")
def g3_strong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which loops lie on cycles of each kind, several components a kind."""
    return cycles.strong_components(tangled(spark, sf_dir), CHECKS).withColumnRenamed("name", "rule")


#: the walk along least edges that can still reach a cycle, from a closure of what reaches what
_WITNESS = f"""ranked AS ({_RANKED}), e AS ({TANGLED}), c AS ({_CHECKED}),
ahead(rule, a, b) AS (SELECT rule, src, dst FROM c UNION SELECT ahead.rule, ahead.a, c.dst FROM ahead JOIN c ON c.rule = ahead.rule AND c.src = ahead.b),
loops AS (SELECT rule, a AS node FROM ahead WHERE a = b), doomed AS (SELECT rule, node FROM loops UNION SELECT ahead.rule, ahead.a FROM ahead JOIN loops ON loops.rule = ahead.rule AND loops.node = ahead.b),
least AS (SELECT rule, src, edge_id, dst FROM (SELECT c.rule, c.src, c.edge_id, c.dst, row_number() OVER (PARTITION BY c.rule, c.src ORDER BY c.edge_id) AS i FROM c JOIN doomed d ON d.rule = c.rule AND d.node = c.dst) x WHERE i = 1),
walk(rule, nodes, node, over) AS (SELECT rule, [min(src)], min(src), false FROM least GROUP BY rule
  UNION ALL SELECT w.rule, list_append(w.nodes, l.dst), l.dst, list_contains(w.nodes, l.dst) FROM walk w JOIN least l ON l.rule = w.rule AND l.src = w.node WHERE NOT w.over),
ends AS (SELECT rule, nodes, node FROM walk WHERE over), met AS (SELECT rule, unnest(nodes[list_position(nodes, node):]) AS node FROM ends)"""


@register(f"WITH RECURSIVE {_WITNESS} SELECT DISTINCT met.rule, l.edge_id FROM met JOIN least l ON l.rule = met.rule AND l.src = met.node")
def g3_cycle_witness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges of the cycle that a search of each kind closes first."""
    return cycles.cycles(tangled(spark, sf_dir), CHECKS).select(F.col("name").alias("rule"), F.explode("edges").alias("edge_id"))


_OF = {"supply": (4, "supply_cycle"), "return": (4, "return_cycle"), "containment": (6, "containment_cycle"), "dependency": (11, "dependency_cycle")}


@register(f"""WITH RECURSIVE {_WITNESS}, w AS (SELECT met.rule, min(l.edge_id) AS subject FROM met JOIN least l ON l.rule = met.rule AND l.src = met.node GROUP BY met.rule)
{union([f"SELECT {stage} AS stage, 'error' AS severity, '{code}' AS code, subject FROM w WHERE rule = '{rule}'" for rule, (stage, code) in _OF.items()])}
UNION ALL SELECT 11, 'error', 'dependency_cycle', min(edge_id) FROM (WITH RECURSIVE {_WITNESS.replace("'depends_on', 'contains'", "'depends_on'")} SELECT l.edge_id FROM met JOIN least l ON l.rule = met.rule AND l.src = met.node WHERE met.rule = 'dependency') y""")
def v4_v6_v11_cycle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cycles of supplies, returns, containment and dependencies, several of each."""
    t = tangled(spark, sf_dir)
    every = validate.circuit(t).unionByName(validate.containment(t)).unionByName(validate.dependency(t))
    return issues(every.where("code LIKE '%cycle'"))


# -- bounded paths and routes --------------------------------------------------------------------
#: the loop's sink with the most ways to it
_TARGET = "SELECT l_orderkey AS o FROM (SELECT l_orderkey, count(DISTINCT b.l_partkey) AS n FROM lineitem b WHERE l_partkey IN (SELECT a.l_partkey FROM lineitem a WHERE a.l_suppkey = 1) GROUP BY l_orderkey) x ORDER BY n DESC, l_orderkey LIMIT 1"
START, BUDGET = "loop:s1", 5000


def _target(t: Topology) -> str:
    return f"sink:o{t.spark.sql(_TARGET).first().o}"


_WALKS = f"""e AS ({pj.edges_sql()}), target AS (SELECT concat('sink:o', CAST(o AS VARCHAR)) AS node FROM ({_TARGET}) y),
walk(edges, node) AS (SELECT CAST([] AS VARCHAR[]), '{START}' UNION ALL SELECT list_append(w.edges, e.edge_id), e.dst FROM walk w JOIN e ON e.src = w.node WHERE e.kind = 'supplies' AND w.node NOT IN (SELECT node FROM target)),
looked AS (SELECT list_append(w.edges, e.edge_id) AS at, e.kind FROM walk w JOIN e ON e.src = w.node WHERE w.node NOT IN (SELECT node FROM target)),
p AS (SELECT edges, row_number() OVER (ORDER BY edges) - 1 AS i FROM walk WHERE node IN (SELECT node FROM target)),
t AS (SELECT p.i, p.edges, (SELECT count(*) FROM looked WHERE looked.at <= p.edges) AS steps, (SELECT count(*) FROM looked WHERE looked.at > p.edges AND kind = 'supplies') AS later FROM p)"""


@register(f"""WITH RECURSIVE {_WALKS}, cut AS (SELECT 'none' AS bound, false AS truncated UNION ALL SELECT 'paths', coalesce((SELECT later > 0 FROM t WHERE i = 1), false) UNION ALL SELECT 'search', (SELECT count(*) FROM looked) > {BUDGET})
SELECT cut.bound, cut.truncated, t.i AS path_index, array_to_string(t.edges, '>') AS edges FROM cut JOIN t ON cut.bound = 'none' OR (cut.bound = 'paths' AND i < 2) OR (cut.bound = 'search' AND steps <= {BUDGET})
UNION ALL SELECT bound, truncated, -1, '' FROM cut""")
def q4_bounded_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths under no bound, a bound of two and a budget of inspected edges, and whether each was cut."""
    t = pj.project(spark, sf_dir)
    target, parts = _target(t), []
    for bound, own in {"none": {}, "paths": {"most": 2}, "search": {"search": BUDGET}}.items():
        found, _, _ = q.possible_supply_paths(t, START, target, **own)
        rows = found.rows.select("path_index", *joined("edges")).union(spark.createDataFrame([(-1, "")], "path_index long, edges string"))
        parts.append(rows.select(F.lit(bound).alias("bound"), F.lit(found.truncated).alias("truncated"), "path_index", "edges"))
    return parts[0].union(parts[1]).union(parts[2])


_FLAGS = f"""WITH RECURSIVE e AS ({pj.edges_sql()}), sup AS (SELECT edge_id, src, dst FROM e WHERE kind = 'supplies'), up(node) AS (SELECT '{SINK}' UNION SELECT sup.src FROM up JOIN sup ON sup.dst = up.node),
walk(edges, nodes, node) AS (SELECT [edge_id], [src, dst], dst FROM sup WHERE src = '{SOURCE}' UNION ALL SELECT list_append(edges, s.edge_id), list_append(nodes, s.dst), s.dst FROM walk JOIN sup s ON s.src = walk.node WHERE s.dst IN (SELECT node FROM up)),
p AS (SELECT row_number() OVER (ORDER BY edges) - 1 AS path_index, nodes[3] AS loop_node, nodes[4] AS part FROM walk WHERE node = '{SINK}')
SELECT path_index, CAST(substr(loop_node, 7) AS BIGINT) % 2 = 0 AS passes_pump_host, CAST(substr(part, 6) AS BIGINT) % 2 = 0 AS crosses_changeover, CAST(1 AS BIGINT) AS origin_source_count FROM p"""


@register(_FLAGS)
def q4_path_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second loop hosts a pump, every second manifold is a member of a changeover."""
    t = pj.project(spark, sf_dir, pumps=True)
    t.tables["edges"] = t.edges.where("NOT (kind = 'pumps' AND try_cast(substr(from_node, 7) AS bigint) % 2 = 1)")
    even = t.nodes.where("kind = 'manifold' AND try_cast(substr(node_id, 6) AS bigint) % 2 = 0")
    t.tables["changeovers"] = spark.createDataFrame([("xfer:1", "", 1)], schema.CHANGEOVERS)
    t.tables["changeover_members"] = even.select(F.lit("xfer:1").alias("changeover_id"), F.lit(0).alias("member_index"), F.col("node_id").alias("node"), F.lit("source_in").alias("port"))
    found, _, _ = q.possible_supply_paths(t, SOURCE, SINK)
    return found.rows.select("path_index", "passes_pump_host", "crosses_changeover", "origin_source_count")


@register(f"""WITH target AS ({_TARGET}), p AS (SELECT DISTINCT {name('mfd:p', 'l_partkey')} AS part, {name('sink:o', 'l_orderkey')} AS sink FROM lineitem WHERE l_orderkey IN (SELECT o FROM target) AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_suppkey = 1))
SELECT row_number() OVER (ORDER BY part) - 1 AS path_index, concat('s-{START}-', part, '>s-', part, '-', sink) AS edges, concat('{START}>', part, '>', sink) AS nodes FROM p""")
def q7_greedy_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routes that share no edge, the least first."""
    t = pj.project(spark, sf_dir)
    return q.independent_supply_paths(t, START, _target(t)).rows.select("path_index", *joined("edges", "nodes"))


#: the least cut: some manifolds are left on the source's side and cut off from the sink, of the others
#: every nation that supplies one is cut off from the source
_CUTS = """WITH way AS (SELECT DISTINCT l.l_partkey AS part, n.n_nationkey AS nation FROM lineitem l JOIN supplier ON s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s_nationkey WHERE n.n_regionkey = 0 AND l.l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 1)),
parts AS (SELECT part, row_number() OVER (ORDER BY part) - 1 AS i FROM (SELECT DISTINCT part FROM way) x), power AS (SELECT i, CAST(pow(2, i) AS BIGINT) AS bit, part FROM parts),
sides AS (SELECT range AS side FROM range(CAST((SELECT pow(2, count(*)) FROM parts) AS BIGINT))),
inside AS (SELECT side, count(part) FILTER (side // bit % 2 = 1) AS cut_off FROM sides LEFT JOIN power ON true GROUP BY side),
outside AS (SELECT side, count(DISTINCT nation) AS cut_off FROM sides JOIN power ON side // bit % 2 = 0 JOIN way ON way.part = power.part GROUP BY side)
SELECT CAST(min(inside.cut_off + coalesce(outside.cut_off, 0)) AS BIGINT) AS routes FROM inside LEFT JOIN outside ON outside.side = inside.side"""


#: the same search over the layers' keys: the least manifold that is left, its least loop, that loop's plant
_ROUTES = f"""WITH RECURSIVE way AS (SELECT DISTINCT {name('plant:n', 'n_nationkey')} AS plant, {name('loop:s', 's_suppkey')} AS loop_, {name('mfd:p', 'l_partkey')} AS part FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
  WHERE n_regionkey = 0 AND l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_orderkey = 1)),
r(i, plants, parts, loop_) AS (SELECT CAST(-1 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), ''
  UNION ALL SELECT i + 1, list_append(plants, plant), list_append(parts, part), loop_ FROM (SELECT r.i, r.plants, r.parts, w.plant, w.part, w.loop_, row_number() OVER (PARTITION BY r.i ORDER BY w.part, w.loop_) AS place FROM r JOIN way w ON NOT list_contains(r.plants, w.plant) AND NOT list_contains(r.parts, w.part)) x WHERE place = 1)
SELECT i AS path_index, concat('s-{SOURCE}-', plants[-1], '>s-', plants[-1], '-', loop_, '>s-', loop_, '-', parts[-1], '>s-', parts[-1], '-{SINK}') AS edges, concat('{SOURCE}>', plants[-1], '>', loop_, '>', parts[-1], '>{SINK}') AS nodes FROM r WHERE i >= 0"""
ORACLES |= {"q7_max_disjoint_supply_paths": _CUTS, "q7_independent_supply_paths": _ROUTES}


# -- reports -------------------------------------------------------------------------------------
_GROUPS = f"""SELECT {name('grp:n', 's_nationkey')} AS group_id, s_nationkey AS n, s_suppkey AS place, {LOOP} AS node FROM supplier
UNION ALL SELECT {name('grp:n', 'n_nationkey')}, n_nationkey, -1, {name('src:r', 'n_regionkey')} FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT {name('grp:n', 'n_nationkey')}, n_nationkey, -2, {name('zone:c', 'min(c_custkey)')} FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 7 = 1 GROUP BY n_nationkey"""


@register(f"""WITH m AS ({_GROUPS}), s AS (SELECT group_id, place, {name('src:r', 'n_regionkey')} AS source FROM m JOIN nation ON n_nationkey = n WHERE place <> -2),
sh AS (SELECT group_id, min(source) AS source FROM s GROUP BY group_id HAVING count(*) >= 2), c AS (SELECT group_id, n, count(*) AS members, min(place) AS least, count(*) FILTER (place >= 0) AS loops FROM m GROUP BY group_id, n)
SELECT c.group_id, c.members, coalesce(sh.source, '') AS shared_sources, CASE WHEN c.n % 3 = 0 AND loops > 0 THEN sh.source ELSE '' END AS ancestor_members, NOT (least = -2 OR (c.n % 2 = 0 AND sh.source IS NOT NULL)) AS independence_holds,
CASE WHEN least = -2 OR (c.n % 2 = 0 AND sh.source IS NOT NULL) THEN 'declaration_violated' WHEN c.n % 2 = 0 THEN 'declaration_consistent' ELSE 'independence_unproven' END AS verdict FROM c LEFT JOIN sh ON sh.group_id = c.group_id""")
def q11_groups_with_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups whose members supply each other, have no source, or promise nothing."""
    t = pj.project(spark, sf_dir)
    m = spark.sql(f"SELECT group_id, n, CAST(row_number() OVER (PARTITION BY group_id ORDER BY place) - 1 AS INT) AS member_index, node FROM ({_GROUPS}) x")
    t.tables["group_members"] = m.select("group_id", "member_index", "node", F.col("node").alias("declared"), F.lit(None).cast(schema.REF).alias("failure_domain"))
    t.tables["groups"] = m.select("group_id", "n").distinct().select("group_id", F.lit("n_plus_one").alias("scheme"), F.lit("cooling_loop").alias("scope"), F.lit("").alias("display_name"), F.lit("").alias("basis"), F.lit(False).alias("require_distinct_failure_domains"), (F.col("n") % 2 == 0).alias("require_independent_sources"))
    return q.redundancy_report(t).select("group_id", "members", *joined("shared_sources", "ancestor_members"), "independence_holds", "verdict")


@register(f"""WITH s AS (SELECT o_custkey, string_agg({name('sink:o', 'o_orderkey')}, '>' ORDER BY {name('sink:o', 'o_orderkey')}) AS sinks FROM orders GROUP BY 1)
SELECT {name('zone:c', 'c_custkey')} AS zone, CASE WHEN c_nationkey % 4 = 3 THEN '' ELSE {name('crah:n', 'c_nationkey')} END AS serving, coalesce(sinks, '') AS sinks, CASE WHEN c_custkey % 10 = 1 THEN {name('crah:n', 'c_nationkey')} ELSE '' END AS air_handlers,
CASE WHEN c_nationkey % 4 <> 3 OR c_custkey % 10 = 1 THEN {name('grp:a', 'c_nationkey % 3')} ELSE '' END AS groups,
CASE WHEN c_nationkey % 4 <> 3 AND sinks IS NOT NULL THEN 'served' WHEN sinks IS NOT NULL THEN 'no_serving_element' WHEN c_nationkey % 4 <> 3 THEN 'no_contained_sink' ELSE 'unpopulated' END AS verdict FROM customer LEFT JOIN s ON o_custkey = c_custkey""")
def q13_zones_with_air_handlers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zones that contain air handlers, zones of nations that serve none, and groups over the handlers."""
    t = pj.project(spark, sf_dir)
    inner = spark.sql(f"SELECT {name('c-air-', 'c_custkey')} AS edge_id, 'contains' AS kind, {name('zone:c', 'c_custkey')} AS from_node, 'container' AS from_port, {name('crah:n', 'c_nationkey')} AS to_node, 'contained' AS to_port FROM customer WHERE c_custkey % 10 = 1")
    t.tables["edges"] = t.edges.where("NOT (kind = 'serves' AND try_cast(substr(from_node, 7) AS int) % 4 = 3)").unionByName(inner)
    air = spark.sql(f"SELECT {name('grp:a', 'n_nationkey % 3')} AS group_id, CAST(n_nationkey AS INT) AS member_index, {name('crah:n', 'n_nationkey')} AS node FROM nation")
    t.tables["group_members"] = air.select("group_id", "member_index", "node", F.col("node").alias("declared"), F.lit(None).cast(schema.REF).alias("failure_domain"))
    return q.zone_reports(t).select("zone", *joined("serving", "sinks", "air_handlers", "groups"), "verdict")


@register(f"""WITH n AS ({pj.nodes_sql()}), c AS (SELECT o_custkey, min({name('sink:o', 'o_orderkey')}) AS least FROM orders GROUP BY 1)
SELECT node_id AS node, coalesce(a.least, b.least, node_id) AS component, a.least IS NULL AND b.least IS NULL AS isolated FROM n LEFT JOIN (SELECT {name('zone:c', 'o_custkey')} AS zone, least FROM c) a ON a.zone = node_id
LEFT JOIN (SELECT {name('sink:o', 'o_orderkey')} AS sink, least FROM orders JOIN c ON c.o_custkey = orders.o_custkey) b ON b.sink = node_id""")
def q15_many_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A component for each customer's zone, when containment alone connects."""
    t = pj.project(spark, sf_dir)
    t.tables["edges"] = t.edges.where("kind = 'contains'")
    return q.connected_components(t)


def _pair(spark: SparkSession, sf_dir: str) -> tuple[Topology, Topology]:
    """Two generations with groups, aliases and changeovers that come, go and change."""
    out = []
    for late in (False, True):
        t = pj.project(spark, sf_dir)
        flip = F.expr("try_cast(substr(group_id, 6) AS int) % 3 = 0") if late else F.lit(False)
        t.tables["groups"] = t.groups.where(f"try_cast(substr(group_id, 6) AS int) % 5 <> {2 if late else 3}").withColumn("require_independent_sources", F.col("require_independent_sources") & ~flip)
        keys = t.nodes.where("kind = 'cooling_loop'").selectExpr("node_id", "try_cast(substr(node_id, 7) AS bigint) k")
        t.tables["aliases"] = keys.where(f"k % 4 <> {2 if late else 3}").select(F.concat(F.lit("line-"), "k").alias("alias_id"), F.when((F.col("k") % 7 == 1) & F.lit(late), F.lit(PLANT)).otherwise(F.col("node_id")).alias("target"))
        t.tables["changeovers"] = keys.where(f"k % 6 <> {2 if late else 3}").select(F.concat(F.lit("xfer-"), "k").alias("changeover_id"), F.lit("").alias("display_name"), F.when((F.col("k") % 5 == 0) & F.lit(late), 2).otherwise(1).cast("bigint").alias("max_concurrent"))
        t.tables["changeover_members"] = keys.select(F.concat(F.lit("xfer-"), "k").alias("changeover_id"), F.lit(0).alias("member_index"), F.col("node_id").alias("node"), F.lit("source_in").alias("port"))
        if late:
            t.tables["nodes"] = t.nodes.unionByName(t.nodes.where("kind = 'crah'").withColumn("node_id", F.concat(F.lit("new-"), "node_id")))
            t.header = replace(t.header, generation=2, parent_generation=1)
        out.append(t)
    return out[0], out[1]


_K, _N = "CAST(s_suppkey AS VARCHAR(20))", "CAST(s_nationkey AS VARCHAR(20))"


@register(f"""WITH g AS (SELECT DISTINCT s_nationkey, count(*) OVER (PARTITION BY s_nationkey) AS m FROM supplier)
SELECT 'node_added' AS change, concat('new-crah:n', CAST(n_nationkey AS VARCHAR(20))) AS subject, '' AS detail FROM nation
UNION ALL SELECT 'group_added', concat('grp:n', {_N}), '' FROM g WHERE s_nationkey % 5 = 3 UNION ALL SELECT 'group_removed', concat('grp:n', {_N}), '' FROM g WHERE s_nationkey % 5 = 2
UNION ALL SELECT 'group_changed', concat('grp:n', {_N}), 'independent-sources=true->false' FROM g WHERE s_nationkey % 5 NOT IN (2, 3) AND s_nationkey % 3 = 0
UNION ALL SELECT 'alias_added', concat('line-', {_K}), '' FROM supplier WHERE s_suppkey % 4 = 3 UNION ALL SELECT 'alias_removed', concat('line-', {_K}), '' FROM supplier WHERE s_suppkey % 4 = 2
UNION ALL SELECT 'alias_added', concat('line-', {_K}), concat('target=', {LOOP}, '->{PLANT}') FROM supplier WHERE s_suppkey % 4 NOT IN (2, 3) AND s_suppkey % 7 = 1
UNION ALL SELECT 'changeover_added', concat('xfer-', {_K}), '' FROM supplier WHERE s_suppkey % 6 = 3 UNION ALL SELECT 'changeover_removed', concat('xfer-', {_K}), '' FROM supplier WHERE s_suppkey % 6 = 2
UNION ALL SELECT 'changeover_changed', concat('xfer-', {_K}), 'max-concurrent=1->2' FROM supplier WHERE s_suppkey % 6 NOT IN (2, 3) AND s_suppkey % 5 = 0""")
def q16_diff_of_every_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diffs.diff(*_pair(spark, sf_dir)).entries


@register(f"""WITH ranked AS ({_RANKED}) SELECT {name('loop:s', 'a.k')} AS a, {name('loop:s', 'b.k')} AS b, a.n % 3 <> 0 AND a.k <> b.k AND a.k % 4 <> 1 AND b.k % 4 <> 1 AS never_together FROM ranked a JOIN ranked b ON a.n = b.n AND b.r IN (a.r, (a.r + 1) % a.size)""")
def q20_mutually_exclusive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbouring loops of a nation, and each with itself, asked for in the nation's changeover."""
    t = pj.project(spark, sf_dir)
    ranked = spark.sql(_RANKED)
    group = F.concat(F.lit("xfer:n"), "n").alias("changeover_id")
    t.tables["changeovers"] = ranked.select(group, F.lit("").alias("display_name"), F.when(F.col("n") % 3 == 0, 2).otherwise(1).cast("bigint").alias("max_concurrent")).distinct()
    t.tables["changeover_members"] = ranked.where("k % 4 <> 1").select(group, F.col("r").cast("int").alias("member_index"), F.concat(F.lit("loop:s"), "k").alias("node"), F.lit("source_in").alias("port"))
    asked = spark.sql(f"WITH ranked AS ({_RANKED}) SELECT concat('xfer:n', a.n) AS changeover_id, concat('loop:s', a.k) AS a_node, 'source_in' AS a_port, concat('loop:s', b.k) AS b_node, 'source_in' AS b_port FROM ranked a JOIN ranked b ON a.n = b.n AND b.r IN (a.r, (a.r + 1) % a.size)")
    return q.mutually_exclusive(t, asked).select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "never_together")


#: (part, kind, bytes beside the leg's number, how often that stands in it) of a leg's rows, and (part, kind, rows, bytes) of the trunk's
_LEG = [("node", "branch", 41, 1), ("node", "cooling_sink", 55, 2), ("node", "crah", 30, 1)]
_LEG += [("edge", kind, 15 + sum(len(x.rstrip("*")) for x in (e, a, b)), 1 + (a + b).count("*")) for e, kind, a, _, b, _ in generator.LEG]
_TRUNK = [("node", "cooling_source", 1, 30), ("node", "cooling_loop", 2, 80), ("node", "thermal_zone", 1, 20), ("edge", "supplies", 2, 76), ("edge", "returns", 2, 76)]


@register(f"""WITH legs AS (SELECT CAST(range AS VARCHAR) AS k FROM range(CAST((SELECT count(*) FROM supplier) AS BIGINT))), n AS (SELECT count(*) AS n, CAST(coalesce(sum(length(k)), 0) AS BIGINT) AS digits FROM legs),
leg(part, kind, bytes, times) AS (VALUES {', '.join(map(str, _LEG))}), trunk(part, kind, n, bytes) AS (VALUES {', '.join(map(str, _TRUNK))}),
own AS (SELECT part, kind, CAST(sum(n) AS BIGINT) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT part, kind, n, n * bytes + digits * times AS bytes FROM leg, n UNION ALL SELECT part, kind, n, bytes FROM trunk) x WHERE n > 0 GROUP BY part, kind),
image AS (SELECT CAST(sum(own.n) AS BIGINT) AS n, CAST(sum(bytes) + 174 + (SELECT length(CAST(n AS VARCHAR)) FROM n) AS BIGINT) AS bytes FROM own)
SELECT part, kind, n AS "rows", bytes FROM own UNION ALL SELECT 'image', '', n, bytes FROM image UNION ALL SELECT 'file', '', n, bytes + 52 FROM image""")
def s8_workload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synthetic facility with a leg for each supplier: its nodes, its edges, its image and its file."""
    legs = spark.read.parquet(f"{sf_dir}/supplier.parquet").count()
    return canonical.sizes(generator.workload(spark, legs, schema.UNBOUNDED))


@register(rules(12, ("duplicate_field", name("p", "n_nationkey"), "nation WHERE n_nationkey % 3 = 0")))
def v12_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third nation binds the same evidence twice in a row."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    times = F.explode(F.expr("CASE WHEN n_nationkey % 3 = 0 THEN array(1, 1, 2) ELSE array(1, 2) END")).alias("generation")
    rows = nations.select("n_nationkey", times)
    subject = F.struct(F.lit("registry").alias("kind"), F.concat(F.lit("x"), "n_nationkey").alias("identity"), F.lit(0).cast(schema.U64).alias("generation"))
    evidence = rows.select(F.lit(schema.EVIDENCE_KINDS[0]).alias("kind"), F.concat(F.lit("p"), "n_nationkey").alias("producer"), subject.alias("subject"), F.col("generation").cast(schema.U64).alias("generation"), F.lit(0).cast(schema.U64).alias("observation"))
    return issues(validate.binding(Topology(spark, {"evidence": evidence}, Header(), schema.UNBOUNDED)))
