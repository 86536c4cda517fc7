"""Registered queries of the graph operators over the star-schema projection, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..functions import describe, text
from ..operators import diff as diffs
from ..operators import queries as q
from ..operators import validate
from ..topology import Topology
from . import projection as pj

SOURCE, PLANT, PART, SINK, OTHER = "src:r0", "plant:n1", "mfd:p1", "sink:o1", "sink:o2"
LOOPS = ["loop:s1", "loop:s2"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def joined(*columns: str):
    return [F.array_join(c, ">").alias(c) for c in columns]


EDGES = pj.edges_sql()
SUP = f"e AS ({EDGES}), sup AS (SELECT edge_id, src, dst, from_port, to_port FROM e WHERE kind = 'supplies')"
NODES = pj.nodes_sql()
FED = f"nodes AS ({NODES}), origins AS (SELECT node_id FROM nodes WHERE kind IN ({', '.join(map(repr, schema.SUPPLIERS))}) AND node_id NOT IN (SELECT dst FROM sup))"


def _bfs_sql(start: str, a: str, b: str, port: str, depth: int = 6) -> str:
    """Breadth-first levels with the least (parent, edge) of each node, unrolled to a depth."""
    parts = [f"{SUP}", f"l0 AS (SELECT '{start}' AS node)", "k0 AS (SELECT * FROM l0)"]
    for i in range(1, depth + 1):
        parts.append(f"l{i} AS (SELECT node, parent, via_edge, entered_port FROM (SELECT s.{b} AS node, s.{a} AS parent, s.edge_id AS via_edge, s.{port} AS entered_port, row_number() OVER (PARTITION BY s.{b} ORDER BY s.{a}, s.edge_id) AS rn FROM l{i - 1} l JOIN sup s ON s.{a} = l.node WHERE s.{b} NOT IN (SELECT node FROM k{i - 1})) x WHERE rn = 1)")
        parts.append(f"k{i} AS (SELECT node FROM k{i - 1} UNION ALL SELECT node FROM l{i})")
    levels = " UNION ALL ".join(f"SELECT node, {i} AS depth, parent, via_edge, entered_port FROM l{i}" for i in range(1, depth + 1))
    return f"WITH {', '.join(parts)} {levels}"


@register(_bfs_sql(SOURCE, "src", "dst", "to_port"))
def q2_downstream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.downstream_of(pj.project(spark, sf_dir), SOURCE).rows.select("node", "depth", "parent", "via_edge", "entered_port")


@register(_bfs_sql(SINK, "dst", "src", "from_port"))
def q1_upstream_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.upstream_of(pj.project(spark, sf_dir), SINK).rows.select("node", "depth", "parent", "via_edge", "entered_port")


def _up(*names: str) -> str:
    """A recursive table up(key, node): what is upstream of each name, itself included."""
    seeds = " UNION ALL ".join(f"SELECT '{n}' AS key, '{n}' AS node" for n in names)
    return f"up(key, node) AS ({seeds} UNION SELECT up.key, sup.src FROM up JOIN sup ON sup.dst = up.node)"


@register(f"WITH RECURSIVE {SUP}, {FED}, {_up(SINK)} SELECT DISTINCT node FROM up WHERE node IN (SELECT node_id FROM origins)")
def q3_sources_serving(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.sources_serving(pj.project(spark, sf_dir), SINK)


_PATHS = f"""walk(edges, nodes, node) AS (SELECT [edge_id], [src, dst], dst FROM sup WHERE src = '{SOURCE}'
  UNION ALL SELECT list_append(edges, s.edge_id), list_append(nodes, s.dst), s.dst FROM walk JOIN sup s ON s.src = walk.node WHERE NOT list_contains(walk.nodes, s.dst) AND s.dst IN (SELECT node FROM up))"""


@register(f"""WITH RECURSIVE {SUP}, {_up(SINK)}, {_PATHS}
SELECT row_number() OVER (ORDER BY edges) - 1 AS path_index, array_to_string(edges, '>') AS edges, array_to_string(nodes, '>') AS nodes, false AS passes_pump_host, false AS crosses_changeover, CAST(1 AS BIGINT) AS origin_source_count
FROM walk WHERE node = '{SINK}'""")
def q4_possible_supply_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.possible_supply_paths(pj.project(spark, sf_dir), SOURCE, SINK)[0].rows
    return rows.select("path_index", *joined("edges", "nodes"), "passes_pump_host", "crosses_changeover", "origin_source_count")


@register(f"""WITH RECURSIVE {SUP}, {_up(SINK)}, {_PATHS}, p AS (SELECT row_number() OVER (ORDER BY edges) - 1 AS i, nodes FROM walk WHERE node = '{SINK}'),
t AS (SELECT i, unnest(nodes[2:]) AS node FROM p)
SELECT a.i AS first, b.i AS second, 'xfer:1' AS changeover_id, a.node AS first_node, b.node AS second_node
FROM t a JOIN t b ON a.i < b.i AND a.node <> b.node WHERE a.node LIKE 'mfd:p%' AND b.node LIKE 'mfd:p%'""")
def q5_exclusive_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pj.project(spark, sf_dir)
    members = t.nodes.where("kind = 'manifold'").select(F.lit("xfer:1").alias("changeover_id"), F.lit(0).alias("member_index"), F.col("node_id").alias("node"), F.lit("source_in").alias("port"))
    t.tables["changeovers"] = spark.createDataFrame([("xfer:1", "", 1)], schema.CHANGEOVERS)
    t.tables["changeover_members"] = members
    return q.possible_supply_paths(t, SOURCE, SINK)[1]


@register(f"""WITH RECURSIVE {SUP}, {_up(SINK)}, {_PATHS}, p AS (SELECT edges, nodes FROM walk WHERE node = '{SINK}'),
r AS (SELECT edge_id, src, dst FROM ({pj.edges_sql(returns=True)}) x WHERE kind = 'returns'),
back(edges, nodes, node) AS (SELECT [edge_id], [src, dst], dst FROM r WHERE src = '{SINK}' UNION ALL SELECT list_append(edges, r.edge_id), list_append(nodes, r.dst), r.dst FROM back JOIN r ON r.src = back.node WHERE NOT list_contains(back.nodes, r.dst)),
b AS (SELECT edges FROM back WHERE node = '{SOURCE}' ORDER BY edges LIMIT 1)
SELECT array_to_string(p.edges, '>') AS edges, array_to_string(b.edges, '>') AS return_edges FROM p, b""")
def q6_possible_circuits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.possible_circuits(pj.project(spark, sf_dir, returns=True), SOURCE, SINK).rows.select(*joined("edges", "return_edges"))


@register()
def q7_independent_supply_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.independent_supply_paths(pj.project(spark, sf_dir), SOURCE, SINK).rows.select("path_index", *joined("edges", "nodes"))


@register()
def q7_max_disjoint_supply_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.max_disjoint_supply_paths(pj.project(spark, sf_dir), SOURCE, SINK)


@register(f"WITH RECURSIVE {SUP}, {_up(SINK, OTHER)} SELECT node FROM (SELECT DISTINCT key, node FROM up WHERE key <> node) x WHERE node NOT IN ('{SINK}', '{OTHER}') GROUP BY node HAVING count(*) = 2")
def q8_common_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.common_dependencies(pj.project(spark, sf_dir), [SINK, OTHER])


@register(f"""WITH RECURSIVE {SUP}, {FED}, {_up(*LOOPS)}, inside AS (SELECT DISTINCT node FROM up),
cand AS (SELECT DISTINCT node AS key FROM up WHERE key <> node),
roots AS (SELECT node_id AS node FROM origins WHERE node_id IN (SELECT node FROM inside)),
way(key, node) AS (SELECT c.key, r.node FROM cand c JOIN roots r ON r.node <> c.key UNION SELECT w.key, s.dst FROM way w JOIN sup s ON s.src = w.node WHERE s.dst <> w.key AND s.dst IN (SELECT node FROM inside)),
probed AS (SELECT c.key, s.subject FROM cand c JOIN (SELECT '{LOOPS[0]}' AS subject UNION ALL SELECT '{LOOPS[1]}') s ON s.subject <> c.key),
lost AS (SELECT p.* FROM probed p LEFT JOIN way w ON w.key = p.key AND w.node = p.subject WHERE w.key IS NULL),
n AS (SELECT p.key, count(*) = (SELECT count(*) FROM lost l WHERE l.key = p.key) AS every FROM probed p GROUP BY p.key)
SELECT l.key AS node, l.subject, n.every AS disconnects_all, l.key IN (SELECT node FROM roots) AS is_structural_source FROM lost l JOIN n ON n.key = l.key""")
def q9_single_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.single_points(pj.project(spark, sf_dir), LOOPS)


@register(f"SELECT group_id, member_index, node AS declared FROM ({pj.members_sql()}) m WHERE node = 'loop:s1'")
def q10_redundancy_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.redundancy_membership(pj.project(spark, sf_dir), "loop:s1")


@register(f"""WITH m AS ({pj.members_sql()}), s AS (SELECT m.group_id, m.member_index, concat('src:r', CAST(n_regionkey AS VARCHAR)) AS source FROM m JOIN supplier ON m.node = concat('loop:s', CAST(s_suppkey AS VARCHAR)) JOIN nation ON n_nationkey = s_nationkey),
sh AS (SELECT group_id, source FROM s GROUP BY group_id, source HAVING count(*) >= 2), c AS (SELECT group_id, count(*) AS members FROM m GROUP BY group_id)
SELECT c.group_id, c.members, coalesce((SELECT string_agg(source, '>' ORDER BY source) FROM sh WHERE sh.group_id = c.group_id), '') AS shared_sources, '' AS ancestor_members,
c.group_id NOT IN (SELECT group_id FROM sh) AS independence_holds, CASE WHEN c.group_id IN (SELECT group_id FROM sh) THEN 'declaration_violated' ELSE 'declaration_consistent' END AS verdict FROM c""")
def q11_redundancy_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.redundancy_report(pj.project(spark, sf_dir)).select("group_id", "members", *joined("shared_sources", "ancestor_members"), "independence_holds", "verdict")


@register("""WITH f AS (SELECT DISTINCT l_orderkey, l_partkey, concat('mfd:p', CAST(l_partkey AS VARCHAR)) AS feeder, concat('s-mfd:p', CAST(l_partkey AS VARCHAR), '-sink:o', CAST(l_orderkey AS VARCHAR)) AS edge_id FROM lineitem),
s AS (SELECT DISTINCT f.l_orderkey, f.l_partkey, concat('src:r', CAST(n_regionkey AS VARCHAR)) AS source FROM f JOIN (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) ps ON ps.l_partkey = f.l_partkey JOIN supplier ON s_suppkey = ps.l_suppkey JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT l_orderkey, source, count(*) AS n FROM s GROUP BY 1, 2), a AS (SELECT l_orderkey, string_agg(source, '>' ORDER BY source) AS sources, coalesce(string_agg(source, '>' ORDER BY source) FILTER (n >= 2), '') AS shared FROM c GROUP BY 1),
g AS (SELECT l_orderkey, count(*) AS n, string_agg(feeder, '>' ORDER BY edge_id) AS feeders FROM f GROUP BY 1)
SELECT concat('sink:o', CAST(o_orderkey AS VARCHAR)) AS sink, coalesce(feeders, '') AS feeders, coalesce(sources, '') AS sources, coalesce(shared, '') AS shared_sources,
CASE WHEN g.n IS NULL THEN 'no_structural_feed' WHEN g.n = 1 THEN 'single_feed' WHEN shared <> '' THEN 'multiple_feeds_sharing_dependency' ELSE 'multiple_independent_feeds' END AS verdict
FROM orders LEFT JOIN g ON g.l_orderkey = o_orderkey LEFT JOIN a ON a.l_orderkey = o_orderkey""")
def q12_sink_service_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.sink_reports(pj.project(spark, sf_dir)).select("sink", *joined("feeders", "sources", "shared_sources"), "verdict")


@register("""SELECT concat('zone:c', CAST(c_custkey AS VARCHAR)) AS zone, concat('crah:n', CAST(c_nationkey AS VARCHAR)) AS serving,
coalesce((SELECT string_agg(concat('sink:o', CAST(o_orderkey AS VARCHAR)), '>' ORDER BY concat('sink:o', CAST(o_orderkey AS VARCHAR))) FROM orders WHERE o_custkey = c_custkey), '') AS sinks,
'' AS air_handlers, '' AS groups, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders) THEN 'served' ELSE 'no_contained_sink' END AS verdict FROM customer""")
def q13_zone_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.zone_reports(pj.project(spark, sf_dir)).select("zone", *joined("serving", "sinks", "air_handlers", "groups"), "verdict")


@register(f"""WITH RECURSIVE {SUP}, down(node) AS (SELECT '{PLANT}' UNION SELECT sup.dst FROM down JOIN sup ON sup.src = down.node), sv AS (SELECT src, dst FROM e WHERE kind = 'serves')
SELECT 'sink' AS what, node FROM down WHERE node LIKE 'sink:%' UNION ALL SELECT DISTINCT 'zone', dst FROM sv JOIN down ON src = node""")
def q14_blast_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = q.blast_radius(pj.project(spark, sf_dir), PLANT)
    return b.sinks.select(F.lit("sink").alias("what"), "node").union(b.zones.select(F.lit("zone").alias("what"), "node"))


@register("""SELECT concat('sink:o', CAST(b.o_orderkey AS VARCHAR)) AS node, 'sibling' AS relation FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey WHERE a.o_orderkey = 1
UNION ALL SELECT concat('zone:c', CAST(o_custkey AS VARCHAR)), 'contains_origin' FROM orders WHERE o_orderkey = 1""")
def q14_containment_peers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.blast_radius(pj.project(spark, sf_dir), SINK, include_containment_peers=True).peers


@register(f"""WITH RECURSIVE e AS ({EDGES}), nodes AS ({NODES}), num AS (SELECT node_id, row_number() OVER (ORDER BY node_id) AS i FROM nodes),
adj AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e), start AS (SELECT min(node_id) AS node FROM nodes),
reach(node) AS (SELECT node FROM start UNION SELECT adj.b FROM reach JOIN adj ON adj.a = reach.node)
SELECT n.node_id AS node, CASE WHEN r.node IS NOT NULL THEN (SELECT node FROM start) WHEN t.node IS NULL THEN n.node_id ELSE n.node_id END AS component, t.node IS NULL AS isolated
FROM nodes n LEFT JOIN reach r ON r.node = n.node_id LEFT JOIN (SELECT DISTINCT a AS node FROM adj) t ON t.node = n.node_id""")
def q15_connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.connected_components(pj.project(spark, sf_dir))


def _later(t: Topology) -> Topology:
    """A second generation: orders whose key ends in 7 are gone, manifolds ending in 3 renamed."""
    nodes = t.nodes.where("NOT (kind = 'cooling_sink' AND node_id LIKE '%7')").withColumn("display_name", F.when(F.expr("kind = 'manifold' AND node_id LIKE '%3'"), "renamed").otherwise(F.col("display_name")))
    edges = t.edges.where("NOT (to_node LIKE 'sink:%7') AND NOT (kind = 'serves' AND to_node LIKE '%9')")
    out = Topology(t.spark, {**t.tables, "nodes": nodes, "edges": edges}, replace(t.header, generation=2, parent_generation=1), t.limits)
    out._made["canonical"] = True
    return out


@register(f"""WITH e AS ({EDGES}), n AS ({NODES})
SELECT 'node_removed' AS change, node_id AS subject, '' AS detail FROM n WHERE kind = 'cooling_sink' AND node_id LIKE '%7'
UNION ALL SELECT 'node_changed', node_id, 'name=""->"renamed"' FROM n WHERE kind = 'manifold' AND node_id LIKE '%3'
UNION ALL SELECT 'edge_removed', edge_id, '' FROM e WHERE dst LIKE 'sink:%7' OR (kind = 'serves' AND dst LIKE '%9')""")
def q16_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pj.project(spark, sf_dir)
    return diffs.diff(t, _later(t)).entries


@register(f"""WITH e AS ({EDGES}), n AS ({NODES}), f AS (SELECT * FROM e WHERE NOT (dst LIKE 'sink:%7' OR (kind = 'serves' AND dst LIKE '%9')))
SELECT 'sink' AS what, node_id AS node FROM n WHERE kind = 'cooling_sink' AND node_id NOT LIKE '%7' AND node_id NOT IN (SELECT dst FROM f WHERE kind = 'supplies')
UNION ALL SELECT 'zone', node_id FROM n WHERE kind = 'thermal_zone' AND node_id NOT IN (SELECT dst FROM f WHERE kind = 'serves')""")
def q16_diff_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    sinks, zones = diffs.unfed(_later(pj.project(spark, sf_dir)))
    return sinks.select(F.lit("sink").alias("what"), "node").union(zones.select(F.lit("zone").alias("what"), "node"))


@register(f"SELECT concat('node ', node_id, ' kind=', kind, ' ', CASE kind WHEN 'cooling_source' THEN 'source' WHEN 'cooling_plant' THEN 'plant' WHEN 'cooling_loop' THEN 'loop' WHEN 'cooling_sink' THEN 'sink' WHEN 'thermal_zone' THEN 'class' WHEN 'crah' THEN 'placement' ELSE kind END, '=', subkind, CASE WHEN kind = 'cooling_sink' THEN concat(' consumer=consumer:', node_id) ELSE '' END) AS line FROM ({NODES}) n")
def q18_describe_node(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.project(spark, sf_dir).nodes.select(describe.node().alias("line"))


@register(f"SELECT concat('edge ', edge_id, ' ', kind, ' ', src, '.', from_port, ' -> ', dst, '.', to_port) AS line FROM ({EDGES}) e")
def q18_describe_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.project(spark, sf_dir).edges.select(describe.edge().alias("line"))


@register(f"WITH {SUP}, {FED} SELECT node_id FROM origins")
def a5_structural_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pj.project(spark, sf_dir).structural_sources()


@register(f"WITH e AS ({EDGES}) SELECT 'out' AS side, edge_id FROM e WHERE src = '{PLANT}' UNION ALL SELECT 'in', edge_id FROM e WHERE dst = '{PART}'")
def a3_incident_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = pj.project(spark, sf_dir)
    return t.out_edges(PLANT).select(F.lit("out").alias("side"), "edge_id").union(t.in_edges(PART).select(F.lit("in").alias("side"), "edge_id"))


@register(f"""WITH e AS ({EDGES}), n AS ({NODES})
SELECT 13 AS stage, 'warning' AS severity, 'sink_feed_absent' AS code, node_id AS subject FROM n WHERE kind = 'cooling_sink' AND node_id NOT IN (SELECT dst FROM e WHERE kind = 'supplies')
UNION ALL SELECT 13, 'warning', 'isolated_element', node_id FROM n WHERE node_id NOT IN (SELECT src FROM e UNION SELECT dst FROM e)""")
def v_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.completeness(pj.project(spark, sf_dir)).select("stage", "severity", "code", "subject")


@register(f"""WITH m AS ({pj.members_sql()}), s AS (SELECT m.group_id, m.member_index, m.node, n_regionkey AS r FROM m JOIN supplier ON m.node = concat('loop:s', CAST(s_suppkey AS VARCHAR)) JOIN nation ON n_nationkey = s_nationkey)
SELECT 9 AS stage, 'error' AS severity, 'group_independent_path_unproven' AS code, concat(b.group_id, '/', b.node) AS subject FROM s a JOIN s b ON a.group_id = b.group_id AND a.member_index < b.member_index AND a.r = b.r""")
def v_redundancy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.redundancy(pj.project(spark, sf_dir)).select("stage", "severity", "code", "subject")


@register("SELECT o_orderkey, CASE WHEN mc < 0 THEN '-' ELSE '' END || CAST(abs(mc) // 1000 AS VARCHAR) || '.' || lpad(CAST(abs(mc) % 1000 AS VARCHAR), 3, '0') || 'C' AS shown FROM (SELECT o_orderkey, CAST(o_orderkey % 20001 - 10000 AS BIGINT) AS mc FROM orders) x")
def f_celsius(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", text.celsius((F.col("o_orderkey") % 20001 - 10000).cast("bigint")).alias("shown"))


@register("SELECT event_id, '\"' || replace(replace(props, '\\', '\\\\'), '\"', '\\\"') || '\"' AS escaped, regexp_full_match(event_type, '[A-Za-z0-9]([A-Za-z0-9._:-]{0,126}[A-Za-z0-9])?') AS is_id FROM events")
def f_escape_and_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", text.escaped(F.col("props")).alias("escaped"), text.identifier(F.col("event_type")).alias("is_id"))
