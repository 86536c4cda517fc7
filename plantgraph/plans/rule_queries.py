"""Registered queries of names, rules, sources and scalar functions over a faulty projection.

The projection has the regions, nations, suppliers and customers of the star schema as sources, plants,
loops with a branch and a pump each, and zones, with aliases, media, temperatures, groups and
changeovers, and with faults that follow from the keys. The SQL of each rule is worked out from the
keys, not from the projected tables, wherever the rule does not speak of what the tables hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..errors import PlantError
from ..functions import text
from ..operators import cycles
from ..operators import diff as diffs
from ..operators import traverse as tr
from ..operators import validate
from ..sources import canonical, grammar, store
from ..topology import Header, Topology, ref
from .graph_queries import register


def name(prefix: str, key: str) -> str:
    return f"concat('{prefix}', CAST({key} AS VARCHAR(20)))"


REGION, PLANT, LOOP, BRANCH, PUMP, ZONE, AIR = name("src:r", "r_regionkey"), name("plant:n", "n_nationkey"), name("loop:s", "s_suppkey"), name("br:s", "s_suppkey"), name("pump:s", "s_suppkey"), name("zone:c", "c_custkey"), name("crah:n", "n_nationkey")
OF_SUPPLIER, OF_CUSTOMER = name("plant:n", "s_nationkey"), name("plant:n", "c_nationkey")
#: where a supplier's loop is named by an alias, by an alias of that alias, or by its id
FED_AS = f"CASE WHEN s_suppkey % 4 = 1 THEN {name('line-', 's_suppkey')} WHEN s_suppkey % 10 = 0 THEN {name('two-', 's_suppkey')} ELSE {LOOP} END"
FED_FROM = f"CASE WHEN s_suppkey % 7 = 3 THEN {name('ghost:n', 's_nationkey')} ELSE {OF_SUPPLIER} END"
LOST_FROM, LOST_TO = "s_suppkey % 7 = 3", "s_suppkey % 10 = 0 AND s_suppkey % 4 <> 1"

#: (columns of nodes, table, condition); suppkey % 29 = 4 names a loop twice, the last row is misnamed
NODES = [
    (REGION, "cooling_source", "facility_water", "CASE WHEN r_regionkey % 2 = 0 THEN 'chilled_water' ELSE 'glycol' END", "5000 + 1000 * r_regionkey", "NULL", "region", ""),
    (PLANT, "cooling_plant", "chiller_plant", "'chilled_water'", "1000 * (n_nationkey % 12)", "6000 + 1000 * (n_nationkey % 5)", "nation", ""),
    (LOOP, "cooling_loop", None, "CASE s_suppkey % 3 WHEN 0 THEN 'glycol' WHEN 1 THEN 'chilled_water' END", "NULL", "1000 * (s_suppkey % 10)", "supplier", ""),
    (LOOP, "cooling_loop", None, "CASE s_suppkey % 3 WHEN 0 THEN 'glycol' WHEN 1 THEN 'chilled_water' END", "NULL", "1000 * (s_suppkey % 10)", "supplier", "WHERE s_suppkey % 29 = 4"),
    (BRANCH, "branch", "rack_branch", "NULL", "NULL", "CASE WHEN s_suppkey % 47 = 5 THEN 20000000 END", "supplier", ""),
    (PUMP, "pump", "centrifugal", "NULL", "NULL", "NULL", "supplier", ""),
    (ZONE, "thermal_zone", "room", "NULL", "NULL", "NULL", "customer", ""),
    (AIR, "crah", "perimeter", "NULL", "NULL", "NULL", "nation", ""),
    (name("-bad-", "s_suppkey"), "manifold", "supply", "NULL", "NULL", "NULL", "supplier", "WHERE s_suppkey % 43 = 1"),
]
#: (edge, kind, from, port, to, port, table, condition)
EDGES = [
    (name("e-rn-", "n_nationkey"), "supplies", name("src:r", "n_regionkey"), "'supply_out'", PLANT, "source_in", "nation", ""),
    (name("e-pl-", "s_suppkey"), "supplies", FED_FROM, "CASE WHEN s_suppkey % 11 = 5 THEN 'heat_out' ELSE 'supply_out' END", FED_AS, "source_in", "supplier", ""),
    (name("e-dup-", "s_suppkey"), "supplies", FED_FROM, "CASE WHEN s_suppkey % 11 = 5 THEN 'heat_out' ELSE 'supply_out' END", FED_AS, "source_in", "supplier", "WHERE s_suppkey % 17 = 2"),
    (name("e-self-", "s_suppkey"), "supplies", LOOP, "'supply_out'", LOOP, "source_in", "supplier", "WHERE s_suppkey % 13 = 6"),
    (name("e-ll-", "s_suppkey"), "supplies", LOOP, "'supply_out'", name("loop:s", "s_suppkey + 1"), "source_in", "supplier", "WHERE s_suppkey % 23 = 8"),
    (name("e-pz-", "c_custkey"), "serves", OF_CUSTOMER, "'server'", ZONE, "served", "customer", "WHERE c_custkey % 50 = 7"),
    (name("e-zl-", "c_custkey"), "supplies", ZONE, "'supply_out'", name("loop:s", "1"), "source_in", "customer", "WHERE c_custkey % 60 = 9"),
    (name("e-az-", "c_custkey"), "serves", name("crah:n", "c_nationkey"), "'server'", ZONE, "served", "customer", "WHERE c_custkey % 50 <> 7 AND c_custkey % 3 <> 0"),
    (name("e-c-", "s_suppkey"), "contains", LOOP, "'container'", BRANCH, "contained", "supplier", "WHERE s_suppkey % 5 <> 0"),
    (name("e-c2-", "s_suppkey"), "contains", name("loop:s", "1"), "'container'", BRANCH, "contained", "supplier", "WHERE s_suppkey % 6 = 1"),
    (name("e-p-", "s_suppkey"), "pumps", LOOP, "'supply_out'", PUMP, "terminal", "supplier", "WHERE s_suppkey % 8 <> 0"),
    (name("e-p2-", "s_suppkey"), "pumps", LOOP, "'return_in'", PUMP, "terminal", "supplier", "WHERE s_suppkey % 9 = 4"),
    (name("e-d-", "s_suppkey"), "depends_on", BRANCH, "'terminal'", LOOP, "terminal", "supplier", "WHERE s_suppkey = 3"),
]
#: (alias, target, table, condition)
ALIASES = [
    (name("line-", "s_suppkey"), LOOP, "supplier", ""),
    (name("line-", "s_suppkey"), LOOP, "supplier", "WHERE s_suppkey % 31 = 5"),
    (name("two-", "s_suppkey"), name("line-", "s_suppkey"), "supplier", "WHERE s_suppkey % 10 = 0"),
    (LOOP, "'src:r0'", "supplier", "WHERE s_suppkey % 37 = 2"),
    (name("lost-", "s_suppkey"), "'nowhere'", "supplier", "WHERE s_suppkey % 41 = 3"),
    (name("bad alias ", "s_suppkey"), LOOP, "supplier", "WHERE s_suppkey % 53 = 9"),
]
GROUP, XFER = name("grp:n", "s_nationkey"), name("xfer:n", "s_nationkey")
#: (group, order, node, failure domain, table, condition)
MEMBERS = [
    (GROUP, "s_suppkey", LOOP, f"CASE WHEN s_suppkey % 3 <> 0 THEN {name('fd-', 's_suppkey % 4')} END", "supplier", ""),
    (name("grp:n", "n_nationkey"), "0", PLANT, "'fd-x'", "nation", "WHERE n_nationkey % 5 = 0"),
    (name("grp:n", "n_nationkey"), "-1", name("ghost:", "n_nationkey"), "'fd-y'", "nation", "WHERE n_nationkey % 4 = 0"),
]
#: (changeover, order, node, port, table, condition)
ENDS = [
    (XFER, "2 * s_suppkey", LOOP, "CASE WHEN s_suppkey % 5 = 1 THEN 'supply_out' ELSE 'source_in' END", "supplier", ""),
    (XFER, "2 * s_suppkey + 1", LOOP, "'source_in'", "supplier", "WHERE s_suppkey % 7 = 2"),
    (name("xfer:n", "n_nationkey"), "0", name("ghost:", "n_nationkey"), "'source_in'", "nation", "WHERE n_nationkey % 4 = 0"),
]


def union(parts: list[str]) -> str:
    return "\nUNION ALL ".join(parts)


EDGES_SQL = union([f"SELECT {e} AS edge_id, '{kind}' AS kind, {a} AS from_node, {ap} AS from_port, {b} AS to_node, '{bp}' AS to_port FROM {table} {where}" for e, kind, a, ap, b, bp, table, where in EDGES])
NODES_SQL = union([f"SELECT {n} AS node_id, '{kind}' AS kind, {repr(sub) if sub else chr(39).join(('CASE WHEN s_suppkey % 2 = 0 THEN ', 'secondary', ' ELSE ', 'primary', ' END'))} AS subkind, {medium} AS medium, CAST({design} AS BIGINT) AS design, CAST({most} AS BIGINT) AS most FROM {table} {where}" for n, kind, sub, medium, design, most, table, where in NODES])
ALIASES_SQL = union([f"SELECT {a} AS alias_id, {b} AS target FROM {table} {where}" for a, b, table, where in ALIASES])


def _indexed(rows: list[tuple], columns: str, of: str) -> str:
    every = union([f"SELECT {g} AS {of}, {o} AS place, {x} AS node, {y} AS {columns} FROM {table} {where}" for g, o, x, y, table, where in rows])
    return f"SELECT {of}, CAST(row_number() OVER (PARTITION BY {of} ORDER BY place) - 1 AS INT) AS member_index, node, {columns} FROM ({every}) x"


MEMBERS_SQL, ENDS_SQL = _indexed(MEMBERS, "domain", "group_id"), _indexed(ENDS, "port", "changeover_id")


def faulty(spark: SparkSession, sf_dir: str) -> Topology:
    for table in ("region", "nation", "supplier", "customer"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    none = {f.name: F.lit(None).cast(f.dataType) for f in schema.NODES.fields}
    nodes = spark.sql(NODES_SQL).withColumnsRenamed({"design": "design_supply_mc", "most": "max_supply_mc"})
    nodes = nodes.withColumns({"pump_role": F.when(F.col("kind") == "pump", "duty"), "consumer": none["consumer"], "display_name": F.lit(""), "refs": F.array().cast(schema.NODES["refs"].dataType)}).select(*schema.NODES.fieldNames())
    members = spark.sql(MEMBERS_SQL)
    domain = F.when(F.col("domain").isNotNull(), F.struct(F.lit("failure_domain").alias("kind"), F.col("domain").alias("identity"), F.lit(0).cast(schema.U64).alias("generation")))
    groups = members.select("group_id").distinct().select("group_id", F.lit("n_plus_one").alias("scheme"), F.lit("cooling_loop").alias("scope"), F.lit("").alias("display_name"), F.lit("").alias("basis"), (F.regexp_extract("group_id", "([0-9]+)", 1).cast("int") % 2 == 0).alias("require_distinct_failure_domains"), F.lit(False).alias("require_independent_sources"))
    ends = spark.sql(ENDS_SQL)
    tables = {
        "nodes": nodes,
        "edges": spark.sql(EDGES_SQL),
        "aliases": spark.sql(ALIASES_SQL),
        "groups": groups,
        "group_members": members.select("group_id", "member_index", "node", F.col("node").alias("declared"), domain.alias("failure_domain")),
        "changeovers": ends.select("changeover_id").distinct().select("changeover_id", F.lit("").alias("display_name"), F.lit(1).cast("bigint").alias("max_concurrent")),
        "changeover_members": ends.select("changeover_id", "member_index", "node", "port"),
    }
    return Topology(spark, tables, Header(facility=ref("facility", "dc-1", 7), producer="projection", origin="imported"), schema.UNBOUNDED)


def issues(df: DataFrame) -> DataFrame:
    return df.select("stage", "severity", "code", "subject")


def rules(stage: int, *parts: tuple[str, str, str], severity: str = "error") -> str:
    """SQL of issues: (code, subject, from and where)."""
    return union([f"SELECT {stage} AS stage, '{severity}' AS severity, '{code}' AS code, {subject} AS subject FROM {rest}" for code, subject, rest in parts])


# -- names ---------------------------------------------------------------------------------------
#: what a name in an edge stands for, worked out from the spelling
NAMED = "CASE WHEN {x} LIKE 'ghost%' OR {x} LIKE 'two-%' THEN NULL WHEN {x} LIKE 'line-%' THEN replace({x}, 'line-', 'loop:s') ELSE {x} END"
RESOLVED = f"SELECT edge_id, kind, from_port, to_port, {NAMED.format(x='from_node')} AS src, {NAMED.format(x='to_node')} AS dst FROM ({EDGES_SQL}) e WHERE NOT (edge_id LIKE 'e-ll-%' AND to_node NOT IN (SELECT {LOOP} FROM supplier))"


@register(union([f"SELECT DISTINCT {n} AS name, {n} AS node_id, '{kind}' AS kind FROM {table} {where}" for n, kind, *_, table, where in NODES if where != "WHERE s_suppkey % 29 = 4"] + [f"SELECT {name('line-', 's_suppkey')}, {LOOP}, 'cooling_loop' FROM supplier", f"SELECT {name('bad alias ', 's_suppkey')}, {LOOP}, 'cooling_loop' FROM supplier WHERE s_suppkey % 53 = 9"]))
def g1_name_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty(spark, sf_dir).lookup


@register(f"SELECT edge_id, kind, src, dst FROM ({RESOLVED}) r UNION ALL SELECT edge_id, kind, {NAMED.format(x='from_node')}, NULL FROM ({EDGES_SQL}) e WHERE edge_id LIKE 'e-ll-%' AND to_node NOT IN (SELECT {LOOP} FROM supplier)")
def g2_edges_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty(spark, sf_dir).edges_resolved.select("edge_id", "kind", "src", "dst")


@register(f"SELECT {name('e-self-', 's_suppkey')} AS edge_id FROM supplier WHERE {LOOP} = (SELECT min({LOOP}) FROM supplier WHERE s_suppkey % 13 = 6)")
def g3_find_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(e,) for e in cycles.find_cycle(faulty(spark, sf_dir), "supplies")], "edge_id string")


@register("""SELECT 'pump' AS member, concat('src:r', CAST(n_regionkey AS VARCHAR)) AS source FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 4
UNION ALL SELECT 'loop', concat('src:r', CAST(n_regionkey AS VARCHAR)) FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE s_suppkey = 2""")
def g6_member_source_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sources of a pump are those of the loop that hosts it."""
    t = faulty(spark, sf_dir)
    members = spark.createDataFrame([("pump", "pump:s4"), ("loop", "loop:s2")], "key string, node string")
    return tr.source_sets(t, members).select(F.col("key").alias("member"), "source")


@register("SELECT 'line-1' AS name, 'loop:s1' AS node_id, 'cooling_loop' AS kind UNION ALL SELECT 'loop:s2', 'loop:s2', 'cooling_loop' UNION ALL SELECT 'pump:s3', 'pump:s3', 'pump' UNION ALL SELECT 'two-10', 'not_found', '' UNION ALL SELECT '', 'malformed_identifier', ''")
def a1_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, out = faulty(spark, sf_dir), []
    for x in ("line-1", "loop:s2", "pump:s3", "two-10", ""):
        try:
            out.append((x, *t.resolve(x)))
        except PlantError as e:
            out.append((x, e.code, ""))
    return spark.createDataFrame(out, "name string, node_id string, kind string")


@register("""SELECT 'node' AS what, 'loop:s1' AS id, concat('most ', CAST(1000 AS VARCHAR)) AS said UNION ALL SELECT 'edge', 'e-p-1', 'pumps' UNION ALL SELECT 'group', 'grp:n1', 'cooling_loop'
UNION ALL SELECT 'alias', 'line-2', 'loop:s2' UNION ALL SELECT 'changeover', 'xfer:n1', '1'""")
def a2_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = faulty(spark, sf_dir)
    parts = [
        t.find_node("line-1").select(F.lit("node").alias("what"), F.col("node_id").alias("id"), F.concat(F.lit("most "), F.col("max_supply_mc").cast("string")).alias("said")),
        t.find_edge("e-p-1").select(F.lit("edge"), "edge_id", "kind"),
        t.find_group("grp:n1").select(F.lit("group"), "group_id", "scope"),
        t.find_alias("line-2").select(F.lit("alias"), "alias_id", "target"),
        t.find_changeover("xfer:n1").select(F.lit("changeover"), "changeover_id", F.col("max_concurrent").cast("string")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


@register(f"SELECT {name('e-az-', 'c_custkey')} AS edge_id, {name('crah:n', 'c_nationkey')} AS from_node FROM customer WHERE c_custkey % 50 <> 7 AND c_custkey % 3 <> 0 UNION ALL SELECT {name('e-pz-', 'c_custkey')}, {OF_CUSTOMER} FROM customer WHERE c_custkey % 50 = 7")
def a4_edges_of_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faulty(spark, sf_dir).edges_of_kind("serves").select("edge_id", "from_node")


@register("""SELECT (SELECT count(*) FROM region) + 2 * (SELECT count(*) FROM nation) + (SELECT 3 * count(*) + count(*) FILTER (s_suppkey % 29 = 4) + count(*) FILTER (s_suppkey % 43 = 1) FROM supplier) + (SELECT count(*) FROM customer) AS nodes,
(SELECT count(*) FROM nation) + (SELECT count(*) + count(*) FILTER (s_suppkey % 17 = 2) + count(*) FILTER (s_suppkey % 13 = 6) + count(*) FILTER (s_suppkey % 23 = 8) + count(*) FILTER (s_suppkey % 5 <> 0) + count(*) FILTER (s_suppkey % 6 = 1) + count(*) FILTER (s_suppkey % 8 <> 0) + count(*) FILTER (s_suppkey % 9 = 4) + count(*) FILTER (s_suppkey = 3) FROM supplier)
 + (SELECT count(*) FILTER (c_custkey % 50 = 7) + count(*) FILTER (c_custkey % 60 = 9) + count(*) FILTER (c_custkey % 50 <> 7 AND c_custkey % 3 <> 0) FROM customer) AS edges,
(SELECT count(DISTINCT k) FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT n_nationkey FROM nation WHERE n_nationkey % 5 = 0 OR n_nationkey % 4 = 0) x) AS groups""")
def a6_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = faulty(spark, sf_dir)
    return spark.createDataFrame([(t.node_count(), t.edge_count(), t.group_count())], "nodes long, edges long, groups long")


@register("SELECT 'dc-1' AS facility, 'projection' AS producer, 'imported' AS origin, 1 AS generation, 0 AS parent, (SELECT count(*) FROM nation) AS plants")
def a7_to_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = faulty(spark, sf_dir)
    t.header.generation, t.header.parent_generation = 5, 4
    d = t.to_draft()
    h = d.header
    return spark.createDataFrame([(h.facility[1], h.producer, h.origin, h.generation, h.parent_generation, d.nodes.where("kind = 'cooling_plant'").count())], "facility string, producer string, origin string, generation int, parent int, plants long")


# -- rules ---------------------------------------------------------------------------------------
@register(rules(0, ("malformed_identifier", name("-bad-", "s_suppkey"), "supplier WHERE s_suppkey % 43 = 1"), ("quantity_out_of_range", BRANCH, "supplier WHERE s_suppkey % 47 = 5"), ("malformed_identifier", name("bad alias ", "s_suppkey"), "supplier WHERE s_suppkey % 53 = 9"),
    ("changeover_cardinality", "id", f"(SELECT changeover_id AS id FROM ({ENDS_SQL}) y GROUP BY changeover_id HAVING count(*) < 2) z")))
def v0_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.shape(faulty(spark, sf_dir)))


@register(rules(1, ("duplicate_identifier", LOOP, "supplier WHERE s_suppkey % 29 = 4"), ("duplicate_identifier", name("line-", "s_suppkey"), "supplier WHERE s_suppkey % 31 = 5"), ("identity_conflict", LOOP, "supplier WHERE s_suppkey % 37 = 2"), ("alias_cycle", name("two-", "s_suppkey"), "supplier WHERE s_suppkey % 10 = 0"), ("alias_target_missing", name("lost-", "s_suppkey"), "supplier WHERE s_suppkey % 41 = 3")))
def v1_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.identity(faulty(spark, sf_dir)))


_PL, _DUP, _SELF, _LL = (name(f"e-{x}-", "s_suppkey") for x in ("pl", "dup", "self", "ll"))


@register(rules(2, ("endpoint_missing", _PL, f"supplier WHERE {LOST_FROM}"), ("endpoint_missing", _PL, f"supplier WHERE {LOST_TO}"), ("endpoint_missing", _DUP, f"supplier WHERE s_suppkey % 17 = 2 AND {LOST_FROM}"), ("endpoint_missing", _DUP, f"supplier WHERE s_suppkey % 17 = 2 AND {LOST_TO}"), ("self_edge", _SELF, "supplier WHERE s_suppkey % 13 = 6"), ("duplicate_edge", _PL, "supplier WHERE s_suppkey % 17 = 2"), ("duplicate_edge", "'e-c2-1'", "supplier WHERE s_suppkey = 1"),
    ("endpoint_missing", _LL, f"supplier WHERE s_suppkey % 23 = 8 AND s_suppkey + 1 NOT IN (SELECT s_suppkey FROM supplier)")))
def v2_endpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.endpoint(faulty(spark, sf_dir)))


_KNOWN = f"NOT ({LOST_FROM}) AND NOT ({LOST_TO})"


@register(rules(3, ("plant_boundary_invalid", name("e-pz-", "c_custkey"), "customer WHERE c_custkey % 50 = 7"), ("invalid_edge_kind_pair", name("e-zl-", "c_custkey"), "customer WHERE c_custkey % 60 = 9"), ("invalid_edge_endpoint_pair", _PL, f"supplier WHERE s_suppkey % 11 = 5 AND {_KNOWN}"), ("invalid_edge_endpoint_pair", _DUP, f"supplier WHERE s_suppkey % 17 = 2 AND s_suppkey % 11 = 5 AND {_KNOWN}")))
def v3_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.role(faulty(spark, sf_dir)))


@register(rules(4, ("supply_cycle", "edge_id", f"(SELECT {name('e-self-', 's_suppkey')} AS edge_id FROM supplier WHERE {LOOP} = (SELECT min({LOOP}) FROM supplier WHERE s_suppkey % 13 = 6)) x")) + "\nUNION ALL " + rules(11, ("dependency_cycle", "'e-c-3'", "supplier WHERE s_suppkey = 3")))
def v4_v8_v11_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = faulty(spark, sf_dir)
    return issues(validate.circuit(t).unionByName(validate.service(t)).unionByName(validate.dependency(t)))


_HOT = "1000 * (s_nationkey % 12) > 1000 * (s_suppkey % 10)"


@register(rules(5, ("medium_mismatch", name("e-rn-", "n_nationkey"), "nation WHERE n_regionkey % 2 = 1"), ("temperature_incompatible", name("e-rn-", "n_nationkey"), "nation WHERE n_regionkey % 2 = 0 AND 5000 + 1000 * n_regionkey > 6000 + 1000 * (n_nationkey % 5)"),
    *(part for e, also in ((_PL, "true"), (_DUP, "s_suppkey % 17 = 2")) for part in (("medium_mismatch", e, f"supplier WHERE {also} AND {_KNOWN} AND s_suppkey % 3 = 0"), ("temperature_incompatible", e, f"supplier WHERE {also} AND {_KNOWN} AND s_suppkey % 3 <> 0 AND {_HOT}"))),
    ("medium_mismatch", _LL, "supplier WHERE s_suppkey % 23 = 8 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AND s_suppkey % 3 = 0"),
    ("loop_kind_mismatch", _LL, "supplier WHERE s_suppkey % 23 = 8 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) AND s_suppkey % 3 <> 0 AND s_suppkey % 2 = 0")))
def v5_medium(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.medium(faulty(spark, sf_dir)))


@register(rules(6, ("ambiguous_parentage", BRANCH, "supplier WHERE s_suppkey % 6 = 1 AND s_suppkey % 5 <> 0"), ("missing_container", BRANCH, "supplier WHERE s_suppkey % 6 <> 1 AND s_suppkey % 5 = 0")))
def v6_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.containment(faulty(spark, sf_dir)))


@register(rules(7, ("pump_attachment_invalid", PUMP, "supplier WHERE s_suppkey % 8 = 0 AND s_suppkey % 9 <> 4"), ("pump_attachment_invalid", PUMP, "supplier WHERE s_suppkey % 8 <> 0 AND s_suppkey % 9 = 4")))
def v7_attachment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.attachment(faulty(spark, sf_dir)))


_LABEL = "concat(group_id, '/', node)"


@register(rules(9, ("group_member_missing", f"concat({name('grp:n', 'n_nationkey')}, '/', {name('ghost:', 'n_nationkey')})", "nation WHERE n_nationkey % 4 = 0"), ("group_scope_invalid", f"concat({name('grp:n', 'n_nationkey')}, '/', {PLANT})", "nation WHERE n_nationkey % 5 = 0"),
    ("group_redundancy_unproven", f"concat({GROUP}, '/', {LOOP})", "supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 3 = 0"),
    ("group_redundancy_unproven", f"concat({GROUP}, '/', {LOOP})", f"(SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey, s_suppkey % 4 ORDER BY {LOOP}) AS n FROM supplier WHERE s_nationkey % 2 = 0 AND s_suppkey % 3 <> 0) x WHERE n > 1")))
def v9_failure_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.redundancy(faulty(spark, sf_dir)))


_GOOD = "s_suppkey % 5 <> 1"


@register(rules(10, ("changeover_member_invalid", f"concat({name('xfer:n', 'n_nationkey')}, '/', {name('ghost:', 'n_nationkey')})", "nation WHERE n_nationkey % 4 = 0"), ("changeover_member_invalid", f"concat({XFER}, '/', {LOOP})", f"supplier WHERE NOT ({_GOOD})"), ("changeover_member_duplicate", f"concat({XFER}, '/', {LOOP})", f"supplier WHERE {_GOOD} AND s_suppkey % 7 = 2"),
    ("constraint_unsatisfied", f"concat({XFER}, '/', {LOOP})", f"supplier WHERE ({_GOOD} OR s_suppkey % 7 = 2) AND {LOOP} NOT IN (SELECT dst FROM ({RESOLVED}) r WHERE dst IS NOT NULL AND to_port = 'source_in')")))
def v10_changeover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.changeover(faulty(spark, sf_dir)))


@register(rules(13, ("isolated_element", name("-bad-", "s_suppkey"), "supplier WHERE s_suppkey % 43 = 1"), ("isolated_element", BRANCH, "supplier WHERE s_suppkey % 5 = 0 AND s_suppkey % 6 <> 1 AND s_suppkey <> 3"), ("isolated_element", PUMP, "supplier WHERE s_suppkey % 8 = 0 AND s_suppkey % 9 <> 4"),
    ("isolated_element", "node_id", f"(SELECT DISTINCT node_id FROM ({NODES_SQL}) n WHERE (node_id LIKE 'loop:%' OR node_id LIKE 'plant:%' OR node_id LIKE 'src:%' OR node_id LIKE 'crah:%') AND node_id NOT IN (SELECT src FROM ({RESOLVED}) r WHERE src IS NOT NULL UNION SELECT dst FROM ({RESOLVED}) r WHERE dst IS NOT NULL)) x"),
    ("isolated_element", ZONE, "customer WHERE c_custkey % 3 = 0 AND c_custkey % 50 <> 7 AND c_custkey % 60 <> 9"), ("zone_service_absent", ZONE, "customer WHERE c_custkey % 3 = 0 AND c_custkey % 50 <> 7"), severity="warning"))
def v13_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return issues(validate.completeness(faulty(spark, sf_dir))).distinct()


# -- sources -------------------------------------------------------------------------------------
def small(spark: SparkSession, sf_dir: str) -> Topology:
    """Regions and nations alone: valid, and as small as a document must be."""
    for table in ("region", "nation"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    empty = {f.name: F.lit(None).cast(f.dataType) for f in schema.NODES.fields}
    nodes = spark.sql(union([f"SELECT {REGION} AS node_id, 'cooling_source' AS kind, 'well' AS subkind FROM region", f"SELECT {PLANT}, 'cooling_plant', 'chiller_plant' FROM nation"]))
    nodes = nodes.withColumns({c: v for c, v in empty.items() if c not in ("node_id", "kind", "subkind")}).withColumn("display_name", F.concat(F.lit("the "), "kind")).select(*schema.NODES.fieldNames())
    edges = spark.sql(f"SELECT {name('e-rn-', 'n_nationkey')} AS edge_id, 'supplies' AS kind, {name('src:r', 'n_regionkey')} AS from_node, 'supply_out' AS from_port, {PLANT} AS to_node, 'source_in' AS to_port FROM nation")
    return Topology(spark, {"nodes": nodes, "edges": edges, "aliases": spark.createDataFrame([("first", "src:r0")], schema.ALIASES)}, Header(facility=ref("facility", "dc-1", 7), producer="projection", witness="by hand"))


_SMALL = union([f"SELECT 'node' AS what, {REGION} AS id, 'the cooling_source' AS said FROM region", f"SELECT 'node', {PLANT}, 'the cooling_plant' FROM nation", f"SELECT 'edge', {name('e-rn-', 'n_nationkey')}, {name('src:r', 'n_regionkey')} FROM nation", "SELECT 'alias', 'first', 'src:r0'"])


def said(t: Topology) -> DataFrame:
    return t.nodes.select(F.lit("node").alias("what"), F.col("node_id").alias("id"), F.col("display_name").alias("said")).union(t.edges.select(F.lit("edge"), "edge_id", "from_node")).union(t.aliases.select(F.lit("alias"), "alias_id", "target"))


@register(_SMALL)
def s1_s2_grammar_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = small(spark, sf_dir)
    return said(grammar.read(spark, grammar.write(canonical.order(canonical.rows_of(t)), t.header)))


@register(_SMALL)
def s3_s6_image_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built, framed, unframed, decoded and checked."""
    _, image = canonical.build(small(spark, sf_dir))
    return said(canonical.load(spark, canonical.unframe(canonical.frame(image))))


@register("SELECT 1 AS generation, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS nodes, 'closed, verified' AS said UNION ALL SELECT 2, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) - 1, 'closed, verified'")
def s7_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two generations published to a store, loaded from it and verified; the store is on the driver."""
    import tempfile

    t = small(spark, sf_dir)
    one = canonical.rows_of(t)
    last = max(r[0] for r in one["nodes"] if r[1] == "cooling_plant")
    two = one | {"nodes": [r for r in one["nodes"] if r[0] != last], "edges": [e for e in one["edges"] if e[4] != last]}
    with tempfile.TemporaryDirectory() as folder:
        s = store.Store.create(spark, f"{folder}/store", "s-1", t.header.facility, durable=False)
        for i, rows in enumerate((one, two), 1):
            s.publish(Topology.of_rows(spark, rows, t.header), s.authority(), f"m{i}")
        counts = [(g, s.load(g).node_count()) for g in (1, 2)]
        good = "verified" if s.verify().where("severity = 'defect'").isEmpty() else "defects"
        s.close()
        out = [(g, n, f"{'open' if s.is_open() else 'closed'}, {good}") for g, n in counts]
    return spark.createDataFrame(out, "generation int, nodes long, said string")


# -- more queries --------------------------------------------------------------------------------
@register("SELECT 'delta' AS what, 'nodes delta -1, edges delta -1' AS line UNION ALL SELECT 'change', concat('node_removed plant:n', CAST(max(n_nationkey) AS VARCHAR)) FROM nation WHERE concat('plant:n', CAST(n_nationkey AS VARCHAR)) = (SELECT max(concat('plant:n', CAST(n_nationkey AS VARCHAR))) FROM nation) UNION ALL SELECT 'change', concat('edge_removed e-rn-', CAST(max(n_nationkey) AS VARCHAR)) FROM nation WHERE concat('plant:n', CAST(n_nationkey AS VARCHAR)) = (SELECT max(concat('plant:n', CAST(n_nationkey AS VARCHAR))) FROM nation)")
def q17_explain_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = small(spark, sf_dir)
    last = t.nodes.where("kind = 'cooling_plant'").agg(F.max("node_id")).first()[0]
    after = Topology(spark, {**t.tables, "nodes": t.nodes.where(F.col("node_id") != last), "edges": t.edges.where(F.col("to_node") != last)}, t.header, t.limits)
    lines = diffs.explain(diffs.diff(t, after))
    return spark.createDataFrame([("delta" if "delta" in x else "change", x) for x in lines if "delta" in x or "removed" in x], "what string, line string")


@register(f"SELECT concat('edge ', {name('e-rn-', 'n_nationkey')}, ' supplies ', {name('src:r', 'n_regionkey')}, '.supply_out -> ', {PLANT}, '.source_in') AS line FROM nation UNION ALL SELECT 'alias first -> src:r0' UNION ALL SELECT 'generation 1'")
def q19_render_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import render

    lines = render.render(small(spark, sf_dir)).splitlines()
    return spark.createDataFrame([(x,) for x in lines if x.split(" ")[0] in ("edge", "alias", "generation")], "line string")


@register("SELECT c_custkey, TRY_CAST(CASE WHEN regexp_full_match(x, '0|[1-9][0-9]{0,19}') THEN x END AS HUGEINT)::VARCHAR AS number, length(x) <= 4 AS shown FROM (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN concat('0', CAST(c_custkey AS VARCHAR)) WHEN 1 THEN concat('-', CAST(c_custkey AS VARCHAR)) ELSE CAST(c_custkey AS VARCHAR) END AS x FROM customer) y")
def f_uint64_and_display_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey").cast("string")
    x = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("0"), key)).when(F.col("c_custkey") % 5 == 1, F.concat(F.lit("-"), key)).otherwise(key)
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", x.alias("x"))
    return customers.select("c_custkey", text.uint64(F.col("x")).cast("string").alias("number"), text.display_text(F.col("x"), 4).alias("shown"))
