"""A facility graph projected from star-schema tables, for queries at scale, and its SQL.

Regions are sources, nations plants (and air handlers), suppliers loops, parts manifolds, orders
sinks, customers zones. Layers: returns run against every supply but those to air handlers; every
supplier's loop has a pump; the loops of a nation form a redundancy group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..topology import Header, Topology, ref

#: name of a node from its table's key
PREFIX = {"region": "src:r", "nation": "plant:n", "supplier": "loop:s", "part": "mfd:p", "orders": "sink:o", "customer": "zone:c", "air": "crah:n"}
#: (letter, kind, from prefix, from port, to prefix, to port, SQL of the key pairs)
LAYERS = [
    ("s", "supplies", "src:r", "supply_out", "plant:n", "source_in", "SELECT n_regionkey a, n_nationkey b FROM nation"),
    ("s", "supplies", "plant:n", "supply_out", "loop:s", "source_in", "SELECT s_nationkey a, s_suppkey b FROM supplier"),
    ("s", "supplies", "loop:s", "supply_out", "mfd:p", "source_in", "SELECT DISTINCT l_suppkey a, l_partkey b FROM lineitem"),
    ("s", "supplies", "mfd:p", "supply_out", "sink:o", "source_in", "SELECT DISTINCT l_partkey a, l_orderkey b FROM lineitem"),
    ("c", "contains", "zone:c", "container", "sink:o", "contained", "SELECT o_custkey a, o_orderkey b FROM orders"),
    ("s", "supplies", "plant:n", "supply_out", "crah:n", "source_in", "SELECT n_nationkey a, n_nationkey b FROM nation"),
    ("v", "serves", "crah:n", "server", "zone:c", "served", "SELECT c_nationkey a, c_custkey b FROM customer"),
]
NODES = [
    ("src:r", "cooling_source", "facility_water", "SELECT r_regionkey k FROM region"),
    ("plant:n", "cooling_plant", "chiller_plant", "SELECT n_nationkey k FROM nation"),
    ("loop:s", "cooling_loop", "primary", "SELECT s_suppkey k FROM supplier"),
    ("mfd:p", "manifold", "supply", "SELECT p_partkey k FROM part"),
    ("sink:o", "cooling_sink", "rack_load", "SELECT o_orderkey k FROM orders"),
    ("zone:c", "thermal_zone", "room", "SELECT c_custkey k FROM customer"),
    ("crah:n", "crah", "perimeter", "SELECT n_nationkey k FROM nation"),
]


def _edge_sql(layer: tuple, keyed: bool = False) -> str:
    letter, kind, a, ap, b, bp, keys = layer
    src, dst = f"concat('{a}', CAST(a AS VARCHAR(20)))", f"concat('{b}', CAST(b AS VARCHAR(20)))"
    told = f", '{a}' AS src_group, CAST(a AS BIGINT) AS src_key, '{b}' AS dst_group, CAST(b AS BIGINT) AS dst_key" if keyed else ""
    return f"SELECT concat('{letter}-', {src}, '-', {dst}) AS edge_id, '{kind}' AS kind, {src} AS src, '{ap}' AS from_port, {dst} AS dst, '{bp}' AS to_port{told} FROM ({keys}) t"


def edges_sql(returns: bool = False, pumps: bool = False, keyed: bool = False) -> str:
    """The resolved edges, as SQL that Spark and DuckDB both run; keyed: with group and key of each end."""
    parts = [_edge_sql(x, keyed) for x in LAYERS]
    if returns:
        for letter, kind, a, _, b, _, keys in LAYERS:
            if kind == "supplies" and b != "crah:n":
                parts.append(_edge_sql(("r", "returns", b, "heat_out", a, "return_in", keys.replace(" a,", " b_,").replace(" b FROM", " a FROM").replace(" b_,", " b,")), keyed))
    if pumps:
        parts.append(_edge_sql(("p", "pumps", "loop:s", "supply_out", "pump:s", "terminal", "SELECT s_suppkey a, s_suppkey b FROM supplier"), keyed))
    return "\nUNION ALL ".join(parts)


def nodes_sql(pumps: bool = False, keyed: bool = False) -> str:
    def told(p: str) -> str:
        return f", '{p}' AS name_group, CAST(k AS BIGINT) AS name_key" if keyed else ""

    own = [*NODES, *([("pump:s", "pump", "centrifugal", "SELECT s_suppkey k FROM supplier")] if pumps else [])]
    return "\nUNION ALL ".join(f"SELECT concat('{p}', CAST(k AS VARCHAR(20))) AS node_id, '{kind}' AS kind, '{sub}' AS subkind{told(p)} FROM ({q}) t" for p, kind, sub, q in own)


#: groups of names as numbers tell them apart, about the fewest first: nodes that pick their least neighbour pick hubs
GROUPS = ["src:r", "plant:n", "crah:n", "loop:s", "pump:s", "zone:c", "mfd:p", "sink:o"]
#: bits of a number that are the key's
KEY = 56


def number_sql(group: str, key: str) -> str:
    """One number for each name of a group and a key from 0 to 2 to the ``KEY``; its group's place comes first."""
    places = " ".join(f"WHEN '{g}' THEN {i}L" for i, g in enumerate(GROUPS))
    return f"shiftleft(CASE {group} {places} END, {KEY}) + {key}"


def _odd(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows with a key that a number has no room for."""
    return rows.where(" OR ".join(f"{k} < 0 OR {k} >= {1 << KEY}L" for k in keys))


def members_sql() -> str:
    """Loops of a nation, as members of its redundancy group."""
    return "SELECT concat('grp:n', CAST(s_nationkey AS VARCHAR(20))) AS group_id, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS INT) AS member_index, concat('loop:s', CAST(s_suppkey AS VARCHAR(20))) AS node FROM supplier"


def project(spark: SparkSession, sf_dir: str, returns: bool = False, pumps: bool = False, limits: schema.Limits = schema.UNBOUNDED) -> Topology:
    """The graph over the tables of a folder. Names are ids already, so nothing is resolved."""
    session = spark
    for name in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"):
        session.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)
    nodes = session.sql(nodes_sql(pumps))
    none = {f.name: F.lit(None).cast(f.dataType) for f in schema.NODES.fields}
    consumer = F.when(F.col("kind") == "cooling_sink", F.struct(F.lit("consumer").alias("kind"), F.col("node_id").alias("identity"), F.lit(0).cast(schema.U64).alias("generation")))
    extra = none | {"consumer": consumer, "display_name": F.lit(""), "refs": F.array().cast(schema.NODES["refs"].dataType), "pump_role": F.when(F.col("kind") == "pump", "duty")}
    nodes = nodes.withColumns({k: v for k, v in extra.items() if k not in ("node_id", "kind", "subkind")}).select(*schema.NODES.fieldNames())
    edges = session.sql(edges_sql(returns, pumps)).select("edge_id", "kind", F.col("src").alias("from_node"), "from_port", F.col("dst").alias("to_node"), "to_port")
    members = session.sql(members_sql()).select("group_id", "member_index", "node", F.col("node").alias("declared"), F.lit(None).cast(schema.REF).alias("failure_domain"))
    groups = members.select("group_id").distinct().select("group_id", F.lit("n_plus_one").alias("scheme"), F.lit("cooling_loop").alias("scope"), F.lit("").alias("display_name"), F.lit("").alias("basis"), F.lit(False).alias("require_distinct_failure_domains"), F.lit(True).alias("require_independent_sources"))
    header = Header(facility=ref("facility", "dc-1", 7), producer="projection", origin="imported")
    t = Topology(spark, {"nodes": nodes, "edges": edges, "groups": groups, "group_members": members}, header, limits)
    t._made["canonical"] = True
    told = edges_sql(returns, pumps, keyed=True)
    columns = ["edge_id", "kind", F.col("src").alias("from_node"), "from_port", F.col("dst").alias("to_node"), "to_port", "src", "dst", "src_group", "src_key", "dst_group", "dst_key"]
    t._made["keyed"] = session.sql(told).select(*columns), edges
    # the same edges, some more than once: no shuffle for those that need not tell
    loose = session.sql(told.replace("SELECT DISTINCT", "SELECT"))
    t._made["loose"] = loose.select(*columns), edges
    keyed = session.sql(nodes_sql(pumps, keyed=True))
    ends = loose.selectExpr(f"{number_sql('src_group', 'src_key')} AS a", f"{number_sql('dst_group', 'dst_key')} AS b")
    odd = _odd(keyed, "name_key"), _odd(loose, "src_key", "dst_key")
    t._made["numbers"] = keyed.selectExpr("node_id", f"{number_sql('name_group', 'name_key')} AS id"), nodes, ends, edges, odd
    return t


def reach_sql(start: str, forward: bool) -> str:
    """A recursive CTE ``reach(node)``: everything over supplies from start, start included."""
    a, b = ("src", "dst") if forward else ("dst", "src")
    return f"e AS ({edges_sql()}), sup AS (SELECT DISTINCT src, dst FROM e WHERE kind = 'supplies'), reach(node) AS (SELECT '{start}' UNION SELECT sup.{b} FROM reach JOIN sup ON sup.{a} = reach.node)"


