"""A synthetic facility of any size: one source, two loops and L legs, from spark.range."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..topology import Header, Topology, ref

#: (edge prefix, kind, from, from port, to, to port); a * stands for the leg's number
LEG = [
    ("e.loop.a.branch.", "supplies", "loop.a", "supply_out", "branch.*", "source_in"),
    ("e.loop.b.branch.", "supplies", "loop.b", "supply_out", "branch.*", "source_in"),
    ("e.branch.sink.", "supplies", "branch.*", "supply_out", "sink.*", "source_in"),
    ("e.branch.crah.", "supplies", "branch.*", "supply_out", "crah.*", "source_in"),
    ("r.sink.branch.", "returns", "sink.*", "heat_out", "branch.*", "return_in"),
    ("r.crah.branch.", "returns", "crah.*", "heat_out", "branch.*", "return_in"),
    ("r.branch.loop.a.", "returns", "branch.*", "heat_out", "loop.a", "return_in"),
    ("r.branch.loop.b.", "returns", "branch.*", "heat_out", "loop.b", "return_in"),
    ("c.loop.a.branch.", "contains", "loop.a", "container", "branch.*", "contained"),
    ("c.zone.sink.", "contains", "zone.0", "container", "sink.*", "contained"),
    ("c.zone.crah.", "contains", "zone.0", "container", "crah.*", "contained"),
    ("s.crah.zone.", "serves", "crah.*", "server", "zone.0", "served"),
]
#: (node, kind, sub-kind, medium, design supply, most supply)
LEG_NODES = [("branch.*", "branch", "rack_branch", "chilled_water", 7000, 20000), ("sink.*", "cooling_sink", "rack_load", None, None, 27000), ("crah.*", "crah", "in_row", "chilled_water", None, 18000)]
TRUNK_NODES = [("src.0", "cooling_source", "facility_water", "chilled_water", 6000, None), ("loop.a", "cooling_loop", "primary", "chilled_water", 7000, 12000), ("loop.b", "cooling_loop", "primary", "chilled_water", 7000, 12000), ("zone.0", "thermal_zone", "room", None, None, None)]
TRUNK = [(f"e.src.loop.{x}", "supplies", "src.0", "supply_out", f"loop.{x}", "source_in") for x in "ab"] + [(f"r.loop.{x}.src", "returns", f"loop.{x}", "heat_out", "src.0", "return_in") for x in "ab"]


def workload(spark: SparkSession, legs: int = 40, limits: schema.Limits = schema.REFERENCE) -> Topology:
    """4 + 3 * legs nodes and 4 + 12 * legs edges."""
    k = F.col("id").cast("string")

    def leg(parts: list) -> DataFrame:
        return spark.range(legs).select(F.explode(F.array(*[F.struct(*p) for p in parts])).alias("x")).select("x.*")

    def at(name: str, alias: str):
        return (F.concat(F.lit(name[:-1]), k) if name.endswith("*") else F.lit(name)).alias(alias)

    edges = leg([(F.concat(F.lit(e), k).alias("edge_id"), F.lit(kind).alias("kind"), at(a, "from_node"), F.lit(ap).alias("from_port"), at(b, "to_node"), F.lit(bp).alias("to_port")) for e, kind, a, ap, b, bp in LEG])
    edges = spark.createDataFrame(TRUNK, schema.EDGES).unionByName(edges)
    own = leg([(at(n, "node_id"), F.lit(kind).alias("kind"), F.lit(sub).alias("subkind"), F.lit(medium).cast("string").alias("medium"), F.lit(design).cast("bigint").alias("design_supply_mc"), F.lit(most).cast("bigint").alias("max_supply_mc"), (F.concat(F.lit("consumer:rack-"), k) if kind == "cooling_sink" else F.lit(None).cast("string")).alias("who")) for n, kind, sub, medium, design, most in LEG_NODES])
    trunk = spark.createDataFrame([(*n, None) for n in TRUNK_NODES], "node_id string, kind string, subkind string, medium string, design_supply_mc bigint, max_supply_mc bigint, who string")
    nodes = trunk.unionByName(own)
    consumer = F.when(F.col("who").isNotNull(), F.struct(F.lit("consumer").alias("kind"), F.col("who").alias("identity"), F.lit(0).cast(schema.U64).alias("generation")))
    nodes = nodes.withColumns({"consumer": consumer, "pump_role": F.lit(None).cast("string"), "display_name": F.lit(""), "refs": F.array().cast(schema.NODES["refs"].dataType)}).select(*schema.NODES.fieldNames())
    header = Header(facility=ref("facility", "benchmark", 1), producer="plantgraph-synthetic-workload/1.0", witness=f"deterministic {legs}-leg workload", authority_epoch=1)
    return Topology(spark, {"nodes": nodes, "edges": edges}, header, limits)
