"""Registered queries of generations kept as partitioned tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..sources.generations import Generations
from . import projection as pj
from .graph_queries import ORACLES, register
from .steps import shared_dir
from .structure_queries import _pair


def _published(spark: SparkSession, sf_dir: str) -> Generations:
    """The two generations of ``_pair``, in the folder that all executors share."""
    store = Generations(spark, f"{shared_dir(spark)}/generations-{uuid.uuid4().hex}", buckets=8)
    for t in _pair(spark, sf_dir):
        store.publish(t)
    return store


@register(f"""WITH n AS ({pj.nodes_sql()}), e AS ({pj.edges_sql()}), c AS (SELECT (SELECT count(*) FROM n) AS nodes, (SELECT count(*) FROM e) AS edges, (SELECT count(*) FROM nation) AS fresh)
SELECT CAST(1 AS BIGINT) AS generation, CAST(0 AS BIGINT) AS parent_generation, true AS linked, nodes, edges FROM c UNION ALL SELECT 2, 1, true, nodes + fresh, edges FROM c""")
def s7_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History with its links, and the rows of each generation as it is loaded."""
    store = _published(spark, sf_dir)
    loaded = [store.load(g).nodes.agg(F.count("*").alias("nodes")).crossJoin(store.load(g).edges.agg(F.count("*").alias("edges"))).withColumn("generation", F.lit(g).cast("long")) for g in (1, 2)]
    return store.history().join(loaded[0].union(loaded[1]), "generation").select("generation", "parent_generation", "linked", "nodes", "edges")


@register(ORACLES["q16_diff_of_every_table"])
def q16_diff_by_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The difference of two published generations, read from the buckets whose digests differ."""
    return _published(spark, sf_dir).diff(1, 2)


@register("""SELECT event_id, TRY_CAST(CASE WHEN regexp_full_match(x, '-?(0|[1-9][0-9]{0,18})') THEN x END AS BIGINT) AS number
FROM (SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('-', CAST(event_id AS VARCHAR)) WHEN 1 THEN concat('0', CAST(event_id AS VARCHAR)) WHEN 2 THEN concat('9223372036854775', CAST(event_id AS VARCHAR)) WHEN 3 THEN concat(' ', CAST(event_id AS VARCHAR)) WHEN 4 THEN '-0' ELSE CAST(user_id AS VARCHAR) END AS x FROM events) y""")
def f_int64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole numbers without signs, zeros or spaces that do not belong; null where one is not in range."""
    x = F.expr("CASE event_id % 6 WHEN 0 THEN concat('-', event_id) WHEN 1 THEN concat('0', event_id) WHEN 2 THEN concat('9223372036854775', event_id) WHEN 3 THEN concat(' ', event_id) WHEN 4 THEN '-0' ELSE cast(user_id AS string) END")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.int64(x).alias("number"))


@register("""SELECT event_id, CASE WHEN regexp_full_match(x, '-?[0-9]{1,6}\\.[0-9]{3}') AND abs(CAST(replace(x, '.', '') AS BIGINT)) <= 10000000 THEN CAST(replace(x, '.', '') AS BIGINT) END AS mc
FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN concat('-', CAST(event_id AS VARCHAR), '.125') WHEN 1 THEN concat(CAST(event_id AS VARCHAR), '.5') WHEN 2 THEN concat(CAST(event_id * 3 AS VARCHAR), '.000') WHEN 3 THEN concat('+', CAST(event_id AS VARCHAR), '.000') ELSE concat('0', CAST(event_id AS VARCHAR), '.001') END AS x FROM events) y""")
def f_celsius_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperatures with three decimals as thousandths; null where the text or its range is wrong."""
    x = F.expr("CASE event_id % 5 WHEN 0 THEN concat('-', event_id, '.125') WHEN 1 THEN concat(event_id, '.5') WHEN 2 THEN concat(event_id * 3, '.000') WHEN 3 THEN concat('+', event_id, '.000') ELSE concat('0', event_id, '.001') END")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", text.celsius_parsed(x).alias("mc"))
