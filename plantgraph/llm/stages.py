"""Cutting lineage between the steps of an operator, without executor-local copies.

A step that is read more than once, or that ends an expensive shuffle, is written as Parquet to the
folder all executors share (``spark.checkpoint.dir``) and read back: a lost executor loses nothing.
Only where that setting is absent on a local master (tests, notebooks) a temporary folder is set up;
on a cluster its absence is an error. Steps delete what no later step reads.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's setting by which a query deletes its shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: the session's own setting, or on a local master a temporary one."""
    for read in (lambda: spark.conf.get("spark.checkpoint.dir", None), lambda: spark.sparkContext.getConf().get("spark.checkpoint.dir")):
        path = read()
        if path:
            return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = tempfile.mkdtemp(prefix="plantgraph-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def release(spark: SparkSession) -> None:
    """From now on the session deletes the shuffle files of every query as it ends, also of those that
    write a result this package has returned and no longer holds. One that is read again is recomputed."""
    spark.conf.set(CLEANUP, "true")


class Stages:
    """Tables that one call of an operator writes on its way."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # a hint: shuffles of results that were written and let go may be deleted now
        self.base = f"{shared_dir(spark)}/{operator}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write df, let go of the shuffle files that made it, and return what was written."""
        path = f"{self.base}/{name}"
        before = self.spark.conf.get(CLEANUP, "false")
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(conf).delete(path, True)


def tasks(spark: SparkSession, least: int = 1) -> int:
    """Partitions for an explicit repartition: the session's own shuffle setting."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, under names of its own: other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))


def spare(df: DataFrame, name: str) -> str:
    """The name, with underscores added until no column of df has it in any spelling."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(stages: Stages, edges: DataFrame, name: str, rounds: int = 200) -> DataFrame:
    """Connected components of (a, b): (node, comp = least node of its component), written down.

    Alternating large-star and small-star (Kiveris et al. 2014): every round is two grouped minima
    and two equi-joins over the edges, and a node's neighbours never meet in one row. Each round is
    written to the shared folder; the loop ends when a round leaves the edges unchanged. Rounds grow
    with the logarithm of the diameter; past ``rounds`` it is an error.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = stages.keep(e, f"{name}-0")
    seen = None
    for i in range(1, rounds + 1):
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or not state[0]:
            break
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = stages.keep(small, f"{name}-{i}")
        stages.drop(f"{name}-{i - 1}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("comp")).union(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def contract(stages: Stages, labels: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """Labels (node, comp) after further links: only edges between components are followed."""
    of = {x: labels.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab"}
    edges = links.join(of["a"], "a", "left").join(of["b"], "b", "left")
    edges = edges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).where("a <> b").distinct()
    upper = components(stages, edges, f"{name}-upper")
    moved = labels.join(upper.select(F.col("node").alias("comp"), F.col("comp").alias("top")), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp"))
    return stages.keep(moved.union(upper.join(labels.select("node"), "node", "left_anti").select("node", "comp")), name)
