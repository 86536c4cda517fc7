"""A corpus pipeline of five of the operators: each stage works on all its predecessor kept.

Stages but the last return the columns of documents. ``run`` writes each stage's result to the
shared folder and reads it back, so a lost executor costs at most a part of one stage. From the line
stage on the session deletes shuffle files when a query ends (``stages.release``), so a stage does not
find those of its predecessor on the disk.

Rows with null or empty texts fail the quality rules. Rows without a doc_id pass the line and
near-duplicate stages unchanged. Of rows that repeat a doc_id and its text one is left after the
near-duplicate stage; rows that share a doc_id but not their text are told apart by the text. Further
columns of documents are carried along to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plantgraph.llm import decontaminate, jaccard, line_dedup, mixing, quality, stages


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the bands of tokeniser fertility."""
    return quality.keep_good(docs)


def line_templates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines whose templates recur; without those that had no other line."""
    stages.release(spark)
    out = line_dedup.line_dedup(docs, min_texts=10, drop_empty=True)
    if "n_chars" in docs.columns:
        dropped = F.col(stages.spare(docs, "n_dropped"))
        out = out.withColumn("n_chars", F.when(dropped > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by shingles of five words, Jaccard 0.8: of the rows with the least
    doc_id, one of those whose text has the least fingerprint."""
    h = stages.spare(docs, "_text_id")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    groups = jaccard.jaccard_join(keyed, k=5, percent=80, carry=(h,)).where("n_shingles > 0 AND doc_id IS NOT NULL")
    kept = stages.Stages(spark, "near-duplicates")
    rows = kept.keep(groups.groupBy("doc_id", "component_id", "component_key", h).agg(F.count("*").alias("n")), "rows")
    own = rows.where("doc_id = component_id").select("doc_id", "component_key", h, "n")
    stays = own.join(own.groupBy("component_key").agg(F.min(h).alias(h)), ["component_key", h], "left_semi")
    late = rows.select("doc_id", h).subtract(stays.select("doc_id", h))
    twice = stays.where("n > 1").select("doc_id", h)
    gone = kept.keep(late.withColumn("again", F.lit(False)).union(twice.withColumn("again", F.lit(True))), "gone")
    once = keyed.join(gone.where("again").select("doc_id", h), ["doc_id", h], "left_semi").dropDuplicates(["doc_id", h])
    return keyed.join(gone.select("doc_id", h), ["doc_id", h], "left_anti").select(*docs.columns).union(once.select(*docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no ten-word window of a benchmark item, or no whole item if it is shorter."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mix takes each document's words."""
    return mixing.mix(docs, weights=(5, 2, 1), cap=3)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_templates),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources", mix_sources),
]

#: SQL cannot express tokeniser fertility; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = stages.Stages(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = kept.keep(docs, f"stage-{i}")
            if i:
                kept.drop(f"stage-{i - 1}")
    return docs
