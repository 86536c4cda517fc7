"""Tables written between the rounds of an iterative plan.

A round that is kept as Parquet in the folder all executors share has no lineage behind it, survives
lost executors, and gives the next round's planner true sizes, so a small frontier is broadcast and
a large one is not.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir as the session has it; on a local master a temporary folder where it is unset."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="plantgraph-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Rounds:
    """Tables of one plan; ``drop`` deletes those that no later round and no answer reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base, self.paths, self.made = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", [], 0
        self.names: dict[str, str] = {}

    def keep(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.made}"
        self.made += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths.append((out, path))
        return out

    def keep_bucketed(self, df: DataFrame, *keys: str) -> DataFrame:
        """Kept in as many buckets of the keys as a shuffle has partitions, sorted by them: a join on all
        keys leaves these rows where they are. Buckets need a name in the catalog, which ends with ``drop``."""
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        path, name = f"{self.base}/{self.made}", f"kept_{uuid.uuid4().hex}"
        self.made += 1
        df.repartition(n, *keys).write.bucketBy(n, *keys).sortBy(*keys).format("parquet").option("path", path).saveAsTable(name)
        out = self.spark.table(name)
        self.paths.append((out, path))
        self.names[path] = name
        return out

    def drop_all_but(self, *tables: DataFrame) -> None:
        """Deletes every table but these."""
        self.drop(*(own for own, _ in self.paths if not any(own is x for x in tables)))

    def drop(self, *tables: DataFrame) -> None:
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            kept = next(p for own, p in self.paths if own is df)
            if kept in self.names:
                self.spark.sql(f"DROP TABLE {self.names.pop(kept)}")
            path = jvm.org.apache.hadoop.fs.Path(kept)
            path.getFileSystem(conf).delete(path, True)
        self.paths = [x for x in self.paths if not any(x[0] is df for df in tables)]
