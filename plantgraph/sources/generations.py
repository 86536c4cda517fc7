"""Generations as partitioned tables: publication, time travel, history and differences at scale.

A folder holds every table of every generation as Parquet under ``table/generation=g/bucket=b``; a row's
bucket follows from its id, so a row stays in its bucket from one generation to the next. A
generation's manifest is written last and is its publication: what lies in the folder without one was
never published and is not seen. It has a line for each table and bucket, with the number of rows
and a digest that no order of rows changes, so it is small whatever the size of the tables; two
generations are compared by their manifests first, and only buckets that differ are read.

Everything is Spark's: any store it writes to will do, one writer at a time.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..errors import PlantError
from ..operators import diff as diffs
from ..topology import Header, Topology

#: what decides the bucket of a row: members lie beside their group or changeover
KEYS = {"nodes": "node_id", "edges": "edge_id", "groups": "group_id", "group_members": "group_id", "aliases": "alias_id", "changeovers": "changeover_id", "changeover_members": "changeover_id"}
#: which tables a record of a difference is made from
PARTS = {"nodes": ("nodes",), "edges": ("edges",), "groups": ("groups", "group_members"), "aliases": ("aliases",), "changeovers": ("changeovers", "changeover_members")}
_HEADER = "facility string, producer string, origin string, witness string, parent_generation long, parent_digest string"
MANIFEST = f"table_name string, bucket int, n long, digest string, {_HEADER}"
NONE = "0" * 64


class Generations:
    """The published generations of one facility in a folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets

    # -- reading ---------------------------------------------------------------------------------
    def manifests(self) -> DataFrame:
        """The lines of all manifests, with their generation."""
        try:
            return self.spark.read.schema(f"{MANIFEST}, generation long").option("basePath", f"{self.path}/manifest").parquet(f"{self.path}/manifest")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], f"{MANIFEST}, generation long")

    def generations(self) -> DataFrame:
        """(generation, digest, parent_generation, parent_digest, facility, rows): one row each. The digest
        covers all buckets and the header; it is no digest of the canonical image."""
        line = F.concat_ws(":", "table_name", "bucket", "n", "digest")
        own = self.manifests().groupBy("generation", *(c.split()[0] for c in _HEADER.split(", "))).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines"), F.sum("n").alias("rows"))
        said = F.concat_ws("\n", F.col("generation").cast("string"), "facility", "producer", "origin", "witness", F.col("parent_generation").cast("string"), "parent_digest", "lines")
        return own.select("generation", F.sha2(said, 256).alias("digest"), "parent_generation", "parent_digest", "facility", "rows")

    def history(self) -> DataFrame:
        """The generations with ``linked``: whether the parent each names is there with the digest it names."""
        own = self.generations()
        parent = own.select(F.col("generation").alias("parent_generation"), F.col("digest").alias("found"))
        linked = (F.col("parent_generation") == 0) & (F.col("parent_digest") == NONE) | (F.col("found") == F.col("parent_digest"))
        return own.join(parent, "parent_generation", "left").select("generation", "digest", "parent_generation", "parent_digest", "rows", F.coalesce(linked, F.lit(False)).alias("linked"))

    def head(self) -> int:
        """The latest generation; 0 before the first."""
        return self.manifests().agg(F.coalesce(F.max("generation"), F.lit(0))).first()[0]

    def _read(self, table: str, generation: int, buckets: list[int] | None = None) -> DataFrame:
        kind = schema.TABLES[table]
        rows = self.spark.read.schema(kind).option("basePath", f"{self.path}/{table}")
        folder = f"{self.path}/{table}/generation={generation}"
        if buckets is None:
            return rows.parquet(folder).select(*kind.fieldNames())
        return rows.parquet(*(f"{folder}/bucket={b}" for b in buckets)).select(*kind.fieldNames()) if buckets else self.spark.createDataFrame([], kind)

    def load(self, generation: int, verify: bool = False, buckets: dict[str, list[int]] | None = None) -> Topology:
        """One generation; no other is read. With ``verify`` every table is read and compared with its manifest.
        ``buckets``: only these of each table."""
        lines = self.manifests().where(F.col("generation") == generation)
        line = lines.first()
        if line is None:
            raise PlantError("generation_not_retained", "no such generation is published", str(generation))
        held: dict[str, list[int]] = {}
        for r in lines.where("n > 0").select("table_name", "bucket").collect():  # a row a table and bucket
            held.setdefault(r.table_name, []).append(r.bucket)
        tables = {}
        for name in KEYS:
            own = held.get(name, [])
            if buckets is not None:
                own = sorted(set(own) & set(buckets.get(name, [])))
                tables[name] = self._read(name, generation, own)
            elif own:
                tables[name] = self._read(name, generation)
        kind, identity, number = line.facility.split("\t")
        header = Header(facility=(kind, identity, Decimal(number)), producer=line.producer, origin=line.origin, witness=line.witness, generation=generation, parent_generation=line.parent_generation, parent_digest=line.parent_digest)
        t = Topology(self.spark, tables, header, schema.UNBOUNDED)
        if verify:
            found = self._digests(t)
            wrong = lines.select("table_name", "bucket", "n", "digest").exceptAll(found.select("table_name", "bucket", "n", "digest"))
            if not wrong.isEmpty():
                raise PlantError("integrity_failure", "a table is not what its manifest says", str(generation))
        return t

    # -- writing ---------------------------------------------------------------------------------
    def _bucket(self, key: str):
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int").alias("bucket")

    def _digests(self, t: Topology) -> DataFrame:
        """(table_name, bucket, n, digest) of every bucket: sums of two fingerprints of the rows, which no
        order of rows changes and which tell how often a row is there."""
        parts = []
        for name, key in KEYS.items():
            if name in t.tables:
                row = F.to_json(F.struct(*schema.TABLES[name].fieldNames()), {"ignoreNullFields": "false"})
                own = t.tables[name].select(self._bucket(key), F.xxhash64(row).cast("decimal(38,0)").alias("x"), F.xxhash64(F.lit(1), F.reverse(row)).cast("decimal(38,0)").alias("y"))
                own = own.groupBy("bucket").agg(F.count("*").alias("n"), F.sha2(F.concat_ws(":", F.sum("x").cast("string"), F.sum("y").cast("string")), 256).alias("digest"))
                parts.append(own.select(F.lit(name).alias("table_name"), "bucket", "n", "digest"))
        out = parts[0]
        for p in parts[1:]:
            out = out.union(p)
        return out

    def publish(self, t: Topology) -> int:
        """Writes t as the next generation, a child of the latest, and returns its number."""
        parent = self.head()
        digest = self.generations().where(F.col("generation") == parent).first().digest if parent else NONE
        facility = "\t".join(map(str, t.header.facility))
        if parent and self.manifests().where(F.col("facility") != facility).limit(1).count():
            raise PlantError("generation_mismatch", "the folder belongs to another facility", facility)
        generation = parent + 1
        for name, key in KEYS.items():
            if name in t.tables:
                rows = t.tables[name].withColumn("bucket", self._bucket(key))
                # what an unpublished attempt has left there is replaced
                # from where the rows are: a shuffle by bucket would leave as many tasks as buckets
                rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{name}/generation={generation}")
        written = Topology(self.spark, {name: self._read(name, generation) for name in KEYS if name in t.tables and not self._read(name, generation).isEmpty()}, t.header, t.limits)
        lines = self._digests(written if written.tables else t)
        header = [F.lit(x).cast(k).alias(n) for (n, k), x in zip((c.split() for c in _HEADER.split(", ")), (facility, t.header.producer, t.header.origin, t.header.witness, parent, digest), strict=True)]
        lines.select("*", *header).coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/generation={generation}")
        return generation

    # -- differences -----------------------------------------------------------------------------
    def changed(self, before: int, after: int) -> DataFrame:
        """(table_name, bucket) of buckets whose rows are not the same in both."""
        lines = self.manifests().select("generation", "table_name", "bucket", "n", "digest")
        a, b = (lines.where(F.col("generation") == g).drop("generation") for g in (before, after))
        both = a.join(b.withColumnsRenamed({"n": "m", "digest": "other"}), ["table_name", "bucket"], "full_outer")
        return both.where("NOT (n <=> m AND digest <=> other)").select("table_name", "bucket")

    def diff(self, before: int, after: int) -> DataFrame:
        """(change, subject, detail): the difference's records, read from the changed buckets alone."""
        own: dict[str, list[int]] = {}
        for r in self.changed(before, after).collect():  # a row a table and bucket at most
            own.setdefault(r.table_name, []).append(r.bucket)
        wanted = {name: sorted({b for x in tables for b in own.get(x, [])}) for tables in PARTS.values() for name in tables}
        a, b = (self.load(g, buckets=wanted) for g in (before, after))
        return diffs.diff(a, b).entries
