"""One generation of a facility graph as DataFrames, with names resolved."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import schema
from .errors import PlantError
from .operators.adjacency import among


@dataclass
class Header:
    facility: tuple | None = None  # (kind, identity, generation)
    producer: str = ""
    origin: str = "authored"
    witness: str = ""
    source: tuple | None = None
    authority_epoch: int = 0
    generation: int = 1
    parent_generation: int = 0
    parent_digest: str = "0" * 64


@dataclass
class Topology:
    """The tables of a draft or generation. ``lookup``, ``edges_resolved`` and the layouts are built
    once and shared by all queries; ``limits`` bounds what queries return."""

    spark: SparkSession
    tables: dict[str, DataFrame]
    header: Header = field(default_factory=Header)
    limits: schema.Limits = schema.REFERENCE
    digest: str = ""
    _made: dict = field(default_factory=dict, repr=False)

    @classmethod
    def of_rows(cls, spark: SparkSession, rows: dict[str, list[tuple]], header: Header | None = None, **more) -> Topology:
        """From rows of Python values; absent tables are empty."""
        tables = {name: local(spark, rows.get(name, []), kind) for name, kind in schema.TABLES.items()}
        return cls(spark, tables, header or Header(), **more)

    def __getattr__(self, name: str) -> DataFrame:
        if name in schema.TABLES:
            if name not in self.tables:
                self.tables[name] = self.spark.createDataFrame([], schema.TABLES[name])
            return self.tables[name]
        raise AttributeError(name)

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    @property
    def lookup(self) -> DataFrame:
        """(name, node_id, kind): node ids and, one step away, aliases that name no node."""
        return self._once("lookup", self._names)

    def _names(self) -> DataFrame:
        own = self.nodes.select(F.col("node_id").alias("name"), "node_id", "kind").dropDuplicates(["name"])
        if "aliases" not in self.tables:
            return own
        other = self.aliases.select(F.col("alias_id").alias("name"), F.col("target").alias("node_id")).dropDuplicates(["name"])
        other = other.join(own.select("node_id", "kind"), "node_id").join(own.select("name"), "name", "left_anti")
        return own.unionByName(other.select("name", "node_id", "kind"))

    @property
    def edges_resolved(self) -> DataFrame:
        """edges with src and dst, null where an endpoint names nothing."""

        def make() -> DataFrame:
            keyed, of = self._made.get("keyed", (None, None))
            if keyed is not None and self.tables.get("edges") is of:  # with the groups and keys of their ends
                return keyed
            if self._made.get("canonical"):  # endpoints are node ids already
                return self.edges.withColumns({"src": F.col("from_node"), "dst": F.col("to_node")})
            a = self.lookup.select(F.col("name").alias("from_node"), F.col("node_id").alias("src"))
            b = self.lookup.select(F.col("name").alias("to_node"), F.col("node_id").alias("dst"))
            return self.edges.join(a, "from_node", "left").join(b, "to_node", "left").select("edge_id", "kind", "from_node", "from_port", "to_node", "to_port", "src", "dst")

        return self._once("edges", make)

    def links(self, *kinds: str) -> DataFrame:
        """``of_kind`` for those that repeated edges do not bother: they may stand more than once."""
        loose = self._loose()
        return self.of_kind(*kinds) if loose is None else loose.where(F.col("kind").isin(*kinds))

    def _loose(self) -> DataFrame | None:
        """The resolved edges with repeats, if they were given for the edges that the table still has."""
        loose, of = self._made.get("loose", (None, None))
        return loose if self.tables.get("edges") is of else None

    def ends(self) -> DataFrame:
        """(kind, src, dst) of all edges, null where an endpoint names nothing; a row may stand more than once."""
        loose = self._loose()
        own = self.edges_resolved if loose is None else loose
        return own.select("kind", "src", "dst", *(c for c in own.columns if c.endswith(("_group", "_key"))))

    def numbers(self) -> tuple[DataFrame, DataFrame] | None:
        """Nodes (node_id, id) and edges' ends (a, b) by the numbers that they were given with, one for each name, in place of
        names; none where nodes or edges are not those any more, or have keys that numbers leave no room for."""
        nodes, own, ends, of, odd = self._made.get("numbers", (None,) * 5)
        if nodes is None or self.tables.get("nodes") is not own or self.tables.get("edges") is not of:
            return None
        return (nodes, ends) if all(x.isEmpty() for x in odd) else None

    def of_kind(self, *kinds: str) -> DataFrame:
        """Edges of the kinds with both ends resolved."""
        return self.edges_resolved.where(F.col("kind").isin(*kinds)).where("src IS NOT NULL AND dst IS NOT NULL")

    def resolve(self, name: str) -> tuple[str, str]:
        """(node_id, kind) of a node id or alias."""
        if not name:
            raise PlantError("malformed_identifier", "a node name must not be empty")
        found = self.nodes.where(F.col("node_id") == name).select("node_id", "kind").first()
        if found is None and "aliases" in self.tables:
            found = self.lookup.where(F.col("name") == name).select("node_id", "kind").first()
        if found is None:
            raise PlantError("not_found", "no node or alias has this name", name)
        return found.node_id, found.kind

    # -- lookups ------------------------------------------------------------
    def find_node(self, name: str) -> DataFrame:
        return self.nodes.where(F.col("node_id") == self.resolve(name)[0])

    def find_edge(self, edge_id: str) -> DataFrame:
        return self.edges.where(F.col("edge_id") == edge_id)

    def find_group(self, group_id: str) -> DataFrame:
        return self.groups.where(F.col("group_id") == group_id)

    def find_alias(self, alias_id: str) -> DataFrame:
        return self.aliases.where(F.col("alias_id") == alias_id)

    def find_changeover(self, changeover_id: str) -> DataFrame:
        return self.changeovers.where(F.col("changeover_id") == changeover_id)

    def out_edges(self, name: str) -> DataFrame:
        return self.edges_resolved.where(F.col("src") == self.resolve(name)[0]).orderBy("edge_id")

    def in_edges(self, name: str) -> DataFrame:
        return self.edges_resolved.where(F.col("dst") == self.resolve(name)[0]).orderBy("edge_id")

    def edges_of_kind(self, kind: str) -> DataFrame:
        return self.edges.where(F.col("kind") == kind).orderBy("edge_id")

    def node_count(self) -> int:
        return self.nodes.count()

    def edge_count(self) -> int:
        return self.edges.count()

    def group_count(self) -> int:
        return self.groups.count()

    def origins(self) -> DataFrame:
        """Supplier kinds without an incoming supplies edge."""
        # dealt out as they come: to tell repeats apart before would keep a task's share of all nodes in its memory
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        fed = self.ends().where("kind = 'supplies' AND dst IS NOT NULL").select(F.col("dst").alias("node_id")).repartition(n, "node_id")
        return self.nodes.where(F.col("kind").isin(*schema.SUPPLIERS)).select("node_id").join(fed, "node_id", "left_anti")

    def origins_among(self, nodes: DataFrame) -> DataFrame:
        """(node): the origins among the nodes (node); only edges into them are looked at."""
        suppliers = self.nodes.where(F.col("kind").isin(*schema.SUPPLIERS)).select(F.col("node_id").alias("node"))
        own = among(suppliers, "node", nodes)
        return own.distinct().join(among(self.ends().where("kind = 'supplies'"), "dst", nodes).select(F.col("dst").alias("node")), "node", "left_anti")

    def structural_sources(self) -> DataFrame:
        return self.origins().orderBy("node_id")

    def to_draft(self) -> Topology:
        """The body alone: what a next generation starts from."""
        h = self.header
        return Topology(self.spark, dict(self.tables), Header(h.facility, h.producer, h.origin, h.witness, h.source, h.authority_epoch), self.limits)

    def views(self, prefix: str = "plant_") -> list[str]:
        """Registers every table as a temporary view for Spark SQL."""
        names = []
        for name in schema.TABLES:
            getattr(self, name).createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        self.edges_resolved.createOrReplaceTempView(prefix + "edges_resolved")
        return [*names, prefix + "edges_resolved"]


def local(spark: SparkSession, rows: list[tuple], kind: T.StructType) -> DataFrame:
    """Rows as a local relation: the planner knows its size, so what is small is broadcast."""

    wanted = to_arrow_schema(kind)
    columns = list(zip(*rows, strict=True)) or [()] * len(kind.fields)
    arrays = [pa.array([schema.plain(v, f.dataType) for v in c], a.type) for c, f, a in zip(columns, kind.fields, wanted, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=wanted), kind)


def ref(kind: str, identity: str, generation: int = 0) -> tuple:
    return (kind, identity, Decimal(generation))
