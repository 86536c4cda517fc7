"""Differences between two generations: a null-safe full outer join for each table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions import text
from ..topology import Topology

#: Kinds of change, in the order in which a difference lists them.
CHANGES = ["node_added", "node_removed", "node_changed", "edge_added", "edge_removed", "edge_changed", "group_added", "group_removed", "group_changed", "alias_added", "alias_removed", "changeover_added", "changeover_removed", "changeover_changed"]


@dataclass
class Diff:
    """``entries`` (change, subject, detail), ordered; what the later generation leaves unfed or
    unserved; counts of nodes and edges gained, which are counted when they are asked for."""

    before: Topology
    after: Topology
    entries: DataFrame
    unfed_sinks: DataFrame
    unserved_zones: DataFrame
    same_facility: bool
    truncated: bool = False

    @property
    def node_delta(self) -> int:
        return self.after.nodes.count() - self.before.nodes.count()

    @property
    def edge_delta(self) -> int:
        return self.after.edges.count() - self.before.edges.count()


def _dash(c: Column) -> Column:
    return F.coalesce(c, F.lit("-"))


def _sizes(t: Topology, table: str, key: str) -> DataFrame:
    return getattr(t, table).groupBy(key).agg(F.count("*").cast("string").alias("members"))


def _table(t: Topology, name: str) -> tuple[DataFrame, list[str]]:
    """(id, fields) as the difference compares them, all as text."""
    if name == "node":
        fields = {"kind": F.col("kind"), "name": text.escaped(F.coalesce("display_name", F.lit(""))), "medium": _dash(F.col("medium")), "design-supply": _dash(text.celsius(F.col("design_supply_mc"))), "max-supply": _dash(text.celsius(F.col("max_supply_mc"))), "references": F.greatest(F.size(F.coalesce("refs", F.array().cast(schema.NODES["refs"].dataType))), F.lit(0)).cast("string")}
        return t.nodes.select(F.col("node_id").alias("id"), *(c.alias(k) for k, c in fields.items())), list(fields)
    if name == "edge":
        return t.edges.select(F.col("edge_id").alias("id"), "kind", F.concat_ws(".", "from_node", "from_port").alias("from"), F.concat_ws(".", "to_node", "to_port").alias("to")), ["kind", "from", "to"]
    if name == "group":
        own = t.groups.join(_sizes(t, "group_members", "group_id"), "group_id", "left")
        fields = {"scheme": F.col("scheme"), "scope": F.col("scope"), "name": text.escaped(F.coalesce("display_name", F.lit(""))), "members": F.coalesce("members", F.lit("0")), "distinct-failure-domains": F.col("require_distinct_failure_domains").cast("string"), "independent-sources": F.col("require_independent_sources").cast("string")}
        return own.select(F.col("group_id").alias("id"), *(c.alias(k) for k, c in fields.items())), list(fields)
    if name == "alias":
        return t.aliases.select(F.col("alias_id").alias("id"), "target"), ["target"]
    own = t.changeovers.join(_sizes(t, "changeover_members", "changeover_id"), "changeover_id", "left")
    return own.select(F.col("changeover_id").alias("id"), text.escaped(F.coalesce("display_name", F.lit(""))).alias("name"), F.coalesce("members", F.lit("0")).alias("members"), F.col("max_concurrent").cast("string").alias("max-concurrent")), ["name", "members", "max-concurrent"]


def unfed(t: Topology) -> tuple[DataFrame, DataFrame]:
    """Sinks without an incoming supplies edge, zones without an incoming serves edge: (node)."""

    def lacking(kind: str, edge: str) -> DataFrame:
        into = t.edges_resolved.where((F.col("kind") == edge) & F.col("dst").isNotNull()).select(F.col("dst").alias("node"))
        return t.nodes.where(F.col("kind") == kind).select(F.col("node_id").alias("node")).join(into, "node", "left_anti")

    return lacking("cooling_sink", "supplies"), lacking("thermal_zone", "serves")


def diff(before: Topology, after: Topology) -> Diff:
    """More entries than ``limits.diff_entries`` of the later generation are cut off before they are put
    in order: what stays is the first of them by table and id."""
    parts = []
    for place, name in enumerate(("node", "edge", "group", "alias", "changeover")):
        (a, fields), (b, _) = _table(before, name), _table(after, name)
        both = a.alias("a").join(b.alias("b"), F.col("a.id") == F.col("b.id"), "full_outer")
        said = [F.when(~F.col(f"a.`{f}`").eqNullSafe(F.col(f"b.`{f}`")), F.concat(F.lit(f"{f}="), F.col(f"a.`{f}`"), F.lit("->"), F.col(f"b.`{f}`"))) for f in fields]
        changed = "alias_added" if name == "alias" else f"{name}_changed"
        change = F.when(F.col("a.id").isNull(), f"{name}_added").when(F.col("b.id").isNull(), f"{name}_removed").otherwise(changed)
        detail = F.when(F.col("a.id").isNotNull() & F.col("b.id").isNotNull(), F.concat_ws(", ", *said)).otherwise("")
        rows = both.select(change.alias("change"), F.coalesce("a.id", "b.id").alias("subject"), detail.alias("detail"), (F.col("a.id").isNotNull() & F.col("b.id").isNotNull()).alias("both"))
        parts.append(rows.where("NOT both OR detail <> ''").drop("both").withColumn("place", F.lit(place)))
    entries = parts[0]
    for p in parts[1:]:
        entries = entries.union(p)
    most, cut = after.limits.diff_entries, False
    if most is not None and entries.limit(most + 1).count() > most:
        entries, cut = entries.orderBy("place", "subject").limit(most), True
    entries = entries.drop("place")
    rank = F.array_position(F.array(*map(F.lit, CHANGES)), F.col("change"))
    sinks, zones = unfed(after)
    return Diff(before, after, entries.orderBy(rank, "subject", "detail"), sinks, zones, before.header.facility == after.header.facility, cut)


def explain(d: Diff) -> list[str]:
    """The difference as lines; for people, so it comes to the driver. The wording is fixed."""
    out = [f"generation {d.before.header.generation} -> {d.after.header.generation}", f"digest {d.before.digest or '0' * 64} -> {d.after.digest or '0' * 64}"]
    if not d.same_facility:
        out.append("facility binding changed; the two generations do not describe the same facility")
    out.append(f"nodes delta {d.node_delta}, edges delta {d.edge_delta}")
    out += [f"{r.change} {r.subject}" + (f" ({r.detail})" if r.detail else "") for r in d.entries.toLocalIterator()]
    out += [f"impact: cooling sink {r.node} has no structural supply route" for r in d.unfed_sinks.orderBy("node").toLocalIterator()]
    out += [f"impact: thermal zone {r.node} has no serving element" for r in d.unserved_zones.orderBy("node").toLocalIterator()]
    if d.truncated:
        out.append("impact: analysis stopped at a configured bound; the report is a prefix")
    return [*out, f"claim boundary: {schema.POSTURE}"]
