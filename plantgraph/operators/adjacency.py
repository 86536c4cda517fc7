"""Edges laid out for a traversal: written once, so that a round moves its frontier and no edge.

The layout is a table of the session's catalog whose files lie in the shared folder, bucketed and
sorted by the node an edge is followed from, with as many buckets as a shuffle has partitions. A
frontier is therefore exchanged towards the edges' buckets, or broadcast where it is small.

A node with more than ``HUB`` edges, a hub, would put them all in one bucket. Its edges are dealt over
parts of at most about ``HUB`` by their own content, in a second table bucketed by node and part, and a
frontier's row is repeated once a part, for hubs alone. Hubs are found by a count that is combined
before it is shuffled; they are at most one for every ``HUB`` edges.

Up to ``LEAST`` edges stay as they were kept: to exchange them costs less than to lay them out.

A traversal makes a layout only when it pays (``Along``): a frontier of up to ``FEW`` nodes is met by name,
which the planner takes down to the tables that the edges come from, and the first larger frontier
is joined with the edges as they come. Edges may tell of each end the group its name is of (the name
without the number at its end) and that number: columns ``src_group``, ``src_key``, ``dst_group`` and
``dst_key``. Then names are looked for as numbers in the tables that have the group, other tables are
not read, and a large frontier is joined with its groups' edges alone.

A node without edges leads nowhere, repeated edges are followed as often as they stand, and a null
in ``here`` is never met. An empty table is followed to an empty answer.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.steps import Rounds

HUB = 100_000
LEAST = 4_000_000
#: nodes that are met by name
FEW = 20_000
#: groups of names that are told apart
GROUPS = 1_000


def names_of(nodes: DataFrame, column: str) -> list[str] | None:
    """The different values of a column, if they are few."""
    own = nodes.where(F.col(column).isNotNull()).select(column)
    found = own.limit(FEW + 1).collect()
    if len(found) > FEW:  # repeats may be what makes them many
        found = own.distinct().limit(FEW + 1).collect()
    return sorted({r[0] for r in found}) if len(found) <= FEW else None


def quoted(names: Iterable[str]) -> str:
    return ", ".join("'" + n.replace("\\", "\\\\").replace("'", "\\'") + "'" for n in names)


def keys_of(name: str) -> list[tuple[str, int]]:
    """The (group, key) that make up a name: a group without a digit at its end, and a number as SQL spells it."""
    group = name.rstrip("0123456789")
    digits = name[len(group) :]
    if not digits or (digits[0] == "0" and digits != "0") or len(digits) > 18:
        return []
    return [(group, int(digits))] + ([(group[:-1], -int(digits))] if group.endswith("-") and digits != "0" else [])


def named(column: str, names: list[str], columns: Iterable[str] = ()):
    """Whether a column is one of the names. Where the columns hold its group and key too, that is said
    of those as well, which goes down to the keys of the tables that the rows are from."""
    if not names:
        return F.lit(False)
    own = F.expr(f"`{column}` IN ({quoted(names)})")
    if f"{column}_group" not in columns:
        return own
    keys: dict[str, list[int]] = {}
    for n in names:
        if len(n) - len(n.rstrip("0123456789")) > 18:  # such a key may be one of the tables' too
            return own
        for group, key in keys_of(n):
            keys.setdefault(group, []).append(key)
    parts = (f"(`{column}_group` = {quoted([g])} AND `{column}_key` IN ({', '.join(f'{k}L' for k in own_keys)}))" for g, own_keys in sorted(keys.items()))
    return F.expr(" OR ".join(parts) or "false") & own


def groups_of(nodes: DataFrame, column: str) -> set[str] | None:
    """The groups of names (without the digits at their ends) in a column, if they are few; a name that ends in
    a negative number is of both groups that can be read from it."""
    group = F.expr(f"trim(TRAILING '0123456789' FROM `{column}`)").alias("g")
    found = [r[0] for r in nodes.where(F.col(column).isNotNull()).select(group).distinct().limit(GROUPS + 1).collect()]
    return {*found, *(g[:-1] for g in found if g.endswith("-"))} if len(found) <= GROUPS else None


def in_groups(rows: DataFrame, column: str, groups: set[str] | None) -> DataFrame:
    """The rows of which the column may be a name of the groups."""
    if groups is None:
        return rows
    if not groups:
        return rows.where(F.lit(False))
    group = f"`{column}_group`" if f"{column}_group" in rows.columns else f"trim(TRAILING '0123456789' FROM `{column}`)"
    return rows.where(F.expr(f"{group} IN ({quoted(sorted(groups))})"))


def plain(edges: DataFrame) -> DataFrame:
    """Without the columns that only say where names come from."""
    return edges.drop(*(f"{x}_{y}" for x in ("src", "dst", "here", "there") for y in ("group", "key")))


def among(rows: DataFrame, column: str, nodes: DataFrame, key: str = "node") -> DataFrame:
    """The rows of which the column is one of the nodes (key)."""
    few = names_of(nodes, key)
    if few is not None:
        return rows.where(named(column, few, rows.columns))
    rows = in_groups(rows, column, groups_of(nodes, key))
    return rows.join(nodes.select(F.col(key).alias(column)).distinct(), column, "left_semi").select(*rows.columns)


def entering(rounds: Rounds, edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (here, there, ...) into the nodes (node); kept where the nodes are few, so that rounds
    over them do not come back to the tables the edges are from."""
    few = names_of(nodes, "node")
    return among(edges, "there", nodes) if few is None else rounds.keep(edges.where(named("there", few, edges.columns)).distinct())


class Along:
    """The edges (here, there, ...) of one traversal, followed a frontier at a time."""

    def __init__(self, rounds: Rounds, edges: DataFrame):
        self.rounds, self.edges, self.large, self.laid = rounds, edges, 0, None
        self.met: set[str] = set()

    def follow(self, frontier: DataFrame) -> DataFrame:
        """Each row of the frontier (node, ...) with each edge from its node."""
        if self.laid is None:
            few = names_of(frontier, "node")
            if few is not None:
                return frontier.join(plain(self.edges.where(named("here", few, self.edges.columns))), F.col("node") == F.col("here"))
            part = self._part(frontier)
            if part is not None:
                return frontier.join(part, F.col("node") == F.col("here"))
            self.large += 1
            if self.large == 1:
                return frontier.join(plain(self.edges), F.col("node") == F.col("here"))
            self.laid = Adjacency(self.rounds, plain(self.edges))
        return self.laid.follow(frontier)

    def _part(self, frontier: DataFrame) -> DataFrame | None:
        """The edges from the groups of names of a large frontier, where edges tell their groups and none
        of these was met before: a layout of all edges would not be read twice."""
        if "here_group" not in self.edges.columns:
            return None
        groups = groups_of(frontier, "node")
        if groups is None or self.met & groups:
            return None
        self.met |= groups
        return plain(in_groups(self.edges, "here", groups))

    def drop(self) -> None:
        """Deletes the layout, if there is one."""
        if self.laid is not None:
            self.laid.drop()


class Adjacency:
    """The edges (here, there, ...) of one traversal; no other column may be named node, part or at."""

    def __init__(self, rounds: Rounds, edges: DataFrame):
        self.rounds, self.tables, self.split = rounds, [], None
        edges = rounds.keep(edges)
        if edges.count() <= LEAST:
            self.hubs, self.plain = None, self._kept(edges)
            return
        as_kept = edges
        hubs = edges.where("here IS NOT NULL").groupBy("here").agg(F.count("*").alias("n")).where(F.col("n") > HUB)
        self.hubs = self._kept(rounds.keep(hubs.select(F.col("here").alias("hub"), F.ceil(F.col("n") / HUB).cast("int").alias("parts"))))
        if not self.hubs.isEmpty():
            own = edges.join(self.hubs, edges.here == self.hubs.hub).withColumn("part", F.pmod(F.xxhash64(*(c for c in edges.columns if c != "here")), "parts").cast("int"))
            self.split = self._kept(rounds.keep_bucketed(own.drop("hub", "parts"), "here", "part"))
            edges = edges.join(self.hubs, edges.here == self.hubs.hub, "left_anti")
        self.plain = self._kept(rounds.keep_bucketed(edges, "here"))
        rounds.drop(as_kept)

    def _kept(self, table: DataFrame) -> DataFrame:
        self.tables.append(table)
        return table

    def follow(self, frontier: DataFrame) -> DataFrame:
        """Each row of the frontier (node, ...) with each edge from its node."""
        out = frontier.join(self.plain, frontier.node == self.plain.here)
        if self.split is None:
            return out
        wide = frontier.join(self.hubs, frontier.node == self.hubs.hub).withColumn("at", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("hub", "parts")
        return out.unionByName(wide.join(self.split, (wide.node == self.split.here) & (wide["at"] == self.split.part)).drop("at", "part"))

    def drop(self) -> None:
        """Deletes the layout; nothing that was not kept may be read from it any more."""
        self.rounds.drop(*self.tables)
