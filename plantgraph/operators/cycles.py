"""Directed cycles: which nodes lie on them, and the cycle that a search meets first.

All checks of a validation are searched together: every table carries the name of its check.

A depth-first search in ascending node and edge order never turns back from a node that can reach a
cycle before it has closed one, and what cannot reach a cycle has no effect on it. So its first cycle
lies on the walk that starts at the least node that can reach a cycle and always takes the least edge
to a node that can: every node has one successor, and the cycle is found by doubling the length of
jumps, in as many rounds as the logarithm of the number of nodes. No task ever walks the graph.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.steps import Rounds
from ..topology import Topology

EDGE = ["name", "edge_id", "src", "dst"]
#: steps of peeling between two written tables
STEPS = 2


def _checked(t: Topology, checks: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, edge_id, src, dst): the resolved edges of each check."""
    names = F.array(*(F.when(F.col("kind").isin(*kinds), F.lit(name)) for name, kinds in checks.items()))
    every = t.of_kind(*{k for kinds in checks.values() for k in kinds})
    return every.select(F.explode(F.array_compact(names)).alias("name"), "edge_id", "src", "dst")


def peel(rounds: Rounds, edges: DataFrame, both: bool = False) -> DataFrame:
    """Edges left when those into nodes without an outgoing edge are taken away until nothing
    changes: they lead to a cycle or lie on one. With ``both``, edges out of nodes without an incoming
    one go as well: what is left lies on a cycle or between two."""
    n = edges.count()
    while n:
        less = edges
        for _ in range(STEPS):
            less = less.join(less.select("name", F.col("src").alias("dst")).distinct(), ["name", "dst"], "left_semi")
            if both:
                less = less.join(less.select("name", F.col("dst").alias("src")).distinct(), ["name", "src"], "left_semi")
        less = rounds.keep(less.select(*edges.columns))
        m = less.count()
        rounds.drop(edges)
        edges = less
        if m == n:
            break
        n = m
    return edges


def cycles(t: Topology, checks: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, edges): for each check with a directed cycle over its kinds, the edges, ascending, of the
    one that a search in ascending order closes first."""
    rounds = Rounds(t.spark, "cycles")
    edges = peel(rounds, rounds.keep(_checked(t, checks)))
    size = edges.groupBy("name").agg(F.count_distinct("src").alias("n")).agg(F.max("n")).first()[0]
    if not size:
        rounds.drop(edges)
        return t.spark.createDataFrame([], "name string, edges array<string>")
    follow = rounds.keep(edges.groupBy("name", "src").agg(F.min(F.struct("edge_id", "dst")).alias("w")).select("name", "src", F.col("w.edge_id").alias("edge_id"), F.col("w.dst").alias("dst")))
    jumps = [follow.select("name", "src", "dst")]
    while 1 << (len(jumps) - 1) < size:
        a, b = jumps[-1], jumps[-1].select("name", F.col("src").alias("dst"), F.col("dst").alias("to"))
        jumps.append(rounds.keep(a.join(b, ["name", "dst"]).select("name", "src", F.col("to").alias("dst"))))
    start = follow.groupBy("name").agg(F.min("src").alias("src"))
    on = rounds.keep(jumps[-1].join(start, ["name", "src"], "left_semi").select("name", F.col("dst").alias("src")))
    for jump in jumps:  # from one node of the cycle to 2, 4, 8 ... of its successors
        on = rounds.keep(on.union(on.join(jump, ["name", "src"]).select("name", F.col("dst").alias("src"))).distinct())
    out = rounds.keep(follow.join(on, ["name", "src"], "left_semi").groupBy("name").agg(F.array_sort(F.collect_set("edge_id")).alias("edges")))
    rounds.drop_all_but(out)
    return out


def find_cycle(t: Topology, *kinds: str) -> list[str]:
    """Edge ids of the first cycle over the kinds, or nothing."""
    found = cycles(t, {"cycle": kinds}).first()
    return found.edges if found else []


def strong_components(t: Topology, checks: dict[str, tuple[str, ...]]) -> DataFrame:
    """(name, node, component): nodes that lie on a directed cycle over a check's kinds; component is the
    least node of those that reach each other.

    Contraction: in what peeling leaves, every node picks one of its edges; the picks of a node lead to a
    cycle, which doubled jumps find in as many rounds as the logarithm of the number of nodes. What
    lies on one becomes one node, and so on until no edge is left. Picks are dealt anew in every round, so
    a short way back beside a long ring does not keep the ring from being found."""
    rounds = Rounds(t.spark, "strong")
    first = rounds.keep(_checked(t, checks).select("name", "src", "dst").distinct())
    itself = rounds.keep(first.where("src = dst").select("name", F.col("src").alias("node")))
    of = rounds.keep(first.select("name", F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("component", F.col("node")))
    edges = rounds.keep(first.where("src <> dst"))
    rounds.drop(first)
    turn = 0
    while True:
        edges = peel(rounds, edges, both=True)
        size = edges.groupBy("name").agg(F.count_distinct("src").alias("n")).agg(F.max("n")).first()[0]
        if not size:
            break
        turn += 1
        pick = edges.groupBy("name", "src").agg(F.min_by("dst", F.struct(F.xxhash64("src", "dst", F.lit(turn)), "dst")).alias("dst"))
        jump, steps = rounds.keep(pick.withColumn("least", F.col("src"))), 1
        while steps < size:  # least of the nodes from src up to, not with, dst
            on = jump.select("name", F.col("src").alias("dst"), F.col("dst").alias("to"), F.col("least").alias("other"))
            now = rounds.keep(jump.join(on, ["name", "dst"]).select("name", "src", F.col("to").alias("dst"), F.least("least", "other").alias("least")))
            rounds.drop(jump)
            jump, steps = now, 2 * steps
        cycle = jump.join(jump.select("name", F.col("dst").alias("src")).distinct(), ["name", "src"], "left_semi").select("name", "src", "least")
        cycle = rounds.keep(cycle.where("src <> least"))
        end = {x: cycle.select("name", F.col("src").alias(x), F.col("least").alias(f"{x}_of")) for x in ("src", "dst")}
        moved = edges.join(end["src"], ["name", "src"], "left").join(end["dst"], ["name", "dst"], "left")
        moved = moved.select("name", F.coalesce("src_of", "src").alias("src"), F.coalesce("dst_of", "dst").alias("dst")).where("src <> dst").distinct()
        now = rounds.keep(of.join(cycle.select("name", F.col("src").alias("component"), F.col("least").alias("to")), ["name", "component"], "left").select("name", "node", F.coalesce("to", "component").alias("component")))
        old, edges = edges, rounds.keep(moved)
        rounds.drop(old, of, jump, cycle)
        of = now
    several = of.groupBy("name", "component").agg(F.count("*").alias("n")).where("n > 1").select("name", "component")
    out = of.join(several, ["name", "component"], "left_semi").union(of.join(several, ["name", "component"], "left_anti").join(itself, ["name", "node"], "left_semi").select("name", "component", "node"))
    return out.select("name", "node", "component")
