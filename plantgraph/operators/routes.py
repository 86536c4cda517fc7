"""Edge-disjoint routes in rounds of breadth-first levels.

The greedy search takes breadth-first routes, each over edges that no earlier one used, and never
gives an edge back: a maximal set, which can be smaller than the greatest. The greatest number is
found with residual edges: each round builds the levels from the start and sends tokens back from
the end, level by level; every node passes each token on over an edge of its own, so the tokens that
arrive are routes without a common edge, and all of them are taken at once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.steps import Rounds
from ..topology import Topology
from . import traverse as tr
from . import ways

ROUTE = "path_index long, edges array<string>, nodes array<string>"


def greedy(t: Topology, a: str, b: str, most: int | None, search: int | None) -> tuple[DataFrame, bool]:
    """(path_index, edges, nodes) of the routes in the order they are found, and whether the budget of
    inspected edges, which all rounds share, ended the search. Of a level the least node goes first,
    and of its edges the least: a node is entered from the least pair of both."""
    none = t.spark.createDataFrame([], ROUTE)
    if a == b:
        return none, False
    rounds = Rounds(t.spark, "routes")
    if search is None:
        edges = ways.between(t, a, b, "supplies").select("src", "edge_id", "dst", F.lit(True).alias("follow"), F.lit(0).cast("long").alias("pos"))
    else:  # what leads nowhere costs steps too
        met = tr.closure(t, t.spark.createDataFrame([(a, a)], "key string, node string"), ("supplies",), True, stop=b).select(F.col("node").alias("src"))
        place = F.row_number().over(Window.partitionBy("src").orderBy("edge_id")).cast("long")
        edges = t.edges_resolved.where("src IS NOT NULL").join(met, "src", "left_semi").select("src", "edge_id", "dst", (F.col("dst").isNotNull() & (F.col("kind") == "supplies")).alias("follow"), place.alias("pos"))
    edges = rounds.keep(edges)
    degree = rounds.keep(edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n_all")))
    routes: list[tuple[int, list[str], list[str]]] = []
    spent = 0
    while most is None or len(routes) < most:
        used = [(e,) for _, own, _ in routes for e in own]  # no more than the answer itself
        left = edges.where("follow").join(F.broadcast(t.spark.createDataFrame(used, "edge_id string")), "edge_id", "left_anti")
        known = frontier = t.spark.createDataFrame([(a,)], "node string")
        levels: list[DataFrame] = []
        end = None
        while end is None:
            step = frontier.join(left, frontier.node == left.src).groupBy(F.col("dst").alias("node")).agg(F.min(F.struct(F.col("src").alias("parent"), "edge_id", "pos")).alias("w"))
            step = rounds.keep(step.join(known, "node", "left_anti").select("node", "w.parent", "w.edge_id", "w.pos"))
            end = step.where(F.col("node") == b).first()
            if search is not None:
                own = frontier.join(degree, "node")
                spent += own.where(F.col("node") < end.parent if end else F.lit(True)).agg(F.coalesce(F.sum("n_all"), F.lit(0))).first()[0] + (end.pos if end else 0)
                if spent > search:
                    return _told(t, routes), True
            if end is None:
                if step.isEmpty():
                    return _told(t, routes), False
                levels.append(step)
                frontier = step.select("node")
                known = known.union(frontier)
        own, nodes = [end.edge_id], [b, end.parent]
        for level in reversed(levels):
            entered = level.where(F.col("node") == nodes[-1]).first()
            own.append(entered.edge_id)
            nodes.append(entered.parent)
        routes.append((len(routes), own[::-1], nodes[::-1]))
        rounds.drop_all_but(edges, degree)
    return _told(t, routes), False


def _told(t: Topology, routes: list) -> DataFrame:
    return t.spark.createDataFrame(routes, ROUTE)


def greatest(t: Topology, a: str, b: str) -> int:
    """How many edge-disjoint supply routes can exist at once."""
    if a == b:
        return 0
    rounds = Rounds(t.spark, "flow")
    edges = rounds.keep(ways.between(t, a, b, "supplies").select("edge_id", "src", "dst"))
    used = t.spark.createDataFrame([], "edge_id string")
    total = 0
    while True:
        forward = edges.join(used, "edge_id", "left_anti").select("edge_id", F.col("src").alias("here"), F.col("dst").alias("there"), F.lit(False).alias("back"))
        residual = rounds.keep(forward.union(edges.join(used, "edge_id", "left_semi").select("edge_id", "dst", "src", F.lit(True))))
        levels = [t.spark.createDataFrame([(a,)], "node string")]
        while True:
            known = reduce(DataFrame.union, levels)
            step = rounds.keep(levels[-1].join(residual, F.col("node") == F.col("here")).select(F.col("there").alias("node")).distinct().join(known, "node", "left_anti"))
            if step.isEmpty():
                return total
            levels.append(step)
            if not step.where(F.col("node") == b).isEmpty():
                break
        into = residual.where(F.col("there") == b).join(levels[-2].withColumnRenamed("node", "here"), "here", "left_semi")
        tokens = rounds.keep(into.select(F.col("edge_id").alias("token"), F.col("here").alias("node"), F.col("edge_id"), "back"))
        trail = [tokens]
        for depth in range(len(levels) - 3, -1, -1):
            into = residual.join(levels[depth].withColumnRenamed("node", "here"), "here", "left_semi").join(tokens.select(F.col("node").alias("there")).distinct(), "there", "left_semi")
            into = into.withColumn("n", F.row_number().over(Window.partitionBy("there").orderBy("edge_id")))
            asked = tokens.select("token", F.col("node").alias("there"), F.row_number().over(Window.partitionBy("node").orderBy("token")).alias("n"))
            tokens = rounds.keep(asked.join(into, ["there", "n"]).select("token", F.col("here").alias("node"), "edge_id", "back"))
            trail.append(tokens)
        arrived = tokens.select("token").distinct()
        taken = reduce(DataFrame.union, trail).join(arrived, "token", "left_semi").select("edge_id", "back")
        total += arrived.count()
        now = used.join(taken.where("back"), "edge_id", "left_anti").select("edge_id").union(taken.where("NOT back").select("edge_id"))
        used = rounds.keep(now)
        rounds.drop_all_but(edges, used)
