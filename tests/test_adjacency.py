"""Edge layouts: plans that leave the edges in place, hubs in parts, and answers that do not change."""

import random
from collections import Counter

import pytest
from facility import DOCUMENT

from plantgraph.operators import adjacency, traverse
from plantgraph.operators.adjacency import Adjacency
from plantgraph.plans.steps import Rounds
from plantgraph.sources import grammar

EDGE = "here string, there string, edge_id string"


def star(spark, n=900):
    """A third of all edges from one node, the others from a node each; a repeated edge and a null."""
    rows = [("hub", f"n{i}", f"h{i}") for i in range(n // 3)] + [(f"n{i}", f"n{i + 1}", f"e{i}") for i in range(2 * n // 3)]
    rows += [("n5", "n6", "e5"), (None, "n1", "x")]
    return rows, spark.createDataFrame(rows, EDGE)


@pytest.fixture
def shuffled(spark):
    """Joins by shuffles, as with frontiers too large for a broadcast, and plans as they are first made."""
    for k, v in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
        spark.conf.unset(k)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("hub", [10**6, 20])
def test_only_the_frontier_is_exchanged(spark, shuffled, monkeypatch, hub):
    monkeypatch.setattr(adjacency, "LEAST", 0)
    monkeypatch.setattr(adjacency, "HUB", hub)
    rows, edges = star(spark)
    along = Adjacency(Rounds(spark, "t"), edges)
    frontier = spark.createDataFrame([("hub", 1), ("n5", 2), ("nowhere", 3)], "node string, key int")
    df = along.follow(frontier)
    assert (along.split is None) == (hub > 900)
    text = plan(df)
    scans = [line for line in text.splitlines() if "FileScan" in line and "kept_" in line]
    assert scans and all("Bucketed: true" in line for line in scans)
    # the frontier once for plain edges; for hubs once to meet them, the hubs themselves, once to the parts
    assert text.count("Exchange hashpartitioning") == (1 if along.split is None else 4)
    key = {"hub": 1, "n5": 2}
    assert Counter((r.node, r.key, r.there, r.edge_id) for r in df.collect()) == Counter((h, key[h], t, e) for h, t, e in rows if h in key)
    along.drop()


def test_edges_of_a_hub_are_dealt_over_parts(spark, monkeypatch):
    monkeypatch.setattr(adjacency, "LEAST", 0)
    monkeypatch.setattr(adjacency, "HUB", 20)
    _, edges = star(spark)
    along = Adjacency(Rounds(spark, "t"), edges)
    (hub,) = along.hubs.collect()
    assert (hub.hub, hub.parts) == ("hub", 15)
    parts = {r.part: r["count"] for r in along.split.groupBy("part").count().collect()}
    assert sum(parts.values()) == 300 and len(parts) == 15 and max(parts.values()) <= 2 * 20
    assert along.plain.where("here = 'hub'").isEmpty() and along.plain.where("here IS NULL").count() == 1
    names = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    along.drop()
    assert {r.tableName for r in spark.sql("SHOW TABLES").collect()} < names


def test_an_empty_layout(spark):
    along = Adjacency(Rounds(spark, "t"), star(spark)[1].limit(0))
    assert along.follow(spark.createDataFrame([("a",)], "node string")).collect() == []
    along.drop()


def test_traversals_do_not_depend_on_hubs(spark, monkeypatch):
    rng = random.Random(11)
    t = grammar.read(spark, DOCUMENT)
    origin = rng.choice(sorted(r.src for r in t.of_kind("supplies").select("src").distinct().collect()))
    seeds = t.of_kind("supplies").select(t.edges_resolved.edge_id.alias("key"), t.edges_resolved.src.alias("node"))
    members = t.nodes.where("kind = 'cooling_sink'").selectExpr("node_id AS key", "node_id AS node")

    def answers():
        reach, cut = traverse.breadth_first(t, origin, ("supplies",), True)
        closed = traverse.closure(t, seeds, ("supplies",), True)
        sources = traverse.source_sets(t, members)
        return sorted(map(tuple, reach.collect())), cut, sorted(map(tuple, closed.collect())), sorted(map(tuple, sources.collect()))

    want = answers()
    assert want[0] and want[3]
    monkeypatch.setattr(adjacency, "LEAST", 0)
    monkeypatch.setattr(adjacency, "HUB", 1)
    assert answers() == want
