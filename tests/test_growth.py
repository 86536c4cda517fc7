"""What a query costs as its graph grows: rounds, tables read and rows shuffled; answers do not change."""

import pytest

from plantgraph import schema
from plantgraph.operators import adjacency, cycles, traverse, validate, ways
from plantgraph.operators import queries as q
from plantgraph.plans import projection
from plantgraph.plans.steps import Rounds
from plantgraph.topology import Topology


def graph(spark, pairs, kind="supplies", nodes="manifold", **more):
    names = sorted({x for p in pairs for x in p})
    edges = [(f"e-{a}-{b}", kind, a, "supply_out", b, "source_in") for a, b in pairs]
    rows = {"nodes": [(n, nodes, "supply", None, None, None, None, None, "", []) for n in names], "edges": edges}
    return Topology.of_rows(spark, rows, limits=schema.UNBOUNDED, **more)


@pytest.fixture
def kept(monkeypatch):
    """How many tables are kept."""
    made = []
    keep = Rounds.keep
    monkeypatch.setattr(Rounds, "keep", lambda self, df: (made.append(1), keep(self, df))[1])
    return made


def test_a_long_ring_takes_few_rounds(spark, kept):
    n = 64
    ring = [(f"n{i:03}", f"n{(i + 1) % n:03}") for i in range(n)] + [(f"n{i:03}", f"n{i - 1:03}") for i in range(3, n, 3)]
    t = graph(spark, [*ring, ("n005", "out"), ("in", "n007"), ("self", "self"), ("n009", "self")])
    found = {(r.node, r.component) for r in cycles.strong_components(t, {"x": ("supplies",)}).collect()}
    assert found == {(a, "n000") for a, _ in ring} | {("self", "self")}
    assert len(kept) < n


def test_few_nodes_are_met_by_name(spark, monkeypatch):
    t = graph(spark, [("a'1", "b"), ("b", "c"), ("x\\\\", "c"), ("c", "d"), ("y", "z")])
    laid = []
    monkeypatch.setattr(adjacency, "Adjacency", lambda *_: laid.append(1))
    assert {r.node for r in q.sources_serving(t, "d").collect()} == {"a'1", "x\\\\"}
    seed = spark.createDataFrame([("d", "d")], "key string, node string")
    assert {r.node for r in traverse.closure(t, seed, ("supplies",), False).collect()} == {"a'1", "b", "c", "d", "x\\\\"}
    assert not laid


def test_groups_of_names_bound_walks(spark):
    t = graph(spark, [("a1", "b1"), ("b1", "c1"), ("a2", "c2")])
    assert ways.shallow(t, "supplies", 3) and not ways.shallow(t, "supplies", 2)
    assert not ways.shallow(graph(spark, [("a1", "a2")]), "supplies", 128)


def test_origins_keep_no_set_of_all_nodes(spark):
    """Edges are dealt out as they come: no task tells apart all the nodes it has seen."""
    origins = projection.project(spark, "/root/testdata/sf0.001").origins()
    assert "Aggregate" not in origins._jdf.queryExecution().sparkPlan().toString()
    assert {r.node_id for r in origins.collect()} == {f"src:r{i}" for i in range(5)}


def test_names_are_looked_for_as_keys_of_the_tables_that_have_them(spark, monkeypatch):
    """A traversal that never meets a part or an order does not read them; nor does it lay edges out."""
    t = projection.project(spark, "/root/testdata/sf0.001")
    own = traverse.layout(t.links("supplies"), False)
    plan = own.where(adjacency.named("here", ["loop:s1", "plant:n3"], own.columns))._jdf.queryExecution().optimizedPlan().toString()
    assert "l_partkey" not in plan and "s_suppkey" in plan
    assert "In(" not in plan and "concat(loop:s, 1)" not in plan
    assert adjacency.keys_of("sink:o-5") == [("sink:o-", 5), ("sink:o", -5)] and adjacency.keys_of("sink:o05") == []
    seeds = t.nodes.where("kind = 'cooling_loop'").selectExpr("node_id key", "node_id node")
    want = {tuple(r) for r in traverse.closure(t, seeds, ("supplies",), False).collect()}
    sets = {tuple(r) for r in traverse.source_sets(t, seeds).collect()}
    laid = []
    make = adjacency.Adjacency
    monkeypatch.setattr(adjacency, "Adjacency", lambda *x: (laid.append(1), make(*x))[1])
    monkeypatch.setattr(adjacency, "FEW", 2)
    assert {tuple(r) for r in traverse.closure(t, seeds, ("supplies",), False).collect()} == want
    assert {tuple(r) for r in traverse.source_sets(t, seeds).collect()} == sets
    assert not laid


def test_edges_of_hubs_are_not_brought_together(spark, monkeypatch):
    """Components are the same when hubs are told apart, whatever the ends' order."""
    pairs = [("a", f"x{i}") for i in range(9)] + [("zz", f"y{i}") for i in range(9)] + [("y3", "x4"), ("p", "q"), ("q", "r"), ("s", "r"), ("m1", "m0")]
    t = graph(spark, pairs)
    want = {(r.node, r.component) for r in q.connected_components(t).collect()}
    assert {c for n, c in want if n[0] in "axyz"} == {"a"} and {c for n, c in want if n in "pqrs"} == {"p"} and ("m1", "m0") in want
    met = []
    beside = traverse._beside
    monkeypatch.setattr(traverse, "_beside", lambda e, on, least, n: (met.append(least.where("n > 3").count()), beside(e, on, least, n))[1])
    monkeypatch.setattr(traverse, "HUB", 3)
    monkeypatch.setattr(traverse, "ROWS", 4)
    assert {(r.node, r.component) for r in q.connected_components(t).collect()} == want
    assert any(met)


def test_pairs_of_members_are_not_grouped(spark):
    """The source that two members share is found for their classes; pairs of members are only joined."""
    rows = [("g", i, f"g/{i}", s) for i, own in enumerate(["ab", "ab", "b", "c", "bc", "ab"]) for s in own] + [("h", 0, "h/0", "a"), ("h", 1, "h/1", "a")]
    own = spark.createDataFrame(rows, "group_id string, i int, label string, source string")
    found = validate._sharing(graph(spark, [("a", "b")]), own)
    sets = {}
    for g, i, _, s in rows:
        sets.setdefault((g, i), set()).add(s)
    want = sorted((f"{h}/{j}", min(x & y)) for (g, i), x in sets.items() for (h, j), y in sets.items() if g == h and i < j and x & y)
    assert sorted(map(tuple, found.collect())) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") <= 1


def test_pairs_of_members_are_dealt_over_tasks(spark, monkeypatch):
    """What writes the pairs joins nothing and grows with them, however few rows the members are."""
    monkeypatch.setattr(validate, "PAIRS", 50, raising=False)
    monkeypatch.setattr(validate, "RUN", 7, raising=False)
    rows = [("g", i, f"g/{i}", s) for i in range(40) for s in ("ab" if i % 3 else "bc")]
    found = validate._sharing(graph(spark, [("a", "b")]), spark.createDataFrame(rows, "group_id string, i int, label string, source string"))
    sets = [set("ab" if i % 3 else "bc") for i in range(40)]
    assert sorted(map(tuple, found.collect())) == sorted((f"g/{j}", min(sets[i] & sets[j])) for j in range(40) for i in range(j))
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert found.rdd.getNumPartitions() == -(-780 // 50)
    assert validate._sharing(graph(spark, [("a", "b")]), spark.createDataFrame([], "group_id string, i int, label string, source string")).collect() == []


def test_components_are_found_by_numbers_in_few_rounds(spark, monkeypatch, tmp_path):
    """Nodes pick their least neighbours and chains become one node: rounds do not grow with a path. Numbers in place of
    names change no answer, and keys that they have no room for are told by name."""
    rounds = []
    to_roots = traverse._to_roots
    monkeypatch.setattr(traverse, "_to_roots", lambda *x: (rounds.append(1), to_roots(*x))[1])
    path = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)] + [("z9", "n060"), ("z1", "z9"), ("b", "z1"), ("b", "z8"), ("q", "q"), ("y", "x")]
    t = graph(spark, path)
    of = {r.node: (r.component, r.isolated) for r in q.connected_components(t).collect()}
    assert len(rounds) <= 3 and of.pop("q") == ("q", False)
    assert of.pop("x") == of.pop("y") == ("x", False) and set(of.values()) == {("b", False)} and len(of) == 65
    t = projection.project(spark, "/root/testdata/sf0.001")
    rounds.clear()
    numbered = sorted(map(tuple, q.connected_components(t).collect()))
    assert t.numbers() and len(rounds) <= 3
    t._made.pop("numbers")
    assert not t.numbers() and sorted(map(tuple, q.connected_components(t).collect())) == numbered
    for name in ("region", "nation", "supplier", "customer", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
        rows = rows.withColumns({c: -rows[c] for c in rows.columns if c.endswith("custkey")})
        rows.write.parquet(f"{tmp_path}/{name}.parquet")
    t = projection.project(spark, str(tmp_path))
    assert t.numbers() is None
    assert sorted(r.component for r in q.connected_components(t).collect()) == [c for _, c, _ in sorted(numbered, key=lambda r: r[1])]
