"""Paths, returns, routes, dominators and cycles on made graphs against sequential searches."""

import random
import time
from dataclasses import replace

import pytest
from facility import HEAD, first_cycle, greedy_routes, most_routes, sequential_paths, sequential_return, step_table, strong

from plantgraph import schema
from plantgraph.operators import cycles, validate, ways
from plantgraph.operators import queries as q
from plantgraph.sources import grammar
from plantgraph.topology import Topology


def graph(spark, own, limits=schema.UNBOUNDED):
    """A topology of loops over edges (edge, kind, src, dst)."""
    names = sorted({n for _, _, x, y in own for n in (x, y)})
    nodes = [(n, "cooling_loop", "primary", None, None, None, None, None, "", []) for n in names]
    t = Topology.of_rows(spark, {"nodes": nodes, "edges": [(e, k, x, "supply_out", y, "source_in") for e, k, x, y in own]}, limits=limits)
    return t


def layered(rng, layers, width, kind="supplies", share=0.5, noise=True):
    own = [(f"e{rng.randrange(10**6):06d}", kind, f"n{a:02d}{i}", f"n{b:02d}{j}") for a in range(layers) for b in (a + 1, a + 2) for i in range(width) for j in range(width) if b < layers and rng.random() < share / (b - a)]
    if noise:
        own += [(f"e{rng.randrange(10**6):06d}", "contains", f"n{a:02d}0", f"n{a:02d}1") for a in range(layers)]
        own += [(f"e{rng.randrange(10**6):06d}", kind, f"n{a:02d}{rng.randrange(width)}", f"x{a}") for a in range(layers - 1)]
    return list({e: (e, k, x, y) for e, k, x, y in own}.values())


def edges_of(rows):
    return [r.edges for r in rows.orderBy("path_index").collect()]


def test_paths_under_every_bound(spark):
    rng = random.Random(3)
    own = layered(rng, 4, 2)
    t = graph(spark, own)
    a, b = "n000", "n031"
    every, _ = sequential_paths(own, a, b, 10**6, 10**6, 128)
    bounds = [(10**6, 10**6, 128), (2, 10**6, 128), (10**6, 9, 128), (10**6, 10**6, 2), (len(every), 10**6, 3)]
    for most, search, length in bounds:
        found, cut = ways.first_paths(t, a, b, "supplies", most, search, length)
        assert (edges_of(found), cut) == sequential_paths(own, a, b, most, search, length), (most, search, length)


def test_reference_budget(spark):
    """The search budget of the reference profile ends a search among many parallel ways."""
    own = [(f"e{i:02d}{s}{d}", "supplies", f"n{i:02d}{s}", f"n{i + 1:02d}{d}") for i in range(5) for s in ("a", "b") for d in ("a", "b")]
    t = graph(spark, own, replace(schema.REFERENCE, search=25, paths=40))
    found, _, _ = q.possible_supply_paths(t, "n00a", "n05a")
    want, cut = sequential_paths(own, "n00a", "n05a", 40, 25, 128)
    assert (edges_of(found.rows), found.truncated) == (want, cut) and cut and want


def test_many_diamonds(spark):
    """2^11 paths: the first 512 take as many prefixes, not as many walks."""
    own = [(f"e{i:02d}{s}", "supplies", f"j{i:02d}", f"m{i:02d}{s}") for i in range(11) for s in "ab"] + [(f"f{i:02d}{s}", "supplies", f"m{i:02d}{s}", f"j{i + 1:02d}") for i in range(11) for s in "ab"]
    t = graph(spark, own, replace(schema.UNBOUNDED, paths=512))
    began = time.time()
    found, cut = ways.first_paths(t, "j00", "j11", "supplies", 512, None, 128)
    assert cut and found.count() == 512 and time.time() - began < 240
    assert edges_of(found) == sequential_paths(own, "j00", "j11", 512, 10**9, 128)[0]


def test_returns(spark):
    own = layered(random.Random(8), 4, 2, kind="returns")  # found after 12 inspected edges, some of them in dead ends
    t = graph(spark, own)
    for search, length in ((12, 128), (11, 128), (None, 2)):
        found, cut = ways.way_back(t, "n000", "n031", "returns", search, length)
        want, stopped = sequential_return(own, "n000", "n031", search or 10**6, 128)
        want, stopped = (None, True) if length == 2 else (want, stopped)  # a way of three edges is not replaced
        assert (edges_of(found), cut) == ([want] if want is not None else [], stopped), (search, length)
    far, cut = ways.way_back(t, "n031", "n000", "returns", None, 128)
    assert far.isEmpty() and not cut


def test_returns_wind_through_cycles(spark):
    """Detours that would come back to a node of the way are not taken."""
    own = [(e, "returns", *p.split()) for e, p in {"a": "n0 n1", "b": "n1 n2", "c": "n2 n0", "d": "n2 n1", "e": "n1 n3", "f": "n3 n5", "g": "n0 n3"}.items()]
    found, cut = ways.way_back(graph(spark, own), "n0", "n5", "returns", None, 128)
    assert edges_of(found) == [sequential_return(own, "n0", "n5", 10**6, 128)[0]] == [["a", "e", "f"]] and not cut


def test_paths_in_a_draft_with_a_cycle(spark):
    own = [("a", "supplies", "s", "x"), ("b", "supplies", "x", "y"), ("c", "supplies", "y", "x"), ("d", "supplies", "y", "t"), ("e", "supplies", "x", "t")]
    found, cut = ways.first_paths(graph(spark, own), "s", "t", "supplies", None, None, 128)
    assert edges_of(found) == [["a", "b", "d"], ["a", "e"]] and not cut


def test_routes(spark):
    pairs = ["s-a", "a-b", "b-t", "a-e", "e-f", "f-t", "s-c", "c-d", "d-b"]
    own = [(p, "supplies", *p.split("-")) for p in pairs]
    t = graph(spark, own)
    found = q.independent_supply_paths(t, "s", "t")
    assert edges_of(found.rows) == [["s-a", "a-b", "b-t"]] and not found.truncated  # greedy 1, greatest 2
    assert q.max_disjoint_supply_paths(t, "s", "t").first().routes == 2
    own = layered(random.Random(2), 4, 3)
    t = graph(spark, own)
    for search in (17,):
        found = q.independent_supply_paths(t, "n000", "n031", search=search)
        assert (edges_of(found.rows), found.truncated) == greedy_routes(own, "n000", "n031", 10**6, search or 10**9), search
    assert q.max_disjoint_supply_paths(t, "n000", "n031").first().routes == most_routes(own, "n000", "n031") == 2
    assert q.independent_supply_paths(t, "n000", "n000").rows.isEmpty() and q.max_disjoint_supply_paths(t, "n031", "n000").first().routes == 0


def test_single_points_behind_cycles(spark):
    """Dominators of a graph with cycles, against removing each candidate and flooding again."""
    rng = random.Random(9)
    for _ in range(2):
        size = 9
        own = {(rng.randrange(size), rng.randrange(1, size)) for _ in range(15)} | {(0, 1), (1, 2), (2, 3), (3, 1)}
        own = [(f"e{x}{y}", "supplies", f"n{x}", f"n{y}") for x, y in sorted(own)]
        t = graph(spark, own)
        out = step_table(own, "supplies")
        names = {n for _, _, x, y in own for n in (x, y)}
        origins = names - {y for *_, y in own}

        def flood(start, without=None, out=out):
            seen, todo = set(), [o for o in start if o != without]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for _, _, y in out[x] if y != without]
            return seen

        subjects = [n for n in ("n3", "n8", "n5") if n in names]
        want = {(c, s) for s in subjects for c in names if any(z in flood([c]) for z in subjects if z != c) and c != s and s not in flood(origins, c)}
        assert {(r.node, r.subject) for r in q.single_points(t, subjects).collect()} == want


def test_cycles(spark):
    rng, n = random.Random(12), 10
    if n:
        own = [(f"e{i:02d}", rng.choice(["supplies", "returns"]), f"n{rng.randrange(n)}", f"n{rng.randrange(n)}") for i in range(n + 3)]
        t = graph(spark, own)
        checks = {"s": ("supplies",), "r": ("returns",), "both": ("supplies", "returns"), "none": ("serves",)}
        of = {c: [(e, x, y) for e, k, x, y in own if k in kinds] for c, kinds in checks.items()}
        assert {r["name"]: r.edges for r in cycles.cycles(t, checks).collect()} == {c: first_cycle(x) for c, x in of.items() if first_cycle(x)}
        assert {(r["name"], r.node): r.component for r in cycles.strong_components(t, checks).collect()} == {(c, x): y for c, o in of.items() for x, y in strong(o).items()}


@pytest.mark.parametrize("kind", ["returns", "contains"])
def test_cycle_rules_of_each_kind(spark, kind):
    ports = {"returns": ("heat_out", "return_in"), "contains": ("container", "contained")}[kind]
    body = "".join(f"node l{i} cooling_loop kind=primary\n" for i in range(3))
    body += "".join(f"edge z{i} {kind} l{i}.{ports[0]} -> l{(i + 1) % 3}.{ports[1]}\n" for i in range(3))
    got = {(r.code, r.subject) for r in validate.validate(grammar.read(spark, HEAD + body)).issues.collect()}
    assert {("return_cycle", "z0")} <= got if kind == "returns" else {("containment_cycle", "z0"), ("dependency_cycle", "z0")} <= got
