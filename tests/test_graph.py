"""Queries, validation and differences against plain-Python models."""

import random
from dataclasses import replace

import pytest
from facility import BODY, DOCUMENT, HEAD, edges, levels, paths

from plantgraph.errors import PlantError
from plantgraph.operators import diff as diffs
from plantgraph.operators import queries as q
from plantgraph.operators import validate
from plantgraph.sources import canonical, grammar


@pytest.fixture(scope="module")
def t(spark):
    return grammar.read(spark, DOCUMENT)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_reach(t):
    for name, forward in (("src:w", True), ("sink:1", False), ("main-loop", True)):
        got = (q.downstream_of if forward else q.upstream_of)(t, name)
        assert sorted(rows(got.rows)) == sorted(levels(DOCUMENT, "loop:1" if name == "main-loop" else name, forward))
        assert not got.truncated
    assert q.upstream_of(t, "src:w").claim == "structurally_impossible"


def test_truncation(t):
    every = levels(DOCUMENT, "src:w", True)
    got = q.downstream_of(t, "src:w", most=3)
    assert got.truncated and sorted(rows(got.rows)) == sorted(every[:3])
    assert q.downstream_of(t, "src:w", depth=0).truncated
    assert q.downstream_of(t, "src:w", depth=max(r[1] for r in every)).truncated  # a frontier is left, leaf or not
    assert not q.downstream_of(t, "src:w", most=len(every)).truncated


def test_names(t):
    assert t.resolve("main-loop") == ("loop:1", "cooling_loop")
    for name, code in (("", "malformed_identifier"), ("nobody", "not_found")):
        with pytest.raises(PlantError) as e:
            t.resolve(name)
        assert e.value.code == code
    assert [r.edge_id for r in t.out_edges("main-loop").collect()] == ["c01", "c04", "e05", "e07", "p01", "r04"]


def test_sources(t):
    assert rows(q.sources_serving(t, "sink:1")) == [("src:w",), ("src:x",)]
    assert rows(q.sources_serving(t, "pump:1")) == [("src:w",), ("src:x",)]  # those of its host
    assert rows(q.sources_serving(t, "zone:1")) == []
    assert rows(t.structural_sources()) == [("src:w",), ("src:x",)]


def test_paths_and_circuits(t):
    found, pairs, sources = q.possible_supply_paths(t, "src:w", "sink:1")
    got = found.rows.orderBy("path_index").collect()
    assert [r.edges for r in got] == paths(DOCUMENT, "src:w", "sink:1", "supplies")
    assert all(r.passes_pump_host and r.crosses_changeover and r.origin_source_count == 1 for r in got)
    assert rows(pairs) == [] and sorted(rows(sources)) == [("src:w",), ("src:x",)]
    cut, _, _ = q.possible_supply_paths(t, "src:w", "sink:1", most=1)
    assert cut.truncated and cut.rows.count() == 1
    circuits = q.possible_circuits(t, "src:w", "sink:1").rows.orderBy("path_index").collect()
    assert [r.return_edges for r in circuits] == [["r01", "r02", "r03", "r04", "r05"]] * 2
    assert q.possible_circuits(t, "src:x", "sink:1").rows.isEmpty()


def test_dependencies(t):
    assert {r.node for r in q.common_dependencies(t, ["sink:1", "crah:1"]).collect()} == {"plant:a", "src:w"}
    got = {(r.node, r.subject): (r.disconnects_all, r.is_structural_source) for r in q.single_points(t, ["sink:1", "crah:1"]).collect()}
    assert got == {("loop:1", "sink:1"): (False, False), ("br:1", "sink:1"): (False, False), ("cdu:1", "sink:1"): (False, False), ("plant:a", "crah:1"): (False, False), ("src:w", "crah:1"): (False, True)}
    for names, code in (([], "empty_input"), (["sink:1"] * 65, "limit_exceeded")):
        with pytest.raises(PlantError) as e:
            q.common_dependencies(t, names)
        assert e.value.code == code


def test_groups(t):
    got = {r.group_id: r for r in q.redundancy_report(t).collect()}
    assert got["g:plants"].verdict == "declaration_consistent" and got["g:plants"].shared_sources == []
    assert got["g:pumps"].verdict == "independence_unproven" and got["g:pumps"].shared_sources == ["src:w", "src:x"]
    assert rows(q.redundancy_membership(t, "pump:1")) == [("g:pumps", 0, "pump:1")]
    assert q.structurally_mutually_exclusive(t, "x:1", ("plant:a", "source_in"), ("plant:b", "source_in"))
    assert not q.structurally_mutually_exclusive(t, "x:1", ("plant:a", "source_in"), ("plant:a", "source_in"))


def test_service(t):
    got = {r.sink: r for r in q.sink_reports(t).collect()}
    assert (got["sink:1"].feeders, got["sink:1"].verdict) == (["cdu:1"], "single_feed")
    assert got["sink:2"].verdict == "no_structural_feed"
    zones = {r.zone: r for r in q.zone_reports(t).collect()}
    assert (zones["zone:1"].serving, zones["zone:1"].sinks, zones["zone:1"].verdict) == (["crah:1"], ["sink:1", "sink:2"], "served")
    assert zones["zone:2"].verdict == "unpopulated"
    with pytest.raises(PlantError):
        q.sink_service_report(t, "zone:1")


def test_blast(t):
    b = q.blast_radius(t, "plant:a", include_containment_peers=True)
    assert rows(b.sinks) == [("sink:1",)] and rows(b.zones) == [("zone:1",)] and rows(b.peers) == []
    assert rows(q.blast_radius(t, "br:1", True).peers) == [("loop:1", "contains_origin"), ("pump:1", "sibling")]


def test_components(t):
    got = {r.node: (r.component, r.isolated) for r in q.connected_components(t).collect()}
    assert got.pop("zone:2") == ("zone:2", True)
    assert set(got.values()) == {("br:1", False)}


def test_random_graphs(spark):
    rng = random.Random(7)
    for size in (6, 9):
        body = "".join(f"node n{i} cooling_loop kind=primary\n" for i in range(size))
        pairs = {(a, b) for a in range(size) for b in range(a + 1, size) if rng.random() < 0.4}
        body += "".join(f"edge e{a}-{b} supplies n{a}.supply_out -> n{b}.source_in\n" for a, b in sorted(pairs))
        t = grammar.read(spark, HEAD + body)
        assert sorted(rows(q.downstream_of(t, "n0").rows)) == sorted(levels(body, "n0", True))
        assert [r.edges for r in q.possible_supply_paths(t, "n0", f"n{size - 1}")[0].rows.orderBy("path_index").collect()] == paths(body, "n0", f"n{size - 1}", "supplies")
        last = f"n{size - 1}"
        origins = {f"n{i}" for i in range(size)} - {y for _, _, y, *_ in edges(body, "supplies")}
        want = set()
        for c in {r[0] for r in levels(body, last, False)}:
            seen, todo = set(), [o for o in origins if o != c]
            while todo:
                x = todo.pop()
                if x not in seen:
                    seen.add(x)
                    todo += [y for _, a, y, *_ in edges(body, "supplies") if a == x and y != c]
            if last not in seen:
                want.add(c)
        assert {r.node for r in q.single_points(t, [last]).collect()} == want


def issues(spark, document):
    report = validate.validate(grammar.read(spark, document))
    return [(r.code, r.subject) for r in report.issues.collect()]


def test_valid(spark):
    assert issues(spark, DOCUMENT) == [("sink_feed_absent", "sink:2"), ("isolated_element", "zone:2"), ("zone_service_absent", "zone:2")]  # by subject, then code


@pytest.mark.parametrize(
    ("more", "want"),
    [
        ("edge z supplies zone:1.supply_out -> loop:1.source_in\nedge y supplies loop:1.supply_out -> src:w.source_in\nedge w serves plant:a.server -> zone:1.served", [("invalid_edge_kind_pair", "z"), ("source_terminal_invalid", "y"), ("plant_boundary_invalid", "w"), ("supply_cycle", "e01"), ("group_independent_path_unproven", "g:plants/plant:b")]),  # loop:1 feeds src:w, so src:x is the one origin left
        ("edge z supplies loop:2.supply_out -> loop:1.source_in", [("supply_cycle", "e05"), ("loop_kind_mismatch", "z")]),
        ("edge z supplies nobody.supply_out -> loop:1.source_in\nedge y supplies loop:1.supply_out -> loop:1.source_in\nedge x supplies src:w.supply_out -> plant:a.source_in", [("endpoint_missing", "z"), ("self_edge", "y"), ("duplicate_edge", "x"), ("supply_cycle", "y")]),
        ("node br:9 branch kind=rack_branch\nnode pump:9 pump kind=centrifugal role=duty\nedge z contains loop:2.container -> br:1.contained", [("missing_container", "br:9"), ("pump_attachment_invalid", "pump:9"), ("ambiguous_parentage", "br:1"), ("isolated_element", "br:9"), ("isolated_element", "pump:9")]),
        ("alias a1 nobody\nalias a2 a1\nalias loop:2 loop:1", [("alias_target_missing", "a1"), ("alias_cycle", "a2"), ("identity_conflict", "loop:2")]),
        ("group g:1 scope=plant require-distinct-failure-domains require-independent-sources plant:a@x main-loop plant:a@x ghost\ngroup g:2 scope=cooling_loop require-independent-sources loop:1 loop:2", [("group_scope_invalid", "g:1/main-loop"), ("group_member_duplicate", "g:1/plant:a"), ("group_member_missing", "g:1/ghost"), ("group_redundancy_unproven", "g:1/plant:a"), ("group_redundancy_unproven", "g:1/ghost"), ("group_redundancy_unproven", "g:1/main-loop"), ("group_independent_path_unproven", "g:2/loop:2")]),
        ("changeover x:2 max=1 plant:a.supply_out ghost.source_in sink:2.source_in plant:b.source_in plant:b.source_in", [("changeover_member_invalid", "x:2/plant:a"), ("changeover_member_invalid", "x:2/ghost"), ("constraint_unsatisfied", "x:2/sink:2"), ("changeover_member_duplicate", "x:2/plant:b")]),
        ("edge z depends_on br:1.terminal -> loop:1.terminal", [("dependency_cycle", "c01")]),
        ("node hot cooling_source kind=well medium=glycol design-supply=30.000\nedge z supplies hot.supply_out -> plant:a.source_in\nedge y supplies hot.supply_out -> sink:2.source_in", [("medium_mismatch", "z"), ("temperature_incompatible", "y")]),
    ],
)
def test_rules(spark, more, want):
    if "temperature" in str(want):
        more = more.replace("hot.supply_out -> sink:2", "hot.supply_out -> sink:3") + "\nnode sink:3 cooling_sink kind=rack_load consumer=c max-supply=20.000\nedge cc contains zone:1.container -> sink:3.contained"
    base = [("isolated_element", "zone:2"), ("sink_feed_absent", "sink:2"), ("zone_service_absent", "zone:2")]
    got = [x for x in issues(spark, DOCUMENT + more + "\n") if x not in base]
    assert sorted(got) == sorted(want)


def test_primary_error_stops_a_build(spark):
    with pytest.raises(PlantError) as e:
        canonical.build(grammar.read(spark, DOCUMENT + "edge z supplies loop:2.supply_out -> loop:1.source_in\nalias q nobody\n"))
    assert (e.value.code, e.value.subject) == ("alias_target_missing", "q") and len(e.value.details) == 2


def test_row_order_does_not_matter(spark):
    lines = (DOCUMENT + "edge z supplies loop:2.supply_out -> loop:1.source_in\n").splitlines()
    assert issues(spark, "\n".join(lines)) == issues(spark, "\n".join(lines[:2] + lines[:1:-1]))


def test_diff(spark, t):
    later = HEAD + BODY.replace("alias main-loop loop:1", "alias main-loop loop:2").replace("edge s01", "edge s02").replace("node zone:2 thermal_zone class=rack", 'node zone:2 thermal_zone class=pod name="two"').replace("edge e09 supplies cdu:1.supply_out -> sink:1.source_in\n", "")
    d = diffs.diff(t, grammar.read(spark, later))
    assert rows(d.entries) == [("node_changed", "zone:2", 'name=""->"two"'), ("edge_added", "s02", ""), ("edge_removed", "e09", ""), ("edge_removed", "s01", ""), ("alias_added", "main-loop", "target=loop:1->loop:2")]
    assert (d.node_delta, d.edge_delta, d.same_facility) == (0, -1, True)
    assert sorted(rows(d.unfed_sinks)) == [("sink:1",), ("sink:2",)] and rows(d.unserved_zones) == [("zone:2",)]
    assert any("sink:1 has no structural supply route" in line for line in diffs.explain(d))


def test_diff_is_cut_before_it_is_sorted(spark, t):
    later = HEAD + BODY.replace("alias main-loop loop:1", "alias main-loop loop:2").replace("edge s01", "edge a01").replace("node zone:2 thermal_zone class=rack", "node zone:2 thermal_zone class=rack name=two")
    after = grammar.read(spark, later)
    after.limits = replace(after.limits, diff_entries=2)
    d = diffs.diff(t, after)
    assert rows(d.entries) == [("node_changed", "zone:2", 'name=""->"two"'), ("edge_added", "a01", "")] and d.truncated
    assert "impact: analysis stopped at a configured bound; the report is a prefix" in diffs.explain(d)
    assert not diffs.diff(t, t).truncated
