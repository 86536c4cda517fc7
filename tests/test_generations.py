"""Generations kept as partitioned tables: time travel, links, digests, differences by bucket."""

from dataclasses import replace

import pytest
from facility import BODY, DOCUMENT, HEAD

from plantgraph.errors import PlantError
from plantgraph.operators import diff as diffs
from plantgraph.sources import grammar
from plantgraph.sources.generations import Generations


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    out = Generations(spark, str(tmp_path_factory.mktemp("generations")), buckets=16)
    assert out.head() == 0 and out.history().isEmpty()
    later = HEAD + BODY.replace("alias main-loop loop:1", "alias main-loop loop:2").replace('name="Pumps" pump:1 pump:2', 'name="Pumps" pump:1')
    for document in (DOCUMENT, later):
        out.publish(grammar.read(spark, document))
    return out


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_time_travel(spark, store):
    first = store.load(1, verify=True)
    for name in ("nodes", "edges", "groups", "group_members", "aliases", "changeovers", "changeover_members"):
        want = getattr(grammar.read(spark, DOCUMENT), name)
        assert sorted(map(str, getattr(first, name).collect())) == sorted(map(str, want.collect())), name
    assert (first.header.facility[1], first.header.witness, first.header.generation) == ("dc-1", "hand written", 1)
    assert "generation=1" in plan(first.nodes) and "generation=2" not in plan(first.nodes)
    with pytest.raises(PlantError) as e:
        store.load(7)
    assert e.value.code == "generation_not_retained"


def test_links(spark, store):
    assert [(r.generation, r.parent_generation, r.linked) for r in store.history().orderBy("generation").collect()] == [(1, 0, True), (2, 1, True)]
    other = grammar.read(spark, DOCUMENT.replace("dc-1", "dc-2"))
    with pytest.raises(PlantError) as e:
        store.publish(other)
    assert e.value.code == "generation_mismatch"


def test_differences_read_changed_buckets(spark, store):
    changed = {(r.table_name, r.bucket) for r in store.changed(1, 2).collect()}
    assert {t for t, _ in changed} == {"aliases", "group_members"} and len(changed) == 2
    want = [tuple(r) for r in diffs.diff(store.load(1), store.load(2)).entries.collect()]
    assert [tuple(r) for r in store.diff(1, 2).collect()] == want and len(want) == 2
    assert store.diff(1, 1).isEmpty()


def test_damage_is_found(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "own"), buckets=4)
    t = grammar.read(spark, DOCUMENT)
    store.publish(t)
    store.publish(replace(t, tables=dict(t.tables)))
    renamed = t.nodes.selectExpr("*").withColumnRenamed("display_name", "x").selectExpr("node_id", "kind", "subkind", "pump_role", "medium", "design_supply_mc", "max_supply_mc", "consumer", "'other' display_name", "refs")
    renamed.withColumn("bucket", store._bucket("node_id")).write.mode("overwrite").partitionBy("bucket").parquet(f"{store.path}/nodes/generation=1")
    with pytest.raises(PlantError) as e:
        store.load(1, verify=True)
    assert e.value.code == "integrity_failure"
    store.load(2, verify=True)
    # another first manifest: the second generation's parent is not what it names any more
    lines = spark.read.parquet(f"{store.path}/manifest/generation=1").selectExpr("table_name", "bucket", "n", "digest", "facility", "'someone' producer", "origin", "witness", "parent_generation", "parent_digest").collect()
    spark.createDataFrame(lines, "table_name string, bucket int, n long, digest string, facility string, producer string, origin string, witness string, parent_generation long, parent_digest string").write.mode("overwrite").parquet(f"{store.path}/manifest/generation=1")
    assert [r.linked for r in store.history().orderBy("generation").collect()] == [True, False]


def test_an_unfinished_publication_is_not_seen(spark, tmp_path):
    store = Generations(spark, str(tmp_path / "own"), buckets=4)
    t = grammar.read(spark, DOCUMENT)
    t.nodes.withColumn("bucket", store._bucket("node_id")).write.partitionBy("bucket").parquet(f"{store.path}/nodes/generation=1")
    assert store.head() == 0
    assert store.publish(t) == 1 and store.load(1, verify=True).node_count() == t.node_count()
