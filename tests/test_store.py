import os

import pytest
from facility import DOCUMENT

from plantgraph import cli
from plantgraph.errors import PlantError
from plantgraph.sources import grammar
from plantgraph.sources.store import STEPS, Store
from plantgraph.topology import ref

FACILITY = ref("facility", "dc-1", 7)


def draft(spark, n=0):
    return grammar.read(spark, DOCUMENT.replace("class=rack", f'class=rack name="v{n}"'))


class Stop(Exception):
    pass


def test_publish_replay_and_fences(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store.create(spark, path, "store-1", FACILITY, durable=False, retain=2)
    with pytest.raises(PlantError) as e:
        s.head()
    assert e.value.code == "not_initialized"
    first = s.authority()
    r = s.publish(draft(spark), first, "m1")
    assert (r.generation, r.replayed, r.head_after) == (1, False, 1)
    assert s.publish(draft(spark), first, "m1").replayed  # before any fence
    for authority, mutation, n, code in ((first, "m1", 1, "idempotency_conflict"), (first, "m2", 1, "stale_base_generation")):
        with pytest.raises(PlantError) as e:
            s.publish(draft(spark, n), authority, mutation)
        assert e.value.code == code
    for i in (2, 3):
        s.publish(draft(spark, i), s.authority(), f"m{i}")
    assert [x.generation for x in s.history().collect()] == [3, 2]
    assert s.load(2).digest == s.manifest.retained[0][1]
    with pytest.raises(PlantError) as e:
        s.load(1)
    assert e.value.code == "generation_not_retained"
    assert {x.code for x in s.verify().collect()} == {"chain_starts_at_retention_boundary"}
    with pytest.raises(PlantError) as e:
        Store.open(spark, path)
    assert e.value.code == "store_locked"
    old = s.authority()
    s.close()
    with pytest.raises(PlantError) as e:
        s.info()
    assert e.value.code == "store_closed"
    with Store.open(spark, path, durable=False) as s2:
        assert s2.authority().epoch == old.epoch + 1
        with pytest.raises(PlantError) as e:
            s2.publish(draft(spark, 9), old, "m9")
        assert e.value.code == "stale_authority_epoch"
    with Store.open(spark, path, read_only=True) as s3, pytest.raises(PlantError) as e:
        s3.publish(draft(spark, 9), s3.authority(), "m9")
    assert e.value.code == "store_read_only"


@pytest.mark.parametrize("step", ["after_generation_rename", "partial_manifest_write", "before_manifest_write", "after_manifest_write"])
def test_stopping_at_any_step(spark, tmp_path, step):
    path = str(tmp_path / "s")
    s = Store.create(spark, path, "store-1", FACILITY, durable=False)
    s.publish(draft(spark), s.authority(), "m1")

    def hook(name):
        if name == step:
            raise Stop

    s.hook = hook
    with pytest.raises(Stop):
        s.publish(draft(spark, 2), s.authority(), "m2")
    s.close()
    with Store.open(spark, path, durable=False) as again:
        committed = STEPS.index(step) >= STEPS.index("after_manifest_write")
        assert again.manifest.head == 1 + committed
        r = again.publish(draft(spark, 2), again.authority(), "m2")
        assert (r.generation, r.replayed) == (2, committed)
        assert again.verify().where("severity = 'defect'").isEmpty()


def test_recovery(spark, tmp_path):
    path = str(tmp_path / "s")
    s = Store.create(spark, path, "store-1", FACILITY, durable=False)
    for i in (1, 2):
        s.publish(draft(spark, i), s.authority(), f"m{i}")
    s.close()
    assert Store.recover(spark, path, durable=False) == "no_action"
    with open(os.path.join(path, "manifest"), "r+b") as f:
        f.truncate(20)
    assert Store.recover(spark, path, durable=False) == "adopted_previous"
    with Store.open(spark, path, durable=False) as again:
        assert again.manifest.head == 1 and again.head().header.generation == 1
        assert {x.code for x in again.verify().collect()} >= {"quarantined_content", "recovered_state"}
    for bad, code in (("relative", "path_invalid"), ("/a/../b", "path_traversal"), (str(tmp_path / "none"), "store_not_found")):
        with pytest.raises(PlantError) as e:
            Store.open(spark, bad)
        assert e.value.code == code


def test_command_line(spark, tmp_path, capsys):
    good, bad = tmp_path / "a.ctg", tmp_path / "b.ctg"
    good.write_text(DOCUMENT)
    bad.write_text(DOCUMENT + "alias q nobody\n")
    a = str(good)
    for args, code, part in (
        ([], 2, ""), (["nothing"], 2, ""), (["paths", a], 2, ""), (["version"], 0, "plantgraph"), (["posture"], 0, "not_owned  power_state"), (["validate", a], 0, "errors 0, warnings 3"),
        (["validate", str(bad)], 1, "alias_target_missing"), (["sources", a], 0, "node_id=src:w"), (["sources", str(tmp_path / "no")], 2, ""), (["downstream", a, "src:x"], 0, "via_edge=e02"),
        (["export", a], 0, "edge e01 supplies"), (["diff", a, a], 0, "generation 1 -> 2"), (["store", str(tmp_path / "none")], 3, ""),
    ):
        assert cli.main(args, spark) == code, args
        assert part in capsys.readouterr().out
