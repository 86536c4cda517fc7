"""The pipeline against a plain version of its stages, and that nothing else needs the subpackage."""

import re
import subprocess
import sys
from pathlib import Path

import corpus_pipeline
import pytest

from plantgraph.llm import quality

ROOT = Path(__file__).resolve().parent.parent.parent
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(seed, n):
    import random

    rng = random.Random(seed)
    words = "the river stone house of green cloud and walks under bright garden water light while morning people carry small boats across quiet lake near old market town every summer evening with friends".split()
    return " ".join(rng.choice(words) + rng.choice(["", "ly", "er", "ing", "s"]) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    base = [prose(i, 80) for i in range(30)]
    line = "this very line stands in many documents of the corpus"
    rows = [(i, t + (f"\n{line}" if i < 14 else ""), "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100, base[20], "en", "s0"), (101, base[21].replace("river", "stone", 1), "en", "s1"), (102, "too short", "en", "s1"), (103, None, "en", None), (104, "word " * 80, "en", "s2")]
    leak = " ".join(f"secret{i}" for i in range(12))
    rows.append((105, base[25][:200] + " " + leak + " " + prose(99, 60), "en", "s2"))
    spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), {r[0]: r[1] for r in rows}, line


def test_stages(spark, folder):
    path, texts, line = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns = docs.columns
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, path)
        if i < 4:
            assert docs.columns == columns
        kept.append({r.doc_id: r for r in docs.collect()})
    first = {r.doc_id for r in quality.quality_rules(spark.read.parquet(f"{path}/documents.parquet")).where("kept").collect()}
    assert set(kept[0]) == first and {102, 103, 104}.isdisjoint(first) and set(range(30)) <= first
    assert set(kept[1]) == first
    for d, r in kept[1].items():
        assert r.text == (texts[d] if not 0 < d < 14 else texts[d].replace(f"\n{line}", "")) and r.n_chars == len(r.text)
    assert set(kept[2]) == first - {100, 101}
    assert set(kept[3]) == set(kept[2]) - {105}
    assert set(kept[4]) == set(kept[3])
    assert all(r.size == len(WORD.findall(kept[3][d].text)) and r.taken <= 3 * r.size for d, r in kept[4].items())
    assert sorted(map(str, kept[4].values())) == sorted(map(str, corpus_pipeline.run(spark, path).collect()))


def test_near_duplicates_leave_one_row_of_each_group(spark):
    a, b, c = prose(1, 60), prose(2, 60), prose(3, 60)
    near = a.replace("river", "stone", 1) if "river" in a else a + " more"
    rows = [(5, a), (5, a), (5, near), (5, b), (7, a), (8, near), (9, c), (None, a), (None, a), (10, ""), (10, ""), (11, None)]
    df = spark.createDataFrame([(*r, "en", "s", 1, "kept") for r in rows], "doc_id long, text string, lang string, source string, n_chars int, _text_id string")
    out = corpus_pipeline.near_duplicates(spark, df, "")
    assert out.columns == df.columns
    got = sorted(((r.doc_id or 0, r.text or "") for r in out.collect()))
    group = [x for x in got if x[1] in (a, near) and x[0] == 5]
    assert len(group) == 1 and [x for x in got if x not in group] == sorted([(0, a), (0, a), (5, b), (9, c), (10, ""), (10, ""), (11, "")])
    assert all(r["_text_id"] == "kept" for r in out.collect())


def test_pipeline_on_an_empty_table_and_with_clashing_columns(spark, folder, tmp_path):
    path, _, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{path}/benchmark.parquet").limit(0).write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
    more = docs.selectExpr("*", "'x' AS n_dropped", "'y' AS kept", "1 AS _DROP", "2 AS component_id")
    out = corpus_pipeline.line_templates(spark, corpus_pipeline.quality_rules(spark, more, path), path)
    assert out.columns == more.columns and out.where("n_dropped <> 'x' OR kept <> 'y' OR _DROP <> 1 OR component_id <> 2").isEmpty() and not out.isEmpty()


def test_entry_imports_without_the_subpackage(tmp_path):
    code = f"import sys; sys.path.insert(0, {str(ROOT)!r}); sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') for n in q); print(len(q), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, check=True).stdout
