"""The operators on small tables against brute force, with the odd cases of each."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import pytest

from plantgraph.llm import decontaminate, jaccard, license_scan, line_dedup, lm_score, mixing, quality, repeats, stages, substring_dedup, suffix_dedup, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s)


def texts():
    """Copies, near copies, shared passages, periodic and very long texts, empties and nulls."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "漢字", "A1", "the", "the", "of"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = prose(120), prose(45)
    out = [base, base, base.replace("the", "THE"), base + " tail", prose(60) + "\n" + passage + "  " + prose(30), passage + "\t" + prose(70), prose(5) + " " + passage]
    out += ["ab " * 60, "x" * 400, "one two", "one two three four", "ONE two three four", "", " \n\t ", None, None, prose(3000), "é" * 150]
    near = base.split()
    for i in range(12):
        own = list(near)
        own[i * 7] = "edited"
        own[i * 5 + 40] = "again"
        out.append(" ".join(own))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i * 3, t, "en", f"s{i % 4}" if i % 5 else None, "clash") for i, t in enumerate(texts())]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, t string").repartition(3)


@pytest.fixture(scope="module")
def table(docs):
    return dict(sorted((r.doc_id, r.text or "") for r in docs.collect()))


def test_jaccard(docs, table, spark):
    for k, percent in ((4, 85), (5, 80)):
        sets = {}
        for d, t in table.items():
            w = WORD.findall(lower(t))
            sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}
        label = {d: d for d in sets}
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                    x, y = sorted((label[a], label[b]))
                    label = {d: x if v == y else v for d, v in label.items()}
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(docs, k, percent).collect()}
        assert got == {d: (len(s), label[d]) for d, s in sets.items()}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.jaccard_join(empty).count() == 0


def test_jaccard_is_complete_for_small_and_uneven_sets(spark):
    rng = random.Random(5)
    rows = []
    for g in range(40):
        n = rng.choice([6, 7, 8, 9, 11, 15, 22, 40])
        own = [f"g{g}w{i}" for i in range(n + 3)]
        rows += [" ".join(own), " ".join([*own[:-1], "other"]), " ".join(own[1:]), " ".join(own[: n // 2])]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    sets = {d: {tuple(t.split()[i : i + 4]) for i in range(len(t.split()) - 3)} or {tuple(t.split())} for d, t in enumerate(rows)}
    label = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {d: x if v == y else v for d, v in label.items()}
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_join(df, 4, 85).collect()} == label


def test_jaccard_with_repeated_rows_low_limits_and_large_tiles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 4)
    rng = random.Random(8)
    base = [f"v{i}" for i in range(100)]
    rows = [(1, " ".join(base))] * 30 + [(2, " ".join([*base[:-1], "near"]))] * 30 + [(1, "other text under the same id as many")]
    rows += [(10 + i, " ".join(base[: rng.randint(48, 100)] + [f"x{i}y{j}" for j in range(rng.randint(0, 90))])) for i in range(40)]
    rows += [(None, " ".join(base)), (90, ""), (91, None)]
    sets = {t: frozenset(t.split()) for _, t in rows if t}
    label = {t: t for t in sets}
    for a in sets:
        for b in sets:
            if a < b and 2 * len(sets[a] & sets[b]) >= len(sets[a] | sets[b]):
                x, y = sorted((label[a], label[b]))
                label = {d: x if v == y else v for d, v in label.items()}
    least = {}
    for d, t in rows:
        if t and d is not None:
            least[label[t]] = min(d, least.get(label[t], d))
    want = Counter((d, len(sets[t]) if t else 0, least[label[t]] if t else d) for d, t in rows)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(2), 1, 50)
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == want


def removed(units, width, table):
    seen, out = set(), {}
    for d in table:
        u = units(table[d])
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            key = tuple(u[i : i + width])
            if key in seen:
                gone[i : i + width] = [True] * width
            seen.add(key)
        out[d] = u, gone
    return out


@pytest.mark.parametrize("width", [20, 7])
def test_substring_dedup(docs, table, width):
    want = {}
    for d, (w, gone) in removed(WORD.findall, width, table).items():
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want[d] = len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept_text) for r in substring_dedup.substring_dedup(docs, width).collect()} == want


@pytest.mark.parametrize("width", [100, 33])
def test_suffix_dedup(docs, table, width):
    want = {}
    for d, (b, gone) in removed(lambda t: t.encode(), width, table).items():
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        want[d] = len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(docs, width).collect()} == want


def test_hot_anchors_are_split(docs, table, monkeypatch):
    from plantgraph.llm import repeats

    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 300)
    want = {d: sum(gone) for d, (_, gone) in removed(WORD.findall, 20, table).items()}
    assert {r.doc_id: r.n_removed for r in substring_dedup.substring_dedup(docs, 20).collect()} == want
    want = {d: sum(gone) for d, (_, gone) in removed(lambda t: t.encode(), 100, table).items()}
    assert {r.doc_id: r.n_removed for r in suffix_dedup.suffix_dedup(docs, 100).collect()} == want


def test_shards_are_merged_by_search(monkeypatch):
    """One anchor over many shards, against a plain set of strings."""
    rng = random.Random(13)
    for size, width in ((40, 9), (200, 16), (1000, 5)):
        monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
        block = []
        for a in range(3):
            for d in range(30):
                body = bytes(rng.choice(b"ab") for _ in range(rng.randint(width, 40)))
                block.append((a, d, 0, 100 * d, len(body) - width + 1, body))
        seen, want = set(), set()
        for a, d, _, s, n, body in block:
            for i in range(n):
                key = a, body[i : i + width]
                if key in seen:
                    want.add((a, d, s + i))
                seen.add(key)
        got = set()
        for a in range(3):  # anchors of a task do not share strings
            got |= {(a, d, s + i) for d, _, s, n in suffix_dedup.suffix_array(width)([p for p in block if p[0] == a]) for i in range(n)}
        assert got == want


def test_removers_with_repeated_ids_and_empty_tables(spark):
    long = " ".join(f"u{i}" for i in range(40))
    rows = [(1, long), (1, long), (2, long), (None, long), (3, "short")]
    got = sorted((r.doc_id or 0, r.n_removed) for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 20).collect())
    assert got == [(0, 0), (1, 0), (1, 0), (2, 40), (3, 0)]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert substring_dedup.substring_dedup(empty).count() == suffix_dedup.suffix_dedup(empty).count() == 0


def test_decontamination(docs, table, spark, monkeypatch):
    passage = " ".join(WORD.findall(table[18])[5:25])
    items = [(1, passage.upper().replace(" ", ", ")), (2, "one two"), (3, ""), (4, None), (5, "no such words in any text at all or anywhere"), (10, passage + " more")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = ALNUM.findall(lower(t or ""))
        for a in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[a : a + 10]), set()).add(str(i))
    want = {}
    for d, t in table.items():
        w = ALNUM.findall(lower(t))
        gone, found = [False] * len(w), set()
        for key, ids in windows.items():
            for a in range(len(w) - len(key) + 1):
                if tuple(w[a : a + len(key)]) == key:
                    gone[a : a + len(key)] = [True] * len(key)
                    found |= ids
        want[d] = len(w), sum(gone), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), any(gone)
    for block in (decontaminate.BLOCK_BYTES, 100):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        got = decontaminate.digest(decontaminate.matches(docs, bench, 10))
        assert {r.doc_id: tuple(r)[1:] for r in got.collect()} == want
        clean = decontaminate.decontaminate(docs, bench, 10)
        assert clean.columns == docs.columns and {r.doc_id for r in clean.collect()} == {d for d, x in want.items() if not x[4]}
    assert decontaminate.decontaminate(docs, bench.limit(0), 10).count() == docs.count()


def test_quality(docs, table):
    got = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for d, t in table.items():
        w, seen, again = WORD.findall(t), set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        grams = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        gone = {j for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), again, len(gone))
        assert r.base_failed == (len(w) < 10 or 100 * len(gone) > 20 * len(w)) and not (r.base_failed and r.kept)
    model, is_byte = quality._model(quality.VOCABULARY)
    for d in (12, 15, 48):
        ids = [x for w in WORD.findall(table[d]) for x in model.encode(w)]
        c = Counter(ids)
        entropy = -sum(n / len(ids) * math.log2(n / len(ids)) for n in c.values())
        assert got[d].n_tokens == len(ids) and got[d].entropy == pytest.approx(entropy) and got[d].byte_share == pytest.approx(sum(is_byte[x] for x in ids) / len(ids))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in got.items() if r.kept}


def test_mixing(docs, table):
    got = mixing.mix(docs).collect()
    size = {d: len(WORD.findall(t)) for d, t in table.items()}
    assert {r.doc_id: r.size for r in got} == size
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()), key=str)
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken % max(r.size, 1) == 0 and r.taken <= 3 * r.size
    assert sum(rows[0].target for rows in by.values()) == pytest.approx(sum(size.values()))
    for rows in by.values():
        assert rows[0].source_size == sum(r.size for r in rows)
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= max(r.size for r in rows)


def test_targets_and_flow():
    t = mixing.targets({"a": 100, "b": 10, None: 90}, (5, 2, 1), 3)
    assert t["b"] == 30 and t["a"] == pytest.approx(170 * 5 / 6) and t[None] == pytest.approx(170 / 6)
    assert mixing.targets({}, (1,), 3) == {} and mixing.targets({"a": 0}, (1,), 3) == {"a": 0.0}
    taken = mixing.route({("a",): 10, ("a", "b"): 10, ("b",): 10, ("c",): 5}, {"a": 20, "b": 25, "c": 99}, 3)
    assert taken[("c",)] == 15 and taken[("a",)] + taken[("a", "b")] + taken[("b",)] == 45
    assert all(10 <= taken[p] <= 20 for p in (("a",), ("a", "b"), ("b",)))  # repetitions are spread


def test_quality_verdict(spark):
    """The verdict from its definition, on texts of all lengths, scripts and kinds."""
    rng = random.Random(11)
    real = "the people of this old town walked along the river every morning before work and talked about their children".split()
    rows = []
    for i in range(60):
        n = rng.choice([11, 12, 20, 40, 150, 600])
        kind = i % 6
        pick = {0: lambda: rng.choice(real), 1: lambda: "".join(rng.choice("qxzjkvw#*") for _ in range(6)), 2: lambda: "漢字仮名"[rng.randrange(4)] * 3, 3: lambda: "привет мир это тест".split()[rng.randrange(4)], 4: lambda: rng.choice("ab"), 5: lambda: "ᚠᚢᚦ"[rng.randrange(3)]}[kind]
        rows.append((i, " ".join(pick() for _ in range(n)), ["en", "de", None, "xx"][i % 4]))
    model, is_byte = quality._model(quality.VOCABULARY)
    got = {r.doc_id: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    kept = 0
    for d, t, lang in rows:
        ids = [x for w in t.split() for x in model.encode(w)]
        n, r = max(len(ids), 2), got[d]
        c = Counter(ids)
        entropy = -sum(k / len(ids) * math.log2(k / len(ids)) for k in c.values())
        chars, share = sum(map(len, t.split())) / len(ids), sum(bool(is_byte[x]) for x in ids) / len(ids)
        band = lang if lang in quality.BANDS else ["Latin", "Latin", "CJK", "Cyrillic", "Latin", "Other"][d % 6]
        assert r.band == band
        least, most, fallback, low = quality.BANDS[band]
        slack = 1 / math.sqrt(n)
        want = least - 3 * slack <= chars <= most + 3 * slack and share <= fallback + slack and entropy >= low * min(1, math.log2(n) / 6) - 1e-12
        assert r.kept == (want and not r.base_failed), (d, t[:50])
        kept += r.kept
    assert 5 < kept < 55


def test_quality_bands_from_labels_and_an_empty_table(spark):
    rows = [(i, " ".join(["aaaa"] * 5 + [f"bb{i}x{j}" for j in range(40)]), "zz", 1) for i in range(120)] + [(200, "x", "yy", 1), (201, None, None, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    bands = quality.fit_bands(df, df)
    assert set(bands) == {*quality.BANDS, "zz"} and bands["en"] == quality.BANDS["en"]
    got = quality.quality_rules(df, bands=bands).where("doc_id < 200").collect()
    assert sum(not r.kept for r in got if not r.base_failed) <= 3
    assert quality.quality_rules(df.limit(0)).collect() == [] and quality.keep_good(df.limit(0)).columns == df.columns


def cost_of(taken, patterns):
    """Words of the k-th repetition of a pattern cost k * k."""
    return sum(k * k * max(0, min(t - k * patterns[p], patterns[p])) for p, t in taken.items() for k in range(3))


def best_by_trial(patterns, quotas, cap):
    """(most words, least cost) over all ways to deal whole words of patterns to sources."""
    states = {tuple(sorted(quotas.items())): (0, 0)}  # quotas left -> best (minus words, cost)
    for p, n in patterns.items():
        after = {}
        for left, (words, cost) in states.items():
            room = dict(left)
            for flow in itertools.product(*(range(min(room[x], cap * n) + 1) for x in p)):
                if sum(flow) <= cap * n:
                    key = tuple(sorted((room | {x: room[x] - f for x, f in zip(p, flow, strict=True)}).items()))
                    new = (words - sum(flow), cost + cost_of({p: sum(flow)}, patterns))
                    after[key] = min(after.get(key, new), new)
        states = after
    return min(states.values())


def test_flow_is_optimal():
    rng = random.Random(9)
    for _ in range(25):
        sources = ["a", "b", "c"][: rng.randint(1, 3)]
        patterns = {}
        for _ in range(rng.randint(1, 4)):
            p = tuple(sorted(rng.sample(sources, rng.randint(1, min(2, len(sources))))))
            patterns[p] = rng.randint(0, 3)
        quotas = {x: rng.randint(0, 6) for x in sources}
        taken = mixing.route(patterns, quotas, 3)
        assert set(taken) == set(patterns) and all(0 <= t <= 3 * patterns[p] for p, t in taken.items())
        assert (-sum(taken.values()), cost_of(taken, patterns)) == best_by_trial(patterns, quotas, 3)


def test_mixing_of_overlapping_sources_ties_and_an_empty_table(spark):
    rows = [(i, "w " * 10, ["a"] if i < 20 else ["a", "b"] if i < 40 else ["b"], "old") for i in range(60)] + [(i, "w " * 10, ["a"], "old") for i in (0, 0)]
    df = spark.createDataFrame(rows + [(99, None, None, "old")], "doc_id long, text string, source array<string>, taken string")
    got = mixing.mix(df, weights=(1, 3), cap=3).collect()
    assert len(got) == 63 and {r.taken for r in got if r.doc_id == 99} == {0}
    of = {"a": 420, "b": 400}
    goal = mixing.targets({**of, None: 0}, (1, 3), 3)
    assert abs(sum(r.taken for r in got) - min(620 * 3, sum(goal.values()))) <= 30  # nothing is lost but parts of documents
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix(df.repartition(5), weights=(1, 3), cap=3).collect()))
    assert mixing.mix(df.limit(0)).collect() == []


def test_lm(docs, table):
    got = {r.doc_id: r for r in lm_score.lm_score(docs, folds=3, held_out=0).collect()}
    held = {d: zlib.crc32(str(d).encode()) % 3 == 0 for d in table}
    c = Counter()
    for d, t in table.items():
        if not held[d]:
            c.update([*WORD.findall(lower(t)), None])
    n, v = sum(c.values()), len(c)
    for d, t in table.items():
        own = [*WORD.findall(lower(t)), None]
        base = sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(own), sum(c[x] > 0 for x in own), n)
        assert r.base_score == pytest.approx(base)
        assert r.score <= 0 and math.isfinite(r.score)
    learned = [d for d, t in table.items() if t and not held[d]]
    assert sum(got[d].score for d in learned) > sum(got[d].base_score for d in learned)


def automaton_of(texts, train, unknown="nowhere"):
    """The whole automaton of a few texts, and the numbers of their words; answers come without Spark."""
    import numpy as np
    import pyarrow as pa

    column = pa.array([*texts, unknown])
    (part,) = lm_score.tx.slices(column)
    tokens, sizes = lm_score._tokens(part)
    heads, x = np.unique(tokens, return_inverse=True)
    b = lm_score.Block({"ids": [*range(len(column))], "train": np.array([*train, False]).tobytes(), "sizes": lm_score._pack(sizes.astype(np.int64)), "heads": lm_score._pack(np.diff(heads, prepend=np.uint64(0))), "tokens": lm_score._pack(x)})

    def answers(asks):
        return pa.concat_tables([lm_score._answer(lm_score._asked(lm_score._ask(kind, 0, 1, keys, values))) for kind, keys, values in asks])

    b.meet(answers(b.asks()))
    b.meet3(answers(b.asks3()))
    return b, lm_score.Automaton(b, int(b.c1.sum()), int((b.c1 > 0).sum()))


def test_lm_probabilities_sum_to_one(monkeypatch):
    import numpy as np

    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefg") for _ in range(rng.randint(0, 30))) for _ in range(12)]
    b, a = automaton_of(texts, [True] * 10 + [False] * 2)
    words = np.arange(len(b.heads))
    end = a.after[b.x[-1]]
    last = {a.start + 1 + i for i, t in enumerate(b.x[b.first2].tolist()) if a.after[t] == end}  # pairs that end a text
    states = {a.start, 0, *a.goto.tolist()} - last
    states |= set(a.fail[list(states)].tolist()) - {end}
    assert len(states) > 20
    for state in states:
        _, weight = a.step(np.full(len(words), state), words)
        assert (10**weight).sum() == pytest.approx(1.0)  # one word is unknown to the training texts
    whole = a.walk(b.x, b.first)
    for i in range(len(texts)):  # the same, one token after the other
        state, total = np.array([a.start]), 0.0
        for t in b.x[b.first[i] : b.first[i + 1]]:
            state, weight = a.step(state, np.array([t]))
            total += weight[0]
        assert whole[i] == pytest.approx(total)
    monkeypatch.setattr(lm_score, "PIECE", 5)
    assert np.allclose(a.walk(b.x, b.first), whole)


def test_lm_score_against_the_formulas(docs, table, spark, monkeypatch):
    monkeypatch.setattr(lm_score, "BLOCK_BYTES", 20_000)
    filler = [(10_000 + i, " ".join(f"f{i}x{j}" for j in range(300)) if i % 2 else None) for i in range(20)]
    rare = [(20_000 + i, "zig zag zog and more") for i in range(8)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(filler + rare, "doc_id long, text string"))
    rows = {**table, **{d: t or "" for d, t in filler + rare}}
    got = {r.doc_id: r for r in lm_score.lm_score(df, folds=3, held_out=0).collect()}
    own = {d: [*WORD.findall(lower(t)), None] for d, t in rows.items()}
    c = Counter()
    for d, x in own.items():
        if zlib.crc32(str(d).encode()) % 3:
            padded = [0, *x]
            for i in range(1, len(padded)):
                c.update([(padded[i],), tuple(padded[i - 1 : i + 1])])
                if i > 1:
                    c.update([tuple(padded[i - 2 : i + 1])])
    uni = {g: k for g, k in c.items() if len(g) == 1}
    n, v = sum(uni.values()), len(uni)

    def p(history, w):
        if not history:
            return (c[(w,)] + 0.1) / (n + 0.1 * (v + 1))
        seen, prior = uni[(None,)] if history == (0,) else c[history], lm_score.PRIOR[len(history) + 1]
        return (c[(*history, w)] + prior * p(history[1:], w)) / (seen + prior)

    assert c[("zig", "zag", "zog")] >= 2
    for d, x in own.items():
        padded = [0, *x]
        want = sum(math.log10(p(tuple(padded[max(0, i - 2) : i]), padded[i])) for i in range(1, len(padded)))
        assert got[d].score == pytest.approx(want, rel=1e-9), d


def test_lm_requests_in_levels_give_the_same_and_grow_with_the_text(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{int(rng.paretovariate(0.6)) % 5000}" for _ in range(60))) for i in range(320)]
    made = {}

    def keep(self, df, name, keep=lm_score.st.Stages.keep):
        out = keep(self, df, name)
        made[name] = out.count()
        return out

    def run(many, blocks, fan):
        made.clear()
        monkeypatch.setattr(lm_score, "FAN", fan)
        df = spark.createDataFrame(rows[:many], "doc_id long, text string").repartition(blocks)
        got = sorted(map(tuple, lm_score.lm_score(df, folds=3, held_out=0).collect()))
        return got, sum(n for name, n in made.items() if name not in ("blocks", "scores")), dict(made)

    monkeypatch.setattr(lm_score.st.Stages, "keep", keep)
    monkeypatch.setattr(lm_score, "SHARD_BYTES", 1500)
    want, square, _ = run(320, 32, 1024)
    got, twice, names = run(320, 32, 4)
    assert {"counts-asked-1", "counts-asked-2", "trigrams-asked-1"} <= set(names) and names["blocks"] == 32
    for a, b in zip(got, want, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-12)
    assert names["counts"] < 0.2 * square
    for many, blocks in ((320, 32), (160, 16)):  # rows are bounded by the blocks, whatever the number of shards
        names = names if many == 320 else run(many, blocks, 4)[2]
        assert names["blocks"] == blocks
        for name, n in names.items():
            if name not in ("blocks", "scores"):
                assert n <= blocks * 4 * (2 if name.startswith("counts") else 1), name


@pytest.mark.parametrize(("shards", "tasks", "fan"), [(0, 1, 4), (3, 2, 4), (5, 2, 4), (64, 2, 4), (65, 2, 4), (10**7, 200, 1024), (10, 5000, 1024)])
def test_lm_levels_hold_enough_shards(shards, tasks, fan, monkeypatch):
    monkeypatch.setattr(lm_score, "FAN", fan)
    own, levels = lm_score._fan(shards, tasks)
    assert 1 <= own <= fan and own**levels >= max(shards, min(tasks, fan), 1) and (levels == 1 or fan ** (levels - 1) < shards)


def test_lm_with_repeated_and_missing_ids_and_an_empty_table(spark):
    rows = [(1, "a b c"), (1, "a b c"), (None, "a b c"), (2, None), (3, "")]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double")
    got = sorted(lm_score.lm_score(df, folds=3, held_out=0).collect(), key=str)
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 4), (1, 4), (1, 4), (2, 1), (3, 1)]
    assert [r.held_out for r in got if r.doc_id is None] == [True] and len({r.score for r in got if r.n_tokens == 4}) == 1
    assert lm_score.lm_score(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(2)
    clean = ["tree", "stone", "river", "house", "cloud", "garbage", "truck", "walks", "green"]
    rows = []
    for i in range(400):
        w = [rng.choice(clean) for _ in range(30)]
        toxic = i % 5 == 0
        if toxic:
            w[i % 30] = ["vilething", "V1LETHING", "vilеthing", "gruntscum"][i % 4]
        elif i % 3 == 0:
            w[3:5] = ["gruntscum", "collector"]
        rows.append((i, " ".join(w), int(toxic)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df, df.where("doc_id < 300"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    late = [(got[i], x) for i, _, x in rows if i >= 300]
    assert sum((s >= 0.7) == bool(x) for s, x in late) / len(late) > 0.9
    assert 0 <= model.score(None) < 0.5 and model.score("") == model.score(None)
    assert toxicity.fold("1D10T  Vilе-thing!") == " idiot vile thing "
    assert 0 <= toxicity.fit(df, df.limit(0)).score("vilething") < 0.1


def test_line_dedup(spark):
    rows = [(i, f"shared line {i} here\n{'abcdefghijkl'[i % 12]}{'xyz'[i % 3]} has a text of its own\n\nshared  line 7 here", "k") for i in range(12)]
    rows += [(100, "alone", "k"), (101, None, "k"), (102, "", "k"), (None, "shared line 3 here", "k"), (103, "shared line 9 here", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = {r.doc_id: r for r in line_dedup.line_dedup(df, min_texts=10).collect()}
    assert got[0].n_dropped == 0 and got[0].text == rows[0][1]  # the first document keeps the template
    assert got[5].text == rows[5][1].split("\n")[1] + "\n" and (got[5].n_lines, got[5].n_dropped) == (4, 2)
    assert got[101].text is None and got[102].text == "" and got[None].n_dropped == 0 and got[100].n_dropped == 0
    assert 103 not in {r.doc_id for r in line_dedup.line_dedup(df, min_texts=10, drop_empty=True).collect()}
    copies = spark.createDataFrame([(i, "the very same\ntext") for i in range(20)], "doc_id long, text string")
    assert line_dedup.line_dedup(copies, min_texts=2).agg({"n_dropped": "sum"}).first()[0] == 0


def by_sql(rows):
    import duckdb
    import pyarrow as pa

    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": pa.array([r[1] for r in rows], pa.string())}))
    return sorted(con.sql(line_dedup.ORACLE).fetchall())


def test_line_dedup_generalises_words(spark):
    rng = random.Random(6)
    names, places = ["Alice", "Bob", "Carol", "Dave", "Eve", "Mallory"], ["News", "Sports", "Arts", "Science"]
    rows = []
    for i in range(60):
        own = " ".join(rng.choice("abcdefghijklmnop") * 3 for _ in range(rng.randint(4, 9)))
        lines = [own, f"Posted by {rng.choice(names)} in {rng.choice(places)}", f"all of it differs {own}", f"seen on {i} pages"]
        rows.append((i, "\n".join(rng.sample(lines, rng.randint(1, 4)))))
    rows += [(100, rows[0][1]), (101, None), (102, ""), (103, "  \n\t\nPosted  by Zoe\tin News"), (104, "Posted by Bob in"), (105, "one two\n" * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = line_dedup.line_dedup(df, min_texts=10).collect()
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, None if r.text is None else hashlib.sha256(r.text.encode()).hexdigest()) for r in out)
    assert got == by_sql(rows)
    assert sum("Posted by" in (r.text or "") for r in out) <= 3  # the first, the one cut short, and no other


def test_line_dedup_with_clashing_columns_repeated_rows_and_an_empty_table(spark):
    rows = [(i, "an old line of boilerplate text\nown " + "abcdefghijkl"[i], "kept", i, "too") for i in range(12)] + [(3, "an old line of boilerplate text\nown d", "again", 3, "too")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string, _D long, _DROP string")
    out = line_dedup.line_dedup(df, min_texts=10)
    assert out.columns == [*df.columns, "n_lines", "n_dropped_"]
    got = out.collect()
    assert len(got) == 13 and [r.n_dropped_ for r in sorted(got, key=lambda r: r.doc_id)] == [0] + [1] * 12
    assert all(r.n_dropped in ("kept", "again") and r._D == r.doc_id and r._DROP == "too" for r in got)
    assert line_dedup.line_dedup(df.limit(0)).collect() == []


def test_license_scan(spark):
    rows = [(1, "Prose.\nLicensed under the Apache License, Version 2.0.\nMore."), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "Licensed under CC BY-NC 4.0.\nAll rights reserved."), (4, "A licence is a thing to have, said the mitten."), (5, None), (6, ""), (7, "This work is licensed under the GNU General Public License, version 2.")]
    got = license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.license) for r in got} == {(1, "Apache-2.0"), (2, "GPL-3.0"), (3, "CC-BY-NC-4.0"), (3, "all-rights-reserved"), (7, "GPL-2.0")}


def test_license_scan_confirms_every_template():
    def found(text):
        return {r["license"] for r in license_scan.Scanner(license_scan.TEMPLATES, 0.1).scan(text)}

    assert "all-rights-reserved" in found("Copyright 2020 Example Corp. All rights reserved. Licensed under the Apache License, Version 2.0.")
    assert found("All rights reserved. This work is licensed under the GNU General Public License, version 3.") == {"all-rights-reserved", "GPL-3.0"}
    assert found("Licensed under CC BY-NC 4.0. All rights reserved.") == {"CC-BY-NC-4.0", "all-rights-reserved"}
    filler = " ".join(f"word{i % 700} licence mit" for i in range(2000))
    for name, notice in license_scan.TEMPLATES.items():
        assert name in found(f"{filler} {notice} {filler}")
    assert [r["line"] for r in license_scan.Scanner(license_scan.TEMPLATES, 0.1).scan("All rights reserved.\n" * 3)] == [0, 1, 2]


def test_license_scan_against_every_alignment():
    """Edited notices in prose: found where some stretch of words is within the limit, else not."""
    rng = random.Random(12)
    templates = {k: license_scan.TEMPLATES[k] for k in ("MIT-text", "BSD-text", "GPL-header", "Apache-2.0-header", "MIT")}
    scanner = license_scan.Scanner(templates, 0.1)
    for _ in range(60):
        name = rng.choice(list(templates))
        own = templates[name].split()
        for _ in range(rng.randint(0, 6)):  # words changed, dropped and put in
            i = rng.randrange(len(own))
            own[i : i + 1] = rng.choice([["changed"], [], [own[i], "extra"]])
        text = " ".join([*(rng.choice(["of", "software", "the", "under"]) for _ in range(30)), *own, *(rng.choice(["and", "to", "license"]) for _ in range(30))])
        got = {(r["license"], r["lacking"] + r["foreign"]) for r in scanner.scan(text)}
        words = license_scan._words(text)[0]
        for k, t in templates.items():
            size = license_scan._words(t)[0]
            best = license_scan._align(size, words)
            if best and best[0] + best[1] <= int(0.1 * len(size)):
                assert (k, best[0] + best[1]) in got
            else:
                assert k not in {x for x, _ in got}


def test_license_scan_compression_names_the_winner(monkeypatch):
    """A header holds a shorter notice: compression makes it the block's licence, and decides alone."""
    header, lone = license_scan.TEMPLATES["Apache-2.0-header"], license_scan.TEMPLATES["Apache-2.0"]
    text = f"Prose before.\n{header}\nMore prose.\n{lone}\nAll rights reserved."
    mains = lambda: [(r["license"], r["line"], r["main"]) for r in license_scan.Scanner(license_scan.TEMPLATES, 0.1).scan(text)]
    got = mains()
    assert sorted(got) == [("Apache-2.0", 1, False), ("Apache-2.0", 3, True), ("Apache-2.0-header", 1, True), ("all-rights-reserved", 4, True)]
    monkeypatch.setattr(license_scan.Scanner, "ranked", lambda self, raw: [0.0] * len(self.names))
    assert sorted(mains()) == [("Apache-2.0", 1, True), ("Apache-2.0", 3, True), ("Apache-2.0-header", 1, False), ("all-rights-reserved", 4, True)]


def test_license_scan_with_odd_rows(spark):
    notice = "Released under the MIT License."
    df = spark.createDataFrame([(1, notice, "x"), (1, notice, "x"), (None, notice, "x"), (2, "", "x"), (3, None, "x"), (4, ("word " * 40_000) + notice, "x")], "doc_id long, text string, license string")
    got = license_scan.license_scan(df).collect()
    assert sorted(r.doc_id or 0 for r in got) == [0, 1, 1, 4] and {r.license for r in got} == {"MIT"}
    assert license_scan.license_scan(df.limit(0)).collect() == []


def test_license_scan_of_wrapped_notices():
    import textwrap

    scanner = license_scan.Scanner(license_scan.TEMPLATES, 0.1)
    for name, notice in license_scan.TEMPLATES.items():
        for width, mark in ((70, ""), (40, " * "), (20, "# ")):
            lines = textwrap.wrap(notice, width, break_on_hyphens=False, break_long_words=False)
            text = "\n".join(["prose before", *(mark + x for x in lines), "", "prose after"])
            assert (name, 1) in {(r["license"], r["line"]) for r in scanner.scan(text)}
    header = license_scan.TEMPLATES["Apache-2.0-header"].replace(" http", "\n\n    http")
    assert "Apache-2.0-header" in {r["license"] for r in scanner.scan("\n".join(["All rights reserved."] * 60 + [header]))}
    edited = license_scan.TEMPLATES["MIT-text"].replace("free of charge", "at no charge")
    assert [(r["license"], r["lacking"], r["foreign"]) for r in scanner.scan(edited)] == [("MIT-text", 2, 2)]


def test_chunks_and_slices_change_nothing(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from plantgraph.llm import repeats, text

    rng = random.Random(21)
    words = [f"w{i}é" for i in range(500)]
    column = pa.array([" ".join(rng.choice(words) for _ in range(n)) for n in (3, 9000, 0, 40, 20_000)])
    (whole,) = text.slices(column)
    want = text.Words(whole).hashes(), repeats._byte_grams(whole.data, 16), repeats.stretches(repeats.Units(whole, True, 8), 20, 8)
    monkeypatch.setattr(text, "CHUNK_BYTES", 700)
    assert np.array_equal(text.Words(whole).hashes(), want[0]) and np.array_equal(repeats._byte_grams(whole.data, 16), want[1])
    assert all(np.array_equal(a, b) for a, b in zip(repeats.stretches(repeats.Units(whole, True, 8), 20, 8), want[2], strict=True))
    parts = list(text.slices(column, 1000))
    assert [len(s) for s in parts] == [1, 1, 2, 1] and [s.first for s in parts] == [0, 1, 2, 4]
    assert np.array_equal(np.concatenate([text.Words(s).hashes() for s in parts]), want[0])


def test_a_text_longer_than_a_slice(spark):
    rng = random.Random(22)
    long = " ".join(f"x{rng.randrange(10**9)}" for _ in range(450_000))
    part = " ".join(long.split()[300_000:300_040])
    rows = [(1, long), (2, f"before {part} after"), (3, long[:200])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 4 << 20
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df, 20).collect()}
    assert got == {1: (450_000, 0), 2: (42, 40), 3: (len(long[:200].split()), 0 if len(long[:200].split()) - 1 < 20 else len(long[:200].split()) - 1)}
    assert {r.doc_id: r.n_words for r in quality.quality_rules(df, lang_col=None).collect()} == {d: n for d, (n, _) in got.items()}


def test_phrases_that_many_texts_share_make_no_passages(spark, monkeypatch):
    """A phrase shorter than half a window is no reason to write any run down, however often it stands."""
    rng = random.Random(7)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    rows = [(i, noise(200) + " the very same phrase of words " + noise(200)) for i in range(60)]
    written = {}
    keep = stages.Stages.keep

    def spy(self, df, name):
        out = keep(self, df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(stages.Stages, "keep", spy)
    monkeypatch.setattr(repeats, "HOT", 20)
    out = suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), 100).collect()
    assert {r.n_removed for r in out} == {0} and len(out) == 60
    assert written["found"] == 0
