"""Conversation repair, ranked search and SimHash on small tables against brute force, with odd input."""

import functools
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from plantgraph.llm import conversations as cv
from plantgraph.llm import queries, simhash
from plantgraph.llm import ranked_search as rs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def lower(s):
    return re.sub("[A-Z]", lambda m: m[0].lower(), s or "")


# -- conversations -------------------------------------------------------------------------------
def cheapest(rows):
    """(cost, letters, repaired rows) over all edits of (role, text, fault) rows."""

    @functools.cache
    def go(i, role, made):
        """The best from row i on, after a row of this role; made: rows inserted here."""
        out = [(0, "", ())] if i == len(rows) and role in "a" else []
        due = "a" if role == "u" else "u"
        name = {"u": "user", "a": "assistant"}[due]
        if made < 3:
            c, s, r = go(i, due, made + 1)
            out.append((c + 3, "I" + s, ((name, ""), *r)))
        if i < len(rows):
            own, text, fault = rows[i]
            c, s, r = go(i + 1, role, 0)
            out.append((c + 4, "D" + s, r))
            if fault in ("", "truncated"):
                more = 3 * (fault == "truncated")
                if own[:1] == due or (own[:1] == "s" and role == ""):
                    c, s, r = go(i + 1, own[:1], 0)
                    out.append((c + more, "K" + s, ((own, text), *r)))
                c, s, r = go(i + 1, due, 0)
                out.append((c + 3 + more, "R" + s, ((name, text), *r)))
        return min(out, key=lambda x: x[:2]) if out else (10**9, "", ())

    return go(0, "", 0)


def repaired(rows):
    """The whole answer for a conversation's (turn, role, text) rows in order."""
    seen, named = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        named.append((role, text, fault))
    turns = {t for t, *_ in rows if t is not None}
    count = Counter(f for *_, f in named)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(named, named[1:], strict=False))
    cost, letters, out = cheapest(tuple(named)) if named else (0, "", ())
    text = "\n".join(f"{r}:{t}" for r, t in out)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, letters, hashlib.sha256(text.encode()).hexdigest())


def test_automaton_finds_the_cheapest_edits():
    rng, automaton = random.Random(1), cv.Automaton()
    names = ["", "blank", "duplicate", "truncated"]
    for _ in range(800):
        rows = [(rng.randrange(4), rng.randrange(4)) for _ in range(rng.randrange(8))]
        cost, letters, _ = cheapest(tuple(("suat"[i], str(n), names[f]) for n, (i, f) in enumerate(rows)))
        assert automaton.repair(bytearray(4 * i + f for i, f in rows)) == (cost, letters)
    assert len(automaton.vectors) < 100  # states are met again: the table stays small
    cost, letters = automaton.repair(bytearray([4 * 1, 4 * 2] * 50_000 + [4 * 1]))
    assert (cost, len(letters)) == (3, 100_002) and len(automaton.vectors) < 100


def test_conversations(spark):
    rng = random.Random(4)
    rows = []
    for conv in range(60):
        n = rng.randrange(1, 8)
        for turn in rng.sample(range(10), n):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]), rng.choice(["Yes.", "No!", "cut", " ", "Ünï?", "a. ", "x\n", f"t{turn}."]), "clash"))
    rows += [(None, 3, "user", "hi.", "c"), (None, None, "assistant", "yo.", "c"), (99, None, "user", "a.", "c"), (99, None, "user", "a.", "c"), (98, 1, None, None, "c"), (97, 1, "user", "w " * 60_000 + ".", "c"), (97, 2, "assistant", "ok.", "c")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, h string").repartition(3)
    want = defaultdict(list)
    for conv, turn, role, text, _ in rows:
        want[conv].append((turn, role or " ", text or " "))
    got = {r[0]: tuple(r)[1:] for r in cv.structure_repair(df).collect()}
    assert got == {c: repaired(sorted(own, key=lambda x: (x[0] is not None, x[0] or 0))) for c, own in want.items()}
    # damaged, as the registered query does it
    got = {r[0]: tuple(r)[1:] for r in cv.structure_repair(*cv.damaged(df)).collect()}
    assert got.keys() == want.keys()
    for conv, own in want.items():
        left = []
        for turn, role, text in sorted(own, key=lambda x: (x[0] is not None, x[0] or 0)):
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
            left += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
        assert got[conv] == repaired(left), conv
    lone = spark.createDataFrame([(5, 1, "user", "a.")], "conv_id string, turn int, role string, text string")
    gone = cv.structure_repair(lone, lost=lone.turn == 1).collect()
    assert [tuple(r) for r in gone] == [("5", 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert cv.structure_repair(lone.limit(0)).count() == 0


# -- ranked search -------------------------------------------------------------------------------
def ranking(docs, items, k):
    docs = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    docs = [(d, c) for d, c in docs if c]
    n_docs, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for d, c in docs:
            m = 10 + (90 * sum(c.values()) * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(TERM.findall(lower(text))) if t in c)
            if s:
                scored.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, *_, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def test_bit_slices():
    rng = np.random.default_rng(2)
    value = rng.integers(0, 1 << 30, (5, 300))
    value[:, rng.random(300) < 0.5] = 0
    total = np.zeros((3, 40, 5), np.uint64)
    want = np.zeros((3, 300), np.int64)
    for term in range(5):
        pos = np.flatnonzero(value[term])
        which = np.sort(rng.choice(3, 2, replace=False))
        rs.add(total, which, *rs.slices_of(pos, value[term][pos], 30))
        want[which] += value[term]
    for i in range(3):
        bits = np.unpackbits(total[i].view(np.uint8), axis=1, bitorder="little")[:, :300].astype(np.int64)
        assert (bits << np.arange(40)[:, None]).sum(0).tolist() == want[i].tolist()
        for k in (1, 7, 400):
            sure, level = (set(rs._set_bits(x[i]).tolist()) for x in rs.leaders(total, k))
            best = sorted(np.flatnonzero(want[i]).tolist(), key=lambda d: -want[i][d])
            assert len(sure) <= k and not sure & level
            if len(best) > k:
                assert len(sure) == k or {want[i][d] for d in level} == {want[i][best[k - 1]]}
                assert sorted(want[i][d] for d in sure) == sorted(want[i][d] for d in best[: len(sure)])
            else:
                assert sure == set(best)


@pytest.mark.parametrize("small", [False, True])
def test_ranked_search(spark, monkeypatch, small):
    if small:
        monkeypatch.setattr(rs, "BLOCK", 7)
        monkeypatch.setattr(rs, "CHUNK", 16)
        monkeypatch.setattr(rs, "ITEMS", 2)
    rng = random.Random(6)
    words = [f"w{i}" for i in range(40)] + ["Ünï", "É", "the", "The", "x1"]
    docs = [(i, rng.choice([" ", "-", "　"]).join(rng.choice(words) for _ in range(rng.randrange(1, 30)))) for i in range(60)]
    docs += [(70, None), (71, "  ,, "), (72, ""), (None, "w1 w2 w3"), (73, "w1 w2 w3"), (73, "w1 w2 w3"), (74, "w4 " * 40_000), (-5, "w1 w2 w3")]
    items = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 9)))) for i in range(9)] + [(20, None), (21, "?"), (22, "nowhere"), (3, "w1 w2"), (None, "w5 w6"), (23, "the " * 500)]
    d = spark.createDataFrame([(*r, "clash") for r in docs], "doc_id long, text string, score string").repartition(2)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    for k in (10, 3):
        assert sorted((tuple(r) for r in rs.ranked_search(d, q, k).collect()), key=str) == ranking(docs, items, k)
    assert rs.ranked_search(d.limit(0), q).count() == 0 and rs.ranked_search(d, q.limit(0)).count() == 0


# -- SimHash -------------------------------------------------------------------------------------
def fingerprint(text, k=4):
    w = WORD.findall(lower(text))
    own = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in own]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(prints, radius):
    label = dict.fromkeys(range(len(prints)))
    label = {i: i for i in label}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            label[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(simhash, "WORDS", 37)  # shingles of one text are hashed in several parts
    rng = random.Random(8)
    words = [f"w{i}" for i in range(300)] + ["Ünï", "漢字", "The"]
    base = [rng.choice(words) for _ in range(400)]
    texts = [" ".join(base), " \t".join(base), "THE " * 300, "the " * 299, "one two", "ONE\ntwo", "one two three four", "", None, " \n", "w1 " * 9000]
    for i in range(40):
        own = list(base)
        own[i * 9] = "other"
        texts.append("  ".join(own))
    texts += [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(60)]
    rows = [(i * 2, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], ""), (None, texts[4], ""), (7, None, "")]
    got = sorted(((r.doc_id is None, r.doc_id or 0, r.fingerprint, r.component_id) for r in simhash.simhash_dedup(spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)).collect()), key=str)
    prints = [fingerprint(t) for _, t, _ in rows]
    label = classes(prints, 4)
    least = {c: min(r[0] for r, o in zip(rows, label, strict=True) if o == c and r[0] is not None) for c in set(label)}
    assert got == sorted(((r[0] is None, r[0] or 0, f"{p:016x}", least[c]) for r, p, c in zip(rows, prints, label, strict=True)), key=str)
    assert simhash.simhash_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_masks_cover_every_pair():
    rng = random.Random(9)
    for n in (10, 10**6, 10**8, 10**10):
        tables = simhash.masks(n, 4)
        for _ in range(300):
            x = rng.getrandbits(64)
            y = x
            for b in rng.sample(range(64), 4):
                y ^= 1 << b
            assert any(x & m == y & m for m in tables)
        assert n <= simhash.FILL << min(m.bit_count() for m in tables)


def test_tree():
    rng = random.Random(10)
    own = [rng.getrandbits(12) for _ in range(300)]
    tree = simhash.Tree()
    for x in set(own):
        tree.add(x)
    for x in own[:50]:
        assert set(tree.within(x, 2)) == {y for y in own if (x ^ y).bit_count() <= 2}
    assert list(simhash.Tree().within(3, 64)) == []


def test_large_buckets_are_cut_into_shards(spark, monkeypatch):
    """A group that shares most bits, in trees of a few nodes, with links only between shards."""
    monkeypatch.setattr(simhash, "SHARD", 6)
    rng = random.Random(11)
    own = {(sum(1 << b for b in rng.sample(range(40), 7))) | 0xABC << 48 for _ in range(120)} | {rng.getrandbits(64) for _ in range(60)}
    own = sorted(own)
    signed = [simhash._signed(x) for x in own]
    s = simhash.st.Stages(spark, "test")
    prints = spark.createDataFrame([(x,) for x in signed], "fp long")
    none = spark.createDataFrame([], "node long, comp long")
    links = simhash._tree_links(s, prints, none, simhash.masks(len(own), 4), 4).collect()
    number = {x: i for i, x in enumerate(signed)}
    label = list(range(len(own)))
    for a, b in ((number[r.a], number[r.b]) for r in links):
        assert (own[a] ^ own[b]).bit_count() <= 4
        x, y = sorted((label[a], label[b]))
        label = [x if v == y else v for v in label]
    assert label == classes(own, 4) and len(set(label)) < len(own)


def test_registered():
    assert {"op11_conversation_repair", "op12_ranked_search", "op13_simhash_dedup"} <= queries.queries().keys()
