"""Finding the shards of text in which repeats can lie: shared by the two repeat removers.

Both removers have one rule: of all runs of ``width`` consecutive units (words or bytes), remove the
units covered by a run that also starts earlier, in a smaller doc_id or earlier in the document.
Equal runs hold the same least hash over their q-unit grams (winnowing, Schleimer et al. 2003), so:

1. **Anchors.** One scan cuts every document into stretches of consecutive run starts that share
   their least hash: about two per ``width - q + 2`` starts. A row (anchor, text, start) each. Short grams
   recur by chance, and the more often the more text there is; half a run is long enough for bytes.
2. **Recurring anchors** are those found in more than one (text, start), and those whose hash
   stands in more than one place of their stretch. Identical whole texts
   count as one text, so copies make nothing recur; a later copy of a text is removed whole.
3. **Passages.** Texts with recurring anchors are read again, and each such stretch is cut out
   with the units its runs cover. A passage that this task has met already is decided on the spot
   (tasks see documents in order), so a passage that a third of all documents hold leaves each task
   once. The rest is dealt out by anchor: all equal runs meet in one shard.
4. **Shards.** Each remover finds in its shards, by its own method, which runs started earlier.
   An anchor with more than ``HOT`` stretches is split by a longer key, the fingerprint of the whole
   run: each run is a passage of its own, and only equal runs meet.
5. **Removal.** The spans found are joined to the documents by id.

Fingerprints of 64 bits route and count; what is removed is decided on words or bytes, or, for copies
of whole texts and for passages that a task has met already, on 128 bits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stages as st
from . import text as tx

U = np.uint64
HOT = 2_000
SEEN = 2_000_000


class Units:
    """A slice's documents as units to compare; ``first`` bounds the documents, ``grams`` hashes."""

    def __init__(self, s: tx.Slice, words: bool, q: int):
        if words:
            self.words = tx.Words(s)
            self.first, self.data = self.words.first, s.data
            self.hash = self.words.hashes()
            self.grams = tx.shingle_hashes(self.hash, q)
        else:
            self.words, self.first, self.data = None, s.offs, s.data
            self.grams = _byte_grams(s.data, q)

    def __len__(self) -> int:
        return int(self.first[-1])

    def cut(self, a: int, b: int) -> bytes:
        """Units a to b, words joined by one space."""
        if self.words is None:
            return self.data[a:b].tobytes()
        start, end = self.words.start, self.words.end
        raw = self.data[start[a] : end[b - 1]].tobytes()
        return b" ".join(raw.split())


def _byte_grams(data: np.ndarray, q: int) -> np.ndarray:
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.empty(n, U)
    power, inverse = tx._powers(tx.CHUNK_BYTES + q + 1)
    for a in range(0, n, tx.CHUNK_BYTES):
        b = min(a + tx.CHUNK_BYTES, n)
        part = data[a : b + q - 1].astype(U) + U(1)
        total = np.zeros(len(part) + 1, U)
        np.cumsum(part * power[: len(part)], out=total[1:])
        out[a:b] = tx.mix((total[q:] - total[:-q]) * inverse[: b - a])
    return out


def stretches(units: Units, width: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(least hash, document, first start, number of starts, whether the least hash stands in more
    than one place, so that a run may recur within) of each stretch of a slice."""
    n, r = len(units), width - q + 1
    if n < width:
        return np.zeros(0, U), *[np.zeros(0, np.int64)] * 3, np.zeros(0, bool)
    least = units.grams
    have = 1
    while have < r:
        step = min(have, r - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    ok = tx.starts_within(units.first, width, n)[: len(least)]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~ok[:-1]
    begins = units.first[:-1]
    new[begins[begins < len(new)]] = True
    begin = np.flatnonzero(new & ok)
    stop = np.ones(len(least) + 1, bool)
    stop[:-1] = new | ~ok
    ends = np.flatnonzero(stop)
    count = ends[np.searchsorted(ends, begin, "right")] - begin
    doc = np.searchsorted(units.first, begin, "right") - 1
    value = least[begin]
    windows = np.lib.stride_tricks.sliding_window_view(units.grams, r)
    inner = np.zeros(len(begin), bool)
    for a in range(0, len(begin), 1 << 14):
        part = slice(a, a + (1 << 14))
        left = (windows[begin[part]] == value[part, None]).argmax(1)
        right = r - 1 - (windows[begin[part] + count[part] - 1][:, ::-1] == value[part, None]).argmax(1)
        inner[part] = right + count[part] - 1 != left
    return value, doc, begin, count, inner


def _anchors(words: bool, width: int, q: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            texts = batch.column("t").to_numpy(zero_copy_only=False)
            for s in tx.slices(batch.column("_text")):
                units = Units(s, words, q)
                least, doc, begin, _, inner = stretches(units, width, q)
                t = texts[s.first : s.first + len(s)]
                pick = np.zeros(len(s), bool)
                for i, x in enumerate(t.tolist()):
                    if x not in seen:
                        seen.add(x)
                        pick[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                use = pick[doc]
                start = begin - units.first[doc]
                start = np.where(inner, -1 - start, start)  # negative: recurs by itself
                rows = [least[use].view(np.int64), t[doc[use]], start[use].astype(np.int32)]
                yield pa.record_batch([pa.array(x) for x in rows], names=["a", "t", "s"])

    return run


def _passages(words: bool, width: int, q: int):
    """kind 0: a passage to decide (a, d, t, s, n, body); 3: the same, in which a run may recur;
    1: runs s to s+n that started earlier. Runs of a hot anchor are passages by themselves."""
    names = ["kind", "a", "d", "t", "s", "n", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        last = None
        for batch in batches:
            ids, texts = batch.column("_id").to_pylist(), batch.column("t").to_pylist()
            wanted, hot = batch.column("at").to_pylist(), batch.column("hot").to_pylist()
            for s in tx.slices(batch.column("_text")):
                units = Units(s, words, q)
                least, doc, begin, count, inner = stretches(units, width, q)
                rel = begin - units.first[doc]
                bounds = np.searchsorted(doc, np.arange(len(s) + 1))
                kind, aa, dd, tt, ss, nn, body = [], [], [], [], [], [], []
                for i in range(len(s)):
                    lo, hi = bounds[i], bounds[i + 1]
                    d, t = ids[s.first + i], texts[s.first + i]
                    if (d, t) == last:  # the same row again
                        continue
                    last = (d, t)
                    at = np.array(sorted(wanted[s.first + i]), np.int64)
                    where = lo + np.searchsorted(rel[lo:hi], at)
                    burning = set(hot[s.first + i] or ())
                    for j, b, c in zip(where.tolist(), begin[where].tolist(), count[where].tolist(), strict=True):
                        cut = units.cut(b, b + c - 1 + width)
                        key = xxhash.xxh3_128_digest(cut)
                        if key in seen:
                            kind.append(1)
                            body.append(None)
                        elif int(rel[j]) in burning:
                            whole = key
                            for k, own in enumerate(_fingerprints(units, b, c, width)):
                                cut = units.cut(b + k, b + k + width)
                                key = xxhash.xxh3_128_digest(cut)
                                kind.append(int(key in seen))
                                body.append(None if key in seen else cut)
                                seen.add(key)
                                aa.append(own)
                                dd.append(d)
                                tt.append(t)
                                ss.append(int(rel[j]) + k)
                                nn.append(1)
                            seen.add(whole)
                            continue
                        else:
                            seen.add(key)
                            kind.append(3 if inner[j] else 0)
                            body.append(cut)
                        aa.append(int(least[j].view(np.int64)))
                        dd.append(d)
                        tt.append(t)
                        ss.append(int(rel[j]))
                        nn.append(c)
                    if len(seen) > SEEN:
                        seen.clear()
                yield pa.record_batch([pa.array(kind, pa.int8()), pa.array(aa, pa.int64()), pa.array(dd, pa.int64()), pa.array(tt, pa.int64()), pa.array(ss, pa.int32()), pa.array(nn, pa.int32()), pa.array(body, pa.binary())], names=names)

    return run


def _fingerprints(units: Units, begin: int, count: int, width: int) -> list[int]:
    """One 64-bit fingerprint for each run of the stretch."""
    if units.words is not None:
        h = tx.shingle_hashes(units.hash[begin : begin + count - 1 + width], width)
    else:
        h = _byte_grams(units.data[begin : begin + count - 1 + width], width)
    return h[:count].view(np.int64).tolist()


#: (anchor, document, text, start, runs, body), in order of anchor, document, text, start
Passage = tuple[int, int, int, int, int, bytes]
Shard = Callable[[list[Passage]], Iterator[tuple[int, int, int, int]]]


def _decide(shard: Shard):
    """Groups a partition's passages by anchor and has ``shard`` decide them, some anchors a call.

    Of equal passages only the first is handed on; one that stays alone with its anchor is handed
    on only if a run may recur inside it."""
    limit = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, size, inner, spans = None, 0, False, []
        own: dict[bytes, Passage] = {}
        block: list[Passage] = []

        def close() -> None:
            nonlocal size, inner
            if len(own) > 1 or inner:
                block.extend(own.values())
                size += sum(map(len, own))
            own.clear()
            inner = False

        def out():
            rows = list(zip(*spans, strict=True)) or [(), (), (), ()]
            spans.clear()
            return pa.record_batch([pa.array(x, kind()) for x, kind in zip(rows, (pa.int64, pa.int64, pa.int32, pa.int32), strict=True)], names=["d", "t", "s", "n"])

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("kind", "a", "d", "t", "s", "n", "body")]
            for kind, a, d, t, s, n, body in zip(*cols, strict=True):
                if a != key:
                    close()
                    key = a
                    if size > limit:
                        spans += shard(block)
                        block, size = [], 0
                        if len(spans) > 100_000:
                            yield out()
                if body in own:
                    spans.append((d, t, s, n))
                else:
                    own[body] = (a, d, t, s, n, body)
                    inner |= kind == 3
        close()
        if block:
            spans += shard(block)
        yield out()

    return run


def _removed(words: bool, width: int, finish):
    """Joins a document's spans of removed run starts into a mask of removed units."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, whole = batch.column("spans"), batch.column("whole").to_pylist()
            for s in tx.slices(batch.column("_text")):
                if words:
                    w = tx.Words(s)
                    first = w.first
                else:
                    w, first = None, s.offs
                count = np.diff(first)
                step = np.zeros(int(first[-1]) + 1, np.int32)
                for i in range(len(s)):
                    if whole[s.first + i] and count[i] >= width:
                        step[first[i]] += 1
                        step[first[i + 1]] -= 1
                        continue
                    own = spans[s.first + i].as_py()
                    if own:
                        a = np.array([x["s"] for x in own]) + first[i]
                        b = a + np.array([x["n"] for x in own]) - 1 + width
                        np.add.at(step, a, 1)
                        np.add.at(step, b, -1)
                gone = np.cumsum(step[:-1]) > 0
                yield finish(batch.column("_id").slice(s.first, len(s)), s, w, first, gone)

    return run


def remove(docs: DataFrame, name: str, words: bool, width: int, q: int, shard: Shard, finish, schema: str, id_col: str, text_col: str) -> DataFrame:
    spark = docs.sparkSession
    s = st.Stages(spark, name)
    plain = st.documents(docs, id_col, text_col)
    with_t = plain.withColumn("t", F.xxhash64("_text"))
    texts = s.keep(with_t.where(F.col("_text").isNotNull()).select("_id", "t", F.xxhash64(F.lit("whole"), "_text").alias("u")), "texts")
    firsts = s.keep(texts.groupBy("t", "u").agg(F.min("_id").alias("d")), "firsts")
    anchors = with_t.where(F.col("_text").isNotNull()).select("_text", "t").mapInArrow(_anchors(words, width, q), "a long, t long, s int")
    anchors = anchors.repartition(st.tasks(spark), "a")
    seen = anchors.selectExpr("a", "t", "s", "min(xxhash64(t, s)) OVER (PARTITION BY a) lo", "max(xxhash64(t, s)) OVER (PARTITION BY a) hi", "count(*) OVER (PARTITION BY a) m")
    seen = seen.where("lo <> hi OR s < 0").selectExpr("CASE WHEN s < 0 THEN -1 - s ELSE s END s", "t", "m")
    per_text = seen.groupBy("t").agg(F.collect_set("s").alias("at"), F.collect_set(F.expr(f"CASE WHEN m > {HOT} THEN s END")).alias("hot"))
    wanted = s.keep(per_text.join(firsts, "t").select(F.col("d").alias("_id"), "t", "at", "hot").distinct(), "wanted")
    found = with_t.join(wanted, ["_id", "t"]).select("_id", "t", "_text", "at", "hot").sortWithinPartitions("_id", "t")
    found = s.keep(found.mapInArrow(_passages(words, width, q), "kind tinyint, a long, d long, t long, s int, n int, body binary"), "found")
    s.drop("wanted")
    passages = found.where("kind IN (0, 3)").repartition(st.tasks(spark), "a").sortWithinPartitions("a", "d", "t", "s")
    spans = s.keep(passages.mapInArrow(_decide(shard), "d long, t long, s int, n int"), "spans")
    every = spans.union(found.where("kind = 1").select("d", "t", "s", "n"))
    of_doc = every.groupBy("d", "t").agg(F.collect_list(F.struct("s", "n")).alias("spans")).select(F.col("d").alias("_id"), "t", "spans")
    copies = texts.join(firsts, ["t", "u"]).where("_id > d").select("_id", "t", F.lit(True).alias("whole")).distinct()
    info = s.keep(of_doc.join(copies, ["_id", "t"], "full").select("_id", "t", "spans", "whole"), "info")
    s.drop("texts", "firsts", "found", "spans")
    joined = with_t.join(info, ["_id", "t"], "left").select("_id", "_text", "spans", "whole")
    return joined.mapInArrow(_removed(words, width, finish), schema)
