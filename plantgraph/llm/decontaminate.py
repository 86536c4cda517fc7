"""Benchmark decontamination by suffix arrays of the training text.

Every shard of documents (a slice of a task's batch) builds a suffix array over its words and every
test suffix is searched in it by bisection, which gives its longest verbatim match with a location,
and every place at which the window starting there occurs. Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``
after lower-casing A-Z. A window is ``width`` consecutive words of an item; an item of fewer words,
but not none, is one window.

A match consists of words that the test set has, so before sorting, a shard keeps only its stretches
of at least the shortest window's length in which every word is known to the test set; elsewhere no
test suffix can reach a window. Words compare by their place in the sorted test vocabulary.

The test set is brought to the driver and shipped to the tasks in blocks of at most ``BLOCK_BYTES``
of text (one item may be more), so its size does not matter to memory; documents are read once per
block. Documents are never shuffled.

Null or wordless items and documents match nothing. Rows that repeat an item id add windows to one item.
Rows that repeat a doc_id or have none are judged one by one. Empty tables give no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stages as st
from . import text as tx

U = np.uint64
BLOCK_BYTES = 16 << 20


class Tests:
    """A block of test items, as sequences of numbers in the order of their sorted word hashes."""

    def __init__(self, items: list[tuple[str, str]], width: int):
        self.width = width
        self.names = [i for i, _ in items]
        column = pa.array([t for _, t in items], pa.large_string())
        hashes, bounds, size = [], [0], 0
        for s in tx.slices(column):
            words = tx.Words(s, tx.NOT_ALNUM, lower=True)
            hashes.append(words.hashes())
            bounds += [size + int(x) for x in words.first[1:]]
            size += len(words)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, U)
        self.vocabulary = np.unique(flat)
        self.first = np.array(bounds, np.int64)
        length = np.diff(self.first)
        self.shortest = int(min(width, *length[length > 0])) if (length > 0).any() else 0
        #: the words, with a gap (0) after the last item, and of each suffix its item and length
        self.words = np.append(np.searchsorted(self.vocabulary, flat) + 1, np.zeros(1, np.int64))
        self.item = np.repeat(np.arange(len(items)), length)
        self.room = self.first[1:][self.item] - np.arange(len(flat))
        self.need = np.minimum(width, length)[self.item]
        self.table = np.zeros(1 << 20, bool)
        self.table[(self.vocabulary & U((1 << 20) - 1)).astype(np.int64)] = True

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """Place of each word hash in the vocabulary, from 1; 0 for words that no item has."""
        out = np.zeros(len(h), np.int64)
        at = np.flatnonzero(self.table[(h & U((1 << 20) - 1)).astype(np.int64)])
        place = np.searchsorted(self.vocabulary, h[at])
        place[place == len(self.vocabulary)] = 0
        known = self.vocabulary[place] == h[at]
        out[at[known]] = place[known] + 1
        return out


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Larsson-Sadakane: sort by one word, then only what is tied, by the rank ever further on."""
    n = len(x)
    order = np.argsort(x, kind="stable")
    new = np.ones(n, bool)
    new[1:] = x[order[1:]] != x[order[:-1]]
    rank = np.zeros(2 * n + 1, np.int64)
    place = np.flatnonzero(new)
    rank[order] = np.repeat(place, np.diff(np.append(place, n))) + 1
    h = 1
    while h < n:
        tied = np.flatnonzero(~(new & np.append(new[1:], True)))
        if not len(tied):
            break
        at = order[tied]
        key = (rank[at].astype(U) << U(32)) | rank[at + h].astype(U)
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[tied] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[tied] = fresh
        rank[at] = np.repeat(tied[fresh], np.diff(np.append(np.flatnonzero(fresh), len(at)))) + 1
        h *= 2
    return order


def _common(x: np.ndarray, a: np.ndarray, y: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of x[a:] and y[b:], ``most`` at most."""
    out = np.zeros(len(a), np.int64)
    live = np.flatnonzero(most > 0)
    while len(live):
        i, j = a[live] + out[live], b[live] + out[live]
        inside = (i < len(x)) & (j < len(y))
        live, i, j = live[inside], i[inside], j[inside]
        live = live[x[i] == y[j]]
        out[live] += 1
        live = live[out[live] < most[live]]
    return out


def search(x: np.ndarray, order: np.ndarray, tests: Tests, depth: np.ndarray) -> np.ndarray:
    """For each test suffix, how many suffixes of x are less than its first ``depth`` words."""
    m = len(tests.item)
    low, high = np.zeros(m, np.int64), np.full(m, len(order), np.int64)
    start = np.arange(m)
    while (open_ := low < high).any():
        at = np.flatnonzero(open_)
        mid = (low[at] + high[at]) // 2
        own = order[mid]
        same = _common(x, own, tests.words, start[at], depth[at])
        end = same >= depth[at]
        left = np.where(own + same < len(x), x[np.minimum(own + same, len(x) - 1)], -1)
        less = ~end & (left < tests.words[np.minimum(start[at] + same, len(tests.words) - 1)])
        low[at[less]] = mid[less] + 1
        high[at[~less]] = mid[~less]
    return low


KIND = pa.list_(pa.struct([("item_id", pa.string()), ("length", pa.int32()), ("position", pa.int32())]))
SCHEMA = "doc_id long, text string, n_words long, n_hit long, hits binary, matches array<struct<item_id: string, length: int, position: int>>"


def _scan(tests: Tests, more: bool):
    """Adds a block's matches to every document; ``more``: to those of earlier blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tx.slices(batch.column("text")):
                words = tx.Words(s, tx.NOT_ALNUM, lower=True)
                first = words.first
                x = tests.numbers(words.hashes())
                hit = np.zeros(len(x) + 1, np.int32)
                found: list[dict[int, tuple[int, int]]] = [{} for _ in range(len(s))]
                if tests.shortest and len(x):
                    _match(tests, words, x, hit, found)
                gone = np.cumsum(hit) > 0
                bits = [np.packbits(gone[a:b]) for a, b in zip(first[:-1], first[1:], strict=True)]
                rows = [[{"item_id": tests.names[i], "length": k, "position": p} for i, (k, p) in sorted(f.items())] for f in found]
                if more:
                    old = batch.slice(s.first, len(s))
                    bits = [b | np.frombuffer(o, np.uint8) for b, o in zip(bits, old.column("hits").to_pylist(), strict=True)]
                    rows = [o + r for o, r in zip(old.column("matches").to_pylist(), rows, strict=True)]
                n_hit = [int(np.bitwise_count(b).sum()) for b in bits]
                own = batch.slice(s.first, len(s))
                yield pa.record_batch([own.column("doc_id"), own.column("text"), pa.array(np.diff(first).astype(np.int64)), pa.array(n_hit, pa.int64()), tx.binary([b.tobytes() for b in bits]), pa.array(rows, KIND)], names=["doc_id", "text", "n_words", "n_hit", "hits", "matches"])

    return run


def _match(tests: Tests, words: tx.Words, x: np.ndarray, hit: np.ndarray, found: list) -> None:
    known = x > 0
    edge = np.ones(len(x) + 1, bool)
    edge[1:-1] = known[1:] != known[:-1]
    edge[words.first] = True
    at = np.flatnonzero(edge)
    a, b = at[:-1], at[1:]
    keep = known[a] & (b - a >= tests.shortest)
    a, b = a[keep], b[keep]
    if not len(a):
        return
    size = b - a + 1  # with a gap after each stretch
    origin = np.repeat(a - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    text = x[np.minimum(origin, len(x) - 1)]
    text[np.cumsum(size) - 1] = 0
    order = suffix_array(text)
    place = search(text, order, tests, tests.room)
    before, after = order[np.maximum(place - 1, 0)], order[np.minimum(place, len(order) - 1)]
    start = np.arange(len(tests.item))
    one, two = _common(text, before, tests.words, start, tests.room), _common(text, after, tests.words, start, tests.room)
    longest = np.maximum(one, two)
    reach = np.flatnonzero((tests.room >= tests.need) & (longest >= tests.need))
    if not len(reach):
        return
    low = search(text, order, tests, np.minimum(tests.need, tests.room))[reach]
    high, bound = low.copy(), np.full(len(reach), len(order), np.int64)
    while (open_ := high < bound).any():  # the last suffix that still begins with the window
        i = np.flatnonzero(open_)
        mid = (high[i] + bound[i]) // 2
        same = _common(text, order[mid], tests.words, reach[i], tests.need[reach[i]]) >= tests.need[reach[i]]
        high[i[same]] = mid[same] + 1
        bound[i[~same]] = mid[~same]
    count = high - low
    of = np.repeat(reach, count)
    local = order[np.repeat(low - (np.cumsum(count) - count), count) + np.arange(count.sum())]
    at = origin[local]
    np.add.at(hit, at, 1)
    np.add.at(hit, at + tests.need[of], -1)
    doc = np.searchsorted(words.first, at, "right") - 1
    reach_of = _common(text, local, tests.words, of, tests.room[of])
    for d, i, k, p in zip(doc.tolist(), tests.item[of].tolist(), reach_of.tolist(), (at - words.first[doc]).tolist(), strict=True):
        if k > found[d].get(i, (0, 0))[0]:
            found[d][i] = (k, p)


def _test_blocks(benchmark: DataFrame, width: int, item_col: str, text_col: str) -> Iterator[Tests]:
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("x")).where("x IS NOT NULL").distinct()
    total = items.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    n = max(1, -(-int(total) // BLOCK_BYTES))
    for k in range(n):
        yield Tests(sorted((r.i or "", r.x) for r in items.where(f"pmod(xxhash64(i, x), {n}) = {k}").toLocalIterator()), width)


def matches(docs: DataFrame, benchmark: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, matches) for every row of docs; a match has the item, the length in
    words of its longest verbatim match and the word position in the document."""
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    steps = st.Stages(docs.sparkSession, "decontaminate")
    for k, tests in enumerate(_test_blocks(benchmark, width, item_col, item_text_col)):
        if k and k % 4 == 0:  # a Python worker for each block is at work at a time
            out = steps.keep(out, f"blocks-{k}")
        out = out.mapInArrow(_scan(tests, k > 0), SCHEMA)
    return out.select("doc_id", "n_words", "n_hit", "matches")


def digest(found: DataFrame) -> DataFrame:
    """The number and sha256 of the items found, from the operator's matches."""
    ids = F.array_sort(F.array_distinct("matches.item_id"))
    return found.select("doc_id", "n_words", "n_hit", F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def _clean(tests: Tests, index: int):
    """Passes on the rows whose text holds no window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tx.slices(batch.column(index)):
                words = tx.Words(s, tx.NOT_ALNUM, lower=True)
                x = tests.numbers(words.hashes())
                hit = np.zeros(len(x) + 1, np.int32)
                if tests.shortest and len(x):
                    _match(tests, words, x, hit, [{} for _ in range(len(s))])
                total = np.concatenate([[0], np.cumsum(np.cumsum(hit[:-1]) > 0)])
                yield batch.slice(s.first, len(s)).filter(pa.array(total[words.first[1:]] == total[words.first[:-1]]))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 13, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that hold no window of the benchmark. Rows are
    decided where they lie, so nothing is joined or shuffled."""
    out = docs
    for tests in _test_blocks(benchmark, width, "item_id", "text"):
        out = out.mapInArrow(_clean(tests, docs.columns.index(text_col)), docs.schema)
    return out
