"""Suffix-array dedup of exact byte strings.

Every byte covered by a string of ``width`` bytes that also starts earlier (smaller doc_id, or same
document, earlier start) is removed; overlaps count, matches never cross documents, and strings are
judged on the input.

``repeats`` deals the passages in which such strings can recur to shards, by content: equal strings
always come to one task. A task cuts its passages into shards of about ``SHARD_BYTES``. A shard sorts
the suffixes of its passages by Larsson-Sadakane refinement (only groups that are still tied are sorted
again, by the rank further on), takes common prefixes of neighbours in text order as Kasai does (a
neighbour pair that both moved on by one byte has one less) and marks the strings whose common prefix
with an earlier one reaches ``width``. Shards that share an anchor are merged by binary search: strings
of the later one that are not marked yet are looked up in the suffix array of the earlier.

Nulls, empty and short texts lose nothing. Rows with an equal id and text are one document; of
different texts with one id the order is that of their fingerprints. Rows without an id are
returned whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats

SHARD_BYTES = 1 << 19


def _words(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position, as numbers that order like them; ends count as zeros."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    n = len(data)
    out = np.zeros(n, np.uint64)
    for i in range(8):
        out |= padded[i : n + i] << np.uint64(56 - 8 * i)
    return out


def suffix_ranks(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, rank): suffixes by their first ``depth`` bytes; equal ones share a rank."""
    n = len(data)
    keys = _words(data) >> np.uint64(8 * max(0, 8 - depth))
    order = np.argsort(keys)
    new = np.ones(n, bool)
    new[1:] = keys[order[1:]] != keys[order[:-1]]
    rank = np.zeros(n + depth + 1, np.int64)
    place = np.flatnonzero(new)
    rank[order] = np.repeat(place, np.diff(np.append(place, n))) + 1
    h = min(8, depth)
    while h < depth:
        step = min(h, depth - h)
        alone = new & np.append(new[1:], True)
        tied = np.flatnonzero(~alone)
        if not len(tied):
            break
        at = order[tied]
        key = (rank[at].astype(np.uint64) << np.uint64(32)) | rank[at + step].astype(np.uint64)
        by = np.argsort(key)
        at, key = at[by], key[by]
        order[tied] = at
        fresh = np.ones(len(at), bool)
        fresh[1:] = key[1:] != key[:-1]
        new[tied] = fresh
        place = tied[fresh]
        rank[at] = np.repeat(place, np.diff(np.append(np.flatnonzero(fresh), len(at)))) + 1
        h += step
    return order, rank[:n]


def common_prefixes(data: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each listed suffix with its predecessor in ``order``."""
    n = len(data)
    before = np.full(n + 1, -2, np.int64)
    before[order[1:]] = order[:-1]
    has = before[:n] >= 0
    at = np.flatnonzero(has)
    follows = np.zeros(len(at), bool)
    follows[1:] = (at[1:] == at[:-1] + 1) & (before[at[1:]] == before[at[:-1]] + 1)
    heads = np.flatnonzero(~follows)
    keys = np.concatenate([_words(data), np.zeros(8, np.uint64)])
    length = np.zeros(len(heads), np.int64)
    a, b = at[heads], before[at[heads]]
    live = np.arange(len(heads))
    while len(live):
        x, y = a[live] + length[live], b[live] + length[live]
        inside = np.maximum(x, y) + 8 <= n
        same = np.zeros(len(live), bool)
        same[inside] = keys[x[inside]] == keys[y[inside]]
        for i in np.flatnonzero(~inside):  # at the end of the data
            while max(x[i], y[i]) < n and data[x[i]] == data[y[i]]:
                x[i] += 1
                y[i] += 1
            length[live[i]] = x[i] - a[live[i]]
        diff = inside & ~same
        if diff.any():
            gap = keys[x[diff]] ^ keys[y[diff]]
            first = np.zeros(len(gap), np.int64)
            for shift in range(8):
                first[(gap >> np.uint64(56 - 8 * shift)) == 0] = shift + 1
            length[live[diff]] += first
        length[live[same]] += 8
        live = live[same]
    out = np.zeros(n, np.int64)
    group = np.cumsum(~follows) - 1
    out[at] = np.maximum(length[group] - (at - at[heads][group]), 0)
    return out


class Shard:
    """The suffix array of some passages: ``starts`` are the strings' places, ``listed`` those places in
    the order of their first ``width`` bytes, ``late`` which of them have an equal one before them."""

    def __init__(self, block: list[repeats.Passage], width: int):
        self.block, self.width = block, width
        sizes = np.array([len(p[5]) for p in block])
        runs = np.array([p[4] for p in block])
        base = np.concatenate([[0], np.cumsum(sizes)])
        data = np.frombuffer(b"".join(p[5] for p in block), np.uint8)
        self.owner = np.repeat(np.arange(len(block)), runs)
        self.place = np.arange(len(self.owner)) - np.repeat(np.cumsum(runs) - runs, runs)
        self.starts = base[:-1][self.owner] + self.place
        _, rank = suffix_ranks(data, width)
        self.listed = self.starts[np.argsort((rank[self.starts].astype(np.uint64) << np.uint64(32)) | self.starts.astype(np.uint64))]
        self.late = common_prefixes(data, self.listed)[self.starts] >= width
        self.words = _words(data)

    def compare(self, a: np.ndarray, other: Shard, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as the strings at a are less than, equal to or greater than the other's at b."""
        out = np.zeros(len(a), np.int8)
        for i in range(0, self.width, 8):
            drop = np.uint64(8 * max(0, i + 8 - self.width))
            x, y = self.words[np.minimum(a + i, len(self.words) - 1)] >> drop, other.words[np.minimum(b + i, len(other.words) - 1)] >> drop
            out = np.where(out == 0, (x > y).astype(np.int8) - (x < y), out)
            if out.all():
                break
        return out

    def merge(self, earlier: Shard) -> None:
        """Marks the strings that the earlier shard holds: those of the anchor that both have."""
        anchors = np.array([p[0] for p in self.block])[self.owner]
        at = np.flatnonzero(~self.late & (anchors == earlier.block[-1][0]))
        low, high = np.zeros(len(at), np.int64), np.full(len(at), len(earlier.listed))
        while (open_ := np.flatnonzero(low < high)).size:
            mid = (low[open_] + high[open_]) // 2
            greater = self.compare(self.starts[at[open_]], earlier, earlier.listed[mid]) > 0
            low[open_[greater]] = mid[greater] + 1
            high[open_[~greater]] = mid[~greater]
        inside = np.flatnonzero(low < len(earlier.listed))
        same = self.compare(self.starts[at[inside]], earlier, earlier.listed[low[inside]]) == 0
        self.late[at[inside[same]]] = True

    def spans(self) -> Iterator[tuple[int, int, int, int]]:
        late, owner = self.late, self.owner
        begin = late & np.append(True, ~late[:-1] | (owner[1:] != owner[:-1]))
        end = late & np.append(~late[1:] | (owner[1:] != owner[:-1]), True)
        for a, b in zip(np.flatnonzero(begin).tolist(), np.flatnonzero(end).tolist(), strict=True):
            _, d, t, s, _, _ = self.block[owner[a]]
            yield d, t, s + int(self.place[a]), b - a + 1


def suffix_array(width: int):
    """Decides a task's passages, which come in the order of their anchors and documents."""

    def decide(block: list[repeats.Passage]) -> Iterator[tuple[int, int, int, int]]:
        size = np.cumsum([len(p[5]) for p in block])
        cuts = np.searchsorted(size, np.arange(1, -(-int(size[-1]) // SHARD_BYTES)) * SHARD_BYTES)
        bounds = sorted({0, *cuts.tolist(), len(block)})
        shards: list[Shard] = []
        for a, b in zip(bounds, bounds[1:], strict=False):
            own = Shard(block[a:b], width)
            shards = [x for x in shards if x.block[-1][0] == own.block[0][0]]
            for x in shards:
                own.merge(x)
            yield from own.spans()
            shards.append(own)

    return decide


def _finish(ids: pa.Array, s, w, first: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    n = np.diff(first)
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[first[1:]] - total[first[:-1]]
    begins = gone.copy()
    begins[1:] &= ~gone[:-1]
    inner = first[:-1][n > 0]
    begins[inner] = gone[inner]
    count = np.concatenate([[0], np.cumsum(begins)])
    kept = [s.data[a:b][~gone[a:b]].tobytes() if r else s.data[a:b].tobytes() for a, b, r in zip(first[:-1], first[1:], removed, strict=True)]
    return pa.record_batch([ids, pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array((count[first[1:]] - count[first[:-1]]).astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_bytes"])


def suffix_dedup(docs: DataFrame, width: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes) of every row of docs."""
    return repeats.remove(docs, "suffix", False, width, max(1, width // 2), suffix_array(width), _finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary", id_col, text_col)
