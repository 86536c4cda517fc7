"""SimHash near-dedup: 64-bit fingerprints of shingles, linked within a Hamming radius by BK-trees.

1. **Fingerprints.** One scan turns each text into the majority bits of the XXH64 values of its
   k-word shingles, repeats included; of these (doc_id, fingerprint) is all that is kept. Equal
   fingerprints are one node from here on, so copies are never paired.
2. **Buckets.** The 64 bits are cut into p >= radius + 2 pieces. Two fingerprints within the radius differ
   in ``radius`` pieces at most and agree on all others, so they meet in one of the C(p, radius)
   buckets (table, bits of the pieces kept). p grows with the number of fingerprints, so that a bucket
   is expected to hold no more than ``FILL`` of them at any size.
3. **Chains.** Neighbours in the order of a bucket that lie within the radius are linked. That alone
   joins most of a dense group, without a pair more than there are rows. It is a shortcut and loses
   nothing: buckets are dealt out by range, and a bucket may be cut anywhere.
4. **Trees.** A bucket that still holds several components becomes a BK-tree, whose children are
   keyed by their integer Hamming distance to the parent; a search follows only edges within the
   radius of its own distance. The commonest component only stands in the tree, all others ask it,
   and a search reports one partner a component. A bucket of more than ``SHARD`` fingerprints is cut
   into shards, each with its own tree, and those that ask visit every shard.
5. **Components** of all links, contracted; a document gets the least doc_id of its component.

Trees are built where their bucket lies and are not broadcast: all of them together grow with the
data. Results are exact; nothing is capped.

A null, empty or wordless text has fingerprint zero and is linked like any other. A text of fewer
than k words has one shingle, its whole sequence. Ids are cast to long; rows that repeat an id or a
text stay rows of their own; rows without an id take part, and their component is the least id
among the others, or null if there is none. Other columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import stages as st
from . import text as tx

SEED = 42
FILL = 32
SHARD = 2048
RUN_BYTES = 16 << 20
#: words whose shingles are hashed at a time
WORDS = 200_000
#: a fingerprint with this share of all rows is joined by broadcast: there are at most as many of them
HOT = 1000
U = np.uint64
LANES = U(0x0101010101010101)


# -- fingerprints --------------------------------------------------------------------------------
def _vote(votes: np.ndarray, h: np.ndarray, doc: np.ndarray) -> None:
    """Adds to votes (documents x 64) how many of the hashes have each bit; doc is ascending. Bits of
    255 hashes at most are added in the bytes of one integer before they are told apart."""
    start = np.union1d(np.flatnonzero(np.diff(doc, prepend=-1)), np.arange(0, len(h), 255))
    own = doc[start]
    first = np.flatnonzero(np.diff(own, prepend=-1))
    for j in range(8):
        part = np.add.reduceat((h >> U(j)) & LANES, start).view(np.uint8).reshape(-1, 8)
        votes[own[first], j::8] += np.add.reduceat(part.astype(np.int64), first, axis=0)


def _joined(words: tx.Words, lo: int, hi: int) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words lo to hi with one space between, and their bounds in that."""
    a, b = int(words.start[lo]), int(words.end[hi - 1])
    size = words.end[lo:hi] - words.start[lo:hi]
    step = np.zeros(b - a + 1, np.int8)
    step[words.start[lo:hi] - a] += 1
    step[words.end[lo:hi] - a] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8) > 0
    end = np.cumsum(size + 1) - 1
    out = np.full(int(end[-1]) + 1, 0x20, np.uint8)
    gap = np.ones(len(out), bool)
    gap[end] = False
    out[gap] = words.data[a:b][inside]
    return out.tobytes(), end - size, end


def fingerprints(s: tx.Slice, k: int) -> np.ndarray:
    """The fingerprint of each document of a slice."""
    words = tx.Words(s, tx.SPACE, lower=True)
    n = np.diff(words.first)
    shingles = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
    votes = np.zeros((len(n), 64), np.int64)
    start = np.repeat(words.first[:-1] - np.concatenate([[0], np.cumsum(shingles)[:-1]]), shingles) + np.arange(shingles.sum())
    doc = np.repeat(np.arange(len(n)), shingles)
    last = start + np.minimum(n, k)[doc] - 1
    digest = xxhash.xxh64_intdigest
    for i in range(0, len(start), WORDS):
        part = slice(i, i + WORDS)
        lo, hi = int(start[part][0]), int(last[part].max()) + 1
        text, begin, end = _joined(words, lo, hi)
        bounds = zip(begin[start[part] - lo].tolist(), end[last[part] - lo].tolist(), strict=True)
        _vote(votes, np.fromiter((digest(text[a:b], SEED) for a, b in bounds), U, len(start[part])), doc[part])
    bits = 2 * votes > shingles[:, None]
    return np.packbits(bits, axis=1, bitorder="little").view(U).ravel()


def _rows(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tx.slices(batch.column(1)):
                yield pa.record_batch([batch.column(0).slice(s.first, len(s)), pa.array(fingerprints(s, k).view(np.int64))], names=["doc_id", "fp"])

    return run


# -- buckets -------------------------------------------------------------------------------------
def masks(n: int, radius: int) -> list[int]:
    """The bits that each table of buckets keeps, for n fingerprints: any two numbers that differ in
    ``radius`` bits at most agree on one of them."""
    pieces = radius + 2
    while pieces < radius + 6 and n > FILL << (64 * (pieces - radius) // pieces):
        pieces += 1
    cut = [64 * i // pieces for i in range(pieces + 1)]
    own = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cut, cut[1:], strict=False)]
    return [sum(own[i] for i in keep) for keep in combinations(range(pieces), pieces - radius)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _buckets(tables: list[int]) -> Column:
    """The (t, key) of every bucket of a fingerprint."""
    return F.explode(F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m)).cast("long")).alias("key")) for i, m in enumerate(tables))))


def _chain(radius: int):
    """(a, b) of neighbours in sorted rows (t, key, fp) of one bucket that lie within the radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: list[np.ndarray] | None = None
        for batch in batches:
            if not len(batch):
                continue
            t, key, fp = (c.to_numpy() for c in batch.columns)
            if before is not None:
                t, key, fp = (np.concatenate([x, y]) for x, y in zip(before, (t, key, fp), strict=True))
            near = (t[1:] == t[:-1]) & (key[1:] == key[:-1]) & (np.bitwise_count(fp[1:].view(U) ^ fp[:-1].view(U)) <= radius)
            yield pa.record_batch([pa.array(fp[:-1][near]), pa.array(fp[1:][near])], names=["a", "b"])
            before = [t[-1:], key[-1:], fp[-1:]]

    return run


# -- trees ---------------------------------------------------------------------------------------
class Tree:
    """A BK-tree of distinct integers: children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.root: tuple[int, dict] | None = None

    def add(self, x: int) -> None:
        if self.root is None:
            self.root = (x, {})
            return
        (y, kids) = self.root
        d = (x ^ y).bit_count()
        while d in kids:
            y, kids = kids[d]
            d = (x ^ y).bit_count()
        kids[d] = (x, {})

    def within(self, x: int, radius: int) -> Iterator[int]:
        todo = [self.root] if self.root else []
        while todo:
            y, kids = todo.pop()
            d = (x ^ y).bit_count()
            if d <= radius:
                yield y
            for e, kid in kids.items():
                if d - radius <= e <= d + radius:
                    todo.append(kid)


def _run_links(fp: list[int], comp: list[int], tree: list[bool], ask: list[bool], radius: int) -> Iterator[tuple[int, int]]:
    """Links between different components of one shard: rows of the tree that do not ask go in first,
    the others ask before they go in."""
    if min(comp) == max(comp):
        return
    shard, of = Tree(), {}
    count: dict[int, int] = {}
    for c in comp:
        count[c] = count.get(c, 0) + 1
    top = max(count, key=count.__getitem__)
    mixed = [i for i in range(len(fp)) if not tree[i] or (ask[i] and comp[i] != top)]
    for i in range(len(fp)):
        if tree[i] and not (ask[i] and comp[i] != top):
            shard.add(fp[i])
            of[fp[i]] = comp[i]
    for i in mixed:
        met = {comp[i]}
        for y in shard.within(fp[i], radius):
            if of[y] not in met:
                met.add(of[y])
                yield fp[i], y
        if tree[i]:
            shard.add(fp[i])
            of[fp[i]] = comp[i]


def _trees(radius: int):
    """Runs of sorted rows (t, key, shard, fp, comp, tree, ask), each a shard and those that ask it."""
    key = ["t", "key", "shard"]

    def search(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = [rows.column(c).to_numpy() for c in key]
        new = np.any([c[1:] != c[:-1] for c in cols], axis=0)
        bounds = [0, *(np.flatnonzero(new) + 1).tolist(), len(rows)]
        fp, comp, tree, ask = (rows.column(c).to_pylist() for c in ("fp", "comp", "tree", "ask"))
        fp = [x & 0xFFFFFFFFFFFFFFFF for x in fp]
        found = [link for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1 for link in _run_links(fp[a:b], comp[a:b], tree[a:b], ask[a:b], radius)]
        if found:
            yield pa.record_batch([pa.array(np.array(x, U).view(np.int64)) for x in zip(*found, strict=True)], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(x.nbytes for x in held) > RUN_BYTES:  # all runs but the last are whole
                rows = pa.Table.from_batches(held)
                cols = [rows.column(c).to_numpy() for c in key]
                cut = int(np.flatnonzero(np.append(True, np.any([c[1:] != c[:-1] for c in cols], axis=0)))[-1])
                if cut:
                    yield from search(rows.slice(0, cut))
                held = rows.slice(cut).combine_chunks().to_batches()
        if held:
            yield from search(pa.Table.from_batches(held))

    return run


def _tree_links(s: st.Stages, prints: DataFrame, comps: DataFrame, tables: list[int], radius: int) -> DataFrame:
    """Links between different components, from the trees of all buckets."""
    labelled = s.keep(prints.select("fp").join(comps.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("comp", "fp").alias("comp")), "labelled")
    rows = labelled.select("fp", "comp", _buckets(tables).alias("at")).select("at.t", "at.key", "fp", "comp")
    kinds = rows.groupBy("t", "key", "comp").agg(F.count("*").alias("c")).groupBy("t", "key")
    large = s.keep(kinds.agg(F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("most"), F.count("*").alias("kinds")).where(f"m > {SHARD}").selectExpr("t", "key", "most.comp top", f"cast(ceil(m / {SHARD}) as int) shards", "kinds"), "large")
    whole = rows.join(large, ["t", "key"], "left_anti").selectExpr("t", "key", "0 shard", "fp", "comp", "true tree", "true ask")
    cut = rows.join(large.where("kinds > 1"), ["t", "key"]).withColumn("own", F.expr("cast(pmod(xxhash64(fp), shards) as int)"))
    trees = cut.selectExpr("t", "key", "own shard", "fp", "comp", "true tree", "false ask")
    asks = cut.where("comp <> top").select("t", "key", F.explode(F.expr("sequence(0, shards - 1)")).alias("shard"), "fp", "comp", F.lit(False).alias("tree"), F.lit(True).alias("ask"))
    every = whole.union(trees).union(asks).repartition(st.tasks(prints.sparkSession), "t", "key", "shard").sortWithinPartitions("t", "key", "shard", F.desc("tree"))
    return s.keep(every.mapInArrow(_trees(radius), "a long, b long").distinct(), "tree-links")


def simhash_dedup(docs: DataFrame, k: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs; see the module's text."""
    spark = docs.sparkSession
    s = st.Stages(spark, "simhash")
    own = s.keep(st.documents(docs, id_col, text_col).mapInArrow(_rows(k), "doc_id long, fp long"), "own")
    prints = s.keep(own.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "prints")
    n, total = prints.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    tables = masks(n, radius)
    rows = prints.select("fp", _buckets(tables).alias("at")).select("at.t", "at.key", "fp")
    chains = rows.repartitionByRange(st.tasks(spark), "t", "key", "fp").sortWithinPartitions("t", "key", "fp").mapInArrow(_chain(radius), "a long, b long")
    comps = s.keep(st.components(s, s.keep(chains.distinct(), "chains"), "first"), "comps-1")
    comps = st.contract(s, comps, _tree_links(s, prints, comps, tables, radius), "comps-2")
    named = prints.join(comps.withColumnRenamed("node", "fp"), "fp", "left").withColumn("comp", F.coalesce("comp", "fp"))
    least = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = s.keep(named.join(least, "comp").select("fp", "component_id", (F.col("n") * HOT >= total).alias("hot")), "named")
    s.drop("prints", "chains", "labelled", "large", "tree-links", "comps-1", "comps-2")
    hot = F.broadcast(named.where("hot").select("fp", "component_id"))  # HOT rows at most
    out = own.join(hot, "fp").union(own.join(hot, "fp", "left_anti").join(named.where("NOT hot").select("fp", "component_id"), "fp"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
