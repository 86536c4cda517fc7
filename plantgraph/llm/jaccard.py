"""N-gram Jaccard join: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

Two documents link when ``100 * |A & B| >= percent * |A | B|`` over their sets of k-word shingles
(64-bit fingerprints). The join is exact; no candidate is capped.

1. **Sets.** One scan turns each text into its sorted shingle set. Documents with equal sets are
   one node from here on (``sid``, a fingerprint of the set), so copies are never paired.
2. **Size-banded tiles.** Sizes fall into geometric bands. A pair in a band differs in at most
   ``d`` shingles, so if the hash range is cut into more than ``d`` pieces, the two sets agree on a
   whole piece: a tile is (band, piece, fingerprint of the piece's shingles). A set also visits every
   higher band that a partner can be in. Sets so unevenly spread that agreeing pieces might all
   be empty add prefix tiles, which cover such pairs exactly. Unlike single shared shingles, tiles
   do not fill up with documents that merely share a passage. A tile of which one slice of text
   holds more than ``LOCAL`` sets sends only its least set there; the others are paired with that one
   and dealt out by it, so a tile that a third of all sets share never meets in one task.
3. **Leaders.** Every set is checked against the least sid of any of its tiles: one pair per set.
   The links found give components; leaders of a set's other tiles are tried only where they lie in
   another component, and those links connect whole components.
4. **Rest.** Of tiles that still hold several components, the sets of the commonest one meet those of
   the others, and the others each other, in blocks of about ``BLOCK`` sets; pairs of different
   components are screened by bitmaps. Each set brings the least ``HEAD`` of its tiles: a pair that has
   one of them in common is taken in the least such tile alone.
5. **Check.** Bits of A's bitmap missing in B's prove that many shingles of A are missing in B, which
   bounds the overlap from above; pairs that survive are decided by intersecting the sorted arrays. Of the
   rest, the ``TRIED`` closest pairs of a set in a block are decided first, and pairs that have come to lie in
   one component by then are left out: of near copies only pairs that could still connect something.

Null or wordless texts have the empty set and link with nothing; a text of fewer than k words has
one shingle, its whole sequence. Ids are cast to long; a row that repeats an id or has none appears
in the result like any other, with the component of its set; a set that only rows without an id
hold links with nothing. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stages as st
from . import text as tx

BAND = 1.6
BLOCK = 512
LOCAL = 8
HEAD = 8
TRIED = 4
SEEN = 1_000_000
CHUNK = 32 << 20
U = np.uint64


def _bands(limit: int = 1 << 40) -> np.ndarray:
    edges, x = [1], 1.0
    while edges[-1] < limit:
        x *= BAND
        if int(np.ceil(x)) > edges[-1]:
            edges.append(int(np.ceil(x)))
    return np.array(edges, np.int64)


EDGES = _bands()


def _pieces(percent: int) -> tuple[np.ndarray, np.ndarray]:
    """For each band: the most shingles in which a pair can differ, and the number of pieces."""
    high = EDGES[1:] - 1
    differ = 2 * high * (100 - percent) // (100 + percent)
    return differ, np.where(differ > 0, differ + 1 + (differ * 6 + 99) // 100, 0)


class Sets:
    """Sorted distinct shingles of a slice's documents: ``u`` with bounds ``first``."""

    def __init__(self, s: tx.Slice, k: int):
        words = tx.Words(s, tx.SPACE, lower=True)
        h = words.hashes()
        n = np.diff(words.first)
        full = tx.shingle_hashes(h, k)
        whole = np.flatnonzero((n > 0) & (n < k))
        counts = np.where(n >= k, n - k + 1, (n > 0).astype(np.int64))
        bounds = np.concatenate([[0], np.cumsum(counts)])
        u = np.zeros(bounds[-1], U)
        if len(full):
            u[np.repeat(n >= k, counts)] = full[tx.starts_within(words.first, k, len(h))[: len(full)]]
        for i in whole:
            own = h[words.first[i] : words.first[i + 1]]
            u[bounds[i]] = tx.shingle_hashes(own, len(own))[0] ^ U(len(own) * 0x51ED27)
        for i in range(len(n)):
            u[bounds[i] : bounds[i + 1]].sort()
        new = np.ones(len(u), bool)
        new[1:] = u[1:] != u[:-1]
        new[bounds[:-1][counts > 0]] = True
        self.u = u[new]
        self.first = np.concatenate([[0], np.cumsum(new)])[bounds]
        self.size = np.diff(self.first)

    def ids(self) -> np.ndarray:
        """Fingerprint of each set; 0 for the empty one."""
        total = np.concatenate([np.zeros(1, U), np.cumsum(tx.mix(self.u ^ U(0x5851F42D4C957F2D)))])
        out = tx.mix((total[self.first[1:]] - total[self.first[:-1]]) ^ self.size.astype(U) * U(0x2545F4914F6CDD1D))
        out[self.size == 0] = 0
        return out


def _tiles(sets: Sets, sid: np.ndarray, pick: np.ndarray, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(tile, sid) arrays for the picked documents, in their own band and in those of larger partners."""
    differ, pieces = _pieces(percent)
    home = np.searchsorted(EDGES, np.maximum(sets.size, 1), "right") - 1
    reach = np.searchsorted(EDGES, np.maximum(100 * sets.size // percent, 1), "right") - 1
    for step in range(int((reach - home).max(initial=0)) + 1):
        band = home + step
        docs = np.flatnonzero(pick & (sets.size > 0) & (band <= reach) & (pieces[band] > 0))
        if not len(docs):
            continue
        size, k = sets.size[docs], pieces[band[docs]]
        at = np.repeat(sets.first[docs] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        u, doc = sets.u[at], np.repeat(np.arange(len(docs)), size)
        piece = ((u >> U(32)) * np.repeat(k.astype(U), size)) >> U(32)
        new = np.ones(len(u), bool)
        new[1:] = (piece[1:] != piece[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        total = np.add.reduceat(tx.mix(u), begin)
        owner = doc[begin]
        salt = (band[docs][owner].astype(U) << U(40)) ^ piece[begin]
        yield tx.mix(total ^ tx.mix(salt)), sid[docs][owner]
        lacking = k - np.bincount(owner, minlength=len(docs))
        for i in np.flatnonzero(lacking >= k - differ[band[docs]]):
            own = sets.u[sets.first[docs[i]] : sets.first[docs[i] + 1]]
            prefix = own[: len(own) - (percent * len(own) + 99) // 100 + 1]
            yield tx.mix(prefix ^ tx.mix(np.array([(int(band[docs[i]]) << 8) | 0xF1], U))), np.full(len(prefix), sid[docs[i]])


def _local(tile: np.ndarray, sid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(tile, salt, sid) of a slice: in tiles of many sets, salt is the least of them for all, and
    that one goes on under salt 0 too; elsewhere salt is 0."""
    order = np.argsort(tile)
    tile, sid = tile[order], sid[order].view(np.int64)
    begin = np.flatnonzero(np.append(True, tile[1:] != tile[:-1]))
    count = np.diff(np.append(begin, len(tile)))
    least = np.minimum.reduceat(sid, begin)
    many = count > LOCAL
    salt = np.where(np.repeat(many, count), np.repeat(least, count), 0)
    return np.concatenate([tile, tile[begin[many]]]), np.concatenate([salt, np.zeros(many.sum(), np.int64)]), np.concatenate([sid, least[many]])


def _own(k: int, carry: list[str]):
    """(doc_id, n, sid) of every document, and what is carried along."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tx.slices(batch.column(1)):
                sets = Sets(s, k)
                more = [batch.column(2 + i).slice(s.first, len(s)) for i in range(len(carry))]
                yield pa.record_batch([batch.column(0).slice(s.first, len(s)), pa.array(sets.size.astype(np.int64)), pa.array(sets.ids().view(np.int64)), *more], names=["doc_id", "n", "sid", *carry])

    return run


def _tile_rows(k: int, percent: int):
    """(tile, salt, sid) of every set; a task forgets which it has met after ``SEEN`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for s in tx.slices(batch.column(0)):
                sets = Sets(s, k)
                sid = sets.ids()
                pick = np.zeros(len(s), bool)
                for i, x in enumerate(sid.tolist()):
                    if x not in seen:
                        seen.add(x)
                        pick[i] = True
                if len(seen) > SEEN:
                    seen.clear()
                found = list(_tiles(sets, sid, pick, percent))
                if found:
                    tile, salt, of = _local(np.concatenate([t for t, _ in found]), np.concatenate([x for _, x in found]))
                    for a in range(0, len(tile), 200_000):
                        part = slice(a, a + 200_000)
                        yield pa.record_batch([pa.array(tile[part].view(np.int64)), pa.array(salt[part]), pa.array(of[part])], names=["tile", "salt", "sid"])

    return run


def _bits(size: int) -> int:
    """Bits of a set's bitmap: a power of two of at least twice its size. Unrelated sets still miss half of
    each other's bits, far beyond what any similarity asked for allows."""
    return max(256, 1 << int(2 * size - 1).bit_length())


def _bitmap(u: np.ndarray) -> bytes:
    m = _bits(len(u))
    flags = np.zeros(m, np.uint8)
    flags[(u & U(m - 1)).astype(np.int64)] = 1
    return np.packbits(flags, bitorder="little").tobytes()


def _common(bits: pa.Array, n: tuple[np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray, other: pa.Array | None = None) -> np.ndarray:
    """The most shingles that rows a and b can have in common. A longer bitmap is folded to the shorter
    one's length: positions are hashes modulo a power of two."""
    other = bits if other is None else other
    raw, length = zip(*((x, np.diff(np.frombuffer(x.buffers()[1], np.int32)[x.offset : x.offset + len(x) + 1])) for x in (bits, other)), strict=True)
    out = np.zeros(len(a), np.int64)
    kinds = length[0][a].astype(np.int64) << 32 | length[1][b]
    for kind in np.unique(kinds):
        la, lb = int(kind >> 32), int(kind & 0xFFFFFFFF)
        at = np.flatnonzero(kinds == kind)
        w = min(la, lb) // 8
        for part in np.array_split(at, max(1, -(-len(at) * max(la, lb) // CHUNK))):
            x, y = (_rows(c, i[part], size).reshape(len(part), -1, w) for c, i, size in ((raw[0], a, la), (raw[1], b, lb)))
            x, y = np.bitwise_or.reduce(x, 1), np.bitwise_or.reduce(y, 1)
            na, nb = n[0][a[part]], n[1][b[part]]
            out[part] = np.minimum(na - np.bitwise_count(x & ~y).sum(1, dtype=np.int64), nb - np.bitwise_count(y & ~x).sum(1, dtype=np.int64))
    return out


def _rows(column: pa.Array, at: np.ndarray, size: int) -> np.ndarray:
    """The values of ``size`` bytes at these rows, as 64-bit words."""
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column)]
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offs[at][:, None] + np.arange(size)].view(U)


def _arrays(k: int):
    """(sid, n, bitmap, sorted shingles) of each document whose set is the one asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(1).to_numpy(zero_copy_only=False)
            for s in tx.slices(batch.column(0)):
                sets = Sets(s, k)
                sid = sets.ids().view(np.int64)
                at = np.flatnonzero(sid == asked[s.first : s.first + len(s)])
                own = [sets.u[sets.first[i] : sets.first[i + 1]] for i in at]
                yield pa.record_batch([pa.array(sid[at]), pa.array(sets.size[at].astype(np.int64)), tx.binary([_bitmap(u) for u in own]), tx.binary([u.tobytes() for u in own])], names=["sid", "n", "bits", "u"])

    return run


def _screen(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.arange(len(batch))
            n = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            both = _common(batch.column("x"), n, at, at, batch.column("y"))
            yield batch.select(["a", "b"]).filter(pa.array(100 * both >= percent * (n[0] + n[1] - both)))

    return run


def _decide(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                if len(x) > len(y):
                    x, y = y, x
                at = np.searchsorted(y, x)
                at[at == len(y)] = 0
                both = int((y[at] == x).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _links(s: st.Stages, name: str, pairs: DataFrame, sets: DataFrame, percent: int, screened: bool = False) -> DataFrame:
    """The pairs (a, b) that link: screened by bitmaps first, so arrays move for the survivors only."""
    if not screened:
        small = sets.select("sid", "n", "bits")
        left = pairs.join(small.select(F.col("sid").alias("a"), F.col("n").alias("na"), F.col("bits").alias("x")), "a")
        both = left.join(small.select(F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("y")), "b")
        both = both.where(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")
        pairs = s.keep(both.select("a", "b", "na", "nb", "x", "y").mapInArrow(_screen(percent), "a long, b long"), f"{name}-screened")
    # pairs are far fewer than sets, as a rule: only the arrays that they ask for move
    asked = sets.select("sid", "u").join(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), "sid", "left_semi")
    left = pairs.select("a", "b").join(asked.select(F.col("sid").alias("a"), F.col("u").alias("x")), "a")
    both = left.join(asked.select(F.col("sid").alias("b"), F.col("u").alias("y")), "b")
    return s.keep(both.select("a", "b", "x", "y").mapInArrow(_decide(percent), "a long, b long"), f"{name}-links")


def _connected(s: st.Stages, comps: DataFrame, found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The components after all links among the pairs found (a, b, best). Each set's best pairs are decided
    first; of the others, those that lie in one component by then need not be decided any more."""
    comps = st.contract(s, comps, _links(s, "best", found.where("best"), sets, percent, screened=True), "comps-3")
    label = (comps.select(F.col("node").alias(x), F.col("comp").alias(f"c{x}")) for x in "ab")
    apart = found.where("NOT best").join(next(label), "a", "left").join(next(label), "b", "left").where("coalesce(ca, a) <> coalesce(cb, b)")
    apart = s.keep(apart.select("a", "b"), "apart")
    return st.contract(s, comps, _links(s, "rest", apart, sets, percent, screened=True), "comps-4")


def _pairs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows with an equal group number (ascending), some groups of one size at a time."""
    begin = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    size = np.diff(np.append(begin, len(group)))
    for g in np.unique(size[size > 1]).tolist():
        x, y = np.triu_indices(g, 1)
        at = begin[size == g]
        for part in np.array_split(at, max(1, -(-len(at) * len(x) // 200_000))):
            yield (part[:, None] + x).ravel(), (part[:, None] + y).ravel()


def _blocks(percent: int):
    """Screens pairs of different components in each run of rows with one (tile, kind, i, j): in
    kind 1 pairs of different sides, in kind 2 those too where i < j."""
    key = ["tile", "kind", "i", "j"]

    def screen(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        cols = {c: rows.column(c).to_numpy() for c in (*key, "sid", "comp", "n", "side")}
        new = np.any([cols[c][1:] != cols[c][:-1] for c in key], axis=0)
        bits = rows.column("bits").combine_chunks()
        cross = (cols["kind"] == 1) | (cols["i"] < cols["j"])
        heads = np.full((len(rows), HEAD), np.iinfo(np.int64).max)  # no tile is less than the padding
        lists = rows.column("heads").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        heads[np.repeat(np.arange(len(rows)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = lists.flatten().to_numpy()
        for a, b in _pairs(np.append(0, np.cumsum(new))):
            n = cols["n"]
            may = (cols["comp"][a] != cols["comp"][b]) & (~cross[a] | (cols["side"][a] != cols["side"][b]))
            may &= 100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])
            a, b = a[may], b[may]
            first = ~((heads[a][:, :, None] == heads[b][:, None, :]) & (heads[a] < cols["tile"][a][:, None])[:, :, None]).any((1, 2))
            a, b = a[first], b[first]
            x, y = np.minimum(cols["sid"][a], cols["sid"][b]), np.maximum(cols["sid"][a], cols["sid"][b])
            if len(x):
                _, one = np.unique(np.stack([x, y], 1), axis=0, return_index=True)
                both = _common(bits, (n, n), a[one], b[one])
                every = n[a[one]] + n[b[one]] - both
                ok = 100 * both >= percent * every
                one, share = one[ok], both[ok] / every[ok]
                of = np.where(cols["sid"][a[one]] == y[one], a[one], b[one])  # the row of the greater set
                order = np.lexsort((-share, of))
                begin = np.flatnonzero(np.append(True, of[order][1:] != of[order][:-1]))
                best = np.zeros(len(one), bool)
                best[order] = np.arange(len(one)) - np.repeat(begin, np.diff(np.append(begin, len(one)))) < TRIED if len(one) else False
                yield pa.record_batch([pa.array(x[one]), pa.array(y[one]), pa.array(best)], names=["a", "b", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            size += batch.nbytes
            if size > CHUNK:  # all runs but the last are whole
                rows = pa.Table.from_batches(held).combine_chunks()
                last = [rows.column(c).to_numpy() for c in key]
                cut = int(np.flatnonzero(np.append(True, np.any([x[1:] != x[:-1] for x in last], axis=0)))[-1])
                yield from screen(rows.slice(0, cut).combine_chunks())
                held = pa.Table.from_batches(rows.slice(cut).to_batches()).combine_chunks().to_batches()
                size = sum(x.nbytes for x in held)
        if held:
            yield from screen(pa.Table.from_batches(held).combine_chunks())

    return run


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_shingles, component_id, component_key) of every row of docs, and its columns ``carry``;
    component_id is the least doc_id reachable by links, component_key tells components apart where
    rows share ids (null for the empty set). See the module's text for the method and for nulls, short
    texts and ties."""
    spark = docs.sparkSession
    s = st.Stages(spark, "jaccard")
    plain = st.documents(docs, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"), *carry)
    kinds = ", ".join(["doc_id long, n long, sid long", *(f"`{c}` {t}" for c, t in rows.dtypes[2:])])
    own = s.keep(rows.mapInArrow(_own(k, list(carry)), kinds), "own")
    tiles = plain.select("_text").mapInArrow(_tile_rows(k, percent), "tile long, salt long, sid long").repartition(st.tasks(spark), "tile", "salt")
    shared = tiles.selectExpr("tile", "salt", "sid", "min(sid) OVER (PARTITION BY tile, salt) lo", "max(sid) OVER (PARTITION BY tile, salt) hi").where("lo <> hi")
    shared = s.keep(shared.select("tile", "salt", "sid", "lo").distinct(), "shared")
    reps = own.join(shared.select("sid").distinct(), "sid", "left_semi").groupBy("sid").agg(F.min("doc_id").alias("_id")).where("_id IS NOT NULL")
    sets = plain.join(reps, "_id").select("_text", "sid").mapInArrow(_arrays(k), "sid long, n long, bits binary, u binary")
    sets = s.keep(sets.groupBy("sid").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("u").alias("u")), "sets")
    pairs = shared.where("sid <> lo").groupBy("sid").agg(F.min("lo").alias("a")).select("a", F.col("sid").alias("b"))
    links = _links(s, "first", pairs, sets, percent)
    comps = s.keep(st.components(s, links, "first"), "comps-1")
    # leaders of other tiles, where they lie in another component
    label = comps.select(F.col("node").alias("sid"), "comp"), comps.select(F.col("node").alias("lo"), F.col("comp").alias("top"))
    pairs = shared.where("sid <> lo").select("lo", "sid").distinct().join(label[0], "sid", "left").join(label[1], "lo", "left")
    pairs = pairs.where("coalesce(comp, sid) <> coalesce(top, lo)").select(F.col("lo").alias("a"), F.col("sid").alias("b"))
    comps = st.contract(s, comps, _links(s, "more", pairs, sets, percent), "comps-2")
    # tiles whose sets are not all connected yet
    labelled = shared.select("tile", "sid").join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    labelled = s.keep(labelled, "labelled")
    s.drop("shared")
    mixed = labelled.groupBy("tile", "comp").agg(F.count("*").alias("c")).groupBy("tile").agg(F.count("*").alias("kinds"), F.sum("c").alias("m"), F.max(F.struct("c", "comp")).alias("most")).where("kinds > 1")
    mixed = s.keep(mixed.selectExpr("tile", "most.comp top", f"m <= {BLOCK} whole", f"cast(ceil(most.c / {BLOCK}) as int) pt", f"cast(ceil((m - most.c) / {BLOCK}) as int) po"), "mixed")
    rest = labelled.join(mixed, "tile").withColumn("is_top", F.expr("comp = top")).withColumn("part", F.expr("cast(pmod(xxhash64(sid), CASE WHEN is_top THEN pt ELSE po END) as int)"))
    rest = rest.withColumn("b", F.explode(F.expr("""CASE WHEN whole THEN array(struct(0 kind, 0 i, 0 j))
        WHEN is_top THEN transform(sequence(0, po - 1), x -> struct(1 kind, part i, x j))
        ELSE concat(transform(sequence(0, pt - 1), x -> struct(1 kind, x i, part j)), transform(sequence(0, po - 1), x -> struct(2 kind, least(part, x) i, greatest(part, x) j))) END""")))
    rest = rest.selectExpr("tile", "b.kind", "b.i", "b.j", "sid", "comp", "CASE WHEN b.kind = 1 THEN cast(is_top as int) ELSE part END side")
    heads = labelled.join(mixed.select("tile"), "tile", "left_semi").groupBy("sid").agg(F.slice(F.array_sort(F.collect_set("tile")), 1, HEAD).alias("heads"))
    rest = rest.join(heads, "sid").join(sets.select("sid", "n", "bits"), "sid").select("tile", "kind", "i", "j", "sid", "comp", "n", "bits", "side", "heads")
    rest = rest.repartition(st.tasks(spark), "tile", "kind", "i", "j").sortWithinPartitions("tile", "kind", "i", "j")
    found = rest.mapInArrow(_blocks(percent), "a long, b long, best boolean").groupBy("a", "b").agg(F.max("best").alias("best"))
    found = s.keep(found, "found")
    s.drop("labelled", "mixed")
    comps = _connected(s, comps, found, sets, percent)
    s.drop("sets", "found", "first-screened", "more-screened")
    named = own.join(comps.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.expr("CASE WHEN n > 0 THEN coalesce(comp, sid) END"))
    named = s.keep(named, "named")
    s.drop("own")
    least = s.keep(named.where("n > 0").groupBy("comp").agg(F.min("doc_id").alias("least")), "least")
    out = named.where("n > 0").join(least, "comp", "left").select("doc_id", "n", "least", "comp", *carry).union(named.where("n = 0").select("doc_id", "n", F.lit(None).cast("long"), "comp", *carry))
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"), F.col("comp").alias("component_key"), *carry)
