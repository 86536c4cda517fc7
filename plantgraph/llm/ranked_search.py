"""Ranked lexical search over a bit-sliced impact index.

Every document is ranked for every item by ``sum of w * ((10^9 tf) div (1000 tf + 8 m))`` over the
item's distinct terms, with the document's length in m and a term's rarity in w (see ``ORACLE`` for
the whole formula). Integers throughout, so any order of addition gives the same score.

1. **Postings.** One scan of all texts writes, for each document, its number of terms and the
   frequencies of those terms that any item asks for. From that table come the number of documents,
   their total length and the terms' document frequencies, counted over all rows.
2. **Index.** A task takes its documents in blocks of ``BLOCK`` at most. A term's impacts in a block,
   w times its weight in each document, are cut into bit slices: slice b is the bitmap of the
   documents whose impact has bit b.
3. **Addition.** An item's scores are the sum of its terms' slices by bitwise carry arithmetic: a
   ripple of XOR and AND from the least slice up, for 64 documents a machine word and for all items
   that hold the term at once. A rare term touches only the words of the bitmaps it occurs in.
4. **Top k.** The k best of a block are found by descending from the most significant slice: of the
   documents still level, those with the bit go ahead if they fit into the k places, and otherwise
   only they remain. Documents level to the last bit are taken by ascending doc_id.
5. **Merge.** The best k of all blocks' best k, by a window that is limited before it is shuffled.

Nothing is approximate. Queries reach the blocks in chunks of ``CHUNK`` distinct terms (an item that
has more is a chunk of its own), one pass over the postings each, so no task and not the driver
ever holds all items of a large table; what is sent is bounded by the chunk. Terms are told apart by
64-bit fingerprints.

Null or wordless documents are not counted and never ranked; null or wordless items have no rows.
Each row of documents is a document of its own, also where ids repeat; rows without an id rank after
all others of the same score. Each row of items is an item of its own, also where ids repeat. An
empty table on either side gives an empty result. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import stages as st
from . import text as tx

#: documents in one block of the index
BLOCK = 1 << 16
#: distinct terms of the items that one pass answers
CHUNK = 1 << 17
#: items whose sums are held at once
ITEMS = 64
U = np.uint64
NONE = np.iinfo(np.int64).max


def _terms(s: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
    """(term of each word, word bounds of documents) of a slice."""
    words = tx.Words(s, tx.NOT_ALNUM, lower=True)
    return words.hashes(), words.first


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item, item_id, term), each distinct term of an item once."""
    for batch in batches:
        for s in tx.slices(batch.column(2)):
            h, first = _terms(s)
            item = np.repeat(np.arange(len(s)), np.diff(first))
            order = np.lexsort((h, item))
            h, item = h[order], item[order]
            new = np.append(True, (h[1:] != h[:-1]) | (item[1:] != item[:-1]))[: len(h)]
            at = pa.array(s.first + item[new])
            yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(h[new].view(np.int64))], names=["item", "item_id", "term"])


def _postings(wanted: np.ndarray):
    """(doc_id, n, at, tf) of each document with a term: positions among the sorted wanted terms and
    their frequencies, as int32 arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in tx.slices(batch.column(1)):
                h, first = _terms(s)
                at = np.searchsorted(wanted, h)
                at[at == len(wanted)] = 0
                hit = np.flatnonzero(wanted[at] == h) if len(wanted) else np.zeros(0, np.int64)
                n = np.diff(first)
                doc = np.repeat(np.arange(len(n)), n)[hit]
                pair, tf = np.unique(doc * max(1, len(wanted)) + at[hit], return_counts=True)
                doc, at = np.divmod(pair, max(1, len(wanted)))
                bounds = np.searchsorted(doc, np.arange(len(n) + 1))
                rows = np.flatnonzero(n)
                at, tf = at.astype(np.int32), tf.astype(np.int32)
                ids = batch.column(0).slice(s.first, len(s)).take(pa.array(rows))
                parts = [tx.binary([x[bounds[i] : bounds[i + 1]].tobytes() for i in rows]) for x in (at, tf)]
                yield pa.record_batch([ids, pa.array(n[rows].astype(np.int64)), *parts], names=["doc_id", "n", "at", "tf"])

    return run


def _document_frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, n): how many of a task's documents hold each term."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.int32)
        own = np.bincount(flat, minlength=len(total))
        own[: len(total)] += total
        total = own
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at), pa.array(total[at])], names=["at", "n"])


# -- bit slices ----------------------------------------------------------------------------------
def slices_of(pos: np.ndarray, value: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(words, slices): the machine words that ascending positions fall into, and for each bit the
    bitmap of the positions whose value has it, in those words."""
    word = pos >> 6
    new = np.append(True, word[1:] != word[:-1])
    begin = np.flatnonzero(new)
    lane = U(1) << (pos & 63).astype(U)
    planes = np.where((value >> np.arange(bits)[:, None]) & 1, lane, U(0))
    return word[begin], np.bitwise_or.reduceat(planes, begin, axis=1)


def add(total: np.ndarray, which: np.ndarray, words: np.ndarray, planes: np.ndarray) -> None:
    """Adds a term's slices to the sums (item, bit, word) of some items, by ripple carry."""
    carry = np.zeros((len(which), len(words)), U)
    rows = which[:, None]
    for b in range(total.shape[1]):
        if b >= len(planes) and not carry.any():
            break
        x = total[rows, b, words]
        if b < len(planes):
            y = planes[b]
            half = x ^ y
            total[rows, b, words] = half ^ carry
            carry = (x & y) | (half & carry)
        else:
            total[rows, b, words] = x ^ carry
            carry &= x


def leaders(total: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sure, level) bitmaps of each item: documents certainly among the k best, and those level with
    the last of them, of which the remaining places are filled. Documents of score 0 are in neither."""
    sure = np.zeros((len(total), total.shape[2]), U)
    level = np.bitwise_or.reduce(total, axis=1)
    for b in range(total.shape[1] - 1, -1, -1):
        ahead = level & total[:, b]
        fits = (np.bitwise_count(sure | ahead).sum(1, dtype=np.int64) <= k)[:, None]
        sure = np.where(fits, sure | ahead, sure)
        level = np.where(fits, level & ~ahead, ahead)
    return sure, level


def _set_bits(bitmap: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.unpackbits(bitmap.view(np.uint8), bitorder="little"))


def _block(ids: np.ndarray, n: np.ndarray, doc: np.ndarray, at: np.ndarray, tf: np.ndarray, q: dict, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(item number, doc_id, score) of the k best documents of a block for each item."""
    keep = q["weight"][at] > 0
    doc, at, tf = doc[keep], at[keep], tf[keep].astype(np.int64)
    m = 10 + (90 * n * q["documents"]) // q["length"]
    value = q["weight"][at] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
    order = np.argsort(at, kind="stable")
    doc, at, value = doc[order], at[order], value[order]
    begin = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else np.zeros(0, np.int64)
    bounds = np.append(begin, len(at))
    words = (len(n) + 63) // 64
    for low in range(0, q["items"], ITEMS):
        high = min(low + ITEMS, q["items"])
        total = np.zeros((high - low, q["bits"], words), U)
        for i, term in enumerate(at[begin].tolist()):
            own = q["of_term"][q["first"][term] : q["first"][term + 1]]
            own = own[np.searchsorted(own, low) : np.searchsorted(own, high)]
            if len(own):
                part = slice(bounds[i], bounds[i + 1])
                most = int(value[part].max()).bit_length()
                add(total, own - low, *slices_of(doc[part], value[part], most))
        sure, level = leaders(total, k)
        for i in range(high - low):
            first = _set_bits(sure[i])
            rest = _set_bits(level[i])
            rest = rest[np.argsort(ids[rest], kind="stable")][: k - len(first)]
            best = np.concatenate([first, rest])
            bit = (total[i][:, best >> 6] >> (best & 63).astype(U)) & U(1)
            score = (bit << np.arange(q["bits"], dtype=U)[:, None]).sum(0, dtype=U).astype(np.int64)
            yield np.full(len(best), low + i), ids[best], score


def _search(q: dict, k: int):
    """(item number, doc_id, score) of the best documents of each block of a task."""

    def answer(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(held)
        ids = rows.column("doc_id").fill_null(NONE).to_numpy()
        lists = [rows.column(c).to_pylist() for c in ("at", "tf")]
        at, tf = (np.frombuffer(b"".join(x), np.int32) for x in lists)
        doc = np.repeat(np.arange(len(rows)), [len(x) // 4 for x in lists[0]])
        found = list(_block(ids, rows.column("n").to_numpy(), doc, at, tf, q, k))
        if found:
            item, best, score = (np.concatenate(x) for x in zip(*found, strict=True))
            yield pa.record_batch([pa.array(item), pa.array(best), pa.array(score)], names=["number", "doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            while len(batch):
                part = batch.slice(0, BLOCK - size)
                batch = batch.slice(len(part))
                held.append(part)
                size += len(part)
                if size == BLOCK:
                    yield from answer(held)
                    held, size = [], 0
        if held:
            yield from answer(held)

    return run


def _queries(rows: list, df: dict[int, int], documents: int, length: int) -> dict:
    """What a chunk's items ask for, as arrays: for each wanted term its weight and its items."""
    wanted = np.unique(np.array([r.term for r in rows], np.int64).view(U))
    number = {item: i for i, item in enumerate(sorted({r.item for r in rows}))}
    at = np.searchsorted(wanted, np.array([r.term for r in rows], np.int64).view(U))
    item = np.array([number[r.item] for r in rows], np.int64)
    order = np.lexsort((item, at))
    seen = np.array([df.get(i, 0) for i in range(len(wanted))], np.int64)
    weight = np.floor(1000 * np.log((2 * documents + 2) / (2 * seen + 1))).astype(np.int64)
    weight[seen == 0] = 0  # no document holds it
    most = int(np.bincount(item, weights=weight[at].astype(float), minlength=1).max()) * 1_000_000
    return {"first": np.searchsorted(at[order], np.arange(len(wanted) + 1)), "of_term": item[order], "weight": weight, "items": len(number), "bits": max(1, most.bit_length() + 1), "documents": documents, "length": length}


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item; see the module's text."""
    spark = docs.sparkSession
    s = st.Stages(spark, "search")
    named = items.select(F.monotonically_increasing_id().alias("item"), F.col(item_col).alias("item_id"), F.col(text_col).cast("string").alias("text"))
    kind = named.schema["item_id"].dataType.simpleString()
    asked = s.keep(named.mapInArrow(_item_terms, f"item long, item_id {kind}, term long"), "asked")
    chunks = max(1, -(-asked.count() // CHUNK))
    asked = asked.withColumn("chunk", F.expr(f"pmod(xxhash64(item), {chunks})"))
    best = None
    for chunk in range(chunks):
        rows = asked.where(F.col("chunk") == chunk).select("item", "term").collect()  # about CHUNK terms
        if not rows:
            continue
        wanted = np.unique(np.array([r.term for r in rows], np.int64).view(U))
        made = st.documents(docs, id_col, text_col).mapInArrow(_postings(wanted), "doc_id long, n long, at binary, tf binary")
        postings = s.keep(made, f"postings-{chunk}")
        documents, length = postings.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(1))).first()
        df = {r["at"]: r.n for r in postings.select("at").mapInArrow(_document_frequency, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()}  # a row a wanted term
        q = _queries(rows, df, documents, length)
        number = sorted({r.item for r in rows})
        names = spark.createDataFrame(pa.table({"number": pa.array(range(len(number)), pa.int64()), "item": pa.array(number, pa.int64())}))
        found = postings.mapInArrow(_search(q, k), "number long, doc_id long, score long").join(F.broadcast(names), "number").select("item", "doc_id", "score")
        found = s.keep(found, f"best-{chunk}")
        s.drop(f"postings-{chunk}")
        best = found if best is None else best.union(found)
    if best is None:
        best = spark.createDataFrame([], "item long, doc_id long, score long")
    place = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    top = best.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
    ids = asked.select("item", "item_id").distinct()
    return top.join(ids, "item").select("item_id", F.col("rank").cast("int").alias("rank"), F.expr(f"nullif(doc_id, {NONE}L)").alias("doc_id"), "score")


ORACLE = r"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM d), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
len AS (SELECT doc_id, count(*) AS n FROM t GROUP BY 1), z AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM len),
df AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
s AS (SELECT i.item_id, c.doc_id, CAST(sum(CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / (2 * df.df + 1))) AS BIGINT) * ((1000000000 * c.tf) // (1000 * c.tf + 8 * (10 + (90 * len.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM i JOIN c ON c.term = i.term JOIN df ON df.term = i.term JOIN len ON len.doc_id = c.doc_id CROSS JOIN z GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
