"""LM scoring with a weighted backoff automaton.

Tokens are words and one end token for each text. The unigram model is additively smoothed over all
training tokens: ``(c + 0.1) / (N + 0.1 * (V + 1))``, unknown words sharing the one extra place.
Bigrams and trigrams above it are smoothed with the model one order below as Dirichlet prior (MacKay
and Peto 1995): ``(c(h, w) + m * p(w)) / (n(h) + m)``. A history that was seen is a state: the empty
one, a word (or the begin of a text), a pair of words. An n-gram is an arc from its history with its
log-probability, to the state of its longest suffix that is one; a state's failure arc carries its
backoff weight ``m / (n(h) + m)`` to the state of the shorter history. A text is read from left to
right, carrying a state: where the state has no arc for a token, failure arcs are followed and their
weights added. Texts of a block are advanced together, one token at a time; long ones in pieces, each
after a run-in of the two tokens before it, which settle its state.

All n-grams of the training texts are in the model, so it grows with the corpus and is never gathered
in one place. Blocks of documents are cut from the scan and written down as token numbers. Each block
asks for the counts of its own words and bigrams: sorted 64-bit fingerprints, packed and sent to the
shard of their range, which adds the blocks' counts up and answers in the same order. Trigrams follow
in a second pass, without those that hold a bigram which occurs nowhere else: their count is the
block's own. Each block then builds the part of the automaton that its own texts can reach. Shards
grow in number with the text; tasks are as many as the session's shuffle partitions.

A block sends at most ``FAN`` rows. Where there are more shards than that, ranges are cut into
shards in levels: a wide range's requests are bundled, as many blocks a bundle as there are ranges, so
that a bundle holds no more than a block did; their keys are merged, their counts added, and the bundle
asks the narrower ranges as a block would. Answers go back the same way, split again by what each asked.
Rows therefore grow with the blocks times the levels, the logarithm of the text to the base ``FAN``.

Null and empty texts have the end token alone. Rows are scored one by one; ids may repeat; a row
without an id counts as held out. An empty table gives an empty result. Words and n-grams are told
apart by 64-bit fingerprints; a chance collision adds two counts together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stages as st
from . import text as tx

U = np.uint64
BLOCK_BYTES = 4 << 20
SHARD_BYTES = 16 << 20
#: the most ranges that a block, or a bundle of blocks, sends requests to
FAN = 1024
PIECE = 256
END = U(0x27BB2EE687B0B0FD)
BEGIN = U(0x51C64A3F9E07D2B5)
#: words of prior knowledge that a history of one and of two words has
PRIOR = {2: 100.0, 3: 10.0}
ADD = 0.1
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def _tokens(s: tx.Slice) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a slice, an end after each document's words, and tokens of each document."""
    words = tx.Words(s, tx.SPACE, lower=True)
    first = words.first + np.arange(len(words.first))
    out = np.full(first[-1], END)
    at = np.ones(len(out), bool)
    at[first[1:] - 1] = False
    out[at] = words.hashes()
    return out, np.diff(first)


def _pack(x: np.ndarray) -> bytes:
    """Numbers of 64 bits, bytes of equal weight together, so that small ones cost little."""
    return _ZIP.compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(_UNZIP.decompress(raw), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Fingerprint of a history and the token after it."""
    return tx.mix(a * tx._SHINGLE[0] + b * tx._SHINGLE[1])


BLOCK = "block long, ids array<long>, train binary, sizes binary, heads binary, tokens binary"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for about ``BLOCK_BYTES`` of text: distinct token hashes and the texts as their numbers."""
    made = 0
    ids, train, tokens, sizes, held = [], [], [], [], 0

    def out() -> pa.RecordBatch:
        heads, x = np.unique(np.concatenate(tokens), return_inverse=True)
        task = TaskContext.get()
        row = [[(task.partitionId() << 32) + made], [pa.concat_arrays(ids)], [np.concatenate(train).tobytes()], [_pack(np.concatenate(sizes))], [_pack(np.diff(heads, prepend=U(0)))], [_pack(x)]]
        kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.binary()] * 4]
        return pa.record_batch([pa.array([v.to_pylist() for v in c] if k == kinds[1] else c, k) for c, k in zip(row, kinds, strict=True)], names=["block", "ids", "train", "sizes", "heads", "tokens"])

    for batch in batches:
        for s in tx.slices(batch.column("text")):
            x, n = _tokens(s)
            own = batch.slice(s.first, len(s))
            ids.append(own.column("doc_id"))
            train.append(own.column("train").to_numpy(zero_copy_only=False).astype(bool))
            tokens.append(x)
            sizes.append(n.astype(np.int64))
            held += len(s.data)
            if held >= BLOCK_BYTES:
                yield out()
                made += 1
                ids, train, tokens, sizes, held = [], [], [], [], 0
    if ids:
        yield out()


class Block:
    """The tokens of a block's texts, as numbers into ``heads``, the sorted hashes; the begin of a text
    is one more. ``at2`` is the bigram that ends at each token, a number into the sorted ``keys2``."""

    def __init__(self, row: dict):
        self.ids = row["ids"]
        self.train = np.frombuffer(row["train"], bool)
        self.sizes = _unpack(row["sizes"])
        self.heads = np.cumsum(_unpack(row["heads"], U), dtype=U)
        self.x = _unpack(row["tokens"])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        self.begin = len(self.heads)
        self.before = np.empty_like(self.x)
        self.before[1:] = self.x[:-1]
        self.before[self.first[:-1]] = self.begin
        self.key2 = _pair(np.append(self.heads, BEGIN)[self.before] ^ U(2), self.heads[self.x])
        self.keys2, self.first2, self.at2 = np.unique(self.key2, return_index=True, return_inverse=True)
        self.learned = np.repeat(self.train, self.sizes)

    def own(self, at: np.ndarray, many: int, learned: np.ndarray) -> np.ndarray:
        return np.bincount(at[learned], minlength=many)

    def asks(self) -> Iterator[tuple[int, np.ndarray, tuple]]:
        """Words and bigrams with their counts in training texts, and of bigrams those in all texts."""
        yield 1, self.heads, (self.own(self.x, len(self.heads), self.learned),)
        yield 2, self.keys2, (self.own(self.at2, len(self.keys2), self.learned), np.bincount(self.at2, minlength=len(self.keys2)))

    def meet(self, answers: pa.Table) -> None:
        """Takes the corpus' counts of words and bigrams. ``asked``: the tokens whose trigram may stand
        elsewhere; ``keys3`` are those trigrams and ``at3`` that of each such token."""
        self.c1, self.c2 = _replies(answers, 1, "a", len(self.heads)), _replies(answers, 2, "a", len(self.keys2))
        self.texts = self.c1[np.searchsorted(self.heads, END)]
        shared = _replies(answers, 2, "b", len(self.keys2))[self.at2] > 1
        inner = np.ones(len(self.x), bool)
        inner[self.first[:-1]] = False
        self.inner = np.flatnonzero(inner)
        self.asked = self.inner[shared[self.inner] & shared[self.inner - 1]]
        self.keys3, self.at3 = np.unique(_pair(self.key2[self.asked - 1] ^ U(3), self.heads[self.x[self.asked]]), return_inverse=True)

    def asks3(self) -> Iterator[tuple[int, np.ndarray, tuple]]:
        yield 3, self.keys3, (self.own(self.at3, len(self.keys3), self.learned[self.asked]),)

    def meet3(self, answers: pa.Table) -> None:
        """``c3``: the count of the trigram that ends at each token."""
        self.c3 = self.learned.astype(np.int64)
        self.c3[self.asked] = _replies(answers, 3, "a", len(self.keys3))[self.at3]


class Automaton:
    """What a block's texts can reach. States: 0 the empty history, 1 + word, then the begin of a text,
    then the bigrams. ``arcs`` are sorted numbers of state and token."""

    def __init__(self, b: Block, total: int, vocabulary: int):
        self.many, self.start = len(b.heads), 1 + b.begin
        pairs = self.start + 1
        self.unigram = np.log10((b.c1 + ADD) / (total + ADD * (vocabulary + 1)))
        self.after = np.where(b.c1 > 0, 1 + np.arange(self.many), 0)  # the state after a token that the empty history met
        history, word, n = b.before[b.first2], b.x[b.first2], np.append(b.c1, b.texts)
        p2 = (b.c2 + PRIOR[2] * 10 ** self.unigram[word]) / (n[history] + PRIOR[2])
        two = np.flatnonzero(b.c2 > 0)
        key2 = (1 + history[two]) * self.many + word[two]
        order = np.argsort(key2)
        t = b.inner[b.c3[b.inner] > 0]
        key3, one = np.unique((pairs + b.at2[t - 1]) * self.many + b.x[t], return_index=True)
        t = t[one]
        p3 = (b.c3[t] + PRIOR[3] * p2[b.at2[t]]) / (b.c2[b.at2[t - 1]] + PRIOR[3])
        self.arcs = np.concatenate([key2[order], key3])
        self.weight = np.log10(np.concatenate([p2[two[order]], p3]))
        self.goto = pairs + np.concatenate([two[order], b.at2[t]])
        self.fail = np.concatenate([np.zeros(pairs, np.int64), self.after[word]])
        self.fail_weight = np.log10(np.concatenate([[1.0], PRIOR[2] / (n + PRIOR[2]), PRIOR[3] / (b.c2 + PRIOR[3])]))

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states and the weights of the arcs taken, failures included."""
        weight = np.zeros(len(state))
        out, state = np.empty_like(state), state.copy()
        open_ = np.arange(len(state))
        while len(open_):
            at, t = state[open_], token[open_]
            key = at * self.many + t
            place = np.searchsorted(self.arcs, key)
            place[place == len(self.arcs)] = 0
            hit = (at > 0) & (self.arcs[place] == key) if len(self.arcs) else np.zeros(len(at), bool)
            done, place = open_[hit], place[hit]
            weight[done] += self.weight[place]
            out[done] = self.goto[place]
            root = at == 0
            done = open_[root]
            weight[done] += self.unigram[t[root]]
            out[done] = self.after[t[root]]
            open_ = open_[~hit & ~root]
            weight[open_] += self.fail_weight[state[open_]]
            state[open_] = self.fail[state[open_]]
        return out, weight

    def walk(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The summed weights of each text ``x[first[i]:first[i + 1]]``, all pieces a token at a time."""
        n = -(-np.diff(first) // PIECE)
        text = np.repeat(np.arange(len(n)), n)
        begin = first[text] + PIECE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        end = np.minimum(begin + PIECE, first[text + 1])
        at = np.maximum(begin - 2, first[text])
        order = np.argsort(at - end, kind="stable")  # the longest first
        text, begin, end, at = text[order], begin[order], end[order], at[order]
        state = np.where(at == first[text], self.start, 0)
        total = np.zeros(len(text))
        live = len(text)
        while live:
            state[:live], weight = self.step(state[:live], x[at[:live]])
            total[:live] += np.where(at[:live] >= begin[:live], weight, 0)
            at[:live] += 1
            live = int((at[:live] < end[:live]).sum())
        return np.bincount(text, total, minlength=len(first) - 1)


ASK = "kind tinyint, shard long, block long, keys binary, a binary, b binary"
ANSWER = "kind tinyint, shard long, block long, a binary, b binary, total long, kinds long"


def _ask(kind: int, block: int, fan: int, keys: np.ndarray, values: list[np.ndarray], of: int = 0, ranges: int = 1) -> Iterator[tuple]:
    """Rows of ASK: the sorted keys, all of range ``of`` among ``ranges`` equal ones, by the ``fan``
    shards of that range, as differences, and their values."""
    cuts = np.searchsorted(keys, np.array([(i << 64) // (ranges * fan) for i in range(of * fan + 1, (of + 1) * fan)], U))
    for i, (lo, hi) in enumerate(zip([0, *cuts], [*cuts, len(keys)], strict=True)):
        if lo < hi:
            packed = [_pack(x[lo:hi]) for x in values]
            yield (kind, of * fan + i, block, _pack(np.diff(keys[lo:hi], prepend=U(0))), *packed, *[None] * (2 - len(packed)))


def _asked(rows) -> pa.Table:
    kinds = [pa.int8(), pa.int64(), pa.int64(), *[pa.binary()] * 3]
    cols = list(zip(*rows, strict=True)) or [()] * 6
    return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["kind", "shard", "block", "keys", "a", "b"])


class Asked:
    """The requests of one group: ``keys``, the distinct ones, and for each request's keys their places
    ``at`` among them, one request after the other until ``ends``."""

    def __init__(self, asked: pa.Table):
        self.rows = asked.sort_by("block")
        self.kind, self.shard = (self.rows.column(c)[0].as_py() for c in ("kind", "shard"))
        keys = [np.cumsum(_unpack(x, U), dtype=U) for x in self.rows.column("keys").to_pylist()]
        self.ends = np.cumsum([len(x) for x in keys])
        self.keys, self.at = np.unique(np.concatenate(keys), return_inverse=True)

    def sums(self) -> list[np.ndarray]:
        """The values added up by key: those of bigrams are two."""
        out = []
        for name in ("a", "b")[: 2 if self.kind == 2 else 1]:
            values = np.concatenate([_unpack(x) for x in self.rows.column(name).to_pylist()])
            out.append(np.bincount(self.at, values, minlength=len(self.keys)).astype(np.int64))
        return out

    def answers(self, sums: list[np.ndarray], total: int = 0, kinds: int = 0) -> pa.Table:
        """What each request hears, in the order of its keys; the two facts stand in one row only."""
        n = len(self.ends)
        packed = [[_pack(x) for x in np.split(v[self.at], self.ends[:-1])] for v in sums]
        packed += [[None] * n] * (2 - len(packed))
        facts = [pa.array([x] + [0] * (n - 1), pa.int64()) for x in (total, kinds)]
        cols = [*(self.rows.column(c) for c in ("kind", "shard", "block")), *(pa.array(x, pa.binary()) for x in packed), *facts]
        return pa.table(cols, names=["kind", "shard", "block", "a", "b", "total", "kinds"])


def _answer(asked: pa.Table) -> pa.Table:
    """Totals of one shard's keys to each that asked; of words also the shard's tokens and kinds."""
    own = Asked(asked)
    sums = own.sums()
    facts = (int(sums[0].sum()), int((sums[0] > 0).sum())) if own.kind == 1 else (0, 0)
    return own.answers([sums[0], *(np.minimum(x, 2) for x in sums[1:])], *facts)


def _ask_on(fan: int, ranges: int):
    """A bundle's requests to the shards of its range, one of ``ranges``."""

    def run(bundle: pa.Table) -> pa.Table:
        own = Asked(bundle.drop_columns("bundle"))
        return _asked(_ask(own.kind, bundle.column("bundle")[0].as_py(), fan, own.keys, own.sums(), own.shard, ranges))

    return run


def _hand_back(bundle: pa.Table, answers: pa.Table) -> pa.Table:
    """What a bundle was answered, to each that it asked for."""
    own = Asked(bundle.drop_columns("bundle"))
    heard = answers.sort_by("shard")
    names = ("a", "b")[: 2 if own.kind == 2 else 1]
    return own.answers([np.concatenate([_unpack(x) for x in heard.column(c).to_pylist()]) for c in names])


def _replies(answers: pa.Table, kind: int, name: str, many: int) -> np.ndarray:
    """What was answered about a kind's keys, in their order."""
    own = answers.filter(pc.equal(answers.column("kind"), kind)).sort_by("shard")
    return np.concatenate([_unpack(x) for x in own.column(name).to_pylist()]) if many else np.zeros(0, np.int64)


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _count(fan: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                for kind, keys, values in Block(row).asks():
                    yield from _asked(_ask(kind, row["block"], fan, keys, values)).to_batches()

    return run


def _count3(fan: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        row = rows.to_pylist()[0]
        b = Block(row)
        b.meet(answers)
        return _asked(x for kind, keys, values in b.asks3() for x in _ask(kind, row["block"], fan, keys, values))

    return run


def _score(total: int, vocabulary: int):
    def run(rows: pa.Table, answers: pa.Table) -> pa.Table:
        b = Block(rows.to_pylist()[0])
        b.meet(answers)
        b.meet3(answers)
        a = Automaton(b, total, vocabulary)
        sums = [np.add.reduceat(x, b.first[:-1]) for x in ((b.c1 > 0).astype(np.int64)[b.x], a.unigram[b.x])]
        cols = [pa.array(b.ids, pa.int64()), pa.array(~b.train), pa.array(b.sizes), pa.array(sums[0]), pa.array(np.full(len(b.sizes), total)), pa.array(sums[1]), pa.array(a.walk(b.x, b.first))]
        return pa.table(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def _fan(shards: int, tasks: int) -> tuple[int, int]:
    """Ranges a level and levels, so that there are at least so many shards and no fewer than tasks, and
    no more than ``FAN`` ranges a level."""
    many, levels = max(shards, min(tasks, FAN)), 1
    while FAN**levels < many:
        levels += 1
    fan = max(round(many ** (1 / levels)), 1)
    return fan + (fan**levels < many), levels


def lm_score(docs: DataFrame, folds: int = 10, held_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs;
    texts whose crc32(id as text) mod ``folds`` is ``held_out`` are not learned from."""
    spark = docs.sparkSession
    s = st.Stages(spark, "lm")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = st.tasks(spark)
    fan, levels = _fan(-(-int(size) // SHARD_BYTES), tasks)
    plain = plain.withColumn("train", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held_out, F.lit(False)))
    blocks = s.keep(plain.mapInArrow(_cut, BLOCK), "blocks")
    facts: dict[str, int] = {}

    def answered(asked: DataFrame, name: str) -> DataFrame:
        bundled = []
        for level in range(1, levels):  # down to the shards, a range fan times as narrow each time
            bundle = F.pmod(F.xxhash64("block"), F.lit(-(-blocks.count() // fan))) if level == 1 else F.expr(f"block div {fan}")
            bundled.append(s.keep(asked.withColumn("bundle", bundle), f"{name}-asked-{level}"))
            asked = bundled[-1].repartition(tasks, "kind", "shard", "bundle").groupBy("kind", "shard", "bundle").applyInArrow(_ask_on(fan, fan**level), ASK)
        out = s.keep(asked.repartition(tasks, "kind", "shard").groupBy("kind", "shard").applyInArrow(_answer, ANSWER), name if levels == 1 else f"{name}-{levels}")
        found = out.where("kind = 1").agg(F.sum("total").alias("n"), F.sum("kinds").alias("v")).first()
        facts.update({k: int(found[k]) for k in ("n", "v") if found[k] is not None})
        for level in range(levels - 1, 0, -1):
            heard = out.withColumns({"bundle": F.col("block"), "of": F.expr(f"shard div {fan}")}).select("kind", "of", "bundle", "shard", "a", "b")
            sides = (x.repartition(tasks, "kind", of, "bundle").groupBy("kind", of, "bundle") for x, of in ((bundled[level - 1], "shard"), (heard, "of")))
            one, other = sides
            out = s.keep(one.cogroup(other).applyInArrow(_hand_back, ANSWER), name if level == 1 else f"{name}-{level}")
            s.drop(f"{name}-{level + 1}", f"{name}-asked-{level}")
        return out

    def met(run, answers: DataFrame, schema: str = ASK) -> DataFrame:
        own = answers.repartition(tasks, "block").groupBy("block")
        return blocks.repartition(tasks, "block").groupBy("block").cogroup(own).applyInArrow(run, schema)

    counts = answered(blocks.mapInArrow(_count(fan), ASK), "counts")
    counts3 = answered(met(_count3(fan), counts), "trigrams")
    scores = s.keep(met(_score(facts.get("n", 0), facts.get("v", 0)), counts.union(counts3), schema=OUT), "scores")
    s.drop("blocks", "counts", "trigrams")
    return scores
