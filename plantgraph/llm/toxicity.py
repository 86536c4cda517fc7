"""Toxicity by a weighted lexicon, matched with Aho-Corasick.

Texts are folded first: lower case, accents off, Cyrillic and Greek look-alikes and the usual digit
and symbol substitutions to the Latin letters they stand for, everything else to single spaces. The
lexicon holds word beginnings and whole words with weights: smoothed log odds of the word's share of
toxic against other labelled documents, kept where the odds are clear of chance. Exceptions are
two-word phrases around a lexicon word that labelled documents use almost only without toxicity; a
match inside one does not count. The matched weights, per square root of the text's words, and the
strongest match go through a logistic curve.

``fit`` learns all of it from at most ``SAMPLE`` labelled rows (those with the least hashes of their
ids), a documented bound; the counts are made by the executors, and what reaches the driver is the
sample's ids and words of toxic rows, both bounded by the sample. ``score`` reads every whole text.

Null and empty texts score as texts without a match. Without toxic labels the lexicon is empty and
every score is the share of toxic labels (0 without labels). Ids that repeat or are missing do not
matter to scores; a labelled id that repeats counts each row. An empty table gives an empty result.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import stages as st

SAMPLE = 20_000

#: Cyrillic and Greek letters that look like Latin ones, and digits and symbols used for letters.
ALIKE = "аaеeоoрpсcуyхxіiјjѕsкkмmтtнhвbαaεeοoρpιiκkνvτtυuχx"
STANDS = "0o1i3e4a5s7t8b@a$s"


class _Fold(dict):
    """Each code point's folded form, worked out when first met."""

    def __missing__(self, c: int) -> str:
        ch = chr(c)
        for table in (ALIKE, STANDS):
            if (i := table.find(ch.lower())) >= 0 and i % 2 == 0 and len(ch.lower()) == 1:
                out = table[i + 1]
                break
        else:
            plain = unicodedata.normalize("NFKD", ch.lower())
            out = "".join(x for x in plain if x.isalnum()) if any(x.isalnum() for x in plain) else ("" if all(unicodedata.combining(x) for x in plain) else " ")
        self[c] = out
        return out


FOLD = _Fold()


def fold(text: str | None) -> str:
    """Folded words with a space before, between and after."""
    return f" {' '.join((text or '').translate(FOLD).split())} "


def features(text: str | None) -> set[str]:
    """Whole words, and the beginnings of words from 4 to 8 letters, as they stand in folded text."""
    out = set()
    for w in set(fold(text).split()):
        out.add(f" {w} ")
        for k in range(4, min(8, len(w) - 1) + 1):
            out.add(f" {w[:k]}")
    return out


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    curve: tuple[float, float, float] = (-30.0, 0.0, 0.0)
    _machine: object = None

    def machine(self):
        if self._machine is None:
            a = ahocorasick.Automaton()
            for k, w in self.weights.items():
                a.add_word(k, (len(k), w))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), None))
            a.make_automaton()
            self._machine = a
        return self._machine

    def __getstate__(self):
        return {"weights": self.weights, "exceptions": self.exceptions, "curve": self.curve, "_machine": None}

    def matched(self, text: str | None) -> tuple[float, float, int]:
        """(summed weight, strongest weight, words): the strongest match that begins at each word."""
        folded = fold(text)
        words = folded.count(" ") - 1 if len(folded) > 2 else 0
        if not self.weights and not self.exceptions:
            return 0.0, 0.0, words
        at: dict[int, float] = {}
        spared = []
        for end, (size, w) in self.machine().iter(folded):
            begin = end - size + 1
            if w is None:
                spared.append((begin, end))
            elif w > at.get(begin, 0.0):
                at[begin] = w
        for a, b in spared:
            for i in [i for i in at if a <= i < b]:
                del at[i]
        return sum(at.values()), max(at.values(), default=0.0), words

    def inputs(self, text: str | None) -> tuple[float, float]:
        total, top, words = self.matched(text)
        return total / math.sqrt(max(words, 16)), top

    def score(self, text: str | None) -> float:
        x, y = self.inputs(text)
        a, b, c = self.curve
        z = max(-60.0, min(60.0, a + b * x + c * y))
        return 1.0 / (1.0 + math.exp(-z))


def _count(kind):
    """(feature, toxic, clean): documents of the sample with each feature, counted per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                (toxic if label else clean).update(kind(text))
        names = list(toxic.keys() | clean.keys())
        for i in range(0, len(names), 50_000):
            part = names[i : i + 50_000]
            yield pa.record_batch([pa.array(part, pa.string()), pa.array([toxic[x] for x in part], pa.int64()), pa.array([clean[x] for x in part], pa.int64())], names=["feature", "toxic", "clean"])

    return run


def _phrases(model: Model):
    def run(text: str | None) -> set[str]:
        folded = fold(text)
        out = set()
        for end, (size, _) in model.machine().iter(folded):
            begin = end - size + 1
            stop = folded.find(" ", begin + 1)
            before = folded.rfind(" ", 0, begin) if begin else -1
            after = folded.find(" ", stop + 1)
            if before >= 0:
                out.add(folded[before : stop + 1])
            if after >= 0:
                out.add(folded[begin : after + 1])
        return out

    return run


def _inputs(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.inputs(t) for t in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.float64()), batch.column(1).cast(pa.int32())], names=["x", "y", "label"])

    return run


def _curve(rows: list) -> tuple[float, float, float]:
    """Logistic regression with a little ridge, by Newton's steps."""
    if not rows:
        return (-30.0, 0.0, 0.0)
    x = np.array([[1.0, r.x, r.y] for r in rows])
    y = np.array([float(r.label) for r in rows])
    b = np.zeros(3)
    ridge = np.diag([1e-3, 0.05, 0.05])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ b)
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(map(float, b))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from the labelled rows: ``labels`` has the ids to learn from and their labels."""
    spark = docs.sparkSession
    s = st.Stages(spark, "toxicity")
    chosen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("label")).where("_id IS NOT NULL AND label IS NOT NULL")
    chosen = chosen.orderBy(F.xxhash64("_id"), "_id", "label").limit(sample)
    rows = st.documents(docs, id_col, text_col).join(F.broadcast(s.keep(chosen, "ids")), "_id").select(F.col("_text").alias("text"), "label")
    rows = s.keep(rows, "rows")
    seen = {r.label: r["count"] for r in rows.groupBy("label").count().collect()}
    n1, n0 = seen.get(1, 0), sum(v for k, v in seen.items() if k != 1)
    if not n1:
        return Model(curve=(-30.0, 0.0, 0.0))
    counts = rows.mapInArrow(_count(features), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (n1 + 1.0)) - F.log((F.col("clean") + 0.5) / (n0 + 1.0))
    chance = F.sqrt(1 / (F.col("toxic") + 0.5) + 1 / (F.col("clean") + 0.5))
    scored = counts.where("toxic >= 3").select("feature", "toxic", "clean", odds.alias("w"), (odds / chance).alias("z")).where("w > 2.5 AND z > 2.3")
    best = scored.collect()
    weights: dict[str, float] = {}
    for r in sorted(best, key=lambda r: (len(r.feature), r.feature)):  # a beginning stands for what it begins
        shorter = [weights[r.feature[:k]] for k in range(5, len(r.feature)) if r.feature[:k] in weights]
        if not shorter or r.w > max(shorter) + 0.7:
            weights[r.feature] = float(r.w)
    model = Model(weights)
    phrases = rows.mapInArrow(_count(_phrases(model)), "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    spared = phrases.where("clean >= 3 AND clean >= 9 * toxic").collect()
    model = Model(weights, sorted(r.feature for r in spared))
    curve = _curve(rows.mapInArrow(_inputs(model), "x double, y double, label int").collect())
    return Model(weights, model.exceptions, curve)


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row of docs."""
    return st.documents(docs, id_col, text_col).mapInArrow(_score(model), "doc_id long, score double")
