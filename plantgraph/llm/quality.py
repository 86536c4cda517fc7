"""Quality rules by tokeniser fertility, on top of a few counts.

A public vocabulary measures each text: characters per token, the share of tokens that fall back to
single bytes, and the entropy of its tokens in bits, held against bands for its language, or where
that is not given or has no band, for the script of most of its letters. Words are measured once for
each slice of documents and counted where they occur: pieces of this vocabulary never cross white
space, so a text's tokens are those of its words.

The bands are parameters (``BANDS``) and widen for short texts: a mean over n tokens may miss its band
by ``WIDEN / sqrt(n)``, a share by ``1 / sqrt(n)``, and the entropy asked of fewer than 64 tokens falls
with the logarithm of their number. So every text gets a verdict. The least characters per token of
English, German, French and Spanish are those that ``fit_bands`` finds on labelled rows, where they
cost one clean text in a hundred; scripts without labels have limits that prose of any kind passes.

Null texts are empty; an empty text fails the base rule (fewer than 10 words). Rows are decided one
by one: repeated and missing ids do not matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as tx

U = np.uint64
WIDEN = 3.0
SAMPLE = 20_000
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

#: language or script: least and most characters per token, most byte-fallback share, least entropy
BANDS = {
    "en": (2.22, 12.0, 0.2, 4.0),
    "de": (2.23, 12.0, 0.2, 4.0),
    "fr": (1.98, 12.0, 0.2, 4.0),
    "es": (1.95, 12.0, 0.2, 4.0),
    "Latin": (1.3, 12.0, 0.3, 2.5),
    "Cyrillic": (0.8, 12.0, 0.4, 2.5),
    "Greek": (0.5, 12.0, 0.7, 2.0),
    "CJK": (0.2, 8.0, 0.95, 2.0),
    "Other": (0.15, 12.0, 0.99, 1.5),
}
#: scripts by their first bytes in UTF-8: lead bytes from, to
SCRIPTS = {"Latin": ((0x41, 0x5A), (0x61, 0x7A), (0xC3, 0xCA)), "Greek": ((0xCD, 0xCF),), "Cyrillic": ((0xD0, 0xD3),), "CJK": ((0xE3, 0xED),), "Other": ((0xD4, 0xE2), (0xEE, 0xF4))}
NAMES = list(SCRIPTS)
_SCRIPT = np.full(256, len(NAMES), np.uint8)
for _i, _name in enumerate(NAMES):
    for _lo, _hi in SCRIPTS[_name]:
        _SCRIPT[_lo : _hi + 1] = _i
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

_MODELS: dict[str, tuple] = {}


def _model(path: str):
    """The vocabulary, loaded once for each worker, and which of its pieces are single bytes."""
    if path not in _MODELS:
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        _MODELS[path] = m, np.array([m.is_byte(i) for i in range(m.get_piece_size())])
    return _MODELS[path]


def _sums(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
    return total[first[1:]] - total[first[:-1]]


def base(s: tx.Slice) -> tuple[tx.Words, np.ndarray, dict[str, np.ndarray]]:
    """Words, their hashes and the base counts of a slice's documents."""
    words = tx.Words(s)
    h = words.hashes()
    lead = (s.data & 0xC0) != 0x80
    gap = tx.SPACE[s.data]
    out = {"n_words": np.diff(words.first), "word_chars": _sums(lead & ~gap, s.offs), "n_symbols": _sums(_SYMBOL[s.data], s.offs)}
    lines = tx.Words(s, tx.NEWLINE)
    with_word = np.searchsorted(words.start, lines.end, "left") > np.searchsorted(words.start, lines.start, "left")
    lh = tx.hashes(s.data, lines.start[with_word], lines.end[with_word])
    ld = lines.doc_of()[with_word]
    order = np.lexsort((lh, ld))
    again = np.zeros(len(lh), bool)
    again[1:] = (lh[order[1:]] == lh[order[:-1]]) & (ld[order[1:]] == ld[order[:-1]])
    out["n_dup_lines"] = np.bincount(ld[order][again], minlength=len(s)).astype(np.int64)
    grams = tx.shingle_hashes(h, 5)
    cover = np.zeros(len(h) + 1, np.int32)
    for i in np.flatnonzero(out["n_words"] >= 6):
        a, b = words.first[i], words.first[i + 1] - 4
        own = grams[a:b]
        by = np.argsort(own)
        same = np.zeros(len(own) + 1, bool)
        same[1:-1] = own[by[1:]] == own[by[:-1]]
        if same.any():
            at = by[same[1:] | same[:-1]] + a
            cover[at] += 1
            cover[at + 5] -= 1
    out["n_repeat_words"] = _sums(np.cumsum(cover[:-1]) > 0, words.first)
    return words, h, out


def fertility(words: tx.Words, h: np.ndarray, path: str) -> dict[str, np.ndarray]:
    """Tokens, byte-fallback tokens and token entropy of each document."""
    model, is_byte = _model(path)
    _, at, inverse = np.unique(h, return_index=True, return_inverse=True)
    raw = words.data
    pieces = model.encode([raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)], num_threads=1) if len(at) else []
    length = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((x for p in pieces for x in p), np.int64, int(length.sum()))
    begin = np.cumsum(length) - length
    size = length[inverse]
    token = flat[np.repeat(begin[inverse] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    first = np.concatenate([[0], np.cumsum(size)])[words.first]
    n = np.diff(first)
    entropy = np.zeros(len(n))
    for i in np.flatnonzero(n):
        c = np.bincount(token[first[i] : first[i + 1]])
        c = c[c > 0]
        entropy[i] = np.log2(n[i]) - float((c * np.log2(c)).sum()) / n[i]
    return {"n_tokens": n, "n_byte_tokens": _sums(is_byte[token], first), "entropy": entropy}


def _scripts(s: tx.Slice) -> list[str]:
    kind = _SCRIPT[s.data]
    counts = np.stack([_sums(kind == i, s.offs) for i in range(len(NAMES))])
    return [NAMES[int(c.argmax())] if c.max() else "Latin" for c in counts.T]


def judge(s: tx.Slice, langs: list, path: str, bands: dict) -> dict[str, np.ndarray]:
    words, h, out = base(s)
    out["base_failed"] = (out["n_words"] < 10) | (100 * out["n_repeat_words"] > 20 * out["n_words"])
    out |= fertility(words, h, path)
    chars = out["word_chars"] / np.maximum(out["n_tokens"], 1)
    share = out["n_byte_tokens"] / np.maximum(out["n_tokens"], 1)
    names = [lang if lang in bands else script for lang, script in zip(langs, _scripts(s), strict=True)]
    least, most, fallback, entropy = np.array([bands[x] for x in names], float).reshape(-1, 4).T
    n = np.maximum(out["n_tokens"], 2)
    slack = 1 / np.sqrt(n)
    inside = (chars >= least - WIDEN * slack) & (chars <= most + WIDEN * slack) & (share <= fallback + slack) & (out["entropy"] >= entropy * np.minimum(1, np.log2(n) / 6))
    return out | {"chars_per_token": chars, "byte_share": share, "kept": inside & ~out["base_failed"]}


LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SCHEMA = ", ".join(["doc_id long", *(f"{x} long" for x in LONGS), "base_failed boolean, kept boolean, n_tokens long, chars_per_token double, byte_share double, entropy double, band string"])


def _scan(path: str, bands: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(2).to_pylist()
            for s in tx.slices(batch.column(1)):
                own = langs[s.first : s.first + len(s)]
                x = judge(s, own, path, bands)
                band = [lang if lang in bands else script for lang, script in zip(own, _scripts(s), strict=True)]
                cols = [batch.column(0).slice(s.first, len(s)), *(pa.array(x[k].astype(np.int64)) for k in LONGS), pa.array(x["base_failed"]), pa.array(x["kept"]), pa.array(x["n_tokens"].astype(np.int64)), pa.array(x["chars_per_token"]), pa.array(x["byte_share"]), pa.array(x["entropy"]), pa.array(band)]
                yield pa.record_batch(cols, names=["doc_id", *LONGS, "base_failed", "kept", "n_tokens", "chars_per_token", "byte_share", "entropy", "band"])

    return run


def _keep(path: str, bands: dict, text: int, lang: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(lang).to_pylist() if lang is not None else [None] * len(batch)
            for s in tx.slices(batch.column(text)):
                x = judge(s, langs[s.first : s.first + len(s)], path, bands)
                yield batch.slice(s.first, len(s)).filter(pa.array(x["kept"]))

    return run


def vocabulary_path(path: str | None = None) -> str:
    return path or os.environ.get("PLANTGRAPH_PIECES", VOCABULARY)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None, bands: dict | None = None) -> DataFrame:
    """Every row's counts, measures and verdict (``kept``)."""
    lang = F.col(lang_col).cast("string") if lang_col else F.lit(None).cast("string")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), lang.alias("lang"))
    return plain.mapInArrow(_scan(vocabulary_path(vocabulary), bands or BANDS), SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text", lang_col: str | None = "lang", vocabulary: str | None = None, bands: dict | None = None) -> DataFrame:
    """The rows of docs, with all their columns, that the rules keep."""
    lang = docs.columns.index(lang_col) if lang_col in docs.columns else None
    return docs.mapInArrow(_keep(vocabulary_path(vocabulary), bands or BANDS, docs.columns.index(text_col), lang), docs.schema)


def fit_bands(docs: DataFrame, labels: DataFrame, bands: dict | None = None, sample: int = SAMPLE, lost: float = 0.01, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", vocabulary: str | None = None) -> dict:
    """``bands`` with the least characters per token of each language that ``labels`` (id, 1 for clean)
    has 100 clean texts of, set where it costs ``lost`` of them. Learned from at most ``sample`` rows,
    those with the least hashes of their ids."""
    chosen = labels.select(F.col(id_col).cast("long").alias("_id"), F.col(label_col).cast("int").alias("_label")).where("_id IS NOT NULL AND _label = 1")
    chosen = chosen.select("_id").distinct().orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = quality_rules(docs.join(F.broadcast(chosen), F.col(id_col).cast("long") == F.col("_id"), "left_semi"), id_col, text_col, lang_col, vocabulary, bands).where("NOT base_failed")
    langs = rows.join(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("_lang")).distinct(), "doc_id").where("_lang IS NOT NULL")
    at = F.col("chars_per_token") + WIDEN / F.sqrt(F.greatest("n_tokens", F.lit(2)))
    found = langs.groupBy("_lang").agg(F.count("*").alias("n"), F.percentile(at, F.lit(lost)).alias("least")).where("n >= 100")
    out = dict(bands or BANDS)
    for r in found.toLocalIterator():  # one row for each language
        out[r["_lang"]] = (float(r.least), *out.get(r["_lang"], out["Latin"])[1:])
    return out
