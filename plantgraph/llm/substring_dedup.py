"""Substring dedup by repeated-phrase automata.

Every word covered by a window of ``width`` consecutive words whose sequence also starts earlier
(smaller doc_id, or same document, earlier start) is removed; windows are judged on the input.

``repeats`` deals the passages in which windows can recur to shards. A shard confirms its recurring
phrases (windows found at two places), compiles them into an Aho-Corasick automaton whose letters
are the shard's words, and streams all its passages through it: each occurrence of a phrase that is
not the phrase's first marks a window. A passage is streamed only by the shard that can hold its
phrases, so work grows with the text, not with shards times text.

Nulls, wordless and short texts lose nothing. Rows with an equal id and text are one document; of
different texts with one id the order is that of their fingerprints. Rows without an id are
returned whole. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import repeats


def _letter(i: int) -> str:
    """The i-th letter: code points without the surrogates."""
    return chr(i + 1 if i < 0xD7FF else i + 0x801)


def automaton(width: int):
    """Decides a shard's passages."""

    def shard(block: list[repeats.Passage]) -> Iterator[tuple[int, int, int, int]]:
        letters: dict[bytes, str] = {}
        lines, first, recurring = [], {}, {}
        for _, d, t, s, n, body in block:
            line = "".join([letters.get(w) or letters.setdefault(w, _letter(len(letters))) for w in body.split(b" ")])
            lines.append(line)
            for i in range(n):
                phrase = line[i : i + width]
                at = first.setdefault(phrase, (d, t, s + i))
                if at != (d, t, s + i):
                    recurring[phrase] = at
        if not recurring:
            return
        phrases = ahocorasick.Automaton()
        for phrase, at in recurring.items():
            phrases.add_word(phrase, at)
        phrases.make_automaton()
        for (_, d, t, s, _, _), line in zip(block, lines, strict=True):
            begin = end = -1
            for last, at in phrases.iter(line):
                i = s + last - width + 1
                if at != (d, t, i):
                    if i != end:
                        if begin >= 0:
                            yield d, t, begin, end - begin
                        begin = i
                    end = i + 1
            if begin >= 0:
                yield d, t, begin, end - begin

    return shard


def _finish(ids: pa.Array, s, w, first: np.ndarray, gone: np.ndarray) -> pa.RecordBatch:
    n = np.diff(first)
    total = np.concatenate([[0], np.cumsum(gone)])
    removed = total[first[1:]] - total[first[:-1]]
    kept = []
    for i in range(len(n)):
        a, b = first[i], first[i + 1]
        raw = s.data[s.offs[i] : s.offs[i + 1]].tobytes()
        if removed[i] == n[i]:
            text = b""
        else:
            found = raw.split()
            text = b" ".join(found if not removed[i] else [x for x, g in zip(found, gone[a:b].tolist(), strict=True) if not g])
        kept.append(text)
    return pa.record_batch([ids, pa.array(n.astype(np.int64)), pa.array(removed.astype(np.int64)), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array([x.decode("utf-8", "replace") for x in kept])], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def substring_dedup(docs: DataFrame, width: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row of docs."""
    return repeats.remove(docs, "substring", True, width, max(1, min(8, width // 2)), automaton(width), _finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string", id_col, text_col)
