"""License scans by conditional compression.

Candidates: a passage that differs from a template in at most ``most`` of its words keeps one of
``most`` + 1 pieces of it whole, so an Aho-Corasick automaton of all templates' pieces finds every
place where one may stand; texts without the longest word of any piece are not read further. A
candidate block is the stretch of words that the template may cover there, with room for the
differences, across line ends, comment marks and blank lines and within lines of any length. Blocks
are compressed with zstandard alone and with each template as a raw dictionary; the size reductions
rank the templates, and in that order each is confirmed by the exact differences in wording: words
that it has and the passage lacks, or has besides; words with digits, such as version numbers, must
all be there. Every template is confirmed or refuted, whatever its rank. Of passages of one template
that overlap the closest counts. Where confirmed passages of several templates overlap, the stretch they
cover together is compressed once more with each: the template with the greatest reduction is the
block's licence (``main``), and those that overlap it are reported as alternatives only, such as a short
notice that is a part of a longer one.

Null and empty texts give no rows. Rows are scanned one by one; a repeated or missing id is passed
on. Equal savings are ordered by the template's name, for the winner too. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from . import stages as st

#: Notices by which texts state their licence.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "BSD-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights under CC0 1.0.",
    "all-rights-reserved": "All rights reserved.",
}
WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")


def _words(text: str) -> tuple[list[str], list[int], list[int]]:
    """Words in lower case, and where they begin and end."""
    found = list(WORD.finditer(text))
    return [m[0].lower() for m in found], [m.start() for m in found], [m.end() for m in found]


def _align(own: list[str], words: list[str]) -> tuple[int, int, int, int] | None:
    """(lacking, foreign, begin, end) of the stretch of words that differs least from own; none if
    a word with a digit is lacking everywhere."""
    never = len(own) + len(words) + 1
    row = [(0, 0, -j) for j in range(len(words) + 1)]  # differences, lacking of them, minus the begin
    for w in own:
        lost = never if any(c.isdigit() for c in w) else 1
        last, row = row, [(row[0][0] + lost, row[0][1] + 1, row[0][2])]
        for j, x in enumerate(words):
            d, k, at = last[j + 1]
            best = (d + lost, k + 1, at)
            d, k, at = row[j]
            best = min(best, (d + 1, k, at))
            row.append(min(best, last[j]) if x == w else best)
    (d, lacking, at), end = min((x, j) for j, x in enumerate(row))
    return (lacking, d - lacking, -at, end) if d < never else None


def _overlapping(rows: list[tuple]) -> Iterator[list[tuple]]:
    """Runs of passages (begin, end, ...) of which each overlaps one before it."""
    block, reach = [], 0
    for r in sorted(rows):
        if block and r[0] >= reach:
            yield block
            block = []
        block.append(r)
        reach = max(reach, r[1]) if len(block) > 1 else r[1]
    if block:
        yield block


class Scanner:
    def __init__(self, templates: dict[str, str], most: float):
        self.names = list(templates)
        self.templates, self.pieces = [], ahocorasick.Automaton()
        gate = set()
        of: dict[str, list[tuple[int, int]]] = {}
        for name, t in templates.items():
            own = _words(t)[0]
            allow = int(most * len(own))
            cuts = [len(own) * i // (allow + 1) for i in range(allow + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                of.setdefault(f" {' '.join(own[a:b])} ", []).append((len(self.templates), a))
                gate.add(max(own[a:b], key=len))
            self.templates.append((name, own, allow, Counter(own)))
        for piece, at in of.items():
            self.pieces.add_word(piece, (len(piece), at))
        self.pieces.make_automaton()
        self.gate = ahocorasick.Automaton()
        for w in gate:
            self.gate.add_word(w, True)
        self.gate.make_automaton()
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False, write_checksum=False)
        self.given = [zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(t.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for t in templates.values()]

    def candidates(self, words: list[str]) -> dict[tuple[int, int], set[tuple[int, int]]]:
        """Per block of words (from, to): the templates that may stand in it and where they would begin."""
        line = f" {' '.join(words)} "
        begins = list(accumulate((len(w) + 1 for w in words), initial=0))
        out: dict[tuple[int, int], set[tuple[int, int]]] = {}
        for end, (size, at) in self.pieces.iter(line):
            first = bisect_right(begins, end - size + 1) - 1
            for i, offset in at:
                _, own, allow, _ = self.templates[i]
                lo, hi = max(0, first - offset - allow), min(len(words), first - offset + len(own) + allow)
                if hi > lo:
                    out.setdefault((lo, hi), set()).add((i, first - offset))
        return out

    def ranked(self, raw: bytes) -> list[float]:
        """The share of a block's compressed size that each template saves."""
        alone = len(self.plain.compress(raw))
        return [1 - len(z.compress(raw)) / alone for z in self.given]

    def scan(self, text: str) -> Iterator[dict]:
        if next(self.gate.iter(text.lower()), None) is None:
            return
        words, starts, ends = _words(text)
        found: list[list[tuple]] = [[] for _ in self.templates]
        for (lo, hi), asked in self.candidates(words).items():
            part = words[lo:hi]
            saved = self.ranked(text[starts[lo] : ends[hi - 1]].encode())
            for i, begin in sorted(asked, key=lambda x: (-saved[x[0]], x)):
                _, own, allow, bag = self.templates[i]
                if not allow:
                    if words[begin : begin + len(own)] == own:
                        found[i].append((0, 0, begin, begin + len(own), saved[i]))
                elif sum((bag & Counter(part)).values()) >= len(own) - allow:
                    best = _align(own, part)
                    if best and best[0] + best[1] <= allow:
                        found[i].append((*best[:2], lo + best[2], lo + best[3], saved[i]))
        rows = []
        for (name, *_), own in zip(self.templates, found, strict=True):
            taken: list[tuple[int, int]] = []
            for lacking, foreign, begin, end, saved in sorted(own, key=lambda x: (x[0] + x[1], x)):  # the closest of those that overlap
                i = bisect_right(taken, (begin, end))
                if (i == 0 or taken[i - 1][1] <= begin) and (i == len(taken) or end <= taken[i][0]):
                    taken.insert(i, (begin, end))
                    rows.append((begin, end, saved, name, lacking, foreign))
        out = []
        for block in _overlapping(rows):
            if len(block) > 1:  # the block all of them share names the winner
                of = dict(zip(self.names, self.ranked(text[starts[block[0][0]] : ends[max(r[1] for r in block) - 1]].encode()), strict=True))
                block.sort(key=lambda r: (-of[r[3]], r[3], r[0]))
            won: list[tuple[int, int]] = []
            for begin, end, saved, name, lacking, foreign in block:
                main = all(end <= a or b <= begin for a, b in won)
                won += [(begin, end)] * main
                out.append((text.count("\n", 0, starts[begin]), -saved, name, lacking, foreign, main))
        for line, saved, name, lacking, foreign, main in sorted(out):
            yield {"license": name, "line": line, "saved": round(-saved, 6), "lacking": lacking, "foreign": foreign, "main": main}


def _scan(templates: dict[str, str], most: float):
    names = ["doc_id", "license", "line", "saved", "lacking", "foreign", "main"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, most)
        for batch in batches:
            rows = [(i, *r.values()) for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if t.is_valid for r in scanner.scan(t.as_py())]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.bool_()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return run


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, most: float = 0.1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, license, line, saved, lacking, foreign, main): the licences found in each text, by line;
    main is false for a notice that overlaps one which compresses their block better."""
    return st.documents(docs, id_col, text_col).mapInArrow(_scan(templates or TEMPLATES, most), "doc_id long, license string, line int, saved double, lacking int, foreign int, main boolean")
