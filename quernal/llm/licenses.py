"""License scan by conditional compression.

The words around each mention of a license, whatever lines they stand on, are
compressed once plainly and once with each template as a raw zstandard
dictionary.  Every template that saves bytes is a candidate, however many there
are, and only those are aligned with the words: a notice has its template's
names and versions and no others, and differs in a bounded number of other
words; where notices overlap, those with the fewest differences stay.  The bytes
that a template saves on the lines of its notice rank the notices.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import OrderedDict

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import col, slices

# License identifiers and the notices by which texts name them.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "AGPL-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0.",
    "EPL-2.0": "Made available under the Eclipse Public License 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-2.1": "This library is licensed under the GNU Lesser General Public License, version 2.1.",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "proprietary": "All rights reserved.",
}
TRIGGER = re.compile(r"licen[sc]e|copyright|rights reserved|permission|public domain|\bCC[ -]?(?:BY|0)", re.I)
WORD = re.compile(r"[A-Za-z0-9]+(?:[.\-/][A-Za-z0-9]+)*")
#: Words that templates need not share with a notice; a template's other words name it.
PLAIN = frozenset("this is a the of to in into under and work program library software source code form free license licensed version v released distributed made available dedicated subject terms public domain".split())
#: Templates without a name: only the wording tells them.
NAMELESS = frozenset(("0BSD", "proprietary"))
#: A word that names one license and is common besides.
COMMON = frozenset(("by",))
LEVEL = 19
#: Words from one compressed piece to the next: more of them would drown short templates in the rest of a piece.
STEP = 8
BLOCK_CHARS = 4096
ROW = "doc_id long, line long, license string, saved_bytes long, differences long, text string"


def words(text: str) -> list[str]:
    return [w.lower() for w in WORD.findall(text)]


class Scanner:
    """Finds notices in a text; equal passages are answered from a bounded memory."""

    def __init__(self, templates: dict[str, str], memory: int = 4096):
        import zstandard as zstd

        self.words = {k: words(v) for k, v in templates.items()}
        self.names = {k: frozenset() if k in NAMELESS else frozenset(v) - PLAIN for k, v in self.words.items()}
        self.any_name = frozenset().union(*self.names.values()) - COMMON
        self.reach = 2 * max(map(len, self.words.values()))
        self.span = max(len(v) + self.bounds(k)[0] for k, v in self.words.items())
        self.plain = zstd.ZstdCompressor(level=LEVEL)
        self.with_template = {k: zstd.ZstdCompressor(level=LEVEL, dict_data=zstd.ZstdCompressionDict(" ".join(self.words[k]).encode(), dict_type=zstd.DICT_TYPE_RAWCONTENT)) for k, v in templates.items()}
        self.answers: OrderedDict[tuple, object] = OrderedDict()
        self.memory = memory

    def remember(self, key: tuple, make):
        if key in self.answers:
            self.answers.move_to_end(key)
            return self.answers[key]
        out = self.answers[key] = make()
        if len(self.answers) > self.memory:
            self.answers.popitem(last=False)
        return out

    def saved(self, names, block: str) -> dict[str, int]:
        """Bytes that each template saves on the words of a block, in lower case with one space between."""
        raw = " ".join(words(block)).encode()
        plain = len(self.plain.compress(raw))
        return {k: plain - len(self.with_template[k].compress(raw)) for k in names}

    def candidates(self, own: list[str]) -> set[str]:
        """Templates that save bytes on some piece of the words; a notice lies whole in a piece that is little longer."""
        out: set[str] = set()
        for a in range(0, max(1, len(own) - self.span), STEP):
            piece = own[a : a + self.span + STEP]
            out |= self.remember(("", *piece), lambda piece=piece: {k for k, n in self.saved(self.words, " ".join(piece)).items() if n > 0})
        return out

    def bounds(self, name: str) -> tuple[int, int]:
        """Most words that may differ, and most of the template's that may be lost or changed."""
        n = len(self.words[name])
        return ((n + 1) // 2, n // 3) if self.names[name] else (n // 8, n // 8)

    def align(self, name: str, own: list[str]) -> list[tuple[int, int, int]]:
        """(differences, first word, end) of the spans of own that are the template's, apart from each other."""
        t, names = self.words[name], self.names[name]
        most, lost = self.bounds(name)
        known = set(own)
        if not known.issuperset(names) or sum(w not in known for w in t) > lost:
            return []
        far = (len(own) + 1, 0)
        none = [far] * (lost + 1)
        fixed = [w in names for w in t]

        def later(cell):
            """One more of the template's words lost or changed."""
            return [far, *cell[:-1]]

        # A cell has for each number of words lost or changed the fewest words added, and minus the first word.
        row = [[(0, 0), *none[1:]]]
        for gone in fixed:
            row.append(none if gone else later(row[-1]))
        ends = []
        for i, w in enumerate(own):
            above, row[0] = row[0], [(0, -i - 1), *none[1:]]
            foreign = w in self.any_name
            for j, x in enumerate(t, 1):
                before, above = above, row[j]
                if w == x:
                    best = before
                elif foreign or fixed[j - 1]:
                    best = none
                else:
                    best = later(before)
                if not foreign:
                    best = [min(p, (c + 1, m)) if c < most else p for p, (c, m) in zip(best, above, strict=True)]
                if not fixed[j - 1]:
                    best = list(map(min, best, later(row[j - 1])))
                row[j] = best
            ends += [(c + d, i + 1 + m, -m, i + 1) for d, (c, m) in enumerate(row[-1]) if c + d <= most]
        taken: list[tuple[int, int, int]] = []
        for c, _, a, b in sorted(ends):
            if all(b <= x or y <= a for _, x, y in taken):
                taken.append((c, a, b))
        return taken

    def passage(self, own: list[str]) -> list[tuple[str, int, int, int]]:
        """(license, differences, first word, end) of the notices; of overlapping ones those that differ least."""
        likely = self.candidates(own)
        found = [(k, *x) for k in self.words if k in likely for x in self.align(k, own)]
        return [x for x in found if not any(y[1] < x[1] and y[2] < x[3] and x[2] < y[3] for y in found)]

    def notices(self, text: str) -> list[tuple[int, str, int, int, str]]:
        """(line, license, saved bytes, differences, lines of the notice), one for each line and license."""
        at = list(WORD.finditer(text))
        starts, own = [m.start() for m in at], [m.group().lower() for m in at]
        regions: list[list[int]] = []
        for m in TRIGGER.finditer(text):
            a, b = bisect_right(starts, m.start()) - 1 - self.reach, bisect_left(starts, m.end()) + self.reach
            if regions and a <= regions[-1][1]:
                regions[-1][1] = b
            else:
                regions.append([max(0, a), b])
        best: dict[tuple[int, str], tuple[int, int, str]] = {}
        for a, b in regions:
            part = own[a:b]
            for k, diff, x, y in self.remember((*part,), lambda part=part: self.passage(part)):
                first, last = at[a + x].start(), at[a + y - 1].end()
                line = text.count("\n", 0, first)
                begin, end = text.rfind("\n", 0, first) + 1, text.find("\n", last)
                end = len(text) if end < 0 else end
                if end - begin > BLOCK_CHARS:
                    begin, end = max(begin, first - BLOCK_CHARS // 2), min(end, last + BLOCK_CHARS // 2)
                block = text[begin:end]
                if (line, k) not in best or diff < best[line, k][1]:
                    best[line, k] = self.remember((k, block, None), lambda k=k, block=block: self.saved([k], block)[k]), diff, block
        return sorted(((line, k, *x) for (line, k), x in best.items()), key=lambda x: (x[0], -x[2], x[1]))

    def scan(self, block: str) -> list[tuple[str, int, int]]:
        """(license, saved bytes, differences) of a block's notices."""
        return [x[1:4] for x in self.notices(block)]


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """One row per document row, line and license whose notice begins on it.

    Null and empty texts have no license; repeated rows and repeated lines are
    reported one by one; an empty table gives no rows; other columns are ignored.
    """
    chosen = templates or TEMPLATES

    def run(batches):
        scanner = Scanner(chosen)
        for batch in slices(batches, "text"):
            rows = []
            for doc, text in zip(col(batch, "doc_id").to_pylist(), col(batch, "text").to_pylist(), strict=True):
                if text and TRIGGER.search(text):
                    rows += [(doc, *x) for x in scanner.notices(text)]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in ROW.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, ROW)
