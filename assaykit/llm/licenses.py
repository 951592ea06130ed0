"""License scans: winnowed fingerprints pick candidates, banded alignment reports coverage and spans.

Texts and templates are lower-cased runs of letters and digits. Hashes of ``GRAM``
neighbouring words are winnowed (the least hash of each window of ``WINDOW``), so
any ``GRAM + WINDOW - 1`` words in common share a fingerprint. The templates'
fingerprints form an inverted index (fingerprint to template and place) whose size
is that of the templates. A document's fingerprints are looked up in it; each hit
gives a template and the place where it would start; the template is aligned with
the words there in a band of ``BAND`` words to either side. An alignment that
matches at least ``MIN_COVERAGE`` of the template's words is reported with its span in
characters of the text, if the template's ``REQUIRED`` runs of words (name, version, Lesser, NC) all
stand in the span as they are, so a neighbouring license is not taken for it.

Templates are notices, headers and, for the short licenses (MIT, BSD, ISC, 0BSD, Unlicense), the whole
text and its warranty part; GPL, LGPL, AGPL, Apache, MPL, EPL and CC are known by notices and headers
only. ``scan`` takes other texts and required runs.

One row per match; a document without a match has none, so null, empty and blank
texts give no rows. Repeated rows are scanned row by row, a null doc_id is kept,
other columns are ignored. Of matches of one template that overlap, and of different
templates whose spans share more than half of the shorter, the one with the most words matched
is reported (equal ones: the larger coverage, then the first). Each document is scanned whole in one pass.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

GRAM, WINDOW, BAND, MIN_COVERAGE = 3, 3, 8, 0.8
#: Remembered word hashes of a worker.
CACHE_WORDS = 400_000

_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO "
             "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE "
             "AUTHORS {}BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
             "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.")
_MIT = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. ")
_BSD = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. ")
_BSD3 = ("3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
         "products derived from this software without specific prior written permission. ")
_BSD_WARRANTY = ("THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, "
                 "INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE "
                 "DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, "
                 "SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR "
                 "SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
                 "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE "
                 "USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.")
_ISC_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
_ISC_WARRANTY = ("THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL "
                 "IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, "
                 "INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER "
                 "IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
                 "PERFORMANCE OF THIS SOFTWARE.")
_UNLICENSE = ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
              "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
              "commercial or non-commercial, and by any means. ")
_UNLICENSE_REST = ("In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all "
                   "copyright interest in the software to the public domain. We make this dedication for the benefit of the public "
                   "at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of "
                   "relinquishment in perpetuity of all present and future rights to this software under copyright law. ")

# Widely used licenses, their notices and headers.
TEMPLATES = {
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
                         "except in compliance with the License. You may obtain a copy of the License at",
    "MIT notice": "Released under the MIT License.",
    "MIT permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software "
                      "and associated documentation files (the \"Software\"), to deal in the Software without "
                      "restriction, including without limitation the rights to use, copy, modify, merge, publish, "
                      "distribute, sublicense, and/or sell copies of the Software",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                  "General Public License as published by the Free Software Foundation",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under a Creative Commons Attribution 4.0 International License.",
    "BSD conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted "
                      "provided that the following conditions are met",
    "ISC permission": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without "
                      "fee is hereby granted, provided that the above copyright notice and this permission notice "
                      "appear in all copies.",
    "MPL-2.0 notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "MPL-1.1 notice": "The contents of this file are subject to the Mozilla Public License Version 1.1",
    "MIT": _MIT + _WARRANTY.format("OR COPYRIGHT HOLDERS "),
    "MIT warranty": _WARRANTY.format("OR COPYRIGHT HOLDERS "),
    "NCSA permission": _MIT[:_MIT.index(", and to permit")].replace("deal in", "deal with"),
    "BSD-2-Clause": _BSD + _BSD_WARRANTY,
    "BSD-3-Clause": _BSD + _BSD3 + _BSD_WARRANTY,
    "BSD warranty": _BSD_WARRANTY,
    "ISC": f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}",
    "0BSD permission": f"{_ISC_GRANT}.",
    "0BSD": f"{_ISC_GRANT}. {_ISC_WARRANTY}",
    "ISC warranty": _ISC_WARRANTY,
    "Unlicense opening": _UNLICENSE,
    "Unlicense": _UNLICENSE + _UNLICENSE_REST + _WARRANTY.format(""),
    "Unlicense dedication": _UNLICENSE_REST,
    "CC0-1.0 notice": "Licensed under CC0 1.0.",
    "CC0-1.0 waiver": "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
                      "to this work.",
    "EPL-2.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                      "License 2.0",
    "EPL-2.0 notice v": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                        "License v2.0",
    "EPL-1.0 notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public "
                      "License v1.0",
}

#: Runs of words that must stand in the span of a match.
REQUIRED: dict[str, list[str]] = {
    "Apache-2.0 notice": ["apache license version 2 0"], "Apache-2.0 header": ["apache license version 2 0"],
    "MIT notice": ["mit license"], "MIT permission": ["deal in the software"], "MIT": ["deal in the software"],
    "NCSA permission": ["deal with the software"], "MIT warranty": ["authors or copyright holders"],
    "GPL-3.0 notice": ["gnu general public license", "version 3"], "GPL header": ["gnu general public license"],
    "CC-BY-NC-4.0 notice": ["cc by nc 4 0"], "CC-BY-4.0 notice": ["commons attribution 4 0"],
    "BSD conditions": ["source and binary forms"], "BSD-3-Clause": ["endorse or promote products"],
    "ISC permission": ["with or without fee", "provided that"], "ISC": ["with or without fee", "provided that"],
    "0BSD permission": ["with or without fee"], "0BSD": ["with or without fee"],
    "MPL-2.0 notice": ["mozilla public license v 2 0"], "MPL-1.1 notice": ["mozilla public license version 1 1"],
    "CC0-1.0 notice": ["cc0 1 0"], "CC0-1.0 waiver": ["waived all copyright"], "Unlicense": ["unencumbered software"],
    "EPL-2.0 notice": ["eclipse public license 2 0"], "EPL-2.0 notice v": ["eclipse public license v2 0"],
    "EPL-1.0 notice": ["eclipse public license v1 0"],
}
for _name, _gnu, _version in (("GPL-2.0", "", "2"), ("GPL-3.0", "", "3"), ("LGPL-2.0", "Library ", "2"), ("LGPL-2.1", "Lesser ", "2.1"),
                              ("LGPL-3.0", "Lesser ", "3"), ("AGPL-3.0", "Affero ", "3")):
    _runs = [f"gnu {_gnu}general public license".lower(), f"version {_version}".replace(".", " ")]
    for _kind, _text in (("notice", f"This work is licensed under the GNU {_gnu}General Public License, version {_version}."),
                         ("header", f"This program is free software: you can redistribute it and/or modify it under the terms of the "
                                    f"GNU {_gnu}General Public License as published by the Free Software Foundation, either version "
                                    f"{_version} of the License, or (at your option) any later version.")):
        TEMPLATES.setdefault(f"{_name} {_kind}", _text)
        REQUIRED[f"{_name} {_kind}"] = _runs
for _code, _long in (("BY", ""), ("BY-SA", "-ShareAlike"), ("BY-NC", "-NonCommercial"), ("BY-ND", "-NoDerivatives"),
                     ("BY-NC-SA", "-NonCommercial-ShareAlike"), ("BY-NC-ND", "-NonCommercial-NoDerivatives")):
    for _version, _port in (("4.0", "International"), ("3.0", "Unported")):
        _run = f"{{}} {_version}".replace(".", " ").lower()
        for _kind, _start, _text in (
                ("short notice", f"CC {_code}", f"Licensed under CC {_code} {_version}."),
                ("long notice", f"Commons Attribution{_long}",
                 f"Licensed under a Creative Commons Attribution{_long} {_version} {_port} License.")):
            if _text not in TEMPLATES.values():
                TEMPLATES[f"CC-{_code}-{_version} {_kind}"] = _text
                REQUIRED[f"CC-{_code}-{_version} {_kind}"] = [_run.format(_start.replace("-", " ").lower())]

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_SPACED = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def winnowed(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints (uint64) and the word places they were taken from, of word hashes."""
    n = len(hashes) - GRAM + 1
    if n < 1:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    grams = np.zeros(n, np.uint64)
    for i in range(GRAM):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[i:i + n]
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0xBF58476D1CE4E5B9)
    width = min(WINDOW, n)
    view = np.lib.stride_tricks.sliding_window_view(grams, width)
    places = np.unique(np.arange(len(view)) + view.argmin(axis=1))
    return grams[places], places


class Scanner:
    """Templates with their inverted index of fingerprints."""

    def __init__(self, templates: dict[str, str] = TEMPLATES, required: dict[str, list[str]] = REQUIRED):
        self.hash = _Hashes()
        self.names = list(templates)
        self.words = [self.split(t.encode().lower()) for t in templates.values()]
        self.required = [[b" %b " % b" ".join(self.split(r.encode().lower())) for r in required.get(name, ())] for name in self.names]
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for k, words in enumerate(self.words):
            if len(words) < GRAM:
                raise ValueError(f"template {self.names[k]!r} has fewer than {GRAM} words")
            for f, p in zip(*winnowed(self.hashes(words))):
                self.index[int(f)].append((k, int(p)))
        self.keys = np.sort(np.fromiter(self.index, np.uint64, len(self.index)))

    @staticmethod
    def split(data: bytes) -> list[bytes]:
        return data.translate(_SPACED).split()

    def hashes(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.hash.__getitem__, words), np.uint64, len(words))

    def has_required(self, k: int, span: list[bytes]) -> bool:
        text = b" %b " % b" ".join(span)
        return all(run in text for run in self.required[k])

    def scan(self, text: str) -> list[tuple[str, int, int, int, int]]:
        """(template, matched words, template words, first character, end character) of each match."""
        data = text.encode().lower()
        words = self.split(data)
        prints, places = winnowed(self.hashes(words))
        at = np.minimum(np.searchsorted(self.keys, prints), len(self.keys) - 1)
        hits = np.flatnonzero(self.keys[at] == prints)
        starts = sorted({(k, int(places[h]) - p) for h in hits for k, p in self.index[int(prints[h])]})
        found, before = [], None
        for k, start in starts:
            if before and before[0] == k and start - before[1] <= band_of(self.words[k]) // 2:
                continue                            # the band of the start before covers this one
            before = (k, start)
            band, least = band_of(self.words[k]), MIN_COVERAGE * len(self.words[k])
            there = set(words[max(0, start - band):max(0, start + len(self.words[k]) + band)])
            if sum(w in there for w in self.words[k]) < least:
                continue
            matched, first, last = aligned(self.words[k], words, start)
            if matched >= least and self.has_required(k, words[first:last + 1]):
                found.append((k, matched, first, last))
        kept: list[tuple[int, int, int, int]] = []
        for match in sorted(found, key=lambda x: (-x[1], -x[1] / len(self.words[x[0]]), x[2], x[0])):
            if not any(overlap(match, x) for x in kept):
                kept.append(match)
        kept.sort(key=lambda x: (x[0], x[2]))
        if not kept:
            return []
        spans = [m.span() for m in _WORD.finditer(data)]
        raw = text.encode()                         # lower-casing ASCII bytes keeps their places
        chars = lambda byte: len(raw[:byte].decode())
        return [(self.names[k], matched, len(self.words[k]), chars(spans[first][0]), chars(spans[last][1]))
                for k, matched, first, last in kept]


def overlap(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> bool:
    """Whether one of two matches (template, matched, first, last) stands in the place of the other."""
    both = min(a[3], b[3]) - max(a[2], b[2]) + 1
    return both > 0 if a[0] == b[0] else 2 * both > min(a[3] - a[2], b[3] - b[2]) + 1


def band_of(template: list[bytes]) -> int:
    """Narrower for short templates, so that neighbouring copies are told apart."""
    return min(BAND, max(1, len(template) // 4))


def aligned(template: list[bytes], words: list[bytes], start: int) -> tuple[int, int, int]:
    """Most template words matched in order within the band around ``start``; first and last word place matched.

    Row i of the table covers the text words start + i - BAND to start + i + BAND; a cell holds
    (matches, -width) so that of equal counts the narrowest span wins.
    """
    band = band_of(template)
    n, width = len(words), 2 * band + 1
    none = (0, 0, -1, -1)                            # matches, first - last, first, last
    row = [none] * (width + 1)
    for i, t in enumerate(template):
        low, left, now = start + i - band, none, []
        for d in range(width):
            j = low + d
            best = max(left, row[d + 1])
            if 0 <= j < n and words[j] == t:
                m, _, first, _ = row[d]
                first = j if first < 0 else first
                best = max(best, (m + 1, first - j, first, j))
            now.append(best)
            left = best
        row = [*now, none]
    best = max(row)
    return best[0], best[2], best[3]


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, id_col: str = "doc_id",
         text_col: str = "text", required: dict[str, list[str]] = REQUIRED) -> DataFrame:
    """doc_id, license, matched_words, template_words, coverage, start, end (characters, end excluded), one row per match."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, required)
        for batch in batches:
            out = [(i, *m) for i, t in enumerate(batch.column(1)) for m in scanner.scan(t.as_py())]
            if out:
                i, *columns = zip(*out)
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(i)), *[pa.array(c, t) for c, t in zip(columns, types)]],
                    ["doc_id", "license", "matched_words", "template_words", "start", "end"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, license string, matched_words bigint, template_words bigint, "
                                "start bigint, end bigint").withColumn(
        "coverage", F.col("matched_words") / F.col("template_words"))
