"""License notices in texts: winnowed fingerprints and seed words find candidates, a banded alignment confirms them.

Templates are few and fixed, so their inverted index is a dictionary that goes
with the function. Any passage that shares five words in a row with a template
shares a winnowed fingerprint with it. A passage that is a finding leaves out d
of a template's words at most, so of any d + 1 of them it has one: the d + 1
longest are looked up as single words, so no edit that leaves COVERAGE and
shifts by no more than the band goes unread, and a text without any of them is
not read further.

A passage bears a template's name only if it holds all words that identify the
template (family, variant and version) and none that identify another one.
Templates compete for a passage, and words that are left out or put in count
against them. A passage that no template names is reported as UNKNOWN."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketloom.llm.text import shingle_prints_of

GRAM, WINDOW = 3, 3
#: Words by which a passage may shift against the template: this many and a tenth of the template.
BAND = 6
#: Share of a template's words that a finding matches; of its and the inserted words, for one that no template names.
COVERAGE, UNNAMED_COVERAGE = 0.75, 0.5
UNKNOWN = "unknown"
#: Words that tell families and variants of licenses apart (fixed values).
FAMILY = frozenset("""apache mit bsd isc gnu lesser library affero gpl lgpl agpl mozilla mpl eclipse epl cc creative commons by nc sa nd
noncommercial sharealike noderivatives noderivs zero unlicense artistic boost zlib""".split())
#: Words up to this many make a short notice, in which every number is part of the version.
SHORT = 16

#: Notices by name (fixed values).
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or
implied. See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": "Released under the MIT License",
    "MIT-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
    "BSD-line": "Released under the BSD License",
    "ISC-line": "Released under the ISC License",
    "Apache": "Released under the Apache License",
    "Apache-1.1": "Licensed under the Apache License, Version 1.1",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3",
    "LGPL-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1",
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3",
    "GPL-header": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0",
    "CC-BY-ND-4.0-line": "Licensed under CC BY-ND 4.0",
    "CC-BY-NC-SA-4.0-line": "Licensed under CC BY-NC-SA 4.0",
    "CC-BY-NC-ND-4.0-line": "Licensed under CC BY-NC-ND 4.0",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "CC-BY-NC-4.0-text": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "CC-BY-ND-4.0": "This work is licensed under a Creative Commons Attribution NoDerivatives 4.0 International License",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with
this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.""",
    "BSD": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions
are met""",
}

_PLAIN = bytes(c if chr(c).isalnum() and c < 128 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[A-Za-z0-9\x80-\U0010FFFF]+")


def winnowed(prints: np.ndarray) -> np.ndarray:
    """Positions of the smallest fingerprint of every window, the last of equals."""
    if len(prints) <= WINDOW:
        return np.arange(len(prints))
    spans = np.lib.stride_tricks.sliding_window_view(prints, WINDOW)[:, ::-1]
    return np.unique(np.arange(len(spans)) + WINDOW - 1 - spans.argmin(axis=1))


def identity(words: list[str]) -> frozenset[str]:
    """The words that identify a template: those of FAMILY, and the numbers of
    its version, which in a long text are those that follow "version" or "v"."""
    numbers = {w for w in words if w.isdigit()} if len(words) <= SHORT else set()
    for i, w in enumerate(words):
        if w in ("version", "v"):
            for v in words[i + 1:]:
                if not v.isdigit():
                    break
                numbers.add(v)
    return frozenset(w for w in words if w in FAMILY) | numbers


class Index:
    """Words of the templates, and where their winnowed fingerprints stand."""

    def __init__(self, templates: dict[str, str]) -> None:
        self.words = {name: [w.lower() for w in _WORD.findall(text)] for name, text in templates.items()}
        self.identity = {name: identity(words) for name, words in self.words.items()}
        self.places: dict[int, list[tuple[str, int]]] = {}
        self.parts = {}
        for name, text in templates.items():
            (single, grams), _ = shingle_prints_of(text.encode().translate(_PLAIN), (1, GRAM))
            self.parts[name] = np.unique(single)
            for at in winnowed(grams):
                self.places.setdefault(int(grams[at]), []).append((name, int(at)))
        self.known = np.array(sorted(self.places), np.uint64)
        self.seeds: dict[bytes, list[tuple[str, int]]] = {}
        for name, words in self.words.items():
            left_out = len(words) - math.ceil(COVERAGE * len(words))
            for at in sorted(range(len(words)), key=lambda i: (-len(words[i]), i))[:left_out + 1]:
                self.seeds.setdefault(words[at].encode(), []).append((name, at))

    def candidates(self, text: str) -> list[tuple[int, str, int]]:
        """(word, template, word of the template) where a seed or a fingerprint is shared."""
        line = text.encode("utf-8", "replace").translate(_PLAIN)
        words = line.lower().split()
        if self.seeds.keys().isdisjoint(words):
            return []
        (single, grams), _ = shingle_prints_of(line, (1, GRAM))
        sown: dict[str, list[tuple[int, int]]] = {}
        for i, w in enumerate(words):
            for name, place in self.seeds.get(w, ()):
                sown.setdefault(name, []).append((i, place))
        hits = {(i, name, place) for name, found in sown.items() for i, place in self._dense(single, name, found)}
        at = winnowed(grams)
        at = at[np.isin(grams[at], self.known)]
        return sorted(hits | {(int(i), name, place) for i in at for name, place in self.places[int(grams[i])]})

    def _dense(self, single: np.ndarray, name: str, found: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Those of `found` whose band holds COVERAGE of the template's words, in any order."""
        n = len(self.words[name])
        band = BAND + n // 10
        held = np.concatenate([[0], np.isin(single, self.parts[name]).cumsum()])
        starts = np.array([i - place for i, place in found])
        low, high = np.clip(starts - band, 0, len(single)), np.clip(starts + n + band, 0, len(single))
        return [f for f, enough in zip(found, held[high] - held[low] >= COVERAGE * n) if enough]

    def find(self, text: str) -> list[tuple[str, int, int, float]]:
        """(template, start, end, coverage) of the passages that match, in code
        points. Coverage is the share of matched words in the template's and the
        inserted ones. Of passages that overlap, a named one stays before one
        that is not, and then the one with the most matched words, less those
        left out and put in."""
        hits = self.candidates(text)
        if not hits:
            return []
        spans = [m.span() for m in _WORD.finditer(text)]
        words = [text[a:b].lower() for a, b in spans]
        found, behind, read = [], {}, set()
        for at, name, place in hits:
            if at < behind.get(name, 0) or (name, at - place) in read:
                continue
            read.add((name, at - place))
            template = self.words[name]
            first, last, matched = banded(template, words, at - place, BAND + len(template) // 10)
            if matched < COVERAGE * len(template):
                continue
            inserted = last - first + 1 - matched
            whole = len(template) + inserted
            said = set(words[first:last + 1])
            # a version that goes on behind the passage, as in 2.1, is another one
            goes_on = (words[last].isdigit() and last + 1 < len(words) and words[last + 1].isdigit()
                       and text[spans[last][1]:spans[last + 1][0]] == ".")
            foreign = {w for w in said if w in FAMILY or w.isdigit() and len(template) <= SHORT} - self.identity[name]
            named = self.identity[name] <= said and not goes_on and not foreign
            if not named and matched < UNNAMED_COVERAGE * whole:
                continue
            found.append((named, 2 * matched - whole, name if named else UNKNOWN, first, last, matched / whole))
            if matched == len(template) and named and not inserted:  # a part of it may be in a passage that matches more
                behind[name] = last + 1
        found.sort(key=lambda f: (not f[0], -f[1], f[3], f[2]))
        kept: list[tuple[str, int, int, float]] = []
        taken: set[int] = set()
        for _, _, name, first, last, share in found:
            if taken.isdisjoint(range(first, last + 1)):
                kept.append((name, spans[first][0], spans[last][1], round(share, 4)))
                taken.update(range(first, last + 1))
        return sorted(kept, key=lambda f: (f[1], f[0]))


def banded(template: list[str], words: list[str], shift: int, band: int) -> tuple[int, int, int]:
    """(first, last, matched) of the alignment of `template` with the words near
    the diagonal `shift` that matches the most words, in the shortest passage."""
    # best[d]: (matched, -first, last) with the next template word at words[i + shift + d - band]
    none = (0, 0, -1)
    best = [none] * (2 * band + 1)
    for i, word in enumerate(template):
        row: list[tuple[int, int, int]] = []
        for d in range(2 * band + 1):
            at = i + shift + d - band
            top = best[d + 1] if d < 2 * band else none  # the template word is left out
            left = row[-1] if row else none  # the text word is left out
            choice = max(top, left)
            if 0 <= at < len(words) and words[at] == word:
                matched, first, _ = best[d]
                choice = max(choice, (matched + 1, first if matched else -at, at))
            row.append(choice)
        # a cell stands for the word just matched; the next row begins one word further
        best = row
    matched, first, last = max(best, key=lambda b: (b[0], b[1] - b[2]))
    return -first, last, matched


def _apply(batches: Iterator[pa.RecordBatch], templates: dict[str, str]) -> Iterator[pa.RecordBatch]:
    index = Index(templates)
    for batch in batches:
        with np.errstate(over="ignore"):
            found = [index.find(t.as_py() or "") for t in batch.column("text")]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([len(f) for f in found], pa.int64()), pa.array([",".join(sorted({x[0] for x in f})) for f in found], pa.string()),
             pa.array([max((x[3] for x in f), default=0.0) for f in found], pa.float64()),
             pa.array([",".join(f"{n}:{a}:{b}:{c:.4f}" for n, a, b, c in f) for f in found], pa.string())],
            ["doc_id", "n_findings", "licenses", "coverage", "spans"])


def license_notices(docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, n_findings, licenses, coverage, spans), one row for each row of
    `docs`, repeated rows too: the names found, UNKNOWN for a notice of a license
    that is not in the index, the largest coverage, and `name:start:end:coverage`
    of every passage. Null and empty texts have none; texts of any length are
    read whole. Only doc_id and text are read. `templates` by name replace the
    fixed notices, whole license texts among them."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    fixed = dict(templates or TEMPLATES)
    return rows.mapInArrow(lambda it: _apply(it, fixed), "doc_id long, n_findings long, licenses string, coverage double, spans string")
