"""License scan: winnowed template fingerprints in an inverted index, then banded alignment.

Texts and templates are sequences of words (runs of letters, digits and non-ASCII bytes, A-Z lower-cased).  Hashes of
``gram`` words are winnowed: of every ``window`` neighbouring hashes the least is a fingerprint, so a run of
gram + window - 1 equal words always shares one with its template.  Fingerprints found in the index name a template and
the place where it would begin; around each such place, unless the words that both have are too few for any match, the
template is aligned with the text in a band of insertions and deletions, and matches that cover enough of the template are reported with their span.

Edge cases: null and empty texts have no matches; every row is judged by itself, so repeated rows repeat their
result; an empty table gives an empty result; other columns are ignored.  Positions count code points.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from importlib import resources
from statistics import mode

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty
from .hashing import PolynomialHash, mix

# One-line statements, notices, grants (the first part of a text that is often copied alone) and whole texts.
LINES: Mapping[str, str] = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Released under the MIT License.",
    "BSD": "Released under the BSD License.",
    "ISC-line": "Released under the ISC License.",
    "MPL-1.1": "The contents of this file are subject to the Mozilla Public License Version 1.1.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
}
NOTICES: Mapping[str, str] = {
    "Apache-2.0-header": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
        'writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either '
        "express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "MPL-2.0-notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
        "file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "
        '"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
    ),
    "BSD-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    ),
}
#: Names, versions and the word for the work of the GNU licenses.
GNU = (
    ("GPL-1.0", "General", "1", "program"), ("GPL-2.0", "General", "2", "program"), ("GPL-3.0", "General", "3", "program"),
    ("LGPL-2.0", "Library General", "2", "library"), ("LGPL-2.1", "Lesser General", "2.1", "library"), ("LGPL-3.0", "Lesser General", "3", "library"),
    ("AGPL-3.0", "Affero General", "3", "program"),
)
CC_KINDS = {
    "BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-ND": "Attribution-NoDerivatives", "BY-NC": "Attribution-NonCommercial",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
CC_VERSIONS = {"1.0": "Generic", "2.0": "Generic", "2.5": "Generic", "3.0": "Unported", "4.0": "International"}


def _gnu_notices() -> dict[str, str]:
    """Per license: the one-line statement, the notice's first paragraph with and without later versions, the whole notice."""
    out = {}
    for name, kind, version, work in GNU:
        title = f"GNU {kind} Public License"
        grant = f"This {work} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation"
        later = f"{grant}, either version {version} of the License, or (at your option) any later version."
        got = f"You should have received a copy of the {title} along with this {work}"
        if version.startswith("3"):
            got += ". If not, see <https://www.gnu.org/licenses/>."
        else:
            got += "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
        warranty = (
            f"This {work} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
            f"MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {title} for more details."
        )
        out[name] = f"This work is licensed under the {title}, version {version}."
        out[f"{name}-notice"] = later
        out[f"{name}-only-notice"] = f"{grant}, version {version} of the License."
        out[f"{name}-whole-notice"] = f"{later} {warranty} {got}"
    return out


def _cc_notices() -> dict[str, str]:
    out = {}
    for kind, title in CC_KINDS.items():
        for version, realm in CC_VERSIONS.items():
            out[f"CC-{kind}-{version}"] = f"Licensed under CC {kind} {version}."
            out[f"CC-{kind}-{version}-notice"] = f"This work is licensed under a Creative Commons {title} {version} {realm} License."
    return out


def _whole_texts(taken: Mapping[str, str]) -> dict[str, str]:
    """The files of ``license_texts``; a name that a statement has already gets ``-text``."""
    files = sorted((f for f in resources.files(__package__).joinpath("license_texts").iterdir() if f.name.endswith(".txt")), key=lambda f: f.name)
    texts = {f.name.removesuffix(".txt"): " ".join(f.read_text(encoding="utf-8").split()).rstrip(".") for f in files}
    return {f"{name}-text" if name in taken else name: text for name, text in texts.items()}


_SHORT = {**LINES, **NOTICES, **_gnu_notices(), **_cc_notices()}
TEMPLATES: Mapping[str, str] = {**_SHORT, **_whole_texts(_SHORT)}


@dataclass
class Words:
    """A text as words: byte range and hash of each."""

    raw: bytes
    begin: np.ndarray
    end: np.ndarray
    hash: np.ndarray

    @classmethod
    def of(cls, text: str) -> Words:
        raw = text.encode("utf-8", "surrogatepass")
        data = np.frombuffer(raw.lower(), np.uint8)
        inside = IN_WORD[data]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
        begin, end = edges[::2], edges[1::2]
        if not len(begin):
            return cls(raw, begin, end, np.zeros(0, np.uint64))
        return cls(raw, begin, end, mix(PolynomialHash(data).of(begin, end - begin)))

    def fingerprints(self, gram: int, window: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word number) of the winnowed grams; the leftmost of equal least hashes."""
        n = len(self.hash) - gram + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        grams = np.zeros(n, np.uint64)
        for k in range(gram):
            grams = mix(grams * np.uint64(0x9E3779B97F4A7C15) + self.hash[k : k + n])
        chosen = np.zeros(n, bool)
        width = min(window, n)
        places = np.lib.stride_tricks.sliding_window_view(grams, width).argmin(axis=1) + np.arange(n - width + 1)
        chosen[places] = True
        at = np.flatnonzero(chosen)
        return grams[at], at


IN_WORD = np.array([chr(b).isascii() and chr(b).isalnum() or b >= 0x80 for b in range(256)])


class TemplateIndex:
    """Sorted fingerprints with the template and word number of each; size follows the templates."""

    def __init__(self, templates: Mapping[str, str], gram: int, window: int):
        self.names, self.words, self.gram, self.window = list(templates), [Words.of(t) for t in templates.values()], gram, window
        found = [(h, i, p) for i, w in enumerate(self.words) for h, p in zip(*w.fingerprints(gram, window), strict=True)]
        found.sort()
        self.hash = np.array([f[0] for f in found], np.uint64)
        self.template = np.array([f[1] for f in found], np.int64)
        self.place = np.array([f[2] for f in found], np.int64)
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *[w.hash for w in self.words]]))
        self.counts = [self.count(self.known(w.hash)) for w in self.words]

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the vocabulary of all templates; one more than the last for other words."""
        at = np.searchsorted(self.vocabulary, hashes)
        inside = at < len(self.vocabulary)
        inside[inside] = self.vocabulary[at[inside]] == hashes[inside]
        return np.where(inside, at, len(self.vocabulary))

    def count(self, known: np.ndarray) -> np.ndarray:
        return np.bincount(known, minlength=len(self.vocabulary) + 1)[: len(self.vocabulary)]

    def most(self, template: int, known: np.ndarray) -> int:
        """No alignment of the template with these words matches more: the words that both have, each as often as in both."""
        return int(np.minimum(self.counts[template], self.count(known)).sum())

    def begins(self, words: Words) -> list[tuple[int, int, int, int]]:
        """(template, least, greatest and most frequent word number where it would begin), from fingerprints in the index."""
        hashes, at = words.fingerprints(self.gram, self.window)
        low, high = np.searchsorted(self.hash, hashes, "left"), np.searchsorted(self.hash, hashes, "right")
        begins: dict[int, list[int]] = {}
        for k in np.flatnonzero(high > low):
            for e in range(low[k], high[k]):
                begins.setdefault(int(self.template[e]), []).append(int(at[k] - self.place[e]))
        out = []
        for t, found in begins.items():
            found.sort()
            band = self.band(t)
            group = found[:1]
            for b in found[1:]:
                if b - group[0] > band:
                    out.append((t, group[0], group[-1], mode(group)))
                    group = []
                group.append(b)
            out.append((t, group[0], group[-1], mode(group)))
        return out

    def band(self, template: int) -> int:
        return max(2, len(self.words[template].hash) // 8)


def align(template: np.ndarray, text: np.ndarray, band: int) -> list[tuple[int, int]]:
    """Matched (template word, text word) pairs of a least-edit alignment of the whole template with a part of ``text``.

    Only cells whose offset lies between -band and len(text) - len(template) + band are filled.
    """
    m, n = len(template), len(text)
    low, high = -band, n - m + band
    width = high - low + 1
    if width <= 0 or not n:
        return []
    big = 1 << 29
    steps = np.arange(width)
    cost = np.where((steps + low >= 0) & (steps + low <= n), 0, big)  # the text before the match is free
    move = np.zeros((m + 1, width), np.int8)
    for i in range(1, m + 1):
        j = steps + (i + low)
        fits = (j >= 0) & (j <= n)
        here = np.where(j >= 1, cost + (template[i - 1] != text[np.clip(j - 1, 0, n - 1)]), big)
        above = np.append(cost[1:], big) + 1
        how = np.where(above < here, 2, 1)
        here = np.where(fits, np.minimum(here, above), big)
        run = np.minimum.accumulate(here - steps) + steps  # text words without a partner, one after another
        move[i] = np.where(fits & (run < big), np.where(run < here, 3, how), 0)
        cost = np.where(fits, run, big)
    d, i, pairs = int(np.argmin(cost)), m, []
    while i > 0 and move[i, d]:
        j = i + d + low
        how = move[i, d]
        if how == 1:
            if template[i - 1] == text[j - 1]:
                pairs.append((i - 1, j - 1))
            i -= 1
        elif how == 2:
            i, d = i - 1, d + 1
        else:
            d -= 1
    return pairs[::-1]


def find_licenses(text: str, index: TemplateIndex, min_coverage: float) -> list[tuple[str, int, int, float]]:
    """(template, start, end, matched share of the template's words), by start.  Of overlapping finds the one with most
    matched words, less those of its template that are missing, stays (then the better share, then the first name): an
    edited notice goes before a line inside it, and a variant is not reported as its siblings too."""
    words = Words.of(text)
    begins = index.begins(words)
    known = index.known(words.hash) if begins else None
    finds: list[tuple[int, float, str, int, int]] = []
    whole: dict[int, list[tuple[int, int]]] = {}  # word ranges of word-for-word copies

    def add(t: int, matched: int, first: int, last: int) -> None:
        m = len(index.words[t].hash)
        finds.append((m - 2 * matched, -matched / m, index.names[t], int(words.begin[first]), int(words.end[last])))

    for t, _, _, at in begins:
        m = len(index.words[t].hash)
        if at >= 0 and np.array_equal(words.hash[at : at + m], index.words[t].hash):
            whole.setdefault(t, []).append((at, at + m))
            add(t, m, at, at + m - 1)
    for t, first, last, _ in begins:
        template, band = index.words[t].hash, index.band(t)
        a, b = max(0, first - band), min(len(words.hash), last + len(template) + band)
        # What overlaps a word-for-word copy of the same template is no better; is there room for another beside it?
        taken = [c for c in whole.get(t, ()) if c[0] < b and a < c[1]]
        edges = [a, *[e for c in sorted(taken) for e in c], b]
        if taken and max(y - x for x, y in zip(edges[::2], edges[1::2], strict=True)) < min_coverage * len(template):
            continue
        if index.most(t, known[a:b]) < min_coverage * len(template):
            continue
        pairs = align(template, words.hash[a:b], band + last - first)
        if len(pairs) >= min_coverage * len(template):
            add(t, len(pairs), a + pairs[0][1], a + pairs[-1][1])
    kept: list[tuple[str, int, int, float]] = []
    for _, share, name, begin, end in sorted(finds):
        if all(end <= b or e <= begin for _, b, e, _ in kept):
            kept.append((name, begin, end, -share))
    chars = lambda at: len(words.raw[:at].decode("utf-8", "surrogatepass"))
    return sorted(((name, chars(a), chars(b), c) for name, a, b, c in kept), key=lambda f: (f[1], f[0]))


def scan_licenses(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: Mapping[str, str] = TEMPLATES,
    gram: int = 3,
    window: int = 2,
    min_coverage: float = 0.8,
) -> DataFrame:
    """``doc_id, n_licenses, licenses, coverage, spans`` per row: distinct names in order, the best coverage (0 without
    a match) and every match as ``name:start:end:coverage``.  One pass over the texts, without a shuffle."""
    base = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    templates = dict(templates)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = TemplateIndex(templates, gram, window)
        for batch in batches:
            rows = []
            for doc, text in batch.itertuples(index=False):
                found = find_licenses(text, index, min_coverage)
                names = ",".join(sorted({f[0] for f in found}))
                rows.append((doc, len(found), names, max((f[3] for f in found), default=0.0), ",".join(f"{n}:{a}:{b}:{c:.3f}" for n, a, b, c in found)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_licenses", "licenses", "coverage", "spans"])

    kind = base.schema["doc_id"].dataType.simpleString()
    return base.mapInPandas(scan, f"doc_id {kind}, n_licenses long, licenses string, coverage double, spans string")
