"""Licences in texts by the Dice coefficient over word bigrams.

Each line and each paragraph of a text is normalised and compared with the templates. A template
is only compared where the number of bigrams allows the threshold, and only if it has a
bigram of the passage. Texts without any word that a match cannot lack are passed over.

Notices inside a longer line or paragraph are found by windows of words: around each place of a
bigram that a match cannot lack, all spans of a size that allows the threshold are compared.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import once_per_worker, per_slice, whole_text

THRESHOLD = 0.8
SCHEMA = "doc_id long, passage int, kind string, license string, dice double, text string"

#: Names and notices of licences. Fixed values.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Licensed under the BSD 3-Clause License.",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2.",),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",),
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

_WORD = re.compile(r"[^\W_]+(?:\.[0-9]+)*")
_GAP = re.compile(r"\n[\x20\x09\x0D]*\n\s*")


def words(text: str) -> list[str]:
    """Lower-case words; signs fall away, version numbers stay whole."""
    return _WORD.findall(text.lower())


def bigrams(own: list[str]) -> frozenset[tuple[str, str]]:
    """Pairs of neighbours between a mark at the start and one at the end, so a single word has two."""
    return frozenset(zip(["^", *own], [*own, "$"])) if own else frozenset()


def dice(a: frozenset, b: frozenset) -> float:
    return 2 * len(a & b) / (len(a) + len(b)) if a and b else 0.0


@dataclass
class Scanner:
    threshold: float = THRESHOLD

    def __post_init__(self) -> None:
        self._sets = [(name, bigrams(words(t))) for name, ts in sorted(TEMPLATES.items()) for t in ts]
        self._having = defaultdict(set)
        for i, (_, s) in enumerate(self._sets):
            for b in s:
                self._having[b].add(i)
        sizes = [len(s) for _, s in self._sets]
        # 2 min(a, b) / (a + b) reaches t only if min >= t / (2 - t) max
        self._ratio = self.threshold / (2 - self.threshold)
        self._signs = sorted({w for _, s in self._sets for w in self._signature(s)})
        self._least, self._most = min(sizes) * self._ratio, max(sizes) / self._ratio
        texts = [words(t) for _, ts in sorted(TEMPLATES.items()) for t in ts]
        self._ends = [(own[0], own[-1]) for own in texts]
        self._anchors = defaultdict(list)
        for i, own in enumerate(texts):
            for b in self._anchor_pairs(own, len(self._sets[i][1])):
                self._anchors[b].append(i)

    def _signature(self, template: frozenset) -> list[str]:
        """Words one of which every match has: without all of them more bigrams are missing than a match can lack."""
        allowed = len(template) * (1 - self._ratio) + 1e-9
        chosen: list[str] = []
        for w in sorted({w for pair in template for w in pair} - {"^", "$"}, key=lambda w: (-len(w), w)):
            chosen.append(w)
            if sum(a in chosen or b in chosen for a, b in template) > allowed:
                return chosen
        return chosen

    def _anchor_pairs(self, own: list[str], size: int) -> list[tuple[str, str]]:
        """Bigrams one of which every match has, those in the fewest templates first."""
        inner = sorted(set(zip(own, own[1:])), key=lambda b: (len(self._having[b]), -len(b[0]) - len(b[1]), b))
        return inner[: int(size * (1 - self._ratio) + 1e-9) + 1]

    def may_match(self, lower: str) -> bool:
        return any(w in lower for w in self._signs)

    def match(self, text: str) -> tuple[str, float] | None:
        """Best template at or over the threshold (ties: first name) and its coefficient."""
        own = words(text) if self.may_match(text.lower()) else []
        if not own:
            return None
        pairs = bigrams(own)
        n = len(pairs)
        if not self._least <= n <= self._most:
            return None
        some = {i for b in pairs if b in self._having for i in self._having[b]}
        best = None
        for i in sorted(some):
            name, s = self._sets[i]
            if min(n, len(s)) >= self._ratio * max(n, len(s)) - 1e-9:
                d = dice(pairs, s)
                if d >= self.threshold and (best is None or d > best[1]):
                    best = (name, d)
        return best

    def _best_in(self, i: int, own: list[str], lo: int, hi: int) -> tuple[float, int, int] | None:
        """(dice, start, end) of the best span of words lo to hi - 1 for template i; of equal ones the first and shortest."""
        template, (first, last) = self._sets[i][1], self._ends[i]
        size = len(template)
        inner = [(a, b) in template for a, b in zip(own[lo : hi - 1], own[lo + 1 : hi])]
        if len({(own[lo + j], own[lo + j + 1]) for j, hit in enumerate(inner) if hit}) < size * self._ratio - 2 - 1e-9:
            return None  # the marks at both ends make two at most
        n = hi - lo
        # a span that starts or ends elsewhere is no worse without its outer word
        starts = [j for j in range(n) if (j < n - 1 and inner[j]) or own[lo + j] == first]
        stops = [(j > 0 and inner[j - 1]) or own[lo + j] == last for j in range(n)]
        best = None
        for j in starts:
            pairs: set[tuple[str, str]] = set()
            common, most = own[lo + j] == first, size / self._ratio + 1e-9
            for k in range(j, n):
                if k > j and (b := (own[lo + k - 1], own[lo + k])) not in pairs:
                    pairs.add(b)
                    if len(pairs) + 2 > most:
                        break
                    common += b in template
                if stops[k]:
                    d = 2 * (common + (own[lo + k] == last)) / (len(pairs) + 2 + size)
                    if d >= self.threshold and (best is None or d > best[0]):
                        best = (d, lo + j, lo + k + 1)
        return best

    def spans(self, text: str) -> list[tuple[float, str, int, int, int]]:
        """(dice, license, first word, start, end): the best spans of words that do not overlap, by place."""
        if not self.may_match(text.lower()):
            return []
        at = [m.span() for m in _WORD.finditer(text)]
        own = [text[a:b].lower() for a, b in at]
        places = defaultdict(list)
        for p, b in enumerate(zip(own, own[1:])):
            for i in self._anchors.get(b, ()):
                places[i].append(p)
        found = []
        for i, held in places.items():
            name, template = self._sets[i]
            reach = int(len(template) / self._ratio + 1e-9) + 2
            todo = [(max(0, p + 2 - reach), min(len(own), p + reach)) for p in held]
            while todo:
                lo, hi = todo.pop()
                if hi - lo > 1 and (best := self._best_in(i, own, lo, hi)):
                    found.append((best[0], name, best[1], best[2]))
                    todo += [(lo, best[1]), (best[2], hi)]
        chosen: list[tuple[int, int, float, str]] = []
        for d, name, a, b in sorted(set(found), key=lambda f: (-f[0], f[2] - f[3], f[1], f[2])):
            k = bisect_left(chosen, (a,))
            if (k == 0 or chosen[k - 1][1] <= a) and (k == len(chosen) or b <= chosen[k][0]):
                chosen.insert(k, (a, b, d, name))
        return [(d, name, a, at[a][0], at[b - 1][1]) for a, b, d, name in chosen]

    def scan(self, text: str) -> list[tuple[int, str, str, float, str]]:
        """(passage, kind, license, dice, text): lines, and paragraphs of several lines, numbered from 0 each,
        and spans, numbered by their first word, that neither lie in one of these nor overlap one that matches as well."""
        out, known = [], []
        if not self.may_match(text.lower()):
            return out
        start = 0
        for i, line in enumerate(text.split("\n")):
            if line and (m := self.match(line)):
                out.append((i, "line", *m, line))
                known.append((start, start + len(line), m[1]))
            start += len(line) + 1
        if "\n" in text:
            ends = [*((g.start(), g.end()) for g in _GAP.finditer(text)), (len(text), len(text))]
            start = 0
            for i, (end, after) in enumerate(ends):
                paragraph = text[start:end]
                if "\n" in paragraph.strip() and (m := self.match(paragraph)):
                    out.append((i, "paragraph", *m, paragraph))
                    known.append((start, end, m[1]))
                start = after
        for d, name, word, a, b in self.spans(text):
            if not any((x <= a and b <= y) or (a < y and x < b and best >= d) for x, y, best in known):
                out.append((word, "span", name, d, text[a:b]))
        return out


def scan(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Licence passages of all texts: (doc_id, passage, kind, license, dice, text).

    Texts without one, null and empty texts give no rows; a null doc_id stays null; repeated
    rows give repeated results; other columns are not read. Of equal coefficients the first
    name counts. A notice inside a longer line or paragraph is a row of kind ``span`` with just
    its own words. One narrow pass over whole texts.
    """

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        scanner = once_per_worker(f"licences {threshold}", lambda: Scanner(threshold))
        found = [(doc, *hit) for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for hit in scanner.scan(text)]
        cols = list(zip(*found)) if found else [()] * 6
        types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.string())
        return pa.record_batch([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "passage", "kind", "license", "dice", "text"])

    flat = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return flat.mapInArrow(per_slice(run, "text"), SCHEMA)
