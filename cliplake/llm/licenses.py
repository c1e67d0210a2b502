"""License scans: winnowed fingerprints find candidates, banded alignment reports spans.

Templates are few and given as a parameter, so their inverted index (fingerprint to
template and position) is small and travels with the task; texts never move. A text's
winnowed fingerprints that are in the index vote for (template, diagonal); close diagonals
form one candidate, which is aligned in a band around them. A place counts only with the
tokens that tell its template from others: the template's ``DECIDING`` words, and of the
tokens that a template has and another one that would pass for it lacks at least the
same share as of all.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliplake.llm.text import LOWER, U, Texts, grams, hash_ranges, runs, slices

K, WINDOW = 3, 2  # tokens of a fingerprint, fingerprints of a window: runs of 4 tokens are seen
BAND = 8  # most tokens inserted or left out between two hits of one candidate, a quarter of a short template
INDEX_TOKENS = 1_000_000  # most tokens of all templates together
TOKEN = np.zeros(256, bool)  # a-z, 0-9 and all non-ASCII bytes
TOKEN[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True

# Notices and license texts, fixed values.
TEMPLATES = {
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0 notice": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0 notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-ND-4.0 notice": "Licensed under CC BY-ND 4.0.",
    "CC-BY-NC-SA-4.0 notice": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-NC-ND-4.0 notice": "Licensed under CC BY-NC-ND 4.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0 notice": "This work is licensed under the GNU General Public License, version 2.",
    "LGPL-3.0 notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "LGPL-2.1 notice": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "AGPL-3.0 notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "MIT notice": "Released under the MIT License.",
    "BSD-3-Clause notice": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause notice": "Released under the BSD 2-Clause License.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    'associated documentation files (the "Software"), to deal in the Software without restriction, including '
    "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
    "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
    "following conditions: The above copyright notice and this permission notice shall be included in all copies "
    "or substantial portions of the Software.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted "
    "provided that the following conditions are met: 1. Redistributions of source code must retain the above "
    "copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
    "reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation "
    "and/or other materials provided with the distribution.",
    "Apache-2.0 header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file "
    "except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0",
    "GPL header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at "
    "your option) any later version.",
}
# Words of a template without which a text names another license, or another version.
DECIDING = {
    "CC-BY-NC-4.0 notice": "cc by nc 4",
    "CC-BY-4.0 notice": "cc by 4",
    "CC-BY-SA-4.0 notice": "cc by sa 4",
    "CC-BY-ND-4.0 notice": "cc by nd 4",
    "CC-BY-NC-SA-4.0 notice": "cc by nc sa 4",
    "CC-BY-NC-ND-4.0 notice": "cc by nc nd 4",
    "GPL-3.0 notice": "general public 3",
    "GPL-2.0 notice": "general public 2",
    "LGPL-3.0 notice": "lesser general public 3",
    "LGPL-2.1 notice": "lesser general public 2 1",
    "AGPL-3.0 notice": "affero general public 3",
    "Apache-2.0 notice": "apache 2",
    "MIT notice": "mit",
    "BSD-3-Clause notice": "bsd 3",
    "BSD-2-Clause notice": "bsd 2",
}


def tokens(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and hash of the tokens: runs of letters and digits, A-Z lower-cased."""
    data = LOWER[texts.data]
    start, end = runs(TOKEN[data], texts.offsets)
    return start, end, np.searchsorted(texts.offsets[1:], start, "right"), hash_ranges(data, start, end)


def winnow(hashes: np.ndarray, doc: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which fingerprints to keep: the smallest of every window within a text (the last of
    equals), all of a text with less than a window."""
    n = len(hashes)
    keep = np.zeros(n, bool)
    if n == 0:
        return keep
    count = np.bincount(doc)
    keep |= count[doc] < window
    if n >= window:
        view = np.lib.stride_tricks.sliding_window_view(hashes, window)
        least = np.arange(len(view)) + window - 1 - np.argmin(view[:, ::-1], axis=1)
        keep[least[doc[: len(view)] == doc[window - 1 :]]] = True
    return keep


def align(template: np.ndarray, text: np.ndarray, first: int, low: int, high: int) -> tuple[int, int, int]:
    """Best alignment of the template with ``text`` (whose first token has number ``first``)
    on diagonals ``low..high`` (text minus template): matched tokens, first and last token.

    A longest common subsequence in the band. Ties take the shorter span, then the earlier.
    """
    return aligned(template, text, first, low, high, [0] * len(template))[:3]


def aligned(
    template: np.ndarray, text: np.ndarray, first: int, low: int, high: int, bits: Sequence[int]
) -> tuple[int, int, int, int]:
    """As ``align``, and the bits (one number for each template token) of the matched tokens."""
    width = high - low + 1
    none = (0, 0, 0, 0)  # matched, minus the span so far, minus the start, bits
    row = [none] * (width + 1)
    best, at = none, (0, 0)
    for i, token in enumerate(template):
        new = [none] * (width + 1)
        for b in range(width):
            j = i + low + b - first
            # row[b] is the diagonal neighbour, row[b + 1] skips a template token, new[b - 1] a text token
            top = max(row[b + 1], (new[b - 1][0], new[b - 1][1] - 1, *new[b - 1][2:]) if b and new[b - 1][0] else none)
            if 0 <= j < len(text) and text[j] == token:
                before = row[b]
                step = (before[0] + 1, before[1] - 1, before[2] if before[0] else -j, before[3] | bits[i])
                if step > top:
                    top = step
                if step > best:
                    best, at = step, (-step[2], j)
            elif row[b][0]:
                top = max(top, (row[b][0], row[b][1] - 1, *row[b][2:]))
            new[b] = top
        row = new
    return best[0], at[0] + first, at[1] + first, best[3]


class Index:
    """Fingerprints of all templates in sorted order with template number and position."""

    def __init__(self, templates: Mapping[str, str], deciding: Mapping[str, str] | None = None, coverage: float = 0.8):
        self.names = list(templates)
        texts = next(slices(pa.array(list(templates.values()), pa.string()), 1 << 62), None)
        if texts is None:
            raise ValueError("no templates")
        _, _, doc, hashes = tokens(texts)
        if len(doc) > INDEX_TOKENS:
            raise ValueError(f"{len(doc)} template tokens; at most {INDEX_TOKENS} travel with a task")
        self.tokens = [hashes[doc == i] for i in range(len(self.names))]
        self.band = np.array([min(BAND, max(1, len(t) // 4)) for t in self.tokens])
        prints, at = grams(hashes, doc, K)
        start = np.searchsorted(doc, np.arange(len(self.names)))
        # every fingerprint of a template is indexed, so any winnowed one of a text meets it
        order = np.argsort(prints, kind="stable")
        self.prints, self.template = prints[order], doc[at][order]
        self.position = at[order] - start[self.template]
        # (bits, how many of them must match) per template
        self.groups: list[list[tuple[int, int]]] = [[] for _ in self.names]
        every = [[1 << i for i in range(len(t))] for t in self.tokens]
        apart: list[list[tuple[int, int]]] = [[] for _ in self.names]
        for other, t, _, _, matched, bits in places(texts, self, coverage, every):
            if other != t and matched < len(self.tokens[t]):
                lacks = (1 << len(self.tokens[t])) - 1 & ~bits
                apart[t].append((lacks, math.ceil(coverage * lacks.bit_count() - 1e-9)))
        for i, name in enumerate(self.names):
            words = next(slices(pa.array([(deciding or {}).get(name, "")], pa.string()), 1 << 62), None)
            must = set() if words is None else set(tokens(words)[3].tolist())
            own = sum(1 << j for j, token in enumerate(self.tokens[i].tolist()) if token in must)
            self.groups[i] = sorted({*apart[i], *([(own, own.bit_count())] if own else [])})
        used = [reduce(or_, (bits for bits, _ in g), 0) for g in self.groups]
        self.bits = [[b & u for b in e] for e, u in zip(every, used)]

    def decided(self, template: int, bits: int) -> bool:
        """Whether the matched tokens tell the template from others."""
        return all((bits & group).bit_count() >= least for group, least in self.groups[template])

    def hits(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the print, number of the index entry) for every equal pair."""
        low, high = np.searchsorted(self.prints, prints, "left"), np.searchsorted(self.prints, prints, "right")
        which = np.repeat(np.arange(len(prints)), high - low)
        offset = np.arange(len(which)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        return which, low[which] + offset


def strongest(
    found: list[tuple[int, int, int, int, int]], lengths: Sequence[int]
) -> list[tuple[int, int, int, int, int]]:
    """Of places that overlap, the one with most matched tokens, of these the one with the
    largest share of its template (of ``lengths`` tokens), then the shortest span (then the
    first template); byte ranges of different texts never overlap."""
    kept: list[tuple[int, int]] = []
    out = []
    for x in sorted(found, key=lambda x: (-x[4], lengths[x[1]], x[3] - x[2], x[2], x[1])):
        i = bisect.bisect(kept, (x[2], x[3]))
        if (i == 0 or kept[i - 1][1] <= x[2]) and (i == len(kept) or kept[i][0] >= x[3]):
            kept.insert(i, (x[2], x[3]))
            out.append(x)
    return sorted(out, key=lambda x: (x[0], x[2]))


def places(
    texts: Texts, index: Index, coverage: float, bits: Sequence[Sequence[int]]
) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(text, template, first token's byte, last token's end, matched tokens, their ``bits``)
    of all places, also overlapping ones."""
    start, end, doc, hashes = tokens(texts)
    prints, at = grams(hashes, doc, K)
    keep = winnow(prints, doc[at])
    prints, at = prints[keep], at[keep]
    which, entry = index.hits(prints)
    if not len(which):
        return
    bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
    d, t = doc[at[which]], index.template[entry]
    diagonal = at[which] - index.position[entry]
    order = np.lexsort((diagonal, t, d))
    d, t, diagonal = d[order], t[order], diagonal[order]
    fresh = np.ones(len(d), bool)
    fresh[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (np.diff(diagonal) > index.band[t[1:]])
    groups = np.append(np.flatnonzero(fresh), len(d))
    for g, h in zip(groups[:-1], groups[1:]):
        template = index.tokens[t[g]]
        low, high = int(diagonal[g] - index.band[t[g]]), int(diagonal[h - 1] + index.band[t[g]])
        a, b = max(bounds[d[g]], low), min(bounds[d[g] + 1], high + len(template))
        matched, first, last, seen = aligned(template, hashes[a:b], int(a), low, high, bits[t[g]])
        if matched >= coverage * len(template):
            yield int(d[g]), int(t[g]), int(start[first]), int(end[last]), matched, seen


def matches(texts: Texts, index: Index, coverage: float) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, template, first token's byte, last token's end, matched tokens)."""
    found = [p[:5] for p in places(texts, index, coverage, index.bits) if index.decided(p[1], p[5])]
    yield from strongest(found, [len(t) for t in index.tokens])


def license_spans(
    docs: DataFrame, templates: Mapping[str, str] | None = None, coverage: float = 0.8,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``(doc_id, license, start_char, end_char, matched, coverage)``: a row for each place
    where at least ``coverage`` of a template's tokens stand in order, with those that tell
    the template from others. Of overlapping places the one with most matched tokens is
    reported, of equals the one that covers its template best.

    Spans are code points, the end exclusive. Places of one template whose diagonals are
    within its band are one. Null and empty texts and texts of fewer than ``K``
    tokens match nothing; repeated rows each give their rows; ids may be null; other
    columns are not read.
    """
    index = Index(TEMPLATES, DECIDING, coverage) if templates is None else Index(templates, None, coverage)
    names = ["doc_id", "license", "start_char", "end_char", "matched", "coverage"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in slices(batch.column(1)):
                found = list(matches(texts, index, coverage))
                if not found:
                    continue
                points = np.concatenate(([0], np.cumsum((texts.data & 0xC0) != 0x80)))
                d, t, a, b, m = map(np.array, zip(*found))
                base = points[texts.offsets[d]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(texts.first + d)),
                        pa.array([index.names[i] for i in t]),
                        pa.array(points[a] - base, pa.int64()),
                        pa.array(points[b] - base, pa.int64()),
                        pa.array(m, pa.int64()),
                        pa.array(m / np.array([len(index.tokens[i]) for i in t]), pa.float64()),
                    ],
                    names,
                )

    schema = "doc_id bigint, license string, start_char bigint, end_char bigint, matched bigint, coverage double"
    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, schema)
