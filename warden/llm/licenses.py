"""License notices in texts: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

Words are runs of letters and digits in lower case. A template of ``n`` words may be spread over ``SPREAD * n`` words of a
text, by words inserted anywhere, and is found wherever it starts: grid windows of ``(SPREAD + 1) * size`` words start
every ``size >= n`` words, so that each run of ``SPREAD * n`` words lies in some grid window as a whole. A grid window
that holds a template has at least a known Jaccard similarity to it; the number of bands follows from that similarity and
from ``MISSED``, the chance that no band of the two signatures agrees. What the bands retrieve is verified at all starts
in the grid window: the share of the template's five-word shingles in ``SPREAD * n`` words must reach ``CONTAINED``.

Templates of other licenses that share much are siblings, such as those of another version. A run of words counts for a
template only if it holds a larger share of the shingles that the template has before a sibling than of those that the
sibling has before it, or half of the former if there are none of the latter. A template without any before a sibling
yields to the sibling where both are found.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from warden.llm.common import chunks, id_and_text, record_batch
from warden.llm.shingles import SHINGLE, combine, mix, word_hashes

CONTAINED = 0.75
MISSED = 1e-6
SPREAD = 3  # an occurrence spans at most so many times the words of its template
SIBLING = 0.25  # share of the smaller of two templates' shingles that the other has, at least
#: Short notices, four of them the license lines of the given documents. ``license_notices`` has the rest.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "it under the terms of the GNU General Public License as published by the Free Software Foundation, "
                "either version 3 of the License, or (at your option) any later version"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)
_PLAIN = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def bands_for(template: int, window: int, contained: float = CONTAINED, missed: float = MISSED) -> int:
    """Bands of one row that let a window of so many shingles miss a template it holds with a chance below ``missed``."""
    common = math.ceil(contained * template)
    least = common / (template + max(window, common) - common)
    return 1 if least >= 1 else math.ceil(math.log(missed) / math.log(1 - least))


def ordered_shingles(data: bytes) -> tuple[np.ndarray, int]:
    """Hashes of the shingles of plain bytes in order, and the number of words."""
    words, _ = word_hashes(data)
    return (combine(words) if len(words) >= SHINGLE else words[:0]), len(words)


def signature(shingles: np.ndarray, bands: int) -> np.ndarray:
    """The smallest hash of a set of shingles under each of ``bands`` hash functions."""
    out = np.full(bands, np.iinfo(np.uint64).max, dtype=np.uint64)
    seeds = mix(np.arange(1, bands + 1, dtype=np.uint64))
    for a in range(0, len(shingles), 4096):
        np.minimum(out, mix(shingles[a : a + 4096, None] ^ seeds[None, :]).min(axis=0), out=out)
    return out


def grid(words: int) -> int:
    """The distance of the grid windows for a template: its words, rounded up by less than a quarter."""
    step = 1 << max(0, words.bit_length() - 3)
    return -(-words // step) * step


@dataclass
class Scanner:
    """Finds ``templates``, pairs of license and text."""

    templates: tuple[tuple[str, str], ...] = TEMPLATES
    contained: float = CONTAINED
    missed: float = MISSED
    sets: list[np.ndarray] = field(init=False)

    def __post_init__(self):
        self.sets, self.sizes = [], []
        self.levels: dict[int, list[int]] = {}  # templates by the distance of their grid windows
        holders: dict[int, list[int]] = {}
        for t, (name, text) in enumerate(self.templates):
            shingles, words = ordered_shingles(text.encode().translate(_PLAIN))
            if not len(shingles):
                raise ValueError(f"a template of {name} has fewer than {SHINGLE} words")
            own = np.unique(shingles)
            self.sets.append(own)
            self.sizes.append(words)
            self.levels.setdefault(grid(words), []).append(t)
            for s in own.tolist():
                holders.setdefault(s, []).append(t)
        self.bands = {
            size: max(bands_for(len(self.sets[t]), (SPREAD + 1) * size - SHINGLE + 1, self.contained, self.missed) for t in own)
            for size, own in self.levels.items()
        }
        self.at_band: dict[tuple[int, int, int], set[int]] = {}
        for size, own in self.levels.items():
            for t in own:
                for b, value in enumerate(signature(self.sets[t], self.bands[size]).tolist()):
                    self.at_band.setdefault((size, b, value), set()).add(t)
        self.holders = holders
        self._set_siblings()
        self.all = np.array(sorted(holders), dtype=np.uint64)

    def retrieve(self, shingles: np.ndarray, size: int) -> set[int]:
        """Templates with grid windows of this size whose signature agrees with that of these shingles in some band."""
        found: set[int] = set()
        for b, value in enumerate(signature(shingles, self.bands[size]).tolist()):
            found |= self.at_band.get((size, b, value), set())
        return found

    def _set_siblings(self) -> None:
        """For each template: sizes of what it and its siblings have alone, who has which shingle, what it yields to."""
        common: dict[tuple[int, int], int] = {}
        for own in self.holders.values():
            for t in own:
                for u in own:
                    if self.templates[t][0] != self.templates[u][0]:
                        common[t, u] = common.get((t, u), 0) + 1
        self.alone: list[list[tuple[int, int]]] = [[] for _ in self.sets]
        self.marks: list[dict[int, list[int]]] = [{s: [] for s in own.tolist()} for own in self.sets]
        self.yields: list[list[int]] = [[] for _ in self.sets]
        for (t, u), n in sorted(common.items()):
            mine, other = len(self.sets[t]) - n, len(self.sets[u]) - n
            if n < SIBLING * min(len(self.sets[t]), len(self.sets[u])):
                continue
            if not mine:
                self.yields[t] += [u] * (other > 0)
                continue
            k = len(self.alone[t])
            self.alone[t].append((mine, other))
            for x, y, counter in ((t, u, 2 * k), (u, t, 2 * k + 1)):
                for s in np.setdiff1d(self.sets[x], self.sets[y], assume_unique=True).tolist():
                    self.marks[t].setdefault(s, []).append(counter)
        self.looked_at = [np.array(sorted(m), dtype=np.uint64) for m in self.marks]

    def densest(self, t: int, shingles: np.ndarray) -> tuple[float, int, int] | None:
        """(containment, first place, words) of the best run of words: the largest containment, then the shortest, the first.

        Runs that do not tell the template from its siblings are left out. Shorter runs are tried where there are
        siblings, so that a notice is not mixed with that of a sibling beside it.
        """
        look, marks, alone = self.looked_at[t], self.marks[t], self.alone[t]
        places = np.flatnonzero(look[np.minimum(np.searchsorted(look, shingles), len(look) - 1)] == shingles)
        met = list(zip(places.tolist(), shingles[places].tolist(), strict=True))
        mine = set(self.sets[t].tolist())
        best = None
        for spread in range(SPREAD, 0, -1) if alone else (SPREAD,):
            held: dict[int, int] = {}
            counts, own, first = [0] * (2 * len(alone)), 0, 0
            for place, shingle in met:
                held[shingle] = held.get(shingle, 0) + 1
                if held[shingle] == 1:
                    own += shingle in mine
                    for k in marks[shingle]:
                        counts[k] += 1
                while (a := met[first])[0] < place and (
                    place - a[0] > spread * self.sizes[t] - SHINGLE or held[a[1]] > 1 or a[1] not in mine
                ):
                    held[a[1]] -= 1
                    if not held[a[1]]:
                        own -= a[1] in mine
                        for k in marks[a[1]]:
                            counts[k] -= 1
                    first += 1
                if shingle not in mine or own < self.contained * len(mine):
                    continue
                run = own, a[0] - place, -a[0]
                if (best is None or run > best) and all(
                    counts[2 * k] * other > counts[2 * k + 1] * size if other else 2 * counts[2 * k] >= size for k, (size, other) in enumerate(alone)
                ):
                    best = run
        return best and (best[0] / len(mine), -best[2], SHINGLE - best[1])

    def scan(self, text: str) -> list[tuple[int, float, int, int]]:
        """(template, containment, first word, words) of the best run of each template that the text holds.

        Only a shingle of a template can make a band agree with it, so a window without one gets no signature.
        """
        shingles, _ = ordered_shingles(text.encode().translate(_PLAIN))
        place = np.minimum(np.searchsorted(self.all, shingles), len(self.all) - 1) if len(self.all) else shingles
        hits = np.flatnonzero(self.all[place] == shingles) if len(self.all) else []
        at: dict[int, list[int]] = {}
        for h in [] if not len(hits) else hits.tolist():
            for t in self.holders[int(shingles[h])]:
                at.setdefault(t, []).append(h)
        best: dict[int, tuple[float, int, int]] = {}
        for size, own in self.levels.items():
            reach = (SPREAD + 1) * size - SHINGLE + 1  # shingles in a grid window
            starts = {
                i * size for t in own for h in at.get(t, ()) for i in range(max(0, h // size - SPREAD), h // size + 1)
                if h < i * size + reach
            }
            for a in sorted(starts):
                cuts = {t: (bisect_left(at[t], a), bisect_left(at[t], a + reach)) for t in own if t in at}
                if all(x == y or best.get(t, ())[::2] == (1, len(self.sets[t]) + SHINGLE - 1) for t, (x, y) in cuts.items()):
                    continue  # no run here can be better: those found are whole, without a word between
                for t in self.retrieve(np.unique(shingles[a : a + reach]), size):
                    run = self.densest(t, shingles[a : a + reach])
                    if run is None:
                        continue
                    run = run[0], a + run[1], run[2]
                    if t not in best or (-run[0], run[2], run[1]) < (-best[t][0], best[t][2], best[t][1]):
                        best[t] = run

        def meet(t: int, u: int) -> bool:
            (_, a, n), (_, b, m) = best[t], best[u]
            return a < b + m and b < a + n

        return [(t, *best[t]) for t in sorted(best) if not any(u in best and meet(t, u) for u in self.yields[t])]


_MATCH = pa.schema([
    ("doc_id", pa.int64()), ("license", pa.string()), ("template", pa.int32()), ("containment", pa.float64()),
    ("first_word", pa.int64()), ("window_words", pa.int64()),
])


def scan_licenses(documents: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """doc_id, license, template, containment, first_word, window_words: a row for each template that a text holds.

    The best run of words for a template counts: the largest containment, then the shortest, the first of equal ones.
    It begins and ends with words of the template. Null and empty texts hold none. Rows with one doc_id,
    or none, are each scanned; whole texts are, at any length. Other columns are not read.
    """
    shared = documents.sparkSession.sparkContext.broadcast(scanner or Scanner())  # its size is that of the templates

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = shared.value
        for batch in chunks(batches):
            rows = [
                (doc, scanner.templates[t][0], t, share, first, size)
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True)
                for t, share, first, size in scanner.scan(text)
            ]
            if rows:
                yield record_batch(_MATCH, **dict(zip(_MATCH.names, zip(*rows, strict=True), strict=True)))

    return id_and_text(documents).mapInArrow(
        run, "doc_id bigint, license string, template int, containment double, first_word bigint, window_words bigint"
    )
