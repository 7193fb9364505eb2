"""License scans: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies.

Texts and templates are sequences of shingles of five words (of all words, for a template of fewer).  Templates are dealt
into classes by length; a class has one window length, a power of two that its templates fill.  Each document is covered by
windows of that length that overlap by three quarters, the first at its beginning (at all positions for windows under eight shingles), so that what is found
does not depend on the documents beside it; every position of a template is a window too, so a verbatim passage always holds a window equal to one of the template's.
``BANDS`` bands of ``ROWS`` minima retrieve a template from a window of similarity s with probability 1 - (1 - s^ROWS)^BANDS: 0.996
at 0.7 and above 0.9999 at 0.8, for each of the windows that a passage fills.

A retrieved template is verified over the whole document: the shares of the template's distinct shingles found, word by word, within a stretch of its
length and a quarter more; stretches that reach ``CONTAINMENT`` are matches, best first, without overlap.

Null and empty texts match nothing; repeated rows each get their matches; other columns, whatever their names, are not carried.  Templates are a
small fixed table (checked: at most ``TEMPLATE_WORDS`` words), sent with the code.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import texts
from .decontam import words_of
from .near_dedup import _MIX, SHINGLE, multipliers, shingles, word_hashes

BANDS, ROWS, CONTAINMENT, TEMPLATE_WORDS = 8, 2, 0.8, 100_000
#: Fixed texts: wording of well-known licences and of the usual notices that refer to them.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
        (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
        distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that
        it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation; either version 2 of the License, or (at your option) any later version."""),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
        Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation
        and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
        copyright notice and this permission notice appear in all copies."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
        distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
)


def window_length(n: int) -> int:
    """The window length for a template of ``n`` shingles; from 8 on a quarter of it fits beside it in the template."""
    return 1 << (n.bit_length() - 1) if n < 8 else 1 << (int(n / 1.25).bit_length() - 1)


def window_keys(x: np.ndarray, lengths: list[int], begins: np.ndarray, ends: np.ndarray, every: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, keys as bands x windows) for each of the ascending window lengths.

    ``begins`` and ``ends`` bound the documents in ``x``; windows lie within one.  Minima of stretches that double in length are shared by all lengths.
    ``every``: at all positions, else at each quarter of a length.
    """
    with np.errstate(over="ignore"):
        low = x.astype(np.uint32)[None, :] * multipliers(BANDS * ROWS).astype(np.uint32)[:, None]
        width = 1
        for length in lengths:
            if low.shape[1] < length - width + 1:
                return
            while width < length:
                low = np.minimum(low[:, :-width], low[:, width:])
                width *= 2
            step = 1 if every or length < 8 else length // 4
            counts = np.maximum((ends - begins - length) // step + 1, 0)
            before = np.cumsum(counts) - counts
            positions = np.repeat(begins - step * before, counts) + step * np.arange(int(counts.sum()))
            own = low[: ROWS if length == 1 else None, positions].astype(np.uint64)  # one shingle: one band says all
            keys = own[0::ROWS] + np.arange(1, len(own) // ROWS + 1, dtype=np.uint64)[:, None]
            for k in range(1, ROWS):
                keys = keys * _MIX + own[k::ROWS]
            yield length, positions, keys * _MIX


class Index:
    BITS = 20

    def __init__(self, templates=TEMPLATES):
        assert sum(len(words_of(t)) for _, t in templates) <= TEMPLATE_WORDS, "templates are a small table"
        self.templates = []  # name, words, size of shingle, distinct shingles by hash, their words
        found: dict[tuple[int, int], list] = {}
        for name, text in templates:
            words = words_of(text)
            if words:
                size = min(SHINGLE, len(words))
                x = shingles(word_hashes(words), size)
                for length, _, keys in window_keys(x, [window_length(len(x))], np.array([0]), np.array([len(x)]), every=True):
                    found.setdefault((size, length), []).extend((int(k), len(self.templates)) for k in keys.ravel())
                by_hash = {int(h): words[i : i + size] for i, h in enumerate(x)}
                assert len(by_hash) == len({tuple(w) for w in by_hash.values()}) == len({tuple(words[i : i + size]) for i in range(len(x))}), "hashes of a template differ"
                self.templates.append((name, len(words), size, np.unique(x), by_hash))
        self.lengths: dict[int, list[int]] = {}
        self.keys = {}
        for (size, length), own in sorted(found.items()):
            keys = np.array(sorted({k for k, _ in own}), dtype=np.uint64)
            owners: dict[int, set[int]] = {}
            for k, t in own:
                owners.setdefault(k, set()).add(t)
            first = np.zeros(1 << self.BITS, dtype=bool)
            first[keys >> np.uint64(64 - self.BITS)] = True
            self.lengths.setdefault(size, []).append(length)
            self.keys[size, length] = (first, keys, owners)

    def retrieve(self, x: np.ndarray, size: int, begins: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(position, template) of windows that share a band with a template."""
        for length, positions, keys in window_keys(x, self.lengths[size], begins, ends):
            first, wanted, owners = self.keys[size, length]
            maybe = first[keys >> np.uint64(64 - self.BITS)]
            windows, keys = np.nonzero(maybe)[1], keys[maybe]
            at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            for i in np.flatnonzero(wanted[at] == keys):
                for template in owners[int(keys[i])]:
                    yield int(positions[windows[i]]), template

    def verify(self, template: int, x: np.ndarray, text: list[bytes], containment: float) -> list[tuple[float, int, int]]:
        """(share, first word, last word) of stretches that hold enough of the template, best first, without overlap; ``x``: the hashed shingles of ``text``."""
        _, words, size, wanted, by_hash = self.templates[template]
        where = np.searchsorted(wanted, x)
        hits = np.flatnonzero(wanted[np.minimum(where, len(wanted) - 1)] == x)
        hits = np.array([i for i in hits if text[i : i + size] == by_hash[int(x[i])]], dtype=np.int64)
        if not len(hits):
            return []
        kinds, most = where[hits], max(1, int(1.25 * words) - size + 1)
        found, counts, begin, distinct = [], {}, 0, 0
        for end in range(len(hits)):
            counts[kinds[end]] = counts.get(kinds[end], 0) + 1
            distinct += counts[kinds[end]] == 1
            while hits[end] - hits[begin] >= most:
                counts[kinds[begin]] -= 1
                distinct -= counts[kinds[begin]] == 0
                begin += 1
            while counts[kinds[begin]] > 1:  # the shortest stretch with these shingles
                counts[kinds[begin]] -= 1
                begin += 1
            if distinct >= containment * len(wanted):
                found.append((distinct / len(wanted), int(hits[begin]), int(hits[end]) + size))
        out: list[tuple[float, int, int]] = []
        taken: list[tuple[int, int]] = []
        for share, a, b in sorted(found, key=lambda f: (-f[0], f[1], f[2])):
            i = np.searchsorted([t[0] for t in taken], a) if taken else 0
            if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or taken[i][0] >= b):
                taken.insert(int(i), (a, b))
                out.append((share, a, b))
        return out

    def find(self, texts: list[str | None], containment: float = CONTAINMENT) -> list[list[dict]]:
        """For each text its matches by position: licence, first word, end word (exclusive), containment.

        The words of all texts stand in one row, so that short texts share the work; windows lie within one text.
        """
        words = [words_of(t) for t in texts]
        ends = np.cumsum([len(w) for w in words])
        begins = ends - [len(w) for w in words]
        hashes = word_hashes([x for w in words for x in w])
        best: list[dict[tuple, float]] = [{} for _ in texts]
        for size in self.lengths:
            if len(hashes) < size:
                continue
            x = shingles(hashes, size)
            retrieved = {(int(np.searchsorted(ends, position, side="right")), template) for position, template in self.retrieve(x, size, begins, np.maximum(ends - size + 1, begins))}
            for i, template in retrieved:
                begin = int(begins[i])
                for share, a, b in self.verify(template, x[begin : max(begin, int(ends[i]) - size + 1)], words[i], containment):
                    key = (self.templates[template][0], a, b)
                    best[i][key] = max(best[i].get(key, 0), share)
        out = []
        for own in best:
            spans = sorted(((n, a, b, s) for (n, a, b), s in own.items()), key=lambda m: (m[1], -m[2], m[0]))
            out.append([{"license": n, "start": a, "end": b, "containment": s} for n, a, b, s in spans])
        return out


def grouped(texts: list[str | None], chars: int = 400_000) -> Iterator[list[str | None]]:
    """Lists of whole texts with about ``chars`` characters each."""
    own, size = [], 0
    for text in texts:
        own.append(text)
        size += len(text or "")
        if size >= chars:
            yield own
            own, size = [], 0
    if own:
        yield own


_MATCH = "array<struct<license:string,start:long,end:long,containment:double>>"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """``(id, matches)`` for every row; start and end count words."""
    rows = texts(docs, id_col, text_col)
    index = Index(templates)
    kind = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m for some in grouped(batch.column(1).to_pylist()) for m in index.find(some, containment)], kind)], names=["id", "matches"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, matches {_MATCH}")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return found.select(
        F.col("id").alias(id_col),
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["license"], m["start"].cast("string"), m["end"].cast("string"))), ",").alias("spans"),
    )
