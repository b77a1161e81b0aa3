"""License scan by conditional compression."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column

# Public license notices and wordings, by SPDX name.
TEMPLATES = {
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, merge, "
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
        "to whom the Software is furnished to do so, subject to the following conditions:",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file '
        "except in compliance with the License. You may obtain a copy of the License at",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation; either version "
        "2 of the License, or (at your option) any later version.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU General Public License as published by the Free Software Foundation, either version "
        "3 of the License, or (at your option) any later version.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation; either "
        "version 2.1 of the License, or (at your option) any later version.",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Lesser General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of "
        "the GNU Affero General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a "
        "copy of the MPL was not distributed with this file, You can obtain one at",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. 3. Neither the name of the copyright holder nor "
        "the names of its contributors may be used to endorse or promote products derived from this "
        "software without specific prior written permission.",
    ],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met: 1. Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following "
        "disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution.",
    ],
    "BSD-2-Clause OR BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met:",
    ],
    "BSL-1.0": [
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy "
        'of the software and accompanying documentation covered by this license (the "Software") to '
        "use, reproduce, display, distribute, execute, and transmit the Software, and to prepare "
        "derivative works of the Software, and to permit third-parties to whom the Software is "
        "furnished to do so, all subject to the following:",
        "Distributed under the Boost Software License, Version 1.0.",
    ],
    "EPL-2.0": [
        "This program and the accompanying materials are made available under the terms of the "
        "Eclipse Public License 2.0 which is available at",
    ],
    "Zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will "
        "the authors be held liable for any damages arising from the use of this software. Permission "
        "is granted to anyone to use this software for any purpose, including commercial "
        "applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions:",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or "
        "without fee is hereby granted, provided that the above copyright notice and this permission "
        "notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "Licensed under the Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0.",
        "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.",
    ],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0."],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.",
    ],
    "CC0-1.0": ["Released under CC0 1.0 Universal.", "Dedicated to the public domain under CC0 1.0."],
    "Unlicense": ["This is free and unencumbered software released into the public domain."],
}
# Words in which licenses of otherwise like wordings differ, and their versions.
MARKS = frozenset("affero lesser library noncommercial noderivatives sharealike".split())
VERSIONS = frozenset("1 1.0 2 2.0 2.1 3 3.0 4 4.0".split())
CUES = r"(?i)licen[cs]|subject to the terms|copyright|permission|redistribut|public domain|free software|CC0"
# A word that a line ends in at its hyphen goes on behind the marks that start the next line.
BREAK = r"(?<=-)\r?\n[ \t#*/;>]*"
WORDS = re.compile(rf"[^\W_]+(?:(?:[.+]|-(?:{BREAK})?)[^\W_]+)*")
OUT = "license string, template int, start int, end int, reduction double, n_diff int, differences string"


def gate(scanner: Scanner) -> str:
    """What any notice holds, as a pattern for Spark: a cue, between whose words a line may end;
    of templates that can lose all their cues within the differences allowed, also the pieces."""
    between = r"[\W_]+"
    parts = [CUES.replace(" ", between)]
    for wording, most, pieces in zip(scanner.words, scanner.most, scanner.pieces):
        if len(re.findall(CUES, " ".join(wording))) <= most:
            for _, piece in pieces:
                words = [between.join(r"\Q" + w + r"\E" for w in part.split("-")) for part in piece]
                parts.append(between.join(words))
    return "|".join(parts)


def occurrences(text: str, part: str) -> Iterator[int]:
    """Where ``part`` stands in ``text``, overlapping places too."""
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


def endings(found: list[str], wording: list[str]) -> list[tuple[int, int]]:
    """For each number of words of the text, the fewest differences (words changed, added or
    missing) of a stretch that ends there, and its start."""
    costs, starts = list(range(len(wording) + 1)), [0] * (len(wording) + 1)
    out = [(costs[-1], 0)]
    for i, word in enumerate(found, 1):
        row, since = [0], [i]
        for j, meant in enumerate(wording):
            cost, start = costs[j] + (word != meant), starts[j]
            if costs[j + 1] + 1 < cost:
                cost, start = costs[j + 1] + 1, starts[j + 1]
            if row[j] + 1 < cost:
                cost, start = row[j] + 1, since[j]
            row.append(cost)
            since.append(start)
        costs, starts = row, since
        out.append((costs[-1], starts[-1]))
    return out


def align(found: list[str], wording: list[str]) -> tuple[int, int, list[tuple[int, list[str], list[str]]]]:
    """The aligned part of ``found``, from its first to its last word that agrees, and the
    differences in order; words of the template before and after that part count as missing."""
    costs = [list(range(len(wording) + 1))]
    for i, word in enumerate(found, 1):
        row, above = [i], costs[-1]
        for j, meant in enumerate(wording):
            row.append(min(above[j] + (word != meant), above[j + 1] + 1, row[j] + 1))
        costs.append(row)
    i, j, steps = len(found), len(wording), []
    while i or j:
        if i and j and costs[i][j] == costs[i - 1][j - 1] + (found[i - 1] != wording[j - 1]):
            i, j = i - 1, j - 1
            steps.append((i, i + 1, j, j + 1))
        elif j and costs[i][j] == costs[i][j - 1] + 1:
            j -= 1
            steps.append((i, i, j, j + 1))
        else:
            i -= 1
            steps.append((i, i + 1, j, j))
    agree = [(i, j) for i, i2, j, j2 in reversed(steps) if i < i2 and j < j2 and found[i] == wording[j]]
    diffs, at, to = [], agree[0][0], 0
    for i, j in [*agree, (agree[-1][0] + 1, len(wording))]:
        if i > at or j > to:
            diffs.append((max(i - at, j - to), found[at:i], wording[to:j]))
        at, to = i + 1, j + 1
    return agree[0][0], agree[-1][0] + 1, diffs


def _other_license(got: list[str], meant: list[str]) -> bool:
    """Does a difference tell licenses apart: a word of one, or one version for another?"""
    versions = [[w for w in words if w in VERSIONS] for words in (got, meant)]
    return all(versions) and versions[0] != versions[1] or {*got} & MARKS != {*meant} & MARKS


class Scanner:
    """Every wording that a piece of occurs is aligned, however many there are."""

    def __init__(self, templates: dict[str, list[str]], tolerance: float) -> None:
        self.rows = [(name, j, t) for name, ts in templates.items() for j, t in enumerate(ts)]
        self.words = [[w.lower() for w in WORDS.findall(t)] for *_, t in self.rows]
        # one word at least is to agree
        self.most = [max(0, min(int(tolerance * len(w)), len(w) - 1)) for w in self.words]
        self.plain = zstandard.ZstdCompressor(level=3, write_content_size=False)
        self.given = [
            zstandard.ZstdCompressor(level=3, write_content_size=False, dict_data=zstandard.ZstdCompressionDict(
                t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))
            for *_, t in self.rows
        ]
        self.pieces = [self._pieces(w, m) for w, m in zip(self.words, self.most)]

    @staticmethod
    def _pieces(wording: list[str], most: int) -> list[tuple[int, list[str]]]:
        """Cut in one piece more than words may differ, so that one piece at least is unchanged."""
        n = min(most + 1, len(wording))
        cuts = [k * len(wording) // n for k in range(n + 1)] if n else []
        return [(a, wording[a:z]) for a, z in zip(cuts, cuts[1:])]

    def scan(self, text: str) -> list[tuple]:
        spots = [(re.sub(BREAK, "", m[0].lower()), m.start(), m.end()) for m in WORDS.finditer(text)]
        found = [w for w, _, _ in spots]
        line = f" {' '.join(found)} "
        offsets = list(accumulate((len(w) + 1 for w in found), initial=0))
        hits: dict[tuple[int, int, int], tuple] = {}
        for i, wording in enumerate(self.words):
            for lo, hi in self._places(line, offsets, i):
                lo, hi = max(lo, 0), min(hi, len(found))
                for a, z in self._ends(found, lo, hi, i):
                    b, e, diffs = align(found[a:z], wording)
                    if any(_other_license(got, meant) for _, got, meant in diffs):
                        continue
                    if (i, a + b, a + e) not in hits:
                        hits[i, a + b, a + e] = self._hit(text, spots, a + b, a + e, i, diffs)
        # the same words once, under the wording that agrees with most of them
        kept: list[tuple] = []
        for _, hit in sorted((_rank(hit, len(self.words[i])), hit) for (i, *_), hit in hits.items()):
            k = bisect_left(kept, hit[2], key=lambda h: h[3] - 1)
            if k == len(kept) or kept[k][2] >= hit[3]:
                kept.insert(k, hit)
        return kept

    def _places(self, line: str, offsets: list[int], i: int) -> list[tuple[int, int]]:
        """Stretches of words that can hold wording ``i``: around each place of one of its
        pieces, so far that the whole wording fits with all differences it may have."""
        wording, most = self.words[i], self.most[i]
        if not wording:
            return []

        def places(part: list[str]) -> Iterator[int]:
            return (bisect_left(offsets, at) for at in occurrences(line, f" {' '.join(part)} "))

        exact = set(places(wording))
        out = [(k, k + len(wording)) for k in sorted(exact)]
        if not most:
            return out
        starts = {k - first for first, piece in self.pieces[i] for k in places(piece)} - exact
        wide: list[tuple[int, int]] = []
        for k in sorted(starts):
            lo, hi = k - most, k + len(wording) + most
            if wide and lo <= wide[-1][1]:
                wide[-1] = wide[-1][0], hi
            else:
                wide.append((lo, hi))
        return out + wide

    def _ends(self, found: list[str], lo: int, hi: int, i: int) -> list[tuple[int, int]]:
        """Stretches of few enough differences; of neighbouring ends the better ones."""
        if found[lo:hi] == self.words[i]:
            return [(lo, hi)]
        ends = endings(found[lo:hi], self.words[i])
        costs = [c for c, _ in ends]
        return [
            (lo + start, lo + k) for k, (c, start) in enumerate(ends)
            if c <= self.most[i] and c == min(costs[max(k - 1, 0) : k + 2])
        ]

    def _hit(self, text: str, spots: list[tuple], lo: int, hi: int, i: int, diffs: list[tuple]) -> tuple:
        name, j, _ = self.rows[i]
        start, end = spots[lo][1], spots[hi - 1][2]
        raw = " ".join(text[start:end].lower().split()).encode()
        whole = len(self.plain.compress(raw))
        saved = (whole - len(self.given[i].compress(raw))) / whole
        said = "; ".join(f"{' '.join(got)} <> {' '.join(meant)}" for _, got, meant in diffs)
        return name, j, start, end, round(saved, 6), sum(d[0] for d in diffs), said


def _rank(hit: tuple, words: int) -> tuple:
    """Most words of the wording without the differences, then fewest differences, then the
    larger reduction, then the first one."""
    return 2 * hit[5] - words, hit[5], -hit[4], hit[0], hit[1], hit[2]


def scan_licenses(
    spark: SparkSession,
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, list[str]] | None = None,
    tolerance: float = 0.1,
) -> DataFrame:
    """License notices in whole texts: which one, where, and how its wording differs.

    At most ``tolerance`` of a template's words may differ, added and missing ones included. Of
    one piece more than that, which a template is cut into, one is unchanged in every notice:
    around each place of a piece the template is aligned with the words of the text, whatever
    the lines, so a text's length, its line breaks, and further notices beside hide nothing. A
    found stretch is compressed with the template as a zstandard raw dictionary; of wordings of
    equal agreement the one that shrinks it most is told. A difference in a word that tells
    licenses apart (Lesser, Affero and others, or another version; see ``MARKS`` and
    ``VERSIONS``) is none of wording: it refuses the finding.
    Nothing is shuffled; Spark passes only texts that hold a cue (see ``gate``) to Python.

    Null or empty texts have no findings. Repeated rows give repeated findings; findings of
    equal rank in one place go to the first name. An empty table gives no rows. Other columns
    are not read.

    Returns doc_id, license, template, start, end (code points), reduction, n_diff, differences.
    """
    rows = docs.select(column(id_col).alias("doc_id"), column(text_col).alias("text"))
    chosen = templates or TEMPLATES
    rows = rows.filter(F.col("text").rlike(gate(Scanner(chosen, tolerance))))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, tolerance)
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.string()]
        names = [c.split()[0] for c in OUT.split(", ")]
        for batch in batches:
            hits = [(i, h) for i, t in enumerate(batch.column(1).to_pylist()) for h in scanner.scan(t)]
            if hits:
                ids = batch.column(0).take(pa.array([i for i, _ in hits], pa.int64()))
                cols = [pa.array(c, k) for c, k in zip(zip(*(h for _, h in hits)), kinds)]
                yield pa.RecordBatch.from_arrays([ids, *cols], ["doc_id", *names])

    return rows.mapInArrow(run, f"doc_id {id_type}, {OUT}")
