"""License scans by conditional compression.

Candidate blocks are runs of lines that speak of a license; wording is looked for in them and in as many words on both
sides as a changed copy of the longest notice can take, so a wrapped notice keeps its head and tail. A block is compressed alone and once with each template as
a zstandard raw dictionary; templates are ranked by how much the size falls near the triggers. The rank only orders: each
template, whatever it saves, has to confirm by its exact wording: the word differences between the block and the
template's notices are taken, and the block is `exact` if a notice stands in it word for word, `modified` if at least
SIMILAR of the notice's words stand there in order.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioweave.llm.common import table

SIMILAR = 0.8
#: Notices of fewer words count only word for word.
LEAST_WORDS = 5
#: Lines without a trigger that a block may hold between lines with one.
GAP = 2
#: A line that is longer is cut to this many characters on each side of its triggers.
REACH = 1500
CACHE = 20_000
LEVEL = 19
#: Names of licenses as notices write them, with their SPDX identifiers.
NAMES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0"),
    "MIT": ("MIT License", "MIT"),
    "BSD-2-Clause": ("BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "BSD-3-Clause", "New BSD License"),
    "ISC": ("ISC License", "ISC"),
    "GPL-2.0": ("GNU General Public License, version 2", "GNU General Public License v2.0", "GPL-2.0"),
    "GPL-3.0": ("GNU General Public License, version 3", "GNU General Public License v3.0", "GPL-3.0"),
    "LGPL-2.1": ("GNU Lesser General Public License, version 2.1", "LGPL-2.1"),
    "LGPL-3.0": ("GNU Lesser General Public License, version 3", "LGPL-3.0"),
    "AGPL-3.0": ("GNU Affero General Public License, version 3", "AGPL-3.0"),
    "MPL-2.0": ("Mozilla Public License, Version 2.0", "Mozilla Public License, v. 2.0", "MPL-2.0"),
    "EPL-2.0": ("Eclipse Public License 2.0", "EPL-2.0"),
    "Unlicense": ("The Unlicense", "Unlicense"),
    "Zlib": ("zlib License", "Zlib"),
    "CC0-1.0": ("CC0 1.0 Universal", "CC0 1.0", "CC0-1.0"),
    "CC-BY-4.0": ("Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"),
    "CC-BY-SA-4.0": ("Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0"),
    "CC-BY-NC-4.0": ("Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0"),
    "CC-BY-ND-4.0": ("Creative Commons Attribution-NoDerivatives 4.0 International License", "CC BY-ND 4.0", "CC-BY-ND-4.0"),
    "CC-BY-NC-SA-4.0": ("Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "CC BY-NC-SA 4.0", "CC-BY-NC-SA-4.0"),
}
#: How notices name a license, and opening sentences of license texts.
PHRASES = ("Licensed under the {}", "Licensed under {}", "Released under the {}", "Released under {}", "This work is licensed under the {}", "This work is licensed under a {}", "This software is distributed under the terms of the {}", "subject to the terms of the {}", "SPDX-License-Identifier: {}")
OPENINGS = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "BSD-3-Clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "Apache-2.0": "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
#: Words may be parted by line ends and comment signs.
TRIGGER = r"(?i)licen[sc]e|permission\W+(is\W+hereby|to\W+use)|redistribution\W+and\W+use|public\W+domain|warrant(y|ies)|\bcc\W+by\b|\bcc0\b|creative\W+commons|copyright|released\W+under|distributed\W+under|terms\W+of\W+the"
_TRIGGER = re.compile(TRIGGER)
_WORD = re.compile(r"\w+(?:[.\-]\w+)*")


def templates() -> dict[str, list[str]]:
    """License id: its notices. Each list joined is that license's dictionary."""
    out = {spdx: [p.format(n) for n in names for p in PHRASES] for spdx, names in NAMES.items()}
    for spdx, text in OPENINGS.items():
        out[spdx].append(text)
    return out


def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


def candidate_blocks(text: str) -> list[tuple[int, int]]:
    """Spans of whole runs of lines around triggers; very long lines count only near their triggers."""
    spans: list[list[int]] = []
    triggers = [m.span() for m in _TRIGGER.finditer(text)]
    at, quiet, k = 0, GAP + 1, 0
    for line in text.split("\n"):
        found = []
        while k < len(triggers) and triggers[k][0] <= at + len(line):
            found.append((max(0, triggers[k][0] - at), min(len(line), triggers[k][1] - at)))
            if triggers[k][1] > at + len(line):  # it goes on in the next line
                break
            k += 1
        if found and len(line) > 2 * REACH:
            for a, b in found:
                lo, hi = at + max(0, a - REACH), at + min(len(line), b + REACH)
                if spans and lo <= spans[-1][1]:
                    spans[-1][1] = hi
                else:
                    spans.append([lo, hi])
            quiet = GAP + 1
        elif found:
            if spans and quiet <= GAP:
                spans[-1][1] = at + len(line)
            else:
                spans.append([at, at + len(line)])
            quiet = 0
        else:
            quiet += 1
        at += len(line) + 1
    return [(a, b) for a, b in spans]


class Scanner:
    def __init__(self, by_license: dict[str, list[str]]) -> None:
        import zstandard

        self.names = sorted(by_license)
        self.notices = {k: [words(t) for t in by_license[k]] for k in self.names}
        self.longest = max(len(t) for texts in by_license.values() for t in texts)
        self.vocabulary = {k: {w for n in notices for w in n} for k, notices in self.notices.items()}
        self.most = max(len(n) for notices in self.notices.values() for n in notices)
        self.alone = zstandard.ZstdCompressor(level=LEVEL)
        self.given = {k: zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict("\n".join(by_license[k]).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)) for k in self.names}
        self.cache: dict[bytes, list[tuple]] = {}

    def ranked(self, block: str) -> list[tuple[float, str]]:
        """All templates; prose far from the triggers would drown what a short notice saves, so only their surroundings count."""
        raw = _near_triggers(block, self.longest).encode()
        base = len(self.alone.compress(raw))
        return sorted(((len(c.compress(raw)) - base) / base, k) for k, c in self.given.items())

    def matches(self, have: list[str]) -> list[tuple]:
        """License, kind, share of the notice found, its length, first word and end, its words that are missing, the words between, and where its words stand."""
        at: dict[str, list[int]] = defaultdict(list)
        for i, w in enumerate(have):
            at[w].append(i)
        out = []
        for name in self.names:
            for notice in self.notices[name]:
                n = len(notice)
                if sum(w in at for w in notice) < (SIMILAR * n if n >= LEAST_WORDS else n):
                    continue
                exact = [i for i in at.get(notice[0], ()) if have[i : i + n] == notice]
                out += [(name, "exact", 1.0, n, i, i + n, [], [], range(i, i + n)) for i in exact]
                if n >= LEAST_WORDS:
                    taken = [(i, i + n) for i in exact]
                    out += [(name, "modified", m / n, n, i, j, *_differences(have, i, j, notice)) for m, i, j in _modified(have, at, notice, taken)]
        return out

    def scan(self, text: str) -> list[tuple]:
        """Block, its start and end with all that it confirms, then license, rank, saved, kind, share, missing, between."""
        cores = candidate_blocks(text)
        if not cores:
            return []
        found = list(_WORD.finditer(text))
        have, starts, ends = [m.group().lower() for m in found], [m.start() for m in found], [m.end() for m in found]
        runs: list[list[int]] = []
        reach = 2 * self.most
        for a, b in cores:
            lo, hi = max(0, bisect_right(ends, a) - reach), min(len(found), bisect_left(starts, b) + reach)
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(hi, runs[-1][1])
            else:
                runs.append([lo, hi])
        of: dict[int, list[tuple]] = defaultdict(list)
        for lo, hi in runs:
            if lo == hi:
                continue
            key = hashlib.blake2b(text[starts[lo] : ends[hi - 1]].encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if (got := self.cache.get(key)) is None:
                got = self.matches(have[lo:hi])
                if len(self.cache) < CACHE:
                    self.cache[key] = got
            for m in got:
                a, b = starts[lo + m[4]], ends[lo + m[5] - 1]
                of[_owner(cores, a, b)].append((*m[:4], a, b, *m[6:8], range(lo + m[4], lo + m[5]), [lo + i for i in m[8]]))
        return self.confirmed(text, have, cores, of)

    def confirmed(self, text: str, have: list[str], cores: list[tuple[int, int]], of: dict[int, list[tuple]]) -> list[tuple]:
        """For each block the best place of each license.

        A place that shares words with better places of other licenses counts only by a word of its own: one outside them
        that no notice of those licenses has.
        """
        ranks: dict[int, dict[str, tuple[int, float]]] = {}
        for k, found in of.items():
            lo, hi = min(cores[k][0], *(m[4] for m in found)), max(cores[k][1], *(m[5] for m in found))
            ranks[k] = {name: (rank, -saved) for rank, (saved, name) in enumerate(self.ranked(text[lo:hi]), 1)}
        better: dict[int, set[str]] = defaultdict(set)
        kept: dict[int, dict[str, tuple]] = defaultdict(dict)
        # Exact wording goes first, then the share found, then length, then rank.
        for k, m in sorted(((k, m) for k, found in of.items() for m in found), key=lambda x: (x[1][1], -x[1][2], -x[1][3], ranks[x[0]][x[1][0]][0], x[1][4])):
            others = {o for i in m[9] for o in better[i] if o != m[0]}
            if not others or any(not better[i] - {m[0]} and not any(have[i] in self.vocabulary[o] for o in others) for i in m[9]):
                for i in m[8]:
                    better[i].add(m[0])
                kept[k].setdefault(m[0], m)
        out = []
        for k in sorted(kept):
            rows = sorted(kept[k].values(), key=lambda m: ranks[k][m[0]][0])
            lo, hi = min(cores[k][0], *(m[4] for m in rows)), max(cores[k][1], *(m[5] for m in rows))
            out += [(k, lo, hi, m[0], *ranks[k][m[0]], *m[1:3], *m[6:8]) for m in rows]
        return out


def _owner(cores: list[tuple[int, int]], a: int, b: int) -> int:
    """The first block that the span a to b touches, or else the nearest."""
    k = next((k for k in range(max(0, bisect_right(cores, (a, a)) - 1), len(cores)) if cores[k][1] > a), len(cores) - 1)
    if cores[k][0] < b or k == 0:
        return k
    return k if cores[k][0] - b < a - cores[k - 1][1] else k - 1


def _near_triggers(block: str, reach: int) -> str:
    spans: list[list[int]] = []
    for m in _TRIGGER.finditer(block):
        if spans and m.start() - reach <= spans[-1][1]:
            spans[-1][1] = m.end() + reach
        else:
            spans.append([max(0, m.start() - reach), m.end() + reach])
    return "\n".join(block[a:b] for a, b in spans) or block


def _modified(have: list[str], at: dict[str, list[int]], notice: list[str], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Words found, start and end of places apart from each other and from those taken, the best ones first.

    A place holds at least SIMILAR of the notice's words in order, within twice the notice's length.
    """
    n = len(notice)
    bits: dict[str, int] = defaultdict(int)
    for i, w in enumerate(notice):
        bits[w] |= 1 << i
    hits = sorted((i, b) for w, b in bits.items() for i in at.get(w, ()))
    full, found, end = (1 << n) - 1, [], 0
    for k, (start, _) in enumerate(hits):
        while end < len(hits) and hits[end][0] < start + 2 * n:
            end += 1
        if end - k < SIMILAR * n:
            continue
        row, most, last = full, 0, start
        for i, b in hits[k:end]:  # common subsequence by bit-parallel rows
            hit = row & b
            row = (row + hit) | (row - hit)
            if (m := n - (row & full).bit_count()) > most:
                most, last = m, i
        if most >= SIMILAR * n:
            found.append((-most, last + 1 - start, start))
    out = []
    for less, length, start in sorted(found):
        if all(start + length <= a or b <= start for a, b in taken):
            taken.append((start, start + length))
            out.append((-less, start, start + length))
    return out


def _differences(have: list[str], start: int, end: int, notice: list[str]) -> tuple[list[str], list[str], list[int]]:
    """The notice's words that are missing, the words between, and the places of those found, by a longest common subsequence."""
    rest = [[0] * (len(notice) + 1) for _ in range(start, end + 1)]
    for i in range(end - 1, start - 1, -1):
        for j in range(len(notice) - 1, -1, -1):
            rest[i - start][j] = rest[i - start + 1][j + 1] + 1 if have[i] == notice[j] else max(rest[i - start + 1][j], rest[i - start][j + 1])
    i, j = start, 0
    missing, between, places = [], [], []
    while i < end and j < len(notice):
        if have[i] == notice[j]:
            places.append(i)
            i, j = i + 1, j + 1
        elif rest[i - start + 1][j] >= rest[i - start][j + 1]:
            between.append(have[i])
            i += 1
        else:
            missing.append(notice[j])
            j += 1
    return missing + notice[j:], between + have[i:end], places


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    return Scanner(templates())


SCHEMA = "doc_id long, block int, char_start long, char_end long, license string, rank int, saved double, kind string, similarity double, missing array<string>, between array<string>"


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per candidate block and license that it confirms, with the differences in wording.

    Offsets are code points of the document and take in all of a notice that starts before or ends after the block's lines. Blocks without a confirmed license give no row, nor do null and empty
    texts. Repeated rows each give their rows; a null id is kept. Extra columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanner()
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.string())]
        names = ["doc_id", "block", "char_start", "char_end", "license", "rank", "saved", "kind", "similarity", "missing", "between"]
        for batch in batches:
            rows = []
            for d, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py()
                rows += [(d.as_py(), *found) for found in scanner.scan(text)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    # The same pattern decides in the JVM which texts reach Python at all.
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").rlike(TRIGGER))
    return rows.mapInArrow(run, SCHEMA)


def op3(spark, sf_dir):  # noqa: ANN001, ANN201
    return scan_licenses(table(spark, sf_dir, "documents"))
