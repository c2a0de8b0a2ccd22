"""License scan by conditional compression.

Lines with a licence word, and lines between such lines that are close, make candidate blocks.  In a block
each template's words are aligned at every common run that an alignment with few enough missing and foreign
words must have, so none is overlooked, however long the block is or whatever quotes it holds.  Round the
alignments of a long block windows of bounded length are cut (a short block is one), so that the savings are
not drowned.  A window is compressed alone and with every template as zstandard raw dictionary; templates
are ranked by how many bytes they save, which orders them and drops none.  In that order the first template
that can be aligned wins, unless one that saves nearly as many bytes differs in fewer words.  What lies
before and after the winning words is scanned again, so a block can name several licences.

A null text is an empty one; texts without licences give no rows, repeated rows repeat theirs, an empty
table gives an empty one.  Offsets are code points, ends exclusive.  Other columns are not read.
"""

from __future__ import annotations

import functools
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from railpulse.llm.common import bounded_batches, map_batches, table, utf8

# Wording of public licence notices, without names and years.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
    "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) "
    "any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Released under the MIT License.",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights "
    "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to "
    "whom the Software is furnished to do so.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
LICENCE_WORD = re.compile(rb"(?i)licen[cs]e|copyright|redistribut|permission|warrant|public domain|free software|published by")
MAX_GAP = 3  # lines without a licence word between lines with one, and around them
MAX_DIFFERENT = 0.12  # missing and foreign words, as a share of the template's
CLOSE = 0.8  # templates that save this share of the winner's bytes can still win by fewer differences
NOISE = 16  # so can those that save this many bytes less: compressed sizes waver by some bytes
WINDOW, AROUND = 160, 40  # words of a block that is compressed whole, and round alignments in longer ones
LEVEL = 3
_WORD = re.compile(rb"[0-9a-z]+(?:\.[0-9]+)*")


def words_of(text: bytes) -> list[tuple[bytes, int, int]]:
    return [(m[0], m.start(), m.end()) for m in _WORD.finditer(text.lower())]


@functools.cache
def _templates() -> list[tuple[str, list[bytes], zstandard.ZstdCompressor]]:
    return [(name, [w for w, _, _ in words_of(text.encode())], zstandard.ZstdCompressor(
        level=LEVEL, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
        for name, text in sorted(TEMPLATES.items())]


@functools.cache
def _seeds() -> tuple[int, dict[tuple[bytes, ...], list[tuple[int, int]]]]:
    """Words of a seed, and for each seed the (template, place) that have it."""
    width = min(least_run(len(words)) for _, words, _ in _templates())
    out: dict[tuple[bytes, ...], list[tuple[int, int]]] = {}
    for t, (_, words, _) in enumerate(_templates()):
        for p in range(len(words) - width + 1):
            out.setdefault(tuple(words[p:p + width]), []).append((t, p))
    return width, out


def blocks(data: bytes) -> list[tuple[int, int]]:
    """(start, end) of candidate blocks, in bytes."""
    if not LICENCE_WORD.search(data):
        return []
    lines, at = [], 0
    for line in data.split(b"\n"):
        lines.append((at, at + len(line), bool(LICENCE_WORD.search(line))))
        at += len(line) + 1
    hits = [i for i, x in enumerate(lines) if x[2]]
    out: list[list[int]] = []
    for i in hits:
        if out and i - out[-1][1] <= MAX_GAP + 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return [(lines[max(0, a - MAX_GAP)][0] if k == 0 or max(0, a - MAX_GAP) > out[k - 1][1] else lines[a][0],
             lines[min(len(lines) - 1, b + MAX_GAP)][1]) for k, (a, b) in enumerate(out)]


def ranked(block: bytes) -> list[tuple[int, str, list[bytes]]]:
    """(bytes saved, name, words) of all templates, the most saved first, the longer of equals first."""
    alone = len(zstandard.ZstdCompressor(level=LEVEL).compress(block))
    saved = [(alone - len(z.compress(block)), name, words) for name, words, z in _templates()]
    return sorted(saved, key=lambda x: (-x[0], -len(x[2]), x[1]))


def slack(length: int) -> int:
    """Missing and foreign words that a template of ``length`` words may have."""
    return int(length * MAX_DIFFERENT)


def least_run(length: int) -> int:
    """Words of the longest common run that every acceptable alignment of ``length`` words has at least."""
    return -(-(length - slack(length)) // (slack(length) + 1))


def fitted(template: list[bytes], words: list[bytes], at: int) -> tuple[int, int, int, int] | None:
    """(first, last, missing, foreign) with the fewest differences of the template where it begins near
    word ``at``, give or take the words it may differ by; None if too much differs."""
    n, room = len(template), slack(len(template))
    if at >= 0 and words[at:at + n] == template:
        return at, at + n, 0, 0
    # row i, place k: the cheapest way of template[:i] to the words that end at at - room + i + k, as
    # (differences, missing, minus the first matched place, or 1 before a match)
    row = [(0, 0, 1)] * (2 * room + 1)
    for i, word in enumerate(template):
        new: list[tuple[int, int, int]] = []
        for k, (d, m, f) in enumerate(row):
            j = at - room + i + k
            best = (d, m, min(f, -j) if f > 0 else f) if 0 <= j < len(words) and words[j] == word else (n + 1, 0, 1)
            if k < 2 * room:  # the template's word is missing
                d, m, f = row[k + 1]
                best = min(best, (d + 1, m + 1, f))
            if k and new[-1][2] <= 0:  # the word before is foreign
                d, m, f = new[-1]
                best = min(best, (d + 1, m, f))
            new.append(best)
        row = new
    k = min(range(2 * room + 1), key=lambda x: (row[x][0], x))
    differences, missing, first = row[k]
    return (-first, at - room + n + k, missing, differences - missing) if differences <= room else None


def notices(words: list[bytes]) -> list[tuple[int, int, int, int, str]]:
    """(first, last, missing, foreign, name) of all acceptable alignments of the templates, by place.

    The words that may differ cut a template into so many runs at most, so the longest has ``least_run``
    words or more: all common runs of that length are tried.
    """
    out: set[tuple[int, int, int, int, str]] = set()
    width, seeds = _seeds()
    run: dict[tuple[int, int], tuple[int, int]] = {}  # (template, where it would begin): last place, seeds in a row
    tried = set()
    for i, gram in enumerate(zip(*(words[k:] for k in range(width)))):
        for t, p in seeds.get(gram, ()):
            name, template, _ = _templates()[t]
            last, n = run.get((t, i - p), (-2, 0))
            n = n + 1 if last == i - 1 else 1
            run[t, i - p] = i, n
            if n + width - 1 >= least_run(len(template)) and (t, i - p) not in tried:
                tried.add((t, i - p))
                if got := fitted(template, words, i - p):
                    out.add((*got, name))
    return sorted(out)


def windows(data: bytes, a: int, b: int) -> list[tuple[int, int]]:
    """(start, end) of parts of block (a, b) that are compressed: all of a short block; of a longer one each
    group of overlapping alignments with some words round it.  No alignment lies across a border."""
    words = words_of(data[a:b])
    if len(words) <= WINDOW:
        return [(a, b)]
    groups: list[list[int]] = []
    for first, last, *_ in notices([w for w, _, _ in words]):
        if groups and first < groups[-1][1]:
            groups[-1][1] = max(groups[-1][1], last)
        else:
            groups.append([first, last])
    out = []
    for k, (first, last) in enumerate(groups):
        low = max(first - AROUND, -(-(groups[k - 1][1] + first) // 2) if k else 0)
        high = min(last + AROUND, -(-(last + groups[k + 1][0]) // 2) if k + 1 < len(groups) else len(words))
        out.append((a + words[low][1], a + words[high - 1][2]))
    return out


def scan(data: bytes) -> list[tuple[str, int, int, int, int, int]]:
    """(licence, start, end, saved, missing, foreign) of each notice, by start, in code points."""
    found = []
    todo = [w for a, b in blocks(data) for w in windows(data, a, b)]
    while todo:
        a, b = todo.pop()
        words = words_of(data[a:b])
        fits: dict[str, tuple[int, int, int, int]] = {}
        for *got, name in notices([w for w, _, _ in words]):
            if name not in fits or sum(got[2:]) < sum(fits[name][2:]):
                fits[name] = tuple(got)
        if not fits:
            continue
        won = None
        for saved, name, _ in ranked(data[a:b]):
            if name not in fits:
                continue
            if won and saved < won[0] - max((1 - CLOSE) * won[0], NOISE):
                break
            if not won or sum(fits[name][2:]) < sum(won[2][2:]):
                won = (won[0] if won else saved, name, fits[name], saved)
        _, name, (first, last, missing, foreign), saved = won
        s, e = a + words[first][1], a + words[last - 1][2]
        found.append((name.removesuffix("-notice"), len(data[:s].decode()), len(data[:e].decode()), saved, missing, foreign))
        todo += [(a, s), (e, b)]
    return sorted(found, key=lambda x: x[1:3])


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, license, start, end, saved_bytes, missing_words, foreign_words) of each notice in ``docs``."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["license", "start", "end", "saved_bytes", "missing_words", "foreign_words"]

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, got = [], []
        for i, data in enumerate(utf8(batch.column(1))):
            for x in scan(data):
                at.append(i)
                got.append(x)
        cols = list(zip(*got, strict=True)) or [()] * 6
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(cols[0], pa.string()),
                                           *(pa.array(c, pa.int64()) for c in cols[1:])], names=[id_col, *names])

    return map_batches(docs.select(id_col, text_col), rows, f"`{id_col}` {kind}, license string, " + ", ".join(
        f"`{n}` bigint" for n in names[1:]))


def op2_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence notices in all ``documents``."""
    return licenses(table(spark, sf_dir, "documents"))
