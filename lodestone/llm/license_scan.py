"""Licence scans: TF-IDF cosine of lines, runs of lines and whole licence files to licence
templates, then inheritance from the nearest directory that has a licence file.

A passage is any run of neighbouring lines of a file, one or more (lines without words do not
part them), and, for files that are licence files, also the whole text, which is held against the
full texts of licences. Its terms are its distinct words, lower-cased A-Z; a term weighs
its inverse document frequency, counted over all files for the terms of the templates, and
as if found once for any other term. Notices and full texts have each their own terms. The best
template of at least ``least`` cosine is the file's own licence, a full text before any notice. Where the first two lines with words of a file
that is like a full text are the title of another licence (``TITLES``, and the titles of the full texts), it is that one. Runs are as long
as may be: one is given up only when no longer one of the same first line can reach ``least``. A file without one takes the licence of the nearest ancestor directory with a licence
file: paths are joined with the directories above them.

Defined results: a null text has no licence of its own; a null path has no directory and
inherits nothing; of equally good templates the first by name wins, of equally good passages the one of
fewest lines, then the first; of several licence files in one directory the best, then the first by path. A licence whose full text and title are not
known may be taken for one that shares its words. Repeated rows each get a result. Columns
other than the id, the path and the text are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.arrays import Words, in_small_batches, lower_ascii, slices, text_bytes
from lodestone.operators.durable import durable, small

#: Notices by which files name their licence (fixed values): identifier and wording.
TEMPLATES = [
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]

#: Licences whose full texts are files of the folder ``licence_texts`` (fixed values).
FULL_TEXTS = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]

#: Titles of licences whose full texts are none of those, but share words with them (fixed values).
TITLES = [
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"), ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("CC-BY-SA-4.0", "Creative Commons Attribution-ShareAlike 4.0 International Public License"), ("EPL-2.0", "Eclipse Public License - v 2.0"), ("GFDL-1.3", "GNU Free Documentation License Version 1.3, 3 November 2008"),
]
#: Least cosine of a title.
TITLE_LEAST = 0.97

#: Names of files that speak for their directory (fixed value).
LICENCE_FILE = r"(?i)^(licen[sc]e|copying|unlicense|notice)([-.].*)?$"
#: Directories with a licence that are broadcast at most; more are joined by a shuffle.
BROADCAST_DIRS = 100_000

_GAPS = np.ones(256, bool)
_GAPS[48:58] = _GAPS[97:123] = _GAPS[128:] = False
#: Bytes lower-cased, and gaps as spaces: the hash of a word takes in the bytes up to the next, if they are not spaces.
_PLAIN = lower_ascii(np.arange(256, dtype=np.uint8))
_PLAIN[_GAPS[_PLAIN]] = 32
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _terms(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Words]:
    """Distinct (line, word hash) pairs of texts, sorted by line; the row of each line; the lines."""
    lines = Words(raw, at, _LINE)
    words = Words(_PLAIN[raw], at)
    line = np.searchsorted(lines.start, words.start, "right") - 1
    hashes = words.hashes()
    order = np.lexsort((hashes, line))
    line, hashes = line[order], hashes[order]
    new = np.append(True, (line[1:] != line[:-1]) | (hashes[1:] != hashes[:-1])) if len(line) else np.zeros(0, bool)
    rows = np.repeat(np.arange(len(at) - 1), np.diff(lines.first))
    return line[new], hashes[new], rows, lines


def _one(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    return np.unique(Words(_PLAIN[raw], np.array([0, len(raw)])).hashes())


class Templates:
    """Unit vectors of the templates over their own terms (a column each), once the frequencies are known."""

    def __init__(self, templates: list[tuple[str, str]]) -> None:
        self.names = [n for n, _ in sorted(templates)]
        self.sets = [_one(t) for _, t in sorted(templates)]
        self.terms = np.unique(np.concatenate(self.sets))

    def weigh(self, files: int, df: np.ndarray) -> None:
        self.rare = math.log((1 + files) / 2) + 1
        self.idf = np.log((1 + files) / (1 + np.minimum(df, files))) + 1
        self.matrix = np.zeros((len(self.terms), len(self.sets)))
        for k, s in enumerate(self.sets):
            at = np.searchsorted(self.terms, s)
            self.matrix[at, k] = self.idf[at] / np.sqrt((self.idf[at] ** 2).sum())

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash among the terms, or -1."""
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def best(self, line: np.ndarray, hashes: np.ndarray, lines: int, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Of each line the best template (-1: none of ``least``) and its cosine."""
        place = self.places(hashes)
        own = place >= 0
        squared = np.bincount(line, np.where(own, self.idf[place], self.rare) ** 2, lines)
        known = np.bincount(line[own], self.idf[place[own]] ** 2, lines)
        # by Cauchy-Schwarz no cosine is over the share of a line's length that its known terms make up
        hopeful = known >= least**2 * np.maximum(squared, 1e-12) * (1 - 1e-9)
        name, score = np.full(lines, -1), np.zeros(lines)
        some = own & hopeful[line]
        who, inside = np.unique(line[some], return_inverse=True)
        if len(who):
            dense = np.zeros((len(who), len(self.terms)))
            dense[inside, place[some]] = self.idf[place[some]]
            cosine = np.round(dense @ self.matrix / np.sqrt(squared[who])[:, None], 12)
            top = cosine.argmax(1)
            value = cosine[np.arange(len(who)), top]
            name[who], score[who] = np.where(value >= least, top, -1), np.where(value >= least, value, 0)
        return name, score

    def runs(self, line: np.ndarray, hashes: np.ndarray, owner: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
        """Runs of two and more lines of one row that reach ``least``: first line, lines with words, best template, cosine.

        What a run holds besides a template's terms only grows with it, and so bounds its cosine to that template. Runs whose
        first or last line adds no term of a template to the others' are left out: a shorter one is as good."""
        least = max(least, 1e-9)
        place = self.places(hashes)
        own = place >= 0
        length = np.array([np.sqrt((self.idf[np.searchsorted(self.terms, s)] ** 2).sum()) for s in self.sets])
        spare = length**2 * (1 / least**2 - 1) * (1 + 1e-9)
        # of the lines with words those that may be in a run at all, in stretches without any other between them
        full, number = np.unique(line, return_inverse=True)
        stays = np.bincount(number, ~own * self.rare**2, len(full)) <= spare.max(initial=0)
        stretch = np.cumsum(np.append(True, owner[full[1:]] != owner[full[:-1]]) | ~stays) if len(full) else np.zeros(0, np.int64)
        stays &= np.bincount(stretch, stays, int(stretch.max(initial=0)) + 1)[stretch] > 1
        held = stays[number]
        hashes, place, own = hashes[held], place[held], own[held]
        k = (np.cumsum(stays) - 1)[number[held]]
        full, stretch = full[stays], stretch[stays]
        none = np.zeros(0, np.int64)
        if not len(full):
            return none, none, none, np.zeros(0)
        weight = np.where(own, self.idf[place], self.rare) ** 2
        order = np.lexsort((k, hashes, stretch[k]))
        same = (hashes[order[1:]] == hashes[order[:-1]]) & (stretch[k[order[1:]]] == stretch[k[order[:-1]]])
        before, after = np.full(len(k), -1), np.full(len(k), len(full))
        before[order[1:][same]], after[order[:-1][same]] = k[order[:-1][same]], k[order[1:][same]]
        until = np.zeros(len(full), np.int64)  # the first line by which all terms of templates of a line have come again
        np.maximum.at(until, k[own], after[own])
        cut = np.searchsorted(k, np.arange(len(full) + 1))
        start = np.flatnonzero(until)
        squared, dots, out = np.zeros(len(start)), np.zeros((len(start), len(self.sets))), []
        for n in range(len(full)):
            last = start + n
            going = last < np.minimum(until[start], len(full))
            going[going] = stretch[last[going]] == stretch[start[going]]
            start, last, squared, dots = start[going], last[going], squared[going], dots[going]
            if not len(start):
                break
            size = cut[last + 1] - cut[last]
            who = np.repeat(np.arange(len(start)), size)
            entry = np.arange(len(who)) + np.repeat(cut[last] - np.cumsum(size) + size, size)
            fresh = before[entry] < start[who]
            who, entry = who[fresh], entry[fresh]
            squared = squared + np.bincount(who, weight[entry], len(start))
            who, entry = who[own[entry]], entry[own[entry]]
            grown, at = np.unique(who, return_index=True)
            if len(grown):
                dots[grown] += np.add.reduceat(self.idf[place[entry]][:, None] * self.matrix[place[entry]], at)
            if n and len(grown):
                cosine = np.round(dots[grown] / np.sqrt(squared[grown])[:, None], 12)
                top = cosine.argmax(1)
                value = cosine[np.arange(len(grown)), top]
                good = value >= least
                out.append((full[start[grown[good]]], np.full(int(good.sum()), n + 1), top[good], value[good]))
            going = (squared[:, None] - dots * length <= spare + 1e-9).any(1)
            start, squared, dots = start[going], squared[going], dots[going]
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (none, none, none, np.zeros(0))


def full_texts() -> list[tuple[str, str]]:
    """The full texts of licences: identifier and text."""
    folder = resources.files("lodestone.llm") / "licence_texts"
    return [(n, (folder / f"{n}.txt").read_text("utf-8")) for n in FULL_TEXTS]


def _title(text: str) -> list[str]:
    """The first two lines with words of a text."""
    return [line for line in text.split("\n") if len(_one(line))][:2]


def _frequencies(texts: DataFrame, *templates: Templates) -> None:
    """Weighs templates by the number of files, and of files with each of their terms: a row for each term comes to the driver."""
    terms = np.unique(np.concatenate([t.terms for t in templates]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, df = 0, np.zeros(len(terms), np.int64)
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = text_bytes(part.column("text"))
                words = Words(_PLAIN[raw], at)
                hashes = words.hashes()
                place = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
                place[terms[place] != hashes] = -1
                rows = np.repeat(np.arange(part.num_rows), np.diff(words.first))
                df += np.bincount(np.unique(rows[place >= 0] * len(df) + place[place >= 0]) % len(df), minlength=len(df))
                files += part.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, len(df)), pa.int32()), pa.array([files, *df.tolist()], pa.int64())], ["term", "n"])

    got = {r.term: r.n for r in texts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
    files, df = got.pop(-1, 0), np.array([got.get(k, 0) for k in range(len(terms))])
    for t in templates:
        t.weigh(files, df[np.searchsorted(terms, t.terms)])


def licences(files: DataFrame, templates: list[tuple[str, str]] | None = None, whole: list[tuple[str, str]] | None = None, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = 0.75) -> DataFrame:
    """For each row its id, path, ``own_licence``, its ``cosine`` and ``line``, where the passage begins (from 1; null
    if none), and ``licence``, its own or the inherited, with ``inherited_from``, the directory. ``templates`` are notices, and
    ``whole`` full texts, by default the built-in ones."""
    known, entire = Templates(templates or TEMPLATES), Templates(whole or full_texts())
    titles = Templates([(n, "\n".join(_title(t))) for n, t in whole or full_texts()] + ([] if whole else TITLES))
    rows = in_small_batches(files).select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    rows = rows.withColumn("speaks", F.coalesce(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE), F.lit(False)))
    _frequencies(rows.select("text"), known, entire, titles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                raw, at = text_bytes(part.column("text"))
                line, hashes, owner, lines = _terms(raw, at)
                name, score = known.best(line, hashes, len(lines), least)
                one = np.flatnonzero(name >= 0)
                # passages: the lines, then runs of lines, then whole texts, which go before these, then their titles where they say otherwise
                found = [(one, np.ones(len(one), np.int64), name[one], score[one], np.zeros(len(one), np.int64))]
                found.append((*(more := known.runs(line, hashes, owner, least)), np.zeros(len(more[0]), np.int64)))
                speaks = np.array(part.column("speaks").to_pylist(), bool)[owner[line]]
                pairs = np.unique(np.rec.fromarrays([owner[line[speaks]], hashes[speaks]], names="row,hash"))
                name, score = entire.best(pairs["row"], pairs["hash"], part.num_rows, least)
                row = np.flatnonzero(name >= 0)
                begin = np.searchsorted(owner[line], row)
                found.append((line[begin], np.zeros(len(row), np.int64), name[row], score[row], np.ones(len(row), np.int64)))
                heads = [np.unique(hashes[a : a + np.searchsorted(line[a:], np.unique(line[a : np.searchsorted(owner[line], r, "right")])[:2][-1], "right")]) for a, r in zip(begin.tolist(), row.tolist(), strict=True)]
                named, near = titles.best(np.repeat(np.arange(len(row)), [len(h) for h in heads]), np.concatenate(heads) if heads else hashes[:0], len(row), TITLE_LEAST)
                other = np.array([k for k in np.flatnonzero(named >= 0).tolist() if titles.names[named[k]] != entire.names[name[row[k]]]], np.int64)
                found.append((line[begin[other]], np.zeros(len(other), np.int64), named[other], near[other], np.full(len(other), 2)))
                first, size, name, score, all_of_it = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((first, size, -score, -all_of_it, owner[first]))
                row, at_first = np.unique(owner[first[order]], return_index=True)
                top = dict(zip(row.tolist(), order[at_first].tolist(), strict=True))
                names = [(known, entire, titles)[all_of_it[k]].names[name[k]] if (k := top.get(r)) is not None else None for r in range(part.num_rows)]
                breaks = np.concatenate([[0], np.cumsum(raw == 10)])
                place = [int(breaks[lines.start[first[k]]] - breaks[at[r]]) + 1 if (k := top.get(r)) is not None else None for r in range(part.num_rows)]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("path"), pa.array(names, pa.string()), pa.array([float(score[top[r]]) if r in top else None for r in range(part.num_rows)], pa.float64()), pa.array(place, pa.int64())], ["id", "path", "own_licence", "cosine", "line"])

    kind = rows.schema["id"].dataType.simpleString()
    own = rows.mapInArrow(run, f"id {kind}, path string, own_licence string, cosine double, line long")
    own = durable(own.withColumn("dir", F.regexp_extract("path", r"^(.*)/[^/]*$", 1)))
    speaks = own.where("own_licence IS NOT NULL AND path IS NOT NULL").where(F.regexp_extract("path", r"([^/]*)$", 1).rlike(LICENCE_FILE))
    theirs = small(speaks.groupBy(F.col("dir").alias("above")).agg(F.min_by("own_licence", F.struct(-F.col("cosine"), "path")).alias("theirs")), BROADCAST_DIRS)
    # directories are joined once each with those above them, however many files they hold
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    dirs = own.where("path IS NOT NULL").select("dir").distinct().select("dir", F.explode(F.array_distinct(above)).alias("above"))
    nearest = dirs.join(theirs, "above").groupBy("dir").agg(F.max_by(F.struct("theirs", "above"), F.length("above")).alias("near"))
    out = own.join(small(durable(nearest), BROADCAST_DIRS), "dir", "left")
    gets = F.col("own_licence").isNull() & F.col("path").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("path").alias(path_col), "own_licence", "cosine", "line", F.coalesce("own_licence", F.when(gets, F.col("near.theirs"))).alias("licence"), F.when(gets, F.col("near.above")).alias("inherited_from"))


def template_table(spark: SparkSession) -> DataFrame:
    """The built-in templates as a table (licence, text)."""
    return spark.createDataFrame(TEMPLATES, "licence string, text string")
