"""Licence scan: sparse TF-IDF cosine to templates, then inheritance by directory.

``scan_files`` is the whole scan.  Header blocks are windows of up to WINDOW
consecutive lines with words, compared to notices, headers and short licence
texts; a licence file is also one vector of its whole text, compared to these
and to full licence texts (``licence_texts/``; the Creative Commons licences
have notices alone).  The dot products of a window's lines add up and its norm
is at least the root of their squared norms' sum, so sums along a text bound
every window's cosine, and only windows that can reach the threshold are
compared.  A file's own licence is the template with the greatest cosine of
MIN_COSINE or more; a reservation of rights ("All rights reserved."), which
also stands in the headers of other licences, counts where no other does.

Line frequencies of all words are counted over all lines into a stored table.
Tasks know those of the templates' words and of the KNOWN most frequent words
(a fixed number); any other word counts with the frequency of the last of
these, so its weight is too small and cosines are too great, never too small.
Where a window with such a word could be a file's best, the words are joined to
the table and the file is compared again with their own weights.

``scan`` is the scan by single lines and notices alone.  Every line of every text is a vector over its distinct words; a word's weight
is its count times its inverse line frequency.  Frequencies of the templates'
words are counted over all lines of the input (one row per template word, so
their size is the templates'); any other word has the greatest weight.  A line
can only reach the threshold where its template words hold enough of its norm,
so most lines are dropped before any product.  A file's own licence is its best
line's template with a cosine of MIN_COSINE or more.

A licence file (LICENSE, LICENCE, COPYING, NOTICE, with any extension) gives
its licence to its directory; a file without a licence of its own takes that of
the nearest directory above it.  Distinct directories are joined to licensed
ones by their ancestor paths first, then files to their directories, so a
directory with a third of all files is one row on the small side of a join
that Spark can split.

Edge cases: null and empty texts have no licence of their own.  A null path is
in no directory.  Equal cosines are settled by the licence's name; several
licence files in a directory by the best cosine, then the name.  Repeated rows
get equal results, extra columns are ignored, an empty table gives an empty
result.
"""

from __future__ import annotations

import copy
import math
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Shared, materialize
from .words import ALNUM, Lines, Words, chunks

MIN_COSINE = 0.8

#: fixed values: notices by licence
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License."],
    "BSD-3-Clause": ["Use of this source code is governed by a BSD-style license.",
                     "Redistribution and use in source and binary forms, with or without modification, are permitted "
                     "provided that the following conditions are met:"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.",
                  "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.",
                     "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International "
                     "License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.",
                     "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International "
                     "License."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "Proprietary": ["All rights reserved.", "Copyright. All rights reserved."],
}

#: lines of a header block at most
WINDOW = 40

#: most frequent words whose line frequencies every task knows
KNOWN = 1 << 16

#: the licence that any other one goes before
RESERVED = "Proprietary"

#: short texts that stand in files as headers
SHORT_TEXTS = ["BSD-2-Clause", "BSD-3-Clause", "MIT"]

#: first and last words of the headers that the full texts give
HEADERS = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", None),
    "GPL-2.0": ("This program is free software", "Also add information"),
    "GPL-3.0": ("This program is free software", "Also add information"),
    "LGPL-2.1": ("This library is free software", "Also add information"),
    "MPL-2.0": ("This Source Code Form is subject", "If it is not possible"),
}


class Templates:
    """Word hashes and unit vectors of the notices under given line frequencies."""

    def __init__(self, templates: dict[str, list[str]] = TEMPLATES):
        pairs = [(name, text) for name, texts in sorted(templates.items()) for text in texts]
        self.names = [n for n, _ in pairs]
        words = Words(pa.array([t for _, t in pairs], pa.string()), ALNUM, lower=True)
        self.vocabulary, which = np.unique(words.hash, return_inverse=True)
        self.counts = np.zeros((len(pairs), len(self.vocabulary)))
        np.add.at(self.counts, (words.text_of, which.reshape(-1)), 1)

    def weigh(self, lines: int, frequency: np.ndarray):
        self.idf = np.log((1 + lines) / (1 + frequency)) + 1
        self.other = math.log(1 + lines) + 1
        unit = self.counts * self.idf
        self.unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        return self

    def place(self, hashes: np.ndarray) -> np.ndarray:
        """Vocabulary index of words, -1 for others."""
        at = np.minimum(np.searchsorted(self.vocabulary, hashes), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[at] == hashes, at, -1)


def _line_words(col: pa.Array):
    """(line, word hash, count) of the distinct words of all lines of a piece, and the lines' texts."""
    words, lines = Words(col, ALNUM, lower=True), Lines(col)
    # lines and words are in text order: a word's line is the last that starts before it
    first_of_line = lines.start  # stripped starts never pass a line's first word
    line = np.searchsorted(first_of_line, words.start, side="right") - 1
    by = np.lexsort((words.hash, line))
    h, line = words.hash[by], line[by]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    at = np.flatnonzero(new)
    text = np.searchsorted(lines.first, line[at], side="right") - 1
    return line[at], h[at], np.diff(np.append(at, len(h))), text


def _frequency_rows(templates: Templates):
    def task(batches):
        count, lines = np.zeros(len(templates.vocabulary), dtype=np.int64), 0
        for batch in batches:
            for piece in chunks(batch):
                line, h, _, _ = _line_words(piece.column(0))
                at = templates.place(h)
                count += np.bincount(at[at >= 0], minlength=len(count))
                lines += len(np.unique(line))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, len(count))), pa.array(np.concatenate([[lines], count]))], names=["term", "n"])
    return task


def weighed_templates(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> Templates:
    """Templates under the line frequencies of all of ``files``."""
    out = Templates(templates)
    rows = (files.select(F.col("text").cast("string").alias("text")).where("text is not null")
            .mapInArrow(_frequency_rows(out), "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect())
    n = {r["term"]: r["n"] for r in rows}  # one row per template word
    return out.weigh(n.get(-1, 0), np.array([n.get(i, 0) for i in range(len(out.vocabulary))], dtype=np.float64))


def best_licences(col: pa.Array, templates: Templates, min_cosine: float):
    """(licence or None, cosine) of each text."""
    line, h, count, text = _line_words(col)
    names, cosines = [None] * len(col), np.zeros(len(col))
    if not len(line):
        return names, cosines
    at = templates.place(h)
    known = at >= 0
    weight = count * np.where(known, templates.idf[np.maximum(at, 0)], templates.other)
    lines, of = np.unique(line, return_inverse=True)
    of = of.reshape(-1)
    norm = np.bincount(of, weight ** 2)
    inside = np.bincount(of, np.where(known, weight ** 2, 0))
    some = inside >= (min_cosine - 1e-9) ** 2 * norm  # else no template can reach the threshold
    row = np.full(len(lines), -1)
    row[some] = np.arange(int(some.sum()))
    use = known & some[of]
    x = np.zeros((int(some.sum()), len(templates.vocabulary)))
    x[row[of[use]], at[use]] = weight[use]
    cosine = x @ templates.unit.T / np.sqrt(norm[some])[:, None] if len(x) else x
    line_text = np.zeros(len(lines), dtype=np.int64)
    line_text[of] = text
    for r, t in enumerate(line_text[some].tolist()):
        k = int(cosine[r].round(9).argmax())  # the first of equals: templates are sorted by name
        c = float(cosine[r, k].round(9))
        if c >= min_cosine and (c, ) > (cosines[t], ) or c == cosines[t] and names[t] and templates.names[k] < names[t]:
            names[t], cosines[t] = templates.names[k], c
    return names, cosines


def _own_rows(templates, min_cosine: float):
    def task(batches):
        for batch in batches:
            for piece in chunks(batch):
                names, cosines = best_licences(piece.column(2), templates.value, min_cosine)
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(names, pa.string()), pa.array(cosines)],
                    names=["id", "path", "own", "cosine"])
    return task


def is_licence_file(path: str):
    return F.lower(F.regexp_extract(path, "([^/]*)$", 1)).rlike(r"^(licen[cs]e|copying|notice)(\..*)?$")


def inherit(files: DataFrame) -> DataFrame:
    """``files`` (id, path, own, cosine) plus licence and source_dir of the licence
    a file takes from a directory (null where it is its own)."""
    named = files.withColumn("dir", F.expr("regexp_replace(path, '/?[^/]*$', '')"))
    given = (named.where(is_licence_file("path") & F.col("own").isNotNull()).groupBy("dir")
             .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "own")).alias("best"))
             .select(F.col("dir").alias("above"), F.col("best.own").alias("given")))
    parts = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    nearest = (named.where("dir is not null").select("dir").distinct()
               .select("dir", F.explode(F.array_distinct(above)).alias("above")).join(given, "above")
               .groupBy("dir").agg(F.max(F.struct(F.length("above").alias("n"), "above", "given")).alias("near"))
               .select("dir", "near.above", "near.given"))
    took = F.col("own").isNull() & F.col("given").isNotNull()
    return named.join(nearest, "dir", "left").select(
        "id", "path", "own", "cosine", F.coalesce("own", "given").alias("licence"),
        F.when(took, F.col("above")).alias("source_dir"))


def scan(files: DataFrame, min_cosine: float = MIN_COSINE, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """(id, path, own, cosine, licence, source_dir) of ``files`` (id, path, text)."""
    rows = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"))
    weighed = Shared(files.sparkSession, weighed_templates(rows, templates))
    own = rows.mapInArrow(_own_rows(weighed, min_cosine),
                          f"id {rows.schema['id'].dataType.simpleString()}, path string, own string, cosine double")
    return inherit(own)


def licence_texts() -> dict[str, str]:
    """Full texts by licence, read on the driver alone."""
    return {p.stem: p.read_text() for p in sorted((Path(__file__).parent / "licence_texts").glob("*.txt"))}


def block_templates() -> dict[str, list[str]]:
    """Notices, headers and short texts by licence: what a window is compared to."""
    texts, out = licence_texts(), {n: list(x) for n, x in TEMPLATES.items()}
    for name in SHORT_TEXTS:
        out.setdefault(name, []).append(texts[name])
    for name, (start, end) in HEADERS.items():
        header = texts[name][texts[name].rindex(start):]
        out.setdefault(name, []).append(header[:header.index(end)] if end else header)
    out["LGPL-3.0"].append(out["GPL-3.0"][-1].replace("General Public", "Lesser General Public"))
    return out


class Weights:
    """Inverse line frequencies of known words (sorted hashes); no other word is in more than ``most`` lines."""

    def __init__(self, hashes: np.ndarray, frequency: np.ndarray, lines: int, most: int):
        self.hashes, by = np.unique(hashes, return_index=True)
        self.frequency, self.lines, self.most = frequency[by], lines, most
        self.idf = np.log((1 + lines) / (1 + self.frequency)) + 1
        self.other = math.log((1 + lines) / (1 + most)) + 1

    def plus(self, hashes: np.ndarray, frequency: np.ndarray) -> Weights:
        return Weights(np.concatenate([self.hashes, hashes]), np.concatenate([self.frequency, frequency]), self.lines,
                       self.most)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        at = self.find(hashes)
        return np.where(at >= 0, self.idf[np.maximum(at, 0)], self.other)


class Scorer:
    """Templates under given weights, and the best licence of texts."""

    def __init__(self, min_cosine: float = MIN_COSINE):
        blocks, texts = block_templates(), licence_texts()
        both = Templates({n: blocks.get(n, []) + ([texts[n]] if n in texts and n not in SHORT_TEXTS else [])
                          for n in blocks | texts})
        self.templates, self.min_cosine = both, min_cosine
        self.names = np.array(both.names)
        #: templates of windows: all but the full texts, the last of their licences
        self.block = np.array([not (n in texts and n not in SHORT_TEXTS and both.names[i + 1:i + 2] != [n])
                               for i, n in enumerate(both.names)])

    def weigh(self, weights: Weights):
        self.weights = weights
        unit = self.templates.counts * weights.of(self.templates.vocabulary)
        self.unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
        return self

    def _order(self, cosine: float, name: str):
        """Sorts better results first."""
        return name == RESERVED, -cosine, name

    def _compare(self, h: np.ndarray, count: np.ndarray, which: np.ndarray):
        """The best (order, cosine, name, words not known) of a vector of words, which may repeat, among templates;
        or None.  With words not known the cosine is a bound."""
        words, at = np.unique(h, return_inverse=True)
        weight = np.bincount(at.reshape(-1), count) * self.weights.of(words)
        other = words[self.weights.find(words) < 0]
        place = self.templates.place(words)
        some = place >= 0
        cosine = (self.unit[which][:, place[some]] @ weight[some] / np.linalg.norm(weight)).round(9)
        return min(((self._order(float(c), n), float(c), n, other) for c, n in zip(cosine, self.names[which].tolist())
                    if c >= self.min_cosine), key=lambda x: x[0], default=None)

    def _windows(self, of, first, h, weight, norm2):
        """(bound, first line, lines, template) of all windows that can reach the threshold."""
        n, need = len(norm2), self.min_cosine - 1e-6
        place = self.templates.place(h)
        some = np.flatnonzero(place >= 0)
        before = np.concatenate([[0.0], np.cumsum(norm2)])
        at = np.arange(n)
        last = np.minimum(at + WINDOW, first)  # end of the longest window from each line
        found = []
        for t in np.flatnonzero(self.block).tolist():
            dot = np.bincount(of[some], weight[some] * self.unit[t][place[some]], minlength=n)
            square = np.concatenate([[0.0], np.cumsum(dot ** 2 / norm2)])
            # a window's cosine is at most the root of its lines' squared cosines' sum
            starts = at[square[last] - square[at] >= need ** 2 - 1e-6]
            if not len(starts):
                continue
            total = np.concatenate([[0.0], np.cumsum(dot)])
            for k in range(1, WINDOW + 1):
                starts = starts[starts + k <= last[starts]]
                if not len(starts):
                    break
                bound = (total[starts + k] - total[starts]) / np.sqrt(before[starts + k] - before[starts])
                good = bound >= need
                found.append((bound[good], starts[good], np.full(int(good.sum()), k), np.full(int(good.sum()), t)))
        return [np.concatenate(x) for x in zip(*found)] if found else None

    def best(self, col: pa.Array, whole: list[bool]):
        """(licence or None, cosine, None or the words to look up before these hold) of each text; ``whole`` marks
        the licence files."""
        line, h, count, text = _line_words(col)
        best, open_ = [None] * len(col), [[] for _ in range(len(col))]

        def take(t: int, got):
            if got and len(got[3]):
                open_[t].append(got)
            elif got and (best[t] is None or got[0] < best[t][0]):
                best[t] = got

        if len(line):
            edge = np.flatnonzero(np.append(True, line[1:] != line[:-1]))  # first words of lines
            edge = np.append(edge, len(line))
            of = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            line_text = text[edge[:-1]]
            weight = count * self.weights.of(h)
            end_of_text = np.searchsorted(line_text, line_text, side="right")
            for t in np.flatnonzero(whole).tolist():
                a, b = np.searchsorted(text, [t, t + 1])
                if a < b:
                    take(t, self._compare(h[a:b], count[a:b], np.arange(len(self.names))))
            windows = self._windows(of, end_of_text, h, weight, np.bincount(of, weight ** 2))
            if windows is not None:
                bound, start, k, template = windows
                blocks, seen = np.flatnonzero(self.block), set()
                for i in np.lexsort((-bound, self.names[template] == RESERVED, line_text[start])).tolist():
                    s, e, t = int(start[i]), int(start[i] + k[i]), int(line_text[start[i]])
                    reach = self._order(min(1.0, float(bound[i]) + 1e-6), str(self.names[template[i]]))
                    if (s, e) in seen or best[t] and best[t][0] <= reach:
                        continue
                    seen.add((s, e))
                    take(t, self._compare(h[edge[s]:edge[e]], count[edge[s]:edge[e]], blocks))
        rare = [[x[3] for x in xs if best[t] is None or x[0] < best[t][0]] for t, xs in enumerate(open_)]
        return ([x and x[2] for x in best], np.array([x[1] if x else 0.0 for x in best]),
                [np.unique(np.concatenate(x)).view(np.int64).tolist() if x else None for x in rare])


def _summed(hashes: list, counts: list):
    words, at = np.unique(np.concatenate(hashes), return_inverse=True)
    return words, np.bincount(at.reshape(-1), np.concatenate(counts)).astype(np.int64)


def _word_rows(batches, most: int = 1 << 20):
    """(word, lines that have it), summed up as far as ``most`` words; the lines themselves under null."""
    words, counts, lines = [], [], 0
    size = 0
    for batch in batches:
        for piece in chunks(batch):
            line, h, _, _ = _line_words(piece.column(0))
            lines += len(np.unique(line))
            distinct, n = np.unique(h, return_counts=True)
            words.append(distinct)
            counts.append(n)
            size += len(distinct)
            if size > most:
                w, n = _summed(words, counts)
                words, counts, size = [w], [n], len(w)
                if size > most // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])
                    words, counts, size = [], [], 0
    if size:
        w, n = _summed(words, counts)
        yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["word", "n"])
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([lines], pa.int64())], names=["word", "n"])


def line_frequencies(rows: DataFrame) -> DataFrame:
    """(word, n): the lines that have each word, and under null the lines with words."""
    return materialize(rows.where("text is not null").select("text").mapInArrow(_word_rows, "word long, n long")
                       .groupBy("word").agg(F.sum("n").alias("n")), "line-frequencies")


def known_weights(frequencies: DataFrame, vocabulary: np.ndarray, known: int = KNOWN) -> Weights:
    """Weights of the templates' words and of the ``known`` most frequent ones."""
    lines = frequencies.where("word is null").agg(F.sum("n")).first()[0] or 0
    words = frequencies.where("word is not null")
    terms = frequencies.sparkSession.createDataFrame(pa.table({"word": vocabulary.view(np.int64)}))
    own = words.join(F.broadcast(terms), "word").select("word", "n").toArrow()
    top = words.orderBy(F.desc("n"), "word").limit(known).select("word", "n").toArrow()
    hashes = [own["word"].to_numpy().view(np.uint64), top["word"].to_numpy().view(np.uint64), vocabulary]
    counts = [own["n"].to_numpy(), top["n"].to_numpy(), np.zeros(len(vocabulary), dtype=np.int64)]
    # the first of equal hashes is taken: a template's word that no line has counts 0
    return Weights(np.concatenate(hashes), np.concatenate(counts), lines, int(counts[1].min()) if len(top) == known else 0)


def _best_rows(scorer):
    def task(batches):
        for batch in batches:
            for piece in chunks(batch):
                names, cosines, rare = scorer.value.best(piece.column(2), piece.column(3).to_pylist())
                text = pa.array([None if r is None else x.as_py() for r, x in zip(rare, piece.column(2))], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(names, pa.string()), pa.array(cosines),
                     pa.array(rare, pa.list_(pa.int64())), text, piece.column(3)],
                    names=["id", "path", "own", "cosine", "rare", "text", "whole"])
    return task


def _settled_rows(scorer):
    def task(batches):
        weights = scorer.value.weights
        for batch in batches:
            for piece in chunks(batch):
                words, n = (piece.column(k).flatten().to_numpy(zero_copy_only=False) for k in (4, 5))
                own = copy.copy(scorer.value)
                own.weights = weights.plus(words.view(np.uint64), n)
                names, cosines, _ = own.best(piece.column(2), piece.column(3).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array(names, pa.string()), pa.array(cosines)],
                    names=["id", "path", "own", "cosine"])
    return task


def scan_files(files: DataFrame, min_cosine: float = MIN_COSINE, known: int = KNOWN) -> DataFrame:
    """(id, path, own, cosine, licence, source_dir) of ``files`` (id, path, text):
    header blocks and whole licence files against all templates, under the line
    frequencies of all words.  ``known`` does not change the result."""
    rows = files.select("id", F.col("path").cast("string").alias("path"), F.col("text").cast("string").alias("text"),
                        F.coalesce(is_licence_file("path"), F.lit(False)).alias("whole"))
    frequencies, scorer = line_frequencies(rows), Scorer(min_cosine)
    scorer.weigh(known_weights(frequencies, scorer.templates.vocabulary, known))
    shared = Shared(files.sparkSession, scorer)
    columns = f"id {rows.schema['id'].dataType.simpleString()}, path string, own string, cosine double"
    first = materialize(
        rows.mapInArrow(_best_rows(shared), columns + ", rare array<long>, text string, whole boolean")
        .withColumn("row", F.monotonically_increasing_id()), "licences")
    looked_up = (first.where("rare is not null").select("row", F.explode("rare").alias("word")).join(frequencies, "word")
                 .groupBy("row").agg(F.collect_list(F.struct("word", "n")).alias("found")))
    settled = (first.where("rare is not null").join(looked_up, "row")
               .select("id", "path", "text", "whole", F.col("found.word").alias("words"), F.col("found.n").alias("ns"))
               .mapInArrow(_settled_rows(shared), columns))
    own = first.where("rare is null").select("id", "path", "own", "cosine").unionByName(settled)
    return inherit(materialize(own, "licences-settled"))


def document_files(docs: DataFrame) -> DataFrame:
    """Documents as files: source/lang/block/id.txt, where ids divisible by 50
    are the block's LICENSE and those divisible by 1000 the language's."""
    top = F.concat_ws("/", "source", "lang")
    block = F.floor(F.col("doc_id") / 50).cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("id"),
        F.when(F.col("doc_id") % 1000 == 0, F.concat(top, F.lit("/LICENSE")))
        .when(F.col("doc_id") % 50 == 0, F.concat(top, F.lit("/"), block, F.lit("/LICENSE")))
        .otherwise(F.concat(top, F.lit("/"), block, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")))
        .alias("path"), "text")
