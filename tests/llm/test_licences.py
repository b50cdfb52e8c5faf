"""Licence scan against a plain version."""

import math
from collections import Counter

from gacetilla.llm import licences

from . import helpers as H


def plain(rows, min_cosine=licences.MIN_COSINE):
    words = lambda t: Counter(H.ALNUM.findall(t.translate(H.LOWER)))
    templates = [(n, words(t)) for n, ts in sorted(licences.TEMPLATES.items()) for t in ts]
    vocabulary = {w for _, t in templates for w in t}
    lines = [words(x) for _, _, t in rows for x in (t or "").split("\n")]
    lines = [x for x in lines if x]
    df = Counter(w for x in lines for w in x)
    idf = lambda w: math.log((1 + len(lines)) / (1 + df[w] if w in vocabulary else 1)) + (
        1 if w in vocabulary else 1)
    own = []
    for i, path, t in rows:
        best = (0.0, None)
        for x in (t or "").split("\n"):
            v = {w: n * idf(w) for w, n in words(x).items()}
            for name, tw in templates:
                tv = {w: n * idf(w) for w, n in tw.items()}
                dot = sum(v.get(w, 0) * y for w, y in tv.items())
                norm = math.sqrt(sum(y * y for y in v.values()) * sum(y * y for y in tv.values()))
                c = round(dot / norm, 9) if norm else 0.0
                if c >= min_cosine and (c > best[0] or c == best[0] and name < best[1]):
                    best = (c, name)
        own.append(best)
    given = {}
    for (i, path, _), (c, name) in zip(rows, own):
        if path and name and path.rsplit("/", 1)[-1].lower().split(".")[0] in ("license", "licence", "copying", "notice"):
            d = path.rpartition("/")[0]
            given[d] = min(given.get(d, (9, "")), (-c, name))
    out = []
    for (i, path, _), (c, name) in zip(rows, own):
        licence, source = name, None
        if name is None and path is not None:
            d = path.rpartition("/")[0]
            while licence is None:
                if d in given:
                    licence, source = given[d][1], d
                if not d:
                    break
                d = d.rpartition("/")[0]
        out.append((i, path, name, round(c, 6), licence, source))
    return out


def test_scan(spark):
    rows = [(1, "LICENSE", "Released under the MIT License."), (2, "a/b/c.txt", "words\nand more"),
            (3, "a/LICENCE.md", "text of a file\nLicensed under the Apache License, Version 2.0.\nend"),
            (4, "a/b/COPYING", "no licence here"), (5, "a/x.txt", None), (6, "z/q.txt", "All rights reserved."),
            (7, "a/b/d/e/f.txt", ""), (8, None, "Released under the MIT License!"), (9, "f.txt", "x"),
            (10, "a/NOTICE", "Released under the MIT License, they say."), (2, "a/b/c.txt", "words\nand more"),
            (11, "a/g.txt", "licensed UNDER cc by-nc 4.0. ok\nfiller " * 3), (None, "", "word " * 5000),
            (12, "long.txt", "the of a " * 5000 + "\nThis work is licensed under the GNU General Public License, version 3.")]
    files = spark.createDataFrame([(*r, "x") for r in rows], "id long, path string, text string, own string")
    got = [(*r[:3], round(r[3], 6), *r[4:]) for r in licences.scan(files).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert licences.scan(files.limit(0)).count() == 0


def test_scan_of_the_test_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    files = licences.document_files(docs)
    rows = [tuple(r) for r in files.select("id", "path", "text").collect()]
    got = [(*r[:3], round(r[3], 6), *r[4:]) for r in licences.scan(files).collect()]
    assert sorted(got, key=repr) == sorted(plain(rows), key=repr)
    assert sum(r[2] is not None for r in got) > 0
