"""Licence scan of header blocks and whole licence files."""

import math
import random
import textwrap
from collections import Counter

import pytest

from gacetilla.llm import licences

from . import helpers as H


def _own(spark, rows):
    files = spark.createDataFrame(rows, "id long, path string, text string")
    return {r.id: r for r in licences.scan_files(files).collect()}


def _header(name, sign, width=60):
    lines = [x for p in licences.block_templates()[name][-1].split("\n\n") for x in textwrap.wrap(" ".join(p.split()), width) + [""]]
    return "\n".join(f"{sign} {x}".rstrip() for x in ["Copyright (C) 2024 Acme", "", *lines]) + "\n\nint main() { return 0; }\n" + "code of x = y;\n" * 50


def test_wrapped_headers_and_full_texts(spark):
    headers = ["Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0"]
    texts = licences.licence_texts()
    rows = [(i, f"h/{n}.c", _header(n, sign, width)) for i, (n, sign, width) in enumerate(
        (n, s, w) for n in headers for s, w in (("//", 76), (" *", 50)))]
    rows += [(100 + i, f"t{i}/LICENSE", "Copyright (c) 2024 Acme\nAll rights reserved.\n\n" + t) for i, t in enumerate(texts.values())]
    rows += [(200 + i, f"t{i}/src/a.c", "int a;") for i in range(len(texts))]
    rows += [(300, "r/a.c", "x\nAll rights reserved.\ny"), (301, "r/b.c", None), (302, None, "\n\n"), (303, "r/LICENSE", "")]
    got = _own(spark, rows)
    for i, path, _ in rows[:2 * len(headers)]:
        assert got[i].own == path[2:-2], path
    for i, name in enumerate(texts):
        assert got[100 + i].own == name and got[200 + i].licence == name and got[200 + i].source_dir == f"t{i}"
    assert [got[i].own for i in (300, 301, 302, 303)] == ["Proprietary", None, None, None]


def _plain(rows):
    """Every window and every whole licence file against every template, with the line frequencies of all words."""
    words = lambda t: Counter(H.ALNUM.findall(t.translate(H.LOWER)))
    texts = {i: [x for x in map(words, (t or "").split("\n")) if x] for i, _, t in rows}
    lines = [x for xs in texts.values() for x in xs]
    df = Counter(w for x in lines for w in x)
    vector = lambda c: {w: n * (math.log((1 + len(lines)) / (1 + df[w])) + 1) for w, n in c.items()}
    norm = lambda v: math.sqrt(sum(y * y for y in v.values()))
    block = [(n, vector(words(t))) for n, ts in licences.block_templates().items() for t in ts]
    full = block + [(n, vector(words(t))) for n, t in licences.licence_texts().items()]
    out = {}
    for i, path, _ in rows:
        xs = texts[i]
        whole = path and path.rsplit("/", 1)[-1].lower().split(".")[0] in ("license", "licence", "copying", "notice")
        cases = [(xs[a:b], block) for a in range(len(xs)) for b in range(a + 1, min(len(xs), a + licences.WINDOW) + 1)]
        found = []
        for part, templates in cases + [(xs, full)] * bool(whole and xs):
            v = vector(sum(part, Counter()))
            for name, tv in templates:
                c = round(sum(v.get(w, 0) * y for w, y in tv.items()) / norm(v) / norm(tv), 9)
                if c >= licences.MIN_COSINE:
                    found.append((name == licences.RESERVED, -round(c, 6), name))
        best = min(found, default=(0, 0, None))
        out[i] = (best[2], -best[1])
    return out


@pytest.mark.parametrize("known", [licences.KNOWN, 1, 30])
def test_weights_of_all_words(spark, known):
    r = random.Random(5)
    word = lambda: f"w{int(r.paretovariate(0.5)) % 300}"
    notices = ["Copyright 2024 Acme Inc. All rights reserved.", "Released under the MIT License, they say.",
               "Licensed under the Apache\n# License, Version 2.0.", "* This work is licensed under the GNU General\n"
               "* Public License, version 3.", "Released under\nthe MIT License.\nReleased under the MIT License ok"]
    rows = [(0, "LICENSE", "a\nLicensed under CC BY 4.0. " + word()), (1, None, None)]
    for i in range(2, 60):
        lines = [" ".join(word() for _ in range(r.randint(0, 6))) for _ in range(r.randint(0, 4))]
        if i % 2:
            lines.insert(r.randint(0, len(lines)), r.choice(notices) + (" " + word()) * (i % 3 == 0))
        rows.append((i, f"d{i % 7}/{'NOTICE' if i % 10 == 0 else i}", "\n".join(lines)))
    files = spark.createDataFrame(rows, "id long, path string, text string")
    got = {x.id: (x.own, round(x.cosine, 6)) for x in licences.scan_files(files, known=known).collect()}
    assert got == _plain(rows) and len({x[0] for x in got.values()}) > 4


def test_a_common_word_counts_little(spark):
    holder = "Copyright 2024 Acme Inc. All rights reserved."
    rows = [(i, f"{i}.c", holder if i == 0 else "2024 acme inc " + f"x{i}") for i in range(300)]
    assert _own(spark, rows)[0].own == "Proprietary"
    assert licences.scan(spark.createDataFrame(rows, "id long, path string, text string")).where("id = 0").first().own is None
