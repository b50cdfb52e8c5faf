"""Operators on texts against plain versions, with nulls, ties, copies and empty tables."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gacetilla.llm import decontaminate, fm_index, line_dedup, ngram_join, quality_rules, repeats
from gacetilla.llm.words import ALNUM, SPACED, Lines, Words, chunks

from . import helpers as H


@pytest.fixture(scope="module")
def texts():
    return H.corpus()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return H.documents(spark, texts).repartition(3).persist()


@pytest.fixture(scope="module")
def empty(spark):
    return H.documents(spark, [])


def test_words_and_lines_match_regular_expressions(texts):
    col = pa.array([t for _, t in texts])
    for lower, cls, pattern in ((False, SPACED, H.SPACED), (True, ALNUM, H.ALNUM)):
        words = Words(col, cls, lower=lower)
        names = {}
        for i, (_, t) in enumerate(texts):
            t = (t or "").translate(H.LOWER) if lower else t or ""
            a, b = words.first[i], words.first[i + 1]
            got = [bytes(words.data[s:e]).decode() for s, e in zip(words.start[a:b], words.end[a:b])]
            assert got == pattern.findall(t)
            for w, h in zip(got, words.hash[a:b].tolist()):
                assert names.setdefault(w, h) == h
        assert len(set(names.values())) == len(names)
    lines = Lines(col)
    for i, (_, t) in enumerate(texts):
        a, b = lines.first[i], lines.first[i + 1]
        keys = [bytes(lines.data[s:e]).decode() for s, e in zip(lines.start[a:b], lines.end[a:b])]
        assert keys == [x.strip(" \t\n\x0b\x0c\r").translate(H.LOWER) for x in (t or "").split("\n")]
        assert lines.length[a:b].tolist() == [len(k) for k in keys]


def test_chunks_keep_whole_texts():
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(["a" * 10, None, "b" * 100, "c"])],
                                       names=["doc_id", "text"])
    parts = list(chunks(batch, size=12))
    assert [len(p) for p in parts] == [2, 1, 1]
    assert pa.Table.from_batches(parts).to_pylist() == batch.to_pylist()


def test_quality_rules(docs, empty, texts):
    order = quality_rules.cascade(docs)
    assert {r.name for r in order} == {r.name for r in quality_rules.rules()}
    got = quality_rules.verdict(docs, order)
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    want = []
    for i, t in texts:
        s = H.statistics(t)
        want.append((i, *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    H.same(got.select(*cols), want)
    assert got.where("base_failed and kept").count() == 0
    # the order of the rules never changes the result; a chain of filters agrees with the verdict
    a = H.rows_of(got.where("kept").select("doc_id", "text"))
    assert a == H.rows_of(quality_rules.keep(docs, order[::-1]).select("doc_id", "text"))
    assert quality_rules.keep(docs, order).columns == docs.columns
    assert quality_rules.verdict(empty, quality_rules.cascade(empty)).count() == 0


def test_cascade_puts_rejection_per_cost_first(spark):
    sample = H.documents(spark, [(i, "word " * 12) for i in range(50)])
    some = [quality_rules.Rule("never", "text = 'z'"), quality_rules.Rule("always", "text is not null")]
    assert [r.name for r, _, _ in quality_rules.order_rules(sample, some)] == ["always", "never"]


def test_suffix_order_and_backward_search():
    rng = np.random.default_rng(4)
    for n, letters, empty in ((1, 1, 0), (7, 1, 0), (60, 2, 0), (900, 3, 0), (900, 200, 0), (50, 2, 20), (40, 1, 39)):
        s = rng.integers(1, letters + 1, n).astype(np.uint8)
        s[rng.random(n) < 0.05] = 0
        s[-1 - empty:] = 0  # texts without words at the end
        s[:empty // 2] = 0
        raw = s.tobytes()
        assert fm_index.suffix_order(s).tolist() == sorted(range(n), key=lambda i: raw[i:])
        index = fm_index.FMIndex(s)
        phrases = rng.integers(1, letters + 1, (15, 3)).astype(np.uint8)
        for p, lo, hi in zip(phrases, *index.count(phrases)):
            at = sorted(index.locate(np.arange(lo, hi)).tolist())
            assert at == [i for i in range(n) if raw[i:i + 3] == p.tobytes()]


@pytest.mark.parametrize("options", [{}, {"shard_words": 200, "block_words": 60}])
def test_decontamination(spark, docs, empty, texts, options):
    w = [H.SPACED.findall(t or "") for _, t in texts]
    items = [(1, " ".join(w[4][:40])), (2, " ".join(x for x in w if len(x) > 80 for x in x[20:45])[:400].upper()),
             (3, "ab ab"), (4, None), (5, "  "), (None, " ".join(w[4][:40])), (6, " ".join(w[4][10:30])), (3, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs, bench, **options)
    want = H.contamination(texts, items)
    assert sum(x[2] > 0 for x in want) > 2
    H.same(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256"), want)
    clean = decontaminate.drop_contaminated(docs, bench, **options)
    assert clean.columns == docs.columns
    H.same(clean.select("doc_id", "text"), [t for t, x in zip(texts, want) if not x[2]])
    assert decontaminate.contamination(empty, bench).count() == 0
    H.same(decontaminate.contamination(docs, bench.limit(0)).select("n_hit").distinct(), [(0,)])


def test_decontamination_counts_a_repeated_id_once(spark):
    texts = [(1, "a b c x d e f"), (2, "a b c"), (3, "d e f g h i"), (4, "none")]
    items = [(7, "a b c"), (7, "d e f"), (8, "g h i"), (7, "a b c")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame(texts, "doc_id long, text string"), bench)
    H.same(got.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256"), H.contamination(texts, items))
    assert {r.doc_id: r.n_items for r in got.collect()} == {1: 1, 2: 1, 3: 2, 4: 0}


@pytest.mark.parametrize("options", [{}, {"shard_lines": 7, "probes_per_task": 5}])
def test_line_dedup(docs, empty, texts, options):
    got = line_dedup.drop_lines(docs, **options)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    want = H.kept_lines(texts)
    assert sum(x[2] for x in want) > 10
    H.same(got.select("doc_id", "n_lines", "n_dropped", "text"), want)
    assert line_dedup.drop_lines(empty).count() == 0


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    h1, h2 = (rng.integers(0, 1 << 63, 5000, dtype=np.uint64) for _ in range(2))
    h1[1:10] = h1[0]  # one hash alone may collide
    ph, prints, counts, owners = line_dedup.unpack(line_dedup.pack(h1, h2, np.arange(5000), np.ones(5000, np.int64) * 3))
    slot = ph.slot(h1, h2)
    assert sorted(slot.tolist()) == list(range(5000))
    assert (owners[slot] == np.arange(5000)).all() and (counts == 3).all()
    assert (prints[slot] == (h2 >> np.uint64(32))).all()


def test_substring_dedup(docs, empty, texts):
    got = repeats.remove_repeats(docs)
    want = H.repeats(texts)
    assert sum(x[2] for x in want) > 200
    H.same(got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)), want)
    assert repeats.remove_repeats(empty).count() == 0


def test_equal_windows_have_equal_anchors():
    rng = np.random.default_rng(8)
    common = rng.integers(1, 1 << 62, 90).astype(np.uint64)
    common[40:52] = common[40]  # a run inside
    parts, first = [], [0]
    for _ in range(20):
        parts += [rng.integers(1, 1 << 62, int(rng.integers(0, 30))).astype(np.uint64), common]
        parts.append(common[-1:].repeat(int(rng.integers(0, 4))))
        first.append(sum(map(len, parts)))
    names = np.concatenate(parts)
    starts, anchor = repeats.anchors(names, np.array(first))
    met = {}
    for s, a in zip(starts.tolist(), anchor.tolist()):
        assert met.setdefault(names[s:s + 50].tobytes(), a) == a


def test_near_copies(docs, empty, texts):
    want = H.near_copies(texts)
    assert len({x[2] for x in want}) < len(want) - 8
    H.same(ngram_join.near_copies(docs, k=4, threshold=85), want)
    H.same(ngram_join.near_copies(docs), H.near_copies(texts, 5, 80))
    assert ngram_join.near_copies(empty).count() == 0


def test_near_copies_of_one_family(spark):
    """A family in which links chain: every member differs a little from the next."""
    w = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(40):
        v = list(w)
        for j in range(i // 2):
            v[(3 * j) % 120] = f"z{j}"
        rows.append((100 - i, " ".join(v)))
    rows += [(500 + i, " ".join(w[:100] + [f"u{i}{j}" for j in range(i)])) for i in range(25)]
    H.same(ngram_join.near_copies(H.documents(spark, rows)), H.near_copies(rows, 5, 80))
