"""Alignment, conversation repair and nearest neighbours against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gacetilla.llm import anchors, repair, vantage

from . import helpers as H

P = pytest.importorskip("public_tokenizers")
PATHS = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def test_alignment(spark):
    rows = H.corpus(30) + [(950, "a▁b"), (951, " \t x  y"), (952, "<s> <|endoftext|> </s>"), (953, "漢字 " * 50),
                           (954, "the cat, the dog and the cat")]
    docs = H.documents(spark, rows).repartition(3)
    H.same(anchors.align(docs, *PATHS), H.aligned(rows, *PATHS))
    empty = anchors.align(H.documents(spark, []), *PATHS)
    assert empty.count() == 0 and empty.columns[0] == "doc_id"
    only = anchors.align(H.documents(spark, [(1, None), (None, "")]), *PATHS)
    H.same(only, [(1, 0, 0, 0, 0, 0, 0, ""), (None, 0, 0, 0, 0, 0, 0, "")])


def test_rows_of_a_block_are_small(spark):
    """Lists of a block are cut into rows of PART entries; the sums are those of the whole."""
    r = random.Random(8)
    rows = [(i, " ".join("".join(r.choice("abcdeo") for _ in range(r.randint(2, 9))) for _ in range(400))) for i in range(90)]
    blocks = {}

    def kept(df, name, *options):
        blocks["rows"] = materialize(df, name, *options)
        return blocks["rows"]
    materialize = anchors.materialize
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(anchors, "materialize", kept)
        H.same(anchors.align(H.documents(spark, rows).coalesce(1), *PATHS), H.aligned(rows, *PATHS))
    lists = ("doc_id", "pairs", "places", "links")
    sizes = blocks["rows"].select("block", *[F.size(c).alias(c) for c in lists]).collect()
    assert len(sizes) > len({x.block for x in sizes}) and max(x[c] for x in sizes for c in lists) <= 12_000


def test_rank_encoding_is_the_files_encoding():
    with open(PATHS[0], encoding="utf-8") as f:
        own = anchors.ByteLevel(f.read())
    assert own.ranks is not None
    codes = [c for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    for at in range(0, len(codes), 50_000):
        texts = [f"a{chr(c)}{chr(c)}1 {chr(c)}! {chr(c)} b" for c in codes[at:at + 50_000]]
        want = own.model.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        assert [own.encode(t) for t in texts] == [e.ids for e in want]
    long = "x" + " " * 40_000 + "y\n\n\n" + "z" * 40_000
    assert own.encode(long) == own.model.encode(" " + long, add_special_tokens=False).ids


def test_windows_are_remembered_by_ids_and_forgotten(spark):
    with open(PATHS[0], encoding="utf-8") as f, open(PATHS[1], "rb") as g:
        own = anchors.Aligner(f.read(), g.read(), memo=5)
    texts = ["the cat sat on the mat", "the cat sat on the mat", None, "x" * 3000, "漢字" * 900, "other words than before"]
    one = own.block(texts)
    a, b = own.tokens(texts[0])
    windows = own.windows(a, b)
    assert len(windows) > 3 and len(set(windows)) < len(windows)  # "the" comes twice
    two = own.block(texts)  # after forgetting
    assert all(np.array_equal(one[c], two[c]) for c in one)
    # no anchor in a text without spaces: one window, whatever its length
    assert len(own.windows(*own.tokens("é" * 500))) == 1


def test_lightest_derivation_is_the_best_of_all_edits():
    r = random.Random(5)
    axioms = repair.row_axioms()
    for _ in range(60):
        rows = [(i, r.choice(["user", "assistant", "system", "tool"]), "x") for i in range(r.randint(0, 4))]
        marks = [r.choice("---tbd") for _ in rows]
        want = H.every_repair(rows, marks, 2)
        shape = [axioms[role[0] if role[0] in "sua" else "", m] for (_, role, _), m in zip(rows, marks)]
        cost, audit = min(repair.lightest(shape, 0)[0].values())[:2]
        lines, state = repair.written(audit, 0, [x[1] for x in rows], [x[2] for x in rows])
        assert (cost, audit, tuple(lines)) == want and state in repair.ENDS
        assert H.stepwise_repair(rows, marks) == want


@pytest.fixture(scope="module")
def conversations():
    r = random.Random(3)
    said = ["Hello.", "Hi there!", "cut of", "", " \t", None, "é漢?  \n", "Why?"]
    rows = []
    for conv in [None, *range(40)]:
        for t in range(r.choice([1, 2, 3, 6, 20, 150])):
            rows.append((conv, r.choice([t, t, t, t, None, t - 1]),
                         r.choice(["user", "assistant"] * 3 + ["system", "tool", None, ""]), r.choice([*said, f"row {t}."])))
    return rows


CONV = "conv_id long, turn long, role string, text string, part string, live int, n string"


@pytest.mark.parametrize("segment", [2048, 7])
def test_conversation_repair(spark, conversations, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT_ROWS", segment)
    df = spark.createDataFrame([(*x, "p", 0, None) for x in conversations], CONV).repartition(5)
    want = H.repaired(conversations)
    H.same(repair.repair(repair.damage(df)), want)
    assert set("".join(x[7] for x in want)) == set("DKR")
    assert repair.written("IRI", 0, ["tool"], ["x"]) == (["user:", "assistant:x", "user:"], 2)


def test_conversation_repair_edges(spark):
    empty = spark.createDataFrame([], CONV)
    assert repair.repair(repair.damage(empty)).count() == 0
    # conversations that lose all their rows are still there
    gone = [(c, t, "user", "x.") for c in range(400) for t in range(1)]
    got = repair.repair(repair.damage(spark.createDataFrame(gone, CONV.split(", part")[0])))
    H.same(got, H.repaired(gone))
    assert got.count() == 400 and got.where("audit = ''").count() > 5
    # without damage: rows given as they are
    rows = spark.createDataFrame([(1, 0, "user", "long. " * 50_000), (1, 1, "assistant", "Yes.")], CONV.split(", part")[0])
    assert repair.repair(rows).first()["audit"] == "KK"


VEC = "vec_id long, embedding array<float>, label int, row string, id int"


@pytest.fixture(scope="module")
def vectors():
    r = np.random.default_rng(2)
    centre = r.normal(size=(8, 6))
    rows = [(i, [float(np.float32(x)) for x in centre[i % 8] + r.normal(size=6) * 0.2]) for i in range(900)]
    hot = rows[0][1]
    rows += [(1000 + i, hot) for i in range(400)]  # one vector in a third of the rows
    rows += [(2000, None), (2100, []), (2200, [0.0] * 6), (2300, [1.0, None, 0.0, 0.0, 0.0, 0.0]),
             (2400, [1.0, float("nan"), 0.0, 0.0, 0.0, 0.0]), (2500, [float("inf")] * 6), (None, hot), (None, rows[3][1]),
             (300, rows[300][1]), (2600, [1.0, 2.0]), (2601, [1.0, 2.5])]
    return rows


def test_exact_search(spark, vectors, monkeypatch):
    monkeypatch.setattr(vantage, "SHARD_BYTES", 200 * 24)
    monkeypatch.setattr(vantage, "BLOCK_BYTES", 5 * 24)
    monkeypatch.setattr(vantage, "LEAF", 16)
    df = spark.createDataFrame([(*x, 1, "r", 2) for x in vectors], VEC).repartition(3)
    got = vantage.neighbours(vantage.points(df), F.col("id") % 100 == 0).select(
        "query_id", "rank", "vec_id", F.round("score", 9))
    H.same(got, H.nearest(vectors))


def test_search_edges(spark):
    empty = vantage.neighbours(vantage.points(spark.createDataFrame([], VEC)), F.col("id") % 100 == 0)
    assert empty.count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 3.0])], "vec_id long, embedding array<double>")
    got = vantage.neighbours(vantage.points(few), F.col("id") % 100 == 0).select("query_id", "rank", "vec_id", "score")
    H.same(got, [(0, 1, 1, 10 ** 0.5)])


def test_factor_trades_recall_for_leaves():
    r = np.random.default_rng(4)
    v = r.normal(size=(6000, 16)).astype(np.float32)
    ids = rows = np.arange(len(v))
    q = rows[::100]
    tree = vantage.Tree(v, leaf=64)
    assert sorted(np.concatenate([m for m, _ in tree.leaves]).tolist()) == rows.tolist()
    found, looked = {}, {}
    for factor in (1.0, 2.0, 6.0):
        found[factor] = vantage.Found(len(q), 10)
        looked[factor] = vantage.search(tree, ids, rows, v[q].astype(float), q, found[factor], factor)
    away = np.linalg.norm(v[q].astype(float)[:, None] - v.astype(float)[None], axis=2)
    away[np.arange(len(q)), q] = np.inf
    assert np.array_equal(found[1.0].rows, np.argsort(away, axis=1)[:, :10])
    recall = {f: np.mean([len(set(a) & set(b)) / 10 for a, b in zip(found[1.0].rows, x.rows)]) for f, x in found.items()}
    assert looked[6.0] < looked[2.0] < looked[1.0] < len(q) * len(tree.leaves) and recall[2.0] >= 0.9
