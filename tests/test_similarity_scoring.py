"""Fuzzy lexicon match (J1, X7) and relevance scores."""

import random

import pytest
from pyspark.sql import functions as F

from conftest import dice
from gacetilla.operators.scoring import score_breakdown
from gacetilla.operators.similarity import dice_pairs, matched_tokens
from gacetilla.schema import ERROR_TYPE
from gacetilla.sources.lexicon import BUILTIN_ROOTS, builtin_lexicon, combined_lexicon

# Words and whether they are similar to a built-in root.
WORDS = {
    "Presidente": True, "President": True, "Presidencial": True, "Presidential": True,
    "Elección": True, "Elecciones": True, "Election": True, "Elections": True,
    "Clima": True, "Climate": True, "Climático": False, "Technology": True, "Tecnológico": True,
}


def test_builtin_lexicon(spark):
    assert len(BUILTIN_ROOTS) == 67
    assert builtin_lexicon(spark).count() == 63


def test_similar_to_root_word(spark):
    toks = spark.createDataFrame([(w,) for w in WORDS], "token string")
    got = {r.token for r in matched_tokens(toks, builtin_lexicon(spark)).collect()}
    assert got == {w for w, ok in WORDS.items() if ok}


def test_dice_pairs_match_brute_force(spark):
    rnd = random.Random(7)
    alphabet = "aeiouéñrstlncpC "
    words = {"".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 9))) for _ in range(400)}
    words |= {"Crisis", " Economy", "ley", "caos", "energía", "policía", "Law", "é", "a"}
    roots = list(dict.fromkeys(BUILTIN_ROOTS)) + ["a", "é", "crisi", "Cris"]
    toks = spark.createDataFrame([(w,) for w in words], "token string")
    lex = spark.createDataFrame([(r,) for r in roots], "root string")
    got = {(r.token, r.root): r.dice for r in dice_pairs(toks, lex, threshold=0.5).collect()}
    want = {(w, r): dice(w, r) for w in words for r in roots if dice(w, r) >= 0.5}
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v)


@pytest.mark.parametrize("unit,threshold", [("byte", 0.75), ("char", 0.75), ("byte", 0.4), ("char", 0.95), ("byte", 1.0)])
def test_large_lexicon_matches_brute_force(spark, unit, threshold):
    rnd = random.Random(11)
    stems = ["".join(rnd.choice("abcdé") for _ in range(rnd.randint(2, 6))) for _ in range(12)]
    words = sorted({"".join(rnd.choice(stems) for _ in range(rnd.randint(1, 3)))[:rnd.randint(1, 12)] for _ in range(220)}
                   | {"aaaa", "aaaaa", "ababab", "bababa", "a", "é", "a a", " ", "aa2", "a2", "😀😀a"})
    df = spark.createDataFrame([(w,) for w in words] + [(None,), (words[0],)], "w string")
    got = {(r.token, r.root): r.dice for r in dice_pairs(df, df, "w", "w", threshold, unit).collect()}
    blank = lambda w: not w.strip()
    want = {(a, b): dice(a, b, unit) for a in words for b in words
            if dice(a, b, unit) >= threshold and not blank(a) and not blank(b)}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(v) for k, v in want.items())


def test_prefix_filter_leaves_few_candidates(spark):
    from gacetilla.operators.similarity import _words, dice_candidates
    rnd = random.Random(3)
    words = sorted({"".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(4, 9))) for _ in range(600)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = dice_candidates(_words(df, "w", "token", "char"), _words(df, "w", "root", "char"), 0.75).select("token", "root")
    grams = [{w[i:i + 2] for i in range(len(w) - 1)} for w in words]
    sharing = sum(bool(a & b) for a in grams for b in grams) - len(words)
    assert found.distinct().count() == found.count() < sharing / 4


def test_alike_words_leave_few_candidates(spark):
    """Words of few syllables, as many hold every bigram, against themselves."""
    from gacetilla.operators.similarity import _words, dice_candidates
    rnd = random.Random(5)
    syllables = [a + b for a in "bcdfgl" for b in "aeio"]
    words = sorted({"".join(rnd.choice(syllables) for _ in range(rnd.randint(2, 6))) for _ in range(4000)})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    found = dice_candidates(_words(df, "w", "token", "byte"), _words(df, "w", "root", "byte"), 0.95).count()
    assert found < 2 * len(words)


def test_elements_are_made_inside_the_row(spark):
    """No aggregate holds a row for each bigram of a word."""
    from gacetilla.operators.similarity import _elements, _words
    words = _words(spark.createDataFrame([("Crisis",), ("aaaa",)], "w string"), "w", "token", "byte")
    plan = _elements(words, "token", bytes([3]) * (1 << 14), 0.75)._jdf.queryExecution().optimizedPlan().toString()
    # the one of the distinct words, and the rows of the keys
    assert plan.count("Aggregate") == 1 and plan.count("Generate") == 1 and "Join" not in plan


def test_no_filter_works_out_elements_of_occurrences(spark):
    df = spark.createDataFrame([("Crisis",), ("aaaa",)], "w string")
    plan = dice_pairs(df, builtin_lexicon(spark), "w")._jdf.queryExecution().optimizedPlan().toString()
    assert not [x for x in plan.split("\n") if "Filter" in x and "lambda" in x]


def test_words_are_made_distinct_once(spark):
    df = spark.createDataFrame([("Crisis",), ("Crisis",), (None,), ("aaaa",)], "w string")
    pairs = dice_pairs(df, builtin_lexicon(spark), "w")
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [token" not in plan and "Aggregate [w" not in plan
    assert [r.token for r in pairs.where("dice = 1").collect()] == [r.token for r in pairs.where("token = root").collect()]


@pytest.mark.parametrize("unit,threshold", [("byte", 0.75), ("char", 0.95), ("byte", 0.97)])
def test_words_of_all_lengths_match_brute_force(spark, unit, threshold):
    """Pairs around the length where keys of several elements end, and repeated bigrams."""
    rnd = random.Random(13)
    words = []
    for n in [1, 2, 3, 4, 5, 8, 12, 20, 37, 38, 39, 40, 41, 42, 43, 44, 60, 64, 66, 68, 150]:
        w = "".join(rnd.choice("abcdeé") for _ in range(n))
        at = rnd.randrange(n)
        words += [w, w[:at] + "a" + w[at + 1:], w[:at] + w[at:] + "b", w[1:] + w[0], w + w[:2], "ab" * (n // 2) + "a"]
    words = sorted({w for w in words if w})
    df = spark.createDataFrame([(w,) for w in words], "w string")
    rows = dice_pairs(df, df, "w", "w", threshold, unit).collect()
    want = {(a, b): dice(a, b, unit) for a in words for b in words if dice(a, b, unit) >= threshold}
    assert len(rows) == len(want) and {(r.token, r.root) for r in rows} == set(want)
    assert all(r.dice == pytest.approx(want[r.token, r.root]) for r in rows)


@pytest.mark.parametrize("cell,chunk", [(50, 40), (1000, 7)])
def test_own_lexicon_in_many_cells(spark, monkeypatch, cell, chunk):
    """A table as its own lexicon: slots cut into chunks, every pair once and both ways."""
    from functools import partial

    from gacetilla.operators import alike
    monkeypatch.setattr(alike, "cells", partial(alike.cells, cell=cell, chunk=chunk))
    rnd = random.Random(17)
    syllables = [a + b for a in "bcdé" for b in "aeió"]
    words = sorted({"".join(rnd.choice(syllables) for _ in range(rnd.randint(1, 6))) for _ in range(300)}
                   | {"ab" * 30, "ab" * 31, "ab" * 30 + "c", "b" + "ab" * 20, "ba ba", "baba", "😀😁é😀", "😀😁é😀😁"})
    df = spark.createDataFrame([(w,) for w in words], "w string").repartition(3)
    rows = dice_pairs(df, df, "w", "w").collect()
    want = {(a, b): dice(a, b) for a in words for b in words if dice(a, b) >= 0.75}
    assert len(rows) == len(want) and {(r.token, r.root) for r in rows} == set(want)
    assert all(r.dice == want[r.token, r.root] and (r.dice == 1 or r.dice == 2 * r.inter / r.denom) for r in rows)


def test_long_words_and_steps(monkeypatch):
    """Words longer than those with combined keys, and candidates cut into steps."""
    import numpy as np

    from gacetilla.operators import alike
    monkeypatch.setattr(alike, "STEP", 7)
    monkeypatch.setattr(alike, "MATRIX", 900)
    rnd = random.Random(19)
    long = ["".join(rnd.choice("abcdefgh") for _ in range(60)) for _ in range(3)]
    words = sorted({w[:k] + x + w[k:] for w in long for k in (0, 9, 30, 60) for x in ("", "y", "zz")}
                   | {"".join(rnd.choice("abc") for _ in range(rnd.randint(2, 9))) for _ in range(60)})
    held = np.ones(1 << alike.SLOT_BITS, np.int8)
    rows = [(w, at) for w in words for at in range(len(w) - 1)]
    cell = alike.Cell([w for w, _ in rows], np.array([at for _, at in rows]), np.full(len(rows), -1), held, 0.75, "byte")
    got = [(rows[i][0], rows[j][0], int(n)) for a, b, shared in cell.pairs() for i, j, n in zip(a, b, shared)]
    assert len({(a, b) for a, b, _ in got}) == len(got)
    assert all(2 * n / (len(a) + len(b) - 2) == dice(a, b) >= 0.75 and len(a) <= len(b) for a, b, n in got)
    assert len(got) == sum(dice(a, b) >= 0.75 for i, a in enumerate(words) for b in words[:i])
    assert sum(len(a) > 40 for a, _, _ in got) > 20


def test_similar_words_meet_the_rankings_threshold(spark, workdir):
    """The words of the documents are matched as the ranking matches them, not only near copies."""
    from gacetilla.plans.contract import q_similar_words
    spark.createDataFrame([(1, "Election elections Elections"), (2, "climate"), (3, None)], "doc_id long, text string"
                          ).write.parquet(f"{workdir}/documents.parquet")
    got = {r.token: (r.similar, r.closest) for r in q_similar_words(spark, workdir).collect()}
    words = ["Election", "elections", "Elections", "climate"]
    want = {a: [dice(a, b) for b in words if a != b and dice(a, b) >= 0.75] for a in words}
    assert got == {a: (len(x), max(x)) for a, x in want.items() if x} and got["Election"][1] < 0.95


def test_items_are_read_once(spark, workdir):
    from gacetilla.operators.summary import summarize
    rows = [(i, "c", "Crisis", f"l{i}", "War. Peace", "", None, None, None, "Climate policy. None.", None) for i in range(5)]
    _items(spark, rows).write.parquet(f"{workdir}/items")
    items = spark.read.parquet(f"{workdir}/items")
    for df in (score_breakdown(items, builtin_lexicon(spark)),
               summarize(items, builtin_lexicon(spark), "item_id", "clean_content")):
        # everything reads the tables of words; none of the plan's scans is the items' own
        assert f"{workdir}/items" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 5


def test_white_space_is_the_same_in_both_forms(spark):
    from gacetilla.functions.text import UNICODE_SPACES, WS_RUN
    every = spark.range(0x110000).where("id < 55296 or id > 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert every.where(F.col("c").rlike(UNICODE_SPACES) != F.col("c").rlike(WS_RUN)).count() == 0


def test_dice_properties():
    for a, b in [("Crisis", "crisis"), ("energía", "Energía"), ("ab", "ba"), ("night", "nacht")]:
        assert dice(a, b) == dice(b, a)
        assert 0.0 <= dice(a, b) <= 1.0
    assert dice("Economy", " Economy") == 1.0


def _items(spark, rows):
    schema = ("item_id long, channel string, title string, link string, description string, "
              "creators string, pub_date string, categories string, keywords string, "
              "clean_content string, error_kind string")
    df = spark.createDataFrame(rows, schema)
    return df.withColumn("error", F.when(F.col("error_kind").isNotNull(),
                                         F.struct(F.col("error_kind").alias("kind"),
                                                  F.lit(None).cast("string").alias("message")))
                         .otherwise(F.lit(None).cast(ERROR_TYPE))).drop("error_kind")


# Items and their score parts.
CASES = [
    # (creators, categories, keywords, title, description, content, error) -> expected
    (("", None, None, "", "", None, "EmptyString"), (True, 0, 0, 0, 0, 0)),
    (("John Doe", None, None, "", "", None, None), (False, 10, 0, 0, 0, 0)),
    (("", "Politics, Economy, Technology", None, "", "", None, None), (False, 0, 10, 0, 0, 0)),
    (("", None, "Inflation, Climate, Security", "", "", None, None), (False, 0, 0, 15, 0, 0)),
    (("", None, None, "Presidente Elections", "", None, None), (False, 0, 0, 0, 20, 0)),
    (("", None, None, "", "Crisis and Security", None, None), (False, 0, 0, 0, 0, 2)),
    (("John Doe", None, None, "", "Crisis and Security", None, None), (False, 10, 0, 0, 0, 2)),
]


def test_relevance_core(spark):
    rows = [(i, "c", t, f"l{i}", d, cr, None, cat, kw, cc, err)
            for i, ((cr, cat, kw, t, d, cc, err), _) in enumerate(CASES)]
    out = {r.item_id: r for r in score_breakdown(_items(spark, rows), builtin_lexicon(spark)).collect()}
    for i, (_, want) in enumerate(CASES):
        r = out[i]
        assert (r.error, r.by_creator, r.by_categories, r.by_keywords, r.by_title,
                r.by_description) == want


def test_content_score_and_texts(spark):
    rows = [(1, "c", "", "l", "", "", None, None, None, "Presidente Elections Crisis Modernización", None),
            (2, "c", "", "l2", "", "", None, None, None, None, None)]
    out = {r.item_id: r for r in score_breakdown(_items(spark, rows), builtin_lexicon(spark)).collect()}
    assert out[1].relevance_content == 3 and out[1].net_relevance == 3
    assert out[2].relevance_content == 0
    assert out[1].explanation == "breakdown [creator: 0, categories: 0, keywords: 0, title: 0, content: 0]"
    assert out[1].score_text.startswith("Relevance[core: 0, content: 3, explanation: 'breakdown [")


def test_occurrences_count_and_additivity(spark):
    rows = [(1, "c", "Crisis Crisis crisis", "l", "Crisis", "x", None, "crisis,Crisis", None, "Crisis", None)]
    r = score_breakdown(_items(spark, rows), builtin_lexicon(spark)).collect()[0]
    assert r.by_title == 30          # 'crisis' lower-case still reaches 0.8
    assert r.by_categories == 10
    assert r.relevance_core == r.by_creator + r.by_categories + r.by_keywords + r.by_title + r.by_description
    assert r.net_relevance == r.relevance_core + r.relevance_content


def test_user_file_lexicon(spark, workdir):
    import os
    p = os.path.join(workdir, "root_words.txt")
    with open(p, "w") as f:
        f.write("Zorro  gato\n\tperro Crisis\n")
    lex = combined_lexicon(spark, user_file=p)
    assert lex.count() == 63 + 3
    assert combined_lexicon(spark, user_file=os.path.join(workdir, "missing.txt")).count() == 63


def test_top_k_composite_errors_first(spark):
    from gacetilla.operators.rank import score_top_k, top_k_composite
    rows = [(i, "c", t, f"l{i}", d, cr, None, cat, kw, cc, err)
            for i, ((cr, cat, kw, t, d, cc, err), _) in enumerate(CASES)]
    items = _items(spark, rows)
    top = top_k_composite(items, builtin_lexicon(spark), 3).orderBy("rank").collect()
    # cores: 4 → 20, 3 → 15, 6 → 12, 1 and 2 → 10, 5 → 2; the errored item 0 first
    assert [r.item_id for r in top] == [0, 4, 3]
    last = top_k_composite(items, builtin_lexicon(spark), 2, errors_last=True).orderBy("rank").collect()
    assert [r.item_id for r in last] == [4, 3]
    best = score_top_k(items, builtin_lexicon(spark), 2).collect()
    assert sorted((r.item_id, r.relevance) for r in best) == [(3, 15), (4, 20)]
    assert top_k_composite(items, builtin_lexicon(spark), 300).count() == len(CASES)  # any k
