"""Large and skewed inputs take the same plan and give the same results."""

from pyspark.sql import functions as F

from gacetilla.operators.scoring import score_breakdown
from gacetilla.sources.lexicon import builtin_lexicon, combined_lexicon
from test_similarity_scoring import CASES, _items


def _rows():
    return [(i, "c", t, f"l{i}", d, cr, None, cat, kw, cc, err)
            for i, ((cr, cat, kw, t, d, cc, err), _) in enumerate(CASES)]


def test_results_without_broadcasts(spark):
    items = _items(spark, _rows())
    want = {r.item_id: tuple(r) for r in score_breakdown(items, builtin_lexicon(spark)).collect()}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = {r.item_id: tuple(r) for r in score_breakdown(items, builtin_lexicon(spark)).collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert got == want


def test_edited_word_file_is_seen_at_once(spark, workdir):
    path = f"{workdir}/words.txt"
    items = _items(spark, [(1, "c", "El zorro y el perro", "l", "d", "", None, None, None, None, None)])

    def title_score(words):
        with open(path, "w") as f:
            f.write(words)
        return score_breakdown(items, combined_lexicon(spark, user_file=path)).first().by_title

    assert title_score("zorro") == 10
    assert title_score("zorro\tperro") == 20
    assert score_breakdown(items, combined_lexicon(spark, user_file=f"{workdir}/missing.txt")).first().by_title == 0


def test_hot_token_counts_exactly(spark):
    # one word in every row: the distinct step collapses it map-side and the
    # per-item counts stay exact
    n = 3000
    df = (spark.range(n).select(
        F.col("id").alias("item_id"), F.lit("c").alias("channel"), F.lit("Crisis crisis").alias("title"),
        F.concat(F.lit("l"), F.col("id").cast("string")).alias("link"), F.lit("the Crisis").alias("description"),
        F.lit("").alias("creators"), F.lit(None).cast("string").alias("categories"),
        F.lit(None).cast("string").alias("keywords"), F.lit(None).cast("string").alias("clean_content"),
        F.lit(None).cast("struct<kind:string,message:string>").alias("error")))
    out = score_breakdown(df, builtin_lexicon(spark))
    agg = out.agg(F.sum("by_title").alias("t"), F.sum("by_description").alias("d"), F.count("*").alias("n")).first()
    assert (agg.t, agg.d, agg.n) == (20 * n, n, n)
