"""Relevance scores.

Per item:

* creator score 10 when ``creators`` is not empty;
* each comma piece of ``categories`` / ``keywords`` that matches the lexicon
  scores 5;
* each white-space word of ``title`` that matches scores 10, of
  ``description`` 1, of ``clean_content`` 1 (the content score);
* an item with an error scores 0 everywhere and is flagged.

Occurrences count (a word repeated three times scores three times).

Plan: one pass over the items writes the token table, a row per item with the
words of its fields and its flags; everything else reads that table.  Its
distinct words are matched with the lexicon, its occurrences semi-joined with
the matches (few are broadcast, and occurrences stay put), and summed per key,
in part before the shuffle.  Only words and scores are shuffled; titles,
descriptions and contents never are, and no text is cut into words twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import split_commas, split_whitespace
from ..session import materialize
from .similarity import DICE_THRESHOLD, filter_matching, matched_tokens

# Points per matching piece of each field, and per creator.
FIELD_WEIGHTS = {
    "categories": 5,
    "keywords": 5,
    "title": 10,
    "description": 1,
    "content": 1,
}
CREATOR_POINTS = 10

# Texts of a score (the last label reads "content" but shows
# the description score).
EXPLANATION_FORMAT = "breakdown [creator: %d, categories: %d, keywords: %d, title: %d, content: %d]"
SCORE_TEXT_FORMAT = "Relevance[core: %d, content: %d, explanation: '%s']"

SCORE_COLUMNS = ["error", "by_creator", "by_categories", "by_keywords", "by_title",
                 "by_description", "relevance_core", "relevance_content", "net_relevance"]


def _field_tokens(with_content: bool = True) -> list[tuple[str, object]]:
    fields = [
        ("categories", split_commas("categories")),
        ("keywords", split_commas("keywords")),
        ("title", split_whitespace("title")),
        ("description", split_whitespace("description")),
    ]
    if with_content:
        fields.append(("content", split_whitespace("clean_content")))
    return fields


def token_table(items: DataFrame, key: str = "item_id", with_content: bool = True,
                carry: list[str] | None = None) -> DataFrame:
    """A row per item, written once: key, the carried columns, ``error_flag``,
    ``creator_points`` and ``fields``, the words of each field of an error-free
    item."""
    fields = [F.struct(F.lit(name).alias("field"), toks.alias("toks"))
              for name, toks in _field_tokens(with_content)]
    rows = items.select(
        key, *(carry or []), F.col("error").isNotNull().alias("error_flag"),
        F.when(F.coalesce(F.col("creators"), F.lit("")) != "", F.lit(CREATOR_POINTS))
         .otherwise(F.lit(0)).cast("long").alias("creator_points"),
        F.when(F.col("error").isNull(), F.array(*fields)).alias("fields"))
    return materialize(rows, "tokens")


def token_occurrences(tokens: DataFrame, key: str = "item_id") -> DataFrame:
    """(key, field, token) for every scored piece of a token table."""
    return (tokens.select(key, F.inline("fields"))
                  .select(key, "field", F.explode("toks").alias("token")))


def vocabulary(tokens: DataFrame) -> DataFrame:
    """The words to match: each item's distinct pieces (de-duplicated inside
    the row, before anything is shuffled)."""
    pieces = F.flatten(F.transform("fields", lambda x: F.coalesce(x.toks, F.array().cast("array<string>"))))
    return tokens.select(F.explode(F.array_distinct(pieces)).alias("token"))


def field_hits(tokens: DataFrame, lexicon: DataFrame, key: str = "item_id",
               threshold: float = DICE_THRESHOLD, length_unit: str = "byte") -> DataFrame:
    """Per key: by_categories, by_keywords, by_title, by_description, by_content
    (only keys with at least one matching piece), from a token table."""
    matches = matched_tokens(vocabulary(tokens), lexicon, threshold=threshold, length_unit=length_unit)
    hits = filter_matching(token_occurrences(tokens, key), matches)
    aggs = [F.sum(F.when(F.col("field") == f, F.lit(w)).otherwise(F.lit(0))).cast("long").alias(f"by_{f}")
            for f, w in FIELD_WEIGHTS.items()]
    return hits.groupBy(key).agg(*aggs)


def _finish(base: DataFrame, hits: DataFrame, key: str) -> DataFrame:
    """Join per-key hits onto the narrow per-item base and add the totals."""
    joined = base.join(hits, key, "left")
    zero = F.lit(0).cast("long")
    err = F.col("error_flag")
    # When the item's own ``error`` is carried along, the flag is ``has_error``.
    flag = "has_error" if "error" in base.columns else "error"
    out = joined.select(
        *[c for c in base.columns if c not in ("error_flag", "creator_points")],
        err.alias(flag),
        *[F.when(err, zero).otherwise(F.coalesce(F.col(c), zero)).alias(c) for c in
          ["creator_points", "by_categories", "by_keywords", "by_title", "by_description", "by_content"]],
    ).withColumnRenamed("creator_points", "by_creator")
    core = (F.col("by_creator") + F.col("by_categories") + F.col("by_keywords")
            + F.col("by_title") + F.col("by_description"))
    return (out.withColumn("relevance_core", core)
               .withColumn("relevance_content", F.col("by_content"))
               .withColumn("net_relevance", F.col("relevance_core") + F.col("relevance_content"))
               .drop("by_content"))


def score_breakdown(items: DataFrame, lexicon: DataFrame, key: str = "item_id",
                    carry: list[str] | None = None, threshold: float = DICE_THRESHOLD,
                    length_unit: str = "byte", with_content: bool = True) -> DataFrame:
    """One row per item: key, carried columns, the §1.3 score columns,
    ``explanation`` and ``score_text``."""
    tokens = token_table(items, key, with_content, carry)
    hits = field_hits(tokens, lexicon, key, threshold, length_unit)
    out = _finish(tokens.drop("fields"), hits, key)
    return out.withColumn("explanation", explanation()).withColumn("score_text", score_text())


def explanation():
    """X10 (the last label is ``content`` but carries the description score)."""
    return F.format_string(EXPLANATION_FORMAT, "by_creator", "by_categories", "by_keywords",
                           "by_title", "by_description")


def score_text():
    """X11."""
    return F.format_string(SCORE_TEXT_FORMAT, "relevance_core", "relevance_content", "explanation")


def with_relevance(items: DataFrame, lexicon: DataFrame, key: str = "item_id",
                   threshold: float = DICE_THRESHOLD, length_unit: str = "byte") -> DataFrame:
    """A4: the items with ``relevance`` set to the net score (all columns kept)."""
    # The scores are narrow and written once, so Spark knows their bytes: while
    # they are small they are broadcast, and the wide item rows stay where they are.
    scores = score_breakdown(items, lexicon, key, threshold=threshold, length_unit=length_unit)
    scores = materialize(scores.select(F.col(key).alias("_key"), F.col("net_relevance").alias("_net")), "scores")
    kept = [F.col(c) for c in items.columns if c not in (key, "relevance")]
    return items.join(scores, F.col(key) == F.col("_key"), "left").select(key, *kept, F.col("_net").alias("relevance"))
