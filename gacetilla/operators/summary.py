"""Extractive summary of item texts.

The ranking hands texts to a remote summariser capped at 150 tokens; here
the summary is extractive and computed on Spark:

1. sentences = maximal runs of characters other than ``. ! ?`` and newline,
   with their closing punctuation, trimmed, empties dropped (position kept);
2. each sentence scores the number of its words that match the lexicon
   (the same fuzzy match as the relevance score);
3. per document, sentences ranked by (score desc, position asc) are taken
   while the running word count stays within the budget (the best sentence
   is always taken);
4. the kept sentences are joined by one space in text order.

One pass over the texts writes the sentences with their words; everything else
reads that table.  Only numbers are shuffled for the choice (the position, word
count and hits of each sentence); the sentences are joined with the kept
positions once, as a stream past a row per document.  The number of tasks grows
with the sentences, so that a task's memory does not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import split_whitespace
from ..session import materialize
from .similarity import DICE_THRESHOLD, filter_matching, matched_tokens

SENTENCE_PATTERN = r"[^.!?\n]+[.!?]*"
TOKEN_BUDGET = 150
#: sentences that one task ranks
TASK_SENTENCES = 250_000


def _sentences(text_col: str):
    """The sentences of a text as an array."""
    found = F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE_PATTERN), 0)
    return F.transform(found, lambda x: F.trim(x))


def sentences(docs: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, pos, sentence, tokens), written once — pos is 1-based."""
    s = (docs.select(key, F.posexplode(_sentences(text_col)).alias("pos0", "sentence"))
             .where(F.col("sentence") != "")
             .select(key, (F.col("pos0") + 1).alias("pos"), "sentence", split_whitespace("sentence").alias("tokens")))
    return materialize(s, "sentences")


def _partitions(sent: DataFrame) -> int:
    """Tasks for a shuffle of the written sentences: their number comes from the files' footers."""
    least = int(sent.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, -(-sent.count() // TASK_SENTENCES))


def summarize(docs: DataFrame, lexicon: DataFrame, key: str = "doc_id", text_col: str = "text",
              budget: int = TOKEN_BUDGET, threshold: float = DICE_THRESHOLD,
              length_unit: str = "byte") -> DataFrame:
    """(key, summary, n_sentences, n_tokens) per document with text; ``key`` is
    unique per document."""
    sent = sentences(docs, key, text_col)
    words = sent.select(F.explode(F.array_distinct("tokens")).alias("token"))
    matches = matched_tokens(words, lexicon, threshold=threshold, length_unit=length_unit)
    hits = (filter_matching(sent.select(key, "pos", F.explode("tokens").alias("token")), matches)
            .groupBy(key, "pos").agg(F.count(F.lit(1)).cast("long").alias("hits")))
    # as many tasks as the sentences need: what one of them sorts does not grow with the input
    parts = _partitions(sent)
    scored = (sent.select(key, "pos", F.size("tokens").cast("long").alias("n_tokens")).repartition(parts, key, "pos")
                  .join(hits.repartition(parts, key, "pos"), [key, "pos"], "left")
                  .withColumn("hits", F.coalesce("hits", F.lit(0).cast("long"))))
    w = Window.partitionBy(key).orderBy(F.col("hits").desc(), F.col("pos").asc())
    ranked = (scored.repartition(parts, key)
                    .withColumn("rank", F.row_number().over(w))
                    .withColumn("running", F.sum("n_tokens").over(
                        w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    # at most ``budget`` sentences a document, as each has a word: a row per document, small
    # enough for a hash table, so the sentences stream past it and their texts are not sorted
    kept = (ranked.where((F.col("rank") == 1) | (F.col("running") <= budget))
                  .groupBy(key).agg(F.collect_list(F.struct("pos", "n_tokens")).alias("_at"))
                  .select(key, "_at", F.col("_at.pos").alias("_places")))
    return (sent.select(key, "pos", "sentence").repartition(parts, key).join(kept.hint("shuffle_hash"), key)
            .where(F.array_contains("_places", F.col("pos")))
            .select(key, "pos", "sentence", F.explode(F.filter("_at", lambda x: x.pos == F.col("pos"))["n_tokens"]).alias("n_tokens"))
            .groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "sentence"))).alias("_kept"),
                              F.count(F.lit(1)).cast("long").alias("n_sentences"),
                              F.sum("n_tokens").cast("long").alias("n_tokens"))
            .select(key, F.array_join("_kept.sentence", " ").alias("summary"), "n_sentences", "n_tokens"))
