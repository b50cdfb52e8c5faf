"""Ordering, top-k and numbering.

Every order ends in a deterministic tie-break (``link``, then the key), so
results repeat run after run.  Top-k is ``orderBy(...).limit(k)``, which
Spark plans as TakeOrderedAndProject: each task keeps its own k best and
only k rows per task reach the final merge — no global sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..session import materialize
from .scoring import score_breakdown
from .similarity import DICE_THRESHOLD

def relevance_order(key: str = "item_id") -> list[Column]:
    """Relevance descending (null last), then link, then key."""
    return [F.col("relevance").desc_nulls_last(), F.col("link").asc_nulls_last(), F.col(key).asc()]


def composite_order(key: str = "item_id", errors_last: bool = False) -> list[Column]:
    """T2 order: (error, core, content) descending.  As in the ranking it
    mirrors, errored items come *first* unless ``errors_last``."""
    err = F.col("error").asc() if errors_last else F.col("error").desc()
    return [err, F.col("relevance_core").desc(), F.col("relevance_content").desc(),
            F.col("link").asc_nulls_last(), F.col(key).asc()]


def _join_back(items: DataFrame, top: DataFrame, key: str) -> DataFrame:
    """Full rows of the selected keys.  ``top`` ends in a limit, so Spark knows
    its size and broadcasts it as long as it is small."""
    return items.join(top, key, "inner")


def score_top_k(items: DataFrame, lexicon: DataFrame, k: int, key: str = "item_id",
                threshold: float = DICE_THRESHOLD, length_unit: str = "byte") -> DataFrame:
    """Score every item, keep the k best by net relevance, full rows with
    ``relevance`` set.  Scores are ranked on a narrow table; only the k
    winners are joined back to the wide rows."""
    scores = score_breakdown(items, lexicon, key, carry=["link"], threshold=threshold,
                             length_unit=length_unit)
    top = (scores.select(key, "link", F.col("net_relevance").alias("relevance"))
                 .orderBy(*relevance_order(key)).limit(k)
                 .select(key, "relevance"))
    return _join_back(items.drop("relevance"), top, key)


def top_k_composite(items: DataFrame, lexicon: DataFrame, k: int, key: str = "item_id",
                    errors_last: bool = False, threshold: float = DICE_THRESHOLD,
                    length_unit: str = "byte") -> DataFrame:
    """K best by (error, core, content), items returned without the score
    (``rank`` 1..k gives their order)."""
    scores = score_breakdown(items, lexicon, key, carry=["link"], threshold=threshold,
                             length_unit=length_unit)
    order = composite_order(key, errors_last)
    top = (scores.orderBy(*order).limit(k)
                 .withColumn("rank", F.row_number().over(Window.orderBy(*order)))
                 .select(key, "rank"))
    return _join_back(items, top, key)


def number_small(df: DataFrame, order: list[Column], name: str = "ord", start: int = 1) -> DataFrame:
    """1-based numbering of a small (top-k) result.  The window has no
    partition key, which is only acceptable because the input is bounded."""
    return df.withColumn(name, (F.row_number().over(Window.orderBy(*order)) - 1 + start).cast("long"))


def number_all(df: DataFrame, sort_cols: list[str], descending: list[bool],
               name: str = "ord", start: int = 0, ranges: int | None = None) -> DataFrame:
    """Global numbering of an unbounded result without a single-partition
    window.

    One exchange: ``repartitionByRange`` splits the order into ranges, each is
    sorted where it is, and a row's place in it is the low part of
    ``monotonically_increasing_id``.  The ranges are written once, because the
    counts that give every range its offset must see the same rows; there is
    one offset per range, so that table is as small as the number of ranges.
    Give it narrow rows (sort columns, key and what a line needs); the sort
    columns should end in a unique key, so ties never pile up in one range.
    """
    order = [F.col(c).desc_nulls_last() if d else F.col(c).asc_nulls_last()
             for c, d in zip(sort_cols, descending)]
    ranges = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = materialize(
        df.repartitionByRange(ranges, *order).sortWithinPartitions(*order)
        .withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part, row = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = local.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(
        Window.unboundedPreceding, -1)), F.lit(0)).alias("_offset"))
    out = local.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.withColumn(name, (F.col("_offset") + row + start).cast("long")).drop("_part", "_at", "_offset")


def random_order(df: DataFrame, seed: int = 42) -> DataFrame:
    """Seeded shuffle, only meaningful before a limit."""
    return df.orderBy(F.rand(seed))


def take_first(df: DataFrame, n: int, order: list[Column]) -> DataFrame:
    """T5: first n items in a deterministic order."""
    return df.orderBy(*order).limit(n)
