"""Feedback ratings.

The interactive prompt of the ranking is replaced by a ratings table
``(link, rating)``: a rating is kept when it reads as an integer from 1 to
5; anything else (0, 6, text, null) means "skipped" and the item is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import days_since
from .rank import take_first

# The accepted rating range.
MIN_RATING, MAX_RATING = 1, 5


def read_ratings(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Ratings as ``(link STRING, rating STRING)``."""
    if fmt == "csv":
        return spark.read.schema("link STRING, rating STRING").option("header", "true").csv(path)
    return spark.read.parquet(path).select(F.col("link").cast("string"), F.col("rating").cast("string"))


def valid_rating(c) -> Column:
    """The rating as BIGINT when it is an integer 1..5, else null."""
    r = F.col(c) if isinstance(c, str) else c
    text = F.trim(r.cast("string"))
    parsed = F.when(text.rlike(r"^[+]?[0-9]+$"), text.try_cast("long"))
    return F.when(parsed.between(MIN_RATING, MAX_RATING), parsed)


def apply_feedback(items: DataFrame, ratings: DataFrame, n: int | None = 20,
                   order: list[Column] | None = None, now: str | None = None) -> DataFrame:
    """C4 core: take the first ``n`` items (T5), join their ratings (J3),
    keep valid ones (P8) and set ``relevance`` to the rating.  With ``now``,
    ``days_since_publication`` (X16) is added."""
    order = order or [F.col("item_id")]
    first = take_first(items, n, order) if n is not None else items
    rated = (ratings.select("link", valid_rating("rating").alias("_rating"))
                    .where(F.col("_rating").isNotNull()))
    # a link rated more than once keeps its lowest valid rating
    one = rated.groupBy("link").agg(F.min("_rating").alias("_rating"))
    out = (first.drop("relevance").join(one, "link", "inner")
                .withColumnRenamed("_rating", "relevance"))
    if now is not None:
        out = out.withColumn("days_since_publication", days_since("pub_date", now))
    return out
