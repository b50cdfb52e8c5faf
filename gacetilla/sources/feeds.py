"""Feed-list scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import WS_CLASS

# Fixed value: a line is a feed when this URL pattern is found anywhere in
# it.  ``(?s)`` lets ``.`` take any character of the line, as in the
# ranking's pattern engine; ``\s`` is spelled out as Unicode white space.
URL_PATTERN = f"(?s)(http|https)://[^{WS_CLASS}/$.?#].[^{WS_CLASS}]*"


def is_feed_line(c) -> Column:
    """Non-empty, not a ``#`` comment, and holding a URL (the whole line is kept)."""
    line = F.col(c) if isinstance(c, str) else c
    return (line != "") & ~line.startswith("#") & line.rlike(URL_PATTERN)


def read_feed_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the feed-list files under ``path`` that name a feed, untrimmed,
    with their line number (``line_no``, 0-based, counted through the files in
    name order)."""
    # an id holds the split (from bit 33) and the row in it; splits are taken by
    # file and offset, not by size, to number them in file order
    meta = F.col("_metadata")
    lines = spark.read.text(path).select(
        F.monotonically_increasing_id().alias("_id"), meta.getField("file_path").alias("_file"),
        meta.getField("file_block_start").alias("_start"), "value")
    # lines of one block, then blocks in order: one row per block in the window
    blocks = (lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
              .withColumn("_before", F.coalesce(F.sum("_n").over(
                  Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    return (lines.where(is_feed_line("value")).join(blocks, ["_file", "_start"])
            .select((F.col("_before") + F.col("_id") - F.col("_first")).cast("long").alias("line_no"),
                    F.col("value").alias("url")))
