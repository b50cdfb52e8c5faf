"""Feedback CSV sink."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import text_or_empty
from ..functions.items import error_debug
from ..schema import CSV_HEADER


def csv_rows(items: DataFrame, feedback_date: str) -> DataFrame:
    """The 12 CSV columns as text: missing texts as '', the error as its
    debug text (``None`` / ``Some(NoContent)``), one feedback date for the
    whole write, relevance as digits or ''."""
    values = [
        text_or_empty("channel"), text_or_empty("title"), text_or_empty("link"),
        text_or_empty("description"), text_or_empty("creators"), text_or_empty("pub_date"),
        text_or_empty("categories"), text_or_empty("keywords"), text_or_empty("clean_content"),
        error_debug("error"), F.lit(feedback_date),
        F.coalesce(F.col("relevance").cast("string"), F.lit("")),
    ]
    return items.select(*[v.alias(h) for v, h in zip(values, CSV_HEADER)])


def write_csv(items: DataFrame, path: str, feedback_date: str, mode: str = "overwrite") -> None:
    """K3: header row, every field quoted when needed (``"`` doubled)."""
    (csv_rows(items, feedback_date).write.mode(mode)
        .option("header", "true").option("quote", '"').option("escape", '"')
        .option("quoteAll", "false").option("emptyValue", "")
        .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false")
        .csv(path))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = ", ".join(f"`{h}` STRING" for h in CSV_HEADER)
    return (spark.read.schema(schema).option("header", "true").option("multiLine", "true")
                 .option("quote", '"').option("escape", '"')
                 .option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path))
