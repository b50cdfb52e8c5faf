"""Item normalisation (P1) and the required-field filter."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import join_categories, join_creators, join_keywords, normalise_pub_date
from ..schema import ERROR_TYPE

REQUIRED = ["title", "link", "description"]


def _given(name: str):
    """A required field with a text; an empty element counts as absent."""
    return F.col(name).isNotNull() & (F.col(name) != "")


def _required_ok():
    return _given("title") & _given("link") & _given("description")


def normalise(raw: DataFrame, key: str = "item_id", channel_col: str = "channel_title",
              extra: list[str] | None = None) -> DataFrame:
    """Project raw RSS items into the item schema, dropping items that lack a
    title, link or description.

    ``raw`` has ``channel_title`` plus the RSS item fields (``title``,
    ``link``, ``description``, ``pubDate``, ``category``, ``dc:creator``,
    ``media:keywords``) and a key column.  ``extra`` columns pass through.
    """
    return (raw.where(_required_ok())
               .select(
                   F.col(key).alias("item_id") if key != "item_id" else F.col("item_id"),
                   F.col(channel_col).alias("channel"),
                   "title", "link", "description",
                   join_creators(F.col("`dc:creator`")).alias("creators"),
                   normalise_pub_date("pubDate").alias("pub_date"),
                   join_categories("category").alias("categories"),
                   join_keywords(F.col("`media:keywords`")).alias("keywords"),
                   F.lit(None).cast("string").alias("clean_content"),
                   F.lit(None).cast(ERROR_TYPE).alias("error"),
                   F.lit(None).cast("long").alias("relevance"),
                   *(extra or []),
               ))


def rejected(raw: DataFrame, key: str = "item_id", channel_col: str = "channel_title") -> DataFrame:
    """Side output of P2: items that miss a required field, with the reason."""
    reason = (F.when(~_given("title"), F.lit("No title"))
               .when(~_given("link"), F.lit("No link"))
               .otherwise(F.lit("No description")))
    return raw.where(~_required_ok()).select(F.col(key).alias("item_id"),
                                             F.col(channel_col).alias("channel"),
                                             reason.alias("reason"))
