"""De-duplication by link (A6) and insert-if-absent.

"First one wins" is decided on narrow rows (link and order columns): a minimum
per link with map-side partial aggregation, so a link copied a million times
collapses inside each map task.  Links that are stored already leave before
that.  The wide rows are joined with the winners once, at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _winners(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, *order) of the first row per key."""
    if len(order) == 1:
        return rows.groupBy(key).agg(F.min(order[0]).alias(order[0]))
    return (rows.groupBy(key).agg(F.min(F.struct(*order)).alias("_first"))
            .select(key, *[F.col(f"_first.{c}").alias(c) for c in order]))


def first_per_key(df: DataFrame, key: str = "link", order: list[str] | None = None) -> DataFrame:
    """One row per ``key``, the one with the smallest ``order`` values.
    ``order`` ends in a column that is unique per row; null keys are left out."""
    order = order or ["item_id"]
    return df.join(_winners(df.select(key, *order), key, order), [key, *order], "left_semi")


def not_present(new: DataFrame, existing: DataFrame, key: str = "link") -> DataFrame:
    """Rows of ``new`` whose key is not in ``existing`` (left anti-join)."""
    return new.join(existing.select(key).distinct(), key, "left_anti")


def rows_to_insert(new: DataFrame, existing: DataFrame | None, key: str = "link",
                   order: list[str] | None = None) -> DataFrame:
    """A6 + J4: first row per key among the new ones, minus keys already stored."""
    if existing is None:
        return first_per_key(new, key, order)
    order = order or ["item_id"]
    left = not_present(new.select(key, *order), existing, key)
    return new.join(_winners(left, key, order), [key, *order], "left_semi")
