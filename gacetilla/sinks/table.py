"""The stored item table (K1, K2) and its scan.

The table is a folder of Parquet files keyed by ``link`` (unique), laid out as
``batch=<id>/bucket=<n>/``: rows are dealt into a fixed number of buckets by a
hash of their link and sorted by it inside, and every insert is a batch.  An
insert looks its links up in their own buckets only (partition filters on
``bucket``, and only the ``link`` column of those files); a batch is written
once, beside the table, and becomes visible by one rename of its folder.  A
batch whose id is stored already is not inserted again, so a retried insert
changes nothing and reports the same count.

``error`` is stored as its long text form (``Kind(message)``) so messages
survive the round trip.  Links stay unique for one writer at a time; writers
at the same moment are not coordinated.  The rename is one step on file
systems that have such a step.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.items import error_text, parse_error
from ..operators.dedup import rows_to_insert
from ..schema import STORED_DDL
from ..session import delete_path, existing_paths, make_folder, path_exists, rename_path

STORED_COLUMNS = ["id", "channel", "title", "link", "description", "creators", "pub_date",
                  "categories", "keywords", "clean_content", "error"]
BUCKETS = 64


def bucket_of(key, buckets: int):
    """Bucket of a link or url."""
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def create_table(spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
    """K1: create the empty table if it does not exist (idempotent).  The
    number of buckets is fixed here, by the name of a hidden folder."""
    if not path_exists(spark, f"{path}/_buckets-*"):
        make_folder(spark, f"{path}/_buckets-{buckets}")


def bucket_count(spark: SparkSession, path: str) -> int:
    name, = existing_paths(spark, f"{path}/_buckets-*")
    return int(name.rsplit("-", 1)[-1])


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The table as stored, with ``batch`` and ``bucket``."""
    return spark.read.schema(f"{STORED_DDL}, batch string, bucket int").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The stored items in the item schema, ``relevance`` null."""
    return stored(spark, path).select(
        F.col("id").alias("item_id"), "channel", "title", "link", "description",
        F.coalesce(F.col("creators"), F.lit("")).alias("creators"), "pub_date", "categories",
        "keywords", "clean_content", parse_error(F.col("error")).alias("error"),
        F.lit(None).cast("long").alias("relevance"))


def stored_links(spark: SparkSession, path: str, links: DataFrame) -> DataFrame:
    """(link, bucket) of what is stored in the buckets of ``links``.  The list
    of buckets, at most their fixed number, goes through the driver."""
    buckets = bucket_count(spark, path)
    wanted = [r[0] for r in links.select(bucket_of("link", buckets)).distinct().collect()]
    return stored(spark, path).where(F.col("bucket").isin(wanted) if len(wanted) < buckets else F.lit(True)
                                     ).select("link", "bucket")


def _stored_rows(items: DataFrame) -> DataFrame:
    # ``id``: a stable 64-bit id derived from the unique link
    return items.select(
        F.xxhash64("link").alias("id"), "channel", "title", "link", "description", "creators",
        "pub_date", "categories", "keywords", "clean_content",
        F.coalesce(error_text(F.col("error")), F.lit("None")).alias("error"))


def _batch_name(batch: str) -> str:
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", batch):
        raise ValueError("a batch id has letters, digits, '_', '.' and '-' only")
    return f"id-{batch}"  # never read as a number


def batch_size(spark: SparkSession, path: str, batch: str) -> int | None:
    """Rows of a batch, None when it is not stored."""
    folder = f"{path}/batch={_batch_name(batch)}"
    if not path_exists(spark, folder):
        return None
    return spark.read.schema("link string, bucket int").parquet(folder).count()


def insert_items(spark: SparkSession, items: DataFrame, path: str, order: list[str] | None = None,
                 batch: str | None = None) -> int:
    """K2: append the items whose link is not stored yet; returns the count
    really inserted.  ``batch`` names the insert: with an id that is stored
    already nothing is read or written and the count is that batch's own."""
    batch = batch or uuid.uuid4().hex
    create_table(spark, path)
    done = batch_size(spark, path, batch)
    if done is not None:
        return done
    new = rows_to_insert(items, stored_links(spark, path, items.select("link")), "link", order or ["item_id"])
    aside = f"{path}/_staging-{uuid.uuid4().hex}"
    try:
        rows = _stored_rows(new).withColumn("bucket", bucket_of("link", bucket_count(spark, path)))
        (rows.repartition("bucket").sortWithinPartitions("bucket", "link")
         .write.partitionBy("bucket").parquet(aside))
        rename_path(spark, aside, f"{path}/batch={_batch_name(batch)}")
    finally:
        delete_path(spark, aside)
    return batch_size(spark, path, batch)
