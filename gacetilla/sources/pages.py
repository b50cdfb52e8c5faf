"""A store of landed pages, laid out for lookups by url.

Pages are dealt into a fixed number of buckets by a hash of their url, one
folder each, and sorted by url inside.  ``fill_content`` joins such a store on
bucket and url: the wanted links say which buckets are read, by dynamic
partition pruning when they are few, and within a bucket the sorted files'
statistics skip row groups.  Pages land in batches (one folder level above the
buckets) that appear by one rename; a batch that has landed is not landed again.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import delete_path, existing_paths, make_folder, path_exists, rename_path
from ..sinks.table import bucket_of

PAGE_BUCKETS = 256


@dataclass
class PageStore:
    """Pages with their ``bucket``, and how many buckets there are."""
    pages: DataFrame
    buckets: int


def land_pages(pages: DataFrame, path: str, url_col: str = "url", buckets: int = PAGE_BUCKETS,
               batch: str | None = None) -> None:
    """Adds pages to the store.  The number of buckets is fixed by the first
    batch; columns ``bucket`` and ``batch`` of ``pages`` are not allowed."""
    if {"bucket", "batch"} & set(pages.columns):
        raise ValueError("bucket and batch are the store's own columns")
    spark = pages.sparkSession
    if not path_exists(spark, f"{path}/_buckets-*"):
        make_folder(spark, f"{path}/_buckets-{buckets}")
    name, = existing_paths(spark, f"{path}/_buckets-*")
    target = f"{path}/batch=id-{batch or uuid.uuid4().hex}"
    if path_exists(spark, target):
        return
    aside = f"{path}/_staging-{uuid.uuid4().hex}"
    try:
        (pages.withColumn("bucket", bucket_of(url_col, int(name.rsplit("-", 1)[-1])))
         .repartition("bucket").sortWithinPartitions("bucket", url_col).write.partitionBy("bucket").parquet(aside))
        rename_path(spark, aside, target)
    finally:
        delete_path(spark, aside)


def page_store(spark: SparkSession, path: str) -> PageStore:
    name, = existing_paths(spark, f"{path}/_buckets-*")
    return PageStore(spark.read.parquet(path).drop("batch"), int(name.rsplit("-", 1)[-1]))
