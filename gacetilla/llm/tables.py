"""Reading inputs, cutting lineage and fixed-size bitmaps for the operators."""

from __future__ import annotations

import pickle

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir, materialize  # noqa: F401  (shared folder, re-read as Parquet)

#: bits of a key bitmap; its size never follows the data
BITMAP_BITS = 26


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


class Shared:
    """A broadcast of an object of this package by value: plain bytes travel, and
    a task makes the object anew, with its class, so executors need not have
    the package."""

    def __init__(self, spark: SparkSession, value):
        self.data = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    def __getstate__(self):
        return {"data": self.data}

    @property
    def value(self):
        if not hasattr(self, "made"):
            self.made = pickle.loads(self.data.value)
        return self.made


class Bitmap:
    """Fixed-size set of 64-bit keys without false negatives.

    2**bits bits (8 MB at 26), whatever the number of keys: it only spares
    shuffles of rows that a later exact join would drop, so a full bitmap
    costs time, never rows.
    """

    def __init__(self, keys: DataFrame, column: str, bits: int = BITMAP_BITS):
        self.mask = (1 << bits) - 1
        at = F.col(column).bitwiseAND(F.lit(self.mask))
        words = (keys.select(F.shiftright(at, 6).alias("w"),
                             F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
                 .groupBy("w").agg(F.bit_or("b").alias("b")).toArrow())
        flags = np.zeros(1 << (bits - 6), dtype=np.int64)
        flags[words["w"].to_numpy()] = words["b"].to_numpy()
        self.data = keys.sparkSession.sparkContext.broadcast(flags.view(np.uint64))

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) & np.uint64(self.mask)
        return (self.data.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def sha256_column(col):
    return F.sha2(F.encode(col, "UTF-8"), 256)
