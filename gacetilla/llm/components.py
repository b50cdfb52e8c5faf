"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize


def _state(edges: DataFrame):
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b") % 1_000_003).alias("h"),
                    F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return tuple(row)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Every node hands its neighbours (larger ones, or itself and smaller ones)
    to the least of them."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    met = both.join(least, "a")
    if large:
        out = met.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label) for the nodes of ``links`` (a, b): label is the least node
    that can be reached.  Each round is written to the shared folder, so lineage
    stays short and a lost executor costs one round at most."""
    edges = materialize(links.select("a", "b").where("a <> b").distinct(), "edges")
    before = _state(edges)
    while before[0]:
        edges = materialize(_star(_star(edges, large=True), large=False), "edges")
        now = _state(edges)
        if now == before:
            break
        before = now
    # stars: every node points to its component's least node
    return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(
        edges.select(F.col("b").alias("node"), F.col("b").alias("label"))).distinct()
