"""Nearest neighbours by vantage-point trees, one tree per shard of vectors.

Every task packs the vectors it reads into shards of at most SHARD_BYTES and
builds a tree over each: a vantage point is chosen among a few candidates (the
one whose distances spread most), the rows are halved at the median distance,
and each half keeps the least and largest distance to that point.  A query's
distance to the vantage point and the triangle inequality give a lower bound
for the whole half; a leaf's bound is the largest on its path.  A leaf is
skipped when ``factor * bound`` exceeds the query's present k-th distance: with
factor one nothing nearer can be lost, so the search is exact; a larger factor
skips more leaves and may miss neighbours.

Queries are packed into blocks of at most BLOCK_BYTES.  Every pair of a block
and a few shards is a cell of a grid, brought together by an equi-join on the
cell's number and searched in one task; a cell's size is bounded, whatever the
data.  Each cell gives the k best of each query, and a window over narrow rows
the k best of all.  No vector passes the driver.  Shards follow the rows as
stored, not their values, so a vector shared by many rows fills no shard more
than others.

Distances are Euclidean, in double precision, from differences of the original
components; the faster product form only picks candidates, with a margin for
its rounding.  Ties go to the smaller id.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part; vectors are compared with those of their own length;
rows with a null id are candidates and come last among ties, but no queries;
repeated rows are candidates of each other (a row's own copy is told by row,
not by id) and each of them is a query; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize

SHARD_BYTES = 16 << 20
BLOCK_BYTES = 16 << 20
LEAF = 256
#: queries searched at once inside a cell
AT_ONCE = 2048
#: shards of a cell, on average
SHARDS_A_CELL = 2
NO_ID = np.iinfo(np.int64).max


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each row of ``a`` to the same row of ``b``."""
    return np.sqrt(np.square(a - b).sum(axis=-1))


class Tree:
    """Rows in leaf order, and for each inner node its vantage point and the
    range of distances of both halves."""

    def __init__(self, vectors: np.ndarray, leaf: int = LEAF, seed: int = 7):
        self.vectors, self.leaf = vectors, leaf
        self.random = np.random.default_rng(seed)
        self.points: list[np.ndarray] = []
        #: per leaf: rows, and its path as (node, least, largest distance)
        self.leaves: list[tuple[np.ndarray, list[tuple[int, float, float]]]] = []
        todo = [(np.arange(len(vectors)), [])]
        while todo:
            rows, path = todo.pop()
            if len(rows) <= leaf:
                self.leaves.append((rows, path))
                continue
            away, point = self._vantage(rows)
            node = len(self.points)
            self.points.append(point)
            order = np.argsort(away, kind="stable")
            rows, away, half = rows[order], away[order], len(rows) // 2
            todo.append((rows[half:], [*path, (node, away[half], away[-1])]))
            todo.append((rows[:half], [*path, (node, away[0], away[half - 1])]))

    def _vantage(self, rows):
        best = None
        for at in self.random.choice(rows, min(4, len(rows)), replace=False):
            point = self.vectors[at].astype(np.float64)
            some = rows if len(rows) <= 1024 else self.random.choice(rows, 1024, replace=False)
            spread = distances(self.vectors[some].astype(np.float64), point).std()
            if best is None or spread > best[0]:
                best = spread, point
        return distances(self.vectors[rows].astype(np.float64), best[1]), best[1]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance of each query to each leaf, less the rounding of the distances."""
        out = np.zeros((len(queries), len(self.leaves)))
        away = [distances(queries, p) for p in self.points]
        for i, (_, path) in enumerate(self.leaves):
            for node, least, most in path:
                np.maximum(out[:, i], np.maximum(least - away[node], away[node] - most), out=out[:, i])
        return np.maximum(out - 1e-9 * (1 + out), 0)


class Found:
    """The k best of each query so far, ordered by distance, then id."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.away = np.full((n, k), np.inf)
        self.ids = np.full((n, k), NO_ID)
        self.rows = np.full((n, k), -1, dtype=np.int64)

    def add(self, query, away, ids, rows) -> None:
        """Offers candidates, one element for each (query, row)."""
        some = np.unique(query)
        k = self.k
        query = np.concatenate([np.repeat(some, k), query])
        away = np.concatenate([self.away[some].ravel(), away])
        ids = np.concatenate([self.ids[some].ravel(), ids])
        rows = np.concatenate([self.rows[some].ravel(), rows])
        order = np.lexsort((rows, ids, away, query))
        query, away, ids, rows = query[order], away[order], ids[order], rows[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        keep = place < k  # every query has its k old ones, so k stay
        self.away[some] = away[keep].reshape(-1, k)
        self.ids[some] = ids[keep].reshape(-1, k)
        self.rows[some] = rows[keep].reshape(-1, k)


def search(tree: Tree, ids, rows, queries, own, found: Found, factor: float = 1.0) -> int:
    """Offers ``found`` the neighbours of ``queries`` (row numbers ``own``) in
    the tree; ``ids`` and ``rows`` name the tree's vectors.  Gives the number
    of (query, leaf) pairs looked at."""
    bounds = tree.bounds(queries)
    norm = np.square(queries).sum(axis=1)
    nearest = bounds.argmin(axis=1)
    looked = 0
    for first in (True, False):
        for i, (members, _) in enumerate(tree.leaves):
            if first:
                some = np.flatnonzero(nearest == i)
            else:
                some = np.flatnonzero((nearest != i) & (factor * bounds[:, i] <= found.away[:, -1]))
            if not len(some):
                continue
            looked += len(some)
            v = tree.vectors[members].astype(np.float64)
            size = np.square(v).sum(axis=1)
            near = norm[some][:, None] + size[None, :] - 2 * (queries[some] @ v.T)
            margin = 1e-12 * (norm[some][:, None] + size[None, :]) * v.shape[1]
            near[own[some][:, None] == rows[members][None, :]] = np.inf
            limit = np.square(found.away[some, -1])
            if len(members) > found.k:
                limit = np.minimum(limit, np.partition(near + margin, found.k - 1, axis=1)[:, found.k - 1])
            q, m = np.nonzero((near - margin <= limit[:, None]) & (near < np.inf))
            if len(q):
                at = members[m]
                found.add(some[q], distances(queries[some[q]], v[m]), ids[at], rows[at])
    return looked


def _packed(limit: int):
    """Rows (row, id, vector) to packs of at most ``limit`` bytes of vectors of one length."""
    def task(batches):
        from pyspark import TaskContext

        held: dict = {}
        made = 0

        def pack(dim):
            nonlocal made
            rows, ids, parts, _ = held.pop(dim)
            made += 1
            number = (TaskContext.get().partitionId() << 32) + made
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((number, pa.int64()), (dim, pa.int32()),
                                               (np.concatenate(rows).tobytes(), pa.binary()),
                                               (np.concatenate(ids).tobytes(), pa.binary()),
                                               (np.concatenate(parts).tobytes(), pa.binary()))],
                names=["pack", "dim", "rows", "ids", "vectors"])

        for batch in batches:
            column = batch.column(2)
            offs = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False)
            size = np.diff(offs)
            row = batch.column(0).to_numpy()
            ids = batch.column(1).fill_null(NO_ID).to_numpy()
            for dim in np.unique(size).tolist():
                at = np.flatnonzero(size == dim)
                most = max(limit // (dim * flat.itemsize), 1)
                while len(at):
                    have = held.setdefault(dim, ([], [], [], [0]))
                    some, at = at[:most - have[3][0]], at[most - have[3][0]:]
                    have[0].append(row[some])
                    have[1].append(ids[some])
                    have[2].append(flat[(offs[some][:, None] + np.arange(dim)).ravel()])
                    have[3][0] += len(some)
                    if have[3][0] >= most:
                        yield pack(dim)
        for dim in list(held):
            yield pack(dim)
    return task


_PACK = "pack long, dim int, rows binary, ids binary, vectors binary"


def _unpack(table: pa.Table, kind):
    for dim, rows, ids, vectors in zip(*(table.column(c).to_pylist() for c in ("dim", "rows", "ids", "vectors"))):
        yield (dim, np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64),
               np.frombuffer(vectors, kind).reshape(-1, dim))


def _cell(k: int, factor: float, kind: str):
    def task(shards: pa.Table, blocks: pa.Table) -> pa.Table:
        trees = [(dim, rows, ids, Tree(v)) for dim, rows, ids, v in _unpack(shards, kind)]
        out: list[list] = [[], [], [], []]
        for dim, own, query, vectors in _unpack(blocks, kind):
            for at in range(0, len(own), AT_ONCE):
                some = slice(at, at + AT_ONCE)
                found = Found(len(own[some]), k)
                for size, rows, ids, tree in trees:
                    if size == dim:
                        search(tree, ids, rows, vectors[some].astype(np.float64), own[some], found, factor)
                q, j = np.nonzero(found.rows >= 0)
                for column, x in zip(out, (own[some][q], query[some][q], found.ids[q, j], found.away[q, j])):
                    column.append(x)
        parts = [np.concatenate(x) if x else np.zeros(0) for x in out]
        ids = parts[2].astype(np.int64)
        return pa.table({"row": parts[0].astype(np.int64), "query_id": parts[1].astype(np.int64),
                         "vec_id": pa.array(ids, mask=ids == NO_ID), "score": parts[3].astype(np.float64)})
    return task


def points(table: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(row, id, vector) of the rows that take part, written once so that row
    numbers stay."""
    kind = table.schema[vector_column].dataType.simpleString()
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    v = F.col(vector_column).cast(kind)
    good = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = table.where(good & F.exists(v, lambda x: x != 0)).select(
        F.monotonically_increasing_id().alias("row"), F.col(id_column).cast("long").alias("id"), v.alias("vector"))
    return materialize(rows, "points")


def neighbours(rows: DataFrame, is_query, k: int = 10, factor: float = 1.0) -> DataFrame:
    """(row, query_id, rank, vec_id, score): the k nearest rows of each of
    ``rows`` (from ``points``) for which the condition ``is_query`` holds."""
    kind = "float32" if rows.schema["vector"].dataType.simpleString() == "array<float>" else "float64"
    shards = materialize(rows.mapInArrow(_packed(SHARD_BYTES), _PACK), "shards")
    queries = rows.where(is_query)
    size = queries.agg(F.sum(F.size("vector").cast("long"))).first()[0] or 0
    blocks = materialize(queries.repartition(max(math.ceil(size * np.dtype(kind).itemsize / BLOCK_BYTES), 1))
                         .mapInArrow(_packed(BLOCK_BYTES), _PACK), "query-blocks")
    # the numbers of packs, not their contents
    across = max(math.ceil(shards.count() / SHARDS_A_CELL), 1)
    down = max(blocks.count(), 1)
    cells = F.sequence(F.lit(0), F.lit(down - 1))
    left = shards.withColumn("across", F.pmod(F.xxhash64("pack"), F.lit(across))).withColumn("down", F.explode(cells))
    cells = F.sequence(F.lit(0).cast("long"), F.lit(across - 1).cast("long"))
    right = (blocks.withColumn("across", F.explode(cells))
             .withColumn("down", F.pmod(F.xxhash64("pack"), F.lit(down)).cast("int")))
    best = left.groupBy("across", "down").cogroup(right.groupBy("across", "down")).applyInArrow(
        _cell(k, factor, kind), "row long, query_id long, vec_id long, score double")
    order = Window.partitionBy("row").orderBy(F.col("score"), F.col("vec_id").asc_nulls_last())
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
