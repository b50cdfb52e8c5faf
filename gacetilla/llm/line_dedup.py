r"""Line de-duplication by a sharded minimal perfect hash.

Distinct line keys (two 64-bit hashes each) are cut into shards of about
SHARD_LINES.  Each shard is a minimal perfect hash in levels of bits: a key
sits at the first level where it alone hits its bit, and the rank of that bit
is its slot in three compact arrays (fingerprint, count of documents, owning
document).  The index holds every distinct line, so a probe always meets its
own slot; the fingerprint is the check.

Documents probe the arrays instead of joining lines: probes carry hashes, a
document and a line number, go to the shard's task and stream past its arrays,
which come first in sort order.  A shard with many occurrences (a line in a
third of all documents) is sent to several salted tasks, so no task sees more
than about PROBES_PER_TASK probes of one shard, and none holds a group.  Lines
are counted map side first.

A line's key is the line without ``[\x20\x09-\x0D]`` at both ends, A-Z
lower-cased.  Keys of at least MIN_CHARS code points that are found in two
documents lose all their lines but those in the smallest ``doc_id`` with it.

Edge cases: null and empty texts are one empty line, which stays.  Rows that
repeat a ``doc_id`` are one document: they share what they own.  Rows with a
null ``doc_id`` neither lose lines nor take any.  A line repeated inside one
document is no repetition.  An empty table gives an empty result; extra
columns are passed through by ``drop_lines`` (but for n_lines and n_dropped,
which are its own).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize
from .words import Lines, chunks, mix

MIN_CHARS = 10
SHARD_LINES = 200_000
PROBES_PER_TASK = 500_000

_U = np.uint64


class PerfectHash:
    """Minimal perfect hash of distinct (h1, h2) pairs, with rank by level."""

    GAMMA = 2.0

    @staticmethod
    def _place(h1, h2, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix(h1 + h2 * _U(2 * level + 1)) % _U(size)).astype(np.int64)

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for bits in levels:
            rank = np.cumsum(bits, dtype=np.int64)
            self.before.append(rank - 1 + total)
            total += int(rank[-1]) if len(rank) else 0

    @classmethod
    def build(cls, h1: np.ndarray, h2: np.ndarray) -> "PerfectHash":
        levels, left = [], np.arange(len(h1))
        while len(left):
            size = max(int(len(left) * cls.GAMMA), 64)
            at = cls._place(h1[left], h2[left], len(levels), size)
            hits = np.bincount(at, minlength=size)
            levels.append(hits == 1)
            left = left[hits[at] > 1]
        return cls(levels)

    def slot(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Slot of each key; some slot or -1 for a key that was not built in."""
        out = np.full(len(h1), -1, dtype=np.int64)
        left = np.arange(len(h1))
        for k, bits in enumerate(self.levels):
            at = self._place(h1[left], h2[left], k, len(bits))
            here = bits[at]
            out[left[here]] = self.before[k][at[here]]
            left = left[~here]
        return out


def pack(h1, h2, owner, count) -> bytes:
    """A shard's hash and arrays as bytes."""
    ph = PerfectHash.build(h1, h2)
    slot = ph.slot(h1, h2)
    n = len(h1)
    prints, counts, owners = np.empty(n, np.uint32), np.empty(n, np.uint32), np.empty(n, np.int64)
    prints[slot] = (h2 >> _U(32)).astype(np.uint32)
    counts[slot] = np.minimum(count, 0xFFFFFFFF)
    owners[slot] = owner
    sizes = np.array([n, len(ph.levels), *[len(b) for b in ph.levels]], dtype=np.int64)
    return b"".join([sizes.tobytes(), *[np.packbits(b).tobytes() for b in ph.levels],
                     prints.tobytes(), counts.tobytes(), owners.tobytes()])


def unpack(blob: bytes):
    n, depth = np.frombuffer(blob, np.int64, 2).tolist()
    sizes = np.frombuffer(blob, np.int64, depth, 16).tolist()
    at, levels = 16 + 8 * depth, []
    for size in sizes:
        packed = np.frombuffer(blob, np.uint8, (size + 7) // 8, at)
        levels.append(np.unpackbits(packed, count=size).astype(bool))
        at += len(packed)
    prints = np.frombuffer(blob, np.uint32, n, at)
    counts = np.frombuffer(blob, np.uint32, n, at + 4 * n)
    owners = np.frombuffer(blob, np.int64, n, at + 8 * n)
    return PerfectHash(levels), prints, counts, owners


def _line_rows(min_chars: int):
    def task(batches):
        for batch in batches:
            for piece in chunks(batch):
                lines = Lines(piece.column(1))
                some = np.flatnonzero(lines.length >= min_chars)
                h1, h2 = lines.hashes(some)
                of = np.searchsorted(lines.first, some, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), piece.column(0).take(pa.array(of)),
                     piece.column(2).take(pa.array(of)), pa.array((some - lines.first[of]).astype(np.int32))],
                    names=["h1", "h2", "doc_id", "text_key", "line"])
    return task


def _build(batches):
    """Rows sorted by shard -> one packed index per shard."""
    held: list = []
    shard = None

    def out():
        cols = [np.concatenate(x) for x in zip(*held)]
        blob = pack(cols[0].view(np.uint64), cols[1].view(np.uint64), cols[2], cols[3])
        return pa.RecordBatch.from_arrays(
            [pa.array([shard], pa.int64()), pa.array([int(cols[3].sum())], pa.int64()), pa.array([blob], pa.binary())],
            names=["shard", "occurrences", "index"])

    for b in batches:
        shards = b.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(shards)) + 1
        for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(shards))):
            if lo == hi:
                continue
            if held and shards[lo] != shard:
                yield out()
                held = []
            shard = int(shards[lo])
            held.append([b.column(k).to_numpy()[lo:hi] for k in range(1, 5)])
    if held:
        yield out()


def _probe(batches):
    """Rows sorted by (shard, salt, index first) -> lines to drop."""
    index = None
    for b in batches:
        blobs = b.column(2)
        heads = np.flatnonzero(blobs.is_valid().to_numpy(zero_copy_only=False))
        edges = np.concatenate([[0], heads, [len(b)]])
        h1, h2, doc = (np.nan_to_num(b.column(k).fill_null(0).to_numpy()) for k in (3, 4, 5))
        for lo, hi in zip(edges[:-1], edges[1:]):
            if lo == hi:
                continue
            if blobs[lo].is_valid:
                index = unpack(blobs[lo].as_py())
                lo += 1
            if lo == hi or index is None:
                continue
            ph, prints, counts, owners = index
            a, c = h1[lo:hi].view(np.uint64), h2[lo:hi].view(np.uint64)
            slot = ph.slot(a, c)
            drop = ((slot >= 0) & (prints[slot] == (c >> _U(32)).astype(np.uint32))
                    & (counts[slot] > 1) & (owners[slot] < doc[lo:hi]))
            some = pa.array(np.flatnonzero(drop) + lo)
            yield pa.RecordBatch.from_arrays([b.column(k).take(some) for k in (5, 6, 7)],
                                             names=["doc_id", "text_key", "line"])


def line_index(occurrences: DataFrame, shard_lines: int = SHARD_LINES) -> tuple[DataFrame, int]:
    """(shard, occurrences, index) of all distinct lines, and the number of shards."""
    lines = materialize(
        occurrences.groupBy("h1", "h2").agg(
            F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .select("h1", "h2", "owner", F.when(F.col("owner") < F.col("last"), F.col("n")).otherwise(1).alias("n")),
        "distinct-lines")
    shards = max(1, -(-lines.count() // shard_lines))
    index = (lines.select(F.pmod("h1", F.lit(shards)).cast("long").alias("shard"), "h1", "h2", "owner", "n")
             .repartition("shard").sortWithinPartitions("shard")
             .mapInArrow(_build, "shard long, occurrences long, index binary"))
    return materialize(index, "line-index"), shards


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, shard_lines: int = SHARD_LINES,
                  probes_per_task: int = PROBES_PER_TASK) -> DataFrame:
    """(doc_id, text_key, lines): numbers of the lines each document loses."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                        F.xxhash64("text").alias("text_key")).where("doc_id is not null and text is not null")
    # written once: read by the index and by the probes
    found = materialize(texts.mapInArrow(_line_rows(min_chars),
                                         "h1 long, h2 long, doc_id long, text_key long, line int"), "line-hashes")
    index, shards = line_index(found, shard_lines)
    salts = F.ceil(F.col("occurrences") / probes_per_task).cast("int")
    hot = index.select("shard", salts.alias("salts")).where("salts > 1")
    probes = (found.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("long")).join(hot, "shard", "left")
              .select("shard", F.pmod(F.xxhash64("doc_id"), F.coalesce("salts", F.lit(1))).cast("int").alias("salt"),
                      F.lit(None).cast("binary").alias("index"), "h1", "h2", "doc_id", "text_key", "line"))
    arrays = (index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.greatest(salts, F.lit(1)) - 1)))
              .select("shard", "salt", "index", *[F.lit(None).cast(t).alias(c) for c, t in (
                  ("h1", "long"), ("h2", "long"), ("doc_id", "long"), ("text_key", "long"), ("line", "int"))]))
    return (arrays.unionByName(probes).repartition("shard", "salt")
            .sortWithinPartitions("shard", "salt", F.col("index").isNull())
            .mapInArrow(_probe, "doc_id long, text_key long, line int")
            .groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("lines")))


def drop_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with the kept lines as ``text``, plus n_lines and n_dropped (long)."""
    found = dropped_lines(docs, **options).select(
        F.col("doc_id").alias("__ld_doc"), F.col("text_key").alias("__ld_key"), F.col("lines").alias("__ld_lines"))
    lines = F.split(F.coalesce(F.col("text").cast("string"), F.lit("")), "\n")
    kept = F.array_join(F.filter(lines, lambda x, i: ~F.array_contains("__ld_lines", i)), "\n")
    out = docs.join(found, (F.col("doc_id").cast("long") == F.col("__ld_doc"))
                    & (F.xxhash64(F.col("text").cast("string")) == F.col("__ld_key")), "left")
    return out.select(
        *[F.when(F.col("__ld_lines").isNull(), F.coalesce(F.col("text").cast("string"), F.lit(""))).otherwise(kept)
          .alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.size(lines).cast("long").alias("n_lines"),
        F.when(F.col("__ld_lines").isNull(), 0).otherwise(F.size("__ld_lines")).cast("long").alias("n_dropped"))
