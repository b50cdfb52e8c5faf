"""Exact Jaccard self-join of word-shingle sets with several global orders.

Two documents link when 100 * |A and B| >= THRESHOLD * |A or B| over their sets
of SHINGLE-word shingles.  In any global order of the shingles, linked sets
share a shingle among their first ``n - ceil(t * n) + 1``.  Several orders are
used: each sorts shingles by a frequency class first (rare before frequent) and
by its own hash after that.  Candidates must share a prefix shingle in the
first order (the lists that are joined), pass the length and position bounds
there, and share enough of them in each further order; only pairs that meet all
filters are verified on the whole sets.

The frequency classes come from a sketch of fixed size over all documents.  They only shape the order, which is the same for all documents, so
the result does not depend on them.

1. ``shingle_sets``: a row per document with its set's name (a 64-bit hash of
   the whole set), size and first-order prefix, written once.  Equal sets have
   one name: copies are one node.
2. Prefix shingles met under two names at least are lists (aggregated map side;
   a bitmap of fixed size spares the shuffle of the others).
3. Stars: in every list the member with the fewest rare shingles is paired with
   the others.  Verified pairs give provisional components.
4. Rest: lists that still hold several components pair the members outside the
   leader's component with the members of other components.  Members of one
   component need no more links, so a family of near copies is not expanded
   into its pairs, and no link that could join two components is left out.
5. Components of all links; a document's component is its least ``doc_id``.

Joins on a list's shingle have AQE's skew handling on both sides; nothing is
collected but the fixed-size sketch and bitmaps.

Edge cases: null, empty and wordless texts have an empty set, size 0, and are
linked with nothing.  Texts of fewer words than a shingle have one shingle, the
whole sequence.  Rows that repeat a ``doc_id`` are rows of their own.  A null
``doc_id`` stays null and never names a component; a component of null ids
alone is null.  Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .tables import Bitmap, materialize
from .words import SPACED, Words, chunks, mix, window_hash

SHINGLE = 5
THRESHOLD = 80
ORDERS = 3
#: slots of the frequency sketch, and of a part of it
SKETCH_BITS = 22
PART_BITS = 16

_U = np.uint64
_FURTHER = [f"order{i}" for i in range(1, ORDERS)]
_SALT = [0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89]


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the shingles of a piece, with repetitions."""
    n = words.counts
    size = np.minimum(n, k)
    rows = np.where(n > 0, np.maximum(n - k, 0) + 1, 0)
    at = np.repeat(words.first[:-1] - (np.cumsum(rows) - rows), rows) + np.arange(int(rows.sum()))
    return window_hash(words.hash, at, np.repeat(size, rows)), np.repeat(np.arange(len(n)), rows)


def _ordered(hashes, text, classes, order: int):
    """Distinct shingles of each text in a global order: indices into ``hashes``."""
    slot = classes[(hashes & _U((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    key = (mix(hashes ^ _U(_SALT[order])) >> _U(8)) | (slot.astype(np.uint64) << _U(56))
    by = np.lexsort((key, text))
    key, text = key[by], text[by]
    new = np.ones(len(by), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
    return by[new], slot[by[new]]


def prefix_length(n: np.ndarray, threshold: int) -> np.ndarray:
    return np.where(n > 0, n - -(-threshold * n // 100) + 1, 0)


def _set_names(hashes, first) -> np.ndarray:
    """A name for each set, whatever the order of its members."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(hashes) + 1, dtype=np.uint64)
        np.cumsum(mix(hashes ^ _U(_SALT[3])), out=total[1:])
        return mix(total[first[1:]] - total[first[:-1]] + np.diff(first).astype(np.uint64)).view(np.int64)


def _sketch_rows(k: int):
    """Counts of a task's shingles by slot, packed: a row for each part of the slots."""
    def task(batches):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        low = _U((1 << SKETCH_BITS) - 1)
        for batch in batches:
            for piece in chunks(batch):
                h, text = shingles(Words(piece.column(0), SPACED, lower=True), k)
                # each shingle of a text once: its slot under a hash of both
                both = np.unique((mix(h ^ mix(text.astype(np.uint64) + _U(1))) & ~low) | (h & low))
                counts += np.bincount((both & low).astype(np.int64), minlength=len(counts))
        for part, some in enumerate(counts.reshape(-1, 1 << PART_BITS)):
            if some.any():
                small = some.astype(np.min_scalar_type(int(some.max())))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part]), pa.array([small.itemsize]), pa.array([zlib.compress(small.tobytes(), 1)])],
                    names=["part", "width", "counts"])
    return task


def _sum_rows(batches):
    """(slot, n) from all packed counts of the parts that a task has."""
    total: dict = {}
    for b in batches:
        for part, width, counts in zip(*(b.column(i).to_pylist() for i in range(3))):
            some = np.frombuffer(zlib.decompress(counts), dtype=f"u{width}")
            total[part] = some + total.get(part, np.zeros(1 << PART_BITS, dtype=np.int64))
    for part, n in total.items():
        n = n.astype(np.int64)
        slot = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(slot + (part << PART_BITS)), pa.array(n[slot])], names=["slot", "n"])


def frequency_classes(texts: DataFrame, k: int = SHINGLE) -> np.ndarray:
    """A class for each sketch slot: 0 for all but frequent shingles.  Every
    document counts."""
    packed = texts.select("text").mapInArrow(_sketch_rows(k), "part long, width long, counts binary")
    # at most one row per slot, read twice
    slots = materialize(packed.repartition("part").mapInArrow(_sum_rows, "slot long, n long"), "sketch")
    mean = (slots.agg(F.sum("n").alias("n")).first()["n"] or 0) / (1 << SKETCH_BITS)
    unit = int(2 * mean) + 2
    rows = slots.where(F.col("n") >= unit).toArrow()
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
    if len(rows):
        out[rows["slot"].to_numpy()] = np.floor(np.log2(rows["n"].to_numpy() / unit)).astype(np.uint8) + 1
    return out


def _prefixes(h, text, n_texts: int, classes, order: int, threshold: int):
    """Prefix shingles of each text in an order: (offsets, indices into ``h``, classes)."""
    idx, slot = _ordered(h, text, classes, order)
    first = np.searchsorted(text[idx], np.arange(n_texts + 1))
    p = prefix_length(np.diff(first), threshold)
    at = np.repeat(first[:-1] - (np.cumsum(p) - p), p) + np.arange(int(p.sum()))
    return np.concatenate([[0], np.cumsum(p)]), idx[at], slot[at]


def _set_rows(classes, k: int, threshold: int):
    def task(batches):
        cls = classes.value
        for batch in batches:
            for piece in chunks(batch):
                h, text = shingles(Words(piece.column(1), SPACED, lower=True), k)
                idx, _ = _ordered(h, text, cls, 0)
                h, text = h[idx], text[idx]
                first = np.searchsorted(text, np.arange(len(piece) + 1))
                n = np.diff(first)
                offs, at, slot = _prefixes(h, text, len(piece), cls, 0, threshold)
                rare = np.concatenate([[0], np.cumsum(slot == 0)])
                lists = [pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(h[at].view(np.int64)))]
                for order in range(1, ORDERS):
                    offs2, at, _ = _prefixes(h, text, len(piece), cls, order, threshold)
                    # a filter may take two shingles for one, so half the bits will do
                    lists.append(pa.ListArray.from_arrays(pa.array(offs2.astype(np.int32)),
                                                          pa.array((h[at] >> _U(32)).astype(np.uint32).view(np.int32))))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(_set_names(h, first), mask=n == 0), pa.array(n),
                     pa.array((rare[offs[1:]] - rare[offs[:-1]]).astype(np.int32)), *lists],
                    names=["doc_id", "name", "n", "rare", "prefix", *_FURTHER])
    return task


def shingle_sets(texts: DataFrame, classes, k: int, threshold: int) -> DataFrame:
    """(doc_id, name, n, rare, prefix, order1, ...) of every document; name is null for an empty set."""
    return texts.mapInArrow(_set_rows(classes, k, threshold),
                            "doc_id long, name long, n long, rare int, prefix array<long>, "
                            + ", ".join(f"{c} array<int>" for c in _FURTHER))


def _list_rows(shared: Bitmap):
    def task(batches):
        for b in batches:
            prefix = b.column(3)
            size = pa.compute.list_value_length(prefix).to_numpy()
            token = prefix.flatten().to_numpy()
            row = np.repeat(np.arange(len(b)), size)
            pos = np.arange(len(token)) - np.repeat(np.cumsum(size) - size, size)
            some = shared.may_hold(token)
            row = pa.array(row[some])
            yield pa.RecordBatch.from_arrays(
                [pa.array(token[some]), b.column(0).take(row), pa.array(pos[some].astype(np.int32)),
                 b.column(1).take(row), b.column(2).take(row)], names=["token", "name", "pos", "n", "rare"])
    return task


def _named_rows(wanted: Bitmap):
    def task(batches):
        for b in batches:
            yield b.filter(pa.array(wanted.may_hold(b.column(0).to_numpy())))
    return task


def _member_rows(wanted: Bitmap, k: int):
    """The whole set of wanted documents (by key)."""
    def task(batches):
        none = np.zeros(1 << SKETCH_BITS, dtype=np.uint8)
        for batch in batches:
            batch = batch.filter(pa.array(wanted.may_hold(batch.column(2).to_numpy())))
            for piece in chunks(batch):
                h, text = shingles(Words(piece.column(1), SPACED, lower=True), k)
                idx, _ = _ordered(h, text, none, 0)
                h, text = h[idx], text[idx]
                first = np.searchsorted(text, np.arange(len(piece) + 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_set_names(h, first)), pa.array(np.diff(first)),
                     pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(h.view(np.int64)))],
                    names=["name", "n", "members"])
    return task


def _both(pairs: DataFrame, sides: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``sides`` (name, ...) of either."""
    for s in "ab":
        pairs = pairs.join(sides.select(F.col("name").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in sides.columns[1:]]), s)
    return pairs


def _names(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("name")).unionByName(pairs.select(F.col("b").alias("name"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, k: int, threshold: int) -> DataFrame:
    """Pairs (a, b) of names whose sets are similar: first the prefixes of the
    further orders must share enough, then the sets are compared.

    All that two sets share before the first of their prefixes ends is in both
    prefixes, so they share at most that and what follows it in that set.
    """
    pairs = materialize(pairs, "candidates")
    further = (sets.where("name is not null").select("name", "n", *_FURTHER)
               .mapInArrow(_named_rows(Bitmap(_names(pairs), "name")),
                           "name long, n long, " + ", ".join(f"{c} array<int>" for c in _FURTHER))
               .dropDuplicates(["name"]))
    met = _both(pairs, further)
    t, n = threshold, "(n_a + n_b)"
    after = f"(({t} * greatest(n_a, n_b) + 99) div 100 - 1)"
    for c in _FURTHER:
        # one more than is met, because half the bits may take two shingles for one
        met = met.where(F.arrays_overlap(f"{c}_a", f"{c}_b")).where(
            f"{100 + t} * (size(array_intersect({c}_a, {c}_b)) + 1 + {after}) >= {t} * {n}")
    met = materialize(met.select("a", "b"), "filtered")
    # one document per name carries the set
    holders = (sets.select("name", "doc_id").join(_names(met), "name", "left_semi")
               .groupBy("name").agg(F.min(F.xxhash64("doc_id")).alias("key")))
    members = (texts.select("doc_id", "text", F.xxhash64("doc_id").alias("key"))
               .mapInArrow(_member_rows(Bitmap(holders, "key"), k), "name long, n long, members array<long>")
               .dropDuplicates(["name"]))
    common = F.size(F.array_intersect("members_a", "members_b"))
    return materialize(
        _both(met, members).where((100 + threshold) * common >= threshold * (F.col("n_a") + F.col("n_b")))
        .select("a", "b"), "links")


def _may_link(a: str, b: str, threshold: int):
    """Length bound, and the position bound at the first shared shingle."""
    t, s = threshold, 100 + threshold
    n = f"({a}.n + {b}.n)"
    return F.expr(f"100 * least({a}.n, {b}.n) >= {t} * greatest({a}.n, {b}.n) and "
                  f"{s} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {t} * {n}")


def _pairs(met: DataFrame) -> DataFrame:
    return met.select(F.least("x.name", "y.name").alias("a"), F.greatest("x.name", "y.name").alias("b")).distinct()


def links(sets: DataFrame, texts: DataFrame, classes, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """Verified links (a, b) between names of sets that hold every component together."""
    named = sets.where("name is not null").select("name", "n", "rare", "prefix")
    shared = materialize(
        named.select("name", F.explode("prefix").alias("token")).groupBy("token")
        .agg(F.min("name").alias("lo"), F.max("name").alias("hi")).where("lo < hi").select("token"), "shared-shingles")
    lists = materialize(
        named.mapInArrow(_list_rows(Bitmap(shared, "token")), "token long, name long, pos int, n long, rare int")
        .join(shared, "token").distinct(), "lists")
    lead = lists.groupBy("token").agg(F.min(F.struct("rare", "name", "n", "pos")).alias("lead")) \
        .select("token", "lead.name", "lead.n", "lead.pos")
    stars = _pairs(lead.alias("x").join(lists.alias("y"), F.col("x.token") == F.col("y.token"))
                   .where("x.name <> y.name").where(_may_link("x", "y", threshold)))
    first = _verified(stars, sets, texts, k, threshold)

    label = components(first)
    labelled = lists.join(label.withColumnRenamed("node", "name"), "name", "left") \
        .withColumn("label", F.coalesce("label", "name"))
    mixed = labelled.groupBy("token").agg(F.min("label").alias("lo"), F.max("label").alias("hi"),
                                          F.min(F.struct("rare", "name", "label")).alias("lead")) \
        .where("lo < hi").select("token", F.col("lead.label").alias("lead"))
    rest = materialize(labelled.join(mixed, "token"), "mixed-lists")
    others = _pairs(rest.where("label <> lead").alias("x").join(rest.alias("y"), F.col("x.token") == F.col("y.token"))
                    .where("x.label <> y.label and (y.label = y.lead or x.name < y.name)")
                    .where(_may_link("x", "y", threshold)))
    return first.unionByName(_verified(others, sets, texts, k, threshold))


def near_copies(docs: DataFrame, k: int = SHINGLE, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    classes = docs.sparkSession.sparkContext.broadcast(frequency_classes(texts, k))
    sets = materialize(shingle_sets(texts, classes, k, threshold), "shingle-sets")
    label = components(links(sets, texts, classes, k, threshold))
    named = (sets.select("doc_id", F.col("n").alias("n_shingles"), "name")
             .join(label.withColumnRenamed("node", "name"), "name", "left")
             .withColumn("label", F.coalesce("label", "name")))
    least = materialize(named.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("component_id")),
                        "component-ids")
    return named.join(least, "label", "left").select(
        "doc_id", "n_shingles", F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"))
