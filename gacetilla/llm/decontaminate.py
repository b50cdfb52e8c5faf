r"""Benchmark decontamination with an FM-index per shard of training text.

A task packs whole documents into shards of about SHARD_WORDS words.  A word's
symbol is one byte of its 64-bit hash, so a shard is a byte string with a
wavelet matrix of eight levels.  Every window of a benchmark item (WINDOW
words, or the whole item if it has fewer) is searched backward through the
wavelet ranks, its occurrences are located by sampled suffix positions and
verified on the 64-bit word hashes.  Removal spans are merged per document.

The benchmark is the query set.  It is cut into blocks of about BLOCK_WORDS
words by the hash of the item id; one block (8 bytes a word and window) is
broadcast per pass over the documents, so a broadcast has a fixed bound and
larger benchmarks mean more passes, merged by document.

Words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.

Edge cases: null and empty documents have no words.  Items without words or
without an id are ignored; rows that repeat an item id add their windows to
it.  A phrase that several items share counts for each.  Repeated document
rows are judged one by one, a null ``doc_id`` is kept; an empty benchmark
leaves every document clean; an empty documents table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fm_index import FMIndex
from .tables import Shared
from .words import ALNUM, Words, chunks, window_hash

WINDOW = 10
SHARD_WORDS = 500_000
BLOCK_WORDS = 1_000_000

_U = np.uint64


def _symbols(names: np.ndarray) -> np.ndarray:
    """One byte (1 to 255) of each word."""
    return (names % _U(255)).astype(np.uint8) + np.uint8(1)


def _item_rows(batches):
    for batch in batches:
        for piece in chunks(batch):
            words = Words(piece.column(1), ALNUM, lower=True)
            offs = pa.array(words.first.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.ListArray.from_arrays(offs, pa.array(words.hash.view(np.int64)))],
                names=["item_id", "words"])


class Phrases:
    """Distinct windows of a block of items, grouped by length."""

    def __init__(self, items: list[tuple[str, np.ndarray]], window: int):
        number: dict[str, int] = {}
        by_length: dict[int, list] = {}
        for item_id, words in items:
            k = number.setdefault(item_id, len(number))
            n = min(window, len(words))
            if n:
                rows = np.lib.stride_tricks.sliding_window_view(words, n)
                by_length.setdefault(n, []).append((rows, np.full(len(rows), k)))
        self.item_ids = list(number)
        #: (names of the words, first owner of each phrase, owners)
        self.groups = []
        for _, parts in sorted(by_length.items()):
            rows = np.concatenate([r for r, _ in parts])
            owner = np.concatenate([o for _, o in parts])
            uniq, which = np.unique(rows, axis=0, return_inverse=True)
            which = which.reshape(-1)
            pair = np.unique(np.stack([which, owner], axis=1), axis=0)
            start = np.searchsorted(pair[:, 0], np.arange(len(uniq) + 1))
            self.groups.append((uniq, start, pair[:, 1]))


def _expand(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def search_shard(names: np.ndarray, text_ends: np.ndarray, phrases: Phrases):
    """Verified (position, length, item) of all phrase occurrences.

    ``names``: word hashes with a 0 after each text; ``text_ends``: where the 0s are.
    """
    s = _symbols(names)
    s[text_ends] = 0
    index = FMIndex(s)
    found = []
    for uniq, start, owners in phrases.groups:
        n = uniq.shape[1]
        lo, hi = index.count(_symbols(uniq.ravel()).reshape(uniq.shape))
        size = hi - lo
        which = np.repeat(np.arange(len(uniq)), size)
        at = index.locate(_expand(lo, size))
        same = np.ones(len(at), dtype=bool)
        for j in range(n):
            k = np.flatnonzero(same)
            same[k] = names[at[k] + j] == uniq[which[k], j]
        at, which = at[same], which[same]
        each = start[which + 1] - start[which]
        found.append((np.repeat(at, each), np.full(int(each.sum()), n), owners[_expand(start[which], each)]))
    if not found:
        z = np.zeros(0, dtype=np.int64)
        return z, z, z
    return tuple(np.concatenate(x) for x in zip(*found))


_FOUND = "doc_id long, text_key long, n_words long, ranges array<struct<at:int,n:int>>, items array<string>"


def _shard_spans(counts: np.ndarray, hashes: np.ndarray, phrases: Phrases):
    """Merged hit spans (text, first word, words) and (text, item) pairs of a
    shard of texts with ``counts`` words each."""
    names = np.zeros(int(counts.sum()) + len(counts), dtype=np.uint64)
    ends = np.cumsum(counts + 1) - 1  # one separator after every text
    word = np.ones(len(names), dtype=bool)
    word[ends] = False
    names[word] = hashes
    at, n, item = search_shard(names, ends, phrases)
    edge = np.zeros(len(names) + 1, dtype=np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    hit = np.cumsum(edge[:-1]) > 0
    turn = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    lo, hi = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    of = np.searchsorted(ends, lo)
    pairs = np.stack([np.searchsorted(ends, at), item], axis=1).reshape(-1, 2)
    return (of, lo - (ends - counts)[of], hi - lo), np.unique(pairs, axis=0)


def _shards(batches, text: int, shard_words: int):
    """Whole texts in groups of about ``shard_words`` words: (pieces, words of each piece)."""
    held, size = [], 0
    for batch in batches:
        for piece in chunks(batch, batch.schema.names[text]):
            words = Words(piece.column(text), ALNUM, lower=True)
            held.append((piece, words))
            size += len(words.hash)
            if size >= shard_words:
                yield held
                held, size = [], 0
    if held:
        yield held


def _search(block, window: int, shard_words: int):
    def task(batches):
        phrases = block.value
        for held in _shards(batches, 1, shard_words):
            counts = np.concatenate([w.counts for _, w in held])
            (of, at, n), pairs = _shard_spans(counts, np.concatenate([w.hash for _, w in held]), phrases)
            texts = np.arange(len(counts) + 1)
            spans = pa.StructArray.from_arrays([pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32))],
                                               names=["at", "n"])
            ids = pa.array([phrases.item_ids[k] for k in pairs[:, 1].tolist()], pa.string())
            key = [window_hash(w.hash, w.first[:-1], w.counts).view(np.int64) for _, w in held]
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([p.column(0) for p, _ in held]), pa.array(np.concatenate(key)), pa.array(counts),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(of, texts).astype(np.int32)), spans),
                 pa.ListArray.from_arrays(pa.array(np.searchsorted(pairs[:, 0], texts).astype(np.int32)), ids)],
                names=["doc_id", "text_key", "n_words", "ranges", "items"])
    return task


def _clean(block, text: int, shard_words: int):
    def task(batches):
        phrases = block.value
        for held in _shards(batches, text, shard_words):
            counts = np.concatenate([w.counts for _, w in held])
            (of, _, _), _ = _shard_spans(counts, np.concatenate([w.hash for _, w in held]), phrases)
            clean = np.ones(len(counts), dtype=bool)
            clean[of] = False
            at = 0
            for piece, _ in held:
                yield piece.filter(pa.array(clean[at:at + len(piece)]))
                at += len(piece)
    return task


def _merged(parts: list[DataFrame]) -> DataFrame:
    """Rows of several passes over the same documents as one row each."""
    if len(parts) == 1:
        return parts[0]
    rows = reduce(DataFrame.unionByName, parts)
    return (rows.groupBy("doc_id", "text_key", "n_words")
            .agg(F.array_distinct(F.flatten(F.collect_list("ranges"))).alias("ranges"),
                 F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
                 (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"))
            .withColumn("copies", F.explode(F.sequence(F.lit(1), "copies"))).drop("copies"))


def _digest(batches):
    for b in batches:
        cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
        hits, items, shas = [], [], []
        for spans, ids in zip(cols["ranges"].to_pylist(), cols["items"].to_pylist()):
            total = end = 0
            for s in sorted((x["at"], x["n"]) for x in spans):
                total += max(0, s[0] + s[1] - max(end, s[0]))
                end = max(end, s[0] + s[1])
            hits.append(total)
            items.append(len(ids))
            shas.append(hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [cols["doc_id"], cols["text_key"], cols["n_words"], pa.array(hits, pa.int64()),
             pa.array(items, pa.int64()), pa.array(shas, pa.string()), cols["ranges"], cols["items"]],
            names=["doc_id", "text_key", "n_words", "n_hit", "n_items", "items_sha256", "ranges", "items"])


def _blocks(benchmark: DataFrame, window: int, block_words: int):
    """Broadcast phrases of the benchmark, about ``block_words`` item words each."""
    items = (benchmark.select(F.col("item_id").cast("string").alias("item_id"),
                              F.col("text").cast("string").alias("text")).where("item_id is not null")
             .mapInArrow(_item_rows, "item_id string, words array<long>").where("size(words) > 0"))
    total = items.agg(F.sum(F.size("words")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // block_words))
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).toArrow()
        words = [np.array(w, dtype=np.int64).view(np.uint64) for w in rows["words"].to_pylist()]
        yield Shared(benchmark.sparkSession, Phrases(list(zip(rows["item_id"].to_pylist(), words)), window))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                      shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, in whose text no window occurs."""
    out = docs
    for block in _blocks(benchmark, window, block_words):
        out = out.mapInArrow(_clean(block, docs.columns.index("text"), shard_words), docs.schema)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                  shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """A row per document: doc_id, text_key (of the word sequence), n_words,
    n_hit, n_items, items_sha256, ranges (merged hit spans in words), items."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [texts.mapInArrow(_search(block, window, shard_words), _FOUND)
             for block in _blocks(benchmark, window, block_words)]
    return _merged(parts).mapInArrow(
        _digest, "doc_id long, text_key long, n_words long, n_hit long, n_items long, items_sha256 string, "
                 "ranges array<struct<at:int,n:int>>, items array<string>")
