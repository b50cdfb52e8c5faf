"""Substring de-duplication by recompression.

``recompress`` names, round by round, maximal runs of a symbol and then pairs
``left right`` of symbols, where a hash bit of the round puts every symbol on
the left or on the right side (so pairs never overlap).  A name is a 64-bit
hash of the kind, the round and the parts: all tasks give equal parts the same
name without an exchange, so the naming is global.

Equal substrings get equal names inside; only their margins depend on what
stands around them.  For every window of W words the interior is followed
through the rounds as a function of the window's words alone: the first and
last run are dropped in a run round, a right symbol at the start and a left
symbol at the end in a pair round.  The window's anchor is the interior symbol
of least hash at the last round (or at the last round with an interior left).
Equal windows therefore have equal anchors, and neighbouring windows mostly
share one, so a document has an anchor for every dozen words or so.

Spark then

1. aggregates anchors by symbol and by the stretch of words that an anchor's
   windows cover (map side first), giving each stretch its least document:
   symbols met in two documents at least reveal the candidates;
2. reads the anchors again; those of a stretch that a smaller document has are
   covered whole;
3. where a symbol has several stretches (at the borders of a repeat), verifies
   the stretches' owners window by window: the least document by (symbol,
   window hash), again aggregated map side;
4. collects the covered ranges of a document and cuts the words.

Steps 2 and 3 join with the aggregated side unique and stored, so a passage in
a third of all documents is a skewed join that Spark splits, never one task's
group.  Bitmaps of fixed size keep anchors of unshared stretches from being
shuffled again.

Edge cases: null and empty texts have no words and keep the empty string.
Texts under W words have no window.  Repeated rows with one ``doc_id`` are one
document and never lose words to each other.  Rows with a null ``doc_id``
neither lose words nor take any.  Extra columns are ignored.  An empty table
gives an empty result.  Hash names are compared as (symbol, window) pairs of
64 + 64 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Bitmap, materialize
from .words import SPACED, Words, chunks, mix, window_hash

WINDOW = 50
#: rounds before the anchor is taken; rounds that also name runs
ROUNDS = 6
RUN_ROUNDS = (1, 4)

_U = np.uint64
_KINDS = {"side": 1, "run": 2, "pair": 3, "anchor": 4, "choice": 5}


def _named(x: np.ndarray, kind: str, at: int) -> np.ndarray:
    salt = ((at * 8 + _KINDS[kind]) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    with np.errstate(over="ignore"):
        return mix(x + _U(salt))


def recompress(x: np.ndarray, text: np.ndarray, step: str, at: int):
    """One naming step.  ``x``: symbols, ``text``: the text of each.

    Returns the new symbols, their texts, and for every old symbol the index
    of the new one; for pairs also which old symbols are left ones.
    """
    n = len(x)
    joined = np.zeros(n, dtype=bool)
    left = None
    with np.errstate(over="ignore"):
        if step == "run":
            joined[1:] = (x[1:] == x[:-1]) & (text[1:] == text[:-1])
            heads = np.flatnonzero(~joined)
            length = np.diff(np.append(heads, n))
            y = x[heads]
            run = length > 1
            y[run] = _named(y[run] * _U(5) + length[run].astype(np.uint64), "run", at)
        else:
            left = _named(x, "side", at) >> _U(63) == 0
            joined[1:] = left[:-1] & ~left[1:] & (text[1:] == text[:-1])
            heads = np.flatnonzero(~joined)
            y = x[heads]
            pair = np.append(joined[1:], False)[heads]
            first = heads[pair]
            y[pair] = _named(x[first] * _U(0xD1342543DE82EF95) + x[first + 1], "pair", at)
    return y, text[heads], np.cumsum(~joined) - 1, left


def anchors(names: np.ndarray, first: np.ndarray, window: int = WINDOW,
            rounds: int = ROUNDS, run_rounds=RUN_ROUNDS):
    """(first word, anchor name) of every window of the texts ``names[first[i]:first[i + 1]]``."""
    counts = np.diff(first)
    n_win = np.maximum(counts - window + 1, 0)
    n_win[counts < window] = 0
    total = int(n_win.sum())
    starts = np.repeat(first[:-1], n_win) + np.arange(total) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    out = np.zeros(total, dtype=np.uint64)
    if not total:
        return starts, out
    win, lo, hi = np.arange(total), starts.copy(), starts + window - 1
    x, text = names.copy(), np.repeat(np.arange(len(counts)), counts)

    def settle(which, lo, hi, x, at):
        rank, best = _named(x, "choice", 0), np.full(len(which), np.iinfo(np.uint64).max, dtype=np.uint64)
        symbol = x[lo]
        for j in range(int((hi - lo).max()) + 1 if len(which) else 0):
            m = np.flatnonzero(hi - lo >= j)
            r = rank[lo[m] + j]
            less = r < best[m]
            best[m[less]] = r[less]
            symbol[m[less]] = x[lo[m[less]] + j]
        out[which] = _named(symbol, "anchor", at)

    level = 0
    for r in range(1, rounds + 1):
        for step in (("run", "pair") if r in run_rounds else ("pair",)):
            y, text, to, left = recompress(x, text, step, r)
            if step == "run":
                lo2, hi2 = to[lo] + 1, to[hi] - 1
            else:
                lo2, hi2 = to[lo] + ~left[lo], to[hi] - left[hi]
            gone = lo2 > hi2
            settle(win[gone], lo[gone], hi[gone], x, level)
            win, lo, hi, x = win[~gone], lo2[~gone], hi2[~gone], y
            level += 1
            if not len(win):
                return starts, out
    settle(win, lo, hi, x, level)
    return starts, out


_ANCHORS = pa.schema([("symbol", pa.int64()), ("stretch", pa.int64()), ("doc", pa.int64()),
                      ("text_key", pa.int64()), ("at", pa.int32()), ("n", pa.int32()),
                      ("again", pa.bool_()), ("windows", pa.list_(pa.int64()))])
_ANCHORS_SQL = ("symbol long, stretch long, doc long, text_key long, at int, n int, again boolean, "
                "windows array<long>")


def _text_keys(words: Words) -> np.ndarray:
    """A 64-bit key of each text's word sequence."""
    return window_hash(words.hash, words.first[:-1], words.counts).view(np.int64)


def _pair_key(symbol: np.ndarray, stretch: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(symbol.view(np.uint64) * _U(0x9FB21C651E98DF25) + stretch.view(np.uint64))


def _owner_key(pair: np.ndarray, doc: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(pair * _U(0xC2B2AE3D27D4EB4F) + doc.view(np.uint64))


def _anchor_rows(window: int, again: Bitmap | None = None, owners: Bitmap | None = None):
    """Anchors of every text; with bitmaps only those whose stretch may be met
    in two documents (``again``), and those that may own a stretch of a symbol
    with several stretches (these carry their window hashes)."""
    def task(batches):
        for batch in batches:
            for piece in chunks(batch):
                words = Words(piece.column(1), SPACED)
                starts, name = anchors(words.hash, words.first, window)
                if not len(starts):
                    continue
                text = np.searchsorted(words.first, starts, side="right") - 1
                new = np.ones(len(starts), dtype=bool)
                new[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
                head = np.flatnonzero(new)
                n = np.diff(np.append(head, len(starts)))
                sym, at, of = name[head], starts[head], text[head]
                stretch = window_hash(words.hash, at, n + window - 1)
                doc = piece.column(0).to_numpy()[of]
                met, windows = np.ones(len(head), dtype=bool), pa.nulls(len(head), pa.list_(pa.int64()))
                if again is not None:
                    pair = _pair_key(sym, stretch)
                    met, own = again.may_hold(pair), owners.may_hold(_owner_key(pair, doc))
                    some = met | own
                    sym, at, of, stretch, doc, n, met, own = (
                        x[some] for x in (sym, at, of, stretch, doc, n, met, own))
                    rows = np.where(own, n, 0)
                    each = np.repeat(at, rows) + np.arange(rows.sum()) - np.repeat(np.cumsum(rows) - rows, rows)
                    values = window_hash(words.hash, each, window).view(np.int64)
                    offs = np.concatenate([[0], np.cumsum(rows)]).astype(np.int32)
                    windows = pa.ListArray.from_arrays(pa.array(offs), pa.array(values))
                yield pa.RecordBatch.from_arrays([
                    pa.array(sym.view(np.int64)), pa.array(stretch.view(np.int64)), pa.array(doc),
                    pa.array(_text_keys(words)[of]), pa.array((at - words.first[of]).astype(np.int32)),
                    pa.array(n.astype(np.int32)), pa.array(met), windows], schema=_ANCHORS)
    return task


def _keys(batches):
    for b in batches:
        pair = _pair_key(b.column(0).to_numpy(), b.column(1).to_numpy())
        owner = _owner_key(pair, b.column(2).to_numpy())
        yield pa.RecordBatch.from_arrays(
            [pa.array(pair.view(np.int64)), pa.array(owner.view(np.int64)), b.column(3), b.column(4)],
            names=["pair", "owner", "again", "mixed"])


def repeated_ranges(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc, text_key, ranges): windows whose words also start in a smaller document.

    ``ranges`` is an array of (at, n): the windows that start at the words
    at .. at + n - 1 of the document.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")) \
        .where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    stretches = (texts.mapInArrow(_anchor_rows(window), _ANCHORS_SQL)
                 .groupBy("symbol", "stretch").agg(F.min("doc").alias("first"), F.max("doc").alias("last")))
    stretches = materialize(stretches, "stretches")
    symbols = (stretches.groupBy("symbol")
               .agg(F.min("first").alias("lo"), F.max("last").alias("hi"),
                    F.min("stretch").alias("one"), F.max("stretch").alias("other"))
               .where("lo < hi").select("symbol", (F.col("one") != F.col("other")).alias("mixed")))
    shared = materialize(stretches.join(symbols, "symbol")
                         .select("symbol", "stretch", "first", (F.col("first") < F.col("last")).alias("again"), "mixed"),
                         "shared-stretches")
    keys = shared.mapInArrow(_keys, "pair long, owner long, again boolean, mixed boolean")
    again, owners = Bitmap(keys.where("again"), "pair"), Bitmap(keys.where("mixed"), "owner")
    # written once: both branches below read it
    met = materialize(texts.mapInArrow(_anchor_rows(window, again, owners), _ANCHORS_SQL), "shared-anchors")
    whole = (met.where("again").select("symbol", "stretch", "doc", "text_key", "at", "n")
             .join(shared.where("again").select("symbol", "stretch", "first"), ["symbol", "stretch"])
             .where("doc > first").select("doc", "text_key", "at", "n"))
    each = (met.where(F.size("windows") > 0)
            .select("symbol", "doc", "text_key", "at", F.posexplode("windows").alias("step", "hash")))
    firsts = materialize(each.groupBy("symbol", "hash").agg(F.min("doc").alias("first"), F.max("doc").alias("last"))
                         .where("first < last").select("symbol", "hash", "first"), "shared-windows")
    single = (each.join(firsts, ["symbol", "hash"]).where("doc > first")
              .select("doc", "text_key", (F.col("at") + F.col("step")).alias("at"), F.lit(1).alias("n")))
    return (whole.unionByName(single).groupBy("doc", "text_key")
            .agg(F.collect_set(F.struct("at", "n")).alias("ranges")))


def _cut(window: int):
    def task(batches):
        for batch in batches:
            for piece in chunks(batch):
                words = Words(piece.column(1), SPACED, hashed=False)
                n_words = len(words.start)
                edge = np.zeros(n_words + 1, dtype=np.int64)
                ranges = piece.column(2)
                size = pa.compute.fill_null(pa.compute.list_value_length(ranges), 0).to_numpy(zero_copy_only=False)
                flat = ranges.flatten()
                at = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(words.first[:-1], size)
                n = flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(edge, at, 1)
                np.add.at(edge, at + n + window - 1, -1)
                kept = np.cumsum(edge[:-1]) == 0
                removed = words.counts - np.add.reduceat(np.append(kept, False).astype(np.int64), words.first[:-1]) \
                    * (words.counts > 0) if len(words.counts) else words.counts
                texts = []
                raw = words.raw.tobytes()
                begin, end = words.start.tolist(), words.end.tolist()
                for i in range(len(piece)):
                    a, b = int(words.first[i]), int(words.first[i + 1])
                    texts.append(b" ".join([raw[begin[k]:end[k]] for k in (np.flatnonzero(kept[a:b]) + a).tolist()])
                                 .decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(words.counts, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])
    return task


def _key_rows(batches):
    for batch in batches:
        for piece in chunks(batch):
            words = Words(piece.column(1), SPACED)
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), piece.column(1), pa.array(_text_keys(words))], names=["doc_id", "text", "text_key"])


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Every row of ``docs`` as (doc_id, n_words, n_removed, kept): the words of
    the text without those in a window of ``window`` words that also starts in
    a document with a smaller id, joined by one space."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = repeated_ranges(texts, window)
    keyed = texts.mapInArrow(_key_rows, "doc_id long, text string, text_key long")
    return (keyed.join(found.withColumnRenamed("doc", "doc_id"), ["doc_id", "text_key"], "left")
            .select("doc_id", "text", "ranges")
            .mapInArrow(_cut(window), "doc_id long, n_words long, n_removed long, kept string"))
