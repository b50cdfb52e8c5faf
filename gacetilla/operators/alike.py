"""Dice similarity of all words of one table with each other.

The same pairs as ``similarity.dice_pairs`` finds for any two tables, for a
table that is its own lexicon, where every bigram is held by many words.

A word is the set of its elements (bigrams, the n-th repetition of one being an
element of its own) in one order, rarest first.  Of a pair, the word with the
smaller length is the short one: it shares ``threshold * (len - 1)`` of its
elements at least, the long one ``threshold / (2 - threshold) * (len - 1)``.  So
the first shared element is among a word's first ones, one more than it may
miss, and the first COMBINED shared ones are among its first ``missing + COMBINED``.

On Spark a word goes to a *cell* for each element that may be its first shared
one.  Cells are made by counts over slots of elements (tables of a fixed size):
rare slots share a cell of about CELL rows, a slot of more than CHUNK rows is cut
into chunks by hash of the word, with a cell for every two of them.  A cell's
pairs are found in its task: equal keys of COMBINED elements, then the
positions, a signature of 128 bits, and the exact intersection.  A pair counts
only in the cell of its first shared element, so it comes once.  A task holds a
cell and a step of candidates, and hands its pairs on in batches: the pairs of a
cell are never held, however many there are.

The output grows with the pairs, and these with the square of the words
where the words are alike.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: elements of a key, for words of which at most so many elements may be missing
COMBINED = 4
MISSING = 8
SLOT_BITS = 16
#: rows of a cell that rare slots share, and of a chunk of a slot
CELL = 50_000
CHUNK = 100_000
#: shuffle partitions of cells at most
PARTITIONS = 4000
#: words read, candidates and matrix entries worked on at once
READ = 20_000
STEP = 1 << 20
MATRIX = 1 << 24
BATCH = 100_000

_MIX = np.random.default_rng(7).integers(1 << 62, 1 << 63, 64, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_LENGTHS = np.uint64(63)


def _hashed(codes: np.ndarray) -> np.ndarray:
    x = codes.astype(np.uint64) * _MIX[0]
    x ^= x >> np.uint64(29)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(32))


def _slots(codes: np.ndarray) -> np.ndarray:
    return (_hashed(codes) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _by_length(norms: list[str]):
    """(places, elements) of the words of each length, elements as numbers in
    the order of the word: both characters and the repetition."""
    flat = np.frombuffer("".join(norms).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    size = np.array([len(w) for w in norms], dtype=np.int64)
    start = np.cumsum(size) - size
    for n in np.unique(size[size > 1]).tolist():
        # very long words a few at a time
        every = np.flatnonzero(size == n)
        for at in range(0, len(every), max(1, MATRIX // n)):
            places = every[at:at + max(1, MATRIX // n)]
            chars = flat[start[places][:, None] + np.arange(n)]
            grams = np.sort((chars[:, :-1] << 21) | chars[:, 1:], axis=1)
            head = np.ones(grams.shape, bool)
            head[:, 1:] = grams[:, 1:] != grams[:, :-1]
            i = np.arange(n - 1)
            time = i - np.maximum.accumulate(np.where(head, i, 0), axis=1)
            yield places, (grams << 21) | np.minimum(time, (1 << 21) - 1)


def _ordered(elements: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Rarest first; equal ones by number."""
    by_class = np.argsort(held[_slots(elements)], axis=1, kind="stable")  # elements are sorted by number
    return np.take_along_axis(elements, by_class, axis=1)


def _missing(n, unit, share: float):
    """Elements that a word may miss; below 0 where it can't be similar at all."""
    return n - np.maximum(np.ceil(share * unit - 1e-9), 1).astype(np.int64)


def _units(norms: list[str], length_unit: str) -> np.ndarray:
    size = (len(w.encode("utf-8", "surrogatepass")) if length_unit == "byte" else len(w) for w in norms)
    return np.fromiter(size, np.int64, len(norms)) - 1


def _counted(words: DataFrame, task) -> np.ndarray:
    """A table of counts by slot, from tasks' own."""
    rows = (words.mapInArrow(task, "slot int, held long").groupBy("slot").agg(F.sum("held").alias("held"))).toArrow()
    out = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    out[rows["slot"].to_numpy()] = rows["held"].to_numpy()
    return out


def _read(batches):
    """(batch, norms) of a few words each."""
    for batch in batches:
        for at in range(0, len(batch), READ):
            part = batch.slice(at, READ)
            yield part, part.column(part.schema.get_field_index("norm")).to_pylist()


def _sums(batches, slots_of):
    out = np.zeros(1 << SLOT_BITS, dtype=np.int64)
    for _, norms in _read(batches):
        for slots in slots_of(norms):
            out += np.bincount(slots, minlength=1 << SLOT_BITS)
    own = np.flatnonzero(out)
    yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(out[own])], names=["slot", "held"])


def _prefixes(norms, held, share, length_unit):
    """For each length: places, ordered elements, and rows and columns of the
    elements that may be a pair's first shared one."""
    units = _units(norms, length_unit)
    for places, elements in _by_length(norms):
        ordered = _ordered(elements, held)
        missing = _missing(ordered.shape[1], units[places], share)
        row, column = np.nonzero(np.arange(ordered.shape[1])[None, :] <= missing[:, None])
        yield places, ordered, row, column


def cells(rows: np.ndarray, cell: int = CELL, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray, int]:
    """First cell and chunks of each slot, from its rows, and the number of cells.
    A slot of k chunks has k * k numbers, of which those of i <= j are used."""
    chunks = np.maximum(1, -(-rows // chunk))
    first = np.zeros(len(rows), dtype=np.int64)
    one = chunks == 1
    before = np.cumsum(np.where(one, rows, 0))
    first[one] = (before[one] - 1).clip(0) // cell
    at = int(first.max()) + 1
    for slot in np.flatnonzero(~one).tolist():
        first[slot] = at
        at += int(chunks[slot]) ** 2
    return first, chunks, at


class Cell:
    """The rows of a cell: words with the place of the element that is to be a
    pair's first shared one."""

    def __init__(self, norms, at, side, held, threshold: float, length_unit: str):
        self.norms, self.side, self.threshold = norms, side, threshold
        self.unit = _units(norms, length_unit)
        self.n = np.array([len(w) - 1 for w in norms], dtype=np.int64)
        self.at = at
        self.loose = self.n - threshold * self.unit
        share = threshold / (2 - threshold)
        self.long, self.short = (_missing(self.n, self.unit, s) for s in (share, threshold))
        most = MISSING / (1 - share) if share < 1 else float("inf")
        blocks = [(places, _ordered(elements, held)) for places, elements in _by_length(norms)]
        self.sign = np.zeros((len(norms), 2), dtype=np.uint64)
        self.first = np.zeros(len(norms), dtype=np.uint64)
        self.blocks = []
        keys = {role: [] for role in ("long", "short", "long single", "short single")}
        for places, ordered in blocks:
            x = _hashed(ordered)
            self.first[places] = x[np.arange(len(places)), at[places]]
            for half in (0, 1):
                self.sign[places, half] = np.bitwise_or.reduce(
                    np.where((x >> np.uint64(6)) & np.uint64(1) == half, np.uint64(1) << (x & np.uint64(63)), np.uint64(0)), axis=1)
            self.blocks.append((places, ordered))
            for role, missing in (("long", self.long), ("short", self.short)):
                own = (at[places] <= missing[places])
                self._combined(keys[role], places, x, missing[places], own & (self.unit[places] <= most))
                # longer words, and those that can be similar to them, meet at the one element
                far = own & (self.unit[places] > (most if role == "long" else share * most - 1e-9))
                keys[f"{role} single"].append((self.first[places[far]], places[far], at[places[far]]))
        self.block = np.zeros(len(norms), dtype=np.int64)
        self.row = np.zeros(len(norms), dtype=np.int64)
        for i, (places, _) in enumerate(self.blocks):
            self.block[places] = i
            self.row[places] = np.arange(len(places))
        self.keys = {role: tuple(np.concatenate(x) for x in zip(*made)) if made else None for role, made in keys.items()}

    def _combined(self, out, places, x, missing, own):
        """Keys of the first element and COMBINED - 1 behind it, as far as they can be
        a pair's first shared ones; elements that all words have stand behind the others."""
        n, at = x.shape[1], self.at[places]
        pads = np.broadcast_to(_hashed(np.arange(1, COMBINED)), (len(x), COMBINED - 1))
        x = np.concatenate([x, pads], axis=1)
        for m in np.unique(missing[own]).tolist():
            for first in range(min(m, n - 1) + 1):
                pick = np.flatnonzero(own & (missing == m) & (at == first))
                if not len(pick):
                    continue
                for others in combinations(range(first + 1, min(m + COMBINED, n + COMBINED - 1)), COMBINED - 1):
                    key = x[pick, first]
                    for k, other in enumerate(others, 2):
                        key = (key ^ (key >> np.uint64(31))) * _MIX[k] + x[pick, other]
                    out.append((key, places[pick], np.full(len(pick), others[-1], np.int64)))

    def candidates(self):
        """(short rows, long rows) that share a key and pass the filters of lengths,
        positions and signatures, some short rows at a time, each pair once."""
        rows = max(len(self.n), 1)
        for kind, size in (("", COMBINED), (" single", 1)):
            if self.keys["long" + kind] is None or self.keys["short" + kind] is None:
                continue
            # the last bits of a key are the long word's length: a short word's key, with what
            # stands behind it, leaves a range of them
            key, owner, last = self.keys["long" + kind]
            key = key & ~_LENGTHS | self.unit[owner].clip(max=63).astype(np.uint64)
            order = np.argsort(key)
            key, owner, last = key[order], owner[order], last[order]
            left, short, end = self.keys["short" + kind]
            order = np.argsort(left)
            left, short, end = left[order] & ~_LENGTHS, short[order], end[order]
            rest = (self.n[short] - end - 1).clip(0)
            most = np.floor(2 * (size + rest) / self.threshold - self.unit[short] + 1e-6).clip(0, 63).astype(np.uint64)
            lo = np.searchsorted(key, left | self.unit[short].clip(max=63).astype(np.uint64), "left")
            hi = np.searchsorted(key, left | most, "right")
            some = np.flatnonzero(hi > lo)
            some = some[np.argsort(short[some], kind="stable")]
            short, end, lo, many = short[some], end[some], lo[some], (hi - lo)[some]
            done = np.cumsum(many)
            behind = (self.n[owner] - last - 1).clip(0)
            # of the short and the long word of each key: signature, what it adds to the elements that
            # only one of a pair may have, and its length and the greatest one of the other
            left = (self.sign[short, 0], self.sign[short, 1], self.loose[short], self.unit[short])
            right = (self.sign[owner, 0], self.sign[owner, 1], self.loose[owner],
                     2 * (size + behind) / self.threshold - self.unit[owner] + 1e-6)
            # a short row's keys stay together, so its pairs are made distinct at once
            bounds = np.flatnonzero(np.diff(short, prepend=-1, append=rows))
            at = 0
            while at < len(bounds) - 1:
                x = bounds[at]
                base = done[x] - many[x]
                at = max(at + 1, int(np.searchsorted(done[bounds[1:] - 1], base + STEP, "right")))
                of = np.arange(x, bounds[at])
                found = []
                for flat in range(0, done[of[-1]] - base, STEP):  # one, but for a row with more than a step
                    start = np.maximum(done[of] - many[of] - base, flat)
                    count = (np.minimum(done[of] - base, flat + STEP) - start).clip(0)
                    own = np.repeat(lo[of] + start - (done[of] - many[of] - base) - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    a, b = self._passed(np.repeat(of, count), own, left, right)
                    a, b = short[a], owner[b]
                    keep = (self.unit[a] < self.unit[b]) | ((self.unit[a] == self.unit[b]) & (a < b))
                    keep &= (self.side[a] < 0) | (self.side[a] != self.side[b])
                    found.append(np.unique(a[keep] * rows + b[keep]))
                every = np.unique(np.concatenate(found)) if len(found) > 1 else found[0]
                yield every // rows, every % rows

    @staticmethod
    def _passed(a, b, left, right):
        """The candidates whose lengths, positions and signatures leave room for the score."""
        apart = np.bitwise_count(left[0][a] ^ right[0][b])
        apart += np.bitwise_count(left[1][a] ^ right[1][b])
        keep = np.flatnonzero((apart <= left[2][a] + right[2][b] + 1e-9) & (left[3][a] <= right[3][b]))
        return a[keep], b[keep]

    def pairs(self):
        """(short rows, long rows, shared elements) of the similar pairs, step by step, each once."""
        for a, b in self.candidates():
            group = self.block[a] * len(self.blocks) + self.block[b]
            order = np.argsort(group, kind="stable")
            bounds = np.flatnonzero(np.diff(group[order], prepend=-1, append=-1))
            for x, y in zip(bounds, bounds[1:]):
                own = order[x:y]
                left, right = (self.blocks[k[own[0]]][1] for k in (self.block[a], self.block[b]))
                step = max(1, MATRIX // (left.shape[1] * right.shape[1]))
                for at in range(0, len(own), step):
                    yield self._exact(a[own[at:at + step]], b[own[at:at + step]], left, right)

    def _exact(self, a, b, left, right):
        left, right = left[self.row[a]], right[self.row[b]]
        if left.shape[1] * right.shape[1] > MATRIX:  # one pair of very long words
            held = np.isin(left[0], right[0])[None, :]
        else:
            held = (left[:, :, None] == right[:, None, :]).any(axis=2)
        shared = held.sum(axis=1)
        keep = (held.argmax(axis=1) == self.at[a]) & (shared > 0) & (2.0 * shared / (self.unit[a] + self.unit[b]) >= self.threshold)
        for i in np.flatnonzero(keep & (shared == self.n[a]) & (shared == self.n[b])).tolist():
            keep[i] = self.norms[a[i]] != self.norms[b[i]]
        return a[keep], b[keep], shared[keep].astype(np.int64)


_PAIR = "token string, root string, inter long, denom long, dice double"


def _matched(table: pa.Table, held, threshold, length_unit):
    """Batches of the pairs of a cell, both ways."""
    norm, token = (table.column(c).combine_chunks() for c in ("norm", "token"))
    cell = Cell(norm.to_pylist(), *(table.column(c).to_numpy().astype(np.int64) for c in ("at", "side")),
                held, threshold, length_unit)
    parts, size = [], 0

    def out():
        a, b, inter = (np.concatenate(x) for x in zip(*parts))
        denom = cell.unit[a] + cell.unit[b]
        dice = 2.0 * inter / denom
        for x, y in ((a, b), (b, a)):
            for at in range(0, len(a), BATCH):
                some = slice(at, at + BATCH)
                yield pa.RecordBatch.from_arrays([token.take(pa.array(x[some])), token.take(pa.array(y[some])), pa.array(inter[some]),
                                                  pa.array(denom[some]), pa.array(dice[some])], names=["token", "root", "inter", "denom", "dice"])
    for found in cell.pairs():
        parts.append(found)
        size += len(found[0])
        if size >= BATCH:
            yield from out()
            parts, size = [], 0
    if size:
        yield from out()


def _each_cell(batches):
    """The tables of cells, from rows in the order of cells."""
    held, of = [], None
    for batch in batches:
        number = batch.column(0).to_numpy()
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]]).tolist()
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if held and of != number[x]:
                yield pa.Table.from_batches(held)
                held = []
            of = number[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


def alike_pairs(words: DataFrame, threshold: float, length_unit: str) -> DataFrame:
    """token, root, inter, denom, dice of all pairs of words of ``words`` (token,
    norm) with different norms and a score of ``threshold`` at least, both ways."""
    spark = words.sparkSession
    threshold = min(threshold, 1.0)  # nothing but equal words scores more
    share = threshold / (2 - threshold)
    counts = _counted(words, lambda batches: _sums(batches, lambda norms: (_slots(e).ravel() for _, e in _by_length(norms))))
    # powers of two: order matters little among elements that are about as rare
    held = spark.sparkContext.broadcast(np.frexp(counts.astype(np.float64))[1].astype(np.int8))

    def first_slots(norms):
        for _, ordered, row, column in _prefixes(norms, held.value, share, length_unit):
            yield _slots(ordered[row, column])

    first, chunks, n_cells = cells(_counted(words, lambda batches: _sums(batches, first_slots)))
    dealt_by = spark.sparkContext.broadcast((first, chunks))

    def deal(batches):
        first, chunks = dealt_by.value
        for batch, norms in _read(batches):
            text = [batch.column(batch.schema.get_field_index(c)) for c in ("token", "norm")]
            for places, ordered, row, column in _prefixes(norms, held.value, share, length_unit):
                slot = _slots(ordered[row, column])
                k = chunks[slot]
                own = (_hashed((ordered * _MIX[2].astype(np.int64)).sum(axis=1))[row] >> np.uint64(20)).astype(np.int64) % k
                again = np.repeat(np.arange(len(row)), k)  # a row for each chunk that this one meets
                other = np.arange(len(again)) - np.repeat(np.cumsum(k) - k, k)
                i, j = np.minimum(own[again], other), np.maximum(own[again], other)
                cell = first[slot[again]] + np.where(k[again] > 1, i * k[again] + j, 0)
                side = np.where(i == j, -1, (own[again] == j).astype(np.int64))
                at = pa.array(places[row[again]])
                for x in range(0, len(again), BATCH):
                    some = slice(x, x + BATCH)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[some]), pa.array(column[again][some], pa.int32()), pa.array(side[some], pa.int32()),
                         *(c.take(at[some]) for c in text)], names=["cell", "at", "side", "token", "norm"])

    def match(batches):
        for table in _each_cell(batches):
            yield from _matched(table, held.value, threshold, length_unit)

    dealt = words.mapInArrow(deal, "cell long, at int, side int, token string, norm string")
    return dealt.repartition(min(n_cells, PARTITIONS), "cell").sortWithinPartitions("cell").mapInArrow(match, _PAIR)
