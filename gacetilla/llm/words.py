"""Vectorised words of text columns, for use inside Arrow tasks.

``chunks`` cuts a record batch into pieces of whole texts of about one MB, so the
working memory of a task does not follow the size of Spark's batches.
``Words`` finds the words of such a piece with byte tables and names each by
a 64-bit hash; nothing here keeps state between pieces.

Null and empty texts have no words.  A text longer than the piece size is a
piece of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

_U = np.uint64
_Q = _U(0x9E3779B97F4A7C15 | 3)          # odd multiplier of byte positions


def byte_class(inside) -> np.ndarray:
    """256 flags: the bytes that belong to a word."""
    return np.array([bool(inside(b)) for b in range(256)])


#: words are ``[^\x20\x09-\x0D]+``
SPACED = byte_class(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: words are ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (digits, lower-case letters, beyond ASCII)
ALNUM = byte_class(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """``base**i`` modulo 2**64 for i < n (made anew: a table kept in a worker
    would outlive the task that shipped this code)."""
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, out=out)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over the others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _placed(data: np.ndarray, start: np.ndarray, table: np.ndarray, step: np.uint64) -> np.ndarray:
    """A value for each byte and its place behind the last of ``start``, all bits
    mixed: sums of them tell runs apart whatever their pattern (sums of powers
    modulo 2**64 would not)."""
    place = np.zeros(len(data), dtype=np.int64)
    place[start] = start
    np.maximum.accumulate(place, out=place)
    place = np.arange(len(data)) - place
    return mix(table[data] + place.view(np.uint64) * step)


def string_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string array; nulls are empty."""
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string())
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], dtype=np.int64)[col.offset:col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], dtype=np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return offs - offs[0], data[offs[0]:offs[-1]]


def chunks(batch: pa.RecordBatch, text: str = "text", size: int = CHUNK_BYTES):
    """Slices of ``batch`` with whole texts of about ``size`` bytes in all."""
    if not len(batch):
        return
    offs, _ = string_buffers(batch.column(batch.schema.get_field_index(text)))
    at = 0
    while at < len(batch):
        end = int(np.searchsorted(offs, offs[at] + size, side="right")) - 1
        end = min(max(end, at + 1), len(batch))
        yield batch.slice(at, end - at)
        at = end


class Words:
    """Words of a piece: ``start``/``end`` bytes, ``hash`` and words per text."""

    def __init__(self, col: pa.Array, inside: np.ndarray = SPACED, lower: bool = False,
                 hashed: bool = True):
        self.offsets, raw = string_buffers(col)
        self.raw = raw
        data = _LOWER[raw] if lower else raw
        self.data = data
        n = len(data)
        word = inside[data]
        before = np.zeros(n, dtype=bool)
        before[1:] = word[:-1]
        cut = self.offsets[:-1]
        before[cut[cut < n]] = False
        after = np.zeros(n, dtype=bool)
        after[:-1] = word[1:]
        cut = self.offsets[1:] - 1
        after[cut[cut >= 0]] = False
        self.start = np.flatnonzero(word & ~before)
        self.end = np.flatnonzero(word & ~after) + 1
        #: words of text i are first[i] .. first[i + 1]
        self.first = np.searchsorted(self.start, self.offsets).astype(np.int64)
        self.counts = np.diff(self.first)
        self.hash = self._hash(word) if hashed else None

    def _hash(self, word) -> np.ndarray:
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        with np.errstate(over="ignore"):
            vals = _placed(self.data, self.start, _BYTE, _Q)
            vals[~word] = 0
            out = np.add.reduceat(vals, self.start)
            out += (self.end - self.start).astype(np.uint64) * _U(0xD6E8FEB86659FD93)
            return mix(out)

    @property
    def text_of(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


_R = _U(0xA0761D6478BD642F | 3)
_RINV = _U(pow(int(_R), -1, 1 << 64))


def window_hash(names: np.ndarray, starts: np.ndarray, lengths) -> np.ndarray:
    """Hashes of the runs ``names[s:s + length]``; equal runs have equal hashes."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(names) + 1, dtype=np.uint64)
        np.cumsum(names * powers(_R, len(names)), out=total[1:])
        out = (total[starts + lengths] - total[starts]) * powers(_RINV, len(names) + 1)[starts]
        return mix(out + _U(1) * np.asarray(lengths, dtype=np.uint64))


_BYTE2 = np.random.default_rng(20240608).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)
_Q2 = _U(0xC2B2AE3D27D4EB4F)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, second: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans ``data[start:end]``, which follow each
    other without overlap; ``second`` is independent of the first."""
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        solid = start[end > start]
        np.cumsum(_placed(data, solid, _BYTE2, _Q2) if second else _placed(data, solid, _BYTE, _Q), out=total[1:])
        return mix(total[end] - total[start] + (end - start).astype(np.uint64) * _U(0xD6E8FEB86659FD93))


class Lines:
    """Lines of a piece (cut at ``\\n``; a text without one is one line) and
    their keys: stripped of ``[\\x20\\x09-\\x0D]``, A-Z lower-cased."""

    def __init__(self, col: pa.Array):
        offsets, raw = string_buffers(col)
        self.data = data = _LOWER[raw]
        breaks = np.flatnonzero(data == 0x0A)
        text_of_break = np.searchsorted(offsets, breaks, side="right") - 1
        self.counts = np.bincount(text_of_break, minlength=len(col)).astype(np.int64) + 1
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        start = np.empty(self.first[-1], dtype=np.int64)
        end = np.empty(self.first[-1], dtype=np.int64)
        inner = np.ones(len(start), dtype=bool)
        inner[self.first[:-1]] = False
        start[self.first[:-1]] = offsets[:-1]
        start[inner] = breaks + 1
        inner = np.ones(len(end), dtype=bool)
        inner[self.first[1:] - 1] = False
        end[self.first[1:] - 1] = offsets[1:]
        end[inner] = breaks
        solid = np.flatnonzero(SPACED[data])
        padded = np.append(solid, len(data))
        self.start = np.minimum(padded[np.searchsorted(solid, start)], end)
        last = np.searchsorted(solid, end) - 1
        self.end = np.maximum(np.where(last >= 0, padded[last] + 1, 0), self.start)
        points = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=points[1:])
        #: code points of each key
        self.length = points[self.end] - points[self.start]

    def hashes(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[some], self.end[some]
        return span_hash(self.data, a, b), span_hash(self.data, a, b, second=True)
