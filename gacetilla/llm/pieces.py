"""Offset-preserving encoding and decoding with SentencePiece BPE models.

``Normalizer`` rewrites text by the longest prefix found in the model's
compiled character map (a double-array trie over UTF-8 bytes) and records, for
every byte of its output, the source byte it came from.  ``Encoder`` merges
the best-scoring neighbours of each segment and projects every piece back to
the byte span of the original text.  Characters that no piece holds fall back
to byte pieces, which share the span of their character.

A segment is a run of spaces with the word after it, cut also between
letters and signs that stand together in no piece: no merge crosses a cut, so
segments are encoded on their own, the new ones of a batch together, and those
of a task are remembered up to CACHE segments.  Texts are cut nowhere else.

On Spark each task reads whole texts and holds the model's tables (one
broadcast, the size of the vocabulary); there is no shuffle.

Edge cases: null and empty texts have no ids and decode to the empty text;
texts of white space alone keep it.  Repeated rows and a null ``doc_id`` are
passed on as they are; extra columns are ignored; an empty table gives an
empty result.  Models other than BPE, and models with user-defined symbols,
raise ``ValueError``.
"""

from __future__ import annotations

import hashlib
import re
import struct
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import Shared
from .words import chunks

SPACE = "▁"
CACHE = 300_000

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class CharsMap:
    """Longest-prefix replacement by a compiled character map."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0]
        self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
        self.strings = blob[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, source bytes) of the longest key at ``data[at:]``."""
        units = self.units
        unit = units[0]
        node = (unit >> 10) << ((unit & 0x200) >> 6)
        best = None
        for k in range(at, len(data)):
            node ^= data[k]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != data[k]:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = units[node] & 0x7FFFFFFF, k + 1 - at
        if best is None:
            return None
        start, used = best
        return self.strings[start:self.strings.index(b"\0", start)], used


class Normalizer:
    def __init__(self, charsmap: bytes = b"", dummy_prefix: bool = True, trim_spaces: bool = False,
                 escape: bool = True):
        self.map = CharsMap(charsmap) if charsmap else None
        self.dummy_prefix, self.trim_spaces = dummy_prefix, trim_spaces
        self.space = SPACE if escape else " "

    @property
    def plain(self) -> bool:
        """No rewriting beyond the dummy prefix and the space mark."""
        return self.map is None and not self.trim_spaces

    def _steps(self, data: bytes):
        at = 0
        while at < len(data):
            found = self.map.longest(data, at) if self.map else None
            if found is None:
                lead = data[at]
                n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = data[at:at + n], n
            yield at, found[0].decode("utf-8"), found[1]
            at += found[1]

    def __call__(self, text: str) -> tuple[str, list[int]]:
        """Normalised text, and the source byte offset of each of its
        characters followed by the end of the source."""
        out: list[str] = []
        align: list[int] = []
        data = text.encode("utf-8")
        before = self.trim_spaces
        for at, chars, _ in self._steps(data):
            for ch in chars:
                if ch == " " and before:
                    continue
                if not out and self.dummy_prefix:
                    out.append(self.space)
                    align.append(at)
                out.append(self.space if ch == " " else ch)
                align.append(at)
                before = self.trim_spaces and ch == " "
        end = len(data)
        if self.trim_spaces:
            while out and out[-1] == self.space and len(out) > self.dummy_prefix:
                out.pop()
                end = align.pop()
            if out == [self.space]:
                out, align = [], []
        return "".join(out), [*align, end]


class Model:
    """Plain tables of a model; small enough to broadcast."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        if proto.trainer_spec.model_type != 2:
            raise ValueError("only BPE models are supported")
        if any(p.type == USER for p in proto.pieces):
            raise ValueError("user-defined symbols are not supported")
        spec = proto.normalizer_spec
        self.norm = (spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces,
                     spec.escape_whitespaces)
        self.pieces = [p.piece for p in proto.pieces]
        self.types = [p.type for p in proto.pieces]
        self.scores = [p.score for p in proto.pieces]
        self.unknown = self.types.index(UNKNOWN)
        self.unknown_surface = proto.trainer_spec.unk_surface
        self.byte_ids = [self.pieces.index(f"<0x{b:02X}>") for b in range(256)] if BYTE in self.types else None


def _segments(long: list[str]) -> re.Pattern:
    """Cuts normalised text where no piece of ``long`` can lie across.

    Pieces hold spaces only in front, so a space ends a segment.  A sign that
    stands beside no letter or digit in any piece is cut from them; the other
    signs hold on to both sides.
    """
    if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in long):
        return re.compile(r"(?s).+")  # pieces cross words: one segment
    signs = {c for c in [*map(chr, range(128)), *"".join(long)] if not c.isalnum() and c != SPACE}
    beside = {c for p in long for x, y in zip(p, p[1:]) for c, o in ((x, y), (y, x))
              if c in signs and o not in signs and o != SPACE}
    free, hold = (re.escape("".join(sorted(x))) for x in (signs - beside, beside))
    either = f"(?:[^{SPACE}{free}{hold}]+|[{free}]+)" if free else f"[^{SPACE}{hold}]+"
    if not hold:
        return re.compile(f"{SPACE}*{either}|{SPACE}+")
    return re.compile(f"{SPACE}*(?:{either}(?:[{hold}]+{either}?)*|(?:[{hold}]+{either}?)+)|{SPACE}+")


class Merger:
    """Merges of many segments at once: every step joins, in each segment that
    still has a pair, the best-scoring and then leftmost one."""

    _NONE = np.int64(1) << 60

    def __init__(self, rank: dict[str, int], ids: dict[str, int]):
        chars = sorted({c for p in rank for c in p})
        symbols = chars + [p for p in rank if len(p) > 1]
        number = {x: i for i, x in enumerate(symbols)}
        self.code = np.array([ord(c) for c in chars], dtype=np.uint32)
        #: piece id of each symbol, -1 for characters that are no piece; the last one is for unknown characters
        self.piece = np.array([ids.get(x, -1) for x in symbols] + [-1], dtype=np.int32)
        self.n = len(symbols)
        pairs = [(number[p[:k]], number[p[k:]], r, number[p]) for p, r in rank.items() if len(p) > 1
                 for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        left, right, ranks, made = (np.array(x, dtype=np.int64) for x in zip(*pairs)) if pairs else [np.zeros(0, np.int64)] * 4
        key = left * (self.n + 1) + right
        # open addressing: a key sits at one of few probes of its slot
        self.bits = max(int(len(key)).bit_length() + 2, 4)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.value = np.full(1 << self.bits, self._NONE, dtype=np.int64)  # rank, then symbol: sorts by rank
        todo, self.probes = np.arange(len(key)), 0
        while len(todo):
            at = self._slot(key[todo], self.probes)
            first = np.unique(at, return_index=True)[1]
            ok = first[self.keys[at[first]] == -1]
            self.keys[at[ok]] = key[todo[ok]]
            self.value[at[ok]] = ranks[todo[ok]] * (self.n + 1) + made[todo[ok]]
            todo = np.delete(todo, ok)
            self.probes += 1

    def _slot(self, key, probe: int):
        with np.errstate(over="ignore"):
            h = key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            return ((h >> np.uint64(64 - self.bits)).astype(np.int64) + probe) & ((1 << self.bits) - 1)

    def _pairs(self, a, b):
        """Value of each pair of symbols, _NONE where they make no piece."""
        key = a * (self.n + 1) + b
        out = np.full(len(key), self._NONE, dtype=np.int64)
        left = np.arange(len(key))
        for probe in range(self.probes):
            at = self._slot(key[left], probe)
            here = self.keys[at]
            hit = here == key[left]
            out[left[hit]] = self.value[at[hit]]
            left = left[~hit & (here != -1)]
            if not len(left):
                break
        return out

    def __call__(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(piece ids, offsets) of the segments; -1 stands for an unknown character."""
        size = np.array([len(x) for x in segments], dtype=np.int64)
        code = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        sym = np.where(self.code[at] == code, at, self.n).astype(np.int64)
        word = np.repeat(np.arange(len(segments)), size)
        done_sym, done_word = [], []
        value = np.full(len(sym), self._NONE, dtype=np.int64)
        inner = np.flatnonzero(word[1:] == word[:-1])
        value[inner] = self._pairs(sym[inner], sym[inner + 1])
        while len(sym):
            head = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            count = np.diff(np.append(head, len(sym)))
            best = np.repeat(np.minimum.reduceat(value, head), count)
            over = best == self._NONE
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                stay = ~over
                sym, word, value, best = sym[stay], word[stay], value[stay], best[stay]
                if not len(sym):
                    break
            hit = np.flatnonzero(value == best)
            hit = hit[np.concatenate([[True], word[hit[1:]] != word[hit[:-1]]])]  # the leftmost of each segment
            sym[hit] = value[hit] % (self.n + 1)
            keep = np.ones(len(sym), dtype=bool)
            keep[hit + 1] = False
            hit = hit - np.arange(len(hit))  # its place when the right parts are gone
            sym, word, value = sym[keep], word[keep], value[keep]
            value[hit] = self._NONE
            right = hit[(hit + 1 < len(sym)) & (word[np.minimum(hit + 1, len(sym) - 1)] == word[hit])]
            value[right] = self._pairs(sym[right], sym[right + 1])
            left = hit[(hit > 0) & (word[hit - 1] == word[hit])] - 1
            value[left] = self._pairs(sym[left], sym[left + 1])
        sym, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_sym, done_word))
        order = np.argsort(word, kind="stable")
        offsets = np.searchsorted(word[order], np.arange(len(segments) + 1))
        return self.piece[sym[order]], offsets


class Encoder:
    def __init__(self, model: Model, cache: int = CACHE):
        self.model = model
        self.normalizer = Normalizer(*model.norm)
        self.ids = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types)) if t in (NORMAL, UNUSED)}
        #: pieces by falling score: the place in this order decides merges
        order = sorted(self.ids.values(), key=lambda i: -model.scores[i])
        self.rank, last = {}, None
        for i in order:
            if model.scores[i] != last:
                last, place = model.scores[i], len(self.rank)
            self.rank[model.pieces[i]] = place
        self.unused = {model.pieces[i] for i in self.ids.values() if model.types[i] == UNUSED}
        self.segment = _segments([p for p in self.ids if len(p) > 1])
        self.merger = None if self.unused else Merger(self.rank, self.ids)
        #: source bytes of each id where nothing is rewritten, its decimal form, and the byte of byte pieces
        self.width = np.array([len(p.replace(SPACE, " ").encode("utf-8")) for p in model.pieces], dtype=np.int32)
        self.decimal = [str(i) for i in range(len(model.pieces))]
        self.byte = np.full(len(model.pieces), -1, dtype=np.int32)
        if model.byte_ids:
            self.byte[model.byte_ids] = np.arange(256)
        self.seen: dict[str, bytes] = {}
        self.limit = cache

    def _merge(self, segment: str) -> list[str]:
        """Symbols left when the best-scoring, then leftmost, neighbours are merged."""
        parts = list(segment)
        n = len(parts)
        if n > 64:
            return self._merge_long(parts)
        get, never, unused = self.rank.get, len(self.rank), self.unused
        at = [get(segment[i:i + 2], never) for i in range(n - 1)]
        made: dict[str, tuple[str, str]] = {}
        while at:
            best = min(at)
            if best == never:
                break
            i = at.index(best)
            both = parts[i] + parts[i + 1]
            if both in unused:
                made[both] = (parts[i], parts[i + 1])
            parts[i] = both
            del parts[i + 1], at[i]
            if i:
                at[i - 1] = get(parts[i - 1] + both, never)
            if i < len(at):
                at[i] = get(both + parts[i + 1], never)
        return self._split_unused(parts, made) if made else parts

    def _merge_long(self, parts: list[str]) -> list[str]:
        """The same by a heap, for long segments."""
        import heapq

        rank, n = self.rank, len(parts)
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list = []
        made: dict[str, tuple[str, str]] = {}

        def offer(i):
            j = after[i]
            if j < n:
                r = rank.get(parts[i] + parts[j])
                if r is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            if a + b in self.unused:
                made[a + b] = (a, b)
            parts[i], parts[j] = a + b, ""
            after[i] = after[j]
            if after[j] < n:
                ahead[after[j]] = i
            if ahead[i] >= 0:
                offer(ahead[i])
            offer(i)
        left = [p for p in parts if p]
        return self._split_unused(left, made) if made else left

    def _split_unused(self, parts, made):
        out, todo = [], parts[::-1]
        while todo:
            p = todo.pop()
            if p in made:
                todo.extend(made[p][::-1])
            else:
                out.append(p)
        return out

    def pieces_of(self, segment: str) -> tuple[list[int], list[int]]:
        """Ids of a segment, and the characters each takes; byte pieces take
        theirs with the last of their character."""
        ids, sizes = [], []
        for p in self._merge(segment):
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
                sizes.append(len(p))
            elif self.model.byte_ids is None:
                ids.append(self.model.unknown)
                sizes.append(len(p))
            else:
                raw = p.encode("utf-8")
                ids.extend(self.model.byte_ids[b] for b in raw)
                sizes.extend([0] * (len(raw) - 1) + [len(p)])
        return ids, sizes

    def _learn(self, segments) -> None:
        """Remembers the ids of segments."""
        if len(self.seen) + len(segments) > self.limit:
            self.seen.clear()
        new = [x for x in segments if x not in self.seen]
        slow = new
        if self.merger is not None and new:
            flat, offsets = self.merger(new)
            raw = flat.tobytes()
            at = (offsets * 4).tolist()
            self.seen.update(zip(new, [raw[x:y] for x, y in zip(at, at[1:])]))
            unknown = np.unique(np.searchsorted(offsets, np.flatnonzero(flat < 0), side="right") - 1)
            slow = [new[i] for i in unknown.tolist()]
        for segment in slow:
            self.seen[segment] = array("i", self.pieces_of(segment)[0]).tobytes()

    def _ends(self, ids: np.ndarray) -> np.ndarray:
        """Source bytes up to each piece's end; byte pieces end with their character."""
        width = self.width[ids]
        byte = self.byte[ids]
        if (byte >= 0).any():
            width[byte >= 0] = 0
            lead = np.flatnonzero((byte >= 0) & ((byte < 0x80) | (byte >= 0xC0)))
            size = 1 + (byte[lead] >= 0xC0) + (byte[lead] >= 0xE0) + (byte[lead] >= 0xF0)
            width[lead + size - 1] = size
        return np.cumsum(width, dtype=np.int32)

    def encode_many(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, source byte at which each piece ends) of every text.

        A piece starts where the one before ends; byte pieces of one character
        end together at the last of them.
        """
        prefix = SPACE if self.normalizer.dummy_prefix else ""
        plain = [self.normalizer.plain and self.normalizer.space == SPACE and SPACE not in t for t in texts]
        parts = [self.segment.findall(prefix + t.replace(" ", SPACE)) if p and t else [] for t, p in zip(texts, plain)]
        seen = self.seen
        new = {x for xs in parts for x in xs if x not in seen}
        if new:
            if len(seen) + len(new) > self.limit:
                seen.clear()
                new = {x for xs in parts for x in xs}
            self._learn(new)
        out = []
        for t, p, xs in zip(texts, plain, parts):
            if not p and t:
                out.append(self._encode_rewritten(t))
                continue
            ids = np.frombuffer(b"".join(map(seen.__getitem__, xs)), np.int32)
            ends = self._ends(ids)
            if prefix:
                ends -= 1  # the prefix counts as a space but has no source byte
            out.append((ids, np.maximum(ends, 0)))
        return out

    def _encode_rewritten(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        norm, align = self.normalizer(text)
        ids, ends, at = [], [], 0
        for segment in self.segment.findall(norm):
            own, sizes = self.pieces_of(segment)
            for i, n in zip(own, sizes):
                at += n
                ids.append(i)
                ends.append(align[at])
        return np.array(ids, np.int32), np.array(ends, np.int32)

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_many([text])[0]

    def joined(self, ids: np.ndarray) -> str:
        """Decimal ids joined by commas."""
        decimal = self.decimal
        return ",".join([decimal[i] for i in ids.tolist()])


class Decoder:
    def __init__(self, model: Model):
        self.dummy = model.norm[1]
        self.trim = model.norm[2]
        surface = []
        for p, t in zip(model.pieces, model.types):
            if t == CONTROL:
                surface.append(b"")
            elif t == UNKNOWN:
                surface.append(model.unknown_surface.encode("utf-8"))
            elif t == BYTE:
                surface.append(bytes([int(p[3:5], 16)]))
            else:
                surface.append(p.replace(SPACE, " ").encode("utf-8"))
        self.surface = surface
        self.leads = [t == NORMAL and p.startswith(SPACE) for p, t in zip(model.pieces, model.types)]

    def decode(self, ids: np.ndarray) -> str:
        if not len(ids):
            return ""
        out = b"".join(map(self.surface.__getitem__, ids.tolist())).decode("utf-8", "replace")
        return out[1:] if self.dummy and self.leads[ids[0]] else out


def _round_trip(model):
    def task(batches):
        encoder, decoder = Encoder(model.value), Decoder(model.value)
        for batch in batches:
            for piece in chunks(batch):
                ids, ends, shas, texts = [], [], [], []
                for own, end in encoder.encode_many([t or "" for t in piece.column(1).to_pylist()]):
                    ids.append(own)
                    ends.append(end)
                    shas.append(hashlib.sha256(encoder.joined(own).encode()).hexdigest())
                    texts.append(decoder.decode(own))
                size = np.array([len(x) for x in ids], dtype=np.int64)
                offs = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.ListArray.from_arrays(offs, pa.array(np.concatenate(ids))),
                     pa.ListArray.from_arrays(offs, pa.array(np.concatenate(ends))),
                     pa.array(size), pa.array(shas, pa.string()), pa.array(texts, pa.string())],
                    names=["doc_id", "ids", "ends", "n_tokens", "ids_sha256", "decoded"])
    return task


def round_trip(docs: DataFrame, model_path: str) -> DataFrame:
    """A row per document: doc_id, ids, ends (source byte offset at which each
    piece ends), n_tokens, ids_sha256 (of the decimal ids joined by commas) and
    decoded, the text decoded from ids."""
    model = Shared(docs.sparkSession, Model(model_path))
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(_round_trip(model), "doc_id long, ids array<int>, ends array<int>, n_tokens long, "
                                            "ids_sha256 string, decoded string"))
