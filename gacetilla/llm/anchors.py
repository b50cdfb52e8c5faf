"""Alignment of two tokenizers' tokens, cut at white-space anchors.

Every text is encoded whole by a byte-level BPE (A, of a space and the text)
and by a SentencePiece model (B, which adds the space itself).  Token ends are
byte offsets.  An anchor is an end that both share and behind which both next
tokens begin with a space; anchors cut a text into windows, each a pair of
token-id tuples.  What a window holds -- groups between shared ends, links
between all A and B tokens of a group, the written form -- follows from its ids
alone, so it is worked out once for each pair of tuples and remembered (up to
MEMO windows of a task).  Texts whose joined token bytes differ from the
space and the text (a model that rewrites characters) have no tokens.

On Spark a task encodes its texts in blocks of about BLOCK_BYTES and writes,
for each block, the distinct id pairs with the number of texts that hold them,
and for each text the pairs it holds (places in the block's list) and how
often.  These lists are cut into rows of PART entries at most, and the rows are
written in small row groups, so no writer, reader or exchange on the JVM holds a
block at once.  Pair counts are sums over blocks, so a pair found in every text costs
one row a block; the best count of each A id is a window over distinct pairs.
Counts go back to the blocks by one join on the pair, and a co-group by block
works out the texts' sums.  Models go to tasks as bytes, whose size is fixed by
their vocabularies.

Edge cases: null and empty texts, and texts whose bytes differ, have zeros and
an empty ``groups_sha256``; strings of special tokens are plain text; a repeated
row counts as a document of its own; ids may be null; extra columns are
ignored; an empty table gives an empty result.  A group without shared ends is
never cut, however long; its links are counted by distinct id pairs.
"""

from __future__ import annotations

import hashlib
import json
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import materialize
from .words import chunks

BLOCK_BYTES = 2 << 20
#: entries of a list in a row of a block
PART = 12_000
#: bytes of a row group of such rows
ROW_GROUP = 4 << 20
MEMO = 200_000
MEMO_BYTES = 64 << 20
#: links of a group that are crossed in place; larger groups go by distinct ids
LARGE = 4096
MARK = "▁"


def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable ones for themselves, the others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(other)}


# Fixed value: how byte-level BPE splits a text before its merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: white space runs from this length on are left to the slower library
LONG_SPACE = re.compile(r"\s{10000}")


class ByteLevel:
    """Encoder A, from the text of a ``tokenizers`` file.

    Where the file's merges stand in the order of their ids, with the usual
    split, its vocabulary is a rank file, and ``tiktoken`` gives the same ids in
    a sixth of the time (the tests compare both on every character); its
    splitting overflows on very long white space, which ``tokenizers`` encodes,
    as it does every text of any other file.
    """

    def __init__(self, text: str):
        self.text = text
        file = json.loads(text)
        byte = _byte_of_char()
        vocab = file["model"]["vocab"] | {x["content"]: x["id"] for x in file["added_tokens"]}
        self.bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            known = all(c in byte for c in token)
            self.bytes[i] = bytes(byte[c] for c in token) if known else token.encode()
        self.ranks = self._ranks(file)

    @cached_property
    def model(self):
        """Made when a text needs it: beside the ranks most tasks don't."""
        from tokenizers import Tokenizer

        model = Tokenizer.from_str(self.text)
        model.encode_special_tokens = True
        return model

    def _ranks(self, file):
        split, model = file["pre_tokenizer"] or {}, file["model"]
        merges = ["".join(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
        plain = (split.get("type") == "ByteLevel" and split.get("use_regex") and not split.get("add_prefix_space")
                 and not file["normalizer"] and not model["dropout"] and not model["continuing_subword_prefix"]
                 and not model["end_of_word_suffix"] and len(model["vocab"]) == 256 + len(merges)
                 and all(model["vocab"][m] == 256 + i for i, m in enumerate(merges)))
        if not plain:
            return None
        import tiktoken

        ranks = {self.bytes[i]: i for i in model["vocab"].values()}
        return tiktoken.Encoding("ranks", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> list[int]:
        if self.ranks is None or (len(text) >= 10000 and LONG_SPACE.search(text)):
            return self.model.encode(" " + text, add_special_tokens=False).ids
        return self.ranks.encode_ordinary(" " + text)


class Pieces:
    """Encoder B, from the bytes of a SentencePiece model."""

    def __init__(self, proto: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.bytes = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.bytes.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i)
                              else piece.replace(MARK, " ").encode())

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


def big_pairs(left, right) -> tuple[np.ndarray, np.ndarray]:
    """Id pairs of one large group and how often each is linked, by distinct ids."""
    x, m = np.unique(left, return_counts=True)
    y, n = np.unique(right, return_counts=True)
    return ((x.astype(np.int64)[:, None] << 32) | y[None, :]).ravel(), (m[:, None] * n[None, :]).ravel()


class Aligner:
    """Encodes texts and aligns their windows, remembering windows by their ids."""

    def __init__(self, byte_level: str, pieces: bytes, memo: int = MEMO):
        self.sides = (ByteLevel(byte_level), Pieces(pieces))
        self.width = [np.array([len(x) for x in s.bytes], dtype=np.int64) for s in self.sides]
        self.spaced = [np.array([x[:1] == b" " for x in s.bytes]) for s in self.sides]
        #: decimal ids with what may follow: the next token of the side, the other side, the next group, nothing
        self.written = [f"{i}{sign}" for i in range(max(map(len, self.width))) for sign in (",", "|", ";", "")]
        self.limit = memo
        self._forget()

    def _forget(self):
        self.number: dict[bytes, int] = {}
        self.text: list[bytes] = []
        self.groups = np.zeros(0, np.int64)
        #: linked pairs of window i, and how often: places first[i] to first[i + 1]
        self.first = np.zeros(1, np.int64)
        self.pairs = np.zeros(0, np.int64)
        self.times = np.zeros(0, np.int64)

    def tokens(self, text: str | None):
        """Ids of both sides, None where the text has no tokens."""
        if not text:
            return None
        whole = b" " + text.encode()
        out = []
        for side in self.sides:
            ids = side.encode(text)
            if b"".join([side.bytes[i] for i in ids]) != whole:
                return None
            out.append(np.array(ids, dtype=np.int32))
        return out

    def windows(self, a: np.ndarray, b: np.ndarray) -> list[bytes]:
        """The windows of a text as ``a ids, -1, b ids`` in bytes."""
        end_a, end_b = np.cumsum(self.width[0][a]), np.cumsum(self.width[1][b])
        open_a = np.flatnonzero(self.spaced[0][a[1:]])  # tokens before a space-marked one
        open_b = np.flatnonzero(self.spaced[1][b[1:]])
        _, i, j = np.intersect1d(end_a[open_a], end_b[open_b], assume_unique=True, return_indices=True)
        cut_a = np.concatenate([[0], open_a[i] + 1, [len(a)]])
        cut_b = np.concatenate([[0], open_b[j] + 1, [len(b)]])
        size = np.diff(cut_a) + np.diff(cut_b) + 1
        starts = np.concatenate([[0], np.cumsum(size)])
        flat = np.full(starts[-1], -1, dtype=np.int32)
        n = np.arange(len(size))
        flat[np.arange(len(a)) + np.repeat(starts[:-1] - cut_a[:-1], np.diff(cut_a))] = a
        shift = starts[:-1] + np.diff(cut_a) + 1 - cut_b[:-1]
        flat[np.arange(len(b)) + np.repeat(shift[n], np.diff(cut_b))] = b
        raw = flat.tobytes()
        at = (starts * 4).tolist()
        return [raw[x:y] for x, y in zip(at, at[1:])]

    def _learn(self, keys: list[bytes]) -> None:
        """Works out windows that are not remembered yet, all at once."""
        flat = np.frombuffer(b"".join(keys), dtype=np.int32)
        size = np.array([len(k) // 4 for k in keys], dtype=np.int64)
        win = np.repeat(np.arange(len(keys)), size)
        side = np.cumsum(flat < 0) - win  # a window's mark stands between its sides
        token = flat >= 0
        ids, win, side = flat[token].astype(np.int64), win[token], side[token]
        width = np.where(side == 0, self.width[0][np.where(side == 0, ids, 0)], self.width[1][np.where(side == 1, ids, 0)])
        total = np.bincount(win[side == 0], weights=width[side == 0], minlength=len(keys)).astype(np.int64)
        base = np.cumsum(total) - total
        end = np.cumsum(width) - base[win] - side * total[win]  # windows one behind the other, both sides from the same byte
        shared = np.intersect1d(end[side == 0], end[side == 1], assume_unique=True)
        group = np.searchsorted(shared, end)
        order = np.argsort(group * 2 + side, kind="stable")
        ids, win, side, group = ids[order], win[order], side[order], group[order]
        # written form: what follows a token is told by the next one
        sign = np.full(len(ids), 3)
        sign[:-1] = np.where(win[1:] != win[:-1], 3, np.where(group[1:] != group[:-1], 2, np.where(side[1:] != side[:-1], 1, 0)))
        words = list(map(self.written.__getitem__, (ids * 4 + sign).tolist()))
        bounds = np.searchsorted(win, np.arange(len(keys) + 1)).tolist()
        at = len(self.text)
        self.text += ["".join(words[x:y]).encode() for x, y in zip(bounds, bounds[1:])]
        self.number.update(zip(keys, range(at, at + len(keys))))
        start = np.searchsorted(group, np.arange(len(shared)))
        left = np.bincount(group[side == 0], minlength=len(shared))
        right = np.bincount(group[side == 1], minlength=len(shared))
        self.groups = np.concatenate([self.groups, np.bincount(win[start], minlength=len(keys))])
        # links: both sides of a group crossed, of large groups by distinct ids
        links = left * right
        small = np.flatnonzero(links <= LARGE)
        many = links[small]
        i = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        of = np.repeat(small, many)
        pair = (ids[start[of] + i // right[of]] << 32) | ids[start[of] + left[of] + i % right[of]]
        parts, counts, owner = [pair], [np.ones(len(pair), np.int64)], [win[start[of]]]
        for g in np.flatnonzero(links > LARGE).tolist():
            x, mid, y = start[g], start[g] + left[g], start[g] + left[g] + right[g]
            pair, n = big_pairs(ids[x:mid], ids[mid:y])
            parts.append(pair)
            counts.append(n)
            owner.append(np.full(len(pair), win[x]))
        pair, n, owner = np.concatenate(parts), np.concatenate(counts), np.concatenate(owner)
        order = np.lexsort((pair, owner))
        pair, n, owner = pair[order], n[order], owner[order]
        head = np.flatnonzero(np.concatenate([[True], (pair[1:] != pair[:-1]) | (owner[1:] != owner[:-1])]))
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.bincount(owner[head], minlength=len(keys)))])
        self.pairs = np.concatenate([self.pairs, pair[head]])
        self.times = np.concatenate([self.times, np.add.reduceat(n, head)])

    def block(self, texts) -> dict:
        """A block's row: statistics of its texts, its distinct pairs with the
        number of texts that hold each, and per text the places of its pairs."""
        if len(self.text) > self.limit or 16 * len(self.pairs) > MEMO_BYTES:
            self._forget()
        both = [self.tokens(t) for t in texts]
        windows = [self.windows(*x) if x else [] for x in both]
        new = list({k for own in windows for k in own if k not in self.number})
        if new:
            self._learn(new)
        own = [list(map(self.number.__getitem__, x)) for x in windows]
        sha = [hashlib.sha256(b";".join(map(self.text.__getitem__, x))).hexdigest() if x else "" for x in own]
        n_texts = len(texts)
        count = np.array([len(x) for x in own], dtype=np.int64)
        owner = np.repeat(np.arange(n_texts), count)
        number = np.fromiter((i for x in own for i in x), np.int64, count.sum())
        # one entry for each text and window, then for each text and pair
        most = max(len(self.text), 1)
        key, often = np.unique(owner * most + number, return_counts=True)
        holder, number_of = key // most, key % most
        many = self.first[number_of + 1] - self.first[number_of]
        at = np.arange(many.sum()) + np.repeat(self.first[number_of] - np.cumsum(many) + many, many)
        pairs, place = np.unique(self.pairs[at], return_inverse=True)
        most = max(len(pairs), 1)
        key = np.repeat(holder, many) * most + place
        order = np.argsort(key, kind="stable")
        key, value = key[order], (self.times[at] * np.repeat(often, many))[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        links = np.add.reduceat(value, head) if len(head) else np.zeros(0, np.int64)
        text_of, places = key[head] // most, key[head] % most
        per_text = lambda x, of: np.bincount(of, weights=x, minlength=n_texts).astype(np.int64)
        return {"n_a": [len(x[0]) if x else 0 for x in both], "n_b": [len(x[1]) if x else 0 for x in both],
                "n_groups": per_text(self.groups[number], owner), "n_links": per_text(links, text_of),
                "groups_sha256": sha, "pairs": pairs, "holders": np.bincount(places, minlength=len(pairs)),
                "size": np.bincount(text_of, minlength=n_texts), "places": places, "links": links}


_STATS = ("n_a", "n_b", "n_groups", "n_links")
_LISTS = [("doc_id", pa.int64()), *((c, pa.int64()) for c in _STATS), ("groups_sha256", pa.string()),
          ("pairs", pa.int64()), ("holders", pa.int32()), ("size", pa.int32()), ("places", pa.int32()),
          ("links", pa.int64())]
_BLOCK = "block long, part int, " + ", ".join(f"{c} array<{'string' if t == pa.string() else 'long' if t == pa.int64() else 'int'}>"
                                    for c, t in _LISTS)


def _rows(number: int, block: dict, most: int = PART):
    """The rows of a block: each list in the same number of slices, in order."""
    lists = [(block[c] if c == "doc_id" else pa.array(block[c], kind)).cast(kind) for c, kind in _LISTS]
    parts = max(1, -(-max(map(len, lists)) // most))
    for part in range(parts):
        columns = [pa.array([number]), pa.array([part], pa.int32())]
        for values in lists:
            start, end = (x * len(values) // parts for x in (part, part + 1))
            columns.append(pa.ListArray.from_arrays(pa.array([0, end - start], pa.int32()), values.slice(start, end - start)))
        yield pa.RecordBatch.from_arrays(columns, names=["block", "part", *(c for c, _ in _LISTS)])


def _blocks(byte_level, pieces):
    def task(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        aligner = Aligner(byte_level.value, pieces.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for some in chunks(batch, size=BLOCK_BYTES):
                row = aligner.block(some.column(1).to_pylist()) | {"doc_id": some.column(0)}
                yield from _rows(number, row)
                number += 1
    return task


_RESULT = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, "
           "groups_sha256 string")


def _scored(blocks: pa.Table, counts: pa.Table) -> pa.Table:
    """Sums of a block's texts, from the corpus-wide counts of its pairs."""
    order = np.argsort(blocks.column("part").to_numpy())
    own = {c: blocks.column(c).combine_chunks().take(pa.array(order)).flatten() for c, _ in _LISTS if c != "holders"}
    pairs = own["pairs"].to_numpy()
    place = np.searchsorted(pairs, counts.column("pair").to_numpy())
    count, best = np.zeros(len(pairs), np.int64), np.zeros(len(pairs), bool)
    count[place] = counts.column("count").to_numpy()
    best[place] = counts.column("best").to_numpy(zero_copy_only=False)
    size, places, links = (own[c].to_numpy() for c in ("size", "places", "links"))
    total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], np.cumsum(size)])])
    return pa.table({"doc_id": own["doc_id"], **{c: own[c] for c in _STATS},
                     "n_best": total(links * best[places]), "count_sum": total(links * count[places]),
                     "groups_sha256": own["groups_sha256"]})


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, count, best): the texts that hold each linked id pair, and whether
    no pair of its A id is in more."""
    one = (blocks.select(F.explode(F.arrays_zip("pairs", "holders")).alias("p"))
           .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.holders").alias("count")))
    top = F.max("count").over(Window.partitionBy(F.shiftright("pair", 32)))
    return one.withColumn("best", F.col("count") == top)


def align(docs: DataFrame, byte_level_path: str, piece_path: str) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups,
    n_links, n_best, count_sum, groups_sha256.  Both files are read on the driver."""
    with open(byte_level_path, encoding="utf-8") as f:
        byte_level = json.dumps(json.load(f), ensure_ascii=False)
    with open(piece_path, "rb") as f:
        pieces = f.read()
    context = docs.sparkSession.sparkContext
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = materialize(rows.mapInArrow(_blocks(context.broadcast(byte_level), context.broadcast(pieces)), _BLOCK),
                         "aligned-blocks", ROW_GROUP)
    counted = (blocks.select(F.col("block").alias("of"), F.explode("pairs").alias("pair"))
               .join(pair_counts(blocks), "pair").select("of", "pair", "count", "best"))
    held = blocks.select("block", "part", "doc_id", *_STATS, "groups_sha256", "pairs", "size", "places", "links")
    return held.groupBy("block").cogroup(counted.groupBy("of")).applyInArrow(_scored, _RESULT)
