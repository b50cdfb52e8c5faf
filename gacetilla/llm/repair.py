"""Conversation structure repair as lightest derivations.

A conversation is well formed when the initials of its roles spell
``(s?(ua)+)?``, a language of four states.  An item (i, q) says that the rows
before row i have been edited so that the automaton stands in q; a deduction
joins an item with an edit of the next row (an axiom of that row), or with an
insertion, and gives the next item.  Weights are (cost, audit) pairs: costs
add, audits (the initials of the edits) are put end to end.  Both only grow, and
a lighter premise never gives a heavier conclusion, so Knuth's agenda may
finalise the lightest item each time; the first goal item popped is the
lightest derivation, with the ASCII-least audit among the cheapest.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for blank
and duplicate rows), Insert an empty user or assistant row 5; a truncated row
that is not deleted adds 5.

On Spark: rows are sorted by conversation and turn over ranges of keys, so a
long conversation lies in several tasks.  A conversation that begins and ends
inside a task, with at most SEGMENT_ROWS rows, is repaired there; results are
remembered by the sequence of initials and faults.  Others are cut into
segments: for every pair of states a task derives the lightest span of its
segment, the spans of a conversation are joined by the same agenda (one short
row a segment, no texts), and then each segment is written out by its part of
the audit.  Only the digest of a conversation's repaired text, which is
sequential by definition, streams through one task, segment by segment.

Edge cases: null roles and texts count as one space; a null conversation id is
a conversation; null turns come first.  Rows of one turn are ordered by role,
then text.  A role with another initial, or an empty one, cannot be kept.
Repeated rows are duplicates.  Extra columns are ignored; an empty table gives
an empty result; a conversation whose rows are all gone has zeros, an empty
audit and the digest of the empty text.
"""

from __future__ import annotations

import hashlib
import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize

SEGMENT_ROWS = 2048
SEGMENT_BYTES = 4 << 20
MEMO = 200_000

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: the automaton of (s?(ua)+)?: states by initial, and the states that may end
MOVES = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
#: the role that an inserted or renamed row takes in each state, and where it leads
ADDED = tuple(("assistant", 3) if "a" in m else ("user", 2) for m in MOVES)
LEGAL_PAIRS = {"su", "ua", "au"}


def _edits(initial: str, fault: str):
    """Axioms of a row: for each state the (next state, cost, letter) of its edits."""
    more = TRUNCATED if fault == "t" else 0
    out = []
    for q in range(4):
        own = [(q, DELETE, "D")]
        if fault not in "bd":
            if initial in MOVES[q]:
                own.append((MOVES[q][initial], KEEP + more, "K"))
            own.append((ADDED[q][1], REROLE + more, "R"))
        out.append(own)
    return out


def row_axioms():
    return {(c, f): _edits(c, f) for c in ("s", "u", "a", "") for f in "-bdt"}


def lightest(axioms, start: int, goals=ENDS, insert: bool = True, one: bool = True):
    """Knuth's agenda over items (i, q).  ``axioms[i][q]`` lists what may join
    an item at i in state q.  Gives {state: (cost, audit, item before, letters)}
    of the goal items (len(axioms), state), with ``one`` only that of the
    lightest, and the same of every item finalised."""
    n = len(axioms)
    final: dict = {}
    found: dict = {}
    agenda = [(0, "", 0, start, (), "")]
    while agenda:
        cost, audit, i, q, before, letters = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q] = (cost, audit, before, letters)
        if i == n and q in goals:
            found[q] = final[i, q]
            if one or len(found) == len(goals):
                break
        if insert and (i, ADDED[q][1]) not in final:
            heapq.heappush(agenda, (cost + INSERT, audit + "I", i, ADDED[q][1], (i, q), "I"))
        if i < n:
            for r, more, letters in axioms[i][q]:
                if (i + 1, r) not in final:
                    heapq.heappush(agenda, (cost + more, audit + letters, i + 1, r, (i, q), letters))
    return found, final


def written(audit: str, state: int, roles, texts):
    """(lines ``role:text`` of the repaired rows, state after them)."""
    out, at = [], 0
    for letter in audit:
        if letter == "I":
            role, state = ADDED[state]
            out.append(role + ":")
            continue
        if letter == "K":
            state = MOVES[state][roles[at][:1]]
            out.append(f"{roles[at]}:{texts[at]}")
        elif letter == "R":
            role, state = ADDED[state]
            out.append(f"{role}:{texts[at]}")
        at += 1
    return out, state


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text, live) after damage by the checksum of
    ``conv_id:turn`` modulo 20: 0 drops the row (it stays with ``live`` false, so
    that its conversation is known), 1 empties the text, 2 removes its ``[.!?]``,
    3 repeats the row, 4 makes the role user."""
    named = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    kind = F.crc32(F.concat(named[0], F.lit(":"), named[1])) % 20
    live = kind != 0
    text = F.when(kind == 1, "").when(kind == 2, F.translate(named[3], ".!?", "")).otherwise(named[3])
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.when(live, F.when(kind == 4, "user").otherwise(named[2])).otherwise("").alias("role"),
        F.when(live, text).otherwise("").alias("text"), live.alias("live"),
        F.when(kind == 3, 2).otherwise(1).alias("copies"))
    return rows.select("*", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "col")


def _flagged(rows: DataFrame) -> DataFrame:
    """Sorted rows with their first fault: (b)lank, (d)uplicate of another turn,
    (t)runcated or none.  Equal rows of one turn are told in the sorted task."""
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    name = F.unhex(F.sha2(F.concat(F.char_length("role"), F.lit(":"), F.col("role"), F.col("text")), 256))
    rows = rows.withColumn("name", name)
    # first turns of what is said in more than one turn: least and greatest combine in the scan's tasks
    first = (rows.where("live").groupBy(F.col("conv_id").alias("__conv"), F.col("name").alias("__name"))
             .agg(F.min(turn).alias("least"), F.max(turn).alias("most")).where("least < most").drop("most"))
    seen = rows.join(first, F.col("conv_id").eqNullSafe(F.col("__conv")) & (F.col("name") == F.col("__name")), "left")
    fault = (F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "b")
             .when(F.coalesce(F.col("least") < turn, F.lit(False)), "d")
             .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "t").otherwise("-"))
    keys = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "live")]
    return (seen.select("conv_id", "turn", "role", "text", "live", fault.alias("fault"))
            .repartitionByRange(*keys).sortWithinPartitions(*keys))


_COUNTS = ("blank", "duplicate", "truncated")
_SPANS = pa.list_(pa.struct([("q", pa.int64()), ("r", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]))
_PIECE = pa.schema(
    [("conv_id", pa.int64()), ("part", pa.int64()), ("seg", pa.int64()), ("whole", pa.bool_()), ("n", pa.int64()),
     ("least", pa.int64()), ("most", pa.int64()), ("turns", pa.int64()), *((c, pa.int64()) for c in _COUNTS),
     ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("cost", pa.int64()),
     ("audit", pa.string()), ("repaired_sha256", pa.string()), ("spans", _SPANS),
     ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
_PIECE_DDL = ("conv_id long, part long, seg long, whole boolean, n long, least long, most long, turns long, "
              "blank long, duplicate long, truncated long, illegal long, first string, last string, cost long, "
              "audit string, repaired_sha256 string, spans array<struct<q:long,r:long,cost:long,audit:string>>, "
              "roles array<string>, texts array<string>")
_CHOICE = "conv_id long, part long, seg long, start long, audit string"
_TOTALS = ["conv_id", "gaps", *_COUNTS, "illegal", "cost", "audit", "repaired_sha256"]


class _Piece:
    """Rows of one conversation that a task holds."""

    def __init__(self, conv, opened):
        self.conv, self.opened = conv, opened  # opened: it may have begun in an earlier task or segment
        self.roles, self.texts, self.faults, self.bytes = [], [], [], 0
        self.least = self.most = None
        self.turns = 0

    def add(self, turn, role, text, fault):
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault)
        self.bytes += len(role) + len(text)
        if turn is not None:
            if self.least is None:
                self.least = turn
            self.turns += turn != self.most
            self.most = turn

    def full(self):
        return len(self.roles) >= SEGMENT_ROWS or self.bytes >= SEGMENT_BYTES

    def row(self, ended, axioms, memo):
        """The piece as a row of _PIECE; a whole conversation comes repaired, a
        segment with its spans and texts."""
        initials = [r[:1] for r in self.roles]
        shape = tuple((c if c in ("s", "u", "a") else "", f) for c, f in zip(initials, self.faults))
        out = dict.fromkeys(_PIECE.names)
        out.update(conv_id=self.conv, whole=ended and not self.opened, n=len(shape), least=self.least,
                   most=self.most, turns=self.turns, blank=self.faults.count("b"),
                   duplicate=self.faults.count("d"), truncated=self.faults.count("t"),
                   illegal=sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
                   first=initials[0] if initials else None, last=initials[-1] if initials else None)
        steps = [axioms[x] for x in shape]
        if out["whole"]:
            if shape not in memo:
                if len(memo) >= MEMO:
                    memo.clear()
                memo[shape] = min(lightest(steps, 0)[0].values())[:2]
            out["cost"], out["audit"] = memo[shape]
            lines, _ = written(out["audit"], 0, self.roles, self.texts)
            out["repaired_sha256"] = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        else:
            out["spans"] = [{"q": q, "r": r, "cost": x[0], "audit": x[1]} for q in range(4)
                            for r, x in lightest(steps, q, goals=range(4), one=False)[0].items()]
            out["roles"], out["texts"] = self.roles, self.texts
        return out


def _pieces(batches):
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    axioms, memo = row_axioms(), {}
    out: list[dict] = []
    made = 0

    def close(ended):
        nonlocal made
        out.append(piece.row(ended, axioms, memo) | {"part": part, "seg": made})
        made += 1

    piece = last = None
    for batch in batches:
        for conv, turn, role, text, live, fault in zip(*(c.to_pylist() for c in batch.columns)):
            if piece is None:
                piece = _Piece(conv, True)  # it may have begun in an earlier task
            elif conv != piece.conv:
                close(True)
                piece, last = _Piece(conv, False), None
            elif piece.full():
                close(False)
                piece = _Piece(conv, True)
            if live:
                same, last = last == (turn, role, text), (turn, role, text)
                piece.add(turn, role, text, "d" if same and fault != "b" else fault)
            if len(out) >= 500:
                yield pa.RecordBatch.from_pylist(out, schema=_PIECE)
                out.clear()
    if piece is not None:
        close(False)
    if out:
        yield pa.RecordBatch.from_pylist(out, schema=_PIECE)


def _chosen(spans: pa.Table) -> pa.Table:
    """The state in which each segment of a conversation starts and its part of
    the audit, by the lightest derivation over the segments' spans."""
    rows = sorted(spans.to_pylist(), key=lambda r: (r["part"], r["seg"]))
    axioms = []
    for r in rows:
        own: list[list] = [[], [], [], []]
        for s in r["spans"]:
            own[s["q"]].append((s["r"], s["cost"], s["audit"]))
        axioms.append(own)
    found, final = lightest(axioms, 0, insert=False)
    *_, before, letters = min(found.values())
    for r in reversed(rows):
        r["start"], r["audit"] = before[1], letters
        *_, before, letters = final[before]
    return pa.Table.from_pylist(rows, schema=pa.schema(
        [("conv_id", pa.int64()), ("part", pa.int64()), ("seg", pa.int64()), ("start", pa.int64()), ("audit", pa.string())]))


def _repaired(batches):
    """Segments with their choices to (lines, cost) of each."""
    for batch in batches:
        costs, lines = [], []
        for r in batch.to_pylist():
            own, _ = written(r["audit"], r["start"], r["roles"], r["texts"])
            lines.append("\n".join(own) if own else None)
            costs.append(sum(s["cost"] for s in r["spans"] if s["q"] == r["start"] and s["audit"] == r["audit"]))
        narrow = batch.select([c for c in _PIECE.names if c not in ("whole", "cost", "repaired_sha256", "spans", "roles", "texts")])
        yield pa.RecordBatch.from_arrays([*narrow.columns, pa.array(costs, pa.int64()), pa.array(lines, pa.string())],
                                         names=[*narrow.schema.names, "cost", "lines"])


_DONE = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in (*_COUNTS, "illegal", "cost")),
                   ("audit", pa.string()), ("repaired_sha256", pa.string())])
_DONE_DDL = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
             "audit string, repaired_sha256 string")


def _totals(batches):
    """Segments in order to one row a conversation; only its counts and its digest are held."""
    total = None

    def done():
        out = {c: total[c] for c in (*_COUNTS, "illegal", "cost", "conv_id")}
        out["gaps"] = total["most"] - total["least"] + 1 - total["turns"] if total["least"] is not None else 0
        out["audit"] = "".join(total["audit"])
        out["repaired_sha256"] = total["digest"].hexdigest()
        return pa.RecordBatch.from_pylist([out], schema=_DONE)

    for batch in batches:
        for r in batch.to_pylist():
            if total is None or total["conv_id"] != r["conv_id"]:
                if total is not None:
                    yield done()
                total = dict.fromkeys((*_COUNTS, "illegal", "cost", "turns"), 0) | {
                    "conv_id": r["conv_id"], "least": None, "most": None, "last": None, "audit": [],
                    "digest": hashlib.sha256(), "any": False}
            for c in (*_COUNTS, "illegal", "cost", "turns"):
                total[c] += r[c]
            if r["least"] is not None:
                total["turns"] -= r["least"] == total["most"]
                total["least"] = r["least"] if total["least"] is None else total["least"]
                total["most"] = r["most"]
            if r["n"]:
                total["illegal"] += total["last"] is not None and total["last"] + r["first"] not in LEGAL_PAIRS
                total["last"] = r["last"]
            total["audit"].append(r["audit"])
            if r["lines"] is not None:
                total["digest"].update(("\n" if total["any"] else "").encode() + r["lines"].encode())
                total["any"] = True
    if total is not None:
        yield done()


def repair(rows: DataFrame) -> DataFrame:
    """A row per conversation of ``rows`` (conv_id, turn, role, text and, where
    given, live: false for rows that only name their conversation): conv_id,
    gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    live = F.col("live") if "live" in rows.columns else F.lit(True)
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                       *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")),
                       F.coalesce(live, F.lit(True)).alias("live"))
    pieces = materialize(_flagged(rows).mapInArrow(_pieces, _PIECE_DDL), "pieces")
    gaps = F.coalesce(F.col("most") - F.col("least") + 1 - F.col("turns"), F.lit(0)).cast("long")
    whole = pieces.where("whole").withColumn("gaps", gaps).select(*_TOTALS)
    segments = pieces.where("not whole")
    chosen = (segments.select("conv_id", "part", "seg", "spans").groupBy("conv_id")
              .applyInArrow(_chosen, _CHOICE).drop("conv_id"))
    kept = [c for c in _PIECE.names if c not in ("whole", "cost", "audit", "repaired_sha256")]
    long = (segments.select(*kept).join(chosen, ["part", "seg"]).select(*_PIECE_INPUT)
            .mapInArrow(_repaired, _LINES_DDL)
            .repartition("conv_id").sortWithinPartitions("conv_id", "part", "seg")
            .mapInArrow(_totals, _DONE_DDL))
    return whole.unionByName(long)


_PIECE_INPUT = ["conv_id", "part", "seg", "n", "least", "most", "turns", *_COUNTS, "illegal", "first", "last", "audit",
                "spans", "roles", "texts", "start"]
_LINES_DDL = ("conv_id long, part long, seg long, n long, least long, most long, turns long, blank long, "
              "duplicate long, truncated long, illegal long, first string, last string, audit string, cost long, lines string")
