"""Small fixtures and plain Python versions of the operators' results."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, name string, token int, label double"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def documents(spark, texts):
    """Documents with nulls and columns whose names clash with the operators' own."""
    rows = [(i, t, None if k % 3 else "en", "src0", None if t is None else len(t), "x", None, k, 0.5)
            for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def corpus(n=60, seed=1):
    """Texts with exact and near copies, shared passages and lines, repeated words, odd characters."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 5))) for _ in range(400)]
    passage = [r.choice(words) for _ in range(70)]
    line = "the same line in many texts"
    texts = []
    for i in range(n):
        w = [r.choice(words) for _ in range(r.choice([0, 1, 3, 9, 40, 120, 300]))]
        kind = r.random()
        if kind < 0.15 and texts:
            t = r.choice(texts)[1] or ""
        elif kind < 0.35 and texts:
            w = SPACED.findall(r.choice(texts)[1] or "")
            for _ in range(1 + len(w) // 150):
                if w:
                    w[r.randrange(len(w))] = r.choice(words)
            t = " ".join(w)
        else:
            if r.random() < 0.3:
                at = r.randint(0, len(w))
                w[at:at] = passage[r.randint(0, 10):r.randint(55, 70)]
            t = " ".join(w)
            if r.random() < 0.4:
                t = t[:len(t) // 2] + "\n" + r.choice([line, "  " + line.upper() + "\t", "short", ""]) + "\n" + t[len(t) // 2:]
        texts.append((i, t))
    texts += [(900, None), (901, ""), (902, " \n\t\n "), (903, "ab " * 400), (904, "x" * 50_000),
              (905, "ÀÉ 漢字 😀 ﬁ\x00 ▁ <s>"), (None, texts[5][1]), (None, None), (7, texts[7][1])]
    return texts


def repeats(rows, window=50):
    first: dict = {}
    for i, t in rows:
        w = SPACED.findall(t or "")
        for k in range(len(w) - window + 1):
            if i is not None:
                key = tuple(w[k:k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = SPACED.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if i is not None and first[tuple(w[k:k + window])] < i:
                gone[k:k + window] = [True] * window
        out.append((i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g))))
    return out


def kept_lines(rows, min_chars=10):
    owners = defaultdict(set)
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if i is not None and len(key(line)) >= min_chars:
                owners[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(owners.get(key(x), ())) < 2 or min(owners[key(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def contamination(rows, items, window=10):
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(window, len(w))
        if i is not None and n:
            for k in range(len(w) - n + 1):
                windows[tuple(w[k:k + n])].add(str(i))
    out = []
    for i, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, met = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k:k + n]) in windows:
                    hit.update(range(k, k + n))
                    met |= windows[tuple(w[k:k + n])]
        out.append((i, len(w), len(hit), len(met), sha(",".join(sorted(met)))))
    return out


def near_copies(rows, k=4, threshold=85):
    sets = []
    for _, t in rows:
        w = SPACED.findall((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(max(len(w) - k, 0) + 1)} if w else set())
    label = list(range(len(rows)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                label[find(a)] = find(b)
    least: dict = {}
    for x, (i, _) in enumerate(rows):
        if i is not None:
            least[find(x)] = min(least.get(find(x), i), i)
    return [(i, len(sets[x]), least.get(find(x))) for x, (i, _) in enumerate(rows)]


def statistics(text):
    text = text or ""
    w = SPACED.findall(text)
    windows = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    covered = {j for i in range(len(w) - 4) if windows[tuple(w[i:i + 5])] > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(df, expected):
    got, want = rows_of(df), sorted(expected, key=repr)
    assert got == want, [x for x in zip(got, want) if x[0] != x[1]][:3]


def aligned(rows, byte_level, pieces):
    """Plain alignment of two tokenizers' tokens, texts one by one."""
    import bisect

    import sentencepiece
    from tokenizers import Tokenizer

    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    left = Tokenizer.from_file(byte_level)
    left.encode_special_tokens = True
    right = sentencepiece.SentencePieceProcessor(model_file=pieces)
    docs = []
    for i, text in rows:
        links, groups, ids = [], [], None
        if text:
            ids = left.encode(" " + text, add_special_tokens=False).ids, right.encode(text)
            raw = ([bytes(byte[c] for c in left.id_to_token(x)) for x in ids[0]],
                   [bytes([int(right.id_to_piece(x)[3:5], 16)]) if right.is_byte(x)
                    else right.id_to_piece(x).replace("▁", " ").encode() for x in ids[1]])
            if any(b"".join(r) != (" " + text).encode() for r in raw):
                ids = None
        if ids:
            ends = [[sum(map(len, r[:k + 1])) for k in range(len(r))] for r in raw]
            shared = sorted(set(ends[0]) & set(ends[1]))
            groups = [([], []) for _ in shared]
            for side in (0, 1):
                for x, e in zip(ids[side], ends[side]):
                    groups[bisect.bisect_left(shared, e)][side].append(x)
            links = [(x, y) for g in groups for x in g[0] for y in g[1]]
        docs.append((i, ids, groups, links))
    count = Counter(p for d in docs for p in set(d[3]))
    best: dict = defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for i, ids, groups, links in docs:
        if ids is None:
            out.append((i, 0, 0, 0, 0, 0, 0, ""))
            continue
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((i, len(ids[0]), len(ids[1]), len(groups), len(links), sum(count[p] == best[p[0]] for p in links),
                    sum(count[p] for p in links), sha(text)))
    return out


def damaged(rows):
    """Rows of each conversation after damage, in order, by plain Python."""
    import zlib

    out: dict = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        held.extend([(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1))
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        out.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
        seen.add((role, text))
    return out


def every_repair(rows, marks, inserts):
    """The cheapest, then ASCII-least, of all edits with at most so many
    insertions, tried one by one: (cost, audit, lines)."""
    best = None
    legal = re.compile("(s?(ua)+)?")
    todo = [(0, 0, "", "", (), 0)]
    while todo:
        at, cost, audit, initials, lines, added = todo.pop()
        if at == len(rows) and legal.fullmatch(initials):
            best = min(best or (cost, audit, lines), (cost, audit, lines))
        if added < inserts:
            todo += [(at, cost + 5, audit + "I", initials + r[0], (*lines, r + ":"), added + 1) for r in ("user", "assistant")]
        if at < len(rows):
            _, role, text = rows[at]
            todo.append((at + 1, cost + 2, audit + "D", initials, lines, added))
            if marks[at] not in "bd" and role:
                more = 5 * (marks[at] == "t")
                todo.append((at + 1, cost + more, audit + "K", initials + role[0], (*lines, f"{role}:{text}"), added))
                todo += [(at + 1, cost + more + 1, audit + "R", initials + r[0], (*lines, f"{r}:{text}"), added)
                         for r in ("user", "assistant")]
            elif marks[at] not in "bd":
                more = 5 * (marks[at] == "t")
                todo += [(at + 1, cost + more + 1, audit + "R", initials + r[0], (*lines, f"{r}:{text}"), added)
                         for r in ("user", "assistant")]
    return best


def stepwise_repair(rows, marks):
    """The same row by row, the best (cost, audit, lines) for each state."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    def offer(where, state, value):
        if state not in where or value[:2] < where[state][:2]:
            where[state] = value

    def inserted(best):
        for _ in range(4):
            for q, (cost, audit, lines) in list(best.items()):
                for name in ("user", "assistant"):
                    if name[0] in step[q]:
                        offer(best, step[q][name[0]], (cost + 5, audit + "I", (*lines, name + ":")))
        return best

    best = inserted({0: (0, "", ())})
    for (_, role, text), mark in zip(rows, marks):
        new: dict = {}
        for q, (cost, audit, lines) in best.items():
            offer(new, q, (cost + 2, audit + "D", lines))
            if mark in "bd":
                continue
            more = cost + 5 * (mark == "t")
            if role[:1] in step[q]:
                offer(new, step[q][role[:1]], (more, audit + "K", (*lines, f"{role}:{text}")))
            for name in ("user", "assistant"):
                if name[0] in step[q]:
                    offer(new, step[q][name[0]], (more + 1, audit + "R", (*lines, f"{name}:{text}")))
        best = inserted(new)
    return min(best[q] for q in (0, 3) if q in best)


def repaired(rows):
    out = []
    for conv, own in damaged(rows).items():
        marks = faults(own)
        turns = {t for t, _, _ in own if t is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        cost, audit, lines = stepwise_repair(own, marks)
        out.append((conv, gaps, *(marks.count(m) for m in "bdt"), illegal, cost, audit, sha("\n".join(lines))))
    return out


def nearest(rows, k=10, of=100):
    """Brute force over (id, vector) rows."""
    import math

    good = [(i, v) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = []
    for a, (i, v) in enumerate(good):
        if i is None or i % of:
            continue
        found = sorted((math.dist(v, w), j is None, j or 0) for b, (j, w) in enumerate(good) if a != b and len(v) == len(w))
        out += [(i, n + 1, None if none else j, round(d, 9)) for n, (d, none, j) in enumerate(found[:k])]
    return out
