"""Fuzzy lexicon match (J1) and Sørensen–Dice similarity.

Similarity of two words, as the ranking defines it:

* white space is removed from both words first;
* equal words score 1;
* a word shorter than 2 length units scores 0;
* otherwise ``2 * |bigrams(a) ∩ bigrams(b)| / (len(a) + len(b) - 2)``, where
  bigrams are consecutive character pairs counted as a multiset, and
  ``len`` is the UTF-8 byte length (``length_unit="byte"``, the default,
  what the ranking's similarity routine measures) or the character length
  (``length_unit="char"``).

The match is a *theta* join (token ~ root).  It is evaluated per **distinct**
token as a prefix-filtered set join:

1. distinct tokens (map-side partial distinct, so a hot word costs one row
   per map task, never one row per occurrence);
2. each word's bigrams as a set of elements (the n-th repetition of a bigram is
   an element of its own), ordered by the number of roots that hold the bigram,
   rarest first; bigrams that no root holds come before all others.  The numbers
   are powers of two by hash of the bigram, a table of fixed size that every
   task has, so a word's elements are put in order inside its row;
3. a pair that reaches the threshold shares at least
   ``threshold / (2 - threshold) * (len - 1)`` elements, seen from either
   word, so of the first elements beyond that many and COMBINED - 1 more it
   shares COMBINED: pairs meet at such combinations.  A word that may miss many
   elements has many combinations, so pairs with a longer word meet at single
   elements.  Most tokens have no prefix element that a root holds, and leave
   there;
4. a candidate is kept at the first key that both words share, and only if the
   lengths and what is left behind that key's first element can still reach the
   threshold; then the sets are intersected, inside the row.

Equal words (after white-space removal) are a join of their own; a
one-character word, which has no bigrams, matches only so.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip_whitespace
from ..session import materialize
from .alike import alike_pairs

DICE_THRESHOLD = 0.75
#: elements of a key, for words of which at most so many elements may be missing
COMBINED = 4
MISSING = 2
#: slots of the table of bigram frequencies
SLOT_BITS = 14


def _unit_length(c: Column, length_unit: str) -> Column:
    if length_unit == "byte":
        return F.octet_length(c)
    if length_unit == "char":
        return F.length(c)
    raise ValueError(f"length_unit must be 'byte' or 'char', not {length_unit!r}")


BIGRAMS_PATTERN = "(?s)(?=(..))"  # every overlapping pair of characters


def _words(df: DataFrame, word: str, prefix: str, length_unit: str) -> DataFrame:
    """(word, norm, len, n): distinct normalised words, their length in units
    and their number of bigrams."""
    n = f"{prefix}_norm"
    return (df.select(F.col(word).alias(prefix)).where(F.col(prefix).isNotNull()).distinct()
              .withColumn(n, strip_whitespace(prefix)).where(F.col(n) != "")
              .withColumn(f"{prefix}_len", _unit_length(F.col(n), length_unit))
              .withColumn(f"{prefix}_n", F.length(n) - 1))


def _bigrams(words: DataFrame, prefix: str) -> Column:
    return F.regexp_extract_all(F.col(f"{prefix}_norm"), F.lit(BIGRAMS_PATTERN), 1)


def frequencies(words: DataFrame, prefix: str) -> bytes:
    """A byte for each slot of bigrams: 0 when no word holds one of them, else the
    power of two of the words that do, and one more.  A fixed size, whatever the
    words; the classes only shape the order of the elements."""
    grams = words.select(F.explode(F.array_distinct(_bigrams(words, prefix))).alias("gram"))
    rows = grams.groupBy(_slot(F.col("gram")).alias("slot")).agg(F.count(F.lit(1)).alias("held")).toArrow()
    out = bytearray(1 << SLOT_BITS)
    for slot, held in zip(rows["slot"].to_pylist(), rows["held"].to_pylist()):
        out[slot] = held.bit_length()
    return bytes(out)


def _slot(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(1 << SLOT_BITS)).cast("int")


def _numbered(grams: Column) -> Column:
    """A word's bigrams, the n-th repetition of one with its number."""
    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        return _bind(starts, lambda at: F.flatten(F.transform(at, lambda first, k: F.transform(
            F.sequence(F.lit(1), F.coalesce(F.get(at, k + 1), F.size(s)) - first),
            lambda time: F.when(time == 1, F.get(s, first)).otherwise(F.concat(F.get(s, first), time.cast("string")))))))
    return _bind(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), g)
                 .otherwise(_bind(F.sort_array(g), runs)))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _key(*elements) -> Column:
    return F.struct(F.xxhash64(*[x.e for x in elements]).alias("key"), elements[0]["at"].alias("at"))


def _combinations(p: Column, left: int, start=1, head=()) -> Column:
    """Keys of all choices of ``left`` elements of an array, each in its order, with
    the place of the first."""
    rest = F.slice(p, start, F.size(p))
    if left == 1:
        return F.transform(rest, lambda x: _key(*head, x))
    return F.flatten(F.transform(rest, lambda x, i: _combinations(p, left - 1, i + start + 1, (*head, x))))


def _elements(words: DataFrame, prefix: str, classes: bytes, threshold: float) -> DataFrame:
    """Words of two characters or more with ``set``, their elements rarest
    first, and ``keys``, a row for each: hashes of elements (of COMBINED ones for
    short words) that a similar word has too, as far as some root may hold them,
    with the ``at`` of the key's first element.  All of it is worked out inside the row."""
    unit, n = F.col(f"{prefix}_len") - 1, F.col(f"{prefix}_n")
    of = lambda e: F.substring(F.lit(classes), _slot(F.substring(e, 1, 2)) + 1, 1)
    ordered = F.sort_array(F.transform(_numbered(_bigrams(words, prefix)), lambda e: F.struct(of(e).alias("held"), e.alias("e"))))
    ordered = F.transform(ordered, lambda x, i: F.struct(x.held, x.e, (i + 1).alias("at")))
    # a little less than the bound, for the rounding of the product
    share = threshold / (2 - threshold)
    missing = n - F.greatest(F.ceil(F.lit(share) * unit - 1e-9), F.lit(1))
    # elements that all words have, behind the others: a word of one element has a key too
    pads = F.array(*[F.struct(F.lit(b"\xff").alias("held"), F.lit(str(i)).alias("e"), F.lit(0).alias("at")) for i in range(1, COMBINED)])

    def first(o, size) -> Column:
        return F.filter(F.slice(o, 1, F.greatest(missing + size, F.lit(0)).cast("int")), lambda x: x.held != F.lit(b"\0"))

    # words up to ``most`` meet at combinations, a longer one and those it can be similar to at elements
    most = MISSING / (1 - share) if share < 1 else float("inf")
    none = F.array().cast("array<struct<key:bigint,at:int>>")
    combined = F.when(unit <= most, _bind(first(F.concat("o", pads), COMBINED), lambda p: _combinations(p, COMBINED))).otherwise(none)
    single = F.when(unit > share * most - 1e-9, F.transform(first(F.col("o"), 1), lambda x: _key(x))).otherwise(none)
    # outer, and arrays that are never null: else Spark tests the arrays by filters
    # below the distinct words, so they would be worked out for every occurrence
    never = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return (words.where(n >= 1).select("*", ordered.alias("o"))
            .select(*words.columns, never(F.transform("o", lambda x: x.e), "array<string>").alias(f"{prefix}_set"), F.concat(combined, single).alias("k"))
            .select(*words.columns, f"{prefix}_set", never(F.col("k.key"), "array<bigint>").alias(f"{prefix}_keys"), F.inline_outer("k"))
            .where("key is not null").withColumnRenamed("at", f"{prefix}_at"))


def dice_candidates(tokens: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """Pairs of different words that share a key and pass the length and position
    filters, each once, with both element sets.  ``tokens`` and ``roots`` are ``_words`` with
    prefixes ``token`` and ``root``."""
    threshold = min(threshold, 1.0)  # nothing but equal words scores more
    classes = frequencies(roots, "root")
    # written once, so Spark knows its bytes and broadcasts it while it is small
    right = materialize(_elements(roots, "root", classes, threshold), "lexicon-prefixes")
    left = _elements(tokens, "token", classes, threshold)
    # the first shared key starts with the first shared element
    most = 1 + F.least(*[F.col(f"{p}_n") - F.col(f"{p}_at") for p in ("token", "root")])
    need = F.lit(float(threshold)) * (F.col("token_len") + F.col("root_len") - 2)
    return left.join(right, "key").where(
        (2.0 * most >= need - 1e-9) & (F.col("token_norm") != F.col("root_norm"))
        & (F.get(F.array_intersect("token_keys", "root_keys"), F.lit(0)) == F.col("key"))).drop("key", "token_at", "root_at")


def dice_pairs(tokens: DataFrame, lexicon: DataFrame, token_col: str = "token",
               root_col: str = "root", threshold: float = DICE_THRESHOLD,
               length_unit: str = "byte") -> DataFrame:
    """All (token, root) pairs with similarity >= threshold.

    Output: token, root, inter (shared bigrams), denom (len_t + len_r - 2),
    dice (double; 1.0 for words equal after white-space removal).
    ``tokens`` may hold duplicates; they are made distinct first.  A table that is
    its own lexicon (the same DataFrame and column) is matched by ``alike``.
    """
    if not threshold > 0:
        raise ValueError("threshold must be > 0")
    need = F.lit(float(threshold))
    # written once: both joins read it, and none of them makes words distinct beside its own work
    toks = materialize(_words(tokens, token_col, "token", length_unit), "distinct-words")
    own = lexicon is tokens and root_col == token_col
    roots = toks.toDF(*[c.replace("token", "root") for c in toks.columns]) if own else _words(lexicon, root_col, "root", length_unit)
    denom = (F.col("token_len") + F.col("root_len") - 2).cast("long")
    if own:
        near = alike_pairs(toks.where("token_n >= 1").select("token", F.col("token_norm").alias("norm")), threshold, length_unit)
    else:
        near = (dice_candidates(toks, roots, threshold)
                .withColumn("inter", F.size(F.array_intersect("token_set", "root_set")).cast("long"))
                .select("token", "root", "inter", denom.alias("denom"),
                        F.when((F.col("token_len") < 2) | (F.col("root_len") < 2), F.lit(0.0))
                         .otherwise(2.0 * F.col("inter") / denom).alias("dice")))
    equal = (toks.join(roots, F.col("token_norm") == F.col("root_norm"))
             .select("token", "root", F.col("token_n").cast("long").alias("inter"), denom.alias("denom"),
                     F.lit(1.0).alias("dice")))
    return near.unionByName(equal).where(F.col("dice") >= need)


def matched_tokens(tokens: DataFrame, lexicon: DataFrame, token_col: str = "token",
                   threshold: float = DICE_THRESHOLD, length_unit: str = "byte") -> DataFrame:
    """Distinct tokens similar to at least one root (the semi-join's right side)."""
    pairs = dice_pairs(tokens, lexicon, token_col=token_col, threshold=threshold,
                       length_unit=length_unit)
    return pairs.select("token").distinct()


def filter_matching(occurrences: DataFrame, matches: DataFrame, token_col: str = "token") -> DataFrame:
    """Keep occurrence rows whose token is in ``matches`` (left semi-join).

    The matched tokens are written once, so Spark knows their bytes when it
    plans the join: few are broadcast and the occurrences stay where they are;
    many are shuffled, with a hot token's occurrences split over tasks.
    """
    m = materialize(matches.select(F.col("token").alias(token_col)).distinct(), "matched-tokens")
    return occurrences.join(m, token_col, "left_semi")
