r"""Quality rules as a short-circuit cascade of native column expressions.

Statistics of a whole text (words are ``[^\x20\x09-\x0D]+``, lines are split
at ``\n``) are built-in functions only.  A rule is a rejection condition over
them.  ``order_rules`` runs every rule on a bounded sample, measures its cost
(time over a job that evaluates nothing) and selectivity (share of rows that
it rejects), and sorts the rules by rejection per cost.  ``keep`` applies them
as a chain of filters in that order, ``verdict`` as one CASE that stops at the
first rejection.  The order changes the cost, never the result.

Repeated 5-word windows are found inside the row: words are hashed, windows
hashed from five word hashes, and only texts in which ``array_distinct`` finds
a repetition sort their windows by hash to mark the repeated positions.
Nothing is exploded or shuffled.

Edge cases: null and empty texts have no words, no lines and all counts 0, so
the word-count rule rejects them.  Texts with fewer than five words have no
windows.  Lines without a word never count as repeated.  Rows are judged one
by one: repeated rows give repeated results, a null ``doc_id`` stays null, an
empty table gives an empty result.  Working columns carry a prefix, and extra
columns of any other name are passed through by ``keep``.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 5
#: rows of the sample on which cost and selectivity are estimated
SAMPLE_ROWS = 1000

_SPACE = "[\\\\x20\\\\x09-\\\\x0D]+"
_P = "__qr_"


def _text(column: str = "text") -> str:
    return f"coalesce(cast(`{column}` as string), '')"


def words_sql(column: str = "text") -> str:
    return f"array_remove(split({_text(column)}, '{_SPACE}'), '')"


def lines_sql(column: str = "text") -> str:
    """Lines that have a word."""
    return f"filter(split({_text(column)}, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')"


def _chars_of(pattern: str, column: str = "text") -> str:
    """Number of ASCII characters of a class: bytes that go when they are removed."""
    return f"(octet_length({_text(column)}) - octet_length(regexp_replace({_text(column)}, '{pattern}', '')))"


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` with ``name`` bound to ``value``, which is evaluated once
    wherever the optimiser moves the expression."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def repeat_words_sql(words: str) -> str:
    """Words in windows of WINDOW words that come twice or more in ``words``."""
    k = WINDOW
    window = ", ".join(f"get(h, i + {j})" for j in range(k))
    covered = ("aggregate(transform(p, (x, j) -> "
               f"least({k}, coalesce(get(p, j + 1) - x, {k}))), 0, (a, x) -> a + x)")
    # starts of windows whose hash has an equal neighbour in sorted order
    starts = "sort_array(transform(filter(s, (x, j) -> x.v <=> get(s, j - 1).v or x.v <=> get(s, j + 1).v), x -> x.i))"
    marked = _let("s", "sort_array(transform(g, (x, i) -> named_struct('v', x, 'i', i)))", _let("p", starts, covered))
    windows = f"transform(sequence(0, size(h) - {k}), i -> xxhash64({window}))"
    found = _let("g", windows, f"if(size(g) = size(array_distinct(g)), 0, {marked})")
    return _let("h", f"transform({words}, x -> xxhash64(x))", f"if(size(h) < {k}, 0, {found})")


def _statistics(column: str = "text") -> dict[str, str]:
    """SQL of each statistic over the text alone."""
    words, lines = words_sql(column), lines_sql(column)
    return {
        "n_words": f"size({words})",
        "word_chars": f"char_length(regexp_replace({_text(column)}, '{_SPACE}', ''))",
        "n_symbols": _chars_of("[#*$%&|<>]+", column),
        "n_lines": f"size({lines})",
        "n_dup_lines": _let("l", lines, "size(l) - size(array_distinct(l))"),
        "n_repeat_words": _let("w", words, repeat_words_sql("w")),
        "n_capitals": _chars_of("[A-Z]+", column),
        "n_letters": _chars_of("[A-Za-z]+", column),
        "n_shouts": _chars_of("!+", column),
    }


#: the statistics that ``with_statistics`` adds
_COLUMNS = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def with_statistics(docs: DataFrame, column: str = "text") -> DataFrame:
    """``docs`` plus the statistics of _COLUMNS (long)."""
    w, l = _P + "w", _P + "l"
    alone = _statistics(column)
    return docs.withColumns({w: F.expr(words_sql(column)), l: F.expr(lines_sql(column))}).withColumns({
        "n_words": F.expr(f"size({w})").cast("long"),
        "word_chars": F.expr(f"char_length(array_join({w}, ''))").cast("long"),
        "n_symbols": F.expr(alone["n_symbols"]).cast("long"),
        "n_lines": F.expr(f"size({l})").cast("long"),
        "n_dup_lines": F.expr(f"size({l}) - size(array_distinct({l}))").cast("long"),
        "n_repeat_words": F.expr(repeat_words_sql(w)).cast("long"),
    }).drop(w, l)


@dataclass(frozen=True)
class Rule:
    """``rejects`` is a condition over statistics, named in braces."""
    name: str
    rejects: str

    def over(self, known=()) -> str:
        """SQL of the condition; statistics that are no column yet are worked out from the text."""
        return self.rejects.format_map({k: k if k in known else v for k, v in _statistics().items()})


def rules() -> list[Rule]:
    """The rules of the library, in no particular order."""
    return [
        Rule("few_words", "{n_words} < 10"),
        Rule("symbols", "10 * {n_symbols} > 3 * {n_words}"),
        Rule("word_length", "{word_chars} < 2 * {n_words} or {word_chars} > 15 * {n_words}"),
        Rule("repeated_lines", "10 * {n_dup_lines} > 3 * {n_lines}"),
        Rule("capitals", "2 * {n_capitals} > {n_letters}"),
        Rule("shouting", "2 * {n_shouts} > {n_words}"),
        Rule("repeated_words", "100 * {n_repeat_words} > 20 * {n_words}"),
    ]


def order_rules(sample: DataFrame, some: list[Rule]) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected), most rejection per second first.

    ``sample`` has at most SAMPLE_ROWS rows; each rule is one small job on it.
    """
    sample = sample.select("text").persist()
    try:
        n = max(sample.count(), 1)

        def run(df, condition):
            began = time.perf_counter()
            hit = df.agg(F.sum(F.expr(f"cast(coalesce({condition}, false) as int)")).alias("n")).first()["n"] or 0
            return time.perf_counter() - began, hit / n

        idle = min(run(sample, "text is null")[0] for _ in range(2))
        out = []
        for rule in some:
            seconds, share = run(sample, rule.over())
            out.append((rule, max(seconds - idle, 1e-4), share))
    finally:
        sample.unpersist()
    return sorted(out, key=lambda x: (-x[2] / x[1], x[1], x[0].name))


def _rejects(rule: Rule, known=()):
    return F.coalesce(F.expr(rule.over(known)), F.lit(False))


def cascade(docs: DataFrame, some: list[Rule] | None = None) -> list[Rule]:
    """The rules in the order that a sample of ``docs`` suggests."""
    # take() reads as few partitions as it needs; a limit would shuffle rows of all of them
    rows = docs.select(F.col("text").cast("string").alias("text")).take(SAMPLE_ROWS)
    sample = docs.sparkSession.createDataFrame(rows, "text string")
    return [r for r, _, _ in order_rules(sample, some or rules())]


def verdict(docs: DataFrame, order: list[Rule]) -> DataFrame:
    """``docs`` with statistics, base_failed and kept."""
    out = with_statistics(docs).withColumn(
        "base_failed", F.expr("n_words < 10 or 100 * n_repeat_words > 20 * n_words"))
    kept = F.when(F.col("base_failed"), F.lit(False))
    for rule in order:
        kept = kept.when(_rejects(rule, _COLUMNS), F.lit(False))
    return out.withColumn("kept", kept.otherwise(F.lit(True)))


def keep(docs: DataFrame, order: list[Rule]) -> DataFrame:
    """The rows that no rule rejects, with the columns of ``docs``."""
    out = docs
    for rule in order:
        out = out.where(~_rejects(rule))
    return out
