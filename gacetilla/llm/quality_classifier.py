"""Quality classifier: a sparse rule ensemble compiled to column expressions.

1. Statistics of whole texts are native column expressions.
2. A random forest is fitted on the statistics of a bounded sample of labelled
   rows (FIT_ROWS, chosen by the hash of the id among all rows that may be
   learnt from); every path from a root to a node is a conjunctive rule over
   statistics.
3. A lasso logistic regression weighs the rules; most weights are zero.
4. ``score`` is the logistic function of the sum of the weights of the rules
   that hold, as one Spark expression: scoring is a projection of the scan.

Rows whose crc32 of the id (as text) is divisible by 5 are held out and never
learnt from.  Labels, language, source and id are no inputs of a score.

Edge cases: null and empty texts have statistics 0 and a score like any other.
Rows without a label, or with a null label or id, are not learnt from; repeated
labels of a row count once each when they differ.  With labels of one class
alone (or none) every score is that class's share (or 0.5).  A null id is not
held out.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import materialize

#: labelled rows that the fit may see; scoring and statistics see all rows
FIT_ROWS = 20_000
TREES, DEPTH = 24, 3
LASSO = 0.001
THRESHOLD = 0.3

_T = "coalesce(cast(text as string), '')"


def _gone(pattern: str) -> str:
    """ASCII characters of a class."""
    return f"(octet_length({_T}) - octet_length(regexp_replace({_T}, '{pattern}', '')))"


#: statistics by name, over the columns of ``_counted``
STATISTICS = {
    "words": "n_words",
    "word_bytes": "(n_bytes - n_space) / greatest(n_words, 1)",
    "symbols": "n_symbols / greatest(n_words, 1)",
    "stops": "n_stops / greatest(n_words, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(n_bytes, 1)",
    "digits": "n_digits / greatest(n_bytes, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "distinct_lines": "n_lines_distinct / greatest(n_lines, 1)",
    "words_a_line": "n_words / greatest(n_lines, 1)",
}


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with a double column ``s_<name>`` for each statistic."""
    out = docs.withColumns({
        "__w": F.expr(f"array_remove(split({_T}, '[\\\\x20\\\\x09-\\\\x0D]+'), '')"),
        "__l": F.expr(f"split({_T}, '\\n')"),
        "n_bytes": F.expr(f"octet_length({_T})"),
        "n_space": F.expr(_gone("[\\\\x20\\\\x09-\\\\x0D]+")),
        "n_symbols": F.expr(_gone("[#*$%&|<>]+")), "n_stops": F.expr(_gone("[.,;:?]+")),
        "n_shouts": F.expr(_gone("!+")), "n_capitals": F.expr(_gone("[A-Z]+")), "n_digits": F.expr(_gone("[0-9]+")),
    }).withColumns({
        "n_words": F.expr("size(__w)"), "n_distinct": F.expr("size(array_distinct(__w))"),
        "n_lines": F.expr("size(__l)"), "n_lines_distinct": F.expr("size(array_distinct(__l))"),
    })
    return out.select(*[F.col(f"`{c}`") for c in docs.columns],
                      *[F.expr(e).cast("double").alias(f"s_{n}") for n, e in STATISTICS.items()])


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def tree_paths(tree: str, names: list[str]) -> list[tuple]:
    """Rules of all nodes below the root, from the tree's printed form.

    A rule is a sorted tuple of (statistic, lower bound, upper bound)."""
    out, path = [], []
    for line in tree.splitlines()[1:]:
        m = re.match(r"( *)(If|Else) \(feature (\d+) (<=|>) ([-+0-9.eE]+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth]
        path.append((depth, names[int(m[3])], m[4], float(m[5])))
        bounds: dict[str, list[float]] = {}
        for _, name, sign, value in path:
            lo_hi = bounds.setdefault(name, [-math.inf, math.inf])
            if sign == ">":
                lo_hi[0] = max(lo_hi[0], value)
            else:
                lo_hi[1] = min(lo_hi[1], value)
        out.append(tuple(sorted((n, lo, hi) for n, (lo, hi) in bounds.items())))
    return out


def rule_column(rule: tuple):
    out = F.lit(True)
    for name, lo, hi in rule:
        c = F.col(f"s_{name}")
        if lo > -math.inf:
            out = out & (c > lo)
        if hi < math.inf:
            out = out & (c <= hi)
    return out


class RuleEnsemble:
    """Weighted conjunctive rules; ``score()`` is a column over statistics."""

    def __init__(self, intercept: float, rules: list[tuple[tuple, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self):
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule_column(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    @classmethod
    def fit(cls, stats: DataFrame, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO) -> "RuleEnsemble":
        """From a small table with ``s_*`` and ``label`` (0.0 or 1.0)."""
        row = stats.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones")).first()
        n, ones = row["n"], row["ones"] or 0
        if not n or ones in (0, n):
            share = (ones + 0.5) / (n + 1)
            return cls(math.log(share / (1 - share)), [])
        names = list(STATISTICS)
        data = VectorAssembler(inputCols=[f"s_{x}" for x in names], outputCol="x").transform(stats)
        forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth,
                                        featureSubsetStrategy="onethird", seed=17).fit(data)
        rules = sorted({r for t in forest.trees for r in tree_paths(t.toDebugString, names)})
        marked = stats.select("label", *[rule_column(r).cast("double").alias(f"r{i}") for i, r in enumerate(rules)])
        data = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="x").transform(marked)
        lr = LogisticRegression(featuresCol="x", labelCol="label", elasticNetParam=1.0, regParam=lasso,
                                standardization=False, maxIter=60).fit(data.select("x", "label"))
        weights = lr.coefficients.toArray().tolist()
        return cls(float(lr.intercept), [(r, w) for r, w in zip(rules, weights) if w != 0.0])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> RuleEnsemble:
    """A model from at most about ``rows`` labelled rows that are not held out."""
    known = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("label"))
             .where("doc_id is not null and label in (0, 1)").where(~held_out()).distinct())
    n = max(known.count(), 1)
    some = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < F.lit(1_000_000 * min(1.0, rows / n)))
    # at most about FIT_ROWS rows of 16 bytes: bounded whatever the input
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(some), "doc_id")
    stats = materialize(with_statistics(texts).drop("text", "doc_id"), "statistics")
    stats = stats.coalesce(4).persist()
    try:
        return RuleEnsemble.fit(stats)
    finally:
        stats.unpersist()


def classify(docs: DataFrame, model: RuleEnsemble, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""
    stats = with_statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text")
    return stats.select("doc_id", held_out().alias("held_out"), model.score().alias("score")).select(
        "doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
