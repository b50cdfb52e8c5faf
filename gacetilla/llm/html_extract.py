"""Main text of pages by gradient-boosted trees over DOM-node features.

Nodes are the page's blocks (``dom``): their features are subtree sizes and
densities, tags, attribute tokens of the node and of those around it, depth
and sibling statistics.  Boosted trees are fitted by Spark on nodes of
TEMPLATE_PAGES labelled pages made by rule (``sample_pages``) and of at most
CORPUS_PAGES pages of the input whose semantic tags tell the main part.

Decoding is hierarchical: a dropped node drops all its descendants, a kept
node may drop any child.  Each page takes the consistent choice with the
greatest sum of log-odds, found from the leaves up and read from the root
down, so no kept block hangs in a dropped one.

The trees are small arrays in a broadcast; pages are scored in batches inside
one projection of the scan, without a shuffle.

Edge cases: null, empty and textless pages give an empty text and length 0.
Text outside any tag is judged like other loose text.  Unclosed and crossing
tags are closed as browsers mostly do; unknown tags count as inline.  Repeated
rows give repeated results, null ids and urls stay null, extra columns are
ignored, and an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .dom import FEATURES, TAG_GROUPS, TOKEN_GROUPS, features, kept_text, parse
from .sample_pages import labelled_pages
from .tables import Shared

TEMPLATE_PAGES = 700
CORPUS_PAGES = 100
ROUNDS, DEPTH = 15, 4

_BIT = {n: 1 << i for i, (n, _) in enumerate(TAG_GROUPS)}
_AWAY = _BIT["nav"] | _BIT["aside"] | _BIT["header"] | _BIT["footer"] | _BIT["form"]


class Trees:
    """A boosted ensemble as arrays; ``margin`` scores many rows at once."""

    def __init__(self, trees: list[tuple[float, list[tuple]]]):
        #: per tree: weight and (feature, threshold, left, right, value) columns
        self.trees = [(w, *[np.array(c) for c in zip(*nodes)]) for w, nodes in trees]

    @classmethod
    def from_model(cls, model) -> "Trees":
        return cls([(w, _nodes(t.toDebugString)) for w, t in zip(model.treeWeights, model.trees)])

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x))
        row = np.arange(len(x))
        for weight, feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = left[at] >= 0
                if not inner.any():
                    break
                goes = x[row, np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(goes, left[at], right[at]), at)
            out += weight * value[at]
        return out


def _nodes(printed: str) -> list[tuple]:
    """(feature, threshold, left, right, value) rows of a tree's printed form."""
    lines = [(len(x) - len(x.lstrip()), x.strip()) for x in printed.splitlines()[1:] if x.strip()]
    out: list = []

    def read(i: int) -> tuple[int, int]:
        """Reads the node at line i: (its index, the line after it)."""
        me = len(out)
        out.append(None)
        text = lines[i][1]
        if text.startswith("Predict"):
            out[me] = (-1, 0.0, -1, -1, float(text.split(":")[1]))
            return me, i + 1
        m = re.match(r"If \(feature (\d+) <= ([-+0-9.eE]+)\)", text)
        left, i = read(i + 1)
        right, i = read(i + 1)  # past the Else line
        out[me] = (int(m[1]), float(m[2]), left, right, 0.0)
        return me, i

    read(0)
    return out


def template_labels(page) -> np.ndarray:
    """1 for marked main blocks and the containers around them."""
    return _with_containers(page, np.array([m == "1" for m in page.marks]))


def semantic_labels(page) -> np.ndarray | None:
    """Labels of a page whose article or main element tells the main part; else None."""
    scope = np.array(page.scope)
    main = (scope & _BIT["article"] > 0) & (scope & _AWAY == 0)
    return _with_containers(page, main) if main.any() else None


def _with_containers(page, main: np.ndarray) -> np.ndarray:
    out = main.copy()
    for i in range(len(out) - 1, 0, -1):
        if out[i]:
            out[page.parent[i]] = True
    return out.astype(np.float64)


def fit(spark: SparkSession, pages: DataFrame) -> Trees:
    made = [(p, template_labels(p)) for p in map(parse, labelled_pages(TEMPLATE_PAGES))]
    rows = pages.select(F.col("html").cast("string").alias("html")).where("length(html) < 200000").take(CORPUS_PAGES)
    for page in map(parse, [r["html"] for r in rows]):
        label = semantic_labels(page)
        if label is not None:
            made.append((page, label))
    x, base = features([p for p, _ in made])
    y = np.concatenate([label for _, label in made])
    some = np.ones(len(y), dtype=bool)
    some[base[:-1]] = False  # the root is always kept
    table = pa.table({f"f{i}": x[some, i] for i in range(x.shape[1])} | {"label": y[some]})
    data = VectorAssembler(inputCols=table.column_names[:-1], outputCol="x").transform(
        spark.createDataFrame(table)).select("x", "label").coalesce(4).persist()
    try:
        model = GBTClassifier(featuresCol="x", labelCol="label", maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3,
                              seed=3).fit(data)
    finally:
        data.unpersist()
    return Trees.from_model(model)


def decode(page, odds: np.ndarray) -> list[bool]:
    """The consistent choice of greatest sum of log-odds (per node, clipped)."""
    n = len(page.tag)
    odds = np.clip(odds, -4.0, 4.0).tolist()
    keep, drop = odds[:], [-x for x in odds]
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        keep[p] += max(keep[i], drop[i])
        drop[p] += drop[i]
    out = [True] * n
    for i in range(1, n):
        out[i] = out[parent[i]] and keep[i] > drop[i]
    return out


PAGES_A_BATCH = 200


def _extract(trees):
    def task(batches):
        model = trees.value
        for batch in batches:
            for at in range(0, len(batch), PAGES_A_BATCH):
                part = batch.slice(at, PAGES_A_BATCH)
                pages = [parse(h or "") for h in part.column(2).to_pylist()]
                x, base = features(pages)
                odds = 2.0 * model.margin(x)
                texts = [kept_text(p, decode(p, odds[a:b])) for p, a, b in zip(pages, base[:-1], base[1:])]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])
    return task


def extract(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """(page_id, url, text) with the main text of every page."""
    spark = pages.sparkSession
    model = Shared(spark, trees or fit(spark, pages))
    return (pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.col("html").cast("string").alias("html"))
            .mapInArrow(_extract(model), "page_id long, url string, text string"))
