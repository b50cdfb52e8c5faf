"""Composed pipelines (C1–C4): dossier, relevance report, feedback.

Each takes DataFrames (items, pages, ratings, lexicon) and returns
DataFrames; the ``run_*`` forms also write the run-stamped outputs (K8).
"""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import _utc_instant
from ..functions.formatting import rfc2822, run_stamp
from ..operators.content import fill_content
from ..operators.feedback import apply_feedback
from ..operators.rank import number_small, relevance_order, score_top_k
from ..operators.scoring import with_relevance
from ..sinks.csv import write_csv
from ..sinks.reports import dossier_lines, item_log_lines, relevance_report_lines, write_report
from ..sinks.table import insert_items
from ..session import materialize, scratch

FIRST_PHASE_K = 100
SECOND_PHASE_K = 20


@dataclass
class Dossier:
    first_phase: DataFrame   # top k1 on metadata, content filled (phase-1 relevance)
    top: DataFrame           # top k2 after re-scoring with content, ``rank`` 1..k2


def two_phase(items: DataFrame, pages: DataFrame, lexicon: DataFrame, k1: int = FIRST_PHASE_K,
              k2: int = SECOND_PHASE_K, clean: bool = True, url_col: str = "url",
              html_col: str = "html", page_key: str | None = None) -> Dossier:
    """T4: top k1 on metadata, fill their content (J2), re-score, top k2.

    Only k1 rows ever reach the page join and the HTML cleaner."""
    # The k1 winners are written to the shared checkpoint folder (k1 rows):
    # the fill join reads them twice and phase 2 (with its size checks) reads
    # the filled rows twice; none of that re-runs phase 1.
    first = materialize(score_top_k(items, lexicon, k1), "first-phase")
    filled = fill_content(first, pages, url_col=url_col, html_col=html_col, page_key=page_key,
                          clean=clean)
    filled = materialize(filled, "first-phase-filled")
    top = score_top_k(filled, lexicon, k2)
    top = number_small(top, relevance_order(), "rank")
    return Dossier(first_phase=filled, top=top)


def _stamp(spark, run_time: str) -> str:
    return spark.range(1).select(run_stamp(_utc_instant(run_time))).first()[0]


def run_dossier(items: DataFrame, pages: DataFrame, lexicon: DataFrame, root: str,
                report_name: str, run_time: str, log: bool = False, db: bool = False,
                **kw) -> dict:
    """C2 with its outputs: ``{name}_{stamp}/dossier-{name}_{stamp}.md``, the
    optional item log and the optional stored table (K8)."""
    spark = items.sparkSession
    stamp = _stamp(spark, run_time)
    folder = os.path.join(root, f"{report_name}_{stamp}")
    with scratch(spark):
        return _write_dossier(materialize(items, "items"), pages, lexicon, folder, f"{report_name}_{stamp}",
                              run_time, log, db, **kw)


def _write_dossier(items, pages, lexicon, folder, name, run_time, log, db, **kw) -> dict:
    spark = items.sparkSession
    d = two_phase(items, pages, lexicon, **kw)
    out = {"folder": folder}
    if log:
        path = os.path.join(folder, f"{name}.md")
        write_report(item_log_lines(d.first_phase), path)
        out["log"] = path
    if db:
        path = os.path.join(folder, f"{name}.parquet")
        out["inserted"] = insert_items(spark, d.first_phase, path)
        out["db"] = path
    path = os.path.join(folder, f"dossier-{name}.md")
    write_report(dossier_lines(d.top, run_time), path)
    out["dossier"] = path
    return out


def relevance_report(items: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Score all items (no opt-in, no top-k) → report lines.  The narrow
    scored list is written once and read back by the report's three parts."""
    scored = with_relevance(items, lexicon).select("item_id", "relevance", "channel", "title", "link")
    return relevance_report_lines(materialize(scored, "scored"))


def run_relevance_report(items: DataFrame, lexicon: DataFrame, root: str, report_name: str,
                         run_time: str) -> str:
    stamp = _stamp(items.sparkSession, run_time)
    path = os.path.join(root, f"{report_name}_{stamp}", f"relevance-{report_name}_{stamp}.md")
    with scratch(items.sparkSession):
        write_report(relevance_report(items, lexicon), path)
    return path


def feedback(items: DataFrame, ratings: DataFrame, n: int = 20, now: str | None = None) -> DataFrame:
    """C4: first n items, rated, relevance = rating."""
    return apply_feedback(items, ratings, n=n, now=now)


def run_feedback(items: DataFrame, ratings: DataFrame, root: str, run_time: str, n: int = 20,
                 file_name: str = "feedback.csv") -> str:
    spark = items.sparkSession
    stamp = _stamp(spark, run_time)
    path = os.path.join(root, f"feedback_{stamp}", file_name)
    date = spark.range(1).select(rfc2822(_utc_instant(run_time))).first()[0]
    write_csv(feedback(items, ratings, n), path, date)
    return path
