"""Command line: the three report commands over landed data.

    python -m gacetilla [--feeds DIR] [--opt-in TERM ...] [--operator and|or]
                        [--root DIR] [--lexicon FILE] COMMAND ...

    dossier    --pages PARQUET [--report-name N] [--log] [--db]
    relevance  [--report-name N]
    feedback   --ratings CSV [--number N] [--file-name F]

Feeds are landed RSS files (a folder or glob) instead of URLs; article pages
are a Parquet table ``(url, html)``; ratings are a CSV ``(link, rating)``.
Each command writes its run-stamped folder under ``--root``.
"""

from __future__ import annotations

import argparse
import datetime as _dt
import sys

from .plans.pipelines import run_dossier, run_feedback, run_relevance_report
from .session import build_session
from .sources.lexicon import DEFAULT_USER_FILE, combined_lexicon
from .sources.rss import load_items


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="gacetilla")
    p.add_argument("--feeds", default="feeds", help="folder or glob of landed RSS files")
    p.add_argument("--opt-in", action="append", default=[], help="category/keyword to opt in")
    p.add_argument("--operator", choices=["and", "or"], default="or")
    p.add_argument("--root", default=".", help="root folder for the reports")
    p.add_argument("--lexicon", default=DEFAULT_USER_FILE, help="extra root words file")
    p.add_argument("--master", default=None, help="Spark master (default local[*])")
    sub = p.add_subparsers(dest="command")
    d = sub.add_parser("dossier")
    d.add_argument("--pages", required=True, help="Parquet table of landed pages (url, html)")
    d.add_argument("--report-name", default="report")
    d.add_argument("--log", action="store_true")
    d.add_argument("--db", action="store_true")
    r = sub.add_parser("relevance")
    r.add_argument("--report-name", default="report")
    f = sub.add_parser("feedback")
    f.add_argument("--ratings", required=True, help="CSV with link,rating")
    f.add_argument("--number", type=int, default=20)
    f.add_argument("--file-name", default="feedback.csv")
    return p


def main(argv=None, spark=None) -> int:
    args = _parser().parse_args(argv)
    if args.command is None:
        _parser().print_help()
        return 0
    spark = spark or build_session(master=args.master or "local[*]")
    lexicon = combined_lexicon(spark, user_file=args.lexicon)
    run_time = _dt.datetime.now(_dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%S")
    if args.command == "dossier":
        items = load_items(spark, args.feeds, args.opt_in, args.operator)
        out = run_dossier(items, spark.read.parquet(args.pages), lexicon, args.root,
                          args.report_name, run_time, log=args.log, db=args.db)
        print(out["dossier"])
    elif args.command == "relevance":
        items = load_items(spark, args.feeds)  # the relevance report takes no opt-in
        print(run_relevance_report(items, lexicon, args.root, args.report_name, run_time))
    else:
        from .operators.feedback import read_ratings
        items = load_items(spark, args.feeds)
        print(run_feedback(items, read_ratings(spark, args.ratings), args.root, run_time,
                           n=args.number, file_name=args.file_name))
    return 0


if __name__ == "__main__":
    sys.exit(main())
