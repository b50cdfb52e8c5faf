"""Composed pipelines (C1–C4, T4, K8) end to end on landed feeds and pages."""

import os

from pyspark.sql import functions as F

from gacetilla.plans.pipelines import (run_dossier, run_feedback, run_relevance_report,
                                       two_phase)
from gacetilla.sinks.table import read_table
from gacetilla.sources.lexicon import builtin_lexicon
from gacetilla.sources.rss import load_items

FEED = """<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>ElDiario.es</title>
<item><title>Crisis en el Gobierno</title><link>https://n/1</link><description>La crisis sigue</description>
<dc:creator>Ana</dc:creator><pubDate>Thu, 21 Mar 2024 18:32:48 GMT</pubDate><category>Política</category></item>
<item><title>Tiempo soleado</title><link>https://n/2</link><description>Sin novedad</description></item>
<item><title>Elecciones y Presidente</title><link>https://n/3</link><description>Campaña</description>
<category>Elecciones</category></item>
</channel></rss>"""


def _text(path):
    return "".join(open(os.path.join(path, f), encoding="utf-8").read()
                   for f in sorted(os.listdir(path)) if f.startswith("part-"))


def _setup(spark, workdir):
    feeds = os.path.join(workdir, "feeds")
    os.makedirs(feeds)
    with open(os.path.join(feeds, "f.xml"), "w") as f:
        f.write(FEED)
    items = load_items(spark, feeds)
    pages = spark.createDataFrame(
        [("https://n/1", "<html><body><p>Crisis y más crisis en la Policía.</p></body></html>"),
         ("https://n/3", "")], "url string, html string")
    return items, pages


def test_two_phase_and_dossier(spark, workdir):
    items, pages = _setup(spark, workdir)
    d = two_phase(items, pages, builtin_lexicon(spark), k1=2, k2=1)
    first = {r.link: r for r in d.first_phase.collect()}
    assert set(first) == {"https://n/1", "https://n/3"}
    assert first["https://n/3"].error.kind == "EmptyString"
    top = d.top.collect()
    assert [(r.link, r.rank) for r in top] == [("https://n/1", 1)]
    assert top[0].relevance > first["https://n/1"].relevance  # content counted in phase 2

    out = run_dossier(items, pages, builtin_lexicon(spark), workdir, "report", "2025-01-01T10:00:00",
                      log=True, db=True, k1=2, k2=1)
    assert out["folder"].endswith("report_2025-01-01-10-00-00")
    dossier = _text(out["dossier"])
    assert dossier.startswith("# Dossier\n\n## Table of Contents\n1. [Crisis en el Gobierno](#crisis-en-el-gobierno)\n")
    assert "- **Number of items:** 1\n" in dossier
    assert '- **Publish Date:** Some("Thu, 21 Mar 2024 18:32:48 +0000")\n' in dossier
    log = _text(out["log"])
    assert log.startswith("# Table of Contents\n1. [")
    assert "- **Error:** Some(EmptyString)" in log
    assert out["inserted"] == 2
    assert read_table(spark, out["db"]).count() == 2


def test_relevance_report_and_feedback(spark, workdir):
    items, _ = _setup(spark, workdir)
    path = run_relevance_report(items, builtin_lexicon(spark), workdir, "rel", "2025-01-01T10:00:00")
    text = _text(path)
    assert text.startswith("# Relevance Report\n\n## Relevance per Channel\n\n- **ElDiario.es:** Items: 3 ")
    assert "## Relevance list\n0. (" in text
    ratings = spark.createDataFrame([("https://n/1", "5"), ("https://n/2", "0"), ("https://n/3", "3")],
                                    "link string, rating string")
    csv = run_feedback(items, ratings, workdir, "2025-01-01T10:00:00", n=20)
    assert "feedback_2025-01-01-10-00-00" in csv
    back = spark.read.option("header", "true").option("multiLine", "true").csv(csv)
    got = {r["Link"]: (r["Relevance"], r["Feedback Date"]) for r in back.collect()}
    assert got == {"https://n/1": ("5", "Wed, 01 Jan 2025 10:00:00 +0000"),
                   "https://n/3": ("3", "Wed, 01 Jan 2025 10:00:00 +0000")}


def test_command_line(spark, workdir):
    from gacetilla.__main__ import main
    items, pages = _setup(spark, workdir)
    pages_path = os.path.join(workdir, "pages.parquet")
    pages.write.parquet(pages_path)
    ratings = os.path.join(workdir, "ratings.csv")
    with open(ratings, "w") as f:
        f.write("link,rating\nhttps://n/1,5\n")
    feeds = os.path.join(workdir, "feeds")
    root = os.path.join(workdir, "out")
    assert main(["--feeds", feeds, "--root", root, "--lexicon", "", "dossier", "--pages", pages_path,
                 "--log"], spark) == 0
    assert main(["--feeds", feeds, "--root", root, "--lexicon", "", "relevance"], spark) == 0
    assert main(["--feeds", feeds, "--root", root, "--lexicon", "", "feedback", "--ratings", ratings],
                spark) == 0
    made = sorted(os.listdir(root))
    assert any(m.startswith("report_") for m in made) and any(m.startswith("feedback_") for m in made)
