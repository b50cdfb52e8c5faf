"""Contract queries that land the test tables as files and read them back, or
exercise operators that no query of ``contract`` reaches.

Files go to the session's shared folder and are written by Spark.  ``landed_sql``
has the DuckDB form of each result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.formatting import rfc2822, run_stamp
from ..functions.items import error_debug, error_text, make_error, parse_error
from ..operators.feedback import read_ratings, valid_rating
from ..operators.normalize import normalise
from ..operators.rank import random_order, top_k_composite
from ..operators.scoring import with_relevance
from ..session import checkpoint_dir
from ..sources.feeds import read_feed_list
from ..sources.lexicon import combined_lexicon
from ..sources.rss import load_items, read_feeds, read_large_feeds, rss_elements
from ..sinks.reports import read_report
from ..sinks.table import read_table
from ..sources.testdata import (BASE_EPOCH, STEP_SECONDS, content_store, document_items, filled_document_items, ratings_from_labels,
                                raw_items_from_documents, table)
from .contract import contract_lexicon
from .oracle import (ITEMS, OPT_IN_OR, RAW_ITEMS, RUN_TIME, _esc, _num, _q, _split_ws,
                     _two_phase_sql, more_sql, p1_scores_sql, scored_filled)
from .pipelines import run_dossier, run_relevance_report

FEED_ITEMS = 250
#: ids of the items of a large feed: one task writes a file
LARGE_FEED_IDS = 50_000
ITEM_TEXTS = ["channel", "title", "link", "description", "creators", "pub_date", "categories", "keywords"]
COMPOSITE_K = 400


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark)}/landed/{name}-{uuid.uuid4().hex}"


def _land_feeds(spark, sf_dir) -> list[str]:
    """The documents as feed files of several items (one per channel and block
    of ids), a broken file, and a path that names nothing."""
    raw = raw_items_from_documents(table(spark, sf_dir, "documents"))
    feeds = (raw.select(F.floor(F.col("item_id") / FEED_ITEMS).alias("block"), "channel_title", "item_id",
                        rss_elements(raw).alias("xml"))
             # a feed has at most FEED_ITEMS items
             .groupBy("block", "channel_title").agg(F.sort_array(F.collect_list(F.struct("item_id", "xml"))).alias("x"))
             .select(F.concat_ws("-", "block", F.md5("channel_title")).alias("feed"),
                     F.concat(F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" '
                                    'xmlns:media="http://search.yahoo.com/mrss/"><channel><title>'),
                              F.col("channel_title"), F.lit("</title>"), F.array_join("x.xml", ""),
                              F.lit("</channel></rss>")).alias("value")))
    path = _folder(spark, "feeds")
    feeds.repartition("feed").write.partitionBy("feed").text(path)
    broken = _folder(spark, "broken")
    feeds.where(F.col("feed").startswith("0-")).select(F.substring("value", 1, 300)).coalesce(1).write.text(broken)
    return [f"{path}/*", broken, f"{path}-none/*.xml"]


def q_load_feeds(spark, sf_dir):
    """C1 with S2–S4, P2 and P6: terms are given in capitals."""
    return load_items(spark, _land_feeds(spark, sf_dir), [t.upper() for t in OPT_IN_OR], "or").select(
        "channel", "title", "link", "description", "creators", "pub_date", "categories", "keywords")


def q_large_feeds(spark, sf_dir):
    """S2, S4, P1 for large feeds: the documents as one file per channel and
    LARGE_FEED_IDS ids, item by item, and a file without a channel."""
    raw = raw_items_from_documents(table(spark, sf_dir, "documents"))
    # documents without a channel are one file, which is one bad feed
    block = F.coalesce(F.floor(F.col("item_id") / LARGE_FEED_IDS), F.lit(0))
    feed = F.when(F.col("channel_title").isNotNull(), F.concat_ws("-", F.md5("channel_title"), block))
    lines = raw.select(feed.alias("feed"), F.col("item_id").alias("ord"), rss_elements(raw).alias("value"))
    titles = raw.select(feed.alias("feed"), "channel_title").distinct()
    head = F.concat(F.lit('<?xml version="1.0"?>\n<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" '
                          'xmlns:media="http://search.yahoo.com/mrss/">\n<channel>\n<title>'), "channel_title",
                    F.lit("</title>\n<link>https://example.org/</link>"))
    lines = (lines.unionByName(titles.select("feed", F.lit(-1).cast("long").alias("ord"), head.alias("value")))
             .unionByName(titles.select("feed", F.lit((1 << 62)).cast("long").alias("ord"),
                                        F.lit("</channel></rss>").alias("value"))))
    path = _folder(spark, "large-feeds")
    lines.repartition("feed").sortWithinPartitions("feed", "ord").drop("ord").write.partitionBy("feed").text(path)
    none = _folder(spark, "no-feed")
    spark.range(1).select(F.lit("<html><p>gone</p></html>").alias("value")).write.text(none)
    items, bad = read_large_feeds(spark, [f"{path}/*", none])
    bad = bad.select(F.lit("bad").alias("channel"), F.col("reason").alias("title"),
                     *[F.lit(None).cast("string").alias(c) for c in ITEM_TEXTS[2:]])
    return normalise(items).select(*ITEM_TEXTS).unionByName(bad)


def q_bad_feeds(spark, sf_dir):
    items, bad = read_feeds(spark, _land_feeds(spark, sf_dir))
    return (bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
            .unionByName(items.agg(F.lit("items").alias("reason"), F.count(F.lit(1)).alias("n"))))


def q_feed_list_file(spark, sf_dir):
    """Page addresses as the lines of several files, with comments and empty lines."""
    n = F.col("page_id") % 10
    line = F.when(n == 3, F.concat(F.lit("# "), F.col("url"))).when(n == 7, F.lit("")).otherwise(F.col("url"))
    path = _folder(spark, "feed-list")
    (table(spark, sf_dir, "pages").repartitionByRange(4, "page_id").sortWithinPartitions("page_id")
     .select(line.alias("value")).write.text(path))
    return read_feed_list(spark, path)


def q_lexicon_file(spark, sf_dir):
    """A word file with all words of every document."""
    path = _folder(spark, "words")
    words = F.array_join(F.filter(F.split("text", "[ \\n]+"), lambda x: x != ""), "\t ")
    table(spark, sf_dir, "documents").select(words.alias("value")).write.text(path)
    return combined_lexicon(spark, user_file=path)


def q_ratings_file(spark, sf_dir):
    """Ratings from a CSV file."""
    path = _folder(spark, "ratings")
    ratings_from_labels(spark, sf_dir).write.option("header", "true").csv(path)
    rows = read_ratings(spark, path)
    return rows.select("link", "rating", valid_rating("rating").alias("valid"))


def q_random_order(spark, sf_dir):
    """All items, in a seeded order."""
    return random_order(document_items(spark, sf_dir), seed=7).select("item_id", "link")


def q_with_relevance(spark, sf_dir):
    """A4: every item with its relevance."""
    out = with_relevance(filled_document_items(spark, sf_dir), contract_lexicon(spark))
    return out.select("item_id", "channel", "title", "link", "clean_content",
                      F.col("error.kind").alias("error_kind"), "relevance")


def q_top_k_composite_items(spark, sf_dir):
    """T2 by its operator, with a k beyond one byte."""
    return top_k_composite(filled_document_items(spark, sf_dir), contract_lexicon(spark), COMPOSITE_K).select(
        F.col("rank").cast("long").alias("rank"), "item_id", "link", "title")


def q_relevance_report_file(spark, sf_dir):
    """The report run twice into its folder, read back."""
    root = _folder(spark, "reports")
    for _ in range(2):
        path = run_relevance_report(document_items(spark, sf_dir), contract_lexicon(spark), root, "all", RUN_TIME)
    name = F.regexp_extract(F.input_file_name(), "reports-[^/]*/(.*)/part-r([0-9]+)-", 1)
    run = F.regexp_extract(F.input_file_name(), "/part-r([0-9]+)-", 1).cast("int")
    return (spark.read.text(path).select(name.alias("file"), run.alias("run"), F.col("value").alias("line"))
            .groupBy("file", "run", "line").agg(F.count(F.lit(1)).alias("n")))


def q_dossier_run(spark, sf_dir):
    """C2 with all its outputs (K4, K6, K7, K2): the dossier, the item log and the
    stored table, read back line by line, and the count that was reported."""
    out = run_dossier(document_items(spark, sf_dir), content_store(spark, sf_dir), contract_lexicon(spark),
                      _folder(spark, "dossiers"), "daily", RUN_TIME, log=True, db=True, clean=False, html_col="body")
    rows = spark.range(1).select(F.lit("inserted").alias("file"), F.lit(str(out["inserted"])).alias("line"))
    for name in ("dossier", "log"):
        rows = rows.unionByName(read_report(spark, out[name]).select(F.lit(name).alias("file"), "line"))
    rows = rows.unionByName(read_table(spark, out["db"]).select(F.lit("table").alias("file"), F.col("link").alias("line")))
    return rows.groupBy("file", "line").agg(F.count(F.lit(1)).alias("n"))


ERROR_KINDS = ["ParsingError", "NetworkError", "NoContent", "EmptyString"]


def q_error_texts(spark, sf_dir):
    """Errors of all kinds as stored text, read back, and as debug text."""
    items = document_items(spark, sf_dir)
    kind = F.element_at(F.array(*map(F.lit, ERROR_KINDS)), (F.col("item_id") % 4 + 1).cast("int"))
    stored = error_text(make_error(kind, F.when(F.col("item_id") % 4 < 2, F.col("title"))))
    back = parse_error(F.when(F.col("item_id") % 9 == 0, F.lit("None")).when(F.col("item_id") % 9 == 1, F.lit("Odd"))
                       .otherwise(stored))
    return items.select("item_id", stored.alias("stored"), back.alias("e")).select(
        "item_id", "stored", F.col("e.kind").alias("kind"), F.col("e.message").alias("message"),
        error_debug("e").alias("debug"))


def q_run_times(spark, sf_dir):
    """Stamps and RFC 2822 texts of times."""
    ts = F.timestamp_seconds(F.lit(BASE_EPOCH) + F.col("doc_id") * STEP_SECONDS)
    return table(spark, sf_dir, "documents").select("doc_id", run_stamp(ts).alias("stamp"), rfc2822(ts).alias("date"))


def landed_queries() -> dict:
    return {f.__name__: f for f in (
        q_load_feeds, q_large_feeds, q_bad_feeds, q_feed_list_file, q_lexicon_file, q_ratings_file, q_random_order, q_with_relevance,
        q_top_k_composite_items, q_relevance_report_file, q_dossier_run, q_error_texts, q_run_times)}


def landed_sql() -> dict[str, str]:
    from ..sources.lexicon import BUILTIN_ROOTS

    builtin = ", ".join(f"({_q(w)})" for w in BUILTIN_ROOTS)
    found = " OR ".join(f"contains(coalesce({c}, ''), {_q(t)})" for t in OPT_IN_OR for c in ("categories", "keywords"))
    when = f"make_timestamp(CAST(({BASE_EPOCH} + doc_id * {STEP_SECONDS}) * 1000000 AS BIGINT))"
    kinds = "[" + ", ".join(map(_q, ERROR_KINDS)) + "]"
    name = "all_" + RUN_TIME[:10] + "-" + RUN_TIME[11:19].replace(":", "-")
    return {
        "q_load_feeds": "WITH " + ITEMS + f"""
SELECT channel, title, link, description, creators, pub_date, categories, keywords FROM items WHERE {found}""",
        "q_large_feeds": "WITH " + ITEMS + """
SELECT channel, title, link, description, creators, pub_date, categories, keywords FROM items
UNION ALL SELECT 'bad', 'feed could not be parsed', NULL, NULL, NULL, NULL, NULL, NULL""",
        "q_bad_feeds": "WITH " + RAW_ITEMS + """
SELECT 'feed could not be parsed' AS reason, 1::BIGINT AS n UNION ALL SELECT 'feed not found', 1
UNION ALL SELECT 'items', count(*) FROM raw_items""",
        "q_feed_list_file": """
WITH l AS (SELECT row_number() OVER (ORDER BY page_id) - 1 AS line_no, url, page_id % 10 AS n FROM pages)
SELECT line_no::BIGINT AS line_no, url FROM l WHERE n NOT IN (3, 7)""",
        "q_lexicon_file": f"""
SELECT DISTINCT root FROM (SELECT root FROM (VALUES {builtin}) AS b(root)
  UNION ALL SELECT unnest({_split_ws("array_to_string(list_filter(regexp_split_to_array(text, '[ ' || chr(10) || ']+'), lambda x: x <> ''), ' ')")}) FROM documents)""",
        "q_ratings_file": """
SELECT 'https://example.org/doc/' || doc_id AS link, CAST((doc_id + 2 * quality + 3 * toxic) % 7 AS VARCHAR) AS rating,
  CASE WHEN (doc_id + 2 * quality + 3 * toxic) % 7 BETWEEN 1 AND 5
       THEN CAST((doc_id + 2 * quality + 3 * toxic) % 7 AS BIGINT) END AS valid FROM labels""",
        "q_random_order": "WITH " + ITEMS + "\nSELECT item_id, link FROM items",
        "q_with_relevance": scored_filled() + """
SELECT item_id, channel, title, link, clean_content, error_kind, net_relevance AS relevance FROM scores""",
        "q_top_k_composite_items": scored_filled() + f"""
SELECT CAST(row_number() OVER (ORDER BY error DESC, relevance_core DESC, relevance_content DESC, link, item_id) AS BIGINT) AS rank,
  item_id, link, title FROM scores
ORDER BY error DESC, relevance_core DESC, relevance_content DESC, link, item_id LIMIT {COMPOSITE_K}""",
        "q_relevance_report_file": p1_scores_sql() + f""",
ch AS (SELECT channel, count(*) AS items, CAST(sum(net_relevance) AS DOUBLE) AS total,
         CAST(sum(net_relevance) AS DOUBLE) / count(*) AS average FROM p1_scores GROUP BY channel),
lines AS (SELECT unnest(['# Relevance Report', '', '## Relevance per Channel', '', '', '## Relevance list', '']) AS line
  UNION ALL SELECT '- **' || channel || ':** Items: ' || items || ' Total: ' || {_num('total')} || ' Average: ' || {_num('average')} FROM ch
  UNION ALL SELECT (row_number() OVER (ORDER BY net_relevance DESC, link, item_id) - 1) || '. (' || net_relevance || ') ['
    || channel || '] ' || title FROM p1_scores)
SELECT '{name}/relevance-{name}.md' AS file, r::INTEGER AS run, line, count(*) AS n
FROM lines, range(1, 3) AS t(r) GROUP BY r, line""",
        "q_dossier_run": f"""
WITH t AS ({_two_phase_sql()} SELECT link FROM top1),
l AS (SELECT 'dossier' AS file, unnest(string_split(line, chr(10))) AS line FROM ({more_sql()["q_dossier_lines"]})
  UNION ALL SELECT 'log', unnest(string_split(line, chr(10))) FROM ({more_sql()["q_item_log_lines"]})
  UNION ALL SELECT 'table', link FROM t UNION ALL SELECT 'inserted', CAST(count(*) AS VARCHAR) FROM t)
SELECT file, line, count(*) AS n FROM l GROUP BY file, line""",
        "q_error_texts": "WITH " + ITEMS + f""",
k AS (SELECT item_id, title, {kinds}[item_id % 4 + 1] AS kind FROM items),
s AS (SELECT *, kind || CASE WHEN item_id % 4 < 2 THEN '(' || title || ')' ELSE '' END AS stored FROM k),
b AS (SELECT *, CASE WHEN item_id % 9 = 0 THEN NULL WHEN item_id % 9 = 1 THEN 'UnknownError' ELSE kind END AS read,
        CASE WHEN item_id % 9 > 1 AND item_id % 4 < 2 THEN title END AS message FROM s)
SELECT item_id, stored, read AS kind, message, CASE WHEN read IS NULL THEN 'None'
  WHEN message IS NOT NULL THEN 'Some(' || read || '("' || {_esc('message')} || '"))' ELSE 'Some(' || read || ')' END AS debug
FROM b""",
        "q_run_times": f"""
SELECT doc_id, strftime({when}, '%Y-%m-%d-%H-%M-%S') AS stamp,
  strftime({when}, '%a, %d %b %Y %H:%M:%S') || ' +0000' AS date FROM documents""",
    }
