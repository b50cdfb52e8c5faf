"""Contract queries: one callable per operator family, (spark, sf_dir) → DataFrame.

Each reads the shared test tables whole (through the views of
``gacetilla.sources.testdata``) and runs the library's operators.  The
DuckDB form of each is in ``gacetilla.plans.oracle``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import anchor
from ..functions.items import channel_type
from ..operators.normalize import rejected
from ..operators.optin import opt_in
from ..operators.rank import composite_order, number_all, number_small, relevance_order
from ..operators.scoring import score_breakdown, token_occurrences, token_table, vocabulary
from ..operators.similarity import dice_pairs, filter_matching, matched_tokens
from ..sources.lexicon import combined_lexicon
from ..sources.testdata import (CONTRACT_EXTRA_ROOTS, content_store, document_items,
                                filled_document_items, nested_pages, page_items, pages_with_channel,
                                ratings_from_labels, raw_items_from_documents, table)
from ..session import materialize
from .oracle import FEEDBACK_DATE, FEEDBACK_N, OPT_IN_AND, OPT_IN_OR, RUN_TIME, SIMILAR_WORDS, TOP_K


def contract_lexicon(spark: SparkSession) -> DataFrame:
    return combined_lexicon(spark, user_file=None, extra_words=CONTRACT_EXTRA_ROOTS)


def q_items_normalised(spark, sf_dir):
    return document_items(spark, sf_dir).select(
        "item_id", "channel", "title", "link", "description", "creators", "pub_date",
        "categories", "keywords")


def q_rejected_items(spark, sf_dir):
    return rejected(raw_items_from_documents(table(spark, sf_dir, "documents")))


def q_channel_type(spark, sf_dir):
    return document_items(spark, sf_dir).select("item_id", "channel",
                                                channel_type("channel").alias("channel_type"))


def q_opt_in_or(spark, sf_dir):
    return opt_in(document_items(spark, sf_dir), OPT_IN_OR, "or").select("item_id", "link")


def q_opt_in_and(spark, sf_dir):
    return opt_in(document_items(spark, sf_dir), OPT_IN_AND, "and").select("item_id", "link")


def q_opt_in_empty(spark, sf_dir):
    return opt_in(document_items(spark, sf_dir), [], "or").select("item_id", "link")


def q_dice_pairs(spark, sf_dir):
    return dice_pairs(vocabulary(token_table(filled_document_items(spark, sf_dir))), contract_lexicon(spark))


def q_fuzzy_tokens(spark, sf_dir):
    tokens = token_table(filled_document_items(spark, sf_dir))
    hits = filter_matching(token_occurrences(tokens), matched_tokens(vocabulary(tokens), contract_lexicon(spark)))
    return hits.groupBy("token").agg(F.count(F.lit(1)).cast("long").alias("occurrences"))


def q_similar_words(spark, sf_dir):
    """J1, X7 with a large lexicon: every distinct word of the documents against
    all of them, the number of others it is similar to, as the ranking has it, and
    the closest score."""
    from ..functions.text import split_whitespace
    words = table(spark, sf_dir, "documents").select(F.explode(split_whitespace("text")).alias("token")).distinct()
    words = materialize(words, "words")
    pairs = dice_pairs(words, words, root_col="token", threshold=SIMILAR_WORDS).where("token <> root")
    return pairs.groupBy("token").agg(F.count(F.lit(1)).alias("similar"), F.max("dice").alias("closest"))


def _scores(spark, sf_dir, carry=("link", "channel", "title")):
    items = filled_document_items(spark, sf_dir)
    return score_breakdown(items, contract_lexicon(spark), carry=list(carry))


def q_score_breakdown(spark, sf_dir):
    return _scores(spark, sf_dir, carry=()).select(
        "item_id", "error", "by_creator", "by_categories", "by_keywords", "by_title",
        "by_description", "relevance_core", "relevance_content", "net_relevance",
        "explanation", "score_text")


def q_top_k(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumnRenamed("net_relevance", "relevance")
    top = s.orderBy(*relevance_order()).limit(TOP_K)
    return number_small(top, relevance_order(), "rank").select("rank", "item_id", "link", "relevance")


def q_top_k_composite(spark, sf_dir):
    s = _scores(spark, sf_dir)
    top = s.orderBy(*composite_order()).limit(TOP_K)
    return number_small(top, composite_order(), "rank").select("rank", "item_id", "link")


def q_relevance_by_channel(spark, sf_dir):
    from ..sinks.reports import relevance_per_channel
    s = _scores(spark, sf_dir).withColumnRenamed("net_relevance", "relevance")
    return relevance_per_channel(s)


def q_relevance_list(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumnRenamed("net_relevance", "relevance")
    return number_all(s.select("item_id", "relevance", "channel", "title", "link"),
                      ["relevance", "link", "item_id"], [True, False, False], "ord", 0
                      ).select("ord", "item_id", "relevance", "channel", "title")


def q_contents_list(spark, sf_dir):
    s = _scores(spark, sf_dir).withColumnRenamed("net_relevance", "relevance")
    top = s.orderBy(*relevance_order()).limit(TOP_K)
    return number_small(top, relevance_order(), "ord").select("ord", "title", anchor("title").alias("anchor"))


def q_feed_lines(spark, sf_dir):
    from ..sources.feeds import is_feed_line
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("line"))
    doc_lines = table(spark, sf_dir, "documents").select(
        F.explode(F.split(F.col("text"), "\n", -1)).alias("line"))
    lines = pages.unionByName(doc_lines)
    return lines.where(is_feed_line("line")).groupBy("line").agg(
        F.count(F.lit(1)).cast("long").alias("copies"))


def q_rss_scan(spark, sf_dir):
    from ..operators.normalize import normalise
    from ..sources.rss import channel_items, parse_rss, rss_document
    raw = raw_items_from_documents(table(spark, sf_dir, "documents"))
    parsed = parse_rss(rss_document(raw))
    items = normalise(channel_items(parsed, feed_col="item_id").drop("pos"))
    return items.select("item_id", "channel", "title", "link", "description", "creators",
                        "pub_date", "categories", "keywords")


def q_union_feeds(spark, sf_dir):
    """U1 + S2–S4: two feed sources (documents and landed pages) written as
    RSS, read back together, flattened and normalised."""
    from ..operators.normalize import normalise
    from ..sources.rss import channel_items, parse_rss, rss_document
    docs = raw_items_from_documents(table(spark, sf_dir, "documents")).withColumn(
        "item_id", F.concat(F.lit("doc:"), F.col("item_id").cast("string")))
    pages = page_items(spark, sf_dir).select(
        "item_id", F.col("channel").alias("channel_title"), "title", "link",
        F.lit("Landed page").alias("description"), F.lit(None).cast("string").alias("pubDate"), F.lit(None).cast("array<string>").alias("category"),
        F.lit(None).cast("array<string>").alias("dc:creator"),
        F.lit(None).cast("array<string>").alias("media:keywords"))
    feeds = rss_document(docs.unionByName(pages))
    items = normalise(channel_items(parse_rss(feeds), feed_col="item_id").drop("pos"))
    return items.select("item_id", "channel", "title", "link", "description", "creators",
                        "pub_date", "categories", "keywords")


def q_clean_region(spark, sf_dir):
    from ..operators.content import clean_pages
    c = clean_pages(pages_with_channel(spark, sf_dir))
    kind = F.when(F.col("clean.error_kind").isNotNull(), F.col("clean.error_kind")).when(
        F.col("clean.clean_content") == "", F.lit("NoContent"))
    return c.select("page_id", channel_type("channel").alias("channel_type"),
                    F.col("clean.region").alias("region"), kind.alias("error_kind"))


def q_clean_text(spark, sf_dir):
    from ..operators.content import clean_pages
    c = clean_pages(pages_with_channel(spark, sf_dir))
    return c.select("page_id", F.col("clean.clean_content").alias("clean_content"),
                    F.col("clean.error_kind").alias("error_kind"))


def q_clean_nested(spark, sf_dir):
    """H2–H7 on pages with every region, nested in its own kind."""
    from ..operators.content import clean_pages
    c = clean_pages(nested_pages(spark, sf_dir))
    return c.select("page_id", F.col("clean.region").alias("region"),
                    F.col("clean.clean_content").alias("clean_content"), F.col("clean.error_kind").alias("error_kind"))


def q_fill_content(spark, sf_dir):
    from ..functions.items import error_text
    from ..operators.content import fill_content
    docs = document_items(spark, sf_dir).withColumn(
        "item_id", F.concat(F.lit("doc:"), F.col("item_id").cast("string")))
    items = page_items(spark, sf_dir).unionByName(docs)
    pages = table(spark, sf_dir, "pages")
    out = fill_content(items, pages, page_key="page_id")
    return out.select("item_id", F.col("error.kind").alias("error_kind"),
                      error_text(F.col("error")).alias("error_text"),
                      "clean_content")


def _two_phase(spark, sf_dir):
    from .pipelines import two_phase
    return two_phase(document_items(spark, sf_dir), content_store(spark, sf_dir),
                     contract_lexicon(spark), clean=False, html_col="body")


def q_two_phase(spark, sf_dir):
    return _two_phase(spark, sf_dir).top.select("rank", "item_id", "link", "relevance")


def _content_addressed(spark, sf_dir):
    from ..operators.normalize import normalise
    raw = raw_items_from_documents(table(spark, sf_dir, "documents"), keep_text=True)
    return normalise(raw, extra=["_text"]).withColumn(
        "link", F.concat(F.lit("https://example.org/"), F.md5("_text"))).drop("_text")


def q_dedup_link(spark, sf_dir):
    from ..operators.dedup import first_per_key
    return first_per_key(_content_addressed(spark, sf_dir), "link", ["item_id"]).select("link", "item_id")


def q_insert_new(spark, sf_dir):
    from ..operators.dedup import rows_to_insert
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id")).distinct()
    docs = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("item_id"), F.concat(F.lit("https://example.org/"), F.md5("text")).alias("link"))
    existing = docs.join(labels, "item_id", "left_semi").select("link")
    return rows_to_insert(_content_addressed(spark, sf_dir), existing, "link", ["item_id"]).select(
        "item_id", "link")


def q_insert_batches(spark, sf_dir):
    """Three batches into one table, the second one given twice;
    each stored link with its batch and the count that its insert reported."""
    import uuid
    from ..session import checkpoint_dir
    from ..sinks.table import insert_items, stored
    path = f"{checkpoint_dir(spark)}/tables/batches-{uuid.uuid4().hex}"
    items = _content_addressed(spark, sf_dir)
    reported = F.lit(None).cast("long")
    for n in (0, 1, 1, 2):
        count = insert_items(spark, items.where(F.col("item_id") % 3 == n), path, ["item_id"], batch=f"third-{n}")
        reported = F.when(F.col("batch") == f"id-third-{n}", F.lit(count).cast("long")).otherwise(reported)
    return stored(spark, path).select("batch", "link", "title", reported.alias("reported"))


def q_page_store(spark, sf_dir):
    """J2 against a store in buckets: two batches of pages and one given again;
    the items of every tenth page, and as many links without a page."""
    import uuid
    from ..functions.items import error_text
    from ..operators.content import fill_content
    from ..session import checkpoint_dir
    from ..sources.pages import land_pages, page_store
    path = f"{checkpoint_dir(spark)}/tables/pages-{uuid.uuid4().hex}"
    pages = table(spark, sf_dir, "pages")
    for n in (0, 1, 0):
        land_pages(pages.where(F.col("page_id") % 2 == n), path, buckets=16, batch=f"half-{n}")
    items = page_items(spark, sf_dir).where(F.substring("item_id", -1, 1) == "0")
    gone = items.withColumn("item_id", F.concat(F.lit("no-"), F.col("item_id"))).withColumn(
        "link", F.concat("link", F.lit("#none")))
    out = fill_content(items.unionByName(gone), page_store(spark, path), page_key="page_id")
    return out.select("item_id", "link", error_text(F.col("error")).alias("error_text"), "clean_content")


def q_store_round_trip(spark, sf_dir):
    import os
    import uuid
    from ..session import checkpoint_dir
    from ..sinks.table import insert_items, read_table
    path = os.path.join(checkpoint_dir(spark), "tables", f"news_item-{uuid.uuid4().hex}")
    insert_items(spark, filled_document_items(spark, sf_dir), path)
    back = read_table(spark, path)
    return back.select("channel", "title", "link", "description", "creators", "pub_date",
                       "categories", "keywords", "clean_content",
                       F.col("error.kind").alias("error_kind"), F.col("error.message").alias("error_message"))


def _feedback(spark, sf_dir):
    from ..operators.feedback import apply_feedback
    from ..sources.testdata import CONTRACT_NOW
    return apply_feedback(document_items(spark, sf_dir), ratings_from_labels(spark, sf_dir),
                          n=FEEDBACK_N, now=CONTRACT_NOW)


def q_feedback(spark, sf_dir):
    return _feedback(spark, sf_dir).select("item_id", "link", "relevance", "days_since_publication")


def q_csv_round_trip(spark, sf_dir):
    import os
    import uuid
    from ..schema import CSV_HEADER
    from ..session import checkpoint_dir
    from ..sinks.csv import read_csv, write_csv
    path = os.path.join(checkpoint_dir(spark), "csv", f"feedback-{uuid.uuid4().hex}")
    write_csv(_feedback(spark, sf_dir), path, FEEDBACK_DATE)
    back = read_csv(spark, path)
    names = {h: h.lower().replace(" ", "_") for h in CSV_HEADER}
    return back.select(*[F.coalesce(F.col(f"`{h}`"), F.lit("")).alias(names[h]) for h in CSV_HEADER])


def q_report_lines(spark, sf_dir):
    from ..sinks.reports import relevance_report_lines
    s = _scores(spark, sf_dir).select("item_id", F.col("net_relevance").alias("relevance"),
                                      "channel", "title", "link")
    # the report reads the scored list three times (per channel, numbering,
    # offsets): it is written once and read back
    return relevance_report_lines(materialize(s, "scored"))


def q_dossier_lines(spark, sf_dir):
    from ..sinks.reports import dossier_lines
    return dossier_lines(_two_phase(spark, sf_dir).top, RUN_TIME)


def q_item_log_lines(spark, sf_dir):
    from ..sinks.reports import item_log_lines
    return item_log_lines(_two_phase(spark, sf_dir).first_phase)


def q_extractive_summary(spark, sf_dir):
    from ..operators.summary import summarize
    return summarize(table(spark, sf_dir, "documents"), contract_lexicon(spark), "doc_id", "text")


def contract_queries() -> dict:
    from .landed import landed_queries
    return landed_queries() | {
        "q_items_normalised": q_items_normalised,
        "q_rejected_items": q_rejected_items,
        "q_channel_type": q_channel_type,
        "q_opt_in_or": q_opt_in_or,
        "q_opt_in_and": q_opt_in_and,
        "q_opt_in_empty": q_opt_in_empty,
        "q_dice_pairs": q_dice_pairs,
        "q_fuzzy_tokens": q_fuzzy_tokens,
        "q_similar_words": q_similar_words,
        "q_score_breakdown": q_score_breakdown,
        "q_top_k": q_top_k,
        "q_top_k_composite": q_top_k_composite,
        "q_relevance_by_channel": q_relevance_by_channel,
        "q_relevance_list": q_relevance_list,
        "q_contents_list": q_contents_list,
        "q_feed_lines": q_feed_lines,
        "q_rss_scan": q_rss_scan,
        "q_union_feeds": q_union_feeds,
        "q_clean_region": q_clean_region,
        "q_clean_text": q_clean_text,
        "q_clean_nested": q_clean_nested,
        "q_fill_content": q_fill_content,
        "q_two_phase": q_two_phase,
        "q_dedup_link": q_dedup_link,
        "q_insert_new": q_insert_new,
        "q_insert_batches": q_insert_batches,
        "q_page_store": q_page_store,
        "q_store_round_trip": q_store_round_trip,
        "q_feedback": q_feedback,
        "q_csv_round_trip": q_csv_round_trip,
        "q_report_lines": q_report_lines,
        "q_dossier_lines": q_dossier_lines,
        "q_item_log_lines": q_item_log_lines,
        "q_extractive_summary": q_extractive_summary,
    }
