"""Item views over the shared test tables (``documents``, ``pages``, ``labels``).

The test tables are not RSS feeds, so the views below map them onto the
item model.  Every rule here is deterministic and row-local (no rows are
dropped or sampled), and each one is mirrored by SQL in
``gacetilla.plans.oracle`` so DuckDB can check the Spark results.

documents → raw RSS items:

* key ``item_id`` = ``doc_id``;
* channel title by ``doc_id % 5``: an El País, 20 Minutos, elDiario and
  El Mundo title, else the ``source`` name (an "Other" outlet);
* title = the first line of ``text``; description = the rest of the text
  (null for one-line texts, which the required-field filter then rejects);
* link = ``https://example.org/doc/<doc_id>``;
* pubDate = 2024-01-01 plus ``doc_id`` × 3607 s, RFC 2822, written with
  ``GMT`` on even ids and ``+0000`` on odd ones;
* category = [upper(lang), "Sección <source>"], none when ``doc_id % 7 = 0``;
* dc:creator = ["Redacción <source>"], none when ``doc_id % 3 = 0``;
* media:keywords = one element with the first three words joined by ", ",
  absent when ``doc_id % 11 = 0``.

news items (filled) = the normalised items, with ``clean_content`` = the
whole ``text``, except that ``doc_id % 13 = 0`` carries a ``NoContent``
error (and no content).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.items import make_error
from ..functions.text import first_line, split_whitespace
from ..operators.normalize import normalise
from ..schema import ERROR_TYPE
from .tables import read_table

# Channel titles given to the test documents.
TEST_CHANNELS = [
    "EL PAÍS: el periódico global",
    "20MINUTOS - Últimas noticias",
    "ElDiario.es",
    "ELMUNDO - Portada",
]
BASE_EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
STEP_SECONDS = 3607
CONTRACT_NOW = "2025-01-01 00:00:00"  # fixed "now" for date arithmetic
CONTRACT_EXTRA_ROOTS = ["ertion", "worthless", "pour", "éeaument"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, f"{sf_dir.rstrip('/')}/{name}.parquet")


def _channel_title(doc_id, source):
    expr = source
    for i in reversed(range(len(TEST_CHANNELS))):
        expr = F.when((doc_id % 5) == i, F.lit(TEST_CHANNELS[i])).otherwise(expr)
    return expr


def raw_items_from_documents(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    d = F.col("doc_id")
    text = F.col("text")
    title = first_line(text)
    ts = F.timestamp_seconds(F.lit(BASE_EPOCH) + d * STEP_SECONDS)
    return docs.select(
        d.alias("item_id"),
        _channel_title(d, F.col("source")).alias("channel_title"),
        title.alias("title"),
        F.concat(F.lit("https://example.org/doc/"), d.cast("string")).alias("link"),
        F.when(text.contains("\n"), F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)"))
         .alias("description"),
        F.concat(F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "EEE, dd MMM yyyy HH:mm:ss"),
                 F.when(d % 2 == 0, F.lit(" GMT")).otherwise(F.lit(" +0000"))).alias("pubDate"),
        F.when(d % 7 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(F.upper("lang"), F.concat(F.lit("Sección "), F.col("source"))))
         .alias("category"),
        F.when(d % 3 == 0, F.array().cast("array<string>"))
         .otherwise(F.array(F.concat(F.lit("Redacción "), F.col("source")))).alias("dc:creator"),
        F.when(d % 11 == 0, F.lit(None).cast("array<string>"))
         .otherwise(F.array(F.array_join(F.slice(split_whitespace(text), 1, 3), ", ")))
         .alias("media:keywords"),
        *([text.alias("_text")] if keep_text else []),
    )


def document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised items from ``documents`` (metadata only, no content yet)."""
    return normalise(raw_items_from_documents(table(spark, sf_dir, "documents")))


def filled_document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items with their content filled in (the state after the content step)."""
    raw = raw_items_from_documents(table(spark, sf_dir, "documents"), keep_text=True)
    items = normalise(raw, extra=["_text"])
    errored = (F.col("item_id") % 13) == 0
    head = [c for c in items.columns if c not in ("clean_content", "error", "relevance", "_text")]
    return items.select(
        *head,
        F.when(errored, F.lit(None).cast("string")).otherwise(F.col("_text")).alias("clean_content"),
        F.when(errored, make_error("NoContent")).otherwise(F.lit(None).cast(ERROR_TYPE)).alias("error"),
        F.lit(None).cast("long").alias("relevance"))


def content_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landed article bodies keyed by URL: one per document (plain text)."""
    return table(spark, sf_dir, "documents").select(
        F.concat(F.lit("https://example.org/doc/"), F.col("doc_id").cast("string")).alias("url"),
        F.col("text").alias("body"))


# Fixed value: channel title of the pages not given to a named outlet.
OTHER_PAGE_CHANNEL = "Agencia de noticias"


def page_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose link is a landed page: one per ``pages`` row.

    Channel by ``page_id % 5`` as for documents (else an "Other" outlet),
    title = the page's ``<title>`` text, link = ``url``, empty description.
    """
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").select(
        F.concat(F.lit("page:"), p.cast("string")).alias("item_id"),
        _channel_title(p, F.lit(OTHER_PAGE_CHANNEL)).alias("channel"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.col("url").alias("link"),
        F.lit("").alias("description"), F.lit("").alias("creators"),
        F.lit(None).cast("string").alias("pub_date"), F.lit(None).cast("string").alias("categories"),
        F.lit(None).cast("string").alias("keywords"), F.lit(None).cast("string").alias("clean_content"),
        F.lit(None).cast(ERROR_TYPE).alias("error"), F.lit(None).cast("long").alias("relevance"))


def pages_with_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("page_id")
    return table(spark, sf_dir, "pages").withColumn(
        "channel", _channel_title(p, F.lit(OTHER_PAGE_CHANNEL)))


def ratings_from_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings table ``(link, rating STRING)`` derived from ``labels``:
    ``(doc_id + 2*quality + 3*toxic) % 7``, so 0 and 6 (skips) occur."""
    lab = table(spark, sf_dir, "labels")
    return lab.select(
        F.concat(F.lit("https://example.org/doc/"), F.col("doc_id").cast("string")).alias("link"),
        ((F.col("doc_id") + 2 * F.col("quality") + 3 * F.col("toxic")) % 7).cast("string").alias("rating"))


# Text around a page that puts it into containers of the kinds
# the outlets' rules look for, with containers of the same kind inside; @ is
# the page's number.
NESTED = (
    """<!DOCTYPE html><body><p>before</p><main data-x="a>b"><article class='top > x'><p title="1>0">Lead @.</p>"""
    """<div><div data-dtm-region="articulo_cuerpo" title='c>d'><p class="article-text">Region @.</p><div><article>"""
    """<p class=article-text>Card <em>@</em>.</p></article><div data-dtm-region='articulo_cuerpo'><p>Inner @.</p></div></div>""",
    """<p class='article-text'>After &#8364; &#x20AC; &#146;@&#146; &eacute;.</p><ol start="@"><li>One<li><p>Two</p>"""
    """<ul><li>Deep</ul></li><li>Three</ol><ol><li>First</ol></div></div><p>Tail @.</p></article></div><main><p class="article-text">"""
    """Main in main.</p></main><p class="article-text">Still main @.</p></main><p class="article-text">Outside.</p>"""
    """<article><p>Second article @.</p></article><script>var t = "<p>never";""")


def nested_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page of ``pages`` inside nested ``article``, ``main`` and ``div``
    elements, with ``>`` in attributes, numbered lists, references by number
    and a script that nothing closes."""
    number = F.col("page_id").cast("string")
    before, after = (F.replace(F.lit(x), F.lit("@"), number) for x in NESTED)
    return pages_with_channel(spark, sf_dir).withColumn("html", F.concat(before, F.col("html"), after))
