"""Fixed schemas of the item table, the RSS input and the stored table."""

from __future__ import annotations

from pyspark.sql import types as T

ERROR_TYPE = T.StructType([
    T.StructField("kind", T.StringType(), True),
    T.StructField("message", T.StringType(), True),
])

# §1.2: one news item.  ``item_id`` is our own deterministic key (the feed
# position or the source row id); the other fields follow the item record.
ITEM_FIELDS = [
    "item_id", "channel", "title", "link", "description", "creators", "pub_date",
    "categories", "keywords", "clean_content", "error", "relevance",
]

ITEM_SCHEMA = T.StructType([
    T.StructField("item_id", T.StringType(), False),
    T.StructField("channel", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("link", T.StringType(), False),
    T.StructField("description", T.StringType(), False),
    T.StructField("creators", T.StringType(), False),
    T.StructField("pub_date", T.StringType(), True),
    T.StructField("categories", T.StringType(), True),
    T.StructField("keywords", T.StringType(), True),
    T.StructField("clean_content", T.StringType(), True),
    T.StructField("error", ERROR_TYPE, True),
    T.StructField("relevance", T.LongType(), True),
])

# Raw item as it comes out of an RSS <item>: what normalisation reads.
RAW_ITEM_SCHEMA = T.StructType([
    T.StructField("title", T.StringType(), True),
    T.StructField("link", T.StringType(), True),
    T.StructField("description", T.StringType(), True),
    T.StructField("pubDate", T.StringType(), True),
    T.StructField("category", T.ArrayType(T.StringType()), True),
    T.StructField("dc:creator", T.ArrayType(T.StringType()), True),
    T.StructField("media:keywords", T.ArrayType(T.StringType()), True),
])

# from_xml schema for one RSS document (<rss><channel>…</channel></rss>).
RSS_SCHEMA = T.StructType([
    T.StructField("channel", T.StructType([
        T.StructField("title", T.StringType(), True),
        T.StructField("item", T.ArrayType(RAW_ITEM_SCHEMA), True),
    ]), True),
])

# K1: the stored table.  ``error`` is kept as its long text form so the
# message survives a round trip.
STORED_DDL = (
    "id BIGINT, channel STRING NOT NULL, title STRING NOT NULL, link STRING NOT NULL, "
    "description STRING NOT NULL, creators STRING, pub_date STRING, categories STRING, "
    "keywords STRING, clean_content STRING, error STRING"
)

# The feedback CSV header (K3), in order.
CSV_HEADER = [
    "Channel", "Title", "Link", "Description", "Creators", "Publication Date", "Categories",
    "Keywords", "Clean Content", "Error", "Feedback Date", "Relevance",
]
