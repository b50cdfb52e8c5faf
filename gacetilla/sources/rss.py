"""RSS scan (S2–S4, U1) and the opted-in item load.

Landed RSS files are read whole (one row per file), parsed with Spark's XML
functions into the channel struct, and flattened to one row per item with
the channel title carried along.  A file that does not parse lands in the
``_corrupt_record`` column and is split off into a side table; the other
feeds go on (per-feed fault tolerance).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.normalize import normalise
from ..operators.optin import lower_terms, opt_in
from ..schema import RSS_SCHEMA
from ..session import existing_paths

XML_OPTIONS = {"mode": "PERMISSIVE", "ignoreSurroundingSpaces": "false",
               "columnNameOfCorruptRecord": "_corrupt_record"}


def parse_rss(docs: DataFrame, text_col: str = "value") -> DataFrame:
    """Add ``rss`` (the parsed document) to rows holding RSS XML text.
    A document that does not parse gets a null ``rss.channel``."""
    return docs.withColumn("rss", F.from_xml(F.col(text_col), RSS_SCHEMA, XML_OPTIONS))


def channel_items(parsed: DataFrame, feed_col: str = "feed") -> DataFrame:
    """One row per item: feed, position in the channel, channel title and
    the raw item fields (as the item struct of the schema)."""
    return (parsed.where(F.col("rss.channel").isNotNull())
                  .select(feed_col, F.col("rss.channel.title").alias("channel_title"),
                          F.posexplode("rss.channel.item").alias("pos", "item"))
                  .select(feed_col, "pos", "channel_title", "item.*"))


def item_key(feed: Column, pos: Column) -> Column:
    """Deterministic item key: feed name and position in it, padded so that
    keys sort by position."""
    return F.concat(feed, F.lit("#"), F.lpad(pos.cast("string"), 10, "0"))


def read_feeds(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """Read every landed RSS file under ``paths`` (a path, glob or
    list) as one union of items.  Returns (raw items, bad feeds).

    Each path is looked up by itself (names only): one that names nothing, or
    cannot be looked up, goes to the bad feeds with its reason, the others are
    read.  A file that does not parse is a bad feed too, and so is one that was
    found but gave no document when it was read (cut off inside a compressed
    stream, or gone since): the names found are held against those read.
    """
    found, missing = [], []
    for path in dict.fromkeys([paths] if isinstance(paths, str) else paths):
        try:
            names = existing_paths(spark, path)
            reason = "feed not found"
        except Exception as error:
            names, reason = [], f"feed could not be read: {str(error).splitlines()[0][:200]}"
        found += names
        if not names:
            missing.append((path, reason))
    tolerant = spark.read.option("ignoreCorruptFiles", "true").option("ignoreMissingFiles", "true")
    docs = (tolerant.text(list(dict.fromkeys(found)), wholetext=True) if found
            else spark.createDataFrame([], "value string"))
    parsed = parse_rss(docs.withColumn("feed", F.input_file_name()))
    # names alone; Spark holds them to plan the scan
    names = spark.createDataFrame([(x,) for x in docs.inputFiles()], "feed string")
    read = parsed.select(F.col("feed").alias("read"), F.col("rss.channel").isNotNull().alias("parsed"))
    bad = names.join(read, F.col("feed") == F.col("read"), "left").where(~F.coalesce("parsed", F.lit(False))).select(
        "feed", F.when(F.col("read").isNull(), "feed could not be read").otherwise("feed could not be parsed").alias("reason"))
    bad = bad.unionByName(spark.createDataFrame(missing, "feed string, reason string"))
    items = channel_items(parsed).withColumn("item_id", item_key(F.col("feed"), F.col("pos")))
    return items, bad


ITEM_END = "</item>"
_OPEN = '<rss xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/"><channel>'


def read_large_feeds(spark: SparkSession, paths) -> tuple[DataFrame, DataFrame]:
    """S2 for feeds too large for one row: (raw items, bad feeds), the columns
    of ``read_feeds``.

    Files are read as text cut at the end tags of their items, so a file is
    split over tasks like any other text and a row is one item.  What stands
    before the first item of a file holds the channel's title, which is joined
    to the file's items (one narrow row a file).  Items keep their order by the
    place of their block and their row in it; these keys change with
    ``spark.sql.files.maxPartitionBytes``.  Bad are items that do not parse and
    files without a channel.  An end tag of an item inside CDATA would cut there.
    """
    text = spark.read.option("lineSep", ITEM_END).text(paths).select(
        F.input_file_name().alias("feed"), F.col("_metadata.file_block_start").alias("block"),
        # the row of its task in the lower bits
        F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("row"), "value")
    start = F.regexp_instr("value", F.lit(r"<item[\s>]"))
    rows = text.withColumn("head", F.when(start > 0, F.substring("value", F.lit(1), start - 1)).otherwise(F.col("value"))
                           ).withColumn("item", F.when(start > 0, F.substring("value", start, F.length("value"))))
    # heads are short but for text between items
    heads = (rows.where(F.col("head").contains("<channel"))
             .select("feed", F.concat(F.substring("head", F.locate("<channel", F.col("head")), F.length("head")),
                                      F.lit("</channel></rss>")).alias("value"))
             .select("feed", parse_head("value").alias("channel_title")).groupBy("feed").agg(F.min("channel_title").alias("channel_title")))
    items = parse_rss(rows.where(F.col("item").isNotNull())
                      .withColumn("value", F.concat(F.lit(_OPEN), "item", F.lit(ITEM_END + "</channel></rss>"))))
    good = (items.where(F.col("rss.channel").isNotNull())
            .select("feed", "block", "row", F.explode("rss.channel.item").alias("it")).join(heads, "feed"))
    key = F.concat("feed", F.lit("#"), F.lpad(F.col("block").cast("string"), 15, "0"), F.lit("-"),
                   F.lpad(F.col("row").cast("string"), 10, "0"))
    bad = (items.where(F.col("rss.channel").isNull()).select("feed", F.lit("item could not be parsed").alias("reason"))
           .unionByName(rows.select("feed").distinct().join(heads, "feed", "left_anti")
                        .select("feed", F.lit("feed could not be parsed").alias("reason"))))
    return good.select("feed", "channel_title", "it.*", key.alias("item_id")), bad


def parse_head(c) -> Column:
    """Title of a channel from the text that starts with its tag."""
    title = F.regexp_extract(F.col(c), r"(?s)<title[^>]*>\s*(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?\s*</title>", 1)
    plain = F.from_xml(F.concat(F.lit("<x><t>"), title, F.lit("</t></x>")), "t string", {"ignoreSurroundingSpaces": "false"})
    cdata = F.col(c).rlike(r"(?s)^.*?<title[^>]*>\s*<!\[CDATA\[")
    return F.when(cdata, title).otherwise(plain["t"])


def load_items(spark: SparkSession, paths, opt_in_terms=(), op: str = "or",
               lower: bool = True) -> DataFrame:
    """Read, flatten, normalise, required-field filter and opt-in filter.

    The item list is not shuffled here: ranking applies its own deterministic
    order (a seeded shuffle is available as ``random_order``, P9).
    """
    raw, _bad = read_feeds(spark, paths)
    items = normalise(raw)
    terms = lower_terms(opt_in_terms) if lower else list(opt_in_terms or [])
    return opt_in(items, terms, op)


def _xml_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")),
                     F.lit(">"), F.lit("&gt;"))


def _element(tag: str, value: Column) -> Column:
    return F.when(value.isNull(), F.lit("")).otherwise(
        F.concat(F.lit(f"<{tag}>"), _xml_escape(value), F.lit(f"</{tag}>")))


def _elements(tag: str, values: Column) -> Column:
    """One element per array entry (nothing for a null array)."""
    return F.coalesce(F.array_join(F.transform(values, lambda v: _element(tag, v)), ""), F.lit(""))


def rss_elements(raw: DataFrame) -> Column:
    """The ``<item>`` element of each raw item row."""
    return F.concat(
        F.lit("<item>"),
        _element("title", raw["title"]), _element("link", raw["link"]),
        _element("description", raw["description"]), _element("pubDate", raw["pubDate"]),
        _elements("category", raw["category"]), _elements("dc:creator", raw["`dc:creator`"]),
        _elements("media:keywords", raw["`media:keywords`"]),
        F.lit("</item>"))


def rss_document(raw: DataFrame) -> DataFrame:
    """Write each raw item row as a one-item RSS document (``value``): the
    inverse of ``parse_rss`` + ``channel_items``, used to land items as
    feeds."""
    doc = F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" '
              'xmlns:media="http://search.yahoo.com/mrss/"><channel>'),
        _element("title", F.col("channel_title")), rss_elements(raw), F.lit("</channel></rss>"))
    return raw.select("item_id", doc.alias("value"))
