"""Article content: HTML cleaning per outlet (H1–H9) and the content fill
join (J2).

A page is cut at its block tags into a tag table: one row for each segment, a
block tag and the text up to the next one, with its position in the page.
Windows over a page's rows give every container its depth, so that a tag meets
its own end tag (the next row of its kind at the same level), a list item the
list it stands in and its number, and every segment the bold or italic text
left open before it.  A page's segments are then put together again: outlet
rules choose them by the ranges of ``article``, ``main`` and marked ``div``
elements, and what is chosen is rendered (``# `` headings, ``**strong**``,
``*em*``, ``* `` and ``1. `` list items, blocks separated by one blank line,
lines wrapped at 1000 characters, one final newline).  Pages are dealt by row
once, before they are cut; windows and the final grouping stay in that
partitioning; how many tasks there are follows from the bytes of the pages, so a
task's share stays the same.  All of it is built-in functions.

The patterns keep to what both Java's and DuckDB's engines know (the possessive
marks are Java's, ``sql_pattern`` leaves them out); ``gacetilla.plans.oracle``
builds its SQL from the same fixed lists.

A paragraph ends at the next block tag; an element without end tag ends with the
page.  An end tag without start tag counts for nothing.  ``>`` inside quoted
attributes of up to 999 characters is part of the tag.  Raw text elements
without end tag reach to the end of the page.  Bold or italic text that a
segment leaves open goes on in the next one; nested bold counts once.
Character references by number, and by a name of HTML with a semicolon, are
decoded, once; unknown names stay as written.
"""

from __future__ import annotations

import math
from html.entities import html5

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.items import channel_type, make_error
from ..schema import ERROR_TYPE
from ..session import materialize
from ..sinks.table import bucket_of
from ..sources.pages import PageStore

WRAP_WIDTH = 1000
#: bytes of html that one task cuts at its tags
TASK_BYTES = 8 << 20

# Elements whose text is no content (raw ones reach to the end of
# the page when nothing closes them), block elements, and the outlet's article
# region.
RAW = ["script", "style", "title", "iframe"]
SKIPPED = ["noscript", "template", "svg", "object"]
BLOCK_TAGS = ("address|article|aside|blockquote|body|caption|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|"
              "figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hgroup|hr|html|li|main|menu|nav|ol|p|pre|section|summary|"
              "table|tbody|td|tfoot|th|thead|tr|ul")
REGION_ATTRIBUTE, REGION_VALUE = "data-dtm-region", "articulo_cuerpo"
PARAGRAPH_CLASS = "article-text"

# Character references by name that the DuckDB form knows; the
# Spark form decodes all names of HTML.
REFERENCES = {
    "nbsp": "\xa0", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "copy": "©", "reg": "®",
    "middot": "·", "hellip": "…", "mdash": "—", "ndash": "–", "laquo": "«", "raquo": "»", "lsquo": "‘", "rsquo": "’",
    "ldquo": "“", "rdquo": "”", "euro": "€", "iquest": "¿", "iexcl": "¡", "ordm": "º", "ordf": "ª",
    "aacute": "á", "eacute": "é", "iacute": "í", "oacute": "ó", "uacute": "ú", "ntilde": "ñ", "uuml": "ü",
    "Aacute": "Á", "Eacute": "É", "Iacute": "Í", "Oacute": "Ó", "Uacute": "Ú", "Ntilde": "Ñ", "Uuml": "Ü",
    "amp": "&",
}
NAMED = {n[:-1]: c for n, c in html5.items() if n.endswith(";")} | REFERENCES | {"Tab": " ", "NewLine": " "}
REFERENCE = "&(?:#[0-9]{1,9}|#[xX][0-9a-fA-F]{1,7}|[A-Za-z][A-Za-z0-9]*);"
#: numbers that stand for another character: those of the old Windows code page, white space, and the marks below
NUMBERED = {b: bytes([b]).decode("cp1252", "replace") for b in range(128, 160)} | {
    b: " " for b in (9, 10, 12, 13)} | {0: "\ufffd"} | {b: "" for b in range(1, 7)}

# Marks inside the working text.
BLOCK, BOLD, BOLD_END, EM, EM_END, LINE = (chr(i) for i in range(1, 7))

_QUOTED = r"""(?:[^>"']++|"[^"]{0,999}"|'[^']{0,999}')*+"""


def tag(names: str, end: str = "/?") -> str:
    """Pattern of the start (``end=""``) or end tags of some elements."""
    return rf"<{end}(?:{names})(?:(?:[\s/]{_QUOTED})?>|[\s/][^>]*>)"


ANY_TAG = rf"<[a-zA-Z/!?]{_QUOTED}>|<[a-zA-Z/!?][^>]*>"

#: page → tags and text alone; ``\1`` in a replacement is the first group
PREPARE = [(r"[\x01-\x06]", ""),
           (r"(?is)<!--.*?(?:-->|\z)|" + "|".join(tag(t, "") + rf".*?(?:</{t}\s*>|\z)" for t in RAW), ""),
           (r"(?is)" + "|".join(tag(t, "") + rf".*?</{t}\s*>" for t in SKIPPED), ""),
           (r"<[a-zA-Z/!?][^>]*\z", ""), (r"[ \t\n\r\f]+", " ")]

#: a mark before every block tag
SEGMENT = ("(?i)(" + tag(BLOCK_TAGS) + ")", BLOCK + r"\1")
NAME = "^</?([a-zA-Z0-9]+)"
OWN_TAG = ("(?i)^" + tag(BLOCK_TAGS), "")
MARKED = rf"""(?i)^<div\s(?:[^>]*\s)?{REGION_ATTRIBUTE} ?= ?(?:"{REGION_VALUE}"|'{REGION_VALUE}'|{REGION_VALUE}[\s>])"""
CLASSED = rf"""(?i)^<p\s(?:[^>]*\s)?class ?= ?(?:"{PARAGRAPH_CLASS}"|'{PARAGRAPH_CLASS}'|{PARAGRAPH_CLASS}[\s>])"""
START = r"""(?i)^<ol\s(?:[^>]*\s)?start ?= ?["']?([0-9]{1,9})"""

#: text of a segment behind its own tag → text with marks
INLINE = [OWN_TAG, ("(?i)" + tag("strong|b", ""), BOLD), ("(?i)" + tag("strong|b", "/"), BOLD_END),
          ("(?i)" + tag("em|i", ""), EM), ("(?i)" + tag("em|i", "/"), EM_END), ("(?i)" + tag("br", ""), LINE),
          (ANY_TAG, "")]
SOLID = r"[^ \x02-\x06]"

#: a segment with its open marks → text with lines still marked
EMPHASIS = ([(r"\x02([^\x02\x03]*)\x02", "\x02" + r"\1")] * 3 + [(r"\x04([^\x04\x05]*)\x04", "\x04" + r"\1")] * 3
            + [(r"\x03([^\x02\x03]*)\x03", "\x03" + r"\1")] * 3 + [(r"\x05([^\x04\x05]*)\x05", "\x05" + r"\1")] * 3
            + [(r"^([^\x02\x03]*)\x03", r"\1"), (r"^([^\x04\x05]*)\x05", r"\1"),
               (r"\x02[ \x06]*\x03", " "), (r"\x04[ \x06]*\x05", " "),
               (r"\x02([ \x06]*)", r"\1**"), (r"([ \x06]*)\x03", r"**\1"),
               (r"\x04([ \x06]*)", r"\1*"), (r"([ \x06]*)\x05", r"*\1")])
#: an item's sign joins the block that follows it
JOINED = (r"(\x06(?:\*|[0-9]+\.) )[ \x01]+", r"\1")


def sql_pattern(pattern: str) -> str:
    """The pattern without Java's possessive marks."""
    return pattern.replace("++", "+").replace("*+", "*")


def _replace(c: Column, steps) -> Column:
    for pattern, by in steps:
        c = F.regexp_replace(c, pattern, by.replace("$", r"\$").replace(r"\1", "$1"))
    return c


def _count(c: Column, mark: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(mark), F.lit("")))


def _bind(value: Column, body) -> Column:
    """``body(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def references(spark: SparkSession) -> DataFrame:
    """(ref_name, char) of every reference by name."""
    return spark.createDataFrame(list(NAMED.items()), "ref_name string, char string")


def _numbered(ref: Column) -> Column:
    """Character of a reference by number (``&#8364;``, ``&#x20AC;``), null for others."""
    digits = F.regexp_extract(ref, "^&#[xX]?([0-9a-fA-F]+);", 1)
    code = F.when(F.lower(F.substring(ref, 3, 1)) == "x", F.conv(digits, 16, 10)).otherwise(digits).cast("int")
    special = F.coalesce(*[F.when(code == b, F.lit(c)) for b, c in NUMBERED.items() if b < 32 or c != "\ufffd"])
    char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    bad = code.between(0xD800, 0xDFFF) | (code > 0x10FFFF) | (code.between(128, 159))
    return F.when(F.substring(ref, 2, 1) == "#", F.coalesce(special, F.when(bad, F.lit("\ufffd")).otherwise(char)))


def _decoded(rows: DataFrame, column: str) -> DataFrame:
    """Rows with ``column`` cut behind every reference, one row for each part
    (numbered by ``part``), the reference replaced by its character: a join
    with the table of names, about 2,100 rows.  Unknown names stay."""
    c = F.col(column)
    parts = rows.withColumn("_parts", F.arrays_zip(F.split(c, REFERENCE).alias("own"),
                                                   F.regexp_extract_all(c, F.lit(REFERENCE), 0).alias("ref")))
    parts = parts.select(*[x for x in rows.columns if x != column], F.posexplode_outer("_parts").alias("part", "_of"))
    ref = F.col("_of.ref")
    names = references(rows.sparkSession)
    found = parts.join(F.broadcast(names), F.substring(ref, 2, F.length(ref) - 2) == F.col("ref_name"), "left")
    return found.select(*[x for x in parts.columns if x != "_of"], F.concat(
        F.coalesce(F.col("_of.own"), F.lit("")),
        F.coalesce(F.col("char"), _numbered(ref), ref, F.lit(""))).alias(column))


#: kinds of containers whose depth is followed, by element
KINDS = {"article": "article", "main": "main", "div": "div", "ul": "list", "ol": "list"}


def tag_table(pages: DataFrame, html_col: str) -> DataFrame:
    """A row per segment of every page: ``_row`` (the page), ``pos``, ``name`` and
    ``closing`` of its tag, ``kind`` and ``level`` of a container, ``end`` (the
    position of a container's own end tag), ``text`` with marks, the emphasis
    open before and after it, and ``number`` of an item of a numbered list.
    Columns of the page stand in ``_page`` of its first row.  Pages without
    html have one row without position."""
    # the bytes of the pages say how many tasks there are, as a task sorts all its segments
    held = pages.agg(F.sum(F.octet_length(html_col))).first()[0] or 0
    cut = (pages.select(F.monotonically_increasing_id().alias("_row"), F.struct(*pages.columns).alias("_page"),
                        _replace(F.col(html_col), PREPARE).alias("_doc"))
           .withColumn("_page", F.col("_page").dropFields(html_col) if len(pages.columns) > 1 else F.col("_page"))
           .repartition(max(2, math.ceil(held / TASK_BYTES)), "_row"))
    seg = F.posexplode_outer(F.split(_replace(F.col("_doc"), [SEGMENT]), BLOCK)).alias("pos", "seg")
    rows = cut.select("_row", "_page", seg)
    s = F.col("seg")
    name, closing = F.lower(F.regexp_extract(s, NAME, 1)), s.startswith("</")
    known = F.create_map(*[F.lit(x) for both in KINDS.items() for x in both])
    rows = rows.select(
        "_row", F.when(F.coalesce(F.col("pos"), F.lit(0)) == 0, F.col("_page")).alias("_page"), "pos",
        name.alias("name"), closing.alias("closing"), known[name].alias("kind"),
        s.rlike(MARKED).alias("marked"), s.rlike(CLASSED).alias("classed"),
        F.when(name == "ol", F.regexp_extract(s, START, 1).try_cast("long")).alias("start"),
        _replace(s, INLINE).alias("text"))
    # running depths and open emphasis; an end tag without start tag leaves them at zero
    kinds = sorted(set(KINDS.values()))
    steps = {k: F.when(F.col("kind") == k, F.when(F.col("closing"), -1).otherwise(1)).otherwise(0) for k in kinds} | {
        "bold": _count(F.col("text"), BOLD) - _count(F.col("text"), BOLD_END),
        "em": _count(F.col("text"), EM) - _count(F.col("text"), EM_END)}
    page = Window.partitionBy("_row").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = page.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.sum(x).over(page).alias(f"_{k}") for k, x in steps.items()],
                       *[F.coalesce(F.sum(steps[k]).over(before), F.lit(0)).alias(f"_{k}0") for k in ("bold", "em")])
    rows = rows.select("*", *[F.least(F.lit(0), F.min(f"_{k}").over(page)).alias(f"_{k}_low") for k in steps],
                       *[F.least(F.lit(0), F.coalesce(F.min(f"_{k}").over(before), F.lit(0))).alias(f"_{k}_low0")
                         for k in ("bold", "em")])
    depth = {k: F.col(f"_{k}") - F.col(f"_{k}_low") for k in steps}
    kind = F.when(F.col("name") == "li", "list").otherwise(F.col("kind"))
    inside = F.coalesce(*[F.when(kind == k, depth[k]) for k in kinds])
    ends = F.col("closing") & (F.col("name") != "li")
    rows = rows.select(
        "_row", "_page", "pos", "name", "closing", "marked", "classed", "start", "text", kind.alias("kind"),
        (inside + F.when(ends, 1).otherwise(0)).alias("level"),
        *[(F.col(f"_{k}0") - F.col(f"_{k}_low0") > 0).alias(f"{k}_before") for k in ("bold", "em")],
        *[(depth[k] > 0).alias(f"{k}_after") for k in ("bold", "em")])
    # tags of a kind at one level come in turns: the next is a container's own end, and
    # an item belongs to the list that began last, which is known in the same order
    peers = Window.partitionBy("_row", "kind", "level").orderBy("pos")
    begins = (F.col("kind") == "list") & (F.col("name") != "li") & ~F.col("closing")
    is_item = (F.col("name") == "li") & ~F.col("closing")
    rows = rows.select("*", F.lead("pos").over(peers).alias("end"), F.sum(F.when(is_item, 1).otherwise(0)).over(peers).alias("_nth"))
    of = F.last(F.when(begins, F.struct("name", "start", "_nth")), ignorenulls=True).over(peers)
    rows = rows.select("*", of.alias("_list"))
    return rows.select("*", F.when(is_item & (F.col("_list.name") == "ol"), F.col("_nth") - F.col("_list._nth")
                                   + F.coalesce(F.col("_list.start"), F.lit(1)) - 1).alias("number")).drop("_nth", "_list")


def _written() -> Column:
    """A segment's text behind the mark of its tag."""
    name, opens = F.col("name"), ~F.col("closing")
    sign = (F.when((name == "li") & opens, F.concat(
                F.lit(LINE), F.when(F.col("number").isNotNull(), F.concat(F.col("number").cast("string"), F.lit(". ")))
                .otherwise(F.lit("* "))))
            .when(name == "li", LINE)
            .when(name.rlike("^h[1-6]$") & opens, F.concat(F.lit(BLOCK), F.repeat(F.lit("#"), F.substring(name, 2, 1).cast("int")), F.lit(" ")))
            .when(name.rlike(f"^({BLOCK_TAGS})$"), BLOCK).otherwise(""))
    text = F.concat(F.when(F.col("em_before"), EM).otherwise(""), F.when(F.col("bold_before"), BOLD).otherwise(""), F.col("text"),
                    F.when(F.col("bold_after"), BOLD_END).otherwise(""), F.when(F.col("em_after"), EM_END).otherwise(""))
    return F.concat(sign, F.when(F.col("text").rlike(SOLID), _replace(text, EMPHASIS)).otherwise(""))


def _page_text(marked: Column) -> Column:
    """H7: marked text to blocks and lines; ``''`` when it has none."""
    def line(x: Column) -> Column:
        x = F.trim(F.regexp_replace(x, " +", " "))
        # filled up to the width at spaces, longer words as they are
        return F.regexp_replace(F.regexp_replace(x, f"(.{{1,{WRAP_WIDTH}}})( |$)", "$1\n"), "\n$", "")

    def block(x: Column) -> Column:
        return F.array_join(F.filter(F.transform(F.split(x, LINE), line), lambda y: y != ""), "\n")

    done = F.filter(F.transform(F.split(_replace(marked, [JOINED]), BLOCK), block), lambda x: x != "")
    return _bind(done, lambda x: F.when(F.size(x) == 0, F.lit("")).otherwise(F.concat(F.array_join(x, "\n\n"), F.lit("\n"))))


def _chosen(outlet: Column):
    """(region, marked text) of a page by its outlet's rule."""
    END = (1 << 31) - 1
    inside = lambda x, r: (x.pos > r.pos) & (x.pos < F.coalesce(r.end, F.lit(END)))
    segs, marks, article, main = (F.col(f"_{c}") for c in ("segs", "marks", "article", "main"))
    text = lambda chosen: F.array_join(F.transform(chosen, lambda x: x.text), "")
    paragraphs = F.filter(segs, lambda x: x.paragraph & inside(x, article))
    regions = F.filter(marks, lambda m: inside(m, article))
    # the paragraphs of a region in a region come again
    repeated = F.flatten(F.transform(regions, lambda m: F.filter(segs, lambda x: x.paragraph & inside(x, m))))
    rules = [((outlet == "ElPais") | (outlet == "VeinteMinutos"), article.isNull(), "none", F.lit("")),
             (outlet == "ElPais", F.lit(True), "article-region", text(repeated)),
             (outlet == "VeinteMinutos", F.lit(True), "article-p", text(paragraphs)),
             (outlet == "ElDiario", main.isNotNull(), "main-p", text(F.filter(segs, lambda x: x.classed & inside(x, main)))),
             (outlet == "ElMundo", article.isNotNull(), "article-p", text(paragraphs))]
    region, marked = F.lit("body"), text(segs)
    for of, when, name, chosen in reversed(rules):
        region, marked = F.when(of & when, name).otherwise(region), F.when(of & when, chosen).otherwise(marked)
    return region, marked


def clean_pages(pages: DataFrame, channel_col: str = "channel", html_col: str = "html") -> DataFrame:
    """Pages with ``clean``, a STRUCT<clean_content, error_kind, error_message,
    region>: empty html is an ``EmptyString`` error, a missing body a
    ``ParsingError``.  ``region`` names the part that was taken, or ``none``.

    The html itself is not carried along: it is no column of the result.
    """
    state = F.when(F.col(html_col).isNull(), "ParsingError").when(F.col(html_col) == "", "EmptyString")
    rest = [c for c in pages.columns if c != html_col]
    rows = tag_table(pages.select(*rest, state.alias("_state"), channel_type(channel_col).alias("_outlet"), html_col), html_col)
    opens = lambda kind: (F.col("kind") == kind) & ~F.col("closing")
    place = F.struct("pos", "end")
    seg = F.struct("pos", "part", ((F.col("name") == "p") & ~F.col("closing")).alias("paragraph"), "classed", "text")
    columns = ["_row", "_page", "pos", "name", "closing", "kind", "end", "marked", "classed", _written().alias("text")]
    whole = (_decoded(rows.select(*columns), "text").groupBy("_row").agg(
        F.first("_page", ignorenulls=True).alias("_page"),
        F.sort_array(F.collect_list(F.when(F.col("text") != "", seg))).alias("_segs"),
        F.sort_array(F.collect_set(F.when(F.col("marked"), place))).alias("_marks"),
        F.min(F.when(opens("article"), place)).alias("_article"), F.min(F.when(opens("main"), place)).alias("_main")))
    region, marked = _chosen(F.col("_page._outlet"))
    done = whole.select("_page", region.alias("_region"), marked.alias("_marked"))
    bad = F.col("_page._state").isNotNull()
    text = lambda kind: F.lit(kind).cast("string")
    return done.select(
        *[F.col("_page").getField(c).alias(c) for c in rest],
        F.struct(F.when(bad, text(None)).otherwise(_page_text(F.col("_marked"))).alias("clean_content"),
                 F.col("_page._state").alias("error_kind"),
                 F.when(F.col("_page._state") == "ParsingError", "page body could not be decoded").alias("error_message"),
                 F.when(bad, "none").otherwise(F.col("_region")).alias("region")).alias("clean"))


def _taken_pages(links: DataFrame, pages: DataFrame, url_col: str, html_col: str, page_key: str | None,
                 buckets: int | None) -> DataFrame:
    """(url, _html) of one page per wanted url: the first by page key (else the
    smallest body).  The links cut the page table first, the choice is made on
    narrow rows, and a body is read only for the chosen page.  In a store with
    buckets the links' buckets are part of the key, so that Spark reads no
    other ones while the links are few."""
    key = [url_col]
    if buckets:
        # written once, so Spark knows their bytes when it plans; the comparison makes them a filter in its eyes
        links = materialize(links.withColumn("bucket", bucket_of(url_col, buckets)), "wanted-links").where(F.col(url_col) != "")
        key = ["bucket", url_col]
    needed = pages.join(links, key, "left_semi")
    if page_key is None:
        return needed.groupBy(url_col).agg(F.min(html_col).alias("_html"))
    first = needed.select(*key, page_key).groupBy(*key).agg(F.min(page_key).alias(page_key))
    return needed.join(first, [*key, page_key], "left_semi").select(url_col, F.col(html_col).alias("_html"))


def fill_content(items: DataFrame, pages: DataFrame | PageStore, url_col: str = "url", html_col: str = "html",
                 page_key: str | None = None, clean: bool = True) -> DataFrame:
    """Fill ``clean_content`` / ``error`` of items from landed pages.

    * no page for the link → ``NetworkError``;
    * page body null → ``ParsingError``; body '' → ``EmptyString``;
    * cleaned text empty → ``NoContent``; otherwise the text.

    An item that carries an error keeps it unless one of these replaces it.
    ``page_key`` (unique per page) chooses among pages of one url.  ``pages`` is
    a table or a store laid out in buckets (``sources.pages``), of which the
    links' buckets are read.
    ``clean=False`` takes the landed body as text (an already-extracted
    article store).
    """
    buckets = None
    if isinstance(pages, PageStore):
        pages, buckets = pages.pages, pages.buckets
    links = items.select(F.col("link").alias(url_col)).distinct()
    one = _taken_pages(links, pages, url_col, html_col, page_key, buckets).withColumnRenamed(url_col, "_url")
    joined = items.join(one.withColumn("_landed", F.lit(True)), F.col("link") == F.col("_url"), "left")
    body = F.col("_html")
    if clean:
        joined = clean_pages(joined, "channel", "_html").withColumnRenamed("clean", "_clean")
    else:
        joined = joined.withColumn("_clean", F.struct(
            F.when(body != "", body).alias("clean_content"),
            F.when(body.isNull(), F.lit("ParsingError")).when(body == "", F.lit("EmptyString")).alias("error_kind"),
            F.when(body.isNull(), F.lit("page body could not be decoded")).alias("error_message")))
    kind, text = F.col("_clean.error_kind"), F.col("_clean.clean_content")
    missing = F.col("_landed").isNull()
    error = (F.when(missing, make_error(F.lit("NetworkError"), F.concat(F.lit("no landed page for "), F.col("link"))))
             .when(kind.isNotNull(), make_error(kind, F.col("_clean.error_message")))
             .when(text == "", make_error("NoContent"))
             .otherwise(F.col("error") if "error" in items.columns else F.lit(None).cast(ERROR_TYPE)))
    content = F.when(missing | kind.isNotNull() | (text == ""), F.lit(None).cast("string")).otherwise(text)
    return joined.select(*[content.alias(c) if c == "clean_content" else error.alias(c) if c == "error" else F.col(c)
                           for c in items.columns])
