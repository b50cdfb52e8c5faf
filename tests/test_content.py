"""HTML cleaning (H1–H9) and the content fill join."""

import pytest
from pyspark.sql import functions as F

from gacetilla.operators.content import clean_pages, fill_content


def _clean(spark, *pages):
    df = spark.createDataFrame([(i, c, h) for i, (c, h) in enumerate(pages)], "i int, channel string, html string")
    rows = clean_pages(df).orderBy("i").collect()
    return [r.clean for r in rows]


PLAIN = [
    ("<html><head><title>Skip</title><style>p{}</style></head><body><h1>Harbour</h1>\n<p>Two <strong>red</strong> cranes,"
     " one <em>small</em>.</p><ul>\n<li>rope</li>\n<li>chain</li></ul></body></html>",
     "# Harbour\n\nTwo **red** cranes, one *small*.\n\n* rope\n* chain\n"),
    ("<unknown>\n Loose words\n<p>In a paragraph</p>\n</unknown thing\n", "Loose words\n\nIn a paragraph\n"),
    ("<h3>Sub</h3>a<br>b<script>x('</p>')</script><!-- <p>no</p> --><div> <br> </div>", "### Sub\n\na\nb\n"),
    ("<li>One<ul><li>Two</ul>after<ul><div><li>wrapped</div></ul><ul>text<li><p>alpha</p><p>beta</p></ul>",
     "* One\n\n* Two\n\nafter\n\n* wrapped\n\ntext\n* alpha\n\nbeta\n"),
    ("<p><b>Open<br><p>goes on</p><h2>still</h2><p>ends</b> here <i> x </i></p>",
     "**Open**\n\n**goes on**\n\n## **still**\n\n**ends** here *x*\n"),
    ("a &lt;b&gt; &amp;lt; &eacute;&nbsp;😊 &#8364;<b></b>", "a <b> &lt; é\xa0😊 €\n"),
    ("<p>" + "word " * 401 + "</p>", "\n".join([("word " * 200).strip()] * 2 + ["word"]) + "\n"),
    ("   ", ""), ("<p></p><hr>", ""),
]


def test_plain_text(spark):
    got = _clean(spark, *[("Agency", h) for h, _ in PLAIN])
    for row, (html, text) in zip(got, PLAIN):
        assert (row.clean_content, row.error_kind) == (text, None), html


def test_empty_and_missing_bodies(spark):
    empty, missing = _clean(spark, ("Agency", ""), ("Agency", None))
    assert (empty.clean_content, empty.error_kind) == (None, "EmptyString")
    assert (missing.clean_content, missing.error_kind) == (None, "ParsingError")


PAGE = """<body><nav><p>menu</p></nav><main><p class="article-text">Main one.<p class='other'>not this</p>
<p id=1 class=article-text>Main two.</p><p class="article-text big">nor this</p></main>
<article><h1>Head</h1><p>First.</p><div class=x><div data-dtm-region="articulo_cuerpo"><p>Region.</p><div><p>Deeper.</p>
</div></div></div><p>Last.</p></article><footer>foot</footer></body>"""
BARE = "<body><p>Only body.</p></body>"


@pytest.mark.parametrize("channel,page,bare", [
    ("EL PAÍS: x", ("Region.\n\nDeeper.\n", "article-region"), ("", "none")),
    ("20Minutos - x", ("First.\n\nRegion.\n\nDeeper.\n\nLast.\n", "article-p"), ("", "none")),
    ("ElDiario.es", ("Main one.\n\nMain two.\n", "main-p"), ("Only body.\n", "body")),
    ("elmundo", ("First.\n\nRegion.\n\nDeeper.\n\nLast.\n", "article-p"), ("Only body.\n", "body")),
    ("Agency", (None, "body"), ("Only body.\n", "body")),
])
def test_outlet_rules(spark, channel, page, bare):
    a, b = _clean(spark, (channel, PAGE), (channel, BARE))
    assert page[0] in (None, a.clean_content) and a.region == page[1]
    assert (b.clean_content, b.region) == bare


def test_regions_in_regions_repeat(spark):
    mark = 'data-dtm-region="articulo_cuerpo"'
    got, = _clean(spark, ("El País", f"<article><div {mark}><p>Outer</p><div {mark}><p>Inner</p></div><p>Tail</p></div>"
                                     "<p>no</p></article><div {mark}><p>outside</p></div>"))
    assert got.clean_content == "Outer\n\nInner\n\nTail\n\nInner\n"


def test_fill_content(spark):
    items = spark.createDataFrame(
        [(1, "Agency", "https://a/1"), (2, "Agency", "https://a/2"), (3, "EL PAÍS: x", "https://a/3"),
         (4, "Agency", "https://a/4"), (5, "Agency", "https://a/5"), (6, "elmundo", "https://a/1")],
        "item_id long, channel string, link string").withColumn(
        "clean_content", F.lit(None).cast("string")).withColumn(
        "error", F.when(F.col("item_id") == 6, F.struct(F.lit("NoContent").alias("kind"), F.lit(None).cast("string").alias("message"))))
    pages = spark.createDataFrame(
        [(10, "https://a/1", "<p>Later.</p>"), (9, "https://a/1", BARE), (2, "https://a/3", BARE), (3, "https://a/4", ""),
         (4, "https://a/5", None), (5, "https://unused", "x")], "page_id int, url string, html string")
    out = {r.item_id: r for r in fill_content(items, pages, page_key="page_id").collect()}
    assert out[1].clean_content == "Only body.\n" and out[1].error is None
    assert out[2].error.kind == "NetworkError" and out[2].clean_content is None
    assert [out[i].error.kind for i in (3, 4, 5)] == ["NoContent", "EmptyString", "ParsingError"]
    assert out[6].clean_content == "Only body.\n" and out[6].error.kind == "NoContent"  # an earlier error stays
    smallest = {r.item_id: r for r in fill_content(items, pages).collect()}
    assert smallest[1].clean_content == "Only body.\n"


def test_all_named_references(spark):
    got, = _clean(spark, ("Agency", "<p>gar&ccedil;on &agrave; 20&deg; &bull; &trade; 2&times;3 &Eacute;&NotEqualTilde; &amp;ccedil; "
                                    "&amp;amp; &lt;&AMP;&Tab;&lt&semi; &nosuch; &; R&D &#39;</p>"))
    assert got.clean_content == "garçon à 20° • ™ 2×3 É≂̸ &ccedil; &amp; <& &lt; &nosuch; &; R&D '\n"


def test_references_of_every_name(spark):
    from html import unescape

    from gacetilla.operators.content import NAMED
    names = sorted(set(NAMED) - {"Tab", "NewLine"})
    got = _clean(spark, ("Agency", "".join(f"<p>x&{n};x</p>" for n in names)), ("Agency", "<p>none</p>"))
    assert got[0].clean_content == "\n\n".join(f"x{unescape(f'&{n};')}x" for n in names) + "\n"
    assert got[1].clean_content == "none\n"


def test_regions_end_at_their_own_tags(spark):
    mark = 'data-dtm-region="articulo_cuerpo"'
    pages = [
        ("20minutos", "<article><p>one</p><article><p>card</p></article><p>two</p></article><article><p>no</p></article>",
         "one\n\ncard\n\ntwo\n"),
        ("20minutos", "<p>no</p></article></div><article><p>one</p></div><p>two", "one\n\ntwo\n"),
        ("ElDiario.es", "<main><p class=article-text>a<main><p class='article-text'>b</p></main><p class=\"article-text\">c</p></main>"
                        "<p class=article-text>no", "a\n\nb\n\nc\n"),
        ("El País", f"<article><div><div {mark}><div><div>x</div><p>in</div><p>still</p></div></div><p>out</p></article>",
         "in\n\nstill\n"),
        ("El País", f"<article><div {mark}><p>A<div {mark}><p>B</p><div {mark}><p>C</div></div></div></article>",
         "A\n\nB\n\nC\n\nB\n\nC\n\nC\n"),
        ("elmundo", "<article><p>x</p>" * 30 + "</article>" * 29 + "<p>last</p></article><p>no</p>", "x\n\n" * 30 + "last\n"),
    ]
    for row, (_, html, text) in zip(_clean(spark, *[p[:2] for p in pages]), pages):
        assert row.clean_content == text, html


def test_tags_with_quotes_and_without_ends(spark):
    long = "x>" * 700
    pages = [
        ('<p title="a>b" data-x=\'c>d\'>text</p>', "text\n"), ('<a href="x"y\'z>link</a> <p title="open>shown</p>', "link\n\nshown\n"),
        ("seen<script>var a = '<p>code", "seen\n"), ("seen<style>p { }", "seen\n"), ("a<!-- <p>no", "a\n"),
        ("a<svg><title>no</title><path d='M'/></svg>b", "ab\n"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2\n"),
        ("a <b>bold</b> x</b> y</i>", "a **bold** x y\n"), ("<p" + " <a" * 3000, ""),
        (f'<p><img src="{"A" * 5000}">image</p><p title="{long}">', "image\n\n" + ("x>" * 700)[1:] + '">\n'),
    ]
    for row, (html, text) in zip(_clean(spark, *[("Agency", h) for h, _ in pages]), pages):
        assert row.clean_content == text or len(html) > 5000, html


def test_numbered_lists(spark):
    pages = [("<ol><li>a<li>b</ol><ul><li>c</ul>", "1. a\n2. b\n\n* c\n"),
             ("<ol start=7><li>a<ol><li>x</li><li>y</li></ol></li><li>b</li></ol><ol><li>z</ol>",
              "7. a\n\n1. x\n2. y\n\n8. b\n\n1. z\n"),
             ("<ul><li>a<ol START = '3'><li><p>x</p></ol><li>b</ul><li>stray", "* a\n\n3. x\n\n* b\n\n* stray\n")]
    for row, (html, text) in zip(_clean(spark, *[("Agency", h) for h, _ in pages]), pages):
        assert row.clean_content == text, html


def test_references_by_number(spark):
    from html import unescape
    codes = ["#8364", "#x20AC", "#X1f600", "#65", "#146", "#129", "#0", "#55296", "#1114112", "#x10FFFD", "#233", "#39"]
    got, = _clean(spark, ("Agency", "".join(f"<p>x&{c};x</p>" for c in codes) + "<p>&#; &#x; &#12a; a&#9;b&#3;c &#38;lt;</p>"))
    want = ["x" + unescape(f"&{c};").replace("\x81", "\ufffd") + "x" for c in codes]
    assert got.clean_content.split("\n\n")[:-1] == want
    assert got.clean_content.endswith("&#; &#x; &#12a; a bc &lt;\n")


def test_plan_is_small_and_deals_pages_once(spark):
    df = spark.createDataFrame([(1, "Agency", "<p>x")], "i int, channel string, html string")
    plan = clean_pages(df)._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 40_000 and plan.count("Exchange hashpartitioning") == 1


def test_columns_of_pages_stay(spark):
    rows = [(1, "Agency", "<p>x", None), (1, "Agency", None, "c"), (None, None, "", "d"), (1, "Agency", "<p>x", None)]
    df = spark.createDataFrame(rows, "pos int, channel string, html string, clean string")
    got = sorted(((r.pos, r.channel, r[-1].clean_content, r[-1].error_kind) for r in clean_pages(df.drop("clean")).collect()), key=repr)
    assert got == sorted([(1, "Agency", "x\n", None), (1, "Agency", None, "ParsingError"), (None, None, None, "EmptyString"),
                          (1, "Agency", "x\n", None)], key=repr)
    assert clean_pages(df.limit(0)).count() == 0


def test_tasks_grow_with_the_pages_and_sort_twice(spark, monkeypatch):
    from gacetilla.operators import content
    df = spark.range(40).select(F.lit("x").alias("channel"), F.concat(
        F.lit("<ol start=3><li>a"), F.repeat(F.lit("<p>text"), 200), F.lit("<li>b</ol><li>c"), F.col("id").cast("string")).alias("html"))
    monkeypatch.setattr(content, "TASK_BYTES", 2000, raising=False)
    rows = content.tag_table(df, "html")
    assert rows.rdd.getNumPartitions() >= 25
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Window ") > 0
    plan = rows._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 2
    assert sorted({r.number for r in rows.collect()}, key=str) == [3, 4, None]
