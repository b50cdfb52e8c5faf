"""Feed list (S1), RSS scan and item normalisation."""

import os

import pytest
from pyspark.sql import functions as F

from gacetilla.operators.dedup import first_per_key
from gacetilla.operators.normalize import rejected
from gacetilla.sources.feeds import read_feed_list
from gacetilla.sources.rss import load_items, read_feeds

HARBOUR = """<?xml version="1.0" encoding="UTF-8"?>
<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/" xmlns:media="http://search.yahoo.com/mrss/">
<channel><title><![CDATA[Puerto Norte]]></title>
<item><title><![CDATA[Grúas & barcos]]></title><link>https://puerto.test/a</link>
<description><![CDATA[<b>Tres</b> barcos nuevos]]></description><dc:creator>Ana Ruiz</dc:creator><dc:creator>Luis Gil</dc:creator>
<pubDate>Mon, 03 Jun 2024 07:05:00 GMT</pubDate><media:keywords>Muelle, Carga</media:keywords>
<category domain="x">Mar</category><category>Economía</category></item>
<item><title>Solo lo justo</title><link>https://puerto.test/b</link><description>Sin más</description></item>
<item><title></title><link>https://puerto.test/c</link><description>Título vacío</description></item>
<item><title>Sin descripción</title><link>https://puerto.test/d</link><description></description></item>
<item><link>https://puerto.test/e</link><description>Sin título</description></item>
</channel></rss>"""

VALLEY = """<rss version="2.0"><channel><title>ElDiario.es</title>
<item><title>Valle</title><link>https://valle.test/1</link><description>Río</description><category>Mar</category></item>
</channel></rss>"""


def _write(folder, **files):
    os.makedirs(folder, exist_ok=True)
    for name, text in files.items():
        with open(os.path.join(folder, f"{name}.xml"), "w", encoding="utf-8") as f:
            f.write(text)
    return folder


def test_feed_list_keeps_whole_lines_that_name_a_feed(spark, workdir):
    path = os.path.join(workdir, "feeds.txt")
    with open(path, "w") as f:
        f.write("https://uno.test/rss\n\n# https://no.test/rss\nsin dirección\n  véase http://dos.test/x  \n")
    rows = read_feed_list(spark, path).orderBy("line_no").collect()
    assert [r.url for r in rows] == ["https://uno.test/rss", "  véase http://dos.test/x  "]
    assert [r.line_no for r in rows] == [0, 4]


def test_line_numbers_over_several_splits(spark, workdir):
    path = os.path.join(workdir, "long.txt")
    with open(path, "w") as f:
        f.write("".join(f"http://feed{i}.test/{'x' * (i % 50)}\n" for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        feeds = read_feed_list(spark, path)
        assert feeds.rdd.getNumPartitions() > 3
        rows = feeds.collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted((r.line_no, r.url.split("/")[2]) for r in rows) == [(i, f"feed{i}.test") for i in range(3000)]


def test_items_of_a_channel(spark, workdir):
    folder = _write(os.path.join(workdir, "feeds"), puerto=HARBOUR)
    items = {r.link[-1]: r for r in load_items(spark, folder).collect()}
    assert set(items) == {"a", "b"}  # empty and missing required fields are rejected
    a, b = items["a"], items["b"]
    assert (a.channel, a.title, a.description) == ("Puerto Norte", "Grúas & barcos", "<b>Tres</b> barcos nuevos")
    assert (a.creators, a.categories, a.keywords) == ("Ana Ruiz,Luis Gil", "mar,economía", "muelle, carga")
    assert a.pub_date == "Mon, 03 Jun 2024 07:05:00 +0000"
    assert (b.creators, b.categories, b.keywords, b.pub_date) == ("", None, None, None)
    raw, _ = read_feeds(spark, folder)
    assert {r.item_id[-1]: r.reason for r in rejected(raw).collect()} == {
        "2": "No title", "3": "No description", "4": "No title"}


def test_bad_feeds_are_listed_and_the_others_read(spark, workdir):
    folder = _write(os.path.join(workdir, "feeds"), puerto=HARBOUR, valle=VALLEY, roto="<rss><channel><title>x</ti")
    missing = os.path.join(workdir, "none", "*.xml")
    raw, bad = read_feeds(spark, [folder, missing, "nofs://host/feed.xml"])
    assert raw.count() == 6
    reasons = {r.feed.rsplit("/", 1)[-1]: r.reason for r in bad.collect()}
    assert reasons["roto.xml"] == "feed could not be parsed" and reasons["*.xml"] == "feed not found"
    assert reasons["feed.xml"].startswith("feed could not be read") and len(reasons) == 3


def test_feeds_that_fail_while_they_are_read(spark, workdir):
    import gzip
    folder = _write(os.path.join(workdir, "feeds of today"), puerto=HARBOUR, valle=VALLEY, gone=HARBOUR)
    with gzip.open(f"{folder}/whole.xml.gz", "wt") as f:
        f.write(VALLEY)
    with open(f"{folder}/whole.xml.gz", "rb") as f:
        data = f.read()
    with open(f"{folder}/cut.xml.gz", "wb") as f:
        f.write(data[:len(data) // 2])
    open(f"{folder}/empty.xml", "w").close()
    raw, bad = read_feeds(spark, folder)
    os.remove(f"{folder}/gone.xml")  # after it was listed
    got = {r.feed.rsplit("/", 1)[-1]: r.reason for r in bad.collect()}
    assert got["cut.xml.gz"] == got["gone.xml"] == "feed could not be read"
    assert got["empty.xml"].startswith("feed could not be") and len(got) == 3
    assert raw.count() == 7 and raw.where("feed like '%whole%'").count() == 1


def test_large_feed_is_read_by_several_tasks(spark, workdir):
    from gacetilla.sources.rss import read_large_feeds
    item = "<item>\n<title>t{0} &amp; &lt;b&gt;</title><link>https://big/{0}</link><description><![CDATA[<p>{1}</p>]]></description></item>\n"
    many = "".join(item.format(i, "word " * 40) for i in range(2000))
    head = "<rss><channel>\n<image><url>u</url></image><title><![CDATA[Big & wide]]></title><link>l</link>"
    folder = _write(os.path.join(workdir, "big"), big=f"{head}{many}</channel></rss>", small=VALLEY,
                    torn=f"<rss><channel><title>Torn &amp; co</title><item><title>x</item>{item.format(7, 'y')}", page="<html>no</html>")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        items, bad = read_large_feeds(spark, folder)
        tasks = items.where("feed like '%big.xml'").select(F.spark_partition_id()).distinct().count()
        big = items.where("feed like '%big.xml'").orderBy("item_id").collect()
        rest = {(r.channel_title, r.title) for r in items.where("feed not like '%big.xml'").collect()}
        reasons = {(r.feed.rsplit("/", 1)[-1], r.reason) for r in bad.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 3
    assert [r.title for r in big] == [f"t{i} & <b>" for i in range(2000)] and {r.channel_title for r in big} == {"Big & wide"}
    assert ("Torn & co", "t7 & <b>") in rest and len(rest) == 2
    assert reasons == {("torn.xml", "item could not be parsed"), ("page.xml", "feed could not be parsed")}
    small, _ = read_feeds(spark, os.path.join(folder, "small.xml"))
    drop = lambda df: sorted(map(str, df.drop("pos", "item_id").collect()))
    assert drop(small) == drop(items.where("feed like '%small.xml'"))


@pytest.mark.parametrize("paths", ["missing", ["missing/a.xml", "missing/*"]])
def test_nothing_readable_is_empty(spark, workdir, paths):
    paths = [os.path.join(workdir, p) for p in ([paths] if isinstance(paths, str) else paths)]
    raw, bad = read_feeds(spark, paths)
    assert raw.count() == 0 and bad.count() == len(paths)
    assert load_items(spark, paths).count() == 0


def test_item_keys_sort_by_position(spark, workdir):
    many = "".join(f"<item><title>t{i}</title><link>https://same.test/</link><description>d</description></item>"
                   for i in range(12))
    folder = _write(os.path.join(workdir, "feeds"), many=f"<rss><channel><title>c</title>{many}</channel></rss>")
    items = load_items(spark, folder)
    assert [r.title for r in items.orderBy("item_id").collect()] == [f"t{i}" for i in range(12)]
    assert first_per_key(items.where("title in ('t2', 't10')"), "link").first().title == "t2"


def test_opt_in_on_loaded_items(spark, workdir):
    folder = _write(os.path.join(workdir, "feeds"), puerto=HARBOUR, valle=VALLEY)
    assert load_items(spark, folder, ["MUELLE"], "or").count() == 1   # lower-cased term
    assert load_items(spark, folder, ["mar", "carga"], "and").count() == 1
    assert load_items(spark, folder, ["mar", "carga"], "or").count() == 2
    assert load_items(spark, folder, [], "and").count() == 3


def test_large_feeds_are_dealt_by_blocks_of_ids(spark, workdir, monkeypatch):
    """No task writes a whole channel; the rows are those of one file per channel."""
    from gacetilla.plans import landed
    rows = [(i, f"Title {i}\nText {i} & more", "en", None if i == 9 else "src", 1) for i in [*range(60), 7]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{workdir}/documents.parquet")
    found, paths = {}, []
    folder = landed._folder
    monkeypatch.setattr(landed, "_folder", lambda s, name: paths.append(folder(s, name)) or paths[-1])
    for ids in (1000, 10):
        monkeypatch.setattr(landed, "LARGE_FEED_IDS", ids)
        found[ids] = sorted(map(str, landed.q_large_feeds(spark, workdir).collect()))
    assert found[10] == found[1000] and len(found[10]) > 55
    files = [spark.read.text(f"{p}/*").inputFiles() for p in paths if "large-feeds" in p]
    assert len(files[1]) > 4 * len(files[0])
