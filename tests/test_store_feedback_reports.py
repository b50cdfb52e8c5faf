"""Stored table (K1, K2, S5, A6, J4), CSV (K3), feedback (S7, P8, J3, X16),
reports (A5, K4–K7, W1, W2, X14, X18), summary (C5)."""

import os

from pyspark.sql import functions as F

from gacetilla.functions.dates import days_since, parse_rfc2822
from gacetilla.functions.formatting import anchor, number_text
from gacetilla.functions.items import error_text, make_error, parse_error
from gacetilla.operators.dedup import first_per_key, rows_to_insert
from gacetilla.operators.feedback import apply_feedback, valid_rating
from gacetilla.operators.rank import number_all
from gacetilla.sinks.csv import read_csv, write_csv
from gacetilla.sinks.reports import relevance_report_lines, write_report
from gacetilla.sinks.table import insert_items, read_table


def _items(spark, n=4, dup=False):
    rows = []
    for i in range(n):
        link = f"https://e/{i % 2 if dup else i}"
        rows.append((i, "ElDiario.es" if i % 2 else "Other", f"Title {i}", link, f"desc {i}",
                     "", "Thu, 21 Mar 2024 18:32:48 +0000", None, None, None, None, None))
    schema = ("item_id long, channel string, title string, link string, description string, creators string, "
              "pub_date string, categories string, keywords string, clean_content string, "
              "error struct<kind:string,message:string>, relevance long")
    return spark.createDataFrame(rows, schema)


def test_dedup_first_wins(spark):
    out = {r.link: r.item_id for r in first_per_key(_items(spark, 6, dup=True), "link", ["item_id"]).collect()}
    assert out == {"https://e/0": 0, "https://e/1": 1}
    again = first_per_key(first_per_key(_items(spark, 6, dup=True)), "link")
    assert again.count() == 2  # idempotent


def test_insert_is_if_absent(spark, workdir):
    path = os.path.join(workdir, "news_item")
    assert insert_items(spark, _items(spark, 4), path) == 4
    assert insert_items(spark, _items(spark, 6), path) == 2
    assert insert_items(spark, _items(spark, 6), path) == 0
    assert read_table(spark, path).count() == 6


def test_error_round_trip(spark, workdir):
    items = _items(spark, 3).withColumn(
        "error", F.when(F.col("item_id") == 0, make_error("NoContent"))
                  .when(F.col("item_id") == 1, make_error(F.lit("NetworkError"), F.lit("timed out (x)")))
                  .otherwise(F.lit(None).cast("struct<kind:string,message:string>")))
    path = os.path.join(workdir, "t")
    insert_items(spark, items, path)
    back = {r.title: r.error for r in read_table(spark, path).collect()}
    assert back["Title 0"].kind == "NoContent" and back["Title 0"].message is None
    assert back["Title 1"].kind == "NetworkError" and back["Title 1"].message == "timed out (x)"
    assert back["Title 2"] is None


def test_parse_error_texts(spark):
    df = spark.createDataFrame([("None",), (None,), ("EmptyString",), ("ParsingError(bad)",), ("weird",)], "t string")
    got = [tuple(r.e) if r.e else None for r in df.select(parse_error("t").alias("e")).collect()]
    assert got == [None, None, ("EmptyString", None), ("ParsingError", "bad"), ("UnknownError", None)]
    txt = spark.range(1).select(error_text(make_error(F.lit("ParsingError"), F.lit("m"))).alias("x")).first().x
    assert txt == "ParsingError(m)"


def test_ratings_filter(spark):
    df = spark.createDataFrame([("1",), ("5",), ("0",), ("6",), ("x",), (None,), (" 3 ",)], "r string")
    assert [r.v for r in df.select(valid_rating("r").alias("v")).collect()] == [1, 5, None, None, None, None, 3]


def test_feedback_join_and_days(spark):
    ratings = spark.createDataFrame([("https://e/0", "4"), ("https://e/1", "0"), ("https://e/3", "2")],
                                    "link string, rating string")
    out = apply_feedback(_items(spark, 4), ratings, n=3, now="2024-03-31 18:32:48").collect()
    assert {(r.item_id, r.relevance) for r in out} == {(0, 4)}
    assert out[0].days_since_publication == 10
    df = spark.createDataFrame([("Thu, 21 Mar 2024 18:32:48 +0000",), (None,), ("junk",)], "d string")
    assert [r.x for r in df.select(days_since("d", "2024-03-22 18:32:47").alias("x")).collect()] == [0, 0, None]


def test_csv_round_trip(spark, workdir):
    items = _items(spark, 2).withColumn("relevance", F.lit(5).cast("long")).withColumn(
        "description", F.lit('multi\nline, "quoted"'))
    path = os.path.join(workdir, "fb.csv")
    write_csv(items, path, "Wed, 01 Jan 2025 00:00:00 +0000")
    back = read_csv(spark, path).collect()
    assert len(back) == 2
    r = back[0]
    assert r["Description"] == 'multi\nline, "quoted"'
    assert r["Error"] == "None" and r["Relevance"] == "5"
    assert r["Feedback Date"] == "Wed, 01 Jan 2025 00:00:00 +0000"


def test_csv_keeps_white_space(spark, workdir):
    items = _items(spark, 1).withColumn("title", F.lit("  padded  ")).withColumn(
        "description", F.lit("\nlead and tail \n")).withColumn("creators", F.lit('a "b", c\\'))
    write_csv(items, f"{workdir}/ws.csv", "d")
    r = read_csv(spark, f"{workdir}/ws.csv").first()
    assert (r["Title"], r["Description"], r["Creators"]) == ("  padded  ", "\nlead and tail \n", 'a "b", c\\')


def test_dates_of_rfc2822(spark):
    forms = {"Thu, 21 Mar 2024 18:32:48 +0000": 0, "21 Mar 2024 18:32 GMT": 48, "Thu, 21 Mar 24 13:32:48 EST": 0,
             "thu, 21 mar 2024 20:32:48 +0200": 0, "Thu,  1 Mar 2024 00:00:00 UT": 1794768,
             "Thu, 21 Mar 2024 11:32:48 PDT (Pacific)": 0, "Thu, 21 Mar 2024 18:32:48 Z": 0}
    df = spark.createDataFrame([(x,) for x in forms], "d string")
    got = df.select(F.unix_timestamp(parse_rfc2822("d")).alias("t")).collect()
    assert [1711045968 - r.t for r in got] == list(forms.values())
    bad = ["", "junk", "31 Feb 2024 10:00:00 GMT", "Thu, 21 Mar 2024 25:00:00 GMT", "21 Mrz 2024 10:00:00 GMT", None]
    df = spark.createDataFrame([(x,) for x in bad], "d string")
    assert all(r.t is None for r in df.select(parse_rfc2822("d").alias("t")).collect())


def test_report_is_appended(spark, workdir):
    def text():
        names = sorted(f for f in os.listdir(f"{workdir}/r") if f.startswith("part-"))
        return "".join(open(f"{workdir}/r/{f}").read() for f in names)

    def lines(word):
        return spark.range(0, 40, numPartitions=5).select(
            F.lit(0).alias("section"), (39 - F.col("id")).alias("ord"),
            F.concat(F.lit(word), (39 - F.col("id")).cast("string")).alias("line"))

    once = lambda word: "".join(f"{word}{i}\n" for i in range(40))
    write_report(lines("a"), f"{workdir}/r")
    write_report(lines("b"), f"{workdir}/r")
    assert text() == once("a") + once("b")
    write_report(lines("c"), f"{workdir}/r", mode="overwrite")
    assert text() == once("c")


def _report(workdir):
    names = sorted(f for f in os.listdir(f"{workdir}/r") if f.startswith("part-"))
    return "".join(open(f"{workdir}/r/{f}").read() for f in names)


def test_failed_run_leaves_the_report(spark, workdir):
    import pytest
    from gacetilla.sinks.reports import _commit, read_report
    line = lambda c: spark.range(0, 30, numPartitions=3).select(
        F.lit(0).alias("section"), F.col("id").alias("ord"), c.alias("line"))
    write_report(line(F.col("id").cast("string")), f"{workdir}/r")
    before = _report(workdir)
    fails = F.when(F.col("id") == 29, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).cast("string")
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception):
            write_report(line(fails), f"{workdir}/r", mode)
        assert _report(workdir) == before
    # a driver that is lost before its commit leaves parts that are no part of the report
    with open(f"{workdir}/r/part-r000002-00000-lost.txt", "w") as f:
        f.write("lost\n")
    assert read_report(spark, f"{workdir}/r").where("line = 'lost'").count() == 0
    write_report(line(F.lit("second")), f"{workdir}/r")
    assert _report(workdir) == before + "second\n" * 30
    got = read_report(spark, f"{workdir}/r").groupBy("run").count().collect()
    assert {tuple(r) for r in got} == {(1, 30), (2, 30)}
    assert [f for f in os.listdir(f"{workdir}/r") if f.startswith("_")] == ["_manifest-00000002"]
    with pytest.raises(FileExistsError):
        _commit(spark, f"{workdir}/r", 2, [1])  # another writer has had that version


def _break(folder):
    """Spoils every data file under a folder."""
    for root, _, files in os.walk(folder):
        for f in files:
            os.chmod(os.path.join(root, f), 0o600)
            with open(os.path.join(root, f), "wb") as out:
                out.write(b"no parquet")


def test_insert_reads_only_its_buckets(spark, workdir):
    from gacetilla.sinks.table import batch_size, bucket_of, create_table, stored_links
    path = f"{workdir}/t"
    create_table(spark, path, buckets=8)
    assert insert_items(spark, _items(spark, 40), path, batch="a") == 40
    assert insert_items(spark, _items(spark, 41).where("item_id >= 30"), path, batch="b") == 1
    assert batch_size(spark, path, "a") == 40 and batch_size(spark, path, "none") is None
    two = _items(spark, 2)
    plan = stored_links(spark, path, two)._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.split("PartitionFilters: ")[1].split("]")[0]
    own = {r[0] for r in two.select(bucket_of("link", 8)).collect()}
    for b in set(range(8)) - own:
        _break(f"{path}/batch=id-a/bucket={b}")
    assert insert_items(spark, two, path, batch="c") == 0


def test_retried_insert_is_no_insert(spark, workdir):
    path = f"{workdir}/t"
    assert insert_items(spark, _items(spark, 5), path, batch="x-1") == 5
    assert insert_items(spark, _items(spark, 9), path, batch="x-1") == 5  # the batch is stored: its own count
    assert insert_items(spark, _items(spark, 0), path, batch="x-2") == 0
    assert insert_items(spark, _items(spark, 3), path, batch="x-2") == 0
    assert read_table(spark, path).count() == 5
    assert not [f for f in os.listdir(path) if f.startswith("_staging")]


def test_page_store_reads_wanted_buckets(spark, workdir):
    from gacetilla.operators.content import fill_content
    from gacetilla.sinks.table import bucket_of
    from gacetilla.sources.pages import land_pages, page_store
    pages = spark.createDataFrame([(i, f"https://p/{i % 60}", f"<p>{i}</p>") for i in range(80)],
                                  "page_id int, url string, html string")
    for batch in ("one", "one", "two"):
        land_pages(pages.where(F.col("page_id") % 2 == int(batch == "two")), f"{workdir}/p", buckets=16, batch=batch)
    items = _items(spark, 4).withColumn("link", F.concat(F.lit("https://p/"), F.col("item_id").cast("string")))
    store = page_store(spark, f"{workdir}/p")
    assert store.buckets == 16 and store.pages.count() == 80
    small = spark.createDataFrame(items.collect(), items.schema)
    out = fill_content(small, store, page_key="page_id")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    own = {r[0] for r in items.select(bucket_of("link", 16)).collect()}
    for b in set(range(16)) - own:
        for batch in ("one", "two"):
            _break(f"{workdir}/p/batch=id-{batch}/bucket={b}")
    out = fill_content(small, page_store(spark, f"{workdir}/p"), page_key="page_id")
    assert {(r.item_id, r.clean_content) for r in out.collect()} == {(i, f"{i}\n") for i in range(4)}


def test_materialised_tables_go_with_the_application():
    import subprocess
    import sys
    import time
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = (f"import sys; sys.path.insert(0, {root!r})\n"
              "from gacetilla.session import build_session, materialize\n"
              "df = materialize(build_session('local[1]').range(5))\n"
              "print(df.count(), df.inputFiles()[0])\n")
    done = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, timeout=300,
                          env={**os.environ, "SPARK_DRIVER_MEMORY": "1g"})
    count, path = done.stdout.split()
    folder = os.path.dirname(os.path.dirname(path.removeprefix("file://")))
    assert count == "5" and os.path.basename(folder).startswith("local-")
    for _ in range(30):  # its JVM takes the folder away as it ends
        if not os.path.exists(folder):
            break
        time.sleep(1)
    assert os.path.isdir(os.path.dirname(folder)) and not os.path.exists(folder)


def test_scratch_belongs_to_its_thread(spark):
    import threading
    from gacetilla.session import materialize, scratch
    inside, outside, kept = threading.Event(), threading.Event(), []

    def other():
        inside.wait()
        kept.append(materialize(spark.range(3), "other"))
        outside.set()

    t = threading.Thread(target=other)
    t.start()
    with scratch(spark):
        mine = materialize(spark.range(2), "mine")
        inside.set()
        outside.wait()
        assert mine.count() == 2
    t.join()
    assert kept[0].count() == 3


def test_anchor_and_number_text(spark):
    df = spark.createDataFrame([("¡Hola, Mundo! 2024",), ("--Already-slugged--",)], "t string")
    assert [r.a for r in df.select(anchor("t").alias("a")).collect()] == ["#hola-mundo-2024", "#already-slugged"]
    nums = [30.0, 2.5, 1 / 3, 0.0005, 12345678.5, 1e15, 1.25e20, -2e-7, 0.0, 100.0, 1234567890123.25, 123456789.0]
    df = spark.createDataFrame([(x,) for x in nums], "x double")
    got = [r.s for r in df.select(number_text("x").alias("s")).collect()]
    assert got == ["30", "2.5", "0.3333333333333333", "0.0005", "12345678.5", "1000000000000000",
                   "125000000000000000000", "-0.0000002", "0", "100", "1234567890123.25", "123456789"]


def test_number_all_is_global_order(spark):
    df = spark.range(0, 500).select((F.col("id") * 7 % 101).alias("relevance"), F.col("id").cast("string").alias("link"),
                                    F.col("id").alias("item_id"))
    got = number_all(df, ["relevance", "link", "item_id"], [True, False, False], "ord", 0).collect()
    want = sorted(((-r.relevance, r.link, r.item_id) for r in got))
    by_ord = sorted(got, key=lambda r: r.ord)
    assert [r.ord for r in by_ord] == list(range(500))
    assert [(-r.relevance, r.link, r.item_id) for r in by_ord] == want


def test_relevance_report_text(spark, workdir):
    items = _items(spark, 4).withColumn("relevance", (F.col("item_id") * 10).cast("long"))
    lines = relevance_report_lines(items)
    path = os.path.join(workdir, "report.md")
    write_report(lines, path)
    text = "".join(open(os.path.join(path, f)).read() for f in sorted(os.listdir(path)) if f.startswith("part-"))
    assert text.startswith("# Relevance Report\n\n## Relevance per Channel\n\n")
    assert "- **ElDiario.es:** Items: 2 Total: 40 Average: 20\n" in text
    assert "- **Other:** Items: 2 Total: 20 Average: 10\n" in text
    assert text.index("ElDiario.es:**") < text.index("Other:**")
    assert "\n## Relevance list\n0. (30) [ElDiario.es] Title 3\n1. (20) [Other] Title 2\n" in text
    assert text.endswith("3. (0) [Other] Title 0\n\n")


def test_debug_texts(spark):
    from gacetilla.functions.items import error_debug, option_debug
    df = spark.createDataFrame([('say "hi"\\\n\tx',), (None,)], "t string")
    got = [r.d for r in df.select(option_debug("t").alias("d")).collect()]
    assert got == ['Some("say \\"hi\\"\\\\\\n\\tx")', "None"]
    odd = spark.createDataFrame([("a\0b\x07 \xa0é😀\u200b\u2028",), ("\u0301a\u0301",)], "t string")
    assert [r.d for r in odd.select(option_debug("t").alias("d")).collect()] == [
        'Some("a\\0b\\u{7} \\u{a0}é😀\\u{200b}\\u{2028}")', 'Some("\\u{301}a\u0301")']
    e = spark.range(1).select(
        error_debug(make_error(F.lit("NetworkError"), F.lit('bad "url"'))).alias("a"),
        error_debug(make_error("NoContent")).alias("b")).first()
    assert (e.a, e.b) == ('Some(NetworkError("bad \\"url\\""))', "Some(NoContent)")
    back = spark.createDataFrame([("ParsingError(line one\nline two)",)], "t string").select(
        parse_error("t").alias("e")).first().e
    assert (back.kind, back.message) == ("ParsingError", "line one\nline two")


def test_read_ratings_and_random_order(spark, workdir):
    from gacetilla.operators.feedback import read_ratings
    from gacetilla.operators.rank import random_order
    p = os.path.join(workdir, "ratings.csv")
    with open(p, "w") as f:
        f.write("link,rating\nhttps://e/0,4\nhttps://e/1,x\n")
    r = {row.link: row.rating for row in read_ratings(spark, p).collect()}
    assert r == {"https://e/0": "4", "https://e/1": "x"}
    items = _items(spark, 6)
    a = [row.item_id for row in random_order(items, seed=3).limit(3).collect()]
    b = [row.item_id for row in random_order(items, seed=3).limit(3).collect()]
    assert a == b and len(set(a)) == 3
