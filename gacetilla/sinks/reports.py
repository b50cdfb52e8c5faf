"""Markdown reports as line DataFrames (A5, K4–K7).

A report is a DataFrame of ``(section, ord, line)``: sections keep the
document order, ``ord`` numbers lines within a section.  Lines are built
with native string functions on the executors from the templates below;
writing sorts by (section, ord), emits the text with many writers and
publishes their files by renaming, so no report passes through the driver.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formatting import anchor, number_text, truncate_chars
from ..functions.items import error_debug, option_debug
from ..operators.rank import number_all
from ..session import delete_path, existing_paths, rename_path

# The report texts, in document order.  ``{name}`` is a field.
RELEVANCE_TITLE = ["# Relevance Report", ""]
RELEVANCE_CHANNELS_HEADING = ["## Relevance per Channel", ""]
RELEVANCE_CHANNEL_LINE = "- **{channel}:** Items: {items} Total: {total} Average: {average}"
RELEVANCE_LIST_HEADING = ["", "## Relevance list"]
RELEVANCE_LIST_LINE = "{ord}. ({relevance}) [{channel}] {title}"
CONTENTS_LINE = "{ord}. [{title}]({anchor})"
LOG_TITLE = ["# Table of Contents"]
LOG_ITEM = ("---\n# {title}\n## Data\n- **Channel:** {channel}\n- **Relevance:** {relevance}\n"
            "- **Link:** {link}\n- **Publish Date:** {pub_date}\n- **Categories:** {categories}\n"
            "- **Keywords:** {keywords}\n- **Error:** {error}\n## Description\n{description}\n"
            "## Clean Content \n{clean_content}\n")
DOSSIER_TITLE = ["# Dossier", ""]
DOSSIER_CONTENTS_HEADING = ["## Table of Contents"]
DOSSIER_METADATA_HEADING = ["", "## Metadata"]
DOSSIER_COUNT_LINE = "- **Number of items:** {count}"
DOSSIER_DATE_LINE = "- **Date:** {date}"
DOSSIER_ITEMS_HEADING = ["", "## News Items"]
DOSSIER_ITEM = ("---\n### {title}\n\n#### Data\n- **Channel:** {channel}\n- **Relevance:** {relevance}\n"
                "- **Link:** {link}\n- **Publish Date:** {pub_date}\n- **Categories:** {categories}\n"
                "- **Keywords:** {keywords}\n- **Error:** {error}\n\n#### Clean Content \n{clean_content}")
NO_CONTENT_TEXT = "N/A"
DESCRIPTION_CHARS = 50

_FIELD = re.compile(r"\{(\w+)\}")


def render(template: str, **fields: Column) -> Column:
    """A template as a column: its literal text around the given fields."""
    parts, pos = [], 0
    for m in _FIELD.finditer(template):
        if m.start() > pos:
            parts.append(F.lit(template[pos:m.start()]))
        parts.append(fields[m.group(1)].cast("string"))
        pos = m.end()
    if pos < len(template):
        parts.append(F.lit(template[pos:]))
    return F.concat(*parts)


def _item_fields() -> dict:
    return dict(
        title=F.col("title"), channel=F.col("channel"),
        relevance=F.coalesce(F.col("relevance"), F.lit(0)), link=F.col("link"),
        pub_date=option_debug("pub_date"), categories=option_debug("categories"),
        keywords=option_debug("keywords"), error=error_debug("error"),
        clean_content=F.coalesce(F.col("clean_content"), F.lit(NO_CONTENT_TEXT)))


def relevance_per_channel(items: DataFrame) -> DataFrame:
    """A5: per channel the item count, the total and the average relevance
    (a missing relevance counts as 0)."""
    rel = F.coalesce(F.col("relevance"), F.lit(0)).cast("double")
    return (items.groupBy("channel")
                 .agg(F.count(F.lit(1)).cast("long").alias("items"), F.sum(rel).alias("total"))
                 .withColumn("average", F.col("total") / F.col("items")))


def _lines(df: DataFrame, section: int, line) -> DataFrame:
    return df.select(F.lit(section).alias("section"), F.col("ord").cast("long").alias("ord"),
                     line.alias("line"))


def _fixed(spark: SparkSession, section: int, lines: list[str]) -> DataFrame:
    rows = F.array(*[F.struct(F.lit(i).cast("long").alias("ord"), F.lit(t).alias("line"))
                     for i, t in enumerate(lines)])
    return spark.range(1).select(F.inline(rows)).select(
        F.lit(section).alias("section"), "ord", "line")


def relevance_report_lines(items: DataFrame) -> DataFrame:
    """K5: title, the per-channel section (by average descending, then
    channel) and the numbered list of every item (0-based, by relevance
    descending)."""
    spark = items.sparkSession
    per_channel = relevance_per_channel(items)
    ch = number_all(per_channel, ["average", "channel"], [True, False], "ord", 0)
    ch_lines = _lines(ch, 2, render(RELEVANCE_CHANNEL_LINE, channel=F.col("channel"), items=F.col("items"),
                                    total=number_text("total"), average=number_text("average")))
    listed = number_all(items.select("item_id", "relevance", "channel", "title", "link"),
                        ["relevance", "link", "item_id"], [True, False, False], "ord", 0)
    item_lines = _lines(listed, 4, render(RELEVANCE_LIST_LINE, ord=F.col("ord"),
                                          relevance=F.coalesce(F.col("relevance"), F.lit(0)),
                                          channel=F.col("channel"), title=F.col("title")))
    return (_fixed(spark, 0, RELEVANCE_TITLE).unionByName(_fixed(spark, 1, RELEVANCE_CHANNELS_HEADING))
            .unionByName(ch_lines).unionByName(_fixed(spark, 3, RELEVANCE_LIST_HEADING))
            .unionByName(item_lines)
            .unionByName(_fixed(spark, 5, [""])))  # the file append ends the report with a newline


def item_log_lines(items: DataFrame, key: str = "item_id") -> DataFrame:
    """K4: contents list plus one section per item, by relevance descending."""
    spark = items.sparkSession
    # numbers are given to narrow rows; contents are joined to them once
    order = number_all(items.select(key, "relevance", "link"), ["relevance", "link", key], [True, False, False],
                       "ord", 1)
    numbered = items.join(order.select(key, "ord"), key)
    toc = _lines(numbered, 1, render(CONTENTS_LINE, ord=F.col("ord"), title=F.col("title"),
                                     anchor=anchor("title")))
    fields = _item_fields()
    fields["description"] = truncate_chars("description", DESCRIPTION_CHARS)
    sections = _lines(numbered, 3, render(LOG_ITEM, **fields))
    return _fixed(spark, 0, LOG_TITLE).unionByName(toc).unionByName(
        _fixed(spark, 2, [""])).unionByName(sections)


def dossier_lines(items: DataFrame, run_time: str, position: str = "rank") -> DataFrame:
    """K6: dossier of items in their given order: ``position`` counts from 1."""
    spark = items.sparkSession
    numbered = items.withColumn("ord", F.col(position).cast("long"))
    toc = _lines(numbered, 2, render(CONTENTS_LINE, ord=F.col("ord"), title=F.col("title"),
                                     anchor=anchor("title")))
    count_line = items.agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(4).alias("section"), F.lit(1).cast("long").alias("ord"),
        render(DOSSIER_COUNT_LINE, count=F.col("n")).alias("line"))
    date_and_heading = [DOSSIER_DATE_LINE.format(date=run_time)] + DOSSIER_ITEMS_HEADING
    return (_fixed(spark, 0, DOSSIER_TITLE)
            .unionByName(_fixed(spark, 1, DOSSIER_CONTENTS_HEADING))
            .unionByName(toc)
            .unionByName(_fixed(spark, 3, DOSSIER_METADATA_HEADING))
            .unionByName(count_line)
            .unionByName(_fixed(spark, 5, date_and_heading))
            .unionByName(_lines(numbered, 6, render(DOSSIER_ITEM, **_item_fields())))
            .unionByName(_fixed(spark, 7, [""])))


def _committed(spark: SparkSession, path: str) -> tuple[int, list[int]]:
    """(version, runs) of a report's latest manifest."""
    found = sorted(existing_paths(spark, f"{path}/_manifest-*"))
    if not found:
        return 0, []
    numbers = found[-1].rsplit("/", 1)[-1].split("-")[1:]
    p = spark._jvm.org.apache.hadoop.fs.Path(found[-1])
    data = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).open(p)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(data, "UTF-8")
    finally:
        data.close()
    return int(numbers[0]), [int(x) for x in text.split()]


def _commit(spark: SparkSession, path: str, version: int, runs: list[int]) -> None:
    """The next manifest: written aside, then renamed.  Two writers that want
    the same version can't both have it."""
    aside = f"{path}/_new-manifest-{uuid.uuid4().hex}"
    p = spark._jvm.org.apache.hadoop.fs.Path(aside)
    out = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).create(p, False)
    try:
        out.write(bytearray(" ".join(map(str, runs)).encode()))
    finally:
        out.close()
    try:
        rename_path(spark, aside, f"{path}/_manifest-{version:08d}")
    finally:
        delete_path(spark, aside)


def _parts(spark: SparkSession, path: str) -> dict[int, list[str]]:
    """Published part files by run."""
    out: dict[int, list[str]] = {}
    for part in existing_paths(spark, f"{path}/part-r*"):
        if m := re.match(r"part-r([0-9]+)-", part.rsplit("/", 1)[-1]):
            out.setdefault(int(m[1]), []).append(part)
    return out


def write_report(lines: DataFrame, path: str, mode: str = "append") -> None:
    """K7: write the report as text, lines in (section, ord) order.

    The sort is range-partitioned, so the report is written by many tasks.  A
    report is a folder of part files that are read in name order.  A run's
    parts are written into a hidden folder of the report; then each is renamed,
    with a name that follows all earlier runs', and the next manifest lists the
    run.  No line passes the driver, and nothing is copied.  The runs of the
    latest manifest are the report: a run that fails takes its parts away and
    leaves the report as it was, and parts that a lost driver left are taken
    away by the next run.  Overwriting removes the old runs after the manifest
    of the new one.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError("mode is 'append' or 'overwrite'")
    spark = lines.sparkSession
    version, runs = _committed(spark, path)
    for run, parts in _parts(spark, path).items():
        if run not in runs:
            for part in parts:
                delete_path(spark, part)
    run = max(runs, default=0) + 1
    aside = f"{path}/_run-{uuid.uuid4().hex}"
    published = []
    try:
        lines.orderBy("section", "ord").select("line").write.text(aside)
        for part in sorted(existing_paths(spark, f"{aside}/part-*")):
            target = f"{path}/part-r{run:06d}-{part.rsplit('/', 1)[-1].removeprefix('part-')}"
            rename_path(spark, part, target)
            published.append(target)
        _commit(spark, path, version + 1, [*runs, run] if mode == "append" else [run])
    except BaseException:
        for part in published:
            delete_path(spark, part)
        raise
    finally:
        delete_path(spark, aside)
    if version:
        delete_path(spark, f"{path}/_manifest-{version:08d}")
    if mode == "overwrite":
        for old in runs:
            for part in _parts(spark, path).get(old, []):
                delete_path(spark, part)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """(run, part, line) of a report's committed runs; lines of a part stand in order."""
    runs = _committed(spark, path)[1]
    parts = [p for run, own in sorted(_parts(spark, path).items()) if run in runs for p in sorted(own)]
    if not parts:
        return spark.createDataFrame([], "run int, part string, line string")
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return spark.read.text(parts).select(F.regexp_extract(name, "^part-r([0-9]+)-", 1).cast("int").alias("run"),
                                         name.alias("part"), F.col("value").alias("line"))
