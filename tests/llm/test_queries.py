"""The registered queries and the pipeline on the smallest tables, against DuckDB, the library or plain versions."""

import os
import re

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as E  # noqa: E402
import corpus_pipeline  # noqa: E402
from gacetilla.llm.contract import llm_queries, llm_sql  # noqa: E402
from tools_check import digest  # noqa: E402

from . import helpers as H  # noqa: E402

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


def test_one_query_for_each_operator():
    names = [n for n in E.queries() if re.match(r"op\d+_", n)]
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 14))
    assert "pipeline" in E.queries() and set(llm_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = llm_queries()[name](spark, SF)
    res = con.execute(llm_sql()[name])
    cols, rows = [d[0] for d in res.description], res.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(cols) and len(got) == len(rows)
    assert digest(df.columns, got)[0] == digest(cols, rows)[0]


def _documents(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


def _kept_by_rules(text):
    n, chars, symbols, dup, repeat = H.statistics(text)
    lines = sum(bool(H.SPACED.search(x)) for x in (text or "").split("\n"))
    capitals = len(re.findall("[A-Z]", text or ""))
    letters = len(re.findall("[A-Za-z]", text or ""))
    return not (n < 10 or 10 * symbols > 3 * n or chars < 2 * n or chars > 15 * n or 10 * dup > 3 * lines
                or 2 * capitals > letters or 2 * (text or "").count("!") > n or 100 * repeat > 20 * n)


def test_pipeline_matches_plain_stages(spark):
    import public_tokenizers
    import sentencepiece

    rows = [r for r in _documents(spark) if _kept_by_rules(r[1])]
    rows = [(x[0], x[3]) for x in H.kept_lines(rows)]
    rows = [r for r, x in zip(rows, H.near_copies(rows, 5, 80)) if x[2] == r[0]]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [r for r, x in zip(rows, H.contamination(rows, items)) if not x[2]]
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = []
    for i, t in rows:
        ids = lib.encode(t)
        want.append((i, len(ids), H.sha(",".join(map(str, ids))), H.sha(lib.decode(ids))))
    assert 0 < len(want) < 200
    H.same(corpus_pipeline.run(spark, SF), want)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    # the join's own test has an empty table
    for name, stage in corpus_pipeline.STAGES:
        assert "Jaccard" in name or stage(spark, docs.limit(0), SF).count() == 0


def test_stages_on_odd_rows(spark):
    rows = H.corpus(30)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, H.documents(spark, rows), SF).count() <= len(rows)
    near = H.rows_of(corpus_pipeline.near(spark, H.documents(spark, rows), SF).select("doc_id"))
    assert (None,) in near and (7,) in near
