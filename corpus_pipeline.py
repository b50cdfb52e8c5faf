"""The corpus pipeline over the documents table.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage
before kept, and returns a DataFrame that is written as Parquet and read again
before the next stage.  All but the last return the columns of documents.

1. quality rules: rows that a rule rejects go.
2. line de-duplication: repeated lines go from the texts; rows stay.
3. n-gram Jaccard join: of each group of near copies the row with the least
   doc_id stays.
4. benchmark decontamination: rows in which a benchmark window occurs go.
5. SentencePiece: ids of each text as digest, with the decoded text's.

SQL can't express stages 3 and 5, so there is no oracle; tests hold the result
against a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gacetilla.llm import quality_rules
from gacetilla.llm.contract import piece_model
from gacetilla.llm.decontaminate import drop_contaminated
from gacetilla.llm.line_dedup import drop_lines
from gacetilla.llm.ngram_join import near_copies
from gacetilla.llm.pieces import round_trip
from gacetilla.llm.tables import materialize, read, sha256_column


def quality(spark, docs, sf_dir):
    return quality_rules.keep(docs, quality_rules.cascade(docs))


def lines(spark, docs, sf_dir):
    out = drop_lines(docs).drop("n_lines", "n_dropped")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))


def near(spark, docs, sf_dir):
    """Rows without an id can't be named by a group and stay."""
    kept = near_copies(docs).where("doc_id is null or doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept.withColumnRenamed("doc_id", "__kept"),
                     F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def benchmark(spark, docs, sf_dir):
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pieces(spark, docs, sf_dir):
    return round_trip(docs, piece_model()).select(
        "doc_id", "n_tokens", "ids_sha256", sha256_column(F.col("decoded")).alias("decoded_sha256"))


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near),
          ("benchmark decontamination", benchmark), ("SentencePiece", pieces)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
