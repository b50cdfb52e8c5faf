"""Queries of the training-data operators, each over its whole table.

Every query is thin: it reads its table, calls the operator with production
parameters and derives the result columns.  ``llm_sql`` has DuckDB SQL where
SQL can express the result on whole tables in reasonable time; the others are
tested against brute force in ``tests/llm``.

Parameters of a query that differ from its operator's defaults are given here:
op2 joins on four words and 0.85 where the operator's defaults, which the
pipeline uses, are five words and 0.8.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from . import html_extract, licences, oracle, quality_classifier, quality_rules, repair, vantage, warc
from .anchors import align
from .decontaminate import contamination
from .line_dedup import drop_lines
from .ngram_join import near_copies
from .pieces import round_trip
from .repeats import remove_repeats
from .tables import read, sha256_column


def piece_model(name: str = "piece_bpe_32k.model") -> str:
    """The model's file, read on the driver alone."""
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_html_extraction(spark, sf_dir):
    return html_extract.extract(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op2_ngram_jaccard_join(spark, sf_dir):
    return near_copies(read(spark, sf_dir, "documents"), k=4, threshold=85)


def op3_quality_rules(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    return quality_rules.verdict(docs, quality_rules.cascade(docs)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_decontaminate(spark, sf_dir):
    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256",
                        (F.col("n_hit") > 0).alias("contaminated"))


def op5_sentencepiece(spark, sf_dir):
    return round_trip(read(spark, sf_dir, "documents"), piece_model()).select(
        "doc_id", "n_tokens", "ids_sha256", sha256_column(F.col("decoded")).alias("decoded_sha256"))


def op6_warc(spark, sf_dir):
    archives = warc.write_archives(read(spark, sf_dir, "pages"), warc.archive_folder(spark))
    return warc.read_archives(archives, with_payload=False).drop("payload", "url")


def op7_license_scan(spark, sf_dir):
    """Documents as files of a tree; see ``licences.document_files``."""
    files = licences.document_files(read(spark, sf_dir, "documents"))
    return licences.scan_files(files).withColumnRenamed("id", "doc_id")


def op8_line_dedup(spark, sf_dir):
    return drop_lines(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", sha256_column(F.col("text")).alias("kept_sha256"))


def op9_substring_dedup(spark, sf_dir):
    return remove_repeats(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", sha256_column(F.col("kept")).alias("kept_sha256"))


def op10_quality_classifier(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    model = quality_classifier.fit(docs, read(spark, sf_dir, "labels"))
    return quality_classifier.classify(docs, model)


def op11_cross_tokenizer_alignment(spark, sf_dir):
    return align(read(spark, sf_dir, "documents"), piece_model("byte_bpe_50k.json"), piece_model())


def op12_conversation_repair(spark, sf_dir):
    return repair.repair(repair.damage(read(spark, sf_dir, "conversations")))


def op13_nearest_neighbours(spark, sf_dir):
    """Factor one: the exact search."""
    rows = vantage.points(read(spark, sf_dir, "embeddings"))
    return vantage.neighbours(rows, F.col("id") % 100 == 0, k=10, factor=1.0).select(
        "query_id", "rank", "vec_id", "score")


def llm_queries():
    return {f.__name__: f for f in (
        op1_html_extraction, op2_ngram_jaccard_join, op3_quality_rules, op4_decontaminate, op5_sentencepiece,
        op6_warc, op7_license_scan, op8_line_dedup, op9_substring_dedup, op10_quality_classifier,
        op11_cross_tokenizer_alignment, op12_conversation_repair, op13_nearest_neighbours)}


def llm_sql():
    return {"op2_ngram_jaccard_join": oracle.OP2, "op3_quality_rules": oracle.OP3, "op4_decontaminate": oracle.OP4,
            "op6_warc": oracle.OP6, "op8_line_dedup": oracle.OP8, "op9_substring_dedup": oracle.OP9,
            "op13_nearest_neighbours": oracle.OP13}
