"""Queries of the training-data operators over the driver's tables, one ``opN_<name>`` each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_extract, line_dedup, lm_score, packing, pieces, quality_rules, simhash, substring_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).withColumnRenamed("id", "doc_id")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words and pieces, digests by position of its ids and of what they decode to, and whether this is the whole text."""
    found = pieces.digests(table(spark, sf_dir, "documents"), pieces.Pieces.load())
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_pieces", "ids_digest", "text_digest", F.col("whole").alias("round_trip"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("bigint").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judged(table(spark, sf_dir, "documents"))
    found = quality_rules.apply(rows, quality_rules.learn(rows, table(spark, sf_dir, "labels")))
    return found.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = packing.pack(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.dedup_passages(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", "spans", F.length("text").cast("bigint").alias("n_chars"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_simhash,
        op2_toxicity,
        op3_html_extract,
        op4_lm_score,
        op5_pieces,
        op6_exact_dedup,
        op7_line_dedup,
        op8_quality_rules,
        op9_packing,
        op10_substring_dedup,
    )
}

ORACLES: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH d AS (
          SELECT doc_id, length(coalesce(text, '')) AS n,
                 sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
          FROM documents),
        r AS (
          SELECT doc_id, text_sha256, count(*) OVER (PARTITION BY text_sha256) AS group_size,
                 first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
          FROM d)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
    """,
}
