"""From raw documents to packed training sequences, one operator a stage.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the
columns of ``documents``.  ``run`` writes every stage as Parquet into the folder that the cluster
shares and reads it again, so a lost executor costs the work of one stage at most.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.llm import line_dedup, near_dedup, packing, quality_rules, substring_dedup
from talkloom.llm.common import ensure_checkpoint_dir

#: Words of a shingle in the near-duplicate stages.
SHINGLE = 5
#: Jaccard similarity of shingle sets from which documents are near-duplicates.
SIMILARITY = 0.8
_HAS_WORD = r"[^\x20\x09-\x0D]"


def _changed(found: DataFrame, columns: list[str]) -> DataFrame:
    """Documents with their new texts, less those of which nothing new was left."""
    out = found.where((F.col("n_removed") == 0) | F.col("text").rlike(_HAS_WORD))
    return out.select(*[F.when(F.col("n_removed") > 0, F.length("text").cast("bigint")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(c) for c in columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the base rules and the learned decision list keep."""
    rules = quality_rules.learn(quality_rules.judged(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_rules.keep(docs, rules)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that stand earlier in the corpus, up to an edit."""
    return _changed(line_dedup.dedup_lines(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out documents whose shingles reach a Jaccard similarity of 0.8 with an earlier one that stays."""
    return near_dedup.keep(docs, size=SHINGLE, similarity=SIMILARITY)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out passages of 50 words or more that nearly repeat earlier ones."""
    return _changed(substring_dedup.dedup_passages(docs), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in windows of 1,024."""
    return packing.pack(docs).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality),
    ("line_dedup", lines),
    ("simhash_near_dedup", near_duplicates),
    ("substring_dedup", passages),
    ("packing", pack),
]

#: Learned rules, edit distance and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
