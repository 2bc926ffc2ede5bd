"""Exact deduplication in DataFrame operations only, with skew-safe combining.

Rows are grouped by (digest, whole normalised text), never by the digest alone.  Spark's
partial aggregation deduplicates within each task before anything is shuffled; a salt then
spreads a group of copies over several reducers, whose winners are combined once more.
The groups' results go back to the documents by digest; the groups have shown by then that
no digest stands for two texts, or the query fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE

_TOP = 1 << 63


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE + "+", "")


def _rank(length: Column, id_: Column) -> Column:
    """A decimal that grows with the length, then with smaller ids; a null id comes last."""
    near = F.coalesce(F.lit(str(_TOP)).cast("decimal(20,0)") - id_.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (length.cast("decimal(17,0)") * F.lit(str(10**20)).cast("decimal(21,0)") + near).cast("decimal(38,0)")


def groups(docs: DataFrame, id_col: str, text_col: str, salts: int) -> DataFrame:
    """One row per distinct text: ``digest, body, best, n``."""
    length = F.length(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), length.alias("len"), normalised(F.col(text_col)).alias("body"))
    rows = rows.select(F.sha2("body", 256).alias("digest"), "body", _rank(F.col("len"), F.col("id")).alias("best"), F.pmod(F.xxhash64("id", F.lit(7)), F.lit(salts)).alias("salt"))
    salted = rows.groupBy("digest", "body", "salt").agg(F.max("best").alias("best"), F.count("*").alias("n"))
    return salted.groupBy("digest", "body").agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 8) -> DataFrame:
    """One row per document: ``id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical without white space; of equal ones the longest original,
    then the smallest id stays.  Null text counts as empty, and all empty texts are one group.
    Repeated rows count each; if the kept id itself repeats with the same length, each of those
    rows is ``kept``.  A row with a null id stays only if its group has no id (``keep_id`` null).
    Empty input gives no rows; other columns are ignored.
    """
    best = F.col("best")
    base = F.lit(str(10**20)).cast("decimal(38,0)")
    near = (best % base).cast("decimal(20,0)")
    found = groups(docs, id_col, text_col, salts).select(
        "digest",
        F.when(near > 0, (F.lit(str(_TOP)).cast("decimal(20,0)") - near).cast("bigint")).alias("keep_id"),
        ((best - near) / base).cast("bigint").alias("keep_len"),
        F.col("n").alias("group_size"),
        "body",
    )
    length = F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("bigint")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), length.alias("len"), F.sha2(normalised(F.col(text_col)), 256).alias("digest"))
    # A digest of two texts would give two rows here; its size in whole texts tells.
    per_digest = found.groupBy("digest").agg(F.count("*").alias("texts"), F.first("keep_id").alias("keep_id"), F.first("keep_len").alias("keep_len"), F.first("group_size").alias("group_size"))
    joined = rows.join(per_digest, "digest")
    checked = joined.withColumn("texts", F.when(F.col("texts") == 1, 1).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest"))))
    kept = (F.col("texts") == 1) & F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("len") == F.col("keep_len"))
    return checked.select("id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))
