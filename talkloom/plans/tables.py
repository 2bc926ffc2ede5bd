"""The driver's tables, and the SQL that queries share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from talkloom.operators import turns


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conv_id, c``: one array of messages per conversation."""
    return turns.to_arrays(table(spark, sf_dir, "conversations"))


#: The same in DuckDB, as a CTE named conv.
CONV = "conv AS (SELECT conv_id, list({'role': role, 'content': text} ORDER BY turn) AS c FROM conversations GROUP BY conv_id)"


def flat_sql(c: str, gap: str = "chr(10) || '--' || chr(10)") -> str:
    return f"array_to_string(list_transform({c}, lambda m: m.role || '|' || m.content), {gap})"


def words_sql(x: str) -> str:
    return rf"len(list_filter(regexp_split_to_array({x}, '\s+'), lambda w: w <> ''))"


def total_words_sql(c: str) -> str:
    return f"coalesce(list_sum(list_transform({c}, lambda m: {words_sql('m.content')})), 0)"
