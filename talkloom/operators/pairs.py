"""Preference pairs: choice of responses, assembly, and merging of stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.functions.text import strip


def outcome(scores: Column, good: Column, bad: Column) -> Column:
    """Struct(kind, best, worst) of the scores of one prompt's responses; first index on ties."""
    top, low = F.array_max(scores), F.array_min(scores)
    best, worst = (F.array_position(scores, top) - 1).cast("int"), (F.array_position(scores, low) - 1).cast("int")
    kind = (
        F.when((F.size(scores) == 0) | F.exists(scores, lambda s: s.isNull()), "judge_failed")
        .when((top >= good) & (low <= bad) & (best != worst), "on_policy")
        .when(top < good, "hybrid")
        .when(low >= good, "all_good")
        .otherwise("ambiguous")
    )
    return F.struct(kind.alias("kind"), best.alias("best"), worst.alias("worst"))


def assemble(prompt: Column, chosen: Column, rejected: Column, category: Column, kind: Column) -> Column:
    """A preference record; texts that only differ in white space at the ends make it ambiguous."""
    one = lambda x: F.array(F.struct(F.lit("assistant").alias("role"), x.alias("content")))
    same = strip(chosen) == strip(rejected)
    return F.struct(prompt.alias("prompt"), one(chosen).alias("chosen"), one(rejected).alias("rejected"), category.alias("category"), F.when(same, "ambiguous").otherwise(kind).alias("pair_type"))


def merge_store(new: DataFrame, store: DataFrame, key: Column, kind: str) -> DataFrame:
    """``store`` with the rows of ``new`` whose key it has not, within a kind; new rows are not compared among themselves."""
    known = store.select(kind, key.alias("__k")).distinct()
    fresh = new.withColumn("__k", key).join(known, [kind, "__k"], "left_anti").drop("__k")
    return store.unionByName(fresh)
