"""Evaluation analytics over verdict facts.

``verdicts``: run_id, model, scenario_id, category, criterion_id, weight, verdict (PASS, FAIL,
AMBIGUOUS).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

CLOSE = 1e-6


def score(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """Weighted points and verdict counts; pct is 0 without weight."""
    is_ = lambda v: F.col("verdict") == v
    out = verdicts.groupBy(*by).agg(
        F.sum(F.when(is_("PASS"), F.col("weight")).otherwise(0.0)).alias("weighted_pass"),
        F.sum("weight").alias("weighted_total"),
        *[F.count_if(is_(v)).alias(v.lower()) for v in ("PASS", "FAIL", "AMBIGUOUS")],
    )
    return out.withColumn("pct", F.when(F.col("weighted_total") > 0, F.col("weighted_pass") / F.col("weighted_total")).otherwise(0.0))


def overall(verdicts: DataFrame, by: list[str]) -> DataFrame:
    """PASS if all criteria pass, AMBIGUOUS if any is, FAIL else; null without a criterion."""
    v = F.when(F.count("verdict") == 0, None).when(F.bool_and(F.col("verdict") == "PASS"), "PASS").when(F.bool_or(F.col("verdict") == "AMBIGUOUS"), "AMBIGUOUS").otherwise("FAIL")
    return verdicts.groupBy(*by).agg(v.alias("verdict"))


def passed(scores: DataFrame) -> Column:
    return (F.col("weighted_total") > 0) & (F.abs(F.col("weighted_pass") - F.col("weighted_total")) < CLOSE)


def change(a: Column, b: Column) -> Column:
    """One of seven classes of a verdict in two runs."""
    return (
        F.when(a.isNull() & b.isNull(), "missing").when(a.isNull(), "new").when(b.isNull(), "removed").when(a == b, "unchanged")
        .when((a == "FAIL") & (b == "PASS"), "improved").when((a == "PASS") & (b == "FAIL"), "REGRESSED").otherwise("changed")
    )


def diff(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """Full outer comparison of two (key, verdict) tables."""
    both = a.withColumnRenamed("verdict", "verdict_a").join(b.withColumnRenamed("verdict", "verdict_b"), key, "full_outer")
    return both.withColumn("change", change(F.col("verdict_a"), F.col("verdict_b")))


def average_runs(scores: DataFrame, label: str, run: str, pct: str, least: int = 2) -> DataFrame:
    """Mean and population deviation over the runs of a label that has ``least`` of them."""
    out = scores.groupBy(label).agg(F.count("*").alias("n_runs"), F.avg(pct).alias("mean"), F.stddev_pop(pct).alias("std"), F.array_join(F.array_sort(F.collect_list(run)), ",").alias("runs"))
    return out.where(F.col("n_runs") >= least)


def unstable(results: DataFrame, scenario: str, run: str, ok: str, most: int = 5) -> DataFrame:
    """Scenarios of all runs that pass in some but not all, closest to a coin flip first."""
    n = results.agg(F.count_distinct(run).alias("__runs"))
    rate = results.groupBy(scenario).agg(F.count_distinct(run).alias("n"), F.avg(F.col(ok).cast("double")).alias("rate"))
    both = rate.join(F.broadcast(n), F.col("n") == F.col("__runs")).where("rate > 0 and rate < 1").drop("__runs")
    return both.orderBy(F.round(F.abs(F.col("rate") - 0.5), 9), scenario).limit(most)


def average_rank(x: str, by: list[str] | None = None) -> Column:
    """Rank from 1 in which ties share their mean."""
    part = Window.partitionBy(*(by or []))
    return (F.rank().over(part.orderBy(x)) + (F.count("*").over(Window.partitionBy(*(by or []), x)) - 1) / 2).cast("double")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """One row ``rho``: rank correlation with mean ranks of ties; null under two rows or without variance.

    Ranks come from the counts of distinct values, a small table where values repeat; no window
    meets all rows.
    """
    pairs = df.groupBy(F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))

    def ranks(c: str) -> DataFrame:
        sizes = pairs.groupBy(c).agg(F.sum("n").alias("k"))
        before = F.coalesce(F.sum("k").over(Window.orderBy(c).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        return sizes.select(c, (before + (F.col("k") + 1) / 2).cast("double").alias("r" + c))

    r = pairs.join(ranks("x"), "x").join(ranks("y"), "y")
    n, sx, sy = F.sum("n"), F.sum(F.col("n") * F.col("rx")), F.sum(F.col("n") * F.col("ry"))
    xx, yy, xy = F.sum(F.col("n") * F.col("rx") ** 2), F.sum(F.col("n") * F.col("ry") ** 2), F.sum(F.col("n") * F.col("rx") * F.col("ry"))
    vx, vy = n * xx - sx * sx, n * yy - sy * sy
    return r.agg(F.when((n >= 2) & (vx > 1e-9) & (vy > 1e-9), (n * xy - sx * sy) / F.sqrt(vx * vy)).alias("rho"))


def calibration(levels: DataFrame, level: str, ok: str, slack: float = 0.05) -> DataFrame:
    """One row: pass rates of levels 1 to 3, whether harder levels pass as often, and what is missing."""
    rate = [F.avg(F.when(F.col(level) == k, F.col(ok).cast("double"))).alias(f"rate_{k}") for k in (1, 2, 3)]
    out = levels.agg(*rate, F.count("*").alias("n"), F.count_if(F.col(level).isNull()).alias("n_missing_level"))
    drop = lambda a, b: F.coalesce(F.col(f"rate_{b}") < F.col(f"rate_{a}") - slack, F.lit(False))
    return out.withColumn("monotonic", ~(drop(1, 2) | drop(2, 3) | drop(1, 3)))


def leaderboard(scores: DataFrame, model: str, category: str, categories: list[str] | None = None) -> DataFrame:
    """Models by categories, with the total over all of them, best first."""
    pct = F.round(100 * F.sum("weighted_pass") / F.sum("weighted_total"), 4)
    wide = scores.groupBy(model).pivot(category, categories).agg(pct)
    total = scores.groupBy(model).agg(pct.alias("total"))
    return wide.join(total, model).orderBy(F.desc("total"), model)


def spread(board: DataFrame, columns: list[str], least: float = 5.0) -> DataFrame:
    """Rows whose present values lie ``least`` points apart or more."""
    values = F.array_compact(F.array(*columns))
    return board.where(F.array_max(values) - F.array_min(values) >= least)


def latest(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row of each key as an aggregate, without a window."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("__r")).select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def weighted_loss(df: DataFrame, loss: str, weight: str, by: list[str] | None = None) -> DataFrame:
    agg = (F.sum(F.col(loss) * F.col(weight)) / F.sum(weight)).alias("loss")
    return df.groupBy(*by).agg(agg) if by else df.agg(agg)


def unknown_ids(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct ids of ``rows`` that ``known`` has no row for, each with a warning."""
    return rows.select(key).distinct().join(known.select(key), key, "left_anti").select(key, F.concat(F.lit("unknown id: "), F.col(key).cast("string")).alias("warning"))
