"""Session analytics: live statistics, recurring topics, moods, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def live_stats(log: DataFrame, as_of: Column, active_minutes: int = 5) -> DataFrame:
    """One row: sessions in all, today and active; messages in all and today; the busiest model, first seen on a tie.

    ``log``: ts, session, model.  A missing model is ``unknown``; a null time counts in totals only.
    """
    today = F.to_date("ts") == F.to_date(as_of)
    active = F.col("ts") >= as_of - F.make_dt_interval(mins=F.lit(active_minutes))
    per_model = log.groupBy(F.coalesce("model", F.lit("unknown")).alias("model")).agg(F.count("*").alias("n"), F.min("ts").alias("first"))
    top = per_model.agg(F.min_by("model", F.struct((-F.col("n")).alias("k"), "first", "model")).alias("top_model"))
    sums = log.agg(
        F.count_distinct("session").alias("sessions"),
        F.count_distinct(F.when(today, F.col("session"))).alias("sessions_today"),
        F.count_distinct(F.when(active, F.col("session"))).alias("sessions_active"),
        F.count("*").alias("messages"),
        F.count_if(today).alias("messages_today"),
    )
    return sums.join(F.broadcast(top), F.lit(True))  # one row each


def last_sessions(df: DataFrame, user: str, order: list[Column], n: int) -> DataFrame:
    """The newest ``n`` rows of a user; Spark keeps ``n`` of them before the shuffle."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(user).orderBy(*order))).where(F.col("__k") <= n).drop("__k")


def recurring_topics(recent: DataFrame, user: str, topics: str, date: str, least: int = 2) -> DataFrame:
    """Topics (comma-packed ones apart, lower case) that occur ``least`` times in a user's recent sessions."""
    parts = F.filter(F.transform(F.split(F.lower(topics), ","), F.trim), lambda t: t != "")
    flat = recent.select(user, date, F.explode(parts).alias("topic"))
    out = flat.groupBy(user, "topic").agg(F.count("*").alias("n"), F.min(date).alias("first_detected"))
    return out.where(F.col("n") >= least)


def ema(values: Column, alpha: float = 0.2) -> Column:
    """Exponential mean of an array in its order; the first value starts it."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, v: F.when(a.isNull(), v).otherwise(alpha * v + (1 - alpha) * a))


def progress(lines: DataFrame, key: str, t: str, line: str) -> DataFrame:
    """Per key: last step, total and smoothed seconds a step of log lines like ``step 5/100`` or ``iter: 20``.

    Steps that do not grow are ignored.  Lines of one run are few; a run is one group.
    """
    step = F.regexp_extract(line, r"(?i)\b(?:step|iter(?:ation)?)\b[:\s]*(\d+)", 1)
    total = F.regexp_extract(line, r"(?i)\b(?:step|iter(?:ation)?)\b[:\s]*\d+\s*/\s*(\d+)", 1)
    rows = lines.select(key, F.col(t).cast("double").alias("t"), F.when(step != "", step.cast("bigint")).alias("step"), F.when(total != "", total.cast("bigint")).alias("total"))
    w = Window.partitionBy(key).orderBy("t")
    rows = rows.where("step > 0").withColumn("best", F.max("step").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.where("best is null or step > best")
    rate = (F.col("t") - F.lag("t").over(w)) / (F.col("step") - F.lag("step").over(w))
    rows = rows.withColumn("rate", rate)
    packed = F.transform(F.array_sort(F.collect_list(F.when(F.col("rate").isNotNull(), F.struct("t", "rate")))), lambda x: x["rate"])
    return rows.groupBy(key).agg(F.max("step").alias("step"), F.max_by("total", F.when(F.col("total").isNotNull(), F.col("t"))).alias("total"), ema(packed).alias("seconds_per_step"))
