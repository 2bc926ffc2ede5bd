"""Structured Streaming: training progress, trace logs, event windows, bounded generation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TRACE = "ts timestamp, event string, level string, scenario_id string"


def trace(spark: SparkSession, path: str) -> DataFrame:
    """Trace events from JSON lines that keep arriving; malformed lines are skipped."""
    lines = spark.readStream.schema("value string").text(path)
    parsed = F.from_json("value", TRACE)
    return lines.select(parsed.alias("e")).where("e.event is not null").select("e.*")


def severities(events: DataFrame) -> DataFrame:
    """Running counts by level."""
    return events.groupBy("level").agg(F.count("*").alias("n"))


def windows(events: DataFrame, late: str = "10 minutes", size: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and sums by event type in tumbling or sliding windows; later than the watermark is dropped."""
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of a user: bursts with no longer pause than ``gap``."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def progress(lines: DataFrame, alpha: float = 0.2, every: int = 10, warm_up: int = 2) -> DataFrame:
    """Smoothed seconds a step of each run from ``run, t, step``; a row at every ``every``-th new step.

    State is one row a run: last time, last step, smoothed rate, steps seen.  Steps that do not grow are ignored.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t0, s0, rate, seen = state.get if state.exists else (None, None, None, 0)
        out = []
        for part in parts:
            for t, step in part.sort_values(["t", "step"])[["t", "step"]].itertuples(index=False):
                if step <= 0 or s0 is not None and step <= s0:
                    continue
                if s0 is not None:
                    now = (t - t0) / (step - s0)
                    rate = now if rate is None else alpha * now + (1 - alpha) * rate
                t0, s0, seen = float(t), int(step), seen + 1
                if seen >= warm_up and seen % every == 0 and rate is not None:
                    out.append((key[0], s0, rate))
        state.update((t0, s0, rate, seen))
        yield pd.DataFrame(out, columns=["run", "step", "seconds_per_step"])

    return lines.groupBy("run").applyInPandasWithState(run, "run string, step long, seconds_per_step double", "t double, step long, rate double, seen long", "append", GroupStateTimeout.NoTimeout)


def bounded_loop(stream: DataFrame, accept: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str):
    """A micro-batch loop: what a batch's filter accepts goes to ``sink`` with the batch's number."""
    return stream.writeStream.foreachBatch(lambda df, n: sink(accept(df), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
