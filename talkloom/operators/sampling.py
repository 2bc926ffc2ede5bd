"""Deterministic shuffles, caps, splits and weighted choices: the order is md5(seed, key)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shuffle_key(seed: str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(seed + ":"), key.cast("string")))


def cap(df: DataFrame, group: str, key: str, caps: DataFrame | int, seed: str = "mix") -> DataFrame:
    """At most ``cap`` rows of a group, the first in shuffled order; groups without a cap keep all.

    ``caps``: one number, or rows of (group, cap).  A window with a row-number limit lets Spark
    discard rows before the shuffle where the cap is a constant.
    """
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(shuffle_key(seed, F.col(key)), F.col(key))))
    if isinstance(caps, int):
        return ranked.where(F.col("__n") <= caps).drop("__n")
    return ranked.join(caps, group, "left").where(F.col("cap").isNull() | (F.col("__n") <= F.col("cap"))).drop("__n", "cap")


def validation_size(n: Column, least: int, share: float, guard: bool = True) -> Column:
    """max(least, share of n), or a tenth of n where that would be more than there is."""
    v = F.greatest(F.lit(least), F.floor(n * share)).cast("bigint")
    return F.when((v > n) & F.lit(guard), F.floor(n / 10).cast("bigint")).otherwise(v)


def split(df: DataFrame, key: str, least: int = 50, share: float = 0.15, seed: str = "split", tail: bool = False, buckets: int = 4096, guard: bool = True) -> DataFrame:
    """``df`` with ``split``: the first rows in shuffled order (the last with ``tail``) are ``val``.

    Without ``guard`` a table of fewer rows than ``least`` is all ``val``.

    The rank of a row is its rank in a bucket of the order's first hex digits plus the sizes of the
    buckets before, a table of fixed size; no global sort meets in one task.
    """
    h = shuffle_key(seed, F.col(key))
    rows = df.withColumn("__h", h).withColumn("__b", F.conv(F.substring("__h", 1, 3), 16, 10).cast("int"))
    sizes = rows.groupBy("__b").agg(F.count("*").alias("__s"))
    w = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__before", F.coalesce(F.sum("__s").over(w), F.lit(0))).withColumn("__total", F.sum("__s").over(Window.partitionBy()))
    own = F.row_number().over(Window.partitionBy("__b").orderBy("__h", key))
    ranked = rows.withColumn("__n", own).join(sizes.drop("__s"), "__b")
    rank, v = F.col("__n") + F.col("__before"), validation_size(F.col("__total"), least, share, guard)
    first = rank <= v if not tail else rank > F.col("__total") - v
    return ranked.withColumn("split", F.when(first, "val").otherwise("train")).drop("__h", "__b", "__n", "__before", "__total")


def split_by(df: DataFrame, group: str, key: str, least: int = 300, share: float = 0.15, seed: str = "split") -> DataFrame:
    """Like ``split`` within each group, val = min(n, max(least, share of n))."""
    sizes = df.groupBy(group).agg(F.count("*").alias("__t"))
    ranked = df.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(shuffle_key(seed, F.col(key)), F.col(key)))).join(sizes, group)
    v = F.least(F.col("__t"), F.greatest(F.lit(least), F.floor(F.col("__t") * share)))
    return ranked.withColumn("split", F.when(F.col("__n") <= v, "val").otherwise("train")).drop("__n", "__t")


def unit(seed: str, key: Column) -> Column:
    """A number in [0, 1) from the first 32 bits of the shuffle key."""
    return F.conv(F.substring(shuffle_key(seed, key), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))


def choose(u: Column, weights: dict[str, float]) -> Column:
    """Inverse cumulative distribution; the last name where rounding leaves a gap."""
    names, at, out = list(weights), 0.0, None
    for name in names[:-1]:
        at += weights[name]
        out = F.when(u < at, name) if out is None else out.when(u < at, name)
    return F.lit(names[-1]) if out is None else out.otherwise(names[-1])


def weight_for(df: DataFrame, name: str, weights: DataFrame, default: float = 1.0) -> DataFrame:
    """``df`` with ``weight``: exact name first, else the first prefix in ``ord``, else the default.

    ``weights`` (prefix, w, ord) is configuration of a few rows; its size is checked before it is broadcast.
    """
    n = weights.limit(10_001).count()
    if n > 10_000:
        raise ValueError("a weight table of over 10,000 prefixes is no configuration")
    keys = df.select(name).distinct()
    hit = F.col(name).startswith(F.col("prefix"))
    best = F.min_by("w", F.struct((F.col(name) != F.col("prefix")).alias("inexact"), "ord"))
    found = keys.join(F.broadcast(weights), hit, "left").groupBy(name).agg(best.alias("weight"))
    return df.join(found.withColumn("weight", F.coalesce("weight", F.lit(default))), name)
