"""Inputs of synthetic generation: scenarios drawn from pools, seeds varied row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from talkloom.operators.sampling import choose, unit


def draw(pool: list[str], seed: str, key: Column) -> Column:
    """One of the pool, evenly, by hash of the key."""
    return F.get(F.array(*map(F.lit, pool)), F.floor(unit(seed, key) * len(pool)).cast("int"))


def scenarios(keys: DataFrame, key: str, weights: dict[str, float], pools: dict[str, list[str]], thresholds: dict[str, tuple[int, int]], seed: str = "scenario") -> DataFrame:
    """A category for each key by weight, a message from its pool, and the scores that make a pair."""
    category = choose(unit(seed + ":category", F.col(key)), weights)
    rows = keys.select(key, category.alias("category"))
    message, good, bad = (None,) * 3
    for name in weights:
        here, (g, b) = F.col("category") == name, thresholds[name]
        text = draw(pools[name], f"{seed}:{name}", F.col(key))
        message = F.when(here, text) if message is None else message.when(here, text)
        good = F.when(here, g) if good is None else good.when(here, g)
        bad = F.when(here, b) if bad is None else bad.when(here, b)
    return rows.select("*", message.alias("message"), good.alias("good"), bad.alias("bad"))


def redate(context: Column, dates: list[str], seed: str, key: Column) -> Column:
    """``[Mon d]`` marks replaced, in order, by consecutive ones of ``dates`` from a drawn start."""
    parts = F.split(context, r"\[[A-Z][a-z]{2} \d+\]")
    n, pool = F.size(parts) - 1, F.array(*map(F.lit, dates))
    start = F.floor(unit(seed, key) * (F.greatest(F.lit(len(dates)) - n, F.lit(0)) + 1)).cast("int")
    filled = F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(F.lit("["), F.coalesce(F.get(pool, start + k - 1), F.lit("")), F.lit("]"), p)))
    return F.when(n > len(dates), context).otherwise(F.array_join(filled, ""))


def rescore(context: Column, seed: str, key: Column, high: tuple[int, int] = (6, 9)) -> Column:
    """``n/10`` scores replaced by ones that start high and never rise; one alone is left."""
    parts = F.split(context, r"\b\d+(?=/10)")
    start = F.lit(high[0]) + F.floor(unit(seed + ":start", key) * (high[1] - high[0] + 1)).cast("int")
    step = F.lit(1) + F.floor(unit(seed + ":step", key) * 2).cast("int")
    score = lambda k: F.greatest(F.lit(1), start - step * (k - 1)).cast("string")
    filled = F.transform(parts, lambda p, k: F.when(k == 0, p).otherwise(F.concat(score(k), p)))
    return F.when(F.size(parts) > 2, F.array_join(filled, "")).otherwise(context)


def reword(context: Column, groups: list[list[str]], seed: str, key: Column) -> Column:
    """Of each group of synonyms the first that occurs is replaced, once, by a drawn one."""
    out = context
    for g, words in enumerate(groups):
        new = draw(words, f"{seed}:{g}", key)
        swapped = None
        for w in words:
            at = F.locate(w, out)
            one = F.concat(F.substring(out, F.lit(1), at - 1), new, F.substring(out, at + len(w), F.length(out)))
            swapped = F.when(at > 0, one) if swapped is None else swapped.when(at > 0, one)
        out = swapped.otherwise(out)
    return out
