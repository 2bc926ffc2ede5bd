import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from talkloom.operators import dedup


def test_band_tuner():
    assert dedup.bands(128, 0.8) == (11, 11)


def test_minima_are_the_plain_formula():
    raw = [0, 1, 2**32 - 1, 123456789]
    a, b = dedup.family(16, 42)
    want = [min(((int(x) * r + int(y)) % dedup.PRIME) & dedup.TOP for r in raw) for x, y in zip(a, b, strict=True)]
    assert dedup.minima(np.array(raw, dtype=np.uint64), 16, 42).tolist() == want


@pytest.mark.parametrize("held", [3, 50, 1 << 17])
def test_remembered_grams_give_the_plain_signature(held, monkeypatch):
    """A gram of many texts is hashed once, also where the memory holds fewer grams than a text has."""
    draw, calls, plain = random.Random(5), [], dedup.hashed
    monkeypatch.setattr(dedup, "hashed", lambda raw, n, seed: calls.append(len(raw)) or plain(raw, n, seed))
    texts = ["".join(draw.choice("abÉß\U0001f600") for _ in range(draw.randrange(90))) for _ in range(60)] + [None, "", "abc", "ABCD", "abcd"]
    signer = dedup.Signer(16, 4, 42, held)
    got = [signer.sign(t).tolist() for t in texts]
    hashed_grams = sum(calls)
    for t, sig in zip(texts, got, strict=True):
        low = (t or "").lower()
        raw = [int.from_bytes(hashlib.md5(low[i : i + 4].encode()).digest()[:4], "little") for i in range(len(low) - 3)]
        assert sig == dedup.minima(np.array(raw, dtype=np.uint64), 16, 42).tolist()
    if held == 1 << 17:
        assert hashed_grams == len({t.lower()[i : i + 4] for t in texts if t for i in range(len(t.lower()) - 3)})


def sequential(rows):
    kept, seen = [], set()
    for ord_, keys in sorted(rows):
        if not seen & set(keys):
            kept.append(ord_)
            seen |= set(keys)
    return kept


@settings(max_examples=6, deadline=None)
@given(st.integers(0, 10**6))
def test_greedy_is_the_sequential_answer(spark, seed):
    draw = random.Random(seed)
    rows = [(k, [draw.randrange(30) for _ in range(3)]) for k in range(40)]
    df = spark.createDataFrame(rows, "ord long, keys array<long>")
    assert sorted(r["ord"] for r in dedup.greedy_keep(df).collect()) == sequential(rows)


def test_chain_keeps_both_ends(spark):
    df = spark.createDataFrame([(1, [1]), (2, [1, 2]), (3, [2])], "ord long, keys array<long>")
    assert sorted(r["ord"] for r in dedup.greedy_keep(df).collect()) == [1, 3]


def test_near_dedup_edges(spark):
    long = "a long sentence about nothing much that goes on and on " * 4
    rows = [(1, long), (2, long), (3, "  "), (4, None), (5, "ab"), (6, "xy"), (7, "quite another matter altogether, with other words")]
    got = dedup.near_dedup(spark.createDataFrame(rows, "ord long, text string"), "ord", "text")
    assert sorted(r["ord"] for r in got.collect()) == [1, 3, 4, 5, 7]


def test_empty(spark):
    empty = spark.createDataFrame([], "ord long, text string")
    assert dedup.near_dedup(empty, "ord", "text").count() == 0
    assert dedup.greedy_keep(empty.select("ord", F.array().cast("array<long>").alias("keys"))).count() == 0


@pytest.mark.parametrize("n", [1, 5])
def test_first_by_keeps_ties(spark, n):
    df = spark.createDataFrame([("a", 1)] * n + [("a", 2)], "k string, o long")
    assert dedup.first_by(df, ["k"], "o").count() == n


def test_rows_that_share_nothing_take_part_in_no_round(spark, monkeypatch):
    """The rounds read those rows alone that share a key; a row without keys stays, one of a null order is left out."""
    sizes, plain = [], dedup.cut
    monkeypatch.setattr(dedup, "cut", lambda df: sizes.append((df.columns, (out := plain(df)).count())) or out)
    rows = [(k, [1000 + k, 2000 + k]) for k in range(50)] + [(60, [7, 1]), (61, [7, 2]), (62, []), (None, [7])]
    df = spark.createDataFrame(rows, "ord long, keys array<long>")
    assert sorted(r["ord"] for r in dedup.greedy_keep(df).collect()) == [*range(50), 60, 62]
    assert max(n for columns, n in sizes if "key" in columns) == 2


def test_conversations_are_read_once(spark, sf):
    from talkloom.plans import load, registry

    load()
    plan = registry.QUERIES["u3_conversations"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "text" not in plan
