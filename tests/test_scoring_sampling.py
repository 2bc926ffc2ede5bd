import pytest
from pyspark.sql import functions as F

from talkloom.operators import pairs, prompts, rules, sampling, scoring, sessions, turns


@pytest.mark.parametrize(
    ("scores", "good", "bad", "kind"),
    [([3, 0, 1], 3, 1, "on_policy"), ([1, 2, 0], 3, 1, "hybrid"), ([3, 3, 3], 3, 1, "all_good"), ([3, 2, 2], 3, 1, "ambiguous"), ([None, 3, 0], 3, 1, "judge_failed"), ([2, 0], 2, 0, "on_policy"), ([2, 1], 2, 0, "ambiguous")],
)
def test_outcome(spark, scores, good, bad, kind):
    df = spark.createDataFrame([(scores,)], "s array<int>")
    assert df.select(pairs.outcome(F.col("s"), F.lit(good), F.lit(bad)).alias("o")).first()["o"]["kind"] == kind


@pytest.mark.parametrize(("a", "b", "label"), [(None, None, "missing"), (None, "PASS", "new"), ("PASS", None, "removed"), ("FAIL", "FAIL", "unchanged"), ("FAIL", "PASS", "improved"), ("PASS", "FAIL", "REGRESSED"), ("PASS", "AMBIGUOUS", "changed")])
def test_change(spark, a, b, label):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(scoring.change(F.col("a"), F.col("b")).alias("x")).first()["x"] == label


def test_spearman_needs_variance(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0)], "x int, y double")
    assert scoring.spearman(df, "x", "y").first()["rho"] is None
    df = spark.createDataFrame([(1, 3.0), (2, 2.0), (3, 1.0)], "x int, y double")
    assert scoring.spearman(df, "x", "y").first()["rho"] == pytest.approx(-1)


@pytest.mark.parametrize(("rates", "ok"), [((0.5, 0.46, 0.5), True), ((0.5, 0.44, 0.5), False)])
def test_calibration_slack(spark, rates, ok):
    rows = [(level, k < r * 100) for level, r in zip((1, 2, 3), rates, strict=True) for k in range(100)] + [(None, True)]
    got = scoring.calibration(spark.createDataFrame(rows, "level int, ok boolean"), "level", "ok").first()
    assert got["monotonic"] is ok and got["n_missing_level"] == 1


def test_split_counts(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    got = {r["split"]: r["count"] for r in sampling.split(df, "k").groupBy("split").count().collect()}
    assert got == {"val": 150, "train": 850}
    small = {r["split"]: r["count"] for r in sampling.split(df.limit(40), "k").groupBy("split").count().collect()}
    assert small == {"val": 4, "train": 36}


def test_prompt_round_trip_and_idempotence(spark):
    base, header = "Base.", "Remember [User] and [Recent sessions]:"
    rows = [("p", "m1\nm2", "h"), (None, "m", None), ("p", None, None), (None, None, None)]
    df = spark.createDataFrame(rows, "profile string, memory string, health string")
    df = df.withColumn("t", prompts.render(base, header, F.col("profile"), F.col("memory"), F.col("health")))
    back = df.select("profile", "memory", "health", prompts.seed_of(base, header, F.col("t")).alias("s"))
    for r in back.collect():
        assert (r["s"]["profile"], r["s"]["memory"], r["s"]["health"]) == (r["profile"], r["memory"], r["health"])
    once = prompts.normalise(base, header, F.col("t"))
    for r in df.where("health is null").select(once.alias("a"), prompts.normalise(base, header, once).alias("b")).collect():
        assert r["a"] == r["b"]


def test_live_stats_bounds(spark):
    rows = [("2024-01-02 10:00:00", "s1", "a"), ("2024-01-02 09:55:00", "s2", "b"), ("2024-01-01 23:00:00", "s1", None), (None, "s3", "b")]
    log = spark.createDataFrame(rows, "ts string, session string, model string").withColumn("ts", F.to_timestamp("ts"))
    r = sessions.live_stats(log, F.to_timestamp(F.lit("2024-01-02 10:00:00"))).first()
    assert (r["sessions"], r["sessions_today"], r["sessions_active"], r["messages"], r["top_model"]) == (3, 2, 2, 4, "b")


def test_progress_ignores_steps_that_do_not_grow(spark):
    lines = [(0.0, "step 5/100"), (10.0, "iter: 10"), (11.0, "step 10"), (12.0, "nothing"), (13.0, "step 0"), (30.0, "step 20/200")]
    df = spark.createDataFrame([("r", t, x) for t, x in lines], "run string, t double, line string")
    r = sessions.progress(df, "run", "t", "line").first()
    assert (r["step"], r["total"], r["seconds_per_step"]) == (20, 200, pytest.approx(0.2 * 2.0 + 0.8 * 2.0))


def test_pair_rules(spark):
    words = " ".join(f"w{k}" for k in range(10))
    other = " ".join(f"v{k}" for k in range(10))
    rows = [("ok", words, other), ("same", words, words), ("short", "a b", other), ("ratio", words, other * 4)]
    df = spark.createDataFrame(rows, "id string, a string, b string")
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.lit("hi").alias("content")))
    got = {r["id"]: r["ok"] for r in df.select("id", rules.pair_ok(prompt, F.col("a"), F.col("b"), F.lit("other")).alias("ok")).collect()}
    assert got == {"ok": True, "same": False, "short": False, "ratio": False}


def test_question_rule_has_two_versions(spark):
    check = F.struct(F.lit("ends_question").alias("type"), F.lit(None).cast("string").alias("value"), F.lit(None).cast("array<string>").alias("values"), F.lit(None).cast("int").alias("min"), F.lit(None).cast("int").alias("max"))
    df = spark.createDataFrame([("Are you ok? I am here.",)], "x string")
    r = df.select(rules.rule_check(F.col("x"), check).alias("a"), rules.rule_check(F.col("x"), check, True).alias("b")).first()
    assert (r["a"], r["b"]) == (False, True)
    assert turns.MESSAGE.startswith("array<struct<")
