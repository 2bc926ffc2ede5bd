import pytest
from pyspark.sql import functions as F

from talkloom.operators import turns

CASES = [
    ("normal", "suaua"), ("trailing_user", "uau"), ("trailing_system", "uas"), ("no_assistant", "uu"), ("single", "ua"), ("empty", ""),
]
ROLE = {"s": "system", "u": "user", "a": "assistant"}


@pytest.fixture(scope="module")
def convs(spark):
    rows = [(n, [(ROLE[r], f"{r}{k}") for k, r in enumerate(p)]) for n, p in CASES]
    return spark.createDataFrame(rows + [("missing", None)], f"id string, c {turns.MESSAGE}")


def shape(df, col):
    return {r["id"]: None if r["x"] is None else "".join(m["role"][0] for m in r["x"]) for r in df.select("id", col.alias("x")).collect()}


def test_assistant_last(convs):
    got = shape(convs, turns.assistant_last(F.col("c")))
    assert got == {"normal": "suaua", "trailing_user": "ua", "trailing_system": "ua", "no_assistant": "uu", "single": "ua", "empty": "", "missing": None}


def test_merge_users(convs):
    got = {r["id"]: r["x"] for r in convs.select("id", turns.merge_users(F.col("c")).alias("x")).collect()}
    assert [(m["role"], m["content"]) for m in got["no_assistant"]] == [("user", "u0\nu1")]
    assert len(got["normal"]) == 5 and got["empty"] == [] and got["missing"] is None


def test_system_does_not_count(convs):
    got = {r["id"]: r["n"] for r in convs.select("id", turns.n_turns(F.col("c")).alias("n")).collect()}
    assert got["normal"] == 4 and got["trailing_system"] == 2


def test_blank_turns_go_before_merging(spark):
    df = spark.createDataFrame([("x", [("user", "a"), ("user", "   "), ("assistant", "b")])], f"id string, c {turns.MESSAGE}")
    assert shape(df, turns.merge_users(turns.drop_blank(F.col("c"))))["x"] == "ua"


def test_tagged_text(spark):
    df = spark.createDataFrame([("x", "pre <|user|> a <|user|> <|assistant|> b")], "id string, t string")
    assert shape(df, turns.from_tagged(F.col("t")))["x"] == "uua"
    assert shape(df, turns.from_tagged(F.col("t"), prefix=False))["x"] == "ua"


def test_tags_count_at_line_starts_only(spark):
    df = spark.createDataFrame([("x", "lost\n<|user|> a\nmore <|assistant|> not\n\n<|assistant|> b")], "id string, t string")
    got = df.select(turns.from_tagged_lines(F.col("t")).alias("x")).first()["x"]
    assert [(m["role"], m["content"]) for m in got] == [("user", "a\nmore <|assistant|> not"), ("assistant", "b")]


def test_numbering_before_the_first_user(spark):
    df = spark.createDataFrame([("x", [("assistant", "hi"), ("user", "yo"), ("assistant", "ok")])], f"id string, c {turns.MESSAGE}")
    r = df.select(turns.judge_view(F.col("c"), "all_turns").alias("a"), turns.judge_view(F.col("c"), "final_turn").alias("f")).first()
    assert r["a"] == "AI T0: hi\nUser T1: yo\nAI T1: ok" and r["f"] == "User: yo\nAI: ok"


def test_newest_turn_stays_even_over_budget(spark):
    df = spark.createDataFrame([(1, 0, "user", "x" * 40), (1, 1, "assistant", "y" * 4000)], "conv_id long, turn long, role string, text string")
    assert [r["turn"] for r in turns.trim_to_budget(df, 50).collect()] == [1]


def test_chunk_may_end_inside_the_previous_window(spark):
    df = spark.createDataFrame([(list(range(9)),)], "t array<int>")
    got = df.select(turns.chunk(F.col("t"), 5, 2).alias("w")).first()["w"]
    assert got == [[0, 1, 2, 3, 4], [3, 4, 5, 6, 7], [6, 7, 8]]


def test_supervised_spans_cut_out_the_replies(convs):
    r = convs.where("id = 'normal'").select(turns.render(F.col("c")).alias("t"), turns.supervised_spans(F.col("c")).alias("s")).first()
    assert [r["t"][s["start"] : s["stop"]] for s in r["s"]] == ["a2<|eot_id|>", "a4<|eot_id|>"]


def test_conversations_that_read_alike_are_not_the_same(spark):
    kind = "id int, c array<struct<role:string,content:string>>"
    rows = [(1, [("user", "a\n--\nassistant|b")]), (2, [("user", "a"), ("assistant", "b")]), (3, [("user", "a"), ("assistant", "b")]), (4, [("user", None)]), (5, [("user", "")])]
    got = spark.createDataFrame(rows, kind).select("id", turns.same(F.col("c")).alias("k")).collect()
    keys = {r["id"]: r["k"] for r in got}
    assert keys[2] == keys[3] and len({keys[k] for k in (1, 2, 4, 5)}) == 4
