import pytest
from pyspark.sql import functions as F

from talkloom.functions import parse, text
from talkloom.plans import load, registry


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "clean"),
    [("a &amp; b", "a & b"), ("&lt;b&gt;x&lt;/b&gt;", "x"), ("<p>x</p>", "x"), ("hi _comma_ there _period_", "hi, there."), ("a   b\t c", "a b c"), ("word \n , next", "word, next"), ("x , y", "x, y"), ("", ""), (None, None)],
)
def test_clean_text(spark, raw, clean):
    assert one(spark, raw, text.clean_text) == clean


@pytest.mark.parametrize(("raw", "clean"), [("mail a.b@c.org now", "mail [EMAIL] now"), ("call +65 9123 4567", "call +[PHONE]"), ("123456789", "123456789"), ("2024-01-01 00:00:07", "[PHONE]:00:07")])
def test_scrub(spark, raw, clean):
    assert one(spark, raw, text.scrub) == clean


def test_similarity(spark):
    df = spark.createDataFrame([("the éa b", "éa c"), ("the", "of"), ("", "x"), (None, "x")], "a string, b string")
    got = [r["s"] for r in df.select(text.similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert got == [pytest.approx(1 / 3), 0.0, 0.0, 0.0]


@pytest.mark.parametrize(("raw", "answer"), [("YES", "YES"), ("no.", "NO"), ("Answer: YES", "YES"), ("yes and no", "UNCLEAR"), ("thinking…\nNO", "NO"), ("knowing", "UNCLEAR"), ("", "UNCLEAR"), (None, "UNCLEAR")])
def test_judge_answer(spark, raw, answer):
    assert one(spark, raw, parse.judge_answer) == answer


def test_judge_answers_are_their_sql_on_odd_texts(spark, tmp_path):
    """Letters beyond A-Z border a word in the SQL, where only a line feed ends a line and only spaces are blank."""
    import duckdb

    texts = ["En ñdoció osque noñrrezar.", "mañana\nyesñ", "a\nNO\n\t", "a\rb\nyes \u00a0", "no_ñ", "ñno yesñ", "", " \n ", None, "final answer:no"]
    rows = [(6 * k + 5, k, "user", t) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    load()
    want = con.execute(registry.ORACLES["judge_answers"]).fetchall()
    assert sorted(tuple(r) for r in registry.QUERIES["judge_answers"](spark, str(tmp_path)).collect()) == sorted(want)


@pytest.mark.parametrize(("raw", "score"), [('{"q1":1,"q2":0,"q3":true}', 2), ("prose", None), ('x "YES" y', 1), ("", None)])
def test_judge_score(spark, raw, score):
    assert one(spark, raw, parse.judge_score) == score


@pytest.mark.parametrize(
    ("raw", "found"),
    [('```json\n{"a": "x", "b": 2}\n```', True), ('{"a": "x", "b": 2}', True), ('<think>{"a":0}</think>{"a": "x", "b": 2', True), ('oops "a": "x" and "b": 2', True), ('only "a": "x"', False), ("{}", False), ("prose", False)],
)
def test_first_object(raw, found):
    got = parse.first_object(raw, ("a", "b"))
    assert (got == {"a": "x", "b": 2}) if found else got is None


def test_session_update(spark):
    got = one(spark, "x\n[FINAL_UPDATE]\nMOOD: Calm\nTopics: a, ,b\nSUMMARY: one\ntwo", parse.session_update)
    assert (got["mood"], got["topics"], got["risk_level"], got["summary"]) == ("Calm", ["a", "b"], None, "one\ntwo")


def test_mood_precedence(spark):
    assert one(spark, "I am sad and in PANIC", parse.mood) == "Panic" and one(spark, "", parse.mood) == "Neutral"


@pytest.mark.parametrize(("raw", "want"), [('x {"a": {"b": "}"}} y {', {"a": {"b": "}"}}), ('{"a": ["x", "y', {"a": ["x", "y"]}), ('{"a": "q\\"}", "b": [1, 2', {"a": 'q"}', "b": [1, 2]}), ("[1, 2]", None), ('```json\n{"a": 1}', {"a": 1})])
def test_cut_and_nested_objects(raw, want):
    assert parse.first_object(raw) == want
