import pytest
from pyspark.sql import functions as F

from talkloom.operators import generate
from talkloom.sources import reports


def test_report_escapes_and_refuses_tables(spark):
    df = spark.createDataFrame([("a|b", 1.25, None)], "x string, y double, z string")
    assert reports.markdown(df) == "| x | y | z |\n|---|---|---|\n| a\\|b | 1.2 |  |\n"
    with pytest.raises(ValueError, match="report"):
        reports.markdown(spark.range(5).toDF("k"), most=4)


def test_documents_are_replaced_whole(tmp_path):
    path = tmp_path / "d" / "p.json"
    reports.replace_document(path, {"a": "é"})
    with pytest.raises(TypeError):
        reports.replace_document(path, {"a": object()})
    assert path.read_text(encoding="utf-8") == '{"a": "é"}' and list(path.parent.iterdir()) == [path]


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "utf-16", "cp1252"])
def test_prompt_encodings(tmp_path, encoding):
    (tmp_path / "p").write_bytes("é ü".encode(encoding))
    assert reports.read_text(tmp_path / "p") == "é ü"


def test_run_folder(tmp_path):
    (tmp_path / "summary.json").write_text("{}")
    assert reports.resolve_run(tmp_path).name == "summary.json"
    (tmp_path / "judged.json").write_text("{}")
    assert reports.resolve_run(tmp_path).name == "judged.json"


def test_varied_context(spark):
    text = "[Apr 3] Mood 7/10, very poor\n[Apr 9] Mood 4/10"
    dates = ["Apr 1", "Apr 2", "Apr 3"]
    df = spark.range(200).select("id", F.lit(text).alias("t"))
    got = df.select(generate.redate(F.col("t"), dates, "d", F.col("id")).alias("d"), generate.rescore(F.col("t"), "s", F.col("id")).alias("s"), generate.reword(F.col("t"), [["very poor", "bad"]], "w", F.col("id")).alias("w")).collect()
    assert {r["d"] for r in got} == {text.replace("[Apr 3]", f"[{a}]").replace("[Apr 9]", f"[{b}]") for a, b in zip(dates, dates[1:], strict=False)}
    for r in got:
        a, b = (int(x) for x in __import__("re").findall(r"(\d+)/10", r["s"]))
        assert 6 <= a <= 9 and b < a
    assert {r["w"] for r in got} == {text, text.replace("very poor", "bad")}


def test_one_score_alone_stays(spark):
    df = spark.createDataFrame([("Mood 7/10", 1)], "t string, id long")
    assert df.select(generate.rescore(F.col("t"), "s", F.col("id")).alias("x")).first()["x"] == "Mood 7/10"
