import json

import pytest
from pyspark.sql import functions as F

from talkloom.sources import files
from talkloom.streaming import streams


def test_jsonl_skips_what_it_cannot_read(spark, tmp_path):
    good = json.dumps({"conversations": [{"role": "user", "content": "é"}], "loss_weight": 2.0}, ensure_ascii=False)
    (tmp_path / "a.jsonl").write_text(f"{good}\n\n{{broken\n{good}\n", encoding="utf-8")
    df = files.read_jsonl(spark, str(tmp_path / "*.jsonl"))
    assert [(r["file_name"], r["loss_weight"], r["conversations"][0]["content"]) for r in df.collect()] == [("a.jsonl", 2.0, "é")] * 2
    assert files.count_malformed(spark, str(tmp_path / "*.jsonl")).first()["n_malformed"] == 1


def test_strict_read_fails(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text(json.dumps({"conversations": [{"role": "user", "content": "x"}]}))
    with pytest.raises(Exception, match="lacks a conversation"):
        files.read_strict(spark, str(tmp_path / "a.jsonl"), 5).collect()


def test_chat_log_masks_and_prunes(spark, tmp_path):
    rows = [("2024-01-01T10:00:00", "s", "m", "M", [("user", "a@b.org")], "call 91234567 89")]
    files.write_chat_log(spark.createDataFrame(rows, files.LOG), str(tmp_path / "log"))
    back = files.read_chat_log(spark, str(tmp_path / "log")).where(F.col("date") == "2024-01-01").first()
    assert back["history"][0]["content"] == "[EMAIL]" and back["response"] == "call [PHONE]"


def test_dialogue_lines(spark):
    df = spark.createDataFrame([("usr: a\nlost\nSYS - b",), ("x\ny",)], "t string")
    got = [[(m["role"], m["content"]) for m in r["c"]] for r in df.select(files.dialogue_lines(F.col("t")).alias("c")).collect()]
    assert got == [[("user", "a"), ("assistant", "b")], [("user", "x"), ("assistant", "y")]]


def test_trace_stream_counts_levels(spark, tmp_path):
    lines = [{"ts": "2024-01-01T00:00:00Z", "event": "e", "level": lv} for lv in ("info", "error", "error")]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "t.jsonl").write_text("\n".join([*map(json.dumps, lines), "{bad"]))
    q = streams.severities(streams.trace(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("levels").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert {r["level"]: r["n"] for r in spark.table("levels").collect()} == {"info": 1, "error": 2}


def test_progress_stream_keeps_state_over_batches(spark, tmp_path):
    schema = "run string, t double, step long"
    for k, part in enumerate(([("r", 0.0, 1), ("r", 2.0, 2)], [("r", 4.0, 3), ("r", 4.5, 3), ("r", 6.0, 4)])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if k == 0:
            lines = spark.readStream.schema(schema).json(str(tmp_path / "in"))
            q = streams.progress(lines, every=2).writeStream.format("memory").queryName("progress").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
    q.stop()
    assert [(r["step"], r["seconds_per_step"]) for r in spark.table("progress").orderBy("step").collect()] == [(2, 2.0), (4, 2.0)]


def test_bounded_loop_accepts_by_batch(spark, tmp_path):
    spark.range(10).write.json(str(tmp_path / "in"))
    got = []
    stream = spark.readStream.schema("id long").json(str(tmp_path / "in"))
    q = streams.bounded_loop(stream, lambda df: df.where("id % 2 = 0"), lambda df, n: got.extend(r["id"] for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(got) == [0, 2, 4, 6, 8]
