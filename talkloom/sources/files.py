"""Files of conversations, runs, logs and traces: JSON lines, JSON documents, partitioned logs.

All paths go to Spark's readers and writers, so any store that Spark knows will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from talkloom.operators.turns import MESSAGE

CONVERSATION = f"conversations {MESSAGE}, loss_weight double"
#: ``label_YYYYMMDD_HHMM`` with an optional tag (fixed format).
RUN_NAME = r"^(.+?)_(\d{8})_(\d{4})(?:_[a-zA-Z0-9]+)?$"


def parse_lines(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Lines that hold a JSON object as columns; blank and malformed ones are skipped."""
    line = F.trim(F.col(column))
    parsed = F.from_json(line, schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})
    rows = lines.where(line != "").withColumn("__p", parsed)
    return rows.where("__p is not null and __p._bad is null").select(*[c for c in lines.columns if c != column], "__p.*").drop("_bad")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str = CONVERSATION) -> DataFrame:
    """JSON lines under a path or glob, with the file's name; malformed lines are skipped."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    return parse_lines(lines, schema)


def count_malformed(spark: SparkSession, path: str | list[str], schema: str = CONVERSATION) -> DataFrame:
    """Per file: lines, and those ``read_jsonl`` skips although they are not blank."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_name").alias("file_name"))
    bad = F.from_json(F.trim("value"), schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
    filled = F.trim("value") != ""
    return lines.groupBy("file_name").agg(F.count("*").alias("n_lines"), F.count_if(filled & (bad.isNull() | bad["_bad"].isNotNull())).alias("n_malformed"))


def read_strict(spark: SparkSession, path: str, limit: int) -> DataFrame:
    """The first ``limit`` examples; the read fails at one without a conversation, a user or an assistant."""
    rows = read_jsonl(spark, path).limit(limit)
    has = lambda role: F.exists("conversations", lambda m: m["role"] == role)
    ok = (F.size(F.coalesce("conversations", F.array().cast(MESSAGE))) > 0) & has("user") & has("assistant")
    return rows.where(F.when(ok, True).otherwise(F.raise_error(F.lit("an example lacks a conversation, a user or an assistant turn")).cast("boolean")))


def write_jsonl(df: DataFrame, path: str, append: bool = False, by: list[str] | None = None) -> None:
    writer = df.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*by) if by else writer).json(path)


def read_documents(spark: SparkSession, path: str | list[str], schema: StructType | str | None = None, recursive: bool = True) -> DataFrame:
    """Whole-file JSON documents with their path; unreadable ones are skipped."""
    reader = spark.read.option("multiLine", True).option("mode", "DROPMALFORMED").option("recursiveFileLookup", recursive).option("pathGlobFilter", "*.json")
    return (reader.schema(schema) if schema else reader).json(path).withColumn("path", F.col("_metadata.file_path"))


def discover_runs(files: DataFrame, path: str = "path") -> DataFrame:
    """Judged documents of run folders first, then other top-level documents that are no judge's by-product; ``ord`` tells later ones."""
    judged = F.col(path).endswith("/judged.json")
    kept = files.where(judged | ~F.col(path).contains("_judged_"))
    return kept.withColumn("ord", F.struct((~judged).alias("top"), F.col(path).alias("path")))


def run_name(name: Column) -> Column:
    """Struct(label, date, time) of a run's file name without extension; nulls if it is none."""
    part = lambda k: F.nullif(F.regexp_extract(name, RUN_NAME, k), F.lit(""))
    return F.struct(part(1).alias("label"), part(2).alias("date"), part(3).alias("time"))


def remaining(jobs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Jobs whose key is not in what was written before."""
    return jobs.join(done.select(key).distinct(), key, "left_anti")


def shard(df: DataFrame, key: str, shards: int) -> DataFrame:
    """``df`` with a shard number and its seed, by hash of the key."""
    n = F.pmod(F.xxhash64(key), F.lit(shards)).cast("int")
    return df.withColumn("shard", n).withColumn("seed", F.lit(1000) + 7919 * n)


LOG = f"ts string, session string, model_id string, model_name string, history {MESSAGE}, response string"


def write_chat_log(rows: DataFrame, path: str) -> None:
    """Log rows under ``date=YYYY-MM-DD`` with personal data masked."""
    from talkloom.functions.text import scrub

    clean = rows.withColumn("response", scrub(F.col("response"))).withColumn("history", F.transform("history", lambda m: F.struct(m["role"].alias("role"), scrub(m["content"]).alias("content"))))
    write_jsonl(clean.withColumn("date", F.to_date("ts")), path, append=True, by=["date"])


def read_chat_log(spark: SparkSession, path: str) -> DataFrame:
    """Log rows with ``date`` from the folder; a filter on it reads no other folder."""
    return spark.read.schema(LOG + ", date date").option("mode", "DROPMALFORMED").json(path)


def normalise_messages(row: Column) -> Column:
    """Messages of a struct under alternative keys: ``conversations``, ``messages`` or ``from``/``value`` items."""
    fields = F.coalesce(row["conversations"], row["messages"])
    role = lambda m: F.coalesce(m["role"], m["from"])
    return F.transform(fields, lambda m: F.struct(F.when(role(m) == "human_system", "system").when(role(m) == "human", "user").when(role(m) == "gpt", "assistant").otherwise(role(m)).alias("role"), F.coalesce(m["content"], m["value"]).alias("content")))


def dialogue_lines(body: Column) -> Column:
    """Messages of lines like ``usr: hello``; once any line has such a prefix, lines without one are dropped, else roles alternate."""
    from talkloom.functions.text import strip

    lines = F.filter(F.transform(F.split(body, "\n"), strip), lambda x: x != "")
    pattern = r"(?i)^\s*(usr|sys|seeker|supporter)\s*[:\-]\s*(.+)$"
    tagged = F.filter(lines, lambda x: F.regexp_like(x, F.lit(pattern)))
    role = lambda x: F.when(F.lower(F.regexp_extract(x, pattern, 1)).isin("sys", "supporter"), "assistant").otherwise("user")
    named = F.transform(tagged, lambda x: F.struct(role(x).alias("role"), strip(F.regexp_extract(x, pattern, 2)).alias("content")))
    turned = F.transform(lines, lambda x, k: F.struct(F.when(k % 2 == 0, "user").otherwise("assistant").alias("role"), x.alias("content")))
    return F.when(F.size(tagged) > 0, named).otherwise(turned)


#: Keys under which corpora keep a dialogue, an utterance and its speaker, in the order they are tried (fixed values).
_DIALOGUE = ("dialog", "dialogs", "conversation", "conversations")
_UTTERANCE = ("text", "utterance", "content", "sentence")
_SPEAKER = ("speaker", "role", "agent_type", "who")


def _said(u: Column) -> Column:
    """A message of one utterance, a map: the first known key with text, else any text; unknown speakers are users."""
    from talkloom.functions.text import strip
    from talkloom.operators.turns import map_role, message

    filled = lambda x: F.nullif(strip(x), F.lit(""))
    known = [filled(F.try_element_at(u, F.lit(k))) for k in _UTTERANCE]
    other = F.get(F.filter(F.transform(F.map_values(u), filled), lambda x: x.isNotNull()), 0)
    speaker = F.coalesce(*[F.nullif(F.try_element_at(u, F.lit(k)), F.lit("")) for k in _SPEAKER])
    return message(F.coalesce(map_role(speaker), F.lit("user")), F.coalesce(*known, other))


def structured_dialogue(items: Column) -> Column:
    """Messages of an ``array<map<string,string>>`` of utterances; those without text are dropped."""
    return F.filter(F.transform(F.filter(items, lambda u: u.isNotNull()), _said), lambda m: m["content"].isNotNull())


def dialogue(body: Column) -> Column:
    """Messages of a text blob in any of the shapes that dialogue corpora use.

    An object with a list of utterances, a list of utterances or of strings (prefixed, or else with
    alternating roles), all as JSON or with single quotes; what gives no message so is read by lines.
    """
    from talkloom.functions.text import strip
    from talkloom.operators.turns import message

    raw = strip(body)
    inner = F.from_json(F.when(raw.startswith("{"), raw), ", ".join(f"{k} string" for k in _DIALOGUE))
    array = F.when(raw.startswith("["), raw)
    listed = F.coalesce(*[F.nullif(inner[k], F.lit("[]")) for k in _DIALOGUE], array)
    maps = structured_dialogue(F.from_json(F.when(listed.rlike(r"^\[\s*\{"), listed), "array<map<string,string>>"))
    pattern = r"(?i)^\s*(usr|sys|seeker|supporter)\s*[:\-]\s*(.+)$"
    texts = F.transform(F.from_json(F.when(~array.rlike(r"^\[\s*\{"), array), "array<string>"), lambda x: F.coalesce(strip(x), F.lit("")))
    spoken = F.transform(
        texts,
        lambda x, k: F.when(x.rlike(pattern), message(F.when(F.lower(F.regexp_extract(x, pattern, 1)).isin("sys", "supporter"), "assistant").otherwise("user"), strip(F.regexp_extract(x, pattern, 2)))).otherwise(
            message(F.when(k % 2 == 0, "user").otherwise("assistant"), x)
        ),
    )
    spoken = F.filter(spoken, lambda m: m["content"] != "")
    return F.when(F.size(maps) > 0, maps).when(F.size(spoken) > 0, spoken).otherwise(dialogue_lines(body))
