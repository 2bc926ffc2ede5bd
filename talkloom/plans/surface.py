"""Queries of sources, the language-model surface, and event windows (``ext_``: beyond the reference's own)."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.functions import llm, parse
from talkloom.operators import prompts, turns
from talkloom.plans.registry import query
from talkloom.plans.tables import CONV, conversations, table
from talkloom.sources import files
from talkloom.streaming import streams


@query(sql="SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY conv_id")
def io1_io2_jsonl(spark, sf_dir):
    """Conversations as JSON lines, a third of them preceded by broken or blank ones, read again."""
    c = conversations(spark, sf_dir).select("conv_id", F.to_json(F.struct(F.col("c").alias("conversations"))).alias("value"))
    noisy = c.select("conv_id", F.explode(F.array(F.lit("  "), F.lit('{"conversations": ['), F.col("value"))).alias("value"))
    rows = files.parse_lines(noisy, files.CONVERSATION)
    chars = F.aggregate("conversations", F.lit(0).cast("bigint"), lambda a, m: a + F.length(m["content"]))
    return rows.select("conv_id", F.size("conversations").cast("bigint").alias("n"), chars.alias("chars"))


@query(sql=r"SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE event_type || '_ck' || user_id END AS label, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%Y%m%d') END AS date, CASE WHEN event_type = 'error' THEN NULL ELSE strftime(ts, '%H%M') END AS time FROM events")
def io9_run_names(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_type") == "error", "latest").otherwise(F.concat("event_type", F.lit("_ck"), F.col("user_id").cast("string"), F.lit("_"), F.date_format("ts", "yyyyMMdd"), F.lit("_"), F.date_format("ts", "HHmm"), F.when(F.col("event_type") == "view", "_full").otherwise("")))
    return e.select("event_id", files.run_name(name).alias("r")).select("event_id", "r.label", "r.date", "r.time")


@query(sql="SELECT count(*) AS n, min(path) AS first, max(path) AS last FROM (SELECT CASE event_type WHEN 'view' THEN 'runs/' || event_id || '/judged.json' WHEN 'click' THEN 'x_judged_' || event_id || '.json' ELSE event_id || '.json' END AS path FROM events) WHERE path LIKE '%/judged.json' OR NOT contains(path, '_judged_')")
def io8_discover(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.when(F.col("event_type") == "view", F.concat(F.lit("runs/"), F.col("event_id").cast("string"), F.lit("/judged.json"))).when(F.col("event_type") == "click", F.concat(F.lit("x_judged_"), F.col("event_id").cast("string"), F.lit(".json"))).otherwise(F.concat(F.col("event_id").cast("string"), F.lit(".json")))
    return files.discover_runs(e.select(path.alias("path"))).agg(F.count("*").alias("n"), F.min("path").alias("first"), F.max("path").alias("last"))


@query(sql="SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def io16_resume(spark, sf_dir):
    return files.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query()
def io18_shards(spark, sf_dir):
    d = files.shard(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 4)
    return d.groupBy("shard", "seed").agg(F.count("*").alias("n"))


@query(sql=f"""WITH {CONV} SELECT conv_id, len(list_filter(c, lambda m: m.role <> 'system')) AS n FROM conv WHERE len(list_filter(c, lambda m: m.role <> 'system')) >= 4""")
def p6_dialogue_lines(spark, sf_dir):
    """Prefixed lines, read back; lines without a prefix are dropped as soon as one has it."""
    line = lambda m: F.concat(F.when(m["role"] == "user", "usr: ").when(m["role"] == "assistant", "SUPPORTER - ").otherwise(""), F.lit("x"), F.replace(m["content"], F.lit("\n"), F.lit(" ")))
    c = conversations(spark, sf_dir).select("conv_id", files.dialogue_lines(F.array_join(F.transform("c", line), "\n")).alias("c"))
    return c.where(turns.packable(F.col("c"))).select("conv_id", F.size("c").cast("bigint").alias("n"))


@query(sql=r"""WITH m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'assistant' ELSE 'user' END AS role, trim(regexp_replace(text, '[^a-zA-Z0-9 ]', '', 'g'), ' ') AS t FROM conversations)
    SELECT conv_id, count(*) AS n, string_agg(role || '|' || t, chr(10) || '--' || chr(10) ORDER BY turn) AS body FROM m WHERE t <> '' GROUP BY conv_id""")
def p6_dialogue_shapes(spark, sf_dir):
    """Conversations written in five shapes of text blobs, and read back by one loader."""
    plain = lambda m: turns.message(m["role"], F.trim(F.regexp_replace(m["content"], "[^a-zA-Z0-9 ]", "")))
    c = conversations(spark, sf_dir).select("conv_id", F.filter(F.transform("c", plain), lambda m: m["content"] != "").alias("c")).where(F.size("c") > 0)
    spoken = F.transform("c", lambda m: F.concat(F.when(m["role"] == "assistant", "sys: ").otherwise("Seeker - "), m["content"]))
    listed = F.to_json(F.transform("c", lambda m: F.struct(F.lit("").alias("text"), m["content"].alias("utterance"), F.when(m["role"] == "assistant", "Therapist").otherwise("client").alias("speaker"))))
    quoted = F.concat(F.lit("{'dialogs': ["), F.array_join(F.transform("c", lambda m: F.concat(F.lit("{'role': '"), m["role"], F.lit("', 'content': '"), m["content"], F.lit("'}"))), ", "), F.lit("]}"))
    shapes = [F.to_json(F.struct(F.col("c").alias("conversation"))), listed, F.to_json(spoken), quoted, F.array_join(spoken, "\n")]
    body = F.coalesce(*[F.when(F.col("conv_id") % len(shapes) == k, s) for k, s in enumerate(shapes)])
    read = c.select("conv_id", files.dialogue(body).alias("c"))
    return read.select("conv_id", F.size("c").cast("bigint").alias("n"), turns.flat(F.col("c")).alias("body"))


@query(sql=f"WITH {CONV} SELECT conv_id, len(c) AS n, c[1].role AS first_role FROM conv")
def d4_alternate_keys(spark, sf_dir):
    """``from``/``value`` items with other role names."""
    name = lambda r: F.when(r == "system", "human_system").when(r == "user", "human").otherwise("gpt")
    item = lambda m: F.struct(F.lit(None).cast("string").alias("role"), F.lit(None).cast("string").alias("content"), name(m["role"]).alias("from"), m["content"].alias("value"))
    none = F.lit(None).cast("array<struct<role:string,content:string,from:string,value:string>>")
    c = conversations(spark, sf_dir).select("conv_id", F.struct(none.alias("conversations"), F.transform("c", item).alias("messages")).alias("row"))
    c = c.select("conv_id", files.normalise_messages(F.col("row")).alias("c"))
    return c.select("conv_id", F.size("c").cast("bigint").alias("n"), F.get("c", 0)["role"].alias("first_role"))


_MD5 = "('0x' || substr(md5(p), 1, 2))::BIGINT"
_REPLY = "CASE WHEN k < 32 THEN 'UNCLEAR' WHEN k % 2 = 1 THEN 'YES' ELSE 'NO' END"


@query(sql=f"""WITH {CONV}, t AS (SELECT conv_id, array_to_string(list_transform(list_filter(c, lambda m: m.role <> 'system'), lambda m: CASE m.role WHEN 'user' THEN 'User' ELSE 'AI' END || ': ' || m.content), chr(10)) AS t FROM conv),
    q AS (SELECT conv_id, 'Conversation:' || chr(10) || t || chr(10) || chr(10) || 'Question: Is it kind?' || chr(10) AS h FROM t),
    a AS (SELECT conv_id, {_REPLY} AS x FROM (SELECT conv_id, {_MD5.replace('(p)', "(h || 'Answer YES or NO only.')")} AS k FROM q)),
    b AS (SELECT conv_id, {_REPLY} AS y FROM (SELECT conv_id, {_MD5.replace('(p)', "(h || 'Think step by step, then write YES or NO on the last line.')")} AS k FROM q)),
    r AS (SELECT conv_id, CASE WHEN x = 'UNCLEAR' THEN y ELSE x END AS answer, x = 'UNCLEAR' AS retried FROM a JOIN b USING (conv_id))
    SELECT conv_id, answer, retried, CASE answer WHEN 'UNCLEAR' THEN 'AMBIGUOUS' WHEN 'YES' THEN 'PASS' ELSE 'FAIL' END AS verdict FROM r""")
def judge_with_retry(spark, sf_dir):
    """A judge behind the stub model; unclear answers are asked again, others are not."""
    seen = turns.judge_view(F.col("c"), "any_turn")
    q = F.lit("Is it kind?")
    c = conversations(spark, sf_dir).select("conv_id", prompts.judge_prompt(q, seen).alias("p"), prompts.judge_prompt(q, seen, True).alias("again"), F.lit("YES").alias("pass_if"))
    return llm.judge(c, "p", "again", "pass_if").select("conv_id", "answer", "retried", "verdict")


@query()
def pp4_generate_and_repair(spark, sf_dir):
    c = conversations(spark, sf_dir).select("conv_id", turns.dump(F.col("c")).alias("p"))
    out = llm.generate_and_repair(c, "p", lambda r: parse.judge_answer(r) == "YES", lambda p, r: F.concat(p, F.lit("\nRewrite: "), r))
    return out.select("conv_id", "source", "reply")


@query(sql="SELECT conv_id, 2 * count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id")
def pp5_pp6_two_phase(spark, sf_dir):
    """User turns first, then answers turn by turn."""
    users = F.transform(turns.of_role(F.col("c"), "user"), lambda m: m["content"])
    c = conversations(spark, sf_dir).select("conv_id", users.alias("users")).where("size(users) > 0")
    return llm.answer_turns(c, "conv_id", "users").select("conv_id", F.size("c").cast("bigint").alias("n"))


@query(sql="SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def ext_tumbling_windows(spark, sf_dir):
    return streams.windows(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


@query(sql="""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER w >= INTERVAL 5 MINUTE, true)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 5 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def ext_session_windows(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events"))
