"""Queries of session analytics, prompts and preference pairs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkloom.functions import text
from talkloom.operators import pairs, prompts, rules, sessions, turns
from talkloom.plans.registry import query
from talkloom.plans.tables import CONV, conversations, table, words_sql
from talkloom.plans.text import _TOK, _jaccard_sql


@query(sql="""WITH m AS (SELECT max(ts) AS t FROM events), e AS (SELECT ts, user_id, event_type, t FROM events, m),
    top AS (SELECT event_type FROM events GROUP BY event_type ORDER BY count(*) DESC, min(ts) LIMIT 1)
    SELECT count(DISTINCT user_id) AS sessions, count(DISTINCT user_id) FILTER (ts::DATE = t::DATE) AS sessions_today, count(DISTINCT user_id) FILTER (ts >= t - INTERVAL 5 MINUTE) AS sessions_active,
      count(*) AS messages, count(*) FILTER (ts::DATE = t::DATE) AS messages_today, (SELECT event_type FROM top) AS top_model FROM e""")
def a8_st3_live_stats(spark, sf_dir):
    """Sessions and messages as of the last event."""
    e = table(spark, sf_dir, "events").select("ts", F.col("user_id").alias("session"), F.col("event_type").alias("model"))
    as_of = F.lit(e.agg(F.max("ts").alias("t")).first()["t"])
    return sessions.live_stats(e, as_of)


@query(sql="""WITH r AS (SELECT user_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events)
    SELECT user_id, event_type AS topic, count(*) AS n, min(ts) AS first_detected FROM r WHERE k <= 10 GROUP BY ALL HAVING count(*) >= 2""")
def a13_w1_recurring_topics(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    recent = sessions.last_sessions(e, "user_id", [F.desc("ts"), F.col("event_id")], 10)
    return sessions.recurring_topics(recent, "user_id", F.col("event_type"), "ts")


@query(sql="""WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) AS k FROM c) SELECT user_id, event_type, n FROM r WHERE k <= 3""")
def k1_top_patterns(spark, sf_dir):
    c = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return sessions.last_sessions(c, "user_id", [F.desc("n"), F.col("event_type")], 3)


@query(sql="SELECT user_id, max(ts) AS last_ts FROM events GROUP BY user_id ORDER BY last_ts DESC, user_id")
def k2_sessions_by_time(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").alias("last_ts")).orderBy(F.desc("last_ts"), "user_id")


@query(sql="SELECT user_id, arg_max(event_type, (ts, event_id)) AS current_mood, count(*) AS n FROM events GROUP BY user_id")
def k4_current_mood(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("current_mood"), F.count("*").alias("n"))


@query(sql="SELECT event_type, count(*) FILTER (value > 50) AS warnings, count(*) FILTER (value > 90) AS errors, count(*) AS n FROM events GROUP BY event_type")
def a29_severities(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("warnings"), F.count_if(F.col("value") > 90).alias("errors"), F.count("*").alias("n"))


@query(sql="""WITH RECURSIVE r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
    e AS (SELECT user_id, k, value AS v FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.k, 0.2 * r.value + 0.8 * e.v FROM e JOIN r ON r.user_id = e.user_id AND r.k = e.k + 1)
    SELECT user_id, round(arg_max(v, k), 6) AS ema FROM e GROUP BY user_id""")
def w9_st1_ema(spark, sf_dir):
    """Smoothed rate of each user, by an ordered fold."""
    packed = F.array_sort(F.collect_list(F.struct("ts", "event_id", "value")))
    e = table(spark, sf_dir, "events").groupBy("user_id").agg(packed.alias("p"))
    return e.select("user_id", F.round(sessions.ema(F.transform("p", lambda x: x["value"])), 6).alias("ema"))


@query(sql="SELECT user_id, count(*) AS step, count(*) + 5 AS total FROM events GROUP BY user_id")
def st1_progress(spark, sf_dir):
    """Training-log lines made from events: one step each."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("k"), F.count("*").over(Window.partitionBy("user_id")).alias("n"))
    lines = e.select("user_id", F.col("k").alias("t"), F.concat(F.lit("loss 1.0 step "), F.col("k").cast("string"), F.lit("/"), (F.col("n") + 5).cast("string")).alias("line"))
    return sessions.progress(lines, "user_id", "t", "line").select("user_id", "step", "total")


_BASE, _HEADER = "You are a study companion.", "Memory:"
_SEED = """seed AS (SELECT doc_id, CASE WHEN lang <> 'de' THEN 'Name: ' || source END AS profile, CASE WHEN lang IN ('en', 'fr') THEN '[Apr 3] ' || lang || chr(10) || '[Apr 9] ' || n_chars END AS memory, CASE WHEN source = 'src0' THEN 'sleep 6h' END AS health FROM documents)"""
_RENDERED = f"""rendered AS (SELECT *, concat_ws(chr(10) || chr(10), '[User]' || chr(10) || profile, '[Recent sessions]' || chr(10) || memory, '[Health data — last 7 days]' || chr(10) || health) AS blocks FROM seed),
  prompts AS (SELECT *, CASE WHEN blocks = '' THEN '{_BASE}' ELSE '{_BASE}' || chr(10) || chr(10) || '{_HEADER}' || chr(10) || blocks END AS prompt FROM rendered)"""


def _seeds(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    profile = F.when(F.col("lang") != "de", F.concat(F.lit("Name: "), "source"))
    memory = F.when(F.col("lang").isin("en", "fr"), F.concat(F.lit("[Apr 3] "), "lang", F.lit("\n[Apr 9] "), F.col("n_chars").cast("string")))
    s = d.select("doc_id", profile.alias("profile"), memory.alias("memory"), F.when(F.col("source") == "src0", "sleep 6h").alias("health"))
    return s.withColumn("prompt", prompts.render(_BASE, _HEADER, F.col("profile"), F.col("memory"), F.col("health")))


@query(sql=f"WITH {_SEED}, {_RENDERED} SELECT doc_id, prompt FROM prompts")
def p13_render_prompt(spark, sf_dir):
    return _seeds(spark, sf_dir).select("doc_id", "prompt")


@query(sql=f"WITH {_SEED}, {_RENDERED} SELECT doc_id, profile, memory, health, true AS same FROM prompts")
def p26_p27_seed_round_trip(spark, sf_dir):
    s = _seeds(spark, sf_dir).select("doc_id", "prompt", prompts.seed_of(_BASE, _HEADER, F.col("prompt")).alias("s"))
    again = prompts.render(_BASE, _HEADER, F.col("s.profile"), F.col("s.memory"), F.col("s.health"))
    return s.select("doc_id", "s.profile", "s.memory", "s.health", (again == F.col("prompt")).alias("same"))


@query(sql=f"WITH {_SEED}, {_RENDERED} SELECT doc_id, prompt AS full, '' AS none, '{_BASE}' AS preamble FROM prompts".replace("AS full", 'AS "full"').replace("AS none", 'AS "none"'))
def p14_prompt_modes(spark, sf_dir):
    return _seeds(spark, sf_dir).select("doc_id", *[prompts.variant(_BASE, F.col("prompt"), m).alias(m) for m in ("full", "none", "preamble")])


@query(sql=f"""WITH {_SEED}, b AS (SELECT doc_id, profile, memory, concat_ws(chr(10) || chr(10), '[User]' || chr(10) || profile, '[Recent sessions]' || chr(10) || memory) AS blocks FROM seed)
    SELECT doc_id, CASE WHEN profile IS NULL AND memory IS NULL THEN 'skipped' WHEN doc_id % 2 = 0 THEN 'rebuilt' ELSE 'salvaged' END AS kind,
      CASE WHEN profile IS NULL AND memory IS NULL THEN CASE WHEN doc_id % 2 = 0 THEN '{_BASE}' ELSE '' END ELSE '{_BASE}' || chr(10) || chr(10) || '{_HEADER}' || chr(10) || blocks END AS prompt FROM b""")
def p23_p25_normalise(spark, sf_dir):
    """Loose and stripped prompts brought to the canonical form."""
    s = _seeds(spark, sf_dir)
    loose = F.concat_ws("\n", F.lit(_BASE), F.when(F.col("profile").isNotNull(), F.concat(F.lit("[User]\n\n"), "profile", F.lit("\n"))), F.when(F.col("memory").isNotNull(), F.concat(F.lit("[Recent sessions]\n"), "memory", F.lit("  "))))
    bare = F.concat_ws(" ", F.when(F.col("profile").isNotNull(), F.concat(F.lit("[User] "), "profile")), F.when(F.col("memory").isNotNull(), F.concat(F.lit("[Recent sessions] "), "memory")))
    prompt = F.when(F.col("doc_id") % 2 == 0, F.when(F.col("profile").isNull() & F.col("memory").isNull(), F.lit(_BASE)).otherwise(loose)).otherwise(bare)
    return s.select("doc_id", prompts.route(_BASE, _HEADER, prompt).alias("r")).select("doc_id", "r.kind", "r.prompt")


_WHO, _DOES = ("The AI", "the MODEL", "Nova", "The user"), ("avoids", "does not give", "gives", "never gives", "refrains from", "not saying")


@query(sql=f"""WITH q AS (SELECT doc_id, {list(_WHO)}[doc_id % 4 + 1] AS who, {list(_DOES)}[doc_id // 4 % 6 + 1] AS does FROM documents)
    SELECT doc_id, lower(who) <> 'the user' AND does <> 'gives' AND NOT (lower(who) = 'the model' AND does = 'not saying') OR lower(who) = 'the model' AND does = 'not saying' AS negative FROM q""")
def p28_negative_flag(spark, sf_dir):
    """Criteria of every subject with every verb, some of them about the user or without a negation."""
    who, does = (F.get(F.array(*map(F.lit, x)), k.cast("int")) for x, k in ((_WHO, F.col("doc_id") % 4), (_DOES, F.floor(F.col("doc_id") / 4) % 6)))
    q = F.concat(F.lit("Does it hold that "), who, F.lit(" "), does, F.lit(" advice?"))
    return table(spark, sf_dir, "documents").select("doc_id", prompts.is_negative(q, "Nova").alias("negative"))


@query(sql=f"WITH {CONV}, t AS (SELECT conv_id, array_to_string(list_transform(list_filter(c, lambda m: m.role <> 'system'), lambda m: CASE m.role WHEN 'user' THEN 'User' ELSE 'AI' END || ': ' || m.content), chr(10)) AS t FROM conv) SELECT conv_id, 'Conversation:' || chr(10) || t || chr(10) || chr(10) || 'Question: Is it kind?' || chr(10) || 'Answer YES or NO only.' AS prompt FROM t")
def p30_p33_judge_prompt(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", prompts.judge_prompt(F.lit("Is it kind?"), turns.judge_view(F.col("c"), "any_turn")).alias("prompt"))


@query(sql="""WITH s AS (SELECT user_id, ts, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k FROM events),
    r AS (SELECT user_id, string_agg('- ' || ts::DATE || ': ' || event_type, chr(10) ORDER BY k) AS recent FROM s WHERE k <= 3 GROUP BY user_id) SELECT user_id, 'Recent:' || chr(10) || recent AS context FROM r""")
def p36_profile_context(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    recent = sessions.last_sessions(e, "user_id", [F.desc("ts"), F.col("event_id")], 3)
    packed = F.reverse(F.array_sort(F.collect_list(F.struct("ts", (-F.col("event_id")).alias("o"), "event_type"))))
    lines = F.transform(packed, lambda x: F.concat(F.lit("- "), F.date_format(x["ts"], "yyyy-MM-dd"), F.lit(": "), x["event_type"]))
    return recent.groupBy("user_id").agg(F.concat(F.lit("Recent:\n"), F.array_join(lines, "\n")).alias("context"))


@query(sql="SELECT doc_id, lang, source FROM documents")
def p39_p11_strip_meta(spark, sf_dir):
    """Training rows from raw ones: the nested meta goes, the tags become columns."""
    raw = table(spark, sf_dir, "documents").select("doc_id", F.struct("lang", "source", "n_chars").alias("meta"))
    return raw.select("doc_id", "meta.lang", "meta.source")


@query(sql=r"""WITH t AS (SELECT doc_id, trim(lang) AS q, text AS a FROM documents) SELECT doc_id, q || chr(10) || substr(a, 1, 20) AS question, length(a) AS n FROM t WHERE length(a) >= 40""")
def p8_question_answer(spark, sf_dir):
    """Question and answer rows: titles and bodies joined, short answers out."""
    d = table(spark, sf_dir, "documents")
    q = F.concat_ws("\n", F.col("lang"), F.substring("text", 1, 20))
    return d.where(F.length("text") >= 40).select("doc_id", q.alias("question"), F.length("text").cast("bigint").alias("n"))


@query(sql=r"SELECT doc_id, regexp_replace(CASE WHEN lang = 'de' THEN text ELSE source END, '^\s+|\s+$', '', 'g') AS found FROM documents")
def p5_first_text(spark, sf_dir):
    """The first of several optional text fields that is not blank."""
    blank = F.when(F.col("lang") == "de", F.col("text")).otherwise(F.lit("  "))
    fields = [F.lit(None).cast("string"), blank, F.lit(""), F.col("source")]
    found = F.coalesce(*[F.nullif(text.strip(f), F.lit("")) for f in fields])
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("found"))


_PAIRS = f"""{CONV}, t AS (SELECT conv_id, list_filter(c, lambda m: m.role = 'assistant') AS a, c FROM conv),
  p AS (SELECT conv_id, len(c) AS n, a[1].content AS chosen, a[len(a)].content AS rejected, CASE conv_id % 3 WHEN 0 THEN 'mixed_mode' WHEN 1 THEN 'casual_sad' ELSE 'other' END AS category, list_contains(list_transform(c, lambda m: m.role), 'user') AS asked FROM t WHERE len(a) >= 2)"""


@query(sql=f"""WITH {_PAIRS}, w AS (SELECT *, {words_sql('chosen')} AS x, {words_sql('rejected')} AS y, {_TOK.format(x='chosen')} AS s, {_TOK.format(x='rejected')} AS t FROM p)
    SELECT conv_id, {_jaccard_sql('s', 't')} <= 0.7 AND x >= 8 AND y >= 8 AND greatest(x, y) / greatest(least(x, y), 1) <= 2.5 AND asked AND NOT (category = 'mixed_mode' AND n < 7)
      AND NOT (category = 'casual_sad' AND (contains(lower(chosen), 'breathe in') OR contains(lower(chosen), 'body scan'))) AS ok FROM w""")
def f16_f22_pair_rules(spark, sf_dir):
    a = turns.of_role(F.col("c"), "assistant")
    c = conversations(spark, sf_dir).withColumn("a", a).where(F.size("a") >= 2)
    category = F.when(F.col("conv_id") % 3 == 0, "mixed_mode").when(F.col("conv_id") % 3 == 1, "casual_sad").otherwise("other")
    ok = rules.pair_ok(F.col("c"), F.get("a", 0)["content"], F.element_at("a", -1)["content"], category)
    return c.select("conv_id", ok.alias("ok"))


@query(sql="""WITH s AS (SELECT doc_id, CASE WHEN doc_id % 10 = 0 THEN [NULL, 3, 0] ELSE [doc_id % 4, doc_id // 4 % 4, n_chars % 4] END AS s FROM documents), m AS (SELECT doc_id, s, list_max(s) AS hi, list_min(s) AS lo, len(s) <> len(list_filter(s, lambda x: x IS NOT NULL)) AS bad FROM s)
    SELECT doc_id, CASE WHEN bad THEN 'judge_failed' WHEN hi >= 3 AND lo <= 1 THEN 'on_policy' WHEN hi < 3 THEN 'hybrid' WHEN lo >= 3 THEN 'all_good' ELSE 'ambiguous' END AS kind, list_position(s, hi) - 1 AS best, list_position(s, lo) - 1 AS worst FROM m""")
def pp2_pair_selection(spark, sf_dir):
    s = F.when(F.col("doc_id") % 10 == 0, F.array(F.lit(None).cast("bigint"), F.lit(3).cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.array(F.col("doc_id") % 4, F.floor(F.col("doc_id") / 4) % 4, F.col("n_chars") % 4))
    d = table(spark, sf_dir, "documents").select("doc_id", pairs.outcome(s, F.lit(3), F.lit(1)).alias("o"))
    return d.select("doc_id", "o.kind", "o.best", "o.worst")


@query(sql=f"""WITH {_PAIRS} SELECT conv_id, chosen, rejected, category, CASE WHEN regexp_replace(chosen, '^\\s+|\\s+$', '', 'g') = regexp_replace(rejected, '^\\s+|\\s+$', '', 'g') THEN 'ambiguous' ELSE 'on_policy' END AS pair_type FROM p""")
def pp3_m5_assemble(spark, sf_dir):
    a = turns.of_role(F.col("c"), "assistant")
    c = conversations(spark, sf_dir).withColumn("a", a).where(F.size("a") >= 2)
    category = F.when(F.col("conv_id") % 3 == 0, "mixed_mode").when(F.col("conv_id") % 3 == 1, "casual_sad").otherwise("other")
    r = c.select("conv_id", pairs.assemble(F.col("c"), F.get("a", 0)["content"], F.element_at("a", -1)["content"], category, F.lit("on_policy")).alias("r"))
    return r.select("conv_id", F.get("r.chosen", 0)["content"].alias("chosen"), F.get("r.rejected", 0)["content"].alias("rejected"), "r.category", "r.pair_type")


@query(sql="""WITH s AS (SELECT doc_id, lang, text FROM documents WHERE doc_id % 3 = 0), n AS (SELECT doc_id + 1000000 AS doc_id, lang, text FROM documents) SELECT doc_id, lang FROM s UNION ALL SELECT doc_id, lang FROM n WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.lang = n.lang AND s.text = n.text)""")
def j5_merge_store(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    store = d.where("doc_id % 3 = 0")
    return pairs.merge_store(d.withColumn("doc_id", F.col("doc_id") + 1000000), store, F.sha2("text", 256), "lang").select("doc_id", "lang")


@query(sql=f"""WITH {CONV}, s AS (SELECT conv_id, list_filter(c, lambda m: m.role = 'system')[1].content AS s, list_filter(c, lambda m: m.role = 'user')[1].content AS u FROM conv),
    w AS (SELECT conv_id, CASE WHEN s IS NULL THEN 'no system message' WHEN NOT contains(s, 'e') THEN 'missing preamble: ' || substr(replace(s, chr(10), chr(92) || 'n'), 1, 120) END AS lenient, s FROM s)
    SELECT conv_id, lenient, CASE WHEN lenient IS NOT NULL THEN lenient WHEN NOT contains(s, 'th') THEN 'missing header' END AS strict FROM w""")
def f28_parity(spark, sf_dir):
    """What keeps each conversation from the format that training expects, with the header asked for and without."""
    return conversations(spark, sf_dir).select("conv_id", turns.parity(F.col("c"), "e").alias("lenient"), turns.parity(F.col("c"), "e", "th").alias("strict"))


@query(sql="SELECT event_id FROM events WHERE strftime(ts, '%Y%m%d') >= '20240115'")
def f24_since(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.col("ts") >= F.to_timestamp(F.lit("20240115"), "yyyyMMdd")).select("event_id")
