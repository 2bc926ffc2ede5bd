"""Queries of turn surgery, windows over turns and model-facing data preparation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from talkloom.functions import parse, text
from talkloom.operators import turns
from talkloom.plans.registry import query
from talkloom.plans.tables import CONV, conversations, flat_sql, table, total_words_sql, words_sql

# Steps of the cleaning contract as DuckDB expressions over a message list.
_BACK = "list_position(list_reverse(list_transform({c}, lambda m: m.role)), 'assistant')"


def _last_sql(c: str) -> str:
    back = _BACK.format(c=c)
    return f"CASE WHEN {back} IS NULL THEN {c} ELSE {c}[1:len({c}) - {back} + 1] END"


_MERGED = f"""
  r AS (SELECT conv_id, turn, role, text, role = 'user' AND coalesce(lag(role) OVER w = 'user', false) AS joins
        FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM r),
  t AS (SELECT conv_id, run, any_value(role) AS role, string_agg(text, chr(10) ORDER BY turn) AS text FROM g GROUP BY conv_id, run),
  merged AS (SELECT conv_id, list({{'role': role, 'content': text}} ORDER BY run) AS c FROM t GROUP BY conv_id)"""


@query(
    sql=f"""WITH {_MERGED},
      fin AS (SELECT conv_id, {_last_sql('c')} AS c FROM merged),
      k AS (SELECT conv_id, c FROM fin
            WHERE len(list_filter(c, lambda m: m.role IN ('user', 'assistant'))) >= 2),
      d AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY conv_id) AS n FROM k)
    SELECT conv_id, len(c) AS n_turns, len(list_filter(c, lambda m: m.role = 'user')) AS n_user,
      len(list_filter(c, lambda m: m.role = 'assistant')) AS n_assistant,
      array_to_string(list_transform(list_filter(c, lambda m: m.role = 'assistant'), lambda m: m.content), ' ') AS assistant_text
    FROM d WHERE n = 1"""
)
def training_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: user runs merged, cut after the last assistant turn, short ones out, exact duplicates out."""
    c = conversations(spark, sf_dir).withColumn("c", turns.assistant_last(turns.merge_users(F.col("c"))))
    c = c.where(~turns.too_short(F.col("c"), 2)).withColumn("body", turns.same(F.col("c")))
    first = c.groupBy("body").agg(F.min("conv_id").alias("conv_id"))
    kept = c.join(first, ["body", "conv_id"], "left_semi")
    count = lambda role: F.size(turns.of_role(F.col("c"), role)).cast("bigint")
    return kept.select("conv_id", F.size("c").cast("bigint").alias("n_turns"), count("user").alias("n_user"), count("assistant").alias("n_assistant"), turns.assistant_text(F.col("c")).alias("assistant_text"))


@query(sql=rf"""WITH {CONV} SELECT conv_id, len(p) AS n, {flat_sql('p')} AS body FROM (SELECT conv_id,
    list_filter(list_transform(c, lambda m: {{'role': m.role, 'content': regexp_replace(m.content, '^\s+|\s+$', '', 'g')}}), lambda m: m.content <> '') AS p FROM conv)""")
def p1_to_example(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("c", turns.drop_blank(F.col("c")))
    return c.select("conv_id", F.size("c").cast("bigint").alias("n"), turns.flat(F.col("c")).alias("body"))


@query(sql=f"WITH {CONV} SELECT conv_id, {flat_sql(_last_sql('c'))} AS body FROM conv")
def p9_assistant_last(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", turns.flat(turns.assistant_last(F.col("c"))).alias("body"))


@query(sql=f"WITH {_MERGED} SELECT conv_id, len(c) AS n, {flat_sql('c')} AS body FROM merged")
def p10_merge_users(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("c", turns.merge_users(F.col("c")))
    return c.select("conv_id", F.size("c").cast("bigint").alias("n"), turns.flat(F.col("c")).alias("body"))


@query(sql=f"""WITH {CONV} SELECT conv_id, array_to_string(list_transform(c, lambda m:
    '<|start_header_id|>' || m.role || '<|end_header_id|>' || chr(10) || chr(10) || m.content || '<|eot_id|>'), '') AS prompt FROM conv""")
def p15_llama_prompt(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", turns.render(F.col("c")).alias("prompt"))


@query(sql=f"WITH {CONV} SELECT conv_id, len(c) AS n, {flat_sql('c')} AS body FROM conv")
def p16_row_major(spark, sf_dir):
    """Parallel arrays of roles and contents back to messages."""
    c = conversations(spark, sf_dir).select("conv_id", F.transform("c", lambda m: m["role"]).alias("role"), F.transform("c", lambda m: m["content"]).alias("content"))
    z = c.select("conv_id", F.arrays_zip("role", "content").alias("c"))
    return z.select("conv_id", F.size("c").cast("bigint").alias("n"), turns.flat(F.col("c")).alias("body"))


@query(sql=f"""WITH {CONV} SELECT conv_id, array_to_string(list_transform(c, lambda m: upper(m.role[1:1]) || m.role[2:] || ': ' || m.content), chr(10)) AS text FROM conv""")
def p17_example_text(spark, sf_dir):
    line = lambda m: F.concat(F.initcap(m["role"]), F.lit(": "), m["content"])
    return conversations(spark, sf_dir).select("conv_id", F.array_join(F.transform("c", line), "\n").alias("text"))


@query(sql=r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM documents),
    s AS (SELECT doc_id, t, unnest(range(0, len(t), 96)) AS start FROM w)
    SELECT doc_id, start // 96 AS chunk_id, start, least(128, len(t) - start) AS n, t[start + 1] AS first_word, t[start + least(128, len(t) - start)] AS last_word FROM s""")
def p18_chunks(spark, sf_dir):
    """Windows of 128 words, 32 of them shared with the next."""
    t = table(spark, sf_dir, "documents").select("doc_id", turns.chunk(text.words(F.col("text")), 128, 32).alias("w"))
    t = t.select("doc_id", F.posexplode("w").alias("chunk_id", "w"))
    return t.select("doc_id", F.col("chunk_id").cast("bigint").alias("chunk_id"), (F.col("chunk_id") * 96).cast("bigint").alias("start"), F.size("w").cast("bigint").alias("n"), F.get("w", 0).alias("first_word"), F.element_at("w", -1).alias("last_word"))


@query(sql=f"""WITH {CONV}, p AS (SELECT conv_id, list_filter(c, lambda m: m.role = 'system') AS s, list_filter(c, lambda m: m.role <> 'system') AS r FROM conv),
    k AS (SELECT conv_id, s, r, unnest(range(0, len(r) // 2 + 1)) AS k FROM p),
    f AS (SELECT *, {total_words_sql('s')} + {total_words_sql('r[2 * k + 1:]')} <= 300 AS fits FROM k),
    b AS (SELECT conv_id, coalesce(min(k) FILTER (fits), max(k)) AS k FROM f GROUP BY conv_id)
    SELECT conv_id, b.k AS dropped_pairs, len(s) + len(r[2 * b.k + 1:]) AS n, {total_words_sql('s')} + {total_words_sql('r[2 * b.k + 1:]')} AS words FROM p JOIN b USING (conv_id)""")
def p19_truncate_pairs(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("t", turns.truncate_pairs(F.col("c"), 300))
    total = F.aggregate("t", F.lit(0).cast("bigint"), lambda s, m: s + text.n_words(m["content"]))
    return c.select("conv_id", F.floor((F.size("c") - F.size("t")) / 2).cast("bigint").alias("dropped_pairs"), F.size("t").cast("bigint").alias("n"), total.alias("words"))


@query(sql="""WITH t AS (SELECT conv_id, turn, sum(length(text) // 4 + 6) OVER w AS used, row_number() OVER w AS k FROM conversations
      WHERE role IN ('user', 'assistant') WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC))
    SELECT conv_id, turn, used FROM t WHERE used <= 400 OR k = 1""")
def p20_trim_to_context(spark, sf_dir):
    return turns.trim_to_budget(table(spark, sf_dir, "conversations"), 400).select("conv_id", "turn", "used")


@query(sql=f"""WITH {CONV}, s AS (SELECT conv_id, list_transform(list_filter(c[greatest(len(c) - 4 + 1, 1):], lambda m: m.role IN ('user', 'assistant')), lambda m: {{'role': m.role, 'content': m.content[1:120]}}) AS p FROM conv)
    SELECT conv_id, len(p) AS n, {flat_sql('p')} AS body FROM s""")
def p21_sanitize(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("p", turns.sanitize(F.col("c"), 4, 120))
    return c.select("conv_id", F.size("p").cast("bigint").alias("n"), turns.flat(F.col("p")).alias("body"))


_NAME = "CASE m.role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'AI' ELSE m.role END"


@query(
    sql=f"""WITH s AS (SELECT * FROM conversations WHERE role <> 'system'),
      n AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS k,
              CASE role WHEN 'user' THEN 'User' WHEN 'assistant' THEN 'AI' ELSE role END AS name,
              max(turn) FILTER (role = 'assistant') OVER (PARTITION BY conv_id) AS last_a FROM s),
      p AS (SELECT *, max(turn) FILTER (role <> 'user' AND turn < last_a) OVER (PARTITION BY conv_id) AS stop FROM n)
    SELECT conv_id, string_agg(name || ': ' || text, chr(10) ORDER BY turn) AS any_turn,
      string_agg(name || ' T' || k || ': ' || text, chr(10) ORDER BY turn) AS all_turns,
      coalesce(string_agg(name || ': ' || text, chr(10) ORDER BY turn) FILTER (turn <= last_a AND turn > coalesce(stop, -1)), '(no assistant turns)') AS final_turn
    FROM p GROUP BY conv_id"""
)
def p29_judge_view(spark, sf_dir):
    c = F.col("c")
    return conversations(spark, sf_dir).select("conv_id", *[turns.judge_view(c, s).alias(s) for s in ("any_turn", "all_turns", "final_turn")])


@query(sql=f"""WITH {CONV}, s AS (SELECT conv_id, list_transform(list_filter(c, lambda m: m.role <> 'system'), lambda m: {{'role': CASE m.role WHEN 'user' THEN 'assistant' ELSE 'user' END, 'content': m.content}}) AS p FROM conv),
    f AS (SELECT conv_id, p, list_position(list_transform(p, lambda m: m.role), 'user') AS pos FROM s)
    SELECT conv_id, array_to_string(list_transform(p, lambda m, i: m.role || '|' || CASE WHEN i = pos THEN 'You are a student.' || chr(10) || chr(10) || m.content ELSE m.content END), chr(10) || '--' || chr(10)) AS body FROM f""")
def p31_flip_roles(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", turns.flat(turns.flip_roles(F.col("c"), F.lit("You are a student."))).alias("body"))


@query(sql=f"WITH {CONV} SELECT conv_id, array_to_string(list_transform(list_filter(c, lambda m: m.role <> 'system'), lambda m: upper(m.role) || ': ' || m.content), chr(10)) AS body FROM conv")
def p35_dump(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", turns.dump(F.col("c")).alias("body"))


@query(sql=f"""WITH {CONV}, f AS (SELECT conv_id, len(c) AS n, list_filter(c, lambda m: m.role = 'user')[1].content AS u FROM conv)
    SELECT conv_id, n AS n_messages, CASE WHEN u IS NULL THEN 'New Chat' WHEN length(u) > 30 THEN u[1:30] || '...' ELSE u END AS title FROM f WHERE n > 1""")
def p37_session_summary(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return c.where(F.size("c") > 1).select("conv_id", F.size("c").cast("bigint").alias("n_messages"), turns.title(F.col("c")).alias("title"))


@query(sql=f"""WITH {CONV}, f AS (SELECT conv_id, list_transform(c, lambda m: length(m.content)) AS x FROM conv)
    SELECT conv_id, array_to_string(list_transform(CASE WHEN len(x) >= 6 THEN x[len(x) - 5:] ELSE list_concat(x, list_transform(range(6 - len(x)), lambda k: 0::BIGINT)) END, lambda v: v::VARCHAR), ',') AS ids FROM f""")
def p38_fixed_length(spark, sf_dir):
    """The last six values, padded with zeros on the right."""
    x = conversations(spark, sf_dir).select("conv_id", F.transform("c", lambda m: F.length(m["content"])).alias("x"))
    pad = F.slice(F.concat("x", F.array_repeat(F.lit(0), 6)), F.greatest(F.size("x") - 5, F.lit(1)), F.lit(6))
    return x.select("conv_id", F.array_join(F.transform(pad, lambda v: v.cast("string")), ",").alias("ids"))


@query(sql="SELECT conv_id, turn, CASE WHEN length(replace(text, chr(10), ' ')) <= 40 THEN replace(text, chr(10), ' ') ELSE replace(text, chr(10), ' ')[1:40] || '…' END AS short FROM conversations")
def p40_preview(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.preview(F.col("text"), 40).alias("short"))


@query(sql=f"WITH {CONV} SELECT conv_id, len(list_filter(c, lambda m: m.role IN ('user', 'assistant'))) AS n FROM conv WHERE len(list_filter(c, lambda m: m.role IN ('user', 'assistant'))) >= 4")
def f1_min_turns(spark, sf_dir):
    c = conversations(spark, sf_dir)
    return c.where(~turns.too_short(F.col("c"), 4)).select("conv_id", turns.n_turns(F.col("c")).alias("n"))


@query(sql=r"SELECT conv_id, count(*) AS n FROM conversations WHERE regexp_replace(text, '^\s+|\s+$', '', 'g') <> '' GROUP BY conv_id")
def f2_drop_empty(spark, sf_dir):
    c = conversations(spark, sf_dir).select("conv_id", turns.drop_blank(F.col("c")).alias("c"))
    return c.where(F.size("c") > 0).select("conv_id", F.size("c").cast("bigint").alias("n"))


@query(sql=f"WITH {CONV} SELECT conv_id, len(c) >= 4 AND list_contains(list_transform(c, lambda m: m.role), 'assistant') AS packable FROM conv")
def f3_packable(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", turns.packable(F.col("c")).alias("packable"))


_ASSISTANT_SQL = "list_filter(c, lambda m: m.role = 'assistant')"


@query(sql=f"WITH {CONV} SELECT conv_id, round({total_words_sql(_ASSISTANT_SQL)} / nullif({total_words_sql('c')}, 0), 6) AS share FROM conv")
def a28_word_share(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", F.round(turns.assistant_share(F.col("c")), 6).alias("share"))


@query(sql="SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def a18_assistant_text(spark, sf_dir):
    c = conversations(spark, sf_dir).where(F.exists("c", lambda m: m["role"] == "assistant"))
    return c.select("conv_id", turns.assistant_text(F.col("c")).alias("text"))


@query(sql="""WITH t AS (SELECT conv_id, sum((role = 'user')::INT) AS n FROM conversations GROUP BY conv_id)
    SELECT CASE WHEN n >= 4 THEN '3+' ELSE n::VARCHAR END AS bucket, count(*) AS n FROM t WHERE n > 0 GROUP BY 1""")
def a14_turn_histogram(spark, sf_dir):
    """User markers in the tagged text of a conversation, by bucket; none is no bucket."""
    tagged = F.array_join(F.transform("c", lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|> "), m["content"])), "\n")
    n = ((F.length("t") - F.length(F.replace("t", F.lit("<|user|>"), F.lit("")))) / 8).cast("int")
    t = conversations(spark, sf_dir).select(tagged.alias("t")).select(n.alias("k")).where("k > 0")
    return t.groupBy(F.when(F.col("k") > 3, "3+").otherwise(F.col("k").cast("string")).alias("bucket")).agg(F.count("*").alias("n"))


@query(sql="""SELECT conv_id, turn, sum((role = 'user')::INT) OVER w AS user_turn,
    sum(change) OVER w AS run FROM (SELECT *, (role <> coalesce(lag(role) OVER v, ''))::INT AS change FROM conversations WINDOW v AS (PARTITION BY conv_id ORDER BY turn))
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def w4_w6_running_turns(spark, sf_dir):
    t = turns.with_runs(table(spark, sf_dir, "conversations"))
    return t.select("conv_id", "turn", F.col("user_turn").cast("bigint").alias("user_turn"), F.col("run").cast("bigint").alias("run"))


@query(sql="""WITH a AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
    SELECT conv_id, t[1] AS first_turn, t[2] AS second_turn, t[len(t)] AS last_turn FROM a""")
def w5_nth_assistant(spark, sf_dir):
    a = conversations(spark, sf_dir).select("conv_id", turns.of_role(F.col("c"), "assistant").alias("a")).where(F.size("a") > 0)
    return a.select("conv_id", F.get("a", 0)["content"].alias("first_turn"), F.get("a", 1)["content"].alias("second_turn"), F.element_at("a", -1)["content"].alias("last_turn"))


@query(sql="SELECT conv_id, turn, CASE WHEN row_number() OVER (PARTITION BY conv_id ORDER BY turn) % 2 = 1 THEN 'user' ELSE 'assistant' END AS role FROM conversations")
def w8_p7_alternate_roles(spark, sf_dir):
    """Utterances without speakers: roles alternate from the user."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.row_number().over(w) % 2 == 1, "user").otherwise("assistant").alias("role"))


@query(sql=r"""WITH u AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')) AS n,
      row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user'),
    l AS (SELECT *, lag(n) OVER (PARTITION BY conv_id ORDER BY turn) AS p, count(*) OVER (PARTITION BY conv_id) AS m FROM u)
    SELECT conv_id, bool_or(coalesce(n <= 4 AND p <= 4, false)) AS terse, bool_or(k = m AND n <= 4) AS last_terse FROM l GROUP BY conv_id""")
def w11_f26_stop_conditions(spark, sf_dir):
    """Whether two user turns in a row are terse (four words here), and whether the last one is."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    u = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("n", text.n_words(F.col("text")))
    u = u.withColumn("p", F.lag("n").over(w)).withColumn("next", F.lead("n").over(w))
    return u.groupBy("conv_id").agg(F.bool_or(F.coalesce((F.col("n") <= 4) & (F.col("p") <= 4), F.lit(False))).alias("terse"), F.bool_or(F.col("next").isNull() & (F.col("n") <= 4)).alias("last_terse"))


@query(sql=f"""WITH {CONV}, u AS (SELECT conv_id, list_transform(list_filter(c, lambda m: m.role = 'user'), lambda m: m.content) AS u FROM conv),
    n AS (SELECT conv_id, u, lower(u[len(u)]) AS last, {words_sql('u[len(u)]')} AS x, {words_sql('u[len(u) - 1]')} AS y FROM u)
    SELECT conv_id, coalesce(contains(last, 'the end') OR contains(last, 'que'), false) AS ended, len(u) > 1 AND coalesce(x <= 1 AND y <= 1, false) AS disengaged, len(u) >= 3 AS at_limit FROM n""")
def f26_stop(spark, sf_dir):
    """Whether a talk ends by a phrase of its user, by two replies of a word, or by its length."""
    s = conversations(spark, sf_dir).select("conv_id", turns.stop_reasons(F.col("c"), ["the end", "que"], 3).alias("s"))
    return s.select("conv_id", "s.ended", "s.disengaged", "s.at_limit")


@query(sql="SELECT conv_id, sha1(text)[1:8] AS h FROM conversations WHERE role = 'user'")
def hash_sha1(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", text.short_hash(F.col("text")).alias("h"))


@query(sql="SELECT conv_id, turn, coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), 0)::BIGINT AS recent_chars FROM conversations")
def w3_last_five(spark, sf_dir):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-5, -1)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).cast("bigint").alias("recent_chars"))


_TAGGED = """tagged AS (SELECT conv_id, 'preface ' || string_agg('<|' || role || '|> ' || text, ' ' ORDER BY turn) AS t FROM conversations WHERE role <> 'system' GROUP BY conv_id)"""


def _tag_sql(prefix: bool) -> str:
    return rf"""WITH {_TAGGED},
      parts AS (SELECT conv_id, unnest(string_split(replace(replace(t, '<|user|>', chr(1) || 'u'), '<|assistant|>', chr(1) || 'a'), chr(1))) AS p,
                generate_subscripts(string_split(replace(replace(t, '<|user|>', chr(1) || 'u'), '<|assistant|>', chr(1) || 'a'), chr(1)), 1) AS k FROM tagged),
      m AS (SELECT conv_id, k, CASE WHEN k = 1 THEN 'user' WHEN p[1:1] = 'u' THEN 'user' ELSE 'assistant' END AS role,
              regexp_replace(CASE WHEN k = 1 THEN p ELSE p[2:] END, '^\s+|\s+$', '', 'g') AS content FROM parts)
    SELECT conv_id, count(*) AS n, string_agg(role || '|' || content, chr(10) || '--' || chr(10) ORDER BY k) AS body FROM m WHERE content <> '' {'' if prefix else 'AND k > 1'} GROUP BY conv_id"""


def _tagged(spark, sf_dir, prefix: bool) -> DataFrame:
    tagged = F.concat(F.lit("preface "), F.array_join(F.transform(F.filter("c", lambda m: m["role"] != "system"), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|> "), m["content"])), " "))
    c = conversations(spark, sf_dir).where(F.exists("c", lambda m: m["role"] != "system")).select("conv_id", turns.from_tagged(tagged, prefix).alias("c"))
    return c.select("conv_id", F.size("c").cast("bigint").alias("n"), turns.flat(F.col("c")).alias("body"))


@query(sql=_tag_sql(True))
def p3_tagged_text(spark, sf_dir):
    return _tagged(spark, sf_dir, True)


@query(sql=_tag_sql(False))
def p3b_tagged_text_strict(spark, sf_dir):
    return _tagged(spark, sf_dir, False)


@query(sql=rf"""WITH {CONV.replace('text}', "replace(text, chr(10), ' ')}")},
    l AS (SELECT conv_id, list_transform(c, lambda m: {{'role': m.role, 'content': regexp_replace(m.content, '^\s+|\s+$', '', 'g')}}) AS p FROM conv)
    SELECT conv_id, len(list_filter(p, lambda m: m.role <> 'system')) AS n, {flat_sql("list_filter(p, lambda m: m.role <> 'system')")} AS body FROM l""")
def p3c_tagged_lines(spark, sf_dir):
    """Tags at line starts only; lines that follow belong to the turn."""
    lines = F.array_join(F.transform(F.filter("c", lambda m: m["role"] != "system"), lambda m: F.concat(F.lit("<|"), m["role"], F.lit("|> "), F.replace(m["content"], F.lit("\n"), F.lit(" ")))), "\n")
    c = conversations(spark, sf_dir).select("conv_id", turns.from_tagged_lines(lines).alias("c"))
    return c.select("conv_id", F.size("c").cast("bigint").alias("n"), turns.flat(F.col("c")).alias("body"))


@query(sql="""WITH x AS (SELECT conv_id, turn, role, CASE role WHEN 'system' THEN ' Supporter ' WHEN 'assistant' THEN 'THERAPIST' ELSE 'Someone' END AS raw FROM conversations)
    SELECT conv_id, turn, raw, CASE WHEN role IN ('system', 'assistant') THEN 'assistant' ELSE 'user' END AS mapped FROM x""")
def p4_map_role(spark, sf_dir):
    raw = F.when(F.col("role") == "system", " Supporter ").when(F.col("role") == "assistant", "THERAPIST").otherwise("Someone")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", raw.alias("raw")).withColumn("mapped", F.coalesce(turns.map_role(F.col("raw")), F.lit("user")))


@query(sql=f"""WITH {CONV}, s AS (SELECT conv_id, unnest(c) AS m, generate_subscripts(c, 1) AS k FROM conv),
    o AS (SELECT conv_id, k, m.role AS role, length('<|start_header_id|>' || m.role || '<|end_header_id|>') + 2 AS head, length(m.content) AS body FROM s),
    e AS (SELECT *, sum(head + body + 10) OVER (PARTITION BY conv_id ORDER BY k) AS stop FROM o)
    SELECT conv_id, count(*) AS n_spans, sum(body + 10)::BIGINT AS supervised_chars, min(stop - body - 10)::BIGINT AS first_start, max(stop)::BIGINT AS last_stop FROM e WHERE role = 'assistant' GROUP BY conv_id""")
def m1_label_mask(spark, sf_dir):
    """Spans of the rendered text that training looks at; conversations without one are refused there."""
    s = conversations(spark, sf_dir).select("conv_id", turns.supervised_spans(F.col("c")).alias("s")).where(F.size("s") > 0)
    total = F.aggregate("s", F.lit(0), lambda a, x: a + x["stop"] - x["start"])
    return s.select("conv_id", F.size("s").cast("bigint").alias("n_spans"), total.cast("bigint").alias("supervised_chars"), F.get("s", 0)["start"].cast("bigint").alias("first_start"), F.element_at("s", -1)["stop"].cast("bigint").alias("last_stop"))


@query(sql=f"""WITH {CONV} SELECT conv_id, array_to_string(list_transform(c, lambda m: '<|im_start|>' || m.role || chr(10) || m.content || '<|im_end|>' || chr(10)), '') AS qwen,
    array_to_string(list_transform(c, lambda m: '<|turn>' || CASE m.role WHEN 'assistant' THEN 'model' ELSE m.role END || chr(10) || m.content || '<turn|>' || chr(10)), '') AS gemma FROM conv""")
def m2_templates(spark, sf_dir):
    return conversations(spark, sf_dir).select("conv_id", turns.render(F.col("c"), "qwen").alias("qwen"), turns.render(F.col("c"), "gemma").alias("gemma"))


@query(sql=f"""WITH {CONV}, n AS (SELECT conv_id, {total_words_sql('c')} AS n FROM conv) SELECT conv_id, n AS n_ids, ((n + 7) // 8) * 8 AS padded, ((n + 7) // 8) * 8 - n AS n_masked FROM n""")
def m3_pad_to_eight(spark, sf_dir):
    """Ids, attention and labels padded to a multiple of eight, labels with -100."""
    ids = F.flatten(F.transform("c", lambda m: text.words(m["content"])))
    c = conversations(spark, sf_dir).select("conv_id", ids.alias("ids"))
    pad = F.pmod(-F.size("ids"), F.lit(8))
    labels = F.concat(F.transform("ids", lambda w: F.length(w)), F.array_repeat(F.lit(-100), pad))
    c = c.select("conv_id", F.size("ids").cast("bigint").alias("n_ids"), labels.alias("labels"))
    return c.select("conv_id", "n_ids", F.size("labels").cast("bigint").alias("padded"), F.size(F.filter("labels", lambda x: x == -100)).cast("bigint").alias("n_masked"))


@query(sql=rf"""WITH w AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS t FROM conversations)
    SELECT conv_id, turn, unnest(range(len(t))) AS pos, unnest(t) AS token, CASE WHEN role = 'assistant' THEN 'UNMASKED' ELSE 'MASKED' END AS state FROM w""")
def m4_token_audit(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.posexplode(text.words(F.col("text"))).alias("pos", "token"))
    return t.select("conv_id", "turn", F.col("pos").cast("bigint").alias("pos"), "token", F.when(F.col("role") == "assistant", "UNMASKED").otherwise("MASKED").alias("state"))


@query(
    sql="""WITH u AS (SELECT conv_id, lower(string_agg(text, ' ' ORDER BY turn)) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id),
      m AS (SELECT conv_id, CASE WHEN contains(t, 'panic') OR contains(t, 'dying') OR contains(t, 'scared') THEN 'Panic'
        WHEN contains(t, 'anxious') OR contains(t, 'worried') THEN 'Anxious' WHEN contains(t, 'sad') OR contains(t, 'tired') THEN 'Sad'
        WHEN contains(t, 'thank') OR contains(t, 'good') OR contains(t, 'happy') THEN 'Happy'
        WHEN contains(t, 'calm') OR contains(t, 'better') THEN 'Calm' ELSE 'Neutral' END AS mood FROM u)
    SELECT conv_id, mood, CASE WHEN mood = 'Panic' THEN 'High' ELSE 'Low' END AS risk,
      CASE mood WHEN 'Happy' THEN 5 WHEN 'Calm' THEN 4 WHEN 'Sad' THEN 2 WHEN 'Anxious' THEN 1 WHEN 'Panic' THEN 1 ELSE 3 END AS score FROM m"""
)
def mood_keywords(spark, sf_dir):
    users = F.array_join(F.transform(turns.of_role(F.col("c"), "user"), lambda m: m["content"]), " ")
    u = conversations(spark, sf_dir).where(F.exists("c", lambda m: m["role"] == "user")).select("conv_id", parse.mood(users).alias("mood"))
    return u.select("conv_id", "mood", parse.risk(F.col("mood")).alias("risk"), parse.mood_score(F.col("mood")).alias("score"))


@query(sql=f"""WITH {CONV}, u AS (SELECT conv_id, list_filter(c, lambda m: m.role = 'user') AS u FROM conv)
    SELECT conv_id, len(u) > 0 AND (contains(lower(u[len(u)].content), 'the end') OR contains(lower(u[len(u)].content), 'que')) AS hit FROM u""")
def f27_phrase_trigger(spark, sf_dir):
    """Whether the last user turn has one of the configured phrases."""
    last = F.element_at(turns.of_role(F.col("c"), "user"), -1)["content"]
    c = conversations(spark, sf_dir).where(F.exists("c", lambda m: m["role"] == "user"))
    rest = conversations(spark, sf_dir).where(~F.exists("c", lambda m: m["role"] == "user")).select("conv_id", F.lit(False).alias("hit"))
    return c.select("conv_id", text.contains_any(F.lower(last), ["the end", "que"]).alias("hit")).unionByName(rest)


@query(sql="SELECT conv_id, turn, 1000 + list_reduce(list_prepend(0::BIGINT, list_transform(string_split('conv_' || conv_id, ''), lambda x: ascii(x)::BIGINT)), lambda a, x: (a * 31 + x) % 4294967296) % 9000 AS seed FROM conversations")
def hash_poly31(spark, sf_dir):
    t = table(spark, sf_dir, "conversations")
    return t.select("conv_id", "turn", text.rolling_hash(F.concat(F.lit("conv_"), F.col("conv_id").cast("string"))).alias("seed"))
