"""Queries of scenario building, seed variation, targeted pair rules and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.operators import generate, rules, sampling, turns
from talkloom.plans.evaluate import _FACTS, facts
from talkloom.plans.registry import query
from talkloom.plans.tables import conversations, table, words_sql
from talkloom.plans.session import _PAIRS
from talkloom.plans.text import _TOK, _jaccard_sql


def _unit_sql(seed: str) -> str:
    return f"(('0x' || substr(md5('{seed}:' || doc_id), 1, 8))::BIGINT / 4294967296.0)"


@query(sql=f"""WITH c AS (SELECT doc_id, CASE WHEN {_unit_sql('scenario:category')} < 0.5 THEN 'help' WHEN {_unit_sql('scenario:category')} < 0.8 THEN 'bio' ELSE 'memory' END AS category FROM documents)
    SELECT doc_id, category, CASE category WHEN 'help' THEN ['h1','h2','h3'][floor({_unit_sql('scenario:help')} * 3)::INT + 1] WHEN 'bio' THEN ['b1','b2'][floor({_unit_sql('scenario:bio')} * 2)::INT + 1] ELSE 'm1' END AS message,
      CASE category WHEN 'bio' THEN 2 ELSE 3 END AS good, CASE category WHEN 'bio' THEN 0 ELSE 1 END AS bad FROM c""")
def pp1_scenarios(spark, sf_dir):
    keys = table(spark, sf_dir, "documents").select("doc_id")
    return generate.scenarios(keys, "doc_id", {"help": 0.5, "bio": 0.3, "memory": 0.2}, {"help": ["h1", "h2", "h3"], "bio": ["b1", "b2"], "memory": ["m1"]}, {"help": (3, 1), "bio": (2, 0), "memory": (3, 1)})


@query()
def p34_vary_health_context(spark, sf_dir):
    """Dates, scores and descriptors of one seed context, varied by document."""
    dates = [f"Apr {k}" for k in range(2, 26)]
    text = F.lit("[Apr 3] Mood 7/10, very poor sleep\n[Apr 9] Mood 4/10\n[Apr 12] Mood 3/10")
    key = F.col("doc_id")
    varied = generate.reword(generate.rescore(generate.redate(text, dates, "d", key), "s", key), [["very poor", "badly disrupted", "terrible"]], "w", key)
    return table(spark, sf_dir, "documents").select("doc_id", varied.alias("context"))


_W = f"w AS (SELECT *, {words_sql('chosen')} AS x, {words_sql('rejected')} AS y, {_TOK.format(x='chosen')} AS s, {_TOK.format(x='rejected')} AS t FROM p)"
_KEYS = ["the", "que", "und", "les"]


def _pairs(spark, sf_dir):
    c = conversations(spark, sf_dir).withColumn("a", turns.of_role(F.col("c"), "assistant")).where(F.size("a") >= 2)
    return c.select("conv_id", F.get("a", 0)["content"].alias("chosen"), F.element_at("a", -1)["content"].alias("rejected"))


@query(sql=f"WITH {_PAIRS}, {_W} SELECT conv_id, (contains(lower(chosen), 'the') OR contains(lower(chosen), 'que')) AND NOT contains(lower(chosen), 'zzz') AND {_jaccard_sql('s', 't')} <= 0.7 AND x >= 6 AND y >= 6 AND greatest(x, y) / greatest(least(x, y), 1) <= 3.0 AS ok FROM w")
def f17_f18_targeted_pairs(spark, sf_dir):
    needs = rules.mentions(F.col("chosen"), F.array(F.lit("the que")))
    return _pairs(spark, sf_dir).select("conv_id", rules.targeted_pair(F.col("chosen"), F.col("rejected"), needs, banned=("zzz",)).alias("ok"))


def _hits_sql(x: str, words: tuple[str, ...] | list[str]) -> str:
    return "(" + " + ".join(f"contains(lower({x}), '{k}')::INT" for k in words) + ")"


_PHRASES, _GENERAL, _BANNED = ("was the", "und die", "de la"), ("for", "mit", "con"), ("hation",)
_COUNTS = ", ".join(f"{_hits_sql(t, w)} AS {n}_{t}" for t in ("chosen", "rejected") for n, w in (("k", _KEYS), ("s", _PHRASES), ("g", _GENERAL), ("b", _BANNED)))


@query(sql=f"""WITH {_PAIRS}, {_W}, n AS (SELECT conv_id, x, y, {_jaccard_sql('s', 't')} <= 0.7 AS unlike, {_COUNTS} FROM w)
    SELECT conv_id,
      unlike AND b_chosen = 0 AND x >= 8 AND y >= 5 AND (k_chosen > 0 OR s_chosen > 0) AND k_rejected < 2 AND s_rejected = 0 AS recall,
      unlike AND b_chosen = 0 AND x >= 5 AND y >= 8 AND (k_rejected > 0 OR s_rejected > 0) AND k_chosen < 2 AND s_chosen = 0 AS restraint,
      unlike AND b_chosen = 0 AND x >= 5 AND y >= 8 AND (k_rejected > 1 OR s_rejected > 0) AND k_chosen < 2 AND s_chosen = 0 AS intrusion,
      unlike AND b_chosen = 0 AND x >= 5 AND y >= 8 AND g_rejected > 0 AND g_chosen = 0 AND s_chosen = 0 AS presumption FROM n""")
def f19_f22_opposed_pairs(spark, sf_dir):
    kinds = ("recall", "restraint", "intrusion", "presumption")
    return _pairs(spark, sf_dir).select("conv_id", *[rules.biometric_pair(F.col("chosen"), F.col("rejected"), k, _KEYS, _PHRASES, _GENERAL, _BANNED).alias(k) for k in kinds])


@query(sql="SELECT doc_id AS id FROM documents WHERE lang = 'en' AND source IN ('src0', 'src1') AND doc_id IN (SELECT doc_id FROM labels)")
def f23_scenario_filter(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.when(F.col("source") == "src0", F.lit(None).cast("string")).when(F.col("source") == "src1", "single").otherwise("dynamic").alias("type"), F.array("lang", F.lit("mobile_safe")).alias("tags"))
    ids = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return rules.filter_scenarios(d, "en", "single", ids, ["en"], True).select("id")


@query(sql="WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('split:' || doc_id), doc_id) AS n, count(*) OVER () AS t FROM documents) SELECT CASE WHEN n <= greatest(50, floor(t * 0.15)) THEN 'val' ELSE 'train' END AS split, count(*) AS n FROM r GROUP BY 1")
def k11_pair_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", guard=False).groupBy("split").agg(F.count("*").alias("n"))


@query(sql="SELECT n_nationkey, 'val' AS split FROM nation")
def k11_small_split(spark, sf_dir):
    """A table of fewer rows than the least validation size is all validation."""
    return sampling.split(table(spark, sf_dir, "nation").select("n_nationkey"), "n_nationkey", guard=False).select("n_nationkey", "split")


@query(sql="SELECT source, round(sum(CASE WHEN length(text) >= 200 THEN 2 ELSE 0 END + CASE WHEN contains(text, '.') THEN 1 ELSE 0 END) / sum(3), 6) AS score FROM documents GROUP BY source")
def a5_check_score(spark, sf_dir):
    """Weighted share of declarative checks that pass."""
    d = table(spark, sf_dir, "documents")
    checks = d.select("source", F.explode(F.array(F.struct(F.lit(2.0).alias("w"), (F.length("text") >= 200).alias("ok")), F.struct(F.lit(1.0).alias("w"), F.col("text").contains(".").alias("ok")))).alias("c"))
    return checks.groupBy("source").agg(F.round(F.sum(F.when(F.col("c.ok"), F.col("c.w")).otherwise(0.0)) / F.sum("c.w"), 6).alias("score"))


@query(sql=f"WITH {_FACTS} SELECT scenario_id, criterion_id, verdict FROM facts WHERE run_id = 'b' AND verdict <> 'PASS'")
def io13_failures(spark, sf_dir):
    return facts(spark, sf_dir).where("run_id = 'b' and verdict <> 'PASS'").select("scenario_id", "criterion_id", "verdict")


@query(sql="SELECT conv_id, string_agg('You: ' || text, chr(10) ORDER BY turn) AS said FROM conversations WHERE role = 'user' GROUP BY conv_id")
def p32_simulator_lines(spark, sf_dir):
    said = F.array_join(F.transform(turns.of_role(F.col("c"), "user"), lambda m: F.concat(F.lit("You: "), m["content"])), "\n")
    return conversations(spark, sf_dir).where(F.exists("c", lambda m: m["role"] == "user")).select("conv_id", said.alias("said"))
