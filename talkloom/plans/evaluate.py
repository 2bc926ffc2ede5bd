"""Queries of evaluation analytics.  Verdict facts come from labels: a document is a scenario, its
source a model, its language a category; quality and toxicity are criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from talkloom.operators import scoring
from talkloom.plans.registry import query
from talkloom.plans.tables import table

_FACTS = """facts AS (
  SELECT 'a' AS run_id, source AS model, doc_id AS scenario_id, lang AS category, 'quality' AS criterion_id, 2.0::DOUBLE AS weight, CASE quality WHEN 1 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'a', source, doc_id, lang, 'clean', 1.0::DOUBLE, CASE WHEN toxic = 0 THEN 'PASS' ELSE 'FAIL' END FROM documents JOIN labels USING (doc_id)
  UNION ALL SELECT 'b', source, doc_id, lang, 'quality', 2.0::DOUBLE, CASE WHEN doc_id % 13 = 0 THEN 'AMBIGUOUS' WHEN (quality = 1) <> (doc_id % 7 = 0) THEN 'PASS' ELSE 'FAIL' END FROM documents JOIN labels USING (doc_id) WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'b', source, doc_id, lang, 'clean', 1.0::DOUBLE, CASE WHEN toxic = 0 THEN 'PASS' ELSE 'FAIL' END FROM documents JOIN labels USING (doc_id) WHERE doc_id % 11 <> 0
  UNION ALL SELECT 'b', source, doc_id + 1000000, lang, 'clean', 1.0::DOUBLE, 'PASS' FROM documents JOIN labels USING (doc_id) WHERE doc_id % 17 = 0)"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of two runs: one as labelled, one with flips, ambiguity, and scenarios gone and added."""
    base = table(spark, sf_dir, "documents").select("doc_id", "lang", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    clean = F.when(F.col("toxic") == 0, "PASS").otherwise("FAIL")
    flipped = F.when(F.col("doc_id") % 13 == 0, "AMBIGUOUS").when((F.col("quality") == 1) != (F.col("doc_id") % 7 == 0), "PASS").otherwise("FAIL")
    row = lambda run, crit, w, v: F.struct(F.lit(run).alias("run_id"), F.lit(crit).alias("criterion_id"), F.lit(w).alias("weight"), v.alias("verdict"))
    a = [row("a", "quality", 2.0, F.when(F.col("quality") == 1, "PASS").otherwise("FAIL")), row("a", "clean", 1.0, clean)]
    b = [row("b", "quality", 2.0, flipped), row("b", "clean", 1.0, clean)]
    both = F.when(F.col("doc_id") % 11 != 0, F.array(*a, *b)).otherwise(F.array(*a))
    keep = [F.col("source").alias("model"), F.col("lang").alias("category")]
    out = base.select(F.col("doc_id").alias("scenario_id"), *keep, F.explode(both).alias("f"))
    added = base.where("doc_id % 17 = 0").select((F.col("doc_id") + 1000000).alias("scenario_id"), *keep, row("b", "clean", 1.0, F.lit("PASS")).alias("f"))
    return out.unionByName(added).select("f.run_id", "model", "scenario_id", "category", "f.criterion_id", "f.weight", "f.verdict")


def _score_sql(by: str) -> str:
    return f"""SELECT {by}, sum(CASE WHEN verdict = 'PASS' THEN weight ELSE 0 END) AS weighted_pass, sum(weight) AS weighted_total, count(*) FILTER (verdict = 'PASS') AS pass,
      count(*) FILTER (verdict = 'FAIL') AS fail, count(*) FILTER (verdict = 'AMBIGUOUS') AS ambiguous FROM facts GROUP BY {by}"""


_PCT = "*, CASE WHEN weighted_total > 0 THEN weighted_pass / weighted_total ELSE 0 END AS pct"
_SCENARIOS = f"scores AS (SELECT {_PCT} FROM ({_score_sql('run_id, model, scenario_id, category')}))"


def scenarios(spark, sf_dir):
    return scoring.score(facts(spark, sf_dir), ["run_id", "model", "scenario_id", "category"])


@query(sql=f"WITH {_FACTS}, {_SCENARIOS} SELECT run_id, scenario_id, weighted_pass, weighted_total, pass, fail, ambiguous, round(pct, 6) AS pct FROM scores")
def a2_a5_scenario_score(spark, sf_dir):
    return scenarios(spark, sf_dir).select("run_id", "scenario_id", "weighted_pass", "weighted_total", "pass", "fail", "ambiguous", F.round("pct", 6).alias("pct"))


@query(sql=f"WITH {_FACTS}, {_SCENARIOS} SELECT run_id, category, sum(weighted_pass) AS p, sum(weighted_total) AS t, count(*) AS n FROM scores GROUP BY ALL")
def a1_category_sums(spark, sf_dir):
    return scenarios(spark, sf_dir).groupBy("run_id", "category").agg(F.sum("weighted_pass").alias("p"), F.sum("weighted_total").alias("t"), F.count("*").alias("n"))


@query(sql=f"WITH {_FACTS}, {_SCENARIOS} SELECT run_id, count(*) AS n, count(*) FILTER (weighted_total > 0 AND abs(weighted_pass - weighted_total) < 1e-6) AS passed, round(100 * sum(weighted_pass) / sum(weighted_total), 6) AS pct FROM scores GROUP BY run_id")
def a3_run_summary(spark, sf_dir):
    s = scenarios(spark, sf_dir)
    return s.groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(scoring.passed(s)).alias("passed"), F.round(100 * F.sum("weighted_pass") / F.sum("weighted_total"), 6).alias("pct"))


@query(sql=f"WITH {_FACTS}, {_SCENARIOS} SELECT run_id, category, count(*) AS n, count(*) FILTER (pct >= 0.75) AS passed, round(avg(pct), 6) AS mean FROM scores GROUP BY ALL")
def a4_category_table(spark, sf_dir):
    return scenarios(spark, sf_dir).groupBy("run_id", "category").agg(F.count("*").alias("n"), F.count_if(F.col("pct") >= 0.75).alias("passed"), F.round(F.avg("pct"), 6).alias("mean"))


@query(sql=f"WITH {_FACTS}, {_SCENARIOS}, m AS (SELECT run_id, model, 100 * sum(weighted_pass) / sum(weighted_total) AS pct FROM scores GROUP BY ALL) SELECT model, count(*) AS n_runs, round(avg(pct), 6) AS mean, round(stddev_pop(pct), 6) AS std, string_agg(run_id, ',' ORDER BY run_id) AS runs FROM m GROUP BY model HAVING count(*) >= 2")
def a6_average_runs(spark, sf_dir):
    m = scenarios(spark, sf_dir).groupBy("run_id", "model").agg((100 * F.sum("weighted_pass") / F.sum("weighted_total")).alias("pct"))
    return scoring.average_runs(m, "model", "run_id", "pct").withColumns({"mean": F.round("mean", 6), "std": F.round("std", 6)})


@query(sql=f"WITH {_FACTS}, {_SCENARIOS}, r AS (SELECT scenario_id, count(DISTINCT run_id) AS n, avg((abs(weighted_pass - weighted_total) < 1e-6)::INT) AS rate FROM scores GROUP BY scenario_id) SELECT scenario_id, n, rate FROM r WHERE n = (SELECT count(DISTINCT run_id) FROM scores) AND rate > 0 AND rate < 1 ORDER BY abs(rate - 0.5), scenario_id LIMIT 5")
def a7_instability(spark, sf_dir):
    s = scenarios(spark, sf_dir)
    return scoring.unstable(s.withColumn("ok", scoring.passed(s)), "scenario_id", "run_id", "ok")


_OVERALL = "overall AS (SELECT run_id, scenario_id, CASE WHEN bool_and(verdict = 'PASS') THEN 'PASS' WHEN bool_or(verdict = 'AMBIGUOUS') THEN 'AMBIGUOUS' ELSE 'FAIL' END AS verdict FROM facts GROUP BY ALL)"
_CHANGE = "CASE WHEN va IS NULL AND vb IS NULL THEN 'missing' WHEN va IS NULL THEN 'new' WHEN vb IS NULL THEN 'removed' WHEN va = vb THEN 'unchanged' WHEN va = 'FAIL' AND vb = 'PASS' THEN 'improved' WHEN va = 'PASS' AND vb = 'FAIL' THEN 'REGRESSED' ELSE 'changed' END"


@query(sql=f"WITH {_FACTS}, {_OVERALL} SELECT run_id, scenario_id, verdict FROM overall")
def a30_overall(spark, sf_dir):
    return scoring.overall(facts(spark, sf_dir), ["run_id", "scenario_id"])


def _runs(spark, sf_dir, key):
    f = scoring.overall(facts(spark, sf_dir), ["run_id", *key])
    return [f.where(F.col("run_id") == r).drop("run_id") for r in "ab"]


@query(sql=f"WITH {_FACTS}, {_OVERALL}, j AS (SELECT scenario_id, a.verdict AS va, b.verdict AS vb FROM (SELECT * FROM overall WHERE run_id = 'a') a FULL JOIN (SELECT * FROM overall WHERE run_id = 'b') b USING (scenario_id)) SELECT scenario_id, va AS verdict_a, vb AS verdict_b, {_CHANGE} AS change FROM j")
def j3_scenario_diff(spark, sf_dir):
    return scoring.diff(*_runs(spark, sf_dir, ["scenario_id"]), ["scenario_id"])


@query(sql=f"WITH {_FACTS}, j AS (SELECT scenario_id, criterion_id, a.verdict AS va, b.verdict AS vb FROM (SELECT * FROM facts WHERE run_id = 'a') a FULL JOIN (SELECT * FROM facts WHERE run_id = 'b') b USING (scenario_id, criterion_id)) SELECT scenario_id, criterion_id, va AS verdict_a, vb AS verdict_b, {_CHANGE} AS change FROM j WHERE va IS DISTINCT FROM vb")
def j4_criterion_diff(spark, sf_dir):
    d = scoring.diff(*_runs(spark, sf_dir, ["scenario_id", "criterion_id"]), ["scenario_id", "criterion_id"])
    return d.where(~F.col("verdict_a").eqNullSafe(F.col("verdict_b")))


@query(sql=f"WITH {_FACTS}, {_OVERALL}, j AS (SELECT scenario_id, a.verdict AS va, b.verdict AS vb FROM (SELECT * FROM overall WHERE run_id = 'a') a FULL JOIN (SELECT * FROM overall WHERE run_id = 'b') b USING (scenario_id)) SELECT {_CHANGE} AS change, count(*) AS n FROM j GROUP BY ALL")
def a22_f25_diff_totals(spark, sf_dir):
    return scoring.diff(*_runs(spark, sf_dir, ["scenario_id"]), ["scenario_id"]).groupBy("change").agg(F.count("*").alias("n"))


_LANGS = ["de", "en", "es", "fr"]


@query(sql=f"WITH {_FACTS} SELECT model, " + ", ".join(f"round(100 * sum(CASE WHEN verdict = 'PASS' THEN weight ELSE 0 END) FILTER (category = '{c}') / sum(weight) FILTER (category = '{c}'), 4) AS {c}" for c in _LANGS) + ", round(100 * sum(CASE WHEN verdict = 'PASS' THEN weight ELSE 0 END) / sum(weight), 4) AS total FROM facts WHERE run_id = 'a' GROUP BY model")
def a19_k3_leaderboard(spark, sf_dir):
    s = scenarios(spark, sf_dir).where("run_id = 'a'")
    return scoring.leaderboard(s, "model", "category", _LANGS)


@query(sql=f"WITH {_FACTS}, p AS (SELECT model, category, 100 * sum(CASE WHEN verdict = 'PASS' THEN weight ELSE 0 END) / sum(weight) AS pct FROM facts WHERE run_id = 'a' GROUP BY ALL) SELECT model, round(max(round(pct, 4)) - min(round(pct, 4)), 4) AS gap FROM p GROUP BY model HAVING max(round(pct, 4)) - min(round(pct, 4)) >= 5")
def a20_spread(spark, sf_dir):
    board = scoring.leaderboard(scenarios(spark, sf_dir).where("run_id = 'a'"), "model", "category", _LANGS)
    v = F.array_compact(F.array(*_LANGS))
    return scoring.spread(board, _LANGS).select("model", F.round(F.array_max(v) - F.array_min(v), 4).alias("gap"))


@query(sql=f"WITH {_FACTS} SELECT model, category, sum(weight) AS t, count(*) AS n FROM facts GROUP BY GROUPING SETS ((model, category), (model))")
def a21_total_row(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.groupingSets([["model", "category"], ["model"]], "model", "category").agg(F.sum("weight").alias("t"), F.count("*").alias("n"))


@query(sql="""WITH x AS (SELECT toxic::DOUBLE AS x, n_chars::DOUBLE AS y FROM documents JOIN labels USING (doc_id)),
    r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM x) SELECT round(corr(rx::DOUBLE, ry::DOUBLE), 6) AS rho FROM r""")
def a11_spearman(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    return scoring.spearman(d, "toxic", "n_chars").select(F.round("rho", 6).alias("rho"))


@query(sql="SELECT doc_id, rank() OVER (PARTITION BY lang ORDER BY n_chars) + (count(*) OVER (PARTITION BY lang, n_chars) - 1) / 2.0 AS r FROM documents".replace("AS r FROM", "AS r FROM").replace("rank()", "(rank()").replace("/ 2.0 AS r", "/ 2.0)::DOUBLE AS r"))
def w7_average_rank(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scoring.average_rank("n_chars", ["lang"]).alias("r"))


@query(sql="""WITH l AS (SELECT CASE lang WHEN 'de' THEN 1 WHEN 'en' THEN 2 WHEN 'fr' THEN 3 END AS level, quality = 1 AND toxic = 0 AS ok FROM documents RIGHT JOIN labels USING (doc_id)),
    r AS (SELECT avg(ok::INT) FILTER (level = 1) AS r1, avg(ok::INT) FILTER (level = 2) AS r2, avg(ok::INT) FILTER (level = 3) AS r3, count(*) AS n, count(*) FILTER (level IS NULL) AS m FROM l)
    SELECT round(r1, 6) AS rate_1, round(r2, 6) AS rate_2, round(r3, 6) AS rate_3, n, m AS n_missing_level, NOT (coalesce(r2 < r1 - 0.05, false) OR coalesce(r3 < r2 - 0.05, false) OR coalesce(r3 < r1 - 0.05, false)) AS monotonic FROM r""")
def a12_j1_calibration(spark, sf_dir):
    level = F.when(F.col("lang") == "de", 1).when(F.col("lang") == "en", 2).when(F.col("lang") == "fr", 3)
    levels = table(spark, sf_dir, "documents").select("doc_id", level.alias("level")).where("level is not null")
    d = table(spark, sf_dir, "labels").join(levels, "doc_id", "left")  # a label without a level counts as missing one
    c = scoring.calibration(d.select("level", ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("ok")), "level", "ok")
    return c.withColumns({f"rate_{k}": F.round(f"rate_{k}", 6) for k in (1, 2, 3)})


@query(sql="SELECT lang, round(sum(n_chars * w) / sum(w), 6) AS loss FROM (SELECT lang, n_chars, CASE WHEN quality = 0 THEN 4.0 ELSE 1.0 END AS w FROM documents JOIN labels USING (doc_id)) GROUP BY lang")
def a27_weighted_loss(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    d = d.withColumn("w", F.when(F.col("quality") == 0, 4.0).otherwise(1.0))
    return scoring.weighted_loss(d, "n_chars", "w", ["lang"]).withColumn("loss", F.round("loss", 6))


@query(sql="SELECT lang, count(*) AS attempts, count(*) FILTER (quality = 1 AND toxic = 0) AS kept, count(*) FILTER (quality = 0) AS low_quality, count(*) FILTER (quality = 1 AND toxic = 1) AS toxic FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def a26_yields(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return d.groupBy("lang").agg(F.count("*").alias("attempts"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("kept"), F.count_if(F.col("quality") == 0).alias("low_quality"), F.count_if((F.col("quality") == 1) & (F.col("toxic") == 1)).alias("toxic"))


@query(sql="SELECT source, max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang FROM documents GROUP BY source")
def w13_latest(spark, sf_dir):
    return scoring.latest(table(spark, sf_dir, "documents").select("source", "doc_id", "lang"), ["source"], "doc_id")


@query(sql="SELECT lang, count(*) AS n FROM documents GROUP BY lang ORDER BY CASE lang WHEN 'fr' THEN 0 ELSE 1 END, lang")
def k6_category_order(spark, sf_dir):
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.when(F.col("lang") == "fr", 0).otherwise(1), "lang")


@query(sql="SELECT doc_id, source FROM labels JOIN documents USING (doc_id)")
def j2_inner_known(spark, sf_dir):
    return table(spark, sf_dir, "labels").select("doc_id").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")


@query(sql="SELECT DISTINCT conv_id AS doc_id, 'unknown id: ' || conv_id AS warning FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)")
def j2_unknown_ids(spark, sf_dir):
    """Results whose definition is not known, as warnings."""
    found = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"))
    return scoring.unknown_ids(found, table(spark, sf_dir, "labels"), "doc_id")


@query(sql="SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def j10_semi(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query(sql="SELECT item_id, lang, length(text) + length(lang) AS n FROM benchmark CROSS JOIN (SELECT DISTINCT lang FROM documents)")
def j8_prompt_matrix(spark, sf_dir):
    """Prompts by models: a bounded list of models is exploded onto each prompt."""
    langs = [r["lang"] for r in table(spark, sf_dir, "documents").select("lang").distinct().orderBy("lang").limit(1001).collect()]
    if len(langs) > 1000:
        raise ValueError("a matrix of over 1,000 models is not exploded onto each prompt")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", F.explode(F.array(*map(F.lit, langs)).cast("array<string>")).alias("lang"))
    return b.select("item_id", "lang", (F.length("text") + F.length("lang")).cast("bigint").alias("n"))


@query(sql="SELECT doc_id, n_chars, item_id FROM (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) AS k FROM documents) JOIN (SELECT item_id, row_number() OVER (ORDER BY item_id) AS k FROM benchmark) USING (k)")
def j11_positional_zip(spark, sf_dir):
    """The i-th document with the i-th item, by explicit ordinals."""
    from pyspark.sql.window import Window

    b = table(spark, sf_dir, "benchmark").select("item_id", F.row_number().over(Window.orderBy("item_id")).alias("k"))
    n = b.count()  # as many documents as there are items can take part
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("doc_id").limit(n)
    return d.withColumn("k", F.row_number().over(Window.orderBy("doc_id"))).join(b, "k").select("doc_id", "n_chars", "item_id")


@query(sql="SELECT doc_id, arg_max(k, (s, -k)) AS best, arg_min(k, (s, k)) AS worst FROM (SELECT doc_id, unnest([0, 1, 2]) AS k, unnest([doc_id % 4, doc_id // 3 % 4, n_chars % 4]) AS s FROM documents) GROUP BY doc_id")
def w14_first_argmax(spark, sf_dir):
    scores = F.array(F.col("doc_id") % 4, F.floor(F.col("doc_id") / 3) % 4, F.col("n_chars") % 4)
    s = table(spark, sf_dir, "documents").select("doc_id", scores.alias("s"))
    best = F.array_position("s", F.array_max("s")) - 1
    return s.select("doc_id", best.cast("int").alias("best"), (F.array_position("s", F.array_min("s")) - 1).cast("int").alias("worst"))


@query(sql="SELECT doc_id, CASE WHEN source LIKE 'src1%' THEN 'bad enum' END AS p1, CASE WHEN n_chars < 60 THEN 'too short' END AS p2, CASE WHEN doc_id IN (SELECT item_id FROM benchmark) THEN 'collision' END AS p3 FROM documents".replace("SELECT doc_id, CASE", "SELECT doc_id, concat_ws('; ', CASE", 1).replace("END AS p1,", "END,").replace("END AS p2,", "END,").replace("END AS p3", "END) AS problems"))
def f29_validate(spark, sf_dir):
    """All problems of a row in one string."""
    known = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), F.lit(True).alias("hit")).distinct()
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(known, "doc_id", "left")
    problems = F.concat_ws("; ", F.when(F.col("source").startswith("src1"), "bad enum"), F.when(F.col("n_chars") < 60, "too short"), F.when(F.col("hit"), "collision"))
    return d.select("doc_id", problems.alias("problems"))
