"""Queries of deduplication, mixing, sampling and corpus profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from talkloom.functions import text
from talkloom.operators import dedup, sampling, turns
from talkloom.plans.registry import query
from talkloom.plans.tables import CONV, conversations, table, words_sql


@query(sql=f"WITH {CONV} SELECT conv_id % 4 AS file, min(conv_id) AS conv_id, count(*) AS n FROM conv GROUP BY conv_id % 4, c")
def u2_exact_per_file(spark, sf_dir):
    """Exact duplicates inside a file: the first stays."""
    c = conversations(spark, sf_dir).select("conv_id", (F.col("conv_id") % 4).alias("file"), turns.same(F.col("c")).alias("body"))
    kept = dedup.first_by(c, ["file", "body"], "conv_id")
    return kept.join(c.groupBy("file", "body").agg(F.count("*").alias("n")), ["file", "body"]).select("file", "conv_id", "n")


_PERMS = 3


def _minhash_sql() -> str:
    a, b = dedup.family(_PERMS, 42)
    cols = ", ".join(f"min((({int(x)}::HUGEINT * raw + {int(y)}::HUGEINT) % {dedup.PRIME}::HUGEINT) & 4294967295::HUGEINT)::BIGINT AS h{k}" for k, (x, y) in enumerate(zip(a, b, strict=True)))
    none = ", ".join(f"coalesce(h{k}, {dedup.TOP}) AS h{k}" for k in range(_PERMS))
    return f"""WITH g AS (SELECT item_id, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 2, 1)), lambda i: substr(lower(text), i, 4)))) AS gram FROM benchmark),
      r AS (SELECT item_id, ('0x' || substr(md5(gram), 7, 2) || substr(md5(gram), 5, 2) || substr(md5(gram), 3, 2) || substr(md5(gram), 1, 2))::BIGINT::HUGEINT AS raw FROM g),
      s AS (SELECT item_id, {cols} FROM r GROUP BY item_id)
    SELECT item_id, {none} FROM benchmark LEFT JOIN s USING (item_id)"""


@query(sql=_minhash_sql())
def a16_minhash(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", dedup.minhash(F.col("text"), _PERMS).alias("s"))
    return b.select("item_id", *[F.get("s", k).alias(f"h{k}") for k in range(_PERMS)])


@query(sql="""WITH c AS (SELECT b, 128 // b AS r, abs(power(1.0 / b, 1.0 / (128 // b)) - 0.8) AS e FROM range(2, 129) t(b)) SELECT b::BIGINT AS b, r::BIGINT AS r FROM c ORDER BY e, b LIMIT 1""")
def a17_band_tuner(spark, sf_dir):
    b, r = dedup.bands(128, 0.8)
    return spark.range(1).select(F.lit(b).cast("bigint").alias("b"), F.lit(r).cast("bigint").alias("r"))


@query()
def u3_j7_near_dedup(spark, sf_dir):
    """Greedy near-deduplication of all documents, in order of their ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return dedup.near_dedup(docs, "doc_id", "text").select("doc_id", "source")


@query()
def u3_conversations(spark, sf_dir):
    """The same for conversations by what their assistant says."""
    said = table(spark, sf_dir, "conversations").withColumn("text", F.when(F.col("role") == "assistant", F.col("text")))  # the others' words need not travel
    c = turns.to_arrays(said).select("conv_id", turns.assistant_text(F.col("c")).alias("text"))
    return dedup.near_dedup_ids(c, "conv_id", "text")


@query(sql="SELECT source, lang, count(*) AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def a23_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("n"))


@query(sql="SELECT text_md5, count(*) AS n FROM (SELECT md5(text) AS text_md5 FROM documents) GROUP BY 1 HAVING count(*) > 1")
def a24_duplicates(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.md5("text").alias("text_md5"))
    return d.groupBy("text_md5").agg(F.count("*").alias("n")).where("n > 1")


@query(sql="SELECT lang, coalesce(nullif(source, 'src0'), 'single') AS kind, count(*) AS n FROM documents GROUP BY ALL")
def a25_category_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("lang", F.coalesce(F.nullif("source", F.lit("src0")), F.lit("single")).alias("kind"))
    return d.groupBy("lang", "kind").agg(F.count("*").alias("n"))


def _rank_sql(p: int) -> str:
    return f"list_sort(list(n))[(round_even({p / 100} * (count(*) - 1), 0))::BIGINT + 1]"


@query(sql=f"WITH w AS (SELECT source, {words_sql('text')} AS n FROM documents) SELECT source, count(*) AS docs, round(avg(n), 6) AS avg_words, {_rank_sql(50)} AS p50, {_rank_sql(90)} AS p90 FROM w GROUP BY source")
def a9_a10_profile(spark, sf_dir):
    """Nearest-rank percentiles with half-even ranks, from counts of distinct values, so a hot source is no one long list."""
    from pyspark.sql.window import Window

    w = table(spark, sf_dir, "documents").select("source", text.n_words(F.col("text")).alias("n"))
    sizes = w.groupBy("source", "n").agg(F.count("*").alias("k"))
    part = Window.partitionBy("source")
    sizes = sizes.withColumn("upto", F.sum("k").over(part.orderBy("n"))).withColumn("all", F.sum("k").over(part))
    at = lambda p: F.min(F.when(F.col("upto") > F.bround(F.lit(p / 100) * (F.col("all") - 1)), F.col("n")))
    return sizes.groupBy("source").agg(F.max("all").alias("docs"), F.round(F.sum(F.col("n") * F.col("k")) / F.max("all"), 6).alias("avg_words"), at(50).alias("p50"), at(90).alias("p90"))


@query(sql=f"WITH w AS (SELECT lang, {words_sql('text')} AS n FROM documents) SELECT lang, count(*) AS docs, max(n) AS longest, round(avg(n), 6) AS mean, count(*) FILTER (n > 512) AS over FROM w GROUP BY lang".replace(" AS over ", ' AS "over" '))
def a15_token_lengths(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("lang", text.n_words(F.col("text")).alias("n"))
    return w.groupBy("lang").agg(F.count("*").alias("docs"), F.max("n").alias("longest"), F.round(F.avg("n"), 6).alias("mean"), F.count_if(F.col("n") > 512).alias("over"))


@query(sql="WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix:' || doc_id), doc_id) AS n FROM documents) SELECT doc_id, source FROM r WHERE n <= 20")
def w12_k7_cap(spark, sf_dir):
    """Twenty rows of each source, the first in shuffled order."""
    return sampling.cap(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 20)


_MIX = [("src0", 30), ("src1", 5), ("src2", 0)]


@query(sql="""WITH m(source, cap) AS (VALUES ('src0', 30), ('src1', 5), ('src2', 0)), r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('mix:' || doc_id), doc_id) AS n FROM documents)
    SELECT doc_id, source FROM r LEFT JOIN m USING (source) WHERE cap IS NULL OR n <= cap""")
def d23_j12_mix(spark, sf_dir):
    """Caps from a mix table; sources it does not name stay whole."""
    caps = spark.createDataFrame(_MIX, "source string, cap int")
    return sampling.cap(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", caps)


@query(sql="""WITH w(prefix, w, ord) AS (VALUES ('src1', 4.0, 0), ('src12', 3.0, 1), ('src', 1.5, 2)), s AS (SELECT DISTINCT source FROM documents),
    b AS (SELECT source, arg_min(w::DOUBLE, (source <> prefix)::INT * 100 + ord) AS weight FROM s LEFT JOIN w ON starts_with(source, prefix) GROUP BY source)
    SELECT source, coalesce(weight, 1.0) AS weight, count(*) AS n FROM documents JOIN b USING (source) GROUP BY ALL""")
def p12_j9_loss_weight(spark, sf_dir):
    """Weights by exact name, then by the first prefix that fits."""
    weights = spark.createDataFrame([("src1", 4.0, 0), ("src12", 3.0, 1), ("src", 1.5, 2)], "prefix string, w double, ord int")
    d = sampling.weight_for(table(spark, sf_dir, "documents").select("source"), "source", weights)
    return d.groupBy("source", "weight").agg(F.count("*").alias("n"))


def _split_sql(v: str, order: str = "") -> str:
    return f"""WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY md5('split:' || doc_id), doc_id) AS n, count(*) OVER () AS t FROM documents)
      SELECT doc_id, CASE WHEN {v} THEN 'val' ELSE 'train' END AS split FROM r"""


@query(sql=_split_sql("n <= CASE WHEN greatest(50, floor(t * 0.15)) > t THEN t // 10 ELSE greatest(50, floor(t * 0.15)) END"))
def k9_global_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")


@query(sql=_split_sql("n > t - greatest(1, floor(t * 0.1))"))
def k12_tail_split(spark, sf_dir):
    return sampling.split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 1, 0.1, tail=True)


@query(sql="""WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('split:' || doc_id), doc_id) AS n, count(*) OVER (PARTITION BY source) AS t FROM documents)
    SELECT doc_id, source, CASE WHEN n <= least(t, greatest(10, floor(t * 0.15))) THEN 'val' ELSE 'train' END AS split FROM r""")
def k10_stratified_split(spark, sf_dir):
    return sampling.split_by(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query(sql="SELECT doc_id FROM documents ORDER BY md5('sample:' || doc_id), doc_id LIMIT 25")
def k8_sample(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy(sampling.shuffle_key("sample", F.col("doc_id")), "doc_id").limit(25)


@query(sql="""WITH u AS (SELECT doc_id, ('0x' || substr(md5('mode:' || doc_id), 1, 8))::BIGINT / 4294967296.0 AS u FROM documents)
    SELECT doc_id, CASE WHEN u < 0.25 THEN 'a' WHEN u < 0.4 THEN 'b' WHEN u < 0.75 THEN 'c' ELSE 'd' END AS mode, CASE WHEN u < 0.35 THEN 'casual' ELSE 'clinical' END AS style FROM u""")
def k13_k14_weighted_choice(spark, sf_dir):
    u = sampling.unit("mode", F.col("doc_id"))
    return table(spark, sf_dir, "documents").select("doc_id", sampling.choose(u, {"a": 0.25, "b": 0.15, "c": 0.35, "d": 0.25}).alias("mode"), F.when(u < 0.35, "casual").otherwise("clinical").alias("style"))


@query(sql="SELECT doc_id, ['north','east','south','west'][doc_id % 4 + 1] AS pick FROM documents")
def k15_round_robin(spark, sf_dir):
    names = F.array(*map(F.lit, ("north", "east", "south", "west")))
    return table(spark, sf_dir, "documents").select("doc_id", F.get(names, (F.col("doc_id") % 4).cast("int")).alias("pick"))


@query(sql="WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents) SELECT doc_id, lang FROM r WHERE n <= 10")
def k5_first_samples(spark, sf_dir):
    from talkloom.operators import sessions

    return sessions.last_sessions(table(spark, sf_dir, "documents").select("doc_id", "lang"), "lang", [F.col("doc_id")], 10)


@query(sql="SELECT 'doc' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'item', item_id, text FROM benchmark")
def u1_union_all(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), "text")
    return d.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), "text"))


@query(sql="SELECT DISTINCT id FROM (SELECT doc_id AS id FROM labels UNION SELECT item_id FROM benchmark)")
def u4_id_union(spark, sf_dir):
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id")).union(table(spark, sf_dir, "benchmark").select("item_id")).distinct()


@query(sql="SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def u6_except(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id", "left_anti").distinct()


@query(sql="SELECT doc_id, list_has_all([lang, source], ['en', 'src0']) AS ok FROM documents")
def u7_f23_superset(spark, sf_dir):
    from talkloom.operators import rules

    return table(spark, sf_dir, "documents").select("doc_id", rules.has_all(F.array("lang", "source"), ["en", "src0"]).alias("ok"))


_J6 = r"list_filter(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}\p{M}_]+')), lambda w: NOT list_contains(['a','the','and','or','in','with','to','for','of','on','at'], w))"


@query(sql=f"""WITH b AS (SELECT item_id, {_J6} AS t FROM benchmark)
    SELECT x.item_id, count(y.item_id) = 0 AS is_new FROM b x LEFT JOIN b y ON y.item_id < x.item_id AND y.item_id >= x.item_id - 50
      AND len(list_intersect(x.t, y.t)) > 0.2 * len(list_distinct(list_concat(x.t, y.t))) GROUP BY x.item_id""")
def j6_w3_novelty(spark, sf_dir):
    """No token similarity above 0.2 with any of the fifty items before."""
    b = table(spark, sf_dir, "benchmark").select("item_id", text.similarity_tokens(F.col("text")).alias("t"))
    return dedup.novel(b, "item_id", "t", 0.2, 50).select("item_id", "is_new")
