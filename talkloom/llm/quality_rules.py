"""Quality rules as a learned decision list, in DataFrame operations only.

Features are Spark SQL expressions over the whole text.  Learning is sequential covering:
grow a conjunction of thresholds by FOIL gain on the labelled rows that no earlier rule
covers, prune it on other labelled rows, stop when a rule is not pure enough.  Each step
reads one small table of statistics, counts of either label by feature and bin, which Spark
aggregates over all labelled rows.  The list becomes one ordered ``CASE WHEN``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WHITE, cut

FEATURES = ("mean_word", "symbol_share", "repeat_share", "dup_line_share", "upper_share", "bang_share", "pipe_share", "distinct_share")


def base_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` with counts over the whole text: n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, and the counts behind the other features.

    n_repeat_words are the words in three-word windows that occur twice or more.  Windows are
    hashed to 64 bits, sorted with their position, and runs of equal hashes counted: n log n in
    the words of a text, so very long texts stay cheap.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).alias("id"), text.alias("t"))
    d = d.select("id", "t", F.filter(F.split("t", WHITE + "+"), lambda w: w != "").alias("w"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    d = d.select(
        "id",
        "w",
        F.size("w").cast("bigint").alias("n_words"),
        F.length(F.regexp_replace("t", WHITE + "+", "")).cast("bigint").alias("word_chars"),
        F.length(F.regexp_replace("t", r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
        F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))[0].cast("bigint").alias("n_dup_lines"),
        F.size(lines).cast("bigint").alias("n_lines"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("bigint").alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^!?]+", "")).cast("bigint").alias("n_bang"),
        F.length(F.regexp_replace("t", r"[^|]+", "")).cast("bigint").alias("n_pipe"),
        F.size(F.array_distinct("w")).cast("bigint").alias("n_distinct"),
    )
    steps = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    hashes = F.transform(steps, lambda i: F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)))
    return d.withColumn("h", hashes).withColumn("n_repeat_words", _covered(F.col("h"))).drop("w", "h")


def _covered(h: Column) -> Column:
    """Words that windows of three with equal hashes cover."""

    def starts(s: Column) -> Column:
        """Sorted positions of the windows whose hash is found again; ``s`` is sorted (hash, position)."""
        same = lambda i, j: F.get(s, i)["x"].eqNullSafe(F.get(s, j)["x"])
        again = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: same(i, i - 1) | same(i, i + 1))
        return F.array_sort(F.transform(again, lambda i: F.get(s, i)["i"]))

    def words(p: Column) -> Column:
        gaps = F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.least(F.lit(3), F.coalesce(F.get(p, k) - F.get(p, k - 1), F.lit(3))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    keyed = F.transform(h, lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    positions = F.transform(F.array(F.array_sort(keyed)), starts)
    return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(F.transform(positions, words)[0]).cast("bigint")


def features(counts: DataFrame) -> DataFrame:
    """``counts`` with FEATURES added, all doubles and never null."""
    n, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    return counts.select(
        "*",
        (F.col("word_chars") / n).alias("mean_word"),
        (F.col("n_symbols") / chars).alias("symbol_share"),
        (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1))).alias("dup_line_share"),
        (F.col("n_upper") / chars).alias("upper_share"),
        (F.col("n_bang") / chars).alias("bang_share"),
        (F.col("n_pipe") / n).alias("pipe_share"),
        (F.col("n_distinct") / n).alias("distinct_share"),
    )


@dataclass(frozen=True)
class Test:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.feature) > self.threshold if self.above else F.col(self.feature) <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Test, ...]


def covers(rule: Rule) -> Column:
    out = F.lit(True)
    for test in rule:
        out = out & test.column()
    return out


def verdict(rules: list[Rule]) -> Column:
    """True unless a rule fires: an ordered conditional expression."""
    case = None
    for rule in rules:
        case = F.when(covers(rule), False) if case is None else case.when(covers(rule), False)
    return F.lit(True) if case is None else case.otherwise(True)


class Learner:
    """Sequential covering over ``id, quality`` rows joined to FEATURES.

    ``purity`` is the least share of bad rows among those a rule fires on, in the growing and in
    the pruning rows; ``least`` the fewest bad rows it must find.  The thresholds tried are the
    ``bins`` quantiles of a feature among all labelled rows, and among the bad ones.
    """

    def __init__(self, labelled: DataFrame, bins: int = 24, purity: float = 0.95, least: int = 3, max_rules: int = 8, max_tests: int = 3):
        self.bins, self.purity, self.least, self.max_rules, self.max_tests = bins, purity, least, max_rules, max_tests
        part = F.when(F.pmod(F.xxhash64("id"), F.lit(3)) == 0, "prune").otherwise("grow")
        self.rows = cut(labelled.select("id", (F.col("quality") == 0).alias("bad"), part.alias("part"), *FEATURES).where("bad is not null"))
        self.cuts = self._cuts()

    def _cuts(self) -> dict[str, list[float]]:
        at = [k / self.bins for k in range(self.bins + 1)]
        values = [(f"{c}_{k}", x) for c in FEATURES for k, x in (("all", F.col(c)), ("bad", F.when(F.col("bad"), F.col(c))))]
        row = self.rows.agg(*[F.percentile(x, F.array(*map(F.lit, at))).alias(name) for name, x in values]).first()
        return {c: sorted({float(v) for k in ("all", "bad") for v in row[f"{c}_{k}"] or []}) for c in FEATURES}

    def _counts(self, rows: DataFrame) -> tuple[int, int]:
        r = rows.agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).first()
        return r["p"], r["n"]

    def _histogram(self, rows: DataFrame) -> dict[str, list[tuple[int, int]]]:
        """Counts of (bad, good) by feature and bin; bin ``k`` has the values in (cut k-1, cut k]."""
        def search(c: str) -> Column:
            cuts = F.array(*[F.lit(t) for t in self.cuts[c]])
            return F.size(F.filter(cuts, lambda t: F.col(c) > t))

        pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("f"), search(c).alias("k")) for c in FEATURES if self.cuts[c]]))
        found = rows.select("bad", pairs.alias("x")).groupBy("x.f", "x.k").agg(F.count_if("bad").alias("p"), F.count_if(~F.col("bad")).alias("n")).collect()  # features x bins rows
        out = {c: [(0, 0)] * (len(self.cuts[c]) + 1) for c in FEATURES}
        for r in found:
            out[r["f"]][r["k"]] = (r["p"], r["n"])
        return out

    def _grow(self, rows: DataFrame) -> Rule:
        rule: Rule = ()
        p, n = self._counts(rows)
        while p and n and len(rule) < self.max_tests:
            best, gain = None, 0.0
            before = math.log2(p / (p + n))
            for c, bins in self._histogram(rows.where(covers(rule))).items():
                low = (0, 0)
                for k, t in enumerate(self.cuts[c]):
                    low = (low[0] + bins[k][0], low[1] + bins[k][1])
                    for above, (a, b) in ((False, low), (True, (p - low[0], n - low[1]))):
                        if a and a * (math.log2(a / (a + b)) - before) > gain + 1e-9:
                            best, gain, counts = Test(c, above, t), a * (math.log2(a / (a + b)) - before), (a, b)
            if best is None:
                break
            rule += (best,)
            p, n = counts
        return rule

    def _value(self, rule: Rule, rows: DataFrame) -> float:
        p, n = self._counts(rows.where(covers(rule)))
        return (p - n) / (p + n) if p + n else -1.0

    def _prune(self, rule: Rule, rows: DataFrame) -> Rule:
        while len(rule) > 1 and self._value(rule[:-1], rows) >= self._value(rule, rows):
            rule = rule[:-1]
        return rule

    def learn(self) -> list[Rule]:
        rules: list[Rule] = []
        left = self.rows
        while len(rules) < self.max_rules:
            grow, prune = left.where("part = 'grow'"), left.where("part = 'prune'")
            if not (rule := self._grow(grow)):
                break
            rule = self._prune(rule, prune)
            (p, n), (q, m) = self._counts(grow.where(covers(rule))), self._counts(prune.where(covers(rule)))
            if p < self.least or p < self.purity * (p + n) or q < self.purity * (q + m):
                break
            rules.append(rule)
            left = left.where(~covers(rule))
        return rules


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and features of every row, computed once and kept in the shared folder without texts."""
    return cut(features(base_counts(docs, id_col, text_col)))


def learn(rows: DataFrame, labels: DataFrame, id_col: str = "doc_id", **options) -> list[Rule]:
    """Rules from every one of ``rows`` (``judged``) with a label (``labels``: id, quality; 1 good, 0 bad)."""
    marks = labels.select(F.col(id_col).alias("id"), F.col("quality")).where("quality is not null").groupBy("id").agg(F.min("quality").alias("quality"))
    return Learner(rows.join(marks, "id"), **options).learn()


def apply(rows: DataFrame, rules: list[Rule]) -> DataFrame:
    """``rows`` (``judged``, or features(base_counts(...))) with ``base_failed`` and ``kept`` added.

    A null text has no words and fails the base rules, as does an empty one.  Repeated rows and
    ids stay; empty input gives no rows; other columns of the documents are ignored.  Without
    rules (no labels, or none pure enough) only the base rules decide.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


def keep(docs: DataFrame, rules: list[Rule], text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``apply`` keeps, with their own columns, in one pass.

    The rows pass through a generator: a plain filter would be pushed below the projections that
    make the features, with a copy of them for every use.
    """
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("body"))
    passed = apply(features(base_counts(whole, "row", "body")), rules).select(F.explode_outer(F.when(F.col("kept"), F.array("id"))).alias("row"))
    return passed.where("row is not null").select("row.*")
