"""Language models as injected functions: ``generate(prompts) -> replies`` on Arrow batches.

A model object is made once per Python worker by ``make()``; the stub needs none and is
deterministic, so queries and tests run without a model.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from talkloom.functions import parse

Generate = Callable[[list[str]], list[str]]


def stub() -> Generate:
    """Replies by the prompt's digest: mostly YES or NO, now and then an unclear one."""

    def reply(prompt: str) -> str:
        k = hashlib.md5(prompt.encode("utf-8", "surrogatepass")).digest()[0]
        return "maybe yes, maybe no" if k < 32 else "YES" if k % 2 else "NO"

    return lambda prompts: [reply(p) for p in prompts]


def generate(prompt: Column, make: Callable[[], Generate] = stub, batch: int = 8) -> Column:
    @F.pandas_udf(StringType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for part in parts:
            filled = part.fillna("").tolist()
            out: list[str] = []
            for at in range(0, len(filled), batch):
                out += model(filled[at : at + batch])
            yield pd.Series(out, dtype="object")

    return run(prompt)


def judge(criteria: DataFrame, prompt: str, again: str, pass_if: str, make: Callable[[], Generate] = stub) -> DataFrame:
    """``criteria`` with ``answer`` and ``verdict``; only unclear answers are asked a second time, with ``again``."""
    first = criteria.withColumn("answer", parse.judge_answer(generate(F.col(prompt), make)))
    clear = first.where("answer <> 'UNCLEAR'").withColumn("retried", F.lit(False))
    second = first.where("answer = 'UNCLEAR'").withColumn("answer", parse.judge_answer(generate(F.col(again), make))).withColumn("retried", F.lit(True))
    return clear.unionByName(second).withColumn("verdict", parse.verdict(F.col("answer"), F.col(pass_if)))


def generate_and_repair(rows: DataFrame, prompt: str, ok: Callable[[Column], Column], rewrite: Callable[[Column, Column], Column], make: Callable[[], Generate] = stub) -> DataFrame:
    """``reply`` and ``source``: the first reply if it passes, else a rewritten one, which may fail too."""
    first = rows.withColumn("reply", generate(F.col(prompt), make)).withColumn("good", ok(F.col("reply")))
    kept = first.where("good").withColumn("source", F.lit("original"))
    fixed = first.where("not good").withColumn("reply", generate(rewrite(F.col(prompt), F.col("reply")), make))
    fixed = fixed.withColumn("source", F.when(ok(F.col("reply")), "repaired").otherwise("rewrite_attempt"))
    return kept.unionByName(fixed).drop("good")


def answer_turns(convs: DataFrame, key: str, users: str, make: Callable[[], Generate] = stub, system: str = "") -> DataFrame:
    """Conversations from simulated user turns, each answered with what was said before in view."""
    from talkloom.operators.turns import MESSAGE

    kind = convs.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for part in parts:
            talks: list[list[dict]] = [[] for _ in range(len(part))]
            asked = [list(u) if u is not None else [] for u in part["users"]]
            for turn in range(max(map(len, asked), default=0)):  # all conversations of a batch advance together
                live = [k for k in range(len(part)) if turn < len(asked[k])]
                for k in live:
                    talks[k].append({"role": "user", "content": asked[k][turn]})
                prompts = ["\n".join([system, *(f"{m['role']}: {m['content']}" for m in talks[k])]) for k in live]
                for k, reply in zip(live, model(prompts), strict=True):
                    talks[k].append({"role": "assistant", "content": reply})
            yield pd.DataFrame({"key": part["key"], "c": talks})

    return convs.select(F.col(key).alias("key"), F.col(users).alias("users")).mapInPandas(run, f"key {kind}, c {MESSAGE}").withColumnRenamed("key", key)
