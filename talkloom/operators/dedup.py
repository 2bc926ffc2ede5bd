"""Exact and near-duplicate removal for conversation corpora."""

from __future__ import annotations

import hashlib
import random
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType
from pyspark.sql.window import Window

from talkloom.sources.shared import cut

PRIME = (1 << 61) - 1
TOP = (1 << 32) - 1
_BLOCK = 64  # values hashed together, which stay in a processor's cache
_HELD = 4096  # rows of hashes gathered together


def first_by(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key.  The key is combined before it is shuffled; ties of ``order`` all stay."""
    low = df.groupBy(*key).agg(F.min(order).alias(order))
    return df.join(low, [*key, order], "left_semi")


def bands(permutations: int, threshold: float) -> tuple[int, int]:
    """Bands and rows whose collision curve turns closest to ``threshold``; the fewest bands on a tie."""
    return min(((b, permutations // b) for b in range(2, permutations + 1)), key=lambda x: abs((1 / x[0]) ** (1 / x[1]) - threshold))


@lru_cache
def family(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of ``n`` universal hashes modulo 2^61 - 1."""
    draw = random.Random(seed)
    a = [draw.randint(1, PRIME - 1) for _ in range(n)]
    b = [draw.randint(0, PRIME - 1) for _ in range(n)]
    return np.array(a, dtype=np.uint64), np.array(b, dtype=np.uint64)


def _fold(x: np.ndarray) -> np.ndarray:
    """Residue of 64-bit values modulo 2^61 - 1."""
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def hashed(raw: np.ndarray, n: int, seed: int) -> np.ndarray:
    """``((a raw + b) mod 2^61 - 1) mod 2^32`` of each value, a row, under each hash, a column.

    The 93-bit product is taken in halves of 32 bits, folded after every step.
    """
    a, b = family(n, seed)
    out = np.empty((len(raw), n), dtype=np.uint32)
    for at in range(0, len(raw), _BLOCK):
        part = raw[at : at + _BLOCK, None].astype(np.uint64)
        high = _fold((a >> np.uint64(32)) * part)
        high = _fold(((high & np.uint64((1 << 29) - 1)) << np.uint64(32)) + (high >> np.uint64(29)))
        low = _fold((a & np.uint64(TOP)) * part)
        out[at : at + _BLOCK] = _fold(_fold(high + low) + b) & np.uint64(TOP)
    return out


def minima(raw: np.ndarray, n: int, seed: int) -> np.ndarray:
    """For each hash the smallest of ``hashed``; all-top without values."""
    out = np.full(n, TOP, dtype=np.uint32)
    for at in range(0, len(raw), _HELD):
        out = np.minimum(out, hashed(raw[at : at + _HELD], n, seed).min(axis=0))
    return out.astype(np.int64)


class Signer:
    """Signatures of texts; the hashes of up to ``held`` grams are remembered, so a gram is hashed once, not once a text."""

    def __init__(self, permutations: int, k: int, seed: int, held: int = 1 << 17):
        self.n, self.k, self.seed, self.held = permutations, k, seed, held
        self.place: dict[str, int] = {}
        self.table = np.empty((0, permutations), dtype=np.uint32)

    def _places(self, grams: list[str]) -> np.ndarray:
        """Rows of ``table`` for ``held`` grams at most, which are all there afterwards."""
        new = [g for g in grams if g not in self.place]
        if len(self.place) + len(new) > self.held:
            self.place.clear()
            new = grams
        if new:
            first, last = len(self.place), len(self.place) + len(new)
            if last > len(self.table):
                wider = np.empty((min(self.held, 2 * last), self.n), dtype=np.uint32)
                wider[:first] = self.table[:first]
                self.table = wider
            raw = b"".join(hashlib.md5(g.encode("utf-8", "surrogatepass")).digest()[:4] for g in new)
            self.table[first:last] = hashed(np.frombuffer(raw, dtype="<u4"), self.n, self.seed)
            self.place.update(zip(new, range(first, last), strict=True))
        return np.fromiter(map(self.place.__getitem__, grams), dtype=np.int64, count=len(grams))

    def sign(self, text: str | None) -> np.ndarray:
        low, out = (text or "").lower(), np.full(self.n, TOP, dtype=np.uint32)
        grams = list({low[i : i + self.k] for i in range(len(low) - self.k + 1)})
        for at in range(0, len(grams), self.held):
            places = self._places(grams[at : at + self.held])
            for x in range(0, len(places), _HELD):
                out = np.minimum(out, self.table[places[x : x + _HELD]].min(axis=0))
        return out.astype(np.int64)


def minhash(text: Column, permutations: int = 128, k: int = 4, seed: int = 42) -> Column:
    """MinHash signature over the set of lower-cased character ``k``-grams."""

    @F.pandas_udf(ArrayType(LongType()))
    def sign(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        signer = Signer(permutations, k, seed)
        for part in parts:
            yield pd.Series([signer.sign(t) for t in part], dtype="object")

    return sign(text)


def band_keys(signature: Column, b: int, r: int) -> Column:
    """One hash per band, tagged with its number."""
    return F.array(*[F.xxhash64(F.lit(k), F.slice(signature, k * r + 1, r)) for k in range(b)])


def greedy_keep(rows: DataFrame, keys: str = "keys", order: str = "ord") -> DataFrame:
    """The rows that stay when each, in order, is dropped if it shares a key with one kept before.

    ``rows`` has distinct ``order`` and arrays of ``keys``.  In a round a row stays if it comes first
    among the undecided of all its keys, and every row that shares a key with one that stays goes;
    this gives the sequential answer.  No pair is formed: a key is an aggregate, and rows with
    equal keys are one row, for the later ones always go.  Rows that share no key stay before the
    first round, so the rounds read those alone that do.  Rows of a null ``order`` are left out.
    """
    equal = rows.where(F.col(order).isNotNull()).select(F.col(order).alias("ord"), F.array_sort(F.array_distinct(keys)).alias("keys"))
    first = cut(equal.groupBy("keys").agg(F.min("ord").alias("ord")))
    by_key = first.select("ord", F.explode("keys").alias("key"))
    shared = by_key.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    left = cut(by_key.join(shared, "key"))
    kept = cut(first.select("ord").join(left.select("ord").distinct(), "ord", "left_anti"))
    while not left.isEmpty():
        low = left.groupBy("key").agg(F.min("ord").alias("low"))
        judged = left.join(low, "key").groupBy("ord").agg(F.bool_and(F.col("ord") == F.col("low")).alias("stays"))
        stays = cut(judged.where("stays").select("ord"))
        kept = kept.unionByName(stays)
        hit = left.join(stays, "ord", "left_semi").select("key").distinct()
        gone = left.join(hit, "key", "left_semi").select("ord").distinct()
        left = cut(left.join(gone, "ord", "left_anti"))
    return kept.withColumnRenamed("ord", order)


def near_dedup_ids(rows: DataFrame, order: str, text: str, threshold: float = 0.8, permutations: int = 128) -> DataFrame:
    """``order`` of the rows that ``near_dedup`` keeps; ``rows`` are read once, for their signatures."""
    b, r = bands(permutations, threshold)
    keys = F.when(_filled(text), band_keys(minhash(F.col(text), permutations), b, r))
    signed = cut(rows.select(order, keys.alias("keys")))
    return signed.where("keys is null").select(order).unionByName(greedy_keep(signed.where("keys is not null"), "keys", order))


def _filled(text: str) -> Column:
    return F.length(F.trim(F.coalesce(F.col(text), F.lit("")))) > 0


def near_dedup(rows: DataFrame, order: str, text: str, threshold: float = 0.8, permutations: int = 128) -> DataFrame:
    """Rows without those whose text collides in a band with an earlier kept one; blank texts always stay.

    Texts shorter than a shingle have one signature, so the first of them stays.
    """
    kept = near_dedup_ids(rows.where(_filled(text)), order, text, threshold, permutations)
    return rows.where(~_filled(text)).unionByName(rows.where(_filled(text)).join(kept, order, "left_semi"))


def novel(rows: DataFrame, order: str, tokens: str, limit: float, last: int) -> DataFrame:
    """``rows`` with ``is_new``: no token similarity above ``limit`` with any of the ``last`` rows before it.

    Rows are compared with a bounded frame, never with all others.
    """
    from talkloom.functions.text import token_similarity

    w = Window.orderBy(order).rowsBetween(-last, -1)
    seen = rows.withColumn("before", F.collect_list(tokens).over(w))
    return seen.withColumn("is_new", ~F.exists("before", lambda t: token_similarity(F.col(tokens), t) > limit)).drop("before")
