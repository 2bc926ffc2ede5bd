"""Toxicity scores by non-negative positive-unlabelled learning, in numpy.

Confirmed toxic rows are the positives; documents whose label is not looked at are the
unlabelled set.  Linear classifiers over hashed words minimise the class-prior-corrected
risk ``pi R_P(+) + max(0, R_U(-) - pi R_P(-))`` (Kiryo et al., 2017): where the corrected
negative risk falls below zero its gradient is reversed, which keeps a flexible model from
over-fitting the positives.  Their mean margin is mapped to a probability on labelled rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
_WORD = re.compile(r"\w+")
_STEM = 5
_MEMO = 1 << 19


class Hasher:
    """Distinct hashed features of a text: its words, and the first five letters of longer ones."""

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> np.ndarray:
        memo, out = self.memo, set()
        if len(memo) > _MEMO:
            memo.clear()
        for word in set(_WORD.findall((text or "").lower())):
            ids = memo.get(word)
            if ids is None:
                ids = (self._id("w" + word), self._id("s" + word[:_STEM])) if len(word) > _STEM else (self._id("w" + word),)
                memo[word] = ids
            out.update(ids)
        return np.fromiter(out, dtype=np.int32, count=len(out))

    @staticmethod
    def _id(feature: str) -> int:
        return zlib.crc32(feature.encode("utf-8", "surrogatepass")) >> (32 - BITS)


@dataclass
class Model:
    """Weights of the chosen features, and the map from margin to probability."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, dtype=np.float64)
        out[self.ids] = self.weights
        return out

    def probability(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


NONE = Model(np.zeros(0, np.int32), np.zeros(0), 0.0, 0.0, -40.0)


class _Rows:
    """Sparse binary rows, restricted to the chosen features."""

    def __init__(self, docs: list[np.ndarray], place: np.ndarray):
        columns = [place[d] for d in docs]
        columns = [c[c >= 0] for c in columns]
        self.n = len(docs)
        self.col = np.concatenate(columns) if columns else np.zeros(0, np.int64)
        self.row = np.repeat(np.arange(self.n), [len(c) for c in columns])

    def margins(self, w: np.ndarray, b: float) -> np.ndarray:
        return np.bincount(self.row, weights=w[self.col], minlength=self.n) + b

    def back(self, g: np.ndarray, size: int) -> tuple[np.ndarray, float]:
        return np.bincount(self.col, weights=g[self.row], minlength=size), float(g.sum())


def choose(pos: list[np.ndarray], unl: list[np.ndarray], most: int, lift: float = 3.0) -> np.ndarray:
    """The features that mark positives best, in deviations of their rates.

    A feature counts that is ``lift`` times as frequent among positives as among unlabelled rows,
    and not by the accident of a few: only these may speak, so a long text gathers no noise.
    """
    size = 1 << BITS
    p = np.bincount(np.concatenate(pos), minlength=size)
    u = np.bincount(np.concatenate(unl), minlength=size) if unl else np.zeros(size, dtype=np.int64)
    n, m = len(pos), max(1, len(unl))
    rate = (p + u + 1) / (n + m + 2)
    z = (p / n - u / m) / np.sqrt(rate * (1 - rate) * (1 / n + 1 / m))
    seen = np.flatnonzero((p >= max(min(4, n), n / 200)) & (p / n >= lift * (u + 0.5) / (m + 1)) & (z >= 3))
    return np.sort(seen[np.argsort(-z[seen], kind="stable")[:most]]).astype(np.int32)


def train_one(pos: _Rows, unl: _Rows, size: int, prior: float, steps: int, l2: float) -> tuple[np.ndarray, float]:
    """Non-negative PU risk with the logistic loss, by Adam on all rows; weights stay at or above 0."""
    w, b = np.zeros(size), -1.0
    mom, var = np.zeros(size + 1), np.zeros(size + 1)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    for t in range(1, steps + 1):
        fp, fu = pos.margins(w, b), unl.margins(w, b)
        negative = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        gw, gb = pos.back(-prior * sig(-fp) / pos.n, size)
        un, ub = unl.back(sig(fu) / unl.n, size)
        pn, pb = pos.back(prior * sig(fp) / pos.n, size)
        way = 1.0 if negative >= 0 else -1.0
        keep = 1.0 if negative >= 0 else 0.0
        g = np.append(keep * gw + way * (un - pn) + l2 * w, keep * gb + way * (ub - pb))
        mom = 0.9 * mom + 0.1 * g
        var = 0.999 * var + 0.001 * g * g
        step = 0.05 * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-8)
        w, b = np.maximum(w - step[:-1], 0), b - step[-1]
    return w, b


def calibrate(margin: np.ndarray, label: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift of a logistic map with Platt's smoothed targets, by Newton steps.

    ``weight`` tells how many rows each one stands for.
    """
    good, bad = label.sum(), len(label) - label.sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(label > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    weight = np.ones(len(label)) if weight is None else weight * (len(label) / weight.sum())
    a, b = 1.0, 0.0
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        grad = x.T @ (weight * (p - target)) + 1e-3 * np.array([a - 1, b])
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        da, db = np.clip(np.linalg.solve(hess, grad), -2, 2)
        a, b = max(1e-3, a - da), b - db
    return float(a), float(b)


def fit(pos: list[np.ndarray], unl: list[np.ndarray], clean: list[np.ndarray], prior: float, most: int = 3000, bags: int = 3, steps: int = 150, l2: float = 1e-4, stand: tuple[float, float] = (1.0, 1.0)) -> Model:
    """``clean`` (labelled not toxic) serves only to map margins to probabilities.

    ``stand`` tells how many labelled rows each of ``pos`` and of ``clean`` stands for, so that the
    map sees the classes in their share of all labels however many of either were sampled.
    """
    if not pos or not (unl or clean):
        return NONE
    unl = unl or clean
    ids = choose(pos, unl, most)
    place = np.full(1 << BITS, -1, dtype=np.int64)
    place[ids] = np.arange(len(ids))
    rows, rng = _Rows(pos, place), np.random.default_rng(7)
    total, bias = np.zeros(len(ids)), 0.0
    for _ in range(bags):
        some = rng.choice(len(unl), size=max(1, len(unl) * 4 // 5), replace=False)
        w, b = train_one(rows, _Rows([unl[k] for k in some], place), len(ids), prior, steps, l2)
        total, bias = total + w / bags, bias + b / bags
    known = _Rows(pos + clean, place)
    label = np.array([1.0] * len(pos) + [0.0] * len(clean))
    slope, shift = calibrate(known.margins(total, bias), label, np.where(label > 0, *stand))
    return Model(ids, total, bias, slope, shift)


def fold(id_: Column) -> Column:
    return F.crc32(id_.cast("string").cast("binary")) % 3


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_positive: int = 4000, most_unlabelled: int = 8000, most_clean: int = 4000, seed: int = 0) -> Model:
    """Fit on a bounded sample of the rows whose fold is not 1.

    ``most_positive``, ``most_unlabelled`` and ``most_clean`` bound the sample: the rows of each
    kind with the smallest hashes of their ids.  No other row is learnt from; the class prior and
    the weights of the classes in the calibration come from all labelled rows of those folds, so a
    score means the same whether or not a bound holds.  Without positives every score is near 0.
    """
    mark = labels.select(F.col(id_col).alias("id"), "toxic").where("toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic")).where(fold(F.col("id")) != 1)
    counts = mark.agg(F.count_if(F.col("toxic") == 1).alias("p"), F.count_if(F.col("toxic") == 0).alias("c"), F.count("*").alias("n")).first()
    if not counts["p"]:
        return NONE
    order = F.xxhash64("id", F.lit(seed))
    pick = lambda df, kind, n: df.select("id").orderBy(order, "id").limit(n).withColumn("kind", F.lit(kind))
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (fold(F.col("id")) != 1))
    ids = (
        pick(mark.where("toxic = 1"), "p", most_positive)
        .unionByName(pick(mark.where("toxic = 0"), "c", most_clean))
        .unionByName(pick(own.select("id").distinct(), "u", most_unlabelled))
    )
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in batches:
            found = [hasher(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "kind", "f"])

    # The sample is bounded by the three parameters, whatever the tables hold.
    chosen = own.join(F.broadcast(ids), "id").select("id", "kind", "text")
    by: dict[str, list] = {"p": [], "u": [], "c": []}
    for row in sorted(chosen.mapInArrow(run, f"id {kind}, kind string, f binary").collect(), key=lambda r: (r["kind"], r["id"], bytes(r["f"]))):
        by[row["kind"]].append(np.frombuffer(row["f"], dtype=np.int32))
    prior = min(0.5, max(0.001, counts["p"] / counts["n"]))
    stand = tuple(max(1.0, counts[k] / most) for k, most in (("p", most_positive), ("c", most_clean)))
    return fit(by["p"], by["u"], by["c"], prior, stand=stand)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """``id, held_out, score, predicted`` for every row, from its whole text alone.

    Null and empty texts have no feature and get the score of the bias.  Repeated rows and ids
    stay; a null id is not held out; empty input gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = Hasher(), model.table()
        for batch in batches:
            margins = np.array([table[hasher(t.as_py())].sum() for t in batch.column(1)], dtype=np.float64) + model.bias
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.probability(margins), pa.float64())], names=["id", "score"])

    scored = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double")
    held = F.coalesce(fold(F.col("id")) == 1, F.lit(False))
    return scored.select("id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
