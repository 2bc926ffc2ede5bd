"""Masked pseudo-likelihood from a bidirectional window network, trained in numpy.

A token is a byte of the UTF-8 text, so nothing is out of vocabulary.  The network sees the
``radius`` bytes on each side of a masked one, adds their position-wise embeddings, and
predicts the byte with one tanh layer and a softmax.  A document's score is the sum over its
bytes of the log-probability given both sides.

Training covers the whole corpus: counts of every (context, byte) are gathered with partial
combining, and trainers take weighted steps over their share of the distinct contexts.  After
each round their parameters are averaged, weighted by the bytes they stand for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

_SPAN = 1 << 22  # bytes handled at a time
_KNOWN = 1 << 21  # distinct (context, byte) kept by a worker


def keys(data: np.ndarray, radius: int) -> np.ndarray:
    """(context, byte) of every position of ``data`` but the first and last ``radius``.

    The context is in the high bytes, left to right, the predicted byte in the lowest.
    """
    n = len(data) - 2 * radius
    key = np.zeros(max(0, n), dtype=np.uint64)
    for k in [*range(radius), *range(radius + 1, 2 * radius + 1), radius]:
        np.left_shift(key, np.uint64(8), out=key)
        np.bitwise_or(key, data[k : k + n], out=key)
    return key


def spans(texts: Iterator[str | None], radius: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Groups of texts as (keys, index of the text of each start, starts); long texts come in parts.

    A text is framed by ``radius`` zero bytes on each side.
    """
    frame = b"\0" * radius
    parts: list[np.ndarray] = []
    owners: list[int] = []
    size = 0

    def out() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *[len(p) for p in parts]])[:-1]
        return np.concatenate(parts), np.array(owners), starts

    for k, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass")
        for at in range(0, len(data), _SPAN):
            left = data[at - radius : at] if at else frame
            right = data[at + _SPAN : at + _SPAN + radius]
            right += frame[: radius - len(right)]
            parts.append(keys(np.frombuffer(left + data[at : at + _SPAN] + right, dtype=np.uint8), radius))
            owners.append(k)
            size += len(parts[-1])
            if size >= _SPAN:
                yield out()
                parts, owners, size = [], [], 0
    if parts:
        yield out()


def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    both = np.concatenate([a[0], b[0]])
    order = np.argsort(both, kind="stable")
    both, n = both[order], np.concatenate([a[1], b[1]])[order]
    first = np.flatnonzero(np.append(True, both[1:] != both[:-1])) if len(both) else np.zeros(0, np.int64)
    return both[first], np.add.reduceat(n, first) if len(first) else n


def gather(docs: DataFrame, text_col: str, radius: int) -> DataFrame:
    """``key, n``: how often each (context, byte) occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        held = empty

        def emit(x: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(x[0]), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[0][at : at + (1 << 16)].astype(np.int64)), pa.array(x[1][at : at + (1 << 16)])], names=["key", "n"])

        for batch in batches:
            for found, _, _ in spans((t.as_py() for t in batch.column(0)), radius):
                held = merge(held, np.unique(found, return_counts=True))
                if len(held[0]) > _KNOWN:
                    yield from emit(held)
                    held = empty
        yield from emit(held)

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "key bigint, n bigint")
    return rows.groupBy("key").agg(F.sum("n").alias("n"))


class Network:
    """``log p(byte | window)``; parameters are float32 arrays E, c, W, b."""

    def __init__(self, radius: int, width: int, arrays: list[np.ndarray] | None = None):
        self.radius, self.width = radius, width
        rng = np.random.default_rng(11)
        self.arrays = arrays or [
            (rng.standard_normal((2 * radius, 256, width)) * 0.3).astype(np.float32),
            np.zeros(width, np.float32),
            (rng.standard_normal((width, 256)) * 0.1).astype(np.float32),
            np.zeros(256, np.float32),
        ]

    def window(self, context: np.ndarray) -> list[np.ndarray]:
        return [(context >> np.uint64(8 * (2 * self.radius - 1 - k)) & np.uint64(255)).astype(np.int64) for k in range(2 * self.radius)]

    def forward(self, context: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        e, c, w, b = self.arrays
        at = self.window(context)
        h = np.tanh(sum(e[k][x] for k, x in enumerate(at)) + c)
        z = h @ w + b
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        return at, h, z

    def gradient(self, context: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[list[np.ndarray], float]:
        """Of the weighted mean negative log-probability of the targets."""
        own, row = np.unique(context, return_inverse=True)
        at, h, logp = self.forward(own)
        total = weight.sum()
        loss = -float((weight * logp[row, target]).sum() / total)
        g = np.exp(logp) * (np.bincount(row, weights=weight, minlength=len(own)) / total).astype(np.float32)[:, None]
        np.subtract.at(g, (row, target), (weight / total).astype(np.float32))
        e, _, w, _ = self.arrays
        gh = (g @ w.T) * (1 - h * h)
        ge = np.zeros_like(e)
        for k, x in enumerate(at):
            one = np.zeros((len(x), 256), np.float32)
            one[np.arange(len(x)), x] = 1
            ge[k] = one.T @ gh
        return [ge, gh.sum(axis=0), h.T @ g, g.sum(axis=0)], loss


def train_block(net: Network, key: np.ndarray, n: np.ndarray, rate: float, batch: int, epochs: int, seed: int) -> float:
    """Adam over weighted rows; the last epoch's mean loss."""
    mom = [np.zeros_like(x) for x in net.arrays]
    var = [np.zeros_like(x) for x in net.arrays]
    rng, t, loss = np.random.default_rng(seed), 0, 0.0
    context, target, weight = key >> np.uint64(8), (key & np.uint64(255)).astype(np.int64), n.astype(np.float64)
    for _ in range(epochs):
        order, losses = rng.permutation(len(key)), []
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            grads, now = net.gradient(context[pick], target[pick], weight[pick])
            losses.append(now)
            t += 1
            for k, g in enumerate(grads):
                mom[k] = 0.9 * mom[k] + 0.1 * g
                var[k] = 0.98 * var[k] + 0.02 * g * g
                net.arrays[k] = net.arrays[k] - rate * (mom[k] / (1 - 0.9**t)) / (np.sqrt(var[k] / (1 - 0.98**t)) + 1e-8)
        loss = float(np.mean(losses)) if losses else 0.0
    return loss


def train(counts: DataFrame, radius: int, width: int, rounds: int = 3, trainers: int = 8, epochs: int = 2, batch: int = 8192, block: int = 1 << 20) -> Network:
    """Parameter averaging over ``trainers`` tasks, each of which reads its share in blocks.

    ``trainers`` bounds what the driver gets: one set of parameters from each, a round.
    """
    shares = cut(counts.repartition(trainers, "key"))
    net = Network(radius, width)
    for k in range(rounds):
        shape = [x.shape for x in net.arrays]
        flat = np.concatenate([x.ravel() for x in net.arrays]).astype(np.float32).tobytes()
        rate = 0.02 / (1 + 2 * k)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Network(radius, width, _unflat(flat, shape))  # noqa: B023
            held, size, weight, seed = [], 0, 0, 0

            def step() -> None:
                key = np.concatenate([x for x, _ in held]).astype(np.uint64)
                n = np.concatenate([x for _, x in held])
                order = np.argsort(key)  # the same steps whatever the order of rows
                train_block(own, key[order], n[order], rate, batch, epochs, seed)  # noqa: B023

            for rows in batches:
                held.append((rows.column(0).to_numpy(), rows.column(1).to_numpy()))
                size += rows.num_rows
                weight += int(held[-1][1].sum())
                if size >= block:
                    step()
                    held, size, seed = [], 0, seed + 1
            if held:
                step()
            if weight:
                out = np.concatenate([x.ravel() for x in own.arrays]).astype(np.float32).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([out], pa.binary()), pa.array([weight], pa.int64())], names=["p", "weight"])

        got = shares.mapInArrow(run, "p binary, weight bigint").collect()  # at most ``trainers`` rows
        if not got:
            break
        got.sort(key=lambda r: (r["weight"], bytes(r["p"])))
        total = sum(r["weight"] for r in got)
        mean = sum(np.frombuffer(r["p"], np.float32).astype(np.float64) * (r["weight"] / total) for r in got)
        net = Network(radius, width, _unflat(mean.astype(np.float32).tobytes(), shape))
    return net


def _unflat(flat: bytes, shapes: list[tuple[int, ...]]) -> list[np.ndarray]:
    data, out, at = np.frombuffer(flat, np.float32), [], 0
    for s in shapes:
        size = int(np.prod(s))
        out.append(data[at : at + size].reshape(s).copy())
        at += size
    return out


class Scorer:
    """Log-probabilities of keys; those met before are looked up."""

    def __init__(self, net: Network):
        self.net = net
        self.key, self.logp = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def compute(self, key: np.ndarray) -> np.ndarray:
        out = np.empty(len(key), np.float32)
        context = key >> np.uint64(8)
        own, row = np.unique(context, return_inverse=True)
        target = (key & np.uint64(255)).astype(np.int64)
        ends = np.searchsorted(row, np.arange(0, len(own) + 4096, 4096))  # keys are sorted, so rows are
        for k, at in enumerate(range(0, len(own), 4096)):
            _, _, logp = self.net.forward(own[at : at + 4096])
            part = slice(ends[k], ends[k + 1])
            out[part] = logp[row[part] - at, target[part]]
        return out

    def __call__(self, key: np.ndarray) -> np.ndarray:
        own = np.unique(key)
        if len(self.key):
            at = np.minimum(np.searchsorted(self.key, own), len(self.key) - 1)
            own = own[self.key[at] != own]
        if len(own):
            if len(self.key) > _KNOWN:
                self.key, self.logp = np.zeros(0, np.uint64), np.zeros(0, np.float32)
                return self(key)
            both = np.concatenate([self.key, own])
            logp = np.concatenate([self.logp, self.compute(own)])
            order = np.argsort(both, kind="stable")
            self.key, self.logp = both[order], logp[order]
        return self.logp[np.searchsorted(self.key, key)]


def score(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_tokens, log_likelihood, mean_log_prob`` for every row.

    A null or empty text has no token, likelihood 0 and a null mean.  Repeated rows and ids stay;
    empty input gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    flat, shape = np.concatenate([x.ravel() for x in net.arrays]).astype(np.float32).tobytes(), [x.shape for x in net.arrays]
    radius, width = net.radius, net.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Network(radius, width, _unflat(flat, shape)))
        for batch in batches:
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            for found, owner, start in spans((t.as_py() for t in batch.column(1)), radius):
                np.add.at(total, owner, np.add.reduceat(scorer(found).astype(np.float64), start))
                np.add.at(n, owner, np.diff(np.append(start, len(found))))
            mean = [t / k if k else None for t, k in zip(total.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(total), pa.array(mean, pa.float64())], names=["id", "n_tokens", "log_likelihood", "mean_log_prob"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens bigint, log_likelihood double, mean_log_prob double")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, width: int = 32, **options) -> DataFrame:
    """Train on all texts of ``docs``, then score each of them."""
    if not 1 <= radius <= 3:
        raise ValueError("radius must be 1, 2 or 3")
    net = train(gather(docs, text_col, radius), radius, width, **options)
    return score(docs, net, id_col, text_col)
