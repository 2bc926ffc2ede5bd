"""Near-duplicate documents by the Jaccard similarity of their word shingles, greedily and without pair lists.

Candidates share a key: one of seven covering SimHash masks, or one of 32 bands of six min-hashes.
At similarity 0.8 a pair shares no band with probability ``(1 - 0.8^6)^32 = 6e-5``, at 0.9 below
1e-10.  The share of equal min-hashes, of which a byte each is at hand, rules out candidates seven
deviations below the similarity; the others are verified on the whole shingle sets.

In id order a document goes if it reaches the similarity with one that stays.  The candidates of a key
of up to ``GROUP`` documents are found in its bucket and verified once; each verified link is from
then on a key of its own.  Of a larger key the first ``FRONT`` undecided documents are compared with one
another, so in a round a document stays if it is in the fronts of all its larger keys and the first
of all its links.  The documents behind the front are compared, in parts of ``FRONT``, with those of
the front that stay; those unlike all of them move up in the next round.  So a group of copies, however
large, goes in one round, and a group of unlike documents loses a whole front a round.  A key with
one undecided document left says nothing more and is forgotten.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import simhash
from .common import forget, kept, sieve, sifted
from .substring_dedup import mix, word_hashes

BANDS = 32
ROWS = 6
#: Documents that a key may hold to be compared with one another.
GROUP = 32
#: Documents of a larger key that are compared with one another in a round, and with so many others in a task.
FRONT = 128
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array(simhash.MASKS, dtype=np.uint64)
_COLUMNS = 4096  # of an incidence matrix
_BLOCK = 512  # shingles times factors that stay in a processor's cache
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * _ODD) | np.uint64(1)


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct hashes of the ``size``-word shingles; of all words if there are fewer."""
    words = word_hashes(text)
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = out * _ODD + words[k : k + n]
    return np.unique(mix(out))


def keys_of(found: np.ndarray, fp: int) -> tuple[np.ndarray, bytes]:
    """Keys of a shingle set, and a byte of each of its min-hashes."""
    low = np.zeros(len(_FACTORS), np.uint64)
    for at in range(0, len(found), _BLOCK):
        part = np.multiply.outer(_FACTORS, found[at : at + _BLOCK]).min(axis=1)
        low = np.minimum(low, part) if at else part
    rows, band = low.reshape(BANDS, ROWS), np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(ROWS):
        band = mix(band * _ODD + rows[:, k])
    masked = mix(mix(_MASKS & np.uint64(fp)) + np.arange(BANDS + 1, BANDS + 8, dtype=np.uint64))
    return np.unique(np.concatenate([band, masked])).view(np.int64), (mix(low) & np.uint64(255)).astype(np.uint8).tobytes()


def row_order(id_col: str, text_col: str) -> Column:
    """A number for a row that orders by id, null last, then by a hash of its text."""
    id_ = F.coalesce(F.col(id_col).cast("bigint").cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(19,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)"))
    text = F.pmod(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), F.lit(1 << 59)).cast("decimal(18,0)")
    return (id_.cast("decimal(20,0)") * F.lit(str(1 << 59)).cast("decimal(18,0)") + text).cast("decimal(38,0)")


def _nodes(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """``ord, digest, n, sign, keys`` of every row: of its shingle set the digest, the size, and what ``keys_of`` gives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digest, n, sign, keys = [], [], [], []
            for t in batch.column(1):
                text = t.as_py()
                found = shingle_set(text, size)
                digest.append(int(mix(np.bitwise_xor.reduce(mix(found + _ODD), keepdims=True) + np.uint64(len(found)))[0].view(np.int64)))
                n.append(len(found))
                own, low = keys_of(found, simhash.fingerprint(text, size))
                keys.append(own)
                sign.append(low)
            columns = [batch.column(0), pa.array(digest, pa.int64()), pa.array(n, pa.int32()), pa.array(sign, pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["ord", "digest", "n", "sign", "keys"])

    return docs.select("__ord", text_col).mapInArrow(run, "ord decimal(38,0), digest bigint, n int, sign binary, keys array<bigint>")


def _sets(docs: DataFrame, text_col: str, size: int) -> DataFrame:
    """``ord, shingles``; four bytes of each hash, which blurs a similarity by less than 1e-5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_set(t.as_py(), size).astype(np.uint32)).tobytes() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["ord", "shingles"])

    return docs.select("__ord", text_col).mapInArrow(run, "ord decimal(38,0), shingles binary")


def _chosen(pairs: DataFrame, a: str, b: str, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """``ord, low`` of the pairs whose binary columns ``a`` and ``b`` pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hit = pa.array([test(x.as_py(), y.as_py()) for x, y in zip(batch.column(2), batch.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(hit), batch.column(1).filter(hit)], names=["ord", "low"])

    return pairs.select("ord", "low", a, b).mapInArrow(run, "ord decimal(38,0), low decimal(38,0)")


def _least(similarity: float) -> float:
    """The share of equal min-hashes below which a pair cannot reach the similarity, but for chance seven deviations off."""
    return similarity - 7 * (similarity * (1 - similarity) / len(_FACTORS)) ** 0.5


def _in_buckets(met: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """``ord, low`` of the likely pairs that share one of the small keys (``met``: ord, key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: set[tuple] = set()
            for bucket in batch.column(0).to_pylist():
                sign = np.frombuffer(b"".join(x["sign"] for x in bucket), np.uint8).reshape(len(bucket), -1)
                n = np.array([x["n"] for x in bucket])
                for k in range(1, len(bucket)):  # sorted by ord
                    likely = (sign[:k] == sign[k]).mean(axis=1) >= _least(similarity)
                    likely &= np.minimum(n[:k], n[k]) >= similarity * np.maximum(n[:k], n[k])
                    out.update((bucket[k]["ord"], bucket[j]["ord"]) for j in np.flatnonzero(likely).tolist())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.decimal128(38, 0)) for k in (0, 1)], names=["ord", "low"])

    member = F.struct("ord", "n", "sign")
    buckets = met.join(nodes.select("ord", "n", "sign"), "ord").groupBy("key").agg(F.array_sort(F.collect_list(member)).alias("bucket"))
    return buckets.select("bucket").mapInArrow(run, "ord decimal(38,0), low decimal(38,0)").distinct()


def _places(sets: list[np.ndarray], values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which set holds which of the sorted ``values``: numbers of sets, and of values in order."""
    owner, each = np.repeat(np.arange(len(sets)), [len(x) for x in sets]), np.concatenate(sets)
    at = np.searchsorted(values, each)
    hit = values[np.minimum(at, len(values) - 1)] == each
    owner, at = owner[hit], at[hit]
    order = np.argsort(at, kind="stable")
    return owner[order], at[order]


def overlaps(a: list[np.ndarray], b: list[np.ndarray] | None = None) -> np.ndarray:
    """Sizes of the intersections of sets ``a`` with sets ``b``, or with one another, as products of incidence matrices."""
    if b is None:
        values, n = np.unique(np.concatenate(a), return_counts=True)
        values, b = values[n > 1], a
    else:
        values = np.intersect1d(np.concatenate(a), np.concatenate(b))
    out = np.zeros((len(a), len(b)), np.float64)
    if not len(values):
        return out
    sides = [(len(x), *_places(x, values)) for x in (a, b)]
    for start in range(0, len(values), _COLUMNS):
        parts = []
        for n, owner, at in sides:
            lo, hi = np.searchsorted(at, (start, start + _COLUMNS))
            part = np.zeros((n, _COLUMNS), np.float32)
            part[owner[lo:hi], at[lo:hi] - start] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _compared(members: DataFrame, by: list[str], similarity: float) -> DataFrame:
    """``ord, low`` of the pairs that reach the similarity: in a group of heads alone, all; else of heads with the others.

    ``members``: ``ord, head, shingles`` and the columns ``by``, which tell the groups.
    """

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("ord")
        sets, ords = [np.frombuffer(x.as_py(), np.uint32) for x in group["shingles"]], group["ord"].combine_chunks()
        head = np.array(group["head"].to_pylist())
        low, high = np.flatnonzero(head), np.flatnonzero(~head)
        if not len(low):
            return pa.table({"ord": ords.slice(0, 0), "low": ords.slice(0, 0)})
        alone, size = not len(high), np.array([len(x) for x in sets])
        both = overlaps([sets[k] for k in low], None if alone else [sets[k] for k in high])
        high = low if alone else high
        near = both >= similarity * (size[low][:, None] + size[high][None, :] - both)
        x, y = np.nonzero(np.triu(near, 1) if alone else near)
        return pa.table({"ord": ords.take(pa.array(high[y])), "low": ords.take(pa.array(low[x]))})

    return members.groupBy(*by).applyInArrow(run, "ord decimal(38,0), low decimal(38,0)")


def _alike(likely: DataFrame, docs: DataFrame, text_col: str, size: int, similarity: float) -> DataFrame:
    """``ord, low`` of the pairs whose shingle sets reach the similarity."""

    def near(x: bytes, y: bytes) -> bool:
        a, b = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        both = len(np.intersect1d(a, b, assume_unique=True))
        return both >= similarity * (len(a) + len(b) - both)

    close, path = kept(likely, "near-close")
    wanted = close.select("ord").unionByName(close.select(F.col("low").alias("ord"))).distinct()
    some = sifted(docs.select("__ord", text_col), "__ord", sieve(wanted.withColumnRenamed("ord", "__ord"), "__ord")).where("__maybe")
    # Rows of one id and one text are the same row here.
    sets = _sets(some, text_col, size).join(wanted, "ord", "left_semi").dropDuplicates(["ord"])
    both = close.join(sets.withColumnRenamed("ord", "low").withColumnRenamed("shingles", "other"), "low").join(sets, "ord")
    hits, _ = kept(_chosen(both, "shingles", "other", near), "near-hits")
    forget(docs.sparkSession, path)
    return hits


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` without the rows that reach ``similarity`` with one that stays and comes before.

    Rows that share an id, or have none, are judged by their texts like any other; of equal rows, and
    of wordless texts, the first stays.  Ids are integers.  Empty input gives no rows; other columns pass through.
    """
    spark, columns = docs.sparkSession, docs.columns
    docs = docs.withColumn("__ord", row_order(id_col, text_col))
    first = F.min_by(F.struct("ord", "n", "sign", "keys"), "ord").alias("r")
    nodes, _ = kept(_nodes(docs, text_col, size).groupBy("digest").agg(first).select("r.*"), "near-nodes")
    by_key = nodes.select("ord", F.explode("keys").alias("key"))

    own = F.xxhash64("ord", "low")

    def met(rows: DataFrame) -> tuple[DataFrame, str]:
        """The rows whose key has two or more, with that number."""
        sizes = rows.groupBy("sure", "key").agg(F.count("*").alias("size")).where("size > 1")
        return kept(rows.join(sizes, ["sure", "key"]), "near-left")

    left, path = met(by_key.withColumn("sure", F.lit(False)))

    def with_links(others: DataFrame, links: DataFrame) -> tuple[DataFrame, str]:
        ends = links.select("ord", own.alias("key")).unionByName(links.select(F.col("low").alias("ord"), own.alias("key")))
        found = met(others.select("ord", "key", "sure").unionByName(ends.withColumn("sure", F.lit(True))).distinct())
        forget(spark, path)
        return found

    # Small keys turn into their verified links.
    few = left.where(F.col("size") <= GROUP).select("ord", "key")
    links = _alike(_in_buckets(few, nodes, similarity), docs, text_col, size, similarity)
    left, path = with_links(left.where(F.col("size") > GROUP), links)
    wide = left.where("not sure").select("ord").distinct()
    some = sifted(docs.select("__ord", text_col), "__ord", sieve(wide, "ord")).where("__maybe")
    sets, held = kept(_sets(some, text_col, size).join(wide, "ord", "left_semi").dropDuplicates(["ord"]), "near-sets")
    gone = nodes.select("ord").where("false")
    # Only so many rows of a key leave a task: the limit by rank is applied before the shuffle, too.
    rank = F.row_number().over(Window.partitionBy("key").orderBy("ord"))
    while not left.isEmpty():
        unsure = not left.where("not sure").isEmpty()
        front, front_path = kept(left.where("not sure").select("key", "ord").withColumn("rank", rank).where(F.col("rank") <= FRONT).select("key", "ord"), "near-front")
        if unsure:
            links, old = kept(_compared(front.join(sets, "ord").withColumn("head", F.lit(True)), ["key"], similarity).distinct(), "near-links")
            left, path = with_links(left, links)
            forget(spark, old)
        low = left.where("sure").groupBy("key").agg(F.min("ord").alias("low"))
        sure = left.where("sure").select("key", "ord").join(low, "key")
        first = sure.select("ord", (F.col("ord") == F.col("low")).alias("s"))
        ahead = left.where("not sure").select("key", "ord").join(front.withColumn("s", F.lit(True)), ["key", "ord"], "left").select("ord", F.coalesce("s", F.lit(False)).alias("s"))
        stays, stays_path = kept(first.unionByName(ahead).groupBy("ord").agg(F.bool_and("s").alias("s")).where("s").select("ord"), "near-stays")
        hits, _ = kept(sure.where("ord <> low").join(stays.withColumnRenamed("ord", "low"), "low", "left_semi").select("ord").distinct(), "near-hits")
        if unsure:
            rows = left.where("not sure").select("key", "ord", F.ceil(F.col("size") / FRONT).cast("int").alias("parts"))
            behind = rows.join(front, ["key", "ord"], "left_anti").join(hits, "ord", "left_anti")
            behind = behind.select("key", "ord", F.pmod(F.xxhash64("ord"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("head"))
            heads = rows.where("parts > 1").join(stays, "ord", "left_semi")
            heads = heads.select("key", "ord", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("head"))
            met_heads = _compared(behind.unionByName(heads).join(sets, "ord"), ["key", "part"], similarity)
            more, _ = kept(met_heads.join(stays.withColumnRenamed("ord", "low"), "low", "left_semi").join(stays, "ord", "left_anti").select("ord").distinct(), "near-hits")
            hits = hits.unionByName(more).distinct()
        gone = gone.unionByName(hits)
        done = hits.unionByName(stays)
        rest, old = left.join(done, "ord", "left_anti").select("ord", "key", "sure"), path
        left, path = met(rest)
        for used in (old, front_path, stays_path):
            forget(spark, used)
    forget(spark, held)
    staying = nodes.select(F.col("ord").alias("__ord")).join(gone.withColumnRenamed("ord", "__ord"), "__ord", "left_anti")
    return docs.join(staying, "__ord", "left_semi").dropDuplicates(["__ord"]).select(*[F.col(f"`{c}`") for c in columns])
