"""SimHash near-duplicates by covering locality-sensitive hashing.

Seven structured bit masks over the 64 bits cover radius 2: bit ``i`` carries the vector
``v = i % 7 + 1`` of GF(2)^3 and mask ``a`` (1..7) keeps the bits with odd ``<a, v>``.  Two
vectors always leave a non-zero ``a`` orthogonal to both, so any two fingerprints that
differ in at most two bits agree under some mask: no pair is missed.

Distinct fingerprints that collide under a mask are verified in their bucket, which yields the
links of a spanning forest.  A bucket of over ``GROUP`` is not compared pair by pair: two values
differ in at most two bits exactly when some 64-bit value lies within one bit of both, so each of
its members emits itself and its 64 one-bit neighbours, and equal values link to their smallest
member.  At most 65 fingerprints can meet in such a value.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import components, cut

SEED = 42
MASKS = [sum(1 << i for i in range(64) if bin(a & (i % 7 + 1)).count("1") % 2) for a in range(1, 8)]
_CHUNK = 1 << 16
#: Fingerprints that a bucket may hold to be compared with one another.
GROUP = 64


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def fingerprint(text: str | None, size: int = 3) -> int:
    """Unsigned SimHash of the word shingles of ``text``; zero if it has no word."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode("utf-8").lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    if len(words) < size:
        return xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - size + 1
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, _CHUNK):
        part = words[at : at + _CHUNK + size - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(size)), strict=False))
        hashes = np.fromiter(map(xxh64_intdigest, shingles, repeat(SEED)), dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << i for i in range(64) if 2 * counts[i] > n)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """``(id, fp)`` for every row, ``fp`` the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [signed(fingerprint(t.as_py(), size)) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp bigint")


def forest(values: np.ndarray) -> list[tuple[int, int]]:
    """Links (value, head) that connect the values within two bits of one another, each head smaller."""
    values = np.sort(values)
    bits = values.view(np.uint64)
    left, right = np.nonzero(np.triu(np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 2, 1))
    head = list(range(len(values)))

    def top(k: int) -> int:
        while head[k] != k:
            k = head[k]
        return k

    for a, b in zip(left.tolist(), right.tolist(), strict=True):
        a, b = sorted((top(a), top(b)))
        head[b] = a
    return [(int(values[k]), int(values[top(k)])) for k in range(len(values)) if top(k) != k]


def links(nodes: DataFrame, group: int = GROUP) -> DataFrame:
    """Links ``(fp, head)`` that connect all fingerprints within two bits of one another.

    ``nodes`` has distinct ``fp``.  Rows grow as 7 a node, and 65 for each in a bucket of over ``group``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [x for bucket in batch.column(0) for x in forest(np.array(bucket.as_py(), np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["fp", "head"])

    tables = nodes.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key")) for k, m in enumerate(MASKS)])).alias("t")).select("fp", "t.*")
    sizes = tables.groupBy("k", "key").agg(F.count("*").alias("size")).where("size > 1")
    met = cut(tables.join(sizes, ["k", "key"]))
    buckets = met.where(F.col("size") <= group).groupBy("k", "key").agg(F.collect_list("fp").alias("bucket"))
    small = buckets.select("bucket").mapInArrow(run, "fp bigint, head bigint")
    members = met.where(F.col("size") > group).select("fp").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)])
    halfway = members.select("fp", F.explode(near).alias("z"))
    heads = halfway.select("fp", F.min("fp").over(Window.partitionBy("z")).alias("head"))
    return small.unionByName(heads.where("fp <> head")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3) -> DataFrame:
    """One row per document: ``id, fp, component_id`` (the smallest id reachable, its own included).

    Null and wordless texts have fingerprint zero and link like any other.  Repeated rows and
    ids stay.  A null id is never a component_id unless its component has no other id.  Empty input gives no rows; other columns
    are ignored.
    """
    fps = cut(fingerprints(docs, id_col, text_col, size))
    nodes = cut(fps.groupBy("fp").agg(F.min("id").alias("first")))
    label = components(links(nodes), "fp", "head").withColumnRenamed("node", "fp")
    known = nodes.join(label, "fp", "left").select("fp", "first", F.coalesce("label", "fp").alias("label"))
    least = known.groupBy("label").agg(F.min("first").alias("component_id"))
    owner = known.join(least, "label").select("fp", "component_id")
    return fps.join(owner, "fp").select("id", "fp", "component_id")
