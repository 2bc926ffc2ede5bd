"""Helpers that several operators share: lineage cuts and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here, as a regular-expression class.
WHITE = r"[\x20\x09-\x0D]"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local master (tests) may fall back to a temporary folder; a cluster that
    names none is refused, because executors do not share local disks.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local") and not sc.master.startswith("local-cluster"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="talkloom-ckpt-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder and drop its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as Parquet in the shared checkpoint folder, smaller there than a checkpoint, and its path."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def forget(spark: SparkSession, path: str) -> None:
    """Delete what ``kept`` wrote, once nothing reads it any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """Inside, what a step has shuffled is deleted when it ends, not when the driver happens to collect its garbage.

    This holds for ``cut``, ``kept`` and other actions on DataFrames made inside; a plan that is handed on should be put together outside.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def _signature(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Connected components of an undirected graph: ``(node, label)``, label the smallest node.

    Alternates large-star and small-star (Kiveris et al., 2014) until the edges are stars.
    Every step is an aggregate with partial combining and a join against one row per node,
    so a star with very many leaves is split by adaptive skew handling; nothing is gathered
    on the driver but a count and a checksum.  Nodes without an edge do not appear.  Nulls and
    self-loops are ignored.
    """
    e = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a > b").distinct()
    e = cut(e)
    seen = _signature(e)
    while seen[0]:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e = cut(moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct())
        now = _signature(e)
        if now == seen:
            break
        seen = now
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return leaves.unionByName(roots)


_BITS = 1 << 15  # of one bitmap row


def sieve(keys: DataFrame, key: str, most: int = 4096) -> DataFrame:
    """A bitmap over hashes of ``key``: ``bucket, bits``, about eight bits a row of ``keys``.

    It has ``most`` rows of 4 KB at most, 16 MB, whatever the keys, so it may be broadcast.  Beyond
    some 16 million keys it lets more through; it never holds back what it should pass.
    """
    n = keys.count()
    buckets = 1
    while buckets < most and buckets * _BITS < 8 * n:
        buckets *= 2
    h = F.pmod(F.xxhash64(key), F.lit(buckets * _BITS))
    rows = keys.select(F.floor(h / _BITS).alias("bucket"), (h % _BITS).alias("at"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits")).withColumn("buckets", F.lit(buckets))


def sifted(df: DataFrame, key: str, bitmap: DataFrame, into: str = "__maybe") -> DataFrame:
    """``df`` with a boolean: false only where ``key`` is surely none of the sieve's keys."""
    buckets = bitmap.select("buckets").limit(1).collect()
    if not buckets:
        return df.withColumn(into, F.lit(False))
    h = F.pmod(F.xxhash64(key), F.lit(buckets[0]["buckets"] * _BITS))
    hashed = df.withColumn("__h", h).withColumn("bucket", F.floor(F.col("__h") / _BITS))
    both = hashed.join(F.broadcast(bitmap.drop("buckets")), "bucket", "left")
    place = (F.col("__h") % _BITS).cast("int")
    byte = F.conv(F.hex(F.substring("bits", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.floor(byte / F.pow(F.lit(2), place % 8)).cast("int") % 2
    return both.withColumn(into, F.coalesce(bit == 1, F.lit(False))).drop("__h", "bucket", "bits")
