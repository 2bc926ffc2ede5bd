"""Where lineage is cut: the folder that the cluster names for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to ``spark.checkpoint.dir`` and read from there; a local master may use a temporary folder."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="talkloom-"))
    return df.checkpoint(eager=True)
