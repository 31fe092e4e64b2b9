"""Cutting the lineage of iterated plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder of spark.checkpoint.dir; where that is unset (a local session) a temporary folder is set, which goes when the session's process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        root = "file://" + folder
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/plan-{uuid.uuid4().hex}"


def saved(df: DataFrame) -> DataFrame:
    """df written to a scratch path and read back."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over all shuffle partitions. Adaptive plans join small partitions, however much work their rows make; these they leave."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def counted(df: DataFrame, **counts: Column) -> tuple[DataFrame, dict]:
    """As saved, with counts (aggregates of df's columns) taken in the pass that writes; a task that is tried again counts once."""
    seen = Observation()
    return saved(df.observe(seen, *[c.alias(n) for n, c in counts.items()])), seen.get
