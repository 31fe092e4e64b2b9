"""What the operators of this subpackage share: reading tables and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def id_text(id_col: str) -> Column:
    """The id as text; a null id counts as empty."""
    return F.coalesce(F.col(id_col).cast("string"), F.lit(""))


def scratch_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder of spark.checkpoint.dir. Where that is unset (a local session) a temporary folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="riskloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def saved(df: DataFrame, what: str, **options: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that what follows neither recomputes it nor depends on the executors that made it."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_batches(batches: Iterable, id_col: int = 0, text_col: int = 1):
    """(ids, texts) of each Arrow batch; a null text counts as empty."""
    for batch in batches:
        yield batch.column(id_col), [t or "" for t in batch.column(text_col).to_pylist()]


def byte_slices(batches: Iterable[pa.RecordBatch], column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """Slices of the batches that hold at most limit bytes in the column, or a single row. Batches may be as large as they like."""
    for batch in batches:
        values = batch.column(column)
        ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(values), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
