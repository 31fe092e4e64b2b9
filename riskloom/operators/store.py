"""Appending to stored tables so that a run that is repeated leaves one copy, and views of what was appended last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_run(rows: DataFrame, path: str, run: str = "run_id") -> None:
    """Adds the rows to the table of the folder path, a partition for each run. A run that is there already is replaced by its new rows, and
    other runs stay as they are; a null run is one of its own. An empty frame changes nothing."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(run).parquet(path)


def read_runs(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The table of the folder path, with the columns of like."""
    return spark.read.schema(like.schema).parquet(path).select(*like.columns)


def write_snapshot(rows: DataFrame, path: str) -> bool:
    """Writes the rows as JSON, nested as they are, a file for each partition; nothing is written where there are no rows. Whether it wrote."""
    if rows.isEmpty():
        return False
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    return True


def load_snapshot(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """The rows of a snapshot, with the schema of like; what can't be read so is null."""
    return spark.read.schema(like.schema).json(path, mode="PERMISSIVE")


def latest(rows: DataFrame, keys: list[str], run: str = "run_id") -> DataFrame:
    """Of each key the rows of its last run. The last runs are found first, so no key's rows are gathered."""
    last = rows.groupBy(*keys).agg(F.max(run).alias(run))
    return rows.join(last, [*keys, run], "left_semi")
