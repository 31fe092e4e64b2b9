"""Vectors as whole numbers: floor(256 c) of every component, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import saved

SCALE = 256


def whole_vectors(rows: DataFrame, vector_col: str, most: float, squared: bool, **kept: Column) -> DataFrame:
    """The kept columns and x (array<long>) of the rows whose vector has components, all of them neither null nor non-finite, as a written
    table. Rows of another length than the most frequent one (of several the greatest) are dropped, and so are those with a component,
    or if squared is set a squared length, of most and more in size, which further sums could not hold."""
    vector = F.col(vector_col).cast("array<double>")
    finite = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)))
    given = rows.select(*[c.alias(n) for n, c in kept.items()], F.when(finite, vector).alias("_v")).where("_v is not null")
    scaled = F.transform("_v", lambda c: F.floor(c * float(SCALE)))
    size = lambda c: (c * float(SCALE)) * (c * float(SCALE)) if squared else F.abs(c * float(SCALE))
    reach = F.aggregate("_v", F.lit(0.0), lambda a, c: a + size(c) if squared else F.greatest(a, size(c)))
    found = saved(given.where(reach < most).select(*kept, scaled.alias("x")), "vectors")
    lengths = found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return found.where(F.size("x") == lengths["d"]) if lengths else found


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of int64."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0), np.int64)
