"""Vectors as fixed-width binary rows: cleaning, stacking, and random-hyperplane order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def finite_vectors(table: DataFrame) -> DataFrame:
    """row (a number of its own; store the table before it is used twice), vec_id and the vector as array<double>.

    Rows with a null vec_id or vector go, and so do vectors that hold a null or non-finite component. Rows that repeat a
    vec_id all stay. Other columns are ignored, whatever their names.
    """
    x = F.col("embedding").cast("array<double>")
    good = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    rows = table.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull()).where(good)


def clean_vectors(table: DataFrame) -> DataFrame:
    """finite_vectors with one row for each vec_id: of rows that repeat one the smallest vector stays."""
    return finite_vectors(table).groupBy("vec_id").agg(F.min("x").alias("x"))


def stack(column, width: int):
    """An Arrow column of list<double> as a matrix; shorter vectors are taken with zeros at their end."""
    import numpy as np

    out = np.zeros((len(column), width))
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    if len(flat) and (np.diff(ends) == width).all():
        return flat[ends[0] : ends[-1]].reshape(-1, width).copy()
    for k in range(len(column)):
        out[k, : ends[k + 1] - ends[k]] = flat[ends[k] : ends[k + 1]]
    return out
