"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def contract(df: DataFrame, column: str, tolerance: float = 1e-3) -> DataFrame:
    """One row: rows, least and largest dimension, rows off unit length, and whether the column keeps to one dimension and unit length."""
    v = doubles(F.col(column))
    off = F.count_if(F.abs(norm(v) - 1.0) > tolerance)
    stats = df.agg(F.count("*").alias("n"), F.min(F.size(column)).alias("min_dim"), F.max(F.size(column)).alias("max_dim"), off.alias("off_unit"))
    return stats.withColumn("holds", (F.col("min_dim") == F.col("max_dim")) & (F.col("off_unit") == 0))
