"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space (space, tab to carriage return) as a Java and RE2 class; a word is a run of anything else.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path below the folder that all executors share (spark.checkpoint.dir).

    Where the setting is absent, as in tests, a temporary folder takes its place; only a local session may do so.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quillmark-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words_of(text: Column) -> Column:
    """The words of a text, in order; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+", -1), "")


def of_smallest_hash(rows: DataFrame, column: str, n: int) -> DataFrame:
    """n rows, those of smallest hash; rows should be a written table, as it is counted first.

    Hashes are spread evenly, so those below 2 n / (number of rows) of their range hold the n smallest, and only they are
    sorted.
    """
    total = rows.count()
    h = F.xxhash64(column)
    if total > 4 * n:
        low = rows.filter(h < F.lit(-(2**63) + 2**65 * n // total))
        rows = low if low.count() >= n else rows
    return rows.orderBy(h, column).limit(n)


def running_start(df: DataFrame, group: list[str], chunk: str, order: list[str], length: str, out: str) -> DataFrame:
    """Adds out: the sum of length over the earlier rows of the group, in the order of chunk, then order.

    A large group is not sorted in one task: rows are summed within (group, chunk), and only one row per
    chunk takes part in the running sum over the group.
    """
    at = Window.partitionBy(*group, chunk)
    chunks = df.groupBy(*group, chunk).agg(F.sum(length).alias("_chunk_sum"))
    before = F.sum("_chunk_sum").over(Window.partitionBy(*group).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1))
    chunks = chunks.withColumn("_chunk_start", F.coalesce(before, F.lit(0))).drop("_chunk_sum")
    inside = F.sum(length).over(at.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    rows = df.withColumn("_inside", F.coalesce(inside, F.lit(0)))
    return rows.join(chunks, [*group, chunk]).withColumn(out, F.col("_inside") + F.col("_chunk_start")).drop("_inside", "_chunk_start")
