"""Exact medians by distributed selection, without a group's values in one place.

The rank that is sought lies between the least and the largest value of its group. That range is cut into cells of equal width,
of logarithms while it spans more than a factor of e, rows are counted by cell, and the range shrinks to the values of the cell that
holds the rank, until it is one value. A step moves one row per group, task and cell; a group of any size and spread takes few
steps, as each makes its range thousands of times narrower. Only the order of cells counts, and both scales keep it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.scratch import scratch

CELLS, LARGEST = 4096, 1.7976931348623157e308


def _scaled(v: Column) -> Column:
    """Signed logarithms, which keep the order of all numbers."""
    return F.when(v > 0, 800 + F.log(v)).when(v < 0, -800 - F.log(-v)).otherwise(0.0)


def medians(rows: DataFrame, by: list[str], value: Column, name: str, cells: int = CELLS) -> DataFrame:
    """(by, name): the median of a number in each group, the mean of the middle two where they are two.

    Null values don't count, and a group without others has no row; a null group is one too. NaN and infinity count as the
    largest number there is. Equal values, however many, are one cell. An empty table gives no rows.
    """
    spark = rows.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = scratch(spark, "medians")
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    number = value.cast("double")
    bounded = F.when(F.isnan(number), LARGEST).otherwise(F.greatest(F.least(number, F.lit(LARGEST)), F.lit(-LARGEST)))
    group = F.to_json(F.struct(*by), {"ignoreNullFields": "false"})
    v = written(rows.filter(number.isNotNull()).select(*by, group.alias("_group"), bounded.alias("_v")))
    groups = v.groupBy("_group").agg(*(F.first(c).alias(c) for c in by), F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
    sought = F.explode(F.array(F.struct(F.lit(0).alias("which"), F.floor((F.col("n") - 1) / 2).alias("rank")), F.struct(F.lit(1).alias("which"), F.floor(F.col("n") / 2).alias("rank"))))
    groups = written(groups)
    state = written(groups.select("_group", sought.alias("s"), "low", "high").select("_group", "s.which", "s.rank", "low", "high"))
    while (wide := state.filter("low < high")).head(1):
        inside = v.join(wide, "_group").filter(F.col("_v").between(F.col("low"), F.col("high")))
        low, high = _scaled(F.col("low")), _scaled(F.col("high"))
        even = (F.col("_v") / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
        share = F.when(high - low > 1, (_scaled(F.col("_v")) - low) / (high - low)).otherwise(even)  # grows with the value, from 0 to 1
        counted = inside.groupBy("_group", "which", "rank", F.least(F.floor(share * cells), F.lit(cells - 1)).alias("cell")).agg(F.count("*").alias("n"), F.min("_v").alias("low"), F.max("_v").alias("high"))
        upto = F.sum("n").over(Window.partitionBy("_group", "which").orderBy("cell"))
        held = counted.withColumn("before", upto - F.col("n")).filter((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("before") + F.col("n")))
        narrowed = held.select("_group", "which", (F.col("rank") - F.col("before")).alias("rank"), "low", "high")
        state = written(state.filter("low = high").unionByName(narrowed))
    middle = state.groupBy("_group").agg(F.sum(F.col("low") * 0.5).alias(name))
    return groups.select("_group", *by).join(middle, "_group").drop("_group")


def with_median(grouped: DataFrame, rows: DataFrame, by: str, value: Column, name: str) -> DataFrame:
    """grouped, one row per value of `by`, with the median of rows by the same column; null where there is none."""
    m = medians(rows, [by], value, name).withColumnRenamed(by, "_by")
    return grouped.join(m, grouped[by].eqNullSafe(F.col("_by")), "left").drop("_by")
