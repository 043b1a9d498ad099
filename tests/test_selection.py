"""Medians by selection against sorting."""

import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillmark.operators import selection


@pytest.mark.parametrize("cells", [100, 4096])
def test_medians(spark, cells):
    rng = random.Random(cells)
    rows = [("whole", float(rng.randint(0, 9))) for _ in range(101)] + [("far", rng.choice([-1, 1]) * 10.0 ** rng.randint(-300, 300)) for _ in range(100)]
    rows += [("same", 7.5)] * 60 + [("one", -3.0), ("two", 1.0), ("two", 2.0), ("near", 1.0), ("near", 1.0 + 2**-52), ("near", 1.0 + 2**-51), (None, 4.0), (None, None), ("none", None)]
    rows += [("ends", float("inf")), ("ends", float("-inf")), ("ends", 5.0)] + [("normal", rng.gauss(0, 1)) for _ in range(500)]
    groups = defaultdict(list)
    for g, v in rows:
        if v is not None:
            groups[g].append(v)
    d = spark.createDataFrame(rows, "g string, v double").repartition(5).withColumn("low", F.lit("clash"))
    got = {r["g"]: r["m"] for r in selection.medians(d, ["g"], F.col("v"), "m", cells).collect()}
    assert got.keys() == groups.keys()
    assert all(m == pytest.approx(statistics.median(groups[g]), rel=1e-15) for g, m in got.items())
    assert selection.medians(d.limit(0), ["g"], F.col("v"), "m").count() == 0


def test_a_step_moves_counts_not_values(spark):
    d = spark.range(20_000).select(F.lit("hot").alias("g"), (F.col("id") * 1.5).alias("v"))
    assert selection.medians(d, ["g"], F.col("v"), "m", 64).collect()[0]["m"] == statistics.median(1.5 * i for i in range(20_000))
    joined = selection.with_median(spark.createDataFrame([("hot",), ("cold",), (None,)], "g string"), d, "g", F.col("v"), "m")
    assert {r["g"]: r["m"] is None for r in joined.collect()} == {"hot": False, "cold": True, None: True}
