"""The index of pivots against comparison with all."""

from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.operators import pivots

SCHEMA = "chunk_id long, tenant_id string, embedding array<float>"


def clustered(rng, n, dim, clusters):
    return (rng.normal(size=(clusters, dim))[rng.integers(0, clusters, n)] + 0.05 * rng.normal(size=(n, dim))).astype(np.float32)


def expected(rows, queries, k):
    """By tenant and number of dimensions, over rows with a direction; distances of six digits, ties to the smaller id."""
    fine = lambda v: v is not None and None not in v and np.isfinite(v).all() and np.any(v)
    groups, out = defaultdict(list), {}
    for i, t, v in rows:
        if fine(v):
            groups[t, len(v)].append((i, np.array(v, np.float32).astype(float)))
    for i, t, v in queries:
        if not fine(v) or not groups[t, len(v)]:
            continue
        ids, x = np.array([g[0] for g in groups[t, len(v)]]), np.array([g[1] for g in groups[t, len(v)]])
        q = np.array(v, np.float32).astype(float)
        scale = lambda m: m / np.abs(m).max(-1, keepdims=True)
        x, q = scale(x), scale(q)
        d = np.round(1 - x @ q / np.linalg.norm(x, axis=1) / np.linalg.norm(q), 6)
        by = np.lexsort((ids, d))[:k]
        out[i] = [(int(ids[j]), float(d[j])) for j in by]
    return out


def found(spark, rows, queries, k, **of):
    items = spark.createDataFrame(rows, SCHEMA).repartition(5).withColumn("space", F.lit("clash"))
    asked = spark.createDataFrame(queries, SCHEMA.replace("chunk_id", "query_id"))
    index = pivots.Index(items, "chunk_id", k, **of)
    got = defaultdict(list)
    for r in index.search(asked).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["chunk_id"], r["distance"]))
        assert r["rank"] == len(got[r["query_id"]])
    return got, index


@pytest.mark.parametrize("kind", ["random", "clustered"])
def test_nearest_is_exact(spark, kind):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8)).astype(np.float32) if kind == "random" else clustered(rng, 600, 8, 15)
    x[200:260] = x[100]  # copies
    x[300] = x[301] * 1e18
    rows = [(i, f"t{i % 3}" if i % 50 else None, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, "t0", None), (1001, "t0", [0.0] * 8), (1002, "t0", [float("nan")] * 8), (1003, "t0", [None] * 8), (1004, "t0", [1.0, 0.0]), (1005, "t0", []), (1006, "only", [1.0] * 8), (1007, "t1", [float("inf")] * 8)]
    queries = [r for r in rows if r[0] % 30 == 0 or r[0] >= 1000]
    got, _ = found(spark, rows, queries, 7, pivots=12, block=16)
    assert got == expected(rows, queries, 7)
    empty = spark.createDataFrame([], SCHEMA)
    assert pivots.nearest(empty.withColumnRenamed("chunk_id", "query_id"), empty, "chunk_id", 3).count() == 0


def test_many_queries_meet_a_block_in_groups(spark, monkeypatch):
    monkeypatch.setattr(pivots, "GROUP", 10)
    rows = [(i, "t", [float(v) for v in r]) for i, r in enumerate(clustered(np.random.default_rng(3), 200, 4, 5))]
    got, _ = found(spark, rows, rows, 3, pivots=8, block=32)
    assert got == expected(rows, rows, 3)


def test_comparisons_grow_slower_than_the_table(spark):
    """Four times the clusters: a query visits few more items, as most cells lie beyond its bound."""
    visited = {}
    for clusters in (20, 80):
        rng = np.random.default_rng(1)
        rows = [(i, "t", [float(v) for v in r]) for i, r in enumerate(clustered(rng, 60 * clusters, 16, clusters))]
        queries = rows[::100]
        got, index = found(spark, rows, queries, 5, pivots=100, block=16)
        assert got == expected(rows, queries, 5)
        visited[clusters] = index.visits.join(index.blocks, "block").agg(F.sum("n")).first()[0] / len(queries)
    assert visited[80] < 2 * visited[20] and visited[80] < 0.15 * 60 * 80


def test_a_tenant_is_no_task(spark):
    """Blocks of one tenant, and of one cell, are cut to their size."""
    rows = [(i, "t", [1.0, i / 1000]) for i in range(2000)]
    index = pivots.Index(spark.createDataFrame(rows, SCHEMA), "chunk_id", 2, pivots=1, block=64)
    assert index.blocks.agg(F.max("n")).first()[0] <= 64 and index.blocks.count() >= 2000 / 64
