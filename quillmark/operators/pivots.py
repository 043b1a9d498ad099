"""Exact nearest neighbours by cosine distance, with an index of pivots that spares comparisons.

Between vectors of length one, half the squared Euclidean distance is the cosine distance, so the triangle inequality holds bounds:
an item at distance r from a pivot is no nearer to a query at distance d from it than |d - r|, and an item whose nearest pivot
this is no nearer than half of d less the query's distance to its own nearest pivot.

1. Equal vectors of a tenant are one item that keeps its k smallest keys; more can't be among the k nearest.
2. Items are sorted by tenant, nearest pivot and distance to it, and cut into blocks that know their least and largest distance.
3. A query is compared with the most promising block of its nearest pivots' cells, whose k-th distance is then its bound.
4. It visits those other blocks whose bounds reach that distance. Each block meets its queries in one group, as two matrices.

Vectors that are far from each other in all directions leave little to spare, and then all blocks are visited; the answer is exact
either way. The pivots are the vectors of smallest hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.scratch import scratch

#: Pivots; items of a block; queries that meet a block in one group.
PIVOTS, BLOCK, GROUP = 128, 512, 4096
#: Digits of a distance; what lies within one unit of the last may tie.
DIGITS = 6


def _usable(v: Column) -> Column:
    """Whether a vector has a direction: not null, all numbers finite, not zero."""
    return F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def _space(v: Column) -> Column:
    """Tenant and number of dimensions: only vectors of the same space meet."""
    return F.concat(F.size(v).cast("string"), F.lit(":"), F.coalesce(F.concat(F.lit("="), F.col("tenant_id").cast("string")), F.lit("")))


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors of one length as unit rows."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(len(column), -1)
    m = m / np.abs(m).max(1, keepdims=True)  # else squares of very long vectors overflow
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Row numbers and vectors by number of dimensions."""
    sizes = np.diff(column.offsets.to_numpy())
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        yield rows, column.take(pa.array(rows))


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _assigned(pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the number of the nearest pivot and the distance; -1 and 0 where no pivot has as many dimensions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, r = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for rows, vectors in _by_length(b.column(1)):
                m = _matrix(vectors)
                if m.shape[1] in pivots:
                    numbers, p = pivots[m.shape[1]]
                    d = _apart(m, p)
                    pivot[rows], r[rows] = numbers[d.argmin(1)], d.min(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(r)], ["space", "v", "keys", "pivot", "r"])

    return run


def _blocks(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted items as rows of many: number, space, pivot, least and largest distance, how many keys, the keys and unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for b in batches:
            space, pivot, r = b.column(0).dictionary_encode().indices.to_numpy(), b.column(3).to_numpy(), b.column(4).to_numpy()
            new = np.flatnonzero((space[1:] != space[:-1]) | (pivot[1:] != pivot[:-1])) + 1
            edges = [0, *new.tolist(), b.num_rows]
            for low, high in zip(edges, edges[1:]):
                for a in range(low, high, size):
                    z = min(a + size, high)
                    keys = b.column(2).slice(a, z - a)
                    n = int(keys.value_lengths().sum().as_py())
                    of = [number, b.column(0)[a].as_py(), int(pivot[a]), float(r[a]), float(r[z - 1]), n, keys.to_pylist(), _matrix(b.column(1).slice(a, z - a)).tobytes()]
                    types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.list_(b.column(2).type), pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(of, types)], ["block", "space", "pivot", "low", "high", "n", "keys", "vectors"])
                    number += 1

    return run


def _to_pivots(pivots: dict[int, tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The distances of each query to all pivots of its number of dimensions, and to the nearest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for rows, vectors in _by_length(b.column(2)):
                m = _matrix(vectors)
                numbers, p = pivots.get(m.shape[1], (np.array([-1]), m[:1]))
                d = _apart(m, p)
                at = pa.array(np.repeat(rows, len(numbers)))
                columns = [b.column(0).take(at), b.column(1).take(at), pa.array(np.tile(numbers, len(rows)), pa.int32()), pa.array(d.ravel()), pa.array(np.repeat(d.min(1), len(numbers)))]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "space", "pivot", "d", "nearest"])

    return run


class Index:
    """Items (key, tenant_id, embedding) cut into blocks, for searches of up to k neighbours. Vectors without direction take no part."""

    def __init__(self, items: DataFrame, key: str, k: int, pivots: int = PIVOTS, block: int = BLOCK):
        self.spark, self.key, self.k = items.sparkSession, key, k
        self.key_type = dict(items.dtypes)[key]
        v = F.transform("embedding", lambda x: x.cast("double"))
        i = items.select(F.col(key).alias("_key"), "tenant_id", v.alias("v")).filter(_usable(F.col("v"))).withColumn("space", _space(F.col("v")))
        place = F.row_number().over(Window.partitionBy("space", "v").orderBy("_key"))
        i = i.withColumn("_place", place).filter(F.col("_place") <= k)  # limited before the shuffle
        items = self._written(i.groupBy("space", "v").agg(F.array_sort(F.collect_list("_key")).alias("keys")), "items")
        some = items.select("v").distinct().orderBy(F.xxhash64("v"), "v").limit(pivots).collect()
        by_length: dict[int, list] = {}
        for n, r in enumerate(some):
            by_length.setdefault(len(r["v"]), []).append((n, r["v"]))
        self.pivots = {n: (np.array([x for x, _ in rows], np.int32), _matrix(pa.array([x for _, x in rows], pa.list_(pa.float64())))) for n, rows in by_length.items()}
        assigned = items.select("space", "v", "keys").mapInArrow(_assigned(self.pivots), f"space string, v array<double>, keys array<{self.key_type}>, pivot int, r double")
        ordered = assigned.repartitionByRange("space", "pivot", "r").sortWithinPartitions("space", "pivot", "r")
        self.blocks = self._written(ordered.mapInArrow(_blocks(block), f"block long, space string, pivot int, low double, high double, n long, keys array<array<{self.key_type}>>, vectors binary"), "blocks")

    def _written(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch(self.spark, name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _compared(self, visits: DataFrame, queries: DataFrame) -> DataFrame:
        """(query_id, key, distance): of each visit (query_id, block) the k nearest items of the block."""
        k, groups = self.k, max(1, -(-self.n_queries // GROUP))
        part = F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int")
        asked = visits.select("query_id", "block").join(queries.select("query_id", "v"), "query_id").select("block", part.alias("part"), "query_id", "v")
        blocks = self.blocks.select("block", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("part"), "keys", "vectors")
        names = ["query_id", self.key, "distance"]

        def each(asked: pa.Table, block: pa.Table) -> pa.Table:
            ids, key_list = asked["query_id"].combine_chunks(), block["keys"]
            if not asked.num_rows or not block.num_rows:
                return pa.Table.from_arrays([ids.slice(0, 0), key_list.combine_chunks().flatten().flatten().slice(0, 0), pa.array([], pa.float64())], names)
            q = _matrix(asked["v"].combine_chunks())
            keys = key_list.combine_chunks().flatten()
            per = np.diff(keys.offsets.to_numpy())
            m = np.frombuffer(block["vectors"][0].as_py()).reshape(len(keys), -1)
            d = np.round(1 - q @ m.T, DIGITS)
            flat, owner = keys.flatten(), np.repeat(np.arange(len(keys)), per)
            values = flat.to_numpy(zero_copy_only=False)
            cut = np.sort(d, 1)[:, min(k, d.shape[1]) - 1]  # items that tie with the k-th may hold smaller keys
            row, item = np.nonzero(d[:, owner] <= cut[:, None])
            by = np.lexsort((values[item], d[row, owner[item]], row))
            row, item = row[by], item[by]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            row, item = row[nth < k], item[nth < k]
            return pa.Table.from_arrays([ids.take(pa.array(row)), flat.take(pa.array(item)), pa.array(d[row, owner[item]])], names)

        schema = f"query_id {dict(queries.dtypes)['query_id']}, {self.key} {self.key_type}, distance double"
        return asked.groupBy("block", "part").cogroup(blocks.groupBy("block", "part")).applyInArrow(lambda _, a, b: each(a.drop_columns(["block", "part"]), b.drop_columns(["block", "part"])), schema)

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, key, distance, rank) of queries (query_id, tenant_id, embedding): the k nearest, rank from 1, ties to the smaller key."""
        k, v = self.k, F.transform("embedding", lambda x: x.cast("double"))
        q = queries.select("query_id", "tenant_id", v.alias("v")).filter(_usable(F.col("v"))).withColumn("space", _space(F.col("v"))).select("query_id", "space", "v")
        q = self._written(q, "queries")
        self.n_queries = q.count()
        of = self.blocks.drop("keys", "vectors")
        cells = of.groupBy("space", "pivot").agg(F.min("low").alias("_low"), F.max("high").alias("_high"), F.sum("n").alias("_n"))
        to = q.mapInArrow(_to_pivots(self.pivots), f"query_id {dict(q.dtypes)['query_id']}, space string, pivot int, d double, nearest double").join(cells, ["space", "pivot"])
        before = F.coalesce(F.sum("_n").over(Window.partitionBy("query_id").orderBy("d", "pivot").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        bound = F.greatest(F.col("d") - F.col("high"), F.col("low") - F.col("d"), F.lit(0.0))
        seeds = to.withColumn("_before", before).filter(F.col("_before") < k).join(of, ["space", "pivot"])
        seeds = self._written(seeds.groupBy("query_id", "space", "pivot").agg(F.min_by("block", F.struct(bound, "block")).alias("block")).select("query_id", "block"), "seeds")
        first = self._written(self._compared(seeds, q), "first")
        kth = first.groupBy("query_id").agg(F.try_element_at(F.array_sort(F.collect_list("distance")), F.lit(k)).alias("kth"))
        within = F.sqrt(2 * (F.coalesce("kth", F.lit(2.0)) + 2 * 10.0**-DIGITS)) + 1e-7
        of_cell = F.greatest(F.col("d") - F.col("_high"), F.col("_low") - F.col("d"), (F.col("d") - F.col("nearest")) / 2)
        near = to.join(kth, "query_id", "left").withColumn("within", within).filter(of_cell <= F.col("within"))
        self.visits = near.join(of, ["space", "pivot"]).filter(bound <= F.col("within")).select("query_id", "block").join(seeds, ["query_id", "block"], "left_anti")
        found = first.unionByName(self._compared(self.visits, q))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", self.key))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def nearest(queries: DataFrame, items: DataFrame, key: str, k: int) -> DataFrame:
    """(query_id, key, distance, rank): the k nearest items (key, tenant_id, embedding) of each query's tenant (query_id, tenant_id, embedding).

    Exact, with distances of DIGITS digits; rank from 1, ties to the smaller key, fewer than k where a tenant has fewer.
    Vectors null, zero or holding null or non-finite numbers take no part; no tenant is one too; empty tables give no rows.
    """
    return Index(items, key, k).search(queries)
