"""Approximate nearest neighbours by inner product: robust-pruned directed graphs, one for each shard.

Every valid vector is indexed. Equal vectors form one node that keeps its smallest ids, one more than are asked for, so no
answer is lost to a group of copies of any size. Nodes are dealt into tiers of about equal length, and by hash into
shards of bounded size within them. A shard's graph is built in one task: nodes are inserted in batches of growing size; a
greedy search in the present graph proposes neighbours, relaxed distance pruning (alpha) keeps edges in different
directions, and reverse edges are pruned alike. Searches start at the shard's middle, and at one node of every part of the
graph that can't be reached from there. Every block of queries searches every shard with a beam; the best of all shards are
merged by a window.

Within a shard vectors are scaled to a length of at most 1 and get one more component that makes their lengths equal, so
the nearest by angle and by inner product agree, and distances keep their digits however long other shards' vectors are.
Recall is measured in every search task: some of its queries are also compared with all vectors of the shard, and the beam
is doubled until GOAL of their nearest are found; where that takes half the shard, the block is compared with the whole
shard, which is exact. Scores are inner products of the original vectors in double precision.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import table, written

K, DEGREE, BEAM_BUILD, BEAM, ALPHA = 20, 32, 64, 100, 1.2
SHARD_ROWS, QUERY_ROWS, BATCH, WIDE = 8192, 16_384, 1024, 4
#: Lengths of one tier differ by at most this factor.
TIER = 1.25
#: Recall on PROBES queries of a task below which its beam is doubled.
GOAL, PROBES = 0.95, 48


def _lifted(x: np.ndarray) -> np.ndarray:
    """x scaled to lengths of at most 1, with a component that makes all of them 1."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max()
    n = (x**2).sum(1)
    return np.hstack([x / np.sqrt(n.max()), np.sqrt(np.maximum(1 - n / n.max(), 0))[:, None]]).astype(np.float32)


def beam_search(x: np.ndarray, near: np.ndarray, starts: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and similarities of the beam for each query, best first; -1 fills up. near: neighbours by node, -1 for none."""
    n, b = len(x), len(q)
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    begin = q @ x[starts].T
    order = np.argsort(-begin, axis=1)[:, :beam]
    ids[:, : order.shape[1]], sims[:, : order.shape[1]] = starts[order], np.take_along_axis(begin, order, 1)
    done = np.zeros((b, beam), bool)
    seen = np.zeros((b, n + 1), bool)  # the last column stands for -1
    seen[:, starts], seen[:, n] = True, True
    active = np.arange(b)
    while len(active):
        i, s = ids[active], sims[active]
        score = np.where(done[active] | (i < 0), -np.inf, s)
        pick = np.argpartition(-score, min(WIDE, beam - 1), axis=1)[:, :WIDE]
        value = np.take_along_axis(score, pick, 1)
        live = value[:, :].max(1) > -np.inf
        active, i, s, pick, value = active[live], i[live], s[live], pick[live], value[live]
        if not len(active):
            break
        rows = np.arange(len(active))[:, None]
        d = done[active]
        d[rows, pick] = True
        nodes = np.where(value > -np.inf, i[rows, pick], -1)
        new = np.where(nodes[:, :, None] >= 0, near[nodes], -1).reshape(len(active), -1)
        at = np.sort(new, axis=1)
        again = np.zeros_like(at, bool)
        again[:, 1:] = at[:, 1:] == at[:, :-1]
        at[again] = -1
        at[seen[active[:, None], at]] = -1
        seen[active[:, None], at] = True
        far = np.full(at.shape, -np.inf, np.float32)
        r, c = np.nonzero(at >= 0)
        far[r, c] = np.einsum("ij,ij->i", x[at[r, c]], q[active[r]])
        all_ids, all_sims = np.hstack([i, at]), np.hstack([s, far])
        all_done = np.hstack([d, np.zeros_like(at, bool)])
        best = np.argpartition(-all_sims, min(beam, all_sims.shape[1]) - 1, axis=1)[:, :beam]
        ids[active], sims[active], done[active] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_sims, all_done))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def robust_prune(x: np.ndarray, of: np.ndarray, candidates: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """At most degree neighbours for each node of `of`, out of its row of candidates (-1 for none).

    The nearest candidate is kept, and removes every candidate that is alpha times nearer to it than to the node.
    """
    top = float((x[0] ** 2).sum())  # all lengths are equal, so squared distances are 2 * (top - similarity)
    vectors = x[candidates]
    own = top - np.einsum("bcd,bd->bc", vectors, x[of])
    open_ = (candidates >= 0) & (candidates != of[:, None])
    out = np.full((len(of), degree), -1, np.int64)
    rows = np.arange(len(of))
    for k in range(degree):
        d = np.where(open_, own, np.inf)
        p = d.argmin(1)
        some = d[rows, p] < np.inf
        if not some.any():
            break
        chosen = candidates[rows, p]
        out[some, k] = chosen[some]
        apart = top - np.einsum("bcd,bd->bc", vectors, vectors[rows, p])
        open_ &= (alpha * alpha * apart > own) & (candidates != chosen[:, None])
    return out


def _link_back(x: np.ndarray, near: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    """Adds the reverse of the batch's edges; nodes with too many are pruned."""
    source, target = np.repeat(batch, degree), near[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, begin, count = np.unique(target, return_index=True, return_counts=True)
    width = int(min(count.max(initial=0), 2 * degree))
    place = np.arange(len(target)) - np.repeat(begin, count)
    more = np.full((len(nodes), width), -1, np.int64)
    fits = place < width
    more[np.repeat(np.arange(len(nodes)), count)[fits], place[fits]] = source[fits]
    again = (more[:, :, None] == near[nodes][:, None, :]).any(2)
    both = np.hstack([near[nodes], np.where(again, -1, more)])
    full = (both >= 0).sum(1) > degree
    near[nodes[full]] = robust_prune(x, nodes[full], both[full], degree, alpha)
    spare = both[~full]
    near[nodes[~full]] = np.take_along_axis(spare, np.argsort(spare < 0, axis=1, kind="stable"), 1)[:, :degree]


def _starts(near: np.ndarray, first: int) -> np.ndarray:
    """Nodes from which all can be reached: the first, and one of each part that those before it don't reach."""
    reached, out = np.zeros(len(near), bool), []
    at = first
    while at >= 0:
        out.append(at)
        front = np.array([at])
        while len(front):
            reached[front] = True
            front = np.unique(near[front])
            front = front[front >= 0]
            front = front[~reached[front]]
        at = -1 if reached.all() else int(reached.argmin())
    return np.array(out)


def build_graph(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM_BUILD, alpha: float = ALPHA, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours by node (-1 for none), and the nodes to start from; all vectors of one shard."""
    x = _lifted(vectors)
    n = len(x)
    near = np.full((n, degree), -1, np.int64)
    start = int((x @ x.mean(0)).argmax())
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    at = min(n, 128)
    first = order[:at]
    near[first] = robust_prune(x, first, np.tile(first, (at, 1)), degree, alpha)
    _link_back(x, near, first, degree, alpha)
    while at < n:
        batch = order[at : at + min(at, BATCH)]
        at += len(batch)
        found, _ = beam_search(x, near, np.array([start]), x[batch], beam)
        near[batch] = robust_prune(x, batch, found, degree, alpha)
        _link_back(x, near, batch, degree, alpha)
    return near, _starts(near, start)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    near, starts = build_graph(np.stack(pdf["embedding"].to_numpy()))
    return pd.DataFrame({"shard": pdf["shard"], "node": np.arange(len(pdf)), "embedding": pdf["embedding"], "ids": pdf["ids"], "near": list(near.astype(np.int32)), "is_start": np.isin(np.arange(len(pdf)), starts)})


def fitting_beam(x: np.ndarray, near: np.ndarray, starts: np.ndarray, vectors: np.ndarray, q: np.ndarray, lifted: np.ndarray, k: int, beam: int) -> tuple[int, float]:
    """The beam, doubled until it finds GOAL of the k nearest of some of the queries, and the share found; 0 if half the shard would be needed."""
    some = np.unique(np.linspace(0, len(q) - 1, PROBES).astype(int))
    k = min(k, len(x))
    s = q[some] @ vectors.T
    least = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
    while True:
        found, _ = beam_search(x, near, starts, lifted[some], min(beam, len(x)))
        got = (np.take_along_axis(s, np.maximum(found, 0), 1) >= least[:, None]) & (found >= 0)
        share = float(np.minimum(got.sum(1), k).mean() / k)
        if share >= GOAL:
            return min(beam, len(x)), share
        if 4 * beam > len(x):
            return 0, 1.0
        beam *= 2


def _search(k: int, beam: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(index: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": [], "beam": [], "shard_recall": []})
        if not len(index) or not len(queries):
            return empty
        index, queries = index.sort_values("node"), queries.sort_values("vec_id")
        original = np.stack(index["embedding"].to_numpy()).astype(np.float64)
        near, ids = np.stack(index["near"].to_numpy()).astype(np.int64), index["ids"].to_numpy()
        x, starts = _lifted(original), np.flatnonzero(index["is_start"].to_numpy())
        asked, vectors = queries["vec_id"].to_numpy(), np.stack(queries["embedding"].to_numpy()).astype(np.float64)
        lifted = vectors / np.abs(vectors).max(1, keepdims=True)
        lifted = np.hstack([lifted / np.sqrt((lifted**2).sum(1, keepdims=True)), np.zeros((len(vectors), 1))]).astype(np.float32)
        beam_here, share = fitting_beam(x, near, starts, original, vectors, lifted, k + 1, beam)
        count = np.array([len(i) for i in ids])
        first, flat = np.cumsum(count) - count, np.concatenate(list(ids))
        out = []
        for low in range(0, len(asked), 256):
            q = vectors[low : low + 256]
            if beam_here:
                found, _ = beam_search(x, near, starts, lifted[low : low + 256], beam_here)
                r, c = np.nonzero(found >= 0)
                node = found[r, c]
            else:
                s = q @ original.T
                most = min(k + 1, len(x))
                r, node = np.nonzero(s >= np.partition(s, len(x) - most, axis=1)[:, len(x) - most, None] * (1 - 1e-12 * np.sign(s)))
            s = np.einsum("ij,ij->i", original[node], q[r])
            n = count[node]
            r, s = np.repeat(r, n), np.repeat(s, n)
            vec = flat[np.repeat(first[node], n) + np.arange(len(r)) - np.repeat(np.cumsum(n) - n, n)]
            own = vec == asked[low + r]
            r, s, vec = r[~own], s[~own], vec[~own]
            by = np.lexsort((vec, -s, r))
            r, s, vec = r[by], s[by], vec[by]
            rank = np.arange(len(r)) - np.searchsorted(r, r)
            out.append(pd.DataFrame({"query_id": asked[low + r], "vec_id": vec, "score": s, "beam": beam_here, "shard_recall": share})[rank < k])
        return pd.concat(out)

    return run


def valid(embedding: Column) -> Column:
    """Whether a vector takes part: no null, no component that is null or not finite, not all zero."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return embedding.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(embedding, lambda v: v != 0)


def tier(embedding: Column) -> Column:
    """A whole number that is equal for vectors of about equal length; of any finite components, as those are scaled first."""
    most = F.array_max(F.transform(embedding, lambda v: F.abs(v.cast("double"))))
    square = F.aggregate(embedding, F.lit(0.0), lambda a, v: a + (v.cast("double") / most) ** 2)
    return F.floor((F.log(most) + F.log(square) / 2) / float(np.log(TIER)) + 0.5).cast("int")  # lengths of 1 lie within a tier, not at its border


def search(vectors: DataFrame, is_query: Column, k: int = K, shard_rows: int = SHARD_ROWS, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score, beam, shard_recall: the k nearest found of each query, rows of vectors (vec_id, embedding) for which is_query holds.

    A query's own id is no candidate. Invalid vectors and rows without id take no part, neither as queries nor as
    candidates; vectors are compared with those of equal dimension. Of a repeated row each id counts once. Ties go to the
    smaller id. An empty table gives an empty result. Other columns are not read. beam is the one with which the row was
    found (0: by comparison with the whole shard), shard_recall what the task measured with it.

    The numbers of shards by dimension and tier come to the driver. A group holds a shard and QUERY_ROWS queries; every
    block of queries meets every shard, as the method has it.
    """
    v = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & valid(F.col("embedding"))).distinct()
    rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
    nodes = v.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    nodes = written(nodes.withColumns({"dim": F.size("embedding"), "tier": tier(F.col("embedding"))}), "nodes")
    sizes: dict[int, dict[int, int]] = {}
    for r in nodes.groupBy("dim", "tier").count().collect():
        sizes.setdefault(r["dim"], {})[r["tier"]] = -(-r["count"] // shard_rows)
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double, beam int, shard_recall double")
    literal = lambda tiers: F.array(*(F.struct(F.lit(t).alias("t"), F.lit(n).alias("n")) for t, n in sorted(tiers.items())))
    tiers = F.create_map(*(x for d, t in sizes.items() for x in (F.lit(d), literal(t))))
    own = F.filter(tiers[F.col("dim")], lambda s: s["t"] == F.col("tier"))[0]["n"]
    shard = F.concat_ws(":", "dim", "tier", F.pmod(F.xxhash64("embedding"), own))
    index = nodes.withColumn("shard", shard).select("shard", "embedding", "ids")
    kind = v.schema["embedding"].dataType.simpleString()
    index = written(index.groupBy("shard").applyInPandas(_build, f"shard string, node int, embedding {kind}, ids array<long>, near array<int>, is_start boolean"), "graph")
    queries = v.filter(is_query)
    blocks = max(1, -(-queries.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block")
    names = lambda s: F.transform(F.sequence(F.lit(0), s["n"] - 1), lambda i: F.concat_ws(":", F.size("embedding"), s["t"], i))
    asked = queries.select("vec_id", "embedding", block, F.explode(F.flatten(F.transform(tiers[F.size("embedding")], names))).alias("shard"))
    graphs = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    found = graphs.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInPandas(_search(k, beam), "query_id long, vec_id long, score double, beam int, shard_recall double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "beam", "shard_recall")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
