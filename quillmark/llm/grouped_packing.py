"""Best-fit packing of documents by linear grouping.

A document is packed whole; only one longer than a sequence is cut, into pieces of a sequence's length and a rest. Lengths
are whole numbers up to that of a sequence, so how many pieces each length has says all that a plan needs, however many
documents there are:

1. Pieces longer than a small share of a sequence are sorted by length and cut into groups of equal numbers; each length
   is rounded up to the longest of its group, so that few sizes are left.
2. Configurations are multisets of these sizes that fit a sequence. How often to use which is a linear programme, solved by
   column generation: its dual values price the sizes, and a knapsack finds the configuration that they pay best for. Whole
   numbers are taken; what the fractions leave is solved again, then left to step 4.
3. Pieces take the places of the sizes of their groups, longest first, which leaves more room than the sizes did.
4. The remaining pieces, longest first, go where they leave the least room, then to new sequences.

The plan is run-length encoded: ranks a to b among the pieces of one length go, so many to each, to consecutive sequences at one
offset. Pieces get their ranks from counts by (task, length), so no group of pieces is sorted or gathered anywhere.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import shared_dir, table
from quillmark.llm.packing import BROADCAST_ROWS, default_tokenizer, word_ids

LENGTH, END = 2048, 0
#: Groups of large pieces; pieces up to 1 / SMALL of a sequence are small.
GROUPS, SMALL = 128, 8
#: Times that what whole numbers leave of a programme is solved again, and pivots of one programme for each of its sizes.
PROGRAMMES, PIVOTS = 2, 12
ROWS = 500
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, first long"
PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def grouped(counts: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Pieces by length cut into groups of equal numbers, longest first: the longest length of each, and how many it has."""
    lengths = np.flatnonzero(counts)[::-1]
    ends = np.cumsum(counts[lengths])
    each = -(-int(ends[-1]) // groups)
    firsts = np.arange(0, int(ends[-1]), each)
    sizes, at = np.unique(-lengths[np.searchsorted(ends, firsts, "right")], return_index=True)
    return -sizes, np.diff(firsts[at], append=ends[-1])


def best_configuration(sizes: np.ndarray, values: np.ndarray, length: int) -> tuple[float, np.ndarray]:
    """The multiset of sizes within length of largest total value, and how often it has each size."""
    worth = np.flatnonzero(values > 1e-12)
    best = [np.zeros(length + 1)]
    for g in worth:
        f, s = best[-1].copy(), sizes[g]
        for low in range(s, length + 1, s):  # one more of this size each time
            high = min(low + s, length + 1)
            np.maximum(f[low:high], f[low - s : high - s] + values[g], out=f[low:high])
        best.append(f)
    config, room = np.zeros(len(sizes), np.int64), length
    for i in range(len(worth), 0, -1):
        s = sizes[worth[i - 1]]
        while room >= s and best[i][room] > best[i - 1][room]:
            config[worth[i - 1]] += 1
            room -= s
    return float(values @ config), config


def programme(sizes: np.ndarray, demand: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Configurations, one a row, and how often to use each (fractions), so that all demand is met with nearly the fewest sequences."""
    k = len(sizes)
    rows = np.diag(length // sizes)
    cost, inverse, x = np.ones(k), np.diag(1.0 / np.diag(rows)), demand / np.diag(rows)
    for _ in range(PIVOTS * k + 50):
        values = cost @ inverse
        if values.min() < -1e-9:  # more than the demand of a size is as good
            column, price = -(np.arange(k) == values.argmin()).astype(np.int64), 0.0
        else:
            value, column = best_configuration(sizes, values, length)
            total = float(cost @ x)
            if value <= 1 + 1e-9 or total - total / value < max(0.5, 2e-4 * total):
                break
            price = 1.0
        enters = inverse @ column
        open_ = np.flatnonzero(enters > 1e-9)
        if not len(open_):
            break
        leaves = open_[np.argmin(x[open_] / enters[open_])]
        step = x[leaves] / enters[leaves]
        x = np.maximum(x - step * enters, 0)
        x[leaves] = step
        pivot = inverse[leaves] / enters[leaves]
        inverse = inverse - np.outer(enters, pivot)
        inverse[leaves] = pivot
        rows[leaves], cost[leaves] = column, price
    used = cost > 0
    return rows[used], x[used]


def configurations(sizes: np.ndarray, demand: np.ndarray, length: int) -> list[tuple[np.ndarray, int]]:
    """Configurations and whole numbers of sequences, which hold no more of a size than there are; the rest is small."""
    out, left = [], demand.astype(np.int64)
    for last in range(PROGRAMMES - 1, -1, -1):
        some = np.flatnonzero(left)
        if not len(some):
            break
        rows, x = programme(sizes[some], left[some].astype(float), length)
        for i in np.argsort(-(x % 1), kind="stable"):
            n, config = int(x[i] + 1e-6), np.zeros(len(sizes), np.int64)
            config[some] = rows[i]
            if not last or x[i] % 1 > 0.6:
                n += 1
            held = config > 0
            n = min(n, int((left[held] // config[held]).min()))
            if n > 0:
                out.append((config, n))
                left -= n * config
    return out


class Plan:
    """Where the pieces of every length go. counts: pieces by length, from 0 to that of a sequence.

    records: (length, rank, pieces, sequence, pieces of each sequence, offset).
    """

    def __init__(self, counts: np.ndarray, groups: int = GROUPS, small: int = SMALL):
        self.length, self.left = len(counts) - 1, counts.astype(np.int64).copy()
        self.rank = np.zeros_like(self.left)
        self.records: list[tuple[int, int, int, int, int, int]] = []
        self.n_sequences = 0
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # by room left: first sequence, sequences
        self._place(self.length, self.left[self.length], self._new(self.left[self.length]), 1, 0)
        self.small = self.length // small
        large = np.where(np.arange(self.length + 1) > self.small, self.left, 0)
        if large.any():
            self._substitute(*grouped(large, groups))
        for n in np.flatnonzero(self.left)[::-1].tolist():
            self._best_fit(n)
        by = np.array(sorted(self.records), np.int64).reshape(-1, 6)
        self.key, self.columns = (by[:, 0] << 44) + by[:, 1], by.T

    def _new(self, n: int) -> int:
        self.n_sequences += int(n)
        return self.n_sequences - int(n)

    def _place(self, n: int, pieces: int, sequence: int, per: int, offset: int) -> None:
        if pieces:
            self.records.append((n, int(self.rank[n]), int(pieces), sequence, per, offset))
            self.rank[n] += pieces
            self.left[n] -= pieces

    def _free(self, room: int, sequence: int, n: int) -> None:
        if n and room:
            self.rooms.setdefault(room, []).append((sequence, n))

    def _longest(self, most: int, n: int) -> list[tuple[int, int]]:
        """Lengths and numbers of the n longest large pieces left that are not longer than most; fewer if there are no more."""
        out = []
        for one in np.flatnonzero(self.left[self.small + 1 : most + 1])[::-1].tolist():
            take = min(n, int(self.left[one + self.small + 1]))
            out.append((one + self.small + 1, take))
            n -= take
            if not n:
                break
        return out

    def _substitute(self, sizes: np.ndarray, demand: np.ndarray) -> None:
        """Runs of sequences of one configuration. A place gets the longest piece left that its size has room for, the last place of
        a sequence the longest that the sequence has; so what longer pieces leave unfilled is not lost, and later places get
        shorter pieces than planned.
        """
        plan = [(np.repeat(sizes, config).tolist(), n) for config, n in configurations(sizes, demand, self.length)]
        for places, n in sorted(plan, key=lambda p: ([-s for s in p[0]], p[1])):
            first = self.n_sequences
            runs, used = [(0, n, self.length)], 0
            for i, size in enumerate(places + [0] * self.length):
                filled = []
                for low, m, room in runs:
                    for one, take in self._longest(size if i + 1 < len(places) else room, m):
                        self._place(one, take, first + low, 1, self.length - room)
                        filled.append((low, take, room - one))
                        low, m = low + take, m - take
                    if m and room < self.length:
                        self._free(room, first + low, m)
                    used = max(used, low + m if room < self.length else low)
                runs = [r for r in filled if i + 1 < len(places) or r[2] > self.small]
                for low, m, room in filled:
                    if i + 1 >= len(places) and room <= self.small:
                        self._free(room, first + low, m)
                if not runs:
                    break
            self._new(used)

    def _best_fit(self, n: int) -> None:
        for room in sorted(r for r in self.rooms if r >= n):
            per, again = room // n, []
            for first, m in self.rooms.pop(room):
                left = int(self.left[n])
                full = min(m, left // per)
                some = left % per if full < m else 0
                self._place(n, full * per, first, per, self.length - room)
                self._free(room - per * n, first, full)
                self._place(n, some, first + full, per, self.length - room)
                self._free(room - some * n, first + full, 1 if some else 0)
                used = full + (1 if some else 0)
                if used < m:
                    again.append((first + used, m - used))
            if again:
                self.rooms.setdefault(room, []).extend(again)
            if not self.left[n]:
                return
        per, left = self.length // n, int(self.left[n])
        full, some = divmod(left, per)
        first = self._new(full + (1 if some else 0))
        self._place(n, full * per, first, per, 0)
        self._free(self.length - per * n, first, full)
        self._place(n, some, first + full, per, 0)
        self._free(self.length - some * n, first + full, 1 if some else 0)

    def places(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the pieces of these lengths and ranks."""
        at = np.searchsorted(self.key, (length << 44) + rank, "right") - 1
        _, first, _, sequence, per, offset = self.columns[:, at]
        i = rank - first
        return sequence + i // per, offset + i % per * length


def _pieces(tokenizer: str, length: int, end: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = word_ids(tokenizer), np.zeros(length + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                if not b.num_rows:
                    continue
                ids, ends = words.ids(b.column(1))
                ids[ends - 1] = end
                ids = ids.astype("<u4")
                n = np.diff(ends, prepend=0)
                per = -(-n // length)
                doc = np.repeat(np.arange(len(n)), per)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
                start = piece * length
                size = np.minimum(n[doc] - start, length)
                a = (ends - n)[doc] + start
                crc = [zlib.crc32(ids[x:z].data) for x, z in zip(a.tolist(), (a + size).tolist())]
                by = np.argsort(size, kind="stable")
                first = np.empty(len(doc), np.int64)
                first[by] = seen[size[by]] + np.arange(len(by)) - np.searchsorted(size[by], size[by])
                seen += np.bincount(size, minlength=length + 1)
                columns = [b.column(0).take(pa.array(doc)), pa.array(piece, pa.int32()), start, size, np.array(crc, np.int64), pa.array([part] * len(doc), pa.int32()), first]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in columns], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "first"])

    return run


def _placed(plan: Plan) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = plan.places(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, groups: int = GROUPS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Sequences are numbered from 0 without gaps, and so are the tokens of each. A null or empty text is the id end alone; a
    null id stays null; repeated rows are packed each; an empty table gives no pieces. A text of any length is cut where
    a sequence ends. Pieces of one length are packed in storage order. Columns other than doc_id and text are not read.
    The driver gets the number of pieces of each length, a row a length.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "pieces")
    docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer or default_tokenizer(), length, end), PIECES).write.parquet(path)
    pieces = spark.read.schema(PIECES).parquet(path)
    sums = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = np.zeros(length + 1, np.int64)
    for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect():
        counts[r["length"]] = r["n"]
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("part", "length", F.coalesce(before, F.lit(0)).alias("before"))
    few = starts.count() <= BROADCAST_ROWS
    ranked = pieces.join(F.broadcast(starts) if few else starts, ["part", "length"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(_placed(Plan(counts, groups)), PLACED)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
