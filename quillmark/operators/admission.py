"""Sliding-window admission: an event is admitted while fewer than `limit` admitted ones of its key lie in the last seconds.

Admission is a sequential rule, but what a chunk of a key's events does to the admitted times that enter it is a map that
can be made without knowing them. Let V(p) be the run of admissions that begins afresh at event p. With D events admitted
before a chunk, and entering times that cease to count at events f_1 <= ... <= f_limit, at most i - 1 events can be admitted before
f_i; so the number admitted up to any event is D + min over i of (i - 1 + V(f_i) so far), and that is reached. A chunk's summary is
therefore the fresh run from each event of its first window, of which the total and the last few times are kept; summaries
of neighbouring chunks compose into one of the same form.

Events are sorted by key and time in ranges. Only keys that span several chunks need summaries: chunks of a key are composed
in groups, about as many as a group has chunks; the groups of a key are passed in turn, then the chunks of each group; then
every chunk replays its events from the times that enter it. Each of these steps runs for all chunks or groups at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.sources.scratch import scratch

WINDOW_S = 60
#: Rows of a chunk, a power of two.
CHUNK = 1 << 16
#: Stands for the time of an admission that has not taken place.
NEVER = -(1 << 62)
#: Last times that a summary keeps, as multiples of the limit: of a chunk, and of a group. Run totals that meet in a minimum
#: differ by less than two limits, so a group's times follow from those of its chunks, and the entering times from both.
OWN_DEPTH, GROUP_DEPTH = 5, 3


def replay(at: np.ndarray, limit: int, micros: int, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of the events at these times (sorted) are admitted, given the admitted times before them (at most limit); and the last admitted times after them.

    An event exactly as old as the window still counts. A limit of 0 or less admits all.
    """
    if limit <= 0:
        return np.ones(len(at), bool), seen
    ring, k, admitted = [NEVER] * (limit - len(seen)) + seen.tolist(), 0, []
    for t in at.tolist():
        fresh = ring[k] < t - micros
        if fresh:
            ring[k] = t
            k = k + 1 if k + 1 < limit else 0
        admitted.append(fresh)
    ring = np.array(ring[k:] + ring[:k], np.int64)
    return np.array(admitted, bool), ring[ring > NEVER]


class Summary:
    """Fresh runs from each event of the first window. times: of these events; counts, tails: what the run from each, or from the
    event behind them, admits, and its last times, latest first. open: whether the chunk ends within its first window.
    """

    def __init__(self, times: np.ndarray, counts: np.ndarray, tails: np.ndarray, open_: bool):
        self.times, self.counts, self.tails, self.open = times, counts, tails, open_

    @classmethod
    def of(cls, at: np.ndarray, limit: int, micros: int) -> Summary:
        n, depth = len(at), OWN_DEPTH * limit
        after = np.append(np.searchsorted(at, at + micros, "right"), n)
        width = int(after[0])
        previous, ring = np.arange(width + 1) - 1, []
        counts, tails = np.zeros(width + 1, np.int64), np.full((depth, width + 1), NEVER)
        while True:
            event = np.minimum(previous + 1, n)
            if len(ring) == limit:
                event = np.maximum(event, after[ring.pop(0)])
            live = np.flatnonzero(event < n)
            if not len(live):
                break
            tails[counts[live] % depth, live] = at[event[live]]
            counts[live] += 1
            ring.append(event)
            previous = event
        back = np.arange(1, depth + 1)[:, None]
        tails = np.where(back <= counts, np.take_along_axis(tails, (counts - back) % depth, 0), NEVER)
        return cls(at[:width], counts, tails, width == n)

    def passed(self, entering: np.ndarray, limit: int, micros: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """How many are admitted, and the last times after them, for each column of entering times, latest first."""
        f = np.searchsorted(self.times, entering[:limit][::-1] + micros, "right")
        totals = np.arange(limit)[:, None] + self.counts[f]
        total = totals.min(0)
        back = np.arange(1, depth + 1)[:, None, None]
        of_run = totals - total + back  # the admission of each run, from its last, at which the sum reaches the level
        known = (of_run <= self.counts[f]) & (of_run <= len(self.tails))
        times = np.where(known, self.tails[np.minimum(of_run, len(self.tails)) - 1, f], NEVER).max(1)
        before = np.arange(1, depth + 1)[:, None] - total  # from there on the entering times
        earlier = np.where(before <= len(entering), np.take_along_axis(entering, np.clip(before, 1, len(entering)) - 1, 0), NEVER)
        return total, np.where(before <= 0, times, earlier)

    def then(self, other: Summary, limit: int, micros: int) -> Summary:
        """Both chunks as one, to the depth of a group."""
        depth = GROUP_DEPTH * limit
        more, tails = other.passed(self.tails, limit, micros, depth)
        counts = self.counts + more
        if not self.open:
            return Summary(self.times, counts, tails, False)
        width = int(np.searchsorted(other.times, self.times[0] + micros, "right"))
        own = np.concatenate([tails[:, :-1], other.tails[:depth, : width + 1]], 1)
        return Summary(np.concatenate([self.times, other.times[:width]]), np.concatenate([counts[:-1], other.counts[: width + 1]]), own, other.open and width == len(other.times))

    def row(self) -> tuple:
        return self.times.tobytes(), self.counts.tobytes(), self.tails.tobytes(), self.open

    @classmethod
    def read(cls, times: bytes, counts: bytes, tails: bytes, open_: bool) -> Summary:
        c = np.frombuffer(counts, np.int64)
        return cls(np.frombuffer(times, np.int64), c, np.frombuffer(tails, np.int64).reshape(-1, len(c)), open_)


FIELDS = "times binary, counts binary, tails binary, open boolean"
ARROW = {"key": pa.string(), "chunk": pa.int64(), "grp": pa.int64(), "times": pa.binary(), "counts": pa.binary(), "tails": pa.binary(), "open": pa.bool_(), "entering": pa.list_(pa.int64())}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], ARROW[n]) for i, n in enumerate(names)], names)


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for r in range(b.num_rows):
            yield tuple(c[r].as_py() for c in b.columns)


def _entering(times: np.ndarray) -> np.ndarray:
    """The admitted times of a state, earliest first."""
    return times[times > NEVER][::-1]


def sliding_window(events: DataFrame, limit: int, seconds: int = WINDOW_S, chunk: int = CHUNK) -> DataFrame:
    """(id, admitted) of events (id, key, ts): admitted while fewer than `limit` admitted ones lie in the last `seconds`.

    Events of a key are taken by ts, then id; no key is a key too; an event without ts is not admitted and does not count.
    A limit of 0 or less admits all. Extra columns are not read; an empty table gives no rows. A key of any size is split
    into chunks of at most `chunk` rows, which run in as many tasks.
    """
    e = events.select("id", F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), F.lit("")).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    if limit <= 0:
        return e.select("id", F.lit(True).alias("admitted"))
    return admissions(e, limit, seconds * 1_000_000, chunk).select("id", "admitted")


def admissions(events: DataFrame, limit: int, micros: int, chunk: int = CHUNK) -> DataFrame:
    """(id, key, at, admitted, since) of events (id, key, at): since is the last admitted time up to an event, its own if it is admitted.

    key is text, none null; at counts microseconds, null for an event that is not admitted and does not count.
    """
    spark, path = events.sparkSession, scratch(events.sparkSession, "events")
    none = events.filter("at IS NULL").select("id", "key", "at", F.lit(False).alias("admitted"), F.lit(None).cast("long").alias("since"))
    dealt = events.filter("at IS NOT NULL").select("id", "key", "at").repartitionByRange("key", "at", "id").sortWithinPartitions("key", "at", "id")
    dealt.withColumn("place", F.monotonically_increasing_id()).withColumn("chunk", F.floor(F.col("place") / chunk)).write.parquet(path)
    dealt = spark.read.parquet(path)

    # keys of several chunks: each of their chunks holds the key's first or last event or nothing else, so there are few
    chunks = dealt.groupBy("key", "chunk").agg(F.lit(1)).groupBy("key").agg(F.count("*").alias("n"), F.collect_list("chunk").alias("chunks")).filter("n > 1")
    links = chunks.select("key", F.ceil(F.sqrt("n")).alias("each"), F.posexplode(F.array_sort("chunks")).alias("k", "chunk")).select("key", "chunk", F.floor(F.col("k") / F.col("each")).alias("grp"))
    path = scratch(spark, "chunks")
    links.write.parquet(path)
    links = spark.read.parquet(path)
    if not links.head(1):
        return _replayed(dealt, None, limit, micros).unionByName(none)

    def own(t: pa.Table) -> pa.Table:
        at = np.sort(t["at"].to_numpy())
        first = tuple(t[c][0].as_py() for c in ("key", "chunk", "grp"))
        return pa.Table.from_batches([_batch([(*first, *Summary.of(at, limit, micros).row())], ["key", "chunk", "grp", "times", "counts", "tails", "open"])])

    path = scratch(spark, "summaries")
    of_chunks = dealt.join(links, ["key", "chunk"]).select("key", "chunk", "grp", "at")
    of_chunks.groupBy("key", "chunk", "grp").applyInArrow(own, f"key string, chunk long, grp long, {FIELDS}").write.parquet(path)
    summaries = spark.read.parquet(path)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, whole = None, None
        for key, _, grp, *fields in _each(batches):
            one = Summary.read(*fields)
            if (key, grp) == group:
                whole = whole.then(one, limit, micros)
            else:
                if group:
                    yield _batch([(*group, *whole.row())], ["key", "grp", "times", "counts", "tails", "open"])
                group, whole = (key, grp), one
        if group:
            yield _batch([(*group, *whole.row())], ["key", "grp", "times", "counts", "tails", "open"])

    def of_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        for key, grp, *fields in _each(batches):
            if key != at:
                at, state = key, np.full((limit, 1), NEVER)
            yield _batch([(key, grp, _entering(state[:, 0]))], ["key", "grp", "entering"])
            state = Summary.read(*fields).passed(state, limit, micros, limit)[1]

    def of_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for key, _, chunk, entering, *fields in _each(batches):
            if entering is not None:
                state = np.array([NEVER] * (limit - len(entering)) + entering, np.int64)[::-1].reshape(-1, 1)
                continue
            yield _batch([(key, chunk, _entering(state[:, 0]))], ["key", "chunk", "entering"])
            state = Summary.read(*fields).passed(state, limit, micros, limit)[1]

    groups = summaries.repartition("key", "grp").sortWithinPartitions("key", "grp", "chunk").mapInArrow(composed, f"key string, grp long, {FIELDS}")
    entries = groups.repartition("key").sortWithinPartitions("key", "grp").mapInArrow(of_groups, "key string, grp long, entering array<long>")
    steps = entries.select("key", "grp", F.lit(-1).cast("long").alias("chunk"), "entering", *(F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in FIELDS.split(", "))))
    steps = steps.unionByName(summaries.withColumn("entering", F.lit(None).cast("array<long>")))
    known = steps.repartition("key", "grp").sortWithinPartitions("key", "grp", "chunk").mapInArrow(of_all, "key string, chunk long, entering array<long>")
    return _replayed(dealt, known, limit, micros).unionByName(none)


def _replayed(dealt: DataFrame, known: DataFrame | None, limit: int, micros: int) -> DataFrame:
    """Every chunk of a key from the times that enter it, which come before its events; chunks without any begin afresh."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state = None, np.zeros(0, np.int64)
        for b in batches:
            key, chunk = b.column(0).dictionary_encode(), b.column(1).to_numpy()
            code, at, ids = key.indices.to_numpy(), b.column(3).to_numpy(), b.column(4)
            starts = np.flatnonzero(np.concatenate([[True], (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])])) if b.num_rows else []
            admitted, events, since = np.zeros(b.num_rows, bool), np.ones(b.num_rows, bool), np.zeros(b.num_rows, np.int64)
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                this = b.column(0)[a].as_py(), int(chunk[a])
                if this != group:
                    group, state = this, np.zeros(0, np.int64)
                    entering = b.column(5)[a].as_py()
                    if entering is not None:
                        state, events[a], a = np.array(entering, np.int64), False, a + 1
                before, times = state[-1] if len(state) else NEVER, at[a:z]
                admitted[a:z], state = replay(times, limit, micros, state)
                since[a:z] = np.maximum.accumulate(np.where(admitted[a:z], times, before))
            columns = [ids, b.column(0), b.column(3), pa.array(admitted), pa.array(since)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(events)) for c in columns], ["id", "key", "at", "admitted", "since"])

    rows = dealt.select("key", "chunk", "place", "at", "id", F.lit(None).cast("array<long>").alias("entering"))
    if known is not None:
        rows = rows.unionByName(known.select("key", "chunk", F.lit(-1).cast("long").alias("place"), F.lit(0).cast("long").alias("at"), F.lit(None).cast("long").alias("id"), "entering"))
    return rows.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "place").mapInArrow(each, "id long, key string, at long, admitted boolean, since long")
