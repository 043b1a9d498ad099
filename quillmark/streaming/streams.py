"""Streams: the stateful operators over events that keep arriving, with the results of their batch forms.

Every function takes and returns streaming DataFrames. Rows of a key wait, as state, until the watermark has passed them, and are
then taken in the order of their time, in whatever order and in however many batches they came. A row that comes when the
watermark has passed its time can't be put in its place: it is given out at once, with `late` set and no verdict, for a table of
its own. What is kept of a key goes once the watermark has passed it by as long as it can bear on later rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from quillmark.functions.text import fingerprint
from quillmark.operators import identity
from quillmark.operators.admission import WINDOW_S, replay
from quillmark.operators.guardrails import offers
from quillmark.operators.lifecycle import HOURS, RECENT
from quillmark.operators.routing import consent
from quillmark.sources.snapshots import Snapshots
from quillmark.sources.tables import admit_uploads

#: How late events may come, and days after which a silent conversation is forgotten.
LATE, DAYS = "1 hour", 30
DAY_MS = 86_400_000
#: Keys wait in so many buckets, and rows in blobs of so many. A bucket is held by one task while its rows are taken.
BUCKETS, BLOB = 256, 1 << 14
#: A task deals so many rows to buckets at once.
DEALT = 1 << 17
#: Stands for the time of the first row where none waits.
NONE_WAITS = 1 << 62
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _blobs(rows: pa.Table) -> list[bytes]:
    """Rows as blobs of up to BLOB rows each."""

    def blob(part: pa.Table) -> bytes:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as w:
            w.write_table(part)
        return sink.getvalue().to_pybytes()

    return [blob(rows[k : k + BLOB]) for k in range(0, len(rows), BLOB)]


def _rows(blobs: Iterator[bytes]) -> pa.Table:
    return pa.concat_tables([pa.ipc.open_stream(bytes(b)).read_all() for b in blobs])


def _dealt(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows as blobs of one bucket each, as Spark hands rows to a stateful processor one by one."""

    def deal(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(batches)
        bucket = t["bucket"].to_numpy()
        order = np.argsort(bucket, kind="stable")
        t, bucket = t.select(schema.names).cast(schema).take(pa.array(order)).combine_chunks(), bucket[order]
        starts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        out = [(int(bucket[a]), b) for a, z in zip(starts, [*starts[1:], len(t)]) for b in _blobs(t[a:z])]
        return pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.int64()), pa.array([b for _, b in out], pa.binary())], ["bucket", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some, n = [], 0
        for b in batches:
            some.append(b)
            n += b.num_rows
            if n >= DEALT:
                yield deal(some)
                some, n = [], 0
        if n:
            yield deal(some)

    return run


class InOrder(StatefulProcessor):
    """Applies a rule to the rows of every key of a bucket in the order of (at, id).

    Rows come and wait as blobs of up to BLOB rows, and what is known of a bucket's keys is one value, so that a batch costs a bucket a few
    calls of the state store, however many rows and keys it has. fields: types of a row's columns beyond key, at (microseconds),
    id and blank (no id). rule(state, at, ids, columns...) gives the new state of a key and a list for each result beyond id; state is
    None at first, and goes keep_ms after the key's last row.
    """

    def __init__(self, fields: dict[str, pa.DataType], results: dict[str, str], rule: Callable, keep_ms: int):
        self.schema = pa.schema({"key": pa.string(), "at": pa.int64(), "id": pa.int64(), "blank": pa.bool_()} | fields)
        self.results, self.rule, self.keep_ms = results, rule, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.keys = handle.getValueState("keys", "states binary")  # {key: (state, time of its last row in milliseconds)}
        self.clock = handle.getValueState("clock", "done long, low long")  # the watermark up to which rows were taken, the first time of those that wait

    def _given(self, ids: pa.ChunkedArray, blank: pa.ChunkedArray, results: list, late: bool) -> Iterator[pd.DataFrame]:
        out = pd.DataFrame({"id": pd.arrays.IntegerArray(ids.to_numpy(), blank.to_numpy())} | {n: pd.array(r, t) for (n, t), r in zip(self.results.items(), results)})
        for k in range(0, len(out), BLOB):
            yield out[k : k + BLOB].assign(late=late)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        t = pa.concat_tables([_rows(pdf["rows"]) if "rows" in pdf else pa.Table.from_pandas(pdf[self.schema.names], self.schema, preserve_index=False) for pdf in rows])
        late = t["at"].to_numpy() // 1000 < passed
        gone, t = t.filter(pa.array(late)), t.filter(pa.array(~late))
        if len(t):
            first = int(t["at"].to_numpy().min())
            done, low = tuple(self.clock.get()) if self.clock.exists() else (-1, first)
            self.waiting.appendList([(b,) for b in _blobs(t)])
            self.clock.update((done, min(low, first)))
            self.handle.registerTimer(first // 1000 + 1)
        yield from self._given(gone["id"], gone["blank"], [[None] * len(gone) for _ in self.results], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        done, low = tuple(self.clock.get()) if self.clock.exists() else (passed, NONE_WAITS)
        if done == passed:
            return  # another timer of this batch has seen to it
        keys, rest = pickle.loads(bytes(self.keys.get()[0])) if self.keys.exists() else {}, NONE_WAITS
        if low // 1000 < passed:
            t = _rows(r[0] for r in self.waiting.get())
            ready = t["at"].to_numpy() // 1000 < passed
            left, t = t.filter(pa.array(~ready)), t.filter(pa.array(ready))
            if len(left):
                rest = int(left["at"].to_numpy().min())
                self.waiting.put([(b,) for b in _blobs(left)])
            else:
                self.waiting.clear()
            yield from self._ruled(t, keys)
        else:
            rest = low
        keys = {k: (s, last) for k, (s, last) in keys.items() if last + self.keep_ms >= passed}
        if keys:
            self.keys.update((pickle.dumps(keys),))
            self.handle.registerTimer(max(min(last for _, last in keys.values()) + self.keep_ms, passed) + 1)
        else:
            self.keys.clear()
        if rest < NONE_WAITS:
            self.handle.registerTimer(rest // 1000 + 1)
        if keys or rest < NONE_WAITS:
            self.clock.update((passed, rest))
        else:
            self.clock.clear()

    def _ruled(self, t: pa.Table, keys: dict) -> Iterator[pd.DataFrame]:
        """The results of rows, by key in order; puts the new states into keys."""
        name = t["key"].combine_chunks().dictionary_encode("encode")
        t = t.drop_columns("key").append_column("key", name.indices)
        order = np.lexsort([t[c].to_numpy() for c in ("id", "at", "key")])
        t = t.take(pa.array(order)).combine_chunks()
        code, at, ids = t["key"].to_numpy(), t["at"].to_numpy(), pc.if_else(t["blank"], None, t["id"])
        starts = np.flatnonzero(np.diff(code, prepend=-1))
        results = [[] for _ in self.results]
        more = [t[n] for n in self.schema.names[4:]]
        for a, z in zip(starts.tolist(), [*starts[1:].tolist(), len(t)]):
            k = name.dictionary[int(code[a])].as_py()
            state, *given = self.rule(keys[k][0] if k in keys else None, at[a:z], ids[a:z], *(c[a:z] for c in more))
            keys[k] = state, int(at[z - 1]) // 1000
            for r, g in zip(results, given):
                r.extend(g)
        yield from self._given(t["id"], t["blank"], results, False)


def _in_order(rows: DataFrame, key: str, processor: InOrder, result: str, buckets: int = BUCKETS) -> DataFrame:
    """Keys are dealt to buckets by a hash; rows without time can't be placed and count as late."""
    spark = rows.sparkSession
    if not str(spark.conf.get(PROVIDER, "")).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)  # the one that keeps lists and timers
    of = F.col(key).cast("string")
    rows = rows.withColumns({"key": of, "at": F.coalesce("at", F.lit(-(1 << 62))), "blank": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0)).cast("long"), "bucket": F.pmod(F.xxhash64(of), F.lit(buckets))})
    blobs = rows.select("bucket", *processor.schema.names).mapInArrow(_dealt(processor.schema), "bucket long, rows binary")
    return blobs.groupBy("bucket").transformWithStateInPandas(processor, f"{result}, late boolean", "append", "EventTime")


def _timed(rows: DataFrame, ts: str, late: str) -> DataFrame:
    """Adds at, microseconds, beside the watermark; at alone goes on, so that late rows get to the processor."""
    return rows.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).withColumn("at", F.unix_micros(ts))


def suppress_duplicates(reports: DataFrame, late: str = LATE, recent: int = RECENT) -> DataFrame:
    """(id, kept, original_id, late) of a stream of reports (id, tenant_id, description, created_at).

    The state of a tenant is its last kept reports, `recent` of them at most: of each text the last one, with its number counted
    back from the last of all.
    """
    day = HOURS * 3_600_000_000

    def rule(state: list | None, at: np.ndarray, ids: pa.ChunkedArray, prints: pa.ChunkedArray) -> tuple:
        texts = prints.combine_chunks().dictionary_encode()
        of = {text: code for code, text in enumerate(texts.dictionary.to_pylist())}
        other = {text: -k for k, (text, *_) in enumerate(state or [], 1)}  # texts that are not among these rows
        last, n, kept, original = {of.get(text, other[text]): (-back, t, i) for text, back, t, i in state or []}, 0, [], []
        for code, t, i in zip(texts.indices.to_pylist(), at.tolist(), ids.to_pylist()):
            found = last.get(code)
            fresh = found is None or n - found[0] > recent or found[1] < t - day
            if fresh:
                last[code], n = (n, t, i), n + 1
            kept.append(fresh)
            original.append(i if fresh else found[2])
        names = {v: k for k, v in other.items()} | {v: k for k, v in of.items()}
        return [(names[c], n - k, t, i) for c, (k, t, i) in last.items() if n - k <= recent], kept, original

    r = _timed(reports, "created_at", late).select("tenant_id", "at", "id", F.coalesce(fingerprint(F.col("description")), F.lit("")).alias("print"))
    processor = InOrder({"print": pa.string()}, {"kept": "boolean", "original_id": "Int64"}, rule, DAY_MS)
    return _in_order(r, "tenant_id", processor, "id long, kept boolean, original_id long")


def sliding_window(events: DataFrame, limit: int, seconds: int = WINDOW_S, late: str = LATE) -> DataFrame:
    """(id, admitted, late) of a stream of events (id, key, ts); the state of a key is its last admitted times, `limit` of them at most."""

    def rule(state: list | None, at: np.ndarray, ids: pa.ChunkedArray) -> tuple:
        admitted, seen = replay(at, limit, seconds * 1_000_000, np.array(state or [], np.int64))
        return seen.tolist(), admitted.tolist()

    e = _timed(events, "ts", late).select("key", "at", "id")
    return _in_order(e, "key", InOrder({}, {"admitted": "boolean"}, rule, seconds * 1000), "id long, admitted boolean")


def resolve_consent(messages: DataFrame, late: str = LATE) -> DataFrame:
    """(id, accepted, late) of a stream of messages (id, conversation_id, role, content, ts): user messages that answer an offer.

    The state of a conversation is whether its last assistant message ended in the offer.
    """

    def rule(state: bool | None, at: np.ndarray, ids: pa.ChunkedArray, roles: pa.ChunkedArray, offer: pa.ChunkedArray, answers: pa.ChunkedArray) -> tuple:
        offered, accepted = bool(state), []
        for role, made, answer in zip(roles.to_pylist(), offer.to_pylist(), answers.to_pylist()):
            if role == "assistant":
                offered = bool(made)
            accepted.append(answer if role == "user" and offered else None)
        return offered, accepted

    m = _timed(messages, "ts", late).select("conversation_id", "at", "id", "role", offers(F.col("content")).alias("offer"), consent(F.col("content")).alias("answer"))
    processor = InOrder({"role": pa.string(), "offer": pa.bool_(), "answer": pa.bool_()}, {"accepted": "boolean"}, rule, DAYS * DAY_MS)
    return _in_order(m, "conversation_id", processor, "id long, accepted boolean").filter("late OR accepted IS NOT NULL")


class Latest(StatefulProcessor):
    """Of each id the latest group: when it changes, the old one is taken back and the new one counted. A row older than what is known changes nothing."""

    def init(self, handle) -> None:
        self.known = handle.getValueState("known", "at long, grp string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        at, grp = max(r for pdf in rows for r in zip(pdf["at"].tolist(), pdf["grp"].tolist()))
        old, out = tuple(self.known.get()) if self.known.exists() else None, []
        if old is None or (at, grp) > old:
            out = ([(old[1], -1)] if old else []) + [(grp, 1)]
            self.known.update((at, grp))
        yield pd.DataFrame(out, columns=["grp", "n"]).astype({"grp": object, "n": "int64"})


def count_latest(changes: DataFrame, by: list[str], table: Snapshots, checkpoint: str, after: Callable[[int], None] | None = None):
    """Starts the query that keeps, in a table (by, n), how many ids are in each group by the latest of their rows (id, ts, by).

    A batch moves only the groups that it changes: old counts and signed changes are added up, and groups that come to 0 go.
    Version n + 2 of the table is the state after batch n, so a batch that is run again changes nothing; after(n) is called then.
    Of rows of one id and time the one whose group is last as JSON holds. Null ids are one id, null values groups of their own.
    """
    spark = changes.sparkSession
    if not str(spark.conf.get(PROVIDER, "")).endswith("RocksDBStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKS)
    group = F.struct(*by)
    shape = changes.select(group.alias("g")).schema["g"].dataType.simpleString()
    rows = changes.select("id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.to_json(group, {"ignoreNullFields": "false"}).alias("grp"))
    moves = rows.groupBy("id").transformWithStateInPandas(Latest(), "grp string, n long", "update", "None")

    def each(batch: DataFrame, number: int) -> None:
        if table.version() == number + 1:
            known = table.read(number + 1).select(F.to_json(group, {"ignoreNullFields": "false"}).alias("grp"), "n", F.lit(False).alias("moved"))
            moved = batch.withColumn("moved", F.lit(True))
            sums = known.unionByName(moved).groupBy("grp").agg(F.sum("n").alias("n"), F.max("moved").alias("moved")).filter("moved")
            sums = sums.withColumn("g", F.from_json("grp", shape)).select("g.*", "n")
            path = f"{checkpoint}-moves/{number}"
            sums.write.mode("overwrite").parquet(path)
            sums = changes.sparkSession.read.schema(sums.schema).parquet(path)
            table.change(put=sums.filter("n <> 0"), out=sums.filter("n = 0"), parent=number + 1)
        if after:
            after(number)

    return moves.writeStream.foreachBatch(each).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def process_uploads(uploads: DataFrame, registry: DataFrame, documents: Callable[[int], DataFrame], sink: Callable[[DataFrame, DataFrame, int], None], checkpoint: str):
    """Starts the query that assesses arriving uploads, batch by batch, and hands jobs and the new stock to the sink.

    documents(number) gives the stock that the batches before this one have made, so that a batch that is run again sees the
    same, and not what it has made itself.
    """

    def each(batch: DataFrame, number: int) -> None:
        stock = documents(number)
        assessed = identity.assess(batch, registry, stock)
        sink(*identity.resolve_jobs(assessed, stock, F.current_date()), number)

    return uploads.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admit_files(files: DataFrame, out: str, checkpoint: str):
    """Starts the query that admits arriving files, batch by batch, into the table at `out` (a folder for each batch).

    A batch knows the names that earlier ones have given; one that is run again replaces its own folder.
    """

    def each(batch: DataFrame, number: int) -> None:
        taken = None
        if number > 0:
            earlier = batch.sparkSession.read.schema(f"tenant_id {dict(batch.dtypes)['tenant_id']}, stem string, status string, batch long").parquet(out)
            taken = earlier.filter((F.col("batch") < number) & (F.col("status") == "queued")).groupBy("tenant_id", "stem").agg(F.count("*").alias("n"))
        admit_uploads(batch, taken=taken).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
