"""Queries of streams: each is run over the table's files to the end, and its result read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.plans import q_cases, q_control, q_turns
from quillmark.plans.views import frame, sql, with_views
from quillmark.sources.scratch import scratch
from quillmark.sources.snapshots import Snapshots
from quillmark.streaming import streams


#: Parts of a stream, each a micro-batch, and rows of a file at least, where a part has several.
SLICES, FILE_ROWS = 10, 20_000


def drained(spark: SparkSession, rows: DataFrame, ts: str, build: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """What a streaming operator makes of rows that come in SLICES batches, out of order, and of a last row that lets the watermark pass all.

    A row is in the slice of its time or, by a hash of it, in the next one or the one after that; rows may be late by as much.
    All slices have as many files as the smallest has rows for, so that a batch is read and prepared by many tasks.
    """
    source, out, state = (scratch(spark, n) for n in ("stream-in", "stream-out", "stream-state"))
    rows, files = rows.withColumn(ts, F.col(ts).cast("timestamp")), 1
    low, high = rows.agg(F.min(F.unix_micros(ts)), F.max(F.unix_micros(ts))).first()
    if low is not None:
        width = (high - low) // SLICES + 1
        slice_ = F.floor((F.unix_micros(ts) - low) / width) + F.pmod(F.xxhash64("id"), F.lit(3))
        dealt, late = rows.withColumn("_slice", F.least(slice_, F.lit(SLICES - 1))), f"{3 * width // 1_000_000 + 1} seconds"
        slices = scratch(spark, "slices")  # rows are made and dealt once, then given to the stream in turn
        dealt.write.partitionBy("_slice").parquet(slices)
        dealt = spark.read.schema(dealt.schema).parquet(slices)
        sizes = dealt.groupBy("_slice").count().agg(F.count("*"), F.min("count")).first()
        files = max(1, sizes[1] // FILE_ROWS) if sizes[0] == SLICES else 1
        for k in range(SLICES):
            part = dealt.filter(F.col("_slice") == k).drop("_slice")
            (part.repartition(files) if files > 1 else part.coalesce(1)).write.mode("append").parquet(source)
        end = spark.range(1).select(*(F.timestamp_micros(F.lit(high + 10 * width + 86_400_000_000)).alias(c) if c == ts else F.lit(None).cast(t).alias(c) for c, t in rows.dtypes))
        end.write.mode("append").parquet(source)
    else:
        late = streams.LATE
        rows.write.parquet(source)
    stream = build(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(source), late)
    q = stream.writeStream.format("parquet").option("checkpointLocation", state).option("path", out).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).filter("NOT late").drop("late")


#: Uploads come in so many lots.
LOTS = 3


def upload_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The jobs of uploads assessed as they arrive, lot by lot, each against the stock that the lots before it have made."""
    uploads, registry, stock = (frame(spark, sf_dir, n) for n in ("v_uploads", "v_registry", "v_documents"))
    source, out, state = (scratch(spark, n) for n in ("uploads-in", "jobs-out", "uploads-state"))
    made = Snapshots(spark, scratch(spark, "stock"), ["tenant_id", "code", "version"])
    for k in range(LOTS):
        uploads.filter(F.pmod("id", F.lit(LOTS)) == k).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 1).parquet(source)

    columns = ["id", "tenant_id", "code", "version", "title", "area", "effective_date", "status"]
    made.create(stock.select(*columns))  # version n + 1 is the stock that batch n finds

    def sink(jobs: DataFrame, new: DataFrame, number: int) -> None:
        jobs.write.mode("overwrite").parquet(f"{out}/batch={number}")
        if made.version() == number + 1:  # else the batch is run again
            new = new.withColumn("id", F.coalesce("id", F.lit(-1))).select(*columns)  # -1 for a document made on the way
            made.change(put=new.subtract(made.read(number + 1)), parent=number + 1)

    streams.process_uploads(stream, registry, lambda number: made.read(number + 1), sink, state).awaitTermination()
    return spark.read.parquet(out).select("id", "tenant_id", "code", "version", "status", "created_document")


def admission_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files admitted or rejected as they arrive, in three lots by id; the query is taken up again after each."""
    source, out, state = (scratch(spark, n) for n in ("files-in", "admitted", "files-state"))
    rows = sql(spark, sf_dir, q_control.UPLOAD_FILES)
    top = rows.agg(F.max("id")).first()[0] or 0
    for lot in range(3):
        rows.filter(F.least(F.floor(F.col("id") * 3 / (top + 1)), F.lit(2)) == lot).write.mode("append").parquet(source)
        streams.admit_files(spark.readStream.schema(rows.schema).parquet(source), out, state).awaitTermination()
    return spark.read.parquet(out).select("id", "status", "reason", "stored_name")


#: Documents as they come in, and what later becomes of some.
STATUS_CHANGES = f"""SELECT id, TIMESTAMP '2024-01-01 00:00:00' AS ts, area, status FROM {{v_documents}}
    UNION ALL SELECT d.id, TIMESTAMP '2026-01-01 00:00:00', coalesce(p.area, d.area), p.status FROM {{v_documents}} d JOIN ({q_control.PATCHES}) p ON p.id = d.id"""


def status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by area and status, kept up to date while changes come in five batches, later ones before earlier ones too."""
    changes = sql(spark, sf_dir, STATUS_CHANGES).withColumn("ts", F.col("ts").cast("timestamp"))
    source, state = scratch(spark, "changes-in"), scratch(spark, "changes-state")
    for k in range(5):
        changes.filter(F.pmod(F.xxhash64("id", "ts"), F.lit(5)) == k).coalesce(1).write.mode("append").parquet(source)
    table = Snapshots(spark, scratch(spark, "counts"), ["area", "status"])
    table.create(spark.createDataFrame([], "area string, status string, n long"))
    stream = spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(source)
    streams.count_latest(stream, ["area", "status"], table, state).awaitTermination()
    return table.read()


QUERIES = {
    "A2_status_counts_stream": status_counts,
    "V8_jobs_stream": upload_stream,
    "S16_admission_stream": admission_stream,
    "L2_duplicate_findings_stream": lambda s, d: drained(s, sql(s, d, q_cases.REPORTS), "created_at", streams.suppress_duplicates),
    "L2_recent_reports_stream": lambda s, d: drained(s, sql(s, d, q_cases.MANY_REPORTS), "created_at", streams.suppress_duplicates),
    "L17_sliding_window_stream": lambda s, d: drained(s, sql(s, d, q_cases.BURSTS), "ts", lambda e, late: streams.sliding_window(e, 2, late=late)),
    "M6_consent_stream": lambda s, d: drained(s, sql(s, d, f"SELECT *, TIMESTAMP '2024-01-01 00:00:00' + CAST(id AS INT) * INTERVAL '1' SECOND AS ts FROM ({q_turns.OFFERED})"), "ts", streams.resolve_consent),
}
#: Streams have the results of their batch forms.
ORACLES = {
    "A2_status_counts_stream": with_views(f"SELECT area, status, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ts DESC) AS place FROM ({STATUS_CHANGES})) WHERE place = 1 GROUP BY area, status"),
    "V8_jobs_stream": with_views(q_control.jobs_of_lots(LOTS)), "L2_recent_reports_stream": q_cases.ORACLES["L2_recent_reports"], "S16_admission_stream": q_control.ORACLES["S16_admission"], "L2_duplicate_findings_stream": q_cases.ORACLES["L2_duplicate_findings"],
    "L17_sliding_window_stream": q_cases.ORACLES["L17_sliding_window"], "M6_consent_stream": q_turns.ORACLES.pop("M6_consent_stream"),
}
