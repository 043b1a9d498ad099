"""A deterministic sharded WARC writer, and the reader of its archives.

Pages are range-sorted by id into shards; every shard is written by one task as a series of files, each record a
gzip member of its own, and a new file begins when the next member would exceed the file size. Record headers,
ids and digests are made anew from the page, so equal input gives equal files wherever tasks run: shard borders are
quantiles of the ids whose hash falls in a fixed class, not of a random sample.

A task writes to a temporary name that holds its attempt, and renames the file when it is whole; a lost task's
leftovers never get a final name. The files count once the manifest, written last, has its name too.

The archive's folder must be one that pyarrow.fs opens from every executor (file, hdfs, s3, gs).
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import shared_dir, table, written

SHARD_BYTES, FILE_BYTES, MAX_SHARDS, SAMPLE_PER_SHARD = 16 << 20, 64 << 20, 20_000, 50
DATE = "2024-01-01T00:00:00Z"
NAMESPACE = uuid.UUID("8d7f6f3c-6b1e-5c59-9c0b-3a5b0b0f7c11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard long, file int, path string, bytes long, records long, first_id long, last_id long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _line(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None, refers_url: str | None = None) -> bytes:
    """A response record, or a revisit record if it refers to another page."""
    digest = sha1(payload)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", DATE)]
    if url is not None:
        head.append(("WARC-Target-URI", _line(url)))
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if refers_to is None:
        block += payload
    else:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest)), ("WARC-Refers-To-Date", DATE), ("X-Refers-To-Page-ID", str(refers_to))]
        if refers_url is not None:
            head.append(("WARC-Refers-To-Target-URI", _line(refers_url)))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{sha1(block)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member without a time."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


@dataclass
class ShardFiles:
    """The files of one shard, rolled by compressed size; done() gives their manifest rows."""

    folder: str
    shard: int
    limit: int
    attempt: str
    rows: list[tuple] = field(default_factory=list)
    out: pa.NativeFile | None = None

    def add(self, page_id: int | None, data: bytes) -> None:
        m = member(data)
        if self.out is not None and self.size + len(m) > self.limit:
            self.close()
        if self.out is None:
            self.name = f"part-{self.shard:06d}-{len(self.rows):04d}.warc.gz"
            self.fs, path = place(self.folder)
            self.temp, self.final = f"{path}/.{self.name}.{self.attempt}", f"{path}/{self.name}"
            self.out, self.size, self.n, self.ids, self.sum = self.fs.open_output_stream(self.temp, compression=None), 0, 0, [], hashlib.sha256()
        self.out.write(m)
        self.sum.update(m)
        self.size, self.n = self.size + len(m), self.n + 1
        if page_id is not None:
            self.ids = [*self.ids[:1], page_id]

    def close(self) -> None:
        self.out.close()
        try:
            self.fs.move(self.temp, self.final)
        except OSError:  # stores that don't rename onto a file: another attempt's equal file is there
            if self.fs.get_file_info(self.final).type != pafs.FileType.File:
                raise
            self.fs.delete_file(self.temp)
        ids = self.ids or [None]
        self.rows.append((self.shard, len(self.rows), f"{self.folder}/{self.name}", self.size, self.n, ids[0], ids[-1], self.sum.hexdigest()))
        self.out = None

    def done(self) -> list[tuple]:
        if self.out is not None:
            self.close()
        return self.rows


def _writer(folder: str, limit: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("shard", pa.int64()), ("file", pa.int32()), ("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())])

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, files, roles, at = f"{TaskContext.get().taskAttemptId()}.tmp", None, {}, None
        for b in batches:
            for r in b.to_pylist():
                if files is None or files.shard != r["shard"]:
                    if files is not None:
                        yield batch(files.done())
                    files = ShardFiles(folder, r["shard"], limit, attempt)
                if at != r["page_id"]:
                    at, roles = r["page_id"], {}
                if r["kind"] == 0:  # the roles of a page come before its rows
                    roles[r["digest"]] = r["refers_to"], r["url"]
                else:
                    payload = r["html"] or b""
                    files.add(r["page_id"], record(r["page_id"], r["url"], payload, *roles.get(sha1(payload), (None, None)) if roles else (None, None)))
        if files is not None:
            yield batch(files.done())

    return run


def _base32(hex40: str) -> Column:
    """The base32 form of a 40-digit hexadecimal column."""
    digit = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    parts = [F.lpad(F.conv(F.substring(hex40, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", digit)


def borders(ids: DataFrame, shards: int, count: int) -> list[int]:
    """At most shards - 1 ids that split the rows about evenly; equal for equal rows, however they are stored."""
    every = max(1, count // (shards * SAMPLE_PER_SHARD))
    s = np.sort(ids.filter(F.col("page_id").isNotNull() & (F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)).select("page_id").toPandas()["page_id"].to_numpy())
    return np.unique(s[[len(s) * i // shards for i in range(1, shards)]]).tolist() if len(s) else []


def write_warc(pages: DataFrame, folder: str, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (page_id, url, html) as an archive; returns its manifest.

    Of pages of equal payload of at least min_bytes the one with the smallest id is a response, the others revisit it;
    rows that share that smallest id are all responses. A null html is an empty payload. A row without id is
    always a response and never referred to, and lies in the last shards, by a hash; a null url leaves its header out. An empty table gives an empty
    manifest. Other columns are not read.
    """
    spark = pages.sparkSession
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    known = written(p.select("page_id", "url", F.sha1("html").alias("hex"), F.octet_length("html").cast("long").alias("n")), "payloads")
    several = known.filter((F.col("n") >= min_bytes) & F.col("page_id").isNotNull())
    first = several.groupBy("hex").agg(F.min(F.struct("page_id", "url")).alias("first"), F.max("page_id").alias("last")).filter("first.page_id < last")
    revisits = several.join(first, "hex").filter("page_id > first.page_id")
    roles = revisits.select("page_id", F.col("first.url").alias("url"), F.lit(None).cast("binary").alias("html"), F.lit(0).alias("kind"), F.col("first.page_id").alias("refers_to"), _base32("hex").alias("digest")).distinct()
    rows = p.select("page_id", "url", "html", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers_to"), F.lit(None).cast("string").alias("digest"))
    without = F.sum(F.when(F.col("page_id").isNull(), F.col("n")))
    total = known.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("bytes"), without.alias("without")).first()
    shards = int(min(MAX_SHARDS, max(1, -(-total["bytes"] // shard_bytes))))
    cuts = np.array(borders(known, shards, total["n"]), np.int64)
    more = 0 if total["without"] is None else int(min(MAX_SHARDS, max(1, -(-total["without"] // shard_bytes))))  # rows without id, dealt by hash

    @F.arrow_udf("long")
    def shard(ids: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(cuts, ids.fill_null(-(2**63)).to_numpy(), side="right"), pa.int64())

    of_hash = F.pmod(F.xxhash64("url", "html"), F.lit(max(1, more))) + len(cuts) + 1
    at = F.when(F.col("page_id").isNull(), of_hash).otherwise(shard("page_id"))
    dealt = rows.unionByName(roles).withColumn("shard", at).repartitionById(len(cuts) + 1 + more, F.col("shard").cast("int"))
    dealt = dealt.sortWithinPartitions("shard", "page_id", "kind", "url", F.xxhash64("html"))
    fs, path = place(folder)
    fs.create_dir(path, recursive=True)
    dealt.mapInArrow(_writer(folder, file_bytes), MANIFEST).write.json(f"{folder}/_manifest.tmp")
    fs.move(f"{path}/_manifest.tmp", f"{path}/_manifest")
    return spark.read.schema(MANIFEST).json(f"{folder}/_manifest")


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record of an uncompressed stream; names of headers in lower case."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.decode().partition(":")
            head[k.lower()] = v.strip()
        block = stream.read(int(head["content-length"]))
        if head["warc-block-digest"] != f"sha1:{sha1(block)}":
            raise ValueError(f"block digest of {head['warc-record-id']}")
        yield head, block


def _read(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [x.split()[0] for x in RECORDS.split(", ")] + ["payload"] * payloads

    def row(head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        digest, n = head["warc-payload-digest"].removeprefix("sha1:"), int(http.rpartition(b"Content-Length: ")[2])
        if head["warc-type"] == "response" and (digest, n) != (sha1(payload), len(payload)):
            raise ValueError(f"payload of {head['warc-record-id']}")
        number = lambda k: int(head[k]) if k in head else None
        return (number("x-page-id"), head.get("warc-target-uri"), head["warc-type"], number("x-refers-to-page-id"), n, digest) + ((payload,) if payloads else ())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri in b.column(0).to_pylist():
                fs, path = place(uri)
                rows, size = [], 0
                with fs.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for head, block in records(stream):
                        rows.append(row(head, block))
                        size += len(block)
                        if len(rows) >= 2000 or size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                if rows:
                    yield batch(rows)

    return run


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """The records of an archive that write_warc has committed; checks every digest. A revisit's payload is empty."""
    files = spark.read.schema(MANIFEST).json(f"{folder}/_manifest").select("path")
    dealt = files.repartition(max(1, files.count()))
    return dealt.mapInArrow(_read(payloads), RECORDS + ", payload binary" * payloads)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


#: The digest's base 32 in DuckDB: five bits at a time out of two hexadecimal digits.
ORACLE = """WITH p AS (SELECT page_id, url, coalesce(html, '') AS html, list_transform(range(1, 41), lambda i: instr('0123456789abcdef', sha1(coalesce(html, ''))[i]) - 1) AS digits FROM pages),
  r AS (SELECT *, CASE WHEN page_id IS NOT NULL THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
  SELECT page_id, url, strlen(html) AS payload_bytes, list_aggregate(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((digits[5 * i // 4 + 1] * 16 + digits[5 * i // 4 + 2]) >> (3 - 5 * i % 4)) & 31) + 1]), 'string_agg', '') AS payload_digest,
    CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM r"""
