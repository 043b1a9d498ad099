"""Size-tiered compaction: arrivals become small immutable shards, runs of similar size are merged into target-sized files.

A store is a folder of Parquet files and of manifests, one for each version. A manifest names the files that make up the
table; it is written under a temporary name and renamed, so readers see a whole version or none. Files are never changed: a
merge writes new ones and commits a version without the old.

Writers fence each other. One that would commit a version first writes a claim to it, then lists the claims and looks for the
version's manifest; if there is another claim, or the manifest, it takes its claim back and begins anew from the latest
version. Of two writers at least one sees the other's claim, as both write before they list, so no version is ever
replaced; that needs a store whose listings are complete (local disks, HDFS, S3, GCS). `vacuum` removes old versions, files
that no kept version names, and what lost writers have left: files, claims and temporary manifests beyond an age.
"""

from __future__ import annotations

import json
import math
import random
import time
import uuid
from dataclasses import asdict, dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmark.llm.common import shared_dir, table
from quillmark.llm.warc import place

TARGET_BYTES, FAN, TIER_FACTOR, FLOOR_BYTES, ARRIVALS = 128 << 20, 4, 4, 64 << 10, 4
#: Seconds after which what no version names is a lost writer's.
ORPHAN_AGE = 24 * 3600


class Conflict(RuntimeError):
    """Another writer has committed, or is about to commit, the version."""


@dataclass(frozen=True)
class Shard:
    path: str
    bytes: int
    rows: int

    def tier(self) -> int:
        """Shards of one tier differ in size by at most TIER_FACTOR."""
        return max(0, math.floor(math.log(max(1, self.bytes) / FLOOR_BYTES, TIER_FACTOR)))


class Store:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.fs, self.root = place(folder)
        self.fs.create_dir(f"{self.root}/manifests", recursive=True)

    def versions(self) -> list[int]:
        files = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/manifests"))
        return sorted(int(f.base_name[1:-5]) for f in files if f.base_name.startswith("v") and f.base_name.endswith(".json"))

    def manifest(self, version: int | None = None) -> tuple[int, list[Shard], str | None]:
        """(version, shards, schema as JSON) of a version, by default the latest; version 0 is the empty store."""
        version = max(self.versions(), default=0) if version is None else version
        if not version:
            return 0, [], None
        with self.fs.open_input_stream(f"{self.root}/manifests/v{version:010d}.json") as f:
            m = json.loads(f.read())
        return version, [Shard(**s) for s in m["shards"]], m["schema"]

    def commit(self, base: int, shards: list[Shard], schema: str) -> int:
        """Makes the shards the version after base; Conflict if another writer has claimed it or been faster."""
        n = base + 1
        final, claim = f"{self.root}/manifests/v{n:010d}.json", f"{self.root}/manifests/.claim-{n:010d}-{uuid.uuid4().hex}"
        with self.fs.open_output_stream(claim) as f:
            f.write(b"claim")
        try:
            names = {f.base_name for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/manifests"))}
            if any(x.startswith(f".claim-{n:010d}-") and not claim.endswith(x) for x in names) or self.fs.get_file_info(final).type != pafs.FileType.NotFound:
                raise Conflict(f"version {n} has another writer")
            temp = f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp"
            with self.fs.open_output_stream(temp) as f:
                f.write(json.dumps({"version": n, "schema": schema, "shards": [asdict(s) for s in sorted(shards, key=lambda s: s.path)]}).encode())
            self.fs.move(temp, final)
        finally:
            self.fs.delete_file(claim)
        return n

    def _change(self, gone: set[str], new: list[Shard], schema: str, seconds: float = 600.0) -> int | None:
        """Commits a version with new and without gone, after whatever other writers commit meanwhile; None if they have taken any of gone."""
        until = time.monotonic() + seconds
        while True:
            version, shards, kind = self.manifest()
            if not gone <= {s.path for s in shards}:
                return None
            try:
                return self.commit(version, [s for s in shards if s.path not in gone] + new, kind or schema)
            except Conflict:
                if time.monotonic() > until:
                    raise
                time.sleep(random.uniform(0.01, 0.2))

    def _written(self, df: DataFrame) -> list[Shard]:
        path = f"{self.folder}/data/{uuid.uuid4().hex}"
        df.write.parquet(path)
        files = self.spark.read.schema(df.schema).parquet(path).groupBy("_metadata.file_path", "_metadata.file_size").count().collect()
        return [Shard(r[0], r[1], r[2]) for r in files]

    def append(self, df: DataFrame) -> int:
        """Adds arrivals as they are partitioned, as small shards; one version. An arrival without rows adds no shard."""
        return self._change(set(), self._written(df), df.schema.json())

    def compact(self, target: int = TARGET_BYTES, fan: int = FAN) -> int:
        """Merges tiers of fan shards or more, below half the target size, until there is none; a version for each merge.

        Every row of the shards is in the new files, which hold about the target size each; rows move to no other task.
        """
        while True:
            version, shards, schema = self.manifest()
            tiers: dict[int, list[Shard]] = {}
            for s in shards:
                if s.bytes < target / 2:
                    tiers.setdefault(s.tier(), []).append(s)
            run = next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= fan), None)
            if run is None:
                return version
            files = max(1, round(sum(s.bytes for s in run) / target))
            df = self.spark.read.schema(T.StructType.fromJson(json.loads(schema))).parquet(*(s.path for s in run))
            self._change({s.path for s in run}, self._written(df.coalesce(files)), schema)

    def read(self, version: int | None = None) -> DataFrame:
        _, shards, schema = self.manifest(version)
        if schema is None:
            raise ValueError("the store is empty")
        kind = T.StructType.fromJson(json.loads(schema))
        return self.spark.read.schema(kind).parquet(*(s.path for s in shards)) if shards else self.spark.createDataFrame([], kind)

    def vacuum(self, keep: int = 1, orphan_age: float = ORPHAN_AGE) -> int:
        """Removes manifests before the last `keep` versions, the files that only they name, and older orphans; gives the number of data files."""
        kept = self.versions()[-keep:]
        live = {place(s.path)[1] for v in kept for s in self.manifest(v)[1]}
        old = {place(s.path)[1] for v in self.versions() if v not in kept for s in self.manifest(v)[1]} - live
        lost = lambda f: f.type == pafs.FileType.File and f.mtime is not None and time.time() - f.mtime.timestamp() >= orphan_age
        data = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/data", recursive=True, allow_not_found=True))
        old |= {f.path for f in data if lost(f) and f.base_name.endswith(".parquet") and f.path not in live}
        for p in old:
            self.fs.delete_file(p)
        for v in self.versions():
            if v not in kept:
                self.fs.delete_file(f"{self.root}/manifests/v{v:010d}.json")
        for f in self.fs.get_file_info(pafs.FileSelector(f"{self.root}/manifests")):
            if f.base_name.startswith(".") and lost(f):
                self.fs.delete_file(f.path)
        return len(old)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document read back from a store that got the table in four arrivals and was compacted: doc_id, lang, source, n_chars, text_md5.

    Nulls, empty texts and repeated rows come back as they were; an empty table gives an empty result.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    store = Store(spark, shared_dir(spark, "shards"))
    for k in range(ARRIVALS):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)) == k))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.md5("text").alias("text_md5"))


ORACLE = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"
