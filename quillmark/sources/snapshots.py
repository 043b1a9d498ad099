"""Tables that change by whole versions: a reader sees one version, a failed job leaves the last, and two writers can't both follow it.

A table is a folder. Every version is a manifest that names the files of a base and of the changes since, in order: rows to put in
by key, and keys to take out. A change is written first, into files of its own, and becomes a version when its manifest gets the
next number, which only one writer can. Reading takes what the base holds of keys without a change, and of each changed key the
last change; compaction makes that a base.
"""

from __future__ import annotations

import json
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another writer has committed since this one has read."""


class Snapshots:
    """A table at a path that all executors share, with rows told apart by the columns `key`, nulls included."""

    def __init__(self, spark: SparkSession, path: str, key: list[str]):
        self.spark, self.path, self.key = spark, path.rstrip("/"), key
        jvm = spark.sparkContext._jvm
        self._at = jvm.org.apache.hadoop.fs.Path
        self.fs = self._at(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self.fs.mkdirs(self._at(f"{self.path}/versions"))

    def _of(self) -> Column:
        return F.to_json(F.struct(*(F.col(k).alias(f"k{i}") for i, k in enumerate(self.key))), {"ignoreNullFields": "false"})

    def version(self) -> int:
        """The number of the last version, 0 for a table without any."""
        names = [f.getPath().getName() for f in self.fs.listStatus(self._at(f"{self.path}/versions"))]
        return max((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), default=0)

    def _manifest(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()[0]) if version else {"base": None, "changes": [], "schema": None}

    def _commit(self, parent: int, manifest: dict) -> int:
        """Gives the manifest the number after its parent's, if no other has it: a link or a rename that never replaces a file."""
        name, own = f"{self.path}/versions/{parent + 1:012d}.json", f"{self.path}/versions/{uuid.uuid4().hex}.tmp"
        stream = self.fs.create(self._at(own), False)
        stream.write(bytearray(json.dumps(manifest), "utf-8"))
        stream.close()
        try:
            if self.fs.getScheme() == "file":
                os.link(self._at(own).toUri().getPath(), self._at(name).toUri().getPath())
            elif not self.fs.rename(self._at(own), self._at(name)):
                raise FileExistsError(name)
        except FileExistsError:
            raise Conflict(f"version {parent + 1} of {self.path} has been committed by another") from None
        finally:
            self.fs.delete(self._at(own), False)
        return parent + 1

    def _written(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.path}/{name}")
        return name

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, by default the last; it stays as it is whatever is committed meanwhile."""
        m = self._manifest(self.version() if version is None else version)
        if m["schema"] is None:
            raise FileNotFoundError(f"{self.path} has no version")
        load = lambda name: self.spark.read.schema(StructType.fromJson(m["schema"])).parquet(f"{self.path}/{name}")
        base = load(m["base"])
        if not m["changes"]:
            return base
        rows = F.struct(*base.columns)
        layers = []
        for n, c in enumerate(m["changes"]):
            if c["put"]:
                layers.append(load(c["put"]).select(self._of().alias("_key"), F.lit(2 * n + 1).alias("_n"), rows.alias("_row")))
            if c["out"]:
                layers.append(self.spark.read.schema("_key string").parquet(f"{self.path}/{c['out']}").select("_key", F.lit(2 * n).alias("_n"), F.lit(None).cast(base.select(rows.alias("r")).schema["r"].dataType).alias("_row")))
        changed = layers[0]
        for layer in layers[1:]:
            changed = changed.unionByName(layer)
        # a struct that is null is told by its number: of a key the highest counts, and an even one takes the key out
        last = changed.groupBy("_key").agg(F.max("_n").alias("_n"), F.max_by("_row", "_n").alias("_row"))
        kept = base.withColumn("_key", self._of()).join(last.select("_key"), "_key", "left_anti").select(*base.columns)
        return kept.unionByName(last.filter("_n % 2 = 1").select("_row.*"))

    def create(self, rows: DataFrame) -> int:
        """Version 1."""
        return self._commit(0, {"base": self._written(rows, "base"), "changes": [], "schema": rows.schema.jsonValue()})

    def change(self, put: DataFrame | None = None, out: DataFrame | None = None, parent: int | None = None) -> int:
        """The version after `parent` (the last, by default) with the rows of `put` in place of those of equal key, and without the keys of `out`.

        A key in both is put. Of several rows of `put` with one key any may stay, so it should have one. Raises Conflict if
        there is a version after `parent`; then the rows should be made anew from that one.
        """
        parent = self.version() if parent is None else parent
        m = self._manifest(parent)
        columns = StructType.fromJson(m["schema"]).names
        change = {"put": self._written(put.select(*columns), "put") if put is not None else None, "out": self._written(out.select(self._of().alias("_key")).distinct(), "out") if out is not None else None}
        return self._commit(parent, m | {"changes": [*m["changes"], change]})

    def compact(self) -> int:
        """The same rows as a base without changes. Files of earlier versions stay for their readers."""
        parent = self.version()
        return self._commit(parent, self._manifest(parent) | {"base": self._written(self.read(parent), "base"), "changes": []})
