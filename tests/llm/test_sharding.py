"""Stores of immutable shards: versions, merges, empty arrivals."""

import pytest
from pyspark.sql import functions as F

from quillmark.llm.common import shared_dir
from quillmark.llm.sharding import Store


def test_compaction_keeps_every_row(spark):
    rows = [(i, None if i % 7 == 0 else f"text {i}") for i in range(200)] + [(1, "text 1")] * 3 + [(None, "")]
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumn("path", F.lit("clash"))
    store = Store(spark, shared_dir(spark, "shards"))
    for k in range(5):
        assert store.append(d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(5)) == k).coalesce(2)) == k + 1
    before, shards, _ = store.manifest()
    assert store.append(d.limit(0)) == 6 and len(store.manifest()[1]) == len(shards) > 4
    version = store.compact(target=1 << 20)
    assert version > before and len(store.manifest()[1]) < len(shards)
    want = sorted(map(str, d.collect()))
    assert sorted(map(str, store.read().collect())) == want == sorted(map(str, store.read(before).collect()))
    assert store.vacuum() > 0 and store.versions() == [version] and sorted(map(str, store.read().collect())) == want


def test_a_version_is_never_replaced(spark):
    store = Store(spark, shared_dir(spark, "shards"))
    store.append(spark.createDataFrame([], "a long"))
    assert store.read().count() == 0
    with pytest.raises(RuntimeError):
        store.commit(0, [], "{}")
