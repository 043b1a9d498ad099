"""Tables of versions: readers, failed jobs, rival writers."""

import threading

import pytest
from pyspark.sql import functions as F

from quillmark.sources.scratch import scratch
from quillmark.sources.snapshots import Conflict, Snapshots
from quillmark.sources.tables import load_register


def rows(spark, *r):
    return spark.createDataFrame(list(r), "tenant_id string, code string, version string")


@pytest.fixture
def table(spark):
    return Snapshots(spark, scratch(spark, "table"), ["tenant_id", "code"])


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_changes_by_key(spark, table):
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.create(rows(spark, ("a", "1", "v1"), ("a", "2", "v1"), (None, "1", "v1"), ("b", None, "v1"))) == 1
    assert table.change(put=rows(spark, ("a", "1", "v2"), (None, "1", "v9"), ("c", "1", "v1"))) == 2
    assert table.change(out=rows(spark, ("a", "2", ""), ("c", "1", ""), ("none", "1", ""))) == 3
    assert table.change(put=rows(spark, ("a", "2", "v5")), out=rows(spark, ("a", "2", ""), ("b", None, ""))) == 4
    last = sorted([("a", "1", "v2"), ("a", "2", "v5"), (None, "1", "v9")], key=str)
    assert got(table.read()) == last
    assert got(table.read(1)) == sorted([("a", "1", "v1"), ("a", "2", "v1"), (None, "1", "v1"), ("b", None, "v1")], key=str)
    assert table.compact() == 5 and got(table.read()) == last and got(table.read(4)) == last
    assert table.change(out=table.read()) == 6 and table.read().count() == 0


def test_a_reader_keeps_its_version_and_a_failed_load_leaves_the_last(spark, table):
    load_register(rows(spark, ("a", "1", "v1"), ("a", "2", "v1"), ("b", "1", "v1")), table)
    before = table.read()
    load_register(rows(spark, ("a", "3", "v1")), table)
    assert got(before) == [("a", "1", "v1"), ("a", "2", "v1"), ("b", "1", "v1")]
    assert got(table.read()) == [("a", "3", "v1"), ("b", "1", "v1")]
    broken = rows(spark, ("a", "4", "v1")).withColumn("version", F.raise_error(F.lit("torn")).cast("string"))
    with pytest.raises(Exception, match="torn"):
        load_register(broken, table)
    assert table.version() == 2 and got(table.read()) == [("a", "3", "v1"), ("b", "1", "v1")]


def test_rival_writers_conflict(spark, table):
    table.create(rows(spark, ("a", "1", "v1")))
    won, lost = [], []

    def write(n):
        try:
            won.append((table.change(put=rows(spark, ("a", "1", f"w{n}")), parent=1), n))
        except Conflict:
            lost.append(n)

    threads = [threading.Thread(target=write, args=(n,)) for n in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert len(won) == 1 and len(lost) == 3 and table.version() == 2
    assert got(table.read()) == [("a", "1", f"w{won[0][1]}")]
