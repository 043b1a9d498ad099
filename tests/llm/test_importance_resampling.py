"""Importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmark.llm import importance_resampling as ir

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return len(words), [zlib.crc32(" ".join(words[i : i + k]).encode()) % 10000 for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain(docs, target):
    of_docs, of_target = [features(t) for _, t in docs], Counter(b for t in target for b in features(t)[1])
    corpus = Counter(b for _, f in of_docs for b in f)
    s, t = sum(corpus.values()), sum(of_target.values())
    gain = [math.floor(1000 * math.log((of_target[b] + 1.0) * (s + 10000.0) / ((corpus[b] + 1.0) * (t + 10000.0)))) for b in range(10000)]
    rows = []
    for (i, _), (n, f) in zip(docs, of_docs):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    drawn = sorted((r for r in rows if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(drawn[: len(drawn) * 5 // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert got(ir.query(spark, SF)) == plain(docs, target)


def test_odd_rows(spark):
    rng = random.Random(5)
    words = ["a", "É", "é", "A", "ß", "日本", "x" * 70, "y" * 5000, "9", "_", "-", "\x00", " ", "the", "der", ",", "\n\t"]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "  ", "", "; "]) for _ in range(rng.randrange(60)))) for i in range(300)]
    docs += [(None, None), (None, ""), (7, "w " * 40), (7, "w " * 40), (None, "w " * 40), (None, "w " * 40), (9, " ".join(f"w{i % 977}" for i in range(200_000))), (10, "z" * 300_000)]
    docs += [(1000 + i, "same words here " * 10) for i in range(200)]
    target = ["the a É日本 der", None, "", "x" * 70 + " w w w"]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(5).withColumn("score", F.lit("clash")).withColumn("target", F.lit(1))
    t = spark.createDataFrame([(x,) for x in target], "text string")
    assert got(ir.resample(d, t)) == plain(docs, target)
    assert got(ir.resample(d, t.limit(0))) == plain(docs, [])
    assert ir.resample(d.limit(0), t).count() == 0


def test_ranks_where_no_bound_is_met(spark):
    """All scores equal: the bound holds all rows, and ties go to smaller ids, split over ranges."""
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("score"))
    out = {r["doc_id"]: r["rank"] for r in ir.ranked(rows, F.lit(True), 5).collect()}
    assert out == {i: i + 1 if i < 50 else None for i in range(1000)}


@pytest.mark.parametrize("kept,fewest", [(0, 1), (3, 1), (1000, 1), (1000, 4)])
def test_any_dictionary_gives_the_same_payloads(kept, fewest, monkeypatch):
    monkeypatch.setattr(ir, "BYTES", 50)
    monkeypatch.setattr(ir, "BLOCK", 7)
    rng = random.Random(1)
    texts = [" ".join(rng.choice(["a", "ab", "abc", "b", "bc", "é", "x" * 80]) for _ in range(rng.randrange(40))) for _ in range(50)]
    words = ir.Dictionary(kept, fewest)
    for _ in range(3):
        flat, text = ir.words_of(pa.array([*texts, None]))
        crc, length = ir.payloads(words, flat)
        assert crc.tolist() == [zlib.crc32(w.encode()) for t in texts for w in t.split()] and length.tolist() == [len(w.encode()) for t in texts for w in t.split()]
        found = Counter((int(t), int(b)) for ts, bs in ir.runs(crc, length, text) for t, b in zip(ts, bs))
        assert found == Counter((i, b) for i, t in enumerate(texts) for b in features(t)[1])
    assert len(words.crc) <= kept


def test_crc_of_long_continuations():
    rng = np.random.default_rng(0)
    for n in (0, 1, 63, 64, 65, 4095, 1 << 20):
        tail = rng.bytes(n)
        joined = ir.advance()(np.array([zlib.crc32(b"head")], np.uint32), np.array([n])) ^ np.uint32(zlib.crc32(tail))
        assert int(joined[0]) == zlib.crc32(b"head" + tail)
