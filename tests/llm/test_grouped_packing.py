"""Packing by linear grouping: pieces against the tokenizer, sequences against their definition and lower bounds."""

import random
import zlib
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import grouped_packing as gp
from quillmark.llm.packing import default_tokenizer

SF = "/root/testdata/sf0.001"


def pieces_of(docs, length):
    from tokenizers import Tokenizer

    model, out = Tokenizer.from_file(default_tokenizer()), []
    for i, text in docs:
        ids = [*model.encode(text or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), length)):
            some = ids[a : a + length]
            out.append((i, k, a, len(some), zlib.crc32(np.array(some, "<u4").tobytes())))
    return sorted(out, key=str)


def check(df, docs, length):
    """The pieces are those of the documents, every sequence is gapless and holds at most length; the number of sequences."""
    rows = [tuple(r) for r in df.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    assert sorted((r[:5] for r in rows), key=str) == pieces_of(docs, length)
    inside = defaultdict(list)
    for r in rows:
        inside[r[5]].append((r[6], r[3]))
    for some in inside.values():
        at = 0
        for offset, n in sorted(some):
            assert offset == at
            at += n
        assert at <= length
    assert set(inside) == set(range(len(inside)))
    return len(inside)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the driver's tables")
def test_the_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    n = check(gp.query(spark, SF), docs, 2048)
    assert n <= 1.02 * -(-sum(r[3] for r in pieces_of(docs, 2048)) // 2048) + 1


def test_odd_rows(spark):
    rng = random.Random(2)
    docs = [(i, " ".join(rng.choice(["the", "of", "naïve", "東京", "x1-y2"]) for _ in range(rng.randrange(150)))) for i in range(200)]
    docs += [(None, None), (None, ""), (7, "of the"), (7, "of the"), (8, "the " * 30_000), *((500 + i, "the of the of the") for i in range(100))]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4).withColumn("length", F.lit("clash")).withColumn("part", F.lit(1))
    check(gp.pack(df, length=100, groups=12), docs, 100)
    check(gp.pack(df, length=7, groups=3), docs, 7)
    assert gp.pack(df.limit(0)).count() == 0


def test_many_starts_are_joined_as_few_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(gp, "BROADCAST_ROWS", 0)
    docs = [(i, "the of " * (i % 40)) for i in range(200)]
    check(gp.pack(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), length=64), docs, 64)


def plan_of(lengths, length, groups):
    """The plan of these lengths, held against its definition: every piece has one place, no sequence is over-full or has gaps."""
    plan = gp.Plan(np.bincount(lengths, minlength=length + 1), groups)
    lengths = np.sort(lengths)
    rank = np.arange(len(lengths)) - np.searchsorted(lengths, lengths)
    sequence, offset = plan.places(lengths, rank)
    by = np.lexsort((offset, sequence))
    s, o, n = sequence[by], offset[by], lengths[by]
    first = np.concatenate([[True], s[1:] != s[:-1]])
    assert (o[first] == 0).all() and (o[1:][~first[1:]] == (o + n)[:-1][~first[1:]]).all() and (o + n).max() <= length
    assert plan.n_sequences == len(np.unique(s)) and s.max() == plan.n_sequences - 1
    return plan


@pytest.mark.parametrize("seed", range(12))
def test_random_lengths(seed):
    rng = np.random.default_rng(seed)
    length = int(rng.choice([1, 2, 9, 64, 500, 2048]))
    low = int(rng.integers(1, length + 1))
    plan_of(rng.integers(low, int(rng.integers(low, length + 1)) + 1, int(rng.integers(1, 4000))), length, int(rng.integers(1, 40)))


@pytest.mark.parametrize("low,high,share", [(1, 2048, 1.008), (300, 1500, 1.01), (500, 1000, 1.045), (1, 300, 1.001), (683, 1024, 1.0)])
def test_near_the_lower_bound(low, high, share):
    lengths = np.random.default_rng(0).integers(low, high + 1, 60_000)
    bound = len(lengths) / 2 if low == 683 else max(lengths.sum() / 2048, (lengths > 1024).sum())
    assert plan_of(lengths, 2048, gp.GROUPS).n_sequences <= share * bound + 2


def test_configurations_beat_longest_first():
    """1000, 548 and 500 fill a sequence; longest first pairs the 1000s and needs 3250."""
    assert plan_of(np.repeat([1000, 548, 500], 3000), 2048, gp.GROUPS).n_sequences <= 3040


def test_the_plan_does_not_grow_with_the_documents():
    counts = np.bincount(np.random.default_rng(1).integers(1, 2049, 50_000), minlength=2049)
    few, many = gp.Plan(counts, 32), gp.Plan(counts * 1_000_000, 32)
    assert len(many.records) < 2 * len(few.records) and many.n_sequences < few.n_sequences * 1_001_000


def test_programme_is_optimal():
    """Sizes 5 and 3 in 11, equal demands: (5, 3, 3) and (5, 5) are best, 0.75 sequences for a pair."""
    rows, x = gp.programme(np.array([5, 3]), np.array([1000.0, 1000.0]), 11)
    assert abs(x.sum() - 750) < 1 and (rows @ np.array([5, 3]) <= 11).all()
