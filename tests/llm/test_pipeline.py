"""The pipeline over a small corpus: every stage's decisions take effect."""

import random

from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmark.llm import packing
from quillmark.llm.common import written
from test_brute_force import exact_components


def test_stages(spark, tmp_path):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(80)), "en", f"s{i % 3}", 0) for i in range(30)]
    rows += [(100, base, "en", "s0", 0), (101, base + " more", "en", "s1", 0), (102, "too short", "en", "s2", 0), (103, base[: len(base) // 2] + " password=abcdefghijkl0123 end " + " ".join(f"q{j}" for j in range(60)), "en", "s2", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == before
        seen[name] = docs.toPandas()
    assert 102 not in set(seen["quality rules"]["doc_id"]) and {100, 101} <= set(seen["quality rules"]["doc_id"])
    assert 101 not in set(seen["near-duplicates"]["doc_id"]) and 100 in set(seen["near-duplicates"]["doc_id"])
    assert not seen["secrets"]["text"].str.contains("abcdefghijkl0123").any() and seen["secrets"]["text"].str.contains("[SECRET]", regex=False).any()
    assert len(seen["mixing"]) > 0
    out = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert (out["offset"] + out["length"] <= 2048).all() and set(out["doc_id"]) <= set(seen["mixing"]["doc_id"]) | set(seen["secrets"]["doc_id"])


def test_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_holds_the_words_that_each_stage_leaves(spark, tmp_path):
    """run() against plain Python: base rules and near-duplicates decide by brute force, and every taken word is packed once."""
    rng = random.Random(12)
    rows = []
    for i in range(120):
        words = [f"w{rng.randint(0, 400)}x{i}" for _ in range(rng.choice([30, 70, 150]))]
        rows.append((i, " ".join(words), "en", f"s{i % 3}", 0))
    rows += [(200 + i, rows[i][1] + " more", "en", "s0", 0) for i in range(0, 40, 2)] + [(300, None, "en", "s1", None), (301, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    long = {i: t for i, t, *_ in rows if t and len(t.split()) >= 50}
    kept = {i for i, (_, c) in exact_components(long).items() if i == c}
    steps, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps = written(stage(spark, steps, str(tmp_path)), "stage")
        seen[name] = [(r["doc_id"], r["text"]) for r in steps.collect()]
    assert {i for i, _ in seen["quality rules"]} == set(long)
    assert {i for i, _ in seen["near-duplicates"]} == kept and dict(seen["near-duplicates"]) == {i: long[i] for i in kept}
    assert dict(seen["secrets"]) == dict(seen["near-duplicates"])
    own = {i: set(t.split()) for i, t in long.items()}
    assert all(set(t.split()) <= own[i] for i, t in seen["mixing"])
    tokens = sum(len(e.ids) + 1 for e in Tokenizer.from_file(packing.default_tokenizer()).encode_batch([t for _, t in seen["mixing"]], add_special_tokens=False))
    assert corpus_pipeline.run(spark, str(tmp_path)).agg(F.sum("length")).first()[0] == tokens
