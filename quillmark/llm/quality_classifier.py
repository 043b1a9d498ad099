"""Quality classifier: naive Bayes features for a linear support vector machine (NB-SVM).

A document is the set of its hashed n-grams: characters (one to three bytes), words and word pairs; a word that
repeats its predecessor also counts as a pair of its own. Indicators are scaled by the log-count ratio of the classes
and the vector to unit length. A hinge-loss model is fitted by dual coordinate descent; a logistic curve, fitted on
rows that the descent didn't see, turns margins into scores.

The fit uses a bounded sample of the labelled rows: of each class at most `per_class` documents, those of smallest
hash, and at most `per_class_slots` n-grams in them. It runs in one task over that sample, which so has a bound in
bytes too; the model has the fixed size of the hash space. Scoring reads every whole text where it lies.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import of_smallest_hash, table, written

BITS = 18
PER_CLASS, PER_CLASS_SLOTS, EPOCHS, COST, CALIBRATE = 4000, 24_000_000, 15, 1.0, 5
CUT = 0.3
WORDS_KEPT = 300_000
ROWS = 1000
U = np.uint64
SAME = U(0x5851F42D4C957F2D)


class Words(dict):
    def __missing__(self, w: bytes) -> int:
        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def _slot(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return (x >> U(64 - BITS)).astype(np.int64)


class Grams:
    """The sorted slots of a text's n-grams."""

    def __init__(self) -> None:
        self.words, self.seen = Words(), np.zeros(1 << BITS, bool)

    def __call__(self, text: bytes) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        b = np.frombuffer(text, np.uint8).astype(U)
        codes = [b + U(1 << 24)]
        if len(b) > 1:
            codes.append(b[:-1] | b[1:] << U(8) | U(1 << 25))
        if len(b) > 2:
            codes.append(b[:-2] | b[1:-1] << U(8) | b[2:] << U(16) | U(1 << 26))
        if words := text.split():
            h = np.fromiter(map(self.words.__getitem__, words), U, len(words))
            codes.append(h)
            if len(h) > 1:
                codes.append(h[:-1] * U(0x9E3779B97F4A7C15) + h[1:])
                if (h[:-1] == h[1:]).any():
                    codes.append(np.array([SAME]))
        if len(self.words) > WORDS_KEPT:
            self.words.clear()
        for c in codes:
            self.seen[_slot(c)] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out.astype(np.int32)


@dataclass
class Model:
    """score = 1 / (1 + exp(-(slope * margin + shift))), margin = sum of `weight` over the slots / length by `ratio` + bias."""

    weight: np.ndarray
    ratio: np.ndarray
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0

    def margin(self, g: np.ndarray) -> float:
        r = self.ratio[g]
        n = float(np.sqrt(r @ r))
        return (float(self.weight[g].sum()) / n if n else 0.0) + self.bias

    def score(self, g: np.ndarray) -> float:
        return 1.0 / (1.0 + float(np.exp(-np.clip(self.slope * self.margin(g) + self.shift, -30.0, 30.0))))


def descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 7) -> np.ndarray:
    """Dual coordinate descent for the hinge loss; the last weight is that of a constant feature."""
    w, alpha, rng = np.zeros((1 << BITS) + 1), np.zeros(len(y)), np.random.default_rng(seed)
    length = np.array([float(v @ v) + 1.0 for v in values])
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            x, v = rows[i], values[i]
            gradient = y[i] * (w[x] @ v + w[-1]) - 1.0
            new = min(max(alpha[i] - gradient / length[i], 0.0), cost[i])
            if step := (new - alpha[i]) * y[i]:
                w[x] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def fit(labels: np.ndarray, grams: list[np.ndarray], share: float, epochs: int = EPOCHS) -> Model:
    """labels: 0 or 1; share: that of label 1 among all labelled rows, which the calibration restores."""
    y = 2.0 * labels - 1.0
    flat = Model(np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.float32))
    if not (0 < labels.sum() < len(labels)):
        flat.shift = float(np.log((share + 0.01) / (1.01 - share)))
        return flat
    held = np.arange(len(y)) % CALIBRATE == 0
    if min(labels[held].sum(), (1 - labels[held]).sum(), labels[~held].sum(), (1 - labels[~held]).sum()) == 0:
        held[:] = False
    train = np.flatnonzero(~held)
    counts = np.ones((2, 1 << BITS))
    for i in train:
        counts[int(labels[i]), grams[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    values = []
    for i in train:
        v = ratio[grams[i]]
        values.append((v / max(1e-12, float(np.sqrt(v @ v)))).astype(np.float32))
    each = np.where(y[train] > 0, 0.5 / (y[train] > 0).mean(), 0.5 / (y[train] < 0).mean())
    w = descend([grams[i] for i in train], values, y[train], COST * each, epochs)
    model = Model((w[:-1] * ratio).astype(np.float32), ratio.astype(np.float32), float(w[-1]))
    use = np.flatnonzero(held) if held.any() else train
    m, t = np.array([model.margin(grams[i]) for i in use]), labels[use].astype(float)
    weight = np.where(t > 0, share / t.mean(), (1 - share) / (1 - t.mean()))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps, slightly regularised
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([(weight * (p - t) * m).sum() + 1e-2 * a, (weight * (p - t)).sum()])
        q = weight * p * (1 - p)
        h = np.array([[(q * m * m).sum() + 1e-2, (q * m).sum()], [(q * m).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    model.slope, model.shift = float(max(a, 0.0)), float(b)
    return model


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def sample_ids(labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, label, share) of the rows to fit on: of each class at most per_class, in no fold that is held out."""
    rows = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("quality").alias("label"))
    rows = written(rows, "labelled")
    share = rows.agg(F.avg("label")).first()[0]
    of_class = [of_smallest_hash(rows.filter(F.col("label") == c), "doc_id", per_class) for c in (0, 1)]
    return of_class[0].unionByName(of_class[1]).select("doc_id", "label", F.lit(0.5 if share is None else float(share)).alias("share"))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    grams = Grams()
    for b in batches:
        found = [grams(t or b"").tobytes() for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary()), b.column(2), b.column(3)], ["doc_id", "grams", "label", "share"])


def _fitted(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    pdf = pd.concat([pd.DataFrame({"doc_id": [], "grams": [], "label": [], "share": []}), *it]).sort_values(["doc_id", "grams"])
    m = fit(pdf["label"].to_numpy(float), [np.frombuffer(g, np.int32) for g in pdf["grams"]], float(pdf["share"].iloc[0]) if len(pdf) else 0.5)
    yield pd.DataFrame({"weight": [m.weight.tobytes()], "ratio": [m.ratio.tobytes()], "bias": [m.bias], "slope": [m.slope], "shift": [m.shift]})


def bounded(features: DataFrame, slots: int) -> DataFrame:
    """The rows of features (u, doc_id, grams, label, share) to fit on: one of each document, up to `slots` n-grams in each class by hash of the id.

    Features is a written table, u a number of its rows. Only ids and sizes, of at most per_class documents a class, are
    sorted in one task.
    """
    f = features.select("u", "doc_id", "label", (F.octet_length("grams") / 4).alias("n"), F.xxhash64("grams").alias("h"))
    one = f.withColumn("one", F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "u"))).filter("one = 1")
    upto = F.sum("n").over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    chosen = one.withColumn("upto", upto).filter(F.col("upto") <= slots).select("u")
    return features.join(F.broadcast(chosen), "u", "left_semi").drop("u")  # at most 2 * per_class numbers


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, per_class_slots: int = PER_CLASS_SLOTS) -> Model:
    """The model of the documents with a quality label; only the model comes to the driver.

    Labels other than 0 and 1 are left out; of several labels of a document the largest holds, of several texts the one
    whose n-grams have the smallest hash. Without rows of both classes every score is the share of label 1, or a half.
    """
    ids = F.broadcast(sample_ids(labels, per_class))  # at most 2 * per_class rows
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text")).join(ids, "doc_id")
    features = rows.select("doc_id", "text", "label", "share").mapInArrow(_features, "doc_id long, grams binary, label int, share double")
    features = written(features.withColumn("u", F.monotonically_increasing_id()), "grams")
    r = bounded(features, per_class_slots).repartition(1).mapInPandas(_fitted, "weight binary, ratio binary, bias double, slope double, shift double").first()
    if r is None:  # no labelled document
        return fit(np.empty(0), [], 0.5)
    return Model(np.frombuffer(r["weight"], np.float32), np.frombuffer(r["ratio"], np.float32), r["bias"], r["slope"], r["shift"])


def score(docs: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """doc_id, held_out, score, predicted: one row per row of docs. Null and empty texts are sets without n-grams."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, m = Grams(), shared.value
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                s = np.array([m.score(grams(t or b"")) for t in b.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(s, pa.float64()), pa.array((s >= cut).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), held_out(F.col("doc_id")).alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
