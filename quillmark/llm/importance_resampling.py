"""Resampling of a corpus towards a target by importance weights of hashed word runs.

1. A dictionary automaton (Aho-Corasick) holds the distinct words that a worker has met, each between two spaces, so that a
   scan of a text reports whole words alone. A word's payload is the CRC-32 and the length of its bytes.
2. The payloads of adjacent words are composed: the CRC of a run of words is that of its first part, advanced by the bytes
   that follow, combined with theirs. So the bucket of a run needs no string of it, and a scan of a batch is a few NumPy
   expressions over the payloads in the order of the words.
3. Bucket counts of corpus and target, summed in each task and then over tasks, give every bucket a gain; a second scan
   adds the gains of a document's runs, and a Gumbel draw seeded by its id turns the weight into a sampling score.
4. The highest scores are ranked without sorting all of them: a bound that enough scores reach, rows above it
   sorted by range, ranks within a range and a running sum over ranges.

A dictionary is only a way to the payloads: a word that it lacks lies between two words found, or at an end, and gets its
payload from its bytes. So results depend neither on which words a dictionary holds nor on its bound.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import running_start, table, written

BUCKETS, LONGEST = 10_000, 3
#: Words whose payloads a worker keeps, none longer than LONG bytes, and new ones that it meets before it builds the automaton anew.
WORDS_KEPT, LONG, FEWEST = 100_000, 64, 2048
#: Bytes of text, and words, that are scanned and composed at once; texts of one batch.
BYTES, BLOCK, ROWS = 1 << 20, 1 << 18, 500
SPACE = 0x20
#: Bytes of a word as they are, A-Z lowered, and all others as spaces.
FOLD = np.array([b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else SPACE for b in range(256)], np.uint8)


class Advance:
    """What a CRC-32 becomes when n more bytes follow, up to their own part: a linear map of its 32 bits, kept as tables by byte."""

    def __init__(self):
        step = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)
        few = [np.arange(256, dtype=np.uint32)[None, :] << np.array([0, 8, 16, 24], np.uint32)[:, None]]
        for _ in range(64):
            few.append((few[-1] >> 8) ^ step[few[-1] & 255])
        self.few, self.doubled = np.array(few[:64]), [few[64]]

    @staticmethod
    def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
        return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        low = n & 63
        out = self.few[low, 0, crc & 255] ^ self.few[low, 1, crc >> 8 & 255] ^ self.few[low, 2, crc >> 16 & 255] ^ self.few[low, 3, crc >> 24]
        high, bit = n >> 6, 0
        while (high >> bit).any():
            if bit == len(self.doubled):
                self.doubled.append(self._apply(self.doubled[-1], self.doubled[-1]))
            some = np.flatnonzero(high >> bit & 1)
            out[some] = self._apply(self.doubled[bit], out[some])
            bit += 1
        return out


class Dictionary:
    """The words that a worker has met, and the automaton that finds them; texts and words are bytes, read as Latin-1."""

    def __init__(self, kept: int = WORDS_KEPT, fewest: int = FEWEST):
        import ahocorasick

        self.kept, self.fewest, self.automaton, self.new = kept, fewest, ahocorasick.Automaton(), {}
        self.crc, self.length = np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def _learn(self) -> None:
        words = list(self.new)[: self.kept - len(self.crc)]
        for i, w in enumerate(words, len(self.crc)):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        self.automaton.make_automaton()
        self.crc = np.concatenate([self.crc, np.array([*map(zlib.crc32, words)], np.uint32)])
        self.length = np.concatenate([self.length, np.array([*map(len, words)], np.int64)])
        self.new = {}

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """CRC and length of every word of a text, in order. Its words have one space between, one before and one behind all."""
        found = self.automaton.iter(text.decode("latin-1")) if len(self.crc) else ()
        hits = np.fromiter(chain.from_iterable(found), np.int64).reshape(-1, 2)
        end, word = hits[:, 0], hits[:, 1]
        crc, length = self.crc[word], self.length[word]
        left, right = np.concatenate([[0], end]), np.concatenate([end - length - 1, [len(text) - 1]])
        holes = np.flatnonzero(right > left)
        if len(holes):
            parts = [text[a + 1 : z].split(b" ") for a, z in zip(left[holes].tolist(), right[holes].tolist())]
            at, others = np.repeat(holes, [*map(len, parts)]), [*chain.from_iterable(parts)]
            crc = np.insert(crc, at, np.array([*map(zlib.crc32, others)], np.uint32))
            length = np.insert(length, at, np.array([*map(len, others)], np.int64))
            if len(self.crc) < self.kept:
                self.new |= dict.fromkeys(w for w in others if len(w) <= LONG)
                if len(self.new) >= max(self.fewest, len(self.crc) // 2):
                    self._learn()
        return crc, length


@cache
def dictionary() -> Dictionary:
    """One for each Python worker, which outlives its tasks."""
    return Dictionary()


@cache
def advance() -> Advance:
    return Advance()


def words_of(texts: pa.Array) -> tuple[bytes, np.ndarray]:
    """All words of the texts with one space around each, and the text of each word. Null counts as empty."""
    texts = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    borders = ends - ends[0] + np.arange(len(ends))
    flat, inside = np.full(len(data) + len(ends), SPACE, np.uint8), np.ones(len(data) + len(ends), bool)
    inside[borders] = False
    flat[inside] = FOLD[data]
    space = flat == SPACE
    text = np.searchsorted(borders, np.flatnonzero(space[:-1] & ~space[1:]), "right") - 1
    once = np.concatenate([[True], ~(space[1:] & space[:-1])])
    return flat[once].tobytes(), text


def payloads(words: Dictionary, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    """CRC and length of all words, scanned in stretches that end at a space."""
    crc, length, a = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
    while a < len(flat) - 1:
        z = flat.find(b" ", min(a + BYTES, len(flat) - 1))
        c, n = words.scan(flat[a : z + 1])
        crc.append(c)
        length.append(n)
        a = z
    return np.concatenate(crc), np.concatenate(length)


def runs(crc: np.ndarray, length: np.ndarray, text: np.ndarray, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Text and bucket of all runs of one to LONGEST words of a text, in blocks."""
    move = advance()
    for a in range(0, len(crc), BLOCK):
        own, run = text[a : a + BLOCK], crc[a : a + BLOCK]
        yield own, run % buckets
        for k in range(1, LONGEST):
            n = min(len(own), len(crc) - k - a)
            if n <= 0:
                break
            following, bytes_ = crc[a + k : a + k + n], length[a + k : a + k + n]
            spaced = move(np.full(n, zlib.crc32(b" "), np.uint32), bytes_) ^ following
            run = move(run[:n], bytes_ + 1) ^ spaced
            same = text[a + k : a + k + n] == own[:n]
            yield own[:n][same], run[same] % buckets


def _batches(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, Iterator]]:
    """Slices of the batches, with the words of each of their texts and the runs of all."""
    words = dictionary()
    for whole in batches:
        for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
            flat, text = words_of(b.column(column))
            crc, length = payloads(words, flat)
            yield b, np.bincount(text, minlength=b.num_rows), (crc, length, text)


def _counts(buckets: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for b, _, found in _batches(batches, 1):
            target = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for text, bucket in runs(*found, buckets):
                counts += np.bincount(target[text] * buckets + bucket, minlength=2 * buckets).reshape(2, -1)
        target, bucket = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(target == 1), pa.array(bucket), pa.array(counts[target, bucket])], ["target", "bucket", "n"])

    return run


def _weights(gains: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    gains = gains.astype(float)  # whole numbers, whose sums are exact up to 2 ** 53

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, n_words, found in _batches(batches, 1):
            weight = np.zeros(b.num_rows)
            for text, bucket in runs(*found, len(gains)):
                weight += np.bincount(text, gains[bucket], b.num_rows)
            n_runs = sum(np.maximum(n_words - k, 0) for k in range(LONGEST))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words.astype(np.int64)), pa.array(n_runs.astype(np.int64)), pa.array(weight.astype(np.int64))], ["doc_id", "n_words", "n_features", "weight"])

    return run


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket, in thousandths of a nat: the smoothed share of the target's runs against that of the corpus.

    A task gives out one count a bucket, and the driver gets one a bucket: their number does not grow with the tables.
    """
    texts = docs.select(F.lit(False).alias("target"), "text").unionAll(target.select(F.lit(True).alias("target"), "text"))
    sums = texts.mapInArrow(_counts(buckets), "target boolean, bucket long, n long").groupBy("target", "bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, buckets), np.int64)
    for r in sums.collect():
        counts[int(r["target"]), r["bucket"]] = r["n"]
    (corpus, wanted), (of_corpus, of_target) = counts, counts.sum(1).tolist()
    of = [(w + 1.0) * (of_corpus + float(buckets)) / ((c + 1.0) * (of_target + float(buckets))) for c, w in zip(corpus.tolist(), wanted.tolist())]
    return np.array([math.floor(1000 * math.log(x)) for x in of], np.int64)


def gumbel(seed: int) -> Column:
    """A draw from the Gumbel distribution, in thousandths, that a document's id and the seed decide; no id counts as an empty one."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def ranked(scored: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """scored, a written table, with the rank of the percent highest scores among eligible rows; null for others.

    The bound comes from an approximate quantile and is confirmed by a count; if too few rows reached it, all would be
    sorted. Equal rows are told apart by a number, so that ranges can split any number of ties.
    """
    share = max(0.0, 1 - percent / 100 * 1.1 - 0.001)
    n, bound = scored.filter(eligible).agg(F.count("*"), F.percentile_approx("score", share, 10_000)).first()
    k = n * percent // 100
    above = eligible & (F.col("score") >= F.lit(bound))
    if scored.filter(above).count() < k:
        above = eligible
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("_row")]
    top = scored.filter(above).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    top = written(top.withColumn("_chunk", F.spark_partition_id()).withColumn("_one", F.lit(1)), "ranges")
    top = running_start(top, [], "_chunk", order, "_one", "_before")
    rank = F.when(F.col("_before") < k, F.col("_before") + 1).cast("long")
    rest = scored.filter(~F.coalesce(above, F.lit(False))).withColumn("rank", F.lit(None).cast("long"))
    return top.withColumn("rank", rank).select(*rest.columns).unionByName(rest)


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = 42, buckets: int = BUCKETS) -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank; rank is null unless the document is drawn.

    percent: of the documents with least_words words, as many are drawn without replacement, with chances in proportion to
    their importance. docs has doc_id and text, target has text; other columns are not read. A null text, in either table,
    has no words. A null id is drawn as an empty one and comes last among ties. Repeated rows are rows of their own, of equal
    score and following ranks. Without documents there are no rows; without a target all weights follow from
    the corpus alone. A text of any length is scanned in stretches.
    """
    gain = gains(docs, target, buckets)
    scored = docs.select("doc_id", "text").mapInArrow(_weights(gain), "doc_id long, n_words long, n_features long, weight long")
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(seed)), "scores")
    return ranked(scored, F.col("n_words") >= least_words, percent)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The whole result in DuckDB: the CRC of every distinct run byte by byte, with a table made by its rule.
ORACLE = f"""WITH t AS (SELECT list(c ORDER BY i) AS crc FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(i))),
  w AS (SELECT row_number() OVER () AS k, doc_id, false AS target, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
    UNION ALL SELECT -row_number() OVER (), NULL, true, regexp_extract_all(translate(coalesce(text, ''), '{LETTERS}', '{LETTERS.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
  f AS (SELECT k, target, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: concat(w[i], ' ', w[i + 1])), list_transform(range(1, len(w) - 1), lambda i: concat(w[i], ' ', w[i + 1], ' ', w[i + 2])))) AS f FROM w),
  d AS (SELECT f, list_prepend(4294967295, list_transform(range(1, len(h), 2), lambda i: 16 * (instr('0123456789ABCDEF', h[i]) - 1) + instr('0123456789ABCDEF', h[i + 1]) - 1)) AS bytes FROM (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM f))),
  b AS (SELECT f, xor(list_reduce(bytes, lambda c, x: xor(c >> 8, t.crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket FROM d, t),
  n AS (SELECT k, target, bucket, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
  s AS (SELECT bucket, sum(CASE WHEN target THEN 0 ELSE n END) AS s, sum(CASE WHEN target THEN n ELSE 0 END) AS t, sum(sum(CASE WHEN target THEN 0 ELSE n END)) OVER () AS all_s, sum(sum(CASE WHEN target THEN n ELSE 0 END)) OVER () AS all_t FROM n GROUP BY bucket),
  g AS (SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(all_s AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(all_t AS DOUBLE) + 10000)))) AS BIGINT) AS gain FROM s),
  x AS (SELECT k, sum(n.n * gain) AS weight FROM n JOIN g USING (bucket) GROUP BY k),
  scored AS (SELECT k, doc_id, len(w) AS n_words, CAST(len(w) + greatest(len(w) - 1, 0) + greatest(len(w) - 2, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256(concat('42:', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN x USING (k) WHERE NOT target),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY n_words >= 20) AS all_n FROM scored)
  SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND place <= all_n * 5 // 100 THEN place END AS rank FROM ranked"""
