"""Mixing sources to target weights, by blocks.

The words of each source, document after document, are cut into blocks of fixed length. The mix is a row of
output shards of equally many slots; a shard's slots are dealt to the sources by a multinomial draw. Slot k of a
source takes block permutation(k) of it, a new pseudorandom permutation for every pass over the source, and slots
and blocks are joined by index. A source has exactly as many slots as its target asks for: draws beyond that number
are cut, and what a source still lacks after the last draw goes to a closing shard. No block is taken more often
than its source's target over its size, rounded up, so at most `limit` times.

Documents are ordered within a source by a hash chunk, then id, so that running sums need no task that holds a source.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import NOT_SPACE, SPACE, running_start, table, words_of, written

WEIGHTS, LIMIT = (1, 2, 3), 3
BLOCK, SLOTS, CHUNKS, SEED = 64, 65_536, 4096, 20_240_501
#: Slots that a task gives out, about, and the most tasks.
TASK_SLOTS, MOST_TASKS = 1 << 18, 20_000


def targets(sizes: dict, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> dict[object, float]:
    """Shares of the total size by source: sources by code point, null last, weigh `weights` in turn.

    A target stops at limit times its source's size; the excess is shared again by weight until none is above.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, free, out = sum(sizes.values()), sum(weight.values()), {}
    bound = True
    for s in sorted(order, key=lambda s: sizes[s] / weight[s]):  # by how soon the limit binds: once one is within it, so are all after it
        share = left * weight[s] / free
        bound = bound and share > limit * sizes[s]
        if bound:
            out[s] = float(limit * sizes[s])
            left, free = left - limit * sizes[s], free - weight[s]
        else:
            out[s] = float(share)
    return {s: out[s] for s in order}


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of range(n), at x: a four-round Feistel network, walked until it falls in the range."""
    half = max(1, (max(1, n - 1).bit_length() + 1) // 2)
    mask, u = np.uint64((1 << half) - 1), np.uint64

    def once(v: np.ndarray) -> np.ndarray:
        a, b = v >> u(half), v & mask
        for i in range(4):
            f = (b + u((key * 4 + i) & 0xFFFFFFFFFFFF)) * u(0x9E3779B97F4A7C15)
            f = (f ^ (f >> u(29))) * u(0xBF58476D1CE4E5B9)
            a, b = b, a ^ ((f >> u(31)) & mask)
        return (a << u(half)) | b

    out = once(x.astype(u))
    while (far := out >= u(n)).any():
        out[far] = once(out[far])
    return out.astype(np.int64)


def _draws(p: list[float], total: int, slots: int, seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for shard in pdf["id"]:
                rng = np.random.Generator(np.random.Philox(key=[seed, int(shard)]))
                c = rng.multinomial(min(slots, total - int(shard) * slots), p)
                yield pd.DataFrame({"shard": int(shard), "part": int(shard) // 1024, "s": np.arange(len(p)), "n": c})[c > 0]

    return run


def _slots(blocks: list[int], seed: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            for r in pdf.itertuples():
                for low in range(r.start, r.end, 1 << 20):
                    k = np.arange(low, min(r.end, low + (1 << 20)))
                    n, index = blocks[r.s], np.empty(len(k), np.int64)
                    for e in np.unique(k // n):
                        at = k // n == e
                        index[at] = permuted(k[at] % n, n, seed + 1_000_003 * r.s + int(e))
                    yield pd.DataFrame({"shard": r.shard, "s": r.s, "pass": k // n, "block": index})

    return run


def slots_of(spark: SparkSession, wanted: list[int], blocks: list[int], slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(shard, s, pass, block): the slots of all output shards, for wanted[s] draws from blocks[s] blocks of each source s."""
    total = sum(wanted)
    p = [w / total for w in wanted]
    shards = -(-total // slots)
    drawn = spark.range(shards).mapInPandas(_draws(p, total, slots, seed), "shard long, part long, s long, n long")
    drawn = running_start(written(drawn, "draws"), ["s"], "part", ["shard"], "n", "start")
    want = spark.createDataFrame(list(enumerate(wanted)), "s long, want long")
    dealt = drawn.join(want, "s").select("shard", "s", "start", F.least(F.col("start") + F.col("n"), "want").alias("end"))
    got = drawn.groupBy("s").agg(F.sum("n").alias("got"))
    late = want.join(got, "s", "left").select(F.lit(shards).alias("shard"), "s", F.coalesce("got", F.lit(0)).alias("start"), F.col("want").alias("end"))
    late = late.filter("start < end").withColumn("start", F.explode(F.expr(f"sequence(start, end - 1, {slots}L)"))).withColumn("end", F.least(F.col("end"), F.col("start") + slots))
    rows = dealt.filter("start < end").unionByName(late)
    tasks = min(MOST_TASKS, -(-total // TASK_SLOTS))  # said outright: rows are few and tiny before they become slots, and would be put in one task
    return rows.repartition(tasks, "shard", "s", "start").mapInPandas(_slots(blocks, seed), "shard long, s long, pass long, block long")


def _numbered(docs: DataFrame) -> DataFrame:
    """docs with row, a number of each row, written so that the number stays."""
    return written(docs.withColumn("_mix_row", F.monotonically_increasing_id()), "numbered")


def _sized(docs: DataFrame, row: Column) -> DataFrame:
    """(row, doc_id, source, size, chunk) of every document; chunk is a hash of id and text, so that rows without id spread."""
    size = F.size(words_of(F.col("text"))).cast("long")
    d = docs.select(row.alias("row"), "doc_id", "source", size.alias("size"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(CHUNKS)).alias("chunk"))
    return written(d, "sizes")


def taken_blocks(spark: SparkSession, sized: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Sources (source, source_size, target), and the taken words (row, pass, low, high): offsets within the document.

    The sources' sizes come to the driver, a row a source.
    """
    sizes = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("size").alias("n")).collect()}
    goal = targets(sizes) if sizes else {}
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    blocks = [-(-sizes[s] // block) for s in order]
    wanted = [round(goal[s] / sizes[s] * n) if n else 0 for s, n in zip(order, blocks)]
    sources = spark.createDataFrame([(s, i, sizes[s], float(goal[s])) for i, s in enumerate(order)], "source string, s long, source_size long, target double")
    if not sum(wanted):
        return sources, spark.createDataFrame([], "row long, pass long, low long, high long")
    rows = sized.filter("size > 0").join(sources.select("source", "s"), sized["source"].eqNullSafe(sources["source"])).select("row", "doc_id", "s", "size", "chunk")
    placed = running_start(rows, ["s"], "chunk", ["doc_id", "size", "row"], "size", "start")
    span = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))
    parts = placed.select("row", "s", "start", "size", F.explode(span).alias("block"))
    low, high = F.greatest("start", F.col("block") * block) - F.col("start"), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * block) - F.col("start")
    parts = parts.select("row", "s", "block", low.alias("low"), high.alias("high"))
    drawn = written(slots_of(spark, wanted, blocks, slots, seed).select("s", "pass", "block"), "slots")  # written: its size is known to the planner
    return sources, parts.join(drawn, ["s", "block"]).select("row", "pass", "low", "high")


def mix(docs: DataFrame, block: int = BLOCK, slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, source: one row per row of docs.

    Null and empty texts have size 0 and are not taken; a null source is a source, the last. Repeated rows each have
    their own words in the stream. An empty table gives an empty result. Columns other than doc_id, source and text
    are not read. Reruns over the same rows agree.
    """
    sized = _sized(docs, F.monotonically_increasing_id())
    sources, parts = taken_blocks(docs.sparkSession, sized, block, slots, seed)
    sources = sources.withColumnRenamed("source", "of")
    taken = parts.groupBy("row").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    all_rows = sized.join(taken, "row", "left").join(sources, F.col("source").eqNullSafe(F.col("of")))
    return all_rows.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "source")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as documents: for each pass over a source a row with the words taken from the document in it.

    Neighbouring blocks are one run of words. A run over the whole document has its text as it was; others have their
    words with the white space between them; a document's runs in one pass are joined by a line break. Null and empty texts
    have no words and leave the mix; rows without id or source are mixed like others, repeated rows each; an empty
    table stays empty.
    """
    cols, docs = docs.columns, _numbered(docs)
    _, parts = taken_blocks(spark, _sized(docs, F.col("_mix_row")))
    runs = parts.groupBy(F.col("row").alias("_mix_of"), "pass").agg(F.array_sort(F.collect_list(F.struct("low", "high"))).alias("_mix_runs")).drop("pass")  # blocks of one document
    rows = docs.join(runs, F.col("_mix_row") == F.col("_mix_of"))
    tokens = F.regexp_extract_all("text", F.lit(f"{SPACE}*{NOT_SPACE}+"), F.lit(0))
    text = lambda r, w: F.concat(F.when(r["low"] != r["prev"], "\n").otherwise(""), F.array_join(F.slice(w, r["low"] + 1, r["high"] - r["low"]), ""))
    linked = F.transform("_mix_runs", lambda r, i: F.struct(r["low"].cast("int").alias("low"), r["high"].cast("int").alias("high"), F.coalesce(F.get("_mix_runs", i - 1)["high"], r["low"]).cast("int").alias("prev")))
    part = F.element_at(F.transform(F.array(tokens), lambda w: F.array_join(F.transform(linked, lambda r: text(r, w)), "")), 1)
    covered = F.aggregate("_mix_runs", F.lit(0).cast("long"), lambda a, r: a + r["high"] - r["low"])
    rows = rows.withColumn("_new", F.when(covered == F.size(words_of(F.col("text"))), F.col("text")).otherwise(F.regexp_replace(part, f"^{SPACE}+", "")))
    new = {"text": F.col("_new"), "n_chars": F.when(F.col("_new") == F.col("text"), F.col("n_chars")).otherwise(F.length("_new").cast("long"))}
    return rows.select(*(new[c].alias(c) if c in new else docs[c] for c in cols))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))
