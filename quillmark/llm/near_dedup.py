"""Near-duplicate documents by min-max hashing, confirmed on the full shingle sets.

Signatures keep both the minimum and the maximum of the hashed shingles under each permutation, so 64 hash
evaluations a shingle give 128 signature values; 32 bands of two minima and two maxima make the buckets. Two
sets of similarity 0.8 share no bucket, or look too unlike in their sketches, with a probability of some 4e-7.

The shape of the job, for groups of any size:
- Documents with the same shingle set collapse into one representative before any bucket is made.
- In a bucket no pairs of all members are emitted. In each round a few hubs, chosen by hash, are compared with the
  bucket's members of other components: by four-bit sketches of the signatures, which pass all but three in 10^7 pairs
  of similarity 0.8, then on the full sets. Links found are merged into components; hubs leave their bucket, and only
  buckets that still hold several components go on. No bucket is sorted or ranked in one task, and the number of hubs
  grows by sixteen a round, so that the number of rounds is the logarithm of the largest bucket, up to 65536 hubs.
- Once a component holds many members of a bucket, the others are checked against that whole component. Both sides are
  dealt into blocks, and a block of one meets a block of the other in a task that gives out one link a document at most;
  the component then leaves the bucket.
- What the first round has left, mostly documents that share a long passage but not enough, is dealt anew by its rarest
  shingles, in a way that loses no pair (prefix filtering). Rounds end when no bucket is left, so every
  two members of a bucket have been compared, or were already connected by links.
- Components are found by alternating stars over written tables; nothing is gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import table, written

PERMUTATIONS, BANDS = 64, 32
SIMILARITY = 80
#: Hubs a bucket: this number to the power of the round, which counts up to MOST_ROUND.
HUBS, MOST_ROUND = 16, 4
#: Before this round, what is left goes into the buckets of its rarest shingles.
REBUCKET = 1
#: A component that holds so many members of one bucket is compared as a whole, in blocks of so many documents.
LARGE, BLOCK_DOCS = 64, 512
#: A pair of similarity 0.8 agrees in 104 of 128 four-bit values on average, with a deviation of 4.4; fewer than this are left out.
SKETCH, LIKELY = 8, 82
#: Up to so many candidate ids, of eight bytes each, are broadcast to pick their texts; beyond it the ids are joined by a shuffle.
BROADCAST_IDS = 1_000_000
WORDS_KEPT = 300_000
U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the two-word shingles; one word is a shingle of its own."""
    if not words:
        return np.empty(0, U)
    h = np.fromiter(map(hashes.__getitem__, words), U, len(words))
    if len(h) == 1:
        return mix(h + U(0x9E3779B97F4A7C15))
    return np.unique(mix(h[:-1] * U(0xFF51AFD7ED558CCD) + mix(h[1:])))


def _sets(texts: pa.Array, hashes: WordHashes) -> list[np.ndarray]:
    out = []
    for t in texts:
        out.append(shingle_set((t.as_py() or b"").lower().split(), hashes))  # bytes: only A-Z change, only ASCII white space splits
    if len(hashes) > WORDS_KEPT:
        hashes.clear()
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """Minimum and maximum of every set under each permutation: 2 * PERMUTATIONS rows, a column for each set that is not empty."""
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    flat = np.concatenate(sets)
    out = np.empty((2 * PERMUTATIONS, len(sets)), U)
    for k, a in enumerate(mix(np.arange(1, PERMUTATIONS + 1, dtype=U)) | U(1)):
        x = flat * a
        out[2 * k] = np.minimum.reduceat(x, starts)
        out[2 * k + 1] = np.maximum.reduceat(x, starts)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each set."""
    rows = 2 * PERMUTATIONS // BANDS
    keys = np.tile(np.arange(BANDS, dtype=U)[:, None], (1, signature.shape[1]))
    for r in range(rows):
        keys = mix(keys * U(0x9E3779B97F4A7C15) + signature[r::rows])
    return keys.T


def sketches(signature: np.ndarray) -> np.ndarray:
    """Four bits of every signature value, sixteen values to a number."""
    nibbles = mix(signature) >> U(60)
    return np.bitwise_or.reduce(nibbles.reshape(SKETCH, 16, -1) << (U(4) * np.arange(16, dtype=U))[None, :, None], axis=1).T


def equal_values(a: str, b: str) -> Column:
    """How many of the signature values agree, as far as two sketches tell."""

    def differ(i: int) -> Column:
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        return F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))

    return F.lit(2 * PERMUTATIONS) - reduce(add, map(differ, range(SKETCH)))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            sets = _sets(b.column(1), hashes)
            n = np.array([len(s) for s in sets], np.int64)
            some = np.flatnonzero(n)
            keys, sketch = np.zeros((len(sets), BANDS), U), np.zeros((len(sets), SKETCH), U)
            if len(some):
                signature = signatures([sets[i] for i in some])
                keys[some], sketch[some] = band_keys(signature), sketches(signature)
            sums = np.array([(s.sum(dtype=U), mix(s).sum(dtype=U)) for s in sets], U).reshape(-1, 2).view(np.int64)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel().view(np.int64))) for x in (keys, sketch)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sums[:, 0]), pa.array(sums[:, 1]), *lists], ["doc_id", "n", "k1", "k2", "bands", "sketch"])


def _set_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            b = whole.slice(at, 1000)
            sets = _sets(b.column(1), hashes)
            ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*sets, np.empty(0, U)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["doc", "s"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Alternating large and small stars until every component is a star; a number of rounds that grows as the logarithm.
    """
    e = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    while True:
        both = e.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("x")).select("x.u", "x.v")
        # written, so that the join is of two plain tables and the edges of one large component can be dealt to several tasks
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "least")
        large = both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        e = written(small.select("x.u", "x.v").filter(F.col("u") != F.col("v")).distinct(), "stars")
        sides = e.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("n")), F.struct(F.col("v").alias("node"), F.lit(0).alias("n")))).alias("x")).select("x.node", "x.n")
        if sides.groupBy("node").agg(F.sum("n").alias("up"), F.min("n").alias("lo")).filter("up > 1 or up = 1 and lo = 0").isEmpty():
            roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
            return roots.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough. Only the sets that the pairs name are moved."""
    named = written(pairs.select(F.col("a").alias("doc")).union(pairs.select("b")).distinct(), "named")
    few = named.count() <= BROADCAST_IDS
    sets = sets.join(F.broadcast(named) if few else named, "doc", "left_semi")
    p = pairs.join(sets.select(F.col("doc").alias("b"), F.col("s").alias("sb")), "b").join(sets.select(F.col("doc").alias("a"), F.col("s").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    return p.select("a", "b", both.alias("i"), (F.size("sa") + F.size("sb")).alias("t")).filter(100 * F.col("i") >= SIMILARITY * (F.col("t") - F.col("i"))).select("a", "b")


def _against(component: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
    """One link, if there is any, from each of a block of outside documents to a block of a component, by counting shared shingles."""
    if not len(component) or not len(outside):
        return pd.DataFrame({"a": [], "b": []})
    own = [np.asarray(x, np.int64) for x in component["s"]]
    size = np.array([len(x) for x in own])
    flat, owner = np.concatenate(own), np.repeat(np.arange(len(own)), size)
    by = np.argsort(flat, kind="stable")
    flat, owner, docs = flat[by], owner[by], component["doc"].to_numpy()
    pairs: list[tuple[int, int]] = []
    for doc, x in zip(outside["d"], outside["x"]):
        lo, hi = np.searchsorted(flat, x, "left"), np.searchsorted(flat, x, "right")
        n = hi - lo
        at = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        both = np.bincount(owner[at], minlength=len(own))
        hit = docs[100 * both >= SIMILARITY * (size + len(x) - both)]
        pairs += [(min(doc, d), max(doc, d)) for d in hit[:1]]  # the others are in the component already
    return pd.DataFrame(pairs, columns=["a", "b"])


def _component_links(meets: DataFrame, labels: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) of documents with large components that they meet in a bucket (doc, comp), checked against all of it.

    The component's documents and those that meet it are dealt by hash into blocks of some BLOCK_DOCS; every pair of
    blocks is a group of its own, so a task holds two blocks, however large either side is.
    """
    held = labels.join(meets.select(F.col("comp").alias("root")).distinct(), "root", "left_semi")
    blocks = held.groupBy(F.col("root").alias("comp")).agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("blocks"))
    blocks = blocks.join(meets.groupBy("comp").agg(F.ceil(F.count("*") / BLOCK_DOCS).cast("int").alias("others")), "comp")
    block = lambda n: F.pmod(F.xxhash64("doc"), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = held.select(F.col("node").alias("doc"), F.col("root").alias("comp")).join(blocks, "comp").select("doc", "comp", block("blocks").alias("i"), every("others").alias("j"))
    outside = meets.join(blocks, "comp").select("doc", F.col("comp").alias("c"), every("blocks").alias("k"), block("others").alias("l"))
    left = members.join(sets, "doc").select("comp", "i", "j", "doc", "s").groupBy("comp", "i", "j")
    right = outside.join(sets.select("doc", F.col("s").alias("x")), "doc").select("c", "k", "l", F.col("doc").alias("d"), "x").groupBy("c", "k", "l")
    return left.cogroup(right).applyInPandas(_against, "a long, b long")


def prefix_buckets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Buckets for the documents that are left in `members`, by the rarest shingles of their sets: no pair is lost.

    In an order that all share, here by frequency among these documents, two sets of similarity 0.8 have a shingle in
    common among the first fifth of each. A passage that many of them share is frequent, and makes no bucket.
    """
    left = written(members.select("doc", "n", "sketch").distinct(), "left")
    shingles = left.select("doc", "n").join(sets, "doc").select("doc", "n", F.explode("s").alias("key"))
    several = shingles.groupBy("key").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("doc").orderBy("df", "key"))
    first = shingles.join(several, "key").withColumn("place", place).filter(F.col("place") <= F.col("n") - F.ceil(F.col("n") * SIMILARITY / 100) + 1)
    return first.filter("df > 1").select("key", "doc", "n").join(left.select("doc", "sketch"), "doc").select("key", "doc", "n", "sketch")


def link_components(members: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, root) for linked documents, from buckets (key, doc, n, sketch) and the sets (doc, s); None if nothing is linked.

    The hubs of a round are the bucket's first document and those of smallest hash, as many as the round has, more or
    less. After the first round the buckets are those of prefix_buckets. A pair is compared on the full sets if at least
    LIKELY of its signature values seem to agree. Where the largest component of a bucket has become large, the bucket's
    other members are checked against all of that component, and its members leave the bucket.
    """
    labels, tested, step = None, None, 0
    while True:
        if step == REBUCKET:
            members = written(prefix_buckets(members, sets), "prefixes")
        if labels is None:
            m = members.withColumn("comp", F.col("doc"))
        else:
            m = members.join(labels, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", "sketch", F.coalesce("root", "doc").alias("comp"))
        per = m.groupBy("key", "comp").agg(F.count("*").alias("held"), F.min("doc").alias("lo"))
        spread = per.groupBy("key").agg(
            F.max(F.struct("held", "comp")).alias("lead"), F.sum("held").alias("size"), F.count("*").alias("comps"), F.min(F.struct("lo", "comp")).alias("one"), F.max(F.struct("lo", "comp")).alias("other")
        ).filter("comps > 1")
        large = F.col("lead.held") >= LARGE
        inside = large & (F.col("comp") == F.col("lead.comp"))
        met = F.when(large & ~inside, F.col("lead.comp"))
        first = F.when(large & (F.col("one.comp") == F.col("lead.comp")), F.col("other.lo")).otherwise(F.col("one.lo"))
        left, most = F.col("size") - F.when(large, F.col("lead.held")).otherwise(0), HUBS ** min(step, MOST_ROUND)
        chosen = F.pmod(F.xxhash64("doc", "key"), F.lit(1 << 20)) * left < (most - 1) << 20
        hub = ~inside & ((F.col("doc") == first) | (left <= most) | chosen)
        m = written(m.join(spread, "key").select("key", "doc", "n", "sketch", "comp", inside.alias("inside"), met.alias("met"), hub.alias("hub")), "buckets")
        if m.isEmpty():
            return labels
        links = None
        if labels is not None:
            meets = written(m.filter("met IS NOT NULL").select("doc", F.col("met").alias("comp")).distinct(), "meets")
            links = None if meets.isEmpty() else _component_links(meets, labels, sets)
        rest = m.filter("NOT inside")
        hubs = rest.filter("hub").select("key", F.col("doc").alias("hub_doc"), F.col("comp").alias("hub_comp"), F.col("n").alias("hub_n"), F.col("sketch").alias("hub_sketch"))
        alike = 100 * F.least("n", "hub_n") >= SIMILARITY * F.greatest("n", "hub_n")
        likely = (F.col("comp") != F.col("hub_comp")) & (F.col("doc") != F.col("hub_doc")) & alike & (equal_values("sketch", "hub_sketch") >= LIKELY)
        pairs = rest.join(hubs, (rest["key"] == hubs["key"]) & likely).select(F.least("doc", "hub_doc").alias("a"), F.greatest("doc", "hub_doc").alias("b")).distinct()
        pairs = written(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.unionByName(pairs)
        found = _linked(pairs, sets)
        links = written(found if links is None else found.unionByName(links), "links")
        if not links.isEmpty():
            labels = components(links if labels is None else links.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
        members = rest.filter("NOT hub").select("key", "doc", "n", "sketch")
        step += 1


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per row of docs.

    Null and empty texts, and texts without words, have no shingles and are linked with nothing. Rows of one
    doc_id count as one document (linked, whatever their texts). A row without doc_id is linked with nothing: its
    component_id is null and it is kept. An empty table gives an empty result. Columns other than doc_id and text are
    not read.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    signed = written(texts.mapInArrow(_signed, "doc_id long, n long, k1 long, k2 long, bands array<long>, sketch array<long>"), "signed")
    some = signed.filter((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = written(some.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("rep")), "representatives")
    known = some.join(reps.select(F.col("rep").alias("doc_id"), "k1", "k2", "n"), ["doc_id", "k1", "k2", "n"], "left_semi")
    banded = known.select(F.col("doc_id").alias("doc"), F.explode("bands").alias("key"))
    several = banded.groupBy("key").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi")).filter("lo < hi").select("key")
    shared = written(banded.join(several, "key"), "members")
    ids = written(shared.select("doc").distinct(), "candidates")
    n = ids.count()
    sketch = known.select(F.col("doc_id").alias("doc"), "n", "sketch")
    members = shared.join(sketch, "doc").select("key", "doc", "n", "sketch")
    chosen = texts.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("doc_id") == F.col("doc"), "left_semi")
    sets = written(chosen.mapInArrow(_set_lists, "doc long, s array<long>"), "sets")
    if sets.count() > n:  # an id that repeats
        sets = written(sets.distinct(), "sets")
    labels = link_components(members, sets)

    rows = signed.select("doc_id", "n", "k1", "k2").join(reps, ["k1", "k2", "n"], "left")
    rows = rows.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("rep"))
    first = rows.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").select("doc_id", "a")
    if not first.isEmpty():  # ids that have several texts connect their groups
        more = rows.join(first, "doc_id").select("a", F.col("rep").alias("b"))
        labels = components(more if labels is None else more.unionByName(labels.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    if labels is None:
        found = rows.withColumn("component_id", F.col("rep"))
    else:
        found = rows.join(labels, F.col("rep") == F.col("node"), "left").withColumn("component_id", F.coalesce("root", "rep"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of smallest id, and one row of it.

    Null and empty texts and rows without id belong to no group and stay, all of them; of repeated rows of an id one stays; an
    empty table stays empty.
    """
    gone = written(near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct(), "dropped")
    few = gone.count() <= BROADCAST_IDS
    stay = docs.join(F.broadcast(gone) if few else gone, "doc_id", "left_anti")
    twice = stay.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    if twice.isEmpty():
        return stay.select(*docs.columns)
    again = stay.join(twice, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.join(twice, "doc_id", "left_anti").unionByName(again).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
