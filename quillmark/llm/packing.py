"""Mixture-controlled packing: every window is filled from the sources by deficit round-robin.

Each source is a queue: its documents' tokens in storage order. There are as many rounds as windows; in each
round a source's deficit grows by its target share of a window, it sends as many whole quanta as the deficit covers,
and the rest is carried to the next round. Without target weights the targets are the sources' own shares, which last to
the end. With weights a source may run dry before others; those share its part by weight from then on, so there is a
phase for each source that ends. Within a phase of R rounds in which a source sends n quanta it has sent floor(n * r / R)
after r of them, so the state at any window follows from the token totals alone: partitions need no word from each other,
and deficits carry across their borders exactly. A window's share of a source is off by a quantum at most, which the next
windows make good. The rounds, one after the other, are one gapless stream that is cut into sequences; all but the last
are full. What is less than a quantum at a source's end comes in the last round.

1. Tokenise once; ids, and each document's place among its task's documents of that source, go to a table.
2. Sum tokens by (source, task): a small table; its running sums give every document its place in the queue.
3. Cut each document at round and sequence borders, where it lies.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain, count, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import shared_dir, table

LENGTH, END = 2048, 1
#: A window holds this many quanta, or one of each source if these are more, but none of fewer than LEAST tokens.
QUANTA, LEAST = 8, 64
#: Parts of words whose ids a worker remembers.
WORDS_KEPT = 500_000
#: Up to so many rows of running sums, of some 40 bytes each, are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 200_000
ROWS = 1000
#: Entries of a table of rounds by sources that a task makes at once.
TABLE = 1 << 21
#: Marks that may follow a word's letters; the apostrophe is none of them, as the tokenizer keeps some endings with it.
MARKS = ",.;:!?%*#$&|<>()[]{}+=~^@/\\-_\""
#: Letters that a word may have before marks: those that are letters by any table, and stay so when composed and lowered.
LETTERS = r"^[A-Za-z\x{C0}-\x{12F}\x{131}-\x{64A}\x{AC00}-\x{D7A3}]+$"
#: Of these, those that nothing composes with and that are lowered one by one; is_plain tells lowered ones.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+$"
is_plain = re.compile("[a-z\xdf-\xf6\xf8-\xff]+").fullmatch
TOKENS = "source string, part int, first long, n long, doc_id long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each run in turn, n of them."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + n, n)


def _halves(words: pa.StringArray) -> tuple[pa.Array, pa.Array]:
    """Heads of words and the marks that follow them; a word that is not letters and then marks is a head as it stands."""
    heads = pc.utf8_rtrim(words, characters=MARKS)
    split = pc.and_(pc.match_substring_regex(heads, LETTERS), pc.utf8_is_alpha(heads))
    lowered = pc.if_else(pc.match_substring_regex(heads, PLAIN), pc.utf8_lower(heads), heads)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
    cuts = np.empty(2 * len(words) + 1, np.int32)
    cuts[::2] = ends
    cuts[1::2] = np.where(split.to_numpy(zero_copy_only=False), ends[:-1] + pc.binary_length(heads).to_numpy(), ends[1:])
    tails = pa.Array.from_buffers(pa.string(), 2 * len(words), [None, pa.py_buffer(cuts), words.buffers()[2]]).take(pa.array(np.arange(1, 2 * len(words), 2)))
    return pc.if_else(split, lowered, words), tails


class WordIds:
    """The ids of parts of words that a worker has met; those of a text are those of its words' parts in turn.

    The tokenizer's own pieces never span white space, nor letters and other marks. A word that is letters and then
    marks has the ids of both parts, so commas and stops cost no new call. Plain letters are lowered here and given to the
    tokenizer's model many words at a time, as its ids tell where a word ends; everything else meets the whole tokenizer
    as it stands, because its normaliser composes before it lowers, and its special tokens are those of lower case only.
    """

    def __init__(self, tokenizer: str, kept: int = WORDS_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers

        self.model, self.kept = Tokenizer.from_file(tokenizer), kept
        self.plain = Tokenizer(self.model.model)  # shares the model; plain letters are normal as they are
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        names = [self.model.id_to_token(i) or "" for i in range(self.model.get_vocab_size())]
        self.ends_word = np.array([n.endswith("</w>") for n in names])
        self.parts: dict[str, int] = {}
        #: The ids of part k are flat[ends[k] : ends[k + 1]]; hits: in how many batches it came, halved now and then.
        self.flat, self.ends, self.hits = np.empty(1 << 16, np.uint32), np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int32)

    def _encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all parts, and how many each has."""
        got = [e.ids for e in self.model.encode_batch_fast(parts, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(got), np.uint32), np.fromiter(map(len, got), np.int64, len(got))

    def _letters(self, parts: list[str], model) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The same, some at a time, of words that have an end each at least."""
        for low in range(0, len(parts), 1000):
            some = parts[low : low + 1000]
            ids = np.array(model.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends_word[ids]) + 1
            yield (ids, np.diff(cuts, prepend=0)) if len(cuts) == len(some) else self._encode(some)

    def _learn(self, new: list[str]) -> None:
        plain = [w for w in new if is_plain(w)]
        letters = [w for w in new if w.isalpha() and not is_plain(w)]
        others = [w for w in new if not w.isalpha()]
        got = [*self._letters(plain, self.plain), *self._letters(letters, self.model), self._encode(others)]
        flat, n = (np.concatenate(x) for x in zip(*got))
        known = len(self.parts)
        self.parts.update(zip(chain(plain, letters, others), count(known)))
        at = int(self.ends[known])
        while at + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while len(self.parts) >= len(self.ends):
            self.ends, self.hits = (np.concatenate([x, np.zeros_like(x)]) for x in (self.ends, self.hits))
        self.flat[at : at + len(flat)] = flat
        self.ends[known + 1 : len(self.parts) + 1] = at + np.cumsum(n)
        self.hits[known : len(self.parts)] = 0

    def _forget(self) -> None:
        """Keeps half as many parts as it may, those that came most often."""
        keep = np.sort(np.argsort(-self.hits[: len(self.parts)], kind="stable")[: self.kept // 2])
        names = list(self.parts)
        self.parts = {}
        self.parts.update((names[k], i) for i, k in enumerate(keep.tolist()))
        first, n = self.ends[keep], self.ends[keep + 1] - self.ends[keep]
        flat = self.flat[_spread(first, n)]
        self.flat[: len(flat)] = flat
        self.ends[1 : len(keep) + 1] = np.cumsum(n)
        self.hits[: len(keep)] = self.hits[keep] >> 1

    def _numbers(self, parts: pa.Array) -> np.ndarray:
        """The numbers of parts; new ones are learned."""
        some = parts.dictionary_encode()
        names = some.dictionary.to_numpy(zero_copy_only=False).tolist()
        at = np.fromiter(map(self.parts.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(at < 0)
        if len(new):
            unknown = [names[i] for i in new.tolist()]
            self._learn(unknown)
            at[new] = np.fromiter(map(self.parts.__getitem__, unknown), np.int64, len(new))
        self.hits[at] += 1
        return at[some.indices.to_numpy()]

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by END, and where each text ends.

        Texts are split at ASCII white space, and their distinct words and the parts of these are found in Arrow, so that Python
        meets a part once a batch.
        """
        lists = pc.ascii_split_whitespace(texts.cast(pa.string()).fill_null(""))
        words = lists.flatten().dictionary_encode()
        flat, total = np.empty(0, np.uint32), np.zeros(1, np.int64)
        if len(words):
            part = self._numbers(pa.concat_arrays(_halves(words.dictionary))).reshape(2, -1).T.ravel()
            first = self.ends[part]
            n = self.ends[part + 1] - first
            ids = self.flat[_spread(first, n)]  # of each distinct word
            n = n.reshape(-1, 2).sum(1)
            at = words.indices.to_numpy()
            first, n = (np.cumsum(n) - n)[at], n[at]
            flat, total = ids[_spread(first, n)], np.concatenate([[0], np.cumsum(n)])
        ends = total[np.cumsum(pc.list_value_length(lists).to_numpy())]
        out = np.insert(flat, ends, np.uint32(END))
        if len(self.parts) > self.kept:
            self._forget()
        return out, ends + np.arange(1, len(texts) + 1)


@cache
def word_ids(tokenizer: str) -> WordIds:
    """One for each Python worker, which outlives its tasks."""
    return WordIds(tokenizer)


def _tokens(tokenizer: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, seen, part = word_ids(tokenizer), {}, TaskContext.get().partitionId()
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                ids, ends = words.ids(b.column(2))
                small = ids.astype("<u4")
                starts = np.concatenate([[0], ends[:-1]])
                first = []
                sources = b.column(1).to_pylist()
                for s, n in zip(sources, (ends - starts).tolist()):
                    first.append(seen.get(s, 0))
                    seen[s] = first[-1] + n
                blobs = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], 4 * ends]).astype(np.int32)), pa.py_buffer(small)])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(sources, pa.string()), pa.array([part] * len(first), pa.int32()), pa.array(first, pa.int64()), pa.array(ends - starts, pa.int64()), b.column(0), blobs],
                    ["source", "part", "first", "n", "doc_id", "ids"],
                )

    return run


def muldiv(x: np.ndarray, y: np.ndarray, n: np.ndarray, less: int = 0) -> np.ndarray:
    """floor((x * y - less) / n) for whole numbers 0 <= x <= n and y, n < 2 ** 42, less 0 or 1, though x * y may need more than 64 bits."""
    high, rest = np.divmod(x * (y >> 20), n)
    return (high << 20) + ((rest << 20) + x * (y & 0xFFFFF) - less) // n


class Rounds:
    """The plan: what each source has sent after each round. totals: tokens by source, in queue order; weights: target shares, by default the totals.

    phases: the first round of each, and how many rounds and which quanta of each source it has.
    """

    def __init__(self, totals: dict, length: int = LENGTH, quantum: int | None = None, weights: dict | None = None):
        quantum = quantum or max(LEAST, length // max(QUANTA, len(totals)))
        self.length, self.quantum, self.order = length, quantum, {s: i for i, s in enumerate(totals)}
        self.n_rounds = max(1, -(-sum(totals.values()) // length))
        self.totals = np.array(list(totals.values()), np.int64)
        self.quanta = self.totals // quantum
        borders, done = self._phases([float(weights.get(s, 0.0)) for s in totals] if weights else None)
        self.first = np.array(borders, np.int64)  # rounds; the last entry is n_rounds
        self.done = np.array(done, np.int64).reshape(len(borders), len(totals))  # quanta sent before each

    def _phases(self, weights: list[float] | None) -> tuple[list[int], list[list[int]]]:
        everything, nothing = self.quanta.tolist(), [0] * len(self.quanta)
        if weights is None:
            return [0, self.n_rounds], [nothing, everything]
        borders, done, left, at = [0], [nothing], [float(q) for q in everything], 0.0
        per_round = self.length / self.quantum
        open_ = [i for i, w in enumerate(weights) if w > 0 and left[i] > 0]
        while open_ and round(at) < self.n_rounds:
            total = sum(weights[i] for i in open_)
            rounds = min(left[i] * total / (weights[i] * per_round) for i in open_)
            for i in open_:
                left[i] = max(0.0, left[i] - rounds * per_round * weights[i] / total)
            at += rounds
            border, so_far = min(round(at), self.n_rounds), [q - round(x) for q, x in zip(everything, left)]
            if border > borders[-1]:
                borders.append(border)
                done.append(so_far)
            else:
                done[-1] = so_far if len(done) > 1 else done[-1]
            open_ = [i for i in open_ if left[i] >= 0.5]
        if borders[-1] < self.n_rounds:  # sources without weight, and what rounding has left
            borders.append(self.n_rounds)
            done.append(everything)
        done[-1] = everything
        return borders, done

    def sent(self, r: np.ndarray) -> np.ndarray:
        """Rows by source, a column for each r: tokens sent before round r."""
        p = np.clip(np.searchsorted(self.first, r, "right") - 1, 0, len(self.first) - 2)
        begin, n = self.done[p].T, (self.done[p + 1] - self.done[p]).T
        rounds = self.first[p + 1] - self.first[p]
        return np.where(r >= self.n_rounds, self.totals[:, None], self.quantum * (begin + muldiv(np.minimum(r - self.first[p], rounds), n, rounds)))

    def rounds_of(self, source: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The round in which a source sends its quantum j."""
        ends = self.done[1:, :]
        p = np.zeros(len(j), np.int64)
        for e in ends[:-1]:
            p += j >= e[source]
        begin, n = self.done[p, source], ends[p, source] - self.done[p, source]
        rounds = self.first[p + 1] - self.first[p]
        some = np.maximum(n, 1)
        within = muldiv(np.minimum(j - begin + 1, some), rounds, some, 1)
        return np.where(j < self.quanta[source], self.first[p] + within, self.n_rounds - 1)

    def places(self, source: np.ndarray, r: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Where in the stream a source's token at the start of quantum j lies, which it sends in round r."""
        rounds, at = np.unique(r, return_inverse=True)
        out = np.empty(len(r), np.int64)
        by, step = np.argsort(at, kind="stable"), max(1, TABLE // max(1, len(self.totals)))
        for low in range(0, len(rounds), step):
            some = rounds[low : low + step]
            before, after = self.sent(some), self.sent(some + 1)
            place = before.sum(0) + np.concatenate([np.zeros((1, len(some)), np.int64), np.cumsum(after - before, 0)[:-1]])
            mine = by[np.searchsorted(at[by], low) : np.searchsorted(at[by], low + step)]
            out[mine] = place[source[mine], at[mine] - low] + j[mine] * self.quantum - before[source[mine], at[mine] - low]
        return out

    def pieces(self, source: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        """For documents at start in their source's queue: document, first token in it, tokens, place in the stream."""
        q = self.quantum
        j0, j1 = start // q, (start + n - 1) // q
        per = j1 - j0 + 1
        doc = np.repeat(np.arange(len(n)), per)
        j = np.repeat(j0, per) + (np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per))
        s = source[doc]
        low, high = np.maximum(j * q, start[doc]), np.minimum((j + 1) * q, (start + n)[doc])
        where = self.places(s, self.rounds_of(s, j), j) + low - j * q
        low, size = low - start[doc], high - low
        joins = np.concatenate([[False], (doc[1:] == doc[:-1]) & (where[1:] == where[:-1] + size[:-1])])
        first = np.flatnonzero(~joins)
        doc, low, where, size = doc[first], low[first], where[first], np.add.reduceat(size, first)
        cuts = (where + size - 1) // self.length - where // self.length + 1  # sequences that each touches
        k = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        doc, low, where, size = (np.repeat(x, cuts) for x in (doc, low, where, size))
        a = np.maximum(where, (where // self.length + k) * self.length)
        z = np.minimum(where + size, (where // self.length + k + 1) * self.length)
        return doc, low + a - where, z - a, a


def _cut(plan: Rounds) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, ROWS) for i in range(0, whole.num_rows, ROWS)):
                if not b.num_rows:
                    continue
                ids = b.column(4).to_pylist()
                n = b.column(3).to_numpy()
                doc, low, size, where = plan.pieces(np.array([plan.order[s] for s in b.column(0).to_pylist()]), b.column(2).to_numpy(), n)
                crc = [zlib.crc32(ids[d][4 * a : 4 * z]) for d, a, z in zip(doc.tolist(), low.tolist(), (low + size).tolist())]
                cols = [b.column(1).take(pa.array(doc)), low, size, np.array(crc, np.int64), n[doc], where // plan.length, where % plan.length]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, quantum: int | None = None, weights: dict | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    quantum: tokens of a piece, by default so many that a window has room for a piece of every source. weights: target
    shares by source (None for rows without one), as far as the sources last; sources without weight follow at the end; by
    default the sources' own shares. The totals by source come to the driver, a row a source. A null or empty text is the
    id END alone; a null source is a queue of its own, the last; repeated rows are packed each. An empty table gives no
    pieces. Columns other than doc_id, source and text are not read.
    """
    spark = docs.sparkSession
    path = shared_dir(spark, "tokens")
    texts = docs.select("doc_id", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("source"), "text")
    texts.mapInArrow(_tokens(tokenizer or default_tokenizer()), TOKENS).write.option("compression", "zstd").parquet(path)
    tokens = spark.read.schema(TOKENS).parquet(path)
    sums = tokens.groupBy("source", "part").agg(F.sum("n").alias("sum"))
    totals = {r["source"]: r["n"] for r in sums.groupBy("source").agg(F.sum("sum").alias("n")).collect()}
    totals = {s: totals[s] for s in sorted(totals, key=lambda s: (s == "", s))}
    targets = weights and {"" if s is None else f"={s}": w for s, w in weights.items()}
    before = F.sum("sum").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("source", "part", F.coalesce(before, F.lit(0)).alias("before"))
    few = starts.count() <= BROADCAST_ROWS
    placed = tokens.join(F.broadcast(starts) if few else starts, ["source", "part"])
    placed = placed.select("source", "doc_id", (F.col("first") + F.col("before")).alias("first"), "n", "ids")
    return placed.mapInArrow(_cut(Rounds(totals, length, quantum, targets)), PIECES)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of pack(), which states nulls, empty texts, repeated rows and empty tables."""
    return pack(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
