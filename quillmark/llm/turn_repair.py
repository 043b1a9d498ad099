"""Repair of the turns of conversations: the cheapest edits after which roles read as a system turn or none, then user and assistant in turn.

A conversation is a word over nine symbols: a row that has to go, or a role (system, user, assistant, other) with or without a
cut-off text. A symbol is a 4 x 4 matrix over the states of the role grammar (nothing yet, after the system turn, after a
user, after an assistant), whose entries are the least cost of edits that lead from one state to another; a conversation is
the min-plus product of its symbols.

1. Rows are sorted by conversation and turn in ranges, so that a conversation of any size is split over tasks into segments.
2. Re-Pair: the commonest pair of neighbouring symbols becomes a new symbol, again and again. A round counts the pairs of all
   segments and takes the commonest that share no symbol, so that one of them does not change the count of another.
3. Every rule gets the product of its two matrices, once, whatever the number of conversations that hold it. An entry keeps
   cost, rank and the state between its halves; its rope, the audit of its edits, is that of both halves joined.
4. A segment is the product of the few symbols it is compressed to; the segments of a conversation are multiplied in turn;
   then each segment, knowing the states at its ends, unrolls its ropes to one edit or more a row.
5. The edits meet the texts, sorted by conversation and row, and a stream over both hashes the repaired conversation.

Ties go to the ASCII-least audit. Audits of one segment from one state to different states are never the beginning of each
other, as they hold equally many edits of rows and end with one; so their order does not change when more is appended, and
an entry needs but its rank among those of its row to settle all later ties. No audit is compared.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import NOT_SPACE, SPACE, table, written

RULES = 256
#: A pair becomes a rule if it occurs so often, and rounds of counting end when no pair does.
LEAST = 2
#: Base symbols: a row by its role, as a capital if its text is cut off; GONE is one that has to be deleted.
SYMBOLS, GONE = "suao", "-"
ALPHABET = GONE + SYMBOLS + SYMBOLS.upper()
NOWHERE = 1 << 60
#: States: nothing yet, after s, after u, after a; what a user or an assistant leads to, and where a conversation may end.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}, "o": {}}
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
#: Rules are written as characters from here on, in texts where every segment ends with a line feed.
FIRST = 0x1000
#: Letters of an edit beside K and D, which tell the role given: rerole to user or assistant (U, A), insert one (u, a).
AUDIT = str.maketrans({"U": "R", "A": "R", "u": "I", "a": "I"})
#: Compressed segments, of some length at most, whose products a worker keeps.
KEPT, SHORT = 4096, 8


def at(i: int, j: int) -> int:
    return 4 * i + j


class Entry:
    """A matrix, by rows: cost, and rank of the audit within its row, by state before and after."""

    __slots__ = ("cost", "rank")

    def __init__(self, cost: tuple[int, ...], rank: tuple[int, ...]):
        self.cost, self.rank = cost, rank


class Base(Entry):
    """Edits of one row, with the inserted turns before it; without a symbol, insertions alone."""

    __slots__ = ("edits",)

    def __init__(self, symbol: str | None):
        best: dict[tuple[int, int], tuple[int, str, str]] = {}
        for i in range(4):
            before = [(0, "", i)]
            for n in (1, 2):  # from any state two insertions reach all states that any number reaches
                before += [(c + INSERT, e + x, NEXT[x][k]) for c, e, k in before if len(e) == n - 1 for x in "ua" if k in NEXT[x]]
            for cost, edit, k in before:
                for c, e, j in [(0, "", k)] if symbol is None else self._of_row(symbol, k):
                    found = (cost + c, (edit + e).translate(AUDIT), edit + e)
                    best[i, j] = min(best.get((i, j), found), found)
        cells = [(i, j) for i in range(4) for j in range(4)]
        ranks = [sum((i, k) in best and best[i, k][1] < best[i, j][1] for k in range(4)) if (i, j) in best else 4 for i, j in cells]
        super().__init__(tuple(best[c][0] if c in best else NOWHERE for c in cells), tuple(ranks))
        self.edits = tuple(best[c][2] if c in best else "" for c in cells)

    @staticmethod
    def _of_row(symbol: str, k: int) -> list[tuple[int, str, int]]:
        out = [(DELETE, "D", k)]
        if symbol != GONE:
            role, cut = symbol.lower(), CUT if symbol.isupper() else 0
            out += [(cut, "K", NEXT[role][k])] if k in NEXT[role] else []
            out += [(REROLE + cut, x.upper(), NEXT[x][k]) for x in "ua" if k in NEXT[x]]
        return out


class Pair(Entry):
    """The product of two matrices; middle: the state between them."""

    __slots__ = ("left", "middle", "right")

    def __init__(self, left: Entry, right: Entry):
        cost, rank, middle = [], [], []
        for i in range(4):
            best = [min((left.cost[at(i, k)] + right.cost[at(k, j)], left.rank[at(i, k)], k) for k in range(4)) for j in range(4)]
            order = sorted(range(4), key=lambda j: (best[j][0] >= NOWHERE, best[j][1], right.rank[at(best[j][2], j)]))
            cost += [min(c, NOWHERE) for c, _, _ in best]
            rank += [order.index(j) for j in range(4)]
            middle += [k for _, _, k in best]
        super().__init__(tuple(cost), tuple(rank))
        self.left, self.right, self.middle = left, right, bytes(middle)


def told(entry: Entry, i: int, j: int) -> list[str]:
    """The rope of an entry unrolled: the edits of each row in turn."""
    out, rest = [], [(entry, i, j)]
    while rest:
        e, i, j = rest.pop()
        if isinstance(e, Base):
            out.append(e.edits[at(i, j)])
        else:
            k = e.middle[at(i, j)]
            rest += [(e.right, k, j), (e.left, i, k)]
    return out


class Grammar:
    """Rules as pairs of characters, in the order in which they are applied, and the matrix of every symbol."""

    def __init__(self, rules: tuple[str, ...]):
        self.rules = rules
        self.entries: dict[str, Entry] = {s: Base(s) for s in ALPHABET}
        for n, (a, b) in enumerate(rules):
            self.entries[chr(FIRST + n)] = Pair(self.entries[a], self.entries[b])
        self.short = lru_cache(KEPT)(self._product)

    def compressed(self, segments: list[str]) -> list[str]:
        text = "\n".join(segments)
        for n, pair in enumerate(self.rules):
            text = text.replace(pair, chr(FIRST + n))
        return text.split("\n") if segments else []

    def _product(self, symbols: str) -> Entry:
        level = [self.entries[s] for s in symbols]
        while len(level) > 1:
            level = [Pair(*level[n : n + 2]) if n + 1 < len(level) else level[n] for n in range(0, len(level), 2)]
        return level[0]

    def products(self, segments: list[str]) -> list[Entry]:
        return [self.short(s) if len(s) <= SHORT else self._product(s) for s in self.compressed(segments)]


@cache
def grammar(rules: tuple[str, ...]) -> Grammar:
    """One for each Python worker, which outlives its tasks."""
    return Grammar(rules)


CLOSING = Base(None)


def _pairs(rules: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of neighbouring symbols; of a run of one symbol every second pair counts, as only these can be replaced at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, counts = FIRST + len(rules), {}
        for b in batches:
            text, weight = "\n".join(grammar(rules).compressed(b.column(0).to_pylist())), b.column(1).to_numpy()
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
            a, z = codes[:-1], codes[1:]
            row = np.cumsum(codes == 10)[:-1]
            fresh = np.concatenate([[True], codes[1:] != codes[:-1]])
            place = np.arange(len(codes)) - np.maximum.accumulate(np.where(fresh, np.arange(len(codes)), 0))
            some = (a != 10) & (z != 10) & ((a != z) | (place[:-1] % 2 == 0))
            pairs, at = np.unique(a[some] * n + z[some], return_inverse=True)
            for p, c in zip(pairs.tolist(), np.bincount(at, weight[row[some]], len(pairs)).tolist()):
                counts[p] = counts.get(p, 0) + int(c)
        pairs = [chr(p // n) + chr(p % n) for p in counts]
        yield pa.RecordBatch.from_arrays([pa.array(pairs, pa.string()), pa.array(list(counts.values()), pa.int64())], ["pair", "n"])

    return run


def learned(segments: DataFrame, most: int = RULES, least: int = LEAST) -> tuple[str, ...]:
    """The rules of the segments (symbols, n). Every round counts all of them; the driver gets one row a pair of symbols, of which there are at most (9 + rules) squared."""
    rules: list[str] = []
    while len(rules) < most:
        counts = segments.select("symbols", "n").mapInArrow(_pairs(tuple(rules)), "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        used: set[str] = set()
        for r in sorted(counts.filter(F.col("n") >= least).collect(), key=lambda r: (-r["n"], r["pair"])):
            if not used & set(r["pair"]) and len(rules) < most:
                rules.append(r["pair"])
                used |= set(r["pair"])
        if not used:
            break
    return tuple(rules)


def _products(rules: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The matrix of each segment: costs, then ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar(rules)
        for b in batches:
            flat = [[*p.cost, *p.rank] for p in g.products(b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(flat, pa.list_(pa.int64()))], ["conv", "part", "matrix"])

    return run


def _states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each segment of a conversation, and what the whole costs. The closing insertions follow the last."""
    for b in batches:
        out = []
        for conv, segments in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            entries = [Entry(s["matrix"][:16], s["matrix"][16:]) for s in segments]
            whole, back = CLOSING, [CLOSING]
            for e in reversed(entries):
                whole = Pair(e, whole)
                back.append(whole)
            end = min(ENDS, key=lambda j: (whole.cost[at(START, j)], whole.rank[at(START, j)]))
            state = START
            for s, e in zip(segments, reversed(back[1:])):
                after = e.middle[at(state, end)]
                out.append((conv, s["part"], state, after, CLOSING.edits[at(after, end)] if s is segments[-1] else "", whole.cost[at(START, end)]))
                state = after
        columns = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, ["conv", "part", "before", "after", "closing", "cost"])


def _edits(rules: tuple[str, ...]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The edits of each row of a segment, with its audit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = grammar(rules)
        for b in batches:
            edits = []
            products = g.products(b.column(2).to_pylist())
            for product, i, j, closing in zip(products, *(c.to_pylist() for c in b.columns[3:6])):
                of_rows = told(product, i, j)
                of_rows[-1] += closing
                edits.append(of_rows)
            audits = ["".join(e).translate(AUDIT) for e in edits]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(edits, pa.list_(pa.string())), pa.array(audits, pa.string())], ["conv", "part", "edits", "audit"])

    return run


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a stream sorted by conversation, where each text comes before the edits of its rows: the hash of each repaired conversation."""
    conv, text, role, out, digest, first = None, "", "", [], hashlib.sha256(), True

    def row(as_role: str, words: str) -> None:
        nonlocal first
        digest.update(("" if first else "\n").encode() + f"{as_role}:{words}".encode())
        first = False

    for b in batches:
        for key, kind, a_role, a_text, edits in zip(*(c.to_pylist() for c in b.columns)):
            if key != conv:
                if conv is not None:
                    out.append((conv, digest.hexdigest()))
                conv, digest, first = key, hashlib.sha256(), True
            if kind == 0:
                role, text = a_role, a_text
                continue
            for e in edits:
                if e in "ua":
                    row("user" if e == "u" else "assistant", "")
                elif e == "K":
                    row(role, text)
                elif e in "UA":
                    row("user" if e == "U" else "assistant", text)
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["conv", "repaired_sha256"])
            out = []
    if conv is not None:
        out.append((conv, digest.hexdigest()))
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out)], ["conv", "repaired_sha256"])


def damaged(rows: DataFrame) -> DataFrame:
    """Rows with faults planted by a hash of conversation and turn: dropped, emptied, without stops, repeated, or given to the user."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(key) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("_role"), F.coalesce("text", blank).alias("_text")).filter(kind != 0)
    rows = rows.withColumn("role", F.when(kind == 4, F.lit("user")).otherwise(F.col("_role"))).withColumn("text", text)
    return rows.select("conv_id", "turn", "role", "text", F.when(kind == 3, F.lit(2)).otherwise(F.lit(1)).alias("times"))


def _keyed(rows: DataFrame) -> DataFrame:
    """conv: the conversation's id as text, marked, so that no id is one too; digest: of role and text."""
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    return rows.withColumn("conv", conv).withColumn("digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))


def _symbol(initial: Column, gone: Column, cut: Column) -> Column:
    known = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    return F.when(gone, GONE).when(cut, F.upper(known)).otherwise(known)


def _sorted_rows(rows: DataFrame) -> DataFrame:
    """Rows without their texts in order of conversation, turn, role and text, written; part and place tell the order within a conversation."""
    last = F.substring(F.regexp_replace("text", f"{SPACE}+$", ""), -1, 1)
    slim = rows.select("conv", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), F.rlike("text", F.lit(NOT_SPACE)).alias("filled"), last.isin(".", "!", "?").alias("ended"), "times")
    slim = slim.withColumn("_copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "_copy").withColumn("_id", F.monotonically_increasing_id())
    order = ["conv", "turn", "role", "digest", "_id"]
    dealt = slim.repartitionByRange(*order).sortWithinPartitions(*order).drop("_id")
    return written(dealt.withColumn("part", F.spark_partition_id()).withColumn("place", F.monotonically_increasing_id()), "turns")


def repair(rows: DataFrame, rules: int = RULES) -> DataFrame:
    """One row per conversation: conv_id, n_rows, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    rows: conv_id, turn, role, text, and times (how often a row stands there; optional, once by default); none is null but
    conv_id, whose null is a conversation of its own, and turn, whose nulls come first. Rows of one turn are in order of role,
    then of a hash of their text; repeated rows stay, and all but the first are duplicates. A role counts by its first
    letter; one that is empty or begins with none of s, u, a can only be given to user or assistant, or deleted. Texts of any
    length are hashed as a stream. An empty table gives no rows. Other columns are not read.

    A conversation of any number of rows is split over tasks, but for the hash of its repaired text, which by its
    definition is one pass over that text: it streams through one task, a row at a time.
    """
    rows = _keyed(rows if "times" in rows.columns else rows.withColumn("times", F.lit(1)))
    turns = _sorted_rows(rows)
    where = F.struct("part", "place")
    first = turns.groupBy("conv", "digest").agg(F.min(where).alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    turns = turns.join(first, ["conv", "digest"], "left").withColumn("again", F.coalesce(where > F.col("_first"), F.lit(False)))
    gone, cut = ~F.col("filled") | F.col("again"), ~F.col("ended")
    turns = turns.withColumn("symbol", _symbol(F.col("initial"), gone, cut))
    segments = turns.groupBy("conv", "part").agg(
        F.array_sort(F.collect_list(F.struct("place", "symbol", "initial", "turn", "role", "digest"))).alias("rows"),
        F.count_if(~F.col("filled")).alias("blank"), F.count_if(F.col("filled") & F.col("again")).alias("duplicate"), F.count_if(F.col("filled") & ~F.col("again") & cut).alias("truncated"),
    )
    initials = F.col("rows.initial")
    legal = F.size(F.filter(F.arrays_zip(F.slice(initials, 1, F.greatest(F.size(initials) - 1, F.lit(0))).alias("a"), F.slice(initials, 2, F.size(initials)).alias("z")), lambda p: F.concat(p["a"], p["z"]).isin("su", "ua", "au")))
    ends = F.struct(F.element_at(initials, 1).alias("first"), F.element_at(initials, -1).alias("last"))
    segments = written(segments.withColumn("symbols", F.array_join("rows.symbol", "")).withColumn("illegal", F.size("rows") - 1 - legal).withColumn("ends", ends), "segments")

    found = learned(written(segments.groupBy("symbols").agg(F.count("*").alias("n")), "words"), rules)
    products = segments.select("conv", "part", "symbols").mapInArrow(_products(found), "conv string, part int, matrix array<long>")
    lists = products.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "matrix"))).alias("segments"))
    states = lists.mapInArrow(_states, "conv string, part int, before int, after int, closing string, cost long")
    states = written(states, "states")
    asked = segments.select("conv", "part", "symbols").join(states, ["conv", "part"]).select("conv", "part", "symbols", "before", "after", "closing")
    edits = written(asked.mapInArrow(_edits(found), "conv string, part int, edits array<string>, audit string"), "edits")

    of_rows = segments.select("conv", "part", "rows").join(edits.drop("audit"), ["conv", "part"]).select("conv", "part", F.explode(F.arrays_zip("rows", "edits")).alias("r"))
    of_rows = of_rows.select("conv", F.col("r.rows.turn").alias("turn"), F.col("r.rows.role").alias("role"), F.col("r.rows.digest").alias("digest"), F.lit(1).alias("kind"), "part", F.col("r.rows.place").alias("place"), F.lit(None).cast("string").alias("text"), F.col("r.edits").alias("edits"))
    texts = rows.select("conv", "turn", "role", "digest", F.lit(0).alias("kind"), F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), "text", F.lit("").alias("edits"))
    stream = texts.unionByName(of_rows).repartition("conv").sortWithinPartitions("conv", "turn", "role", "digest", "kind", "part", "place")
    hashed = stream.select("conv", "kind", "role", "text", "edits").mapInArrow(_hashed, "conv string, repaired_sha256 string")

    parts = segments.drop("rows", "symbols").join(edits.select("conv", "part", "audit"), ["conv", "part"]).join(states.select("conv", "part", "cost"), ["conv", "part"])
    whole = parts.groupBy("conv").agg(
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal")), F.first("cost").alias("cost"),
        F.array_sort(F.collect_list(F.struct("part", "ends", "audit"))).alias("_parts"),
    )
    borders = F.arrays_zip(F.slice("_parts.ends.last", 1, F.greatest(F.size("_parts") - 1, F.lit(0))).alias("a"), F.slice("_parts.ends.first", 2, F.size("_parts")).alias("z"))
    between = F.size(F.filter(borders, lambda p: ~F.concat(p["a"], p["z"]).isin("su", "ua", "au")))
    whole = whole.withColumn("illegal", F.col("illegal") + between).withColumn("audit", F.array_join("_parts.audit", "")).drop("_parts")
    turns_of = rows.groupBy("conv", "turn").agg(F.sum("times").alias("n"), F.first("conv_id").alias("conv_id"))
    spans = turns_of.groupBy("conv").agg(F.first("conv_id").alias("conv_id"), F.sum("n").alias("n_rows"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    return spans.join(whole, "conv").join(hashed, "conv").drop("conv")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))
    every = rows.groupBy("conv_id").agg(F.lit(1)).select("conv_id", conv.alias("conv"))
    done = repair(damaged(rows)).withColumn("conv", conv).drop("conv_id")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(done, "conv", "left").select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
