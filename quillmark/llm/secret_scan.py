"""Secret scans, in DataFrame functions only: fixed patterns, and strings that look random.

Two character Markov models (bigrams, smoothed towards single characters) are trained from labelled samples: one of random
strings, one of ordinary identifiers. A long token outside the patterns' spans is a secret if its log-likelihood
ratio exceeds a threshold, and so much a character too, as long paths gather some by their length. The samples of the query:
the values that the patterns find and base-64 strings made of digests are the random strings, and the corpus's words of
eight characters or more, outside those spans, the identifiers; these count alone and between separators, as in paths, and
dates count beside them. Each class is fitted on at most `sample` distinct strings, those of smallest hash.

Spans are code-point offsets, end exclusive. They are found within the row by splitting at the pattern and
adding up the lengths, so scanning moves no row between tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm.common import of_smallest_hash, table, written

#: Pattern, group that is measured, least length, text to look for first.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": (ASSIGN, 2, 12, r"(?i:passw|secret|token|api_?key)"),
    "access": (r"AKIA[A-Z0-9]{14,}", 0, 18, "AKIA"),
    "hex": (r"[0-9a-f]{16,}", 0, 16, r"[0-9a-f]{16}"),
}
#: The runs of AKIA[A-Z0-9]+ and [0-9a-f]+ that are long enough, which these patterns give, are those that remain
#: when shorter ones are dropped: a run is matched from its start to its end either way.
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
#: A long token of digits and both cases: likely random, so that a small corpus must not learn it as ordinary.
MIXED = r"(?<![A-Za-z0-9+/_=-])" + "".join(rf"(?=[A-Za-z0-9+/_=-]*{c})" for c in ("[0-9]", "[a-z]", "[A-Z]")) + TOKEN
IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_]{7,}"
#: Character codes 32 to 126, and one for the start of a string.
V, START = 96, 95
SAMPLE, SMOOTH, THRESHOLD, PER_CHAR = 20_000, 0.1, 25.0, 1.25
#: Random strings that every sample has, so that a corpus without any fixed value has a random class too; and as many dates.
DIGESTS = 2048
SEPARATORS = "/-_"
DATES = ("yyyy-MM-dd_HH-mm-ss", "yyyy/MM/dd", "yyyyMMdd-HHmmss")
MARK = "[SECRET]"
#: Elements of a block of running values; characters of a block of a text that is cut at many places.
BLOCK, PIECE = 64, 512
#: Beyond the end of any text.
FAR = 2**31 - 1


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f and its lambdas name it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _before(values: Column, fold: Callable[[Column, Column], Column]) -> Column:
    """What fold makes of the whole numbers before each element, from 0 on, in two levels, so that many elements stay cheap."""
    total = lambda a, start: F.aggregate(a, start, fold)

    def both(x: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(x, b * BLOCK + 1, F.lit(BLOCK)), F.lit(0)))
        starts = F.aggregate(blocks, F.array(F.lit(0)), lambda acc, s: F.concat(acc, F.array(fold(F.element_at(acc, -1), s))))
        return _let(starts, lambda st: F.transform(x, lambda _, i: total(F.slice(x, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK), F.get(st, F.floor(i / BLOCK).cast("int")))))

    return F.when(F.size(values) > 0, _let(values, both)).otherwise(F.array().cast("array<int>"))


def _prefix_sums(lengths: Column) -> Column:
    return _before(lengths, lambda s, x: s + x)


def _prefix_max(values: Column) -> Column:
    return _before(values, lambda s, x: F.greatest(s, x))


def _matches(text: Column, kind: int, pattern: str, group: int, least: int, first: str) -> Column:
    """Array of (start, end, kind, value) of the pattern's matches whose group has the least length."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    # gap 0, match 0, gap 1, match 1, ...: the length before match i is the sum before it, and its own gap
    both = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("m"), value.alias("v")), lambda z: F.struct(F.length(z["g"]).alias("g"), F.coalesce(F.length(z["m"]), F.lit(0)).alias("m"), z["v"].alias("v")))

    def spans(z: Column) -> Column:
        sums = _prefix_sums(F.transform(z, lambda x: x["g"] + x["m"]))
        at = lambda s: F.transform(z, lambda x, i: F.struct((F.get(s, i) + x["g"]).alias("start"), (F.get(s, i) + x["g"] + x["m"]).alias("end"), F.lit(kind).alias("kind"), x["v"].alias("value")))
        return F.filter(F.element_at(F.transform(F.array(sums), at), 1), lambda x: F.length(x["value"]) >= least)

    found = F.element_at(F.transform(F.array(both), spans), 1)
    none = F.array().cast("array<struct<start:int,end:int,kind:int,value:string>>")
    return F.when(text.rlike(first), found).otherwise(none)


def base_spans(text: Column) -> Column:
    """The spans of the fixed patterns by start, then kind as listed."""
    return F.array_sort(F.concat(*(_matches(text, k, *KINDS[name]) for k, name in enumerate(KINDS))))


def _chars(s: Column) -> Column:
    return F.regexp_extract_all(s, F.lit("(?s)."), F.lit(0))


def _code(char: Column) -> Column:
    """The code of a character of an ASCII string."""
    return F.least(F.greatest(F.ascii(char) - 32, F.lit(0)), F.lit(START - 1))


def _pairs(s: Column) -> Column:
    """The bigrams of a string, START before its first character."""
    shifted = lambda c: F.concat(F.array(F.lit(START)), F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))))
    return _let(F.transform(_chars(s), _code), lambda c: F.zip_with(shifted(c), c, lambda a, b: a * V + b))


def training_samples(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(text, label): at most `sample` distinct strings of each label, those of smallest hash.

    Values of base spans have label 1, and so have eight base-64 strings made of SHA-256 digests of each value, and
    DIGESTS more made of numbers: random strings over the alphabet that the patterns' values lack. Identifiers have label 0:
    all those of the corpus, after the base spans are cut out of the texts (MARK holds no identifier), and the long tokens
    that mix digits and both cases, which belong to neither class before they are scored.
    """
    d = docs.select(F.coalesce("text", F.lit("")).alias("t")).withColumn("spans", base_spans(F.col("t")))
    digest = lambda v, i: F.substring(F.base64(F.unhex(F.sha2(F.concat(v, F.lit(str(i))), 256))), 1, 32)
    values = F.flatten(F.transform("spans", lambda x: F.array(x["value"], *(digest(x["value"], i) for i in range(8)))))
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(redacted(F.col("t"), F.col("spans")), MIXED, " "), F.lit(IDENTIFIER), F.lit(0)))
    both = d.select(F.transform(values, lambda v: F.struct(v.alias("text"), F.lit(1).alias("label"))).alias("a"), F.transform(words, lambda w: F.struct(w.alias("text"), F.lit(0).alias("label"))).alias("b"))
    more = docs.sparkSession.range(DIGESTS).select(digest(F.col("id").cast("string"), 0).alias("text"), F.lit(1).alias("label"))
    rows = written(both.select(F.explode(F.concat("a", "b")).alias("x")).select("x.text", "x.label").unionByName(more).distinct(), "samples")
    return of_smallest_hash(rows.filter("label = 1"), "text", sample).unionByName(of_smallest_hash(rows.filter("label = 0"), "text", sample))


def fit(samples: DataFrame, smooth: float = SMOOTH) -> list[float]:
    """The V * V log-likelihood ratios of the bigrams, random strings over identifiers; all 0 without samples of both labels.

    samples: (text, label), label 1 for random strings. Identifiers also count between separators, and dates beside them.
    The counts are aggregated in Spark; only the table of fixed size comes to the driver.
    """
    framed = F.transform(F.array(*map(F.lit, SEPARATORS)), lambda c: F.concat(c, "text", c))
    more = samples.filter("label = 0").select(F.explode(framed).alias("text"), "label", F.lit(0).alias("own"))
    day = F.timestamp_seconds(F.col("id") * 1_000_003)
    dates = samples.sparkSession.range(DIGESTS).select(F.explode(F.array(*(F.date_format(day, d) for d in DATES))).alias("text"), F.lit(0).alias("label"), F.lit(0).alias("own"))
    every = samples.select("text", "label", F.lit(1).alias("own")).unionByName(more).unionByName(dates)
    pairs = every.select("label", "own", F.explode(_pairs(F.col("text"))).alias("pair"))
    n = pairs.groupBy("pair").agg(F.sum(F.col("label").cast("double")).alias("r"), F.sum(1.0 - F.col("label")).alias("o"), F.sum(F.col("own") * (1 - F.col("label"))).alias("own")).toPandas()
    import numpy as np

    r, o = np.zeros(V * V), np.zeros(V * V)
    r[n["pair"]], o[n["pair"]] = n["r"], n["o"]
    if not (r.sum() and n["own"].sum()):
        return [0.0] * (V * V)

    def logp(counts: np.ndarray) -> np.ndarray:
        """Smoothed towards the frequency of the second character, so that a rare character tells something after any other."""
        c = counts.reshape(V, V)
        alone = (c.sum(0) + 0.5) / (c.sum() + 0.5 * V)
        return np.log((c + smooth * V * alone) / (c.sum(1, keepdims=True) + smooth * V)).ravel()

    return [round(float(x), 6) for x in logp(r) - logp(o)]


def ratio(s: Column, model: list[float]) -> Column:
    """The log-likelihood ratio of a string, in one pass over its characters."""
    ratios = F.from_json(F.lit(json.dumps(model)), "array<double>")
    start = F.struct(F.lit(START).alias("at"), F.lit(0.0).alias("sum"))

    def step(acc: Column, char: Column) -> Column:
        code = _code(char)
        return F.struct(code.alias("at"), (acc["sum"] + F.element_at(ratios, acc["at"] * V + code + 1)).alias("sum"))

    return F.aggregate(_chars(s), start, step, lambda acc: acc["sum"])


def secret_spans(text: Column, model: list[float], threshold: float = THRESHOLD) -> tuple[Column, Column]:
    """Base spans, and the added ones (kind 3): long tokens that overlap no base span and look random."""
    base = base_spans(text)
    long = _matches(text, len(KINDS), TOKEN, 0, 16, TOKEN)
    return base, F.filter(long, lambda x: ratio(x["value"], model) > F.greatest(F.lit(threshold), PER_CHAR * F.length(x["value"])))


def _apart(base: Column, more: Column) -> Column:
    """The added spans that overlap no base span: among all by start, none before ends within one, and none behind begins within it."""
    own = lambda x: x["kind"] < len(KINDS)

    def apart(spans: Column) -> Column:
        ends = _prefix_max(F.transform(spans, lambda x: F.when(own(x), x["end"]).otherwise(0)))
        # from the end, the least start is the greatest distance from beyond the last
        starts = F.reverse(_prefix_max(F.reverse(F.transform(spans, lambda x: F.when(own(x), FAR - x["start"]).otherwise(0)))))
        kept = lambda e, s: F.filter(spans, lambda x, i: ~own(x) & (F.get(e, i) <= x["start"]) & (FAR - F.get(s, i) >= x["end"]))
        return _let(ends, lambda e: _let(starts, lambda s: kept(e, s)))

    return F.when((F.size(base) > 0) & (F.size(more) > 0), _let(F.array_sort(F.concat(base, more)), apart)).otherwise(more)


def _joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, [*KINDS, "random"]))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, model: list[float]) -> DataFrame:
    """All columns of docs, with base and spans: arrays of (start, end, kind, value), spans by start, then kind.

    A null text counts as empty. Rows may repeat; each is scanned on its own.
    """
    text = F.coalesce("text", F.lit(""))
    base, more = secret_spans(text, model)
    d = docs.withColumns({"_base": base, "_more": more})
    return d.withColumn("_spans", F.array_sort(F.concat("_base", _apart(F.col("_base"), F.col("_more"))))).drop("_more")


def _cut(blocks: Column, start: Column, end: Column) -> Column:
    """Characters start to end of a text given in blocks of PIECE."""
    of = lambda i: F.floor(i / PIECE).cast("int")
    near = F.array_join(F.slice(blocks, of(start) + 1, of(end - 1) - of(start) + 1), "")
    return F.when(end > start, F.substring(near, start - of(start) * PIECE + 1, end - start)).otherwise(F.lit(""))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span, or run of overlapping spans, replaced by MARK."""

    def pieces(s: Column, e: Column, b: Column) -> Column:
        each = F.transform(s, lambda x, i: F.when(x["start"] >= F.get(e, i), F.concat(_cut(b, F.get(e, i), x["start"]), F.lit(MARK))).otherwise(F.lit("")))
        return F.concat(F.array_join(each, ""), F.substring(text, F.array_max(F.transform(s, lambda x: x["end"])) + 1, F.length(text)))

    blocks, ends = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0)), lambda s: _prefix_max(F.transform(s, lambda x: x["end"]))
    return F.when(F.size(spans) > 0, _let(spans, lambda s: _let(ends(s), lambda e: _let(blocks, lambda b: pieces(s, e, b))))).otherwise(text)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their secrets replaced; n_chars is counted anew where the text changes.

    A null text stays null, an empty one empty; every row is scanned on its own, repeated ones too, and rows without id like
    others; an empty table stays empty.
    """
    model = fit(training_samples(docs))
    found = scan(docs, model).withColumn("_new", redacted(F.col("text"), F.col("_spans")))
    changed = F.size("_spans") > 0
    new = {"text": F.col("_new"), "n_chars": F.when(changed, F.length("_new").cast("long")).otherwise(F.col("n_chars"))}
    return found.select(*(new[c].alias(c) if c in new else c for c in docs.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans; and n_random, the number of added spans.

    Null and empty texts have no spans; the digest is then that of the empty string. An empty table gives an
    empty result. Columns other than doc_id and text are not read.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    d = scan(docs, fit(training_samples(docs)))
    n = lambda k: F.size(F.filter("_spans", lambda x: x["kind"] == k)).cast("long")
    return d.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"), _joined(F.col("_spans")).alias("spans"), n(3).alias("n_random"))
