"""Quality rules with robust multivariate outliers, in DataFrame functions only.

Every document gets counts (words, symbols, repeated lines, repeated three-word windows). Transformed rates
form a vector; a regularised minimum-covariance-determinant estimate per language and source gives its
Mahalanobis distance, and documents beyond a cut-off are rejected. The estimate of n rows of a language and source is drawn
towards its language's as if that stood for PRIOR more rows, and so is a language's towards that of all rows; so
few rows don't judge themselves, many do, and nothing changes at any particular number. A language's estimate is made of all
its rows, whatever their source.

The estimate starts from coordinate medians and quartiles and makes concentration steps: distances under
the present estimate, then mean and covariance of the h nearest rows. Each step is one aggregation of
count and moment sums by (group, distance bin); the h nearest rows are the lowest bins. The
vectors are whole hundredths, so that sums of doubles are exact and reruns agree.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.llm.common import NOT_SPACE, SPACE, table, words_of, written

P = 5
X = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]
#: Least standard deviation of each coordinate, in hundredths: log mean word length, symbols, repeated lines, repeated windows, capitals.
FLOORS = (15.0, 40.0, 55.0, 60.0, 25.0)
#: Share of rows in the half-sample, and what makes its covariance consistent for five normal coordinates.
SHARE, CONSISTENT = 0.75, 1.41
#: The chi-square quantile of 5 degrees of freedom at 1 - 1e-5.
CUT = 30.86
#: Rows that the estimate above counts for, and concentration steps.
PRIOR, STEPS = 100.0, 4


def counts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, lang, source and the counts of every document, and the columns named by `more`; a null text counts as empty.

    n_repeat_words are the words that lie in a three-word window found at least twice in the text: equal
    windows are found by sorting (hash, position) within the row, so no row leaves its task.
    """
    d = docs.select("doc_id", "lang", "source", *more, F.coalesce("text", F.lit("")).alias("t"))
    d = d.withColumn("w", words_of(F.col("t"))).withColumn("lines", F.filter(F.split("t", "\n", -1), lambda x: x.rlike(NOT_SPACE)))
    d = d.withColumn("h", F.transform("w", lambda x: F.xxhash64(x)))
    part = lambda k: F.slice("h", F.lit(k), F.size("h") - 2)
    windows = F.zip_with(F.zip_with(part(1), part(2), lambda x, y: F.xxhash64(x, y)), part(3), lambda x, y: F.xxhash64(x, y))
    d = d.withColumn("tri", F.when(F.size("h") >= 3, windows))
    pairs = F.array_sort(F.transform("tri", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("s", F.when(F.size(F.array_distinct("tri")) < F.size("tri"), pairs))
    twice = lambda x, i: F.when((x["h"] == F.get("s", i - 1)["h"]) | (x["h"] == F.get("s", i + 1)["h"]), x["i"])
    d = d.withColumn("at", F.array_sort(F.filter(F.transform("s", twice), lambda p: p.isNotNull())))
    covered = F.transform("at", lambda p, i: F.least(F.lit(3), F.coalesce(F.get("at", i + 1) - p, F.lit(3))))
    size = lambda c: F.size(c).cast("long")
    return d.select(
        "doc_id", "lang", "source", *more,
        size("w").alias("n_words"),
        F.length(F.regexp_replace("t", f"{SPACE}+", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (size("lines") - size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.coalesce(F.aggregate(covered, F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long").alias("n_repeat_words"),
        size("lines").alias("n_lines"),
        (F.length("t") - F.length(F.regexp_replace("t", r"\p{Lu}+", ""))).cast("long").alias("n_upper"),
    ).withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def vectors(c: DataFrame) -> DataFrame:
    """Adds x0 to x4, in whole hundredths, and the keys lk and sk (a null language or source is a key of its own)."""
    rate = lambda a, b, k: F.log1p(F.lit(float(k)) * F.col(a) / F.greatest(F.col(b), F.lit(1)))
    xs = [
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        rate("n_symbols", "word_chars", 100), rate("n_dup_lines", "n_lines", 10), rate("n_repeat_words", "n_words", 10), rate("n_upper", "word_chars", 10),
    ]
    key = lambda k: F.coalesce(F.concat(F.lit("="), k), F.lit("null"))
    return c.withColumns({x: F.round(100 * e) for x, e in zip(X, xs)}).withColumns({"lk": key("lang"), "sk": key("source")})


def cholesky(c: dict[tuple[int, int], Column]) -> list[tuple[str, Column]]:
    """Columns l{i}{j} of the lower factor of a symmetric matrix, each from those before it."""
    out = []
    for j in range(P):
        s = reduce(lambda a, k: a - F.col(f"l{j}{k}") ** 2, range(j), c[j, j])
        out.append((f"l{j}{j}", F.sqrt(s)))
        for i in range(j + 1, P):
            s = reduce(lambda a, k, i=i, j=j: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), c[i, j])
            out.append((f"l{i}{j}", s / F.col(f"l{j}{j}")))
    return out


def factored(groups: DataFrame, means: dict[int, Column], cov: dict[tuple[int, int], Column]) -> DataFrame:
    """Per group g: the means m{i} and the factor of the covariance with the floors added to its diagonal."""
    g = groups.select("g", *(means[i].alias(f"m{i}") for i in range(P)), *((cov[i, j] + F.lit(FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in PAIRS))
    for name, col in cholesky({(i, j): F.col(f"c{i}{j}") for i, j in PAIRS}):
        g = g.withColumn(name, col)
    return g.drop(*(f"c{i}{j}" for i, j in PAIRS))


def with_distance(rows: DataFrame, model: DataFrame, on: tuple[str, ...] = ("lk", "sk")) -> DataFrame:
    """Adds d2, the squared Mahalanobis distance, by forward substitution with the group's factor."""
    r = rows.join(model, list(on), "left")
    for i in range(P):
        s = reduce(lambda a, k, i=i: a - F.col(f"l{i}{k}") * F.col(f"z{k}"), range(i), F.col(X[i]) - F.col(f"m{i}"))
        r = r.withColumn(f"z{i}", s / F.col(f"l{i}{i}"))
    return r.withColumn("d2", reduce(lambda a, i: a + F.col(f"z{i}") ** 2, range(1, P), F.col("z0") ** 2))


MOMENTS = ["n", *(f"m{i}" for i in range(P)), *(f"c{i}{j}" for i, j in PAIRS)]


def drawn(own: DataFrame, above: DataFrame, prior: float) -> DataFrame:
    """The moments of groups (g, up), each drawn towards those of the group above it."""
    a = above.select(F.col("g").alias("up"), *(F.col(c).alias(f"up_{c}") for c in MOMENTS))
    share = F.col("n") / (F.col("n") + F.lit(float(prior)))
    both = own.join(a.hint("merge"), "up")  # small tables, of which many would fill the driver as broadcasts
    return both.select("g", "n", *((share * F.col(c) + (1 - share) * F.col(f"up_{c}")).alias(c) for c in MOMENTS[1:]))


def fit(rows: DataFrame, prior: float = PRIOR, steps: int = STEPS) -> DataFrame:
    """The estimate for every (lk, sk): each step takes the half-sample of every pair, language and of all rows, and draws the former towards the latter."""
    pair, lang = F.concat(F.lit("p"), "lk", F.lit("\x01"), "sk"), F.concat(F.lit("l"), "lk")
    keys = written(rows.groupBy("lk", "sk").agg(F.lit(1)).select("lk", "sk", pair.alias("g"), lang.alias("up")), "mcd-keys")
    rows = rows.select(F.explode(F.array(pair, lang, F.lit(""))).alias("g"), *X)

    def model_of(moments: DataFrame) -> DataFrame:
        m = written(moments, "mcd-moments")
        whole = m.filter("g = ''").select("g", *MOMENTS)
        langs = drawn(m.join(keys.select(F.col("up").alias("g"), F.substring("up", 1, 0).alias("up")).distinct().hint("merge"), "g"), whole, prior)
        pairs = drawn(m.join(keys.select("g", "up").hint("merge"), "g"), langs, prior)
        every = whole.unionByName(langs).unionByName(pairs)
        return written(factored(every, {i: F.col(f"m{i}") for i in range(P)}, {(i, j): F.col(f"c{i}{j}") for i, j in PAIRS}), "mcd-step")

    quarts = rows.groupBy("g").agg(F.count("*").cast("double").alias("n"), *(F.percentile(x, F.array(*map(F.lit, (0.25, 0.5, 0.75)))).alias(x) for x in X))
    spread = {(i, j): ((F.col(X[i])[2] - F.col(X[i])[0]) / 1.349) ** 2 if i == j else F.lit(0.0) for i, j in PAIRS}
    model = model_of(quarts.select("g", "n", *(F.col(X[i])[1].alias(f"m{i}") for i in range(P)), *(spread[i, j].alias(f"c{i}{j}") for i, j in PAIRS)))
    for _ in range(steps):
        near = with_distance(rows, model, ("g",)).withColumn("bin", F.floor(50 * F.log1p("d2")))
        bins = near.groupBy("g", "bin").agg(
            F.count("*").alias("n"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(X)), *(F.sum(F.col(X[i]) * F.col(X[j])).alias(f"q{i}{j}") for i, j in PAIRS)
        )
        seen = F.coalesce(F.sum("n").over(Window.partitionBy("g").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        low = bins.withColumns({"seen": seen, "all": F.sum("n").over(Window.partitionBy("g"))}).filter(F.col("seen") < F.ceil(SHARE * F.col("all")))
        sums = low.groupBy("g").agg(F.sum("n").alias("h"), F.first("all").cast("double").alias("n"), *(F.sum(f"s{i}").alias(f"s{i}") for i in range(P)), *(F.sum(f"q{i}{j}").alias(f"q{i}{j}") for i, j in PAIRS))
        mean = {i: F.col(f"s{i}") / F.col("h") for i in range(P)}
        cov = {(i, j): F.lit(CONSISTENT) * (F.col(f"q{i}{j}") / F.col("h") - mean[i] * mean[j]) for i, j in PAIRS}
        model = model_of(sums.select("g", "n", *(mean[i].alias(f"m{i}") for i in range(P)), *(cov[i, j].alias(f"c{i}{j}") for i, j in PAIRS)))
    return written(keys.drop("up").join(model, "g").drop("g"), "mcd-model")  # so that its size is known where it meets the rows


def quality_rules(docs: DataFrame, prior: float = PRIOR, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, the counts, base_failed, d2 (null if base_failed) and kept.

    Null text, language, source or id: the text counts as empty, a null language or source is a group of
    its own. An empty or very short text fails the base rules. Repeated rows each get their verdict. An empty
    table gives an empty result. Columns other than doc_id, text, lang and source are not read.
    """
    rows = written(vectors(counts(docs)), "quality-vectors")
    model = fit(rows.filter(~F.col("base_failed")), prior)
    scored = with_distance(rows, model)
    d2 = F.when(~F.col("base_failed"), F.col("d2"))
    kept = ~F.col("base_failed") & (F.coalesce(d2, F.lit(0.0)) <= cut)
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", d2.alias("d2"), kept.alias("kept"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rules keep, with their columns as they were; every row is judged by its own text.

    The counts are written beside the row, so that no verdict has to find its document again. Null and empty texts fail the
    base rules and go; rows without id, language or source are judged like others, repeated rows each; an empty table
    stays empty.
    """
    row = docs.select("doc_id", "lang", "source", "text", F.struct(*(docs[c] for c in docs.columns)).alias("_doc"))
    rows = written(vectors(counts(row, "_doc")), "quality-vectors")
    good = rows.filter(~F.col("base_failed"))
    kept = with_distance(good, fit(good.drop("_doc"))).filter(F.coalesce("d2", F.lit(0.0)) <= CUT)
    return kept.select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
