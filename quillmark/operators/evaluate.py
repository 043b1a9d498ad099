"""Evaluation of recorded answers against a bank of cases. Flags are null where they don't apply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import cited_codes, fold
from quillmark.operators.guardrails import COMMON_TITLE_WORDS
from quillmark.operators.retrieval import title_words
from quillmark.operators.selection import with_median

#: How an answer names a kind of document, and how it begins where it doesn't begin with the answer.
CONNECTOR = r"\b(el|la|los|las)\s+(procedimiento|politica|manual|instructivo|formato|plan|organigrama|documento|ficha|registro)\b"
PREAMBLE = r"(?i)^\s*(seg[uúÚ]n|de acuerdo|conforme|tal como|bas[aáÁ]ndome|en el documento|el documento \w+-\w+-\d)"
METRICS = ("citation", "section", "tool", "escalation", "no_phantom", "grounded_ok")


def flags(cases: DataFrame, known: DataFrame) -> DataFrame:
    """Adds the flags and hit to cases (case_no, model, answer, expected_code, expected_section, expected_tool, used_tool, must_escalate, escalated, grounded)."""
    c = cases.withColumn("codes", cited_codes(F.col("answer")))
    bad = c.select("case_no", F.explode("codes").alias("code")).join(known.select("code").distinct(), "code", "left_anti")
    bad = bad.groupBy("case_no").agg(F.sort_array(F.collect_set("code")).alias("phantoms"))
    c = c.join(bad, "case_no", "left").withColumn("phantoms", F.coalesce("phantoms", F.array().cast("array<string>")))
    c = c.withColumns({
        "citation": F.when(F.col("expected_code").isNotNull(), F.array_contains("codes", F.col("expected_code"))),
        "section": F.when(F.col("expected_section").isNotNull(), F.col("answer").contains(F.col("expected_section"))),
        "tool": F.when(F.col("expected_tool").isNotNull(), F.col("used_tool") == F.col("expected_tool")),
        "escalation": F.col("escalated") == F.col("must_escalate"),
        "no_phantom": F.size("phantoms") == 0,
        "grounded_ok": F.when(F.col("expected_code").isNotNull(), F.col("grounded")),
    })
    return c.withColumn("hit", F.coalesce("citation", F.lit(True)) & F.coalesce("tool", F.lit(True)) & F.col("escalation") & F.col("no_phantom"))


def percent(c: Column) -> Column:
    """Share of true among values that are not null, in percent; null if there is none."""
    return F.avg(c.cast("int")) * 100


def metrics(flagged: DataFrame) -> DataFrame:
    g = flagged.groupBy("model").agg(*(percent(F.col(m)).alias(m) for m in METRICS), percent(F.col("hit")).alias("hit"), F.max("latency").alias("max_latency"))
    return with_median(g, flagged, "model", F.col("latency"), "median_latency")


def failures(flagged: DataFrame) -> DataFrame:
    """(case_no, model, reasons) of cases that fail in citation, tool, escalation or phantoms."""
    why = F.array(F.when(~F.col("citation"), F.concat_ws("", F.lit("esperaba "), "expected_code")), F.when(~F.col("tool"), F.concat_ws("", F.lit("no uso "), "expected_tool")), F.when(~F.col("escalation"), "escalacion"), F.when(~F.col("no_phantom"), F.concat(F.lit("CITA INVENTADA: "), F.array_join("phantoms", ","))))
    f = flagged.withColumn("reasons", F.filter(why, lambda r: r.isNotNull()))
    return f.filter(F.size("reasons") > 0).select("case_no", "model", F.array_join("reasons", "; ").alias("reasons"))


def attribution(answers: DataFrame, titles: DataFrame) -> DataFrame:
    """Adds named to answers (id, tenant_id, answer): codes of titles (tenant_id, code, title) of which the answer has two distinctive words, after a connector.

    Equal answers of a tenant are read once. Words are joined to titles by equality, so only titles that share a word meet an
    answer.
    """
    words = lambda c: F.array_distinct(F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9_]+"), F.lit(0)))
    a = answers.select("tenant_id", "answer").distinct().filter(fold(F.col("answer")).rlike(CONNECTOR)).select("tenant_id", "answer", F.explode(words(F.col("answer"))).alias("w"))
    t = titles.select("tenant_id", "code", "title").distinct().select("*", F.explode(title_words(F.col("title"), COMMON_TITLE_WORDS)).alias("w"))
    n = a.join(t, ["tenant_id", "w"]).groupBy("tenant_id", "answer", "code", "title").agg(F.count("*").alias("n")).filter("n >= 2")
    named = n.groupBy("tenant_id", "answer").agg(F.sort_array(F.collect_set("code")).alias("named"))
    return answers.join(named, ["tenant_id", "answer"], "left").withColumn("named", F.coalesce("named", F.array().cast("array<string>")))


def obedience(flagged: DataFrame) -> DataFrame:
    """Per model: answers without code, answers that begin with the answer, median length; blank and error rows are left out of these."""
    good = (F.col("answer") != "") & ~F.col("answer").startswith("(error")
    g = flagged.groupBy("model").agg(percent(F.col("hit")).alias("hit"), percent(F.when(good, F.size("codes") == 0)).alias("without_code"), percent(F.when(good, ~F.col("answer").rlike(PREAMBLE))).alias("answer_first"))
    return with_median(g, flagged, "model", F.when(good, F.length("answer")), "median_chars")


def compare(flagged: DataFrame, a: str, b: str) -> DataFrame:
    """(question, hit_a, hit_b) of the questions that two models were both asked."""
    side = lambda m, n: flagged.filter(F.col("model") == m).select("question", F.col("hit").alias(n))
    return side(a, "hit_a").join(side(b, "hit_b"), "question")


def states(flagged: DataFrame) -> DataFrame:
    return flagged.groupBy("question").pivot("model", ["base", "rag", "tuned"]).agg(F.max(F.col("hit").cast("int")))


def invented(flagged: DataFrame) -> DataFrame:
    """(model, code, n): invented codes."""
    return flagged.select("model", F.explode("phantoms").alias("code")).groupBy("model", "code").agg(F.count("*").alias("n"))


def attach_traces(cases: DataFrame, traces: DataFrame) -> DataFrame:
    """Cases (case_no, conversation_id) with tools and grounded of the latest assistant trace of their conversation."""
    last = traces.filter("role = 'assistant'").groupBy("conversation_id").agg(F.max_by("trace", "id").alias("trace"))
    tools = F.from_json(F.get_json_object("trace", "$.tools"), "array<string>")
    return cases.join(last, "conversation_id", "left").select("case_no", "conversation_id", F.array_join(tools, ",").alias("tools"), F.get_json_object("trace", "$.grounded").alias("grounded"))
