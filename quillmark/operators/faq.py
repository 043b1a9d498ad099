"""Question and answer pairs: rules, deduplication, loading, and JSON out of model text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import base_code, cited_codes, number_set, question_key, strings
from quillmark.operators.clauses import worth_questions

MIN_ANSWER, MAX_ANSWER = 20, 600
#: Phrases of uncertainty, and figures that need no source.
UNSURE = (
    "no se especifica", "no se indica", "no se menciona", "no esta claro", "no queda claro", "podria ser", "probablemente", "se asume", "asumiendo", "no se detalla",
    "el texto no", "el fragmento no", "la clausula no", "no proporciona",
)
IGNORED_FIGURES = ("9001", "9000", "14001", "45001", "2015", "2018")


def validate(pairs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds reason and detail of the first rule that a pair (id, pregunta, respuesta, clausula, codigo) fails, null if none.

    known: codes (code) that exist; without it that rule is left out.
    """
    q, a = F.trim(F.coalesce("pregunta", F.lit(""))), F.trim(F.coalesce("respuesta", F.lit("")))
    said = F.filter(strings(UNSURE), lambda p: F.lower(a).contains(p))
    figures = F.array_except(F.array_except(number_set(a), number_set(F.col("clausula"))), strings(IGNORED_FIGURES))
    foreign = F.array_except(F.array_except(cited_codes(a), cited_codes(F.col("clausula"))), F.array(base_code(F.col("codigo"))))
    listed = lambda x: F.array_join(F.array_sort(x), ", ")
    p = pairs.withColumn("_base", base_code(F.col("codigo")))
    if known is not None:
        c = p.select("id", "_base", F.explode(cited_codes(a)).alias("code")).filter("code <> _base").join(known.select("code").distinct(), "code", "left_anti")
        p = p.join(c.groupBy("id").agg(F.sort_array(F.collect_set("code")).alias("_unknown")), "id", "left")
    else:
        p = p.withColumn("_unknown", F.lit(None).cast("array<string>"))
    rule = lambda test, reason, detail: F.when(test, F.struct(F.lit(reason).alias("reason"), detail.alias("detail")))
    first = F.coalesce(
        rule((F.length(q) < 10) | ~q.endswith("?"), "pregunta_vacia", F.substring(q, 1, 60)), rule(~F.length(a).between(MIN_ANSWER, MAX_ANSWER), "longitud", F.concat(F.length(a).cast("string"), F.lit(" caracteres"))),
        rule(F.size(said) > 0, "incertidumbre", F.get(said, F.lit(0))), rule(F.size(figures) > 0, "cifra_inventada", listed(figures)), rule(F.size(foreign) > 0, "codigo_inventado", listed(foreign)),
        rule(F.size("_unknown") > 0, "codigo_inexistente", listed(F.col("_unknown"))),
    )
    return p.withColumn("_first", first).withColumns({"reason": F.col("_first.reason"), "detail": F.col("_first.detail")}).drop("_first", "_base", "_unknown")


def first_of_each(pairs: DataFrame) -> DataFrame:
    """Adds duplicate to valid pairs (pos, item, pregunta): all but the first of each question key."""
    place = F.row_number().over(Window.partitionBy("_key").orderBy("pos", "item"))
    return pairs.withColumn("_key", question_key(F.col("pregunta"))).withColumn("duplicate", place > 1).drop("_key")


def candidate_clauses(chunks: DataFrame, documents: DataFrame, areas: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Clauses in force that are worth questions, of some areas and codes if given."""
    d = documents.filter("status = 'vigente'").select(F.col("id").alias("document_id"), "code", "version", "area")
    d = d.filter(F.col("area").isin(areas)) if areas else d
    d = d.filter(F.col("code").rlike(prefix)) if prefix else d
    return chunks.join(d, "document_id").filter(worth_questions(F.col("content"))).select(F.col("id").alias("chunk_id"), "code", "version", "area", "section")


def load(entries: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Entries (id, tenant_id, codigo, seccion, pregunta, respuesta) with their document and, where there is one, their clause; a question once per document.

    Of documents of one base code, and of clauses of one section, the last id holds.
    """
    d = documents.groupBy("tenant_id", base_code(F.col("code")).alias("base")).agg(F.max("id").alias("document_id"))
    c = chunks.groupBy("document_id", "section").agg(F.max("id").alias("chunk_id")).withColumnRenamed("section", "seccion")
    e = entries.withColumn("base", base_code(F.col("codigo"))).join(d, ["tenant_id", "base"]).join(c, ["document_id", "seccion"], "left")
    place = F.row_number().over(Window.partitionBy("tenant_id", "document_id", "pregunta").orderBy("id"))
    return e.withColumn("place", place).filter("place = 1").select("id", "tenant_id", "document_id", "chunk_id", "seccion", "pregunta", "respuesta")


def first_object(c: Column) -> Column:
    """The first brace-balanced piece of a text; null without one. Braces within strings count as well."""
    text = F.substring(c, F.locate("{", c), F.length(c))
    chars = F.split(text, "")
    state = "struct<depth:int,at:int,end:int>"

    def step(a: Column, ch: Column) -> Column:
        depth = a["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        at = a["at"] + F.length(ch)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((a["end"] == 0) & (ch == "}") & (depth == 0), at).otherwise(a["end"]).alias("end")).cast(state)

    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end")).cast(state)
    end = F.aggregate(chars, start, step, lambda a: a["end"])
    return F.when((F.locate("{", c) > 0) & (end > 0), F.substring(text, F.lit(1), end))


def clause_key(code: Column, section: Column) -> Column:
    return F.concat(code, F.lit("§"), F.coalesce(section, F.lit("-")))
