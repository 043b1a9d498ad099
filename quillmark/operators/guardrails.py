"""Audit of recorded answers: citations, versions, sections, claims of records, and the verdict on each turn."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import CODE_CITED, base_code, cited_codes, fold
from quillmark.operators.retrieval import title_words

#: Words that titles share, the question that offers to pass a case on, and marks of an echoed prompt.
COMMON_TITLE_WORDS = (
    "de", "del", "la", "el", "los", "las", "y", "en", "para", "por", "a", "procedimiento", "manual", "instructivo", "formato", "politica", "plan",
    "gestion", "calidad", "sistema", "documento", "documentos", "general",
)
OFFER = "¿Quieres que lo derive al Responsable de Calidad para que lo revise?"
PROMPT_MARKS = (
    "no inventes procedimientos", "no se recupero ningun fragmento", "y pregunta si quiere que lo derives", "la derivacion solo ocurre si el usuario la acepta",
    "responde unicamente con base en ellos", "fragmentos de documentos iso vigentes recuperados",
)
CITED_VERSION = r"(?i)\b([A-Z]{2,5}-[A-Z]{2,5}-\d{1,3})([\s,(]{0,3}(?:versi[oóÓ]n|ver\.?|v\.?)\s*)(\d{1,3})\b"
SECTION_NAMED = r"(?i)(?:secci[oóÓ]n|§|apartado|ac[aáÁ]pite)\s*(\d+(?:\.\d+)*)"
ACTION_ID = r"(?is)acci[oóÓ]n correctiva[^.\n]{0,90}?\bID\s*(\d{1,6})\b|\bID\s*(\d{1,6})\b[^.\n]{0,90}?acci[oóÓ]n correctiva"
FINDING_ID = r"(?is)(?:no conformidad|hallazgo|observaci[oóÓ]n)[^.\n]{0,90}?\bID\s*(\d{1,6})\b|\bID\s*(\d{1,6})\b[^.\n]{0,90}?(?:no conformidad|hallazgo)"
ESCALATING, CATALOGUE, READING = ("escalate_to_quality",), ("buscar_documentos",), ("leer_documento",)


def by_answer(retrieved: DataFrame) -> DataFrame:
    """One row per answer of (id, tenant_id, answer, chunk columns): its retrieved clauses as an array, nearest first."""
    c = F.struct("distance", "chunk_id", "code", "version", "section", "title", "content")
    return retrieved.groupBy("id", "tenant_id", "answer").agg(F.array_sort(F.collect_list(c)).alias("chunks"))


def classify(answers: DataFrame, known: DataFrame) -> DataFrame:
    """Adds backed, not_retrieved and phantom to answers (id, tenant_id, answer, chunks); known is (tenant_id, code).

    Codes that retrieved clauses have or name are backed. The others are joined to the known codes of the tenant, one row
    per cited code.
    """
    own = F.transform("chunks", lambda c: base_code(c["code"]))
    named = F.flatten(F.transform("chunks", lambda c: cited_codes(c["content"])))
    a = answers.withColumn("cited", cited_codes(F.col("answer"))).withColumn("backed", F.array_intersect("cited", F.array_union(own, named)))
    rest = a.select("id", "tenant_id", F.explode(F.array_except("cited", "backed")).alias("code")).join(known.withColumn("known", F.lit(True)), ["tenant_id", "code"], "left")
    g = rest.groupBy("id").agg(F.sort_array(F.collect_set(F.when(F.col("known"), F.col("code")))).alias("not_retrieved"), F.sort_array(F.collect_set(F.when(F.col("known").isNull(), F.col("code")))).alias("phantom"))
    none = F.array().cast("array<string>")
    return a.join(g, "id", "left").withColumns({"backed": F.sort_array("backed"), "not_retrieved": F.coalesce("not_retrieved", none), "phantom": F.coalesce("phantom", none)})


def cites_source(answer: Column, chunks: Column) -> Column:
    """Whether an answer names a retrieved code, qualifier included, or two distinctive words of a retrieved title."""
    squeeze = lambda c: F.upper(F.regexp_replace(c, r"[\s_\-]+", ""))
    words = F.regexp_extract_all(fold(answer), F.lit(r"[a-z0-9_]+"), F.lit(0))
    by_title = F.exists(chunks, lambda c: F.size(F.array_intersect(title_words(c["title"], COMMON_TITLE_WORDS), words)) >= 2)
    return F.exists(chunks, lambda c: squeeze(answer).contains(squeeze(c["code"]))) | by_title


def cited_versions(c: Column) -> Column:
    """Distinct (code, version) that a text states."""
    codes, numbers = (F.regexp_extract_all(c, F.lit(CITED_VERSION), F.lit(i)) for i in (1, 3))
    return F.array_distinct(F.zip_with(codes, numbers, lambda k, n: F.struct(F.upper(k).alias("code"), F.concat(F.lit("v"), n.cast("int").cast("string")).alias("version"))))


def repair_versions(answers: DataFrame, versions: DataFrame) -> DataFrame:
    """Adds repaired and corrections ("CODE vX>vY") to (id, tenant_id, answer); versions is (tenant_id, code, versions, in_force).

    A stated version that the document never had becomes the one in force; "CODE vN" replaces the whole match.
    """
    whole, codes, numbers = (F.regexp_extract_all("answer", F.lit(CITED_VERSION), F.lit(i)) for i in (0, 1, 3))
    m = answers.select("id", "tenant_id", F.explode(F.array_distinct(F.arrays_zip(whole.alias("whole"), codes.alias("code"), numbers.alias("n")))).alias("m"))
    m = m.select("id", "tenant_id", "m.whole", F.col("m.code").alias("written"), F.upper("m.code").alias("code"), F.concat(F.lit("v"), F.col("m.n").cast("int").cast("string")).alias("version"))
    wrong = m.join(versions, ["tenant_id", "code"]).filter(~F.array_contains("versions", F.col("version")) & F.col("in_force").isNotNull())
    fixes = wrong.groupBy("id").agg(F.array_sort(F.collect_list(F.struct(F.length("whole").alias("n"), "whole", F.concat_ws(" ", "written", "in_force").alias("by"), F.concat(F.col("code"), F.lit(" "), F.col("version"), F.lit(">"), F.col("in_force")).alias("note")))).alias("fixes"))
    out = answers.join(fixes, "id", "left")
    text = F.aggregate(F.reverse("fixes"), F.col("answer"), lambda t, f: F.replace(t, f["whole"], f["by"]))  # longest first: a match may begin another
    return out.withColumns({"repaired": F.coalesce(text, "answer"), "corrections": F.coalesce(F.array_sort(F.transform("fixes", lambda f: f["note"])), F.array().cast("array<string>"))}).drop("fixes")


def sections_named(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(SECTION_NAMED), F.lit(1)))


def citations(answer: Column, chunks: Column, escalated: Column, empty_catalogue: Column) -> Column:
    """Distinct (code, version, section) that stand behind an answer, nearest first.

    Of the retrieved clauses those of cited codes, of these the named sections if any; without a cited code all of them, if
    the answer cites its source and was neither passed on nor out of an empty catalogue.
    """
    used, named = cited_codes(answer), sections_named(answer)
    of_code = F.filter(chunks, lambda c: F.array_contains(used, base_code(c["code"])))
    of_section = F.filter(of_code, lambda c: F.coalesce(F.array_contains(named, c["section"]), F.lit(False)))
    chosen = F.when(F.size(of_section) > 0, of_section).when(F.size(of_code) > 0, of_code).otherwise(chunks)
    none = (F.size(used) == 0) & (escalated | empty_catalogue | ~cites_source(answer, chunks))
    flat = F.array_distinct(F.transform(chosen, lambda c: F.struct(c["code"], c["version"], c["section"])))
    return F.when(none, F.slice(flat, 1, 0)).otherwise(flat)


def read_citations(reads: DataFrame) -> DataFrame:
    """(id, code, version, section) of answers that read documents (id, answer, code, version, sections): the sections named, else the document."""
    used = F.sort_array(F.array_intersect(sections_named(F.col("answer")), "sections"))
    return reads.select("id", "code", "version", F.explode_outer(F.when(F.size(used) > 0, used)).alias("section"))


def catalogue_citations(answers: DataFrame, documents: DataFrame) -> DataFrame:
    """Distinct documents in force, of the answer's tenant, whose code begins with a cited one: (id, code, version).

    Both sides are made distinct before they meet, so that their pairs, of which there may be many, are so without being held or
    shuffled: a code has one base. Only ids that stand for answers of several tenants need another pass over theirs.
    """
    c = answers.select("id", "tenant_id", F.explode(cited_codes(F.col("answer"))).alias("base")).distinct()
    of = Window.partitionBy("id")
    c = c.withColumn("shared", F.coalesce(F.min("tenant_id").over(of) != F.max("tenant_id").over(of), F.lit(False)))
    d = documents.filter("status = 'vigente'").select("tenant_id", "code", "version", F.regexp_extract("code", CODE_CITED, 0).alias("base")).distinct()
    of_each = lambda some: some.join(d, ["tenant_id", "base"]).select("id", "code", "version")
    return of_each(c.filter("NOT shared")).unionByName(of_each(c.filter("shared")).distinct())


def invented_records(answers: DataFrame, actions: DataFrame, findings: DataFrame) -> DataFrame:
    """(id, kind, record): records that answers claim and the tables (id) lack."""

    def claims(pattern: str, kind: str, table: DataFrame) -> DataFrame:
        ids = F.transform(F.arrays_zip(*(F.regexp_extract_all("answer", F.lit(pattern), F.lit(g)).alias(f"g{g}") for g in (1, 2))), lambda x: F.coalesce(F.nullif(x["g1"], F.lit("")), x["g2"]))
        c = answers.select("id", F.explode(F.array_distinct(ids)).alias("record")).select("id", F.lit(kind).alias("kind"), F.col("record").cast("long").alias("record"))
        return c.join(table.select(F.col("id").alias("record")), "record", "left_anti").select("id", "kind", "record")

    return claims(ACTION_ID, "accion correctiva", actions).unionByName(claims(FINDING_ID, "hallazgo", findings))


def echoes_prompt(c: Column) -> Column:
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(False)
    for mark in PROMPT_MARKS:
        out = out | low.contains(mark)
    return out


def yielded_data(result: Column) -> Column:
    """Whether a tool's JSON result has something to stand on: no error, and no empty list of documents, findings or actions."""
    ok = F.coalesce(F.get_json_object(result, "$.error"), F.lit("")).isin("", "false", "0")
    for k in ("documentos", "hallazgos", "acciones"):
        v = F.get_json_object(result, f"$.{k}")
        ok = ok & (v.isNull() | ~v.isin("[]", "{}", "", "0", "false"))
    return ok


def verdict(phantom: Column, echoed: Column, documental: Column, has_context: Column, has_data: Column, escalated: Column, empty: Column) -> Column:
    """What becomes of a turn. Arguments are booleans; documental is false while a finding of the conversation lacks its action."""
    blank = empty | echoed
    return (
        F.when(phantom, "phantom_citation").when(documental & ~has_context & ~has_data, "no_context").when(blank & escalated, "escalated")
        .when(blank & documental, "no_context").when(blank, "no_answer").otherwise("answered")
    )


def grounded(read: Column, catalogued: Column, has_data: Column, has_context: Column, cites: Column, not_retrieved: Column) -> Column:
    return read | catalogued | has_data | (has_context & cites & ~not_retrieved) | ~cites


def gaps(turns: DataFrame) -> DataFrame:
    """Escalations of turns (id, documental, escalated, offered, accepted, missing) that the documents don't cover: terms missing, nothing accepted."""
    some = turns.filter("documental AND NOT escalated AND NOT offered AND accepted = 0 AND size(missing) > 0")
    return some.select("id", F.concat(F.lit("El SGC no cubre: "), F.array_join("missing", ", "), F.lit(". Se respondio desde el catalogo.")).alias("reason"), F.lit("sin_contexto").alias("cause"), F.lit("propuesta").alias("status"))


def offers(c: Column) -> Column:
    return F.rtrim(F.coalesce(c, F.lit(""))).endswith(OFFER)


def with_offer(c: Column) -> Column:
    """The text ending in the offer exactly once; a closing question of its own gives way to it."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+$", "")
    cut = F.when(t.endswith("?") & t.contains("¿"), F.regexp_replace(F.substring(t, F.lit(1), F.length(t) - F.length(F.substring_index(t, "¿", -1)) - 1), r"\s+$", "")).otherwise(t)
    return F.when(t.endswith(OFFER), t).when(cut == "", OFFER).otherwise(F.concat(cut, F.lit("\n\n" + OFFER)))


def pending_actions(findings: DataFrame, actions: DataFrame) -> DataFrame:
    """Conversations with a finding that is not closed and has no action."""
    return findings.filter("status <> 'cerrado'").join(actions.select(F.col("finding_id").alias("id")), "id", "left_anti").select("conversation_id").distinct()


def production_without_request(kind: Column, request: Column, answer: Column, message: str) -> Column:
    """The answer, or a message where material was asked for and no request was made."""
    return F.when((kind == "produccion") & request.isNull(), F.lit(message)).otherwise(answer)


def trace_rows(answers: DataFrame, max_distance: float) -> DataFrame:
    """Assistant rows (id, content, chunk_ids, trace) of classified answers: accepted clauses and the turn as JSON."""
    item = lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["code"].alias("code"), c["version"].alias("version"), c["section"].alias("section"), F.round(c["distance"], 4).alias("distance"))
    trace = F.struct(F.struct(F.lit(max_distance).alias("max_distance"), F.transform("chunks", item).alias("accepted")).alias("retrieval"), (F.size("phantom") == 0).alias("grounded"), F.lit(False).alias("escalate"))
    return answers.select("id", F.col("answer").alias("content"), F.transform("chunks", lambda c: c["chunk_id"]).alias("chunk_ids"), F.to_json(trace).alias("trace"))


def last_of(df: DataFrame, by: str, order: str) -> DataFrame:
    return df.withColumn("_p", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))).filter("_p = 1").drop("_p")
