"""Training examples out of questions and clauses: attribution, decontamination, caps, leak-free splits, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import base_code, cited_codes, document_type, fold
from quillmark.operators.guardrails import cites_source
from quillmark.operators.selection import with_median

#: Sentences that attribute an answer, and what types of documents are called.
TEMPLATES = (" Lo define ", " Esta en ", " Lo indica ", " Lo establece ")
NAMES = {"PR": "el procedimiento", "PO": "la politica", "MN": "el manual", "IN": "el instructivo", "FO": "el formato", "PL": "el plan", "OR": "el organigrama", "OB": "el documento"}


def clause_table(clauses: DataFrame) -> DataFrame:
    """The last clause (pos) of every (code, section), a missing section as '-'."""
    c = clauses.withColumn("section", F.coalesce("section", F.lit("-")))
    cols = [k for k in c.columns if k not in ("code", "section")]
    return c.groupBy("code", "section").agg(F.max_by(F.struct(*cols), "pos").alias("x")).select("code", "section", "x.*")


def attributed(answer: Column, code: Column, version: Column, title: Column, section: Column, variant: Column) -> Column:
    """The answer with its source: by title in the template of the variant, by code as well where the title has no two distinctive words."""
    base = F.concat(F.trim(F.regexp_replace(answer, r"[. ]+$", "")), F.lit("."))
    readable = F.when(F.upper(title) == title, F.concat(F.upper(F.substring(title, 1, 1)), F.lower(F.substring(title, 2, 10_000)))).otherwise(title)
    named = F.concat(F.coalesce(F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))[document_type(base_code(code))], F.lit("el documento")), F.lit(" "), F.trim(readable))
    at = F.coalesce(F.concat(F.lit(", seccion "), section), F.lit(""))
    lead = F.concat(base, F.element_at(F.array(*map(F.lit, TEMPLATES)), (variant % len(TEMPLATES)).cast("int") + 1))
    by_title = F.concat(lead, named, at, F.lit("."))
    by_code = F.concat(lead, named, F.lit(" ("), base_code(code), F.lit(" "), version, F.lit(")"), at, F.lit("."))
    chunk = F.array(F.struct(code.alias("code"), title.alias("title")))
    return F.when(cites_source(by_title, chunk), by_title).otherwise(by_code)


def normal_question(c: Column) -> Column:
    return F.trim(F.regexp_replace(fold(c), "[^a-z0-9 ]", ""))


def held_out(questions: DataFrame, bank: DataFrame) -> DataFrame:
    """questions (question) that the bank (question) lacks, compared in normal form."""
    b = bank.select(normal_question(F.col("question")).alias("_n")).distinct()
    return questions.withColumn("_n", normal_question(F.col("question"))).join(b, "_n", "left_anti").drop("_n")


def citation_family(entries: DataFrame, clauses: DataFrame, bank: DataFrame, known: DataFrame) -> DataFrame:
    """Entries (id, codigo, seccion, question, respuesta) with grp, answer and the first reason to discard them, null if none.

    clauses: code, section, version, title, content. The template rotates with the entries kept of each clause.
    """
    b = bank.select(normal_question(F.col("question")).alias("_n"), F.lit(True).alias("banked")).distinct()
    e = entries.withColumn("section", F.coalesce("seccion", F.lit("-"))).withColumnRenamed("codigo", "code").withColumn("_n", normal_question(F.col("question")))
    e = e.join(clauses.select("code", "section", "version", "title", "content"), ["code", "section"], "left").join(b, "_n", "left")
    early = F.when(F.col("content").isNull(), "clausula no hallada").when(F.col("banked"), "esta en el banco de pruebas")
    e = e.withColumn("early", early)
    k = F.row_number().over(Window.partitionBy("code", "section", F.col("early").isNull()).orderBy("id")) - 1
    e = e.withColumn("answer", attributed(F.col("respuesta"), F.col("code"), F.col("version"), F.col("title"), F.nullif("section", F.lit("-")), k))
    codes = e.filter("early IS NULL").select("id", F.explode(F.array_except(cited_codes(F.col("answer")), cited_codes(F.col("content")))).alias("code"))
    bad = codes.join(known.select("code").distinct(), "code", "left_anti").select("id").distinct().withColumn("bad", F.lit(True))
    e = e.join(bad, "id", "left")
    reason = F.coalesce("early", F.when(~cites_source(F.col("answer"), F.array(F.struct("code", "title"))), "la atribucion no la reconoce el guardrail").when(F.col("bad"), "cita codigo inexistente"))
    return e.select("id", F.lit("cita").alias("family"), F.concat("code", F.lit("§"), "section").alias("grp"), "question", "answer", reason.alias("discarded"))


def phantom_family(rejected: DataFrame, clauses: DataFrame, bank: DataFrame) -> DataFrame:
    """As citation_family, from rejected entries (id, code, section, phantoms, question, answer): the phantom codes are taken out of the answer."""
    b = bank.select(normal_question(F.col("question")).alias("_n"), F.lit(True).alias("banked")).distinct()
    r = rejected.withColumn("_n", normal_question(F.col("question"))).join(b, "_n", "left").join(clauses.select("code", "section", "version", "title"), ["code", "section"], "left")
    names = F.transform(F.split("phantoms", ","), lambda p: F.upper(F.trim(p)))
    clean = F.aggregate(names, F.col("answer"), lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"\s*"), p, F.lit(r"\b")), F.lit("")))
    clean = F.trim(F.regexp_replace(clean, r"\s+([,.])", "$1"))
    r = r.withColumn("answer", attributed(clean, F.col("code"), F.col("version"), F.col("title"), F.nullif("section", F.lit("-")), F.lit(0)))
    left = F.size(F.array_intersect(names, cited_codes(F.col("answer")))) > 0
    reason = F.when(F.col("banked"), "esta en el banco de pruebas").when(F.col("version").isNull(), "clausula no hallada").when(left, "no se pudo retirar el codigo fantasma")
    return r.select("id", F.lit("fantasma").alias("family"), F.concat("code", F.lit("§"), "section").alias("grp"), "question", "answer", reason.alias("discarded"))


def prompted_family(catalogue: DataFrame, templates: list[str], family: str, tool: str, per: int, seed: int = 7) -> DataFrame:
    """Examples that call a tool: `per` templates, by seeded hash, filled with every title of (code, title)."""
    t = F.explode(F.array(*(F.struct(F.lit(i).alias("k"), F.lit(x).alias("template")) for i, x in enumerate(templates)))).alias("x")
    e = catalogue.select("code", "title", t).select("code", "title", "x.*")
    place = F.row_number().over(Window.partitionBy("code", "title").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "code", "title", "k")), "k"))
    e = e.withColumn("place", place).filter(F.col("place") <= per)
    return e.select(F.lit(family).alias("family"), F.concat(F.lit(f"{family}:"), "code").alias("grp"), F.replace("template", F.lit("{titulo}"), "title").alias("question"), F.lit(tool).alias("tool"))


def dealt(groups: DataFrame, by: list[str], size: str, seed: int) -> DataFrame:
    """Adds before to groups (by, grp, size): the sizes of the groups of `by` that come before it in seeded order, by MD5.

    The running sum goes in two levels, by the first three digits of the hash, so that no task sorts all groups.
    """
    g = groups.withColumn("h", F.md5(F.concat(F.lit(f"{seed}:"), "grp"))).withColumn("chunk", F.substring("h", 1, 3))
    earlier = F.sum("in_chunk").over(Window.partitionBy(*by).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    chunks = g.groupBy(*by, "chunk").agg(F.sum(size).alias("in_chunk")).withColumn("earlier", F.coalesce(earlier, F.lit(0))).drop("in_chunk")
    inside = F.sum(size).over(Window.partitionBy(*by, "chunk").orderBy("h", "grp").rowsBetween(Window.unboundedPreceding, -1))
    g = g.withColumn("inside", F.coalesce(inside, F.lit(0))).join(chunks, [*by, "chunk"])
    return g.withColumn("before", F.col("earlier") + F.col("inside")).drop("h", "chunk", "earlier", "inside")


def capped(examples: DataFrame, family: str, cap: int, seed: int = 7) -> DataFrame:
    """Examples (family, grp) with the family cut to whole groups, in seeded order, until the cap is reached; a cap of 0 cuts nothing."""
    if cap <= 0:
        return examples
    own = examples.filter(F.col("family") == family)
    n = own.groupBy("family", "grp").agg(F.count("*").alias("size"))
    kept = dealt(n, ["family"], "size", seed).filter(F.col("before") < cap).select("grp")
    return examples.filter(F.col("family") != family).unionByName(own.join(kept, "grp", "left_semi").select(*examples.columns))


def split(examples: DataFrame, valid: float, test: float, seed: int = 7) -> DataFrame:
    """Adds particion: groups are dealt family by family, and a group held out by any family is held out in all; valid goes first.

    A family of three groups or more gives max(1, round half even of its share).
    """
    g = examples.select("family", "grp").distinct().withColumn("one", F.lit(1))
    g = dealt(g, ["family"], "one", seed).join(g.groupBy("family").agg(F.count("*").alias("n")), "family")
    share = lambda s: F.when(F.col("n") >= 3, F.greatest(F.lit(1), F.bround(F.col("n") * s))).otherwise(0)
    kind = F.when(F.col("before") < share(valid), 1).when(F.col("before") < share(valid) + share(test), 2).otherwise(3)
    best = g.groupBy("grp").agg(F.min(kind).alias("kind"))
    return examples.join(best, "grp").withColumn("particion", F.element_at(F.array(*map(F.lit, ("valid", "test", "train"))), F.col("kind"))).drop("kind")


def report(examples: DataFrame) -> DataFrame:
    return examples.groupBy("particion", "family").agg(F.count("*").alias("examples"), F.count_distinct("grp").alias("groups"))


def profile(examples: DataFrame) -> DataFrame:
    """Per partition: examples by type, and length of the answers."""
    n = F.length("answer")
    g = examples.groupBy("particion").agg(F.count_if(F.col("is_call")).alias("tool_call"), F.count_if(~F.col("is_call")).alias("texto"), F.max(n).alias("max_chars"), F.count_if(n < 20).alias("below_20"), F.count_if(n.between(20, 24)).alias("from_20"), F.count_if(n > 24).alias("above_24"))
    return with_median(g, examples, "particion", n, "median_chars")


def prompt_lengths(examples: DataFrame) -> DataFrame:
    g = examples.groupBy("family").agg(F.avg(F.length("question")).alias("mean_chars"))
    return with_median(g, examples, "family", F.length("question"), "median_chars")


def gold_messages(examples: DataFrame, mode: Column) -> DataFrame:
    """(id, messages) of (id, question, code, version, section, content): with the clause at distance 0.30, without context, or from memory."""
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    block = F.concat(F.lit("Fragmentos VIGENTES recuperados:\n\n[Fragmento 1] Documento: "), "code", F.lit(" "), "version", F.coalesce(F.concat(F.lit(" | Seccion: "), "section"), F.lit("")), F.lit("\n"), "content")
    system = F.when(mode == "contexto", F.concat(F.lit("Eres el asistente.\n\n"), block)).when(mode == "sin_contexto", F.lit("Eres el asistente.\n\nNo se recupero ningun fragmento. No inventes.")).otherwise(F.lit("Eres el asistente."))
    return examples.select("id", F.array(m("system", system), m("user", F.col("question"))).alias("messages"))
