"""The catalogue of documents in force: search by terms, reading of documents, follow-up suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import CODE_CITED, base_code, fold, strings
from quillmark.operators.clauses import index_title, starts_formal
from quillmark.operators.grams import containing
from quillmark.operators.retrieval import FORMAL_TITLES, label

MAX_FOUND, MAX_OPTIONS, READ_CHARS, BEST_CLAUSES, BEST_CHARS, MAX_SUGGESTIONS, LABEL_CHARS, MAX_CITABLE = 25, 10, 24_000, 4, 9_000, 7, 38, 400
#: Words for types of documents, topics with area prefix and words of titles, and words without weight.
KINDS = {
    "politica": "-PO-", "politicas": "-PO-", "procedimiento": "-PR-", "procedimientos": "-PR-", "manual": "-MN-", "manuales": "-MN-", "formato": "-FO-", "formatos": "-FO-", "instructivo": "-IN-",
    "instructivos": "-IN-", "plan": "-PL-", "planes": "-PL-", "organigrama": "-OR-", "organigramas": "-OR-", "alcance": "-AL-", "objetivo": "-OB-", "objetivos": "-OB-",
}
TOPICS = {
    "ti": ("STI", ("tecnologia",)), "sistemas": ("STI", ("tecnologia", "sistemas")), "informatica": ("STI", ("tecnologia",)), "tecnologia": ("STI", ("tecnologia",)),
    "calidad": ("CAL", ("calidad",)), "compras": ("COM", ("compra", "proveedor")), "proveedores": ("COM", ("proveedor",)), "rrhh": ("GTH", ("humana", "personal")),
    "personal": ("GTH", ("humana", "personal")), "inventario": ("INV", ("inventario",)), "inventarios": ("INV", ("inventario",)),
    "comercial": ("CMC", ("comercial", "cliente")), "cliente": ("CMC", ("cliente",)), "conciliacion": ("CNC", ("conciliacion",)),
    "facturacion": ("FAC", ("facturacion",)), "costos": ("CYP", ("costo", "presupuesto")), "logistica": ("SPL", ("logistic", "carga", "almacen")),
    "gerencial": ("GGR", ("gerencial", "riesgo")), "riesgos": (None, ("riesgo",)), "auditoria": (None, ("auditoria",)), "auditorias": (None, ("auditoria",)),
    "riesgo": (None, ("riesgo",)), "capacitacion": (None, ("capacitacion",)), "seguridad": (None, ("seguridad",)), "epp": (None, ("epp", "proteccion personal")),
    "sst": (None, ("seguridad", "salud")), "proteccion": (None, ("proteccion",)), "hallazgo": (None, ("no conforme", "correctiva")), "reclamo": (None, ("reclamo",)),
    "reclamos": (None, ("reclamo",)),
}
WEIGHTLESS = ("de", "del", "la", "el", "los", "las", "sobre", "para", "que", "hay", "tienes")


def terms(c: Column) -> Column:
    """(kinds, topics, free) of a query: segments of codes, topic words, and other words of more than two characters.

    Words are not folded here: one with an accent is a free word.
    """
    words = F.filter(F.split(F.lower(c), r"(?U)[^\w]+"), lambda w: (w != "") & ~w.isin(*WEIGHTLESS))
    kind = F.create_map(*(F.lit(x) for kv in KINDS.items() for x in kv))
    topics = F.filter(words, lambda w: w.isin(*TOPICS) & ~w.isin(*KINDS))
    free = F.filter(words, lambda w: ~w.isin(*KINDS, *TOPICS) & (F.length(w) > 2))
    return F.struct(F.transform(F.filter(words, lambda w: w.isin(*KINDS)), lambda w: kind[w]).alias("kinds"), topics.alias("topics"), free.alias("free"))


def search(queries: DataFrame, documents: DataFrame, most: int = MAX_FOUND) -> DataFrame:
    """(query_id, place, code, version, total) for (query_id, tenant_id, topic): documents in force by code, at most `most` of each query.

    Kinds and topics must both hold, one of each; free words count only where there is neither, and without any word all
    documents are found. Equal topics of a tenant are searched once: the index of character runs gives the documents that hold
    one of the words that would do, and these are tested. What is found without any word is the same for a tenant's topics.
    """
    prefix = F.create_map(*(F.lit(x) for k, (p, _) in TOPICS.items() if p for x in (k, p)))
    words = F.create_map(*(x for k, (_, w) in TOPICS.items() for x in (F.lit(k), strings(w))))
    d = documents.filter("status = 'vigente'").select("tenant_id", "id", "code", "version", fold(F.col("title")).alias("t"), fold(F.col("area")).alias("a"))
    asked = queries.filter("trim(topic) <> ''").select("query_id", "tenant_id", "topic")
    q = asked.select("tenant_id", "topic").distinct().withColumn("x", terms(F.col("topic"))).select("tenant_id", "topic", "x.*")
    of_kind = F.exists("kinds", lambda k: F.col("code").contains(k))
    has = lambda c, w: F.col(c).contains(w)
    of_topic = F.exists("topics", lambda k: F.coalesce(F.col("code").startswith(F.concat(prefix[k], F.lit("-"))), F.lit(False)) | F.exists(words[k], lambda w: has("t", w) | prefix[k].isNotNull() & has("a", w)))
    of_free = F.exists("free", lambda w: has("t", fold(w)) | has("a", fold(w)) | F.lower("code").contains(w))
    test = F.when((F.size("kinds") > 0) | (F.size("topics") > 0), ((F.size("kinds") == 0) | of_kind) & ((F.size("topics") == 0) | of_topic)).otherwise(of_free)

    # words of which a document must hold one, in whichever field; the test tells the fields
    of_words = F.concat(F.flatten(F.transform("topics", lambda k: words[k])), F.filter(F.transform("topics", lambda k: F.lower(F.concat(prefix[k], F.lit("-")))), lambda w: w.isNotNull()))
    needed = F.when(F.size("topics") > 0, of_words).when(F.size("kinds") > 0, F.transform("kinds", F.lower)).otherwise(F.concat("free", F.transform("free", fold)))
    wanted = q.select("tenant_id", "topic", F.explode(F.array_distinct(needed)).alias("word"))
    hits = containing(wanted, d.select("tenant_id", "id", F.concat_ws("\n", F.lower("code"), "t", "a").alias("text")))
    listed = wanted.join(hits, ["tenant_id", "word"]).select("tenant_id", "topic", "id").distinct()
    found = listed.join(q, ["tenant_id", "topic"]).join(d, ["tenant_id", "id"]).filter(test)
    first, total = _first(found, ["tenant_id", "topic"], most)
    all_first, all_total = _first(d, ["tenant_id"], most)
    open_ = q.filter((F.size("kinds") == 0) & (F.size("topics") == 0) & (F.size("free") == 0))
    whole = open_.join(all_first.join(all_total, "tenant_id"), "tenant_id")
    names = ["tenant_id", "topic", "place", "code", "version", "total", "t", "a", "free"]
    answers = first.join(total, ["tenant_id", "topic"]).select(*names).unionByName(whole.select(*names))
    return asked.join(answers, ["tenant_id", "topic"]).select("query_id", "place", "code", "version", "total", "t", "a", "free")


def _first(found: DataFrame, by: list[str], most: int) -> tuple[DataFrame, DataFrame]:
    """The first of a group by code, version and id, and how many it has."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy("code", "version", "id"))
    return found.withColumn("place", place).filter(F.col("place") <= most), found.groupBy(*by).agg(F.count("*").alias("total"))  # limited before the shuffle


def unmatched(found: DataFrame) -> DataFrame:
    """(query_id, term): free words that no document found for their query has in code, title or area."""
    f = found.select("query_id", F.explode("free").alias("term"), F.lower(F.concat_ws(" ", "code", "t", "a")).alias("text"))
    g = f.groupBy("query_id", "term").agg(F.max(F.col("text").contains(fold(F.col("term")))).alias("hit"))
    return g.filter("NOT hit").select("query_id", "term")


def resolve(references: DataFrame, documents: DataFrame) -> DataFrame:
    """(ref_id, outcome, document_id, options) of (ref_id, tenant_id, reference): by the beginning of the code, else by the title.

    Equal references of a tenant are resolved once, both times through the index of character runs; a code is marked at its
    beginning, so that what begins it is contained with the mark.
    """
    mark = F.lit("\x02")
    d = documents.filter("status = 'vigente'").select("tenant_id", "id", "code", "title")
    r = references.select("ref_id", "tenant_id", F.trim("reference").alias("reference")).filter("reference <> ''")
    asked = r.select("tenant_id", "reference").distinct().withColumn("begins", F.concat(mark, F.lower("reference"))).withColumn("within", fold(F.col("reference")))

    def found(rest: DataFrame, word: str, text: Column) -> DataFrame:
        hits = containing(rest.select("tenant_id", F.col(word).alias("word")), d.select("tenant_id", "id", text.alias("text")))
        return rest.join(hits.withColumnRenamed("word", word), ["tenant_id", word]).join(d.select("tenant_id", "id", "code"), ["tenant_id", "id"]).select("tenant_id", "reference", "id", "code")

    by_code = found(asked, "begins", F.concat(mark, F.lower("code")))
    rest = asked.join(by_code.select("tenant_id", "reference").distinct(), ["tenant_id", "reference"], "left_anti")
    both = by_code.unionByName(found(rest, "within", fold(F.col("title"))))
    counts = both.groupBy("tenant_id", "reference").agg(F.count("*").alias("n"), F.min("id").alias("document_id"))
    place = F.row_number().over(Window.partitionBy("tenant_id", "reference").orderBy("code", "id"))
    few = both.withColumn("place", place).filter(F.col("place") <= MAX_OPTIONS)  # limited before the shuffle
    options = few.groupBy("tenant_id", "reference").agg(F.array_sort(F.collect_list("code")).alias("options"))
    out = r.join(counts.join(options, ["tenant_id", "reference"]), ["tenant_id", "reference"], "left")
    return out.select("ref_id", F.when(F.col("n").isNull(), "not_found").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("outcome"), F.when(F.col("n") == 1, F.col("document_id")).alias("document_id"), F.when(F.col("n") > 1, F.array_join("options", ",")).alias("options"))


def clause_index(chunks: DataFrame) -> DataFrame:
    """(document_id, chunk_id, section, title, has_title) of clauses with a section."""
    return chunks.filter("section IS NOT NULL").select("document_id", F.col("id").alias("chunk_id"), "section", index_title(F.col("content")).alias("x")).select("document_id", "chunk_id", "section", "x.title", "x.has_title")


def read_sections(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(ask_id, chunk_id, section) of (ask_id, document_id, section): the clause and its subclauses."""
    a = asked.select("ask_id", "document_id", F.regexp_replace(F.trim("section"), r"\.+$", "").alias("wanted"))
    c = chunks.select("document_id", F.col("id").alias("chunk_id"), "section")
    return a.join(c, "document_id").filter((F.col("section") == F.col("wanted")) | F.col("section").startswith(F.concat("wanted", F.lit(".")))).select("ask_id", "chunk_id", "section")


def read_whole(chunks: DataFrame, budget: int = READ_CHARS) -> DataFrame:
    """(document_id, included, total, truncated): the clauses of a document, in order, that fit the budget."""
    w = Window.partitionBy("document_id").orderBy("id")
    c = chunks.withColumn("upto", F.sum(F.length("content")).over(w))
    g = c.groupBy("document_id").agg(F.count_if(F.col("upto") <= budget).alias("included"), F.count("*").alias("total"))
    return g.withColumn("truncated", F.col("included") < F.col("total"))


def most_substantial(chunks: DataFrame, most: int = BEST_CLAUSES, budget: int = BEST_CHARS) -> DataFrame:
    """(document_id, chunk_id, section, place): the longest clauses with a section that are no formality, within the budget, in document order."""
    c = chunks.filter("section IS NOT NULL").filter(~starts_formal(F.col("content"), FORMAL_TITLES)).select("document_id", F.col("id").alias("chunk_id"), "section", F.length("content").alias("n"))
    w = Window.partitionBy("document_id").orderBy(F.desc("n"), "chunk_id")
    c = c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most).withColumn("upto", F.sum("n").over(w)).filter(F.col("upto") <= budget)
    return c.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("chunk_id"))).select("document_id", "chunk_id", "section", "place")


def suggestions(index: DataFrame, documents: DataFrame, most: int = MAX_SUGGESTIONS) -> DataFrame:
    """(document_id, place, label, message): clauses to go on with, titled ones if any, operative before formal, then the whole document."""
    w = Window.partitionBy("document_id")
    i = index.withColumn("any", F.max("has_title").over(w)).filter("has_title OR NOT any")
    formal = F.exists(strings(FORMAL_TITLES), lambda t: F.lower(F.trim("title")).startswith(t))
    i = i.withColumn("place", F.row_number().over(w.orderBy(formal.cast("int"), "chunk_id"))).filter(F.col("place") <= most).join(documents.select(F.col("id").alias("document_id"), "code"), "document_id")
    short = F.when(F.length("title") <= LABEL_CHARS, F.col("title")).otherwise(F.concat(F.regexp_replace(F.substring("title", 1, LABEL_CHARS), r" [^ ]*$", ""), F.lit("...")))
    one = i.select("document_id", "place", short.alias("label"), F.concat(F.lit("Del documento "), "code", F.lit(", explicame la seccion "), "section").alias("message"))
    whole = i.groupBy("document_id", "code").agg((F.max("place") + 1).alias("place")).select("document_id", "place", F.lit("Ver el documento completo").alias("label"), F.concat(F.lit("Dame el resumen completo del documento "), "code").alias("message"))
    return one.unionByName(whole)


def suggestions_for(answers: DataFrame, dominant: DataFrame, offered: DataFrame) -> DataFrame:
    """(id, place, label) for answers (id, tenant_id, read_document_id): of the document read, else of the dominant one (id, document_id)."""
    a = answers.join(dominant, "id", "left").select("id", F.coalesce("read_document_id", "document_id").alias("document_id"))
    return a.join(offered, "document_id").select("id", "place", "label")


def capabilities(documents: DataFrame) -> DataFrame:
    g = documents.filter("status = 'vigente'").groupBy("tenant_id").agg(F.count("*").alias("in_force"), F.sort_array(F.collect_set("area")).alias("areas"))
    return g


def citable(chunks: DataFrame, documents: DataFrame, most: int = MAX_CITABLE) -> DataFrame:
    """(tenant_id, place, reference): clauses in force that can be cited, by code and section, at most `most` of each tenant."""
    d = documents.filter("status = 'vigente'").select(F.col("id").alias("document_id"), F.col("tenant_id").alias("tenant"), "code", "version")
    c = chunks.filter("section IS NOT NULL").join(d, "document_id").select(F.col("tenant").alias("tenant_id"), "code", "section", label(F.col("code"), F.col("version"), F.col("section")).alias("reference"), "id")
    w = Window.partitionBy("tenant_id").orderBy("code", "section", "id")
    return c.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most).select("tenant_id", "place", "reference")


def clause_exists(references: DataFrame, documents: DataFrame) -> DataFrame:
    """(ref_id) of (ref_id, tenant_id, reference) that cite a code in force."""
    c = references.select("ref_id", "tenant_id", F.explode(F.array_distinct(F.regexp_extract_all("reference", F.lit(CODE_CITED), F.lit(0)))).alias("code"))
    d = documents.filter("status = 'vigente'").select("tenant_id", base_code(F.col("code")).alias("code"))
    return c.join(d, ["tenant_id", "code"], "left_semi").select("ref_id").distinct()
