"""Vector retrieval joined to the documents in force, with both distance cuts, and what is built from its result.

Chunks, documents and queries are DataFrames; a query sees the chunks of its tenant. Candidates are exact: the index of pivots
spares a query the blocks of clauses that can't hold one of its nearest. Only ids and vectors take part in that; texts are
joined to what is found. For approximate search over large sets see the graphs of the training-data operators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import base_code, fold
from quillmark.operators.pivots import nearest

MAX_DISTANCE, MARGIN, PENALTY, TOP = 0.527, 0.08, 0.06, 4
FAQ_TOP, FAQ_MAX, SUPPORT_MAX = 3, 0.35, 0.37
#: Titles of clauses that are formalities.
FORMAL_TITLES = ("objetivo", "alcance", "documentos de referencia", "abreviaturas", "responsabilidad", "control de cambios")
CITED = ["chunk_id", "code", "version", "section", "title", "distance"]


def is_formal(content: Column) -> Column:
    """Whether a clause is a formality, by its heading."""
    head = F.lower(F.regexp_replace(F.substring(F.coalesce(content, F.lit("")), 1, 90), r"^\s*\d+(?:\.\d+)*\.?\s*", ""))
    out = F.lit(False)
    for t in FORMAL_TITLES:
        out = out | head.startswith(t)
    return out


def candidates(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """The k nearest chunks of documents in force, for each query (query_id, tenant_id, embedding); rank from 1, ties to the smaller chunk."""
    d = documents.filter(F.col("status") == "vigente").select(F.col("id").alias("document_id"), "tenant_id", "code", "version", "title", "effective_date")
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "section", "content", "embedding").join(d, "document_id")
    near = nearest(queries, c.select("chunk_id", "tenant_id", "embedding"), "chunk_id", k)
    return near.join(c.drop("embedding"), "chunk_id")


def retrieve(queries: DataFrame, chunks: DataFrame, documents: DataFrame, k: int = TOP, max_distance: float = MAX_DISTANCE, margin: float = MARGIN) -> DataFrame:
    """The k best of 3k candidates after the penalty for formal clauses, with verdict accepted, beyond_threshold or beyond_margin."""
    c = candidates(queries, chunks, documents, 3 * k)
    c = c.withColumn("distance", F.round(F.col("distance") + F.when(is_formal(F.col("content")), PENALTY).otherwise(0.0), 6))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "chunk_id"))
    c = c.withColumn("rank", rank).filter(F.col("rank") <= k)
    best = F.min(F.when(F.col("distance") <= max_distance, F.col("distance"))).over(Window.partitionBy("query_id"))
    verdict = F.when(F.col("distance") > max_distance, "beyond_threshold").when(F.lit(margin > 0) & (F.col("distance") > best + margin), "beyond_margin").otherwise("accepted")
    return c.withColumn("verdict", verdict)


def retrieve_faqs(queries: DataFrame, faqs: DataFrame, documents: DataFrame, chunks: DataFrame, k: int = FAQ_TOP, max_distance: float = FAQ_MAX) -> DataFrame:
    """The k nearest questions of documents in force, then the distance cut; the source clause is optional."""
    d = documents.filter(F.col("status") == "vigente").select(F.col("id").alias("document_id"), "tenant_id", "code", "version")
    f = faqs.select(F.col("id").alias("faq_id"), "document_id", "chunk_id", "question", "answer", "reviewed", "embedding").join(d, "document_id")
    source = chunks.select(F.col("id").alias("chunk_id"), "section", F.col("content").alias("source_content"))
    near = nearest(queries, f.select("faq_id", "tenant_id", "embedding"), "faq_id", k).filter(F.col("distance") <= max_distance)
    return near.join(f.drop("embedding"), "faq_id").join(source, "chunk_id", "left")


def direct_sections(turns: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Clauses that a message names itself: "del documento X ... seccion N" gives N and its subclauses, at distance 0."""
    pattern = r"(?is)del documento\s+([A-Z]{2,5}-[A-Z]{2,5}-\d{1,3}).{0,40}?secci[oó]n\s+(\d+(?:\.\d+)*)"
    t = turns.select(F.col("id").alias("turn_id"), "tenant_id", F.upper(F.regexp_extract("content", pattern, 1)).alias("base"), F.regexp_extract("content", pattern, 2).alias("asked"))
    d = documents.filter(F.col("status") == "vigente").select(F.col("id").alias("document_id"), "tenant_id", "code", "version", base_code(F.col("code")).alias("base"))
    c = chunks.select(F.col("id").alias("chunk_id"), "document_id", "section").join(d, "document_id")
    under = (F.col("section") == F.col("asked")) | F.col("section").startswith(F.concat("asked", F.lit(".")))
    return t.filter("base <> ''").join(c, ["tenant_id", "base"]).filter(under).select("turn_id", "chunk_id", "code", "version", "section", F.lit(0.0).alias("distance"))


def label(code: Column, version: Column, section: Column) -> Column:
    return F.concat(code, F.lit(" "), version, F.coalesce(F.concat(F.lit(", seccion "), section), F.lit("")))


def context_blocks(found: DataFrame, by: str = "query_id") -> DataFrame:
    """One numbered, labelled block of text for each query, of its accepted clauses in order of rank."""
    items = F.transform(F.array_sort(F.collect_list(F.struct("rank", "code", "version", "title", "section", "content"))), lambda x: x)
    heading = lambda x, i: F.concat(F.lit("[Fragmento "), i + 1, F.lit("] Documento: "), x["code"], F.lit(" "), x["version"], F.coalesce(F.concat(F.lit(' | Titulo: "'), x["title"], F.lit('"')), F.lit("")), F.coalesce(F.concat(F.lit(" | Seccion: "), x["section"]), F.lit("")), F.lit("\n"), x["content"])
    return found.groupBy(by).agg(items.alias("items")).select(by, F.array_join(F.transform("items", heading), "\n\n---\n\n").alias("block"))


def faq_blocks(found: DataFrame, by: str = "query_id") -> DataFrame:
    """One block of the questions found for each query, with whether they were reviewed and the text of the source clause."""

    def one(x: Column, i: Column) -> Column:
        seal = F.when(x["reviewed"], "revisada por Calidad").otherwise("generada, sin revisar")
        source = F.coalesce(F.concat(F.lit("\nTexto de la clausula:\n"), x["source_content"]), F.lit(""))
        return F.concat(F.lit("[FAQ "), i + 1, F.lit("] ("), seal, F.lit(") "), label(x["code"], x["version"], x["section"]), F.lit("\nP: "), x["question"], F.lit("\nR: "), x["answer"], source)

    items = F.array_sort(F.collect_list(F.struct("rank", "code", "version", "section", "question", "answer", "reviewed", "source_content")))
    return found.groupBy(by).agg(items.alias("items")).select(by, F.array_join(F.transform("items", one), "\n\n---\n\n").alias("block"))


def traces(found: DataFrame, max_distance: float = MAX_DISTANCE, by: str = "query_id") -> DataFrame:
    """The JSON trace of each query: what was accepted and rejected, distances to four places."""
    item = F.struct("rank", "chunk_id", "code", "version", "section", "title", F.round("distance", 4).alias("distance"))
    side = lambda accepted: F.transform(F.array_sort(F.filter("items", lambda x: (x["verdict"] == "accepted") == accepted)), lambda x: x["item"].dropFields("rank"))
    g = found.groupBy(by).agg(F.collect_list(F.struct(item.alias("item"), "verdict")).alias("items"))
    return g.select(by, F.to_json(F.struct(F.lit(max_distance).alias("max_distance"), side(True).alias("accepted"), side(False).alias("rejected"))).alias("trace"))


def dominant(found: DataFrame, by: str = "query_id") -> DataFrame:
    """The document that half or more of a query's accepted clauses come from; ties to the nearest."""
    n = found.groupBy(by, base_code(F.col("code")).alias("code")).agg(F.count("*").alias("n"), F.min("distance").alias("best"))
    at = Window.partitionBy(by)
    ranked = n.withColumn("total", F.sum("n").over(at)).withColumn("place", F.row_number().over(at.orderBy(F.desc("n"), "best", "code")))
    return ranked.filter("place = 1 AND n * 2 >= total").select(by, "code", "n", "total")


def calibration(queries: DataFrame, chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for queries flagged inside or not: worst inside, best outside, whether they separate, recommended threshold."""
    best = candidates(queries, chunks, documents, 1).select("query_id", "distance").join(queries.select("query_id", "inside"), "query_id")
    g = best.agg(F.max(F.when(F.col("inside"), F.col("distance"))).alias("worst_inside"), F.min(F.when(~F.col("inside"), F.col("distance"))).alias("best_outside"))
    apart = F.col("worst_inside") < F.col("best_outside")
    advised = F.when(F.col("best_outside").isNull(), F.round(F.col("worst_inside") + 0.05, 3)).when(apart, F.round((F.col("worst_inside") + F.col("best_outside")) / 2, 3)).otherwise(F.round(F.col("worst_inside") + 0.02, 3))
    return g.withColumns({"separable": F.coalesce(apart, F.lit(False)), "recommended": advised})


def title_words(title: Column, stops: tuple[str, ...]) -> Column:
    """A title's distinctive words: folded, longer than three characters, no common word."""
    return F.array_distinct(F.filter(F.regexp_extract_all(fold(title), F.lit(r"[a-z0-9_]+"), F.lit(0)), lambda w: (F.length(w) > 3) & ~w.isin(*stops)))
