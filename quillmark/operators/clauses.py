"""From page text to clauses: repairs, boilerplate, tables, numbered clauses, and the clause tables of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import strings
from quillmark.operators.retrieval import FORMAL_TITLES

MIN_PAGES, PAGE_SHARE = 3, 0.6
MIN_CHARS, MAX_CHARS, ANNOUNCE_CHARS, FAQ_CHARS, HEADER_ROWS, INDEX_CHARS = 80, 3000, 250, 120, 6, 72
#: A numbered heading, a line of a table of contents, and more titles of formalities.
HEADING_LINE = r"[^\S\n]*(\d{1,2}(?:\.\d{1,2}){0,3})\.?[^\S\n]+[A-ZÁÉÍÓÚÑ][^\n]{0,120}[^\S\n]*"
CONTENTS_LINE = r"\.{4,}\s*\d*\s*$"
MORE_FORMAL_TITLES = (*FORMAL_TITLES, "anexos", "registros")
NUMBER = r"^\s*\d+(?:\.\d+)*\.?\s*"
HEADER_WORDS = ("CÓDIGO", "CODIGO", "VERSIÓN", "VERSION", "PÁGINA")
CONNECTORS = ("DE", "DEL", "LA", "EL", "LOS", "LAS", "Y", "E", "EN", "PARA", "POR", "A")


def repair_linebreaks(c: Column) -> Column:
    """Codes and words that a page's line ends have split."""
    c = F.regexp_replace(c, r"\b([A-Z]{2,5}-[A-Z]{2,5}-)[\s\x{A0}]+(\d{1,3})\b", "$1$2")
    c = F.regexp_replace(c, r"(?U)(\w)-[ \t]*\n[ \t]*([a-záéíóúñü])", "$1$2")
    return F.regexp_replace(c, r"(?U)(\w-)[ \t]*\n[ \t]*([A-Z0-9])", "$1$2")


def strip_boilerplate(pages: DataFrame) -> DataFrame:
    """(doc_id, text): the pages (doc_id, page_no, text) joined, without lines that most pages repeat.

    Documents of fewer than MIN_PAGES pages stay as they are; the others lose blank lines as well.
    """
    lines = pages.select("doc_id", "page_no", F.posexplode(F.split("text", r"\r\n|\n|\r")).alias("at", "line"))
    n = pages.groupBy("doc_id").agg(F.count_distinct("page_no").alias("n_pages"))
    lines = lines.join(n, "doc_id").withColumn("key", F.trim("line"))
    often = lines.filter("n_pages >= 3 AND key <> ''").groupBy("doc_id", "key", "n_pages").agg(F.count_distinct("page_no").alias("on_pages"))
    often = often.filter(F.col("on_pages") >= F.greatest(F.lit(2), F.floor(F.col("n_pages") * PAGE_SHARE))).select("doc_id", "key")
    kept = lines.join(often, ["doc_id", "key"], "left_anti").filter("n_pages < 3 OR key <> ''")
    text = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "at", "line"))).alias("x"))
    return n.join(text, "doc_id", "left").select("doc_id", F.coalesce(F.array_join(F.transform("x", lambda x: x["line"]), "\n"), F.lit("")).alias("text"))


def is_contents(c: Column) -> Column:
    """Whether a text is a table of contents: one dotted line, or dotted lines in half of several."""
    lines = F.filter(F.split(F.coalesce(c, F.lit("")), "\n"), lambda x: F.trim(x) != "")
    dotted = F.size(F.filter(lines, lambda x: x.rlike(CONTENTS_LINE)))
    return F.when(F.size(lines) == 0, F.lit(False)).when(F.size(lines) == 1, dotted == 1).otherwise((dotted >= 2) & (dotted * 2 >= F.size(lines)))


def announces_only(c: Column) -> Column:
    t = F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    return t.endswith(":") & (F.length(t) < ANNOUNCE_CHARS)


def render_table(rows: Column) -> Column:
    """An array of rows of cells as lines "a | b"; empty cells and rows go."""
    cells = lambda r: F.filter(F.transform(r, lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))), lambda c: c != "")
    return F.array_join(F.filter(F.transform(rows, lambda r: F.array_join(cells(r), " | ")), lambda r: r != ""), "\n")


def is_header_table(rows: Column) -> Column:
    """Whether a table of at most HEADER_ROWS rows names two of the header's fields in its first two rows."""
    flat = F.upper(F.array_join(F.flatten(F.slice(rows, 1, 2)), " ", ""))
    n = sum((flat.contains(w).cast("int") for w in HEADER_WORDS), F.lit(0))
    return (F.size(rows) <= HEADER_ROWS) & (n >= 2)


def split_clauses(texts: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, clause_no, section, content): numbered clauses of (doc_id, text), or paragraphs where none is found.

    A text is cut in its row before every line that is a heading; what stands before the first one is clause 0.
    """
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    pieces = F.split("text", rf"(?md)(?=^{HEADING_LINE}$)")
    headed = F.get(pieces, F.lit(0)).rlike(rf"(?d)^{HEADING_LINE}(?:\n|\z)").cast("int")
    clause = lambda p, i: F.struct((i + headed).cast("long").alias("clause_no"), F.nullif(F.regexp_extract(p, rf"(?d)^{HEADING_LINE}(?:\n|\z)", 1), F.lit("")).alias("section"), trimmed(p).alias("content"))
    paragraph = lambda p, i: F.struct(i.cast("long").alias("clause_no"), F.lit(None).cast("string").alias("section"), trimmed(p).alias("content"))
    long = lambda x: F.length(x["content"]) >= min_chars
    good = texts.select("doc_id", "text", F.filter(F.transform(pieces, clause), lambda x: long(x) & ~is_contents(x["content"])).alias("good"))
    rest = F.filter(F.transform(F.split("text", "\n\n"), paragraph), long)
    return good.select("doc_id", F.explode(F.when(F.size("good") > 0, F.col("good")).otherwise(rest)).alias("x")).select("doc_id", "x.*")


def split_oversized(clauses: DataFrame, limit: int = MAX_CHARS) -> DataFrame:
    """Adds piece_no; clauses beyond the limit are packed paragraph by paragraph, a long paragraph stays whole."""
    state = "struct<done:array<string>,open:array<string>,size:int>"
    start = F.struct(F.array().cast("array<string>").alias("done"), F.array().cast("array<string>").alias("open"), F.lit(0).alias("size")).cast(state)
    joined = lambda a: F.regexp_replace(F.array_join(a, "\n\n"), r"^\s+|\s+$", "")

    def step(a: Column, p: Column) -> Column:
        full = (a["size"] + F.length(p) > limit) & (F.size(a["open"]) > 0)
        return F.struct(
            F.when(full, F.concat(a["done"], F.array(joined(a["open"])))).otherwise(a["done"]).alias("done"),
            F.when(full, F.array(p)).otherwise(F.concat(a["open"], F.array(p))).alias("open"),
            F.when(full, F.length(p)).otherwise(a["size"] + F.length(p)).alias("size"),
        ).cast(state)

    packed = F.aggregate(F.split("content", "\n\n"), start, step, lambda a: F.concat(a["done"], F.array(joined(a["open"]))))
    pieces = F.when(F.length("content") <= limit, F.array("content")).otherwise(packed)
    return clauses.select("doc_id", "clause_no", "section", F.posexplode(pieces).alias("piece_no", "content"))


def clauses_of(pages: DataFrame) -> DataFrame:
    """Clause table of paged documents: boilerplate, repairs, clauses, pieces."""
    t = strip_boilerplate(pages)
    return split_oversized(split_clauses(t.withColumn("text", repair_linebreaks(F.col("text")))))


def ingest(documents: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(clauses, report): the clauses that replace those of the documents, and per document their number, whether it has none, and blind clauses."""
    c = clauses_of(pages)
    per = c.groupBy("doc_id").agg(F.count("*").alias("clauses"), F.count_if(announces_only(F.col("content"))).alias("blind"))
    report = documents.select(F.col("id").alias("doc_id"), "code", "version").join(per, "doc_id", "left")
    return c, report.select("doc_id", "code", "version", F.coalesce("clauses", F.lit(0)).alias("clauses"), F.coalesce("blind", F.lit(0)).alias("blind"), F.col("clauses").isNull().alias("skipped"))


def reindex(clauses: DataFrame, pages: DataFrame, changed: DataFrame) -> DataFrame:
    """The clause table with the documents of `changed` (doc_id) cut anew; others keep theirs."""
    return clauses.join(changed, "doc_id", "left_anti").unionByName(clauses_of(pages.join(changed, "doc_id", "left_semi")))


def starts_formal(c: Column, titles: tuple[str, ...]) -> Column:
    head = F.lower(F.regexp_replace(F.substring(F.coalesce(c, F.lit("")), 1, 90), NUMBER, ""))
    return F.exists(strings(titles), lambda t: head.startswith(t))


def worth_questions(c: Column) -> Column:
    """Whether a clause has enough to ask about."""
    return (F.length(c) >= FAQ_CHARS) & ~starts_formal(c, MORE_FORMAL_TITLES) & ~announces_only(c)


def index_title(c: Column) -> Column:
    """(title, has_title) of a clause: its leading run of words in capitals, or its first words.

    The run ends at a word that isn't all capitals, a number, a code, or one with "|" or ":".
    """
    text = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "), NUMBER, ""))
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    state = "struct<title:string,open:boolean>"

    def step(a: Column, w: Column) -> Column:
        bare = F.regexp_replace(w, r"^[.,;:]+|[.,;:]+$", "")
        stop = (bare == "") | bare.rlike(r"^[A-Z]{2,5}-[A-Z]{2,5}-\d{1,3}$") | w.contains("|") | w.contains(":") | (F.upper(bare) != bare) | bare.rlike(r"^\d+$")
        more = F.when(a["title"] == "", bare).otherwise(F.concat(a["title"], F.lit(" "), bare))
        taken = a["open"] & ~stop
        return F.struct(F.when(taken, more).otherwise(a["title"]).alias("title"), (taken & (F.length(more) <= INDEX_CHARS)).alias("open")).cast(state)

    run = F.aggregate(words, F.struct(F.lit("").alias("title"), F.lit(True).alias("open")).cast(state), step, lambda a: a["title"])
    cut = F.concat(F.regexp_replace(F.substring(text, 1, INDEX_CHARS), r" [^ ]*$", ""), F.lit("..."))
    titled = (F.length(run) >= 4) & ~run.isin(*CONNECTORS)
    named = F.concat(F.substring(run, 1, 1), F.lower(F.substring(run, 2, 10_000)))
    title = F.when(text == "", "(sin titulo)").when(titled, named).when(F.length(text) <= INDEX_CHARS, text).otherwise(cut)
    return F.struct(title.alias("title"), (titled & (text != "")).alias("has_title"))
