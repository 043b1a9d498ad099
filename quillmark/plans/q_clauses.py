"""Queries T: from pages to clauses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions import text as x
from quillmark.operators import clauses as t
from quillmark.operators.retrieval import is_formal
from quillmark.plans.views import frame, sql, with_views

HEADING = r"^\s*(\d{1,2}(?:\.\d{1,2}){0,3})\.?\s+([A-ZÁÉÍÓÚÑ][^\n]{0,120})\s*$"
#: Clause-like texts with headings in capitals, colons and dots.
HEADED = """SELECT id, concat(section, '.1 ', CASE id % 7 WHEN 0 THEN 'OBJETIVO' WHEN 1 THEN 'CONDICIONES GENERALES' WHEN 2 THEN 'DOCUMENTOS DE REFERENCIA GTH-PR-01' WHEN 3 THEN 'El alcance es:' WHEN 4 THEN 'TITULO ........ 4' WHEN 5 THEN 'A' ELSE 'REGISTRO DEL HALLAZGO' END,
    CASE WHEN id % 7 IN (3, 4) THEN '' WHEN id % 7 = 5 THEN concat(' | tabla ', substr(content, 14)) ELSE concat(' ', lower(substr(content, 14))) END) AS content FROM {v_chunks}"""
CELLS = """SELECT id, array(array(code, title, CASE WHEN id % 3 = 0 THEN 'CODIGO' END), array('', ' ', NULL), array(concat(area, chr(10), 'b'), version, CASE WHEN id % 2 = 0 THEN 'Version' ELSE '' END)) AS cells FROM {v_documents}"""
CELLS_D = CELLS.replace("array(", "list_value(")
STRIPPED = r"""WITH RECURSIVE lines AS (SELECT doc_id, page_no, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {v_pages}),
    n AS (SELECT doc_id, count(DISTINCT page_no) AS n_pages FROM {v_pages} GROUP BY doc_id),
    often AS (SELECT l.doc_id, trim(l.line) AS key FROM lines l JOIN n ON n.doc_id = l.doc_id WHERE n.n_pages >= 3 AND trim(l.line) <> '' GROUP BY l.doc_id, trim(l.line), n.n_pages HAVING count(DISTINCT l.page_no) >= greatest(2, floor(n.n_pages * 0.6))),
    kept AS (SELECT l.* FROM lines l JOIN n ON n.doc_id = l.doc_id ANTI JOIN often o ON o.doc_id = l.doc_id AND o.key = trim(l.line) WHERE n.n_pages < 3 OR trim(l.line) <> ''),
    texts AS (SELECT n.doc_id, coalesce(string_agg(k.line, chr(10) ORDER BY k.page_no, k.pos), '') AS text FROM n LEFT JOIN kept k ON k.doc_id = n.doc_id GROUP BY n.doc_id)"""
REPAIR = r"regexp_replace(regexp_replace(regexp_replace(text, '\b([A-Z]{2,5}-[A-Z]{2,5}-)[\s]+(\d{1,3})\b', '\1\2', 'g'), '([\p{L}\p{N}_])-[ \t]*\n[ \t]*([a-záéíóúñü])', '\1\2', 'g'), '([\p{L}\p{N}_]-)[ \t]*\n[ \t]*([A-Z0-9])', '\1\2', 'g')"
CONTENTS = r"""CASE WHEN n_lines = 0 THEN false WHEN n_lines = 1 THEN n_dotted = 1 ELSE n_dotted >= 2 AND n_dotted * 2 >= n_lines END"""
COUNTED = r"""len(list_filter(string_split(content, chr(10)), lambda l: trim(l) <> '')) AS n_lines, len(list_filter(string_split(content, chr(10)), lambda l: trim(l) <> '' AND regexp_matches(l, '\.{4,}\s*\d*\s*$'))) AS n_dotted"""
CLAUSES = rf"""{STRIPPED}, fixed AS (SELECT doc_id, {REPAIR} AS text FROM texts),
    pieces AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM fixed),
    numbered AS (SELECT *, regexp_extract(line, '{HEADING}', 1) AS heading, sum(CASE WHEN regexp_extract(line, '{HEADING}', 1) <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS clause_no FROM pieces),
    raw AS (SELECT doc_id, CAST(clause_no AS BIGINT) AS clause_no, nullif(max(heading), '') AS section, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') AS content FROM numbered GROUP BY doc_id, clause_no),
    good AS (SELECT doc_id, clause_no, section, content FROM (SELECT *, {COUNTED} FROM raw) WHERE length(content) >= 80 AND NOT ({CONTENTS})),
    rest AS (SELECT doc_id, CAST(pos - 1 AS BIGINT) AS clause_no, CAST(NULL AS VARCHAR) AS section, regexp_replace(p, '^\s+|\s+$', '', 'g') AS content FROM (SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS p, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pos FROM fixed WHERE doc_id NOT IN (SELECT doc_id FROM good))),
    clauses AS (SELECT * FROM good UNION ALL SELECT * FROM rest WHERE length(content) >= 80)"""
#: clauses cut at 3000 characters, paragraph by paragraph.
PIECES = r"""paras AS (SELECT doc_id, clause_no, section, unnest(string_split(content, chr(10) || chr(10))) AS para, generate_subscripts(string_split(content, chr(10) || chr(10)), 1) AS pos FROM clauses WHERE length(content) > 3000),
    walk AS (SELECT doc_id, clause_no, section, pos, para, 0 AS piece_no, length(para) AS size FROM paras WHERE pos = 1 UNION ALL
      SELECT p.doc_id, p.clause_no, p.section, p.pos, p.para, CASE WHEN w.size + length(p.para) > 3000 THEN w.piece_no + 1 ELSE w.piece_no END, CASE WHEN w.size + length(p.para) > 3000 THEN length(p.para) ELSE w.size + length(p.para) END
      FROM walk w JOIN paras p ON p.doc_id = w.doc_id AND p.clause_no = w.clause_no AND p.pos = w.pos + 1),
    cut AS (SELECT doc_id, clause_no, section, 0 AS piece_no, content FROM clauses WHERE length(content) <= 3000 UNION ALL
      SELECT doc_id, clause_no, max(section), piece_no, regexp_replace(string_agg(para, chr(10) || chr(10) ORDER BY pos), '^\s+|\s+$', '', 'g') FROM walk GROUP BY doc_id, clause_no, piece_no)"""
LONG = "SELECT id AS doc_id, CAST(0 AS BIGINT) AS clause_no, '1' AS section, replace(text, chr(10), concat(chr(10), chr(10))) AS content FROM {v_documents}"


def indexed(source: str) -> str:
    """Common table expressions for the index titles of a source (id, content): x_titles (id, title, has_title)."""
    return rf"""x AS (SELECT id, trim(regexp_replace(replace(content, chr(10), ' '), '^\s*\d+(\.\d+)*\.?\s*', '')) AS text FROM ({source})),
    x_words AS (SELECT id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (SELECT id, list_filter(string_split_regex(text, '\s+'), lambda w: w <> '') AS ws FROM x)),
    x_bare AS (SELECT id, pos, w, regexp_replace(w, '^[.,;:]+|[.,;:]+$', '', 'g') AS bare FROM x_words),
    x_stops AS (SELECT *, bare = '' OR regexp_matches(bare, '^[A-Z]{{2,5}}-[A-Z]{{2,5}}-\d{{1,3}}$') OR contains(w, '|') OR contains(w, ':') OR upper(bare) <> bare OR regexp_matches(bare, '^\d+$') AS stop FROM x_bare),
    x_ends AS (SELECT *, bool_or(stop) OVER (PARTITION BY id ORDER BY pos) AS ended, coalesce(sum(length(bare) + 1) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - 1, 0) AS prev FROM x_stops),
    x_runs AS (SELECT id, string_agg(bare, ' ' ORDER BY pos) FILTER (NOT ended AND prev <= 72) AS run FROM x_ends GROUP BY id),
    x_named AS (SELECT x.id, x.text, coalesce(r.run, '') AS run, length(coalesce(r.run, '')) >= 4 AND coalesce(r.run, '') NOT IN ('DE', 'DEL', 'LA', 'EL', 'LOS', 'LAS', 'Y', 'E', 'EN', 'PARA', 'POR', 'A') AS titled FROM x LEFT JOIN x_runs r ON r.id = x.id),
    x_titles AS (SELECT id, CASE WHEN text = '' THEN '(sin titulo)' WHEN titled THEN concat(substr(run, 1, 1), lower(substr(run, 2))) WHEN length(text) <= 72 THEN text ELSE concat(regexp_replace(substr(text, 1, 72), ' [^ ]*$', ''), '...') END AS title, titled AND text <> '' AS has_title FROM x_named)"""


TITLES = "'objetivo|alcance|documentos de referencia|abreviaturas|responsabilidad|control de cambios"
HEAD = r"lower(regexp_replace(substr(content, 1, 90), '^\s*\d+(\.\d+)*\.?\s*', ''))"


def _pages(s, d) -> DataFrame:
    return frame(s, d, "v_pages")


def _clauses(s, d) -> DataFrame:
    return t.split_clauses(t.strip_boilerplate(_pages(s, d)).withColumn("text", t.repair_linebreaks(F.col("text"))))


def _long(s, d) -> DataFrame:
    # a document's text, its lines as paragraphs
    return sql(s, d, LONG)


def _ingested(s, d, k: int) -> DataFrame:
    return t.ingest(frame(s, d, "v_documents"), _pages(s, d))[k]


QUERIES = {
    "T1_repair_linebreaks": lambda s, d: _pages(s, d).select("doc_id", "page_no", t.repair_linebreaks(F.col("text")).alias("text")),
    "T2_strip_boilerplate": lambda s, d: t.strip_boilerplate(_pages(s, d)),
    "T3_table_of_contents": lambda s, d: sql(s, d, HEADED).select("id", t.is_contents(F.col("content")).alias("is_contents")),
    "T4_announces_only": lambda s, d: sql(s, d, HEADED).select("id", t.announces_only(F.col("content")).alias("announces")),
    "T5_render_table": lambda s, d: sql(s, d, CELLS).select("id", t.render_table(F.col("cells")).alias("rendered")),
    "T6_header_table": lambda s, d: sql(s, d, CELLS).select("id", t.is_header_table(F.col("cells")).alias("is_header")),
    "T7_split_clauses": _clauses,
    "T8_split_oversized": lambda s, d: t.split_oversized(_long(s, d)).select("doc_id", "piece_no", F.length("content").alias("n"), F.md5("content").alias("digest")),
    "T9_ingest_clauses": lambda s, d: _ingested(s, d, 0).select("doc_id", "clause_no", "section", "piece_no", "content"),
    "T9_ingest_report": lambda s, d: _ingested(s, d, 1),
    "T10_reindex": lambda s, d: t.reindex(t.clauses_of(_pages(s, d)), _pages(s, d), sql(s, d, "SELECT id AS doc_id FROM {v_documents} WHERE id % 9 = 0")).select("doc_id", "clause_no", "section", "piece_no", "content"),
    "T11_worth_questions": lambda s, d: sql(s, d, HEADED).select("id", t.worth_questions(F.col("content")).alias("worth")),
    "T12_formal_clause": lambda s, d: sql(s, d, HEADED).select("id", is_formal(F.col("content")).alias("formal")),
    "T13_index_title": lambda s, d: sql(s, d, HEADED).select("id", t.index_title(F.col("content")).alias("x")).select("id", "x.title", "x.has_title"),
    "T14_slug": lambda s, d: frame(s, d, "v_files").select("id", x.slug(F.concat("filename", F.lit(" Ñandú ÁÉ"))).alias("slug")),
    "T15_title": lambda s, d: frame(s, d, "v_files").select("id", x.title_from_filename(F.col("filename")).alias("title")),
    "T16_fold": lambda s, d: frame(s, d, "documents").select("doc_id", F.md5(x.fold(F.col("text"))).alias("digest")),
}

_SQL = {
    "T1_repair_linebreaks": f"SELECT doc_id, page_no, {REPAIR} AS text FROM {{v_pages}}",
    "T2_strip_boilerplate": f"{STRIPPED} SELECT doc_id, text FROM texts",
    "T3_table_of_contents": f"SELECT id, {CONTENTS} AS is_contents FROM (SELECT id, {COUNTED} FROM ({HEADED}))",
    "T4_announces_only": f"SELECT id, trim(content) LIKE '%:' AND length(trim(content)) < 250 AS announces FROM ({HEADED})",
    "T5_render_table": f"SELECT id, array_to_string(list_filter(list_transform(cells, lambda r: array_to_string(list_filter(list_transform(r, lambda c: trim(replace(coalesce(c, ''), chr(10), ' '))), lambda c: c <> ''), ' | ')), lambda r: r <> ''), chr(10)) AS rendered FROM ({CELLS_D})",
    "T6_header_table": f"""SELECT id, len(cells) <= 6 AND (CASE WHEN contains(flat, 'CÓDIGO') THEN 1 ELSE 0 END + CASE WHEN contains(flat, 'CODIGO') THEN 1 ELSE 0 END + CASE WHEN contains(flat, 'VERSIÓN') THEN 1 ELSE 0 END + CASE WHEN contains(flat, 'VERSION') THEN 1 ELSE 0 END + CASE WHEN contains(flat, 'PÁGINA') THEN 1 ELSE 0 END) >= 2 AS is_header
        FROM (SELECT id, cells, upper(array_to_string(list_transform(flatten(cells[1:2]), lambda c: coalesce(c, '')), ' ')) AS flat FROM ({CELLS_D}))""",
    "T7_split_clauses": f"{CLAUSES} SELECT * FROM clauses",
    "T8_split_oversized": f"WITH RECURSIVE clauses AS ({LONG}), {PIECES} SELECT doc_id, piece_no, length(content) AS n, md5(content) AS digest FROM cut",
    "T9_ingest_clauses": f"{CLAUSES}, {PIECES} SELECT doc_id, clause_no, section, piece_no, content FROM cut",
    "T9_ingest_report": rf"""{CLAUSES}, {PIECES}, t AS (SELECT doc_id, regexp_replace(content, '^\s+|\s+$', '', 'g') AS content FROM cut) SELECT d.id AS doc_id, d.code, d.version, count(c.doc_id) AS clauses, count(*) FILTER (c.content LIKE '%:' AND length(c.content) < 250) AS blind, count(c.doc_id) = 0 AS skipped
        FROM {{v_documents}} d LEFT JOIN t c ON c.doc_id = d.id GROUP BY d.id, d.code, d.version""",
    "T10_reindex": f"{CLAUSES}, {PIECES} SELECT doc_id, clause_no, section, piece_no, content FROM cut",
    "T11_worth_questions": f"SELECT id, length(content) >= 120 AND NOT regexp_matches({HEAD}, '^({TITLES[1:]}|anexos|registros)') AND NOT (trim(content) LIKE '%:' AND length(trim(content)) < 250) AS worth FROM ({HEADED})",
    "T12_formal_clause": f"SELECT id, regexp_matches({HEAD}, '^({TITLES[1:]})') AS formal FROM ({HEADED})",
    "T13_index_title": f"WITH {indexed(HEADED)} SELECT id, title, has_title FROM x_titles",
    "T15_title": r"""WITH f AS (SELECT id, trim(regexp_replace(filename, '\.[^.]*$', '')) AS stem FROM {v_files}), b AS (SELECT id, CASE WHEN regexp_matches(stem, '^([A-Z]{2,4}-[A-Z]{2}-\d{1,3})\b') THEN regexp_replace(stem, '^([A-Z]{2,4}-[A-Z]{2}-\d{1,3})\b', '') ELSE regexp_replace(stem, '(?i)^[a-z]{2,5}_[a-z]{2,5}_\d{1,3}_', '') END AS bare FROM f),
        w AS (SELECT id, list_filter(string_split_regex(regexp_replace(bare, '[_\-]+', ' ', 'g'), '\s+'), lambda w: w <> '') AS ws FROM b)
        SELECT id, array_to_string(list_transform(ws, lambda w, i: CASE WHEN i > 1 AND lower(w) IN ('de', 'del', 'la', 'las', 'el', 'los', 'y', 'o', 'en', 'a', 'por', 'para') THEN lower(w) ELSE concat(upper(substr(w, 1, 1)), lower(substr(w, 2))) END), ' ') AS title FROM w""",
    "T14_slug": "SELECT id, regexp_replace(regexp_replace(lower(strip_accents(concat(filename, ' Ñandú ÁÉ'))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM {v_files}",
    "T16_fold": "SELECT doc_id, md5(lower(strip_accents(text))) AS digest FROM {documents}",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
