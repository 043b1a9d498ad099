"""Queries V and S: document control, sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as x
from quillmark.operators import identity as i
from quillmark.operators import register as g
from quillmark.plans.views import frame, sql, with_views
from quillmark.sources import records
from quillmark.sources import tables as t
from quillmark.sources.scratch import scratch
from quillmark.sources.snapshots import Snapshots

HEADERS = "SELECT id, concat('CODIGO : ', lower(code), ' VERSION : 0', substr(version, 2), CASE WHEN id % 4 = 0 THEN ' REVISION : 31/02/2024' WHEN id % 4 = 1 THEN ' Revisión: 08/04/2025' ELSE '' END) AS text FROM {v_documents}"
#: The words of an approval block, with places: labels in three columns, roles below in one or two lines, a footer.
WORDS = """SELECT d.id AS doc_id, CAST(600 AS DOUBLE) AS page_width, w.text, CAST(w.x0 AS DOUBLE) AS x0, CAST(w.x0 + 40 AS DOUBLE) AS x1, CAST(w.top + d.id % 3 AS DOUBLE) AS top FROM {v_documents} d JOIN (
    SELECT 'ELABORADO' AS text, 60 AS x0, 100 AS top, 0 AS k UNION ALL SELECT 'POR:', 105, 100, 0 UNION ALL SELECT 'REVISADO', 260, 100, 0 UNION ALL SELECT 'POR:', 305, 100, 0 UNION ALL SELECT 'APROBADO', 460, 100, 1 UNION ALL SELECT 'POR:', 505, 100, 1
    UNION ALL SELECT 'JEFE', 50, 120, 0 UNION ALL SELECT 'TI', 95, 120, 0 UNION ALL SELECT 'COORDINADOR', 250, 120, 0 UNION ALL SELECT 'GERENTE', 450, 120, 1 UNION ALL SELECT 'GENERAL', 500, 132, 1 UNION ALL SELECT 'prohibida', 50, 150, 0 UNION ALL SELECT 'nada', 450, 165, 0) w ON w.k = 0 OR d.id % 5 <> 0"""
LAST_PAGES = "SELECT id AS doc_id, CASE WHEN id % 10 = 0 THEN 'Elaborado por Gestion Humana Aprobado por el Gerente General Esta prohibida la copia' ELSE 'sin firmas' END AS text FROM {v_documents}"
TODAY = "DATE '2026-01-01'"
FILES = "SELECT id, tenant_id, code, CASE WHEN id % 3 = 0 THEN concat(title, ' (', area, ')') ELSE title END AS title, concat(folder, filename) AS path, CASE WHEN id % 4 < 2 THEN 'same' ELSE text END AS content FROM (SELECT f.*, d.title, d.area FROM {v_files} f JOIN {v_documents} d ON d.id = f.id)"
REGISTER_TEXT = """SELECT tenant_id, id AS pos, concat('Documento ', title, ' ', code, ' ', CASE WHEN id % 8 = 0 THEN 'N/A' ELSE lpad(substr(version, 2), 2, '0') END, ' ', CASE WHEN id % 5 = 0 THEN 'N/A' WHEN id % 5 = 1 THEN '31/02/2024' ELSE '15/03/2024' END) AS line FROM {v_documents}"""
UPLOAD_FILES = "SELECT id, tenant_id, concat('in/', CASE id % 4 WHEN 0 THEN 'Informe Final.PDF' WHEN 1 THEN concat(code, '.pdf') WHEN 2 THEN 'nota.txt' ELSE 'Año.pdf' END) AS path, CASE WHEN id % 11 = 0 THEN 0 WHEN id % 13 = 0 THEN 99999999 ELSE length(text) END AS length FROM {v_documents}"
PATCHES = "SELECT id, 'obsoleto' AS status, CASE WHEN id % 2 = 0 THEN 'Nueva area' END AS area FROM {v_documents} WHERE id % 10 = 0"
GONE = "SELECT id FROM {v_documents} WHERE id % 7 = 3"
CHECKPOINTS = """SELECT id AS pos, CASE WHEN id % 9 = 0 THEN '{"clave": "torn' ELSE concat('{"clave":"', code, '§', CAST(id % 3 AS STRING), '","codigo":"', code, '","version":"', version, '","titulo":"t","area":"', area, '","seccion":"', CAST(id % 3 AS STRING), '","generadas":[{"pregunta":"p', CAST(id AS STRING), '","respuesta":"r"}]}') END AS value FROM {v_documents}"""
METADATA = """SELECT concat(code, '_', CAST(id % 400 AS STRING), '.pdf') AS filename, code, version, concat(title, CASE WHEN id % 6 = 0 THEN ', con "comillas"' ELSE '' END) AS title, area,
    CASE WHEN id % 12 = 0 THEN '2024-02-31' WHEN id % 5 = 0 THEN '' ELSE CAST(effective_date AS STRING) END AS effective_date, CASE WHEN id % 4 = 0 THEN '' WHEN id % 50 = 1 THEN 'otro' ELSE status END AS status FROM {v_documents}"""
EXAMPLES = """SELECT id, CASE WHEN id % 10 = 0 THEN 'valid' WHEN id % 10 = 1 THEN 'test' ELSE 'train' END AS particion, array(named_struct('role', 'user', 'content', question, 'tool_calls', CAST(NULL AS ARRAY<STRING>)),
    named_struct('role', 'assistant', 'content', answer, 'tool_calls', CASE WHEN is_call THEN array('buscar_documentos') END)) AS messages FROM {v_examples}"""
REPORTS = """SELECT concat('# Rechazos', chr(10), '- **', code, ' §', CAST(id % 9 AS STRING), '** — ZZZ-PR-99, YYY-PO-01', chr(10), '  - P: que dice ', CAST(id AS STRING), '?', chr(10), '  - R: lo dice ZZZ-PR-99', chr(10), CASE WHEN id % 2 = 0 THEN concat('- **', code, ' §1** — QQQ-PR-01', chr(10), '  - P: otra', chr(10), '  - R: nada', chr(10)) ELSE '' END) AS value FROM {v_documents}"""


def V(name: str):  # noqa: N802
    return lambda s, d: frame(s, d, name)


docs, uploads, registry, chunks = V("v_documents"), V("v_uploads"), V("v_registry"), V("v_chunks")


def assessed(s: SparkSession, d: str) -> DataFrame:
    return i.assess(uploads(s, d), registry(s, d), docs(s, d))


def _jobs(s, d, k: int) -> DataFrame:
    return i.resolve_jobs(assessed(s, d), docs(s, d), F.lit("2026-01-01").cast("date"))[k]


def _with(s, d, text: str, name: str, write, read):
    """What `read` makes of the path to which `write` has written the statement's rows."""
    path = scratch(s, name)
    write(sql(s, d, text), path)
    return read(path)


def _metadata(s, d, k: int) -> DataFrame:
    return _with(s, d, METADATA, "metadata", lambda df, p: df.repartitionByRange("filename").sortWithinPartitions("filename", "version").write.csv(p, header=True, escape='"'), lambda p: t.read_metadata(s, p)[k])


def _text(s, rows: DataFrame, order: list[str], kind: str) -> DataFrame:
    """What a data source makes of text files of rows, which are written in order, a folder for each tenant if there is one."""
    path = scratch(s, kind)
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    (sorted_.drop("pos").write.partitionBy("tenant_id") if "tenant_id" in rows.columns else sorted_.write).text(path)
    records.register(s)
    return s.read.format(kind).load(path)


def _register_replaced(s, d) -> DataFrame:
    table = Snapshots(s, scratch(s, "register"), ["tenant_id", "code"])
    t.load_register(registry(s, d), table)
    t.load_register(registry(s, d).filter("tenant_id = 'tenant-1' AND code LIKE 'CAL%'"), table)
    return table.read().select("tenant_id", "code", "version", "effective_date")


def _table(s, rows: DataFrame, name: str) -> Snapshots:
    table = Snapshots(s, scratch(s, name), ["id"])
    table.create(rows)
    return table


def _patched(s, d) -> DataFrame:
    table, patches = _table(s, docs(s, d), "documents"), sql(s, d, PATCHES)
    table.change(put=g.patched(table.read().join(patches, "id", "left_semi"), patches, ["status", "area"]))
    return table.read()


def _deleted(s, d) -> DataFrame:
    """The clauses that are left once documents are deleted: the clauses go first, so that none is without its document."""
    documents, clauses, gone = _table(s, docs(s, d), "documents"), _table(s, chunks(s, d), "clauses"), sql(s, d, GONE)
    clauses.change(out=clauses.read().join(gone.withColumnRenamed("id", "document_id"), "document_id", "left_semi"))
    documents.change(out=gone)
    return clauses.read().join(documents.read().select(F.col("id").alias("document_id")), "document_id", "left_semi")


def _faq_file(s, d) -> DataFrame:
    rows = sql(s, d, "SELECT id % 20 AS file, pregunta, respuesta, codigo FROM {v_faq}")
    null = F.lit(None).cast("string")
    entry = F.struct("pregunta", "respuesta", "codigo", null.alias("version"), null.alias("titulo_documento"), null.alias("area"), F.lit("7.1").alias("seccion"))
    path = scratch(s, "faq")
    rows.groupBy("file").agg(F.count("*").alias("total"), F.collect_list(entry).alias("entradas")).drop("file").repartition(4).write.json(path)
    # a file of JSON lines is read line by line; multi-line files hold one object
    return s.read.schema(t.FAQ_FILE).json(path).select(F.explode("entradas").alias("e")).select("e.pregunta", "e.respuesta", "e.codigo", "e.seccion")


def _sink(s, d) -> DataFrame:
    return _with(s, d, EXAMPLES, "dataset", t.write_dataset, lambda p: s.read.json(p)).select("id", "particion", F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|").alias("messages"))


def _appended(s, d) -> DataFrame:
    path = scratch(s, "checkpoint")
    lines = t.read_checkpoint(sql(s, d, CHECKPOINTS)).drop("pos")
    t.append_checkpoint(lines.filter("seccion = '0'"), path)
    t.append_checkpoint(lines.filter("seccion <> '0'"), path)
    return s.read.schema(t.CHECKPOINT).json(path).select("clave", "codigo", F.col("generadas")[0]["pregunta"].alias("pregunta"))


def _sorted_csv(s, d) -> DataFrame:
    return _with(s, d, METADATA, "csv", t.write_metadata, lambda p: s.read.csv(p, header=True, escape='"')).select("filename", "code", "version", "title", "area")


def _approval(s, d) -> DataFrame:
    return i.approvals(sql(s, d, WORDS), sql(s, d, LAST_PAGES))




def _flat():
    return F.array_join(F.transform("advices", lambda a: F.concat(a["code"], F.lit("="), a["detail"])), ";")


QUERIES = {
    "V1_header": lambda s, d: sql(s, d, HEADERS).select("id", i.parse_header(F.col("text")).alias("h")).select("id", "h.*"),
    "V2_filename_code": lambda s, d: V("v_files")(s, d).select("id", i.code_from_filename(F.col("filename")).alias("code")),
    "V3_approval_block": lambda s, d: i.approval_blocks(sql(s, d, WORDS)),
    "V4_approval_inline": _approval,
    "V5_assess": lambda s, d: assessed(s, d).select("id", "code", "version", _flat().alias("advices"), "blocking", "needs_review"),
    "V6_version_number": lambda s, d: docs(s, d).select("id", x.version_number(F.col("version")).alias("n")),
    "V7_document_type": lambda s, d: docs(s, d).select("id", x.document_type(F.col("code")).alias("kind")),
    "V8_jobs": lambda s, d: _jobs(s, d, 0).select("id", "tenant_id", "code", "version", "status", "created_document"),
    "V8_documents": lambda s, d: _jobs(s, d, 1).select("id", "tenant_id", "code", "version", "title", "area", "status"),
    "V9_apply_advice": lambda s, d: i.apply_advice(assessed(s, d), docs(s, d))[0].select("id", "status"),
    "V10_discard": lambda s, d: i.discard(_jobs(s, d, 0), sql(s, d, "SELECT id FROM {v_documents} WHERE id % 5 = 0"), docs(s, d), chunks(s, d))[0].select("id", "status"),
    "V11_reconcile": lambda s, d: g.reconcile(docs(s, d), registry(s, d)),
    "V12_same_content": lambda s, d: g.same_content_once(sql(s, d, FILES)).select("id", "tenant_id", "code", "path"),
    "V13_distinct_codes": lambda s, d: g.distinct_codes(sql(s, d, FILES)).select("id", "tenant_id", "code"),
    "V14_unique_filenames": lambda s, d: g.unique_filenames(sql(s, d, "SELECT id, tenant_id, code, area AS title FROM {v_documents}")).select("id", "filename"),
    "V15_coverage": lambda s, d: g.coverage(docs(s, d), registry(s, d)),
    "V16_known_codes": lambda s, d: g.known_codes(docs(s, d), registry(s, d)),
    "V17_version_map": lambda s, d: g.version_map(docs(s, d)).select("tenant_id", "code", F.array_join("versions", ",").alias("versions"), "in_force"),
    "V18_conflicts": lambda s, d: g.conflicts(docs(s, d)).select("tenant_id", "code", F.array_join("versions", ",").alias("versions")),
    "V19_patch": lambda s, d: _patched(s, d).select("id", "status", "area"),
    "V20_delete": lambda s, d: _deleted(s, d).select("id", "document_id"),
    "S1_metadata": lambda s, d: _metadata(s, d, 0),
    "S1_metadata_errors": lambda s, d: _metadata(s, d, 1),
    "S2_iso_date": lambda s, d: sql(s, d, METADATA).select("filename", "version", t.iso_date(F.col("effective_date"))[0].alias("day"), t.iso_date(F.col("effective_date"))[1].alias("wrong")),
    "S3_register_text": lambda s, d: g.register_rows(_text(s, sql(s, d, REGISTER_TEXT).select("tenant_id", "pos", "line"), ["tenant_id", "pos"], "register_text")),
    "S4_coded_files": lambda s, d: t.coded_files(sql(s, d, FILES).select("path")).select("path", "code", "title", "area"),
    "S5_faq_file": _faq_file,
    "S6_checkpoint": lambda s, d: t.read_checkpoint(sql(s, d, CHECKPOINTS)).select("clave", "pos", F.col("generadas")[0]["pregunta"].alias("pregunta")),
    "S7_checkpoint_sink": _appended,
    "S8_resume": lambda s, d: t.unfinished(sql(s, d, "SELECT DISTINCT concat(code, '§', CAST(id % 3 AS STRING)) AS clave FROM {v_documents}"), t.read_checkpoint(sql(s, d, CHECKPOINTS))),
    "S9_register_load": _register_replaced,
    "S10_register_seed": lambda s, d: t.register_of_metadata(docs(s, d).withColumn("code", F.lower("code")), F.col("tenant_id")).select("tenant_id", "code", "version", "process", "effective_date"),
    "S11_metadata_sink": _sorted_csv,
    "S12_dataset_sink": _sink,
    "S13_tagged": lambda s, d: t.tagged(sql(s, d, EXAMPLES)).select("id", "particion", "tipo"),
    "S14_rejections": lambda s, d: t.rejection_summary(sql(s, d, "SELECT id, CASE WHEN id % 3 = 0 THEN 'longitud' ELSE 'cifra_inventada' END AS reason, pregunta AS question FROM {v_faq}")).select("reason", "total", "place", "question"),
    "S15_rejection_report": lambda s, d: _text(s, sql(s, d, REPORTS), ["value"], "rejection_text").drop("tenant_id", "pos"),
    "S16_admission": lambda s, d: t.admit_uploads(sql(s, d, UPLOAD_FILES)).select("id", "status", "reason", "stored_name"),
}

FOOTER = r"(?i)(?:Est[áa]\s+)?prohibid|reproducci|autorizaci[oó]n expresa"
#: Approval blocks; lines of these pages have one height each.
BLOCKS = rf"""WITH w AS (SELECT *, (x0 + x1) / 2 AS mid, trim(upper(text), ':') AS label FROM ({WORDS})), r AS (SELECT doc_id, max(top) AS row FROM w WHERE label IN ('ELABORADO', 'REVISADO', 'APROBADO') GROUP BY doc_id),
    c AS (SELECT w.doc_id, label, coalesce((mid + lag(mid) OVER (PARTITION BY w.doc_id ORDER BY mid)) / 2, 0) AS low, coalesce((mid + lead(mid) OVER (PARTITION BY w.doc_id ORDER BY mid)) / 2, page_width) AS high FROM w JOIN r ON r.doc_id = w.doc_id WHERE abs(top - row) < 4 AND label IN ('ELABORADO', 'REVISADO', 'APROBADO')),
    b AS (SELECT w.* FROM w JOIN r ON r.doc_id = w.doc_id WHERE top > row + 1), f AS (SELECT doc_id, min(top) AS footer FROM (SELECT doc_id, top, string_agg(text, ' ' ORDER BY x0) AS line FROM b GROUP BY doc_id, top) WHERE regexp_matches(line, '{FOOTER}') GROUP BY doc_id),
    p AS (SELECT c.doc_id, c.label, b.top, string_agg(b.text, ' ' ORDER BY b.x0) AS part FROM b JOIN c ON c.doc_id = b.doc_id AND b.mid >= c.low AND b.mid < c.high LEFT JOIN f ON f.doc_id = b.doc_id WHERE f.footer IS NULL OR b.top < f.footer GROUP BY c.doc_id, c.label, b.top),
    k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, label ORDER BY top) AS place FROM p), o AS (SELECT doc_id, label, string_agg(part, ' ' ORDER BY top) AS role FROM k WHERE place <= 3 GROUP BY doc_id, label),
    blocks AS (SELECT d.doc_id, max(role) FILTER (label = 'ELABORADO') AS prepared_by, max(role) FILTER (label = 'REVISADO') AS reviewed_by, max(role) FILTER (label = 'APROBADO') AS approved_by FROM (SELECT DISTINCT doc_id FROM w) d LEFT JOIN o ON o.doc_id = d.doc_id GROUP BY d.doc_id)"""


def inline(label: str) -> str:
    found = rf"regexp_extract(text, '(?i){label}\s+por\s+(?:el|la|los|las)?\s*([^\n_]{{3,60}})', 1)"
    cut = rf"string_split_regex(string_split_regex({found}, '(?i)\s+(?:Elaborado|Revisado|Aprobado)\s+por\b')[1], '{FOOTER}')[1]"
    return rf"nullif(regexp_replace(regexp_replace({cut}, '^[ :.\t-]+|[ :.\t-]+$', '', 'g'), '^\s+|\s+$', '', 'g'), '')"


ASSESSED = """WITH u AS (SELECT *, nullif(regexp_extract(trim(regexp_replace(filename, '\\.[^.]*$', '')), '^([A-Z]{2,4}-[A-Z]{2}-\\d{1,3})\\b', 1), '') AS name_code FROM {v_uploads}),
    c AS (SELECT * EXCLUDE (name_code), name_code, coalesce(header_code, name_code) AS code, CASE WHEN coalesce(header_code, name_code) IS NOT NULL THEN coalesce(header_version, 'v1') END AS version FROM u),
    j AS (SELECT c.*, r.code IS NOT NULL AS registered, r.version AS reg_version, r.effective_date AS reg_date FROM c LEFT JOIN {v_registry} r ON r.tenant_id = c.tenant_id AND r.code = c.code),
    h AS (SELECT j.id, count(d.id) AS have, string_agg(CAST(d.id AS VARCHAR), ',' ORDER BY d.id) FILTER (d.version = j.version) AS same,
      string_agg(CAST(d.id AS VARCHAR), ',' ORDER BY d.id) FILTER (d.status = 'vigente' AND d.version <> j.version AND CAST(substr(d.version, 2) AS INT) < CAST(substr(j.version, 2) AS INT)) AS older,
      string_agg(CAST(d.id AS VARCHAR), ',' ORDER BY d.id) FILTER (CAST(substr(d.version, 2) AS INT) > CAST(substr(j.version, 2) AS INT)) AS newer FROM j LEFT JOIN {v_documents} d ON d.tenant_id = j.tenant_id AND d.code = j.code GROUP BY j.id),
    a AS (SELECT j.*, list_filter([CASE WHEN header_code <> name_code THEN concat('code_mismatch=', name_code, '/', header_code) END, CASE WHEN j.code IS NULL THEN 'no_code=' END, CASE WHEN j.code IS NOT NULL AND header_version IS NULL THEN 'no_version=' END,
      CASE WHEN split_part(j.code, '-', 2) IN ('PR', 'MN', 'IN', 'PL') AND approved_by IS NULL THEN concat('sin_bloque_de_aprobacion=', split_part(j.code, '-', 2)) END, CASE WHEN j.code IS NOT NULL AND NOT registered THEN 'fuera_de_lista_maestra=' END,
      CASE WHEN registered AND reg_date IS NULL THEN 'sin_fecha_de_aprobacion=' END, CASE WHEN reg_version <> j.version THEN concat('version_discrepa_de_lista_maestra=', j.version, '/', reg_version) END, CASE WHEN j.code IS NOT NULL AND have = 0 THEN 'new_document=' END,
      CASE WHEN same IS NOT NULL THEN concat('same_version_exists=', same) END, CASE WHEN older IS NOT NULL THEN concat('supersedes_previous=', older) END, CASE WHEN newer IS NOT NULL THEN concat('older_than_registered=', newer) END], lambda v: v IS NOT NULL) AS list, h.older FROM j JOIN h ON h.id = j.id),
    assessed AS (SELECT *, list_contains(list, 'no_code=') AS blocking, len(list_filter(list, lambda v: v <> 'new_document=')) > 0 AS needs_review FROM a)"""
JOBS = ASSESSED + """, jobs AS (SELECT s.id, s.tenant_id, s.code, s.version, CASE WHEN blocking OR needs_review THEN 'requiere_revision' ELSE 'listo' END AS status, NOT blocking AND d.id IS NULL AS created_document, d.id AS document_id, blocking
    FROM assessed s LEFT JOIN {v_documents} d ON d.tenant_id = s.tenant_id AND d.code = s.code AND d.version = s.version)"""
UPDATED = """, up AS (SELECT tenant_id, code, version, arg_max(area, id) AS area, arg_max(title, id) AS title FROM assessed WHERE NOT blocking GROUP BY ALL)
        SELECT {id}, coalesce(d.tenant_id, u.tenant_id) AS tenant_id, coalesce(d.code, u.code) AS code, coalesce(d.version, u.version) AS version, coalesce(nullif(trim(d.title), ''), u.title) AS title, coalesce(u.area, d.area) AS area, coalesce(d.status, 'vigente') AS status
        FROM {{v_documents}} d FULL JOIN up u ON u.tenant_id = d.tenant_id AND u.code = d.code AND u.version = d.version"""


def jobs_of_lots(n: int) -> str:
    """The jobs of uploads in n lots by id, each lot against the stock that those before it have made; a document made on the way has the number -1."""

    def of(k: int, text: str) -> str:
        return text.replace("{v_uploads}", f"(SELECT * FROM {{v_uploads}} WHERE id % {n} = {k})").replace("{v_documents}", f"stock{k - 1}" if k else "{v_documents}")

    updated = UPDATED.format(id="coalesce(d.id, -1) AS id")
    lots = ", ".join(f"jobs{k} AS ({of(k, JOBS)} SELECT id, tenant_id, code, version, status, created_document FROM jobs), stock{k} AS ({of(k, JOBS + updated)})" for k in range(n))
    return f"WITH {lots} " + " UNION ALL ".join(f"SELECT * FROM jobs{k}" for k in range(n))


BEST = "row_number() OVER (PARTITION BY filename ORDER BY version DESC)"
STATUS = "lower(coalesce(nullif(trim(status), ''), 'vigente'))"
BAD_DAY = "trim(effective_date) <> '' AND try_cast(trim(effective_date) AS DATE) IS NULL"

_SQL = {
    "V1_header": rf"""SELECT id, nullif(upper(regexp_extract(text, '(?i)C[OÓó]D(?:IGO)?\s*[:.]?\s*([A-Z]{{2,4}}-[A-Z]{{2}}-\d{{1,3}})', 1)), '') AS code, concat('v', CAST(CAST(nullif(regexp_extract(text, '(?i)VERSI[OÓó]N\s*[:.]?\s*(\d{{1,3}})', 1), '') AS INT) AS VARCHAR)) AS version,
        CAST(try_strptime(nullif(regexp_extract(text, '(?i)REVISI[OÓó]N\s*[:.]?\s*(\d{{2}}/\d{{2}}/\d{{4}})', 1), ''), '%d/%m/%Y') AS DATE) AS revision_date FROM ({HEADERS})""",
    "V2_filename_code": r"SELECT id, nullif(regexp_extract(trim(regexp_replace(filename, '\.[^.]*$', '')), '^([A-Z]{2,4}-[A-Z]{2}-\d{1,3})\b', 1), '') AS code FROM {v_files}",
    "V3_approval_block": f"{BLOCKS} SELECT * FROM blocks",
    "V4_approval_inline": rf"""{BLOCKS}, t AS (SELECT doc_id, {inline('Aprobado')} AS approved, {inline('Elaborado')} AS prepared FROM ({LAST_PAGES}))
        SELECT t.doc_id, CASE WHEN b.approved_by IS NULL AND t.approved IS NOT NULL THEN coalesce(b.prepared_by, t.prepared) ELSE b.prepared_by END AS prepared_by, b.reviewed_by, coalesce(b.approved_by, t.approved) AS approved_by FROM t LEFT JOIN blocks b ON b.doc_id = t.doc_id""",
    "V5_assess": ASSESSED + " SELECT id, code, version, array_to_string(list, ';') AS advices, blocking, needs_review FROM assessed",
    "V6_version_number": "SELECT id, CAST(substr(version, 2) AS INT) AS n FROM {v_documents}",
    "V7_document_type": "SELECT id, upper(split_part(code, '-', 2)) AS kind FROM {v_documents}",
    "V8_jobs": JOBS + " SELECT id, tenant_id, code, version, status, created_document FROM jobs",
    "V8_documents": JOBS + UPDATED.format(id="d.id"),
    "V9_apply_advice": ASSESSED + """, gone AS (SELECT DISTINCT tenant_id, CAST(unnest(string_split(older, ',')) AS BIGINT) AS id FROM assessed WHERE older IS NOT NULL)
        SELECT d.id, CASE WHEN g.id IS NULL THEN d.status ELSE 'obsoleto' END AS status FROM {v_documents} d LEFT JOIN gone g ON g.id = d.id AND g.tenant_id = d.tenant_id""",
    "V10_discard": JOBS + " SELECT id, status FROM jobs WHERE id % 5 <> 0",
    "V11_reconcile": """SELECT coalesce(f.tenant_id, r.tenant_id) AS tenant_id, coalesce(f.code, r.code) AS code, CASE WHEN f.code IS NULL THEN 'registered_without_file' WHEN r.code IS NULL THEN 'file_not_registered' ELSE 'both' END AS side
        FROM (SELECT DISTINCT tenant_id, upper(split_part(code, ' (', 1)) AS code FROM {v_documents}) f FULL JOIN {v_registry} r ON r.tenant_id = f.tenant_id AND r.code = f.code""",
    "V12_same_content": f"SELECT id, tenant_id, code, path FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, code, sha256(content) ORDER BY length(path), path) AS place FROM ({FILES})) WHERE place = 1",
    "V13_distinct_codes": rf"""WITH f AS (SELECT id, tenant_id, code AS base, path, coalesce(nullif(regexp_extract(title, '\(([^)]+)\)', 1), ''), string_split(path, '/')[-2]) AS q, split_part(path, '/', 1) AS root, count(*) OVER (PARTITION BY tenant_id, code) AS m FROM ({FILES})),
        a AS (SELECT *, CASE WHEN m > 1 THEN concat(base, ' (', q, ')') ELSE base END AS c1 FROM f), b AS (SELECT *, CASE WHEN m > 1 AND count(*) OVER (PARTITION BY tenant_id, c1) > 1 THEN concat(base, ' (', q, ' - ', root, ')') ELSE c1 END AS c2 FROM a),
        k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, c2 ORDER BY path) AS k FROM b) SELECT id, tenant_id, CASE WHEN m > 1 AND k > 1 THEN concat(c2, ' #', k) ELSE c2 END AS code FROM k""",
    "V14_unique_filenames": """WITH n AS (SELECT id, tenant_id, concat(regexp_replace(lower(code), '[^a-z0-9]+', '_', 'g'), '_', substr(area, 1, 60)) AS name FROM {v_documents}), k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, name ORDER BY id) AS k FROM n)
        SELECT id, concat(name, CASE WHEN k > 1 THEN concat('_', k) ELSE '' END, '.pdf') AS filename FROM k""",
    "V15_coverage": """WITH f AS (SELECT DISTINCT tenant_id, code FROM {v_documents}), s AS (SELECT coalesce(f.tenant_id, r.tenant_id) AS tenant_id, f.code AS f, r.code AS r FROM f FULL JOIN {v_registry} r ON r.tenant_id = f.tenant_id AND r.code = f.code)
        SELECT tenant_id, count(*) FILTER (f IS NOT NULL AND r IS NOT NULL) AS registered_and_indexed, count(*) FILTER (f IS NULL) AS registered_only, count(*) FILTER (r IS NULL) AS indexed_only FROM s GROUP BY tenant_id""",
    "V16_known_codes": "SELECT tenant_id, upper(split_part(code, ' (', 1)) AS code FROM {v_documents} UNION SELECT tenant_id, upper(code) FROM {v_registry}",
    "V17_version_map": "SELECT tenant_id, code, string_agg(DISTINCT version, ',' ORDER BY version) AS versions, arg_max(version, CAST(substr(version, 2) AS INT)) FILTER (status = 'vigente') AS in_force FROM {v_documents} GROUP BY tenant_id, code",
    "V18_conflicts": "SELECT tenant_id, code, string_agg(version, ',' ORDER BY version) AS versions FROM {v_documents} WHERE status = 'vigente' GROUP BY tenant_id, code HAVING count(*) > 1",
    "V19_patch": "SELECT id, CASE WHEN id % 10 = 0 THEN 'obsoleto' ELSE status END AS status, CASE WHEN id % 10 = 0 THEN 'Nueva area' ELSE area END AS area FROM {v_documents}",
    "V20_delete": "SELECT id, document_id FROM {v_chunks} WHERE document_id % 7 <> 3",
    "S1_metadata": f"""SELECT filename, code, version, title, area, try_cast(nullif(trim(effective_date), '') AS DATE) AS effective_date, {STATUS} AS status FROM (SELECT *, {BEST} AS place FROM ({METADATA}) WHERE {STATUS} IN ('vigente', 'obsoleto') AND NOT ({BAD_DAY})) WHERE place = 1""",
    "S1_metadata_errors": f"""SELECT filename, code, CASE WHEN {STATUS} NOT IN ('vigente', 'obsoleto') THEN 'status' ELSE 'effective_date' END AS error FROM ({METADATA}) WHERE {STATUS} NOT IN ('vigente', 'obsoleto') OR ({BAD_DAY})""",
    "S2_iso_date": f"SELECT filename, version, try_cast(nullif(trim(effective_date), '') AS DATE) AS day, {BAD_DAY} AS wrong FROM ({METADATA})",
    "S3_register_text": rf"""WITH r AS (SELECT tenant_id, pos, regexp_extract(rtrim(line), '\b([A-Z]{{3}}-[A-Z]{{2}}-\d{{2}})\s+(\d+|N/A)\s+(\d{{2}}/\d{{2}}/\d{{4}}|N/A)\s*$', ['code', 'v', 'd']) AS m FROM ({REGISTER_TEXT})), g AS (SELECT tenant_id, pos, m.code AS code, m.v AS v, m.d AS d FROM r WHERE m.code <> '' AND m.v <> 'N/A')
        SELECT tenant_id, code, concat('v', CAST(CAST(v AS INT) AS VARCHAR)) AS version, CAST(try_strptime(CASE WHEN d <> 'N/A' THEN d END, '%d/%m/%Y') AS DATE) AS effective_date FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, code ORDER BY pos DESC) AS place FROM g) WHERE place = 1""",
    "S4_coded_files": rf"""WITH n AS (SELECT path, trim(regexp_replace(string_split(path, '/')[-1], '(?i)\.pdf$', '')) AS name FROM ({FILES})) SELECT path, regexp_extract(name, '^([A-Z]{{3}}-[A-Z]{{2}}-\d{{2}})\s+(.+)$', 1) AS code, trim(regexp_extract(name, '^([A-Z]{{3}}-[A-Z]{{2}}-\d{{2}})\s+(.+)$', 2)) AS title,
        split_part(path, '/', 1) AS area FROM n WHERE regexp_matches(name, '^[A-Z]{{3}}-[A-Z]{{2}}-\d{{2}}\s+.+$')""",
    "S5_faq_file": "SELECT pregunta, respuesta, codigo, '7.1' AS seccion FROM {v_faq}",
    "S6_checkpoint": "SELECT concat(code, '§', CAST(id % 3 AS VARCHAR)) AS clave, min(id) AS pos, concat('p', CAST(max(id) AS VARCHAR)) AS pregunta FROM {v_documents} WHERE id % 9 <> 0 GROUP BY 1",
    "S7_checkpoint_sink": "SELECT concat(code, '§', CAST(id % 3 AS VARCHAR)) AS clave, max(code) AS codigo, concat('p', CAST(max(id) AS VARCHAR)) AS pregunta FROM {v_documents} WHERE id % 9 <> 0 GROUP BY 1",
    "S8_resume": "SELECT DISTINCT concat(code, '§', CAST(id % 3 AS VARCHAR)) AS clave FROM {v_documents} EXCEPT SELECT concat(code, '§', CAST(id % 3 AS VARCHAR)) FROM {v_documents} WHERE id % 9 <> 0",
    "S9_register_load": "SELECT tenant_id, code, version, effective_date FROM {v_registry} WHERE tenant_id <> 'tenant-1' OR code LIKE 'CAL%'",
    "S10_register_seed": "SELECT tenant_id, code, version, area AS process, effective_date FROM {v_documents}",
    "S11_metadata_sink": f"SELECT filename, code, version, title, area FROM ({METADATA})",
    "S12_dataset_sink": "SELECT id, CASE WHEN id % 10 = 0 THEN 'valid' WHEN id % 10 = 1 THEN 'test' ELSE 'train' END AS particion, concat('user:', question, '|assistant:', answer) AS messages FROM {v_examples}",
    "S13_tagged": "SELECT id, CASE WHEN id % 10 = 0 THEN 'valid' WHEN id % 10 = 1 THEN 'test' ELSE 'train' END AS particion, CASE WHEN is_call THEN 'tool_call' ELSE 'texto' END AS tipo FROM {v_examples}",
    "S14_rejections": "WITH r AS (SELECT id, CASE WHEN id % 3 = 0 THEN 'longitud' ELSE 'cifra_inventada' END AS reason, pregunta AS question FROM {v_faq}) SELECT * FROM (SELECT reason, count(*) OVER (PARTITION BY reason) AS total, row_number() OVER (PARTITION BY reason ORDER BY id) AS place, question FROM r) WHERE place <= 40",
    "S15_rejection_report": """SELECT code, CAST(id % 9 AS VARCHAR) AS section, 'ZZZ-PR-99,YYY-PO-01' AS phantoms, concat('que dice ', CAST(id AS VARCHAR), '?') AS question, 'lo dice ZZZ-PR-99' AS answer FROM {v_documents}
        UNION ALL SELECT code, '1', 'QQQ-PR-01', 'otra', 'nada' FROM {v_documents} WHERE id % 2 = 0""",
    "S16_admission": f"""WITH f AS (SELECT id, tenant_id, string_split(path, '/')[-1] AS name, CASE WHEN NOT lower(path) LIKE '%.pdf' THEN 'not_pdf' WHEN length = 0 THEN 'empty' WHEN length > 26214400 THEN 'too_large' END AS reason FROM ({UPLOAD_FILES})),
        s AS (SELECT *, substr(regexp_replace(lower(strip_accents(regexp_replace(name, '\\.[^.]*$', ''))), '[^a-z0-9]+', '_', 'g'), 1, 80) AS stem FROM f), k AS (SELECT *, row_number() OVER (PARTITION BY tenant_id, stem, reason IS NULL ORDER BY id) AS k FROM s)
        SELECT id, CASE WHEN reason IS NULL THEN 'queued' ELSE 'rejected' END AS status, reason, CASE WHEN reason IS NULL THEN concat(stem, CASE WHEN k > 1 THEN concat('_', k) ELSE '' END, '.pdf') END AS stored_name FROM k""",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
