"""Queries L1-L8, L10, L14, L17, L18 and Q: life cycle of findings, and question pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions import text as x
from quillmark.operators import admission
from quillmark.operators import faq as q
from quillmark.operators import lifecycle as c
from quillmark.operators import register as reg
from quillmark.plans.views import frame, sql, texts, with_views

REPORTS = "SELECT event_id AS id, concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id, concat(CASE event_id % 2 WHEN 0 THEN 'Desviación ' ELSE 'desviacion, ' END, event_type) AS description, ts AS created_at FROM {events}"
#: more texts a day than the latest reports that a new one is held against
MANY_REPORTS = "SELECT event_id AS id, concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id, concat(CASE event_id % 2 WHEN 0 THEN 'Desviación ' ELSE 'desviacion, ' END, event_type, ' en el área ', CAST(user_id % 40 AS STRING)) AS description, ts AS created_at FROM {events}"
REQUESTS = """SELECT l_orderkey * 10 + l_linenumber + CAST(l_partkey AS BIGINT) * 10000000 AS id, concat('tenant-', CAST(l_suppkey % 4 AS STRING)) AS tenant_id, l_orderkey AS finding_id, concat('accion ', CAST(l_partkey % 30 AS STRING)) AS description,
    CASE WHEN l_linenumber = 3 THEN ' ' ELSE 'Jefe' END AS responsible, CASE l_linenumber WHEN 1 THEN '1995-01-01' WHEN 2 THEN 'pronto' ELSE '1999-05-05' END AS due_date_raw FROM {lineitem}"""
ASKED = "SELECT event_id AS ask_id, concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id, event_id % 20000 AS finding_id FROM {events}"
DETAILS = "SELECT event_id AS id, concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id, event_id % 5000 AS finding_id, CASE WHEN event_id % 9 = 0 THEN ' ' ELSE concat(' ', event_type, ' ') END AS detail FROM {events}"
TAGS = "SELECT DISTINCT conversation_id, 'error' AS cause, 'cita inexistente' AS reason FROM {v_escalations} WHERE conversation_id % 5 = 0"
PATCHES = "SELECT id, CASE id % 3 WHEN 0 THEN 'resuelta' WHEN 1 THEN 'pendiente' ELSE 'otra' END AS status FROM {v_escalations} WHERE id % 4 = 0"
FAILURES = "SELECT event_id AS id, event_type AS kind, repeat(props, 300) AS detail FROM {events}"
BURSTS = "SELECT event_id AS id, CAST(user_id AS STRING) AS key, TIMESTAMP '2024-01-01 00:00:00' + CAST(event_id % 3000 AS INT) * INTERVAL '1' SECOND AS ts FROM {events}"
ENTRIES = "SELECT p_partkey AS id, concat('tenant-', CAST(p_partkey % 4 AS STRING)) AS tenant_id, concat(CASE p_partkey % 6 WHEN 0 THEN 'STI' WHEN 1 THEN 'CAL' WHEN 2 THEN 'COM' WHEN 3 THEN 'GTH' WHEN 4 THEN 'SST' ELSE 'QQQ' END, '-PR-0', CAST(p_partkey % 10 AS STRING)) AS codigo, CAST(p_partkey % 4 AS STRING) AS seccion, p_type AS pregunta, p_name AS respuesta FROM {part}"
OBJECTS = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN concat('Claro: {"a":{"b":', CAST(event_id AS STRING), '}} y {"c":1}') WHEN 1 THEN 'sin objeto' WHEN 2 THEN '{"abierto": {' WHEN 3 THEN concat('```', props, '```') ELSE '} {"x":"}"} fin' END AS text FROM {events}"""
JOBS = "SELECT id, tenant_id, CASE id % 4 WHEN 0 THEN 'pendiente' WHEN 1 THEN 'requiere_revision' ELSE 'listo' END AS status, id % 3 AS n_advices FROM {v_documents}"


def _validated(s: SparkSession, d: str) -> DataFrame:
    known = reg.known_codes(frame(s, d, "v_documents"), frame(s, d, "v_registry")).select("code")
    return q.validate(frame(s, d, "v_faq"), known)


def _once(s: SparkSession, d: str) -> DataFrame:
    v = _validated(s, d)
    marked = q.first_of_each(v.filter("reason IS NULL").withColumns({"pos": F.col("id"), "item": F.lit(0)}))
    return marked.select("id", "duplicate")


def requests(s: SparkSession, d: str) -> DataFrame:
    """Requests; of those that repeat an id, the first of the table, in the order of its files and of their rows."""
    items = frame(s, d, "lineitem").select("*", F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    rows = s.sql(REQUESTS.replace("SELECT ", "SELECT place, ", 1), lineitem=items)
    first = F.min_by(F.struct(*(x for x in rows.columns if x not in ("id", "place"))), "place")
    return rows.groupBy("id").agg(first.alias("x")).select("id", "x.*")


def _actions(s: SparkSession, d: str, k: int) -> DataFrame:
    today = F.lit("1998-01-01").cast("date")
    return c.register_actions(requests(s, d), frame(s, d, "v_findings"), sql(s, d, "SELECT finding_id, description FROM {v_capa}"), today)[k]


QUERIES = {
    "L1_fingerprint": lambda s, d: sql(s, d, REPORTS).select("id", x.fingerprint(F.col("description")).alias("print"), c.severity(F.substring("description", 1, 5)).alias("severity")),
    "L2_duplicate_findings": lambda s, d: c.suppress_duplicates(sql(s, d, REPORTS)),
    "L2_recent_reports": lambda s, d: c.suppress_duplicates(sql(s, d, MANY_REPORTS)),
    "L3_register_action": lambda s, d: _actions(s, d, 0).select("id", "finding_id", F.coalesce("error", F.lit("registrada")).alias("outcome")),
    "L3_findings_after": lambda s, d: _actions(s, d, 1).select("id", "status"),
    "L4_finding_status": lambda s, d: c.finding_status(sql(s, d, ASKED), frame(s, d, "v_findings"), frame(s, d, "v_capa")).select("ask_id", "status", "severity", F.coalesce(F.size("actions"), F.lit(-1)).alias("n_actions")),
    "L5_extend_finding": lambda s, d: c.extend_findings(frame(s, d, "v_findings"), sql(s, d, DETAILS)).select("id", "description"),
    "L6_proposals": lambda s, d: c.proposals(sql(s, d, "SELECT id, tenant_id, conversation_id, content AS question FROM {v_messages} WHERE role = 'user'"), "sin_contexto", "Sin respaldo.").select("id", "tenant_id", "question", "cause", "status"),
    "L7_retag": lambda s, d: c.retag(frame(s, d, "v_escalations"), sql(s, d, TAGS)).select("id", "cause", "reason", "status"),
    "L8_incidents": lambda s, d: c.incidents(sql(s, d, FAILURES)).select("id", "reference", "kind", F.length("detail").alias("n")),
    "L10_patch_escalation": lambda s, d: c.patch_escalations(frame(s, d, "v_escalations"), sql(s, d, PATCHES), F.lit("2026-01-01").cast("timestamp")),
    "L14_upload_jobs": lambda s, d: sql(s, d, JOBS).groupBy("tenant_id").agg(F.count_if(F.col("status") == "pendiente").alias("pending"), F.count_if(F.col("status") == "requiere_revision").alias("needs_review"), F.max("id").alias("last_id")),
    "A13_upload_queue": lambda s, d: sql(s, d, "SELECT id, status, n_advices FROM (" + JOBS + ") ORDER BY id DESC LIMIT 50"),
    "L17_sliding_window": lambda s, d: admission.sliding_window(sql(s, d, BURSTS), 2),
    "L18_tenant": lambda s, d: frame(s, d, "v_messages").select("id", c.tenant(F.col("tenant_id"), "tenant-1")[0].alias("tenant"), c.tenant(F.col("tenant_id"), "tenant-1")[1].alias("overridden")),
    "Q1_numbers": lambda s, d: frame(s, d, "v_faq").select("id", F.array_join(F.array_sort(x.number_set(F.concat("clausula", F.lit(" 007 1,50")))), ",").alias("numbers")),
    "Q2_validate": lambda s, d: _validated(s, d).select("id", "reason", "detail"),
    "Q3_question_key": lambda s, d: frame(s, d, "v_faq").select("id", x.question_key(F.col("pregunta")).alias("key")),
    "Q4_first_of_each": _once,
    "Q5_candidate_clauses": lambda s, d: q.candidate_clauses(texts(s, d), frame(s, d, "v_documents"), ["src1", "src2", "src3", "src4", "src5"], "^(STI|CAL|COM)"),
    "Q6_known_codes": lambda s, d: reg.known_codes(frame(s, d, "v_documents"), frame(s, d, "v_registry")),
    "Q7_load": lambda s, d: q.load(sql(s, d, ENTRIES), frame(s, d, "v_documents"), texts(s, d)).select("id", "document_id", "chunk_id"),
    "Q8_first_object": lambda s, d: sql(s, d, OBJECTS).select("id", q.first_object(F.col("text")).alias("object")),
    "Q9_rejections": lambda s, d: _validated(s, d).filter("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")),
    "Q10_clause_key": lambda s, d: sql(s, d, ENTRIES).select("id", q.clause_key(F.col("codigo"), F.nullif("seccion", F.lit("0"))).alias("key")),
}

PRINT = "trim(regexp_replace(lower(strip_accents(description)), '[^a-z0-9]+', ' ', 'g'))"
ACTIONS = f"""WITH r AS (SELECT DISTINCT ON (id) * FROM ({REQUESTS})), v AS (SELECT r.*, CASE WHEN regexp_matches(due_date_raw, '^\\d{{4}}') THEN CAST(due_date_raw AS DATE) END AS due, f.id AS found, EXISTS (SELECT 1 FROM {{v_capa}} a WHERE a.finding_id = r.finding_id AND a.description = r.description) AS had
    FROM r LEFT JOIN {{v_findings}} f ON f.id = r.finding_id AND f.tenant_id = r.tenant_id), e AS (SELECT *, CASE WHEN due < DATE '1998-01-01' THEN 'fecha_en_el_pasado' WHEN trim(responsible) = '' OR due IS NULL THEN 'datos_incompletos' WHEN found IS NULL THEN 'not_found' WHEN had THEN 'duplicado' END AS early FROM v),
    o AS (SELECT *, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY finding_id, description, early IS NULL ORDER BY id) > 1 THEN 'duplicado' END) AS error FROM e)"""
#: a tenant's reports one after the other, with its 50 last kept ones, the latest first
SUPPRESSED = """WITH RECURSIVE r AS (SELECT id, tenant_id, created_at, {print} AS print FROM ({reports})), e AS (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at, id) AS k FROM r),
        step AS (SELECT tenant_id, k, id, true AS kept, id AS original_id, [{{'id': id, 'print': print, 'at': created_at}}] AS recent FROM e WHERE k = 1 UNION ALL
          SELECT tenant_id, k, id, len(same) = 0, CASE WHEN len(same) = 0 THEN id ELSE same[1].id END, CASE WHEN len(same) = 0 THEN list_prepend({{'id': id, 'print': print, 'at': created_at}}, recent)[1:50] ELSE recent END
          FROM (SELECT e.tenant_id, e.k, e.id, e.print, e.created_at, s.recent, list_filter(s.recent, lambda q: q.print = e.print AND q.at >= e.created_at - INTERVAL 24 HOUR) AS same FROM step s JOIN e ON e.tenant_id = s.tenant_id AND e.k = s.k + 1))
        SELECT id, kept, original_id FROM step"""
NUMBERS = lambda t: f"list_distinct(list_transform(regexp_extract_all({t}, '\\d+(?:[.,]\\d+)*'), lambda n: regexp_replace(replace(n, ',', '.'), '^0+(\\d)', '\\1')))"
CODES = lambda t: f"list_distinct(regexp_extract_all({t}, '\\b[A-Z]{{2,5}}-[A-Z]{{2,5}}-\\d{{1,3}}\\b'))"
VALID = f"""WITH k AS (SELECT list(code) AS codes FROM (SELECT code FROM {{v_documents}} UNION SELECT code FROM {{v_registry}})), f AS (SELECT *, list_filter({NUMBERS('respuesta')}, lambda n: NOT list_contains({NUMBERS('clausula')}, n) AND n NOT IN ('9001', '9000', '14001', '45001', '2015', '2018')) AS figures,
    list_filter({CODES('respuesta')}, lambda n: NOT list_contains({CODES('clausula')}, n) AND n <> codigo) AS foreign_codes, list_filter({CODES('respuesta')}, lambda n: n <> codigo AND NOT list_contains(k.codes, n)) AS unknown FROM {{v_faq}} CROSS JOIN k),
    valid AS (SELECT id, pregunta, CASE WHEN length(pregunta) < 10 OR pregunta NOT LIKE '%?' THEN 'pregunta_vacia' WHEN length(respuesta) NOT BETWEEN 20 AND 600 THEN 'longitud' WHEN len(figures) > 0 THEN 'cifra_inventada' WHEN len(foreign_codes) > 0 THEN 'codigo_inventado' WHEN len(unknown) > 0 THEN 'codigo_inexistente' END AS reason,
      CASE WHEN length(pregunta) < 10 OR pregunta NOT LIKE '%?' THEN substr(pregunta, 1, 60) WHEN length(respuesta) NOT BETWEEN 20 AND 600 THEN concat(length(respuesta), ' caracteres') WHEN len(figures) > 0 THEN array_to_string(list_sort(figures), ', ') WHEN len(foreign_codes) > 0 THEN array_to_string(list_sort(foreign_codes), ', ') WHEN len(unknown) > 0 THEN array_to_string(list_sort(unknown), ', ') END AS detail FROM f)"""
KEY = "array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(strip_accents(pregunta)), '[a-z0-9_]+'), lambda w: w NOT IN (" + ", ".join(f"'{w}'" for w in x.QUESTION_STOPS) + ")), lambda w: substr(w, 1, 6)))), ' ')"

_SQL = {
    "L1_fingerprint": f"SELECT id, {PRINT} AS print, CASE WHEN substr(description, 1, 5) IN ('observacion', 'menor', 'mayor') THEN substr(description, 1, 5) ELSE 'menor' END AS severity FROM ({REPORTS})",
    "L2_duplicate_findings": SUPPRESSED.format(reports=REPORTS, print=PRINT),
    "L2_recent_reports": SUPPRESSED.format(reports=MANY_REPORTS, print=PRINT),
    "L17_sliding_window": f"""WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ts, id) AS k FROM ({BURSTS})),
        step AS (SELECT id, key, k, true AS admitted, [ts] AS seen FROM e WHERE k = 1 UNION ALL
          SELECT id, key, k, len(own) < 2, CASE WHEN len(own) < 2 THEN list_append(own, ts) ELSE own END FROM (SELECT e.*, list_filter(s.seen, lambda t: t >= e.ts - INTERVAL 60 SECOND) AS own FROM step s JOIN e ON e.key = s.key AND e.k = s.k + 1))
        SELECT id, admitted FROM step""",
    "L3_register_action": ACTIONS + " SELECT id, finding_id, coalesce(error, 'registrada') AS outcome FROM o",
    "L3_findings_after": ACTIONS + " SELECT f.id, CASE WHEN f.status = 'abierto' AND f.id IN (SELECT finding_id FROM o WHERE error IS NULL) THEN 'en_revision' ELSE f.status END AS status FROM {v_findings} f",
    "L4_finding_status": f"""SELECT a.ask_id, coalesce(f.status, 'not_found') AS status, f.severity, CASE WHEN f.id IS NULL THEN -1 ELSE (SELECT count(*) FROM {{v_capa}} c WHERE c.finding_id = f.id) END AS n_actions FROM ({ASKED}) a LEFT JOIN {{v_findings}} f ON f.id = a.finding_id AND f.tenant_id = a.tenant_id""",
    "L5_extend_finding": f"""WITH d AS (SELECT tenant_id, finding_id, string_agg(concat(chr(10), chr(10), 'Ampliación: ', trim(detail)), '' ORDER BY id) AS more FROM ({DETAILS}) WHERE trim(detail) <> '' GROUP BY tenant_id, finding_id) SELECT f.id, concat(f.description, coalesce(d.more, '')) AS description FROM {{v_findings}} f LEFT JOIN d ON d.finding_id = f.id AND d.tenant_id = f.tenant_id""",
    "L6_proposals": "SELECT id, tenant_id, content AS question, 'sin_contexto' AS cause, 'propuesta' AS status FROM {v_messages} WHERE role = 'user'",
    "L7_retag": """WITH e AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) = 1 AND conversation_id % 5 = 0 AND cause <> 'error' AS hit FROM {v_escalations}) SELECT id, CASE WHEN hit THEN 'error' ELSE cause END AS cause, CASE WHEN hit THEN 'cita inexistente' END AS reason, CASE WHEN hit THEN 'propuesta' ELSE status END AS status FROM e""",
    "L8_incidents": f"SELECT id, concat('INC-', CASE WHEN length(CAST(id AS VARCHAR)) < 5 THEN lpad(CAST(id AS VARCHAR), 5, '0') ELSE CAST(id AS VARCHAR) END) AS reference, kind, least(2000, length(detail)) AS n FROM ({FAILURES})",
    "L10_patch_escalation": """SELECT id, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN 'resuelta' WHEN id % 4 = 0 AND id % 3 = 1 THEN 'pendiente' ELSE status END AS status, CASE WHEN id % 4 = 0 AND id % 3 = 0 THEN TIMESTAMP '2026-01-01' WHEN (id % 4 <> 0 OR id % 3 = 2) AND status IN ('resuelta', 'descartada') THEN created_at END AS resolved_at FROM {v_escalations}""",
    "L14_upload_jobs": f"SELECT tenant_id, count(*) FILTER (status = 'pendiente') AS pending, count(*) FILTER (status = 'requiere_revision') AS needs_review, max(id) AS last_id FROM ({JOBS}) GROUP BY tenant_id",
    "A13_upload_queue": f"SELECT id, status, n_advices FROM ({JOBS}) ORDER BY id DESC LIMIT 50",
    "L18_tenant": "SELECT id, 'tenant-1' AS tenant, tenant_id <> 'tenant-1' AS overridden FROM {v_messages}",
    "Q1_numbers": f"SELECT id, array_to_string(list_sort({NUMBERS('t')}), ',') AS numbers FROM (SELECT id, concat(clausula, ' 007 1,50') AS t FROM {{v_faq}})",
    "Q2_validate": VALID + " SELECT id, reason, detail FROM valid",
    "Q3_question_key": f"SELECT id, {KEY} AS key FROM {{v_faq}}",
    "Q4_first_of_each": VALID + f" SELECT id, row_number() OVER (PARTITION BY {KEY} ORDER BY id) > 1 AS duplicate FROM valid WHERE reason IS NULL",
    "Q5_candidate_clauses": r"""SELECT c.id AS chunk_id, d.code, d.version, d.area, c.section FROM {v_chunks} c JOIN {v_documents} d ON d.id = c.document_id WHERE d.status = 'vigente' AND d.area IN ('src1', 'src2', 'src3', 'src4', 'src5') AND regexp_matches(d.code, '^(STI|CAL|COM)') AND length(c.content) >= 120
        AND NOT starts_with(c.content, '1. OBJETIVO') AND NOT (trim(c.content) LIKE '%:' AND length(trim(c.content)) < 250)""",
    "Q6_known_codes": "SELECT tenant_id, code FROM {v_documents} UNION SELECT tenant_id, code FROM {v_registry}",
    "Q7_load": f"""WITH d AS (SELECT tenant_id, code, max(id) AS document_id FROM {{v_documents}} GROUP BY ALL), c AS (SELECT document_id, section, max(id) AS chunk_id FROM {{v_chunks}} GROUP BY ALL), e AS (SELECT e.*, d.document_id, c.chunk_id, row_number() OVER (PARTITION BY e.tenant_id, d.document_id, e.pregunta ORDER BY e.id) AS place
        FROM ({ENTRIES}) e JOIN d ON d.tenant_id = e.tenant_id AND d.code = e.codigo LEFT JOIN c ON c.document_id = d.document_id AND c.section = e.seccion) SELECT id, document_id, chunk_id FROM e WHERE place = 1""",
    "Q8_first_object": """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN concat('{"a":{"b":', CAST(event_id AS VARCHAR), '}}') WHEN 3 THEN props WHEN 4 THEN '{"x":"}' END AS object FROM {events}""",
    "Q9_rejections": VALID + " SELECT reason, count(*) AS n FROM valid WHERE reason IS NOT NULL GROUP BY reason",
    "Q10_clause_key": f"SELECT id, concat(codigo, '§', CASE WHEN seccion = '0' THEN '-' ELSE seccion END) AS key FROM ({ENTRIES})",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
