"""Queries G: audit of answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import guardrails as g
from quillmark.operators import register as reg
from quillmark.plans.views import frame, sql, with_views

TURNS = """SELECT a.id, a.conversation_id, a.answer, a.id % 7 = 0 AS phantom, a.id % 11 = 0 AS echoed, a.id % 3 <> 0 AS documental, a.id % 4 <> 0 AS has_context, a.id % 5 = 0 AS has_data, a.id % 6 = 0 AS escalated, a.id % 13 = 0 AS empty,
    a.id % 2 = 0 AS cites, a.id % 8 = 0 AS not_retrieved, CASE WHEN a.id % 9 = 0 THEN 'produccion' ELSE 'documental' END AS kind, CASE WHEN a.id % 18 = 0 THEN 'solicitud' END AS request FROM {v_answers} a"""
RESULTS = """SELECT event_id AS id, CASE event_id % 6 WHEN 0 THEN '{"documentos":[]}' WHEN 1 THEN concat('{"documentos":[{"codigo":"', event_type, '"}]}') WHEN 2 THEN '{"error":"not_found"}' WHEN 3 THEN props WHEN 4 THEN '{"hallazgos":[],"k":1}' ELSE '{"acciones":[1],"error":null}' END AS result FROM {events}"""
CLAIMS = """SELECT id, concat(answer, ' La accion correctiva quedo con ID ', CAST(id % 40000 AS STRING), '. El hallazgo ID ', CAST(id % 30000 AS STRING), CASE WHEN id % 2 = 0 THEN ' y la no conformidad con ID 999999' ELSE '' END) AS answer FROM {v_answers}"""
OFFERED = f"""SELECT id, CASE id % 5 WHEN 0 THEN concat(answer, ' ¿Confirmas que lo derive?') WHEN 1 THEN concat(answer, ' {g.OFFER}  ') WHEN 2 THEN concat(answer, ' ¿Lo derivo?') WHEN 3 THEN '' ELSE answer END AS answer FROM {{v_answers}}"""
READS = "SELECT a.id, a.answer, d.code, d.version, array('1', '2', '9') AS sections FROM {v_answers} a JOIN {v_documents} d ON d.id = a.source_document_id"
GAPS = "SELECT m.id, m.id % 3 <> 0 AS documental, m.id % 5 = 0 AS escalated, m.id % 7 = 0 AS offered, m.id % 2 AS accepted, CASE WHEN m.id % 4 = 0 THEN array('vacaciones', 'viajes') ELSE CAST(array() AS ARRAY<STRING>) END AS missing FROM {v_messages} m"
ECHOES = "SELECT id, concat(CASE id % 8 WHEN 0 THEN 'NO INVENTES procedimientos. ' WHEN 1 THEN 'Responde unicamente con base en ellos ' ELSE '' END, answer) AS answer FROM {v_answers}"

KNOWN = "(SELECT tenant_id, upper(split_part(code, ' (', 1)) AS code FROM {v_documents} UNION SELECT tenant_id, upper(code) FROM {v_registry})"
CODES = r"'\b[A-Z]{2,5}-[A-Z]{2,5}-\d{1,3}\b'"
CLASSED = rf"""WITH a AS (SELECT id, tenant_id, answer, list(upper(split_part(code, ' (', 1))) || flatten(list(regexp_extract_all(content, {CODES}))) AS own FROM {{v_retrieved}} GROUP BY id, tenant_id, answer),
    c AS (SELECT DISTINCT id, tenant_id, own, unnest(regexp_extract_all(answer, {CODES})) AS code FROM a), k AS {KNOWN},
    classed AS (SELECT c.id, c.code, CASE WHEN list_contains(c.own, c.code) THEN 'backed' WHEN k.code IS NOT NULL THEN 'not_retrieved' ELSE 'phantom' END AS class FROM c LEFT JOIN k ON k.tenant_id = c.tenant_id AND k.code = c.code)"""
WORDS = r"list_filter(regexp_extract_all(lower(strip_accents(title)), '[a-z0-9_]+'), lambda w: length(w) > 3 AND w NOT IN ('procedimiento', 'manual', 'instructivo', 'formato', 'politica', 'plan', 'gestion', 'calidad', 'sistema', 'documento', 'documentos', 'general', 'para'))"
CITES = rf"bool_or(contains(upper(regexp_replace(answer, '[\s_-]+', '', 'g')), upper(regexp_replace(code, '[\s_-]+', '', 'g'))) OR len(list_intersect({WORDS}, regexp_extract_all(lower(strip_accents(answer)), '[a-z0-9_]+'))) >= 2)"
VERSIONS = r"'(?i)\b([A-Z]{2,5}-[A-Z]{2,5}-\d{1,3})([\s,(]{0,3}(?:versi[oóÓ]n|ver\.?|v\.?)\s*)(\d{1,3})\b'"
SECTIONS = r"'(?i)(?:secci[oóÓ]n|§|apartado|ac[aáÁ]pite)\s*(\d+(?:\.\d+)*)'"


def _answers(s: SparkSession, d: str) -> DataFrame:
    return g.by_answer(frame(s, d, "v_retrieved"))


def _classified(s: SparkSession, d: str) -> DataFrame:
    return g.classify(_answers(s, d), reg.known_codes(frame(s, d, "v_documents"), frame(s, d, "v_registry")))


def _join(*names: str):
    return [F.array_join(n, ",").alias(n) for n in names]


def _turns(s: SparkSession, d: str) -> DataFrame:
    t = sql(s, d, TURNS)
    pending = g.pending_actions(frame(s, d, "v_findings"), frame(s, d, "v_capa")).withColumn("pending", F.lit(True))
    return t.join(pending, "conversation_id", "left").withColumn("documental", F.col("documental") & F.col("pending").isNull())



QUERIES = {
    "G1_cited_codes": lambda s, d: frame(s, d, "v_answers").select("id", F.array_join(F.array_sort(g.cited_codes(F.col("answer"))), ",").alias("codes")),
    "G2_classify_citations": lambda s, d: _classified(s, d).select("id", *_join("backed", "not_retrieved", "phantom")),
    "G3_cites_source": lambda s, d: _answers(s, d).select("id", g.cites_source(F.col("answer"), F.col("chunks")).alias("cites")),
    "G4_cited_versions": lambda s, d: frame(s, d, "v_answers").select("id", F.explode(g.cited_versions(F.col("answer"))).alias("x")).select("id", "x.code", "x.version"),
    "G5_repair_versions": lambda s, d: g.repair_versions(frame(s, d, "v_answers").select("id", "tenant_id", "answer"), reg.version_map(frame(s, d, "v_documents"))).select("id", "repaired", *_join("corrections")),
    "G6_sections_named": lambda s, d: frame(s, d, "v_answers").select("id", F.array_join(g.sections_named(F.col("answer")), ",").alias("sections")),
    "G7_citations": lambda s, d: _answers(s, d).select("id", F.explode(g.citations(F.col("answer"), F.col("chunks"), F.col("id") % 6 == 0, F.col("id") % 10 == 0)).alias("c")).select("id", "c.code", "c.version", "c.section"),
    "G8_read_citations": lambda s, d: g.read_citations(sql(s, d, READS)),
    "G9_catalogue_citations": lambda s, d: g.catalogue_citations(frame(s, d, "v_answers"), frame(s, d, "v_documents")),
    "G10_invented_records": lambda s, d: g.invented_records(sql(s, d, CLAIMS), frame(s, d, "v_capa"), frame(s, d, "v_findings")),
    "G11_echoes_prompt": lambda s, d: sql(s, d, ECHOES).select("id", g.echoes_prompt(F.col("answer")).alias("echoes")),
    "G12_tool_data": lambda s, d: sql(s, d, RESULTS).select("id", g.yielded_data(F.col("result")).alias("data")),
    "G13_verdict": lambda s, d: _turns(s, d).select("id", g.verdict(*map(F.col, ("phantom", "echoed", "documental", "has_context", "has_data", "escalated", "empty"))).alias("verdict"), g.grounded(F.lit(False), F.col("id") % 10 == 0, *map(F.col, ("has_data", "has_context", "cites", "not_retrieved"))).alias("grounded")),
    "G14_gaps": lambda s, d: g.gaps(sql(s, d, GAPS)),
    "G15_offer": lambda s, d: sql(s, d, OFFERED).select("id", g.offers(F.col("answer")).alias("offers"), g.with_offer(F.col("answer")).alias("text")),
    "G16_pending_action": lambda s, d: g.pending_actions(frame(s, d, "v_findings"), frame(s, d, "v_capa")),
    "G17_production": lambda s, d: sql(s, d, TURNS).select("id", g.production_without_request(F.col("kind"), F.col("request"), F.col("answer"), "Falta la clausula.").alias("answer")),
    "G18_trace_sink": lambda s, d: g.trace_rows(_classified(s, d), 0.527).select("id", F.array_join("chunk_ids", ",").alias("chunk_ids"), F.get_json_object("trace", "$.grounded").alias("grounded"), F.get_json_object("trace", "$.retrieval.accepted[0].code").alias("first_code")),
}

_SQL = {
    "G1_cited_codes": rf"SELECT id, array_to_string(list_sort(list_distinct(regexp_extract_all(answer, {CODES}))), ',') AS codes FROM {{v_answers}}",
    "G2_classify_citations": CLASSED + """ SELECT a.id, coalesce(string_agg(c.code, ',' ORDER BY c.code) FILTER (class = 'backed'), '') AS backed, coalesce(string_agg(c.code, ',' ORDER BY c.code) FILTER (class = 'not_retrieved'), '') AS not_retrieved,
        coalesce(string_agg(c.code, ',' ORDER BY c.code) FILTER (class = 'phantom'), '') AS phantom FROM a LEFT JOIN classed c ON c.id = a.id GROUP BY a.id""",
    "G3_cites_source": f"SELECT id, {CITES} AS cites FROM {{v_retrieved}} GROUP BY id",
    "G4_cited_versions": rf"SELECT DISTINCT id, upper(regexp_extract(m, {VERSIONS}, 1)) AS code, concat('v', CAST(CAST(regexp_extract(m, {VERSIONS}, 3) AS INT) AS VARCHAR)) AS version FROM (SELECT id, unnest(regexp_extract_all(answer, {VERSIONS})) AS m FROM {{v_answers}})",
    "G5_repair_versions": rf"""WITH v AS (SELECT tenant_id, code, list(version) AS versions, arg_max(version, CAST(substr(version, 2) AS INT)) FILTER (status = 'vigente') AS in_force FROM {{v_documents}} GROUP BY tenant_id, code),
        m AS (SELECT *, regexp_extract(answer, {VERSIONS}, 0) AS whole, upper(regexp_extract(answer, {VERSIONS}, 1)) AS code, concat('v', CAST(CAST(nullif(regexp_extract(answer, {VERSIONS}, 3), '') AS INT) AS VARCHAR)) AS version FROM {{v_answers}}),
        f AS (SELECT m.*, v.in_force FROM m LEFT JOIN v ON v.tenant_id = m.tenant_id AND v.code = m.code AND NOT list_contains(v.versions, m.version) AND v.in_force IS NOT NULL)
        SELECT id, CASE WHEN in_force IS NULL THEN answer ELSE replace(answer, whole, concat(code, ' ', in_force)) END AS repaired, CASE WHEN in_force IS NULL THEN '' ELSE concat(code, ' ', version, '>', in_force) END AS corrections FROM f""",
    "G6_sections_named": rf"SELECT id, array_to_string(regexp_extract_all(answer, {SECTIONS}, 1), ',') AS sections FROM {{v_answers}}",
    "G7_citations": rf"""WITH r AS (SELECT *, list_contains(regexp_extract_all(answer, {CODES}), upper(split_part(code, ' (', 1))) AS of_code, list_contains(regexp_extract_all(answer, {SECTIONS}, 1), section) AS of_section, len(regexp_extract_all(answer, {CODES})) AS used FROM {{v_retrieved}}),
        f AS (SELECT *, bool_or(of_code AND of_section) OVER (PARTITION BY id) AS any_section, bool_or(of_code) OVER (PARTITION BY id) AS any_code FROM r)
        SELECT DISTINCT id, code, version, section FROM f WHERE used > 0 AND CASE WHEN any_section THEN of_code AND of_section WHEN any_code THEN of_code ELSE true END""",
    "G8_read_citations": rf"""WITH r AS (SELECT a.id, a.answer, d.code, d.version, list_sort(list_intersect(list_distinct(regexp_extract_all(a.answer, {SECTIONS}, 1)), ['1', '2', '9'])) AS used FROM {{v_answers}} a JOIN {{v_documents}} d ON d.id = a.source_document_id)
        SELECT id, code, version, unnest(CASE WHEN len(used) > 0 THEN used ELSE [NULL] END) AS section FROM r""",
    "G9_catalogue_citations": rf"SELECT DISTINCT c.id, d.code, d.version FROM (SELECT id, tenant_id, unnest(regexp_extract_all(answer, {CODES})) AS base FROM {{v_answers}}) c JOIN {{v_documents}} d ON d.tenant_id = c.tenant_id AND d.status = 'vigente' AND starts_with(d.code, c.base)",
    "G10_invented_records": """WITH c AS (SELECT id, 'accion correctiva' AS kind, id % 40000 AS record FROM {v_answers} UNION ALL SELECT id, 'hallazgo', id % 30000 FROM {v_answers} UNION ALL SELECT id, 'hallazgo', 999999 FROM {v_answers} WHERE id % 2 = 0)
        SELECT id, kind, record FROM c WHERE kind = 'accion correctiva' AND record NOT IN (SELECT id FROM {v_capa}) OR kind = 'hallazgo' AND record NOT IN (SELECT id FROM {v_findings})""",
    "G11_echoes_prompt": f"SELECT id, contains(lower(answer), 'no inventes procedimientos') OR contains(lower(answer), 'responde unicamente con base en ellos') AS echoes FROM ({ECHOES})",
    "G12_tool_data": f"SELECT id, coalesce(json_extract_string(result, '$.error'), '') = '' AND coalesce(CAST(json_extract(result, '$.documentos') AS VARCHAR), 'x') <> '[]' AND coalesce(CAST(json_extract(result, '$.hallazgos') AS VARCHAR), 'x') <> '[]' AS data FROM ({RESULTS})",
    "G13_verdict": f"""WITH p AS (SELECT DISTINCT conversation_id FROM {{v_findings}} WHERE status <> 'cerrado' AND id NOT IN (SELECT finding_id FROM {{v_capa}})), t AS (SELECT t.* EXCLUDE (documental), documental AND p.conversation_id IS NULL AS documental FROM ({TURNS}) t LEFT JOIN p ON p.conversation_id = t.conversation_id)
        SELECT id, CASE WHEN phantom THEN 'phantom_citation' WHEN documental AND NOT has_context AND NOT has_data THEN 'no_context' WHEN (empty OR echoed) AND escalated THEN 'escalated' WHEN (empty OR echoed) AND documental THEN 'no_context' WHEN empty OR echoed THEN 'no_answer' ELSE 'answered' END AS verdict,
        id % 10 = 0 OR has_data OR (has_context AND cites AND NOT not_retrieved) OR NOT cites AS grounded FROM t""",
    "G14_gaps": "SELECT id, 'El SGC no cubre: vacaciones, viajes. Se respondio desde el catalogo.' AS reason, 'sin_contexto' AS cause, 'propuesta' AS status FROM {v_messages} WHERE id % 3 <> 0 AND id % 5 <> 0 AND id % 7 <> 0 AND id % 2 = 0 AND id % 4 = 0",
    "G15_offer": f"""SELECT id, rtrim(answer) LIKE '%{g.OFFER}' AS offers, CASE WHEN rtrim(answer) LIKE '%{g.OFFER}' THEN rtrim(answer) WHEN id % 5 = 3 THEN '{g.OFFER}' WHEN id % 5 IN (0, 2) THEN concat(replace(replace(answer, ' ¿Confirmas que lo derive?', ''), ' ¿Lo derivo?', ''), chr(10), chr(10), '{g.OFFER}') ELSE concat(answer, chr(10), chr(10), '{g.OFFER}') END AS text FROM ({OFFERED})""",
    "G16_pending_action": "SELECT DISTINCT conversation_id FROM {v_findings} f WHERE status <> 'cerrado' AND NOT EXISTS (SELECT 1 FROM {v_capa} a WHERE a.finding_id = f.id)",
    "G17_production": f"SELECT id, CASE WHEN kind = 'produccion' AND request IS NULL THEN 'Falta la clausula.' ELSE answer END AS answer FROM ({TURNS})",
    "G18_trace_sink": CLASSED + """ SELECT r.id, string_agg(CAST(chunk_id AS VARCHAR), ',' ORDER BY distance, chunk_id) AS chunk_ids, CASE WHEN r.id IN (SELECT id FROM classed WHERE class = 'phantom') THEN 'false' ELSE 'true' END AS grounded, arg_min(r.code, (distance, chunk_id)) AS first_code FROM {v_retrieved} r GROUP BY r.id""",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
