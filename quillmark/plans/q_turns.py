"""Queries M: turns and transcripts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.text import normal_turn
from quillmark.operators import guardrails as g
from quillmark.operators import routing as r
from quillmark.operators import transcripts as t
from quillmark.plans.views import frame, sql, with_views

OFFERED = f"SELECT id, conversation_id, role, CASE WHEN role = 'assistant' AND id % 3 <> 0 THEN concat('No lo tengo. ', '{g.OFFER}') ELSE content END AS content FROM {{v_turns}}"
PROPOSED = "SELECT id, conversation_id % 100 AS conversation_id, status FROM {v_escalations}"
CHANNELS = "SELECT concat('tenant-', CAST(conversation_id % 4 AS STRING)) AS tenant_id, CASE WHEN conversation_id % 2 = 0 THEN 'web' ELSE 'chat' END AS channel, CAST(conversation_id AS STRING) AS external_user_id FROM {v_messages}"
PROMPTS = """SELECT m.id, CASE WHEN m.id % 2 = 0 THEN 'Eres el asistente.' END AS system_prompt, CASE WHEN m.id % 3 = 0 THEN 'P: ? R: .' END AS faq_block, CASE WHEN m.id % 5 <> 0 THEN 'Fragmento' END AS context_block,
    array(named_struct('role', 'assistant', 'content', 'antes')) AS history, m.content, m.id % 7 = 0 AS produces FROM {v_messages} m"""
LEAKS = """SELECT event_id AS id, CASE event_id % 9 WHEN 0 THEN concat('<tool_call>{"name":"buscar_documentos","arguments":{"tema":"', event_type, '"}}</tool_call>') WHEN 1 THEN concat('Claro.', chr(10), 'escalate_to_quality', chr(10), 'Motivo: ', event_type, chr(10), 'Listo, derivado.')
    WHEN 2 THEN concat('get_capa_status: {"finding_id": ', CAST(user_id AS STRING), '}') WHEN 3 THEN '```json {"name":"no_existe","arguments":{}} ```' WHEN 4 THEN concat('<think>dudo', chr(10), 'mucho</think> Es ', event_type) WHEN 5 THEN concat('register_finding: se registro ', event_type)
    WHEN 6 THEN concat('{"name":"leer_documento","arguments":{"documento":"', event_type, '"}}') WHEN 7 THEN props ELSE event_type END AS text FROM {events}"""
ARGUMENTS = """SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN 'buscar_documentos' WHEN 1 THEN 'get_capa_status' WHEN 2 THEN 'register_finding' WHEN 3 THEN 'borrar_todo' ELSE 'registrar_accion_correctiva' END AS name,
    CASE event_id % 7 WHEN 0 THEN '{"tema":"x","finding_id":"7","description":"d"}' WHEN 1 THEN '{"finding_id":"siete","description":" "}' WHEN 2 THEN '[1]' WHEN 3 THEN '' WHEN 4 THEN '{"finding_id":12}' WHEN 5 THEN props ELSE 'no es json' END AS arguments FROM {events}"""
SCENES = """SELECT p_partkey AS id, concat('tenant-', CAST(p_partkey % 4 AS STRING)) AS tenant_id, concat(CASE p_partkey % 6 WHEN 0 THEN 'Un operario con armas y ' WHEN 1 THEN 'An infographic poster of ' WHEN 2 THEN 'worker checking a list near ' WHEN 3 THEN 'morning building ' WHEN 4 THEN 'la caja con guantes de ' ELSE '' END, p_name) AS description,
    CASE p_partkey % 3 WHEN 0 THEN concat('STI-PR-0', CAST(p_partkey % 10 AS STRING), ' seccion 2') WHEN 1 THEN 'sin codigo' ELSE 'QQQ-PR-01' END AS clause FROM {part}"""
NORMAL = r"""trim(regexp_replace(lower(strip_accents(regexp_replace(content, '^[!¡?¿.,;:\s]+|[!¡?¿.,;:\s]+$', '', 'g'))), '\s+', ' ', 'g'))"""
QUOTED = lambda xs: ", ".join(f"'{x}'" for x in xs)
SOCIAL = f"""SELECT *, CASE WHEN n <> '' AND length(n) <= 45 AND len(p) > 0 AND len(list_filter(p, lambda s: s NOT IN ({QUOTED([*r.GREETINGS, *r.COURTESY, *r.FAREWELLS])}))) = 0
    THEN CASE WHEN p[-1] IN ({QUOTED(r.FAREWELLS)}) THEN 'despedida' WHEN p[-1] IN ({QUOTED(r.COURTESY)}) THEN 'cortesia' ELSE 'saludo' END END AS social
    FROM (SELECT *, list_filter(string_split_regex(n, '\\s*(?:,|\\.|;|\\by\\b)\\s*'), lambda s: s <> '') AS p FROM (SELECT *, {NORMAL} AS n FROM {{v_turns}}))"""
HAS = lambda ps: f"regexp_matches(n, '{'|'.join(ps)}')"
CLASSED = f"""SELECT id, CASE WHEN social IS NOT NULL THEN 'social' WHEN n = '' OR (regexp_matches(n, '\\b[a-z]{{2,5}}-[a-z]{{2,5}}-\\d{{1,3}}\\b') AND NOT {HAS(r.PRODUCTION)}) THEN 'documental' WHEN {HAS(r.PRODUCTION)} THEN 'produccion' WHEN {HAS(r.META)} THEN 'meta'
    WHEN {HAS(r.INJECTION)} THEN 'documental' WHEN {HAS(r.INSTRUCTION)} THEN 'conversacional' WHEN previous AND length(n) <= 70 AND ({HAS(r.FOLLOW_CLEAR)} OR ({HAS(r.FOLLOW_WEAK)} AND NOT {HAS((r.DOMAIN,))})) THEN 'conversacional' ELSE 'documental' END AS kind
    FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id) > 1 AS previous FROM ({SOCIAL}))"""
#: The consent of a normal text n.
CONSENT = f"""CASE WHEN n <> '' AND length(n) <= 64 AND regexp_matches(trim(regexp_replace(regexp_replace(n, '[,;.!?]+', ' ', 'g'), '\\s+', ' ', 'g')), '{r.YES}') THEN true
    WHEN n <> '' AND length(n) <= 64 AND regexp_matches(trim(regexp_replace(regexp_replace(n, '[,;.!?]+', ' ', 'g'), '\\s+', ' ', 'g')), '{r.NO}') THEN false END"""


def _turns(s: SparkSession, d: str) -> DataFrame:
    return frame(s, d, "v_turns")


def _leaks(s: SparkSession, d: str) -> DataFrame:
    return sql(s, d, LEAKS)


def _prompts(s: SparkSession, d: str) -> DataFrame:
    return r.prompts(sql(s, d, PROMPTS), "Asistente por defecto.", "2026-01-01")


def _calls(s: SparkSession, d: str) -> DataFrame:
    a = sql(s, d, ARGUMENTS)
    m, bad = t.parsed_arguments(F.col("arguments"))
    return a.select("id", "name", m.alias("m"), bad.alias("bad"))


QUERIES = {
    "M1_normal_turn": lambda s, d: _turns(s, d).select("id", normal_turn(F.col("content")).alias("n")),
    "M2_social": lambda s, d: _turns(s, d).select("id", r.social_class(F.col("content")).alias("social")),
    "M3_turn_class": lambda s, d: r.with_previous(_turns(s, d)).select("id", r.turn_class(F.col("content"), F.col("has_previous")).alias("kind")),
    "M4_social_reply": lambda s, d: r.social_replies(_turns(s, d)).select("id", "social", F.substring("reply", 1, 12).alias("reply")),
    "M5_consent": lambda s, d: _turns(s, d).select("id", r.consent(F.col("content")).alias("consent")),
    "M6_resolve_consent": lambda s, d: r.resolve_consent(sql(s, d, OFFERED), sql(s, d, PROPOSED)),
    "M7_useful_question": lambda s, d: r.useful_questions(_turns(s, d)),
    "M8_history": lambda s, d: r.history(_turns(s, d)).select("conversation_id", "id", "place"),
    "M9_conversations": lambda s, d: r.new_conversations(sql(s, d, CHANNELS), sql(s, d, CHANNELS + " WHERE conversation_id % 3 = 0")),
    "M10_prompt": lambda s, d: _prompts(s, d).select("id", F.size("messages").alias("n"), F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"), F.md5(F.array_join(F.transform("messages", lambda m: m["content"]), "|")).alias("digest")),
    "M11_merge_system": lambda s, d: _prompts(s, d).select("id", t.merge_system(F.col("messages")).alias("m")).select("id", F.array_join(F.transform("m", lambda m: m["role"]), ",").alias("roles"), F.length(F.col("m")[0]["content"]).alias("n")),
    "M12_reasoning": lambda s, d: _leaks(s, d).select("id", t.strip_reasoning(F.col("text")).alias("text")),
    "M13_recovered_call": lambda s, d: _leaks(s, d).select("id", t.recovered_call(F.col("text")).alias("c")).select("id", "c.name"),
    "M14_tool_prefix": lambda s, d: _leaks(s, d).select("id", t.strip_tool_prefix(F.col("text")).alias("text")),
    "M14_leaks": lambda s, d: _leaks(s, d).select("id", t.split_leaks(F.col("text")).alias("x")).select("id", "x.text", F.array_join("x.mentioned", ",").alias("mentioned")),
    "M15_arguments": lambda s, d: _calls(s, d).select("id", F.array_join(F.array_sort(F.map_keys("m")), ",").alias("keys"), "bad"),
    "M16_call_check": lambda s, d: _calls(s, d).select("id", t.call_error(F.col("name"), F.col("m")).alias("error")),
    "M17_native_calls": lambda s, d: sql(s, d, "SELECT event_id AS id, array(named_struct('name', event_type, 'arguments', props)) AS calls FROM {events}").select("id", t.native_calls(F.col("calls")).alias("c")).select("id", F.col("c")[0]["tool_name"].alias("tool_name"), F.col("c")[0]["arguments"]["k"].alias("k")),
    "M18_banned": lambda s, d: sql(s, d, SCENES).select("id", F.array_join(r.banned_terms(F.col("description")), ",").alias("terms")),
    "M19_lettered": lambda s, d: sql(s, d, SCENES).select("id", F.array_join(r.lettered_terms(F.col("description")), ",").alias("terms")),
    "M20_looks_spanish": lambda s, d: sql(s, d, SCENES).select("id", r.looks_spanish(F.col("description")).alias("spanish")),
    "M21_has_action": lambda s, d: sql(s, d, SCENES).select("id", r.has_action(F.col("description")).alias("action")),
    "M22_material": lambda s, d: r.validate_material(sql(s, d, SCENES), frame(s, d, "v_documents")).select("id", "error"),
}

_SQL = {
    "M1_normal_turn": f"SELECT id, {NORMAL} AS n FROM {{v_turns}}",
    "M2_social": f"SELECT id, social FROM ({SOCIAL})",
    "M3_turn_class": CLASSED,
    "M4_social_reply": f"""SELECT id, social, substr(CASE WHEN social = 'saludo' AND coalesce(bool_or(social = 'saludo') OVER (PARTITION BY conversation_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) THEN 'Aquí sigo. Dime' WHEN social = 'saludo' THEN '¡Hola! Respondo' WHEN social = 'cortesia' THEN '¡A ti! Si te surge' WHEN social = 'despedida' THEN 'Hasta luego. Vuelve' END, 1, 12) AS reply FROM ({SOCIAL})""",
    "M5_consent": f"SELECT id, {CONSENT} AS consent FROM (SELECT id, {NORMAL} AS n FROM {{v_turns}})",
    "M6_resolve_consent": f"""WITH o AS ({OFFERED}), w AS (SELECT *, {NORMAL} AS n, last_value(CASE WHEN role = 'assistant' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o),
        a AS (SELECT id, conversation_id, {CONSENT} AS yes FROM w WHERE role = 'user' AND rtrim(last) LIKE '%{g.OFFER}'), p AS (SELECT conversation_id, max(id) AS escalation_id FROM ({PROPOSED}) WHERE status = 'propuesta' GROUP BY conversation_id)
        SELECT a.id, p.escalation_id, CASE WHEN yes THEN 'pendiente' ELSE 'descartada' END AS status FROM a JOIN p ON p.conversation_id = a.conversation_id WHERE yes IS NOT NULL""",
    "M6_consent_stream": f"""WITH o AS ({OFFERED}), w AS (SELECT *, {NORMAL} AS n, last_value(CASE WHEN role = 'assistant' THEN content END IGNORE NULLS) OVER (PARTITION BY conversation_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM o),
        a AS (SELECT id, {CONSENT} AS accepted FROM w WHERE role = 'user' AND rtrim(last) LIKE '%{g.OFFER}') SELECT id, accepted FROM a WHERE accepted IS NOT NULL""",
    "M7_useful_question": f"""WITH u AS (SELECT id, conversation_id, trim(content) AS text, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS k, {CONSENT} AS yes FROM (SELECT *, {NORMAL} AS n FROM {{v_turns}} WHERE role = 'user')),
        b AS (SELECT u.id, arg_max(v.text, v.k) AS back FROM u JOIN u v ON v.conversation_id = u.conversation_id AND v.k < u.k AND v.k >= u.k - 6 AND v.yes IS NULL AND v.text <> '' AND v.text <> u.text GROUP BY u.id)
        SELECT u.id, CASE WHEN u.text <> '' AND u.yes IS NULL THEN u.text ELSE coalesce(b.back, nullif(u.text, ''), '(sin registrar)') END AS question FROM u LEFT JOIN b ON b.id = u.id""",
    "M8_history": "WITH b AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY id DESC) AS back FROM {v_turns}) SELECT conversation_id, id, row_number() OVER (PARTITION BY conversation_id ORDER BY id) AS place FROM b WHERE back <= 6",
    "M9_conversations": f"SELECT DISTINCT * FROM ({CHANNELS}) WHERE CAST(external_user_id AS BIGINT) % 3 <> 0",
    "M10_prompt": """WITH p AS (SELECT id, content, concat_ws(',', 'system', CASE WHEN id % 3 = 0 THEN 'system' END, 'system', CASE WHEN id % 7 = 0 THEN 'system' END, 'assistant', 'user') AS roles,
        concat_ws('|', CASE WHEN id % 2 = 0 THEN 'Eres el asistente.' ELSE 'Asistente por defecto.' END, CASE WHEN id % 3 = 0 THEN concat('Preguntas frecuentes parecidas:', chr(10), chr(10), 'P: ? R: .') END, concat(CASE WHEN id % 5 = 0 THEN 'No se recupero ningun fragmento. No inventes.' ELSE concat('Fragmentos VIGENTES recuperados:', chr(10), chr(10), 'Fragmento') END,
          chr(10), chr(10), 'Recuerda: no apruebas ni modificas documentos. HOY es 2026-01-01.'), CASE WHEN id % 7 = 0 THEN 'Se pide producir material visual.' END, 'antes', content) AS body FROM {v_messages}) SELECT id, len(string_split(roles, ',')) AS n, roles, md5(body) AS digest FROM p""",
    "M11_merge_system": """SELECT id, 'system,assistant,user' AS roles, length(concat_ws(concat(chr(10), chr(10)), CASE WHEN id % 2 = 0 THEN 'Eres el asistente.' ELSE 'Asistente por defecto.' END, CASE WHEN id % 3 = 0 THEN concat('Preguntas frecuentes parecidas:', chr(10), chr(10), 'P: ? R: .') END,
          CASE WHEN id % 5 = 0 THEN 'No se recupero ningun fragmento. No inventes.' ELSE concat('Fragmentos VIGENTES recuperados:', chr(10), chr(10), 'Fragmento') END, 'Recuerda: no apruebas ni modificas documentos. HOY es 2026-01-01.', CASE WHEN id % 7 = 0 THEN 'Se pide producir material visual.' END)) AS n FROM {v_messages}""",
    "M12_reasoning": f"SELECT id, trim(regexp_replace(text, '(?is)<think>.*?</think>', '', 'g')) AS text FROM ({LEAKS})",
    "M13_recovered_call": f"SELECT id, CASE id % 9 WHEN 0 THEN 'buscar_documentos' WHEN 2 THEN 'get_capa_status' WHEN 6 THEN 'leer_documento' END AS name FROM ({LEAKS})",
    "M14_tool_prefix": rf"SELECT id, trim(regexp_replace(text, '(?i)^\s*(?:<tool_call>|```json|```)?\s*(?:{t.NAMES})\s*[:\-–]\s*', '')) AS text FROM ({LEAKS})",
    "M14_leaks": f"SELECT id, CASE id % 9 WHEN 1 THEN concat('Claro.', chr(10), 'Listo, derivado.') WHEN 2 THEN '' WHEN 5 THEN '' ELSE text END AS text, CASE id % 9 WHEN 1 THEN 'escalate_to_quality' WHEN 2 THEN 'get_capa_status' WHEN 5 THEN 'register_finding' ELSE '' END AS mentioned FROM ({LEAKS})",
    "M15_arguments": f"SELECT id, CASE id % 7 WHEN 0 THEN 'description,finding_id,tema' WHEN 1 THEN 'description,finding_id' WHEN 4 THEN 'finding_id' WHEN 5 THEN 'k' ELSE '' END AS keys, id % 7 IN (2, 6) AS bad FROM ({ARGUMENTS})",
    "M16_call_check": f"""SELECT id, CASE WHEN name = 'borrar_todo' THEN 'unknown_tool' WHEN name = 'buscar_documentos' AND id % 7 <> 0 THEN 'invalid_arguments' WHEN name = 'get_capa_status' AND id % 7 NOT IN (0, 4) THEN 'invalid_arguments' WHEN name = 'register_finding' AND id % 7 <> 0 THEN 'invalid_arguments' WHEN name = 'registrar_accion_correctiva' AND id % 7 <> 0 THEN 'invalid_arguments' END AS error FROM ({ARGUMENTS})""",
    "M17_native_calls": "SELECT event_id AS id, event_type AS tool_name, json_extract_string(props, '$.k') AS k FROM {events}",
    "M18_banned": f"SELECT id, CASE WHEN id % 6 = 0 THEN 'armas' ELSE '' END AS terms FROM ({SCENES})",
    "M19_lettered": f"SELECT id, CASE WHEN id % 6 = 1 THEN 'infographic,poster' ELSE '' END AS terms FROM ({SCENES})",
    "M20_looks_spanish": f"SELECT id, regexp_matches(lower(description), '[áéíóúñ¿¡]') OR len(list_intersect(regexp_extract_all(lower(description), '[a-záéíóúñ]+'), [{QUOTED(r.SPANISH)}])) >= 2 AS spanish FROM ({SCENES})",
    "M21_has_action": f"SELECT id, len(list_filter(string_split_regex(description, '\\s+'), lambda w: lower(w) LIKE '%ing' AND lower(w) NOT IN ({QUOTED(r.ING_NOUNS)}))) > 0 AS action FROM ({SCENES})",
    "M22_material": f"""SELECT q.id, CASE WHEN q.id % 6 = 0 THEN 'fuera_de_alcance' WHEN q.id % 6 = 1 THEN 'pide_texto' WHEN q.id % 3 = 1 THEN 'sin_respaldo' WHEN NOT EXISTS (SELECT 1 FROM {{v_documents}} d WHERE d.tenant_id = q.tenant_id AND d.status = 'vigente' AND d.code = regexp_extract(q.clause, '[A-Z]{{3}}-[A-Z]{{2}}-\\d{{2}}')) THEN 'codigo_inexistente' END AS error FROM ({SCENES}) q""",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
