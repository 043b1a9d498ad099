"""Queries C, D and E: catalogue, training sets, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import catalog as c
from quillmark.operators import evaluate as e
from quillmark.operators import retrieval as r
from quillmark.operators import trainset as t
from quillmark.plans import q_guard, q_retrieval
from quillmark.plans.q_clauses import indexed
from quillmark.plans.views import frame, sql, with_views

TITLED = """SELECT id, tenant_id, code, version, concat(CASE id % 6 WHEN 0 THEN 'Atención de Solicitudes Tecnológicas ' WHEN 1 THEN 'GESTION DE LA CALIDAD ' WHEN 2 THEN 'Seguridad y Salud ' WHEN 3 THEN 'Compra a Proveedores ' WHEN 4 THEN 'Auditoría interna ' ELSE 'Manual ' END, area) AS title,
    CASE id % 4 WHEN 0 THEN 'Tecnología' ELSE area END AS area, status, effective_date FROM {v_documents}"""
TOPICS = """SELECT p_partkey AS query_id, concat('tenant-', CAST(p_partkey % 4 AS STRING)) AS tenant_id, CASE p_partkey % 8 WHEN 0 THEN 'políticas de TI' WHEN 1 THEN 'procedimientos de compras' WHEN 2 THEN 'vacaciones src7' WHEN 3 THEN 'hay manuales sobre seguridad?' WHEN 4 THEN 'auditoria' WHEN 5 THEN concat('src', CAST(p_partkey % 20 AS STRING)) WHEN 6 THEN 'formato de viajes' ELSE ' ' END AS topic FROM {part}"""
REFERENCES = """SELECT p_partkey AS ref_id, concat('tenant-', CAST(p_partkey % 4 AS STRING)) AS tenant_id, CASE p_partkey % 4 WHEN 0 THEN concat('sti-pr-0', CAST(p_partkey % 10 AS STRING)) WHEN 1 THEN concat('interna src', CAST(p_partkey % 20 AS STRING)) WHEN 2 THEN 'STI' ELSE 'nada de esto' END AS reference FROM {part}"""
CLAUSES = "SELECT id, document_id, CASE WHEN id % 10 = 0 THEN NULL ELSE concat(section, CASE WHEN id % 3 = 0 THEN '.1' ELSE '' END) END AS section, content FROM {v_chunks}"
ASKED = "SELECT event_id AS ask_id, CAST(FLOOR(event_id / 10) AS BIGINT) AS document_id, CASE WHEN event_id % 2 = 0 THEN '1.' ELSE '2' END AS section FROM {events}"
CITES = "SELECT p_partkey AS ref_id, concat('tenant-', CAST(p_partkey % 4 AS STRING)) AS tenant_id, concat('segun STI-PR-0', CAST(p_partkey % 10 AS STRING), CASE WHEN p_partkey % 2 = 0 THEN ' y CAL-MN-01' ELSE '' END) AS reference FROM {part}"
BANK = "SELECT pregunta AS question FROM {v_faq} WHERE id % 50 = 0"
SOURCES = f"SELECT id AS pos, code, CAST(id % 3 AS STRING) AS section, version, title, concat('ver STI-PR-01 ', substr(title, 1, 20)) AS content FROM ({TITLED})"
ENTRIES = """SELECT id, concat(CASE id % 5 WHEN 0 THEN 'STI' WHEN 1 THEN 'CAL' WHEN 2 THEN 'COM' WHEN 3 THEN 'GTH' ELSE 'ZZZ' END, '-PR-0', CAST(id % 10 AS STRING)) AS codigo, CAST(id % 3 AS STRING) AS seccion, concat('¡', upper(pregunta), '!') AS question,
    concat('El plazo es ', CAST(id % 30 AS STRING), CASE WHEN id % 7 = 0 THEN ' segun QQQ-PR-77. ' ELSE '. ' END) AS respuesta FROM {v_faq}"""
REJECTED = "SELECT id, codigo AS code, seccion AS section, 'QQQ-PR-77, AAA-PO-1' AS phantoms, question, concat('Lo dice QQQ-PR-77 , y tambien AAA-PO-1.') AS answer FROM (" + ENTRIES + ")"
EXAMPLES = "SELECT id, family, grp, question, answer, is_call FROM {v_examples}"
ATTRIBUTED = """SELECT event_id AS id, concat('tenant-', CAST(user_id % 4 AS STRING)) AS tenant_id, CASE event_id % 4 WHEN 0 THEN 'Lo define el procedimiento de atencion de solicitudes tecnologicas.' WHEN 1 THEN 'Esta en el manual de compra a proveedores' WHEN 2 THEN 'atencion de solicitudes' ELSE 'Segun la politica de seguridad y salud' END AS answer FROM {events}"""
CASES = "SELECT event_id AS case_no, user_id AS conversation_id FROM {events}"
KNOWN = "SELECT DISTINCT code FROM {v_documents}"
PROMPTS = ["Quien aprueba {titulo}?", "Autoriza {titulo}", "Cambia {titulo} por favor"]


def V(name: str):  # noqa: N802
    return lambda s, d: frame(s, d, name)


def T(text: str):  # noqa: N802
    return lambda s, d: sql(s, d, text)


titled, clauses, examples = T(TITLED), T(CLAUSES), T(EXAMPLES)


def _found(s: SparkSession, d: str) -> DataFrame:
    return c.search(sql(s, d, TOPICS), titled(s, d))


def _offered(s: SparkSession, d: str) -> DataFrame:
    return c.suggestions(c.clause_index(clauses(s, d)), titled(s, d))


def _explicit(s: SparkSession, d: str) -> DataFrame:
    dominant = r.dominant(q_retrieval.retrieved(s, d).filter("verdict = 'accepted'")).select(F.col("query_id").alias("id"), "code")
    docs = frame(s, d, "v_documents").filter("status = 'vigente'").groupBy("code").agg(F.min("id").alias("document_id"))
    asked = sql(s, d, "SELECT query_id AS id, tenant_id, CASE WHEN query_id % 2 = 0 THEN query_id END AS read_document_id FROM {v_queries}")
    return c.suggestions_for(asked, dominant.join(docs, "code").select("id", "document_id"), _offered(s, d))


def _table(s: SparkSession, d: str) -> DataFrame:
    return t.clause_table(sql(s, d, SOURCES))


def _cited(s: SparkSession, d: str) -> DataFrame:
    return t.citation_family(sql(s, d, ENTRIES), _table(s, d), sql(s, d, BANK), sql(s, d, KNOWN))


def _phantom(s: SparkSession, d: str) -> DataFrame:
    return t.phantom_family(sql(s, d, REJECTED), _table(s, d), sql(s, d, BANK))


def _split(s: SparkSession, d: str) -> DataFrame:
    return t.split(examples(s, d), 0.1, 0.1)


def _flagged(s: SparkSession, d: str) -> DataFrame:
    return e.flags(frame(s, d, "v_eval"), sql(s, d, KNOWN))


QUERIES = {
    "C1_terms": lambda s, d: sql(s, d, TOPICS).select("query_id", c.terms(F.col("topic")).alias("x")).select("query_id", *(F.array_join(f"x.{k}", ",").alias(k) for k in ("kinds", "topics", "free"))),
    "C2_search": lambda s, d: _found(s, d).select("query_id", "place", "code", "version", "total"),
    "C3_unmatched": lambda s, d: c.unmatched(_found(s, d)),
    "C4_resolve": lambda s, d: c.resolve(sql(s, d, REFERENCES), titled(s, d)).select("ref_id", "outcome", "document_id", "options"),
    "C5_clause_index": lambda s, d: c.clause_index(clauses(s, d)),
    "C6_read_sections": lambda s, d: c.read_sections(sql(s, d, ASKED), clauses(s, d)),
    "C7_read_whole": lambda s, d: c.read_whole(clauses(s, d)),
    "C8_most_substantial": lambda s, d: c.most_substantial(clauses(s, d)),
    "C9_suggestions": _offered,
    "C10_suggestions_for": _explicit,
    "C11_capabilities": lambda s, d: c.capabilities(titled(s, d)).select("tenant_id", "in_force", F.array_join("areas", ",").alias("areas")),
    "C12_citable": lambda s, d: c.citable(clauses(s, d), titled(s, d)),
    "C13_clause_exists": lambda s, d: c.clause_exists(sql(s, d, CITES), titled(s, d)),
    "D1_clause_table": lambda s, d: _table(s, d).select("code", "section", "version", "title"),
    "D2_attribution": lambda s, d: _cited(s, d).filter("discarded IS NULL OR discarded LIKE 'cita%'").select("id", "answer"),
    "D3_citation_family": lambda s, d: _cited(s, d).select("id", "grp", "discarded"),
    "D4_phantom_family": lambda s, d: _phantom(s, d).select("id", "grp", "discarded", "answer"),
    "D5_prompted_family": lambda s, d: t.prompted_family(sql(s, d, "SELECT DISTINCT code, title FROM {v_documents}"), PROMPTS, "escalacion", "escalate_to_quality", 2),
    "D6_held_out": lambda s, d: t.held_out(sql(s, d, ENTRIES), sql(s, d, BANK)).select("id", "question"),
    "D7_capped": lambda s, d: t.capped(examples(s, d), "cita", 100).select("id", "family", "grp"),
    "D8_split": lambda s, d: _split(s, d).select("id", "family", "grp", "particion"),
    "D9_report": lambda s, d: t.report(_split(s, d)),
    "D10_profile": lambda s, d: t.profile(sql(s, d, "SELECT CASE WHEN id % 10 = 0 THEN 'valid' ELSE 'train' END AS particion, answer, is_call FROM {v_examples}")),
    "D11_prompt_lengths": lambda s, d: t.prompt_lengths(examples(s, d)),
    "D12_gold_messages": lambda s, d: t.gold_messages(sql(s, d, f"SELECT x.pos AS id, x.code, x.version, x.section, x.content, x.title AS question FROM ({SOURCES}) x"), F.when(F.col("id") % 3 == 0, "contexto").when(F.col("id") % 3 == 1, "sin_contexto").otherwise("memoria")).select("id", F.md5(F.array_join(F.transform("messages", lambda m: F.concat_ws(":", m["role"], m["content"])), "|")).alias("digest")),
    "E1_flags": lambda s, d: _flagged(s, d).select("case_no", *e.METRICS),
    "E2_percent": lambda s, d: _flagged(s, d).agg(F.round(e.percent(F.col("section")), 6).alias("section"), F.count("section").alias("n")),
    "E3_metrics": lambda s, d: e.metrics(_flagged(s, d)),
    "E4_failures": lambda s, d: e.failures(_flagged(s, d)),
    "E5_hit": lambda s, d: _flagged(s, d).select("case_no", "hit"),
    "E6_attribution": lambda s, d: e.attribution(sql(s, d, ATTRIBUTED), titled(s, d).filter("status = 'vigente'")).select("id", F.array_join("named", ",").alias("named")),
    "E7_obedience": lambda s, d: e.obedience(_flagged(s, d)),
    "E8_compare": lambda s, d: e.compare(_flagged(s, d), "base", "tuned"),
    "E9_states": lambda s, d: e.states(_flagged(s, d)),
    "E9_invented": lambda s, d: e.invented(_flagged(s, d)),
    "E10_traces": lambda s, d: e.attach_traces(sql(s, d, CASES), frame(s, d, "v_traces")),
}

Q = lambda xs: ", ".join(f"'{x}'" for x in xs)
KIND = "CASE w " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in c.KINDS.items()) + " END"
TERMS = f"""SELECT query_id, tenant_id, list_transform(list_filter(ws, lambda w: w IN ({Q(c.KINDS)})), lambda w: {KIND}) AS kinds, list_filter(ws, lambda w: w IN ({Q(c.TOPICS)}) AND w NOT IN ({Q(c.KINDS)})) AS topics,
    list_filter(ws, lambda w: w NOT IN ({Q([*c.KINDS, *c.TOPICS])}) AND length(w) > 2) AS free FROM (SELECT query_id, tenant_id, list_filter(string_split_regex(lower(topic), '[^\\p{{L}}\\p{{N}}_]+'), lambda w: w <> '' AND w NOT IN ({Q(c.WEIGHTLESS)})) AS ws FROM ({TOPICS}) WHERE trim(topic) <> '')"""
FORCE = f"SELECT *, lower(strip_accents(title)) AS t, lower(strip_accents(area)) AS a FROM ({TITLED}) WHERE status = 'vigente'"
TOPIC = "CASE k " + " ".join("WHEN '{}' THEN {}".format(k, " OR ".join([f"starts_with(code, '{p}-')"] * bool(p) + [x for v in w for x in [f"contains(t, '{v}')"] + [f"contains(a, '{v}')"] * bool(p)])) for k, (p, w) in c.TOPICS.items()) + " END"
SEARCH = f"""WITH q AS ({TERMS}), d AS ({FORCE}), p AS (SELECT q.*, d.id, d.code, d.version, d.t, d.a, len(list_filter(q.kinds, lambda k: contains(d.code, k))) > 0 AS of_kind, len(list_filter(q.topics, lambda k: {TOPIC})) > 0 AS of_topic,
    len(list_filter(q.free, lambda w: contains(d.t, lower(strip_accents(w))) OR contains(d.a, lower(strip_accents(w))) OR contains(lower(d.code), w))) > 0 AS of_free FROM q JOIN d ON d.tenant_id = q.tenant_id),
    f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY code, version, id) AS place, count(*) OVER (PARTITION BY query_id) AS total FROM p WHERE CASE WHEN len(kinds) > 0 OR len(topics) > 0 THEN (len(kinds) = 0 OR of_kind) AND (len(topics) = 0 OR of_topic) ELSE len(free) = 0 OR of_free END)"""
FORMAL = "regexp_matches(lower(regexp_replace(substr(content, 1, 90), '^\\s*\\d+(\\.\\d+)*\\.?\\s*', '')), '^(objetivo|alcance|documentos de referencia|abreviaturas|responsabilidad|control de cambios)')"
TABLE = f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY code, section ORDER BY pos DESC) AS place FROM ({SOURCES})) WHERE place = 1"
NORMAL = "trim(regexp_replace(lower(strip_accents(question)), '[^a-z0-9 ]', '', 'g'))"
BANKED = f"(SELECT DISTINCT {NORMAL} AS n FROM ({BANK}))"
EARLY = f"""WITH e AS (SELECT e.*, s.version, s.title, s.content, CASE WHEN s.code IS NULL THEN 'clausula no hallada' WHEN {NORMAL.replace('question', 'e.question')} IN (SELECT n FROM {BANKED}) THEN 'esta en el banco de pruebas' END AS early FROM ({ENTRIES}) e LEFT JOIN ({TABLE}) s ON s.code = e.codigo AND s.section = e.seccion)"""
FLAGGED = """WITH k AS (SELECT DISTINCT code FROM {v_documents}), c AS (SELECT *, list_distinct(regexp_extract_all(answer, '\\b[A-Z]{2,5}-[A-Z]{2,5}-\\d{1,3}\\b')) AS codes FROM {v_eval}),
    b AS (SELECT case_no, list_sort(list(code)) AS phantoms FROM (SELECT case_no, unnest(codes) AS code FROM c) u WHERE code NOT IN (SELECT code FROM k) GROUP BY case_no),
    f AS (SELECT c.*, coalesce(b.phantoms, []) AS phantoms, CASE WHEN expected_code IS NOT NULL THEN list_contains(codes, expected_code) END AS citation, CASE WHEN expected_section IS NOT NULL THEN contains(answer, expected_section) END AS section, CASE WHEN expected_tool IS NOT NULL THEN used_tool = expected_tool END AS tool,
      escalated = must_escalate AS escalation, b.phantoms IS NULL AS no_phantom, CASE WHEN expected_code IS NOT NULL THEN grounded END AS grounded_ok FROM c LEFT JOIN b ON b.case_no = c.case_no),
    flagged AS (SELECT *, coalesce(citation, true) AND coalesce(tool, true) AND escalation AND no_phantom AS hit FROM f)"""
#: The answer with its source, from respuesta, code, version, title, section and variant.
TITLED_WORDS = q_guard.WORDS
BASE = "concat(trim(regexp_replace(respuesta, '[. ]+$', '')), '.')"
NAMED = "concat(coalesce(CASE upper(split_part(split_part(code, ' (', 1), '-', 2)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in t.NAMES.items()) + " END, 'el documento'), ' ', trim(CASE WHEN upper(title) = title THEN concat(upper(substr(title, 1, 1)), lower(substr(title, 2))) ELSE title END))"
LEAD = f"({BASE} || [{Q(t.TEMPLATES)}][variant % 4 + 1] || {NAMED})"
AT = "(coalesce(', seccion ' || section, '') || '.')"
CITING = lambda text: rf"(contains(upper(regexp_replace({text}, '[\s_-]+', '', 'g')), upper(regexp_replace(code, '[\s_-]+', '', 'g'))) OR len(list_distinct(list_intersect({TITLED_WORDS}, regexp_extract_all(lower(strip_accents({text})), '[a-z0-9_]+')))) >= 2)"
ATTRIBUTION = f"CASE WHEN {CITING(f'({LEAD} || {AT})')} THEN {LEAD} || {AT} ELSE {LEAD} || ' (' || upper(split_part(code, ' (', 1)) || ' ' || version || ')' || {AT} END"
CITED = rf"""{EARLY}, v AS (SELECT id, codigo AS code, nullif(seccion, '-') AS section, seccion, question, respuesta, version, title, content, early, row_number() OVER (PARTITION BY codigo, seccion, early IS NULL ORDER BY id) - 1 AS variant FROM e),
    a AS (SELECT *, {ATTRIBUTION} AS answer FROM v), b AS (SELECT DISTINCT id FROM (SELECT id, content, unnest(regexp_extract_all(answer, {q_guard.CODES})) AS c FROM a WHERE early IS NULL) WHERE NOT list_contains(regexp_extract_all(content, {q_guard.CODES}), c) AND c NOT IN (SELECT code FROM {{v_documents}})),
    cited AS (SELECT a.id, a.answer, concat(code, '§', seccion) AS grp, coalesce(early, CASE WHEN NOT {CITING('answer')} THEN 'la atribucion no la reconoce el guardrail' END, CASE WHEN b.id IS NOT NULL THEN 'cita codigo inexistente' END) AS discarded FROM a LEFT JOIN b ON b.id = a.id)"""
PARTS = f"""WITH g AS (SELECT DISTINCT family, grp FROM ({EXAMPLES})), p AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY md5(concat('7:', grp)), grp) AS place, count(*) OVER (PARTITION BY family) AS n FROM g),
    h AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, CAST(round_even(n * CAST(0.1 AS DOUBLE), 0) AS INT)) ELSE 0 END AS share FROM p), k AS (SELECT grp, min(CASE WHEN place <= share THEN 1 WHEN place <= 2 * share THEN 2 ELSE 3 END) AS kind FROM h GROUP BY grp),
    parted AS (SELECT e.*, ['valid', 'test', 'train'][kind] AS particion FROM ({EXAMPLES}) e JOIN k ON k.grp = e.grp)"""
INDEX = f"{indexed(CLAUSES)}, idx AS (SELECT c.document_id, c.id AS chunk_id, c.section, t.title, t.has_title FROM ({CLAUSES}) c JOIN x_titles t ON t.id = c.id WHERE c.section IS NOT NULL)"
OFFERED = rf"""{INDEX}, any_titled AS (SELECT *, bool_or(has_title) OVER (PARTITION BY document_id) AS any_title FROM idx), placed AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY CAST(regexp_matches(lower(trim(title)), '^(objetivo|alcance|documentos de referencia|abreviaturas|responsabilidad|control de cambios)') AS INT), chunk_id) AS place FROM any_titled WHERE has_title OR NOT any_title),
    shown AS (SELECT p.*, d.code FROM placed p JOIN {{v_documents}} d ON d.id = p.document_id WHERE place <= 7),
    offered AS (SELECT document_id, place, CASE WHEN length(title) <= 38 THEN title ELSE concat(regexp_replace(substr(title, 1, 38), ' [^ ]*$', ''), '...') END AS label, concat('Del documento ', code, ', explicame la seccion ', section) AS message FROM shown
      UNION ALL SELECT document_id, max(place) + 1, 'Ver el documento completo', concat('Dame el resumen completo del documento ', code) FROM shown GROUP BY document_id, code)"""
PCT = lambda m: f"avg(CAST({m} AS INT)) * 100 AS {m}"

_SQL = {
    "C1_terms": f"SELECT query_id, array_to_string(kinds, ',') AS kinds, array_to_string(topics, ',') AS topics, array_to_string(free, ',') AS free FROM ({TERMS}) UNION ALL SELECT query_id, '', '', '' FROM ({TOPICS}) WHERE trim(topic) = ''",
    "C2_search": SEARCH + " SELECT query_id, place, code, version, total FROM f WHERE place <= 25",
    "C3_unmatched": SEARCH + ", u AS (SELECT query_id, unnest(free) AS term, lower(concat_ws(' ', code, t, a)) AS text FROM f WHERE place <= 25) SELECT query_id, term FROM u GROUP BY query_id, term HAVING NOT bool_or(contains(text, lower(strip_accents(term))))",
    "C4_resolve": f"""WITH d AS ({FORCE}), r AS (SELECT ref_id, tenant_id, trim(reference) AS reference FROM ({REFERENCES})), x AS (SELECT r.ref_id, d.id, d.code FROM r JOIN d ON d.tenant_id = r.tenant_id AND starts_with(lower(d.code), lower(r.reference))),
        y AS (SELECT * FROM x UNION ALL SELECT r.ref_id, d.id, d.code FROM r JOIN d ON d.tenant_id = r.tenant_id AND contains(d.t, lower(strip_accents(r.reference))) WHERE r.ref_id NOT IN (SELECT ref_id FROM x)),
        g AS (SELECT ref_id, count(*) AS n, min(id) AS document_id, array_to_string(list_sort(list(code))[1:10], ',') AS options FROM y GROUP BY ref_id)
        SELECT r.ref_id, CASE WHEN n IS NULL THEN 'not_found' WHEN n > 1 THEN 'ambiguous' ELSE 'found' END AS outcome, CASE WHEN n = 1 THEN document_id END AS document_id, CASE WHEN n > 1 THEN options END AS options FROM r LEFT JOIN g ON g.ref_id = r.ref_id""",
    "C6_read_sections": f"SELECT a.ask_id, c.id AS chunk_id, c.section FROM (SELECT ask_id, document_id, rtrim(section, '.') AS wanted FROM ({ASKED})) a JOIN ({CLAUSES}) c ON c.document_id = a.document_id AND (c.section = a.wanted OR starts_with(c.section, concat(a.wanted, '.')))",
    "C7_read_whole": f"WITH u AS (SELECT *, sum(length(content)) OVER (PARTITION BY document_id ORDER BY id) AS upto FROM ({CLAUSES})) SELECT document_id, count(*) FILTER (upto <= 24000) AS included, count(*) AS total, count(*) FILTER (upto <= 24000) < count(*) AS truncated FROM u GROUP BY document_id",
    "C8_most_substantial": f"""WITH n AS (SELECT document_id, id AS chunk_id, section, length(content) AS n FROM ({CLAUSES}) WHERE section IS NOT NULL AND NOT {FORMAL}), k AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY n DESC, chunk_id) AS rank FROM n), u AS (SELECT *, sum(n) OVER (PARTITION BY document_id ORDER BY n DESC, chunk_id) AS upto FROM k WHERE rank <= 4)
        SELECT document_id, chunk_id, section, row_number() OVER (PARTITION BY document_id ORDER BY chunk_id) AS place FROM u WHERE upto <= 9000""",
    "C5_clause_index": f"WITH {INDEX} SELECT * FROM idx",
    "C9_suggestions": f"WITH {OFFERED} SELECT document_id, place, label, message FROM offered",
    "C10_suggestions_for": f"""{q_retrieval.FOUND}, n AS (SELECT query_id, split_part(code, ' (', 1) AS code, count(*) AS n, min(distance) AS best FROM found WHERE verdict = 'accepted' GROUP BY ALL), p AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, best, code) AS place FROM n),
        main AS (SELECT p.query_id, min(d.id) AS document_id FROM p JOIN {{v_documents}} d ON d.code = p.code AND d.status = 'vigente' WHERE p.place = 1 AND p.n * 2 >= p.total GROUP BY p.query_id), {OFFERED},
        asked AS (SELECT q.query_id AS id, coalesce(CASE WHEN q.query_id % 2 = 0 THEN q.query_id END, m.document_id) AS document_id FROM {{v_queries}} q LEFT JOIN main m ON m.query_id = q.query_id) SELECT a.id, o.place, o.label FROM asked a JOIN offered o ON o.document_id = a.document_id""",
    "C11_capabilities": f"SELECT tenant_id, count(*) AS in_force, string_agg(DISTINCT area, ',' ORDER BY area) AS areas FROM ({TITLED}) WHERE status = 'vigente' GROUP BY tenant_id",
    "C12_citable": f"""SELECT * FROM (SELECT d.tenant_id, row_number() OVER (PARTITION BY d.tenant_id ORDER BY d.code, c.section, c.id) AS place, concat(d.code, ' ', d.version, ', seccion ', c.section) AS reference FROM ({CLAUSES}) c JOIN ({FORCE}) d ON d.id = c.document_id WHERE c.section IS NOT NULL) WHERE place <= 400""",
    "C13_clause_exists": f"SELECT DISTINCT r.ref_id FROM (SELECT ref_id, tenant_id, unnest(regexp_extract_all(reference, '\\b[A-Z]{{2,5}}-[A-Z]{{2,5}}-\\d{{1,3}}\\b')) AS code FROM ({CITES})) r JOIN ({FORCE}) d ON d.tenant_id = r.tenant_id AND d.code = r.code",
    "D1_clause_table": f"SELECT code, section, version, title FROM ({TABLE})",
    "D6_held_out": f"SELECT id, question FROM ({ENTRIES}) WHERE {NORMAL} NOT IN (SELECT n FROM {BANKED})",
    "D2_attribution": CITED + " SELECT id, answer FROM cited WHERE discarded IS NULL OR discarded LIKE 'cita%'",
    "D3_citation_family": CITED + " SELECT id, grp, discarded FROM cited",
    "D4_phantom_family": rf"""WITH r AS (SELECT r.*, s.version, s.title, {NORMAL.replace('question', 'r.question')} IN (SELECT n FROM {BANKED}) AS banked, trim(regexp_replace(regexp_replace(regexp_replace(r.answer, '\s*QQQ-PR-77\b', '', 'g'), '\s*AAA-PO-1\b', '', 'g'), '\s+([,.])', '\1', 'g')) AS respuesta, 0 AS variant
        FROM ({REJECTED}) r LEFT JOIN ({TABLE}) s ON s.code = r.code AND s.section = r.section), a AS (SELECT * EXCLUDE (answer), {ATTRIBUTION} AS answer FROM r)
        SELECT id, concat(code, '§', section) AS grp, answer, CASE WHEN banked THEN 'esta en el banco de pruebas' WHEN version IS NULL THEN 'clausula no hallada' WHEN contains(answer, 'QQQ-PR-77') OR contains(answer, 'AAA-PO-1') THEN 'no se pudo retirar el codigo fantasma' END AS discarded FROM a""",
    "D5_prompted_family": """WITH c AS (SELECT DISTINCT code, title FROM {v_documents}), e AS (SELECT code, title, 0 AS k, concat('Quien aprueba ', title, '?') AS question FROM c UNION ALL SELECT code, title, 1, concat('Autoriza ', title) FROM c UNION ALL SELECT code, title, 2, concat('Cambia ', title, ' por favor') FROM c),
        p AS (SELECT *, row_number() OVER (PARTITION BY code, title ORDER BY md5(concat_ws(':', '7', code, title, CAST(k AS VARCHAR))), k) AS place FROM e) SELECT 'escalacion' AS family, concat('escalacion:', code) AS grp, question, 'escalate_to_quality' AS tool FROM p WHERE place <= 2""",
    "D7_capped": f"""WITH g AS (SELECT grp, count(*) AS n FROM ({EXAMPLES}) WHERE family = 'cita' GROUP BY grp), k AS (SELECT grp, coalesce(sum(n) OVER (ORDER BY md5(concat('7:', grp)), grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM g)
        SELECT id, family, grp FROM ({EXAMPLES}) WHERE family <> 'cita' OR grp IN (SELECT grp FROM k WHERE earlier < 100)""",
    "D8_split": PARTS + " SELECT id, family, grp, particion FROM parted",
    "D9_report": PARTS + " SELECT particion, family, count(*) AS examples, count(DISTINCT grp) AS groups FROM parted GROUP BY particion, family",
    "D10_profile": """SELECT CASE WHEN id % 10 = 0 THEN 'valid' ELSE 'train' END AS particion, count(*) FILTER (is_call) AS tool_call, count(*) FILTER (NOT is_call) AS texto, median(length(answer)) AS median_chars, max(length(answer)) AS max_chars,
        count(*) FILTER (length(answer) < 20) AS below_20, count(*) FILTER (length(answer) BETWEEN 20 AND 24) AS from_20, count(*) FILTER (length(answer) > 24) AS above_24 FROM {v_examples} GROUP BY 1""",
    "D11_prompt_lengths": "SELECT family, avg(length(question)) AS mean_chars, median(length(question)) AS median_chars FROM {v_examples} GROUP BY family",
    "D12_gold_messages": f"""SELECT pos AS id, md5(concat('system:Eres el asistente.', CASE pos % 3 WHEN 0 THEN concat(chr(10), chr(10), 'Fragmentos VIGENTES recuperados:', chr(10), chr(10), '[Fragmento 1] Documento: ', code, ' ', version, ' | Seccion: ', section, chr(10), content) WHEN 1 THEN concat(chr(10), chr(10), 'No se recupero ningun fragmento. No inventes.') ELSE '' END, '|user:', title)) AS digest FROM ({SOURCES})""",
    "E1_flags": FLAGGED + " SELECT case_no, citation, section, tool, escalation, no_phantom, grounded_ok FROM flagged",
    "E2_percent": FLAGGED + " SELECT round(avg(CAST(section AS INT)) * 100, 6) AS section, count(section) AS n FROM flagged",
    "E3_metrics": FLAGGED + f" SELECT model, {', '.join(PCT(m) for m in e.METRICS)}, {PCT('hit')}, median(latency) AS median_latency, max(latency) AS max_latency FROM flagged GROUP BY model",
    "E4_failures": FLAGGED + """, w AS (SELECT case_no, model, list_filter([CASE WHEN NOT citation THEN concat('esperaba ', expected_code) END, CASE WHEN NOT tool THEN concat('no uso ', expected_tool) END, CASE WHEN NOT escalation THEN 'escalacion' END, CASE WHEN NOT no_phantom THEN concat('CITA INVENTADA: ', array_to_string(phantoms, ',')) END], lambda r: r IS NOT NULL) AS reasons FROM flagged)
        SELECT case_no, model, array_to_string(reasons, '; ') AS reasons FROM w WHERE len(reasons) > 0""",
    "E5_hit": FLAGGED + " SELECT case_no, hit FROM flagged",
    "E6_attribution": rf"""WITH a AS ({ATTRIBUTED}), d AS (SELECT DISTINCT tenant_id, answer FROM a WHERE regexp_matches(lower(strip_accents(answer)), '{e.CONNECTOR}')), f AS (SELECT DISTINCT tenant_id, code, title FROM ({FORCE})),
        m AS (SELECT d.tenant_id, d.answer, string_agg(DISTINCT f.code, ',' ORDER BY f.code) AS named FROM d JOIN f ON f.tenant_id = d.tenant_id WHERE len(list_distinct(list_intersect({TITLED_WORDS}, regexp_extract_all(lower(strip_accents(answer)), '[a-z0-9_]+')))) >= 2 GROUP BY d.tenant_id, d.answer)
        SELECT a.id, coalesce(m.named, '') AS named FROM a LEFT JOIN m ON m.tenant_id = a.tenant_id AND m.answer = a.answer""",
    "E7_obedience": FLAGGED + r", g AS (SELECT *, answer <> '' AND NOT starts_with(answer, '(error') AS good FROM flagged) SELECT model, avg(CAST(hit AS INT)) * 100 AS hit, avg(CASE WHEN good THEN CAST(len(codes) = 0 AS INT) END) * 100 AS without_code, avg(CASE WHEN good THEN CAST(NOT regexp_matches(answer, '(?i)^\s*(seg[uúÚ]n|de acuerdo)') AS INT) END) * 100 AS answer_first, median(CASE WHEN good THEN length(answer) END) AS median_chars FROM g GROUP BY model",
    "E8_compare": FLAGGED + " SELECT a.question, a.hit AS hit_a, b.hit AS hit_b FROM flagged a JOIN flagged b ON b.question = a.question AND a.model = 'base' AND b.model = 'tuned'",
    "E9_states": FLAGGED + " SELECT question, max(CASE WHEN model = 'base' THEN CAST(hit AS INT) END) AS base, max(CASE WHEN model = 'rag' THEN CAST(hit AS INT) END) AS rag, max(CASE WHEN model = 'tuned' THEN CAST(hit AS INT) END) AS tuned FROM flagged GROUP BY question",
    "E9_invented": FLAGGED + " SELECT model, code, count(*) AS n FROM (SELECT model, unnest(phantoms) AS code FROM flagged) GROUP BY model, code",
    "E10_traces": f"""WITH l AS (SELECT conversation_id, arg_max(trace, id) AS trace FROM {{v_traces}} WHERE role = 'assistant' GROUP BY conversation_id) SELECT c.case_no, c.conversation_id, CASE WHEN l.trace IS NOT NULL THEN array_to_string(CAST(json_extract(l.trace, '$.tools') AS VARCHAR[]), ',') END AS tools, json_extract_string(l.trace, '$.grounded') AS grounded FROM ({CASES}) c LEFT JOIN l ON l.conversation_id = c.conversation_id""",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
