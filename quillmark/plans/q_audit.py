"""Queries A and L9-L16: audit reports and roll-ups, as SQL that both engines run. Traces are JSON."""

from __future__ import annotations

from quillmark.plans.views import sql, with_views

#: (Spark SQL, DuckDB SQL or None where the same text serves)
_SQL: dict[str, tuple[str, str | None]] = {
    "A1_overview": ("""SELECT (SELECT count(*) FROM {v_documents}) AS documents, (SELECT count(*) FROM {v_documents} WHERE status = 'vigente') AS in_force, (SELECT count(*) FROM {v_chunks}) AS chunks,
        (SELECT count(DISTINCT conversation_id) FROM {v_messages}) AS conversations, (SELECT count(*) FROM {v_messages}) AS messages, (SELECT count(*) FROM {v_findings}) AS findings""", None),
    "A2_by_area": ("""SELECT d.area, count(*) AS documents, count(*) FILTER (WHERE d.status = 'vigente') AS in_force, CAST(sum(coalesce(c.n, 0)) AS BIGINT) AS chunks
        FROM {v_documents} d LEFT JOIN (SELECT document_id, count(*) AS n FROM {v_chunks} GROUP BY document_id) c ON c.document_id = d.id GROUP BY d.area""", None),
    "A3_few_chunks": ("SELECT d.id, d.code, d.version, d.title, count(c.id) AS chunks FROM {v_documents} d LEFT JOIN {v_chunks} c ON c.document_id = d.id GROUP BY d.id, d.code, d.version, d.title HAVING count(c.id) <= 2", None),
    "A4_indexed_text": ("SELECT c.id, c.section, substr(c.content, 1, 300) AS content FROM {v_chunks} c JOIN {v_documents} d ON d.id = c.document_id WHERE d.code = 'STI-PR-01'", None),
    "A5_with_tables": ("SELECT c.id, d.code, c.section, substr(c.content, 1, 200) AS content FROM {v_chunks} c JOIN {v_documents} d ON d.id = c.document_id WHERE c.content LIKE '%|%' ORDER BY d.code, c.id LIMIT 30", None),
    "A6_last_answers": ("""SELECT id, created_at, substr(content, 1, 90) AS answer, get_json_object(trace, '$.grounded') AS grounded, get_json_object(trace, '$.escalate') AS escalated, CAST(get_json_object(trace, '$.elapsed_ms') AS BIGINT) AS ms
        FROM {v_traces} WHERE role = 'assistant' ORDER BY created_at DESC, id DESC LIMIT 20""",
        """SELECT id, created_at, substr(content, 1, 90) AS answer, json_extract_string(trace, '$.grounded') AS grounded, json_extract_string(trace, '$.escalate') AS escalated, CAST(json_extract_string(trace, '$.elapsed_ms') AS BIGINT) AS ms
        FROM {v_traces} WHERE role = 'assistant' ORDER BY created_at DESC, id DESC LIMIT 20"""),
    "A7_sources": ("""SELECT id, f.code, f.version, f.section, f.distance FROM (SELECT id, explode(from_json(get_json_object(trace, '$.retrieval.accepted'), 'array<struct<code:string,version:string,section:string,distance:double>>')) AS f FROM {v_traces} WHERE role = 'assistant')""",
        """SELECT id, f->>'code' AS code, f->>'version' AS version, f->>'section' AS section, CAST(f->>'distance' AS DOUBLE) AS distance FROM (SELECT id, unnest(json_extract(trace, '$.retrieval.accepted[*]')) AS f FROM {v_traces} WHERE role = 'assistant')"""),
    "A8_ungrounded": ("SELECT id, created_at, substr(content, 1, 120) AS answer FROM {v_traces} WHERE role = 'assistant' AND get_json_object(trace, '$.grounded') = 'false'",
        "SELECT id, created_at, substr(content, 1, 120) AS answer FROM {v_traces} WHERE role = 'assistant' AND json_extract_string(trace, '$.grounded') = 'false'"),
    "A9_unanswered": ("SELECT u.id, u.content AS question FROM {v_traces} u JOIN {v_traces} a ON a.id = u.id + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND get_json_object(a.trace, '$.escalate') = 'true'",
        "SELECT u.id, u.content AS question FROM {v_traces} u JOIN {v_traces} a ON a.id = u.id + 1 AND a.role = 'assistant' WHERE u.role = 'user' AND json_extract_string(a.trace, '$.escalate') = 'true'"),
    "A10_conversation": ("SELECT id, role, content FROM {v_messages} WHERE conversation_id = 7", None),
    "A11_mean_distance": ("""SELECT round(avg(f.distance), 4) AS mean_distance, count(*) AS sources FROM (SELECT explode(from_json(get_json_object(trace, '$.retrieval.accepted'), 'array<struct<distance:double>>')) AS f FROM {v_traces} WHERE role = 'assistant')""",
        """SELECT round(avg(CAST(f->>'distance' AS DOUBLE)), 4) AS mean_distance, count(*) AS sources FROM (SELECT unnest(json_extract(trace, '$.retrieval.accepted[*]')) AS f FROM {v_traces} WHERE role = 'assistant')"""),
    "A12_findings": ("SELECT f.id, f.description, f.status, f.created_at, count(a.id) AS actions FROM {v_findings} f LEFT JOIN {v_capa} a ON a.finding_id = f.id GROUP BY f.id, f.description, f.status, f.created_at", None),
    "A14_two_in_force": ("SELECT tenant_id, code, array_join(sort_array(collect_list(version)), ',') AS versions FROM {v_documents} WHERE status = 'vigente' GROUP BY tenant_id, code HAVING count(*) > 1",
        "SELECT tenant_id, code, string_agg(version, ',' ORDER BY version) AS versions FROM {v_documents} WHERE status = 'vigente' GROUP BY tenant_id, code HAVING count(*) > 1"),
    "A15_obsolete": ("SELECT code, version, title, effective_date FROM {v_documents} WHERE status = 'obsoleto'", None),
    "L9_escalation_inbox": ("""SELECT id, tenant_id, cause, status, created_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS place FROM {v_escalations} WHERE status <> 'propuesta') WHERE place <= 50""", None),
    "L9_escalation_counts": ("""SELECT tenant_id, count(*) FILTER (WHERE status = 'pendiente') AS pending, count(*) FILTER (WHERE status = 'en_revision') AS in_review, count(*) FILTER (WHERE status = 'resuelta') AS resolved,
        count(*) FILTER (WHERE status = 'descartada') AS discarded, count(*) FILTER (WHERE status = 'propuesta') AS offered FROM {v_escalations} GROUP BY tenant_id""", None),
    "L11_open_without_action": ("SELECT f.tenant_id, count(*) AS open_without_action FROM {v_findings} f LEFT ANTI JOIN {v_capa} a ON a.finding_id = f.id WHERE f.status <> 'cerrado' GROUP BY f.tenant_id",
        "SELECT f.tenant_id, count(*) AS open_without_action FROM {v_findings} f ANTI JOIN {v_capa} a ON a.finding_id = f.id WHERE f.status <> 'cerrado' GROUP BY f.tenant_id"),
    "L11_finding_counts": ("SELECT tenant_id, status, severity, count(*) AS n FROM {v_findings} GROUP BY tenant_id, status, severity", None),
    "L12_incident_list": ("""SELECT concat('INC-', lpad(CAST(id AS STRING), 5, '0')) AS reference, tenant_id, created_at FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id ORDER BY created_at DESC, id DESC) AS place FROM {v_escalations} WHERE cause = 'error') WHERE place <= 20""", None),
    "L13_status": ("""WITH d AS (SELECT tenant_id, count(*) FILTER (WHERE status = 'vigente') AS in_force, count(*) FILTER (WHERE status = 'obsoleto') AS obsolete FROM {v_documents} GROUP BY tenant_id),
        c AS (SELECT f.tenant_id, count(*) FILTER (WHERE a.status <> 'completado' AND a.due_date < DATE '1998-01-01') AS overdue, count(*) FILTER (WHERE a.status <> 'completado') AS unfinished FROM {v_capa} a JOIN {v_findings} f ON f.id = a.finding_id GROUP BY f.tenant_id),
        e AS (SELECT tenant_id, count(*) FILTER (WHERE status = 'pendiente') AS pending, count(*) FILTER (WHERE cause = 'sin_contexto') AS gaps FROM {v_escalations} GROUP BY tenant_id)
        SELECT d.tenant_id, d.in_force, d.obsolete, c.overdue, c.unfinished, e.pending, e.gaps FROM d LEFT JOIN c ON c.tenant_id = d.tenant_id LEFT JOIN e ON e.tenant_id = d.tenant_id""", None),
    "L15_library": ("""WITH n AS (SELECT document_id, count(*) AS chunks FROM {v_chunks} GROUP BY document_id) SELECT d.tenant_id, coalesce(nullif(d.area, 'src0'), 'Sin area') AS area, count(*) AS documents, count(*) FILTER (WHERE d.status = 'vigente') AS in_force,
        CAST(sum(coalesce(n.chunks, 0)) AS BIGINT) AS chunks FROM {v_documents} d LEFT JOIN n ON n.document_id = d.id GROUP BY d.tenant_id, coalesce(nullif(d.area, 'src0'), 'Sin area')""", None),
    "L16_orphan_actions": ("SELECT a.status, count(*) AS n FROM {v_capa} a JOIN {v_findings} f ON f.id = a.finding_id WHERE f.id IS NOT NULL GROUP BY a.status", None),
}

QUERIES = {name: (lambda s, d, q=q: sql(s, d, q)) for name, (q, _) in _SQL.items()}
ORACLES = {name: with_views(other or q) for name, (q, other) in _SQL.items()}
