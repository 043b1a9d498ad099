"""Queries R: retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.functions.vectors import contract
from quillmark.operators import retrieval as r
from quillmark.plans.views import frame, sql, texts, with_views

#: Vectors of the driver's table are far apart, so its queries use a wider cut than the default.
CUT = 0.78

NEAR = """WITH pairs AS (SELECT q.query_id, c.id AS chunk_id, d.code, d.version, d.title, c.section, c.content, d.effective_date,
    round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])), 6) AS distance
    FROM {v_queries} q JOIN {v_chunks} c ON c.tenant_id = q.tenant_id JOIN {v_documents} d ON d.id = c.document_id AND d.status = 'vigente'),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM pairs)"""
FORMAL = r"""regexp_matches(lower(regexp_replace(substr(content, 1, 90), '^\s*\d+(\.\d+)*\.?\s*', '')), '^(objetivo|alcance|documentos de referencia|abreviaturas|responsabilidad|control de cambios)')"""
FOUND = f"""{NEAR}, moved AS (SELECT * EXCLUDE (distance, rank), round(distance + CASE WHEN {FORMAL} THEN 0.06 ELSE 0 END, 6) AS distance FROM near WHERE rank <= 12),
  again AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM moved),
  top AS (SELECT *, min(CASE WHEN distance <= {CUT} THEN distance END) OVER (PARTITION BY query_id) AS best FROM again WHERE rank <= 4),
  found AS (SELECT *, CASE WHEN distance > {CUT} THEN 'beyond_threshold' WHEN distance > best + 0.08 THEN 'beyond_margin' ELSE 'accepted' END AS verdict FROM top)"""
FAQS = """SELECT id, document_id, CASE WHEN id % 3 = 0 THEN NULL ELSE id END AS chunk_id, concat('¿Que dice ', CAST(id AS STRING), '?') AS question,
    concat('Dice ', CAST(label AS STRING)) AS answer, label % 2 = 0 AS reviewed, embedding FROM {v_chunks}"""
FAQ_FOUND = f"""WITH faqs AS ({FAQS}), pairs AS (SELECT q.query_id, f.id AS faq_id, f.chunk_id, f.question, f.answer, f.reviewed, d.code, d.version,
    round(list_cosine_distance(CAST(q.embedding AS DOUBLE[]), CAST(f.embedding AS DOUBLE[])), 6) AS distance
    FROM {{v_queries}} q JOIN {{v_documents}} d ON d.tenant_id = q.tenant_id AND d.status = 'vigente' JOIN faqs f ON f.document_id = d.id),
  near AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, faq_id) AS rank FROM pairs),
  found AS (SELECT n.*, c.section, c.content AS source_content FROM near n LEFT JOIN {{v_chunks}} c ON c.id = n.chunk_id WHERE n.rank <= 3 AND n.distance <= {CUT})"""
TURNS = "SELECT id, concat('tenant-', CAST(conversation_id % 4 AS STRING)) AS tenant_id, content FROM {v_turns}"
INSIDE = "SELECT query_id, tenant_id, embedding, query_id % 50 = 0 AS inside FROM {v_queries}"


def _three(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    return [frame(spark, sf_dir, v) for v in ("v_queries", "v_chunks", "v_documents")]


def retrieved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.retrieve(*_three(spark, sf_dir), max_distance=CUT)


def faqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, c, d = _three(spark, sf_dir)
    return r.retrieve_faqs(q, sql(spark, sf_dir, FAQS), d, c, max_distance=CUT)


QUERIES = {
    "R1_candidates": lambda s, d: r.candidates(*_three(s, d), 12).select("query_id", "rank", "chunk_id", "code", "version", "distance"),
    "R2_penalty": lambda s, d: r.retrieve(*_three(s, d), max_distance=2.0, margin=0.0).select("query_id", "rank", "chunk_id", "distance", r.is_formal(F.col("content")).alias("formal")),
    "R3_retrieve": lambda s, d: retrieved(s, d).select("query_id", "rank", "chunk_id", "code", "version", "section", "distance", "verdict"),
    "R4_faqs": lambda s, d: faqs(s, d).select("query_id", "rank", "faq_id", "question", "answer", "code", "version", "section", "distance", "reviewed", F.coalesce("source_content", F.lit("")).alias("source_content")),
    "R5_direct_section": lambda s, d: r.direct_sections(sql(s, d, TURNS), texts(s, d), frame(s, d, "v_documents")),
    "R6_context_block": lambda s, d: r.context_blocks(retrieved(s, d).filter("verdict = 'accepted'")),
    "R7_faq_block": lambda s, d: r.faq_blocks(faqs(s, d)),
    "R8_citation_label": lambda s, d: retrieved(s, d).select("query_id", "rank", r.label(F.col("code"), F.col("version"), F.col("section")).alias("label")),
    "R9_trace": lambda s, d: r.traces(retrieved(s, d), CUT).select("query_id", F.get_json_object("trace", "$.max_distance").cast("double").alias("max_distance"), F.get_json_object("trace", "$.accepted[0].chunk_id").cast("long").alias("first_id"), F.get_json_object("trace", "$.accepted[0].distance").cast("double").alias("first_distance"), F.size(F.from_json(F.get_json_object("trace", "$.rejected"), "array<struct<chunk_id:long>>")).alias("n_rejected")),
    "R10_dominant": lambda s, d: r.dominant(retrieved(s, d).filter("verdict = 'accepted'")),
    "R11_sufficient": lambda s, d: retrieved(s, d).groupBy("query_id").agg((F.count_if(F.col("verdict") == "accepted") >= 1).alias("sufficient")),
    "R12_support": lambda s, d: retrieved(s, d).filter((F.col("verdict") == "accepted") & (F.col("distance") <= r.SUPPORT_MAX) & (F.col("rank") == 1)).select("query_id", r.label(F.col("code"), F.col("version"), F.col("section")).alias("label"), "distance"),
    "R13_calibration": lambda s, d: r.calibration(sql(s, d, INSIDE), frame(s, d, "v_chunks"), frame(s, d, "v_documents")),
    "R14_embedding_contract": lambda s, d: contract(frame(s, d, "embeddings"), "embedding"),
}

_SQL = {
    "R1_candidates": f"{NEAR} SELECT query_id, rank, chunk_id, code, version, distance FROM near WHERE rank <= 12",
    "R2_penalty": f"{FOUND} SELECT query_id, rank, chunk_id, distance, {FORMAL} AS formal FROM again WHERE rank <= 4",
    "R3_retrieve": f"{FOUND} SELECT query_id, rank, chunk_id, code, version, section, distance, verdict FROM found",
    "R4_faqs": f"{FAQ_FOUND} SELECT query_id, rank, faq_id, question, answer, code, version, section, distance, reviewed, coalesce(source_content, '') AS source_content FROM found",
    "R5_direct_section": r"""WITH t AS (SELECT id, tenant_id, upper(regexp_extract(content, '(?is)del documento\s+([A-Z]{2,5}-[A-Z]{2,5}-\d{1,3}).{0,40}?secci[oó]n\s+(\d+(?:\.\d+)*)', 1)) AS base,
        regexp_extract(content, '(?is)del documento\s+([A-Z]{2,5}-[A-Z]{2,5}-\d{1,3}).{0,40}?secci[oó]n\s+(\d+(?:\.\d+)*)', 2) AS asked FROM (""" + TURNS + """))
        SELECT t.id AS turn_id, c.id AS chunk_id, d.code, d.version, c.section, CAST(0 AS DOUBLE) AS distance FROM t JOIN {v_documents} d ON d.tenant_id = t.tenant_id AND d.status = 'vigente' AND split_part(d.code, ' (', 1) = t.base
        JOIN {v_chunks} c ON c.document_id = d.id AND (c.section = t.asked OR starts_with(c.section, concat(t.asked, '.'))) WHERE t.base <> ''""",
    "R6_context_block": f"""{FOUND}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM found WHERE verdict = 'accepted')
        SELECT query_id, string_agg(concat('[Fragmento ', i, '] Documento: ', code, ' ', version, ' | Titulo: "', title, '" | Seccion: ', section, chr(10), content), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY i) AS block FROM a GROUP BY query_id""",
    "R7_faq_block": f"""{FAQ_FOUND}, a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS i FROM found)
        SELECT query_id, string_agg(concat('[FAQ ', i, '] (', CASE WHEN reviewed THEN 'revisada por Calidad' ELSE 'generada, sin revisar' END, ') ', code, ' ', version, CASE WHEN section IS NULL THEN '' ELSE ', seccion ' || section END,
          chr(10), 'P: ', question, chr(10), 'R: ', answer, CASE WHEN source_content IS NULL THEN '' ELSE chr(10) || 'Texto de la clausula:' || chr(10) || source_content END), concat(chr(10), chr(10), '---', chr(10), chr(10)) ORDER BY i) AS block FROM a GROUP BY query_id""",
    "R8_citation_label": f"{FOUND} SELECT query_id, rank, concat(code, ' ', version, CASE WHEN section IS NULL THEN '' ELSE ', seccion ' || section END) AS label FROM found",
    "R9_trace": f"""{FOUND} SELECT query_id, CAST({CUT} AS DOUBLE) AS max_distance, arg_min(chunk_id, rank) FILTER (verdict = 'accepted') AS first_id, round(arg_min(distance, rank) FILTER (verdict = 'accepted'), 4) AS first_distance,
        count(*) FILTER (verdict <> 'accepted') AS n_rejected FROM found GROUP BY query_id""",
    "R10_dominant": f"""{FOUND}, n AS (SELECT query_id, split_part(code, ' (', 1) AS code, count(*) AS n, min(distance) AS best FROM found WHERE verdict = 'accepted' GROUP BY ALL),
        p AS (SELECT *, sum(n) OVER (PARTITION BY query_id) AS total, row_number() OVER (PARTITION BY query_id ORDER BY n DESC, best, code) AS place FROM n) SELECT query_id, code, n, CAST(total AS BIGINT) AS total FROM p WHERE place = 1 AND n * 2 >= total""",
    "R11_sufficient": f"{FOUND} SELECT query_id, count(*) FILTER (verdict = 'accepted') >= 1 AS sufficient FROM found GROUP BY query_id",
    "R12_support": f"{FOUND} SELECT query_id, concat(code, ' ', version, ', seccion ', section) AS label, distance FROM found WHERE verdict = 'accepted' AND distance <= 0.37 AND rank = 1",
    "R13_calibration": f"""{NEAR}, g AS (SELECT max(CASE WHEN query_id % 50 = 0 THEN distance END) AS worst_inside, min(CASE WHEN query_id % 50 <> 0 THEN distance END) AS best_outside FROM near WHERE rank = 1)
        SELECT *, coalesce(worst_inside < best_outside, false) AS separable, CASE WHEN best_outside IS NULL THEN round(worst_inside + 0.05, 3) WHEN worst_inside < best_outside THEN round((worst_inside + best_outside) / 2, 3) ELSE round(worst_inside + 0.02, 3) END AS recommended FROM g""",
    "R14_embedding_contract": """WITH v AS (SELECT len(embedding) AS n, sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) AS size FROM {embeddings})
        SELECT count(*) AS n, min(n) AS min_dim, max(n) AS max_dim, count(*) FILTER (abs(size - 1) > 0.001) AS off_unit, min(n) = max(n) AND count(*) FILTER (abs(size - 1) > 0.001) = 0 AS holds FROM v""",
}
ORACLES = {k: with_views(v) for k, v in _SQL.items()}
