"""All registered queries with the SQL that states their results."""

from quillmark.plans import q_audit, q_cases, q_clauses, q_control, q_guard, q_learn, q_retrieval, q_streams, q_turns

_MODULES = (q_retrieval, q_audit, q_clauses, q_control, q_guard, q_turns, q_cases, q_learn, q_streams)
QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
