"""The corpus pipeline: quality rules, near-duplicates, secrets, mixing, packing, in this order.

Every stage takes (spark, docs, sf_dir) and its result is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmark.llm import mixing, near_dedup, packing, quality_rules, secret_scan
from quillmark.llm.common import table, written

STAGES = [
    ("quality rules", quality_rules.stage),
    ("near-duplicates", near_dedup.stage),
    ("secrets", secret_scan.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: SQL can't state the trained models, the draws and the tokens; the tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of packed sequences that the stages make of the table documents, each stage of all that its predecessor kept.

    Null and empty texts fail the quality rules and go; rows without id, language or source go through all stages; of
    repeated rows of an id one stays; an empty table gives no pieces. Columns beyond those of documents are carried
    until the last stage.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
