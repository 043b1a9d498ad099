"""The index of character runs, and the searches through it, against reading every text."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark.operators import catalog, grams


def test_containing(spark):
    rng = random.Random(2)
    texts = [(rng.choice(["t", "u", None]), i, rng.choice([None, "", "".join(rng.choice("abé ") for _ in range(rng.randrange(12)))])) for i in range(300)]
    words = [(t, "".join(rng.choice("abé ") for _ in range(n))) for t in ("t", "u", None, "none") for n in (1, 1, 2, 3, 3, 4, 6) for _ in range(3)] + [("t", ""), ("t", None), ("t", "a"), ("t", "a")]
    want = {(t, w, i) for t, w in words if w for u, i, x in texts if u == t and x and w in x}
    d = spark.createDataFrame(texts, "tenant_id string, id long, text string").withColumn("word", F.lit("clash"))
    w = spark.createDataFrame(words, "tenant_id string, word string").withColumn("text", F.lit("clash"))
    rows = grams.containing(w, d).collect()
    assert len(rows) == len(want) and {tuple(r) for r in rows} == want
    assert grams.containing(w.limit(0), d).count() == grams.containing(w, d.limit(0)).count() == 0


def test_no_join_of_words_and_texts_by_tenant_alone(spark):
    d = spark.createDataFrame([("t", 1, "uno dos")], "tenant_id string, id long, text string")
    w = spark.createDataFrame([("t", "dos")], "tenant_id string, word string")
    plan = grams.containing(w, d)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.split("\n") if "Join " in line]
    assert joins and all("run" in line or "id" in line.split("Join")[1].replace("tenant_id", "") for line in joins)


DOCUMENTS = [(1, "t", "STI-PR-01", "v1", "Compra de equipos", "src1"), (2, "t", "STI-PO-02", "v1", "Política de seguridad", "src2"), (3, "t", "CAL-PR-03", "v1", "Auditoría", "seguridad"), (4, "u", "STI-PR-01", "v1", "Otra", "x"), (5, "t", "CAL-MN-04", "v2", "", "")]


@pytest.mark.parametrize("topic,ids", [("políticas de ti", [1, 2]), ("politicas de ti", [2]), ("politicas", [2]), ("procedimientos", [1, 3]), ("ti", [1, 2]), ("de la", [1, 2, 3, 5]), ("equipos", [1]), ("cal-mn", [5, 3]), ("seguridad", [2]), ("nada", []), ("formato de compras", [])])
def test_search(spark, topic, ids):
    d = spark.createDataFrame([(*r, "vigente") for r in DOCUMENTS], "id long, tenant_id string, code string, version string, title string, area string, status string")
    q = spark.createDataFrame([(7, "t", topic), (8, "t", topic), (9, "none", topic), (10, "t", " ")], "query_id long, tenant_id string, topic string")
    codes = {r[0]: r[2] for r in DOCUMENTS}
    got = catalog.search(q, d).collect()
    for query in (7, 8):
        mine = [r for r in got if r["query_id"] == query]
        assert sorted(r["code"] for r in mine) == sorted(codes[i] for i in ids) and all(r["total"] == len(ids) for r in mine)
    assert {r["query_id"] for r in got} <= {7, 8}
