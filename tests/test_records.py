"""Data sources over text files: ranges cut anywhere, filters in the reader."""

import pytest
from pyspark.sql import functions as F

from quillmark.sources import records

LINES = ["Documento uno STI-PR-01 03 15/03/2024", "sin fila", "Año ñandú CAL-MN-02 N/A N/A  ", "", "otro STI-PR-01 4 N/A", "x STI-PR-01 5 1/1/2024", "ultimo GTH-IN-09 10 31/02/2024"]
ENTRY = "# Rechazos\n- **{c} §{k}** — ZZZ-PR-99, YYY-PO-01\n  - P: ¿qué dice {k}?\n  - R: lo dice ZZZ\n- **roto\nresto"


@pytest.mark.parametrize("size", [1, 7, 40, 1 << 20])
def test_every_record_once_however_files_are_cut(spark, tmp_path, size, monkeypatch):
    monkeypatch.setattr(records, "READ", 16)
    records.register(spark)
    for tenant, lines in (("a", LINES), ("b", LINES[:1])):
        (tmp_path / "r" / f"tenant_id={tenant}").mkdir(parents=True)
        (tmp_path / "r" / f"tenant_id={tenant}" / "part-0").write_text("\n".join(lines) + ("\n" if tenant == "a" else ""))
    rows = spark.read.format("register_text").option("rangeBytes", size).load(f"file://{tmp_path}/r").orderBy("pos").collect()
    assert [tuple(r)[0:1] + tuple(r)[2:] for r in rows] == [("a", "STI-PR-01", "03", "15/03/2024"), ("a", "CAL-MN-02", "N/A", "N/A"), ("a", "STI-PR-01", "4", "N/A"), ("a", "GTH-IN-09", "10", "31/02/2024"), ("b", "STI-PR-01", "03", "15/03/2024")]
    (tmp_path / "e").mkdir()
    (tmp_path / "e" / "part-0").write_text("\n".join(ENTRY.format(c="STI-PR-01", k=k) for k in range(5)))
    rows = spark.read.format("rejection_text").option("rangeBytes", size).load(f"file://{tmp_path}/e").orderBy("pos").collect()
    assert [tuple(r)[2:] for r in rows] == [("STI-PR-01", str(k), "ZZZ-PR-99,YYY-PO-01", f"¿qué dice {k}?", "lo dice ZZZ") for k in range(5)]


def test_filters_on_the_code_are_evaluated_in_the_reader(spark, tmp_path):
    records.register(spark)
    (tmp_path / "part-0").write_text("\n".join(LINES))
    df = spark.read.format("register_text").load(f"file://{tmp_path}")
    one = df.filter((F.col("code") == "STI-PR-01") & (F.col("version") != "4"))
    assert [r["version"] for r in one.collect()] == ["03"]
    assert {r["code"] for r in df.filter(F.col("code").isin("STI-PR-01", "GTH-IN-09")).collect()} == {"STI-PR-01", "GTH-IN-09"}
    plan = one._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.split("\n") if "Filter" in line and "BatchScan" not in line]
    assert all("code" not in line for line in left), plan
    (tmp_path / "none").mkdir()
    assert spark.read.format("register_text").load(f"file://{tmp_path}/none").count() == 0
