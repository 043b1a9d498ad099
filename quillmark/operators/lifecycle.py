"""Findings, corrective actions, escalations and incidents: what is registered, suppressed, refused and patched."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import fingerprint
from quillmark.operators.admission import admissions
from quillmark.sources.scratch import scratch

SEVERITIES = ("observacion", "menor", "mayor")
HOURS, RECENT = 24, 50
ESCALATION_STATES = ("propuesta", "pendiente", "en_revision", "resuelta", "descartada")


def severity(c: Column) -> Column:
    """A severity that is none counts as minor."""
    return F.when(c.isin(*SEVERITIES), c).otherwise("menor")


def suppress_duplicates(reports: DataFrame, recent: int = RECENT) -> DataFrame:
    """(id, kept, original_id) of reports (id, tenant_id, description, created_at), in order of created_at, then id.

    A report is suppressed if one of the tenant's `recent` last kept reports has its text and is 24 hours old at most; its
    original is the last such. A report without time is kept and suppresses none. No tenant is one too.

    By age alone, the reports of a text are admissions with a limit of one, which split a text of any size over tasks. Where no
    tenant has kept more than `recent` in 24 hours, age alone decides; that too is an admission, of what is kept by tenant.
    The reports of other, crowded tenants stream through a task a tenant, which holds the `recent` last kept.
    """
    day = HOURS * 3_600_000_000
    tenant = F.coalesce(F.concat(F.lit("="), F.col("tenant_id").cast("string")), F.lit(""))
    r = reports.select("id", tenant.alias("tenant"), fingerprint(F.col("description")).alias("print"), F.unix_micros(F.col("created_at").cast("timestamp")).alias("at"))
    key = F.concat(F.length("tenant").cast("string"), F.lit(":"), "tenant", F.coalesce(F.concat(F.lit("="), "print"), F.lit("")))
    path = scratch(reports.sparkSession, "reports")
    admissions(r.select("id", key.alias("key"), "at"), 1, day).write.parquet(path)
    by_age = reports.sparkSession.read.parquet(path)
    first = by_age.filter("admitted").select("key", F.col("at").alias("since"), F.col("id").alias("original_id"))
    of_age = by_age.join(first, ["key", "since"], "left").select("id", "key", "at", F.expr("admitted OR at IS NULL").alias("kept"), F.coalesce("original_id", "id").alias("original_id"))
    of_key = F.expr("substring(key, instr(key, ':') + 1, int(substring_index(key, ':', 1)))")
    by_tenant = admissions(by_age.filter("admitted").select("id", of_key.alias("key"), "at"), recent, day)
    crowded = by_tenant.filter("NOT admitted").select(F.col("key").alias("tenant")).distinct()
    if not crowded.head(1):
        return of_age.select("id", "kept", "original_id")

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, last = None, deque(maxlen=recent)
        for pdf in batches:
            kept, original = [], []
            for tenant, text, at, i in zip(pdf["tenant"], pdf["print"], pdf["at"], pdf["id"]):
                if tenant != of:
                    of, last = tenant, deque(maxlen=recent)
                found = next((k for x, t, k in reversed(last) if x == text and t >= at - day), None)
                if found is None:
                    last.append((text, at, i))
                kept.append(found is None)
                original.append(i if found is None else found)
            yield pd.DataFrame({"id": pdf["id"], "kept": kept, "original_id": original})

    timed = r.filter("at IS NOT NULL").join(crowded, "tenant").repartition("tenant").sortWithinPartitions("tenant", "at", "id")
    apart = of_age.withColumn("tenant", of_key).join(crowded.withColumn("crowded", F.lit(True)), "tenant", "left").filter("crowded IS NULL OR at IS NULL")
    return apart.select("id", "kept", "original_id").unionByName(timed.mapInPandas(each, "id long, kept boolean, original_id long"))


def register_actions(requests: DataFrame, findings: DataFrame, existing: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(outcomes, findings): requests (id, tenant_id, finding_id, description, responsible, due_date_raw) with an error or none, and findings with their new status.

    In order: a date in the past, a missing responsible or date, a finding that the tenant lacks, an action that the finding
    has already, by its text, from before or from an earlier request. An open finding goes into review.
    """
    due = F.try_to_date(F.substring(F.trim("due_date_raw"), 1, 10), "yyyy-MM-dd")
    r = requests.withColumn("due_date", F.when(F.trim("due_date_raw").rlike(r"^\d{4}-\d{2}-\d{2}"), due))
    r = r.join(findings.select("tenant_id", F.col("id").alias("finding_id"), F.lit(True).alias("found")), ["tenant_id", "finding_id"], "left")
    had = existing.select("finding_id", F.md5("description").alias("digest")).distinct().withColumn("had", F.lit(True))
    r = r.withColumn("digest", F.md5("description")).join(had, ["finding_id", "digest"], "left")
    early = F.when(F.col("due_date") < today, "fecha_en_el_pasado").when((F.trim(F.coalesce("responsible", F.lit(""))) == "") | F.col("due_date").isNull(), "datos_incompletos").when(F.col("found").isNull(), "not_found").when(F.col("had"), "duplicado")
    r = r.withColumn("early", early)
    again = F.row_number().over(Window.partitionBy("finding_id", "digest", F.col("early").isNull()).orderBy("id")) > 1
    r = r.withColumn("error", F.coalesce("early", F.when(again, "duplicado")))
    taken = r.filter("error IS NULL").select(F.col("finding_id").alias("id"), F.lit(True).alias("acted")).distinct()
    f = findings.join(taken, "id", "left").withColumn("status", F.when(F.col("acted") & (F.col("status") == "abierto"), "en_revision").otherwise(F.col("status"))).drop("acted")
    return r.select("id", "tenant_id", "finding_id", "due_date", "error"), f


def finding_status(asked: DataFrame, findings: DataFrame, actions: DataFrame) -> DataFrame:
    """(ask_id, finding_id, status, severity, actions) for (ask_id, tenant_id, finding_id); a finding of another tenant is as unknown as none."""
    a = actions.groupBy("finding_id").agg(F.array_sort(F.collect_list(F.struct("description", "responsible", "due_date", "status"))).alias("actions"))
    f = findings.select("tenant_id", F.col("id").alias("finding_id"), "status", "severity")
    return asked.join(f, ["tenant_id", "finding_id"], "left").join(a, "finding_id", "left").select("ask_id", "finding_id", F.coalesce("status", F.lit("not_found")).alias("status"), "severity", F.when(F.col("status").isNotNull(), F.coalesce("actions", F.array().cast(a.schema["actions"].dataType))).alias("actions"))


def extend_findings(findings: DataFrame, details: DataFrame) -> DataFrame:
    """Findings with the details (id, tenant_id, finding_id, detail) appended in order."""
    d = details.filter("trim(detail) <> ''").groupBy("tenant_id", "finding_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", F.trim("detail").alias("t")))), lambda x: F.concat(F.lit("\n\nAmpliación: "), x["t"])), "").alias("more"))
    return findings.join(d.withColumnRenamed("finding_id", "id"), ["tenant_id", "id"], "left").withColumn("description", F.concat("description", F.coalesce("more", F.lit("")))).drop("more")


def proposals(questions: DataFrame, cause: str, reason: str) -> DataFrame:
    """Escalations for questions (id, tenant_id, conversation_id, question): always as proposals."""
    return questions.select("id", "tenant_id", "conversation_id", "question", F.lit(cause).alias("cause"), F.lit(reason).alias("reason"), F.lit("propuesta").alias("status"))


def retag(escalations: DataFrame, tags: DataFrame) -> DataFrame:
    """Escalations with cause and reason of tags (conversation_id, cause, reason) on the last of each conversation, as a proposal again."""
    last = F.row_number().over(Window.partitionBy("conversation_id").orderBy(F.desc("id")))
    t = tags.select("conversation_id", F.col("cause").alias("new_cause"), F.col("reason").alias("new_reason"))
    e = escalations.withColumn("place", last).join(t, "conversation_id", "left")
    hit = (F.col("place") == 1) & F.col("new_cause").isNotNull() & (F.col("new_cause") != F.col("cause"))
    return e.select("id", "conversation_id", F.when(hit, F.col("new_cause")).otherwise(F.col("cause")).alias("cause"), F.when(hit, F.col("new_reason")).alias("reason"), F.when(hit, "propuesta").otherwise(F.col("status")).alias("status"))


def incidents(failures: DataFrame) -> DataFrame:
    """Adds reference (INC- and the id) to failures (id, kind, detail), the detail cut to 2000 characters."""
    return failures.select("id", F.concat(F.lit("INC-"), F.when(F.length(F.col("id").cast("string")) < 5, F.lpad(F.col("id").cast("string"), 5, "0")).otherwise(F.col("id").cast("string"))).alias("reference"), "kind", F.substring("detail", 1, 2000).alias("detail"))


def patch_escalations(escalations: DataFrame, patches: DataFrame, now: Column) -> DataFrame:
    """Escalations with the status of patches (id, status): closing stamps resolved_at, reopening clears it, an unknown status changes nothing."""
    p = patches.filter(F.col("status").isin(*ESCALATION_STATES)).select("id", F.col("status").alias("new"))
    e = escalations.join(p, "id", "left")
    closed = F.col("new").isin("resuelta", "descartada")
    return e.select("id", F.coalesce("new", "status").alias("status"), F.when(closed, now).when(F.col("new").isNull() & F.col("status").isin("resuelta", "descartada"), F.col("created_at")).alias("resolved_at"))


def tenant(requested: Column, configured: str | None) -> tuple[Column, Column]:
    """The tenant that holds, and whether it overrides the requested one."""
    fixed = F.nullif(F.lit(configured or ""), F.lit(""))
    return F.coalesce(fixed, requested), fixed.isNotNull() & F.coalesce(requested != fixed, F.lit(False))
