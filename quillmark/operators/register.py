"""The master register against the files and documents there are."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.functions.text import base_code, slug, version_number


def reconcile(files: DataFrame, registry: DataFrame) -> DataFrame:
    """(tenant_id, code, side): both, registered_without_file or file_not_registered."""
    f = files.select("tenant_id", base_code(F.col("code")).alias("code")).distinct().withColumn("f", F.lit(True))
    r = registry.select("tenant_id", "code").distinct().withColumn("r", F.lit(True))
    side = F.when(F.col("f").isNull(), "registered_without_file").when(F.col("r").isNull(), "file_not_registered").otherwise("both")
    return f.join(r, ["tenant_id", "code"], "full").select("tenant_id", "code", side.alias("side"))


def same_content_once(files: DataFrame) -> DataFrame:
    """Of files (id, tenant_id, code, path, content) of equal code and content the one of shortest path; ties to the first path, then to the smallest id."""
    at = Window.partitionBy("tenant_id", "code", "hash").orderBy(F.length("path"), "path", "id")
    return files.withColumn("hash", F.sha2("content", 256)).withColumn("place", F.row_number().over(at)).filter("place = 1").drop("place")


def distinct_codes(files: DataFrame) -> DataFrame:
    """Codes that several files share get a qualifier: parentheses of the title or folder, then the root folder, then an ordinal by path and id."""
    folder, root = F.element_at(F.split("path", "/"), -2), F.split("path", "/")[0]
    qualifier = F.coalesce(F.nullif(F.regexp_extract("title", r"\(([^)]+)\)", 1), F.lit("")), folder)
    n = lambda *c: F.count("*").over(Window.partitionBy("tenant_id", *c))
    f = files.withColumn("base", F.col("code")).withColumn("code", F.when(n("base") > 1, F.concat("base", F.lit(" ("), qualifier, F.lit(")"))).otherwise(F.col("code")))
    f = f.withColumn("many", n("base") > 1).withColumn("code", F.when(F.col("many") & (n("code") > 1), F.concat("base", F.lit(" ("), qualifier, F.lit(" - "), root, F.lit(")"))).otherwise(F.col("code")))
    k = F.row_number().over(Window.partitionBy("tenant_id", "code").orderBy("path", "id"))
    return f.withColumn("k", k).withColumn("code", F.when(F.col("many") & (F.col("k") > 1), F.concat("code", F.lit(" #"), F.col("k").cast("string"))).otherwise(F.col("code"))).drop("many", "k", "base")


def unique_filenames(rows: DataFrame) -> DataFrame:
    """A flat filename of code and title for every row, with _2, _3 and so on where names clash."""
    base = F.concat(slug(F.col("code")), F.lit("_"), F.substring(slug(F.col("title")), 1, 60))
    k = F.row_number().over(Window.partitionBy("tenant_id", "name").orderBy("id"))
    return rows.withColumn("name", base).withColumn("k", k).withColumn("filename", F.concat("name", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(F.lit("")), F.lit(".pdf"))).drop("name", "k")


def coverage(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """Per tenant: codes registered and indexed, registered only, indexed only."""
    s = reconcile(documents, registry)
    return s.groupBy("tenant_id").agg(*(F.count_if(F.col("side") == k).alias(n) for k, n in (("both", "registered_and_indexed"), ("registered_without_file", "registered_only"), ("file_not_registered", "indexed_only"))))


def known_codes(documents: DataFrame, registry: DataFrame) -> DataFrame:
    """(tenant_id, code): base codes that are indexed or registered."""
    return documents.select("tenant_id", base_code(F.col("code")).alias("code")).union(registry.select("tenant_id", F.upper("code"))).distinct()


def version_map(documents: DataFrame) -> DataFrame:
    """(tenant_id, code, versions, in_force): all versions of a base code, and the highest in force."""
    n = version_number(F.col("version"))
    d = documents.withColumn("code", base_code(F.col("code")))
    return d.groupBy("tenant_id", "code").agg(F.sort_array(F.collect_set("version")).alias("versions"), F.max_by("version", F.when(F.col("status") == "vigente", n)).alias("in_force"))


def conflicts(documents: DataFrame) -> DataFrame:
    """Codes with more than one version in force."""
    g = documents.filter("status = 'vigente'").groupBy("tenant_id", "code").agg(F.sort_array(F.collect_list("version")).alias("versions"))
    return g.filter(F.size("versions") > 1)


def patched(documents: DataFrame, patches: DataFrame, columns: list[str]) -> DataFrame:
    """documents with the non-null values of patches (id, columns)."""
    p = patches.select("id", *(F.col(c).alias(f"_{c}") for c in columns))
    return documents.join(p, "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in columns}).drop(*(f"_{c}" for c in columns))


def register_rows(rows: DataFrame) -> DataFrame:
    """(tenant_id, code, version, effective_date) of a register's rows as they stand in its text (tenant_id, pos, code, version, effective_date); the last row of a code holds.

    Rows without a version are left out; a date that is missing or wrong is null.
    """
    day = F.try_to_date(F.when(F.col("effective_date") != "N/A", F.col("effective_date")), "dd/MM/yyyy")
    rows = rows.filter("version <> 'N/A'").select("tenant_id", "pos", "code", F.concat(F.lit("v"), F.col("version").cast("int").cast("string")).alias("version"), day.alias("effective_date"))
    return rows.groupBy("tenant_id", "code").agg(F.max_by(F.struct("version", "effective_date"), "pos").alias("x")).select("tenant_id", "code", "x.version", "x.effective_date")
