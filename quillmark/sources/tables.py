"""Sources and sinks: metadata CSV, register text, coded files, FAQ JSON, checkpoints, register loads, data sets and uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillmark.functions.text import slug
from quillmark.sources.snapshots import Snapshots

METADATA = "filename string, code string, version string, title string, area string, effective_date string, status string"
FAQ_FILE = "total long, entradas array<struct<pregunta:string,respuesta:string,codigo:string,version:string,titulo_documento:string,area:string,seccion:string>>"
CHECKPOINT = "clave string, codigo string, version string, titulo string, area string, seccion string, generadas array<struct<pregunta:string,respuesta:string>>"
#: A coded file's name.
CODED = r"^([A-Z]{3}-[A-Z]{2}-\d{2})\s+(.+)$"
MAX_UPLOAD = 25 << 20
SHOWN = 40


def iso_date(c: Column) -> tuple[Column, Column]:
    """The date of strict ISO text, and whether text that is not blank is none."""
    t = F.trim(F.coalesce(c, F.lit("")))
    d = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(t, "yyyy-MM-dd"))
    return d, (t != "") & d.isNull()


def read_metadata(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of metadata CSV files: of a repeated filename the later line holds; a blank status means in force.

    Lines keep their order within a file. A blank filename, another status and a wrong date are errors.
    """
    raw = spark.read.csv(path, schema=METADATA, header=True, escape='"', encoding="UTF-8", ignoreLeadingWhiteSpace=True).withColumns({"file": F.col("_metadata.file_path"), "line": F.monotonically_increasing_id()})
    status = F.lower(F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("vigente")))
    day, wrong = iso_date(F.col("effective_date"))
    name = F.trim(F.coalesce("filename", F.lit("")))
    error = F.when(name == "", "filename").when(~status.isin("vigente", "obsoleto"), "status").when(wrong, "effective_date")
    rows = raw.withColumns({"filename": name, "status": status, "error": error, "day": day})
    last = F.row_number().over(Window.partitionBy("filename").orderBy(F.desc("file"), F.desc("line")))
    good = rows.filter("error IS NULL").withColumn("place", last).filter("place = 1")
    return good.select("filename", "code", "version", "title", "area", F.col("day").alias("effective_date"), "status"), rows.filter("error IS NOT NULL").select("filename", "code", "error")


def write_metadata(rows: DataFrame, path: str) -> None:
    """Metadata as CSV sorted by code: parts of a range sort, so their names give the order."""
    rows.select(*(c.split()[0] for c in METADATA.split(", "))).orderBy("code", "filename").write.csv(path, header=True, escape='"')


def coded_files(paths: DataFrame) -> DataFrame:
    """(path, code, title, area) of (root, path): files whose name begins with a code; the first folder is the area."""
    name = F.trim(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.pdf$", ""))
    area = F.when(F.size(F.split("path", "/")) > 1, F.split("path", "/")[0]).otherwise("General")
    f = paths.filter(F.lower("path").endswith(".pdf")).withColumns({"code": F.regexp_extract(name, CODED, 1), "title": F.trim(F.regexp_extract(name, CODED, 2)), "area": area})
    return f.filter("code <> ''")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length) of all files below a folder; their contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length")
    return f.withColumn("path", F.regexp_replace("path", "^" + root.replace("file://", "file:(//)?").rstrip("/") + "/", ""))


def read_faq(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FAQ_FILE).json(path, multiLine=True).select(F.explode("entradas").alias("e")).select("e.*")


def append_checkpoint(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def read_checkpoint(lines: DataFrame) -> DataFrame:
    """Records of checkpoint lines (pos, value): torn lines are left out; per key the content of the last, at the place of the first."""
    r = lines.withColumn("r", F.from_json("value", CHECKPOINT + ", _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"}))
    r = r.filter("r._corrupt_record IS NULL AND r.clave IS NOT NULL").select("pos", "r.*").drop("_corrupt_record")
    return r.groupBy("clave").agg(F.min("pos").alias("pos"), F.max_by(F.struct(*(c for c in r.columns if c not in ("clave", "pos"))), "pos").alias("x")).select("clave", "pos", "x.*")


def unfinished(work: DataFrame, done: DataFrame) -> DataFrame:
    """Clauses (clave, ...) that no checkpoint record holds."""
    return work.join(done.select("clave"), "clave", "left_anti")


def load_register(rows: DataFrame, register: Snapshots) -> int:
    """Replaces the register of every tenant in rows (tenant_id, code, ...), and leaves others as they are, in one version of the table, whose number it gives.

    A load that another one overtakes raises Conflict and changes nothing.
    """
    parent = register.version()
    if not parent:
        return register.create(rows)
    gone = register.read(parent).join(rows.select("tenant_id").distinct(), "tenant_id", "left_semi")
    return register.change(put=rows, out=gone, parent=parent)


def register_of_metadata(metadata: DataFrame, tenant: Column) -> DataFrame:
    return metadata.select(tenant.alias("tenant_id"), F.upper("code").alias("code"), "version", "title", F.col("area").alias("process"), "effective_date", F.lit("metadata").alias("source"))


def write_dataset(examples: DataFrame, path: str) -> None:
    """Examples (particion, messages, ...) as JSON lines, a folder for each partition."""
    examples.write.partitionBy("particion").json(path)


def tagged(examples: DataFrame) -> DataFrame:
    """Adds tipo: tool_call if the last message calls tools, else texto."""
    calls = F.size(F.element_at("messages", -1)["tool_calls"]) > 0
    return examples.withColumn("tipo", F.when(F.coalesce(calls, F.lit(False)), "tool_call").otherwise("texto"))


def rejection_summary(rejected: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(reason, total, place, question, detail): up to `shown` rejections of each reason, with the reason's total."""
    place = F.row_number().over(Window.partitionBy("reason").orderBy("id"))
    first = rejected.withColumn("place", place).filter(F.col("place") <= shown)  # limited before the shuffle
    return first.join(rejected.groupBy("reason").agg(F.count("*").alias("total")), "reason")


def admit_uploads(files: DataFrame, limit: int = MAX_UPLOAD, taken: DataFrame | None = None) -> DataFrame:
    """Adds status (queued or rejected), reason, stem and stored_name to files (id, tenant_id, path, length).

    A stem that occurs again in a tenant gets a number, in order of id. taken: (tenant_id, stem, n), how often stems are in use
    already.
    """
    name = F.element_at(F.split("path", "/"), -1)
    reason = F.when(~F.lower(name).endswith(".pdf"), "not_pdf").when(F.col("length") == 0, "empty").when(F.col("length") > limit, "too_large")
    stem = F.coalesce(F.nullif(F.substring(slug(F.regexp_replace(name, r"\.[^.]*$", "")), 1, 80), F.lit("")), F.lit("documento"))
    f = files.withColumns({"reason": reason, "stem": stem})
    k = F.row_number().over(Window.partitionBy("tenant_id", "stem", F.col("reason").isNull()).orderBy("id"))
    f = f.withColumn("k", k)
    if taken is not None:
        f = f.join(taken, ["tenant_id", "stem"], "left").withColumn("k", F.col("k") + F.coalesce("n", F.lit(0))).drop("n")
    stored = F.concat("stem", F.when(F.col("k") > 1, F.concat(F.lit("_"), F.col("k").cast("string"))).otherwise(F.lit("")), F.lit(".pdf"))
    return f.withColumns({"status": F.when(F.col("reason").isNull(), "queued").otherwise("rejected"), "stored_name": F.when(F.col("reason").isNull(), stored)}).drop("k")
