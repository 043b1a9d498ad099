"""An inverted index of character runs, for the texts that contain a word anywhere within.

A text holds a word only if it holds all runs of three characters of the word (all of it, where the word is shorter). The index lists
the texts of a tenant that hold a run; a word looks up the rarest of its runs, and only the texts listed there are read
and tested. So the work follows from how often rare runs occur, not from words times texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LENGTH = 3


def runs(text: Column, n: int = LENGTH) -> Column:
    """The distinct runs of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - (n - 1)), lambda i: F.substr(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def containing(words: DataFrame, texts: DataFrame) -> DataFrame:
    """(tenant_id, word, id): the texts (tenant_id, id, text) of a word's tenant (tenant_id, word) that contain the word.

    Each word of a tenant is looked up once, however often it is given. A null or empty word is in no text, a null text holds
    no word; no tenant is one too. id tells a text of a tenant. Extra columns are not read.
    """
    tenant = F.coalesce(F.concat(F.lit("="), F.col("tenant_id").cast("string")), F.lit("")).alias("_tenant")
    asked = words.filter("word <> ''").select("tenant_id", tenant, "word").distinct()
    held = texts.filter("text IS NOT NULL").select(tenant, "id", "text")
    of_length = [runs(F.col("text"), n) for n in range(1, LENGTH + 1)]
    postings = held.select("_tenant", "id", F.explode(F.concat(*of_length)).alias("run"))
    listed = postings.groupBy("_tenant", "run").agg(F.count("*").alias("n"))
    own = F.explode(F.when(F.length("word") < LENGTH, F.array("word")).otherwise(runs(F.col("word")))).alias("run")
    every = asked.select("tenant_id", "_tenant", "word", own).join(listed, ["_tenant", "run"], "left")
    rarest = every.groupBy("tenant_id", "_tenant", "word").agg(F.min_by("run", F.struct(F.coalesce("n", F.lit(0)), "run")).alias("run"))
    near = rarest.join(postings, ["_tenant", "run"]).select("tenant_id", "_tenant", "word", "id")
    return near.join(held, ["_tenant", "id"]).filter(F.contains("text", "word")).select("tenant_id", "word", "id")
