"""Tables and derived inputs of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as hard-wrapped text files, by doc_id: long words broken at line ends, indented lines, blank lines."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    t = F.col("text")
    t = F.when(F.col("doc_id") % 7 == 0, F.regexp_replace(t, "([a-z]{4})([a-z]{4,})", "$1-\n$2")).otherwise(t)
    t = F.when(F.col("doc_id") % 5 == 0, F.regexp_replace(t, "\n([^\n]*)\n", "\n    $1\n")).otherwise(t)
    t = F.when(F.col("doc_id") % 2 == 1, F.replace(t, F.lit("\n"), F.lit("\n\n"))).otherwise(t)
    return docs.select("doc_id", t.alias("text"))


def derived_sql() -> str:
    t = "CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '([a-z]{4})([a-z]{4,})', '\\1-' || chr(10) || '\\2', 'g') ELSE text END"
    t = f"CASE WHEN doc_id % 5 = 0 THEN regexp_replace({t}, '\\n([^\\n]*)\\n', chr(10) || '    \\1' || chr(10), 'g') ELSE {t} END"
    t = f"CASE WHEN doc_id % 2 = 1 THEN replace({t}, chr(10), chr(10) || chr(10)) ELSE {t} END"
    return f"SELECT doc_id, {t} AS text FROM documents"
