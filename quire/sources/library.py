"""The library: files of known formats (SRC-01 to SRC-03, QRY-06)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BOOKS = 128
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(s: Column) -> Column:
    return F.translate(s, UPPER, UPPER.lower())


def format_of(name: Column) -> Column:
    """pdf, txt or epub by extension; null for others and for names that are nothing else."""
    return F.nullif(F.regexp_extract(ascii_lower(name), "(?s)^.+\\.(pdf|txt|epub)$", 1), F.lit(""))


def kind_of(fmt: Column) -> Column:
    return F.when(fmt == "pdf", "DOC_PDF").when(fmt == "txt", "DOC_TXT").when(fmt == "epub", "DOC_EPUB")


def library(files: DataFrame, most: int = MOST_BOOKS) -> DataFrame:
    """Rows (name, size, fmt) of files (name, size): known formats, in order of their names without ASCII case, ``most`` at most."""
    rows = files.select("name", "size", format_of(F.col("name")).alias("fmt")).where("fmt is not null")
    return rows.orderBy(ascii_lower(F.col("name")), "name").limit(most)


def scan(spark: SparkSession, folder: str, most: int = MOST_BOOKS) -> DataFrame:
    """library() of a folder; files are listed, not read."""
    files = spark.read.format("binaryFile").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"))
    return library(files, most)
