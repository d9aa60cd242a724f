"""Plain text to units, lines and paragraphs (TXT-*)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joining import join_lines, joined_words
from ..functions.stats import smallest_mode

#: A unit's size in bytes, and how far its end may be looked for.
UNIT_TARGET, UNIT_SLACK = 3000, 4000


def lines(docs: DataFrame, *keys: str, text: str = "text") -> DataFrame:
    """Rows (keys, line_no, text, indent, blank): CR, LF and CRLF each end a line; a tab indents by 8."""
    t = F.regexp_replace(F.col(text), "\r\n?", "\n")
    rows = docs.select(*keys, F.posexplode(F.split(F.regexp_replace(t, "\n\\z", ""), "\n")).alias("line_no", "line")).where(F.col(text) != "")
    lead = F.regexp_extract("line", "^[ \t]*", 0)
    bare = F.regexp_replace(F.regexp_replace("line", "^[ \t]+", ""), "[ \t]+\\z", "")
    rows = rows.select(*keys, "line_no", bare.alias("text"), F.length(F.replace(lead, F.lit("\t"), F.lit(" " * 8))).alias("indent"))
    return rows.withColumn("blank", F.col("text") == "")


def modal_indent(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, base_indent): the most frequent indent of lines with text, 8 for 8 and more; of equals the smallest."""
    counted = rows.where(~F.col("blank")).groupBy(*keys, F.least("indent", F.lit(8)).alias("bin")).agg(F.count("*").alias("n"))
    return counted.groupBy(*keys).agg(smallest_mode(F.col("bin"), F.col("n")).alias("base_indent"))


def paragraphs(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, para, text, indent, n_lines, joins) from lines().

    A paragraph starts at a document's first line, after a blank line, and where a line is indented by more than one over the base.
    """
    own, whole = Window.partitionBy(*keys).orderBy("line_no"), Window.partitionBy(*keys)
    # The base is modal_indent(), by windows over the partitions that the others need too.
    counts = [F.struct(F.count_if(~F.col("blank") & (F.least("indent", F.lit(8)) == k)).over(whole).alias("n"), F.lit(-k).alias("k")) for k in range(9)]
    rows = rows.withColumn("base_indent", -F.greatest(*counts)["k"])
    starts = F.coalesce(F.lag("blank").over(own), F.lit(True)) | (F.col("indent") > F.col("base_indent") + 1)
    rows = rows.withColumn("starts", (~F.col("blank") & starts).cast("int"))
    rows = rows.withColumn("para", F.sum("starts").over(own) - 1).where(~F.col("blank"))
    grouped = rows.groupBy(*keys, "para").agg(
        F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("parts"), F.min_by("indent", "line_no").alias("indent"), F.count("*").alias("n_lines")
    )
    texts = F.transform("parts", lambda p: p["text"])
    return grouped.select(*keys, "para", join_lines(texts).alias("text"), "indent", "n_lines", joined_words(texts).cast("int").alias("joins"))


_BLANK = re.compile(rb"\n[\r \t]*\n")


def _cut(data: bytes, target: int, slack: int) -> Iterator[tuple[int, int, bool]]:
    """(from, to, clean): whether a unit begins where a blank line ended the one before."""
    start, clean = 0, True
    while start < len(data):
        aim = start + target
        end, next_clean = len(data), True
        if aim < len(data):
            limit = min(aim + slack, len(data))
            blank = _BLANK.search(data, aim, limit)
            line = data.find(b"\n", aim, limit)
            next_clean = blank is not None
            end = blank.end() if blank else line + 1 if line >= 0 else limit
        yield start, end, clean
        start, clean = end, next_clean


def units(docs: DataFrame, key: str, text: str = "text", target: int = UNIT_TARGET, slack: int = UNIT_SLACK) -> DataFrame:
    """Rows (key, unit, from, to, clean): byte ranges that tile each text (a string, or a file's bytes), cut at blank lines where there are any near.

    Each cut depends on the one before, so a text is cut by one small loop; texts are dealt over all tasks as they are read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [
                (k, i, a, b, clean)
                for k, t in zip(batch[key], batch[text])
                for i, (a, b, clean) in enumerate(_cut(t.encode() if isinstance(t, str) else bytes(t or b""), target, slack))
            ]
            yield pd.DataFrame(rows, columns=[key, "unit", "from", "to", "clean"])

    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, unit int, `from` long, `to` long, clean boolean")


def unit_flags(rows: DataFrame, *keys: str) -> DataFrame:
    """units() with cont (its first paragraph goes on from the unit before) and open (its last one goes on)."""
    own = Window.partitionBy(*keys).orderBy("unit")
    later = F.lead("clean").over(own)
    return rows.select("*", ((F.col("unit") > 0) & ~F.col("clean")).alias("cont"), F.coalesce(~later, F.lit(False)).alias("open"))


def content(column: str | Column) -> Column:
    """Bytes of a text column, as a file would hold them."""
    return F.encode(column, "UTF-8")
