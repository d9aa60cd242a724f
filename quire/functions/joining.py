"""Joining lines to paragraphs, words broken at line ends mended (RFL-12)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import BREAK_HYPHEN, LETTER, LOWER


def join_lines(lines: Column, dehyphenate: bool = True) -> Column:
    """Lines (an array of non-empty strings) as one text.

    A hyphen at a line's end after a letter goes if the next line starts in lower case; any
    other hyphen stays and its word is joined without a space.
    """
    text = F.array_join(lines, "\n")
    if dehyphenate:
        text = F.regexp_replace(text, f"(?<=[{LETTER}])[{BREAK_HYPHEN}]\n(?=[{LOWER}])", "")
    text = F.regexp_replace(text, f"([{BREAK_HYPHEN}])\n", "$1")
    return F.regexp_replace(text, "\n", " ")


def joined_words(lines: Column) -> Column:
    """How many broken words join_lines mends."""
    return F.regexp_count(F.array_join(lines, "\n"), F.lit(f"(?<=[{LETTER}])[{BREAK_HYPHEN}]\n(?=[{LOWER}])"))
