"""Paragraphs to screen lines and screens (LAY-*)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Widths of a test font in ems, by character; 0.5 for all others.
WIDTHS = {
    **dict.fromkeys(" ", 0.26), **dict.fromkeys("iljI.,;:!|'`", 0.30), **dict.fromkeys("()[]/-ftr", 0.38), **dict.fromkeys("mw", 0.80),
    **dict.fromkeys("MW", 0.88), "—": 1.00, "–": 0.50, "…": 0.90,
}
CAPITAL, OTHER = 0.66, 0.50

LINE_HEIGHT, LINE_MUL, PARA_GAP, HEAD_GAP = 1.2, 1.28, 0.35, 0.70
TEXT_W, TEXT_H = 452.0, 222.0

SCREEN_LINE = "array<struct<screen:int,line_no:int,para:int,text:string,x:double,top:double,w:double,first:boolean,last:boolean,head:boolean,center:boolean>>"


def char_width(c: str) -> float:
    """A character's width in ems."""
    if c in WIDTHS:
        return WIDTHS[c]
    return CAPITAL if "A" <= c <= "Z" or "À" <= c <= "Þ" else OTHER


def text_width(text: Column) -> Column:
    """A text's width in ems, natively."""
    n = lambda cls: F.regexp_count(text, F.lit(f"[{cls}]"))
    by_width: dict[float, str] = {}
    for c, w in WIDTHS.items():
        by_width[w] = by_width.get(w, "") + ("\\" + c if c in "[]-|" else c)
    named = sum((n(cls) * w for w, cls in by_width.items()), F.lit(0.0))
    known = n("".join(by_width.values()))
    capitals = n("A-ZÀ-Þ") - n("IMW")
    return named + capitals * CAPITAL + (F.length(text) - known - capitals) * OTHER


def _layout(paras: list, px: float, text_w: float, text_h: float, indent: float, line_mul: float, para_gap: float, head_gap: float) -> list[dict]:
    """Greedy lines and screens of one unit's paragraphs (para, text, heading, center, cont)."""
    widths: dict[str, float] = {}

    def measure(word: str) -> float:
        if word not in widths:
            widths[word] = sum(map(char_width, word)) * px
        return widths[word]

    def prefix(word: str, start: int, room: float) -> tuple[int, float]:
        """Characters of a word from start that fit, and their width."""
        n, used = 0, 0.0
        while start + n < len(word) and used + measure(word[start + n]) <= room:
            used += measure(word[start + n])
            n += 1
        return n, used

    step, space = px * LINE_HEIGHT * line_mul, char_width(" ") * px
    lines: list[dict] = []
    screen, on_screen, y = 0, 0, 0.0
    for k, p in enumerate(paras):
        words = [w for w in p["text"].split(" ") if w]
        if not words:
            continue
        if on_screen:
            y += step * (para_gap + (head_gap if p["heading"] else 0))
        first, i, cut = True, 0, 0  # the next word, and how much of it is set
        while i < len(words):
            lead = indent if first and not (p["heading"] or p["center"] or (k == 0 and p["cont"])) else 0.0
            room = max(text_w - lead, 2 * space)
            used, own = 0.0, []
            while i < len(words):
                before = used + (space if own else 0)
                n, wide = prefix(words[i], cut, room - before) if cut else (len(words[i]), measure(words[i]))
                if cut + n < len(words[i]) or before + wide > room:
                    break
                used = before + wide
                own.append(words[i][cut:])
                i, cut = i + 1, 0
            if not own:  # a word that is too long for a line: as much of it as fits, one character at least
                n, used = prefix(words[i], cut, room)
                n, used = (n, used) if n else (1, measure(words[i][cut]))
                own, cut = [words[i][cut : cut + n]], cut + n
                if cut == len(words[i]):
                    i, cut = i + 1, 0
            full = y + step > text_h + 0.5
            lone_heading = first and p["heading"] and on_screen >= 2 and y + 2 * step > text_h + 0.5
            if (full or lone_heading) and on_screen:
                screen, on_screen, y = screen + 1, 0, 0.0
            x = max(0.0, (text_w - used) / 2) if p["center"] else lead
            lines.append(
                {"screen": screen, "line_no": len(lines), "para": p["para"], "text": " ".join(own), "x": x, "top": y, "w": used, "first": first,
                 "last": i == len(words), "head": bool(p["heading"]), "center": bool(p["center"])}
            )
            y, on_screen, first = y + step, on_screen + 1, False
    return lines


def screen_lines(
    paragraphs: DataFrame, *keys: str, px: float = 18.0, text_w: float = TEXT_W, text_h: float = TEXT_H, indent: float | None = None,
    line_mul: float = LINE_MUL, para_gap: float = PARA_GAP, head_gap: float = HEAD_GAP,
) -> DataFrame:
    """Rows (keys, screen, line_no, para, text, x, top, w, first, last, head, center) from (keys, para, text, heading[, center, cont]).

    A unit's paragraphs are one small list, laid out by one loop; units are dealt over all tasks. indent is px by default.
    """
    lead = px if indent is None else indent
    flag = lambda c: F.col(c) if c in paragraphs.columns else F.lit(False)
    para = F.struct("para", "text", "heading", flag("center").alias("center"), flag("cont").alias("cont"))

    def lay(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda unit: _layout(unit, px, text_w, text_h, lead, line_mul, para_gap, head_gap))

    lay.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    units = paragraphs.groupBy(*keys).agg(F.array_sort(F.collect_list(para)).alias("paras"))
    laid = units.select(*keys, F.explode(F.pandas_udf(lay, SCREEN_LINE)("paras")).alias("l"))
    return laid.select(*keys, "l.*")


def screens(lines: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, screen, first_line, n_lines, first_para), what a screen's index holds."""
    return lines.groupBy(*keys, "screen").agg(F.min("line_no").alias("first_line"), F.count("*").alias("n_lines"), F.min("para").alias("first_para"))


def ordinals(index: DataFrame, book: str, unit: str) -> DataFrame:
    """screens() with the place of each screen in its book, and the unit and screen before and after it."""
    own = Window.partitionBy(book).orderBy(unit, "screen")
    at = F.struct(F.col(unit).alias("unit"), "screen")
    return index.select("*", F.row_number().over(own).alias("ordinal"), F.lag(at).over(own).alias("previous"), F.lead(at).over(own).alias("next"))


def screen_of_paragraph(lines: DataFrame, para: Column, *keys: str) -> DataFrame:
    """Rows (keys, screen): the first screen with a line of paragraph ``para`` or a later one."""
    return lines.where(F.col("para") >= para).groupBy(*keys).agg(F.min("screen").alias("screen"))
