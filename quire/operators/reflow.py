"""Lines of a page to paragraphs (RFL-*): a page is one array of lines, its measures and running heads are functions of that array, paragraphs one fold over it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.chars import BREAK_HYPHEN, ends_terminal, first_word_length, is_page_number, starts_lower
from ..functions.joining import join_lines, joined_words
from ..functions.stats import percentile, percentile_of

PAGE_WIDTH = 595.0


def body_size() -> Column:
    """The middle line size of a group of lines; a size not above 0 counts as 10."""
    return percentile(F.when(F.col("size") > 0, F.col("size")).otherwise(F.lit(10.0)), 0.5)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often a lambda inside ``f`` uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _body(lines: Column) -> Column:
    return percentile_of(F.transform(lines, lambda w: F.when(w["size"] > 0, w["size"]).otherwise(F.lit(10.0))), 0.5)


def _split(lines: Column, page_width: float) -> Column:
    """Where a page of lines is split; null if it has one column."""

    def of(body: Column) -> Column:
        wide = F.filter(lines, lambda w: w["gap_w"] >= F.greatest(F.lit(6.0), body * 1.2))
        centres = F.filter(F.transform(wide, lambda w: w["gap_x"] + w["gap_w"] / 2), lambda c: c.isNotNull())
        return _let(centres, lambda cs: _let(percentile_of(cs, 0.5), lambda split: found(cs, split)))

    def found(centres: Column, split: Column) -> Column:
        half = F.floor((F.size(lines) + 1) / 2)
        near = F.size(F.filter(centres, lambda c: F.abs(c - split) <= page_width * 0.05))
        return F.when((F.size(lines) >= 8) & (F.size(centres) >= half) & split.between(page_width * 0.28, page_width * 0.72) & (near >= half), split)

    return _let(_body(lines), of)


def gutters(lines: DataFrame, *keys: str, page_width: float = PAGE_WIDTH) -> DataFrame:
    """Rows (keys, split) of pages of two columns: the middle of the gap that most lines have near the middle of the page."""
    pages = lines.groupBy(*keys).agg(F.collect_list(F.struct("size", "gap_x", "gap_w")).alias("lines"))
    return pages.select(*keys, _split(F.col("lines"), page_width).alias("split")).where("split is not null")


def _cut(w: Column, split: Column) -> Column:
    """The one or two parts of a line of a page, by (col, from the top, from the left)."""
    inside = (w["gap_off"] > 0) & (w["gap_off"] < F.length(w["text"]) - 1)
    straddles = split.isNotNull() & inside & split.between(w["gap_x"], w["gap_x"] + w["gap_w"])

    def part(text: Column, x: Column, x_end: Column, col: Column) -> Column:
        return F.struct(col.cast("int").alias("col"), w["y"].isNull().alias("low"), (-w["y"]).alias("down"), x.alias("x"), w["line_no"].alias("line_no"), text.alias("text"), x_end.alias("x_end"), w["y"].alias("y"), w["size"].alias("size"))

    left = part(F.left(w["text"], w["gap_off"]), w["x"], w["gap_x"], F.lit(0))
    right = part(F.substring(w["text"], w["gap_off"] + 2, F.length(w["text"])), w["gap_x"] + w["gap_w"], w["x_end"], F.lit(1))
    plain = part(w["text"], w["x"], w["x_end"], F.when(split.isNotNull() & (w["x"] >= split), 1).otherwise(0))
    return F.when(straddles, F.array(left, right)).otherwise(F.array(plain))


def _columned(lines: DataFrame, *keys: str, page_width: float) -> DataFrame:
    """Rows (keys, lines_in, cols), one for each page that has a line with text: its lines in columns and in order, as an array. The one place where lines are moved.

    Such arrays are opened by the outer explode only: from the plain one Spark infers a filter on their size and pushes it below the columns they are made
    of, so that the lambdas compute those again for each line.
    """
    fields = ("line_no", "text", "x", "x_end", "y", "size", "gap_x", "gap_w", "gap_off")
    pages = lines.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias("lines")).where(F.exists("lines", lambda w: w["text"] != ""))
    parts = _let(_split(F.col("lines"), page_width), lambda split: F.flatten(F.transform("lines", lambda w: _cut(w, split))))
    return pages.select(*keys, F.size("lines").cast("long").alias("lines_in"), F.array_sort(F.filter(parts, lambda w: w["text"] != "")).alias("cols"))


def in_columns(lines: DataFrame, *keys: str, page_width: float = PAGE_WIDTH) -> DataFrame:
    """lines with col (0 or 1) and order: column, from the top, from the left.

    A line whose widest gap holds the gutter is cut in two there; the character at gap_off, its space, goes.
    """
    rows = _columned(lines, *keys, page_width=page_width).select(*keys, F.posexplode_outer("cols").alias("order", "w"))
    return rows.select(*keys, *[F.col(f"w.{c}").alias(c) for c in ("line_no", "y", "size", "text", "x", "x_end", "col")], "order")


def _measures(cols: Column, page_width: float) -> Column:
    """Struct (body, x0, x1, leading, justified) of a page's lines in columns."""

    def known(values: Column) -> Column:
        return F.filter(values, lambda v: v.isNotNull())

    def step(w: Column, i: Column) -> Column:
        above = F.get(cols, i - 1)
        return F.when(above["col"] == w["col"], above["y"] - w["y"])

    def of(body: Column) -> Column:
        steps = F.filter(F.transform(cols, step), lambda dy: (dy > 0.55 * body) & (dy < 3.0 * body))
        x0, x1 = percentile_of(known(F.transform(cols, lambda w: w["x"])), 0.25), percentile_of(known(F.transform(cols, lambda w: w["x_end"])), 0.9)
        ends = F.transform(F.filter(cols, lambda w: F.abs(w["size"] - body) <= 0.15 * body), lambda w: w["x_end"])
        found = F.struct(body.alias("body"), x0.alias("x0"), x1.alias("x1"), F.coalesce(percentile_of(steps, 0.5), body * 1.2).alias("leading"), known(ends).alias("ends"))
        return _let(found, lambda m: _let(F.when(m["x1"] > m["x0"], m["x1"]).otherwise(m["x0"] + page_width / 2), lambda right: whole(m, right)))

    def whole(m: Column, right: Column) -> Column:
        flush = F.size(F.filter(m["ends"], lambda e: e >= right - 0.35 * m["body"]))
        justified = (F.size(m["ends"]) >= 4) & (flush >= 0.55 * F.size(m["ends"]))
        return F.struct(m["body"].alias("body"), m["x0"].alias("x0"), right.alias("x1"), m["leading"].alias("leading"), justified.alias("justified"))

    return _let(_body(cols), of)


def _marked(cols: Column, m: Column, drop: bool) -> Column:
    """A page's lines in columns with dropped: two passes over them, the first says which lines could be a head or foot by themselves."""
    lefts, n_page = F.size(F.filter(cols, lambda w: w["col"] == 0)), F.size(cols)

    def first(w: Column, i: Column, n_left: Column) -> Column:
        below, above = F.get(cols, i + 1), F.get(cols, i - 1)
        gap_below, gap_above = F.when(below["col"] == w["col"], w["y"] - below["y"]), F.when(above["col"] == w["col"], above["y"] - w["y"])
        n = F.when(w["col"] == 0, n_left).otherwise(n_page - n_left)
        top = F.when(w["col"] == 0, i).otherwise(i - n_left)
        short = (w["x_end"] - w["x"]) < 0.85 * (m["x1"] - m["x0"])
        number = (w["size"] <= 1.40 * m["body"]) & is_page_number(w["text"])

        def falls(gap: Column, k: Column) -> Column:
            apart = (w["size"] <= 1.05 * m["body"]) & (gap > 1.55 * m["leading"]) & short
            return F.coalesce(gap.isNotNull() & (apart | ((k == 0) & number)), F.lit(False))

        return F.struct(n.alias("n"), top.alias("top"), (n - 1 - top).alias("end"), falls(gap_below, top).alias("head"), falls(gap_above, n - 1 - top).alias("foot"))

    def second(w: Column, i: Column, marks: Column) -> Column:
        k = F.get(marks, i)
        at_top = k["head"] & ((k["top"] == 0) | ((k["top"] == 1) & F.get(marks, i - 1)["head"]))
        at_end = k["foot"] & ((k["end"] == 0) | ((k["end"] == 1) & F.get(marks, i + 1)["foot"]))
        dropped = F.lit(drop) & (n_page >= 4) & (k["n"] >= 4) & (at_top | at_end)
        return F.struct(*[w[c].alias(c) for c in ("line_no", "text", "x", "x_end", "y", "size", "col")], i.alias("order"), dropped.alias("dropped"))

    marks = _let(lefts, lambda n_left: F.transform(cols, lambda w, i: first(w, i, n_left)))
    return _let(marks, lambda ms: F.transform(cols, lambda w, i: second(w, i, ms)))


def pages_of(lines: DataFrame, *keys: str, page_width: float = PAGE_WIDTH, drop: bool = True) -> DataFrame:
    """Rows (keys, lines_in, m, cols), one for each page that has a line with text: its measures and its lines in columns, each with dropped.

    All measures are folds over one array a page, so lines are read once and moved once.
    """
    pages = _columned(lines, *keys, page_width=page_width)
    pages = pages.withColumn("m", _measures(F.col("cols"), page_width))
    return pages.withColumn("cols", _marked(F.col("cols"), F.col("m"), drop))


def measures(lines: DataFrame, *keys: str, page_width: float = PAGE_WIDTH) -> DataFrame:
    """Rows (keys, body, x0, x1, leading, justified) of pages in columns."""
    pages = lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("order", "col", "x", "x_end", "y", "size"))).alias("cols"))
    return pages.select(*keys, _measures(F.col("cols"), page_width).alias("m")).select(*keys, "m.*")


def without_running_heads(lines: DataFrame, *keys: str, page_width: float = PAGE_WIDTH, drop: bool = True) -> DataFrame:
    """lines in columns with measures and dropped: up to two lines at each end of a column that are set apart, short and no larger than the body, or a page number."""
    rows = pages_of(lines, *keys, page_width=page_width, drop=drop).select(*keys, "m.*", F.explode_outer("cols").alias("w"))
    return rows.select(*keys, "w.*", "body", "x0", "x1", "leading", "justified")


def _starts(lines: list, body: float, leading: float, justified: bool) -> list[int]:
    """The paragraph of each kept line of a page, from 0."""
    out: list[int] = []
    para, n_lines, right, prev = -1, 0, 0.0, None
    for w in lines:
        starts = True
        if prev is not None and w["col"] == prev["col"]:
            gap, dx, indent = prev["y"] - w["y"], w["x"] - prev["x"], max(4.0, 0.55 * body)
            starts = gap <= 0 or gap > 1.55 * leading or dx > indent or (dx < -indent and n_lines > 1) or abs(w["size"] - prev["size"]) > 0.18 * body
            if not starts and not prev["hyphen"]:
                most = max(right, w["x_end"])
                if justified:
                    starts = prev["x_end"] < most - 2.2 * body
                else:
                    starts = prev["x_end"] + 0.5 * body + 0.5 * body * w["first_word"] < most - 0.5 * body
        if starts:
            para, n_lines, right = para + 1, 0, w["x_end"]
        n_lines, right, prev = n_lines + 1, max(right, w["x_end"]), w
        out.append(para)
    return out


def _starts_of_pages(batches: Iterator[tuple]) -> Iterator[pd.Series]:
    for lines, body, leading, justified in batches:
        yield pd.Series([_starts(*page) for page in zip(lines, body, leading, justified)])


_starts_of_pages.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]], "return": Iterator[pd.Series]}


def with_paragraphs(pages: DataFrame, *keys: str) -> DataFrame:
    """Kept lines of pages_of() (with their page's measures) and their paragraph."""
    fields = ["order", "text", "x", "x_end", "y", "size", "col"]

    def line(w: Column) -> Column:
        return F.struct(*[w[c].alias(c) for c in fields], w["text"].rlike(f"[{BREAK_HYPHEN}]$").alias("hyphen"), first_word_length(w["text"]).alias("first_word"))

    measured = ["body", "x0", "x1", "leading", "justified"]
    kept = pages.select(*keys, "m.*", F.transform(F.filter("cols", lambda w: ~w["dropped"]), line).alias("lines"))
    starts = F.pandas_udf(_starts_of_pages, T.ArrayType(T.IntegerType()))("lines", "body", "leading", "justified")
    rows = kept.select(*keys, *measured, F.explode_outer(F.arrays_zip("lines", starts.alias("paras"))).alias("z")).where("z is not null")
    return rows.select(*keys, *measured, *[F.col(f"z.lines.{c}") for c in fields], F.col("z.paras").alias("para"))


def paragraphs(lines: DataFrame, *keys: str, dehyphenate: bool = True) -> DataFrame:
    """Rows (keys, para, text, size, x, x_end, y, n_lines, col, joins, heading, center, cont, open) from with_paragraphs()."""
    grouped = lines.groupBy(*keys, "para", "body", "x0", "x1").agg(
        F.array_sort(F.collect_list(F.struct("order", "text"))).alias("parts"), F.max("size").alias("size"), F.min_by("x", "order").alias("x"),
        F.min_by("x_end", "order").alias("x_end"), F.min_by("y", "order").alias("y"), F.count("*").alias("n_lines"), F.min_by("col", "order").alias("col"),
    )
    texts = F.transform("parts", lambda p: p["text"])
    left, right, width = F.col("x") - F.col("x0"), F.col("x1") - F.col("x_end"), F.col("x1") - F.col("x0")
    own = Window.partitionBy(*keys)
    rows = grouped.withColumn("text", join_lines(texts, dehyphenate))
    few = F.col("n_lines") <= 3
    return rows.select(
        *keys, "para", "text", "size", "x", "x_end", "y", "n_lines", "col",
        (joined_words(texts) if dehyphenate else F.lit(0)).cast("int").alias("joins"),
        ((F.col("size") > 1.12 * F.col("body")) & few).alias("heading"),
        (few & (left > 0.06 * width) & (right > 0.06 * width) & (F.abs(left - right) < 0.12 * width)).alias("center"),
        ((F.col("para") == F.min("para").over(own)) & starts_lower(F.col("text"))).alias("cont"),
        ((F.col("para") == F.max("para").over(own)) & ~ends_terminal(F.col("text"))).alias("open"),
    )


def reflow(lines: DataFrame, *keys: str, page_width: float = PAGE_WIDTH, drop_running: bool = True, detect_columns: bool = True, dehyphenate: bool = True) -> DataFrame:
    """Paragraphs of pages of lines (keys, line_no, text, x, x_end, y, size, gap_x, gap_w, gap_off)."""
    if not detect_columns:
        lines = lines.withColumn("gap_w", F.lit(0.0))
    pages = pages_of(lines, *keys, page_width=page_width, drop=drop_running)
    return paragraphs(with_paragraphs(pages, *keys), *keys, dehyphenate=dehyphenate)


def page_stats(lines: DataFrame, *keys: str, page_width: float = PAGE_WIDTH) -> DataFrame:
    """Rows (keys, lines_in, lines_dropped, columns, body, leading) of pages."""
    dropped = F.size(F.filter("cols", lambda w: w["dropped"])).cast("long")
    columns = F.array_max(F.transform("cols", lambda w: w["col"])) + 1
    return pages_of(lines, *keys, page_width=page_width).select(*keys, "lines_in", dropped.alias("lines_dropped"), columns.alias("columns"), "m.body", "m.leading")
