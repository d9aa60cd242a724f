"""Runs of a page to lines (LIN-*). Coordinates are doubles; thresholds are compared as such."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

LINE = "line_no int, text string, y double, x double, x_end double, size double, gap_x double, gap_w double, gap_off int"
#: Runs that are taken from a batch, and lines that make one, at a time.
BATCH = 4096


def normal_rotation(rotate: Column) -> Column:
    """0, 90, 180 or 270."""
    turn = F.pmod(rotate, F.lit(360))
    return (turn - turn % 90).cast("int")


def displayed(runs: DataFrame) -> DataFrame:
    """Runs (x, y, dx, dy) moved to the page's corner (mb_x0, mb_y0, mb_x1, mb_y1) and turned as it is shown (rotate)."""
    turn = normal_rotation(F.col("rotate"))
    x, y, w, h = F.col("x") - F.col("mb_x0"), F.col("y") - F.col("mb_y0"), F.col("mb_x1") - F.col("mb_x0"), F.col("mb_y1") - F.col("mb_y0")
    dx, dy = F.col("dx"), F.col("dy")

    def by_turn(zero, quarter, half, three) -> Column:
        return F.when(turn == 90, quarter).when(turn == 180, half).when(turn == 270, three).otherwise(zero)

    return runs.withColumns(
        {"x": by_turn(x, y, w - x, h - y), "y": by_turn(y, w - x, h - y, x), "dx": by_turn(dx, dy, -dx, -dy), "dy": by_turn(dy, -dx, -dy, dx)}
    )


def is_vertical() -> Column:
    return (F.abs("dy") > 1.5 * F.abs("dx")) & (F.col("width") > 0)


def usable_advance() -> Column:
    return F.when(F.abs("dx") >= F.col("width") / 2, F.abs("dx")).otherwise(F.col("width"))


_BLANK = re.compile("[ \\t\\r\\n]+")


def _fold(runs: list) -> list[dict]:
    """Lines of one page's runs in order: a line's first run sets its baseline and how far others may be from it.

    A gap is measured from the end of the last run and against the size of the line before the new one; gap_off is where the
    space of the widest gap is in the line's text, -1 if there is none or no text on one side of it.
    """
    lines: list[dict] = []
    now: dict | None = None
    for r in runs:
        end = r["x"] + r["width"]
        if now is not None and abs(r["y"] - now["y"]) <= now["reach"]:
            gap = r["x"] - now["pen"]
            if gap > 0.25 * now["size"]:
                if gap > now["gap_w"]:
                    now.update(gap_w=gap, gap_x=now["pen"], before=len(now["parts"]))
                now["parts"].append(" ")
            now["parts"].append(r["text"])
            now.update(size=max(now["size"], r["size"]), pen=end, x_end=max(now["x_end"], end))
        else:
            size = r["size"] if r["size"] > 0 else 10.0
            now = {"parts": [r["text"]], "y": r["y"], "x": r["x"], "size": size, "pen": end, "x_end": max(r["x"], end), "reach": max(0.7, 0.3 * size), "gap_x": 0.0, "gap_w": 0.0, "before": 0}
            lines.append(now)
    kept = []
    for x in lines:
        text = _BLANK.sub(" ", "".join(x["parts"])).strip(" ")
        if text:
            at = len(_BLANK.sub(" ", "".join(x["parts"][: x["before"]])).strip(" "))
            at, gap_w = (at, x["gap_w"]) if 0 < at < len(text) else (-1, 0.0)
            kept.append({"line_no": len(kept), "text": text, "y": x["y"], "x": x["x"], "x_end": x["x_end"], "size": x["size"], "gap_x": x["gap_x"], "gap_w": gap_w, "gap_off": at})
    return kept


def _folded(keys: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Lines of runs that come page by page and in order; of a task's pages one is held at a time."""

    def made(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist(rows, schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, runs, out = None, [], []

        def close() -> None:
            out.extend(dict(zip(keys, now)) | line for line in _fold(runs))

        for batch in batches:
            for start in range(0, len(batch), BATCH):
                rows = batch.slice(start, BATCH).to_pylist()
                for r in rows:
                    page = tuple(r[k] for k in keys)
                    if page != now:
                        if runs:
                            close()
                        now, runs = page, []
                    runs.append(r)
                if len(out) >= BATCH:
                    yield made(out)
                    out = []
        if runs:
            close()
        yield made(out)

    return run


def group_lines(runs: DataFrame, *keys: str) -> DataFrame:
    """Rows (keys, line_no, text, y, x, x_end, size, gap_x, gap_w, gap_off) from runs (keys, text, x, y, size, width, dx, dy).

    Vertical runs are left out. Runs are taken from the top, to 0.7 points, and from the left; those of one line are told by
    its first run, not by their neighbours, so the fold is one loop for each page.
    """
    own = runs.where(~is_vertical())
    row = (-F.round(F.col("y") / 0.7)).alias("_row")
    own = own.select(*keys, row, "x", "text", "y", "size", usable_advance().alias("width"))
    # Rows and not arrays of a page's runs go to Python: of these a batch would hold as many pages as others hold rows.
    ordered = own.repartition(*keys).sortWithinPartitions(*keys, "_row", "x", "text", "y", "size", "width").drop("_row")
    schema = T.StructType([own.schema[k] for k in keys] + T.StructType.fromDDL(LINE).fields)
    return ordered.mapInArrow(_folded(list(keys), to_arrow_schema(schema)), schema)
