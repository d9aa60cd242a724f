"""Runs to lines: as a stream of rows, whatever batches these come in."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import lines


def test_pages_are_folded_as_they_come():
    """A task holds one page and a batch of lines; before, a batch held thousands of pages."""
    schema = pa.schema([("page", pa.int64()), ("line_no", pa.int32()), ("text", pa.string()), *[(c, pa.float64()) for c in ("y", "x", "x_end", "size", "gap_x", "gap_w")], ("gap_off", pa.int32())])
    pulled = []

    def batches():
        for b in range(40):
            pulled.append(b)
            rows = [{"page": i // 3, "text": f"t{i}", "x": 10.0, "y": 100.0 - i % 3 * 20, "size": 10.0, "width": 10.0} for i in range(b * 1000, b * 1000 + 1000)]
            yield pa.RecordBatch.from_pylist(rows)

    out = lines._folded(["page"], schema)(batches())
    first = next(out)
    assert len(first) >= lines.BATCH and len(pulled) < 10
    got = [r for b in (first, *out) for r in b.to_pylist()]
    assert [(r["page"], r["line_no"], r["text"]) for r in got] == [(i // 3, i % 3, f"t{i}") for i in range(40_000)]


def test_runs_in_any_order_make_the_same_lines(spark):
    rng = random.Random(1)
    rows = [(p, f"w{p} {i} {k}", 50.0 + 60 * k, 700.0 - 14 * i, 10.0, 50.0, 50.0, 0.0) for p in (None, 1, 2) for i in range(30) for k in range(3)]
    rng.shuffle(rows)
    runs = spark.createDataFrame(rows, "page int, text string, x double, y double, size double, width double, dx double, dy double")
    got = lines.group_lines(runs.repartition(3), "page").orderBy("page", "line_no").collect()
    assert [(r["page"], r["line_no"], r["text"]) for r in got] == [(p, i, " ".join(f"w{p} {i} {k}" for k in range(3))) for p in (None, 1, 2) for i in range(30)]
    assert "collect_list" not in lines.group_lines(runs, "page").groupBy("page").agg(F.count("*"))._jdf.queryExecution().optimizedPlan().toString()
