"""Form XObjects: pictures of a PDF that streams call by name, which may hold all text of a page (CS-12).

Calls make a tree of pages and forms, followed level by level. A form's stream runs once for each resources and state that it is called with, in its own
coordinates; the matrices along a path are multiplied as columns, and a run moves to its page by the product of its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import written
from . import pdf

#: Levels of forms in forms that are followed.
DEEPEST = 8
NUMBER = "[-+]?[0-9]*\\.?[0-9]+"


def _times(a: Column, b: Column) -> Column:
    """The product of two matrices of six numbers: a first, then b."""
    cell = lambda i, j, k=None: a[i] * b[j] + a[i + 1] * b[j + 2] + (b[k] if k else F.lit(0.0))
    return F.array(cell(0, 0), cell(0, 1), cell(2, 0), cell(2, 1), cell(4, 0, 4), cell(4, 1, 5))


def forms(objs: DataFrame) -> DataFrame:
    """Rows (book, num, body, content, matrix, own) of form XObjects that can be read; own: whether it has resources and doesn't use its caller's."""
    matrix = F.regexp_extract("body", "(?s)/Matrix[ \\t\\r\\n]*\\[([^\\]]*)\\]", 1)
    numbers = F.transform(F.regexp_extract_all(matrix, F.lit(NUMBER), F.lit(0)), lambda x: x.cast("double"))
    one = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    rows = objs.where((F.col("status") == "OK") & F.col("body").rlike("/Subtype[ \\t\\r\\n]*/Form\\b"))
    own = F.col("body").rlike("/Resources[ \\t\\r\\n]*(?:<<|[0-9])")
    return rows.select("book", "num", "body", F.decode("data", "ISO-8859-1").alias("content"), F.when(F.size(numbers) == 6, numbers).otherwise(one).alias("matrix"), own.alias("own"))


def _holders(paged: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (book, holder, body): pages, and forms that have resources, as holders of names."""
    pages = paged.select("book", F.concat(F.lit("page "), F.col("unit").cast("string")).alias("holder"), "body")
    return pages.unionByName(own.where("own").select("book", F.concat(F.lit("form "), F.col("num").cast("string")).alias("holder"), "body"))


def _met(calls: DataFrame, names: DataFrame, own: DataFrame) -> DataFrame:
    """``calls`` (book, holder, name and others) of forms that exist, with num, matrix and own, and the holder of what the form itself names."""
    rows = calls.join(names, ["book", "holder", "name"]).join(own.select("book", "num", "matrix", "own"), ["book", "num"])
    return rows.withColumn("holder", F.when(F.col("own"), F.concat(F.lit("form "), F.col("num").cast("string"))).otherwise(F.col("holder")))


def runs(objs: DataFrame, paged: DataFrame, own: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows (book, unit, seq and those of pdf.placed): runs of pages, ``shown`` (book, unit, s as pdf.SHOWN), and of the forms they call, in the order in which they are drawn."""
    shown, own, holders = written(shown, "pdf_shown"), written(own, "pdf_forms"), _holders(paged, own)
    names, fonts = written(pdf.named(objs, holders, "holder", "XObject"), "pdf_xobjects"), written(pdf.fonts(objs, holders, "holder"), "pdf_fonts")
    begun = shown.select("book", "unit", F.concat(F.lit("page "), F.col("unit").cast("string")).alias("holder"), F.explode("s.calls").alias("c"))
    calls = begun.select("book", "unit", "holder", "c.name", F.array("c.at").alias("path"), "c.m", "c.state")
    found = shown.select("book", "unit", F.explode("s.runs").alias("r")).select("book", "unit", F.array("r.at").alias("path"), *pdf.placed(F.col("r")))
    key = ["book", "num", "holder", "state"]
    for _ in range(DEEPEST):
        met = _met(calls, names, own).withColumn("m", _times(F.col("matrix"), F.col("m")))
        met = written(met.select("book", "unit", "path", "num", "holder", "m", "state"), "pdf_calls")
        if met.isEmpty():
            break
        drawn = met.select(*key).distinct().join(own.select("book", "num", "content"), ["book", "num"]).join(fonts, ["book", "holder"], "left")
        drawn = written(drawn.select(*key, F.pandas_udf(pdf._interpret, pdf.SHOWN)("content", "fonts", "state").alias("s")), "pdf_drawn")
        here = met.join(drawn, key)
        each = here.select("book", "unit", "path", "m", F.explode("s.runs").alias("r"))
        found = found.unionByName(each.select("book", "unit", F.array_append("path", F.col("r.at")).alias("path"), *pdf.placed(_moved(F.col("r"), F.col("m")))))
        inner = here.select("book", "unit", "holder", "path", "m", F.explode("s.calls").alias("c"))
        calls = inner.select("book", "unit", "holder", "c.name", F.array_append("path", F.col("c.at")).alias("path"), _times(F.col("c.m"), F.col("m")).alias("m"), "c.state")
    order = Window.partitionBy("book", "unit").orderBy("path")
    return found.withColumn("seq", F.row_number().over(order) - 1).select("book", "unit", "seq", *[c for c in found.columns if c not in ("book", "unit", "path")])


def _moved(run: Column, m: Column) -> Column:
    """A run in the coordinates that a matrix leads to: its place moves, its directions turn."""
    turned = lambda x, y, i: run[x] * m[i] + run[y] * m[i + 2]
    put = {"x": turned("x", "y", 0) + m[4], "y": turned("x", "y", 1) + m[5]}
    put |= {a: turned(f"{a[0]}x", f"{a[0]}y", i) for p in "ud" for i, a in enumerate((f"{p}x", f"{p}y"))}
    return F.struct(*[put.get(n, run[n]).alias(n) for n in ("text", "x", "y", "fs", "ux", "uy", "dx", "dy", "codes", "unmapped")])


def called(objs: DataFrame, paged: DataFrame, own: DataFrame) -> DataFrame:
    """Rows (book, unit, num, depth, n, ops): the forms that a page's streams call, n times at one depth, and how many operators that show text these calls run."""
    own = written(own, "pdf_forms")
    names = written(pdf.named(objs, _holders(paged, own), "holder", "XObject"), "pdf_xobjects")

    def by_name(rows: DataFrame, *keys: str) -> DataFrame:
        bare = F.regexp_replace("content", "(?s)\\((?:[^()\\\\]++|\\\\.)*+\\)", "()")
        each = rows.select(*keys, F.explode(F.regexp_extract_all(bare, F.lit("/([^ /<>\\[\\](){}%\\t\\r\\n]+)[ \\t\\r\\n]+Do(?![A-Za-z0-9])"), F.lit(1))).alias("name"))
        return each.groupBy(*keys, "name").agg(F.count("*").alias("times"))

    inside = written(by_name(own, "book", "num"), "pdf_inside")
    pages = by_name(pdf.contents(objs, paged), "book", "unit")
    calls = pages.select("book", "unit", F.concat(F.lit("page "), F.col("unit").cast("string")).alias("holder"), "name", F.col("times").alias("n"))
    ops = own.select("book", "num", pdf.text_operators(F.col("content")).cast("long").alias("each"))
    found = None
    for depth in range(DEEPEST):
        met = written(_met(calls, names, own).groupBy("book", "unit", "num", "holder").agg(F.sum("n").alias("n")), "pdf_calls")
        here = met.join(ops, ["book", "num"]).select("book", "unit", "num", F.lit(depth).alias("depth"), "n", (F.col("n") * F.col("each")).alias("ops"))
        found = here if found is None else found.unionByName(here)
        if met.isEmpty():
            break
        calls = met.join(inside, ["book", "num"]).select("book", "unit", "holder", "name", (F.col("n") * F.col("times")).alias("n"))
    return found
