"""Queries over pages of lines, screens and reading state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, lines, progress, reflow
from ..sources import library as shelf_source
from ..sources import xhtml
from .common import table

WORDS = 12


def page_lines(spark: SparkSession, d: str) -> DataFrame:
    """Documents as pages of lines of WORDS words, a smaller page number below a third of them, a gutter in a quarter."""
    docs = table(spark, d, "documents").select("doc_id", F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ").alias("ws"))
    n = F.ceil(F.size("ws") / WORDS)
    rows = docs.select("doc_id", "ws", n.alias("n"), F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))).alias("line_no"))
    k = F.col("line_no")
    text = F.array_join(F.slice("ws", k * WORDS + 1, WORDS), " ")
    last = (k == F.col("n") - 1) & (F.col("doc_id") % 3 == 0)
    rows = rows.select("doc_id", "line_no", F.when(last, k.cast("string")).otherwise(text).alias("text"), last.alias("last"))
    # The gap is at the first space after the middle of the text, if there is one.
    off = F.call_function("locate", F.lit(" "), F.col("text"), F.floor(F.length("text") / 2).cast("int") + 1) - 1
    gap = (F.col("doc_id") % 4 == 0) & (off >= 0)
    return rows.select(
        "doc_id", "line_no", "text",
        F.when(k % 7 == 0, 86.0).otherwise(72.0).alias("x"),
        (F.lit(72.0) + F.length("text") * 5.0).alias("x_end"),
        (F.lit(700.0) - k * 12.0 - F.floor(k / 7) * 10.0 - F.when(F.col("last"), 30.0).otherwise(0.0)).alias("y"),
        F.when(k == 0, 18.0).otherwise(10.0).alias("size"),
        F.when(gap, 280.0 + (k % 3)).otherwise(0.0).alias("gap_x"),
        F.when(gap, 24.0).otherwise(0.0).alias("gap_w"),
        F.when(gap, off).otherwise(-1).cast("int").alias("gap_off"),
    )


def line_geometry(spark: SparkSession, d: str) -> DataFrame:
    return page_lines(spark, d).groupBy("doc_id").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min_by("x", "line_no").alias("x"), F.max("x_end").alias("x_end"), F.min("y").alias("y"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Three runs a line, on pages turned by doc_id, every eleventh upright."""
    rows = page_lines(spark, d).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(2))))
    third = F.ceil(F.length("text") / 3).cast("int")
    text = F.substring(F.col("text"), F.col("k") * third + 1, third)
    vertical = (F.col("doc_id") + F.col("line_no")) % 11 == 0
    width = F.length("piece") * 5.0
    rows = rows.withColumns({"piece": text, "up": vertical}).where("piece <> ''")
    return rows.select(
        "doc_id", "line_no", "k", F.col("piece").alias("text"), (F.lit(72.0) + F.col("k") * third * 5.0 + F.col("k") * 4.0).alias("x"), "y", "size",
        width.alias("width"), F.when(F.col("up"), 0.0).otherwise(width).alias("dx"), F.when(F.col("up"), width).otherwise(0.0).alias("dy"),
        (F.col("doc_id") % 4 * 90 - 360).cast("int").alias("rotate"), F.lit(0.0).alias("mb_x0"), F.lit(0.0).alias("mb_y0"), F.lit(595.0).alias("mb_x1"), F.lit(842.0).alias("mb_y1"),
    )


def run_orientation(spark: SparkSession, d: str) -> DataFrame:
    shown = lines.displayed(_runs(spark, d))
    return shown.groupBy("doc_id").agg(
        F.count("*").alias("runs"), F.count_if(lines.is_vertical()).alias("runs_vertical"), F.min("x").alias("x"), F.max("y").alias("y"),
        F.sum(lines.usable_advance()).alias("advance"), F.first(lines.normal_rotation(F.col("rotate"))).alias("turn"),
    )


def run_lines(spark: SparkSession, d: str) -> DataFrame:
    """Runs of upright pages grouped to lines again."""
    runs = _runs(spark, d).where("dy = 0").withColumn("rotate", F.lit(0))
    return lines.group_lines(runs.select("doc_id", "text", "x", "y", "size", "width", "dx", "dy"), "doc_id")


def body_percentiles(spark: SparkSession, d: str) -> DataFrame:
    rows = page_lines(spark, d)
    return rows.groupBy("doc_id").agg(reflow.body_size().alias("body"), reflow.percentile(F.col("x_end"), 0.9).alias("p90"), reflow.percentile(F.col("x"), 0.25).alias("p25"))


def gutter_detect(spark: SparkSession, d: str) -> DataFrame:
    return reflow.gutters(page_lines(spark, d), "doc_id")


def column_split(spark: SparkSession, d: str) -> DataFrame:
    return reflow.in_columns(page_lines(spark, d), "doc_id").select("doc_id", "line_no", "col", "text", "x", "x_end", F.col("order").cast("int").alias("place"))


def _measured(spark: SparkSession, d: str) -> DataFrame:
    return reflow.measures(reflow.in_columns(page_lines(spark, d), "doc_id"), "doc_id")


def leading(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("doc_id", "leading")


def justified_flag(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("doc_id", "x0", "x1", "justified")


def running_heads(spark: SparkSession, d: str) -> DataFrame:
    rows = reflow.without_running_heads(page_lines(spark, d), "doc_id")
    return rows.where("dropped").select("doc_id", "line_no", "col", "text")


def reflow_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return reflow.reflow(page_lines(spark, d), "doc_id").select("doc_id", "para", "text", "n_lines", "col", "joins")


def paragraph_flags(spark: SparkSession, d: str) -> DataFrame:
    return reflow.reflow(page_lines(spark, d), "doc_id").select("doc_id", "para", "heading", "center", "cont", "open")


def reflow_stats(spark: SparkSession, d: str) -> DataFrame:
    return reflow.page_stats(page_lines(spark, d), "doc_id")


def glyph_width(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.round(layout.text_width(F.col("line")), 6).alias("em"))


def layout_screens(spark: SparkSession, d: str) -> DataFrame:
    paras = xhtml.paragraphs(table(spark, d, "pages"), "page_id")
    return layout.screens(layout.screen_lines(paras, "page_id"), "page_id")


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    return layout.screen_lines(xhtml.paragraphs(table(spark, d, "pages"), "page_id"), "page_id")


def _book_screens(spark: SparkSession, d: str) -> DataFrame:
    """Pages as units of books of ten."""
    index = layout_screens(spark, d)
    return index.withColumns({"book": F.floor(F.col("page_id") / 10), "unit": (F.col("page_id") % 10).cast("int")})


def screen_ordinals(spark: SparkSession, d: str) -> DataFrame:
    rows = layout.ordinals(_book_screens(spark, d).drop("page_id"), "book", "unit")
    return rows.select("book", "unit", "screen", "ordinal", F.col("previous.unit").alias("previous_unit"), F.col("previous.screen").alias("previous_screen"), F.col("next.unit").alias("next_unit"), F.col("next.screen").alias("next_screen"))


def relayout(spark: SparkSession, d: str) -> DataFrame:
    """The screen at 24 px that holds the paragraph on top of each page's second screen at 18 px."""
    paras = xhtml.paragraphs(table(spark, d, "pages"), "page_id")
    small = layout.screens(layout.screen_lines(paras, "page_id"), "page_id").where("screen = 1").select("page_id", F.col("first_para").alias("wanted"))
    large = layout.screen_lines(paras, "page_id", px=24.0).join(small, "page_id")
    return layout.screen_of_paragraph(large, F.col("wanted"), "page_id", "wanted")


#: A day in the unit of touches' ``at``.
DAY = 86_400 * 10**9


def touches(spark: SparkSession, d: str) -> DataFrame:
    """Events as touches of books named by user, in order of time."""
    e = table(spark, d, "events")
    seq = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)") * 1000 + F.col("event_id") % 1000
    return e.select(
        F.concat(F.lit("book "), F.col("user_id").cast("string"), F.lit(".epub")).alias("name"), (F.col("user_id") * 97).alias("size"),
        (F.col("event_id") % 50).alias("unit"), F.lit(50).cast("long").alias("total"), (F.col("event_id") % 7).alias("para"), (F.col("event_id") % 40).alias("px"),
        seq.alias("at"), "event_id", F.struct(seq.alias("at"), "event_id").alias("seq"),
    )


def progress_latest(spark: SparkSession, d: str) -> DataFrame:
    return progress.latest(touches(spark, d)).select("name", "size", "unit", "total", "para", "px", "event_id")


def progress_saves(spark: SparkSession, d: str) -> DataFrame:
    rows = touches(spark, d).withColumn("unit", F.col("event_id") % 3)
    return progress.saves(rows, "at", DAY).select("name", "size", "unit", "total", "para", "px", "event_id")


def progress_lru(spark: SparkSession, d: str) -> DataFrame:
    return progress.recent(touches(spark, d)).select("name", "size", "event_id")


def _library(spark: SparkSession, d: str) -> DataFrame:
    """Files named by user: every one of the first thousand has a book, in four formats."""
    users = table(spark, d, "events").select("user_id").distinct()
    ext = F.element_at(F.array(*[F.lit(x) for x in ("epub", "PDF", "Txt", "cbz")]), (F.col("user_id") % 4 + 1).cast("int"))
    return users.select(F.concat(F.lit("book "), F.col("user_id").cast("string"), F.lit("."), ext).alias("name"), (F.col("user_id") * 97).alias("size"))


def shelf_percent(spark: SparkSession, d: str) -> DataFrame:
    books = progress.latest(touches(spark, d)).select("name", "size", "unit", "total")
    rows = progress.shelf(_library(spark, d), books)
    return rows.select("name", "size", progress.size_text(F.col("size") * 1000).alias("size_text"), "unit", "percent")


def resume_point(spark: SparkSession, d: str) -> DataFrame:
    seen = touches(spark, d)
    places = progress.latest(seen.where("event_id % 3 = 0")).select("name", "size", "unit", "para", "px")
    units = seen.select("name", "size", "unit", (F.col("event_id") % 3).alias("n_screens"))
    return progress.resume_points(seen.select("name", "size").distinct(), places, units)


def progress_file(spark: SparkSession, d: str) -> DataFrame:
    """The list as the lines of its file, read back."""
    top = progress.recent(touches(spark, d))
    return progress.parsed(progress.file_lines(top)).select("name", "size", "unit", "total", "para", "px", F.col("place").cast("int"))


def library_scan(spark: SparkSession, d: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".epub", ".PDF", ".Txt", ".zip")]), (F.col("page_id") % 4 + 1).cast("int"))
    files = table(spark, d, "pages").select(F.concat(F.lit("Page "), F.col("page_id").cast("string"), ext).alias("name"), F.octet_length("html").cast("long").alias("size"))
    return shelf_source.library(files)


def format_counts(spark: SparkSession, d: str) -> DataFrame:
    fmt = shelf_source.format_of(F.col("name"))
    return _library(spark, d).groupBy(fmt.alias("fmt"), shelf_source.kind_of(fmt).alias("kind")).agg(F.count("*").alias("n"))


def xref_merge(spark: SparkSession, d: str) -> DataFrame:
    """Revisions of numbered objects: the newest entry of each number wins when read, the last one in a reconstruction."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("num"), F.col("l_linenumber").alias("rev"), F.col("l_partkey").alias("off"))
    return rows.groupBy("num").agg(F.max_by("off", F.struct("rev", "off")).alias("newest"), F.min_by("off", F.struct("rev", "off")).alias("oldest"))


def trailer_merge(spark: SparkSession, d: str) -> DataFrame:
    """Trailers of a user's events: older ones fill in what newer ones lack, key by key."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 2 == 0, F.col("event_type")).alias("root"), F.when(F.col("event_id") % 3 == 0, F.round("value", 6)).alias("info"))
    newest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col("event_id"))).alias(c)
    return e.groupBy("user_id").agg(newest("root"), newest("info"))


QUERIES = {
    f.__name__: f
    for f in (
        line_geometry, run_orientation, run_lines, body_percentiles, gutter_detect, column_split, leading, justified_flag, running_heads, reflow_paragraphs,
        paragraph_flags, reflow_stats, glyph_width, layout_screens, layout_lines, screen_ordinals, relayout, progress_latest, progress_saves, progress_lru, shelf_percent,
        resume_point, progress_file, library_scan, format_counts, xref_merge, trailer_merge,
    )
}

# The same in SQL.
LINES_SQL = f"""
w AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS ws FROM documents),
wl AS (SELECT doc_id, ws, CAST(ceil(len(ws) / {WORDS}.0) AS BIGINT) AS n, k FROM w, generate_series(0, CAST(ceil(len(ws) / {WORDS}.0) AS BIGINT) - 1) AS g(k)),
wt AS (SELECT doc_id, k AS line_no, (k = n - 1 AND doc_id % 3 = 0) AS is_last,
              CASE WHEN k = n - 1 AND doc_id % 3 = 0 THEN CAST(k AS VARCHAR) ELSE array_to_string(ws[k * {WORDS} + 1:(k + 1) * {WORDS}], ' ') END AS text FROM wl),
wo AS (SELECT *, CASE WHEN doc_id % 4 = 0 AND strpos(substr(text, length(text) // 2 + 1), ' ') > 0 THEN strpos(substr(text, length(text) // 2 + 1), ' ') + length(text) // 2 - 1 ELSE -1 END AS off FROM wt),
lines AS (SELECT doc_id, line_no, text, CASE WHEN line_no % 7 = 0 THEN 86.0::DOUBLE ELSE 72.0::DOUBLE END AS x, 72.0::DOUBLE + length(text) * 5.0::DOUBLE AS x_end,
                 700.0::DOUBLE - line_no * 12.0::DOUBLE - (line_no // 7) * 10.0::DOUBLE - CASE WHEN is_last THEN 30.0::DOUBLE ELSE 0.0::DOUBLE END AS y,
                 CASE WHEN line_no = 0 THEN 18.0::DOUBLE ELSE 10.0::DOUBLE END AS size,
                 CASE WHEN off >= 0 THEN 280.0::DOUBLE + line_no % 3 ELSE 0.0::DOUBLE END AS gap_x, CASE WHEN off >= 0 THEN 24.0::DOUBLE ELSE 0.0::DOUBLE END AS gap_w, off AS gap_off FROM wo)"""
PCT = "list_sort(list({0}) FILTER (({0}) IS NOT NULL))[CAST(floor((count({0}) - 1) * {1} + 0.5) AS BIGINT) + 1]"
BODY_SQL = f"body AS (SELECT doc_id, {PCT.format('CASE WHEN size > 0 THEN size ELSE 10.0::DOUBLE END', '0.5')} AS body FROM lines GROUP BY doc_id)"
GUTTER_SQL = f"""{BODY_SQL},
gc AS (SELECT doc_id, count(*) AS n, {PCT.format("c", "0.5")} AS split, count(c) AS nc FROM
        (SELECT doc_id, CASE WHEN gap_w >= greatest(6.0, body * 1.2) THEN gap_x + gap_w / 2 END AS c FROM lines JOIN body USING (doc_id)) GROUP BY doc_id),
gn AS (SELECT doc_id, count(*) FILTER (gap_w >= greatest(6.0, body * 1.2) AND abs(gap_x + gap_w / 2 - split) <= 595.0 * 0.05) AS near FROM lines JOIN body USING (doc_id) JOIN gc USING (doc_id) GROUP BY doc_id),
gut AS (SELECT doc_id, split FROM gc JOIN gn USING (doc_id) WHERE n >= 8 AND nc >= (n + 1) // 2 AND split BETWEEN 595.0 * 0.28 AND 595.0 * 0.72 AND near >= (n + 1) // 2)"""
COLUMNS_SQL = f"""{GUTTER_SQL},
sp AS (SELECT l.*, split, coalesce(gap_off > 0 AND gap_off < length(text) - 1 AND gap_x <= split AND split <= gap_x + gap_w, FALSE) AS across FROM lines l LEFT JOIN gut USING (doc_id)),
parts AS (SELECT doc_id, line_no, y, size, left(text, gap_off) AS text, x, gap_x AS x_end, 0 AS col FROM sp WHERE across
          UNION ALL SELECT doc_id, line_no, y, size, substr(text, gap_off + 2), gap_x + gap_w, x_end, 1 FROM sp WHERE across
          UNION ALL SELECT doc_id, line_no, y, size, text, x, x_end, CASE WHEN split IS NOT NULL AND x >= split THEN 1 ELSE 0 END FROM sp WHERE NOT across),
cols AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY col, y DESC, x, line_no) - 1 AS INTEGER) AS place FROM parts WHERE text <> '')"""
MEASURES_SQL = f"""{COLUMNS_SQL},
b2 AS (SELECT doc_id, {PCT.format('size', '0.5')} AS body FROM cols GROUP BY doc_id),
st AS (SELECT c.*, body, lag(y) OVER (PARTITION BY doc_id, col ORDER BY place) - y AS dy FROM cols c JOIN b2 USING (doc_id)),
mm AS (SELECT doc_id, body, {PCT.format("x", "0.25")} AS x0, {PCT.format("x_end", "0.9")} AS x1r,
              {PCT.format("CASE WHEN dy > 0.55 * body AND dy < 3.0 * body THEN dy END", "0.5")} AS lead FROM st GROUP BY doc_id, body),
m AS (SELECT doc_id, body, x0, CASE WHEN x1r > x0 THEN x1r ELSE x0 + 595.0 / 2 END AS x1, coalesce(lead, body * 1.2) AS "leading" FROM mm),
j AS (SELECT doc_id, count(*) FILTER (abs(size - m.body) <= 0.15 * m.body) AS n, count(*) FILTER (abs(size - m.body) <= 0.15 * m.body AND x_end >= x1 - 0.35 * m.body) AS flush
      FROM st JOIN m USING (doc_id) GROUP BY doc_id)"""
NUM = "(length(text) <= 10 AND (regexp_full_match(text, '[ .\\-|\\[\\]–—]*[0-9][0-9 .\\-|\\[\\]–—]*') OR regexp_full_match(text, '[ .\\-|\\[\\]–—]*[ivxlcdmIVXLCDM][ivxlcdmIVXLCDM .\\-|\\[\\]–—]*')))"
HEADS_SQL = f"""{MEASURES_SQL},
h0 AS (SELECT c.*, m.body, m."leading", x1 - x0 AS bw, count(*) OVER (PARTITION BY doc_id, col) AS n, count(*) OVER (PARTITION BY doc_id) AS np,
              row_number() OVER (PARTITION BY doc_id, col ORDER BY place) - 1 AS ft, row_number() OVER (PARTITION BY doc_id, col ORDER BY place DESC) - 1 AS fe,
              y - lead(y) OVER (PARTITION BY doc_id, col ORDER BY place) AS gb, lag(y) OVER (PARTITION BY doc_id, col ORDER BY place) - y AS ga FROM cols c JOIN m USING (doc_id)),
h1 AS (SELECT *, coalesce(gb IS NOT NULL AND ((size <= 1.05 * body AND gb > 1.55 * "leading" AND x_end - x < 0.85 * bw) OR (ft = 0 AND size <= 1.40 * body AND {NUM})), FALSE) AS head,
              coalesce(ga IS NOT NULL AND ((size <= 1.05 * body AND ga > 1.55 * "leading" AND x_end - x < 0.85 * bw) OR (fe = 0 AND size <= 1.40 * body AND {NUM})), FALSE) AS foot FROM h0),
h2 AS (SELECT *, lag(head) OVER (PARTITION BY doc_id, col ORDER BY place) AS hb, lag(foot) OVER (PARTITION BY doc_id, col ORDER BY place DESC) AS fa FROM h1),
heads AS (SELECT *, np >= 4 AND n >= 4 AND ((head AND (ft = 0 OR (ft = 1 AND hb))) OR (foot AND (fe = 0 OR (fe = 1 AND fa)))) AS dropped FROM h2)"""
RUNS_SQL = f"""{LINES_SQL},
r0 AS (SELECT doc_id, line_no, k, substr(text, k * CAST(ceil(length(text) / 3.0) AS BIGINT) + 1, CAST(ceil(length(text) / 3.0) AS BIGINT)) AS piece, CAST(ceil(length(text) / 3.0) AS BIGINT) AS third, y, size,
              (doc_id + line_no) % 11 = 0 AS up FROM lines, generate_series(0, 2) AS g(k)),
runs AS (SELECT doc_id, piece AS text, 72.0::DOUBLE + k * third * 5.0::DOUBLE + k * 4.0::DOUBLE AS x, y, size, length(piece) * 5.0::DOUBLE AS width, CASE WHEN up THEN 0.0 ELSE length(piece) * 5.0::DOUBLE END AS dx,
                CASE WHEN up THEN length(piece) * 5.0::DOUBLE ELSE 0.0 END AS dy, doc_id % 4 * 90 AS turn FROM r0 WHERE piece <> ''),
shown AS (SELECT doc_id, width, turn, CASE turn WHEN 90 THEN y WHEN 180 THEN 595.0 - x WHEN 270 THEN 842.0 - y ELSE x END AS x, CASE turn WHEN 90 THEN 595.0 - x WHEN 180 THEN 842.0 - y WHEN 270 THEN x ELSE y END AS y,
                 CASE turn WHEN 90 THEN dy WHEN 180 THEN -dx WHEN 270 THEN -dy ELSE dx END AS dx, CASE turn WHEN 90 THEN -dx WHEN 180 THEN -dy WHEN 270 THEN dx ELSE dy END AS dy FROM runs)"""
TOUCH_SQL = """
t AS (SELECT 'book ' || user_id || '.epub' AS name, CAST(user_id * 97 AS BIGINT) AS size, CAST(event_id % 50 AS BIGINT) AS unit, CAST(50 AS BIGINT) AS total, CAST(event_id % 7 AS BIGINT) AS para,
             CAST(event_id % 40 AS BIGINT) AS px, epoch_us(ts) * 1000 + event_id % 1000 AS seen, event_id FROM events),
latest AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY name, size ORDER BY seen DESC, event_id DESC) = 1)"""
_width = {}
for _c, _w in layout.WIDTHS.items():
    _width[_w] = _width.get(_w, "") + ("\\" + _c if _c in "[]-|" else "''" if _c == "'" else _c)
_named = " + ".join(f"{w} * len(regexp_extract_all(l, '[{cls}]'))" for w, cls in _width.items())
_known = f"len(regexp_extract_all(l, '[{''.join(_width.values())}]'))"
_caps = "(len(regexp_extract_all(l, '[A-ZÀ-Þ]')) - len(regexp_extract_all(l, '[IMW]')))"
ORACLE = {
    "line_geometry": f"WITH {LINES_SQL} SELECT doc_id, count(*) AS n, max(size) AS size, arg_min(x, line_no) AS x, max(x_end) AS x_end, min(y) AS y FROM lines GROUP BY doc_id",
    "run_orientation": f"""WITH {RUNS_SQL} SELECT doc_id, count(*) AS runs, count(*) FILTER (abs(dy) > 1.5 * abs(dx) AND width > 0) AS runs_vertical, min(x) AS x, max(y) AS y,
       sum(CASE WHEN abs(dx) >= width / 2 THEN abs(dx) ELSE width END) AS advance, CAST(max(turn) AS INTEGER) AS turn FROM shown GROUP BY doc_id""",
    "body_percentiles": f"WITH {LINES_SQL}, {BODY_SQL} SELECT doc_id, any_value(body) AS body, {PCT.format('x_end', '0.9')} AS p90, {PCT.format('x', '0.25')} AS p25 FROM lines JOIN body USING (doc_id) GROUP BY doc_id",
    "gutter_detect": f"WITH {LINES_SQL}, {GUTTER_SQL} SELECT doc_id, split FROM gut",
    "column_split": f"WITH {LINES_SQL}, {COLUMNS_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, col, text, x, x_end, place FROM cols",
    "leading": f'WITH {LINES_SQL}, {MEASURES_SQL} SELECT doc_id, "leading" FROM m',
    "justified_flag": f"WITH {LINES_SQL}, {MEASURES_SQL} SELECT doc_id, x0, x1, n >= 4 AND flush >= 0.55 * n AS justified FROM m JOIN j USING (doc_id)",
    "running_heads": f"WITH {LINES_SQL}, {HEADS_SQL} SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, col, text FROM heads WHERE dropped",
    "reflow_stats": f"""WITH {LINES_SQL}, {HEADS_SQL} SELECT doc_id, (SELECT count(*) FROM lines l WHERE l.doc_id = heads.doc_id) AS lines_in, count(*) FILTER (dropped) AS lines_dropped, max(col) + 1 AS columns,
       any_value(body) AS body, any_value("leading") AS "leading" FROM heads GROUP BY doc_id""",
    "glyph_width": f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, round({_named} + {_caps} * {layout.CAPITAL} + (length(l) - {_known} - {_caps}) * {layout.OTHER}, 6)::DOUBLE AS em
FROM (SELECT doc_id, i, ls[i] AS l FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), generate_series(1, len(ls)) AS g(i))""",
    "progress_latest": f"WITH {TOUCH_SQL} SELECT name, size, unit, total, para, px, event_id FROM latest",
    "progress_saves": f"""WITH {TOUCH_SQL}, moves AS (SELECT * REPLACE (event_id % 3 AS unit) FROM t)
SELECT name, size, unit, total, para, px, event_id FROM moves QUALIFY lag(unit) OVER (PARTITION BY name, size ORDER BY seen, unit) IS DISTINCT FROM unit""",
    "progress_lru": f"WITH {TOUCH_SQL} SELECT name, size, event_id FROM latest ORDER BY seen DESC, event_id DESC LIMIT 128",
    "shelf_percent": f"""WITH {TOUCH_SQL},
lib AS (SELECT 'book ' || user_id || '.' || CASE user_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'PDF' WHEN 2 THEN 'Txt' ELSE 'cbz' END AS name, user_id * 97 AS size FROM (SELECT DISTINCT user_id FROM events))
SELECT l.name, CAST(l.size AS BIGINT) AS size, CASE WHEN l.size * 1000 < 1048576 THEN (l.size * 1000 // 1024) || ' KB' ELSE (l.size * 10000 // 1048576 // 10) || ',' || (l.size * 10000 // 1048576 % 10) || ' MB' END AS size_text,
       unit, CASE WHEN total > 0 THEN CAST(least(100, unit * 100 // total) AS BIGINT) END AS percent FROM lib l LEFT JOIN latest t ON l.name = t.name AND l.size = t.size""",
    "resume_point": f"""WITH {TOUCH_SQL}, third AS (SELECT * FROM t WHERE event_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY name, size ORDER BY seen DESC, event_id DESC) = 1),
f AS (SELECT name, size, min(unit) AS fu FROM t WHERE unit < 8 AND event_id % 3 > 0 GROUP BY ALL)
SELECT b.name, b.size, CASE WHEN px BETWEEN 12 AND 34 THEN px ELSE 18 END AS px, coalesce(unit, fu, 0) AS unit, coalesce(para, 0) AS para
FROM (SELECT DISTINCT name, size FROM t) b LEFT JOIN third USING (name, size) LEFT JOIN f USING (name, size)""",
    "progress_file": f"WITH {TOUCH_SQL} SELECT name, size, unit, total, para, px, CAST(row_number() OVER (ORDER BY seen DESC, event_id DESC) + 1 AS INTEGER) AS place FROM latest ORDER BY seen DESC, event_id DESC LIMIT 128",
    "library_scan": """SELECT name, size, fmt FROM (SELECT 'Page ' || page_id || CASE page_id % 4 WHEN 0 THEN '.epub' WHEN 1 THEN '.PDF' WHEN 2 THEN '.Txt' ELSE '.zip' END AS name, CAST(octet_length(encode(html)) AS BIGINT) AS size,
       CASE page_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' END AS fmt FROM pages) WHERE fmt IS NOT NULL ORDER BY lower(name), name LIMIT 128""",
    "format_counts": """SELECT fmt, kind, count(*) AS n FROM (SELECT CASE user_id % 4 WHEN 0 THEN 'epub' WHEN 1 THEN 'pdf' WHEN 2 THEN 'txt' END AS fmt,
       CASE user_id % 4 WHEN 0 THEN 'DOC_EPUB' WHEN 1 THEN 'DOC_PDF' WHEN 2 THEN 'DOC_TXT' END AS kind FROM (SELECT DISTINCT user_id FROM events)) GROUP BY ALL""",
    "xref_merge": """SELECT l_orderkey AS num, arg_max(l_partkey, l_linenumber * 10000000000 + l_partkey) AS newest, arg_min(l_partkey, l_linenumber * 10000000000 + l_partkey) AS oldest FROM lineitem GROUP BY ALL""",
    "trailer_merge": """SELECT user_id, arg_max(event_type, event_id) FILTER (event_id % 2 = 0) AS root, arg_max(round(value, 6), event_id) FILTER (event_id % 3 = 0) AS info FROM events GROUP BY ALL""",
}
