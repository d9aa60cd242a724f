"""Queries over books made of pages and documents: EPUB, PDF and codecs, built and read back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.tables import written
from ..operators import lines, reflow
from ..sources import epub, pdf, pdf_forms, xhtml
from .common import table
from .text_queries import PARAS_SQL


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Ten pages a book, in descending order of page_id."""
    rows = table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 10).alias("book")).agg(
        F.reverse(F.array_sort(F.collect_list(F.struct(F.col("page_id").alias("i"), "html")))).alias("chaps")
    )
    return rows.select("book", epub.build(F.col("chaps"), F.concat(F.lit("Book "), F.col("book").cast("string"))).alias("content"))


def spine_order(spark: SparkSession, d: str) -> DataFrame:
    rows = epub.chapters(epub.members(_books(spark, d)))
    return rows.select("book", F.col("chapter").cast("int"), "name", F.octet_length("html").cast("long").alias("bytes"))


def epub_titles(spark: SparkSession, d: str) -> DataFrame:
    return epub.packages(epub.members(_books(spark, d))).select("book", "folder", "title", "author")


def epub_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs numbered through whole chapters, however many units a reader cuts these into."""
    chaps = written(epub.chapters(epub.members(_books(spark, d))), "chapters")
    return xhtml.paragraphs(chaps, "book", "chapter")


def epub_unit_plan(spark: SparkSession, d: str) -> DataFrame:
    """Units of chapters that hold all pages of a book one after another."""
    rows = table(spark, d, "pages").groupBy(F.floor(F.col("page_id") / 25).alias("book")).agg(F.array_sort(F.collect_list(F.struct("page_id", "html"))).alias("ps"))
    chaps = rows.select("book", F.lit(0).alias("chapter"), F.array_join(F.transform("ps", lambda p: p["html"]), "\n").alias("html"))
    return epub.units(chaps).select("book", "part", "from", "to", "first", "last")


def codec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.encode("text", "UTF-8").alias("raw"))
    names = F.element_at(F.array(*[F.lit(x) for x in ("FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode")]), (F.col("doc_id") % 4 + 1).cast("int"))
    rows = docs.withColumn("name", names)
    rows = rows.select("doc_id", "name", codecs.decoded(codecs.encoded(F.col("raw"), F.col("name")), F.array("name")).alias("d"))
    return rows.select("doc_id", "name", F.col("d.status").alias("status"), F.decode("d.data", "UTF-8").alias("text"))


MAP = "1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"


LATIN = r"[^\x00-\xFF]"


def pdf_files(spark: SparkSession, d: str, scanned: Callable[[Column, Column], Column] | None = None, nested: Callable[[Column, Column], Column] | None = None, chained: bool = False) -> DataFrame:
    """Documents as PDF files of a page for each line, whole: as an escaped string if Latin-1 has its characters, else in a font of two bytes with a map to Unicode.

    Pages for which ``scanned`` (doc_id, page from 1) holds show an image instead; those for which ``nested`` holds call a form that calls another, turned, with the line.
    If ``chained``, contents are in hexadecimal, and they, their filter and their length stand behind one to five references. Titles are in UTF-16 in every second file, else escaped.
    """
    rows = table(spark, d, "documents").select("doc_id", F.split("text", "\n").alias("ls"))
    n = F.size("ls")
    kids = F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.concat((i * 2 + 5).cast("string"), F.lit(" 0 R"))), " ")

    def shown(line: Column) -> Column:
        plain = F.concat(F.lit("/F1 10 Tf 20 100 Td ("), F.regexp_replace(line, r"([()\\])", r"\\$1"), F.lit(") Tj"))
        wide = F.concat(F.lit("/F2 10 Tf 20 100 Td <"), F.hex(F.encode(line, "UTF-16BE")), F.lit("> Tj"))
        return F.when(line.rlike(r"[^\x20-\x7E\xA0-\xFF]"), wide).otherwise(plain)

    def drawn(z: Column) -> Column:
        text = shown(z["ls"])
        return text if scanned is None else F.when(scanned(F.col("doc_id"), z["i"]), F.lit("q 400 0 0 200 0 0 cm /I1 Do Q")).otherwise(text)

    def forms(z: Column) -> tuple[Column, Column]:
        """What a page's resources name and the objects behind it: the outer form has resources, the inner one uses them."""
        if nested is None:
            return F.lit(""), F.lit("")
        is_nested, first = nested(F.col("doc_id"), z["i"]), n * 2 + 8 + z["i"] * 2
        outer, inner = first.cast("string"), (first + 1).cast("string")
        made = F.concat(
            outer, F.lit(" 0 obj << /Type /XObject /Subtype /Form /Matrix [1 0 0 1 5 7] /Resources << /XObject << /X2 "), inner,
            F.lit(" 0 R >> /Font << /F1 3 0 R /F2 4 0 R >> >> >> stream\nq .5 0 0 .5 3 4 cm /X2 Do Q\nendstream endobj\n"), inner,
            F.lit(" 0 obj << /Type /XObject /Subtype /Form /Matrix [0 1 -1 0 0 0] >> stream\nBT "), shown(z["ls"]), F.lit(" ET\nendstream endobj\n"),
        )
        return F.when(is_nested, F.concat(F.lit(" /XObject << /X1 "), outer, F.lit(" 0 R >>"))).otherwise(""), F.when(is_nested, made).otherwise("")

    def content(z: Column) -> Column:
        return drawn(z) if nested is None else F.when(nested(F.col("doc_id"), z["i"]), F.lit("ET q 2 0 0 2 10 20 cm /X1 Do Q BT")).otherwise(drawn(z))

    def stream(z: Column) -> tuple[Column, Column]:
        """What a page says of its contents, and their objects."""
        num, whole = (z["i"] * 2 + 6).cast("string"), F.concat(F.lit("BT "), content(z), F.lit(" ET"))
        if not chained:
            return num, F.concat(num, F.lit(" 0 obj << >> stream\n"), whole, F.lit("\nendstream endobj\n"))
        last, far = (F.col("doc_id") + z["i"]) % 5 + 1, F.lpad(num, 6, "0")  # numbers of seven digits are no page's
        digits = F.concat(F.hex(F.encode(whole, "ISO-8859-1")), F.lit(">"))
        behind = F.transform(F.sequence(F.lit(1), last.cast("int")), lambda k: F.concat((10 - k).cast("string"), far, F.lit(" 0 obj "), F.when(k == last, num).otherwise(F.concat((9 - k).cast("string"), far)), F.lit(" 0 R endobj\n")))
        return F.concat(F.lit("9"), far), F.concat(
            F.array_join(behind, ""), num, F.lit(" 0 obj << /Filter 4"), far, F.lit(" 0 R /Length 3"), far, F.lit(" 0 R >> stream\n"), digits, F.lit("\nendstream endobj\n4"), far,
            F.lit(" 0 obj [/ASCIIHexDecode] endobj\n3"), far, F.lit(" 0 obj 2"), far, F.lit(" 0 R endobj\n2"), far, F.lit(" 0 obj "), F.length(digits).cast("string"), F.lit(" endobj\n"),
        )

    page = F.array_join(
        F.transform(
            F.arrays_zip("ls", F.sequence(F.lit(1), n).alias("i")),
            lambda z: F.concat(
                (z["i"] * 2 + 5).cast("string"), F.lit(" 0 obj << /Type /Page /MediaBox [0 0 400 200] /Resources << /Font << /F1 3 0 R /F2 4 0 R >>"), forms(z)[0], F.lit(" >> /Contents "), stream(z)[0],
                F.lit(" 0 R >> endobj\n"), stream(z)[1], forms(z)[1],
            ),
        ),
        "",
    )
    number = F.col("doc_id").cast("string")
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("(Livro \\("), number, F.lit("\\))"))).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(F.concat(F.lit("Título "), number), "UTF-16BE")), F.lit(">")))
    text = F.concat(
        F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids ["), kids, F.lit("] >> endobj\n"),
        F.lit("3 0 obj << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> endobj\n"),
        F.lit("4 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [5 0 R] /ToUnicode 6 0 R >> endobj\n"),
        F.lit(f"5 0 obj << /Type /Font /Subtype /CIDFontType2 /DW 500 >> endobj\n6 0 obj << >> stream\n{MAP}\nendstream endobj\n"), page,
        (n * 2 + 7).cast("string"), F.lit(" 0 obj << /Title "), title, F.lit(" /Author (A \\050B\\051) >> endobj\ntrailer << /Root 1 0 R /Info "), (n * 2 + 7).cast("string"), F.lit(" 0 R >>\n%%EOF\n"),
    )
    return rows.select(F.col("doc_id").alias("book"), F.encode(text, "ISO-8859-1").alias("content"))


def pdf_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = pdf.runs(pdf_files(spark, d))
    return rows.select("book", F.col("unit").cast("int"), "text", "x", "y", "size", "width", "codes", "unmapped")


def _nested(doc_id: Column, page: Column) -> Column:
    return (doc_id + page) % 3 == 0


def pdf_form_runs(spark: SparkSession, d: str) -> DataFrame:
    """pdf_runs where every third page has its line in a form inside a form: half the size and turned, then twice the size, moved at each step."""
    rows = pdf.runs(pdf_files(spark, d, nested=_nested))
    return rows.select("book", F.col("unit").cast("int"), "seq", "text", "x", "y", "size", "width", "dx", "dy", "codes", "unmapped")


def pdf_chained_runs(spark: SparkSession, d: str) -> DataFrame:
    """pdf_runs where contents, filters and lengths are behind chains of references."""
    rows = pdf.runs(pdf_files(spark, d, chained=True))
    return rows.select("book", F.col("unit").cast("int"), "text", "x", "y", "size", "width", "codes", "unmapped")


def pdf_form_calls(spark: SparkSession, d: str) -> DataFrame:
    """The same files: which forms each page calls, how deep, and what text they show."""
    objs = pdf.objects(pdf_files(spark, d, nested=_nested))
    paged = pdf.pages(objs)
    return pdf_forms.called(objs, paged, pdf_forms.forms(objs)).select("book", F.col("unit").cast("int"), "num", "depth", "n", "ops")


def pdf_pages(spark: SparkSession, d: str) -> DataFrame:
    books = pdf_files(spark, d)
    objs = pdf.objects(books)
    text = pdf.contents(objs, pdf.pages(objs)).groupBy("book").agg(F.count("*").alias("pages"), F.sum(pdf.text_operators(F.col("content"))).alias("text_ops"))
    return text.join(books.select("book", pdf.version(F.col("content")).alias("version")), "book")


def pdf_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Documents' PDF files through runs, lines and paragraphs."""
    rows = written(pdf.runs(pdf_files(spark, d)), "runs")
    found = written(lines.group_lines(lines.displayed(rows), "book", "unit"), "lines")
    return reflow.reflow(found, "book", "unit").select("book", F.col("unit").cast("int"), "para", "text", F.col("n_lines").cast("int"))


QUERIES = {f.__name__: f for f in (spine_order, epub_titles, epub_paragraphs, epub_unit_plan, codec_roundtrip, pdf_runs, pdf_form_runs, pdf_chained_runs, pdf_form_calls, pdf_pages, pdf_paragraphs)}
_LS = "(SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), generate_series(1, len(ls)) AS g(i)"
# Characters beyond two bytes are two codes that the map doesn't know.
_PDF_LINES = f"""(SELECT doc_id, i, regexp_replace(ls[i], '[\\x{{10000}}-\\x{{10FFFF}}]', '', 'g') AS t, length(ls[i]) AS n FROM {_LS})"""
_PDF_RUNS = f"""SELECT doc_id AS book, CAST(i - 1 AS INTEGER) AS unit, t AS text, 20.0::DOUBLE AS x, 100.0::DOUBLE AS y, 10.0::DOUBLE AS size, (2 * n - length(t)) * 5.0::DOUBLE AS width,
       CAST(2 * n - length(t) AS INTEGER) AS codes, CAST(2 * (n - length(t)) AS INTEGER) AS unmapped FROM {_PDF_LINES} WHERE t <> ''"""
ORACLE = {
    "spine_order": """SELECT page_id // 10 AS book, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id DESC) - 1 AS INTEGER) AS chapter, 'OEBPS/text/c' || page_id || '.xhtml' AS name,
       CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages""",
    "epub_titles": "SELECT DISTINCT page_id // 10 AS book, 'OEBPS' AS folder, 'Book ' || (page_id // 10) AS title, 'A & B' AS author FROM pages",
    "epub_paragraphs": f"""SELECT p.page_id // 10 AS book, chapter, para, text, heading FROM ({PARAS_SQL}) p
JOIN (SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id // 10 ORDER BY page_id DESC) - 1 AS INTEGER) AS chapter FROM pages) c USING (page_id)""",
    "codec_roundtrip": """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'FlateDecode' WHEN 1 THEN 'ASCIIHexDecode' WHEN 2 THEN 'ASCII85Decode' ELSE 'RunLengthDecode' END AS name, 'OK' AS status, text FROM documents""",
    "pdf_runs": _PDF_RUNS,
    "pdf_form_runs": f"""SELECT doc_id AS book, CAST(i - 1 AS INTEGER) AS unit, 0 AS seq, t AS text, CASE WHEN f THEN -74.0::DOUBLE ELSE 20.0::DOUBLE END AS x, CASE WHEN f THEN 62.0::DOUBLE ELSE 100.0::DOUBLE END AS y,
       10.0::DOUBLE AS size, w AS width, CASE WHEN f THEN 0.0::DOUBLE ELSE w END AS dx, CASE WHEN f THEN w ELSE 0.0::DOUBLE END AS dy, CAST(2 * n - length(t) AS INTEGER) AS codes, CAST(2 * (n - length(t)) AS INTEGER) AS unmapped
FROM (SELECT *, (doc_id + i) % 3 = 0 AS f, (2 * n - length(t)) * 5.0::DOUBLE AS w FROM {_PDF_LINES}) WHERE t <> ''""",
    "pdf_form_calls": f"""SELECT doc_id AS book, CAST(i - 1 AS INTEGER) AS unit, CAST(len(ls) * 2 + 8 + i * 2 + depth AS INTEGER) AS num, depth, 1::BIGINT AS n, CAST(depth AS BIGINT) AS ops
FROM {_LS}, (VALUES (0), (1)) AS v(depth) WHERE (doc_id + i) % 3 = 0""",
    "pdf_pages": f"SELECT doc_id AS book, count(*) AS pages, count(*) AS text_ops, '1.4' AS version FROM {_LS} GROUP BY doc_id",
    "pdf_chained_runs": _PDF_RUNS,
    "pdf_paragraphs": f"""SELECT doc_id AS book, CAST(i - 1 AS INTEGER) AS unit, 0 AS para, p AS text, 1 AS n_lines
FROM (SELECT doc_id, i, trim(regexp_replace(t, '[ \\t\\r\\n]+', ' ', 'g')) AS p FROM {_PDF_LINES}) WHERE p <> ''""",
}
