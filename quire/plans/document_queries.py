"""Queries over documents as books of every format, and over their PDF files as a report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.tables import fresh_path, written
from ..operators import progress
from ..sources import document, epub, pdf, pdf_xref, shelf
from . import page_queries
from .book_queries import LATIN, pdf_files
from .common import table
from .text_queries import units_sql


def _scanned(doc_id: Column, page: Column) -> Column:
    """Pages that show an image and no text: of every seventh document all, of the others every third."""
    return (doc_id % 7 == 0) | (page % 3 == 0)


def _pdfs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    objs = pdf.objects(pdf_files(spark, d, _scanned))
    return objs, pdf.pages(objs)


def pdf_report(spark: SparkSession, d: str) -> DataFrame:
    return pdf.report(*_pdfs(spark, d)).drop("bytes")


def text_layer_probe(spark: SparkSession, d: str) -> DataFrame:
    """Has any of four sampled pages text?"""
    return pdf.text_layer(*_pdfs(spark, d))


def _revised(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of two revisions, an object for each line: the newer one has every third. It stands first in every fifth file; every third file has bytes before its header."""
    n = F.size(F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = table(spark, d, "documents").select("doc_id", n.alias("n"))

    def entry(off: Column, gen: int) -> Column:
        return F.concat(F.lpad(off.cast("string"), 10, "0"), F.lit(f" {gen:05d} n \n"))

    old = F.concat(F.lit("xref\n0 "), (F.col("n") + 1).cast("string"), F.lit("\n0000000000 65535 f \n"), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n")), lambda i: entry(i * 20 + 15, 0)), ""))
    old = F.concat(old, F.lit("trailer << /Size "), (F.col("n") + 1).cast("string"), F.lit(" /Root 1 0 R /ID [<00> <01>] >>\n"))
    third = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: i % 3 == 0)
    new = F.concat(F.lit("xref\n1 1\n0000000000 00001 f \n"), F.array_join(F.transform(third, lambda i: F.concat(i.cast("string"), F.lit(" 1\n"), entry(i * 20 + 17, 1))), ""))
    rows = rows.select("doc_id", old.alias("old"), new.alias("new"), (F.col("doc_id") % 5 == 0).alias("first"))
    root = F.concat(F.lit("trailer << /Info 4 0 R /Root "), F.when(F.col("doc_id") % 2 == 0, "2").otherwise("1"), F.lit(" 0 R /Prev "))
    whole = F.length("new") + F.length(root) + 14  # its place has ten digits
    rows = rows.withColumn("at", F.when(F.col("first"), whole + 9).otherwise(F.lit(9)))
    newer = F.concat("new", root, F.lpad(F.col("at").cast("string"), 10, "0"), F.lit(" >>\n"))
    start = F.when(F.col("first"), F.lit(9)).otherwise(F.length("old") + 9).cast("string")
    body = F.when(F.col("first"), F.concat(newer, "old")).otherwise(F.concat("old", newer))
    junk = F.when(F.col("doc_id") % 3 == 0, F.lit("junk\n")).otherwise(F.lit(""))
    return rows.select(F.col("doc_id").alias("book"), F.encode(F.concat(junk, F.lit("%PDF-1.4\n"), body, F.lit("startxref\n"), start, F.lit("\n%%EOF\n")), "ISO-8859-1").alias("content"))


def pdf_cross_references(spark: SparkSession, d: str) -> DataFrame:
    return pdf.cross_references(pdf.revisions(_revised(spark, d)))


def pdf_trailers(spark: SparkSession, d: str) -> DataFrame:
    return pdf.trailers(pdf.revisions(_revised(spark, d))).where("key <> 'Prev'")


def _referenced(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files whose tables point at their objects, one for each line (null text: one empty line): its MD5, in a newer revision that of every third line and ``new``.

    By doc_id % 3 tables only, streams only, or a table with a stream for newer readers; in the last two, even lines are in an object stream. Behind the tables stands an object without an entry
    for each fourth line. Every seventh file's startxref points at nothing.
    """
    text = F.coalesce("text", F.lit(""))
    rows = table(spark, d, "documents").select("doc_id", F.transform(F.split(text, "\n"), lambda x: F.md5(x)).alias("ls"), F.transform(F.split(text, "\n"), lambda x: F.md5(F.concat(x, F.lit("new")))).alias("ns"), (F.col("doc_id") % 3).alias("kind"))
    n, kind = F.size("ls"), F.col("kind")
    plain = F.filter(F.sequence(F.lit(1), n), lambda i: (kind == 0) | (i % 2 == 1))
    packed = F.filter(F.sequence(F.lit(1), n), lambda i: (kind != 0) & (i % 2 == 0))
    rows = rows.withColumns({"plain": plain, "packed": packed, "third": F.filter(F.sequence(F.lit(1), n), lambda i: i % 3 == 0), "fourth": F.filter(F.sequence(F.lit(1), n), lambda i: i % 4 == 0)})
    string = lambda c: c.cast("string")
    each = lambda name, f: F.array_join(F.transform(name, f), "")
    digits = lambda c, k: F.lpad(F.hex(c), k, "0")
    obj = lambda i, body: F.concat(F.lpad(string(i), 7, "0"), F.lit(" 0 obj "), body, F.lit(" endobj\n"))
    one = lambda i, digest: obj(i, F.concat(F.lit("("), digest, F.lit(")")))
    line = lambda name, i: F.get(name, i - 1)

    olds, news = each("plain", lambda i: one(i, line("ls", i))), each("third", lambda i: one(i, line("ns", i)))
    names = F.concat(each("packed", lambda i: F.concat(string(i), F.lit(" "), string((i / 2).cast("int") * 35 - 35), F.lit(" "))))
    inner = F.concat(names, each("packed", lambda i: F.concat(F.lit("("), line("ls", i), F.lit(") "))))
    holder = obj(n + 2, F.concat(F.lit("<< /Type /ObjStm /N "), string(F.size("packed")), F.lit(" /First "), string(F.length(names)), F.lit(" >> stream\n"), inner, F.lit("\nendstream")))
    start = F.concat(F.lit("%PDF-1.5\n"), olds, obj(n + 1, F.lit("<< /Type /Catalog >>")), news, F.when(kind == 0, "").otherwise(holder))
    rows = rows.select("*", start.alias("body"), (F.size("plain") * 56 + 9).alias("root"), (F.size("plain") * 56 + 51).alias("newer"))
    held = F.col("newer") + F.size("third") * 56

    lines = lambda name, off: each(name, lambda i: F.concat(string(i), F.lit(" 1\n"), F.lpad(string(off(i)), 10, "0"), F.lit(" 00000 n \n")))
    old_off = lambda i: F.when(kind == 0, i - 1).otherwise(((i - 1) / 2).cast("int")) * 56 + 9
    new_off = lambda i: F.col("newer") + ((i / 3).cast("int") - 1) * 56
    last = F.concat(string(n + 1), F.lit(" 1\n"), F.lpad(string(F.col("root")), 10, "0"), F.lit(" 00000 n \n"))
    root = F.concat(F.lit(" /Root "), string(n + 1), F.lit(" 0 R"))
    tables = lambda found, more: F.concat(F.lit("xref\n"), found, F.lit("trailer <<"), root, more, F.lit(" >>\n"))
    records = lambda name, record: each(name, lambda i: F.concat(*record(i)))
    at = lambda off: (F.lit("01"), digits(off, 8), F.lit("00000000"))
    inside = lambda i: (F.lit("02"), digits(n + 2, 8), digits((i / 2).cast("int") - 1, 8))
    streams = lambda num, index, data, more: obj(num, F.concat(F.lit("<< /Type /XRef /W [1 4 4] /Filter /ASCIIHexDecode /Index ["), index, F.lit("]"), root, more, F.lit(" >> stream\n"), data, F.lit(">\nendstream")))
    singles = lambda name: each(name, lambda i: F.concat(string(i), F.lit(" 1 ")))
    even = F.concat(singles("packed"), string(n + 2), F.lit(" 1"))
    of_packed = F.concat(records("packed", inside), *at(held))

    inner_stream = streams(n + 3, even, of_packed, F.lit(""))  # that of a hybrid
    whole_stream = streams(n + 3, F.concat(singles("plain"), string(n + 1), F.lit(" 1 "), even), F.concat(records("plain", lambda i: at(old_off(i))), *at(F.col("root")), of_packed), F.lit(""))
    place = F.length("body")
    first = F.when(kind == 0, tables(F.concat(lines("plain", old_off), last), F.lit(""))).when(kind == 1, whole_stream)
    first = first.otherwise(F.concat(inner_stream, tables(F.concat(lines("plain", old_off), last), F.concat(F.lit(" /XRefStm "), string(place)))))
    rows = rows.withColumns({"first": first, "prev": place + F.when(kind == 2, F.length(inner_stream)).otherwise(0)})
    prev = F.concat(F.lit(" /Prev "), string(F.col("prev")))
    second = F.when(kind == 1, streams(n + 4, singles("third"), records("third", lambda i: at(new_off(i))), prev)).otherwise(tables(lines("third", new_off), prev))
    dead = each("fourth", lambda i: one(i, F.md5(F.lit("dead"))))
    named = F.when(F.col("doc_id") % 7 == 6, F.lit("0")).otherwise(string(F.length("body") + F.length("first")))
    return rows.select(F.col("doc_id").alias("book"), F.encode(F.concat("body", "first", second, dead, F.lit("startxref\n"), named, F.lit("\n%%EOF\n")), "ISO-8859-1").alias("content"))


def pdf_live_objects(spark: SparkSession, d: str) -> DataFrame:
    """Each object that holds a digest, and where its file's cross-references say that it is."""
    books = written(_referenced(spark, d), "referenced")
    found = pdf_xref.entries(pdf.revisions(books)).select("book", "num", "off", "stream", "place")
    objs = pdf.objects(books).select("book", "num", F.nullif(F.regexp_extract("body", "^ ?\\(([0-9a-f]{32})\\)", 1), F.lit("")).alias("digest")).where("digest is not null")
    return objs.join(found, ["book", "num"], "left")


EXTENSIONS = ("pdf", "txt", "EPUB", "cbz", "txt")


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Documents as books in four formats by doc_id; every second text file is Latin-1 if its characters are, a null text is an empty file."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    pages = F.transform(F.split("text", "\n"), lambda line, i: F.struct(i.alias("i"), F.concat(F.lit("<p>"), F.replace(F.replace(line, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</p>")).alias("html")))
    zips = epub.build(F.coalesce(pages, F.array().cast("array<struct<i:int,html:string>>")), F.concat(F.lit("Book "), F.col("doc_id").cast("string")))
    latin = (F.col("doc_id") % 5 == 4) & ~F.col("text").rlike(LATIN)
    texts = F.when(latin, F.encode("text", "ISO-8859-1")).otherwise(F.encode("text", "UTF-8"))
    kind = F.col("doc_id") % 5
    rest = docs.where(kind != 0)
    rest = rest.select("doc_id", F.when(kind == 2, F.lit(True)).otherwise(False).alias("zip"), "text")
    made = rest.where("zip").select("doc_id", zips.alias("content")).unionByName(rest.where("not zip").select("doc_id", texts.alias("content")))
    files = pdf_files(spark, d, _scanned).where("book % 5 = 0").withColumnRenamed("book", "doc_id")
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.col("doc_id") % 5 + 1).cast("int"))
    name = F.concat(F.lit("book "), F.col("doc_id").cast("string"), F.lit("."), ext)
    return made.unionByName(files).select(F.col("doc_id").alias("book"), name.alias("name"), (F.col("doc_id") * 97).alias("size"), "content")


def document_open(spark: SparkSession, d: str) -> DataFrame:
    return document.opened(_books(spark, d))


def document_card(spark: SparkSession, d: str) -> DataFrame:
    """Cards with the places where users, of the numbers of documents, stopped."""
    books = _books(spark, d)
    places = progress.latest(page_queries.touches(spark, d)).withColumn("name", F.concat(F.lit("book "), F.floor(F.col("size") / 97).cast("string")))
    ext = F.element_at(F.array(*[F.lit(x) for x in EXTENSIONS]), (F.floor(F.col("size") / 97) % 5 + 1).cast("int"))
    places = places.withColumn("name", F.concat("name", F.lit("."), ext))
    return document.cards(document.opened(books).join(books.select("book", "name", "size"), "book"), places)


def document_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return document.paragraphs(_books(spark, d))


def _shelf(spark: SparkSession, d: str) -> str:
    """A folder with a file for each of _books(), a folder inside it for each thousand."""
    folder = fresh_path(spark, "shelf")
    name = F.concat(F.floor(F.col("book") / 1000).cast("string"), F.lit("/"), F.col("name"))
    shelf.write(_books(spark, d).select(name.alias("name"), "content"), folder)
    return folder


def shelf_heads(spark: SparkSession, d: str) -> DataFrame:
    """What the first bytes say of text and PDF files that aren't empty; no others are opened, and of these no more is read."""
    head = chars.SAMPLE + chars.LONGEST
    rows = shelf.read(spark, _shelf(spark, d), "name", "size", "fmt", "head", formats="txt,pdf", least_bytes=1, head_bytes=head)
    text = F.col("fmt") == "txt"
    return rows.select("name", "fmt", F.when(text, F.col("size")).alias("size"), F.when(text, chars.encoding_of(F.col("head"), whole=F.col("size") <= head)).alias("encoding"), F.when(~text, pdf.version(F.col("head"))).alias("version"))


def shelf_open(spark: SparkSession, d: str) -> DataFrame:
    """document_open over files, by their names: each format's files are read by themselves."""
    return document.opened(document.folder(spark, _shelf(spark, d)))


QUERIES = {f.__name__: f for f in (shelf_heads, shelf_open, pdf_report, text_layer_probe, pdf_cross_references, pdf_trailers, pdf_live_objects, document_open, document_card, document_paragraphs)}
_SCANNED = "(doc_id % 7 = 0 OR i % 3 = 0)"
_PAGES = "(SELECT doc_id, i, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), generate_series(1, len(ls)) AS g(i))"
_LATIN = "(doc_id % 5 = 4 AND NOT regexp_matches(text, '[^\\x{00}-\\x{FF}]'))"
_OPEN_SQL = f"""
{units_sql(f"SELECT doc_id, text, {_LATIN} AS latin FROM documents WHERE doc_id % 5 IN (1, 4)")},
un AS (SELECT doc_id, count(*) AS units FROM units GROUP BY doc_id),
ds AS (SELECT doc_id, text, doc_id % 5 AS k, {_LATIN} AS latin, len(string_split(text, chr(10))) AS n, coalesce(units, 0) AS units FROM documents LEFT JOIN un USING (doc_id)),
found AS (SELECT doc_id AS book, CASE k WHEN 0 THEN 'DOC_PDF' WHEN 2 THEN 'DOC_EPUB' WHEN 3 THEN NULL ELSE 'DOC_TXT' END AS kind,
       CASE WHEN k = 2 THEN 'Book ' || doc_id WHEN k = 0 AND text IS NOT NULL THEN CASE WHEN doc_id % 2 = 0 THEN 'Livro (' || doc_id || ')' ELSE 'Título ' || doc_id END END AS title,
       CASE WHEN k = 2 THEN 'A & B' WHEN k = 0 AND text IS NOT NULL THEN 'A (B)' END AS author, CASE WHEN k = 0 AND text IS NOT NULL THEN '1.4' END AS version,
       CASE WHEN k IN (1, 4) AND text <> '' THEN CASE WHEN latin AND length(left(text, 8192)) < octet_length(encode(left(text, 8192))) THEN 'Latin-1' ELSE 'UTF-8' END END AS encoding,
       CAST(CASE WHEN k IN (0, 2) THEN coalesce(n, 0) WHEN k = 3 THEN 0 ELSE units END AS BIGINT) AS units,
       CAST(CASE WHEN k = 0 THEN coalesce(2 * n + 7, 0) WHEN k = 2 THEN coalesce(n, 0) + 3 ELSE 0 END AS BIGINT) AS objects,
       k = 0 AND text IS NOT NULL AS rebuilt, FALSE AS encrypted,
       CASE WHEN k = 3 THEN 'unknown format' WHEN k = 2 AND text IS NULL THEN 'no chapter that can be read' WHEN k <> 2 AND (text IS NULL OR (k <> 0 AND text = '')) THEN 'empty file' END AS error FROM ds)"""
ORACLE = {
    "pdf_report": f"""SELECT doc_id AS book, count(*) AS pages, count(*) AS with_contents, count(*) AS streams_ok, 0::BIGINT AS streams_image, 0::BIGINT AS streams_error,
       count(*) FILTER (NOT {_SCANNED}) AS text_pages, count(*) FILTER (NOT {_SCANNED}) AS text_ops, count(*) FILTER ({_SCANNED}) AS image_pages,
       count(*) AS fonts_type1, 0::BIGINT AS fonts_truetype, count(*) AS fonts_type0, 0::BIGINT AS fonts_other, count(*) AS fonts_to_unicode,
       CASE WHEN count(*) FILTER (NOT {_SCANNED}) = 0 THEN 'no text layer' ELSE 'text' END AS verdict FROM {_PAGES} GROUP BY doc_id""",
    "text_layer_probe": f"""SELECT doc_id AS book, max(n) AS units, count(*) AS sampled, count(*) FILTER (NOT {_SCANNED}) AS with_text, count(*) FILTER (NOT {_SCANNED}) AS text_ops,
       CASE WHEN count(*) FILTER (NOT {_SCANNED}) = 0 THEN 'no text layer' ELSE 'text' END AS verdict FROM {_PAGES} WHERE i - 1 IN (0, n // 4, n // 2, 3 * n // 4) GROUP BY doc_id""",
    "pdf_cross_references": """SELECT doc_id AS book, CAST(i AS INTEGER) AS num, CAST(i * 20 + CASE WHEN i % 3 = 0 THEN 17 ELSE 15 END + CASE WHEN doc_id % 3 = 0 THEN 5 ELSE 0 END AS BIGINT) AS off,
       CAST(CASE WHEN i % 3 = 0 THEN 1 ELSE 0 END AS INTEGER) AS gen FROM (SELECT doc_id, len(string_split(coalesce(text, ''), chr(10))) AS n FROM documents), generate_series(1, n) AS g(i)""",
    "pdf_trailers": """SELECT doc_id AS book, key, CASE key WHEN 'Size' THEN CAST(len(string_split(coalesce(text, ''), chr(10))) + 1 AS VARCHAR) WHEN 'Info' THEN '4 0 R' WHEN 'ID' THEN '[<00> <01>]'
       ELSE CASE WHEN doc_id % 2 = 0 THEN '2 0 R' ELSE '1 0 R' END END AS value FROM documents, (VALUES ('Size'), ('Info'), ('ID'), ('Root')) AS k(key)""",
    "pdf_live_objects": """SELECT doc_id AS book, CAST(i AS INTEGER) AS num,
       CAST(CASE WHEN doc_id % 7 = 6 THEN NULL WHEN i % 3 = 0 THEN (CASE WHEN doc_id % 3 = 0 THEN n ELSE (n + 1) // 2 END) * 56 + 51 + (i // 3 - 1) * 56 WHEN doc_id % 3 = 0 THEN (i - 1) * 56 + 9 WHEN i % 2 = 1 THEN (i - 1) // 2 * 56 + 9 END AS BIGINT) AS off,
       CAST(CASE WHEN doc_id % 7 <> 6 AND doc_id % 3 <> 0 AND i % 3 <> 0 AND i % 2 = 0 THEN n + 2 END AS INTEGER) AS stream, CAST(CASE WHEN doc_id % 7 <> 6 AND doc_id % 3 <> 0 AND i % 3 <> 0 AND i % 2 = 0 THEN i // 2 - 1 END AS INTEGER) AS place,
       md5(CASE WHEN doc_id % 7 = 6 AND i % 4 = 0 THEN 'dead' WHEN i % 3 = 0 THEN ls[i] || 'new' ELSE ls[i] END) AS digest
       FROM (SELECT doc_id, ls, len(ls) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)), generate_series(1, n) AS g(i)""",
    "shelf_heads": f"""SELECT CAST(doc_id // 1000 AS VARCHAR) || '/book ' || doc_id || CASE WHEN doc_id % 5 = 0 THEN '.pdf' ELSE '.txt' END AS name, CASE WHEN doc_id % 5 = 0 THEN 'pdf' ELSE 'txt' END AS fmt,
       CASE WHEN doc_id % 5 <> 0 THEN CAST(CASE WHEN {_LATIN} THEN length(text) ELSE octet_length(encode(text)) END AS BIGINT) END AS size,
       CASE WHEN doc_id % 5 <> 0 THEN CASE WHEN {_LATIN} AND length(left(text, 8192)) < octet_length(encode(left(text, 8192))) THEN 'LATIN1' ELSE 'UTF8' END END AS encoding,
       CASE WHEN doc_id % 5 = 0 THEN '1.4' END AS version FROM documents WHERE doc_id % 5 IN (0, 1, 4) AND (text <> '' OR (doc_id % 5 = 0 AND text = ''))""",
    "shelf_open": f"""WITH RECURSIVE {_OPEN_SQL} SELECT * REPLACE (CAST(book // 1000 AS VARCHAR) || '/book ' || book || CASE book % 5 WHEN 0 THEN '.pdf' WHEN 2 THEN '.EPUB' WHEN 3 THEN '.cbz' ELSE '.txt' END AS book) FROM found""",
    "document_open": f"WITH RECURSIVE {_OPEN_SQL} SELECT * FROM found",
    "document_card": f"""WITH RECURSIVE {_OPEN_SQL}, {page_queries.TOUCH_SQL},
c AS (SELECT f.*, 'book ' || book || CASE book % 5 WHEN 0 THEN '.pdf' WHEN 2 THEN '.EPUB' WHEN 3 THEN '.cbz' ELSE '.txt' END AS name, CAST(book * 97 AS BIGINT) AS size, p.unit AS place
      FROM found f LEFT JOIN latest p ON p.size = f.book * 97)
SELECT book, name, size, title, author, units, error, CASE WHEN error IS NULL THEN CASE kind WHEN 'DOC_PDF' THEN 'PDF-' || version WHEN 'DOC_EPUB' THEN 'EPUB' ELSE 'plain text ' || encoding END END AS format,
       CASE WHEN error IS NULL AND kind = 'DOC_PDF' THEN 'cross-reference rebuilt' END AS warning,
       CASE WHEN error IS NULL AND place IS NOT NULL THEN CASE kind WHEN 'DOC_PDF' THEN 'page ' ELSE 'part ' END || (place + 1) || ' of ' || units END AS resume FROM c""",
}
