"""Books of any format under one contract: opened, read unit by unit, and their card (SRC-09, SRC-10, QRY-02, TXT-08).

Each format keeps its own relations; these are their unions by name. What can't be opened is a row with an error.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.tables import written
from ..operators import lines, reflow
from . import epub, library, pdf, shelf, txt

#: Body size and leading of plain text, which has none of its own.
TXT_BODY, TXT_LEADING = 10.0, 12.0
OTHERS = "DOC_OTHER"
ENCODINGS = {"UTF8": "UTF-8", "LATIN1": "Latin-1"}
COLUMNS = ("book", "kind", "title", "author", "version", "encoding", "units", "objects", "rebuilt", "encrypted", "error")


def kind() -> Column:
    """DOC_PDF, DOC_TXT or DOC_EPUB by a book's name; null for other names."""
    return library.kind_of(library.format_of(F.col("name")))


def _of(books: DataFrame | Callable[[str], DataFrame], wanted: str) -> DataFrame:
    """The books of one format; OTHERS are those of none that is known."""
    if callable(books):
        return books(wanted)
    return books.where(kind().isNull() if wanted == OTHERS else kind() == wanted).select("book", "content")


def folder(spark: SparkSession, path: str) -> Callable[[str], DataFrame]:
    """The files of a folder as books, by their names: for each format a scan that opens no file of another."""

    def books(wanted: str) -> DataFrame:
        rows = shelf.read(spark, path, "name", "content", formats=wanted.removeprefix("DOC_").lower())
        return rows.select(F.col("name").alias("book"), "content")

    return books


def _text_units(books: DataFrame) -> DataFrame:
    """Rows (book, unit, text, cont, open) of text files; each unit is decoded by the encoding of its whole file."""
    files = _of(books, "DOC_TXT").select("book", "content", chars.encoding_of(F.col("content"), whole=True).alias("encoding"))
    cut = txt.unit_flags(txt.units(files, "book", "content"), "book").join(files, "book")
    part = F.substring(F.col("content"), (F.col("from") + 1).cast("int"), (F.col("to") - F.col("from")).cast("int"))
    part = F.when((F.col("unit") == 0) & chars.has_mark(F.col("content")), F.substring(part, F.lit(4), F.octet_length(part))).otherwise(part)
    rows = cut.select("book", "unit", "encoding", part.alias("part"), "cont", "open")
    text = F.when(F.col("encoding") == "UTF8", chars.utf8_text(F.col("part"))).otherwise(chars.latin1_text(F.col("part")))
    return rows.select("book", "unit", text.alias("text"), "cont", "open")


def _epub_units(rows: DataFrame) -> DataFrame:
    """epub.units() of members(), numbered through the book as unit."""
    own = Window.partitionBy("book").orderBy("chapter", "part")
    return epub.units(epub.chapters(rows)).withColumn("unit", F.row_number().over(own) - 1)


def opened(books: DataFrame | Callable[[str], DataFrame]) -> DataFrame:
    """Rows of COLUMNS, one for each of ``books`` (book, name, content; book distinct), or of those of a folder(): what its format says of it, or its error.

    Null content is an empty file. What a format doesn't have is null, 0 or false. Other columns are not read; no books give no rows.
    """
    pdfs = _of(books, "DOC_PDF")
    objs = pdf.objects(pdfs)
    found = pdf.opened(pdfs, objs, pdf.pages(objs)).withColumn("kind", F.lit("DOC_PDF"))

    names = F.create_map(*[F.lit(x) for item in ENCODINGS.items() for x in item])
    texts = _of(books, "DOC_TXT")
    cut = txt.units(texts, "book", "content").groupBy("book").agg(F.count("*").alias("units"))
    empty = F.coalesce(F.octet_length("content"), F.lit(0)) == 0
    texts = texts.join(cut, "book", "left").select(
        "book", F.lit("DOC_TXT").alias("kind"), F.when(~empty, names[chars.encoding_of(F.col("content"), whole=True)]).alias("encoding"), F.coalesce("units", F.lit(0).cast("long")).alias("units"),
        F.when(empty, "empty file").alias("error"),
    )

    zips = _of(books, "DOC_EPUB")
    rows = written(epub.members(zips), "members")
    sums = rows.groupBy("book").agg(F.count("name").alias("objects"), F.max(F.col("name") == epub.CONTAINER).alias("container"))
    packs = epub.packages(rows).groupBy("book").agg(F.first("title").alias("title"), F.first("author").alias("author"))
    cut = _epub_units(rows).groupBy("book").agg(F.count("*").alias("units"))
    zips = zips.select("book").join(sums, "book", "left").join(packs.withColumn("package", F.lit(True)), "book", "left").join(cut, "book", "left")
    error = (
        F.when(F.coalesce("objects", F.lit(0)) == 0, "not a ZIP")
        .when(~F.coalesce("container", F.lit(False)), "no container.xml")
        .when(F.col("package").isNull(), "no package file")
        .when(F.col("units").isNull(), "no chapter that can be read")
    )
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("units", "objects")]
    zips = zips.select("book", F.lit("DOC_EPUB").alias("kind"), "title", "author", *counts, error.alias("error"))

    others = _of(books, OTHERS).select("book", F.lit(0).cast("long").alias("units"), F.lit("unknown format").alias("error"))
    rows = found.unionByName(texts, True).unionByName(zips, True).unionByName(others, True).select(*COLUMNS)
    return rows.fillna({"objects": 0, "rebuilt": False, "encrypted": False})


def paragraphs(books: DataFrame | Callable[[str], DataFrame]) -> DataFrame:
    """Rows (book, kind, unit, para, text, n_lines, heading, center, body, leading, cont, open) of ``books`` (book, name, content), whatever their format.

    Books that can't be opened and units without text have no rows. n_lines and center are null where a format doesn't have them.
    """
    runs = written(pdf.runs(_of(books, "DOC_PDF")), "runs")
    grouped = written(lines.group_lines(lines.displayed(runs), "book", "unit"), "lines")
    measured = reflow.page_stats(grouped, "book", "unit").select("book", "unit", "body", "leading")
    pages = reflow.reflow(grouped, "book", "unit").join(measured, ["book", "unit"], "left").withColumn("kind", F.lit("DOC_PDF"))

    units = written(_text_units(books), "text_units")
    texts = txt.paragraphs(txt.lines(units, "book", "unit"), "book", "unit").join(units.drop("text"), ["book", "unit"])
    own = Window.partitionBy("book", "unit")
    texts = texts.withColumns({
        "kind": F.lit("DOC_TXT"), "heading": F.lit(False), "body": F.lit(TXT_BODY), "leading": F.lit(TXT_LEADING),
        "cont": F.col("cont") & (F.col("para") == F.min("para").over(own)), "open": F.col("open") & (F.col("para") == F.max("para").over(own)),
    })

    parts = written(_epub_units(epub.members(_of(books, "DOC_EPUB"))), "epub_units")
    numbered = parts.select("book", "chapter", "part", "unit")
    marked = epub.paragraphs(parts.drop("unit")).join(numbered, ["book", "chapter", "part"]).withColumn("kind", F.lit("DOC_EPUB"))

    wanted = {"book": None, "kind": None, "unit": "int", "para": "int", "text": None, "n_lines": "int", "heading": None, "center": "boolean", "body": "double", "leading": "double", "cont": None, "open": None}

    def shaped(rows: DataFrame) -> DataFrame:
        cols = {c: F.col(c) if c in rows.columns else F.lit(None) for c in wanted}
        return rows.select(*[(cols[c].cast(t) if t else cols[c]).alias(c) for c, t in wanted.items()])

    return shaped(pages).unionByName(shaped(texts)).unionByName(shaped(marked))


def cards(found: DataFrame, places: DataFrame) -> DataFrame:
    """Rows (book, name, size, title, author, format, units, warning, resume, error) of opened() with name and size, and of places (name, size, unit).

    format says the format with its version or encoding, resume the unit that was read last, from 1, of how many.
    """
    kinds = F.when(F.col("kind") == "DOC_PDF", F.concat(F.lit("PDF-"), F.coalesce("version", F.lit("?")))).when(F.col("kind") == "DOC_TXT", F.concat_ws(" ", F.lit("plain text"), "encoding")).when(F.col("kind") == "DOC_EPUB", F.lit("EPUB"))
    warning = F.concat_ws("; ", F.when(F.col("rebuilt"), "cross-reference rebuilt"), F.when(F.col("encrypted"), "encrypted"))
    unit = F.when(F.col("kind") == "DOC_PDF", "page").otherwise("part")
    rows = found.join(places.select("name", "size", F.col("unit").alias("at")), ["name", "size"], "left")
    resume = F.concat_ws(" ", unit, (F.col("at") + 1).cast("string"), F.lit("of"), F.col("units").cast("string"))
    shown = F.col("error").isNull()
    return rows.select(
        "book", "name", "size", "title", "author", F.when(shown, kinds).alias("format"), "units", F.when(shown, F.nullif(warning, F.lit(""))).alias("warning"),
        F.when(shown & F.col("at").isNotNull(), resume).alias("resume"), "error",
    )
