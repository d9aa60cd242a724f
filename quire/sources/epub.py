"""EPUB books to chapters, units and paragraphs (SRC-12 to SRC-18, XML-05 to XML-07, XML-12).

A container is opened once for each book, by the standard library; what it holds are rows, and everything after
that is joins: manifest to members, spine to manifest.
"""

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import xhtml

CHUNK, MOST_BLOCKS = 49_152, 1008
CONTAINER = "META-INF/container.xml"


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for book, content in zip(batch["book"], batch["content"]):
            try:
                with zipfile.ZipFile(io.BytesIO(bytes(content or b""))) as z:
                    for i, m in enumerate(z.infolist()):
                        try:
                            rows.append((book, i, m.filename, m.file_size, m.compress_type, z.read(m), None))
                        except Exception as e:  # a damaged member is a row with an error, not a failed task
                            rows.append((book, i, m.filename, m.file_size, m.compress_type, None, type(e).__name__))
            except zipfile.BadZipFile:
                rows.append((book, -1, None, 0, 0, None, "not a ZIP"))
        yield pd.DataFrame(rows, columns=["book", "idx", "name", "usize", "method", "data", "err"])


def members(books: DataFrame) -> DataFrame:
    """Rows (book, idx, name, usize, method, data, err) of books (book, content)."""
    kind = books.schema["book"].dataType.simpleString()
    return books.select("book", "content").mapInPandas(_members, f"book {kind}, idx int, name string, usize long, method int, data binary, err string")


def _first(rows: DataFrame, *keys: str) -> DataFrame:
    """Of members of the same name the first one."""
    return rows.groupBy("book", *keys).agg(F.min_by("data", "idx").alias("data"))


def packages(rows: DataFrame) -> DataFrame:
    """Rows (book, folder, opf, title, author): each book's package file."""
    named = _first(rows.where("name is not null"), "name")
    inner = named.where(F.col("name") == CONTAINER).select("book", F.decode("data", "UTF-8").alias("xml"))
    path = F.get(xhtml.attributes(F.col("xml"), "rootfile", "full-path"), F.lit(0))
    inner = inner.select("book", path.alias("name"))
    opf = inner.join(named, ["book", "name"]).select("book", "name", F.decode("data", "UTF-8").alias("opf"))
    text = lambda tag: F.nullif(xhtml.decode_xml(xhtml.tag_text(F.col("opf"), tag)), F.lit(""))
    return opf.select("book", F.regexp_extract("name", "^(.*)/[^/]*$", 1).alias("folder"), "opf", text("title").alias("title"), text("creator").alias("author"))


def _tags(xml: Column, tag: str) -> Column:
    return F.regexp_extract_all(xml, F.lit(f"(?is)<{xhtml.PREFIX}{tag}[ \\t\\r\\n][^>]*>"), F.lit(0))


def manifest(packs: DataFrame) -> DataFrame:
    """Rows (book, pos, id, name): items by the full names of their members."""
    rows = packs.select("book", "folder", F.posexplode(_tags(F.col("opf"), "item")).alias("pos", "tag"))
    return rows.select("book", "pos", xhtml.attribute(F.col("tag"), "id").alias("id"), resolve_in(F.col("folder"), xhtml.attribute(F.col("tag"), "href")).alias("name"))


def resolve_in(folder: Column, href: Column) -> Column:
    return xhtml.resolve(F.concat_ws("/", folder, href), "")


def spine(packs: DataFrame) -> DataFrame:
    """Rows (book, pos, idref) in reading order."""
    rows = packs.select("book", F.posexplode(_tags(F.col("opf"), "itemref")).alias("pos", "tag"))
    return rows.select("book", "pos", xhtml.attribute(F.col("tag"), "idref").alias("idref"))


def chapters(rows: DataFrame) -> DataFrame:
    """Rows (book, chapter, name, html): spine entries whose item and member exist, numbered from 0."""
    packs = packages(rows)
    items = manifest(packs).join(rows.where("name is not null").select("book", "name").distinct(), ["book", "name"], "left_semi")
    items = items.groupBy("book", "id").agg(F.min_by("name", "pos").alias("name"))
    order = spine(packs).withColumnRenamed("idref", "id").join(items, ["book", "id"])
    numbered = order.withColumn("chapter", F.row_number().over(Window.partitionBy("book").orderBy("pos")) - 1)
    named = _first(rows.where("name is not null"), "name")
    return numbered.join(named, ["book", "name"]).select("book", "chapter", "name", F.decode("data", "UTF-8").alias("html"))


_TAG = re.compile(rb"</?(?:[A-Za-z0-9_.-]+:)?([A-Za-z0-9]*)[^>]*>")
_BLOCKS = {b.encode() for b in xhtml.BLOCKS}


def _plan(data: bytes, chunk: int, most: int) -> list[tuple[int, int]]:
    """Byte ranges of a chapter, cut after a tag once a unit has chunk bytes or most block tags."""
    if len(data) <= chunk:
        return [(0, len(data))]
    cuts, start, blocks = [], 0, 0
    for m in _TAG.finditer(data):
        blocks += m[1].lower() in _BLOCKS
        if m.end() - start >= chunk or blocks >= most:
            cuts.append((start, m.end()))
            start, blocks = m.end(), 0
    return cuts + ([(start, len(data))] if start < len(data) else [])


def units(chaps: DataFrame, chunk: int = CHUNK, most: int = MOST_BLOCKS) -> DataFrame:
    """Rows (book, chapter, part, from, to, first, last, html): chapters cut into units; each cut depends on the one before."""
    kind = chaps.schema["book"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for book, chapter, html in zip(batch["book"], batch["chapter"], batch["html"]):
                data = (html or "").encode()
                plan = _plan(data, chunk, most)
                rows += [(book, chapter, i, a, b, i == 0, i == len(plan) - 1, data[a:b].decode("utf-8", "replace")) for i, (a, b) in enumerate(plan)]
            yield pd.DataFrame(rows, columns=["book", "chapter", "part", "from", "to", "first", "last", "html"])

    return chaps.select("book", "chapter", "html").mapInPandas(
        run, f"book {kind}, chapter int, part int, `from` long, `to` long, first boolean, last boolean, html string"
    )


def paragraphs(parts: DataFrame) -> DataFrame:
    """Rows (book, chapter, part, para, text, heading, cont, open) of units(); cont and open only inside a chapter."""
    rows = xhtml.paragraphs(parts, "book", "chapter", "part", "first", "last")
    own = Window.partitionBy("book", "chapter", "part")
    ends = {"cont": ~F.col("first") & (F.col("para") == F.min("para").over(own)), "open": ~F.col("last") & (F.col("para") == F.max("para").over(own))}
    return rows.withColumns(ends).drop("first", "last")


def _zip(chaps: list[tuple[int, str]], title: str) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip")
        z.writestr(CONTAINER, '<container><rootfiles><rootfile full-path="OEBPS/book.opf"/></rootfiles></container>')
        items = "".join(f'<item id="c{i}" href="text/../text/c{i}.xhtml#x"/>' for i, _ in reversed(chaps))
        refs = "".join(f'<itemref idref="c{i}"/>' for i, _ in chaps)
        z.writestr("OEBPS/book.opf", f'<opf:package><opf:metadata><dc:title>{title}</dc:title><dc:creator>A &amp; B</dc:creator></opf:metadata><opf:manifest>{items}<item id="gone" href="none.xhtml"/></opf:manifest><opf:spine><itemref idref="gone"/>{refs}</opf:spine></opf:package>')
        for i, html in chaps:
            z.writestr(f"OEBPS/text/c{i}.xhtml", html or "")
    return out.getvalue()


def _build(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for chaps, title in batches:
        yield pd.Series([_zip([(c["i"], c["html"]) for c in own], t) for own, t in zip(chaps, title)])


def build(chaps: Column, title: Column) -> Column:
    """EPUB bytes of an array of struct (i, html), in reading order: the inverse, for tests and round trips."""
    return F.pandas_udf(_build, "binary")(chaps, title)
