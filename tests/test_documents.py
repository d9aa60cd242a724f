"""Books of every format under one contract, the PDF report and its samples, on hand-made files."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quire.functions import chars
from quire.plans import ORACLE, QUERIES
from quire.sources import document, epub, pdf

BOOK = "book int, name string, size long, content binary, title string"
SHOWN = b"BT /F1 10 Tf 20 100 Td (%s) Tj ET"
IMAGE = b"q 10 0 0 10 0 0 cm /I1 Do Q"


def pdf_file(contents, info=b"", tail=b""):
    """A file of one page for each of ``contents``; None is a page without any, bytes beginning with a slash are a stream's filter."""
    kids = b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(contents)))
    out = b"%PDF-1.6\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n2 0 obj << /Type /Pages /Kids [" + kids + b"] >> endobj\n"
    out += b"3 0 obj << /Type /Font /Subtype /TrueType /ToUnicode 9 0 R >> endobj\n4 0 obj << /Type /Font /Subtype /MMType1 >> endobj\n"
    for i, c in enumerate(contents):
        at = b"" if c is None else b" /Contents %d 0 R" % (11 + 2 * i)
        out += b"%d 0 obj << /Type /Page /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >>%s >> endobj\n" % (10 + 2 * i, at)
        if c is not None:
            head, body = (b"/Filter " + c, b"xx") if c.startswith(b"/") else (b"", c)
            out += b"%d 0 obj << %s >> stream\n%s\nendstream endobj\n" % (11 + 2 * i, head, body)
    return out + b"5 0 obj << " + info + b" >> endobj\ntrailer << /Root 1 0 R /Info 5 0 R" + tail + b" >>\n"


@pytest.fixture(scope="module")
def books(spark):
    zipped = spark.range(1).select(epub.build(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(f"<p>chapter {i}</p><p>more</p>").alias("html")) for i in (0, 1)]), F.lit("Two")).alias("c")).first()[0]
    info = b"/Title (a \\(b\\) (c) \\351\\\n!) /Author <FEFF0041D83DDE00004200e7>"
    long = ("word " * 700).encode() + b"\n\nsecond unit caf\xe9\n"
    rows = [
        (1, "a.PDF", 1, pdf_file([SHOWN % b"first page of text"], info, b" /Encrypt 8 0 R"), "x"), (2, "b.txt", 2, long, None), (3, "c.epub", 3, bytes(zipped), None), (4, "d.txt", 4, b"", None),
        (5, "e.txt", 5, None, None), (6, "f.epub", 6, b"PK no", None), (7, "g.mobi", 7, b"text", None), (8, None, 8, b"text", None), (9, "h.pdf", 9, b"plain", None),
        (10, "i.pdf", 10, None, None), (11, "j.pdf", 11, b"%PDF-1.2\n1 0 obj << >> endobj", None), (12, "k.txt", 12, b"\xef\xbb\xbfmarked", None),
    ]
    return spark.createDataFrame([(a, b, c, None if d is None else bytearray(d), e) for a, b, c, d, e in rows], BOOK)


def test_every_book_opens_or_says_why_not(books):
    got = {r["book"]: r for r in document.opened(books).collect()}
    assert len(got) == 12
    assert (got[1]["kind"], got[1]["title"], got[1]["author"], got[1]["version"], got[1]["units"]) == ("DOC_PDF", "a (b) (c) é!", "ABç", "1.6", 1)
    assert got[1]["rebuilt"] and got[1]["encrypted"] and got[1]["error"] is None
    assert (got[2]["encoding"], got[2]["units"]) == ("Latin-1", 2) and (got[12]["encoding"], got[12]["units"]) == ("UTF-8", 1)
    assert (got[3]["title"], got[3]["author"], got[3]["units"], got[3]["error"]) == ("Two", "A & B", 2, None)
    errors = {4: "empty file", 5: "empty file", 6: "not a ZIP", 7: "unknown format", 8: "unknown format", 9: "no %PDF- header", 10: "empty file", 11: "no pages"}
    assert {b: r["error"] for b, r in got.items() if r["error"]} == errors


def test_units_of_every_format_are_paragraphs(books):
    got = [(r["book"], r["unit"], r["text"].strip()[-12:], r["body"], r["leading"]) for r in document.paragraphs(books).orderBy("book", "unit", "para").collect()]
    assert got == [
        (1, 0, "page of text", 10.0, 12.0), (2, 0, "rd word word", 10.0, 12.0), (2, 1, "nd unit café", 10.0, 12.0), (3, 0, "chapter 0", None, None), (3, 0, "more", None, None),
        (3, 1, "chapter 1", None, None), (3, 1, "more", None, None), (12, 0, "marked", 10.0, 12.0),
    ]


def test_cards(spark, books):
    places = spark.createDataFrame([("b.txt", 2, 1), ("a.PDF", 99, 0), ("d.txt", 4, 0)], "name string, size long, unit long")
    found = document.opened(books).join(books.select("book", "name", "size"), "book")
    got = {r["book"]: r for r in document.cards(found, places).collect()}
    assert (got[2]["format"], got[2]["resume"]) == ("plain text Latin-1", "part 2 of 2")
    assert (got[1]["format"], got[1]["resume"], got[1]["warning"]) == ("PDF-1.6", None, "cross-reference rebuilt; encrypted")
    assert (got[4]["format"], got[4]["resume"], got[4]["error"]) == (None, None, "empty file")


def test_no_books(books):
    none = books.where("false")
    assert document.opened(none).count() == 0 and document.paragraphs(none).count() == 0


def test_cross_reference_where_it_is_said_to_be(spark):
    body = pdf_file([IMAGE])
    files = [(1, body + b"xref\n0 1\nstartxref\n%d\n%%%%EOF" % len(body)), (2, b"junk" + body + b"xref\n0 1\nstartxref\n%d\n%%%%EOF" % len(body)), (3, body + b"xref\nstartxref\n9\n%%EOF")]
    df = spark.createDataFrame([(n, bytearray(c)) for n, c in files], "book int, content binary")
    objs = pdf.objects(df)
    assert {r["book"]: r["rebuilt"] for r in pdf.opened(df, objs, pdf.pages(objs)).collect()} == {1: False, 2: False, 3: True}


def test_report_and_sampled_pages(spark):
    text = SHOWN % b"some text"
    files = {
        1: [IMAGE, text, text, IMAGE, text], 2: [IMAGE, None, IMAGE], 3: [b"/FooDecode", b"/FooDecode", text], 4: [b"/DCTDecode"], 5: [text], 6: [None],
    }
    objs = pdf.objects(spark.createDataFrame([(b, bytearray(pdf_file(c))) for b, c in files.items()], "book int, content binary"))
    paged = pdf.pages(objs)
    got = {r["book"]: r for r in pdf.report(objs, paged).collect()}
    counts = ("pages", "with_contents", "streams_ok", "streams_image", "streams_error", "text_pages", "text_ops", "image_pages")
    assert {b: (*(r[c] for c in counts), r["verdict"]) for b, r in got.items()} == {
        1: (5, 5, 5, 0, 0, 3, 3, 2, "text"), 2: (3, 2, 2, 0, 0, 0, 0, 2, "no text layer"), 3: (3, 3, 1, 0, 2, 1, 1, 2, "damaged"), 4: (1, 1, 0, 1, 0, 0, 0, 1, "unreadable"),
        5: (1, 1, 1, 0, 0, 1, 1, 0, "text"), 6: (1, 0, 0, 0, 0, 0, 0, 0, "unreadable"),
    }
    assert [got[1][f"fonts_{n}"] for n in ("type1", "truetype", "type0", "other", "to_unicode")] == [5, 5, 0, 0, 5]
    layer = {r["book"]: (r["units"], r["sampled"], r["with_text"], r["text_ops"], r["verdict"]) for r in pdf.text_layer(objs, paged).collect()}
    assert layer == {
        1: (5, 4, 2, 2, "text"), 2: (3, 2, 0, 0, "no text layer"), 3: (3, 1, 1, 1, "text"), 4: (1, 0, 0, 0, "nothing sampled"), 5: (1, 1, 1, 1, "text"), 6: (1, 0, 0, 0, "nothing sampled"),
    }


def test_revisions_follow_prev(spark):
    """Three tables out of their order, one behind a free entry; a chain that comes back on itself; a start that is no table; no start."""
    head = b"%PDF-1.4\n"
    newest = b"xref\n0 2\n0000000000 65535 f\n0000000111 00002 n\r\n3 1\n0000000333 00000 f \ntrailer\n<< /Root 1 0 R /Prev %03d >>\n"
    oldest = b"xref\n2 2\n0000000222 00000 n \n0000000330 00000 n \ntrailer << /Size 9 /Root 7 0 R /Title (a \\) >> b) /D << /E 1 >> >>\n"
    middle = b"xref\n1 1\n0000000999 00000 n \ntrailer << /Info 5 0 R /Size 4 /Prev %03d >>\n"
    first = len(newest % 0) + len(head)
    chain = head + newest % (first + len(oldest)) + oldest + middle % first + b"startxref\n9\n%%EOF"
    loop = head + newest % 9 + b"startxref\n9"
    files = [(1, chain), (2, b"12\n" + loop), (3, head + b"xref\nstartxref\n4"), (4, b""), (5, None), (6, head + newest % 999 + b"startxref 9")]
    revs = pdf.revisions(spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in files], "book int, content binary"))
    assert sorted((r["book"], r["rev"]) for r in revs.collect()) == [(1, 0), (1, 1), (1, 2), (2, 0), (6, 0)]
    assert sorted(map(tuple, pdf.cross_references(revs).collect())) == [(1, 1, 111, 2), (1, 2, 222, 0), (1, 3, 330, 0), (2, 1, 114, 2), (6, 1, 111, 2)]
    got = {(r["book"], r["key"]): r["value"] for r in pdf.trailers(revs).collect()}
    assert [got.get((1, k)) for k in ("Root", "Size", "Info")] == ["1 0 R", "4", "5 0 R"] and (2, "Size") not in got


@pytest.mark.parametrize(("raw", "text"), [(b"a" * 200, "a" * 93), (b"\xe9" * 60, "é" * 47), (b"\xfe\xff" + "ç".encode("utf-16-be") * 60, "ç" * 46), (b"\xfe\xff\xd8\x3d\xde\x00", None), (b"", None)])
def test_metadata_is_clipped(spark, raw, text):
    assert spark.createDataFrame([(bytearray(raw),)], "b binary").select(chars.metadata_text(F.col("b"))).first()[0] == text


def test_queries_agree_with_sql(spark, tmp_path):
    """Null, empty and long texts, in every format."""
    import duckdb

    text = ["plain line\nand café\n\n   \nmore ( of ) it \\ here", None, "", "wide — text\nŁódź", "x" * 9000 + "\n\n" + "word\n" * 2000, "a & b <c>", "só latin é", "\n\n\n"]
    docs = spark.createDataFrame([(i, text[i % len(text)]) for i in range(40)], "doc_id long, text string").withColumns({"lang": F.lit("x"), "source": F.lit("y")})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    events = [(i, i % 45, datetime(2024, 1, 1), "click", float(i)) for i in range(60)]
    spark.createDataFrame(events, "event_id long, user_id long, ts timestamp_ntz, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("documents", "events"):
        con.execute(f"create view {name} as select * from '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("shelf_heads", "shelf_open", "document_open", "document_card", "pdf_report", "text_layer_probe", "pdf_cross_references", "pdf_trailers", "pdf_live_objects", "txt_units", "txt_unit_flags"):
        df = QUERIES[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        sql = con.execute(f"SELECT {', '.join(chr(34) + c + chr(34) for c in cols)} FROM ({ORACLE[name]})").fetchall()
        assert sorted(map(repr, map(tuple, df.select(*[f"`{c}`" for c in cols]).collect()))) == sorted(map(repr, sql)), name
