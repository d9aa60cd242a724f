"""Lines, paragraphs, screens, text files, books and progress on hand-made inputs."""

import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quire.functions import chars
from quire.operators import layout, lines, progress, reflow
from quire.sources import epub, library, pdf, txt, xhtml
from quire.streaming import progress as stream

LINE = "page int, line_no int, text string, x double, x_end double, y double, size double, gap_x double, gap_w double, gap_off int"


def reflowed(spark, rows, **options):
    """rows: (text, x, x_end, y, size[, gap_x, gap_w, gap_off])"""
    full = [(1, i, *(tuple(r) + (0.0, 0.0, 0)[len(r) - 5 :])) for i, r in enumerate(rows)]
    df = spark.createDataFrame(full, LINE)
    return reflow.reflow(df, "page", **options).orderBy("para").collect()


LEFT, RIGHT = 72.0, 520.0


def block(texts, y=700.0, x=LEFT, end=RIGHT, size=11.0, step=14.0):
    return [(t, x, end, y - step * i, size) for i, t in enumerate(texts)]


def test_indent_starts_a_paragraph_and_words_are_mended(spark):
    rows = block(["first line of it that is gene-", "roso and goes on to the margin", "and ends here with some words"])
    rows += [("A new one that is set in by more", LEFT + 18, RIGHT, 658.0, 11.0), ("and returns to the margin after", LEFT, RIGHT, 644.0, 11.0)]
    got = reflowed(spark, rows)
    assert len(got) == 2 and "generoso" in got[0]["text"] and got[0]["joins"] == 1 and got[1]["n_lines"] == 2


def test_ragged_lines_stay_together(spark):
    rows = [("ragged line number one with much", LEFT, 500.0, 700.0, 11.0), ("internationalisation of it all and", LEFT, 470.0, 686.0, 11.0), ("characteristically it goes on with", LEFT, 505.0, 672.0, 11.0), ("extraordinary", LEFT, 200.0, 658.0, 11.0)]
    assert len(reflowed(spark, rows)) == 1


def test_blank_space_parts_blocks(spark):
    assert len(reflowed(spark, block(["one", "two"]) + block(["three", "four"], y=650.0))) == 2


def test_head_and_page_number_go(spark):
    rows = [("Running title", LEFT, 200.0, 760.0, 9.0)] + block(["body text line one", "body text line two", "body text line six"]) + [("xvii", 300.0, 320.0, 40.0, 11.0)]
    assert [p["text"] for p in reflowed(spark, rows)] == ["body text line one body text line two body text line six"]
    assert len(reflowed(spark, rows, drop_running=False)) == 3


def test_large_title_stays_and_is_a_heading(spark):
    rows = [("Chapter One", 230.0, 360.0, 760.0, 20.0)] + block(["body text line one", "body text line two", "body text line six", "and seven"])
    got = reflowed(spark, rows)
    assert got[0]["heading"] and got[0]["center"] and got[0]["text"] == "Chapter One" and not got[1]["heading"]


def test_compound_keeps_its_hyphen(spark):
    got = reflowed(spark, block(["the word is Nao-", "Violenta here and", "a long com-", "prida one"]))
    text = " ".join(p["text"] for p in got)
    assert "Nao-Violenta" in text and "comprida" in text and sum(p["joins"] for p in got) == 1


def test_two_columns(spark):
    rows = [(f"left {i} right {i}", LEFT, RIGHT, 700.0 - 14 * i, 11.0, 280.0, 24.0, 6) for i in range(8)]
    got = reflowed(spark, rows)
    assert {p["col"] for p in got} == {0, 1} and "right" not in "".join(p["text"] for p in got if p["col"] == 0) and got[0]["text"].startswith("left 0")
    assert {p["col"] for p in reflowed(spark, rows, detect_columns=False)} == {0}
    dotted = [(f"Chapter {i} 7", LEFT, RIGHT, 700.0 - 14 * i, 11.0, 450.0, 40.0, 9) for i in range(8)]
    assert {p["col"] for p in reflowed(spark, dotted)} == {0}


def test_no_and_one_line(spark):
    assert reflowed(spark, []) == [] and len(reflowed(spark, [("alone", LEFT, 100.0, 700.0, 11.0)])) == 1


RUN = "page int, text string, x double, y double, size double, width double, dx double, dy double"


def test_runs_to_lines(spark):
    rows = [(1, "World", 50.0, 700.2, 10.0, 25.0, 25.0, 0.0), (1, "Hello", 10.0, 700.0, 10.0, 25.0, 25.0, 0.0), (1, "up", 5.0, 500.0, 10.0, 10.0, 0.0, 10.0), (1, "next", 10.0, 688.0, 12.0, 20.0, 20.0, 0.0), (1, "!", 30.0, 688.0, 12.0, 4.0, 4.0, 0.0), (1, " \t", 10.0, 600.0, 10.0, 5.0, 5.0, 0.0)]
    got = lines.group_lines(spark.createDataFrame(rows, RUN), "page").orderBy("line_no").collect()
    assert [(r["text"], r["x"], r["x_end"]) for r in got] == [("Hello World", 10.0, 75.0), ("next!", 10.0, 34.0)] and got[0]["gap_off"] == 5 and got[0]["gap_w"] == 15.0


def test_gaps_are_measured_from_the_last_run_and_the_size_before_it(spark):
    def row(page, text, x, size, width):
        return (page, text, x, 700.0, size, width, width, 0.0)

    rows = [row(1, "long", 10.0, 10.0, 100.0), row(1, "ab", 20.0, 10.0, 10.0), row(1, "cd", 50.0, 10.0, 10.0)]  # 20 from the run before, inside the longest
    rows += [row(2, "a", 10.0, 8.0, 4.0), row(2, "B", 17.0, 40.0, 20.0)]  # 3 points are a space for 8, not for 40
    rows += [row(3, "a  b ", 10.0, 10.0, 25.0), row(3, " c", 36.0, 10.0, 10.0), row(3, "right col", 300.0, 10.0, 50.0)]
    rows += [row(4, "end", 10.0, 10.0, 15.0), row(4, " ", 90.0, 10.0, 5.0)]  # nothing after the gap
    got = {r["page"]: r for r in lines.group_lines(spark.createDataFrame(rows, RUN), "page").collect()}
    assert [got[k]["text"] for k in (1, 2, 3, 4)] == ["longab cd", "a B", "a b c right col", "end"]
    assert got[1]["x_end"] == 110.0 and (got[3]["gap_off"], got[3]["gap_w"]) == (5, 254.0) and (got[4]["gap_off"], got[4]["gap_w"]) == (-1, 0.0)


def test_columns_part_where_the_gap_holds_the_gutter(spark):
    rows = [(f"left {i} right {i}", LEFT, RIGHT, 700.0 - 14 * i, 11.0, 280.0, 24.0, 6) for i in range(8)]
    beside = ("over it a title", LEFT, RIGHT, 740.0, 11.0, 296.0, 20.0, 7)  # its gap begins behind the gutter, at 292
    ends = ("no text after ", LEFT, RIGHT, 760.0, 11.0, 280.0, 24.0, 13)
    df = spark.createDataFrame([(1, i, *r) for i, r in enumerate([*rows, beside, ends])], LINE)
    got = {(r["line_no"], r["col"]): r["text"] for r in reflow.in_columns(df, "page").collect()}
    assert got[0, 0] == "left 0" and got[0, 1] == "right 0" and got[8, 0] == beside[0] and got[9, 0] == ends[0] and len(got) == 18


def test_lines_beyond_the_margin_are_flush(spark):
    ends = [500.0] * 2 + [400.0] * 4 + [520.0] * 4 + [540.0] * 2
    rows = [(1, i, "text", LEFT, e, 700.0 - 14 * i, 11.0, 0.0, 0.0, -1) for i, e in enumerate(ends)]
    page = reflow.measures(reflow.in_columns(spark.createDataFrame(rows, LINE), "page"), "page").first()
    # x1 is 540; of 12 lines the 2 there are flush, and the 4 at 520 are not
    assert page["x1"] == 540.0 and not page["justified"]
    rows = [(1, i, "text", LEFT, e, 700.0 - 14 * i, s, 0.0, 0.0, -1) for i, (e, s) in enumerate([(520.0, 11.0)] * 3 + [(540.0, 11.0)] + [(400.0, 11.0)] * 2 + [(518.0, 0.0)] * 4)]
    page = reflow.measures(reflow.in_columns(spark.createDataFrame(rows, LINE), "page"), "page").first()
    # 540 lies beyond x1 = 520 by more than a third of the body and counts as flush; sizes of 0 count as 10 for the body
    assert page["x1"] == 520.0 and page["body"] == 11.0 and page["justified"]


@pytest.mark.parametrize("rotate,want", [(0, (10.0, 20.0)), (90, (20.0, 90.0)), (-90, (180.0, 10.0)), (540, (90.0, 180.0))])
def test_turned_pages(spark, rotate, want):
    df = spark.createDataFrame([(15.0, 25.0, 1.0, 0.0, rotate, 5.0, 5.0, 105.0, 205.0)], "x double, y double, dx double, dy double, rotate int, mb_x0 double, mb_y0 double, mb_x1 double, mb_y1 double")
    r = lines.displayed(df).first()
    assert (r["x"], r["y"]) == want


def laid(spark, paras, **options):
    rows = [(1, i, t, h) for i, (t, h) in enumerate(paras)]
    return layout.screen_lines(spark.createDataFrame(rows, "page int, para int, text string, heading boolean"), "page", **options).orderBy("line_no").collect()


def test_layout_holds_its_invariants(spark):
    paras = [("A Heading", True)] + [(" ".join(f"word{i}" for i in range(k)), False) for k in (3, 40, 90, 200)] + [("Late Heading", True), ("tail", False)]
    got = laid(spark, paras)
    assert all(r["w"] <= 452.5 and r["text"] for r in got) and {r["screen"] for r in got} == set(range(got[-1]["screen"] + 1))
    for s in {r["screen"] for r in got}:
        assert next(r for r in got if r["screen"] == s)["top"] == 0.0
    for i, (text, _) in enumerate(paras):
        own = [r for r in got if r["para"] == i]
        assert " ".join(r["text"] for r in own) == text and own[0]["first"] and own[-1]["last"] and sum(r["first"] for r in own) == 1
    assert got[0]["x"] == 0.0 and next(r for r in got if r["para"] == 2)["x"] == 18.0


def test_long_word_is_cut(spark):
    got = laid(spark, [("a" * 64, False)], px=30.0, text_w=60.0, indent=0.0)
    assert "".join(r["text"] for r in got) == "a" * 64 and all(r["text"] == "aaaa" for r in got)
    assert len(laid(spark, [("abc def ghi", False)], px=24.0, text_w=3.0, indent=0.0)) >= 9 - 2
    assert laid(spark, [("", False)]) == []


def test_very_long_words_and_streams_take_linear_time(spark):
    import zlib

    from quire.functions import codecs

    got = laid(spark, [("b" * 300_000, False)])
    assert "".join(r["text"] for r in got) == "b" * 300_000
    data = bytes(range(256)) * 60_000
    assert codecs.flate(zlib.compress(data, 0)) == data and codecs.flate(zlib.compress(data)[:-9])[:256] == data[:256]


def txt_paras(spark, data):
    df = spark.createDataFrame([(1, bytearray(data))], "doc int, content binary").select("doc", chars.text_of(F.col("content")).alias("text"))
    return txt.paragraphs(txt.lines(df, "doc"), "doc").orderBy("para").collect()


@pytest.mark.parametrize("data,want", [
    (b"one line\nwrapped here\n\nsecond one\nends", ["one line wrapped here", "second one ends"]), (b"a\r\nb\r\n\r\nc\r\n", ["a b", "c"]), (b"a\rb\r\rc", ["a b", "c"]),
    ("ção e\npágina".encode("latin-1"), ["ção e página"]), (b"\xef\xbb\xbfwith mark", ["with mark"]), (b"com-\nprida Nao-\nViolenta", ["comprida Nao-Violenta"]),
    (b"First.\nSecond.\n    An indented one\ngoes on", ["First. Second.", "An indented one goes on"]), (b"", []), (b"no end", ["no end"]), (b"\n \n\t\n", []),
])
def test_text_files(spark, data, want):
    assert [p["text"] for p in txt_paras(spark, data)] == want


def html_paras(spark, html):
    return [(r["text"], r["heading"]) for r in xhtml.paragraphs(spark.createDataFrame([(1, html)], "page int, html string"), "page").orderBy("para").collect()]


@pytest.mark.parametrize("html,want", [
    ("<html><head><title>T</title><style>p{}</style></head><body><h1>One</h1><p>A <b>bo</b>ld &eacute;.</p></body>", [("One", True), ("A bold é.", False)]),
    ("<h2></h2><p>next</p>", [("next", True)]), ("<x:p>a</x:p><X:P>b", [("a", False), ("b", False)]), ("a<br/>b<span> c</span>\n d", [("a", False), ("b c d", False)]),
    ("<script>if (a) '</p>'</script>x<!-- <p>no</p", [("xno", False)]), ("<p>a&nbsp;&nbsp;b</p><p> &#160; </p>", [("a b", False)]), ("x < y", [("x", False)]), ("", []), (None, []),
    ("<p>&amp;lt;</p><!DOCTYPE x><?pi?><p>z</p>", [("&lt;", False), ("z", False)]), ("<h1>a<br>b</h1>", [("a", True), ("b", False)]),
])
def test_xhtml(spark, html, want):
    assert html_paras(spark, html) == want


def test_attribute_values(spark):
    html = """<a href='q'><a class=x href="a b"><A  HREF = "it's &amp; so" ><x:a href=bare/b.html id=2><a data-href="no" href=""><a name="n"><a title='href=x' href='y>z'>"""
    df = spark.createDataFrame([(html,)], "h string")
    assert df.select(xhtml.attributes(F.col("h"), "a", "href")).first()[0] == ["q", "a b", "it's & so", "bare/b.html", "", "y"]
    tag = spark.createDataFrame([("<item id='c 1' href=\"t's.xhtml\"/>",)], "t string")
    assert tuple(tag.select(xhtml.attribute(F.col("t"), "id"), xhtml.attribute(F.col("t"), "href"), xhtml.attribute(F.col("t"), "none")).first()) == ("c 1", "t's.xhtml", "")


def test_epub_of_single_quotes(spark):
    opf = "<package><dc:title>T</dc:title><item id='a' href='text one.xhtml'/><itemref idref='a'/></package>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfile full-path='O/b.opf'/></container>")
        z.writestr("O/b.opf", opf)
        z.writestr("O/text one.xhtml", "<p>first</p>")
    rows = epub.members(spark.createDataFrame([(1, bytearray(out.getvalue()))], "book int, content binary"))
    assert [(c["name"], c["html"]) for c in epub.chapters(rows).collect()] == [("O/text one.xhtml", "<p>first</p>")]


def container(entries, opf="OEBPS/b.opf"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", f'<c:container><rootfile full-path="{opf}"/></c:container>')
        for name, text in entries:
            z.writestr(name, text)
    return out.getvalue()


def test_epub(spark):
    opf = '<package><dc:title>O &amp; Livro</dc:title><dc:creator>Autora</dc:creator><item id="b" href="b.xhtml"/><item id="a" href="x/../a.xhtml"/><item id="a" href="b.xhtml"/><itemref idref="a"/><itemref idref="none"/><itemref idref="b"/></package>'
    big = "<h1>B</h1>" + "".join(f"<p>paragraph number {i} " + "x" * 80 + "</p>\n" for i in range(900))
    books = [(1, container([("OEBPS/b.opf", opf), ("OEBPS/a.xhtml", "<p>first</p>"), ("OEBPS/b.xhtml", big)])), (2, b"not a zip"), (3, container([]))]
    rows = epub.members(spark.createDataFrame([(i, bytearray(c)) for i, c in books], "book int, content binary"))
    assert rows.where("book = 2").first()["err"] == "not a ZIP"
    pack = epub.packages(rows).collect()
    assert [(p["book"], p["title"], p["author"], p["folder"]) for p in pack] == [(1, "O & Livro", "Autora", "OEBPS")]
    chaps = epub.chapters(rows).orderBy("chapter")
    assert [(c["chapter"], c["name"]) for c in chaps.collect()] == [(0, "OEBPS/a.xhtml"), (1, "OEBPS/b.xhtml")]
    parts = epub.units(chaps)
    own = parts.where("chapter = 1").orderBy("part").collect()
    assert len(own) > 1 and all(a["to"] == b["from"] for a, b in zip(own, own[1:])) and own[0]["first"] and own[-1]["last"]
    paras = epub.paragraphs(parts).where("chapter = 1").orderBy("part", "para").collect()
    assert [p["text"].split(" x")[0] for p in paras] == ["B"] + [f"paragraph number {i}" for i in range(900)]
    assert not paras[0]["cont"] and sum(p["cont"] for p in paras) == sum(p["open"] for p in paras) == len(own) - 1


def test_pdf_streams_with_parameters(spark):
    """A PNG predictor for one filter, and for the second of two."""
    import zlib

    def predicted(text, columns):
        text = text.ljust(-(-len(text) // columns) * columns)
        rows, above, out = [text[i : i + columns] for i in range(0, len(text), columns)], bytes(columns), b""
        for row in rows:
            out += b"\x02" + bytes((x - y) % 256 for x, y in zip(row, above))
            above = row
        return zlib.compress(out)

    head = "<< /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 7 >> >>"
    two = "<< /Filter [/ASCIIHexDecode /FlateDecode] /DecodeParms [null << /Columns 5 /Predictor 15 >>] >>"
    body = b"%PDF-1.4\n1 0 obj " + head.encode() + b" stream\n" + predicted(b"BT (one) Tj ET", 7) + b"\nendstream endobj\n"
    body += b"2 0 obj " + two.encode() + b" stream\n" + predicted(b"BT (two) Tj ET ", 5).hex().encode() + b">\nendstream endobj\n"
    rows = pdf.objects(spark.createDataFrame([(1, bytearray(body))], "book int, content binary")).collect()
    got = {r["num"]: (r["status"], bytes(r["data"]).strip()) for r in rows}
    assert got == {1: ("OK", b"BT (one) Tj ET"), 2: ("OK", b"BT (two) Tj ET")}


def test_pdf_of_two_pages_and_two_fonts(spark):
    """A composite font with widths and a map to Unicode beside a simple one with differences; positions worked out by hand."""
    body = (
        "%PDF-1.6\n10 0 obj << /Type /Catalog /Pages 11 0 R >> endobj\n11 0 obj << /Type /Pages /Kids [20 0 R 30 0 R] >> endobj\n"
        "12 0 obj << /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [13 0 R] /ToUnicode 14 0 R >> endobj\n"
        "13 0 obj << /Type /Font /Subtype /CIDFontType0 /DW 400 /W [32 [250] 65 70 800 200 [100 300]] >> endobj\n"
        "14 0 obj << >> stream\n1 beginbfrange <0041> <0046> <0391> endbfrange 2 beginbfchar <0020> <0020> <00C8> <00660066> endbfchar 1 beginbfrange <00C9> <00CA> [<0021> <003F>] endbfrange\nendstream endobj\n"
        "15 0 obj << /Type /Font /Subtype /Type1 /FirstChar 97 /Widths [500 600] /Encoding << /Differences [98 /eacute /uni20AC] >> >> endobj\n"
        "20 0 obj << /Type /Page /MediaBox [0 0 300 400] /Resources << /Font << /G 12 0 R >> >> /Contents 21 0 R >> endobj\n"
        "21 0 obj << >> stream\nBT /G 20 Tf 30 350 Td <00410042> Tj <002000C800C9> Tj 0 -40 Td <00CA0100> Tj ET\nendstream endobj\n"
        "30 0 obj << /Type /Page /MediaBox [0 0 300 400] /Resources << /Font << /G 12 0 R /S 15 0 R >> >> /Contents 31 0 R >> endobj\n"
        "31 0 obj << >> stream\nq 2 0 0 2 10 10 cm BT /S 10 Tf 5 100 Td (abc) Tj /G 10 Tf <0043> Tj ET Q BT /S 12 Tf 1 0 0 1 15 30 Tm (a\\(b) Tj ET\nendstream endobj\n"
    )
    books = spark.createDataFrame([(7, bytearray(body.encode("latin-1")))], "book int, content binary")
    got = [(r["unit"], r["text"], r["codes"], r["unmapped"], *(round(r[c], 6) for c in ("x", "y", "size", "width"))) for r in pdf.runs(books).orderBy("unit", "seq").collect()]
    assert got == [
        (0, "ΑΒ", 2, 0, 30.0, 350.0, 20.0, 32.0), (0, " ff!", 3, 0, 62.0, 350.0, 20.0, 13.0), (0, "?", 2, 1, 30.0, 310.0, 20.0, 16.0),
        (1, "aé€", 3, 0, 20.0, 210.0, 20.0, 32.0), (1, "Γ", 1, 0, 52.0, 210.0, 20.0, 16.0), (1, "a(é", 3, 0, 15.0, 30.0, 12.0, 19.2),
    ]
    found = lines.group_lines(lines.displayed(pdf.runs(books)), "book", "unit")
    assert sorted((r["unit"], r["line_no"], r["text"]) for r in found.collect()) == [(0, 0, "ΑΒ ff!"), (0, 1, "?"), (1, 0, "aé€Γ"), (1, 1, "a(é")]


def test_pdf_objects_pages_and_streams(spark):
    import zlib

    stream = zlib.compress(b"BT /F1 10 Tf 1 0 0 1 20 30 Tm [(ab) -1000 (c)] TJ 0 -12 Td (d\\051) Tj ET")
    packed = b"5 0 6 42 << /Type /Font /Encoding /WinAnsiEncoding >> << /unused 1 >>"
    body = (
        b"%PDF-1.7\n1 0 obj <</Type /Catalog /Pages 2 0 R>> endobj 2 0 obj <</Type /Pages /Kids [4 0 R 3 0 R]>> endobj\n"
        b"3 0 obj <</Type /Page /Contents [7 0 R 99 0 R] /Rotate 90 /Resources <</Font <</F1 5 0 R>>>>>> endobj 4 0 obj <</Type /Page /Contents 9 0 R>> endobj\n"
        b"7 0 obj <</Filter /FlateDecode>> stream\n" + stream + b"\nendstream endobj\n8 0 obj <</Type /ObjStm /N 2 /First 9>> stream\n" + packed + b"\nendstream endobj\n"
        b"9 0 obj <<>> stream\n(old) Tj\nendstream endobj 9 0 obj <<>> stream\n(no font) Tj\nendstream endobj\n"
    )
    books = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(b"junk")), (3, bytearray(b""))], "book int, content binary")
    objs = pdf.objects(books)
    assert {r["num"] for r in objs.where("book = 1").collect()} == {1, 2, 3, 4, 5, 6, 7, 8, 9} and bytes(objs.where("num = 9").first()["data"]) == b"(no font) Tj"
    paged = pdf.pages(objs)
    assert [(r["unit"], r["num"]) for r in paged.orderBy("unit").collect()] == [(0, 4), (1, 3)]
    ops = {r["unit"]: r["n"] for r in pdf.contents(objs, paged).select("unit", pdf.text_operators(F.col("content")).alias("n")).collect()}
    assert ops == {0: 1, 1: 2}
    runs = pdf.runs(books).orderBy("seq").collect()
    assert [(r["text"], round(r["x"], 6), round(r["y"], 6)) for r in runs] == [("ab", 20.0, 30.0), ("c", 40.0, 30.0), ("d)", 20.0, 18.0)] and {r["unit"] for r in runs} == {1} and runs[0]["rotate"] == 90
    assert spark.createDataFrame([(bytearray(body),)], "c binary").select(pdf.version(F.col("c"))).first()[0] == "1.7"


TOUCH = "name string, size long, unit long, total long, para long, px long, seq long"


def test_progress_keeps_the_books_touched_last(spark):
    rows = [(f"b{i % 148}", 1, i, 200, 0, 18, i) for i in range(296)] + [("b0", 2, 5, 10, 0, 18, 500)]
    got = progress.recent(spark.createDataFrame(rows, TOUCH)).collect()
    assert len(got) == 128 and got[0]["size"] == 2 and got[1]["name"] == "b147" and got[1]["unit"] == 295 and got[-1]["name"] == "b21"


def test_progress_file(spark, tmp_path):
    rows = [("tab\tna\tme é", 10, 3, 9, 2, 18, 5), ("other", 11, 1, 0, 0, 12, 9)]
    df = spark.createDataFrame(rows, TOUCH)
    path = f"file://{tmp_path}/progress"
    progress.save(df, path, theme=2)
    assert [r["value"] for r in spark.read.text(path).collect()] == ["#ereader1", "theme\t2", "b\t11\t1\t0\t0\t12\tother", "b\t10\t3\t9\t2\t18\ttab\tna\tme é"]
    back = progress.load(spark, path).orderBy(F.desc("seq")).collect()
    assert [r["name"] for r in back] == ["other", "tab\tna\tme é"] and back[1]["unit"] == 3
    bad = ["", "b", "b\t1\t2", "b\tabc\t-4\tx\t\t9\tname", "b\t1\t2\t3\t4\t5\t", "b\t1\t2\t3\t4\t5\t" + "n" * 128, "x\t1", "b\t99999999999999999999\t1\t1\t1\t1\tlong"]
    lines_ = spark.createDataFrame(list(enumerate(bad)), "place int, value string")
    assert [(r["name"], r["size"], r["unit"], r["px"]) for r in progress.parsed(lines_).orderBy("place").collect()][0] == ("name", 0, 0, 9)


def test_a_failed_save_leaves_the_old_file(spark, tmp_path):
    path = f"file://{tmp_path}/progress"
    progress.save(spark.createDataFrame([("a", 1, 2, 3, 4, 18, 1)], TOUCH), path, theme=3)
    old = (tmp_path / "progress").read_text()
    broken = spark.createDataFrame([("b", 1, 2, 3, 4, 18, 1)], TOUCH).withColumn("unit", F.raise_error(F.lit("lost")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        progress.save(broken, path)
    assert (tmp_path / "progress").read_text() == old and [f.name for f in tmp_path.iterdir() if not f.name.startswith(".")] == ["progress"]
    progress.save(spark.createDataFrame([], TOUCH), path, theme=1)
    assert (tmp_path / "progress").read_text() == "#ereader1\ntheme\t1\n"


def test_theme_is_read_back(spark):
    of = lambda *rows: progress.theme_of(spark.createDataFrame(list(enumerate(rows)), "place int, value string"))
    assert (of("#ereader1", "theme\t2", "b\t1"), of("theme\t1", "theme\t-4x"), of("theme\tx"), of("theme\t"), of("b")) == (2, -4, 0, 0, 0)


def test_saves_follow_units(spark):
    rng = random.Random(5)
    rows = [(f"b{min(rng.randrange(6), 2)}", 1, rng.randrange(3), 9, k % 5, 18, rng.randrange(-300, 300)) for k in range(400)]
    rows = list({(r[0], r[6]): r for r in rows}.values()) + [(None, 1, 1, 1, 1, 1, 1), ("b0", 1, None, 1, 1, 1, 1), ("b0", 1, 1, 1, 1, 1, None)]
    want, last = [], {}
    for r in sorted((r for r in rows if None not in r), key=lambda r: r[6]):
        if last.get(r[0]) != r[2]:
            want.append(r)
        last[r[0]] = r[2]
    for span in (1, 7, 64, 10_000):  # every touch alone, books over many blocks, all in two
        assert sorted(map(tuple, progress.saves(spark.createDataFrame(rows, TOUCH), span=span).collect())) == sorted(want)
    twice = spark.createDataFrame([("b", 1, 1, 1, 1, 1, 1)] * 2, TOUCH)
    assert progress.saves(twice).count() == 1 and progress.saves(twice.limit(0)).count() == 0
    assert progress.saves(twice.withColumn("_note", F.lit(1))).columns == [*twice.columns, "_note"]


def test_kept_progress_is_written_when_a_unit_changes(spark, tmp_path):
    source, path, checkpoint = (f"file://{tmp_path}/{x}" for x in ("in", "progress", "cp"))
    progress.save(spark.createDataFrame([("old", 7, 1, 2, 0, 18, 1), ("b1", 1, 0, 9, 0, 18, 0)], TOUCH), path, theme=4)

    def batch(*rows) -> list[str]:
        """The file's lines after one more batch; each call starts the query again."""
        spark.createDataFrame(list(rows), TOUCH).coalesce(1).write.mode("append").parquet(source)
        stream.keep(spark.readStream.schema(TOUCH).parquet(source), path, checkpoint, most=3).awaitTermination(120)
        return (tmp_path / "progress").read_text().splitlines()[1:]

    first = batch(("b1", 1, 3, 9, 0, 18, 10), ("b2", 1, 0, 9, 5, 18, 12), ("b1", 1, 4, 9, 1, 18, 11), (None, 1, 1, 1, 1, 1, 99), ("b3", 1, None, 1, 1, 1, 99))
    assert first == ["theme\t4", "b\t1\t0\t9\t5\t18\tb2", "b\t1\t4\t9\t1\t18\tb1", "b\t7\t1\t2\t0\t18\told"]
    written = (tmp_path / "progress").stat().st_ino
    assert batch(("b2", 1, 0, 9, 7, 18, 20), ("b1", 1, 2, 9, 0, 18, 5)) == first  # the paragraph only; an older touch
    assert (tmp_path / "progress").stat().st_ino == written
    assert batch(("b2", 1, 1, 9, 0, 18, 21), ("b4", 2, 0, None, None, None, 22)) == ["theme\t4", "b\t2\t0\t0\t0\t0\tb4", "b\t1\t1\t9\t0\t18\tb2", "b\t1\t4\t9\t1\t18\tb1"]
    assert (tmp_path / "progress").stat().st_ino != written


def test_shelf_and_resume(spark):
    books = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "name string, size long")
    at = spark.createDataFrame([("a", 1, 99, 100, 4, 99), ("b", 2, 7, 0, 0, 20)], "name string, size long, unit long, total long, para long, px long")
    got = {r["name"]: r["percent"] for r in progress.shelf(books, at).collect()}
    assert got == {"a": 99, "b": None, "c": None}
    units = spark.createDataFrame([("c", 3, 0, 0), ("c", 3, 2, 5), ("c", 3, 1, 1)], "name string, size long, unit long, n_screens long")
    got = {r["name"]: (r["px"], r["unit"], r["para"]) for r in progress.resume_points(books, at, units).collect()}
    assert got == {"a": (18, 99, 4), "b": (20, 7, 0), "c": (18, 1, 0)}


def test_streamed_touches(spark, tmp_path):
    source = f"file://{tmp_path}/in"
    for k in range(3):
        spark.createDataFrame([(f"b{i}", 1, k * 10 + i, 99, 0, 18, k * 10 + i) for i in range(k, k + 4)], TOUCH).coalesce(1).write.mode("append").parquet(source)
    touches = spark.readStream.schema(TOUCH).option("maxFilesPerTrigger", 1).parquet(source)
    query = stream.follow(touches, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", most=5)
    query.awaitTermination(120)
    got = spark.read.parquet(f"file://{tmp_path}/out/version=2").collect()
    want = progress.recent(spark.read.schema(TOUCH).parquet(source), 5).collect()
    assert sorted(map(tuple, got)) == sorted(tuple(r[c] for c in got[0].asDict()) for r in want)


def test_library(spark, tmp_path):
    for name in ("b.TXT", "A.pdf", "c.epub", ".pdf", "d.zip", "noext"):
        (tmp_path / name).write_bytes(b"12345")
    (tmp_path / "sub").mkdir()
    got = library.scan(spark, f"file://{tmp_path}").collect()
    assert [(r["name"], r["size"], r["fmt"]) for r in got] == [("A.pdf", 5, "pdf"), ("b.TXT", 5, "txt"), ("c.epub", 5, "epub")]


def test_screens_are_numbered_through_a_book(spark):
    rows = [(1, u, s, 0, 1, 0) for u in range(3) for s in range(u + 1)]
    got = layout.ordinals(spark.createDataFrame(rows, "book int, unit int, screen int, first_line int, n_lines long, first_para int"), "book", "unit").orderBy("ordinal").collect()
    assert [r["ordinal"] for r in got] == list(range(1, 7)) and got[0]["previous"] is None and tuple(got[1]["previous"]) == (0, 0) and tuple(got[3]["previous"]) == (1, 1) and got[-1]["next"] is None
