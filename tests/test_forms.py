"""Form XObjects against the same page with its forms written out."""

import math
import random

import pytest
from pyspark.sql import functions as F

from quire.sources import pdf, pdf_forms

FONT = b"2 0 obj << /Type /Font /Subtype /Type1 /Encoding /WinAnsiEncoding >> endobj\n"


def file_of(pages, forms, resources=b"<< /Font << /F1 2 0 R >> /XObject << %s >> >>"):
    """pages: contents; forms: by number, (entries of the dictionary, content). Pages name every form Xn; forms only what their entries say."""
    named = b" ".join(b"/X%d %d 0 R" % (n, n) for n in forms)
    kids = b" ".join(b"%d 0 R" % (1000 + 2 * i) for i in range(len(pages)))
    out = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 9 0 R >> endobj\n9 0 obj << /Type /Pages /Kids [" + kids + b"] >> endobj\n" + FONT
    for i, content in enumerate(pages):
        out += b"%d 0 obj << /Type /Page /Resources %s /Contents %d 0 R >> endobj\n" % (1000 + 2 * i, resources % named, 1001 + 2 * i)
        out += b"%d 0 obj << >> stream\n%s\nendstream endobj\n" % (1001 + 2 * i, content)
    for n, (entries, content) in forms.items():
        out += b"%d 0 obj << /Type /XObject /Subtype /Form %s >> stream\n%s\nendstream endobj\n" % (n, entries, content)
    return out


def of(spark, *files):
    return spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "book int, content binary")


def shown(spark, *files):
    return [tuple(r) for r in pdf.runs(of(spark, *files)).orderBy("book", "unit", "seq").select("book", "unit", "seq", "text", "x", "y", "size", "width", "dx", "dy").collect()]


TEXT = b"BT /F1 10 Tf 5 7 Td (%s) Tj ET "


def close(a, b):
    return len(a) == len(b) and all(x == y if isinstance(x, (int, str)) else math.isclose(x, y, abs_tol=1e-6, rel_tol=1e-9) for p, q in zip(a, b) for x, y in zip(p, q))


@pytest.mark.parametrize("seed", range(3))
def test_forms_show_what_they_hold(spark, seed):
    rng = random.Random(seed)
    number = lambda: b"%d" % rng.randrange(-3, 4) if rng.random() < 0.5 else b"%.2f" % rng.uniform(-2, 2)
    matrix = lambda: b" ".join(number() for _ in range(6))
    forms, written_out = {}, {}

    def content(callable_, depth):
        """Text and calls, and the same with the calls written out."""
        own, whole = b"", b""
        for _ in range(rng.randrange(1, 5)):
            if callable_ and rng.random() < 0.6:
                n, m, spacing = rng.choice(callable_), matrix(), b"%d Tc " % rng.randrange(3)
                own += spacing + b"q " + m + b" cm /X%d Do Q " % n
                whole += spacing + b"q " + m + b" cm q " + written_out[n] + b" Q Q "
            else:
                text = TEXT % bytes(rng.choice(b"abcdef") for _ in range(rng.randrange(1, 5)))
                own, whole = own + text, whole + text
        return own, whole

    for n in range(20, 26):
        m = matrix() if rng.random() < 0.7 else None
        own, whole = content([k for k in forms], n)
        names = b" ".join(b"/X%d %d 0 R" % (k, k) for k in forms)
        kept = b"/Resources << /Font << /F1 2 0 R >> /XObject << %s >> >>" % names if rng.random() < 0.5 else b""
        forms[n] = ((b"/Matrix [" + m + b"]" if m else b"") + kept, own)
        written_out[n] = (m or b"1 0 0 1 0 0") + b" cm " + whole
    pages = [content(list(forms), 0) for _ in range(4)]
    got = shown(spark, file_of([p for p, _ in pages], forms))
    assert close(got, shown(spark, file_of([p for _, p in pages], {}))) and len(got) > 8


def test_depth_cycles_and_what_is_missing(spark):
    deep = {20 + i: (b"", TEXT % (b"level%d" % i) + (b"/X%d Do " % (21 + i))) for i in range(12)}
    loop = {20: (b"", TEXT % b"round" + b"/X20 Do")}
    odd = {20: (b"/Resources 30 0 R", TEXT % b"own"), 21: (b"/Matrix [1 2 3]", TEXT % b"short matrix"), 22: (b"/Filter /FooDecode", TEXT % b"unread"), 23: (b"", b"")}
    files = [
        file_of([TEXT % b"before" + b"/X20 Do " + TEXT % b"after"], deep), file_of([b"/X20 Do"], loop),
        file_of([b"/X20 Do /X21 Do /X22 Do /X23 Do /X99 Do /X20 Do"], odd) + b"30 0 obj << /Font << /F1 2 0 R >> >> endobj\n",
        file_of([b"/X20 Do"], {20: (b"/Resources << >>", TEXT % b"no font")}), file_of([b"/I1 Do " + TEXT % b"image"], {}),
        file_of([b"BT /F1 10 Tf ET /X20 Do " + TEXT % b"own font"], {20: (b"", b"BT 5 7 Td (caller's font) Tj ET")}),
    ]
    got = shown(spark, *files)
    text = lambda book: [r[3] for r in got if r[0] == book]
    assert text(0) == ["before", *[f"level{i}" for i in range(8)], "after"] and text(1) == ["round"] * 8
    assert text(2) == ["own", "short matrix", "own"] and text(3) == [] and text(4) == ["image"]
    assert text(5) == ["own font"]  # a form begins without a font
    assert [r[2] for r in got if r[0] == 0] == list(range(10))


def test_text_in_forms_is_a_text_layer(spark):
    forms = {20: (b"", TEXT % b"one" + b"/X21 Do /X21 Do ( /X22 Do )"), 21: (b"", TEXT % b"two" + TEXT % b"three"), 22: (b"", TEXT % b"never")}
    objs = pdf.objects(of(spark, file_of([b"/X20 Do", b"q Q", b"/X21 Do " + TEXT % b"own"], forms)))
    paged = pdf.pages(objs)
    calls = {(r["unit"], r["num"], r["depth"]): (r["n"], r["ops"]) for r in pdf_forms.called(objs, paged, pdf_forms.forms(objs)).collect()}
    assert calls == {(0, 20, 0): (1, 1), (0, 21, 1): (2, 4), (2, 21, 0): (1, 2)}
    layer = pdf.text_layer(objs, paged).first()
    assert (layer["verdict"], layer["with_text"], layer["text_ops"]) == ("text", 2, 8)
    report = pdf.report(objs, paged).first()
    assert (report["text_pages"], report["text_ops"], report["image_pages"], report["verdict"]) == (2, 8, 1, "text")


def test_no_forms(spark):
    objs = pdf.objects(of(spark, file_of([TEXT % b"plain"], {}), b""))
    assert pdf_forms.forms(objs).isEmpty() and pdf_forms.called(objs, pdf.pages(objs), pdf_forms.forms(objs)).count() == 0
    assert pdf.runs(of(spark)).select(F.col("seq")).count() == 0


def test_fonts_are_read_once_and_strings_shown_whole(monkeypatch):
    """A task's pages name the same fonts: before, each page read them again and went through its strings code by code."""
    import pandas as pd

    made = []

    class Font(pdf.Font):
        def __init__(self, f):
            made.append(f)
            super().__init__(f)

        def unicode(self, code):
            asked.append(code)
            return super().unicode(code)

    asked = []
    monkeypatch.setattr(pdf, "Font", Font)
    wide = {"name": "F2", "font": "/Type0", "descendant": "<< /DW 700 >>", "encoding": "", "unicode": "1 beginbfrange <0041> <0042> <0061> endbfrange"}
    fonts = [{"name": "F1", "font": "/Type1 /FirstChar 65 /Widths [250]", "descendant": "", "encoding": "", "unicode": ""}, wide]
    page = "BT 2 Tc 3 Tw /F1 10 Tf (" + "A b\x81" * 1000 + ") Tj /F2 10 Tf <" + "004100420043" * 1000 + "00> Tj ET"
    rows = [r for batch in pdf._interpret(iter([(pd.Series([page] * 20), pd.Series([fonts] * 20))] * 2)) for r in batch["runs"]]
    assert len(rows) == 40 and len(made) == 2 and len(asked) < 300
    one, two = rows[-1]
    assert one["text"] == "A b" * 1000 and (one["codes"], one["unmapped"], one["dx"]) == (4000, 1000, 1000 * (2.5 + 3 * 5 + 4 * 2 + 3))
    assert two["text"] == "ab" * 1000 and (two["codes"], two["unmapped"], two["dx"]) == (3001, 1001, 3001 * (7.0 + 2))
