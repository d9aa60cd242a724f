"""Inputs that are long or malformed on purpose: patterns pass them in one go, without deep recursion."""

import pytest
from pyspark.sql import functions as F

from quire.sources import pdf, xhtml

MANY = 100_000


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("a" + "<br> " * MANY + "b", [("a", False), ("b", False)]),
        ("a" + " <br/>\n" * MANY + "<h1>b" + "<p></p>" * MANY + "c", [("a", False), ("b", True), ("c", False)]),
        ("<h1> </h1> " * MANY + "b", [("b", True)]),
        ("x " * MANY, [("x " * (MANY - 1) + "x", False)]),
        ("a<b" * MANY, None),
        ("<script>" + "x" * MANY, []),
        ("&amp;" * MANY, [("&" * MANY, False)]),
    ],
)
def test_long_pages(spark, html, want):
    got = [(r["text"], r["heading"]) for r in xhtml.paragraphs(spark.createDataFrame([(1, html)], "page_id int, html string"), "page_id").orderBy("para").collect()]
    assert want is None or got == want


def test_marks_and_spaces(spark):
    """Every short mix of text, breaks, headings and spaces: a run of marks counts as one, a heading's wins."""
    import itertools
    import re

    mixes = ["".join(m) for n in range(7) for m in itertools.product(["x", "<br>", "<h2>", " "], repeat=n)]
    got = {r[0]: r[1] for r in spark.createDataFrame([(m,) for m in mixes], "m string").select("m", xhtml.marked_text(F.col("m"))).collect()}

    def plain(m):
        s = re.sub(" +", " ", m.replace("<br>", "\1").replace("<h2>", "\2"))
        return re.sub("[\1\2 ]*[\1\2][\1\2 ]*", lambda run: "\2" if "\2" in run[0] else "\1", s)

    assert {m: plain(m) for m in mixes} == got


def _one(spark, content):
    return spark.createDataFrame([(1, bytearray(content))], "book int, content binary")


@pytest.mark.parametrize("title", [b"(" + b"a" * MANY + b")", b"(" + b"\\051" * MANY + b")", b"(" + b"(a)" * MANY + b")", b"<" + b"41" * MANY + b">", b"(" * MANY, b"(" + b"a" * MANY])
def test_long_titles(spark, title):
    body = b"%PDF-1.4\n1 0 obj << /Type /Catalog >> endobj\n2 0 obj << /Type /Page >> endobj\n3 0 obj << /Title " + title + b" >> endobj\ntrailer << /Info 3 0 R >>"
    books = _one(spark, body)
    objs = pdf.objects(books)
    row = pdf.opened(books, objs, pdf.pages(objs)).first()
    assert row["units"] == 1 and row["error"] is None
    assert row["title"] == {b"(a": "a" * 93, b"(\\": ")" * 93, b"((": ("(a)" * 31 if title.startswith(b"((a") else None), b"<4": "A" * 93}.get(title[:2] if title.endswith((b")", b">")) else b"")


@pytest.mark.parametrize("value", [b"(" + b"a" * MANY + b")", b"(" + b"\\)" * MANY + b")", b"[" + b"1 " * MANY + b"]", b"<" + b"0" * MANY + b">"])
def test_long_trailer_values(spark, value):
    body = b"%PDF-1.4\nxref\n0 1\n0000000000 65535 f \ntrailer << /A " + value + b" /B 7 >>\nstartxref\n9\n%%EOF"
    got = {r["key"]: r["value"] for r in pdf.trailers(pdf.revisions(_one(spark, body))).collect()}
    assert got == {"A": value.decode(), "B": "7"}
