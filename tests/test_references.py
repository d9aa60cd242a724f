"""References behind references: chains of every length, circles, and streams that are measured by them."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.sources import pdf

HEAD = b"%PDF-1.5\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\n"
FONT = b"3 0 obj << /Type /Font /Subtype /Type1 >> endobj\n"
SHOWN = b"BT /F1 10 Tf 20 100 Td (text) Tj ET"


def chain(first, length, end):
    """``length`` reference objects from ``first`` on, the last one to ``end``."""
    return b"".join(b"%d 0 obj %d 0 R endobj\n" % (first + i, first + i + 1 if i < length - 1 else end) for i in range(length))


def runs(spark, *files):
    return [tuple(r) for r in pdf.runs(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "book int, content binary")).select("book", "unit", "text").orderBy("book", "unit", "seq").collect()]


def links(spark, text):
    objs = pdf.objects(spark.createDataFrame([(1, bytearray(text))], "book int, content binary"))
    return {r["num"]: r["body"].strip() for r in objs.collect()}


@pytest.mark.parametrize("length", [1, 2, 5, 16, 30, 31])
def test_chains_end_at_their_value(spark, length):
    got = links(spark, chain(100, length, 7) + b"7 0 obj (value) endobj")
    assert got == {7: "(value)", **{100 + i: "(value)" for i in range(length)}}


def test_chains_that_are_too_long_or_circles_end_nowhere(spark):
    """As many as 32 references are followed, the first of them in a dictionary: of a chain of 40 the last 31 have a value."""
    got = links(spark, chain(100, 40, 7) + b"7 0 obj (value) endobj " + chain(200, 3, 200) + b"300 0 obj 300 0 R endobj " + chain(400, 2, 999))
    assert [got[100 + i] == "(value)" for i in range(40)] == [False] * 9 + [True] * 31
    assert all(got[n].endswith("R") for n in (200, 201, 202, 300, 400, 401))


def test_everything_behind_references(spark):
    """Kids, pages, contents (one, and an array), resources, fonts, filters, parameters and lengths."""
    packed = zlib.compress(SHOWN)
    png = zlib.compress(b"".join(b"\x00" + SHOWN[i : i + 5] for i in range(0, len(SHOWN), 5)))
    file = (
        HEAD + FONT + b"2 0 obj << /Type /Pages /Kids 50 0 R >> endobj\n" + chain(50, 2, 55) + b"55 0 obj [10 0 R 60 0 R] endobj\n" + chain(60, 3, 20)
        + b"10 0 obj << /Type /Page /Resources 70 0 R /Contents 80 0 R >> endobj\n" + chain(70, 2, 75) + b"75 0 obj << /Font 76 0 R >> endobj\n76 0 obj 77 0 R endobj\n77 0 obj << /F1 78 0 R >> endobj\n"
        + chain(78, 1, 3) + chain(80, 4, 85) + b"85 0 obj [ 30 0 R 31 0 R ] endobj\n"
        + b"20 0 obj << /Type /Page /Resources << /Font << /F1 3 0 R >> >> /Contents 90 0 R >> endobj\n" + chain(90, 2, 32)
        + b"30 0 obj << /Filter 40 0 R /Length 47 0 R >> stream\n" + packed + b"\nendstream endobj\n" + chain(40, 2, 43) + b"43 0 obj /FlateDecode endobj\n47 0 obj 44 0 R endobj\n44 0 obj %d endobj\n" % len(packed)
        + b"31 0 obj << /Filter [/FlateDecode] /DecodeParms 45 0 R >> stream\n" + png + b"\nendstream endobj\n45 0 obj 46 0 R endobj\n46 0 obj << /Predictor 12 /Columns 5 >> endobj\n"
        + b"32 0 obj << /Filter 99 0 R >> stream\n" + SHOWN + b"\nendstream endobj\n"
    )
    assert runs(spark, file) == [(0, 0, "text"), (0, 0, "text"), (0, 1, "text")]


def test_streams_that_hold_the_word_for_their_end(spark):
    inner = b"BT /F1 10 Tf 20 100 Td (a endstream endobj b) Tj ET"
    page = b"2 0 obj << /Type /Pages /Kids [10 0 R] >> endobj\n10 0 obj << /Type /Page /Resources << /Font << /F1 3 0 R >> >> /Contents 30 0 R >> endobj\n"

    def file(length, more=b""):
        return HEAD + FONT + page + b"30 0 obj << /Length " + length + b" >> stream\r\n" + inner + b"\nendstream endobj\n" + more

    files = [file(b"%d" % len(inner)), file(b"40 0 R", b"40 0 obj 41 0 R endobj\n41 0 obj %d endobj\n" % len(inner)), file(b"%d" % (len(inner) + 3)), file(b"40 0 R"), file(b"99999999")]
    got = runs(spark, *files)
    assert [r for r in got if r[0] < 2] == [(0, 0, "a endstream endobj b"), (1, 0, "a endstream endobj b")]
    objs = pdf.objects(spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(files)], "book int, content binary"))
    data = {r["book"]: bytes(r["data"]) for r in objs.where(F.col("num") == 30).collect()}
    assert data == {0: inner, 1: inner, **{i: inner[: inner.index(b"endstream")].rstrip(b"\n") for i in (2, 3, 4)}}
    short = HEAD + b"30 0 obj << /Length 3 >> stream\nabc \n \nendstream endobj\n31 0 obj << /Length 2 >> stream\nabc\nendstream endobj"
    assert {n: bytes(r) for n, r in pdf.objects(spark.createDataFrame([(1, bytearray(short))], "book int, content binary")).where("data is not null").select("num", "data").collect()} == {30: b"abc", 31: b"abc"}
