"""Character functions and codecs on synthetic inputs."""

import zlib

import pytest
from pyspark.sql import functions as F

from quire.functions import chars, codecs
from quire.functions.joining import join_lines, joined_words
from quire.functions.stats import percentile_of
from quire.operators import layout
from quire.sources import pdf, txt, xhtml


def one(spark, column, *values, schema=None):
    names = [f"c{i}" for i in range(len(values))]
    df = spark.createDataFrame([tuple(values)], schema or names)
    return df.select(column(*[F.col(n) for n in df.columns]).alias("r")).first()["r"]


BAD = "�"


@pytest.mark.parametrize("data,want", [
    ("41", "A"), ("C3A1", "á"), ("E28094", "—"), ("F09F9396", "📖"), ("C080", BAD), ("E08080", BAD), ("EDA080", BAD), ("F4908080", BAD),
    ("80", BAD), ("FF", BAD), ("C3", BAD), ("C341", BAD + "A"), ("", ""),
])
def test_utf8_repair(data, want):
    assert chars.repair_utf8(bytes.fromhex(data)) == want


def test_utf8_repair_always_advances(spark):
    for a in range(256):
        assert chars.repair_utf8(bytes([a]))
        for b in range(0, 256, 7):
            assert 1 <= len(chars.repair_utf8(bytes([a, b]))) <= 2
    assert one(spark, chars.utf8_text, bytes.fromhex("53C3A36F")) == "São"


@pytest.mark.parametrize("text,want", [("12", True), ("- 7 -", True), ("xvii", True), ("MIX", True), ("4 iv", False), ("", False), ("| |", False), ("12345678901", False), ("page 3", False), ("[12]", True)])
def test_page_numbers(spark, text, want):
    assert one(spark, chars.is_page_number, text) is want


@pytest.mark.parametrize("data,want", [
    (b"plain", "UTF8"), ("ação".encode(), "UTF8"), ("ação".encode("latin-1"), "LATIN1"), (b"\xef\xbb\xbfx\xff", "UTF8"), (b"", "UTF8"),
    (b"a" * 8191 + "é".encode(), "UTF8"), (b"a" * 8191 + b"\xe9", "UTF8"), (b"\x80", "LATIN1"), (b"\xe0\x80\x80", "UTF8"),
])
def test_encodings(spark, data, want):
    assert one(spark, chars.encoding_of, data) == want


def test_text_of_files(spark):
    assert one(spark, chars.text_of, bytes.fromhex("E7E36F")) == "ção"
    assert one(spark, chars.text_of, b"\xef\xbb\xbf" + "ção".encode()) == "ção"
    assert one(spark, chars.latin1_text, b"\x93a\x94\x81\xe9") == "“a”\x81é"
    assert one(spark, chars.metadata_text, bytes.fromhex("FEFF00E7")) == "ç" and one(spark, chars.metadata_text, b"\xe7") == "ç"


@pytest.mark.parametrize("text,want", [("&amp;lt;", "&lt;"), ("&#233;&#xE9;", "éé"), ("&bogus; & &", "&bogus; & &"), ("&Eacute;", "&Eacute;"), ("&#xD800;", "&#xD800;"), ("a&nbsp;b", "a b"), ("&toolonganame;", "&toolonganame;")])
def test_entities(spark, text, want):
    assert one(spark, chars.decode_entities, text) == want


@pytest.mark.parametrize("lines,want,joins", [
    (["a com-", "prida"], "a comprida", 1), (["Nao-", "Violenta"], "Nao-Violenta", 0), (["one", "two"], "one two", 0), (["x -", "y"], "x -y", 0), (["a­", "b"], "ab", 1), (["é-", "é-", "é"], "ééé", 2),
])
def test_joining(spark, lines, want, joins):
    assert one(spark, join_lines, lines) == want and one(spark, joined_words, lines) == joins


def test_percentile(spark):
    assert one(spark, lambda c: percentile_of(c, 0.5), [4.0, 1.0, 3.0, 2.0]) == 3.0
    assert one(spark, lambda c: percentile_of(c, 0.5), [], schema="c0 array<double>") is None


@pytest.mark.parametrize("name,data,want", [
    ("ASCIIHexDecode", b"48656C6C6F>", b"Hello"), ("AHx", b"4>", b"\x40"), ("ASCII85Decode", b"87cURD]j7BEbo7~>", b"Hello world"[:11]), ("A85", b"z~>", bytes(4)),
    ("RunLengthDecode", bytes.fromhex("02414243FE5A80"), b"ABCZZZ"), ("LZWDecode", bytes.fromhex("800B6050220C0C8501"), b"-----A---B"),
    ("FlateDecode", b"\r\n" + zlib.compress(bytes(range(256)) * 16), bytes(range(256)) * 16), ("Crypt", b"as it is", b"as it is"),
])
def test_codecs(name, data, want):
    assert codecs.decode(data, [name]) == (want, codecs.OK)


def test_codec_statuses_and_chains():
    assert codecs.decode(bytes([7] * 64), ["FlateDecode"]) == (b"", codecs.BAD_DATA)
    assert codecs.decode(b"abcd", ["DCTDecode"])[1] == codecs.IMAGE and codecs.decode(b"abcd", ["Nothing"])[1] == codecs.UNKNOWN
    assert codecs.decode(b"abcd", []) == (b"abcd", codecs.OK)
    assert codecs.decode(zlib.compress(b"x" * 999).hex().encode() + b">", ["AHx", "Fl"])[0] == b"x" * 999
    rows = zlib.compress(bytes([2, 10, 20, 30, 2, 1, 1, 1]))
    assert codecs.decode(rows, ["FlateDecode"], {"Predictor": 12, "Columns": 3})[0] == bytes([10, 20, 30, 11, 21, 31])
    assert codecs.predictor(bytes([1, 2, 3, 4, 5, 6]), 2, columns=3) == bytes([1, 3, 6, 4, 9, 15])
    half = zlib.compress(bytes(1000) + bytes(range(256)) * 40)
    assert codecs.flate(half[: len(half) // 2])[:1000] == bytes(1000)
    long = bytes(i * 7 % 251 for i in range(20_000))
    for n in ("FlateDecode", "ASCIIHexDecode", "ASCII85Decode", "RunLengthDecode"):
        assert codecs.decode(codecs.encode(long, n), [n]) == (long, codecs.OK)


@pytest.mark.parametrize("token,want", [("--5", -5), ("34-", 34), (".", 0), ("-", 0), ("+8", 8), ("-1.5", -1.5)])
def test_numbers(token, want):
    assert pdf.number(token) == want


@pytest.mark.parametrize("token,want", [("(a(b)c)", b"a(b)c"), (r"(a\)b)", b"a)b"), (r"(\101\n)", b"A\n"), ("(a\\\nb)", b"ab"), ("<41424>", b"AB@"), ("(x\0y)", b"x\0y")])
def test_strings(token, want):
    assert pdf.string_bytes(token) == want


@pytest.mark.parametrize("name,want", [("A", "A"), ("uni00E7", "ç"), ("u1F4D6", "📖"), ("eacute", "é"), ("space", " "), ("a.alt", "a"), ("nothing", ""), ("uniD800", ""), ("emdash", "—")])
def test_glyphs(name, want):
    assert pdf.glyph_text(name) == want


@pytest.mark.parametrize("href,want", [("text/c.xhtml#a", "OEBPS/text/c.xhtml"), ("../OEBPS/./Text//c.x", "OEBPS/Text/c.x"), ("../../../x", "x"), ("", "OEBPS")])
def test_resolving(spark, href, want):
    assert one(spark, lambda c: xhtml.resolve(c, "OEBPS"), href) == want


def test_text_units_tile():
    data = b"\n\n".join(b"paragraph %d " % i * 20 for i in range(400))
    cuts = list(txt._cut(data, 3000, 4000))
    assert cuts[0][0] == 0 and cuts[-1][1] == len(data) and all(a[1] == b[0] for a, b in zip(cuts, cuts[1:])) and all(b > a for a, b, _ in cuts) and all(c for _, _, c in cuts)
    assert list(txt._cut(b"", 3000, 4000)) == [] and list(txt._cut(b"x" * 9000, 3000, 4000)) == [(0, 7000, True), (7000, 9000, False)]


def test_width_natively(spark):
    text = "Wil mM-fox, ÀÉ[1] — x…"
    assert one(spark, layout.text_width, text) == pytest.approx(sum(map(layout.char_width, text)))
