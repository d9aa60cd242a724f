"""Cross-reference tables, streams and hybrids, and which objects they keep in force."""

import zlib

from quire.sources import pdf, pdf_xref

HEAD = b"%PDF-1.5\n"
CATALOG = b"1 0 obj << /Type /Catalog >> endobj\n"


def books(spark, *files):
    return spark.createDataFrame([(i, None if f is None else bytearray(f)) for i, f in enumerate(files)], "book int, content binary")


def table(offsets, trailer):
    """A table whose subsections hold one entry each."""
    lines = b"".join(b"%d 1\n%010d %05d %s \n" % (n, off, gen, b"n" if off else b"f") for n, (off, gen) in offsets.items())
    return b"xref\n" + lines + b"trailer << /Root 1 0 R " + trailer + b" >>\n"


def stream(records, widths, trailer, num=90, pack=False):
    data = b"".join(v.to_bytes(w, "big") for r in records for v, w in zip(r, widths))
    data = zlib.compress(data) if pack else data
    said = b"/Filter /FlateDecode " if pack else b""
    return b"%d 0 obj << /Type /XRef /W [%s] /Root 1 0 R /Length %d %s%s >>\nstream\n" % (num, b" ".join(b"%d" % w for w in widths), len(data), said, trailer) + data + b"\nendstream endobj\n"


def closed(body, start):
    return body + b"startxref\n%d\n%%%%EOF\n" % start


def entries(spark, *files):
    rows = pdf_xref.entries(pdf_xref.revisions(books(spark, *files))).collect()
    return {(r["book"], r["num"]): (r["off"], r["gen"], r["stream"], r["place"]) for r in rows}


def objects(spark, *files):
    return {(r["book"], r["num"]): r["body"].strip() for r in pdf.objects(books(spark, *files)).collect() if "/" not in r["body"]}


def test_records_and_ranges(spark):
    """Ranges in any order, empty ones, more records than numbers and more numbers than records, no type field, wide fields, packed bytes that hold the word for their end."""
    files = [
        (stream([(1, 500, 3), (2, 7, 9), (0, 0, 0), (1, 0x656E64, 1), (1, 1, 1)], (1, 3, 1), b"/Index [20 2 4 0 5 2]"), {20: (500, 3, None, None), 21: (None, None, 7, 9), 6: (0x656E64, 1, None, None)}),
        (stream([(700, 0), (800, 2)], (2, 1), b"/Size 5"), {}),
        (stream([(0, 700, 0), (0, 800, 2)], (0, 2, 1), b"/Size 5"), {0: (700, 0, None, None), 1: (800, 2, None, None)}),
        (stream([(1, 65 + i, 0) for i in range(300)], (1, 4, 2), b"/Size 300", pack=True), {i: (65 + i, 0, None, None) for i in range(300)}),
        (stream([(1, int.from_bytes(b"endstream"[:8], "big"), 0), (1, 77, 1)], (1, 8, 2), b"/Index [3 1 1000 50]"), {3: (int.from_bytes(b"endstrea", "big"), 0, None, None), 1000: (77, 1, None, None)}),
        (stream([(1, 77, 1)], (1, 9, 2), b"/Size 1"), {}),
        (stream([(1, 77, 1)], (1, 2, 1), b"/Index []"), {}),
        (stream([], (1, 2, 1), b"/Size 4"), {}),
        (stream([(3, 77, 1), (1, 2**64 - 1, 5)], (1, 8, 1), b"/Size 4"), {1: (0, 5, None, None)}),
    ]
    got = entries(spark, *[closed(HEAD + f, 9) for f, _ in files])
    assert got == {(i, n): e for i, (_, want) in enumerate(files) for n, e in want.items()}


def test_hybrids_read_their_stream_before_what_they_continue(spark):
    """Newest table, its stream, the table before it: the first to have a number wins; the stream's own chain comes before the older table."""
    oldest = table({5: (505, 0), 6: (606, 0), 8: (808, 0)}, b"")
    inner = stream([(1, 555, 0)], (1, 2, 1), b"/Index [5 1]", num=91)
    first, second = 9 + len(oldest), 9 + len(oldest) + len(inner)
    hybrid = stream([(2, 30, 1), (2, 30, 2)], (1, 2, 1), b"/Index [4 1 6 1] /Prev %d /XRefStm 9" % first)
    newest = table({4: (444, 0), 7: (0, 1)}, b"/Prev 9 /XRefStm %d" % second)
    file = closed(HEAD + oldest + inner + hybrid + newest, second + len(hybrid))
    want = {4: (444, 0, None, None), 5: (555, 0, None, None), 6: (None, None, 30, 2), 8: (808, 0, None, None)}
    got = entries(spark, file, b"junk\n" + file)
    assert {n: e for (b, n), e in got.items() if b == 0} == want
    assert {n: e for (b, n), e in got.items() if b == 1} == {n: (None if e[0] is None else e[0] + 5, *e[1:]) for n, e in want.items()}


def test_subsections_have_as_many_lines_as_they_say(spark):
    text = b"xref\n3 1\n0000000111 00000 n \n0000000222 00000 n \n9 1\n0000000333 00000 n \ntrailer << >>\n"
    assert {n for _, n in entries(spark, closed(HEAD + text, 9))} == {3, 9}


def test_circles_white_space_and_places_of_nothing(spark):
    one = table({3: (333, 0)}, b"/Prev 9")
    two = stream([(1, 444, 0)], (1, 2, 1), b"/Index [4 1] /Prev %d" % (9 + len(one)))  # the white space before itself
    files = [closed(HEAD + one, 9), closed(HEAD + one + b" \n" + two, 9 + len(one)), closed(HEAD + one, 12), closed(HEAD + one, 99999999999999999999999), closed(HEAD, 9), b"", None]
    assert {k: v[0] for k, v in entries(spark, *files).items()} == {(0, 3): 333, (1, 4): 444}


def test_objects_in_force(spark):
    """A file's tables decide against marks that stand later; numbers without an entry, and entries that point elsewhere, have no object."""
    a, b, old, c = b"3 0 obj (three) endobj\n", b"4 0 obj (four) endobj\n", b"5 0 obj (old) endobj\n", b"5 0 obj (five) endobj\n"
    packed = b"6 0 obj << /Type /ObjStm /N 3 /First 15 >> stream\n7 0 8 8 3 15   (seven) (eight) (packed) \nendstream endobj\n"
    stale = b"3 0 obj (stale) endobj\n9 0 obj (no entry) endobj\n"
    at, body = {}, HEAD
    for n, part in (("1", CATALOG), ("3", a), ("4", b), ("old", old), ("5", c), ("6", packed)):
        at[n] = len(body)
        body += part
    first = {1: (at["1"], 0), 3: (at["3"], 0), 5: (at["old"], 0)}
    start = len(body)
    plain = body + table(first, b"")
    newer = stream([(1, at["5"], 0), (1, at["6"], 0), (2, 6, 0), (1, at["4"] - 1, 0), (1, 2, 0)], (1, 4, 1), b"/Index [5 3 4 1 8 1] /Prev %d" % start, pack=True)
    both = closed(plain + newer + stale, len(plain))
    damaged = closed(body + table({**first, 1: (at["3"], 0)}, b"") + stale, start)
    got = objects(spark, both, closed(plain + stale, start), damaged, body + stale)
    assert {n: v for (i, n), v in got.items() if i == 0} == {3: "(three)", 4: "(four)", 5: "(five)", 7: "(seven)"}
    assert {n: v for (i, n), v in got.items() if i == 1} == {3: "(three)", 5: "(old)"}
    by_marks = {3: "(stale)", 4: "(four)", 5: "(five)", 7: "(seven)", 8: "(eight)", 9: "(no entry)"}
    assert {n: v for (i, n), v in got.items() if i == 2} == by_marks == {n: v for (i, n), v in got.items() if i == 3}


def test_long_dictionaries_and_many_sections(spark):
    """200,000 bytes of a dictionary, and 300 revisions, newest last."""
    long = stream([(1, 50, 0)], (1, 2, 1), b"/Size 1 /X (" + b"a" * 200_000 + b")")
    body, prev = HEAD, b""
    for i in range(300):
        here = len(body)
        body += table({i % 100 + 2: (1000 + i, 0)}, prev)
        prev = b"/Prev %d" % here
    got = entries(spark, closed(HEAD + long, 9), closed(body, here), closed(HEAD + b"1 0 obj << " + b"(" * 200_000 + b"xref " * 1000, 9))
    assert got == {(0, 0): (50, 0, None, None), **{(1, i % 100 + 2): (1000 + i, 0, None, None) for i in range(200, 300)}}
