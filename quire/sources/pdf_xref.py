"""Cross-reference tables, cross-reference streams and hybrids of both, and the objects they keep in force (SRC-20 to SRC-24).

Sections of both kinds are cut from a file at their marks, with the places they stand at. One small fold over a file's sections puts them in the order in which they
are read: from the one startxref names, each one's stream for newer readers (XRefStm) before what it continues (Prev). Entries are rows: lines of a table, or records
of fixed width cut by column expressions, which get their numbers from the ranges of Index by a window. Objects in force are entries joined to the places of objects.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.tables import written
from .pdf_syntax import OBJECT, _parms, _value

WHITE = " \t\r\n\f\0"
#: A table, or an object whose dictionary says that it is a cross-reference stream.
SECTION = (
    "(?s)(?=(?<![a-z])xref[ \\t\\r\\n])"
    "|(?=(?<![0-9])[0-9]{1,7}[ \\t\\r\\n]+[0-9]{1,5}[ \\t\\r\\n]+obj[ \\t\\r\\n]*<<(?:(?!endobj|stream|/XRef\\b).)*+/XRef\\b)"
)
_HEADER = "(?s)^[0-9]+[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+obj(.*?)stream(?:\\r\\n|\\n|\\r)"
_ENTRY = "([0-9]{10})[ \\t\\r\\n]+([0-9]{5})[ \\t\\r\\n]+([nf])[ \\t\\r\\n]*"
_NAME = "[^ \\t\\r\\n/<>()\\[\\]]+"
#: Fields of a record wider than this aren't numbers.
WIDEST = 8


def _trailing(text: Column) -> Column:
    return F.length(text) - F.length(F.rtrim(text, F.lit(WHITE)))


def _stream(piece: Column, head: Column) -> Column:
    """The bytes of a stream from the text behind its mark: as many as Length says if endstream follows there, else up to the first endstream."""
    rest = F.substring(piece, F.length(F.regexp_extract(piece, _HEADER, 0)) + 1, F.length(piece))
    length = _value(head, "Length", "([0-9]{1,9})(?![0-9])(?![ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R)").try_cast("int")
    said = F.substring(rest, length + 1, F.lit(16)).rlike("^[ \\t\\r\\n]*endstream")
    return F.when(said, F.left(rest, length)).otherwise(F.regexp_extract(rest, "(?s)^(.*?)(?:\\r\\n|\\n|\\r)?endstream", 1))


def sections(books: DataFrame) -> DataFrame:
    """Rows (book, shift, start, at, white, entries, trailer, head, raw) of books (book, content) with a startxref: every section at its place from the header, shift bytes into the file.

    A table has entries and a trailer; a stream has its dictionary as head and trailer, and its bytes. ``white`` is how much white space stands before it.
    """
    text = F.decode("content", "ISO-8859-1")
    last = F.regexp_extract(F.right("t", F.lit(2048)), "(?s)startxref[ \\t\\r\\n]+([0-9]+)(?!.*startxref)", 1)
    rows = books.select("book", text.alias("t"), F.greatest(F.instr(F.left(text, F.lit(1024)), "%PDF-") - 1, F.lit(0)).alias("shift"))
    rows = rows.select("book", "shift", F.nullif(last, F.lit("")).try_cast("long").alias("start"), F.posexplode(F.split("t", SECTION)).alias("pos", "p")).where("start is not null")
    p, table = F.col("p"), F.startswith("p", F.lit("xref"))
    head = F.when(~table & p.rlike(_HEADER), F.regexp_extract(p, _HEADER, 1))
    trailer = F.regexp_extract(p, "(?s)^xref[0-9nf \\t\\r\\n]*trailer[ \\t\\r\\n]*<<((?:(?!<<|>>).|<<[^>]*>>)*+)>>", 1)
    rows = rows.select("book", "shift", "start", "pos", F.length(p).alias("n"), _trailing(p).alias("white"), F.when(table, F.regexp_extract(p, "^xref([0-9nf \\t\\r\\n]*)", 1)).alias("entries"),
                       F.when(table, trailer).otherwise(head).alias("trailer"), head.alias("head"), F.when(head.isNotNull(), F.encode(_stream(p, head), "ISO-8859-1")).alias("raw"))
    # Only lengths, tables and streams of this one kind are moved; the rest of a file stays where it was read.
    own = Window.partitionBy("book").orderBy("pos")
    at = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - F.col("shift")
    rows = rows.withColumns({"at": at, "white": F.coalesce(F.lag("white").over(own), F.lit(0))})
    return rows.where("trailer is not null").select("book", "shift", "start", "at", "white", "entries", "trailer", "head", "raw")


def revisions(books: DataFrame) -> DataFrame:
    """Rows (book, rev, entries, trailer, head, raw, shift) of books (book, content): sections in the order they are read, from the one startxref names, 0, to the oldest.

    Places may point at white space before a section. A section that was read already isn't read again. Books without a section at their start have no rows.
    """
    found = written(sections(books), "pdf_sections")
    place = lambda key: F.when(F.col("head").isNull() | F.lit(key == "Prev"), _value(F.col("trailer"), key, "([0-9]+)").try_cast("long")).alias(key)
    per = found.groupBy("book").agg(F.first("start").alias("start"), F.collect_list(F.struct("at", "white", place("Prev"), place("XRefStm"))).alias("ts"))

    def step(state: Column, _: Column) -> Column:
        top = F.element_at(state["open"], -1)
        here = F.get(F.filter("ts", lambda t: (t["at"] >= top) & (t["at"] - t["white"] <= top)), F.lit(0))
        rest = F.slice(state["open"], F.lit(1), F.size(state["open"]) - 1)
        new = here.isNotNull() & ~F.array_contains(state["seen"], F.coalesce(here["at"], F.lit(-1)))
        further = F.concat(rest, F.filter(F.array(here["Prev"], here["XRefStm"]), lambda x: x.isNotNull()))
        after = F.struct(F.when(new, further).otherwise(rest).alias("open"), F.when(new, F.array_append(state["seen"], here["at"])).otherwise(state["seen"]).alias("seen"))
        return F.when(F.size(state["open"]) > 0, after).otherwise(state)

    begun = F.struct(F.array("start").cast("array<bigint>").alias("open"), F.array().cast("array<bigint>").alias("seen"))
    order = F.aggregate(F.sequence(F.lit(0), F.size("ts") * 2), begun, step, lambda s: s["seen"])
    read = per.select("book", F.posexplode(order).alias("rev", "at"))
    return found.join(read, ["book", "at"]).select("book", "rev", "entries", "trailer", "head", "raw", "shift")


def _of_tables(revs: DataFrame) -> DataFrame:
    """Rows (book, rev, i, num, kind, a, b) of the lines of tables; a subsection has as many as it says."""
    section = "(?s)(?<![0-9])([0-9]{1,7})[ \\t]+([0-9]{1,7})[ \\t\\r\\n]+((?:" + _ENTRY.replace("(", "(?:") + ")++)"
    parts = F.arrays_zip(*[F.regexp_extract_all("entries", F.lit(section), F.lit(i)).alias(c) for i, c in ((1, "first"), (2, "count"), (3, "lines"))])
    rows = revs.where("entries is not null").select("book", "rev", "shift", F.posexplode(parts).alias("s", "p")).select("book", "rev", "shift", "s", "p.*")
    fields = F.arrays_zip(*[F.regexp_extract_all("lines", F.lit(_ENTRY), F.lit(i)).alias(c) for i, c in ((1, "off"), (2, "gen"), (3, "state"))])
    rows = rows.select("book", "rev", "shift", "s", "first", "count", F.posexplode(fields).alias("k", "e")).where(F.col("k") < F.col("count").cast("int"))
    i = F.struct(F.col("s").cast("long").alias("s"), F.col("k").cast("long").alias("k"))
    return rows.select("book", "rev", "shift", i.alias("i"), (F.col("first").cast("long") + F.col("k")).alias("num"), F.when(F.col("e.state") == "n", 1).otherwise(0).cast("long").alias("kind"),
                       F.col("e.off").cast("long").alias("a"), F.col("e.gen").cast("long").alias("b"))


def _of_streams(revs: DataFrame) -> DataFrame:
    """Rows (book, rev, i, num, kind, a, b) of the records of streams: W says how wide their fields are, Index which numbers they have, in ranges; without it they count from 0.

    Records that Index has no number for count as none. A stream that can't be decoded, has fewer than three widths or one above WIDEST has no records.
    """
    filters = F.regexp_extract_all(F.regexp_extract("head", "(?s)/Filter[ \\t\\r\\n]*(\\[[^\\]]*\\]|/[A-Za-z0-9]+)", 1), F.lit("/([A-Za-z0-9]+)"), F.lit(1))
    widths = F.transform(F.regexp_extract_all(F.regexp_extract("head", "/W[ \\t\\r\\n]*\\[([^\\]]*)\\]", 1), F.lit("[0-9]+"), F.lit(0)), lambda x: F.coalesce(x.try_cast("int"), F.lit(WIDEST + 1)))
    rows = revs.where("head is not null").select("book", "rev", "shift", "head", widths.alias("w"), codecs.decoded(F.col("raw"), filters, _parms(F.col("head"))).alias("d"))
    rows = rows.where((F.size("w") >= 3) & (F.array_max("w") <= WIDEST) & (F.array_max("w") > 0) & (F.col("d.status") == codecs.OK)).withColumn("w", F.slice("w", 1, 8))
    rows = rows.select("book", "rev", "shift", "head", "w", F.col("d.data").alias("data"), F.aggregate("w", F.lit(0), lambda n, x: n + x).alias("wide"))
    n = F.floor(F.octet_length("data") / F.col("wide")).cast("int")

    def field(i: Column, k: int) -> Column:
        before = sum((F.col("w")[j] for j in range(k)), F.lit(0))
        return F.coalesce(F.conv(F.hex(F.substring("data", i * F.col("wide") + before + 1, F.col("w")[k])), 16, 10).try_cast("long"), F.lit(0).cast("long"))

    def record(i: Column) -> Column:
        return F.struct(i.cast("long").alias("i"), F.when(F.col("w")[0] == 0, F.lit(1).cast("long")).otherwise(field(i, 0)).alias("kind"), field(i, 1).alias("a"), field(i, 2).alias("b"))

    records = rows.where(n > 0).select("book", "rev", "shift", F.explode(F.transform(F.sequence(F.lit(0), n - 1), record)).alias("r")).select("book", "rev", "shift", "r.*")
    listed = F.regexp_extract_all(F.regexp_extract("head", "/Index[ \\t\\r\\n]*\\[([^\\]]*)\\]", 1), F.lit("[0-9]+"), F.lit(0))
    whole = F.array(F.lit("0"), F.coalesce(_value(F.col("head"), "Size", "([0-9]+)"), F.lit("0")))
    bounds = F.when(F.col("head").rlike("/Index[ \\t\\r\\n]*\\["), listed).otherwise(whole)
    pairs = F.transform(F.sequence(F.lit(0), F.floor(F.size("bounds") / 2).cast("int") - 1), lambda j: F.struct(*[F.coalesce(F.get("bounds", 2 * j + k).try_cast("int"), F.lit(0)).cast("long").alias(c) for k, c in ((0, "first"), (1, "count"))]))
    ranges = rows.select("book", "rev", bounds.alias("bounds")).where("size(bounds) > 1").select("book", "rev", F.posexplode(pairs).alias("pos", "p")).where("p.count > 0")
    begin = F.coalesce(F.sum("p.count").over(Window.partitionBy("book", "rev").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranges.select("book", "rev", begin.alias("i"), (F.col("p.first") - begin).alias("by"), (begin + F.col("p.count")).alias("end"))
    # Ranges lie between the records they begin before: the last one passed holds a record, so neither is multiplied by the other.
    both = records.unionByName(ranges, allowMissingColumns=True)
    passed = Window.partitionBy("book", "rev").orderBy("i", F.col("kind").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumns({"by": F.last("by", ignorenulls=True).over(passed), "end": F.last("end", ignorenulls=True).over(passed)}).where((F.col("i") < F.col("end")) & F.col("kind").isNotNull())
    return both.select("book", "rev", "shift", F.struct(F.lit(0).cast("long").alias("s"), F.col("i").alias("k")).alias("i"), (F.col("i") + F.col("by")).alias("num"), "kind", "a", "b")


def entries(revs: DataFrame) -> DataFrame:
    """Rows (book, num, off, gen, stream, place) of revisions(): of each object's number the newest entry in use; a free entry hides no older one.

    An object stands at ``off`` in the file, or as number ``place`` (from 0) in the object stream ``stream``.
    """
    rows = _of_tables(revs).unionByName(_of_streams(revs)).where("kind in (1, 2) and num < 2147483648")
    e = rows.groupBy("book", "num").agg(F.min_by(F.struct("kind", "a", "b", "shift"), F.struct("rev", "i")).alias("e"))
    plain, packed = F.col("e.kind") == 1, F.col("e.kind") == 2
    return e.select("book", F.col("num").cast("int").alias("num"), F.when(plain, F.col("e.a") + F.col("e.shift")).alias("off"), F.when(plain, F.col("e.b")).try_cast("int").alias("gen"),
                    F.when(packed, F.col("e.a")).try_cast("int").alias("stream"), F.when(packed, F.col("e.b")).try_cast("int").alias("place"))


def cross_references(revs: DataFrame) -> DataFrame:
    """Rows (book, num, off, gen): entries() that stand in the file themselves."""
    return entries(revs).where("off is not null").select("book", "num", "off", "gen")


def trailers(revs: DataFrame) -> DataFrame:
    """Rows (book, key, value) of revisions(): older trailers give only the keys that newer ones lack. Of a stream, its dictionary is the trailer."""
    item = f"(?s)/({_NAME})[ \\t\\r\\n]*(<<.*?>>|<[^>]*>|\\[[^\\]]*\\]|\\((?:[^()\\\\]++|\\\\.)*+\\)|[0-9]+[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R|/?{_NAME})"
    items = F.arrays_zip(F.regexp_extract_all("trailer", F.lit(item), F.lit(1)).alias("key"), F.regexp_extract_all("trailer", F.lit(item), F.lit(2)).alias("value"))
    rows = revs.select("book", "rev", F.posexplode(items).alias("pos", "i"))
    return rows.groupBy("book", F.col("i.key").alias("key")).agg(F.min_by("i.value", F.struct("rev", "pos")).alias("value"))


def placed(books: DataFrame) -> DataFrame:
    """Rows (book, num, pos, at, white, body) of every object's mark in books (book, content), with the place its number stands at in the file and the white space before it."""
    text = F.decode("content", "ISO-8859-1")
    gaps = F.transform(F.split(text, OBJECT), lambda g: F.struct(F.length(g).alias("n"), _trailing(g).alias("white")))
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(OBJECT), F.lit(0)).alias("o"), gaps.alias("gap"))
    rows = books.select("book", F.posexplode(parts).alias("pos", "z")).select("book", "pos", F.col("z.o").alias("o"), F.col("z.gap.n").alias("gap"), F.col("z.gap.white").alias("white"))
    own = Window.partitionBy("book").orderBy("pos")
    ends = F.sum(F.col("gap") + F.coalesce(F.length("o"), F.lit(0))).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    body = F.regexp_extract("o", "(?s)^[0-9]+[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+obj(.*)endobj\\z", 1)
    rows = rows.where("o is not null").select("book", "pos", "white", F.regexp_extract("o", "^[0-9]+", 0).cast("int").alias("num"), (ends - F.length("o")).alias("at"), body.alias("body"))
    return rows.select("book", "num", "pos", "at", "white", "body")


def in_force(revs: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows (book, num, pos, stream) of files whose tables lead to their root: each object's mark among ``marks`` (placed()), or the object stream that holds it.

    Where an entry points to no object of its number there is none. Files whose Root isn't found that way have no rows: their tables are damaged.
    """
    known = entries(revs)
    near = marks.select("book", "num", "pos", "at", "white")
    plain = known.where("off is not null").join(near, ["book", "num"]).where((F.col("off") <= F.col("at")) & (F.col("off") >= F.col("at") - F.col("white"))).select("book", "num", "pos")
    plain = written(plain.withColumn("stream", F.lit(None).cast("int")), "pdf_plain")
    packed = known.where("stream is not null").select("book", "num", "stream").join(plain.select("book", F.col("num").alias("stream")), ["book", "stream"])
    found = written(plain.unionByName(packed.select("book", "num", F.lit(None).cast("int").alias("pos"), "stream")), "pdf_force")
    root = trailers(revs).where("key = 'Root'").select("book", F.nullif(F.regexp_extract("value", "^([0-9]{1,7})[ \\t\\r\\n]", 1), F.lit("")).cast("int").alias("num"))
    return found.join(root.join(found.select("book", "num"), ["book", "num"], "left_semi").select("book"), "book", "left_semi")
