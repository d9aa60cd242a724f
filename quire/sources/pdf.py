"""PDF files as relations: objects, pages, fonts and text runs (SRC-19 to SRC-33, FNT-*, CS-*).

A file's objects are found by their ``N G obj`` marks. Its cross-references, where they lead to the root, say which of them are in force
(pdf_xref); else the last of a number wins, as in a file whose table has to be rebuilt. Object streams are unpacked to more rows, pages are
joined to their contents and fonts, and only the operators of one page's content run through a loop.
"""

import math
import re
from collections.abc import Iterator
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from ..functions.chars import metadata_text
from ..functions.tables import discard, written
from . import pdf_forms, pdf_xref
from .pdf_syntax import OBJECT, _parms, _ref, _refs, _value
from .pdf_xref import cross_references, revisions, trailers  # noqa: F401

STREAM = "(?s)stream(?:\\r\\n|\\n|\\r)(.*?)(?:\\r\\n|\\n|\\r)?endstream"
#: Levels of a page tree that are followed.
DEEPEST = 64
#: Runs, and calls of XObjects with the state they begin in (STATE), numbered together in the order of the stream; ux, uy: where one unit upwards leads.
SHOWN = (
    "struct<runs:array<struct<at:int,text:string,x:double,y:double,fs:double,ux:double,uy:double,dx:double,dy:double,codes:int,unmapped:int>>,"
    "calls:array<struct<at:int,name:string,m:array<double>,state:array<double>>>>"
)
#: Font size, spacing of characters and of words, scale, leading and rise: what a form takes over from its caller besides the matrix.
STATE = {"fs": 0.0, "tc": 0.0, "tw": 0.0, "th": 1.0, "tl": 0.0, "ts": 0.0}


def version(content: Column) -> Column:
    """What the header in the first 1024 bytes says, as '1.4'; null if there is none."""
    return F.nullif(F.regexp_extract(F.decode(F.substring(content, 1, 1024), "ISO-8859-1"), "%PDF-([0-9]+\\.[0-9]+)", 1), F.lit(""))


LINK = "^[ \\t\\r\\n]*([0-9]{1,7})[ \\t\\r\\n]+[0-9]{1,5}[ \\t\\r\\n]+R[ \\t\\r\\n]*$"
#: References that are followed from a dictionary to a value.
MOST_HOPS = 32


def links(objs: DataFrame) -> DataFrame:
    """Rows (book, num, to) of objects (book, num, body) that are nothing but a reference: the number at the end of the chain, null for one that is too long or a circle.

    Each round joins the chains with themselves and doubles their reach, so that five rounds reach MOST_HOPS.
    """
    one = objs.select("book", "num", F.nullif(F.regexp_extract("body", LINK, 1), F.lit("")).cast("int").alias("to")).where("to is not null")
    now = written(one.withColumn("hops", F.lit(1)), "pdf_links")
    if now.isEmpty():
        return now.drop("hops")
    for _ in range(MOST_HOPS.bit_length() - 1):
        further = now.select("book", F.col("num").alias("to"), F.col("to").alias("next"), F.col("hops").alias("more"))
        joined = now.join(further, ["book", "to"], "left")
        if joined.where("next is not null").isEmpty():
            break
        now = written(joined.select("book", "num", F.coalesce("next", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "pdf_links")
    # The dictionary's own reference is a hop as well; an end that is itself a reference lies beyond the most.
    ends = now.join(one.select("book", F.col("num").alias("to"), F.lit(True).alias("on")), ["book", "to"], "left")
    return ends.select("book", "num", F.when(F.col("on").isNull() & (F.col("hops") < MOST_HOPS), F.col("to")).alias("to"))


def _followed(objs: DataFrame) -> DataFrame:
    """``objs`` with every reference object replaced by what it leads to, under its own number; pages, which are counted, stay where they are."""
    found = links(objs)
    if found.isEmpty():
        return objs
    counted = F.col("body").rlike("/Type[ \\t\\r\\n]*/(?:Pages?|Catalog)\\b")
    rest = [c for c in objs.columns if c not in ("book", "num")]
    ends = found.where("to is not null").join(objs.withColumnRenamed("num", "to").where(~counted), ["book", "to"]).select("book", "num", *rest)
    return written(objs.join(ends, ["book", "num"], "left_anti").unionByName(ends), "pdf_followed")


def _array(rows: DataFrame, objs: DataFrame, key: str) -> DataFrame:
    """``rows`` (book, body and others) and ``listed``: what stands in the brackets of an array in the dictionary, or in those of the object that it names; null if there is none."""
    inline = F.regexp_extract("body", f"(?s)/{key}[ \\t\\r\\n]*(\\[[^\\]]*\\])", 1)
    named = objs.where("data is null").select("book", F.col("num").alias("at"), F.nullif(F.regexp_extract("body", "(?s)^[ \\t\\r\\n]*(\\[[^\\]]*\\])", 1), F.lit("")).alias("there")).where("there is not null")
    rows = rows.withColumns({"inline": F.nullif(inline, F.lit("")), "at": _ref(F.col("body"), key)})
    if rows.where("inline is null and at is not null").isEmpty() or named.isEmpty():
        return rows.withColumnRenamed("inline", "listed").drop("at")
    rows = rows.join(named, ["book", "at"], "left")
    return rows.withColumn("listed", F.coalesce("inline", "there")).drop("inline", "there", "at")


def objects(books: DataFrame) -> DataFrame:
    """Rows (book, num, body, data, status) of books (book, content): the object of each number that is in force, its stream decoded. A written table.

    Filter, DecodeParms and Length may stand behind references. A stream has the Length that is said if endstream follows there, so that it may hold
    that word itself; else the first endstream ends it. Objects that are only references are what they lead to.
    """
    rows, force = _chosen(books)
    has = F.col("body").rlike("(?s)stream[\\r\\n].*endstream")
    head = F.regexp_replace("body", "(?s)stream[\\r\\n].*", "")
    rows = written(rows.select("book", "num", head.alias("body"), F.when(has, F.encode(F.regexp_extract("body", STREAM, 1), "ISO-8859-1")).alias("raw")), "pdf_parts")
    streams = _described(rows, _followed(rows.where("raw is null").select("book", "num", "body")))
    streams = _measured(streams, books)
    filters = F.regexp_extract_all("filter", F.lit("/([A-Za-z0-9]+)"), F.lit(1))
    decoded = streams.withColumn("d", codecs.decoded(F.col("raw"), filters, _parms(F.col("parms")))).select("book", "num", "body", F.col("d.data").alias("data"), F.col("d.status").alias("status"))
    nothing = [F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("status")]
    plain = written(decoded.unionByName(rows.where("raw is null").select("book", "num", "body", *nothing)), "pdf_objects")
    discard(rows)
    packed = plain.where(F.col("body").rlike("/Type[ ]*/ObjStm"))
    if not packed.isEmpty():
        rows, plain = plain, written(plain.unionByName(_unpacked(packed, force).join(plain.select("book", "num"), ["book", "num"], "left_anti")), "pdf_objects")
        discard(rows)
    followed = _followed(plain)
    if followed is not plain:
        discard(plain)
    return followed


def _described(rows: DataFrame, small: DataFrame) -> DataFrame:
    """The streams among ``rows`` (book, num, body, raw) with filter, parms (as they would stand in the dictionary) and length, each from there or from the object of ``small`` that it names."""
    keys = {"filter": "Filter", "parms": "(?:DecodeParms|DP)", "length": "Length"}
    direct = {
        "filter": F.regexp_extract("body", "(?s)/Filter[ \\t\\r\\n]*(\\[[^\\]]*\\]|/[A-Za-z0-9]+)", 1), "parms": F.col("body"),
        "length": F.regexp_extract("body", "(?s)/Length[ \\t\\r\\n]+([0-9]{1,9})(?![0-9])(?![ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R)", 1),
    }
    streams = rows.where("raw is not null")
    refs = {name: _ref(F.col("body"), key) for name, key in keys.items()}
    held = streams.select("book", "num", F.explode(F.array(*[F.struct(F.lit(n).alias("name"), r.alias("at")) for n, r in refs.items()])).alias("r")).select("book", "num", "r.*").where("at is not null")
    if held.isEmpty():  # as in most files: streams needn't move
        return streams.select("book", "num", "body", "raw", *[c.alias(n) for n, c in direct.items()]).withColumn("length", F.nullif("length", F.lit("")).try_cast("int"))
    held = held.join(small.select("book", F.col("num").alias("at"), F.col("body").alias("there")), ["book", "at"])
    # A row for each stream that refers to anything: its three values side by side.
    wide = held.groupBy("book", "num").agg(*[F.max(F.when(F.col("name") == n, F.col("there"))).alias(f"{n}_there") for n in keys])
    given = {
        "filter": F.coalesce("filter_there", direct["filter"]), "parms": F.coalesce(F.concat(F.lit("/DecodeParms "), F.col("parms_there")), direct["parms"]),
        "length": F.coalesce("length_there", direct["length"]),
    }
    found = streams.join(wide, ["book", "num"], "left").select("book", "num", "body", "raw", *[c.alias(n) for n, c in given.items()])
    return found.withColumn("length", F.nullif(F.trim("length"), F.lit("")).try_cast("int"))


def _measured(streams: DataFrame, books: DataFrame) -> DataFrame:
    """``streams`` with raw as long as length says, where endstream follows in the file; the few that are longer than up to their first endstream are cut from it again."""
    shorter = (F.col("length") < F.octet_length("raw")) & F.decode(F.substring("raw", F.col("length") + 1, F.octet_length("raw")), "ISO-8859-1").rlike("^[ \\t\\r\\n]*\\z")
    streams = streams.withColumn("raw", F.when(shorter, F.substring("raw", F.lit(1), F.col("length"))).otherwise(F.col("raw")))
    longer = streams.where(F.col("length") > F.octet_length("raw") + 2).select("book", "num", "body", "length")
    if longer.isEmpty():
        return streams
    text = F.decode("content", "ISO-8859-1")
    rows = longer.join(books.select("book", text.alias("t")), "book")
    # The text of the dictionary, as it stands in the file after the last mark of its number.
    mark = F.concat(F.lit("(?s)^.*(?<![0-9])"), F.col("num").cast("string"), F.lit("[ \\t\\r\\n]+[0-9]{1,5}[ \\t\\r\\n]+obj\\b"))
    before = F.length(F.call_function("regexp_extract", F.col("t"), mark, F.lit(0))) + F.length("body")
    start = before + F.length(F.regexp_extract(F.substring("t", before + 1, F.lit(8)), "^stream(?:\\r\\n|\\n|\\r)", 0))
    ends = F.substring("t", start + F.col("length") + 1, F.lit(16)).rlike("^[ \\t\\r\\n]*endstream")
    whole = rows.where(ends).select("book", "num", F.encode(F.substring("t", start + 1, F.col("length")), "ISO-8859-1").alias("whole"))
    return streams.join(whole, ["book", "num"], "left").withColumn("raw", F.coalesce("whole", "raw")).drop("whole")


def _chosen(books: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows (book, num, body): the object of each number that its file's cross-references keep in force, in files without any that can be used the last one; and those of pdf_xref.in_force()."""
    announced = books.where(F.decode(F.substring("content", F.greatest(F.octet_length("content") - 2047, F.lit(1)), F.lit(2048)), "ISO-8859-1").rlike("startxref[ \\t\\r\\n]+[0-9]"))
    revs = written(revisions(announced), "pdf_revisions")
    if revs.isEmpty():
        text = F.decode("content", "ISO-8859-1")
        parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(OBJECT), F.lit(1)).alias("num"), F.regexp_extract_all(text, F.lit(OBJECT), F.lit(3)).alias("body"))
        rows = books.select("book", F.posexplode(parts).alias("pos", "o")).select("book", F.col("o.num").cast("int").alias("num"), "pos", F.col("o.body").alias("body"))
        return rows.groupBy("book", "num").agg(F.max_by("body", "pos").alias("body")), None
    marks = written(pdf_xref.placed(books), "pdf_marks")
    force = written(pdf_xref.in_force(revs, marks), "pdf_in_force")
    # Of a file whose tables are used every number is decided: one mark, or none.
    decided = marks.select("book", "num").distinct().join(force.select("book").distinct(), "book", "left_semi").join(force.where("pos is not null").select("book", "num", F.col("pos").alias("live")), ["book", "num"], "left")
    rows = marks.join(decided.select("book", "num", F.coalesce("live", F.lit(-1)).alias("live")), ["book", "num"], "left").where("live is null or live = pos")
    return rows.groupBy("book", "num").agg(F.max_by("body", "pos").alias("body")), force


def _unpacked(packed: DataFrame, force: DataFrame | None = None) -> DataFrame:
    """Objects inside object streams: N pairs of number and offset, then the objects from First. Of files in ``force`` only those that stand there."""
    text, first = F.decode("data", "ISO-8859-1"), _value(F.col("body"), "First", "([0-9]+)").cast("int")
    rows = packed.select("book", text.alias("t"), first.alias("first"), F.col("num").alias("stream"))
    numbers = F.transform(F.regexp_extract_all(F.left("t", F.col("first")), F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))
    rows = rows.withColumn("ns", numbers)
    entries = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("ns") / 2).cast("int") - 1),
        lambda i: F.struct(
            F.get("ns", 2 * i).alias("num"), F.get("ns", 2 * i + 1).alias("at"), F.coalesce(F.get("ns", 2 * i + 3), F.lit(2**30)).alias("end")
        ),
    )
    rows = rows.where(F.size("ns") > 1).select("book", "stream", "t", "first", F.explode(entries).alias("e"))
    body = F.substring("t", F.col("first") + F.col("e.at") + 1, F.col("e.end") - F.col("e.at"))
    rows = rows.select("book", "stream", F.col("e.num").alias("num"), body.alias("body"))
    if force is not None:
        held = force.where("stream is not null").select("book", "num", "stream", F.lit(True).alias("held"))
        rows = rows.join(force.select("book", F.lit(True).alias("decided")).distinct(), "book", "left").join(held, ["book", "num", "stream"], "left").where("decided is null or held")
    last = rows.groupBy("book", "num").agg(F.max_by("body", "stream").alias("body"))
    return last.select("book", "num", "body", F.lit(None).cast("binary").alias("data"), F.lit(None).cast("string").alias("status"))


def pages(objs: DataFrame) -> DataFrame:
    """Rows (book, unit, num, body) in the order of the page tree, from 0; pages that the tree doesn't reach come after, by number."""
    kind = F.regexp_extract("body", "/Type[ \\t\\r\\n]*/(Pages?)\\b", 1)
    nodes = objs.where(kind != "").select("book", "num", "body", kind.alias("kind"))
    kids = _array(nodes.where("kind = 'Pages'"), objs, "Kids").select("book", F.col("num").alias("up"), F.posexplode(_refs(F.col("listed"))).alias("pos", "num"))
    chains = links(objs)  # those to pages
    if not chains.isEmpty():
        kids = kids.join(chains, ["book", "num"], "left").select("book", "up", "pos", F.coalesce("to", "num").alias("num"))
    root = objs.where(F.col("body").rlike("/Type[ \\t\\r\\n]*/Catalog\\b")).groupBy("book").agg(F.max_by(_ref(F.col("body"), "Pages"), "num").alias("num"))
    level = root.select("book", "num", F.array().cast("array<int>").alias("path"))
    reached = level
    for _ in range(DEEPEST):  # one join for each level of the tree
        level = level.join(kids.withColumnRenamed("num", "kid"), (level.num == F.col("up")) & (level.book == kids.book)).select(
            level.book, F.col("kid").alias("num"), F.array_append("path", F.col("pos")).alias("path")
        )
        level = written(level, "pdf_tree")
        if level.isEmpty():
            break
        reached = reached.unionByName(level)
    first = reached.groupBy("book", "num").agg(F.min("path").alias("path"))
    rows = nodes.where("kind = 'Page'").join(first, ["book", "num"], "left")
    own = Window.partitionBy("book").orderBy(F.col("path").asc_nulls_last(), "num")
    return written(rows.withColumn("unit", F.row_number().over(own) - 1).select("book", "unit", "num", "body"), "pdf_pages")


def _streams(objs: DataFrame, paged: DataFrame) -> DataFrame:
    """Rows (book, unit, pos, data, status): the streams that a page's contents name; status is null where there is no such stream."""
    refs = F.coalesce("listed", F.regexp_extract("body", "(?s)/Contents[ \\t\\r\\n]*([0-9]+[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R)", 1))
    return _array(paged, objs, "Contents").select("book", "unit", F.posexplode(_refs(refs)).alias("pos", "num")).join(objs.select("book", "num", "data", "status"), ["book", "num"], "left").drop("num")


def contents(objs: DataFrame, paged: DataFrame) -> DataFrame:
    """Rows (book, unit, content): a page's streams joined by line ends; parts that can't be read are left out."""
    parts = _streams(objs, paged).where("status = 'OK'")
    joined = parts.groupBy("book", "unit").agg(F.array_sort(F.collect_list(F.struct("pos", F.decode("data", "ISO-8859-1").alias("t")))).alias("ps"))
    return joined.select("book", "unit", F.array_join(F.transform("ps", lambda p: p["t"]), "\n").alias("content"))


def text_operators(content: Column) -> Column:
    """How many operators of a page show text; strings are left out first."""
    bare = F.regexp_replace(F.regexp_replace(content, "(?s)\\((?:[^()\\\\]++|\\\\.)*+\\)", "()"), "<[0-9A-Fa-f \\t\\r\\n]*>", "()")
    return F.regexp_count(bare, F.lit("(?:\\)|\\]|[ \\t\\r\\n])[ \\t\\r\\n]*(?:Tj|TJ|'|\")(?![A-Za-z0-9])"))


def named(objs: DataFrame, holders: DataFrame, key: str, kind: str) -> DataFrame:
    """Rows (book, key, name, num): what the resources of ``holders`` (book, key, body) name, of one kind: Font or XObject."""
    body = holders.select("book", key, "body", _ref(F.col("body"), "Resources").alias("r")).join(objs.select("book", F.col("num").alias("r"), F.col("body").alias("rb")), ["book", "r"], "left")
    body = body.select("book", key, F.concat_ws(" ", "body", "rb").alias("body"))
    body = body.withColumn("f", _ref(F.col("body"), kind)).join(objs.select("book", F.col("num").alias("f"), F.col("body").alias("fb")), ["book", "f"], "left")
    listed = F.concat_ws(" ", F.regexp_extract("body", f"(?s)/{kind}[ \\t\\r\\n]*<<(.*?)>>", 1), "fb")
    names = F.arrays_zip(
        F.regexp_extract_all(listed, F.lit("/([^ /<>\\t\\r\\n]+)[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R"), F.lit(1)).alias("name"),
        F.regexp_extract_all(listed, F.lit("/[^ /<>\\t\\r\\n]+[ \\t\\r\\n]+([0-9]+)[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R"), F.lit(1)).alias("num"),
    )
    return body.select("book", key, F.explode(names).alias("n")).select("book", key, F.col("n.name").alias("name"), F.col("n.num").cast("int").alias("num"))


def fonts(objs: DataFrame, holders: DataFrame, key: str = "unit") -> DataFrame:
    """Rows (book, key, fonts): by name what each font of a page, or of another holder, is: its own text, its descendant's, its encoding's and its map to Unicode."""
    rows = named(objs, holders, key, "Font").join(objs.select("book", "num", F.col("body").alias("font")), ["book", "num"])
    for name, ref in (("descendant", _value(F.col("font"), "DescendantFonts", "\\[[ \\t\\r\\n]*([0-9]+)").cast("int")), ("encoding", _ref(F.col("font"), "Encoding")), ("unicode", _ref(F.col("font"), "ToUnicode"))):
        text = F.coalesce(F.decode("data", "ISO-8859-1"), F.col("body"))
        rows = rows.withColumn("k", ref).join(objs.select("book", F.col("num").alias("k"), text.alias(name)), ["book", "k"], "left").drop("k")
    own = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("name", "font", "descendant", "encoding", "unicode")])
    return rows.groupBy("book", key).agg(F.collect_list(own).alias("fonts"))


_ESCAPED = "(?s)\\\\(?:[0-7]{1,3}|\r\n|.)|[^\\\\]+"


def _string(text: Column, key: str) -> Column:
    """The bytes of a string in a dictionary, in parentheses (one level inside them) or hexadecimal; null if there is none."""
    plain = "(?:[^()\\\\]++|\\\\.)"  # loops without a way back: others recurse once for each character
    literal = _value(text, key, f"\\(((?:{plain}|\\({plain}*+\\))*+)\\)")

    def one(part: Column) -> Column:
        escaped = F.substring(part, F.lit(2), F.length(part))
        octal = F.char((F.conv(escaped, 8, 10).cast("int")) % 256)
        named = F.translate(escaped, "nrtbf", "\n\r\t\b\f")
        meant = F.when(escaped.rlike("^[0-7]"), octal).when(escaped.rlike("^[\r\n]"), F.lit("")).otherwise(named)
        return F.when(F.startswith(part, F.lit("\\")), meant).otherwise(part)

    whole = F.array_join(F.transform(F.regexp_extract_all(literal, F.lit(_ESCAPED), F.lit(0)), one), "")
    digits = F.regexp_replace(_value(text, key, "<([0-9A-Fa-f \\t\\r\\n]+)>"), "[ \\t\\r\\n]", "")
    return F.coalesce(F.encode(whole, "ISO-8859-1"), F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits)))


def opened(books: DataFrame, objs: DataFrame, paged: DataFrame) -> DataFrame:
    """Rows (book, version, objects, units, title, author, rebuilt, encrypted, error), one for each of books (book, content).

    rebuilt says that the place named after startxref, within the last 2048 bytes, is no cross-reference; encrypted is no error.
    """
    text = F.decode("content", "ISO-8859-1")
    head = F.instr(F.left(text, F.lit(1024)), "%PDF-") - 1
    place = F.regexp_extract(F.right(text, F.lit(2048)), "(?s)startxref[ \\t\\r\\n]+([0-9]+)(?!.*startxref)", 1)
    there = F.substring(text, F.greatest(head, F.lit(0)) + F.coalesce(F.nullif(place, F.lit("")).try_cast("int"), F.lit(2**30)) + 1, F.lit(1000))
    trailers = F.regexp_extract_all(text, F.lit("/Info[ \\t\\r\\n]+([0-9]{1,7})[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R"), F.lit(1))
    rows = books.select(
        "book", version(F.col("content")).alias("version"), (F.octet_length("content") > 0).alias("filled"), F.try_element_at(trailers, F.lit(-1)).cast("int").alias("info"),
        ((F.octet_length("content") > 0) & ~there.rlike("(?s)^[ \\t\\r\\n]*(?:xref|[0-9]+[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+obj(?:(?!endobj|stream).)*/XRef)")).alias("rebuilt"), text.rlike("/Encrypt[ \\t\\r\\n]").alias("encrypted"),
    )
    own = [metadata_text(_string(F.col("body"), k)).alias(k.lower()) for k in ("Title", "Author")]
    rows = rows.join(objs.select("book", F.col("num").alias("info"), *own), ["book", "info"], "left")
    rows = rows.join(objs.groupBy("book").agg(F.count("*").alias("objects")), "book", "left").join(paged.groupBy("book").agg(F.count("*").alias("units")), "book", "left")
    error = F.when(~F.coalesce("filled", F.lit(False)), "empty file").when(F.col("version").isNull(), "no %PDF- header").when(F.col("units").isNull(), "no pages")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("objects", "units")]
    return rows.select("book", "version", *counts, "title", "author", "rebuilt", "encrypted", error.alias("error"))


def _counted(objs: DataFrame, paged: DataFrame) -> DataFrame:
    """Rows (book, unit, streams, ok, images, bytes, ops): what a page's streams hold; pages without any have 0 of all. ops counts those of forms, each time they are called."""
    state, ok = F.col("status"), F.col("status") == "OK"
    found = _streams(objs, paged).groupBy("book", "unit").agg(
        F.count("*").alias("streams"), F.count_if(ok).alias("ok"), F.count_if(state == codecs.IMAGE).alias("images"), F.sum(F.when(ok, F.octet_length("data"))).alias("bytes"),
        F.sum(F.when(ok, text_operators(F.decode("data", "ISO-8859-1")))).alias("ops"),
    )
    rows = paged.select("book", "unit").join(found, ["book", "unit"], "left")
    own = pdf_forms.forms(objs)
    if not own.isEmpty():
        called = pdf_forms.called(objs, paged, own).groupBy("book", "unit").agg(F.sum("ops").alias("more"))
        rows = rows.join(called, ["book", "unit"], "left").withColumn("ops", F.coalesce("ops", F.lit(0)) + F.coalesce("more", F.lit(0)))
    return rows.select("book", "unit", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("streams", "ok", "images", "bytes", "ops")])


def report(objs: DataFrame, paged: DataFrame) -> DataFrame:
    """One row a book with pages: its pages, their streams, fonts and text operators, and a verdict.

    A font counts once for each page that names it. Pages without contents are neither pages of text nor of images.
    """
    rows = _counted(objs, paged).groupBy("book").agg(
        F.count("*").alias("pages"), F.count_if(F.col("streams") > 0).alias("with_contents"), F.sum("ok").alias("streams_ok"), F.sum("images").alias("streams_image"),
        F.sum(F.col("streams") - F.col("ok") - F.col("images")).alias("streams_error"), F.sum("bytes").alias("bytes"),
        F.count_if(F.col("ops") > 0).alias("text_pages"), F.sum("ops").alias("text_ops"), F.count_if((F.col("streams") > 0) & (F.col("ops") == 0)).alias("image_pages"),
    )
    font = fonts(objs, paged).select("book", F.explode("fonts.font").alias("f"))
    kind = F.regexp_extract("f", "/Subtype[ \\t\\r\\n]*/([A-Za-z0-9]+)", 1)
    kinds = {"type1": kind.isin("Type1", "MMType1"), "truetype": kind == "TrueType", "type0": kind == "Type0", "other": ~kind.isin("Type1", "MMType1", "TrueType", "Type0"), "to_unicode": F.col("f").contains("/ToUnicode")}
    by = font.groupBy("book").agg(*[F.count_if(c).alias(f"fonts_{n}") for n, c in kinds.items()])
    verdict = F.when(F.col("streams_ok") == 0, "unreadable").when(F.col("streams_error") > F.col("streams_ok"), "damaged").when(F.col("text_pages") == 0, "no text layer").otherwise("text")
    counts = [F.coalesce(f"fonts_{n}", F.lit(0).cast("long")).alias(f"fonts_{n}") for n in kinds]
    return rows.join(by, "book", "left").select(*rows.columns, *counts, verdict.alias("verdict"))


def text_layer(objs: DataFrame, paged: DataFrame) -> DataFrame:
    """Rows (book, units, sampled, with_text, text_ops, verdict): what the first page and those at each quarter show, if they can be read."""
    units = paged.groupBy("book").agg(F.count("*").alias("units"))
    chosen = units.select("book", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.floor(k * F.col("units") / 4).cast("int")))).alias("unit"))
    probes = paged.join(chosen, ["book", "unit"], "left_semi")
    seen = _counted(objs, probes).where("ok > 0").groupBy("book").agg(F.count("*").alias("sampled"), F.count_if(F.col("ops") > 0).alias("with_text"), F.sum("ops").alias("text_ops"))
    verdict = F.when(F.col("sampled").isNull(), "nothing sampled").when(F.col("with_text") == 0, "no text layer").otherwise("text")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("sampled", "with_text", "text_ops")]
    return units.join(seen, "book", "left").select("book", "units", *counts, verdict.alias("verdict"))


# Names of glyphs that text fonts use beyond those of one character.
GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6",
    "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@", "bracketleft": "[",
    "backslash": "\\", "bracketright": "]", "underscore": "_", "braceleft": "{", "bar": "|", "braceright": "}", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“",
    "quotedblright": "”", "endash": "–", "emdash": "—", "ellipsis": "…", "bullet": "•", "fi": "ﬁ", "fl": "ﬂ", "guillemotleft": "«", "guillemotright": "»", "germandbls": "ß",
}
ACCENTS = {"acute": "\u0301", "grave": "\u0300", "circumflex": "\u0302", "dieresis": "\u0308", "tilde": "\u0303", "cedilla": "\u0327", "ring": "\u030a", "caron": "\u030c"}


def glyph_text(name: str) -> str:
    """A glyph's character by its name: listed, uniXXXX or uXXXX, one character, or a letter and an accent; '' if unknown."""
    import unicodedata

    name = name.split(".")[0]
    if name in GLYPHS or len(name) == 1:
        return GLYPHS.get(name, name)
    m = re.fullmatch(r"uni([0-9A-Fa-f]{4})|u([0-9A-Fa-f]{4,6})", name)
    if m:
        cp = int(m[1] or m[2], 16)
        return chr(cp) if cp < 0xD800 or 0xDFFF < cp <= 0x10FFFF else ""
    if name[1:] in ACCENTS:
        return unicodedata.normalize("NFC", name[0] + ACCENTS[name[1:]])
    return ""


def _hex_text(digits: str) -> str:
    return bytes.fromhex(digits).decode("utf-16-be", "ignore")


class Font:
    """A font's codes to text and widths, from the texts of its objects."""

    def __init__(self, f) -> None:
        font, descendant, encoding, cmap = f["font"], f["descendant"], f["encoding"], f["unicode"]
        self.wide = "/Type0" in font
        self.text: dict[int, str] = {}
        self.widths: dict[int, float] = {}
        if not self.wide:
            kind = "mac_roman" if "MacRoman" in font + encoding else "cp1252"
            self.text = {c: t for c in range(32, 256) if (t := bytes([c]).decode(kind, "ignore"))}
            code = 0
            for item in re.findall(r"/([^ /\[\]<>\s]+)|(\d+)", (re.search(r"/Differences\s*\[(.*?)\]", font + " " + encoding, re.S) or ["", ""])[1]):
                if item[1]:
                    code = int(item[1])
                else:
                    self.text[code] = glyph_text(item[0]) or self.text.get(code, "")
                    code += 1
            first = int((re.search(r"/FirstChar\s+(\d+)", font) or [0, 0])[1])
            for i, w in enumerate(re.findall(r"-?[\d.]+", (re.search(r"/Widths\s*\[(.*?)\]", font, re.S) or ["", ""])[1])):
                self.widths[first + i] = float(w)
        self.default = float((re.search(r"/DW\s+(\d+)", descendant) or [0, 1000])[1]) if self.wide else 500.0
        for m in re.finditer(r"(\d+)\s*(?:\[([^\]]*)\]|(\d+)\s+(-?[\d.]+))", (re.search(r"/W\s*\[(.*)\]", descendant, re.S) or ["", ""])[1]):
            if m[2] is not None:
                self.widths.update({int(m[1]) + i: float(w) for i, w in enumerate(m[2].split())})
            else:
                self.widths.update(dict.fromkeys(range(int(m[1]), min(int(m[3]), 65535) + 1), float(m[4])))
        self.ranges: list[tuple[int, int, list[str]]] = []
        for kind, part in re.findall(r"beginbf(char|range)(.*?)endbf", cmap, re.S):
            if kind == "char":
                for a, t in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]*)>", part):
                    self.ranges.append((int(a, 16), int(a, 16), [_hex_text(t)]))
            else:
                for a, b, t, many in re.findall(r"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]*)>|\[(.*?)\])", part, re.S):
                    self.ranges.append((int(a, 16), int(b, 16), [_hex_text(x) for x in re.findall(r"<([0-9A-Fa-f]*)>", many)] if many else [_hex_text(t)]))

    def unicode(self, code: int) -> str:
        for a, b, to in self.ranges:
            if a <= code <= b and to:
                if len(to) > 1:
                    return to[code - a] if code - a < len(to) else ""
                last = ord(to[0][-1]) + code - a if to[0] else 0xD800
                return to[0][:-1] + chr(last) if not 0xD800 <= last <= 0xDFFF else ""
        return "" if self.wide else self.text.get(code, "")

    def width(self, code: int) -> float:
        return self.widths.get(code) or self.default

    @cached_property
    def _of_bytes(self) -> tuple[dict[int, str], bytes, list[float]]:
        """Of a font of one byte a code: the text of each code, the codes that have any, their widths."""
        texts = {c: self.unicode(c) for c in range(256)}
        return texts, bytes(c for c, t in texts.items() if t), [self.width(c) for c in range(256)]

    @cached_property
    def _of_code(self) -> dict[int, tuple[str, float]]:
        return {}

    def shown(self, data: bytes) -> tuple[str, int, int, float, int]:
        """What a string shows: text, codes, how many of them have none, the sum of widths, spaces of one byte."""
        if not self.wide:
            texts, mapped, widths = self._of_bytes
            return data.decode("latin-1").translate(texts), len(data), len(data.translate(None, mapped)), sum(map(widths.__getitem__, data)), data.count(32)
        codes, known = [int.from_bytes(data[i : i + 2], "big") for i in range(0, len(data), 2)], self._of_code
        for code in codes:
            if code not in known:
                known[code] = self.unicode(code), self.width(code)
        texts, widths = zip(*map(known.__getitem__, codes))
        return "".join(texts), len(codes), texts.count(""), sum(widths), 0


class _Fonts(dict):
    """Fonts by the texts of their objects, read once for all pages of a task that name them; beyond ``most`` the table starts anew."""

    def of(self, f, most: int = 200) -> Font:
        key = f["font"], f["descendant"], f["encoding"], f["unicode"]
        if key not in self:
            if len(self) >= most:
                self.clear()
            self[key] = Font(f)
        return self[key]


# Loops in strings never go back: their branches begin with different characters.
_TOKEN = re.compile(r"%[^\r\n]*|\((?:[^()\\]++|\\.|\((?:[^()\\]++|\\.)*+\))*+\)|<<|>>|<[0-9A-Fa-f\s]*>|/[^\s/<>\[\](){}%]*|[\[\]{}]|[^\s/<>\[\](){}%]+", re.S)
_ESCAPE = re.compile(rb"\\(?:([0-7]{1,3})|\r\n?|(.))", re.S)
_PLAIN = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b""}


def string_bytes(token: str) -> bytes:
    """The bytes of a literal or hexadecimal string."""
    if token[0] == "<":
        return codecs.ascii_hex(token[1:].encode("latin-1"))
    raw = token[1:-1].encode("latin-1")
    if b"\\" not in raw:
        return raw
    return _ESCAPE.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1] else _PLAIN.get(m[2], m[2]) if m[2] else b"", raw)


def number(token: str) -> float:
    """Numbers as found in the wild: --5 is -5, 34- is 34, a lone point 0."""
    m = re.match(r"([+-]*)(\d*\.?\d*)", token)
    value = float(m[2]) if m and any(c.isdigit() for c in m[2]) else 0.0
    return -value if m and "-" in m[1] else value


def _times(a: tuple, b: tuple) -> tuple:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


_ONE = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def interpret(content: str, listed: list, begun: list[float] | None = None, fonts: _Fonts | None = None) -> dict:
    """Text runs and calls of one stream of a page or form; text without a known font is passed over."""
    known = {f["name"]: f for f in listed}
    fonts = _Fonts() if fonts is None else fonts
    loaded: dict[str, Font] = {}
    state = {"ctm": _ONE, "font": None, **(STATE if begun is None else dict(zip(STATE, begun)))}
    stack: list[dict] = []
    tm = line = _ONE
    args: list = []
    array: list | None = None
    runs: list[dict] = []
    calls: list[dict] = []

    def show(data: bytes) -> None:
        nonlocal tm
        font = state["font"]
        if font is None or not data:
            return
        size = (state["fs"] * state["th"], 0.0, 0.0, state["fs"], 0.0, state["ts"])
        m = _times(tm, state["ctm"])
        begin = _times(size, m)
        text, codes, unmapped, width, spaces = font.shown(data)
        move = width / 1000 * state["fs"] + codes * state["tc"] + spaces * state["tw"]
        tm = _times((1.0, 0.0, 0.0, 1.0, move * state["th"], 0.0), tm)
        end = _times(size, _times(tm, state["ctm"]))
        dx, dy = end[4] - begin[4], end[5] - begin[5]
        if text:
            at = len(runs) + len(calls)
            runs.append({"at": at, "text": text, "x": begin[4], "y": begin[5], "fs": state["fs"], "ux": m[2], "uy": m[3], "dx": dx, "dy": dy, "codes": codes, "unmapped": unmapped})

    def advance(x: float, y: float) -> None:
        nonlocal tm, line
        tm = line = _times((1.0, 0.0, 0.0, 1.0, x, y), line)

    if "BI" in content:
        content = re.sub(r"(?s)\bBI\s.*?\sID\s.*?\sEI(?=\s|$)", " ", content)
    for token in _TOKEN.findall(content):
        c = token[0]
        if c == "%":
            continue
        if c in "(<" and token != "<<":
            (args if array is None else array).append(string_bytes(token))
        elif c == "[":
            array = []
        elif c == "]":
            args.append(array or [])
            array = None
        elif c == "/":
            args.append(token[1:])
        elif c in "+-.0123456789":
            (args if array is None else array).append(number(token))
        elif array is None:
            nums = [a for a in args if isinstance(a, float)]
            strings = [a for a in args if isinstance(a, bytes)]
            n = len(nums)
            if token == "q":
                stack.append(dict(state))
            elif token == "Q" and stack:
                state = stack.pop()
            elif token == "cm" and n >= 6:
                state["ctm"] = _times(tuple(nums[-6:]), state["ctm"])
            elif token == "BT":
                tm = line = _ONE
            elif token == "Tf" and n:
                name = next((a for a in reversed(args) if isinstance(a, str)), "")
                if name in known and name not in loaded:
                    loaded[name] = fonts.of(known[name])
                state["font"], state["fs"] = loaded.get(name), nums[-1]
            elif token in ("Td", "TD") and n >= 2:
                if token == "TD":
                    state["tl"] = -nums[-1]
                advance(nums[-2], nums[-1])
            elif token == "Tm" and n >= 6:
                tm = line = tuple(nums[-6:])
            elif token == "T*":
                advance(0.0, -state["tl"])
            elif token in ("Tc", "Tw", "TL", "Ts") and n:
                state[token.lower()] = nums[-1]
            elif token == "Tz" and n:
                state["th"] = nums[-1] / 100 or 1.0
            elif token == "Tj" and strings:
                show(strings[-1])
            elif token in ("'", '"') and strings:
                if token == '"' and n >= 2:
                    state["tw"], state["tc"] = nums[-2], nums[-1]
                advance(0.0, -state["tl"])
                show(strings[-1])
            elif token == "Do" and args and isinstance(args[-1], str):
                calls.append({"at": len(runs) + len(calls), "name": args[-1], "m": list(state["ctm"]), "state": [state[k] for k in STATE]})
            elif token == "TJ" and args and isinstance(args[-1], list):
                for item in args[-1]:
                    if isinstance(item, bytes):
                        show(item)
                    else:
                        tm = _times((1.0, 0.0, 0.0, 1.0, -item / 1000 * state["fs"] * state["th"], 0.0), tm)
            args = []
    return {"runs": runs, "calls": calls}


def _interpret(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    fonts = _Fonts()
    for content, listed, *more in batches:
        begun = more[0] if more else [None] * len(content)
        yield pd.DataFrame([interpret(c or "", list(f) if f is not None else [], b, fonts) for c, f, b in zip(content, listed, begun)], columns=["runs", "calls"])


def placed(run: Column) -> list[Column]:
    """A run's columns as its page has them, its fields being those of SHOWN after all matrices."""
    scale = F.hypot(run["ux"], run["uy"])
    size = run["fs"] * F.when(scale == 0, 1.0).otherwise(scale)
    plain = lambda *names: [run[n].alias(n) for n in names]
    return [*plain("text", "x", "y"), size.alias("size"), F.hypot(run["dx"], run["dy"]).alias("width"), *plain("dx", "dy", "codes", "unmapped")]


def runs(books: DataFrame) -> DataFrame:
    """Rows (book, unit, seq, text, x, y, size, width, dx, dy, codes, unmapped, mb_x0, mb_y0, mb_x1, mb_y1, rotate) of books (book, content)."""
    objs = objects(books)
    paged = pages(objs)
    box = F.transform(F.regexp_extract_all(F.regexp_extract("body", "(?s)/MediaBox[ \\t\\r\\n]*\\[([^\\]]*)\\]", 1), F.lit("-?[0-9.]+"), F.lit(0)), lambda x: x.cast("double"))
    whole = F.when(F.size(box) == 4, box).otherwise(F.array(*[F.lit(x) for x in (0.0, 0.0, 612.0, 792.0)]))
    sized = paged.select("book", "unit", whole.alias("b"), F.coalesce(_value(F.col("body"), "Rotate", "(-?[0-9]+)").cast("int"), F.lit(0)).alias("rotate"))
    rows = contents(objs, paged).join(fonts(objs, paged), ["book", "unit"], "left")
    shown = rows.select("book", "unit", F.pandas_udf(_interpret, SHOWN)("content", "fonts").alias("s"))
    own = pdf_forms.forms(objs)
    if own.isEmpty():
        made = shown.select("book", "unit", F.posexplode("s.runs").alias("seq", "r")).select("book", "unit", "seq", *placed(F.col("r")))
    else:
        made = pdf_forms.runs(objs, paged, own, shown)
    corner = [F.least(F.col("b")[i], F.col("b")[i + 2]).alias(f"mb_{c}0") for i, c in ((0, "x"), (1, "y"))]
    far = [F.greatest(F.col("b")[i], F.col("b")[i + 2]).alias(f"mb_{c}1") for i, c in ((0, "x"), (1, "y"))]
    return made.join(sized, ["book", "unit"]).select(*made.columns, *corner, *far, "rotate")
