"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line's normal form is its words, lower-cased, joined by single spaces. Two lines
repeat each other if their normal forms are equal or, from MIN_WORDS words on, if one
word inserted, deleted or replaced turns one into the other. A line is dropped if any earlier
line (by doc_id, then place) repeats it, whatever became of that one. Blank lines stay.

Equal lines meet by a 128-bit hash. For the others, all variants with one word
deleted are emitted as hashed keys:

* lines of equal length with an equal variant at the same place differ in that word;
* a line that equals another's variant lacks that word.

So in a group of equal keys the earliest line decides for all others; no pairs
are formed, and a template that a million lines share costs a million rows. The word
edit of each decision is verified on the words.

Before variants are emitted, lines that cannot have a partner are left out. One edit leaves the
first or the last k words of a line as they were, k at most half of its words: a line that shares neither with
another has no partner, and one that shares its first k words needs variants of the rest only. This
loses nothing, and spares the variants of nearly all lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Words that a line needs for the bound of one edit; shorter lines must be equal. The bound does not grow with the line.
MIN_WORDS = 8
#: A line's place in the order of lines: null doc_ids come last. Rows that repeat (doc_id, text) share their lines' places.
DOC = ["no_id", "id", "text_hash"]
PLACE = [*DOC, "place"]
#: White space besides the space and the line end.
_BLANKS = ("\t", "\x0b", "\x0c", "\r")


def _identity() -> list[Column]:
    return [
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce("doc_id", F.lit(0)).alias("id"),
        F.xxhash64("text").alias("text_hash"),
    ]


def _by_turn(docs: DataFrame) -> DataFrame:
    """Rows (row, no_id, id, text_hash, again): again is true for all but one of the rows that share doc_id and text."""
    own = docs.select(F.struct("*").alias("row"), *_identity())
    repeated = written(own.groupBy(*DOC).agg(F.count("*").alias("n")).where("n > 1").select(*DOC), "repeated_rows")
    same = written(own.join(repeated, DOC, "left_semi").withColumn("at", F.monotonically_increasing_id()), "rows_that_repeat")
    first = same.groupBy(*DOC).agg(F.min("at").alias("first_at"))
    same = same.join(first, DOC).select("row", *DOC, (F.col("at") > F.col("first_at")).alias("again"))
    return own.join(repeated, DOC, "left_anti").select("row", *DOC, F.lit(False).alias("again")).union(same)


def _plain_lines() -> Column:
    """The lines of a row's text in lower case, white space as spaces."""
    text = F.lower("row.text")
    for blank in _BLANKS:
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.split(text, "\n")


def _normal(line: Column) -> Column:
    trimmed = F.trim(line)
    return F.when(F.contains(line, F.lit("  ")), F.regexp_replace(trimmed, " +", " ")).otherwise(trimmed)


def _lines(rows: DataFrame) -> DataFrame:
    """A row for each line with a word: its place, and its normal form (line)."""
    each = rows.where("not again and row.text is not null").select(*DOC, F.posexplode(_plain_lines()).alias("place", "line"))
    return each.withColumn("line", _normal(F.col("line"))).where("line <> ''")


def _words_of(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """``lines`` (PLACE and other columns) with the words of their normal forms (w). Lines that aren't asked for are not formed."""
    asked = lines.groupBy(*DOC).agg(F.collect_list(F.struct(*[c for c in lines.columns if c not in DOC])).alias("asked"))
    own = rows.where("not again").join(asked, DOC).select(*DOC, "asked", _plain_lines().alias("all_lines"))
    each = F.transform("asked", lambda x: F.struct(x.alias("x"), F.get("all_lines", x["place"]).alias("line")))
    own = own.select(*DOC, F.explode(each).alias("e"))
    return own.select(*DOC, "e.x.*", F.split(_normal(F.col("e.line")), " ").alias("w"))


def _edge_keys(line: Column, n: Column) -> dict[str, Column]:
    """Hashes of the first and the last k of a line's n words, k a power of two and at most half of n.

    A line whose number of words is itself a power of two gets those for one word less too: its
    partners that are a word shorter have that k.
    """

    def key(side: str, k: Column) -> Column:
        return F.xxhash64(F.lit(side), k, F.call_function("substring_index", line, F.lit(" "), k if side == "first" else -k))

    def power(m: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1), F.length(F.bin(m)) - 2)  # half the highest bit of m

    k, less = power(n), power(n - 1)
    return {
        "first_key": F.when(n >= MIN_WORDS, key("first", k)),
        "last_key": F.when(n >= MIN_WORDS, key("last", k)),
        "first_key_less": F.when((n >= MIN_WORDS) & (k != less), key("first", less)),
        "last_key_less": F.when((n >= MIN_WORDS) & (k != less), key("last", less)),
    }


def _candidates(distinct: DataFrame) -> DataFrame:
    """The distinct lines that share an edge with another, and which (first_shared, last_shared); line_id ascends with their places."""
    names = ["first_key", "last_key", "first_key_less", "last_key_less"]
    keys = distinct.where("first_key is not null")
    each = keys.select(F.explode(F.array_compact(F.array(*names))).alias("edge"))
    common = written(each.groupBy("edge").agg(F.count("*").alias("n")).where("n > 1").select("edge"), "common_edges")
    sides = F.array(*[F.struct(F.col(c).alias("edge"), F.lit(c.startswith("first")).alias("is_first")) for c in names])
    rows = keys.select("first", F.explode(sides).alias("e")).select("first", "e.edge", "e.is_first").where("edge is not null")
    shared = rows.join(common, "edge", "left_semi")
    found = shared.groupBy("first").agg(F.max("is_first").alias("first_shared"), F.max(~F.col("is_first")).alias("last_shared"))
    placed = found.select("first.*", "first_shared", "last_shared").repartitionByRange(*PLACE).sortWithinPartitions(*PLACE)
    return written(placed.withColumn("line_id", F.monotonically_increasing_id()), "candidates")


def _variants(texts: DataFrame) -> DataFrame:
    """Rows (first, key, j): the hashed line with word j left out, and whole (j = -1)."""

    # The hash of a line is the sum of its words' hashes, each by word and place, so that with a word left
    # out it is the sum before that word and the sum after it with places one less. 44 bits a word: sums of half a million fit.
    def at(place: Column, salt: str) -> Column:
        return F.shiftrightunsigned(F.xxhash64(F.lit(salt), "word", place), 20)

    # The lines are dealt out before their words are: the windows need no exchange of their own.
    each = texts.repartition("line_id").select("line_id", "first_shared", "last_shared", F.size("w").alias("n"), F.posexplode("w").alias("j", "word"))
    each = each.withColumns({f"{s}{d}": at(F.col("j") - d, s) for s in ("a", "b") for d in (0, 1)})
    line = Window.partitionBy("line_id")
    upto = line.orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = {}
    for s in ("a", "b"):
        sums[f"{s}_without"] = F.sum(f"{s}0").over(upto) - F.col(f"{s}0") + F.sum(f"{s}1").over(line) - F.sum(f"{s}1").over(upto)
        sums[f"{s}_whole"] = F.sum(f"{s}0").over(line)
    each = each.withColumns(sums)
    quarter = F.floor(F.col("n") / 4)  # the shared edges are at least so long
    emitted = (F.col("first_shared") & (F.col("j") >= quarter)) | (F.col("last_shared") & (F.col("j") < F.col("n") - quarter))
    out = F.array(
        F.when(emitted, F.struct(F.xxhash64(F.col("n") - 1, "a_without", "b_without").alias("key"), F.col("j").alias("j"))),
        F.when(F.col("j") == 0, F.struct(F.xxhash64("n", "a_whole", "b_whole").alias("key"), F.lit(-1).alias("j"))),
    )
    return each.select("line_id", F.explode(F.array_compact(out)).alias("v")).select("line_id", "v.key", "v.j")


def _near_repeats(rows: DataFrame, distinct: DataFrame) -> DataFrame:
    """Places of the distinct lines with an earlier line one word edit away."""
    texts = written(_words_of(rows, _candidates(distinct)), "candidate_texts")
    keyed = written(_variants(texts), "variants")
    groups = keyed.groupBy("key", "j").agg(F.min("line_id").alias("place_first"), F.count("*").alias("rows"))
    variant = F.col("j") >= 0
    of_key = groups.groupBy("key").agg(
        F.sum("rows").alias("rows"),
        F.min(F.when(~variant, F.col("place_first"))).alias("whole_first"),
        F.min(F.when(variant, F.col("place_first"))).alias("variant_first"),
        F.min_by(F.when(variant, F.col("j")), F.when(variant, F.col("place_first"))).alias("variant_j"),
    )
    of_key = written(of_key.where("rows > 1").drop("rows"), "met_keys")
    met = written(keyed.join(of_key.select("key"), "key", "left_semi"), "met_variants")
    same_place = met.where("j >= 0").groupBy("key", "j").agg(F.min("line_id").alias("place_first"))
    met = met.join(of_key, "key").join(same_place, ["key", "j"], "left")
    # j: the word that is left out of this line; by_j: the word left out of the earlier line, -1 for none
    options = F.array(
        F.struct(F.col("place_first").alias("by"), F.col("j").alias("j"), F.col("j").alias("by_j")),
        F.struct(F.when(variant, F.col("whole_first")).alias("by"), F.col("j").alias("j"), F.lit(-1).alias("by_j")),
        F.struct(F.when(~variant, F.col("variant_first")).alias("by"), F.lit(-1).alias("j"), F.col("variant_j").alias("by_j")),
    )
    met = met.select("line_id", F.explode(options).alias("o")).where(F.col("o.by") < F.col("line_id"))
    best = met.groupBy("line_id").agg(F.min("o").alias("o")).select("line_id", "o.*")
    theirs = texts.select(F.col("line_id").alias("by"), F.col("w").alias("by_w"))
    checked = best.join(texts.select(*PLACE, "line_id", "w"), "line_id").join(theirs, "by")

    def without(w: str, j: str) -> Column:
        cut = F.concat(F.slice(w, F.lit(1), F.col(j)), F.slice(w, F.col(j) + 2, F.size(w)))
        return F.when(F.col(j) < 0, F.col(w)).otherwise(cut)

    return checked.where(without("w", "j") == without("by_w", "by_j")).select(*PLACE)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with its repeated lines taken out of text, plus n_lines and kept_lines (int).

    One row for each row of ``docs``, its other columns as they were, but n_chars, if there is one, which is
    counted anew. Null text stays null and has 0 lines; a text of which every line is repeated becomes
    empty. Columns of docs called n_lines or kept_lines give way. Null doc_ids come last, in order of their texts' hashes.
    Of rows that share doc_id and text one, whichever, keeps lines; the others repeat it. An empty table gives no rows.
    """
    rows = _by_turn(docs)
    n = F.octet_length("line") - F.octet_length(F.replace("line", F.lit(" "), F.lit(""))) + 1
    lines = _lines(rows).withColumn("n", n)
    keys = _edge_keys(F.col("line"), F.col("n"))
    lines = lines.select(
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"), F.struct(*PLACE).alias("first"), *[k.alias(c) for c, k in keys.items()]
    )
    distinct = lines.groupBy("h1", "h2").agg(F.min("first").alias("first"), *[F.min(c).alias(c) for c in keys])
    distinct = written(distinct.drop("h1", "h2"), "distinct_lines")
    kept = distinct.select("first.*").join(_near_repeats(rows, distinct), PLACE, "left_anti")
    kept = kept.groupBy(*DOC).agg(F.collect_list("place").alias("kept"))
    return _of_kept_lines(docs, rows, kept)


def _of_kept_lines(docs: DataFrame, rows: DataFrame, kept: DataFrame) -> DataFrame:
    own = rows.join(kept, DOC, "left")
    own = own.withColumn("all_lines", F.split("row.text", "\n"))
    blank = F.transform("all_lines", lambda x, i: F.when(~x.rlike(r"[^\x20\x09-\x0D]"), i))
    none = F.array().cast("array<int>")
    places = F.array_sort(F.concat(F.when(F.col("again"), none).otherwise(F.coalesce("kept", none)), F.array_compact(blank)))
    own = own.withColumn("lines", F.transform(places, lambda i: F.get("all_lines", i)))
    no_text = F.col("row.text").isNull()
    text = F.when(~no_text, F.array_join("lines", "\n"))
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    counts = {"n_lines": F.when(no_text, 0).otherwise(F.size("all_lines")), "kept_lines": F.when(no_text, 0).otherwise(F.size("lines"))}
    return own.select(
        *[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns if c not in counts], *[x.alias(c) for c, x in counts.items()]
    )


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "n_lines", "kept_lines")


OP1_SQL = """
WITH l AS (
  SELECT doc_id, i - 1 AS place, lines[i] AS line,
         list_filter(string_split_regex(lower(lines[i]), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL), generate_series(1, len(lines)) AS g(i)),
u AS (SELECT w, len(w) AS n, min({'d': doc_id, 'p': place}) AS f FROM l WHERE len(w) > 0 GROUP BY w),
v AS (SELECT w, f, n - 1 AS n, j, list_concat(w[1:j - 1], w[j + 1:]) AS k FROM u, generate_series(1, n) AS g(j) WHERE n >= 8),
x AS (SELECT a.w FROM v a JOIN v b ON a.n = b.n AND a.j = b.j AND a.k = b.k AND b.f < a.f
      UNION SELECT a.w FROM v a JOIN u b ON b.n >= 8 AND a.k = b.w AND b.f < a.f
      UNION SELECT a.w FROM u a JOIN v b ON a.n >= 8 AND b.k = a.w AND b.f < a.f),
s AS (SELECT f.d AS d, f.p AS p FROM u WHERE w NOT IN (SELECT w FROM x)),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.place) AS text, count(*) AS kept
      FROM l LEFT JOIN s ON l.doc_id = s.d AND l.place = s.p WHERE len(l.w) = 0 OR s.d IS NOT NULL GROUP BY l.doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t.text, '') END AS text,
       CAST(coalesce(len(string_split(d.text, chr(10))), 0) AS INTEGER) AS n_lines, CAST(coalesce(t.kept, 0) AS INTEGER) AS kept_lines
FROM documents d LEFT JOIN t USING (doc_id)
"""
