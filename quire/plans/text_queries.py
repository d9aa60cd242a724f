"""Queries over documents and pages: characters, plain text, XHTML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import chars
from ..functions.joining import join_lines, joined_words
from ..sources import txt, xhtml
from .common import derived, derived_sql, table


def utf8_lengths(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.length("text").cast("long").alias("code_points"), F.octet_length("text").cast("long").alias("bytes"))


def utf8_invalid_probe(spark: SparkSession, d: str) -> DataFrame:
    """Each document's bytes with a cut at the end and an illegal sequence in front, repaired."""
    broken = F.concat(F.unhex(F.lit("E08080C34180")), F.encode("text", "UTF-8"), F.unhex(F.lit("C3")))
    fixed = table(spark, d, "documents").select("doc_id", chars.utf8_text(broken).alias("text"))
    return fixed.select("doc_id", F.left("text", F.lit(4)).alias("head"), F.right("text", F.lit(1)).alias("tail"), F.length("text").cast("long").alias("code_points"))


def encoding_detect(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files, every second one in Latin-1 if all its characters are there: told by all of a file's bytes. A null text has neither encoding nor length."""
    docs = table(spark, d, "documents")
    utf8 = (F.col("doc_id") % 2 == 0) | F.col("text").rlike("[^\\x00-\\xFF]")
    content = F.when(utf8, F.encode("text", "UTF-8")).otherwise(F.encode("text", "ISO-8859-1"))
    rows = docs.select("doc_id", content.alias("content"), chars.encoding_of(content, whole=True, sample=None).alias("encoding"))
    mark = chars.has_mark(F.col("content")).cast("long")  # text_of() drops it, but it is a code point of the document
    return rows.select("doc_id", "encoding", (F.length(chars.text_of(F.col("content"), F.col("encoding"))) + mark).alias("code_points"))


def cp1252_decode(spark: SparkSession, d: str) -> DataFrame:
    return spark.range(0x80, 0x100).select(F.col("id").alias("byte"), F.ascii(chars.latin1_text(F.unhex(F.hex("id")))).cast("long").alias("code_point"))


def char_classes(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "documents").select(F.explode(F.split("text", "")).alias("c")).where("c <> ''")
    c = F.col("c")
    return each.groupBy("c").agg(F.count("*").alias("n")).select(
        "c", "n", c.rlike(f"[{chars.LETTER}]").alias("letter"), c.rlike(f"[{chars.LOWER}]").alias("is_lower"),
        c.rlike(f"[{chars.BREAK_HYPHEN}]").alias("hyphen"), chars.ends_terminal(c).alias("terminal"),
    )


def pagenum_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of documents, and numerals between them, by whether they are page numbers."""
    docs = table(spark, d, "documents")
    text = F.concat(F.lit("- "), F.col("doc_id").cast("string"), F.lit(" -\nxvii\nMIX 4\n"), F.coalesce("text", F.lit("")))
    rows = docs.select("doc_id", F.explode(F.split(text, "\n")).alias("line"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(chars.is_page_number(F.col("line"))).alias("page_numbers"))


def txt_lines(spark: SparkSession, d: str) -> DataFrame:
    return txt.lines(derived(spark, d), "doc_id").select("doc_id", "line_no", "text", "indent", "blank")


def txt_modal_indent(spark: SparkSession, d: str) -> DataFrame:
    return txt.modal_indent(txt.lines(derived(spark, d), "doc_id"), "doc_id")


def txt_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = txt.paragraphs(txt.lines(derived(spark, d), "doc_id"), "doc_id")
    return rows.select("doc_id", F.col("para").cast("int"), "text", "indent", "n_lines", "joins")


def txt_units(spark: SparkSession, d: str) -> DataFrame:
    return txt.units(derived(spark, d), "doc_id")


def txt_unit_flags(spark: SparkSession, d: str) -> DataFrame:
    return txt.unit_flags(txt.units(derived(spark, d), "doc_id"), "doc_id")


def dehyphenate(spark: SparkSession, d: str) -> DataFrame:
    lines = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    return derived(spark, d).select("doc_id", join_lines(lines).alias("text"), joined_words(lines).cast("int").alias("joins"))


def first_words(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", chars.first_word_length(F.col("line")).cast("int").alias("cps"), F.left("line", F.lit(1)).alias("first_cp"), F.right("line", F.lit(2)).alias("last_two"))


def entity_decode(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("&amp;lt; &#233;&#xE9; &bogus; & &hellip;"), F.col("html"))
    return table(spark, d, "pages").select("page_id", chars.decode_entities(text).alias("text"))


def xhtml_tags(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages").select(F.explode(xhtml.tags(F.col("html"))).alias("tag"))
    return rows.groupBy("tag").agg(F.count("*").alias("n"))


def xhtml_attrs(spark: SparkSession, d: str) -> DataFrame:
    """Links of pages, after some in other ways of writing them."""
    html = F.concat(F.lit(LINKS), F.col("html"))
    return table(spark, d, "pages").select("page_id", F.posexplode(xhtml.attributes(html, "a", "href")).alias("pos", "href"))


LINKS = """<a class=x href='one "two" three'>a</a><A  HREF="b c &amp; d's" id=y>b</A><x:a href = plain/e.html rel=z>c</x:a><a data-href="no" href=''>d</a><abbr href="no">"""


def xhtml_title(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", xhtml.tag_text(F.col("html"), "title").alias("title"))


def xhtml_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return xhtml.paragraphs(table(spark, d, "pages"), "page_id")


def xhtml_headings(spark: SparkSession, d: str) -> DataFrame:
    return xhtml_paragraphs(spark, d).where("heading").select("page_id", "para", "text")


def href_resolve(spark: SparkSession, d: str) -> DataFrame:
    return xhtml_attrs(spark, d).select("page_id", "pos", xhtml.resolve(F.concat(F.lit("../x/./"), F.col("href")), "OEBPS/text").alias("path"))


# The same in SQL.
E_SQL = "[^\\x00-\\xFF]"
PREFIX, REST = xhtml.PREFIX, "(?:[ \\t\\r\\n/][^>]*)?>"
UNREAD_SQL = xhtml.UNREAD
_ENT = "MAP {" + ", ".join(f"'{k}': {v!r}" if v != "'" else f"'{k}': ''''" for k, v in chars.ENTITIES.items()).replace('"\'"', "''''") + "}"


def _decode_sql(s: str) -> str:
    body = "t[2:-2]"
    number = (
        f"CASE WHEN regexp_full_match({body}, '#[xX][0-9A-Fa-f]+') THEN TRY_CAST('0x' || t[4:-2] AS BIGINT)"
        f" WHEN regexp_full_match({body}, '#[0-9]+') THEN TRY_CAST(t[3:-2] AS BIGINT) END"
    )
    real = f"CASE WHEN ({number}) > 0 AND (({number}) < 55296 OR ({number}) > 57343) AND ({number}) <= 1114111 THEN chr(CAST({number} AS INTEGER)) END"
    one = f"CASE WHEN regexp_full_match(t, '(?s)&.+;') THEN coalesce(ent[{body}], {real}, t) ELSE t END"
    return f"list_aggregate(list_prepend('', list_transform(regexp_extract_all({s}, '&#?[0-9A-Za-z]{{1,9}};|[^&]+|&'), lambda t: {one})), 'string_agg', '')"


LINES_SQL = """
  SELECT doc_id, i - 1 AS line_no, trim(l, ' ' || chr(9)) AS text, length(replace(regexp_extract(l, '^[ \\t]*'), chr(9), '        ')) AS indent
  FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '\\n\\z', ''), chr(10)) AS ls FROM d WHERE text <> ''),
       generate_series(1, len(ls)) AS g(i), LATERAL (SELECT ls[i] AS l)"""
JOINED_SQL = (
    f"regexp_replace(regexp_replace(regexp_replace({{0}}, '([{chars.LETTER}])[{chars.BREAK_HYPHEN}]\\n([{chars.LOWER}])', '\\1\\2', 'g'),"
    f" '([{chars.BREAK_HYPHEN}])\\n', '\\1', 'g'), '\\n', ' ', 'g')"
)
JOINS_SQL = f"CAST(len(regexp_extract_all({{0}}, '[{chars.LETTER}][{chars.BREAK_HYPHEN}]\\n[{chars.LOWER}]')) AS INTEGER)"
MODE_SQL = """
  SELECT doc_id, arg_max(bin, n * 100 - bin) AS base_indent FROM (
    SELECT doc_id, least(indent, 8) AS bin, count(*) AS n FROM l WHERE text <> '' GROUP BY ALL) GROUP BY doc_id"""
MARKED_SQL = f"""
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    html, '{xhtml.UNREAD}', '', 'g'), '{xhtml.HEADING}', chr(2), 'g'), '{xhtml.BLOCK}', chr(1), 'g'), '<[^>]*>', '', 'g'), '<[^>]*\\z', ''),
    '{xhtml.NBSP}', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'), '[\\x01\\x02 ]*\\x02[\\x01\\x02 ]*', chr(2), 'g') AS s FROM pages"""
PARAS_SQL = f"""
WITH m AS ({MARKED_SQL}),
p AS (SELECT page_id, list_filter(regexp_extract_all(regexp_replace(s, ' ?(?:\\x01 ?)+', chr(1), 'g'), '[\\x01\\x02]?[^\\x01\\x02]+'),
                                  lambda x: trim(translate(x, chr(1) || chr(2), '')) <> '') AS ps FROM m),
e AS (SELECT {_ENT} AS ent)
SELECT page_id, CAST(i - 1 AS INTEGER) AS para, {_decode_sql("trim(translate(ps[i], chr(1) || chr(2), ''))")} AS text, ps[i][1] = chr(2) AS heading
FROM p, e, generate_series(1, len(ps)) AS g(i)"""
_LINKS_SQL = "'" + LINKS.replace("'", "''") + "'"
# What follows the sign of equality up to the tag's end, then the rule for quotes.
HREF_SQL = f"""
  SELECT page_id, i - 1 AS pos, replace(replace(replace(replace(replace(CASE WHEN v[1] IN ('"', '''') THEN split_part(v[2:], v[1], 1) ELSE split_part(v, ' ', 1) END,
         '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS href
  FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all({_LINKS_SQL} || html, '(?i)<{PREFIX}a[ \\t\\r\\n][^>]*'), lambda t: regexp_extract(t, '(?is)^.*?[ \\t\\r\\n]href[ \\t]*(=.*)$', 1)),
                                    lambda v: v <> '') AS vs FROM pages), generate_series(1, len(vs)) AS g(i), LATERAL (SELECT ltrim(vs[i][2:], ' ' || chr(9)) AS v)"""

QUERIES = {
    f.__name__: f
    for f in (
        utf8_lengths, utf8_invalid_probe, encoding_detect, cp1252_decode, char_classes, pagenum_lines, txt_lines, txt_modal_indent, txt_paragraphs,
        txt_units, txt_unit_flags, dehyphenate, first_words, entity_decode, xhtml_tags, xhtml_attrs, xhtml_title, xhtml_paragraphs, xhtml_headings, href_resolve,
    )
}


def units_sql(relation: str) -> str:
    """Rows (doc_id, unit, "from", "to", clean) of a relation (doc_id, text, latin): its line ends and blank lines are listed once, each cut is looked up in them."""
    target, slack = txt.UNIT_TARGET, txt.UNIT_SLACK
    return f"""
ul AS (SELECT doc_id, latin, string_split(text, chr(10)) AS ls FROM ({relation}) WHERE text <> ''),
ub AS (SELECT doc_id, i, CASE WHEN latin THEN length(ls[i]) ELSE octet_length(encode(ls[i])) END AS n, regexp_full_match(ls[i], '[\\r \\t]*') AS blank, len(ls) AS k FROM ul, generate_series(1, len(ls)) AS g(i)),
up AS (SELECT doc_id, i, k, sum(n + 1) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS p, lead(blank) OVER (PARTITION BY doc_id ORDER BY i) AS before_blank, sum(n + 1) OVER (PARTITION BY doc_id) - 1 AS total FROM ub),
uq AS (SELECT *, lead(p) OVER (PARTITION BY doc_id ORDER BY i) + 1 AS e FROM up),
us AS (SELECT doc_id, max(total) AS total, coalesce(list(p ORDER BY i) FILTER (i < k), []) AS nl, coalesce(list({{'s': p, 'e': e}} ORDER BY i) FILTER (i < k - 1 AND before_blank), []) AS bl FROM uq GROUP BY doc_id),
ur AS (SELECT doc_id, -1 AS unit, 0::HUGEINT AS "from", 0::HUGEINT AS "to", TRUE AS clean, TRUE AS next_clean FROM us
       UNION ALL
       SELECT doc_id, unit + 1, start, CASE WHEN start + {target} >= total THEN total WHEN b IS NOT NULL THEN b.e WHEN l IS NOT NULL THEN l + 1 ELSE least(start + {target + slack}, total) END,
              next_clean, start + {target} >= total OR b IS NOT NULL
       FROM (SELECT doc_id, unit, "to" AS start, total, next_clean, list_filter(bl, lambda x: x.s >= "to" + {target} AND x.e <= least("to" + {target + slack}, total))[1] AS b,
                    list_filter(nl, lambda x: x >= "to" + {target} AND x < least("to" + {target + slack}, total))[1] AS l FROM ur JOIN us USING (doc_id) WHERE "to" < total)),
units AS (SELECT doc_id, CAST(unit AS INTEGER) AS unit, CAST("from" AS BIGINT) AS "from", CAST("to" AS BIGINT) AS "to", clean FROM ur WHERE unit >= 0)"""


_DERIVED_UNITS = f"WITH RECURSIVE {units_sql(f'SELECT doc_id, text, FALSE AS latin FROM ({derived_sql()})')}"
ORACLE = {
    "txt_units": f"{_DERIVED_UNITS} SELECT * FROM units",
    "txt_unit_flags": f"""{_DERIVED_UNITS} SELECT *, unit > 0 AND NOT clean AS cont, coalesce(NOT lead(clean) OVER (PARTITION BY doc_id ORDER BY unit), FALSE) AS open FROM units""",
    "utf8_lengths": "SELECT doc_id, CAST(length(text) AS BIGINT) AS code_points, CAST(octet_length(encode(text)) AS BIGINT) AS bytes FROM documents",
    "utf8_invalid_probe": "SELECT doc_id, chr(65533) || chr(65533) || 'A' || chr(65533) AS head, chr(65533) AS tail, CAST(length(text) + 5 AS BIGINT) AS code_points FROM documents",
    "encoding_detect": f"""
SELECT doc_id, CASE WHEN text IS NULL THEN NULL WHEN doc_id % 2 = 0 OR regexp_matches(text, '{E_SQL}') OR length(text) = octet_length(encode(text)) THEN 'UTF8' ELSE 'LATIN1' END AS encoding,
       CAST(length(text) AS BIGINT) AS code_points FROM documents""",
    "cp1252_decode": "SELECT CAST(b AS BIGINT) AS byte, CAST(CASE "
    + " ".join(f"WHEN b = {b} THEN {ord(c)}" for b, c in zip(chars.C1_BYTES, chars.C1_TEXT))
    + " ELSE b END AS BIGINT) AS code_point FROM range(128, 256) AS r(b)",
    "char_classes": f"""
SELECT c, count(*) AS n, regexp_matches(c, '[{chars.LETTER}]') AS letter, regexp_matches(c, '[{chars.LOWER}]') AS is_lower,
       regexp_matches(c, '[{chars.BREAK_HYPHEN}]') AS hyphen, regexp_matches(c, '[{chars.TERMINAL.replace("'", "''")}]') AS terminal
FROM (SELECT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> '' GROUP BY c""",
    "pagenum_lines": f"""
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (length(l) <= 10 AND (regexp_full_match(l, '[{chars.SEPARATOR}]*[0-9][0-9{chars.SEPARATOR}]*')
       OR regexp_full_match(l, '[{chars.SEPARATOR}]*[ivxlcdmIVXLCDM][ivxlcdmIVXLCDM{chars.SEPARATOR}]*'))) AS page_numbers
FROM (SELECT doc_id, unnest(string_split('- ' || doc_id || ' -' || chr(10) || 'xvii' || chr(10) || 'MIX 4' || chr(10) || coalesce(text, ''), chr(10))) AS l FROM documents)
GROUP BY doc_id""",
    "txt_lines": f"WITH d AS ({derived_sql()}) SELECT doc_id, CAST(line_no AS INTEGER) AS line_no, text, CAST(indent AS INTEGER) AS indent, text = '' AS blank FROM ({LINES_SQL})",
    "txt_modal_indent": f"WITH d AS ({derived_sql()}), l AS ({LINES_SQL}) SELECT doc_id, CAST(base_indent AS INTEGER) AS base_indent FROM ({MODE_SQL})",
    "txt_paragraphs": f"""
WITH d AS ({derived_sql()}), l AS ({LINES_SQL}), b AS ({MODE_SQL}),
s AS (SELECT l.*, CASE WHEN l.text <> '' AND (coalesce(lag(l.text = '') OVER w, TRUE) OR indent > base_indent + 1) THEN 1 ELSE 0 END AS st
      FROM l JOIN b USING (doc_id) WINDOW w AS (PARTITION BY doc_id ORDER BY line_no)),
p AS (SELECT *, sum(st) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS para FROM s),
g AS (SELECT doc_id, para, string_agg(text, chr(10) ORDER BY line_no) AS t, arg_min(indent, line_no) AS indent, count(*) AS n_lines FROM p WHERE text <> '' GROUP BY ALL)
SELECT doc_id, CAST(para AS INTEGER) AS para, {JOINED_SQL.format("t")} AS text, CAST(indent AS INTEGER) AS indent, n_lines, {JOINS_SQL.format("t")} AS joins FROM g""",
    "dehyphenate": f"""
WITH d AS ({derived_sql()}), j AS (SELECT doc_id, array_to_string(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> ''), chr(10)) AS t FROM d)
SELECT doc_id, {JOINED_SQL.format("t")} AS text, {JOINS_SQL.format("t")} AS joins FROM j""",
    "first_words": """
SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CAST(least(41, length(regexp_extract(ls[i], '^ *([^ ]*)', 1))) AS INTEGER) AS cps, left(ls[i], 1) AS first_cp, right(ls[i], 2) AS last_two
FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents), generate_series(1, len(ls)) AS g(i)""",
    "entity_decode": f"WITH e AS (SELECT {_ENT} AS ent) SELECT page_id, {_decode_sql(chr(39) + '&amp;lt; &#233;&#xE9; &bogus; & &hellip;' + chr(39) + ' || html')} AS text FROM pages, e",
    "xhtml_tags": f"SELECT lower(t) AS tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<{PREFIX}([A-Za-z][A-Za-z0-9]*)[^>]*>', 1)) AS t FROM pages) GROUP BY ALL",
    "xhtml_attrs": f"SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM ({HREF_SQL})",
    "href_resolve": f"""SELECT page_id, CAST(pos AS INTEGER) AS pos, array_to_string(list_concat(['OEBPS', 'x'], list_filter(string_split(regexp_replace(href, '#.*$', ''), '/'), lambda x: x NOT IN ('', '.'))), '/') AS path
FROM ({HREF_SQL})""",
    "xhtml_title": f"SELECT page_id, left(trim(regexp_extract(html, '(?is)<{PREFIX}title{REST}([^<]*)', 1)), 95) AS title FROM pages",
    "xhtml_paragraphs": PARAS_SQL,
    "xhtml_headings": f"SELECT page_id, para, text FROM ({PARAS_SQL}) WHERE heading",
}
