"""XHTML to paragraphs, tags and attributes (XML-*), row by row without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import decode_entities

# Tags that end a block of text; tags whose content isn't read.
BLOCKS = (
    "p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "tr", "td", "th", "hr", "table", "ul", "ol",
    "dd", "dt", "dl", "section", "article", "aside", "figure", "figcaption", "pre", "header", "footer", "nav", "body", "title",
)
SKIPPED = ("head", "script", "style")

PREFIX = "(?:[A-Za-z0-9_.-]+:)?"
REST = "(?:[ \\t\\r\\n/][^>]*)?>"
#: Comments, declarations and skipped elements, the leftmost first; an element that isn't closed runs to the end.
UNREAD = "(?is)<[!?][^>]*>|" + "|".join(f"<{PREFIX}{t}{REST}.*?(?:</{PREFIX}{t}{REST}|\\z)" for t in SKIPPED)
HEADING = f"(?i)<{PREFIX}h[1-6]{REST}"
BLOCK = f"(?i)</?{PREFIX}(?:{'|'.join(BLOCKS)}){REST}"
NBSP = "&(?:nbsp|#0*160|#[xX]0*[aA]0);"


def _closed(s: Column) -> Column:
    """Without a last tag that never ends: after this, a search for the end of a tag always finds one and never passes text twice."""
    tail = F.substring_index(s, ">", -1)
    return F.concat(F.left(s, F.length(s) - F.length(tail)), F.substring_index(tail, "<", 1))


def marked_text(html: Column) -> Column:
    """Text with U+0001 for a break and U+0002 for one that opens a heading, white space collapsed, entities not yet decoded."""
    s = _closed(F.regexp_replace(_closed(F.translate(F.coalesce(html, F.lit("")), "\u0001\u0002", "")), UNREAD, ""))
    s = F.regexp_replace(s, HEADING, "\u0002")
    s = F.regexp_replace(s, BLOCK, "\u0001")
    s = F.regexp_replace(_closed(s), "<[^>]*>", "")
    s = F.regexp_replace(s, NBSP, " ")
    s = F.regexp_replace(s, "[ \\t\\r\\n]+", " ")
    # Spaces beside marks go, then runs of marks become one; each pattern passes a run once, however long it is.
    s = F.regexp_replace(s, "(?<=[\u0001\u0002]) | (?=[\u0001\u0002])", "")
    s = F.regexp_replace(s, "(?<!\u0001)\u0001*+\u0002[\u0001\u0002]*+", "\u0002")
    return F.regexp_replace(s, "\u0001+", "\u0001")


def paragraphs(pages: DataFrame, *keys: str, html: str = "html") -> DataFrame:
    """Rows (keys, para, text, heading): the paragraphs of each page in order, from 0.

    Inline tags vanish without separating words. A heading tag marks the next paragraph with text.
    """
    parts = F.regexp_extract_all(marked_text(F.col(html)), F.lit("[\u0001\u0002]?[^\u0001\u0002]+"), F.lit(0))
    kept = F.filter(parts, lambda p: F.trim(F.translate(p, "\u0001\u0002", "")) != "")
    rows = pages.select(*keys, F.posexplode(kept).alias("para", "marked"))
    text = decode_entities(F.trim(F.translate("marked", "\u0001\u0002", "")))
    return rows.select(*keys, "para", text.alias("text"), F.startswith("marked", F.lit("\u0002")).alias("heading"))


def tags(html: Column) -> Column:
    """Names of all opening tags, without prefix, in lower case."""
    found = F.regexp_extract_all(html, F.lit(f"<{PREFIX}([A-Za-z][A-Za-z0-9]*)[^>]*>"), F.lit(1))
    return F.transform(found, F.lower)


def attributes(html: Column, tag: str, name: str) -> Column:
    """Values of an attribute of all tags of a name that have it, the five XML entities decoded."""
    found = F.regexp_extract_all(html, F.lit(f"(?is)<{PREFIX}{tag}(?:[ \\t\\r\\n][^>]*?)?{_given(name)}"), F.lit(1))
    return F.transform(found, _unquoted)


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of one tag, empty if it has none."""
    return _unquoted(F.regexp_extract(tag, f"(?is){_given(name)}", 1))


def _given(name: str) -> str:
    """An attribute after white space: in quotes of either kind up to the same one, bare up to a space. No value goes beyond the tag."""
    return f"[ \\t\\r\\n]{name}[ \\t]*=[ \\t]*(\"[^\">]*|'[^'>]*|[^ >]*)"


def _unquoted(value: Column) -> Column:
    return decode_xml(F.regexp_replace(value, "^[\"']", ""))


def decode_xml(s: Column) -> Column:
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(text))
    return s


def tag_text(html: Column, tag: str) -> Column:
    """Text after the first tag of a name, up to the next tag, trimmed; 95 characters at most."""
    return F.left(F.trim(F.regexp_extract(html, f"(?is)<{PREFIX}{tag}{REST}([^<]*)", 1)), F.lit(95))


def resolve(href: Column, base: str) -> Column:
    """A reference relative to a folder: anchor cut off, empty and '.' steps dropped, '..' steps up."""
    steps = F.split(F.concat(F.lit(base + "/"), F.regexp_replace(href, "#.*$", "")), "/")
    none = F.array().cast("array<string>")
    path = F.aggregate(
        steps,
        none,
        lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.array_join(path, "/")
