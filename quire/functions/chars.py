"""Character and encoding functions as column expressions (CHR-*)."""

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes, as regular expression sets.
LETTER = "A-Za-zÀ-ÖØ-öø-ſ"
LOWER = "a-zß-öø-ÿ"
BREAK_HYPHEN = "\\-‐\u00ad"
TERMINAL = ".!?:;…\"')\\]”’»"
SEPARATOR = " .\\-|\\[\\]–—"

# What the bytes 80 to 9F stand for in CP1252; 81, 8D, 8F, 90 and 9D stay as they are.
C1_BYTES = (0x80, 0x82, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x8B, 0x8C, 0x8E, 0x91, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0x9B, 0x9C, 0x9E, 0x9F)
C1_TEXT = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

# Named entities that books use.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "mdash": "—", "ndash": "–", "hellip": "…",
    "lsquo": "‘", "rsquo": "’", "ldquo": "“", "rdquo": "”", "laquo": "«", "raquo": "»", "eacute": "é", "egrave": "è",
    "agrave": "à", "ccedil": "ç", "atilde": "ã", "otilde": "õ", "aacute": "á", "iacute": "í", "oacute": "ó", "uacute": "ú",
    "acirc": "â", "ecirc": "ê", "ocirc": "ô", "uuml": "ü", "deg": "°", "copy": "©", "trade": "™", "bull": "•",
    "dagger": "†", "sect": "§", "middot": "·",
}

#: An entity or what stands between two; at most nine characters before the semicolon.
ENTITY_OR_TEXT = "&#?[0-9A-Za-z]{1,9};|[^&]+|&"


def is_letters(s: Column) -> Column:
    return s.rlike(f"^[{LETTER}]+$")


def starts_lower(s: Column) -> Column:
    return s.rlike(f"^[{LOWER}]")


def ends_with_break_hyphen(s: Column) -> Column:
    return s.rlike(f"[{BREAK_HYPHEN}]$")


def ends_terminal(s: Column) -> Column:
    return s.rlike(f"[{TERMINAL}]$")


def first_word_length(s: Column) -> Column:
    """Code points of the first word, counted to 41 at most."""
    return F.least(F.lit(41), F.length(F.regexp_extract(s, "^ *([^ ]*)", 1)))


def is_page_number(s: Column) -> Column:
    """At most ten code points, digits or else Roman letters between separators."""
    digits, roman = f"^[{SEPARATOR}]*[0-9][0-9{SEPARATOR}]*$", f"^[{SEPARATOR}]*[ivxlcdmIVXLCDM][ivxlcdmIVXLCDM{SEPARATOR}]*$"
    return (F.length(s) <= 10) & (s.rlike(digits) | s.rlike(roman))


#: Bytes by which an encoding is told, and those that the last sequence begun in them may still have.
SAMPLE, LONGEST = 8192, 3
_WHOLE = "^(?:[\\x00-\\x7F]|[\\xC2-\\xDF][\\x80-\\xBF]|[\\xE0-\\xEF][\\x80-\\xBF]{2}|[\\xF0-\\xF4][\\x80-\\xBF]{3})*+"
_CUT = "^(?:[\\xC2-\\xDF]|[\\xE0-\\xEF][\\x80-\\xBF]?|[\\xF0-\\xF4][\\x80-\\xBF]{0,2})?\\z"


def encoding_of(content: Column, whole: Column | bool = False, sample: int | None = SAMPLE) -> Column:
    """UTF8 or LATIN1, from a byte-order mark or the first ``sample`` bytes (None: all): lead bytes with their continuations. Null for null.

    A sequence that the sample cuts is read on behind it. One that the content's end cuts is fine, unless the content is a ``whole`` file.
    """
    part = F.decode(content if sample is None else F.substring(content, 1, sample + LONGEST), "ISO-8859-1")
    good = F.length(F.regexp_extract(part, _WHOLE, 0))
    enough = good >= (F.length(part) if sample is None else F.least(F.length(part), F.lit(sample)))
    cut = ~(F.lit(whole) if isinstance(whole, bool) else whole) & F.substring(part, good + 1, F.length(part)).rlike(_CUT)
    return F.when(content.isNull(), F.lit(None)).when(has_mark(content) | enough | cut, F.lit("UTF8")).otherwise(F.lit("LATIN1"))


def has_mark(content: Column) -> Column:
    return F.startswith(F.hex(F.substring(content, 1, 3)), F.lit("EFBBBF"))


def latin1_text(content: Column) -> Column:
    """Bytes as CP1252 text."""
    return F.translate(F.decode(content, "ISO-8859-1"), "".join(map(chr, C1_BYTES)), C1_TEXT)


def text_of(content: Column, encoding: Column | None = None) -> Column:
    """A text file's bytes as text, by its encoding (encoding_of(), if none is given), without the mark."""
    bare = F.when(has_mark(content), F.substring(content, F.lit(4), F.octet_length(content))).otherwise(content)
    return F.when((encoding_of(content) if encoding is None else encoding) == "UTF8", utf8_text(bare)).otherwise(latin1_text(bare))


#: Bytes of a metadata string before its last character, of UTF-16BE and of others.
MOST_METADATA = 91, 93


def metadata_text(raw: Column) -> Column:
    """A metadata string: UTF-16BE after its mark, without surrogates, else one byte a character; no character begins after MOST_METADATA bytes."""
    units = F.filter(F.regexp_extract_all(F.substring(F.hex(raw), F.lit(5), F.octet_length(raw) * 2), F.lit("[0-9A-F]{4}"), F.lit(0)), lambda u: ~u.rlike("^D[89A-F]"))
    marked = F.startswith(F.hex(F.substring(raw, 1, 2)), F.lit("FEFF"))
    text = F.when(marked, F.decode(F.unhex(F.array_join(units, "")), "UTF-16BE")).otherwise(F.decode(raw, "ISO-8859-1"))
    most = F.when(marked, MOST_METADATA[0]).otherwise(MOST_METADATA[1])
    whole = F.aggregate(F.split(F.left(text, F.lit(MOST_METADATA[1])), ""), F.lit(""), lambda acc, c: F.when(F.octet_length(acc) < most, F.concat(acc, c)).otherwise(acc))
    return F.nullif(whole, F.lit(""))


def code_point_text(cp: Column) -> Column:
    """The character of a code point; null for none and for surrogates."""
    real = ((cp > 0) & (cp < 0xD800)) | ((cp > 0xDFFF) & (cp <= 0x10FFFF))
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(cp), 8, "0")), "UTF-32"))


def decode_entities(s: Column) -> Column:
    """Named and numeric entities in one pass; what isn't one stays as it is."""
    names = F.create_map(*[F.lit(x) for item in ENTITIES.items() for x in item])

    def one(part: Column) -> Column:
        body = F.substring(part, F.lit(2), F.length(part) - 2)
        number = F.when(
            body.rlike("^#[xX][0-9A-Fa-f]+$"), F.conv(F.substring(body, F.lit(3), F.length(body)), 16, 10).cast("long")
        ).when(body.rlike("^#[0-9]+$"), F.substring(body, F.lit(2), F.length(body)).cast("long"))
        value = F.coalesce(F.try_element_at(names, body), code_point_text(number))
        return F.when(part.rlike("^&.+;$"), F.coalesce(value, part)).otherwise(part)

    return F.array_join(F.transform(F.regexp_extract_all(s, F.lit(ENTITY_OR_TEXT), F.lit(0)), one), "")


_SHAPED = re.compile(rb"[\xC0-\xDF][\x80-\xBF]|[\xE0-\xEF][\x80-\xBF]{2}|[\xF0-\xF7][\x80-\xBF]{3}|[\x80-\xFF]")


def repair_utf8(data: bytes) -> str:
    """Text of bytes; every well-shaped but illegal sequence, and every stray byte, is one U+FFFD."""

    def legal(m: re.Match) -> bytes:
        try:
            m[0].decode("utf-8")
            return m[0]
        except UnicodeDecodeError:
            return b"\xef\xbf\xbd"

    return _SHAPED.sub(legal, data).decode("utf-8")


def _repaired(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in batches:
        yield batch.map(lambda b: None if b is None else repair_utf8(bytes(b)))


def utf8_text(content: Column) -> Column:
    """repair_utf8 of a binary column, in Arrow batches."""
    return F.pandas_udf(_repaired, T.StringType())(content)
