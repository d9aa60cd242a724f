"""Values in the dictionaries of PDF files, as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import codecs

OBJECT = "(?s)(?<![0-9])([0-9]{1,7})[ \\t\\r\\n]+([0-9]{1,5})[ \\t\\r\\n]+obj\\b(.*?)endobj"


def _value(text: Column, key: str, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, f"(?s)/{key}[ \\t\\r\\n]*{pattern}", 1), F.lit(""))


def _ref(text: Column, key: str) -> Column:
    return _value(text, key, "([0-9]+)[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R").cast("int")


def _refs(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)[ \\t\\r\\n]+[0-9]+[ \\t\\r\\n]+R"), F.lit(1)), lambda x: x.cast("int"))


def _parms(head: Column) -> Column:
    """The parameters of a stream's filters, an array of structs of codecs.PARAMETERS; ``null`` stands for a filter without any."""
    given = F.regexp_extract(head, "(?s)/(?:DecodeParms|DP)[ \\t\\r\\n]*(\\[[^\\]]*\\]|<<.*?>>)", 1)
    each = F.regexp_extract_all(given, F.lit("(?s)(<<.*?>>|null)"), F.lit(1))

    def number(p: Column, key: str, default: int) -> Column:
        n = F.coalesce(_value(p, key, "([0-9]{1,9})").cast("int"), F.lit(default))
        return (n if key == "EarlyChange" else F.greatest(n, F.lit(1))).alias(key)

    return F.transform(each, lambda p: F.struct(*[number(p, k, d) for k, d in codecs.PARAMETERS.items()]))
