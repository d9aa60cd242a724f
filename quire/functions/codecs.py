"""Byte codecs of embedded streams (COD-*), small helpers for Arrow batches."""

import base64
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OK, BAD_DATA, IMAGE, UNKNOWN = "OK", "ERR_DATA", "ERR_IMAGE", "ERR_UNKNOWN"
SHORT = {"Fl": "FlateDecode", "LZW": "LZWDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode"}
IMAGES = {"DCTDecode", "DCT", "JPXDecode", "CCITTFaxDecode", "CCF", "JBIG2Decode"}


class BadData(ValueError):
    pass


def flate(data: bytes) -> bytes:
    """zlib, else raw deflate; what was decoded before an error counts, nothing at all doesn't."""
    data = data.lstrip(b"\r\n\t ")
    for bits in (15, -15):
        out, d = [], zlib.decompressobj(bits)
        try:
            for i in range(0, len(data), 256):
                out.append(d.decompress(data[i : i + 256]))
            return b"".join([*out, d.flush()])
        except zlib.error:
            if any(out):
                return b"".join(out)
    raise BadData("flate")


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def ascii85(data: bytes) -> bytes:
    data = re.sub(rb"[\s\0]", b"", data.strip().removeprefix(b"<~").split(b"~")[0])
    groups = re.findall(rb"z|[!-u]{1,5}", data)
    if b"".join(groups) != data:
        raise BadData("ascii85")
    out = []
    for g in groups:
        if g == b"z":
            out.append(b"\0\0\0\0")
        elif len(g) > 1:
            value = 0
            for c in g.ljust(5, b"u"):
                value = (value * 85 + c - 33) % 2**32
            out.append(value.to_bytes(4, "big")[: len(g) - 1])
    return b"".join(out)


def run_length(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        else:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
    return b"".join(out)


def lzw(data: bytes, early: int = 1) -> bytes:
    """Codes of 9 to 12 bits, high bits first; 256 clears, 257 ends."""
    bits, have, width = 0, 0, 9
    table: list[bytes] = []
    last, out = b"", []
    for byte in data:
        bits, have = (bits << 8 | byte) & 0xFFFFFFFF, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [], 9, b""
            continue
        if code < 256:
            word = bytes([code])
        elif code - 258 < len(table):
            word = table[code - 258]
        elif last and code - 258 == len(table):
            word = last + last[:1]
        else:
            break
        if last and len(table) < 4096 - 258:
            table.append(last + word[:1])
        out.append(word)
        last = word
        width = min(12, max(9, (len(table) + 258 + early).bit_length()))
    return b"".join(out)


def predictor(data: bytes, kind: int, columns: int = 1, colors: int = 1, bits: int = 8) -> bytes:
    """Undoes TIFF (2) and PNG (10 to 15) prediction; a cut last row goes."""
    step, row = max(1, colors * bits // 8), (columns * colors * bits + 7) // 8
    if row > len(data):
        return b""
    if kind == 2 and bits == 8:
        rows = np.frombuffer(data[: len(data) // row * row], np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    if kind < 10:
        return data
    out, above = [], bytearray(row)
    for i in range(0, len(data) - row, row + 1):
        how, now = data[i], bytearray(data[i + 1 : i + 1 + row])
        for k in range(row):
            left, up, corner = now[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
            if how == 1:
                now[k] = now[k] + left & 255
            elif how == 2:
                now[k] = now[k] + up & 255
            elif how == 3:
                now[k] = now[k] + (left + up) // 2 & 255
            elif how == 4:
                guess = left + up - corner
                nearest = min((abs(guess - left), 0, left), (abs(guess - up), 1, up), (abs(guess - corner), 2, corner))
                now[k] = now[k] + nearest[2] & 255
        out.append(bytes(now))
        above = now
    return b"".join(out)


#: What a stream's parameters hold, all whole numbers, and what each is if it is not given.
PARAMETERS = {"Predictor": 1, "Columns": 1, "Colors": 1, "BitsPerComponent": 8, "EarlyChange": 1}


def decode(data: bytes, filters: list[str], parms: list[dict] | dict | None = None) -> tuple[bytes, str]:
    """A chain of filters; one dictionary of parameters belongs to the first. Returns bytes and a status."""
    given = [parms] if isinstance(parms, dict) else list(parms or [])
    for i, name in enumerate(filters):
        name, own = SHORT.get(name, name), (given[i] if i < len(given) else None) or {}
        if name in IMAGES:
            return data, IMAGE
        try:
            if name == "FlateDecode":
                data = flate(data)
            elif name == "LZWDecode":
                data = lzw(data, own.get("EarlyChange", 1))
            elif name == "ASCIIHexDecode":
                data = ascii_hex(data)
            elif name == "ASCII85Decode":
                data = ascii85(data)
            elif name == "RunLengthDecode":
                data = run_length(data)
            elif name != "Crypt":
                return data, UNKNOWN
        except BadData:
            return b"", BAD_DATA
        if own.get("Predictor", 1) > 1 and name in ("FlateDecode", "LZWDecode"):
            data = predictor(data, own["Predictor"], own.get("Columns", 1), own.get("Colors", 1), own.get("BitsPerComponent", 8))
    return data, OK


def _decode_all(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
    for content, filters, *parms in batches:
        given = [[{k: int(p[k]) for k in PARAMETERS} for p in ps] if ps is not None else [] for ps in parms[0]] if parms else [None] * len(content)
        yield pd.DataFrame([decode(bytes(c or b""), list(f) if f is not None else [], p) for c, f, p in zip(content, filters, given)], columns=["data", "status"])


def decoded(content: Column, filters: Column, parms: Column | None = None) -> Column:
    """Struct (data, status) of a binary column, an array of filter names and, parallel to it, one of structs of PARAMETERS without nulls."""
    # Most streams of many files have no filter: their bytes stay where they are.
    bare = F.coalesce(F.size(filters), F.lit(0)) <= 0
    kind = T.StructType().add("data", "binary").add("status", "string")
    made = F.pandas_udf(_decode_all, kind)(F.when(~bare, content), filters, *([] if parms is None else [F.when(~bare, parms)]))
    return F.when(bare, F.struct(F.coalesce(content, F.lit(b"")).alias("data"), F.lit(OK).alias("status"))).otherwise(made)


def _encode_all(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for content, name in batches:
        yield pd.Series([encode(bytes(c or b""), n) for c, n in zip(content, name)])


def encode(data: bytes, name: str) -> bytes:
    """The inverse of some filters, for tests and round trips."""
    if name == "FlateDecode":
        return zlib.compress(data)
    if name == "ASCIIHexDecode":
        return data.hex().encode() + b">"
    if name == "ASCII85Decode":
        return base64.a85encode(data) + b"~>"
    if name == "RunLengthDecode":
        return b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"
    return data


def encoded(content: Column, name: Column) -> Column:
    return F.pandas_udf(_encode_all, T.BinaryType())(content, name)
