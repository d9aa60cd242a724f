"""Fill-in-middle: documents cut in prefix, middle and suffix, and put together in another order around sentinels.

One table drives a finite automaton over bytes. Its states join what of a UTF-8 sequence is still to come with what of a sentinel
has been read; each transition is marked if its byte begins a unit (a code point) and if it ends a sentinel. The first pass runs the
automaton over blocks of bytes, many side by side, and keeps only how many marked transitions each block had. These counts give the length of a
text in units and tell sentinels; their prefix sums give the block of each cut, and the second pass runs over those blocks alone to find its byte.

No state remembers more than the last few bytes, so a block begins with those before it and needs nothing of the block before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Marks before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Of 100 documents so many are cut, and of 100 of these so many have their suffix first.
CUT_RATE, SUFFIX_FIRST = 90, 20
SEED = "1"
#: Bytes of a block, and of texts that are scanned at a time (one longer text is scanned alone).
BLOCK, SLAB = 512, 1 << 23
UNIT, HIT = 1, 1 << 32

#: (first and last lead byte, bytes that follow, least and largest of the next): the well-formed sequences of Unicode's table 3-7.
LEADS = (
    (0xC2, 0xDF, 1, 0x80, 0xBF), (0xE0, 0xE0, 2, 0xA0, 0xBF), (0xE1, 0xEC, 2, 0x80, 0xBF), (0xED, 0xED, 2, 0x80, 0x9F), (0xEE, 0xEF, 2, 0x80, 0xBF),
    (0xF0, 0xF0, 3, 0x90, 0xBF), (0xF1, 0xF3, 3, 0x80, 0xBF), (0xF4, 0xF4, 3, 0x80, 0x8F),
)
NONE = (0, 0, 0)


def checked(sentinels: tuple[str, ...]) -> tuple[str, ...]:
    """The sentinels, if text around one can never read as another: none in another, no end of one the beginning of one."""
    if len(set(sentinels)) != 3 or not all(sentinels):
        raise ValueError("three different sentinels that are not empty are needed")
    for a in sentinels:
        for b in sentinels:
            if (a != b and a in b) or any(a.endswith(b[:i]) for i in range(1, len(b))):
                raise ValueError(f"the sentinels {a} and {b} overlap")
    return sentinels


def _follows(state: tuple, byte: int) -> tuple[tuple, bool]:
    """The bytes still to come after ``byte``, and whether it begins a unit; a byte that fits nowhere is a unit."""
    left, low, high = state
    if left and low <= byte <= high:
        return ((left - 1, 0x80, 0xBF) if left > 1 else NONE), False
    return next(((n, lo, hi) for a, b, n, lo, hi in LEADS if a <= byte <= b), NONE), True


class Automaton:
    """next[state * 256 + byte] and, for the same transition, marks: UNIT and HIT added up. State 0 is that of a text's beginning."""

    def __init__(self, sentinels: tuple[str, ...] = SENTINELS):
        marks = [s.encode() for s in sentinels]
        begun = {m[:i] for m in marks for i in range(len(m) + 1)}
        self.memory = max(3, *map(len, marks))
        numbers, waiting = {(NONE, b""): 0}, [(NONE, b"")]
        table, counted = [], []
        for follow, seen in waiting:  # grows while it is read
            for byte in range(256):
                then, unit = _follows(follow, byte)
                read = seen + bytes([byte])
                kept = next(read[i:] for i in range(len(read) + 1) if read[i:] in begun)
                state = (then, kept)
                if state not in numbers:
                    numbers[state] = len(numbers)
                    waiting.append(state)
                table.append(numbers[state] * 256)
                counted.append(UNIT * unit + HIT * (kept in marks))
        self.next, self.marks = np.array(table, np.int32), np.array(counted, np.int64)

    def _steps(self, data: np.ndarray, at: np.ndarray, n: np.ndarray, state: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """For each step the transitions taken by the first lanes; lanes (from ``at``, ``n`` bytes) stand in falling order of n."""
        live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), side="left")
        for t, m in enumerate(live.tolist()):
            taken = state[:m] + data[at[:m] + t]
            state[:m] = self.next[taken]
            yield m, taken

    def _begun(self, data: np.ndarray, at: np.ndarray, warm: np.ndarray) -> np.ndarray:
        """States at ``at``, from the ``warm`` bytes before it."""
        state, order = np.zeros(len(at), np.int32), np.argsort(-warm, kind="stable")
        ready = state[order]
        for _ in self._steps(data, (at - warm)[order], warm[order], ready):
            pass
        state[order] = ready
        return state

    def counts(self, data: np.ndarray, at: np.ndarray, n: np.ndarray, warm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Units begun and sentinels ended in each lane."""
        order = np.argsort(-n, kind="stable")
        state, total = self._begun(data, at[order], warm[order]), np.zeros(len(at), np.int64)
        for m, taken in self._steps(data, at[order], n[order], state):
            total[:m] += self.marks[taken]
        out = np.empty_like(total)
        out[order] = total
        return out % HIT, out // HIT

    def places(self, data: np.ndarray, at: np.ndarray, n: np.ndarray, warm: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The byte at which the nth unit (from 0) of each lane begins."""
        order = np.argsort(-n, kind="stable")
        state, left = self._begun(data, at[order], warm[order]), nth[order] + 1
        found = np.zeros(len(at), np.int64)
        for t, (m, taken) in enumerate(self._steps(data, at[order], n[order], state)):
            begins = self.marks[taken] % HIT
            left[:m] -= begins
            here = (left[:m] == 0) & (begins == 1)
            found[:m][here] = t
        out = np.empty_like(found)
        out[order] = found + at[order]
        return out

    def scan(self, data: np.ndarray, ends: np.ndarray, a: np.ndarray, b: np.ndarray, cut: np.ndarray):
        """Of texts side by side in ``data`` (ends: their bounds, from 0 on): units, sentinels and, where ``cut`` and there is none, the bytes after min and max of a % (units + 1) and b % (units + 1) units."""
        sizes = np.diff(ends)
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks
        text = np.repeat(np.arange(len(sizes)), blocks)
        at = ends[text] + (np.arange(len(text)) - first[text]) * BLOCK
        n = np.minimum(BLOCK, ends[text + 1] - at)
        warm = np.minimum(self.memory, at - ends[text])
        units, hits = self.counts(data, at, n, warm)
        before = np.concatenate([[0], np.cumsum(units)])
        ends_of = np.append(first, len(text))
        held = before[ends_of[1:]] - before[ends_of[:-1]]
        found = np.bincount(text, hits, len(sizes)).astype(np.int64)
        cuts = np.sort(np.stack([a % (held + 1), b % (held + 1)]), axis=0)
        bytes_ = np.full(cuts.shape, -1, np.int64)
        for k in range(2):
            ask = np.flatnonzero(cut & (found == 0))
            bytes_[k, ask] = sizes[ask]
            ask = ask[cuts[k, ask] < held[ask]]
            unit = before[first[ask]] + cuts[k, ask]
            lane = np.searchsorted(before, unit, side="right") - 1
            bytes_[k, ask] = self.places(data, at[lane], n[lane], warm[lane], unit - before[lane]) - ends[ask]
        return held, found, cuts, bytes_


def _slabs(ends: np.ndarray) -> Iterator[tuple[int, int]]:
    i = 0
    while i < len(ends) - 1:
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + SLAB, side="right")) - 1)
        yield i, j
        i = j


_automata: dict[tuple[str, ...], Automaton] = {}


def _cuts(sentinels: tuple[str, ...]):
    """Struct (units, sentinels, prefix, middle: units; first, second: bytes) of a text; the last four null where it isn't to be cut."""

    @F.arrow_udf("units long, sentinels long, prefix long, middle long, first long, second long")
    def scanned(text: pa.Array, a: pa.Array, b: pa.Array, cut: pa.Array) -> pa.Array:
        if sentinels not in _automata:
            _automata[sentinels] = Automaton(sentinels)
        text = text.cast(pa.large_binary())
        offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
        held = text.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        a, b, cut = (c.to_numpy(zero_copy_only=False) for c in (a, b, cut))
        parts = []
        for i, j in _slabs(offsets):
            units, hits, cuts, at = _automata[sentinels].scan(data, offsets[i : j + 1], a[i:j], b[i:j], cut[i:j])
            parts.append(np.stack([units, hits, cuts[0], cuts[1] - cuts[0], at[0], at[1]]))
        rows = np.concatenate(parts, axis=1) if parts else np.zeros((6, 0), np.int64)
        whole = rows[4] < 0
        columns = [pa.array(r, mask=None if k < 2 else whole) for k, r in enumerate(rows)]
        return pa.StructArray.from_arrays(columns, ["units", "sentinels", "prefix", "middle", "first", "second"])

    return scanned


def transformed(
    docs: DataFrame, cut_rate: int = CUT_RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED, sentinels: tuple[str, ...] = SENTINELS
) -> DataFrame:
    """``docs`` with the text in its new order, its n_chars if there is one, and columns fim_units, fim_form, fim_prefix and fim_middle.

    A text is plain, left as it is, if it is null (then empty) or empty, holds a sentinel, or a hash of seed and doc_id says so; else it becomes
    P prefix S suffix M middle (psm) or S suffix P prefix M middle (spm), cut at two places that hashes choose; pieces may be empty.
    fim_units counts code points of the text (a byte that belongs to none counts as one), fim_prefix and fim_middle those of the pieces, null if plain.
    Rows of the same doc_id draw the same numbers, a null doc_id those of the empty string. Columns of ``docs`` with the names of the new ones give way;
    an empty table gives no rows. Texts are scanned whole, whatever their length.
    """
    prefix, suffix, middle = checked(tuple(sentinels))
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("fim_digest", 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]
    new = ("fim_units", "fim_form", "fim_prefix", "fim_middle")
    kept = [c for c in docs.columns if c not in new]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.coalesce("text", F.lit("")).cast("binary").alias("fim_bytes"), digest.alias("fim_digest"))
    wanted = (F.octet_length("fim_bytes") > 0) & (h[2] % 100 < cut_rate)
    rows = rows.withColumn("cut", _cuts((prefix, suffix, middle))("fim_bytes", h[0], h[1], wanted))
    text, first, second = F.col("fim_bytes"), F.col("cut.first").cast("int"), F.col("cut.second").cast("int")
    head, mid = F.substring(text, F.lit(1), first), F.substring(text, first + 1, second - first)
    tail = F.substring(text, second + 1, F.octet_length(text))
    mark = {s: F.lit(s).cast("binary") for s in (prefix, suffix, middle)}
    form = F.when(first.isNull(), "plain").when(h[3] % 100 < suffix_first, "spm").otherwise("psm")
    out = (
        F.when(first.isNull(), text)
        .when(h[3] % 100 < suffix_first, F.concat(mark[suffix], tail, mark[prefix], head, mark[middle], mid))
        .otherwise(F.concat(mark[prefix], head, mark[suffix], tail, mark[middle], mid))
        .cast("string")
    )
    put = {"text": out, "n_chars": F.length(out).cast("long")}
    return rows.select(
        *[put.get(c, F.col(f"row.`{c}`")).alias(c) for c in kept],
        F.col("cut.units").alias("fim_units"),
        form.alias("fim_form"),
        F.col("cut.prefix").alias("fim_prefix"),
        F.col("cut.middle").alias("fim_middle"),
    )


def restored(text: Column, form: Column, sentinels: tuple[str, ...] = SENTINELS) -> Column:
    """The text that ``transformed`` was given, from what it gave and the form."""
    prefix, suffix, middle = sentinels

    def between(a: str, b: str) -> Column:
        return F.substring_index(F.substring_index(text, b, 1), a, -1)

    last = F.substring_index(text, middle, -1)
    psm = F.concat(between(prefix, suffix), last, between(suffix, middle))
    spm = F.concat(between(prefix, middle), last, between(suffix, prefix))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    out = transformed(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("fim_units").alias("n"),
        F.col("fim_form").alias("form"),
        F.col("fim_prefix").alias("prefix_chars"),
        F.col("fim_middle").alias("middle_chars"),
        F.sha2(F.col("text").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored(F.col("text"), F.col("fim_form")).cast("binary"), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS g FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || substr(g, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(g, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(g, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(g, 25, 8) AS BIGINT) AS h4 FROM d),
c AS (SELECT doc_id, t, n, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, substr(t, 1, a) AS x, substr(t, a + 1, b - a) AS y, substr(t, b + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || x || '<S>' || z || '<M>' || y ELSE '<S>' || z || '<P>' || x || '<M>' || y END)
         AS output_sha256,
       sha256(t) AS restored_sha256
FROM p
"""
