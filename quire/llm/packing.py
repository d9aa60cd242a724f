"""Packing token sequences by best-fit decreasing.

Documents are tokenized where they are read, cut into full windows as long as they fill
them, and the rests are packed: longest first, each into the open window it leaves least room in, found
by a segment tree over remaining capacities. A task packs its documents in groups of about
GROUP_TOKENS, so nothing is shuffled and memory is bounded whatever the input.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import then_free
from .tokens import WORD_LEVEL, encoder, slabs, tokenizer_path

WINDOW = 2048
VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Tokens after which a task closes a group of windows.
GROUP_TOKENS = 2**23
#: Pieces whose ids a worker remembers between tasks.
REMEMBERED = 50_000
#: Room from which a window of a closing group is filled with a cut piece of the emptiest windows.
LEAST_CUT = 32


class Capacities:
    """Open windows by remaining capacity; a segment tree tells the least capacity in use that is large enough."""

    def __init__(self, most: int):
        self.size = 1 << most.bit_length()
        self.used = [0] * (2 * self.size)
        self.windows: list[list[int]] = [[] for _ in range(self.size)]

    def add(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        i = capacity + self.size
        while i:
            self.used[i] += 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, window) with the smallest capacity of at least ``least``; removes it."""
        used, i = self.used, least + self.size
        if not used[i]:
            while i & 1 or not used[i + 1]:  # up until there is something to the right
                i >>= 1
                if i <= 1:
                    return None
            i += 1
            while i < self.size:
                i = 2 * i if used[2 * i] else 2 * i + 1
        capacity = i - self.size
        while i:
            used[i] -= 1
            i >>= 1
        return capacity, self.windows[capacity].pop()


def pack(lengths: list[int], window: int = WINDOW, least_cut: int = LEAST_CUT) -> list[list[tuple[int, int, int]]]:
    """Windows, each a list of (document, start, length), that hold all tokens of documents of these lengths."""
    windows: list[list[tuple[int, int, int]]] = []
    rests = []
    for doc, n in enumerate(lengths):
        full = n // window
        windows += [[(doc, k * window, window)] for k in range(full)]
        if n % window:
            rests.append((n % window, doc, full * window))
    room = Capacities(window)
    opened: dict[int, int] = {}
    for n, doc, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        found = room.take(n)
        if found is None:
            capacity, at = window, len(windows)
            windows.append([])
        else:
            capacity, at = found
        windows[at].append((doc, start, n))
        opened[at] = capacity - n
        if capacity > n:
            room.add(capacity - n, at)
    _fill_by_cuts(windows, {w: r for w, r in opened.items() if r >= least_cut}, window)
    return [w for w in windows if w]


def _fill_by_cuts(windows: list, rooms: dict[int, int], window: int) -> None:
    """Empties the emptiest windows into the room of the others, pieces cut as needed."""
    order = sorted(rooms, key=lambda w: (rooms[w], w))
    low, high = 0, len(order) - 1
    while low < high:
        donor = order[high]
        while windows[donor] and low < high:
            to = order[low]
            doc, start, n = windows[donor].pop()
            m = min(n, rooms[to])
            windows[to].append((doc, start + n - m, m))
            if n > m:
                windows[donor].append((doc, start, n - m))
            rooms[to] -= m
            if not rooms[to]:
                low += 1
        high -= 1


_PIECES = "doc_id string, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in _PIECES.split(", ")])


def _packed(batches: Iterator[pa.RecordBatch], vocabulary: str, end_id: int, window: int, group_tokens: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(vocabulary, WORD_LEVEL)
    partition, sequence = TaskContext.get().partitionId(), 0
    names: list = []
    ids: list[np.ndarray] = []
    held = 0

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal sequence
        rows, size = [], 0
        for own in pack([len(x) for x in ids], window):
            offset = 0
            for doc, start, n in own:
                data = ids[doc][start : start + n].astype("<u4").tobytes()
                rows.append((names[doc], start, n, len(ids[doc]), (partition << 32) + sequence, offset, data))
                offset += n
                size += n
            sequence += 1
            if size > 2**20:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)

    for batch in batches:
        own_names, at = batch.column(0).to_pylist(), 0
        for texts in slabs(batch.column(1)):
            flat, counts = coder.encode(texts)
            ends = np.cumsum(counts)
            # the end id after each document's ids
            flat = np.insert(flat, ends, end_id)
            bounds = np.concatenate(([0], ends + np.arange(1, len(ends) + 1))).tolist()
            for k in range(len(texts)):
                names.append(own_names[at + k])
                ids.append(flat[bounds[k] : bounds[k + 1]])
                held += bounds[k + 1] - bounds[k]
                if held >= group_tokens:
                    yield from close()
                    names.clear()
                    ids.clear()
                    held = 0
            at += len(texts)
    yield from close()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def pack_documents(
    docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID, window: int = WINDOW, group_tokens: int = GROUP_TOKENS
) -> DataFrame:
    """Rows (doc_id, start, length, doc_tokens, sequence_id, offset, ids), one for each piece of a document.

    A document's ids are those of its text and then end_id; a null text has that one id. Pieces of a sequence follow
    one another from offset 0 without a gap and hold ``window`` ids at most; what is left of a window is padding.
    ids are little-endian unsigned 32-bit integers. Rows that repeat a doc_id are documents of their own. Other columns are not
    read; an empty table gives no rows. Sequence ids are unique, not dense.
    """
    vocabulary = vocabulary or tokenizer_path(VOCABULARY)
    kind = docs.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from then_free(_packed(batches, vocabulary, end_id, window, group_tokens), lambda: encoder(vocabulary, WORD_LEVEL).keep(REMEMBERED))

    out = docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, _PIECES)
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def op6_packing(spark, sf_dir: str) -> DataFrame:
    out = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
