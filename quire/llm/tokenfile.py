"""Token ids in files, compressed by the range coder.

Documents are dealt by ascending doc_id over shards, one for each partition. A shard is a file
of chunks; a chunk is a table of its documents and blocks of at most BLOCK_TOKENS ids, each coded from a fresh
state and checksummed, so every block can be read alone. A document longer than a block runs on in the
next one of its chunk. The index has a row for each chunk: where it is, and how many ids it holds.

    chunk    = "QIDS" version:u8 head_bytes:u32 head blocks
    head     = zlib of JSON {"doc_ids": [...], "n_tokens": [...], "blocks": [[n_tokens, bytes, crc32 of the ids], ...]}

A task writes its shard under a name of its own attempt and the index, written by Spark's commit protocol, names those
that count: a lost executor's halves are never read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rangecoder
from .common import fresh_path, shuffle_partitions, written
from .tokens import BYTE_LEVEL, encoder, slabs, tokenizer_path

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
#: Ids after which a chunk is closed; a block holds as many at most.
BLOCK_TOKENS = 2**22
MAGIC, VERSION = b"QIDS", 1


def _store(path: str):
    """A file system and the path in it."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path)


def write_chunk(names: list[str | None], lengths: list[int], ids: np.ndarray, vocabulary: int, block_tokens: int = BLOCK_TOKENS) -> bytes:
    """Documents (id as text, number of ids) and all their ids."""
    blocks, parts = [], []
    for a in range(0, len(ids), block_tokens):
        own = ids[a : a + block_tokens]
        data = rangecoder.encode(own, vocabulary)
        blocks.append([len(own), len(data), zlib.crc32(own.astype("<u4").tobytes())])
        parts.append(data)
    head = zlib.compress(json.dumps({"doc_ids": names, "n_tokens": lengths, "blocks": blocks}).encode())
    return b"".join([MAGIC, struct.pack("<BI", VERSION, len(head)), head, *parts])


def read_chunk(data: bytes, vocabulary: int) -> Iterator[tuple[str | None, np.ndarray]]:
    """Documents and their ids; raises ValueError if a checksum fails."""
    version, size = struct.unpack_from("<BI", data, 4)
    if data[:4] != MAGIC or version != VERSION:
        raise ValueError("not a chunk of token ids")
    head = json.loads(zlib.decompress(data[9 : 9 + size]))
    at, blocks = 9 + size, iter(head["blocks"])
    held = np.zeros(0, np.uint32)
    for name, n in zip(head["doc_ids"], head["n_tokens"]):
        more = []
        have = len(held)
        while have < n:
            count, length, crc = next(blocks)
            own = rangecoder.decode(data[at : at + length], count, vocabulary).astype(np.uint32)
            if zlib.crc32(own.astype("<u4").tobytes()) != crc:
                raise ValueError("a block of token ids fails its checksum")
            at += length
            more.append(own)
            have += count
        if more:
            held = np.concatenate([held, *more])
        yield name, held[:n]
        held = held[n:]


_INDEX = "shard long, chunk long, path string, offset long, length long, n_docs long, n_tokens long"
_INDEX_ARROW = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in _INDEX.split(", ")])


def _write_shard(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end_id: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    coder = encoder(tokenizer, BYTE_LEVEL)
    vocabulary = coder.tokenizer.get_vocab_size()
    shard = TaskContext.get().partitionId()
    names: list[str | None] = []
    lengths: list[int] = []
    parts: list[np.ndarray] = []
    rows: list[tuple] = []
    file, offset, held, where = None, 0, 0, f"{path}/shard-{shard:06d}-{uuid.uuid4().hex}.qids"
    store, inside = _store(where)

    def close() -> None:
        nonlocal file, offset
        if file is None:
            store.create_dir(inside.rpartition("/")[0], recursive=True)
            file = store.open_output_stream(inside, compression=None)
        data = write_chunk(names, lengths, np.concatenate(parts), vocabulary, block_tokens)
        file.write(data)
        rows.append((shard, len(rows), where, offset, len(data), len(names), sum(lengths)))
        offset += len(data)
        names.clear()
        lengths.clear()
        parts.clear()

    for batch in batches:
        own_names, at = batch.column(0).to_pylist(), 0
        for texts in slabs(batch.column(1)):
            flat, counts = coder.encode(texts)
            ends = np.cumsum(counts)
            flat, counts = np.insert(flat, ends, end_id), counts + 1
            start = 0
            while start < len(counts):
                # As many documents as fill a chunk.
                ends = np.cumsum(counts[start:])
                stop = min(start + int(np.searchsorted(ends, block_tokens - held)) + 1, len(counts))
                n = int(ends[stop - start - 1])
                names += own_names[at + start : at + stop]
                lengths += counts[start:stop].tolist()
                parts.append(flat[:n])
                flat, start, held = flat[n:], stop, held + n
                if held >= block_tokens:
                    close()
                    held = 0
            at += len(texts)
    if names:
        close()
    if file is not None:
        file.close()
    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=[c.split()[0] for c in _INDEX.split(", ")]), schema=_INDEX_ARROW, preserve_index=False)


def write_token_files(
    docs: DataFrame, path: str | None = None, tokenizer: str | None = None, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS
) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) and returns the index of chunks, with each chunk's first place (start).

    Shards and, in them, chunks and documents ascend by doc_id, null doc_ids first; rows that repeat a doc_id are
    documents of their own, in order of their texts. A null text is empty: it has the end id alone. An empty table
    gives an empty index and no file.
    """
    spark = docs.sparkSession
    path, tokenizer = path or fresh_path(spark, "token_ids"), tokenizer or tokenizer_path(VOCABULARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_shard(batches, path, tokenizer, end_id, block_tokens)

    rows = docs.select("doc_id", "text").repartitionByRange(shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select(F.col("doc_id").cast("string"), "text")
    index = written(rows.mapInArrow(run, _INDEX), "token_index")
    inside = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    shards = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    shards = shards.select("shard", F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    return index.join(shards, "shard").withColumn("start", F.col("first") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).drop("first")


def _read(batches: Iterator[pd.DataFrame], vocabulary: int) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, offset, length, start in zip(batch["path"], batch["offset"], batch["length"], batch["start"]):
            store, inside = _store(path)
            with store.open_input_file(inside) as file:
                file.seek(offset)
                data = file.read(length)
            rows, size = [], 0
            for name, ids in read_chunk(data, vocabulary):
                rows.append((name, start, len(ids), ids.astype("<u4").tobytes()))
                start += len(ids)
                size += len(ids)
                if size > 2**20:
                    yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
                    rows, size = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])


def read_token_files(index: DataFrame, tokenizer: str | None = None, doc_id_type: str = "long") -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids), one for each document of the chunks in ``index``; ids are little-endian unsigned 32-bit integers."""
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer or tokenizer_path(VOCABULARY)).get_vocab_size()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _read(batches, vocabulary)

    spark = index.sparkSession
    chunks = index.select("path", "offset", "length", "start").repartition(max(shuffle_partitions(spark), 1), "path", "offset")
    got = chunks.mapInPandas(run, "doc_id string, start long, n_tokens long, ids binary")
    return got.withColumn("doc_id", F.col("doc_id").cast(doc_id_type))


def op10_token_files(spark, sf_dir: str) -> DataFrame:
    index = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return read_token_files(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
