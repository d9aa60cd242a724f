"""Sharding: documents in order of doc_id, cut at equal sums of bytes into contiguous shards.

The rows are sorted over ranges once, and written. The bytes and rows of each written partition are summed, and running
sums over these totals, a row for each partition, give the place at which a partition begins in the whole. Running sums inside the partitions
finish the place of every document, and the places at which one shard ends and the next begins are put beside the partition in which they fall.
Documents themselves move once: what follows the sort reads their sizes only, and a document finds its shard in the few cuts of its own partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SHARDS = 8
#: monotonically_increasing_id() has the partition above this bit and the row in it below.
ROW_BITS = 33
NEW = ("shard", "slot", "shard_size")


def byte_size(text: Column) -> Column:
    """The bytes of the text in UTF-8, none for null, and one for its end."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long") + 1


def _ordered(docs: DataFrame) -> DataFrame:
    """Rows (row, shard_size, at), written: ``at`` has the partition of the sort and the row in it.

    Rows of the same doc_id stand in order of a hash of the text. Rows that repeat that, too, are dealt by the place they were
    read at, so that copies of one row, however many, are cut as others are; which of them goes where can't be told from the result.
    """
    kept = [c for c in docs.columns if c not in NEW]
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"),
        byte_size(F.col("text")).alias("shard_size"),
        F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("tie"),
        F.monotonically_increasing_id().alias("nth"),
    )
    order = [F.col("row.doc_id").asc_nulls_first(), "tie", "nth"]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return written(rows.select("row", "shard_size", F.monotonically_increasing_id().alias("at")), "ordered")


def _cuts(ordered: DataFrame, shards: int) -> DataFrame:
    """Rows (part, rows_before, cuts) for each partition of the sort; cuts: its runs of rows of one shard, as structs (from, shard, slot_at), in order."""
    sizes = ordered.select("at", "shard_size", F.shiftright("at", ROW_BITS).alias("part"))
    totals = sizes.groupBy("part").agg(F.sum("shard_size").alias("bytes"), F.count("*").alias("rows"))
    # One row for each partition meets here, whatever the documents are.
    all_parts = Window.partitionBy(F.lit(0))
    earlier = all_parts.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(all_parts).alias("all_bytes"),
    )
    totals = written(totals, "totals")
    inside = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sizes.withColumn("run", F.sum("shard_size").over(inside)).join(totals, "part")
    # A document is in the shard in which its middle lies.
    shard = F.expr(f"(2 * (cast(bytes_before as decimal(30,0)) + run) - shard_size) * {int(shards)} div (2 * cast(all_bytes as decimal(30,0)))")
    row = F.col("at") - F.shiftleft("part", ROW_BITS) + F.col("rows_before")
    runs = placed.select("part", "rows_before", "at", shard.cast("int").alias("shard"), row.alias("place"))
    runs = runs.groupBy("part", "rows_before", "shard").agg(F.min("at").alias("from"), F.min("place").alias("place"))
    # One row for each partition and shard that meet: partitions and shards, added up.
    begins = runs.groupBy("shard").agg(F.min("place").alias("shard_at"))
    runs = runs.join(begins, "shard")
    cut = F.struct("from", "shard", (F.col("place") - F.col("shard_at")).alias("slot_at"))
    return runs.groupBy("part", "rows_before").agg(F.array_sort(F.collect_list(cut)).alias("cuts"))


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """``docs`` with shard (int, from 0), slot (its place in the shard, gapless from 0) and shard_size (bytes of the text and one).

    Shards are contiguous in order of doc_id, nulls first, and of a hash of the text where doc_ids repeat. Each holds the documents whose middle byte lies in
    its part of all bytes, so its sum misses the equal share by at most half a document at each end; a document larger than that share can leave others empty.
    Null text is as empty text, and counts one byte. Equal texts stay together only as their doc_ids do: a group may exceed a shard.
    Columns of ``docs`` with the names of the new ones give way; an empty table gives no rows. The rows come from a written table, and a second reading gives the same.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    ordered = _ordered(docs)
    cuts = written(_cuts(ordered, shards), "cuts")
    here = F.element_at(F.filter("cuts", lambda c: c["from"] <= F.col("at")), -1)
    rows = ordered.withColumn("part", F.shiftright("at", ROW_BITS)).join(cuts, "part").withColumn("here", here)
    return rows.select("row.*", F.col("here.shard").alias("shard"), (F.col("here.slot_at") + F.col("at") - F.col("here.from")).alias("slot"), "shard_size")


def write_shards(docs: DataFrame, folder: str, shards: int = SHARDS) -> None:
    """The rows of ``sharded`` as Parquet files under ``folder``, a folder ``shard=n`` for each; a task holds neighbours, so it writes to few of them."""
    sharded(docs, shards).write.partitionBy("shard").parquet(folder)


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    out = sharded(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("shard_size").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: crc32 by its definition: bytes from the right, the reversed polynomial 0xEDB88320, all ones before and after.
OP12_SQL = """
WITH poly AS (
  SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(CAST(b AS BIGINT), CAST(range(8) AS BIGINT[])),
           lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS size,
             list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes FROM d),
c AS (SELECT doc_id, text, size, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes),
             lambda c, b: xor(c >> 8, t[CAST(xor(c & 255, b) AS BIGINT) + 1])), 4294967295) AS text_crc32 FROM s, poly),
r AS (SELECT *, CAST(sum(size) OVER (ORDER BY doc_id NULLS FIRST, md5(text) ROWS UNBOUNDED PRECEDING) AS HUGEINT) AS run,
             CAST(sum(size) OVER () AS HUGEINT) AS total FROM c),
p AS (SELECT *, CAST((2 * run - size) * 8 // (2 * total) AS INTEGER) AS shard FROM r)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY run) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM p
"""
