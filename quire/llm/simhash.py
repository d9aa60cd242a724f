"""SimHash near-dedup with pivot distance tables.

A fingerprint is 64 majority bits over the hashes of a document's word shingles;
documents whose fingerprints differ in few bits belong together. Equal
fingerprints are one node, so exact copies cost nothing further.

Finding the links:

* Blocks. The 64 bits are cut into blocks, more of them than bits may differ, so two
  linked fingerprints agree on all but ``max_bits`` blocks. Each fingerprint goes to one
  bucket for every choice of agreeing blocks; no link can be missed. Keys are counted first:
  a bucket of one is never written.
* Pivot table. Every fingerprint that shares a bucket has its distances to PIVOTS fixed references; by the
  triangle inequality two fingerprints cannot be linked if any of these differs by more than
  ``max_bits``. Buckets of two are discarded by it before they are written; of the pairs
  that larger ones lead to, below, only those it leaves are verified bit by bit.
* Reference fingerprints in the bucket. In each bucket a few members are drawn as
  references, and every member is compared with them. Members near a
  reference are linked to it at once: a star, not all pairs. This joins large
  groups of near copies in linear time. Only pairs of the same bucket that the stars left in
  different components are compared after it.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import words, written
from .components import components

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SHINGLE = 4
MAX_BITS = 4
#: Fixed reference fingerprints of the pivot table. Each tells some 42 of 100 unrelated pairs apart.
PIVOTS = 16
#: References drawn in each bucket, and the most rounds of drawing them.
REFERENCES = 3
ROUNDS = 3
#: Pairs left to compare, per fingerprint, under which no further round of stars is worth its shuffle.
ENOUGH = 20


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Rows (doc_id, fp) with fp a long whose 64 bits are the fingerprint, one for each row of ``docs``.

    A to Z are lower-cased, words are what stands between white space, shingles of ``shingle`` words
    are joined by a space and hashed whole (XXH64, seed 42); fewer words make one shingle, no words or a
    null text the fingerprint 0. A bit is 1 if it is set in over half of the hashes. Two counters share
    a long: each has 32 bits.
    """
    tagged = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.translate("text", UPPER, UPPER.lower()).alias("t"))
    tagged = tagged.select("doc_id", "row", words(F.col("t")).alias("w"))
    n = F.size("w")
    def joined(i):
        return F.concat_ws(" ", *[F.get("w", i + k) for k in range(shingle)])
    many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(joined(i)))
    hashes = F.when(n >= shingle, many).when(n > 0, F.array(F.xxhash64(F.array_join("w", " "))))
    each = tagged.select("doc_id", "row", F.explode_outer(hashes).alias("h"))
    pair = F.lit(0x0000000100000001)
    counts = each.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.count("h").alias("n"),
        *[F.sum(F.shiftrightunsigned("h", i).bitwiseAND(pair)).alias(f"c{i}") for i in range(32)],
    )
    fp = F.lit(0).cast("long")
    for i in range(32):
        low = (F.col(f"c{i}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("n")).cast("long")
        high = (F.shiftrightunsigned(f"c{i}", 32) * 2 > F.col("n")).cast("long")
        fp = fp.bitwiseOR(F.shiftleft(low, i)).bitwiseOR(F.shiftleft(high, i + 32))
    return counts.select("doc_id", F.coalesce(fp, F.lit(0).cast("long")).alias("fp"))


def distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def _block_masks(n: int, max_bits: int) -> list[int]:
    """Masks of the block choices that linked fingerprints agree on, as signed longs.

    The more fingerprints there are, the more bits a bucket's key has, so that unrelated
    fingerprints rarely meet (once for each four at most, up to 10^8 of them). Any choice is exact.
    """
    def meetings(blocks: int) -> float:
        return comb(blocks, max_bits) * n / 2 ** (64 * (blocks - max_bits) // blocks)

    blocks = next(b for b in range(max_bits + 3, max_bits + 6) if b == max_bits + 5 or meetings(b) <= 0.25)
    ends = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [(1 << ends[i + 1]) - (1 << ends[i]) for i in range(blocks)]
    masks = [sum(c) for c in combinations(parts, blocks - max_bits)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


_TABLE = [f"d{j}" for j in range(PIVOTS)]


def _pivot_distances(fp: str = "fp") -> list[Column]:
    """A fingerprint's row of the pivot table."""
    return [distance(F.col(fp), F.xxhash64(F.lit(f"pivot {j}"))).cast("int").alias(d) for j, d in enumerate(_TABLE)]


def _may_link(a: str, b: str, max_bits: int) -> Column:
    """Whether the pivot table leaves a pair: no coordinate differs by more than max_bits."""
    return F.greatest(*[F.abs(F.col(f"{a}.{d}") - F.col(f"{b}.{d}")) for d in _TABLE]) <= max_bits


def _buckets(fps: DataFrame, max_bits: int) -> DataFrame:
    """Rows (key, fp) of buckets that may hold a link."""
    masks = _block_masks(fps.count(), max_bits)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.lit(m) for m in masks])).alias("choice", "mask"))
    # Two buckets that share a hash are compared as one: more pairs to look at, none lost.
    keyed = keyed.select("fp", F.xxhash64("choice", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    # Spark sizes these keys as if there were one a fingerprint, so that it would broadcast many times what it may.
    met = written(keyed.join(shared.hint("merge"), "key"), "shared_buckets")
    spread = met.select("key", *_pivot_distances()).groupBy("key").agg(
        F.count("*").alias("n"), F.greatest(*[F.max(d) - F.min(d) for d in _TABLE]).alias("apart")
    )
    open_ = spread.where((F.col("n") > 2) | (F.col("apart") <= max_bits)).select("key")
    return written(met.join(open_, "key", "left_semi"), "buckets")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (u, v) whose components are those of all pairs of ``fps`` (column fp, distinct) within max_bits."""
    buckets = _buckets(fps, max_bits)
    member = F.struct("fp", *_pivot_distances())
    stars = None
    for turn in range(ROUNDS):
        drawn = [F.min_by("fp", F.xxhash64("fp", F.lit(s))).alias(f"ref{s}") for s in range(turn * REFERENCES, (turn + 1) * REFERENCES)]
        refs = buckets.groupBy("key").agg(*drawn).select("key", F.explode(F.array_distinct(F.array(*[f"ref{s}" for s in range(turn * REFERENCES, (turn + 1) * REFERENCES)]))).alias("ref"))
        near = buckets.join(refs, "key").where("fp <> ref").select(member.alias("a"), F.struct(F.col("ref").alias("fp"), *_pivot_distances("ref")).alias("b"))
        near = near.where(_may_link("a", "b", max_bits)).where(distance(F.col("a.fp"), F.col("b.fp")) <= max_bits)
        near = near.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v")).distinct()
        stars = written(near if stars is None else stars.union(near).distinct(), "stars")
        comp = components(stars)
        labelled = buckets.join(comp, F.col("fp") == F.col("node"), "left")
        labelled = written(labelled.select("key", "fp", F.coalesce("component", "fp").alias("comp")), "labelled")
        by = labelled.groupBy("key", "comp").agg(F.count("*").alias("n"))
        open_ = by.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
        open_ = open_.where("n * n > own")
        left = open_.agg(F.sum((F.col("n").cast("double") * F.col("n") - F.col("own")) / 2)).first()[0] or 0
        if left <= ENOUGH * labelled.count():
            break
    rest = labelled.join(open_.select("key"), "key").select("key", "fp", "comp", *_pivot_distances())
    a, b = rest.alias("a"), rest.alias("b")
    found = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.comp") < F.col("b.comp")) & _may_link("a", "b", max_bits))
    found = found.where(distance(F.col("a.fp"), F.col("b.fp")) <= max_bits)
    across = found.select(F.col("a.comp").alias("u"), F.col("b.comp").alias("v")).distinct()
    return written(stars.union(across), "links")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows (doc_id, fp, component_id), one for each row of ``docs``.

    component_id is the smallest doc_id that links reach, the document's own included. Rows without
    words share fingerprint 0 and so belong together. A null doc_id is never the smallest; a component
    of null ids only has a null component_id. Rows that repeat a doc_id each get a row. Other columns are
    not read; an empty table gives no rows.
    """
    prints = written(fingerprints(docs, shingle), "fingerprints")
    nodes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    reach = components(links(nodes.select("fp"), max_bits))
    named = nodes.join(reach, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("comp")
    )
    named = written(named, "named")
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    return prints.join(named.join(smallest, "comp").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the smallest of their component; rows of a null doc_id stay."""
    keep = near_duplicates(docs, shingle, max_bits).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_semi").union(docs.where("doc_id is null"))


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
