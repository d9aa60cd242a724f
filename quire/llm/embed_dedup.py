"""Embedding near-dedup by sorted projection passes.

Each pass draws random hyperplanes; a vector's hash is the bits that tell its sides, and vectors are
sorted by it, bit after bit. Near vectors share long prefixes and so stand close together: each is compared
with the WINDOW next ones, also across the partitions of the sort. Pairs at or above the threshold, verified in double precision, are
united over all passes, of each run of windows only as many as hold it together; a vector's links are counted among its component, block against block, without
writing out the pairs.

Equal vectors are one node with a weight. The number of passes follows the number of vectors: enough that
a pair just at the threshold shares a prefix of ``prefix_bits`` at least once with the probability RECALL.
If vectors are spread evenly, those of a prefix fit into one window. A prefix that more vectors share is crowded:
there the vectors that the windows left in different components are compared whole, block against block, so that
the probability holds for any data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions, written
from .components import components

THRESHOLD = 0.9
WINDOW = 48
RECALL = 0.97
HASH_BITS = 62
#: Members that are compared as one block; larger components are cut into such blocks.
BLOCK = 256
SEED = 20_24


def usable(vector: str = "embedding") -> Column:
    """Whether a vector takes part: not null, without null or non-finite components, not zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0), F.lit(False))


def prefix_bits(n: int, window: int = WINDOW) -> int:
    """Bits of a prefix that no more than ``window`` of ``n`` vectors share if they are spread evenly."""
    return min(HASH_BITS, math.ceil(max(0.0, math.log2(max(n, 1) / window))))


def passes(n: int, threshold: float = THRESHOLD, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has shared a prefix with probability ``recall``."""
    meets = (1 - math.acos(threshold) / math.pi) ** prefix_bits(n, window)
    return 2 if meets > 0.99 else max(2, math.ceil(math.log(1 - recall) / math.log(1 - meets)))


def planes(width: int, turn: int) -> np.ndarray:
    return np.random.default_rng(SEED + turn).normal(size=(width, HASH_BITS))


def matrix(vectors: pd.Series) -> np.ndarray:
    """Unit vectors in double precision; scaled first, so that very large or small ones neither overflow nor vanish."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _hashes(batches: Iterator[pd.DataFrame], turns: int) -> Iterator[pd.DataFrame]:
    weights = 1 << np.arange(HASH_BITS, dtype=np.int64)[::-1]
    for batch in batches:
        for width, rows in batch.groupby(batch["embedding"].map(len)):
            x = matrix(rows["embedding"])
            for turn in range(turns):
                h = ((x @ planes(width, turn)) > 0) @ weights
                yield pd.DataFrame({"turn": turn, "width": width, "h": h, "node": rows["node"], "embedding": rows["embedding"]})


def _chained(x: np.ndarray, threshold: float, window: int, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of near pairs at most ``window`` apart, without those between places that closer pairs join already; the later one is ``fresh``."""
    label = np.arange(len(x))
    first, second = [], []
    for gap in range(1, min(window, len(x) - 1) + 1):
        i = np.flatnonzero((np.einsum("ij,ij->i", x[:-gap], x[gap:]) >= threshold) & fresh[gap:] & (label[:-gap] != label[gap:]))
        if len(i):
            first.append(i)
            second.append(i + gap)
            while True:  # labels to the least of each component
                least = np.minimum(label[i], label[i + gap])
                before = label.copy()
                np.minimum.at(label, before[i], least)
                np.minimum.at(label, before[i + gap], least)
                label = label[label]
                if (label == before).all():
                    break
    return (np.concatenate(first), np.concatenate(second)) if first else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _pairs(rows: pd.DataFrame, threshold: float, window: int, fresh: np.ndarray) -> Iterator[pd.DataFrame]:
    for _, own in rows.groupby(["turn", "width"], sort=False):
        i, j = _chained(matrix(own["embedding"]), threshold, window, fresh[own.index])
        if len(i):
            node = own["node"].to_numpy()
            yield pd.DataFrame({"u": node[i], "v": node[j]})


_SORTED = ["turn", "width", "node", "embedding"]
_FOUND = "u long, v long, edge int, at int, turn int, width int, node long, embedding "


def _with_nulls(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows with all columns of a pair or of a row at an edge."""
    rows = rows.reindex(columns=[c.split()[0] for c in _FOUND.split(", ")]).astype(object)
    return rows.where(rows.notna(), None)


def _windows(batches: Iterator[pd.DataFrame], threshold: float, window: int) -> Iterator[pd.DataFrame]:
    """Verified pairs (u, v) among each row's next ones in the sorted order of its pass; rows before a batch are carried over.

    The first and the last rows of a partition come too, with the edge between partitions that they lie at.
    """
    part, held, seen = TaskContext.get().partitionId(), None, 0

    def at_edge(rows: pd.DataFrame, edge: int, first: int) -> pd.DataFrame:
        return _with_nulls(rows[_SORTED].assign(edge=edge, at=np.arange(len(rows)) + first))

    for batch in batches:
        if seen < window and len(batch):
            yield at_edge(batch.head(window - seen), part, seen)
        seen += len(batch)
        rows = batch if held is None else pd.concat([held, batch], ignore_index=True)
        fresh = np.arange(len(rows)) >= (0 if held is None else len(held))  # pairs of rows carried over are known
        yield from map(_with_nulls, _pairs(rows, threshold, window, fresh))
        held = rows.tail(window).reset_index(drop=True)
    if held is not None and len(held):
        yield at_edge(held, part + 1, -len(held))


def _edge_pairs(rows: pd.DataFrame, threshold: float, window: int) -> pd.DataFrame:
    """Pairs across an edge: the last rows before it and the first behind it."""
    rows = rows.sort_values("at").reset_index(drop=True)
    found = list(_pairs(rows, threshold, window, (rows["at"] >= 0).to_numpy()))
    return pd.concat(found, ignore_index=True) if found else pd.DataFrame({"u": [], "v": []}, dtype="int64")


def near_pairs(nodes: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Pairs (u < v) of ``nodes`` (node, embedding) with cosine >= threshold that hold together what the windows bring together."""
    n = nodes.count()
    turns = passes(n, threshold, window)
    kind = nodes.schema["embedding"].dataType.simpleString()
    rows = nodes.mapInPandas(
        lambda b: _hashes(b, turns), f"turn int, width int, h long, node long, embedding {kind}"
    )
    order = ["turn", "width", "h", "node"]
    # Partitions of many windows each: a window reaches into the next one only.
    n_parts = max(1, min(shuffle_partitions(nodes.sparkSession), n * turns // (50 * window)))
    rows = rows.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    found = rows.mapInPandas(lambda b: _windows(b, threshold, window), _FOUND + kind)
    found = written(found, "windows")
    edges = found.where("edge is not null").select("edge", "at", *_SORTED)
    across = edges.groupBy("edge").applyInPandas(lambda g: _edge_pairs(g, threshold, window), "u long, v long")
    pairs = found.where("u is not null").select("u", "v").union(across)
    return pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _across(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Components that a link between the members of two blocks joins; for a block with itself, among its members."""
    a, b = group[group["side"] == 0], group[group["side"] == 1]
    b = a if b.empty else b
    if a.empty:
        return pd.DataFrame({"u": [], "v": []}, dtype="int64")
    ca, cb = a["comp"].to_numpy(), b["comp"].to_numpy()
    i, j = np.nonzero(matrix(a["embedding"]) @ matrix(b["embedding"]).T >= threshold)
    u, v = ca[i], cb[j]
    return pd.DataFrame({"u": np.minimum(u, v), "v": np.maximum(u, v)})[u != v].drop_duplicates()


def crowded_pairs(nodes: DataFrame, comps: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Pairs (u < v) of components that a link between vectors of one crowded prefix joins; a vector that ``comps`` lacks is its own.

    In each crowded prefix the members of its largest component are not compared with one another, so a group of near-equal
    vectors costs its size times the number of other vectors there.
    """
    n = nodes.count()
    turns, drop = passes(n, threshold, window), HASH_BITS - prefix_bits(n, window)
    keys = ["turn", "width", "prefix"]
    hashed = nodes.mapInPandas(
        lambda b: (rows.drop(columns="embedding") for rows in _hashes(b, turns)), "turn int, width int, h long, node long"
    )
    hashed = hashed.select("turn", "width", F.shiftright("h", drop).alias("prefix"), "node")
    labelled = hashed.join(comps, "node", "left").select(*keys, "node", F.coalesce("component", "node").alias("comp"))
    labelled = written(labelled, "prefixes")
    sizes = labelled.groupBy(*keys, "comp").agg(F.count("*").alias("n")).groupBy(*keys).agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "comp")).alias("top")
    )
    # Blocks of the others come first, then those of the largest component.
    sizes = sizes.where((F.col("n") > window + 1) & (F.col("n") > F.col("top.n"))).select(
        *keys,
        F.col("top.comp").alias("top"),
        F.ceil((F.col("n") - F.col("top.n")) / BLOCK).cast("int").alias("others"),
        F.ceil(F.col("top.n") / BLOCK).cast("int").alias("tops"),
    )
    members = labelled.join(sizes, keys)
    is_top = F.col("comp") == F.col("top")
    dealt = F.xxhash64("node")
    block = F.when(is_top, F.col("others") + F.pmod(dealt, F.col("tops"))).otherwise(F.pmod(dealt, F.col("others"))).cast("int")
    members = members.withColumn("block", block)
    last = F.when(is_top, F.col("others")).otherwise(F.col("others") + F.col("tops")) - 1
    meets = _meetings(last)
    rows = members.select(*keys, "node", "comp", F.explode(meets).alias("m")).select(*keys, "m.*", "node", "comp")
    rows = rows.join(nodes.select("node", "embedding"), "node")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        return _across(group, threshold)

    return rows.groupBy(*keys, "i", "j").applyInPandas(compare, "u long, v long").distinct()


def _meetings(last: Column) -> Column:
    """The meetings (i, j, side) of a member of ``block`` with blocks 0 to ``last``: side 0 with those that follow and its own, side 1 with those before."""
    return F.transform(
        F.sequence(F.lit(0), last),
        lambda k: F.struct(
            F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j"), (k < F.col("block")).cast("int").alias("side")
        ),
    )


def _count_links(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Weighted links between the members of two blocks of a component; for a block with itself, among its members."""
    a, b = group[group["side"] == 0], group[group["side"] == 1]
    own = b.empty
    xa, wa = matrix(a["embedding"]), a["weight"].to_numpy(np.int64)
    xb, wb = (xa, wa) if own else (matrix(b["embedding"]), b["weight"].to_numpy(np.int64))
    near = xa @ xb.T >= threshold
    if own:
        np.fill_diagonal(near, False)
        return pd.DataFrame({"node": a["node"], "n": near @ wb})
    return pd.DataFrame({"node": np.concatenate([a["node"], b["node"]]), "n": np.concatenate([near @ wb, near.T @ wa])})


def link_counts(nodes: DataFrame, comps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Rows (node, n): how many vectors other than those equal to it a node links with, within its component."""
    members = nodes.join(comps, "node")
    sizes = comps.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    members = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    meets = _meetings(F.col("blocks") - 1)
    rows = members.select("component", "node", "weight", "embedding", F.explode(meets).alias("m"))
    rows = rows.select("component", "m.*", "node", "weight", "embedding")

    def count(group: pd.DataFrame) -> pd.DataFrame:
        return _count_links(group, threshold)

    counted = rows.groupBy("component", "i", "j").applyInPandas(count, "node long, n long")
    return counted.groupBy("node").agg(F.sum("n").alias("n"))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, window: int = WINDOW) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors`` (vec_id, embedding).

    A vector that is null or zero, or has a null or non-finite component, links with nothing and is its own component.
    Vectors of different lengths never link. Rows that repeat a vec_id are vectors of their own; a null vec_id takes part, but
    is never a component's smallest; a component of null ids has a null component_id and keeps nothing. Other columns are not read;
    an empty table gives no rows.
    """
    rows = vectors.select("vec_id", F.when(usable(), F.col("embedding")).alias("embedding"))
    keyed = rows.withColumn("node", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding")))
    nodes = keyed.where("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("embedding").alias("embedding")
    )
    nodes = written(nodes, "nodes")
    pairs = written(near_pairs(nodes.select("node", "embedding"), threshold, window), "pairs")
    comps = written(components(pairs), "components")
    across = crowded_pairs(nodes.select("node", "embedding"), comps, threshold, window)
    stars = comps.select(F.col("node").alias("u"), F.col("component").alias("v"))
    comps = written(components(written(stars.union(across), "joined")), "components")
    counts = link_counts(nodes.select("node", "weight", "embedding"), comps, threshold)
    named = nodes.select("node", "least", "weight").join(comps, "node", "left").join(counts, "node", "left")
    named = written(named.select("node", "least", "weight", F.coalesce("component", "node").alias("comp"), F.coalesce("n", F.lit(0)).alias("n")), "named")
    smallest = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(smallest, "comp").select("node", "component_id", (F.col("n") + F.col("weight") - 1).alias("links"))
    out = keyed.select("vec_id", "node").join(named, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )


def op5_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
