"""Approximate nearest neighbours by inner product: an inverted file with product-quantised residuals.

Vectors belong to the list of their nearest coarse centroid; what is left of a vector
is quantised part by part. A query visits the lists whose centroids have the largest products with it and adds
up, for each code there, entries of its own table of products with all codewords. Small lists share a
bucket, large ones are cut into several; queries meet codes only, bucket by bucket. The best of all buckets by these sums
are ranked again by exact products in double precision, the only step that fetches vectors.

Centroids and codewords are fitted on a bounded sample; all rows are indexed. How many lists are
visited is first measured on the sample: so many that they hold the share COVERAGE of true neighbours.
Before each search PROBES of its own queries are compared with all rows; lists and candidates are as many as hold
the share REACHED of what these find, up to all of them. Equal sums, as copies have, go to smaller vec_ids.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .embed_dedup import usable

K = 20
#: Rows to fit on at most: those with the smallest hashes of vec_id.
SAMPLE = 16_000
#: Lists at most, and the rows that one has on average below that.
LISTS, LIST_ROWS = 4096, 4
PARTS = 16
CODEWORDS = 256
#: The share of true neighbours that the visited lists must hold, and sample queries to measure it with.
COVERAGE = 0.95
SAMPLE_QUERIES = 400
#: Candidates of a query that are ranked exactly, at least.
SHORTLIST = 160
#: Queries of a search that are compared with all rows, at most, and the share of their true neighbours that the lists
#: visited must hold, and of these the candidates.
PROBES, REACHED = 128, 0.98
#: Rows of a bucket (codes of some 24 bytes), and queries, that meet in one group at most, about.
BLOCK_ROWS, BLOCK_QUERIES = 65_536, 512
SEED = 11


def _nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of c for each of x, and its squared distance less that of x to 0; in runs, so that memory is bounded."""
    own, least, size = np.zeros(len(x), np.int64), np.zeros(len(x)), (c * c).sum(axis=1)
    for a in range(0, len(x), 1024):
        d = size - 2 * x[a : a + 1024] @ c.T
        own[a : a + 1024] = d.argmin(axis=1)
        least[a : a + 1024] = d.min(axis=1)
    return own, least


def _means(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """k-means centroids; an empty one takes the point farthest from its own."""
    rng = np.random.default_rng(SEED)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own, least = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0][:, None]
        if (n == 0).any():
            far = np.argsort(-least - (x * x).sum(axis=1))[: int((n == 0).sum())]
            c[n == 0] = x[far]
    return c


class Quantizer:
    """Coarse centroids and the codewords of each part of the residuals."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.width = sample.shape[1]
        self.centroids = _means(sample, lists)
        self.parts = [p for p in np.array_split(np.arange(self.width), min(PARTS, self.width)) if len(p)]
        residuals = sample - self.centroids[self.lists(sample)]
        self.words = [_means(residuals[:, p], CODEWORDS) for p in self.parts]
        self.middle = self.centroids.mean(axis=0)

    def lists(self, x: np.ndarray) -> np.ndarray:
        return _nearest(x, self.centroids)[0]

    def codes(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        r = x - self.centroids[own]
        return np.stack(
            [_nearest(r[:, p], w)[0] for p, w in zip(self.parts, self.words)], axis=1
        ).astype(np.uint8)

    def tables(self, q: np.ndarray) -> list[np.ndarray]:
        """Products of queries with the codewords: [part][query, word]."""
        return [q[:, p] @ w.T for p, w in zip(self.parts, self.words)]

    def near(self, q: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of lists and codes of rows: [query, row], the sums by which queries rank rows.

        A query's product with the middle of the centroids is left out: it ranks nothing, and would take the sums' digits.
        """
        coarse, tables = q @ (self.centroids - self.middle).T, self.tables(q)

        def sums(own: np.ndarray, codes: np.ndarray) -> np.ndarray:
            out = coarse[:, own]
            for table, code in zip(tables, codes.T):
                out += table[:, code]
            return out.astype(np.float32)

        return sums

    def visited(self, q: np.ndarray, n: int) -> np.ndarray:
        """[query, list]: whether the list is one of the n with the largest products."""
        near = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")[:, :n]
        out = np.zeros((len(q), len(self.centroids)), bool)
        np.put_along_axis(out, near, True, axis=1)
        return out

    def visits(self, sample: np.ndarray, k: int) -> int:
        """Lists to visit so that they hold the share COVERAGE of the sample's own neighbours."""
        q = sample[:: max(1, len(sample) // SAMPLE_QUERIES)]
        top = np.argsort(-(q @ sample.T), axis=1)[:, : k + 1]
        rank = np.argsort(np.argsort(-(q @ self.centroids.T), axis=1, kind="stable"), axis=1)
        need = np.sort(np.take_along_axis(rank, self.lists(sample)[top], axis=1).ravel())
        return int(need[min(len(need) - 1, math.ceil(COVERAGE * len(need)))]) + 1


def _stack(vectors: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in vectors])


class Index:
    """rows: a table (row, vec_id, list, codes, embedding) of all usable vectors, row unique; quantizer None if there are none."""

    def __init__(self, rows: DataFrame, quantizer: Quantizer | None, sizes: dict[int, int], visits: int):
        self.rows, self.quantizer, self.sizes, self.visits = rows, quantizer, sizes, visits


def take_part(vectors: DataFrame) -> DataFrame:
    """The usable rows (vec_id, embedding): finite, not zero, and as long as most are (of equally frequent lengths the smallest)."""
    rows = vectors.select("vec_id", "embedding").where(usable() & F.col("vec_id").isNotNull())
    most = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    return rows.where(F.size("embedding") == (most["n"] if most else 0))


def build(vectors: DataFrame, k: int = K, lists: int | None = None) -> Index:
    rows = take_part(vectors)
    n = rows.count()
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toPandas()
    if not n:
        return Index(rows, None, {}, 0)
    sample = _stack(drawn["embedding"])
    quantizer = Quantizer(sample, lists or max(1, min(LISTS, n // LIST_ROWS)))
    kind = rows.schema["embedding"].dataType.simpleString()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            x = _stack(batch["embedding"]) if len(batch) else np.zeros((0, quantizer.width))
            own = quantizer.lists(x)
            codes = [c.tobytes() for c in quantizer.codes(x, own)]
            yield pd.DataFrame({"vec_id": batch["vec_id"], "list": own.astype(np.int32), "codes": codes, "embedding": batch["embedding"]})

    coded = rows.mapInPandas(assign, f"vec_id long, list int, codes binary, embedding {kind}")
    coded = written(coded.withColumn("row", F.monotonically_increasing_id()), "inverted_file")
    sizes = {r["list"]: r["n"] for r in coded.groupBy("list").agg(F.count("*").alias("n")).collect()}  # at most one row a list
    visits = quantizer.visits(sample, k)
    # However the query lies, the lists visited hold k vectors besides its own.
    smallest = np.cumsum(sorted(sizes.get(i, 0) for i in range(len(quantizer.centroids))))
    visits = max(visits, int(np.searchsorted(smallest, k + 1)) + 1)
    return Index(coded, quantizer, sizes, min(visits, len(quantizer.centroids)))


def _codes(codes: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1)


def _reach(index: Index, asked: DataFrame, k: int) -> tuple[int, int]:
    """Lists to visit and candidates to rank exactly, so that they hold the share REACHED of the k nearest that PROBES of ``asked`` have among all rows."""
    spark, quantizer = asked.sparkSession, index.quantizer
    probes = asked.orderBy(F.xxhash64("query_id", F.lit(SEED)), "query_id").limit(PROBES).toPandas()
    if probes.empty:
        return index.visits, SHORTLIST
    q, names = _stack(probes["embedding"]), probes["query_id"].to_numpy()
    columns = ["probe", "vec_id", "row", "list", "near", "score"]

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = [pd.DataFrame(columns=columns)] * len(q)
        sums = quantizer.near(q)
        for batch in batches:
            if batch.empty:
                continue
            ids, rows, own = (batch[c].to_numpy() for c in ("vec_id", "row", "list"))
            # What differs by rounding only, as copies may, is equal.
            score, near = (q @ _stack(batch["embedding"]).T).astype(np.float32), sums(own, _codes(batch["codes"]))
            for i, values in enumerate(score):
                at = np.flatnonzero(ids != names[i])
                if len(at) > k:
                    at = at[values[at] >= np.partition(values[at], len(at) - k)[len(at) - k]]
                at = at[np.lexsort((rows[at], ids[at], -values[at]))[:k]]
                more = pd.DataFrame({"probe": i, "vec_id": ids[at], "row": rows[at], "list": own[at], "near": near[i, at], "score": values[at]})
                more = more if best[i].empty else pd.concat([best[i], more])
                best[i] = more.sort_values(["score", "vec_id", "row"], ascending=[False, True, True]).head(k)
        yield from (found for found in best if len(found))

    found = index.rows.mapInPandas(nearest, "probe int, vec_id long, row long, list int, near float, score float")
    order = Window.partitionBy("probe").orderBy(F.desc("score"), "vec_id", "row")
    true = found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).toPandas()  # PROBES * k rows at most
    if true.empty:
        return index.visits, SHORTLIST
    place = np.argsort(np.argsort(-(q @ quantizer.centroids.T), axis=1, kind="stable"), axis=1)
    visits = max(index.visits, _quantile(place[true["probe"], true["list"]] + 1))
    visited = quantizer.visited(q, visits)
    true = true[visited[true["probe"], true["list"]]]
    wanted = [true[true["probe"] == i] for i in range(len(q))]
    wanted = [(w["near"].to_numpy(np.float32), w["vec_id"].to_numpy(), w["row"].to_numpy()) for w in wanted]

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Of how many visited rows each true neighbour is ranked behind."""
        behind = [np.zeros(len(w[0]), np.int64) for w in wanted]
        sums = quantizer.near(q)
        for batch in batches:
            if batch.empty:
                continue
            ids, rows, own = (batch[c].to_numpy() for c in ("vec_id", "row", "list"))
            near = sums(own, _codes(batch["codes"]))
            near[~visited[:, own] | (names[:, None] == ids[None, :])] = -np.inf
            for i, (values, name, row) in enumerate(wanted):
                up = np.sort(near[i])
                more = np.searchsorted(up, values, side="right")
                behind[i] += len(up) - more
                for j in np.flatnonzero(more > np.searchsorted(up, values, side="left")):
                    same = near[i] == values[j]
                    behind[i][j] += ((ids[same] < name[j]) | ((ids[same] == name[j]) & (rows[same] < row[j]))).sum()
        for i, (_, _, row) in enumerate(wanted):
            yield pd.DataFrame({"probe": i, "row": row, "behind": behind[i]})

    passed = index.rows.select("row", "vec_id", "list", "codes").mapInPandas(ahead, "probe int, row long, behind long")
    behind = passed.groupBy("probe", "row").agg(F.sum("behind").alias("behind")).toPandas()["behind"]
    return visits, max(SHORTLIST, _quantile(behind.to_numpy() + 1) if len(behind) else 0)


def _quantile(needs: np.ndarray) -> int:
    """The least number that the share REACHED of ``needs`` doesn't exceed."""
    return int(np.sort(needs)[math.ceil(REACHED * len(needs)) - 1])


def _buckets(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each list its first bucket and how many it fills: lists that are too small for one share it with their neighbours."""
    first, blocks = np.zeros(len(sizes), np.int64), np.maximum(1, -(-sizes // BLOCK_ROWS))
    bucket, held = 0, 0
    for i, (n, b) in enumerate(zip(sizes.tolist(), blocks.tolist())):
        if held and held + n > BLOCK_ROWS:
            bucket, held = bucket + 1, 0
        first[i] = bucket
        if b > 1:
            bucket, held = bucket + b, 0
        else:
            held += n
    return first, blocks


def search(index: Index, queries: DataFrame, k: int = K) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for ``queries`` (vec_id, embedding): the k nearest found besides those of the query's own vec_id.

    score is the inner product in double precision; ties go to the smaller vec_id. Queries that can't take part get no rows.
    Of queries that share a vec_id the one of the smallest hash is asked. Indexed rows that share a vec_id are each found by themselves.
    """
    spark = queries.sparkSession
    quantizer = index.quantizer
    if quantizer is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = queries.schema["embedding"].dataType.simpleString()
    asked = queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.min_by("embedding", F.xxhash64("embedding")).alias("embedding"))
    asked = written(asked, "queries")
    visits, most = _reach(index, asked, k)
    most = max(most, k)
    q_blocks = max(1, math.ceil(asked.count() / BLOCK_QUERIES))
    first, blocks = _buckets(np.array([index.sizes.get(i, 0) for i in range(len(quantizer.centroids))]))

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for a in range(0, len(batch), 256):
                some = batch.iloc[a : a + 256]
                rows, lists = np.nonzero(quantizer.visited(_stack(some["embedding"]), visits))
                each = blocks[lists]
                rows = np.repeat(rows, each)
                own = np.repeat(first[lists] - (np.cumsum(each) - each), each) + np.arange(each.sum())
                met = np.unique(np.stack([rows, own], axis=1), axis=0)  # a query once for each bucket
                out = some.iloc[met[:, 0]]
                yield pd.DataFrame({"query_id": out["query_id"], "embedding": out["embedding"], "bucket": met[:, 1]})

    sent = asked.mapInPandas(visit, f"query_id long, embedding {kind}, bucket long")
    sent = sent.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int"))
    places = spark.createDataFrame(pd.DataFrame({"list": np.arange(len(first), dtype=np.int32), "first": first, "blocks": blocks}))
    rows = index.rows.select("row", "vec_id", "list", "codes").join(F.broadcast(places), "list")  # LISTS rows at most
    rows = rows.withColumn("bucket", F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks"))).drop("first", "blocks")
    rows = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))

    def rank(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        return _best_of_bucket(quantizer, rows, asked, most, visits)

    key = ["bucket", "part"]
    found = rows.groupBy(*key).cogroup(sent.groupBy(*key)).applyInPandas(rank, "query_id long, row long, vec_id long, near float")
    best = Window.partitionBy("query_id").orderBy(F.desc("near"), "vec_id", "row")
    short = found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= most).select("query_id", "row")
    pairs = short.join(index.rows.select("row", "vec_id", "embedding"), "row").join(asked.withColumnRenamed("embedding", "q"), "query_id")
    scored = pairs.select("query_id", "vec_id", F.pandas_udf(_products, "double")("q", "embedding").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _products(batches: Iterator[tuple]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series(np.einsum("ij,ij->i", _stack(a), _stack(b)) if len(a) else np.zeros(0))


_products.__annotations__ = {"batches": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}


def _best_of_bucket(quantizer: Quantizer, rows: pd.DataFrame, asked: pd.DataFrame, most: int, visits: int) -> pd.DataFrame:
    """The ``most`` rows of a bucket's visited lists with the largest sums, for each query; of equal sums those of smaller vec_id."""
    none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "row": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "near": np.zeros(0, np.float32)})
    if rows.empty or asked.empty:
        return none
    rows = rows.sort_values(["vec_id", "row"])
    ids, names, own = rows["row"].to_numpy(), rows["vec_id"].to_numpy(), rows["list"].to_numpy()
    codes = _codes(rows["codes"])
    out = [none]
    for a in range(0, len(asked), 64):
        some = asked.iloc[a : a + 64]
        q, queries = _stack(some["embedding"]), some["query_id"].to_numpy()
        near = quantizer.near(q)(own, codes)
        near[~quantizer.visited(q, visits)[:, own] | (queries[:, None] == names[None, :])] = -np.inf
        for query, values in zip(queries, near):
            at = np.flatnonzero(values > -np.inf)
            if len(at) > most:
                least = np.partition(values[at], len(at) - most)[len(at) - most]
                above, equal = at[values[at] > least], at[values[at] == least]
                at = np.concatenate([above, equal[: most - len(above)]])
            out.append(pd.DataFrame({"query_id": query, "row": ids[at], "vec_id": names[at], "near": values[at]}))
    return pd.concat(out, ignore_index=True)


def op2_ann(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    index = build(vectors)
    return search(index, index.rows.where("vec_id % 20 = 0").select("vec_id", "embedding"))
