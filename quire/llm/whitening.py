"""Whitening of embeddings by block Lanczos, without ever forming their covariance.

Entries become integers first, so that counts, sums and deviations are exact. Each pass sends one block of orthonormal
directions Q to the tasks; a task centres its vectors by the exact means, adds up X'(XQ) and returns one small matrix. The driver keeps the
basis built so far and its images, orthogonalises the next block against all of it, twice, and takes Ritz pairs from them. Directions that vanish on the way are
replaced by random ones (breakdown); a basis that grows too large shrinks to its best Ritz vectors (restart). It ends when the residuals of the wanted
pairs are as small as rounding leaves them, or when the basis spans the whole space. What the driver holds grows with the width of a vector, never with their number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

COMPONENTS = 8
#: Entries are floor(SCALE * entry) + SHIFT.
SCALE, SHIFT = 1024, 100_000
#: Entries from this size on are an error: beyond it a double has no 1024ths.
LARGEST = 2.0**40
#: Directions of a block besides those wanted, and the largest basis as a multiple of a block.
SPARE, BLOCKS = 4, 12
#: Residuals against the largest eigenvalue; eigenvalues below the second of these are none.
TOLERANCE, NOTHING = 1e-13, 1e-12
MOST_PASSES = 500
SEED = 13


def finite(vector: str = "embedding") -> Column:
    """Whether a vector is not null and has neither null nor non-finite entries."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(v.isNotNull() & ~bad, F.lit(False))


def scaled(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, x) of the finite vectors that are as long as most are (of equally frequent lengths the smallest), x as integers, written."""
    rows = vectors.where(finite())
    most = rows.groupBy(F.size("embedding").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    rows = rows.where(F.size("embedding") == (most["n"] if most else 0))

    def whole(c: Column) -> Column:
        entry = c.cast("double")
        return F.when(F.abs(entry) < LARGEST, F.floor(entry * SCALE) + SHIFT).otherwise(F.raise_error(F.lit("an entry is too large")).cast("long"))

    return written(rows.select("vec_id", F.transform("embedding", whole).alias("x")), "whole_vectors")


def _matrix(x: pa.Array, width: int) -> np.ndarray:
    return x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)


def _sums(rows: DataFrame, width: int) -> list[int]:
    """The exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * width
        for batch in batches:
            x = _matrix(batch.column(0), width)
            some = x - SHIFT
            fits = not len(x) or float(np.abs(some).max()) * len(x) < 2**62
            total = [t + int(s) + SHIFT * len(x) for t, s in zip(total, (some if fits else some.astype(object)).sum(axis=0))]
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(width), pa.int32()), pa.array([Decimal(t) for t in total], pa.decimal128(38, 0))], ["dimension", "total"]
        )

    parts = rows.select("x").mapInArrow(add, "dimension int, total decimal(38,0)")
    found = parts.groupBy("dimension").agg(F.sum("total").alias("total")).collect()  # a row for each dimension
    return [int(t) for _, t in sorted((r["dimension"], r["total"]) for r in found)]


@dataclass
class Centre:
    """The exact mean of n vectors: in dimension j, base[j] + rest[j] / n, with rest from 0 to n - 1."""

    n: int
    base: np.ndarray
    rest: list[int]

    @classmethod
    def of(cls, n: int, sums: list[int]) -> Centre:
        return cls(n, np.array([s // n for s in sums], np.int64), [s % n for s in sums])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.base) - np.array([r / self.n for r in self.rest])

    def deviations(self, x: np.ndarray) -> list[int]:
        """Of each vector the sum over dimensions of (n * x - sum)^2, exactly."""
        away = x - self.base
        largest = (float(np.abs(away).max()) + 1) * self.n if away.size else 0
        if largest * largest * max(1, len(self.base)) < 2**62:
            d = away * self.n - np.array(self.rest, np.int64)
        else:
            d = away.astype(object) * self.n - np.array(self.rest, object)
        return [int(v) for v in (d * d).sum(axis=1)]


def _product(rows: DataFrame, centre: Centre, q: np.ndarray) -> np.ndarray:
    """The covariance times q: one pass over the vectors."""
    width, block = q.shape

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, block))
        for batch in batches:
            x = centre.centred(_matrix(batch.column(0), width))
            total += x.T @ (x @ q)
        yield pa.RecordBatch.from_arrays([pa.array(range(width * block), pa.int32()), pa.array(total.ravel())], ["cell", "total"])

    cells = rows.select("x").mapInArrow(multiply, "cell int, total double").groupBy("cell").agg(F.sum("total").alias("total"))
    out = np.zeros(width * block)
    for r in cells.collect():  # a row for each dimension and direction
        out[r["cell"]] = r["total"]
    return out.reshape(width, block) / centre.n


def _next_block(w: np.ndarray, basis: np.ndarray, wanted: int, scale: float, rng: np.random.Generator) -> np.ndarray:
    """Orthonormal directions orthogonal to the basis: those of w, and random ones in place of what vanishes."""
    for _ in range(2):
        w = w - basis @ (basis.T @ w)
    u, size, _ = np.linalg.svd(w, full_matrices=False)
    q = u[:, size > NOTHING * scale][:, :wanted]
    q = np.hstack([q, rng.standard_normal((len(basis), wanted - q.shape[1]))])
    for _ in range(3):
        q = np.linalg.qr(q - basis @ (basis.T @ q))[0]
    return q


def block_lanczos(
    apply: Callable[[np.ndarray], np.ndarray], width: int, k: int = COMPONENTS, tolerance: float = TOLERANCE, blocks: int = BLOCKS, seed: int = SEED
) -> tuple[np.ndarray, np.ndarray, int]:
    """The k largest eigenvalues, falling, of a symmetric operator that has none below 0, their unit vectors as columns, and the passes it took."""
    rng = np.random.default_rng(seed)
    k = min(k, width)
    block = min(width, k + SPARE)
    q = np.linalg.qr(rng.standard_normal((width, block)))[0]
    basis = image = np.zeros((width, 0))
    for passes in range(1, MOST_PASSES + 1):
        last = apply(q)
        basis, image = np.hstack([basis, q]), np.hstack([image, last])
        t = basis.T @ image
        values, turn = np.linalg.eigh((t + t.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz = basis @ turn[:, :k]
        residuals = np.linalg.norm(image @ turn[:, :k] - ritz * values[:k], axis=0)
        if basis.shape[1] == width or residuals.max() <= tolerance * max(values[0], 0.0):
            ritz = ritz / np.linalg.norm(ritz, axis=0)
            return values[:k], ritz * np.sign(ritz[np.abs(ritz).argmax(axis=0), np.arange(k)]), passes
        q = _next_block(last, basis, min(block, width - basis.shape[1]), values[0], rng)
        if basis.shape[1] + q.shape[1] > max(blocks, 3) * block:
            keep = k + block
            basis, image = basis @ turn[:, :keep], image @ turn[:, :keep]
    raise RuntimeError(f"the components have not converged after {MOST_PASSES} passes")


@dataclass
class Whitening:
    """Fitted on n vectors: their mean, the components as columns, and the eigenvalues."""

    centre: Centre
    values: np.ndarray
    components: np.ndarray
    passes: int


def fit(rows: DataFrame, k: int = COMPONENTS, blocks: int = BLOCKS) -> Whitening | None:
    """From the rows of ``scaled``; None if there are no vectors. Components without variance are left out, so there may be fewer than k."""
    found = rows.agg(F.count("*").alias("n"), F.first(F.size("x")).alias("width")).first()
    if not found["n"] or not found["width"]:
        return None
    centre = Centre.of(found["n"], _sums(rows, found["width"]))
    values, components, passes = block_lanczos(lambda q: _product(rows, centre, q), found["width"], k, blocks=blocks)
    some = values > NOTHING * max(values[0], 0.0)
    return Whitening(centre, values[some], components[:, some], passes)


def whitened(rows: DataFrame, model: Whitening) -> DataFrame:
    """``rows`` (with x, as of ``scaled``) and deviation, decimal(38,0) and exact, and whitened, an array with an entry for each component."""
    centre, turn = model.centre, model.components / np.sqrt(model.values)

    @F.arrow_udf("deviation decimal(38,0), whitened array<double>")
    def project(x: pa.Array) -> pa.Array:
        m = _matrix(x, len(centre.base))
        w = centre.centred(m) @ turn
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
        exact = pa.array([Decimal(v) for v in centre.deviations(m)], pa.decimal128(38, 0))
        return pa.StructArray.from_arrays([exact, lists], ["deviation", "whitened"])

    return rows.withColumn("to", project("x")).select("*", "to.deviation", "to.whitened").drop("to")


def checked(out: DataFrame, model: Whitening) -> tuple[float, float]:
    """The trace of the covariance, by the deviations, and the largest entry of the whitened vectors' covariance less the identity."""
    k, n = len(model.values), model.centre.n
    w = [F.element_at("whitened", i + 1) for i in range(k)]
    first = out.agg(F.sum(F.col("deviation").cast("double")).alias("all"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(w)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    error = 0.0
    if pairs:
        second = out.agg(*[F.avg((w[i] - first[f"m{i}"]) * (w[j] - first[f"m{j}"])).alias(f"c{i}_{j}") for i, j in pairs]).first()
        error = max(abs(second[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    return first["all"] / n / n / n, error


def whiten(vectors: DataFrame, k: int = COMPONENTS) -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for each vector that takes part and each of up to k components.

    Vectors that are null or hold null or non-finite entries take no part, nor do those of another length than most have; an entry of 2^40 or more is an error.
    Zero vectors and repeated or null ids are vectors like others. Directions without variance are no components: equal vectors, or a single one, give no rows,
    as an empty table does. deviation is exact as decimal(38,0). Other columns are not carried.
    """
    spark = vectors.sparkSession
    rows = scaled(vectors.select("vec_id", "embedding"))
    model = fit(rows, k)
    kind = rows.schema["vec_id"].dataType.simpleString()
    if model is None or not len(model.values):
        return spark.createDataFrame(
            [], f"vec_id {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        )
    out = written(whitened(rows, model).drop("x"), "whitened")
    trace, error = checked(out, model)
    shares = F.array(*[F.lit(float(v) / trace) for v in model.values])
    return out.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id",
        (F.col("at") + 1).alias("component"),
        F.lit(model.centre.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.element_at(shares, F.col("at") + 1).alias("explained"),
        F.lit(error).alias("identity_error"),
    )


def op13_whitening(spark, sf_dir: str) -> DataFrame:
    """deviation is null where it doesn't fit into a long; deviation_exact is its exact value always."""
    out = whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return out.select(
        "vec_id", "component", "n", F.expr("try_cast(deviation as long)").alias("deviation"), "whitened", "explained", "identity_error",
        F.col("deviation").alias("deviation_exact"),
    )
