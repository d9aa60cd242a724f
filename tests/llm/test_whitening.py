"""Whitening against eigenvectors of the whole covariance, and Lanczos on matrices that are hard for it."""

from fractions import Fraction

import numpy as np
import pytest

from quire.llm import whitening as w

KIND = "vec_id long, embedding array<float>, component int, x string"


def table(spark, vectors):
    return spark.createDataFrame([(i, v, 7, "theirs") for i, v in vectors], KIND)


def random_vectors(n, width, seed=1):
    rng = np.random.default_rng(seed)
    turn = rng.standard_normal((width, width)) * (0.8 ** np.arange(width))[:, None]
    return (rng.standard_normal((n, width)) @ turn).astype(np.float32)


def expected(vectors, k):
    """Exact integers, sums and deviations; eigenvectors by numpy."""
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviations = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[float(Fraction(n * c - s, n)) for c, s in zip(v, sums)] for v in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return deviations, centred @ turn / np.sqrt(values), values / np.trace(centred.T @ centred / n)


@pytest.mark.parametrize("n,width,k", [(400, 20, 8), (60, 5, 8), (30, 70, 8), (200, 16, 3)])
def test_components_are_the_eigenvectors(spark, n, width, k):
    vectors = random_vectors(n, width)
    rows = w.whiten(table(spark, [(i, v.tolist()) for i, v in enumerate(vectors)]), k).collect()
    deviations, white, shares = expected(vectors, k)
    k = white.shape[1]
    assert len(rows) == n * k and {r.n for r in rows} == {n}
    got = np.zeros((n, k))
    for r in rows:
        got[r.vec_id, r.component - 1] = r.whitened
        assert int(r.deviation) == deviations[r.vec_id] and abs(r.explained / shares[r.component - 1] - 1) < 1e-9 and r.identity_error < 1e-8
    sign = np.sign((got * white).sum(axis=0))
    assert np.abs(got - sign * white).max() < 1e-7


def test_what_takes_no_part(spark):
    vectors = random_vectors(50, 6)
    nan, inf = float("nan"), float("inf")
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(100, None), (101, [nan] * 6), (102, [1.0, inf, 0.0, 0.0, 0.0, 0.0]), (103, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    rows += [(200, [0.0] * 6), (None, [1.0] * 6), (7, [2.0] * 6), (7, [2.0] * 6)]
    found = w.whiten(table(spark, rows)).collect()
    taking = [v for i, v in rows if i is None or i < 100 or i == 200]
    assert {r.n for r in found} == {54} and len(found) == 54 * 6
    deviations, _, _ = expected(np.array(taking, np.float32), 6)
    assert sorted(int(r.deviation) for r in found if r.component == 1) == sorted(deviations)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, [])]):
        assert w.whiten(table(spark, rows)).collect() == []
    flat = w.whiten(table(spark, [(i, [float(i), 2.0 * i, 3.0]) for i in range(9)])).collect()
    assert {r.component for r in flat} == {1} and abs(flat[0].explained - 1) < 1e-12


def test_entries_that_are_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        w.whiten(table(spark, [(1, [1e30, 0.0]), (2, [0.0, 1.0])])).collect()


def test_deviations_beyond_a_long(spark, tmp_path):
    vectors = [[(-1.0) ** i * 2.0**30, float(i)] for i in range(10)]
    table(spark, list(enumerate(vectors))).write.parquet(f"{tmp_path}/embeddings.parquet")
    out = w.op13_whitening(spark, str(tmp_path))
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"]
    assert [t for _, t in out.dtypes] == ["bigint", "int", "bigint", "bigint", "double", "double", "double", "decimal(38,0)"]
    deviations, _, _ = expected(np.array(vectors, np.float32), 2)
    for r in out.collect():
        assert int(r.deviation_exact) == deviations[r.vec_id] and r.deviation is None


def test_lanczos_restarts_and_breakdowns():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    for values in (
        0.97 ** np.arange(300),  # restarts
        np.r_[np.full(9, 5.0), np.full(291, 1.0)],  # few different values: the second block vanishes
        np.r_[3.0, 2.0, np.zeros(298)],
        np.full(300, 2.0),
        np.zeros(300),
        1 + np.arange(300)[::-1] / 3000,  # no gap to speak of
    ):
        a = (turn * values) @ turn.T
        got, vectors, passes = w.block_lanczos(lambda q: a @ q, 300, blocks=6)
        assert np.abs(got - np.sort(values)[::-1][:8]).max() < 1e-10
        assert np.abs(a @ vectors - vectors * got).max() < 1e-10 and np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-10
        assert passes < 150


def test_exact_centre():
    n, sums = 3, [300_001, -7]
    centre = w.Centre.of(n, sums)
    x = np.array([[100_000, -2], [2**45, 5]], np.int64)
    assert centre.deviations(x) == [sum((n * int(c) - s) ** 2 for c, s in zip(v, sums)) for v in x.tolist()]
