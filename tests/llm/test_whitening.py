"""Whitening against a dense eigendecomposition over all rows."""

import numpy as np
import pytest

from barloom.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n bigint, at int"


def dense(vectors, k=16):
    """n, exact deviation of each vector, whitened columns and shares of the trace."""
    x = [[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors]
    fit = sorted(set(map(tuple, x)))
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    off = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in x])
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    cov = centred.T @ centred / n
    values, turn = np.linalg.eigh(cov)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return n, [sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x], off @ turn / np.sqrt(values), values / np.trace(cov)


def table(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    rows = [(i, None if v is None else [None if c is None else float(c) for c in v], 1, "x", 2, 3) for i, v in zip(ids, vectors, strict=True)]
    return spark.createDataFrame(rows, SCHEMA)


def spread(rng, n, dim):
    return rng.standard_normal((n, dim)) * np.linspace(3, 0.5, dim) + rng.standard_normal(dim) * 5


def check(got, vectors, ids, k):
    n, deviation, white, share = dense(vectors, k)
    by = {(r["vec_id"], r["component"]): r for r in got}
    assert len(by) == len(got) == len(vectors) * k
    sign = np.sign([by[ids[0], c + 1]["whitened"] * white[0, c] for c in range(k)])
    for row, i in enumerate(ids):
        for c in range(k):
            r = by[i, c + 1]
            assert r["n"] == n and r["deviation"] == deviation[row]
            assert r["whitened"] * sign[c] == pytest.approx(white[row, c], abs=1e-9)
            assert r["explained"] == pytest.approx(share[c], rel=1e-9)
            assert r["identity_error"] < 1e-9


def test_whitened(spark):
    vectors = list(spread(np.random.default_rng(1), 400, 40))
    vectors += vectors[:150] + [vectors[0]] * 200
    ids = list(range(len(vectors)))
    rows = table(spark, [*vectors, None, [], [1.0] * 39 + [None], [float("nan")] * 40, [float("inf")] + [0.0] * 39, [1.0, 2.0]], [*ids, 9001, 9002, 9003, 9004, 9005, 9006])
    check(whitening.whitened(rows).collect(), vectors, ids, 16)


def test_fewer_dimensions_than_components(spark):
    vectors = list(spread(np.random.default_rng(2), 60, 5))
    check(whitening.whitened(table(spark, vectors)).collect(), vectors, list(range(60)), 5)


def test_directions_without_variance(spark):
    flat = np.zeros((80, 20))
    flat[:, :3] = spread(np.random.default_rng(3), 80, 3)
    check(whitening.whitened(table(spark, list(flat))).collect(), list(flat), list(range(80)), 3)


def test_nothing_to_whiten(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, [None, []])).collect() == []
    assert whitening.whitened(table(spark, [[1.0, 2.0]] * 5)).collect() == []


def test_repeated_and_null_ids(spark):
    vectors = list(spread(np.random.default_rng(4), 30, 4))
    got = whitening.whitened(table(spark, vectors, [None, None, *[7] * 28]), components=2).collect()
    assert sorted((r["vec_id"] is None, r["component"]) for r in got) == sorted([(i < 2, c) for i in range(30) for c in (1, 2)])


@pytest.mark.parametrize(
    "spectrum", [np.r_[1e6, 1 + np.arange(63)[::-1] * 0.01], np.logspace(8, 0, 64), np.r_[np.linspace(5, 4, 10), np.zeros(54)], np.linspace(2, 1, 200)], ids=["outlier", "steep", "flat rest", "close"]
)
def test_subspace(spectrum):
    rng, dim = np.random.default_rng(5), len(spectrum)
    turn = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    cov = (turn * spectrum) @ turn.T
    pairs, values, residual = whitening.subspace(lambda block: cov @ block, dim, 16)
    k = min(16, int((spectrum > 0).sum()))
    assert residual < 1e-11 and len(values) == k
    assert np.allclose(values, spectrum[:k], rtol=1e-8, atol=1e-11 * spectrum[0])
    assert np.allclose(np.abs((pairs * turn[:, :k]).sum(axis=0)), 1, atol=1e-6)
    assert np.allclose(pairs.T @ pairs, np.eye(k), atol=1e-12)


def test_deviation_beyond_a_long(spark):
    rows = table(spark, [[0.0, 0.0], [3e7, 1.0], [1.0, 3e7], [2.0, 5.0]])
    got = {r["vec_id"]: r["deviation"] for r in whitening.whitened(rows).collect()}
    assert got[0] is not None and len(got) == 4
    wide = table(spark, [[0.0, 0.0], [3e8, 1.0], [1.0, -3e8], [2.0, 5.0]])
    assert None in {r["deviation"] for r in whitening.whitened(wide).collect()}
