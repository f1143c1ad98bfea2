"""Whitening against numpy's eigenvectors and whole-number arithmetic; the solver on clusters and defects."""

import numpy as np
import pytest

from aisle.llm import eigen, whitening


def plain(vectors):
    x = np.stack([np.floor(1024 * np.array(v, float)) + 100_000 for v in vectors]).astype(np.int64)
    n, sums = len(x), x.sum(0)
    y = x - sums / n
    values, vectors = np.linalg.eigh(y.T @ y / n)
    return n, ((n * x.astype(object) - sums) ** 2).sum(1), y @ vectors[:, ::-1] / np.sqrt(np.maximum(values[::-1], 1e-300)), values[::-1]


def sample(rows, width, seed=0):
    rng = np.random.default_rng(seed)
    return [[float(np.float32(v)) for v in row] for row in rng.normal(size=(rows, width)) * np.linspace(3, 0.2, width)]


def test_as_numpy(spark):
    vectors = sample(300, 12)
    odd = [None, [], [1.0], [None] * 12, [float("nan")] * 12, [float("inf")] + [0.0] * 11, [1e30] * 12]
    rows = [(i, v, "x", 1) for i, v in enumerate([*vectors[:150], *odd, *vectors[150:]])]
    rows += [(None, vectors[0], "x", 1), (5, vectors[5], "x", 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, whitened string, n int").repartition(5)
    found = whitening.report(df).collect()
    used = [(i, v) for i, v, *_ in rows if v and len(v) == 12 and all(x is not None and abs(x) < 1e20 for x in v)]
    n, deviation, whitened, values = plain([v for _, v in used])
    assert len(found) == 8 * n and {r.n for r in found} == {n}
    signs = {}
    by_id = {i: k for k, (i, _) in enumerate(used)}
    for r in found:
        k = by_id[r.vec_id]
        assert r.deviation == deviation[k]
        want = whitened[k, r.component - 1]
        sign = signs.setdefault(r.component, np.sign(want * r.whitened))
        assert r.whitened == pytest.approx(sign * want, abs=1e-9)
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    assert {r.identity_error for r in found} == {found[0].identity_error} and found[0].identity_error < 1e-9


def test_few_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert whitening.report(frame([(1, None), (2, [])])).count() == 0
    assert whitening.report(frame([(1, [1.0, 2.0])])).count() == 0
    assert whitening.report(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    rows = whitening.report(frame([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0, 2.0]), (4, [3.0, 2.0])])).collect()
    assert [(r.component, abs(r.whitened), r.explained) for r in rows] == [(1, 1.0, 1.0)] * 4
    assert {r.deviation for r in rows} == {(2048 * 2) ** 2}
    assert whitening.report(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_large_entries(spark):
    """Deviations beyond 64 bits are exact in the operator and null in the report."""
    vectors = [[1e9 * i, float(i % 3)] for i in range(40)]
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>")
    _, deviation, _, _ = plain(vectors)
    found = {r.vec_id: int(r.deviation) for r in whitening.whiten(df).collect()}
    assert found == dict(enumerate(deviation.tolist())) and max(deviation) >= 1 << 63
    assert {r.deviation for r in whitening.report(df).collect()} == {v if v < 1 << 63 else None for v in deviation.tolist()}


@pytest.mark.parametrize("width", [1, 3, 64, 70])
def test_exact_squares(width):
    rng = np.random.default_rng(width)
    for bits in (10, 30, 45, 51, 55):
        d = rng.integers(-(1 << bits), 1 << bits, (20, width))
        assert list(whitening.square_sums(d)) == [sum(int(v) ** 2 for v in row) for row in d]
        assert (whitening._product(d) == d.T.astype(object) @ d.astype(object)).all()


@pytest.mark.parametrize("kind", ["random", "flat", "cluster", "low", "zero", "split"])
def test_eigenpairs(kind):
    rng = np.random.default_rng(3)
    q = np.linalg.qr(rng.normal(size=(40, 40)))[0]
    values = {
        "random": rng.uniform(1, 9, 40), "flat": np.full(40, 3.0), "cluster": np.r_[[5, 5, 5, 5 + 1e-12, 4.9999999, 3, 3, 2], np.ones(32)],
        "low": np.r_[[7, 1e-3], np.zeros(38)], "zero": np.zeros(40), "split": np.arange(40.0),
    }[kind]
    matrix = np.diag(values) if kind == "split" else q @ np.diag(values) @ q.T
    matrix = (matrix + matrix.T) / 2
    found, vectors = eigen.leading(matrix, 8)
    top = max(values.max(), 1.0)
    assert np.abs(found - np.sort(values)[::-1][:8]).max() < 1e-13 * top
    assert np.abs(matrix @ vectors - vectors * found).max() < 1e-12 * top
    assert np.abs(vectors.T @ vectors - np.eye(8)).max() < 1e-12
