"""Whitening against dense eigenvectors and exact sums."""

import numpy as np
import pytest

from wiretally.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n long, component string, part int"


def made(spark, vectors, ids=None):
    ids = range(len(vectors)) if ids is None else ids
    return spark.createDataFrame([(i, v, 1, "c", 2) for i, v in zip(ids, vectors)], SCHEMA)


def check(df, kept, components=8, tolerance=1e-9):
    """``kept``: the vectors that take part, in any order, with their ids."""
    x = np.array([[int(np.floor(1024 * c)) + 100000 for c in v] for _, v in kept], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    far = x * n - sums
    centred = far.astype(float) / n
    cov = centred.T @ centred / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1], q[:, ::-1]
    count = min(components, int((e > 1e-12 * max(e[0], 1e-300)).sum()))
    out = df.collect()
    assert len(out) == n * count and {r["n"] for r in out} == {n}
    got = {}
    for r in out:
        got.setdefault((r["vec_id"], r["deviation"]), {}).setdefault(r["component"], []).append(r["whitened"])
    exact = [int(d) if d < 2 ** 63 else None for d in (far ** 2).sum(axis=1)]
    assert sorted(got, key=repr) == sorted(set(zip((i for i, _ in kept), exact)), key=repr)
    shown = {r["component"]: r["explained"] for r in out}
    assert np.allclose([shown[j + 1] for j in range(count)], e[:count] / np.trace(cov), rtol=1e-6)
    assert max(r["identity_error"] for r in out) < 1e-4
    if len(got) == n:
        w = np.array([[got[i, d][j + 1][0] for j in range(count)] for (i, _), d in zip(kept, exact)])
        assert np.abs(w.T @ w / n - np.eye(count)).max() < 1e-8
        axes = centred.T @ w / n / np.sqrt(e[:count])
        assert np.abs(cov @ axes - axes * e[:count]).max() < tolerance * e[0]
        for j in range(count):
            if min(np.abs(np.delete(e, j) - e[j]), default=1) > 1e-3 * e[0]:
                mine = centred @ q[:, j] / np.sqrt(e[j])
                assert np.abs(w[:, j] * np.sign(w[:, j] @ mine) - mine).max() < 1e-8


def test_stored_vectors(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    kept = [(r["vec_id"], list(r["embedding"])) for r in df.collect()]
    check(whitening.whitened(df), kept)


def test_awkward_rows(spark):
    rng = np.random.default_rng(5)
    good = rng.normal(size=(40, 5)).tolist()
    odd = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [1e300, 0.0, 0.0, 0.0, 0.0]]
    df = made(spark, good + odd + [good[3]], list(range(38)) + [7, None] + list(range(100, 107)) + [3])
    check(whitening.whitened(df), list(zip(list(range(38)) + [7, None, 3], good + [good[3]])))


@pytest.mark.parametrize("name", ["line", "plane", "equal variances", "two dimensions", "one dimension", "few rows", "uneven", "large"])
def test_shapes(spark, name):
    rng = np.random.default_rng(11)
    vectors = {"line": rng.normal(size=(50, 1)) * 8 @ np.ones((1, 12)), "plane": np.round(rng.normal(size=(60, 2)) * 50) @ np.eye(2, 12),
               "equal variances": np.concatenate([4 * np.eye(12), -4 * np.eye(12)]), "two dimensions": rng.normal(size=(50, 2)),
               "one dimension": rng.normal(size=(50, 1)), "few rows": rng.normal(size=(4, 20)), "uneven": rng.normal(size=(80, 30)) * 2.0 ** -np.arange(30) * 8,
               "large": rng.normal(size=(9, 3)) * 1e9}[name]
    kept = list(enumerate(vectors.tolist()))
    check(whitening.whitened(made(spark, vectors.tolist())), kept)


def test_nothing_to_scale(spark):
    assert whitening.whitened(made(spark, [])).count() == 0
    assert whitening.whitened(made(spark, [[1.0, 2.0]])).count() == 0
    assert whitening.whitened(made(spark, [[1.0, 2.0]] * 5)).count() == 0
    assert whitening.whitened(made(spark, [None, []])).count() == 0


def test_lengths_that_tie(spark):
    kept = [(i, v) for i, v in enumerate([[1.0, 2.0], [2.0, 1.0], [1.0, 2.0, 3.0], [3.0, 1.0, 2.0]])]
    check(whitening.whitened(made(spark, [v for _, v in kept])), kept[2:])


def test_bidiagonal_steps(spark):
    """X V = U B with orthonormal U and V, U = X G, and B two diagonals."""
    x = np.random.default_rng(2).normal(size=(70, 9))

    class Dense:
        length = 9

        @staticmethod
        def summed(share):
            return share(x)

    values, axes, trace = whitening.bidiagonal(Dense, 9)
    assert np.allclose(values, np.linalg.svd(x)[1] ** 2, rtol=1e-12) and np.allclose(trace, (x * x).sum())
    assert np.allclose(axes.T @ axes, np.eye(9), atol=1e-12) and np.allclose(x.T @ x @ axes, axes * values, atol=1e-11)
    for count in (1, 3):
        values, axes, _ = whitening.bidiagonal(Dense, count)
        assert np.allclose(values, np.linalg.svd(x)[1][:count] ** 2, rtol=1e-12) and axes.shape == (9, count)
