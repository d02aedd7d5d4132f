import math

import numpy as np
import pytest

from annospark.llm import whitening
from annospark.llm.common import read

COLUMNS = "vec_id long, embedding array<double>"


def brute(vectors):
    """Eigenvalues, components, exact deviations and whitened values, by numpy and whole numbers."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    values, vecs = np.linalg.eigh(centred.T @ centred / n)
    return n, deviation, values[::-1], vecs[:, ::-1], centred


def check(rows, vectors, k=8):
    n, deviation, values, vecs, centred = brute(vectors)
    k = min(k, len(values))
    by = {}
    for r in rows:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(rows) == n * k and sorted(by) == list(range(n))
    for i in range(n):
        assert {r.deviation for r in by[i].values()} == {deviation[i]} and {r.n for r in by[i].values()} == {n}
    y = np.array([[by[i][j + 1].whitened for j in range(k)] for i in range(n)])
    for j in range(k):
        assert by[0][j + 1].explained == pytest.approx(values[j] / values.sum(), rel=1e-9)
        want = centred @ vecs[:, j] / np.sqrt(values[j])
        assert min(np.abs(y[:, j] - want).max(), np.abs(y[:, j] + want).max()) < 1e-7
    error = np.abs(y.T @ y / n - np.eye(k)).max()
    assert {r.identity_error for r in rows} == {rows[0].identity_error}
    assert rows[0].identity_error < 1e-9 and error < 1e-9


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_whole_table(spark, sf):
    table = sorted(read(spark, f"/root/testdata/{sf}", "embeddings").collect(), key=lambda r: r.vec_id)
    assert [r.vec_id for r in table] == list(range(len(table)))
    check(whitening.op12_whitening(spark, f"/root/testdata/{sf}").collect(), [r.embedding for r in table])


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 64, 200])
def test_eigenvalues_and_components(n):
    rng = np.random.default_rng(n)
    spread = rng.standard_normal((n, n)) * np.exp(rng.standard_normal(n) * 3)
    turn, _ = np.linalg.qr(rng.standard_normal((n, n)))
    kinds = {
        "general": spread @ spread.T, "zero": np.zeros((n, n)), "one": np.eye(n), "low": np.outer(spread[:, 0], spread[:, 0]),
        "equal": turn @ np.diag(np.r_[np.full(n // 2, 5.0), np.arange(n - n // 2)]) @ turn.T,
        "close": turn @ np.diag(1 + 1e-12 * np.arange(n)) @ turn.T, "diagonal": np.diag(np.arange(n) + 1.0),
        "near": turn @ np.diag(1 + 1.1e-3 * np.arange(n)) @ turn.T, "huge": 1e200 * spread @ spread.T, "tiny": 1e-200 * spread @ spread.T,
    }
    for name, matrix in kinds.items():
        matrix = (matrix + matrix.T) / 2
        values, vectors = whitening.eigen(matrix, 8)
        k, norm = min(8, n), np.abs(matrix).max() * n
        assert np.abs(values - np.linalg.eigvalsh(matrix)[::-1][:k]).max() <= 1e-13 * norm, name
        assert np.abs(vectors.T @ vectors - np.eye(k)).max() < 1e-13, name
        assert np.abs(matrix @ vectors - vectors * values).max() <= 1e-12 * norm, name


def test_sturm_counts():
    rng = np.random.default_rng(0)
    d, e = rng.standard_normal(30), rng.standard_normal(29)
    values = np.linalg.eigvalsh(np.diag(d) + np.diag(e, 1) + np.diag(e, -1))
    at = rng.uniform(-4, 4, 200)
    assert (whitening.below(d, e, at) == [(values < x).sum() for x in at]).all()


def test_rows_of_any_kind(spark):
    rng = np.random.default_rng(3)
    good = [rng.standard_normal(5).tolist() for _ in range(40)]
    bad = [None, [], [1.0, None, 2.0, 3.0, 4.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1.0, 2.0], [1e300] * 5]
    rows = [(i, v) for i, v in enumerate(good)] + [(100 + i, v) for i, v in enumerate(bad)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], COLUMNS + ", n int, component string")
    check(whitening.whiten(df).collect(), good)
    assert whitening.whiten(df.limit(0)).count() == 0
    assert whitening.whiten(df.filter("vec_id >= 100 and vec_id <> 105")).columns == [
        "vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_repeated_rows_null_ids_and_no_variance(spark):
    df = spark.createDataFrame([(7, [0.5, 1.0]), (7, [0.5, 1.0]), (None, [0.5, 2.0]), (None, [0.5, 2.0])], COLUMNS)
    rows = whitening.whiten(df).collect()
    assert len(rows) == 8 and [r.vec_id for r in rows].count(None) == 4
    assert {round(abs(r.whitened), 9) for r in rows if r.component == 1} == {1.0}
    assert {(r.whitened, r.explained) for r in rows if r.component == 2} == {(0.0, 0.0)}
    assert rows[0].identity_error < 1e-12
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0, 3.0]) for i in range(5)], COLUMNS)).collect()
    assert {(r.deviation, r.whitened, r.explained, r.identity_error) for r in same} == {(0, 0.0, 0.0, 0.0)}


def test_large_numbers_stay_exact(spark):
    vectors = [[1e6 + i, -1e6 * i, 3.25 * i] for i in range(3)]
    rows = whitening.whiten(spark.createDataFrame(list(enumerate(vectors)), COLUMNS)).collect()
    n, deviation, *_ = brute(vectors)
    assert {r.vec_id: r.deviation for r in rows} == {i: d if d < 2**63 else None for i, d in enumerate(deviation)}
