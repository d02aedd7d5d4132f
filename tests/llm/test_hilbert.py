import itertools
from collections import defaultdict

import numpy as np
import pytest

from annospark.llm import hilbert
from annospark.llm.common import read


@pytest.mark.parametrize("n,bits", [(2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_cell_by_neighbours(n, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=n)))
    keys = hilbert.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    steps = np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1)
    assert (steps == 1).all()


def brute(rows, queries, k=20):
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in queries:
        s = x @ np.array(v, dtype=np.float64)
        s[ids == i] = -np.inf
        order = np.lexsort((ids, -np.round(s, 12)))[: min(k, len(ids) - (ids == i).sum())]
        out[i] = [(int(ids[j]), s[j]) for j in order]
    return out


@pytest.mark.parametrize("sf", ["sf0.1"])
def test_recall_on_whole_table(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in read(spark, f"/root/testdata/{sf}", "embeddings").collect()]
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    got = defaultdict(dict)
    for r in hilbert.op3_ann(spark, f"/root/testdata/{sf}").collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys()
    vectors = dict(rows)
    hits = 0
    for q, found in got.items():
        assert sorted(found) == list(range(1, len(want[q]) + 1))
        listed = [found[k] for k in sorted(found)]
        assert [(-s, i) for i, s in listed] == sorted((-s, i) for i, s in listed)
        assert all(s == pytest.approx(np.dot(np.float64(vectors[q]), np.float64(vectors[i])), abs=1e-12) for i, s in listed)
        hits += len({i for i, _ in listed} & {i for i, _ in want[q]})
    assert hits / sum(map(len, want.values())) >= 0.9


def test_rows_of_any_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 7), 0.5]) for i in range(1, 100)] + [(100 + i, [2.0, 2.0, 2.0]) for i in range(100)]
    bad = [(500, None), (520, []), (540, [0.0, 0.0, 0.0]), (560, [nan, 1.0, 1.0]), (580, [inf, 1.0, 1.0]), (600, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 1) for r in rows + bad + rows[:5]], "vec_id long, embedding array<double>, rank int")
    got = defaultdict(list)
    for r in hilbert.search(df, df.filter("vec_id % 20 = 0"), curves=3).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = brute(rows, [r for r in rows if r[0] % 20 == 0])
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
    few = df.filter("vec_id in (1, 2, 20)")
    assert hilbert.search(few, few.filter("vec_id = 20")).count() == 2
    assert hilbert.search(df.filter("false"), df.filter("false")).collect() == []


def test_windows_far_smaller_than_the_table(spark, monkeypatch):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((10, 64))
    x = centres[rng.integers(0, 10, 8000)] + 0.7 * rng.standard_normal((8000, 64))
    x *= rng.uniform(0.5, 1, 8000)[:, None] / np.linalg.norm(x, axis=1, keepdims=True)
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows, [r for r in rows if r[0] % 80 == 0])
    shares, measure = [], hilbert.recall
    monkeypatch.setattr(hilbert, "recall", lambda *a: shares.append(measure(*a)) or shares[-1])
    got = defaultdict(set)
    for r in hilbert.search(df, df.filter("vec_id % 80 = 0"), window=128, curves=6).collect():
        got[r.query_id].add(r.vec_id)
    share = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items()) / 2000
    assert share >= 0.95 <= shares[-1] and shares == sorted(shares) and len(shares) > 1 and shares[0] < 0.95
    assert share == pytest.approx(shares[-1], abs=0.001)  # the sample is all 100 queries


def test_small_beside_one_huge_and_two_vectors_of_an_id(spark):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((300, 8))
    x[7] *= 1e9
    rows = list(enumerate(x.tolist()))
    df = spark.createDataFrame([*rows, (20, [-1.0] * 8)], "vec_id long, embedding array<double>")
    got = defaultdict(list)
    for r in hilbert.search(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert len(got[20]) == 40
    want = brute([*rows, (20, [-1.0] * 8)], [r for r in rows if r[0] % 20 == 0 and r[0] != 20])
    assert all(got[q] == [i for i, _ in v] for q, v in want.items())
