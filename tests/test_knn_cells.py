"""The pivot-partitioned KNN join: exact on any data, local on clustered data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn


def table(spark, x, y=None, first=0):
    rows = [(first + i, [float(v) for v in a], float(0 if y is None else y[i])) for i, a in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<double>, y double")


def brute(te, tr, k, p, first):
    out = {}
    for i, a in enumerate(te):
        d = np.abs(tr - a).sum(1) if p == 1 else np.sqrt(((tr - a) ** 2).sum(1))
        out[first + i] = np.argsort(d, kind="stable")[:k].tolist()
    return out


def neighbours(test, train, k, p=2):
    got = {}
    for r in knn.knn_candidates(test, train, k, "x", "id", "y", p).orderBy("test_id", "rank").collect():
        got.setdefault(r["test_id"], []).append(r["train_id"])
    return got


def clustered(rng, n, centres=40, d=3):
    c = rng.normal(size=(centres, d)) * 100
    return c[rng.integers(0, centres, n)] + rng.normal(size=(n, d))


@pytest.mark.parametrize("p", [1, 2])
@pytest.mark.parametrize("kind", ["clustered", "uniform", "grid", "copies"])
def test_equals_brute_force(spark, monkeypatch, p, kind):
    rng = np.random.default_rng(5)
    tr, te = {"clustered": lambda: (clustered(rng, 600), clustered(rng, 50)), "uniform": lambda: (rng.random((600, 5)), rng.random((50, 5))),
              "grid": lambda: (rng.integers(0, 4, (600, 2)).astype(float), rng.integers(0, 4, (50, 2)).astype(float)),
              "copies": lambda: (np.repeat(rng.normal(size=(6, 2)), 100, axis=0), rng.normal(size=(50, 2)))}[kind]()
    monkeypatch.setattr(knn, "CELL_ROWS", 30)
    monkeypatch.setattr(knn, "BLOCK_ROWS", 64)
    assert neighbours(table(spark, te, first=10_000), table(spark, tr), 7, p) == brute(te, tr, 7, p, 10_000)


def test_rows_visit_a_bounded_share_of_cells(spark, monkeypatch):
    rng = np.random.default_rng(6)
    monkeypatch.setattr(knn, "CELL_ROWS", 50)
    x = clustered(rng, 4000)
    train = table(spark, x[:3600]).select(F.col("id").alias("rid"), "x")
    test = table(spark, x[3600:]).select(F.col("id").alias("qid"), "x")
    cells = knn.build_cells(train, 3600, 5, 2)
    visits = knn.visit_counts(test, cells, 5).sum() / 400
    assert len(cells.pivots) == 72 and cells.count.sum() == 3600 and visits <= 0.15 * 72
    assert neighbours(table(spark, x[3600:], first=10_000), table(spark, x[:3600]), 5) == brute(x[3600:], x[:3600], 5, 2, 10_000)


def test_bounds_hold(monkeypatch):
    rng = np.random.default_rng(7)
    for p in (1, 2):
        x, z = rng.normal(size=(300, 3)) * 5, rng.normal(size=(60, 3)) * 5
        pivots = knn.choose_pivots(x[:80], 12, p)
        to = knn.distances(x, pivots, p)
        home, near = to.argmin(axis=1), to.min(axis=1)
        small = np.full((12, 4), np.inf)
        for c in range(12):
            own = np.sort(near[home == c])[:4]
            small[c, :len(own)] = own
        count = np.bincount(home, minlength=12)
        cells = knn.Cells(pivots, p, count, np.array([near[home == c].min(initial=np.inf) for c in range(12)]),
                          np.array([near[home == c].max(initial=-np.inf) for c in range(12)]), small)
        upper, lower, _ = cells.bounds(z, 4)
        d = knn.distances(z, x, p)
        assert (np.sort(d, axis=1)[:, 3] <= upper).all()
        for c in np.flatnonzero(count):
            assert (d[:, home == c].min(axis=1) >= lower[:, c]).all()


def test_few_rows_empty_sides_and_large_offsets(spark, monkeypatch):
    monkeypatch.setattr(knn, "CELL_ROWS", 2)
    rng = np.random.default_rng(8)
    tr, te = rng.normal(size=(5, 2)) + 1e7, rng.normal(size=(4, 2)) + 1e7
    assert neighbours(table(spark, te, first=100), table(spark, tr), 9) == brute(te, tr, 9, 2, 100)
    assert neighbours(table(spark, te).where("false"), table(spark, tr), 3) == {}
    assert neighbours(table(spark, te), table(spark, tr).where("false"), 3) == {}
