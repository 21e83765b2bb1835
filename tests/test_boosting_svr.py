"""Softmax boosting and epsilon-insensitive regression against numpy."""

import tempfile

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tessera.operators import boosting as B
from tessera.operators import gradient as G
from tessera.operators import models
from tessera.operators.tune import fit_context, leaderboard
from tessera.plans.workflow import load_model, save_model


def frame(spark, x, y, parts=5):
    return spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                 ["row_id", "features", "label"]).repartition(parts)


def three_classes(n=400):
    rng = np.random.default_rng(12)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 5, n), rng.random(n)])
    y = (x[:, 0] + 0.5 * (x[:, 1] > 2) > 0.3).astype(int) + (x[:, 2] * (x[:, 1] + 1) > 2)
    return x, y.astype(int)


def numpy_boosting(x, y, k, rounds, rate, depth, min_rows):
    """Trees by exhaustive search over the same cuts, row by row."""
    cuts = B.thresholds(x)
    share = np.bincount(y, minlength=k) / len(y)
    scores = np.tile(np.log(share), (len(x), 1))

    def split(rows, g):
        best = (1e-12 * (g[rows] ** 2).sum(), None)
        for j, cut in enumerate(cuts):
            for t in cut:
                left, right = rows[x[rows, j] <= t], rows[x[rows, j] > t]
                if min(len(left), len(right)) >= min_rows:
                    gain = g[left].sum() ** 2 / len(left) + g[right].sum() ** 2 / len(right) - g[rows].sum() ** 2 / len(rows)
                    if gain > best[0] * (1 + 1e-9):
                        best = (gain, (left, right))
        return best[1]

    for _ in range(rounds):
        p = B.softmax(scores)
        for c in range(k):
            g = (y == c) - p[:, c]
            open_, leaves = [np.arange(len(x))], []
            for _ in range(depth):
                nxt = []
                for rows in open_:
                    parts = split(rows, g)
                    if parts is None:
                        leaves.append(rows)
                    else:
                        nxt += parts
                open_ = nxt
            for rows in leaves + open_:
                h = (np.abs(g[rows]) * (1 - np.abs(g[rows]))).sum()
                scores[rows, c] += rate * (k - 1) / k * g[rows].sum() / h
    return B.softmax(scores)


@pytest.mark.parametrize("rounds,depth,min_rows", [(12, 2, 1), (4, 3, 15)])
def test_equals_numpy_boosting(spark, monkeypatch, rounds, depth, min_rows):
    x, y = three_classes()
    monkeypatch.setattr(B, "RENEW", 5)
    monkeypatch.setattr(B, "SLOTS", 3)
    model = B.SoftmaxBoosting(3, rounds, 0.3, depth, min_rows).fit(frame(spark, x, y))
    assert model.probabilities(x) == pytest.approx(numpy_boosting(x, y, 3, rounds, 0.3, depth, min_rows), abs=1e-8)


def test_saves_loads_and_ranks(spark):
    x, y = three_classes()
    df = frame(spark, x, y)
    ctx = fit_context(df, "Classification")
    assert ctx.n_classes == 3
    model = models.build("Classification", "GB", {"n_estimators": 15}, ctx).fit(df)
    got = {r.row_id: (r.prediction, r.probability.toArray().tolist()) for r in model.transform(df).collect()}
    assert np.mean([got[i][0] == y[i] for i in range(len(y))]) > 0.95
    assert all(sum(p) == pytest.approx(1) for _, p in got.values())
    path = tempfile.mkdtemp(prefix="model-", dir="/tmp") + "/m"
    save_model(model, path)
    again = load_model(spark, path, "Classification", "GB").transform(df)
    assert {r.row_id: r.prediction for r in again.collect()} == {i: p for i, (p, _) in got.items()}


def test_subsampling_and_a_class_without_rows(spark):
    x, y = three_classes()
    model = B.SoftmaxBoosting(4, 5, 0.3, 2, subsample=0.6).fit(frame(spark, x, y))
    p = model.probabilities(x)
    assert np.isfinite(p).all() and (p[:, 3] < 1e-6).all() and (p.argmax(axis=1) == y).mean() > 0.8
    with pytest.raises(ValueError):
        B.SoftmaxBoosting(3, 2).fit(frame(spark, x, y).where("false"))


# ---------------------------------------------------------------- epsilon-insensitive regression

def line(n=300):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(n, 3))
    return x, x @ [1.5, -2.0, 0.0] + 4 + rng.laplace(size=n) * 0.3


def tube(x, y, w, b, c, eps):
    return 0.5 * w @ w + c * np.maximum(np.abs(y - x @ w - b) - eps, 0).sum()


@pytest.mark.parametrize("c,eps", [(1.0, 0.1), (0.01, 0.1), (10.0, 1.0)])
def test_reaches_the_minimum_of_the_tube_loss(spark, c, eps):
    x, y = line()
    model = G.TubeRegression(c, eps).fit(frame(spark, x, y))
    w, b = model.coefficients.toArray(), model.intercept
    # subgradient descent in numpy from the solution finds nothing better
    best = tube(x, y, w, b, c, eps)
    v, a, low = w.copy(), b, best
    for t in range(20_000):
        r = x @ v + a - y
        s = np.sign(r) * (np.abs(r) > eps) * c
        step = 0.05 / (1 + t) / max(1.0, c * len(y) / 10)
        v, a = v - step * (v + x.T @ s), a - step * s.sum()
        low = min(low, tube(x, y, v, a, c, eps))
    assert best <= low * (1 + 2e-3)


def test_epsilon_changes_the_fit_and_a_wide_tube_is_flat(spark):
    x, y = line()
    df = frame(spark, x, y)
    fits = [G.TubeRegression(1.0, e).fit(df) for e in (0.05, 2.0)]
    assert np.abs(fits[0].coefficients.toArray() - fits[1].coefficients.toArray()).max() > 0.02
    flat = G.TubeRegression(1.0, (y.max() - y.min()) / 2 + 1e-9).fit(df)
    assert flat.coefficients.toArray().tolist() == [0, 0, 0] and flat.intercept == pytest.approx((y.max() + y.min()) / 2)


def test_registry_uses_it(spark):
    x, y = line(150)
    df = frame(spark, x, y)
    ctx = fit_context(df, "Regression")
    for kernel in ("linear", "rbf"):
        model = models.build("Regression", "SVR", {"kernel": kernel, "C": 10.0, "epsilon": 0.05, "components": 40}, ctx).fit(df)
        got = {r.row_id: r.prediction for r in model.transform(df).select("row_id", "prediction").collect()}
        assert np.corrcoef([got[i] for i in range(len(y))], y)[0, 1] > 0.9
    board = leaderboard(df, df, "Regression", ["L2", "LR"]).collect()
    assert all(r["error"] is None for r in board)


@pytest.mark.parametrize("subsample", [1.0, 0.6])
def test_one_task_boosts_as_passes_do(spark, subsample):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(400, 3)).round(2)
    y = (x[:, 0] + 0.5 * rng.normal(size=400) > 0).astype(int) + (x[:, 1] > 0.5)
    df = frame(spark, x, y)
    jobs, models = [], []
    for local in (0, 400):
        spark.sparkContext.setJobGroup(f"boost{local}-{subsample}", "")
        models.append(B.SoftmaxBoosting(3, 12, 0.3, 3, 2, subsample, local=local).fit(df))
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"boost{local}-{subsample}")))
    spark.sparkContext.setJobGroup("other", "")
    assert models[0].probabilities(x) == pytest.approx(models[1].probabilities(x), abs=1e-9)
    assert len(models[1].rounds) == 12 and jobs[0] > 36 and jobs[1] < 12
