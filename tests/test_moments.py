"""Linear models from shared statistics against numpy and MLlib."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import moments as MM
from tessera.operators import models
from tessera.operators.tune import fit_context, leaderboard, score, tune, with_folds


def data(spark, n=600, d=4, parts=7, offset=0.0):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(n, d)) * [1, 3, 0.2, 10][:d] + offset
    y = x @ np.array([2.0, -1.0, 0.5, 0.01])[:d] + 3 + rng.normal(size=n)
    df = spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["row_id", "features", "label"])
    return x, y, df.repartition(parts)


@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_moments_are_those_of_the_rows(spark, offset):
    x, y, df = data(spark, offset=offset)
    got = MM.fold_moments(df.withColumn("fold", F.col("row_id") % 3))
    z = np.column_stack([x, y])
    for f in range(3):
        own = z[np.arange(len(z)) % 3 == f]
        assert got[f].n == len(own)
        assert got[f].mean == pytest.approx(own.mean(axis=0), rel=1e-12)
        assert got[f].scatter == pytest.approx((own - own.mean(axis=0)).T @ (own - own.mean(axis=0)), rel=1e-7, abs=1e-6)
    merged = MM.merged(got.values())
    assert merged.scatter == pytest.approx(MM.Moments.of(z).scatter, rel=1e-9, abs=1e-6)


@pytest.mark.parametrize("name,params", [("LR", {}), ("LR", {"fit_intercept": False}), ("L2", {"alpha": 3.0}), ("L1", {"alpha": 0.05}),
                                         ("EN", {"alpha": 0.05, "l1_ratio": 0.4})])
def test_fold_scores_equal_fits_of_every_fold(spark, name, params):
    _, _, df = data(spark)
    folded = with_folds(df, 3, 42)
    got = MM.fold_scores(name, params, MM.fold_moments(folded))
    for f in range(3):
        train, held = folded.where(F.col("fold") != f), folded.where(F.col("fold") == f)
        want = score(models.build("Regression", name, params, fit_context(train, "Regression")).fit(train), held, "Regression")
        assert got[f][2] == pytest.approx(want, abs=1e-6 if name in ("LR", "L2") else 2e-4)


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(200, 6)), rng.normal(size=200)
    m = MM.Moments.of(np.column_stack([x, y]))
    for l1, l2 in ((0.0, 0.1), (0.05, 0.0), (0.02, 0.3), (10.0, 0.0)):
        a, c = m.scatter[:6, :6] / 200, m.scatter[:6, 6] / 200
        for selection in ("cyclic", "random"):
            b = MM.descent(a, c, l1, l2, 5000, selection)
            g = c - a @ b - l2 * b     # subgradient conditions
            assert np.allclose(g[b != 0], l1 * np.sign(b[b != 0]), atol=1e-8) and (np.abs(g[b == 0]) <= l1 + 1e-8).all()


def test_non_negative_least_squares():
    rng = np.random.default_rng(4)
    for seed in range(20):
        x = rng.normal(size=(80, 8))
        x[:, 7] = x[:, 0] + x[:, 1]                  # collinear
        x[:, 6] = 0 if seed % 2 else x[:, 6]         # constant
        y = x @ rng.normal(size=8) + rng.normal(size=80)
        m = MM.Moments.of(np.column_stack([x, y]))
        b, intercept = MM.solve("LR", {"positive": True}, m)
        g = m.scatter[:8, 8] - m.scatter[:8, :8] @ b
        scale = np.abs(m.scatter[:8, 8]).max()
        assert (b >= 0).all() and (g <= 1e-8 * scale).all() and (np.abs(g[b > 0]) <= 1e-8 * scale).all()
        assert intercept == pytest.approx(y.mean() - x.mean(axis=0) @ b)


def test_positive_model_predicts_saves_and_loads(spark):
    import tempfile

    from tessera.plans.workflow import load_model, save_model
    x, y, df = data(spark)
    model = models.build("Regression", "LR", {"positive": True}, fit_context(df, "Regression")).fit(df)
    assert model.coefficients[1] == 0 and model.coefficients[0] == pytest.approx(2.0, abs=0.5)
    got = {r.row_id: r.prediction for r in model.transform(df).collect()}
    assert [got[i] for i in range(len(y))] == pytest.approx(x @ model.coefficients.toArray() + model.intercept)
    path = tempfile.mkdtemp(prefix="model-", dir="/tmp") + "/m"
    save_model(model, path)
    again = {r.row_id: r.prediction for r in load_model(spark, path, "Regression", "LR").transform(df).collect()}
    assert again == pytest.approx(got)


def test_collinear_constant_and_few_rows(spark):
    rows = [(i, Vectors.dense([i % 2, 1 - i % 2, 5.0]), float(3 * (i % 2) + 1)) for i in range(20)]
    df = spark.createDataFrame(rows, ["row_id", "features", "label"])
    found = MM.fold_moments(df.withColumn("fold", F.lit(0)))[0]
    for name in MM.LINEAR:
        b, c = MM.solve(name, {"alpha": 1e-9}, found)
        assert np.isfinite(b).all() and MM.r2(b, c, found) == pytest.approx(1.0, abs=1e-6)
    assert MM.fold_moments(df.where("false").withColumn("fold", F.lit(0))) == {}
    one = MM.fold_moments(df.limit(1).withColumn("fold", F.lit(0)))[0]
    assert np.isnan(MM.r2(*MM.solve("LR", {}, one), one))


def test_tuning_is_one_pass_whatever_the_trials(spark):
    _, _, df = data(spark)
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for trials in (1, 12):
        spark.sparkContext.setJobGroup(f"tune{trials}", "")
        best, params, model, board = tune(df, "Regression", "EN", n_trials=trials, folds=3)
        jobs.append(len(tracker.getJobIdsForGroup(f"tune{trials}")))
        assert board.count() == trials and best == max(r.cv_score for r in board.collect())
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[0] == jobs[1]
    board = leaderboard(df.where("row_id % 4 > 0"), df.where("row_id % 4 = 0"), "Regression", ["LR", "L1", "L2", "EN"]).collect()
    for r in board:
        model = models.build("Regression", r["model"], {}, fit_context(df.where("row_id % 4 > 0"), "Regression")).fit(df.where("row_id % 4 > 0"))
        assert r["score"] == pytest.approx(score(model, df.where("row_id % 4 = 0"), "Regression"), abs=1e-3)
