"""Logistic regression of all trials and folds together, against MLlib and numpy."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.operators import logistic as L
from tessera.operators.tune import tune


def data(spark, k, n=300, d=4, parts=5):
    rng = np.random.default_rng(k)
    x = rng.normal(size=(n, d)) * [1, 2, 0.3, 5][:d]
    y = (x @ rng.normal(size=(d, k)) + rng.gumbel(size=(n, k))).argmax(axis=1)
    df = spark.createDataFrame([(i, Vectors.dense(a), float(b), i % 3) for i, (a, b) in enumerate(zip(x, y))], ["row_id", "features", "label", "fold"])
    return x, y, df.repartition(parts).cache()


@pytest.mark.parametrize("k", [2, 3])
def test_equals_mllib_fits_of_every_fold(spark, k):
    x, y, df = data(spark, k)
    strengths = [0.05, 1.0, 50.0]
    scores, w = L.cross_validate(df, strengths, 3, k)
    for t, c in enumerate(strengths):
        accuracy = []
        for f in range(3):
            train, held = df.where(F.col("fold") != f), df.where(F.col("fold") == f)
            m = LogisticRegression(regParam=1 / (c * train.count()), standardization=False, maxIter=2000, tol=1e-12).fit(train)
            want = m.coefficientMatrix.toArray()
            assert w[t, f][:, :-1] == pytest.approx(want, rel=2e-3, abs=2e-4)
            accuracy.append(m.transform(held).where("label = prediction").count() / held.count())
        assert scores[t] == pytest.approx(np.mean(accuracy), abs=0.011)


def test_separable_classes_and_weak_penalty(spark):
    x = np.concatenate([np.full(20, -1.0), np.full(20, 1.0)])
    df = spark.createDataFrame([(Vectors.dense([v, 1.0]), float(v > 0), i % 2) for i, v in enumerate(x)], ["features", "label", "fold"])
    scores, w = L.cross_validate(df, [1e-4, 100.0], 2, 2)
    assert scores[1] == 1.0 and np.isfinite(w).all() and w[1, 0, 0, 0] > w[0, 0, 0, 0] > 0
    with pytest.raises(ValueError):
        L.cross_validate(df.where("false"), [1.0], 2, 2)


def test_tuning_takes_the_same_passes_for_all_trials(spark):
    _, _, df = data(spark, 2)
    tracker = spark.sparkContext.statusTracker()
    jobs = []
    for trials in (2, 10):
        spark.sparkContext.setJobGroup(f"logit{trials}", "")
        best, params, model, board = tune(df.drop("fold"), "Classification", "LR", n_trials=trials, folds=3)
        jobs.append(len(tracker.getJobIdsForGroup(f"logit{trials}")))
        assert board.count() == trials and best == max(r.cv_score for r in board.collect()) and model.transform(df).count() == df.count()
    spark.sparkContext.setJobGroup("other", "")
    assert jobs[1] <= jobs[0] + 12      # a few more Newton steps, not fits


def test_bound(spark):
    assert L.fits(100, 2, 50) and not L.fits(300, 2, 50) and not L.fits(60, 5, 50) and L.fits(20, 5, 50)
