import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import knn, metrics


def auc_pairs(y, s):
    pos = [b for a, b in zip(y, s) if a == 1]
    neg = [b for a, b in zip(y, s) if a != 1]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p in pos for n in neg)
    return tot / (len(pos) * len(neg))


def test_regression_metrics(spark):
    y = np.array([3.0, -0.5, 2.0, 7.0, 0.0])
    p = np.array([2.5, 0.0, 2.0, 8.0, 0.1])
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    m = metrics.regression_metrics(df).first()
    e = y - p
    assert m["MAE"] == pytest.approx(np.abs(e).mean())
    assert m["RMSE"] == pytest.approx(np.sqrt((e ** 2).mean()))
    assert m["R2"] == pytest.approx(1 - (e ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert m["MAPE"] == pytest.approx(np.mean(np.abs(e) / np.maximum(np.abs(y), np.finfo(float).eps)))
    assert m["EVS"] == pytest.approx(1 - e.var() / y.var())


def test_weighted_prf_with_unpredicted_class(spark):
    y = [0, 0, 1, 1, 2, 2, 2]
    p = [0, 1, 1, 1, 1, 0, 0]            # class 2 is never predicted
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(y, p)], "label double, prediction double")
    m = metrics.classification_metrics(df).first()
    classes = [0, 1, 2]
    sup = [y.count(c) for c in classes]
    tp = [sum(1 for a, b in zip(y, p) if a == b == c) for c in classes]
    pr = [tp[i] / p.count(c) if p.count(c) else 0 for i, c in enumerate(classes)]
    rc = [tp[i] / sup[i] for i in range(3)]
    f1 = [2 * a * b / (a + b) if a + b else 0 for a, b in zip(pr, rc)]
    w = lambda v: sum(a * s for a, s in zip(v, sup)) / len(y)
    assert m["Accuracy"] == pytest.approx(sum(tp) / len(y))
    assert (m["Precision"], m["Recall"], m["F1"]) == pytest.approx((w(pr), w(rc), w(f1)))


def test_auc_ties(spark):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 2, 300)
    s = np.round(rng.normal(y * 0.7, 1.0), 1)          # many tied scores
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "label int, score double").repartition(7)
    assert metrics.roc_auc(df, "label", "score") == pytest.approx(auc_pairs(list(y), list(s)))


@pytest.mark.parametrize("p,weights", [(2, "uniform"), (1, "distance")])
def test_knn_matches_brute_force_across_blocks(spark, p, weights, monkeypatch):
    rng = np.random.default_rng(11)
    tr = rng.normal(size=(120, 4))
    te = rng.normal(size=(30, 4))
    ytr = rng.integers(0, 3, 120).astype(float)
    train = spark.createDataFrame([(i, [float(v) for v in x], float(y)) for i, (x, y) in enumerate(zip(tr, ytr))],
                                  "id long, x array<double>, y double")
    test = spark.createDataFrame([(1000 + i, [float(v) for v in x]) for i, x in enumerate(te)], "id long, x array<double>")
    monkeypatch.setattr(knn, "BLOCK_ROWS", 25)          # 2 x 5 cell grid
    got = {r["test_id"]: r["prediction"] for r in
           knn.knn_regress(test, train, 5, "x", "id", "y", p=p, weights=weights).collect()}
    for i, x in enumerate(te):
        d = np.abs(tr - x).sum(1) if p == 1 else np.sqrt(((tr - x) ** 2).sum(1))
        idx = np.argsort(d, kind="stable")[:5]
        w = np.ones(5) if weights == "uniform" else 1 / d[idx]
        assert got[1000 + i] == pytest.approx((w * ytr[idx]).sum() / w.sum())
    votes = {r["test_id"]: r["prediction"] for r in knn.knn_classify(test, train, 5, "x", "id", "y", p=p).collect()}
    for i, x in enumerate(te):
        d = np.abs(tr - x).sum(1) if p == 1 else np.sqrt(((tr - x) ** 2).sum(1))
        lab = ytr[np.argsort(d, kind="stable")[:5]]
        vals, cnts = np.unique(lab, return_counts=True)
        assert votes[1000 + i] == vals[np.argmax(cnts)]        # np.unique sorts: ties -> smallest
