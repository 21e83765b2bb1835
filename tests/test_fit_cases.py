"""Cases that a fitted plan, the metrics and the CSV source must survive."""

import datetime as dt
import os
import tempfile

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tessera.functions.dates import DATE_FORMATS, parse_with
from tessera.operators import clean, metrics, models, shape
from tessera.operators.charts import target_distribution
from tessera.operators.tune import fit_context, with_folds
from tessera.operators.types import coerce_dates
from tessera.plans.feature_plan import FeaturePlan, fit_plan
from tessera.plans.workflow import load_model, save_model
from tessera.sources.csv import read_csv
from tessera.sources.tables import read_table


def folder(name):
    return tempfile.mkdtemp(prefix=f"{name}-", dir="/tmp")


# ---------------------------------------------------------------- plans

def test_float_levels_of_a_regression_target(spark, sf):
    li = read_table(spark, sf, "lineitem").limit(2000)
    plan, train, test = fit_plan(li, "l_extendedprice")
    assert plan.task == "Regression" and any("." in f for f in plan.features)
    assert train.count() + test.count() == 2000 - plan.duplicates_dropped
    assert len(train.first()["features"]) == len(plan.features) or plan.pca


def awkward(spark, n=400):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        day = dt.date(2021, 1, 1) + dt.timedelta(days=int(rng.integers(0, 300)))
        rows.append((float(rng.normal()), f"{day:%m/%d/%Y}" if i % 2 else None, f"u{rng.integers(0, 100000)}" if i % 4 else f"u{i % 7}",
                     float(rng.integers(0, 4)) / 2, "yes" if rng.random() < .5 else "no"))
    return spark.createDataFrame(rows, "`a.b` double, d string, many string, lev double, y string")


def test_half_null_dates_dotted_names_and_absent_columns(spark, monkeypatch):
    from tessera.operators import encode
    monkeypatch.setattr(encode, "MAP_LITERAL_LIMIT", 5)     # so that ``many`` becomes a joined dictionary
    df = awkward(spark)
    plan, train, test = fit_plan(df, "y")
    assert plan.coerced["d"] == "MM/dd/yyyy" and plan.types["d"] == "datetime"
    assert "many" in plan.tables or "many" in plan.encoders or "many" in plan.dropped
    full = plan.transform(df).count()
    assert full == df.count()
    for gone in ("many", "d", "a.b"):
        assert plan.transform(df.drop(gone)).count() == full
    path = folder("plan") + "/p"
    plan.save(path)
    back = FeaturePlan.load(spark, path)
    key = lambda p: sorted(tuple(round(x, 9) for x in r.v) for r in p.transform(df).select(vector_to_array("features").alias("v")).collect())
    assert key(plan) == key(back)


def test_split_and_folds_do_not_depend_on_partitions(spark):
    df = awkward(spark)
    seen = []
    for parts in (1, 3, 16):
        _, train, test = fit_plan(df.repartition(parts), "y")
        folds = with_folds(train, 5, task="Classification")
        seen.append((sorted(r.row_id for r in test.select("row_id").collect()),
                     sorted((r.row_id, r.fold) for r in folds.select("row_id", "fold").collect())))
        per = {(r["label"], r["fold"]): r["count"] for r in folds.groupBy("label", "fold").count().collect()}
        for label in (0.0, 1.0):
            sizes = [per.get((label, f), 0) for f in range(5)]
            assert max(sizes) - min(sizes) <= 1
    assert seen[0] == seen[1] == seen[2]


def test_target_distribution_of_many_text_classes(spark):
    df = spark.createDataFrame([(f"c{i % 25}",) for i in range(100)], "y string")
    assert target_distribution(df, "y")["counts"].count() == 25


# ---------------------------------------------------------------- metrics

@pytest.mark.parametrize("parts", [1, 4, 16])
def test_auc_of_many_levels(spark, parts):
    rng = np.random.default_rng(1)
    n = 100_000
    y, s = rng.integers(0, 2, n), rng.normal(size=n)
    s += 0.5 * y
    rank = np.empty(n)
    rank[np.argsort(s)] = np.arange(1, n + 1)
    want = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() + 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    import pandas as pd
    df = spark.createDataFrame(pd.DataFrame({"label": y, "s": s})).repartition(parts)
    assert metrics.roc_auc(df, "label", "s") == pytest.approx(want, abs=1e-12)


# ---------------------------------------------------------------- imputation, dates, power transform

def test_imputed_integers(spark):
    df = spark.createDataFrame([(1, 9007199254740993), (2, 9007199254740993), (None, None)], "a int, b long")
    out = clean.impute(df, clean.fit_imputer(df, ["a"], ["b"])).collect()
    assert [r.a for r in out] == [1.0, 2.0, 1.5] and out[2].b == 9007199254740993


@pytest.mark.parametrize("text,day", [
    ("1/5/2020", (2020, 1, 5)), ("25/12/2020", (2020, 12, 25)), ("20200105", (2020, 1, 5)), ("2020-1-5", (2020, 1, 5)),
    ("2020-01-05T10:00:00Z", (2020, 1, 5, 10)), ("2020-01-05 10:00:00+00:00", (2020, 1, 5, 10)),
    ("01/05/2020 10:00:00", (2020, 1, 5, 10)), (" " * 80 + "2020-01-05", (2020, 1, 5))])
def test_date_forms(spark, text, day):
    df = spark.createDataFrame([(text,)] * 3, "d string")
    out, chosen = coerce_dates(df, 0.6)
    assert chosen["d"] in DATE_FORMATS and out.first()["d"] == dt.datetime(*day)
    assert parse_with(F.lit("x"), chosen["d"]) is not None


def test_yeo_johnson_without_a_bound(spark):
    years = np.repeat(np.arange(1994, 2025), np.arange(1, 32))       # piles up at the end: a large power
    df = spark.createDataFrame([(float(v),) for v in years], "x double")
    p = shape.fit_yeo_johnson(df, ["x"])["x"]
    x = np.log1p(years.astype(float))

    def llf(lam):
        z = np.exp(lam * (x - x.max())) / lam
        return -len(x) / 2 * (np.log(z.var()) + 2 * lam * x.max()) + (lam - 1) * x.sum()

    grid = np.linspace(6, 1000, 4000)
    best = max(grid, key=llf)
    assert p["lambda"] > 5 and llf(p["lambda"]) >= llf(best) - 1e-6
    out = np.array([r.x for r in shape.yeo_johnson_transform(df, {"x": p}).collect()])
    assert np.isfinite(out).all() and abs(out.mean()) < 1e-6 and out.std() == pytest.approx(1.0)


# ---------------------------------------------------------------- CSV

def test_csv_quotes_breaks_headers_and_numbers(spark):
    p = os.path.join(folder("csv"), "q.csv")
    with open(p, "w", newline="") as f:
        f.write('k,a.b,"s,t",n\n1,"He said ""hi"", ok",1D,0x1\n2,"two\nlines",2,3\n3,plain,x,4.5\n')
    rows = read_csv(spark, p).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, 'He said "hi", ok', "1D", "0x1"), (2, "two\nlines", "2", "3"), (3, "plain", "x", "4.5")]


# ---------------------------------------------------------------- models

def toy(spark, task, n=120):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(n, 3))
    y = x @ [2.0, -1.0, 0.5] + 3 + 0.1 * rng.normal(size=n)
    y = (y > 3).astype(float) if task == "Classification" else y
    return x, y, spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))],
                                       ["row_id", "features", "label"])


@pytest.mark.parametrize("task", ["Regression", "Classification"])
def test_every_model_fits_saves_and_loads(spark, task):
    x, y, df = toy(spark, task)
    ctx = fit_context(df, task)
    small = {"n_estimators": 5, "max_depth": 4}
    for name in models.registry(task):
        model = models.build(task, name, small if name in ("RF", "BR", "BC", "GB") else {}, ctx).fit(df)
        got = {r.row_id: r.prediction for r in model.transform(df).select("row_id", "prediction").collect()}
        assert len(got) == len(y)
        fit = np.array([got[i] for i in range(len(y))])
        if task == "Classification":
            assert (fit == y).mean() > 0.8, name
        else:
            assert np.corrcoef(fit, y)[0, 1] > 0.8, name
        path = f"{folder('model')}/{name}"
        save_model(model, path)
        back = load_model(spark, path, task, name)
        again = {r.row_id: r.prediction for r in back.transform(df).select("row_id", "prediction").collect()}
        assert again == pytest.approx(got), name
        for params in models.sample_params(task, name, 3):
            models.build(task, name, params, ctx)


def test_linear_models_equal_closed_forms(spark):
    x, y, df = toy(spark, "Regression")
    ctx = fit_context(df, "Regression")
    design = np.column_stack([x, np.ones(len(y))])
    want = np.linalg.lstsq(design, y, rcond=None)[0]
    lr = models.build("Regression", "LR", {}, ctx).fit(df)
    assert [*lr.coefficients, lr.intercept] == pytest.approx(want.tolist(), abs=1e-6)
    xc, yc = x - x.mean(axis=0), y - y.mean()
    ridge = np.linalg.solve(xc.T @ xc + 5.0 * np.eye(3), xc.T @ yc)
    l2 = models.build("Regression", "L2", {"alpha": 5.0}, ctx).fit(df)
    assert list(l2.coefficients) == pytest.approx(ridge.tolist(), abs=1e-5)

    def descent(l1, l2_, rounds=3000):   # min 1/2n |y - xw|^2 + l1 |w| + l2/2 w^2
        w, n = np.zeros(3), len(yc)
        for _ in range(rounds):
            for j in range(3):
                r = yc - xc @ w + xc[:, j] * w[j]
                rho = xc[:, j] @ r / n
                w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (xc[:, j] @ xc[:, j] / n + l2_)
        return w

    lasso = models.build("Regression", "L1", {"alpha": 0.3}, ctx).fit(df)
    assert list(lasso.coefficients) == pytest.approx(descent(0.3, 0.0).tolist(), abs=2e-3)
    net = models.build("Regression", "EN", {"alpha": 0.4, "l1_ratio": 0.5}, ctx).fit(df)
    assert list(net.coefficients) == pytest.approx(descent(0.2, 0.2).tolist(), abs=2e-2)


def test_logistic_regression_and_pca(spark):
    from tessera.operators.split import fit_pca
    x, y, df = toy(spark, "Classification")
    ctx = fit_context(df, "Classification")
    lr = models.build("Classification", "LR", {"C": 1.0, "max_iter": 500}, ctx).fit(df)
    w = np.zeros(4)
    design = np.column_stack([x, np.ones(len(y))])
    for _ in range(100):     # Newton on sum log-loss + |w|^2 / 2 (intercept free)
        p = 1 / (1 + np.exp(-design @ w))
        pen = np.diag([1.0, 1.0, 1.0, 0.0])
        w -= np.linalg.solve(design.T @ (design * (p * (1 - p))[:, None]) + pen, design.T @ (p - y) + pen @ w)
    assert [*lr.coefficients, lr.intercept] == pytest.approx(w.tolist(), rel=2e-2, abs=2e-2)
    flat = df.select(*[vector_to_array("features")[i].alias(f"x.{i}") for i in range(3)])
    got = fit_pca(flat, ["x.0", "x.1", "x.2"], 2)
    val, vec = np.linalg.eigh(np.cov(x.T))
    for k in range(2):
        v = vec[:, ::-1][:, k]
        v = v * (1 if v[np.argmax(np.abs(v))] > 0 else -1)
        assert got["components"][k] == pytest.approx(v.tolist(), abs=1e-8)
    assert got["explained_variance"] == pytest.approx((val[::-1][:2] / val.sum()).tolist())
