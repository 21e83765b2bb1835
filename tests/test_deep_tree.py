"""Trees of many rows: distributed top, branches in tasks, against MLlib's tree."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors

from tessera.operators.deep_tree import DeepTree, DeepTreeModel, candidates
from tessera.operators.models import FitContext, build
from tessera.plans.workflow import load_model, save_model


def data(spark, n=900, k=3):
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.integers(0, 25, n), rng.integers(0, 12, n) / 4, rng.integers(0, 2, n), np.zeros(n)])
    y = np.where(rng.random(n) < 0.3, rng.integers(0, k, n), (x[:, 0] // 9) % k)
    return spark.createDataFrame([(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ["row_id", "features", "label"]).repartition(4).cache()


def found(model, df):
    return {r["row_id"]: (r["prediction"], r["probability"].toArray().round(9).tolist()) for r in model.transform(df).collect()}


@pytest.mark.parametrize("depth,rows,impurity,local", [(30, 1, "gini", 60), (30, 4, "entropy", 200), (4, 1, "gini", 25), (30, 1, "gini", 5000)])
def test_equals_mllib(spark, depth, rows, impurity, local):
    df = data(spark)
    want = DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=rows, impurity=impurity, seed=1).fit(df)
    got = DeepTree(3, depth, rows, impurity, local=local).fit(df)
    a, b = found(want, df), found(got, df)
    assert len(b) == 900 and a.keys() == b.keys()
    assert np.mean([a[i] == b[i] for i in a]) > 0.95          # splits of equal gain are told apart by rounding only
    y = {r["row_id"]: r["label"] for r in df.collect()}
    assert np.mean([a[i][0] == y[i] for i in y]) == pytest.approx(np.mean([b[i][0] == y[i] for i in y]), abs=0.01)


def test_many_rows_take_it_and_it_loads(spark, tmp_path):
    est = build("Classification", "DT", {}, FitContext(1_000_000, 4, n_classes=3))
    assert isinstance(est, DeepTree) and not isinstance(build("Classification", "DT", {}, FitContext(1000, 4)), DeepTree)
    est.local = 100
    df = data(spark)
    model = est.fit(df)
    save_model(model, f"file://{tmp_path}/m")
    again = load_model(spark, f"file://{tmp_path}/m", "Classification", "DT")
    assert isinstance(again, DeepTreeModel) and found(again, df) == found(model, df)
    assert found(DeepTree(3, subset="sqrt", local=100).fit(df), df).keys() == found(model, df).keys()


def test_thresholds_are_bounded():
    assert candidates(np.array([1.0, 1, 2, 4])).tolist() == [1.5, 3.0] and 20 < len(candidates(np.random.default_rng(0).random(5000))) <= 31
