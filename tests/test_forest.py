"""Forests that grow in tasks, against MLlib's."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from test_deep_tree import data, found

from tessera.operators.forest import DrawnRule, Forest, ForestModel, times_drawn
from tessera.operators.models import FitContext, build
from tessera.plans.workflow import load_model, save_model


def right(rows, df):
    y = {r["row_id"]: r["label"] for r in df.select("row_id", "label").collect()}
    return np.mean([rows[i][0] == y[i] for i in y])


@pytest.mark.parametrize("depth,rows,local", [(30, 4, 10_000), (30, 1, 60), (4, 1, 100)])
def test_one_whole_tree_is_a_tree_of_mllib(spark, depth, rows, local):
    df = data(spark)
    a = found(DecisionTreeClassifier(maxDepth=depth, minInstancesPerNode=rows, seed=1).fit(df), df)
    b = found(Forest(3, 1, depth, rows, "all", bootstrap=False, local=local).fit(df), df)
    assert len(b) == 900 and np.mean([a[i][0] == b[i][0] for i in a]) > 0.95
    assert right(a, df) == pytest.approx(right(b, df), abs=0.01)


def test_is_as_good_as_mllib_and_the_same_however_it_is_cut(spark, tmp_path):
    df = data(spark)
    train, held = df.where("row_id % 3 > 0"), df.where("row_id % 3 = 0")
    want = found(RandomForestClassifier(numTrees=40, maxDepth=30, featureSubsetStrategy="sqrt", seed=1).fit(train), held)
    model = Forest(3, 40, local=10_000).fit(train)
    got = found(model, held)
    assert got.keys() == want.keys() and right(got, held) == pytest.approx(right(want, held), abs=0.05)
    assert np.mean([np.abs(np.subtract(got[i][1], want[i][1])).max() for i in got]) < 0.12       # shares of 40 trees
    assert all(sum(p) == pytest.approx(1) for _, p in got.values())
    again = found(Forest(3, 40, local=10_000, round_bytes=50_000).fit(train), held)              # a few trees a round
    assert again == got
    tops = Forest(3, 40, local=80).fit(train)
    assert max(len(t["feature"]) for t in tops.tops) > 1 and right(found(tops, held), held) == pytest.approx(right(want, held), abs=0.05)
    save_model(tops, f"file://{tmp_path}/m")
    loaded = load_model(spark, f"file://{tmp_path}/m", "Classification", "RF")
    assert isinstance(loaded, ForestModel) and found(loaded, held) == found(tops, held)
    assert found(tops, held.where("false")) == {}


def test_draws():
    row = np.random.default_rng(0).integers(-2**62, 2**62, 50_000)
    n = times_drawn(row, 3, 42, 0.7, True)
    assert n.mean() == pytest.approx(0.7, abs=0.02) and n.var() == pytest.approx(0.7, abs=0.03) and (n != times_drawn(row, 4, 42, 0.7, True)).any()
    some = times_drawn(row, 3, 42, 0.7, False)
    assert set(some.tolist()) == {0, 1} and some.mean() == pytest.approx(0.7, abs=0.02) and (times_drawn(row, 3, 42, 1.0, False) == 1).all()
    own = DrawnRule([4] * 9, 2, 1, False, 3, 42).drawn([(1, 2, i) for i in range(9000)])
    assert all(len(set(r)) == 3 for r in own[:50].tolist()) and np.bincount(own.ravel()) / 3000 == pytest.approx(np.ones(9), abs=0.1)


def test_many_rows_take_it():
    many, few = FitContext(100_000, 4, n_classes=3), FitContext(200, 4)
    assert isinstance(build("Classification", "RF", {}, many), Forest) and isinstance(build("Classification", "BC", {"max_features": 0.6}, many), Forest)
    assert not isinstance(build("Classification", "RF", {"n_estimators": 5}, few), Forest)
    assert build("Classification", "BC", {"max_features": 0.6}, many)._subset(18) == 11
