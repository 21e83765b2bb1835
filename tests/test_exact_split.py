"""SPL-1 with the exact size, by refinement of a hash histogram."""

import hashlib
import math

import pytest

from tessera.operators import split as S
from tessera.plans.feature_plan import fit_plan
from tessera.sources.tables import read_table


@pytest.mark.parametrize("n", [1, 4, 5, 6, 999, 3000])
def test_takes_the_smallest_hashes(spark, n):
    df = spark.range(n).repartition(3)
    got = {r["id"] for r in S.exact_split(df, ["id"], 0.2, 7).where("is_test").collect()}
    order = sorted(range(n), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
    assert got == set(order[:math.ceil(0.2 * n)])


def test_equal_keys_and_a_hot_key(spark):
    df = spark.createDataFrame([(i % 3, i) for i in range(100)] + [(9, i) for i in range(200)], "k long, i long").repartition(4)
    out = S.exact_split(df, ["k"], 0.2)
    assert out.where("is_test").count() == 60 and out.columns == ["k", "i", "is_test"]
    taken = {r["k"]: r["count"] for r in out.where("is_test").groupBy("k").count().collect()}
    order = sorted([0, 1, 2, 9], key=lambda k: hashlib.md5(f"42|{k}".encode()).hexdigest())
    whole = {0: 34, 1: 33, 2: 33, 9: 200}
    rest = 60
    for k in order:     # smaller hashes are taken whole before a greater one begins
        assert taken.get(k, 0) == min(rest, whole[k])
        rest -= min(rest, whole[k])


def test_edges(spark):
    df = spark.range(10)
    assert S.exact_split(df, None, 0.0).where("is_test").count() == 0
    assert S.exact_split(df, None, 1.0).where("is_test").count() == 10
    assert S.exact_split(df.where("false")).count() == 0


def test_plan_of_exact_size(spark, sf):
    orders = read_table(spark, sf, "orders")
    _, train, test = fit_plan(orders, "o_orderpriority", exact_test=True)
    n = orders.count()
    assert test.count() == math.ceil(0.2 * n) and train.count() == n - test.count()
    assert not {"__row_key"} & set(train.columns)
