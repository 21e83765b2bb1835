import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators.profile import (adjusted_skew, column_stats, distinct_counts, quantiles,
                                       rank_quantiles, value_counts)
from tessera.sources.tables import normalize_nan


def pandas_skew(x):
    return pd.Series(x).skew()


def test_adjusted_skew_matches_pandas(spark):
    rng = np.random.default_rng(1)
    x = rng.exponential(2.0, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    p = column_stats(df)["x"]
    assert p.skew == pytest.approx(pandas_skew(x), rel=1e-9)


def test_skew_constant_and_tiny(spark):
    df = spark.createDataFrame([(2.0,)] * 5, "x double")
    assert column_stats(df)["x"].skew == 0.0
    assert adjusted_skew(2, 1.0, 0.5) is None


def test_nan_is_null(spark):
    df = normalize_nan(spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double"))
    p = column_stats(df)["x"]
    assert p.non_null == 1 and p.missing == 2


@pytest.mark.parametrize("limit", [1_000_000, 0])
def test_quantiles_exact_both_paths(spark, limit):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(10, 3, 1001), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").repartition(5)
    got = quantiles(df, ["x"], [0.25, 0.5, 0.75, 0.1], {"x": len(set(x))}, exact_map_limit=limit)["x"]
    want = np.percentile(x, [25, 50, 75, 10])
    assert got == pytest.approx(list(want), abs=1e-9)


def test_rank_quantiles_with_ties(spark):
    x = [1.0] * 10 + [2.0] * 3 + [5.0] * 7
    df = spark.createDataFrame([(v,) for v in x], "x double")
    assert rank_quantiles(df, "x", [0.25, 0.5, 0.9], partitions=3) == pytest.approx(
        list(np.percentile(x, [25, 50, 90])))


def test_value_counts_and_distinct(spark):
    df = spark.createDataFrame([(1, 1.0, "a"), (1, 2.5, "b"), (2, None, "a"), (None, 1.0, None)],
                               "i bigint, d double, s string")
    vc = {(r["column"], r["value"]): r["cnt"] for r in value_counts(df).collect()}
    assert vc[("i", "1")] == 2 and vc[("d", "1.0")] == 2 and vc[("d", "2.5")] == 1 and vc[("s", "a")] == 2
    assert distinct_counts(df) == {"i": 2, "d": 2, "s": 2}


def test_partition_invariance(spark, sf):
    from tessera.sources.tables import read_table
    li = read_table(spark, sf, "lineitem")
    a = column_stats(li.coalesce(1))
    b = column_stats(li.repartition(16))
    for c in li.columns:
        assert a[c].non_null == b[c].non_null
        if a[c].mean is not None:
            assert a[c].mean == pytest.approx(b[c].mean, rel=1e-12)
            assert a[c].skew == pytest.approx(b[c].skew, rel=1e-9, abs=1e-12)
    assert math.isclose(quantiles(li.coalesce(1), ["l_extendedprice"], [0.5])["l_extendedprice"][0],
                        quantiles(li.repartition(16), ["l_extendedprice"], [0.5])["l_extendedprice"][0])


def test_freq_quantiles_match_numpy(spark):
    from tessera.operators.profile import freq_quantiles
    rng = np.random.default_rng(9)
    a = rng.integers(0, 40, 777).astype(float)
    b = np.round(rng.normal(0, 1, 777), 3)
    df = spark.createDataFrame([(float(x), float(y)) for x, y in zip(a, b)], "a double, b double")
    got = freq_quantiles(value_counts(df), ["a", "b"], [0.25, 0.5, 0.75, 0.9], {"a": 777, "b": 777})
    assert got["a"] == pytest.approx(list(np.percentile(a, [25, 50, 75, 90])))
    assert got["b"] == pytest.approx(list(np.percentile(b, [25, 50, 75, 90])))


def test_report_keeps_measures_with_distinct_values(spark):
    from tessera.operators.analyze import report
    df = spark.createDataFrame([(i, i % 30, i * 1.5 + 0.25, "ab"[i % 2]) for i in range(200)],
                               "key long, size long, price double, target string")
    sections = report(df, "target")
    for name in ("numeric_analysis", "outlier_analysis"):
        assert [r["column"] for r in sections[name].collect()] == ["size", "price"]
    assert {r.column_a for r in sections["correlations"].collect()} == {"size", "price"}


def test_numeric_sections_of_lineitem_hold_the_price(spark, sf):
    from tessera.plans.flagship import numeric_profile
    assert "l_extendedprice" in {r["column"] for r in numeric_profile(spark, sf).collect()}


def test_complete_columns_share_their_deviation(spark):
    from tessera.operators.analyze import correlation_pairs
    df = spark.createDataFrame([(i, float(i * i % 7), 2.0, None if i == 3 else i % 4) for i in range(20)], "a int, b double, c double, d int")
    rows = lambda d: {(r[0], r[1]): None if r[2] is None else round(r[2], 12) for r in d.collect()}
    assert rows(correlation_pairs(df, df.columns, {"a", "b", "c"})) == rows(correlation_pairs(df, df.columns))
    one = column_stats(df.limit(1))["a"]
    assert one.std is None and round(column_stats(df)["a"].std, 9) == 5.916079783
