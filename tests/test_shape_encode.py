import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import encode, shape


def yj(x, lam):
    x = np.asarray(x, float)
    out = np.empty_like(x)
    pos = x >= 0
    out[pos] = np.log1p(x[pos]) if abs(lam) < 1e-12 else ((x[pos] + 1) ** lam - 1) / lam
    out[~pos] = -np.log1p(-x[~pos]) if abs(lam - 2) < 1e-12 else -((1 - x[~pos]) ** (2 - lam) - 1) / (2 - lam)
    return out


def llf(x, lam):
    return -len(x) / 2 * math.log(yj(x, lam).var()) + (lam - 1) * np.sum(np.sign(x) * np.log1p(np.abs(x)))


def test_yeo_johnson_lambda_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.lognormal(0, 0.8, 400), -rng.exponential(0.3, 50)])
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    p = shape.fit_yeo_johnson(df, ["x"])["x"]
    grid = np.linspace(-3, 3, 60001)
    best = grid[np.argmax([llf(x, g) for g in grid])]
    assert p["lambda"] == pytest.approx(best, abs=2e-4)
    out = np.array([r[0] for r in shape.yeo_johnson_transform(df, {"x": p}).collect()])
    assert out.mean() == pytest.approx(0, abs=1e-9) and out.std() == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize("lam", [0.0, 2.0, 0.5, -1.0])
def test_yeo_johnson_branches(spark, lam):
    x = [-2.0, -0.5, 0.0, 0.5, 3.0]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    got = [r[0] for r in df.select(shape.yeo_johnson(F.col("x"), lam)).collect()]
    assert got == pytest.approx(list(yj(x, lam)))


@pytest.mark.parametrize("n,method", [(9, None), (10, "IQR Capping"), (499, "IQR Capping"), (500, "Z-score Capping")])
def test_outlier_method_branches(spark, n, method):
    x = [float(i % 17) for i in range(n)]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    p = shape.fit_outliers(df, ["x"])
    assert (p.get("x") or {}).get("method") == method


def test_clip_keeps_nulls(spark):
    df = spark.createDataFrame([(1.0,), (None,), (100.0,)] + [(2.0,)] * 20, "x double")
    p = shape.fit_outliers(df, ["x"], method="iqr")
    out = [r[0] for r in shape.cap_outliers(df, p).collect()]
    assert out[1] is None and out[2] == 2.0 and p["x"]["outliers_capped"] == 2


@pytest.mark.parametrize("k,kind", [(2, "ordinal"), (3, "onehot"), (10, "onehot"), (11, "frequency")])
def test_encoder_routes(spark, k, kind):
    df = spark.createDataFrame([(f"v{i % k}",) for i in range(50)], "c string")
    assert encode.fit_encoders(df, ["c"])["c"]["kind"] == kind


def test_unknown_levels(spark):
    tr = spark.createDataFrame([("a", "x", "p"), ("b", "y", "q"), ("a", "z", "r")] + [("a", "x", f"f{i}") for i in range(10)],
                               "o string, h string, f string")
    p = encode.fit_encoders(tr, ["o", "h", "f"])
    sc = spark.createDataFrame([("c", "w", "unseen")], "o string, h string, f string")
    r = encode.encode(sc, p).first().asDict()
    assert r["o"] == -1.0 and r["h_x"] == 0.0 and r["h_y"] == 0.0 and r["h_z"] == 0.0 and r["f"] == 0.0
    t = encode.encode(tr, p).first().asDict()
    assert t["o"] == 0.0 and t["h_x"] == 1.0 and t["f"] == pytest.approx(1 / 13)


def test_float_levels_named_like_pandas(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (0.5,)], "c double")
    p = encode.fit_encoders(df, ["c"])
    assert encode.encode(df, p).columns == ["c_0.5", "c_1.0", "c_2.0"]


def test_big_frequency_dictionary_joins(spark):
    df = spark.range(3000).select((F.col("id") % 1500).cast("string").alias("c"))
    p = encode.fit_encoders(df, ["c"])
    assert "table" in p["c"]
    out = encode.encode(df, p).agg(F.min("c"), F.max("c")).first()
    assert out[0] == pytest.approx(2 / 3000) and out[1] == pytest.approx(2 / 3000)
