"""Correlation of wide tables from masked Gram blocks."""

import numpy as np
import pandas as pd
import pytest

from tessera.operators import analyze, gram


def pandas_matrix(pdf):
    return pdf.corr(min_periods=2).to_numpy()


def wide(n=200, d=50, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4)) @ rng.normal(size=(4, d)) + rng.normal(size=(n, d)) + np.arange(d) * 1e5
    x[rng.random((n, d)) < 0.2] = np.nan
    x[:, 3] = 0.1           # constant
    x[:, 4] = np.nan        # missing
    x[:, 5] = np.where(np.arange(n) == 7, 1.0, np.nan)     # one value
    return pd.DataFrame(x, columns=[f"a.{k}" if k % 7 == 0 else f"c{k}" for k in range(d)])


def frame(spark, pdf, parts=5):
    schema = ", ".join(f"`{c}` double" for c in pdf.columns)
    return spark.createDataFrame([[None if v != v else float(v) for v in r] for r in pdf.to_numpy()], schema).repartition(parts)


@pytest.mark.parametrize("block", [7, 128])
def test_equals_pandas(spark, monkeypatch, block):
    monkeypatch.setattr(gram, "BLOCK", block)
    pdf = wide()
    got = gram.correlations(frame(spark, pdf), list(pdf.columns))
    want = pandas_matrix(pdf)
    want[3, :] = want[:, 3] = np.nan
    assert np.allclose(got, want, atol=1e-9, equal_nan=True)


def test_sections_agree_on_both_paths(spark, monkeypatch):
    pdf = wide(d=12)
    df = frame(spark, pdf)
    rows = lambda: {(r.column_a, r.column_b): r["corr"] for r in analyze.correlation_pairs(df, list(pdf.columns)).collect()}
    narrow = rows()
    monkeypatch.setattr(analyze, "WIDE", 3)
    blocks = rows()
    assert narrow.keys() == blocks.keys()
    for k, v in narrow.items():
        if "c3" not in k:      # the narrow path leaves rounding of a constant column
            assert (v is None) == (blocks[k] is None) and (v is None or v == pytest.approx(blocks[k], abs=1e-9)), k
    assert analyze.correlation_pairs(df, list(pdf.columns)).count() == 144


def test_a_thousand_columns(spark):
    rng = np.random.default_rng(3)
    from pyspark.sql import functions as F
    base = spark.range(300).select(*[F.sin(F.col("id") * float(rng.random() * 9) + k).alias(f"c{k}") for k in range(1000)])
    got = gram.correlations(base, base.columns)
    assert np.allclose(got, np.corrcoef(base.toPandas().to_numpy().T), atol=1e-9)


def test_empty_table(spark):
    df = frame(spark, wide(d=45)).where("false")
    assert all(r["corr"] is None for r in analyze.correlation_pairs(df, df.columns).collect())
