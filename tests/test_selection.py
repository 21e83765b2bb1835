"""Exact quantiles by bracketed selection; digests of rows and long values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.operators import analyze, clean, profile, selection
from tessera.operators.profile import quantiles, text_columns, value_counts

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]


def same(spark, values, limit, parts=5):
    df = spark.createDataFrame(pd.DataFrame({"x": values})).repartition(parts)
    got = selection.selection_quantiles(df, ["x"], PROBS, limit)["x"]
    assert got == pytest.approx(np.quantile(values, PROBS).tolist(), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("limit", [3, 50, 5000])
def test_distributions(spark, limit):
    rng = np.random.default_rng(2)
    same(spark, rng.normal(size=4000), limit)
    same(spark, np.exp(20 * rng.normal(size=3000)), limit)                                    # many magnitudes
    same(spark, np.concatenate([rng.normal(size=1500), np.full(2500, 0.25)]), limit)           # a hot value
    same(spark, rng.integers(0, 3, 3000).astype(float), limit)                                 # three hot values
    same(spark, np.array([1.0, np.nextafter(1.0, 2)] * 500 + [-0.0, 0.0, 5e-324, -5e-324]), limit)
    same(spark, np.array([7.0]), limit)


def test_two_million_values_and_a_hot_one(spark):
    n = 2_000_000
    df = spark.range(0, 2 * n, 1, 8).select(F.when(F.col("id") < n, F.col("id") * 0.5).otherwise(F.lit(1234.5)).alias("x"), F.col("id").alias("y"))
    before = selection.LIMIT
    got = quantiles(df, ["x", "y"], [0.1, 0.25, 0.5, 0.9], {"x": n, "y": 2 * n})
    ordered = np.sort(np.concatenate([np.arange(n) * 0.5, np.full(n, 1234.5)]))
    assert got["x"] == pytest.approx(np.quantile(ordered, [0.1, 0.25, 0.5, 0.9]).tolist())
    assert got["y"] == pytest.approx(np.quantile(np.arange(2 * n), [0.1, 0.25, 0.5, 0.9]).tolist())
    assert selection.LIMIT == before < n


def test_nulls_nan_and_empty(spark):
    df = spark.createDataFrame([(1.0, None), (float("nan"), None), (3.0, None), (None, None)], "a double, b double")
    assert selection.selection_quantiles(df, ["a", "b"], [0.5], 1) == {"a": [2.0], "b": [None]}
    assert selection.selection_quantiles(df.where("false"), ["a"], [0.5]) == {"a": [None]}


def test_the_column_is_not_shuffled(spark, monkeypatch):
    seen = []
    plain = selection._finish

    def watch(data, v, searches):
        seen.extend(s.inside for s in searches)
        return plain(data, v, searches)

    monkeypatch.setattr(selection, "_finish", watch)
    df = spark.range(0, 1_000_000, 1, 8).select(F.col("id").cast("double").alias("x"))
    assert selection.selection_quantiles(df, ["x"], [0.5], 20_000)["x"] == [499_999.5]
    assert seen and max(seen) <= 20_000


# ---------------------------------------------------------------- digests

def rows(spark):
    long = "word " * 40
    data = [(1, "a", long), (1, "a", long), (None, "a", long + "!"), (2, None, "short"), (2, None, "short"), (2, "x", None), (None, None, None),
            (None, None, None), (None, "2", None)]
    return spark.createDataFrame(data, "k long, s string, t string")


def test_long_values_are_named_and_counted(spark):
    df = rows(spark)
    prof = profile.column_stats(df)
    named = text_columns(df, prof)
    assert named == {"t"} and text_columns(df, prof, ["t"]) == set()
    got = {(r["column"], r["value"], r["cnt"]) for r in value_counts(df, named=named).collect()}
    assert {x for x in got if x[0] == "t"} == {("t", None, 2), ("t", None, 1), ("t", "short", 2)}
    assert {x for x in got if x[0] == "s"} == {("s", "a", 3), ("s", "x", 1), ("s", "2", 1)}
    assert profile.distinct_counts(df, freq=value_counts(df, named=named)) == profile.distinct_counts(df, freq=value_counts(df)) == {
        "k": 2, "s": 3, "t": 3}


def test_names_that_clash_are_told_apart(spark, monkeypatch):
    plain = profile.digest
    monkeypatch.setattr(profile, "digest", lambda *v: (F.lit(1).cast("long"), F.lit(2).cast("long"), plain(*v)[2]))
    df = rows(spark).where("t is not null")
    freq = value_counts(df, ["t"], {"t"})
    assert [(r["cnt"], r["kinds"]) for r in freq.where("value is null").collect()] == [(3, 2)]
    assert profile.distinct_counts(df, ["t"], freq) == {"t": 3}


def test_duplicate_rows(spark):
    df = rows(spark)
    assert clean.duplicate_count(df) == df.count() - df.distinct().count() == 3
    zeros = spark.createDataFrame([(0.0, [1.0], {"a": 1, "b": 2}), (-0.0, [1.0], {"b": 2, "a": 1}), (float("nan"), None, None), (float("nan"), None, None)],
                                  "x double, v array<double>, m map<string,int>")
    assert [tuple(r) for r in analyze.overview(zeros).collect()] == [(4, 3, 2)]
    assert [tuple(r) for r in analyze.overview(df.where("false")).collect()] == [(0, 3, 0)]


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange" in line or "HashAggregate" in line]


def test_no_exchange_carries_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    prof = profile.column_stats(docs)
    assert "text" in text_columns(docs, prof)
    for df in (value_counts(docs, named=text_columns(docs, prof)), profile.distinct_rows(docs)):
        text_ids = {f"text#{x}" for x in __import__("re").findall(r"text#(\d+)", df._jdf.queryExecution().executedPlan().toString())}
        assert text_ids and not any(t in line for line in exchanges(df) for t in text_ids)
