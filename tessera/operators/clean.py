"""MIS-1..5 (imputation) and DUP-1/2 (duplicates)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import distinct_rows, q, value_counts


def null_counts(df: DataFrame) -> DataFrame:
    """MIS-1: ``(column, missing)`` from one aggregate, unpivoted."""
    r = df.agg(*[F.count_if(F.col(q(c)).isNull()).alias(c) for c in df.columns]).first()
    return df.sparkSession.createDataFrame([(c, r[c]) for c in df.columns], "column string, missing bigint")


def means(df: DataFrame, cols: list[str]) -> dict[str, float]:
    if not cols:
        return {}
    r = df.agg(*[F.avg(F.col(q(c)).cast("double")).alias(c) for c in cols]).first()
    return {c: r[c] for c in cols}


def mode_table(df: DataFrame, cols: list[str], freq: DataFrame | None = None) -> DataFrame:
    """``(column, value)``: most frequent non-null value; ties -> the smallest
    value (numerically for numeric columns). Computed from the frequency
    table with a top-1 window that Spark limits per map task before the
    exchange, so no column's whole value set meets in one task."""
    vc = (freq if freq is not None else value_counts(df, cols)).where(F.col("column").isin(cols))
    w = Window.partitionBy("column").orderBy(F.desc("cnt"), F.col("num").asc_nulls_last(), F.col("value").asc())
    return vc.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("column", "value", "cnt")


def modes(df: DataFrame, cols: list[str], freq: DataFrame | None = None) -> dict[str, object]:
    """MIS-3/4: fitted mode per column as its exact string; ``impute`` casts it
    to the column's type."""
    if not cols:
        return {}
    got = {r["column"]: r["value"] for r in mode_table(df, cols, freq).collect()}
    return {c: got.get(c) for c in cols}


def fit_imputer(df: DataFrame, mean_cols: list[str] = (), mode_cols: list[str] = (),
                freq: DataFrame | None = None) -> dict[str, dict]:
    return {"mean": means(df, list(mean_cols)), "mode": modes(df, list(mode_cols), freq)}


def impute(df: DataFrame, params: dict[str, dict]) -> DataFrame:
    """MIS-2..5: ``coalesce(c, fitted)`` for every fitted column, one select. A
    column filled with a mean becomes double (the mean of integers is not one)."""
    mean, mode = params.get("mean", {}), params.get("mode", {})
    out = []
    for c in df.columns:
        if mode.get(c) is not None:
            out.append(F.coalesce(F.col(q(c)), F.lit(mode[c]).cast(df.schema[c].dataType)).alias(c))
        elif mean.get(c) is not None:
            out.append(F.coalesce(F.col(q(c)).cast("double"), F.lit(float(mean[c]))).alias(c))
        else:
            out.append(F.col(q(c)))
    return df.select(*out)


def duplicate_count(df: DataFrame) -> int:
    """DUP-1: rows minus distinct rows (NULLs compare equal), by row digests."""
    r = distinct_rows(df).agg(F.sum("cnt").alias("n"), F.sum("kinds").alias("d")).first()
    return (r["n"] or 0) - (r["d"] or 0)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """DUP-2: full-row distinct (map-side partial aggregation first)."""
    return df.dropDuplicates()
