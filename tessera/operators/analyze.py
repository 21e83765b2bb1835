"""ANA-1..9: the profiling report as long-form DataFrames.

Everything is computed from one fused profile (moments + frequency table),
one quantile aggregate and one outlier-count aggregate; sections are small
DataFrames built from those fitted scalars.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import (EXACT_MAP_LIMIT, FLOATING, TEXT_LENGTH, ColumnProfile, column_stats, distinct_and_parsed, distinct_rows,
                      freq_quantiles, pandas_dtype, q, quantiles, text_columns, value_counts)
from ..functions.dates import DATE_FORMATS
from .types import feature_types, group_types, problem_type, rates_from_profile

QUARTILES = [0.25, 0.5, 0.75]


@dataclass
class TableFacts:
    """Everything the report sections need, computed once."""
    df: DataFrame
    prof: dict[str, ColumnProfile]
    types: dict[str, str]
    groups: dict[str, list[str]] = field(default_factory=dict)
    freq: DataFrame | None = None
    owns_freq: bool = False

    def release(self) -> None:
        if self.owns_freq and self.freq is not None:
            self.freq.unpersist()


def facts(df: DataFrame, freq: DataFrame | None = None, cache_freq: bool = True, **type_kw) -> TableFacts:
    """Moments in one pass; the value-frequency table (one shuffle) then
    gives distinct counts and date parse counts in one small aggregation,
    and - when cached - exact quantiles later without another scan."""
    owns = freq is None
    prof = column_stats(df)
    if owns:
        freq = value_counts(df, named=text_columns(df, prof, text_length=type_kw.get("text_length", TEXT_LENGTH)))
        if cache_freq:
            freq = freq.persist(StorageLevel.MEMORY_AND_DISK)
        else:
            owns = False
    distinct_and_parsed(df, prof, freq, DATE_FORMATS)
    types = feature_types(df, prof, rates=rates_from_profile(prof), **type_kw)
    return TableFacts(df, prof, types, group_types(types), freq, owns)


def overview(df: DataFrame) -> DataFrame:
    """ANA-1 / DUP-1: rows, columns, duplicate rows (all but the first), in
    one job: group the digests of the rows (map-side combined), then sum the
    groups. No row travels; a third digest tells apart rows of equal names."""
    spark = df.sparkSession
    g = distinct_rows(df)
    r = g.agg(F.sum("cnt").alias("n"), F.sum("kinds").alias("d")).first()
    n, d = r["n"] or 0, r["d"] or 0
    return spark.createDataFrame([(n, len(df.columns), n - d)],
                                 "rows bigint, columns bigint, duplicate_rows bigint")


def columns_section(f: TableFacts) -> DataFrame:
    """ANA-2 / MIS-1: dtype, missing, missing %, distinct per column."""
    rows = []
    for c, p in f.prof.items():
        rows.append((c, pandas_dtype(f.df.schema[c].dataType), p.missing,
                     (p.missing / p.n_rows * 100.0) if p.n_rows else None, p.distinct))
    return f.df.sparkSession.createDataFrame(
        rows, "column string, dtype string, missing_values bigint, missing_percent double, "
              "unique_values bigint")


def target_section(f: TableFacts, target: str) -> DataFrame:
    """ANA-3: task type, distinct, missing of the target."""
    p = f.prof[target]
    task = problem_type(f.df, target, p)
    return f.df.sparkSession.createDataFrame(
        [(task, p.distinct, p.missing)], "task_type string, unique_values bigint, missing_values bigint")


def numeric_quantiles(f: TableFacts, cols: list[str]) -> dict[str, list]:
    """Exact quartiles: from the frequency table for columns within the
    single-task bound, by the range-partitioned rank method above it."""
    small = [c for c in cols if f.freq is not None and (f.prof[c].distinct or 0) <= EXACT_MAP_LIMIT]
    out = freq_quantiles(f.freq, small, QUARTILES, {c: f.prof[c].non_null for c in small}) if small else {}
    rest = [c for c in cols if c not in out]
    if rest:
        out.update(quantiles(f.df, rest, QUARTILES, {c: f.prof[c].distinct for c in rest}))
    return out


def measures(f: TableFacts) -> list[str]:
    """Columns of the numeric sections, in table order: the numerical ones, and
    floating ones that are typed id because nearly every value is distinct."""
    return [c for c, t in f.types.items()
            if t == "numerical" or (t == "id" and isinstance(f.df.schema[c].dataType, FLOATING))]


def describe_section(f: TableFacts, cols: list[str] | None = None,
                     qs: dict[str, list] | None = None) -> DataFrame:
    """ANA-4/5: describe() of the numerical columns plus bias-corrected skewness."""
    cols = measures(f) if cols is None else cols
    qs = qs if qs is not None else numeric_quantiles(f, cols)
    rows = []
    for c in cols:
        p = f.prof[c]
        q1, q2, q3 = qs[c]
        rows.append((c, float(p.non_null), p.mean, p.std, p.min, q1, q2, q3, p.max, p.skew))
    return f.df.sparkSession.createDataFrame(
        rows, "column string, count double, mean double, std double, min double, q25 double, "
              "q50 double, q75 double, max double, skewness double")


def iqr_bounds(q1: float, q3: float, k: float = 1.5) -> tuple[float, float]:
    iqr = q3 - q1
    return q1 - k * iqr, q3 + k * iqr


def outlier_counts(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Strictly-outside counts for every column in one aggregate."""
    if not bounds:
        return {}
    r = df.agg(*[F.count_if((F.col(q(c)) < lo) | (F.col(q(c)) > hi)).alias(c)
                 for c, (lo, hi) in bounds.items()]).first()
    return {c: r[c] for c in bounds}


def outliers_section(f: TableFacts, cols: list[str] | None = None,
                     qs: dict[str, list] | None = None, truncate: bool = True) -> DataFrame:
    """ANA-6: IQR report; Q1, Q3, IQR and percent truncated toward zero like
    ``int()``; bounds from the untruncated quartiles; percent over all rows."""
    cols = measures(f) if cols is None else cols
    qs = qs if qs is not None else numeric_quantiles(f, cols)
    bounds = {c: iqr_bounds(qs[c][0], qs[c][2]) for c in cols if qs[c][0] is not None}
    counts = outlier_counts(f.df, bounds)
    rows = []
    for c in cols:
        q1, _, q3 = qs[c]
        if q1 is None:
            continue
        lo, hi = bounds[c]
        n = f.prof[c].n_rows
        cnt = counts[c]
        pct = cnt / n * 100 if n else 0.0
        t = int if truncate else float
        rows.append((c, t(q1), t(q3), t(q3 - q1), lo, hi, cnt, t(pct)))
    kind = "bigint" if truncate else "double"
    return f.df.sparkSession.createDataFrame(
        rows, f"column string, q1 {kind}, q3 {kind}, iqr {kind}, lower_bound double, "
              f"upper_bound double, outlier_count bigint, outlier_percent {kind}")


def categories_section(f: TableFacts) -> DataFrame:
    """ANA-7: category count per categorical column."""
    rows = [(c, f.prof[c].distinct) for c in f.groups["categorical"]]
    return f.df.sparkSession.createDataFrame(rows, "column string, categories_count bigint")


WIDE = 40   # columns whose pairs still fit one compiled aggregate


def correlation_pairs(df: DataFrame, cols: list[str], complete: set[str] | tuple = ()) -> DataFrame:
    """ANA-8: pairwise-complete Pearson matrix, long form (all ordered pairs).
    Columns known to be ``complete`` (no nulls) have one deviation for all their pairs.

    Up to WIDE columns, one aggregate holds d(d+1)/2 pair moments; the
    constant-column case is NULL (``try_divide``) instead of the ANSI
    divide-by-zero error. Wider tables take masked Gram blocks."""
    spark = df.sparkSession
    if len(cols) > WIDE:
        from .gram import correlations
        m = correlations(df, cols)
        rows = [(a, b, None if m[i, j] != m[i, j] else float(m[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)]
        return spark.createDataFrame(rows, "column_a string, column_b string, corr double")
    proj, aggs = [], []
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i:]]
    proj += [F.col(q(c)).cast("double").alias(f"c{i}") for i, c in enumerate(cols) if c in complete]
    for k, (a, b) in enumerate(pairs):
        if a in complete and b in complete:
            xa, yb = F.col(f"c{cols.index(a)}"), F.col(f"c{cols.index(b)}")
            top = F.stddev_samp(xa) * F.stddev_samp(yb) if a == b else F.covar_samp(xa, yb)
            aggs.append(F.try_divide(top, F.stddev_samp(xa) * F.stddev_samp(yb)).alias(f"p{k}"))
            continue
        x, y = F.col(q(a)).cast("double"), F.col(q(b)).cast("double")
        both = x.isNotNull() & y.isNotNull()
        # pairwise-complete inputs are projected once, then read by three aggregates
        proj += [F.when(both, x).alias(f"x{k}"), F.when(both, y).alias(f"y{k}")]
        xa, yb = F.col(f"x{k}"), F.col(f"y{k}")
        aggs.append(F.try_divide(F.covar_samp(xa, yb),
                                 F.stddev_samp(xa) * F.stddev_samp(yb)).alias(f"p{k}"))
    r = df.select(*proj).agg(*aggs).first() if aggs else None
    rows = []
    for k, (a, b) in enumerate(pairs):
        v = r[f"p{k}"]
        if a == b and v is not None:
            v = 1.0
        rows.append((a, b, v))
        if a != b:
            rows.append((b, a, v))
    return spark.createDataFrame(rows, "column_a string, column_b string, corr double")


def report(df: DataFrame, target: str, **type_kw) -> dict[str, DataFrame]:
    """ANA-9: sections in the reference's order; numeric and outlier sections
    are absent without numerical columns."""
    f = facts(df, cache_freq=True, **type_kw)
    try:
        out = {"dataset_overview": overview(df), "column_analysis": columns_section(f),
               "target_analysis": target_section(f, target)}
        num = measures(f)
        if num:
            qs = numeric_quantiles(f, num)
            out["numeric_analysis"] = describe_section(f, num, qs)
            out["outlier_analysis"] = outliers_section(f, num, qs)
        out["categorical_analysis"] = categories_section(f)
        out["correlations"] = correlation_pairs(df, num, {c for c in num if not f.prof[c].missing})
        # one row per column (or pair of columns): made here, while the frequency table is kept
        return {k: df.sparkSession.createDataFrame(v.collect(), v.schema) for k, v in out.items()}
    finally:
        f.release()
