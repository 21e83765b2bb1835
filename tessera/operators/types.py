"""Type inference: date coercion (TYP-1..3), feature types (TYP-4/5) and
task detection (TYP-6)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import DATE_FORMATS, matching_formats, parse_with, value_shape
from .profile import (ColumnProfile, is_numeric, is_string, is_timestamp,
                      profile, q)

FEATURE_TYPES = ["numerical", "categorical", "boolean", "datetime", "text", "id",
                 "constant", "all_null"]


class TaskError(ValueError):
    pass


def date_parse_rates(df: DataFrame, cols: list[str] | None = None,
                     formats: list[str] | None = None) -> dict[str, dict]:
    """For each string column: rows parsed by the best format, over all rows and
    over non-null rows. One aggregate for every (column, format) pair whose form occurs."""
    fmts = formats or DATE_FORMATS
    cols = [c for c in (cols or df.columns) if is_string(df.schema[c].dataType)]
    if not cols:
        return {}
    # the shapes of the values, a few per column, tell which formats are worth parsing with
    items = F.array(*[F.struct(F.lit(c).alias("column"), value_shape(F.col(q(c))).alias("shape")) for c in cols])
    forms = matching_formats(df.select(F.inline(items)), fmts)
    aggs = [F.count(F.lit(1)).alias("__n")]
    for c in cols:
        aggs.append(F.count(F.col(q(c))).alias(f"nn|{c}"))
        aggs += [F.count(parse_with(F.col(q(c)), fmts[i])).alias(f"p{i}|{c}") for i in forms.get(c, [])]
    r = df.agg(*aggs).first().asDict()
    out = {}
    for c in cols:
        counts = [r.get(f"p{i}|{c}", 0) for i in range(len(fmts))]
        best = max(range(len(fmts)), key=lambda i: (counts[i], -i))
        n, nn = r["__n"], r[f"nn|{c}"]
        out[c] = {"format": fmts[best], "parsed": counts[best], "rows": n, "non_null": nn,
                  "rate_all": counts[best] / n if n else 0.0,
                  "rate_non_null": counts[best] / nn if nn else 0.0}
    return out


def rates_from_profile(prof: dict[str, ColumnProfile], formats: list[str] | None = None) -> dict[str, dict]:
    """``date_parse_rates`` from a profile computed with ``date_formats``."""
    fmts = formats or DATE_FORMATS
    out = {}
    for c, p in prof.items():
        counts = p.extra.get("parsed")
        if counts is None:
            continue
        best = max(range(len(fmts)), key=lambda i: (counts[i], -i))
        n, nn = p.n_rows, p.non_null
        out[c] = {"format": fmts[best], "parsed": counts[best], "rows": n, "non_null": nn,
                  "rate_all": counts[best] / n if n else 0.0,
                  "rate_non_null": counts[best] / nn if nn else 0.0}
    return out


def coerce_dates(df: DataFrame, threshold: float = 0.6, cols: list[str] | None = None,
                 exclude: list[str] | None = None, formats: list[str] | None = None):
    """TYP-1 (0.6), TYP-2 (0.5), TYP-3 (0.8): convert a string column whose
    parsed share of **all** rows exceeds ``threshold``; unparsed -> NULL.
    Returns ``(df, {column: format})``."""
    rates = date_parse_rates(df, cols, formats)
    chosen = {c: r["format"] for c, r in rates.items()
              if r["rate_all"] > threshold and c not in (exclude or [])}
    if not chosen:
        return df, {}
    out = df.select(*[parse_with(F.col(q(c)), chosen[c]).alias(c) if c in chosen else F.col(q(c))
                      for c in df.columns])
    return out, chosen


def classify(p: ColumnProfile, dt: T.DataType, parse_rate: float | None,
             cat_threshold: int = 20, text_length: int = 30, id_ratio: float = 0.95,
             distinct_cap: int | None = None, date_threshold: float = 0.8) -> str:
    """TYP-4 decision list for one column."""
    if p.non_null == 0:
        return "all_null"
    if (p.distinct or 0) <= 1:
        return "constant"
    uniq = p.distinct if distinct_cap is None else min(p.distinct, distinct_cap)
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if is_numeric(dt) and p.not01 == 0:
        return "boolean"
    if is_timestamp(dt):
        return "datetime"
    if is_string(dt) and parse_rate is not None and parse_rate > date_threshold:
        return "datetime"
    if is_numeric(dt):
        if uniq <= cat_threshold:
            return "categorical"
        if uniq / p.n_rows > id_ratio:
            return "id"
        return "numerical"
    if is_string(dt):
        if uniq / p.n_rows > id_ratio:
            return "id"
        if (p.avg_len or 0) > text_length:
            return "text"
        return "categorical"
    return "categorical"


def feature_types(df: DataFrame, prof: dict[str, ColumnProfile] | None = None,
                  cat_threshold: int = 20, text_length: int = 30, id_ratio: float = 0.95,
                  distinct_cap: int | None = None, date_threshold: float = 0.8,
                  rates: dict | None = None) -> dict[str, str]:
    """TYP-4: ``{column: feature_type}`` in table order.

    ``distinct_cap`` (off by default) lets distinct counts saturate, as a type
    check on a sample of that many values would."""
    prof = prof or profile(df)
    rates = rates if rates is not None else date_parse_rates(df)
    return {c: classify(prof[c], df.schema[c].dataType,
                        rates.get(c, {}).get("rate_non_null"), cat_threshold, text_length,
                        id_ratio, distinct_cap, date_threshold) for c in df.columns}


def group_types(types: dict[str, str]) -> dict[str, list[str]]:
    out = {k: [] for k in FEATURE_TYPES}
    for c, t in types.items():
        out[t].append(c)
    return out


def types_frame(spark, types: dict[str, str]) -> DataFrame:
    return spark.createDataFrame(list(types.items()), "column string, feature_type string")


def problem_type(df: DataFrame, target: str, prof: ColumnProfile | None = None) -> str:
    """TYP-6: Classification or Regression from the non-null target."""
    if target not in df.columns:
        raise TaskError(f"target column '{target}' not found")
    p = prof if prof is not None and prof.distinct is not None else profile(df, [target])[target]
    if p.non_null == 0:
        raise TaskError("target column has no values")
    if p.distinct <= 1:
        raise TaskError("target column has a single value")
    dt = df.schema[target].dataType
    if is_string(dt) or isinstance(dt, T.BooleanType):
        return "Classification"
    if is_numeric(dt):
        floating = isinstance(dt, T.DoubleType)
        if p.distinct < 20 and not floating:
            return "Classification"
        return "Regression"
    raise TaskError(f"unsupported target type {dt.simpleString()}")
