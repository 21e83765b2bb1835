"""DT-1..7: calendar features of datetime columns, fitted once, applied in
training, batch and stream scoring alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import as_utc_timestamp, cyclical, date_parts, days_since, epoch_micros, time_parts
from .profile import q


def fit_dates(df: DataFrame, cols: list[str]) -> dict[str, dict]:
    """One aggregate: per column non-null count, minimum (micros) and the
    'some hour is not 0' flag (a NULL also turns it on, as in pandas)."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        ts = as_utc_timestamp(F.col(q(c)))
        aggs += [F.count(ts).alias(f"n|{c}"), F.min(epoch_micros(ts, df.schema[c].dataType)).alias(f"min|{c}"),
                 F.bool_or((F.hour(ts) != 0) | ts.isNull()).alias(f"h|{c}")]
    r = df.agg(*aggs).first()
    return {c: {"min_micros": r[f"min|{c}"], "with_time": bool(r[f"h|{c}"]),
                "dtype": df.schema[c].dataType.simpleString()}
            for c in cols if r[f"n|{c}"]}


def date_features(df: DataFrame, params: dict[str, dict], cyclic: bool = True,
                  duration: bool = True, drop: bool = True) -> DataFrame:
    """Append the parts of every fitted column (pandas appends at the end)
    and drop the originals; a column that never parsed is left alone."""
    keep = [F.col(q(c)) for c in df.columns if not (drop and c in params)]
    new = []
    for c, p in params.items():
        ts = as_utc_timestamp(F.col(q(c)))
        new += date_parts(ts, c)
        if p["with_time"]:
            new += time_parts(ts, c)
        if duration:
            dt = df.schema[c].dataType if c in df.columns else None
            new.append(days_since(ts, p["min_micros"], c, dt))
        if cyclic:
            new += cyclical(ts, c)
    return df.select(*keep, *new)
