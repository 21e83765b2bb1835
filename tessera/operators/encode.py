"""ENC-1..7: target label encoding, and ordinal / one-hot / frequency
encoding routed by distinct count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import q, value_counts, value_string

# dictionaries up to this many entries become literal map expressions; larger
# ones are joined (Spark broadcasts one only if its measured size allows it)
MAP_LITERAL_LIMIT = 1_000


def route(distinct: int) -> str:
    """ENC-3: <= 2 ordinal, 3..10 one-hot, > 10 frequency."""
    if distinct <= 2:
        return "ordinal"
    if distinct <= 10:
        return "onehot"
    return "frequency"


def fit_encoders(df: DataFrame, cols: list[str], freq: DataFrame | None = None) -> dict[str, dict]:
    """Levels / shares per column from the value-frequency table. Small
    dictionaries are returned inline; frequency dictionaries above
    MAP_LITERAL_LIMIT stay a DataFrame (``table``)."""
    if not cols:
        return {}
    vc = (freq if freq is not None else value_counts(df, cols)).where(F.col("column").isin(cols))
    stats = {r["column"]: (r["d"], r["n"]) for r in
             vc.groupBy("column").agg(F.count(F.lit(1)).alias("d"), F.sum("cnt").alias("n")).collect()}
    n_rows = df.count()
    params = {}
    small = [c for c in cols if route(stats.get(c, (0, 0))[0]) != "frequency"
             or stats[c][0] <= MAP_LITERAL_LIMIT]
    levels = {}
    if small:
        for r in vc.where(F.col("column").isin(small)).collect():
            levels.setdefault(r["column"], []).append((r["value"], r["cnt"]))
    for c in cols:
        d = stats.get(c, (0, 0))[0]
        kind = route(d)
        if kind in ("ordinal", "onehot"):
            params[c] = {"kind": kind, "levels": sorted(v for v, _ in levels.get(c, []))}
        elif d <= MAP_LITERAL_LIMIT:
            params[c] = {"kind": "frequency", "shares": {v: k / n_rows for v, k in levels.get(c, [])}}
        else:
            table = vc.where(F.col("column") == c).select(
                F.col("value"), (F.col("cnt") / F.lit(n_rows)).alias("share"))
            params[c] = {"kind": "frequency", "table": table, "entries": d}
    return params


def encode(df: DataFrame, params: dict[str, dict], unknown_share: float = 0.0) -> DataFrame:
    """ENC-4..7 apply. One-hot columns replace the original at the end (as
    pandas concat does); unknown levels: ordinal -1, one-hot all zeros,
    frequency ``unknown_share``."""
    big = {c: p for c, p in params.items() if p["kind"] == "frequency" and "table" in p and c in df.columns}
    for c, p in big.items():      # a column that the rows lack is left out (PRJ-7 fills it)
        t = p["table"].select(F.col("value").alias("__k_value"), F.col("share").alias(f"__f_{c}"))
        df = df.join(t, value_string(df, c) == F.col("__k_value"), "left").drop("__k_value")
    keep, tail = [], []
    for c in df.columns:
        if c.startswith("__f_"):
            continue
        if c not in params:
            keep.append(F.col(q(c)))
            continue
        p = params[c]
        vs = value_string(df, c)
        if p["kind"] == "ordinal":
            arr = F.array(*[F.lit(v) for v in p["levels"]])
            pos = F.array_position(arr, vs)
            keep.append(F.when(pos > 0, (pos - 1).cast("double")).otherwise(F.lit(-1.0)).alias(c))
        elif p["kind"] == "onehot":
            tail += [F.coalesce((vs == F.lit(v)).cast("double"), F.lit(0.0)).alias(f"{c}_{v}")
                     for v in p["levels"]]
        elif "shares" in p:
            if p["shares"]:
                m = F.create_map(*[e for k, v in sorted(p["shares"].items()) for e in (F.lit(k), F.lit(v))])
                keep.append(F.coalesce(F.element_at(m, vs), F.lit(unknown_share)).alias(c))
            else:
                keep.append(F.lit(unknown_share).alias(c))
        else:
            keep.append(F.coalesce(F.col(q(f"__f_{c}")), F.lit(unknown_share)).alias(c))
    return df.select(*keep, *tail)


def fit_label(df: DataFrame, target: str) -> list[str]:
    """ENC-1: sorted distinct strings of the target (index = position)."""
    vs = value_string(df, target)
    return [r[0] for r in df.select(vs.alias("v")).where("v IS NOT NULL").distinct().orderBy("v").collect()]


def encode_label(df: DataFrame, target: str, classes: list[str], out: str | None = None) -> DataFrame:
    arr = F.array(*[F.lit(v) for v in classes])
    pos = F.array_position(arr, value_string(df, target))
    return df.withColumn(out or target, F.when(pos > 0, (pos - 1).cast("double")))


def decode_label(df: DataFrame, col: str, classes: list[str], out: str | None = None) -> DataFrame:
    """ENC-2: index -> original string."""
    arr = F.array(*[F.lit(v) for v in classes])
    return df.withColumn(out or col, F.element_at(arr, F.col(q(col)).cast("int") + 1))
