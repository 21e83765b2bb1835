"""PRJ-1..7: rule-based column pruning and re-alignment."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .profile import ColumnProfile, is_integral, q

# Name fragments that mark a column as a person's name or an id.
NAME_WORDS = ["name", "first", "last", "full"]
ID_WORDS = ["id", "uuid", "uid", "identifier"]


def name_rule(col: str) -> str | None:
    """PRJ-1..3: metadata-only rules (no data is read)."""
    low = col.lower()
    if any(w in low for w in NAME_WORDS):
        return "name"
    if any(w in low for w in ID_WORDS):
        return "id"
    if low.startswith("unnamed"):
        return "unnamed"
    return None


def prune_rules(df: DataFrame, target: str | None = None,
                prof: dict[str, ColumnProfile] | None = None) -> dict[str, str]:
    """``{column: rule}`` for every dropped column. Name rules are decided
    before any scan, so only surviving columns are read. The target is
    always kept (recorded deviation).

    Data rules need no frequency table: a column has at most one distinct
    non-null value iff ``min = max`` (or it is all null); only integer
    columns that already satisfy ``min = 0, max = n-1, no nulls`` get an
    exact distinct count (one aggregate over those candidates)."""
    dropped = {}
    rest = []
    for c in df.columns:
        if c == target:
            continue
        r = name_rule(c)
        if r:
            dropped[c] = r
        else:
            rest.append(c)
    if rest:
        if prof is not None and all(prof[c].distinct is not None for c in rest):
            for c in rest:
                p = prof[c]
                if (p.distinct or 0) <= 1:
                    dropped[c] = "constant"
                elif (is_integral(df.schema[c].dataType) and p.min == 0 and p.max == p.n_rows - 1
                      and p.non_null == p.n_rows and p.distinct == p.n_rows):
                    dropped[c] = "row_number"
        else:
            orderable = [c for c in rest if not isinstance(df.schema[c].dataType, (T.MapType, T.ArrayType,
                                                                                     T.StructType))]
            aggs = [F.count(F.lit(1)).alias("__n")]
            for i, c in enumerate(orderable):
                x = F.col(q(c))
                aggs += [F.count(x).alias(f"nn{i}"), F.min(x).alias(f"mn{i}"), F.max(x).alias(f"mx{i}")]
            r = df.agg(*aggs).first()
            n = r["__n"]
            cands = []
            for i, c in enumerate(orderable):
                nn, mn, mx = r[f"nn{i}"], r[f"mn{i}"], r[f"mx{i}"]
                if nn == 0 or mn == mx:
                    dropped[c] = "constant"
                elif is_integral(df.schema[c].dataType) and mn == 0 and mx == n - 1 and nn == n:
                    cands.append(c)
            if cands:
                d = df.agg(*[F.count_distinct(F.col(q(c))).alias(c) for c in cands]).first()
                for c in cands:
                    if d[c] == n:
                        dropped[c] = "row_number"
    return {c: dropped[c] for c in df.columns if c in dropped}


def prune_columns(df: DataFrame, target: str | None = None,
                  prof: dict[str, ColumnProfile] | None = None):
    """PRJ-6: returns ``(pruned_df, {column: rule})``; Catalyst prunes the scan."""
    rules = prune_rules(df, target, prof)
    return df.select(*[F.col(q(c)) for c in df.columns if c not in rules]), rules


def align(df: DataFrame, columns: list[str], fill: float = 0.0) -> DataFrame:
    """PRJ-7: absent columns -> ``fill``, extra columns dropped, fitted order."""
    have = set(df.columns)
    return df.select(*[F.col(q(c)) if c in have else F.lit(fill).alias(c) for c in columns])
