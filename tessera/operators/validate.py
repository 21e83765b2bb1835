"""VAL-1/2: table checks in the reference's order, as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import q


class ValidationError(ValueError):
    def __init__(self, check: str, detail: str):
        super().__init__(f"{check}: {detail}")
        self.check, self.detail = check, detail


CHECKS = ["is_dataframe", "has_rows", "has_two_columns", "not_all_null",
          "target_exists", "target_not_all_null"]


def validate_checks(df: DataFrame, target: str) -> list[tuple[str, bool, str]]:
    """All checks from one aggregate: ``count(*)``, ``count(c)`` per column."""
    if not isinstance(df, DataFrame):
        return [("is_dataframe", False, f"got {type(df).__name__}")]
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("__n")] + [F.count(F.col(q(c))).alias(f"c{i}") for i, c in enumerate(cols)]
    r = df.agg(*aggs).first()
    n = r["__n"]
    nn = {c: r[f"c{i}"] for i, c in enumerate(cols)}
    has_target = target in cols   # case-sensitive, unlike Spark's resolver
    out = [("is_dataframe", True, "DataFrame"),
           ("has_rows", n >= 1, f"{n} rows"),
           ("has_two_columns", len(cols) >= 2, f"{len(cols)} columns"),
           ("not_all_null", sum(nn.values()) > 0, f"{sum(nn.values())} non-null cells"),
           ("target_exists", has_target, target),
           ("target_not_all_null", has_target and nn.get(target, 0) > 0,
            f"{nn.get(target, 0)} non-null target values")]
    return out


def validate(df: DataFrame, target: str, raise_on_failure: bool = True) -> DataFrame | bool:
    checks = validate_checks(df, target)
    if raise_on_failure:
        for name, ok, detail in checks:
            if not ok:
                raise ValidationError(name, detail)
    spark = df.sparkSession if isinstance(df, DataFrame) else None
    if spark is None:
        return False
    return spark.createDataFrame(checks, "check string, passed boolean, detail string")
