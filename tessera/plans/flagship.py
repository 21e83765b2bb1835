"""Flagship query: what does this table look like, which columns have outliers?"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import analyze as A
from ..sources.tables import read_table


def numeric_profile(spark: SparkSession, sf_dir: str, table: str = "lineitem") -> DataFrame:
    """Long form ``column, count, mean, std, min, q25, q50, q75, max,
    skewness, outlier_count`` for the numerical columns of ``table``."""
    f = A.facts(read_table(spark, sf_dir, table))
    num = A.measures(f)
    qs = A.numeric_quantiles(f, num)
    desc = A.describe_section(f, num, qs)
    out = A.outliers_section(f, num, qs).select("column", "outlier_count")
    f.release()
    return desc.join(out, "column", "left").orderBy("column")
