"""Parquet table source with the engine's null model (NaN -> NULL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import q

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def normalize_nan(df: DataFrame) -> DataFrame:
    """pandas treats NaN as missing; Spark does not. Map NaN to NULL in every
    floating column so that counts, means and distincts agree."""
    fl = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    if not fl:
        return df
    return df.select(*[
        F.when(F.isnan(F.col(q(c))), F.lit(None)).otherwise(F.col(q(c))).alias(c) if c in fl else F.col(q(c))
        for c in df.columns])


def read_table(spark: SparkSession, sf_dir: str, name: str, nan_to_null: bool = True) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return normalize_nan(df) if nan_to_null else df
