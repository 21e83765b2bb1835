"""CSV source (IO-1..5): header, type inference, ragged rows, encoding
fallback and the pandas family of missing-value tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import q

# The strings pandas' CSV reader treats as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
             "n/a", "nan", "null"]
# The spellings pandas reads as booleans.
TRUE_TOKENS = ["True", "TRUE", "true"]
FALSE_TOKENS = ["False", "FALSE", "false"]

# What counts as a number in a text column.
INTEGER = r"^\s*[+-]?\d+\s*$"
REAL = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$|^[+-]?[iI]nf(inity)?$"
OVERFLOW = "_overflow"


class DatasetError(ValueError):
    """Raised by the load guards (IO-5)."""


def _reader(spark: SparkSession, encoding: str, multi_line: bool):
    """Quotes as RFC 4180 has them: doubled inside quotes, line breaks allowed."""
    return (spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"')
            .option("multiLine", multi_line))


def _header(spark: SparkSession, path: str, encoding: str, multi_line: bool) -> list[str]:
    return _reader(spark, encoding, multi_line).csv(path).columns


def _read_raw(spark: SparkSession, path: str, encoding: str, cols: list[str], multi_line: bool) -> DataFrame:
    # One extra trailing column catches rows with too many fields; rows with
    # too few are padded with NULL by the PERMISSIVE parser.
    schema = T.StructType([T.StructField(c, T.StringType()) for c in cols]
                          + [T.StructField(OVERFLOW, T.StringType())])
    return (_reader(spark, encoding, multi_line).schema(schema).option("mode", "PERMISSIVE")
            .option("nullValue", "\u0000").option("emptyValue", "").csv(path))


def read_csv(spark: SparkSession, path: str, encoding: str | None = None,
             na_tokens: list[str] | None = None, infer: bool = True, multi_line: bool = True) -> DataFrame:
    """``multi_line`` keeps line breaks inside quotes; switch it off for files
    that have none, and Spark can split large files between tasks."""
    if not path.lower().endswith(".csv") and not path.endswith("/"):
        # directories of part files are fine; other single-file formats are not
        if "." in path.rsplit("/", 1)[-1]:
            raise DatasetError(f"unsupported file type: {path}")
    enc = encoding or "UTF-8"
    cols = _header(spark, path, enc, multi_line)
    raw = _read_raw(spark, path, enc, cols, multi_line)
    if encoding is None:
        bad = raw.select(F.count_if(F.concat_ws("", *[F.col(q(c)) for c in cols]).contains("�"))
                         .alias("n")).first()["n"]
        if bad:
            enc = "ISO-8859-1"
            cols = _header(spark, path, enc, multi_line)
            raw = _read_raw(spark, path, enc, cols, multi_line)
    tokens = NA_TOKENS if na_tokens is None else na_tokens
    df = raw.filter(F.col(OVERFLOW).isNull()).select(*[
        F.when(F.col(q(c)).isin(tokens), F.lit(None)).otherwise(F.col(q(c))).alias(c) for c in cols])
    if infer:
        df = infer_types(df)
    check_loaded(df)
    return df


def infer_types(df: DataFrame) -> DataFrame:
    """Per string column: bigint if every value casts, else double, else
    boolean, else string. One aggregate pass decides every column."""
    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not cols:
        return df
    def number(x, shape, kind):   # Java's own parsers also take "1D" and "0x1p3"
        return F.when(x.rlike(shape), x.try_cast(kind))

    aggs = []
    for k, c in enumerate(cols):
        x = F.col(q(c))
        aggs += [F.count(x).alias(f"n{k}"), F.count(number(x, INTEGER, "bigint")).alias(f"i{k}"),
                 F.count(number(x, REAL, "double")).alias(f"d{k}"),
                 F.count_if(x.isin(TRUE_TOKENS + FALSE_TOKENS)).alias(f"b{k}")]
    r = df.agg(*aggs).first().asDict()
    place = {c: k for k, c in enumerate(cols)}
    out = []
    for c in df.columns:
        x, k = F.col(q(c)), place.get(c)
        if k is None or r[f"n{k}"] == 0:
            out.append(x)
        elif r[f"i{k}"] == r[f"n{k}"]:
            out.append(number(x, INTEGER, "bigint").alias(c))
        elif r[f"d{k}"] == r[f"n{k}"]:
            out.append(number(x, REAL, "double").alias(c))
        elif r[f"b{k}"] == r[f"n{k}"]:
            out.append(x.isin(TRUE_TOKENS).alias(c))
        else:
            out.append(x)
    return df.select(*out)


def check_loaded(df: DataFrame) -> None:
    if len(df.columns) < 2:
        raise DatasetError("dataset must have at least 2 columns")
    if df.isEmpty():
        raise DatasetError("dataset is empty")
