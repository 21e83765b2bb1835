"""Registered queries: one per operator group of the survey, each a
``(spark, sf_dir) -> DataFrame`` over the driver's tables, with the DuckDB
SQL that must give the same rows (columns aliased identically, doubles
rounded identically on both sides)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sources.tables import read_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def rnd(c: Column | str, d: int = 6) -> Column:
    """Round on the Spark side exactly as ``sround`` does in SQL (and fold -0.0)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), d) + F.lit(0.0)


def sround(x: str, d: int = 6) -> str:
    return f"(round(CAST({x} AS DOUBLE), {d}) + 0.0)"


def rounded(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    return df.select(*[rnd(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_table(spark, sf, name)


# Table schemas as the driver writes them (used to generate the SQL oracles;
# the Spark side always reads the schema from the parquet files).
SCHEMAS = {
    "customer": [("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"),
                 ("c_acctbal", "double"), ("c_mktsegment", "string")],
    "orders": [("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
               ("o_totalprice", "double"), ("o_orderdate", "timestamp"), ("o_orderpriority", "string")],
    "lineitem": [("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"),
                 ("l_linenumber", "int"), ("l_quantity", "double"), ("l_extendedprice", "double"),
                 ("l_discount", "double"), ("l_tax", "double"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "timestamp")],
    "part": [("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"),
             ("p_type", "string"), ("p_size", "int"), ("p_retailprice", "double")],
    "supplier": [("s_suppkey", "bigint"), ("s_name", "string"), ("s_nationkey", "int"),
                 ("s_acctbal", "double")],
    "events": [("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"),
               ("event_type", "string"), ("value", "double"), ("props", "string")],
    "documents": [("doc_id", "bigint"), ("text", "string"), ("lang", "string"),
                  ("source", "string"), ("n_chars", "bigint")],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
}
NUMERIC_TYPES = {"bigint", "int", "double"}
PANDAS = {"bigint": "int64", "int": "int32", "double": "float64", "string": "object",
          "timestamp": "datetime64[ns]"}

# measures of lineitem that the numeric sections are checked on (typing is checked
# on its own by the feature_types query)
LINEITEM_NUMERICAL = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


from . import queries_profile  # noqa: E402,F401  (registers the profiling queries)
from . import queries_prep  # noqa: E402,F401
from . import queries_text  # noqa: E402,F401
from . import queries_charts  # noqa: E402,F401
from . import queries_models  # noqa: E402,F401
from . import queries_workflow  # noqa: E402,F401
