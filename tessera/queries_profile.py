"""Profiling, typing, validation and pruning queries (ANA, TYP, VAL, PRJ)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import analyze as A
from .operators.profile import value_counts
from .operators.prune import NAME_WORDS, ID_WORDS, prune_rules
from .operators.types import problem_type, types_frame
from .operators.validate import validate_checks
from .queries import (LINEITEM_NUMERICAL, NUMERIC_TYPES, PANDAS, SCHEMAS, T, register, rounded,
                      sround, union_sql)

# ---------------------------------------------------------------- ANA-1 / DUP-1

register("profile_overview", sql="""
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(11 AS BIGINT) AS "columns",
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM lineitem)) AS BIGINT) AS duplicate_rows
FROM lineitem""")(lambda spark, sf: A.overview(T(spark, sf, "lineitem")))


# ---------------------------------------------------------------- ANA-2 / MIS-1

def _columns_sql(table: str) -> str:
    parts = []
    for c, t in SCHEMAS[table]:
        parts.append(
            f"SELECT '{c}' AS \"column\", '{PANDAS[t]}' AS dtype, "
            f"CAST(count(*) - count({c}) AS BIGINT) AS missing_values, "
            f"{sround(f'100.0 * (count(*) - count({c})) / count(*)')} AS missing_percent, "
            f"CAST(count(DISTINCT {c}) AS BIGINT) AS unique_values FROM {table}")
    return union_sql(parts)


@register("profile_columns", sql=_columns_sql("orders"))
def profile_columns(spark, sf):
    f = A.facts(T(spark, sf, "orders"), cache_freq=False)
    out = A.columns_section(f)
    f.release()
    return rounded(out, {"missing_percent": 6})


# ---------------------------------------------------------------- ANA-4/5, SKW-1

def _describe_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(
            f"SELECT '{c}' AS \"column\", CAST(count({c}) AS DOUBLE) AS count, "
            f"{sround(f'avg({c})', 4)} AS mean, {sround(f'stddev_samp({c})', 4)} AS std, "
            f"{sround(f'min({c})', 4)} AS min, {sround(f'quantile_cont({c}, 0.25)', 4)} AS q25, "
            f"{sround(f'quantile_cont({c}, 0.5)', 4)} AS q50, {sround(f'quantile_cont({c}, 0.75)', 4)} AS q75, "
            f"{sround(f'max({c})', 4)} AS max, {sround(f'skewness({c})', 6)} AS skewness FROM {table}")
    return union_sql(parts)


DESCRIBE_DIGITS = {"mean": 4, "std": 4, "min": 4, "q25": 4, "q50": 4, "q75": 4, "max": 4, "skewness": 6}


@register("describe_numeric", sql=_describe_sql("lineitem", LINEITEM_NUMERICAL))
def describe_numeric(spark, sf):
    f = A.facts(T(spark, sf, "lineitem").select(*LINEITEM_NUMERICAL))
    out = A.describe_section(f, LINEITEM_NUMERICAL)
    f.release()
    return rounded(out, DESCRIBE_DIGITS)


@register("skewness_adj", sql=union_sql([
    f"SELECT '{c}' AS \"column\", {sround(f'skewness({c})', 6)} AS skewness FROM lineitem"
    for c in ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]]))
def skewness_adj(spark, sf):
    from .operators.profile import adjusted_skew_col
    df = T(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber"]
    row = df.agg(*[adjusted_skew_col(F.col(c).cast("double")).alias(c) for c in cols]).first()
    return spark.createDataFrame([(c, row[c]) for c in cols], "column string, skewness double") \
        .select("column", F.round("skewness", 6).alias("skewness") + F.lit(0.0)).toDF("column", "skewness")


# ---------------------------------------------------------------- ANA-6

def _iqr_sql(table: str, cols: list[str]) -> str:
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS "column", CAST(trunc(q1) AS BIGINT) AS q1, CAST(trunc(q3) AS BIGINT) AS q3,
       CAST(trunc(q3 - q1) AS BIGINT) AS iqr,
       {sround('q1 - 1.5 * (q3 - q1)', 4)} AS lower_bound, {sround('q3 + 1.5 * (q3 - q1)', 4)} AS upper_bound,
       CAST(count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS BIGINT) AS outlier_count,
       CAST(trunc(100.0 * count_if({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / count(*)) AS BIGINT)
         AS outlier_percent
FROM {table}, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM {table})
GROUP BY q1, q3""")
    return union_sql(parts)


@register("iqr_outliers", sql=_iqr_sql("lineitem", LINEITEM_NUMERICAL))
def iqr_outliers(spark, sf):
    f = A.facts(T(spark, sf, "lineitem").select(*LINEITEM_NUMERICAL))
    out = A.outliers_section(f, LINEITEM_NUMERICAL)
    f.release()
    return rounded(out, {"lower_bound": 4, "upper_bound": 4})


# ---------------------------------------------------------------- ANA-7

LINEITEM_CATEGORICAL = ["l_linenumber", "l_discount", "l_tax", "l_returnflag", "l_linestatus"]


@register("category_counts", sql=union_sql([
    f"SELECT '{c}' AS \"column\", CAST(count(DISTINCT {c}) AS BIGINT) AS categories_count FROM lineitem"
    for c in LINEITEM_CATEGORICAL]))
def category_counts(spark, sf):
    f = A.facts(T(spark, sf, "lineitem"), cache_freq=False)
    out = A.categories_section(f)
    f.release()
    return out


# ---------------------------------------------------------------- ANA-8

@register("correlation_pairs", sql=union_sql([
    f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
    + (f"{sround(f'corr({a}, {b})', 6)}" if a != b else f"CASE WHEN stddev_samp({a}) > 0 THEN 1.0 END")
    + " AS corr FROM lineitem"
    for a in LINEITEM_NUMERICAL for b in LINEITEM_NUMERICAL]))
def correlation_pairs(spark, sf):
    return rounded(A.correlation_pairs(T(spark, sf, "lineitem"), LINEITEM_NUMERICAL), {"corr": 6})


# ---------------------------------------------------------------- TYP-4

TYPED_TABLES = ["customer", "orders", "lineitem", "part", "supplier", "events", "documents", "labels"]
SQL_DATE_FORMATS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H:%M:%S.%f', '%Y-%m-%dT%H:%M:%S', " \
                   "'%Y-%m-%d %H:%M', '%Y-%m-%d', '%Y/%m/%d', '%m/%d/%Y', '%m/%d/%Y %H:%M', " \
                   "'%d-%m-%Y', '%d.%m.%Y', '%b %d, %Y', '%d %b %Y', '%B %d, %Y', '%d/%m/%Y', " \
                   "'%m/%d/%Y %H:%M:%S', '%d/%m/%Y %H:%M:%S', '%Y%m%d']"


def _type_case(table: str, c: str, t: str) -> str:
    u = f"count(DISTINCT {c})"
    arms = [f"WHEN count({c}) = 0 THEN 'all_null'", f"WHEN count(DISTINCT {c}) <= 1 THEN 'constant'"]
    if t in NUMERIC_TYPES:
        arms.append(f"WHEN count_if({c} NOT IN (0, 1)) = 0 THEN 'boolean'")
        arms += [f"WHEN {u} <= 20 THEN 'categorical'",
                 f"WHEN {u} / count(*) > 0.95 THEN 'id'", "ELSE 'numerical'"]
    elif t == "timestamp":
        arms.append("ELSE 'datetime'")
    else:
        arms += [f"WHEN count(CASE WHEN regexp_matches(trim({c}), '[0-9]') THEN try_strptime(trim({c}), "
                 f"{SQL_DATE_FORMATS}) END) / count({c}) > 0.8 THEN 'datetime'",
                 f"WHEN {u} / count(*) > 0.95 THEN 'id'",
                 f"WHEN avg(length({c})) > 30 THEN 'text'", "ELSE 'categorical'"]
    return (f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", CASE {' '.join(arms)} END "
            f"AS feature_type FROM {table}")


@register("feature_types", sql=union_sql(
    [_type_case(t, c, ty) for t in TYPED_TABLES for c, ty in SCHEMAS[t]]))
def feature_types_q(spark, sf):
    out = None
    for t in TYPED_TABLES:
        f = A.facts(T(spark, sf, t), cache_freq=False)
        ft = types_frame(spark, f.types).select(F.lit(t).alias("table"), "column", "feature_type")
        out = ft if out is None else out.unionByName(ft)
    return out


# ---------------------------------------------------------------- TYP-6

PROBLEMS = [("orders", "o_orderpriority"), ("orders", "o_totalprice"), ("lineitem", "l_linenumber"),
            ("lineitem", "l_quantity"), ("labels", "quality"), ("customer", "c_acctbal"),
            ("part", "p_size")]


def _problem_sql(table, c):
    t = dict(SCHEMAS[table])[c]
    if t == "string":
        case = "any_value('Classification')"
    elif t == "double":
        case = "any_value('Regression')"
    else:
        case = f"CASE WHEN count(DISTINCT {c}) < 20 THEN 'Classification' ELSE 'Regression' END"
    return f"SELECT '{table}' AS \"table\", '{c}' AS target, {case} AS task_type FROM {table}"


@register("problem_type", sql=union_sql([_problem_sql(t, c) for t, c in PROBLEMS]))
def problem_type_q(spark, sf):
    rows = [(t, c, problem_type(T(spark, sf, t), c)) for t, c in PROBLEMS]
    return spark.createDataFrame(rows, "table string, target string, task_type string")


# ---------------------------------------------------------------- VAL-1/2

@register("validate_checks", sql="""
SELECT * FROM (VALUES ('is_dataframe', true, 'DataFrame')) t(check_name, passed, detail)
UNION ALL SELECT 'has_rows', count(*) >= 1, CAST(count(*) AS VARCHAR) || ' rows' FROM orders
UNION ALL SELECT 'has_two_columns', true, '6 columns'
UNION ALL SELECT 'not_all_null', count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice)
          + count(o_orderdate) + count(o_orderpriority) > 0,
          CAST(count(o_orderkey) + count(o_custkey) + count(o_orderstatus) + count(o_totalprice)
          + count(o_orderdate) + count(o_orderpriority) AS VARCHAR) || ' non-null cells' FROM orders
UNION ALL SELECT 'target_exists', true, 'o_orderpriority'
UNION ALL SELECT 'target_not_all_null', count(o_orderpriority) > 0,
          CAST(count(o_orderpriority) AS VARCHAR) || ' non-null target values' FROM orders""")
def validate_checks_q(spark, sf):
    rows = validate_checks(T(spark, sf, "orders"), "o_orderpriority")
    return spark.createDataFrame(rows, "check_name string, passed boolean, detail string")


@register("validate_failing", sql="""
SELECT 'empty' AS target, 'target_not_all_null' AS check_name, 'failed' AS kind, count(*) AS rows FROM orders
UNION ALL SELECT 'absent', 'target_exists', 'failed', count(*) FROM orders
UNION ALL SELECT 'absent', 'target_not_all_null', 'failed', count(*) FROM orders""")
def validate_failing(spark, sf):
    """The checks that fail for a target without values and for an absent one."""
    o = T(spark, sf, "orders").select("o_orderkey", F.lit(None).cast("string").alias("empty"))
    n = o.count()
    rows = [(t, c, "failed", n) for t in ("empty", "absent") for c, ok, _ in validate_checks(o, t) if not ok]
    return spark.createDataFrame(rows, "target string, check_name string, kind string, rows bigint")


# ---------------------------------------------------------------- PRJ-1..5

PRUNED_TABLES = ["customer", "orders", "lineitem", "part", "supplier", "events"]


def _prune_sql(table):
    parts = []
    for c, t in SCHEMAS[table]:
        low = c.lower()
        name_hit = " OR ".join(f"contains(lower('{c}'), '{w}')" for w in NAME_WORDS)
        id_hit = " OR ".join(f"contains(lower('{c}'), '{w}')" for w in ID_WORDS)
        arms = [f"WHEN {name_hit} THEN 'name'", f"WHEN {id_hit} THEN 'id'",
                f"WHEN starts_with(lower('{c}'), 'unnamed') THEN 'unnamed'",
                f"WHEN count(DISTINCT {c}) <= 1 THEN 'constant'"]
        if t in ("bigint", "int"):
            arms.append(f"WHEN min({c}) = 0 AND max({c}) = count(*) - 1 AND count({c}) = count(*) "
                        f"AND count(DISTINCT {c}) = count(*) THEN 'row_number'")
        parts.append(f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", CASE {' '.join(arms)} END AS rule "
                     f"FROM {table}")
        del low
    return union_sql(parts)


@register("prune_columns", sql="SELECT * FROM (" + union_sql([_prune_sql(t) for t in PRUNED_TABLES])
          + ") WHERE rule IS NOT NULL")
def prune_columns_q(spark, sf):
    rows = []
    for t in PRUNED_TABLES:
        rows += [(t, c, r) for c, r in prune_rules(T(spark, sf, t)).items()]
    return spark.createDataFrame(rows, "table string, column string, rule string")


# ---------------------------------------------------------------- value-frequency table

@register("value_frequencies", sql=union_sql([
    f"SELECT '{c}' AS \"column\", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS cnt "
    f"FROM orders WHERE {c} IS NOT NULL GROUP BY {c}"
    for c in ["o_orderstatus", "o_orderpriority", "o_custkey"]]))
def value_frequencies(spark, sf):
    return value_counts(T(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority", "o_custkey"]) \
        .select("column", "value", "cnt")
