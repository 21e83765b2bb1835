"""Preprocessing queries: MIS, DUP, TYP-1, DT, OUT, SKW, ENC, SPL, SCL, PCA."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import clean, datefeat, encode, shape, split as S
from .operators.types import date_parse_rates
from .queries import T, register, rounded, sround, union_sql

# ---------------------------------------------------------------- derived nulls
# customer/orders/lineitem carry no NULLs, so the null cases are derived from
# the data itself: status 'P' orders lose their price, status 'F' orders lose
# priority and customer.


def orders_with_nulls(spark, sf):
    o = T(spark, sf, "orders")
    return o.select(
        "o_orderkey", "o_orderstatus", "o_orderdate",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")).alias("o_custkey"))


ORDERS_NULLS_SQL = """(SELECT o_orderkey, o_orderstatus, o_orderdate,
  CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
  CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority,
  CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_custkey FROM orders)"""


# ---------------------------------------------------------------- MIS-2

@register("impute_mean", sql=f"""
SELECT o_orderkey, {sround('coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM ' + ORDERS_NULLS_SQL + '))', 4)}
  AS o_totalprice FROM {ORDERS_NULLS_SQL}""")
def impute_mean(spark, sf):
    o = orders_with_nulls(spark, sf)
    p = clean.fit_imputer(o, mean_cols=["o_totalprice"])
    return rounded(clean.impute(o, p).select("o_orderkey", "o_totalprice"), {"o_totalprice": 4})


@register("impute_mean_integer", sql=f"""
SELECT o_orderkey, {sround('coalesce(o_custkey, (SELECT avg(o_custkey) FROM ' + ORDERS_NULLS_SQL + '))', 4)}
  AS o_custkey FROM {ORDERS_NULLS_SQL}""")
def impute_mean_integer(spark, sf):
    o = orders_with_nulls(spark, sf)
    return rounded(clean.impute(o, clean.fit_imputer(o, mean_cols=["o_custkey"])).select("o_orderkey", "o_custkey"), {"o_custkey": 4})


# ---------------------------------------------------------------- MIS-3/4

@register("impute_mode_exact", sql=f"""
WITH o AS (SELECT o_orderkey, o_custkey + 9007199254740993 AS big FROM {ORDERS_NULLS_SQL})
SELECT o_orderkey, coalesce(big, (SELECT big FROM o WHERE big IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS big
FROM o""")
def impute_mode_exact(spark, sf):
    o = orders_with_nulls(spark, sf).select("o_orderkey", (F.col("o_custkey") + F.lit(9007199254740993)).alias("big"))
    return clean.impute(o, clean.fit_imputer(o, mode_cols=["big"]))


@register("impute_mode", sql=f"""
WITH o AS {ORDERS_NULLS_SQL},
mp AS (SELECT o_orderpriority AS v FROM o WHERE o_orderpriority IS NOT NULL GROUP BY 1
       ORDER BY count(*) DESC, 1 ASC LIMIT 1),
mc AS (SELECT o_custkey AS v FROM o WHERE o_custkey IS NOT NULL GROUP BY 1
       ORDER BY count(*) DESC, 1 ASC LIMIT 1)
SELECT o_orderkey, coalesce(o_orderpriority, (SELECT v FROM mp)) AS o_orderpriority,
       coalesce(o_custkey, (SELECT v FROM mc)) AS o_custkey FROM o""")
def impute_mode(spark, sf):
    o = orders_with_nulls(spark, sf)
    p = clean.fit_imputer(o, mode_cols=["o_orderpriority", "o_custkey"])
    return clean.impute(o, p).select("o_orderkey", "o_orderpriority", "o_custkey")


@register("null_counts", sql=union_sql([
    f"SELECT '{c}' AS \"column\", CAST(count(*) - count({c}) AS BIGINT) AS missing FROM {ORDERS_NULLS_SQL}"
    for c in ["o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", "o_orderpriority", "o_custkey"]]))
def null_counts(spark, sf):
    return clean.null_counts(orders_with_nulls(spark, sf))


# ---------------------------------------------------------------- DUP-1/2

@register("drop_duplicates", sql="SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def drop_duplicates(spark, sf):
    return clean.drop_duplicates(T(spark, sf, "orders").select("o_orderstatus", "o_orderpriority"))


@register("dedup_documents", sql="""
SELECT md5(text) AS text_md5, lang, source, CAST(count(*) AS BIGINT) AS copies
FROM (SELECT DISTINCT text, lang, source FROM documents) GROUP BY ALL""")
def dedup_documents(spark, sf):
    d = clean.drop_duplicates(T(spark, sf, "documents").select("text", "lang", "source"))
    return d.groupBy(F.md5("text").alias("text_md5"), "lang", "source").agg(F.count(F.lit(1)).alias("copies"))


# ---------------------------------------------------------------- TYP-1..3

def orders_date_strings(spark, sf):
    o = T(spark, sf, "orders")
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey", "o_orderstatus", "o_orderpriority",
        F.when(F.col("o_orderstatus") != "P", d).otherwise(F.lit("unknown")).alias("d_mostly"),
        F.when(F.col("o_orderstatus") == "P", d).otherwise(F.lit("n/a")).alias("d_third"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.date_format("o_orderdate", "MM/dd/yyyy"))
        .alias("d_us"))


DATE_STR_SQL = """(SELECT o_orderkey, o_orderstatus, o_orderpriority,
  CASE WHEN o_orderstatus <> 'P' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS d_mostly,
  CASE WHEN o_orderstatus = 'P' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'n/a' END AS d_third,
  CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%m/%d/%Y') END AS d_us FROM orders)"""
COERCE_COLS = [("o_orderstatus", None), ("o_orderpriority", None), ("d_mostly", "%Y-%m-%d"),
               ("d_third", "%Y-%m-%d"), ("d_us", "%m/%d/%Y")]
JAVA_FMT = {"%Y-%m-%d": "yyyy-MM-dd", "%m/%d/%Y": "MM/dd/yyyy"}


def _coerce_sql():
    parts = []
    for c, fmt in COERCE_COLS:
        parsed = f"count(try_strptime({c}, '{fmt}'))" if fmt else "0"
        for th in (0.5, 0.6, 0.8):
            parts.append(
                f"SELECT '{c}' AS \"column\", {th} AS threshold, CAST({parsed} AS BIGINT) AS parsed, "
                f"{sround(f'{parsed} / count(*)', 6)} AS parse_rate, {parsed} / count(*) > {th} AS converted "
                f"FROM {DATE_STR_SQL}")
    return union_sql(parts)


@register("date_coercion", sql=_coerce_sql())
def date_coercion(spark, sf):
    df = orders_date_strings(spark, sf)
    rates = date_parse_rates(df, [c for c, _ in COERCE_COLS])
    rows = [(c, th, r["parsed"], r["rate_all"], r["rate_all"] > th)
            for c, r in rates.items() for th in (0.5, 0.6, 0.8)]
    out = spark.createDataFrame(rows, "column string, threshold double, parsed bigint, parse_rate double, "
                                      "converted boolean")
    return rounded(out, {"parse_rate": 6})


@register("date_coercion_apply", sql=f"""
SELECT o_orderkey, strftime(try_strptime(d_mostly, '%Y-%m-%d'), '%Y-%m-%d') AS d_mostly
FROM {DATE_STR_SQL}""")
def date_coercion_apply(spark, sf):
    from .operators.types import coerce_dates
    df, _ = coerce_dates(orders_date_strings(spark, sf).select("o_orderkey", "d_mostly"), threshold=0.6)
    return df.select("o_orderkey", F.date_format("d_mostly", "yyyy-MM-dd").alias("d_mostly"))


# ---------------------------------------------------------------- DT-1..6

def _date_sql(table, key, c, with_time):
    two_pi = "(2 * pi())"
    parts = [f"CAST(year({c}) AS DOUBLE) AS {c}_year", f"CAST(month({c}) AS DOUBLE) AS {c}_month",
             f"CAST(day({c}) AS DOUBLE) AS {c}_day", f"CAST(isodow({c}) - 1 AS DOUBLE) AS {c}_dayofweek",
             f"CAST(quarter({c}) AS DOUBLE) AS {c}_quarter", f"CAST(weekofyear({c}) AS DOUBLE) AS {c}_weekofyear"]
    if with_time:
        parts += [f"CAST(hour({c}) AS DOUBLE) AS {c}_hour", f"CAST(minute({c}) AS DOUBLE) AS {c}_minute"]
    parts += [f"CAST(floor((epoch_us({c}) - (SELECT min(epoch_us({c})) FROM {table})) / 86400000000) AS DOUBLE)"
              f" AS {c}_days_since",
              f"{sround(f'sin({two_pi} * month({c}) / 12)')} AS {c}_month_sin",
              f"{sround(f'cos({two_pi} * month({c}) / 12)')} AS {c}_month_cos",
              f"{sround(f'sin({two_pi} * (isodow({c}) - 1) / 7)')} AS {c}_dow_sin",
              f"{sround(f'cos({two_pi} * (isodow({c}) - 1) / 7)')} AS {c}_dow_cos"]
    return f"SELECT {key}, " + ", ".join(parts) + f" FROM {table}"


def _date_query(spark, sf, table, keys, c):
    df = T(spark, sf, table).select(*keys, c)
    p = datefeat.fit_dates(df, [c])
    out = datefeat.date_features(df, p)
    return rounded(out, {f"{c}_{s}": 6 for s in ("month_sin", "month_cos", "dow_sin", "dow_cos")})


@register("date_parts", sql=_date_sql("orders", "o_orderkey", "o_orderdate", False))
def date_parts_q(spark, sf):
    return _date_query(spark, sf, "orders", ["o_orderkey"], "o_orderdate")


@register("date_time_parts", sql=_date_sql("events", "event_id", "ts", True))
def date_time_parts_q(spark, sf):
    return _date_query(spark, sf, "events", ["event_id"], "ts")


@register("lineitem_date_parts", sql="""
SELECT CAST(year(l_shipdate) AS DOUBLE) AS y, CAST(isodow(l_shipdate) - 1 AS DOUBLE) AS dow,
       CAST(weekofyear(l_shipdate) AS DOUBLE) AS week, CAST(count(*) AS BIGINT) AS n
FROM lineitem GROUP BY ALL""")
def lineitem_date_parts(spark, sf):
    li = T(spark, sf, "lineitem")
    return (li.select(F.year("l_shipdate").cast("double").alias("y"),
                      F.weekday("l_shipdate").cast("double").alias("dow"),
                      F.weekofyear("l_shipdate").cast("double").alias("week"))
            .groupBy("y", "dow", "week").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- OUT-1..4

CAP_COLS = ["l_quantity", "l_extendedprice"]


def _cap_sql(method):
    sel = []
    for c in CAP_COLS:
        if method == "iqr":
            lo = f"(SELECT quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)"
            hi = f"(SELECT quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)) FROM lineitem)"
        else:
            lo = f"(SELECT avg({c}) - 3 * stddev_samp({c}) FROM lineitem)"
            hi = f"(SELECT avg({c}) + 3 * stddev_samp({c}) FROM lineitem)"
        sel.append(f"{sround(f'greatest(least({c}, {hi}), {lo})', 4)} AS {c}")
    return "SELECT l_orderkey, l_linenumber, " + ", ".join(sel) + " FROM lineitem"


def _cap_query(spark, sf, method):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *CAP_COLS)
    p = shape.fit_outliers(li, CAP_COLS, method=method)
    return rounded(shape.cap_outliers(li, p), {c: 4 for c in CAP_COLS})


@register("cap_iqr", sql=_cap_sql("iqr"))
def cap_iqr(spark, sf):
    return _cap_query(spark, sf, "iqr")


@register("cap_zscore", sql=_cap_sql("zscore"))
def cap_zscore(spark, sf):
    return _cap_query(spark, sf, "zscore")


REPORT_COLS = [("lineitem", "l_quantity"), ("lineitem", "l_extendedprice"), ("lineitem", "l_discount"),
               ("supplier", "s_acctbal"), ("customer", "c_acctbal"), ("orders", "o_totalprice")]


def _report_sql(table, c):
    n, skew = f"count({c})", f"skewness({c})"
    method = f"CASE WHEN {n} < 500 OR abs({skew}) > 1 THEN 'IQR Capping' ELSE 'Z-score Capping' END"
    lo = (f"CASE WHEN {n} < 500 OR abs({skew}) > 1 THEN quantile_cont({c}, 0.25) - 1.5 * (quantile_cont({c}, 0.75)"
          f" - quantile_cont({c}, 0.25)) ELSE avg({c}) - 3 * stddev_samp({c}) END")
    hi = (f"CASE WHEN {n} < 500 OR abs({skew}) > 1 THEN quantile_cont({c}, 0.75) + 1.5 * (quantile_cont({c}, 0.75)"
          f" - quantile_cont({c}, 0.25)) ELSE avg({c}) + 3 * stddev_samp({c}) END")
    return (f"SELECT '{table}' AS \"table\", '{c}' AS \"column\", m AS method, "
            f"CAST(count_if({c} < lo OR {c} > hi) AS BIGINT) AS outliers_capped "
            f"FROM {table}, (SELECT {method} AS m, {lo} AS lo, {hi} AS hi FROM {table}) GROUP BY m")


@register("outlier_cap_report", sql=union_sql([_report_sql(t, c) for t, c in REPORT_COLS]))
def outlier_cap_report(spark, sf):
    out = None
    for t, c in REPORT_COLS:
        df = T(spark, sf, t).select(c)
        r = shape.outlier_report(spark, shape.fit_outliers(df, [c])).select(
            F.lit(t).alias("table"), "column", "method", "outliers_capped")
        out = r if out is None else out.unionByName(r)
    return out


# ---------------------------------------------------------------- SKW-2/3

YJ_COLS = ["l_extendedprice", "l_quantity", "l_orderkey"]


def _yj_sql_expr(x, lam):
    pos = f"ln({x} + 1)" if lam == 0 else f"(pow({x} + 1, {lam}) - 1) / {lam}"
    neg = f"-ln(1 - {x})" if lam == 2 else f"-(pow(1 - {x}, {2 - lam}) - 1) / {2 - lam}"
    return f"CASE WHEN {x} >= 0 THEN {pos} ELSE {neg} END"


def _yj_var_sql_expr(x, lam):
    """SQL twin of ``yeo_johnson_shifted``."""
    if lam == 0:
        return _yj_sql_expr(x, lam)
    return f"CASE WHEN {x} >= 0 THEN pow({x} + 1, {lam}) / {lam} ELSE {_yj_sql_expr(x, lam)} + 1.0 / {lam} END"


def _yj_grid_sql():
    parts = []
    for c in YJ_COLS:
        for lam in shape.COARSE_GRID:
            llf = (f"-count({c}) / 2.0 * ln(var_pop({_yj_var_sql_expr(c, lam)})) + "
                   f"({lam} - 1) * sum(sign({c}) * ln(1 + abs({c})))")
            parts.append(f"SELECT '{c}' AS \"column\", {float(lam)} AS lambda, {sround(llf, 3)} AS llf FROM lineitem")
    return union_sql(parts)


@register("yeo_johnson_grid", sql=_yj_grid_sql())
def yeo_johnson_grid(spark, sf):
    li = T(spark, sf, "lineitem")
    g = shape.yj_loglik_grid(li, {c: shape.COARSE_GRID for c in YJ_COLS})
    rows = [(c, float(lam), llf) for c, v in g.items() for lam, llf in v]
    return rounded(spark.createDataFrame(rows, "column string, lambda double, llf double"), {"llf": 3})


YJ_ROUNDS = 3      # refinements of the checked fit: lambda to 0.001, where both engines' sums agree on the best


def _yj_fit_sql(c: str) -> str:
    """CTEs b0..bR: the best lambda of the coarse grid, then of each refinement."""
    def yj(lam):
        return (f"CASE WHEN {c} >= 0 THEN CASE WHEN {lam} = 0 THEN ln({c} + 1) ELSE pow({c} + 1, {lam}) / {lam} END "
                f"ELSE CASE WHEN {lam} = 2 THEN -ln(1 - {c}) ELSE -(pow(1 - {c}, 2 - {lam}) - 1) / (2 - {lam}) END "
                f"+ CASE WHEN {lam} = 0 THEN 0 ELSE 1.0 / {lam} END END")
    llf = f"-count({c}) / 2.0 * ln(var_pop({yj('g.lam')})) + (g.lam - 1) * sum(sign({c}) * ln(1 + abs({c})))"
    step, out = 0.5, []
    grid = "SELECT CAST(i AS DOUBLE) / 2 AS lam FROM range(-10, 11) t(i)"
    for r in range(YJ_ROUNDS + 1):
        out.append(f"b{r} AS (SELECT lam FROM (SELECT g.lam, {llf} AS llf FROM lineitem, ({grid}) g GROUP BY g.lam) "
                   "ORDER BY llf DESC, abs(lam) LIMIT 1)")
        step /= 8
        grid = f"SELECT lam + (i - 8) * {step!r} AS lam FROM b{r}, range(0, 17) t(i)"
    return ",\n".join(out)


def _yj_apply_sql():
    c = "l_extendedprice"
    return f"""
WITH {_yj_fit_sql(c)},
t AS (SELECT l_orderkey, l_linenumber, CASE WHEN lam = 0 THEN ln({c} + 1) ELSE (pow({c} + 1, lam) - 1) / lam END AS y
      FROM lineitem, b{YJ_ROUNDS})
SELECT l_orderkey, l_linenumber, {sround('(y - (SELECT avg(y) FROM t)) / (SELECT stddev_pop(y) FROM t)', 6)}
  AS l_extendedprice FROM t"""


@register("yeo_johnson_apply", sql=_yj_apply_sql())
def yeo_johnson_apply(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    p = shape.fit_yeo_johnson(li, ["l_extendedprice"], rounds=YJ_ROUNDS)
    return rounded(shape.yeo_johnson_transform(li, p), {"l_extendedprice": 6})


# ---------------------------------------------------------------- ENC-1/2

@register("label_encode", sql="""
SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS DOUBLE) AS label FROM orders""")
def label_encode(spark, sf):
    o = T(spark, sf, "orders")
    classes = encode.fit_label(o, "o_orderpriority")
    return encode.encode_label(o, "o_orderpriority", classes, "label").select("o_orderkey", "label")


@register("label_roundtrip", sql="SELECT o_orderkey, o_orderpriority FROM orders")
def label_roundtrip(spark, sf):
    o = T(spark, sf, "orders")
    classes = encode.fit_label(o, "o_orderpriority")
    enc = encode.encode_label(o, "o_orderpriority", classes, "label")
    return encode.decode_label(enc, "label", classes, "decoded").select(
        "o_orderkey", F.col("decoded").alias("o_orderpriority"))


# ---------------------------------------------------------------- ENC-3..6

@register("ordinal_encode", sql="""
SELECT l_orderkey, l_linenumber,
  CASE l_linestatus WHEN (SELECT min(l_linestatus) FROM lineitem) THEN 0.0
       WHEN (SELECT max(l_linestatus) FROM lineitem) THEN 1.0 ELSE -1.0 END AS l_linestatus
FROM lineitem""")
def ordinal_encode(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus")
    p = encode.fit_encoders(li, ["l_linestatus"])
    return encode.encode(li, p)


def _onehot_sql():
    st = ["F", "O", "P"]
    pr = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    cols = [f"CAST(o_orderstatus = '{v}' AS DOUBLE) AS \"o_orderstatus_{v}\"" for v in st]
    cols += [f"CAST(o_orderpriority = '{v}' AS DOUBLE) AS \"o_orderpriority_{v}\"" for v in pr]
    return "SELECT o_orderkey, " + ", ".join(cols) + " FROM orders"


@register("onehot_encode", sql=_onehot_sql())
def onehot_encode(spark, sf):
    o = T(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    return encode.encode(o, encode.fit_encoders(o, ["o_orderstatus", "o_orderpriority"]))


@register("frequency_encode", sql="""
SELECT l_orderkey, l_linenumber,
  (round(count(*) OVER (PARTITION BY l_partkey) / count(*) OVER (), 8) + 0.0) AS l_partkey,
  (round(count(*) OVER (PARTITION BY l_suppkey) / count(*) OVER (), 8) + 0.0) AS l_suppkey
FROM lineitem""")
def frequency_encode(spark, sf):
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = encode.fit_encoders(li, ["l_partkey", "l_suppkey"])
    return rounded(encode.encode(li, p), {"l_partkey": 8, "l_suppkey": 8})


@register("encoder_routes", sql=union_sql([
    f"SELECT '{t}' AS \"table\", '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) <= 2 THEN 'ordinal' "
    f"WHEN count(DISTINCT {c}) <= 10 THEN 'onehot' ELSE 'frequency' END AS kind FROM {t}"
    for t, c in [("lineitem", "l_linestatus"), ("lineitem", "l_returnflag"), ("part", "p_type"),
                 ("part", "p_brand"), ("customer", "c_mktsegment"), ("customer", "c_nationkey")]]))
def encoder_routes(spark, sf):
    rows = []
    for t, c in [("lineitem", "l_linestatus"), ("lineitem", "l_returnflag"), ("part", "p_type"),
                 ("part", "p_brand"), ("customer", "c_mktsegment"), ("customer", "c_nationkey")]:
        df = T(spark, sf, t).select(c)
        rows.append((t, c, encode.fit_encoders(df, [c])[c]["kind"]))
    return spark.createDataFrame(rows, "table string, column string, kind string")


# ---------------------------------------------------------------- SPL-1, SCL-1

SPLIT_SQL = "((('0x' || substr(md5('42|' || CAST(o_orderkey AS VARCHAR)), 1, 8))::UBIGINT) / 4294967296.0 < 0.2)"


@register("split_8020", sql=f"SELECT o_orderkey, {SPLIT_SQL} AS is_test FROM orders")
def split_8020(spark, sf):
    return S.split(T(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.2, 42)


@register("split_exact", sql="""
SELECT l_orderkey, l_linenumber, row_number() OVER (ORDER BY md5('42|' || l_orderkey || '|' || l_linenumber)) <= ceil(0.2 * count(*) OVER ()) AS is_test
FROM lineitem""")
def split_exact(spark, sf):
    """SPL-1 with the exact number of test rows."""
    return S.exact_split(T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], 0.2, 42)


@register("standard_scale", sql=f"""
WITH o AS (SELECT o_orderkey, o_totalprice, {SPLIT_SQL} AS is_test FROM orders),
st AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM o WHERE NOT is_test)
SELECT o_orderkey, is_test, {sround('(o_totalprice - m) / s', 6)} AS o_totalprice FROM o, st""")
def standard_scale(spark, sf):
    o = S.split(T(spark, sf, "orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 0.2, 42)
    p = S.fit_scaler(o.where(~F.col("is_test")), ["o_totalprice"])
    return rounded(S.scale(o, p), {"o_totalprice": 6})


# ---------------------------------------------------------------- PCA-1 (rows-only)

@register("pca_project")
def pca_project(spark, sf):
    li = T(spark, sf, "lineitem")
    cols = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_partkey", "l_suppkey"]
    sc = S.scale(li, S.fit_scaler(li, cols))
    p = S.fit_pca(sc, cols, k=3)
    return S.pca_transform(sc, p, keep=["l_orderkey", "l_linenumber"])

