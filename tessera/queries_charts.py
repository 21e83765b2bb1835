"""Chart-data queries: VIZ-1..10."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import charts as C
from .queries import LINEITEM_NUMERICAL, T, register, rounded, sround, union_sql
from .queries_profile import LINEITEM_CATEGORICAL


def _edge_sql(i, c):
    return f"CASE WHEN {i} >= nb_{c} THEN hi_{c} ELSE CAST({i} AS DOUBLE) * ((hi_{c} - lo_{c}) / nb_{c}) + lo_{c} END"


def _hist_sql(table, c):
    st = (f"SELECT count({c}) AS n_{c}, min({c}) AS lo_{c}, max({c}) AS hi_{c}, "
          f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.75) AS q3_{c} FROM {table}")
    width = (f"CASE WHEN 2.0 * (q1q3) * pow(n_{c}, -1.0 / 3.0) > 0 THEN least(2.0 * (q1q3) * pow(n_{c}, -1.0 / 3.0), "
             f"(hi_{c} - lo_{c}) / (log2(n_{c}) + 1.0)) ELSE (hi_{c} - lo_{c}) / (log2(n_{c}) + 1.0) END"
             ).replace("q1q3", f"q3_{c} - q1_{c}")
    plan = f"SELECT *, CAST(ceil((hi_{c} - lo_{c}) / ({width})) AS INTEGER) AS nb_{c} FROM ({st})"
    i0 = f"least(CAST(floor(({c} - lo_{c}) * (nb_{c} / (hi_{c} - lo_{c}))) AS INTEGER), nb_{c} - 1)"
    i1 = f"(CASE WHEN {c} < {_edge_sql(i0, c)} THEN {i0} - 1 ELSE {i0} END)"
    i2 = f"CASE WHEN {c} >= {_edge_sql(f'{i1} + 1', c)} AND {i1} <> nb_{c} - 1 THEN {i1} + 1 ELSE {i1} END"
    return f"""
SELECT '{c}' AS "column", CAST(b.i AS INTEGER) AS bin, {sround(_edge_sql('b.i', c), 6)} AS lo,
       {sround(_edge_sql('b.i + 1', c), 6)} AS hi, CAST(count(x.bin) AS BIGINT) AS cnt
FROM ({plan}) p CROSS JOIN generate_series(0, p.nb_{c} - 1) b(i)
LEFT JOIN (SELECT {i2} AS bin FROM {table}, ({plan}) WHERE {c} IS NOT NULL) x ON x.bin = b.i
GROUP BY ALL"""


@register("histogram", sql=union_sql([_hist_sql("lineitem", c) for c in LINEITEM_NUMERICAL]))
def histogram(spark, sf):
    li = T(spark, sf, "lineitem")
    return rounded(C.histogram(li, LINEITEM_NUMERICAL), {"lo": 6, "hi": 6})


def _density_sql(table, c):
    return f"""SELECT * FROM (
WITH st AS (SELECT count({c}) AS n, min({c}) AS mn, max({c}) AS mx, stddev_samp({c}) * pow(count({c}), -0.2) AS h
            FROM {table}),
g AS (SELECT CAST(i AS INTEGER) AS point, (mn - 3 * h) + ((mx + 3 * h) - (mn - 3 * h)) * i / 199 AS gx
      FROM st, generate_series(0, 199) t(i))
SELECT '{c}' AS "column", point, {sround('gx', 6)} AS x,
       {sround(f'sum(exp(-pow((gx - {c}) / h, 2) / 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi()))', 12)}
         AS density
FROM g, st, {table} WHERE {c} IS NOT NULL GROUP BY point, gx)"""


@register("density", sql=union_sql([_density_sql("lineitem", "l_quantity"), _density_sql("orders", "o_totalprice")]))
def density(spark, sf):
    a = C.density(T(spark, sf, "lineitem"), "l_quantity")
    b = C.density(T(spark, sf, "orders"), "o_totalprice")
    return rounded(a.unionByName(b), {"x": 6, "density": 12})


@register("box_summary", sql=union_sql([f"""
SELECT '{c}' AS "column", {sround('q1', 6)} AS q1, {sround('q2', 6)} AS median, {sround('q3', 6)} AS q3,
       {sround(f'min(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END)', 6)}
         AS whisker_low,
       {sround(f'max(CASE WHEN {c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1) THEN {c} END)', 6)}
         AS whisker_high,
       CAST(count_if(NOT ({c} >= q1 - 1.5 * (q3 - q1) AND {c} <= q3 + 1.5 * (q3 - q1))) AS BIGINT) AS fliers
FROM lineitem, (SELECT quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.5) AS q2,
                       quantile_cont({c}, 0.75) AS q3 FROM lineitem) GROUP BY q1, q2, q3"""
    for c in LINEITEM_NUMERICAL]))
def box_summary(spark, sf):
    out = C.box_summary(T(spark, sf, "lineitem"), LINEITEM_NUMERICAL)
    return rounded(out, {k: 6 for k in ("q1", "median", "q3", "whisker_low", "whisker_high")})


@register("top_categories", sql="SELECT * FROM (" + union_sql([f"""
SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, CAST(count(*) AS BIGINT) AS cnt,
       CAST(row_number() OVER (ORDER BY count(*) DESC, CAST({c} AS VARCHAR) ASC) AS INTEGER) AS rank
FROM lineitem WHERE {c} IS NOT NULL GROUP BY {c}""" for c in LINEITEM_CATEGORICAL + ["l_partkey"]])
          + ") WHERE rank <= 10")
def top_categories(spark, sf):
    li = T(spark, sf, "lineitem")
    return C.top_categories(li, LINEITEM_CATEGORICAL + ["l_partkey"], 10)


PAIR_COLS = ["o_totalprice", "o_custkey", "o_orderkey"]


@register("pair_sample", sql=union_sql([f"""
SELECT * FROM (SELECT '{a} vs {b}' AS pair, CAST({a} AS DOUBLE) AS x, CAST({b} AS DOUBLE) AS y, o_orderkey
FROM orders WHERE {a} IS NOT NULL AND {b} IS NOT NULL
ORDER BY md5('42|' || CAST(o_orderkey AS VARCHAR)) LIMIT 3000)"""
    for i, a in enumerate(PAIR_COLS) for b in PAIR_COLS[i + 1:]]))
def pair_sample(spark, sf):
    return C.pair_sample(T(spark, sf, "orders"), PAIR_COLS, ["o_orderkey"], 3000, 42)


@register("target_distribution", sql="""
SELECT o_orderpriority, CAST(count(*) AS BIGINT) AS cnt FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def target_distribution(spark, sf):
    return C.target_distribution(T(spark, sf, "orders"), "o_orderpriority")["counts"]


@register("chart_clean", sql="""
SELECT CAST(count(*) AS BIGINT) AS "rows", CAST(count(DISTINCT doc_id) AS BIGINT) AS docs
FROM (SELECT DISTINCT * FROM documents)""")
def chart_clean(spark, sf):
    d = C.clean_for_charts(T(spark, sf, "documents"))
    return d.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("doc_id").alias("docs"))


@register("chart_data", sql="""
SELECT * FROM (VALUES ('num_dist'), ('box'), ('cat'), ('target'), ('num_vs_num')) t(chart)""")
def chart_data(spark, sf):
    """VIZ-10: which charts the whole of ``orders`` gives, all computed."""
    types = {"numerical": ["o_totalprice", "o_custkey"], "categorical": ["o_orderstatus", "o_orderpriority"], "text": []}
    charts = C.chart_data(T(spark, sf, "orders"), types, "o_orderpriority", ["o_orderkey"])
    out = None
    for name, df in charts.items():
        frames = df.values() if isinstance(df, dict) else [df]
        for f in frames:
            one = f.agg(F.count(F.lit(1)).alias("n")).where("n > 0").select(F.lit(name).alias("chart"))
            out = one if out is None else out.unionByName(one)
    return out


@register("chart_clean_rows", sql="""
SELECT DISTINCT doc_id, md5(text) AS text_md5, lang, source, n_chars FROM documents""")
def chart_clean_rows(spark, sf):
    """VIZ-1: the rows that stay, with an unnamed column beside them."""
    d = T(spark, sf, "documents")
    both = d.unionByName(d).withColumn("Unnamed: 0", F.monotonically_increasing_id())
    return C.clean_for_charts(both).select("doc_id", F.md5("text").alias("text_md5"), "lang", "source", "n_chars")


_BOX_SQL = union_sql([f"""
SELECT 'box' AS chart, '{c}' AS "column", k AS item, round(v, 4) + 0.0 AS value FROM (
  SELECT unnest(['q1', 'median', 'q3']) AS k, unnest([quantile_cont({c}, 0.25), quantile_cont({c}, 0.5), quantile_cont({c}, 0.75)]) AS v
  FROM orders)""" for c in ("o_totalprice", "o_custkey")])
_CAT_SQL = union_sql([f"""
SELECT '{k}' AS chart, '{c}' AS "column", {c} AS item, CAST(count(*) AS DOUBLE) AS value FROM orders GROUP BY {c}"""
                      for k, c in (("cat", "o_orderstatus"), ("cat", "o_orderpriority"), ("target", "o_orderpriority"))])


@register("chart_values", sql=f"""{_BOX_SQL}
UNION ALL {_CAT_SQL}
UNION ALL SELECT 'num_dist', "column", 'rows', CAST(n AS DOUBLE) FROM (SELECT unnest(['o_totalprice', 'o_custkey']) AS "column", count(*) AS n FROM orders)
UNION ALL SELECT 'num_vs_num', 'o_totalprice vs o_custkey', 'rows', CAST(least(3000, count(*)) AS DOUBLE) FROM orders""")
def chart_values(spark, sf):
    """VIZ-10: the values of the charts of ``orders``, in long form."""
    types = {"numerical": ["o_totalprice", "o_custkey"], "categorical": ["o_orderstatus", "o_orderpriority"], "text": []}
    charts = C.chart_data(T(spark, sf, "orders"), types, "o_orderpriority", ["o_orderkey"])

    def rows(df, chart, column, item, value):
        return df.select(F.lit(chart).alias("chart"), column.alias("column"), item.alias("item"), value.cast("double").alias("value"))

    box, cat, dist, pairs = charts["box"], charts["cat"], charts["num_dist"], charts["num_vs_num"]
    sides = [rows(box, "box", F.col("column"), F.lit(k), F.round(k, 4)) for k in ("q1", "median", "q3")]
    sides.append(rows(cat, "cat", F.col("column"), F.col("value"), F.col("cnt")))
    sides.append(rows(charts["target"]["counts"], "target", F.lit("o_orderpriority"), F.col("o_orderpriority"), F.col("cnt")))
    sides.append(rows(dist.groupBy("column").agg(F.sum("cnt").alias("n")), "num_dist", F.col("column"), F.lit("rows"), F.col("n")))
    sides.append(rows(pairs.groupBy("pair").agg(F.count("*").alias("n")), "num_vs_num", F.col("pair"), F.lit("rows"), F.col("n")))
    out = sides[0]
    for s in sides[1:]:
        out = out.unionByName(s)
    return out
