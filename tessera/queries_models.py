"""Metric and neighbour queries: EV-1..11, MR-8, MC-5."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import knn as K
from .operators import metrics as M
from .operators.split import split_hash
from .queries import T, register, rounded, sround

METRIC_DIGITS = {k: 6 for k in ("MAE", "MSE", "RMSE", "R2", "MAPE", "EVS", "Accuracy", "Precision",
                                "Recall", "F1", "ROC-AUC")}


# ---------------------------------------------------------------- EV-1..6
# prediction of a line's price from the part's list price: quantity * retailprice

def price_predictions(spark, sf):
    li = T(spark, sf, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice")
    part = T(spark, sf, "part").select("p_partkey", "p_retailprice")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * F.col("p_retailprice")).alias("prediction"))


@register("regression_metrics", sql=f"""
WITH d AS (SELECT l_extendedprice AS y, l_quantity * p_retailprice AS p FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT {sround('avg(abs(y - p))')} AS MAE, {sround('avg((y - p) * (y - p))', 4)} AS MSE,
       {sround('sqrt(avg((y - p) * (y - p)))')} AS RMSE,
       {sround('1 - avg((y - p) * (y - p)) / var_pop(y)')} AS R2,
       {sround('avg(abs(y - p) / greatest(abs(y), 2.220446049250313e-16))')} AS MAPE,
       {sround('1 - var_pop(y - p) / var_pop(y)')} AS EVS FROM d""")
def regression_metrics(spark, sf):
    return rounded(M.regression_metrics(price_predictions(spark, sf)), {**METRIC_DIGITS, "MSE": 4})


# ---------------------------------------------------------------- EV-7..11, binary
# quality label of a document predicted from its length (long documents -> 1)

def quality_predictions(spark, sf):
    lab = T(spark, sf, "labels").select("doc_id", "quality")
    doc = T(spark, sf, "documents").select("doc_id", "n_chars")
    return lab.join(doc, "doc_id").select(
        F.col("quality").alias("label"), (F.col("n_chars") >= 1000).cast("int").alias("prediction"),
        F.col("n_chars").cast("double").alias("score"))


def _binary_sql():
    return f"""
WITH d AS (SELECT quality AS y, CAST(n_chars >= 1000 AS INTEGER) AS p, CAST(n_chars AS DOUBLE) AS s
           FROM labels JOIN documents USING (doc_id)),
cls AS (SELECT c, count_if(y = c AND p = c) AS tp, count_if(y = c) AS sup, count_if(p = c) AS prd
        FROM d, (SELECT DISTINCT y AS c FROM d UNION SELECT DISTINCT p FROM d) GROUP BY c),
pc AS (SELECT *, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rc
       FROM cls),
rk AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r FROM d),
auc AS (SELECT (sum(CASE WHEN y = 1 THEN r END) - count_if(y = 1) * (count_if(y = 1) + 1) / 2.0)
               / (count_if(y = 1) * count_if(y <> 1)) AS a FROM rk)
SELECT {sround('sum(tp) / sum(sup)')} AS Accuracy, {sround('sum(pr * sup) / sum(sup)')} AS Precision,
       {sround('sum(rc * sup) / sum(sup)')} AS Recall,
       {sround('sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * sup) / sum(sup)')} AS F1,
       {sround('any_value(a)')} AS "ROC-AUC" FROM pc, auc"""


@register("classification_metrics", sql=_binary_sql())
def classification_metrics(spark, sf):
    return rounded(M.classification_metrics(quality_predictions(spark, sf), scores="score"), METRIC_DIGITS)


# ---------------------------------------------------------------- EV-11, multi-class one-vs-rest
# return flag predicted from the discount band; one score column per class

RF_SCORES = {"A": "l_tax", "N": "l_quantity", "R": "l_discount"}


def flag_predictions(spark, sf):
    li = T(spark, sf, "lineitem")
    pred = (F.when(F.col("l_discount") < 0.03, "A").when(F.col("l_discount") < 0.07, "N").otherwise("R"))
    return li.select(F.col("l_returnflag").alias("label"), pred.alias("prediction"),
                     *[F.col(c).alias(f"s_{k}") for k, c in RF_SCORES.items()])


def _multi_sql():
    aucs = []
    for k, c in RF_SCORES.items():
        aucs.append(f"""(SELECT (sum(CASE WHEN pos THEN r END) - count_if(pos) * (count_if(pos) + 1) / 2.0)
   / (count_if(pos) * count_if(NOT pos)) FROM (SELECT l_returnflag = '{k}' AS pos,
   rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r FROM lineitem))""")
    return f"""
WITH d AS (SELECT l_returnflag AS y, CASE WHEN l_discount < 0.03 THEN 'A' WHEN l_discount < 0.07 THEN 'N'
                  ELSE 'R' END AS p FROM lineitem),
cls AS (SELECT c, count_if(y = c AND p = c) AS tp, count_if(y = c) AS sup, count_if(p = c) AS prd
        FROM d, (SELECT DISTINCT y AS c FROM d UNION SELECT DISTINCT p FROM d) GROUP BY c),
pc AS (SELECT *, CASE WHEN prd > 0 THEN tp / prd ELSE 0 END AS pr, CASE WHEN sup > 0 THEN tp / sup ELSE 0 END AS rc
       FROM cls)
SELECT {sround('sum(tp) / sum(sup)')} AS Accuracy, {sround('sum(pr * sup) / sum(sup)')} AS Precision,
       {sround('sum(rc * sup) / sum(sup)')} AS Recall,
       {sround('sum(CASE WHEN pr + rc > 0 THEN 2 * pr * rc / (pr + rc) ELSE 0 END * sup) / sum(sup)')} AS F1,
       {sround('(' + ' + '.join(aucs) + f') / {len(aucs)}')} AS "ROC-AUC" FROM pc"""


@register("multiclass_metrics", sql=_multi_sql())
def multiclass_metrics(spark, sf):
    df = flag_predictions(spark, sf)
    return rounded(M.classification_metrics(df, scores={k: f"s_{k}" for k in RF_SCORES}), METRIC_DIGITS)


@register("roc_auc", sql="""
SELECT CAST(s AS DOUBLE) AS score, CAST(count_if(y = 1) AS BIGINT) AS npos, CAST(count_if(y <> 1) AS BIGINT) AS nneg,
       CAST(coalesce(sum(count_if(y <> 1)) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            AS BIGINT) AS nneg_before
FROM (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)) GROUP BY s""")
def roc_auc_levels(spark, sf):
    """The score-level table behind EV-11 (distributed prefix sums)."""
    d = quality_predictions(spark, sf)
    lv = (d.groupBy(F.col("score").alias("s")).agg(F.count_if(F.col("label") == 1).alias("npos"),
                                                     F.count_if(F.col("label") != 1).alias("nneg")))
    pre = M.prefix_counts(lv, "s", ["nneg"])
    return pre.select(F.col("s").alias("score"), "npos", "nneg", F.col("nneg_before").cast("bigint"))


@register("auc_continuous", sql=f"""
WITH r AS (SELECT o_orderpriority = '1-URGENT' AS pos, rank() OVER (ORDER BY o_totalprice)
                  + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 AS r FROM orders)
SELECT {sround("(sum(CASE WHEN pos THEN r END) - count_if(pos) * (count_if(pos) + 1) / 2.0) / (count_if(pos) * count_if(NOT pos))")} AS auc
FROM r""")
def auc_continuous(spark, sf):
    """EV-11 with about as many score levels as rows."""
    o = T(spark, sf, "orders").select((F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"), "o_totalprice")
    return rounded(spark.createDataFrame([(M.roc_auc(o, "label", "o_totalprice"),)], "auc double"), {"auc": 6})


# ---------------------------------------------------------------- MR-8, MC-5 on embeddings

EMB_SPLIT_SQL = "((('0x' || substr(md5('42|' || CAST(vec_id AS VARCHAR)), 1, 8))::UBIGINT) / 4294967296.0 < 0.2)"


def embedding_split(spark, sf):
    e = T(spark, sf, "embeddings").withColumn("is_test", split_hash(["vec_id"], 42) < F.lit(0.2))
    return e.where("is_test").drop("is_test"), e.where("NOT is_test").drop("is_test")


def _knn_sql(k, agg):
    return f"""
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label, {EMB_SPLIT_SQL} AS is_test FROM embeddings),
d AS (SELECT t.vec_id AS test_id, r.vec_id AS train_id, CAST(r.label AS DOUBLE) AS label,
             list_distance(t.x, r.x) AS dist
      FROM (SELECT * FROM e WHERE is_test) t, (SELECT * FROM e WHERE NOT is_test) r),
nn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY dist, train_id) AS rn FROM d)
       WHERE rn <= {k})
{agg}"""


@register("knn_classify", sql=_knn_sql(5, """
SELECT test_id, label AS prediction FROM (
  SELECT test_id, label, row_number() OVER (PARTITION BY test_id ORDER BY count(*) DESC, label ASC) AS r
  FROM nn GROUP BY test_id, label) WHERE r = 1"""))
def knn_classify(spark, sf):
    test, train = embedding_split(spark, sf)
    return K.knn_classify(test, train, 5, "embedding", "vec_id", "label")


@register("knn_regress", sql=_knn_sql(5, f"""
SELECT test_id, {sround('sum(label / dist) / sum(1.0 / dist)')} AS prediction FROM nn GROUP BY test_id"""))
def knn_regress(spark, sf):
    test, train = embedding_split(spark, sf)
    return rounded(K.knn_regress(test, train, 5, "embedding", "vec_id", "label", weights="distance"),
                   {"prediction": 6})


@register("knn_neighbors", sql=_knn_sql(5, f"""
SELECT test_id, train_id, CAST(rn AS INTEGER) AS rank, {sround('dist', 6)} AS dist FROM nn"""))
def knn_neighbors(spark, sf):
    test, train = embedding_split(spark, sf)
    c = K.knn_candidates(test, train, 5, "embedding", "vec_id", "label")
    return rounded(c.select("test_id", "train_id", "rank", "dist"), {"dist": 6})
