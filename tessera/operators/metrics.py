"""EV-1..11: regression and classification metrics as aggregates.

No metric pulls rows to the driver: regression metrics are one aggregate;
classification metrics go through the (label, prediction) confusion table
(k^2 rows); ROC-AUC uses score-level counts and a distributed prefix sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .profile import q

EPS = 2.220446049250313e-16     # float64 machine epsilon (MAPE denominator floor)


def regression_metrics(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """EV-1..6: MAE, MSE, RMSE, R2, MAPE, EVS in one aggregate."""
    y, p = F.col(q(label)).cast("double"), F.col(q(pred)).cast("double")
    e = y - p
    base = df.agg(F.avg(F.abs(e)).alias("MAE"), F.avg(e * e).alias("MSE"),
                  F.var_pop(y).alias("vy"), F.var_pop(e).alias("ve"),
                  F.avg(F.abs(e) / F.greatest(F.abs(y), F.lit(EPS))).alias("MAPE"))
    return base.select("MAE", "MSE", F.sqrt("MSE").alias("RMSE"),
                       (1 - F.try_divide(F.col("MSE"), F.col("vy"))).alias("R2"), "MAPE",
                       (1 - F.try_divide(F.col("ve"), F.col("vy"))).alias("EVS"))


def confusion(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """``(label, prediction, cnt)``: k^2 rows at most."""
    return df.groupBy(F.col(q(label)).alias("y"), F.col(q(pred)).alias("p")).agg(F.count(F.lit(1)).alias("cnt"))


def per_class(df: DataFrame, label: str = "label", pred: str = "prediction") -> DataFrame:
    """``(cls, tp, support, predicted)`` for every class seen in either column;
    the source is read once."""
    cm = confusion(df, label, pred)
    zero = F.lit(0).cast("bigint")
    hit = F.when(F.col("y") == F.col("p"), F.col("cnt")).otherwise(zero)
    sides = F.array(F.struct(F.col("y").alias("cls"), hit.alias("tp"), F.col("cnt").alias("support"), zero.alias("predicted")),
                    F.struct(F.col("p").alias("cls"), zero.alias("tp"), zero.alias("support"), F.col("cnt").alias("predicted")))
    return (cm.select(F.explode(sides).alias("s")).where("s.cls IS NOT NULL").groupBy(F.col("s.cls").alias("cls"))
            .agg(*[F.sum(f"s.{c}").alias(c) for c in ("tp", "support", "predicted")]))


def classification_metrics(df: DataFrame, label: str = "label", pred: str = "prediction",
                           scores: dict | str | None = None) -> DataFrame:
    """EV-7..11: accuracy, support-weighted precision / recall / F1 (a class
    never predicted has precision 0), and ROC-AUC when scores are given."""
    pc = per_class(df, label, pred)
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(F.lit(0.0))
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(prec + rec > 0, 2 * prec * rec / (prec + rec)).otherwise(F.lit(0.0))
    n = F.sum("support")
    m = pc.agg((F.sum("tp") / n).alias("Accuracy"),
               (F.sum(prec * F.col("support")) / n).alias("Precision"),
               (F.sum(rec * F.col("support")) / n).alias("Recall"),
               (F.sum(f1 * F.col("support")) / n).alias("F1"))
    auc = roc_auc(df, label, scores) if scores is not None else None
    return m.withColumn("ROC-AUC", F.lit(auc).cast("double"))


def prefix_counts(freq: DataFrame, order_col: str, value_cols: list[str], partitions: int | None = None,
                  by: str | None = None) -> DataFrame:
    """Running sums of ``value_cols`` over ``order_col`` (per ``by``) without a
    global single-partition window. The table is range-partitioned and kept in
    the checkpoint folder, because range bounds come from a sample and must not
    differ between the two reads; each partition is totalled, the totals (one
    row per partition and ``by``) become offsets, and a window runs inside each
    partition. Adds ``<c>_before`` (strictly smaller keys)."""
    spark = freq.sparkSession
    P = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [by] if by else []
    ensure_checkpoint_dir(spark)
    ranged = freq.repartitionByRange(P, *keys, order_col).withColumn("__pid", F.spark_partition_id()).checkpoint()
    before = Window.partitionBy(*keys).orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranged.groupBy(*keys, "__pid").agg(*[F.sum(c).alias(c) for c in value_cols]).select(
        *keys, "__pid", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__off_{c}") for c in value_cols])
    inside = Window.partitionBy(*keys, "__pid").orderBy(order_col).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(offsets, [*keys, "__pid"])
    for c in value_cols:
        out = out.withColumn(f"{c}_before", F.col(f"__off_{c}") + F.coalesce(F.sum(c).over(inside), F.lit(0)))
    return out.drop("__pid", *[f"__off_{c}" for c in value_cols])


def class_aucs(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """``(cls, auc)`` one-vs-rest for every scored class with both sides present,
    in one pass: Mann-Whitney AUC with tie-averaged ranks, sum over score levels
    of pos * (neg_below + neg_at / 2) / (P * N)."""
    names = list(scores)
    sides = F.array(*[F.struct(F.lit(i).alias("i"), (F.col(q(label)) == F.lit(c)).alias("pos"),
                               F.col(q(scores[c])).cast("double").alias("s")) for i, c in enumerate(names)])
    levels = (df.select(F.explode(sides).alias("x")).where("x.s IS NOT NULL AND x.pos IS NOT NULL")
              .groupBy(F.col("x.i").alias("i"), F.col("x.s").alias("s"))
              .agg(F.count_if("x.pos").alias("npos"), F.count_if(~F.col("x.pos")).alias("nneg")))
    pre = prefix_counts(levels, "s", ["nneg"], by="i")
    sums = pre.groupBy("i").agg(F.sum(F.col("npos") * (F.col("nneg_before") + F.col("nneg") / 2.0)).alias("u"),
                                F.sum("npos").alias("P"), F.sum("nneg").alias("N"))
    return sums.where("P > 0 AND N > 0").select("i", (F.col("u") / F.col("P") / F.col("N")).alias("auc"))


def roc_auc(df: DataFrame, label: str, scores: dict | str) -> float | None:
    """EV-11: binary -> AUC of the positive-class score; more classes ->
    one-vs-rest macro mean over the classes present in ``label``.
    ``scores`` is one column name (binary, positive class = 1) or
    ``{class_value: score_column}``."""
    if isinstance(scores, str):
        scores = {1: scores}
    elif len(scores) <= 2:
        last = sorted(scores)[-1]
        scores = {last: scores[last]}
    got = class_aucs(df, label, scores).agg(F.avg("auc").alias("auc")).first()
    return got["auc"]
