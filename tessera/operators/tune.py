"""SEL-1/2 (leaderboard and best-model choice) and HPO-1/2 (seeded random
search with k-fold cross-validation).

Linear regression models are scored from shared statistics (``moments``): one pass
over the rows serves all of them, all trials and all folds. Logistic regression takes
its Newton steps for all trials and folds in the same passes. The other models are
fitted fold by fold."""

from __future__ import annotations

import logging
import math
from concurrent.futures import ThreadPoolExecutor

from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import logistic
from . import moments as MM
from .metrics import classification_metrics, prefix_counts, regression_metrics
from .models import FitContext, build, registry, sample_params

log = logging.getLogger(__name__)


def fit_context(train: DataFrame, task: str, seed: int = 42) -> FitContext:
    """The few training-set scalars the estimators' parameter conversions need."""
    k = train.agg(F.count_distinct("label").alias("k")).first()["k"]     # a distinct count would group the other sums by label
    x = vector_to_array("features")
    # variance of all feature values, summed per row
    w = train.select("label", x.alias("x")).select(
        "label", F.aggregate("x", F.lit(0.0), lambda a, v: a + v).alias("s"),
        F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("s2"), F.size("x").alias("d"))
    r = w.agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("label").alias("sp"), F.stddev_samp("label").alias("ss"), F.max("d").alias("most"),
              F.sum("s").alias("s"), F.sum("s2").alias("s2"), F.sum("d").alias("d")).first()
    xv = r["s2"] / r["d"] - (r["s"] / r["d"]) ** 2 if r["d"] else None
    return FitContext(n=r["n"], n_features=r["most"] or 1, y_std_pop=r["sp"] or 1.0, y_std_samp=r["ss"] or 1.0,
                      x_var=xv or 1.0, n_classes=k or 2, seed=seed)


def score(model, test: DataFrame, task: str, metric: str | None = None) -> float | None:
    """R^2 (regression) or weighted F1 / accuracy (classification)."""
    pred = model.transform(test).select("label", F.col("prediction").cast("double").alias("prediction"))
    if task == "Regression":
        return regression_metrics(pred).first()["R2"]
    m = classification_metrics(pred).first()
    return m["Accuracy"] if metric == "accuracy" else m["F1"]


def shared_statistics(task: str, name: str, ctx: FitContext) -> bool:
    """Whether a model is solved from the moments of one pass."""
    return task == "Regression" and name in MM.LINEAR and ctx.n_features <= MM.MAX_FEATURES


def leaderboard(train: DataFrame, test: DataFrame, task: str, models: list[str] | None = None,
                parallelism: int = 4, seed: int = 42) -> DataFrame:
    """SEL-1/2: default-parameter fit of every model of the task, scored on
    the test part; rank 1 = best (strict ``>``: the first in registry order
    wins ties; NaN/None never wins). Fits run as concurrent Spark jobs."""
    spark = train.sparkSession
    ctx = fit_context(train, task, seed)
    names = models or list(registry(task))

    errors: dict[str, str] = {}
    linear = [n for n in names if shared_statistics(task, n, ctx)]
    shared: dict[int, MM.Moments] = {}
    if linear:   # fold 1 is the test part
        both = [d.select("features", "label", F.lit(i).alias("fold")) for i, d in enumerate((train, test))]
        shared = MM.fold_moments(both[0].unionByName(both[1]))

    def run(name):
        try:
            if name in linear:
                if 1 not in shared:   # an empty test part
                    return name, None
                return name, MM.r2(*MM.solve(name, {}, shared[0], seed), shared[1])
            return name, score(build(task, name, {}, ctx).fit(train), test, task)
        except Exception as e:  # noqa: BLE001  (shown in the leaderboard's error column)
            log.warning("model %s failed: %s", name, str(e)[:200])
            errors[name] = str(e)[:500]
            return name, None

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        results = dict(ex.map(run, names))
    best, best_score = None, -math.inf
    for n in names:
        s = results[n]
        if s is not None and not math.isnan(s) and s > best_score:
            best, best_score = n, s
    order = sorted(names, key=lambda n: (-(results[n]) if results[n] is not None and not math.isnan(results[n])
                                         else math.inf, names.index(n)))
    if best is None:
        raise RuntimeError(f"no model could be fitted: {errors}")
    rows = [(n, results[n], i + 1, n == best, errors.get(n)) for i, n in enumerate(order)]
    return spark.createDataFrame(rows, "model string, score double, rank int, best boolean, error string")


def with_folds(df: DataFrame, folds: int = 5, seed: int = 42, task: str = "Regression") -> DataFrame:
    """Fold id from a seeded hash of the row id (which is a hash of the raw
    row). For classification the folds are stratified: the rows of a class are
    ranked in hash order, by distributed prefix sums, and dealt in turn, so that
    the folds of a class differ by one row at most."""
    spread = F.xxhash64(F.col("row_id"), F.lit(seed))
    if task != "Classification":
        return df.withColumn("fold", F.pmod(spread, F.lit(folds)).cast("int"))
    ranked = prefix_counts(df.select("row_id", "label", spread.alias("spread"), F.lit(1).alias("one")), "spread", ["one"], by="label")
    return df.join(ranked.select("row_id", (F.col("one_before") % folds).cast("int").alias("fold")), "row_id")


def cross_val(train: DataFrame, task: str, name: str, params: dict, folds: int = 5, seed: int = 42,
              ctx: FitContext | None = None) -> float:
    """Mean k-fold score: R^2 for regression, accuracy for classification."""
    ctx = ctx or fit_context(train, task, seed)
    vals = []
    for f in range(folds):
        tr, va = train.where(F.col("fold") != f), train.where(F.col("fold") == f)
        s = score(build(task, name, params, ctx).fit(tr), va, task, metric="accuracy")
        vals.append(s if s is not None else float("nan"))
    return sum(vals) / len(vals)


def tune_linear(spark, data: DataFrame, name: str, trials: list[dict], seed: int = 42):
    """``tune`` for the linear models, from the moments of every fold."""
    moments = MM.fold_moments(data)
    scores = [sum(r2 for _, _, r2 in MM.fold_scores(name, p, moments).values()) / max(1, len(moments)) for p in trials]
    good = [i for i, s in enumerate(scores) if not math.isnan(s)]
    if not good or not moments:
        raise RuntimeError(f"every trial of {name} failed: no fold with a varying label")
    best = max(good, key=lambda i: (scores[i], -i))
    model = MM.linear_model(spark, *MM.solve(name, trials[best], MM.merged(moments.values()), seed))
    tdf = spark.createDataFrame([(i, str(p), scores[i], None) for i, p in enumerate(trials)],
                                "trial int, params string, cv_score double, error string")
    return scores[best], trials[best], model, tdf


def tune(train: DataFrame, task: str, name: str, n_trials: int = 10, folds: int = 5, seed: int = 42,
         parallelism: int = 4):
    """HPO-1/2: ``n_trials`` seeded draws, each scored by k-fold CV (trials
    run as concurrent jobs over one persisted training set); the best
    parameters are refitted on the whole training part.
    Linear regression models take one pass over the rows in all (no persisted set,
    no fit per trial), and the final model comes from the same statistics.
    Returns ``(best_score, best_params, model, trials_df)``."""
    spark = train.sparkSession
    ctx = fit_context(train, task, seed)
    if shared_statistics(task, name, ctx):
        return tune_linear(spark, with_folds(train, folds, seed, task), name, sample_params(task, name, n_trials, seed), seed)
    data = with_folds(train, folds, seed, task).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        trials = sample_params(task, name, n_trials, seed)

        errors: dict[int, str] = {}

        if task == "Classification" and name == "LR" and logistic.fits(ctx.n_features, ctx.n_classes, len(trials) * folds):
            together, _ = logistic.cross_validate(data, [float(p.get("C", 1.0)) for p in trials], folds, ctx.n_classes)
        else:
            together = None

        def run(i):
            if together is not None:
                return i, together[i]
            try:
                return i, cross_val(data, task, name, trials[i], folds, seed, ctx)
            except Exception as e:  # noqa: BLE001  (shown in the trial table)
                log.warning("trial %s of %s failed: %s", i, name, str(e)[:200])
                errors[i] = str(e)[:500]
                return i, float("nan")

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
            scores = dict(ex.map(run, range(len(trials))))
        best_i = None
        for i in range(len(trials)):
            s = scores[i]
            if not math.isnan(s) and (best_i is None or s > scores[best_i]):
                best_i = i
        if best_i is None:
            raise RuntimeError(f"every trial of {name} failed: {errors}")
        best_params = trials[best_i]
        model = build(task, name, best_params, ctx).fit(train)
    finally:
        data.unpersist()
    rows = [(i, str(trials[i]), scores[i], errors.get(i)) for i in range(len(trials))]
    tdf = spark.createDataFrame(rows, "trial int, params string, cv_score double, error string")
    return scores[best_i], best_params, model, tdf
