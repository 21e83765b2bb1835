"""PIP-1/2, SEL, HPO, EV, SCO-1, IO-9..11: the whole training workflow.

``fit(df, target)`` profiles the raw table, fits the feature plan, ranks the
task's models, tunes the best one, evaluates it on the test part and returns
a ``FittedWorkflow`` that scores batch or streaming DataFrames.
"""

from __future__ import annotations

import json
import logging

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import analyze
from ..operators.encode import decode_label
from ..operators.metrics import classification_metrics, regression_metrics
from ..operators.models import KnnModel
from ..operators.profile import q
from ..operators.tune import leaderboard, tune
from ..session import ensure_checkpoint_dir
from ..sources.reports import write_evaluation, write_inputs, write_report
from .feature_plan import FeaturePlan, fit_plan, plan_summary

log = logging.getLogger(__name__)


class FittedWorkflow:
    def __init__(self, plan: FeaturePlan, model, model_name: str, params: dict, cv_score,
                 report: dict | None = None, board: DataFrame | None = None, metrics: DataFrame | None = None,
                 trials: DataFrame | None = None):
        self.plan, self.model, self.model_name, self.params = plan, model, model_name, params
        self.cv_score, self.report, self.board, self.metrics, self.trials = cv_score, report, board, metrics, trials

    # SCO-1
    def predict(self, df: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
        """Raw rows -> ``prediction`` (decoded for classification), with the
        ``keep`` columns (keys) and ``label`` when the target is present."""
        # a kept column that is also an input rides along as a copy
        own = {c: f"__kept{i}" for i, c in enumerate(keep) if c in df.columns and c in (*self.plan.inputs, self.plan.target)}
        feats = self.plan.transform(df.withColumns({n: F.col(q(c)) for c, n in own.items()}) if own else df, keep=[own.get(c, c) for c in keep])
        if "row_id" not in feats.columns:
            feats = feats.withColumn("row_id", F.monotonically_increasing_id())
            if isinstance(self.model, KnnModel):   # joins on the id: it must not be computed twice
                ensure_checkpoint_dir(df.sparkSession)
                feats = feats.checkpoint()
        out = self.model.transform(feats)
        kept = [F.col(q(own.get(c, c))).alias(c) for c in keep if own.get(c, c) in out.columns]
        pred = out.select(*kept, *(["label"] if "label" in out.columns else []), F.col("prediction").cast("double").alias("prediction"))
        if self.plan.classes is not None:
            pred = decode_label(pred, "prediction", self.plan.classes)
            if "label" in pred.columns:
                pred = decode_label(pred, "label", self.plan.classes)
        return pred

    # IO-10
    def save(self, path: str) -> None:
        self.plan.save(f"{path}/plan")
        meta = {"model_name": self.model_name, "params": self.params, "cv_score": self.cv_score,
                "task": self.plan.task}
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite") \
            .text(f"{path}/meta")
        save_model(self.model, f"{path}/model")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FittedWorkflow":
        plan = FeaturePlan.load(spark, f"{path}/plan")
        meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
        model = load_model(spark, f"{path}/model", meta["task"], meta["model_name"])
        return FittedWorkflow(plan, model, meta["model_name"], meta["params"], meta["cv_score"])


# ---------------------------------------------------------------------- persistence of models

def save_model(model, path: str) -> None:
    """IO-11: MLlib models through their writers; KNN keeps its training
    table as parquet; random-Fourier models keep W, b next to the linear model;
    the trees of softmax boosting are JSON, those of deep trees and forests a table."""
    from ..operators.boosting import SoftmaxModel
    from ..operators.deep_tree import DeepTreeModel
    from ..operators.forest import ForestModel
    from ..operators.models import RffModel
    spark = SparkSession.getActiveSession()
    if isinstance(model, KnnModel):
        model.train.write.mode("overwrite").parquet(f"{path}/train")
        spark.createDataFrame([(json.dumps({"k": model.est.k, "weights": model.est.weights, "p": model.est.p,
                                            "task": model.est.task, "n_classes": model.est.n_classes}),)], "m string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/knn")
    elif isinstance(model, RffModel):
        r = model.rff
        spark.createDataFrame([(json.dumps({"W": r.W.tolist(), "b": r.b.tolist(), "scale": r.scale,
                                            "cls": type(model.model).__name__}),)], "m string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/rff")
        model.model.write().overwrite().save(f"{path}/inner")
    elif isinstance(model, SoftmaxModel):
        model.save(f"{path}/boosting")
    elif isinstance(model, DeepTreeModel):
        model.save(f"{path}/deep_tree")
    elif isinstance(model, ForestModel):
        model.save(f"{path}/forest")
    else:
        model.write().overwrite().save(f"{path}/mllib")
        spark.createDataFrame([(type(model).__module__ + "." + type(model).__name__,)], "m string") \
            .coalesce(1).write.mode("overwrite").text(f"{path}/class")


def _load_mllib(spark, path):
    import importlib
    name = spark.read.text(f"{path}/class").first()[0]
    mod, cls = name.rsplit(".", 1)
    return getattr(importlib.import_module(mod), cls).load(f"{path}/mllib")


def load_model(spark: SparkSession, path: str, task: str, name: str):
    import numpy as np

    from ..operators.boosting import SoftmaxModel
    from ..operators.deep_tree import DeepTreeModel
    from ..operators.forest import ForestModel
    from ..operators.models import KnnEstimator, RandomFourier, RffModel
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    hfs = fs.getFileSystem(spark._jsc.hadoopConfiguration())
    if hfs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/knn")):
        m = json.loads(spark.read.text(f"{path}/knn").first()[0])
        km = KnnModel.__new__(KnnModel)
        km.est = KnnEstimator(m["task"], m["k"], m["weights"], m["p"], m["n_classes"])
        km.train = spark.read.parquet(f"{path}/train")
        return km
    if hfs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/rff")):
        m = json.loads(spark.read.text(f"{path}/rff").first()[0])
        rff = RandomFourier.__new__(RandomFourier)
        rff.W, rff.b, rff.scale = np.array(m["W"]), np.array(m["b"]), m["scale"]
        import pyspark.ml.classification as C
        import pyspark.ml.regression as R
        cls = getattr(C, m["cls"], None) or getattr(R, m["cls"])
        return RffModel(rff, cls.load(f"{path}/inner"))
    if hfs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/boosting")):
        return SoftmaxModel.load(spark, f"{path}/boosting")
    if hfs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/deep_tree")):
        return DeepTreeModel.load(spark, f"{path}/deep_tree")
    if hfs.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/forest")):
        return ForestModel.load(spark, f"{path}/forest")
    return _load_mllib(spark, path)


# ---------------------------------------------------------------------- evaluation

def evaluate(wf_model, test: DataFrame, task: str) -> DataFrame:
    """EV on the test part; ROC-AUC from the model's probabilities when it
    has them (positive class for 2 classes, one-vs-rest otherwise)."""
    out = wf_model.transform(test)
    pred = out.withColumn("prediction", F.col("prediction").cast("double"))
    if task == "Regression":
        return regression_metrics(pred)
    scores = None
    if "probability" in out.columns:
        k = out.select(F.size(vector_to_array("probability")).alias("k")).first()["k"]
        arr = vector_to_array("probability")
        pred = pred.select("label", "prediction", *[arr[i].alias(f"p{i}") for i in range(k)])
        scores = "p1" if k == 2 else {float(i): f"p{i}" for i in range(k)}
    return classification_metrics(pred, scores=scores)


def fit(df: DataFrame, target: str, n_trials: int = 10, folds: int = 5, seed: int = 42,
        models: list[str] | None = None, with_report: bool = True, parallelism: int = 4,
        sink: str | None = None) -> FittedWorkflow:
    """PIP-1: the whole workflow as Spark jobs. With ``sink`` the report, the
    evaluation and the scoring input contract are written below that path (IO-6..8)."""
    report = analyze.report(df, target) if with_report else None
    plan, train, test = fit_plan(df, target, seed=seed)
    board = leaderboard(train, test, plan.task, models, parallelism, seed)
    best = board.where("best").first()
    if best is None:
        raise RuntimeError("no model could be fitted")
    cv, params, model, trials = tune(train, plan.task, best["model"], n_trials, folds, seed, parallelism)
    metrics = evaluate(model, test, plan.task).checkpoint()    # one row; evaluated here, whoever reads it
    if sink:
        if report:
            write_report(report, f"{sink}/report")
        write_evaluation(metrics, sink)
        write_inputs(df.sparkSession, plan.inputs, sink)
    return FittedWorkflow(plan, model, best["model"], params, cv, report, board, metrics, trials)


def summary(spark, wf: FittedWorkflow) -> DataFrame:
    """PIP-2: training summary row."""
    return plan_summary(spark, wf.plan).withColumn("model", F.lit(wf.model_name)) \
        .withColumn("params", F.lit(json.dumps(wf.params))).withColumn("cv_score", F.lit(wf.cv_score))
