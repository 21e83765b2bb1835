"""MR-1..10, MC-1..7, HPO-3: the model registry on MLlib.

Every entry builds an estimator with ``fit(df) -> model`` and
``model.transform(df)`` adding a double ``prediction`` (and ``probability``
where the model has one) from a ``features`` vector and a ``label`` column.
Regularisation is converted so that the MLlib objective equals the
reference's (see the survey notes per model).
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from typing import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import (DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression,
                                       OneVsRest, RandomForestClassifier)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import (DecisionTreeRegressor, GBTRegressor, LinearRegression,
                                   RandomForestRegressor)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import SoftmaxBoosting
from .deep_tree import LOCAL, DeepTree
from .forest import Forest
from .gradient import TubeRegression
from .knn import knn_class_shares, knn_regress
from .moments import MomentEstimator

MAX_DEPTH = 30          # MLlib's limit for tree depth; also used where the reference sets no limit
RFF_COMPONENTS = 100    # default number of random Fourier features (parameter ``components``)


@dataclass
class FitContext:
    n: int                       # training rows
    n_features: int
    y_std_pop: float = 1.0
    y_std_samp: float = 1.0
    x_var: float = 1.0           # variance of all feature values (for gamma='scale')
    n_classes: int = 2
    seed: int = 42


@dataclass
class ModelSpec:
    name: str
    task: str
    build: Callable[[dict, FitContext], object]
    space: Callable[[random.Random], dict]
    defaults: dict = field(default_factory=dict)


def loguniform(r: random.Random, lo: float, hi: float) -> float:
    return math.exp(r.uniform(math.log(lo), math.log(hi)))


def depth(v) -> int:
    return MAX_DEPTH if v is None else min(int(v), MAX_DEPTH)


def leaf_rows(p: dict) -> int:
    """min_samples_leaf, and min_samples_split as the leaf size that a split of
    so few rows would need (MLlib has no rule of its own for splits)."""
    return max(int(p.get("min_samples_leaf", 1)), int(p.get("min_samples_split", 2)) // 2, 1)


def subset(v) -> str:
    """max_features -> featureSubsetStrategy."""
    if v is None:
        return "all"
    if isinstance(v, float):
        return str(v)
    return v


# ---------------------------------------------------------------- wrappers

class KnnEstimator:
    """MR-8 / MC-5 as an estimator over the exact KNN join."""

    def __init__(self, task: str, k: int = 5, weights: str = "uniform", p: int = 2, n_classes: int = 2):
        self.task, self.k, self.weights, self.p, self.n_classes = task, k, weights, p, n_classes

    def fit(self, df: DataFrame):
        return KnnModel(self, df)


class KnnModel:
    def __init__(self, est: KnnEstimator, train: DataFrame):
        self.est = est
        self.train = train.select("row_id", vector_to_array("features").alias("x"), "label")

    def transform(self, df: DataFrame) -> DataFrame:
        test = df.select("row_id", vector_to_array("features").alias("x"))
        e = self.est
        if e.task == "Regression":
            pred = knn_regress(test, self.train, e.k, "x", "row_id", "label", e.p, e.weights)
        else:
            pred = knn_class_shares(test, self.train, e.n_classes, e.k, "x", "row_id", "label", e.p, e.weights)
            pred = pred.select("test_id", "prediction", array_to_vector("shares").alias("probability"))
        return df.join(pred.withColumnRenamed("test_id", "row_id"), "row_id", "left")


class RandomFourier:
    """Random Fourier features ``sqrt(2/D) cos(W x + b)`` of an RBF kernel
    with ``exp(-gamma ||x-y||^2)``; W, b drawn from a seeded generator
    (d x D numbers on the driver)."""

    def __init__(self, n_features: int, gamma: float, components: int = RFF_COMPONENTS, seed: int = 42):
        rng = np.random.default_rng(seed)
        self.W = rng.normal(0.0, math.sqrt(2 * gamma), size=(components, n_features))
        self.b = rng.uniform(0, 2 * math.pi, size=components)
        self.scale = math.sqrt(2.0 / components)

    def apply(self, df: DataFrame) -> DataFrame:
        W, b, scale = self.W, self.b, self.scale

        @F.pandas_udf("array<double>")
        def project(x: pd.Series) -> pd.Series:   # one matrix product per Arrow batch
            if not len(x):
                return pd.Series([], dtype=object)
            return pd.Series(list(scale * np.cos(np.stack(x.to_numpy()) @ W.T + b)))

        return df.withColumn("features", array_to_vector(project(vector_to_array("features"))))


class RffEstimator:
    """MR-9 / MC-6 re-aim: a linear model on random Fourier features."""

    def __init__(self, inner, n_features: int, gamma: float, seed: int = 42, components: int = RFF_COMPONENTS):
        self.inner, self.rff = inner, RandomFourier(n_features, gamma, components, seed)

    def fit(self, df: DataFrame):
        return RffModel(self.rff, self.inner.fit(self.rff.apply(df)))


class RffModel:
    def __init__(self, rff, model):
        self.rff, self.model = rff, model

    def transform(self, df: DataFrame) -> DataFrame:
        orig = df.withColumnRenamed("features", "__orig")
        out = self.model.transform(self.rff.apply(orig.withColumn("features", F.col("__orig"))))
        return out.drop("features").withColumnRenamed("__orig", "features")


def gamma_of(p: dict, ctx: FitContext) -> float:
    g = p.get("gamma", "scale")
    if g == "scale":
        return 1.0 / (ctx.n_features * ctx.x_var) if ctx.x_var > 0 else 1.0
    if g == "auto":
        return 1.0 / ctx.n_features
    return float(g)


# ---------------------------------------------------------------- regression builders

def _lr(p, ctx):
    if p.get("positive"):   # MLlib has no bound on coefficients
        return MomentEstimator("LR", p)
    return LinearRegression(regParam=0.0, fitIntercept=p.get("fit_intercept", True), solver="normal",
                            standardization=False)


def _lasso(p, ctx):
    return LinearRegression(elasticNetParam=1.0, regParam=p.get("alpha", 1.0), standardization=False,
                            maxIter=int(p.get("max_iter", 1000)), tol=1e-6)


def _ridge(p, ctx):
    # Spark divides regParam by the label std; this makes the objectives equal
    return LinearRegression(elasticNetParam=0.0, solver="normal", standardization=False,
                            regParam=p.get("alpha", 1.0) * ctx.y_std_pop / ctx.n)


def _enet(p, ctx):
    a, r = p.get("alpha", 1.0), p.get("l1_ratio", 0.5)
    l1, l2 = a * r, a * (1 - r) * ctx.y_std_samp
    return LinearRegression(regParam=l1 + l2, elasticNetParam=(l1 / (l1 + l2)) if l1 + l2 else 0.0,
                            standardization=False, solver="l-bfgs",
                            maxIter=int(p.get("max_iter", 1000)))


def _rf_reg(p, ctx):
    return RandomForestRegressor(numTrees=int(p.get("n_estimators", 100)), maxDepth=depth(p.get("max_depth")),
                                 minInstancesPerNode=leaf_rows(p),
                                 featureSubsetStrategy=subset(p.get("max_features")),
                                 bootstrap=bool(p.get("bootstrap", True)), seed=ctx.seed)


def _bag_reg(p, ctx):
    return RandomForestRegressor(numTrees=int(p.get("n_estimators", 10)), maxDepth=depth(None),
                                 featureSubsetStrategy=subset(p.get("max_features")),
                                 subsamplingRate=float(p.get("max_samples", 1.0)),
                                 bootstrap=bool(p.get("bootstrap", True)), seed=ctx.seed)


def _gb_reg(p, ctx):
    return GBTRegressor(maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                        maxDepth=depth(p.get("max_depth", 3)), minInstancesPerNode=leaf_rows(p),
                        subsamplingRate=float(p.get("subsample", 1.0)), seed=ctx.seed)


def _knr(p, ctx):
    return KnnEstimator("Regression", int(p.get("n_neighbors", 5)), p.get("weights", "uniform"), int(p.get("p", 2)))


def _svr(p, ctx):
    inner = TubeRegression(float(p.get("C", 1.0)), float(p.get("epsilon", 0.1)))   # MLlib has no epsilon-insensitive loss
    if p.get("kernel", "rbf") == "linear":
        return inner
    return RffEstimator(inner, ctx.n_features, gamma_of(p, ctx), ctx.seed, int(p.get("components", RFF_COMPONENTS)))


def _dt_reg(p, ctx):
    return RandomForestRegressor(numTrees=1, bootstrap=False, maxDepth=depth(p.get("max_depth")),
                                 minInstancesPerNode=leaf_rows(p), featureSubsetStrategy=subset(p.get("max_features")),
                                 seed=ctx.seed) if p.get("max_features") else \
        DecisionTreeRegressor(maxDepth=depth(p.get("max_depth")), minInstancesPerNode=leaf_rows(p), seed=ctx.seed)


# ---------------------------------------------------------------- classification builders

def _logit(p, ctx):
    return LogisticRegression(regParam=1.0 / (float(p.get("C", 1.0)) * ctx.n), elasticNetParam=0.0,
                              standardization=False, maxIter=int(p.get("max_iter", 100)))


def _rf_cls(p, ctx):
    trees = int(p.get("n_estimators", 100))
    if ctx.n * trees > LOCAL:
        return Forest(ctx.n_classes, trees, depth(p.get("max_depth")), leaf_rows(p), subset(p.get("max_features", "sqrt")),
                      bool(p.get("bootstrap", True)), seed=ctx.seed)
    return RandomForestClassifier(numTrees=int(p.get("n_estimators", 100)), maxDepth=depth(p.get("max_depth")),
                                  minInstancesPerNode=leaf_rows(p),
                                  featureSubsetStrategy=subset(p.get("max_features", "sqrt")),
                                  bootstrap=bool(p.get("bootstrap", True)), seed=ctx.seed)


def _bag_cls(p, ctx):
    trees = int(p.get("n_estimators", 10))
    if ctx.n * trees > LOCAL:
        return Forest(ctx.n_classes, trees, depth(None), 1, subset(p.get("max_features")), bool(p.get("bootstrap", True)),
                      float(p.get("max_samples", 1.0)), ctx.seed)
    return RandomForestClassifier(numTrees=int(p.get("n_estimators", 10)), maxDepth=depth(None),
                                  featureSubsetStrategy=subset(p.get("max_features")),
                                  subsamplingRate=float(p.get("max_samples", 1.0)),
                                  bootstrap=bool(p.get("bootstrap", True)), seed=ctx.seed)


def _gb_cls(p, ctx):
    if ctx.n_classes > 2:   # MLlib boosts two classes only
        return SoftmaxBoosting(ctx.n_classes, int(p.get("n_estimators", 100)), float(p.get("learning_rate", 0.1)), depth(p.get("max_depth", 3)),
                               leaf_rows(p), float(p.get("subsample", 1.0)), seed=ctx.seed)
    return GBTClassifier(maxIter=int(p.get("n_estimators", 100)), stepSize=float(p.get("learning_rate", 0.1)),
                         maxDepth=depth(p.get("max_depth", 3)), minInstancesPerNode=leaf_rows(p),
                         subsamplingRate=float(p.get("subsample", 1.0)), seed=ctx.seed)


def _knc(p, ctx):
    return KnnEstimator("Classification", int(p.get("n_neighbors", 5)), p.get("weights", "uniform"),
                        int(p.get("p", 2)), ctx.n_classes)


def _svc(p, ctx):
    svm = LinearSVC(regParam=1.0 / (float(p.get("C", 1.0)) * ctx.n), standardization=False)
    inner = svm if ctx.n_classes <= 2 else OneVsRest(classifier=svm, parallelism=min(ctx.n_classes, 8))
    if p.get("kernel", "rbf") == "linear":
        return inner
    return RffEstimator(inner, ctx.n_features, gamma_of(p, ctx), ctx.seed, int(p.get("components", RFF_COMPONENTS)))


def _dt_cls(p, ctx):
    impurity = "gini" if p.get("criterion", "gini") == "gini" else "entropy"   # log_loss is entropy
    if ctx.n > LOCAL:       # MLlib's passes grow with the number of nodes
        return DeepTree(ctx.n_classes, depth(p.get("max_depth")), leaf_rows(p), impurity, p.get("max_features"), ctx.seed)
    if p.get("max_features"):
        return RandomForestClassifier(numTrees=1, bootstrap=False, maxDepth=depth(p.get("max_depth")), impurity=impurity,
                                      minInstancesPerNode=leaf_rows(p), featureSubsetStrategy=subset(p.get("max_features")),
                                      seed=ctx.seed)
    return DecisionTreeClassifier(maxDepth=depth(p.get("max_depth")), impurity=impurity, minInstancesPerNode=leaf_rows(p),
                                  seed=ctx.seed)


# ---------------------------------------------------------------- HPO-3 search spaces

def _choice(r, xs):
    return xs[r.randrange(len(xs))]


# Model short names, parameter names and search ranges of the reference.
SPACES = {
    ("Regression", "LR"): lambda r: {"fit_intercept": _choice(r, [True, False]), "positive": _choice(r, [True, False])},
    ("Regression", "L1"): lambda r: {"alpha": loguniform(r, 1e-6, 10), "max_iter": r.randint(1000, 10000),
                                     "selection": _choice(r, ["cyclic", "random"])},
    ("Regression", "L2"): lambda r: {"alpha": loguniform(r, 1e-6, 100)},
    ("Regression", "EN"): lambda r: {"alpha": loguniform(r, 1e-6, 10), "l1_ratio": r.uniform(0, 1),
                                     "max_iter": r.randint(1000, 10000),
                                     "selection": _choice(r, ["cyclic", "random"])},
    ("Regression", "RF"): lambda r: {"n_estimators": r.randint(50, 1000), "max_depth": r.randint(3, 50),
                                     "min_samples_split": r.randint(2, 20), "min_samples_leaf": r.randint(1, 20),
                                     "max_features": _choice(r, ["sqrt", "log2", None]),
                                     "bootstrap": _choice(r, [True, False])},
    ("Regression", "BR"): lambda r: {"n_estimators": r.randint(10, 300), "max_samples": r.uniform(0.5, 1.0),
                                     "max_features": r.uniform(0.5, 1.0), "bootstrap": _choice(r, [True, False])},
    ("Regression", "GB"): lambda r: {"n_estimators": r.randint(100, 1000), "learning_rate": loguniform(r, 1e-3, 0.3),
                                     "max_depth": r.randint(3, 10), "min_samples_split": r.randint(2, 20), "min_samples_leaf": r.randint(1, 20),
                                     "subsample": r.uniform(0.5, 1.0)},
    ("Regression", "KNR"): lambda r: {"n_neighbors": r.randint(2, 50), "weights": _choice(r, ["uniform", "distance"]),
                                      "p": r.randint(1, 2)},
    ("Regression", "SVR"): lambda r: {"C": loguniform(r, 1e-3, 100), "epsilon": loguniform(r, 1e-4, 1),
                                      "kernel": _choice(r, ["rbf", "linear"]), "gamma": _choice(r, ["scale", "auto"])},
    ("Regression", "DT"): lambda r: {"max_depth": r.randint(2, 50), "min_samples_split": r.randint(2, 20),
                                     "min_samples_leaf": r.randint(1, 20),
                                     "max_features": _choice(r, ["sqrt", "log2", None])},
    ("Classification", "LR"): lambda r: {"C": loguniform(r, 1e-4, 100), "max_iter": r.randint(100, 2000)},
    ("Classification", "RF"): lambda r: {"n_estimators": r.randint(100, 1000), "max_depth": r.randint(3, 50),
                                         "min_samples_split": r.randint(2, 20), "min_samples_leaf": r.randint(1, 20),
                                         "max_features": _choice(r, ["sqrt", "log2", None]),
                                         "bootstrap": _choice(r, [True, False])},
    ("Classification", "BC"): lambda r: {"n_estimators": r.randint(10, 300), "max_samples": r.uniform(0.5, 1.0),
                                         "max_features": r.uniform(0.5, 1.0), "bootstrap": _choice(r, [True, False])},
    ("Classification", "GB"): lambda r: {"n_estimators": r.randint(100, 1000),
                                         "learning_rate": loguniform(r, 1e-3, 0.3), "max_depth": r.randint(3, 10),
                                         "min_samples_split": r.randint(2, 20), "min_samples_leaf": r.randint(1, 20), "subsample": r.uniform(0.5, 1.0)},
    ("Classification", "KNC"): lambda r: {"n_neighbors": r.randint(2, 50),
                                          "weights": _choice(r, ["uniform", "distance"]), "p": r.randint(1, 2)},
    ("Classification", "SVC"): lambda r: {"C": loguniform(r, 1e-4, 100), "kernel": _choice(r, ["rbf", "linear"]),
                                          "gamma": _choice(r, ["scale", "auto"])},
    ("Classification", "DT"): lambda r: {"max_depth": r.randint(2, 50), "min_samples_split": r.randint(2, 20), "min_samples_leaf": r.randint(1, 20),
                                         "max_features": _choice(r, ["sqrt", "log2", None]),
                                         "criterion": _choice(r, ["gini", "entropy"])},
}

BUILDERS = {
    "Regression": {"LR": _lr, "L1": _lasso, "L2": _ridge, "EN": _enet, "RF": _rf_reg, "BR": _bag_reg,
                   "GB": _gb_reg, "KNR": _knr, "SVR": _svr, "DT": _dt_reg},
    "Classification": {"LR": _logit, "RF": _rf_cls, "BC": _bag_cls, "GB": _gb_cls, "KNC": _knc, "SVC": _svc,
                       "DT": _dt_cls},
}


def registry(task: str) -> dict[str, ModelSpec]:
    """Models of a task in the reference's registry order."""
    if task not in BUILDERS:
        raise ValueError(f"unknown task {task}")
    return {n: ModelSpec(n, task, b, SPACES[(task, n)]) for n, b in BUILDERS[task].items()}


def build(task: str, name: str, params: dict, ctx: FitContext):
    specs = registry(task)
    if name not in specs:
        raise ValueError(f"unknown model {name} for {task}")
    return specs[name].build(params or {}, ctx)


def sample_params(task: str, name: str, n_trials: int, seed: int = 42) -> list[dict]:
    """HPO-3: ``n_trials`` seeded random draws from the model's space."""
    r = random.Random(seed)
    return [SPACES[(task, name)](r) for _ in range(n_trials)]
