"""MR-1..4 and HPO-1/2 from shared statistics: one pass, any number of trials.

The linear models need of a table only its number of rows, the means and the
scatter matrix of (features, label). One pass sums these per fold; the moments of
a training part are the merged moments of the other folds. Every trial of every
fold is then solved from matrices of (features + 1)² numbers on the driver, and
scored on the held-out fold from that fold's own moments, without predictions.

Moments are kept about their own means and merged by the pairwise rule, so that
large offsets cost no digits. The tasks' matrices are merged by Spark in rounds of
``FAN_IN``; the driver receives a few per fold.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.common import _py2java
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FEATURES = 512   # beyond, a matrix per fold and task is too large; models are fitted one by one
FAN_IN = 64
ROUNDS = 3           # 64^3 tasks become one matrix per fold
LINEAR = ("LR", "L1", "L2", "EN")
SCHEMA = "fold int, part int, n double, mean binary, scatter binary"


@dataclass
class Moments:
    """Rows, means and scatter (sums of products about the means) of the columns
    x_1 .. x_d, y."""

    n: float
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Moments:
        mean = z.mean(axis=0)
        c = z - mean
        return Moments(float(len(z)), mean, c.T @ c)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        return Moments(n, self.mean + gap * (other.n / n), self.scatter + other.scatter + np.outer(gap, gap) * (self.n * other.n / n))

    @property
    def d(self) -> int:
        return len(self.mean) - 1

    def about_zero(self) -> Moments:
        """The same sums of products about zero (a fit without an intercept)."""
        return Moments(self.n, np.zeros_like(self.mean), self.scatter + self.n * np.outer(self.mean, self.mean))


def merged(parts: Iterator[Moments] | list[Moments]) -> Moments | None:
    total = None
    for m in parts:
        total = m if total is None else total + m
    return total


def _row(fold: int, part: int, m: Moments) -> tuple:
    return fold, part, m.n, m.mean.tobytes(), m.scatter.tobytes()


def _read(n: float, mean: bytes, scatter: bytes) -> Moments:
    mu = np.frombuffer(mean)
    return Moments(n, mu, np.frombuffer(scatter).reshape(len(mu), len(mu)))


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
    cols = list(zip(*rows)) if rows else [[]] * 5
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["fold", "part", "n", "mean", "scatter"])


def fold_moments(df: DataFrame, fold_col: str = "fold", features_col: str = "features", label_col: str = "label") -> dict[int, Moments]:
    """Moments per fold of a table of feature vectors and labels, in one pass."""
    rows = df.select(F.col(fold_col).cast("int").alias("fold"), vector_to_array(features_col).alias("x"),
                     F.col(label_col).cast("double").alias("y"))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, Moments] = {}
        for b in batches:
            if not b.num_rows:
                continue
            fold, y = b.column(0).to_numpy(), b.column(2).to_numpy()
            z = np.column_stack([b.column(1).flatten().to_numpy().reshape(len(y), -1), y])
            for f in np.unique(fold).tolist():
                own = Moments.of(z[fold == f])
                found[f] = found[f] + own if f in found else own
        part = TaskContext.get().partitionId()
        yield from _table([_row(f, part, m) for f, m in found.items()]).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        fold, part = table.column("fold")[0].as_py(), table.column("part")[0].as_py()
        total = merged(_read(n.as_py(), mean.as_py(), scatter.as_py())
                       for n, mean, scatter in zip(table.column("n"), table.column("mean"), table.column("scatter")))
        return _table([_row(fold, part // FAN_IN, total)])

    out = rows.mapInArrow(sums, SCHEMA)
    for _ in range(ROUNDS):
        out = out.groupBy("fold", F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, SCHEMA)
    found: dict[int, Moments] = {}
    for r in sorted(out.collect(), key=lambda r: (r["fold"], r["part"])):
        m = _read(r["n"], bytes(r["mean"]), bytes(r["scatter"]))
        found[r["fold"]] = found[r["fold"]] + m if r["fold"] in found else m
    return found


# ---------------------------------------------------------------- solvers

def least_squares(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Solution of a b = c of least norm (one-hot columns are collinear)."""
    if not len(c):
        return c
    scale = np.sqrt(np.maximum(np.diag(a), 0))
    scale[scale == 0] = 1.0
    value, vector = np.linalg.eigh(a / np.outer(scale, scale))
    keep = value > value.max(initial=0) * len(c) * 1e-13
    return vector[:, keep] @ ((vector[:, keep].T @ (c / scale)) / value[keep]) / scale


def non_negative(a: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Least squares with b >= 0 by the active set method: a column enters while
    the fit gains by it, and leaves when its coefficient would fall below zero."""
    d = len(c)
    b, free = np.zeros(d), np.zeros(d, dtype=bool)
    size = np.sqrt(np.maximum(np.diag(a), 0))
    tol = 1e-10 * np.where(size > 0, size, 1) * (np.abs(c / np.where(size > 0, size, 1)).max() if d else 0)
    for _ in range(10 * d + 10):
        slope = c - a @ b
        open_ = np.flatnonzero(~free & (slope > tol) & (size > 0))
        if not len(open_):
            break
        free[open_[np.argmax(slope[open_] / size[open_])]] = True
        while True:
            s = np.zeros(d)
            s[free] = least_squares(a[np.ix_(free, free)], c[free])
            low = free & (s <= 0)
            if not low.any():
                b = s
                break
            with np.errstate(divide="ignore", invalid="ignore"):
                step = np.where(low, b / (b - s), np.inf)
            b = b + np.nanmin(step) * (s - b)
            free &= ~(low & (b <= 1e-15 * np.abs(b).max(initial=0)))
            b[~free] = 0.0
            if not free.any():
                break
    return b


def descent(a: np.ndarray, c: np.ndarray, l1: float, l2: float, max_iter: int = 1000, selection: str = "cyclic",
            seed: int = 42, tol: float = 1e-12) -> np.ndarray:
    """min 1/2 b'a b - c'b + l1 |b| + l2/2 |b|² by coordinate descent."""
    d = len(c)
    b, slope, order = np.zeros(d), c.copy(), list(range(d))   # slope = c - a b
    diag, rng = np.diag(a).copy(), random.Random(seed)
    size = np.sqrt(np.maximum(diag, 0))
    for _ in range(max_iter):
        if selection == "random":
            rng.shuffle(order)
        moved = 0.0
        for j in order:
            if diag[j] <= 0:
                continue
            rho = slope[j] + diag[j] * b[j]
            new = math.copysign(max(abs(rho) - l1, 0.0), rho) / (diag[j] + l2)
            if new != b[j]:
                slope -= a[:, j] * (new - b[j])
                moved = max(moved, abs(new - b[j]) * size[j])
                b[j] = new
        if moved <= tol * max(1.0, float(np.abs(b * size).max(initial=0))):
            break
    return b


def solve(name: str, params: dict, m: Moments, seed: int = 42) -> tuple[np.ndarray, float]:
    """Coefficients and intercept of a linear model from the moments of its
    training rows."""
    d = m.d
    if name == "LR":
        own = m if params.get("fit_intercept", True) else m.about_zero()
        fit = non_negative if params.get("positive", False) else least_squares
        b = fit(own.scatter[:d, :d], own.scatter[:d, d])
        return b, float(own.mean[d] - own.mean[:d] @ b)
    a, c, alpha = m.scatter[:d, :d], m.scatter[:d, d], float(params.get("alpha", 1.0))
    if name == "L2":
        b = np.linalg.solve(a + alpha * np.eye(d), c) if alpha else least_squares(a, c)
    else:
        ratio = 1.0 if name == "L1" else float(params.get("l1_ratio", 0.5))
        b = descent(a / m.n, c / m.n, alpha * ratio, alpha * (1 - ratio), int(params.get("max_iter", 1000)),
                    params.get("selection", "cyclic"), seed)
    return b, float(m.mean[d] - m.mean[:d] @ b)


def r2(b: np.ndarray, intercept: float, m: Moments) -> float:
    """R² of a linear model on the rows behind ``m``."""
    d = m.d
    total = m.scatter[d, d]
    off = m.mean[d] - intercept - m.mean[:d] @ b
    left = total - 2 * b @ m.scatter[:d, d] + b @ m.scatter[:d, :d] @ b + m.n * off * off
    return float(1 - left / total) if total > 0 else math.nan


def fold_scores(name: str, params: dict, moments: dict[int, Moments]) -> dict[int, tuple[np.ndarray, float, float]]:
    """fold -> (coefficients, intercept, R² on the fold) of a fit on the others."""
    out = {}
    for f, held in moments.items():
        train = merged(m for g, m in moments.items() if g != f)
        b, intercept = solve(name, params, train) if train is not None else (np.zeros(held.d), math.nan)
        out[f] = b, intercept, r2(b, intercept, held)
    return out


def linear_model(spark: SparkSession, coefficients: np.ndarray, intercept: float) -> LinearRegressionModel:
    """The solution as an MLlib model (predicts, saves and loads as any other)."""
    java = spark._jvm.org.apache.spark.ml.regression.LinearRegressionModel(
        "linReg_moments", _py2java(spark.sparkContext, DenseVector(coefficients)), float(intercept), 1.0)
    return LinearRegressionModel(java)


class MomentEstimator:
    """A linear model as an estimator over the moments of one pass."""

    def __init__(self, name: str, params: dict):
        self.name, self.params = name, params

    def fit(self, df: DataFrame) -> LinearRegressionModel:
        found = fold_moments(df.withColumn("fold", F.lit(0)))
        if not found:
            raise ValueError("no rows to fit")
        return linear_model(df.sparkSession, *solve(self.name, self.params, found[0]))
