"""MR-9: ε-insensitive linear regression by L-BFGS over a distributed gradient.

The objective is |w|²/2 + C Σ max(0, |y - w·x - b| - ε). The loss is smoothed at its
two kinks, first widely and then ever less, each minimum being the start of the next
search. Value and gradient are one pass over the rows, for all step sizes of a round
together: every task sums its batches in numpy, Spark adds the tasks' vectors, and
d + 2 numbers per step reach the driver, where L-BFGS chooses.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .moments import linear_model

#: Widths of the smoothed kinks, in standard deviations of the label, and the relative
#: gain at which the search at that width ends.
WIDTHS = ((0.1, 1e-3), (0.01, 1e-4), (0.001, 1e-5))
STEPS = np.array([2.0, 1.0, 0.5, 0.2, 0.05, 0.005])
HISTORY = 10


def tube_loss(r: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Loss of residuals and its slope: zero within epsilon, linear beyond
    epsilon + width, a parabola between."""
    over = np.abs(r) - epsilon
    bent = np.clip(over, 0.0, width)
    return np.where(over > width, over - width / 2, bent * bent / (2 * width)), np.sign(r) * bent / width


def sums(rows: DataFrame, loss: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]], points: np.ndarray) -> np.ndarray:
    """For each row (w, b) of ``points``: (Σ loss, Σ slope·x, Σ slope) over (x
    array<double>, y double), the slope taken of the prediction. One pass serves
    all points."""
    k, d = points.shape[0], points.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, d + 2))
        for batch in batches:
            if batch.num_rows:
                y = batch.column(1).to_numpy()
                x = batch.column(0).flatten().to_numpy().reshape(len(y), -1)
                value, slope = loss(x @ points[:, :d].T + points[:, d] - y[:, None])
                total += np.column_stack([value.sum(axis=0), slope.T @ x, slope.sum(axis=0)])
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int32()), pa.array(flat)], names=["i", "v"])

    out = np.zeros(k * (d + 2))
    for r in rows.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out.reshape(k, d + 2)


def lbfgs(f: Callable[[np.ndarray], list[tuple[float, np.ndarray]]], x: np.ndarray, max_iter: int = 40, tol: float = 1e-6) -> np.ndarray:
    """Minimiser of a smooth convex function by the two-loop recursion. ``f`` gives
    value and gradient of several points at once: a round tries all ``STEPS`` along
    its direction and takes the lowest, so that it is one evaluation."""
    value, g = f(x[None, :])[0]
    steps: list[np.ndarray] = []
    turns: list[np.ndarray] = []
    for _ in range(max_iter):
        d, a = g.copy(), []
        for s, t in zip(reversed(steps), reversed(turns)):
            a.append(s @ d / (t @ s))
            d -= a[-1] * t
        if steps:
            d *= steps[-1] @ turns[-1] / (turns[-1] @ turns[-1])
        for s, t, k in zip(steps, turns, reversed(a)):
            d += (k - t @ d / (t @ s)) * s
        if g @ d <= 0:
            d, steps, turns = g, [], []
        first = 1.0 if steps else min(1.0, 1.0 / max(np.abs(g).sum(), 1e-300))
        tried = x - first * STEPS[:, None] * d
        found = f(tried)
        i = int(np.argmin([v for v, _ in found]))
        new_value, new_g = found[i]
        if not new_value < value:
            if not steps:
                break
            steps, turns = [], []     # start again along the gradient
            continue
        s, t = tried[i] - x, new_g - g
        gain = value - new_value
        x, value, g = tried[i], new_value, new_g
        if s @ t > 1e-12 * np.linalg.norm(s) * np.linalg.norm(t):
            steps, turns = [*steps, s][-HISTORY:], [*turns, t][-HISTORY:]
        if gain <= tol * max(abs(value), 1e-300):
            break
    return x


class TubeRegression:
    """Estimator: linear support vector regression. ``features`` and ``label`` in,
    an MLlib linear model out."""

    def __init__(self, c: float = 1.0, epsilon: float = 0.1, max_iter: int = 40):
        self.c, self.epsilon, self.max_iter = c, epsilon, max_iter

    def fit(self, df: DataFrame):
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            r = rows.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d"), F.min("y").alias("low"), F.max("y").alias("high"),
                         F.stddev_pop("y").alias("spread")).first()
            if not r["n"]:
                raise ValueError("no rows to fit")
            d, middle = r["d"], (r["low"] + r["high"]) / 2
            if (r["high"] - r["low"]) / 2 <= self.epsilon:    # every label is in the tube of a flat function
                return linear_model(df.sparkSession, np.zeros(d), middle)
            scale = 1.0 / (self.c * r["n"])      # divided by C n: the same minimiser, at the scale of one row

            def objective(points: np.ndarray, width: float) -> list[tuple[float, np.ndarray]]:
                total = sums(rows, lambda e: tube_loss(e, self.epsilon, width), points) / r["n"]
                w = points[:, :d]
                return [(0.5 * scale * float(v @ v) + float(t[0]), np.append(scale * v + t[1:-1], t[-1])) for v, t in zip(w, total)]

            z = np.append(np.zeros(d), middle)
            for width, tol in WIDTHS:       # each minimum is where the next, sharper search begins
                z = lbfgs(lambda x, width=width * max(r["spread"], 1e-12): objective(x, width), z, self.max_iter, tol)
            return linear_model(df.sparkSession, z[:d], float(z[d]))
        finally:
            rows.unpersist()
