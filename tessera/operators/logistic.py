"""HPO-1 for logistic regression: all trials on all folds in the same passes.

The objective of a trial is Σ log-loss + |w|² / (2 C), intercepts free. Newton steps
for every (trial, fold) at once: a pass gives each model its loss, gradient and
curvature at its own coefficients over the rows outside its fold, and the driver
solves one small system per model. A step that raises a model's loss is halved.
About ten passes serve any number of trials and folds; one more counts the right
predictions on the held-out folds.

A model has (features + 1) coefficients for two classes and that many per class for
more. Every task adds its batches in numpy; Spark adds the tasks' arrays in rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import softmax

MAX_SIZE = 256          # coefficients of a model
MAX_NUMBERS = 4_000_000  # curvature entries of all models of a pass (32 MB)
FAN_IN, ROUNDS = 64, 3
SUMS = "part int, sums binary"


def sum_arrays(rows: DataFrame, shape: tuple[int, ...], batch: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """Sum over all batches of an array of one shape, merged in rounds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            if b.num_rows:
                total += batch(b)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                                         names=["part", "sums"])

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        return pa.table([pa.array([table.column("part")[0].as_py() // FAN_IN], pa.int32()), pa.array([total.tobytes()], pa.binary())],
                        names=["part", "sums"])

    out = rows.mapInArrow(run, SUMS)
    for _ in range(ROUNDS):
        out = out.groupBy(F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, SUMS)
    found = [np.frombuffer(bytes(r["sums"])) for r in out.collect()]
    return sum(found).reshape(shape) if found else np.zeros(shape)


def _read(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features with a one at the end, class, fold) of a batch."""
    y = b.column(1).to_numpy().astype(np.int64)
    x = b.column(0).flatten().to_numpy().reshape(len(y), -1)
    return np.column_stack([x, np.ones(len(y))]), y, b.column(2).to_numpy()


def fits(n_features: int, n_classes: int, models: int) -> bool:
    """Whether the curvatures of so many models are within the bound."""
    size = (n_features + 1) * (1 if n_classes <= 2 else n_classes)
    return size <= MAX_SIZE and models * size * size <= MAX_NUMBERS


def newton_sums(x: np.ndarray, y: np.ndarray, fold: np.ndarray, w: np.ndarray, folds: np.ndarray, k: int) -> np.ndarray:
    """Per model: loss, gradient and curvature over the rows outside its fold, as
    one row. ``w`` has (model, class, coefficient); one class stands for two."""
    m, c, d = w.shape
    out = np.zeros((m, 1 + c * d + (c * d) ** 2))
    for i in range(m):
        use = fold != folds[i]
        a = x[use]
        z = a @ w[i].T
        if c == 1:
            t = y[use] == 1
            p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            out[i, 0] = np.logaddexp(0, np.where(t, -z[:, 0], z[:, 0])).sum()
            out[i, 1:1 + d] = a.T @ (p[:, 0] - t)
            out[i, 1 + d:] = (a.T @ (a * (p * (1 - p)))).ravel()
            continue
        p = softmax(z)
        right = z[np.arange(len(a)), y[use]]
        top = z.max(axis=1)
        out[i, 0] = (top + np.log(np.exp(z - top[:, None]).sum(axis=1)) - right).sum()
        gap = p.copy()
        gap[np.arange(len(a)), y[use]] -= 1
        out[i, 1:1 + c * d] = (gap.T @ a).ravel()
        curve = np.zeros((c, d, c, d))
        for r in range(c):
            for s in range(r, c):
                weight = p[:, r] * ((r == s) - p[:, s])
                curve[r, :, s, :] = a.T @ (a * weight[:, None])
                curve[s, :, r, :] = curve[r, :, s, :].T
        out[i, 1 + c * d:] = curve.ravel()
    return out


def cross_validate(data: DataFrame, strengths: list[float], folds: int, n_classes: int, max_iter: int = 50,
                   tol: float = 1e-8) -> tuple[list[float], np.ndarray]:
    """Mean held-out accuracy of each C, and the coefficients (trial, fold, class,
    coefficient). ``data`` has features, label and fold, and is read in each pass:
    it should be persisted."""
    rows = data.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"), F.col("fold").cast("int").alias("fold"))
    first = rows.select(F.size("x").alias("d")).first()
    if first is None:
        raise ValueError("no rows to fit")
    d, c = first["d"] + 1, 1 if n_classes <= 2 else n_classes
    models = [(t, f) for t in range(len(strengths)) for f in range(folds)]
    held = np.array([f for _, f in models])
    penalty = np.array([1.0 / strengths[t] for t, _ in models])
    free = np.ones((c, d), dtype=bool)
    free[:, -1] = False                                       # intercepts aren't penalised
    w = np.zeros((len(models), c, d))
    step, loss = np.zeros_like(w), np.full(len(models), np.inf)
    open_ = np.arange(len(models))
    for _ in range(max_iter):
        now, out_folds = w[open_], held[open_]
        found = sum_arrays(rows, (len(open_), 1 + c * d + (c * d) ** 2), lambda b: newton_sums(*_read(b), now, out_folds, n_classes))
        left = []
        for at, i in enumerate(open_.tolist()):
            pull = penalty[i] * np.where(free, w[i], 0.0)
            value = found[at, 0] + 0.5 * float((pull * w[i]).sum())
            if value > loss[i] * (1 + 1e-12) + 1e-12:         # too far: half the step
                step[i] /= 2
                w[i] -= step[i]
                if np.abs(step[i]).max() > tol:
                    left.append(i)
                continue
            loss[i] = value
            g = found[at, 1:1 + c * d] + pull.ravel()
            h = found[at, 1 + c * d:].reshape(c * d, c * d) + np.diag(penalty[i] * free.ravel())
            h += np.eye(c * d) * 1e-10 * max(1.0, np.diag(h).max())   # intercepts of many classes shift together
            step[i] = -np.linalg.solve(h, g).reshape(c, d)
            if np.abs(step[i]).max() > tol * max(1.0, np.abs(w[i]).max()):
                w[i] += step[i]
                left.append(i)
        open_ = np.array(left, dtype=np.int64)
        if not len(open_):
            break

    def hits(b: pa.RecordBatch) -> np.ndarray:
        x, y, fold = _read(b)
        out = np.zeros((len(models), 2))
        for i in range(len(models)):
            use = fold == held[i]
            z = x[use] @ w[i].T
            guess = (z[:, 0] > 0).astype(np.int64) if c == 1 else z.argmax(axis=1)
            out[i] = (guess == y[use]).sum(), use.sum()
        return out

    right = sum_arrays(rows, (len(models), 2), hits).reshape(len(strengths), folds, 2)
    with np.errstate(invalid="ignore", divide="ignore"):
        share = right[..., 0] / right[..., 1]
    return [float(s.mean()) for s in share], w.reshape(len(strengths), folds, c, d)
