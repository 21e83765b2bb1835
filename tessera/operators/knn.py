"""MR-8 / MC-5: exact k-nearest-neighbour join, regression and vote.

Pivots are drawn from the train rows (far apart, by a hash of the id) and every
train row belongs to its nearest pivot: the cells of a Voronoi partition, each
with its count, its radii and the k smallest distances to its pivot. These few
numbers bound, for a test row, the distance of its k-th neighbour (triangle
inequality over the small pivot distances), and from below the distance of any row
of a cell (radii and the bisecting plane of two pivots). A test row visits only
the cells whose lower bound is within its own upper bound, so on clustered data the
work follows the neighbourhoods, not the product of both sides; on data without
structure every cell is visited, which is the plain block join.

Cells and the test rows that visit them are split to blocks of ``BLOCK_ROWS``, and a
block pair is one cogrouped numpy call that keeps the k best per test row. A window
then keeps the global k best (``row_number <= k`` is limited per task before its
exchange). The driver holds the pivots and k + 3 numbers per cell.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .profile import q

BLOCK_ROWS = 10_000        # rows of one side per call; bounds a task's memory
CELL_ROWS = 2_000          # train rows per pivot that are aimed at
MAX_PIVOTS = 1024
CELL_ELEMENTS = 4_000_000  # doubles in one distance temporary (~32 MB)
SLACK = 1e-6               # relative allowance for rounding in the bounds


def _features(df: DataFrame, cols) -> F.Column:
    if isinstance(cols, str):
        return F.col(q(cols)).cast("array<double>")
    return F.array(*[F.col(q(c)).cast("double") for c in cols])


def distances(a: np.ndarray, b: np.ndarray, p: int) -> np.ndarray:
    """All distances between the rows of two small matrices."""
    out = np.empty((len(a), len(b)))
    step = max(1, CELL_ELEMENTS // max(1, b.size))
    for s in range(0, len(a), step):
        diff = a[s:s + step, None, :] - b[None, :, :]
        out[s:s + step] = np.abs(diff).sum(axis=2) if p == 1 else np.sqrt((diff * diff).sum(axis=2))
    return out


def nearest(a: np.ndarray, b: np.ndarray, k: int, p: int, upper: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``a``, row of ``b``, distance) of the k nearest within ``upper``, ties by
    the place in ``b``. Euclidean distances are screened by one matrix product, whose
    rounding is allowed for, and taken exactly only where a row may be among the k."""
    k = min(k, len(b))
    rows, cols, dist = [], [], []
    if p == 2:
        middle = np.nan_to_num(b.mean(axis=0))
        b0 = b - middle
        b2 = (b0 * b0).sum(axis=1)
    for s, z in _slices(len(a), len(b) if p == 2 else b.size):
        if p == 2:
            a0 = a[s:z] - middle
            a2 = (a0 * a0).sum(axis=1)
            found = a0 @ b0.T
            found *= -2
            found += b2
            found += a2[:, None]                       # squares of the distances but for rounding
            slack = 1e-9 * (a2 + np.nanmax(b2, initial=0.0)) + 1e-300
            most = np.fmin(np.square(upper[s:z]) * (1 + 1e-9), np.partition(found, k - 1, axis=1)[:, k - 1] + slack) + slack
        else:
            found = distances(a[s:z], b, p)
            most = np.fmin(upper[s:z], np.partition(found, k - 1, axis=1)[:, k - 1])
        r, c = np.nonzero(found <= most[:, None])
        d = np.empty(len(r))
        for lo, hi in _slices(len(r), b.shape[1]):
            diff = a[s + r[lo:hi]] - b[c[lo:hi]]
            d[lo:hi] = np.abs(diff).sum(axis=1) if p == 1 else np.sqrt((diff * diff).sum(axis=1))
        order = np.lexsort((c, d, r))
        r, c, d = r[order], c[order], d[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        good = (place < k) & (d <= upper[s:z][r])
        rows.append(s + r[good])
        cols.append(c[good])
        dist.append(d[good])
    return np.concatenate(rows), np.concatenate(cols), np.concatenate(dist)


def choose_pivots(sample: np.ndarray, n: int, p: int) -> np.ndarray:
    """``n`` rows of the sample, each as far as possible from those before."""
    chosen = [0]
    near = distances(sample, sample[:1], p)[:, 0]
    while len(chosen) < n and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1:]], p)[:, 0])
    return sample[chosen]


@dataclass
class Cells:
    """Pivots and, per cell, count, least and greatest pivot distance and the k
    smallest ones (ascending, inf beyond the count)."""

    pivots: np.ndarray
    p: int
    count: np.ndarray
    least: np.ndarray
    radius: np.ndarray
    small: np.ndarray

    def __post_init__(self):
        self.between = distances(self.pivots, self.pivots, self.p)
        self.size = np.abs(self.pivots).max(initial=0.0) * (self.pivots.shape[1] if self.p == 1 else math.sqrt(self.pivots.shape[1]))

    def slack(self, x: np.ndarray) -> np.ndarray:
        return SLACK * (self.size + (np.abs(x).sum(axis=1) if self.p == 1 else np.sqrt((x * x).sum(axis=1))))

    def bounds(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(upper bound of the k-th neighbour's distance, lower bound of the
        distance of any row per cell) of test rows; the third is the pivot distance."""
        to = distances(x, self.pivots, self.p)
        slack = self.slack(x)
        ways = (to[:, :, None] + self.small[None, :, :]).reshape(len(x), -1)
        kth = min(k, ways.shape[1]) - 1
        upper = np.partition(ways, kth, axis=1)[:, kth] + slack if ways.shape[1] >= k else np.full(len(x), np.inf)
        lower = np.maximum(to - self.radius, self.least - to)
        home = to.argmin(axis=1)
        near = to[np.arange(len(x)), home]
        if self.p == 1:     # rows of another cell are nearer to its pivot than to the home pivot
            plane = (to - near[:, None]) / 2
        else:
            gap = self.between[home]
            plane = np.where(gap > 0, (to ** 2 - near[:, None] ** 2) / np.where(gap > 0, 2 * gap, 1), 0)
        lower = np.maximum(lower, plane) - slack[:, None]
        lower[:, self.count == 0] = np.inf
        return upper, lower, to

    def visits(self, x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(upper bound, matrix of cells to visit) of test rows."""
        upper, lower, _ = self.bounds(x, k)
        return upper, (lower <= upper[:, None]) & (self.count > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)


def _slices(n: int, width: int) -> Iterator[tuple[int, int]]:
    step = max(1, CELL_ELEMENTS // max(1, width))
    for a in range(0, n, step):
        yield a, min(n, a + step)


def build_cells(train: DataFrame, n_train: int, k: int, p: int) -> Cells | None:
    """Cells of the train rows (rid, x); None for an empty table."""
    n = max(1, min(MAX_PIVOTS, math.ceil(n_train / CELL_ROWS)))
    drawn = train.select("x", "rid").orderBy(F.xxhash64("rid"), "rid").limit(4 * n if n > 1 else 1).collect()
    if not drawn:
        return None
    pivots = choose_pivots(np.array([r["x"] for r in drawn], dtype=np.float64), n, p)
    blank = np.zeros(len(pivots))
    guide = Cells(pivots, p, blank, blank, blank, np.zeros((len(pivots), 1)))

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(pivots), dtype=np.int64)
        least, radius = np.full(len(pivots), np.inf), np.full(len(pivots), -np.inf)
        small: list[np.ndarray] = [np.zeros(0)] * len(pivots)
        for b in batches:
            x = _matrix(b.column("x")) if b.num_rows else np.zeros((0, pivots.shape[1]))
            for a, z in _slices(len(x), pivots.size):
                to = distances(x[a:z], pivots, p)
                cell, slack = to.argmin(axis=1), guide.slack(x[a:z])
                near = to[np.arange(z - a), cell]
                np.add.at(count, cell, 1)
                np.minimum.at(least, cell, near - slack)
                np.maximum.at(radius, cell, near + slack)
                for c in np.unique(cell).tolist():
                    small[c] = np.sort(np.concatenate([small[c], (near + slack)[cell == c]]))[:k]
        own = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(count[own]), pa.array(least[own]), pa.array(radius[own]),
                                          pa.array([small[c] for c in own.tolist()], pa.list_(pa.float64()))],
                                         names=["cell", "n", "least", "radius", "small"])

    found = (train.select("x").mapInArrow(summarise, "cell int, n long, least double, radius double, small array<double>")
             .groupBy("cell").agg(F.sum("n").alias("n"), F.min("least").alias("least"), F.max("radius").alias("radius"),
                                  F.slice(F.array_sort(F.flatten(F.collect_list("small"))), 1, k).alias("small")).collect())
    count, least, radius = np.zeros(len(pivots), dtype=np.int64), np.zeros(len(pivots)), np.zeros(len(pivots))
    small = np.full((len(pivots), k), np.inf)
    for r in found:
        c = r["cell"]
        count[c], least[c], radius[c] = r["n"], r["least"], r["radius"]
        small[c, :len(r["small"])] = r["small"]
    return Cells(pivots, p, count, least, radius, small)


def visit_counts(test: DataFrame, cells: Cells, k: int) -> np.ndarray:
    """Test rows that visit each cell."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(cells.pivots), dtype=np.int64)
        for b in batches:
            x = _matrix(b.column("x")) if b.num_rows else np.zeros((0, cells.pivots.shape[1]))
            for a, z in _slices(len(x), cells.small.size + cells.pivots.size):
                total += cells.visits(x[a:z], k)[1].sum(axis=0)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["cell", "n"])

    out = np.zeros(len(cells.pivots), dtype=np.int64)
    for r in test.select("x").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r["cell"]] = r["n"]
    return out


def knn_candidates(test: DataFrame, train: DataFrame, k: int, features, id_col: str, label_col: str,
                   p: int = 2, block_rows: int | None = None) -> DataFrame:
    """``(test_id, train_id, dist, label)``: the k nearest train rows of every
    test row (ties by train id)."""
    block_rows = block_rows or BLOCK_ROWS
    t = test.select(F.col(q(id_col)).cast("long").alias("qid"), _features(test, features).alias("x"))
    r = train.select(F.col(q(id_col)).cast("long").alias("rid"), _features(train, features).alias("x"),
                     F.col(q(label_col)).cast("double").alias("y"))
    cells = build_cells(r, train.count(), k, p)
    if cells is None:
        return test.sparkSession.createDataFrame([], "test_id long, train_id long, dist double, label double, rank int")
    coming = visit_counts(t, cells, k)
    # a block pair holds block_rows of each side at most, on average
    train_parts = np.maximum(1, -(-cells.count // block_rows)).tolist()
    test_parts = np.maximum(1, -(-coming // block_rows)).tolist()
    n_cells = len(cells.pivots)

    def home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x")) if b.num_rows else np.zeros((0, cells.pivots.shape[1]))
            cell = np.concatenate([np.zeros(0, np.int64), *(distances(x[a:z], cells.pivots, p).argmin(axis=1)
                                                            for a, z in _slices(len(x), cells.pivots.size))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32())], names=[*b.schema.names, "cell"])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("x")) if b.num_rows else np.zeros((0, cells.pivots.shape[1]))
            for a, z in _slices(len(x), cells.small.size + cells.pivots.size):
                upper, open_ = cells.visits(x[a:z], k)
                row, cell = np.nonzero(open_)
                own = b.slice(a, z - a).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(cell, pa.int32()), pa.array(upper[row])],
                                                 names=[*b.schema.names, "cell", "upper"])

    def parts(of: list[int]) -> F.Column:
        return F.get(F.array(*[F.lit(int(v)) for v in of]), F.col("cell")) if n_cells > 1 else F.lit(int(of[0]))

    def dealt(df: DataFrame, key: str, own: str, own_parts: list[int], other: str, other_parts: list[int]) -> DataFrame:
        """Each row in its own block of the cell, once for each block of the other side."""
        return df.select("*", F.pmod(F.xxhash64(key), parts(own_parts)).cast("int").alias(own),
                         F.explode(F.sequence(F.lit(0), parts(other_parts) - 1)).alias(other))

    left = dealt(t.mapInArrow(visit, "qid long, x array<double>, cell int, upper double"), "qid", "tb", test_parts, "rb", train_parts)
    right = dealt(r.mapInArrow(home, "rid long, x array<double>, y double, cell int"), "rid", "rb", train_parts, "tb", test_parts)

    def block(own: pd.DataFrame, other: pd.DataFrame) -> pd.DataFrame:
        if own.empty or other.empty:
            return pd.DataFrame({"qid": [], "rid": [], "dist": [], "y": []})
        other = other.sort_values("rid", kind="stable")
        A = np.stack(own["x"].to_numpy()).astype(np.float64)
        B = np.stack(other["x"].to_numpy()).astype(np.float64)
        rid, ry, qid, upper = other["rid"].to_numpy(), other["y"].to_numpy(), own["qid"].to_numpy(), own["upper"].to_numpy()
        row, col, dist = nearest(A, B, k, p, upper)
        return pd.DataFrame({"qid": qid[row], "rid": rid[col], "dist": dist, "y": ry[col]})

    cand = (left.groupBy("cell", "tb", "rb").cogroup(right.groupBy("cell", "tb", "rb"))
            .applyInPandas(block, "qid long, rid long, dist double, y double"))
    w = Window.partitionBy("qid").orderBy("dist", "rid")
    return (cand.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select(F.col("qid").alias("test_id"), F.col("rid").alias("train_id"), "dist",
                    F.col("y").alias("label"), "rank"))


def knn_class_shares(test: DataFrame, train: DataFrame, n_classes: int, k: int = 5, features="features", id_col: str = "id",
                     label_col: str = "label", p: int = 2, weights: str = "uniform") -> DataFrame:
    """MC-5 with scores: ``(test_id, prediction, shares)``, the share of the
    votes of each class 0..n_classes-1; the first largest share wins."""
    votes = knn_votes(test, train, k, features, id_col, label_col, p, weights)
    own = [F.sum(F.when(F.col("label") == i, F.col("votes")).otherwise(0.0)) / F.sum("votes") for i in range(n_classes)]
    shares = votes.groupBy("test_id").agg(F.array(*own).alias("shares"))
    return shares.select("test_id", (F.array_position("shares", F.array_max("shares")) - 1).cast("double").alias("prediction"), "shares")


def knn_regress(test: DataFrame, train: DataFrame, k: int = 5, features="features", id_col: str = "id",
                label_col: str = "label", p: int = 2, weights: str = "uniform") -> DataFrame:
    """MR-8: ``(test_id, prediction)``: mean (or 1/distance-weighted mean) of
    the k nearest labels."""
    c = knn_candidates(test, train, k, features, id_col, label_col, p)
    if weights == "distance":
        c = c.withColumn("zero", F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("test_id")))
        w = F.when(F.col("zero") == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        w = F.lit(1.0)
    return c.groupBy("test_id").agg((F.sum(w * F.col("label")) / F.sum(w)).alias("prediction"))


def knn_votes(test: DataFrame, train: DataFrame, k: int = 5, features="features", id_col: str = "id",
              label_col: str = "label", p: int = 2, weights: str = "uniform") -> DataFrame:
    """``(test_id, label, votes)`` of the k nearest rows."""
    c = knn_candidates(test, train, k, features, id_col, label_col, p)
    if weights == "distance":
        c = c.withColumn("zero", F.max((F.col("dist") == 0).cast("int")).over(Window.partitionBy("test_id")))
        w = F.when(F.col("zero") == 1, (F.col("dist") == 0).cast("double")).otherwise(1.0 / F.col("dist"))
    else:
        w = F.lit(1.0)
    return c.groupBy("test_id", "label").agg(F.sum(w).alias("votes"))


def knn_classify(test: DataFrame, train: DataFrame, k: int = 5, features="features", id_col: str = "id",
                 label_col: str = "label", p: int = 2, weights: str = "uniform") -> DataFrame:
    """MC-5: ``(test_id, prediction)``: (weighted) majority vote, ties -> the
    smallest label."""
    votes = knn_votes(test, train, k, features, id_col, label_col, p, weights)
    win = Window.partitionBy("test_id").orderBy(F.desc("votes"), F.asc("label"))
    return (votes.withColumn("r", F.row_number().over(win)).where("r = 1")
            .select("test_id", F.col("label").alias("prediction")))
