"""MC-4: gradient boosting for several classes.

Every round fits one regression tree per class to the gradient of the softmax loss
and gives its leaves Newton values. The features are binned once (thresholds from a
bounded sample in hash order, as tree learners on Spark do); a level of the K trees
of a round is one pass: every task adds, per (class, node, feature, bin), the number
of rows, their gradients and their curvature in numpy, Spark adds the tasks' tables,
and the driver picks the best splits. The last level's table holds the leaf values
too, so a round of depth h takes h passes. Rows carry their scores in a checkpointed
table that is renewed every ``RENEW`` rounds; the few trees since are applied on the
way, so that no plan grows with the rounds. A table of at most ``LOCAL`` rows is boosted
by one task, in the same steps, since a pass of tasks for every level costs more.

The driver holds K x nodes x features x bins numbers, whatever the number of rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

BINS = 32
SLOTS = 64          # open nodes of a tree that one pass counts
SAMPLE = 10_000     # rows that choose the thresholds
RENEW = 10
LOCAL = 200_000     # rows that one task boosts


@dataclass
class Tree:
    """Nodes of a tree: the rows with x[feature] <= threshold go left; a leaf has
    feature -1 and a value."""

    feature: np.ndarray
    threshold: np.ndarray
    bin: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    @staticmethod
    def empty() -> Tree:
        return Tree(*(np.zeros(0, t) for t in (np.int64, float, np.int64, np.int64, np.int64, float)))

    def add(self) -> int:
        for name, blank in (("feature", -1), ("threshold", 0.0), ("bin", 0), ("left", 0), ("right", 0), ("value", 0.0)):
            setattr(self, name, np.append(getattr(self, name), blank))
        return len(self.feature) - 1

    def leaf(self, x: np.ndarray, binned: bool) -> np.ndarray:
        """Node in which every row ends."""
        at = np.zeros(len(x), dtype=np.int64)
        row = np.arange(len(x))
        cut = self.bin if binned else self.threshold
        while True:
            inner = self.feature[at] >= 0
            if not inner.any():
                return at
            f = np.maximum(self.feature[at], 0)
            step = np.where(x[row, f] <= cut[at], self.left[at], self.right[at])
            at = np.where(inner, step, at)

    def predict(self, x: np.ndarray, binned: bool = False) -> np.ndarray:
        return self.value[self.leaf(x, binned)]

    def as_lists(self) -> dict:
        return {k: getattr(self, k).tolist() for k in ("feature", "threshold", "bin", "left", "right", "value")}

    @staticmethod
    def of(d: dict) -> Tree:
        whole = {"feature", "bin", "left", "right"}
        return Tree(**{k: np.array(v, dtype=np.int64 if k in whole else float) for k, v in d.items()})


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def thresholds(sample: np.ndarray, bins: int = BINS) -> list[np.ndarray]:
    """Per feature at most ``bins`` - 1 cuts between values of the sample."""
    out = []
    for x in sample.T:
        values = np.unique(x)
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) >= bins:
            at = np.unique(np.searchsorted(values, np.quantile(x, np.arange(1, bins) / bins), side="left"))
            middle = middle[np.unique(np.clip(at, 1, len(middle)) - 1)]
        out.append(middle)
    return out


def to_bins(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1).astype(np.uint8)


def level_table(bins: np.ndarray, label: np.ndarray, scores: np.ndarray, trees: list[Tree], slots: list[dict[int, int]],
                n_bins: int, keep: np.ndarray | None = None) -> np.ndarray:
    """(class, slot, feature, bin, [rows, gradient, gradient², curvature]) sums of a
    batch over the open nodes of the trees (slots: node -> slot)."""
    k, d = len(trees), bins.shape[1]
    width = max((len(s) for s in slots), default=0)
    out = np.zeros((k, width, d, n_bins, 4))
    p = softmax(scores)
    for c, tree in enumerate(trees):
        number = np.full(len(tree.feature), -1, dtype=np.int64)
        for node, slot in slots[c].items():
            number[node] = slot
        slot = number[tree.leaf(bins, True)]
        use = slot >= 0 if keep is None else (slot >= 0) & keep
        if not use.any():
            continue
        g = (label[use] == c) - p[use, c]
        stats = np.stack([np.ones(len(g)), g, g * g, np.abs(g) * (1 - np.abs(g))], axis=1)
        for j in range(d):
            cell = slot[use] * n_bins + bins[use, j]
            for s in range(4):
                out[c, :, j, :, s] += np.bincount(cell, weights=stats[:, s], minlength=width * n_bins).reshape(width, n_bins)
    return out


def newton(sums: np.ndarray, k: int, rate: float) -> float:
    """Value of a leaf with these sums."""
    return 0.0 if sums[3] < 1e-150 else rate * (k - 1) / k * sums[1] / sums[3]


def grow(trees: list[Tree], slots: list[dict[int, int]], table: np.ndarray, cuts: list[np.ndarray], last: bool, rate: float,
         min_rows: int) -> list[list[int]]:
    """Split the open nodes by the largest fall of squared error; returns the
    children that stay open. Nodes that can't be split, and all children of the last
    level, become leaves."""
    k, nxt = len(trees), []
    for c, tree in enumerate(trees):
        children: list[int] = []
        for node, slot in slots[c].items():
            hist = table[c, slot]
            total = hist[0].sum(axis=0)
            tree.value[node] = newton(total, k, rate)
            left = hist.cumsum(axis=1)[:, :-1]
            right = total - left
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = left[..., 1] ** 2 / left[..., 0] + right[..., 1] ** 2 / right[..., 0] - total[1] ** 2 / total[0]
            gain[(left[..., 0] < min_rows) | (right[..., 0] < min_rows)] = -np.inf
            for j, cut in enumerate(cuts):
                gain[j, len(cut):] = -np.inf
            best = int(np.argmax(gain)) if gain.size else 0
            j, b = divmod(best, max(1, gain.shape[1]))
            if not gain.size or not gain[j, b] > 1e-12 * max(total[2], 1e-300):
                continue
            tree.feature[node], tree.bin[node], tree.threshold[node] = j, b, cuts[j][b]
            for side, sums in (("left", left[j, b]), ("right", right[j, b])):
                child = tree.add()
                getattr(tree, side)[node] = child
                tree.value[child] = newton(sums, k, rate)
                if not last and sums[0] >= 2 * min_rows:
                    children.append(child)
        nxt.append(children)
    return nxt


class SoftmaxBoosting:
    """Estimator over ``features`` and ``label`` (0 .. k-1, as doubles)."""

    def __init__(self, n_classes: int, n_estimators: int = 100, learning_rate: float = 0.1, max_depth: int = 3, min_rows: int = 1,
                 subsample: float = 1.0, bins: int = BINS, seed: int = 42, local: int = LOCAL):
        self.k, self.rounds, self.rate, self.depth = n_classes, n_estimators, learning_rate, max_depth
        self.min_rows, self.subsample, self.bins, self.seed, self.local = min_rows, subsample, bins, seed, local

    def fit(self, df: DataFrame) -> SoftmaxModel:
        ensure_checkpoint_dir(df.sparkSession)
        raw = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("label"))
        drawn = raw.select("x", F.xxhash64("x", "label").alias("h")).orderBy("h").limit(SAMPLE).collect()
        if not drawn:
            raise ValueError("no rows to fit")
        cuts = thresholds(np.array([r["x"] for r in drawn]), self.bins)
        share = np.zeros(self.k)
        for r in raw.groupBy("label").count().collect():
            share[r["label"]] = r["count"]
        start = np.log(np.maximum(share / share.sum(), np.finfo(float).tiny))
        d, n_bins, k = len(cuts), max((len(c) for c in cuts), default=0) + 1, self.k

        def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = b.column(0).flatten().to_numpy().reshape(b.num_rows, -1) if b.num_rows else np.zeros((0, d))
                packed = to_bins(x, cuts)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in packed], pa.binary()), b.column(1),
                                                  pa.array([start.tobytes()] * b.num_rows, pa.binary()), b.column(2)],
                                                 names=["bins", "label", "scores", "row"])

        schema = "bins binary, label int, scores binary, row long"
        rows = raw.withColumn("row", F.xxhash64("x", "label", F.monotonically_increasing_id())).mapInArrow(prepare, schema)
        if share.sum() <= self.local:
            return SoftmaxModel(start, self._in_a_task(rows, start, cuts, n_bins))
        rows = rows.checkpoint()
        recent: list[list[Tree]] = []      # rounds that the scores in ``rows`` lack

        def read(b: pa.RecordBatch, since: list[list[Tree]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(b.num_rows, d)
            scores = np.frombuffer(b"".join(b.column("scores").to_pylist())).reshape(b.num_rows, k).copy()
            for trees in since:
                for c, tree in enumerate(trees):
                    scores[:, c] += tree.predict(bins, True)
            return bins, b.column("label").to_numpy(), scores

        def tables(trees: list[Tree], slots: list[dict[int, int]], round_: int) -> np.ndarray:
            since, part, seed = list(recent), self.subsample, self.seed
            shape = (k, max(len(s) for s in slots), d, n_bins, 4)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                total = np.zeros(shape)
                for b in batches:
                    if b.num_rows:
                        bins, label, scores = read(b, since)
                        keep = None if part >= 1 else _drawn(b.column("row").to_numpy(), round_, seed) < part
                        total += level_table(bins, label, scores, trees, slots, n_bins, keep)
                flat = total.ravel()
                at = np.flatnonzero(flat)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at])], names=["i", "v"])

            out = np.zeros(int(np.prod(shape)))
            found = rows.mapInArrow(run, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
            out[found["i"].to_numpy()] = found["v"].to_numpy()
            return out.reshape(shape)

        def after(trees: list[Tree], round_: int) -> None:
            nonlocal rows
            recent.append(trees)
            if len(recent) == RENEW and round_ < self.rounds - 1:
                since = list(recent)

                def renew(batches: Iterator[pa.RecordBatch], since=since) -> Iterator[pa.RecordBatch]:
                    for b in batches:
                        if b.num_rows:
                            scores = read(b, since)[2]
                            yield pa.RecordBatch.from_arrays([b.column("bins"), b.column("label"),
                                                              pa.array([s.tobytes() for s in scores], pa.binary()), b.column("row")], names=b.schema.names)

                rows = rows.mapInArrow(renew, schema).checkpoint()
                recent.clear()

        return SoftmaxModel(start, self._boost(tables, after, cuts))

    def _boost(self, tables: Callable[[list[Tree], list[dict[int, int]], int], np.ndarray], after: Callable[[list[Tree], int], None],
               cuts: list[np.ndarray]) -> list[list[Tree]]:
        """The trees of all rounds, from the sums over the rows; ``after`` takes those of each round."""
        done: list[list[Tree]] = []
        for round_ in range(self.rounds):
            trees = [Tree.empty() for _ in range(self.k)]
            for t in trees:
                t.add()
            nodes = [[0] for _ in range(self.k)]
            for level in range(self.depth):
                below: list[list[int]] = [[] for _ in range(self.k)]
                shape = [Tree.of(t.as_lists()) for t in trees]    # nodes as they are before this level's splits
                for a in range(0, max(map(len, nodes)), SLOTS):
                    slots = [{node: s for s, node in enumerate(own[a:a + SLOTS])} for own in nodes]
                    found = grow(trees, slots, tables(shape, slots, round_), cuts, level == self.depth - 1, self.rate, self.min_rows)
                    below = [x + y for x, y in zip(below, found)]
                nodes = below
                if not any(nodes):
                    break
            done.append(trees)
            after(trees, round_)
        return done

    def _in_a_task(self, rows: DataFrame, start: np.ndarray, cuts: list[np.ndarray], n_bins: int) -> list[list[Tree]]:
        """All rounds over the binned rows of one partition."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            read = [(b"".join(b.column(0).to_pylist()), b.column(1).to_numpy(), b.column(3).to_numpy()) for b in batches if b.num_rows]
            if not read:
                return
            label, row = np.concatenate([r[1] for r in read]), np.concatenate([r[2] for r in read])
            bins = np.frombuffer(b"".join(r[0] for r in read), np.uint8).reshape(len(label), -1)
            scores = np.tile(start, (len(label), 1))

            def tables(trees: list[Tree], slots: list[dict[int, int]], round_: int) -> np.ndarray:
                keep = None if self.subsample >= 1 else _drawn(row, round_, self.seed) < self.subsample
                return level_table(bins, label, scores, trees, slots, n_bins, keep)

            def after(trees: list[Tree], round_: int) -> None:
                for c, tree in enumerate(trees):
                    scores[:, c] += tree.predict(bins, True)

            for trees in self._boost(tables, after, cuts):
                yield pa.RecordBatch.from_arrays([pa.array([json.dumps([t.as_lists() for t in trees])])], names=["trees"])

        found = rows.repartition(1).mapInArrow(run, "trees string").collect()       # one partition: in the order of the rounds
        return [[Tree.of(t) for t in json.loads(r["trees"])] for r in found]


def _drawn(row: np.ndarray, round_: int, seed: int) -> np.ndarray:
    """A number in [0, 1) per row and round."""
    x = row.astype(np.uint64) ^ np.uint64((round_ * 0x9E3779B97F4A7C15 + seed) & (2**64 - 1))
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
    return (x >> np.uint64(11)).astype(float) / 2**53


class SoftmaxModel:
    def __init__(self, start: np.ndarray, rounds: list[list[Tree]]):
        self.start, self.rounds = start, rounds

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        scores = np.tile(self.start, (len(x), 1))
        for trees in self.rounds:
            for c, tree in enumerate(trees):
                scores[:, c] += tree.predict(x)
        return softmax(scores)

    def transform(self, df: DataFrame) -> DataFrame:
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("array<double>")
        def shares(x: pd.Series) -> pd.Series:    # all trees over one Arrow batch
            return pd.Series(list(model.value.probabilities(np.stack(x.to_numpy()))) if len(x) else [], dtype=object)

        out = df.withColumn("__shares", shares(vector_to_array("features")))
        best = F.array_position("__shares", F.array_max("__shares")) - 1
        return out.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("__shares")).drop("__shares")

    def save(self, path: str) -> None:
        spark = SparkSession.getActiveSession()
        text = json.dumps({"start": self.start.tolist(), "rounds": [[t.as_lists() for t in trees] for trees in self.rounds]})
        spark.createDataFrame([(text,)], "m string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> SoftmaxModel:
        m = json.loads(spark.read.text(path).first()[0])
        return SoftmaxModel(np.array(m["start"]), [[Tree.of(t) for t in trees] for trees in m["rounds"]])
