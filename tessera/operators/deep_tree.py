"""MC-7 without a depth limit on many rows: a classification tree whose top grows by
distributed histograms and whose branches are finished inside tasks.

MLlib reads all rows once for every group of nodes that fits its memory, and a tree
without a limit has about as many nodes as rows: its time grows with their square,
and the driver holds every node. Here a pass over the rows serves one level of the
nodes with more than ``LOCAL`` rows; when a node has fewer, its rows go to one task
that grows the whole branch. The driver keeps the top (some rows / LOCAL nodes), the
branches are a checkpointed table that scoring joins to the rows by a shuffle.

Candidate thresholds, impurities, leaf sizes and the merging of leaves with the same
prediction are MLlib's: up to 31 thresholds a feature from a sample of 10000 rows.
"""

from __future__ import annotations

import io
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .logistic import sum_arrays

LOCAL = 50_000          # rows of a branch that one task grows
SAMPLE = 10_000         # rows that thresholds are taken from, as in MLlib
BINS = 32
CELLS = 500_000         # histogram entries that are scored at once
SPREAD = 997            # groups that rows without a branch are dealt to


def candidates(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds of a feature: midpoints of neighbouring values, near equal counts."""
    v, counts = np.unique(values, return_counts=True)
    mid = (v[:-1] + v[1:]) / 2
    if len(mid) <= bins - 1:
        return mid
    stride, seen, out = len(values) / bins, np.cumsum(counts), []
    target = stride
    for i in range(1, len(v)):
        if abs(seen[i - 1] - target) < abs(seen[i] - target):
            out.append(mid[i - 1])
            target += stride
    return np.array(out)


def bin_rows(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    """Bin of every value: the number of thresholds below it."""
    return np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)]).astype(np.uint8)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1)


def _bytes(column: pa.Array, rows: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(rows, -1)


class Rule:
    """What a node needs to choose its split."""

    def __init__(self, widths: list[int], n_classes: int, min_rows: int, entropy: bool, subset: int, seed: int):
        self.widths, self.n_classes, self.min_rows, self.entropy, self.subset, self.seed = widths, n_classes, min_rows, entropy, subset, seed
        self.start = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64)   # first cell of each feature
        self.size = int(sum(widths))
        self.feature = np.repeat(np.arange(len(widths)), widths)
        self.cut = np.arange(self.size) - self.start[self.feature]

    def histogram(self, bins: np.ndarray, y: np.ndarray, slot: np.ndarray, slots: int) -> np.ndarray:
        cell = (slot[:, None] * self.size + self.start + bins) * self.n_classes + y[:, None]
        return np.bincount(cell.ravel(), minlength=slots * self.size * self.n_classes).reshape(slots, self.size, self.n_classes)

    def cells(self) -> int:
        """Entries of the histogram of a node."""
        return self.size * self.n_classes

    def split(self, bins: np.ndarray, y: np.ndarray, slot: np.ndarray, names: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``best`` of the rows of some nodes."""
        return self.best(self.histogram(bins, y, slot, len(names)), names)

    def _weighted(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Rows times impurity."""
        some = np.maximum(n, 1)
        if self.entropy:
            return -(c * np.log2(np.maximum(c, 1) / some[..., None])).sum(axis=-1)
        return n - (c.astype(float) ** 2).sum(axis=-1) / some

    def best(self, hist: np.ndarray, names: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per node: feature (-1: none), bin that is the last to go left, and the class counts left."""
        cum = np.cumsum(hist, axis=1)
        before = np.concatenate([np.zeros_like(cum[:, :1]), cum], axis=1)[:, self.start]
        left = cum - before[:, self.feature]
        total = hist[:, :self.widths[0]].sum(axis=1)
        right = total[:, None] - left
        nl, nr = left.sum(axis=-1), right.sum(axis=-1)
        n = total.sum(axis=-1)
        gain = self._weighted(total, n)[:, None] - self._weighted(left, nl) - self._weighted(right, nr)
        gain[(nl < self.min_rows) | (nr < self.min_rows)] = -1
        if self.subset < len(self.widths):
            for i, name in enumerate(names):     # features a node may use, by its place in the tree
                drawn = np.random.default_rng((self.seed, *name)).permutation(len(self.widths))[:self.subset]
                gain[i, ~np.isin(self.feature, drawn)] = -1
        at = gain.argmax(axis=1)
        rows = np.arange(len(at))
        good = gain[rows, at] > 1e-12 * np.maximum(n, 1)
        return np.where(good, self.feature[at], -1), self.cut[at], left[rows, at]


def route(bins: np.ndarray, feature: np.ndarray, cut: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Leaf of every row; the right child stands behind the left one."""
    node, rows = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(rows):
        rows = rows[feature[node[rows]] >= 0]
        here = node[rows]
        node[rows] = left[here] + (bins[rows, feature[here]] > cut[here])
    return node


def merged(feature: np.ndarray, left: np.ndarray, counts: np.ndarray, open_: np.ndarray | None = None) -> np.ndarray:
    """Features after sibling leaves of the same prediction became one leaf; ends in
    ``open_`` are no leaves."""
    feature, guess = feature.copy(), counts.argmax(axis=1)
    leaf = feature < 0 if open_ is None else (feature < 0) & ~open_
    for i in np.flatnonzero(feature >= 0)[::-1]:         # children stand behind their parent
        a = left[i]
        if leaf[a] and leaf[a + 1] and guess[a] == guess[a + 1]:
            feature[i], leaf[i] = -1, True
    return feature


def grow(bins: np.ndarray, y: np.ndarray, rule: Rule, depth: int, name: int, merge: bool = True) -> dict[str, np.ndarray]:
    """A whole branch of at most ``depth`` levels, level by level."""
    features, cuts, lefts = [], [], []
    counts = [np.bincount(y, minlength=rule.n_classes)[None]]
    rows, slot, known = np.arange(len(y)), np.zeros(len(y), np.int64), 1
    while True:
        c = counts[-1]
        level = len(counts) - 1
        m, n = len(c), c.sum(axis=1)
        feature, cut, left = np.full(m, -1, np.int16), np.zeros(m, np.int16), np.zeros(m, np.int32)
        tried = np.flatnonzero((c.max(axis=1) < n) & (n >= 2 * rule.min_rows)) if level < depth else np.array([], np.int64)
        of = np.full(m, -1, np.int64)
        of[tried] = np.arange(len(tried))
        keep = of[slot] >= 0
        rows, slot = rows[keep], of[slot[keep]]
        order = np.argsort(slot, kind="stable")
        rows, slot = rows[order], slot[order]
        children, step = [], max(1, CELLS // rule.cells())
        for lo in range(0, len(tried), step):
            hi = min(lo + step, len(tried))
            a, b = np.searchsorted(slot, [lo, hi])
            f, k, first = rule.split(bins[rows[a:b]], y[rows[a:b]], slot[a:b] - lo, [(name, level, int(t)) for t in tried[lo:hi]])
            feature[tried[lo:hi]], cut[tried[lo:hi]] = f, k
            split = f >= 0
            total = c[tried[lo:hi]][split]
            children.append(np.stack([first[split], total - first[split]], axis=1).reshape(-1, rule.n_classes))
        split = np.flatnonzero(feature >= 0)
        left[split] = known + 2 * np.arange(len(split))
        features.append(feature)
        cuts.append(cut)
        lefts.append(left)
        if not len(split):
            break
        here = tried[slot]
        keep = feature[here] >= 0
        rows, here = rows[keep], here[keep]
        slot = left[here] - known + (bins[rows, feature[here]] > cut[here])
        known += 2 * len(split)
        counts.append(np.concatenate(children))
    out = {"feature": np.concatenate(features), "cut": np.concatenate(cuts), "left": np.concatenate(lefts), "counts": np.concatenate(counts)}
    if merge:
        out["feature"] = merged(out["feature"], out["left"], out["counts"])
    return out


def _pack(tree: dict[str, np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez(buf, **tree)
    return buf.getvalue()


class DeepTree:
    """A classification tree of many rows; ``subset``: features a node may split on."""

    def __init__(self, n_classes: int, max_depth: int = 30, min_rows: int = 1, impurity: str = "gini", subset: str | None = None,
                 seed: int = 42, local: int = LOCAL):
        self.n_classes, self.max_depth, self.min_rows, self.entropy = max(2, n_classes), max_depth, min_rows, impurity == "entropy"
        self.subset, self.seed, self.local = subset, seed, local

    def _subset(self, d: int) -> int:
        return {"sqrt": int(np.ceil(np.sqrt(d))), "log2": max(1, int(np.ceil(np.log2(d))))}.get(self.subset, d)   # as MLlib

    def fit(self, df: DataFrame) -> "DeepTreeModel":
        ensure_checkpoint_dir(df.sparkSession)
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit")
        seen = rows.select("x").sample(SAMPLE / n, self.seed).collect() if n > SAMPLE else rows.select("x").collect()
        x = np.array([r["x"] for r in seen])
        cuts = [candidates(x[:, j]) for j in range(x.shape[1])]
        rule = Rule([len(c) + 1 for c in cuts], self.n_classes, self.min_rows, self.entropy, self._subset(len(cuts)), self.seed)

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    found = bin_rows(_matrix(b.column(0), b.num_rows), cuts)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), b.column(1)], names=["bins", "y"])

        data = rows.mapInArrow(binned, "bins binary, y int").persist(StorageLevel.MEMORY_AND_DISK)
        try:
            top, depth = self._top(data, rule, n)
            branches = self._branches(data, rule, top, depth)
            ends = {r["node"]: r["leaf"] for r in branches.select("node", "leaf").collect()}
        finally:
            data.unpersist()
        open_ = np.array([i in ends and not ends[i] for i in range(len(top["feature"]))])     # these go on as branches
        top["feature"] = merged(top["feature"], top["left"], top["counts"], open_)
        return DeepTreeModel(cuts, top, open_, branches.where(~F.col("leaf")).select("node", "tree"))

    def _top(self, data: DataFrame, rule: Rule, n: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """The nodes with more than ``local`` rows and their children."""
        c = rule.n_classes
        first = sum_arrays(data, (c,), lambda b: np.bincount(b.column(1).to_numpy(), minlength=c).astype(float)).astype(np.int64)
        feature, cut, left, counts, depth = [-1], [0], [0], [first], [0]
        open_ = [0] if n > self.local else []
        per_pass = max(1, 4_000_000 // (rule.size * c))      # histograms of a pass: 32 MB
        while open_:
            level = [i for i in open_ if depth[i] < self.max_depth and counts[i].max() < counts[i].sum() and counts[i].sum() >= 2 * rule.min_rows]
            open_ = []
            for lo in range(0, len(level), per_pass):
                now = level[lo:lo + per_pass]
                slot_of = np.full(len(feature), -1, np.int64)
                slot_of[now] = np.arange(len(now))
                tree = tuple(np.array(a, np.int64) for a in (feature, cut, left))

                def count(b: pa.RecordBatch) -> np.ndarray:
                    bins, y = _bytes(b.column(0), b.num_rows), b.column(1).to_numpy()
                    slot = slot_of[route(bins, *tree)]
                    use = slot >= 0
                    return rule.histogram(bins[use], y[use], slot[use], len(now)).astype(float)

                hist = sum_arrays(data, (len(now), rule.size, c), count).astype(np.int64)
                f, k, part = rule.best(hist, [(0, depth[i], i) for i in now])
                for at, i in enumerate(now):
                    if f[at] < 0:
                        continue
                    feature[i], cut[i], left[i] = int(f[at]), int(k[at]), len(feature)
                    for side in (part[at], counts[i] - part[at]):
                        if side.sum() > self.local:
                            open_.append(len(feature))
                        feature.append(-1)
                        cut.append(0)
                        left.append(0)
                        counts.append(side)
                        depth.append(depth[i] + 1)
        return {"feature": np.array(feature), "cut": np.array(cut), "left": np.array(left), "counts": np.array(counts)}, np.array(depth)

    def _branches(self, data: DataFrame, rule: Rule, top: dict[str, np.ndarray], depth: np.ndarray) -> DataFrame:
        """(node, tree, leaf) of every branch that one task can grow."""
        size = top["counts"].sum(axis=1)
        grows = (top["feature"] < 0) & (size <= self.local) & (top["counts"].max(axis=1) < size) & (depth < self.max_depth)
        tree, deepest = (top["feature"], top["cut"], top["left"]), self.max_depth

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    node = route(_bytes(b.column(0), b.num_rows), *tree)
                    use = pa.array(grows[node])
                    yield pa.RecordBatch.from_arrays([pa.array(node), b.column(0), b.column(1)], names=["node", "bins", "y"]).filter(use)

        def finish(table: pa.Table) -> pa.Table:
            node, bins = table.column("node")[0].as_py(), table.column("bins").combine_chunks()
            found = grow(_bytes(bins, table.num_rows), table.column("y").to_numpy().astype(np.int64), rule, deepest - int(depth[node]), node)
            return pa.table([pa.array([node], pa.int64()), pa.array([_pack(found)], pa.binary()), pa.array([bool(found["feature"][0] < 0)])],
                            names=["node", "tree", "leaf"])

        return (data.mapInArrow(assign, "node long, bins binary, y int").groupBy("node")
                .applyInArrow(finish, "node long, tree binary, leaf boolean").checkpoint())


class DeepTreeModel:
    def __init__(self, cuts: list[np.ndarray], top: dict[str, np.ndarray], open_: np.ndarray, branches: DataFrame):
        self.cuts, self.top, self.open, self.branches = cuts, top, open_, branches

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows meet their branch in a task, the branch first; no group is held."""
        cuts, top, open_ = self.cuts, self.top, self.open
        tree = (top["feature"], top["cut"], top["left"])
        rest = [c for c in df.columns if c != "features"]
        rows = df.select(vector_to_array("features").alias("x"), F.struct(F.lit(1).alias("__one"), *[F.col(f"`{c}`") for c in rest]).alias("rest"))
        kind = rows.schema["rest"].dataType
        routed = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("rest", kind), T.StructField("key", T.LongType()),
                               T.StructField("node", T.LongType())])
        scored = T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("rest", kind), T.StructField("prediction", T.DoubleType()),
                               T.StructField("shares", T.ArrayType(T.DoubleType()))])

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    node = route(bin_rows(_matrix(b.column(0), b.num_rows), cuts), *tree)
                    key = np.where(open_[node], node, -1 - np.arange(len(node)) % SPREAD)
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(key), pa.array(node)], names=["x", "rest", "key", "node"])

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, branch = None, None
            for b in batches:
                key, packed = b.column(2).to_numpy(), b.column(4)
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else []
                for lo, hi in zip(first, [*first[1:], len(key)]):
                    if packed[int(lo)].is_valid:
                        at, branch = key[lo], dict(np.load(io.BytesIO(packed[int(lo)].as_py())))
                        lo += 1
                    if lo == hi:
                        continue
                    part = b.slice(lo, hi - lo)
                    if key[lo] >= 0:
                        if at != key[lo]:
                            raise RuntimeError(f"branch {key[lo]} is missing")
                        c = branch["counts"][route(bin_rows(_matrix(part.column(0), len(part)), cuts), branch["feature"], branch["cut"], branch["left"])]
                    else:
                        c = top["counts"][part.column(3).to_numpy()]
                    shares = pa.array((c / c.sum(axis=1, keepdims=True)).tolist(), pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(c.argmax(axis=1).astype(float)), shares],
                                                     names=["x", "rest", "prediction", "shares"])

        trees = self.branches.select(F.lit(None).cast(routed["x"].dataType).alias("x"), F.lit(None).cast(kind).alias("rest"), F.col("node").alias("key"),
                                     "node", "tree")
        both = rows.mapInArrow(assign, routed).withColumn("tree", F.lit(None).cast("binary")).unionByName(trees)
        dealt = both.repartition("key").sortWithinPartitions("key", F.col("tree").isNull())
        return dealt.mapInArrow(score, scored).select(array_to_vector("x").alias("features"), *[F.col(f"rest.`{c}`").alias(c) for c in rest],
                                                      "prediction", array_to_vector("shares").alias("probability"))

    def save(self, path: str) -> None:
        self.branches.write.mode("overwrite").parquet(f"{path}/branches")
        meta = {"cuts": [c.tolist() for c in self.cuts], "top": {k: v.tolist() for k, v in self.top.items()}, "open": self.open.tolist()}
        self.branches.sparkSession.createDataFrame([(json.dumps(meta),)], "m string").coalesce(1).write.mode("overwrite").text(f"{path}/top")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "DeepTreeModel":
        m = json.loads(spark.read.text(f"{path}/top").first()[0])
        return DeepTreeModel([np.array(c) for c in m["cuts"]], {k: np.array(v) for k, v in m["top"].items()}, np.array(m["open"]),
                             spark.read.parquet(f"{path}/branches"))
