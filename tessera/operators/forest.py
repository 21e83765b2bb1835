"""MC-2 / MC-3 on many rows: forests whose trees grow in tasks.

MLlib grows all trees of a forest level by level on the driver: without a depth limit
the driver holds about as many nodes as rows times trees, and every group of them is a
pass over the rows. Here a task grows a whole tree, or the branch of one: the nodes of
more than ``local`` rows are split by distributed histograms for all trees of a round
in the same pass, then every row goes, packed, to the branches it was drawn for. The
trees are a checkpointed table; scoring sends the rows to them by a shuffle and sums the
shares of each row. The driver keeps the tops (rows / ``local`` nodes a tree).

Draws of rows and the features of a node come from hashes, so they don't depend on
partitions. Thresholds are those of ``deep_tree``; leaves are not merged, as in the
reference, since the shares of all trees are averaged.
"""

from __future__ import annotations

import io
import json
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir
from .deep_tree import SAMPLE, Rule, _bytes, _matrix, bin_rows, candidates, grow, route
from .logistic import sum_arrays

LOCAL = 200_000             # rows of a branch that one task grows
ROUND_BYTES = 1_000_000_000  # packed rows that a round of trees shuffles
CHUNK_ROWS = 1_000_000      # rows times trees of a chunk whose shares one task sums
GROUP_ROWS = 500_000        # scored rows that meet one branch in a task


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of 64-bit numbers."""
    for m in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(m)
    return x ^ (x >> np.uint64(31))


def times_drawn(row: np.ndarray, tree: int, seed: int, share: float, bootstrap: bool) -> np.ndarray:
    """How often a tree takes each row: Poisson(share) with replacement, else 0 or 1."""
    if not bootstrap and share >= 1:
        return np.ones(len(row), np.int64)
    salt = mix(np.array([(tree + 1) * 0x9E3779B97F4A7C15 + seed & (2**64 - 1)], np.uint64))
    u = (mix(row.astype(np.uint64) ^ salt) >> np.uint64(11)).astype(float) / 2**53
    if not bootstrap:
        return (u < share).astype(np.int64)
    reach = np.cumsum([math.exp(-share) * share**k / math.factorial(k) for k in range(20)])
    return np.searchsorted(reach, u, "right")


class DrawnRule(Rule):
    """The rule of a node that looks at ``subset`` features of its own; only these are counted."""

    def drawn(self, names: list[tuple]) -> np.ndarray:
        d, out = len(self.widths), np.full(len(names), self.seed, np.uint64)
        for part in np.array(names, np.int64).reshape(len(names), -1).T:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + part.astype(np.uint64) + np.uint64(1))
        order = mix(out[:, None] + (np.arange(d, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD1B54A32D192ED03))
        return np.sort(np.argsort(order, axis=1, kind="stable")[:, :self.subset], axis=1)

    def best(self, hist: np.ndarray, names: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From the counts of all features, cut to the drawn ones."""
        own, wide = self.drawn(names), max(self.widths)
        at = np.minimum(self.start[own][:, :, None] + np.arange(wide), self.size - 1)
        cells = hist[np.arange(len(hist))[:, None, None], at] * (np.arange(wide) < np.array(self.widths)[own][:, :, None])[..., None]
        return self._choose(cells.swapaxes(2, 3), own)

    def split(self, bins: np.ndarray, y: np.ndarray, slot: np.ndarray, names: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own, wide, c = self.drawn(names), max(self.widths), self.n_classes
        m = own.shape[1]
        cell = ((slot[:, None] * m + np.arange(m)) * c + y[:, None]) * wide + np.take_along_axis(bins, own[slot], axis=1)
        return self._choose(np.bincount(cell.ravel(), minlength=len(names) * m * c * wide).reshape(len(names), m, c, wide), own)

    def cells(self) -> int:
        return min(self.subset, len(self.widths)) * max(self.widths) * self.n_classes

    def _choose(self, cells: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells are (node, feature, class, bin): the sums over classes run along whole rows of bins."""
        left = cells.cumsum(axis=3, dtype=float)
        total = left[:, 0, :, -1]
        right = total[:, None, :, None] - left
        n, nl, nr = total.sum(axis=1), left.sum(axis=2), right.sum(axis=2)
        gain = (left * left).sum(axis=2) / np.maximum(nl, 1) + (right * right).sum(axis=2) / np.maximum(nr, 1)
        gain -= ((total * total).sum(axis=1) / np.maximum(n, 1))[:, None, None]
        gain[(nl < self.min_rows) | (nr < self.min_rows)] = -1
        rows, flat = np.arange(len(own)), gain.reshape(len(own), -1)
        at = flat.argmax(axis=1)
        j, cut = np.divmod(at, cells.shape[3])
        good = flat[rows, at] > 1e-12 * np.maximum(n, 1)
        return np.where(good, own[rows, j], -1), cut, left[rows, j, :, cut].astype(np.int64)


def _pack(tree: dict[str, np.ndarray]) -> bytes:
    buf = io.BytesIO()
    np.savez_compressed(buf, **tree)
    return buf.getvalue()


def _runs(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) of every value."""
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        if len(part):
            yield int(key[part[0]]), part


class Forest:
    """A classification forest; ``subset``: features a node may split on ("all", "sqrt",
    "log2" or a share), ``share``: rows drawn for a tree."""

    def __init__(self, n_classes: int, trees: int = 100, max_depth: int = 30, min_rows: int = 1, subset: str = "sqrt",
                 bootstrap: bool = True, share: float = 1.0, seed: int = 42, local: int = LOCAL, round_bytes: int = ROUND_BYTES):
        self.n_classes, self.trees, self.max_depth, self.min_rows, self.subset = max(2, n_classes), trees, max_depth, min_rows, subset
        self.bootstrap, self.share, self.seed, self.local, self.round_bytes = bootstrap, share, seed, local, round_bytes

    def _subset(self, d: int) -> int:      # as MLlib
        named = {"all": d, "sqrt": math.ceil(math.sqrt(d)), "log2": max(1, math.ceil(math.log2(d)))}
        return named[self.subset] if self.subset in named else max(1, math.ceil(float(self.subset) * d))

    def fit(self, df: DataFrame) -> "ForestModel":
        ensure_checkpoint_dir(df.sparkSession)
        rows = df.select(vector_to_array("features").alias("x"), F.col("label").cast("int").alias("y"))
        rows = rows.withColumn("row", F.xxhash64("x", "y", F.monotonically_increasing_id()))
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit")
        seen = rows.select("x").sample(SAMPLE / n, self.seed).collect() if n > SAMPLE else rows.select("x").collect()
        x = np.array([r["x"] for r in seen])
        cuts = [candidates(x[:, j]) for j in range(x.shape[1])]
        rule = DrawnRule([len(c) + 1 for c in cuts], self.n_classes, self.min_rows, False, self._subset(len(cuts)), self.seed)

        def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if b.num_rows:
                    found = bin_rows(_matrix(b.column(0), b.num_rows), cuts)
                    yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in found], pa.binary()), b.column(1), b.column(2)],
                                                     names=["bins", "y", "row"])

        # checkpointed: a lost block must not come back with other draws
        data = rows.mapInArrow(binned, "bins binary, y int, row long").checkpoint().persist(StorageLevel.MEMORY_AND_DISK)
        c, tops, branches = self.n_classes, [], []
        at_once = max(1, int(self.round_bytes // (n * (len(cuts) + 5))))
        try:
            whole = sum_arrays(data, (c,), lambda b: np.bincount(b.column(1).to_numpy(), minlength=c).astype(float)).astype(np.int64)
            for lo in range(0, self.trees, at_once):
                trees = list(range(lo, min(lo + at_once, self.trees)))
                own = self._tops(data, rule, trees, whole)
                branches.append(self._branches(data, rule, dict(zip(trees, own))))
                tops += [t for t, _ in own]
        finally:
            data.unpersist()
        return ForestModel(cuts, c, tops, reduce(DataFrame.unionByName, branches))

    def _draw(self, row: np.ndarray, tree: int) -> np.ndarray:
        return times_drawn(row, tree, self.seed, self.share, self.bootstrap)

    def _tops(self, data: DataFrame, rule: DrawnRule, trees: list[int], whole: np.ndarray) -> list[tuple[dict[str, np.ndarray], list[int]]]:
        """Per tree the nodes with more than ``local`` rows and their children, and the depth of each node."""
        draw, c = self._draw, self.n_classes
        found = {t: {"feature": [-1], "cut": [0], "left": [0], "counts": [whole], "depth": [0]} for t in trees}
        open_ = [(t, 0) for t in trees] if whole.sum() > self.local else []
        per_pass = max(1, 4_000_000 // (rule.size * c))
        while open_:
            level, open_ = open_, []
            for lo in range(0, len(level), per_pass):
                now = level[lo:lo + per_pass]
                shape, slots = {}, {}
                for t in {t for t, _ in now}:
                    shape[t] = tuple(np.array(found[t][k], np.int64) for k in ("feature", "cut", "left"))
                    slots[t] = np.full(len(found[t]["feature"]), -1, np.int64)
                for i, (t, node) in enumerate(now):
                    slots[t][node] = i

                def count(b: pa.RecordBatch) -> np.ndarray:
                    bins, y, row = _bytes(b.column(0), b.num_rows), b.column(1).to_numpy(), b.column(2).to_numpy()
                    total = np.zeros((len(now), rule.size, c))
                    for t, own in slots.items():
                        slot = own[route(bins, *shape[t])]
                        use = np.repeat(np.arange(len(y)), np.where(slot >= 0, draw(row, t), 0))
                        first = own[own >= 0].min()      # the nodes of a tree follow each other
                        some = int((own >= 0).sum())
                        total[first:first + some] += rule.histogram(bins[use], y[use], slot[use] - first, some)
                    return total

                hist = sum_arrays(data, (len(now), rule.size, c), count).astype(np.int64)
                feature, cut, part = rule.best(hist, [(t, found[t]["depth"][node], node) for t, node in now])
                for i, (t, node) in enumerate(now):
                    f = found[t]
                    f["counts"][node] = hist[i, :rule.widths[0]].sum(axis=0)
                    if feature[i] < 0:
                        continue
                    f["feature"][node], f["cut"][node], f["left"][node] = int(feature[i]), int(cut[i]), len(f["feature"])
                    for side in (part[i], f["counts"][node] - part[i]):
                        if side.sum() > self.local and side.max() < side.sum() and f["depth"][node] + 1 < self.max_depth:
                            open_.append((t, len(f["feature"])))
                        for k, v in (("feature", -1), ("cut", 0), ("left", 0), ("counts", side), ("depth", f["depth"][node] + 1)):
                            f[k].append(v)
            open_.sort()
        return [({k: np.array(f[k], np.int64) for k in ("feature", "cut", "left", "counts")}, f["depth"]) for f in found.values()]

    def _branches(self, data: DataFrame, rule: DrawnRule, tops: dict[int, tuple[dict[str, np.ndarray], list[int]]]) -> DataFrame:
        """(tree, node, packed) of every branch that a task grows."""
        draw, deepest, grows = self._draw, self.max_depth, {}
        for t, (top, depth) in tops.items():
            size = top["counts"].sum(axis=1)
            grows[t] = (top["feature"] < 0) & (size <= self.local) & (top["counts"].max(axis=1) < size) & (np.array(depth) < self.max_depth)
        parts = min(sum(int(g.sum()) for g in grows.values()), 4 * data.sparkSession.sparkContext.defaultParallelism) or 1
        parts = max(parts, int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                bins, y, row = _bytes(b.column(0), b.num_rows), b.column(1).to_numpy().astype(np.int32), b.column(2).to_numpy()
                out = []
                for t, (top, _) in tops.items():
                    times = draw(row, t)
                    node = route(bins, top["feature"], top["cut"], top["left"])
                    kept = np.flatnonzero((times > 0) & grows[t][node])
                    for at, places in _runs(node[kept]):
                        use = kept[places]
                        out.append((t, at, bins[use].tobytes(), y[use].tobytes(), times[use].astype(np.uint8).tobytes()))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), (pa.int32(), pa.int64(), *[pa.binary()] * 3))],
                                                     names=["tree", "node", "bins", "y", "times"])

        def joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
            return np.frombuffer(b"".join(column.to_pylist()), kind)

        def finish(table: pa.Table) -> pa.Table:
            t, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
            times = joined(table.column("times"), np.uint8)
            rows = np.repeat(np.arange(len(times)), times)
            bins, y = joined(table.column("bins"), np.uint8).reshape(len(times), -1), joined(table.column("y"), np.int32)
            found = grow(bins[rows], y[rows].astype(np.int64), rule, deepest - int(tops[t][1][node]), t << 32 | node, False)
            found["counts"] = found["counts"].astype(np.int32)
            return pa.table([pa.array([t], pa.int32()), pa.array([node], pa.int64()), pa.array([_pack(found)], pa.binary())],
                            names=["tree", "node", "packed"])

        return (data.mapInArrow(assign, "tree int, node long, bins binary, y binary, times binary").repartition(parts, "tree", "node")
                .groupBy("tree", "node").applyInArrow(finish, "tree int, node long, packed binary").checkpoint())


class ForestModel:
    def __init__(self, cuts: list[np.ndarray], n_classes: int, tops: list[dict[str, np.ndarray]], branches: DataFrame):
        self.cuts, self.n_classes, self.tops, self.branches = cuts, n_classes, tops, branches

    def transform(self, df: DataFrame) -> DataFrame:
        """Chunks of rows send their bins to every branch they reach; the shares come
        back to the chunk and are summed there."""
        ensure_checkpoint_dir(df.sparkSession)
        cuts, tops, c = self.cuts, self.tops, self.n_classes
        rest = [x for x in df.columns if x != "features"]
        rows = df.select(vector_to_array("features").alias("x"), F.struct(F.lit(1).alias("__one"), *[F.col(f"`{x}`") for x in rest]).alias("rest"))
        kind = rows.schema["rest"].dataType
        x_rest = [T.StructField("x", T.ArrayType(T.DoubleType())), T.StructField("rest", kind)]
        size = max(1, CHUNK_ROWS // len(tops))

        def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen, part = 0, TaskContext.get().partitionId() << 33
            for b in batches:
                at = seen + np.arange(b.num_rows)
                seen += b.num_rows
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part + at // size, pa.int64()), pa.array(at % size, pa.int32())],
                                                 names=["x", "rest", "chunk", "pos"])

        numbered = rows.mapInArrow(number, T.StructType([*x_rest, T.StructField("chunk", T.LongType()), T.StructField("pos", T.IntegerType())])).checkpoint()
        salts = max(1, math.ceil(numbered.count() / GROUP_ROWS))

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                if not b.num_rows:
                    continue
                bins, chunk, pos = bin_rows(_matrix(b.column(0), b.num_rows), cuts), b.column(1).to_numpy(), b.column(2).to_numpy()
                for t, top in enumerate(tops):
                    node, out = route(bins, top["feature"], top["cut"], top["left"]), []
                    for k, own in _runs(chunk):
                        for at, places in _runs(node[own]):
                            use = own[places]
                            out.append((t, at, k % salts, k, pos[use].tobytes(), bins[use].tobytes()))
                    yield pa.RecordBatch.from_arrays([pa.array(v, a) for v, a in zip(zip(*out), (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                                     names=["tree", "node", "salt", "chunk", "pos", "bins"])

        def score(sent: pa.Table, branch: pa.Table) -> pa.Table:
            if not sent.num_rows:
                return pa.table([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.binary())], names=["chunk", "pos", "shares"])
            packed = [np.frombuffer(v, np.uint8).reshape(-1, len(cuts)) for v in sent.column("bins").to_pylist()]
            if branch.num_rows:
                tree = dict(np.load(io.BytesIO(branch.column("packed")[0].as_py())))
                counts = [tree["counts"][route(bins, tree["feature"], tree["cut"], tree["left"])] for bins in packed]
            else:       # a leaf of the top
                end = tops[sent.column("tree")[0].as_py()]["counts"][sent.column("node")[0].as_py()]
                counts = [np.tile(end, (len(bins), 1)) for bins in packed]
            return pa.table([sent.column("chunk"), sent.column("pos"), pa.array([(v / v.sum(axis=1, keepdims=True)).tobytes() for v in counts], pa.binary())],
                            names=["chunk", "pos", "shares"])

        def add(own: pa.Table, shares: pa.Table) -> pa.Table:
            total = np.zeros((size, c))
            order = np.lexsort((shares.column("tree").to_numpy(), shares.column("node").to_numpy())) if shares.num_rows else []
            pos, found = shares.column("pos").to_pylist(), shares.column("shares").to_pylist()
            for i in order:      # always in the same order: sums of the same numbers
                total[np.frombuffer(pos[i], np.int32)] += np.frombuffer(found[i]).reshape(-1, c)
            mean = total[own.column("pos").to_numpy()] / len(tops)
            return pa.table([own.column("x"), own.column("rest"), pa.array(mean.argmax(axis=1).astype(float)), pa.array(mean.tolist(), pa.list_(pa.float64()))],
                            names=["x", "rest", "prediction", "shares"])

        sent = numbered.select("x", "chunk", "pos").mapInArrow(send, "tree int, node long, salt int, chunk long, pos binary, bins binary")
        trees = self.branches.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        by = ("tree", "node", "salt")

        def labelled(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            out = score(left, right)
            return out.append_column("tree", pa.array([key[0].as_py()] * out.num_rows, pa.int32())).append_column("node", pa.array([key[1].as_py()] * out.num_rows, pa.int64()))

        scored = sent.groupBy(*by).cogroup(trees.groupBy(*by)).applyInArrow(labelled, "chunk long, pos binary, shares binary, tree int, node long")
        out = (numbered.groupBy("chunk").cogroup(scored.groupBy("chunk"))
               .applyInArrow(add, T.StructType([*x_rest, T.StructField("prediction", T.DoubleType()), T.StructField("shares", T.ArrayType(T.DoubleType()))])))
        return out.select(array_to_vector("x").alias("features"), *[F.col(f"rest.`{x}`").alias(x) for x in rest],
                          "prediction", array_to_vector("shares").alias("probability"))

    def save(self, path: str) -> None:
        self.branches.write.mode("overwrite").parquet(f"{path}/branches")
        meta = {"cuts": [v.tolist() for v in self.cuts], "n_classes": self.n_classes, "tops": [{k: v.tolist() for k, v in t.items()} for t in self.tops]}
        self.branches.sparkSession.createDataFrame([(json.dumps(meta),)], "m string").coalesce(1).write.mode("overwrite").text(f"{path}/tops")

    @staticmethod
    def load(spark: SparkSession, path: str) -> "ForestModel":
        m = json.loads(spark.read.text(f"{path}/tops").first()[0])
        return ForestModel([np.array(v) for v in m["cuts"]], m["n_classes"], [{k: np.array(v, np.int64) for k, v in t.items()} for t in m["tops"]],
                           spark.read.parquet(f"{path}/branches"))
