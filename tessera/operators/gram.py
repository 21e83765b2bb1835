"""ANA-8 of wide tables: pairwise-complete correlation from masked Gram blocks.

With X the centred values (0 where a value is missing) and M the mask of present
ones, the four products MᵀM, XᵀM, (X²)ᵀM and XᵀX hold, for every pair of columns,
the count, both sums, both sums of squares and the sum of products over the rows
where both are present. Every task adds them batch by batch in numpy and sends them
as blocks of ``BLOCK`` x ``BLOCK`` columns; Spark merges the tasks' blocks in rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .profile import q

BLOCK = 128
FAN_IN, ROUNDS = 64, 3      # 64^3 tasks become one block per pair
SCHEMA = "i int, j int, part int, sums binary"


def _row(i: int, j: int, part: int, sums: np.ndarray) -> tuple:
    return i, j, part, np.ascontiguousarray(sums).tobytes()


def _table(rows: list[tuple]) -> pa.Table:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary())
    cols = list(zip(*rows)) if rows else [[]] * 4
    return pa.table([pa.array(list(c), k) for c, k in zip(cols, kinds)], names=["i", "j", "part", "sums"])


def gram(df: DataFrame, cols: list[str], centre: np.ndarray) -> np.ndarray:
    """The four products as one (4, d, d) array."""
    d = len(cols)
    edges = range(0, d, BLOCK)
    data = df.select(*[F.col(q(c)).cast("double").alias(f"c{k}") for k, c in enumerate(cols)])

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, d, d))
        for b in batches:
            x = np.column_stack([b.column(k).to_numpy(zero_copy_only=False) for k in range(d)]).astype(np.float64) - centre
            m = ~np.isnan(x)
            x[~m] = 0.0
            m = m.astype(np.float64)
            total += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        part = TaskContext.get().partitionId()
        for i in edges:
            for j in edges:
                yield from _table([_row(i, j, part, total[:, i:i + BLOCK, j:j + BLOCK])]).to_batches()

    def merge(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s.as_py()) for s in table.column("sums"))
        return _table([_row(table.column("i")[0].as_py(), table.column("j")[0].as_py(), table.column("part")[0].as_py() // FAN_IN, total)])

    rows = data.mapInArrow(sums, SCHEMA)
    for _ in range(ROUNDS):
        rows = rows.groupBy("i", "j", F.floor(F.col("part") / FAN_IN)).applyInArrow(merge, SCHEMA)
    out = np.zeros((4, d, d))
    for r in rows.toLocalIterator():
        block = out[:, r["i"]:r["i"] + BLOCK, r["j"]:r["j"] + BLOCK]
        block += np.frombuffer(bytes(r["sums"])).reshape(block.shape)
    return out


def correlations(df: DataFrame, cols: list[str]) -> np.ndarray:
    """Pearson matrix over the rows where both columns are present; NaN where
    there are less than two of them or a column doesn't vary."""
    means = df.agg(*[F.avg(F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double"))).alias(f"m{k}") for k, c in enumerate(cols)]).first()
    centre = np.array([0.0 if m is None else m for m in means])
    n, s, ss, sp = gram(df, cols, centre)
    with np.errstate(divide="ignore", invalid="ignore"):
        var = ss - s * s / n
        cov = sp - s * s.T / n
        # what is left of a constant column's variance is rounding of its mean
        var[var <= 1e-24 * n * (centre ** 2)[:, None]] = np.nan
        out = cov / np.sqrt(var * var.T)
        out[n < 2] = np.nan
    out = np.clip(out, -1.0, 1.0)
    known = ~np.isnan(np.diag(out))
    out[np.diag_indices(len(cols))] = np.where(known, 1.0, np.nan)
    return out
