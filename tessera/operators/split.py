"""SPL-1/2 (deterministic split), SCL-1 (standardisation), PCA-1."""

from __future__ import annotations

import math

from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .profile import q


def split_hash(key_cols: list[str], seed: int = 42) -> Column:
    """A uniform number in [0, 1) from the row key: the first 32 bits of
    ``md5(seed|key...)``. Independent of partitioning and engine."""
    s = F.concat_ws("|", F.lit(str(seed)), *[F.col(q(c)).cast("string") for c in key_cols])
    return F.conv(F.substring(F.md5(s), 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def split(df: DataFrame, key_cols: list[str] | None = None, test: float = 0.2, seed: int = 42,
          col: str = "is_test") -> DataFrame:
    """SPL-1: mark ~``test`` of the rows as test rows (no shuffle, no sort)."""
    keys = key_cols or df.columns
    return df.withColumn(col, split_hash(keys, seed) < F.lit(test))


def row_hash(key_cols: list[str], seed: int = 42) -> Column:
    """``md5(seed|key...)`` as 32 hex digits."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(q(c)).cast("string") for c in key_cols]))


def smallest(df: DataFrame, name: Column, k: int, digits: int = 4) -> tuple[Column, int]:
    """Condition that holds for the rows whose hex string ``name`` (32 digits) is
    among the ``k`` smallest, and how many rows beyond k it holds for (only equal
    strings, which it can't tell apart).

    The k-th smallest is found by refining a histogram of 16 ** digits buckets: a
    pass counts the rows of the bucket that holds it by their next digits, until
    the bucket is taken whole. Nothing is sorted or shuffled but the counts."""
    if k <= 0:
        return F.lit(False), 0
    prefix, rest = "", k
    while True:
        own = df.where(F.substring(name, 1, len(prefix)) == prefix) if prefix else df
        part = F.substring(name, len(prefix) + 1, digits)
        counts = sorted((r["part"], r["count"]) for r in own.groupBy(part.alias("part")).count().collect())
        for part_, n in counts:
            if rest <= n:
                prefix += part_
                break
            rest -= n
        else:      # fewer rows than k
            return F.lit(True), 0
        if rest == n or len(prefix) >= 32:
            return F.substring(name, 1, len(prefix)) <= prefix, n - rest


def exact_split(df: DataFrame, key_cols: list[str] | None = None, test: float = 0.2, seed: int = 42,
                col: str = "is_test") -> DataFrame:
    """SPL-1 with the exact size: the ``ceil(test n)`` rows of the smallest row
    hash are test rows. Rows of equal keys are told apart by a second hash, of
    their place in a checkpointed table; which of them are taken is arbitrary."""
    name = row_hash(key_cols or df.columns, seed)
    k = math.ceil(test * df.count())
    taken, over = smallest(df, name, k)
    if not over:
        return df.withColumn(col, taken)
    ensure_checkpoint_dir(df.sparkSession)
    tie = "__tie"
    while tie in df.columns:
        tie += "_"
    placed = df.withColumn(tie, F.monotonically_increasing_id().cast("string")).checkpoint()
    # 16 digits of the row, 16 of its place: equal keys stay neighbours
    second = F.concat(F.substring(name, 1, 16), F.substring(F.md5(F.concat_ws("|", name, F.col(tie))), 1, 16))
    return placed.withColumn(col, smallest(placed, second, k)[0]).drop(tie)


def fit_scaler(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """SCL-1: mean and population std (constant -> 1) in one aggregate."""
    if not cols:
        return {}
    r = df.agg(*[e for c in cols for e in (F.avg(F.col(q(c)).cast("double")).alias(f"m|{c}"),
                                           F.stddev_pop(F.col(q(c)).cast("double")).alias(f"s|{c}"))]).first()
    return {c: (r[f"m|{c}"] or 0.0, r[f"s|{c}"] if r[f"s|{c}"] else 1.0) for c in cols}


def scale(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[((F.col(q(c)).cast("double") - params[c][0]) / params[c][1]).alias(c)
                       if c in params else F.col(q(c)) for c in df.columns])


def fit_pca(df: DataFrame, cols: list[str], k: int = 10) -> dict:
    """PCA-1: components of the centred features (MLlib does not centre),
    sign fixed so that the largest |loading| of each component is positive."""
    means = {c: m for c, (m, _) in fit_scaler(df, cols).items()}
    plain = [f"__x{i}" for i in range(len(cols))]
    centred = df.select(*[(F.col(q(c)).cast("double") - means[c]).alias(x) for c, x in zip(cols, plain)])
    vec = VectorAssembler(inputCols=plain, outputCol="__v", handleInvalid="keep").transform(centred)
    model = PCA(k=min(k, len(cols)), inputCol="__v", outputCol="__p").fit(vec)
    pc = model.pc.toArray()          # d x k, small
    comps = []
    for j in range(pc.shape[1]):
        col = pc[:, j]
        i = max(range(len(col)), key=lambda t: abs(col[t]))
        comps.append([float(v) * (1.0 if col[i] >= 0 else -1.0) for v in col])
    return {"cols": cols, "means": means, "components": comps,
            "explained_variance": [float(v) for v in model.explainedVariance]}


def pca_transform(df: DataFrame, params: dict, keep: list[str] = (), prefix: str = "pc") -> DataFrame:
    """Projection as plain column arithmetic (k dot products), no UDF."""
    cols, means = params["cols"], params["means"]
    outs = []
    for j, comp in enumerate(params["components"]):
        e = None
        for c, w in zip(cols, comp):
            t = (F.col(q(c)).cast("double") - F.lit(means[c])) * F.lit(w)
            e = t if e is None else e + t
        outs.append(e.alias(f"{prefix}{j}"))
    return df.select(*[F.col(q(c)) for c in keep], *outs)


__all__ = ["split", "split_hash", "exact_split", "smallest", "row_hash", "fit_scaler", "scale", "fit_pca", "pca_transform",
           "array_to_vector", "vector_to_array"]
