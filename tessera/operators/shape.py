"""SKW-1..3 (Yeo-Johnson de-skewing) and OUT-1..4 (outlier capping)."""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.power import clip, log_scale, yeo_johnson, yeo_johnson_scaled
from .profile import ColumnProfile, column_stats, distinct_bounds, q, quantiles

COARSE_GRID = [i / 2 for i in range(-10, 11)]      # -5.0 .. 5.0, step 0.5


def column_range(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    r = df.agg(*[e for j, c in enumerate(cols) for e in (F.min(F.col(q(c)).cast("double")).alias(f"a{j}"),
                                                         F.max(F.col(q(c)).cast("double")).alias(f"b{j}"))]).first()
    return {c: (r[f"a{j}"], r[f"b{j}"]) for j, c in enumerate(cols) if r[f"a{j}"] is not None}


def yj_loglik_grid(df: DataFrame, grids: dict[str, list[float]],
                   ranges: dict[str, tuple[float, float]] | None = None) -> dict[str, list[tuple[float, float]]]:
    """For every column and candidate lambda, the Yeo-Johnson log-likelihood
    ``-n/2 ln var_pop(yj(x)) + (l-1) sum(sign(x) ln(1+|x|))`` - all pairs in
    one aggregate pass. With ``ranges`` (least and largest value per column) the
    powers are scaled down inside, so that no lambda overflows."""
    # project every transformed value once, then aggregate plain columns (an
    # expression inside a moment aggregate is re-evaluated per buffer update)
    proj, aggs, scales = [], [], {}
    for j, (c, lams) in enumerate(grids.items()):
        x = F.col(q(c)).cast("double")
        scales[c] = [log_scale(lam, *ranges[c]) if ranges and c in ranges else 0.0 for lam in lams]
        proj += [x.alias(f"x{j}"), (F.signum(x) * F.log1p(F.abs(x))).alias(f"s{j}")]
        proj += [yeo_johnson_scaled(x, lam, k).alias(f"y{j}_{i}") for i, (lam, k) in enumerate(zip(lams, scales[c]))]
        aggs += [F.count(f"x{j}").alias(f"n{j}"), F.sum(f"s{j}").alias(f"s{j}")]
        aggs += [F.var_pop(f"y{j}_{i}").alias(f"v{j}_{i}") for i in range(len(lams))]
    r = df.select(*proj).agg(*aggs).first()
    out = {}
    for j, (c, lams) in enumerate(grids.items()):
        n, s = r[f"n{j}"], r[f"s{j}"] or 0.0
        res = []
        for i, lam in enumerate(lams):
            v = r[f"v{j}_{i}"]
            ok = v is not None and v > 0 and math.isfinite(v)
            res.append((lam, -n / 2 * (math.log(v) + 2 * scales[c][i]) + (lam - 1) * s if ok else -math.inf))
        out[c] = res
    return out


def fit_yeo_johnson(df: DataFrame, cols: list[str], rounds: int = 5, points: int = 17,
                    grid: list[float] | None = None) -> dict[str, dict]:
    """SKW-2: lambda by grid search; while the best point of a column lies on the
    edge of its grid, the grid moves on and widens, so lambda has no bound; then
    ``rounds`` refinements around the best point (each a single pass over the
    persisted columns); then the mean and population std of the transformed
    column for standardisation."""
    if not cols:
        return {}
    data = df.select(*[F.col(q(c)).cast("double").alias(c) for c in cols]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        grid = grid or COARSE_GRID
        ranges = column_range(data, cols)
        steps = {c: grid[1] - grid[0] for c in cols}

        def search(grids):
            found = yj_loglik_grid(data, grids, ranges)
            return {c: max(v, key=lambda t: (t[1], -abs(t[0])))[0] for c, v in found.items()}

        best = search({c: grid for c in cols})
        grids = {c: list(grid) for c in cols}
        half = len(grid) // 2
        for _ in range(64):
            edge = [c for c in cols if best[c] in (grids[c][0], grids[c][-1]) and c in ranges and ranges[c][0] < ranges[c][1]]
            if not edge:
                break
            for c in edge:
                steps[c] *= 2
                grids[c] = [best[c] + (i - half) * steps[c] for i in range(len(grid))]
            best.update(search({c: grids[c] for c in edge}))
        half = (points - 1) // 2
        for _ in range(rounds):
            steps = {c: steps[c] * 2 / (points - 1) for c in cols}
            best = search({c: [best[c] + (i - half) * steps[c] for i in range(points)] for c in cols})
        scale = {c: log_scale(best[c], *ranges[c]) if c in ranges else 0.0 for c in cols}
        ys = data.select(*[power_column(F.col(q(c)), best[c], scale[c]).alias(f"y{j}") for j, c in enumerate(cols)])
        r = ys.agg(*[e for j in range(len(cols)) for e in (F.avg(f"y{j}").alias(f"m{j}"), F.stddev_pop(f"y{j}").alias(f"s{j}"))]).first()
    finally:
        data.unpersist()
    return {c: {"lambda": best[c], "mean": r[f"m{j}"], "std": r[f"s{j}"] or 1.0, "log_scale": scale[c]} for j, c in enumerate(cols)}


def power_column(x, lam: float, scale: float):
    """The transformed column; beyond harmless powers its scaled form, which
    standardisation makes equal."""
    return yeo_johnson(x, lam) if scale == 0 else yeo_johnson_scaled(x, lam, scale)


def yeo_johnson_transform(df: DataFrame, params: dict[str, dict]) -> DataFrame:
    """SKW-3: transform and standardise (mean 0, population std 1)."""
    out = []
    for c in df.columns:
        if c in params:
            p = params[c]
            std = p["std"] if p["std"] else 1.0
            out.append(((power_column(F.col(q(c)).cast("double"), p["lambda"], p.get("log_scale", 0.0)) - p["mean"]) / std).alias(c))
        else:
            out.append(F.col(q(c)))
    return df.select(*out)


def skewed_columns(prof: dict[str, ColumnProfile], cols: list[str], threshold: float = 0.5) -> list[str]:
    return [c for c in cols if prof[c].skew is not None and abs(prof[c].skew) > threshold]


def fit_outliers(df: DataFrame, cols: list[str], method: str = "auto", iqr_multiplier: float = 1.5,
                 z_threshold: float = 3.0, prof: dict[str, ColumnProfile] | None = None) -> dict[str, dict]:
    """OUT-1..3: per column method and bounds (skip < 10 non-null values).
    Moments from one aggregate, quartiles from one aggregate, outlier counts
    from one aggregate."""
    if not cols:
        return {}
    prof = prof or column_stats(df, cols)
    chosen = {}
    for c in cols:
        p = prof[c]
        if p.non_null < 10:
            continue
        m = method
        if method == "auto":
            m = "iqr" if p.non_null < 500 or abs(p.skew or 0.0) > 1 else "zscore"
        chosen[c] = m
    iqr_cols = [c for c, m in chosen.items() if m == "iqr"]
    known = distinct_bounds({c: prof[c] for c in iqr_cols})
    qs = quantiles(df, iqr_cols, [0.25, 0.75], known) if iqr_cols else {}
    params = {}
    for c, m in chosen.items():
        if m == "iqr":
            q1, q3 = qs[c]
            lo, hi = q1 - iqr_multiplier * (q3 - q1), q3 + iqr_multiplier * (q3 - q1)
            params[c] = {"method": "IQR Capping", "lower": lo, "upper": hi}
        else:
            p = prof[c]
            params[c] = {"method": "Z-score Capping", "lower": p.mean - z_threshold * p.std,
                         "upper": p.mean + z_threshold * p.std}
    if params:
        r = df.agg(*[F.count_if((F.col(q(c)) < p["lower"]) | (F.col(q(c)) > p["upper"])).alias(c)
                     for c, p in params.items()]).first()
        for c in params:
            params[c]["outliers_capped"] = r[c]
    return params


def cap_outliers(df: DataFrame, params: dict[str, dict]) -> DataFrame:
    """OUT-2/3 apply: NULL-preserving clip to the fitted bounds."""
    return df.select(*[clip(F.col(q(c)).cast("double"), params[c]["lower"], params[c]["upper"]).alias(c)
                       if c in params else F.col(q(c)) for c in df.columns])


def outlier_report(spark, params: dict[str, dict]) -> DataFrame:
    """OUT-4: ``(column, method, outliers_capped)``."""
    return spark.createDataFrame([(c, p["method"], p["outliers_capped"]) for c, p in params.items()],
                                 "column string, method string, outliers_capped bigint")
