"""VIZ-1..10: the data behind every chart, as aggregates over all rows.

Drawing is not built; each function returns the small DataFrame a plotting
front end would draw (bins, density grid, box statistics, top categories,
a seeded sample of points).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .clean import drop_duplicates
from .profile import column_stats, distinct_bounds, is_numeric, q, quantiles, value_counts
from .types import coerce_dates

KDE_POINTS = 200
KDE_CUT = 3.0


def clean_for_charts(df: DataFrame) -> DataFrame:
    """VIZ-1: drop ``^Unnamed`` columns (case-sensitive), drop duplicate rows,
    coerce string columns that parse as dates for > 80 % of rows."""
    df = df.select(*[F.col(q(c)) for c in df.columns if not c.startswith("Unnamed")])
    df = drop_duplicates(df)
    out, _ = coerce_dates(df, threshold=0.8)
    return out


def auto_bins(n: int, lo: float, hi: float, q1: float, q3: float) -> int:
    """numpy's ``bins='auto'``: the smaller of the Sturges and
    Freedman-Diaconis widths (FD only when IQR > 0)."""
    ptp = hi - lo
    if n == 0 or ptp == 0:
        return 1
    sturges = ptp / (math.log2(n) + 1.0)
    fd = 2.0 * (q3 - q1) * n ** (-1.0 / 3.0)
    width = min(fd, sturges) if fd > 0 else sturges
    return max(1, int(math.ceil(ptp / width)))


def bin_edge(i: Column, lo: float, hi: float, nbins: int) -> Column:
    """Left edge of bin ``i`` as ``linspace`` computes it (last edge exact)."""
    step = (hi - lo) / nbins
    return F.when(i >= nbins, F.lit(hi)).otherwise(i.cast("double") * F.lit(step) + F.lit(lo))


def bin_index(x: Column, lo: float, hi: float, nbins: int) -> Column:
    """Equal-width bin of ``x`` with numpy's edge corrections; the last bin
    is closed on the right."""
    if hi == lo:
        return F.when(x.isNotNull(), F.lit(0))
    i0 = F.least(F.floor((x - F.lit(lo)) * F.lit(nbins / (hi - lo))).cast("int"), F.lit(nbins - 1))
    i1 = F.when(x < bin_edge(i0, lo, hi, nbins), i0 - 1).otherwise(i0)
    return F.when((x >= bin_edge(i1 + 1, lo, hi, nbins)) & (i1 != nbins - 1), i1 + 1).otherwise(i1)


# the bin-edge table is broadcast while it has at most this many rows
EDGE_BROADCAST_ROWS = 100_000


def histogram(df: DataFrame, cols: list[str], bins: int | None = None) -> DataFrame:
    """VIZ-2: ``(column, bin, lo, hi, cnt)`` over all non-null rows; bin count
    fitted from (n, min, max, IQR) - one stats pass, one quantile pass, one
    grouped count; empty bins are reported with 0."""
    spark = df.sparkSession
    if not cols:
        return spark.createDataFrame([], "column string, bin int, lo double, hi double, cnt bigint")
    prof = column_stats(df, cols)
    qs = quantiles(df, cols, [0.25, 0.75], distinct_bounds(prof)) if bins is None else {}
    plan = {}
    for c in cols:
        p = prof[c]
        if not p.non_null:
            continue
        nb = bins or auto_bins(p.non_null, p.min, p.max, qs[c][0], qs[c][1])
        plan[c] = (p.min, p.max, nb)
    # bin index in three chained projections: each step is computed once per
    # row instead of being re-expanded inside the next one
    plan_items = list(plan.items())
    xs = df.select(*[F.col(q(c)).cast("double").alias(f"x{j}") for j, (c, _) in enumerate(plan_items)])
    step0, step1, step2 = [], [], []
    for j, (c, (lo, hi, nb)) in enumerate(plan_items):
        x = F.col(f"x{j}")
        if hi == lo:
            step0.append(F.when(x.isNotNull(), F.lit(0)).alias(f"i{j}"))
            step1.append(F.col(f"i{j}"))
            step2.append(F.col(f"i{j}"))
            continue
        step0.append(F.least(F.floor((x - F.lit(lo)) * F.lit(nb / (hi - lo))).cast("int"),
                             F.lit(nb - 1)).alias(f"i{j}"))
        i0 = F.col(f"i{j}")
        step1.append(F.when(x < bin_edge(i0, lo, hi, nb), i0 - 1).otherwise(i0).alias(f"i{j}"))
        i1 = F.col(f"i{j}")
        step2.append(F.when((x >= bin_edge(i1 + 1, lo, hi, nb)) & (i1 != nb - 1), i1 + 1).otherwise(i1)
                     .alias(f"i{j}"))
    xcols = [F.col(f"x{j}") for j in range(len(plan_items))]
    b = xs.select(*xcols, *step0).select(*xcols, *step1).select(*step2)
    stacked = b.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(f"i{j}").alias("bin")) for j, (c, _) in enumerate(plan_items)
    ])).alias("s")).select("s.column", "s.bin")
    counts = stacked.where(F.col("bin").isNotNull()).groupBy("column", "bin").agg(F.count(F.lit(1)).alias("cnt"))
    edges = None
    for c, (lo, hi, nb) in plan.items():
        i = F.col("id").cast("int")
        e = spark.range(nb).select(F.lit(c).alias("column"), i.alias("bin"),
                                   bin_edge(i, lo, hi, nb).alias("lo"), bin_edge(i + 1, lo, hi, nb).alias("hi"))
        edges = e if edges is None else edges.unionByName(e)
    if sum(nb for _, _, nb in plan.values()) <= EDGE_BROADCAST_ROWS:
        edges = F.broadcast(edges)
    return (edges.join(counts, ["column", "bin"], "left")
            .select("column", "bin", "lo", "hi", F.coalesce("cnt", F.lit(0)).alias("cnt")))


def scott_bandwidth(n: int, std: float) -> float:
    """Gaussian KDE bandwidth (Scott's rule, sample std)."""
    return std * n ** (-1.0 / 5.0)


def density(df: DataFrame, col: str, points: int = KDE_POINTS, cut: float = KDE_CUT) -> DataFrame:
    """VIZ-3: Gaussian KDE on ``points`` grid points spanning
    [min - cut*h, max + cut*h]. Evaluated over the ``(value, count)``
    frequency table, so repeated values cost once."""
    spark = df.sparkSession
    p = column_stats(df, [col])[col]
    if not p.non_null or not p.std:
        return spark.createDataFrame([], "column string, point int, x double, density double")
    h = scott_bandwidth(p.non_null, p.std)
    lo, hi = p.min - cut * h, p.max + cut * h
    grid = [lo + (hi - lo) * i / (points - 1) for i in range(points)]
    freq = (df.select(F.col(q(col)).cast("double").alias("v")).where(F.col("v").isNotNull())
            .groupBy("v").agg(F.count(F.lit(1)).alias("cnt")))
    norm = 1.0 / (p.non_null * h * math.sqrt(2 * math.pi))
    # every distinct value meets the grid's literal points; one sum per point, combined before the shuffle
    at = freq.select("v", "cnt", F.posexplode(F.array(*[F.lit(g) for g in grid])).alias("point", "x"))
    term = F.col("cnt") * F.exp(-F.pow((F.col("x") - F.col("v")) / h, 2) / 2)
    sums = at.groupBy("point", "x").agg((F.sum(term) * norm).alias("density"))
    return sums.select(F.lit(col).alias("column"), "point", "x", "density")


def box_summary(df: DataFrame, cols: list[str], whis: float = 1.5) -> DataFrame:
    """VIZ-4: quartiles, whiskers (most extreme values inside whis*IQR) and
    the number of fliers, per column."""
    spark = df.sparkSession
    qs = quantiles(df, cols, [0.25, 0.5, 0.75])
    aggs = []
    for c in cols:
        q1, _, q3 = qs[c]
        if q1 is None:
            continue
        lo, hi = q1 - whis * (q3 - q1), q3 + whis * (q3 - q1)
        x = F.col(q(c)).cast("double")
        inside = (x >= lo) & (x <= hi)
        aggs += [F.min(F.when(inside, x)).alias(f"wl|{c}"), F.max(F.when(inside, x)).alias(f"wh|{c}"),
                 F.count_if(~inside).alias(f"f|{c}")]
    r = df.agg(*aggs).first() if aggs else None
    rows = [(c, *qs[c], r[f"wl|{c}"], r[f"wh|{c}"], r[f"f|{c}"]) for c in cols if qs[c][0] is not None]
    return spark.createDataFrame(rows, "column string, q1 double, median double, q3 double, "
                                       "whisker_low double, whisker_high double, fliers bigint")


def top_categories(df: DataFrame, cols: list[str], k: int = 10, freq: DataFrame | None = None) -> DataFrame:
    """VIZ-5: ``(column, value, cnt, rank)``, the ``k`` most frequent values of
    every column (ties by value). The rank filter becomes a per-task group
    limit before the exchange, so a high-cardinality column ships k rows
    per task, not its whole value set."""
    vc = (freq if freq is not None else value_counts(df, cols)).where(F.col("column").isin(cols))
    w = Window.partitionBy("column").orderBy(F.desc("cnt"), F.asc("value"))
    return (vc.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
            .select("column", "value", "cnt", "rank"))


def sample_order(key_cols: list[str], seed: int = 42) -> Column:
    """A seeded, engine-independent order: md5 of ``seed|key...``."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(q(c)).cast("string") for c in key_cols]))


def hash_sample(df: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """VIZ-9: the ``n`` rows with the smallest seeded key hash (a top-k:
    per-partition top-n, then one merge of at most n rows per partition)."""
    return df.orderBy(sample_order(key_cols, seed)).limit(n)


def pair_sample(df: DataFrame, cols: list[str], key_cols: list[str], n: int = 3000, seed: int = 42,
                max_pairs: int = 3) -> DataFrame:
    """VIZ-6: complete rows of the first ``max_pairs`` pairs of ``cols``,
    ``n`` seeded rows each: ``(pair, x, y, key...)``."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]][:max_pairs]
    out = None
    for a, b in pairs:
        s = hash_sample(df.where(F.col(q(a)).isNotNull() & F.col(q(b)).isNotNull()), n, key_cols, seed) \
            .select(F.lit(f"{a} vs {b}").alias("pair"), F.col(q(a)).cast("double").alias("x"),
                    F.col(q(b)).cast("double").alias("y"), *[F.col(q(k)) for k in key_cols])
        out = s if out is None else out.unionByName(s)
    return out


def target_distribution(df: DataFrame, target: str) -> dict[str, DataFrame]:
    """VIZ-7: counts when the target has < 20 distinct values or isn't numeric,
    otherwise a histogram and a density curve."""
    vc = value_counts(df, [target])
    if vc.count() < 20:
        return {"counts": vc.select(F.col("value").alias(target), "cnt")}
    if not is_numeric(df.schema[target].dataType):   # many classes of text: their counts
        return {"counts": vc.select(F.col("value").alias(target), "cnt")}
    return {"histogram": histogram(df, [target]), "density": density(df, target)}


def chart_data(df: DataFrame, types: dict[str, list[str]], target: str, key_cols: list[str] | None = None,
               text_col: str | None = None) -> dict[str, DataFrame]:
    """VIZ-10: all chart data by name."""
    from .tfidf import word_frequencies
    num, cat = types.get("numerical", []), types.get("categorical", [])
    out = {"num_dist": histogram(df, num[:5]), "box": box_summary(df, num[:6]),
           "cat": top_categories(df, cat[:5]), "target": target_distribution(df, target)}
    if len(num) >= 2 and key_cols:
        out["num_vs_num"] = pair_sample(df, num[:4], key_cols)
    texts = types.get("text", [])
    if text_col or texts:
        out["word_cloud"] = word_frequencies(df, text_col or texts[0])
    return out
