"""Fused column profile, value-frequency table and exact quantiles.

One aggregate pass computes every per-column moment the other operators
need (typing, pruning, imputation, analysis); one shuffle with map-side
combining builds the ``(column, value, cnt)`` frequency table that serves
distinct counts, modes, encoders and top-k charts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import q

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOATING = (T.FloatType, T.DoubleType, T.DecimalType)
TIMESTAMP = (T.TimestampType, T.TimestampNTZType, T.DateType)

# Pandas dtype names reported for each Spark type.
PANDAS_DTYPE = {
    "tinyint": "int8", "smallint": "int16", "int": "int32", "bigint": "int64",
    "float": "float32", "double": "float64", "string": "object", "boolean": "bool",
    "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "object",
}

# A global exact `percentile` keeps a value -> count map that is merged in one
# task; it is used only while the column's distinct count is below this bound.
EXACT_MAP_LIMIT = 1_000_000

LONG_VALUE = 64     # bytes beyond which a text value is grouped by its digest
PART_BYTES = 16 << 20   # of rows in a partition of a table that is read many times
TEXT_LENGTH = 30    # mean characters from which a string column is text


def is_numeric(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL + FLOATING)


def is_integral(dt: T.DataType) -> bool:
    return isinstance(dt, INTEGRAL)


def is_string(dt: T.DataType) -> bool:
    return isinstance(dt, (T.StringType, T.VarcharType, T.CharType))


def is_timestamp(dt: T.DataType) -> bool:
    return isinstance(dt, TIMESTAMP)


def pandas_dtype(dt: T.DataType) -> str:
    s = dt.simpleString()
    if s.startswith("decimal"):
        return "float64"
    return PANDAS_DTYPE.get(s, "object")


@dataclass
class ColumnProfile:
    name: str
    dtype: str
    n_rows: int
    non_null: int
    distinct: int | None = None
    min: float | None = None
    max: float | None = None
    mean: float | None = None
    std: float | None = None          # sample (n-1)
    std_pop: float | None = None
    skew_pop: float | None = None     # Spark's g1
    not01: int | None = None          # numeric values outside {0, 1}
    avg_len: float | None = None      # strings: mean length of non-null values
    extra: dict = field(default_factory=dict)

    @property
    def missing(self) -> int:
        return self.n_rows - self.non_null

    @property
    def skew(self) -> float | None:
        """Bias-corrected sample skewness G1 (pandas ``Series.skew``)."""
        return adjusted_skew(self.non_null, self.std_pop, self.skew_pop)


def adjusted_skew(n: int, std_pop: float | None, g1: float | None) -> float | None:
    if n is None or n < 3:
        return None
    if not std_pop:
        return 0.0
    if g1 is None:
        return None
    return g1 * math.sqrt(n * (n - 1)) / (n - 2)


def adjusted_skew_col(c: Column) -> Column:
    """SKW-1 as one aggregate expression (usable inside any ``agg``)."""
    n = F.count(c)
    g1 = F.skewness(c)
    return (F.when(n < 3, F.lit(None).cast("double"))
            .when(F.stddev_pop(c) == 0, F.lit(0.0))
            .otherwise(g1 * F.sqrt(n * (n - 1)) / (n - 2)))


def _stat_plan(df: DataFrame, cols: list[str]) -> tuple[list[Column], list[Column]]:
    """(projection, aggregates): numeric columns are cast once in the
    projection so the moment aggregates read plain columns."""
    proj, aggs = [], [F.count(F.lit(1)).alias("__n")]
    for i, c in enumerate(cols):
        dt = df.schema[c].dataType
        if is_numeric(dt):
            proj.append(F.col(q(c)).cast("double").alias(f"v{i}"))
            v = F.col(f"v{i}")
            aggs += [F.count(v).alias(f"nn|{c}"), F.min(v).alias(f"min|{c}"), F.max(v).alias(f"max|{c}"),
                     F.avg(v).alias(f"mean|{c}"), F.stddev_pop(v).alias(f"stdp|{c}"), F.skewness(v).alias(f"g1|{c}"),
                     F.count_if(~v.isin(0.0, 1.0)).alias(f"n01|{c}")]
        elif is_string(dt):
            proj.append(F.length(F.col(q(c))).alias(f"v{i}"))
            aggs += [F.count(f"v{i}").alias(f"nn|{c}"), F.avg(f"v{i}").alias(f"len|{c}")]
        else:
            proj.append(F.col(q(c)).isNotNull().alias(f"v{i}"))
            aggs.append(F.count_if(f"v{i}").alias(f"nn|{c}"))
    return proj, aggs


def column_stats(df: DataFrame, cols: list[str] | None = None, date_formats: list[str] | None = None,
                 approx_distinct: bool = False) -> dict[str, ColumnProfile]:
    """One aggregate pass over ``df``; returns a small dict of scalars.
    With ``date_formats`` the same pass also counts, per string column and
    format, the values that parse (``extra['parsed']``); with
    ``approx_distinct`` it adds an HLL estimate (``extra['approx_distinct']``)
    that size checks (e.g. the exact-quantile strategy) can use."""
    cols = list(df.columns if cols is None else cols)
    proj, aggs = _stat_plan(df, cols)
    if approx_distinct:
        aggs += [F.approx_count_distinct(F.col(f"v{i}") if is_numeric(df.schema[c].dataType) else F.col(q(c)),
                                         0.02).alias(f"ad|{c}") for i, c in enumerate(cols)]
        if not all(is_numeric(df.schema[c].dataType) for c in cols):
            proj += [F.col(q(c)) for c in cols if not is_numeric(df.schema[c].dataType)]
    if date_formats:
        from ..functions.dates import parse_with
        for i, c in enumerate(cols):
            if is_string(df.schema[c].dataType):
                for k, f in enumerate(date_formats):
                    proj.append(parse_with(F.col(q(c)), f).isNotNull().alias(f"d{i}_{k}"))
                    aggs.append(F.count_if(f"d{i}_{k}").alias(f"p{k}|{c}"))
    r = (df.select(*proj) if proj else df).agg(*aggs).first().asDict()
    n = r["__n"]
    out = {}
    for c in cols:
        dt = df.schema[c].dataType
        p = ColumnProfile(c, dt.simpleString(), n, r[f"nn|{c}"])
        if is_numeric(dt):
            p.min, p.max, p.mean = r[f"min|{c}"], r[f"max|{c}"], r[f"mean|{c}"]
            p.std_pop, p.skew_pop = r[f"stdp|{c}"], r[f"g1|{c}"]
            p.std = p.std_pop * math.sqrt(p.non_null / (p.non_null - 1)) if p.non_null > 1 else None
            p.not01 = r[f"n01|{c}"]
        elif is_string(dt):
            p.avg_len = r[f"len|{c}"]
            if date_formats:
                p.extra["parsed"] = [r[f"p{k}|{c}"] for k in range(len(date_formats))]
        if approx_distinct:
            p.extra["approx_distinct"] = r[f"ad|{c}"]
        out[c] = p
    return out


def value_string(df: DataFrame, c: str) -> Column:
    """Canonical string of a value, as pandas ``astype(str)`` writes it:
    integers plainly, whole-number floats as ``N.0`` (never ``1.0E7``),
    other floats in their shortest form."""
    dt = df.schema[c].dataType
    x = F.col(q(c))
    if isinstance(dt, FLOATING):
        xd = x.cast("double")
        whole = (xd == F.floor(xd)) & (F.abs(xd) < 1e15)
        return F.when(whole, F.concat(F.floor(xd).cast("bigint").cast("string"), F.lit(".0"))) \
            .otherwise(xd.cast("string"))
    if isinstance(dt, T.BooleanType):
        return F.when(x, F.lit("True")).when(~x, F.lit("False"))
    return x.cast("string")


def format_double(d: Column) -> Column:
    """``value_string`` of a double column."""
    whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
    return F.when(whole, F.concat(F.floor(d).cast("bigint").cast("string"), F.lit(".0"))).otherwise(d.cast("string"))


def digest(*values: Column) -> tuple[Column, Column, Column]:
    """Two 64-bit names of a row of values and a third digest that checks them.
    Nulls have no part in Spark's row hash, so their places are hashed as well."""
    blanks = [v.isNull() for v in values]
    return tuple(F.xxhash64(F.lit(seed), *values, *blanks) for seed in (11, 12, 13))


def value_counts(df: DataFrame, cols: list[str] | None = None, named: set[str] | None = None) -> DataFrame:
    """``(column, value, cnt, num, kinds)`` over the non-null values of ``cols``
    (``num``: the numeric value, for numeric ordering).

    Expand (unpivot) -> partial HashAggregate -> one exchange -> final
    aggregate: a hot value costs one row per map task, not one per row.
    Rows are grouped on typed slots (long / double / string) and only the
    reduced table is rendered as strings.

    In the string columns ``named``, values of more than LONG_VALUE bytes are
    grouped by two 64-bit digests and have no ``value``: no long text is
    shuffled. ``kinds`` counts the contents under a name: 1, or 2 should a third
    digest tell two values apart.
    """
    cols = list(df.columns if cols is None else cols)
    named = {c for c in named or () if c in cols and is_string(df.schema[c].dataType)}
    items = []
    for c in cols:
        dt = df.schema[c].dataType
        x = F.col(q(c))
        nl, nd, ns = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
        name = [nl, nl, nl]
        if is_integral(dt):
            slots = (x.cast("long"), nd, ns)
        elif isinstance(dt, FLOATING):
            slots = (nl, x.cast("double"), ns)
        elif c in named:
            long = F.octet_length(x) > LONG_VALUE
            slots = (nl, nd, F.when(~long, x))
            name = [F.when(long, h) for h in digest(x)]
        else:
            slots = (nl, nd, value_string(df, c))
        fields = [F.lit(c).alias("column"), slots[0].alias("l"), slots[1].alias("d"), slots[2].alias("s")]
        if named:
            fields += [h.alias(f"h{i}") for i, h in enumerate(name)]
        items.append(F.struct(*fields))
    stacked = df.select(F.explode(F.array(*items)).alias("v")).select("v.*")
    some = F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
    if named:
        g = (stacked.where(some | F.col("h0").isNotNull()).groupBy("column", "l", "d", "s", "h0", "h1")
             .agg(F.count(F.lit(1)).alias("cnt"), F.min("h2").alias("low"), F.max("h2").alias("high")))
        kinds = F.when(F.col("low") != F.col("high"), 2).otherwise(1)
    else:
        g = stacked.where(some).groupBy("column", "l", "d", "s").agg(F.count(F.lit(1)).alias("cnt"))
        kinds = F.lit(1)
    return g.select("column",
                    F.coalesce(F.col("s"), F.col("l").cast("string"), format_double(F.col("d"))).alias("value"),
                    "cnt", F.coalesce(F.col("l").cast("double"), F.col("d")).alias("num"), kinds.alias("kinds"))


def row_width(prof: dict[str, ColumnProfile]) -> float:
    """Bytes of a row of the profiled columns, roughly."""
    return sum(16 + (p.avg_len or 0) for p in prof.values())


def sized(df: DataFrame, rows: int, width: float) -> DataFrame:
    """``df`` in no more partitions than its size asks for (PART_BYTES each, two a
    core at least): passes over a shuffled table that is read many times would be
    mostly task starts. Partitions are joined as they lie, none is ever added."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.coalesce(max(2 * cores, math.ceil(rows * width / PART_BYTES)))


def distinct_rows(df: DataFrame) -> DataFrame:
    """``(h0, h1, cnt, kinds)``: one row per distinct row of ``df``, by digest.
    Arrays and structs are hashed as they are, maps as sorted entries."""
    values = []
    for f in df.schema.fields:
        c = F.col(q(f.name))
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            c = c + F.lit(0.0).cast(f.dataType)      # -0.0 equals 0.0
        elif isinstance(f.dataType, T.MapType):
            c = F.array_sort(F.map_entries(c))
        values.append(c)
    names = [h.alias(f"h{i}") for i, h in enumerate(digest(*values))]
    g = df.select(*names).groupBy("h0", "h1").agg(F.count(F.lit(1)).alias("cnt"), F.min("h2").alias("low"), F.max("h2").alias("high"))
    return g.select("h0", "h1", "cnt", F.when(F.col("low") != F.col("high"), 2).otherwise(1).alias("kinds"))


def text_columns(df: DataFrame, prof: dict[str, ColumnProfile], keep: list[str] | tuple = (), text_length: int = TEXT_LENGTH) -> set[str]:
    """String columns whose values are long on average: no mode, level or label
    is ever taken of them, only their number of distinct values."""
    return {c for c, p in prof.items() if c not in keep and is_string(df.schema[c].dataType) and (p.avg_len or 0) > text_length}


def distinct_counts(df: DataFrame, cols: list[str] | None = None,
                    freq: DataFrame | None = None) -> dict[str, int]:
    cols = list(df.columns if cols is None else cols)
    if not cols:
        return {}
    vc = freq if freq is not None else value_counts(df, cols)
    got = {r["column"]: r["n"] for r in
           vc.where(F.col("column").isin(cols)).groupBy("column").agg(F.sum("kinds").alias("n")).collect()}
    return {c: int(got.get(c, 0)) for c in cols}


def distinct_and_parsed(df: DataFrame, prof: dict[str, ColumnProfile], freq: DataFrame,
                        date_formats: list[str] | None = None) -> None:
    """Fill ``distinct`` of every profiled column and, for string columns, the
    per-format parse counts - one aggregation over the frequency table, so
    each distinct string is parsed once and weighted by its count, and only with
    the formats whose form a value of the column has."""
    from ..functions.dates import matching_formats, parse_with, value_shape
    cols = list(prof)
    strings = [c for c in cols if is_string(df.schema[c].dataType)]
    fmts = date_formats or []
    forms: dict[str, list[int]] = {}
    if strings and fmts:
        shapes = freq.where(F.col("column").isin(strings)).select("column", value_shape(F.col("value")).alias("shape"))
        forms = matching_formats(shapes, fmts)
    aggs = [F.sum("kinds").alias("d")]
    for k, f in enumerate(fmts):
        own = [c for c in strings if k in forms.get(c, [])]
        if own:
            aggs.append(F.sum(F.when(F.col("column").isin(own) & parse_with(F.col("value"), f).isNotNull(), F.col("cnt"))).alias(f"p{k}"))
    got = {r["column"]: r.asDict() for r in freq.where(F.col("column").isin(cols)).groupBy("column").agg(*aggs).collect()}
    for c in cols:
        r = got.get(c, {})
        prof[c].distinct = int(r.get("d") or 0)
        if c in strings and fmts:
            prof[c].extra["parsed"] = [int(r.get(f"p{k}") or 0) for k in range(len(fmts))]


def freq_quantiles(freq: DataFrame, cols: list[str], probs: list[float], non_null: dict[str, int]) -> dict:
    """Exact linear-interpolated quantiles from the ``(column, num, cnt)`` rows
    of a frequency table: running counts per column (a window over the
    column's distinct values; callers keep this to columns within
    EXACT_MAP_LIMIT distinct values), then one broadcast range join picks the
    values at the needed ranks."""
    spark = freq.sparkSession
    need = []
    for c in cols:
        n = non_null[c]
        for p in probs:
            h = p * (n - 1)
            need += [(c, int(math.floor(h))), (c, int(math.ceil(h)))]
    if not need:
        return {c: [None] * len(probs) for c in cols}
    ranks = F.broadcast(spark.createDataFrame(sorted(set(need)), "rc string, r bigint"))   # 2 x probs x cols rows
    w = Window.partitionBy("column").orderBy("num").rowsBetween(Window.unboundedPreceding, 0)
    t = (freq.where(F.col("column").isin(cols) & F.col("num").isNotNull())
         .withColumn("hi", F.sum("cnt").over(w)).withColumn("lo", F.col("hi") - F.col("cnt")))
    hits = t.join(ranks, (t["column"] == ranks["rc"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))) \
        .select("column", "r", "num").collect()
    at = {(r["column"], r["r"]): r["num"] for r in hits}
    out = {}
    for c in cols:
        n = non_null[c]
        vals = []
        for p in probs:
            if n == 0:
                vals.append(None)
                continue
            h = p * (n - 1)
            lo, hi = int(math.floor(h)), int(math.ceil(h))
            vals.append(at[(c, lo)] + (h - lo) * (at[(c, hi)] - at[(c, lo)]))
        out[c] = vals
    return out


def profile(df: DataFrame, cols: list[str] | None = None, distinct: bool = True,
            freq: DataFrame | None = None) -> dict[str, ColumnProfile]:
    """Fused profile: moments in one pass, exact distinct counts from the
    value-frequency table."""
    prof = column_stats(df, cols)
    if distinct:
        freq = freq if freq is not None else value_counts(df, list(prof), text_columns(df, prof))
        for c, d in distinct_counts(df, list(prof), freq).items():
            prof[c].distinct = d
    return prof


def profile_frame(spark, prof: dict[str, ColumnProfile]) -> DataFrame:
    """Long-form profile DataFrame (small: one row per column)."""
    rows = [(p.name, p.dtype, p.n_rows, p.non_null, p.missing, p.distinct, p.min, p.max,
             p.mean, p.std, p.skew, p.avg_len) for p in prof.values()]
    schema = ("column string, dtype string, n bigint, non_null bigint, missing bigint, "
              "distinct bigint, min double, max double, mean double, std double, "
              "skewness double, avg_len double")
    return spark.createDataFrame(rows, schema)


# --------------------------------------------------------------------------
# exact quantiles

def distinct_bounds(prof: dict[str, ColumnProfile], limit: int = EXACT_MAP_LIMIT) -> dict[str, int | None]:
    """A proven upper bound on each column's distinct count: the exact count
    when known, else the non-null count when that is within ``limit``;
    None (unknown) otherwise."""
    out = {}
    for c, p in prof.items():
        if p.distinct is not None:
            out[c] = p.distinct
        elif p.non_null is not None and p.non_null <= limit:
            out[c] = p.non_null
        else:
            out[c] = p.extra.get("approx_distinct")
    return out


def quantiles(df: DataFrame, cols: list[str], probs: list[float],
              distinct: dict[str, int] | None = None,
              exact_map_limit: int = EXACT_MAP_LIMIT) -> dict[str, list[float | None]]:
    """Exact linear-interpolated quantiles (pandas / ``quantile_cont``).

    Columns whose distinct count is within ``exact_map_limit`` share one
    aggregate with Spark's exact ``percentile``; larger ones share the passes
    of a bracketed selection (no shuffle of the column, no single-task merge).
    """
    if not cols:
        return {}
    distinct = dict(distinct or {})
    unknown = [c for c in cols if distinct.get(c) is None]
    if unknown:       # only when no bound is known: one HLL pass decides the strategy
        approx = df.agg(*[F.approx_count_distinct(F.col(q(c)), 0.02).alias(c) for c in unknown]).first()
        distinct.update({c: approx[c] for c in unknown})
    small = [c for c in cols if (distinct.get(c) or 0) <= exact_map_limit]
    big = [c for c in cols if c not in small]
    out: dict[str, list[float | None]] = {}
    if small:
        arr = F.array(*[F.lit(float(p)) for p in probs])
        r = df.agg(*[F.percentile(F.col(q(c)).cast("double"), arr).alias(c) for c in small]).first()
        for c in small:
            out[c] = list(r[c]) if r[c] is not None else [None] * len(probs)
    if big:
        from .selection import selection_quantiles
        out.update(selection_quantiles(df, big, probs))
    return out


def rank_quantiles(df: DataFrame, c: str, probs: list[float], partitions: int | None = None) -> list:
    """Exact quantiles of a high-cardinality column by bracketed selection.
    ``partitions`` spreads the scan and has no part in the result."""
    from .selection import selection_quantiles
    rows = df.select(F.col(q(c)))
    return selection_quantiles(rows.repartition(partitions) if partitions else rows, [c], probs)[c]
