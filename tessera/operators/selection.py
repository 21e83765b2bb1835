"""Exact quantiles by bracketed selection.

A KLL sketch of a column brackets the value of every wanted rank between two of
its values. A pass over the column then counts what lies below a bracket and
inside it, which proves or refutes the bracket, and sketches the inside, which
gives the next, far smaller one. When at most ``LIMIT`` values are inside, only
these are grouped and sorted. Every pass is one aggregate over a scan: nothing of
the column is shuffled but the values of the last brackets.

The sketches only choose where to look; the counts are exact, so the result is.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .profile import q

LIMIT = 100_000     # values of a bracket that are sorted
SKETCH = 2048       # size of a sketch: ranks are right to about 0.15 % of its rows
MARGIN = 0.004      # ranks by which a bracket is wider on both sides


@dataclass
class Search:
    """The search for one rank: the value lies in [low, high]; ``below`` rows
    are less than ``low`` and ``inside`` rows are within."""

    column: str
    rank: int
    low: float
    high: float
    below: int
    inside: int
    tried: tuple[float, float] | None = None   # the bracket that the current pass tests
    value: float | None = None

    def narrow(self, points: list[float]) -> None:
        """Choose the next bracket from quantiles (left, at, right) of the rows inside."""
        left, at, right = (min(max(p, self.low), self.high) for p in points)
        # a bracket that isn't smaller can't be split by neighbours: test one value alone
        self.tried = (left, right) if (left, right) != (self.low, self.high) else (at, at)

    def learn(self, below: int, inside: int) -> None:
        """Counts of the tested bracket."""
        left, right = self.tried
        if self.rank < below:
            self.high, self.inside = math.nextafter(left, -math.inf), below - self.below
        elif self.rank >= below + inside:
            end = self.below + self.inside
            self.low, self.below = math.nextafter(right, math.inf), below + inside
            self.inside = end - self.below
        else:
            self.low, self.high, self.below, self.inside = left, right, below, inside
        if self.low == self.high:
            self.value = self.low


def _within(c: Column, low: float, high: float) -> Column:
    return (c >= F.lit(low)) & (c <= F.lit(high))


def _points(share: float) -> list[float]:
    return [max(0.0, share - MARGIN), share, min(1.0, share + MARGIN)]


def selection_quantiles(df: DataFrame, cols: list[str], probs: list[float], limit: int | None = None) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column, null and NaN left out."""
    limit = LIMIT if limit is None else limit
    v = {c: f"v{i}" for i, c in enumerate(cols)}
    data = df.select(*[F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double")).alias(v[c]) for c in cols])
    got = data.agg(*[x for c in cols for x in (F.count(v[c]).alias(f"n{v[c]}"), F.min(v[c]).alias(f"a{v[c]}"), F.max(v[c]).alias(f"z{v[c]}"),
                                               F.kll_sketch_agg_double(v[c], F.lit(SKETCH)).alias(f"s{v[c]}"))]).first()
    n = {c: got[f"n{v[c]}"] for c in cols}
    wanted = {(c, r) for c in cols if n[c] for p in probs for r in (math.floor(p * (n[c] - 1)), math.ceil(p * (n[c] - 1)))}
    searches = [Search(c, r, got[f"a{v[c]}"], got[f"z{v[c]}"], 0, n[c]) for c, r in sorted(wanted)]
    sketches = {(s.column, s.low, s.high): got[f"s{v[s.column]}"] for s in searches}
    for s in searches:
        if s.low == s.high:
            s.value = s.low
    while True:
        open_ = [s for s in searches if s.value is None and s.inside > limit]
        if not open_:
            break
        _choose(df, open_, sketches)
        # one test per bracket, however many ranks are sought in it
        tests = sorted({(s.column, *s.tried) for s in open_})
        aggs = []
        for i, (c, low, high) in enumerate(tests):
            x = F.col(v[c])
            aggs += [F.count_if(x < F.lit(low)).alias(f"b{i}"), F.count_if(_within(x, low, high)).alias(f"i{i}"),
                     F.kll_sketch_agg_double(F.when(_within(x, low, high), x), F.lit(SKETCH)).alias(f"s{i}")]
        counts = data.agg(*aggs).first()
        number = {t: i for i, t in enumerate(tests)}
        for s in open_:
            i = number[s.column, *s.tried]
            s.learn(counts[f"b{i}"], counts[f"i{i}"])
            if (s.low, s.high) == s.tried and s.value is None:
                sketches[s.column, s.low, s.high] = counts[f"s{i}"]
    _finish(data, v, [s for s in searches if s.value is None])
    at = {(s.column, s.rank): s.value for s in searches}
    out: dict[str, list[float | None]] = {}
    for c in cols:
        out[c] = []
        for p in probs:
            h = p * (n[c] - 1)
            if not n[c]:
                out[c].append(None)
                continue
            low, high = at[c, math.floor(h)], at[c, math.ceil(h)]
            out[c].append(low + (h - math.floor(h)) * (high - low))
    return out


def _choose(df: DataFrame, searches: list[Search], sketches: dict) -> None:
    """The next bracket of every search, from the sketch of its rows; one whose
    sketch was of a wider bracket (after a miss) tests the sketch's value alone."""
    asked = []
    for s in searches:
        sketch = sketches.get((s.column, s.low, s.high))
        if sketch is None:     # the bracket moved beside a tested one: halve it by value
            middle = s.low + (s.high - s.low) / 2 if math.isfinite(s.high - s.low) else s.low / 2 + s.high / 2
            s.tried = (s.low, middle)
        else:
            asked.append((s, bytes(sketch)))
    if not asked:
        return
    # Spark wants the ranks as literals: one row that holds the sketches
    table = df.sparkSession.createDataFrame([tuple(k for _, k in asked)], ", ".join(f"k{i} binary" for i in range(len(asked))))
    at = [F.array(*[F.lit(x) for x in _points((s.rank - s.below + 0.5) / s.inside)]) for s, _ in asked]
    row = table.select(*[F.kll_sketch_get_quantile_double(F.col(f"k{i}"), x).alias(f"p{i}") for i, x in enumerate(at)]).first()
    for i, (s, _) in enumerate(asked):
        s.narrow(list(row[f"p{i}"]))


def _finish(data: DataFrame, v: dict[str, str], searches: list[Search]) -> None:
    """Group and sort the values inside the last brackets."""
    if not searches:
        return
    spans = sorted({(s.column, s.low, s.high, s.below) for s in searches})
    inside = [F.when(_within(F.col(v[c]), low, high), F.struct(F.lit(i).alias("span"), F.col(v[c]).alias("value")))
              for i, (c, low, high, _) in enumerate(spans)]
    values = data.select(F.explode(F.array_compact(F.array(*inside))).alias("x")).groupBy("x.span", "x.value").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("span").orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    sorted_ = values.withColumn("after", upto)
    number = {t: i for i, t in enumerate(spans)}
    at = sorted({(number[s.column, s.low, s.high, s.below], s.rank - s.below) for s in searches})
    ranks = F.broadcast(data.sparkSession.createDataFrame(at, "r_span int, place long"))    # two ranks per wanted quantile
    hit = (F.col("span") == F.col("r_span")) & (F.col("place") < F.col("after")) & (F.col("place") >= F.col("after") - F.col("n"))
    found = {(r["r_span"], r["place"]): r["value"] for r in sorted_.join(ranks, hit).select("r_span", "place", "value").collect()}
    for s in searches:
        s.value = found[number[s.column, s.low, s.high, s.below], s.rank - s.below]
