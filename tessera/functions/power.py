"""Yeo-Johnson power transform and clipping as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def yeo_johnson(x: Column, lam: float) -> Column:
    """SKW-3: x >= 0: ((x+1)^l - 1)/l (l = 0: ln(x+1));
    x < 0: -((1-x)^(2-l) - 1)/(2-l) (l = 2: -ln(1-x))."""
    if abs(lam) < 1e-12:
        pos = F.log1p(x)
    else:
        pos = (F.pow(x + 1, F.lit(lam)) - 1) / lam
    if abs(lam - 2) < 1e-12:
        neg = -F.log1p(-x)
    else:
        neg = -(F.pow(1 - x, F.lit(2 - lam)) - 1) / (2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def yeo_johnson_scaled(x: Column, lam: float, log_scale: float) -> Column:
    """``(yj(x) + 1/lam) * exp(-log_scale)`` (without the 1/lam where lam is 0):
    differs from ``yj`` by a shift and a factor only, and stays finite for large
    powers, because the scale is taken off inside the exponent."""
    if log_scale == 0:
        return yeo_johnson_shifted(x, lam)
    down = math.exp(-log_scale) if log_scale > -700 else 0.0
    shift = 1.0 / lam if abs(lam) >= 1e-12 else 0.0
    if abs(lam) < 1e-12:
        pos = F.log1p(x) * F.lit(down)
    else:
        pos = F.exp(F.log1p(x) * F.lit(lam) - F.lit(log_scale)) / F.lit(lam)
    if abs(lam - 2) < 1e-12:
        neg = (F.lit(shift) - F.log1p(-x)) * F.lit(down)
    else:
        neg = F.lit((shift + 1 / (2 - lam)) * down) - F.exp(F.log1p(-x) * F.lit(2 - lam) - F.lit(log_scale)) / F.lit(2 - lam)
    return F.when(x >= 0, pos).otherwise(neg)


def log_scale(lam: float, low: float, high: float) -> float:
    """Largest exponent that ``yj`` takes on [low, high]; 0 while it is harmless."""
    ends = []
    if high >= 0:
        ends += [lam * math.log1p(high), lam * math.log1p(max(low, 0.0))]
    if low < 0:
        ends += [(2 - lam) * math.log1p(-low), (2 - lam) * math.log1p(max(-high, 0.0))]
    top = max(ends)
    return top if abs(top) > 100 else 0.0


def yeo_johnson_shifted(x: Column, lam: float) -> Column:
    """``yj(x) + 1/lam`` (lam != 0): same variance as ``yj``, but for x >= 0 it
    is ``(x+1)^lam / lam`` with no cancellation against the constant, so the
    variance stays accurate for strongly negative lambdas."""
    if abs(lam) < 1e-12:
        return yeo_johnson(x, lam)
    return F.when(x >= 0, F.pow(x + 1, F.lit(lam)) / lam).otherwise(yeo_johnson(x, lam) + 1.0 / lam)


def clip(x: Column, lo: float, hi: float) -> Column:
    """NULL-preserving clip (an unguarded least/greatest turns NULL into hi)."""
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))
