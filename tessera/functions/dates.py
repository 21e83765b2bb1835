"""Date parsing and calendar-part expressions (TYP-1..3, DT-1..5)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The timestamp formats tried, in order, when a string column is
# tested for dates (Java DateTimeFormatter patterns; month-first like pandas),
# each with a shape regex that every string the format can parse matches.
DATE_FORMAT_SHAPES = [
    ("yyyy-MM-dd HH:mm:ss[.SSSSSS]", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}(\.\d{1,9})?$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}(\.\d{1,9})?$"),
    ("yyyy-MM-dd HH:mm", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}$"),
    ("yyyy-MM-dd", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{1,2}/\d{1,2}$"),
    ("MM/dd/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("MM/dd/yyyy HH:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("dd-MM-yyyy", r"^\d{1,2}-\d{1,2}-\d{4}$"),
    ("dd.MM.yyyy", r"^\d{1,2}\.\d{1,2}\.\d{4}$"),
    ("MMM d, yyyy", r"^[A-Za-z]{3} \d{1,2}, \d{4}$"),
    ("d MMM yyyy", r"^\d{1,2} [A-Za-z]{3} \d{4}$"),
    ("MMMM d, yyyy", r"^[A-Za-z]+ \d{1,2}, \d{4}$"),
    ("M/d/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("d/M/yyyy", r"^\d{1,2}/\d{1,2}/\d{4}$"),
    ("M/d/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("d/M/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$"),
    ("M/d/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("d/M/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$"),
    ("yyyy-M-d", r"^\d{4}-\d{1,2}-\d{1,2}$"),
    ("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX", r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"),
    ("yyyy-MM-dd HH:mm:ss[.SSSSSS]XXX", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})$"),
    ("yyyyMMdd", r"^\d{8}$"),
]
DATE_FORMATS = [f for f, _ in DATE_FORMAT_SHAPES]
MAX_DATE_LEN = 64          # longest trimmed string any format above can match
_SHAPES = dict(DATE_FORMAT_SHAPES)


# digits and letters as the shape regexes see them; T and Z stand for themselves in ISO forms
_LETTERS = "".join(chr(c) for c in [*range(65, 91), *range(97, 123)] if chr(c) not in "TZ")


def value_shape(c: Column) -> Column:
    """The character classes of a value that could be a date (9 for a digit, a for
    a letter), NULL for one that couldn't: every shape regex matches a value if and
    only if it matches its shape."""
    s = F.trim(c.cast("string"))
    could = (F.length(s) <= MAX_DATE_LEN) & s.rlike("[0-9]")
    return F.when(could, F.translate(s, "0123456789" + _LETTERS, "9" * 10 + "a" * len(_LETTERS)))


def matching_formats(shapes: DataFrame, formats: list[str]) -> dict[str, list[int]]:
    """column -> numbers of the formats that some shape of a (column, shape) table
    has the form of; a format without a known form may match any."""
    forms = [_SHAPES.get(f) for f in formats]
    hits = [F.max(F.col("shape").rlike(r) if r else F.lit(True)).alias(f"f{i}") for i, r in enumerate(forms)]
    rows = shapes.where(F.col("shape").isNotNull()).distinct().groupBy("column").agg(*hits).collect()
    return {r["column"]: [i for i in range(len(formats)) if r[f"f{i}"]] for r in rows}


def parse_with(c: Column, fmt: str) -> Column:
    """NULL unless the whole string is a timestamp in ``fmt`` (never raises).
    A cheap shape regex runs first: a failed parse is far costlier than a
    regex miss, and most strings are not dates."""
    s = F.trim(c.cast("string"))
    guard = s.rlike(_SHAPES[fmt]) if fmt in _SHAPES else s.rlike("[0-9]")
    # no supported format is longer than MAX_DATE_LEN: long texts skip the regex
    return F.when((F.length(s) <= MAX_DATE_LEN) & guard, F.try_to_timestamp(s, F.lit(fmt)))


def as_utc_timestamp(c: Column) -> Column:
    """Calendar parts are read from the value itself: TIMESTAMP_NTZ and
    TIMESTAMP both answer year/month/hour directly, and casting a wall-clock
    value into a session zone with daylight saving would move nonexistent
    local times (02:30 on a spring-forward day becomes 03:30)."""
    return c


NTZ_EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"


def epoch_micros(c: Column, dtype: T.DataType) -> Column:
    """Microseconds since 1970-01-01 00:00: of the instant for TIMESTAMP, of
    the wall clock (zone-free ``timestampdiff``) for TIMESTAMP_NTZ / DATE."""
    if isinstance(dtype, T.TimestampType):
        return F.unix_micros(c)
    return F.timestamp_diff("MICROSECOND", F.expr(NTZ_EPOCH), c.cast("timestamp_ntz"))


def dayofweek_monday0(ts: Column) -> Column:
    """pandas ``dayofweek``: Monday = 0 ... Sunday = 6 (Spark ``weekday``)."""
    return F.weekday(ts)


def date_parts(c: Column, name: str) -> list[Column]:
    """DT-1: year, month, day, dayofweek, quarter, ISO week (double)."""
    return [F.year(c).cast("double").alias(f"{name}_year"),
            F.month(c).cast("double").alias(f"{name}_month"),
            F.dayofmonth(c).cast("double").alias(f"{name}_day"),
            dayofweek_monday0(c).cast("double").alias(f"{name}_dayofweek"),
            F.quarter(c).cast("double").alias(f"{name}_quarter"),
            F.weekofyear(c).cast("double").alias(f"{name}_weekofyear")]


def time_parts(c: Column, name: str) -> list[Column]:
    """DT-2: hour and minute."""
    return [F.hour(c).cast("double").alias(f"{name}_hour"),
            F.minute(c).cast("double").alias(f"{name}_minute")]


def days_since(c: Column, min_micros: int, name: str, dtype: T.DataType | None = None) -> Column:
    """DT-3: whole elapsed 24 h days since the fitted minimum (floor)."""
    micros = epoch_micros(c, dtype or T.TimestampType())
    return F.floor((micros - F.lit(min_micros)) / F.lit(86_400_000_000)).cast("double").alias(f"{name}_days_since")


def cyclical(c: Column, name: str) -> list[Column]:
    """DT-4/5: sin/cos of month (period 12) and day of week (period 7)."""
    m = F.month(c).cast("double")
    d = dayofweek_monday0(c).cast("double")
    two_pi = 2 * math.pi
    return [F.sin(F.lit(two_pi) * m / 12).alias(f"{name}_month_sin"),
            F.cos(F.lit(two_pi) * m / 12).alias(f"{name}_month_cos"),
            F.sin(F.lit(two_pi) * d / 7).alias(f"{name}_dow_sin"),
            F.cos(F.lit(two_pi) * d / 7).alias(f"{name}_dow_cos")]
