"""Formats are chosen from value shapes before anything is parsed."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import dates as D
from tessera.operators.types import coerce_dates, date_parse_rates, feature_types

VALUES = ["2020-01-05", "2020-1-5 10:00:00.123", "2020-01-05T10:00:00Z", "2020-01-05T10:00:00+02:00", "25/12/2020", "12/25/2020 1:02", "Jan 5, 2020",
          "5 Jan 2020", "September 5, 2020", "20200105", "2020", "12:30", "Customer#0001", "ZT9", "Tue 5", "", " 2020/01/05 ", "x" * 70 + "1", "05.01.2020", "1-2-2020"]


def test_a_shape_matches_as_its_value_does(spark):
    df = spark.createDataFrame([(v,) for v in VALUES], "v string")
    for r in df.select("v", D.value_shape(F.col("v")).alias("s")).collect():
        v = r["v"].strip(" ")
        if r["s"] is None:
            assert len(v) > D.MAX_DATE_LEN or not re.search("[0-9]", v)
            continue
        for _, regex in D.DATE_FORMAT_SHAPES:
            assert bool(re.search(regex, v)) == bool(re.search(regex, r["s"])), (v, regex)


def test_rates_equal_parsing_with_every_format(spark):
    df = spark.createDataFrame([(v, "word", None) for v in VALUES], "v string, w string, n string")
    got = date_parse_rates(df)
    counts = df.agg(*[F.count(D.parse_with(F.col("v"), f)).alias(f"p{i}") for i, f in enumerate(D.DATE_FORMATS)]).first()
    best = max(range(len(counts)), key=lambda i: (counts[i], -i))
    assert (got["v"]["format"], got["v"]["parsed"]) == (D.DATE_FORMATS[best], counts[best])
    assert got["w"]["parsed"] == got["n"]["parsed"] == 0 and got["n"]["non_null"] == 0


def test_only_formats_whose_form_occurs_are_tried(spark):
    rows = [("iso", "2020-01-05"), ("us", "1/5/2020"), ("names", "Customer#0001"), ("names", "99-A")]
    shapes = spark.createDataFrame(rows, "column string, v string").select("column", D.value_shape(F.col("v")).alias("shape"))
    forms = {c: [D.DATE_FORMATS[i] for i in f] for c, f in D.matching_formats(shapes, D.DATE_FORMATS).items()}
    assert forms == {"iso": ["yyyy-MM-dd", "yyyy-M-d"], "us": ["MM/dd/yyyy", "M/d/yyyy", "d/M/yyyy"], "names": []}


@pytest.mark.parametrize("rows,want", [
    ([f"{d}/{m}/2020" for d in (13, 25, 30, 31) for m in (1, 3, 5)], dt.datetime(2020, 1, 13)),      # a field over 12 is the day
    ([f"{m}/{d}/2020" for m in (1, 3, 5) for d in (13, 25, 30, 31)], dt.datetime(2020, 1, 13)),
    (["1/2/2020", "3/4/2020"], dt.datetime(2020, 1, 2)),                                              # both orders fit: month first
    (["2/3/2020", "14/3/2020", "15/4/2020"], dt.datetime(2020, 3, 2))])
def test_day_and_month_order(spark, rows, want):
    df = spark.createDataFrame([(r,) for r in rows], "d string")
    out, _ = coerce_dates(df, 0.6)
    assert out.first()["d"] == want


def test_mixed_columns(spark):
    half = ["2020-01-05"] * 7 + ["word 1"] * 3
    df = spark.createDataFrame([(v, f"k{i}") for i, v in enumerate(half)], "d string, k string")
    assert coerce_dates(df, 0.6)[1] == {"d": "yyyy-MM-dd"} and coerce_dates(df, 0.7)[1] == {}
    assert feature_types(df) == {"d": "categorical", "k": "id"}
