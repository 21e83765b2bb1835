import datetime as dt

import pytest

from tessera.operators import clean, datefeat


def test_mode_ties_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "c string")
    assert clean.modes(df, ["c"]) == {"c": "a"}
    num = spark.createDataFrame([(10,), (9,), (10,), (9,)], "k bigint")
    assert clean.modes(num, ["k"]) == {"k": "9"}      # numeric order, not '10' < '9'


def test_impute_mean_and_mode(spark):
    df = spark.createDataFrame([(1.0, "x"), (3.0, "x"), (None, None), (None, "y")], "n double, c string")
    p = clean.fit_imputer(df, ["n"], ["c"])
    out = clean.impute(df, p).collect()
    assert [r["n"] for r in out] == [1.0, 3.0, 2.0, 2.0]
    assert [r["c"] for r in out] == ["x", "x", "x", "y"]


def test_duplicates_nulls_equal(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, "a")], "a int, b string")
    assert clean.duplicate_count(df) == 1
    assert clean.drop_duplicates(df).count() == 2


def ts(*a):
    return dt.datetime(*a)


@pytest.mark.parametrize("rows,with_time", [
    ([ts(2024, 1, 1), ts(2024, 1, 2)], False),
    ([ts(2024, 1, 1), ts(2024, 1, 2, 5, 30)], True),
    ([ts(2024, 1, 1), None], True),            # a NULL also switches hour/minute on
])
def test_hour_flag(spark, rows, with_time):
    df = spark.createDataFrame([(r,) for r in rows], "t timestamp")
    p = datefeat.fit_dates(df, ["t"])
    assert p["t"]["with_time"] is with_time
    cols = datefeat.date_features(df, p).columns
    assert ("t_hour" in cols) == with_time and "t" not in cols


def test_days_since_floor_and_parts(spark):
    df = spark.createDataFrame([(ts(2024, 1, 1, 23),), (ts(2024, 1, 2, 1),), (ts(2024, 1, 7, 23, 59),)], "t timestamp")
    p = datefeat.fit_dates(df, ["t"])
    out = datefeat.date_features(df, p).orderBy("t_days_since").collect()
    assert [r["t_days_since"] for r in out] == [0.0, 0.0, 6.0]     # 2 hours apart is day 0, not 1
    assert out[0]["t_dayofweek"] == 0.0        # 2024-01-01 is a Monday
    assert out[2]["t_dayofweek"] == 6.0 and out[0]["t_weekofyear"] == 1.0
    # scoring rows before the fitted minimum go negative (floor)
    early = spark.createDataFrame([(ts(2023, 12, 31, 23, 30),)], "t timestamp")
    assert datefeat.date_features(early, p).first()["t_days_since"] == -1.0


def test_wall_clock_parts_ignore_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.sql("SELECT timestamp_ntz'2024-03-10 02:30:00' AS t UNION ALL "
                       "SELECT timestamp_ntz'2024-03-09 02:30:00'")
        p = datefeat.fit_dates(df, ["t"])
        out = datefeat.date_features(df, p).orderBy("t_days_since").collect()
        assert [r["t_hour"] for r in out] == [2.0, 2.0]      # 02:30 does not exist in New York that day
        assert [r["t_days_since"] for r in out] == [0.0, 1.0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
