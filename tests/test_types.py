import pytest

from tessera.operators.profile import profile
from tessera.operators.types import TaskError, coerce_dates, feature_types, problem_type


def test_decision_list(spark):
    n = 100
    rows = []
    for i in range(n):
        rows.append((None, 7, i % 2, i % 5, i, (i % 40) * 1.5, f"c{i % 4}", "x" * 40 + str(i % 3), f"u{i}",
                     f"2020-01-{(i % 28) + 1:02d}", True if i % 2 else False))
    df = spark.createDataFrame(rows, "nul string, con int, b01 int, small int, ident bigint, num double, "
                                     "cat string, txt string, sid string, dstr string, flag boolean")
    t = feature_types(df)
    assert t == {"nul": "all_null", "con": "constant", "b01": "boolean", "small": "categorical",
                 "ident": "id", "num": "numerical", "cat": "categorical", "txt": "text", "sid": "id",
                 "dstr": "datetime", "flag": "boolean"}


def test_unique_columns_of_any_length_are_ids(spark):
    # 6000 distinct of 6000 rows: an id; a cap of 5000 values makes it numerical (5000/6000 < 0.95)
    df = spark.range(6000).selectExpr("cast(id * 3 as bigint) as k", "cast(id % 7 as int) as y")
    assert feature_types(df)["k"] == "id"
    assert feature_types(df, distinct_cap=5000)["k"] == "numerical"


def test_problem_type(spark):
    df = spark.createDataFrame([(1, 1.5, "a"), (2, 2.5, "b"), (1, 3.5, "a")], "i int, d double, s string")
    assert problem_type(df, "i") == "Classification"
    assert problem_type(df, "d") == "Regression"
    assert problem_type(df, "s") == "Classification"
    one = spark.createDataFrame([(1,), (1,)], "i int")
    with pytest.raises(TaskError):
        problem_type(one, "i")
    with pytest.raises(TaskError):
        problem_type(df, "missing")


@pytest.mark.parametrize("share,th,converted", [(0.55, 0.5, True), (0.55, 0.6, False), (0.65, 0.6, True),
                                                (0.65, 0.8, False), (0.85, 0.8, True)])
def test_date_coercion_thresholds(spark, share, th, converted):
    n = 200
    k = int(n * share)
    rows = [(f"03/{(i % 28) + 1:02d}/2021",) if i < k else ("garbage",) for i in range(n)]
    df = spark.createDataFrame(rows, "d string")
    out, chosen = coerce_dates(df, th)
    assert ("d" in chosen) == converted
    if converted:
        assert chosen["d"] == "MM/dd/yyyy"
        assert out.where("d IS NOT NULL").count() == k


def test_bare_year_and_clock_are_not_dates(spark):
    df = spark.createDataFrame([("2020",), ("12:30",), ("hello",)], "d string")
    _, chosen = coerce_dates(df, 0.3)
    assert chosen == {}
