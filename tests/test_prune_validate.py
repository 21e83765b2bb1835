import pytest

from tessera.operators.prune import align, prune_rules
from tessera.operators.validate import ValidationError, validate, validate_checks


def test_name_rules_and_target_exemption(spark):
    df = spark.createDataFrame([(1, 2.0, 3, 4, 5, 1)], "First int, width double, `Unnamed: 0` int, lastlog int, "
                                                      "amount int, paid int")
    r = prune_rules(df, target="paid")
    assert r["First"] == "name" and r["lastlog"] == "name" and r["width"] == "id"
    assert r["Unnamed: 0"] == "name"     # 'unnamed' contains 'name': rule 1 fires first
    assert "paid" not in r


@pytest.mark.parametrize("values,dropped", [([0, 1, 2, 3], True), ([1, 2, 3, 4], False), ([0, 1, 3, 4], False),
                                             ([0, 1, 1, 2], False), ([3, 1, 0, 2], True)])
def test_row_number_rule(spark, values, dropped):
    df = spark.createDataFrame([(v, i % 2) for i, v in enumerate(values)], "k bigint, y int")
    assert ("k" in prune_rules(df, "y")) == dropped


def test_constant_rule(spark):
    df = spark.createDataFrame([(1, 5, None), (2, 5, None), (3, 5, None)], "y int, c int, n string")
    r = prune_rules(df, "y")
    assert r == {"c": "constant", "n": "constant"}


def test_align(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "a double, extra double")
    out = align(df, ["a", "b"])
    assert out.columns == ["a", "b"] and out.first()["b"] == 0.0


def test_validate_order(spark):
    df = spark.createDataFrame([(None, None)], "a int, b int")
    checks = dict((c, ok) for c, ok, _ in validate_checks(df, "a"))
    assert checks["has_rows"] and not checks["not_all_null"]
    with pytest.raises(ValidationError) as e:
        validate(df, "a")
    assert e.value.check == "not_all_null"
    with pytest.raises(ValidationError) as e:
        validate(spark.createDataFrame([(1, 2)], "a int, b int"), "A")   # case-sensitive
    assert e.value.check == "target_exists"
