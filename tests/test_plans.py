from __future__ import annotations

import random

import pytest

from lakemart import plans

from helpers import physical_plan, row_set, rows


@pytest.fixture
def ages(spark):
    data = [(30, 20.5), (30, 1.0), (40, None), (None, 5.0), (50, 90.0)]
    return spark.createDataFrame(data, "Age bigint, BMI double")


def test_flagship_order_null_key_and_blank_group(ages):
    result = plans.sum_by_category(ages, "Age", "BMI")
    assert result.columns == ["Age", "Sum of BMI"]
    assert rows(result) == [(50, 90.0), (30, 21.5), (None, 5.0)]


def test_ties_are_ordered_by_category(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 1.0), ("c", 2.0)], "k string, v double")
    assert rows(plans.sum_by_category(df, "k", "v")) == [("c", 2.0), ("a", 1.0), ("b", 1.0)]


def test_sum_of_groups_is_total(spark):
    rng = random.Random(7)
    data = [(rng.randrange(20), rng.randrange(1000)) for _ in range(2000)]
    df = spark.createDataFrame(data, "k bigint, v bigint")
    sums = rows(plans.sum_by_category(df, "k", "v"))
    assert sum(s for _, s in sums) == sum(v for _, v in data)
    assert [s for _, s in sums] == sorted((s for _, s in sums), reverse=True)


def test_collation_is_binary(spark):
    df = spark.createDataFrame([("A", 1.0), ("a", 2.0), ("a ", 4.0)], "k string, v double")
    assert rows(plans.sum_by_category(df, "k", "v")) == [("a ", 4.0), ("a", 2.0), ("A", 1.0)]


def health_source(spark):
    columns = [c.source for c in plans.HEALTH.columns]
    data = [
        ("59", "2", 32.1, 101.0, 157, 93.2, 38.0, 4.0, 4.86, 87, 151, "extra"),
        ("48", "1", 21.6, 87.0, 183, 103.2, 70.0, 3.0, 3.89, 69, 75, "extra"),
        ("x", "1", 1.0, 1.0, 1, 1.0, 1.0, 1.0, 1.0, 1, 1, "extra"),
    ]
    return spark.createDataFrame(data, [*columns, "HIDDEN"])


def test_health_view(spark):
    view = plans.view(health_source(spark), plans.HEALTH)
    assert view.dtypes == [
        ("Age", "bigint"), ("Gender", "bigint"), ("BMI", "double"), ("BP", "double"),
        ("S1", "bigint"), ("S2", "double"), ("S3", "double"), ("S4", "double"),
        ("S5", "double"), ("S6", "bigint"), ("Y", "bigint"),
    ]
    assert [r[0] for r in rows(view)] == [59, 48, None]


def test_view_of_text_equals_try_cast(spark):
    texts = ["1", " 7 ", "\t-3\n", "+4", "2.9", "", " ", "x", "1-URGENT", "1 2", "--1", "1e3", "\u00a05",
             "9223372036854775807", "9223372036854775808", "0x1", "\u0661", None, "1\n", "\x7f8", "+", "1L"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    model = plans.Model("m", (plans.Column("n", "t", "int64"), plans.Column("d", "t", "double")))
    expected = rows(df.selectExpr("try_cast(t AS bigint)", "try_cast(t AS double)"))
    assert str(rows(plans.view(df, model))) == str(expected)


def test_view_can_raise_instead_of_null(spark):
    strict = plans.Model("m", (plans.Column("Age", "AGE", "int64"),), errors_as_null=False)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        plans.view(health_source(spark), strict).collect()


def test_summarize_uses_declared_defaults(spark):
    result = plans.summarize(plans.view(health_source(spark), plans.HEALTH), plans.HEALTH)
    assert result.columns[:3] == ["Age", "Gender", "Sum of BMI"]
    assert len(result.columns) == 11
    assert result.count() == 3


def test_summarize_picks_columns(spark):
    view = plans.view(health_source(spark), plans.HEALTH)
    result = plans.summarize(view, plans.HEALTH, by=["Gender"], measures=["Y"])
    assert row_set(result) == [(1, 76), (2, 151)]
    with pytest.raises(ValueError):
        plans.summarize(view, plans.HEALTH, measures=["Age"])


def test_integer_overflow_is_null(spark):
    df = spark.createDataFrame([(1, 2**62), (1, 2**62), (2, 5)], "k bigint, v bigint")
    model = plans.Model(
        "m", (plans.Column("k", "k", "int64"), plans.Column("v", "v", "int64", "sum"))
    )
    assert row_set(plans.summarize(plans.view(df, model), model)) == [(1, None), (2, 5)]
    strict = plans.Model("m", model.columns, errors_as_null=False)
    with pytest.raises(Exception, match="OVERFLOW"):
        plans.summarize(plans.view(df, strict), strict).collect()


def test_model_checks_its_declaration():
    with pytest.raises(ValueError):
        plans.Column("a", "a", "string")
    with pytest.raises(ValueError):
        plans.Column("a", "a", "int64", "max")
    with pytest.raises(KeyError):
        plans.HEALTH.column("nope")


def test_cross_filter_list(ages):
    assert row_set(plans.cross_filter(ages, "Age", [30])) == [(30, 1.0), (30, 20.5)]
    assert row_set(plans.cross_filter(ages, "Age", [40, None])) == [(40, None), (None, 5.0)]
    assert row_set(plans.cross_filter(ages, "Age", [None])) == [(None, 5.0)]
    assert row_set(plans.cross_filter(ages, "Age", [])) == []


def test_cross_filter_table(spark, ages):
    selected = spark.createDataFrame([(30,), (30,), (None,)], "Age bigint")
    expected = [(30, 1.0), (30, 20.5), (None, 5.0)]
    assert row_set(plans.cross_filter(ages, "Age", selected)) == expected


def test_cross_filter_list_reaches_the_scan(spark, small_dir):
    parts = spark.read.parquet(f"{small_dir}/part.parquet")
    plan = physical_plan(plans.cross_filter(parts, "p_size", [1, 2]))
    assert "PushedFilters: [In(p_size, [1,2])]" in plan
