"""Filters on the literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from jobgrain.operators import filters
from jobgrain.schema import POSTING_RAW


def postings(spark, rows):
    return spark.read.schema(POSTING_RAW).json(spark.sparkContext.parallelize([json.dumps(r) for r in rows]))


def ids(df):
    return sorted(r["id"] for r in df.collect())


def test_title(spark):
    df = postings(spark, [{"id": 1, "name": "Аналитик данных"}, {"id": 2, "name": "Разработчик Python"},
                          {"id": 3, "name": "Data Analyst"}, {"id": 4, "name": None}, {"id": 5, "name": "HR data analyst"},
                          {"id": 6}, {"id": 7, "name": "Data analyst, synchro team"}])
    assert ids(filters.by_title(df)) == ["1", "3"]


def test_role(spark):
    df = postings(spark, [{"id": 1, "professional_roles": [{"id": "156"}]}, {"id": 2, "professional_roles": [{"id": "1"}]},
                          {"id": 3, "professional_roles": []}, {"id": 4}, {"id": 5, "professional_roles": [{"id": "157"}, {"id": 10}]},
                          {"id": 6, "professional_roles": [{"id": None}]}])
    assert ids(filters.by_role(df)) == ["1", "5"]


def test_salary(spark):
    df = postings(spark, [{"id": 1, "salary": {"from": 100, "to": 200, "currency": "RUR"}}, {"id": 2, "salary": None},
                          {"id": 3, "salary": {}}, {"id": 4, "salary": {"currency": "RUR"}},
                          {"id": 5, "salary": {"to": 150, "currency": "RUR"}}, {"id": 6, "salary": {"from": 100, "currency": "USD"}},
                          {"id": 7, "salary": {"from": 0, "to": 500, "currency": "RUR"}}])
    assert ids(filters.by_salary(df)) == list("1234567")
    assert ids(filters.by_salary(df, low=100)) == ["1", "5"]
    assert ids(filters.by_salary(df, low=0, high=0)) == ["7"]
    assert ids(filters.by_salary(df, high=150)) == ["1", "5", "7"]
    assert ids(filters.by_salary(df, high=150, currency="USD")) == ["6"]


@pytest.mark.parametrize("column, f", [("experience", filters.by_experience), ("employment", filters.by_employment),
                                       ("schedule", filters.by_schedule)])
def test_by_id(spark, column, f):
    df = postings(spark, [{"id": 1, column: {"id": "a"}}, {"id": 2, column: {"id": "b"}}, {"id": 3, column: None}, {"id": 4}])
    assert ids(f(df, {"a"})) == ["1"]
    assert ids(f(df, [])) == ids(f(df, None)) == list("1234")


def test_skill_text(spark):
    df = postings(spark, [{"id": 1, "snippet": {"requirement": "SQL and Python"}}, {"id": 2, "snippet": {"requirement": None}},
                          {"id": 3}, {"id": 4, "snippet": {"requirement": "sql, java"}}])
    assert ids(filters.by_skill_text(df)) == list("1234")
    assert ids(filters.by_skill_text(df, ["Sql"])) == ["1", "4"]
    assert ids(filters.by_skill_text(df, ["Sql"], ["JAVA"])) == ["1"]
    assert ids(filters.by_skill_text(df, None, ["java"])) == ["1", "2", "3"]


@pytest.mark.parametrize("count, kept", [(10, 11), (11, 11)])
def test_outliers_need_more_than_ten_values(spark, count, kept):
    values = [(float(i),) for i in range(count - 1)] + [(1e6,), (None,)]
    df = spark.createDataFrame(values, "salary_avg double")
    out = filters.without_outliers(df)
    assert out.count() == kept
    assert out.where(F.col("salary_avg").isNull()).count() == 1


def test_outliers_of_an_empty_table(spark):
    assert filters.without_outliers(spark.createDataFrame([(None,)], "salary_avg double")).count() == 1


def test_features_must_be_selected(spark):
    df = spark.createDataFrame([(1, None), (None, "a"), (2, "b")], "a int, b string")
    assert filters.with_features(df, ["a", "b"]).count() == 1
    with pytest.raises(ValueError):
        filters.with_features(df, [])


def test_remote(spark):
    df = spark.createDataFrame([("УДАЛЕННАЯ работа",), ("Полный день",), (None,)], "s string")
    assert [r[0] for r in df.select(filters.is_remote(F.col("s"))).collect()] == [True, False, False]
