"""Column functions on literals, edge cases first."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain import fixed_values as V
from jobgrain.functions import dates, nested, numbers, text
from jobgrain.operators import clean


def one(spark, column, **values):
    names = list(values)
    schema = T.StructType([T.StructField(n, _type(v)) for n, v in values.items()])
    return spark.createDataFrame([tuple(values[n] for n in names)], schema).select(column.alias("v")).first()["v"]


def _type(v):
    return {str: T.StringType(), float: T.DoubleType(), int: T.LongType(), type(None): T.StringType(),
            list: T.ArrayType(T.StringType())}[type(v)]


@pytest.mark.parametrize("raw, want", [("\t a b \n", "a b"), ("  x ", "x"), ("", ""), ("\x1cx\x1f", "x"),
                                       (None, None), ("a b", "a b")])
def test_strip(spark, raw, want):
    assert one(spark, text.strip(F.col("a")), a=raw) == want


@pytest.mark.parametrize("raw, want", [
    ("{'from': 10, 'to': None, 'currency': 'RUR'}", (10.0, None, "RUR")),
    ('{"from": 1.5, "to": null, "currency": "USD"}', (1.5, None, "USD")),
    ("{'from': None, 'to': 7, 'currency': 'None of True'}", (None, 7.0, "None of True")),
    ("  {'currency': 'it\\'s None, False', 'from': None}  ", (None, None, "it's None, False")),
    ("not nested", None), (None, None)])
def test_parse_struct_cell(spark, raw, want):
    schema = T.StructType.fromDDL("`from` double, `to` double, currency string")
    got = one(spark, nested.parse_cell(F.col("a"), schema), a=raw)
    assert (tuple(got) if got else got) == want


def test_parse_list_cell_with_bare_words(spark):
    schema = T.ArrayType(T.StructType.fromDDL("name string, hot boolean"))
    raw = "[{'name': 'A', 'hot': True}, {'name': None, 'hot': False}]"
    assert [tuple(e) for e in one(spark, nested.parse_cell(F.col("a"), schema), a=raw)] == [("A", True), (None, False)]
    many = "[" + ", ".join("{'name': 'n', 'hot': None}" for _ in range(3000)) + "]"
    assert len(one(spark, nested.parse_cell(F.col("a"), schema), a=many)) == 3000


def test_bad_cells_are_flagged(spark):
    schema = T.StructType.fromDDL("name string, salary struct<`from`: double>")
    df = spark.createDataFrame([(" a ", "{'from': 1}"), ("b", "{broken"), ("c", None)], "name string, salary string")
    rows = clean.parse_cells(df, schema).collect()
    assert [r["name"] for r in rows] == ["a", "b", "c"]
    assert [r["_bad_cells"] for r in rows] == [[], ["salary"], []]


@pytest.mark.parametrize("raw, want", [("12", 12.0), (" 1.5e3 ", 1500.0), ("-.5", -0.5), ("1d", None), ("abc", None), ("", None),
                                       ("NaN", None), ("1_000", None), ("7.", 7.0), (None, None)])
def test_to_number(spark, raw, want):
    assert one(spark, numbers.to_number(F.col("a")), a=raw) == want


@pytest.mark.parametrize("low, high, want", [(100000.0, 150000.0, 125000.0), (100000.0, None, 100000.0),
                                             (None, 150000.0, 150000.0), (None, None, None), (0.0, 0.0, 0.0)])
def test_salary_avg(spark, low, high, want):
    df = spark.createDataFrame([(low, high)], "a double, b double")
    assert df.select(numbers.salary_avg(F.col("a"), F.col("b"))).first()[0] == want


def test_experience_years(spark):
    df = spark.createDataFrame([(("noExperience", "x"),), (("between1And3", "x"),), (("between3And6", "x"),),
                                (("moreThan6", "x"),), (("other", "x"),), (None,)],
                               "experience struct<id: string, name: string>")
    rows = df.select(*clean.experience_columns()).collect()
    assert [r["min_experience_years"] for r in rows] == [0, 1, 3, 6, None, None]
    assert [r["avg_experience_years"] for r in rows] == [0, 2, 4, 8, None, None]


def test_nan_salary_is_missing(spark):
    df = spark.createDataFrame([((float("nan"), None, "RUR"),)], "salary struct<`from`: double, `to`: double, currency: string>")
    row = df.select(*clean.salary_columns()).first()
    assert row["salary_from"] is None and row["has_salary"] is False and row["salary_avg"] is None


def test_dates_near_midnight_and_future(spark):
    day = F.lit("2026-01-28 12:00:00+00:00").cast("timestamp")
    df = spark.createDataFrame([("2026-01-28T01:36:00+0300",), ("2026-01-28T01:36:00+03:00",), ("2026-01-28T15:00:01+00:00",), ("bad",)],
                               "published_at string")
    rows = df.select(*clean.date_columns(day)).collect()
    assert [str(r["published_date"]) for r in rows] == ["2026-01-28", "2026-01-28", "2026-01-28", "None"]
    assert [r["published_year_month"] for r in rows][:2] == ["2026-01", "2026-01"]
    assert [r["days_since_publication"] for r in rows] == [0, 0, -1, None]
    assert rows[0]["published_at"] == rows[1]["published_at"]
    assert df.select(F.unix_timestamp(dates.instant(F.col("published_at")))).first()[0] == 1769553360


@pytest.mark.parametrize("name, want", [
    ("BI-аналитик", "BI Analyst"), ("Big Data BI developer", "Data Analyst"), ("Mobile analyst", "Other"),
    ("Mobile Tableau analyst", "BI Analyst"), ("Системный аналитик", "System Analyst"), ("Бизнес-аналитик", "Business Analyst"),
    ("Финансовый аналитик", "Financial Analyst"), ("Аналитик данных", "Data Analyst"), ("Повар", "Other"), (None, "Other")])
def test_job_family(spark, name, want):
    assert one(spark, text.first_rule(F.col("a"), V.JOB_FAMILY_RULES, V.OTHER_FAMILY), a=name) == want


def test_lexicon_modes(spark):
    lexicon = {"Java": ["java"], "SQL": ["sql", "SQL"], "Upper": ["ONLY UPPER"], "R": [" r "]}
    tags = lambda mode, s: one(spark, text.lexicon_tags(F.col("a"), lexicon, mode), a=s)
    assert tags("substring", "JavaScript and only upper") == ["Java"]
    assert tags("word", "JavaScript") == []
    assert tags("word", "Java, SQL.") == ["Java", "SQL"]
    assert tags("substring", "a r b") == ["R"]
    assert tags("substring", None) == []


def test_union_lists_with_missing(spark):
    assert one(spark, text.union_lists(F.col("a"), F.col("b")), a=["b", "a", "b"], b=["c"]) == ["a", "b", "c"]
    df = spark.createDataFrame([(None, ["x"])], "a array<string>, b array<string>")
    assert df.select(text.union_lists(F.col("a"), F.col("b"))).first()[0] == ["x"]


def test_display_numbers(spark):
    assert one(spark, numbers.money_text(F.col("a"), "-"), a=1234567.9) == "1 234 567 ₽"
    assert spark.sql("select cast(null as double) a").select(numbers.money_text(F.col("a"), "-")).first()[0] == "-"
    assert one(spark, numbers.compact_money(F.col("a")), a=145999.0) == "145K ₽"
    assert one(spark, numbers.compact_money(F.col("a")), a=100000.0) == "100000 ₽"
    assert one(spark, numbers.percent(F.col("a"), F.col("b")), a=1, b=0) == 0.0


@pytest.mark.parametrize("years, want", [(0.0, 60000), (3.0, 105000), (0.1, 62000), (0.3, 64000), (1 / 6, 62000)])
def test_salary_estimate_rounds_half_to_even(spark, years, want):
    e = one(spark, numbers.salary_estimate(F.col("a")), a=years)
    assert (e["predicted_salary"], e["low"], e["high"]) == (want, want - 10000, want + 10000)


def test_indicator_collisions_get_a_suffix(spark):
    df = spark.createDataFrame([(["A B", "a/b"],), (["a/b"],)], "skills_list array<string>")
    rows = clean.skill_indicators(df, ["A B", "a/b"]).collect()
    assert [(r["skill_a_b"], r["skill_a_b_2"]) for r in rows] == [(1, 1), (0, 1)]


def test_missing_list_differs_from_first_of_empty(spark):
    df = spark.createDataFrame([(None,), ([],), ([("S",)],)], "key_skills array<struct<name: string>>")
    rows = df.select(nested.names_of(F.col("key_skills")).alias("n"), nested.first_field(F.col("key_skills"), "name").alias("f")).collect()
    assert [(r["n"], r["f"]) for r in rows] == [([], None), ([], None), (["S"], "S")]
