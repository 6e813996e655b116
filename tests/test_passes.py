"""How often reports read their input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobgrain.clustering import profile
from jobgrain.operators import statistics
from jobgrain.operators.tally import tally

ROWS = 4_000


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(2)
    rows = [(int(rng.integers(0, 3)), None if i % 5 == 0 else float(rng.lognormal(11, 1)), str(rng.choice(["junior", "senior"])),
             int(rng.choice([0, 1, 3])), str(rng.choice(["удаленно", "office"])), [str(s) for s in rng.choice(list("abcdefg"), 2)]) for i in range(ROWS)]
    return spark.createDataFrame(rows, "cluster int, salary_avg double, experience_name string, min_experience_years int, schedule_name string,"
                                       " skills_list array<string>").withColumns({
        "has_salary": F.col("salary_avg").isNotNull(), "skills_count": F.size("skills_list"), "name": F.col("experience_name")})


def passes(spark, df, action) -> float:
    """Rows that were read, as a multiple of the table: a function on a column that every figure needs counts them."""
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    counted = df.withColumn("salary_avg", F.udf(count, "double").asNondeterministic()("salary_avg"))
    action(counted)
    return seen.value / ROWS


def test_statistics_report_takes_two_passes(spark, table):
    want = statistics.salary_summary(table).first()
    assert want["median"] == pytest.approx(np.median([r[0] for r in table.select("salary_avg").dropna().collect()]))
    assert passes(spark, table, lambda df: statistics.statistics_report(df).collect()) <= 2.1
    assert passes(spark, table, lambda df: statistics.salary_summary(df).collect()) <= 2.1


def test_profiles_take_two_passes(spark, table):
    want = sorted(map(repr, profile.profiles(table, 3, ["salary_avg"], ["schedule_name"]).collect()))
    got = []
    assert passes(spark, table, lambda df: got.extend(profile.profiles(df, 3, ["salary_avg"], ["schedule_name"]).collect())) <= 2.1
    assert sorted(map(repr, got)) == want


def test_report_of_an_empty_table(spark, table):
    rows = {(r["section"], r["key"]): r["value"] for r in statistics.statistics_report(table.where("false")).collect()}
    assert rows["salary_coverage", "with_salary"] == 0.0 and rows["salary", "median"] is None and rows["skills", "mean_skills"] is None
    assert rows["salary_coverage", "with_pct"] == 0.0


def test_tally_counts_nulls_apart(spark):
    df = spark.createDataFrame([("a", 1.0, ["x", None, "x"]), (None, None, None), ("a", 3.0, [])], "v string, p double, l array<string>")
    rows = {(r["kind"], r["feature"], r["key"]): (r["n"], r["known"], r["total"]) for r in
            tally(df, amounts={"p": F.col("p")}, values=["v"], items=["l"]).collect()}
    assert rows == {("rows", None, None): (3, 0, None), ("amount", "p", None): (3, 2, 4.0), ("value", "v", "a"): (2, 0, None),
                    ("value", "v", None): (1, 0, None), ("item", "l", "x"): (2, 0, None)}
