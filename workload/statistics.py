"""Aggregates, top-k and reports (A1-A7, A17-A23, K, L6)."""

from pyspark.sql import functions as F

from jobgrain.operators import statistics as S
from jobgrain.operators.quantiles import quantiles
from jobgrain.plans.jobs import observed, relevant
from workload.cleaning import cleaned
from workload.filtering import EXCLUDE, INCLUDE
from workload.registry import query, r
from workload.tables import AS_OF, as_of, raw_postings, table


@query("salary_by_experience", """
SELECT experience_id, count(*) AS n, count(*) FILTER (has_salary) AS with_salary,
  round(avg(salary_avg), 4) AS mean, round(min(salary_avg), 4) AS low, round(max(salary_avg), 4) AS high
FROM p GROUP BY experience_id""")
def flagship(spark, sf):
    return cleaned(spark, sf).groupBy("experience_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("has_salary").alias("with_salary"),
        r(F.avg("salary_avg")).alias("mean"), r(F.min("salary_avg")).alias("low"), r(F.max("salary_avg")).alias("high"))


@query("a01_salary_coverage", """
SELECT count(*) AS total, count(*) FILTER (has_salary) AS with_salary, count(*) FILTER (NOT has_salary) AS without_salary,
  round(100.0 * count(*) FILTER (has_salary) / count(*), 4) AS with_pct,
  round(100.0 * count(*) FILTER (NOT has_salary) / count(*), 4) AS without_pct FROM p""")
def a01(spark, sf):
    return S.salary_coverage(cleaned(spark, sf)).withColumns({"with_pct": r("with_pct"), "without_pct": r("without_pct")})


SUMMARY = """SELECT round(avg(salary_avg), 4) AS mean, round(quantile_cont(salary_avg, 0.5), 4) AS median,
  round(min(salary_avg), 4) AS "min", round(max(salary_avg), 4) AS "max" FROM p"""


def _rounded(df, *columns):
    return df.withColumns({c: r(c) for c in columns})


@query("a02_salary_summary", SUMMARY)
def a02(spark, sf):
    return _rounded(S.salary_summary(cleaned(spark, sf)), "mean", "median", "min", "max")


@query("a02_salary_summary_one_currency", SUMMARY + " WHERE salary_currency = 'USD'")
def a02_usd(spark, sf):
    return _rounded(S.salary_summary(cleaned(spark, sf), currency="USD"), "mean", "median", "min", "max")


@query("a03_experience_distribution", """
SELECT experience_name AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM p), 4) AS pct
FROM p WHERE experience_name IS NOT NULL GROUP BY 1""")
def a03(spark, sf):
    return _rounded(S.distribution(cleaned(spark, sf), "experience_name"), "pct")


@query("a04_mean_experience", """
SELECT round(avg(min_experience_years), 6) AS mean_min_years, round(avg(avg_experience_years), 6) AS mean_avg_years FROM p""")
def a04(spark, sf):
    m = S.mean_experience(cleaned(spark, sf))
    return m.select(r("mean_min_years", 6).alias("mean_min_years"), r("mean_avg_years", 6).alias("mean_avg_years"))


@query("a05_mean_skills", "SELECT round(avg(len(skills_list)), 6) AS mean_skills FROM p")
def a05(spark, sf):
    return S.mean_skills(cleaned(spark, sf)).select(r("mean_skills", 6).alias("mean_skills"))


@query("a06_top_skills", """
WITH e AS (SELECT unnest(skills_list) AS skill FROM p)
SELECT skill, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM p), 4) AS pct FROM e
GROUP BY skill ORDER BY n DESC, skill LIMIT 10""")
def a06(spark, sf):
    return _rounded(S.top_skills(cleaned(spark, sf), 10), "pct")


@query("a06_top_items_ordered", """
SELECT p_name AS skill, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey
GROUP BY p_name ORDER BY n DESC, skill LIMIT 15""", postings=False)
def a06_items(spark, sf):
    """The long form: one row per mention."""
    lines = table(spark, sf, "lineitem").select("l_partkey")
    part = table(spark, sf, "part").select("p_partkey", F.split(F.col("p_name"), r"\|").alias("skills_list"))
    return S.skill_counts(lines.join(part, lines.l_partkey == part.p_partkey)).orderBy(F.desc("n"), "skill").limit(15)


@query("a07_quantiles_events", """
SELECT round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.3), 6) AS q30,
  round(quantile_cont(value, 0.7), 6) AS q70, round(quantile_cont(value, 0.75), 6) AS q75, count(value) AS n FROM events""", postings=False)
def a07(spark, sf):
    return _rounded6(quantiles(table(spark, sf, "events"), "value", {"q25": 0.25, "q30": 0.3, "q70": 0.7, "q75": 0.75}))


def _rounded6(df):
    return df.withColumns({c: r(c, 6) for c, t in df.dtypes if t == "double"})


@query("a07_quantiles_by_flag", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(quantile_cont(l_extendedprice, 0.5), 6) AS q50,
  round(quantile_cont(l_extendedprice, 0.75), 6) AS q75, count(l_extendedprice) AS n FROM lineitem GROUP BY l_returnflag""", postings=False)
def a07_flag(spark, sf):
    return _rounded6(quantiles(table(spark, sf, "lineitem"), "l_extendedprice",
                               {"q25": 0.25, "q50": 0.5, "q75": 0.75}, by=["l_returnflag"]))


KEPT = """p WHERE (contains(lower(name), 'machinery') OR contains(lower(name), 'building') OR contains(lower(name), 'house'))
  AND NOT (contains(lower(name), 'low') OR contains(lower(name), 'urgent'))"""


@query("a17_stage_counts", f"SELECT 'after' AS stage, count(*) AS n FROM {KEPT} UNION ALL SELECT 'before', count(*) FROM p")
def a17(spark, sf):
    """Counts before and after the filter, observed while one job runs."""
    before, n_before = observed(raw_postings(spark, sf).select("id", "name", "k"), "before")
    after, n_after = observed(relevant(before, ["k"], INCLUDE, EXCLUDE), "after")
    after.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([("before", n_before.get["n"]), ("after", n_after.get["n"])], "stage string, n bigint")


@query("a18_home_summary", f"""
SELECT count(*) AS total_vacancies, count(*) FILTER (has_salary) AS with_salary, round(avg(salary_avg), 4) AS avg_salary,
  count(*) FILTER (published_date BETWEEN DATE '{AS_OF[:10]}' - 30 AND DATE '{AS_OF[:10]}') AS active_vacancies,
  CAST(max(published_date) AS VARCHAR) AS last_updated, round(100.0 * count(*) FILTER (has_salary) / count(*), 4) AS with_salary_pct
FROM p""")
def a18(spark, sf):
    home = S.home_summary(cleaned(spark, sf), as_of())
    return _rounded(home, "avg_salary", "with_salary_pct").withColumn("last_updated", F.col("last_updated").cast("string"))


@query("a19_market_kpis", """
WITH f AS (SELECT *, published_date > DATE '2000-07-01' AND published_date <= DATE '2001-07-01' AS ty,
  published_date > DATE '1999-07-01' AND published_date <= DATE '2000-07-01' AS ly FROM p WHERE area_name = 'NATION_3')
SELECT round(avg(salary_avg) FILTER (ty), 4) AS avg_salary, count(*) FILTER (ty) AS total_vacancies,
  round(100.0 * (count(*) FILTER (ty) - count(*) FILTER (ly)) / count(*) FILTER (ly), 4) AS yearly_change FROM f""")
def a19(spark, sf):
    day = F.lit("2001-07-01 00:00:00").cast("timestamp")
    return _rounded(S.market_kpis(cleaned(spark, sf), day, region="NATION_3", period="year"), "avg_salary", "yearly_change")


@query("a20_trend_by_level", """
SELECT published_year_month, count(*) FILTER (experience_id = 'noExperience') AS "Junior",
  count(*) FILTER (experience_id = 'between1And3') AS "Middle",
  count(*) FILTER (experience_id IN ('between3And6', 'moreThan6')) AS "Senior" FROM p GROUP BY 1""")
def a20(spark, sf):
    return S.trend_by_level(cleaned(spark, sf))


@query("a21_skill_demand", """
WITH e AS (SELECT unnest(skills_list) AS skill FROM p), w AS (SELECT unnest(['BUILDING', 'NATION_7', 'HIGH', 'Python']) AS skill)
SELECT w.skill, count(e.skill) AS demand FROM w LEFT JOIN e USING (skill) GROUP BY 1""")
def a21(spark, sf):
    return S.skill_demand(cleaned(spark, sf), ["BUILDING", "NATION_7", "HIGH", "Python"])


@query("a23_column_moments", """
SELECT round(avg(salary_avg), 4) AS salary_avg_mean, round(stddev_pop(salary_avg), 4) AS salary_avg_std,
  min(salary_avg) AS salary_avg_min, max(salary_avg) AS salary_avg_max,
  round(avg(min_experience_years), 4) AS min_experience_years_mean, round(stddev_pop(min_experience_years), 4) AS min_experience_years_std,
  CAST(min(min_experience_years) AS DOUBLE) AS min_experience_years_min, CAST(max(min_experience_years) AS DOUBLE) AS min_experience_years_max FROM p""")
def a23(spark, sf):
    m = S.moments(cleaned(spark, sf), ["salary_avg", "min_experience_years"])
    return m.withColumns({c: r(c) for c in m.columns})


@query("k01_top_by_count", """
SELECT area_name, count(*) AS n FROM p GROUP BY 1 ORDER BY n DESC, area_name LIMIT 5""")
def k01(spark, sf):
    return S.distribution(cleaned(spark, sf), "area_name").limit(5).select(F.col("value").alias("area_name"), "n")


@query("k02_first_ten", "SELECT id, name FROM p ORDER BY k LIMIT 10")
def k02(spark, sf):
    return raw_postings(spark, sf).orderBy("k").limit(10).select("id", "name")


@query("k06_value_counts", "SELECT name AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM p), 4) AS pct FROM p GROUP BY 1")
def k06(spark, sf):
    return _rounded(S.distribution(cleaned(spark, sf), "name"), "pct")


REPORT_SQL = """
WITH n AS (SELECT count(*) AS total, count(*) FILTER (has_salary) AS paid, avg(salary_avg) AS mean,
  quantile_cont(salary_avg, 0.5) AS median, min(salary_avg) AS low, max(salary_avg) AS high, avg(len(skills_list)) AS skills FROM p),
e AS (SELECT unnest(skills_list) AS skill FROM p)
SELECT section, "key", round(CAST(value AS DOUBLE), 4) AS value, round(CAST(pct AS DOUBLE), 4) AS pct FROM (
  SELECT 'salary_coverage' AS section, 'with_salary' AS "key", paid AS value, NULL AS pct FROM n
  UNION ALL SELECT 'salary_coverage', 'without_salary', total - paid, NULL FROM n
  UNION ALL SELECT 'salary_coverage', 'with_pct', 100.0 * paid / total, NULL FROM n
  UNION ALL SELECT 'salary_coverage', 'without_pct', 100.0 * (total - paid) / total, NULL FROM n
  UNION ALL SELECT 'salary', 'mean', mean, NULL FROM n UNION ALL SELECT 'salary', 'median', median, NULL FROM n
  UNION ALL SELECT 'salary', 'min', low, NULL FROM n UNION ALL SELECT 'salary', 'max', high, NULL FROM n
  UNION ALL SELECT 'skills', 'mean_skills', skills, NULL FROM n
  UNION ALL SELECT 'experience', experience_name, count(*), 100.0 * count(*) / (SELECT total FROM n) FROM p
    WHERE experience_name IS NOT NULL GROUP BY 2
  UNION ALL (SELECT 'top_skills', skill, count(*), 100.0 * count(*) / (SELECT total FROM n) FROM e
    GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10))"""


@query("l06_statistics_report", REPORT_SQL)
def l06(spark, sf):
    return _rounded(S.statistics_report(cleaned(spark, sf)), "value", "pct")
