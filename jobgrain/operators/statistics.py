"""Market statistics."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain import fixed_values as V
from jobgrain.functions.numbers import lookup, percent
from jobgrain.operators.quantiles import quantiles
from jobgrain.operators.tally import AMOUNT, ITEM, ROWS, VALUE, part, slots_of, tally


def salary_coverage(df: DataFrame, flag: str = "has_salary") -> DataFrame:
    counts = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col(flag)).alias("with_salary"))
    rest = F.col("total") - F.col("with_salary")
    return counts.select("total", "with_salary", rest.alias("without_salary"),
                         percent(F.col("with_salary"), F.col("total")).alias("with_pct"),
                         percent(rest, F.col("total")).alias("without_pct"))


def salary_summary(df: DataFrame, value: str = "salary_avg", currency: str | None = None) -> DataFrame:
    """Mean, median, least and greatest of the known values, in two passes."""
    if currency is not None:
        df = df.where(F.col("salary_currency") == currency)
    counts = tally(df, amounts={value: F.col(value)}, slots=[value])
    return _summary(counts, df, value)


def _summary(counts: DataFrame, df: DataFrame, value: str) -> DataFrame:
    """The summary from a tally; the median passes over the values of its slot once more."""
    median = quantiles(df, value, {"median": 0.5}, slots=slots_of(counts, value)).first()["median"]
    return (part(counts, AMOUNT, value).groupBy().agg(F.try_divide(F.sum("total"), F.sum("known")).alias("mean"), F.min("low").alias("min"), F.max("high").alias("max"))
            .select("mean", F.lit(median).cast("double").alias("median"), "min", "max"))


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count and share per value; unknown values count only in the denominator."""
    counts = df.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("total")).scalar()
    return (counts.where(F.col("value").isNotNull())
            .select("value", "n", percent(F.col("n"), total).alias("pct"))
            .orderBy(F.desc("n"), "value"))


def mean_experience(df: DataFrame) -> DataFrame:
    return df.agg(F.avg("min_experience_years").alias("mean_min_years"),
                  F.avg("avg_experience_years").alias("mean_avg_years"))


def mean_skills(df: DataFrame, count: str = "skills_count") -> DataFrame:
    return df.agg(F.avg(count).alias("mean_skills"))


def skill_counts(df: DataFrame, skills: str = "skills_list") -> DataFrame:
    """Mentions per skill; a skill listed twice in one posting counts twice."""
    return (df.select(F.explode(skills).alias("skill")).where(F.col("skill").isNotNull())
            .groupBy("skill").agg(F.count(F.lit(1)).alias("n")))


def top_skills(df: DataFrame, n: int = 10, skills: str = "skills_list") -> DataFrame:
    """The `n` most mentioned skills with their share of postings; ties by name."""
    total = df.agg(F.count(F.lit(1)).alias("total")).scalar()
    return (skill_counts(df, skills).orderBy(F.desc("n"), "skill").limit(n)
            .select("skill", "n", percent(F.col("n"), total).alias("pct"))
            .orderBy(F.desc("n"), "skill"))


def skill_vocabulary(df: DataFrame, n: int = 15, more_than: int = 10,
                     skills: str = "skills_list") -> list[str]:
    """Names of the `n` top skills, none for a table of `more_than` rows or fewer."""
    if len(df.select(skills).where(F.col(skills).isNotNull()).limit(more_than + 1).collect()) <= more_than:
        return []
    return [r["skill"] for r in
            skill_counts(df, skills).orderBy(F.desc("n"), "skill").limit(n).collect()]


def skill_demand(df: DataFrame, wanted=V.DEMAND_SKILLS, skills: str = "skills_list") -> DataFrame:
    """Mentions of each wanted skill, 0 for one that never occurs."""
    counts = skill_counts(df.select(F.filter(skills, lambda s: s.isin(list(wanted))).alias(skills)), skills)
    names = df.sparkSession.createDataFrame([(s,) for s in wanted], "skill string")
    return names.join(counts, "skill", "left").select("skill", F.coalesce("n", F.lit(0)).alias("demand"))


def moments(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean, population deviation, least and greatest of each column, one row."""
    return df.agg(*[f(F.col(c).cast("double")).alias(f"{c}_{tag}")
                    for c in columns
                    for tag, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Zero mean and unit population deviation; a constant column becomes 0."""
    stats = moments(df, columns)
    one = stats.select(F.struct("*").alias("m")).scalar()

    def z(c: str) -> Column:
        x = F.col(c).cast("double")
        scaled = (x - one[f"{c}_mean"]) / F.nullif(one[f"{c}_std"], F.lit(0.0))
        return F.when(x.isNotNull(), F.coalesce(scaled, F.lit(0.0))).alias(c)

    return df.select(*[z(c) if c in columns else F.col(f"`{c}`") for c in df.columns])


def home_summary(df: DataFrame, as_of: Column, active_days: int = 30) -> DataFrame:
    """Totals of the base as of a date."""
    day = F.to_date(as_of)
    recent = F.col("published_date").between(F.date_sub(day, active_days), day)
    totals = df.agg(
        F.count(F.lit(1)).alias("total_vacancies"), F.count_if("has_salary").alias("with_salary"),
        F.avg("salary_avg").alias("avg_salary"), F.count_if(recent).alias("active_vacancies"),
        F.max("published_date").alias("last_updated"))
    return totals.withColumn("with_salary_pct", percent(F.col("with_salary"), F.col("total_vacancies")))


def market_kpis(df: DataFrame, as_of: Column, region: str | None = None, period: str = "all",
                source: str | None = None, region_column: str = "area_name",
                source_column: str = "source") -> DataFrame:
    """Mean salary and count in the period, change of the last 12 months in %.

    `period` is `month`, `year` or `all`; the change always compares the 12
    months up to `as_of` with the 12 before.
    """
    months = {"month": 1, "year": 12, "all": None}[period]
    if region is not None:
        df = df.where(F.col(region_column) == region)
    if source is not None:
        df = df.where(F.col(source_column) == source)
    day, published = F.to_date(as_of), F.col("published_date")
    year_ago, two_years_ago = F.add_months(day, -12), F.add_months(day, -24)
    inside = published <= day
    if months is not None:
        inside &= published > F.add_months(day, -months)
    this_year = F.count_if((published > year_ago) & (published <= day))
    last_year = F.count_if((published > two_years_ago) & (published <= year_ago))
    return df.agg(
        F.avg(F.when(inside, F.col("salary_avg"))).alias("avg_salary"),
        F.count_if(inside).alias("total_vacancies"),
        F.try_divide((this_year - last_year) * 100.0, last_year).alias("yearly_change"))


def trend_by_level(df: DataFrame, levels=V.LEVELS, table=V.LEVEL_BY_EXPERIENCE,
                   column: str = "experience_id") -> DataFrame:
    """Postings per month, one column per seniority level."""
    labelled = df.select("published_year_month", lookup(F.col(column), table).alias("level"))
    return (labelled.groupBy("published_year_month").pivot("level", list(levels))
            .agg(F.count(F.lit(1))).na.fill(0).orderBy("published_year_month"))


def statistics_report(df: DataFrame, top: int = 10) -> DataFrame:
    """The clean table's statistics as tidy (section, key, value) rows.

    One pass over the table makes a tally of all figures, a second one narrows the median down.
    """
    counts = tally(df, amounts={"salary_avg": F.col("salary_avg"), "has_salary": F.col("has_salary").cast("int"), "skills_count": F.col("skills_count")},
                   values=["experience_name"], items=["skills_list"], slots=["salary_avg"])
    amounts = {r["feature"]: r for r in part(counts, AMOUNT).collect()}
    total = part(counts, ROWS).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    with_salary = int((amounts["has_salary"]["total"] if amounts else 0) or 0)
    skills = amounts.get("skills_count")
    mean = skills["total"] / skills["known"] if skills and skills["known"] else None
    salary = _summary(counts, df, "salary_avg").first()

    def share(n: int) -> float:
        return 100.0 * n / total if total else 0.0

    rest = total - with_salary
    rows = [("salary_coverage", "with_salary", float(with_salary)), ("salary_coverage", "without_salary", float(rest)),
            ("salary_coverage", "with_pct", share(with_salary)), ("salary_coverage", "without_pct", share(rest)),
            *[("salary", c, salary[c]) for c in ("mean", "median", "min", "max")], ("skills", "mean_skills", mean)]
    single = df.sparkSession.createDataFrame([(*r, None) for r in rows], "section string, key string, value double, pct double")

    def listed(section: str, found: DataFrame) -> DataFrame:
        return found.select(F.lit(section).alias("section"), "key", F.col("n").cast("double").alias("value"), percent(F.col("n"), F.lit(total)).alias("pct"))

    levels = part(counts, VALUE, "experience_name").where(F.col("key").isNotNull())
    best = part(counts, ITEM, "skills_list").orderBy(F.desc("n"), "key").limit(top)
    return single.union(listed("experience", levels)).union(listed("top_skills", best))
