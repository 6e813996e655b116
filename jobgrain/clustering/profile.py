"""Profiles of given clusters.

Every figure is a partial aggregate first; lists are built only from rows that
are already limited per cluster. The results have one row per cluster.
"""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobgrain import fixed_values as V
from jobgrain.clustering.features import CLUSTER
from jobgrain.functions.numbers import money_text
from jobgrain.operators.filters import is_remote
from jobgrain.operators.quantiles import quantiles
from jobgrain.operators.tally import AMOUNT, ITEM, ROWS, VALUE, part, slots_of, tally

TITLE_SHARE = 0.30
# Stands for all clusters together where figures are grouped by cluster.
EVERY = -1


def cluster_ids(df: DataFrame, k: int) -> DataFrame:
    return df.sparkSession.range(k).select(F.col("id").cast("int").alias(CLUSTER))


def sizes(df: DataFrame, k: int) -> DataFrame:
    """Rows per cluster, 0 for an empty one."""
    counts = df.groupBy(CLUSTER).agg(F.count(F.lit(1)).alias("n"))
    return cluster_ids(df, k).join(F.broadcast(counts), CLUSTER, "left").select(CLUSTER, F.coalesce("n", F.lit(0)).alias("n"))


def salaries(df: DataFrame) -> DataFrame:
    """Median and mean of the known salaries per cluster."""
    medians = quantiles(df, "salary_avg", {"median_salary": 0.5}, by=[CLUSTER]).drop("n")
    means = df.groupBy(CLUSTER).agg(F.avg("salary_avg").alias("mean_salary"))
    return means.join(F.broadcast(medians), CLUSTER, "left").select(CLUSTER, "median_salary", "mean_salary")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(cluster, feature, value, n) of the known values, one pass for all columns."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in columns])
    return (df.select(CLUSTER, F.inline(pairs)).where(F.col("value").isNotNull())
            .groupBy(CLUSTER, "feature", "value").agg(F.count(F.lit(1)).alias("n")))


def titles(counts: DataFrame, totals: DataFrame, feature: str = "name", share: float = TITLE_SHARE) -> DataFrame:
    """Names with at least `share` of the cluster, most frequent first.

    At 30% no cluster can have more than three. `totals` has a row per cluster.
    """
    frequent = (counts.where(F.col("feature") == feature)
                .join(F.broadcast(totals.select(CLUSTER, F.col("n").alias("_total"))), CLUSTER)
                .where(F.col("n") / F.col("_total") >= share))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "value")))
    return frequent.groupBy(CLUSTER).agg(F.array_join(F.transform(ordered, lambda t: t["value"]), " / ").alias("titles"))


def top_skills(df: DataFrame, n: int = 5, skills: str = "skills_list") -> DataFrame:
    """The `n` most mentioned skills of each cluster, ties by name."""
    counts = (df.select(CLUSTER, F.explode(skills).alias("skill")).where(F.col("skill").isNotNull())
              .groupBy(CLUSTER, "skill").agg(F.count(F.lit(1)).alias("_n")))
    return _best_items(counts, n)


def _best_items(counts: DataFrame, n: int = 5) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(CLUSTER).orderBy(F.desc("_n"), "skill"))
    best = counts.withColumn("_rank", rank).where(F.col("_rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", "skill")))
    return best.groupBy(CLUSTER).agg(F.transform(ordered, lambda s: s["skill"]).alias("skills"))


def remote_rates(df: DataFrame, schedule: str = "schedule_name", stem: str = V.REMOTE_STEM) -> DataFrame:
    return df.groupBy(CLUSTER).agg(
        (F.avg(is_remote(F.col(schedule), stem).cast("double")) * 100).alias("remote_rate"))


def modes(counts: DataFrame) -> DataFrame:
    """Most frequent value per cluster and feature, the smallest on a tie."""
    pick = F.min(F.struct((-F.col("n")).alias("n"), "value"))
    return counts.groupBy(CLUSTER, "feature").agg(pick["value"].alias("mode"))


def mean_years(df: DataFrame, column: str = "min_experience_years") -> DataFrame:
    return df.groupBy(CLUSTER).agg(F.avg(column).alias("mean_years"))


def salary_tags(df: DataFrame, per_cluster: DataFrame, population: DataFrame | None = None) -> DataFrame:
    """Tag of each cluster's median against the 30% and 70% quantiles.

    The quantiles are over the kept rows, or over `population` if given.
    """
    q = quantiles(df if population is None else population, "salary_avg", {"q30": 0.3, "q70": 0.7}).first()
    return _tagged(per_cluster, q["q30"], q["q70"])


def _tagged(per_cluster: DataFrame, q30: float | None, q70: float | None) -> DataFrame:
    median, low, high = F.col("median_salary"), q30 or 0.0, q70 or 0.0
    tag = (F.when(median.isNull() | F.lit(high <= 0), F.lit(""))
           .when(median > high, V.SALARY_TAG_HIGH).when(median > low, V.SALARY_TAG_NORMAL)
           .otherwise(V.SALARY_TAG_LOW))
    return per_cluster.select("*", tag.alias("salary_tag"))


def profiles(df: DataFrame, k: int, numeric: list[str], categorical: list[str],
             stem: str = V.REMOTE_STEM, population: DataFrame | None = None) -> DataFrame:
    """One row per cluster: id from 1, title, description, count, pay, skills, remote share.

    `df` holds the kept rows with a `cluster` column 0..k-1.
    """
    named = list(dict.fromkeys(["name", *categorical]))
    # One pass for all counts and sums, and one more that narrows the medians and the bounds of the tags down.
    state = tally(df, [CLUSTER], amounts={"salary_avg": F.col("salary_avg"), "min_experience_years": F.col("min_experience_years"),
                                          "remote": is_remote(F.col("schedule_name"), stem).cast("double")},
                  values=named, items=["skills_list"], slots=["salary_avg"])
    totals = part(state, ROWS).select(CLUSTER, "n")
    amounts = part(state, AMOUNT).groupBy(CLUSTER).agg(*[
        F.max(F.when(F.col("feature") == c, F.try_divide(F.col("total"), F.col("known")))).alias(n)
        for c, n in (("salary_avg", "mean_salary"), ("min_experience_years", "mean_years"), ("remote", "_remote"))])
    base = totals.join(amounts, CLUSTER).select(CLUSTER, "n", "mean_salary", "mean_years", (F.col("_remote") * 100).alias("remote_rate"))
    counts = part(state, VALUE).where(F.col("key").isNotNull()).select(CLUSTER, "feature", F.col("key").alias("value"), "n")
    picked = modes(counts.where(F.col("feature").isin(categorical))) if categorical else None
    skills = _best_items(part(state, ITEM).select(CLUSTER, F.col("key").alias("skill"), F.col("n").alias("_n")))

    both = F.array(F.col(CLUSTER), F.lit(EVERY)) if population is None else F.array(CLUSTER)
    slots = slots_of(state.withColumn("_group", F.explode(both)), "salary_avg", ["_group"])
    bounds = quantiles(df.select("salary_avg", F.explode(both).alias("_group")), "salary_avg",
                       {"median_salary": 0.5, "q30": 0.3, "q70": 0.7}, by=["_group"], slots=slots)
    medians = bounds.where(F.col("_group") != EVERY).select(F.col("_group").alias(CLUSTER), "median_salary")
    every = bounds.where(F.col("_group") == EVERY) if population is None else quantiles(population, "salary_avg", {"q30": 0.3, "q70": 0.7})
    limits = every.select("q30", "q70").first()

    out = cluster_ids(df, k)
    for one in (base, medians, titles(counts, base), skills):  # k rows each
        out = out.join(F.broadcast(one), CLUSTER, "left")
    if picked is not None:
        wide = picked.groupBy(CLUSTER).agg(
            *[F.max(F.when(F.col("feature") == c, F.col("mode"))).alias(f"_mode_{c}") for c in categorical])
        out = out.join(F.broadcast(wide), CLUSTER, "left")
    out = _tagged(out, *(limits or (None, None)))

    number = F.col(CLUSTER) + 1
    title = F.coalesce(F.col("titles"), F.concat(F.lit(V.GROUP_TITLE_PREFIX), number))
    title = F.when(F.col("salary_tag") != "", F.concat(title, F.lit(" ("), "salary_tag", F.lit(")"))).otherwise(title)
    parts = [F.col(f"_mode_{c}") for c in categorical]
    if "min_experience_years" in numeric:
        parts.append(F.format_string("Опыт ~%.1f г.", "mean_years"))
    described = F.concat_ws(", ", *parts) if parts else F.lit("")
    return out.select(
        number.alias("id"), title.alias("title"),
        F.when(described != "", described).otherwise(F.lit(V.MIXED_GROUP)).alias("description"),
        F.coalesce("n", F.lit(0)).alias("vacancies_count"),
        "mean_salary", money_text(F.col("mean_salary"), V.SALARY_UNKNOWN).alias("avg_salary"),
        F.coalesce("skills", F.array().cast("array<string>")).alias("skills"),
        F.coalesce("remote_rate", F.lit(0.0)).alias("remote_rate"))
