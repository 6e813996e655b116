"""Silhouette from per-cluster distance sums, without any pair of rows.

The Gower and Hamming distances are sums over features, so the distances of a
tuple to a whole cluster are too: a categorical term is a count lookup, a
numeric one follows from running counts and sums over the sorted values. The
two-feature Euclidean case, which is not separable, is in `euclidean`.
"""

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobgrain.clustering.features import CLUSTER, WEIGHT
from jobgrain.operators.scale import few_values, spread_join

# Up to this many distinct values one sorted run is fine; beyond, they are cut
# into BUCKETS runs of about equal length.
ONE_RUN = 20_000
BUCKETS = 256


def cluster_sizes(tuples: DataFrame, k: int) -> list[int]:
    """Rows per cluster 0..k-1, empty ones included (k numbers)."""
    found = {r[CLUSTER]: r["n"] for r in
             tuples.groupBy(CLUSTER).agg(F.sum(WEIGHT).alias("n")).collect()}
    return [int(found.get(i, 0)) for i in range(k)]


def skip_reason(sizes: list[int]) -> str | None:
    """Why a labelling cannot be scored, or None."""
    used = sum(1 for n in sizes if n)
    if used < 2:
        return "fewer than two clusters"
    if used >= sum(sizes):
        return "every row is its own cluster"
    return None


@dataclass(frozen=True)
class Columns:
    """What a scoring plan needs to know of the feature columns; the same for every k."""
    cuts: dict[str, list[float]]
    few: set[str]


def inspect(tuples: DataFrame, numeric: list[str], categorical: list[str]) -> Columns:
    """Cuts of the numerics, and which columns have few distinct values."""
    cuts = {c: run_bounds(tuples, c) for c in numeric}
    few = {c for c in numeric if not cuts[c]} | {c for c in categorical if few_values(tuples, c)}
    return Columns(cuts, few)


def run_bounds(tuples: DataFrame, column: str) -> list[float]:
    """Values that cut the distinct values of a column into runs; none if few."""
    if few_values(tuples, column, ONE_RUN):
        return []
    cuts = tuples.select(column).distinct().agg(F.percentile_approx(column, [i / BUCKETS for i in range(1, BUCKETS)], 10_000)).first()[0]
    return sorted(set(cuts))


def abs_difference_sums(tuples: DataFrame, column: str, k: int, bounds=(), by=()) -> DataFrame:
    """Per value x (and `by`), columns `_s0.._s{k-1}`: sum of |x - x_j| over each cluster."""
    by, x = list(by), F.col(column)
    hist = tuples.groupBy(*by, column).agg(*[
        F.sum(F.when(F.col(CLUSTER) == i, F.col(WEIGHT)).otherwise(0)).cast("double").alias(f"_n{i}")
        for i in range(k)])
    counts, masses = [f"_n{i}" for i in range(k)], [F.col(f"_n{i}") * x for i in range(k)]
    whole = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))

    def result(df, upto):
        def total_to(i):
            count, all_count, mass, all_mass = upto(i)
            return x * (2 * count - all_count) + all_mass - 2 * mass
        return df.select(*by, column, *[total_to(i).alias(f"_s{i}") for i in range(k)])

    if not bounds:
        run = whole.orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow)
        return result(hist, lambda i: (F.sum(counts[i]).over(run), F.sum(counts[i]).over(whole),
                                       F.sum(masses[i]).over(run), F.sum(masses[i]).over(whole)))

    hist = hist.withColumn("_run", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < x)))
    totals = hist.groupBy(*by, "_run").agg(
        *[F.sum(c).alias(f"_c{i}") for i, c in enumerate(counts)],
        *[F.sum(m).alias(f"_m{i}") for i, m in enumerate(masses)])
    before = whole.orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    parts = [f"{p}{i}" for p in ("_c", "_m") for i in range(k)]
    offsets = totals.select(*by, "_run",
                            *[F.coalesce(F.sum(p).over(before), F.lit(0.0)).alias(f"_before{p}") for p in parts],
                            *[F.sum(p).over(whole).alias(f"_all{p}") for p in parts])
    # One row per run (and per `by` value): at most BUCKETS rows each.
    placed = hist.join(F.broadcast(offsets), by + ["_run"])
    run = W.partitionBy(*by, "_run").orderBy(column).rowsBetween(W.unboundedPreceding, W.currentRow)
    return result(placed, lambda i: (
        F.col(f"_before_c{i}") + F.sum(counts[i]).over(run), F.col(f"_all_c{i}"),
        F.col(f"_before_m{i}") + F.sum(masses[i]).over(run), F.col(f"_all_m{i}")))


def mismatch_sums(tuples: DataFrame, column: str, sizes: list[int]) -> DataFrame:
    """Per value, columns `_s0..`: rows of each cluster with another value."""
    return tuples.groupBy(column).agg(*[
        (F.lit(n) - F.sum(F.when(F.col(CLUSTER) == i, F.col(WEIGHT)).otherwise(0))).cast("double").alias(f"_s{i}")
        for i, n in enumerate(sizes)])


def gower_sums(tuples: DataFrame, ranges: dict[str, float], categorical: list[str], sizes: list[int],
               columns: Columns | None = None) -> DataFrame:
    """Tuples with `_d0.._d{k-1}`: summed Gower distance to the rows of each cluster."""
    columns = inspect(tuples, list(ranges), categorical) if columns is None else columns
    k, out, terms = len(sizes), tuples, [[] for _ in sizes]

    def attach(sums, c, scale):
        nonlocal out
        named = sums.withColumnsRenamed({f"_s{i}": f"_{c}_{i}" for i in range(k)})
        # One row per distinct value: broadcast only where these were counted.
        out = out.join(F.broadcast(named), c) if c in columns.few else spread_join(out, named, c, "inner")
        for i in range(k):
            terms[i].append(F.col(f"_{c}_{i}") / F.lit(scale))

    for c, r in ranges.items():
        if r:
            attach(abs_difference_sums(tuples, c, k, columns.cuts.get(c, ())), c, float(r))
    for c in categorical:
        attach(mismatch_sums(tuples, c, sizes), c, 1.0)
    features = float(len(ranges) + len(categorical))
    sums = [(reduce(add, t, F.lit(0.0)) / F.lit(features)).alias(f"_d{i}") for i, t in enumerate(terms)]
    return out.select(*tuples.columns, *sums)


def coefficient(sizes: list[int]) -> Column:
    """Silhouette of a tuple from its `_d0..` sums; 0 in a cluster of one."""
    own = F.element_at(F.array(*[F.lit(n) for n in sizes]), F.col(CLUSTER) + 1)
    inner = F.element_at(F.array(*[F.col(f"_d{i}") for i in range(len(sizes))]), F.col(CLUSTER) + 1)
    a = inner / F.nullif(own - 1, F.lit(0))
    others = [F.when(F.col(CLUSTER) != i, F.col(f"_d{i}") / F.lit(float(n))) for i, n in enumerate(sizes) if n]
    b = F.least(*others) if len(others) > 1 else others[0]
    return F.coalesce((b - a) / F.nullif(F.greatest(a, b), F.lit(0.0)), F.lit(0.0))


def mean_silhouette(sums: DataFrame, sizes: list[int]) -> DataFrame:
    """One row: `silhouette` over all rows behind the tuples."""
    return sums.agg((F.sum(coefficient(sizes) * F.col(WEIGHT)) / F.sum(WEIGHT)).alias("silhouette"))


def gower_silhouette(tuples: DataFrame, ranges: dict[str, float], categorical: list[str],
                     sizes: list[int], columns: Columns | None = None) -> DataFrame:
    return mean_silhouette(gower_sums(tuples, ranges, categorical, sizes, columns), sizes)


def hamming_silhouette(tuples: DataFrame, categorical: list[str], sizes: list[int],
                       columns: Columns | None = None) -> DataFrame:
    return gower_silhouette(tuples, {}, categorical, sizes, columns)


def line_silhouette(tuples: DataFrame, column: str, sizes: list[int], columns: Columns | None = None) -> DataFrame:
    """Euclidean with one feature: the absolute difference."""
    return gower_silhouette(tuples, {column: 1.0}, [], sizes, columns)
