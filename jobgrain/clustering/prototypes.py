"""K-Modes and K-Prototypes by repeated DataFrame aggregates.

Centroids are k literal rows on the driver, so a plan never grows with the
number of iterations and no lineage has to be cut inside the loop.
"""

from functools import reduce
from operator import add

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.clustering.features import CLUSTER, WEIGHT, FeatureSet, distance, nearest
from jobgrain.operators.scale import small_join

DENSITY = "density"

MAX_ITER = 100


def value_frequencies(tuples: DataFrame, column: str) -> DataFrame:
    """Relative frequency of each value of one categorical feature."""
    counts = tuples.groupBy(column).agg(F.sum(WEIGHT).alias("_n"))
    total = counts.agg(F.sum("_n").alias("total")).scalar()
    return counts.select(column, (F.col("_n") / total).alias(f"_f_{column}"))


def with_density(tuples: DataFrame, features: FeatureSet) -> DataFrame:
    """Mean relative frequency of a tuple's categorical values."""
    out = tuples
    for c in features.categorical:
        out = small_join(out, value_frequencies(tuples, c), c)
    shares = [F.col(f"_f_{c}") for c in features.categorical]
    return (out.withColumn(DENSITY, reduce(add, shares) / F.lit(float(len(shares))))
            .drop(*[f"_f_{c}" for c in features.categorical]))


def cao_seeds(dense: DataFrame, features: FeatureSet, k: int, gamma: float = 1.0) -> list[dict]:
    """The densest tuple, then k-1 times the tuple of largest min(distance) * density.

    `dense` is `with_density(...)`. Ties go to numerics nearest the mean, then to
    the smallest tuple. Seeds for a smaller k are a prefix of these, so a sweep
    calls this once. Stops early when all distinct tuples are used.
    """
    spread = reduce(add, [F.abs(F.col(c)) for c in features.numeric], F.lit(0.0))
    order = F.struct(spread.alias("spread"), *[F.col(c) for c in features.categorical + features.numeric])
    row = F.struct(*features.columns)
    seeds: list[dict] = []
    while len(seeds) < k:
        if seeds:
            gap = F.least(*([distance(features, s, gamma) for s in seeds] + [F.lit(float("inf"))]))
            score = gap * F.col(DENSITY)
            pool = dense.where(gap > 0)
        else:
            score, pool = F.col(DENSITY), dense
        # min_by over the negated score and the tuple order: one partial aggregate.
        best = pool.agg(F.min_by(row, F.struct((-score).alias("s"), order.alias("o"))).alias("seed")).first()
        if best["seed"] is None:
            break
        seeds.append(best["seed"].asDict())
    return seeds


def update(tuples: DataFrame, features: FeatureSet, centroids: list[dict],
           gamma: float) -> tuple[list[dict], float]:
    """New centroids and the cost of the old ones, in one job.

    Numeric centroid: weighted mean. Categorical centroid: weighted mode, the
    smallest value on a tie. An empty cluster keeps its centroid.
    """
    rows = update_table(tuples, features, centroids, gamma).collect()  # k rows per feature
    cost = 0.0
    new = [dict(c) for c in centroids]
    for r in rows:
        if r["feature"] is None:
            cost += r["cost"]
            for c in features.numeric:
                new[r[CLUSTER]][c] = r[f"mean_{c}"]
        else:
            new[r[CLUSTER]][r["feature"]] = r["value"]
    return new, cost


def update_table(tuples: DataFrame, features: FeatureSet, centroids: list[dict],
                 gamma: float) -> DataFrame:
    """One step as a table: per cluster a row of sums, per categorical its mode."""
    placed = tuples.withColumn("_near", nearest(features, centroids, gamma))
    # The sums ride along as a feature without a name, so tuples are read once.
    pairs = ["named_struct('feature', string(null), 'value', string(null))"] + [
        f"named_struct('feature', '{c}', 'value', `{c}`)" for c in features.categorical]
    unnamed = [f"if(feature is null, `{c}` * {WEIGHT}, null)" for c in features.numeric]
    counted = (placed.selectExpr(f"_near.cid as {CLUSTER}", f"{WEIGHT} * _near.d as _cost", WEIGHT,
                                 *[f"`{c}`" for c in features.numeric], f"inline(array({', '.join(pairs)}))")
               .groupBy(CLUSTER, "feature", "value")
               .agg(F.expr(f"sum({WEIGHT}) as _n"), F.expr("sum(_cost) as _cost"),
                    *[F.expr(f"sum({u}) as `_s_{c}`") for u, c in zip(unnamed, features.numeric)]))
    return counted.groupBy(CLUSTER, "feature").agg(
        F.expr("min(struct(-_n as n, value as v)).v as value"), F.expr("sum(_n) as size"), F.expr("sum(_cost) as cost"),
        *[F.expr(f"sum(`_s_{c}`) / sum(_n) as `mean_{c}`") for c in features.numeric])


def fit(tuples: DataFrame, features: FeatureSet, seeds: list[dict], gamma: float,
        max_iter: int = MAX_ITER) -> tuple[list[dict], float, list[float]]:
    """Iterate until the cost stops falling; returns centroids, cost, cost history."""
    centroids, history = seeds, []
    while len(history) < max_iter:
        moved, cost = update(tuples, features, centroids, gamma)
        if history and cost >= history[-1] * (1 - 1e-12):
            history.append(cost)
            break
        history.append(cost)
        if moved == centroids:
            break
        centroids = moved
    return centroids, history[-1], history


def default_gamma(features: FeatureSet) -> float:
    """Half the mean deviation of the scaled numerics; 1 without numerics."""
    if not features.numeric:
        return 1.0
    return 0.5 * sum(1.0 if features.moments[c].std else 0.0 for c in features.numeric) / len(features.numeric)
