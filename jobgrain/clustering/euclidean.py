"""Euclidean silhouette of two numeric features without pairs of tuples.

Where one feature (`level`, e.g. years of experience) has few distinct values, the
other (`wide`, e.g. salary) any number, no Python runs; else see `quadtree`. Within a level the distance is an
absolute difference, handled by running sums. Between levels that differ by c
the distance sqrt(dx^2 + c^2) is smooth in dx at the scale of c, so the rows of
a cell no wider than c act exactly (to rounding) like NODES weighted points at
its Chebyshev nodes. Cells are halved dyadically and each leaf cell meets, at
every depth, only the few cells of its interaction list, by an equi-join; the
work grows with tuples * NODES, never with tuples squared.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.clustering import quadtree, scoring
from jobgrain.clustering.features import CLUSTER, WEIGHT
from jobgrain.clustering.silhouette import abs_difference_sums, mean_silhouette
from jobgrain.operators.scale import small_join

NODES = 20
# Up to this many distinct values a feature is taken as levels; beyond, both features go through `quadtree`.
FEW_LEVELS = 64
MAX_SERIES = 5_000

_NODE = [math.cos((2 * q + 1) * math.pi / (2 * NODES)) for q in range(NODES)]
# Chebyshev series coefficients from values at the nodes; the transpose turns
# moments of the polynomials into weights at the nodes.
_TO_SERIES = [[(1.0 if n == 0 else 2.0) / NODES * math.cos(n * math.acos(t)) for t in _NODE]
              for n in range(NODES)]


def _sql(values) -> str:
    if isinstance(values, list):
        return f"array({', '.join(_sql(v) for v in values)})"
    return f"{values!r}D"


def _dot(a: str, b: str) -> str:
    return f"aggregate(zip_with({a}, {b}, (p, q) -> p * q), 0D, (total, v) -> total + v)"


def _times(matrix: list[list[float]], vector: str) -> str:
    return f"transform({_sql(matrix)}, line -> {_dot('line', vector)})"


# T_0 .. T_{NODES-1} at cos(_angle), as an array.
_POLYNOMIALS = f"transform(sequence(0, {NODES - 1}), n -> cos(n * _angle))"


def level_values(tuples: DataFrame, level: str) -> list[float] | None:
    """The distinct values in order, or None if they are many."""
    rows = tuples.select(level).distinct().limit(FEW_LEVELS + 1).collect()
    return None if len(rows) > FEW_LEVELS else sorted(r[0] for r in rows)


def _angle(u: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), u)))


def _moments(points: DataFrame, keys: list[str], x: str, weight: str, center: Column, half: Column) -> DataFrame:
    """Weights at the cell's nodes, `_q` array, that stand for its points."""
    sums = (points.withColumn("_angle", _angle((F.col(x) - center) / half)).groupBy(*keys)
            .agg(*[F.expr(f"sum({weight} * cos({n} * _angle))").alias(f"_t{n}") for n in range(NODES)]))
    transposed = [list(column) for column in zip(*_TO_SERIES)]
    vector = f"array({', '.join(f'_t{n}' for n in range(NODES))})"
    return sums.select(*keys, F.expr(_times(transposed, vector)).alias("_q"))


def euclidean_sums(tuples: DataFrame, wide: str, level: str, levels: list[float], low: float, high: float,
                   k: int, bounds=()) -> DataFrame:
    """Tuples with `_d0.._d{k-1}`: summed distance to the rows of each cluster.

    `low` and `high` bound the wide feature, `levels` lists the other's values.
    """
    same = abs_difference_sums(tuples, wide, k, bounds, by=[level])
    near = tuples.join(same, [level, wide])
    gaps = [b - a for a, b in zip(levels, levels[1:])]
    if not gaps:
        return near.select(*tuples.columns, *[F.col(f"_s{i}").alias(f"_d{i}") for i in range(k)])
    span = max(high - low, 1e-300)
    depth = max(0, math.ceil(math.log2(span / min(gaps)))) if span > min(gaps) else 0

    def cell(x, d):
        return F.least(F.floor((x - F.lit(low)) / F.lit(span) * F.lit(float(2 ** d))), F.lit(2 ** d - 1)).cast("bigint")

    def half(d: Column) -> Column:
        return F.lit(span / 2) / F.pow(F.lit(2.0), d)

    def center(d: Column, c: Column) -> Column:
        return F.lit(low) + (c * 2 + 1) * half(d)

    d_leaf = F.lit(depth)
    placed = tuples.withColumn("_leaf", cell(F.col(wide), depth))
    leaf = _moments(placed, ["_leaf", level, CLUSTER], wide, WEIGHT,
                    center(d_leaf, F.col("_leaf")), half(d_leaf))

    # The leaf nodes stand for all rows; gather them into the coarser cells.
    points = leaf.select("_leaf", level, CLUSTER, F.posexplode("_q").alias("_i", "_w")).withColumn(
        "_x", center(d_leaf, F.col("_leaf")) + half(d_leaf) * F.element_at(F.lit(_NODE), F.col("_i") + 1))
    sources = leaf.select(d_leaf.alias("_depth"), F.col("_leaf").alias("_cell"), level, CLUSTER, "_q")
    if depth > 2:
        up = points.withColumn("_depth", F.explode(F.sequence(F.lit(2), F.lit(depth - 1)))).withColumn(
            "_cell", F.floor(F.col("_leaf") / F.pow(F.lit(2.0), F.lit(depth) - F.col("_depth"))).cast("bigint"))
        coarse = _moments(up, ["_depth", "_cell", level, CLUSTER], "_x", "_w",
                          center(F.col("_depth"), F.col("_cell")), half(F.col("_depth")))
        sources = sources.unionByName(coarse)

    # Which cells a leaf cell meets: its neighbours, and per depth the children of
    # its parent's neighbours that are not its own neighbours.
    leaves = leaf.select("_leaf").distinct()
    meets = leaves.select("_leaf", d_leaf.alias("_depth"),
                          F.explode(F.sequence(F.col("_leaf") - 1, F.col("_leaf") + 1)).alias("_cell"))
    if depth >= 2:
        own = F.floor(F.col("_leaf") / F.pow(F.lit(2.0), F.lit(depth) - F.col("_depth"))).cast("bigint")
        parent = F.floor(F.col("_own") / 2).cast("bigint")
        far = (leaves.withColumn("_depth", F.explode(F.sequence(F.lit(2), d_leaf))).withColumn("_own", own)
               .withColumn("_cell", F.explode(F.sequence(2 * (parent - 1), 2 * (parent + 1) + 1)))
               .where(F.abs(F.col("_cell") - F.col("_own")) > 1).select("_leaf", "_depth", "_cell"))
        meets = meets.unionByName(far)

    # Potential at the nodes of each leaf cell, one column per target level, then
    # its Chebyshev coefficients.
    targets = F.posexplode(F.lit(_NODE)).alias("_t", "_u")
    met = (meets.join(sources, ["_depth", "_cell"])
           .select("_leaf", "_depth", "_cell", F.col(level).alias("_from"), CLUSTER, "_q", targets)
           .withColumn("_dx", center(d_leaf, F.col("_leaf")) + half(d_leaf) * F.col("_u")
                       - center(F.col("_depth"), F.col("_cell")))
           .withColumn("_h", half(F.col("_depth"))))

    def potential(target: float) -> Column:
        distance = f"sqrt(pow(_dx - _h * u, 2) + pow(_from - {target!r}D, 2))"
        terms = f"zip_with(_q, {_sql(_NODE)}, (w, u) -> w * {distance})"
        return F.when(F.col("_from") != F.lit(target),
                      F.expr(f"aggregate({terms}, 0D, (total, v) -> total + v)")).otherwise(F.lit(0.0))

    at_nodes = met.groupBy("_leaf", CLUSTER, "_t").agg(
        *[F.sum(potential(e)).alias(f"_g{j}") for j, e in enumerate(levels)])
    by_level = at_nodes.select("_leaf", CLUSTER, "_t", F.inline(F.array(*[
        F.struct(F.lit(e).alias(level), F.col(f"_g{j}").alias("_g")) for j, e in enumerate(levels)])))
    # NODES values per leaf cell, level and cluster.
    values = "transform(array_sort(collect_list(struct(_t, _g))), v -> v._g)"
    series = (by_level.groupBy("_leaf", level, CLUSTER)
              .agg(F.expr(values).alias("_values"))
              .withColumn("_series", F.expr(_times(_TO_SERIES, "_values")))
              .groupBy("_leaf", level)
              .agg(*[F.max(F.when(F.col(CLUSTER) == i, F.col("_series"))).alias(f"_series{i}") for i in range(k)]))

    u = (F.col(wide) - center(d_leaf, F.col("_leaf"))) / half(d_leaf)
    # One row per leaf cell and level, however many tuples a cell has.
    found = (small_join(near.withColumn("_leaf", cell(F.col(wide), depth)), series, ["_leaf", level], "left", MAX_SERIES)
             .withColumn("_angle", _angle(u)).withColumn("_polynomials", F.expr(_POLYNOMIALS)))

    def total(i: int) -> Column:
        across = F.expr(_dot(f"_series{i}", "_polynomials"))
        return (F.col(f"_s{i}") + F.coalesce(across, F.lit(0.0))).alias(f"_d{i}")

    return found.select(*tuples.columns, *[total(i) for i in range(k)])


def plane_silhouette(tuples: DataFrame, wide: str, level: str, low: float, high: float,
                     sizes: list[int], levels: list[float] | None = None, bounds=()) -> DataFrame:
    """One row: `silhouette`. `low` and `high` bound the wide feature; both features may have any number of values."""
    levels = level_values(tuples, level) if levels is None else levels
    if levels is None:
        labelled = tuples.withColumn(scoring.LABELS, F.array(CLUSTER))
        score, = scoring.silhouettes(quadtree.plane_sums(labelled, wide, level, [len(sizes)]), [sizes])
        return tuples.sparkSession.createDataFrame([(score,)], "silhouette double")
    return mean_silhouette(
        euclidean_sums(tuples, wide, level, levels, low, high, len(sizes), bounds), sizes)
