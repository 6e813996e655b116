"""Distances of all pairs of tuples, for results that need the matrix itself.

Scores never need it (see `scoring`, `quadtree`); an export of the matrix does. The
number of pairs is checked before any is made.
"""

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.clustering.features import gower
from jobgrain.operators.scale import settle

LIMIT = 20_000
TILE_ROWS = 1_000


def pairwise(tuples: DataFrame, numeric: dict[str, float], categorical: list[str], metric: str = "gower",
             limit: int = LIMIT, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b, distance) of every pair of different rows once; `a` and `b` are structs of the features and the row's number.

    `numeric` gives the range of each numeric feature, which "gower" divides by; "euclidean" takes numeric features only and
    "hamming" is the share of different features. Rows are numbered from 0 in the order of the features. More than `limit`
    rows raise a ValueError, since the result grows with their square. The rows are dealt into blocks, and every pair of
    blocks, the triangle only, is one key of an equi-join.
    """
    columns = [*numeric, *categorical]
    count = tuples.count()
    if count > limit:
        raise ValueError(f"{count} rows make {count * (count - 1) // 2} pairs; the limit is {limit} rows")
    # At most `limit` rows, so one sorted run numbers them.
    numbered = settle(tuples.select(*columns).orderBy(*columns).coalesce(1).withColumn("row", F.monotonically_increasing_id()))
    blocks = max(1, math.ceil(count / tile_rows))
    block = F.pmod(F.col("row"), F.lit(blocks))
    whole = F.struct("row", *columns)
    left = numbered.select(whole.alias("a"), block.alias("i"), F.explode(F.sequence(block, F.lit(blocks - 1).cast("long"))).alias("j"))
    right = numbered.select(whole.alias("b"), F.explode(F.sequence(F.lit(0).cast("long"), block)).alias("i"), block.alias("j"))
    met = left.join(right, ["i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a.row") < F.col("b.row")))
    return met.select("a", "b", _distance(metric, numeric, categorical).alias("distance"))


def _distance(metric: str, numeric: dict[str, float], categorical: list[str]) -> Column:
    a = {c: F.col("a")[c] for c in [*numeric, *categorical]}
    b = {c: F.col("b")[c] for c in [*numeric, *categorical]}
    if metric == "gower":
        return gower(a, b, numeric, categorical)
    if metric == "hamming":
        return sum(((a[c] != b[c]).cast("double") for c in a), F.lit(0.0)) / F.lit(float(len(a)))
    if metric == "euclidean" and not categorical:
        return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in a), F.lit(0.0)))
    raise ValueError(f"no {metric!r} distance of these features")
