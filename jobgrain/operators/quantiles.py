"""Exact interpolated quantiles by selection in rounds, without a buffer of all values.

Spark's `percentile` keeps every distinct value of a group in one buffer. Here the
first round counts the values in slots of a logarithmic scale, which any aggregate can
carry along. The slot that holds a wanted rank is known exactly from the counts. If its
least and greatest value differ, the next round reads only the values between these two:
few are listed and put in order, many are counted in SLOTS narrower slots. A long tail
or a far outlier costs a round at most, since every round starts from the bounds of the
values that are left.
"""

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.operators.scale import BROADCAST_ROWS, settle, spread_join

# Slots of the first round per doubling of the value.
DETAIL = 64
SLOTS = 4_096
# Rows of a slot whose values are listed; of more they are counted in slots again.
ONE_SORT = 200_000

STATE = ["_r", "_rank", "_before", "_n", "_low", "_high", "_total"]


def known(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The values as `_x`, with their groups; missing values and values without a group are left out."""
    x = F.col(value).cast("double")
    return df.select(*by, x.alias("_x")).dropna(subset=[*by, "_x"])


def slot(x: Column) -> Column:
    """Number of a slot of the first round: it never falls as x rises."""
    return F.floor(F.signum(x) * F.log2(F.abs(x) + 1.0) * DETAIL)


def slot_counts(df: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    """The first round: rows, least and greatest value of each slot of each group."""
    by = list(by)
    return (known(df, value, by).groupBy(*by, slot(F.col("_x")).alias("_slot"))
            .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")))


def _held(df: DataFrame) -> list | DataFrame:
    """The state between rounds: local rows if they are few, else written."""
    rows = df.limit(BROADCAST_ROWS + 1).collect()
    return rows if len(rows) <= BROADCAST_ROWS else settle(df)


def _picked(counted: DataFrame, keys: list[str]) -> DataFrame:
    """The slots that hold the wanted rank of their bracket, with the rows before them."""
    upto = F.col("_before") + F.sum("_n").over(W.partitionBy(*keys, "_r").orderBy("_low").rowsBetween(W.unboundedPreceding, W.currentRow))
    return (counted.withColumn("_upto", upto).where((F.col("_rank") < F.col("_upto")) & (F.col("_rank") >= F.col("_upto") - F.col("_n")))
            .withColumn("_before", F.col("_upto") - F.col("_n")).select(*keys, *STATE))


def _narrowed(rows: DataFrame, state: list | DataFrame, schema: T.StructType, by: list[str], one_sort: int) -> DataFrame:
    """One round over the values within the brackets of `state`."""
    if by:
        small = isinstance(state, list)
        brackets = rows.sparkSession.createDataFrame(state, schema) if small else state
        brackets = brackets.groupBy(*by).agg(F.collect_list(F.struct(*STATE)).alias("_b"))  # two for each quantile
        placed = rows.join(F.broadcast(brackets), by) if small else spread_join(rows, brackets, by, "inner")
    else:
        listed = [F.struct(*[F.lit(b[c]).alias(c) for c in STATE]) for b in state]
        placed = rows.withColumn("_b", F.array(*listed))
    inside = F.filter("_b", lambda b: (F.col("_x") >= b["_low"]) & (F.col("_x") <= b["_high"]))
    cut = placed.select(*by, "_x", F.inline(inside))
    # Halves, so that the width of a bracket stays finite.
    share = (F.col("_x") / 2 - F.col("_low") / 2) / (F.col("_high") / 2 - F.col("_low") / 2)
    few = F.col("_n") <= one_sort
    counted = (cut.withColumns({"_slot": F.when(~few, F.floor(share * SLOTS)), "_value": F.when(few, F.col("_x"))})
               .groupBy(*by, "_r", "_rank", "_before", "_total", "_slot", "_value")
               .agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_low"), F.max("_x").alias("_high")))
    return _picked(counted, by)


def quantiles(df: DataFrame, value: str, probs: dict[str, float], by: list[str] = (),
              one_sort: int = ONE_SORT, slots: DataFrame | None = None) -> DataFrame:
    """One row per group with a column per entry of `probs`, plus the count `n`.

    Linear interpolation at rank p * (n - 1). Groups without a value are absent; without `by` there is always one row.
    The rounds run at once: one over all rows, unless its `slots` are given, and mostly one over the wanted slots only.
    """
    by, names = list(by), list(probs)
    spark, rows = df.sparkSession, known(df, value, by)
    slots = slot_counts(df, value, by) if slots is None else slots
    last = F.col("_total") - 1
    ranks = F.array(*[F.struct(F.lit(2 * i + up).alias("_r"), f(F.lit(float(p)) * last).cast("long").alias("_rank"))
                      for i, p in enumerate(probs.values()) for up, f in enumerate((F.floor, F.ceil))])
    wanted = (slots.withColumns({"_total": F.sum("_n").over(W.partitionBy(*by)), "_before": F.lit(0).cast("long")})
              .select(*by, "_n", "_low", "_high", "_total", "_before", F.inline(ranks)))
    first = _picked(wanted, by)
    schema, state, done = first.schema, _held(first), []
    while True:
        if isinstance(state, list):
            left = [r for r in state if r["_low"] < r["_high"]]
            done.append([r for r in state if r["_low"] == r["_high"]])
            if not left:
                break
        else:
            left = state.where("_low < _high")
            done.append(state.where("_low = _high"))
            if left.isEmpty():
                break
        state = _held(_narrowed(rows, left, schema, by, one_sort))

    def between(low: float | None, high: float | None, p: float, total: int) -> float | None:
        part = p * (total - 1)
        return None if low is None else low + (high - low) * (part - math.floor(part))

    types = T.StructType([*[f for f in schema.fields if f.name in by], *[T.StructField(n, T.DoubleType()) for n in names], T.StructField("n", T.LongType(), False)])
    if all(isinstance(d, list) for d in done):
        groups: dict[tuple, dict] = {} if by else {(): {}}
        totals: dict[tuple, int] = {}
        for r in (r for d in done for r in d):
            key = tuple(r[c] for c in by)
            groups.setdefault(key, {})[r["_r"]], totals[key] = r["_low"], r["_total"]
        return spark.createDataFrame([(*key, *[between(at.get(2 * i), at.get(2 * i + 1), float(p), totals.get(key, 0)) for i, p in enumerate(probs.values())],
                                       totals.get(key, 0)) for key, at in groups.items()], types)
    frames = [spark.createDataFrame(d, schema) if isinstance(d, list) else d for d in done]
    found = reduce(DataFrame.union, frames)

    def column(i: int, p: float) -> Column:
        low, high = (F.max(F.when(F.col("_r") == 2 * i + up, F.col("_low"))) for up in (0, 1))
        part = F.lit(float(p)) * (F.max("_total") - 1)
        return (low + (high - low) * (part - F.floor(part))).alias(names[i])

    return found.groupBy(*by).agg(*[column(i, p) for i, p in enumerate(probs.values())], F.max("_total").alias("n"))
