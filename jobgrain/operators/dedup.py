"""Deduplication and incremental appends."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobgrain.operators.scale import HOT_SHARE, salts_of, settle, spread_join


def keep_first(df: DataFrame, key, order_by: list) -> DataFrame:
    """First row per key in the given order; rows with an empty key are dropped.

    Spark cuts each map task to one row per key before the shuffle
    (WindowGroupLimit), so a hot key never piles up in one task.
    """
    keys = [key] if isinstance(key, str) else list(key)
    types = dict(df.dtypes)
    for k in keys:
        df = df.where(F.col(k).isNotNull() & (F.col(k) != "") if types[k] == "string"
                      else F.col(k).isNotNull())
    first = F.row_number().over(W.partitionBy(*keys).orderBy(*order_by))
    return df.withColumn("_rank", first).where("_rank = 1").drop("_rank")


def only_new(batch: DataFrame, seen: DataFrame, key: str = "id", skewed: bool = True) -> DataFrame:
    """Rows of `batch` whose key was not seen; repeats inside the batch stay."""
    known = seen.select(key).where(F.col(key).isNotNull()).distinct()
    if not skewed:
        return batch.join(known, key, "left_anti")
    return spread_join(batch, known, key, "left_anti")


def append(parts: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name; missing columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def collect_batches(df: DataFrame, key: str, batch: str, order_by: list,
                    dedupe_within: bool = False) -> DataFrame:
    """Ordered batches, each adding only keys that no earlier batch had.

    With all batches in one table a key belongs to the first batch it occurs
    in, so one aggregate replaces the chain of anti-joins: its partial step
    shrinks hot keys before the shuffle. It is written once and also tells which
    keys are hot, so the input is read twice. Rows without a key are all kept.
    """
    first = settle(df.groupBy(key).agg(F.min(batch).alias("_first"), F.count(F.lit(1)).alias("_rows")))
    total = first.agg(F.sum("_rows")).first()[0] or 0
    # At most 1 / share keys.
    many = first.where(F.col("_rows") > HOT_SHARE * total).select(F.xxhash64(key).alias("code"), "_rows").collect()
    hot = salts_of({r["code"]: r["_rows"] for r in many}, total) if total else {}
    tied = spread_join(df, first.where(F.col(key).isNotNull()).drop("_rows"), key, "left", hot=hot)
    kept = tied.where(F.col("_first").isNull() | (F.col(batch) == F.col("_first"))).drop("_first")
    return keep_first(kept, key, order_by) if dedupe_within else kept
