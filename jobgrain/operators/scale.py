"""Shared ways to keep a join or an iteration safe at any data size."""

import math
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A key is hot when it holds more than this share of the rows, so at most
# 1 / HOT_SHARE keys can be hot: the broadcast of hot keys has a fixed bound.
HOT_SHARE = 0.002
# Values a sketch of frequent items keeps at most: counts are right to about a third of a thousandth of the rows.
TRACKED = 10_000
BROADCAST_ROWS = 20_000
HUGE_METHOD, HUGE_METHOD_DEFAULT = "spark.sql.codegen.hugeMethodLimit", "65535"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by the cluster; a local one only on a local master."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = current.get() if current.isDefined() else None
    if root is None:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="jobgrain-checkpoint-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, visible to all executors."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Materialise `df` in the checkpoint folder and cut its lineage."""
    spark = df.sparkSession
    root = checkpoint_root(spark)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return df.checkpoint(eager=True)


@contextmanager
def setting(spark: SparkSession, name: str, value: str):
    """Actions inside run with `name` set to `value`."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def small_join(left: DataFrame, right: DataFrame, keys, how: str = "inner",
               limit: int = BROADCAST_ROWS) -> DataFrame:
    """Equi-join that broadcasts `right` if it has at most `limit` rows.

    The check fetches at most `limit + 1` rows, and those are what is broadcast.
    A larger `right` goes through `spread_join`.
    """
    rows = right.limit(limit + 1).collect()
    if len(rows) > limit:
        return spread_join(left, right, keys, how)
    return left.join(F.broadcast(left.sparkSession.createDataFrame(rows, right.schema)), _listed(keys), how)


def compile_wide(spark: SparkSession) -> None:
    """Has Spark split the code of wide projections, unless the session sets a limit of its own.

    The virtual machine leaves methods of more than 8,000 bytes uncompiled, and a projection of some dozen nested columns in
    whole-stage code is one such method. With this limit Spark runs it by its split code instead.
    """
    if spark.conf.get(HUGE_METHOD) == HUGE_METHOD_DEFAULT:
        spark.conf.set(HUGE_METHOD, "8000")


def few_values(df: DataFrame, column: str, limit: int = BROADCAST_ROWS) -> bool:
    """Whether a column has at most `limit` distinct values."""
    return df.select(column).distinct().limit(limit + 1).count() <= limit


def use_all_cores(df: DataFrame, key: str) -> DataFrame:
    """Deal out an input that has fewer splits than there are cores.

    A file of one row group is one task, however much work follows the scan.
    Inputs with enough splits are returned as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores, key)


def _listed(keys) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _code(df: DataFrame, keys: list[str]) -> Column:
    return F.xxhash64(*[df[k] for k in keys])


def hot_keys(df: DataFrame, keys, share: float = HOT_SHARE) -> dict[int, int]:
    """Number of salts of each key that holds more than `share` of the rows, by the hash of the key.

    One pass over the keys alone: every task sends a sketch of its most frequent keys, no key is shuffled. A key gets as many
    salts as it holds shares. Rows without a key count like a key. Two keys of one hash are only dealt out together.
    """
    keys = _listed(keys)
    most = int(1 / share) + 1
    found = df.select(_code(df, keys).alias("_code")).agg(
        F.expr(f"approx_top_k(_code, {most}, {max(TRACKED, most)})").alias("top"), F.count(F.lit(1)).alias("n")).first()
    return salts_of({r["item"]: r["count"] for r in found["top"]}, found["n"], share)


def salts_of(counts: dict[int, int], total: int, share: float = HOT_SHARE) -> dict[int, int]:
    """Salts of the keys of more than `share` of `total` rows."""
    return {code: math.ceil(n / (share * total)) for code, n in counts.items() if n > share * total}


def spread_join(left: DataFrame, right: DataFrame, keys, how: str,
                share: float = HOT_SHARE, hot: dict[int, int] | None = None) -> DataFrame:
    """Equi-join of any `left` with a `right` that has few rows per key.

    Rows of a hot key on the left, and rows without a key if they are many, are dealt over salts by a hash of the whole row,
    and the matching right rows are repeated for each salt, so no task gets a whole hot key, however the input is split, and
    a retried task deals its rows the same way. Without hot keys this is a plain join. `hot` is what `hot_keys` or `salts_of`
    gives where counts are known already.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type {how!r}")
    keys = _listed(keys)
    hot = hot_keys(left, keys, share) if hot is None else hot
    if not hot:
        return left.join(right, keys, how)
    # At most 1 / share rows, so safe to broadcast at any size of the inputs.
    table = F.broadcast(left.sparkSession.createDataFrame(list(hot.items()), "_hot long, _salts int"))
    maps = [f.name for f in left.schema.fields if "map<" in f.dataType.simpleString()]  # maps have no hash
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns if c not in maps])
    salted_left = (left.withColumn("_code", _code(left, keys)).join(table, F.col("_code") == F.col("_hot"), "left")
                   .withColumn("_salt", F.coalesce(F.pmod(row, F.col("_salts")), F.lit(0)).cast("int")).select(*left.columns, "_salt"))
    salts = F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)
    salted_right = (right.withColumn("_code", _code(right, keys)).join(table, F.col("_code") == F.col("_hot"), "left")
                    .select(*right.columns, F.explode(salts).alias("_salt")))
    return salted_left.join(salted_right, [*keys, "_salt"], how).drop("_salt")
