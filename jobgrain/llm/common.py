"""Helpers that several corpus operators share: table access, lineage cuts, words and linked groups."""

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows that are broadcast at most, and the number of parts of a hot key beyond that.
BROADCAST_ROWS = 500_000
SALTS = 16
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# ASCII letters only: the other letters of a text keep their case.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the supplied tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


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


def _checkpoint_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Write `df` to the shared checkpoint folder and cut its lineage.

    The folder is the one the cluster names in `spark.checkpoint.dir`. Without
    that setting a local master gets a folder of its own; a cluster is refused,
    since its executors could not read each other's files. Shuffle files of `df` are
    deleted once its rows are written, as nothing reads them any more.
    """
    _checkpoint_folder(df.sparkSession)
    with setting(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        return df.checkpoint(eager=True)


def packed(df: DataFrame) -> DataFrame:
    """`df` written to the shared checkpoint folder in compressed columns, which take a fraction of the room of `settle`.

    Rows come back in other partitions, without an order.
    """
    folder = f"{_checkpoint_folder(df.sparkSession)}/packed-{uuid.uuid4().hex}"
    with setting(df.sparkSession, SHUFFLE_CLEANUP, "true"):
        df.write.option("compression", "zstd").parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], unique: str) -> DataFrame:
    """Left join with a `right` of one row per key; nulls in a key are equal to each other.

    Up to BROADCAST_ROWS rows of `right`, which are counted, are broadcast. Beyond, each is repeated for every salt and the
    rows of `left` are dealt over the salts by their `unique` column, so that a hot key is split.
    """
    names = {k: f"_right_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    same = [left[k].eqNullSafe(right[r]) for k, r in names.items()]
    if right.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), same, "left").drop(*names.values())
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(unique), F.lit(SALTS)).cast("int"))
    dealt = right.withColumn("_right_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    same = [salted[k].eqNullSafe(dealt[r]) for k, r in (names | {"_salt": "_right_salt"}).items()]
    return salted.join(dealt, same, "left").drop("_salt", "_right_salt", *names.values())


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Actions inside hand at most `rows` rows at once to a Python worker, which bounds its memory for long texts."""
    with setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def ascii_lower(text):
    """`text` with A-Z in lower case and everything else untouched.

    `lower` would also change other letters, so it is only used where there are none.
    """
    by_letter = text
    for big, small in zip(UPPER, LOWER):
        by_letter = F.replace(by_letter, F.lit(big), F.lit(small))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(by_letter)


def connected(links: DataFrame, left: str, right: str) -> DataFrame:
    """Connected components of undirected `links`: one row (node, root) per linked node.

    `root` is the smallest node of the component. Each round gives every node the
    smallest root among its neighbours and then follows that root one step, so a
    chain of length n takes about log n rounds. Each round is cut by a checkpoint.
    Sums are minima, so a node with very many links is combined before the shuffle.
    """
    edges = settle(links.select(F.col(left).alias("a"), F.col(right).alias("b"))
                   .union(links.select(F.col(right), F.col(left))).distinct())
    roots = settle(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
                   .select("node", F.least("node", "low").alias("root")))
    while True:
        near = (edges.join(roots.withColumnRenamed("node", "b"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low")))
        nearer = roots.join(near, "node").select("node", F.least("root", "low").alias("mid"), F.col("root").alias("old"))
        jump = roots.select(F.col("node").alias("mid"), F.col("root").alias("far"))
        following = settle(nearer.join(jump, "mid").select("node", F.least("mid", "far").alias("root"), "old"))
        roots = following.select("node", "root")
        if following.where("root != old").isEmpty():
            return roots
