"""Shards along a Hilbert curve over document metadata.

Each metadata dimension is cut into 2**bits levels at its own quantiles, the
levels are turned into the index of a Hilbert curve, and the table is ordered by
that index and cut into runs of equal row counts. Rows of one shard are close in
all dimensions at once, so the minimum and maximum that Parquet keeps per file
prune on any of them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.llm.common import settle

DIMENSIONS = ("source", "lang", "n_chars")


def _value(df: DataFrame, name: str) -> Column:
    """A dimension as whole text or as a double that keeps its order."""
    kind = df.schema[name].dataType
    if isinstance(kind, T.StringType):
        return F.col(name)
    if isinstance(kind, (T.DateType, T.TimestampType)):
        return F.unix_seconds(F.col(name).cast("timestamp")).cast("double")
    return F.col(name).cast("double")


def _text_cuts(docs: DataFrame, texts: dict[str, str], levels: int) -> dict[str, list[str]]:
    """Per axis the values of its text dimension at the inner quantiles, whole values in byte order.

    Values are counted first, so a frequent one is one row from there on. The running
    count is the offset of the range partition plus the count inside it. At most
    `levels` values of an axis come to the driver.
    """
    if not texts:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("axis"), F.col(d).alias("value")) for n, d in texts.items()]))
    counts = docs.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("axis", "value").agg(F.count(F.lit(1)).alias("n"))
    placed = settle(counts.repartitionByRange("axis", "value").withColumn("part", F.spark_partition_id()))
    before = Window.partitionBy("axis").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("axis", "part").agg(F.sum("n").alias("held"))
               .withColumns({"base": F.coalesce(F.sum("held").over(before), F.lit(0)),
                             "total": F.sum("held").over(Window.partitionBy("axis"))}).drop("held"))
    inside = F.sum("n").over(Window.partitionBy("axis", "part").orderBy("value"))
    cuts = (placed.withColumn("inside", inside).join(F.broadcast(offsets), ["axis", "part"])
            .where(F.expr(f"(base + inside) * {levels} div total > (base + inside - n) * {levels} div total"))
            .select("axis", "value").collect())
    return {n: sorted(r["value"] for r in cuts if r["axis"] == n) for n in texts}


def _index(df: DataFrame, names: list[str], bits: int) -> DataFrame:
    """Columns `names` hold levels below 2**bits; adds `hilbert`, their place on the curve.

    The known axes-to-transpose scheme: undo the excess rotations from the highest
    bit down, Gray-encode, then interleave the bits.
    """
    first, last = names[0], names[-1]
    x = {n: F.col(n) for n in names}
    for bit in range(bits - 1, 0, -1):
        mask = F.lit((1 << bit) - 1)
        for n in names:
            is_set = F.shiftright(x[n], bit).bitwiseAND(F.lit(1)) == 1
            swap = F.when(is_set, F.lit(0)).otherwise(x[first].bitwiseXOR(x[n]).bitwiseAND(mask))
            flip = F.when(is_set, mask).otherwise(swap)
            changed = {first: x[first].bitwiseXOR(flip)}
            if n != first:
                changed[n] = x[n].bitwiseXOR(swap)
            df = df.withColumns(changed)
    for before, n in zip(names, names[1:]):
        df = df.withColumn(n, x[n].bitwiseXOR(x[before]))
    turn = F.lit(0)
    for bit in range(bits - 1, 0, -1):
        turn = turn.bitwiseXOR(F.when(F.shiftright(x[last], bit).bitwiseAND(F.lit(1)) == 1, F.lit((1 << bit) - 1))
                               .otherwise(F.lit(0)))
    df = df.withColumn("turn", turn).withColumns({n: x[n].bitwiseXOR(F.col("turn")) for n in names})
    parts = [F.shiftleft(F.shiftright(x[n].cast("long"), bit).bitwiseAND(F.lit(1).cast("long")),
                         bit * len(names) + len(names) - 1 - i)
             for bit in range(bits) for i, n in enumerate(names)]
    return df.withColumn("hilbert", sum(parts[1:], parts[0])).drop(*names, "turn")


def hilbert_shards(docs: DataFrame, shards: int = 8, dimensions=DIMENSIONS, bits: int = 4,
                   keep=("doc_id",), text: str = "text") -> DataFrame:
    """`keep` columns of every row with `size`, `text_crc32`, `hilbert`, `shard` and `slot`.

    Shards hold row counts that differ by at most one; `slot` counts from 0 within a
    shard. `size` is the UTF-8 length of the text plus 1.

    Null or empty text has size 1 and the checksum of ''. Text dimensions are cut by
    whole values in byte order. A null metadata value has level 0. Rows that tie on the curve are ordered by a hash of their text and then
    by the place they were read from, so equal rows are all kept and spread like any
    others; a value that fills a third of the table is cut into several shards. An
    empty table gives an empty result. Other columns are not looked at.

    Checksums and `keep` are shuffled once, and of text dimensions the counts of their
    distinct values. The global rank is the offset of the range partition plus the place inside it; the only table that is
    broadcast has one row per partition.
    """
    if bits * len(dimensions) > 62:
        raise ValueError("bits times dimensions must stay below 63")
    levels = 1 << bits
    names = [f"axis_{i}" for i in range(len(dimensions))]
    texts = {n: d for d, n in zip(dimensions, names) if isinstance(docs.schema[d].dataType, T.StringType)}
    numbers = {n: d for d, n in zip(dimensions, names) if n not in texts}
    cuts = _text_cuts(docs, texts, levels)
    if numbers:
        shares = F.array(*[F.lit(i / levels) for i in range(1, levels)])
        cuts |= docs.agg(*[F.percentile_approx(_value(docs, d), shares, 10_000).alias(n) for n, d in numbers.items()]).first().asDict()

    def level(name: str, dimension: str) -> Column:
        value = _value(docs, dimension)
        above = [F.coalesce((value > F.lit(cut)).cast("int"), F.lit(0)) for cut in dict.fromkeys(cuts[name] or [])]
        return sum(above, F.lit(0)).alias(name)

    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.struct(*[F.col(c) for c in keep]).alias("row"),
                       (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"),
                       F.monotonically_increasing_id().alias("read_at"),
                       *[level(n, d) for n, d in zip(names, dimensions)])
    order = ["hilbert", "tie", "read_at"]
    ranked = settle(_index(rows, names, bits).withColumn("tie", F.xxhash64("text_crc32", "size"))
                    .repartitionByRange(*order).sortWithinPartitions(*order)
                    .withColumns({"part": F.spark_partition_id(),
                                  "place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
                    .select("row", "size", "text_crc32", "hilbert", "part", "place"))
    counts = ranked.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumns({"base": F.coalesce(F.sum("n").over(before), F.lit(0)),
                                  "total": F.sum("n").over(Window.partitionBy(F.lit(0)))}).drop("n")
    rank, total = F.col("base") + F.col("place"), F.col("total")
    shard = F.expr(f"(base + place) * {shards} div total")
    return (ranked.join(F.broadcast(offsets), "part")
            .select("row.*", "size", "text_crc32", "hilbert", shard.cast("int").alias("shard"),
                    (rank - F.expr(f"(((base + place) * {shards} div total) * total + {shards - 1}) div {shards}")).alias("slot")))


def write_shards(docs: DataFrame, path: str, shards: int = 8, dimensions=DIMENSIONS, bits: int = 4) -> None:
    """Write whole documents as one folder per shard, in curve order inside it."""
    packed = docs.select(F.struct("*").alias("document"), *dict.fromkeys([*dimensions, "text"]))
    placed = hilbert_shards(packed, shards, dimensions, bits, keep=("document",))
    (placed.select("document.*", F.col("shard").alias("_shard"), F.col("slot").alias("_slot"))
     .repartitionByRange("_shard", "_slot").sortWithinPartitions("_shard", "_slot").drop("_slot")
     .write.mode("overwrite").partitionBy("_shard").parquet(path))
