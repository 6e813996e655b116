"""New landed files to postings not seen before (the incremental form of D2)."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from jobgrain.operators.dedup import only_new
from jobgrain.schema import POSTING_RAW
from jobgrain.sources.postings import listed_files

BATCH = "batch_id"


def new_postings(spark: SparkSession, landing: str, lateness: str | None = None,
                 schema=POSTING_RAW) -> DataFrame:
    """Stream of first-seen postings from a folder of landed JSON files.

    The seen ids are state. With `lateness` an id is forgotten that long after the
    file that brought it was written, which bounds the state; when a posting was
    published does not matter, so none is dropped for being old. Files must land
    within `lateness` of their modification time. Without it no repeat ever passes and
    the state grows with the ids. A malformed record fails the stream.
    """
    rows = spark.readStream.schema(schema).option("mode", "FAILFAST").json(landing).where(F.col("id").isNotNull() & (F.col("id") != ""))
    if lateness is None:
        return rows.dropDuplicates(["id"])
    timed = rows.select("*", F.col("_metadata.file_modification_time").alias("_arrived")).withWatermark("_arrived", lateness)
    return timed.dropDuplicatesWithinWatermark(["id"]).drop("_arrived")


def ingest_available(stream: DataFrame, output: str, checkpoint: str) -> StreamingQuery:
    """Process what has landed, append it as Parquet, and stop."""
    return (stream.writeStream.format("parquet").option("path", output)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def ingest_new(spark: SparkSession, landing: str, output: str, checkpoint: str, key: str = "id",
               schema=POSTING_RAW, files_per_batch: int | None = None) -> StreamingQuery:
    """Append what has landed and was not published before, as one partition per batch, and stop.

    The meaning is that of `only_new`: a row passes if no earlier batch published its key, repeats inside a batch stay, and
    rows without a key are all kept. The published table is the only memory, so no state grows. A batch that is replayed
    after a failure overwrites its own partition and does not see itself. A malformed record fails the stream.
    """
    stream = spark.readStream.schema(schema).option("mode", "FAILFAST")
    if files_per_batch is not None:
        stream = stream.option("maxFilesPerTrigger", files_per_batch)

    def publish(rows: DataFrame, batch_id: int) -> None:
        here = rows.sparkSession
        new = rows
        if not listed_files(here, output).isEmpty():
            published = here.read.schema(f"`{key}` {rows.schema[key].dataType.simpleString()}, {BATCH} long").parquet(output)
            new = only_new(rows, published.where(F.col(BATCH) < batch_id), key)
        new.write.mode("overwrite").parquet(f"{output}/{BATCH}={batch_id}")

    return (stream.json(landing).writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
