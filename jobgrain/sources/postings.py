"""Landed JSON, result snapshots and the run report."""

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.fixed_values import ANALYST_ROLE_IDS, ROLE_NAME_STEM
from jobgrain.operators.clean import parse_cells
from jobgrain.operators.filters import by_name_stem, by_role
from jobgrain.operators.scale import small_join
from jobgrain.schema import PAGE, POSTING_RAW, ROLE_CATALOGUE
from jobgrain.sources.arrays import read_array

SNAPSHOT = "snapshot_ts"
CORRUPT = "_corrupt_record"
# What read_postings does with text that is not JSON of the schema.
JSON_MODES = {"fail": "FAILFAST", "keep": "PERMISSIVE", "drop": "DROPMALFORMED"}


def read_postings(spark: SparkSession, path: str, schema: T.StructType = POSTING_RAW,
                  whole_array: bool | str = False, malformed: str = "fail") -> DataFrame:
    """Postings from JSON Lines (each line a record or an array of records).

    `whole_array` reads files that are one array each: True in one task a file, "split" in as many as a large
    file has splits (see `arrays`), where malformed text always fails. Else `malformed` text fails the read,
    or is kept as a row with nothing but its text in `_corrupt_record`, or dropped.
    """
    if whole_array == "split":
        return read_array(spark, path, schema)
    if malformed == "keep":
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(schema).option("multiLine", whole_array).option("mode", JSON_MODES[malformed])
            .option("columnNameOfCorruptRecord", CORRUPT).json(path))


def corrupt_records(spark: SparkSession, path: str, whole_array: bool = False) -> DataFrame:
    """(file, text, id) of the records of landed files that are not JSON; `id` if it could be read before the fault."""
    rows = read_postings(spark, path, whole_array=whole_array, malformed="keep")
    # Spark refuses a scan of the corrupt column alone, which count() would make; the second test always holds.
    broken = F.col(CORRUPT).isNotNull() & (F.length(F.coalesce("id", F.lit(""))) >= 0)
    return rows.where(broken).select(F.col("_metadata.file_path").alias("file"), F.col(CORRUPT).alias("text"), "id")


def read_postings_as_text(spark: SparkSession, path: str, schema: T.StructType = POSTING_RAW) -> DataFrame:
    """The same for records whose nested values may be stringified."""
    loose = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return parse_cells(spark.read.schema(loose).json(path), schema)


def write_postings(df: DataFrame, path: str, snapshot: str) -> None:
    """Write one snapshot as JSON Lines; the snapshot id is the partition. A second run replaces it."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/{SNAPSHOT}={snapshot}")


def write_clean(df: DataFrame, path: str, snapshot: str) -> None:
    """Write one snapshot of the clean table as Parquet. A second run replaces it."""
    df.write.mode("overwrite").parquet(f"{path}/{SNAPSHOT}={snapshot}")


def export_csv(df: DataFrame, path: str) -> None:
    """CSV export, replacing an earlier one; lists and structs go out as JSON text."""
    flat = [F.to_json(F.col(f"`{f.name}`")).alias(f.name)
            if isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields]
    df.select(*flat).write.mode("overwrite").option("header", True).csv(path)


def latest_snapshot(df: DataFrame, column: str = SNAPSHOT) -> DataFrame:
    """Rows of the newest snapshot.

    The maximum comes from a scalar subquery over the partition column, so the
    scan prunes all other partitions at run time.
    """
    return df.where(F.col(column) == df.agg(F.max(column).alias("newest")).scalar())


def listed_files(spark: SparkSession, path: str, pattern: str = "*.parquet") -> DataFrame:
    """(path, modificationTime) of the files below a folder; only the listing is read, no content. Empty if there is no folder."""
    try:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "path string, modificationTime timestamp")
    return files.select("path", "modificationTime")


def latest_file(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the most recently modified Parquet file, the last path on a tie; no columns and no rows without a file."""
    newest = listed_files(spark, path).agg(F.max(F.struct("modificationTime", "path")).alias("m")).first()["m"]
    return spark.createDataFrame([], T.StructType()) if newest is None else spark.read.parquet(newest["path"])


def read_newest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the newest Parquet snapshot below `path`, found by the names of the partitions; empty without one."""
    name = F.regexp_extract("path", rf"/{SNAPSHOT}=([^/]+)/", 1)
    newest = listed_files(spark, path).select(F.max(F.when(name != "", name)).alias("n")).first()["n"]
    if newest is None:
        return spark.createDataFrame([], T.StructType())
    return spark.read.option("basePath", path).parquet(f"{path}/{SNAPSHOT}={newest}")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAGE).json(path)


def postings_of_pages(pages: DataFrame, roles=ANALYST_ROLE_IDS, items: str = "items",
                      role_column: str = "professional_roles") -> DataFrame:
    """One row per kept posting; absent and empty pages give none."""
    keep = [c for c in pages.columns if c != items]
    rows = pages.select(*keep, F.explode(items).alias("_item")).select(*keep, "_item.*")
    return by_role(rows, roles, role_column) if roles else rows


def until_empty_page(pages: DataFrame, batch: str, page: str, items: str = "items") -> DataFrame:
    """Pages of each batch before its first empty one."""
    empty = F.col(items).isNull() | (F.size(items) == 0)
    stops = pages.where(empty).groupBy(batch).agg(F.min(page).alias("_stop"))
    return (small_join(pages.where(~empty), stops, batch, "left")
            .where(F.col("_stop").isNull() | (F.col(page) < F.col("_stop"))).drop("_stop"))


def read_catalogue(spark: SparkSession, path: str, whole_document: bool = True) -> DataFrame:
    """One catalogue per file, or per line if not `whole_document`."""
    return spark.read.schema(ROLE_CATALOGUE).option("multiLine", whole_document).json(path)


def catalogue_roles(catalogue: DataFrame, stem: str = ROLE_NAME_STEM) -> DataFrame:
    """(id, name) of the catalogue's roles whose name contains the stem."""
    roles = (catalogue.select(F.explode("categories").alias("_c"))
             .select(F.explode("_c.roles").alias("_r")).select("_r.id", "_r.name"))
    return by_name_stem(roles, stem)


def sample_text(name: Column, salary: Column) -> Column:
    """`title (from-to)`, with `none` where no salary is given."""
    def part(c):
        return F.coalesce(c.cast("bigint").cast("string"), F.lit("None"))
    band = F.when(salary.isNull(), F.lit("none")).otherwise(
        F.concat(part(salary["from"]), F.lit("-"), part(salary["to"])))
    return F.concat(F.coalesce(name, F.lit("untitled")), F.lit(" ("), band, F.lit(")"))


def run_report(raw_count: int, kept: DataFrame, kept_count: int, seconds: float,
               order_by: list, sample: int = 10, corrupt: int = 0, bad_cells: int = 0) -> tuple[DataFrame, DataFrame]:
    """(one-row metrics, first postings as numbered sample); records and cells that could not be read are counted too."""
    spark = kept.sparkSession
    metrics = spark.createDataFrame([(raw_count, kept_count, float(seconds), corrupt, bad_cells)],
                                    "raw_count bigint, kept_count bigint, seconds double, corrupt_records bigint, bad_cells bigint")
    return metrics, report_sample(kept, order_by, sample)


def report_sample(kept: DataFrame, order_by: list, sample: int = 10) -> DataFrame:
    return (kept.orderBy(*order_by).limit(sample)
            .select("id", sample_text(F.col("name"), F.col("salary")).alias("line")))
