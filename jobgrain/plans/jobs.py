"""Collect, filter, clean, analyse and end-to-end jobs."""

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain import fixed_values as V
from jobgrain.clustering.profile import profiles
from jobgrain.clustering.sweep import Sweep, sweep
from jobgrain.operators import clean, dedup, filters, statistics, tagging
from jobgrain.operators.scale import compile_wide, scratch_path
from jobgrain.schema import PAGE, POSTING_RAW
from jobgrain.sources import postings as io


def collect(pages: DataFrame, batch: str = "batch", page: str = "page", order_by=(),
            roles=V.ANALYST_ROLE_IDS, dedupe_within: bool = False) -> DataFrame:
    """Landed pages of ordered role batches to one table of new postings."""
    rows = io.postings_of_pages(io.until_empty_page(pages, batch, page), roles)
    return dedup.collect_batches(rows, "id", batch, list(order_by) or [batch, page], dedupe_within)


def relevant(raw: DataFrame, order_by: list, include=V.TITLE_INCLUDE, exclude=V.TITLE_EXCLUDE) -> DataFrame:
    """Title filter, then the first posting per id."""
    return dedup.keep_first(filters.by_title(raw, include, exclude), "id", order_by)


def observed(df: DataFrame, stage: str) -> tuple[DataFrame, Observation]:
    """Count rows as they pass, without a second scan."""
    seen = Observation(stage)
    return df.observe(seen, F.count(F.lit(1)).alias("n")), seen


def filter_job(raw: DataFrame, path: str, snapshot: str, order_by: list, write=io.write_postings, **phrases) -> tuple[int, int]:
    """Filter, write the snapshot, and return the counts before and after."""
    before, n_before = observed(raw, "before")
    after, n_after = observed(relevant(before, order_by, **phrases), "after")
    write(after, path, snapshot)
    return n_before.get["n"], n_after.get["n"]


def clean_table(raw: DataFrame, as_of: Column | None = None, remove_outliers: bool = False,
                remove_json: bool = True, tag_text: bool = False, lexicon: dict | None = None,
                vocabulary: list[str] | None = None) -> DataFrame:
    """Raw postings to the clean table; `vocabulary` adds skill indicator columns.

    `remove_json` drops the nested sources and service columns; all other columns of the
    input stay, and `_bad_cells` names the cells that could not be read.
    """
    compile_wide(raw.sparkSession)
    out = clean.flatten(clean.parse_cells(raw), as_of, keep_raw=True)
    if remove_json:
        out = clean.drop_raw(out)
    if tag_text:
        if not lexicon:
            raise ValueError("tagging texts needs a lexicon")
        out = tagging.tag_skills(out, lexicon).withColumn("skills_count", F.size("skills_list"))
    if vocabulary:
        out = clean.skill_indicators(out, vocabulary)
    return filters.without_outliers(out) if remove_outliers else out


def clean_job(raw: DataFrame, path: str, snapshot: str, indicators: bool = True, remove_outliers: bool = False,
              **options) -> DataFrame:
    """Clean, write the snapshot as Parquet, return its statistics.

    The skills that get a column are those of all postings, outliers included. The raw postings are read and parsed once:
    the clean rows are written before the vocabulary and the bounds of outliers are taken from them.
    """
    base = clean_table(raw, **options)
    if indicators or remove_outliers:
        base = staged(base)
    if indicators:
        base = clean.skill_indicators(base, statistics.skill_vocabulary(base))
    io.write_clean(filters.without_outliers(base) if remove_outliers else base, path, snapshot)
    written = base.sparkSession.read.parquet(f"{path}/{io.SNAPSHOT}={snapshot}")
    return statistics.statistics_report(written)


def staged(df: DataFrame) -> DataFrame:
    """`df` written as Parquet to the shared scratch folder and read again: later passes read the columns they need."""
    path = scratch_path(df.sparkSession, "staged")
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@dataclass(frozen=True)
class Analysis:
    sweep: Sweep
    profiles: DataFrame


def analyse(table: DataFrame, selected: list[str], ks=range(2, 13), stem: str = V.REMOTE_STEM,
            families: bool = True, **options) -> Analysis:
    """Newest snapshot to clusters and their profiles."""
    newest = io.latest_snapshot(table) if io.SNAPSHOT in table.columns else table
    frame = clean.analysis_frame(newest) if families else newest.select(*V.ANALYSIS_COLUMNS)
    found = sweep(frame, selected, ks, **options)
    f = found.features
    return Analysis(found, profiles(found.label(frame), found.best.k, f.numeric, f.categorical, stem))


def analyse_newest(spark: SparkSession, path: str, selected: list[str], ks=range(2, 13), **options) -> Analysis:
    """The newest clean snapshot below `path`, found in the file listing, to clusters and their profiles."""
    return analyse(io.read_newest_snapshot(spark, path).drop(io.SNAPSHOT), selected, ks, **options)


def run_all(spark: SparkSession, pages_path: str, output: str, snapshot: str, as_of: Column,
            include=V.TITLE_INCLUDE, exclude=V.TITLE_EXCLUDE, roles=V.ANALYST_ROLE_IDS, malformed: str = "fail",
            **options) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Collect, filter and clean landed pages; returns (metrics, sample, statistics).

    `pages_path` holds JSON Lines of {batch, page, items}; the steps hand Parquet on, so JSON is parsed once. A failing step
    fails the run, and so does a malformed page, unless `malformed` is "keep" or "drop"; kept ones are counted in the
    metrics, as are the cells that could not be read.
    """
    started = time.monotonic()
    pages = io.read_postings(spark, pages_path, _with_origin(PAGE), malformed=malformed)
    corrupt = None
    if malformed == "keep":
        pages, corrupt = _corrupt_counted(pages)
    raw_path, kept_path, clean_path = f"{output}/raw", f"{output}/relevant", f"{output}/clean"
    io.write_clean(collect(staged(pages), roles=roles), raw_path, snapshot)
    raw = spark.read.parquet(f"{raw_path}/{io.SNAPSHOT}={snapshot}")
    order = ["batch", "page", "published_at"]
    before, after = filter_job(raw, kept_path, snapshot, order, write=io.write_clean, include=include, exclude=exclude)
    kept = spark.read.parquet(f"{kept_path}/{io.SNAPSHOT}={snapshot}")
    stats = clean_job(kept, clean_path, snapshot, as_of=as_of, **options)
    written = spark.read.parquet(f"{clean_path}/{io.SNAPSHOT}={snapshot}")
    bad = written.agg(F.sum(F.size(clean.BAD_CELLS))).first()[0] if clean.BAD_CELLS in written.columns else 0
    metrics, sample = io.run_report(before, kept, after, time.monotonic() - started, ["published_at", "id"],
                                    corrupt=corrupt.get["n"] if corrupt else 0, bad_cells=bad or 0)
    return metrics, sample, stats


def _corrupt_counted(pages: DataFrame) -> tuple[DataFrame, Observation]:
    """Readable pages; the corrupt ones are counted as they pass."""
    seen = Observation("corrupt")
    return pages.observe(seen, F.count(io.CORRUPT).alias("n")).where(F.col(io.CORRUPT).isNull()).drop(io.CORRUPT), seen


def _with_origin(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField("batch", T.IntegerType()), T.StructField("page", T.IntegerType()),
                         *schema.fields])
