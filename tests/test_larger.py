"""What keeps queries in bounds on larger tables: cells parsed once, flat rows shuffled, files strung together."""

import datetime
import glob
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.operators import clean, scale
from jobgrain.schema import POSTING_CORE
from workload import files, tables

ROWS = 90


@pytest.fixture()
def small(spark, tmp_path):
    """Orders, customers and nations of a few rows, with a null in every column of orders but the keys."""
    at = datetime.datetime(2001, 1, 2, 3, 4, 5)
    orders = [(k, k % 7, None if k % 10 == 0 else "OFP"[k % 3], None if k % 11 == 0 else k * 10.5, None if k % 12 == 0 else at,
               None if k % 13 == 0 else f"{k % 5 + 1}-LEVEL") for k in range(ROWS)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp,"
                          " o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(c, f"C{c}", c % 2, 1.0 * c, "SEG") for c in range(7)], "c_custkey long, c_name string, c_nationkey int,"
                          " c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame([(0, "N_0", 0), (1, "N_1", 0)], "n_nationkey int, n_name string, n_regionkey int").write.parquet(f"{tmp_path}/nation.parquet")
    return str(tmp_path)


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_cell_is_parsed_and_stripped_once(spark):
    schema = T.StructType([T.StructField("salary", T.StructType([T.StructField("from", T.DoubleType())]))])
    cells = [(" {'from': None} ",), ("{'from': 2.5}",), ("{'from': ",), ("{'from': 1,}",), ("plain",), ("  ",), (None,)]
    out = clean.parse_cells(spark.createDataFrame(cells, "salary string"), schema)
    assert _plan(out).count("from_json") == 1
    assert _plan(out).count("regexp_replace") < 12  # 100 and more when each word's test named the text again
    found = [(r["salary"] and r["salary"]["from"], r["salary"] is None, r[clean.BAD_CELLS]) for r in out.collect()]
    assert found[:3] == [(None, False, []), (2.5, False, []), (None, True, ["salary"])]
    assert found[4:] == [(None, True, ["salary"]), (None, True, []), (None, True, [])]


def test_postings_made_in_their_pages_are_the_raw_ones(spark, small):
    raw = tables.raw_postings(spark, small).select(files.FIELDS)
    paged = (tables.keyed_rows(spark, small).groupBy().agg(F.collect_list(F.struct(*tables.KEYED)).alias("items"))
             .select(F.explode(tables.postings_of("items")).alias("p")).select("p.*"))
    assert [(f.name, f.dataType.simpleString()) for f in paged.schema] == [(f.name, f.dataType.simpleString()) for f in POSTING_CORE]
    assert raw.count() == ROWS and sorted(map(repr, raw.collect())) == sorted(map(repr, paged.collect()))


def test_pages_shuffle_flat_rows(spark, small):
    pages = files._landed_pages(spark, small)
    plan = pages._jdf.queryExecution().executedPlan().toString()
    grouped = [line for line in plan.splitlines() if "partial_collect_list" in line]
    assert grouped and not any("salary" in line for line in grouped)
    landed = pages.select("batch", "page", F.explode("items.id").alias("id")).collect()
    assert sorted(map(tuple, landed)) == sorted((k % 3 + late, k // 100, str(k)) for k in range(ROWS) for late in range(1 + (k % 5 == 0)))


def test_one_array_file_of_repeated_records_is_written_unsorted(spark, tmp_path):
    lines = spark.range(1000, numPartitions=5).select(F.to_json(F.struct((F.col("id") % 10).alias("id"))).alias("line"))
    files._write_one_array(lines, f"{tmp_path}/one")
    written, = glob.glob(f"{tmp_path}/one/part-*")
    assert sorted(r["id"] for r in json.load(open(written))) == sorted(list(range(10)) * 100)


def test_landings_are_compressed(spark, small, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "scratch_path", lambda _, name: f"{tmp_path}/scratch/{name}")
    assert sorted(int(r["id"]) for r in files.incremental(spark, small).collect()) == list(range(ROWS))
    landed = glob.glob(f"{tmp_path}/scratch/landing/part-*")
    assert landed and all(f.endswith(".json.gz") for f in landed)


def test_wide_projections_run_by_split_code_unless_the_session_says_otherwise(spark):
    before = spark.conf.get(scale.HUGE_METHOD)
    try:
        for given, then in ((scale.HUGE_METHOD_DEFAULT, "8000"), ("30000", "30000")):
            spark.conf.set(scale.HUGE_METHOD, given)
            scale.compile_wide(spark)
            assert spark.conf.get(scale.HUGE_METHOD) == then
    finally:
        spark.conf.set(scale.HUGE_METHOD, before)
