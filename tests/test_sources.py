"""Readers, snapshots, jobs and the incremental stream."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from jobgrain.plans import jobs
from jobgrain.schema import POSTING_RAW
from jobgrain.sources import postings as io
from jobgrain.streaming.ingest import ingest_available, ingest_new, new_postings


def test_pretty_array_with_service_columns(spark, tmp_path):
    rows = [{"id": 7, "name": "x", "salary": {"from": 1, "to": None, "currency": "RUR"}, "archived": False,
             "contacts": {"any": ["shape"]}, "key_skills": [{"name": "SQL"}]}, {"id": "8"}]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2, ensure_ascii=False))
    df = io.read_postings(spark, str(tmp_path), whole_array=True)
    assert df.schema == POSTING_RAW
    assert sorted(r["id"] for r in df.collect()) == ["7", "8"]
    clean = jobs.clean_table(df)
    assert "archived" not in clean.columns and "salary" not in clean.columns
    assert {r["id"]: r["skills_list"] for r in clean.collect()} == {"7": ["SQL"], "8": []}
    kept = jobs.clean_table(df, remove_json=False)
    assert "salary" in kept.columns and "archived" in kept.columns


def test_pages_keep_listed_roles_and_skip_empty(spark):
    df = spark.read.schema("batch int, page int, items array<struct<id: string, professional_roles: array<struct<id: string>>>>").json(
        spark.sparkContext.parallelize([
            '{"batch": 0, "page": 0, "items": [{"id": "1", "professional_roles": [{"id": "156"}]}, {"id": "2", "professional_roles": [{"id": "1"}]}]}',
            '{"batch": 0, "page": 1, "items": []}', '{"batch": 0, "page": 2, "items": [{"id": "3", "professional_roles": [{"id": "10"}]}]}',
            '{"batch": 1, "page": 0}']))
    assert sorted(r["id"] for r in io.postings_of_pages(df).collect()) == ["1", "3"]
    assert [r["id"] for r in io.postings_of_pages(io.until_empty_page(df, "batch", "page")).collect()] == ["1"]


def test_latest_snapshot_prunes_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    for snapshot in ("20260101", "20260103", "20260102"):
        io.write_clean(spark.range(3).withColumn("s", F.lit(snapshot)), path, snapshot)
    newest = io.latest_snapshot(spark.read.parquet(path))
    assert {r["s"] for r in newest.collect()} == {"20260103"}
    assert "PartitionFilters: [isnotnull(snapshot_ts" in newest._jdf.queryExecution().executedPlan().toString()


def test_latest_file(spark, tmp_path):
    for i, name in enumerate(["b", "a"]):
        spark.range(1).coalesce(1).select(F.lit(name).alias("n")).write.mode("append").parquet(str(tmp_path / "t"))
        files = sorted(p for p in os.listdir(tmp_path / "t") if p.endswith(".parquet"))
        time.sleep(1.1)
    assert len(files) == 2
    assert [r["n"] for r in io.latest_file(spark, str(tmp_path / "t")).collect()] == ["a"]


def test_catalogue(spark, tmp_path):
    doc = {"categories": [{"id": "1", "name": "IT", "roles": [{"id": "10", "name": "Аналитик"}, {"id": "96", "name": "Программист"}]},
                          {"id": "2", "name": "none", "roles": []}]}
    (tmp_path / "c.json").write_text(json.dumps(doc, indent=1))
    assert [tuple(r) for r in io.catalogue_roles(io.read_catalogue(spark, str(tmp_path))).collect()] == [("10", "Аналитик")]


def test_report_lines(spark):
    df = spark.createDataFrame([("1", "a", (100000.0, None)), ("2", "b", None), ("3", None, (1.0, 2.0))],
                               "id string, name string, salary struct<`from`: double, `to`: double>")
    metrics, sample = io.run_report(5, df, 3, 1.5, ["id"])
    assert metrics.first().asDict() == {"raw_count": 5, "kept_count": 3, "seconds": 1.5, "corrupt_records": 0, "bad_cells": 0}
    assert [r["line"] for r in sample.orderBy("id").collect()] == ["a (100000-None)", "b (none)", "untitled (1-2)"]


def test_filter_job_counts(spark, tmp_path):
    df = spark.createDataFrame([("1", "Data analyst", 1), ("1", "Data analyst", 2), ("2", "Повар", 3)], "id string, name string, pos int")
    assert jobs.filter_job(df, str(tmp_path / "o"), "s1", ["pos"]) == (3, 1)
    assert spark.read.json(str(tmp_path / "o")).count() == 1


def test_stream_passes_each_id_once(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(landing)
    with open(f"{landing}/1.json", "w") as f:
        json.dump([{"id": "1"}, {"id": "2"}, {"id": "1"}], f)
    ingest_available(new_postings(spark, landing), out, state).awaitTermination()
    with open(f"{landing}/2.json", "w") as f:
        json.dump([{"id": "2"}, {"id": "3"}], f)
    ingest_available(new_postings(spark, landing), out, state).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["1", "2", "3"]


def test_stream_with_bounded_state(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(landing)
    with open(f"{landing}/1.json", "w") as f:
        json.dump([{"id": "1", "published_at": "2026-01-28T10:00:00+0300"}, {"id": "1", "published_at": "2026-01-28T11:00:00+0300"}], f)
    ingest_available(new_postings(spark, landing, lateness="7 days"), out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 1


def _publish(spark, tmp_path, files, **options):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.makedirs(landing, exist_ok=True)
    for name, ids in files.items():
        with open(f"{landing}/{name}", "w") as f:
            json.dump([{"id": i, "name": name} for i in ids], f)
    ingest_new(spark, landing, out, state, **options).awaitTermination()
    return sorted((r["id"] or "", r["name"], r["batch_id"]) for r in spark.read.parquet(out).collect())


def test_batches_keep_their_repeats_and_replays_overwrite(spark, tmp_path):
    first = _publish(spark, tmp_path, {"1.json": ["a", "b", "b", None]})
    assert first == [("", "1.json", 0), ("a", "1.json", 0), ("b", "1.json", 0), ("b", "1.json", 0)]
    second = _publish(spark, tmp_path, {"2.json": ["b", "c", "c", None]})
    assert second == sorted([*first, ("", "2.json", 1), ("c", "2.json", 1), ("c", "2.json", 1)])
    # The batch was published, but its commit was lost: it is made again and replaces itself.
    for name in os.listdir(tmp_path / "state" / "commits"):
        if name.strip(".").startswith("1"):
            os.remove(tmp_path / "state" / "commits" / name)
    assert _publish(spark, tmp_path, {}) == second
    assert _publish(spark, tmp_path, {"3.json": ["a", "d"]})[-1] == ("d", "3.json", 2)


def test_one_file_a_batch(spark, tmp_path):
    rows = _publish(spark, tmp_path, {f"{i}.json": ["x", f"own {i}"] for i in range(3)}, files_per_batch=1)
    assert [r[0] for r in rows] == ["own 0", "own 1", "own 2", "x"] and {r[2] for r in rows} == {0, 1, 2}


def test_run_reports_what_could_not_be_read(spark, tmp_path):
    def posting(i, **more):
        return {"id": str(i), "name": "data analyst", "published_at": "2026-01-28T10:00:00+0300", "professional_roles": [{"id": "156"}], **more}
    pages = tmp_path / "pages"
    pages.mkdir()
    lines = [json.dumps({"batch": 0, "page": p, "items": [posting(2 * p), posting(2 * p + 1)]}) for p in range(3)]
    (pages / "p.json").write_text("\n".join([*lines, '{"batch": 1, "page": 0, "items": [{"id": "9"']))
    include = ["analyst"]
    with pytest.raises(Exception):
        jobs.run_all(spark, str(pages), str(tmp_path / "o1"), "s", F.lit("2026-02-01").cast("timestamp"), include, [])
    metrics, sample, stats = jobs.run_all(spark, str(pages), str(tmp_path / "o2"), "s", F.lit("2026-02-01").cast("timestamp"), include, [], malformed="keep")
    row = metrics.first()
    assert (row["raw_count"], row["kept_count"], row["corrupt_records"], row["bad_cells"]) == (6, 6, 1, 0)
    assert sample.count() == 6 and not stats.isEmpty()
