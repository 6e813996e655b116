"""What used to be lost without a word: malformed input, unreadable cells, late postings, empty keywords, reruns."""

import json
import os

import pytest
from pyspark.sql import functions as F

from jobgrain.operators import tagging
from jobgrain.plans import jobs
from jobgrain.schema import POSTING_CORE
from jobgrain.sources import postings as io
from jobgrain.streaming.ingest import ingest_available, new_postings


def test_malformed_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1"}\n{"id": "2"\n{"id": "3"}\n')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_postings(spark, str(tmp_path)).collect()
    kept = io.read_postings(spark, str(tmp_path), malformed="keep").collect()
    assert sorted((r["id"] or "", r[io.CORRUPT] or "") for r in kept) == [("", '{"id": "2"'), ("1", ""), ("3", "")]
    assert [r["text"] for r in io.corrupt_records(spark, str(tmp_path)).collect()] == ['{"id": "2"']
    assert sorted(r["id"] for r in io.read_postings(spark, str(tmp_path), malformed="drop").collect()) == ["1", "3"]


def test_truncated_array_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": "1"}, {"id": "2"')
    with pytest.raises(Exception, match="(?i)malformed"):
        io.read_postings(spark, str(tmp_path), whole_array=True).collect()
    assert io.corrupt_records(spark, str(tmp_path), whole_array=True).count() == 1


def test_both_tagging_ways_agree(spark):
    texts = spark.createDataFrame([(1, "Spark and sql"), (1, "SQL again"), (2, "nothing"), (3, ""), (4, None)], "key int, text string")
    lexicon = spark.createDataFrame([("S", "sql"), ("S", "sql"), ("P", "spark"), ("E", ""), ("N", None), ("L", "sql again and again")],
                                    "skill string, keyword string")
    small = sorted(tuple(r) for r in tagging.tag_texts(texts, lexicon, "key", "text").collect())
    large = sorted(tuple(r) for r in tagging.tag_texts_by_anchor(texts, lexicon, "key", "text").collect())
    assert small == large == [(1, "P"), (1, "S")]
    assert tagging.tag_texts_by_anchor(texts, lexicon.where("false"), "key", "text").count() == 0


def test_lexicon_is_needed_and_read(spark, tmp_path):
    raw = spark.createDataFrame([], POSTING_CORE)
    with pytest.raises(ValueError, match="lexicon"):
        jobs.clean_table(raw, tag_text=True)
    (tmp_path / "lex.json").write_text('{"skill": "S", "keyword": "sql"}\n{"skill": "E", "keyword": ""}\n')
    assert [tuple(r) for r in tagging.read_lexicon(spark, str(tmp_path)).collect()] == [("S", "sql")]


def test_late_posting_is_kept(spark, tmp_path):
    landing, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    os.mkdir(landing)
    for i, (key, day) in enumerate([("1", "2026-01-20"), ("2", "2020-01-01"), ("1", "2026-01-20")]):
        with open(f"{landing}/{i}.json", "w") as f:
            f.write(json.dumps({"id": key, "published_at": f"{day}T00:00:00+0300"}))
        ingest_available(new_postings(spark, landing, lateness="1 day"), out, state).awaitTermination()
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["1", "2"]


def test_rerun_replaces_and_newest_is_listed(spark, tmp_path):
    path = str(tmp_path / "clean")
    df = spark.range(5).withColumn("x", F.lit("a"))
    for snapshot, n in (("s1", 5), ("s1", 3), ("s0", 4)):
        io.write_clean(df.limit(n), path, snapshot)
    assert spark.read.parquet(path).count() == 7
    newest = io.read_newest_snapshot(spark, path)
    assert newest.count() == 3 and newest.select(io.SNAPSHOT).distinct().first()[0] == "s1"
    missing = str(tmp_path / "none")
    assert io.latest_file(spark, missing).count() == 0 and io.read_newest_snapshot(spark, missing).count() == 0
