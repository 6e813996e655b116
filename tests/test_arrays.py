"""Array files read in splits against Spark's own reader of whole files."""

import json
import random

import pytest

from jobgrain.schema import POSTING_RAW
from jobgrain.sources import postings as io
from jobgrain.sources.arrays import array_records, read_array

SCHEMA = "id string, name string, tags array<string>, nested struct<a: struct<b: string>, l: array<struct<x: long>>>"


def record(rng, i):
    odd = ['}', '{', '"', '\\', '[', ']', ',', '},{', '\\"}', ' ', 'é', '😀', '\n', '", "id": "9', '\\\\']
    text = "".join(rng.choice(odd) for _ in range(rng.randrange(12)))
    return {"id": str(i), "name": text, "tags": [text[::-1], "}"] if i % 3 else [], "nested": {"a": {"b": text} if i % 2 else None, "l": [{"x": i}, {"x": None}]}}


@pytest.mark.parametrize("indent", [None, 2])
@pytest.mark.parametrize("split_bytes", [64, 700, 1 << 20])
def test_splits_give_the_records_of_the_whole(spark, tmp_path, indent, split_bytes):
    rng = random.Random(split_bytes)
    for f in range(2):
        (tmp_path / f"{f}.json").write_text(json.dumps([record(rng, 100 * f + i) for i in range(60)], indent=indent, ensure_ascii=bool(f)), encoding="utf-8")
    (tmp_path / "empty.json").write_text(" [ ]\n")
    (tmp_path / "one.json").write_text('[{}]')
    want = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = read_array(spark, str(tmp_path), want.schema)
        tasks = io.read_postings(spark, str(tmp_path), whole_array="split").rdd.getNumPartitions()
        rows = sorted(map(repr, got.collect()))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert rows == sorted(map(repr, want.collect())) and len(rows) == 121
    assert tasks > 20 or split_bytes > 700


@pytest.mark.parametrize("text", ['[{"id": "1"}, {"id": "2"', '[{"id": "1"}, 5]', '[{"id": "1"}, {"id": "2}]', '{"id": "1"}', '[{"id": "1"}] x'])
def test_what_is_not_an_array_of_objects_raises(spark, tmp_path, text):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception):
        array_records(spark, str(tmp_path)).collect()


def test_postings_from_split_arrays(spark, tmp_path):
    rows = [{"id": str(i), "name": "x", "salary": {"from": i, "to": None, "currency": "RUR"}, "key_skills": [{"name": "SQL"}]} for i in range(30)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=2))
    got, want = (io.read_postings(spark, str(tmp_path), whole_array=w) for w in ("split", True))
    assert got.schema == want.schema == POSTING_RAW and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
