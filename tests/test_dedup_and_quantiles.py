"""Deduplication, skew-safe joins, exact quantiles and tagging against plain answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobgrain.operators import dedup, scale, tagging
from jobgrain.operators import quantiles as quantile_rounds
from jobgrain.operators.quantiles import quantiles


def test_keep_first(spark):
    df = spark.createDataFrame([("1", 2), ("2", 1), ("1", 1), ("3", 5), ("", 0), (None, 0)], "id string, pos int")
    once = dedup.keep_first(df, "id", ["pos"])
    assert sorted(map(tuple, once.collect())) == [("1", 1), ("2", 1), ("3", 5)]
    assert sorted(dedup.keep_first(once, "id", ["pos"]).collect()) == sorted(once.collect())


def test_keep_first_cuts_before_the_shuffle(spark):
    plan = dedup.keep_first(spark.createDataFrame([("1", 2)], "id string, pos int"), "id", ["pos"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") >= 2


def test_only_new_keeps_repeats_inside_the_batch(spark):
    batch = spark.createDataFrame([("1", 1), ("2", 2), ("2", 3), (None, 4)], "id string, v int")
    seen = spark.createDataFrame([("1",), ("9",), ("1",)], "id string")
    for skewed in (True, False):
        assert sorted(r["v"] for r in dedup.only_new(batch, seen, skewed=skewed).collect()) == [2, 3, 4]


def _skewed(spark, n=6000):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.4 else None if rng.random() < 0.1 else f"k{rng.randrange(500)}", i) for i in range(n)]
    return spark.createDataFrame(rows, "k string, v int").repartition(8)


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_plain_join(spark, how):
    left = _skewed(spark)
    right = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 600, 2)], "k string, x int")
    want = sorted(map(repr, left.join(right, "k", how).collect()))
    assert sorted(map(repr, scale.spread_join(left, right, "k", how).collect())) == want
    assert sorted(map(repr, scale.spread_join(left, right, "k", how, hot={}).collect())) == want


def test_hot_keys_and_their_salts(spark):
    left = _skewed(spark)
    code, missing = left.select(F.xxhash64(F.lit("hot")), F.xxhash64(F.lit(None).cast("string"))).first()
    found = scale.hot_keys(left, "k", share=0.02)
    assert set(found) == {code, missing} and 18 <= found[code] <= 22 and 2 <= found[missing] <= 4
    assert scale.hot_keys(left.where("v < 0"), "k") == {}
    assert scale.hot_keys(left, ["k", "v"]) == {}


def test_spread_join_splits_a_hot_key_of_one_input_split(spark):
    """40 % of the rows have one key and all rows lie in one split: no task of the join gets more than a small part of them."""
    left = _skewed(spark).coalesce(1)
    right = spark.createDataFrame([("hot", 1)], "k string, x int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = scale.spread_join(left, right, "k", "left")
        per_task = [r["count"] for r in joined.where("k = 'hot'").groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        for name in ("adaptive.enabled", "shuffle.partitions", "autoBroadcastJoinThreshold"):
            spark.conf.unset(f"spark.sql.{name}")
        spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert len(per_task) >= 24 and max(per_task) < 0.15 * sum(per_task)


def test_ordered_batches_read_their_input_twice(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    rows = _skewed(spark).withColumn("batch", F.col("v") % 3).withColumn("k", F.udf(count, "string").asNondeterministic()("k"))
    got = dedup.collect_batches(rows, "k", "batch", ["v"])
    assert got.count() > 2_000 and seen.value <= 2.1 * 6_000


def test_collect_batches(spark):
    rows = [("a", 0, 1), ("a", 1, 2), ("b", 1, 3), ("b", 1, 4), ("b", 2, 5), (None, 0, 6)]
    df = spark.createDataFrame(rows, "id string, batch int, v int")
    assert sorted(r["v"] for r in dedup.collect_batches(df, "id", "batch", ["v"]).collect()) == [1, 3, 4, 6]
    within = dedup.collect_batches(df, "id", "batch", ["v"], dedupe_within=True)
    assert sorted(r["v"] for r in within.collect()) == [1, 3]


def test_append_fills_missing_columns(spark):
    out = dedup.append([spark.createDataFrame([(1, "a")], "x int, y string"), spark.createDataFrame([(1,), (1,)], "x int")])
    assert out.count() == 3 and out.where("y is null").count() == 2


@pytest.mark.parametrize("one_sort", [0, 30, 2_000_000])
@pytest.mark.parametrize("shape", ["normal", "few", "single", "two", "outlier", "tail", "extreme"])
def test_quantiles_equal_numpy(spark, one_sort, shape):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(0, 1, 5000), "few": rng.integers(0, 5, 5000).astype(float), "single": np.array([4.0]),
         "two": np.array([1.0, 2.0]), "outlier": np.append(1e6 + rng.normal(0, 1e-4, 4999), 1e18), "tail": rng.lognormal(0, 6, 5000),
         "extreme": np.concatenate([[-1.7e308, 1.7e308, -0.0], rng.normal(0, 1e-300, 3000)])}[shape]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")
    probs = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.7, "e": 1.0}
    row = quantiles(df, "x", probs, one_sort=one_sort).first()
    assert row["n"] == len(x)
    for name, p in probs.items():
        assert row[name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-12)


def test_largest_sorted_slot_under_a_far_outlier(spark, monkeypatch):
    """All values but one lie close together: what is sorted in the end is below 1 % of the rows."""
    rows = spark.range(200_000).select(F.when(F.col("id") == 0, 1e15).otherwise(50_000 + F.rand(1) * 1e-3).alias("x"))
    sizes, one = [], quantile_rounds._picked
    monkeypatch.setattr(quantile_rounds, "_picked", lambda counted, keys: sizes.append(
        max((r["count"] for r in counted.groupBy("_r").count().collect()), default=0)) or one(counted, keys))
    got = quantiles(rows, "x", {"q": 0.25, "m": 0.5}, one_sort=1_000).first()
    want = np.quantile([r["x"] for r in rows.collect()], [0.25, 0.5])
    assert [got["q"], got["m"]] == pytest.approx(list(want), rel=1e-15)
    assert len(sizes) <= 5 and sizes[-1] < 2_000  # sizes[1:-1] are counts of slots, of which there are SLOTS
    assert max(sizes) <= quantile_rounds.SLOTS + 1


def test_quantiles_by_group_and_empty(spark):
    rng = np.random.default_rng(4)
    groups = {g: rng.normal(g, 1 + g, 400 * (g + 1)) for g in range(3)}
    df = spark.createDataFrame([(g, float(v)) for g, xs in groups.items() for v in xs] + [(9, None)], "g int, x double")
    rows = {r["g"]: r for r in quantiles(df, "x", {"m": 0.5, "q": 0.3}, by=["g"]).collect()}
    assert set(rows) == {0, 1, 2}
    for g, xs in groups.items():
        assert rows[g]["m"] == pytest.approx(np.quantile(xs, 0.5)) and rows[g]["q"] == pytest.approx(np.quantile(xs, 0.3))
    empty = quantiles(df.where("g = 9"), "x", {"m": 0.5}).first()
    assert empty["m"] is None and empty["n"] == 0


def test_small_join_has_a_way_for_large_tables(spark):
    left = _skewed(spark)
    right = spark.createDataFrame([(f"k{i}", i) for i in range(600)] + [("hot", 1)], "k string, x int")
    want = sorted(map(repr, left.join(right, "k").collect()))
    for limit in (10, 10_000):
        joined = scale.small_join(left, right, "k", limit=limit)
        assert sorted(map(repr, joined.collect())) == want


def test_quantiles_of_many_groups(spark, monkeypatch):
    df = spark.range(4000).select((F.col("id") % 40).alias("g"), F.col("id").cast("double").alias("x"))
    want = sorted(map(tuple, quantiles(df, "x", {"m": 0.5}, by=["g"]).collect()))
    assert want[0] == (0, 1980.0, 100)
    monkeypatch.setattr("jobgrain.operators.quantiles.BROADCAST_ROWS", 5)
    assert sorted(map(tuple, quantiles(df, "x", {"m": 0.5}, by=["g"]).collect())) == want


def test_anchored_tags_equal_brute_force(spark):
    rng = random.Random(5)
    letters = "abc "
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 60)))) for i in range(80)] + [(99, None)]
    words = sorted({("s%d" % (i % 7), "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))) for i in range(60)})
    docs, lexicon = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(words, "skill string, keyword string")
    want = sorted({(i, s) for i, t in texts if t for s, w in words if w in t.lower()})
    assert sorted(map(tuple, tagging.tag_texts_by_anchor(docs, lexicon, "id", "t").collect())) == want
    assert sorted(map(tuple, tagging.tag_texts(docs, lexicon, "id", "t").collect())) == want


def test_tags_of_a_lexicon_too_large_to_broadcast(spark, monkeypatch):
    """Short, long and very long keywords, other scripts, a keyword of one character, and texts without any."""
    rng = random.Random(11)
    letters = "ab é😀ж"
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 90)))) for i in range(60)] + [(98, None), (99, "")]
    words = {(f"s{i % 9}", "".join(rng.choice(letters) for _ in range(rng.randrange(1, 9)))) for i in range(80)}
    words |= {(f"long {i}", texts[i][1][5:5 + 33 + i]) for i in range(12) if len(texts[i][1]) > 60}
    words |= {("near miss", texts[20][1][:33] + "ab"), ("null", None), ("empty", "")}
    docs, lexicon = spark.createDataFrame(texts, "id int, t string"), spark.createDataFrame(sorted(words, key=repr), "skill string, keyword string")
    want = sorted({(i, s) for i, t in texts if t for s, w in words if w and w in t.lower()})
    monkeypatch.setattr(tagging, "BROADCAST_ROWS", 5)
    found = tagging.tag_texts_by_anchor(docs, lexicon, "id", "t")
    assert sorted(map(tuple, found.collect())) == want and any(s.startswith("long") for _, s in want)
    anchors = spark.range(3_000).select(F.concat(F.lit("a"), F.col("id").cast("string")).alias("_anchor"))
    bits = tagging.anchor_filter(anchors)
    assert len(bits) * 8 >= 16 * 3_000 and 0 < np.unpackbits(bits).mean() < 0.15
    assert tagging.tag_texts_by_anchor(docs, lexicon.where("false"), "id", "t").collect() == []


def test_name_lexicon_and_merge(spark):
    df = spark.createDataFrame([("uses Python", None, ["SQL"])], "requirement string, responsibility string, skills_list array<string>")
    assert tagging.tag_skills(df, tagging.name_lexicon(["Python", "SQL"])).first()["skills_list"] == ["Python", "SQL"]
