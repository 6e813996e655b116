"""Fits and scores of many k at once against one at a time, brute force and their properties."""

import pickle
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from jobgrain.clustering import fused, kmeans, methods, pairwise, prototypes, quadtree, scoring
from jobgrain.clustering import sweep as sw
from jobgrain.clustering.features import CLUSTER, FeatureSet, assign, measure, split_types
from tests.test_clustering import brute_silhouette

SCHEMA = "salary_avg double, min_experience_years double, schedule_name string, area_name string"


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    n = 500
    pay = np.concatenate([rng.normal(100, 10, n // 2), rng.lognormal(5, 1, n // 2 - 60), np.full(60, 77.0)])
    rows = [(float(p), float(rng.choice([0, 1, 3, 6])), str(rng.choice(list("abcd"))), str(rng.choice(["it's", 'q"q', "ü", "x\\y", "z"]))) for p in pay]
    return spark.createDataFrame([*rows, (None, 1.0, "a", "z"), (5.0, 1.0, None, "z")], SCHEMA)


def data_of(frame, *columns):
    return methods.Data.of(frame, measure(frame, split_types(list(columns))))


@pytest.mark.parametrize("columns", [("schedule_name", "area_name"), ("salary_avg", "schedule_name"),
                                     ("salary_avg", "min_experience_years", "schedule_name")])
@pytest.mark.parametrize("few", [0, fused.FEW_VALUES])
def test_fused_fits_equal_single_fits(frame, columns, few, monkeypatch):
    monkeypatch.setattr(fused, "FEW_VALUES", few)
    data = data_of(frame, *columns)
    dense = prototypes.with_density(data.tuples, data.features)
    seeds = prototypes.cao_seeds(dense, data.features, 5, data.gamma)
    assert fused.cao_seeds(dense, data.features, 5, data.gamma) == seeds
    together = fused.fit(data.tuples, data.features, {(k, 0): seeds[:k] for k in (2, 3, 5)}, data.gamma, 9)
    for k in (2, 5):
        centroids, cost, history = prototypes.fit(data.tuples, data.features, seeds[:k], data.gamma, 9)
        mine = together[k, 0]
        assert mine.cost == pytest.approx(cost, rel=1e-9) and mine.history == pytest.approx(history, rel=1e-9)
        for a, b in zip(mine.centroids, centroids if mine.converged else []):
            assert all(a[c] == pytest.approx(b[c], abs=1e-9) for c in data.features.numeric)
            assert all(a[c] == b[c] for c in data.features.categorical)


def test_passes_are_those_of_the_longest_fit(frame, monkeypatch):
    passes, one = [], fused._pass
    monkeypatch.setattr(fused, "_pass", lambda *a: passes.append(len(a[2])) or one(*a))
    data = data_of(frame, "salary_avg", "schedule_name")
    method, runs = methods.KPrototypes(max_iter=20), [(k, r) for k in range(2, 6) for r in range(2)]
    fits = method.fit(data, runs)
    iterations = [f.iterations for f in fits.values()]
    assert len(passes) == max(iterations) < sum(iterations) and sum(passes) == sum(iterations)
    assert all(b <= a * (1 + 1e-12) for f in fits.values() for a, b in zip(f.history, f.history[1:]))
    assert all(fits[k, 0].cost != fits[k, 1].cost for k in (4, 5))  # restarts are real
    assert fits == method.fit(data, runs)


def test_kmeans_ends_at_a_fixed_point(frame):
    data = data_of(frame, "salary_avg", "min_experience_years")
    fits = methods.KMeans(tolerance=0.0).fit(data, [(k, r) for k in (2, 4) for r in range(3)])
    rows = data.tuples.toPandas()
    x, w = rows[data.features.numeric].to_numpy(), rows["w"].to_numpy()
    for (k, _), fit in fits.items():
        centres = np.array([[c[f] for f in data.features.numeric] for c in fit.centroids])
        gaps = ((x[:, None, :] - centres) ** 2).sum(2)
        label = gaps.argmin(1)
        assert fit.converged and fit.cost == pytest.approx((w * gaps.min(1)).sum(), rel=1e-9)
        for i in range(k):
            assert np.allclose(np.average(x[label == i], axis=0, weights=w[label == i]), centres[i], atol=1e-6)
    assert len({f.cost for run, f in fits.items() if run[0] == 4}) > 1


def test_kmeans_finds_planted_groups_however_rows_are_dealt(spark):
    rng = np.random.default_rng(3)
    middles = [(0, 0), (50, 3), (0, 40), (60, 60), (-40, 20)]
    rows = [(a + float(rng.normal()), b + float(rng.normal())) for a, b in middles for _ in range(40)]
    costs = set()
    for parts in (1, 7):  # how rows are dealt must not matter
        df = spark.createDataFrame(rows, "salary_avg double, min_experience_years double").repartition(parts)
        found = sw.sweep(df, ["salary_avg", "min_experience_years"], range(2, 7), final_restarts=3)
        assert found.best.k == 5 and found.best.method_name == "K-Means"
        costs.add(round(found.best.cost, 9))
        runs = {r["k"]: r for r in found.runs.collect()}
        assert all(runs[k]["cost"] > runs[k + 1]["cost"] for k in range(2, 5))
    assert len(costs) == 1


def test_seeds_are_distinct_and_prefixes(frame):
    data = data_of(frame, "salary_avg")
    seeds = fused.spread_seeds(data.tuples, data.features, 6, [0, 4])
    assert all(len({s["salary_avg"] for s in chosen}) == 6 for chosen in seeds) and seeds[0] != seeds[1]
    assert fused.spread_seeds(data.tuples, data.features, 3, [4]) == [seeds[1][:3]]


def distances(rows, features, ranges):
    out = sum(np.abs(rows[c].to_numpy()[:, None] - rows[c].to_numpy()) / r for c, r in ranges.items())
    return out + sum((rows[c].to_numpy()[:, None] != rows[c].to_numpy()).astype(float) for c in features.categorical)


@pytest.mark.parametrize("columns", [("salary_avg",), ("schedule_name", "area_name"), ("salary_avg", "area_name"),
                                     ("salary_avg", "min_experience_years", "schedule_name"), ("salary_avg", "min_experience_years")])
@pytest.mark.parametrize("small", [False, True])
def test_scores_of_many_labellings(frame, columns, small, monkeypatch):
    """Random labels of several k at once, with an empty cluster and one that cannot be scored."""
    if small:  # many ranges, leaves and blocks, joins without broadcast
        monkeypatch.setattr(scoring, "RANGE_ROWS", 20)
        monkeypatch.setattr(scoring, "BROADCAST_ROWS", 1)
        monkeypatch.setattr(quadtree, "BLOCK_LEAVES", 2)
        monkeypatch.setattr(quadtree.plane_sums, "__defaults__", (16,))
    data, f = data_of(frame, *columns), None
    f = data.features
    key = F.xxhash64(*f.columns)

    def random_labels(salt, k):
        labels = data.tuples.select(*f.columns, F.pmod(key + salt, F.lit(k)).cast("int").alias(CLUSTER))
        return methods.Fit("given", k + (salt == 1), [], 0.0, 0.0, labels=labels)

    fits = [random_labels(0, 3), random_labels(1, 2), random_labels(5, 1), random_labels(9, 7)]
    scores = data.scores(fits, "euclidean" if not f.categorical else "gower")
    assert scores[2] == (None, "fewer than two clusters")
    rows = data.labelled(fits).toPandas()
    rows = rows.loc[rows.index.repeat(rows["w"])].reset_index(drop=True)
    if f.categorical or len(f.numeric) == 1:
        gaps = distances(rows, f, {c: f.moments[c].z_range if f.categorical else 1.0 for c in f.numeric})
    else:
        gaps = np.hypot(*[rows[c].to_numpy()[:, None] - rows[c].to_numpy() for c in f.numeric])
    given = np.stack(rows["labels"].to_numpy())
    for i in (0, 1, 3):
        assert scores[i][0] == pytest.approx(brute_silhouette(gaps, given[:, i]), abs=1e-9)


def test_tree_covers_every_leaf_once(spark):
    rng = np.random.default_rng(6)
    points = spark.createDataFrame([(float(a), float(b)) for a, b in np.concatenate([rng.normal(0, 1, (600, 2)), rng.lognormal(0, 3, (300, 2))])], "x double, y double")
    low, high = points.agg(F.min("x"), F.min("y")).first(), points.agg(F.max("x"), F.max("y")).first()
    square = quadtree.Square("x", "y", tuple(low), tuple(high))
    rows = points.toPandas()
    celled = spark.createDataFrame(rows.assign(_cell=square.deepest(rows)))
    tree = quadtree.grow(celled, square, 20)
    leaf = tree.leaf_of(square.deepest(rows))
    sizes = {int(c): int(n) for c, n in zip(*np.unique(leaf, return_counts=True))}
    assert sizes == {c: tree.counts[c] for c in tree.leaves.tolist()} and max(sizes.values()) <= 20
    cx, cy, half = square.box(leaf)
    assert (np.abs(rows.x - cx) <= half * (1 + 1e-9)).all() and (np.abs(rows.y - cy) <= half * (1 + 1e-9)).all()
    assert sorted(c for b in tree.blocks().values() for c in b) == sorted(tree.leaves.tolist())
    for leaf in tree.leaves.tolist()[::7]:
        near, far = tree.met(leaf)
        assert sum(tree.counts[c] for c in near + far) == 900 and leaf in near


def test_a_method_of_ones_own(frame):
    """A fourth method, without centroids: groups of equal size by pay."""
    def thirds(tuples, k):
        cuts = tuples.approxQuantile("salary_avg", [i / k for i in range(1, k)], 0.0)
        label = sum(((F.col("salary_avg") > c).cast("int") for c in cuts), F.lit(0))
        return tuples.withColumn(CLUSTER, label), float(k)

    method = methods.Alone("equal parts", "gower", thirds)
    found = sw.sweep(frame, ["salary_avg", "schedule_name"], range(2, 5), method=method)
    assert found.best.method_name == "equal parts"
    rows = found.runs.orderBy("k").collect()
    assert [r["k"] for r in rows] == [2, 3, 4] and all(r["silhouette_score"] is not None for r in rows)
    labelled = found.label(frame)
    assert labelled.count() == 500 and labelled.select(CLUSTER).distinct().count() == found.best.k
    assert set(labelled.columns) == {*frame.columns, CLUSTER}


def test_spark_ml_as_a_method(frame):
    features = measure(frame, split_types(["min_experience_years", "salary_avg"]))

    def spark_kmeans(tuples, k):
        centroids, cost = kmeans.fit(kmeans.as_vectors(tuples, features), features, k, restarts=1)
        return assign(tuples, features, centroids, 0.0), cost

    theirs = sw.sweep(frame, ["salary_avg", "min_experience_years"], [3], method=methods.Alone("Spark ML", "euclidean", spark_kmeans))
    mine = sw.sweep(frame, ["salary_avg", "min_experience_years"], [3])
    assert mine.best.cost <= theirs.best.cost * 1.05


def test_fewer_tuples_than_clusters(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (1.0, "b")] * 3, "salary_avg double, name string")
    found = sw.sweep(df, ["salary_avg", "name"], range(2, 6))
    reasons = {r["k"]: r["skipped_reason"] for r in found.runs.collect()}
    assert reasons[4] == reasons[5] == "more clusters than distinct tuples" and reasons[3] is None
    with pytest.raises(ValueError):
        sw.sweep(df, ["salary_avg", "name"], [2], pin=9)


@pytest.mark.parametrize("tile_rows", [7, 1_000])
def test_pairwise_distances(frame, tile_rows):
    data = data_of(frame, "salary_avg", "min_experience_years", "schedule_name")
    f, rows = data.features, data.tuples.limit(60)
    ranges = {c: f.moments[c].z_range for c in f.numeric}
    found = pairwise.pairwise(rows, ranges, f.categorical, tile_rows=tile_rows)
    assert "Cartesian" not in found._jdf.queryExecution().executedPlan().toString()
    pairs = found.collect()
    assert len({(p.a.row, p.b.row) for p in pairs}) == len({frozenset((p.a.row, p.b.row)) for p in pairs}) == len(pairs) == 60 * 59 // 2
    for p in pairs:
        want = (sum(abs(p.a[c] - p.b[c]) / ranges[c] for c in f.numeric) + (p.a.schedule_name != p.b.schedule_name)) / 3
        assert p.distance == pytest.approx(want, abs=1e-12)
    plane = pairwise.pairwise(rows, ranges, [], "euclidean").first()
    assert plane.distance == pytest.approx(np.hypot(*[plane.a[c] - plane.b[c] for c in f.numeric]))
    assert {p.distance for p in pairwise.pairwise(rows, {}, f.categorical, "hamming").collect()} <= {0.0, 1.0}
    with pytest.raises(ValueError):
        pairwise.pairwise(rows, ranges, f.categorical, limit=59)
    with pytest.raises(ValueError):
        pairwise.pairwise(rows, ranges, f.categorical, "euclidean")
    assert pairwise.pairwise(rows.limit(0), ranges, f.categorical).collect() == []


def _ordered_batch(rows=20_000):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"a": rng.normal(size=rows).round(4), "c": rng.choice(list("uvwx"), rows), "w": rng.integers(1, 4, rows)})
    return frame.sort_values(["c", "a"], ignore_index=True)


def test_blocks_of_ordered_tuples_are_assigned_whole():
    features = FeatureSet(["a"], ["c"])
    batch = fused.Batch(_ordered_batch(), features)
    blocks = fused.Blocks.of(batch)
    listed = [[{"a": -1.0, "c": "u"}, {"a": 0.2, "c": "v"}, {"a": 0.25, "c": "w"}, {"a": 0.25, "c": "w"}], [{"a": 0.0, "c": "x"}, {"a": 2.0, "c": "x"}]]
    for (units, label, cost), centroids in zip(blocks.labelled(listed, 0.5), listed):
        assert len(units) < len(batch) / 8  # most of the tuples were taken in blocks
        assert units.weight.sum() == batch.weight.sum() and len(label) == len(cost) == len(units)
    key = ["run", "cluster", "feature", "value"]
    whole, single = (fused._partial(page, features, listed, 0.5).sort_values(key, ignore_index=True) for page in (blocks, batch))
    pd.testing.assert_frame_equal(whole[key], single[key])
    np.testing.assert_allclose(whole["total"], single["total"], rtol=1e-11, atol=1e-9)


def test_tuples_without_order_or_numbers_make_no_blocks():
    frame = _ordered_batch().sample(frac=1, random_state=1)
    assert fused.Blocks.of(fused.Batch(frame, FeatureSet(["a"], ["c"]))) is None
    assert fused.Blocks.of(fused.Batch(frame, FeatureSet([], ["c"]))) is None


def test_data_hands_tuples_on_in_order(spark):
    rows = [(float(i * 37 % 101), "uv"[i % 2]) for i in range(101)]
    frame = spark.createDataFrame(rows, "salary_avg double, name string")
    data = methods.Data.of(frame, measure(frame, FeatureSet(["salary_avg"], ["name"])))
    for part in data.tuples.select("name", "salary_avg").rdd.glom().collect():
        assert [tuple(r) for r in part] == sorted(tuple(r) for r in part)


def _grown(n=6_000):
    rng = np.random.default_rng(5)
    places = np.concatenate([rng.normal(size=(n // 2, 2)), rng.normal(size=(n // 2, 2)) * 0.01 + 1])
    square = quadtree.Square("x", "y", tuple(places.min(0)), tuple(places.max(0)))
    deepest = square.deepest(pd.DataFrame(places, columns=["x", "y"]))
    counts, leaves, open_ = {}, [], [1]
    while open_:
        cell = open_.pop()
        depth = (cell.bit_length() - 1) // 2
        counts[cell] = int((deepest >> 2 * (quadtree.DEPTH - depth) == cell).sum())
        if counts[cell] <= 20:
            leaves.append(cell) if counts[cell] else counts.pop(cell)
        else:
            open_ += range(4 * cell, 4 * cell + 4)
    return quadtree.Tree(square, counts, leaves)


def test_a_plan_meets_every_tuple_once_and_shares_the_far_cells():
    tree = _grown()
    met = sum(len(tree.met(leaf)[1]) for leaf in tree.leaves.tolist())
    shared, seen = 0, set()
    for block, leaves in tree.blocks().items():
        above, plan = {}, tree.plan(block)
        shared += sum(len(step[2]) + len(step[3]) for step in plan)
        for cell, parent, far, apart, near in plan:
            above[cell] = above.get(parent, []) + far
            x, y, h = tree.boxes[cell]
            for c in far:
                cx, cy, ch = tree.boxes[c]
                assert max(abs(x - cx), abs(y - cy)) - h - ch >= 2 * max(h, ch) * (1 - 1e-9)
            if near is not None:
                seen.add(cell)
                assert sum(tree.counts[c] for c in above[cell] + apart + near) == tree.counts[1]
    assert seen == tree.is_leaf
    assert shared < met / 3


def test_what_a_task_holds_of_the_plans_is_packed():
    tree = _grown()
    packed = sum(len(pickle.dumps(tree.plan(block))) for block in tree.blocks())
    lists = sum(sys.getsizeof(ids) + sum(map(sys.getsizeof, ids)) for leaf in tree.leaves.tolist() for ids in tree.met(leaf))
    assert packed < lists / 8
