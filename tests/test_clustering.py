"""Clustering against brute force and by its properties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from jobgrain.clustering import euclidean, kmeans, profile, prototypes, silhouette
from jobgrain.clustering import sweep as sw
from jobgrain.clustering.features import (CLUSTER, FeatureSet, assign, collapse, gower, measure, nearest,
                                          split_types, tuples_of)

N = 300


def brute_silhouette(distances, labels):
    out = []
    for i, own in enumerate(labels):
        same = labels == own
        if same.sum() == 1:
            out.append(0.0)
            continue
        a = distances[i][same].sum() / (same.sum() - 1)
        b = min(distances[i][labels == other].mean() for other in set(labels) - {own})
        out.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return float(np.mean(out))


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.round(np.concatenate([rng.normal(0, 1, N - 4), [30.0, 31.0, 250.0, 250.0]]), 2)
    e = rng.choice([-1.2, -0.6, 0.5, 2.0], N)
    c, d = rng.choice(list("abc"), N), rng.choice(list("uvwxyz"), N)
    labels = rng.integers(0, 3, N)
    labels[0] = 3  # a cluster of one row
    rows = [(float(a), float(b), str(g), str(h), int(i)) for a, b, g, h, i in zip(x, e, c, d, labels)]
    df = spark.createDataFrame(rows, "x double, e double, c string, d string, cluster int")
    return df, x, e, c, d, labels


def weighted(df, *columns):
    return collapse(df, list(columns), [CLUSTER])


def test_line(points):
    df, x, _, _, _, labels = points
    t = weighted(df, "x")
    sizes = silhouette.cluster_sizes(t, 5)  # the fifth is empty
    assert sizes[4] == 0
    want = brute_silhouette(np.abs(x[:, None] - x), labels)
    assert silhouette.line_silhouette(t, "x", sizes).first()[0] == pytest.approx(want, abs=1e-12)


def test_gower_with_and_without_cut_runs(points, monkeypatch):
    df, x, _, c, _, labels = points
    t, span = weighted(df, "x", "c"), float(x.max() - x.min())
    sizes = silhouette.cluster_sizes(t, 4)
    want = brute_silhouette((np.abs(x[:, None] - x) / span + (c[:, None] != c)) / 2, labels)
    assert silhouette.run_bounds(t, "x") == []
    monkeypatch.setattr(silhouette, "ONE_RUN", 10)
    cuts = silhouette.run_bounds(t, "x")
    assert len(cuts) > 50
    for columns in (silhouette.Columns({}, {"x", "c"}), silhouette.Columns({"x": cuts}, set()), silhouette.inspect(t, ["x"], ["c"])):
        got = silhouette.gower_silhouette(t, {"x": span}, ["c"], sizes, columns).first()[0]
        assert got == pytest.approx(want, abs=1e-12)


def test_hamming(points):
    df, _, _, c, d, labels = points
    t = weighted(df, "c", "d")
    want = brute_silhouette(((c[:, None] != c).astype(float) + (d[:, None] != d)) / 2, labels)
    assert silhouette.hamming_silhouette(t, ["c", "d"], silhouette.cluster_sizes(t, 4)).first()[0] == pytest.approx(want, abs=1e-12)


@pytest.mark.parametrize("stretch", [1.0, 0.01, 50.0])
def test_plane(points, stretch):
    df, x, e, _, _, labels = points
    t = weighted(df.withColumn("x", F.col("x") * stretch), "x", "e")
    xs = x * stretch
    want = brute_silhouette(np.sqrt((xs[:, None] - xs) ** 2 + (e[:, None] - e) ** 2), labels)
    got = euclidean.plane_silhouette(t, "x", "e", float(xs.min()), float(xs.max()), silhouette.cluster_sizes(t, 4))
    assert got.first()[0] == pytest.approx(want, abs=1e-10)


def test_plane_of_two_features_of_many_values(spark):
    """Two wide features: clumps, a far outlier, lines, equal points with other labels, and a cluster of one row."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, 900), rng.lognormal(0, 2, 600), np.full(300, 2.5), rng.normal(9, 1e-3, 199), [4e4]])
    y = np.concatenate([rng.exponential(3, 1500), np.linspace(0, 1, 300), rng.normal(9, 1e-3, 199), [-5.0]])
    x[:40], y[:40] = x[40:80], y[40:80]
    labels = rng.integers(0, 4, 2000)
    labels[7] = 5
    t = weighted(spark.createDataFrame([(float(a), float(b), int(i)) for a, b, i in zip(x, y, labels)], "x double, e double, cluster int"), "x", "e")
    want = brute_silhouette(np.hypot(x[:, None] - x, y[:, None] - y), labels)
    got = euclidean.plane_silhouette(t, "x", "e", 0.0, 0.0, silhouette.cluster_sizes(t, 6))
    assert got.first()[0] == pytest.approx(want, abs=1e-9)


def test_skip_reasons():
    assert silhouette.skip_reason([5, 0]) and silhouette.skip_reason([1, 1, 1])
    assert silhouette.skip_reason([2, 1]) is None


def test_all_tuples_equal_has_no_valid_k(spark):
    df = spark.createDataFrame([("a", "b")] * 20, "schedule_name string, area_name string")
    found = sw.sweep(df, ["schedule_name", "area_name"], range(1, 4), restarts=1, final_restarts=1)
    reasons = {r["k"]: r["skipped_reason"] for r in found.runs.collect()}
    assert reasons == {1: "fewer than two clusters", 2: "more clusters than distinct tuples",
                       3: "more clusters than distinct tuples"}
    assert found.best.k == 1 and found.best_score == 0.0


def test_constant_numeric_contributes_nothing(spark):
    a = {"x": F.lit(1.0), "c": F.lit("u")}
    b = {"x": F.lit(1.0), "c": F.lit("v")}
    assert spark.range(1).select(gower(a, b, {"x": 0.0}, ["c"])).first()[0] == 0.5


def test_cost_never_rises_and_fits_repeat(points):
    df, *_ = points
    features = FeatureSet(["x"], ["c", "d"])
    t = collapse(df, ["x", "c", "d"])
    dense = prototypes.with_density(t, features)
    seeds = prototypes.cao_seeds(dense, features, 4, 0.5)
    assert prototypes.cao_seeds(dense, features, 2, 0.5) == seeds[:2]
    first = prototypes.fit(t, features, seeds, 0.5)
    assert all(b <= a + 1e-9 for a, b in zip(first[2], first[2][1:]))
    assert prototypes.fit(t, features, seeds, 0.5) == first


def test_modes_step_equals_plain_python(points):
    df, _, _, c, d, _ = points
    features, centres = FeatureSet([], ["c", "d"]), [{"c": "a", "d": "u"}, {"c": "b", "d": "v"}]
    new, cost = prototypes.update(collapse(df, ["c", "d"]), features, centres, 1.0)
    dist = np.array([(c != m["c"]).astype(int) + (d != m["d"]) for m in centres])
    labels = dist.argmin(axis=0)
    assert cost == dist.min(axis=0).sum()
    for i in range(2):
        for name, values in (("c", c), ("d", d)):
            seen, counts = np.unique(values[labels == i], return_counts=True)
            assert new[i][name] == seen[counts.argmax()]


def test_quoted_values_survive_as_centroids(spark):
    names = ["it's", 'a "b"', "back\\slash", "per%cent"]
    t = spark.createDataFrame([(n, 1) for n in names], "c string, w long")
    near = t.select("c", nearest(FeatureSet([], ["c"]), [{"c": n} for n in names], 1.0).alias("n")).collect()
    assert {r["c"]: r["n"]["cid"] for r in near} == {n: i for i, n in enumerate(names)}
    assert all(r["n"]["d"] == 0 for r in near)


def test_nearest_prefers_the_lowest_id(spark):
    t = spark.createDataFrame([("a", 1)], "c string, w long")
    assert assign(t, FeatureSet([], ["c"]), [{"c": "b"}, {"c": "d"}], 1.0).first()[CLUSTER] == 0


def test_kmeans_on_separated_groups(spark):
    rows = [(float(g * 100 + i), g) for g in range(3) for i in range(10)]
    df = spark.createDataFrame(rows, "salary_avg double, g int")
    features = measure(df, split_types(["salary_avg"]))
    tuples = tuples_of(df, features)
    centres, cost = kmeans.fit(kmeans.as_vectors(tuples, features), features, 3, restarts=3)
    z = features.moments["salary_avg"]
    assert sorted(round(c["salary_avg"] * z.std + z.mean, 6) for c in centres) == [4.5, 104.5, 204.5]
    one_centre = kmeans.fit(kmeans.as_vectors(tuples, features), features, 1, restarts=1)
    assert one_centre[1] > cost


def test_sweep_finds_planted_groups_and_labels_rows(spark):
    rows = [(1000.0 * g + i, f"job {g}", 0, "s", "remote", "area", ["A", f"S{g}"]) for g in range(3) for i in range(12)]
    rows.append((None, "job 0", 1, "s", None, None, []))
    df = spark.createDataFrame(rows, "salary_avg double, name string, min_experience_years int, x string,"
                                     " schedule_name string, area_name string, skills_list array<string>")
    found = sw.sweep(df, ["Зарплата", "Название вакансии"], range(2, 6), restarts=1, final_restarts=1)
    assert found.best.method_name == "K-Prototypes" and found.best.k == 3
    assert found.best_score == max(r["silhouette_score"] for r in found.runs.collect())
    assert sw.best_k(found.runs).first()["k"] == 3
    labelled = found.label(df)
    assert labelled.count() == 36 and set(df.columns) | {CLUSTER} == set(labelled.columns)
    shown = profile.profiles(labelled, 3, ["salary_avg"], ["name"], stem="remote").orderBy("id").collect()
    assert sum(r["vacancies_count"] for r in shown) == 36
    assert {r["title"].split(" (")[0] for r in shown} == {"job 0", "job 1", "job 2"}
    assert all(r["remote_rate"] == 100.0 and r["skills"][0] == "A" for r in shown)
    pinned = sw.sweep(df, ["salary_avg", "name"], range(2, 4), restarts=1, final_restarts=1, pin=5)
    assert pinned.best.k == 5


def test_sweep_errors(spark):
    df = spark.createDataFrame([(None, "a")], "salary_avg double, name string")
    with pytest.raises(ValueError):
        sw.sweep(df, [])
    with pytest.raises(ValueError):
        sw.sweep(df, ["salary_avg", "name"])


def test_profile_fallbacks_for_an_empty_cluster(spark):
    df = spark.createDataFrame([(0, None, f"n{i}", None, None, None) for i in range(4)],
                               "cluster int, salary_avg double, name string, min_experience_years int,"
                               " schedule_name string, skills_list array<string>")
    rows = profile.profiles(df, 2, [], []).orderBy("id").collect()
    assert [r["vacancies_count"] for r in rows] == [4, 0]
    assert [r["title"] for r in rows] == ["Группа #1", "Группа #2"]
    assert rows[1]["skills"] == [] and rows[1]["remote_rate"] == 0.0 and rows[1]["avg_salary"] == "Не указана"
    assert rows[0]["description"] == "Смешанная группа"


def test_title_share_is_inclusive_and_tied_modes_take_the_smallest(spark):
    names = ["b"] * 3 + ["a"] * 3 + ["c"] * 2 + ["d"] * 2
    df = spark.createDataFrame([(0, n) for n in names], "cluster int, name string")
    counts = profile.value_counts(df, ["name"])
    assert profile.titles(counts, profile.sizes(df, 1)).first()["titles"] == "a / b"
    assert profile.modes(counts).first()["mode"] == "a"
