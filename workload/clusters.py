"""Clustering: tuples, distances, silhouettes and profiles on given labels, fits and sweeps (A8-A16, C, J1-J3, K4)."""

from pyspark.sql import functions as F

from jobgrain.clustering import euclidean, methods, pairwise, profile, prototypes, quadtree, scoring, silhouette
from jobgrain.clustering import sweep as W
from jobgrain.clustering.features import (CLUSTER, FeatureSet, collapse, gower, measure, nearest,
                                          tuples_of)
from jobgrain.operators.statistics import standardize
from workload.cleaning import cleaned
from workload.registry import query, r
from workload.tables import base, table

CATS = ["c_mktsegment", "o_orderstatus", "n_name"]
GIVEN = 4  # given labels: customer key modulo 4

# Features of the base view: whole pay, years, segment.
FEATURES_SQL = """
f AS (SELECT k, o_custkey, CAST(o_custkey % 4 AS INTEGER) AS cluster, c_mktsegment, o_orderstatus, n_name,
        o_totalprice AS pay, c_acctbal AS balance,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 3 WHEN '4' THEN 6 END AS years
      FROM b)"""


def base_rows(spark, sf):
    return base(spark, sf).selectExpr(
        "o_orderkey as k", "int(o_custkey % 4) as cluster", "c_mktsegment", "o_orderstatus", "n_name",
        "o_totalprice as pay", "c_acctbal as balance",
        "case substring(o_orderpriority, 1, 1) when '1' then 0 when '2' then 1 when '3' then 3 when '4' then 6 end as years")


def labelled(spark, sf):
    """Clean postings with a given label."""
    return cleaned(spark, sf).withColumn(CLUSTER, (F.col("employer_id").cast("bigint") % GIVEN).cast("int"))


LABELLED_SQL = "l AS (SELECT *, CAST(o_custkey % 4 AS INTEGER) AS cluster FROM p)"


def _weighted(df, columns):
    return collapse(df.dropna(subset=columns), columns, [CLUSTER])


@query("c00_weighted_tuples", """
SELECT c_mktsegment, o_orderstatus, n_name, count(*) AS w FROM b GROUP BY ALL""")
def c00(spark, sf):
    return collapse(base_rows(spark, sf), CATS)


# --- figures of given clusters ---------------------------------------------

@query("a08_cluster_sizes", f"""
WITH {LABELLED_SQL}, ids AS (SELECT CAST(unnest(range(6)) AS INTEGER) AS cluster)
SELECT cluster, count(l.k) AS n FROM ids LEFT JOIN l USING (cluster) GROUP BY 1""")
def a08(spark, sf):
    """Two more clusters than there are labels, so two are empty."""
    return profile.sizes(labelled(spark, sf), GIVEN + 2)


@query("a09_cluster_salary", f"""
WITH {LABELLED_SQL} SELECT cluster, round(quantile_cont(salary_avg, 0.5), 4) AS median_salary, round(avg(salary_avg), 4) AS mean_salary
FROM l GROUP BY 1""")
def a09(spark, sf):
    return profile.salaries(labelled(spark, sf)).withColumns(
        {"median_salary": r("median_salary"), "mean_salary": r("mean_salary")})


@query("a10_dominant_titles", f"""
WITH {LABELLED_SQL}, named AS (SELECT cluster, schedule_name AS name FROM l WHERE schedule_name IS NOT NULL),
tot AS (SELECT cluster, count(*) AS total FROM l GROUP BY 1),
t AS (SELECT cluster, name, count(*) AS n FROM named GROUP BY 1, 2)
SELECT cluster, string_agg(name, ' / ' ORDER BY n DESC, name) AS titles FROM t JOIN tot USING (cluster)
WHERE n * 1.0 / total >= 0.3 GROUP BY 1""")
def a10(spark, sf):
    rows = labelled(spark, sf)
    return profile.titles(profile.value_counts(rows, ["schedule_name"]), profile.sizes(rows, GIVEN), "schedule_name")


SKILLS_SQL = """sk AS (SELECT cluster, skill, count(*) AS n FROM (SELECT cluster, unnest(skills_list) AS skill FROM {src}) GROUP BY 1, 2),
sr AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, skill) AS rn FROM sk),
s5 AS (SELECT cluster, string_agg(skill, '|' ORDER BY rn) AS skills FROM sr WHERE rn <= 5 GROUP BY 1)"""


@query("a11_cluster_top_skills", f"WITH {LABELLED_SQL}, {SKILLS_SQL.format(src='l')} SELECT * FROM s5")
def a11(spark, sf):
    return profile.top_skills(labelled(spark, sf)).withColumn("skills", F.array_join("skills", "|"))


@query("a12_cluster_remote_share", f"""
WITH {LABELLED_SQL} SELECT cluster, round(100.0 * count(*) FILTER (coalesce(contains(lower(schedule_name), 'удален'), FALSE)) / count(*), 6) AS remote_rate
FROM l GROUP BY 1""")
def a12(spark, sf):
    return profile.remote_rates(labelled(spark, sf)).withColumn("remote_rate", r("remote_rate", 6))


@query("a13_cluster_modes", f"""
WITH {LABELLED_SQL}, v AS (
  SELECT cluster, 'schedule_name' AS feature, schedule_name AS value FROM l
  UNION ALL SELECT cluster, 'area_name', area_name FROM l
  UNION ALL SELECT cluster, 'department_name', department_name FROM l),
c AS (SELECT cluster, feature, value, count(*) AS n FROM v WHERE value IS NOT NULL GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY cluster, feature ORDER BY n DESC, value) AS rn FROM c)
SELECT cluster, feature, value AS mode FROM k WHERE rn = 1""")
def a13(spark, sf):
    return profile.modes(profile.value_counts(labelled(spark, sf), ["schedule_name", "area_name", "department_name"]))


@query("a14_cluster_mean_years", f"""
WITH {LABELLED_SQL} SELECT cluster, round(avg(min_experience_years), 6) AS mean_years,
  printf('%.1f', avg(min_experience_years)) AS shown FROM l GROUP BY 1""")
def a14(spark, sf):
    return profile.mean_years(labelled(spark, sf)).select(
        CLUSTER, r("mean_years", 6).alias("mean_years"), F.format_string("%.1f", "mean_years").alias("shown"))


@query("a15_sizes_by_cluster", f"WITH {LABELLED_SQL} SELECT cluster, count(*) AS n FROM l GROUP BY 1")
def a15(spark, sf):
    return profile.sizes(labelled(spark, sf), GIVEN).orderBy(CLUSTER)


@query("a16_cluster_mean_scaled", f"""
WITH {LABELLED_SQL}, kept AS (SELECT * FROM l WHERE salary_avg IS NOT NULL)
SELECT cluster, round(avg((salary_avg - (SELECT avg(salary_avg) FROM kept)) / (SELECT stddev_pop(salary_avg) FROM kept)), 6) AS salary_avg
FROM kept GROUP BY 1""")
def a16(spark, sf):
    kept = labelled(spark, sf).select(CLUSTER, "salary_avg").dropna()
    return standardize(kept, ["salary_avg"]).groupBy(CLUSTER).agg(r(F.avg("salary_avg"), 6).alias("salary_avg"))


@query("a22_label_guard", """
SELECT k AS labelling, CAST(count(DISTINCT o_custkey % k) AS BIGINT) AS labels, count(*) AS n,
  count(DISTINCT o_custkey % k) >= 2 AND count(DISTINCT o_custkey % k) < count(*) AS can_score
FROM orders, (SELECT unnest([1, 2, 5]) AS k) GROUP BY k""", postings=False)
def a22(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey").withColumn("labelling", F.explode(F.array(*map(F.lit, (1, 2, 5)))))
    counts = (orders.groupBy("labelling", (F.col("o_custkey") % F.col("labelling")).alias(CLUSTER))
              .agg(F.count(F.lit(1)).alias("w")))
    guard = counts.groupBy("labelling").agg(F.count(F.lit(1)).alias("labels"), F.sum("w").alias("n"))
    return guard.withColumn("can_score", (F.col("labels") >= 2) & (F.col("labels") < F.col("n")))


# --- distances and silhouettes of given labels ------------------------------

RANGE_SQL = "g AS (SELECT max(pay) - min(pay) AS span FROM f)"


def _line_sums(values: str) -> str:
    """`ls`: per value of pay and cluster, the sum of |pay - x| over the cluster, from running counts and sums."""
    return f"""
h AS (SELECT v.pay, c.other, count(f.pay) AS n, coalesce(sum(f.pay), 0) AS mass
  FROM (SELECT DISTINCT pay FROM {values}) v CROSS JOIN (SELECT unnest(range({GIVEN})) AS other) c
  LEFT JOIN {values} f ON f.pay = v.pay AND f.cluster = c.other GROUP BY 1, 2),
ls AS (SELECT pay, other, pay * (2 * sum(n) OVER upto - sum(n) OVER whole) + sum(mass) OVER whole - 2 * sum(mass) OVER upto AS total,
  CAST(sum(n) OVER whole AS DOUBLE) AS n FROM h
  WINDOW upto AS (PARTITION BY other ORDER BY pay), whole AS (PARTITION BY other))"""


# Per row and cluster: the mean of half a scaled difference and half a mismatch.
GOWER_SUMS_SQL = f"""{_line_sums('f')},
m AS (SELECT cluster AS other, c_mktsegment, count(*) AS same FROM f GROUP BY 1, 2),
d AS (SELECT f.k, f.pay, f.c_mktsegment, f.cluster, ls.other, (ls.total / span + ls.n - coalesce(m.same, 0)) / 2 AS total, ls.n
  FROM f JOIN ls ON f.pay = ls.pay LEFT JOIN m ON m.other = ls.other AND m.c_mktsegment = f.c_mktsegment, g)"""
LINE_SUMS_SQL = f"""{_line_sums('f')},
d AS (SELECT f.k, f.pay, f.c_mktsegment, f.cluster, ls.other, ls.total, ls.n FROM f JOIN ls ON f.pay = ls.pay)"""
SCORE_SQL = """si AS (SELECT k, max(total / (n - 1)) FILTER (other = cluster) AS inner_mean, min(total / n) FILTER (other <> cluster) AS outer_mean
  FROM d GROUP BY k)
SELECT round(avg((outer_mean - inner_mean) / greatest(outer_mean, inner_mean)), 9) AS silhouette FROM si"""


def _pay_range(rows):
    low, high = rows.agg(F.min("pay"), F.max("pay")).first()
    return low, high


def _sil(one):
    return one.select(F.round("silhouette", 9).alias("silhouette"))


@query("c07_gower_to_centroid", f"""
WITH {FEATURES_SQL}, {RANGE_SQL}
SELECT k, round((abs(pay - 250000) / span + CASE WHEN c_mktsegment <> 'BUILDING' THEN 1 ELSE 0 END) / 2, 9) AS distance FROM f, g""")
def c07(spark, sf):
    rows = base_rows(spark, sf)
    low, high = _pay_range(rows)
    here = {"pay": F.col("pay"), "c_mktsegment": F.col("c_mktsegment")}
    centre = {"pay": F.lit(250000.0), "c_mktsegment": F.lit("BUILDING")}
    return rows.select("k", F.round(gower(here, centre, {"pay": high - low}, ["c_mktsegment"]), 9).alias("distance"))


@query("j02_distance_sums", f"""
WITH {FEATURES_SQL}, {RANGE_SQL}, {GOWER_SUMS_SQL}
SELECT pay, c_mktsegment, cluster, count(DISTINCT k) AS w, {', '.join(f'round(max(total) FILTER (other = {i}), 5) AS to_{i}' for i in range(4))}
FROM d GROUP BY pay, c_mktsegment, cluster""")
def j02(spark, sf):
    """What the full distance matrix is used for: each tuple's distance to whole clusters."""
    tuples = _weighted(base_rows(spark, sf), ["pay", "c_mktsegment"])
    low, high = _pay_range(tuples)
    sums = silhouette.gower_sums(tuples, {"pay": high - low}, ["c_mktsegment"], silhouette.cluster_sizes(tuples, GIVEN))
    return sums.select("pay", "c_mktsegment", CLUSTER, "w", *[r(f"_d{i}", 5).alias(f"to_{i}") for i in range(GIVEN)])


@query("j02_pairwise_distances", f"""
WITH {FEATURES_SQL}, t AS (SELECT years, c_mktsegment, o_orderstatus, avg(pay) AS pay FROM f WHERE years IS NOT NULL GROUP BY 1, 2, 3),
g AS (SELECT max(pay) - min(pay) AS pays, max(years) - min(years) AS span FROM t)
SELECT a.c_mktsegment AS a_segment, a.o_orderstatus AS a_status, a.years AS a_years, b.c_mktsegment AS b_segment, b.o_orderstatus AS b_status,
  b.years AS b_years, round((abs(a.pay - b.pay) / pays + abs(a.years - b.years) * 1.0 / span + CASE WHEN a.c_mktsegment <> b.c_mktsegment THEN 1 ELSE 0 END
    + CASE WHEN a.o_orderstatus <> b.o_orderstatus THEN 1 ELSE 0 END) / 4, 9) AS distance
FROM t a JOIN t b ON (a.c_mktsegment, a.o_orderstatus, a.years) < (b.c_mktsegment, b.o_orderstatus, b.years), g""")
def j02_pairs(spark, sf):
    """The whole matrix of Gower distances, for groups of postings with their mean pay."""
    groups = base_rows(spark, sf).where("years is not null").groupBy("years", "c_mktsegment", "o_orderstatus").agg(F.avg("pay").alias("pay"))
    row = groups.agg(F.max("pay") - F.min("pay"), (F.max("years") - F.min("years")).cast("double")).first()
    found = pairwise.pairwise(groups, {"pay": row[0], "years": row[1]}, ["c_mktsegment", "o_orderstatus"], tile_rows=20)
    key = {s: F.struct(f"{s}.c_mktsegment", f"{s}.o_orderstatus", f"{s}.years") for s in "ab"}
    ordered = found.select(F.least(key["a"], key["b"]).alias("a"), F.greatest(key["a"], key["b"]).alias("b"), r("distance", 9).alias("distance"))
    return ordered.select(*[F.col(f"{s}.{c}").alias(f"{s}_{n}") for s in "ab" for c, n in
                            (("c_mktsegment", "segment"), ("o_orderstatus", "status"), ("years", "years"))], "distance")


@query("c08_silhouette_line", f"""
WITH {FEATURES_SQL}, {LINE_SUMS_SQL}, {SCORE_SQL}""")
def c08_line(spark, sf):
    tuples = _weighted(base_rows(spark, sf), ["pay"])
    return _sil(silhouette.line_silhouette(tuples, "pay", silhouette.cluster_sizes(tuples, GIVEN)))


def _plane_sql(x: str, y: str) -> str:
    """Scaled features, and every pair of rows."""
    return f"""kept AS (SELECT * FROM f WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
z AS (SELECT k, cluster, ({x} - (SELECT avg({x}) FROM kept)) / (SELECT stddev_pop({x}) FROM kept) AS x,
  ({y} - (SELECT avg({y}) FROM kept)) / (SELECT stddev_pop({y}) FROM kept) AS y FROM kept),
d AS (SELECT a.k, a.cluster, z.cluster AS other, sum(sqrt((a.x - z.x) ** 2 + (a.y - z.y) ** 2)) AS total, count(*) AS n
  FROM z a, z GROUP BY ALL), {SCORE_SQL}"""


@query("c08_silhouette_plane", f"WITH {FEATURES_SQL}, {_plane_sql('pay', 'years')}")
def c08_plane(spark, sf):
    """Two scaled numeric features, one of few values, true Euclidean distance."""
    rows = base_rows(spark, sf)
    features = measure(rows, FeatureSet(["pay", "years"], []))
    tuples = features.encode(_weighted(rows, ["pay", "years"]))
    pay = features.moments["pay"]
    return _sil(euclidean.plane_silhouette(tuples, "pay", "years", (pay.low - pay.mean) / pay.std,
                                           (pay.high - pay.mean) / pay.std, silhouette.cluster_sizes(tuples, GIVEN)))


@query("c08_silhouette_two_prices", f"WITH {FEATURES_SQL}, {_plane_sql('pay', 'balance')}")
def c08_prices(spark, sf):
    """Two scaled features of many values each."""
    rows = base_rows(spark, sf)
    features = measure(rows, FeatureSet(["pay", "balance"], []))
    tuples = features.encode(_weighted(rows, ["pay", "balance"])).withColumn(scoring.LABELS, F.array(CLUSTER))
    sizes = [silhouette.cluster_sizes(tuples, GIVEN)]
    score, = scoring.silhouettes(quadtree.plane_sums(tuples, "pay", "balance", [GIVEN]), sizes)
    return spark.createDataFrame([(round(score, 9),)], "silhouette double")


@query("c09_silhouette_hamming", f"""
WITH {FEATURES_SQL}, t AS (SELECT c_mktsegment, o_orderstatus AS pay, n_name, cluster, count(*) AS w FROM f GROUP BY ALL),
d AS (SELECT a.c_mktsegment, a.pay, a.n_name, a.cluster, a.w, z.cluster AS other, sum(z.w) AS n,
  sum(z.w * ((CASE WHEN a.c_mktsegment <> z.c_mktsegment THEN 1 ELSE 0 END + CASE WHEN a.pay <> z.pay THEN 1 ELSE 0 END
    + CASE WHEN a.n_name <> z.n_name THEN 1 ELSE 0 END) / 3.0)) AS total FROM t a, t z GROUP BY ALL),
si AS (SELECT c_mktsegment, pay, n_name, cluster, w, max(total / (n - 1)) FILTER (other = cluster) AS inner_mean,
  min(total / n) FILTER (other <> cluster) AS outer_mean FROM d GROUP BY ALL)
SELECT round(sum(w * (outer_mean - inner_mean) / greatest(outer_mean, inner_mean)) / sum(w), 9) AS silhouette FROM si""")
def c09(spark, sf):
    tuples = _weighted(base_rows(spark, sf), CATS)
    return _sil(silhouette.hamming_silhouette(tuples, CATS, silhouette.cluster_sizes(tuples, GIVEN)))


@query("c10_silhouette_gower", f"""
WITH {FEATURES_SQL}, {RANGE_SQL}, {GOWER_SUMS_SQL}, {SCORE_SQL}""")
def c10(spark, sf):
    tuples = _weighted(base_rows(spark, sf), ["pay", "c_mktsegment"])
    low, high = _pay_range(tuples)
    return _sil(silhouette.gower_silhouette(tuples, {"pay": high - low}, ["c_mktsegment"],
                                            silhouette.cluster_sizes(tuples, GIVEN)))


# --- assignment, seeds and single steps -------------------------------------

CENTROIDS = [{"pay": -1.0, "c_mktsegment": "BUILDING"}, {"pay": 0.0, "c_mktsegment": "MACHINERY"},
             {"pay": 1.5, "c_mktsegment": "BUILDING"}]
MIXED = FeatureSet(["pay"], ["c_mktsegment"])

NEAR_SQL = """z AS (SELECT k, (pay - (SELECT avg(pay) FROM f)) / (SELECT stddev_pop(pay) FROM f) AS pay, c_mktsegment, o_orderstatus, n_name FROM f),
n AS (SELECT *, (pay + 1.0) * (pay + 1.0) + CASE WHEN c_mktsegment <> 'BUILDING' THEN 0.5 ELSE 0 END AS d0,
  pay * pay + CASE WHEN c_mktsegment <> 'MACHINERY' THEN 0.5 ELSE 0 END AS d1,
  (pay - 1.5) * (pay - 1.5) + CASE WHEN c_mktsegment <> 'BUILDING' THEN 0.5 ELSE 0 END AS d2 FROM z),
a AS (SELECT *, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM n)"""


def _measured(rows):
    return measure(rows, MIXED)


@query("j03_nearest_centroid", f"WITH {FEATURES_SQL}, {NEAR_SQL} SELECT k, cluster, round(least(d0, d1, d2), 8) AS d FROM a")
def j03(spark, sf):
    rows = base_rows(spark, sf)
    encoded = _measured(rows).encode(rows)
    return encoded.select("k", nearest(MIXED, CENTROIDS, 0.5).alias("n")).select(
        "k", F.col("n.cid").alias(CLUSTER), F.round("n.d", 8).alias("d"))


@query("j01_labels_on_rows", f"""
WITH {FEATURES_SQL}, {NEAR_SQL} SELECT f.k, f.pay, f.c_mktsegment, a.cluster FROM f JOIN a USING (k)""")
def j01(spark, sf):
    """Labels back on the original rows, without a join."""
    rows = base_rows(spark, sf).drop(CLUSTER)
    fit = W.Fit("K-Prototypes", 3, CENTROIDS, 0.5, 0.0)
    return W.label_rows(rows, _measured(rows), fit).select("k", "pay", "c_mktsegment", CLUSTER)


@query("c05_kprototypes_step", f"""
WITH {FEATURES_SQL}, {NEAR_SQL},
c AS (SELECT cluster, c_mktsegment, count(*) AS n FROM a GROUP BY 1, 2),
m AS (SELECT cluster, c_mktsegment, row_number() OVER (PARTITION BY cluster ORDER BY n DESC, c_mktsegment) AS rn FROM c)
SELECT a.cluster, round(avg(pay), 6) AS mean_pay, round(sum(least(d0, d1, d2)), 4) AS cost, count(*) AS size, any_value(m.c_mktsegment) AS mode
FROM a JOIN m ON m.cluster = a.cluster AND rn = 1 GROUP BY 1""")
def c05_step(spark, sf):
    rows = base_rows(spark, sf)
    features = _measured(rows)
    step = prototypes.update_table(tuples_of(rows, features), features, CENTROIDS, 0.5)
    named = F.col("feature").isNotNull()
    return step.groupBy(CLUSTER).agg(
        r(F.max(F.when(~named, F.col("mean_pay"))), 6).alias("mean_pay"), r(F.max(F.when(~named, F.col("cost"))), 4).alias("cost"),
        F.max(F.when(~named, F.col("size"))).alias("size"), F.max(F.when(named, F.col("value"))).alias("mode"))


MODES = [{"c_mktsegment": "BUILDING", "o_orderstatus": "O", "n_name": "NATION_1"},
         {"c_mktsegment": "MACHINERY", "o_orderstatus": "F", "n_name": "NATION_2"},
         {"c_mktsegment": "BUILDING", "o_orderstatus": "P", "n_name": "NATION_3"}]


@query("c04_kmodes_step", f"""
WITH {FEATURES_SQL}, n AS (SELECT *, {', '.join('(' + ' + '.join(f"CASE WHEN {c} <> '{v}' THEN 1 ELSE 0 END" for c, v in m.items()) + f') AS d{i}' for i, m in enumerate(MODES))} FROM f),
a AS (SELECT * EXCLUDE (cluster), CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS cluster FROM n),
v AS (SELECT cluster, 'c_mktsegment' AS feature, c_mktsegment AS value FROM a UNION ALL SELECT cluster, 'o_orderstatus', o_orderstatus FROM a
  UNION ALL SELECT cluster, 'n_name', n_name FROM a),
c AS (SELECT cluster, feature, value, count(*) AS n FROM v GROUP BY ALL),
m AS (SELECT *, row_number() OVER (PARTITION BY cluster, feature ORDER BY n DESC, value) AS rn FROM c)
SELECT cluster, feature, value FROM m WHERE rn = 1""")
def c04_step(spark, sf):
    features = FeatureSet([], CATS)
    step = prototypes.update_table(collapse(base_rows(spark, sf), CATS), features, MODES, 1.0)
    return step.where(F.col("feature").isNotNull()).select(CLUSTER, "feature", "value")


@query("c06_cao_seeds", f"""
WITH {FEATURES_SQL}, t AS (SELECT c_mktsegment AS a, o_orderstatus AS b, n_name AS c, count(*) AS w FROM f GROUP BY ALL),
den AS (SELECT a, b, c, (sum(w) OVER (PARTITION BY a) / sum(w) OVER () + sum(w) OVER (PARTITION BY b) / sum(w) OVER ()
  + sum(w) OVER (PARTITION BY c) / sum(w) OVER ()) / 3 AS density FROM t),
s0 AS (SELECT a, b, c FROM den ORDER BY density DESC, a, b, c LIMIT 1),
g0 AS (SELECT den.*, (CASE WHEN den.a <> s0.a THEN 1 ELSE 0 END + CASE WHEN den.b <> s0.b THEN 1 ELSE 0 END + CASE WHEN den.c <> s0.c THEN 1 ELSE 0 END) AS g FROM den, s0),
s1 AS (SELECT a, b, c FROM g0 WHERE g > 0 ORDER BY g * density DESC, a, b, c LIMIT 1),
g1 AS (SELECT g0.a, g0.b, g0.c, density, least(g, CASE WHEN g0.a <> s1.a THEN 1 ELSE 0 END + CASE WHEN g0.b <> s1.b THEN 1 ELSE 0 END + CASE WHEN g0.c <> s1.c THEN 1 ELSE 0 END) AS g FROM g0, s1),
s2 AS (SELECT a, b, c FROM g1 WHERE g > 0 ORDER BY g * density DESC, a, b, c LIMIT 1)
SELECT seed, a AS c_mktsegment, b AS o_orderstatus, c AS n_name FROM (
  SELECT 0 AS seed, * FROM s0 UNION ALL SELECT 1, * FROM s1 UNION ALL SELECT 2, * FROM s2)""")
def c06(spark, sf):
    features = FeatureSet([], CATS)
    dense = prototypes.with_density(collapse(base_rows(spark, sf), CATS), features)
    seeds = prototypes.cao_seeds(dense, features, 3)
    return spark.createDataFrame([(i, *[s[c] for c in CATS]) for i, s in enumerate(seeds)],
                                 "seed int, c_mktsegment string, o_orderstatus string, n_name string")


# --- profiles ----------------------------------------------------------------

PROFILE_SQL = f"""
WITH {LABELLED_SQL}, q AS (SELECT quantile_cont(salary_avg, 0.3) AS q30, quantile_cont(salary_avg, 0.7) AS q70 FROM l),
{SKILLS_SQL.format(src='l')},
u AS (SELECT cluster, count(*) AS n, avg(salary_avg) AS pay, quantile_cont(salary_avg, 0.5) AS med, avg(min_experience_years) AS years,
  100.0 * count(*) FILTER (coalesce(contains(lower(schedule_name), 'удален'), FALSE)) / count(*) AS remote FROM l GROUP BY 1),
ti AS (SELECT cluster, string_agg(name, ' / ' ORDER BY c DESC, name) AS titles FROM (
  SELECT cluster, name, count(*) AS c FROM l GROUP BY 1, 2) JOIN u USING (cluster) WHERE c * 1.0 / n >= 0.3 GROUP BY 1),
mo AS (SELECT cluster, max(value) FILTER (feature = 's') AS s, max(value) FILTER (feature = 'a') AS a FROM (
  SELECT *, row_number() OVER (PARTITION BY cluster, feature ORDER BY c DESC, value) AS rn FROM (
    SELECT cluster, 's' AS feature, schedule_name AS value, count(*) AS c FROM l WHERE schedule_name IS NOT NULL GROUP BY ALL
    UNION ALL SELECT cluster, 'a', area_name, count(*) FROM l GROUP BY ALL)) WHERE rn = 1 GROUP BY 1),
e AS (SELECT *, CASE WHEN med > q70 THEN '🤑 Высокая ЗП' WHEN med > q30 THEN '💵 Нормальная ЗП' ELSE '📉 Маленькая ЗП' END AS tag
  FROM u JOIN mo USING (cluster) JOIN s5 USING (cluster) LEFT JOIN ti USING (cluster), q)"""


@query("c11_cluster_profiles", PROFILE_SQL + """
SELECT cluster + 1 AS id, coalesce(titles, 'Группа #' || (cluster + 1)) || ' (' || tag || ')' AS title,
  s || ', ' || a || ', Опыт ~' || printf('%.1f', years) || ' г.' AS description, n AS vacancies_count, round(pay, 4) AS mean_salary,
  replace(format('{:,}', CAST(trunc(pay) AS BIGINT)), ',', ' ') || ' ₽' AS avg_salary, skills, round(remote, 6) AS remote_rate FROM e""")
def c11(spark, sf):
    found = profile.profiles(labelled(spark, sf), GIVEN, ["salary_avg", "min_experience_years"], ["schedule_name", "area_name"])
    return found.withColumns({"skills": F.array_join("skills", "|"), "mean_salary": r("mean_salary"),
                              "remote_rate": r("remote_rate", 6)})


@query("c12_salary_tags", PROFILE_SQL + " SELECT cluster, tag AS salary_tag FROM e")
def c12(spark, sf):
    rows = labelled(spark, sf)
    return profile.salary_tags(rows, profile.salaries(rows)).select(CLUSTER, "salary_tag")


# --- fits and sweeps ----------------------------------------------------------

def _runs(found):
    return found.runs.withColumn("silhouette_score", r("silhouette_score", 6))


@query("c01_dispatch_by_types")
def c01(spark, sf):
    """Method chosen for numeric, categorical and mixed selections."""
    frame = _frame(spark, sf)
    found = [W.sweep(frame, picked, range(2, 4)) for picked in
             (["min_experience_years"], ["schedule_name", "area_name"], ["salary_avg", "schedule_name"])]
    out = found[0].summary()
    for f in found[1:]:
        out = out.union(f.summary())
    return out.withColumn("silhouette_score", r("silhouette_score", 6))


def _frame(spark, sf):
    """The analysis columns."""
    return cleaned(spark, sf)


@query("c02_sweep_mixed")
def c02(spark, sf):
    """2 to 12 clusters, the default."""
    return _runs(W.sweep(_frame(spark, sf), ["Зарплата", "График работы"]))


@query("c03_kmeans_sizes")
def c03(spark, sf):
    frame = _frame(spark, sf)
    found = W.sweep(frame, ["salary_avg", "min_experience_years"])
    return profile.sizes(found.label(frame), found.best.k)


@query("c03_features_in_any_order", "SELECT true AS same, CAST(2 AS BIGINT) AS runs")
def c03_order(spark, sf):
    """Two numeric features, each first once, over unrounded pay: the same scores."""
    scores = [W.sweep(_frame(spark, sf), pair, [3], restarts=1, final_restarts=1).runs.select(r("silhouette_score", 6).alias("s"))
              for pair in (["salary_avg", "min_experience_years"], ["min_experience_years", "salary_avg"])]
    both = scores[0].union(scores[1])
    return both.agg((F.count_distinct("s") == 1).alias("same"), F.count("s").alias("runs"))


MISS_SQL = "(CASE WHEN {0}.a <> {1}.a THEN 1 ELSE 0 END + CASE WHEN {0}.b <> {1}.b THEN 1 ELSE 0 END)"


def _cao_sql(k: int) -> list[str]:
    """Distinct tuples of schedule and area, and their k seeds."""
    parts = ["""t AS MATERIALIZED (SELECT schedule_name AS a, area_name AS b, count(*) AS w FROM p
      WHERE schedule_name IS NOT NULL AND area_name IS NOT NULL GROUP BY ALL)""",
             """g0 AS MATERIALIZED (SELECT a, b, (sum(w) OVER (PARTITION BY a) / sum(w) OVER ()
      + sum(w) OVER (PARTITION BY b) / sum(w) OVER ()) / 2 AS density, CAST(99 AS BIGINT) AS gap FROM t)""",
             "s0 AS MATERIALIZED (SELECT a, b FROM g0 ORDER BY density DESC, a, b LIMIT 1)"]
    for i in range(1, k):
        parts += [f"g{i} AS MATERIALIZED (SELECT g.a, g.b, density, least(gap, {MISS_SQL.format('g', 's')}) AS gap FROM g{i - 1} g, s{i - 1} s)",
                  f"s{i} AS MATERIALIZED (SELECT a, b FROM g{i} WHERE gap > 0 ORDER BY gap * density DESC, a, b LIMIT 1)"]
    return parts


def _modes_sql(k: int, steps: int, at: str = "") -> list[str]:
    """`steps` reassignments from the first k seeds, unrolled; later steps repeat a converged result."""
    parts = [f"m{at}0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS cid, a, b FROM s{i}" for i in range(k)) + ")"]
    for n in range(1, steps + 1):
        m, near = f"m{at}{n - 1}", f"near{at}{n}"
        parts += [f"""{near} AS MATERIALIZED (SELECT a, b, w, cid FROM (SELECT t.a, t.b, t.w, m.cid,
          row_number() OVER (PARTITION BY t.a, t.b ORDER BY {MISS_SQL.format('t', 'm')}, m.cid) AS rn FROM t, {m} m) WHERE rn = 1)""",
                  *[f"""{c}{at}{n}x AS (SELECT cid, {c} AS v FROM (SELECT cid, {c}, row_number() OVER (PARTITION BY cid ORDER BY sum(w) DESC, {c}) AS rn
          FROM {near} GROUP BY cid, {c}) WHERE rn = 1)""" for c in "ab"],
                  f"""m{at}{n} AS MATERIALIZED (SELECT m.cid, coalesce(x.v, m.a) AS a, coalesce(y.v, m.b) AS b
          FROM {m} m LEFT JOIN a{at}{n}x x USING (cid) LEFT JOIN b{at}{n}x y USING (cid))"""]
    return parts


def _kmodes_sql(k: int, steps: int) -> str:
    return ("WITH " + ", ".join(_cao_sql(k) + _modes_sql(k, steps)) + f" SELECT CAST(cid AS INTEGER) AS cluster, a AS schedule_name, b AS area_name,"
            f" (SELECT CAST(sum(w) AS BIGINT) FROM near{steps} z WHERE z.cid = m.cid) AS size FROM m{steps} m")


def _kmodes_sweep_sql(ks: range, steps: int) -> str:
    """Every k fitted, and the Hamming silhouette of its labels from counts of all pairs of tuples."""
    parts = _cao_sql(max(ks))
    for k in ks:
        parts += _modes_sql(k, steps, f"{k}_")
    parts += ["fits AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {k} AS k, a, b, w, cid FROM near{k}_{steps}" for k in ks) + ")",
              f"""d AS (SELECT x.k, x.a, x.b, x.w, x.cid, y.cid AS other, sum(y.w * {MISS_SQL.format('x', 'y')}) / 2.0 AS total, sum(y.w) AS n
      FROM fits x JOIN fits y ON x.k = y.k GROUP BY ALL)""",
              """i AS (SELECT k, a, b, w, max(total / nullif(n - 1, 0)) FILTER (other = cid) AS inner_mean, min(total / n) FILTER (other <> cid) AS outer_mean
      FROM d GROUP BY k, a, b, w, cid)""",
              """sc AS (SELECT k, round(sum(w * coalesce((outer_mean - inner_mean) / nullif(greatest(inner_mean, outer_mean), 0), 0)) / sum(w), 6) AS score,
      FROM i GROUP BY k)""",
              f"co AS (SELECT f.k, sum(f.w * {MISS_SQL.format('f', 'm')}) AS cost FROM fits f JOIN (" + " UNION ALL ".join(
                  f"SELECT {k} AS k, * FROM m{k}_{steps}" for k in ks) + ") m ON f.k = m.k AND f.cid = m.cid GROUP BY 1)"]
    return "WITH " + ", ".join(parts)


# The supplied tables settle in two or three steps; the query reports how many it took.
KMODES_SWEEP_SQL = _kmodes_sweep_sql(range(2, 13), 5)


@query("c04_kmodes_sweep", KMODES_SWEEP_SQL + """
SELECT 'K-Modes' AS method_name, CAST(k AS INTEGER) AS k, score AS silhouette_score, CAST(cost AS DOUBLE) AS cost FROM sc JOIN co USING (k)""")
def c04_sweep(spark, sf):
    """2 to 12 clusters of schedule and area."""
    return _runs(W.sweep(_frame(spark, sf), ["schedule_name", "area_name"])).select("method_name", "k", "silhouette_score", "cost")


@query("c13_run_summary", KMODES_SWEEP_SQL + """
SELECT 'K-Modes' AS method_name, CAST(k AS INTEGER) AS n_clusters, score AS silhouette_score FROM sc ORDER BY score DESC, k LIMIT 1""")
def c13(spark, sf):
    found = W.sweep(_frame(spark, sf), ["schedule_name", "area_name"])
    return found.summary().withColumn("silhouette_score", r("silhouette_score", 6))


@query("c04_kmodes_centroids", _kmodes_sql(4, 8))
def c04(spark, sf):
    """A whole fit: seeds, iterations until the cost stops falling, rows per cluster."""
    frame = _frame(spark, sf)
    features = measure(frame, FeatureSet([], ["schedule_name", "area_name"]))
    data = methods.Data.of(frame, features)
    fit = methods.KModes().fit(data, [(4, 0)])[4, 0]
    counts = scoring.cluster_sizes(data.labelled([fit]), [4])[0]
    return spark.createDataFrame(
        [(i, c["schedule_name"], c["area_name"], counts[i] or None) for i, c in enumerate(fit.centroids)],
        "cluster int, schedule_name string, area_name string, size bigint")


def _kprototypes_sql(k: int, steps: int) -> str:
    """The same for scaled pay and schedule, with squared distance plus half a mismatch."""
    gap = "(({0}.x - {1}.x) * ({0}.x - {1}.x) + CASE WHEN {0}.b <> {1}.b THEN 0.5 ELSE 0 END)"
    parts = ["kept AS (SELECT salary_avg AS pay, schedule_name AS b FROM p WHERE salary_avg IS NOT NULL AND schedule_name IS NOT NULL)",
             """t AS MATERIALIZED (SELECT (pay - (SELECT avg(pay) FROM kept)) / (SELECT stddev_pop(pay) FROM kept) AS x, b, count(*) AS w
      FROM kept GROUP BY ALL)""",
             """g0 AS MATERIALIZED (SELECT x, b, sum(w) OVER (PARTITION BY b) / sum(w) OVER () AS density, CAST(1e300 AS DOUBLE) AS gap FROM t)""",
             "s0 AS MATERIALIZED (SELECT x, b FROM g0 ORDER BY density DESC, abs(x), b, x LIMIT 1)"]
    for i in range(1, k):
        parts += [f"g{i} AS MATERIALIZED (SELECT g.x, g.b, density, least(gap, {gap.format('g', 's')}) AS gap FROM g{i - 1} g, s{i - 1} s)",
                  f"s{i} AS MATERIALIZED (SELECT x, b FROM g{i} WHERE gap > 0 ORDER BY gap * density DESC, abs(x), b, x LIMIT 1)"]
    parts.append("m0 AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT {i} AS cid, x, b FROM s{i}" for i in range(k)) + ")")
    for n in range(1, steps + 1):
        parts += [f"""near{n} AS MATERIALIZED (SELECT x, b, w, cid FROM (SELECT t.x, t.b, t.w, m.cid,
          row_number() OVER (PARTITION BY t.x, t.b ORDER BY {gap.format('t', 'm')}, m.cid) AS rn FROM t, m{n - 1} m) WHERE rn = 1)""",
                  f"x{n} AS (SELECT cid, sum(x * w) / sum(w) AS v FROM near{n} GROUP BY cid)",
                  f"""b{n} AS (SELECT cid, b AS v FROM (SELECT cid, b, row_number() OVER (PARTITION BY cid ORDER BY sum(w) DESC, b) AS rn
          FROM near{n} GROUP BY cid, b) WHERE rn = 1)""",
                  f"""m{n} AS MATERIALIZED (SELECT m.cid, coalesce(x.v, m.x) AS x, coalesce(y.v, m.b) AS b
          FROM m{n - 1} m LEFT JOIN x{n} x USING (cid) LEFT JOIN b{n} y USING (cid))"""]
    return ("WITH " + ", ".join(parts) + f" SELECT CAST(cid AS INTEGER) AS cluster, round(x, 6) AS salary_avg, b AS schedule_name FROM m{steps}")


@query("c05_kprototypes_centroids", _kprototypes_sql(3, 80))
def c05(spark, sf):
    frame = _frame(spark, sf)
    features = measure(frame, FeatureSet(["salary_avg"], ["schedule_name"]))
    fit = methods.KPrototypes().fit(methods.Data.of(frame, features), [(3, 0)])[3, 0]
    return spark.createDataFrame(
        [(i, round(c["salary_avg"], 6), c["schedule_name"]) for i, c in enumerate(fit.centroids)],
        "cluster int, salary_avg double, schedule_name string")


@query("c14_pinned_sweep")
def c14(spark, sf):
    """All scores of a sweep, then sizes of a pinned k whatever its score."""
    frame = _frame(spark, sf)
    found = W.sweep(frame, ["salary_avg", "name"], range(2, 20), final_restarts=5, pin=16)
    return profile.sizes(found.label(frame), 16)


@query("k04_best_labelling", f"""
WITH {FEATURES_SQL}, sc AS (SELECT 2 + (k % 3) AS labelling, round(sum(pay), 2) AS score FROM f GROUP BY 1)
SELECT labelling AS k, score FROM sc ORDER BY score DESC, k LIMIT 1""")
def k04(spark, sf):
    """Arg-max, the lowest k on a tie."""
    scores = base_rows(spark, sf).groupBy((F.col("k") % 3 + 2).alias("k")).agg(r(F.sum("pay"), 2).alias("silhouette_score"))
    return W.best_k(scores).select("k", F.col("silhouette_score").alias("score"))
