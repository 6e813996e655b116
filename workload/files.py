"""Landed files, snapshots and whole jobs (S, L, incremental ingest)."""

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.clustering import profile
from jobgrain.fixed_values import ANALYST_ROLE_IDS
from jobgrain.operators.scale import scratch_path
from jobgrain.plans import jobs
from jobgrain.schema import POSTING_CORE
from jobgrain.sources import postings as io
from jobgrain.streaming.ingest import ingest_available, ingest_new, new_postings
from workload.filtering import EXCLUDE, INCLUDE
from workload.registry import query, r
from workload.statistics import KEPT, REPORT_SQL
from workload.tables import KEYED, as_of, keyed_rows, postings_of, raw_postings, table

FIELDS = [f.name for f in POSTING_CORE.fields]

ROUND_TRIP_SQL = """SELECT id, name, salary_from, salary_currency, experience_id, address_raw,
  array_to_string(skills_list, '|') AS skills, CAST(roles[1] AS VARCHAR) AS first_role FROM p"""


def _flat(df):
    return df.select(
        "id", "name", F.col("salary.from").alias("salary_from"), F.col("salary.currency").alias("salary_currency"),
        F.col("experience.id").alias("experience_id"), F.col("address.raw").alias("address_raw"),
        F.coalesce(F.array_join("key_skills.name", "|"), F.lit("")).alias("skills"),
        F.get("professional_roles.id", F.lit(0)).alias("first_role"))


@query("s01_json_lines_of_arrays", ROUND_TRIP_SQL)
def s01(spark, sf):
    """Landed JSON whose lines are arrays of up to 100 postings."""
    path = scratch_path(spark, "landed")
    rows = raw_postings(spark, sf)
    pages = rows.groupBy(F.floor(F.col("k") / 100)).agg(F.collect_list(F.struct(*FIELDS)).alias("items"))
    pages.select(F.to_json("items")).write.text(path)
    return _flat(io.read_postings(spark, path))


@query("s01_json_array_files", """
SELECT CAST(event_id AS VARCHAR) AS id, event_type AS name FROM events""", postings=False)
def s01_files(spark, sf):
    """Whole-file arrays, one file per 1,000 records."""
    path = scratch_path(spark, "arrays")
    item = F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name"))
    pages = table(spark, sf, "events").groupBy(F.floor(F.col("event_id") / 1000)).agg(F.collect_list(item).alias("items"))
    body = F.concat(F.lit("["), F.array_join(F.transform("items", lambda i: F.to_json(i)), ",\n "), F.lit("]"))
    pages.select(body).write.option("maxRecordsPerFile", 1).text(path)
    return io.read_postings(spark, path, POSTING_CORE, whole_array=True).select("id", "name")


def _write_one_array(lines, path):
    """One file with one array of the records in `line`. All tasks make the lines; one strings them together and holds none."""
    lines = jobs.staged(lines)
    count = lines.count()
    one = lines.coalesce(1).withColumn("at", F.monotonically_increasing_id())  # 0, 1, ... in a single partition
    one.select(F.concat(F.when(F.col("at") == 0, "[").otherwise(""), "line", F.when(F.col("at") == count - 1, "]").otherwise(","))).write.text(path)


@query("s01_json_array_in_splits", ROUND_TRIP_SQL)
def s01_splits(spark, sf):
    """All postings as one array in one file, read in splits."""
    path = scratch_path(spark, "one_array")
    _write_one_array(raw_postings(spark, sf).select(F.to_json(F.struct(*FIELDS)).alias("line")), path)
    return _flat(io.read_postings(spark, path, POSTING_CORE, whole_array="split"))


@query("s02_stringified_cells", ROUND_TRIP_SQL)
def s02(spark, sf):
    """Records whose nested values arrive as JSON text inside a string."""
    path = scratch_path(spark, "stringified")
    rows = raw_postings(spark, sf).select(FIELDS)
    nested = (T.StructType, T.ArrayType)
    rows.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name)
                  for f in POSTING_CORE.fields]).write.json(path)
    return _flat(io.read_postings_as_text(spark, path))


@query("s03_json_snapshots", """
SELECT CAST(k % 2 AS VARCHAR) AS snapshot, count(*) AS n, count(salary_from) AS paid FROM p GROUP BY 1""")
def s03(spark, sf):
    path = scratch_path(spark, "raw")
    rows = raw_postings(spark, sf)
    for snapshot in (0, 1):
        io.write_postings(rows.where(F.col("k") % 2 == snapshot).select(FIELDS), path, f"s{snapshot}")
    schema = T.StructType([*POSTING_CORE.fields, T.StructField(io.SNAPSHOT, T.StringType())])
    back = io.read_postings(spark, path, schema)
    return back.groupBy(F.substring(io.SNAPSHOT, 2, 1).alias("snapshot")).agg(
        F.count(F.lit(1)).alias("n"), F.count("salary.from").alias("paid"))


@query("s04_clean_parquet", """
SELECT id, salary_avg, array_to_string(skills_list, '|') AS skills, 's1' AS snapshot_ts FROM p""")
def s04(spark, sf):
    path = scratch_path(spark, "clean")
    io.write_clean(jobs.clean_table(raw_postings(spark, sf), as_of()), path, "s1")
    return spark.read.parquet(path).select("id", "salary_avg", F.array_join("skills_list", "|").alias("skills"), io.SNAPSHOT)


@query("s04_csv_export", """
SELECT id, salary_avg, CAST(len(skills_list) AS INTEGER) AS skills FROM p""")
def s04_csv(spark, sf):
    """CSV with lists as JSON text, read back."""
    path = scratch_path(spark, "csv")
    io.export_csv(jobs.clean_table(raw_postings(spark, sf), as_of()).select("id", "salary_avg", "skills_list"), path)
    back = spark.read.schema("id string, salary_avg double, skills_list string").option("header", True).option("escape", "\\").csv(path)
    return back.select("id", "salary_avg", F.size(F.from_json("skills_list", T.ArrayType(T.StringType()))).alias("skills"))


@query("s05_newest_snapshot", """
SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders WHERE o_orderkey % 3 = 2""", postings=False)
def s05(spark, sf):
    path = scratch_path(spark, "snapshots")
    orders = table(spark, sf, "orders").withColumn(io.SNAPSHOT, F.concat(F.lit("2026010"), F.col("o_orderkey") % 3))
    orders.write.partitionBy(io.SNAPSHOT).parquet(path)
    newest = io.read_newest_snapshot(spark, path)
    return newest.select("o_orderkey", r("o_totalprice", 2).alias("price"))


PAGES_SQL = """pg AS (SELECT event_id // 100 AS page, event_id // 100 // 10 AS batch, event_id, user_id,
  (event_id // 100) % 13 = 5 AS empty FROM events)"""


def _event_pages(spark, sf):
    """Pages of 100 events; every thirteenth is empty."""
    events = table(spark, sf, "events")
    item = F.struct(F.col("event_id").cast("string").alias("id"),
                    F.array(F.struct((F.col("user_id") % 170).cast("string").alias("id"))).alias("professional_roles"))
    pages = events.groupBy(F.floor(F.col("event_id") / 100).alias("page")).agg(F.collect_list(item).alias("items"))
    return pages.select("page", F.floor(F.col("page") / 10).alias("batch"),
                        F.when(F.col("page") % 13 != 5, F.col("items")).alias("items"))


ROLES = ", ".join(ANALYST_ROLE_IDS)


@query("s06_page_ingest", f"""
WITH {PAGES_SQL} SELECT page, CAST(event_id AS VARCHAR) AS id FROM pg WHERE NOT empty AND user_id % 170 IN ({ROLES})""", postings=False)
def s06(spark, sf):
    return io.postings_of_pages(_event_pages(spark, sf)).select("page", "id")


@query("f11_empty_page_stop", f"""
WITH {PAGES_SQL}, st AS (SELECT batch, min(page) AS stop FROM pg WHERE empty GROUP BY 1)
SELECT page, CAST(event_id AS VARCHAR) AS id FROM pg LEFT JOIN st USING (batch) WHERE stop IS NULL OR page < stop""", postings=False)
def f11(spark, sf):
    pages = io.until_empty_page(_event_pages(spark, sf), "batch", "page")
    return io.postings_of_pages(pages, roles=None).select("page", "id")


@query("s08_role_catalogue", """
SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name FROM nation WHERE contains(lower(n_name), 'nation_2')""", postings=False)
def s08(spark, sf):
    """A nested catalogue: one category per region, its nations as roles."""
    path = scratch_path(spark, "catalogue")
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    role = F.struct(F.col("n_nationkey").cast("string").alias("id"), F.col("n_name").alias("name"))
    categories = (nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_regionkey", "r_name")
                  .agg(F.collect_list(role).alias("roles")))
    category = F.struct(F.col("r_regionkey").cast("string").alias("id"), F.col("r_name").alias("name"), "roles")
    categories.select(F.array(category).alias("categories")).write.json(path)
    return io.catalogue_roles(io.read_catalogue(spark, path, whole_document=False), "nation_2")


@query("s09_run_report", f"""
WITH kept AS (SELECT * FROM {KEPT})
SELECT * FROM (SELECT id, name || ' (' || CASE WHEN salary_currency IS NULL THEN 'none' ELSE
  coalesce(CAST(CAST(salary_from AS BIGINT) AS VARCHAR), 'None') || '-' || coalesce(CAST(CAST(salary_to AS BIGINT) AS VARCHAR), 'None') END || ')' AS line
  FROM kept ORDER BY k LIMIT 10)
UNION ALL SELECT 'raw_count', CAST(count(*) AS VARCHAR) FROM p UNION ALL SELECT 'kept_count', CAST(count(*) AS VARCHAR) FROM kept""")
def s09(spark, sf):
    before, n_before = jobs.observed(raw_postings(spark, sf), "before")
    after, n_after = jobs.observed(jobs.relevant(before, ["k"], INCLUDE, EXCLUDE), "after")
    path = scratch_path(spark, "kept")
    after.write.parquet(path)
    metrics, sample = io.run_report(n_before.get["n"], spark.read.parquet(path), n_after.get["n"], 0.0, ["k"])
    counts = metrics.select(F.inline(F.array(*[F.struct(F.lit(c).alias("id"), F.col(c).cast("string").alias("line"))
                                               for c in ("raw_count", "kept_count")])))
    return sample.unionByName(counts)


@query("l01_filter_job", f"""
WITH kept AS (SELECT * FROM {KEPT}) SELECT id, name, (SELECT count(*) FROM p) AS n_before, (SELECT count(*) FROM kept) AS n_after FROM kept""")
def l01(spark, sf):
    path = scratch_path(spark, "relevant")
    before, after = jobs.filter_job(raw_postings(spark, sf), path, "s1", ["k"], include=INCLUDE, exclude=EXCLUDE)
    return io.read_postings(spark, path).select("id", "name", F.lit(before).cast("bigint").alias("n_before"),
                                                F.lit(after).cast("bigint").alias("n_after"))


@query("l02_clean_job", REPORT_SQL)
def l02(spark, sf):
    stats = jobs.clean_job(raw_postings(spark, sf), scratch_path(spark, "cleaned"), "s1", as_of=as_of())
    return stats.withColumns({"value": r("value"), "pct": r("pct")})


def _landed_pages(spark, sf):
    """Pages of at most 100 postings in three batches; each fifth posting also lands in the next batch."""
    own = (F.col("k") % 3).cast("int")
    placed = keyed_rows(spark, sf).select(*KEYED, F.floor(F.col("k") / 100).cast("int").alias("page"),
                                          F.explode(F.array_compact(F.array(own, F.when(F.col("k") % 5 == 0, own + 1)))).alias("batch"))
    # The flat rows are shuffled, some ten times smaller than the postings made from them.
    pages = placed.groupBy("batch", "page").agg(F.collect_list(F.struct(*KEYED)).alias("items"))
    return pages.select("batch", "page", postings_of("items").alias("items"))


@query("l01_filter_job_twice", f"SELECT count(*) AS n, 2 AS runs FROM {KEPT}")
def l01_twice(spark, sf):
    """A second run of one snapshot replaces the first."""
    path = scratch_path(spark, "relevant")
    for _ in range(2):
        jobs.filter_job(raw_postings(spark, sf), path, "s1", ["k"], include=INCLUDE, exclude=EXCLUDE)
    return io.read_postings(spark, path).agg(F.count(F.lit(1)).alias("n")).withColumn("runs", F.lit(2))


@query("l02_clean_job_without_outliers", """
WITH q AS (SELECT quantile_cont(salary_avg, 0.25) AS a, quantile_cont(salary_avg, 0.75) AS b FROM p WHERE salary_avg IS NOT NULL),
kept AS (SELECT p.* FROM p, q WHERE salary_avg IS NULL OR salary_avg BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a))
SELECT count(*) AS n, count(salary_avg) AS paid, (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT 'skill_' || lower(replace(replace(s, ' ', '_'), '/', '_')) AS s
   FROM (SELECT unnest(skills_list) AS s FROM p) GROUP BY s ORDER BY count(*) DESC, s LIMIT 15)) AS skills FROM kept""")
def l02_outliers(spark, sf):
    """Skill columns come from all postings, rows without the outliers."""
    path = scratch_path(spark, "cleaned")
    jobs.clean_job(raw_postings(spark, sf), path, "s1", as_of=as_of(), remove_outliers=True)
    written = io.read_newest_snapshot(spark, path)
    skills = ",".join(sorted(c for c in written.columns if c.startswith("skill_")))
    return written.agg(F.count(F.lit(1)).alias("n"), F.count("salary_avg").alias("paid")).withColumn("skills", F.lit(skills))


@query("s01_corrupt_records", """
SELECT count(*) FILTER (WHERE event_id % 7 = 3) AS corrupt, count(*) FILTER (WHERE event_id % 7 <> 3) AS good FROM events""", postings=False)
def s01_corrupt(spark, sf):
    """Every seventh line broken off: reported, not lost."""
    path = scratch_path(spark, "broken")
    line = F.to_json(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("name")))
    table(spark, sf, "events").select(F.when(F.col("event_id") % 7 == 3, F.substring(line, F.lit(1), F.length(line) - 1)).otherwise(line)).write.text(path)
    rows = io.read_postings(spark, path, POSTING_CORE, malformed="keep")
    return rows.agg(F.count(io.CORRUPT).alias("corrupt"), F.count("id").alias("good"))


@query("p01_bad_cells", """
SELECT 'salary' AS cell, count(*) FILTER (WHERE o_orderkey % 5 = 1) AS n FROM orders""", postings=False)
def p01_bad(spark, sf):
    """Unreadable cells are named in the clean table."""
    key = F.col("o_orderkey")
    raw = table(spark, sf, "orders").select(
        key.cast("string").alias("id"), *[F.lit(None).cast("string").alias(f.name) for f in POSTING_CORE.fields if f.name not in ("id", "salary")],
        F.when(key % 5 == 1, "{'from': 1,").otherwise("{'from': 1, 'to': 2}").alias("salary"))
    out = jobs.clean_table(raw, as_of())
    return out.select(F.explode("_bad_cells").alias("cell")).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))


@query("k03_newest_file", "SELECT o_orderkey FROM orders WHERE o_orderkey % 3 = 2", postings=False)
def k03(spark, sf):
    """Three files, the last written is read."""
    path = scratch_path(spark, "files")
    for i in range(3):
        table(spark, sf, "orders").where(f"o_orderkey % 3 = {i}").select("o_orderkey").coalesce(1).write.mode("append").parquet(path)
        time.sleep(0.02)  # file systems with coarse clocks
    return io.latest_file(spark, path)


@query("l03_collect_job", f"SELECT id, CAST(k % 3 AS INTEGER) AS batch FROM p WHERE list_has_any(roles, [{ROLES}])")
def l03(spark, sf):
    return jobs.collect(jobs.staged(_landed_pages(spark, sf)), dedupe_within=True).select("id", "batch")


@query("l04_analyse_job")
def l04(spark, sf):
    """Newest snapshot to cluster profiles, by work schedule and area."""
    path = scratch_path(spark, "clean")
    clean = jobs.clean_table(raw_postings(spark, sf), as_of())
    for snapshot in ("s0", "s1"):
        io.write_clean(clean.where("area_name <> 'NATION_0'") if snapshot == "s0" else clean, path, snapshot)
    found = jobs.analyse_newest(spark, path, ["График работы", "Местность"])
    return found.profiles.withColumns({"skills": F.array_join("skills", "|"), "mean_salary": r("mean_salary"),
                                       "remote_rate": r("remote_rate", 6)})


@query("l05_end_to_end", f"""
WITH kept AS (SELECT * FROM {KEPT} AND list_has_any(roles, [{ROLES}]))
SELECT 'raw_count' AS "key", CAST(count(*) AS DOUBLE) AS value FROM p WHERE list_has_any(roles, [{ROLES}])
UNION ALL SELECT 'kept_count', count(*) FROM kept
UNION ALL SELECT 'with_salary', count(*) FILTER (has_salary) FROM kept
UNION ALL SELECT 'mean', round(avg(salary_avg), 4) FROM kept
UNION ALL SELECT 'median', round(quantile_cont(salary_avg, 0.5), 4) FROM kept
UNION ALL SELECT 'mean_skills', round(avg(len(skills_list)), 4) FROM kept""")
def l05(spark, sf):
    pages, out = scratch_path(spark, "pages"), scratch_path(spark, "run")
    _landed_pages(spark, sf).write.option("compression", "gzip").json(pages)
    metrics, _, stats = jobs.run_all(spark, pages, out, "s1", as_of(), INCLUDE, EXCLUDE)
    counts = metrics.select(F.inline(F.array(*[F.struct(F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
                                               for c in ("raw_count", "kept_count")])))
    picked = stats.where(F.col("key").isin("with_salary", "mean", "median", "mean_skills")).select("key", r("value").alias("value"))
    return counts.unionByName(picked)


@query("incremental_ingest", "SELECT id, name FROM p")
def incremental(spark, sf):
    """Two landings with overlap through the stream; every id passes once."""
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "ingested", "state"))
    rows = raw_postings(spark, sf).select(FIELDS)
    for half in (rows.where("id % 3 <> 0"), rows.where("id % 3 <> 1")):
        # Files that are not split, so none is large.
        half.write.mode("append").option("compression", "gzip").option("maxRecordsPerFile", 200_000).json(landing)
        ingest_available(new_postings(spark, landing), out, state).awaitTermination()
    return spark.read.parquet(out).select("id", "name")


@query("incremental_ingest_of_batches", """
WITH l AS (SELECT l_orderkey AS id, l_linenumber AS n, l_orderkey % 3 AS first FROM lineitem)
SELECT CAST(id AS VARCHAR) AS id, first AS batch, count(*) AS n FROM l GROUP BY 1, 2""", postings=False)
def incremental_batches(spark, sf):
    """Three landings; every line also lands in the next one, where its order is known. Repeats of an order in a landing stay."""
    landing, out, state = (scratch_path(spark, n) for n in ("landing", "published", "state"))
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("id"), F.col("l_orderkey") % 3)
    for i in range(3):
        lines.where((F.col("(l_orderkey % 3)") == i) | (F.col("(l_orderkey % 3)") == i - 1)).select("id").write.mode("append").json(landing)
        ingest_new(spark, landing, out, state, schema="id string").awaitTermination()
    return spark.read.parquet(out).groupBy("id", F.col("batch_id").cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n"))


@query("c11_profile_of_one_group", """
SELECT CAST(1 AS INTEGER) AS id, count(*) AS vacancies_count, round(avg(salary_avg), 4) AS mean_salary FROM p""")
def one_group(spark, sf):
    """All postings as one cluster."""
    rows = jobs.clean_table(raw_postings(spark, sf), as_of()).withColumn("cluster", (F.length("id") % 1).cast("int"))
    return profile.profiles(rows, 1, [], []).select("id", "vacancies_count", r("mean_salary").alias("mean_salary"))
