"""Projections."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain import fixed_values as V
from jobgrain.clustering.features import FeatureSet, resolve
from jobgrain.functions import nested, numbers, text
from jobgrain.operators import clean, statistics
from jobgrain.operators.filters import is_remote
from jobgrain.plans.jobs import clean_table
from workload.registry import query, r
from workload.tables import as_of, raw_postings, table


def cleaned(spark, sf, **options):
    return clean_table(raw_postings(spark, sf), as_of(), **options)


def accessor(name: str, *columns: str):
    """A query over clean columns that need no rounding."""
    listed = ", ".join(columns)

    @query(name, f"SELECT id, {listed} FROM p")
    def run(spark, sf):
        return cleaned(spark, sf).select("id", *columns)


K = T.StructType([T.StructField("k", T.LongType())])


@query("p01_parse_nested_cells", """
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS plain_k,
       CAST(json_extract(props, '$.k') AS BIGINT) AS quoted_k,
       event_type AS kept_text, CAST(NULL AS VARCHAR) AS none_value, TRUE AS flag, TRUE AS broken_is_null
FROM events""", postings=False)
def p01(spark, sf):
    """The JSON cell, its single-quoted literal form, bare words, and a broken cell."""
    shape = T.StructType.fromDDL("k bigint, note string, none string, flag boolean")
    literal = F.concat(F.lit("{'k': "), F.get_json_object("props", "$.k"), F.lit(", 'note': 'None, True: "),
                       F.col("event_type"), F.lit("', 'none': None, 'flag': True}"))
    parsed = nested.parse_cell(literal, shape)
    broken = nested.parse_cell(F.concat(F.lit("{"), F.col("event_type"), F.lit("}")), K)
    return table(spark, sf, "events").select(
        "event_id", nested.parse_cell(F.col("props"), K)["k"].alias("plain_k"), parsed["k"].alias("quoted_k"),
        F.replace(parsed["note"], F.lit("None, True: "), F.lit("")).alias("kept_text"),
        parsed["none"].alias("none_value"), parsed["flag"].alias("flag"),
        (broken.isNull() | broken["k"].isNull()).alias("broken_is_null"))


@query("p02_strip", """
WITH t AS (SELECT doc_id, chr(9) || chr(160) || text || chr(10) || chr(8195) || ' ' AS padded FROM documents)
SELECT doc_id, length(padded) AS padded_length, md5(regexp_replace(padded,
  '^[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+|[\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+$',
  '', 'g')) AS stripped_md5
FROM t""", postings=False)
def p02(spark, sf):
    padded = F.concat(F.lit("\t "), F.col("text"), F.lit("\n  "))
    return table(spark, sf, "documents").select(
        "doc_id", F.length(padded).cast("bigint").alias("padded_length"), F.md5(text.strip(padded)).alias("stripped_md5"))


accessor("p03_salary_fields", "salary_from", "salary_to", "salary_currency")


@query("p04_numeric_coercion", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  CASE WHEN l_suppkey % 3 <> 0 THEN l_extendedprice END AS coerced FROM lineitem""", postings=False)
def p04(spark, sf):
    """Plain, blank-padded, suffixed and non-numeric texts of a price."""
    price = F.col("l_extendedprice").cast("string")
    dirty = (F.when(F.col("l_suppkey") % 3 == 1, F.concat(F.lit(" "), price, F.lit(" ")))
             .when(F.col("l_suppkey") % 3 == 2, price)
             .when(F.col("l_suppkey") % 2 == 0, F.concat(price, F.lit("d"))).otherwise(F.lit("n/a")))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", numbers.to_number(dirty).alias("coerced"))


accessor("p05_has_salary", "has_salary")
accessor("p06_salary_avg", "salary_avg")
accessor("p07_experience_fields", "experience_id", "experience_name")
accessor("p08_min_experience_years", "min_experience_years")
accessor("p09_avg_experience_years", "avg_experience_years")


@query("p10_published_at", "SELECT id, epoch_us(local_ts - INTERVAL 3 HOUR) AS published_micros FROM p")
def p10(spark, sf):
    return cleaned(spark, sf).select("id", F.unix_micros("published_at").alias("published_micros"))


@query("p11_published_date", "SELECT id, CAST(published_date AS VARCHAR) AS published_date FROM p")
def p11(spark, sf):
    return cleaned(spark, sf).select("id", F.col("published_date").cast("string"))


accessor("p12_published_year_month", "published_year_month")
accessor("p13_days_since_publication", "days_since_publication")
accessor("p14_employer", "employer_name", "employer_id")
accessor("p15_area", "area_name", "area_id")
accessor("p16_type", "type_id", "type_name")
accessor("p17_schedule", "schedule_id", "schedule_name")
accessor("p18_employment", "employment_id", "employment_name")
accessor("p19_employment_form", "employment_form_id", "employment_form_name")
accessor("p20_department", "department_id", "department_name")
accessor("p21_address", "address_city", "address_street", "address_building", "address_raw")
accessor("p22_snippet", "requirement", "responsibility")


@query("p23_main_role", """
SELECT id, CAST(roles[1] AS VARCHAR) AS main_role_id, 'role ' || roles[1] AS main_role_name FROM p""")
def p23(spark, sf):
    return cleaned(spark, sf).select("id", "main_role_id", "main_role_name")


accessor("p24_work_format", "work_format_name", "work_format_id")
accessor("p25_working_hours", "working_hours_name")
accessor("p26_work_schedule_by_days", "work_schedule_name")


@query("p28_skill_names", "SELECT id, array_to_string(skills_list, '|') AS skills FROM p")
def p28(spark, sf):
    return cleaned(spark, sf).select("id", F.array_join("skills_list", "|").alias("skills"))


@query("p29_skills_count", "SELECT id, CAST(len(skills_list) AS INTEGER) AS skills_count FROM p")
def p29(spark, sf):
    return cleaned(spark, sf).select("id", "skills_count")


SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]


@query("p30_skill_indicators", "SELECT id, " + ", ".join(
    f"CAST(list_contains(skills_list, '{s}') AS INTEGER) AS skill_{s.lower()}" for s in SEGMENTS) + " FROM p")
def p30(spark, sf):
    """Indicator columns of a given vocabulary."""
    wide = clean.skill_indicators(cleaned(spark, sf).select("id", "skills_list"), SEGMENTS)
    return wide.drop("skills_list")


@query("p30_skill_indicators_pivot", "SELECT id, " + ", ".join(
    f"CAST(list_contains(skills_list, '{s}') AS INTEGER) AS skill_{s.lower()}" for s in SEGMENTS) + " FROM p")
def p30_pivot(spark, sf):
    return clean.skill_indicators_pivot(cleaned(spark, sf).select("id", "skills_list"), SEGMENTS)


@query("p30_top_skill_indicators", """
WITH e AS (SELECT id, unnest(skills_list) AS skill FROM p),
v AS (SELECT skill FROM e GROUP BY skill ORDER BY count(*) DESC, skill LIMIT 15)
SELECT 'skill_' || lower(replace(replace(skill, ' ', '_'), '/', '_')) AS indicator,
       CAST(count(DISTINCT id) AS BIGINT) AS postings
FROM e JOIN v USING (skill) GROUP BY 1""")
def p30_top(spark, sf):
    """Sums of the indicators of the table's own 15 most frequent skills."""
    base = cleaned(spark, sf).select("id", "skills_list")
    wide = clean.skill_indicators(base, statistics.skill_vocabulary(base))
    names = [c for c in wide.columns if c.startswith("skill_")]
    sums = wide.agg(*[F.sum(c).alias(c) for c in names])
    return sums.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("indicator"), F.col(c).cast("bigint").alias("postings")) for c in names])))


FLAT = [
    "id", "name", "salary_from", "salary_to", "salary_currency", "has_salary", "salary_avg", "experience_id", "experience_name",
    "min_experience_years", "avg_experience_years", "published_at", "published_date", "published_year_month",
    "days_since_publication", "employer_id", "employer_name", "area_id", "area_name", "type_id", "type_name", "schedule_id",
    "schedule_name", "employment_id", "employment_name", "employment_form_id", "employment_form_name", "department_id",
    "department_name", "address_city", "address_street", "address_building", "address_raw", "requirement", "responsibility",
    "main_role_id", "main_role_name", "work_format_name", "work_format_id", "working_hours_name", "work_schedule_name",
    "skills_list", "skills_count"]


@query("p31_drop_raw_columns", f"""
SELECT unnest([{', '.join(f"'{c}'" for c in sorted(FLAT + ['k']))}]) AS column_name,
       (SELECT count(*) FROM orders) AS row_count""", postings=False)
def p31(spark, sf):
    """Column names left after dropping nested sources and service columns."""
    left = clean.drop_raw(cleaned(spark, sf, remove_json=False))
    return left.groupBy().agg(F.count(F.lit(1)).alias("row_count")).select(
        F.explode(F.array(*[F.lit(c) for c in sorted(left.columns)])).alias("column_name"), "row_count")


@query("p32_analysis_frame", """
SELECT id, CASE WHEN contains(lower(name), 'bi') AND NOT contains(lower(name), 'mobile') THEN 'BI Analyst' ELSE 'Other' END AS name,
  salary_avg, avg_experience_years, min_experience_years, requirement, responsibility, schedule_name,
  employment_name, employer_name, area_name, array_to_string(skills_list, '|') AS skills_list FROM p""")
def p32(spark, sf):
    return clean.analysis_frame(cleaned(spark, sf)).withColumn("skills_list", F.array_join("skills_list", "|"))


# (family, keyword, void when the text also holds one of these)
PART_RULES = [("Cold", "blue", ["blue ring", "blue bolt"]), ("Cold", "cold", []), ("Small parts", "bolt", []),
              ("Small parts", "ring", ["large"]), ("Hot", "red", [])]


@query("p33_title_family", """
SELECT p_partkey, CASE
  WHEN contains(lower(p_name), 'blue') AND NOT (contains(lower(p_name), 'blue ring') OR contains(lower(p_name), 'blue bolt')) THEN 'Cold'
  WHEN contains(lower(p_name), 'cold') THEN 'Cold'
  WHEN contains(lower(p_name), 'bolt') THEN 'Small parts'
  WHEN contains(lower(p_name), 'ring') AND NOT contains(lower(p_name), 'large') THEN 'Small parts'
  WHEN contains(lower(p_name), 'red') THEN 'Hot' ELSE 'Other' END AS family FROM part""", postings=False)
def p33(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", text.first_rule(F.col("p_name"), PART_RULES, V.OTHER_FAMILY).alias("family"))


@query("p34_feature_labels", """
WITH kept AS (SELECT * FROM p WHERE salary_avg IS NOT NULL AND min_experience_years IS NOT NULL)
SELECT CAST(count(*) AS BIGINT) AS rows_kept, CAST(sum(min_experience_years) AS BIGINT) AS years FROM kept""")
def p34(spark, sf):
    """Features picked by their display labels."""
    columns = resolve(["Зарплата", "Минимальный опыт"])
    return cleaned(spark, sf).select(*columns).dropna().agg(
        F.count(F.lit(1)).alias("rows_kept"), F.sum("min_experience_years").alias("years"))


@query("p35_categorical_cast", """
SELECT id, CAST(min_experience_years AS VARCHAR) AS min_experience_years FROM p""")
def p35(spark, sf):
    return FeatureSet([], ["min_experience_years"]).encode(cleaned(spark, sf).select("id", "min_experience_years"))


@query("p36_standardise", """
WITH kept AS (SELECT * FROM p WHERE salary_avg IS NOT NULL AND min_experience_years IS NOT NULL)
SELECT id, round((salary_avg - (SELECT avg(salary_avg) FROM kept)) / (SELECT stddev_pop(salary_avg) FROM kept), 6) AS salary_avg,
  round((min_experience_years - (SELECT avg(min_experience_years) FROM kept)) / (SELECT stddev_pop(min_experience_years) FROM kept), 6) AS min_experience_years
FROM kept""")
def p36(spark, sf):
    kept = cleaned(spark, sf).select("id", "salary_avg", "min_experience_years").dropna()
    z = statistics.standardize(kept, ["salary_avg", "min_experience_years"])
    return z.select("id", r("salary_avg", 6).alias("salary_avg"), r("min_experience_years", 6).alias("min_experience_years"))


@query("p37_salary_text", """
SELECT id, CASE WHEN salary_avg IS NULL THEN 'Не указана'
  ELSE replace(format('{:,}', CAST(trunc(salary_avg) AS BIGINT)), ',', ' ') || ' ₽' END AS pay FROM p""")
def p37(spark, sf):
    return cleaned(spark, sf).select("id", numbers.money_text(F.col("salary_avg"), V.SALARY_UNKNOWN).alias("pay"))


@query("p38_kpi_display", """
WITH a AS (SELECT area_name, count(*) AS total, count(*) FILTER (has_salary) AS paid,
  CAST(trunc(avg(salary_avg)) AS BIGINT) AS pay,
  100.0 * count(*) FILTER (coalesce(contains(lower(schedule_name), 'удален'), FALSE)) / count(*) AS remote FROM p GROUP BY 1)
SELECT area_name, round(100.0 * paid / total, 4) AS paid_pct,
  CASE WHEN pay > 100000 THEN (pay // 1000) || 'K ₽' ELSE pay || ' ₽' END AS pay_text,
  round(100 - remote, 4) AS office_pct FROM a""")
def p38(spark, sf):
    sums = cleaned(spark, sf).groupBy("area_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("has_salary").alias("paid"), F.avg("salary_avg").alias("pay"),
        F.count_if(is_remote(F.col("schedule_name"))).alias("remote"))
    return sums.select("area_name", r(numbers.percent(F.col("paid"), F.col("total"))).alias("paid_pct"),
                       numbers.compact_money(F.col("pay")).alias("pay_text"),
                       r(100 - numbers.percent(F.col("remote"), F.col("total"))).alias("office_pct"))


@query("p39_salary_estimate", """
SELECT k, CAST(60000 + 15000 * avg_experience_years AS BIGINT) AS predicted_salary,
  CAST(50000 + 15000 * avg_experience_years AS BIGINT) AS low,
  CAST(70000 + 15000 * avg_experience_years AS BIGINT) AS high, '₽' AS currency FROM p""")
def p39(spark, sf):
    """One request per posting, by its experience."""
    frame = cleaned(spark, sf).select(F.col("id").cast("bigint").alias("k"),
                                      numbers.salary_estimate(F.col("avg_experience_years")).alias("e"))
    return frame.select("k", "e.*")
