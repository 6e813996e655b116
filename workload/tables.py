"""Nested raw postings from the relational tables, by row-local rules.

`POSTINGS_SQL` states the same rules for the oracle, already flattened the way
a clean table should look.
"""

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain.operators.scale import compile_wide, use_all_cores
from jobgrain.schema import POSTING_CORE

AS_OF = "2001-09-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return use_all_cores(table(spark, sf_dir, "documents"), "doc_id")


def as_of() -> Column:
    """The instant AS_OF in UTC, whatever the session zone is."""
    return F.lit(f"{AS_OF}+00:00").cast("timestamp")


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = use_all_cores(table(spark, sf_dir, "orders"), "o_orderkey")
    customer = table(spark, sf_dir, "customer")
    nation = table(spark, sf_dir, "nation")
    return (orders.join(customer, orders.o_custkey == customer.c_custkey)
            .join(nation, customer.c_nationkey == nation.n_nationkey))


def _id_name(i: str, n: str) -> str:
    return f"named_struct('id', string({i}), 'name', string({n}))"


def _named(n: str) -> str:
    return f"named_struct('name', string({n}))"


_STREET = "concat('Street ', o_custkey % 50)"
_SALARY = """if(k % 7 = 0, null, named_struct('from', if(k % 3 = 0, null, round(o_totalprice)),
  'to', if(k % 4 = 0, null, round(o_totalprice * 1.25)), 'currency', if(k % 5 = 0, 'USD', 'RUR')))"""
_SKILLS = f"array({_named('c_mktsegment')}, {_named('n_name')}, {_named('lvl')})"
_ROLE = "named_struct('id', string({0}), 'name', concat('role ', {0}))"

RAW_COLUMNS = {
    "id": "string(k)",
    "name": "concat_ws(' ', c_mktsegment, o_orderpriority)",
    "salary": _SALARY, "salary_range": _SALARY,
    "experience": f"if(exp_id is null, null, {_id_name('exp_id', 'lvl')})",
    "employer": _id_name("c_custkey", "c_name"),
    "area": _id_name("n_nationkey", "n_name"),
    "type": _id_name("lower(o_orderstatus)", "concat('type ', o_orderstatus)"),
    "schedule": f"""case o_orderstatus when 'O' then {_id_name("'remote'", "'Удаленная работа'")}
      when 'F' then {_id_name("'fullDay'", "'Полный день'")} end""",
    "employment": f"""case k % 3 when 0 then {_id_name("'full'", "'Full time'")}
      when 1 then {_id_name("'part'", "'Part time'")} end""",
    "employment_form": f"""if(k % 4 = 0, null, {_id_name("concat('form', k % 4)", "concat('Form ', k % 4)")})""",
    "department": f"""if(k % 10 = 0, {_id_name("concat(c_custkey, '-dep')", "c_mktsegment")}, null)""",
    "professional_roles": f"""case when k % 4 = 0 then array() when k % 8 = 1 then null
      else array({_ROLE.format("(k % 170)")}, {_ROLE.format("((k + 7) % 170)")}) end""",
    "work_format": f"""if(k % 5 = 0, array(), array({_id_name("concat('f', k % 3)", "concat('Format ', k % 3)")}))""",
    "working_hours": f"""if(k % 6 = 0, null, array({_named("concat('h', k % 9)")}))""",
    "work_schedule_by_days": f"""if(k % 2 = 0, array({_named("'5/2'")}), array())""",
    "key_skills": f"""case when k % 11 = 0 then null when k % 13 = 0 then array()
      when k % 2 = 0 then concat({_SKILLS}, array({_named('c_mktsegment')})) else {_SKILLS} end""",
    "address": f"""if(k % 6 = 0, null, named_struct('city', n_name, 'street', {_STREET},
      'building', if(k % 5 = 0, null, string(k % 200)), 'raw', concat_ws(', ', n_name, {_STREET})))""",
    "snippet": """if(k % 9 = 0, null, named_struct('requirement', concat(lower(c_mktsegment), ' analyst, ', lvl),
      'responsibility', if(k % 5 = 0, null, concat('reports for ', n_name))))""",
    "published_at": """concat(date_format(o_orderdate + make_dt_interval(0, 0, int(k % 1440), 0),
      "yyyy-MM-dd'T'HH:mm:ss"), '+0300')""",
}


# What the columns of a posting are made from.
KEYED = ["k", "lvl", "exp_id", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
         "c_custkey", "c_name", "c_mktsegment", "n_nationkey", "n_name"]


def keyed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat rows that postings are made from."""
    compile_wide(spark)
    return base(spark, sf_dir).selectExpr(
        "*", "o_orderkey as k", "substring(o_orderpriority, 3) as lvl",
        "case substring(o_orderpriority, 1, 1) when '1' then 'noExperience' when '2' then 'between1And3'"
        " when '3' then 'between3And6' when '4' then 'moreThan6' end as exp_id")


def _typed(field: T.StructField) -> str:
    return f"cast({RAW_COLUMNS[field.name]} as {field.dataType.simpleString()})"


def postings_of(items: str) -> Column:
    """An array of `KEYED` structs as an array of the postings made from them, with the fields of `POSTING_CORE`."""
    fields = ", ".join(f"'{f.name}', {_typed(f)}" for f in POSTING_CORE.fields)
    return F.expr(f"transform({items}, r -> named_struct({re.sub(rf'\b({'|'.join(KEYED)})\b', r'r.\1', fields)}))")


def raw_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`POSTING_CORE` plus `k` (the order key) and three service columns."""
    return keyed_rows(spark, sf_dir).selectExpr(
        *[f"{_typed(f)} as {f.name}" for f in POSTING_CORE.fields],
        "concat('/p/', k) as alternate_url", "string(k % 17 = 0) as archived", "string(o_orderdate) as created_at", "k")


POSTINGS_SQL = f"""
b AS (
  SELECT *, o_orderkey AS k, substr(o_orderpriority, 3) AS lvl,
         o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS local_ts
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
),
s AS (
  SELECT *,
    CASE WHEN k % 7 <> 0 AND k % 3 <> 0 THEN round(o_totalprice) END AS salary_from,
    CASE WHEN k % 7 <> 0 AND k % 4 <> 0 THEN round(o_totalprice * 1.25) END AS salary_to,
    CASE WHEN k % 7 <> 0 THEN CASE WHEN k % 5 = 0 THEN 'USD' ELSE 'RUR' END END AS salary_currency
  FROM b
),
p AS (
  SELECT k, o_custkey, lvl, local_ts, salary_from, salary_to, salary_currency,
    CAST(k AS VARCHAR) AS id, c_mktsegment || ' ' || o_orderpriority AS name,
    salary_from IS NOT NULL OR salary_to IS NOT NULL AS has_salary,
    coalesce((salary_from + salary_to) / 2, salary_from, salary_to) AS salary_avg,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'noExperience' WHEN '2' THEN 'between1And3'
      WHEN '3' THEN 'between3And6' WHEN '4' THEN 'moreThan6' END AS experience_id,
    CASE WHEN substr(o_orderpriority, 1, 1) <> '5' THEN lvl END AS experience_name,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 1 WHEN '3' THEN 3 WHEN '4' THEN 6 END
      AS min_experience_years,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 0 WHEN '2' THEN 2 WHEN '3' THEN 4 WHEN '4' THEN 8 END
      AS avg_experience_years,
    CAST(local_ts AS DATE) AS published_date,
    strftime(local_ts, '%Y-%m') AS published_year_month,
    CAST(floor((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(local_ts - INTERVAL 3 HOUR)) / 86400000000.0) AS INTEGER)
      AS days_since_publication,
    CAST(c_custkey AS VARCHAR) AS employer_id, c_name AS employer_name,
    CAST(n_nationkey AS VARCHAR) AS area_id, n_name AS area_name,
    lower(o_orderstatus) AS type_id, 'type ' || o_orderstatus AS type_name,
    CASE o_orderstatus WHEN 'O' THEN 'remote' WHEN 'F' THEN 'fullDay' END AS schedule_id,
    CASE o_orderstatus WHEN 'O' THEN 'Удаленная работа' WHEN 'F' THEN 'Полный день' END AS schedule_name,
    CASE k % 3 WHEN 0 THEN 'full' WHEN 1 THEN 'part' END AS employment_id,
    CASE k % 3 WHEN 0 THEN 'Full time' WHEN 1 THEN 'Part time' END AS employment_name,
    CASE WHEN k % 4 <> 0 THEN 'form' || (k % 4) END AS employment_form_id,
    CASE WHEN k % 4 <> 0 THEN 'Form ' || (k % 4) END AS employment_form_name,
    CASE WHEN k % 10 = 0 THEN c_custkey || '-dep' END AS department_id,
    CASE WHEN k % 10 = 0 THEN c_mktsegment END AS department_name,
    CASE WHEN k % 4 <> 0 AND k % 8 <> 1 THEN [k % 170, (k + 7) % 170] ELSE [] END AS roles,
    CASE WHEN k % 5 <> 0 THEN 'f' || (k % 3) END AS work_format_id,
    CASE WHEN k % 5 <> 0 THEN 'Format ' || (k % 3) END AS work_format_name,
    CASE WHEN k % 6 <> 0 THEN 'h' || (k % 9) END AS working_hours_name,
    CASE WHEN k % 2 = 0 THEN '5/2' END AS work_schedule_name,
    CASE WHEN k % 11 = 0 OR k % 13 = 0 THEN [] WHEN k % 2 = 0 THEN [c_mktsegment, n_name, lvl, c_mktsegment]
      ELSE [c_mktsegment, n_name, lvl] END AS skills_list,
    CASE WHEN k % 6 <> 0 THEN n_name END AS address_city,
    CASE WHEN k % 6 <> 0 THEN 'Street ' || (o_custkey % 50) END AS address_street,
    CASE WHEN k % 6 <> 0 AND k % 5 <> 0 THEN CAST(k % 200 AS VARCHAR) END AS address_building,
    CASE WHEN k % 6 <> 0 THEN n_name || ', Street ' || (o_custkey % 50) END AS address_raw,
    CASE WHEN k % 9 <> 0 THEN lower(c_mktsegment) || ' analyst, ' || lvl END AS requirement,
    CASE WHEN k % 9 <> 0 AND k % 5 <> 0 THEN 'reports for ' || n_name END AS responsibility
  FROM s
)"""
