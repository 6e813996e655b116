"""Filters, deduplication, joins, set operations and text tagging (F, D, J, U, T)."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.functions import text
from jobgrain.operators import dedup, filters, statistics, tagging
from jobgrain.operators.quantiles import quantiles
from workload.cleaning import cleaned
from workload.registry import query, r
from workload.tables import documents, raw_postings, table

INCLUDE, EXCLUDE = ["machinery", "building", "house"], ["low", "urgent"]


@query("f01_title_filter", """
SELECT id, name FROM p WHERE (contains(lower(name), 'machinery') OR contains(lower(name), 'building')
  OR contains(lower(name), 'house')) AND NOT (contains(lower(name), 'low') OR contains(lower(name), 'urgent'))""")
def f01(spark, sf):
    return filters.by_title(raw_postings(spark, sf), INCLUDE, EXCLUDE).select("id", "name")


@query("f02_salary_band", """
SELECT id, coalesce(salary_from, salary_to) AS pay FROM p WHERE salary_currency = 'RUR'
  AND coalesce(salary_from, salary_to) BETWEEN 100000 AND 200000""")
def f02(spark, sf):
    kept = filters.by_salary(raw_postings(spark, sf), 100000, 200000)
    return kept.select("id", F.coalesce("salary.from", "salary.to").alias("pay"))


@query("f02_salary_floor_zero", "SELECT id FROM p WHERE salary_currency = 'USD' AND coalesce(salary_from, salary_to) >= 0")
def f02_zero(spark, sf):
    return filters.by_salary(raw_postings(spark, sf), low=0, currency="USD").select("id")


@query("f03_experience_level", "SELECT id, experience_id FROM p WHERE experience_id IN ('noExperience', 'between3And6')")
def f03(spark, sf):
    kept = filters.by_experience(raw_postings(spark, sf), ["noExperience", "between3And6"])
    return kept.select("id", F.col("experience.id").alias("experience_id"))


@query("f04_employment_type", "SELECT id, employment_id FROM p WHERE employment_id = 'part'")
def f04(spark, sf):
    return filters.by_employment(raw_postings(spark, sf), ["part"]).select("id", F.col("employment.id").alias("employment_id"))


@query("f05_schedule_type", "SELECT id, schedule_id FROM p WHERE schedule_id = 'remote'")
def f05(spark, sf):
    return filters.by_schedule(raw_postings(spark, sf), ["remote"]).select("id", F.col("schedule.id").alias("schedule_id"))


@query("f06_skill_text", """
SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'and')
  AND NOT contains(lower(text), 'der ')""", postings=False)
def f06(spark, sf):
    return filters.by_skill_text(documents(spark, sf), ["The", "AND"], ["Der "], text="text").select("doc_id")


@query("f07_analyst_role", """
SELECT id FROM p WHERE list_has_any(roles, [10, 134, 148, 150, 156, 163, 164])""")
def f07(spark, sf):
    return filters.by_role(raw_postings(spark, sf)).select("id")


@query("f08_outliers_events", """
WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3, count(value) AS n FROM events)
SELECT event_id, value FROM events, q WHERE value IS NULL OR n <= 10
  OR value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""", postings=False)
def f08(spark, sf):
    return filters.without_outliers(table(spark, sf, "events"), "value").select("event_id", "value")


@query("f08_outliers_salary", """
WITH q AS (SELECT quantile_cont(salary_avg, 0.25) AS q1, quantile_cont(salary_avg, 0.75) AS q3 FROM p)
SELECT id, salary_avg FROM p, q WHERE salary_avg IS NULL
  OR salary_avg BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)""")
def f08_salary(spark, sf):
    return cleaned(spark, sf, remove_outliers=True).select("id", "salary_avg")


@query("f09_role_name_stem", "SELECT n_nationkey, n_name FROM nation WHERE contains(lower(n_name), 'nation_1')", postings=False)
def f09(spark, sf):
    return filters.by_name_stem(table(spark, sf, "nation"), "nation_1", "n_name").select("n_nationkey", "n_name")


@query("f10_drop_missing_features", """
SELECT id, salary_avg, schedule_name FROM p WHERE salary_avg IS NOT NULL AND schedule_name IS NOT NULL""")
def f10(spark, sf):
    frame = cleaned(spark, sf).select("id", "salary_avg", "schedule_name")
    return filters.with_features(frame, ["salary_avg", "schedule_name"])


@query("f12_remote_work", "SELECT id, coalesce(contains(lower(schedule_name), 'удален'), FALSE) AS remote FROM p")
def f12(spark, sf):
    return cleaned(spark, sf).select("id", filters.is_remote(F.col("schedule_name")).alias("remote"))


REST = ["l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag",
        "l_linestatus", "l_shipdate"]


@query("d01_keep_first_lineitem", f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY {', '.join(REST)}) AS rn FROM lineitem)
WHERE rn = 1""", postings=False)
def d01(spark, sf):
    first = dedup.keep_first(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], REST)
    return first.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


@query("d01_keep_first_events", """
SELECT event_id, user_id FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1""", postings=False)
def d01_events(spark, sf):
    return dedup.keep_first(table(spark, sf, "events"), "user_id", ["ts", "event_id"]).select("event_id", "user_id")


def _batches(spark, sf):
    """Orders in batch 0..2, every fifth also in the next batch, every ninth twice in its own."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("id"), "o_totalprice")
    key = F.col("o_orderkey")
    own = (key % 3).cast("int")
    batches = F.array_compact(F.array(own, F.when(key % 5 == 0, own + 1), F.when(key % 9 == 0, own)))
    return orders.select("id", "o_totalprice", F.explode(batches).alias("batch"))


BATCHES_SQL = """b AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, CAST(o_orderkey % 3 AS INTEGER) AS batch FROM orders
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_totalprice, CAST(o_orderkey % 3 + 1 AS INTEGER) FROM orders WHERE o_orderkey % 5 = 0
  UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_totalprice, CAST(o_orderkey % 3 AS INTEGER) FROM orders WHERE o_orderkey % 9 = 0)"""


@query("d02_incremental_anti_join", f"""
WITH {BATCHES_SQL}
SELECT id, o_totalprice, batch FROM b WHERE batch > 0 AND id NOT IN (SELECT id FROM b AS c WHERE c.batch < b.batch)""", postings=False)
def d02(spark, sf):
    b = _batches(spark, sf)
    new = [dedup.only_new(b.where(f"batch = {i}"), b.where(f"batch < {i}")) for i in (1, 2, 3)]
    return reduce(DataFrame.union, [n.select("id", "o_totalprice", "batch") for n in new])


@query("s07_ordered_batches", f"""
WITH {BATCHES_SQL}
SELECT id, o_totalprice, batch FROM b WHERE batch = (SELECT min(batch) FROM b AS c WHERE c.id = b.id)""", postings=False)
def s07(spark, sf):
    return dedup.collect_batches(_batches(spark, sf), "id", "batch", ["o_totalprice"]).select("id", "o_totalprice", "batch")


@query("s07_ordered_batches_distinct", f"""
WITH {BATCHES_SQL}
SELECT id, min(o_totalprice) AS o_totalprice, min(batch) AS batch FROM b GROUP BY id""", postings=False)
def s07_distinct(spark, sf):
    return dedup.collect_batches(_batches(spark, sf), "id", "batch", ["o_totalprice"],
                                 dedupe_within=True).select("id", "o_totalprice", "batch")


@query("j04_text_lexicon", """
WITH lex AS (SELECT 'item ' || item_id AS skill, lower(text) AS keyword FROM benchmark UNION ALL SELECT 'blank', NULL)
SELECT DISTINCT doc_id, skill FROM documents JOIN lex ON contains(lower(text), keyword)""", postings=False)
def j04(spark, sf):
    return tagging.tag_texts(documents(spark, sf), _passages(spark, sf), "doc_id", "text")


@query("j04_lexicon_through_a_filter", """
WITH lex AS (SELECT 'item ' || item_id AS skill, lower(text) AS keyword FROM benchmark UNION SELECT 'start ' || item_id, lower(substr(text, 1, 24)) FROM benchmark
  UNION SELECT 'part ' || p_partkey, lower(p_name) FROM part)
SELECT DISTINCT doc_id, skill FROM documents JOIN lex ON keyword <> '' AND contains(lower(text), keyword)""", postings=False)
def j04_filter(spark, sf):
    """The way for lexicons that are too large to broadcast: passages, their beginnings, and names of parts."""
    lower = F.lower("text")
    item = table(spark, sf, "benchmark")
    lexicon = (item.select(F.concat(F.lit("item "), "item_id").alias("skill"), lower.alias("keyword"))
               .union(item.select(F.concat(F.lit("start "), "item_id"), F.lower(F.substring("text", 1, 24))))
               .union(table(spark, sf, "part").select(F.concat(F.lit("part "), "p_partkey"), F.lower("p_name"))))
    return tagging.tag_texts_by_anchor(documents(spark, sf), lexicon, "doc_id", "text", broadcast_rows=0)


def _passages(spark, sf):
    """A lexicon table: every benchmark passage, and an empty keyword that finds nothing."""
    passages = table(spark, sf, "benchmark").select(
        F.concat(F.lit("item "), F.col("item_id")).alias("skill"), F.lower("text").alias("keyword"))
    return passages.union(spark.range(1).select(F.lit("blank"), F.lit("")))


@query("j04_text_lexicon_by_anchor", """
WITH lex AS (SELECT 'item ' || item_id AS skill, lower(text) AS keyword FROM benchmark UNION ALL SELECT 'blank', NULL)
SELECT DISTINCT doc_id, skill FROM documents JOIN lex ON contains(lower(text), keyword)""", postings=False)
def j04_anchor(spark, sf):
    """The way taken for a lexicon too large to inline."""
    return tagging.tag_texts_by_anchor(documents(spark, sf), _passages(spark, sf), "doc_id", "text", anchor=8)


@query("j05_table_thresholds", """
WITH q AS (SELECT quantile_cont(salary_avg, 0.3) AS q30, quantile_cont(salary_avg, 0.7) AS q70 FROM p)
SELECT id, CASE WHEN salary_avg > q70 THEN 'high' WHEN salary_avg > q30 THEN 'normal' WHEN salary_avg IS NOT NULL THEN 'low' END AS band
FROM p, q""")
def j05(spark, sf):
    frame = cleaned(spark, sf).select("id", "salary_avg")
    q = quantiles(frame, "salary_avg", {"q30": 0.3, "q70": 0.7}).select(F.struct("q30", "q70").alias("q")).scalar()
    pay = F.col("salary_avg")
    return frame.select("id", F.when(pay > q["q70"], "high").when(pay > q["q30"], "normal")
                        .when(pay.isNotNull(), "low").alias("band"))


@query("u01_append", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, o_totalprice, CAST(NULL AS VARCHAR) AS note FROM orders WHERE o_orderkey % 3 = 0
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), NULL, o_orderpriority FROM orders WHERE o_orderkey % 3 = 1
UNION ALL SELECT CAST(o_orderkey AS VARCHAR), o_totalprice, o_orderpriority FROM orders WHERE o_orderkey % 3 = 2""", postings=False)
def u01(spark, sf):
    orders = table(spark, sf, "orders").withColumn("id", F.col("o_orderkey").cast("string"))
    return dedup.append([orders.where("o_orderkey % 3 = 0").select("id", "o_totalprice"),
                         orders.where("o_orderkey % 3 = 1").select("id", F.col("o_orderpriority").alias("note")),
                         orders.where("o_orderkey % 3 = 2").select(F.col("o_orderpriority").alias("note"), "id", "o_totalprice")])


@query("u02_union_lists", """
SELECT id, array_to_string(list_sort(list_distinct(list_concat(skills_list,
  CASE WHEN requirement IS NULL THEN [] ELSE string_split(requirement, ', ') END))), '|') AS merged FROM p""")
def u02(spark, sf):
    return cleaned(spark, sf).select("id", F.array_join(
        text.union_lists(F.col("skills_list"), F.split("requirement", ", ")), "|").alias("merged"))


LEXICON = {
    "articles": ["the ", " le ", " la ", "der "], "and": [" and ", " et ", " und "],
    "endings": ["tion", "ment", "ung"], "upper": ["THE"], "accents": ["é", "ü"], "rare": ["mit license", "copyright"],
}


def _tags_sql(column: str) -> str:
    hits = [f"CASE WHEN {' OR '.join(f'contains(lower({column}), {chr(39)}{k}{chr(39)})' for k in words)} THEN '{skill}' END"
            for skill, words in LEXICON.items()]
    return f"list_sort(list_filter([{', '.join(hits)}], lambda x: x IS NOT NULL))"


@query("t01_lexicon_tags", f"SELECT doc_id, array_to_string({_tags_sql('text')}, '|') AS tags FROM documents", postings=False)
def t01(spark, sf):
    docs = documents(spark, sf)
    return docs.select("doc_id", F.array_join(text.lexicon_tags(F.col("text"), LEXICON), "|").alias("tags"))


@query("t01_lexicon_tags_two_texts", f"""
SELECT d.doc_id, array_to_string(list_sort(list_distinct(list_concat({_tags_sql('d.text')}, {_tags_sql('c.text')}))), '|') AS tags
FROM documents d LEFT JOIN (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS text FROM conversations GROUP BY 1) c
  ON c.conv_id = d.doc_id""", postings=False)
def t01_two(spark, sf):
    docs = documents(spark, sf).select("doc_id", F.col("text").alias("requirement"))
    talk = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]), "\n").alias("responsibility"))
    tagged = tagging.tag_skills(docs.join(talk, "doc_id", "left"), LEXICON)
    return tagged.select("doc_id", F.array_join("skills_list", "|").alias("tags"))


@query("t01_lexicon_words", """
SELECT doc_id, regexp_matches(lower(text), '(^|[^\\pL\\pN\\pM_])and($|[^\\pL\\pN\\pM_])') AS has_and FROM documents""", postings=False)
def t01_words(spark, sf):
    """Keywords as whole words."""
    tags = text.lexicon_tags(F.col("text"), {"and": ["and"]}, mode="word")
    return documents(spark, sf).select("doc_id", (F.size(tags) > 0).alias("has_and"))


@query("t02_tag_frequency", f"""
SELECT skill, count(*) AS n FROM (SELECT unnest({_tags_sql('text')}) AS skill FROM documents) GROUP BY skill""", postings=False)
def t02(spark, sf):
    docs = documents(spark, sf)
    return statistics.skill_counts(docs.select(text.lexicon_tags(F.col("text"), LEXICON).alias("skills_list")))


@query("u03_except_by_key", """
SELECT CAST(o_orderkey AS VARCHAR) AS id, round(o_totalprice, 2) AS price FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""", postings=False)
def u03(spark, sf):
    orders = table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return dedup.only_new(orders, lines, "o_orderkey").select(
        F.col("o_orderkey").cast("string").alias("id"), r("o_totalprice", 2).alias("price"))
