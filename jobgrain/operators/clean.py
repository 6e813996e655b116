"""Raw posting to flat clean table."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from jobgrain import fixed_values as V
from jobgrain.functions import dates, nested, numbers, text
from jobgrain.schema import POSTING_CORE

BAD_CELLS = "_bad_cells"
ENTITIES = ("employer", "area", "type", "schedule", "employment", "employment_form", "department")
ADDRESS_PARTS = ("city", "street", "building", "raw")
SNIPPET_PARTS = ("requirement", "responsibility")
# First elements of the list fields: (source, field, column).
FIRST_ELEMENTS = (
    ("professional_roles", "id", "main_role_id"), ("professional_roles", "name", "main_role_name"),
    ("work_format", "name", "work_format_name"), ("work_format", "id", "work_format_id"),
    ("working_hours", "name", "working_hours_name"), ("work_schedule_by_days", "name", "work_schedule_name"))


def derived_columns() -> dict[str, list[str]]:
    """Nested source column -> columns made from it, taken from the specs above."""
    out = {"salary": ["salary_from", "salary_to", "salary_currency"], "salary_range": [], "experience": ["experience_id", "experience_name"],
           "key_skills": ["skills_list", "skills_count"], "address": [f"address_{p}" for p in ADDRESS_PARTS], "snippet": list(SNIPPET_PARTS)}
    out |= {e: [f"{e}_id", f"{e}_name"] for e in ENTITIES}
    for source, _, column in FIRST_ELEMENTS:
        out.setdefault(source, []).append(column)
    return out


def parse_cells(df: DataFrame, schema: T.StructType = POSTING_CORE) -> DataFrame:
    """Strip text columns; read stringified nested ones with the declared type.

    A cell that looks nested but cannot be read becomes NULL and its name is
    listed in `_bad_cells`.
    """
    wanted = {f.name: f.dataType for f in schema.fields}
    out, texts, bad = [], [], []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        target = wanted.get(field.name, field.dataType)
        if not isinstance(field.dataType, T.StringType):
            out.append(c)
        elif isinstance(target, (T.StructType, T.ArrayType)):
            out.append(nested.parse_cell(c, target).alias(field.name))
            held = f"_text_{len(bad)}"
            texts.append(c.alias(held))
            bad.append(F.when(F.col(f"`{field.name}`").isNull() & F.col(held).isNotNull() & (text.strip(F.col(held)) != ""), F.lit(field.name)))
        else:
            out.append(text.strip(c).alias(field.name))
    if not bad:
        return df.select(*out)
    # The names of unreadable cells come from the parsed cells in a second step, so that none is parsed twice.
    return df.select(*out, *texts).select(*[F.col(f"`{c}`") for c in df.columns], F.array_compact(F.array(*bad)).alias(BAD_CELLS))


def salary_columns(salary: str = "salary") -> list[Column]:
    low = numbers.not_nan(F.col(f"{salary}.from"))
    high = numbers.not_nan(F.col(f"{salary}.to"))
    return [low.alias("salary_from"), high.alias("salary_to"),
            F.col(f"{salary}.currency").alias("salary_currency"),
            (low.isNotNull() | high.isNotNull()).alias("has_salary"),
            numbers.salary_avg(low, high).alias("salary_avg")]


def experience_columns() -> list[Column]:
    key = F.col("experience.id")
    return [key.alias("experience_id"), F.col("experience.name").alias("experience_name"),
            numbers.lookup(key, V.MIN_EXPERIENCE_YEARS).alias("min_experience_years"),
            numbers.lookup(key, V.AVG_EXPERIENCE_YEARS).alias("avg_experience_years")]


def date_columns(as_of: Column) -> list[Column]:
    raw = F.col("published_at")
    ts, local = dates.instant(raw), dates.wall_clock(raw)
    return [ts.alias("published_at"), local.cast("date").alias("published_date"),
            F.date_format(local, "yyyy-MM").alias("published_year_month"),
            dates.days_between(ts, as_of).alias("days_since_publication")]


def entity_columns(entity: str) -> list[Column]:
    return [F.col(f"{entity}.{part}").alias(f"{entity}_{part}") for part in ("id", "name")]


def list_columns() -> list[Column]:
    """First elements of the list fields."""
    return [nested.first_field(F.col(src), part).alias(out) for src, part, out in FIRST_ELEMENTS]


def skill_columns() -> list[Column]:
    skills = nested.names_of(F.col("key_skills"))
    return [skills.alias("skills_list"), F.size(skills).alias("skills_count")]


def flatten(df: DataFrame, as_of: Column | None = None, keep_raw: bool = False) -> DataFrame:
    """All derived columns in one projection; `as_of` defaults to now.

    Names of unreadable cells are carried along. `keep_raw` keeps every other column of the
    input too, but for those that a derived column replaces.
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    derived = (salary_columns() + experience_columns() + date_columns(as_of)
               + [c for e in ENTITIES for c in entity_columns(e)]
               + [F.col(f"address.{p}").alias(f"address_{p}") for p in ADDRESS_PARTS]
               + [F.col(f"snippet.{p}").alias(p) for p in SNIPPET_PARTS]
               + list_columns() + skill_columns())
    if not keep_raw:
        return df.select("id", "name", *derived, *[c for c in df.columns if c == BAD_CELLS])
    made = set(df.select("id", "name", *derived).columns)
    return df.select("id", "name", *derived, *[F.col(f"`{c}`") for c in df.columns if c not in made])


def drop_raw(df: DataFrame, service=V.SERVICE_COLUMNS) -> DataFrame:
    """Drop nested sources whose derived columns exist, and service columns."""
    spent = [raw for raw, out in derived_columns().items() if not out or any(c in df.columns for c in out)]
    return df.drop(*spent, *service)


def indicator_name(skill: str) -> str:
    return "skill_" + skill.replace(" ", "_").replace("/", "_").lower()


def skill_indicators(df: DataFrame, vocabulary: list[str], skills: str = "skills_list") -> DataFrame:
    """A 0/1 column per skill; equal names get a running suffix."""
    columns, taken = [], {}
    for skill in vocabulary:
        name = indicator_name(skill)
        taken[name] = taken.get(name, 0) + 1
        name = name if taken[name] == 1 else f"{name}_{taken[name]}"
        columns.append(F.array_contains(F.col(skills), skill).cast("int").alias(name))
    return df.select("*", *columns)


def skill_indicators_pivot(df: DataFrame, vocabulary: list[str], key: str = "id",
                           skills: str = "skills_list") -> DataFrame:
    """The same indicators as (key, columns) from the long form."""
    long = df.select(key, F.explode_outer(F.array_distinct(F.col(skills))).alias("_skill"))
    flags = [F.coalesce(F.max(F.when(F.col("_skill") == s, 1)), F.lit(0)).alias(indicator_name(s))
             for s in vocabulary]
    return long.groupBy(key).agg(*flags)


def analysis_frame(df: DataFrame) -> DataFrame:
    """The 12 analysis columns with titles reduced to job families."""
    family = text.first_rule(F.col("name"), V.JOB_FAMILY_RULES, V.OTHER_FAMILY)
    return df.select(*[family.alias("name") if c == "name" else F.col(c) for c in V.ANALYSIS_COLUMNS])
