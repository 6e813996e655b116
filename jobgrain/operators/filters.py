"""Filters over raw postings (F1-F7, F9) and tables.

Absent and explicit null fields are the same thing here. A filter without
arguments returns its input, as decided while the plan is built.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain import fixed_values as V
from jobgrain.functions.text import contains_all, contains_any
from jobgrain.operators.quantiles import quantiles


def by_title(df: DataFrame, include=V.TITLE_INCLUDE, exclude=V.TITLE_EXCLUDE,
             name: str = "name") -> DataFrame:
    return df.where(contains_any(F.col(name), include) & ~contains_any(F.col(name), exclude))


def by_salary(df: DataFrame, low=None, high=None, currency: str = "RUR",
              salary: str = "salary") -> DataFrame:
    """Currency must match and `from`, or else `to`, lie in the inclusive band."""
    if low is None and high is None:
        return df
    pay = F.coalesce(F.col(f"{salary}.from"), F.col(f"{salary}.to"))
    keep = (F.col(f"{salary}.currency") == currency) & pay.isNotNull()
    if low is not None:
        keep &= pay >= low
    if high is not None:
        keep &= pay <= high
    return df.where(keep)


def _by_id(df: DataFrame, column: str, ids) -> DataFrame:
    return df.where(F.col(f"{column}.id").isin(list(ids))) if ids else df


def by_experience(df: DataFrame, levels=None) -> DataFrame:
    return _by_id(df, "experience", levels)


def by_employment(df: DataFrame, types=None) -> DataFrame:
    return _by_id(df, "employment", types)


def by_schedule(df: DataFrame, types=None) -> DataFrame:
    return _by_id(df, "schedule", types)


def by_skill_text(df: DataFrame, required=None, excluded=None,
                  text: str = "snippet.requirement") -> DataFrame:
    """All of `required` and none of `excluded`, whatever their case."""
    if not required and not excluded:
        return df
    return df.where(contains_all(F.col(text), [s.lower() for s in required or []])
                    & ~contains_any(F.col(text), [s.lower() for s in excluded or []]))


def has_role(roles: Column, ids=V.ANALYST_ROLE_IDS) -> Column:
    """True when any role id, as text, is in `ids`; false for no roles."""
    return F.coalesce(F.exists(roles, lambda r: r["id"].cast("string").isin(list(ids))), F.lit(False))


def by_role(df: DataFrame, ids=V.ANALYST_ROLE_IDS, roles: str = "professional_roles") -> DataFrame:
    return df.where(has_role(F.col(roles), ids))


def by_name_stem(df: DataFrame, stem: str = V.ROLE_NAME_STEM, name: str = "name") -> DataFrame:
    return df.where(contains_any(F.col(name), [stem]))


def is_remote(c: Column, stem: str = V.REMOTE_STEM) -> Column:
    return contains_any(c, [stem])


def without_outliers(df: DataFrame, value: str = "salary_avg", at_least: int = 11) -> DataFrame:
    """Keep values within 1.5 IQR of the quartiles, and rows without a value.

    Below `at_least` values every row stays. The bounds are fetched (one row), so the plan is a scan and a filter.
    """
    q = quantiles(df, value, {"q1": 0.25, "q3": 0.75}).first()
    if q["n"] < at_least:
        return df
    reach = 1.5 * (q["q3"] - q["q1"])
    x = F.col(value)
    return df.where(x.isNull() | x.between(q["q1"] - reach, q["q3"] + reach))


def with_features(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows that have every one of the selected features."""
    if not columns:
        raise ValueError("no features selected")
    return df.dropna(how="any", subset=columns)
