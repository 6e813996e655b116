"""Numeric expressions: coercion, salary, experience, display numbers."""

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobgrain.fixed_values import CURRENCY_SIGN, ESTIMATE_BASE, ESTIMATE_MARGIN, ESTIMATE_STEP

_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def to_number(c: Column) -> Column:
    """Text to double, NULL for anything but a plain decimal number."""
    return F.when(F.rlike(c, F.lit(_NUMBER)), c.try_cast("double"))


def not_nan(c: Column) -> Column:
    """NaN to NULL, so that missing has one form."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def salary_avg(low: Column, high: Column) -> Column:
    return F.coalesce((low + high) / 2, low, high)


def lookup(c: Column, table: dict) -> Column:
    """Literal map lookup; an unknown key gives NULL."""
    literal = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.try_element_at(literal, c)


def grouped_thousands(c: Column) -> Column:
    """Truncated to whole units, a blank between thousands."""
    return F.replace(F.format_number(c.cast("bigint"), 0), F.lit(","), F.lit(" "))


def money_text(c: Column, missing: str) -> Column:
    return F.coalesce(F.concat(grouped_thousands(c), F.lit(f" {CURRENCY_SIGN}")), F.lit(missing))


def compact_money(c: Column) -> Column:
    """`145K` above 100,000 by whole division, else the number itself."""
    whole = c.cast("bigint")
    return F.when(whole > 100000, F.concat(F.floor(whole / 1000), F.lit(f"K {CURRENCY_SIGN}"))
                  ).otherwise(F.concat(whole, F.lit(f" {CURRENCY_SIGN}")))


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where whole is 0."""
    return F.when(whole > 0, part * F.lit(100.0) / whole).otherwise(F.lit(0.0))


def salary_estimate(years: Column) -> Column:
    """struct(predicted_salary, low, high, currency); rounds half to even."""
    value = F.bround(ESTIMATE_BASE + ESTIMATE_STEP * years.cast("double"), -3).cast("bigint")
    return F.struct(value.alias("predicted_salary"), (value - ESTIMATE_MARGIN).alias("low"),
                    (value + ESTIMATE_MARGIN).alias("high"), F.lit(CURRENCY_SIGN).alias("currency"))
