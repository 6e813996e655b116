"""Publication time: instant, wall clock of the posting's own offset, age."""

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def instant(c: Column) -> Column:
    """ISO text with an offset (`+0300` or `+03:00`) to a timestamp."""
    return c.try_cast("timestamp")


def wall_clock(c: Column) -> Column:
    """Local time as written, whatever the session zone is."""
    return F.replace(F.substring(c, 1, 19), F.lit("T"), F.lit(" ")).try_cast("timestamp_ntz")


def days_between(ts: Column, as_of: Column) -> Column:
    """Whole days from `ts` to `as_of`, floored (negative for a future time)."""
    micros = F.unix_micros(as_of) - F.unix_micros(ts)
    return F.floor((micros - F.pmod(micros, F.lit(DAY_MICROS))) / DAY_MICROS).cast("int")
