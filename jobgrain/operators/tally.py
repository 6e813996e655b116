"""One aggregate that carries all figures of a report: counts, sums, value counts and quantile slots.

Every row is handed on as a few small records (kind, key, slot, amount), and one grouped
aggregate adds them up, partially before its shuffle. Reports read their parts from the
result, which has a row per distinct value, so the input itself is passed over once.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain.operators.quantiles import slot
from jobgrain.operators.scale import settle

ROWS, AMOUNT, VALUE, ITEM, SLOT = "rows", "amount", "value", "item", "slot"


def _record(kind: str, feature: str | None = None, key: Column | None = None, at: Column | None = None, amount: Column | None = None) -> Column:
    def given(c, of):
        return (F.lit(None) if c is None else c).cast(of)
    return F.struct(F.lit(kind).alias("kind"), F.lit(feature).cast("string").alias("feature"), given(key, "string").alias("key"),
                    given(at, "long").alias("slot"), given(amount, "double").alias("amount"))


def _items(column: str) -> Column:
    """A record for every known entry of a list."""
    entries = F.filter(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda s: s.isNotNull())
    return F.transform(entries, lambda s: _record(ITEM, column, key=s))


def tally(df: DataFrame, by: list[str] = (), amounts: dict[str, Column] | None = None, values: list[str] = (),
          items: list[str] = (), slots: list[str] = ()) -> DataFrame:
    """(*by, kind, feature, key, slot, n, known, total, low, high) in one pass over `df`, settled.

    `amounts` are summed, the distinct `values` and the entries of the lists `items` counted; `slots` are numeric columns
    whose quantiles are wanted: their rows are the first round of `quantiles`.
    """
    records = [_record(ROWS)]
    records += [_record(AMOUNT, name, amount=c) for name, c in (amounts or {}).items()]
    records += [_record(VALUE, c, key=F.col(c)) for c in values]
    records += [_record(SLOT, c, at=slot(F.col(c).cast("double")), amount=F.col(c)) for c in slots]
    lists = [_items(c) for c in items]
    whole = F.concat(F.array(*records), *lists) if lists else F.array(*records)
    return settle(df.select(*by, F.inline(whole)).groupBy(*by, "kind", "feature", "key", "slot").agg(
        F.count(F.lit(1)).alias("n"), F.count("amount").alias("known"), F.sum("amount").alias("total"),
        F.min("amount").alias("low"), F.max("amount").alias("high")))


def part(counts: DataFrame, kind: str, feature: str | None = None) -> DataFrame:
    """The records of one kind."""
    found = counts.where(F.col("kind") == kind)
    return found if feature is None else found.where(F.col("feature") == feature)


def slots_of(counts: DataFrame, feature: str, by: list[str] = ()) -> DataFrame:
    """The first round of `quantiles`, over the groups of the tally or over coarser ones."""
    return (part(counts, SLOT, feature).where(F.col("known") > 0).groupBy(*by, F.col("slot").alias("_slot"))
            .agg(F.sum("known").alias("_n"), F.min("low").alias("_low"), F.max("high").alias("_high")))
