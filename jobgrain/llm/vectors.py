"""Whole-number vectors of a column of float arrays, shared by the operators on embeddings."""

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whole components of this size or more do not surely fit in a long.
TOO_LARGE = 1 << 62
# Tasks that add up the sums of all others; their results are what reaches the driver.
MERGERS = 16


def whole(vector: Column, scale: int, offset: int = 0) -> Column:
    """floor(scale x) + offset of each component as longs; null if the vector or a component is null or not finite."""
    numbers = F.transform(vector, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(numbers, lambda x: F.floor(scale * x) + offset))


def shape(rows: DataFrame, column: str) -> tuple[int, int, int]:
    """Rows, components of each and the largest size of a component; raises where lengths differ or longs may overflow."""
    size = F.size(column)
    found = rows.agg(F.count(F.lit(1)), F.min(size), F.max(size),
                     F.max(F.coalesce(F.greatest(F.array_max(column), -F.array_min(column)), F.lit(0)))).first()
    n, least, most, largest = (x or 0 for x in found)
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components; they must have the same number")
    if not 0 <= largest < TOO_LARGE:
        raise ArithmeticError("a whole component does not fit in a long")
    return n, most, largest


def stacked(lists: pd.Series, width: int, exact: bool) -> np.ndarray:
    """One row per list: longs, or Python's integers where products would not fit in a long."""
    flat = np.concatenate([np.asarray(x, np.int64) for x in lists]) if len(lists) else np.empty(0, np.int64)
    return flat.reshape(len(lists), width).astype(object if exact else np.int64)


def totals(rows: DataFrame, measure: Callable[[pd.DataFrame], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of `rows` of the `size` numbers that `measure` makes of each; exact for Python's integers.

    Every task hands on one row, MERGERS tasks add those up, and the driver adds MERGERS rows, however many tasks there are.
    """
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, met = np.zeros(size, object), False
        for batch in batches:
            total, met = total + measure(batch), True
        if met:
            yield pd.DataFrame({"total": [pickle.dumps(total)]})

    def merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, met = np.zeros(size, object), False
        for batch in batches:
            for one in batch["total"]:
                total, met = total + pickle.loads(one), True
        if met:
            yield pd.DataFrame({"total": [pickle.dumps(total)]})

    parts = rows.mapInPandas(partial, "total binary").repartition(MERGERS).mapInPandas(merged, "total binary").collect()
    return sum((pickle.loads(t) for t, in parts), np.zeros(size, object))
