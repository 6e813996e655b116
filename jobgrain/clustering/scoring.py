"""Silhouettes of many labellings at once, without pairs of tuples.

Gower, Hamming and one-feature Euclidean distances are sums over features. A
categorical term is a count lookup. A numeric term follows from running counts and
sums in the order of the values: the tuples are dealt into ranges of that order, a
first pass adds up each range, and a second pass runs through every range with what
lies before and behind it. Both passes serve all labellings. Two-feature Euclidean
distances are in `quadtree`.
"""

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.clustering.features import WEIGHT
from jobgrain.operators.scale import BROADCAST_ROWS, settle, spread_join

LABELS = "labels"
SUMS = "_sums"
RANGE_ROWS = 50_000


def offsets(ks: list[int]) -> list[int]:
    """First column of each labelling when their clusters are put side by side."""
    return [0, *np.cumsum(ks).tolist()]


def cluster_sizes(labelled: DataFrame, ks: list[int]) -> list[list[int]]:
    """Rows of every cluster of every labelling, empty ones included, in one pass."""
    found = (labelled.select(WEIGHT, F.posexplode(LABELS).alias("labelling", "cluster"))
             .groupBy("labelling", "cluster").agg(F.sum(WEIGHT).alias("n")).collect())
    sizes = [[0] * k for k in ks]
    for labelling, cluster, n in found:
        sizes[labelling][cluster] = int(n)
    return sizes


def _onehot(frame: pd.DataFrame, ks: list[int]) -> np.ndarray:
    """Weight of each tuple in the column of its cluster, labellings side by side."""
    starts = np.array(offsets(ks)[:-1])
    columns = np.stack(frame[LABELS].to_numpy()).astype(np.int64) + starts
    out = np.zeros((len(frame), sum(ks)))
    np.put_along_axis(out, columns, frame[WEIGHT].to_numpy(np.float64)[:, None], 1)
    return out


def _add_numeric(rows: DataFrame, column: str, scale: float, ks: list[int], count: int) -> DataFrame:
    """Adds sum |x - x_j| / scale over each cluster to the array of sums."""
    parts = max(1, -(-count // RANGE_ROWS), min(rows.sparkSession.sparkContext.defaultParallelism, -(-count // 1_000)))
    # Equal values may fall into several ranges: their terms are zero on either side of a cut.
    ranged = settle(rows.repartitionByRange(parts, F.col(column), F.xxhash64(*[c for c in rows.columns if c not in (LABELS, SUMS)]))
                    .sortWithinPartitions(column).withColumn("_range", F.spark_partition_id()))
    width = sum(ks)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, at = np.zeros(2 * width), None
        for frame in batches:
            if len(frame):
                at, weights = int(frame["_range"].iloc[0]), _onehot(frame, ks)
                total += np.concatenate([weights.sum(0), (weights * frame[column].to_numpy(np.float64)[:, None]).sum(0)])
        if at is not None:
            yield pd.DataFrame({"range": [at], "total": [total]})

    # One row per range: 50,000 times fewer than tuples.
    found = ranged.mapInPandas(summed, "range int, total array<double>").collect()
    totals = np.zeros((parts, 2, width))
    for at, total in found:
        totals[at] = np.array(total).reshape(2, width)
    before, whole = np.cumsum(totals, axis=0) - totals, totals.sum(0)

    def added(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carried = None
        for frame in batches:
            if not len(frame):
                continue
            if carried is None:
                carried = before[int(frame["_range"].iloc[0])].copy()
            x, weights = frame[column].to_numpy(np.float64)[:, None], _onehot(frame, ks)
            counts, masses = np.cumsum(weights, axis=0) + carried[0], np.cumsum(weights * x, axis=0) + carried[1]
            carried = np.stack([counts[-1], masses[-1]])
            sums = (x * (2 * counts - whole[0]) + whole[1] - 2 * masses) / scale
            yield frame.assign(**{SUMS: list(np.stack(frame[SUMS].to_numpy()) + sums)}).drop(columns="_range")

    return ranged.mapInPandas(added, rows.schema)


def _add_categorical(rows: DataFrame, column: str, sizes: list[list[int]]) -> DataFrame:
    """Adds the rows of each cluster with another value to the array of sums."""
    ks = [len(s) for s in sizes]
    flat = [n for s in sizes for n in s]
    starts = F.array(*[F.lit(s) for s in offsets(ks)[:-1]])
    placed = rows.select(column, WEIGHT, F.posexplode(F.zip_with(LABELS, starts, lambda a, b: a + b)).alias("labelling", "place"))
    per_place = placed.groupBy(column, "place").agg(F.sum(WEIGHT).alias("n"))
    # At most one entry per cluster of all labellings.
    counts = per_place.groupBy(column).agg(F.map_from_entries(F.collect_list(F.struct("place", "n"))).alias("_counts"))
    apart = F.transform(F.sequence(F.lit(0), F.lit(len(flat) - 1)), lambda i: F.element_at(F.array(*[F.lit(n) for n in flat]), i + 1)
                        - F.coalesce(F.element_at("_counts", i), F.lit(0)))
    others = counts.select(column, apart.alias("_apart"))
    few = settle(others)
    small = few.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(few), column) if small else spread_join(rows, few, column, "inner")
    return joined.select(*[F.zip_with(SUMS, "_apart", lambda a, b: a + b).alias(SUMS) if c == SUMS else F.col(c) for c in rows.columns])


def separable_sums(labelled: DataFrame, scales: dict[str, float], categorical: list[str], sizes: list[list[int]], count: int) -> DataFrame:
    """Tuples with `_sums`: summed distance to each cluster of each labelling, times the number of features."""
    ks = [len(s) for s in sizes]
    rows = labelled.withColumn(SUMS, F.array_repeat(F.lit(0.0), sum(ks)))
    for c, scale in scales.items():
        if scale:
            rows = _add_numeric(rows, c, float(scale), ks, count)
    for c in categorical:
        rows = _add_categorical(rows, c, sizes)
    return rows


def silhouettes(sums: DataFrame, sizes: list[list[int]]) -> list[float]:
    """Mean silhouette of every labelling from tuples with `_sums`; the scale of the sums does not matter.

    A tuple in a cluster of one row counts 0. A labelling must have two clusters that are not empty.
    """
    ks = [len(s) for s in sizes]
    starts = offsets(ks)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, weight = np.zeros(len(ks)), 0.0
        for frame in batches:
            if not len(frame):
                continue
            w, every = frame[WEIGHT].to_numpy(np.float64), np.arange(len(frame))
            gaps, given = np.stack(frame[SUMS].to_numpy()), np.stack(frame[LABELS].to_numpy())
            weight += w.sum()
            for i, size in enumerate(sizes):
                mine, label = gaps[:, starts[i]:starts[i + 1]], given[:, i]
                n = np.array(size, np.float64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    inner = mine[every, label] / (n[label] - 1)
                    outer = mine / n
                    outer[:, n == 0] = np.inf
                    outer[every, label] = np.inf
                    outer = outer.min(1)
                    one = (outer - inner) / np.maximum(inner, outer)
                total[i] += (w * np.where((n[label] > 1) & np.isfinite(one), one, 0.0)).sum()
        if weight:
            yield pd.DataFrame({"place": np.arange(len(ks) + 1), "total": np.append(total, weight)})

    found = dict(sums.select(WEIGHT, LABELS, SUMS).mapInPandas(scored, "place int, total double").groupBy("place").agg(F.sum("total")).collect())
    return [found[i] / found[len(ks)] for i in range(len(ks))]
