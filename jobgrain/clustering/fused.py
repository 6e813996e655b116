"""Many centroid fits at once: every pass over the tuples serves all k and restarts that still move.

A run is one fit, named by (k, restart). One pass assigns each tuple to its nearest
centroid in every run and hands on weighted sums and value counts, which Spark adds
up; the driver holds nothing but centroids. A run that has settled leaves the pass,
so a sweep costs as many passes as its longest fit, not their sum.

Tuples that follow each other with equal categories act as a block. The tuples nearest to
one centroid form a convex set, so if all corners of a block's box have the same label,
the whole block has it, and its sums do; only the blocks on a border are taken tuple by
tuple. Where tuples come in order, as from `methods.Data`, that is nearly all of the work saved.
Blocks are made once in a fit and written as pages, which a pass reads without making rows of them.
"""

import pickle
from dataclasses import dataclass
from itertools import product
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.clustering.features import WEIGHT, FeatureSet
from jobgrain.operators.scale import few_values, setting, settle
from jobgrain.schema import with_fields

Run = tuple[int, int]
Centroids = list[dict]
# Rows of a pass that are sums, not value counts.
SIZE, COST = -1, -2
SETTLED = 1e-12
# Up to this many tasks, and values of a categorical, the sums of the tasks are collected; else Spark adds them up.
FEW_TASKS, FEW_VALUES = 64, 200
# Tuples of a block and of a page at most, the most numeric features (a box has 2 ** n corners), and the pages handed to Python at once.
BLOCK, PAGE_ROWS, BOXED, PAGES = 64, 50_000, 3, 4
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@dataclass(frozen=True)
class Result:
    """A fitted run: centroids in encoded units, the cost of assigning to them, and how it ended."""
    centroids: Centroids
    cost: float
    iterations: int
    converged: bool
    history: tuple[float, ...] = ()


class Batch:
    """Tuples of one Arrow batch as matrices; categoricals as numbers of their values in the batch."""

    def __init__(self, batch: pd.DataFrame, features: FeatureSet):
        self.features = features
        self.numeric = batch[features.numeric].to_numpy(np.float64) if features.numeric else np.empty((len(batch), 0))
        self.weight = batch[WEIGHT].to_numpy(np.float64)
        self.codes, self.values = [], []
        for c in features.categorical:
            codes, values = pd.factorize(batch[c])
            self.codes.append(codes)
            self.values.append(values)

    def __len__(self) -> int:
        return len(self.weight)

    def at(self, rows: np.ndarray, numeric: np.ndarray | None = None, weight: np.ndarray | None = None) -> "Batch":
        """Some of the tuples, or others with their categories."""
        out = object.__new__(Batch)
        out.features, out.values, out.codes = self.features, self.values, [codes[rows] for codes in self.codes]
        out.numeric = self.numeric[rows] if numeric is None else numeric
        out.weight = self.weight[rows] if weight is None else weight
        return out

    def distances(self, centroids: Centroids, gamma: float) -> np.ndarray:
        """Squared Euclidean plus gamma times the mismatches, tuples x centroids."""
        out = np.zeros((len(self), len(centroids)))
        for j, c in enumerate(self.features.numeric):
            gap = self.numeric[:, j, None] - np.array([float(m[c]) for m in centroids])
            out += gap * gap
        for codes, values, c in zip(self.codes, self.values, self.features.categorical):
            place = {v: i for i, v in enumerate(values)}
            wanted = np.array([place.get(m[c], -1) for m in centroids])
            out += np.where(np.arange(len(values))[:, None] == wanted, 0.0, gamma)[codes]
        return out

    def nearest(self, centroids: Centroids, gamma: float) -> tuple[np.ndarray, np.ndarray]:
        """Label (the lowest id on a tie) and distance of each tuple."""
        gaps = self.distances(centroids, gamma)
        label = gaps.argmin(1)
        return label, gaps[np.arange(len(self)), label]


class Blocks:
    """Runs of tuples with equal categories, at most BLOCK long, with their boxes, means and squares about the means."""

    def __init__(self, batch: Batch):
        first = np.zeros(len(batch), bool)
        first[::BLOCK] = True
        for codes in batch.codes:
            first[1:] |= codes[1:] != codes[:-1]
        self.batch, self.starts = batch, np.flatnonzero(first)
        self.sizes = np.diff(np.append(self.starts, len(batch)))
        weight, mass = batch.weight[:, None], batch.weight[:, None] * batch.numeric
        total = np.add.reduceat(batch.weight, self.starts)
        low, high = (f.reduceat(batch.numeric, self.starts) for f in (np.minimum, np.maximum))
        mean = np.clip(np.add.reduceat(mass, self.starts) / total[:, None], low, high)
        self.within = np.add.reduceat((weight * (batch.numeric - np.repeat(mean, self.sizes, 0)) ** 2).sum(1), self.starts)
        self.mean = batch.at(self.starts, mean, total)
        self.corners = [batch.at(self.starts, np.where(at, high, low), total) for at in product((False, True), repeat=mean.shape[1])]

    @staticmethod
    def of(batch: Batch) -> "Blocks | None":
        """None where blocks would save nothing: the tuples have no order, many categories or too many numbers."""
        if not 0 < len(batch.features.numeric) <= BOXED or len(batch) < 2 * BLOCK:
            return None
        found = Blocks(batch)
        return found if 8 * len(found.starts) <= len(batch) else None

    def labelled(self, listed: list[Centroids], gamma: float) -> Iterator[tuple[Batch, np.ndarray, np.ndarray]]:
        """Per run: whole blocks at their means and the tuples of all others, their labels, and what each adds to the cost."""
        flat = [c for centroids in listed for c in centroids]
        corners = [c.distances(flat, gamma) for c in self.corners]
        means, start = self.mean.distances(flat, gamma), 0
        for centroids in listed:
            mine = slice(start, start + len(centroids))
            labels = [c[:, mine].argmin(1) for c in corners]
            whole = np.logical_and.reduce([labels[0] == label for label in labels])
            rows, blocks = np.flatnonzero(np.repeat(~whole, self.sizes)), np.flatnonzero(whole)
            single = self.batch.at(rows)
            label, gap = single.nearest(centroids, gamma)
            common = labels[0][blocks]
            units = self.batch.at(np.concatenate([self.starts[blocks], rows]), np.concatenate([self.mean.numeric[blocks], single.numeric]),
                                  np.concatenate([self.mean.weight[blocks], single.weight]))
            cost = np.concatenate([self.within[blocks] + self.mean.weight[blocks] * means[blocks, start + common], single.weight * gap])
            yield units, np.concatenate([common, label]), cost
            start = mine.stop


PARTIAL = "run int, cluster int, feature int, value string, total double"


def _paged(tuples: DataFrame, features: FeatureSet) -> DataFrame:
    """The tuples of each Arrow batch as one page: their blocks, or the plain batch where those would save nothing."""
    plain = FeatureSet(features.numeric, features.categorical)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            if len(frame):
                batch = Batch(frame, plain)
                yield pd.DataFrame({"page": [pickle.dumps(Blocks.of(batch) or batch, pickle.HIGHEST_PROTOCOL)]})

    with setting(tuples.sparkSession, BATCH, str(PAGE_ROWS)):
        return settle(tuples.select(*features.columns, WEIGHT).mapInPandas(pages, "page binary"))


def _labelled(page: "Blocks | Batch", listed: list[Centroids], gamma: float) -> Iterator[tuple[Batch, np.ndarray, np.ndarray]]:
    if isinstance(page, Blocks):
        yield from page.labelled(listed, gamma)
        return
    for centroids in listed:
        label, gap = page.nearest(centroids, gamma)
        yield page, label, page.weight * gap


def _partial(page: "Blocks | Batch", features: FeatureSet, listed: list[Centroids], gamma: float) -> pd.DataFrame:
    """Weighted sums and value counts of one page in every run, of the clusters that have tuples in it."""
    parts: list[tuple] = []
    for run, (units, label, cost) in enumerate(_labelled(page, listed, gamma)):
        k, numeric = len(listed[run]), len(features.numeric)
        used = np.flatnonzero(np.bincount(label, minlength=k))
        sums = [(SIZE, units.weight), (COST, cost)] + [(j, units.weight * units.numeric[:, j]) for j in range(numeric)]
        parts += [(run, feature, used, np.full(len(used), None), np.bincount(label, amount, k)[used]) for feature, amount in sums]
        for j, (codes, values) in enumerate(zip(units.codes, units.values), numeric):
            counts = np.bincount(label * len(values) + codes, units.weight, k * len(values))
            at = np.flatnonzero(counts)
            parts.append((run, j, at // len(values), np.asarray(values, object)[at % len(values)], counts[at]))
    sizes = [len(p[4]) for p in parts]
    return pd.DataFrame({"run": np.repeat([p[0] for p in parts], sizes), "cluster": np.concatenate([p[2] for p in parts]),
                         "feature": np.repeat([p[1] for p in parts], sizes), "value": np.concatenate([p[3] for p in parts]),
                         "total": np.concatenate([p[4] for p in parts])})


KEY = ["run", "cluster", "feature"]


def _pass(pages: DataFrame, features: FeatureSet, runs: dict[Run, Centroids], gamma: float, few: bool = False) -> list:
    """One pass: (run, cluster, feature, value, total), value counts reduced to the mode of each cluster.

    `few` says that the tasks are few and the categoricals have few values: then the sums of the tasks are added up on the
    driver, which saves the shuffles, most of the time of a short pass.
    """
    listed = list(runs.values())

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for page in (p for frame in batches for p in frame["page"]):
            one = _partial(pickle.loads(page), features, listed, gamma)
            if not few:
                yield one
            else:
                held = one if held is None else pd.concat([held, one]).groupby([*KEY, "value"], dropna=False, as_index=False)["total"].sum()
        if held is not None:
            yield held

    partial = pages.mapInPandas(summed, PARTIAL)
    if few:
        totals: dict[tuple, float] = {}
        for run, cluster, feature, value, total in sorted(partial.collect(), key=repr):  # a fixed order of the sums
            totals[run, cluster, feature, value] = totals.get((run, cluster, feature, value), 0.0) + total
        best: dict[tuple, tuple] = {}
        for (*key, value), total in totals.items():
            best[tuple(key)] = min(best.get(tuple(key), (np.inf, None)), (-total, value), key=lambda b: (b[0], b[1] or ""))
        return [(*key, value, -least) for key, (least, value) in best.items()]
    counted = partial.groupBy(*KEY, "value").agg(F.sum("total").alias("total"))
    # The most frequent value of each cluster and feature, the smallest on a tie; sums are single rows already.
    pick = F.min(F.struct((-F.col("total")).alias("least"), "value"))
    return counted.groupBy(*KEY).agg(pick.alias("p")).select(*KEY, "p.value", -F.col("p.least")).collect()


def fit(tuples: DataFrame, features: FeatureSet, starts: dict[Run, Centroids], gamma: float, max_iter: int,
        tolerance: float = 0.0) -> dict[Run, Result]:
    """All runs to the end: until the cost stops falling, or centroids move by less than `tolerance` (squared, summed).

    Numeric centroids are weighted means, categorical ones weighted modes; an empty cluster keeps its centroid.
    """
    tasks = tuples.select(F.spark_partition_id()).distinct().count()
    few = tasks <= FEW_TASKS and all(few_values(tuples, c, FEW_VALUES) for c in features.categorical)
    pages = _paged(tuples, features)
    moving, histories, done = dict(starts), {run: [] for run in starts}, {}
    while moving:
        with setting(tuples.sparkSession, BATCH, str(PAGES)):
            found = _pass(pages, features, moving, gamma, few)
        moved = {run: [dict(c) for c in centroids] for run, centroids in moving.items()}
        sizes: dict[tuple[Run, int], float] = {}
        sums, costs, names = [], dict.fromkeys(moving, 0.0), list(moving)
        for at, cluster, feature, value, total in found:
            run = names[at]
            if feature == SIZE:
                sizes[run, cluster] = total
            elif feature == COST:
                costs[run] += total
            elif feature < len(features.numeric):
                sums.append((run, cluster, features.numeric[feature], total))
            else:
                moved[run][cluster][features.categorical[feature - len(features.numeric)]] = value
        for run, cluster, column, total in sums:
            if sizes[run, cluster]:
                moved[run][cluster][column] = total / sizes[run, cluster]
        for run in names:
            history = histories[run]
            history.append(costs[run])
            shift = sum((new[c] - old[c]) ** 2 for new, old in zip(moved[run], moving[run]) for c in features.numeric)
            same = all(new[c] == old[c] for new, old in zip(moved[run], moving[run]) for c in features.categorical)
            stuck = len(history) > 1 and history[-1] >= history[-2] * (1 - SETTLED)
            settled = stuck or (same and shift <= tolerance)
            if settled or len(history) >= max_iter:
                done[run] = Result(moving.pop(run), costs[run], len(history), settled, tuple(history))
            else:
                moving[run] = moved[run]
    return done


def labels(tuples: DataFrame, features: FeatureSet, fits: list[tuple[Centroids, float]], column: str = "labels") -> DataFrame:
    """The tuples with an array of labels, one per fit (centroids, gamma)."""
    schema = with_fields(tuples.schema, **{column: "array<int>"})

    def labelled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            batch = Batch(frame, features)
            found = np.empty((len(frame), len(fits)), np.int32)
            for i, (centroids, gamma) in enumerate(fits):
                found[:, i] = batch.nearest(centroids, gamma)[0]
            yield frame.assign(**{column: list(found)})

    return tuples.mapInPandas(labelled, schema)


# --- seeds ------------------------------------------------------------------

def cao_seeds(dense: DataFrame, features: FeatureSet, k: int, gamma: float) -> Centroids:
    """The densest tuple, then k - 1 times the one of largest min(distance) * density; one short pass for each.

    `dense` has a `density` column. Ties go to numerics nearest the mean, then to the smallest tuple. Seeds for a smaller k
    are a prefix of these. Stops early when all distinct tuples are used.
    """
    columns = features.categorical + features.numeric
    rows = dense.select(*columns, WEIGHT, "density")
    schema = with_fields(rows.schema, score="double", spread="double")
    seeds: Centroids = []
    while len(seeds) < k:
        def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                batch = Batch(frame, features)
                gap = batch.distances(seeds, gamma).min(1) if seeds else np.ones(len(frame))
                spread = np.zeros(len(frame))
                for j in range(len(features.numeric)):
                    spread = spread + np.abs(batch.numeric[:, j])
                scored = frame.assign(score=gap * frame["density"], spread=spread)[gap > 0]
                yield scored.sort_values(["score", "spread", *columns], ascending=[False, *[True] * (1 + len(columns))]).head(1)

        found = rows.mapInPandas(best, schema).orderBy(F.desc("score"), "spread", *columns).limit(1).collect()
        if not found:
            break
        seeds.append({c: found[0][c] for c in features.numeric + features.categorical})
    return seeds


def _mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hashes of hashes and a salt (the finaliser of splitmix64)."""
    z = keys.astype(np.uint64) + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def spread_seeds(tuples: DataFrame, features: FeatureSet, k: int, restarts: list[int], seed: int = 42) -> list[Centroids]:
    """k seeds for each restart, drawn with a chance that grows with weight times squared distance to those before.

    Every tuple draws an exponential waiting time at that rate from a hash of its values, and the shortest wins. The draw does
    not depend on how tuples are dealt to tasks. One pass draws the next seed of all restarts; those of a smaller k are a prefix.
    """
    columns = list(features.numeric)
    rows = tuples.select(*columns, WEIGHT, F.xxhash64(*sorted(columns)).alias("_key"))
    schema = with_fields(tuples.select(*columns).schema, restart="int", wait="double")
    numeric = FeatureSet(columns, [])
    seeds: list[Centroids] = [[] for _ in restarts]
    while all(len(s) < k for s in seeds):
        def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in batches:
                batch, keys = Batch(frame, numeric), frame["_key"].to_numpy(np.int64).view(np.uint64)
                for r, chosen in enumerate(seeds):
                    rate = batch.weight * (batch.distances(chosen, 0.0).min(1) if chosen else 1.0)
                    chance = (_mixed(_mixed(keys, seed + restarts[r]), len(chosen)) >> np.uint64(11)).astype(np.float64) + 0.5
                    wait = -np.log(chance / 2.0 ** 53) / np.where(rate > 0, rate, np.nan)
                    if not np.isnan(wait).all():
                        at = int(np.nanargmin(wait))
                        yield frame.iloc[[at]][columns].assign(restart=r, wait=wait[at])

        first = F.min_by(F.struct(*columns), F.struct("wait", *sorted(columns)))
        found = {r["restart"]: r["s"].asDict() for r in rows.mapInPandas(drawn, schema).groupBy("restart").agg(first.alias("s")).collect()}
        if len(found) < len(restarts):  # all distinct tuples are used
            break
        for r, chosen in enumerate(seeds):
            chosen.append(found[r])
    return seeds
