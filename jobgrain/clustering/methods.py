"""Ways to fit that a sweep can take, and what they fit.

A method has a name, the metric that scores its labels, how often to restart, and
`fit`, which gets all wanted runs at once. The three built in share `fused`, so all
their runs move in the same passes. `Alone` makes a method of any function
`fit(tuples, k) -> (labels, cost)`.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.clustering import fused, prototypes, quadtree, scoring
from jobgrain.clustering.features import CLUSTER, FeatureSet, tuples_of
from jobgrain.clustering.silhouette import skip_reason
from jobgrain.operators.scale import settle

EUCLIDEAN, HAMMING, GOWER = "euclidean", "hamming", "gower"
TASK_ROWS = 100_000


@dataclass(frozen=True)
class Fit:
    """One labelling rule: centroids in encoded units, or, for other methods, the labels of all tuples."""
    method_name: str
    k: int
    centroids: list[dict]
    gamma: float
    cost: float
    iterations: int = 0
    converged: bool = True
    history: tuple[float, ...] = ()
    labels: DataFrame | None = field(default=None, compare=False)


@dataclass(frozen=True)
class Data:
    """Encoded distinct tuples with weights, settled over all cores, and their features."""
    tuples: DataFrame
    features: FeatureSet
    count: int
    gamma: float

    @staticmethod
    def of(df: DataFrame, features: FeatureSet) -> "Data":
        found = settle(tuples_of(df, features))
        count = found.count()
        parts = max(df.sparkSession.sparkContext.defaultParallelism, -(-count // TASK_ROWS))
        # The exchange that made the tuples may have left them in a few tasks. In order, neighbours have the same label in a fit.
        order = features.categorical + features.numeric
        return Data(settle(found.repartitionByRange(parts, *order).sortWithinPartitions(*order)), features, count, prototypes.default_gamma(features))

    def labelled(self, fits: list[Fit]) -> DataFrame:
        """Tuples with an array of labels, in the order of the fits."""
        ruled = [(f.centroids, f.gamma) for f in fits if f.labels is None]
        out, place = fused.labels(self.tuples, self.features, ruled, "_ruled"), 0
        columns = []
        for i, f in enumerate(fits):
            if f.labels is None:
                columns.append(F.col("_ruled")[place])
                place += 1
            else:
                out = out.join(f.labels.select(*self.features.columns, F.col(CLUSTER).cast("int").alias(f"_given{i}")), self.features.columns)
                columns.append(F.col(f"_given{i}"))
        return settle(out.select(*self.tuples.columns, F.array(*columns).alias(scoring.LABELS)))

    def scores(self, fits: list[Fit], metric: str) -> list[tuple[float | None, str | None]]:
        """(silhouette, None) or (None, reason) of each fit; all that can be scored share their passes."""
        if not fits:
            return []
        labelled = self.labelled(fits)
        sizes = scoring.cluster_sizes(labelled, [f.k for f in fits])
        reasons = [skip_reason(s) for s in sizes]
        kept = [i for i, r in enumerate(reasons) if r is None]
        if not kept:
            return [(None, r) for r in reasons]
        rows = labelled.withColumn(scoring.LABELS, F.array(*[F.col(scoring.LABELS)[i] for i in kept]))
        mine, f = [sizes[i] for i in kept], self.features
        if metric == EUCLIDEAN and len(f.numeric) == 2:
            sums = quadtree.plane_sums(rows, *f.numeric, [len(s) for s in mine])
        elif metric == EUCLIDEAN:
            if len(f.numeric) != 1 or f.categorical:
                raise ValueError("the Euclidean silhouette takes one or two numeric features")
            sums = scoring.separable_sums(rows, {f.numeric[0]: 1.0}, [], mine, self.count)
        else:
            sums = scoring.separable_sums(rows, {c: f.moments[c].z_range for c in f.numeric}, f.categorical, mine, self.count)
        found = dict(zip(kept, scoring.silhouettes(sums, mine)))
        return [(found.get(i), r) for i, r in enumerate(reasons)]


class Method(Protocol):
    """What a sweep needs of a method. `restarts` serve the search for k, `final_restarts` the fit that is returned."""
    name: str
    metric: str
    restarts: int
    final_restarts: int

    def fit(self, data: Data, runs: list[fused.Run]) -> dict[fused.Run, Fit]:
        """Fits by (k, restart); a run with more clusters than distinct tuples is never asked for."""


def _fits(name: str, data: Data, starts: dict[fused.Run, fused.Centroids], max_iter: int, tolerance: float = 0.0) -> dict[fused.Run, Fit]:
    found = fused.fit(data.tuples, data.features, starts, data.gamma, max_iter, tolerance)
    return {run: Fit(name, run[0], r.centroids, data.gamma, r.cost, r.iterations, r.converged, r.history) for run, r in found.items()}


@dataclass(frozen=True)
class KMeans:
    """Numeric features; every restart draws its own seeds."""
    name: str = "K-Means"
    metric: str = EUCLIDEAN
    restarts: int = 3
    final_restarts: int = 10
    seed: int = 42
    max_iter: int = 300
    tolerance: float = 1e-4

    def fit(self, data: Data, runs: list[fused.Run]) -> dict[fused.Run, Fit]:
        wanted = sorted({r for _, r in runs})
        seeds = dict(zip(wanted, fused.spread_seeds(data.tuples, data.features, max(k for k, _ in runs), wanted, self.seed)))
        return _fits(self.name, data, {(k, r): seeds[r][:k] for k, r in runs}, self.max_iter, self.tolerance)


@dataclass(frozen=True)
class KModes:
    """Categorical features. The seeds are the densest spread-out tuples, so all restarts would be equal: one is made."""
    name: str = "K-Modes"
    metric: str = HAMMING
    restarts: int = 1
    final_restarts: int = 1
    max_iter: int = prototypes.MAX_ITER

    def fit(self, data: Data, runs: list[fused.Run]) -> dict[fused.Run, Fit]:
        dense = settle(prototypes.with_density(data.tuples, data.features))
        seeds = fused.cao_seeds(dense, data.features, max(k for k, _ in runs), data.gamma)
        return _fits(self.name, data, {run: seeds[:run[0]] for run in runs}, self.max_iter)


@dataclass(frozen=True)
class KPrototypes:
    """Mixed features. The first restart starts at the seed tuples, others keep their categories and draw the numbers anew."""
    name: str = "K-Prototypes"
    metric: str = GOWER
    restarts: int = 1
    final_restarts: int = 3
    seed: int = 42
    max_iter: int = prototypes.MAX_ITER

    def fit(self, data: Data, runs: list[fused.Run]) -> dict[fused.Run, Fit]:
        dense, most = settle(prototypes.with_density(data.tuples, data.features)), max(k for k, _ in runs)
        seeds = fused.cao_seeds(dense, data.features, most, data.gamma)

        def start(k: int, restart: int) -> fused.Centroids:
            if not restart:
                return seeds[:k]
            columns = sorted(data.features.numeric)
            drawn = np.random.default_rng(self.seed + restart).standard_normal((most, len(columns)))  # scaled features: mean 0, deviation 1
            return [{**s, **dict(zip(columns, map(float, d)))} for s, d in zip(seeds[:k], drawn)]

        return _fits(self.name, data, {run: start(*run) for run in runs}, self.max_iter)


@dataclass(frozen=True)
class Alone:
    """A method of any function `fit(tuples, k) -> (labels, cost)`, called once for each run.

    `tuples` has the encoded features and their weight `w`; `labels` gives a `cluster` from 0 to k - 1 to each of them.
    """
    name: str
    metric: str
    fit_one: Callable[[DataFrame, int], tuple[DataFrame, float]]
    restarts: int = 1
    final_restarts: int = 1

    def fit(self, data: Data, runs: list[fused.Run]) -> dict[fused.Run, Fit]:
        found = {}
        for run in runs:
            labels, cost = self.fit_one(data.tuples, run[0])
            found[run] = Fit(self.name, run[0], [], data.gamma, cost, labels=settle(labels.select(*data.features.columns, CLUSTER)))
        return found


def by_types(features: FeatureSet) -> Method:
    """K-Means for numeric features only, K-Modes for categorical ones only, K-Prototypes for both."""
    if not features.categorical:
        return KMeans()
    return KPrototypes() if features.numeric else KModes()
