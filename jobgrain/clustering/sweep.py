"""Choice of method and of k."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.clustering.features import CLUSTER, FeatureSet, assign, measure, resolve, split_types
from jobgrain.clustering.methods import Data, Fit, Method, by_types
from jobgrain.operators.scale import spread_join

RUNS = "method_name string, k int, silhouette_score double, skipped_reason string, iterations int, converged boolean, cost double"


@dataclass(frozen=True)
class Sweep:
    features: FeatureSet
    runs: DataFrame
    best: Fit
    best_score: float

    def label(self, df: DataFrame, encoded_prefix: str = "_z_") -> DataFrame:
        """Kept rows of `df` with their cluster: a row-local projection, or a join for methods without centroids."""
        return label_rows(df, self.features, self.best, encoded_prefix)

    def summary(self) -> DataFrame:
        return self.runs.sparkSession.createDataFrame(
            [(self.best.method_name, self.best.k, float(self.best_score))],
            "method_name string, n_clusters int, silhouette_score double")


def best_k(runs: DataFrame) -> DataFrame:
    """The run of greatest score, the lowest k on a tie (K4)."""
    pick = F.max(F.struct("silhouette_score", (-F.col("k")).alias("_k"), "k"))
    return (runs.where(F.col("silhouette_score").isNotNull()).agg(pick.alias("_r"))
            .select("_r.k", "_r.silhouette_score"))


def label_rows(df: DataFrame, features: FeatureSet, fit: Fit, prefix: str = "_z_") -> DataFrame:
    kept = df.dropna(how="any", subset=features.columns)
    renamed = {c: f"{prefix}{c}" for c in features.columns}
    encoded = kept.withColumns({
        **{renamed[c]: features.moments[c].z(F.col(c)) for c in features.numeric},
        **{renamed[c]: F.col(c).cast("string") for c in features.categorical}})
    aliased = FeatureSet([renamed[c] for c in features.numeric], [renamed[c] for c in features.categorical])
    if fit.labels is not None:
        given = fit.labels.select(*[F.col(c).alias(renamed[c]) for c in features.columns], CLUSTER)
        return spread_join(encoded, given, list(renamed.values()), "inner").drop(*renamed.values())
    centroids = [{renamed[c]: v for c, v in m.items()} for m in fit.centroids]
    return assign(encoded, aliased, centroids, fit.gamma).drop(*renamed.values())


def sweep(df: DataFrame, selected: list[str], ks=range(2, 13), restarts: int | None = None,
          final_restarts: int | None = None, pin: int | None = None, method: Method | None = None) -> Sweep:
    """Fit every k, score it, refit the best (first on a tie), or the pinned one.

    `selected` are feature labels or column names, in any order. The method follows from their types unless one is given,
    and brings its own restarts unless they are given: of several the one of least cost counts. All k and restarts move
    through the tuples together, and all labels are scored together. `runs` says of each k how many iterations it took and
    whether it settled before the limit. Only k-sized results reach the driver; a k that cannot be fitted or scored is
    reported with its reason.
    """
    chosen = split_types(resolve(selected))
    if not chosen.categorical:  # centroids are sums over features, whose order must not matter
        chosen = split_types(sorted(resolve(selected)))
    features = measure(df, chosen)
    method, data, ks = method or by_types(features), Data.of(df, features), list(ks)
    restarts = method.restarts if restarts is None else restarts
    final_restarts = method.final_restarts if final_restarts is None else final_restarts

    def fitted(wanted: list[int], tries: range) -> dict[tuple[int, int], Fit]:
        runs = [(k, r) for k in wanted for r in tries if k <= data.count]
        return method.fit(data, runs) if runs else {}

    every = fitted(ks, range(restarts))
    best = {k: min((f for run, f in every.items() if run[0] == k), key=lambda f: f.cost) for k in ks if k <= data.count}
    scored = dict(zip(best, data.scores(list(best.values()), method.metric)))
    rows = []
    for k in ks:
        fit, (score, reason) = best.get(k), scored.get(k, (None, "more clusters than distinct tuples"))
        rows.append((method.name, k, score, reason, fit and fit.iterations, fit and fit.converged, fit and fit.cost))

    best_k, best_score = ks[0], -1.0
    for _, k, score, *_ in rows:
        if score is not None and score > best_score:
            best_k, best_score = k, score
    if pin is not None:
        best_k, best_score = pin, next((s for _, k, s, *_ in rows if k == pin and s is not None), -1.0)
    # Restarts that the search has made already are not made again.
    done = restarts if best_k in best else 0
    last = [f for run, f in every.items() if run[0] == best_k] + list(fitted([best_k], range(done, final_restarts)).values())
    if not last:
        raise ValueError(f"{best_k} clusters need at least as many distinct tuples")
    return Sweep(features, df.sparkSession.createDataFrame(rows, RUNS), min(last, key=lambda f: f.cost), max(best_score, 0.0))
