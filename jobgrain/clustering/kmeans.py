"""K-Means on weighted numeric tuples through Spark ML."""

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame

from jobgrain.clustering import prototypes
from jobgrain.clustering.features import WEIGHT, FeatureSet


def as_vectors(tuples: DataFrame, features: FeatureSet) -> DataFrame:
    """Components in the order of their names, so that a fit does not depend on the order of the selection."""
    return VectorAssembler(inputCols=sorted(features.numeric), outputCol="_v").transform(tuples)


def fit(vectors: DataFrame, features: FeatureSet, k: int, restarts: int, seed: int = 42,
        max_iter: int = 300) -> tuple[list[dict], float]:
    """Best of `restarts` fits by training cost; centroids as plain rows."""
    return fit_reported(vectors, features, k, restarts, seed, max_iter)[:2]


def fit_reported(vectors: DataFrame, features: FeatureSet, k: int, restarts: int, seed: int = 42,
                 max_iter: int = 300) -> tuple[list[dict], float, int, bool]:
    """Best of `restarts` fits by training cost: centroids as plain rows, cost, iterations, whether it settled."""
    if k == 1:  # below what Spark ML accepts
        centroids, cost, _ = prototypes.fit(vectors, features, [dict.fromkeys(features.numeric, 0.0)], 1.0)
        return centroids, cost, 1, True
    best = None
    for i in range(restarts):
        model = KMeans(k=k, seed=seed + i, featuresCol="_v", weightCol=WEIGHT, maxIter=max_iter,
                       tol=1e-4, initMode="k-means||").fit(vectors)
        cost = model.summary.trainingCost
        if best is None or cost < best[1]:
            best = ([dict(zip(sorted(features.numeric), map(float, c))) for c in model.clusterCenters()], cost,
                    model.summary.numIter, model.summary.numIter < max_iter)
    return best
