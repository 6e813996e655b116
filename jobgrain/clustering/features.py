"""Feature tuples (C0, P35, P36) and row-local distances to literal centroids."""

from dataclasses import dataclass, field
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobgrain import fixed_values as V
from jobgrain.operators.filters import with_features
from jobgrain.operators.statistics import moments

WEIGHT = "w"
CLUSTER = "cluster"


@dataclass(frozen=True)
class Feature:
    """A numeric feature's moments over the kept rows, as plain numbers."""
    mean: float
    std: float
    low: float
    high: float

    def z(self, c: Column) -> Column:
        if not self.std:
            return F.lit(0.0)
        return (c.cast("double") - F.lit(self.mean)) / F.lit(self.std)

    @property
    def z_range(self) -> float:
        return (self.high - self.low) / self.std if self.std else 0.0


@dataclass(frozen=True)
class FeatureSet:
    numeric: list[str]
    categorical: list[str]
    moments: dict[str, Feature] = field(default_factory=dict)

    @property
    def columns(self) -> list[str]:
        return self.numeric + self.categorical

    def encode(self, df: DataFrame) -> DataFrame:
        """Scaled numerics and text categoricals, in place."""
        return df.withColumns({**{c: self.moments[c].z(F.col(c)) for c in self.numeric},
                               **{c: F.col(c).cast("string") for c in self.categorical}})


def resolve(labels: list[str], table: dict[str, str] = V.FEATURE_LABELS) -> list[str]:
    """Columns of the selected features, given by label or by column name."""
    if not labels:
        raise ValueError("no features selected")
    return [table.get(label, label) for label in labels]


def split_types(columns: list[str], numeric=V.NUMERIC_FEATURES) -> FeatureSet:
    return FeatureSet([c for c in columns if c in numeric], [c for c in columns if c not in numeric])


def measure(df: DataFrame, features: FeatureSet) -> FeatureSet:
    """Fill in the moments: one aggregate, one row to the driver."""
    kept = with_features(df, features.columns)
    counted = moments(kept, features.numeric) if features.numeric else kept
    row = (kept.agg(F.count(F.lit(1)).alias("n")).first() if not features.numeric
           else counted.first())
    if (not features.numeric and row["n"] == 0) or (
            features.numeric and row[f"{features.numeric[0]}_mean"] is None):
        raise ValueError("no rows left after dropping missing features")
    found = {c: Feature(row[f"{c}_mean"], row[f"{c}_std"], row[f"{c}_min"], row[f"{c}_max"])
             for c in features.numeric}
    return FeatureSet(features.numeric, features.categorical, found)


def collapse(df: DataFrame, columns: list[str], extra: list[str] = ()) -> DataFrame:
    """Distinct tuples with their row count; partial sums shrink hot tuples first."""
    return df.groupBy(*columns, *extra).agg(F.count(F.lit(1)).alias(WEIGHT))


def tuples_of(df: DataFrame, features: FeatureSet) -> DataFrame:
    """Encoded distinct tuples of the rows that have all features."""
    kept = with_features(df, features.columns).select(*features.columns)
    return features.encode(collapse(kept, features.columns))


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _distance_sql(features: FeatureSet, centroid: dict, gamma: float) -> str:
    squares = [f"(`{c}` - ({float(centroid[c])!r}D)) * (`{c}` - ({float(centroid[c])!r}D))" for c in features.numeric]
    misses = [f"if(`{c}` = {_text(centroid[c])}, 0D, {float(gamma)!r}D)" for c in features.categorical]
    return " + ".join(squares + misses)


def distance(features: FeatureSet, centroid: dict, gamma: float) -> Column:
    """Squared Euclidean on numerics plus gamma times the mismatches.

    Built as SQL text: a fit plans this for k centroids in every iteration, and
    one parse is much cheaper than a call per operator.
    """
    return F.expr(_distance_sql(features, centroid, gamma))


def nearest(features: FeatureSet, centroids: list[dict], gamma: float) -> Column:
    """struct(d, cid) of the nearest centroid, the lowest id on a tie."""
    return F.expr("array_min(array({}))".format(", ".join(
        f"named_struct('d', {_distance_sql(features, m, gamma)}, 'cid', {i})" for i, m in enumerate(centroids))))


def assign(df: DataFrame, features: FeatureSet, centroids: list[dict], gamma: float) -> DataFrame:
    """Label column on encoded rows or tuples, without a join."""
    return (df.withColumn("_near", nearest(features, centroids, gamma))
            .withColumn(CLUSTER, F.col("_near.cid")).drop("_near"))


def gower(a: dict[str, Column], b: dict[str, Column], ranges: dict[str, float],
          categorical: list[str]) -> Column:
    """Mean over features of |difference| / range, or 0/1 mismatch.

    A constant numeric (range 0) contributes 0.
    """
    terms = [F.abs(a[c] - b[c]) / F.lit(r) if r else F.lit(0.0) for c, r in ranges.items()]
    terms += [(a[c] != b[c]).cast("double") for c in categorical]
    return reduce(add, terms) / F.lit(float(len(terms)))
