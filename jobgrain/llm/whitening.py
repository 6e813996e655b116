"""Whitening of embeddings: pivoted Cholesky of the centred scatter, then one-sided Jacobi on the triangular factor.

The scatter A of n distinct whole vectors is summed exactly about an integer centre.
P A P' = L L' by Cholesky with the largest remaining pivot first; rotations from the
right make the columns of L orthogonal without ever forming another product. Then
L J = U D, so A has the eigenvalues D squared and the normalised columns U.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import settle
from jobgrain.llm.vectors import shape, stacked, totals, whole

SCALE = 64
OFFSET = 1_000_000
COMPONENTS = 16
SWEEPS = 60
# Rows whose products are summed at once as doubles, which hold whole numbers up to 2**53 exactly.
CHUNK = 4_096


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """L with a = L L', rows in the order of `a`; columns stop where the rest is rounding, so their number is the rank."""
    left, order = a.astype(np.longdouble).copy(), []
    columns, largest = [], left.diagonal().max(initial=0)
    for _ in range(len(a)):
        diagonal = left.diagonal().copy()
        diagonal[order] = -1
        pivot = int(diagonal.argmax()) if len(a) else 0
        if diagonal[pivot] <= largest * len(a) * np.finfo(np.float64).eps:
            break
        column = left[:, pivot] / np.sqrt(left[pivot, pivot])
        column[order] = 0
        left -= np.outer(column, column)
        order.append(pivot)
        columns.append(column)
    return np.stack(columns, 1) if columns else np.zeros((len(a), 0), np.longdouble)


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and unit eigenvectors (columns) of factor factor', by rotating pairs of columns.

    The pairs of a sweep are played as a tournament, so the columns of a step are disjoint and turn together.
    """
    g = factor.astype(np.longdouble).copy()
    if g.shape[1] % 2:
        g = np.pad(g, ((0, 0), (0, 1)))  # a column of zeros turns with nothing
    half, tiny = g.shape[1] // 2, np.finfo(np.longdouble).eps
    seats = np.arange(g.shape[1])
    for _ in range(SWEEPS if half else 0):
        turned = False
        for _ in range(max(1, 2 * half - 1)):
            p, q = seats[:half], seats[half:][::-1]
            a, b, c = (g[:, p] ** 2).sum(0), (g[:, q] ** 2).sum(0), (g[:, p] * g[:, q]).sum(0)
            open_ = np.abs(c) > tiny * np.sqrt(a * b)
            if open_.any():
                turned = True
                zeta = (b[open_] - a[open_]) / (2 * c[open_])
                t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
                cosine = 1 / np.sqrt(1 + t * t)
                x, y = g[:, p[open_]], g[:, q[open_]]
                g[:, p[open_]], g[:, q[open_]] = cosine * x - cosine * t * y, cosine * t * x + cosine * y
            seats = np.concatenate([seats[:1], seats[-1:], seats[1:-1]])
        if not turned:
            break
    norms = np.sqrt((g * g).sum(0))
    kept = np.argsort(-norms, kind="stable")[:factor.shape[1]]
    kept = kept[norms[kept] > 0]
    return norms[kept] ** 2, g[:, kept] / norms[kept]


class Whitening:
    """What is fitted: n distinct vectors, their exact sums, and the components with their eigenvalues."""

    def __init__(self, n: int, sums: list[int], scatter: np.ndarray, centre: np.ndarray, components: int):
        self.n, self.sums, self.centre = n, sums, centre
        self.rest = np.array([s - n * int(c) for s, c in zip(sums, centre)], object)  # sums about the centre
        # n times the scatter about the mean, in whole numbers: nothing is lost before the one division.
        exact = n * scatter - np.outer(self.rest, self.rest)
        # In two steps, since a whole number may have more digits than a long double.
        high = exact // (n * n)
        covariance = high.astype(np.longdouble) + (exact - high * (n * n)).astype(np.longdouble) / (np.longdouble(n) * n)
        values, vectors = one_sided_jacobi(pivoted_cholesky(covariance))
        trace = covariance.trace()
        self.values, self.vectors = values[:components], vectors[:, :components]
        self.explained = [float(v / trace) for v in self.values]
        self.means = (self.rest.astype(np.longdouble) / n).astype(np.float64)  # about the centre
        self.project = (self.vectors / np.sqrt(self.values)).astype(np.float64)

    def whitened(self, matrix: np.ndarray) -> np.ndarray:
        return ((matrix - self.centre).astype(np.float64) - self.means) @ self.project

    def deviations(self, matrix: np.ndarray) -> list[int | None]:
        """Sum of (n x - S)^2 of each row, exact; None where it does not fit in a long."""
        about = matrix - self.centre
        largest = int(max(np.abs(about).max(initial=0), np.abs(self.rest).max(initial=0)))
        if 4 * self.n * self.n * (largest + 1) ** 2 * max(1, matrix.shape[1]) < 1 << 62:
            gaps = self.n * about.astype(np.int64) - self.rest.astype(np.int64)
        else:
            gaps = self.n * about.astype(object) - self.rest
        return [int(s) if s < 1 << 63 else None for s in (gaps * gaps).sum(1)]


def fit(distinct: DataFrame, n: int, dims: int, largest: int, components: int = COMPONENTS) -> Whitening:
    """Components of the distinct whole vectors `x`, from two passes: sums, then the scatter about their rounded mean."""
    sums = totals(distinct, lambda batch: stacked(batch["x"], dims, True).sum(0), dims).tolist()
    centre = np.array([round(s / n) if n else 0 for s in sums], np.int64)

    def scatter(batch: pd.DataFrame) -> np.ndarray:
        total = np.zeros((dims, dims), object)
        about = stacked(batch["x"], dims, largest >= 1 << 61) - centre
        for i in range(0, len(about), CHUNK):
            part = about[i:i + CHUNK]
            if len(part) * int(np.abs(part).max(initial=0)) ** 2 < 1 << 53:
                part = part.astype(np.float64)
                total += (part.T @ part).astype(np.int64).astype(object)
            else:
                part = part.astype(object)
                total += part.T @ part
        return total.ravel()

    about = totals(distinct, scatter, dims * dims).reshape(dims, dims)
    return Whitening(n, sums, about, centre, components)


def identity_error(distinct: DataFrame, fitted: Whitening, dims: int) -> float:
    """Largest absolute entry of the covariance of the whitened fit list less the identity, measured over all of it."""
    size = len(fitted.values)

    def moments(batch: pd.DataFrame) -> np.ndarray:
        white = fitted.whitened(stacked(batch["x"], dims, False))
        return np.concatenate([white.sum(0), (white.T @ white).ravel()])

    sums = totals(distinct, moments, size + size * size).astype(np.float64)
    mean, square = sums[:size] / fitted.n, sums[size:].reshape(size, size) / fitted.n
    return float(np.abs(square - np.outer(mean, mean) - np.eye(size)).max(initial=0))


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, offset: int = OFFSET,
           id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained and identity_error: one row per vector and component.

    Vectors become whole numbers; each distinct one is fitted once, so repeats have no weight. Null vectors and vectors with
    a null or non-finite component take no part. Rows with a null or repeated id are all returned. There are no more
    components than the rank of the covariance (what is below the rounding of its largest entry is zero): where all vectors
    are equal there are none, and no rows. Components of equal eigenvalue are any orthogonal ones of their space, the same
    for all rows. deviation is exact, and null where it does not fit in a long. Vectors of different lengths raise a
    ValueError, components beyond 2**62 an ArithmeticError. Extra columns are not looked at. An empty table gives an empty
    result.
    """
    rows = settle(vectors.select(F.col(id_column).alias("id"), whole(F.col(vector), scale, offset).alias("x")).where("x is not null"))
    _, dims, largest = shape(rows, "x")
    distinct = settle(rows.select("x").distinct())
    n = distinct.count()
    fitted = fit(distinct, n, dims, largest, components) if n else None
    size = len(fitted.values) if fitted else 0
    error = identity_error(distinct, fitted, dims) if size else 0.0

    @F.pandas_udf("deviation long, white array<double>")
    def made(lists: pd.Series) -> pd.DataFrame:
        matrix = stacked(lists, dims, False)
        return pd.DataFrame({"deviation": pd.array(fitted.deviations(matrix), "Int64"), "white": list(fitted.whitened(matrix))})

    out = rows.where(F.lit(size > 0)).select("id", made("x").alias("m")).select("id", "m.deviation", F.posexplode("m.white").alias("at", "whitened"))
    shares = F.array(*[F.lit(e) for e in fitted.explained]) if size else F.array(F.lit(0.0))
    return out.select(F.col("id").alias(id_column), (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
                      "whitened", F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
