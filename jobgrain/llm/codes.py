"""Vector compression: each part of a vector becomes the index of its nearest codebook entry, found by Orchard search.

Orchard search starts at some entry and follows its list of all entries by distance.
An entry nearer to the part than the current one takes its place, and its own list is
followed from the start; entries met before are not measured again. Beyond twice the
current distance no entry of a list can be nearer, by the triangle inequality, so the
search ends there. All parts of a batch move through their lists together.
"""

import hashlib
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import lookup, settle
from jobgrain.llm.vectors import shape, stacked, totals, whole

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2


class Orchard:
    """Distance-sorted neighbour lists of the entries of one codebook."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        gaps = self._squared(entries[:, None, :], entries[None, :, :])
        self.order = np.argsort(gaps, axis=1, kind="stable")
        self.gaps = np.take_along_axis(gaps, self.order, 1)

    @staticmethod
    def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        difference = a - b
        return (difference * difference).sum(-1)

    def start(self, parts: np.ndarray) -> np.ndarray:
        """An entry that is near in the first component, by bisection."""
        if not parts.shape[1] or not len(parts):
            return np.zeros(len(parts), np.int64)
        by_first = np.argsort(self.entries[:, 0], kind="stable")
        return by_first[np.minimum(np.searchsorted(self.entries[by_first, 0], parts[:, 0]), len(by_first) - 1)]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index of the nearest entry of each part, the lowest on a tie, its squared distance, and the distances computed.

        Distances stay squared, so twice the distance is four times its square. An entry as near as the current one lies
        within twice the distance too, hence ties are all met.
        """
        count, k = len(parts), len(self.entries)
        best = self.start(parts)
        near = self._squared(parts, self.entries[best])
        seen = np.zeros((count, k), bool)
        seen[np.arange(count), best] = True
        place, active, measured = np.zeros(count, np.int64), np.arange(count), count
        while len(active):
            current, at = best[active], place[active]
            open_ = (self.gaps[current, at] <= 4 * near[active]).astype(bool)
            active, met = active[open_], self.order[current, at][open_]
            place[active] += 1
            fresh = ~seen[active, met]
            rows, entry = active[fresh], met[fresh]
            seen[rows, entry] = True
            gap = self._squared(parts[rows], self.entries[entry])
            measured += len(rows)
            better = ((gap < near[rows]) | ((gap == near[rows]) & (entry < best[rows]))).astype(bool)
            moved = rows[better]
            best[moved], near[moved], place[moved] = entry[better], gap[better], 0
            active = active[place[active] < k]
        return best, near, measured


class Codebooks:
    """Entries of every part, as whole numbers: parts x entries x components."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.search = [Orchard(part) for part in entries]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()

    def assign(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes and squared distances, rows x parts."""
        width = self.entries.shape[2]
        found = [o.nearest(matrix[:, p * width:(p + 1) * width])[:2] for p, o in enumerate(self.search)]
        return np.stack([f[0] for f in found], 1), np.stack([f[1] for f in found], 1)

    def decode(self, indexes: np.ndarray) -> np.ndarray:
        """The vectors that stand for codes."""
        return np.concatenate([self.entries[p][indexes[:, p]] for p in range(len(self.entries))], 1)


def _moved(rows: DataFrame, books: Codebooks, exact: bool) -> Codebooks:
    """One round: every entry becomes the floor of the mean of its parts; an unused entry stays."""
    parts, k, width = books.entries.shape

    def summed(batch: pd.DataFrame) -> np.ndarray:
        matrix = stacked(batch["x"], parts * width, exact)
        indexes, _ = books.assign(matrix)
        sums = np.zeros((parts, k, width + 1), object)  # the last place counts
        for p in range(parts):
            mine = matrix[:, p * width:(p + 1) * width]
            for entry in np.unique(indexes[:, p]):
                # Sums of a batch of longs below 2**28 fit in a long; larger ones are Python's integers.
                at = indexes[:, p] == entry
                sums[p, entry, :width], sums[p, entry, width] = mine[at].sum(0).astype(object), int(at.sum())
        return sums.ravel()

    # As many numbers as the codebooks have, whatever the number of vectors.
    sums = totals(rows.select("x"), summed, parts * k * (width + 1)).reshape(parts, k, width + 1)
    entries = books.entries.copy()
    used = sums[:, :, width] > 0
    entries[used] = sums[used][:, :width] // sums[used][:, width:]
    return Codebooks(entries)


def train(rows: DataFrame, dims: int, exact: bool, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of vectors `x` of `dims` components: the first vectors by id, moved `rounds` times over all rows."""
    first = rows.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").toPandas()["x"]
    matrix = stacked(first, dims, exact)
    books = Codebooks(matrix.reshape(len(matrix), parts, dims // parts).transpose(1, 0, 2))
    for _ in range(rounds):
        books = _moved(rows, books, exact)
    return books


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE,
             id_column: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and codebooks_sha256 of every vector that takes part.

    code holds the 0-based entry of each part in hex, two digits each (so at most 256 entries); error is the squared distance
    to the decoded vector, label_error its sum over the rows of equal label, nulls together. Null vectors and vectors with a
    null or non-finite component take no part. Rows without an id are coded like others, but are the last to start a
    codebook; equal ids are ordered by their vectors. Repeated rows are all returned. With fewer vectors than entries the
    codebooks are smaller. Vectors of different lengths, or of one that `parts` does not divide, raise a ValueError,
    components beyond 2**62 an ArithmeticError; below, all numbers are exact, and an error that does not fit in a long is
    null. Extra columns are not looked at. An empty table gives an empty result.
    """
    if entries > 256:
        raise ValueError("two hex digits name at most 256 entries")
    rows = settle(vectors.select(F.col(id_column).alias("id"), F.col(label).alias("label"), whole(F.col(vector), scale).alias("x")).where("x is not null"))
    count, dims, largest = shape(rows, "x")
    if dims % parts:
        raise ValueError(f"{dims} components cannot be cut into {parts} equal parts")
    exact = largest >= 1 << 28 or 4 * dims * (largest + 1) ** 2 >= 1 << 61
    books = train(rows, dims, exact, parts, entries, rounds) if count else None

    @F.pandas_udf("code string, error long")
    def coded(lists: pd.Series) -> pd.DataFrame:
        indexes, gaps = books.assign(stacked(lists, dims, exact))
        sums = [int(s) for s in gaps.sum(1)]
        return pd.DataFrame({"code": [bytes(row).hex() for row in indexes.astype(np.uint8)],
                             "error": pd.array([s if s < 1 << 63 else None for s in sums], "Int64")})

    placed = settle(rows.withColumn("unique", F.monotonically_increasing_id()).withColumn("c", coded("x"))
                    .select("id", "label", "unique", "c.code", "c.error"))
    whole_sum = F.sum(F.col("error").cast("decimal(38,0)"))
    # A sum with a missing part is missing too.
    sums = placed.groupBy("label").agg(F.when(F.count("error") == F.count(F.lit(1)), whole_sum.try_cast("long")).alias("label_error"))
    return lookup(placed, sums, ["label"], unique="unique").select(
        F.col("id").alias(id_column), F.col("label").alias(label), "code", "error", "label_error",
        F.lit(books.sha256 if books else None).cast("string").alias("codebooks_sha256"))
