"""SimHash near copies: Hamming links of fingerprints by the generalised pigeonhole principle.

The 64 bits of a fingerprint are grouped by their correlation into m groups. If the
thresholds t of the groups add up to TAU - m + 1, two fingerprints that differ in at
most TAU bits differ in at most t bits of some group; a threshold of -1 leaves a group
out. Every fingerprint chooses its own thresholds by dynamic programming over estimated
numbers of candidates, probes the values within t of its own in each group, and what
it meets is compared in full.

Lists of a value that are too long to be compared in pairs are linked without pairs:
two fingerprints differ in at most TAU bits exactly if one value lies within TAU // 2
of the first and within the rest of TAU of the second, so all fingerprints around a
value are linked with one of them, and no pair has to be verified.
"""

from itertools import combinations
from math import comb
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.llm.common import connected, lookup, settle

N = 3
TAU = 2
BITS = 64
SEED = 42
# Hashes whose bits are counted at once: 64 bytes each while they are.
CHUNK = 4_096
# A group of bits is cut into pieces of at most this many for the estimates: 2**PIECE counts a piece.
PIECE = 11
GROUPS = (2, 3, 4)
# Rows of one probed value beyond which its fingerprints are linked through the values around them, which costs
# about 65 rows each; pairs would cost half of the rows of the value each.
CROWD = 128
MASKS_AT_ONCE = 64


def shingle_hashes(text: str | None, n: int = N) -> np.ndarray:
    """XXH64 of every n-word shingle of a text, repeats included; of the whole sequence if it has fewer words.

    Words are separated by ASCII white space and lower-cased within ASCII, which is what bytes.split and bytes.lower do.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(n, len(words))
    line = b" ".join(words)
    after = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate([[0], after[:len(words) - size]]).tolist()
    ends = (after[size - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts, ends)), np.uint64, len(ends))


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as a signed long; 0 for none."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[i:i + CHUNK]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, n: int = N) -> DataFrame:
    """doc_id and fp (a long) of every row."""
    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, n)) for t in texts], dtype=np.int64)

    return docs.select("doc_id", made("text").alias("fp"))


def _bits(prints: pd.Series) -> np.ndarray:
    return np.unpackbits(prints.to_numpy(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(bits: np.ndarray, places: list[int]) -> np.ndarray:
    """The numbers that some of the bits make, the first place lowest."""
    return bits[:, places].astype(np.int64) @ (np.int64(1) << np.arange(len(places), dtype=np.int64))


def correlation(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the absolute correlation of their bits, over all of them."""
    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        both = np.zeros((BITS + 1, BITS + 1), np.int64)  # the last place is always set: it counts single bits and rows
        for batch in batches:
            bits = np.pad(_bits(batch["fp"]), ((0, 0), (0, 1)), constant_values=1).astype(np.float64)
            both += (bits.T @ bits).astype(np.int64)
        yield pd.DataFrame({"place": np.arange(both.size), "both": both.ravel()})

    rows = prints.mapInPandas(counted, "place int, both long").groupBy("place").agg(F.sum("both").alias("both")).collect()
    both = np.zeros((BITS + 1) ** 2)
    for place, count in rows:
        both[place] = count
    both = both.reshape(BITS + 1, BITS + 1)
    n = int(both[BITS, BITS])
    share, mean = both[:BITS, :BITS] / max(n, 1), both[BITS, :BITS] / max(n, 1)
    spread = np.sqrt(mean * (1 - mean))
    spread[spread == 0] = np.inf
    related = np.abs(share - np.outer(mean, mean)) / np.outer(spread, spread)
    np.fill_diagonal(related, 0.0)
    return n, related


def grouped(related: np.ndarray, m: int) -> list[list[int]]:
    """m groups of bits of about equal size; each is filled with the bits most related to those it has."""
    left, groups = list(range(len(related))), []
    for i in range(m):
        size = len(left) // (m - i)
        group = [max(left, key=lambda b: related[b, left].sum())]
        left.remove(group[0])
        while len(group) < size:
            group.append(max(left, key=lambda b: related[b, group].sum()))
            left.remove(group[-1])
        groups.append(group)
    return groups


def _pieces(group: list[int]) -> list[list[int]]:
    return [list(map(int, p)) for p in np.array_split(group, -(-len(group) // PIECE))]


def ball(width: int, radius: int) -> list[int]:
    """Masks of at most `radius` of `width` bits."""
    return [sum(1 << b for b in flipped) for r in range(radius + 1) for flipped in combinations(range(width), r)]


class Allocation:
    """Groups of bits with what is needed to choose thresholds: shares of fingerprints near each value of a piece."""

    def __init__(self, groups: list[list[int]], counts: dict[tuple[int, int], np.ndarray], n: int, tau: int = TAU):
        self.groups, self.n, self.tau = groups, n, tau
        self.near = {}
        for (g, p), count in counts.items():
            width, all_values = len(_pieces(groups[g])[p]), np.arange(len(count))
            # Share of the fingerprints at a distance of exactly r from each value.
            self.near[g, p] = np.stack([sum((count[all_values ^ mask] for mask in ball(width, r) if bin(mask).count("1") == r),
                                            np.zeros(len(count))) for r in range(tau + 1)]) / max(n, 1)

    def candidates(self, bits: np.ndarray, g: int) -> np.ndarray:
        """Estimated fingerprints within 0..tau of each row's value of a group; pieces are taken as independent."""
        exact = np.zeros((self.tau + 1, len(bits)))
        exact[0] = 1.0
        for p, places in enumerate(_pieces(self.groups[g])):
            near = self.near[g, p][:, _values(bits, places)]
            exact = np.stack([sum(exact[r - s] * near[s] for s in range(r + 1)) for r in range(self.tau + 1)])
        return self.n * np.cumsum(exact, axis=0)

    def thresholds(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row the thresholds of the groups and the estimated cost: probes and candidates.

        Thresholds plus one add up to tau + 1; the least cost of each sum is kept group by group.
        """
        most = self.tau + 1
        best = np.full((most + 1, len(bits)), np.inf)
        best[0] = 0.0
        chosen = []
        for g, group in enumerate(self.groups):
            met = self.candidates(bits, g)
            cost = [np.zeros(len(bits))] + [sum(comb(len(group), i) for i in range(t + 1)) + met[t] for t in range(self.tau + 1)]
            trials = np.stack([np.stack([best[total - u] + cost[u] if u <= total else np.full(len(bits), np.inf)
                                         for u in range(most + 1)]) for total in range(most + 1)])
            chosen.append(trials.argmin(1))
            best = trials.min(1)
        total, every = np.full(len(bits), most), np.arange(len(bits))
        found = np.zeros((len(self.groups), len(bits)), np.int64)
        for g in reversed(range(len(self.groups))):
            found[g] = chosen[g][total, every] - 1
            total = total - found[g] - 1
        return found, best[most]


def allocate(prints: DataFrame, tau: int = TAU, choices: tuple[int, ...] = GROUPS) -> Allocation:
    """The grouping into 2, 3 or 4 groups of least estimated cost; counts, correlations and costs cover all fingerprints.

    Few groups have selective values but need many probes, many groups the reverse, so more fingerprints want fewer groups.
    """
    n, related = correlation(prints)
    groupings = {m: grouped(related, m) for m in choices}
    pieces = [(m, g, p, places) for m, groups in groupings.items() for g, group in enumerate(groups) for p, places in enumerate(_pieces(group))]

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = [np.zeros(1 << len(places), np.int64) for *_, places in pieces]
        for batch in batches:
            bits = _bits(batch["fp"])
            for total, (*_, places) in zip(totals, pieces):
                total += np.bincount(_values(bits, places), minlength=len(total))
        for i, total in enumerate(totals):
            at = np.flatnonzero(total)
            yield pd.DataFrame({"piece": np.full(len(at), i), "value": at, "c": total[at]})

    # At most 2**PIECE values of each piece, whatever the number of fingerprints.
    rows = prints.mapInPandas(counted, "piece int, value int, c long").groupBy("piece", "value").agg(F.sum("c").alias("c")).collect()
    counts = {m: {} for m in choices}
    for m, g, p, places in pieces:
        counts[m][g, p] = np.zeros(1 << len(places))
    for i, value, c in rows:
        m, g, p, _ = pieces[i]
        counts[m][g, p][value] = c
    plans = {m: Allocation(groupings[m], counts[m], n, tau) for m in choices}

    def priced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        costs = dict.fromkeys(choices, 0.0)
        for batch in batches:
            bits = _bits(batch["fp"])
            for m, plan in plans.items():
                costs[m] += float(plan.thresholds(bits)[1].sum())
        yield pd.DataFrame({"m": list(costs), "cost": list(costs.values())})

    total = {m: c for m, c in prints.mapInPandas(priced, "m int, cost double").groupBy("m").agg(F.sum("cost")).collect()}
    return plans[min(choices, key=lambda m: (total.get(m, 0.0), m))]


def probes(prints: DataFrame, plan: Allocation) -> DataFrame:
    """part, value and fp: a fingerprint's own value of each group (`member`) and the values it looks up (`probe`)."""
    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own, bits = batch["fp"].to_numpy(np.int64), _bits(batch["fp"])
            chosen, _ = plan.thresholds(bits)
            for g, group in enumerate(plan.groups):
                values = _values(bits, group)
                for t in np.unique(chosen[g]):
                    mine = np.flatnonzero(chosen[g] == t)
                    masks = np.array(ball(len(group), int(max(t, 0))), np.int64)
                    for i in range(0, len(masks), MASKS_AT_ONCE):
                        some = masks[i:i + MASKS_AT_ONCE]
                        yield pd.DataFrame({"part": np.full(len(mine) * len(some), g), "value": (values[mine][:, None] ^ some).ravel(),
                                            "fp": np.repeat(own[mine], len(some)), "probe": t >= 0, "member": np.tile(some == 0, len(mine))})

    return prints.select("fp").mapInPandas(made, "part int, value long, fp long, probe boolean, member boolean")


def links(prints: DataFrame, tau: int = TAU, crowd: int = CROWD) -> DataFrame:
    """(a, b) of different fingerprints at `tau` or fewer bits; crowded values give enough of them for the same components.

    `prints` has distinct values in `fp`. A value that over `crowd` rows have or probe is not expanded into pairs.
    """
    rows = probes(prints, allocate(prints, tau))
    per_value = ["part", "value"]
    crowded = settle(rows.groupBy(*per_value).agg(F.count(F.lit(1)).alias("rows"), F.max("member").alias("met"))
                     .where((F.col("rows") > crowd) & F.col("met")).select(*per_value))
    marked = lookup(rows, crowded.withColumn("crowded", F.lit(True)), per_value, unique="fp")
    lists = (marked.where("crowded is null").groupBy(*per_value)
             .agg(F.collect_list(F.when(F.col("probe"), F.col("fp"))).alias("probing"), F.collect_list(F.when(F.col("member"), F.col("fp"))).alias("members"))
             .where((F.size("members") > 0) & (F.size("probing") > 0)))
    pairs = (lists.select(F.explode("probing").alias("a"), "members").select("a", F.explode("members").alias("b"))
             .where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)))
    if crowded.isEmpty():
        return pairs.distinct()
    return pairs.union(around(marked.where("crowded").select("fp").distinct(), tau)).distinct()


def around(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, b) links of fingerprints of the same components as all their links, through the values around them.

    Each gives the values within tau // 2 of it (`near`) and within the rest of tau; the least near one of a value is linked
    with all others of that value, which lie within tau of it. A value has no more fingerprints than a ball of bits.
    """
    inner, outer = tau // 2, tau - tau // 2
    masks = np.array(ball(BITS, outer), np.uint64).view(np.int64)
    near = np.array([bin(int(m)).count("1") <= inner for m in masks.view(np.uint64)])

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            own = batch["fp"].to_numpy(np.int64)
            for i in range(0, len(masks), MASKS_AT_ONCE):
                some = masks[i:i + MASKS_AT_ONCE]
                yield pd.DataFrame({"value": (own[:, None] ^ some).ravel(), "fp": np.repeat(own, len(some)),
                                    "near": np.tile(near[i:i + MASKS_AT_ONCE], len(own))})

    met = (prints.select("fp").mapInPandas(made, "value long, fp long, near boolean").groupBy("value")
           .agg(F.min(F.when(F.col("near"), F.col("fp"))).alias("hub"), F.collect_set("fp").alias("all")).where((F.size("all") > 1) & F.col("hub").isNotNull()))
    return (met.select("hub", F.explode("all").alias("fp")).where("hub != fp")
            .select(F.least("hub", "fp").alias("a"), F.greatest("hub", "fp").alias("b")))


def near_copies(docs: DataFrame, n: int = N, tau: int = TAU) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and fp (the same as a long) of every row.

    component_id is the smallest doc_id that links of `tau` or fewer differing bits reach. Null and empty texts and texts of
    white space have fingerprint zero and are linked like any other. Rows with a null doc_id take part and pass links on; a
    component is named null only if it has no other row. Repeated rows are all returned. Extra columns are not looked at.
    An empty table gives an empty result.
    """
    prints = settle(fingerprints(docs, n))
    distinct = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected(links(distinct, tau), "a", "b").withColumnRenamed("node", "fp")
    rooted = distinct.join(roots, "fp").select("fp", "root", "low")
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component"))
    named = settle(lookup(rooted, lowest, ["root"], unique="fp").select("fp", "component"))
    alone = settle(distinct.join(named, "fp", "left").select("fp", F.coalesce("component", "low").alias("component_id")))
    return (lookup(prints, alone, ["fp"], unique="doc_id")
            .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "fp"))
