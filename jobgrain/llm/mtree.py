"""Exact top-k inner products by best-first search in M-trees.

A vector x of squared norm |x|^2 gets one more coordinate, sqrt(M - |x|^2) for the
largest squared norm M of its tree. Euclidean distance to (q, 0) then falls as the
inner product with q rises, so nearest neighbours in this metric are the largest
products. The rows are dealt to trees of bounded size by their nearest pivot; every
tree holds pages of entries with the distance to the routing object of the page and,
for inner pages, a covering radius. Queries, in blocks, visit every tree best-first.
"""

import heapq
import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from jobgrain.llm.common import settle

SCALE = 256
EVERY = 50
K = 5
TREE_ROWS = 2_048
PAGE, FANOUT = 128, 16
BLOCK = 2_048
MOST_PIVOTS = 256
FOUND = "query long, vec_id long, unnamed boolean, score long"


@dataclass
class Page:
    """Entries are rows of the tree. On an inner page they route to `children` within `radius`."""
    rows: np.ndarray
    to_parent: np.ndarray
    radius: np.ndarray | None = None
    children: list[int] | None = None


class Tree:
    """An M-tree over integer vectors, loaded in bulk."""

    def __init__(self, rids: np.ndarray, ids: np.ndarray, unnamed: np.ndarray, vectors: np.ndarray):
        self.rids, self.ids, self.unnamed, self.vectors = rids, ids, unnamed, vectors
        squares = (vectors * vectors).sum(1)
        self.most = int(squares.max())
        self.extra = np.sqrt((self.most - squares).astype(np.float64))
        self.pages: list[Page] = []
        self.root = self._load(np.arange(len(ids)), None)[0]

    def between(self, rows: np.ndarray, one: int) -> np.ndarray:
        """Distances of rows to one row."""
        gaps = (self.vectors[rows] - self.vectors[one]).astype(np.float64)
        return np.sqrt((gaps * gaps).sum(1) + (self.extra[rows] - self.extra[one]) ** 2)

    def _load(self, rows: np.ndarray, parent: int | None) -> tuple[int, float]:
        """Make the pages below one routing object; its page number and covering radius."""
        to_parent = self.between(rows, parent) if parent is not None else np.zeros(len(rows))
        if len(rows) <= PAGE:
            self.pages.append(Page(rows, to_parent))
            return len(self.pages) - 1, float(to_parent.max())
        chosen, near = [int(rows[0])], self.between(rows, int(rows[0]))
        nearest = np.zeros(len(rows), np.int64)
        wanted = min(FANOUT, -(-len(rows) // PAGE))
        while len(chosen) < wanted and near.max() > 0:  # the farthest row so far becomes the next routing object
            one = int(rows[near.argmax()])
            gaps = self.between(rows, one)
            nearest[gaps < near] = len(chosen)
            near = np.minimum(near, gaps)
            chosen.append(one)
        if len(chosen) == 1:  # all rows are equal: cut them evenly
            chosen = chosen * wanted
            nearest = np.arange(len(rows)) % wanted
        kept, radius, children = [], [], []
        for i, one in enumerate(chosen):
            mine = rows[nearest == i]
            if len(mine) == len(rows):  # no progress: cut by order
                for part in np.array_split(mine, wanted):
                    page, reach = self._load(part, one)
                    kept.append(one), radius.append(reach), children.append(page)
            elif len(mine):
                page, reach = self._load(mine, one)
                kept.append(one), radius.append(reach), children.append(page)
        at = np.array(kept)
        self.pages.append(Page(at, self.between(at, parent) if parent is not None else np.zeros(len(at)), np.array(radius), children))
        return len(self.pages) - 1, float(to_parent.max())

    def search(self, query: np.ndarray, own: int, k: int) -> list[int]:
        """The k rows of largest product with `query`, ties to the smaller id, without the row whose rid is `own`."""
        base = int((query * query).sum()) + self.most
        slack = 1e-9 * (1.0 + base) ** 0.5
        best, kth = np.empty(0, np.int64), np.inf
        scores = np.empty(0, np.int64)
        heap = [(0.0, self.root, -1.0)]
        while heap:
            bound, number, to_router = heapq.heappop(heap)
            if bound > kth + slack:
                break
            page = self.pages[number]
            rows = page.rows
            reach = page.radius if page.children is not None else 0.0
            open_ = slice(None)
            if to_router >= 0 and kth < np.inf:  # the stored distances rule entries out before any is computed
                open_ = np.flatnonzero(np.abs(to_router - page.to_parent) - reach <= kth + slack)
                rows = rows[open_]
                if not len(rows):
                    continue
            products = self.vectors[rows] @ query
            if page.children is None:
                other = self.rids[rows] != own
                best, scores = np.concatenate([best, rows[other]]), np.concatenate([scores, products[other]])
                if len(best) > k:
                    order = np.lexsort((self.ids[best], self.unnamed[best], -scores))[:k]
                    best, scores = best[order], scores[order]
                if len(best) >= k:
                    kth = max(0.0, base - 2.0 * float(scores.min())) ** 0.5
            else:
                gaps = np.sqrt(np.maximum(base - 2.0 * products, 0.0))
                low = np.maximum(gaps - page.radius[open_], 0.0)
                numbers = np.arange(len(page.rows))[open_]
                for i in np.flatnonzero(low <= kth + slack):
                    heapq.heappush(heap, (float(low[i]), page.children[numbers[i]], float(gaps[i])))
        return list(zip(best.tolist(), scores.tolist()))


def _whole(embedding: Column) -> Column:
    """floor(256 x) of each component; null if the vector or a component is null or not finite."""
    numbers = F.transform(embedding, lambda x: x.cast("double"))
    finite = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(finite, F.transform(numbers, lambda x: F.floor(SCALE * x)))


def _stack(lists: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(x, np.int64) for x in lists])


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, tree_rows: int = TREE_ROWS, block: int = BLOCK,
          id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k largest products of each query.

    Queries are the rows whose id is divisible by `every`, candidates all rows but
    the query's own row; another row of the same id is a candidate. Vectors are
    compared only with vectors of their own length. Null vectors and vectors with a
    null or non-finite component take no part; empty vectors have product 0 with
    each other. A row with a null id is never a query; as a candidate it comes after
    equal scores with an id. Repeated query rows are answered once each. Products
    must fit in a long: components beyond 2**24 raise an ArithmeticError.

    The pivots are a bounded sample (at most 256 vectors) and only decide which rows
    share a tree. Trees have about `tree_rows` rows, so a vector that a third of the
    rows repeat fills many trees. Each (tree, block of queries) is its own task unit.
    """
    rows = settle(vectors.select(F.col(id_column).cast("long").alias("id"), _whole(F.col(vector)).alias("v")).where("v is not null")
                  .withColumns({"rid": F.monotonically_increasing_id(), "dim": F.size("v")}))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("id") % every == 0, 1)).alias("q"),
                     F.max(F.coalesce(F.array_max(F.transform("v", lambda x: F.abs(x))), F.lit(0))).alias("most")).first()
    if (sizes["most"] or 0) > 1 << 24:
        raise ArithmeticError("a component is too large for products that fit in a long")
    pivots = rows.orderBy(F.xxhash64("rid"), "rid").limit(min(MOST_PIVOTS, -(-sizes["n"] // tree_rows))).select("v").collect()
    known = {}
    for (v,) in pivots:
        known.setdefault(len(v), []).append(v)
    known = {dim: np.array(v, np.int64) for dim, v in known.items()}

    @F.pandas_udf("int")
    def nearest(lists: pd.Series) -> pd.Series:
        out = np.zeros(len(lists), np.int32)
        lengths = lists.map(len).to_numpy()
        for dim, centres in known.items():
            mine = np.flatnonzero(lengths == dim)
            if len(mine) and dim:
                x = _stack(lists.iloc[mine])
                out[mine] = ((centres * centres).sum(1) - 2 * (x @ centres.T)).argmin(1)
        return pd.Series(out)

    placed = settle(rows.withColumn("pivot", nearest("v")))
    parts = placed.groupBy("dim", "pivot").agg(F.ceil(F.count(F.lit(1)) / tree_rows).cast("int").alias("parts"))
    dealt = placed.join(parts, ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")).cast("int"))

    def grown(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rid")
        ids = group["id"].fillna(0).astype(np.int64).to_numpy() if group["id"].isna().any() else group["id"].to_numpy(np.int64)
        tree = Tree(group["rid"].to_numpy(np.int64), ids, group["id"].isna().to_numpy(), _stack(group["v"]))
        return pd.DataFrame({"dim": [key[0]], "tree": [f"{key[1]}-{key[2]}"], "pages": [pickle.dumps(tree)]})

    trees = dealt.select("dim", "pivot", "part", "rid", "id", "v").groupBy("dim", "pivot", "part").applyInPandas(
        grown, "dim int, tree string, pages binary")
    blocks = max(1, -(-sizes["q"] // block))
    asked = (rows.where(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("rid"), F.lit(blocks)).cast("int"))
             .groupBy("dim", "block").agg(F.collect_list(F.struct("rid", "v")).alias("queries")))
    pairs = trees.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).join(asked, ["dim", "block"])

    def answered(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for pages, queries in zip(group["pages"], group["queries"]):
            tree = pickle.loads(pages)
            for q in queries:
                for row, score in tree.search(np.asarray(q["v"], np.int64), q["rid"], k):
                    out.append((q["rid"], int(tree.ids[row]), bool(tree.unnamed[row]), score))
        return pd.DataFrame(out, columns=["query", "vec_id", "unnamed", "score"])

    found = pairs.groupBy("dim", "tree", "block").applyInPandas(answered, FOUND)
    best = Window.partitionBy("query").orderBy(F.desc("score"), "unnamed", "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = rows.where(F.col("id") % every == 0).select(F.col("rid").alias("query"), F.col("id").alias("query_id"))
    return top.join(names, "query").select("query_id", "rank", F.when(~F.col("unnamed"), F.col("vec_id")).alias("vec_id"), "score")
