"""Euclidean distance sums of two numeric features of any number of values, without pairs of tuples.

The plane is cut into a quadtree whose leaves hold few tuples. The distance to a tuple
is smooth in that tuple's place as soon as it is a cell's width away from the cell, so
seen from there all tuples of a cell act, to rounding, like NODES x NODES weighted
points at its Chebyshev nodes; and the sums over tuples that far away are as smooth within
a cell, so they are made at its nodes and handed down to the cells below it. Each leaf meets
the tuples of the leaves next to it one by one, and everything else through cells that are
far enough away, each at the highest level that allows it. The work grows with the tuples,
never with tuples squared, for all labellings at once.

Cells are numbered so that the parent of cell c is c >> 2; the root is 1. The leaves
of a block (a cell with up to BLOCK_LEAVES leaves) are done by one task, which gets
their tuples, those of the leaves next to them, and the weighted points of the far cells.
"""

import pickle
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jobgrain.clustering.features import WEIGHT
from jobgrain.clustering.scoring import LABELS, SUMS, _onehot
from jobgrain.operators.scale import settle, small_join
from jobgrain.schema import with_fields

NODES = 14
LEAF_ROWS = 1_024
BLOCK_LEAVES = 32
# Levels of the tree; two tuples that differ by less than 2**-DEPTH of the span are in one leaf.
DEPTH = 30
# Levels whose cells are counted, or merged, in one step.
STEP = 3
# Distances held at once.
TILE = 1 << 17

NODE = np.cos((2 * np.arange(NODES) + 1) * np.pi / (2 * NODES))
SERIES = np.cos(np.arange(NODES)[:, None] * np.arccos(NODE)) * np.where(np.arange(NODES) == 0, 1.0, 2.0)[:, None] / NODES
# A cell of no more tuples than nodes is its tuples.
FEW = NODES * NODES
SOURCE = "cell long, xs array<double>, ys array<double>, weights array<double>"


def _spread(v: np.ndarray) -> np.ndarray:
    """Each bit of a number of up to 31 bits moved to twice its place."""
    v = v.astype(np.int64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = (v | (v << shift)) & mask
    return v


def _gathered(v: np.ndarray) -> np.ndarray:
    """The reverse of `_spread`."""
    v = v.astype(np.int64) & 0x5555555555555555
    for shift, mask in ((1, 0x3333333333333333), (2, 0x0F0F0F0F0F0F0F0F), (4, 0x00FF00FF00FF00FF), (8, 0x0000FFFF0000FFFF), (16, 0x00000000FFFFFFFF)):
        v = (v | (v >> shift)) & mask
    return v


class Square:
    """The bounding square, and the cells in it."""

    def __init__(self, x: str, y: str, low: tuple[float, float], high: tuple[float, float]):
        self.x, self.y, self.low = x, y, low
        self.side = max(high[0] - low[0], high[1] - low[1]) or 1.0

    def deepest(self, frame: pd.DataFrame) -> np.ndarray:
        """Number of the deepest cell of each tuple."""
        top = (1 << DEPTH) - 1
        at = [np.clip(np.floor((frame[c].to_numpy(np.float64) - low) / self.side * (1 << DEPTH)), 0, top).astype(np.int64)
              for c, low in zip((self.x, self.y), self.low)]
        return (np.int64(1) << (2 * DEPTH)) | _spread(at[0]) | (_spread(at[1]) << 1)

    def box(self, cells) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centre and half the width of cells."""
        cells = np.asarray(cells, np.int64)
        level = np.array([(int(c).bit_length() - 1) // 2 for c in np.ravel(cells)], np.int64).reshape(cells.shape)
        rest, half = cells - (np.int64(1) << (2 * level)), self.side / 2.0 ** (level + 1)
        return self.low[0] + (2 * _gathered(rest) + 1) * half, self.low[1] + (2 * _gathered(rest >> 1) + 1) * half, half


class Tree:
    """Which cells are leaves; `counts` has the tuples of every cell, inner ones included."""

    def __init__(self, square: Square, counts: dict[int, int], leaves: list[int]):
        self.square, self.counts = square, counts
        by_start = sorted(leaves, key=self.start)
        self.leaves = np.array(by_start, np.int64)
        self.starts = np.array([self.start(c) for c in by_start], np.int64)
        self.is_leaf = set(leaves)
        inner = [c for c in counts if c not in self.is_leaf]
        self.children = {c: [d for d in range(4 * c, 4 * c + 4) if d in counts] for c in inner}
        self.boxes = {c: (x, y, h) for c, x, y, h in zip(counts, *map(np.ndarray.tolist, square.box(list(counts))))}

    @staticmethod
    def start(cell: int) -> int:
        """The first deepest cell of a cell; leaves follow each other in this order."""
        return cell << 2 * (DEPTH - (cell.bit_length() - 1) // 2)

    def leaf_of(self, deepest: np.ndarray) -> np.ndarray:
        return self.leaves[np.searchsorted(self.starts, deepest, side="right") - 1]

    def met(self, leaf: int) -> tuple[list[int], list[int]]:
        """Leaves that are met tuple by tuple, and cells that are far enough away."""
        near, far, open_ = [], [], [1]
        x, y, h = self.boxes[leaf]
        while open_:
            cell = open_.pop()
            cx, cy, ch = self.boxes[cell]
            if max(abs(x - cx), abs(y - cy)) - h - ch >= 2 * ch * (1 - 1e-9):
                far.append(cell)
            elif cell in self.is_leaf:
                near.append(cell)
            else:
                open_ += self.children[cell]
        return near, far

    def plan(self, block: int) -> list[tuple]:
        """What the cells of a block meet, parents first: (cell, parent, far, apart, near).

        `far` cells act on the cell's nodes, or on the tuples of a small leaf; leaves also have cells that are far enough from
        each of their tuples but too near for the nodes (`apart`), and leaves that are met tuple by tuple (`near`; else None).
        """
        found, open_ = [], [(block, 0, [1])]
        while open_:
            cell, parent, waiting = open_.pop()
            x, y, h = self.boxes[cell]
            leaf, far, apart, near, below = cell in self.is_leaf, [], [], [], []
            while waiting:
                other = waiting.pop()
                ox, oy, oh = self.boxes[other]
                gap = max(abs(x - ox), abs(y - oy)) - h - oh
                if gap >= 2 * max(h, oh) * (1 - 1e-9):
                    far.append(other)
                elif leaf and gap >= 2 * oh * (1 - 1e-9):
                    apart.append(other)
                elif leaf and other in self.is_leaf:
                    near.append(other)
                elif other not in self.is_leaf and (leaf or oh > h):
                    waiting += self.children[other]
                else:
                    below.append(other)
            found.append((cell, parent, far, apart, near if leaf else None))
            if not leaf:
                open_ += [(c, cell, list(below)) for c in self.children[cell]]
        return found

    def blocks(self) -> dict[int, list[int]]:
        """Leaves by block: the largest cells with at most BLOCK_LEAVES leaves."""
        found, open_ = {}, [1]
        below: dict[int, int] = {}
        for leaf in self.leaves.tolist():
            while leaf:
                below[leaf] = below.get(leaf, 0) + 1
                leaf >>= 2
        while open_:
            cell = open_.pop()
            if below[cell] <= BLOCK_LEAVES or cell in self.is_leaf:
                first = np.searchsorted(self.starts, self.start(cell))
                found[cell] = self.leaves[first:first + below[cell]].tolist()
            else:
                open_ += self.children[cell]
        return found


def grow(points: DataFrame, square: Square, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree of cells with more than `leaf_rows` tuples above leaves with fewer; `points` has the deepest `_cell`.

    Each step counts the cells a few levels down, of crowded cells only. The counts have one row per cell: a leaf and its
    inner cells for some hundred tuples each.
    """
    counts: dict[int, int] = {}
    leaves, crowded, level = [], None, 0
    while crowded is None or crowded:
        reach = min(level + STEP, DEPTH)
        rows = points if crowded is None else points.join(F.broadcast(points.sparkSession.createDataFrame([(c,) for c in crowded], "_top long")),
                                                          F.shiftright("_cell", 2 * (DEPTH - level)) == F.col("_top"), "left_semi")
        found = {c: n for c, n in rows.groupBy(F.shiftright("_cell", 2 * (DEPTH - reach)).alias("c")).count().collect()}
        sums = dict(found)
        for step in range(reach - level):
            for c in [c for c in sums if (c.bit_length() - 1) // 2 == reach - step]:
                sums[c >> 2] = sums.get(c >> 2, 0) + sums[c]
        open_ = [1] if crowded is None else crowded
        counts |= {c: sums[c] for c in open_ if c in sums}
        crowded, waiting = [], list(open_)
        while waiting:
            cell = waiting.pop()
            depth = (cell.bit_length() - 1) // 2
            if sums[cell] <= leaf_rows or depth == DEPTH:
                leaves.append(cell)
            elif depth == reach:
                crowded.append(cell)
            else:
                below = [d for d in range(4 * cell, 4 * cell + 4) if d in sums]
                counts |= {d: sums[d] for d in below}
                waiting += below
        level = reach
    return Tree(square, counts, leaves)


def _polynomials(u: np.ndarray) -> np.ndarray:
    """T_0 .. T_{NODES-1} of each number, numbers x NODES."""
    return np.cos(np.arange(NODES) * np.arccos(np.clip(u, -1.0, 1.0))[:, None])


def _distance_sums(xs, ys, from_x, from_y, from_w: np.ndarray) -> np.ndarray:
    """Weighted sums of the distances of each place to all of the others, TILE distances at a time."""
    sums = np.zeros((len(xs), from_w.shape[1]))
    step = max(1, TILE // max(1, len(xs)))
    for i in range(0, len(from_x), step):
        gaps, across = xs[:, None] - from_x[i:i + step], ys[:, None] - from_y[i:i + step]
        gaps *= gaps
        across *= across
        gaps += across
        sums += np.sqrt(gaps, out=gaps) @ from_w[i:i + step]
    return sums


def _between(box: tuple[float, float, float], values: np.ndarray, xs: np.ndarray, ys: np.ndarray) -> np.ndarray:
    """Values at places in a cell from those at its nodes (NODES * NODES x width)."""
    cx, cy, h = box
    over_x, over_y = _polynomials((xs - cx) / h) @ SERIES, _polynomials((ys - cy) / h) @ SERIES
    lines, out = values.reshape(NODES, NODES, -1), np.zeros((len(xs), values.shape[1]))
    for i in range(NODES):
        out += over_x[:, i, None] * (over_y @ lines[i])
    return out


def _as_nodes(square: Square, cell: int, xs: np.ndarray, ys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The weighted points that stand for those of a cell, seen from a cell's width away."""
    if len(xs) <= FEW:
        return xs, ys, weights
    cx, cy, h = (float(v) for v in square.box(cell))
    over_x, over_y = _polynomials((xs - cx) / h) @ SERIES, _polynomials((ys - cy) / h) @ SERIES
    out = np.zeros((NODES, NODES, weights.shape[1]))
    for i in range(NODES):
        out[i] = (over_y * over_x[:, i, None]).T @ weights
    at_x, at_y = np.meshgrid(cx + h * NODE, cy + h * NODE, indexing="ij")
    return at_x.ravel(), at_y.ravel(), out.reshape(FEW, -1)


def _row(cell: int, xs, ys, weights) -> dict:
    return {"cell": cell, "xs": xs, "ys": ys, "weights": weights.ravel()}


def sources(points: DataFrame, tree: Tree, ks: list[int]) -> DataFrame:
    """The weighted points of every cell: of leaves from their tuples, of inner cells from the cells below, STEP levels at a time."""
    square, width = tree.square, sum(ks)
    inner = set(tree.children)

    def of_leaf(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = _as_nodes(square, int(key[0]), frame[square.x].to_numpy(np.float64), frame[square.y].to_numpy(np.float64), _onehot(frame, ks))
        return pd.DataFrame([_row(int(key[0]), *found)])

    leaves = settle(points.groupBy("_leaf").applyInPandas(of_leaf, SOURCE))
    every, merged = leaves, leaves
    deepest = max((c.bit_length() - 1) // 2 for c in tree.counts)
    for top in range((deepest - 1) // STEP * STEP, -1, -STEP):
        def of_inner(frame: pd.DataFrame) -> pd.DataFrame:  # settled before `top` moves on
            held = {int(c): (np.array(x), np.array(y), np.array(w).reshape(len(x), width))
                    for c, x, y, w in zip(frame["cell"], frame["xs"], frame["ys"], frame["weights"])}
            rows = []
            for level in range(top + STEP, top, -1):
                parents: dict[int, list[int]] = {}
                for c in held:
                    if (c.bit_length() - 1) // 2 == level:
                        parents.setdefault(c >> 2, []).append(c)
                for parent, below in parents.items():
                    if parent in inner:
                        held[parent] = _as_nodes(square, parent, *(np.concatenate([held[c][i] for c in sorted(below)]) for i in range(3)))
                        rows.append(_row(parent, *held[parent]))
            return pd.DataFrame(rows, columns=["cell", "xs", "ys", "weights"])

        band = merged.where((F.col("cell") >= 1 << 2 * (top + 1)) & (F.col("cell") < 1 << 2 * (top + STEP + 1)))
        up = settle(band.groupBy(_ancestor(top).alias("_top")).applyInPandas(of_inner, SOURCE))
        every, merged = every.union(up), merged.union(up)
    return every


def _ancestor(level: int):
    """The cell at `level` above (or at) the one in `cell`."""
    return F.expr(f"shiftright(cell, 2 * (int((length(bin(cell)) - 1) / 2) - {level}))")


def plane_sums(labelled: DataFrame, x: str, y: str, ks: list[int], leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Tuples with `_sums`: summed Euclidean distance over (x, y) to each cluster of each labelling."""
    low_x, low_y, high_x, high_y = labelled.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
    square = Square(x, y, (low_x, low_y), (high_x, high_y))

    def numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(_cell=square.deepest(frame))

    kept = labelled.select(x, y, WEIGHT, LABELS)
    celled = settle(kept.mapInPandas(numbered, with_fields(kept.schema, _cell="long")))
    tree = grow(celled, square, leaf_rows)

    firsts, of_first = tree.starts, tree.leaves  # all that a task needs of the tree

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            yield frame.assign(_leaf=of_first[np.searchsorted(firsts, frame["_cell"].to_numpy(np.int64), side="right") - 1])

    points = settle(celled.mapInPandas(placed, with_fields(celled.schema, _leaf="long")))
    cells = sources(points, tree, ks)

    plans, near, far = {}, [], []  # a plan is packed until its task unpacks it: every worker holds all of them
    for block in tree.blocks():
        plan = tree.plan(block)
        near += [(block, c) for c in {c for step in plan for c in step[4] or []}]
        far += [(block, c) for c in {c for step in plan for c in step[2] + step[3]}]
        plans[block] = pickle.dumps(plan)
    spark = labelled.sparkSession
    beside = small_join(points.drop("_cell"), spark.createDataFrame(near, "_block long, _leaf long"), "_leaf")
    beyond = small_join(cells, spark.createDataFrame(far, "_far_block long, cell long"), "cell")
    width = sum(ks)

    def summed(key: tuple, tuples: pd.DataFrame, far_cells: pd.DataFrame) -> pd.DataFrame:
        at = {int(leaf): rows for leaf, rows in tuples.groupby("_leaf").indices.items()}
        xs, ys, weights = tuples[x].to_numpy(np.float64), tuples[y].to_numpy(np.float64), _onehot(tuples, ks)
        held = {int(c): (np.array(a), np.array(b), np.array(w).reshape(len(a), width))
                for c, a, b, w in zip(far_cells["cell"], far_cells["xs"], far_cells["ys"], far_cells["weights"])}

        def over(to_x, to_y, others: list[int]) -> np.ndarray:
            if not others:
                return np.zeros((len(to_x), width))
            return _distance_sums(to_x, to_y, *(np.concatenate([held[c][i] for c in others]) for i in range(3)))

        out, handed = [], {}
        for cell, parent, far_off, apart, beside_it in pickle.loads(plans[int(key[0])]):
            box = tuple(float(v) for v in square.box(cell))
            own = None if beside_it is None else at[cell]
            small = own is not None and len(own) <= FEW
            if small:
                to_x, to_y = xs[own], ys[own]
            else:
                grid = np.meshgrid(box[0] + box[2] * NODE, box[1] + box[2] * NODE, indexing="ij")
                to_x, to_y = grid[0].ravel(), grid[1].ravel()
            sums = over(to_x, to_y, far_off)
            if parent:
                sums += _between(*handed[parent], to_x, to_y)
            if own is None:
                handed[cell] = box, sums
                continue
            if not small:
                sums = _between(box, sums, xs[own], ys[own])
            one_by_one = np.concatenate([at[c] for c in beside_it])
            sums += over(xs[own], ys[own], apart) + _distance_sums(xs[own], ys[own], xs[one_by_one], ys[one_by_one], weights[one_by_one])
            out.append(tuples.iloc[own][[x, y, WEIGHT, LABELS]].assign(**{SUMS: list(sums)}))
        return pd.concat(out)

    schema = with_fields(kept.schema, **{SUMS: "array<double>"})
    return beside.groupBy("_block").cogroup(beyond.groupBy("_far_block")).applyInPandas(summed, schema)
