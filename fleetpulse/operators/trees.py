"""Regression trees from histograms: a forest with vector leaves and leaf-wise boosting.

Inputs are cut into at most ``BINS`` bins once; a row is then a few bytes of bin numbers, its targets
and a hash of its keys. Both growers look for the split of largest gain, which is how much the sum
of squares about the means falls, added up over all targets.

The forest grows a level of all trees at a time. Tasks add up histograms of every node that is still
large, one row per node and task, their sums choose the splits, and only splits come to the driver.
A node of at most ``NODE_ROWS`` rows goes to one task with its rows and is finished there. How often
a tree draws a row follows from the row's hash, so a repeated task draws the same.

Boosting grows one tree a round and target, best leaf first: a queue holds the leaves by the gain of
their best split, the smaller child's histogram is counted and the larger one's is the rest. Up to
``FIT_ROWS`` rows a target is boosted in one task. Beyond, all targets advance together, and one
pass over the rows counts the histograms that they ask for.

Rows with equal bins never part. Where the grid of all bins has at most ``CELLS`` cells and fewer than
there are rows, one pass adds up the rows of every cell for all trees or rounds, and both growers work on
these sums: no pass per level or split, and no more in a task at any number of rows.

A model is a table of nodes. Rows are scored by their cell of the grid, whose cells are scored once, and
where the grid is larger with blocks of at most ``BLOCK_NODES`` nodes.
"""

from __future__ import annotations

import functools
import heapq
import math
import operator
import pickle
from collections.abc import Callable, Generator, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetpulse.functions.exprs import finite_or
from fleetpulse.settings import DEV

SEED = 42
BINS = 255
NODE_ROWS, FIT_ROWS = 1 << 18, 1 << 20
BLOCK_NODES = 2_000_000
#: Cells of a grid that is worked on by sums, bytes of sums in a task, tasks that share out the rows, and rows added at once.
CELLS, HELD, SHARES, SLICE_ROWS = 1 << 18, 64 << 20, 8, 1 << 19
#: Rounds after which the rows' predictions so far are written down when boosting over many tasks.
KEEP_ROUNDS = 20
#: Differences of gains, as a share of a node's sum of squares, that may be rounding: such gains are equal.
EQUAL_GAIN = 1e-10

NODES = "tree int, output int, node long, feature int, cut double, left_id long, right_id long, value array<double>, cover double, gain double"


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 120
    depth: int = 18
    min_leaf: int = 2
    min_split: int = 5


@dataclass(frozen=True)
class BoostSettings:
    """``leaves`` and ``depth`` bound a tree; None is no bound."""

    rounds: int = 180
    leaves: int | None = None
    depth: int | None = 5
    step: float = 0.05
    rows: float = 0.85
    columns: float = 0.85
    min_leaf: float = 1.0
    l2: float = 1.0


LEAF_WISE = BoostSettings(leaves=31, depth=None, min_leaf=20.0, l2=0.0)


# ---- bins ---------------------------------------------------------------------------------------


def bin_cuts(df: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """Upper bounds of the bins of each feature; the last bin has none."""
    share = [i / (bins + 1) for i in range(1, bins + 1)]
    one = df.agg(*[F.percentile_approx(finite_or(f, 0.0), F.array(*map(F.lit, share)), F.lit(10_000)).alias(f) for f in features]).first()
    return [np.unique(np.array(v if v is not None else [], float)) for v in one]


def binned(df: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """``key, x, y`` of every row: hash, a byte of bin number per feature, targets."""

    @F.pandas_udf("binary")
    def codes(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            x = np.column_stack([np.searchsorted(c, s.to_numpy(float)) for c, s in zip(cuts, cols, strict=True)]).astype(np.uint8)
            yield pd.Series([r.tobytes() for r in x])

    return df.select(
        F.xxhash64(*keys).alias("key"), codes(*[finite_or(f, 0.0) for f in features]).alias("x"), F.array(*[finite_or(t, 0.0) for t in targets]).alias("y"))


def _arrays(pdf: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = np.frombuffer(b"".join(pdf["x"]), np.uint8).reshape(len(pdf), width)
    return pdf["key"].to_numpy(np.int64), x, np.stack(pdf["y"].to_numpy()).astype(float)


# ---- cells --------------------------------------------------------------------------------------


def grid_shape(cuts: list[np.ndarray]) -> tuple[int, ...]:
    return tuple(len(c) + 1 for c in cuts)


def grid_bins(cuts: list[np.ndarray]) -> np.ndarray:
    """The bins of every cell of the grid."""
    shape = grid_shape(cuts)
    return np.stack(np.unravel_index(np.arange(math.prod(shape)), shape), 1).astype(np.uint8)


def _cells_of(cols: Sequence[pd.Series], cuts: list[np.ndarray]) -> np.ndarray:
    return np.ravel_multi_index([np.searchsorted(c, s.to_numpy(float)) for c, s in zip(cuts, cols, strict=True)], grid_shape(cuts))


def celled(df: DataFrame, features: Sequence[str], values: Sequence[Column], keys: Sequence[str], cuts: list[np.ndarray]) -> DataFrame:
    """``key, cell, v0, v1, ...`` of every row: hash, cell of the grid, values."""

    @F.pandas_udf("int")
    def cell(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(_cells_of(cols, cuts).astype(np.int32))

    return df.select(
        F.xxhash64(*keys).alias("key"), cell(*[finite_or(f, 0.0) for f in features]).alias("cell"), *[v.cast("double").alias(f"v{i}") for i, v in enumerate(values)])


def _slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held, n = [], 0
    for pdf in batches:
        held.append(pdf)
        n += len(pdf)
        if n >= SLICE_ROWS:
            yield pd.concat(held, ignore_index=True)
            held, n = [], 0
    if n:
        yield pd.concat(held, ignore_index=True)


def cell_sums(rows: DataFrame, cells: int, rounds: int, weigh: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    """``round, share, sums``: by cell the weights and the weighted values of every round, over one share of the rows.

    A task holds the sums of as many rounds as fit ``HELD`` bytes; other rounds are other tasks' over the same rows.
    """
    values = [c for c in rows.columns if c.startswith("v")]
    height = 1 + len(values)
    at_once = max(1, HELD // (8 * height * cells))
    few = rows.coalesce(SHARES)

    def adder(some: range) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = np.zeros((len(some), height, cells))
            for pdf in _slices(batches):
                key, cell, v = pdf["key"].to_numpy(np.int64), pdf["cell"].to_numpy(), [pdf[c].to_numpy() for c in values]
                for own, r in zip(total, some, strict=True):
                    w = weigh(key, r)
                    at = np.flatnonzero(w)
                    w, c = w[at], cell[at]
                    own[0] += np.bincount(c, w, cells)
                    for i, u in enumerate(v, 1):
                        own[i] += np.bincount(c, w * u[at], cells)
            for own, r in zip(total, some, strict=True):
                yield pd.DataFrame([(r, TaskContext.get().partitionId(), own.tobytes())], columns=["round", "share", "sums"])

        return add

    parts = [few.mapInPandas(adder(range(a, min(a + at_once, rounds))), "round int, share int, sums binary") for a in range(0, rounds, at_once)]
    return functools.reduce(DataFrame.unionAll, parts)


def _added(pdf: pd.DataFrame, cells: int) -> np.ndarray:
    """The sums of a round over all shares, always added in the same order."""
    return sum(np.frombuffer(b, float) for b in pdf.sort_values("share")["sums"]).reshape(-1, cells)


def uniform(keys: np.ndarray, *salt: int) -> np.ndarray:
    """Numbers in [0, 1) that follow from keys and salt."""
    h = keys.astype(np.int64).view(np.uint64).copy()
    for s in salt:
        h = (h ^ np.uint64((s * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
    return (h >> np.uint64(11)).astype(float) / (1 << 53)


_DRAWS = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


def draws(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often a tree draws each row: once in the mean, independently."""
    return np.searchsorted(_DRAWS, uniform(keys, seed, tree)).astype(float)


# ---- the forest ---------------------------------------------------------------------------------


def _score(total: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The part of the sum of squares that a node's means explain."""
    return (total**2).sum(axis=-1) / np.maximum(weight, 1e-300)


def best_splits(x: np.ndarray, y: np.ndarray, w: np.ndarray, slot: np.ndarray, slots: int, min_leaf: float) -> tuple[np.ndarray, ...]:
    """Feature (-1 for none), bin and gain of the best split of every slot, and each slot's weight and sums.

    Of equal gains the first feature, then the lowest bin is taken.
    """
    return split_sums(x, w, w[:, None] * y, w * (y**2).sum(axis=1), slot, slots, min_leaf)


def split_sums(x: np.ndarray, w: np.ndarray, wy: np.ndarray, wq: np.ndarray, slot: np.ndarray, slots: int, min_leaf: float) -> tuple[np.ndarray, ...]:
    """``best_splits`` of rows or cells with their weights, weighted targets and weighted sums of squares."""
    weight = np.bincount(slot, w, slots)
    sums = np.stack([np.bincount(slot, wy[:, t], slots) for t in range(wy.shape[1])], 1)
    squares = np.bincount(slot, wq, slots)
    base = _score(sums, weight)
    near = np.maximum(squares, 1e-300) * EQUAL_GAIN
    feature, cut, gain = np.full(slots, -1), np.zeros(slots, int), np.zeros(slots)
    for f in range(x.shape[1]):
        key = slot.astype(np.int64) * (BINS + 1) + x[:, f]
        order = np.argsort(key, kind="stable")
        key = key[order]
        ends = np.flatnonzero(np.diff(key, append=-1) != 0)
        own = key[ends] // (BINS + 1)
        before = np.searchsorted(own, own, "left")  # the first cell of the slot
        cw = np.cumsum(w[order])[ends]
        cs = np.cumsum(wy[order], axis=0)[ends]
        first = before - 1
        lw = cw - np.where(first >= 0, cw[first], 0.0)
        ls = cs - np.where(first[:, None] >= 0, cs[first], 0.0)
        rw, rs = weight[own] - lw, sums[own] - ls
        fair = (lw >= min_leaf) & (rw >= min_leaf) & (np.append(own[1:], -1) == own)
        found = np.where(fair, _score(ls, lw) + _score(rs, rw) - base[own], -np.inf)
        heads = np.flatnonzero(np.diff(own, prepend=-1) != 0)
        top = np.maximum.reduceat(found, heads)
        place = np.flatnonzero(found >= np.repeat(top, np.diff(heads, append=len(own))) - near[own])
        place = place[np.unique(own[place], return_index=True)[1]]
        better = place[found[place] > gain[own[place]] + near[own[place]]]
        feature[own[better]], gain[own[better]], cut[own[better]] = f, found[better], key[ends[better]] % (BINS + 1)
    return feature, cut, np.where(feature >= 0, gain, 0.0), weight, sums


def grow_levels(x: np.ndarray, w: np.ndarray, wy: np.ndarray, wq: np.ndarray, node: int, depth: int, s: ForestSettings) -> list[tuple]:
    """The tree below a node that lies ``depth`` levels down: node, feature, bin, value, weight, gain; children are 2n and 2n + 1.

    Grown from rows or cells as in ``split_sums``.
    """
    out: list[tuple] = []
    ids, slot = np.array([node], np.int64), np.zeros(len(x), np.int64)
    while len(ids):
        feature, cut, gain, weight, sums = split_sums(x, w, wy, wq, slot, len(ids), s.min_leaf)
        if depth >= s.depth:
            feature[:] = -1
        feature[weight < s.min_split] = -1
        value = sums / weight[:, None]
        out += zip(ids.tolist(), feature.tolist(), cut.tolist(), value.tolist(), weight.tolist(), np.where(feature >= 0, gain, 0.0).tolist(), strict=True)
        split = np.flatnonzero(feature >= 0)
        place = np.full(len(ids), -1)
        place[split] = np.arange(len(split))
        live = place[slot] >= 0
        x, w, wy, wq, slot = x[live], w[live], wy[live], wq[live], slot[live]
        right = x[np.arange(len(x)), feature[slot]] > cut[slot]
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], 1).ravel()
        slot, depth = 2 * place[slot] + right, depth + 1
    return out


def _walk(x: np.ndarray, tree: dict[int, tuple[int, int]]) -> np.ndarray:
    """The node that each row of bins has reached, in a tree of splits by node."""
    node = np.ones(len(x), np.int64)
    level = [1] if 1 in tree else []
    while level:
        for n in level:
            at = np.flatnonzero(node == n)
            f, b = tree[n]
            node[at] = 2 * n + (x[at, f] > b)
        level = [c for n in level for c in (2 * n, 2 * n + 1) if c in tree]
    return node


def _node_rows(tree: int, output: int, rows: Sequence[tuple], cuts: list[np.ndarray]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["node", "feature", "cut", "value", "cover", "gain"])
    out.insert(0, "output", output)
    out.insert(0, "tree", tree)
    inner = out["feature"] >= 0
    out["cut"] = [float(cuts[f][b]) if f >= 0 else 0.0 for f, b in zip(out["feature"], out["cut"], strict=True)]
    out["left_id"], out["right_id"] = np.where(inner, 2 * out["node"], -1), np.where(inner, 2 * out["node"] + 1, -1)
    return out[["tree", "output", "node", "feature", "cut", "left_id", "right_id", "value", "cover", "gain"]]


def fit_forest(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], s: ForestSettings = ForestSettings(),
    keys: Sequence[str] | None = None, fit_split: str | None = DEV, seed: int = SEED,
) -> TreeModel:
    """One forest for all targets, on all rows of the fit split. Rows with equal ``keys`` (all columns by default) are drawn alike."""
    dev = df if fit_split is None else df.where(F.col("split") == fit_split)
    cuts, width, outputs = bin_cuts(dev, features), len(features), len(targets)
    keys = keys or [*features, *targets]
    if nodes := _forest_of_cells(dev, features, targets, keys, cuts, s, seed):
        return TreeModel(list(features), list(targets), nodes, np.zeros(outputs), 1.0 / s.trees, cuts)
    rows = binned(dev, features, targets, keys, cuts).persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    n = rows.count()
    if n == 0:
        raise ValueError("no rows in the fit split")
    upper: dict[int, dict[int, tuple[int, int]]] = {t: {} for t in range(s.trees)}
    done: list[pd.DataFrame] = []
    large = {(t, 1) for t in range(s.trees)} if n > NODE_ROWS else set()
    while large:
        found = _split_nodes(rows, upper, large, width, outputs, s, seed)
        large = set()
        for r in found.itertuples():
            done.append(_node_rows(r.tree, -1, [(r.node, r.feature, r.bin, list(r.value), r.weight, r.gain)], cuts))
            if r.feature >= 0:
                upper[r.tree][r.node] = (r.feature, r.bin)
                large |= {(r.tree, 2 * r.node + side) for side, size in enumerate((r.left_rows, r.weight - r.left_rows)) if size > NODE_ROWS}
    leaves = {(int(r.tree.iloc[0]), int(r.node.iloc[0])) for r in done if r.feature.iloc[0] < 0}
    lower = _finish_nodes(rows, upper, leaves, width, cuts, s, seed)
    nodes = lower if not done else lower.unionByName(spark.createDataFrame(pd.concat(done), NODES))
    nodes = nodes.persist(StorageLevel.MEMORY_AND_DISK)
    nodes.count()
    rows.unpersist()
    return TreeModel(list(features), list(targets), nodes, np.zeros(outputs), 1.0 / s.trees, cuts)


def _forest_of_cells(
    dev: DataFrame, features: Sequence[str], targets: Sequence[str], keys: Sequence[str], cuts: list[np.ndarray], s: ForestSettings, seed: int,
) -> DataFrame | None:
    """The nodes of all trees, each grown from its sums by cell; None if the grid is too large or has more cells than there are rows."""
    cells = math.prod(grid_shape(cuts))
    if cells > CELLS:
        return None
    y = [finite_or(t, 0.0).cast("double") for t in targets]
    rows = celled(dev, features, [*y, functools.reduce(operator.add, [v * v for v in y])], keys, cuts).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        if rows.count() <= cells:
            return None

        def grow(pdf: pd.DataFrame) -> pd.DataFrame:
            sums = _added(pdf, cells)
            at = np.flatnonzero(sums[0])
            w, wy, wq = sums[0, at], sums[1:-1, at].T, sums[-1, at]
            return _node_rows(int(pdf["round"].iloc[0]), -1, grow_levels(grid_bins(cuts)[at], w, wy, wq, 1, 0, s) if len(at) else [], cuts)

        nodes = cell_sums(rows, cells, s.trees, lambda key, t: draws(key, t, seed)).groupBy("round").applyInPandas(grow, NODES).persist(StorageLevel.MEMORY_AND_DISK)
        nodes.count()
        return nodes
    finally:
        rows.unpersist()


def _split_nodes(rows: DataFrame, upper: dict, large: set, width: int, outputs: int, s: ForestSettings, seed: int) -> pd.DataFrame:
    """The best splits of all large nodes, from histograms added up over tasks."""
    shared = rows.sparkSession.sparkContext.broadcast((upper, large))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, wanted = shared.value
        total: dict[tuple[int, int], np.ndarray] = {}
        for pdf in batches:
            key, x, y = _arrays(pdf, width)
            for t in {t for t, _ in wanted}:
                w = draws(key, t, seed)
                node = _walk(x, trees[t])
                for own in np.unique(node):
                    if (t, int(own)) in wanted:
                        at = np.flatnonzero(node == own)
                        part = _cells(x[at], y[at], w[at])
                        total[t, int(own)] = total.get((t, int(own)), 0.0) + part
        yield pd.DataFrame([(t, n, h.tobytes()) for (t, n), h in total.items()], columns=["tree", "node", "cells"])

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        cells = sum(np.frombuffer(c, float) for c in pdf["cells"]).reshape(width, BINS + 1, outputs + 2)
        at = np.argwhere(cells[..., 0] > 0)
        # a cell is a row of its weight and mean: the gain needs no more
        best = (-1, 0, 0.0, 0.0)
        weight, sums = cells[0, :, 0].sum(), cells[0, :, 1:-1].sum(axis=0)
        near = max(cells[0, :, -1].sum(), 1e-300) * EQUAL_GAIN
        for f in range(width):
            own = at[at[:, 0] == f, 1]
            lw, ls = np.cumsum(cells[f, own, 0])[:-1], np.cumsum(cells[f, own, 1:-1], axis=0)[:-1]
            gain = _score(ls, lw) + _score(sums - ls, weight - lw) - _score(sums, weight)
            gain[(lw < s.min_leaf) | (weight - lw < s.min_leaf)] = -np.inf
            if len(gain) and (k := int((gain >= gain.max() - near).argmax())) >= 0 and gain[k] > best[2] + near:
                best = (f, int(own[k]), float(gain[k]), float(lw[k]))
        depth = int(pdf["node"].iloc[0]).bit_length() - 1
        if depth >= s.depth or weight < s.min_split:
            best = (-1, 0, 0.0, 0.0)
        return pd.DataFrame([(pdf["tree"].iloc[0], pdf["node"].iloc[0], *best, weight, (sums / weight).tolist())],
                            columns=["tree", "node", "feature", "bin", "gain", "left_rows", "weight", "value"])

    parts = rows.mapInPandas(count, "tree int, node long, cells binary")
    return parts.groupBy("tree", "node").applyInPandas(
        choose, "tree int, node long, feature int, bin int, gain double, left_rows double, weight double, value array<double>").toPandas()


def _cells(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """By feature and bin: weight, sums of targets, sum of squares."""
    columns = [w, *(w * y[:, t] for t in range(y.shape[1])), w * (y**2).sum(axis=1)]
    return np.stack([np.stack([np.bincount(x[:, f], c, BINS + 1) for c in columns], 1) for f in range(x.shape[1])])


def _finish_nodes(rows: DataFrame, upper: dict, leaves: set, width: int, cuts: list[np.ndarray], s: ForestSettings, seed: int) -> DataFrame:
    """The parts of all trees below the splits found so far, each in one task."""
    shared = rows.sparkSession.sparkContext.broadcast((upper, leaves))

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees, ended = shared.value
        for pdf in batches:
            key, x, y = _arrays(pdf, width)
            out = []
            for t, splits in trees.items():
                w = draws(key, t, seed)
                node = _walk(x, splits)
                for own in np.unique(node):
                    at = np.flatnonzero((node == own) & (w > 0))
                    if len(at) and (t, int(own)) not in ended:
                        out.append((t, int(own), pickle.dumps((x[at], y[at], w[at].astype(np.uint8)), protocol=5)))
            yield pd.DataFrame(out, columns=["tree", "node", "rows"])

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (np.concatenate(part) for part in zip(*map(pickle.loads, pdf["rows"]), strict=True))
        tree, node = int(pdf["tree"].iloc[0]), int(pdf["node"].iloc[0])
        w = w.astype(float)
        return _node_rows(tree, -1, grow_levels(x, w, w[:, None] * y, w * (y**2).sum(axis=1), node, node.bit_length() - 1, s), cuts)

    return rows.mapInPandas(deal, "tree int, node long, rows binary").groupBy("tree", "node").applyInPandas(finish, NODES)


# ---- boosting -----------------------------------------------------------------------------------

#: A box of bins: its lowest and highest bin by feature.
Box = tuple[tuple[int, int], ...]


def _best_cut(cells: np.ndarray, columns: np.ndarray, s: BoostSettings) -> tuple[float, int, int] | None:
    """Gain, feature and bin of the best split of a leaf's histogram of counts and residual sums."""
    n, g = cells[0, :, 0].sum(), cells[0, :, 1].sum()
    ln, lg = np.cumsum(cells[columns, :, 0], axis=1), np.cumsum(cells[columns, :, 1], axis=1)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = lg**2 / (ln + s.l2) + (g - lg) ** 2 / (n - ln + s.l2) - g**2 / (n + s.l2)
    gain[(ln < s.min_leaf) | (n - ln < s.min_leaf) | (cells[columns, :, 0] == 0)] = -np.inf
    top = float(gain.max())
    f, b = divmod(int((gain >= top - EQUAL_GAIN * abs(top)).argmax()), cells.shape[1])
    return (top, int(columns[f]), b) if top > 1e-12 * max(n, 1.0) else None


def leaf_wise(width: int, columns: np.ndarray, s: BoostSettings) -> Generator[Box, np.ndarray, list[tuple]]:
    """Grows one tree, best leaf first: asks for the histogram of a box and gets it; returns its nodes.

    Nodes are numbered as they are made, the root 0: node, feature, bin, left, right, value, weight, gain.
    """
    root: Box = tuple((0, BINS) for _ in range(width))
    cells = yield root
    nodes: dict[int, list] = {}
    waiting: list[tuple] = []

    def leaf(node: int, box: Box, cells: np.ndarray, depth: int) -> None:
        n, g = cells[0, :, 0].sum(), cells[0, :, 1].sum()
        nodes[node] = [node, -1, 0, -1, -1, s.step * g / (n + s.l2) if n + s.l2 else 0.0, n, 0.0]
        cut = _best_cut(cells, columns, s) if s.depth is None or depth < s.depth else None
        if cut:
            heapq.heappush(waiting, (-cut[0], node, cut, box, cells, depth))

    leaf(0, root, cells, 0)
    while waiting and (s.leaves is None or (len(nodes) + 1) // 2 < s.leaves):
        _, node, (gain, f, b), box, cells, depth = heapq.heappop(waiting)
        sides = [tuple((lo, b) if k == f else (lo, hi) for k, (lo, hi) in enumerate(box)), tuple((b + 1, hi) if k == f else (lo, hi) for k, (lo, hi) in enumerate(box))]
        small = int(2 * cells[f, : b + 1, 0].sum() > cells[f, :, 0].sum())
        counted = yield sides[small]
        parts = (counted, cells - counted) if small == 0 else (cells - counted, counted)
        left = len(nodes)
        nodes[node][1:5] = f, b, left, left + 1
        nodes[node][7] = gain
        for child, (side, part) in enumerate(zip(sides, parts, strict=True)):
            leaf(left + child, side, part, depth + 1)
    return [tuple(n) for n in nodes.values()]


def _columns(width: int, share: float, *salt: int) -> np.ndarray:
    take = max(1, int(share * width))
    return np.sort(np.argsort(uniform(np.arange(width), *salt), kind="stable")[:take])


def _inside(x: np.ndarray, box: Box) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for f, (lo, hi) in enumerate(box):
        if lo > 0 or hi < BINS:
            hit &= (x[:, f] >= lo) & (x[:, f] <= hi)
    return hit


def _leaf_values(x: np.ndarray, nodes: list[tuple]) -> np.ndarray:
    """A tree's value for rows of bins."""
    feature, cut, left, right, value = (np.array([n[k] for n in nodes]) for k in range(1, 6))
    at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
    while (inner := feature[at] >= 0).any():
        at = np.where(inner, np.where(x[rows, feature[at]] <= cut[at], left[at], right[at]), at)
    return value[at]


def _count(x: np.ndarray, r: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
    """By feature and bin: rows and their residuals' sum; of cells, ``n`` is how many rows each has."""
    return np.stack([np.stack([np.bincount(x[:, f], n, BINS + 1), np.bincount(x[:, f], r, BINS + 1)], 1) for f in range(x.shape[1])])


def grow_leaf_wise(x: np.ndarray, r: np.ndarray, n: np.ndarray | None, columns: np.ndarray, s: BoostSettings) -> list[tuple]:
    """One tree on the residuals of rows, or of cells with ``n`` rows each."""
    members = {tuple((0, BINS) for _ in range(x.shape[1])): np.arange(len(x))}
    grower = leaf_wise(x.shape[1], columns, s)
    box = next(grower)
    try:
        while True:
            at = members.get(box)
            if at is None:
                # the rows of the smallest box around it that is known
                around = min((m for b, m in members.items() if all(o[0] <= i[0] and i[1] <= o[1] for o, i in zip(b, box, strict=True))), key=len)
                at = members[box] = around[_inside(x[around], box)]
            box = grower.send(_count(x[at], r[at], None if n is None else n[at]))
    except StopIteration as end:
        return end.value


def boost_rows(key: np.ndarray, x: np.ndarray, y: np.ndarray, base: float, output: int, s: BoostSettings, seed: int) -> list[list[tuple]]:
    """All rounds of one target on rows in memory."""
    pred, trees = np.full(len(x), base), []
    for k in range(s.rounds):
        taken = np.flatnonzero(uniform(key, seed, k) < s.rows)
        trees.append(grow_leaf_wise(x[taken], (y - pred)[taken], None, _columns(x.shape[1], s.columns, seed, k, output), s))
        pred = pred + _leaf_values(x, trees[-1])
    return trees


def _boost_cells(rows: DataFrame, base: np.ndarray, cuts: list[np.ndarray], s: BoostSettings, seed: int) -> DataFrame:
    """The nodes of all rounds of all targets, each target grown in a task from its sums by cell, a round after the other."""
    cells, outputs = math.prod(grid_shape(cuts)), len(base)

    def deal(pdf: pd.DataFrame) -> pd.DataFrame:
        total = _added(pdf, cells)
        return pd.DataFrame(
            [(int(pdf["round"].iloc[0]), t, np.stack([total[0], total[1 + t]]).tobytes()) for t in range(outputs)], columns=["round", "output", "sums"])

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, own = grid_bins(cuts), -1
        for pdf in batches:
            for r in pdf.itertuples():
                if r.output != own:
                    own, pred = r.output, np.full(cells, base[r.output])
                n, total = np.frombuffer(r.sums, float).reshape(2, cells)
                at = np.flatnonzero(n)
                tree = grow_leaf_wise(x[at], (total - n * pred)[at], n[at], _columns(x.shape[1], s.columns, seed, r.round, own), s)
                pred = pred + _leaf_values(x, tree)
                yield pd.DataFrame(_boost_nodes(r.round, own, tree, cuts), columns=[c.split()[0] for c in NODES.split(", ")])

    sums = cell_sums(rows, cells, s.rounds, lambda key, k: (uniform(key, seed, k) < s.rows).astype(float))
    dealt = sums.groupBy("round").applyInPandas(deal, "round int, output int, sums binary")
    return dealt.repartitionByRange(outputs, "output").sortWithinPartitions("output", "round").mapInPandas(fit, NODES)


def _boost_spread(rows: DataFrame, base: np.ndarray, width: int, s: BoostSettings, seed: int) -> list[list[list[tuple]]]:
    """All rounds of all targets over rows in many tasks; the targets' growers advance together."""
    outputs = len(base)
    trees: list[list[list[tuple]]] = [[] for _ in range(outputs)]
    state, kept = rows.withColumn("p", F.array(*[F.lit(float(b)) for b in base])).persist(StorageLevel.MEMORY_AND_DISK), 0
    for k in range(s.rounds):
        growers = [leaf_wise(width, _columns(width, s.columns, seed, k, t), s) for t in range(outputs)]
        asked = {t: next(g) for t, g in enumerate(growers)}
        while asked:
            found = _histograms(state, asked, [t[kept:] for t in trees], width, s.rows, seed, k)
            following = {}
            for t in asked:
                try:
                    following[t] = growers[t].send(found[t])
                except StopIteration as end:
                    trees[t].append(end.value)
            asked = following
        if (k + 1) % KEEP_ROUNDS == 0:
            new = _advanced(state, [t[kept:] for t in trees], width).persist(StorageLevel.MEMORY_AND_DISK)
            new.count()
            state.unpersist()
            state, kept = new, k + 1
    state.unpersist()
    return trees


def _predictions(pdf: pd.DataFrame, x: np.ndarray, trees: list[list[list[tuple]]]) -> np.ndarray:
    p = np.stack(pdf["p"].to_numpy()).astype(float)
    for t, own in enumerate(trees):
        for tree in own:
            p[:, t] += _leaf_values(x, tree)
    return p


def _histograms(state: DataFrame, asked: dict[int, Box], trees: list, width: int, share: float, seed: int, k: int) -> dict[int, np.ndarray]:
    shared = state.sparkSession.sparkContext.broadcast(trees)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = {t: np.zeros((width, BINS + 1, 2)) for t in asked}
        for pdf in batches:
            key, x, y = _arrays(pdf, width)
            rest = y - _predictions(pdf, x, shared.value)
            taken = uniform(key, seed, k) < share
            for t, box in asked.items():
                at = np.flatnonzero(taken & _inside(x, box))
                total[t] += _count(x[at], rest[at, t])
        yield pd.DataFrame([(t, h.tobytes()) for t, h in total.items()], columns=["output", "cells"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf["output"].iloc[0], sum(np.frombuffer(c, float) for c in pdf["cells"]).tobytes())], columns=["output", "cells"])

    kind = "output int, cells binary"
    out = state.mapInPandas(count, kind).groupBy("output").applyInPandas(add, kind).collect()
    return {r["output"]: np.frombuffer(r["cells"], float).reshape(width, BINS + 1, 2) for r in out}


def _advanced(state: DataFrame, trees: list, width: int) -> DataFrame:
    shared = state.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = _arrays(pdf, width)[1]
            yield pdf.assign(p=list(_predictions(pdf, x, shared.value)))

    return state.mapInPandas(run, state.schema)


def _boost_nodes(k: int, output: int, tree: list[tuple], cuts: list[np.ndarray]) -> list[tuple]:
    return [
        (k, output, node, f, float(cuts[f][b]) if f >= 0 else 0.0, left, right, [float(value)], float(n), float(gain))
        for node, f, b, left, right, value, n, gain in tree
    ]


def fit_boosted(
    df: DataFrame, features: Sequence[str], targets: Sequence[str], s: BoostSettings = BoostSettings(),
    keys: Sequence[str] | None = None, fit_split: str | None = DEV, seed: int = SEED,
) -> TreeModel:
    """Boosted trees for each target, on all rows of the fit split."""
    dev = df if fit_split is None else df.where(F.col("split") == fit_split)
    cuts, width = bin_cuts(dev, features), len(features)
    keys = keys or [*features, *targets]
    if (cells := math.prod(grid_shape(cuts))) <= CELLS:
        rows = celled(dev, features, [finite_or(t, 0.0) for t in targets], keys, cuts).persist(StorageLevel.MEMORY_AND_DISK)
        one = rows.agg(F.count(F.lit(1)), *[F.avg(f"v{t}") for t in range(len(targets))]).first()
        if one[0] > cells:
            base = np.array(one[1:], float)
            nodes = _boost_cells(rows, base, cuts, s, seed).persist(StorageLevel.MEMORY_AND_DISK)
            nodes.count()
            rows.unpersist()
            return TreeModel(list(features), list(targets), nodes, base, 1.0, cuts)
        rows.unpersist()
    rows = binned(dev, features, targets, keys, cuts).persist(StorageLevel.MEMORY_AND_DISK)
    spark = df.sparkSession
    one = rows.agg(F.count(F.lit(1)), *[F.avg(F.col("y")[t]) for t in range(len(targets))]).first()
    if not one[0]:
        raise ValueError("no rows in the fit split")
    base = np.array(one[1:], float)
    if one[0] > FIT_ROWS:
        trees = _boost_spread(rows, base, width, s, seed)
        every = [r for t, own in enumerate(trees) for k, tree in enumerate(own) for r in _boost_nodes(k, t, tree, cuts)]
        nodes = spark.createDataFrame(every, NODES)
    else:
        def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                key, x, y = _arrays(pdf, width)
                yield pd.DataFrame([(t, pickle.dumps((key, x, y[:, t]), protocol=5)) for t in range(len(targets))], columns=["output", "rows"])

        def fit(pdf: pd.DataFrame) -> pd.DataFrame:
            key, x, y = (np.concatenate(part) for part in zip(*map(pickle.loads, pdf["rows"]), strict=True))
            order = np.argsort(key, kind="stable")  # sums don't depend on how rows arrive
            output = int(pdf["output"].iloc[0])
            trees = boost_rows(key[order], x[order], y[order], float(base[output]), output, s, seed)
            return pd.DataFrame([r for k, tree in enumerate(trees) for r in _boost_nodes(k, output, tree, cuts)], columns=[c.split()[0] for c in NODES.split(", ")])

        nodes = rows.mapInPandas(deal, "output int, rows binary").groupBy("output").applyInPandas(fit, NODES)
    nodes = nodes.persist(StorageLevel.MEMORY_AND_DISK)
    nodes.count()
    rows.unpersist()
    return TreeModel(list(features), list(targets), nodes, base, 1.0, cuts)


# ---- models -------------------------------------------------------------------------------------


@dataclass
class TreeModel:
    """Nodes of all trees; a prediction is ``base + scale * sum of leaves``. All their splits are at ``cuts``, if these are given."""

    features: list[str]
    targets: list[str]
    nodes: DataFrame
    base: np.ndarray
    scale: float
    cuts: list[np.ndarray] | None = None
    _blocks: list[list[tuple]] = field(default_factory=list, repr=False)
    _grid: np.ndarray | None = field(default=None, repr=False)

    def blocks(self) -> list[list[tuple]]:
        """Trees as arrays, in blocks of at most ``BLOCK_NODES`` nodes or one tree: output, feature, cut, left, right, value, cover."""
        if not self._blocks:
            sizes = self.nodes.groupBy("tree").count().orderBy("tree").collect()
            bounds, held = [sizes[0]["tree"]], 0
            for r in sizes:
                if held and held + r["count"] > BLOCK_NODES:
                    bounds.append(r["tree"])
                    held = 0
                held += r["count"]
            for a, b in zip(bounds, [*bounds[1:], sizes[-1]["tree"] + 1], strict=True):
                part = self.nodes.where((F.col("tree") >= a) & (F.col("tree") < b)).toPandas().sort_values(["tree", "output", "node"])
                self._blocks.append([_compiled(g) for _, g in part.groupby(["tree", "output"])])
        return self._blocks

    def release(self) -> None:
        self.nodes.unpersist()

    def grid_scores(self) -> np.ndarray:
        """The sum of all trees' leaves for every cell of the grid and every output, trees as tasks."""
        if self._grid is None:
            cuts, outputs = self.cuts, len(self.targets)
            cells = math.prod(grid_shape(cuts))

            def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                x = np.stack([np.append(c, np.inf)[b] for c, b in zip(cuts, grid_bins(cuts).T, strict=True)], 1)
                total = np.zeros((cells, outputs))
                for pdf in whole_trees(batches):
                    for _, g in pdf.groupby(["tree", "output"]):
                        total += tree_sums(x, [_compiled(g.sort_values("node"))], outputs)
                yield pd.DataFrame([(0, TaskContext.get().partitionId(), total.tobytes())], columns=["round", "share", "sums"])

            dealt = self.nodes.repartition(2 * SHARES, "tree", "output").sortWithinPartitions("tree", "output", "node")
            self._grid = _added(dealt.mapInPandas(run, "round int, share int, sums binary").toPandas(), outputs)
        return self._grid

    def predict(self, df: DataFrame, prefix: str) -> DataFrame:
        """Add ``<prefix><target>`` for every target."""
        if self.cuts is not None and math.prod(grid_shape(self.cuts)) <= CELLS:
            score = _cell_scorer(df.sparkSession.sparkContext.broadcast(self.grid_scores()), self.cuts, len(self.targets))
            out = df.withColumn("_sums", score(*[finite_or(f, 0.0) for f in self.features]))
            return out.withColumns({f"{prefix}{t}": F.lit(float(b)) + F.lit(self.scale) * F.col("_sums")[f"v{i}"] for i, (t, b) in enumerate(zip(self.targets, self.base, strict=True))}).drop("_sums")
        names = [f"_in_{f}" for f in self.features]
        outputs = len(self.targets)
        out = df.withColumns({n: finite_or(f, 0.0) for n, f in zip(names, self.features, strict=True)})
        total = [F.lit(float(b)) for b in self.base]
        for k, block in enumerate(self.blocks()):
            out = out.withColumn(f"_sum_{k}", _scorer(df.sparkSession.sparkContext.broadcast(block), outputs)(*names))
            total = [t + F.lit(self.scale) * F.col(f"_sum_{k}")[i] for i, t in enumerate(total)]
        return out.withColumns({f"{prefix}{t}": v for t, v in zip(self.targets, total, strict=True)}).drop(*names, *[f"_sum_{k}" for k in range(len(self._blocks))])

    def importances(self, name: str) -> DataFrame:
        """Share of each feature in the gains of a tree, averaged over trees, largest first."""
        names = F.array(*map(F.lit, self.features))
        every = SparkSession.active().createDataFrame([(f,) for f in self.features], "feature string")
        gains = self.nodes.where("feature >= 0").groupBy("tree", "output", names[F.col("feature")].alias("feature")).agg(F.sum("gain").alias("g"))
        totals = gains.groupBy("tree", "output").agg(F.sum("g").alias("total"))
        shares = gains.join(totals, ["tree", "output"]).groupBy("feature").agg(F.sum(F.col("g") / F.col("total")).alias("share"))
        trees = self.nodes.select("tree", "output").distinct().count()
        return every.join(shares, "feature", "left").select(
            F.lit(name).alias("model"), "feature", (F.coalesce("share", F.lit(0.0)) / trees).alias("importance")).orderBy(F.desc("importance"), "feature")


def _compiled(g: pd.DataFrame) -> tuple:
    ids = g["node"].to_numpy()
    left, right = np.searchsorted(ids, g["left_id"]), np.searchsorted(ids, g["right_id"])
    value = np.stack(g["value"].to_numpy()).astype(float)
    return int(g["output"].iloc[0]), g["feature"].to_numpy(np.int32), g["cut"].to_numpy(float), left.astype(np.int32), right.astype(np.int32), value, g["cover"].to_numpy(float)


def whole_trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted nodes cut between trees only."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        if len(pdf):
            last = (pdf["tree"] == pdf["tree"].iloc[-1]) & (pdf["output"] == pdf["output"].iloc[-1])
            if not last.all():
                yield pdf[~last]
            rest = pdf[last]
    if rest is not None and len(rest):
        yield rest


def _cell_scorer(shared, cuts: list[np.ndarray], outputs: int):
    names = [f"v{i}" for i in range(outputs)]

    @F.pandas_udf(", ".join(f"{n} double" for n in names))
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            yield pd.DataFrame(shared.value[_cells_of(cols, cuts)], columns=names)

    return score


def _scorer(shared, outputs: int):
    @F.pandas_udf("array<double>")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(list(tree_sums(np.column_stack([c.to_numpy(float) for c in cols]), shared.value, outputs)))

    return score


def tree_sums(x: np.ndarray, trees: list[tuple], outputs: int) -> np.ndarray:
    """The sum of the trees' leaves for each row and output."""
    total, rows = np.zeros((len(x), outputs)), np.arange(len(x))
    for output, feature, cut, left, right, value, _ in trees:
        node = np.zeros(len(x), np.int32)
        while True:
            f = feature[node]
            if (f < 0).all():
                break
            low = x[rows, np.maximum(f, 0)] <= cut[node]
            node = np.where(f >= 0, np.where(low, left[node], right[node]), node)
        if output < 0:
            total += value[node]
        else:
            total[:, output] += value[node, 0]
    return total
