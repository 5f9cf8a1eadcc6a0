"""Detectors fitted on residual features: isolation forest, covariance distance, sequences."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetpulse.functions.exprs import finite_or
from fleetpulse.functions.linear import squared_norm
from fleetpulse.functions.quantiles import quantile_values
from fleetpulse.operators.anomaly import min_max_score, min_max_scores
from fleetpulse.operators.prepare import Standardizer, fit_standardizer, sequences
from fleetpulse.streaming.storage import stored
from fleetpulse.settings import BLOCK_ROWS, DEV, LOOKUP_ROWS, SEQ, SEQUENCE_ROWS, TRAJECTORY

SEED = 42
TREES = 200
# Rows per tree by default, as in the original isolation forest paper; any number can be asked for.
TREE_ROWS = 256
# Rows of a tree's node that one task may grow on; larger nodes are split by aggregations.
NODE_ROWS = 1 << 16
PERCENTILE = 0.99
PRECISION_RIDGE = 1e-6
EULER_GAMMA = 0.5772156649015329
# Raw score of an average row; higher is more anomalous.
OFFSET = 0.5

ROW_KEYS = (*TRAJECTORY, SEQ)


def rows_per_tree(wanted: int | None, sample_rows: int) -> int:
    """Rows that each tree is grown on: all sampled ones for ``None``."""
    if wanted is not None and wanted < 1:
        raise ValueError("a tree needs at least one row")
    return sample_rows if wanted is None else min(wanted, sample_rows)


def expected_path(n: np.ndarray | float) -> np.ndarray:
    """Mean search depth among n rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER_GAMMA) - 2.0 * (safe - 1.0) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def grow_tree(x: np.ndarray, rng: np.random.Generator, max_depth: int, root: int = 1) -> list[tuple[int, int, float, int, int, float, int]]:
    """Nodes below ``root``: id, feature (-1 at a leaf), cut, left, right, path length, rows.

    The root of a tree is 1 and the children of n are 2n and 2n + 1, so a node's depth follows from its id.
    """
    nodes: list[tuple[int, int, float, int, int, float, int]] = []
    todo = [(root, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        part, depth = x[rows], node.bit_length() - 1
        lo, hi = part.min(axis=0), part.max(axis=0)
        split_on = np.flatnonzero(hi > lo)
        if depth >= max_depth or len(rows) <= 1 or len(split_on) == 0:
            nodes.append((node, -1, 0.0, -1, -1, float(depth + expected_path(len(rows))), len(rows)))
            continue
        f = int(rng.choice(split_on))
        cut = random_cut(rng, lo[f], hi[f])
        left = part[:, f] < cut
        nodes.append((node, f, cut, 2 * node, 2 * node + 1, 0.0, len(rows)))
        todo += [(2 * node, rows[left]), (2 * node + 1, rows[~left])]
    return nodes


def random_cut(rng: np.random.Generator, low: float, high: float) -> float:
    """A cut between two values that leaves rows on both sides."""
    cut = float(rng.uniform(low, high))
    return cut if cut > low else float(np.nextafter(low, high))


@dataclass(frozen=True)
class IsolationForest:
    """Standardisation and the trees as arrays: feature, cut, left, right, path."""

    features: list[str]
    scaler: Standardizer
    trees: list[tuple[np.ndarray, ...]]
    tree_rows: int
    fit_rows: int


ISOLATION_NODES = "tree_id int, node_id long, feature int, cut double, left_id long, right_id long, path double, rows long"


def isolation_trees(
    rows: DataFrame,
    features: Sequence[str],
    trees: int = TREES,
    tree_rows: int | None = TREE_ROWS,
    keys: Sequence[str] = ROW_KEYS,
    seed: int = SEED,
    fit_rows: int | None = None,
    node_rows: int = NODE_ROWS,
) -> DataFrame:
    """Node table of the forest, each tree grown on its own draw from all rows.

    A node of more than ``node_rows`` rows is split by one aggregation, which gives the lowest and
    highest value of every feature of all such nodes of all trees, and its rows move on to its
    children; the split follows from tree, node and seed. Smaller nodes are finished in one task
    each. A draw of up to ``node_rows`` rows has exactly that many; a larger one as many in the mean.
    """
    n = rows.count() if fit_rows is None else fit_rows
    wanted = rows_per_tree(tree_rows, n)
    share = min(1.0, wanted / max(n, 1))
    exact = wanted < n and wanted <= node_rows
    drawn = (
        rows.select(*keys, F.array(*features).alias("_x"))
        .withColumn("tree_id", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        .withColumn("_hash", F.xxhash64(*keys, "tree_id", F.lit(seed)))
    )
    if wanted < n:
        # a hash cut leaves little more than the wanted rows of each tree, which are ranked
        limit = min(1.0, share + (8.0 * math.sqrt(wanted) / max(n, 1) if exact else 0.0))
        if limit < 1.0:
            drawn = drawn.where(F.col("_hash") < F.lit(int(-(2 ** 63) + limit * 2 ** 64)))
    if exact:
        w = Window.partitionBy("tree_id").orderBy("_hash", *keys)
        drawn = drawn.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= wanted)
    depth = max(1, math.ceil(math.log2(max(wanted, 2))))
    drawn = drawn.select("tree_id", F.lit(1).cast("long").alias("node_id"), "_hash", "_x")
    spark, upper = rows.sparkSession, []
    large = wanted > node_rows
    while large:
        drawn = stored(drawn)
        bounds = drawn.groupBy("tree_id", "node_id").agg(
            F.count(F.lit(1)).alias("rows"), F.array(*[F.min(F.col("_x")[i]) for i in range(len(features))]).alias("lo"),
            F.array(*[F.max(F.col("_x")[i]) for i in range(len(features))]).alias("hi")).where(F.col("rows") > node_rows).collect()
        splits = [s for s in (_isolation_split(r, seed, depth) for r in bounds) if s]
        if not splits:
            break
        upper += splits
        table = spark.createDataFrame([(t, k, f, c) for t, k, f, c, *_ in splits], "tree_id int, node_id long, _f int, _cut double")
        # as many rows as nodes of more than node_rows rows
        moved = drawn.join(F.broadcast(table) if len(splits) <= LOOKUP_ROWS else table, ["tree_id", "node_id"], "left")
        right = (F.get("_x", F.col("_f")) >= F.col("_cut")).cast("long")
        drawn = moved.select("tree_id", F.when(F.col("_f").isNull(), F.col("node_id")).otherwise(2 * F.col("node_id") + right).alias("node_id"), "_hash", "_x")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        # rows are put in an order of their own, so that the tree doesn't depend on how they arrive
        pdf = pdf.assign(_text=pdf["_x"].map(lambda v: v.tobytes())).sort_values(["_hash", "_text"])
        tree, root = int(pdf["tree_id"].iloc[0]), int(pdf["node_id"].iloc[0])
        nodes = grow_tree(np.stack(pdf["_x"].to_numpy()), np.random.default_rng([seed, tree, root]), depth, root)
        out = pd.DataFrame(nodes, columns=["node_id", "feature", "cut", "left_id", "right_id", "path", "rows"])
        out.insert(0, "tree_id", tree)
        return out

    lower = drawn.groupBy("tree_id", "node_id").applyInPandas(grow, ISOLATION_NODES)
    return lower.unionByName(spark.createDataFrame([(*s[:4], 2 * s[1], 2 * s[1] + 1, 0.0, s[4]) for s in upper], ISOLATION_NODES)) if upper else lower


def _isolation_split(node, seed: int, depth: int) -> tuple[int, int, int, float, int] | None:
    """Tree, node, feature, cut and rows of a node's split; none where its rows are equal or it is deep enough."""
    lo, hi = np.array(node["lo"]), np.array(node["hi"])
    open_ = np.flatnonzero(hi > lo)
    if not len(open_) or int(node["node_id"]).bit_length() - 1 >= depth:
        return None
    rng = np.random.default_rng([seed, node["tree_id"], node["node_id"]])
    f = int(rng.choice(open_))
    return node["tree_id"], node["node_id"], f, random_cut(rng, lo[f], hi[f]), node["rows"]


def fit_isolation_forest(
    df: DataFrame,
    features: Sequence[str],
    trees: int = TREES,
    max_samples: int | None = TREE_ROWS,
    keys: Sequence[str] = ROW_KEYS,
    seed: int = SEED,
    fit_split: str = DEV,
    node_rows: int = NODE_ROWS,
) -> IsolationForest:
    """Grow trees on draws of ``max_samples`` rows (``None``: all) from all standardised rows of the fit split.

    The node table is collected: at most ``trees * (2 * rows per tree)`` small rows.
    """
    dev = df.where(F.col("split") == fit_split)
    scaler = fit_standardizer(dev, features, None)
    clean = scaler.transform(dev.select(*keys, *[finite_or(f, 0.0).alias(f) for f in features])).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n = clean.count()
        if n == 0:
            raise ValueError("no rows in the fit split")
        nodes = isolation_trees(clean, features, trees, max_samples, keys, seed, n, node_rows).toPandas()
    finally:
        clean.unpersist()
    return IsolationForest(list(features), scaler, [_tree_arrays(g) for _, g in nodes.groupby("tree_id")], rows_per_tree(max_samples, n), n)


def _tree_arrays(nodes: pd.DataFrame) -> tuple[np.ndarray, ...]:
    nodes = nodes.sort_values("node_id")
    ids = nodes["node_id"].to_numpy()
    children = (np.searchsorted(ids, nodes[c]) for c in ("left_id", "right_id"))
    return nodes["feature"].to_numpy(), nodes["cut"].to_numpy(), *children, nodes["path"].to_numpy()


def forest_path(model: IsolationForest, x: np.ndarray) -> np.ndarray:
    """Mean path length of each row over all trees."""
    total = np.zeros(len(x))
    width, flat = x.shape[1], np.ascontiguousarray(x).ravel()
    at = np.arange(len(x)) * width
    for feature, cut, left, right, path in model.trees:
        # a leaf is its own child, so that all rows take as many steps as the tree is deep
        own = np.arange(len(feature))
        child = np.stack([np.where(feature < 0, own, left), np.where(feature < 0, own, right)], 1).ravel()
        f, node = np.maximum(feature, 0), np.zeros(len(x), dtype=int)
        for _ in range(_steps(feature, left, right)):
            node = child.take(2 * node + ~(flat.take(at + f.take(node)) < cut.take(node)))
        total += path[node]
    return total / len(model.trees)


def _steps(feature: np.ndarray, left: np.ndarray, right: np.ndarray) -> int:
    """Levels of a tree below its root."""
    level, steps = np.zeros(1, dtype=int), 0
    while len(level := level[feature[level] >= 0]):
        level, steps = np.concatenate([left[level], right[level]]), steps + 1
    return steps


def isolation_raw_scores(df: DataFrame, model: IsolationForest) -> DataFrame:
    """Raw score (higher is more anomalous) and label of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    names = [f"_s_{f}" for f in model.features]

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        m = shared.value
        scale = float(expected_path(m.tree_rows)) or 1.0
        for cols in batches:
            x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
            yield pd.Series(np.power(2.0, -forest_path(m, x) / scale) - OFFSET)

    scaled = df.withColumns({
        n: (finite_or(f, 0.0) - F.lit(model.scaler.means[f])) / F.lit(model.scaler.stds[f]) for n, f in zip(names, model.features)
    })
    out = scaled.withColumn("iforest_raw_score", score(*names)).drop(*names)
    return out.withColumn("iforest_anomaly_label", (F.col("iforest_raw_score") > 0).cast("int"))


def isolation_scores(df: DataFrame, model: IsolationForest) -> DataFrame:
    """Scores scaled to [0, 1] over all rows. The Python scoring pass is kept, not repeated."""
    raw = isolation_raw_scores(df, model).persist(StorageLevel.MEMORY_AND_DISK)
    return min_max_score(raw, "iforest_raw_score", "iforest_anomaly_score").withColumn(
        "iforest_feature_count", F.lit(len(model.features)))


@dataclass(frozen=True)
class Distance:
    """Standardisation, mean and precision of the covariance detector."""

    features: list[str]
    scaler: Standardizer
    mean: list[float]
    covariance: np.ndarray
    precision: np.ndarray
    shrinkage: float
    rows: int


def gram_matrix(df: DataFrame, columns: Sequence[str]) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums of products, sums, sum of fourth powers of row norms about 0, and row count.

    Each partition adds up one small matrix; the matrices are summed by cell on the
    executors and only the p x p result is collected.
    """
    names = list(columns)
    p = len(names)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g, n = np.zeros((p + 1, p + 1)), 0
        fourth = 0.0
        for pdf in batches:
            x = np.column_stack([np.ones(len(pdf)), pdf.to_numpy(dtype=float)])
            g += x.T @ x
            sq = np.einsum("ij,ij->i", x[:, 1:], x[:, 1:])
            fourth += float(sq @ sq)
            n += len(pdf)
        if n:
            i, j = np.indices(g.shape)
            yield pd.DataFrame({"i": np.append(i.ravel(), -1), "j": np.append(j.ravel(), -1), "v": np.append(g.ravel(), fourth)})

    cells = df.select(*names).mapInPandas(partial, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros((p + 1, p + 1))
    inner = cells[cells["i"] >= 0]
    out[inner["i"], inner["j"]] = inner["v"]
    fourth = float(cells.loc[cells["i"] < 0, "v"].sum())
    return out[1:, 1:], out[0, 1:], fourth, int(round(out[0, 0]))


def shrunk_covariance(gram: np.ndarray, fourth: float, n: int) -> tuple[np.ndarray, float]:
    """Covariance pulled towards a multiple of the identity (Ledoit and Wolf, 2004).

    ``gram`` and ``fourth`` are of centred rows.
    """
    p = len(gram)
    cov = gram / n
    mu = np.trace(cov) / p
    spread = float((cov ** 2).sum())
    delta = (spread - 2.0 * mu * np.trace(cov) + p * mu ** 2) / p
    beta = min((fourth / n - spread) / (p * n), delta)
    share = 0.0 if delta <= 0 or beta <= 0 else beta / delta
    return (1.0 - share) * cov + share * mu * np.eye(p), share


def fit_distance(
    df: DataFrame,
    features: Sequence[str],
    ridge: float = PRECISION_RIDGE,
    fit_split: str = DEV,
) -> Distance:
    """Mean and regularised precision of the standardised fit split, over all its rows."""
    dev = df.where(F.col("split") == fit_split).select(*[finite_or(f, 0.0).alias(f) for f in features])
    scaler = fit_standardizer(dev, features, None)
    scaled = scaler.transform(dev)
    gram, sums, _, n = gram_matrix(scaled, features)
    if n == 0:
        raise ValueError("no rows in the fit split")
    mean = sums / n
    centred = scaled.select(*[(F.col(f) - F.lit(float(m))).alias(f) for f, m in zip(features, mean)])
    gram, _, fourth, n = gram_matrix(centred, features)
    cov, share = shrunk_covariance(gram, fourth, n)
    precision = np.linalg.pinv(cov) + ridge * np.eye(len(features))
    return Distance(list(features), scaler, mean.tolist(), cov, precision, share, n)


def covariance_table(model: Distance, spark) -> DataFrame:
    rows = [(a, b, float(model.covariance[i, j]), float(model.shrinkage))
            for i, a in enumerate(model.features) for j, b in enumerate(model.features)]
    return spark.createDataFrame(rows, "first_feature string, second_feature string, covariance double, shrinkage double")


def distances(df: DataFrame, model: Distance) -> DataFrame:
    """Distance of each standardised row from the fitted centre."""
    names = [f"_s_{f}" for f in model.features]
    scaled = df.withColumns({
        n: (finite_or(f, 0.0) - F.lit(model.scaler.means[f])) / F.lit(model.scaler.stds[f]) for n, f in zip(names, model.features)
    })
    # a rounded pseudo-inverse can be slightly indefinite
    values, vectors = np.linalg.eigh(model.precision)
    root = np.sqrt(np.maximum(values, 0.0))[:, None] * vectors.T
    out = squared_norm(scaled, names, model.mean, root, "_d2")
    return out.withColumn("mahalanobis_distance", F.sqrt(F.greatest("_d2", F.lit(0.0)))).drop("_d2", *names)


def distance_scores(
    df: DataFrame,
    model: Distance,
    percentile: float = PERCENTILE,
    fit_split: str = DEV,
    fit_rows: DataFrame | None = None,
) -> DataFrame:
    """Distance, label against the fit split's percentile, and score over all rows.

    ``fit_rows`` are the same rows where they are cheaper to compute, without order.
    """
    # every pass of the percentile and the range would compute the distances again
    found = stored(distances(df, model))
    ranked = found if fit_rows is None else distances(fit_rows, model)
    (limit,) = quantile_values(ranked.where(F.col("split") == fit_split), "mahalanobis_distance", [percentile])
    scored = min_max_scores(found, {"mahalanobis_distance": "mahalanobis_score"}, ranked)
    return scored.withColumns({
        "mahalanobis_anomaly_label": (F.col("mahalanobis_distance") >= F.lit(limit)).cast("int"),
        "mahalanobis_threshold": F.lit(limit),
        "mahalanobis_feature_count": F.lit(len(model.features)),
    })


@dataclass(frozen=True)
class SequenceModel:
    """Standardisation, mean window and principal directions."""

    features: list[str]
    scaler: Standardizer
    size: int
    mean: np.ndarray
    directions: np.ndarray


def lagged_moments(df: DataFrame, columns: Sequence[str], size: int, keys: Sequence[str] = TRAJECTORY, seq: str = SEQ, block_rows: int = BLOCK_ROWS) -> tuple[np.ndarray, np.ndarray, int]:
    """Sum of products and sum of all trailing windows of ``size`` rows, as flat vectors with the oldest row first, and their number.

    No window is stored. A block of a trajectory, with the rows it borrows from the one before, is a
    matrix; entry (i, j) of a window's product is a product of the block's rows i and j places on, so
    each pair of places is one product of two views of it. Blocks add up in their task.
    """
    p = len(columns)
    wide = size * p
    values = [f"_v{i}" for i in range(p)]

    def block(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values("_at")[values].to_numpy(dtype=float)
        n = len(x) - size + 1
        total, sums = np.zeros((wide, wide)), np.zeros(wide)
        for i in range(size if n > 0 else 0):
            sums[i * p : (i + 1) * p] = x[i : i + n].sum(axis=0)
            for j in range(i, size):
                part = x[i : i + n].T @ x[j : j + n]
                total[i * p : (i + 1) * p, j * p : (j + 1) * p] = part
                total[j * p : (j + 1) * p, i * p : (i + 1) * p] = part.T
        return pd.DataFrame([(max(n, 0), sums.tobytes(), total.tobytes())], columns=["n", "sums", "products"])

    number = F.floor((F.col(seq) - 1) / F.lit(block_rows))
    rows = df.select(*keys, F.col(seq).alias("_at"), number.alias("_block"), *[finite_or(c, 0.0).cast("double").alias(v) for c, v in zip(columns, values, strict=True)])
    # the last rows of a block are the first ones of the next
    tail = F.col("_at") > (F.col("_block") + 1) * block_rows - (size - 1)
    borrowed = rows.where(tail).withColumn("_block", F.col("_block") + 1)
    parts = rows.unionByName(borrowed).groupBy(*keys, "_block").applyInPandas(block, "n long, sums binary, products binary")

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, sums, total = 0, np.zeros(wide), np.zeros((wide, wide))
        for pdf in batches:
            n += int(pdf["n"].sum())
            for a, b in zip(pdf["sums"], pdf["products"], strict=True):
                sums, total = sums + np.frombuffer(a), total + np.frombuffer(b).reshape(wide, wide)
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": np.concatenate([i.ravel(), np.arange(wide), [-1]]), "j": np.concatenate([j.ravel(), np.full(wide, -1), [-1]]),
                            "v": np.concatenate([total.ravel(), sums, [float(n)]])})

    cells = parts.mapInPandas(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    total, sums = np.zeros((wide, wide)), np.zeros(wide)
    inner, edge = cells[cells["j"] >= 0], cells[(cells["j"] < 0) & (cells["i"] >= 0)]
    total[inner["i"], inner["j"]], sums[edge["i"]] = inner["v"], edge["v"]
    return total, sums, int(round(float(cells.loc[cells["i"] < 0, "v"].sum())))


def fit_sequence_model(
    df: DataFrame,
    features: Sequence[str],
    size: int = SEQUENCE_ROWS,
    k: int = 32,
    fit_split: str = DEV,
    **kw: object,
) -> SequenceModel:
    """Linear autoencoder of standardised trailing windows: their leading directions, from lagged products.

    Without a full window there is no direction. A direction's largest entry is positive.
    """
    dev = df.where(F.col("split") == fit_split)
    scaler = fit_standardizer(dev, features, None)
    total, sums, n = lagged_moments(scaler.transform(dev), features, size, **kw)
    width = size * len(features)
    mean = sums / max(n, 1)
    cov = total / max(n, 1) - np.outer(mean, mean)
    values, vectors = np.linalg.eigh((cov + cov.T) / 2)
    lead = vectors[:, np.argsort(-values, kind="stable")[: min(k, width)]] if n else np.zeros((width, 1))
    lead = lead * np.where(lead[np.abs(lead).argmax(axis=0), np.arange(lead.shape[1])] < 0, -1.0, 1.0)
    return SequenceModel(list(features), scaler, size, mean, lead)


def sequence_errors(df: DataFrame, model: SequenceModel, **kw: object) -> DataFrame:
    """Mean squared reconstruction error of each row's trailing window; 0 before a full one."""
    shared = df.sparkSession.sparkContext.broadcast((model.mean, model.directions))

    @F.pandas_udf("double")
    def error(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        mean, v = shared.value
        for s in batches:
            out = np.zeros(len(s))
            full = s.notna().to_numpy()
            if full.any():
                x = np.stack(s[full].to_numpy()).astype(float) - mean
                gap = x - (x @ v) @ v.T
                out[full] = np.einsum("ij,ij->i", gap, gap) / gap.shape[1]
            yield pd.Series(out)

    scaled = model.scaler.transform(df.withColumns({f"_raw_{f}": F.col(f) for f in model.features}))
    windows = sequences(scaled, model.features, model.size, keep_short=True, **kw)
    out = windows.withColumn("lstm_reconstruction_error", error("sequence")).withColumn(
        "sequence_ready", F.col("sequence").isNotNull().cast("int"))
    return out.drop("sequence", *model.features).withColumnsRenamed({f"_raw_{f}": f for f in model.features})


def sequence_scores(df: DataFrame, model: SequenceModel, percentile: float = PERCENTILE, fit_split: str = DEV, **kw: object) -> DataFrame:
    """Score and label against the fit split's percentile of full windows."""
    out = sequence_errors(df, model, **kw).persist(StorageLevel.MEMORY_AND_DISK)
    ready = F.col("sequence_ready") == 1
    (limit,) = quantile_values(out.where((F.col("split") == fit_split) & ready), "lstm_reconstruction_error", [percentile])
    return label_reconstruction(out, limit, model.size, len(model.features))


def label_reconstruction(df: DataFrame, limit: float, size: int, features: int) -> DataFrame:
    err = F.col("lstm_reconstruction_error")
    return df.withColumns({
        "lstm_autoencoder_score": F.least(err / F.lit(max(limit, 1e-12)), F.lit(1.0)),
        "lstm_autoencoder_label": ((err >= F.lit(limit)) & (F.col("sequence_ready") == 1)).cast("int"),
        "lstm_threshold": F.lit(limit),
        "lstm_sequence_length": F.lit(size),
        "lstm_feature_count": F.lit(features),
    })


def sequence_counts(df: DataFrame, size: int = SEQUENCE_ROWS, keys: Sequence[str] = TRAJECTORY) -> DataFrame:
    """Full windows per trajectory."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"))
    return n.withColumn("sequence_count", F.greatest(F.col("row_count") - (size - 1), F.lit(0)))


def sequence_totals(counts: DataFrame, every: int = 10, fit_split: str = DEV) -> DataFrame:
    """Windows of the fit split in all, for validation (every n-th) and for training."""
    one = counts.where(F.col("split") == fit_split).agg(
        F.sum("row_count").alias("dev_rows_seen"), F.sum("sequence_count").alias("total_dev_sequences"),
        F.count(F.lit(1)).alias("unit_group_count"))
    held = F.ceil(F.col("total_dev_sequences") / every).cast("long")
    return one.withColumns({
        "validation_sequences": held, "train_sequences": F.col("total_dev_sequences") - held, "validation_every": F.lit(every)})
