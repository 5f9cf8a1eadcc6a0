"""Exact Shapley values of tree models, given the share of training rows on each path.

A leaf counts for a row only through the features that its path tests: with a feature known, the
row meets all of the path's tests of it or not; unknown, it passes them by the share of training
rows that did. The weights of all sets of known features follow from one polynomial per leaf and
row, whose factors are the features: dividing one out gives the sets without it. All leaves of a
tree with equally many features are worked on together, and trees are tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from fleetpulse.functions.exprs import finite_or
from fleetpulse.operators.trees import TreeModel, _compiled, whole_trees
from fleetpulse.settings import SEQ, TRAJECTORY

#: Leaves that are worked on at once.
LEAVES = 128


def leaf_paths(tree: tuple, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every leaf: number, lowest (exclusive) and highest value by feature, share of rows by feature, whether it is tested."""
    _, feature, cut, left, right, _, cover = tree
    n = len(feature)
    low, high = np.full((n, width), -np.inf), np.full((n, width), np.inf)
    share, tested = np.ones((n, width)), np.zeros((n, width), bool)
    level = np.array([0])
    while len(level := level[feature[level] >= 0]):
        f = feature[level]
        for child, bound in ((left[level], high), (right[level], low)):
            for table in (low, high, share, tested):
                table[child] = table[level]
            tested[child, f] = True
            share[child, f] *= cover[child] / cover[level]
            bound[child, f] = np.minimum(bound[child, f], cut[level]) if bound is high else np.maximum(bound[child, f], cut[level])
        level = np.concatenate([left[level], right[level]])
    leaves = np.flatnonzero(feature < 0)
    return leaves, low[leaves], high[leaves], share[leaves], tested[leaves]


def set_weights(d: int) -> np.ndarray:
    """The weight of a set of each size among ``d`` features, without one of them."""
    return np.array([math.factorial(k) * math.factorial(d - 1 - k) / math.factorial(d) for k in range(d)])


def tree_values(x: np.ndarray, tree: tuple, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    """``rows x features x outputs`` contributions of one tree, and its mean by output."""
    width = x.shape[1]
    leaves, low, high, share, tested = leaf_paths(tree, width)
    output, value = tree[0], tree[5][leaves]
    if output >= 0:
        value = np.zeros((len(leaves), outputs))
        value[:, output] = tree[5][leaves, 0]
    out = np.zeros((len(x), width, outputs))
    depth = tested.sum(axis=1)
    for d in np.unique(depth[depth > 0]):
        weights = set_weights(int(d))
        own = np.flatnonzero(depth == d)
        for at in range(0, len(own), LEAVES):
            part = own[at : at + LEAVES]
            used = np.nonzero(tested[part])[1].reshape(len(part), d)
            row = np.arange(len(part))[:, None]
            z = share[part][row, used]
            met = (x[:, used] > low[part][row, used]) & (x[:, used] <= high[part][row, used])  # rows x leaves x d
            sets = np.zeros((len(x), len(part), d + 1))
            sets[..., 0] = 1.0
            for k in range(d):
                grown = sets * z[None, :, k, None]
                grown[..., 1:] += sets[..., :-1] * met[..., k, None]
                sets = grown
            for k in range(d):
                without = np.zeros((len(x), len(part), d))
                without[..., d - 1] = sets[..., d]
                for j in range(d - 1, 0, -1):
                    without[..., j - 1] = sets[..., j] - z[None, :, k] * without[..., j]
                missed = sets[..., :d] / z[None, :, k, None]
                total = (np.where(met[..., k, None], without, missed) * weights).sum(axis=2) * (met[..., k] - z[None, :, k])
                for f in np.unique(used[:, k]):
                    hit = np.flatnonzero(used[:, k] == f)
                    out[:, f] += total[:, hit] @ value[part[hit]]
    return out, (share.prod(axis=1)[:, None] * value).sum(axis=0)


def tree_contributions(model: TreeModel, sample: DataFrame, keys: Sequence[str] = (*TRAJECTORY, SEQ)) -> DataFrame:
    """``keys, target, feature, contribution, expected`` of every row of a bounded sample.

    The contributions of a row and target add up to its prediction minus ``expected``.
    """
    rows = sample.select(*keys, *[finite_or(f, 0.0).alias(f"_f{i}") for i, f in enumerate(model.features)]).toPandas()
    x = rows[[f"_f{i}" for i in range(len(model.features))]].to_numpy(float)
    spark = sample.sparkSession
    shared = spark.sparkContext.broadcast(x)
    outputs, width = len(model.targets), len(model.features)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, mean = np.zeros((len(x), width, outputs)), np.zeros(outputs)
        for pdf in whole_trees(batches):
            for _, g in pdf.groupby(["tree", "output"]):
                values, base = tree_values(shared.value, _compiled(g.sort_values("node")), outputs)
                total, mean = total + values, mean + base
        r, f, t = (i.ravel() for i in np.indices(total.shape))
        yield pd.DataFrame({"r": r, "f": f, "t": t, "v": total.ravel(), "m": mean[t]})

    parts = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    dealt = model.nodes.repartition(parts, "tree", "output").sortWithinPartitions("tree", "output", "node")
    added = dealt.mapInPandas(run, "r int, f int, t int, v double, m double").groupBy("r", "f", "t").agg(
        (F.sum("v") * F.lit(model.scale)).alias("contribution"), (F.sum("m") * F.lit(model.scale)).alias("m"))
    names, targets, base = (F.array(*map(F.lit, v)) for v in (model.features, model.targets, [float(b) for b in model.base]))
    numbered = spark.createDataFrame(rows[list(keys)].assign(r=np.arange(len(rows))), StructType([*sample.select(*keys).schema, StructField("r", IntegerType())]))
    return added.join(F.broadcast(numbered), "r").select(
        *keys, targets[F.col("t")].alias("target"), names[F.col("f")].alias("feature"), "contribution", (F.col("m") + base[F.col("t")]).alias("expected"))


def tree_attribution(model: TreeModel, sample: DataFrame, name: str, keys: Sequence[str] = (*TRAJECTORY, SEQ)) -> DataFrame:
    """Mean absolute contribution of each feature over rows and targets."""
    found = tree_contributions(model, sample, keys)
    sizes = found.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_shap"), F.count_distinct(*keys).alias("sample_size"))
    return sizes.select(
        F.lit(name).alias("model"), "feature", "mean_abs_shap", F.lit(len(model.targets)).alias("targets_explained"),
        F.lit(len(model.targets)).alias("available_target_count"), "sample_size", F.lit("tree_shap").alias("explanation_type"))
