"""Operating contexts: k-means, mixtures of known parts and drift; ``mixtures`` fits them."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetpulse.functions.exprs import finite_or
from fleetpulse.functions.linear import squared_norm
from fleetpulse.functions.quantiles import quantile_values
from fleetpulse.operators.ordering import occurrence_join
from fleetpulse.settings import DEV

CLUSTERS = 6
KMEANS_STARTS = 10
MAX_ITERATIONS = 300
SEED = 42
# A start has converged when no centre moves farther.
MOVED = 1e-4


@dataclass(frozen=True)
class Clusters:
    """Centres of k-means, one row each."""

    centres: np.ndarray

    def clusterCenters(self) -> list[np.ndarray]:  # noqa: N802  as Spark's model names it
        return list(self.centres)


def _vectors(df: DataFrame, features: Sequence[str], out: str = "_features") -> DataFrame:
    clean = df.withColumns({f"_v_{f}": finite_or(f, 0.0) for f in features})
    return VectorAssembler(inputCols=[f"_v_{f}" for f in features], outputCol=out).transform(clean).drop(*[f"_v_{f}" for f in features])


def fit_kmeans(
    df: DataFrame,
    features: Sequence[str],
    k: int = CLUSTERS,
    starts: int = KMEANS_STARTS,
    max_iter: int = MAX_ITERATIONS,
    seed: int = SEED,
    fit_split: str = DEV,
) -> Clusters:
    """Best of several seeded starts by within-cluster cost.

    Spark's k-means|| gives each start its first centres. The rounds of all starts are then the same passes: a pass
    assigns the rows to the centres of every start that has not converged.
    """
    dev = df.where(F.col("split") == fit_split)
    rows = _vectors(dev, features).select("_features").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = [np.array(KMeans(k=k, maxIter=0, seed=seed + s, featuresCol="_features").fit(rows).clusterCenters(), float) for s in range(starts)]
    finally:
        rows.unpersist()
    # distances about a point near the rows lose less to rounding
    middle = np.mean(np.concatenate(first), axis=0)
    blocks = _blocks(dev, features, middle).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        centres, costs, todo = [c - middle for c in first], [math.inf] * starts, list(range(starts))
        for _ in range(max_iter):
            moved = []
            for s, (n, sums, cost) in zip(todo, _round(blocks, [centres[s] for s in todo]), strict=True):
                # a centre without rows stays
                new = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres[s])
                if (((new - centres[s]) ** 2).sum(axis=1) > MOVED ** 2).any():
                    moved.append(s)
                centres[s], costs[s] = new, cost
            todo = moved
            if not todo:
                break
    finally:
        blocks.unpersist()
    return Clusters(centres[int(np.argmin(costs))] + middle)


def _blocks(df: DataFrame, features: Sequence[str], middle: np.ndarray) -> DataFrame:
    """The rows as matrices about ``middle``, one per Arrow batch."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [(pdf.to_numpy(dtype=float) - middle).tobytes()]})

    return df.select(*[finite_or(f, 0.0).cast("double").alias(f) for f in features]).mapInPandas(pack, "x binary")


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, the smaller number of equal ones, and the squared distance less the row's own square."""
    gaps = (centres ** 2).sum(axis=1) - 2 * (x @ centres.T)
    own = gaps.argmin(axis=1)
    return own, gaps[np.arange(len(x)), own]


def _round(blocks: DataFrame, centres: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
    """For each start the rows and sums of every centre, and the cost: one pass for all of them."""
    k, p = centres[0].shape

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found = [[np.zeros(k), np.zeros((k, p)), 0.0] for _ in centres]
        for pdf in batches:
            for b in pdf["x"]:
                x = np.frombuffer(b).reshape(-1, p)
                square = float((x * x).sum())
                for f, c in zip(found, centres, strict=True):
                    own, gap = nearest(x, c)
                    f[0] += np.bincount(own, minlength=k)
                    f[1] += np.eye(k)[own].T @ x
                    f[2] += square + float(gap.sum())
        yield pd.DataFrame([(i, n.tobytes(), s.tobytes(), cost) for i, (n, s, cost) in enumerate(found)], columns=["i", "n", "s", "cost"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        n, s = (sum(np.frombuffer(b) for b in pdf[c]).tobytes() for c in ("n", "s"))
        return pd.DataFrame([(pdf["i"].iloc[0], n, s, pdf["cost"].sum())], columns=["i", "n", "s", "cost"])

    kind = "i int, n binary, s binary, cost double"
    out = sorted(blocks.mapInPandas(add, kind).groupBy("i").applyInPandas(whole, kind).collect())
    return [(np.frombuffer(r["n"]), np.frombuffer(r["s"]).reshape(k, p), r["cost"]) for r in out]


def assign_kmeans(df: DataFrame, model: Clusters, features: Sequence[str]) -> DataFrame:
    middle = model.centres.mean(axis=0)
    centres = model.centres - middle

    @F.pandas_udf("int")
    def assign(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(nearest(np.column_stack([c.to_numpy(float) for c in cols]) - middle, centres)[0])

    return df.withColumn("kmeans_context_id", assign(*[finite_or(f, 0.0) for f in features]))


def merge_contexts(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("split", "unit_id", "cycle"), **kw: object) -> DataFrame:
    """Context ids of two separately stored tables by key and occurrence; gaps are -1 and 0."""
    out = occurrence_join(left, right, keys, **kw)
    ids = [c for c in ("kmeans_context_id", "gmm_context_id") if c in out.columns]
    weights = [c for c in ("context_probability", "context_confidence") if c in out.columns]
    return out.fillna(-1, subset=ids).fillna(0.0, subset=weights)


@dataclass(frozen=True)
class Mixture:
    """Weights, means and covariances of a Gaussian mixture."""

    weights: list[float]
    means: list[list[float]]
    covariances: list[list[list[float]]]


def mixture_by_group(df: DataFrame, features: Sequence[str], group: str, fit_split: str = DEV) -> Mixture:
    """Mixture with one component per known group: its share, mean and covariance."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    rows = df.where(F.col("split") == fit_split).groupBy(group).agg(
        F.count(F.lit(1)).alias("_n"),
        *[F.avg(f).alias(f"_m{i}") for i, f in enumerate(features)],
        *[F.covar_pop(features[i], features[j]).alias(f"_c{i}_{j}") for i, j in pairs],
    ).orderBy(group).collect()
    total = sum(r["_n"] for r in rows)
    p = range(len(features))
    return Mixture(
        [r["_n"] / total for r in rows],
        [[r[f"_m{i}"] for i in p] for r in rows],
        [[[r[f"_c{min(i, j)}_{max(i, j)}"] for j in p] for i in p] for r in rows],
    )


def log_likelihood(df: DataFrame, features: Sequence[str], mixture: Mixture, name: str = "gmm_log_likelihood") -> DataFrame:
    """Log density of each row under the mixture, stable for distant rows."""
    p = len(features)
    out = df.withColumns({f"_f{i}": finite_or(f, 0.0) for i, f in enumerate(features)})
    terms: list[Column] = []
    for c, (w, m, cov) in enumerate(zip(mixture.weights, mixture.means, mixture.covariances)):
        chol = np.linalg.cholesky(np.asarray(cov, dtype=float))
        white = np.linalg.inv(chol)
        constant = math.log(max(w, 1e-300)) - 0.5 * p * math.log(2 * math.pi) - float(np.log(np.diag(chol)).sum())
        out = squared_norm(out, [f"_f{i}" for i in range(p)], m, white, f"_d{c}")
        terms.append(F.lit(constant) - 0.5 * F.col(f"_d{c}"))
    top = F.greatest(*terms) if len(terms) > 1 else terms[0]
    out = out.withColumn("_top", top)
    rest = [F.exp(t - F.col("_top")) for t in terms]
    out = out.withColumn(name, F.col("_top") + F.ln(sum(rest[1:], rest[0])))
    return out.drop("_top", *[f"_f{i}" for i in range(p)], *[f"_d{c}" for c in range(len(terms))])


def context_drift(df: DataFrame, value: str = "gmm_log_likelihood", fit_split: str = DEV) -> DataFrame:
    """Drift of rows less likely than the lowest percent of the fit split."""
    low, high = quantile_values(df.where(F.col("split") == fit_split), value, [0.01, 0.99])
    if low is None:
        raise ValueError("no likelihood values in the fit split")
    below = F.col(value) < F.lit(low)
    gap = F.abs(F.col(value) - F.lit(low)) / F.lit(max(abs(low), 1e-9))
    return df.withColumns({
        "context_drift_score": F.when(below, F.least(gap, F.lit(1.0))).otherwise(0.0),
        "context_drift_label": F.when(below, "Potential_Context_Drift").otherwise("No_Context_Drift"),
        "dev_likelihood_lower_threshold": F.lit(low),
        "dev_likelihood_upper_threshold": F.lit(high),
    })
