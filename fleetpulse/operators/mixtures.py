"""Gaussian mixtures by expectation maximisation over all rows of the fit split.

A round is one pass: tasks weigh their rows with every component and add up weights, sums and
products, one small row per task and component. A ridge on every covariance keeps components of
few rows regular. Densities are compared as logarithms, so distant rows don't underflow.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetpulse.functions.exprs import finite_or, unit_clip
from fleetpulse.operators import contexts
from fleetpulse.operators.contexts import CLUSTERS, MAX_ITERATIONS, SEED, Clusters, Mixture
from fleetpulse.settings import DEV

RIDGE, TOLERANCE = 1e-6, 1e-3


def _shaped(mixture: Mixture) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Constant of each component's log density, means, and matrices that whiten about them."""
    means = np.asarray(mixture.means, float)
    p = means.shape[1]
    roots = [np.linalg.cholesky(np.asarray(c, float)) for c in mixture.covariances]
    constants = [math.log(max(w, 1e-300)) - 0.5 * p * math.log(2 * math.pi) - float(np.log(np.diag(r)).sum()) for w, r in zip(mixture.weights, roots, strict=True)]
    return np.array(constants), means, [np.linalg.inv(r) for r in roots]


def log_parts(x: np.ndarray, shaped: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Log of weight times density by row and component, and log density of the rows."""
    constants, means, white = shaped
    parts = np.stack([c - 0.5 * (((x - m) @ w.T) ** 2).sum(axis=1) for c, m, w in zip(constants, means, white, strict=True)], 1)
    top = parts.max(axis=1)
    return parts, top + np.log(np.exp(parts - top[:, None]).sum(axis=1))


def _moments(rows: DataFrame, share, k: int, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Weights, sums and products by component, and the total log density; ``share(x, label)`` gives both per row."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, q, total = np.zeros(k), np.zeros((k, p)), np.zeros((k, p, p)), 0.0
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["x"].to_numpy()).astype(float)
            r, density = share(x, pdf["label"].to_numpy())
            n, s, total = n + r.sum(axis=0), s + r.T @ x, total + float(density.sum())
            q = q + np.stack([(x * r[:, [c]]).T @ x for c in range(k)])
        yield pd.DataFrame([(c, n[c], s[c].tobytes(), q[c].tobytes(), total if c == 0 else 0.0) for c in range(k)], columns=["c", "n", "s", "q", "l"])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        s, q = (sum(np.frombuffer(b) for b in pdf[c]).tobytes() for c in ("s", "q"))
        return pd.DataFrame([(pdf["c"].iloc[0], pdf["n"].sum(), s, q, pdf["l"].sum())], columns=["c", "n", "s", "q", "l"])

    kind = "c int, n double, s binary, q binary, l double"
    found = sorted(rows.mapInPandas(add, kind).groupBy("c").applyInPandas(whole, kind).collect())
    return (np.array([r["n"] for r in found]), np.stack([np.frombuffer(r["s"]) for r in found]),
            np.stack([np.frombuffer(r["q"]).reshape(p, p) for r in found]), sum(r["l"] for r in found))


def _maximised(n: np.ndarray, s: np.ndarray, q: np.ndarray, ridge: float) -> Mixture:
    n = n + 10 * np.finfo(float).eps
    means = s / n[:, None]
    covariances = q / n[:, None, None] - means[:, :, None] * means[:, None, :]
    return Mixture((n / n.sum()).tolist(), means.tolist(), [((c + c.T) / 2 + ridge * np.eye(len(c))).tolist() for c in covariances])


def fit_mixture(
    df: DataFrame,
    features: Sequence[str],
    k: int = CLUSTERS,
    max_iter: int = MAX_ITERATIONS,
    seed: int = SEED,
    fit_split: str = DEV,
    ridge: float = RIDGE,
    tolerance: float = TOLERANCE,
) -> tuple[Mixture, list[float]]:
    """The mixture, started from k-means, and the mean log density of the fit rows before each round.

    Rounds end where that grows by less than ``tolerance``.
    """
    dev = df.where(F.col("split") == fit_split)
    start = contexts.fit_kmeans(dev, features, k, 1, max_iter, seed, fit_split)
    # products about a centre near the rows lose less to rounding
    centre = np.mean(start.clusterCenters(), axis=0).astype(float)
    rows = contexts.assign_kmeans(dev, start, features).select(
        F.array(*[finite_or(f, 0.0) - F.lit(float(c)) for f, c in zip(features, centre, strict=True)]).alias("x"), F.col("kmeans_context_id").alias("label"),
    ).persist(StorageLevel.MEMORY_AND_DISK)

    def hard(x: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.eye(k)[label], np.zeros(len(x))

    def moments(share) -> tuple[Mixture, float]:
        n, s, q, total = _moments(rows, share, k, len(features))
        return _maximised(n, s, q, ridge), total / max(n.sum(), 1.0)

    try:
        mixture, _ = moments(hard)
        likelihoods: list[float] = []
        for _ in range(max_iter):
            shaped = _shaped(mixture)

            def soft(x: np.ndarray, label: np.ndarray, shaped=shaped) -> tuple[np.ndarray, np.ndarray]:
                parts, density = log_parts(x, shaped)
                return np.exp(parts - density[:, None]), density

            following, likelihood = moments(soft)
            likelihoods.append(likelihood)
            if len(likelihoods) > 1 and likelihood - likelihoods[-2] < tolerance:
                break
            mixture = following
    finally:
        rows.unpersist()
    return Mixture(mixture.weights, (np.asarray(mixture.means) + centre).tolist(), mixture.covariances), likelihoods


def assign_mixture(df: DataFrame, mixture: Mixture, features: Sequence[str]) -> DataFrame:
    """Most likely component (the smaller number of equal ones), its probability, the clipped confidence, and the log density."""
    shaped = _shaped(mixture)

    @F.pandas_udf("gmm_context_id int, context_probability double, gmm_log_likelihood double")
    def assign(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for cols in batches:
            parts, density = log_parts(np.column_stack([c.to_numpy(float) for c in cols]), shaped)
            yield pd.DataFrame({"gmm_context_id": parts.argmax(axis=1), "context_probability": np.exp(parts.max(axis=1) - density), "gmm_log_likelihood": density})

    out = df.withColumn("_m", assign(*[finite_or(f, 0.0) for f in features]))
    out = out.withColumns({c: F.col("_m")[c] for c in ("gmm_context_id", "context_probability", "gmm_log_likelihood")}).drop("_m")
    return out.withColumn("context_confidence", unit_clip("context_probability"))


def context_table(df: DataFrame, kmeans: Clusters, mixture: Mixture, features: Sequence[str]) -> DataFrame:
    """Both context ids of every row on one lineage, so no join is needed."""
    return assign_mixture(contexts.assign_kmeans(df, kmeans, features), mixture, features)
