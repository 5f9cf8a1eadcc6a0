"""Percentiles, linear algebra, detectors and contexts against NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse.functions.linear import squared_norm
from fleetpulse.functions.quantiles import exact_quantiles, quantile_values
from fleetpulse.operators import contexts, detectors, evaluation, explain, mixtures, residuals, trees, twin


@pytest.mark.parametrize("n", [1, 2, 19, 501, 4_000])
@pytest.mark.parametrize("kind", ["spread", "ties"])
@pytest.mark.parametrize("bracket", [200_000, 5])
def test_exact_percentiles(spark, n, kind, bracket):
    rng = np.random.default_rng(n)
    x = rng.lognormal(0, 2, n) if kind == "spread" else rng.integers(0, 4, n).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"g": np.arange(n) % 2, "v": x}))
    out = exact_quantiles(df, "v", [0.0, 0.1001, 0.5, 0.9, 0.99, 1.0], by=["g"], accuracy=100 if bracket == 5 else 10_000, bracket_rows=bracket)
    for r in out.collect():
        assert abs(r["quantile"] - np.percentile(x[r["g"]::2], r["p"] * 100)) < 1e-9


def test_percentiles_skip_non_finite_and_empty(spark):
    df = spark.createDataFrame([(1.0,), (3.0,), (float("nan"),), (float("inf"),), (None,)], "v double")
    assert quantile_values(df, "v", [0.5]) == [2.0]
    assert quantile_values(df.where("v < 0"), "v", [0.5]) == [None]


def test_both_forms_of_the_squared_norm(spark):
    rng = np.random.default_rng(1)
    p = 20
    x, m, mu = rng.normal(size=(30, p)), rng.normal(size=(p, p)), rng.normal(size=p)
    names = [f"c{i}" for i in range(p)]
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(i=range(30)))
    wide = squared_norm(df, names, mu, m, "d").orderBy("i").toPandas()["d"]
    assert np.allclose(wide, (((x - mu) @ m.T) ** 2).sum(axis=1))
    narrow = squared_norm(df, names[:4], mu[:4], m[:4, :4], "d").orderBy("i").toPandas()["d"]
    assert np.allclose(narrow, (((x[:, :4] - mu[:4]) @ m[:4, :4].T) ** 2).sum(axis=1))


@pytest.fixture(scope="module")
def planted(spark):
    """Correlated residual features with fifteen far rows in the test split."""
    rng = np.random.default_rng(3)
    n, p = 3_000, 5
    x = rng.normal(size=(n, p)) @ rng.normal(size=(p, p))
    odd = np.arange(n) >= n - 15
    x[odd] += 25
    pdf = pd.DataFrame(x, columns=[f"residual_Xs_{i}" for i in range(p)])
    pdf["split"], pdf["unit_id"], pdf["seq"], pdf["odd"] = np.where(np.arange(n) < 2_500, "dev", "test"), 1, np.arange(1, n + 1), odd
    return spark.createDataFrame(pdf).cache(), pdf


def test_isolation_forest_finds_planted_rows(planted):
    df, _ = planted
    names = [f"residual_Xs_{i}" for i in range(5)]
    model = detectors.fit_isolation_forest(df, names, trees=60)
    out = detectors.isolation_scores(df, model).toPandas()
    assert out["iforest_anomaly_score"].between(0, 1).all()
    assert out.nlargest(15, "iforest_raw_score")["odd"].all()
    again = detectors.isolation_scores(df.repartition(5), detectors.fit_isolation_forest(df.repartition(3), names, trees=60)).toPandas()
    assert np.allclose(out.sort_values("seq")["iforest_raw_score"].to_numpy(), again.sort_values("seq")["iforest_raw_score"].to_numpy())


def test_sample_sizes_of_trees():
    assert detectors.rows_per_tree(None, 900) == 900
    assert detectors.rows_per_tree(256, 900) == 256
    assert detectors.rows_per_tree(2000, 900) == 900
    with pytest.raises(ValueError):
        detectors.rows_per_tree(0, 900)


def test_trees_use_the_rows_that_are_asked_for(planted):
    df, _ = planted
    names = [f"residual_Xs_{i}" for i in range(5)]
    model = detectors.fit_isolation_forest(df, names, trees=3, max_samples=None)
    assert model.tree_rows == model.fit_rows > detectors.TREE_ROWS


def test_shrunk_covariance_and_distance(planted):
    df, pdf = planted
    names = [f"residual_Xs_{i}" for i in range(5)]
    model = detectors.fit_distance(df, names)
    dev = pdf[pdf["split"] == "dev"][names].to_numpy()
    z = (dev - dev.mean(0)) / dev.std(0)
    c = z - z.mean(0)
    n, p = c.shape
    s = c.T @ c / n
    mu = np.trace(s) / p
    target = mu * np.eye(p)
    # definition: distance of the sample covariance from the target, and mean distance of single rows from it
    d2 = ((s - target) ** 2).sum() / p
    b2 = min(np.mean([((np.outer(r, r) - s) ** 2).sum() / p for r in c]) / n, d2)
    expected = b2 / d2 * target + (1 - b2 / d2) * s
    assert np.allclose(model.covariance, expected)
    prec = np.linalg.inv(expected) + 1e-6 * np.eye(p)
    all_z = (pdf[names].to_numpy() - dev.mean(0)) / dev.std(0) - z.mean(0)
    want = np.sqrt(np.einsum("ij,jk,ik->i", all_z, prec, all_z))
    out = detectors.distance_scores(df, model).orderBy("seq").toPandas()
    assert np.allclose(out["mahalanobis_distance"], want)
    assert abs(out["mahalanobis_threshold"][0] - np.percentile(want[:2_500], 99)) < 1e-9
    assert out[out["odd"]]["mahalanobis_anomaly_label"].all()


def test_sequence_model_rebuilds_windows(planted):
    df, pdf = planted
    names = ["residual_Xs_0", "residual_Xs_1"]
    model = detectors.fit_sequence_model(df, names, size=6, k=4)
    out = detectors.sequence_scores(df, model).orderBy("seq").toPandas()
    # windows do not reach from one split into the other
    full = (out["seq"] >= 6) & ~out["seq"].between(2_501, 2_505)
    assert (out["sequence_ready"] == full).all() and (out["lstm_reconstruction_error"][~full] == 0).all()
    z = (pdf[names] - pdf[names][:2_500].mean()) / pdf[names][:2_500].std(ddof=0)
    windows = np.stack([z.to_numpy()[i - 5:i + 1].ravel() for i in range(5, len(z))])
    dev = windows[:2_495]
    mean = dev.mean(0)
    v = np.linalg.svd(dev - mean, full_matrices=False)[2][:4].T
    gap = (windows - mean) - (windows - mean) @ v @ v.T
    assert np.allclose(out["lstm_reconstruction_error"][full], (gap ** 2).mean(1)[full[5:]], atol=1e-8)
    assert out[out["seq"] > 2_990]["lstm_autoencoder_label"].all()


def test_contexts_recover_planted_clusters(spark):
    rng = np.random.default_rng(5)
    centres = np.array([[0, 0], [20, 0], [0, 20]])
    own = rng.integers(0, 3, 600)
    x = centres[own] + rng.normal(size=(600, 2))
    pdf = pd.DataFrame({"split": np.where(np.arange(600) % 4 == 0, "test", "dev"), "seq": range(600), "W_a": x[:, 0], "W_b": x[:, 1], "own": own})
    df = spark.createDataFrame(pdf)
    names = ["W_a", "W_b"]
    km, gm = contexts.fit_kmeans(df, names, k=3, starts=2), mixtures.fit_mixture(df, names, k=3, max_iter=50)
    mix, _ = gm
    out = mixtures.context_table(df, km, mix, names)
    got = out.toPandas()
    assert got.groupby("own")["kmeans_context_id"].nunique().max() == 1 and got["kmeans_context_id"].nunique() == 3
    assert got["context_confidence"].between(0, 1).all()
    ll = contexts.log_likelihood(df, names, mix).orderBy("seq").toPandas()["gmm_log_likelihood"]
    dens = sum(
        w * np.exp(-0.5 * np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)) / (2 * np.pi * np.sqrt(np.linalg.det(c)))
        for w, m, c in zip(mix.weights, np.array(mix.means), np.array(mix.covariances)))
    assert np.allclose(ll, np.log(dens))
    q = evaluation.cluster_quality(out, names, "kmeans_context_id").collect()
    assert all(r["silhouette"] > 0.9 and r["davies_bouldin"] < 0.3 for r in q)


def test_silhouette_by_pairs(spark):
    rng = np.random.default_rng(8)
    x, lab = rng.normal(size=(40, 3)), rng.integers(0, 3, 40)
    lab[0] = 9  # a cluster of one row
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abc")).assign(split="dev", k=lab))
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    want = []
    for i in range(40):
        same = (lab == lab[i]).sum()
        if same == 1:
            want.append(0.0)
            continue
        a = d[i, lab == lab[i]].sum() / (same - 1)
        b = min(d[i, lab == c].mean() for c in set(lab) - {lab[i]})
        want.append((b - a) / max(a, b))
    got = evaluation.cluster_quality(df, list("abc"), "k").first()
    assert abs(got["silhouette"] - np.mean(want)) < 1e-9


@pytest.fixture(scope="module")
def line_rows(spark):
    rng = np.random.default_rng(11)
    n = 800
    w = rng.uniform(-1, 1, size=(n, 3))
    pdf = pd.DataFrame(w, columns=["W_a", "W_b", "W_c"])
    pdf["Xs_T48"] = 3 * w[:, 0] + w[:, 1] * w[:, 0]
    pdf["split"], pdf["unit_id"], pdf["seq"] = np.where(np.arange(n) % 4 == 0, "test", "dev"), 1, np.arange(n)
    return spark.createDataFrame(pdf).cache()


def test_members_learn_and_compare(line_rows):
    features, targets = ["W_a", "W_b", "W_c"], ["Xs_T48"]
    prefixes = {m: f"{m}_predicted_" for m in ("rf", "xgb", "lin")}
    df = twin.fit_twin(line_rows, prefixes["lin"], twin.polynomial, features, targets).predict(line_rows)
    df = trees.fit_forest(line_rows, features, targets, trees.ForestSettings(trees=10, depth=8)).predict(df, prefixes["rf"])
    df = trees.fit_boosted(line_rows, features, targets, trees.BoostSettings(rounds=20, step=0.3)).predict(df, prefixes["xgb"])
    table = {r["model"]: r for r in twin.compare_models(df, targets, prefixes).where("split = 'test' and sensor = 'Xs_T48'").collect()}
    assert table["lin"]["r2"] > 0.999 and table["rf"]["r2"] > 0.8 and table["xgb"]["r2"] > 0.8
    weights = {r["model"]: r["weight"] for r in twin.blend_weights(df, targets, prefixes).collect()}
    assert abs(sum(weights.values()) - 1) < 1e-12 and max(weights, key=weights.get) == "lin"


def test_attribution_finds_the_used_inputs(line_rows):
    model = twin.fit_twin(line_rows, "p_", twin.polynomial, ["W_a", "W_b", "W_c"], ["Xs_T48"])
    sample = explain.explanation_sample(line_rows, 60)
    out = explain.permutation_attribution(
        lambda d: model.predict(d).withColumnRenamed("p_Xs_T48", "prediction"), sample, model.features, "poly")
    got = {r["feature"]: r["mean_abs_shap"] for r in out.collect()}
    assert got["W_a"] > got["W_b"] > got["W_c"] and got["W_c"] < 1e-6
    assert explain.mean_importance(out).first()["feature"] == "W_a"


def test_validation_reports_a_damaged_value(spark, trajectories):
    sensors = ["Xs_T48", "Xs_P2"]
    source = trajectories.withColumns({f"ensemble_predicted_{s}": F.lit(0.25) for s in sensors})
    good = residuals.residual_features(residuals.residuals(source, sensors), sensors)
    assert {r["status"] for r in residuals.validate_residuals(good, source, sensors).collect()} == {"PASSED", "INFO"}
    bad = good.withColumn("residual_Xs_P2", F.when(F.col("seq") == 5, F.col("residual_Xs_P2") + 1).otherwise(F.col("residual_Xs_P2")))
    failed = {r["check_name"] for r in residuals.validate_residuals(bad, source, sensors).where("status = 'FAILED'").collect()}
    assert {"residual_formula", "abs_residual_formula", "resfeat_trend"} <= failed and "actual_xs_copy" not in failed


def test_starts_of_kmeans_share_their_passes(spark):
    """The centres are those of Spark's k-means run start by start; all starts together take as many passes as the longest."""
    from pyspark.ml.clustering import KMeans

    rng = np.random.default_rng(3)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(400, 3)) + 50, columns=["a", "b", "c"]).assign(split="dev")).repartition(3).cache()
    rows = contexts._vectors(df, ["a", "b", "c"]).cache()
    found = [KMeans(k=4, maxIter=300, seed=42 + s, featuresCol="_features").fit(rows) for s in range(4)]
    best = min(found, key=lambda m: m.summary.trainingCost)
    passes = []
    plain, contexts._round = contexts._round, lambda blocks, centres: passes.append(len(centres)) or plain(blocks, centres)
    try:
        got = contexts.fit_kmeans(df, ["a", "b", "c"], k=4, starts=4)
    finally:
        contexts._round = plain
    assert np.allclose(got.clusterCenters(), best.clusterCenters())
    assert len(passes) == max(m.summary.numIter for m in found) and sum(passes) == sum(m.summary.numIter for m in found)


def test_distances_are_computed_once_for_percentile_and_range(spark):
    names = [f"x{i}" for i in range(18)]
    rng = np.random.default_rng(4)
    df = spark.createDataFrame(pd.DataFrame(rng.normal(size=(200, 18)), columns=names).assign(split="dev", unit_id=1, seq=range(200)))
    out = detectors.distance_scores(df, detectors.fit_distance(df, names))
    assert "EvalPython" not in out._jdf.queryExecution().executedPlan().toString()
    assert out.where("mahalanobis_anomaly_label = 1").count() == 2
