"""Tree members, their attribution, isolation trees on any number of rows, mixtures and lagged products against brute force."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleetpulse.operators import detectors, mixtures, tree_attribution, trees, twin

FEATURES, TARGETS = ["W_a", "W_b", "W_c"], ["Xs_T48", "Xs_P2"]
SMALL_FOREST = trees.ForestSettings(trees=6, depth=6)


@pytest.fixture(scope="module")
def lines(spark):
    """Two sensors with a product of inputs, one constant and one missing input value, and repeated rows."""
    rng = np.random.default_rng(5)
    n = 1_500
    w = np.round(rng.uniform(-1, 1, size=(n, 3)), 2)
    pdf = pd.DataFrame(w, columns=FEATURES)
    pdf["Xs_T48"] = 3 * w[:, 0] * w[:, 1] + np.where(w[:, 2] > 0.3, 1.0, 0.0)
    pdf["Xs_P2"] = np.where((w[:, 0] > 0) & (w[:, 1] > 0), 4.0, w[:, 2])
    pdf.loc[7, "W_a"] = np.nan
    pdf.loc[9, "W_b"] = np.inf
    pdf["split"], pdf["unit_id"], pdf["seq"] = np.where(np.arange(n) % 4 == 0, "test", "dev"), 1, np.arange(1, n + 1)
    pdf = pd.concat([pdf, pdf.iloc[[3, 3]].assign(seq=[n + 1, n + 2])], ignore_index=True)
    return spark.createDataFrame(pdf).repartition(5).cache()


def test_draws_are_poisson_and_repeatable():
    keys = np.arange(200_000, dtype=np.int64)
    got = trees.draws(keys, 3, 42)
    assert abs(got.mean() - 1) < 0.02 and abs(got.var() - 1) < 0.03 and abs((got == 0).mean() - math.exp(-1)) < 0.01
    assert (got == trees.draws(keys, 3, 42)).all() and (got != trees.draws(keys, 4, 42)).any()


def brute_split(x, y, w, min_leaf):
    """Gain of the best split by trying every feature and bin."""
    def left_out(m):
        return (w[m] @ ((y[m] - (w[m] @ y[m]) / w[m].sum()) ** 2)).sum() if w[m].sum() else 0.0

    whole, best = left_out(np.ones(len(x), bool)), 0.0
    for f in range(x.shape[1]):
        for b in range(int(x[:, f].max())):
            m = x[:, f] <= b
            if w[m].sum() >= min_leaf and w[~m].sum() >= min_leaf:
                best = max(best, whole - left_out(m) - left_out(~m))
    return best


def test_splits_gain_over_all_targets():
    rng = np.random.default_rng(0)
    for _ in range(20):
        n = int(rng.integers(8, 60))
        x, y = rng.integers(0, 6, (n, 3)).astype(np.uint8), rng.normal(size=(n, 2))
        w, slot = rng.integers(1, 4, n).astype(float), rng.integers(0, 3, n)
        feature, cut, gain, weight, sums = trees.best_splits(x, y, w, slot, 3, 2)
        for s in range(3):
            m = slot == s
            want = brute_split(x[m], y[m], w[m], 2) if m.any() else 0.0
            assert abs(gain[s] - want) < 1e-9 and (feature[s] >= 0) == (want > 1e-9)
            assert abs(weight[s] - w[m].sum()) < 1e-9 and np.allclose(sums[s], (w[:, None] * y)[m].sum(axis=0))


def test_forest_is_the_same_in_one_task_and_over_many(lines, monkeypatch):
    want = trees.fit_forest(lines, FEATURES, TARGETS, SMALL_FOREST)
    monkeypatch.setattr(trees, "NODE_ROWS", 200)
    got = trees.fit_forest(lines.repartition(3), FEATURES, TARGETS, SMALL_FOREST)
    a, b = (m.nodes.toPandas().sort_values(["tree", "node"]).reset_index(drop=True) for m in (want, got))
    assert a[["tree", "node", "feature", "cut", "left_id", "right_id"]].equals(b[["tree", "node", "feature", "cut", "left_id", "right_id"]])
    assert np.allclose(np.stack(a["value"]), np.stack(b["value"])) and np.allclose(a["cover"], b["cover"])
    # every tree draws as many rows as its hashes say, and a split shares them out
    inner = a[a["feature"] >= 0].merge(a, left_on=["tree", "left_id"], right_on=["tree", "node"], suffixes=("", "_l")).merge(
        a, left_on=["tree", "right_id"], right_on=["tree", "node"], suffixes=("", "_r"))
    assert np.allclose(inner["cover"], inner["cover_l"] + inner["cover_r"])
    assert (a["cover"] >= 2).all() and a["node"].map(lambda v: int(v).bit_length() - 1).max() <= 6
    assert [c for c in got.importances("m").toPandas()["importance"]] == pytest.approx([c for c in want.importances("m").toPandas()["importance"]])


def sql_scores(spark, model, lines):
    """Predictions by joining rows level by level with the node table."""
    rows = lines.select("seq", *[F.when(F.abs(F.col(f)) < float("inf"), F.col(f)).otherwise(0.0).alias(f) for f in FEATURES])
    model.nodes.createOrReplaceTempView("nodes")
    rows.createOrReplaceTempView("fit_rows")
    spark.sql("SELECT tree, output, min(node) AS node FROM nodes GROUP BY tree, output").crossJoin(rows).createOrReplaceTempView("at0")
    x = "CASE n.feature WHEN 0 THEN W_a WHEN 1 THEN W_b ELSE W_c END"
    parts = []
    for k in range(40):
        parts.append(spark.sql(f"SELECT a.seq, a.output, n.value FROM at{k} a JOIN nodes n USING (tree, output, node) WHERE n.feature < 0"))
        step = spark.sql(f"SELECT a.tree, a.output, CASE WHEN {x} <= n.cut THEN n.left_id ELSE n.right_id END AS node, seq, W_a, W_b, W_c "
                         f"FROM at{k} a JOIN nodes n USING (tree, output, node) WHERE n.feature >= 0").cache()
        if step.isEmpty():
            break
        step.createOrReplaceTempView(f"at{k + 1}")
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    value = F.when(F.col("output") < 0, F.col("value")[F.col("t")]).when(F.col("output") == F.col("t"), F.col("value")[0])
    long = every.withColumn("t", F.explode(F.array(*map(F.lit, range(len(model.targets)))))).withColumn("v", value)
    got = long.groupBy("seq", "t").agg(F.sum("v").alias("v")).toPandas().pivot(index="seq", columns="t", values="v").sort_index()
    return model.base + model.scale * got.to_numpy()


@pytest.mark.parametrize("kind", ["forest", "depth", "leaf"])
def test_scores_equal_a_join_with_the_node_table(spark, lines, kind, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK_NODES", 60)  # several blocks
    if kind == "forest":
        model = trees.fit_forest(lines, FEATURES, TARGETS, trees.ForestSettings(trees=4, depth=5))
    else:
        s = trees.BoostSettings(rounds=5, depth=3, rows=0.9) if kind == "depth" else trees.BoostSettings(rounds=5, depth=None, leaves=9, min_leaf=10, l2=0.0)
        model = trees.fit_boosted(lines, FEATURES, TARGETS, s)
    got = model.predict(lines, "p_").orderBy("seq").toPandas()
    assert len(model.blocks()) > 1
    want = sql_scores(spark, model, lines)
    assert np.allclose(got[["p_Xs_T48", "p_Xs_P2"]].to_numpy(), want)


def test_boosting_is_the_same_in_one_task_and_over_many(lines, monkeypatch):
    s = trees.BoostSettings(rounds=4, depth=None, leaves=7, min_leaf=10, l2=0.5, columns=0.7)
    want = trees.fit_boosted(lines, FEATURES, TARGETS, s)
    monkeypatch.setattr(trees, "FIT_ROWS", 100)
    monkeypatch.setattr(trees, "KEEP_ROUNDS", 2)
    got = trees.fit_boosted(lines.repartition(3), FEATURES, TARGETS, s)
    a, b = (m.nodes.toPandas().sort_values(["tree", "output", "node"]).reset_index(drop=True) for m in (want, got))
    names = ["tree", "output", "node", "feature", "cut", "left_id", "right_id", "cover"]
    assert a[names].equals(b[names]) and np.allclose(np.stack(a["value"]), np.stack(b["value"]))


def test_leaf_wise_growth_takes_the_largest_gain_first():
    rng = np.random.default_rng(2)
    x = rng.integers(0, 30, (400, 2)).astype(np.uint8)
    y = np.where(x[:, 0] > 14, 10.0, 0.0) + np.where((x[:, 0] > 14) & (x[:, 1] > 9), 5.0, 0.0) + np.where(x[:, 0] <= 5, 0.5, 0.0)
    s = trees.BoostSettings(rounds=1, leaves=4, depth=None, step=1.0, rows=1.1, columns=1.0, min_leaf=1, l2=0.0)
    (tree,) = trees.boost_rows(np.arange(400), x, y, float(y.mean()), 0, s, 1)
    assert [(n[1], n[2]) for n in tree if n[1] >= 0] == [(0, 14), (0, 5), (1, 9)]
    assert np.allclose(trees._leaf_values(x, tree) + y.mean(), y)


def test_interactions_need_leaves(lines):
    """Leaf-wise growth fits planted corners of three inputs better than shallow trees of as many rounds."""
    corner = F.when((F.col("W_a") > 0) & (F.col("W_b") > 0) & (F.col("W_c") > 0), 4.0).when((F.col("W_a") < -0.5) & (F.col("W_b") < 0) & (F.col("W_c") < 0), -4.0)
    rows = lines.withColumn("Xs_P2", F.coalesce(corner, F.lit(0.0)))
    prefixes = {"xgb": "xgb_", "lgbm": "lgbm_", "rf": "rf_", "lin": "lin_"}
    shared = {"rounds": 30, "step": 0.2, "columns": 1.0}
    df = trees.fit_boosted(rows, FEATURES, TARGETS, trees.BoostSettings(depth=2, **shared)).predict(rows, "xgb_")
    df = trees.fit_boosted(rows, FEATURES, TARGETS, trees.BoostSettings(leaves=31, depth=None, min_leaf=5, l2=0.0, **shared)).predict(df, "lgbm_")
    df = trees.fit_forest(rows, FEATURES, TARGETS, trees.ForestSettings(trees=20, depth=10)).predict(df, "rf_")
    df = twin.fit_twin(rows, "lin_", twin.polynomial, FEATURES, TARGETS).predict(df)
    table = {(r["model"], r["sensor"]): r["rmse"] for r in twin.compare_models(df, TARGETS, prefixes).where("split = 'test'").collect()}
    assert table["lgbm", "Xs_P2"] < 0.7 * table["xgb", "Xs_P2"]
    assert table["rf", "Xs_P2"] < 0.7 * table["lin", "Xs_P2"]
    weights = {r["model"]: r["weight"] for r in twin.blend_weights(df, TARGETS, prefixes).collect()}
    assert abs(sum(weights.values()) - 1) < 1e-12


def shapley_by_sets(x, tree, width, output):
    """Contributions by all sets of known inputs, walking the tree for each."""
    _, feature, cut, left, right, value, cover = tree

    def mean(node, known, row):
        if feature[node] < 0:
            return value[node][output]
        a, b = left[node], right[node]
        if feature[node] in known:
            return mean(a if row[feature[node]] <= cut[node] else b, known, row)
        return (cover[a] * mean(a, known, row) + cover[b] * mean(b, known, row)) / cover[node]

    out = np.zeros((len(x), width))
    for r, row in enumerate(x):
        for f in range(width):
            rest = [g for g in range(width) if g != f]
            for size in range(width):
                for s in itertools.combinations(rest, size):
                    weight = math.factorial(size) * math.factorial(width - 1 - size) / math.factorial(width)
                    out[r, f] += weight * (mean(0, {*s, f}, row) - mean(0, set(s), row))
    return out


def test_tree_contributions_are_shapley_values_and_add_up(lines):
    model = trees.fit_forest(lines, FEATURES, TARGETS, trees.ForestSettings(trees=2, depth=5))
    x = np.random.default_rng(1).uniform(-1, 1, (12, 3))
    for tree in model.blocks()[0]:
        got, _ = tree_attribution.tree_values(x, tree, 2)
        for t in range(2):
            assert np.allclose(got[:, :, t], shapley_by_sets(x, tree, 3, t))
    boosted = trees.fit_boosted(lines, FEATURES, TARGETS, trees.BoostSettings(rounds=12, depth=4))
    sample = lines.where("seq <= 60")
    for m in (model, boosted):
        found = tree_attribution.tree_contributions(m, sample).groupBy("seq", "target").agg(
            (F.sum("contribution") + F.max("expected")).alias("v")).toPandas().pivot(index="seq", columns="target", values="v").sort_index()
        want = m.predict(sample, "p_").toPandas().sort_values("seq")
        assert np.allclose(found[TARGETS].to_numpy(), want[[f"p_{t}" for t in TARGETS]].to_numpy())
    report = tree_attribution.tree_attribution(boosted, sample, "xgboost").toPandas()
    assert set(report["feature"]) == set(FEATURES) and (report["sample_size"] == 60).all() and (report["mean_abs_shap"] >= 0).all()


def test_isolation_trees_on_all_rows_split_large_nodes_by_aggregation(spark):
    rng = np.random.default_rng(4)
    n, p = 900, 4
    x = rng.normal(size=(n, p))
    x[:200] = x[0]  # equal rows can't be split
    x[-3:] += 9
    names = [f"residual_Xs_{i}" for i in range(p)]
    pdf = pd.DataFrame(x, columns=names).assign(split="dev", unit_id=1, seq=np.arange(1, n + 1))
    df = spark.createDataFrame(pdf)
    nodes = detectors.isolation_trees(df, names, 5, None, node_rows=150).toPandas()
    assert nodes.groupby("tree_id").size().min() > 50 and not nodes.duplicated(["tree_id", "node_id"]).any()
    # every row's way through the table ends in one leaf, and nodes have the rows that reach them
    for _, tree in nodes.groupby("tree_id"):
        by = tree.set_index("node_id")
        reached = dict.fromkeys(by.index, 0)
        for row in x:
            node = 1
            while True:
                reached[node] += 1
                r = by.loc[node]
                if r["feature"] < 0:
                    break
                node = int(r["left_id"] if row[int(r["feature"])] < r["cut"] else r["right_id"])
        assert reached == by["rows"].to_dict()
        assert min(reached.values()) > 0 and by.loc[1, "rows"] == n
    model = detectors.fit_isolation_forest(df, names, 20, None, node_rows=150)
    assert model.tree_rows == model.fit_rows == n
    got = detectors.isolation_scores(df, model).toPandas()
    assert set(got.nlargest(3, "iforest_raw_score")["seq"]) == {n - 2, n - 1, n}


def test_mixture_likelihood_never_falls_and_parts_are_found(spark):
    rng = np.random.default_rng(6)
    names = [f"W_{i}" for i in range(12)]
    centres = np.eye(3, 12) * 8
    own = rng.integers(0, 3, 500)
    x = centres[own] + rng.normal(size=(500, 12)) @ np.diag(np.linspace(0.2, 1.5, 12))
    x[:, 11] = 1.0  # flat: its covariance is the ridge alone
    df = spark.createDataFrame(pd.DataFrame(x, columns=names).assign(split=np.where(np.arange(500) % 5 == 0, "test", "dev"), own=own)).repartition(4)
    mix, steps = mixtures.fit_mixture(df, names, 3)
    assert all(b >= a - 1e-9 for a, b in zip(steps[:-1], steps[1:])) and abs(sum(mix.weights) - 1) < 1e-12
    dev = np.arange(500) % 5 != 0
    share = np.bincount(own[dev]) / dev.sum()
    assert np.allclose(sorted(mix.weights), sorted(share), atol=1e-6)
    for c in mix.covariances:
        assert abs(c[11][11] - mixtures.RIDGE) < 1e-9 and np.linalg.eigvalsh(np.asarray(c)).min() > 0
    got = mixtures.assign_mixture(df, mix, names).toPandas()
    assert (got.groupby("own")["gmm_context_id"].nunique() == 1).all() and got["context_confidence"].between(0, 1).all()
    # the density of a row by the formula
    r = got.iloc[0]
    row, total = r[names].to_numpy(float), 0.0
    for w, m, c in zip(mix.weights, mix.means, mix.covariances):
        d, c = row - np.asarray(m), np.asarray(c)
        total += w * math.exp(-0.5 * d @ np.linalg.solve(c, d)) / math.sqrt((2 * math.pi) ** 12 * np.linalg.det(c))
    assert abs(math.log(total) - r["gmm_log_likelihood"]) < 1e-6


@pytest.mark.parametrize("block_rows", [7, 65_536])
def test_lagged_products_equal_stored_windows(spark, block_rows):
    rng = np.random.default_rng(9)
    parts, windows = [], []
    for unit, n in ((1, 60), (2, 4), (3, 5), (4, 23)):
        x = rng.normal(size=(n, 2))
        parts.append(pd.DataFrame(x, columns=["a", "b"]).assign(split="dev", unit_id=unit, seq=np.arange(1, n + 1)))
        windows += [x[k : k + 5].ravel() for k in range(n - 4)]
    df, windows = spark.createDataFrame(pd.concat(parts)).repartition(3), np.array(windows)
    total, sums, n = detectors.lagged_moments(df, ["a", "b"], 5, block_rows=block_rows)
    assert n == len(windows) and np.allclose(total, windows.T @ windows) and np.allclose(sums, windows.sum(axis=0))
    model = detectors.fit_sequence_model(df, ["a", "b"], 5, 3, block_rows=block_rows)
    z = windows.copy()
    rows = pd.concat(parts)[["a", "b"]].to_numpy()
    z = (z - np.tile(rows.mean(axis=0), 5)) / np.tile(rows.std(axis=0), 5)
    values, vectors = np.linalg.eigh(np.cov(z.T, bias=True))
    for k in range(3):
        assert abs(abs(vectors[:, -1 - k] @ model.directions[:, k]) - 1) < 1e-6
    got = detectors.sequence_errors(df, model, block_rows=block_rows).toPandas().sort_values(["unit_id", "seq"])
    lead = vectors[:, -3:]
    c = z - z.mean(axis=0)
    want = ((c - c @ lead @ lead.T) ** 2).mean(axis=1)
    assert np.allclose(got[got["sequence_ready"] == 1]["lstm_reconstruction_error"], want)


@pytest.fixture(scope="module")
def coarse(lines):
    """Inputs of few values: the grid of their bins has fewer cells than there are rows."""
    return lines.withColumns({f: F.round(F.col(f) * 3) / 3 for f in FEATURES}).cache()


def same_nodes(a, b, keys):
    a, b = (m.nodes.toPandas().sort_values(keys).reset_index(drop=True) for m in (a, b))
    names = [*keys, "feature", "cut", "left_id", "right_id", "cover"]
    assert len(a) > 20 and a[names].astype(float).equals(b[names].astype(float)) and np.allclose(np.stack(a["value"]), np.stack(b["value"])) and np.allclose(a["gain"], b["gain"])


@pytest.mark.parametrize("kind", ["forest", "boosted"])
def test_trees_of_cells_are_those_of_rows(coarse, kind, monkeypatch):
    s = trees.BoostSettings(rounds=4, depth=None, leaves=7, min_leaf=10, l2=0.5, columns=0.7)

    def fit(df):
        return trees.fit_forest(df, FEATURES, TARGETS, SMALL_FOREST) if kind == "forest" else trees.fit_boosted(df, FEATURES, TARGETS, s)

    for slow in ("binned", "_boost_spread", "_split_nodes"):  # rows are not worked on one by one
        monkeypatch.setattr(trees, slow, None)
    monkeypatch.setattr(trees, "HELD", 1 << 15)  # several tasks share out the trees
    monkeypatch.setattr(trees, "NODE_ROWS", 200)
    monkeypatch.setattr(trees, "FIT_ROWS", 100)
    cells = fit(coarse)
    got = cells.predict(coarse, "p_").orderBy("seq").toPandas()
    monkeypatch.undo()
    monkeypatch.setattr(trees, "CELLS", 0)
    rows = fit(coarse)
    same_nodes(cells, rows, ["tree", "output", "node"])
    want = rows.predict(coarse, "p_").orderBy("seq").toPandas()
    assert np.allclose(got[["p_Xs_T48", "p_Xs_P2"]], want[["p_Xs_T48", "p_Xs_P2"]])
