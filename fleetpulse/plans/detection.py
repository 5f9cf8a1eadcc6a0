"""Queries E-H: contexts, twin, residuals, detectors and fusion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions import channels
from fleetpulse.operators import anomaly, contexts, detectors, mixtures, prepare, residuals, trees, twin
from fleetpulse.operators.ordering import uniform_sample
from fleetpulse.plans import inputs
from fleetpulse.plans.registry import query
from fleetpulse.plans.sql import DIRECTIONS, W, W5, alert, each, sequence_errors
from fleetpulse.settings import DEV
from fleetpulse.sources import tables
from fleetpulse.streaming.storage import stored

S4 = inputs.SENSORS
MEMBERS = inputs.MEMBERS
W_NAMES = [f"W_{i}" for i in range(1, tables.EMBEDDING_WIDTH + 1)]
CENTRES = [f"c{i}" for i in range(1, tables.EMBEDDING_WIDTH + 1)]
MEANS = [f"m{i}" for i in range(1, tables.EMBEDDING_WIDTH + 1)]


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    return tables.embedding_vectors(spark, sf)


@query("E1", "", "cluster size", " ".join(CENTRES))
def kmeans_centres(spark: SparkSession, sf: str) -> DataFrame:
    df = _vectors(spark, sf)
    model = contexts.fit_kmeans(df, W_NAMES)
    centres = spark.createDataFrame(
        [(i, *[float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, " + ", ".join(f"{c} double" for c in CENTRES))
    sizes = contexts.assign_kmeans(df.where(F.col("split") == DEV), model, W_NAMES).groupBy(
        F.col("kmeans_context_id").alias("cluster")).agg(F.count(F.lit(1)).alias("size"))
    return centres.join(sizes, "cluster", "left")


@query("E2", "split", "seq kmeans_context_id")
def kmeans_assignment(spark: SparkSession, sf: str) -> DataFrame:
    df = _vectors(spark, sf)
    return contexts.assign_kmeans(df, contexts.fit_kmeans(df, W_NAMES), W_NAMES)


@query("E3", "", "component", " ".join(["weight", *MEANS]))
def mixture_parts(spark: SparkSession, sf: str) -> DataFrame:
    mix, _ = mixtures.fit_mixture(_vectors(spark, sf), W_NAMES)
    return spark.createDataFrame(
        [(i, w, *m) for i, (w, m) in enumerate(zip(mix.weights, mix.means))],
        "component int, weight double, " + ", ".join(f"{m} double" for m in MEANS))


@query("E4", "split", "seq gmm_context_id", "context_probability context_confidence gmm_log_likelihood")
def mixture_assignment(spark: SparkSession, sf: str) -> DataFrame:
    df = _vectors(spark, sf)
    return mixtures.assign_mixture(df, mixtures.fit_mixture(df, W_NAMES)[0], W_NAMES)


@query("E5", "split", "unit_id cycle seq kmeans_context_id gmm_context_id", "context_probability context_confidence", tables=("li",),
       sql="""WITH n AS (SELECT *, row_number() OVER (PARTITION BY split, unit_id, cycle ORDER BY seq) AS occ FROM li),
       g AS (SELECT split, unit_id, cycle, gmm_context_id, 0.5 + Xs_Nf AS p, row_number() OVER (PARTITION BY split, unit_id, cycle ORDER BY seq) AS occ FROM li WHERE Xs_T48 > 5)
       SELECT n.split, n.unit_id, n.cycle, n.seq, n.kmeans_context_id, coalesce(g.gmm_context_id, -1) AS gmm_context_id, coalesce(p, 0.0) AS context_probability,
       coalesce(p, 0.0) AS context_confidence FROM n LEFT JOIN g USING (split, unit_id, cycle, occ)""")
def merged_contexts(spark: SparkSession, sf: str) -> DataFrame:
    li = stored(tables.lineitem_telemetry(spark, sf).select("split", "unit_id", "cycle", "seq", "kmeans_context_id", "gmm_context_id", "Xs_T48", "Xs_Nf"))
    left = li.select("split", "unit_id", "cycle", "seq", "kmeans_context_id")
    p = 0.5 + F.col("Xs_Nf")
    right = li.where("Xs_T48 > 5").select(
        "split", "unit_id", "cycle", "seq", "gmm_context_id", p.alias("context_probability"), p.alias("context_confidence"))
    return contexts.merge_contexts(left, right)


LIKELIHOOD = """SELECT split, unit_id, seq, sum(exp(part - top)) AS s, max(top) AS top FROM (
 SELECT *, max(part) OVER (PARTITION BY split, unit_id, seq) AS top FROM (
  SELECT split, unit_id, seq, ln(w) - 0.5*(2*ln(2*pi()) + ln(det) + (dy*dy*cxx - 2*dx*dy*cxy + dx*dx*cyy)/det) AS part FROM (
   SELECT li.split, li.unit_id, li.seq, Xs_T48 - mx AS dx, Xs_Ps30 - my AS dy, w, cxx, cyy, cxy, cxx*cyy - cxy*cxy AS det FROM liz li CROSS JOIN (
    SELECT gmm_context_id, count(*)/sum(count(*)) OVER () AS w, avg(Xs_T48) AS mx, avg(Xs_Ps30) AS my, covar_pop(Xs_T48, Xs_T48) AS cxx,
    covar_pop(Xs_Ps30, Xs_Ps30) AS cyy, covar_pop(Xs_T48, Xs_Ps30) AS cxy FROM liz WHERE split = 'dev' GROUP BY gmm_context_id) g)))
 GROUP BY split, unit_id, seq"""


def _likelihood(spark: SparkSession, sf: str) -> DataFrame:
    fitted = inputs.fit_lineitem(spark, sf)
    mixture = contexts.mixture_by_group(fitted.scaled(sequenced=False), ["Xs_T48", "Xs_Ps30"], "gmm_context_id")
    return contexts.log_likelihood(fitted.scaled(), ["Xs_T48", "Xs_Ps30"], mixture)


@query("E6", "split", "unit_id seq", "gmm_log_likelihood", tables=("liz",),
       sql=f"SELECT split, unit_id, seq, top + ln(s) AS gmm_log_likelihood FROM ({LIKELIHOOD})")
def row_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    return _likelihood(spark, sf)


@query("E7", "split context_drift_label", "unit_id seq", "context_drift_score dev_likelihood_lower_threshold dev_likelihood_upper_threshold", tables=("liz",),
       sql=f"""WITH ll AS (SELECT split, unit_id, seq, top + ln(s) AS v FROM ({LIKELIHOOD})),
       b AS (SELECT quantile_cont(v, 0.01) AS lo, quantile_cont(v, 0.99) AS hi FROM ll WHERE split = 'dev')
       SELECT split, unit_id, seq, CASE WHEN v < lo THEN least(1.0, abs(v - lo)/greatest(abs(lo), 1e-9)) ELSE 0.0 END AS context_drift_score,
       CASE WHEN v < lo THEN 'Potential_Context_Drift' ELSE 'No_Context_Drift' END AS context_drift_label,
       lo AS dev_likelihood_lower_threshold, hi AS dev_likelihood_upper_threshold FROM ll, b""")
def drift(spark: SparkSession, sf: str) -> DataFrame:
    return contexts.context_drift(_likelihood(spark, sf))


# ---------------------------------------------------------------- twin

TWIN_FEATURES = ["W_alt", "W_Mach", "gmm_context_id"]
ROW_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def _twin_rows(fitted: inputs.FittedLineitem, sequenced: bool = True) -> DataFrame:
    return tables.with_operating_conditions(fitted.scaled(sequenced), fitted.spark, fitted.sf)


@query("F1", "role column_name", "n", "mean", tables=("li",),
       sql="""WITH x AS (SELECT CAST(p_size AS DOUBLE) AS W_alt, p_retailprice/1000 AS W_Mach, CAST(gmm_context_id AS DOUBLE) AS gmm_context_id, Xs_T48, Xs_Ps30, Xs_Nf, Xs_Wf
       FROM li LEFT JOIN part ON l_partkey = p_partkey)
       SELECT CASE WHEN column_name LIKE 'Xs%' THEN 'target' ELSE 'feature' END AS role, column_name, count(*) AS n, avg(v) AS mean
       FROM (UNPIVOT x ON COLUMNS(*) INTO NAME column_name VALUE v) GROUP BY ALL""")
def model_columns(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.with_operating_conditions(tables.lineitem_telemetry(spark, sf, sequenced=False), spark, sf)
    df = df.withColumn("Xs_T48_trend", F.lit(0.0))
    features, targets = channels.twin_columns(df)
    named = [("feature", f) for f in features] + [("target", t) for t in targets]
    return df.agg(*[F.count(c).alias(f"{c}__n") for _, c in named], *[F.avg(c).alias(f"{c}__m") for _, c in named]).select(
        F.inline(F.array(*[F.struct(F.lit(r).alias("role"), F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("n"), F.col(f"{c}__m").alias("mean")) for r, c in named])))


@query("F2", "", "event_id", "a b", tables=("gap",),
       sql="SELECT event_id, coalesce(Xs_T48, 0.0) AS a, coalesce(Xs_P2, 0.0) AS b FROM gap")
def model_matrix(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    df = twin.features_matrix(inputs.gappy_events(spark, sf), ["Xs_T48", "Xs_P2"]).withColumn("_a", vector_to_array("_features"))
    return df.withColumns({"a": F.col("_a")[0], "b": F.col("_a")[1]})


def fit_member(fitted: inputs.FittedLineitem, name: str) -> trees.TreeModel:
    """A tree member in its full size for all sensors."""
    rows = _twin_rows(fitted, sequenced=False)
    if name == "rf":
        return trees.fit_forest(rows, TWIN_FEATURES, S4, keys=ROW_KEYS)
    return trees.fit_boosted(rows, TWIN_FEATURES, S4, trees.BoostSettings() if name == "xgb" else trees.LEAF_WISE, keys=ROW_KEYS)


def _predicted(spark: SparkSession, sf: str, name: str) -> DataFrame:
    fitted = inputs.fit_lineitem(spark, sf)
    return fit_member(fitted, name).predict(_twin_rows(fitted), MEMBERS[name])


def _outputs(prefix: str) -> str:
    return " ".join(f"{s} {prefix}{s}" for s in S4)


@query("F3", "split", "unit_id seq", _outputs("rf_predicted_"))
def forest_member(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf, "rf")


@query("F4", "split", "unit_id seq", _outputs("xgb_predicted_"))
def boosted_member(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf, "xgb")


@query("F5", "split", "unit_id seq", _outputs("lgbm_predicted_"))
def leaf_wise_member(spark: SparkSession, sf: str) -> DataFrame:
    return _predicted(spark, sf, "lgbm")


@query("F6", "split", "unit_id seq", _outputs("lin_predicted_"))
def polynomial_member(spark: SparkSession, sf: str) -> DataFrame:
    fitted = inputs.fit_lineitem(spark, sf)
    model = twin.fit_twin(_twin_rows(fitted, sequenced=False), "lin_predicted_", twin.polynomial, TWIN_FEATURES, S4)
    return model.predict(_twin_rows(fitted))


@query("F7", "split is_validation", "unit_id n", tables=("ev",),
       sql="SELECT split, unit_id, split = 'dev' AND seq % 10 = 0 AS is_validation, count(*) AS n FROM ev GROUP BY ALL")
def holdout(spark: SparkSession, sf: str) -> DataFrame:
    return twin.holdout_mask(inputs.events(spark, sf)).groupBy("split", "unit_id", "is_validation").agg(F.count(F.lit(1)).alias("n"))


ERRORS = " UNION ALL ".join(
    f"SELECT '{m}' AS model, sqrt(sum({each('power({s} - ' + p + '{s}, 2)', sep=' + ')})/(4*count(*))) AS dev_rmse FROM mem WHERE split = 'dev'" for m, p in MEMBERS.items())


@query("F8", "model", "", "dev_rmse weight", tables=("mem",),
       sql=f"SELECT model, dev_rmse, (1/greatest(dev_rmse, 1e-9))/sum(1/greatest(dev_rmse, 1e-9)) OVER () AS weight FROM ({ERRORS})")
def member_weights(spark: SparkSession, sf: str) -> DataFrame:
    return twin.blend_weights(inputs.fit_lineitem(spark, sf).members(sequenced=False), S4, MEMBERS)


@query("F9", "split", "unit_id seq", " ".join(f"ensemble_predicted_{s}" for s in S4), tables=("mem",),
       sql=f"""WITH w AS (SELECT model, (1/greatest(dev_rmse, 1e-9))/sum(1/greatest(dev_rmse, 1e-9)) OVER () AS w FROM ({ERRORS})),
       p AS (SELECT max(w) FILTER (model = 'rf') AS wr, max(w) FILTER (model = 'xgb') AS wx, max(w) FILTER (model = 'lgbm') AS wl FROM w)
       SELECT split, unit_id, seq, """ + each("wr*rf_predicted_{s} + wx*xgb_predicted_{s} + wl*lgbm_predicted_{s} AS ensemble_predicted_{s}") + " FROM mem, p")
def blended(spark: SparkSession, sf: str) -> DataFrame:
    fitted = inputs.fit_lineitem(spark, sf)
    weights = {r["model"]: r["weight"] for r in twin.blend_weights(fitted.members(sequenced=False), S4, MEMBERS).collect()}
    return twin.blend(fitted.members(), S4, MEMBERS, weights)


COMPARED = " UNION ALL ".join(
    f"""SELECT split, '{s}' AS sensor, '{m}' AS model, avg(abs({s} - {p}{s})) AS mae, sqrt(avg(power({s} - {p}{s}, 2))) AS rmse,
    CASE WHEN abs(sum({s}*{s}) - power(sum({s}), 2)/count(*)) < 1e-12 THEN 0.0 ELSE 1 - sum(power({s} - {p}{s}, 2))/(sum({s}*{s}) - power(sum({s}), 2)/count(*)) END AS r2,
    count(*) AS count FROM mem GROUP BY split""" for s in S4 for m, p in MEMBERS.items())


@query("F10", "split sensor model target_type", "count", "mae rmse r2 r2_percent", tables=("mem",),
       sql=f"""WITH c AS ({COMPARED}) SELECT *, r2*100 AS r2_percent, 'raw_X_s_only' AS target_type FROM (SELECT * FROM c UNION ALL
       SELECT split, 'ALL_RAW_XS', model, avg(mae), avg(rmse), avg(r2), sum(count) FROM c GROUP BY split, model)""")
def comparison(spark: SparkSession, sf: str) -> DataFrame:
    return twin.compare_models(inputs.fit_lineitem(spark, sf).members(sequenced=False), S4, MEMBERS)


@query("F11", "model feature", "", "importance")
def importances(spark: SparkSession, sf: str) -> DataFrame:
    fitted = inputs.fit_lineitem(spark, sf)
    names = {"rf": "random_forest", "xgb": "xgboost", "lgbm": "lightgbm"}
    parts = [fit_member(fitted, m).importances(label) for m, label in names.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


AUDIT_GAPS = " UNION ALL ".join(
    f"SELECT '{a}' AS first_name, '{b}' AS second_name, max(abs({a} - {b})) AS value, CASE WHEN bool_and(abs({a} - {b}) <= 1e-12 + 1e-5*abs({b})) THEN 1 ELSE 0 END AS flag FROM x"
    for i, a in enumerate(S4) for b in S4[i + 1:])
AUDIT_CORR = " UNION ALL ".join(f"SELECT '{t}' AS first_name, '{f}' AS second_name, abs(corr({f}, {t})) AS value FROM x" for t in S4 for f in ("W_alt", "W_Mach"))


@query("F12", "kind first_name second_name", "flag", "value", tables=("li",),
       sql=f"""WITH x AS (SELECT CAST(p_size AS DOUBLE) AS W_alt, p_retailprice/1000 AS W_Mach, Xs_T48, Xs_Ps30, Xs_Nf, Xs_Wf FROM li LEFT JOIN part ON l_partkey = p_partkey)
       SELECT 'pair' AS kind, * FROM ({AUDIT_GAPS}) UNION ALL
       SELECT 'corr', first_name, second_name, value, row_number() OVER (PARTITION BY first_name ORDER BY value DESC, second_name) FROM ({AUDIT_CORR})""")
def channel_audit(spark: SparkSession, sf: str) -> DataFrame:
    df = tables.with_operating_conditions(tables.lineitem_telemetry(spark, sf, sequenced=False), spark, sf)
    pairs = twin.duplicate_channels(df, S4).select(
        F.lit("pair").alias("kind"), F.col("first_sensor").alias("first_name"), F.col("second_sensor").alias("second_name"),
        F.col("max_gap").alias("value"), F.col("duplicate").cast("long").alias("flag"))
    corr = twin.top_correlations(df, ["W_alt", "W_Mach"], S4).select(
        F.lit("corr").alias("kind"), F.col("target").alias("first_name"), F.col("feature").alias("second_name"),
        F.col("abs_corr").alias("value"), F.col("rank").cast("long").alias("flag"))
    return pairs.unionByName(corr)


# ---------------------------------------------------------------- residuals

@query("G1", "split", "unit_id seq gmm_context_id", " ".join(f"residual_{s} abs_residual_{s}" for s in S4), sql="SELECT * FROM res", tables=("res",))
def residual_values(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.fit_lineitem(spark, sf).residuals()


FEATURE_SQL = ", ".join(
    f"""avg(residual_{s}) OVER {W5} AS resfeat_residual_{s}_rolling_mean_5, coalesce(stddev_samp(residual_{s}) OVER {W5}, 0.0) AS resfeat_residual_{s}_rolling_std_5,
    coalesce(residual_{s} - lag(residual_{s}) OVER ({W}), 0.0) AS resfeat_residual_{s}_trend, avg(abs_residual_{s}) OVER {W5} AS resfeat_abs_residual_{s}_rolling_mean_5""" for s in S4)
FEATURES = [n for s in S4 for n in residuals.residual_feature_names(s)]


def _features(spark: SparkSession, sf: str) -> DataFrame:
    return residuals.residual_features(inputs.fit_lineitem(spark, sf).residuals(), S4)


@query("G2", "split", "unit_id seq", " ".join(FEATURES), sql=f"SELECT split, unit_id, seq, {FEATURE_SQL} FROM res", tables=("res",))
def residual_features(spark: SparkSession, sf: str) -> DataFrame:
    return _features(spark, sf)


SQUARES = each("residual_{s}*residual_{s}", sep=" + ")


@query("G3", "check_name status", "values_checked", "max_error tolerance mean_abs_residual", tables=("res",),
       sql=f"""SELECT unnest(['actual_xs_copy','ensemble_prediction_copy','residual_formula','abs_residual_formula','resfeat_rolling_mean','resfeat_rolling_std','resfeat_trend','resfeat_abs_rolling_mean']) AS check_name,
       'PASSED' AS status, 0.0 AS max_error, 0.00001 AS tolerance, NULL AS mean_abs_residual, (SELECT 4*count(*) FROM res) AS values_checked
       UNION ALL SELECT 'finite_numeric_values', 'PASSED', CAST(count(*) FILTER (total_abs_residual IS NULL) AS DOUBLE), 0.0, NULL, 4*count(*) FROM res
       UNION ALL SELECT split || '_residual_magnitude_summary', 'INFO', sqrt(sum({SQUARES})/(4*count(*))), 0.0, sum(total_abs_residual)/(4*count(*)), 4*count(*) FROM res GROUP BY split""")
def residual_checks(spark: SparkSession, sf: str) -> DataFrame:
    fitted = inputs.fit_lineitem(spark, sf)
    source = twin.blend(fitted.members(), S4, MEMBERS, inputs.EQUAL)
    kept = [n for s in S4 for n in (s, f"ensemble_predicted_{s}", f"residual_{s}", f"abs_residual_{s}")]
    rows = residuals.residual_features(fitted.residuals().select("split", "unit_id", "seq", *kept), S4)
    return residuals.validate_residuals(rows, source, S4)


# ---------------------------------------------------------------- detectors

@query("H1", "split", "unit_id seq", "total_abs_residual", sql="SELECT * FROM res", tables=("res",))
def total_residual(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.fit_lineitem(spark, sf).residuals()


def _thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.fit_thresholds(inputs.fit_lineitem(spark, sf).residuals(sequenced=False))


@query("H2", "context_id", "rows_used", "watch warning critical", sql="SELECT * FROM thr", tables=("thr",))
def thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return _thresholds(spark, sf)


@query("H3", "context_id problem", tables=("thr",),
       sql="""WITH t AS (SELECT context_id, CASE WHEN context_id = '1' THEN critical*2 ELSE watch END AS watch, warning, critical FROM thr WHERE context_id <> 'global')
       SELECT context_id, 'levels_out_of_order' AS problem FROM t WHERE NOT (watch <= warning AND warning <= critical)
       UNION ALL SELECT 'global', 'missing' WHERE (SELECT count(*) FROM t WHERE context_id = 'global') = 0""")
def threshold_problems(spark: SparkSession, sf: str) -> DataFrame:
    t = _thresholds(spark, sf)
    anomaly.check_thresholds(t)
    damaged = t.where("context_id <> 'global'").withColumn(
        "watch", F.when(F.col("context_id") == "1", F.col("critical") * 2).otherwise(F.col("watch")))
    return anomaly.bad_thresholds(damaged)


@query("H4", "split", "unit_id gmm_context_id seq", "watch_threshold warning_threshold critical_threshold", tables=("res", "thr"),
       sql="""SELECT res.split, unit_id, seq, gmm_context_id, coalesce(t.watch, g.watch) AS watch_threshold, coalesce(t.warning, g.warning) AS warning_threshold,
       coalesce(t.critical, g.critical) AS critical_threshold FROM res LEFT JOIN (SELECT * FROM thr WHERE context_id <> '2') t ON t.context_id = CAST(gmm_context_id AS VARCHAR)
       CROSS JOIN (SELECT * FROM thr WHERE context_id = 'global') g""")
def attached_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    fitted = inputs.fit_lineitem(spark, sf)
    known = anomaly.fit_thresholds(fitted.residuals(sequenced=False)).where("context_id <> '2'")
    return anomaly.attach_thresholds(fitted.residuals(), known)


@query("H5", "split residual_alert_level", "unit_id seq", "total_abs_residual residual_anomaly_score", sql="SELECT * FROM sc", tables=("sc",))
def residual_scores(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.scored(inputs.fit_lineitem(spark, sf))


@query("H6", "feature", "n", "mean", tables=("res",),
       sql=f"""WITH x AS (SELECT {each('residual_{s}')}, {FEATURE_SQL} FROM res)
       SELECT feature, count(*) AS n, avg(v) AS mean FROM (UNPIVOT x ON COLUMNS(*) INTO NAME feature VALUE v) GROUP BY feature""")
def detector_features(spark: SparkSession, sf: str) -> DataFrame:
    df = _features(spark, sf)
    names = channels.anomaly_features(df)
    return df.agg(*[F.count(n).alias(f"{n}__n") for n in names], *[F.avg(n).alias(f"{n}__m") for n in names]).select(
        F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}__n").alias("n"), F.col(f"{n}__m").alias("mean")) for n in names])))


@query("H7", "split", "unit_id seq", "Xs_T48", tables=("ev",),
       sql="SELECT split, unit_id, seq, Xs_T48 FROM ev WHERE split = 'dev' ORDER BY md5(split || '|' || unit_id || '|' || seq || '|42'), split, unit_id, seq LIMIT 500")
def training_sample(spark: SparkSession, sf: str) -> DataFrame:
    return uniform_sample(inputs.events(spark, sf).where(F.col("split") == DEV), ["split", "unit_id", "seq"], 500)


DETECTOR_FEATURES = [f"residual_{s}" for s in S4] + FEATURES


def _inputs(spark: SparkSession, sf: str) -> DataFrame:
    """The detectors' inputs of every row, written once, without the columns that no detector reads."""
    return stored(_features(spark, sf).select("split", "unit_id", "seq", *DETECTOR_FEATURES))


@query("H8", "", "tree_id node_id feature rows", "cut path")
def isolation_trees(spark: SparkSession, sf: str) -> DataFrame:
    rows = prepare.standardize(_features(spark, sf).where(F.col("split") == DEV), DETECTOR_FEATURES)
    return detectors.isolation_trees(rows, DETECTOR_FEATURES)


@query("H9", "split", "unit_id seq iforest_anomaly_label", "iforest_raw_score iforest_anomaly_score")
def isolation_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _inputs(spark, sf)
    return detectors.isolation_scores(rows, detectors.fit_isolation_forest(rows, DETECTOR_FEATURES))


N = len(DETECTOR_FEATURES)
EACH = f"range(1, {N} + 1)"
_NAMES = "[" + ", ".join(f"'{n}'" for n in DETECTOR_FEATURES) + "]"


def _newton(rounds: int = 60) -> str:
    """Tables ``nv0`` to ``nv<rounds>``: X (2I - AX) from the transpose over its norms tends to the inverse of ``cv``."""
    product = f"list_transform({{x}}, lambda r: list_transform({EACH}, lambda j: list_sum(list_transform({EACH}, lambda k: r[k] * {{y}}[k][j]))))"
    norm = "list_max(list_transform(a, lambda r: list_sum(list_transform(r, lambda v: abs(v)))))"
    steps = [f"nv0 AS MATERIALIZED (SELECT a, list_transform(a, lambda r: list_transform(r, lambda v: v / ({norm} * {norm}))) AS x FROM cv)"]
    for k in range(rounds):
        steps.append(
            f"nv{k + 1} AS MATERIALIZED (SELECT a, {product.format(x='x', y='y')} AS x FROM (SELECT a, x, list_transform({EACH}, lambda i: list_transform({EACH}, "
            f"lambda j: (CASE WHEN i = j THEN 2.0 ELSE 0.0 END) - p[i][j])) AS y FROM (SELECT a, x, {product.format(x='a', y='x')} AS p FROM nv{k})))")
    return ",\n".join(steps)


SHRUNK = f"""fx AS (SELECT split, unit_id, seq, [{', '.join(DETECTOR_FEATURES)}] AS x FROM (SELECT split, unit_id, seq, {each('residual_{s}')}, {FEATURE_SQL} FROM res)),
st AS (SELECT list(m ORDER BY j) AS m, list(CASE WHEN s = 0 THEN 1.0 ELSE s END ORDER BY j) AS s FROM (
 SELECT j, avg(v) AS m, stddev_pop(v) AS s FROM (SELECT j, x[j] AS v FROM (SELECT x, unnest({EACH}) AS j FROM fx WHERE split = 'dev')) GROUP BY j)),
z AS (SELECT split, unit_id, seq, list_transform({EACH}, lambda j: (x[j] - m[j]) / s[j]) AS z FROM fx, st),
mu AS (SELECT list(m ORDER BY j) AS u FROM (SELECT j, avg(v) AS m FROM (SELECT j, z[j] AS v FROM (SELECT z, unnest({EACH}) AS j FROM z WHERE split = 'dev')) GROUP BY j)),
c AS (SELECT split, unit_id, seq, list_transform({EACH}, lambda j: z[j] - u[j]) AS d FROM z, mu),
mo AS (SELECT avg(power(list_sum(list_transform(d, lambda v: v * v)), 2)) AS f4, count(*) AS n FROM c WHERE split = 'dev'),
co AS (SELECT i, j, avg(d[i] * d[j]) AS v FROM (SELECT d, i, unnest({EACH}) AS j FROM (SELECT d, unnest({EACH}) AS i FROM c WHERE split = 'dev')) GROUP BY i, j),
lw0 AS (SELECT sum(v) FILTER (i = j) AS tr, sum(v * v) AS fro FROM co),
lw1 AS (SELECT tr / {N} AS m, (fro - 2 * tr / {N} * tr + {N} * power(tr / {N}, 2)) / {N} AS delta, (f4 - fro) / ({N} * n) AS beta0 FROM lw0, mo),
lw AS (SELECT m, CASE WHEN delta <= 0 OR beta0 <= 0 THEN 0.0 ELSE least(beta0, delta) / delta END AS sh FROM lw1),
cw AS (SELECT i, j, (1 - sh) * v + CASE WHEN i = j THEN sh * m ELSE 0.0 END AS v, sh FROM co, lw),
cv AS (SELECT list(r ORDER BY i) AS a FROM (SELECT i, list(v ORDER BY j) AS r FROM cw GROUP BY i))"""
DISTANCES = f"""{SHRUNK}, {_newton()},
pr AS (SELECT list_transform({EACH}, lambda i: list_transform({EACH}, lambda j: x[i][j] + CASE WHEN i = j THEN 1e-6 ELSE 0.0 END)) AS p FROM nv60),
d AS (SELECT split, unit_id, seq, sqrt(greatest(list_sum(list_transform({EACH}, lambda i: d[i] * list_sum(list_transform({EACH}, lambda j: p[i][j] * d[j])))), 0.0)) AS mahalanobis_distance FROM c, pr)"""


@query("H10", "first_feature second_feature", "", "covariance shrinkage", tables=("res",),
       sql=f"WITH {SHRUNK} SELECT {_NAMES}[i] AS first_feature, {_NAMES}[j] AS second_feature, v AS covariance, sh AS shrinkage FROM cw")
def shrunk_covariance(spark: SparkSession, sf: str) -> DataFrame:
    return detectors.covariance_table(detectors.fit_distance(_inputs(spark, sf), DETECTOR_FEATURES), spark)


@query("H11", "split", "unit_id seq", "mahalanobis_distance", sql=f"WITH {DISTANCES} SELECT * FROM d", tables=("res",))
def row_distances(spark: SparkSession, sf: str) -> DataFrame:
    rows = _inputs(spark, sf)
    return detectors.distances(rows, detectors.fit_distance(rows, DETECTOR_FEATURES))


@query("H12", "split", "unit_id seq mahalanobis_anomaly_label", "mahalanobis_score mahalanobis_threshold", tables=("res",),
       sql=f"""WITH {DISTANCES}, t AS (SELECT quantile_cont(mahalanobis_distance, 0.99) AS q FROM d WHERE split = 'dev'), r AS (SELECT min(mahalanobis_distance) AS lo, max(mahalanobis_distance) AS hi FROM d)
       SELECT split, unit_id, seq, CASE WHEN mahalanobis_distance >= q THEN 1 ELSE 0 END AS mahalanobis_anomaly_label,
       (mahalanobis_distance - lo)/greatest(hi - lo, 1e-12) AS mahalanobis_score, q AS mahalanobis_threshold FROM d, t, r""")
def distance_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _inputs(spark, sf)
    return detectors.distance_scores(rows, detectors.fit_distance(rows, DETECTOR_FEATURES))


@query("H13", "split", "unit_id seq sequence_ready", "lstm_reconstruction_error")
def reconstruction(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"residual_{s}" for s in S4]
    rows = stored(inputs.fit_lineitem(spark, sf).residuals().select("split", "unit_id", "seq", *names))
    model = detectors.fit_sequence_model(rows, names)
    return detectors.sequence_errors(rows, model)


@query("H14", "split", "unit_id row_count sequence_count total_dev_sequences validation_sequences train_sequences", tables=("ev",),
       sql="""WITH c AS (SELECT split, unit_id, count(*) AS row_count, greatest(count(*) - 19, 0) AS sequence_count FROM ev GROUP BY ALL),
       t AS (SELECT sum(sequence_count) AS total_dev_sequences, ceil(sum(sequence_count)/10.0) AS validation_sequences FROM c WHERE split = 'dev')
       SELECT c.*, t.*, total_dev_sequences - validation_sequences AS train_sequences FROM c, t""")
def sequence_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = detectors.sequence_counts(tables.events_telemetry(spark, sf, sequenced=False))
    return counts.crossJoin(F.broadcast(detectors.sequence_totals(counts)))


@query("H15", "split", "unit_id seq sequence_ready lstm_autoencoder_label", "lstm_reconstruction_error lstm_autoencoder_score lstm_threshold", tables=("ev",),
       sql=f"""WITH {sequence_errors('Xs_T48', 'ev')},
       t AS (SELECT quantile_cont(err, 0.99) AS q FROM se WHERE split = 'dev' AND ready = 1)
       SELECT split, unit_id, seq, ready AS sequence_ready, CASE WHEN ready = 1 AND err >= q THEN 1 ELSE 0 END AS lstm_autoencoder_label,
       err AS lstm_reconstruction_error, least(err/greatest(q, 1e-12), 1.0) AS lstm_autoencoder_score, q AS lstm_threshold FROM se, t""")
def reconstruction_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.events(spark, sf)
    return detectors.sequence_scores(rows, detectors.fit_sequence_model(rows, ["Xs_T48"], k=DIRECTIONS))


FUSED = "residual_contribution iforest_contribution mahalanobis_contribution lstm_autoencoder_contribution"


@query("H16", "split", "unit_id seq", "final_anomaly_score", sql="SELECT * FROM fu", tables=("fu",))
def fused_score(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.fused(spark, sf)


@query("H17", "split dominant_detector", "unit_id seq", FUSED, sql="SELECT * FROM fu", tables=("fu",))
def dominance(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.fused(spark, sf)


@query("H18", "split", "unit_id seq residual_vote detector_agreement_count", "detector_agreement_ratio", sql="SELECT * FROM fu", tables=("fu",))
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.fused(spark, sf)


@query("H19", "split alert_level", "unit_id seq", "", sql="SELECT * FROM evs", tables=("evs",))
def levels(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.events(spark, sf).withColumn("alert_level", anomaly.alert_level("final_anomaly_score"))


@query("H20", "split alert_level severity_description", "unit_id event_id severity_rank", "", tables=("ev0",),
       sql=f"""SELECT split, unit_id, event_id, alert_level, CASE alert_level WHEN 'Watch' THEN 1 WHEN 'Warning' THEN 2 WHEN 'Critical' THEN 3 ELSE 0 END AS severity_rank,
       CASE alert_level WHEN 'Watch' THEN 'Early abnormal behavior detected' WHEN 'Warning' THEN 'Strong anomaly pattern detected' WHEN 'Critical' THEN 'Critical anomaly pattern detected'
       ELSE 'Normal operating behavior' END AS severity_description FROM (SELECT *, {alert('final_anomaly_score')} AS alert_level FROM ev0)""")
def severity(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.classify_severity(tables.events_telemetry(spark, sf, sequenced=False))


@query("H21", "split", "unit_id seq", "rolling_anomaly_mean rolling_anomaly_slope positive_rolling_anomaly_slope early_warning_score", sql="SELECT * FROM ew", tables=("ew",))
def early_warning(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.early_events(spark, sf)


@query("H22", "split early_warning_label", "unit_id seq early_warning_rank early_warning_window", "", tables=("ew",),
       sql="SELECT *, CASE early_warning_label WHEN 'Watch_Risk' THEN 1 WHEN 'Increasing_Risk' THEN 2 ELSE 0 END AS early_warning_rank, 5 AS early_warning_window FROM ew")
def early_warning_labels(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.early_events(spark, sf)


@query("H23", "by_kind by_value alert_level", "row_count", "row_percent", tables=("ev0",),
       sql=f"""WITH x AS (SELECT split, CAST(gmm_context_id AS VARCHAR) AS c, {alert('final_anomaly_score')} AS alert_level FROM ev0)
       SELECT 'split' AS by_kind, split AS by_value, alert_level, count(*) AS row_count, count(*)*100.0/sum(count(*)) OVER (PARTITION BY split) AS row_percent FROM x GROUP BY split, alert_level
       UNION ALL SELECT 'context', c, alert_level, count(*), count(*)*100.0/sum(count(*)) OVER (PARTITION BY c) FROM x GROUP BY c, alert_level""")
def cross_tabs(spark: SparkSession, sf: str) -> DataFrame:
    df = anomaly.classify_severity(tables.events_telemetry(spark, sf, sequenced=False)).withColumn("context", F.col("gmm_context_id").cast("string"))
    a = anomaly.alert_cross_tab(df, "split").withColumnRenamed("split", "by_value").withColumn("by_kind", F.lit("split"))
    b = anomaly.alert_cross_tab(df, "context").withColumnRenamed("context", "by_value").withColumn("by_kind", F.lit("context"))
    return a.unionByName(b)


@query("H24", "split", "unit_id event_id", "scaled flat share", tables=("ev0",),
       sql="""SELECT split, unit_id, event_id, (Xs_T48 - lo)/(hi - lo) AS scaled, 0.0 AS flat, CASE WHEN gmm_context_id = 0 THEN 0.0 ELSE Xs_T48/gmm_context_id END AS share
       FROM ev0, (SELECT min(Xs_T48) AS lo, max(Xs_T48) AS hi FROM ev0)""")
def normalised(spark: SparkSession, sf: str) -> DataFrame:
    from fleetpulse.functions.exprs import safe_divide

    df = tables.events_telemetry(spark, sf, sequenced=False).withColumn("_one", F.lit(7.0))
    df = anomaly.min_max_scores(df, {"Xs_T48": "scaled", "_one": "flat"})
    return df.withColumn("share", safe_divide("Xs_T48", "gmm_context_id"))
