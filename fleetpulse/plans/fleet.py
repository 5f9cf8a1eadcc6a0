"""Queries O-P: serving and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import evaluation, explain, feedback, health, reasoning, serving
from fleetpulse.operators.contexts import log_likelihood, mixture_by_group
from fleetpulse.operators.ordering import order_buckets
from fleetpulse.plans import inputs
from fleetpulse.plans.monitoring import CORR_MODELS, MEMORY_SQL, correlation_importance, memory_rows
from fleetpulse.plans.registry import query
from fleetpulse.plans.sql import W, W5
from fleetpulse.sources import tables

UNIT = 3
SERVED_TEXT = (
    "split alert_level health_state anomaly_detected anomaly_status root_cause_pattern "
    "inspection_focus top_sensor_1 top_sensor_2 top_sensor_3 feedback_status"
)
SERVED_NUMS = (
    "health_index remaining_health_percentage final_anomaly_score context_confidence "
    "model_agreement_score confidence_score uncertainty_score reliability_score contribution_1 contribution_2 contribution_3"
)
MEANS = ("health_index", "confidence_score", "uncertainty_score", "reliability_score")
MEAN_SQL = ", ".join(f"avg({m}) AS average_{m}" for m in MEANS)


@query("O1", SERVED_TEXT + " explanation_text", "unit_id cycle seq kmeans_context_id gmm_context_id", SERVED_NUMS, tables=("sv", "flast"),
       sql="""SELECT sv.* REPLACE (coalesce(f.feedback_status, 'no_feedback') AS feedback_status) FROM sv LEFT JOIN flast f
       ON sv.unit_id = f.unit_id AND sv.cycle = f.cycle AND sv.gmm_context_id = f.context_id""")
def serving_table(spark: SparkSession, sf: str) -> DataFrame:
    latest = feedback.latest_feedback(inputs.feedback_log(spark, sf))
    return serving.serving_table(inputs.serving_source(spark, sf), latest)


@query("O2", "kind name", "", "value", tables=("sv",),
       sql=f"""SELECT 'alert_level' AS kind, alert_level AS name, count(*) AS value FROM sv GROUP BY ALL UNION ALL SELECT 'health_state', health_state, count(*) FROM sv GROUP BY ALL
       UNION ALL SELECT 'split', split, count(*) FROM sv GROUP BY ALL UNION ALL SELECT 'feedback_status', feedback_status, count(*) FROM sv GROUP BY ALL
       UNION ALL SELECT 'overall', name, v FROM (UNPIVOT (SELECT CAST(count(*) AS DOUBLE) AS records_count, CAST(count(*) FILTER (alert_level <> 'Normal') AS DOUBLE) AS anomaly_records,
       CAST(count(*) FILTER (alert_level = 'Normal') AS DOUBLE) AS normal_records, CAST(count(*) FILTER (alert_level <> 'Normal') AS DOUBLE)/count(*) AS anomaly_ratio, {MEAN_SQL} FROM sv)
       ON COLUMNS(*) INTO NAME name VALUE v)""")
def serving_summary(spark: SparkSession, sf: str) -> DataFrame:
    return serving.serving_summary(inputs.served(spark, sf))


@query("O3", SERVED_TEXT, "unit_id cycle seq matched_rows", SERVED_NUMS, tables=("sv",),
       sql=f"SELECT *, count(*) OVER () AS matched_rows FROM sv WHERE unit_id = {UNIT} ORDER BY cycle DESC, seq DESC LIMIT 1")
def latest_of_unit(spark: SparkSession, sf: str) -> DataFrame:
    return serving.latest_of_unit(inputs.served(spark, sf), UNIT)


@query("O4", SERVED_TEXT, "unit_id cycle seq", SERVED_NUMS, tables=("sv",),
       sql="SELECT * FROM sv QUALIFY row_number() OVER (PARTITION BY unit_id ORDER BY cycle DESC, seq) = 1")
def latest_of_all(spark: SparkSession, sf: str) -> DataFrame:
    return serving.latest_of_every_unit(inputs.served(spark, sf))


def _first_sql(cond: str, limit: int) -> str:
    return f"""SELECT *, (SELECT count(*) FROM sv WHERE {cond}) AS total_matching_records, (SELECT count(*) FROM sv WHERE {cond}) > {limit} AS truncated
    FROM (SELECT * FROM sv WHERE {cond} ORDER BY split, seq LIMIT {limit})"""


@query("O5", "split health_state alert_level anomaly_status truncated", "unit_id cycle seq total_matching_records", "health_index final_anomaly_score confidence_score", tables=("sv",),
       sql=_first_sql(f"unit_id = {UNIT}", 5000))
def unit_trend(spark: SparkSession, sf: str) -> DataFrame:
    return serving.health_trend_of_unit(inputs.served(spark, sf), UNIT)


@query("O6", "split health_state alert_level root_cause_pattern top_sensor_1 feedback_status truncated", "unit_id cycle seq total_matching_records", "final_anomaly_score health_index", tables=("sv",),
       sql=_first_sql(f"unit_id = {UNIT} AND alert_level <> 'Normal'", 5))
def unit_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return serving.anomalies_of_unit(inputs.served(spark, sf), UNIT, limit=5)


@query("O7", "split alert_level root_cause_pattern explanation_text", "unit_id cycle seq", "final_anomaly_score health_index", tables=("sv",),
       sql=f"SELECT * FROM sv WHERE unit_id = {UNIT} AND cycle = 5 ORDER BY split, seq LIMIT 1")
def unit_root_cause(spark: SparkSession, sf: str) -> DataFrame:
    return serving.root_cause_at(inputs.served(spark, sf), UNIT, 5)


@query("O8", "split truncated", "unit_id cycle seq total_matching_records", "model_agreement_score context_confidence confidence_score uncertainty_score reliability_score", tables=("sv",),
       sql=_first_sql(f"unit_id = {UNIT}", 5000))
def unit_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return serving.confidence_of_unit(inputs.served(spark, sf), UNIT)


@query("O9", "anomaly_detected", "alert_normal alert_watch alert_warning alert_critical state_healthy state_degrading state_warning state_critical anomaly_records total_records unique_units",
       "anomaly_ratio " + " ".join(f"average_{m}" for m in MEANS), tables=("sv",),
       sql="SELECT " + ", ".join(f"count(*) FILTER (alert_level = '{a}') AS alert_{a.lower()}" for a in ("Normal", "Watch", "Warning", "Critical")) + ", "
       + ", ".join(f"count(*) FILTER (health_state = '{a}') AS state_{a.lower()}" for a in ("Healthy", "Degrading", "Warning", "Critical"))
       + f""", count(*) FILTER (alert_level <> 'Normal') AS anomaly_records, count(*) FILTER (alert_level <> 'Normal') > 0 AS anomaly_detected,
       CAST(count(*) FILTER (alert_level <> 'Normal') AS DOUBLE)/count(*) AS anomaly_ratio, count(*) AS total_records, count(DISTINCT unit_id) AS unique_units, {MEAN_SQL} FROM sv""")
def fleet(spark: SparkSession, sf: str) -> DataFrame:
    return serving.fleet_summary(inputs.served(spark, sf))


@query("O10", "alert_level anomaly_detected anomaly_status", "event_id", "", tables=("evs",),
       sql="SELECT *, alert_level <> 'Normal' AS anomaly_detected, CASE WHEN alert_level <> 'Normal' THEN 'Anomaly_Detected' ELSE 'No_Anomaly' END AS anomaly_status FROM evs")
def anomaly_fields(spark: SparkSession, sf: str) -> DataFrame:
    from fleetpulse.operators.anomaly import classify_severity

    return serving.add_anomaly_fields(classify_severity(tables.events_telemetry(spark, sf, sequenced=False)))


MEMORY_ORDER = ["split", "unit_id", "cycle", "context_id", "final_anomaly_score"]
MEMORY = MEMORY_SQL.format(cond="true")


def _memory(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.alert_memory(memory_rows(spark, sf), feedback.latest_feedback(inputs.feedback_log(spark, sf)))


@query("O11", "split alert_level root_cause_pattern feedback_status truncated", "unit_id cycle context_id total_matching_records", "final_anomaly_score", tables=("evp", "flast"),
       sql=f"SELECT *, count(*) OVER () AS total_matching_records, count(*) OVER () > 500 AS truncated FROM ({MEMORY}) ORDER BY {', '.join(MEMORY_ORDER)} LIMIT 500")
def fleet_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return serving.fleet_anomalies(_memory(spark, sf), MEMORY_ORDER)


@query("O12", "kind alert_level feedback_label feedback_status feedback_truncated", "feedback_id unit_id cycle context_id feedback_total_records", "", tables=("flog", "evp", "flast"),
       sql=f"""SELECT * FROM (SELECT 'feedback' AS kind, alert_level, feedback_label, CASE WHEN cycle < 15 THEN 'used_for_threshold_adaptation' ELSE 'stored' END AS feedback_status,
       (SELECT count(*) FROM flog) > 500 AS feedback_truncated, feedback_id, unit_id, cycle, context_id, (SELECT count(*) FROM flog) AS feedback_total_records FROM flog ORDER BY feedback_id DESC LIMIT 500)
       UNION ALL SELECT * FROM (SELECT 'recent_alert', alert_level, NULL, feedback_status, NULL, NULL, unit_id, cycle, context_id, NULL FROM ({MEMORY}) ORDER BY {', '.join(MEMORY_ORDER)} LIMIT 100)""")
def history(spark: SparkSession, sf: str) -> DataFrame:
    # thresholds were adapted after day 15
    log = inputs.feedback_log(spark, sf)
    last = log.where("cycle < 15").agg(F.max("feedback_id")).first()[0]
    told = serving.feedback_history(feedback.mark_used(log, last or 0)).withColumn("kind", F.lit("feedback"))
    alerts = serving.recent_alerts(_memory(spark, sf), MEMORY_ORDER).withColumn("kind", F.lit("recent_alert"))
    return told.unionByName(alerts, allowMissingColumns=True)


SEARCHED = """SELECT * FROM sv WHERE alert_level = 'Warning' AND (contains(CAST(unit_id AS VARCHAR), 'xs_p') OR contains(CAST(cycle AS VARCHAR), 'xs_p') OR contains(lower(alert_level), 'xs_p')
 OR contains(lower(anomaly_status), 'xs_p') OR contains(lower(root_cause_pattern), 'xs_p') OR contains(lower(top_sensor_1), 'xs_p') OR contains(lower(top_sensor_2), 'xs_p') OR contains(lower(top_sensor_3), 'xs_p'))"""


@query("O13", "split alert_level top_sensor_1", "unit_id cycle seq", "final_anomaly_score", sql=SEARCHED, tables=("sv",))
def search(spark: SparkSession, sf: str) -> DataFrame:
    return serving.search_alerts(inputs.served(spark, sf), "Warning", " Xs_P")


@query("O14", "split alert_level", "unit_id cycle seq", "final_anomaly_score", tables=("sv",),
       sql="SELECT * FROM sv WHERE alert_level <> 'Normal' ORDER BY cycle, split, unit_id, seq LIMIT 12 OFFSET 24")
def third_page(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.served(spark, sf).where("alert_level <> 'Normal'")
    return serving.page(rows, ["cycle", "split", "unit_id", "seq"], 3)


@query("O15", "split alert_level", "unit_id cycle", "final_anomaly_score", tables=("evs",),
       sql="""SELECT split, unit_id, cycle, final_anomaly_score, alert_level FROM (SELECT *, seq - 1 AS r, count(*) OVER (PARTITION BY split, unit_id) AS n FROM evs)
       WHERE r % greatest(1, CAST(ceil(n/20.0) AS BIGINT)) = 0 OR r = n - 1""")
def points(spark: SparkSession, sf: str) -> DataFrame:
    from fleetpulse.operators.anomaly import classify_severity

    rows = classify_severity(tables.events_telemetry(spark, sf, sequenced=False))
    return serving.chart_points(rows, ["split", "unit_id"], ["ts", "event_id"], order_buckets("ts", "event_id"), points=20)


@query("O16", "facet value", "count", "", tables=("evp", "flast", "flog"),
       sql=f"""WITH m AS ({MEMORY}) SELECT DISTINCT 'units' AS facet, CAST(unit_id AS VARCHAR) AS value, 0 AS count FROM m UNION SELECT 'contexts', CAST(context_id AS VARCHAR), 0 FROM m
       UNION SELECT 'alertLevels', alert_level, 0 FROM m UNION SELECT 'patterns', root_cause_pattern, 0 FROM m UNION ALL SELECT 'labels', feedback_label, count(*) FROM flog GROUP BY feedback_label""")
def facets(spark: SparkSession, sf: str) -> DataFrame:
    labels = serving.label_counts(inputs.feedback_log(spark, sf)).select(F.lit("labels").alias("facet"), F.col("label").alias("value"), "count")
    return serving.facets(_memory(spark, sf)).withColumn("count", F.lit(0).cast("long")).unionByName(labels)


@query("O17", "model feature", "", "mean_abs_shap", sql=f"SELECT * FROM ({CORR_MODELS}) WHERE model = 'dev'", tables=("li",))
def model_rows(spark: SparkSession, sf: str) -> DataFrame:
    return serving.attribution_of_model(correlation_importance(spark, sf), "dev")


@query("O18", "name", "row_count", "", tables=("evp",),
       sql="SELECT root_cause_pattern AS name, count(*) AS row_count FROM evp GROUP BY ALL ORDER BY row_count DESC, name LIMIT 3")
def top_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return serving.top_counts(inputs.with_pattern(tables.events_telemetry(spark, sf, sequenced=False)), "root_cause_pattern", 3)


# ---------------------------------------------------------------- evaluation

LEVELS = ("Normal", "Watch", "Warning", "Critical")
RISKS = ("Stable", "Watch_Risk", "Increasing_Risk")
P1_INTS = "row_count " + " ".join(f"{n.lower()}_count" for n in (*LEVELS, *RISKS)) + " anomaly_alert_count"
P1_NUMS = (
    " ".join(f"{n.lower()}_ratio" for n in (*LEVELS, *RISKS))
    + " anomaly_alert_ratio average_final_anomaly_score std_final_anomaly_score min_final_anomaly_score max_final_anomaly_score"
    " average_anomaly_persistence_proxy false_alarm_proxy_rate average_detector_agreement_ratio average_detector_agreement_count"
    " average_residual_anomaly_score average_iforest_anomaly_score average_mahalanobis_score average_lstm_autoencoder_score"
    " average_early_warning_score average_rolling_anomaly_mean average_positive_rolling_slope"
)
# early warning and persistence over the fused rows
EW_FUSED = f"""f0 AS (SELECT *, coalesce(final_anomaly_score - lag(final_anomaly_score) OVER ({W}), 0.0) AS slope FROM fu),
f1 AS (SELECT *, avg(final_anomaly_score) OVER {W5} AS rolling_anomaly_mean, least(greatest(avg(slope) OVER {W5}, 0.0), 1.0) AS positive_rolling_anomaly_slope,
 avg(CASE WHEN final_anomaly_score >= 0.40 THEN 1.0 ELSE 0.0 END) OVER {W5} AS persistence FROM f0),
f2 AS (SELECT *, least(0.70*rolling_anomaly_mean + 0.30*positive_rolling_anomaly_slope, 1.0) AS early_warning_score FROM f1),
f3 AS (SELECT *, CASE WHEN early_warning_score >= 0.65 THEN 'Increasing_Risk' WHEN early_warning_score >= 0.40 THEN 'Watch_Risk' ELSE 'Stable' END AS early_warning_label FROM f2),
p1 AS (SELECT split, count(*) AS row_count, """ + ", ".join(
    f"count(*) FILTER (alert_level = '{n}') AS {n.lower()}_count, CAST(count(*) FILTER (alert_level = '{n}') AS DOUBLE)/count(*) AS {n.lower()}_ratio" for n in LEVELS) + ", " + ", ".join(
    f"count(*) FILTER (early_warning_label = '{n}') AS {n.lower()}_count, CAST(count(*) FILTER (early_warning_label = '{n}') AS DOUBLE)/count(*) AS {n.lower()}_ratio" for n in RISKS) + """,
 count(*) FILTER (alert_level <> 'Normal') AS anomaly_alert_count, CAST(count(*) FILTER (alert_level <> 'Normal') AS DOUBLE)/count(*) AS anomaly_alert_ratio,
 avg(final_anomaly_score) AS average_final_anomaly_score, stddev_pop(final_anomaly_score) AS std_final_anomaly_score, min(final_anomaly_score) AS min_final_anomaly_score,
 max(final_anomaly_score) AS max_final_anomaly_score, avg(persistence) AS average_anomaly_persistence_proxy,
 CAST(count(*) FILTER (alert_level <> 'Normal' AND final_anomaly_score < 0.40) AS DOUBLE)/count(*) AS false_alarm_proxy_rate, avg(detector_agreement_ratio) AS average_detector_agreement_ratio,
 avg(detector_agreement_count) AS average_detector_agreement_count, avg(residual_anomaly_score) AS average_residual_anomaly_score, avg(iforest_anomaly_score) AS average_iforest_anomaly_score,
 avg(mahalanobis_score) AS average_mahalanobis_score, avg(lstm_autoencoder_score) AS average_lstm_autoencoder_score, avg(early_warning_score) AS average_early_warning_score,
 avg(rolling_anomaly_mean) AS average_rolling_anomaly_mean, avg(positive_rolling_anomaly_slope) AS average_positive_rolling_slope FROM f3 GROUP BY split),
dd AS (SELECT split, dominant_detector FROM (SELECT *, row_number() OVER (PARTITION BY split ORDER BY n DESC, dominant_detector) AS r FROM (SELECT split, dominant_detector, count(*) AS n FROM fu GROUP BY ALL)) WHERE r = 1)"""


def _anomaly_metrics(spark: SparkSession, sf: str) -> DataFrame:
    from fleetpulse.operators.anomaly import early_warning

    return evaluation.anomaly_metrics(early_warning(inputs.fused(spark, sf)))


@query("P1", "split dominant_detector", P1_INTS, P1_NUMS, sql=f"WITH {EW_FUSED} SELECT * FROM p1 JOIN dd USING (split)", tables=("fu",))
def anomaly_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _anomaly_metrics(spark, sf)


@query("P2", "", "", "average_anomaly_alert_ratio average_final_anomaly_score average_early_warning_score test_vs_dev_alert_ratio_multiplier", tables=("fu",),
       sql=f"""WITH {EW_FUSED}, d AS (SELECT max(anomaly_alert_ratio) FILTER (split = 'dev') AS dv, max(anomaly_alert_ratio) FILTER (split = 'test') AS ts FROM p1)
       SELECT avg(anomaly_alert_ratio) AS average_anomaly_alert_ratio, avg(average_final_anomaly_score) AS average_final_anomaly_score, avg(average_early_warning_score) AS average_early_warning_score,
       max(CASE WHEN dv > 0 THEN ts/dv END) AS test_vs_dev_alert_ratio_multiplier FROM p1, d""")
def anomaly_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.anomaly_summary(_anomaly_metrics(spark, sf))


STATES = ("Healthy", "Degrading", "Warning", "Critical")
TRENDS = ("Stable", "Deteriorating", "Recovering")
PRIORITIES = ("Routine", "Low", "Medium", "High")
P3_INTS = "row_count " + " ".join(f"{s.lower()}_count" for s in STATES)
P3_NUMS = (
    "average_health_index std_health_index min_health_index max_health_index average_final_anomaly_score average_residual_trend_score average_anomaly_persistence_score "
    "health_trend_smoothness mean_abs_health_delta health_deterioration_consistency average_health_deterioration_score average_health_index_delta "
    + " ".join([f"{s.lower()}_ratio" for s in STATES] + [f"{s.lower()}_trend_ratio" for s in TRENDS] + [f"{s.lower()}_priority_ratio" for s in PRIORITIES])
)


def _ratio(column: str, values: tuple[str, ...], suffix: str) -> str:
    return ", ".join(f"CAST(count(*) FILTER ({column} = '{v}') AS DOUBLE)/count(*) AS {v.lower()}{suffix}" for v in values)


HEALTH_METRICS = f"""SELECT split, count(*) AS row_count, avg(health_index) AS average_health_index, stddev_pop(health_index) AS std_health_index, min(health_index) AS min_health_index,
 max(health_index) AS max_health_index, avg(final_anomaly_score) AS average_final_anomaly_score, avg(residual_trend_score) AS average_residual_trend_score,
 avg(anomaly_persistence_score) AS average_anomaly_persistence_score, 1/(1 + avg(abs(health_index_delta))) AS health_trend_smoothness, avg(abs(health_index_delta)) AS mean_abs_health_delta,
 CAST(count(*) FILTER (health_index_delta <= 0.0) AS DOUBLE)/count(*) AS health_deterioration_consistency, {_ratio('health_state', STATES, '_ratio')}, {_ratio('health_trend_label', TRENDS, '_trend_ratio')},
 {_ratio('inspection_priority', PRIORITIES, '_priority_ratio')}, """ + ", ".join(f"count(*) FILTER (health_state = '{s}') AS {s.lower()}_count" for s in STATES) + """,
 avg(health_deterioration_score) AS average_health_deterioration_score, avg(health_index_delta) AS average_health_index_delta FROM eva GROUP BY split"""


def _health_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.health_metrics(health.health_alerts(health.health_trends(inputs.health_events(spark, sf))))


@query("P3", "split", P3_INTS, P3_NUMS, sql=HEALTH_METRICS, tables=("eva",))
def health_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _health_metrics(spark, sf)


@query("P4", "split", "", "correlation_health_index_T_wear correlation_health_index_T_flat", tables=("evh",),
       sql="SELECT split, coalesce(corr(health_index, Xs_T48*0.5 + cycle), 0.0) AS correlation_health_index_T_wear, 0.0 AS correlation_health_index_T_flat FROM evh GROUP BY split")
def correlations(spark: SparkSession, sf: str) -> DataFrame:
    from fleetpulse.functions.channels import degradation_channels

    df = inputs.health_events(spark, sf).withColumns({"T_wear": F.col("Xs_T48") * 0.5 + F.col("cycle"), "T_flat": F.lit(1.5)})
    return evaluation.health_correlations(df, degradation_channels(df))


@query("P5", "", "", "average_health_trend_smoothness average_health_deterioration_consistency average_health_index health_drop_test_vs_dev test_vs_dev_critical_multiplier", tables=("eva",),
       sql=f"""WITH m AS ({HEALTH_METRICS}), d AS (SELECT max(average_health_index) FILTER (split = 'dev') AS hd, max(average_health_index) FILTER (split = 'test') AS ht,
       max(critical_ratio) FILTER (split = 'dev') AS cd, max(critical_ratio) FILTER (split = 'test') AS ct FROM m)
       SELECT avg(health_trend_smoothness) AS average_health_trend_smoothness, avg(health_deterioration_consistency) AS average_health_deterioration_consistency,
       avg(average_health_index) AS average_health_index, max(hd - ht) AS health_drop_test_vs_dev, max(CASE WHEN cd > 0 THEN ct/cd END) AS test_vs_dev_critical_multiplier FROM m, d""")
def health_summary(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.health_evaluation_summary(_health_metrics(spark, sf))


def _quality_sql(label: str, name: str) -> str:
    return f"""{name}c AS (SELECT split, {label} AS c, count(*) AS n, avg(x*x + y*y) AS q, avg(x) AS mx, avg(y) AS my FROM v GROUP BY ALL),
 {name}d AS (SELECT v.split, v.id, v.{label} AS own, k.c, k.n, greatest(v.x*v.x + v.y*v.y - 2*(v.x*k.mx + v.y*k.my) + k.q, 0.0) AS dist, sqrt(power(v.x - k.mx, 2) + power(v.y - k.my, 2)) AS gap FROM v JOIN {name}c k ON v.split = k.split),
 {name}s AS (SELECT split, id, max(CASE WHEN c = own THEN n END) AS n, max(CASE WHEN c = own THEN dist*n/(n - 1) END) AS a, min(CASE WHEN c <> own THEN dist END) AS b FROM {name}d GROUP BY split, id),
 {name}r AS (SELECT split, avg(CASE WHEN n <= 1 THEN 0.0 ELSE (b - a)/greatest(a, b) END) AS sil, count(*) AS n FROM {name}s GROUP BY split),
 {name}g AS (SELECT split, own AS c, avg(gap) AS s FROM {name}d WHERE c = own GROUP BY split, own),
 {name}b AS (SELECT split, avg(w) AS db FROM (SELECT a.split, a.c, max((ga.s + gb.s)/sqrt(power(a.mx - b.mx, 2) + power(a.my - b.my, 2))) AS w FROM {name}c a JOIN {name}c b ON a.split = b.split AND a.c <> b.c
  JOIN {name}g ga ON ga.split = a.split AND ga.c = a.c JOIN {name}g gb ON gb.split = b.split AND gb.c = b.c GROUP BY a.split, a.c) GROUP BY split)"""


@query("P6", "split", "rows_seen", "kmeans_silhouette gmm_silhouette kmeans_davies_bouldin gmm_davies_bouldin average_context_confidence gmm_average_log_likelihood",
       sql=f"""WITH v AS (SELECT CASE WHEN vec_id % 3 = 2 THEN 'test' ELSE 'dev' END AS split, vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, label % 3 AS ka, label AS gb FROM embeddings),
       {_quality_sql('ka', 'k')}, {_quality_sql('gb', 'g')},
       p AS (SELECT ka, CAST(count(*) AS DOUBLE)/sum(count(*)) OVER () AS w, avg(x) AS mx, avg(y) AS my, covar_pop(x, x) AS sxx, covar_pop(y, y) AS syy, covar_pop(x, y) AS sxy FROM v WHERE split = 'dev' GROUP BY ka),
       ll AS (SELECT split, id, ln(sum(w*exp(-0.5*((x-mx)*(x-mx)*syy - 2*(x-mx)*(y-my)*sxy + (y-my)*(y-my)*sxx)/(sxx*syy - sxy*sxy))/(2*pi()*sqrt(sxx*syy - sxy*sxy)))) AS l FROM v CROSS JOIN p GROUP BY split, id),
       m AS (SELECT split, avg(l) AS l FROM ll GROUP BY split), h AS (SELECT split, avg(1.0/(1 + abs(x))) AS c FROM v GROUP BY split)
       SELECT kr.split, kr.n AS rows_seen, kr.sil AS kmeans_silhouette, gr.sil AS gmm_silhouette, kb.db AS kmeans_davies_bouldin, gb.db AS gmm_davies_bouldin, h.c AS average_context_confidence, m.l AS gmm_average_log_likelihood
       FROM kr JOIN gr USING (split) JOIN kb USING (split) JOIN gb USING (split) JOIN m USING (split) JOIN h USING (split)""")
def context_quality(spark: SparkSession, sf: str) -> DataFrame:
    names = ["W_1", "W_2"]
    df = tables.embedding_vectors(spark, sf, 2).withColumns({
        "kmeans_context_id": F.col("unit_id") % 3, "gmm_context_id": F.col("unit_id"), "context_confidence": 1.0 / (1.0 + F.abs("W_1"))})
    return evaluation.context_metrics(log_likelihood(df, names, mixture_by_group(df, names, "kmeans_context_id")), names)


@query("P7", "split dominant_root_cause_pattern", "", "top_sensor_stability inspection_focus_completeness recurrence_ratio temporal_reasoning_available", tables=("rec",),
       sql="""WITH x AS (SELECT *, CASE WHEN gmm_context_id < 3 THEN 'Xs_T48' ELSE 'Xs_P2' END AS s FROM rec), a AS (SELECT split, s, count(*) AS n FROM x GROUP BY ALL),
       b AS (SELECT split, p, row_number() OVER (PARTITION BY split ORDER BY n DESC, p) AS r FROM (SELECT split, root_cause_pattern AS p, count(*) AS n FROM x GROUP BY ALL))
       SELECT x.split, max(p) AS dominant_root_cause_pattern, max(st) AS top_sensor_stability, avg(CASE WHEN gmm_context_id <> 4 THEN 1.0 ELSE 0.0 END) AS inspection_focus_completeness,
       avg(CASE WHEN similar_pattern_count_recent >= 2 THEN 1.0 ELSE 0.0 END) AS recurrence_ratio, 1.0 AS temporal_reasoning_available
       FROM x JOIN (SELECT split, CAST(max(n) AS DOUBLE)/sum(n) AS st FROM a GROUP BY split) q ON q.split = x.split JOIN b ON b.split = x.split AND b.r = 1 GROUP BY x.split""")
def reasoning_quality(spark: SparkSession, sf: str) -> DataFrame:
    df = reasoning.recurrence(reasoning.temporal_features(inputs.pattern_events(spark, sf)))
    df = df.withColumns({
        "top_sensor_1": F.when(F.col("gmm_context_id") < 3, "Xs_T48").otherwise("Xs_P2"),
        "inspection_focus": F.when(F.col("gmm_context_id") != 4, reasoning.pattern_focus("root_cause_pattern"))})
    return evaluation.reasoning_metrics(df)


@query("P8", "split shap_available sensor_residual_ranking_available", "", "explanation_completeness_score explanation_text_availability top_sensor_explanation_availability", tables=("evp",),
       sql="""SELECT split, avg((10 + CASE WHEN gmm_context_id <> 2 THEN 1 ELSE 0 END)/11.0) AS explanation_completeness_score, avg(CASE WHEN gmm_context_id <> 3 THEN 1.0 ELSE 0.0 END) AS explanation_text_availability,
       avg(CASE WHEN gmm_context_id <> 2 THEN 1.0 ELSE 0.0 END) AS top_sensor_explanation_availability, false AS shap_available, true AS sensor_residual_ranking_available FROM evp GROUP BY split""")
def explanation_quality(spark: SparkSession, sf: str) -> DataFrame:
    df = explain.explanation_report(inputs.pattern_events(spark, sf)).withColumns({
        "top_sensor_3": F.when(F.col("gmm_context_id") != 2, F.col("top_sensor_3")),
        "explanation_text": F.when(F.col("gmm_context_id") != 3, F.col("explanation_text")).otherwise("short")})
    return evaluation.explanation_metrics(df, ranking=True)

