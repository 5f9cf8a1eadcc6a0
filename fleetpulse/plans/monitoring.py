"""Queries I-N: health, joins, reasoning, explanation, uncertainty, feedback."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetpulse.functions.exprs import safe_corr
from fleetpulse.operators import anomaly, explain, feedback, health, ordering, reasoning, tree_attribution, twin, uncertainty
from fleetpulse.plans import detection, inputs
from fleetpulse.plans.registry import query
from fleetpulse.plans.sql import fixed, quote
from fleetpulse.sources import tables
from fleetpulse.streaming.storage import shared_folder

S4 = inputs.SENSORS
ABS4 = inputs.ABS_RESIDUALS


@query("I1", "split", "unit_id seq", "residual_trend_score anomaly_persistence_score", sql="SELECT * FROM evh", tables=("evh",))
def trend_and_persistence(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_index(inputs.events(spark, sf))


@query("I2", "split", "unit_id seq", "health_index remaining_health_percentage", sql="SELECT * FROM evh", tables=("evh",))
def index(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_index(inputs.events(spark, sf))


@query("I3", "split", "rows", "average_health_index average_final_anomaly_score average_residual_trend_score average_anomaly_persistence_score min_health_index max_health_index",
       sql="""SELECT split, count(*) AS rows, avg(health_index) AS average_health_index, avg(final_anomaly_score) AS average_final_anomaly_score,
       avg(residual_trend_score) AS average_residual_trend_score, avg(anomaly_persistence_score) AS average_anomaly_persistence_score,
       min(health_index) AS min_health_index, max(health_index) AS max_health_index FROM evh GROUP BY split""", tables=("evh",))
def summary(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_summary(health.health_index(inputs.events(spark, sf)))


@query("I4", "split health_state health_state_explanation", "unit_id cycle seq health_state_rank", "health_index", tables=("evh",),
       sql="""SELECT *, CASE health_state WHEN 'Healthy' THEN 3 WHEN 'Degrading' THEN 2 WHEN 'Warning' THEN 1 ELSE 0 END AS health_state_rank,
       CASE health_state WHEN 'Healthy' THEN 'Health index is high and anomaly severity is low.' WHEN 'Degrading' THEN 'Health index shows early degradation signs.'
       WHEN 'Warning' THEN 'Health index indicates significant degradation behavior.' ELSE 'Health index indicates severe anomaly behavior.' END AS health_state_explanation FROM evh""")
def states(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_state(health.health_index(inputs.events(spark, sf)))


def _trends(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_trends(inputs.health_events(spark, sf))


@query("I5", "split", "unit_id seq", "health_index_rolling_mean health_index_delta health_deterioration_score_raw", sql="SELECT * FROM evt", tables=("evt",))
def raw_trends(spark: SparkSession, sf: str) -> DataFrame:
    return health.raw_trends(inputs.health_events(spark, sf))


@query("I6", "split", "unit_id seq", "health_deterioration_score", sql="SELECT * FROM evt", tables=("evt",))
def deterioration(spark: SparkSession, sf: str) -> DataFrame:
    return _trends(spark, sf)


@query("I7", "split health_trend_label", "unit_id seq", "", sql="SELECT * FROM evt", tables=("evt",))
def trend_labels(spark: SparkSession, sf: str) -> DataFrame:
    return health.raw_trends(inputs.health_events(spark, sf))


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return health.health_alerts(health.raw_trends(inputs.health_events(spark, sf)))


@query("I8", "split inspection_priority", "unit_id seq inspection_priority_rank", "", tables=("eva",),
       sql="SELECT *, CASE inspection_priority WHEN 'Low' THEN 1 WHEN 'Medium' THEN 2 WHEN 'High' THEN 3 ELSE 0 END AS inspection_priority_rank FROM eva")
def priorities(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(spark, sf)


@query("I9", "split inspection_focus", "unit_id seq", "", sql="SELECT * FROM eva", tables=("eva",))
def focus(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(spark, sf)


@query("I10", "split health_alert_message", "unit_id seq", "", tables=("eva",),
       sql=f"""SELECT *, 'Health state is ' || health_state || ' with ' || alert_level || ' anomaly alert. Health index is ' || {fixed('health_index', 1)} || '/100 and final anomaly score is '
       || {fixed('final_anomaly_score', 3)} || '. Health trend is ' || health_trend_label || '. Inspection priority is ' || inspection_priority
       || '. This module provides inspection-focus support only; maintenance scheduling decisions belong to the autonomous maintenance supervisor.' AS health_alert_message FROM eva""")
def messages(spark: SparkSession, sf: str) -> DataFrame:
    return _alerts(spark, sf)


# ---------------------------------------------------------------- joins

@query("J1", "split", "unit_id cycle seq gmm_context_id", "matched", tables=("li",),
       sql="""WITH l AS (SELECT *, row_number() OVER (PARTITION BY split, unit_id, cycle ORDER BY seq) AS occ FROM li),
       r AS (SELECT split, unit_id, cycle, Xs_Ps30 AS matched, row_number() OVER (PARTITION BY split, unit_id, cycle ORDER BY seq) AS occ FROM li WHERE gmm_context_id <> 1)
       SELECT l.split, l.unit_id, l.cycle, l.seq, l.gmm_context_id, r.matched FROM l LEFT JOIN r USING (split, unit_id, cycle, occ)""")
def by_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    li = tables.lineitem_telemetry(spark, sf)
    right = li.where("gmm_context_id <> 1").select("split", "unit_id", "cycle", "seq", F.col("Xs_Ps30").alias("matched"))
    return ordering.occurrence_join(li, right, ["split", "unit_id", "cycle"])


@query("J2", "split", "unit_id seq", "Xs_T48 doubled rank_score", tables=("ev",),
       sql="SELECT split, unit_id, seq, Xs_T48, Xs_T48*2 AS doubled, final_anomaly_score AS rank_score FROM ev")
def by_row_key(spark: SparkSession, sf: str) -> DataFrame:
    ev = inputs.events(spark, sf)
    key = ["split", "unit_id", "seq"]
    return ordering.key_join(
        ev.select(*key, "Xs_T48"), ev.select(*key, (F.col("Xs_T48") * 2).alias("doubled")),
        ev.select(*key, F.col("final_anomaly_score").alias("rank_score")))


@query("J3", "aligned", "left_rows right_rows left_only_keys right_only_keys", tables=("ev",),
       sql="SELECT count(*) AS left_rows, count(*) FILTER (gmm_context_id <> 2) AS right_rows, count(*) FILTER (gmm_context_id = 2) AS left_only_keys, 0 AS right_only_keys, count(*) FILTER (gmm_context_id = 2) = 0 AS aligned FROM ev")
def audit(spark: SparkSession, sf: str) -> DataFrame:
    ev = inputs.events(spark, sf)
    return ordering.alignment_audit(ev, ev.where("gmm_context_id <> 2"))


@query("J4", "split feedback_status", "unit_id cycle event_id", "", tables=("ev0", "flast"),
       sql="SELECT e.split, e.unit_id, e.cycle, e.event_id, coalesce(f.feedback_status, 'no_feedback') AS feedback_status FROM ev0 e LEFT JOIN flast f ON e.unit_id = f.unit_id AND e.cycle = f.cycle AND e.gmm_context_id = f.context_id AND f.feedback_status <> 'uncertain'")
def with_status(spark: SparkSession, sf: str) -> DataFrame:
    latest = feedback.latest_feedback(inputs.feedback_log(spark, sf)).where("feedback_status <> 'uncertain'")
    return feedback.with_feedback(tables.events_telemetry(spark, sf, sequenced=False), latest)


# ---------------------------------------------------------------- reasoning

def _ranked(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.root_cause(inputs.fit_lineitem(spark, sf).residuals(), ABS4)


@query("K1", "split top_sensor_1 top_sensor_2 top_sensor_3", "unit_id seq", "contribution_1 contribution_2 contribution_3 top3_contribution_sum", sql="SELECT * FROM rc", tables=("rc",))
def top_sensors(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.rank_sensors(inputs.fit_lineitem(spark, sf).residuals(), ABS4, 3)


@query("K2", "split has_temperature has_pressure has_flow has_rotation has_hot_section has_core_pressure", "unit_id seq", "", tables=("rc",),
       sql="SELECT *, has_t AS has_temperature, has_p AS has_pressure, has_w AS has_flow, has_n AS has_rotation, has_t AS has_hot_section, has_p AS has_core_pressure FROM rc")
def families(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.add_family_flags(_ranked(spark, sf), ["top_sensor_1", "top_sensor_2", "top_sensor_3"])


@query("K3", "split root_cause_pattern", "unit_id seq", "", sql="SELECT * FROM rc", tables=("rc",))
def patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


@query("K4", "split inspection_focus", "unit_id seq", "", sql="SELECT * FROM rc", tables=("rc",))
def pattern_focus(spark: SparkSession, sf: str) -> DataFrame:
    return _ranked(spark, sf)


FAULT_SQL = """CASE WHEN final_anomaly_score < 0.40 THEN 'normal_operating_variation'
 WHEN context_confidence < 0.50 AND anomaly_persistence_score < 0.40 THEN 'possible_operating_context_shift'
 WHEN final_anomaly_score >= 0.85 AND anomaly_persistence_score >= 0.40 THEN 'critical_persistent_fault_related_pattern'
 WHEN final_anomaly_score >= 0.65 AND anomaly_persistence_score >= 0.40 THEN 'likely_fault_related_residual_pattern'
 WHEN anomaly_persistence_score >= 0.40 THEN 'persistent_watch_level_residual_pattern' ELSE 'watch_level_residual_pattern' END"""


def _with_confidence(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.pattern_events(spark, sf).withColumn("context_confidence", 1.0 - F.col("gmm_context_id") * 0.15)


@query("K5", "split fault_label", "unit_id seq", "", tables=("evp",),
       sql=f"SELECT *, {FAULT_SQL} AS fault_label FROM (SELECT *, 1.0 - gmm_context_id*0.15 AS context_confidence FROM evp)")
def fault_labels(spark: SparkSession, sf: str) -> DataFrame:
    return _with_confidence(spark, sf).withColumn(
        "fault_label", reasoning.operating_or_fault("final_anomaly_score", "context_confidence", "anomaly_persistence_score"))


FOCUS_SQL = "CASE root_cause_pattern " + " ".join(f"WHEN '{k}' THEN {quote(v)}" for k, v in reasoning.PATTERN_FOCUS.items()) + f" ELSE {quote(reasoning.DEFAULT_FOCUS)} END"


@query("K6", "split summary", "unit_id seq", "", tables=("evp",),
       sql=f"""SELECT *, 'The alert level is ' || alert_level || '. Residual attribution suggests ' || root_cause_pattern || '. The operating-vs-fault reasoning label is ' || {FAULT_SQL}
       || '. Recommended inspection focus: ' || {FOCUS_SQL} || ' This is an explanation and inspection-focus recommendation only, not a maintenance scheduling decision.' AS summary
       FROM (SELECT *, 1.0 - gmm_context_id*0.15 AS context_confidence FROM evp)""")
def summaries(spark: SparkSession, sf: str) -> DataFrame:
    return _with_confidence(spark, sf).withColumn("summary", reasoning.reasoning_summary(
        "alert_level", "root_cause_pattern", "final_anomaly_score", "context_confidence", "anomaly_persistence_score"))


GRAPH_SQL = " UNION ALL ".join(
    f"SELECT '{a}' AS source_family, '{b}' AS target_family, '{kind}' AS dependency_type, {strength} AS dependency_strength, {quote(note)} AS reasoning_note"
    for a, b, kind, strength, note in reasoning.GRAPH_EDGES)


@query("K7", "edge_type source_family target_family source_sensors target_sensors source_family_available target_family_available dependency_type reasoning_note", "available_sensor_count", "dependency_strength",
       sql=f"""WITH s AS (SELECT DISTINCT sensor FROM (UNPIVOT (SELECT Xs_T48, Xs_Ps30, Xs_Nf, Xs_Wf FROM li) ON COLUMNS(*) INTO NAME sensor VALUE v)),
       p AS (SELECT sensor, CASE sensor WHEN 'Xs_T48' THEN 'Temperature' WHEN 'Xs_Ps30' THEN 'Pressure' WHEN 'Xs_Nf' THEN 'Rotational' ELSE 'Fuel_Flow' END AS family FROM s),
       f AS (SELECT family, string_agg(sensor, ', ' ORDER BY sensor) AS names, count(*) AS n FROM p GROUP BY family)
       SELECT 'family_dependency' AS edge_type, source_family, target_family, coalesce(a.names, '') AS source_sensors, coalesce(b.names, '') AS target_sensors, a.n IS NOT NULL AS source_family_available,
       b.n IS NOT NULL AS target_family_available, coalesce(a.n, 0) + coalesce(b.n, 0) AS available_sensor_count, dependency_type, dependency_strength, reasoning_note
       FROM ({GRAPH_SQL}) e LEFT JOIN f a ON a.family = source_family LEFT JOIN f b ON b.family = target_family
       UNION ALL SELECT 'sensor_family_membership', family, family, sensor, sensor, true, true, 1, 'sensor_family_membership', 1.0, sensor || ' is grouped under the ' || family || ' reasoning family.' FROM p""", tables=("li",))
def graph(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.fit_lineitem(spark, sf).residuals(sequenced=False)
    return reasoning.dependency_graph(reasoning.sensor_table(rows, ABS4))


@query("K8", "split root_cause_pattern root_cause_recurrence_status root_cause_memory_note", "unit_id cycle event_id similar_pattern_count_recent", "", tables=("rec",),
       sql="""SELECT *, CASE WHEN similar_pattern_count_recent >= 2 THEN 'Recurring' WHEN similar_pattern_count_recent = 1 THEN 'Previously_Seen' ELSE 'New_or_Isolated' END AS root_cause_recurrence_status,
       'Recent previous cycle count=' || similar_pattern_count_recent || ' within 20 cycles.' AS root_cause_memory_note FROM rec""")
def recurrences(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.recurrence(inputs.with_pattern(tables.events_telemetry(spark, sf, sequenced=False)))


@query("K9", "split flag", "unit_id out_of_order_rows", "", tables=("ev",),
       sql="""SELECT split, unit_id, sum(CASE WHEN c < p THEN 1 ELSE 0 END) AS out_of_order_rows, CASE WHEN sum(CASE WHEN c < p THEN 1 ELSE 0 END) > 0 THEN 'Check_Order' ELSE 'OK' END AS flag
       FROM (SELECT split, unit_id, c, lag(c) OVER (PARTITION BY split, unit_id ORDER BY seq) AS p FROM (SELECT *, CASE WHEN event_id % 500 = 7 THEN cycle - 3 ELSE cycle END AS c FROM ev)) GROUP BY split, unit_id""")
def order_check(spark: SparkSession, sf: str) -> DataFrame:
    ev = inputs.events(spark, sf).withColumn("cycle", F.when(F.col("event_id") % 500 == 7, F.col("cycle") - 3).otherwise(F.col("cycle")))
    return reasoning.order_flag(ev).withColumnRenamed("root_cause_tracker_non_monotonic_cycle_flag", "flag")


def _temporal(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.temporal_features(inputs.pattern_events(spark, sf))


@query("K10", "split", "unit_id seq", "anomaly_score_rolling_mean anomaly_score_delta health_index_delta anomaly_persistence_score_temporal", sql="SELECT * FROM etr", tables=("etr",))
def temporal_features(spark: SparkSession, sf: str) -> DataFrame:
    return _temporal(spark, sf)


@query("K11", "split temporal_pattern", "unit_id seq", "", sql="SELECT * FROM etr", tables=("etr",))
def temporal_patterns(spark: SparkSession, sf: str) -> DataFrame:
    return _temporal(spark, sf)


@query("K12", "split temporal_reasoning_text", "unit_id seq", "", tables=("etr",),
       sql=f"""SELECT *, 'Temporal pattern is ' || temporal_pattern || '. Recent anomaly persistence is ' || {fixed('anomaly_persistence_score_temporal', 2)} || '. Anomaly score change is '
       || {fixed('anomaly_score_delta', 4)} || '. Health index change from previous cycle is ' || {fixed('health_index_delta', 2)} || '. Root-cause evidence suggests ' || root_cause_pattern
       || '. This is reasoning support only, not a maintenance decision.' AS temporal_reasoning_text FROM etr""")
def temporal_text(spark: SparkSession, sf: str) -> DataFrame:
    return reasoning.temporal_reasoning(_temporal(spark, sf))


@query("K13", "kind name split", "row_count", "", tables=("rc",),
       sql="""SELECT 'root_cause_pattern' AS kind, root_cause_pattern AS name, 'all' AS split, count(*) AS row_count FROM rc GROUP BY ALL UNION ALL
       SELECT 'inspection_focus', inspection_focus, 'all', count(*) FROM rc GROUP BY ALL UNION ALL SELECT 'top_sensor_1', top_sensor_1, 'all', count(*) FROM rc GROUP BY ALL UNION ALL
       SELECT 'root_cause_pattern', root_cause_pattern, split, count(*) FROM rc GROUP BY ALL""")
def counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = inputs.fit_lineitem(spark, sf).residuals(sequenced=False)
    return reasoning.pattern_counts(reasoning.root_cause(rows, ABS4))


# ---------------------------------------------------------------- explanation

@query("L1", "split rank_1_sensor rank_2_sensor rank_3_sensor rank_4_sensor rank_5_sensor", "unit_id seq",
       "total_abs_residual rank_1_contribution rank_2_contribution rank_3_contribution rank_4_contribution rank_5_contribution topk_contribution_sum", tables=("top",),
       sql="SELECT *, " + ", ".join(f"ranked[{i}].sensor AS rank_{i}_sensor, -ranked[{i}].neg AS rank_{i}_contribution" for i in range(1, 5))
       + ", 'none' AS rank_5_sensor, 0.0 AS rank_5_contribution, -(ranked[1].neg + ranked[2].neg + ranked[3].neg + ranked[4].neg) AS topk_contribution_sum FROM top")
def ranking(spark: SparkSession, sf: str) -> DataFrame:
    return explain.sensor_ranking(inputs.fit_lineitem(spark, sf).residuals(), ABS4)


def _subsystem(c: str) -> str:
    return f"CASE {c} WHEN 'Xs_T48' THEN 'hot_section_thermal_subsystem' WHEN 'Xs_Ps30' THEN 'core_pressure_subsystem' WHEN 'Xs_Nf' THEN 'fan_rotational_subsystem' WHEN 'Xs_Wf' THEN 'fuel_flow_subsystem' ELSE 'unknown_subsystem' END"


@query("L2", "split subsystem_1 subsystem_2 subsystem_3", "unit_id seq", "", tables=("rc",),
       sql="SELECT *, " + ", ".join(f"{_subsystem(f'top_sensor_{i}')} AS subsystem_{i}" for i in (1, 2, 3)) + " FROM rc")
def subsystems(spark: SparkSession, sf: str) -> DataFrame:
    return explain.subsystem_report(_ranked(spark, sf), text=False)


@query("L3", "split primary_subsystem subsystem_explanation", "unit_id seq", "", tables=("rc",),
       sql=f"""SELECT *, 'Leading residual contribution is associated with ' || primary_subsystem || '. Supporting contributors are ' || {_subsystem('top_sensor_2')} || ' and ' || {_subsystem('top_sensor_3')}
       || '. Pattern label: ' || root_cause_pattern || '. Inspection focus: ' || inspection_focus || ' This is explanation support only, not a maintenance decision.' AS subsystem_explanation
       FROM (SELECT *, {_subsystem('top_sensor_1')} AS primary_subsystem FROM rc)""")
def subsystem_report(spark: SparkSession, sf: str) -> DataFrame:
    return explain.subsystem_report(_ranked(spark, sf))


def _percent(c: str) -> str:
    return fixed(f"{c}*100.0", 1) + " || '%'"


L4_TEXT = (
    "'The engine shows a ' || alert_level || ' alert under GMM operating context ' || gmm_context_id || '. The baseline K-Means context is ' || kmeans_context_id || "
    "'. The ensemble digital twin estimated expected measured sensor behavior using operating conditions, virtual sensors, and context information, then compared it with actual measured sensors. "
    f"The final anomaly score is ' || {fixed('final_anomaly_score', 3)} || '. The health index is ' || {fixed('health_index', 1)} || '/100 and the health state is ' || health_state || "
    f"'. The main contributing sensors are ' || top_sensor_1 || ' (' || {_percent('contribution_1')} || '), ' || top_sensor_2 || ' (' || {_percent('contribution_2')} || '), and ' || top_sensor_3 || ' (' || {_percent('contribution_3')} || "
    f"'). The residual pattern is classified as ' || root_cause_pattern || '. Recommended inspection focus: ' || inspection_focus || ' Context confidence is ' || {_percent('context_confidence')} || "
    f"', model agreement is ' || {_percent('model_agreement_score')} || ', confidence is ' || {_percent('confidence_score')} || ', uncertainty is ' || {_percent('uncertainty_score')} || ', and reliability is ' || {_percent('reliability_score')} || "
    "'. This explanation supports inspection focus only and does not make maintenance scheduling decisions.'"
)


@query("L4", "split alert_level health_state top_sensor_1 top_sensor_2 top_sensor_3 root_cause_pattern inspection_focus dominant_detector explanation_text maintenance_decision component_role",
       "unit_id cycle seq kmeans_context_id gmm_context_id",
       "context_confidence final_anomaly_score health_index remaining_health_percentage anomaly_persistence_score residual_trend_score contribution_1 contribution_2 contribution_3 "
       "total_abs_residual top3_contribution_sum model_agreement_score confidence_score uncertainty_score reliability_score", tables=("wide",),
       sql=f"SELECT *, {L4_TEXT} AS explanation_text, 'Not generated by this component' AS maintenance_decision, 'Human-readable explanation and inspection-focus support' AS component_role FROM wide")
def report(spark: SparkSession, sf: str) -> DataFrame:
    return explain.explanation_report(inputs.wide(spark, sf))


@query("L5", "split", "unit_id seq", "Xs_T48", tables=("ev",),
       sql="SELECT split, unit_id, seq, Xs_T48 FROM ev ORDER BY md5(split || '|' || unit_id || '|' || seq || '|42'), split, unit_id, seq LIMIT 300")
def row_sample(spark: SparkSession, sf: str) -> DataFrame:
    return explain.explanation_sample(inputs.events(spark, sf))


def _attribution(spark: SparkSession, sf: str) -> DataFrame:
    """All four members and all sensors; tree members exactly, the polynomial by feature orders, averaged over sensors."""
    fitted = inputs.fit_lineitem(spark, sf)
    features = detection.TWIN_FEATURES
    train = tables.with_operating_conditions(fitted.scaled(sequenced=False), spark, sf)
    sample = explain.explanation_sample(tables.with_operating_conditions(fitted.scaled(), spark, sf)).persist(StorageLevel.MEMORY_AND_DISK)
    model = twin.fit_twin(train, "p_", twin.polynomial, features, inputs.SENSORS)
    parts = [
        explain.permutation_attribution(
            lambda d, t=t: twin.Twin("p_", features, {t: model.models[t]}).predict(d).withColumnRenamed(f"p_{t}", "prediction"), sample, features, "polynomial",
            targets=len(inputs.SENSORS))
        for t in inputs.SENSORS
    ]
    every = parts[0]
    for more in parts[1:]:
        every = every.unionByName(more)
    out = every.groupBy("model", "feature", "available_target_count", "sample_size", "explanation_type").agg(
        F.avg("mean_abs_shap").alias("mean_abs_shap"), F.sum("targets_explained").cast("int").alias("targets_explained"))
    for member, name in {"rf": "random_forest", "xgb": "xgboost", "lgbm": "lightgbm"}.items():
        out = out.unionByName(tree_attribution.tree_attribution(detection.fit_member(fitted, member), sample, name))
    return out


@query("L6", "model feature explanation_type", "sample_size targets_explained", "mean_abs_shap")
def attribution(spark: SparkSession, sf: str) -> DataFrame:
    return _attribution(spark, sf)


CORR_MODELS = " UNION ALL ".join(
    f"SELECT split AS model, '{f}' AS feature, abs(corr({f}, Xs_Ps30)) AS mean_abs_shap FROM li GROUP BY split" for f in ("Xs_T48", "Xs_Nf", "Xs_Wf"))


def correlation_importance(spark: SparkSession, sf: str) -> DataFrame:
    """Importance of sensors for one target by absolute correlation, one model per split."""
    li = tables.lineitem_telemetry(spark, sf, sequenced=False)
    names = ["Xs_T48", "Xs_Nf", "Xs_Wf"]
    wide = li.groupBy("split").agg(*[F.abs(safe_corr(n, "Xs_Ps30")).alias(n) for n in names])
    return wide.select(F.col("split").alias("model"), F.inline(F.array(*[
        F.struct(F.lit(n).alias("feature"), F.col(n).alias("mean_abs_shap")) for n in names])))


@query("L7", "feature", "", "mean_abs_shap", tables=("li",),
       sql=f"SELECT feature, avg(mean_abs_shap) AS mean_abs_shap FROM ({CORR_MODELS}) GROUP BY feature ORDER BY mean_abs_shap DESC, feature LIMIT 20")
def shared_importance(spark: SparkSession, sf: str) -> DataFrame:
    return explain.mean_importance(correlation_importance(spark, sf))


# ---------------------------------------------------------------- uncertainty

@query("M1", "split", "unit_id seq", "model_disagreement", sql="SELECT * FROM ag", tables=("ag",))
def disagreement(spark: SparkSession, sf: str) -> DataFrame:
    return uncertainty.model_disagreement(inputs.fit_lineitem(spark, sf).members(), S4)


def _disagreement(spark: SparkSession, sf: str, sequenced: bool = False) -> DataFrame:
    return uncertainty.model_disagreement(inputs.fit_lineitem(spark, sf).members(sequenced), S4)


@query("M2", "", "dev_rows_seen", "percentile_value max_value normalization_threshold", tables=("agq",),
       sql="SELECT n AS dev_rows_seen, q AS percentile_value, mx AS max_value, scale AS normalization_threshold FROM agq")
def disagreement_scale(spark: SparkSession, sf: str) -> DataFrame:
    return uncertainty.fit_disagreement_scale(_disagreement(spark, sf))


@query("M3", "split", "unit_id seq", "normalized_model_disagreement model_agreement_score agreement_normalization_threshold", sql="SELECT * FROM ag", tables=("ag",))
def agreement(spark: SparkSession, sf: str) -> DataFrame:
    fitted = inputs.fit_lineitem(spark, sf)
    fit_rows = uncertainty.model_disagreement(fitted.members(sequenced=False), S4)
    scale = uncertainty.fit_disagreement_scale(fit_rows).first()["normalization_threshold"]
    return uncertainty.model_agreement(uncertainty.model_disagreement(fitted.members(), S4), S4, scale)


@query("M4", "split", "event_id", "data_quality_score", tables=("gap",),
       sql="SELECT event_id, split, 1.0 - (CASE WHEN Xs_T48 IS NULL THEN 1 ELSE 0 END + CASE WHEN Xs_P2 IS NULL THEN 1 ELSE 0 END + 1)/4.0 AS data_quality_score FROM gap")
def quality(spark: SparkSession, sf: str) -> DataFrame:
    return uncertainty.data_quality(inputs.gappy_events(spark, sf), ["Xs_T48", "Xs_P2", "Xs_Nf", "W_alt"])


@query("M5", "split", "unit_id seq", "confidence_score uncertainty_score reliability_score", sql="SELECT * FROM wide", tables=("wide",))
def confidence(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.wide(spark, sf)


@query("M6", "split confidence_label uncertainty_label", "unit_id seq", "", tables=("evh",),
       sql="""SELECT *, CASE WHEN c >= 0.80 THEN 'High_Confidence' WHEN c >= 0.60 THEN 'Moderate_Confidence' WHEN c >= 0.40 THEN 'Low_Confidence' ELSE 'Very_Low_Confidence' END AS confidence_label,
       CASE WHEN 1.0 - c >= 0.60 THEN 'High_Uncertainty' WHEN 1.0 - c >= 0.40 THEN 'Moderate_Uncertainty' WHEN 1.0 - c >= 0.20 THEN 'Low_Uncertainty' ELSE 'Very_Low_Uncertainty' END AS uncertainty_label
       FROM (SELECT *, least(greatest(0.35*(1.0 - final_anomaly_score) + 0.25*(1.0 - gmm_context_id*0.17) + 0.25*anomaly_persistence_score + 0.15*1.0, 0.0), 1.0) AS c FROM evh)""")
def confidence_labels(spark: SparkSession, sf: str) -> DataFrame:
    df = inputs.health_events(spark, sf).withColumns({
        "model_agreement_score": 1.0 - F.col("final_anomaly_score"), "context_confidence": 1.0 - F.col("gmm_context_id") * 0.17,
        "data_quality_score": F.lit(1.0)})
    return uncertainty.confidence(df)


# ---------------------------------------------------------------- feedback

@query("N1", "alert_level feedback_label feedback_status", "feedback_id unit_id cycle context_id", "final_anomaly_score", tables=("fr",),
       sql="SELECT *, 'stored' AS feedback_status, row_number() OVER (ORDER BY cycle >= 15, ts, event_id) AS feedback_id FROM fr")
def stored(spark: SparkSession, sf: str) -> DataFrame:
    path = shared_folder(spark)
    records = inputs.feedback_records(spark, sf)
    bucket = ordering.order_buckets("ts", "event_id")
    feedback.store_feedback(spark, path, records.where("cycle < 15"), ["ts", "event_id"], bucket)
    return feedback.store_feedback(spark, path, records.where("cycle >= 15"), ["ts", "event_id"], bucket)


@query("N2", "feedback_status", "unit_id cycle context_id", "", sql="SELECT * FROM flast", tables=("flast",))
def latest(spark: SparkSession, sf: str) -> DataFrame:
    return feedback.latest_feedback(inputs.feedback_log(spark, sf))


MEMORY_SQL = """SELECT e.unit_id, e.cycle, e.split, e.gmm_context_id AS context_id, e.alert_level, e.final_anomaly_score, e.root_cause_pattern, CASE WHEN e.gmm_context_id < 3 THEN 'Xs_T48' ELSE 'Xs_P2' END AS top_sensor_1,
 'unknown' AS top_sensor_2, 'unknown' AS top_sensor_3, coalesce(f.feedback_status, 'no_feedback') AS feedback_status
 FROM evp e LEFT JOIN (SELECT * FROM flast WHERE {cond}) f ON e.unit_id = f.unit_id AND e.cycle = f.cycle AND e.gmm_context_id = f.context_id WHERE e.alert_level <> 'Normal'"""
MEMORY_TEXT = "split alert_level root_cause_pattern top_sensor_1 top_sensor_2 top_sensor_3 feedback_status"


def memory_rows(spark: SparkSession, sf: str) -> DataFrame:
    return inputs.with_pattern(anomaly.classify_severity(tables.events_telemetry(spark, sf, sequenced=False))).withColumn(
        "top_sensor_1", F.when(F.col("gmm_context_id") < 3, "Xs_T48").otherwise("Xs_P2"))


@query("N3", MEMORY_TEXT, "unit_id cycle context_id", "final_anomaly_score", sql=MEMORY_SQL.format(cond="feedback_status <> 'uncertain'"), tables=("evp", "flast"))
def memory(spark: SparkSession, sf: str) -> DataFrame:
    last = feedback.latest_feedback(inputs.feedback_log(spark, sf)).where("feedback_status <> 'uncertain'")
    return feedback.alert_memory(memory_rows(spark, sf), last)


@query("N4", MEMORY_TEXT, "unit_id cycle context_id", "final_anomaly_score", sql=MEMORY_SQL.format(cond="true"), tables=("evp", "flast"))
def refreshed_memory(spark: SparkSession, sf: str) -> DataFrame:
    old = feedback.alert_memory(memory_rows(spark, sf))
    return feedback.refresh_memory(old, feedback.latest_feedback(inputs.feedback_log(spark, sf)))


def adapted_sql(order: str = "feedback_id") -> str:
    run = f"sum(ln(f)) OVER (PARTITION BY context_id ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    return f"""WITH u AS (SELECT CASE WHEN CAST(context_id AS VARCHAR) IN (SELECT context_id FROM ethr WHERE context_id <> '3') THEN CAST(context_id AS VARCHAR) ELSE 'global' END AS context_id,
 {order}, CASE feedback_label WHEN 'rejected_false_alarm' THEN 1.02 WHEN 'missed_anomaly' THEN 0.98 ELSE 1.0 END AS f FROM flog),
 r AS (SELECT *, {run} AS s FROM u),
 m AS (SELECT context_id, arg_max(s, {order}) AS total, min(s) AS low, count(*) AS n FROM r GROUP BY context_id)
 SELECT t.context_id, coalesce(n, 0) AS feedback_records_used, """ + ", ".join(
        f"CASE WHEN n IS NULL THEN {x} ELSE greatest({x}*exp(total), 1e-9*exp(total - low)) END AS {x}" for x in ("watch", "warning", "critical")) + """
 FROM (SELECT * FROM ethr WHERE context_id <> '3') t LEFT JOIN m USING (context_id)"""


@query("N5", "context_id", "feedback_records_used", "watch warning critical", sql=adapted_sql(), tables=("ethr", "flog"))
def adapted(spark: SparkSession, sf: str) -> DataFrame:
    base = inputs.event_thresholds(spark, sf).where("context_id <> '3'")
    return feedback.adapt_thresholds(base, inputs.feedback_log(spark, sf))


@query("N6", "context_id", "feedback_records_used memory_rows with_feedback log_rows used_rows", "watch warning critical", tables=("ethr", "flog", "evp", "flast"),
       sql=f"""SELECT a.*, mm.*, l.n AS log_rows, l.n AS used_rows FROM ({adapted_sql()}) a, (SELECT count(*) AS n FROM flog) l, (SELECT count(*) AS memory_rows, count(*) FILTER (feedback_status <> 'no_feedback') AS with_feedback FROM ({MEMORY_SQL.format(cond='true')})) mm""")
def submitted(spark: SparkSession, sf: str) -> DataFrame:
    base = inputs.event_thresholds(spark, sf).where("context_id <> '3'")
    mem, thresholds, log = feedback.submit_feedback(
        spark, shared_folder(spark), inputs.feedback_records(spark, sf), feedback.alert_memory(memory_rows(spark, sf)), base,
        ["ts", "event_id"], ordering.order_buckets("ts", "event_id"))
    totals = mem.agg(F.count(F.lit(1)).alias("memory_rows"), F.count_if(F.col("feedback_status") != "no_feedback").alias("with_feedback"))
    marks = log.agg(F.count(F.lit(1)).alias("log_rows"), F.count_if(F.col("feedback_status") == feedback.USED).alias("used_rows"))
    return thresholds.crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(marks))
