"""The same telemetry tables in DuckDB SQL, as named common table expressions."""

from __future__ import annotations

SENSORS = ("Xs_T48", "Xs_Ps30", "Xs_Nf", "Xs_Wf")
MEMBERS = ("rf", "xgb", "lgbm")
W = "PARTITION BY split, unit_id ORDER BY seq"
W5 = f"({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
DESC_MAINT = "'Not generated by this component'"


def each(template: str, names=SENSORS, sep: str = ", ") -> str:
    return sep.join(template.format(s=n) for n in names)


def clip01(x: str) -> str:
    return f"least(greatest(coalesce({x}, 0.0), 0.0), 1.0)"


def alert(x: str) -> str:
    return f"CASE WHEN {x} >= 0.85 THEN 'Critical' WHEN {x} >= 0.65 THEN 'Warning' WHEN {x} >= 0.40 THEN 'Watch' ELSE 'Normal' END"


def state(x: str) -> str:
    return f"CASE WHEN {x} >= 85 THEN 'Healthy' WHEN {x} >= 65 THEN 'Degrading' WHEN {x} >= 40 THEN 'Warning' ELSE 'Critical' END"


def fixed(x: str, d: int) -> str:
    u = float(10 ** d)
    return f"printf('%.{d}f', floor(({x})*{u} + 0.500000001)/{u} + 0.0)"


def case(x: str, mapping: dict, default: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items())
    return f"CASE {x} {whens} ELSE {default} END"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPLIT = "CASE WHEN {} % 3 = 2 THEN 'test' ELSE 'dev' END"
HEALTH_BODY = f"""
SELECT *, 100.0 - 60.0*final_anomaly_score - 25.0*residual_trend_score - 15.0*anomaly_persistence_score AS health_index
FROM (SELECT *, avg(final_anomaly_score) OVER {W5} AS residual_trend_score,
      avg(CASE WHEN final_anomaly_score >= 0.40 THEN 1.0 ELSE 0.0 END) OVER {W5} AS anomaly_persistence_score FROM {{src}})
"""
PATTERN_OF_CONTEXT = {
    0: "thermal_response_deviation", 1: "pressure_system_deviation", 2: "rotational_speed_deviation",
    3: "flow_or_fuel_related_deviation", 4: "multisensor_residual_deviation",
}
PATTERN_SQL = "CASE gmm_context_id " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in PATTERN_OF_CONTEXT.items()) + " END"


def _top3() -> str:
    """Ranking of the four absolute residuals by share, ties by position."""
    shares = ", ".join(
        f"{{'neg': -(abs_residual_{s}/greatest(total_abs_residual, 1e-12)), 'pos': {i}, 'sensor': '{s}'}}" for i, s in enumerate(SENSORS))
    return f"list_sort([{shares}])"


CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "ev0": ((), f"""SELECT {SPLIT.format('user_id')} AS split, user_id AS unit_id,
        CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS INTEGER) AS cycle, ts, event_id,
        CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 ELSE -1 END AS gmm_context_id,
        value AS Xs_T48, least(value/200.0, 1.0) AS final_anomaly_score FROM events"""),
    "ev": (("ev0",), "SELECT *, row_number() OVER (PARTITION BY unit_id ORDER BY ts, event_id) AS seq FROM ev0"),
    "evs": (("ev",), f"SELECT *, {alert('final_anomaly_score')} AS alert_level FROM ev"),
    "evh0": (("evs",), HEALTH_BODY.format(src="evs")),
    "evh": (("evh0",), f"SELECT *, health_index AS remaining_health_percentage, {state('health_index')} AS health_state FROM evh0"),
    "evp": (("evh",), f"SELECT *, {PATTERN_SQL} AS root_cause_pattern FROM evh"),
    "ew0": (("evs",), f"SELECT *, coalesce(final_anomaly_score - lag(final_anomaly_score) OVER ({W}), 0.0) AS slope FROM evs"),
    "ew1": (("ew0",), f"""SELECT *, avg(final_anomaly_score) OVER {W5} AS rolling_anomaly_mean, avg(slope) OVER {W5} AS rolling_anomaly_slope FROM ew0"""),
    "ew2": (("ew1",), """SELECT *, least(greatest(rolling_anomaly_slope, 0.0), 1.0) AS positive_rolling_anomaly_slope,
        least(greatest(0.70*rolling_anomaly_mean + 0.30*least(greatest(rolling_anomaly_slope, 0.0), 1.0), 0.0), 1.0) AS early_warning_score FROM ew1"""),
    "ew": (("ew2",), """SELECT *, CASE WHEN early_warning_score >= 0.65 THEN 'Increasing_Risk' WHEN early_warning_score >= 0.40 THEN 'Watch_Risk' ELSE 'Stable' END AS early_warning_label FROM ew2"""),
    "evt0": (("evh",), f"SELECT *, coalesce(health_index - lag(health_index) OVER ({W}), 0.0) AS health_index_delta FROM evh"),
    "evt1": (("evt0",), f"""SELECT *, avg(health_index) OVER {W5} AS health_index_rolling_mean,
        avg(greatest(-health_index_delta, 0.0)) OVER {W5} AS health_deterioration_score_raw FROM evt0"""),
    "evt": (("evt1",), """SELECT *, least(health_deterioration_score_raw / greatest((SELECT max(health_deterioration_score_raw) FROM evt1), 1e-12), 1.0) AS health_deterioration_score,
        CASE WHEN health_index_delta < -2 THEN 'Deteriorating' WHEN health_index_delta > 2 THEN 'Recovering' ELSE 'Stable' END AS health_trend_label FROM evt1"""),
    "eva": (("evt",), """SELECT *, CASE WHEN health_state = 'Critical' OR alert_level = 'Critical' THEN 'High'
        WHEN health_state = 'Warning' OR alert_level = 'Warning' THEN 'Medium'
        WHEN health_state = 'Degrading' OR alert_level = 'Watch' OR health_trend_label = 'Deteriorating' THEN 'Low' ELSE 'Routine' END AS inspection_priority,
        CASE WHEN health_state = 'Critical' OR alert_level = 'Critical' THEN 'Immediate inspection focus required'
        WHEN health_state = 'Warning' OR alert_level = 'Warning' THEN 'Inspect affected subsystem indicators'
        WHEN health_trend_label = 'Deteriorating' THEN 'Track deteriorating health trend'
        WHEN health_state = 'Degrading' OR alert_level = 'Watch' THEN 'Monitor degradation indicators' ELSE 'Routine monitoring' END AS inspection_focus FROM evt"""),
    "etr0": (("evp",), f"""SELECT *, avg(final_anomaly_score) OVER {W5} AS anomaly_score_rolling_mean,
        coalesce(final_anomaly_score - lag(final_anomaly_score) OVER ({W}), 0.0) AS anomaly_score_delta,
        coalesce(health_index - lag(health_index) OVER ({W}), 0.0) AS health_index_delta,
        avg(CASE WHEN final_anomaly_score >= 0.40 THEN 1.0 ELSE 0.0 END) OVER {W5} AS anomaly_persistence_score_temporal FROM evp"""),
    "etr": (("etr0",), """SELECT *, CASE WHEN anomaly_persistence_score_temporal >= 0.80 AND health_index_delta < -1.0 THEN 'Persistent_Deterioration'
        WHEN anomaly_score_delta > 0.05 AND health_index_delta < 0.0 THEN 'Increasing_Anomaly'
        WHEN anomaly_persistence_score_temporal >= 0.40 THEN 'Intermittent_Anomaly'
        WHEN anomaly_score_delta < -0.05 AND health_index_delta >= 0.0 THEN 'Recovering_Behaviour' ELSE 'Stable_Behaviour' END AS temporal_pattern FROM etr0"""),
    "rec": (("evp",), """SELECT p.*, (SELECT count(DISTINCT q.cycle) FROM evp q WHERE q.split = p.split AND q.unit_id = p.unit_id
        AND q.root_cause_pattern = p.root_cause_pattern AND q.cycle BETWEEN p.cycle - 20 AND p.cycle - 1) AS similar_pattern_count_recent FROM evp p"""),
    "li0": ((), f"""SELECT {SPLIT.format('l_suppkey')} AS split, l_suppkey AS unit_id,
        CAST((year(l_shipdate) - 1995)*12 + month(l_shipdate) AS INTEGER) AS cycle, l_shipdate AS ts, l_orderkey, l_linenumber, l_partkey,
        CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS gmm_context_id,
        CASE l_linestatus WHEN 'F' THEN 0 ELSE 1 END AS kmeans_context_id,
        l_quantity AS Xs_T48, l_extendedprice AS Xs_Ps30, l_discount AS Xs_Nf, l_tax AS Xs_Wf,
        row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq FROM lineitem"""),
    "li": (("li0",), "SELECT * FROM li0"),
    "stats": (("li",), "SELECT " + each("avg({s}) AS m_{s}, stddev_pop({s}) AS s_{s}") + " FROM li WHERE split = 'dev'"),
    "liz": (("li", "stats"), "SELECT li.* REPLACE (" + each("(li.{s} - m_{s})/s_{s} AS {s}") + ") FROM li, stats"),
    "p_rf": (("liz",), "SELECT gmm_context_id, kmeans_context_id, " + each("avg({s}) AS rf_predicted_{s}") + " FROM liz WHERE split = 'dev' GROUP BY ALL"),
    "p_xgb": (("liz",), "SELECT gmm_context_id, " + each("avg({s}) AS xgb_predicted_{s}") + " FROM liz WHERE split = 'dev' GROUP BY ALL"),
    "p_lgbm": (("liz",), "SELECT kmeans_context_id, " + each("avg({s}) AS lgbm_predicted_{s}") + " FROM liz WHERE split = 'dev' GROUP BY ALL"),
    "mem": (("liz", "p_rf", "p_xgb", "p_lgbm"), """SELECT * FROM liz LEFT JOIN p_rf USING (gmm_context_id, kmeans_context_id)
        LEFT JOIN p_xgb USING (gmm_context_id) LEFT JOIN p_lgbm USING (kmeans_context_id)"""),
    "ens": (("mem",), "SELECT *, " + each("(1.0/3)*rf_predicted_{s} + (1.0/3)*xgb_predicted_{s} + (1.0/3)*lgbm_predicted_{s} AS ensemble_predicted_{s}") + " FROM mem"),
    "res0": (("ens",), "SELECT *, " + each("{s} - ensemble_predicted_{s} AS residual_{s}, abs({s} - ensemble_predicted_{s}) AS abs_residual_{s}") + " FROM ens"),
    "res": (("res0",), "SELECT *, " + each("abs_residual_{s}", sep=" + ") + " AS total_abs_residual FROM res0"),
    "thr": (("res",), """SELECT CAST(gmm_context_id AS VARCHAR) AS context_id, quantile_cont(total_abs_residual, 0.90) AS watch,
        quantile_cont(total_abs_residual, 0.95) AS warning, quantile_cont(total_abs_residual, 0.99) AS critical, count(*) AS rows_used
        FROM res WHERE split = 'dev' GROUP BY 1 UNION ALL
        SELECT 'global', quantile_cont(total_abs_residual, 0.90), quantile_cont(total_abs_residual, 0.95), quantile_cont(total_abs_residual, 0.99), count(*)
        FROM res WHERE split = 'dev'"""),
    "sc": (("res", "thr"), """SELECT res.*, coalesce(t.watch, g.watch) AS watch_threshold, coalesce(t.warning, g.warning) AS warning_threshold,
        coalesce(t.critical, g.critical) AS critical_threshold, least(total_abs_residual/greatest(coalesce(t.critical, g.critical), 1e-9), 1.0) AS residual_anomaly_score,
        CASE WHEN total_abs_residual >= coalesce(t.critical, g.critical) THEN 'Critical' WHEN total_abs_residual >= coalesce(t.warning, g.warning) THEN 'Warning'
        WHEN total_abs_residual >= coalesce(t.watch, g.watch) THEN 'Watch' ELSE 'Normal' END AS residual_alert_level
        FROM res LEFT JOIN thr t ON t.context_id = CAST(gmm_context_id AS VARCHAR) CROSS JOIN (SELECT * FROM thr WHERE context_id = 'global') g"""),
    "rng": (("res",), """SELECT min(abs_residual_Xs_Nf) AS nf0, max(abs_residual_Xs_Nf) - min(abs_residual_Xs_Nf) AS nf1, min(abs_residual_Xs_T48) AS t0,
        max(abs_residual_Xs_T48) - min(abs_residual_Xs_T48) AS t1, min(abs_residual_Xs_Wf) AS wf0, max(abs_residual_Xs_Wf) - min(abs_residual_Xs_Wf) AS wf1 FROM res"""),
    "det0": (("sc", "rng"), f"""SELECT sc.*, {clip01('(abs_residual_Xs_Nf - nf0)/nf1')} AS iforest_anomaly_score,
        {clip01('(abs_residual_Xs_T48 - t0)/t1')} AS mahalanobis_score, {clip01('(abs_residual_Xs_Wf - wf0)/wf1')} AS lstm_autoencoder_score FROM sc, rng"""),
    "fu0": (("det0",), """SELECT *, CASE WHEN residual_alert_level <> 'Normal' THEN 1 ELSE 0 END AS residual_vote,
        CASE WHEN iforest_anomaly_score >= 0.9 THEN 1 ELSE 0 END AS iforest_anomaly_label,
        CASE WHEN mahalanobis_score >= 0.9 THEN 1 ELSE 0 END AS mahalanobis_anomaly_label,
        CASE WHEN lstm_autoencoder_score >= 0.9 THEN 1 ELSE 0 END AS lstm_autoencoder_label,
        0.35*residual_anomaly_score AS residual_contribution, 0.20*iforest_anomaly_score AS iforest_contribution,
        0.20*mahalanobis_score AS mahalanobis_contribution, 0.25*lstm_autoencoder_score AS lstm_autoencoder_contribution FROM det0"""),
    "fu1": (("fu0",), """SELECT *, residual_contribution + iforest_contribution + mahalanobis_contribution + lstm_autoencoder_contribution AS final_anomaly_score,
        residual_vote + iforest_anomaly_label + mahalanobis_anomaly_label + lstm_autoencoder_label AS detector_agreement_count,
        greatest(residual_contribution, iforest_contribution, mahalanobis_contribution, lstm_autoencoder_contribution) AS top_part FROM fu0"""),
    "fu": (("fu1",), f"""SELECT *, detector_agreement_count/4.0 AS detector_agreement_ratio, {alert('final_anomaly_score')} AS alert_level,
        CASE WHEN residual_contribution = top_part THEN 'residual' WHEN iforest_contribution = top_part THEN 'iforest'
        WHEN mahalanobis_contribution = top_part THEN 'mahalanobis' ELSE 'lstm_autoencoder' END AS dominant_detector FROM fu1"""),
    "hi": (("fu",), HEALTH_BODY.format(src="fu")),
    "hs": (("hi",), f"SELECT *, health_index AS remaining_health_percentage, {state('health_index')} AS health_state FROM hi"),
    "top": (("hs",), f"SELECT *, {_top3()} AS ranked FROM hs"),
    "rc0": (("top",), "SELECT *, " + ", ".join(
        f"CASE WHEN total_abs_residual <= 1e-12 THEN 'none' ELSE ranked[{i}].sensor END AS top_sensor_{i}, "
        f"CASE WHEN total_abs_residual <= 1e-12 THEN 0.0 ELSE -ranked[{i}].neg END AS share_{i}" for i in (1, 2, 3)) + " FROM top"),
    "rc1": (("rc0",), """SELECT *, round(share_1, 6) AS contribution_1, round(share_2, 6) AS contribution_2, round(share_3, 6) AS contribution_3,
        round(share_1 + share_2 + share_3, 6) AS top3_contribution_sum,
        list_contains([top_sensor_1, top_sensor_2, top_sensor_3], 'Xs_T48') AS has_t, list_contains([top_sensor_1, top_sensor_2, top_sensor_3], 'Xs_Ps30') AS has_p,
        list_contains([top_sensor_1, top_sensor_2, top_sensor_3], 'Xs_Nf') AS has_n, list_contains([top_sensor_1, top_sensor_2, top_sensor_3], 'Xs_Wf') AS has_w FROM rc0"""),
    "rc2": (("rc1",), """SELECT *, CASE WHEN has_t AND has_p THEN 'hot_section_pressure_thermal_deviation'
        WHEN has_w AND has_t THEN 'flow_thermal_response_deviation' WHEN has_w AND has_p THEN 'flow_pressure_response_deviation'
        WHEN has_n AND has_p THEN 'rotational_pressure_deviation' WHEN has_n AND has_t THEN 'rotational_thermal_response_deviation'
        WHEN has_t THEN 'thermal_response_deviation' WHEN has_p THEN 'pressure_system_deviation' WHEN has_w THEN 'flow_or_fuel_related_deviation'
        WHEN has_n THEN 'rotational_speed_deviation' ELSE 'multisensor_residual_deviation' END AS root_cause_pattern FROM rc1"""),
    "rc": (("rc2",), """SELECT *, CASE root_cause_pattern
        WHEN 'hot_section_pressure_thermal_deviation' THEN 'Inspect hot-section temperature and pressure response consistency, especially HPT/LPT-related signal behavior.'
        WHEN 'flow_thermal_response_deviation' THEN 'Inspect fuel/flow signal consistency and thermal response behavior.'
        WHEN 'flow_pressure_response_deviation' THEN 'Inspect fuel/flow signal consistency and pressure response behavior.'
        WHEN 'rotational_pressure_deviation' THEN 'Inspect rotational-speed signal consistency and pressure response behavior.'
        WHEN 'rotational_thermal_response_deviation' THEN 'Inspect rotational-speed signal consistency and thermal response behavior.'
        WHEN 'thermal_response_deviation' THEN 'Inspect temperature response sensors and heat-related signal patterns.'
        WHEN 'pressure_system_deviation' THEN 'Inspect pressure sensor behavior and compression-flow consistency.'
        WHEN 'flow_or_fuel_related_deviation' THEN 'Inspect fuel-flow-related signal consistency.'
        WHEN 'rotational_speed_deviation' THEN 'Inspect fan/core rotational-speed signal consistency.'
        ELSE 'Inspect the top contributing measured sensor channels.' END AS inspection_focus FROM rc2"""),
    "ag0": (("rc",), "SELECT *, (" + each(
        "sqrt((power(rf_predicted_{s} - (rf_predicted_{s}+xgb_predicted_{s}+lgbm_predicted_{s})/3, 2) + power(xgb_predicted_{s} - (rf_predicted_{s}+xgb_predicted_{s}+lgbm_predicted_{s})/3, 2)"
        " + power(lgbm_predicted_{s} - (rf_predicted_{s}+xgb_predicted_{s}+lgbm_predicted_{s})/3, 2))/3)", sep=" + ") + ")/4 AS model_disagreement FROM rc"),
    "agq": (("ag0",), """SELECT quantile_cont(model_disagreement, 0.99) AS q, max(model_disagreement) AS mx, count(*) AS n,
        CASE WHEN quantile_cont(model_disagreement, 0.99) > 1e-12 THEN quantile_cont(model_disagreement, 0.99) WHEN max(model_disagreement) > 1e-12 THEN max(model_disagreement) ELSE 1.0 END AS scale
        FROM ag0 WHERE split = 'dev'"""),
    "ag": (("ag0", "agq"), f"""SELECT ag0.*, {clip01('model_disagreement/greatest(scale, 1e-12)')} AS normalized_model_disagreement,
        1.0 - {clip01('model_disagreement/greatest(scale, 1e-12)')} AS model_agreement_score, scale AS agreement_normalization_threshold,
        1.0 - kmeans_context_id*0.25 AS context_confidence, 1.0 AS data_quality_score FROM ag0, agq"""),
    "cf0": (("ag",), f"""SELECT *, {clip01('0.35*model_agreement_score + 0.25*context_confidence + 0.25*anomaly_persistence_score + 0.15*data_quality_score')} AS confidence_score FROM ag"""),
    "wide": (("cf0",), f"""SELECT *, 1.0 - confidence_score AS uncertainty_score,
        {clip01('0.50*confidence_score + 0.30*model_agreement_score + 0.20*data_quality_score')} AS reliability_score FROM cf0"""),
    "sv": (("evp",), """SELECT split, unit_id, cycle, seq, gmm_context_id, -1 AS kmeans_context_id, final_anomaly_score, alert_level, health_index, remaining_health_percentage,
        health_state, root_cause_pattern, alert_level <> 'Normal' AS anomaly_detected,
        CASE WHEN alert_level <> 'Normal' THEN 'Anomaly_Detected' ELSE 'No_Anomaly' END AS anomaly_status,
        CASE WHEN gmm_context_id < 3 THEN 'Xs_T48' ELSE 'Xs_P2' END AS top_sensor_1, 'none' AS top_sensor_2, 'none' AS top_sensor_3,
        0.0 AS contribution_1, 0.0 AS contribution_2, 0.0 AS contribution_3, 'No inspection focus available.' AS inspection_focus,
        'No anomaly explanation available.' AS explanation_text, 0.0 AS model_agreement_score, 0.0 AS context_confidence,
        1.0 - final_anomaly_score/2.0 AS confidence_score, final_anomaly_score/2.0 AS uncertainty_score, 0.0 AS reliability_score,
        'no_feedback' AS feedback_status FROM evp"""),
    "fr": (("ev0",), f"""SELECT event_id, ts, unit_id, cycle, gmm_context_id AS context_id, {alert('final_anomaly_score')} AS alert_level, final_anomaly_score,
        {PATTERN_SQL} AS root_cause_pattern,
        CASE event_id % 4 WHEN 0 THEN 'accepted_alert' WHEN 1 THEN 'rejected_false_alarm' WHEN 2 THEN 'missed_anomaly' ELSE 'uncertain' END AS feedback_label, '' AS operator_note FROM ev0"""),
    "flog": (("fr",), "SELECT row_number() OVER (ORDER BY ts, event_id) AS feedback_id, ts AS timestamp_utc, *, 'stored' AS feedback_status FROM fr"),
    "flast": (("flog",), "SELECT unit_id, cycle, context_id, arg_max(feedback_label, feedback_id) AS feedback_status FROM flog GROUP BY ALL"),
    "ethr": (("ev0",), """SELECT CAST(gmm_context_id AS VARCHAR) AS context_id, quantile_cont(Xs_T48, 0.90) AS watch, quantile_cont(Xs_T48, 0.95) AS warning,
        quantile_cont(Xs_T48, 0.99) AS critical, count(*) AS rows_used FROM ev0 WHERE split = 'dev' GROUP BY 1 UNION ALL
        SELECT 'global', quantile_cont(Xs_T48, 0.90), quantile_cont(Xs_T48, 0.95), quantile_cont(Xs_T48, 0.99), count(*) FROM ev0 WHERE split = 'dev'"""),
    "gap": ((), f"""SELECT event_id, {SPLIT.format('user_id')} AS split, CASE WHEN event_id % 23 = 0 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS unit_id,
        CASE WHEN event_id % 29 = 0 THEN NULL ELSE CAST(day(ts) AS VARCHAR) END AS cycle,
        CASE WHEN event_id % 17 = 0 OR event_id % 19 = 0 OR event_id % 31 = 0 THEN NULL ELSE value END AS Xs_T48,
        CASE WHEN user_id % 3 = 2 THEN NULL ELSE value*2 END AS Xs_P2, CAST(NULL AS DOUBLE) AS Xs_Nf, 3.5 AS W_alt,
        CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS event_type FROM events"""),
    "gap1": (("gap",), """SELECT gap.* REPLACE (coalesce(gap.Xs_T48, m.a) AS Xs_T48, coalesce(gap.Xs_P2, m.b) AS Xs_P2)
        FROM gap JOIN (SELECT split, median(Xs_T48) AS a, median(Xs_P2) AS b FROM gap GROUP BY split) m ON gap.split = m.split"""),
    "gap2": (("gap1",), """SELECT * REPLACE (coalesce(Xs_T48, (SELECT median(Xs_T48) FROM gap1), 0.0) AS Xs_T48,
        coalesce(Xs_P2, (SELECT median(Xs_P2) FROM gap1), 0.0) AS Xs_P2, coalesce(Xs_Nf, 0.0) AS Xs_Nf) FROM gap1"""),
}


def with_tables(body: str, *names: str) -> str:
    """``body`` preceded by the named tables and everything they are built from."""
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order) + "\n" + body


#: Principal directions of the registered sequence models.
DIRECTIONS = 2


def sequence_errors(value: str, table: str, size: int = 20, squarings: int = 30) -> str:
    """Tables up to ``se``: the reconstruction error of trailing windows of one standardised column.

    A leading direction is what repeated squaring of the covariance, scaled to a trace of 1, leaves;
    it is taken out of the covariance before the next one.
    """
    square = (
        "list_transform(m, lambda a: list_transform(range(1, {n} + 1), lambda j: list_sum(list_transform(range(1, {n} + 1), lambda k: a[k] * m[k][j]))))"
    ).format(n=size)
    trace = f"list_sum(list_transform(range(1, {size} + 1), lambda i: m[i][i]))"
    steps = [f"""sz AS (SELECT split, unit_id, seq, ({value} - m)/s AS z FROM {table}, (SELECT avg({value}) AS m, stddev_pop({value}) AS s FROM {table} WHERE split = 'dev')),
 sw AS (SELECT split, unit_id, seq, CASE WHEN seq >= {size} THEN list(z) OVER ({W} ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW) END AS x FROM sz),
 sl AS (SELECT unit_id, seq, j, x[j] AS v FROM (SELECT unit_id, seq, x, unnest(range(1, {size} + 1)) AS j FROM sw WHERE split = 'dev' AND x IS NOT NULL)),
 sm AS (SELECT list(u ORDER BY j) AS mu FROM (SELECT j, avg(v) AS u FROM sl GROUP BY j)),
 sd AS (SELECT list_transform(range(1, {size} + 1), lambda j: x[j] - mu[j]) AS d FROM sw, sm WHERE split = 'dev' AND x IS NOT NULL),
 sc AS (SELECT i, list(c ORDER BY j) AS r FROM (SELECT i, j, avg(d[i] * d[j]) AS c FROM sd, range(1, {size} + 1) a(i), range(1, {size} + 1) b(j) GROUP BY i, j) GROUP BY i),
 sp0 AS MATERIALIZED (SELECT list(r ORDER BY i) AS m FROM sc)"""]
    for q in range(DIRECTIONS):
        before = f"sp{q}"
        for k in range(squarings):
            steps.append(f"sq{q}_{k} AS MATERIALIZED (SELECT list_transform(m, lambda a: list_transform(a, lambda v: v / {trace})) AS m FROM (SELECT {square} AS m FROM {before}))")
            before = f"sq{q}_{k}"
        steps.append(
            f"sb{q} AS MATERIALIZED (SELECT list_transform(range(1, {size} + 1), lambda i: m[i][t] / sqrt(m[t][t])) AS u FROM (SELECT m, list_position(g, list_max(g)) AS t FROM "
            f"(SELECT m, list_transform(range(1, {size} + 1), lambda i: m[i][i]) AS g FROM {before})))")
        steps.append(f"sv{q} AS MATERIALIZED (SELECT list_transform(u, lambda v: v / sqrt(list_sum(list_transform(u, lambda w: w * w)))) AS u FROM sb{q})")
        # C - uu'C
        steps.append(
            f"sp{q + 1} AS MATERIALIZED (SELECT list_transform(range(1, {size} + 1), lambda i: list_transform(range(1, {size} + 1), lambda j: m[i][j] - u[i] * "
            f"list_sum(list_transform(range(1, {size} + 1), lambda k: u[k] * m[k][j])))) AS m FROM sp{q}, sv{q})")
    dots = " - ".join(f"power(list_sum(list_transform(range(1, {size} + 1), lambda j: d[j] * sv{q}.u[j])), 2)" for q in range(DIRECTIONS))
    steps.append(
        f"sx AS (SELECT split, unit_id, seq, CASE WHEN x IS NOT NULL THEN list_transform(range(1, {size} + 1), lambda j: x[j] - mu[j]) END AS d FROM sw, sm)")
    steps.append(
        f"se AS (SELECT split, unit_id, seq, CASE WHEN d IS NULL THEN 0 ELSE 1 END AS ready, "
        f"CASE WHEN d IS NULL THEN 0.0 ELSE (list_sum(list_transform(d, lambda v: v * v)) - {dots}) / {size} END AS err FROM sx, {', '.join(f'sv{q}' for q in range(DIRECTIONS))})")
    return ",\n ".join(steps)
