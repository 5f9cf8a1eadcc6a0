"""Results worked out by hand."""

from __future__ import annotations

import math

import pytest
from conftest import rows
from pyspark.sql import functions as F

from fleetpulse.functions import channels
from fleetpulse.functions.exprs import fixed, normalized, safe_divide
from fleetpulse.operators import anomaly, contexts, evaluation, explain, health, prepare, reasoning, serving, twin, uncertainty
from fleetpulse.sources import tables

KEY = "split string, unit_id int, seq long, cycle int"


def unit(spark, values, name, extra=""):
    data = [("dev", 1, i + 1, i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"{KEY}, {name} double")


def test_rolling(spark):
    out = prepare.rolling_features(unit(spark, [1, 2, 4], "x"), ["x"])
    got = rows(out.select("seq", *[F.round(c, 5) for c in prepare.rolling_names("x")]), "seq")
    assert got == [(1, 1.0, 0.0, 0.0), (2, 1.5, 0.70711, 1.0), (3, 2.33333, 1.52753, 2.0)]


def test_early_warning_and_health(spark):
    df = unit(spark, [0.2, 0.6], "final_anomaly_score")
    ew = rows(anomaly.early_warning(df).select("seq", F.round("early_warning_score", 9), "early_warning_label", F.round("rolling_anomaly_slope", 9)), "seq")
    assert ew == [(1, 0.14, "Stable", 0.0), (2, 0.34, "Stable", 0.2)]
    h = rows(health.health_state(health.health_index(df)).select("seq", F.round("health_index", 9), "health_state"), "seq")
    assert h == [(1, 83.0, "Degrading"), (2, 46.5, "Warning")]


def test_unseen_context_uses_global_thresholds(spark):
    t = spark.createDataFrame([("global", 0.1, 0.15, 0.4), ("0", 0.05, 0.06, 0.07)], "context_id string, watch double, warning double, critical double")
    df = spark.createDataFrame([(0.2, 9)], "total_abs_residual double, gmm_context_id int")
    r = anomaly.score_residuals(df, t).first()
    assert (r["residual_anomaly_score"], r["residual_alert_level"]) == (0.5, "Warning")
    anomaly.check_thresholds(t)
    with pytest.raises(ValueError):
        anomaly.check_thresholds(t.where("context_id <> 'global'"))


def test_fusion(spark):
    df = spark.createDataFrame([(1.0, 0.5, 0.0, 0.4, "Watch", 1, 0, None)], """residual_anomaly_score double, iforest_anomaly_score double,
        mahalanobis_score double, lstm_autoencoder_score double, residual_alert_level string, iforest_anomaly_label int,
        mahalanobis_anomaly_label int, lstm_autoencoder_label int""")
    r = anomaly.fuse(df).first()
    assert abs(r["final_anomaly_score"] - 0.55) < 1e-12
    assert (r["alert_level"], r["dominant_detector"], r["detector_agreement_count"], r["detector_agreement_ratio"]) == ("Watch", "residual", 2, 0.5)
    two = anomaly.fuse(df, {"residual": 0.5, "mahalanobis": 0.5}).first()
    assert two["final_anomaly_score"] == 0.5 and two["detector_agreement_ratio"] == 0.5
    with pytest.raises(ValueError):
        normalized({"a": -1.0})


def test_top_three(spark):
    df = spark.createDataFrame([(2.0, 6.0, 0.0, 2.0), (0.0, 0.0, 0.0, 0.0)], ", ".join(f"abs_residual_{n} double" for n in "abcd"))
    first, zero = reasoning.rank_sensors(df, df.columns, 3).orderBy(F.desc("total_abs_residual")).collect()
    assert [first[f"top_sensor_{i}"] for i in (1, 2, 3)] == ["b", "a", "d"]
    assert [first[f"contribution_{i}"] for i in (1, 2, 3)] == [0.6, 0.2, 0.2] and first["top3_contribution_sum"] == 1.0
    assert [zero[f"top_sensor_{i}"] for i in (1, 2, 3)] == ["none"] * 3 and zero["contribution_1"] == 0.0


def test_fewer_sensors_than_ranks(spark):
    df = spark.createDataFrame([(2.0, 1.0)], "abs_residual_Xs_T48 double, abs_residual_Xs_Nf double")
    r = explain.sensor_ranking(df, df.columns).first()
    assert (r["rank_2_sensor"], r["rank_3_sensor"], r["rank_5_contribution"]) == ("Xs_Nf", "none", 0.0)


@pytest.mark.parametrize("block", [21, 4096])
def test_recurrence(spark, block):
    data = [("dev", 1, c, "p") for c in (1, 1, 5, 25, 26)]
    df = spark.createDataFrame(data, "split string, unit_id int, cycle int, root_cause_pattern string")
    out = reasoning.recurrence(df, block_cycles=block)
    assert rows(out.select("cycle", "similar_pattern_count_recent"), "cycle") == [(1, 0), (1, 0), (5, 1), (25, 1), (26, 1)]


def test_strongest_temporal_pattern_wins(spark):
    df = spark.createDataFrame([(0.1, -2.0, 0.8), (0.1, -0.5, 0.8), (-0.1, 1.0, 0.0), (0.0, 0.0, 0.0)], "a double, h double, p double")
    got = [r[0] for r in df.select(reasoning.temporal_pattern("a", "h", "p")).collect()]
    assert got == ["Persistent_Deterioration", "Increasing_Anomaly", "Recovering_Behaviour", "Stable_Behaviour"]


def test_recurrence_keeps_rows_without_a_pattern(spark):
    df = spark.createDataFrame([("dev", 1, 1, None), ("dev", 1, 2, "p")], "split string, unit_id int, cycle int, root_cause_pattern string")
    assert rows(reasoning.recurrence(df).select("cycle", "similar_pattern_count_recent", "root_cause_recurrence_status"), "cycle") == [
        (1, 0, "New_or_Isolated"), (2, 0, "New_or_Isolated")]


@pytest.mark.parametrize("sensors, pattern", [
    (("Xs_T48", "Xs_Ps30", "Xs_Nf"), "hot_section_pressure_thermal_deviation"),
    (("Xs_T24", "Xs_P21", "Xs_Nc"), "thermal_pressure_rotational_coupled_deviation"),
    (("Xs_T24", "Xs_P15", "none"), "temperature_pressure_instability"),
    (("Xs_Wf", "Xs_T30", "none"), "flow_thermal_response_deviation"),
    (("Xs_Wf", "Xs_P2", "none"), "flow_pressure_response_deviation"),
    (("Xs_Nf", "Xs_P2", "none"), "rotational_pressure_deviation"),
    (("Xs_Nf", "Xs_T30", "none"), "rotational_thermal_response_deviation"),
    (("Xs_T50", "none", "none"), "thermal_response_deviation"),
    (("Xs_P2", "none", "none"), "pressure_system_deviation"),
    (("Xs_Wf", "none", "none"), "flow_or_fuel_related_deviation"),
    (("Xs_Nc", "none", "none"), "rotational_speed_deviation"),
    (("Xv_bpr", "none", "none"), "efficiency_related_deviation"),
    (("none", "none", "none"), "multisensor_residual_deviation"),
])
def test_patterns_from_text_and_from_known_names(spark, sensors, pattern):
    df = spark.createDataFrame([sensors], "a string, b string, c string")
    for known in (None, list(sensors)):
        r = reasoning.add_pattern(df, ["a", "b", "c"], known).first()
        assert r["root_cause_pattern"] == pattern
        assert r["inspection_focus"] == reasoning.PATTERN_FOCUS[pattern]


@pytest.mark.parametrize("sensor, label", [
    ("Xs_T48", "hot_section_thermal_subsystem"), ("Xs_T24", "compressor_thermal_subsystem"), ("Xs_Ps30", "core_pressure_subsystem"),
    ("Xs_P15", "fan_lpc_pressure_subsystem"), ("Xs_Wf", "fuel_flow_subsystem"), ("Xs_Nf", "fan_rotational_subsystem"),
    ("abs_residual_Xs_Nc", "core_rotational_subsystem"), ("shaft_1", "rotational_subsystem"), ("epr", "efficiency_subsystem"),
    ("none", "unknown_subsystem"), (None, "unknown_subsystem"), ("zz", "general_sensor_subsystem"),
])
def test_subsystems(spark, sensor, label):
    df = spark.createDataFrame([(sensor,)], "s string")
    assert df.select(explain.subsystem("s")).first()[0] == label


def test_operating_or_fault(spark):
    data = [(0.3, 0.9, 1.0), (0.5, 0.4, 0.2), (0.9, 0.9, 0.4), (0.7, 0.9, 0.6), (0.5, 0.4, 0.8), (0.7, 0.9, 0.0)]
    df = spark.createDataFrame(data, "s double, c double, p double")
    assert [r[0] for r in df.select(reasoning.operating_or_fault("s", "c", "p")).collect()] == [
        "normal_operating_variation", "possible_operating_context_shift", "critical_persistent_fault_related_pattern",
        "likely_fault_related_residual_pattern", "persistent_watch_level_residual_pattern", "watch_level_residual_pattern"]


def test_confidence(spark):
    df = spark.createDataFrame([(1.0, 0.8, 0.0, 1.0)], "model_agreement_score double, context_confidence double, anomaly_persistence_score double, data_quality_score double")
    r = uncertainty.confidence(df).first()
    assert [round(r[c], 9) for c in ("confidence_score", "uncertainty_score", "reliability_score")] == [0.70, 0.30, 0.85]
    assert (r["confidence_label"], r["uncertainty_label"]) == ("Moderate_Confidence", "Low_Uncertainty")


def test_disagreement_and_its_scale(spark):
    df = spark.createDataFrame([("dev", 1.0, 2.0, 3.0)], "split string, rf_predicted_s double, xgb_predicted_s double, lgbm_predicted_s double")
    out = uncertainty.model_disagreement(df, ["s"])
    assert abs(out.first()["model_disagreement"] - math.sqrt(2 / 3)) < 1e-12
    flat = uncertainty.model_disagreement(df.withColumns({c: F.lit(1.0) for c in df.columns[1:]}), ["s"])
    assert uncertainty.fit_disagreement_scale(flat).first()["normalization_threshold"] == 1.0


def test_recorded_errors_give_recorded_weights():
    # Recorded member errors and the weights recorded with them.
    errors = {"rf": 0.005136, "xgb": 0.016698, "lgbm": 0.014763, "mlp": 0.118849}
    weights = {"rf": 0.5887, "xgb": 0.1811, "lgbm": 0.2048, "mlp": 0.0254}
    got = twin.weights_from_errors(errors)
    assert all(abs(got[k] - v) < 5e-4 for k, v in weights.items())


def test_alert_text_and_priority(spark):
    df = spark.createDataFrame([("dev", 1, 3, 46.25, "Warning", 0.6005, "Watch", "Deteriorating")], """split string, unit_id int, cycle int, health_index double,
        health_state string, final_anomaly_score double, alert_level string, health_trend_label string""")
    r = health.health_alerts(df).first()
    assert (r["inspection_priority"], r["inspection_priority_rank"]) == ("Medium", 2)
    assert "Health index is 46.3/100 and final anomaly score is 0.601. Health trend is Deteriorating." in r["health_alert_message"]
    calm = health.health_alerts(df.drop("health_trend_label").withColumns({"health_state": F.lit("Healthy"), "alert_level": F.lit("Normal")})).first()
    assert calm["inspection_priority"] == "Routine" and "Health trend is Unknown." in calm["health_alert_message"]


def test_number_text(spark):
    df = spark.createDataFrame([(46.15,), (-0.00001,), (-2.345,)], "x double")
    assert [r[0] for r in df.select(fixed("x", 1)).collect()] == ["46.2", "0.0", "-2.3"]


def test_channel_names():
    assert channels.channel_names(["T 24", "P-30", "Xs_N/f", ""], "Xs", 4) == ["Xs_T_24", "Xs_P_30", "Xs_N_f", "Xs_4"]
    assert channels.channel_names(["a"], "W", 2) == ["W_1", "W_2"]
    assert channels.check_groups(["A", "W", "X_s", "X_v", "Y"]) == ["A", "W", "X_s", "X_v"]
    with pytest.raises(KeyError):
        channels.check_groups(["A", "W"])


def test_leaks_are_refused(spark):
    df = spark.createDataFrame([(1.0, 2.0, 3.0, 4.0, 5)], "W_alt double, Xv_T40 double, Xs_T48 double, Xs_T48_trend double, gmm_context_id int")
    assert channels.twin_columns(df) == (["W_alt", "Xv_T40", "gmm_context_id"], ["Xs_T48"])
    with pytest.raises(ValueError):
        channels.twin_columns(df.select("Xs_T48"))
    with pytest.raises(ValueError):
        channels.anomaly_features(spark.createDataFrame([(1.0,)], "resfeat_predicted_x double"))


def test_cleaning(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("1", "2", "dev", 1.0, None, 5.0, "a"), ("x", None, "dev", nan, None, 5.0, None), ("2.7", "3", "test", inf, 8.0, 5.0, "b")],
                               "unit_id string, cycle string, split string, v double, w double, k double, t string")
    out = prepare.clean(df).orderBy("split", "unit_id", "cycle").collect()
    assert [c for c in prepare.clean(df).columns] == ["unit_id", "cycle", "split", "t"]  # v, w and k are constant after filling
    assert [(r["unit_id"], r["cycle"], r["t"]) for r in out] == [(1, 0, "unknown"), (1, 2, "a"), (2, 3, "b")]


def test_dev_fit_ignores_test_rows(spark, trajectories):
    changed = trajectories.withColumn("Xs_T48", F.when(F.col("split") == "test", F.col("Xs_T48") * 100 + 7).otherwise(F.col("Xs_T48")))
    assert prepare.fit_standardizer(trajectories, ["Xs_T48"]) == prepare.fit_standardizer(changed, ["Xs_T48"])
    ids = {"gmm_context_id": F.col("unit_id") % 2}
    a = anomaly.fit_thresholds(trajectories.withColumns(ids), "Xs_T48").orderBy("context_id").collect()
    b = anomaly.fit_thresholds(changed.withColumns(ids), "Xs_T48").orderBy("context_id").collect()
    assert a == b


def test_inferred_keys(spark):
    df = spark.createDataFrame([(1, "7", 3.0), (2, "bad", 4.0), (3, "7", 5.5)], "pos long, engine string, flight_hs double")
    assert rows(tables.add_unit_and_cycle(df, "pos").select("pos", "unit_id", "cycle"), "pos") == [(1, 7, 3), (2, 1, 4), (3, 7, 5)]
    only = spark.createDataFrame([(1, 3.0), (2, 4.0)], "pos long, x double")
    assert rows(tables.add_unit_and_cycle(only, "pos", rows_per_bucket=1).select("pos", "unit_id", "cycle"), "pos") == [(1, 1, 1), (2, 1, 2)]


def test_merged_contexts_fill_gaps(spark):
    left = spark.createDataFrame([("dev", 1, 1, 1, 4), ("dev", 1, 1, 2, 5)], "split string, unit_id int, cycle int, seq long, kmeans_context_id int")
    right = spark.createDataFrame([("dev", 1, 1, 9, 2, 0.7)], "split string, unit_id int, cycle int, seq long, gmm_context_id int, context_confidence double")
    out = contexts.merge_contexts(left, right)
    assert rows(out.select("seq", "kmeans_context_id", "gmm_context_id", "context_confidence"), "seq") == [(1, 4, 2, 0.7), (2, 5, -1, 0.0)]


def test_serving_queries(spark):
    df = spark.createDataFrame([("dev", 1, c, i + 1, 0.5, "Watch" if c > 1 else "Normal") for i, c in enumerate([1, 2, 2, 3, 3])],
                               "split string, unit_id int, cycle int, seq long, final_anomaly_score double, alert_level string")
    table = serving.serving_table(df)
    assert serving.latest_of_unit(table, 1).first()["seq"] == 5
    assert serving.latest_of_unit(table, 2).count() == 0
    assert serving.latest_of_every_unit(table).first()["seq"] == 4
    few = serving.anomalies_of_unit(table, 1, limit=2).collect()
    assert [r["seq"] for r in few] == [2, 3] and few[0]["truncated"] and few[0]["total_matching_records"] == 4
    assert [r["seq"] for r in serving.page(table, ["seq"], 99, size=2).collect()] == [5]
    deep = serving.page(table, ["seq"], 2, size=2, bucket=F.floor(F.col("seq") / 2), shallow_rows=2)
    assert [r["seq"] for r in deep.collect()] == [3, 4]
    assert serving.search_alerts(table, "Watch", "ANOMALY_det").count() == 4
    kept = serving.chart_points(table, ["unit_id"], ["seq"], F.floor(F.col("seq") / 2), points=2).orderBy("_row").collect()
    assert [r["_row"] for r in kept] == [0, 3, 4]


def test_flat_correlation_is_zero(spark):
    df = spark.createDataFrame([("dev", 1.0, 5.0, 2.0), ("dev", 2.0, 5.0, 4.0)], "split string, health_index double, T_a double, T_b double")
    r = evaluation.health_correlations(df, ["T_a", "T_b"]).first()
    assert r["correlation_health_index_T_a"] == 0.0 and abs(r["correlation_health_index_T_b"] - 1.0) < 1e-12
    assert spark.range(1).select(safe_divide(F.lit(3.0), F.lit(0.0))).first()[0] == 0.0
