"""Telemetry tables that the registered queries run on, built from the driver's tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.operators import anomaly, health, reasoning, residuals, serving, twin, uncertainty
from fleetpulse.operators.ordering import lookup_join, order_buckets, small_table
from fleetpulse.operators.prepare import Standardizer, fit_standardizer
from fleetpulse.sources.tables import events_telemetry, lineitem_telemetry
from fleetpulse.settings import DEV

SENSORS = ["Xs_T48", "Xs_Ps30", "Xs_Nf", "Xs_Wf"]
ABS_RESIDUALS = [f"abs_residual_{s}" for s in SENSORS]
MEMBERS = {"rf": "rf_predicted_", "xgb": "xgb_predicted_", "lgbm": "lgbm_predicted_"}
EQUAL = {m: 1.0 for m in MEMBERS}


def events(spark: SparkSession, sf: str) -> DataFrame:
    return events_telemetry(spark, sf)


def gappy_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with missing and infinite values, missing text and damaged key fields."""
    i = F.col("event_id")
    return spark.read.parquet(f"{sf}/events.parquet").select(
        "event_id",
        F.when(F.col("user_id") % 3 == 2, "test").otherwise("dev").alias("split"),
        F.when(i % 23 == 0, F.lit("n/a")).otherwise(F.col("user_id").cast("string")).alias("unit_id"),
        F.when(i % 29 == 0, F.lit(None)).otherwise(F.dayofmonth("ts").cast("string")).alias("cycle"),
        F.when(i % 17 == 0, F.lit(None)).when(i % 19 == 0, F.lit(float("inf"))).when(i % 31 == 0, F.lit(float("nan")))
        .otherwise(F.col("value")).alias("Xs_T48"),
        F.when(F.col("user_id") % 3 == 2, F.lit(None)).otherwise(F.col("value") * 2).alias("Xs_P2"),
        F.lit(None).cast("double").alias("Xs_Nf"),
        F.lit(3.5).alias("W_alt"),
        F.when(i % 13 == 0, F.lit(None)).otherwise(F.col("event_type")).alias("event_type"),
    )


@dataclass
class FittedLineitem:
    """Scaler and three simple predictors fitted once on the lineitem telemetry.

    The predictors are means of each sensor over the fit rows of a group. Row-wise tables
    come with or without ``seq``; fits use the form without, which needs no shuffle.
    """

    spark: SparkSession
    sf: str
    scaler: Standardizer
    means: list[tuple[list[str], DataFrame]]

    def scaled(self, sequenced: bool = True) -> DataFrame:
        return self.scaler.transform(lineitem_telemetry(self.spark, self.sf, sequenced))

    def members(self, sequenced: bool = True) -> DataFrame:
        return self._predicted(self.scaled(sequenced))

    def _predicted(self, df: DataFrame) -> DataFrame:
        for by, table in self.means:
            df = lookup_join(df, table, by)
        return df

    def residuals(self, sequenced: bool = True) -> DataFrame:
        return self._residuals(self.members(sequenced))

    def residuals_of(self, raw: DataFrame) -> DataFrame:
        """Residuals of other rows, such as a stream, under the fitted parameters."""
        return self._residuals(self._predicted(self.scaler.transform(raw)))

    def _residuals(self, members: DataFrame) -> DataFrame:
        df = twin.blend(members, SENSORS, MEMBERS, EQUAL)
        return anomaly.total_abs_residual(residuals.residuals(df, SENSORS), ABS_RESIDUALS)


def fit_lineitem(spark: SparkSession, sf: str) -> FittedLineitem:
    raw = lineitem_telemetry(spark, sf, sequenced=False)
    scaler = fit_standardizer(raw, SENSORS)
    dev = scaler.transform(raw).where(F.col("split") == DEV)
    groups = {"rf": ["gmm_context_id", "kmeans_context_id"], "xgb": ["gmm_context_id"], "lgbm": ["kmeans_context_id"]}
    # one pass for the three groupings; the bits of grouping_id mark columns not grouped by
    table, _ = small_table(dev.groupingSets(list(groups.values()), "gmm_context_id", "kmeans_context_id").agg(
        F.grouping_id().alias("_g"), *[F.avg(s).alias(s) for s in SENSORS]))
    bits = {"rf": 0, "xgb": 1, "lgbm": 2}
    means = [
        (by, table.where(F.col("_g") == bits[m]).select(*by, *[F.col(s).alias(f"{MEMBERS[m]}{s}") for s in SENSORS]))
        for m, by in groups.items()
    ]
    return FittedLineitem(spark, sf, scaler, means)


def scored(fitted: FittedLineitem, sequenced: bool = True) -> DataFrame:
    thresholds = anomaly.fit_thresholds(fitted.residuals(sequenced=False))
    return anomaly.score_residuals(fitted.residuals(sequenced), thresholds)


def detector_scores(fitted: FittedLineitem, sequenced: bool = True) -> DataFrame:
    """Residual scores with three further detectors from single residuals."""
    detectors = {
        "abs_residual_Xs_Nf": ("iforest_anomaly_score", "iforest_anomaly_label"),
        "abs_residual_Xs_T48": ("mahalanobis_score", "mahalanobis_anomaly_label"),
        "abs_residual_Xs_Wf": ("lstm_autoencoder_score", "lstm_autoencoder_label"),
    }
    df = anomaly.min_max_scores(
        scored(fitted, sequenced), {v: s for v, (s, _) in detectors.items()}, fitted.residuals(sequenced=False))
    return df.withColumns({label: (F.col(score) >= 0.9).cast("int") for score, label in detectors.values()})


def fused(spark: SparkSession, sf: str, sequenced: bool = True) -> DataFrame:
    return anomaly.fuse(detector_scores(fit_lineitem(spark, sf), sequenced))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    """Fusion, health, root cause, agreement and confidence of every lineitem row."""
    fitted = fit_lineitem(spark, sf)
    df = health.health_state(health.health_index(anomaly.fuse(detector_scores(fitted))))
    df = reasoning.root_cause(df, ABS_RESIDUALS)
    df = uncertainty.model_disagreement(df, SENSORS)
    fit_rows = uncertainty.model_disagreement(fitted.members(sequenced=False), SENSORS)
    scale = uncertainty.fit_disagreement_scale(fit_rows).first()["normalization_threshold"]
    df = uncertainty.model_agreement(df, SENSORS, scale)
    df = df.withColumn("context_confidence", 1.0 - F.col("kmeans_context_id") * 0.25)
    return uncertainty.confidence(uncertainty.data_quality(df, SENSORS))


def early_events(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.early_warning(anomaly.classify_severity(events(spark, sf)))


def health_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events with alert level, health index and state."""
    return health.health_state(health.health_index(anomaly.classify_severity(events(spark, sf))))


def pattern_events(spark: SparkSession, sf: str) -> DataFrame:
    """Health events with a pattern label taken from the event type."""
    return with_pattern(health_events(spark, sf))


def with_pattern(df: DataFrame) -> DataFrame:
    # Pattern label of each event type code.
    names = ("thermal_response_deviation", "pressure_system_deviation", "rotational_speed_deviation",
             "flow_or_fuel_related_deviation", "multisensor_residual_deviation")
    out = F.lit(names[-1])
    for i, n in reversed(list(enumerate(names[:-1]))):
        out = F.when(F.col("gmm_context_id") == i, n).otherwise(out)
    return df.withColumn("root_cause_pattern", out)


def serving_source(spark: SparkSession, sf: str) -> DataFrame:
    """Events telemetry with health, pattern, leading sensor and confidence."""
    return pattern_events(spark, sf).withColumns({
        "top_sensor_1": F.when(F.col("gmm_context_id") < 3, "Xs_T48").otherwise("Xs_P2"),
        "confidence_score": 1.0 - F.col("final_anomaly_score") / 2.0,
        "uncertainty_score": F.col("final_anomaly_score") / 2.0,
    })


def served(spark: SparkSession, sf: str) -> DataFrame:
    """Serving table of the events telemetry."""
    return serving.serving_table(serving_source(spark, sf))


def feedback_records(spark: SparkSession, sf: str) -> DataFrame:
    """One feedback record per event; the label follows from the event number."""
    return feedback_of(events_telemetry(spark, sf, sequenced=False))


def feedback_of(rows: DataFrame) -> DataFrame:
    # Labels by remainder of the event number.
    label = F.when(F.col("event_id") % 4 == 0, "accepted_alert").when(F.col("event_id") % 4 == 1, "rejected_false_alarm").when(
        F.col("event_id") % 4 == 2, "missed_anomaly").otherwise("uncertain")
    return with_pattern(rows).select(
        "event_id", "ts", "unit_id", "cycle", F.col("gmm_context_id").alias("context_id"),
        anomaly.alert_level("final_anomaly_score").alias("alert_level"), "final_anomaly_score",
        "root_cause_pattern", label.alias("feedback_label"), F.lit("").alias("operator_note"),
    )


def feedback_log(spark: SparkSession, sf: str) -> DataFrame:
    from fleetpulse.operators.feedback import number_feedback

    return number_feedback(feedback_records(spark, sf), 0, ["ts", "event_id"], order_buckets("ts", "event_id"), F.col("ts"))


def event_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return anomaly.fit_thresholds(events_telemetry(spark, sf, sequenced=False), "Xs_T48")
