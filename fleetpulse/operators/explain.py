"""Sensor rankings, subsystem reports, explanation texts and model attribution."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.exprs import fixed, fmt, hash_rank
from fleetpulse.operators.ordering import uniform_sample
from fleetpulse.operators.reasoning import DEFAULT_FOCUS, plain_sensor, rank_sensors
from fleetpulse.settings import LOOKUP_ROWS, NO_MAINTENANCE, SEQ, TRAJECTORY

# Subsystem of a sensor by name part; the first match applies.
SUBSYSTEMS = (
    (("t48", "t50"), "hot_section_thermal_subsystem"),
    (("t24", "t30", "t2", "temp", "temperature"), "compressor_thermal_subsystem"),
    (("ps30", "p40", "p50"), "core_pressure_subsystem"),
    (("p2", "p15", "p21", "p24", "p30", "press", "pressure"), "fan_lpc_pressure_subsystem"),
    (("wf", "fuel", "flow"), "fuel_flow_subsystem"),
    (("nf",), "fan_rotational_subsystem"),
    (("nc",), "core_rotational_subsystem"),
    (("speed", "shaft", "n1", "n2"), "rotational_subsystem"),
    (("eff", "efficiency", "epr", "bpr"), "efficiency_subsystem"),
)
NO_SENSOR = ("none", "nan", "", "unknown")
OTHER_SUBSYSTEM = "general_sensor_subsystem"
UNKNOWN_SUBSYSTEM = "unknown_subsystem"

# Sentences.
SUBSYSTEM_TEXT = (
    "Leading residual contribution is associated with %s. Supporting contributors are %s and %s. "
    "Pattern label: %s. Inspection focus: %s This is explanation support only, not a maintenance decision."
)
REPORT_TEXT = (
    "The engine shows a %s alert under GMM operating context %s. The baseline K-Means context is %s. "
    "The ensemble digital twin estimated expected measured sensor behavior using operating conditions, "
    "virtual sensors, and context information, then compared it with actual measured sensors. "
    "The final anomaly score is %s. The health index is %s/100 and the health state is %s. "
    "The main contributing sensors are %s (%s%%), %s (%s%%), and %s (%s%%). "
    "The residual pattern is classified as %s. Recommended inspection focus: %s "
    "Context confidence is %s%%, model agreement is %s%%, confidence is %s%%, uncertainty is %s%%, and "
    "reliability is %s%%. This explanation supports inspection focus only and does not make maintenance "
    "scheduling decisions."
)
SUBSYSTEM_ROLE = "Subsystem-level explanation support"
REPORT_ROLE = "Human-readable explanation and inspection-focus support"

# Report columns after the row key, with the value of a missing one.
REPORT_DEFAULTS: Mapping[str, object] = {
    "kmeans_context_id": -1,
    "gmm_context_id": -1,
    "context_confidence": 0.0,
    "final_anomaly_score": 0.0,
    "alert_level": "Normal",
    "health_index": 100.0,
    "health_state": "Healthy",
    "remaining_health_percentage": 100.0,
    "anomaly_persistence_score": 0.0,
    "residual_trend_score": 0.0,
    "top_sensor_1": "unknown",
    "top_sensor_2": "unknown",
    "top_sensor_3": "unknown",
    "contribution_1": 0.0,
    "contribution_2": 0.0,
    "contribution_3": 0.0,
    "root_cause_pattern": "unknown_residual_pattern",
    "inspection_focus": DEFAULT_FOCUS,
    "total_abs_residual": 0.0,
    "top3_contribution_sum": 0.0,
    "dominant_detector": "unknown",
    "model_agreement_score": 0.0,
    "confidence_score": 0.0,
    "uncertainty_score": 1.0,
    "reliability_score": 0.0,
}


def sensor_ranking(df: DataFrame, columns: Sequence[str], k: int = 5) -> DataFrame:
    """The k leading sensors of each row with unrounded shares."""
    return rank_sensors(df, columns, k, "rank_{}_sensor", "rank_{}_contribution", "topk_contribution_sum", decimals=None)


def subsystem(sensor: str | Column) -> Column:
    name = F.trim(plain_sensor(sensor))
    out = F.when(F.coalesce(name, F.lit("nan")).isin(*NO_SENSOR), UNKNOWN_SUBSYSTEM)
    for tokens, label in SUBSYSTEMS:
        out = out.when(F.rlike(name, F.lit("|".join(tokens))), label)
    return out.otherwise(OTHER_SUBSYSTEM)


def subsystem_report(df: DataFrame, text: bool = True) -> DataFrame:
    """Subsystems of the three leading sensors, and a sentence about them."""
    out = df.withColumns({f"subsystem_{i}": subsystem(f"top_sensor_{i}") for i in (1, 2, 3)})
    out = out.withColumn("primary_subsystem", F.col("subsystem_1"))
    if text:
        out = out.withColumn("subsystem_explanation", fmt(
            SUBSYSTEM_TEXT, "primary_subsystem", "subsystem_2", "subsystem_3", "root_cause_pattern", "inspection_focus"))
    return out.withColumns({
        "hard_causal_claim": F.lit(False),
        "maintenance_decision": F.lit(NO_MAINTENANCE),
        "component_role": F.lit(SUBSYSTEM_ROLE),
    })


def subsystem_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("primary_subsystem").agg(F.count(F.lit(1)).alias("row_count"))


def with_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill missing values, and whole missing columns, with fixed defaults."""
    cols: dict[str, Column] = {}
    for name, value in defaults.items():
        cols[name] = F.coalesce(F.col(name), F.lit(value)) if name in df.columns else F.lit(value)
    return df.withColumns(cols)


def explanation_report(df: DataFrame) -> DataFrame:
    """The 31-column explanation table from a joined row; extra key ``seq`` is kept."""
    full = with_defaults(df, REPORT_DEFAULTS)

    def share(c: str) -> Column:
        return fixed(F.col(c) * 100.0, 1)

    text = fmt(
        REPORT_TEXT, "alert_level", F.col("gmm_context_id").cast("string"), F.col("kmeans_context_id").cast("string"),
        fixed("final_anomaly_score", 3), fixed("health_index", 1), "health_state",
        "top_sensor_1", share("contribution_1"), "top_sensor_2", share("contribution_2"),
        "top_sensor_3", share("contribution_3"), "root_cause_pattern", "inspection_focus",
        share("context_confidence"), share("model_agreement_score"), share("confidence_score"),
        share("uncertainty_score"), share("reliability_score"),
    )
    keys = ["unit_id", "cycle", "split"] + ([SEQ] if SEQ in df.columns else [])
    return full.select(
        *keys, *REPORT_DEFAULTS, text.alias("explanation_text"),
        F.lit(NO_MAINTENANCE).alias("maintenance_decision"), F.lit(REPORT_ROLE).alias("component_role"),
    )


def explanation_sample(df: DataFrame, n: int = 300, keys: Sequence[str] = (*TRAJECTORY, SEQ), seed: int = 42) -> DataFrame:
    """A bounded, reproducible row sample in row order."""
    return uniform_sample(df, keys, n, seed).orderBy(*keys)


def permutation_attribution(
    predict,
    sample: DataFrame,
    features: Sequence[str],
    model: str,
    targets: int = 1,
    permutations: int = 4,
    keys: Sequence[str] = (*TRAJECTORY, SEQ),
    seed: int = 42,
) -> DataFrame:
    """Mean absolute contribution of each feature, by sampled feature orders.

    For each explained row a background row is drawn from the sample and features are
    switched from background to actual values one by one, in several random orders. The
    change of the prediction at each switch is that feature's contribution.
    ``predict(df)`` must add a ``prediction`` column. The sample is meant to be small (see
    ``explanation_sample``): its rows are numbered in one task.
    """
    rows = sample.select(*keys, *[F.col(f).cast("double").alias(f) for f in features]).withColumn(
        "_pos", F.row_number().over(_by_hash(keys, seed)))
    n = rows.count()
    base = rows.select(F.col("_pos").alias("_base"), *[F.col(f).alias(f"{f}__base") for f in features])
    drawn = rows.withColumn("_perm", F.explode(F.sequence(F.lit(0), F.lit(permutations - 1)))).withColumn(
        "_base", (F.pmod(F.col("_pos") * 31 + F.col("_perm") * 17, F.lit(n)) + 1).cast("int"))
    place = F.array_sort(F.array(*[
        F.struct(F.md5(F.concat_ws("|", F.col("_perm"), F.col("_pos"), F.lit(f), F.lit(seed))).alias("h"), F.lit(f).alias("f"))
        for f in features
    ]))
    order = F.transform(place, lambda s: s["f"])
    steps = (
        drawn.join(F.broadcast(base) if n <= LOOKUP_ROWS else base, "_base")
        .withColumn("_order", order)
        .withColumn("_step", F.explode(F.sequence(F.lit(0), F.lit(len(features)))))
    )
    mixed = steps.withColumns({
        f: F.when(F.array_position("_order", F.lit(f)) <= F.col("_step"), F.col(f)).otherwise(F.col(f"{f}__base")) for f in features
    })
    scored = predict(mixed).select(
        *keys, "_perm", "_step", F.when(F.col("_step") > 0, F.col("_order")[F.col("_step") - 1]).alias("feature"), "prediction")
    path = F.array_sort(F.collect_list(F.struct("_step", "feature", "prediction")))
    walks = scored.groupBy(*keys, "_perm").agg(path.alias("_path"))
    moves = walks.select(*keys, "_perm", F.inline(F.transform(
        F.sequence(F.lit(1), F.lit(len(features))),
        lambda i: F.struct(
            F.get("_path", i)["feature"].alias("feature"),
            (F.get("_path", i)["prediction"] - F.get("_path", i - 1)["prediction"]).alias("change")),
    )))
    per_row = moves.groupBy(*keys, "feature").agg(F.avg("change").alias("value"))
    return per_row.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_shap")).select(
        F.lit(model).alias("model"), "feature", "mean_abs_shap",
        F.lit(1).alias("targets_explained"), F.lit(targets).alias("available_target_count"),
        F.lit(n).alias("sample_size"), F.lit("permutation_shap_model_agnostic").alias("explanation_type"),
    )


def _by_hash(keys: Sequence[str], seed: int):
    return Window.partitionBy(F.lit(0)).orderBy(hash_rank(keys, seed + 7))


def mean_importance(attribution: DataFrame, top: int = 20) -> DataFrame:
    """Importance averaged over models, largest first."""
    return attribution.groupBy("feature").agg(F.avg("mean_abs_shap").alias("mean_abs_shap")).orderBy(
        F.desc("mean_abs_shap"), "feature").limit(top)
