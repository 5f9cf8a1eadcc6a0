"""Agreement between models, data quality and confidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.channels import DEGRADATION, TARGETS, numeric_columns
from fleetpulse.functions.exprs import INF, finite_or, level, normalized, row_std, unit_clip
from fleetpulse.functions.quantiles import exact_quantiles
from fleetpulse.settings import CONFIDENCE_LEVELS, CONFIDENCE_WEIGHTS, DEV, NO_MAINTENANCE, UNCERTAINTY_LEVELS

MEMBERS = ("rf_predicted_", "xgb_predicted_", "lgbm_predicted_")
PERCENTILE = 0.99
ROLE = "Confidence, reliability, and uncertainty scoring"


def model_disagreement(df: DataFrame, sensors: Sequence[str], members: Sequence[str] = MEMBERS) -> DataFrame:
    """Mean over sensors of the deviation between the members' predictions."""
    clean = {f"_p_{m}{s}": finite_or(f"{m}{s}", 0.0) for s in sensors for m in members}
    spread = [row_std([f"_p_{m}{s}" for m in members]) for s in sensors]
    out = df.withColumns(clean).withColumn("model_disagreement", sum(spread[1:], spread[0]) / float(len(sensors)))
    return out.drop(*clean)


def fit_disagreement_scale(df: DataFrame, fit_split: str = DEV, percentile: float = PERCENTILE) -> DataFrame:
    """One row: percentile, largest value and the scale actually used."""
    rows = df.where(F.col("split") == fit_split)
    q = exact_quantiles(rows, "model_disagreement", [percentile]).select(F.col("quantile").alias("percentile_value"))
    top = rows.agg(F.max("model_disagreement").alias("max_value"), F.count(F.lit(1)).alias("dev_rows_seen"))
    scale = (
        F.when(F.col("percentile_value") > 1e-12, F.col("percentile_value"))
        .when(F.col("max_value") > 1e-12, F.col("max_value"))
        .otherwise(1.0)
    )
    return top.join(F.broadcast(q), how="left").withColumn("normalization_threshold", scale)


def model_agreement(df: DataFrame, sensors: Sequence[str], scale: float, percentile: float = PERCENTILE, fit_split: str = DEV) -> DataFrame:
    """Disagreement scaled to [0, 1] and agreement as its complement."""
    share = unit_clip(F.col("model_disagreement") / F.lit(max(scale, 1e-12)))
    return df.withColumns({
        "normalized_model_disagreement": share,
        "model_agreement_score": 1.0 - share,
        "uncertainty_from_model_disagreement": share,
        "agreement_normalization_threshold": F.lit(float(scale)),
        "agreement_normalization_percentile": F.lit(percentile * 100.0),
        "agreement_fit_split": F.lit(fit_split),
        "agreement_sensor_count": F.lit(len(sensors)),
    })


def quality_columns(df: DataFrame) -> list[str]:
    """Numeric columns that count for data quality: no keys, no degradation or targets."""
    return [c for c in numeric_columns(df)
            if c not in ("unit_id", "cycle", "seq") and not c.startswith(DEGRADATION + TARGETS)]


def data_quality(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One minus the share of missing and of infinite entries in the row."""
    columns = quality_columns(df) if columns is None else columns
    if not columns:
        return df.withColumn("data_quality_score", F.lit(1.0))
    bad = F.lit(0)
    for c in columns:
        x = F.col(c).cast("double")
        bad = bad + (x.isNull() | F.isnan(x)).cast("int") + F.coalesce((F.abs(x) == F.lit(INF)).cast("int"), F.lit(0))
    return df.withColumn("data_quality_score", unit_clip(1.0 - bad / F.lit(float(len(columns)))))


def confidence(df: DataFrame, weights: Mapping[str, float] = CONFIDENCE_WEIGHTS) -> DataFrame:
    """Confidence, uncertainty and reliability with their labels."""
    share = normalized(dict(weights))
    inputs = {c: unit_clip(c) if c in df.columns else F.lit(0.0) for c in share}
    out = df.withColumns(inputs)
    parts = [F.lit(w) * F.col(c) for c, w in share.items()]
    out = out.withColumn("confidence_score", unit_clip(sum(parts[1:], parts[0])))
    out = out.withColumns({
        "uncertainty_score": unit_clip(1.0 - F.col("confidence_score")),
        "reliability_score": unit_clip(
            0.50 * F.col("confidence_score") + 0.30 * F.col("model_agreement_score") + 0.20 * F.col("data_quality_score")),
    })
    return out.withColumns({
        "confidence_label": level("confidence_score", CONFIDENCE_LEVELS, "Very_Low_Confidence"),
        "uncertainty_label": level("uncertainty_score", UNCERTAINTY_LEVELS, "Very_Low_Uncertainty"),
        "component_role": F.lit(ROLE),
        "maintenance_decision": F.lit(NO_MAINTENANCE),
    })
