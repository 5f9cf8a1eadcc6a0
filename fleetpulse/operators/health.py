"""Health index, states, trends and inspection alerts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.channels import require_columns
from fleetpulse.functions.exprs import clip, finite_or, fixed, fmt, label_map, level, unit_clip
from fleetpulse.operators.ordering import difference, in_blocks, trailing
from fleetpulse.settings import (
    BLOCK_ROWS, HEALTH_LEVELS, HEALTH_WEIGHTS, NO_MAINTENANCE, ROLLING_ROWS, SEQ, TRAJECTORY,
)

# Ranks and texts.
STATE_RANK = {"Warning": 1, "Degrading": 2, "Healthy": 3}
STATE_TEXT = {
    "Healthy": "Health index is high and anomaly severity is low.",
    "Degrading": "Health index shows early degradation signs.",
    "Warning": "Health index indicates significant degradation behavior.",
}
CRITICAL_TEXT = "Health index indicates severe anomaly behavior."
PRIORITY_RANK = {"Low": 1, "Medium": 2, "High": 3}
FOCUS_CRITICAL = "Immediate inspection focus required"
FOCUS_WARNING = "Inspect affected subsystem indicators"
FOCUS_TREND = "Track deteriorating health trend"
FOCUS_WATCH = "Monitor degradation indicators"
FOCUS_ROUTINE = "Routine monitoring"
ALERT_MESSAGE = (
    "Health state is %s with %s anomaly alert. Health index is %s/100 and final anomaly score is %s. "
    "Health trend is %s. Inspection priority is %s. This module provides inspection-focus support only; "
    "maintenance scheduling decisions belong to the autonomous maintenance supervisor."
)


def health_index(
    df: DataFrame,
    score: str = "final_anomaly_score",
    rows: int = ROLLING_ROWS,
    threshold: float = 0.40,
    weights: Mapping[str, float] = HEALTH_WEIGHTS,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Trend and persistence of the score over recent rows, and the index from 0 to 100."""

    def build(x: DataFrame, w):
        frame = trailing(w, rows)
        clean = x.withColumn(score, unit_clip(score))
        return clean.withColumns({
            "residual_trend_score": F.avg(score).over(frame),
            "anomaly_persistence_score": F.avg((F.col(score) >= threshold).cast("double")).over(frame),
        })

    out = in_blocks(df, rows - 1, build, keys, seq, block_rows)
    index = (
        F.lit(100.0)
        - weights["score"] * F.col(score)
        - weights["trend"] * F.col("residual_trend_score")
        - weights["persistence"] * F.col("anomaly_persistence_score")
    )
    return out.withColumn("health_index", clip(finite_or(index, 0.0), 0.0, 100.0)).withColumn(
        "remaining_health_percentage", F.col("health_index"))


def health_summary(df: DataFrame) -> DataFrame:
    """Rows, mean, smallest and largest index and mean components per split."""
    return df.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("health_index").alias("average_health_index"),
        F.avg("final_anomaly_score").alias("average_final_anomaly_score"),
        F.avg("residual_trend_score").alias("average_residual_trend_score"),
        F.avg("anomaly_persistence_score").alias("average_anomaly_persistence_score"),
        F.min("health_index").alias("min_health_index"),
        F.max("health_index").alias("max_health_index"),
    )


def health_state(df: DataFrame, index: str = "health_index") -> DataFrame:
    """State, rank and explanation from the index."""
    out = df.withColumn(index, clip(finite_or(index, 0.0), 0.0, 100.0))
    out = out.withColumn("health_state", level(index, HEALTH_LEVELS, "Critical"))
    return out.withColumns({
        "remaining_health_percentage": F.col(index),
        "health_state_rank": label_map("health_state", STATE_RANK, 0),
        "health_state_explanation": label_map("health_state", STATE_TEXT, CRITICAL_TEXT),
    })


def trend_label(delta: str | Column, threshold: float = 2.0) -> Column:
    d = F.col(delta) if isinstance(delta, str) else delta
    return F.when(d < -threshold, "Deteriorating").when(d > threshold, "Recovering").otherwise("Stable")


def raw_trends(
    df: DataFrame,
    index: str = "health_index",
    rows: int = ROLLING_ROWS,
    threshold: float = 2.0,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rolling index, its change, the unscaled deterioration and the trend label."""

    def build(x: DataFrame, w):
        frame = trailing(w, rows)
        return (
            x.withColumn(index, clip(finite_or(index, 0.0), 0.0, 100.0))
            .withColumn("health_index_delta", difference(index, w))
            .withColumn("_drop", F.greatest(-F.col("health_index_delta"), F.lit(0.0)))
            .withColumns({"health_index_rolling_mean": F.avg(index).over(frame),
                          "health_deterioration_score_raw": F.avg("_drop").over(frame)})
            .drop("_drop")
        )

    out = in_blocks(df, rows, build, keys, seq, block_rows)
    return out.withColumn("health_trend_label", trend_label("health_index_delta", threshold))


def scale_deterioration(df: DataFrame, raw: str = "health_deterioration_score_raw") -> DataFrame:
    """Deterioration relative to the worst row of the whole table."""
    worst = df.agg(F.max(raw)).first()[0]
    return df.withColumn("health_deterioration_score", unit_clip(F.col(raw) / F.lit(max(float(worst or 0.0), 1e-12))))


def health_trends(df: DataFrame, **kw: object) -> DataFrame:
    return scale_deterioration(raw_trends(df, **kw))


def inspection_priority(state: str, alert: str, trend: str | None) -> Column:
    s, a = F.col(state), F.col(alert)
    low = (s == "Degrading") | (a == "Watch")
    if trend:
        low = low | F.coalesce(F.col(trend) == "Deteriorating", F.lit(False))
    return (
        F.when((s == "Critical") | (a == "Critical"), "High")
        .when((s == "Warning") | (a == "Warning"), "Medium")
        .when(low, "Low")
        .otherwise("Routine")
    )


def inspection_focus(state: str, alert: str, trend: str | None) -> Column:
    s, a = F.col(state), F.col(alert)
    out = (
        F.when((s == "Critical") | (a == "Critical"), FOCUS_CRITICAL)
        .when((s == "Warning") | (a == "Warning"), FOCUS_WARNING)
    )
    if trend:
        out = out.when(F.col(trend) == "Deteriorating", FOCUS_TREND)
    return out.when((s == "Degrading") | (a == "Watch"), FOCUS_WATCH).otherwise(FOCUS_ROUTINE)


def health_alerts(df: DataFrame) -> DataFrame:
    """Inspection priority, focus and message of every row."""
    require_columns(df, ("unit_id", "cycle", "split", "health_index", "health_state", "final_anomaly_score", "alert_level"))
    trend = "health_trend_label" if "health_trend_label" in df.columns else None
    out = df.withColumns({
        "inspection_priority": inspection_priority("health_state", "alert_level", trend),
        "inspection_focus": inspection_focus("health_state", "alert_level", trend),
    })
    return out.withColumns({
        "inspection_priority_rank": label_map("inspection_priority", PRIORITY_RANK, 0),
        "health_alert_message": fmt(
            ALERT_MESSAGE, "health_state", "alert_level", fixed("health_index", 1),
            fixed("final_anomaly_score", 3), F.coalesce(F.col(trend), F.lit("Unknown")) if trend else F.lit("Unknown"),
            "inspection_priority",
        ),
        "maintenance_decision": F.lit(NO_MAINTENANCE),
    })
