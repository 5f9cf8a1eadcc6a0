"""Residual thresholds, detector fusion, severity and early warning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.exprs import col, finite_or, label_map, level, normalized, row_sum, unit_clip
from fleetpulse.functions.quantiles import quantile_columns
from fleetpulse.operators.ordering import difference, in_blocks, lookup_join, small_table, trailing
from fleetpulse.settings import (
    ALERT_LEVELS, BLOCK_ROWS, DEV, EARLY_WARNING_LEVELS, FUSION_WEIGHTS, RESIDUAL_PERCENTILES,
    ROLLING_ROWS, SEQ, TRAJECTORY,
)

GLOBAL = "global"

# Severity ranks and texts.
SEVERITY_RANK = {"Watch": 1, "Warning": 2, "Critical": 3}
SEVERITY_TEXT = {
    "Watch": "Early abnormal behavior detected",
    "Warning": "Strong anomaly pattern detected",
    "Critical": "Critical anomaly pattern detected",
}
NORMAL_TEXT = "Normal operating behavior"
RISK_RANK = {"Watch_Risk": 1, "Increasing_Risk": 2}

# Score, vote and weight column of each detector, in order of precedence.
DETECTORS = {
    "residual": ("residual_anomaly_score", "residual_vote", "residual_contribution"),
    "iforest": ("iforest_anomaly_score", "iforest_anomaly_label", "iforest_contribution"),
    "mahalanobis": ("mahalanobis_score", "mahalanobis_anomaly_label", "mahalanobis_contribution"),
    "lstm_autoencoder": ("lstm_autoencoder_score", "lstm_autoencoder_label", "lstm_autoencoder_contribution"),
}


def total_abs_residual(df: DataFrame, columns: Sequence[str], name: str = "total_abs_residual") -> DataFrame:
    return df.withColumn(name, row_sum([F.abs(F.col(c)) for c in columns]))


def fit_thresholds(
    df: DataFrame,
    value: str = "total_abs_residual",
    context: str = "gmm_context_id",
    fit_split: str = DEV,
    **kw: object,
) -> DataFrame:
    """Watch, warning and critical percentiles per context and over all rows.

    Columns: ``context_id`` (text, or ``global``), one per level, ``rows_used``.
    """
    groups = F.array(F.col(context).cast("string"), F.lit(GLOBAL))
    rows = df.where(F.col("split") == fit_split).select(F.explode(groups).alias("context_id"), value)
    out = quantile_columns(rows, value, RESIDUAL_PERCENTILES, ["context_id"], **kw)
    return out.select("context_id", *[n for n, _ in RESIDUAL_PERCENTILES], F.col("n").cast("long").alias("rows_used"))


def bad_thresholds(thresholds: DataFrame) -> DataFrame:
    """Rows that break watch <= warning <= critical, and a row if ``global`` is missing."""
    ordered = (F.col("watch") <= F.col("warning")) & (F.col("warning") <= F.col("critical"))
    broken = thresholds.where(~F.coalesce(ordered, F.lit(False))).select("context_id", F.lit("levels_out_of_order").alias("problem"))
    count = thresholds.agg(F.count_if(F.col("context_id") == GLOBAL).alias("_n"))
    missing = count.where(F.col("_n") == 0).select(F.lit(GLOBAL).alias("context_id"), F.lit("missing").alias("problem"))
    return broken.unionByName(missing)


def check_thresholds(thresholds: DataFrame) -> None:
    problems = bad_thresholds(thresholds)
    if not problems.isEmpty():
        raise ValueError(f"bad thresholds: {problems.limit(20).collect()}")


def attach_thresholds(df: DataFrame, thresholds: DataFrame, context: str = "gmm_context_id") -> DataFrame:
    """Add the context's thresholds, or the global ones for a context never fitted."""
    levels = [n for n, _ in RESIDUAL_PERCENTILES]
    local, _ = small_table(thresholds)
    base = local.where(F.col("context_id") == GLOBAL).first()
    if base is None:
        raise ValueError("global thresholds are missing")
    own = local.where(F.col("context_id") != GLOBAL).select(
        F.col("context_id").alias("_context"), *[F.col(n).alias(f"_{n}") for n in levels])
    out = lookup_join(df.withColumn("_context", F.col(context).cast("string")), own, ["_context"])
    return out.withColumns({
        f"{n}_threshold": F.coalesce(f"_{n}", F.lit(float(base[n]))) for n in levels
    }).drop("_context", *[f"_{n}" for n in levels])


def score_residuals(
    df: DataFrame,
    thresholds: DataFrame,
    value: str = "total_abs_residual",
    context: str = "gmm_context_id",
) -> DataFrame:
    """Score against the critical threshold and name the level reached."""
    out = attach_thresholds(df, thresholds, context)
    x = F.col(value)
    name = (
        F.when(x >= F.col("critical_threshold"), "Critical")
        .when(x >= F.col("warning_threshold"), "Warning")
        .when(x >= F.col("watch_threshold"), "Watch")
        .otherwise("Normal")
    )
    ratio = x / F.greatest(F.col("critical_threshold"), F.lit(1e-9))
    return out.withColumns({
        "residual_anomaly_score": F.least(ratio, F.lit(1.0)),
        "residual_alert_level": name,
    })


def min_max_scores(df: DataFrame, columns: Mapping[str, str], ranges_from: DataFrame | None = None) -> DataFrame:
    """Scale columns to [0, 1] by their range over all rows; a flat column gives 0.

    ``columns`` maps value to score names. All ranges come from one aggregation, over
    ``ranges_from`` if the same rows are available more cheaply there.
    """
    source = df if ranges_from is None else ranges_from
    found = source.agg(*[f(v).alias(f"{v}__{n}") for v in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
    out = {}
    for value, name in columns.items():
        lo, hi = found[f"{value}__lo"], found[f"{value}__hi"]
        span = max(float(hi) - float(lo), 1e-12) if lo is not None else 1.0
        out[name] = unit_clip((F.col(value) - F.lit(float(lo or 0.0))) / F.lit(span))
    return df.withColumns(out)


def min_max_score(df: DataFrame, value: str, name: str) -> DataFrame:
    return min_max_scores(df, {value: name})


def fuse(df: DataFrame, weights: Mapping[str, float] = FUSION_WEIGHTS, alert: str = "residual_alert_level") -> DataFrame:
    """Weighted sum of the detectors present in ``weights``, with votes and dominance.

    Weights are scaled to sum to one. The residual detector votes whenever its level is
    not Normal; the others vote by their label column.
    """
    share = normalized(dict(weights))
    names = list(share)
    clean = {DETECTORS[n][0]: unit_clip(DETECTORS[n][0]) for n in names}
    votes = {
        DETECTORS[n][1]: (F.col(alert) != "Normal").cast("int") if n == "residual"
        else F.coalesce(F.col(DETECTORS[n][1]).cast("int"), F.lit(0))
        for n in names
    }
    out = df.withColumns({**clean, **votes})
    out = out.withColumns({
        **{DETECTORS[n][2]: F.lit(w) * F.col(DETECTORS[n][0]) for n, w in share.items()},
        **{f"fusion_weight_{n}": F.lit(w) for n, w in share.items()},
    })
    parts = [F.col(DETECTORS[n][2]) for n in names]
    total = sum(parts[1:], parts[0])
    top = F.greatest(*parts) if len(parts) > 1 else parts[0]
    ballots = [F.col(v) for v in votes]
    dominant = F.lit(names[-1])
    for name in reversed(names[:-1]):
        dominant = F.when(F.col(DETECTORS[name][2]) == top, name).otherwise(dominant)
    out = out.withColumns({
        "detector_agreement_count": sum(ballots[1:], ballots[0]),
        "dominant_detector": dominant,
        "final_anomaly_score": F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0)),
    })
    return out.withColumns({
        "detector_agreement_ratio": F.col("detector_agreement_count") / F.lit(float(len(names))),
        "alert_level": level("final_anomaly_score", ALERT_LEVELS, "Normal"),
    })


def alert_level(c: str | Column) -> Column:
    return level(c, ALERT_LEVELS, "Normal")


def classify_severity(df: DataFrame, score: str = "final_anomaly_score") -> DataFrame:
    """Alert level, rank and description from the cleaned score."""
    return df.withColumn("alert_level", level(unit_clip(score), ALERT_LEVELS, "Normal")).withColumns({
        "severity_rank": label_map("alert_level", SEVERITY_RANK, 0),
        "severity_description": label_map("alert_level", SEVERITY_TEXT, NORMAL_TEXT),
    })


def early_warning(
    df: DataFrame,
    score: str = "final_anomaly_score",
    rows: int = ROLLING_ROWS,
    mean_weight: float = 0.70,
    slope_weight: float = 0.30,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rolling level and rising slope of the score combined into a risk label."""

    def build(x: DataFrame, w):
        frame = trailing(w, rows)
        return (
            x.withColumn("_score", unit_clip(score))
            .withColumn("_slope", difference("_score", w))
            .withColumns({"rolling_anomaly_mean": F.avg("_score").over(frame),
                          "rolling_anomaly_slope": F.avg("_slope").over(frame)})
            .drop("_score", "_slope")
        )

    out = in_blocks(df, rows, build, keys, seq, block_rows)
    rising = F.least(F.greatest(F.col("rolling_anomaly_slope"), F.lit(0.0)), F.lit(1.0))
    warning = unit_clip(mean_weight * F.col("rolling_anomaly_mean") + slope_weight * rising)
    out = out.withColumns({"positive_rolling_anomaly_slope": rising, "early_warning_score": warning})
    out = out.withColumn("early_warning_label", level("early_warning_score", EARLY_WARNING_LEVELS, "Stable"))
    return out.withColumns({
        "early_warning_rank": label_map("early_warning_label", RISK_RANK, 0),
        "early_warning_window": F.lit(rows),
        "early_warning_watch_threshold": F.lit(EARLY_WARNING_LEVELS[0][1]),
        "early_warning_increasing_threshold": F.lit(EARLY_WARNING_LEVELS[1][1]),
    })


def alert_cross_tab(df: DataFrame, by: str, alert: str = "alert_level") -> DataFrame:
    """Row count and share of each alert level within ``by``."""
    counts = df.groupBy(by, alert).agg(F.count(F.lit(1)).alias("row_count"))
    share = F.col("row_count") / F.sum("row_count").over(Window.partitionBy(by))
    return counts.withColumn("row_percent", share * 100.0)


def clean_score(c: str | Column) -> Column:
    return finite_or(col(c), 0.0)
