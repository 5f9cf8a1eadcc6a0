"""Label-free evaluation of every stage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.exprs import clip, finite_or, safe_corr, unit_clip
from fleetpulse.operators.ordering import difference, in_blocks, lookup_join, trailing
from fleetpulse.settings import BLOCK_ROWS, DEV, ROLLING_ROWS, SEQ, TEST, TRAJECTORY

# Columns an explanation must fill.
EXPLANATION_COLUMNS = (
    "gmm_context_id", "context_confidence", "health_index", "health_state", "final_anomaly_score",
    "alert_level", "top_sensor_1", "top_sensor_2", "top_sensor_3", "root_cause_pattern", "explanation_text",
)


def _share(cond: Column) -> Column:
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double"))


def _mode(df: DataFrame, column: str, name: str, by: str = "split") -> DataFrame:
    """Most frequent value per group; equal counts give the first name."""
    counts = df.groupBy(by, column).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(by).agg(F.min_by(column, F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v"))).alias(name))


def anomaly_metrics(
    df: DataFrame,
    rows: int = ROLLING_ROWS,
    threshold: float = 0.40,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Alert, score, persistence, agreement and early-warning figures per split."""

    def build(x: DataFrame, w):
        x = x.withColumn("_score", unit_clip("final_anomaly_score"))
        return x.withColumn("_persistence", F.avg((F.col("_score") >= threshold).cast("double")).over(trailing(w, rows)))

    x = in_blocks(df, rows - 1, build, keys, seq, block_rows)
    lvl, risk = F.col("alert_level"), F.col("early_warning_label")
    names = ("Normal", "Watch", "Warning", "Critical")
    risks = ("Stable", "Watch_Risk", "Increasing_Risk")
    alert = lvl.isin("Watch", "Warning", "Critical")
    base = x.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        *[F.count_if(lvl == n).alias(f"{n.lower()}_count") for n in names],
        F.count_if(alert).alias("anomaly_alert_count"),
        *[_share(lvl == n).alias(f"{n.lower()}_ratio") for n in names],
        _share(alert).alias("anomaly_alert_ratio"),
        F.avg("_score").alias("average_final_anomaly_score"),
        F.stddev_pop("_score").alias("std_final_anomaly_score"),
        F.min("_score").alias("min_final_anomaly_score"),
        F.max("_score").alias("max_final_anomaly_score"),
        F.avg("_persistence").alias("average_anomaly_persistence_proxy"),
        _share(alert & (F.col("_score") < threshold)).alias("false_alarm_proxy_rate"),
        *[F.avg(finite_or(c, 0.0)).alias(f"average_{c}") for c in (
            "detector_agreement_ratio", "detector_agreement_count", "residual_anomaly_score",
            "iforest_anomaly_score", "mahalanobis_score", "lstm_autoencoder_score") if c in df.columns],
        F.avg(unit_clip("early_warning_score")).alias("average_early_warning_score"),
        *[F.count_if(risk == n).alias(f"{n.lower()}_count") for n in risks],
        *[_share(risk == n).alias(f"{n.lower()}_ratio") for n in risks],
        F.avg(finite_or("rolling_anomaly_mean", 0.0)).alias("average_rolling_anomaly_mean"),
        F.avg(finite_or("positive_rolling_anomaly_slope", 0.0)).alias("average_positive_rolling_slope"),
    )
    return base.join(_mode(df, "dominant_detector", "dominant_detector"), "split", "left") if "dominant_detector" in df.columns else base


def _by_split(column: str, split: str) -> Column:
    return F.max(F.when(F.col("split") == split, F.col(column)))


def anomaly_summary(metrics: DataFrame) -> DataFrame:
    """Means over splits and the test-to-dev ratio of alert shares."""
    dev, test = _by_split("anomaly_alert_ratio", DEV), F.coalesce(_by_split("anomaly_alert_ratio", TEST), F.lit(0.0))
    return metrics.agg(
        F.avg("anomaly_alert_ratio").alias("average_anomaly_alert_ratio"),
        F.avg("average_final_anomaly_score").alias("average_final_anomaly_score"),
        F.avg("average_early_warning_score").alias("average_early_warning_score"),
        F.when(dev > 0, test / dev).alias("test_vs_dev_alert_ratio_multiplier"),
    )


def health_metrics(
    df: DataFrame,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Index, state, smoothness, trend and priority figures per split."""
    x = in_blocks(
        df.withColumn("_health", finite_or("health_index", 0.0)), 1,
        lambda d, w: d.withColumn("_delta", difference("_health", w)), keys, seq, block_rows)
    h = clip("_health", 0.0, 100.0)
    move = F.avg(F.abs("_delta"))
    state, trend, prio = F.col("health_state"), F.col("health_trend_label"), F.col("inspection_priority")
    states = ("Healthy", "Degrading", "Warning", "Critical")
    return x.groupBy("split").agg(
        F.count(F.lit(1)).alias("row_count"),
        F.avg(h).alias("average_health_index"),
        F.stddev_pop(h).alias("std_health_index"),
        F.min(h).alias("min_health_index"),
        F.max(h).alias("max_health_index"),
        F.avg(finite_or("final_anomaly_score", 0.0)).alias("average_final_anomaly_score"),
        F.avg(finite_or("residual_trend_score", 0.0)).alias("average_residual_trend_score"),
        F.avg(finite_or("anomaly_persistence_score", 0.0)).alias("average_anomaly_persistence_score"),
        (1.0 / (1.0 + move)).alias("health_trend_smoothness"),
        move.alias("mean_abs_health_delta"),
        _share(F.col("_delta") <= 0.0).alias("health_deterioration_consistency"),
        *[F.count_if(state == s).alias(f"{s.lower()}_count") for s in states],
        *[_share(state == s).alias(f"{s.lower()}_ratio") for s in states],
        *[_share(trend == s).alias(f"{s.lower()}_trend_ratio") for s in ("Stable", "Deteriorating", "Recovering")],
        F.avg(finite_or("health_deterioration_score", 0.0)).alias("average_health_deterioration_score"),
        F.avg(finite_or("health_index_delta", 0.0)).alias("average_health_index_delta"),
        *[_share(prio == s).alias(f"{s.lower()}_priority_ratio") for s in ("Routine", "Low", "Medium", "High")],
    )


def health_correlations(df: DataFrame, channels: Sequence[str], health: str = "health_index") -> DataFrame:
    """Correlation of health with each channel per split; 0 when either is flat."""
    x = finite_or(health, 0.0)
    out = []
    for c in channels:
        r = safe_corr(x, finite_or(c, 0.0))
        out.append(F.coalesce(r, F.lit(0.0)).alias(f"correlation_health_index_{c}"))
    return df.groupBy("split").agg(*out)


def health_evaluation_summary(metrics: DataFrame) -> DataFrame:
    """Health drop from dev to test and the ratio of critical shares."""
    dev_critical, test_critical = _by_split("critical_ratio", DEV), _by_split("critical_ratio", TEST)
    return metrics.agg(
        F.avg("health_trend_smoothness").alias("average_health_trend_smoothness"),
        F.avg("health_deterioration_consistency").alias("average_health_deterioration_consistency"),
        F.avg("average_health_index").alias("average_health_index"),
        (_by_split("average_health_index", DEV) - _by_split("average_health_index", TEST)).alias("health_drop_test_vs_dev"),
        F.when(dev_critical > 0, test_critical / dev_critical).alias("test_vs_dev_critical_multiplier"),
    )


def cluster_quality(df: DataFrame, features: Sequence[str], label: str, by: str = "split") -> DataFrame:
    """Silhouette and Davies-Bouldin index per split, over all rows.

    The silhouette uses squared Euclidean distance, whose mean to a cluster follows from
    the cluster's size, mean and mean squared norm. No pairs of rows are formed.
    """
    xs = [F.col(f).cast("double") for f in features]
    rows = df.where(F.col(label).isNotNull()).select(by, F.col(label).alias("_own"), *[x.alias(f"_x{i}") for i, x in enumerate(xs)])
    dims = [f"_x{i}" for i in range(len(xs))]
    rows = rows.dropna(subset=dims)
    norm = sum([F.col(d) * F.col(d) for d in dims[1:]], F.col(dims[0]) * F.col(dims[0]))
    clusters = rows.groupBy(by, "_own").agg(
        F.count(F.lit(1)).alias("_n"), F.avg(norm).alias("_sq"), *[F.avg(d).alias(f"_m{i}") for i, d in enumerate(dims)])
    table = clusters.groupBy(by).agg(
        F.collect_list(F.struct("_own", "_n", "_sq", F.array(*[f"_m{i}" for i in range(len(dims))]).alias("_m"))).alias("_clusters"))
    # one list entry per cluster of a split: bounded by the number of clusters
    x = lookup_join(rows, table, [by]).withColumn("_norm", norm)

    def mean_distance(c: Column) -> Column:
        dot = sum([F.col(d) * c["_m"][i] for i, d in enumerate(dims[1:], 1)], F.col(dims[0]) * c["_m"][0])
        return F.greatest(F.col("_norm") - 2.0 * dot + c["_sq"], F.lit(0.0))

    own = F.filter("_clusters", lambda c: c["_own"] == F.col("_own"))[0]
    others = F.filter("_clusters", lambda c: c["_own"] != F.col("_own"))
    a = mean_distance(own) * own["_n"] / F.greatest(own["_n"] - 1, F.lit(1))
    b = F.array_min(F.transform(others, mean_distance))
    s = F.when(own["_n"] <= 1, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(b - a, F.greatest(a, b)), F.lit(0.0)))
    gap = F.sqrt(sum([(F.col(d) - own["_m"][i]) * (F.col(d) - own["_m"][i]) for i, d in enumerate(dims[1:], 1)],
                     (F.col(dims[0]) - own["_m"][0]) * (F.col(dims[0]) - own["_m"][0])))
    scored = x.select(by, "_own", s.alias("_s"), gap.alias("_gap"))
    per_cluster = scored.groupBy(by, "_own").agg(F.sum("_s").alias("_ssum"), F.count(F.lit(1)).alias("_n"), F.avg("_gap").alias("_spread"))
    withm = per_cluster.join(clusters.drop("_n", "_sq"), [by, "_own"])
    left, right = withm.alias("l"), withm.alias("r")
    between = F.sqrt(sum([(F.col(f"l._m{i}") - F.col(f"r._m{i}")) ** 2 for i in range(1, len(dims))],
                         (F.col("l._m0") - F.col("r._m0")) ** 2))
    # clusters against clusters, not rows
    ratio = left.join(right, (F.col(f"l.{by}") == F.col(f"r.{by}")) & (F.col("l._own") != F.col("r._own"))).select(
        F.col(f"l.{by}").alias(by), F.col("l._own").alias("_own"),
        F.when(between > 0, (F.col("l._spread") + F.col("r._spread")) / between).otherwise(0.0).alias("_ratio"))
    worst = ratio.groupBy(by, "_own").agg(F.max("_ratio").alias("_worst")).groupBy(by).agg(F.avg("_worst").alias("davies_bouldin"))
    return per_cluster.groupBy(by).agg(
        F.sum("_n").alias("rows_used"), (F.sum("_ssum") / F.sum("_n")).alias("silhouette"), F.count(F.lit(1)).alias("clusters"),
    ).join(worst, by, "left").select(
        by, "rows_used", "clusters",
        F.when(F.col("clusters") < 2, 0.0).otherwise(F.col("silhouette")).alias("silhouette"),
        F.coalesce("davies_bouldin", F.lit(0.0)).alias("davies_bouldin"))


def context_metrics(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Quality of both clusterings, mean confidence and mean log-likelihood per split."""
    km = cluster_quality(df, features, "kmeans_context_id").select(
        "split", F.col("rows_used").alias("rows_seen"), F.col("silhouette").alias("kmeans_silhouette"), F.col("davies_bouldin").alias("kmeans_davies_bouldin"))
    gm = cluster_quality(df, features, "gmm_context_id").select(
        "split", F.col("silhouette").alias("gmm_silhouette"), F.col("davies_bouldin").alias("gmm_davies_bouldin"))
    means = df.groupBy("split").agg(
        F.avg("context_confidence").alias("average_context_confidence"),
        F.avg("gmm_log_likelihood").alias("gmm_average_log_likelihood"))
    return km.join(gm, "split").join(means, "split")


def reasoning_metrics(df: DataFrame) -> DataFrame:
    """Stability of the leading sensor, completeness, recurrence and modal pattern per split."""
    sensors = df.groupBy("split", "top_sensor_1").agg(F.count(F.lit(1)).alias("_n"))
    stability = sensors.where("top_sensor_1 is not null").groupBy("split").agg((F.max("_n") / F.sum("_n")).alias("top_sensor_stability"))
    shares = df.groupBy("split").agg(
        F.avg(F.col("inspection_focus").isNotNull().cast("double")).alias("inspection_focus_completeness"),
        (_share(F.col("root_cause_recurrence_status") == "Recurring") if "root_cause_recurrence_status" in df.columns else F.lit(0.0)).alias("recurrence_ratio"),
        F.lit(1.0 if "temporal_pattern" in df.columns else 0.0).alias("temporal_reasoning_available"),
    )
    return stability.join(shares, "split").join(_mode(df, "root_cause_pattern", "dominant_root_cause_pattern"), "split", "left")


def explanation_metrics(df: DataFrame, attribution: bool = False, ranking: bool = False) -> DataFrame:
    """Completeness of explanation rows per split."""
    filled = [F.avg(F.col(c).isNotNull().cast("double")) if c in df.columns else F.lit(0.0) for c in EXPLANATION_COLUMNS]
    tops = F.col("top_sensor_1").isNotNull() & F.col("top_sensor_2").isNotNull() & F.col("top_sensor_3").isNotNull()
    return df.groupBy("split").agg(
        (sum(filled[1:], filled[0]) / float(len(filled))).alias("explanation_completeness_score"),
        _share(F.length("explanation_text") > 20).alias("explanation_text_availability"),
        _share(tops).alias("top_sensor_explanation_availability"),
        F.lit(attribution).alias("shap_available"),
        F.lit(ranking).alias("sensor_residual_ranking_available"),
    )
