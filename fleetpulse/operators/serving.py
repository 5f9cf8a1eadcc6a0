"""The wide serving table and the queries on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.channels import project
from fleetpulse.functions.exprs import finite_or
from fleetpulse.operators.explain import with_defaults
from fleetpulse.operators.feedback import FEEDBACK_COLUMNS, MEMORY_COLUMNS, with_feedback
from fleetpulse.operators.ordering import number_rows
from fleetpulse.settings import ALERT_LEVELS, FEEDBACK_LABELS, LOOKUP_ROWS, SEQ

MAX_RECORDS = 5_000
ALERTS = tuple(n for n, _ in ALERT_LEVELS)
STATES = ("Healthy", "Degrading", "Warning", "Critical")

# Columns of the serving table and the value of a missing one.
SERVING_COLUMNS = (
    "unit_id", "cycle", "split", "kmeans_context_id", "gmm_context_id", "context_confidence",
    "health_index", "remaining_health_percentage", "health_state", "final_anomaly_score",
    "alert_level", "anomaly_detected", "anomaly_status", "top_sensor_1", "top_sensor_2",
    "top_sensor_3", "contribution_1", "contribution_2", "contribution_3", "root_cause_pattern",
    "inspection_focus", "explanation_text", "model_agreement_score", "confidence_score",
    "uncertainty_score", "reliability_score", "feedback_status",
)
SERVING_DEFAULTS: Mapping[str, object] = {
    "kmeans_context_id": -1,
    "gmm_context_id": -1,
    "context_confidence": 0.0,
    "health_index": 100.0,
    "remaining_health_percentage": 100.0,
    "health_state": "Healthy",
    "final_anomaly_score": 0.0,
    "alert_level": "Normal",
    "top_sensor_1": "none",
    "top_sensor_2": "none",
    "top_sensor_3": "none",
    "contribution_1": 0.0,
    "contribution_2": 0.0,
    "contribution_3": 0.0,
    "root_cause_pattern": "normal_or_no_pattern",
    "inspection_focus": "No inspection focus available.",
    "explanation_text": "No anomaly explanation available.",
    "model_agreement_score": 0.0,
    "confidence_score": 0.0,
    "uncertainty_score": 1.0,
    "reliability_score": 0.0,
}

# Columns returned by the unit queries.
TREND_COLUMNS = (
    "unit_id", "cycle", "split", "health_index", "remaining_health_percentage", "health_state",
    "final_anomaly_score", "alert_level", "anomaly_detected", "anomaly_status", "confidence_score",
    "uncertainty_score", "reliability_score",
)
ANOMALY_COLUMNS = (
    "unit_id", "cycle", "split", "final_anomaly_score", "alert_level", "anomaly_detected",
    "anomaly_status", "health_index", "health_state", "confidence_score", "uncertainty_score",
    "reliability_score", "root_cause_pattern", "inspection_focus", "top_sensor_1", "top_sensor_2",
    "top_sensor_3", "contribution_1", "contribution_2", "contribution_3", "explanation_text",
    "feedback_status",
)
ROOT_COLUMNS = (
    "unit_id", "cycle", "split", "alert_level", "anomaly_detected", "anomaly_status",
    "final_anomaly_score", "health_index", "health_state", "top_sensor_1", "top_sensor_2",
    "top_sensor_3", "contribution_1", "contribution_2", "contribution_3", "root_cause_pattern",
    "inspection_focus", "explanation_text", "confidence_score", "uncertainty_score", "reliability_score",
)
CONFIDENCE_COLUMNS = (
    "unit_id", "cycle", "split", "model_agreement_score", "context_confidence", "confidence_score",
    "uncertainty_score", "reliability_score", "confidence_label", "uncertainty_label",
)
SEARCH_COLUMNS = (
    "unit_id", "cycle", "alert_level", "anomaly_status", "root_cause_pattern",
    "top_sensor_1", "top_sensor_2", "top_sensor_3",
)


def add_anomaly_fields(df: DataFrame) -> DataFrame:
    """Anomaly flag and status from the alert level, unless already present."""
    flag = F.coalesce(F.col("alert_level") != "Normal", F.lit(True))
    out = df if "anomaly_detected" in df.columns else df.withColumn("anomaly_detected", flag)
    if "anomaly_status" in out.columns:
        return out
    return out.withColumn("anomaly_status", F.when(F.col("anomaly_detected"), "Anomaly_Detected").otherwise("No_Anomaly"))


def serving_table(df: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """All serving columns of a joined row, defaults filled, feedback attached."""
    full = with_defaults(df.drop("anomaly_detected", "anomaly_status"), SERVING_DEFAULTS)
    full = add_anomaly_fields(full)
    if latest is None:
        full = full.withColumn("feedback_status", F.lit("no_feedback"))
    else:
        full = with_feedback(full, latest)
    extra = [SEQ] if SEQ in df.columns else []
    return full.select(*SERVING_COLUMNS, *extra)


def _mean(c: str) -> Column:
    return F.sum(finite_or(c, 0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))


def serving_summary(df: DataFrame) -> DataFrame:
    """Counts by alert, state, split and feedback, and overall figures, as name-value rows.

    One pass over the table with grouping sets.
    """
    counts = (
        df.groupingSets(
            [["alert_level"], ["health_state"], ["split"], ["feedback_status"], []],
            "alert_level", "health_state", "split", "feedback_status",
        )
        .agg(
            F.grouping_id().alias("_g"),
            F.count(F.lit(1)).alias("_n"), F.count_if(F.col("alert_level") != "Normal").alias("_a"),
            *[_mean(c).alias(f"_{c}") for c in ("health_index", "confidence_score", "uncertainty_score", "reliability_score")],
        )
    )
    labels = F.coalesce("alert_level", "health_state", "split", "feedback_status")
    # grouping_id has one bit per column, set where the column is not grouped
    kind = (F.when(F.col("_g") == 7, "alert_level").when(F.col("_g") == 11, "health_state")
            .when(F.col("_g") == 13, "split").when(F.col("_g") == 14, "feedback_status"))
    per_label = counts.where(F.col("_g") != 15).select(kind.alias("kind"), labels.alias("name"), F.col("_n").cast("double").alias("value"))
    n = F.col("_n").cast("double")
    totals = counts.where(F.col("_g") == 15).select(F.inline(F.array(*[
        F.struct(F.lit("overall").alias("kind"), F.lit(name).alias("name"), v.alias("value")) for name, v in (
            ("records_count", n), ("anomaly_records", F.col("_a").cast("double")), ("normal_records", n - F.col("_a")),
            ("anomaly_ratio", F.col("_a") / F.greatest(n, F.lit(1.0))),
            ("average_health_index", F.col("_health_index")),
            ("average_confidence_score", F.col("_confidence_score")),
            ("average_uncertainty_score", F.col("_uncertainty_score")),
            ("average_reliability_score", F.col("_reliability_score")),
        )
    ])))
    return per_label.unionByName(totals)


def latest_of_unit(df: DataFrame, unit: int) -> DataFrame:
    """Last row of one unit, with the number of its rows."""
    rows = df.where(F.col("unit_id") == unit)
    full = F.struct(*df.columns)
    one = rows.groupBy().agg(F.max_by(full, F.struct("cycle", SEQ)).alias("_r"), F.count(F.lit(1)).alias("matched_rows"))
    return one.where("matched_rows > 0").select("_r.*", "matched_rows")


def latest_of_every_unit(df: DataFrame) -> DataFrame:
    """First row of the highest cycle of each unit; reduced before the shuffle."""
    best = F.struct((-F.col("cycle").cast("long")).alias("c"), F.col(SEQ).alias("s"), F.col("split").alias("p"))
    return add_anomaly_fields(df).groupBy(F.col("unit_id").alias("_u")).agg(
        F.min_by(F.struct(*add_anomaly_fields(df).columns), best).alias("_r")).select("_r.*")


def _first_rows(df: DataFrame, columns: Sequence[str], limit: int) -> DataFrame:
    """First ``limit`` matches in row order, sorted by cycle; totals on every row."""
    total = df.groupBy().agg(F.count(F.lit(1)).alias("total_matching_records"))
    picked = project(add_anomaly_fields(df), ("unit_id", "cycle", SEQ), columns).orderBy("split", SEQ).limit(limit)
    out = picked.crossJoin(F.broadcast(total))
    return out.withColumn("truncated", F.col("total_matching_records") > limit).orderBy("cycle", "split", SEQ)


def health_trend_of_unit(df: DataFrame, unit: int, limit: int = MAX_RECORDS) -> DataFrame:
    return _first_rows(df.where(F.col("unit_id") == unit), TREND_COLUMNS, limit)


def anomalies_of_unit(df: DataFrame, unit: int, limit: int = MAX_RECORDS) -> DataFrame:
    return _first_rows(df.where((F.col("unit_id") == unit) & F.col("alert_level").isin(*ALERTS)), ANOMALY_COLUMNS, limit)


def confidence_of_unit(df: DataFrame, unit: int, limit: int = MAX_RECORDS) -> DataFrame:
    return _first_rows(df.where(F.col("unit_id") == unit), CONFIDENCE_COLUMNS, limit)


def root_cause_at(df: DataFrame, unit: int, cycle: int) -> DataFrame:
    """First row of a unit and cycle."""
    rows = df.where((F.col("unit_id") == unit) & (F.col("cycle") == cycle))
    return project(add_anomaly_fields(rows), ("unit_id", "cycle", SEQ), ROOT_COLUMNS).orderBy("split", SEQ).limit(1)


def fleet_summary(df: DataFrame) -> DataFrame:
    """One row of fleet-wide counts, ratio and means, in a single aggregation."""
    n = F.count(F.lit(1))
    anomalies = F.count_if(F.col("alert_level").isin(*ALERTS))
    return df.agg(
        *[F.count_if(F.col("alert_level") == a).alias(f"alert_{a.lower()}") for a in ("Normal", *ALERTS)],
        *[F.count_if(F.col("health_state") == s).alias(f"state_{s.lower()}") for s in STATES],
        anomalies.alias("anomaly_records"),
        (anomalies > 0).alias("anomaly_detected"),
        (anomalies / F.greatest(n, F.lit(1))).alias("anomaly_ratio"),
        n.alias("total_records"),
        F.countDistinct("unit_id").alias("unique_units"),
        *[_mean(c).alias(f"average_{c}") for c in ("health_index", "confidence_score", "uncertainty_score", "reliability_score")],
    )


def fleet_anomalies(memory: DataFrame, order: Sequence[str], limit: int = 500) -> DataFrame:
    """First alerts of the fleet in a stated order, with their number in all and whether some are left out."""
    bound = max(1, int(limit))
    total = memory.agg(F.count(F.lit(1)).alias("total_matching_records"))
    first = memory.orderBy(*order).limit(bound).crossJoin(F.broadcast(total))
    return first.withColumn("truncated", F.col("total_matching_records") > bound).orderBy(*order)


def feedback_history(log: DataFrame, limit: int = 500) -> DataFrame:
    """The last stored feedback rows, newest first, with totals."""
    bound = max(1, int(limit))
    total = log.groupBy().agg(F.count(F.lit(1)).alias("feedback_total_records"))
    last = project(log, ("feedback_id",), FEEDBACK_COLUMNS).orderBy(F.desc("feedback_id")).limit(bound)
    out = last.crossJoin(F.broadcast(total)).withColumn("feedback_truncated", F.col("feedback_total_records") > bound)
    return out.orderBy(F.desc("timestamp_utc"), F.desc("feedback_id"))


def recent_alerts(memory: DataFrame, order: Sequence[str], limit: int = 100) -> DataFrame:
    return project(memory, ("unit_id", "cycle"), MEMORY_COLUMNS).orderBy(*order).limit(max(1, int(limit)))


def search_alerts(df: DataFrame, alert: str | None = None, term: str = "", columns: Sequence[str] = SEARCH_COLUMNS) -> DataFrame:
    """Rows of one level (or all) where any searched column contains the text, in any case."""
    out = add_anomaly_fields(df)
    if alert is not None:
        out = out.where(F.col("alert_level") == alert)
    needle = term.strip().lower()
    if not needle:
        return out
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.contains(F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(needle))
    return out.where(hit)


def page(
    df: DataFrame,
    order: Sequence[str],
    number: int,
    size: int = 12,
    bucket: Column | Sequence[Column] | None = None,
    shallow_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """One page of ordered rows; a page past the end gives the last page.

    Early pages come from a top-k. Deep pages number the rows by ``bucket`` instead, the first
    order column if none is given, so that the rows before the page are never gathered in one place.
    """
    total = df.count()
    last = max(1, -(-total // size))
    first = (max(1, min(number, last)) - 1) * size
    if first + size <= shallow_rows:
        return df.orderBy(*order).offset(first).limit(size)
    numbered = number_rows(df, [], order, order[0] if bucket is None else bucket, name="_row", start=0)
    return numbered.where((F.col("_row") >= first) & (F.col("_row") < first + size)).drop("_row").orderBy(*order)


def chart_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket: Column | Sequence[Column], points: int = 400) -> DataFrame:
    """Evenly spaced rows per key, about ``points`` of them, always with the last row."""
    usable = df.where(F.col("cycle").isNotNull() & F.col("final_anomaly_score").isNotNull())
    numbered = number_rows(usable, keys, order, bucket, name="_row", start=0)
    sizes = usable.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    stride = F.greatest(F.lit(1), F.ceil(F.col("_n") / F.lit(float(points))))
    keep = (F.pmod(F.col("_row"), stride) == 0) | (F.col("_row") == F.col("_n") - 1)
    return numbered.join(sizes, list(keys)).where(keep).select(*keys, "cycle", "final_anomaly_score", "alert_level", "_row")


def facets(memory: DataFrame) -> DataFrame:
    """Distinct units, contexts, levels and patterns of the alert memory, as rows."""
    long = memory.select(F.inline(F.array(*[
        F.struct(F.lit(k).alias("facet"), F.col(c).cast("string").alias("value"))
        for k, c in (("units", "unit_id"), ("contexts", "context_id"), ("alertLevels", "alert_level"), ("patterns", "root_cause_pattern"))
    ])))
    return long.where("value is not null and value <> ''").distinct()


def label_counts(log: DataFrame) -> DataFrame:
    """Count of every allowed feedback label, also those never used."""
    return log.agg(*[F.count_if(F.col("feedback_label") == x).alias(x) for x in FEEDBACK_LABELS]).select(F.inline(F.array(*[
        F.struct(F.lit(x).alias("label"), F.col(x).alias("count")) for x in FEEDBACK_LABELS])))


def attribution_of_model(attribution: DataFrame, model: str) -> DataFrame:
    """Attribution rows of one model with finite values, largest first."""
    rows = attribution.where((F.col("model") == model) & finite_or("mean_abs_shap", None).isNotNull())
    return rows.orderBy(F.desc("mean_abs_shap"), "feature")


def top_counts(df: DataFrame, column: str, n: int) -> DataFrame:
    """The most frequent values of a column; equal counts in name order."""
    return df.groupBy(F.col(column).alias("name")).agg(F.count(F.lit(1)).alias("row_count")).orderBy(
        F.desc("row_count"), "name").limit(n)
