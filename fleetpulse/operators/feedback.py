"""Operator feedback, alert memory and threshold adaptation."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetpulse.functions.exprs import finite_or
from fleetpulse.operators.anomaly import GLOBAL
from fleetpulse.operators.ordering import number_rows, small_table
from fleetpulse.settings import ALERT_LEVELS, FEEDBACK_LABELS, FEEDBACK_STEP

# Columns of the feedback log and of the alert memory.
FEEDBACK_COLUMNS = (
    "feedback_id", "timestamp_utc", "unit_id", "cycle", "context_id", "alert_level",
    "final_anomaly_score", "root_cause_pattern", "feedback_label", "feedback_status", "operator_note",
)
MEMORY_COLUMNS = (
    "unit_id", "cycle", "split", "context_id", "alert_level", "final_anomaly_score",
    "root_cause_pattern", "top_sensor_1", "top_sensor_2", "top_sensor_3", "feedback_status",
)
NO_FEEDBACK = "no_feedback"
STORED, USED = "stored", "used_for_threshold_adaptation"
# Smallest threshold, and how far a level is lifted above one that passed it.
FLOOR = 1e-9
REPAIR = 1.05
LEVELS = ("watch", "warning", "critical")


def check_labels(records: DataFrame) -> None:
    bad = records.where(~F.coalesce(F.col("feedback_label").isin(*FEEDBACK_LABELS), F.lit(False)))
    wrong = bad.select("feedback_label").distinct().limit(5).collect()
    if wrong:
        raise ValueError(f"unknown feedback labels: {[r[0] for r in wrong]}; allowed: {FEEDBACK_LABELS}")


def number_feedback(records: DataFrame, last_id: int, order: Sequence[str], bucket: Column | Sequence[Column], at: Column | None = None) -> DataFrame:
    """New log rows with ids after ``last_id`` in the given order."""
    numbered = number_rows(records, [], order, bucket, name="feedback_id", start=last_id + 1)
    return numbered.withColumns({
        "timestamp_utc": F.current_timestamp() if at is None else at,
        "feedback_status": F.lit(STORED),
        "operator_note": F.coalesce("operator_note", F.lit("")) if "operator_note" in records.columns else F.lit(""),
    }).select(*FEEDBACK_COLUMNS)


def last_feedback_id(log: DataFrame) -> int:
    return int(log.agg(F.max(F.col("feedback_id").cast("long"))).first()[0] or 0)


def stored_log(spark: SparkSession, path: str) -> DataFrame | None:
    """The log at ``path`` with its folder as ``batch``, or None if nothing is there yet."""
    try:
        return spark.read.option("basePath", path).parquet(path).withColumn("batch", F.col("batch").cast("string"))
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def store_feedback(
    spark: SparkSession, path: str, records: DataFrame, order: Sequence[str], bucket: Column | Sequence[Column], batch: str | None = None,
) -> DataFrame:
    """Add checked records to the log at ``path`` as one folder and return the whole log.

    The folder is named by ``batch``; storing a batch again replaces it and keeps its ids. Ids go on
    after the largest of the other batches. Where two writers took the same ids at once, the one of
    the larger name sees it after writing and numbers its rows again.
    """
    check_labels(records)
    batch = batch or uuid.uuid4().hex
    place = f"{path}/batch={batch}"
    log = stored_log(spark, path)
    own = log.where(F.col("batch") == batch).agg(F.min("feedback_id")).first()[0] if log is not None else None
    last = own - 1 if own is not None else 0 if log is None else last_feedback_id(log)
    number_feedback(records, last, order, bucket).write.mode("overwrite").parquet(place)
    while True:
        log = stored_log(spark, path)
        ranges = {r["batch"]: (r["a"], r["b"]) for r in log.groupBy("batch").agg(F.min("feedback_id").alias("a"), F.max("feedback_id").alias("b")).collect()}
        if batch not in ranges:
            break  # no records
        a, b = ranges.pop(batch)
        if not any(name < batch and x <= b and y >= a for name, (x, y) in ranges.items()):
            break
        last = max(y for _, y in ranges.values())
        number_feedback(records, last, order, bucket).write.mode("overwrite").parquet(place)
    return log.drop("batch")


def mark_used(log: DataFrame, last_id: Column | int | None = None) -> DataFrame:
    """The log after an adaptation: the rows up to ``last_id`` (all by default) are marked as used."""
    used = F.lit(True) if last_id is None else F.col("feedback_id") <= last_id
    return log.withColumn("feedback_status", F.when(used, F.lit(USED)).otherwise(F.col("feedback_status")))


def latest_feedback(log: DataFrame, order: Sequence[str] = ("feedback_id",), value: str = "feedback_label") -> DataFrame:
    """Last feedback of each unit, cycle and context; rows without a usable key are skipped."""
    keyed = log.select(
        F.col("unit_id").cast("string").try_cast("double").cast("long").alias("unit_id"),
        F.col("cycle").cast("string").try_cast("double").cast("int").alias("cycle"),
        F.col("context_id").cast("string").try_cast("double").cast("int").alias("context_id"),
        F.col(value).alias("_value"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
    ).where("unit_id is not null and cycle is not null and context_id is not null")
    by = F.struct(*[f"_o{i}" for i in range(len(order))])
    return keyed.groupBy("unit_id", "cycle", "context_id").agg(F.max_by("_value", by).alias("feedback_status"))


def with_feedback(df: DataFrame, latest: DataFrame, context: str = "gmm_context_id") -> DataFrame:
    """Each row's feedback status by unit, cycle and context, or ``no_feedback``."""
    right = latest.select(
        F.col("unit_id").alias("_u"), F.col("cycle").alias("_c"), F.col("context_id").alias("_x"),
        F.col("feedback_status").alias("_status"))
    same = (
        (F.col("unit_id") == F.col("_u")) & (F.col("cycle") == F.col("_c"))
        & (F.coalesce(F.col(context), F.lit(-1)) == F.col("_x"))
    )
    base = df.drop("feedback_status")
    return base.join(right, same, "left").withColumn(
        "feedback_status", F.coalesce("_status", F.lit(NO_FEEDBACK))).drop("_u", "_c", "_x", "_status")


def resolve_context(df: DataFrame, candidates: Sequence[str] = ("gmm_context_id", "context_id")) -> Column:
    """The first context column the table has, or -1."""
    for c in candidates:
        if c in df.columns:
            return F.coalesce(F.col(c).cast("int"), F.lit(-1))
    return F.lit(-1)


def alert_memory(df: DataFrame, latest: DataFrame | None = None) -> DataFrame:
    """Alert rows only, with root cause and feedback status."""
    rows = df.where(F.col("alert_level").isin(*[n for n, _ in ALERT_LEVELS])).withColumn("context_id", resolve_context(df))
    names = ["root_cause_pattern", "top_sensor_1", "top_sensor_2", "top_sensor_3"]
    rows = rows.withColumns({n: F.coalesce(n, F.lit("unknown")) if n in df.columns else F.lit("unknown") for n in names})
    rows = rows.withColumn("final_anomaly_score", finite_or("final_anomaly_score", 0.0))
    if latest is None:
        rows = rows.withColumn("feedback_status", F.lit(NO_FEEDBACK))
    else:
        rows = with_feedback(rows, latest, "context_id")
    return rows.select(*MEMORY_COLUMNS)


def refresh_memory(memory: DataFrame, latest: DataFrame) -> DataFrame:
    return with_feedback(memory, latest, "context_id").select(*memory.columns)


def step_factors(step: float = FEEDBACK_STEP) -> dict[str, float]:
    return {
        "accepted_alert": 1.0,
        "rejected_false_alarm": 1.0 + step,
        "missed_anomaly": 1.0 - step,
        "uncertain": 1.0,
    }


def known_thresholds(thresholds: DataFrame) -> DataFrame:
    known = small_table(thresholds)[0]
    if known.where(F.col("context_id") == GLOBAL).isEmpty():
        raise ValueError("global thresholds are missing")
    return known


def replay_state(
    known: DataFrame, log: DataFrame, order: str = "feedback_id", step: float = FEEDBACK_STEP, block_rows: int = 65_536,
) -> DataFrame:
    """What a stretch of the log does to the thresholds of each context: ``context_id, total, low, first, used, last``.

    Each label multiplies all three levels by one factor and holds them above a floor, so a replay is
    a running product with a lower bound. ``total`` is the logarithm of the product, ``low`` that of
    the smallest prefix, ``first`` the first factor, ``used`` the number of rows, ``last`` the largest
    place in the log. States of stretches that follow each other combine (``combined``). A stretch is
    cut into blocks of ``order``, whose states are combined as well.
    """
    factor: Column | None = None
    for label, f in step_factors(step).items():
        cond = F.col("feedback_label") == label
        factor = F.when(cond, F.lit(f)) if factor is None else factor.when(cond, F.lit(f))
    asked = F.coalesce(F.col("context_id").cast("int"), F.lit(-1)).cast("string")
    contexts = known.select(F.col("context_id").alias("_context")).distinct()
    used = (
        log.where(F.col("feedback_label").isin(*FEEDBACK_LABELS))
        .withColumn("_asked", asked).join(contexts, F.col("_asked") == F.col("_context"), "left")
        .select(F.coalesce("_context", F.lit(GLOBAL)).alias("context_id"),
                F.col(order).alias("_order"), factor.alias("_factor"),
                F.floor(F.col(order) / F.lit(block_rows)).cast("long").alias("_block"))
    )
    run = Window.partitionBy("context_id", "_block").orderBy("_order").rowsBetween(Window.unboundedPreceding, 0)
    blocks = (
        used.withColumn("_log", F.sum(F.ln("_factor")).over(run))
        .groupBy("context_id", "_block")
        .agg(F.max_by("_log", "_order").alias("total"), F.min("_log").alias("low"),
             F.min_by("_factor", "_order").alias("first"), F.count(F.lit(1)).alias("used"), F.max("_order").alias("last"))
    )
    return combined(blocks, "_block")


def combined(states: DataFrame, order: str) -> DataFrame:
    """One state per context from the states of its stretches, in the order of ``order``."""
    before = Window.partitionBy("context_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        states.withColumn("_before", F.coalesce(F.sum("total").over(before), F.lit(0.0)))
        .groupBy("context_id")
        .agg(F.sum("total").alias("total"), F.min(F.col("_before") + F.col("low")).alias("low"),
             F.min_by("first", order).alias("first"), F.sum("used").alias("used"), F.max("last").alias("last"))
    )


def apply_state(known: DataFrame, state: DataFrame) -> DataFrame:
    """The base thresholds after a replay: ``x * P`` or ``floor * P / min(prefix product)``, whichever is larger.

    Levels out of order are repaired after the first feedback; a common factor keeps the order later.
    """
    out = known.join(state.select("context_id", *[F.col(c).alias(f"_{c}") for c in ("total", "low", "first", "used")]), "context_id", "left").withColumns({
        "_first": F.coalesce("_first", F.lit(1.0)), "_total": F.coalesce("_total", F.lit(0.0)),
        "_low": F.coalesce("_low", F.lit(0.0)), "_used": F.coalesce("_used", F.lit(0)),
    })
    touched = F.col("_used") > 0
    out = out.withColumns({f"_{x}": F.greatest(F.col(x) * F.col("_first"), F.lit(FLOOR)) for x in LEVELS})
    out = out.withColumn("_warning", F.when(F.col("_watch") > F.col("_warning"), F.col("_watch") * REPAIR).otherwise(F.col("_warning")))
    out = out.withColumn("_critical", F.when(F.col("_warning") > F.col("_critical"), F.col("_warning") * REPAIR).otherwise(F.col("_critical")))
    rest = F.exp(F.col("_total") - F.ln("_first"))
    held = F.lit(FLOOR) * F.exp(F.col("_total") - F.col("_low"))
    return out.select(
        "context_id",
        *[F.when(touched, F.greatest(F.col(f"_{x}") * rest, held)).otherwise(F.col(x)).alias(x) for x in LEVELS],
        F.col("_used").cast("long").alias("feedback_records_used"),
    )


def adapt_thresholds(
    thresholds: DataFrame, log: DataFrame, order: str = "feedback_id", step: float = FEEDBACK_STEP, block_rows: int = 65_536,
) -> DataFrame:
    """Thresholds after replaying all feedback, always from the base thresholds."""
    known = known_thresholds(thresholds)
    return apply_state(known, replay_state(known, log, order, step, block_rows))


def submit_feedback(
    spark: SparkSession,
    log_path: str,
    records: DataFrame,
    memory: DataFrame,
    thresholds: DataFrame,
    order: Sequence[str],
    bucket: Column | Sequence[Column],
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Store feedback, refresh the alert memory, adapt the thresholds; returns both and the log with its used rows marked."""
    log = store_feedback(spark, log_path, records, order, bucket)
    return refresh_memory(memory, latest_feedback(log)), adapt_thresholds(thresholds, log), mark_used(log)
