"""Prediction residuals, their rolling features and their validation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.functions.channels import require_columns
from fleetpulse.functions.exprs import is_finite
from fleetpulse.operators.ordering import difference, in_blocks, trailing
from fleetpulse.settings import BLOCK_ROWS, ROLLING_ROWS, SEQ, TRAJECTORY

# Fixed value: largest accepted difference between stored and recomputed numbers.
TOLERANCE = 1e-5


def residual_feature_names(sensor: str, rows: int = ROLLING_ROWS) -> tuple[str, str, str, str]:
    return (
        f"resfeat_residual_{sensor}_rolling_mean_{rows}",
        f"resfeat_residual_{sensor}_rolling_std_{rows}",
        f"resfeat_residual_{sensor}_trend",
        f"resfeat_abs_residual_{sensor}_rolling_mean_{rows}",
    )


def residuals(df: DataFrame, sensors: Sequence[str], prefix: str = "ensemble_predicted_") -> DataFrame:
    """Actual minus predicted, and its absolute value, per sensor."""
    require_columns(df, [*sensors, *[f"{prefix}{s}" for s in sensors]])
    out: dict[str, Column] = {}
    for s in sensors:
        gap = F.col(s) - F.col(f"{prefix}{s}")
        out[f"residual_{s}"] = gap
        out[f"abs_residual_{s}"] = F.abs(gap)
    return df.withColumns(out)


def _features(x: DataFrame, w, sensors: Sequence[str], rows: int, tag: str = "") -> DataFrame:
    frame = trailing(w, rows)
    cols: dict[str, Column] = {}
    for s in sensors:
        mean, std, trend, amean = residual_feature_names(s, rows)
        cols[mean + tag] = F.avg(f"residual_{s}").over(frame)
        cols[std + tag] = F.coalesce(F.stddev_samp(f"residual_{s}").over(frame), F.lit(0.0))
        cols[trend + tag] = difference(f"residual_{s}", w)
        cols[amean + tag] = F.avg(f"abs_residual_{s}").over(frame)
    return x.withColumns(cols)


def residual_features(
    df: DataFrame,
    sensors: Sequence[str],
    rows: int = ROLLING_ROWS,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Rolling mean, deviation and change of residuals, rolling mean of absolute residuals."""
    return in_blocks(df, rows - 1, lambda x, w: _features(x, w, sensors, rows), keys, seq, block_rows)


def validate_residuals(
    df: DataFrame,
    source: DataFrame,
    sensors: Sequence[str],
    rows: int = ROLLING_ROWS,
    tolerance: float = TOLERANCE,
    prefix: str = "ensemble_predicted_",
    confidence: str | None = None,
) -> DataFrame:
    """Check table of a stored residual table against its source rows.

    Copies, formulas and rolling features are recomputed; one row per check with the
    largest error, then residual size per split. ``source`` holds the actual sensors, the
    predictions and, when named, the context confidence, on the same row keys.
    """
    keys = [*TRAJECTORY, SEQ]
    feature_names = [n for s in sensors for n in residual_feature_names(s, rows)]
    copied = [*sensors, *[f"{prefix}{s}" for s in sensors], *([confidence] if confidence else [])]
    again = in_blocks(df, rows - 1, lambda x, w: _features(x, w, sensors, rows, "__again"))

    def worst(pairs: Sequence[tuple[Column, Column]]) -> Column:
        gaps = [F.coalesce(F.abs(a - b), F.lit(float("inf"))) for a, b in pairs]
        return F.greatest(*gaps) if len(gaps) > 1 else gaps[0]

    c = F.col
    copies: list[tuple[str, Column]] = [
        ("actual_xs_copy", worst([(c(s), c(f"{s}__source")) for s in sensors])),
        ("ensemble_prediction_copy", worst([(c(prefix + s), c(f"{prefix}{s}__source")) for s in sensors])),
    ]
    if confidence:
        copies.append(("context_confidence_copy", worst([(c(confidence), c(f"{confidence}__source"))])))
    checks: list[tuple[str, Column]] = [
        ("residual_formula", worst([(c(f"residual_{s}"), c(s) - c(prefix + s)) for s in sensors])),
        ("abs_residual_formula", worst([(c(f"abs_residual_{s}"), F.abs(c(f"residual_{s}"))) for s in sensors])),
    ]
    kinds = ("resfeat_rolling_mean", "resfeat_rolling_std", "resfeat_trend", "resfeat_abs_rolling_mean")
    for i, kind in enumerate(kinds):
        names = [residual_feature_names(s, rows)[i] for s in sensors]
        checks.append((kind, worst([(c(n), c(n + "__again")) for n in names])))
    numeric = [f"residual_{s}" for s in sensors] + [f"abs_residual_{s}" for s in sensors] + feature_names
    bad = sum([(~is_finite(n)).cast("long") for n in numeric[1:]], (~is_finite(numeric[0])).cast("long"))
    squares = sum([c(f"residual_{s}") ** 2 for s in sensors[1:]], c(f"residual_{sensors[0]}") ** 2)
    sizes = sum([c(f"abs_residual_{s}") for s in sensors[1:]], c(f"abs_residual_{sensors[0]}"))
    # what needs no source row is one number per row before the join, which then moves the copied columns and these
    own = again.select(
        *keys, *copied, *[e.alias(f"__{n}") for n, e in checks], bad.alias("__bad"), sizes.alias("__abs"), squares.alias("__sq"))
    both = own.join(source.select(*keys, *[F.col(x).alias(f"{x}__source") for x in copied]), keys, "left")
    per_split = both.groupBy("split").agg(
        *[F.max(e).alias(n) for n, e in copies], *[F.max(f"__{n}").alias(n) for n, _ in checks],
        F.sum("__bad").cast("double").alias("finite_numeric_values"),
        F.sum("__abs").alias("_abs"), F.sum("__sq").alias("_sq"), F.count(F.lit(1)).alias("_n"),
    )
    names = [*(n for n, _ in copies[:2]), *(n for n, _ in checks[:2]), *(n for n, _ in copies[2:]), *(n for n, _ in checks[2:])]
    total = per_split.agg(
        *[F.max(n).alias(n) for n in names], F.sum("finite_numeric_values").alias("finite_numeric_values"), F.sum("_n").alias("_n"))
    rows_out = [F.struct(F.lit(n).alias("check_name"), c(n).alias("max_error"), F.lit(tolerance).alias("tolerance")) for n in names]
    rows_out.append(F.struct(F.lit("finite_numeric_values").alias("check_name"), c("finite_numeric_values").alias("max_error"), F.lit(0.0).alias("tolerance")))
    passed = F.when(c("max_error") <= c("tolerance"), "PASSED").otherwise("FAILED")
    values = c("_n") * len(sensors)
    info = per_split.select(
        F.concat("split", F.lit("_residual_magnitude_summary")).alias("check_name"),
        F.lit("INFO").alias("status"),
        F.sqrt(c("_sq") / values).alias("max_error"),
        F.lit(0.0).alias("tolerance"),
        (c("_abs") / values).alias("mean_abs_residual"),
        values.cast("long").alias("values_checked"),
    )
    head = total.select("_n", F.inline(F.array(*rows_out))).select(
        "check_name", passed.alias("status"), "max_error", "tolerance",
        F.lit(None).cast("double").alias("mean_abs_residual"), values.cast("long").alias("values_checked"),
    )
    return head.unionByName(info)
