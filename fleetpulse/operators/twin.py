"""Sensor prediction from operating conditions: the polynomial member, blend and comparison; ``trees`` has the others."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import PolynomialExpansion, VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from fleetpulse.functions.channels import twin_columns
from fleetpulse.functions.exprs import finite_or, safe_corr
from fleetpulse.settings import DEV, SEQ

ALL_SENSORS = "ALL_RAW_XS"
TARGET_TYPE = "raw_X_s_only"
HOLDOUT = 10


def polynomial(target: str, degree: int = 2) -> Estimator:
    """Least squares on all products of inputs up to a degree."""
    return Pipeline(stages=[
        PolynomialExpansion(degree=degree, inputCol="_features", outputCol="_poly"),
        LinearRegression(featuresCol="_poly", labelCol=target, solver="normal"),
    ])


def features_matrix(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Inputs with non-finite entries as 0, assembled into one vector column."""
    names = [f"_in_{f}" for f in features]
    clean = df.withColumns({n: finite_or(f, 0.0) for n, f in zip(names, features)})
    return VectorAssembler(inputCols=names, outputCol="_features").transform(clean).drop(*names)


@dataclass
class Twin:
    """One model per sensor under a column prefix."""

    prefix: str
    features: list[str]
    models: dict[str, Model] = field(default_factory=dict)

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``<prefix><sensor>`` for every sensor in one pass over the rows."""
        out = features_matrix(df, self.features)
        for sensor, model in self.models.items():
            out = model.transform(out).withColumnRenamed("prediction", f"{self.prefix}{sensor}")
            out = out.drop("_poly")
        return out.drop("_features")


def fit_twin(
    df: DataFrame,
    prefix: str,
    make,
    features: Sequence[str] | None = None,
    targets: Sequence[str] | None = None,
    fit_split: str = DEV,
) -> Twin:
    """Fit ``make(sensor)`` for every sensor on one split.

    The assembled training rows are kept for all sensors; blocks lost with an executor are
    recomputed from the source.
    """
    auto_features, auto_targets = twin_columns(df) if features is None or targets is None else ([], [])
    features, targets = list(features or auto_features), list(targets or auto_targets)
    rows = features_matrix(df.where(F.col("split") == fit_split), features).select(
        "_features", *[finite_or(t, 0.0).alias(t) for t in targets]).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Twin(prefix, features, {t: make(t).fit(rows) for t in targets})
    finally:
        rows.unpersist()


def holdout_mask(df: DataFrame, every: int = HOLDOUT, seq: str = SEQ, fit_split: str = DEV) -> DataFrame:
    """Mark every n-th row of the fit split as validation."""
    return df.withColumn("is_validation", (F.col("split") == fit_split) & (F.pmod(F.col(seq), F.lit(every)) == 0))


def blend_weights(df: DataFrame, sensors: Sequence[str], prefixes: Mapping[str, str], fit_split: str = DEV) -> DataFrame:
    """Pooled error of each member over all sensors and its inverse-error weight."""
    aggs: list[Column] = []
    for name, prefix in prefixes.items():
        squares = [(F.col(s) - F.col(f"{prefix}{s}")) ** 2 for s in sensors]
        aggs.append(F.sum(sum(squares[1:], squares[0])).alias(f"{name}__sq"))
    one = df.where(F.col("split") == fit_split).agg(F.count(F.lit(1)).alias("_n"), *aggs)
    rows = [
        F.struct(F.lit(m).alias("model"), F.sqrt(F.col(f"{m}__sq") / (F.col("_n") * len(sensors))).alias("dev_rmse"))
        for m in prefixes
    ]
    long = one.select(F.inline(F.array(*rows)))
    inverse = 1.0 / F.greatest(F.col("dev_rmse"), F.lit(1e-9))
    # one row per member
    return long.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy(F.lit(0))))


def weights_from_errors(errors: Mapping[str, float]) -> dict[str, float]:
    inverse = {k: 1.0 / max(v, 1e-9) for k, v in errors.items()}
    total = math.fsum(inverse.values())
    return {k: v / total for k, v in inverse.items()}


def blend(df: DataFrame, sensors: Sequence[str], prefixes: Mapping[str, str], weights: Mapping[str, float], out: str = "ensemble_predicted_") -> DataFrame:
    """Weighted sum of the members' predictions per sensor."""
    total = sum(weights[m] for m in prefixes)
    cols: dict[str, Column] = {}
    for s in sensors:
        terms = [F.lit(weights[m] / total) * F.col(f"{p}{s}") for m, p in prefixes.items()]
        cols[f"{out}{s}"] = sum(terms[1:], terms[0])
    return df.withColumns(cols)


def compare_models(df: DataFrame, sensors: Sequence[str], prefixes: Mapping[str, str]) -> DataFrame:
    """Errors and explained variance per split, sensor and model, and means over sensors.

    Sums for all sensors and models come from one aggregation over wide rows, so rows are
    not multiplied by sensors and models before the shuffle.
    """
    aggs: list[Column] = []
    for i, s in enumerate(sensors):
        aggs += [F.sum(s).alias(f"y{i}"), F.sum(F.col(s) * F.col(s)).alias(f"yy{i}")]
        for m, p in prefixes.items():
            e = F.col(s) - F.col(f"{p}{s}")
            aggs += [F.sum(F.abs(e)).alias(f"a{i}_{m}"), F.sum(e * e).alias(f"q{i}_{m}")]
    wide = df.groupBy("split").agg(F.count(F.lit(1)).alias("count"), *aggs)
    parts = []
    for i, s in enumerate(sensors):
        spread = F.col(f"yy{i}") - F.col(f"y{i}") * F.col(f"y{i}") / F.col("count")
        for m in prefixes:
            r2 = F.when(F.abs(spread) < 1e-12, 0.0).otherwise(1.0 - F.col(f"q{i}_{m}") / spread)
            parts.append(F.struct(
                F.lit(s).alias("sensor"), F.lit(m).alias("model"),
                (F.col(f"a{i}_{m}") / F.col("count")).alias("mae"),
                F.sqrt(F.col(f"q{i}_{m}") / F.col("count")).alias("rmse"), r2.alias("r2")))
    each = wide.select("split", "count", F.inline(F.array(*parts)))
    every = each.groupBy("split", "model").agg(
        F.avg("mae").alias("mae"), F.avg("rmse").alias("rmse"), F.avg("r2").alias("r2"), F.sum("count").alias("count"),
    ).withColumn("sensor", F.lit(ALL_SENSORS))
    names = ["split", "sensor", "model", "mae", "rmse", "r2", "count"]
    return every.select(*names).unionByName(each.select(*names)).withColumns({
        "r2_percent": F.col("r2") * 100.0, "target_type": F.lit(TARGET_TYPE)})


def duplicate_channels(df: DataFrame, columns: Sequence[str], absolute: float = 1e-12, relative: float = 1e-5) -> DataFrame:
    """Pairs of channels with their largest gap and whether they agree on every row.

    The tolerance is ``absolute + relative * |second|``. Pairs are of columns, not rows.
    """
    aggs, parts = [], []
    for i, a in enumerate(columns):
        for b in columns[i + 1:]:
            gap = F.abs(F.col(a) - F.col(b))
            near = gap <= absolute + relative * F.abs(F.col(b))
            aggs += [F.max(gap).alias(f"{a}|{b}|gap"), F.bool_and(F.coalesce(near, F.lit(False))).alias(f"{a}|{b}|same")]
            parts.append(F.struct(F.lit(a).alias("first_sensor"), F.lit(b).alias("second_sensor"),
                                  F.col(f"`{a}|{b}|gap`").alias("max_gap"), F.col(f"`{a}|{b}|same`").alias("duplicate")))
    return df.agg(*aggs).select(F.inline(F.array(*parts)))


def top_correlations(df: DataFrame, features: Sequence[str], targets: Sequence[str], k: int = 5) -> DataFrame:
    """Features most correlated with each target, from one aggregation."""
    pairs = [(t, f) for t in targets for f in features]
    one = df.agg(*[safe_corr(f, t).alias(f"{t}|{f}") for t, f in pairs])
    long = one.select(F.inline(F.array(*[
        F.struct(F.lit(t).alias("target"), F.lit(f).alias("feature"), F.abs(F.col(f"`{t}|{f}`")).alias("abs_corr")) for t, f in pairs])))
    usable = long.where("abs_corr is not null")
    w = Window.partitionBy("target").orderBy(F.desc("abs_corr"), "feature")
    return usable.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
