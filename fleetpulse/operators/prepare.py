"""Cleaning, trajectory features and scaling."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetpulse.functions.channels import numeric_columns, require_columns
from fleetpulse.functions.exprs import finite_or
from fleetpulse.functions.quantiles import exact_quantiles
from fleetpulse.operators.ordering import difference, in_blocks, lookup_join, small_table, trailing
from fleetpulse.settings import BLOCK_ROWS, DEV, ROLLING_ROWS, SEQ, SEQUENCE_ROWS, TRAJECTORY

KEY_COLUMNS = ("split", "unit_id", "cycle", "seq")


def _doubles(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]


def infinite_to_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """NaN and infinities become NULL."""
    columns = _doubles(df) if columns is None else columns
    return df.withColumns({c: finite_or(c, None) for c in columns})


def _whole(c: str, default: int, kind: str) -> Column:
    """Integer part of a number or numeric text, or the default."""
    number = finite_or(F.col(c).cast("string").try_cast("double"), None)
    return F.coalesce(number.cast("long"), F.lit(default).cast("long")).cast(kind)


def coerce_metadata(df: DataFrame) -> DataFrame:
    """Bad unit ids become 1, bad cycles 0; the split becomes text."""
    require_columns(df, ("unit_id", "cycle", "split"))
    return df.withColumns({
        "unit_id": _whole("unit_id", 1, "long"),
        "cycle": _whole("cycle", 0, "int"),
        "split": F.col("split").cast("string"),
    })


def _medians(df: DataFrame, columns: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Medians of several columns per group: one row per group, one column per channel."""
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in columns]))
    long = exact_quantiles(df.select(*by, cells), "_value", [0.5], by=[*by, "_column"])
    return long.groupBy(*by).agg(*[F.max(F.when(F.col("_column") == c, F.col("quantile"))).alias(f"{c}__median") for c in columns])


def impute_numeric(df: DataFrame, columns: Sequence[str] | None = None, split: str = "split") -> DataFrame:
    """Missing numbers become the split's median, else the median after that fill, else 0.

    All columns with gaps share their passes over the data.
    """
    if columns is None:
        columns = [c for c in numeric_columns(df) if c not in KEY_COLUMNS]
    if not columns:
        return df
    holes = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
    gaps = [c for c in columns if holes[c]]
    if not gaps:
        return df
    medians, _ = small_table(_medians(df, gaps, [split]))
    out = lookup_join(df, medians, [split]).withColumns({c: F.coalesce(c, f"{c}__median") for c in gaps})
    out = out.select(*df.columns)
    # a gap can only remain where a split had no value at all
    left = out.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in gaps]).first()
    rest = [c for c in gaps if left[c]]
    if not rest:
        return out
    found = _medians(out, rest, []).first()
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(found[f"{c}__median"]).cast("double"), F.lit(0.0)) for c in rest})


def impute_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing text becomes 'unknown'."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna("unknown", subset=list(columns))


def constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per numeric column: smallest and largest value and whether it is constant."""
    if columns is None:
        columns = [c for c in numeric_columns(df) if c not in KEY_COLUMNS]
    one = df.agg(*[F.min(c).cast("double").alias(f"{c}__lo") for c in columns],
                 *[F.max(c).cast("double").alias(f"{c}__hi") for c in columns])
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__lo").alias("low"), F.col(f"{c}__hi").alias("high"))
             for c in columns]
    return one.select(F.inline(F.array(*parts))).withColumn(
        "is_constant", F.coalesce(F.col("low") == F.col("high"), F.lit(True)))


def drop_constant_columns(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Remove numeric columns with at most one distinct value, over both splits."""
    flat = [r["column_name"] for r in constant_columns(df, columns).where("is_constant").collect()]
    return df.drop(*flat)


def order_rows(df: DataFrame, partitions: int | None = None, order: Sequence[str] = ("split", "unit_id", "cycle")) -> DataFrame:
    """Rows laid out by split, unit and cycle in range partitions, sorted inside each."""
    extra = [SEQ] if SEQ in df.columns and SEQ not in order else []
    cols = [*order, *extra]
    spread = df.repartitionByRange(partitions, *cols) if partitions else df.repartitionByRange(*cols)
    return spread.sortWithinPartitions(*cols)


def clean(df: DataFrame) -> DataFrame:
    """All cleaning steps in order."""
    out = impute_text(impute_numeric(coerce_metadata(infinite_to_null(df))))
    return order_rows(drop_constant_columns(out))


def add_trajectory_index(df: DataFrame, seq: str = SEQ, first: int = 1) -> DataFrame:
    """Zero-based position, taken from the stored sequence number."""
    return df.withColumn("trajectory_index", (F.col(seq) - F.lit(first)).cast("long"))


def rolling_names(sensor: str, rows: int = ROLLING_ROWS) -> tuple[str, str, str]:
    return f"{sensor}_rolling_mean_{rows}", f"{sensor}_rolling_std_{rows}", f"{sensor}_trend"


def rolling_features(
    df: DataFrame,
    sensors: Sequence[str],
    rows: int = ROLLING_ROWS,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Trailing mean and sample deviation, and first difference, of each sensor."""

    def build(x: DataFrame, w):
        frame = trailing(w, rows)
        cols: dict[str, Column] = {}
        for s in sensors:
            mean, std, trend = rolling_names(s, rows)
            cols[mean] = F.avg(s).over(frame)
            cols[std] = F.coalesce(F.stddev_samp(s).over(frame), F.lit(0.0))
            cols[trend] = difference(s, w)
        return x.withColumns(cols)

    return in_blocks(df, rows - 1, build, keys, seq, block_rows)


def zero_fill(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-finite numbers become 0."""
    columns = _doubles(df) if columns is None else columns
    return df.withColumns({c: finite_or(c, 0.0) for c in columns})


def engineer(df: DataFrame, sensors: Sequence[str], rows: int = ROLLING_ROWS, **kw: object) -> DataFrame:
    """Trajectory index and rolling features of the sensors, then zero fill."""
    return zero_fill(rolling_features(add_trajectory_index(df), sensors, rows, **kw))


def sequence_index(
    df: DataFrame,
    size: int = SEQUENCE_ROWS,
    stride: int = 1,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    cycle: str = "cycle",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """First and last cycle and row number of every full window."""

    def build(x: DataFrame, w):
        return x.withColumns({
            "sequence_start_cycle": F.lag(cycle, size - 1).over(w),
            "start_row_index": F.lag(seq, size - 1).over(w),
        })

    out = in_blocks(df, size - 1, build, keys, seq, block_rows)
    full = F.col("start_row_index").isNotNull() & (F.pmod(F.col("start_row_index") - 1, F.lit(stride)) == 0)
    return out.where(full).select(
        *keys, "sequence_start_cycle", F.col(cycle).alias("sequence_end_cycle"),
        "start_row_index", F.col(seq).alias("end_row_index"),
        F.lit(size).alias("window_size"), F.lit(stride).alias("stride"),
    )


def sequences(
    df: DataFrame,
    columns: Sequence[str],
    size: int = SEQUENCE_ROWS,
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    stride: int = 1,
    keep_short: bool = False,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Each row's trailing window as one flat array, oldest row first."""

    def build(x: DataFrame, w):
        row = F.array(*[finite_or(c, 0.0) for c in columns])
        return x.withColumn("_row", row).withColumn("_rows", F.collect_list("_row").over(trailing(w, size))).drop("_row")

    out = in_blocks(df, size - 1, build, keys, seq, block_rows)
    full = F.size("_rows") == size
    if not keep_short:
        out = out.where(full & (F.pmod(F.col(seq) - size, F.lit(stride)) == 0))
    return out.withColumn("sequence", F.when(full, F.flatten("_rows"))).drop("_rows")


@dataclass(frozen=True)
class Standardizer:
    """Means and population deviations fitted on one split; deviation 0 counts as 1."""

    means: dict[str, float]
    stds: dict[str, float]

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(m)) / F.lit(self.stds[c]) for c, m in self.means.items()
        })


def fit_standardizer(df: DataFrame, columns: Sequence[str], fit_split: str | None = DEV) -> Standardizer:
    """One aggregation over the fit split."""
    rows = df if fit_split is None else df.where(F.col("split") == fit_split)
    stats = rows.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    ).first()
    means = {c: float(stats[f"{c}__mean"] or 0.0) for c in columns}
    stds = {c: float(stats[f"{c}__std"] or 0.0) or 1.0 for c in columns}
    return Standardizer(means, stds)


def standardize(df: DataFrame, columns: Sequence[str], fit_split: str | None = DEV) -> DataFrame:
    return fit_standardizer(df, columns, fit_split).transform(df)
