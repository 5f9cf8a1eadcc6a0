"""Exact percentiles without holding a group's values in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.functions.exprs import finite_or
from fleetpulse.operators.ordering import small_table
from fleetpulse.settings import LOOKUP_ROWS

ACCURACY = 10_000
BRACKET_ROWS = 200_000
SLICES = 4_096


def exact_quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    by: Sequence[str] = (),
    accuracy: int = ACCURACY,
    bracket_rows: int = BRACKET_ROWS,
) -> DataFrame:
    """Linearly interpolated percentiles of the finite values, one row per group and p.

    Columns: ``by``, ``p``, ``n``, ``quantile``. A sketch first brackets each wanted rank
    within a few thousandths of the rows. Brackets that may still hold too many rows are
    cut into slices and counted until the slice with the rank is short. Only then are the
    distinct values of the short brackets counted and ranked.
    """
    probs = sorted(set(float(p) for p in probs))
    keys = [*by, "p"]
    # no filter here: it would be pushed down and repeat the expression behind the value
    vals = df.select(*by, finite_or(value, None).alias("_v"), F.lit(1).alias("_one"))
    brackets, small = small_table(_sketch(vals, probs, by, accuracy))
    brackets = _shorten(vals, brackets, keys, by, bracket_rows)
    ranked = _running(
        _with_brackets(vals, brackets, by, small)
        .groupBy(*keys, "n", "_h", "_k", _zone().alias("_z"), F.when(_zone() == 0, F.col("_v")).alias("_v"))
        .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        .where("_low is not null"),
        keys, ["_z", "_v"],
    )
    at_k, at_next = _holds(0), _holds(1)
    frac = F.col("_h") - F.col("_k")
    return (
        ranked.groupBy(*keys, "n", "_h", "_k")
        .agg(F.max(F.when(at_k, _edge())).alias("_a"), F.max(F.when(at_next, _edge())).alias("_b"))
        .select(*keys, "n", F.when(frac > 0, F.col("_a") + frac * (F.col("_b") - F.col("_a")))
                .otherwise(F.col("_a")).alias("quantile"))
    )


def _sketch(vals: DataFrame, probs: list[float], by: Sequence[str], accuracy: int) -> DataFrame:
    """Per group and p: row count, wanted rank and a bracket of values around it."""
    margin = 2.0 / accuracy
    wanted = [x for p in probs for x in (max(0.0, p - margin), min(1.0, p + margin))]
    stats = vals.groupBy(*by).agg(
        F.count("_v").alias("n"),
        F.percentile_approx("_v", wanted, accuracy).alias("_q"),
    )
    per_p = [
        F.struct(F.lit(p).alias("p"), F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi"))
        for i, p in enumerate(probs)
    ]
    return (
        stats.where(F.col("n") > 0)
        .select(*by, "n", F.inline(F.array(*per_p)))
        .withColumn("_h", F.col("p") * (F.col("n") - 1))
        .withColumn("_k", F.floor("_h").cast("long"))
        .withColumn("_rows", F.ceil(F.col("n") * F.lit(2 * margin)).cast("long"))
        .withColumn("_one", F.lit(1))
    )


def _zone() -> Column:
    return F.when(F.col("_v") < F.col("lo"), -1).when(F.col("_v") > F.col("hi"), 1).otherwise(0)


def _edge() -> Column:
    """The value next to the bracket for rows outside it, the value itself inside."""
    return F.when(F.col("_z") < 0, F.col("_high")).otherwise(F.col("_low"))


def _running(counts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_upto", F.sum("_c").over(w))


def _holds(step: int) -> Column:
    """True for the counted row that holds rank k + step."""
    rank = F.col("_k") + step
    return (F.col("_upto") > rank) & (F.col("_upto") - F.col("_c") <= rank)


def _with_brackets(vals: DataFrame, brackets: DataFrame, by: Sequence[str], small: bool) -> DataFrame:
    return vals.join(F.broadcast(brackets) if small else brackets, [*by, "_one"])


def _shorten(vals: DataFrame, brackets: DataFrame, keys: list[str], by: Sequence[str], limit: int) -> DataFrame:
    """Cut brackets with more than ``limit`` rows into slices until every one is short."""
    too_long = (F.col("_rows") > limit) & (F.col("hi") > F.col("lo"))
    while True:
        todo, small = small_table(brackets.where(too_long), LOOKUP_ROWS)
        if todo.isEmpty():
            return brackets
        width = (F.col("hi") - F.col("lo")) / F.lit(float(SLICES))
        piece = F.least(F.floor((F.col("_v") - F.col("lo")) / width), F.lit(SLICES - 1))
        ranked = _running(
            _with_brackets(vals, todo, by, small)
            .groupBy(*keys, "n", "_h", "_k", _zone().alias("_z"), F.when(_zone() == 0, piece).alias("_s"))
            .agg(F.count(F.lit(1)).alias("_c"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
            .where("_low is not null"),
            keys, ["_z", "_s"],
        )
        both = _holds(0) & (_holds(1) | (F.col("_h") == F.col("_k")))
        inside = F.col("_z") == 0
        cut = ranked.groupBy(*keys, "n", "_h", "_k").agg(
            F.max(F.when(both & inside, F.col("_low")).when(_holds(0), F.when(inside, F.col("_high")).otherwise(_edge()))).alias("lo"),
            F.max(F.when(both & inside, F.col("_high")).when(_holds(1), _edge())).alias("hi"),
            F.coalesce(F.max(F.when(both & inside, F.col("_c"))), F.lit(0)).alias("_rows"),
        ).withColumn("hi", F.coalesce("hi", "lo")).withColumn("_one", F.lit(1))
        merged = brackets.where(~too_long).unionByName(cut.select(brackets.columns))
        brackets, _ = small_table(merged, LOOKUP_ROWS)


def quantile_columns(
    df: DataFrame,
    value: str,
    named: Sequence[tuple[str, float]],
    by: Sequence[str] = (),
    **kw: object,
) -> DataFrame:
    """One row per group with a column per named percentile, and ``n``."""
    long = exact_quantiles(df, value, [p for _, p in named], by, **kw)
    picks = [F.max(F.when(F.col("p") == F.lit(float(p)), F.col("quantile"))).alias(name) for name, p in named]
    return long.groupBy(*by, "n").agg(*picks)


def quantile_values(df: DataFrame, value: str, probs: Sequence[float], **kw: object) -> list[float | None]:
    """Percentiles of the whole table as plain numbers; None for an empty table."""
    found = {r["p"]: r["quantile"] for r in exact_quantiles(df, value, probs, **kw).collect()}
    return [found.get(float(p)) for p in probs]
