"""Registry of runnable queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.plans.sql import with_tables

Run = Callable[[SparkSession, str], DataFrame]
SCALE = 1e6
# Added before cutting to whole units. It is a little above one half, so that exact halves
# fall on the same side in both engines in spite of rounding noise.
HALF = 0.5001


@dataclass(frozen=True)
class Query:
    run: Run
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(
    key: str,
    text: str = "",
    ints: str = "",
    nums: str = "",
    sql: str | None = None,
    tables: tuple[str, ...] = (),
) -> Callable[[Run], Run]:
    """Register a query by survey id.

    ``text``, ``ints`` and ``nums`` name the output columns; numbers are rounded to six
    decimals on both sides. ``sql`` selects at least these columns from the named tables.
    """

    def register(fn: Run) -> Run:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(spark, sf).select(
                *text.split(),
                *[F.col(c).cast("long").alias(c) for c in ints.split()],
                *[(F.floor(F.col(c).cast("double") * SCALE + HALF) / SCALE).alias(c) for c in nums.split()],
            )

        full = None
        if sql is not None:
            parts = [
                *text.split(),
                *[f"CAST({c} AS BIGINT) AS {c}" for c in ints.split()],
                *[f"floor(CAST({c} AS DOUBLE)*{SCALE} + {HALF})/{SCALE} AS {c}" for c in nums.split()],
            ]
            full = with_tables(f"SELECT {', '.join(parts)} FROM ({sql}) q", *tables)
        if key in QUERIES:
            raise ValueError(f"query {key} is registered twice")
        QUERIES[key] = Query(run, full)
        return fn

    return register
