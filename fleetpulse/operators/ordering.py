"""Row order, blocked windows and key joins.

A trajectory is one ``(split, unit_id)``. One unit may hold a large share of all
rows, so nothing here sends a whole trajectory to one task: rows are numbered in
order buckets plus offsets, and trailing windows run in blocks of ``seq`` that
borrow the last rows of the block before.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from fleetpulse.functions.exprs import col, hash_rank
from fleetpulse.settings import BLOCK_ROWS, LOOKUP_ROWS, SEQ, TASK_ROWS, TRAJECTORY


# Bits cut from a number that breaks ties, coarse to fine.
TIE_BITS = (24, 16, 8, 0)


def order_buckets(column: str, tie: str | None = None) -> list[Column]:
    """Coarse to fine buckets of a timestamp that never decrease along it.

    ``tie`` is the whole number that orders rows of equal time. Its slices follow the finest
    time, so that many rows of one time, or without a time, are split as well.
    The session time zone must be free of clock changes, such as UTC.
    """
    times = [F.unix_seconds(F.date_trunc(unit, column)) for unit in ("month", "day", "hour", "minute", "second")]
    exact = F.unix_micros(F.col(column).cast("timestamp"))
    ties = [F.struct(exact, F.floor(F.col(tie) / F.lit(2 ** bits))) for bits in TIE_BITS] if tie else []
    return [*times, exact, *ties]


def _longest(df: DataFrame, candidates: Sequence[Column]) -> list[int]:
    """Rows of the longest bucket of each candidate, from one pass: the coarser ones are rolled up from the finest."""
    names = [f"_b{i}" for i in range(len(candidates))]
    finest = df.select(*[F.xxhash64(c).alias(n) for c, n in zip(candidates, names)]).groupBy(*names).agg(F.count(F.lit(1)).alias("_n"))
    sizes = finest.select("_n", F.posexplode(F.array(*names)).alias("_level", "_key")).groupBy("_level", "_key").agg(F.sum("_n").alias("_n"))
    found = {r["_level"]: r["_n"] for r in sizes.groupBy("_level").agg(F.max("_n").alias("_n")).collect()}
    return [found.get(i, 0) for i in range(len(candidates))]


def pick_bucket(df: DataFrame, candidates: Sequence[Column], task_rows: int = TASK_ROWS) -> Column:
    """The coarsest bucket that holds at most ``task_rows`` rows over all keys together.

    The finest candidate is used when none is short enough, so it should tell rows apart.
    Fine candidates have many buckets and are counted only where the first three are too long.
    """
    for part in (candidates[:-1][:3], candidates[:-1][3:]):
        for candidate, rows in zip(part, _longest(df, part) if part else []):
            if rows <= task_rows:
                return candidate
    return candidates[-1]


def longest_key(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the key that has most of them; rows of a key with NULL get no number and don't count."""
    known = df.select(*keys).dropna()
    return known.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0] or 0


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    bucket: str | Column | Sequence[Column],
    name: str = SEQ,
    start: int = 1,
    task_rows: int = TASK_ROWS,
) -> DataFrame:
    """Running number of each row within ``keys``, in ``order``.

    ``order`` must tell all rows of a key apart, or a repeated task may number them anew.
    ``bucket`` is a value that does not decrease along ``order`` (a day, a minute, a block
    number); keys hold no NULL, and rows whose order is NULL come first. Rows are sorted only
    inside one bucket; the rows of earlier buckets enter as an offset from a table with one
    row per key and bucket. Of several buckets, coarse to fine, the coarsest with a bounded
    number of rows is taken; where every key is counted to have few rows, each is sorted whole,
    since buckets would then hold a few rows each and the offsets be a table as long as the rows.
    """
    if keys and not isinstance(bucket, (str, Column)) and longest_key(df, keys) <= min(task_rows, BLOCK_ROWS):
        number = F.row_number().over(Window.partitionBy(*keys).orderBy(*[col(o) for o in order]))
        known = reduce(and_, [F.col(k).isNotNull() for k in keys], F.lit(True))
        return df.withColumn(name, F.when(known, number + F.lit(start - 1)).cast("long"))
    by = bucket if isinstance(bucket, (str, Column)) else pick_bucket(df, bucket, task_rows)
    # within a struct, NULL is a value that sorts first and equals itself
    rows = df.withColumn("_bucket", F.struct(col(by).alias("at")))
    counts = rows.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(*[col(o) for o in order])
    return (
        rows.withColumn("_inside", F.row_number().over(inside))
        .join(offsets, [*keys, "_bucket"], "left")
        .withColumn(name, (F.col("_inside") + F.col("_before") + F.lit(start - 1)).cast("long"))
        .drop("_bucket", "_inside", "_before")
    )


def in_blocks(
    df: DataFrame,
    look_back: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    keys: Sequence[str] = TRAJECTORY,
    seq: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Run row-window features in blocks of ``seq``.

    ``build(df, w)`` adds columns with the ordered window ``w``. ``look_back`` is how
    many earlier rows a result depends on; that many rows are copied into the next
    block and dropped afterwards, so results equal those of an unblocked window.
    ``seq`` must be dense within a trajectory.
    """
    if look_back > block_rows:
        raise ValueError("a block must be at least as long as the look-back")
    block = F.floor(F.col(seq) / F.lit(block_rows)).cast("long")
    tail = F.pmod(F.col(seq), F.lit(block_rows)) >= F.lit(block_rows - look_back)
    copies = F.when(tail, F.array(block, block + 1)).otherwise(F.array(block))
    w = Window.partitionBy(*keys, "_block").orderBy(seq)
    out = build(df.withColumn("_block", F.explode(copies)), w)
    return out.where(block == F.col("_block")).drop("_block")


def trailing(w: WindowSpec, rows: int) -> WindowSpec:
    """Current row and the rows before it, ``rows`` in all."""
    return w.rowsBetween(-(rows - 1), 0)


def difference(c: str, w: WindowSpec) -> Column:
    """Change from the row before; 0 on the first row."""
    return F.coalesce(F.col(c) - F.lag(c).over(w), F.lit(0.0))


def small_table(df: DataFrame, max_rows: int = LOOKUP_ROWS) -> tuple[DataFrame, bool]:
    """Evaluate a parameter table once if it is small.

    Up to ``max_rows`` rows are fetched and returned as a local table (True). A larger
    table is returned as it came (False).
    """
    rows = df.limit(max_rows + 1).toArrow()
    if rows.num_rows > max_rows:
        return df, False
    return df.sparkSession.createDataFrame(rows, df.schema), True


def lookup_join(
    df: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str = "left",
    max_rows: int = LOOKUP_ROWS,
) -> DataFrame:
    """Join to a parameter table: broadcast within the bound, shuffled beyond it."""
    local, small = small_table(table, max_rows)
    return df.join(F.broadcast(local) if small else local, list(on), how)


def key_join(left: DataFrame, *rights: DataFrame, keys: Sequence[str] = (*TRAJECTORY, SEQ)) -> DataFrame:
    """One-to-one join on the unique row key; columns already present are not repeated."""
    out = left
    for right in rights:
        new = [c for c in right.columns if c not in out.columns]
        out = out.join(right.select(*keys, *new), list(keys), "left")
    return out


def occurrence_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    order: str = SEQ,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Left join where the n-th row of a key meets the n-th row of the same key."""
    bucket = [F.floor(F.col(order) / F.lit(block_rows))]
    lhs = number_rows(left, keys, [order], bucket, name="_occurrence")
    rhs = number_rows(right, keys, [order], bucket, name="_occurrence")
    new = [c for c in right.columns if c not in left.columns]
    return lhs.join(rhs.select(*keys, "_occurrence", *new), [*keys, "_occurrence"], "left").drop("_occurrence")


def alignment_audit(left: DataFrame, right: DataFrame, keys: Sequence[str] = (*TRAJECTORY, SEQ)) -> DataFrame:
    """One row: row counts of both sides, keys missing on either side, and a flag."""
    sides = (
        left.select(*keys, F.lit(1).alias("_l"), F.lit(0).alias("_r"))
        .unionByName(right.select(*keys, F.lit(0).alias("_l"), F.lit(1).alias("_r")))
        .groupBy(*keys).agg(F.sum("_l").alias("_l"), F.sum("_r").alias("_r"))
    )
    return sides.agg(
        F.coalesce(F.sum("_l"), F.lit(0)).alias("left_rows"),
        F.coalesce(F.sum("_r"), F.lit(0)).alias("right_rows"),
        F.count_if(F.col("_r") == 0).alias("left_only_keys"),
        F.count_if(F.col("_l") == 0).alias("right_only_keys"),
        F.coalesce(F.bool_and(F.col("_l") == F.col("_r")), F.lit(True)).alias("aligned"),
    )


def require_aligned(left: DataFrame, right: DataFrame, keys: Sequence[str] = (*TRAJECTORY, SEQ)) -> None:
    row = alignment_audit(left, right, keys).first()
    if not row["aligned"]:
        raise ValueError(f"tables are not aligned: {row.asDict()}")


def uniform_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all, if fewer), chosen by a reproducible hash of the key.

    A first cut on the leading hash digits leaves little more than ``n`` rows, so only
    those are sorted.
    """
    total = df.count()
    if total <= n:
        return df
    share = n / total + 8.0 * (n ** 0.5) / total
    picked = df.withColumn("_hash", hash_rank(keys, seed))
    if share < 1.0:
        picked = picked.where(F.substring("_hash", 1, 12) <= F.lit("%012x" % int(share * 16 ** 12)))
    return picked.orderBy("_hash", *keys).limit(n).drop("_hash")
