"""Readers and writers of telemetry tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.functions.channels import check_groups, drop_targets, name_channels
from fleetpulse.functions.exprs import finite_or
from fleetpulse.operators.ordering import number_rows, order_buckets, require_aligned
from fleetpulse.settings import DEV, SEQ, TEST

# Fixed value: components of a vector in ``embeddings``.
EMBEDDING_WIDTH = 64

FORMATS = ("parquet", "csv", "json", "orc")


def read_required(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None) -> DataFrame:
    """Read a stage table. A missing path is an error; text formats take a schema."""
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt}")
    reader = spark.read.format(fmt)
    if schema:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", True)
    if fmt == "csv":
        reader = reader.option("header", True)
    return reader.load(path)


def write_stage(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> None:
    """Replace a stage table. Partitioning by split lets later stages skip the other split."""
    writer = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def load_split(spark: SparkSession, path: str, split: str, fmt: str = "parquet") -> DataFrame:
    """One split of a telemetry export, tagged with its name, without target columns."""
    return drop_targets(read_required(spark, path, fmt)).withColumn("split", F.lit(split))


def load_all(spark: SparkSession, paths: Mapping[str, str], fmt: str = "parquet") -> DataFrame:
    """All splits stacked by column name."""
    return stack_splits({name: read_required(spark, p, fmt) for name, p in paths.items()})


def stack_splits(parts: Mapping[str, DataFrame]) -> DataFrame:
    out: DataFrame | None = None
    for name, part in parts.items():
        tagged = drop_targets(part).withColumn("split", F.lit(name))
        out = tagged if out is None else out.unionByName(tagged)
    if out is None:
        raise ValueError("no split given")
    return out


def assemble_groups(
    groups: Mapping[str, DataFrame],
    on: Sequence[str] = ("split", "row_idx"),
    names: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Channel groups of the same rows side by side, joined on the exported row number.

    Columns are named by group (``A``, ``W``, ``X_s`` as ``Xs``, ``X_v`` as ``Xv``, ``T``).
    """
    prefixes = {"A": "A", "W": "W", "X_s": "Xs", "X_v": "Xv", "T": "T"}
    out: DataFrame | None = None
    for g in check_groups(groups):
        part = name_channels(groups[g], prefixes[g], (names or {}).get(g), keep=on)
        if out is None:
            out = part
        else:
            require_aligned(out, part, on)
            out = out.join(part, list(on))
    return out


def _first(columns: Sequence[str], parts: Sequence[str], endings: Sequence[str], skip: str) -> str | None:
    for c in columns:
        low = c.lower()
        if c != skip and (any(p in low for p in parts) or any(low.endswith(e) for e in endings)):
            return c
    return None


def _number(c: str, default: int) -> Column:
    number = finite_or(F.col(c).cast("string").try_cast("double"), None)
    return F.coalesce(number.cast("long"), F.lit(default).cast("long"))


def add_unit_and_cycle(df: DataFrame, row_order: str, rows_per_bucket: int = 65_536) -> DataFrame:
    """Unit and cycle from the first column whose name suggests them.

    Without such a column the unit is 1 and the cycle counts rows per unit.
    """
    # Name parts that suggest a unit or a cycle.
    unit = _first(df.columns, ("unit", "engine"), ("id",), "unit_id")
    cycle = _first(df.columns, ("cycle", "flight", "time", "hs"), (), "cycle")
    out = df
    if "unit_id" not in out.columns:
        out = out.withColumn("unit_id", _number(unit, 1) if unit else F.lit(1).cast("long"))
    else:
        out = out.withColumn("unit_id", _number("unit_id", 1))
    if "cycle" in out.columns:
        return out.withColumn("cycle", _number("cycle", 0))
    if cycle:
        return out.withColumn("cycle", _number(cycle, 0))
    bucket = F.floor(F.col(row_order) / F.lit(rows_per_bucket))
    return number_rows(out, ["unit_id"], [row_order], bucket, name="cycle")


def events_columns(events: DataFrame) -> DataFrame:
    """The ``events`` table as single-sensor telemetry without row numbers.

    Units are users, a cycle is a day, and the score is the value scaled to [0, 1].
    """
    return events.select(
        F.when(F.col("user_id") % 3 == 2, TEST).otherwise(DEV).alias("split"),
        F.col("user_id").alias("unit_id"),
        F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).alias("cycle"),
        "ts", "event_id",
        context_code("event_type").alias("gmm_context_id"),
        F.col("value").alias("Xs_T48"),
        F.least(F.col("value") / 200.0, F.lit(1.0)).alias("final_anomaly_score"),
    )


def events_telemetry(spark: SparkSession, sf_dir: str, sequenced: bool = True) -> DataFrame:
    df = events_columns(spark.read.parquet(f"{sf_dir}/events.parquet"))
    if not sequenced:
        return df
    return number_rows(df, ["split", "unit_id"], ["ts", "event_id"], order_buckets("ts", "event_id"))


def context_code(c: str) -> Column:
    # The five event types in name order.
    kinds = ("click", "error", "purchase", "signup", "view")
    out = F.lit(-1)
    for i, k in reversed(list(enumerate(kinds))):
        out = F.when(F.col(c) == k, i).otherwise(out)
    return out


def lineitem_columns(lineitem: DataFrame) -> DataFrame:
    """The ``lineitem`` table as telemetry of four sensors; units are suppliers."""
    return lineitem.select(
        F.when(F.col("l_suppkey") % 3 == 2, TEST).otherwise(DEV).alias("split"),
        F.col("l_suppkey").alias("unit_id"),
        ((F.year("l_shipdate") - 1995) * 12 + F.month("l_shipdate")).alias("cycle"),
        F.col("l_shipdate").alias("ts"),
        "l_orderkey", "l_linenumber", "l_partkey",
        F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2).alias("gmm_context_id"),
        F.when(F.col("l_linestatus") == "F", 0).otherwise(1).alias("kmeans_context_id"),
        F.col("l_quantity").alias("Xs_T48"),
        F.col("l_extendedprice").alias("Xs_Ps30"),
        F.col("l_discount").alias("Xs_Nf"),
        F.col("l_tax").alias("Xs_Wf"),
    )


def lineitem_telemetry(spark: SparkSession, sf_dir: str, sequenced: bool = True) -> DataFrame:
    df = lineitem_columns(spark.read.parquet(f"{sf_dir}/lineitem.parquet"))
    if not sequenced:
        return df
    order = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "Xs_Ps30"]
    return number_rows(df, ["split", "unit_id"], order, order_buckets("ts", "l_orderkey"))


def with_operating_conditions(df: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part attributes as operating conditions of each lineitem row."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(
        F.col("p_partkey").alias("l_partkey"),
        F.col("p_size").cast("double").alias("W_alt"),
        (F.col("p_retailprice") / 1000.0).alias("W_Mach"),
    )
    return df.join(part, "l_partkey", "left")


def embedding_vectors(spark: SparkSession, sf_dir: str, width: int = EMBEDDING_WIDTH) -> DataFrame:
    """The ``embeddings`` table with its components as operating conditions."""
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        F.when(F.col("vec_id") % 3 == 2, TEST).otherwise(DEV).alias("split"),
        F.col("label").cast("long").alias("unit_id"),
        F.col("vec_id").alias(SEQ),
        F.lit(0).alias("cycle"),
        *[F.col("embedding")[i].cast("double").alias(f"W_{i + 1}") for i in range(width)],
    )
