"""Written tables that cut lineage, and the row and batch sizes that Python tasks get."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetpulse.streaming.storage import shuffles_freed

#: Bytes of rows the JVM puts in one Arrow batch, so that very long texts don't pile up in one batch.
BATCH_BYTES = 16 << 20
#: Rows of keys that are sent to every task at most.
BROADCAST_ROWS = 250_000


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="fleetpulse-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def kept_at(df: DataFrame, path: str) -> DataFrame:
    """``df`` written to a folder and read back."""
    with shuffles_freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def staged(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: later steps neither recompute it nor lose it with an executor."""
    return kept_at(df, shared_folder(df.sparkSession, name))


def lookup(table: DataFrame) -> DataFrame:
    """A written table of keys, marked for broadcast if it is counted to be small; a larger one is joined by a shuffle."""
    return F.broadcast(table) if table.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else table


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with its columns named ``c0, c1, ...``, so that none clashes with the names an operator uses inside."""
    return df.toDF(*(f"c{k}" for k in range(len(df.columns))))


def free_name(name: str, columns: list[str]) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def sized_batches(spark: SparkSession) -> None:
    """Bound the bytes of the Arrow batches that Python functions get."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
