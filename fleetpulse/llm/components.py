"""Connected components of an edge table, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.staging import staged


def components(edges: DataFrame) -> DataFrame:
    """``id, component``: the smallest id reachable over ``a, b`` edges, for every id that has an edge.

    Alternates two steps that each keep the components: every node ties its larger neighbours to
    its smallest one, then every node ties its smaller neighbours to the smallest of them. The
    edges end as stars around the smallest ids. Rounds grow with the logarithm of the longest path.
    """
    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    pairs = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "edges")
    before = state(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = staged(moved.union(lowest.select("u", "m")).distinct(), "edges")
        after = state(pairs)
        if after == before:
            break
        before = after
    smallest = pairs.select("v").distinct()
    return pairs.toDF("id", "component").union(smallest.select("v", "v"))
