"""Mixes sources to target weights with a splitting tree over source block quotas.

Every source is cut into blocks by a hash. Its target is met by whole passes over the source and,
for the rest, by its blocks in a permuted order; the block where the target is reached is cut at a
finer hash. The number of blocks that each source contributes is its quota. A tree halves the
output shards again and again and deals the quotas of a node to its two sides by a draw without
replacement (a multivariate hypergeometric split with exact totals). Then every shard takes its
quota of each source's permuted blocks, disjoint from all other shards, and is ordered locally by
a hash.

All tables but the documents have a row per source, block or bin. Windows run over the blocks of
one source (``BLOCKS``), the bins of one block (``BINS``) or the quotas of ``GROUP`` sources.

Results: a null source is a source of its own, ordered last; a null text has size 0. Sources of
size 0 have target 0 and are never taken. Rows that repeat an id are taken alike. An empty table
gives an empty table. Reruns give the same rows, whatever the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm.staging import partitions, staged

BLOCKS, BINS, GROUP = 256, 4096, 256
#: Words in a text: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def _hash(seed: int, *cols: Column | str) -> Column:
    return F.xxhash64(F.lit(seed), *cols)


def _source_key(col: str) -> Column:
    """A join key that tells a null source from all others and keeps their order by code point, null last."""
    return F.when(F.col(col).isNull(), F.lit("n")).otherwise(F.concat(F.lit("a"), F.col(col).cast("string")))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """``key, source_size`` with ``target``: the weighted share of all sizes, stopped at ``limit`` times the source.

    The excess is reshared by weight until no source is above its limit: at the common level where
    the targets add up. The weights repeat over the sources in order.
    """
    numbered = sizes.withColumn("no", F.row_number().over(Window.orderBy("key")))
    w = F.element_at(F.array(*map(F.lit, map(float, weights))), F.pmod(F.col("no") - 1, F.lit(len(weights))).cast("int") + 1)
    rows = numbered.withColumn("w", w).withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    rows = rows.withColumn("level", F.col("cap") / F.col("w"))
    upward = Window.orderBy("level", "no")
    everything = Window.partitionBy(F.lit(1))
    rows = rows.withColumns({
        "want": F.sum("source_size").over(everything) * F.lit(float(share)),
        "capped": F.coalesce(F.sum("cap").over(upward.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)),
        "open": F.sum("w").over(upward.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
    })
    level = (F.col("want") - F.col("capped")) / F.col("open")
    first = F.min(F.when(level <= F.col("level"), F.struct("level", "no", level.alias("common")))).over(everything)
    rows = rows.withColumn("common", first["common"])
    return rows.select("key", "no", "source_size", F.least("cap", F.coalesce(F.col("common") * F.col("w"), "cap")).alias("target"))


def split_quotas(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """``key, group, quota`` to ``key, shard, count``: the quotas dealt to the shards by a splitting tree.

    Each node holds the quotas left for its shards; its left half of the shards gets its exact
    share of the node's total, drawn without replacement from all quotas of the node, so the
    counts by source follow the multivariate hypergeometric law and add up to the quotas.
    """
    units = quotas.withColumn("unit", F.explode(F.sequence(F.lit(1), F.col("quota").cast("int"))))
    units = units.select("key", "group", "unit", F.lit(0).alias("shard"), F.lit(shards).alias("n"))
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        node = Window.partitionBy("group", "shard", "n")
        left = F.floor(F.col("n") / 2).cast("int")
        u = F.shiftrightunsigned(_hash(seed + level, "group", "shard", "n"), 11) / F.lit(float(2**53))
        room = F.floor(F.count("*").over(node) * left / F.col("n") + u)
        drawn = F.row_number().over(node.orderBy(_hash(seed + level, "key", "unit"), "key", "unit")) <= room
        units = units.withColumns({"left": left, "goes_left": drawn}).select(
            "key", "group", "unit",
            F.when(F.col("goes_left") | (F.col("n") == 1), F.col("shard")).otherwise(F.col("shard") + F.col("left")).alias("shard"),
            F.when(F.col("n") == 1, F.lit(1)).when(F.col("goes_left"), F.col("left")).otherwise(F.col("n") - F.col("left")).alias("n"),
        )
    return units.groupBy("key", "shard").agg(F.count("*").alias("count"))


def plan_mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3, 1, 2),
    share: float = 1.5,
    limit: float = 2.0,
    shards: int | None = None,
    seed: int = 11,
) -> tuple[DataFrame, DataFrame]:
    """The narrow columns ``__key, __size, __block, __bin`` of ``docs``, and what each block of each source is used for.

    The second table has per source and block: the source's size and target, the output shards of
    its passes, and the bin below which documents get the last pass.
    """
    shards = shards or partitions(docs.sparkSession)
    narrow = staged(marks(docs, id_col, text_col, source_col, seed), "sizes")
    by_block = staged(narrow.groupBy("__key", "__block").agg(F.sum("__size").alias("words")), "blocks")
    sizes = by_block.groupBy(F.col("__key").alias("key")).agg(F.sum("words").alias("source_size"))
    goal = targets(sizes, weights, share, limit)
    goal = goal.withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
    goal = staged(goal.withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "targets")
    permuted = Window.partitionBy("key").orderBy(_hash(seed, "key", "block"), "block")
    blocks = by_block.select(F.col("__key").alias("key"), F.col("__block").alias("block"), "words").join(goal, "key")
    blocks = blocks.withColumns({
        "rank": F.row_number().over(permuted),
        "before": F.coalesce(F.sum("words").over(permuted.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    })
    inside = F.col("before") + F.col("words") <= F.col("rest")
    border = ~inside & (F.col("before") < F.col("rest"))
    blocks = staged(blocks.withColumns({"inside": inside, "border": border}), "ranks")
    bins = (
        narrow.join(blocks.where("border").select(F.col("key").alias("__key"), F.col("block").alias("__block"), "before", "rest"), ["__key", "__block"])
        .groupBy("__key", "__block", "__bin").agg(F.sum("__size").alias("w"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    )
    along = Window.partitionBy("__key", "__block").orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("from", F.col("before") + F.coalesce(F.sum("w").over(along), F.lit(0)))
    # a bin is taken if more than half of it lies below the target
    cuts = bins.where(F.col("from") + F.col("w") / 2 <= F.col("rest")).groupBy("__key", "__block").agg((F.max("__bin") + 1).alias("cut"))
    blocks = blocks.join(cuts.select(F.col("__key").alias("key"), F.col("__block").alias("block"), "cut"), ["key", "block"], "left")
    blocks = blocks.withColumn("below", F.when(F.col("inside"), F.lit(BINS)).otherwise(F.coalesce("cut", F.lit(0))))
    blocks = staged(blocks.withColumn("uses", F.col("passes") + (F.col("below") > 0).cast("int")), "uses")
    # one unit per source, block and pass, in permuted order within the source
    units = blocks.where("uses > 0").withColumn("pass", F.explode(F.sequence(F.lit(1), F.col("uses"))))
    order = Window.partitionBy("key").orderBy("pass", "rank")
    units = units.select("key", "block", "pass", F.row_number().over(order).alias("place"))
    quotas = blocks.groupBy("key", F.floor((F.col("no") - 1) / GROUP).alias("group")).agg(F.sum("uses").alias("quota")).where("quota > 0")
    dealt = split_quotas(quotas, shards, seed)
    upto = Window.partitionBy("key").orderBy("shard")
    dealt = dealt.withColumn("last", F.sum("count").over(upto))
    dealt = dealt.withColumn("place", F.explode(F.sequence(F.col("last") - F.col("count") + 1, F.col("last")))).select("key", "place", "shard")
    placed = units.withColumn("place", F.col("place").cast("long")).join(dealt, ["key", "place"])
    shards_of = placed.groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("passes_of"))
    out = blocks.join(shards_of, ["key", "block"], "left").select(
        F.col("key").alias("__key"), F.col("block").alias("__block"), F.col("source_size").alias("__source_size"),
        F.col("target").alias("__target"), F.col("passes").alias("__passes"), F.col("below").alias("__below"),
        F.coalesce(F.col("passes_of.shard"), F.array().cast("array<int>")).alias("__shards"),
    )
    return narrow, staged(out, "plan")


def marks(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """Columns that place a document: source key, size in words, block and bin."""
    h = _hash(seed, id_col, source_col)
    return docs.select(
        F.col(id_col).alias("__id"), _source_key(source_col).alias("__key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        F.pmod(h, F.lit(BLOCKS)).cast("int").alias("__block"),
        F.pmod(F.shiftrightunsigned(h, 16), F.lit(BINS)).cast("int").alias("__bin"),
    )


def _shards_of_row() -> Column:
    """The shards of a row's copies: one for each whole pass, and one more below the cut."""
    n = F.col("__passes") + (F.col("__bin") < F.col("__below")).cast("int")
    return F.slice("__shards", F.lit(1), F.when(F.col("__size") > 0, n).otherwise(F.lit(0)))


def usage(docs: DataFrame, **options) -> DataFrame:
    """Per document: ``id, size, source_size, target, copies, taken``."""
    narrow, plan = plan_mix(docs, **options)
    rows = narrow.join(plan, ["__key", "__block"]).withColumn("copies", F.size(_shards_of_row()).cast("long"))
    return rows.select(
        F.col("__id").alias("id"), F.col("__size").alias("size"), F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"), "copies", (F.col("__size") * F.col("copies")).alias("taken"),
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11, **options) -> DataFrame:
    """The mixture: rows of ``docs`` as often as they are taken, dealt to output shards and shuffled within each."""
    _, plan = plan_mix(docs, id_col, text_col, source_col, seed=seed, **options)
    shards = options.get("shards") or partitions(docs.sparkSession)
    h = _hash(seed, id_col, source_col)
    placed = docs.select(
        F.struct(*docs.columns).alias("__row"), _source_key(source_col).alias("__key"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("__size"),
        F.pmod(h, F.lit(BLOCKS)).cast("int").alias("__block"),
        F.pmod(F.shiftrightunsigned(h, 16), F.lit(BINS)).cast("int").alias("__bin"),
    ).join(plan, ["__key", "__block"])
    copies = placed.select("__row", F.posexplode(_shards_of_row()).alias("__copy", "__shard"))
    copies = copies.withColumn("__at", _hash(seed, f"__row.{id_col}", "__copy", "__shard"))
    return copies.repartitionById(shards, F.col("__shard")).sortWithinPartitions("__shard", "__at").select("__row.*")
