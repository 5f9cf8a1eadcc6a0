"""Exact deduplication by progressive refinement: length, then a prefix hash, then the full hash.

Lengths and prefix hashes are gathered in one narrow table. Only texts whose length and prefix
another text shares get their full content hashed; the rest are known to be unique without it.
Counts are combined before every shuffle, so a group of copies of any size is one row per task.

Results: a null text is an empty text, and all empty texts are copies of each other. Of equal
texts the smallest id stays; rows that repeat that id stay with it. Null ids are larger than all
others. An empty table gives an empty table. Columns of the input are kept as they are; the added
ones of :func:`mark_copies` are those of ``ADDED`` and replace input columns of the same name, while
:func:`keep_one` adds none. Inner names cannot clash, since input columns are numbered meanwhile.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.staging import lookup, numbered, staged

#: Characters of the text that the second step hashes.
PREFIX = 128
ADDED = ("keep_id", "group_size", "kept")
_KEYS = ["__length", "__prefix"]


def normalised(text: Column) -> Column:
    """The text with every run of ASCII white space as one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _keyed(docs: DataFrame, text: str) -> DataFrame:
    clean = normalised(F.col(text))
    return docs.withColumns({
        "__text": clean,
    }).withColumns({
        "__length": F.octet_length("__text"),
        "__prefix": F.xxhash64(F.substring("__text", 1, PREFIX)),
    })


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: str | None = None) -> DataFrame:
    """``docs`` with ``keep_id``, ``group_size`` and ``kept``; ``digest`` names a column for the SHA-256 of every text."""
    added = [*ADDED, *([digest] if digest else [])]
    docs = docs.drop(*(c for c in docs.columns if c.lower() in [a.lower() for a in added] and c not in (id_col, text_col)))
    names = docs.columns
    out = _marked(numbered(docs), *(f"c{names.index(c)}" for c in (id_col, text_col)), "__digest" if digest else None)
    return out.select(
        *(F.col(f"c{k}").alias(name) for k, name in enumerate(names)), *ADDED,
        *([F.col("__digest").alias(digest)] if digest else []),
    )


def _marked(docs: DataFrame, id_col: str, text_col: str, digest: str | None = None) -> DataFrame:
    """What ``mark_copies`` gives, for columns that :func:`numbered` named."""
    narrow = staged(_keyed(docs.select(id_col, text_col), text_col).select(*_KEYS), "lengths")
    # sent to all tasks where they are few, so that rows of a hot length stay where they are and are combined there
    lengths = lookup(staged(narrow.groupBy("__length").count().where("count > 1").select("__length"), "repeated"))
    same_prefix = (
        narrow.join(lengths, "__length", "left_semi").groupBy(*_KEYS).count().where("count > 1")
        .select(*_KEYS, F.lit(True).alias("__shared"))
    )
    shared = lookup(staged(same_prefix, "prefixes"))
    keyed = _keyed(docs, text_col).join(shared, _KEYS, "left")
    full = F.sha2(F.encode("__text", "UTF-8"), 256)
    if digest:
        keyed = keyed.withColumn(digest, full)
        full = F.col(digest)
    keyed = keyed.withColumn("__full", F.when(F.col("__shared"), full)).drop("__text", "__shared")
    groups = _groups(docs, shared, id_col, text_col)
    out = keyed.join(lookup(groups), [*_KEYS, "__full"], "left")
    keep = F.when(F.col("__size").isNull(), F.col(id_col)).otherwise(F.col("__keep"))
    return out.withColumns({
        "keep_id": keep,
        "group_size": F.coalesce("__size", F.lit(1)).cast("long"),
        "kept": F.col(id_col).eqNullSafe(keep),
    }).drop(*_KEYS, "__full", "__keep", "__size")


def _groups(docs: DataFrame, shared: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per text that several rows have: its keys, the id that stays and the number of rows."""
    content = _keyed(docs.select(id_col, text_col), text_col).join(shared, _KEYS, "left_semi")
    hashed = content.select(id_col, *_KEYS, F.sha2(F.encode("__text", "UTF-8"), 256).alias("__full"))
    counted = hashed.groupBy(*_KEYS, "__full").agg(F.min(id_col).alias("__keep"), F.count("*").alias("__size"))
    return staged(counted.where("__size > 1"), "copies")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with the columns and values they came with, whatever their names are."""
    names, plain = docs.columns, numbered(docs)
    kept = _marked(plain, *(f"c{names.index(c)}" for c in (id_col, text_col))).where("kept")
    return kept.select(*plain.columns).toDF(*names)
