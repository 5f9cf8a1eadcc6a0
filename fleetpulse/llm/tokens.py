"""Token counts of a piece vocabulary: every distinct pre-token is counted once.

A pre-token runs from one word mark to the next. No piece of the vocabulary reaches over that
border (checked when the model is loaded), so the count of a text is the sum over its pre-tokens.
Pre-tokens are counted in their shard and joined there to the frequencies per document; ids are
never kept.

Results: a null text is an empty text and has 0 bytes and 0 tokens. An empty table gives an empty
table. Rows that repeat are counted each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import chunks, sharded
from fleetpulse.llm.staging import partitions, sized_batches
from fleetpulse.llm.vocabularies import place

MODEL, LIMIT = "piece_bpe_32k.model", 4096
#: Pre-tokens of a shard that are remembered at once.
MEMORY = 500_000
MARK = "\u2581"


@lru_cache(2)
def model(path: str):
    import sentencepiece

    out = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [out.id_to_piece(i) for i in range(out.get_piece_size())]
    if any("\n" in p or MARK in p.lstrip(MARK) for p in pieces) or len(out.encode("\n", num_threads=1)) != 2:
        raise ValueError("the vocabulary has pieces that reach over a word's border")
    return out


def count_pieces(path: str, pre_tokens: list[str]) -> list[int]:
    """Pieces of each pre-token, which starts with a space (its word mark) or a newline."""
    # the model puts a word mark before a text: it takes the place of the space, or comes before the newline
    texts = [t[1:] if t[0] == " " else t for t in pre_tokens]
    found = map(len, model(path).encode(texts, num_threads=1))
    return [1 if t == " " else n - (t[0] == "\n") for t, n in zip(pre_tokens, found, strict=True)]


def count_tokens(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT
) -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` of every row of ``docs``."""
    spark = docs.sparkSession
    path, shards = path or place(MODEL), partitions(spark)
    sized_batches(spark)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = sharded.slice_name()
        for part in chunks.slices(batches):
            texts = part.column("text").fill_null("")
            marked = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(" ", texts, ""))
            cut = chunks.cut(marked)
            shard = np.fromiter((zlib.crc32(c.encode()) % shards for c in cut.distinct), np.int64, len(cut.distinct))
            yield sharded.frames(name(), part.select(["id", "n_bytes"]), cut.text_of_chunk(), cut.codes, cut.distinct, shard, shards)

    def values():
        memory = chunks.Memo(MEMORY)
        return lambda items: np.array(memory.values_of(items, lambda new: count_pieces(path, new)), np.int64)

    def finish(carried: pa.RecordBatch, total: np.ndarray) -> pa.RecordBatch:
        n = pa.array(np.rint(total).astype(np.int64))
        return pa.RecordBatch.from_arrays([*carried.columns, n, pc.greater(n, limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
        F.col(text_col).cast("string").alias("text"),
    )
    sums = sharded.valued(rows.mapInArrow(split, sharded.FRAME), shards, values)
    return sharded.totals(sums, "id long, n_bytes long, n_tokens long, over_limit boolean", finish)
