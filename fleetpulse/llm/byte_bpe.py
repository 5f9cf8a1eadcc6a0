"""Byte-level BPE encoding and decoding over a rank file, in linear time.

The bytes of every unit that the splitting pattern gives are read as Latin-1 characters, so that
an Aho-Corasick automaton over the vocabulary finds all tokens in them in one pass. Encoding
starts with the longest token at each place and steps back where two neighbours could not stand
side by side in the result of the merges. Whether they can depends on the two tokens alone, so the
answers are kept; every place is given up at most once. The ids are those that the merges give.

Results: null and empty texts have no ids. Ids outside the vocabulary don't decode and raise.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm import chunks
from fleetpulse.llm.staging import sized_batches
from fleetpulse.llm.vocabularies import pattern, place

RANKS = "byte_bpe_50k.tiktoken"
#: Entries of the memories of a Python worker: chunks, and pairs of tokens.
MEMORY, PAIRS = 60_000, 1 << 16
#: Bytes of text that are encoded at once.
SLICE = 2 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Codec:
    """Encodes and decodes bytes by a table of ranks; a token's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], split: str) -> None:
        import ahocorasick
        import regex

        self.units = regex.compile(split).findall
        self.ranks = ranks
        self.bytes_of = {i: t for t, i in ranks.items()}
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            pieces = self._merge(token, i) if len(token) > 1 else []
            if len(pieces) == 2:
                self.parts[i] = (ranks[pieces[0]], ranks[pieces[1]])
                self.merged[self.parts[i]] = i
            elif not pieces:
                self.parts[i] = None
            # a token that its own merges don't reach never occurs in a result
        self.automaton = ahocorasick.Automaton()
        for i in self.parts:
            self.automaton.add_word(self.bytes_of[i].decode("latin-1"), i)
        self.automaton.make_automaton()
        self.size_of = {i: len(t) for i, t in self.bytes_of.items()}
        self.beside = lru_cache(PAIRS)(self._beside)
        self.memory = chunks.Memo(MEMORY)
        most = max(self.bytes_of, default=-1) + 1
        self.tokens = chunks.Pool([self.bytes_of.get(i, b"") for i in range(most)])
        self.decimal = chunks.Pool([b"%d " % i for i in range(most)])

    def _merge(self, word: bytes, below: int) -> list[bytes]:
        """The parts of ``word`` after all merges of lower rank than ``below``: the defining, slow way."""
        parts = [word[k : k + 1] for k in range(len(word))]
        while len(parts) > 1:
            rank, k = min((self.ranks.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank >= below:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _beside(self, left: int, right: int) -> bool:
        """Whether merging could leave these two tokens as neighbours.

        Undo the merges that made the two tokens, the latest first, as far as they touch the border.
        If at some point the tokens on both sides of the border would have been merged before the
        undone merge happened, the border could not have lasted.
        """
        undone = 1 << 62
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < undone:
                return False
            inner, outer = self.parts[left], self.parts[right]
            if inner is None and outer is None:
                return True
            # of equal ranks the merge on the left came first, so the right one is undone first
            if outer is None or (inner is not None and left > right):
                undone, left = left, inner[1]
            else:
                # a pair of the same rank across the border would have come before the right one
                undone, right = right + 1, outer[0]

    def unit(self, data: bytes) -> list[int]:
        """The ids of one unit."""
        whole = self.ranks.get(data)
        if whole is not None and whole in self.parts:
            return [whole]
        size, beside, n = self.size_of, self.beside, len(data)
        options: list[list[int]] = [[] for _ in data]
        for end, token in self.automaton.iter(data.decode("latin-1")):
            options[end + 1 - size[token]].append(token)  # the longest of a start comes last
        # a place is reached by one sequence only, the ids of what stands before it, so its options are used up once
        out, here, last = [], 0, -1
        while here < n:
            left = options[here]
            while left:
                token = left.pop()
                end = here + size[token]
                if (last < 0 or beside(last, token)) and (end == n or options[end]):
                    out.append(token)
                    here, last = end, token
                    break
            else:
                here -= size[out.pop()]
                last = out[-1] if out else -1
        return out

    def encode(self, text: str) -> list[int]:
        units = self.units(text)
        if len(units) == 1:
            return self.unit(text.encode())
        return [i for u in units for i in self.unit(u.encode())]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many texts and where those of each text begin; every distinct chunk is encoded once."""
        cut = chunks.cut(texts, stops=True)
        found = self.memory.values_of(cut.distinct, lambda new: [np.array(self.encode(c), np.int32).tobytes() for c in new])
        pool = np.frombuffer(b"".join(found), np.int32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        starts = np.cumsum(sizes) - sizes
        counts = sizes[cut.codes]
        bounds = np.concatenate([[0], np.cumsum(counts)])[cut.bounds]
        return pool[chunks.gather(starts[cut.codes], counts)], bounds

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


@lru_cache(2)
def codec(path: str, split: str) -> Codec:
    """One codec per Python worker, vocabulary and pattern."""
    return Codec(read_ranks(path), split)




def encode(docs: DataFrame, text_col: str = "text", out_col: str = "ids", path: str | None = None, split: str | None = None) -> DataFrame:
    """``docs`` with the ids of every text as an array."""
    path, split = path or place(RANKS), split or pattern()
    sized_batches(docs.sparkSession)
    rest = [c for c in docs.columns if c != out_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split)
        for part in chunks.slices(batches, text_col, SLICE):
            ids, bounds = own.encode_all(part.column(text_col))
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), lists], [*rest, out_col])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in rest)
    return docs.select(*rest).mapInArrow(run, f"{kinds}, `{out_col}` array<int>")


def decode(coded: DataFrame, ids_col: str = "ids", out_col: str = "bytes", path: str | None = None, split: str | None = None) -> DataFrame:
    """``coded`` with the bytes that its ids stand for; the ids are dropped."""
    path, split = path or place(RANKS), split or pattern()
    rest = [c for c in coded.columns if c not in (ids_col, out_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split)
        for part in batches:
            data = [own.decode(ids) if ids is not None else None for ids in part.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in rest), pa.array(data, pa.binary())], [*rest, out_col])

    kinds = "".join(f"`{c}` {coded.schema[c].dataType.simpleString()}, " for c in rest)
    return coded.mapInArrow(run, f"{kinds}`{out_col}` binary")


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, split: str | None = None) -> DataFrame:
    """Encodes every text and decodes the ids: ``id, n_tokens, ids_sha256, decoded_sha256``.

    The first hash is that of the decimal ids, joined by single spaces.
    """
    path, split = path or place(RANKS), split or pattern()
    sized_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split)

        def hashes(pool: chunks.Pool, ids: np.ndarray, bounds: np.ndarray, cut: int) -> list[str]:
            data, ends = pool.join(ids, bounds)
            return [hashlib.sha256(data[a : max(a, b - cut)]).hexdigest() for a, b in zip(ends[:-1], ends[1:], strict=True)]

        for part in chunks.slices(batches, most=SLICE):
            ids, bounds = own.encode_all(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("id"), pa.array(np.diff(bounds), pa.int64()),
                    pa.array(hashes(own.decimal, ids, bounds, 1), pa.string()), pa.array(hashes(own.tokens, ids, bounds, 0), pa.string()),
                ],
                ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
            del ids, bounds
            chunks.release()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
