"""Cuts texts into short pieces that tokenizers treat independently, without a Python loop over words.

A cut stands before a single space or newline with an ordinary character on either side. The
splitting patterns of byte-level vocabularies and the word marks of piece vocabularies both end
a unit there, so every chunk can be encoded once, whatever stands around it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
#: First bytes of characters that may be white space or a word mark outside ASCII.
_WIDE = np.zeros(256, bool)
_WIDE[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".,;:!?"]] = True


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Chunks:
    """``codes[bounds[i]:bounds[i + 1]]`` are the chunks of text i, as indices into ``distinct``."""

    distinct: list[str]
    codes: np.ndarray
    bounds: np.ndarray

    def text_of_chunk(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each text; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    return data, off - off[0]


def cut(texts: pa.Array, stops: bool = False) -> Chunks:
    """Chunks of every text. ``stops`` also cuts between a letter and one of ``.,;:!?``."""
    data, off = raw(texts)
    mark = np.zeros(len(data) + 1, bool)
    if len(data):
        at = np.flatnonzero((data == 32) | (data == 10))
        at = at[(at > 0) & (at < len(data) - 1)]
        b1, b2, b3, after = data[at - 1], data[np.maximum(at - 2, 0)], data[np.maximum(at - 3, 0)], data[at + 1]
        wide = (b1 >= 0x80) & (_WIDE[b2] | ((b2 < 0xC0) & _WIDE[b3]))
        mark[at[~_SPACE[b1] & ~wide & ~_SPACE[after] & ~_WIDE[after]]] = True
        if stops:
            at = np.flatnonzero(_STOP[data[1:]]) + 1
            mark[at[_LETTER[data[at - 1]]]] = True
    mark[off] = True
    starts = np.flatnonzero(mark)
    bounds = np.searchsorted(starts[:-1], off)
    if len(starts) < 2:
        return Chunks([], np.zeros(0, np.int64), bounds)
    view = pa.LargeStringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data))
    coded = view.dictionary_encode()
    return Chunks(coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), bounds)


def words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words (runs of anything but ASCII white space), the word codes in order, and the range of each text.

    ``lower`` lower-cases A to Z first.
    """
    data, off = raw(texts)
    data = _LOWER[data] if lower else data
    letter = ~_BLANK[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[off] = True
    begins = letter & (edge[:-1] | ~np.concatenate([[False], letter[:-1]]))
    ends = letter & (edge[1:] | ~np.concatenate([letter[1:], [False]]))
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    bounds = np.searchsorted(first, off)
    if not len(first):
        return [], np.zeros(0, np.int64), bounds
    # words and the gaps between them alternate; the words are every second value
    cuts = np.empty(2 * len(first), np.int64)
    cuts[0::2], cuts[1::2] = first, last
    view = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)])
    coded = view.take(pa.array(np.arange(0, len(cuts) - 1, 2))).dictionary_encode()
    return coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), bounds


def gather(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the ranges ``starts[i] .. starts[i] + sizes[i]``, one after the other."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)


def release() -> None:
    """Give memory that is free in the Python worker back to the system: workers outlive their tasks, and wait beside those of later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of each have about ``most`` bytes or are a single text. Free memory is released at the end."""
    for batch in batches:
        sizes = np.asarray(pa.compute.binary_length(batch.column(column)).fill_null(0)).astype(np.int64)
        group = np.cumsum(sizes) // most
        begin = 0
        for end in [*(np.flatnonzero(np.diff(group)) + 1), len(sizes)]:
            if end > begin:
                yield batch.slice(begin, end - begin)
            begin = end
    release()


class Memo:
    """Values by key in two generations of at most ``most`` entries; the older one is dropped when the newer is full.

    Keys that come again move to the newer generation, so frequent ones stay.
    """

    def __init__(self, most: int) -> None:
        self.most = most
        self.older: dict = {}
        self.newer: dict = {}

    def values_of(self, keys: list, compute) -> list:
        """The value of every key; ``compute`` maps the list of missing keys to their values."""
        out = [self.newer.get(k) for k in keys]
        gone = [i for i, v in enumerate(out) if v is None]
        new = []
        for i in gone:
            v = out[i] = self.older.get(keys[i])
            if v is None:
                new.append(i)
        if new:
            for i, v in zip(new, compute([keys[i] for i in new]), strict=True):
                out[i] = v
        for i in gone:
            if len(self.newer) >= self.most:
                self.older, self.newer = self.newer, {}
            self.newer[keys[i]] = out[i]
        return out


class Pool:
    """Byte strings by number, laid end to end, to put many of them together without a Python loop."""

    def __init__(self, items: list[bytes]) -> None:
        self.data = np.frombuffer(b"".join(items), np.uint8)
        self.sizes = np.fromiter(map(len, items), np.int32, len(items))
        self.starts = np.concatenate([[0], np.cumsum(self.sizes[:-1], dtype=np.int64)]).astype(np.int32) if items else self.sizes

    def join(self, numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items ``numbers`` one after the other, and the bytes where ``numbers[bounds]`` begin."""
        sizes = self.sizes[numbers]
        ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        where = np.repeat((self.starts[numbers] - ends[:-1]).astype(np.int32), sizes)
        where += np.arange(len(where), dtype=np.int32)
        return self.data[where], ends[bounds]
