"""Sums over the items of each text, where the value of an item is known only in the item's shard.

The texts of a slice and the distinct items in them are numbered. For every shard one packed row
goes to the shard's task: the items, and which text has which item how often. The shard's task
values each item and sends back one number per text of the slice. Rows are as many as slices times
shards, and an item of any frequency is in a slice's rows once, so no key is hot.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

FRAME = "slice string, kind int, shard int, body binary"


def pack(value: object) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(pickle.dumps(value, protocol=5))


def unpack(body: bytes) -> object:
    import zstandard

    return pickle.loads(zstandard.ZstdDecompressor().decompress(body))


def squeeze(numbers: np.ndarray) -> tuple[str, list[bytes]]:
    """Integers in small room: their first bytes, their second bytes and so on, each compressed by itself.

    Where most numbers are small, as differences of sorted ones are, the high bytes take next to nothing.
    """
    import zstandard

    press = zstandard.ZstdCompressor(level=3)
    places = np.ascontiguousarray(numbers).view(np.uint8).reshape(len(numbers), numbers.itemsize)
    return numbers.dtype.str, [press.compress(places[:, k].tobytes()) for k in range(numbers.itemsize)]


def spread(squeezed: tuple[str, list[bytes]]) -> np.ndarray:
    """The integers that were squeezed."""
    import zstandard

    kind, places = squeezed
    press = zstandard.ZstdDecompressor()
    columns = [np.frombuffer(press.decompress(p), np.uint8) for p in places]
    return np.stack(columns, axis=1).reshape(-1).view(kind)


def slice_name() -> Callable[[], str]:
    """Names for the slices of the running task, the same in every attempt."""
    from pyspark import TaskContext

    n, task = 0, TaskContext.get().partitionId()

    def name() -> str:
        nonlocal n
        n += 1
        return f"{task}-{n}"

    return name


def frames(name: str, carried: pa.RecordBatch, text: np.ndarray, item: np.ndarray, items, shard: np.ndarray, shards: int) -> pa.RecordBatch:
    """The packed rows of a slice: ``text[i]`` has ``item[i]``, an index into ``items``, whose shards are given.

    ``items`` are a list or an array of integers. ``carried`` are the columns that each text's result has besides its sum.
    Texts, a text's items and an array's integers are sent as differences, since these are in order and dense.
    """
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, carried.schema) as out:
        out.write_batch(carried)
    kinds, numbers, bodies = [0], [hash_of(name) % shards], [pack(sink.getvalue().to_pybytes())]
    pairs, counts = np.unique(text.astype(np.int64) * max(len(items), 1) + item, return_counts=True)
    text, item = np.divmod(pairs, max(len(items), 1))
    order = np.argsort(shard[item], kind="stable")
    text, item, counts = text[order].astype(np.uint32), item[order], counts[order]
    edges = np.searchsorted(shard[item], np.arange(shards + 1))
    by_shard = np.argsort(shard, kind="stable")
    item_edges = np.searchsorted(shard[by_shard], np.arange(shards + 1))
    place = np.empty(len(items), np.uint32)
    place[by_shard] = np.arange(len(items), dtype=np.uint32)
    for s in range(shards):
        a, b = edges[s], edges[s + 1]
        if a < b:
            own = by_shard[item_edges[s] : item_edges[s + 1]]
            small = place[item[a:b]] - np.uint32(item_edges[s])
            first = np.concatenate([[True], text[a + 1 : b] != text[a : b - 1]])
            begin = np.flatnonzero(first)
            steps = np.diff(small, prepend=np.uint32(0))
            steps[begin] = small[begin]
            body = (
                carried.num_rows, squeeze(np.diff(items[own], prepend=0)) if isinstance(items, np.ndarray) else pack([items[i] for i in own]),
                squeeze(np.diff(text[a:b][begin], prepend=np.uint32(0))), squeeze(np.diff([*begin, b - a]).astype(np.uint32)),
                squeeze(steps), squeeze(counts[a:b]),
            )
            kinds.append(1)
            numbers.append(s)
            bodies.append(pickle.dumps(body, protocol=5))
    n = len(kinds)
    return pa.RecordBatch.from_arrays(
        [pa.array([name] * n), pa.array(kinds, pa.int32()), pa.array(numbers, pa.int32()), pa.array(bodies, pa.binary())],
        ["slice", "kind", "shard", "body"],
    )


def hash_of(name: str) -> int:
    import zlib

    return zlib.crc32(name.encode())


def sums_of(body: bytes, value_of: Callable[[object], np.ndarray]) -> bytes:
    """One number per text of the slice: the values of its items, as often as it has them."""
    n, items, text, sizes, steps, counts = pickle.loads(body)
    items = unpack(items) if isinstance(items, bytes) else np.cumsum(spread(items))
    text, sizes, steps = np.cumsum(spread(text), dtype=np.int64), spread(sizes).astype(np.int64), spread(steps).astype(np.int64)
    ends = np.cumsum(steps)
    begin = np.cumsum(sizes) - sizes
    item = ends - np.repeat(ends[begin] - steps[begin], sizes)
    values = value_of(items)[item] * spread(counts)
    return pack(np.bincount(np.repeat(text, sizes), values, n))


def valued(packed: DataFrame, shards: int, value_of: Callable[[], Callable[[object], np.ndarray]]) -> DataFrame:
    """Frames to sums, in the shards' tasks; ``value_of()`` is called once per task and gives the valuing function."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = value_of()
        for b in batches:
            kinds = b.column("kind").to_pylist()
            bodies = [x if k == 0 else sums_of(x, value) for k, x in zip(kinds, b.column("body").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("slice"), b.column("kind"), pa.array(bodies, pa.binary())], ["slice", "kind", "body"])

    return packed.repartition(shards, "shard").mapInArrow(run, "slice string, kind int, body binary")


def valued_by(packed: DataFrame, shards: int, value_of: Callable[[list], Callable[[object], np.ndarray]]) -> DataFrame:
    """Frames to sums where the shard's part of a table comes along: rows of kind -1, which are read first.

    ``value_of`` gets the unpacked bodies of the shard's part and gives the valuing function.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, part, value = None, [], None
        for b in batches:
            names, kinds, bodies = [], [], []
            for name, kind, shard, body in zip(*(b.column(c).to_pylist() for c in ("slice", "kind", "shard", "body")), strict=True):
                if shard != place:
                    place, part, value = shard, [], None
                if kind == -1:
                    part.append(unpack(body))
                    continue
                if kind == 1:
                    value = value or value_of(part)
                    body = sums_of(body, value)
                names.append(name)
                kinds.append(kind)
                bodies.append(body)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(kinds, pa.int32()), pa.array(bodies, pa.binary())], ["slice", "kind", "body"])

    return (
        packed.repartition(shards, "shard").sortWithinPartitions("shard", "kind")
        .mapInArrow(run, "slice string, kind int, body binary")
    )


def totals(sums: DataFrame, schema: str, finish: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch]) -> DataFrame:
    """Adds the sums of every slice and turns its carried columns and totals into result rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, carried, total = None, None, None
        for b in batches:
            for s, kind, body in zip(*(b.column(c).to_pylist() for c in ("slice", "kind", "body")), strict=True):
                if s != name and carried is not None:
                    yield finish(carried, total)
                if kind == 0:
                    name, carried = s, pa.ipc.open_stream(unpack(body)).read_next_batch()
                    total = np.zeros(carried.num_rows)
                else:
                    total = total + unpack(body)
        if carried is not None:
            yield finish(carried, total)

    return sums.repartition("slice").sortWithinPartitions("slice", "kind").mapInArrow(run, schema)
