"""Token ids in length-delimited binary records with a separate index of offsets.

Documents are dealt to files by ranges of their id and lie in ascending order within a file. A
record is framed as: payload length (8 bytes), masked checksum of the length (4), payload, masked
checksum of the payload (4). The payload is the document id (8 bytes, signed), a byte that says if
there is an id, a byte with the width of a token id (2 bytes if all of the record's ids fit, else 4),
and the token ids. All numbers are little-endian. The index file of
a record file holds the offset of each record (8 bytes), so that records can be read in any order.

Results: a null text is empty and gives only the end id. Null ids come last. Rows that repeat an
id are ordered by a hash of their text. An empty table gives no files and an empty table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetpulse.llm import chunks
from fleetpulse.llm.files import opened, written
from fleetpulse.llm.staging import partitions, shared_folder, sized_batches, staged
from fleetpulse.llm.vocabularies import place

VOCABULARY, END = "byte_bpe_50k.json", 2
MEMORY = 400_000
SLICE = 8 << 20
#: Bytes of a record file that are read at once.
READ = 8 << 20
_HEAD, _SUM = struct.Struct("<QI"), struct.Struct("<I")
_NAME = struct.Struct("<qBB")


def masked(data) -> int:
    """The CRC-32 of ``data``, turned and shifted so that a checksum of checksums stays meaningful."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def framed(doc: int | None, ids: np.ndarray) -> bytes:
    """A document's record."""
    kind = "<u2" if ids.max(initial=0) < 1 << 16 else "<u4"
    payload = _NAME.pack(doc or 0, doc is not None, int(kind[2])) + ids.astype(kind).tobytes()
    length = struct.pack("<Q", len(payload))
    return b"".join([length, _SUM.pack(masked(length)), payload, _SUM.pack(masked(payload))])


def document_of(payload: memoryview) -> tuple[int | None, np.ndarray]:
    """The document's id and its token ids."""
    doc, known, width = _NAME.unpack_from(payload)
    return doc if known else None, np.frombuffer(payload, f"<u{width}", offset=_NAME.size).astype("<u4")


@lru_cache(2)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), chunks.Memo(MEMORY)


def encode_texts(path: str, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts and where those of each text begin; every distinct chunk is encoded once."""
    library, memory = tokenizer(path)
    cut = chunks.cut(texts, stops=True)

    def encoded(new: list[str]) -> list[bytes]:
        return [np.array(e.ids, np.uint32).tobytes() for e in library.encode_batch_fast(new, add_special_tokens=False)]

    found = memory.values_of(cut.distinct, encoded)
    pool = np.frombuffer(b"".join(found), np.uint32)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    counts = sizes[cut.codes]
    bounds = np.concatenate([[0], np.cumsum(counts)])[cut.bounds]
    return pool[chunks.gather((np.cumsum(sizes) - sizes)[cut.codes], counts)], bounds


def _by_range(docs: DataFrame, id_col: str, text_col: str, files: int) -> DataFrame:
    """``id, text, file``: documents dealt to files by equal ranges of the ids in the table."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    cuts = rows.select(F.percentile_approx("id", [k / files for k in range(1, files)], 10_000).alias("cuts")).first()["cuts"] if files > 1 else None
    file = F.when(F.col("id").isNull(), F.lit(files - 1))
    edges = sorted(set(cuts or []))
    if edges:
        bound = F.array(*(F.lit(int(c)) for c in edges))
        file = file.otherwise(F.size(F.filter(bound, lambda c: c < F.col("id"))))
    else:
        file = file.otherwise(F.lit(0))
    return rows.withColumn("file", file.cast("int"))


def write_records(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None,
    end: int = END, folder: str | None = None, files: int | None = None,
) -> DataFrame:
    """Writes the record and index files; returns a row per file: ``file, path, index, n_records, n_ids``."""
    spark = docs.sparkSession
    path, files = path or place(VOCABULARY), files or partitions(spark)
    folder = folder or shared_folder(spark, "records")
    sized_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a task has the rows of one file; the file's number is only known with its first row
        out = ctx = None
        offsets, at, n_ids, number = [], 0, 0, None
        for part in chunks.slices(batches, most=SLICE):
            if ctx is None:
                number = part.column("file")[0].as_py()
                ctx = written(f"{folder}/ids-{number:06d}.rec")
                out = ctx.__enter__()
            ids, bounds = encode_texts(path, part.column("text"))
            last = np.array([end], np.uint32)
            lines = []
            for k, doc in enumerate(part.column("id").to_pylist()):
                frame = framed(doc, np.append(ids[bounds[k] : bounds[k + 1]], last))
                lines.append(frame)
                offsets.append(at)
                at += len(frame)
            out.write(b"".join(lines))
            n_ids += len(ids) + part.num_rows
        if ctx is not None:
            ctx.__exit__(None, None, None)
            with written(f"{folder}/ids-{number:06d}.idx") as index:
                index.write(np.array(offsets, np.uint64).tobytes())
            yield pa.RecordBatch.from_pylist([{
                "file": number, "path": f"{folder}/ids-{number:06d}.rec", "index": f"{folder}/ids-{number:06d}.idx",
                "n_records": len(offsets), "n_ids": n_ids,
            }], schema=pa.schema([("file", pa.int32()), ("path", pa.string()), ("index", pa.string()), ("n_records", pa.int64()), ("n_ids", pa.int64())]))

    dealt = _by_range(docs, id_col, text_col, files).repartitionById(files, F.col("file"))
    ordered = dealt.withColumn("tie", F.xxhash64("text")).sortWithinPartitions(F.col("id").asc_nulls_last(), "tie").drop("tie")
    return staged(ordered.mapInArrow(run, "file int, path string, index string, n_records long, n_ids long"), "manifest")


def read_payloads(path: str, index: str, order: np.ndarray | None = None) -> Iterator[memoryview]:
    """The payloads of a record file, in file order or in the order given by record numbers; checksums are verified."""
    offsets = np.frombuffer(opened(index).read(), np.uint64).astype(np.int64)
    with opened(path) as file:
        ends = np.append(offsets[1:], file.size())
        if order is not None:
            groups = [(int(offsets[k]), int(ends[k]), [k]) for k in order]
        else:
            part = offsets // READ
            cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(offsets)]
            groups = [(int(offsets[a]), int(ends[b - 1]), range(a, b)) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]
        for begin, end, numbers in groups:
            data = memoryview(file.read_at(end - begin, begin))
            for k in numbers:
                frame = data[int(offsets[k]) - begin : int(ends[k]) - begin]
                length, check = _HEAD.unpack_from(frame)
                payload = frame[12 : 12 + length]
                if masked(frame[:8]) != check or len(frame) != length + 16 or masked(payload) != _SUM.unpack_from(frame, 12 + length)[0]:
                    raise ValueError(f"record {k} of {path} is damaged")
                yield payload


def read_records(manifest: DataFrame) -> DataFrame:
    """Reads the files of a manifest back: ``id, start, n_tokens, ids_crc32`` per document, start over all files."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "start", "n_tokens", "ids_crc32"]
        for b in batches:
            for path, index, start in zip(*(b.column(c).to_pylist() for c in ("path", "index", "start")), strict=True):
                rows = []
                for payload in read_payloads(path, index):
                    doc, ids = document_of(payload)
                    rows.append((doc, start, len(ids), zlib.crc32(ids)))
                    start += len(ids)
                    if len(rows) == 50_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    spread = listed.repartition(partitions(manifest.sparkSession), "file")
    return spread.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
