"""WARC files compressed record by record with a Zstandard dictionary of their own.

A writer task keeps its first records, builds a dictionary from them, and starts the file with a
skippable frame that holds it. Every record is then a frame of its own, so that it can be read by
itself once the dictionary is loaded. Where too few bytes were kept, the frame is left out.

Of the records with equal payloads of at least ``LEAST`` bytes the one of the smallest page is a
response; the others are revisits, which name it and hold no payload. Smaller payloads are always
written as responses.

Results: null html is an empty payload. Rows that repeat the smallest page id of a payload are all
responses. A null page id counts as larger than all others; a revisit of a group in which every id
is null does not exist, since all its rows are responses. An empty table gives no files and an
empty table.
"""

from __future__ import annotations

import hashlib
import io
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetpulse.llm.files import opened, written
from fleetpulse.llm.staging import partitions, shared_folder, sized_batches, staged

LEAST = 100
#: The dictionary: its bytes, the records and bytes it is built from at most, and the bytes it is built from at least.
DICTIONARY, SAMPLES, SAMPLE_BYTES, ENOUGH = 32 << 10, 2_000, 2 << 20, 64 << 10
LEVEL = 3
#: Magic number of the skippable frame that holds a file's dictionary.
MAGIC = 0x184D2A5D
READ = 4 << 20


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, html, digest, refers_to`` of every page; ``refers_to`` is null for responses."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("html")
    ).withColumn("digest", F.sha2(F.encode("html", "UTF-8"), 256))
    long_ones = rows.where(F.octet_length("html") >= LEAST)
    shared = long_ones.groupBy("digest").agg(F.min("page_id").alias("__first"), F.count("*").alias("__n")).where("__n > 1")
    found = rows.join(staged(shared.drop("__n"), "payloads"), "digest", "left")
    other = F.col("__first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("__first"))
    return found.select("page_id", "url", "html", "digest", F.when(other, F.col("__first")).alias("refers_to"))


def record_id(page: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page is None else page}:{digest}>"


def record(page: int | None, url: str | None, html: str, digest: str, refers_to: int | None) -> bytes:
    """A WARC record of a page."""
    payload = html.encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {(url or 'urn:unknown').replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """What a record says about its page; the payload's size and digest are taken from the bytes of a response."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if fields["WARC-Block-Digest"] != f"sha256:{hashlib.sha256(block).hexdigest()}" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
    page = fields["WARC-Record-ID"].split(":")[2]
    refers = fields.get("WARC-Refers-To")
    payload = block.partition(b"\r\n\r\n")[2]
    whole = fields["WARC-Type"] == "response"
    return {
        "page_id": int(page) if page else None, "record_type": fields["WARC-Type"],
        "payload_bytes": len(payload) if whole else None,
        "payload_digest": hashlib.sha256(payload).hexdigest() if whole else fields["WARC-Payload-Digest"].split(":")[1],
        "refers_to": int(refers.split(":")[2]) if refers else None,
    }


def dictionary_of(samples: list[bytes]) -> bytes:
    """A dictionary for records like the samples, or nothing if they are too few."""
    import zstandard

    if len(samples) < 8 or sum(map(len, samples)) < ENOUGH:
        return b""
    # few clusters of parameters: the search for better ones costs more than it saves
    return zstandard.train_dictionary(DICTIONARY, samples, k=200, d=8, threads=0).as_bytes()


class Writer:
    """Collects the first records for the dictionary, then writes one frame per record."""

    def __init__(self, out) -> None:
        self.out, self.kept, self.size, self.compressor, self.n = out, [], 0, None, 0

    def add(self, data: bytes) -> None:
        self.n += 1
        if self.compressor:
            self.out.write(self.compressor.compress(data))
            return
        self.kept.append(data)
        self.size += len(data)
        if len(self.kept) >= SAMPLES or self.size >= SAMPLE_BYTES:
            self.start()

    def start(self) -> None:
        import zstandard

        # one very long record does not fill the dictionary
        found = dictionary_of([d[: SAMPLE_BYTES // 16] for d in self.kept])
        if found:
            packed = zstandard.ZstdCompressor(level=19).compress(found)
            self.out.write(struct.pack("<II", MAGIC, len(packed)) + packed)
        shared = zstandard.ZstdCompressionDict(found) if found else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=shared, write_checksum=True)
        for data in self.kept:
            self.out.write(self.compressor.compress(data))
        self.kept = []

    def end(self) -> None:
        if not self.compressor:
            self.start()


def read_file(path: str) -> Iterator[bytes]:
    """The records of a file, a frame at a time."""
    import zstandard

    with opened(path) as file:
        head, shared = file.read(8), None
        rest = head
        if len(head) == 8 and struct.unpack("<II", head)[0] == MAGIC:
            found = file.read(struct.unpack("<II", head)[1])
            shared, rest = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(found)), b""
        reader = zstandard.ZstdDecompressor(dict_data=shared)
        frame, out = reader.decompressobj(), io.BytesIO()
        while True:
            rest = rest or file.read(READ)
            if not rest:
                break
            out.write(frame.decompress(rest))
            rest = b""
            if frame.eof:
                rest = frame.unused_data
                yield out.getvalue()
                frame, out = reader.decompressobj(), io.BytesIO()


def write_archives(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", folder: str | None = None, files: int | None = None
) -> DataFrame:
    """Writes the archives; returns a row per file: ``path, n_records``."""
    spark = pages.sparkSession
    files, folder = files or partitions(spark), folder or shared_folder(spark, "archives")
    sized_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        path, ctx, own = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst", None, None
        for b in batches:
            if own is None and b.num_rows:
                ctx = written(path)
                own = Writer(ctx.__enter__())
            for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to")), strict=True):
                own.add(record(*row))
        if own is not None:
            own.end()
            ctx.__exit__(None, None, None)
            yield pa.RecordBatch.from_pylist([{"path": path, "n_records": own.n}])

    # the page and its payload decide the file, and so the order within it
    rows = plan_records(pages, id_col, url_col, html_col).repartition(files, "page_id", "digest").sortWithinPartitions("page_id", "digest")
    return staged(rows.mapInArrow(run, "path string, n_records long"), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Reads archives back: ``page_id, payload_bytes, payload_digest, record_type, refers_to`` per record.

    A revisit gets the size of the payload it names from that payload's response.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                for data in read_file(path):
                    rows.append(parsed(data))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kinds)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    spread = manifest.repartition(partitions(manifest.sparkSession), "path")
    rows = staged(spread.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"), "read")
    revisited = rows.where("record_type = 'revisit'").select("payload_digest").distinct()
    sizes = rows.where("record_type = 'response'").join(revisited, "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("__size"))
    found = rows.where("record_type = 'revisit'").join(sizes, "payload_digest", "left").withColumn("payload_bytes", F.col("__size"))
    return rows.where("record_type = 'response'").unionByName(found.drop("__size"))
