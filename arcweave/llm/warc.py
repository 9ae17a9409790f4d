"""WARC archives in seekable Zstandard bundles.

A bundle is a row of independent zstd frames of some records each, then a skippable frame with the seek table (the
compressed and the plain size of every frame), so that any zstd tool reads the whole and a reader that knows the
table goes straight to a frame. An index maps records to (file, frame, offset in the frame, length).

    frames | 0x184D2A5E, size | per frame: uint32 compressed, uint32 plain | uint32 frames, uint8 0, uint32 0x8F92EAB1
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm.wavelet import get, put

FRAME_BYTES, FILE_BYTES = 1 << 20, 64 << 20
#: Payloads from this size on are stored once.
LEAST_SHARED = 1000
_SKIPPABLE, _SEEK_MAGIC = 0x184D2A5E, 0x8F92EAB1
_SPACE = uuid.UUID("9f5c0d0e-7a55-4a3c-8d5b-6f1d7c1a2b3c")  # names record ids
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}:{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response record, or with refers_to a revisit without the payload."""
    digest = hashlib.sha1(payload).hexdigest()
    target = "".join(c if c > " " else f"%{ord(c):02X}" for c in url) if url else f"urn:page:{page_id}"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id, digest)}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Page-ID: {'' if page_id is None else page_id}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and payload (empty for revisits) of the records in a row."""
    at = 0
    while at < len(raw):
        end = raw.index(b"\r\n\r\n", at)
        lines = raw[at:end].decode().split("\r\n")
        headers = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        start, size = end + 4, int(headers["content-length"])
        block = raw[start : start + size]
        payload = block[block.index(b"\r\n\r\n") + 4 :]
        if headers["warc-type"] == "response" and hashlib.sha1(payload).hexdigest() != headers["warc-payload-digest"].removeprefix("sha1:"):
            raise ValueError(f"record {headers['warc-record-id']} is damaged")
        yield headers, payload
        at = start + size + 4


class Bundle:
    """Collects records into frames; ``done`` gives the file's bytes."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.frames, self.sizes, self.part, self.held = frame_bytes, [], [], [], 0
        self.press = zstandard.ZstdCompressor(level=3)

    @property
    def size(self) -> int:
        return sum(map(len, self.frames)) + self.held

    def add(self, raw: bytes) -> tuple[int, int]:
        """The frame and the offset in it that a record gets."""
        if self.held and self.held + len(raw) > self.frame_bytes:
            self._close()
        place = len(self.frames), self.held
        self.part.append(raw)
        self.held += len(raw)
        return place

    def _close(self) -> None:
        if self.part:
            plain = b"".join(self.part)
            self.frames.append(self.press.compress(plain))
            self.sizes.append((len(self.frames[-1]), len(plain)))
            self.part, self.held = [], 0

    def done(self) -> bytes:
        self._close()
        table = b"".join(struct.pack("<II", *s) for s in self.sizes) + struct.pack("<IBI", len(self.sizes), 0, _SEEK_MAGIC)
        return b"".join(self.frames) + struct.pack("<II", _SKIPPABLE, len(table)) + table


def seek_table(tail: bytes) -> list[tuple[int, int]]:
    """(compressed, plain) sizes of the frames, from the end of a file."""
    n, _, magic = struct.unpack("<IBI", tail[-9:])
    if magic != _SEEK_MAGIC:
        raise ValueError("no seek table")
    return [struct.unpack_from("<II", tail, len(tail) - 9 - 8 * (n - i)) for i in range(n)]


def frames_of(content: bytes) -> Iterator[bytes]:
    at = 0
    for compressed, plain in seek_table(content):
        yield zstandard.ZstdDecompressor().decompress(content[at : at + compressed], max_output_size=max(plain, 1))
        at += compressed


def read_record(path: str, frame: int, offset: int, length: int) -> tuple[dict[str, str], bytes]:
    """One record by its place: two short reads and one frame."""
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        size = f.size()
        f.seek(size - 9)
        n = struct.unpack("<IBI", f.read(9))[0]
        f.seek(size - 9 - 8 * n)
        table = seek_table(f.read(9 + 8 * n))
        f.seek(sum(c for c, _ in table[:frame]))
        raw = zstandard.ZstdDecompressor().decompress(f.read(table[frame][0]), max_output_size=max(table[frame][1], 1))
    return next(parse(raw[offset : offset + length]))


def _write(folder: str, frame_bytes: int, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, rows = Bundle(frame_bytes), []

        def close() -> pa.RecordBatch:
            nonlocal bundle, rows
            # A name of its own for each attempt; the index names those that count.
            path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
            put(path, bundle.done())
            columns = list(zip(*rows, strict=True))
            out = pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array([path] * len(rows)), *(pa.array(c, pa.int64()) for c in columns[2:])],
                names=["page_id", "record_id", "file", "frame", "offset", "length"],
            )
            bundle, rows = Bundle(frame_bytes), []
            return out

        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                for r in batch.slice(i, 64).to_pylist():
                    payload = (r["html"] or "").encode("utf-8", "surrogatepass")
                    raw = record(r["page_id"], r["url"], payload, r["refers_to"])
                    rows.append((r["page_id"], record_id(r["page_id"], hashlib.sha1(payload).hexdigest()), *bundle.add(raw), len(raw)))
                    if bundle.size >= file_bytes:
                        yield close()
        if rows:
            yield close()

    return write


def write_archives(pages: DataFrame, folder: str, least_shared: int = LEAST_SHARED, frame_bytes: int = FRAME_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record for each row of pages (page_id, url, html) into bundles in ``folder``, a URI that all machines
    reach; the index: page_id, record_id, file, frame, offset, length.

    Of equal payloads of at least ``least_shared`` bytes, the one with the largest page_id is a response, the others
    are revisits of it; rows that share that page_id are responses all. A null html is an empty payload; a null
    page_id is smaller than any other and its record always a response, as is any smaller payload. A null url is
    named after the page. Other columns are left aside; no rows make no files.
    """
    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("_key", F.sha2("html", 256))
    large = cluster.staged(keyed.where((F.octet_length("html") >= least_shared) & F.col("page_id").isNotNull()).select("page_id", "_key"), "payloads")
    latest = large.groupBy("_key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").select("_key", "refers_to")
    revisits = large.join(cluster.checkpointed(latest), "_key").where("page_id < refers_to").distinct()
    rows = cluster.join_ids(keyed, cluster.checkpointed(revisits.select("page_id", "_key", "refers_to")), ["page_id", "_key"], "left")
    schema = "page_id long, record_id string, file string, frame long, offset long, length long"
    return cluster.staged(rows.select("page_id", "url", "html", "refers_to").mapInArrow(_write(folder, frame_bytes, file_bytes), schema), "index")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column("file").to_pylist():
            for raw in frames_of(get(path)):
                rows = []
                for h, payload in parse(raw):
                    number = lambda name: int(h[name]) if h.get(name) else None  # noqa: B023, E731
                    kind = h["warc-type"]
                    rows.append((number("x-page-id"), len(payload) if kind == "response" else number("x-payload-length"), h["warc-payload-digest"].removeprefix("sha1:"), kind, number("x-refers-to-page-id")))
                columns = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])


def read_archives(index: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record in the files of an index."""
    files = index.select("file").distinct().repartition(cluster.shuffle_partitions(index.sparkSession), "file")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op4_warc(spark, sf_dir: str) -> DataFrame:
    return read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), cluster.new_folder(spark, "warc")))


OP4_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
k AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS d, sha256(b) AS k FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY k) AS last FROM k)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id < last THEN last END AS refers_to FROM m
"""
