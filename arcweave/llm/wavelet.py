"""Token-ID files: one wavelet matrix per shard.

A file holds a run of documents in ascending doc_id: their ids, lengths and all tokens as bit-planes over the shard's
own alphabet, each plane compressed by zstd. Rank and select on the planes give single tokens, counts and places of
occurrence without decoding the rest; decoding everything goes plane by plane.

    magic b"AWWM1\\n\\0\\0" | uint64 length of the header | header (JSON: counts, zeros per plane, section sizes) | sections
    sections: alphabet (uint32), doc_id (int64), null flags (uint8), tokens per document (int64), planes (bits, little-endian)
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm.tokens import encoder
from arcweave.llm.words import pieces, text_buffer

MAGIC = b"AWWM1\n\0\0"
#: Tokens after which a shard's file is closed, bytes of text that a range of doc_ids has on average, and the most ranges
#: there are (one number for each on the driver, a row for each in one task).
FILE_TOKENS, RANGE_BYTES, RANGES = 8_000_000, 24 << 20, 1 << 16


def _filter(values: np.ndarray, bits: np.ndarray, n: int) -> np.ndarray:
    mask = pa.BooleanArray.from_buffers(pa.bool_(), n, [None, pa.py_buffer(bits)])
    kind = pa.uint16() if values.dtype == np.uint16 else pa.uint32()
    return pa.Array.from_buffers(kind, n, [None, pa.py_buffer(values)]).filter(mask).to_numpy(zero_copy_only=False)


def planes_of(symbols: np.ndarray, levels: int) -> tuple[list[np.ndarray], list[int]]:
    """Bit-planes from the highest bit on; each next plane has the zeros of the one before first, then its ones."""
    v = np.ascontiguousarray(symbols, np.uint16 if levels <= 16 else np.uint32)
    n, planes, zeros = len(v), [], []
    for level in reversed(range(levels)):
        bits = np.packbits((v & v.dtype.type(1 << level)) != 0, bitorder="little")
        low = _filter(v, ~bits, n)
        planes.append(bits)
        zeros.append(len(low))
        if level:
            v = np.concatenate([low, _filter(v, bits, n)])
    return planes, zeros


class WaveletMatrix:
    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self._words: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(planes)

    def _directory(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """The plane as 64-bit words, and the ones before each word."""
        if self._words[level] is None:
            padded = np.zeros(self.n // 64 * 8 + 8, np.uint8)
            padded[: len(self.planes[level])] = self.planes[level]
            words = padded.view("<u8")
            self._words[level] = words, np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        return self._words[level]

    def _rank1(self, level: int, i: int) -> int:
        words, before = self._directory(level)
        w, b = divmod(i, 64)
        return int(before[w]) + (int(words[w]) & ((1 << b) - 1)).bit_count()

    def _select(self, level: int, k: int, one: bool) -> int:
        """The place of the k-th (from 0) one or zero."""
        words, before = self._directory(level)
        count = before if one else np.arange(len(before)) * 64 - before
        w = int(np.searchsorted(count, k, "right")) - 1
        word = int(words[w]) if one else ~int(words[w]) & (1 << 64) - 1
        for _ in range(k - int(count[w])):
            word &= word - 1
        return w * 64 + (word & -word).bit_length() - 1

    def access(self, i: int) -> int:
        symbol = 0
        for level, zeros in enumerate(self.zeros):
            words, _ = self._directory(level)
            bit, one = int(words[i // 64]) >> (i % 64) & 1, self._rank1(level, i)
            symbol = symbol << 1 | bit
            i = zeros + one if bit else i - one
        return symbol

    def _narrow(self, symbol: int, i: int, j: int) -> tuple[int, int]:
        for level, zeros in enumerate(self.zeros):
            a, b = self._rank1(level, i), self._rank1(level, j)
            i, j = (zeros + a, zeros + b) if symbol >> (len(self.zeros) - 1 - level) & 1 else (i - a, j - b)
        return i, j

    def count(self, symbol: int, i: int = 0, j: int | None = None) -> int:
        """Occurrences in [i, j)."""
        i, j = self._narrow(symbol, i, self.n if j is None else j)
        return j - i

    def occurrences(self, symbol: int, i: int = 0, j: int | None = None) -> list[int]:
        """Places in [i, j), ascending."""
        found = []
        for at in range(*self._narrow(symbol, i, self.n if j is None else j)):
            for level in reversed(range(len(self.zeros))):
                one = bool(symbol >> (len(self.zeros) - 1 - level) & 1)
                at = self._select(level, at - self.zeros[level] if one else at, one)
            found.append(at)
        return found

    def decode(self) -> np.ndarray:
        v = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for level in reversed(range(len(self.planes))):
            zeros, bit = self.zeros[level], np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            v[zeros:] |= v.dtype.type(1 << (len(self.planes) - 1 - level))
            up = np.empty_like(v)
            np.place(up, bit, v[zeros:]) if zeros < self.n else None
            np.place(up, ~bit, v[:zeros]) if zeros else None
            v = up
        return v


def encode_file(ids: np.ndarray, tokens: np.ndarray, ends: np.ndarray, no_id: np.ndarray | None = None) -> bytes:
    """A file of documents ``ids`` whose tokens stand in a row, each up to its end."""
    alphabet, symbols = np.zeros(0, np.uint32), tokens
    if len(tokens):
        seen = np.zeros(int(tokens.max()) + 1, bool)
        seen[tokens] = True
        alphabet = np.flatnonzero(seen).astype(np.uint32)
        symbols = (np.cumsum(seen) - 1).astype(np.uint32)[tokens]
    levels = max(1, (len(alphabet) - 1).bit_length())
    planes, zeros = planes_of(symbols, levels)
    no_id = np.zeros(len(ids), np.uint8) if no_id is None else no_id.astype(np.uint8)
    press = zstandard.ZstdCompressor(level=1)
    raw = [alphabet, ids.astype(np.int64), no_id, np.diff(ends, prepend=0).astype(np.int64), *planes]
    sections = [press.compress(x.tobytes()) for x in raw]
    header = json.dumps({"documents": len(ids), "tokens": len(tokens), "zeros": zeros, "sections": list(map(len, sections)), "raw": [x.nbytes for x in raw]}).encode()
    return MAGIC + struct.pack("<Q", len(header)) + header + b"".join(sections)


class TokenFile:
    """A file read back."""

    def __init__(self, content: bytes):
        if content[:8] != MAGIC:
            raise ValueError("not a token file")
        (size,) = struct.unpack_from("<Q", content, 8)
        h = json.loads(content[16 : 16 + size])
        at, parts, press = 16 + size, [], zstandard.ZstdDecompressor()
        for n, raw in zip(h["sections"], h["raw"], strict=True):
            parts.append(np.frombuffer(press.decompress(content[at : at + n], max_output_size=max(raw, 1)) if raw else b"", np.uint8))
            at += n
        self.alphabet, self.ids, self.no_id = parts[0].view("<u4"), parts[1].view("<i8"), parts[2].astype(bool)
        self.ends = np.cumsum(parts[3].view("<i8"))
        self.matrix = WaveletMatrix(h["tokens"], parts[4:], h["zeros"])

    def tokens(self) -> np.ndarray:
        return self.alphabet[self.matrix.decode()] if self.matrix.n else np.zeros(0, np.uint32)

    def _symbol(self, token: int) -> int | None:
        i = int(np.searchsorted(self.alphabet, token))
        return i if i < len(self.alphabet) and self.alphabet[i] == token else None

    def token(self, i: int) -> int:
        return int(self.alphabet[self.matrix.access(i)])

    def count(self, token: int, i: int = 0, j: int | None = None) -> int:
        symbol = self._symbol(token)
        return 0 if symbol is None else self.matrix.count(symbol, i, j)

    def occurrences(self, token: int, i: int = 0, j: int | None = None) -> list[int]:
        symbol = self._symbol(token)
        return [] if symbol is None else self.matrix.occurrences(symbol, i, j)


def put(path: str, content: bytes) -> None:
    """Write a file to any store that pyarrow knows, the shared folder's among them."""
    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    with store.open_output_stream(name, compression=None) as out:
        out.write(content)


def get(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(path)
    with store.open_input_file(name) as f:
        return f.read()


def _write(spec, end: int, folder: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        bucket, part, size = None, 0, 0

        def close() -> pa.RecordBatch:
            nonlocal held, size, part
            ids, no_id, tokens, ends, base = [], [], [], [], 0
            for i, z, t, e in held:
                ids.append(i)
                no_id.append(z)
                tokens.append(t)
                ends.append(e[1:] + base)
                base += len(t)
            ids, ends = np.concatenate(ids), np.concatenate(ends)
            # Each attempt of a task has names of its own; only those of the one that counts get into the manifest.
            path = f"{folder}/{bucket:07d}-{part:05d}-{uuid.uuid4().hex}.wm"
            put(path, encode_file(ids, np.concatenate(tokens), ends, np.concatenate(no_id)))
            row = [[bucket], [part], [path], [len(ids)], [base]]
            held, size, part = [], 0, part + 1
            return pa.RecordBatch.from_arrays([pa.array(x[0:1]) if isinstance(x[0], str) else pa.array(x, pa.int64()) for x in row], names=["bucket", "part", "file", "documents", "tokens"])

        coder = encoder(spec.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            of = np.array(batch.column("_bucket"))
            for a, b in zip(edges := [0, *(np.flatnonzero(np.diff(of)) + 1).tolist()], [*edges[1:], len(of)], strict=True):
                if bucket is not None and int(of[a]) != bucket:
                    if held:
                        yield close()
                    part = 0
                bucket = int(of[a])
                for piece in pieces(iter([batch.slice(a, b - a)]), 2 << 20):
                    ids = piece.column("doc_id")
                    held.append((np.array(ids.fill_null(0)), np.array(ids.is_null()), *coder.encode(*text_buffer(piece.column("text")), end)))
                    size += len(held[-1][2])
                    if size >= FILE_TOKENS:
                        yield close()
        if held:
            yield close()

    return write


def write_files(docs: DataFrame, spec: str, folder: str, end: int = 0) -> DataFrame:
    """Encode all documents (doc_id, text) and write them in ascending doc_id; the manifest, a row for each file:
    bucket and part (in this order, files follow each other), file, documents, tokens, start (tokens in files before).

    spec: a tokenizer file's JSON. ``end`` is put after each document. A null text is empty: its end id only. Null
    doc_ids come first; rows that share a doc_id stand side by side. No rows make no files. Other columns are left
    aside. folder: a URI that all machines reach.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    total = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("bytes")).first()
    ranged, n = cluster.ranged(docs, "doc_id", max(1, min(max(cluster.shuffle_partitions(spark), total["bytes"] // RANGE_BYTES), total["n"], RANGES)))
    ordered = ranged.repartitionById(n, F.col("_bucket")).sortWithinPartitions("_bucket", F.col("doc_id").asc_nulls_first())
    shared = spark.sparkContext.broadcast(spec)  # a tokenizer file: a few megabytes, whatever the corpus
    files = cluster.checkpointed(ordered.mapInArrow(_write(shared, end, folder), "bucket long, part long, file string, documents long, tokens long"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = files.groupBy("bucket").agg(F.sum("tokens").alias("n")).select("bucket", F.coalesce(F.sum("n").over(before("bucket")), F.lit(0)).alias("ahead"))
    inside = F.coalesce(F.sum("tokens").over(before("bucket", "part")), F.lit(0))
    return files.withColumn("inside", inside).join(ahead, "bucket").select("bucket", "part", "file", "documents", "tokens", (F.col("ahead") + F.col("inside")).alias("start"))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            f = TokenFile(get(row["file"]))
            raw = memoryview(f.tokens().astype("<u4").tobytes())
            ends = f.ends
            begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(f.ids, mask=f.no_id),
                    pa.array(begins + row["start"]),
                    pa.array(ends - begins),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                ],
                names=["doc_id", "start", "n_tokens", "ids_crc32"],
            )


def read_documents(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the files of a manifest."""
    n = cluster.shuffle_partitions(manifest.sparkSession)
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def occurrences(manifest: DataFrame, token: int) -> DataFrame:
    """Places of a token in the whole corpus (tokens before it), by rank and select in each file."""

    def find(batches):
        for batch in batches:
            for row in batch.to_pylist():
                found = TokenFile(get(row["file"])).occurrences(token)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(found, np.int64) + row["start"])], names=["place"])

    return manifest.select("file", "start").mapInArrow(find, "place long")


def op10_wavelet(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    files = write_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), spec, cluster.new_folder(spark, "tokens"))
    return read_documents(files)
