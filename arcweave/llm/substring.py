"""Substring dedup: every window of 50 words is hashed (Rabin-Karp) and counted; repeated windows are cut out.

Texts travel once, packed into blocks of a few megabytes in a staged table. Each block sends each distinct window
once, with the smallest doc_id that has it, to the bucket of its hash; a bucket answers a block with the places of
those that start in a smaller document elsewhere. So a window which a third of all documents share costs one entry for
each block, not one for each document, and no text is shuffled to find it.

A row holds what one block has for one bucket, and both numbers grow with the corpus. So beyond FAN blocks, blocks send
to FAN ranges of hashes only; there FAN blocks at a time are merged into one, a block of the range, and the same is done
again inside each range. Rows stay thousands of entries long, and levels grow with the logarithm of the corpus.

A window is told by 93 bits: a hash modulo 2**61-1 and 32 bits of one with another base.
"""

from __future__ import annotations

import itertools
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm.words import pieces, rolling, text_buffer, windows, word_hashes

BLOCK_BYTES = 8 << 20
#: Window hashes in one bucket, at most, on average.
BUCKET_HASHES = 4_000_000
#: Nodes that meet in a bucket, at most, and ranges that a node deals to on the way there.
FAN = 512
#: Tasks that answer at once, at most; beyond, a task has several buckets, one after the other.
TASKS = 1 << 16
_NONE = np.iinfo(np.int64).max  # stands for a null doc_id: larger than any other


def pack_words(values: np.ndarray) -> bytes:
    """64-bit integers, byte plane by byte plane, which zstd presses well where the high bytes are alike."""
    planes = np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<q", len(values)) + planes.tobytes())


def unpack_words(blob: bytes) -> np.ndarray:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<q", raw)
    planes = np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, n)
    return np.ascontiguousarray(planes.T).view("<u8").reshape(n)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count = TaskContext.get().partitionId(), 0
    press = zstandard.ZstdCompressor(level=1)
    for batch in pieces(batches, BLOCK_BYTES):
        ids = batch.column("doc_id").cast(pa.int64())
        order = np.argsort(np.array(ids.fill_null(_NONE)), kind="stable")  # smallest doc_id first
        batch = batch.take(pa.array(order))
        ids = batch.column("doc_id").cast(pa.int64())
        data, offsets = text_buffer(batch.column("text"))
        n = sum(len(data[a:b].tobytes().split()) for a, b in zip(offsets[:-1], offsets[1:], strict=True))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([(part << 32) + count]),
                pa.array([n]),
                pa.array([np.array(ids.fill_null(_NONE)).tobytes()], pa.binary()),
                pa.array([np.array(ids.is_null()).tobytes()], pa.binary()),
                pa.array([offsets.tobytes()], pa.binary()),
                pa.array([press.compress(data.tobytes())], pa.binary()),
            ],
            names=["block", "n", "ids", "no_id", "offsets", "text"],
        )
        count += 1


def _order(hashes: np.ndarray, extra: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stable order by both, and where in it a new pair begins."""
    order = np.argsort(hashes, kind="stable")
    h, x = hashes[order], extra[order]
    same = h[1:] == h[:-1]
    if (x[1:][same] != x[:-1][same]).any():  # one hash of two windows
        order = np.lexsort((extra, hashes))
        h, x = hashes[order], extra[order]
        same = h[1:] == h[:-1]
    return order, np.flatnonzero(np.concatenate([[True], ~same | (x[1:] != x[:-1])])[: len(h)])


class _Block:
    """Of a block: where each window starts, its document, and its number among the different windows, in order of hash."""

    def __init__(self, ids: bytes, no_id: bytes, offsets: bytes, text: bytes, length: int):
        self.ids, self.no_id, self.offsets = np.frombuffer(ids, np.int64), np.frombuffer(no_id, bool), np.frombuffer(offsets, np.int64)
        size = int(self.offsets[-1])
        self.text = zstandard.ZstdDecompressor().decompress(text, max_output_size=max(size, 1)) if size else b""
        words, self.first = word_hashes(np.frombuffer(self.text, np.uint8), self.offsets)
        self.start, self.document = windows(self.first, length)
        hashes, extra = rolling(words, length)[self.start], (rolling(words, length, 1)[self.start] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        order, new = _order(hashes, extra)
        self.hashes, self.extra = hashes[order[new]], extra[order[new]]
        self.least = self.ids[self.document[order[new]]]  # documents ascend: the first has the smallest id
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))


_SENT = "range long, node long, at long, low long, hashes binary, extra binary, least binary"
_ANSWER = "range long, node long, places binary"


def _dealt(hashes: np.ndarray, extra: np.ndarray, least: np.ndarray, node: int, first: int, last: int, ranges: int) -> pa.RecordBatch:
    """Rows for ranges first to last of so many, of ascending hashes of a node."""
    bucket = ((hashes >> np.uint64(29)) * np.uint64(ranges)) >> np.uint64(32)
    cuts = np.searchsorted(bucket, np.arange(first, last + 1, dtype=np.uint64)).tolist()
    low = int(least.min())
    out = [(k, x, pack_words(hashes[x:y]), extra[x:y].tobytes(), pack_words((least[x:y] - low).astype(np.uint64))) for k, (x, y) in enumerate(itertools.pairwise(cuts), first) if y > x]
    columns = [[x[0] for x in out], [node] * len(out), [x[1] for x in out], [low] * len(out)]
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), *(pa.array([x[i] for x in out], pa.binary()) for i in (2, 3, 4))], names=["range", "node", "at", "low", "hashes", "extra", "least"])


def _send(length: int, ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                b = _Block(row["ids"], row["no_id"], row["offsets"], row["text"], length)
                if len(b.hashes):
                    yield _dealt(b.hashes, b.extra, b.least, row["block"], 0, ranges, ranges)

    return send


class _Together:
    """Rows of one range side by side: which of their entries are equal, and the smallest document of each window."""

    def __init__(self, rows: list[dict]):
        hashes = [unpack_words(x["hashes"]) for x in rows]
        self.size = [len(x) for x in hashes]
        hashes, extra = np.concatenate(hashes), np.concatenate([np.frombuffer(x["extra"], np.uint32) for x in rows])
        least = np.concatenate([unpack_words(x["least"]).astype(np.int64) + x["low"] for x in rows])
        self.order, self.new = _order(hashes, extra)
        self.hashes, self.extra = hashes[self.order[self.new]], extra[self.order[self.new]]
        del hashes, extra
        self._ordered = least[self.order]
        self.smallest = np.minimum.reduceat(self._ordered, self.new)

    def hits(self, known: np.ndarray | None = None) -> np.ndarray:
        """Of all entries: whether a smaller document has the window, here or (known, of the different windows) elsewhere."""
        n = np.diff(np.append(self.new, len(self.order)))
        found = self._ordered > np.repeat(self.smallest, n)
        if known is not None:
            found |= np.repeat(known, n)
        out = np.empty(len(found), bool)
        out[self.order] = found
        return out


def _places(rows: list[dict], size: list[int], hit: np.ndarray) -> list[tuple[int, int, bytes]]:
    out = []
    for x, end, n in zip(rows, np.cumsum(size).tolist(), size, strict=True):
        found = np.flatnonzero(hit[end - n : end])
        if len(found):
            out.append((x["range"], x["node"], pack_words((found + x["at"]).astype(np.uint64))))
    return out


def _by(key: str):
    """Rows of sorted batches, key by key."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
        rows = (row for batch in batches for row in batch.to_pylist())
        for _, group in itertools.groupby(rows, key=lambda r: (r["range"], r.get(key))):
            yield list(group)

    return groups


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _by("range")(batches):
        t = _Together(rows)
        out = _places([{k: x[k] for k in ("range", "node", "at")} for x in rows], t.size, t.hits())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out]) for i in (0, 1)] + [pa.array([x[2] for x in out], pa.binary())], names=["range", "node", "places"])


def _merge(ranges: int, parts: int):
    """Rows of a group of nodes to those of one node, dealt to the parts of each of the ranges."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by("group")(batches):
            t, of = _Together(rows), rows[0]["range"]
            yield _dealt(t.hashes, t.extra, t.smallest, rows[0]["group"], of * parts, (of + 1) * parts, ranges * parts)

    return merge


def _split(runs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
    """What has been said to a merged node, to the nodes it was made of."""
    if not len(runs):
        return pd.DataFrame({"range": [], "node": [], "places": []})
    rows = runs.to_dict("records")
    t = _Together(rows)
    known = np.zeros(len(t.new), bool)
    for blob in answers["places"]:
        known[unpack_words(blob)] = True
    return pd.DataFrame(_places(rows, t.size, t.hits(known)), columns=["range", "node", "places"])


def _judge(runs: DataFrame, ranges: int, nodes: int, node_entries: int) -> DataFrame:
    """range, node, places (of the node's windows): those that start in a smaller document of another node.

    runs: rows for ranges of hashes, each range with rows of so many nodes, of about so many windows in all ranges.
    """
    n = cluster.shuffle_partitions(runs.sparkSession)
    if nodes <= FAN:
        tasks = min(ranges, TASKS)
        dealt = runs.repartitionById(tasks, (F.col("range") % tasks).cast("int"))
        return (dealt.sortWithinPartitions("range") if tasks < ranges else dealt).mapInArrow(_answer, _ANSWER)
    groups = -(-nodes // FAN)
    parts = FAN if groups > FAN else max(1, -(-groups * FAN * node_entries // (ranges * BUCKET_HASHES)))
    grouped = cluster.staged(runs, "runs", "none").withColumn("group", F.pmod(F.xxhash64("node"), F.lit(groups)))
    merged = grouped.repartition(max(n, min(ranges, TASKS)), "range", "group").sortWithinPartitions("range", "group").mapInArrow(_merge(ranges, parts), _SENT)
    below = cluster.staged(_judge(merged, ranges * parts, groups, FAN * node_entries), "answers", "none")
    below = below.select(F.expr(f"range div {parts}").alias("range"), F.col("node").alias("group"), "places")
    return grouped.groupBy("range", "group").cogroup(below.groupBy("range", "group")).applyInPandas(_split, _ANSWER)


def _runs(flags: np.ndarray) -> list[dict[str, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [{"start": int(a), "end": int(b)} for a, b in edges.reshape(-1, 2)]


def _cut(length: int):
    def cut(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(blocks):
            return pd.DataFrame({"doc_id": [], "n_words": [], "n_removed": [], "removed": [], "kept_text": []})
        row = blocks.iloc[0]
        b = _Block(row["ids"], row["no_id"], row["offsets"], row["text"], length)
        hit = np.zeros(len(b.hashes), bool)
        for blob in answers["places"]:
            hit[unpack_words(blob)] = True
        repeated = hit[b.number] | (b.ids[b.document] > b.least[b.number])
        edge = np.zeros(int(b.first[-1]) + 1, np.int64)
        np.add.at(edge, b.start[repeated], 1)
        np.add.at(edge, b.start[repeated] + length, -1)
        gone = np.cumsum(edge)[:-1] > 0
        kept, runs, count = [], [], []
        for i in range(len(b.ids)):
            words = b.text[b.offsets[i] : b.offsets[i + 1]].split()
            flags = gone[b.first[i] : b.first[i + 1]]
            count.append(int(flags.sum()))
            if count[-1]:
                words = [w for w, f in zip(words, flags.tolist(), strict=True) if not f]
            kept.append(b" ".join(words).decode("utf-8", "replace"))
            runs.append(_runs(flags) if count[-1] else [])
        ids = pd.array(b.ids, dtype="Int64")
        ids[b.no_id] = pd.NA
        return pd.DataFrame({"doc_id": ids, "n_words": np.diff(b.first), "n_removed": count, "removed": runs, "kept_text": kept})

    return cut


def dedup_substrings(docs: DataFrame, length: int = 50) -> DataFrame:
    """Cut out word windows that also start in a document with a smaller doc_id.

    Takes doc_id and text (other columns are left aside); gives one row per input row: doc_id, n_words, n_removed,
    removed (maximal intervals of word numbers, end exclusive) and kept_text (kept words joined by one space).

    Windows are judged on the input. A null or empty text, or one of fewer than ``length`` words, keeps all it has.
    Repeats within one document stay, and so do those between rows that share a doc_id: neither is smaller. A null
    doc_id counts as larger than any other. An empty table gives an empty one.

    Two different windows share their 93 bits with a chance of about 2**-93 a pair.
    """
    spark = docs.sparkSession
    blocks = cluster.staged(
        docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(
            _pack, "block long, n long, ids binary, no_id binary, offsets binary, text binary"
        ),
        "blocks",
        "none",
    )
    count, total = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    ranges = FAN if count > FAN else max(cluster.shuffle_partitions(spark), -(-total // BUCKET_HASHES))
    # Once they are answered, the window hashes on disk are gone.
    runs = blocks.mapInArrow(_send(length, ranges), _SENT)
    answers = cluster.staged(_judge(runs, ranges, count, -(-total // max(count, 1))), "answers", "none").select(F.col("node").alias("block"), "places")
    return (
        blocks.drop("n")
        .groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(_cut(length), "doc_id long, n_words long, n_removed long, removed array<struct<start:int,end:int>>, kept_text string")
    )


def op2_substring_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


#: Window functions over one row per window; run on small tables, where it is exact by comparing the words themselves.
OP2_SQL = r"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM docs WHERE len(w) >= 50),
windows AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts),
judged AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS least FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM judged WHERE least < doc_id),
lists AS (SELECT doc_id, list(k) AS ks FROM gone GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ks), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ks IS NULL THEN w ELSE list_filter(w, lambda x, j: NOT list_contains(ks, j)) END, ' ')) AS kept_sha256
FROM docs d LEFT JOIN lists USING (doc_id)
"""
