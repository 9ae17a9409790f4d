"""Document fingerprints: MinHash signatures over five-word shingles.

A shingle's 64-bit hash (over word hashes) goes through 128 universal hash permutations a*h + b modulo
2**64; for each, the smallest value over a document's shingles is kept, of it 16 bits. The share of equal components
estimates the Jaccard similarity of the shingle sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm import similar
from arcweave.llm.words import mix, pieces, shingle_hashes, text_buffer

SHINGLE, PERMUTATIONS, SEED = 5, 128, 20240229
_PIECE = 1 << 20


def _family(level: int = 0) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + level)
    draw = lambda: rng.integers(0, 2**64, PERMUTATIONS, np.uint64)
    return draw() | np.uint64(1), draw()


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """uint16 (texts, permutations); texts without words have the largest value throughout."""
    return _signed(*shingle_hashes(data, offsets, SHINGLE))


def _signed(h: np.ndarray, first: np.ndarray, level: int = 0) -> np.ndarray:
    out = np.full((len(first) - 1, PERMUTATIONS), 0xFFFF, np.uint16)
    some = np.flatnonzero(np.diff(first))
    if len(some):
        starts, v = first[some], np.empty_like(h)
        for k, (a, b) in enumerate(zip(*_family(level), strict=True)):
            np.multiply(h, a, out=v)
            np.add(v, b, out=v)
            # From the middle: the high bits of a minimum are zeros, the lowest ones have a short period.
            out[some, k] = (np.minimum.reduceat(v, starts) >> np.uint64(20)).astype(np.uint16)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).mean(axis=-1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (hex, four digits a component) of every whole text.

    Equal texts have equal fingerprints. A null text is an empty one; empty texts are alike. One row per input row,
    with its doc_id, null or not; other columns are left aside.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, _PIECE):
            sig = signatures(*text_buffer(piece.column("text")))
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([_hex(s) for s in sig], pa.string())], names=["doc_id", "fingerprint"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fingerprint string")


def _hex(signature: np.ndarray) -> str:
    return signature.astype(">u2").tobytes().hex()


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of range, head flag and descending doc_id; each is compared with the row behind it."""
    last = None  # (range, doc_id, text, signature) of the row that still waits for the next

    def compare(pairs: list[tuple]) -> pa.RecordBatch:
        texts = []
        for (_, _, text, _), (_, _, following, _) in pairs:
            k = len(text) // 3
            texts.append((text[: len(text) - k] + following[:k]).encode("utf-8", "surrogatepass"))
        offsets = np.cumsum([0, *map(len, texts)])
        edited = signatures(np.frombuffer(b"".join(texts), np.uint8), offsets)
        own, following = (np.stack([p[i][3] for p in pairs]) for i in (0, 1))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([p[0][1] for p in pairs], pa.int64()),
                pa.array([len(p[0][2]) for p in pairs], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                pa.array([_hex(s) for s in own], pa.string()),
                pa.array([_hex(s) for s in edited], pa.string()),
                pa.array(likeness(own, edited)),
                pa.array(likeness(own, following)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for piece in pieces(batches, _PIECE):
        sig = signatures(*text_buffer(piece.column("text")))
        pairs = []
        for row in zip(*(piece.column(c).to_pylist() for c in ("_range", "doc_id", "text", "_head")), sig, strict=True):
            here = (row[0], row[1], row[2] or "", row[4])
            if last is not None and last[0] == here[0]:
                pairs.append((last, here))
            elif row[3]:
                continue  # one more head of a range that has had its next
            last = None if row[3] else here
        if pairs:
            yield compare(pairs)


def with_edits(docs: DataFrame) -> DataFrame:
    """Each text's fingerprint beside that of its edited text, whose last third is the next document's beginning.

    Documents follow each other by descending doc_id, null ids last, rows of one id by text; the first follows the
    last, and a single row itself. Texts are sorted in ranges of doc_id. The first row of a range is also sent to the
    range before it, so that a task sees each row's next; which rows these are takes one number per range.
    """
    spark = docs.sparkSession
    least = -(1 << 63)
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string"))
    rows, n = cluster.ranged(rows, "doc_id", cluster.shuffle_partitions(spark))
    rows = rows.withColumn("_order", F.coalesce("doc_id", F.lit(least)))
    found = sorted(((r["_bucket"], r["_order"]) for r in rows.groupBy("_bucket").agg(F.max("_order").alias("_order")).collect()), reverse=True)
    heads = spark.createDataFrame([(b, o, found[i - 1][0]) for i, (b, o) in enumerate(found)], "_bucket int, _order long, _before int")
    sent = F.when(F.col("_before").isNull(), F.array(F.struct(F.col("_bucket").alias("r"), F.lit(False).alias("h")))).otherwise(
        F.array(F.struct(F.col("_bucket").alias("r"), F.lit(False).alias("h")), F.struct(F.col("_before").alias("r"), F.lit(True).alias("h")))
    )
    return (
        rows.join(F.broadcast(heads), ["_bucket", "_order"], "left")  # at most a row for each range
        .select("doc_id", "text", "_order", F.explode(sent).alias("s"))
        .select("doc_id", "text", "_order", F.col("s.r").alias("_range"), F.col("s.h").alias("_head"))
        .repartitionById(n, F.col("_range"))
        .sortWithinPartitions("_range", "_head", F.col("_order").desc(), F.col("doc_id").desc_nulls_last(), "text")
        .select("doc_id", "text", "_range", "_head")
        .mapInArrow(_edited, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    )


#: Bands of the signature that are joined: at a similarity of 0.8 some of 25 bands of 5 agree in all but 5 of 100,000 pairs.
BANDS, ROWS = 25, 5


def band_keys(h: np.ndarray, first: np.ndarray, level: int = 0) -> np.ndarray:
    """uint64 (texts, BANDS): equal keys where a band of the signatures agrees. Levels have permutations of their own."""
    sig = _signed(h, first, level)[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.zeros(sig.shape[:2], np.uint64) + np.arange(BANDS, dtype=np.uint64)
    for r in range(ROWS):
        key = mix(key ^ sig[:, :, r])
    return key


def finer(level: int):
    """Rows (bucket, node, shingles, component) to members of finer buckets: other bands inside each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(iter([batch]), _PIECE, "shingles"):
                sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in part.column("shingles")]
                size = np.array(list(map(len, sets)))
                keys = band_keys(np.concatenate(sets), np.concatenate([[0], np.cumsum(size)]), level + 1)
                of = np.array(part.column("bucket")).astype(np.int64).view(np.uint64)
                keys = mix(keys ^ mix(of + np.uint64(level))[:, None])
                repeat = np.repeat(np.arange(len(sets)), BANDS)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel().view(np.int64)), part.column("node").take(pa.array(repeat)), pa.array(size[repeat], pa.int32()), part.column("component").take(pa.array(repeat))],
                    names=["bucket", "node", "size", "component"],
                )

    return run


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, _PIECE):
        h, first = shingle_hashes(*text_buffer(piece.column("text")), SHINGLE)
        size = [len(np.unique(h[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        keys = band_keys(h, first).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(piece.column(c) for c in similar.KEY), pa.array(size, pa.int32()), pa.array(list(keys), pa.list_(pa.int64()))],
            names=[*similar.KEY, "size", "bands"],
        )


def near_duplicates(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """doc_id and component_id: the smallest doc_id that chains of similar texts reach, one row per input row.

    Similar: a Jaccard similarity of at least ``similarity`` of the sets of five-word shingles, verified on these.
    Candidates are all texts whose signatures agree in a band; ``similar.components`` verifies all pairs of a bucket
    that aren't in one group already, large ones by way of further bands. Equal texts are one group; null and empty
    texts are one text. A null doc_id is never the smallest. An empty table gives an empty one.
    """
    rows = similar.keyed(docs.select("doc_id", "text")).select(*similar.KEY, "text")
    banded = cluster.staged(rows.mapInArrow(_banded, "h1 long, h2 long, no_id int, id long, size int, bands array<long>"), "bands")
    nodes, sets_of = similar.texts_of(banded, rows, SHINGLE, ["size", "bands"])
    members = nodes.select("node", "size", F.col("node").alias("component"), F.explode("bands").alias("bucket"))
    component = similar.components(members, None, sets_of, similarity, finer)
    of = nodes.select("h1", "h2", "node").join(component, "node", "left").select("h1", "h2", F.coalesce("component", "node").alias("component"))
    ids = cluster.staged(banded.select(*similar.KEY).join(of, ["h1", "h2"]).select(F.when(F.col("no_id") == 0, F.col("id")).alias("doc_id"), "component"), "components")
    cluster.discard(banded, nodes)
    least = cluster.checkpointed(ids.groupBy("component").agg(F.min("doc_id").alias("component_id")))
    return ids.join(least, "component").select("doc_id", "component_id")


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    return with_edits(spark.read.parquet(f"{sf_dir}/documents.parquet"))
