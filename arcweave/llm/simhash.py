"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into d // 2 + 1 segments, so that of two fingerprints at d or fewer differing bits one
segment differs in at most one bit. Each segment is indexed once for each of its bits with that bit left out: equal
keys are candidates, verified by the number of differing bits. That is 64 keys for a distinct fingerprint, whatever d.

Candidates meet in sorted runs of a key. A run emits a star for each set of fingerprints it links, never its pairs; a
run that is too long for comparing all with all is indexed again by the bits that its key leaves open.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.algorithms.contraction import smallest_member
from arcweave.llm import minhash, similar
from arcweave.llm.words import pieces, shingle_hashes, text_buffer

SEED = 42
#: Runs up to this length are compared all with all; longer ones get finer keys while bits are left to make them from.
RUN = 4096
_SMALL = 8
_CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int, seed: int = SEED) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and the six separators only
    if not words:
        return 0
    size = np.fromiter(map(len, words), np.int64, len(words))
    line = b" ".join(words)
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    k = min(shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    digest, count = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _CHUNK):
        pair = zip(starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist(), strict=True)
        h = np.array([digest(line[a:b], seed) for a, b in pair], "<u8")
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * count > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ("doc_id",), seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """The columns ``keep`` and ``fp`` (BIGINT, the 64 bits as a signed number), or fp0, fp1 ... for more seeds than one.

    A null text has no words: 0.
    """
    names = ["fp"] if len(seeds) == 1 else [f"fp{i}" for i in range(len(seeds))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(iter([batch]), 2 << 20, "_text"):
                data, offsets = text_buffer(part.column("_text"))
                raw, cuts = data.tobytes(), offsets.tolist()
                columns = [np.array([fingerprint(raw[a:b], shingle, seed) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], np.uint64) for seed in seeds]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *(pa.array(c.view(np.int64)) for c in columns)], names=[*keep, *names])

    source = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(run, fields + "".join(f", {n} bigint" for n in names))


def _segments(bits: list[int], pieces_: int) -> list[list[int]]:
    cuts = [len(bits) * i // pieces_ for i in range(pieces_ + 1)]
    return [bits[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def _star(fps: np.ndarray, bit: int, every: bool, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars over what a run links. every: all pairs count, else those that differ in the left-out bit."""
    n = len(fps)
    side = (fps >> np.uint64(bit)) & np.uint64(1)
    root = np.full(n, -1)
    rest = np.arange(n)
    while len(rest):
        start = rest[0]
        root[start] = start
        front = np.array([start])
        rest = rest[1:]
        while len(front) and len(rest):
            near = np.zeros(len(rest), bool)
            for at in range(0, len(front), 256):
                f = front[at : at + 256]
                hit = np.bitwise_count(fps[f][:, None] ^ fps[rest][None, :]) <= most
                if not every:
                    hit &= side[f][:, None] != side[rest][None, :]
                near |= hit.any(axis=0)
            front, rest = rest[near], rest[~near]
            root[front] = start
    member = np.flatnonzero(root != np.arange(n))
    return fps[root[member]], fps[member]


def _link(most: int, last: bool, limit: int):
    """Sorted rows (key, fp, bit, every, segment) to stars (a, b), or for runs that are too long to their rows again."""

    def emit(a, b, key, segment) -> pa.RecordBatch:
        """segment: of rows to be indexed again, else None."""
        segment = np.full(len(a), -1) if segment is None else segment
        return pa.RecordBatch.from_arrays(
            [pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(key), pa.array(segment, pa.int32())], names=["a", "b", "key", "segment"]
        )

    def whole(key: np.ndarray, fp: np.ndarray, bit: np.ndarray, every: np.ndarray, segment: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.append(edge, len(key)))
        run = np.repeat(size, size)
        number = np.repeat(np.arange(len(edge)), size)
        a, b = [], []
        for k in range(1, min(_SMALL, int(size.max(initial=0)))):
            i = np.flatnonzero((number[:-k] == number[k:]) & (run[:-k] <= _SMALL))
            x, y = fp[i], fp[i + k]
            ok = np.bitwise_count(x ^ y) <= most
            ok &= every[i] | (((x ^ y) >> bit[i]) & np.uint64(1)).astype(bool)
            a.append(x[ok])
            b.append(y[ok])
        for e in np.flatnonzero(size > _SMALL):
            s = slice(edge[e], edge[e] + size[e])
            if size[e] > limit and not last:
                yield emit(fp[s], fp[s], key[s], segment[s])
                continue
            x, y = _star(fp[s], int(bit[edge[e]]), bool(every[edge[e]]), most)
            a.append(x)
            b.append(y)
        if a and sum(map(len, a)):
            x, y = np.concatenate(a), np.concatenate(b)
            yield emit(x, y, np.zeros(len(x), np.int64), None)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last run so far, which may go on
        long = None  # the key of a run that is known to be too long

        def columns(batch):
            get = lambda name, kind: np.array(batch.column(name)).astype(kind, copy=False)
            return [get("key", np.int64), get("fp", np.int64).view(np.uint64), get("bit", np.int64).astype(np.uint64), get("every", bool), get("segment", np.int64)]

        for batch in batches:
            if not batch.num_rows:
                continue
            new = columns(batch)
            if held:
                new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            key = new[0]
            if long is not None:  # goes straight on
                n = int(np.searchsorted(key, long, "right"))
                if n:
                    yield emit(new[1][:n], new[1][:n], key[:n], new[4][:n])
                new = [x[n:] for x in new]
                key = new[0]
                if not len(key):
                    held = []
                    continue
                long = None
            cut = int(np.searchsorted(key, key[-1], "left"))
            if cut:
                yield from whole(*(x[:cut] for x in new))
            held = [x[cut:] for x in new]
            if len(held[0]) > limit and not last:
                long = held[0][-1]
                yield emit(held[1], held[1], held[0], held[4])
                held = []
        if held and len(held[0]):
            yield from whole(*held)

    return link


def _keys(rows: DataFrame, bits: list[int], pieces_: int, upper) -> DataFrame:
    """One row for each bit: the bits of its segment without it, with ``upper`` hashed in where a key has been before."""
    entries = []
    for number, segment in enumerate(_segments(bits, pieces_)):
        mask = sum(1 << b for b in segment)
        for i, b in enumerate(segment):
            m = mask & ~(1 << b)
            entries.append((number, m - (1 << 64) if m >> 63 else m, b, i == 0))
    table = F.array(*[F.struct(F.lit(t).alias("segment"), F.lit(m).cast("bigint").alias("m"), F.lit(b).alias("bit"), F.lit(e).alias("every")) for t, m, b, e in entries])
    key = F.xxhash64("v.bit", F.col("fp").bitwiseAND(F.col("v.m")), *upper)
    return rows.select("*", F.explode(table).alias("v")).select(key.alias("key"), "fp", "v.bit", "v.every", "v.segment")


def links(fps: DataFrame, most: int = 3, partitions: int | None = None) -> DataFrame:
    """Stars (a, b) that connect just what chains of fingerprints at ``most`` or fewer differing bits connect.

    fps: distinct non-null BIGINT ``fp``. A key is a 64-bit hash of segment and value: chance equality costs a
    comparison and nothing else. Runs beyond RUN fingerprints are indexed again by the bits outside their segment
    (that have the rest of the differences); there two keys fix most bits, and the next level the others, so that
    what is compared all with all in the end is bounded by the number of values of the open bits.
    """
    parts = most // 2 + 1
    n = partitions or cluster.shuffle_partitions(fps.sparkSession)
    found = []
    # Each level's rows, the bits that no key of the levels before has fixed, and those keys.
    todo = [(fps, list(range(64)), ())]
    level = 0
    while todo:
        following = []
        for rows, bits, upper in todo:
            last = len(bits) <= 18 or level >= 4
            keyed = _keys(rows, bits, parts, upper).repartition(n, "key").sortWithinPartitions("key")
            out = cluster.staged(keyed.mapInArrow(_link(most, last, RUN), "a bigint, b bigint, key bigint, segment int"), "links")
            found.append(out.where("segment < 0").select("a", "b"))
            again = out.where("segment >= 0").select(F.col("a").alias("fp"), "key", "segment")
            if not last and not again.isEmpty():
                for number, segment in enumerate(_segments(bits, parts)):
                    following.append((again.where(F.col("segment") == number), [b for b in bits if b not in segment], (F.col("key"),)))
        todo, level = following, level + 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out.distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fp and component_id: the smallest doc_id that chains of close fingerprints reach.

    One row per input row. Texts without words (null, empty) have fingerprint 0 and link like any other; fewer words
    than ``shingle`` make one shingle. Rows that share a fingerprint share a component, repeated rows included. A null
    doc_id is never the smallest; a component of null ids only has a null component_id. Other columns are left aside.
    """
    fps = cluster.staged(fingerprints(docs.select(F.col("doc_id").cast("bigint"), "text"), shingle), "fingerprints")
    first = cluster.checkpointed(fps.groupBy("fp").agg(F.min("doc_id").alias("doc_id")))
    component = smallest_member(links(first.select("fp"), most), "a", "b").withColumnRenamed("id", "fp")
    least = first.join(component, "fp").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    linked = cluster.checkpointed(component.join(least, "component").select("fp", "component_id"))
    of_fp = cluster.checkpointed(
        first.join(linked, "fp", "left").select("fp", F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def _sketched(shingle: int):
    """KEY and text to KEY, size of the shingle set, SimHash over the shingles, and bands of their MinHash signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1 << 20):
            h, first = shingle_hashes(*text_buffer(part.column("text")), shingle)
            size = [len(np.unique(h[a:b])) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            fp = np.zeros(part.num_rows, np.uint64)
            for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                count = np.zeros(64, np.int64)
                for at in range(a, b, _CHUNK):
                    count += np.unpackbits(h[at : min(b, at + _CHUNK)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
                fp[i] = np.packbits(2 * count > b - a, bitorder="little").view("<u8")[0]
            keys = minhash.band_keys(h, first).view(np.int64)
            columns = [pa.array(size, pa.int32()), pa.array(fp.view(np.int64)), pa.array(list(keys), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in similar.KEY), *columns], names=[*similar.KEY, "size", "fp", "bands"])

    return run


def drop_similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, most: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, but of each group of similar texts only the row with the smallest doc_id.

    Similar: the sets of ``shingle``-word shingles have a Jaccard similarity of at least ``similarity``; groups are
    what such pairs connect. Fingerprints at ``most`` or fewer differing bits, found by their deletion variants, give
    most of the groups. At a similarity of 0.8 some 15 % of a fingerprint's bits differ, which no key of few bits
    finds; what is left is sought by bands of MinHash signatures (all but 5 of 100,000 pairs at 0.8 meet). Either
    way a pair counts only if the shingle sets say so; ``similar.components`` looks at all pairs that meet and
    aren't in one group already.

    Equal texts are one group always, null and empty texts are one text; of rows that share doc_id and text one
    stays. A null doc_id is larger than any other. An empty table gives an empty one.
    """
    key = similar.KEY
    keyed = similar.keyed(docs)
    rows = keyed.select(*key, "text")
    sketched = cluster.staged(rows.mapInArrow(_sketched(shingle), "h1 long, h2 long, no_id int, id long, size int, fp long, bands array<long>"), "sketches")
    nodes, sets_of = similar.texts_of(sketched, rows, shingle, ["size", "fp", "bands"])

    of = cluster.checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("n")))
    near = links(of.select("fp"), most)
    lead = of.select(F.col("fp").alias("a"), F.col("lead").alias("x")), of.select(F.col("fp").alias("b"), F.col("lead").alias("y"))
    near = near.join(lead[0], "a").join(lead[1], "b").select("x", "y")
    equal = nodes.select("fp", F.col("node").alias("y")).join(of.where("n > 1").select("fp", F.col("lead").alias("x")), "fp").where("x <> y").select("x", "y")
    pairs = cluster.checkpointed(near.unionByName(equal).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    sets = cluster.staged(sets_of(cluster.checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())), "shingles")
    known = cluster.staged(similar.verified(pairs, sets, similarity), "known")
    group = smallest_member(known, "a", "b").withColumnRenamed("id", "node")

    members = nodes.select("node", "size", "bands").join(group, "node", "left").select("node", "size", F.coalesce("component", "node").alias("component"), F.explode("bands").alias("bucket"))
    component = similar.components(members, known, sets_of, similarity, minhash.finer)

    first = nodes.select("node", *key).join(component, "node", "left").withColumn("component", F.coalesce("component", "node"))
    winner = cluster.checkpointed(first.groupBy("component").agg(F.min(F.struct("no_id", "id", "h1", "h2")).alias("w")).select("w.*"))
    counted = sketched.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    judged = counted.join(winner.withColumn("wins", F.lit(True)), key, "left").select(*key, "n", F.coalesce("wins", F.lit(False)).alias("wins"))
    judged = cluster.checkpointed(judged.where("n > 1 or not wins"))
    cluster.discard(sketched, nodes, sets, known)
    kept = cluster.join_ids(keyed.select("row", *key), judged.where("not wins").select(*key), key, "left_anti")
    many = judged.where("wins").select(*key)
    if many.isEmpty():
        return kept.select("row.*")
    once = cluster.join_ids(kept, many, key, "left_semi").dropDuplicates(key)
    return cluster.join_ids(kept, many, key, "left_anti").select("row.*").unionByName(once.select("row.*"))


def op3_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
