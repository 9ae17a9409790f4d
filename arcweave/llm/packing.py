"""Best-fit packing of documents into token sequences by a grouping genetic algorithm on islands.

Documents are encoded where they are read; what moves are rows of a few numbers per piece. Pieces that fill a sequence
have it to themselves; the others are dealt into shards of some thousand items. Each shard lives on several islands, a
row each, that evolve a population of packings: crossover injects well-filled bins of one parent into the other,
removes the bins that hold the same items, and best-fits the displaced ones, largest first. Between epochs the best
packing of an island migrates to the next. Badly filled bins of all shards meet once more at the end.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.llm.tokens import encoder
from arcweave.llm.words import pieces, text_buffer

LENGTH = 1024
SHARD_ITEMS = 16_384
ISLANDS, EPOCHS, POPULATION, OFFSPRING = 2, 2, 5, 24


def best_fit(sizes: np.ndarray, room: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, taken in the order given: the fullest it fits into, of those with ``room`` or new ones."""
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    for b, r in enumerate(room.tolist()):
        stacks[r].append(b)
    mask = sum(1 << r for r, s in enumerate(stacks) if s)
    out, new = [], len(room)
    for s in sizes.tolist():
        fits = mask >> s
        if fits:
            r = s + (fits & -fits).bit_length() - 1
            stack = stacks[r]
            b = stack.pop()
            if not stack:
                mask ^= 1 << r
        else:
            r, b, new = capacity, new, new + 1
        stacks[r - s].append(b)
        mask |= 1 << (r - s)
        out.append(b)
    return np.array(out, np.int64)


class Island:
    """Packings of one shard's items: arrays of bin numbers."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity, self.rng = sizes.astype(np.int64), capacity, np.random.default_rng(seed)
        self.least = -(-int(self.sizes.sum()) // capacity)

    def fit(self, order: np.ndarray) -> np.ndarray:
        out = np.empty(len(order), np.int64)
        out[order] = best_fit(self.sizes[order], np.zeros(0, np.int64), self.capacity)
        return out

    def score(self, bins: np.ndarray) -> tuple[int, float]:
        """To be made small: bins, then minus the mean of their squared fill."""
        fill = np.bincount(bins, self.sizes)
        return len(fill), -float(np.mean((fill / self.capacity) ** 2)) if len(fill) else 0.0

    def start(self, n: int) -> list[np.ndarray]:
        """Best-fit decreasing, and that order with more and more noise in the sizes."""
        found = [self.fit(np.argsort(-self.sizes, kind="stable"))]
        while len(found) < n:
            noise = self.rng.normal(0, self.capacity * 0.02 * len(found), len(self.sizes))
            found.append(self.fit(np.argsort(-(self.sizes + noise), kind="stable")))
        return found

    def _refit(self, bins: np.ndarray, loose: np.ndarray) -> np.ndarray:
        """Take the loose items out and best-fit them, largest first, into what is left."""
        kept, inverse = np.unique(bins[~loose], return_inverse=True)
        out = np.empty(len(bins), np.int64)
        out[~loose] = inverse
        room = self.capacity - np.bincount(inverse, self.sizes[~loose], minlength=len(kept)).astype(np.int64)
        items = np.flatnonzero(loose)
        items = items[np.argsort(-self.sizes[items], kind="stable")]
        out[items] = best_fit(self.sizes[items], room, self.capacity)
        return out

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        fill = np.bincount(b, self.sizes)
        good = np.flatnonzero(fill >= np.quantile(fill, 0.5))
        share = self.rng.uniform(0.1, 0.5)
        inject = np.zeros(len(fill), bool)
        inject[good[self.rng.random(len(good)) < share]] = True
        theirs = inject[b]
        hit = np.zeros(int(a.max(initial=-1)) + 1, bool)
        hit[a[theirs]] = True  # bins of a that hold an injected item
        child = np.where(theirs, b + len(hit), a)
        return self._refit(child, hit[a] & ~theirs)

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        """Empty the worst bins and some others."""
        fill = np.bincount(bins, self.sizes)
        order = np.argsort(fill, kind="stable")
        drop = np.zeros(len(fill), bool)
        drop[order[: max(1, len(fill) // 50)]] = True
        drop |= self.rng.random(len(fill)) < 0.03
        return self._refit(bins, drop[bins])

    def evolve(self, population: list[np.ndarray], offspring: int) -> list[np.ndarray]:
        """Best first. Ends early at the number of bins that the sum of sizes needs at least."""
        ranked = sorted(((self.score(p), i, p) for i, p in enumerate(population)), key=lambda x: x[:2])
        count = len(ranked)
        for _ in range(offspring):
            if ranked[0][0][0] <= self.least or len(ranked) < 2:
                break
            i, j = sorted(self.rng.choice(len(ranked), 2, replace=False).tolist())
            child = self.cross(*(ranked[x][2] for x in ((i, j) if self.rng.random() < 0.5 else (j, i))))
            if self.rng.random() < 0.5:
                child = self.mutate(child)
            score = self.score(child)
            if score < ranked[-1][0] and all(score != r[0] for r in ranked):
                count += 1
                ranked[-1] = (score, count, child)
                ranked.sort(key=lambda x: x[:2])
        return [p for _, _, p in ranked]


def _cut(spec, end: int, length: int, keep_ids: bool):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, count = encoder(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in pieces(iter([batch]), 1 << 20):
                flat, ends = coder.encode(*text_buffer(piece.column("text")), end)
                raw = memoryview(flat.astype("<u4").tobytes())
                size = np.diff(ends)
                first = np.where(size > length, size % length, size)
                first = np.where((first == 0) & (size > 0), length, first)  # a multiple: all pieces are whole
                n = 1 + (size - first) // length
                doc = np.repeat(np.arange(len(n)), n)
                number = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = np.where(number > 0, first[doc] + (number - 1) * length, 0)
                stop = first[doc] + number * length
                lo, hi = (ends[doc] + start).tolist(), (ends[doc] + stop).tolist()
                columns = [
                    pa.array((part << 36) + count + np.arange(len(doc))),
                    piece.column("doc_id").take(pa.array(doc)),
                    pa.array(number.astype(np.int32)),
                    pa.array(start),
                    pa.array(stop - start),
                    pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(lo, hi, strict=True)], pa.int64()),
                ]
                names = ["item", "doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    columns.append(pa.array([raw[4 * a : 4 * b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                count += len(doc)

    return cut


def _shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["length", "item"])
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "items": [pdf["item"].to_numpy(np.int64).tobytes()], "sizes": [pdf["length"].to_numpy(np.int32).tobytes()]})


def _evolve(capacity: int, epoch: int, level: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            out = []
            for row in pdf.itertuples():
                sizes = np.frombuffer(row.sizes, np.int32)
                island = Island(sizes, capacity, hash((level, row.shard, row.island, epoch)) & 0x7FFFFFFF)
                packings = np.frombuffer(row.population, np.int32).reshape(-1, len(sizes)) if row.population else []
                population = [p.astype(np.int64) for p in packings]
                if row.guest:
                    population.append(np.frombuffer(row.guest, np.int32).astype(np.int64))
                population = island.evolve(population or island.start(POPULATION if row.island == 0 else POPULATION + row.island), OFFSPRING)[:POPULATION]
                score = island.score(population[0])
                best = population[0].astype(np.int32).tobytes()
                out.append((row.shard, row.island, row.items, row.sizes, np.stack(population).astype(np.int32).tobytes(), best, score[0], score[1]))
            yield pd.DataFrame(out, columns=["shard", "island", "items", "sizes", "population", "best", "bins", "score"])

    return run


def _places(capacity: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.itertuples():
                sizes, bins = np.frombuffer(row.sizes, np.int32).astype(np.int64), np.frombuffer(row.best, np.int32)
                order = np.argsort(bins, kind="stable")
                ends = np.cumsum(sizes[order])
                fill = np.bincount(bins, sizes).astype(np.int64)
                before = np.cumsum(fill) - fill
                yield pd.DataFrame(
                    {
                        "item": np.frombuffer(row.items, np.int64)[order],
                        "length": sizes[order],
                        "sequence_id": (row.shard << 24) + bins[order].astype(np.int64),
                        "offset": ends - sizes[order] - before[bins[order]],
                        "room": capacity - fill[bins[order]],
                    }
                )

    return run


def pack_items(items: DataFrame, capacity: int, level: int = 0) -> DataFrame:
    """item, length, sequence_id, offset, room (left in the sequence) for rows (item: unique BIGINT, length: 1 to capacity - 1)."""
    n = items.count()
    shards = max(1, -(-n // SHARD_ITEMS))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("item"), F.lit(shards)).cast("bigint") + F.lit(level << 36))
    rows = dealt.groupBy("shard").applyInPandas(_shard, "shard long, items binary, sizes binary")
    state = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"), F.lit(None).cast("binary").alias("population"), F.lit(None).cast("binary").alias("guest"))
    tasks = min(shards * ISLANDS, max(cluster.shuffle_partitions(items.sparkSession), shards * ISLANDS // 8))
    used = []
    for epoch in range(EPOCHS):
        state = cluster.staged(
            state.repartition(tasks, "shard", "island").mapInPandas(
                _evolve(capacity, epoch, level), "shard long, island int, items binary, sizes binary, population binary, best binary, bins long, score double"
            ),
            "islands",
        )
        used.append(state)
        if epoch < EPOCHS - 1:
            guests = state.select("shard", ((F.col("island") + 1) % ISLANDS).alias("island"), F.col("best").alias("guest"))
            state = state.drop("best", "bins", "score").join(guests, ["shard", "island"])
    chosen = state.groupBy("shard").agg(F.min_by(F.struct("items", "sizes", "best"), F.struct("bins", "score", "island")).alias("x")).select("shard", "x.*")
    placed = cluster.staged(chosen.mapInPandas(_places(capacity), "item long, length long, sequence_id long, offset long, room long"), "placed")
    cluster.discard(*used)
    return placed


def pack(docs: DataFrame, spec: str, length: int = LENGTH, end: int = 2, keep_ids: bool = False) -> DataFrame:
    """Pack all documents (doc_id, text) into sequences of at most ``length`` tokens.

    Returns a row per piece: doc_id, piece (from 0), start (tokens of the document before it), length, ids_crc32,
    sequence_id and offset; with keep_ids also ``ids``, the piece's tokens as little-endian unsigned 32-bit integers.
    spec: a tokenizer file's JSON; ``end`` closes each document. Documents beyond ``length`` are cut, and their first
    piece is what the whole ones leave over. A null text is empty: its end id only. Rows that share a doc_id, or have
    a null one, are documents of their own. Other columns are left aside; an empty table gives an empty one.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)  # a tokenizer file: a few megabytes, whatever the corpus
    schema = "item long, doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    rows = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(_cut(shared, end, length, keep_ids), schema)
    rows = cluster.staged(rows, "pieces")
    part = rows.where(F.col("length") < length).select("item", "length")
    placed = pack_items(part, length)
    # Bins with room to spare meet those of other shards; what comes of it counts if it needs fewer.
    spare = placed.where(F.col("room") >= length // 32)
    before = spare.agg(F.count_distinct("sequence_id")).first()[0]
    if before > 1 and placed.agg(F.count_distinct(F.shiftright("sequence_id", 24))).first()[0] > 1:
        again = pack_items(spare.select("item", "length"), length, 1)
        if again.agg(F.count_distinct("sequence_id")).first()[0] < before:
            placed = placed.where(F.col("room") < length // 32).unionByName(again)
    whole = rows.where(F.col("length") >= length).withColumn("sequence_id", -1 - F.col("item")).withColumn("offset", F.lit(0).cast("bigint"))
    rest = rows.where(F.col("length") < length).join(placed.select("item", "sequence_id", "offset"), "item")
    return rest.unionByName(whole).drop("item")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = f.read()
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), spec)
