"""Groups of texts with a Jaccard similarity of their shingle sets: verified on the sets, from the buckets they meet in.

Texts that share a bucket are candidates. Of a small bucket all pairs are verified. Of a larger one each text is held
against one of its texts first; what these links leave in different groups is dealt into finer buckets while there are
many of them, and in the end compared block by block, all with all. No pair of a bucket goes unseen but those that are
in one group already. Nodes are different texts; 128 bits tell texts apart.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave import cluster
from arcweave.algorithms.contraction import smallest_member
from arcweave.llm.words import pieces, shingle_hashes, text_buffer

#: Texts of a block; two blocks meet in one step of a task.
BLOCK = 128
#: Nodes of a bucket whose pairs are listed at once; nodes of an open bucket beyond which finer buckets come first, and
#: how often.
SMALL, FINER, LEVELS = 32, 1024, 3
#: A bucket with as many nodes among one in SAMPLED (by a hash) is answered where its rows are, without a shuffle.
HOT, SAMPLED = 2000, 64
_COLUMNS = 1 << 14
_LEAST = -(1 << 63)
KEY = ["h1", "h2", "no_id", "id"]


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns), h1 and h2 (128 bits of the text, a null is an empty one), no_id and id (for the order), text."""
    text, id_ = F.coalesce(F.col("text").cast("string"), F.lit("")), F.col("doc_id").cast("bigint")
    return docs.select(
        F.struct("*").alias("row"),
        F.xxhash64(text).alias("h1"),
        F.xxhash64(F.lit(1), text).alias("h2"),
        F.when(id_.isNull(), 1).otherwise(0).alias("no_id"),
        F.coalesce(id_, F.lit(_LEAST)).alias("id"),
        text.alias("text"),
    )


def texts_of(sketched: DataFrame, rows: DataFrame, shingle: int, sketch: list[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The different texts behind rows of KEY and columns that are functions of the text, and how to get their sets.

    sketched: KEY and the columns ``sketch``, a row for each document; rows: KEY and text. The texts: node (any number),
    KEY of the first document that has it, and ``sketch``.
    """
    first = F.min(F.struct("no_id", "id")).alias("first")
    found = sketched.groupBy("h1", "h2").agg(first, *(F.first(c).alias(c) for c in sketch))
    nodes = cluster.staged(found.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "first.*", *sketch), "texts")
    repeated = not sketched.groupBy(*KEY).count().where("count > 1").isEmpty()  # rows that share both text and doc_id

    def sets_of(wanted: DataFrame) -> DataFrame:
        wanted = cluster.checkpointed(nodes.join(wanted, "node", "left_semi").select(*KEY, "node"))
        sets = cluster.join_ids(rows, wanted, KEY, "inner").select("node", "text").mapInArrow(shingle_sets(shingle), "node long, shingles binary")
        return sets.dropDuplicates(["node"]) if repeated else sets

    return nodes, sets_of


def shingle_sets(shingle: int):
    """node and text to node and shingles: the set's 64-bit hashes, ascending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, 1 << 20):
            h, first = shingle_hashes(*text_buffer(part.column("text")), shingle)
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([part.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    return run


def _jaccard(least: float):
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= least * (len(x) + len(y) - both) - 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return check


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of distinct pairs (a, b) those whose sets are similar."""
    x, y = (sets.select(F.col("node").alias(k), F.col("shingles").alias(v)) for k, v in (("a", "x"), ("b", "y")))
    return pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_jaccard(similarity), "a long, b long")


def _meet(least: float, most: int):
    """Sorted rows (bucket, node, size, component) to pairs (a, b, bucket null), or for larger buckets to (first node, node, bucket).

    a is null where the two can't be similar by their sizes, or are in one component.
    """

    def may(size, component, other_size, other_component):
        return (np.minimum(size, other_size) >= least * np.maximum(size, other_size) - 1e-9) & (component != other_component)

    def emit(a, b, bucket, ok=None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a, mask=None if ok is None else ~ok), pa.array(b), pa.array(bucket) if bucket is not None else pa.nulls(len(a), pa.int64())], names=["a", "b", "bucket"])

    def whole(bucket: np.ndarray, node: np.ndarray, size: np.ndarray, component: np.ndarray) -> Iterator[pa.RecordBatch]:
        edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        n = np.diff(np.append(edge, len(bucket)))
        run, number = np.repeat(n, n), np.repeat(np.arange(len(edge)), n)
        for k in range(1, min(most, int(n.max()))):
            i = np.flatnonzero((number[:-k] == number[k:]) & (run[:-k] <= most))
            i = i[may(size[i], component[i], size[i + k], component[i + k])]
            if len(i):
                yield emit(node[i], node[i + k], None)
        if len(i := np.flatnonzero(run > most)):
            first = edge[number[i]]
            yield emit(node[first], node[i], bucket[i], may(size[first], component[first], size[i], component[i]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4  # the last bucket so far, which may go on
        long = None  # bucket, last node and the first with size and component, of one that is known to be large
        for batch in batches:
            if not batch.num_rows:
                continue
            new = [np.array(batch.column(c)).astype(np.int64, copy=False) for c in ("bucket", "node", "size", "component")]
            new = [np.concatenate(x) for x in zip(held, new, strict=True)]
            once = np.concatenate([[True], (new[0][1:] != new[0][:-1]) | (new[1][1:] != new[1][:-1])])
            if long is not None and new[0][0] == long[0] and new[1][0] == long[1]:
                once[0] = False
            new, held = [x[once] for x in new], [x[:0] for x in new]
            if long is not None:
                n = int(np.searchsorted(new[0], long[0], "right"))
                if n:
                    yield emit(np.full(n, long[2]), new[1][:n], new[0][:n], may(*long[3:], new[2][:n], new[3][:n]))
                    long = (long[0], new[1][n - 1], *long[2:])
                new = [x[n:] for x in new]
                if not len(new[0]):
                    continue
                long = None
            cut = int(np.searchsorted(new[0], new[0][-1], "left"))
            if cut:
                yield from whole(*(x[:cut] for x in new))
            held = [x[cut:] for x in new]
            if len(held[0]) > most:
                bucket, node, size, component = held
                yield emit(np.full(len(node), node[0]), node, bucket, may(size[0], component[0], size, component))
                long, held = (bucket[0], node[-1], node[0], size[0], component[0]), [x[:0] for x in held]
        if len(held[0]):
            yield from whole(*held)

    return meet


def _met(members: DataFrame, similarity: float, most: int) -> DataFrame:
    n = cluster.shuffle_partitions(members.sparkSession)
    sort = lambda rows: rows.repartition(n, "bucket").sortWithinPartitions("bucket", "node").mapInArrow(_meet(similarity, most), "a long, b long, bucket long")
    some = members.where(F.pmod(F.xxhash64("node"), F.lit(SAMPLED)) == 0)
    first = F.min(F.struct(F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("component").alias("a_component")))
    hot = some.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), first.alias("f")).where(F.col("n") >= HOT).select("bucket", "f.*")
    hot = cluster.checkpointed(hot)
    if hot.isEmpty():
        return cluster.staged(sort(members), "met")
    there = cluster.join_ids(members, hot, ["bucket"], "inner")
    may = (F.least("size", "a_size") >= similarity * F.greatest("size", "a_size") - 1e-9) & (F.col("component") != F.col("a_component"))
    there = there.select(F.when(may, F.col("a")).alias("a"), F.col("node").alias("b"), "bucket")
    return cluster.staged(sort(cluster.join_ids(members, hot.select("bucket"), ["bucket"], "left_anti")).unionByName(there), "met")


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two of the sets share."""
    size = np.array([len(s) for s in sets])
    value, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size)
    shared = count[column] > 1
    row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        i = slice(*np.searchsorted(column, [at, at + _COLUMNS]))
        there = np.zeros((len(sets), _COLUMNS), np.float32)
        there[row[i], column[i] - at] = 1
        out += there @ there.T
    return out


def _blocks(least: float):
    """Sorted rows (bucket, i, j, node, component, shingles): of each two blocks, links between different components."""

    def links(nodes: list[int], components: list[int], sets: list[bytes]) -> tuple[list[int], list[int]]:
        sets = [np.frombuffer(s, np.uint64) for s in sets]
        size = np.array([len(s) for s in sets])
        component = np.unique(np.array(components), return_inverse=True)[1]
        both = _overlaps(sets)
        ok = (both >= least * (size[:, None] + size[None, :] - both) - 1e-9) & (component[:, None] != component[None, :])
        a, b = np.nonzero(np.triu(ok, 1))
        pair = np.unique(np.minimum(component[a], component[b]) * len(nodes) + np.maximum(component[a], component[b]), return_index=True)[1]
        return [nodes[i] for i in a[pair]], [nodes[i] for i in b[pair]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def out():
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in links([*held], *map(list, zip(*held.values(), strict=True)))], names=["a", "b"])

        for batch in batches:
            for *here, node, component, s in zip(*(batch.column(c).to_pylist() for c in ("bucket", "i", "j", "node", "component")), batch.column("shingles"), strict=True):
                if here != key:
                    if len(held) > 1:
                        yield out()
                    key, held = here, {}
                held[node] = component, s.as_py()
        if len(held) > 1:
            yield out()

    return run


def components(members: DataFrame, known: DataFrame | None, sets_of: Callable[[DataFrame], DataFrame], similarity: float, finer: Callable | None = None, most: int = SMALL, level: int = 0) -> DataFrame:
    """node and component (its smallest node): what verified pairs of a common bucket connect; lone nodes are left out.

    members: bucket, node, size of the set, and component: nodes of one component are known to be in one group.
    known: the links (a, b) behind these components, or None. They go into the result.
    sets_of: from a table of nodes to their shingle sets as ``shingle_sets`` makes them, one row each.
    finer: (level) to a function for ``mapInArrow`` from rows (bucket, node, shingles, component) to members, whose
    buckets hold fewer texts and in which similar ones still meet.
    """
    n = cluster.shuffle_partitions(members.sparkSession)
    met = _met(members, similarity, most)
    found = cluster.checkpointed(met.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    needed = found.select(F.explode(F.array("a", "b")).alias("node")).unionByName(met.where("bucket is not null").select(F.col("b").alias("node")))
    sets = cluster.staged(sets_of(cluster.checkpointed(needed.distinct())), "shingles")
    links = verified(found, sets, similarity)
    links = cluster.staged(links if known is None else links.unionByName(known), "similar")
    component = smallest_member(links, "a", "b").withColumnRenamed("id", "node")
    used = [met, sets, links]
    large = met.where("bucket is not null").select("bucket", F.col("b").alias("node"))
    if large.isEmpty():
        cluster.discard(*used)
        return component
    large = cluster.checkpointed(large.join(component, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")))
    # Of buckets with the same nodes one will do; of each, the component with most nodes needn't be compared with itself.
    same = F.struct(F.bit_xor(F.xxhash64("node")), F.bit_xor(F.xxhash64("node", F.lit(1))), F.count(F.lit(1)))
    open_ = large.groupBy("bucket").agg(same.alias("nodes"), F.count(F.lit(1)).alias("n"), F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    open_ = cluster.checkpointed(open_.groupBy("nodes").agg(F.min("bucket").alias("bucket"), F.max("n").alias("n")).select("bucket", "n"))
    if open_.isEmpty():
        cluster.discard(*used)
        return component
    if finer and level < LEVELS and not (wide := open_.where(F.col("n") > FINER)).isEmpty():
        rows = large.join(wide.select("bucket"), "bucket", "left_semi").join(sets, "node").select("bucket", "node", "shingles", "component")
        below = cluster.staged(rows.mapInArrow(finer(level), "bucket long, node long, size int, component long"), "finer")
        used.append(below)
        component = components(below, links, lambda nodes: sets.join(nodes, "node", "left_semi"), similarity, finer, most, level + 1)
        open_ = open_.where(F.col("n") <= FINER)
        large = cluster.checkpointed(large.join(open_, "bucket", "left_semi").select("bucket", "node").join(component, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component")))
        links = component.select(F.col("node").alias("a"), F.col("component").alias("b"))
    parts = cluster.checkpointed(large.join(open_, "bucket", "left_semi").groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("n")))
    of = parts.groupBy("bucket").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all")).where("all > main.n")
    blocks = lambda k: F.ceil(k / BLOCK).cast("int")
    of = cluster.checkpointed(of.select("bucket", F.col("main.component").alias("main"), blocks(F.col("all") - F.col("main.n")).alias("rest"), blocks(F.col("main.n")).alias("mains")))
    if of.isEmpty():
        cluster.discard(*used)
        return component
    slot = F.when(F.col("component") == F.col("main"), F.col("rest") + F.pmod(F.xxhash64("node"), F.col("mains"))).otherwise(F.pmod(F.xxhash64("node"), F.col("rest")))
    others = F.when(F.col("slot") < F.col("rest"), F.sequence(F.lit(0), F.col("rest") + F.col("mains") - 1)).otherwise(F.sequence(F.lit(0), F.col("rest") - 1))
    sent = large.join(of, "bucket").withColumn("slot", slot.cast("int")).select("bucket", "node", "component", "slot", F.explode(others).alias("other"))
    sent = sent.select("bucket", F.least("slot", "other").alias("i"), F.greatest("slot", "other").alias("j"), "node", "component").join(sets, "node")
    more = sent.repartition(n, "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j").select("bucket", "i", "j", "node", "component", "shingles").mapInArrow(_blocks(similarity), "a long, b long")
    every = cluster.staged(links.unionByName(more), "similar")
    component = smallest_member(every, "a", "b").withColumnRenamed("id", "node")
    cluster.discard(*used, every)
    return component
