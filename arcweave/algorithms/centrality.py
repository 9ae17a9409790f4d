"""Degree, PageRank, betweenness, closeness."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.algorithms import compact
from arcweave.algorithms.traversal import nodes_of
from arcweave.cluster import checkpointed, shuffle_partitions
from arcweave.graph import PropertyGraph


def degree_centrality(graph: PropertyGraph, normalized: bool = False, types=()) -> DataFrame:
    """id, in_degree, out_degree, degree; normalized: divided by the number of other nodes."""
    d = graph.degrees(types)
    if not normalized:
        return d
    n = max(d.count() - 1, 1)
    return d.select("id", *[(F.col(c) / n).alias(c) for c in ("out_degree", "in_degree", "degree")])


def pagerank(graph: PropertyGraph, damping: float = 0.85, max_iterations: int = 100, tolerance: float = 1e-6, types=()) -> DataFrame:
    """id, rank; ranks sum to 1. Parallel edges count; the rank of nodes without outgoing edges is spread evenly.

    Parallel edges are counted once, as a share of their source's rank, so that a round is one join and one partial
    aggregation; a hub's contributions are summed before they are shuffled. The shares stay where their source is.
    """
    nodes = checkpointed(nodes_of(graph))
    n = nodes.count()
    if not n:
        return nodes.withColumn("rank", F.lit(0.0))
    e = graph.edge_scan(types).groupBy("src", "dst").agg(F.count(F.lit(1)).alias("m"))
    out = graph.edge_scan(types).groupBy("src").agg(F.count(F.lit(1)).alias("d"))
    share = e.join(out, "src").select("src", "dst", (F.col("m") / F.col("d")).alias("s"))
    share = checkpointed(share.repartition(shuffle_partitions(graph.spark), "src"))
    if compact.small(share):
        there = nodes.select(F.col("id").alias("dst"), F.lit(True).alias("there"))
        edges = share.join(nodes, F.col("src") == F.col("id"), "left_semi").join(there, "dst", "left")
        edges = edges.select("src", "dst", "s", F.coalesce("there", F.lit(False)).alias("there"))
        found = checkpointed(compact.in_one_task(edges, compact.ranks(n, damping, max_iterations, tolerance), "id long, rank double"))
        rest = found.where("id is null").first()
        return nodes.join(found, "id", "left").select("id", F.coalesce("rank", F.lit(rest["rank"] if rest else 1.0 / n)).alias("rank"))
    sinks = nodes.join(out, F.col("id") == F.col("src"), "left").select("id", F.col("d").isNull().alias("sink"))
    rank = checkpointed(sinks.withColumn("rank", F.lit(1.0 / n)))
    lost = rank.agg(F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).first()[0]
    for _ in range(max_iterations):
        base = F.lit((1 - damping) / n + damping * lost / n)
        got = rank.join(share, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("s")).alias("g"))
        new = rank.withColumnRenamed("rank", "old").join(got, "id", "left").withColumn("rank", base + damping * F.coalesce("g", F.lit(0.0)))
        rank = checkpointed(new.select("id", "sink", "rank", F.abs(F.col("rank") - F.col("old")).alias("change")))
        change, lost = rank.agg(F.max("change"), F.coalesce(F.sum(F.when(F.col("sink"), F.col("rank"))), F.lit(0.0))).first()
        rank = rank.drop("change")
        if change < tolerance:
            break
    return rank.select("id", "rank")


def _all_sources(graph: PropertyGraph, types, work: Callable, schema: str, most_edges: int) -> DataFrame:
    """work(edges, places of sources) on partitions of all nodes. The edges go to every executor as arrays, 24 bytes
    each, so that their number is checked against ``most_edges`` first."""
    e = graph.edge_scan(types).select("src", "dst")
    if e.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges for an algorithm that searches from every node")
    held = e.toArrow()
    shared = graph.spark.sparkContext.broadcast(compact.Numbered(*(np.array(held.column(c)) for c in ("src", "dst"))))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        g = shared.value
        for pdf in frames:
            ids = pdf["id"].to_numpy(np.int64)
            place = np.minimum(np.searchsorted(g.ids, ids), max(g.n - 1, 0))
            known = g.ids[place] == ids if g.n else np.zeros(len(ids), bool)
            yield work(g, ids, np.where(known, place, -1))

    return nodes_of(graph).repartition(graph.spark.sparkContext.defaultParallelism * 2, "id").mapInPandas(run, schema)


def _levels(g: compact.Numbered, source: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Level by level: the nodes of the next one, and the edges that lead there (from, to)."""
    seen, front = np.zeros(g.n, bool), np.array([source])
    seen[source] = True
    while len(front):
        e = g.out_of(front)
        a, b = g.a[e], g.b[e]
        new = ~seen[b]
        a, b = a[new], b[new]
        front = np.unique(b)
        seen[front] = True
        if len(front):
            yield front, a, b


def _dependencies(g: compact.Numbered, ids: np.ndarray, places: np.ndarray) -> pd.DataFrame:
    """Brandes: what the shortest paths from these sources owe to each node."""
    total = np.zeros(g.n)
    for s in places[places >= 0].tolist():
        paths, levels = np.zeros(g.n), []
        paths[s] = 1
        for _, a, b in _levels(g, s):
            np.add.at(paths, b, paths[a])
            levels.append((a, b))
        due = np.zeros(g.n)
        for a, b in reversed(levels):
            np.add.at(due, a, paths[a] / paths[b] * (1 + due[b]))
        due[s] = 0
        total += due
    return pd.DataFrame({"id": g.ids[total > 0], "b": total[total > 0]})


def betweenness_centrality(graph: PropertyGraph, normalized: bool = True, types=(), most_edges: int = 5_000_000) -> DataFrame:
    """id, betweenness: Brandes over directed, unweighted edges; normalized: times 2 / ((n - 1)(n - 2))."""
    n = nodes_of(graph).count()
    scale = 2.0 / ((n - 1) * (n - 2)) if normalized and n > 2 else 1.0
    part = _all_sources(graph, types, _dependencies, "id long, b double", most_edges).groupBy("id").agg(F.sum("b").alias("b"))
    return nodes_of(graph).join(part, "id", "left").select("id", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


#: Nodes that edges lead to of which a worker holds all distances, two bytes a pair, and cells of the sources worked on at once.
TABLE, CELLS = 4_000, 4_000_000


def closeness_centrality(graph: PropertyGraph, wf: bool = False, types=(), most_edges: int = 5_000_000) -> DataFrame:
    """id, closeness: reached nodes over the sum of their distances; wf: times the share of the others that is reached.

    After its first step a search only meets nodes that edges lead to, so that the edges between those go to every executor
    and each source brings its own. If they are more than ``most_edges``, the searches are rounds of joins, a row a pair.
    """
    n = nodes_of(graph).count()
    e = checkpointed(graph.edge_scan(types).where("src <> dst").select("src", "dst").distinct())
    inside = checkpointed(e.join(e.select(F.col("dst").alias("id")).distinct(), F.col("src") == F.col("id"), "left_semi"))
    met = e.select("dst").distinct()
    if max(inside.count(), met.count()) > most_edges:
        found = _reached_by_joins(e)
    else:
        found = _reached(e, inside.toArrow(), met.toArrow())
    c = F.coalesce(F.col("reached") / F.nullif("far", F.lit(0)), F.lit(0.0))
    share = F.coalesce("reached", F.lit(0)) / (n - 1) if wf and n > 1 else F.lit(1.0)
    return nodes_of(graph).join(found, "id", "left").select("id", (c * share).alias("closeness"))


def _reached(e: DataFrame, inside: pa.Table, met: pa.Table) -> DataFrame:
    """id, reached, far: how many other nodes each source reaches, and the sum of their distances."""
    inner = compact.Numbered(*(np.array(inside.column(c)) for c in ("src", "dst")), more=np.array(met.column("dst")))
    shared, table, cells = e.sparkSession.sparkContext.broadcast(inner), TABLE, CELLS

    def by_search(g: compact.Numbered, source: int, out: np.ndarray) -> tuple[int, int]:
        seen, front, far, reached, depth = np.zeros(g.n, bool), out, 0, 0, 1
        seen[out] = True
        if source >= 0:
            seen[source] = True
        while len(front):
            reached, far, depth = reached + len(front), far + depth * len(front), depth + 1
            front = g.b[g.out_of(front)]
            front = np.unique(front[~seen[front]])
            seen[front] = True
        return reached, far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, all_pairs = shared.value, None
        none = np.int16(np.iinfo(np.int16).max)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            flat, size = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
            to, begin = np.searchsorted(g.ids, flat), np.cumsum(size) - size
            place = np.minimum(np.searchsorted(g.ids, ids), g.n - 1)
            place = np.where(g.ids[place] == ids, place, -1)
            reached, far = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
            if g.n > table:
                for i, (b, k) in enumerate(zip(begin.tolist(), size.tolist(), strict=True)):
                    reached[i], far[i] = by_search(g, int(place[i]), to[b : b + k])
            else:
                if all_pairs is None:  # one step further on than the distance, as seen by what leads there
                    all_pairs = np.full((g.n, g.n), none)
                    for s in range(g.n):
                        all_pairs[s, s] = 1
                        for depth, (front, _, _) in enumerate(_levels(g, s), 2):
                            all_pairs[s, front] = depth
                i, ends = 0, begin + size
                while i < len(ids):
                    j = max(i + 1, int(np.searchsorted(ends, begin[i] + cells // g.n, "right")))
                    best = np.minimum.reduceat(all_pairs[to[begin[i] : ends[j - 1]]], begin[i:j] - begin[i])
                    own = np.flatnonzero(place[i:j] >= 0)
                    best[own, place[i:j][own]] = none
                    there = best < none
                    reached[i:j], far[i:j] = there.sum(axis=1), np.where(there, best, 0).sum(axis=1, dtype=np.int64)
                    i = j
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(reached), pa.array(far)], names=["id", "reached", "far"])

    return e.groupBy(F.col("src").alias("id")).agg(F.collect_list("dst").alias("to")).mapInArrow(run, "id long, reached long, far long")


def _reached_by_joins(e: DataFrame) -> DataFrame:
    front = checkpointed(e.select(F.col("src").alias("s"), F.col("dst").alias("t"), F.lit(1).alias("d")))
    seen = front
    while not front.isEmpty():
        new = front.join(e.hint("merge"), F.col("t") == F.col("src")).where("s <> dst").select("s", F.col("dst").alias("t"), (F.col("d") + 1).alias("d")).distinct()
        front = checkpointed(new.join(seen.hint("merge"), ["s", "t"], "left_anti"))
        seen = seen.unionByName(front)
    return seen.groupBy(F.col("s").alias("id")).agg(F.count(F.lit(1)).alias("reached"), F.sum("d").alias("far"))
