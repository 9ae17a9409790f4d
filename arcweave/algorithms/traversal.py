"""Breadth-first search, depth-first order, shortest paths, topological order: frontiers as DataFrames.

Every loop cuts its lineage with a checkpoint in the shared folder and ends when a frontier is empty or nothing
changes. Edges are (src, dst[, weight]); the number of rounds is that of levels, not of nodes. Few edges are searched in
one task (``compact``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.algorithms import compact
from arcweave.cluster import checkpointed
from arcweave.graph import PropertyGraph


def nodes_of(graph: PropertyGraph) -> DataFrame:
    return graph.node_scan(properties=()).select("id")


def edges_of(graph: PropertyGraph, types=(), weight: str | None = None, default: float = 1.0) -> DataFrame:
    """src, dst, w: the named property where it is a number, else 1."""
    if weight is None or graph.edge_type(weight) is None:
        return graph.edge_scan(types).select("src", "dst", F.lit(default).alias("w"))
    return graph.edge_scan(types, (weight,)).select("src", "dst", F.coalesce(F.col(f"`{weight}`").try_cast("double"), F.lit(default)).alias("w"))


def bfs(graph: PropertyGraph, start: int, types=(), max_depth: int | None = None) -> DataFrame:
    """id, depth of what outgoing edges reach from start."""
    e = checkpointed(graph.edge_scan(types).select("src", "dst").distinct())
    front = checkpointed(nodes_of(graph).where(F.col("id") == start).select("id", F.lit(0).alias("depth")))
    if compact.small(e) and not front.isEmpty():
        return front.unionByName(compact.in_one_task(e, compact.depths(start, max_depth), "id long, depth int").where("depth > 0"))
    seen, depth = front, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        new = front.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        front = checkpointed(new.withColumn("depth", F.lit(depth)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def bfs_layers(graph: PropertyGraph, start: int, types=()) -> DataFrame:
    """depth, nodes: the sorted ids of each layer."""
    return bfs(graph, start, types).groupBy("depth").agg(F.array_sort(F.collect_list("id")).alias("nodes"))


def shortest_paths(graph: PropertyGraph, source: int, weight: str | None = None, types=(), max_rounds: int | None = None) -> DataFrame:
    """id, distance, predecessor by rounds of relaxation; only nodes that came nearer go on. Negative weights are
    allowed while there is no negative cycle (see bellman_ford)."""
    return _relax(graph, source, weight, types, max_rounds)[0]


def _relax(graph, source, weight, types, max_rounds):
    e = checkpointed(edges_of(graph, types, weight).groupBy("src", "dst").agg(F.min("w").alias("w")))
    start = nodes_of(graph).where(F.col("id") == source)
    known = checkpointed(start.select("id", F.lit(0.0).alias("distance"), F.lit(None).cast("bigint").alias("predecessor")))
    if compact.small(e) and not known.isEmpty():
        found = checkpointed(compact.in_one_task(e, compact.distances(source, max_rounds), "id long, distance double, predecessor long, moved boolean"))
        return known.join(found, "id", "left_anti").unionByName(found.drop("moved")), not found.where("moved").isEmpty()
    front, rounds = known, 0
    while not front.isEmpty() and (max_rounds is None or rounds < max_rounds):
        rounds += 1
        reach = front.join(e, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(
            F.min(F.struct((F.col("distance") + F.col("w")).alias("d"), F.col("src").alias("p"))).alias("new")
        )
        both = checkpointed(known.join(reach, "id", "full"))
        better = F.col("new").isNotNull() & (F.col("distance").isNull() | (F.col("new.d") < F.col("distance")))
        marked = checkpointed(
            both.select("id", F.when(better, F.col("new.d")).otherwise(F.col("distance")).alias("distance"), F.when(better, F.col("new.p")).otherwise(F.col("predecessor")).alias("predecessor"), better.alias("moved"))
        )
        known = marked.drop("moved")
        front = marked.where("moved").drop("moved")
    return known, not front.isEmpty()


dijkstra = shortest_paths


def bellman_ford(graph: PropertyGraph, source: int, weight: str | None = None, types=()) -> tuple[DataFrame, bool]:
    """Distances, and whether a negative cycle is reachable: then something still moves after as many rounds as nodes."""
    return _relax(graph, source, weight, types, nodes_of(graph).count())


def path_to(paths: DataFrame, target: int) -> list[int]:
    """The nodes of one shortest path, source first; empty if there is none.

    Each round doubles the steps that a node's pointer skips, and the nodes on the path so far name those between
    them, so that the number of jobs grows with the logarithm of the path's length.
    """
    up = checkpointed(paths.select("id", F.col("predecessor").alias("p")))
    known = checkpointed(up.where(F.col("id") == target).select(F.col("id").alias("node"), F.lit(0).cast("bigint").alias("step")))
    if known.isEmpty():
        return []
    jumps, far, n = [], up, 1
    while not far.where((F.col("id") == target) & F.col("p").isNotNull()).isEmpty():
        jumps.append((far, n))
        over = far.select(F.col("id").alias("p"), F.col("p").alias("p2"))
        far, n = checkpointed(far.join(over, "p").select("id", F.col("p2").alias("p"))), 2 * n
    for jump, n in reversed(jumps):
        new = known.join(jump, F.col("node") == F.col("id")).where("p is not null").select(F.col("p").alias("node"), (F.col("step") + n).alias("step"))
        known = checkpointed(known.unionByName(new).distinct())
    return [r["node"] for r in known.orderBy(F.desc("step")).collect()]


def astar(graph: PropertyGraph, source: int, target: int, weight: str | None = None, heuristic: DataFrame | None = None, types=()) -> tuple[float, list[int]] | None:
    """Distance and nodes of a shortest path. heuristic: id, h (at most the true rest); it only saves work, and here
    relaxation does all of it, so the result is that of dijkstra."""
    paths = checkpointed(shortest_paths(graph, source, weight, types))
    row = paths.where(F.col("id") == target).first()
    return None if row is None else (row["distance"], path_to(paths, target))


def floyd_warshall(graph: PropertyGraph, weight: str | None = None, types=()) -> DataFrame:
    """src, dst, distance of all pairs with a path, by squaring in the (min, +) algebra: the result is as large as the
    number of pairs, for graphs of which that can be written."""
    own = nodes_of(graph).select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(0.0).alias("distance"))
    e = edges_of(graph, types, weight).select("src", "dst", F.col("w").alias("distance"))
    d = checkpointed(own.unionByName(e).groupBy("src", "dst").agg(F.min("distance").alias("distance")))
    size = None
    while True:
        far = d.select(F.col("src").alias("m"), F.col("dst").alias("t"), F.col("distance").alias("d2"))
        d = checkpointed(
            d.join(far, F.col("dst") == F.col("m")).select("src", F.col("t").alias("dst"), (F.col("distance") + F.col("d2")).alias("distance")).groupBy("src", "dst").agg(F.min("distance").alias("distance"))
        )
        now = tuple(d.agg(F.count(F.lit(1)), F.sum("distance")).first())
        if now == size:
            return d
        size = now


def topological_levels(graph: PropertyGraph, types=()) -> DataFrame | None:
    """id, level: edges go from lower to higher levels; (level, id) is a topological order. None if there is a cycle.

    While there are many edges, those into nodes without outgoing ones are set aside, in one join a round; once the levels
    of the rest are known, each of these nodes is one above the highest that leads to it.
    """
    e, aside = checkpointed(graph.edge_scan(types).select("src", "dst").distinct()), []
    while (rows := e.count()) > max(compact.ONE_TASK, 0):
        goes_on = e.select(F.col("src").alias("dst")).distinct().withColumn("goes_on", F.lit(True))
        marked = checkpointed(e.join(goes_on, "dst", "left"))
        e = marked.where("goes_on").select("src", "dst")
        if e.count() == rows:
            return None
        aside.append(marked.where("goes_on is null").select("src", "dst"))
    level = checkpointed(compact.in_one_task(e, compact.levels, "id long, level int"))
    if not level.where("level < 0").isEmpty():
        return None
    for last in reversed(aside):
        above = last.join(level, F.col("src") == F.col("id"), "left").groupBy(F.col("dst").alias("id"))
        level = checkpointed(level.unionByName(above.agg((F.max(F.coalesce("level", F.lit(0))) + 1).alias("level"))))
    return nodes_of(graph).join(level, "id", "left").select("id", F.coalesce("level", F.lit(0)).alias("level"))


def is_dag(graph: PropertyGraph, types=()) -> bool:
    return topological_levels(graph, types) is not None


def dfs(graph: PropertyGraph, start: int | None = None, types=(), most_edges: int = 5_000_000) -> list[int]:
    """Finish (post-) order, neighbours by ascending id; start None: from every node in turn. Depth-first search is
    sequential: it runs on the driver, on graphs of up to ``most_edges`` edges, and refuses larger ones."""
    out = small_adjacency(graph, types, most_edges)
    roots = [start] if start is not None else sorted(r["id"] for r in nodes_of(graph).collect())
    seen: set[int] = set()
    order: list[int] = []
    for root in roots:
        if root in seen:
            continue
        seen.add(root)
        stack = [(root, iter(out.get(root, ())))]
        while stack:
            node, rest = stack[-1]
            for n in rest:
                if n not in seen:
                    seen.add(n)
                    stack.append((n, iter(out.get(n, ()))))
                    break
            else:
                order.append(node)
                stack.pop()
    return order


def small_edges(graph: PropertyGraph, types, most_edges: int, *properties: str) -> list:
    e = graph.edge_scan(types, properties)
    if e.count() > most_edges:
        raise ValueError(f"more than {most_edges} edges for an algorithm that runs on the driver")
    return e.orderBy("eid").collect()


def small_adjacency(graph: PropertyGraph, types=(), most_edges: int = 5_000_000) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for r in small_edges(graph, types, most_edges):
        out.setdefault(r["src"], []).append(r["dst"])
    return {k: sorted(v) for k, v in out.items()}
