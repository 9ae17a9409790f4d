"""Components, cores, triangles, clustering, spanning forests, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.algorithms import compact
from arcweave.algorithms.contraction import smallest_member
from arcweave.algorithms.traversal import edges_of, nodes_of
from arcweave.cluster import checkpointed
from arcweave.graph import PropertyGraph


def connected_components(graph: PropertyGraph, types=()) -> DataFrame:
    """id, component: the smallest id of its weak component."""
    found = smallest_member(graph.edge_scan(types))
    return nodes_of(graph).join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def connected_component_count(graph: PropertyGraph, types=()) -> int:
    return connected_components(graph, types).agg(F.count_distinct("component")).first()[0]


def strongly_connected_components(graph: PropertyGraph, types=()) -> DataFrame:
    """id, component: the smallest id of its strong component.

    Nodes without incoming or outgoing edges are peeled off; then each node takes the largest id that reaches it as
    its colour, and what a colour's root reaches backwards within the colour is a component.
    """
    e = checkpointed(graph.edge_scan(types).where("src <> dst").select("src", "dst").distinct())
    left, found = checkpointed(nodes_of(graph)), None

    def out(df: DataFrame) -> None:
        nonlocal found
        found = df if found is None else found.unionByName(df)

    while not left.isEmpty():
        if compact.small(e):
            part = compact.in_one_task(e, compact.strong, "id long, c long")
            out(left.join(part, "id", "left").select("id", F.coalesce("c", "id").alias("component")))
            break
        while True:  # peel
            inner = e.select(F.col("src").alias("id")).intersect(e.select(F.col("dst").alias("id")))
            single = checkpointed(left.join(inner, "id", "left_anti"))
            if single.isEmpty():
                break
            out(single.select("id", F.col("id").alias("component")))
            left = checkpointed(left.join(single, "id", "left_anti"))
            e = checkpointed(e.join(left, F.col("src") == F.col("id"), "left_semi").join(left, F.col("dst") == F.col("id"), "left_semi"))
        if left.isEmpty():
            break
        colour = checkpointed(left.select("id", F.col("id").alias("c")))
        while True:
            best = e.join(colour, F.col("src") == F.col("id")).groupBy("dst").agg(F.max("c").alias("n"))
            both = checkpointed(colour.join(best, F.col("id") == F.col("dst"), "left").select("id", F.greatest("c", "n").alias("c"), (F.col("n") > F.col("c")).alias("moved")))
            colour = both.select("id", "c")
            if both.where("moved").isEmpty():
                break
        inside = e.join(colour.select(F.col("id").alias("src"), F.col("c").alias("c1")), "src").join(colour.select(F.col("id").alias("dst"), F.col("c").alias("c2")), "dst").where("c1 = c2")
        inside = checkpointed(inside.select("src", "dst"))
        front = checkpointed(colour.where("id = c"))
        seen = front
        while True:  # backwards from each root, within its colour
            new = front.join(inside, F.col("id") == F.col("dst")).select(F.col("src").alias("id"), "c").distinct().join(seen, "id", "left_anti")
            front = checkpointed(new)
            if front.isEmpty():
                break
            seen = seen.unionByName(front)
        seen = checkpointed(seen)
        least = seen.groupBy("c").agg(F.min("id").alias("component"))
        out(seen.join(least, "c").select("id", "component"))
        left = checkpointed(left.join(seen, "id", "left_anti"))
        e = checkpointed(e.join(left, F.col("src") == F.col("id"), "left_semi").join(left, F.col("dst") == F.col("id"), "left_semi"))
    return found if found is not None else left.select("id", F.col("id").alias("component"))


def simple_edges(graph: PropertyGraph, types=()) -> DataFrame:
    """a < b: undirected, no loops, no repeats."""
    return graph.edge_scan(types).where("src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()


def triangles(graph: PropertyGraph, types=()) -> DataFrame:
    """x, y, z: each triangle once. Edges point from the end of smaller degree to the larger (ties by id), so that no
    node has more than about the square root of twice the edges going out, hubs included."""
    e = checkpointed(simple_edges(graph, types))
    degree = e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    d1, d2 = (degree.select(F.col("id").alias(k), F.col("count").alias(f"d{k}")) for k in ("a", "b"))
    low = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    o = checkpointed(e.join(d1, "a").join(d2, "b").select(F.when(low, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(low, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedge = o.join(o.withColumnRenamed("v", "w"), "u").where("v < w").select("u", F.col("v").alias("a"), F.col("w").alias("b"))
    closed = wedge.join(e, ["a", "b"])
    s = F.array_sort(F.array("u", "a", "b"))
    return closed.select(s[0].alias("x"), s[1].alias("y"), s[2].alias("z"))


def triangle_count(graph: PropertyGraph, types=()) -> DataFrame:
    """id, triangles of every node."""
    count = triangles(graph, types).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("t"))
    return nodes_of(graph).join(count, "id", "left").select("id", F.coalesce("t", F.lit(0)).cast("bigint").alias("triangles"))


def total_triangles(graph: PropertyGraph, types=()) -> int:
    return triangles(graph, types).count()


def clustering(graph: PropertyGraph, types=()) -> DataFrame:
    """id, triangles, degree, coefficient: 2 T / (k (k - 1)), 0 where k < 2."""
    k = simple_edges(graph, types).select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("k"))
    t = triangle_count(graph, types).join(k, "id", "left").select("id", "triangles", F.coalesce("k", F.lit(0)).alias("degree"))
    c = F.when(F.col("degree") < 2, 0.0).otherwise(2.0 * F.col("triangles") / (F.col("degree") * (F.col("degree") - 1)))
    return t.withColumn("coefficient", c)


def global_clustering(graph: PropertyGraph, types=()) -> float:
    """The mean coefficient of all nodes."""
    return clustering(graph, types).agg(F.avg("coefficient")).first()[0] or 0.0


def core_numbers(graph: PropertyGraph, types=()) -> DataFrame:
    """id, core: the largest k of which the node is in the k-core. Peels all nodes at or below a level at once, and
    finishes in one task once few edges are left. The joins are merges: a broadcast would pass through the driver every round."""
    e = checkpointed(simple_edges(graph, types))
    degree = lambda: e.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").count()
    d, k = checkpointed(degree()), 1
    found = nodes_of(graph).join(d.hint("merge"), "id", "left_anti").select("id", F.lit(0).alias("core"))
    while not d.isEmpty():
        if compact.small(e):
            rest = compact.in_one_task(e, compact.cores(k), "id long, core int")
            return found.unionByName(d.join(rest, "id", "left").select("id", F.coalesce("core", F.lit(k)).alias("core")))
        k = max(k, d.agg(F.min("count")).first()[0])
        found = found.unionByName(d.where(F.col("count") <= k).select("id", F.lit(k).alias("core")))
        stay = d.where(F.col("count") > k).select("id").hint("merge")
        e = checkpointed(e.join(stay, F.col("a") == F.col("id"), "left_semi").join(stay, F.col("b") == F.col("id"), "left_semi"))
        # Nodes whose last edge went here are left with degree 0 and peel at k, too.
        d = checkpointed(stay.join(degree().hint("merge"), "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("count")))
    return found


def k_core(graph: PropertyGraph, k: int, types=()) -> DataFrame:
    return core_numbers(graph, types).where(F.col("core") >= k).select("id")


def spanning_forest(graph: PropertyGraph, weight: str | None = None, types=()) -> DataFrame:
    """src, dst, w: the minimum spanning forest of the undirected graph, of equal weights the edge with smaller ends.

    Borůvka: each round every part takes its best edge, parts that are joined become one, and what lies inside goes;
    once few edges are left, one task finishes.
    """
    e = edges_of(graph, types, weight).where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "w")
    e = checkpointed(e.groupBy("src", "dst").agg(F.min("w").alias("w")).select("src", "dst", "w", F.col("src").alias("p"), F.col("dst").alias("q")))
    chosen = checkpointed(e.select("src", "dst", "w").limit(0))
    while rows := e.count():
        if rows <= compact.ONE_TASK:
            rest = compact.in_one_task(e.select("src", "dst", "w", "p", "q"), compact.forest, "src long, dst long, w double")
            return checkpointed(chosen.unionByName(rest))
        best = F.min(F.struct("w", "src", "dst", F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"))).alias("e")
        each = e.unionByName(e.select("src", "dst", "w", F.col("q").alias("p"), F.col("p").alias("q"))).groupBy("p").agg(best)
        new = checkpointed(each.select("e.*").distinct(), rows)
        chosen = checkpointed(chosen.unionByName(new.select("src", "dst", "w")))
        part = smallest_member(new, "p", "q")
        p, q = (part.select(F.col("id").alias(k), F.col("component").alias(v)) for k, v in (("p", "p2"), ("q", "q2")))
        e = e.join(p, "p").join(q, "q").where("p2 <> q2").select("src", "dst", "w", F.col("p2").alias("p"), F.col("q2").alias("q"))
        e = checkpointed(e, rows)
    return chosen


kruskal = spanning_forest


def prim(graph: PropertyGraph, start: int, weight: str | None = None, types=()) -> DataFrame:
    """The tree of a minimum spanning forest that holds ``start``."""
    forest = checkpointed(spanning_forest(graph, weight, types))
    part = smallest_member(forest)
    mine = part.where(F.col("id") == start).select("component")
    ids = part.join(mine, "component", "left_semi").select(F.col("id").alias("src"))
    return forest.join(ids, "src", "left_semi")


def label_propagation(graph: PropertyGraph, rounds: int = 100, types=()) -> DataFrame:
    """id, community. Synchronous: each round every node takes its neighbours' most frequent label, the smallest of
    equals. It may swing between two states; then, and after ``rounds``, it stops."""
    both = checkpointed(graph.edge_scan(types).where("src <> dst").select(F.explode(F.array(F.struct(F.col("src").alias("a"), F.col("dst").alias("b")), F.struct(F.col("dst").alias("a"), F.col("src").alias("b")))).alias("x")).select("x.*").groupBy("a", "b").agg(F.count(F.lit(1)).alias("m")))
    label = checkpointed(nodes_of(graph).select("id", F.col("id").alias("l")))
    if compact.small(both):
        found = compact.in_one_task(both.select("a", "b", "m"), compact.labels(rounds), "id long, l2 long")
        return label.join(found, "id", "left").select("id", F.coalesce("l2", "l").alias("community"))
    before = None
    for _ in range(rounds):
        votes = both.join(label, F.col("b") == F.col("id")).groupBy("a", "l").agg(F.sum("m").alias("n"))
        best = votes.groupBy("a").agg(F.max(F.struct("n", (-F.col("l")).alias("k"))).alias("x")).select("a", (-F.col("x.k")).alias("new"))
        new = checkpointed(label.join(best, F.col("id") == F.col("a"), "left").select("id", F.coalesce("new", "l").alias("l")))
        same = lambda x, y: x.exceptAll(y).isEmpty()
        if same(new, label) or before is not None and same(new, before):
            return new.withColumnRenamed("l", "community")
        before, label = label, new
    return label.withColumnRenamed("l", "community")


def modularity(graph: PropertyGraph, communities: DataFrame, types=()) -> float:
    """Of communities (id, community) over the undirected edges, each counted once."""
    e = checkpointed(graph.edge_scan(types).where("src <> dst").select("src", "dst"))
    m = e.count()
    if not m:
        return 0.0
    a, b = (communities.select(F.col("id").alias(k), F.col("community").alias(v)) for k, v in (("src", "x"), ("dst", "y")))
    ends = e.join(a, "src").join(b, "dst")
    inside = ends.where("x = y").count()
    degree = ends.select(F.explode(F.array("x", "y")).alias("c")).groupBy("c").count()
    return inside / m - (degree.agg(F.sum(F.col("count") * F.col("count"))).first()[0] or 0) / (4 * m * m)
