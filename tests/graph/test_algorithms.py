"""Each algorithm against a plain one on small random graphs."""

import itertools
import random
import re
from collections import Counter, defaultdict, deque

import pyarrow as pa
import pytest

from arcweave import cluster
from arcweave.algorithms import centrality, compact, sequential, structure, traversal
from arcweave.graph import PropertyGraph


def make(spark, n, m, seed, dag=False):
    rng = random.Random(seed)
    edges = []
    for i in range(m):
        a, b = rng.randrange(n), rng.randrange(n)
        if dag and a >= b:
            a, b = (b, a) if a != b else (0, n - 1)
        edges.append((i, a, b, "E", round(rng.uniform(0.5, 9), 3)))
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(n)], "id long, labels array<string>")
    return PropertyGraph.from_frames(nodes, spark.createDataFrame(edges, "eid long, src long, dst long, type string, w double")), edges


@pytest.fixture(params=[True, False], ids=["one task", "rounds"])
def both_ways(request, monkeypatch):
    """As one task takes a small graph, and as rounds of joins take a large one."""
    if not request.param:
        monkeypatch.setattr(compact, "ONE_TASK", -1)


@pytest.fixture(scope="module")
def sparse(spark):
    return make(spark, 16, 18, 1)


@pytest.fixture(scope="module")
def dense(spark):
    return make(spark, 12, 34, 2)


def out_of(edges):
    out = defaultdict(list)
    for _, a, b, _, w in edges:
        out[a].append((b, w))
    return out


def hops(edges, start):
    out, depth, queue = out_of(edges), {start: 0}, deque([start])
    while queue:
        v = queue.popleft()
        for w, _ in out[v]:
            if w not in depth:
                depth[w] = depth[v] + 1
                queue.append(w)
    return depth


def pairs(df):
    return {r[0]: r[1] for r in df.collect()}


def undirected(edges):
    return {tuple(sorted((a, b))) for _, a, b, _, _ in edges if a != b}


def parts(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_bfs_and_layers(both_ways, sparse, dense):
    for g, e in (sparse, dense):
        assert pairs(traversal.bfs(g, 0)) == hops(e, 0)
    layers = pairs(traversal.bfs_layers(dense[0], 0))
    assert sum(layers.values(), []) and set(sum(layers.values(), [])) == set(hops(dense[1], 0))


def test_components(both_ways, sparse, dense):
    for g, e in (sparse, dense):
        n = 16 if g is sparse[0] else 12
        assert pairs(structure.connected_components(g)) == dict(enumerate(parts(n, undirected(e))))
        assert structure.connected_component_count(g) == len(set(parts(n, undirected(e))))
        reach = {v: set(hops(e, v)) for v in range(n)}
        strong = {v: min(w for w in reach[v] if v in reach[w]) for v in range(n)}
        assert pairs(structure.strongly_connected_components(g)) == strong


def test_components_of_a_long_chain_and_a_hub(both_ways, spark):
    rows = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(40)] + [(5, 5), (5000, 5000)]
    got = pairs(structure.smallest_member(spark.createDataFrame(rows, "src long, dst long")))
    assert got == {i: 0 for i in range(41)} | {1000 + i: 1000 for i in range(40)} | {5000: 5000}


def test_weighted_paths(both_ways, dense):
    g, e = dense
    best = dict.fromkeys(range(12), float("inf"))
    best[0] = 0.0
    for _ in range(12):
        for _, a, b, _, w in e:
            best[b] = min(best[b], best[a] + w)
    paths = traversal.dijkstra(g, 0, "w")
    got = {r.id: r.distance for r in paths.collect()}
    assert got == pytest.approx({k: v for k, v in best.items() if v < float("inf")})
    target = max(got, key=got.get)
    path = traversal.path_to(paths, target)
    cheapest = {(a, b): min(w for _, x, y, _, w in e if (x, y) == (a, b)) for _, a, b, _, _ in e}
    assert sum(cheapest[p] for p in itertools.pairwise(path)) == pytest.approx(got[target]) and path[0] == 0
    assert traversal.astar(g, 0, target, "w")[0] == pytest.approx(got[target])
    every = {(r.src, r.dst): r.distance for r in traversal.floyd_warshall(g, "w").collect()}
    assert {k[1]: v for k, v in every.items() if k[0] == 0} == pytest.approx(got)
    assert traversal.bellman_ford(g, 0, "w")[1] is False


def test_negative_cycle(both_ways, spark):
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(3)], "id long, labels array<string>")
    edges = spark.createDataFrame([(0, 0, 1, "E", 1.0), (1, 1, 2, "E", -3.0), (2, 2, 1, "E", 1.0)], "eid long, src long, dst long, type string, w double")
    assert traversal.bellman_ford(PropertyGraph.from_frames(nodes, edges), 0, "w")[1] is True


def test_topological(both_ways, spark, dense):
    g, e = make(spark, 12, 20, 3, dag=True)
    level = pairs(traversal.topological_levels(g))
    assert len(level) == 12 and all(level[a] < level[b] for _, a, b, _, _ in e)
    assert traversal.is_dag(g) and not traversal.is_dag(dense[0])


def test_dfs(sparse):
    g, e = sparse
    out = {k: sorted(x for x, _ in v) for k, v in out_of(e).items()}
    seen, order = set(), []

    def visit(v):
        seen.add(v)
        for w in out.get(v, []):
            if w not in seen:
                visit(w)
        order.append(v)

    for v in range(16):
        if v not in seen:
            visit(v)
    assert traversal.dfs(g) == order


def test_triangles_clustering_cores(both_ways, dense, sparse):
    for g, e in (dense,):
        n = 12 if g is dense[0] else 16
        near = defaultdict(set)
        for a, b in undirected(e):
            near[a].add(b)
            near[b].add(a)
        found = [t for t in itertools.combinations(range(n), 3) if t[1] in near[t[0]] and t[2] in near[t[0]] and t[2] in near[t[1]]]
        count = Counter(v for t in found for v in t)
        assert pairs(structure.triangle_count(g)) == {v: count[v] for v in range(n)} and structure.total_triangles(g) == len(found)
        want = {v: 2 * count[v] / (len(near[v]) * (len(near[v]) - 1)) if len(near[v]) > 1 else 0.0 for v in range(n)}
        assert {r.id: r.coefficient for r in structure.clustering(g).collect()} == pytest.approx(want)
        core = {}
        for k in range(n):
            left = set(range(n))
            while drop := {v for v in left if len(near[v] & left) < k}:
                left -= drop
            core |= dict.fromkeys(left, k)
        assert pairs(structure.core_numbers(g)) == core


def test_spanning_forest(both_ways, dense, sparse):
    for g, e in (dense,):
        cheapest = {}
        for _, a, b, _, w in e:
            if a != b:
                k = tuple(sorted((a, b)))
                cheapest[k] = min(w, cheapest.get(k, w))
        root, kept = list(range(16)), set()
        find = lambda i: i if root[i] == i else find(root[i])  # noqa: B023, E731
        for (a, b), w in sorted(cheapest.items(), key=lambda x: (x[1], x[0])):
            if find(a) != find(b):
                root[find(a)] = find(b)
                kept.add((a, b, w))
        assert {tuple(r) for r in structure.kruskal(g, "w").collect()} == kept
        tree = structure.prim(g, 0, "w").collect()
        assert {tuple(r) for r in tree} == {x for x in kept if find(x[0]) == find(0)}


def test_pagerank(both_ways, dense, sparse):
    for g, e in (dense, sparse):
        n = 12 if g is dense[0] else 16
        out, r = out_of(e), [1 / n] * n
        for _ in range(100):
            lost = sum(r[v] for v in range(n) if not out[v])
            new = [0.15 / n + 0.85 * lost / n] * n
            for v in range(n):
                for w, _ in out[v]:
                    new[w] += 0.85 * r[v] / len(out[v])
            done = max(abs(a - b) for a, b in zip(r, new, strict=True)) < 1e-6
            r = new
            if done:
                break
        assert pairs(centrality.pagerank(g)) == pytest.approx(dict(enumerate(r)))


def test_betweenness_and_closeness(sparse):
    g, e = sparse
    depth = {v: hops(e, v) for v in range(16)}
    out = {k: set(x for x, _ in v) for k, v in out_of(e).items()}
    paths = defaultdict(float)
    for s in range(16):
        paths[s, s] = 1
        for v in sorted(depth[s], key=depth[s].get):
            for w in sorted(out.get(v, ())):
                if depth[s][w] == depth[s][v] + 1:
                    # parallel edges make one path here only if the adjacency has them once
                    paths[s, w] += paths[s, v] * sum(1 for x, _ in out_of(e)[v] if x == w)
    want = dict.fromkeys(range(16), 0.0)
    for s, t, v in itertools.product(range(16), repeat=3):
        if len({s, t, v}) == 3 and t in depth[s] and v in depth[s] and t in depth[v] and depth[s][v] + depth[v][t] == depth[s][t]:
            want[v] += paths[s, v] * paths[v, t] / paths[s, t]
    assert pairs(centrality.betweenness_centrality(g, normalized=False)) == pytest.approx(want)
    close = {v: (len(d) - 1) / sum(d.values()) if sum(d.values()) else 0.0 for v, d in depth.items()}
    assert pairs(centrality.closeness_centrality(g)) == pytest.approx(close)


def test_flows(spark):
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(6)], "id long, labels array<string>")
    rows = [(0, 1, 16.0, 1.0), (0, 2, 13.0, 4.0), (1, 3, 12.0, 2.0), (2, 1, 4.0, 1.0), (3, 2, 9.0, 1.0), (2, 4, 14.0, 3.0), (4, 3, 7.0, 1.0), (3, 5, 20.0, 1.0), (4, 5, 4.0, 2.0)]
    edges = spark.createDataFrame([(i, a, b, "E", c, d) for i, (a, b, c, d) in enumerate(rows)], "eid long, src long, dst long, type string, cap double, cost double")
    g = PropertyGraph.from_frames(nodes, edges)
    assert sequential.max_flow(g, 0, 5, "cap") == 23 and sequential.max_flow(g, 0, 99) is None
    flow, cost = sequential.min_cost_max_flow(g, 0, 5, "cap", "cost")
    assert flow == 23 and cost <= 12 * 4 + 4 * 8 + 7 * 9 + 100


def test_cut_points_and_bridges(sparse):
    g, e = sparse
    links = undirected(e)
    count = lambda vs, ls: len({parts(16, ls)[v] for v in vs})
    base = count(range(16), links)
    assert {(r.src, r.dst) for r in sequential.bridges(g).collect()} == {x for x in links if count(range(16), links - {x}) > base}
    want = {v for v in range(16) if count([u for u in range(16) if u != v], {x for x in links if v not in x}) > base - (not any(v in x for x in links))}
    assert {r.id for r in sequential.articulation_points(g).collect()} == want


def test_communities(both_ways, spark):
    cliques = [(a + c * 6, b + c * 6) for c in range(3) for a, b in itertools.combinations(range(6), 2)] + [(5, 6), (11, 12)]
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(18)], "id long, labels array<string>")
    g = PropertyGraph.from_frames(nodes, spark.createDataFrame([(i, a, b, "E") for i, (a, b) in enumerate(cliques)], "eid long, src long, dst long, type string"))
    want = {v: v // 6 * 6 for v in range(18)}
    found = sequential.louvain(g)
    assert pairs(found) == want
    assert structure.modularity(g, found) == pytest.approx(45 / 47 - (31**2 + 32**2 + 31**2) / (4 * 47**2))
    got = pairs(structure.label_propagation(g))
    assert len({got[v] for v in range(6)}) == 1 and len(set(got.values())) <= 3


def test_degrees(dense):
    g, e = dense
    got = {r.id: (r.out_degree, r.in_degree) for r in centrality.degree_centrality(g).collect()}
    assert got == {v: (sum(a == v for _, a, _, _, _ in e), sum(b == v for _, _, b, _, _ in e)) for v in range(12)}


def test_cut_points_of_more_edges_than_the_driver_takes(sparse, monkeypatch):
    monkeypatch.setattr(sequential, "MOST_EDGES", 5)
    links, count = undirected(sparse[1]), lambda vs, ls: len({parts(16, ls)[v] for v in vs})
    base = count(range(16), links)
    assert {(r.src, r.dst) for r in sequential.bridges(sparse[0]).collect()} == {x for x in links if count(range(16), links - {x}) > base}
    want = {v for v in range(16) if count([u for u in range(16) if u != v], {x for x in links if v not in x}) > base - (not any(v in x for x in links))}
    assert {r.id for r in sequential.articulation_points(sparse[0]).collect()} == want


def test_adjacency_of_runs_that_go_on_in_the_next_batch_and_ranges_in_any_order():
    rows = [(7, 1, 2), (7, 4, 1), (9, 1, 5), (1, 4, 3), (1, 7, 2), (1, 9, 5), (4, 1, 3), (4, 7, 1)]
    batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i:j], strict=True)], ["a", "b", "m"]) for i, j in ((0, 1), (1, 4), (4, 5), (5, 8))]
    g = compact.Adjacency(iter(batches), len(rows))
    got = {int(v): [(int(g.ids[x]), int(m)) for x, m in zip(g.to[i : i + k], g.m[i : i + k], strict=True)] for v, i, k in zip(g.ids, g.first, g.size, strict=True)}
    assert got == {1: [(4, 3), (7, 2), (9, 5)], 4: [(1, 3), (7, 1)], 7: [(1, 2), (4, 1)], 9: [(1, 5)]}


def test_louvain_of_more_edges_than_the_driver_takes(spark, monkeypatch):
    monkeypatch.setattr(sequential, "MOST_EDGES", 5)
    cliques = [(a + c * 6, b + c * 6) for c in range(3) for a, b in itertools.combinations(range(6), 2)] + [(5, 6), (11, 12), (3, 3)]
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(19)], "id long, labels array<string>")
    g = PropertyGraph.from_frames(nodes, spark.createDataFrame([(i, a, b, "E") for i, (a, b) in enumerate(cliques)], "eid long, src long, dst long, type string"))
    assert pairs(sequential.louvain(g)) == {v: v // 6 * 6 for v in range(19)}


def test_levels_above_many_ends_take_few_rounds(spark, monkeypatch):
    monkeypatch.setattr(compact, "ONE_TASK", 40)
    rows, written = [(i, i + 1) for i in range(30)] + [(i % 31, 100 + i) for i in range(200)], []
    real = traversal.checkpointed
    monkeypatch.setattr(traversal, "checkpointed", lambda *x: written.append(x) or real(*x))
    edges = spark.createDataFrame([(i, a, b, "E") for i, (a, b) in enumerate(rows)], "eid long, src long, dst long, type string")
    nodes = spark.createDataFrame([(i, ["N"]) for i in {x for r in rows for x in r}], "id long, labels array<string>")
    want = {i: i for i in range(31)} | {100 + i: i % 31 + 1 for i in range(200)}
    assert pairs(traversal.topological_levels(PropertyGraph.from_frames(nodes, edges))) == want
    assert len(written) < 10  # three a level before


def test_rounds_of_cores_broadcast_nothing(spark, monkeypatch, dense):
    monkeypatch.setattr(compact, "ONE_TASK", 12)
    plans, real = [], structure.checkpointed
    monkeypatch.setattr(structure, "checkpointed", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or real(df))
    near = defaultdict(set)
    for a, b in undirected(dense[1]):
        near[a].add(b)
        near[b].add(a)
    core = {}
    for k in range(12):
        left = set(range(12))
        while drop := {v for v in left if len(near[v] & left) < k}:
            left -= drop
        core |= dict.fromkeys(left, k)
    assert pairs(structure.core_numbers(dense[0])) == core
    assert len(plans) > 3 and not any("BroadcastExchange" in p for p in plans)


@pytest.mark.parametrize(("most", "table", "cells"), [(0, 4000, 64), (20, 4000, 64), (20, 4, 64)], ids=["joins", "table", "searches"])
def test_closeness_of_more_edges_than_executors_take(spark, monkeypatch, most, table, cells):
    monkeypatch.setattr(centrality, "TABLE", table)
    monkeypatch.setattr(centrality, "CELLS", cells)
    rng = random.Random(8)
    edges = [(i, rng.randrange(40), rng.randrange(6), "E", 1.0) for i in range(60)]
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(41)], "id long, labels array<string>")
    g = PropertyGraph.from_frames(nodes, spark.createDataFrame(edges, "eid long, src long, dst long, type string, w double"))
    depth = {v: hops(edges, v) for v in range(41)}
    close = {v: (len(d) - 1) / sum(d.values()) if sum(d.values()) else 0.0 for v, d in depth.items()}
    assert pairs(centrality.closeness_centrality(g, most_edges=most)) == pytest.approx(close)
    assert pairs(centrality.closeness_centrality(g, wf=True, most_edges=most)) == pytest.approx({v: c * (len(depth[v]) - 1) / 40 for v, c in close.items()})


def test_dangling_edges_are_found_in_partitions_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(cluster, "PARTITION_ROWS", 3, raising=False)
    rows = [(0, 0, 1), (1, 1, 9), (2, 8, 9), (3, None, 2), (4, 2, 2), (5, 9, 0)]
    edges = spark.createDataFrame([(*r, "E") for r in rows], "eid long, src long, dst long, type string")
    nodes = spark.createDataFrame([(i, ["N"]) for i in range(3)], "id long, labels array<string>")
    g = PropertyGraph.from_frames(nodes, edges)
    assert sorted(r.eid for r in g.dangling_edges().collect()) == [1, 2, 3, 5]
    assert cluster.partitions_for(spark, 300) == 101
    assert PropertyGraph.from_frames(nodes, edges.where("eid in (0, 4)")).dangling_edges().isEmpty()


def test_walks_are_counted_between_levels_only_and_go_on_as_they_are(spark, sparse, monkeypatch):
    monkeypatch.setattr(cluster, "PARTITION_ROWS", 5, raising=False)
    g, e = sparse
    found = g.cypher("MATCH (a)-[*1..2]->(b) RETURN a AS a, b AS b")
    want = Counter((a, b) for _, a, b, _, _ in e) + Counter((a, d) for _, a, b, _, _ in e for _, c, d, _, _ in e if b == c)
    assert Counter(tuple(r) for r in found.collect()) == want
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert len(re.findall(r"Aggregate \[_s#\w+, _[ty]#", plan)) == 2  # 3 before: the last level, too
