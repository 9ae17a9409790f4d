"""Registries, adapters and bridges on a small graph: 0 -> 1 -> 2 -> 0, 2 -> 3, and 4 alone."""

import pytest
from pyspark.sql import functions as F

from arcweave import adapters, plugins
from arcweave.graph import PropertyGraph
from arcweave.sources import snapshots


@pytest.fixture(scope="module")
def ring(spark):
    nodes = spark.createDataFrame([(i, float(i)) for i in range(5)], "id long, x double")
    edges = spark.createDataFrame([(0, 0, 1, 2.0), (1, 1, 2, 2.0), (2, 2, 0, 1.0), (3, 2, 3, 5.0)], "eid long, src long, dst long, w double")
    return PropertyGraph(spark).with_vertices(nodes, "N").with_edges(edges, "E", "N", "N")


def test_network_view(ring):
    v = adapters.NetworkView(ring)
    assert (v.number_of_nodes(), v.number_of_edges()) == (5, 4) and v.nodes() == [0, 1, 2, 3, 4] and v.edges() == [(0, 1), (1, 2), (2, 0), (2, 3)]
    assert v.has_node(4) and not v.has_node(9) and v.has_edge(2, 3) and not v.has_edge(3, 2)
    assert v.neighbors(2) == [0, 3] and v.predecessors(0) == [2] and v.degree()[2] == 3 and v.in_degree()[3] == 1 and v.out_degree()[4] == 0
    assert v.shortest_path(0, 3) == [0, 1, 2, 3] and v.shortest_path_length(0, 3, "w") == 9.0 and v.shortest_path_length(3, 0) is None
    assert sum(v.pagerank().values()) == pytest.approx(1) and v.connected_components() == [{0, 1, 2, 3}, {4}]
    assert v.topological_sort() is None and v.closeness_centrality()[4] == 0 and v.betweenness_centrality()[4] == 0


def test_solver(ring):
    s = adapters.Solver(ring)
    assert s.shortest_path(0, 3, "w") == {"status": "optimal", "distance": 9.0, "path": [0, 1, 2, 3]}
    assert s.shortest_path(0, 3, method="bellman_ford")["distance"] == 3 and s.shortest_path(3, 0)["status"] == "infeasible"
    assert s.all_pairs_shortest_paths("w")[1, 0] == 3.0 and s.max_flow(0, 3, "w")["max_flow"] == 2 and s.max_flow(0, 99)["status"] == "infeasible"
    assert s.minimum_spanning_tree("w")["total_weight"] == 8.0 and s.min_cost_max_flow(0, 3, "w")["max_flow"] == 2
    assert s.graph_stats() == {"nodes": 5, "edges": 4, "density": 0.2, "components": 2}
    with pytest.raises(ValueError, match="unknown method"):
        s.shortest_path(0, 3, method="magic")


def test_functions_and_aggregates(ring):
    plugins.register_function("halved", lambda x: x / 2)
    plugins.register_aggregate("span", lambda x: F.max(x) - F.min(x))
    assert ring.cypher("MATCH (n:N) WHERE n.x = 3 RETURN Halved(n.x) AS h").first()["h"] == 1.5
    assert ring.cypher("MATCH (n:N) RETURN span(n.x) AS s").first()["s"] == 4.0


def test_algorithms_by_name(ring):
    r = plugins.registry()
    assert "pagerank" in r.names() and {x.id: x.depth for x in r.call(ring, "bfs", start=0).collect()} == {0: 0, 1: 1, 2: 2, 3: 3}
    assert r.call(ring, "max_flow", source=0, sink=3) == 1
    for given, error in (({}, ValueError), ({"start": 0, "no": 1}, ValueError), ({"start": "0"}, TypeError)):
        with pytest.raises(error):
            r.call(ring, "bfs", **given)
    r.register(plugins.Algorithm("nodes", lambda g: g.info()["nodes"]))
    assert r.call(ring, "nodes") == 5
    with pytest.raises(ValueError, match="already"):
        r.register(plugins.Algorithm("nodes", lambda g: 0))


def test_visitors(ring):
    seen = []
    plugins.visit_layers(ring, 0, lambda depth, nodes: seen.append((depth, [x.id for x in nodes.collect()])) or depth < 1)
    assert seen == [(0, [0]), (1, [1])]
    order = []
    plugins.visit_depth_first(ring, 0, order.append)
    assert order == [3, 2, 1, 0]


class Network:
    """As much of a networkx graph as the bridge asks for."""

    def __init__(self, directed):
        self.directed = directed

    def is_directed(self):
        return self.directed

    def nodes(self, data=False):
        return [("a", {"size": 1}), ("b", {})] if data else ["a", "b"]

    def edges(self, data=False):
        return [("a", "b", {"w": 2.5})]


@pytest.mark.parametrize(("directed", "edges"), [(True, {(0, 1, 2.5)}), (False, {(0, 1, 2.5), (1, 0, 2.5)})])
def test_from_networkx(spark, directed, edges):
    g = snapshots.from_networkx(spark, Network(directed))
    assert {(r.src, r.dst, r.w) for r in g.edge_scan(properties=None).collect()} == edges
    assert {(r.id, r["name"]) for r in g.node_scan().collect()} == {(0, "a"), (1, "b")}
