"""Views of a graph in the style of in-memory libraries: answers as Python values, for graphs whose answers fit there."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import functions as F

from arcweave.algorithms import centrality, sequential, structure, traversal
from arcweave.graph import PropertyGraph


def _dict(df) -> dict:
    return {r[0]: r[1] for r in df.collect()}


@dataclass(frozen=True)
class NetworkView:
    """Nodes, edges, neighbours and measures by the names that network libraries give them."""

    graph: PropertyGraph

    def number_of_nodes(self) -> int:
        return self.graph.info()["nodes"]

    def number_of_edges(self) -> int:
        return self.graph.info()["edges"]

    def nodes(self) -> list[int]:
        return sorted(_dict(traversal.nodes_of(self.graph).select("id", F.lit(0))))

    def edges(self) -> list[tuple[int, int]]:
        return sorted((r["src"], r["dst"]) for r in self.graph.edge_scan().collect())

    def has_node(self, node: int) -> bool:
        return not traversal.nodes_of(self.graph).where(F.col("id") == node).isEmpty()

    def has_edge(self, a: int, b: int) -> bool:
        return not self.graph.edge_scan().where((F.col("src") == a) & (F.col("dst") == b)).isEmpty()

    def neighbors(self, node: int) -> list[int]:
        return sorted({r["neighbor"] for r in self.graph.neighbors([node]).collect()})

    successors = neighbors

    def predecessors(self, node: int) -> list[int]:
        return sorted({r["neighbor"] for r in self.graph.neighbors([node], "in").collect()})

    def degree(self) -> dict[int, int]:
        return _dict(self.graph.degrees().select("id", "degree"))

    def in_degree(self) -> dict[int, int]:
        return _dict(self.graph.degrees().select("id", "in_degree"))

    def out_degree(self) -> dict[int, int]:
        return _dict(self.graph.degrees().select("id", "out_degree"))

    def shortest_path(self, source: int, target: int, weight: str | None = None) -> list[int]:
        return traversal.path_to(traversal.shortest_paths(self.graph, source, weight), target)

    def shortest_path_length(self, source: int, target: int, weight: str | None = None) -> float | None:
        row = traversal.shortest_paths(self.graph, source, weight).where(F.col("id") == target).first()
        return row["distance"] if row else None

    def pagerank(self, alpha: float = 0.85, max_iter: int = 100, tol: float = 1e-6) -> dict[int, float]:
        return _dict(centrality.pagerank(self.graph, alpha, max_iter, tol))

    def betweenness_centrality(self, normalized: bool = True) -> dict[int, float]:
        return _dict(centrality.betweenness_centrality(self.graph, normalized))

    def closeness_centrality(self, wf_improved: bool = False) -> dict[int, float]:
        return _dict(centrality.closeness_centrality(self.graph, wf_improved))

    def connected_components(self) -> list[set[int]]:
        groups: dict[int, set[int]] = {}
        for node, component in _dict(structure.connected_components(self.graph)).items():
            groups.setdefault(component, set()).add(node)
        return [groups[k] for k in sorted(groups)]

    def topological_sort(self) -> list[int] | None:
        levels = traversal.topological_levels(self.graph)
        return None if levels is None else [r["id"] for r in levels.orderBy("level", "id").collect()]


@dataclass(frozen=True)
class Solver:
    """Problems and their solutions as dictionaries with a ``status``."""

    graph: PropertyGraph

    def shortest_path(self, source: int, target: int, weight: str | None = None, method: str = "dijkstra") -> dict:
        if method not in ("dijkstra", "bellman_ford", "astar"):
            raise ValueError(f"unknown method {method}")
        if method == "bellman_ford":
            paths, negative = traversal.bellman_ford(self.graph, source, weight)
            if negative:
                return {"status": "negative cycle"}
        else:
            paths = traversal.dijkstra(self.graph, source, weight)
        row = paths.where(F.col("id") == target).first()
        return {"status": "infeasible"} if row is None else {"status": "optimal", "distance": row["distance"], "path": traversal.path_to(paths, target)}

    def all_pairs_shortest_paths(self, weight: str | None = None) -> dict[tuple[int, int], float]:
        return {(r["src"], r["dst"]): r["distance"] for r in traversal.floyd_warshall(self.graph, weight).collect()}

    def max_flow(self, source: int, sink: int, capacity: str | None = None) -> dict:
        flow = sequential.max_flow(self.graph, source, sink, capacity)
        return {"status": "infeasible"} if flow is None else {"status": "optimal", "max_flow": flow}

    def min_cost_max_flow(self, source: int, sink: int, capacity: str | None = None, cost: str | None = None) -> dict:
        found = sequential.min_cost_max_flow(self.graph, source, sink, capacity, cost)
        return {"status": "infeasible"} if found is None else {"status": "optimal", "max_flow": found[0], "total_cost": found[1]}

    def minimum_spanning_tree(self, weight: str | None = None) -> dict:
        edges = sorted((r["src"], r["dst"], r["w"]) for r in structure.spanning_forest(self.graph, weight).collect())
        return {"status": "optimal", "edges": edges, "total_weight": sum(w for _, _, w in edges)}

    def communities(self, resolution: float = 1.0) -> dict:
        found = sequential.louvain(self.graph, resolution)
        return {"status": "optimal", "communities": _dict(found), "modularity": structure.modularity(self.graph, found)}

    def graph_stats(self) -> dict[str, float]:
        info = self.graph.info()
        n, m = info["nodes"], info["edges"]
        return {"nodes": n, "edges": m, "density": m / (n * (n - 1)) if n > 1 else 0.0, "components": structure.connected_component_count(self.graph)}
