"""User functions, aggregates and algorithms by name, and traversals that report to a visitor."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.algorithms import centrality, sequential, structure, traversal
from arcweave.functions.scalar import AGGREGATES, SCALARS
from arcweave.graph import PropertyGraph


def register_function(name: str, function: Callable[..., Column]) -> None:
    """A function of Columns for GQL and Cypher, called by any spelling of the name."""
    SCALARS[name.lower()] = function


def register_aggregate(name: str, function: Callable[[Column], Column]) -> None:
    """An aggregate of one Column; it isn't for use with DISTINCT."""

    def run(x: Column, distinct: bool) -> Column:
        if distinct:
            raise ValueError(f"{name} has no DISTINCT")
        return function(x)

    AGGREGATES[name.lower()] = run


@dataclass(frozen=True)
class Parameter:
    name: str
    kind: type
    default: object = None
    required: bool = False


@dataclass(frozen=True)
class Algorithm:
    """run(graph, **parameters) gives a DataFrame, or a number, list or tuple."""

    name: str
    run: Callable
    parameters: tuple[Parameter, ...] = ()

    def __call__(self, graph: PropertyGraph, **given):
        known = {p.name: p for p in self.parameters}
        if unknown := set(given) - set(known):
            raise ValueError(f"{self.name} has no parameter {sorted(unknown)[0]}")
        if missing := [p.name for p in self.parameters if p.required and p.name not in given]:
            raise ValueError(f"{self.name} needs {missing[0]}")
        for k, v in given.items():
            kind = known[k].kind
            if v is not None and not isinstance(v, (int, float) if kind is float else kind):
                raise TypeError(f"{self.name}: {k} is a {kind.__name__}")
        return self.run(graph, **{p.name: given.get(p.name, p.default) for p in self.parameters})


@dataclass
class Registry:
    algorithms: dict[str, Algorithm] = field(default_factory=dict)

    def register(self, algorithm: Algorithm) -> None:
        if algorithm.name in self.algorithms:
            raise ValueError(f"{algorithm.name} is there already")
        self.algorithms[algorithm.name] = algorithm

    def get(self, name: str) -> Algorithm:
        return self.algorithms[name]

    def names(self) -> list[str]:
        return sorted(self.algorithms)

    def call(self, graph: PropertyGraph, name: str, **given):
        return self.get(name)(graph, **given)


def registry() -> Registry:
    """The library's own algorithms; more can be registered."""
    p, out = Parameter, Registry()
    start, weight = p("start", int, required=True), p("weight", str)
    for name, run, parameters in (
        ("bfs", traversal.bfs, (start, p("max_depth", int))),
        ("bfs_layers", traversal.bfs_layers, (start,)),
        ("dfs", traversal.dfs, (p("start", int),)),
        ("dijkstra", traversal.dijkstra, (p("source", int, required=True), weight)),
        ("bellman_ford", traversal.bellman_ford, (p("source", int, required=True), weight)),
        ("floyd_warshall", traversal.floyd_warshall, (weight,)),
        ("topological_levels", traversal.topological_levels, ()),
        ("connected_components", structure.connected_components, ()),
        ("strongly_connected_components", structure.strongly_connected_components, ()),
        ("triangle_count", structure.triangle_count, ()),
        ("clustering", structure.clustering, ()),
        ("core_numbers", structure.core_numbers, ()),
        ("spanning_forest", structure.spanning_forest, (weight,)),
        ("label_propagation", structure.label_propagation, (p("rounds", int, 100),)),
        ("degree_centrality", centrality.degree_centrality, (p("normalized", bool, False),)),
        ("pagerank", centrality.pagerank, (p("damping", float, 0.85), p("max_iterations", int, 100), p("tolerance", float, 1e-6))),
        ("betweenness_centrality", centrality.betweenness_centrality, (p("normalized", bool, True),)),
        ("closeness_centrality", centrality.closeness_centrality, (p("wf", bool, False),)),
        ("louvain", sequential.louvain, (p("resolution", float, 1.0),)),
        ("articulation_points", sequential.articulation_points, ()),
        ("bridges", sequential.bridges, ()),
        ("max_flow", sequential.max_flow, (p("source", int, required=True), p("sink", int, required=True), p("capacity", str))),
        ("min_cost_max_flow", sequential.min_cost_max_flow, (p("source", int, required=True), p("sink", int, required=True), p("capacity", str), p("cost", str))),
    ):
        out.register(Algorithm(name, run, parameters))
    return out


def visit_layers(graph: PropertyGraph, start: int, visitor: Callable[[int, DataFrame], bool | None], types=()) -> None:
    """Breadth-first: the visitor gets each layer's depth and nodes as a DataFrame (``id``); False ends the search."""
    found = traversal.bfs(graph, start, types)
    for depth in sorted(r["depth"] for r in found.select("depth").distinct().collect()):
        if visitor(depth, found.where(F.col("depth") == depth).select("id")) is False:
            return


def visit_depth_first(graph: PropertyGraph, start: int | None, visitor: Callable[[int], bool | None], types=()) -> None:
    """Depth-first: the visitor gets each node as it is finished; False ends the search. On the driver, as ``dfs``."""
    for node in traversal.dfs(graph, start, types):
        if visitor(node) is False:
            return
