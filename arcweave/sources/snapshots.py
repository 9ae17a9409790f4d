"""Graphs as folders of Parquet tables, and from and to edge lists."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.graph import EdgeTable, PropertyGraph, VertexTable


def save(graph: PropertyGraph, path: str) -> None:
    """One folder per table, and a manifest table of what each is."""
    rows = []
    for i, t in enumerate(graph.vertices):
        t.df.write.parquet(f"{path}/vertices-{i}")
        rows.append(("vertex", i, json.dumps({"labels": t.labels})))
    for i, t in enumerate(graph.edges):
        t.df.write.parquet(f"{path}/edges-{i}")
        rows.append(("edge", i, json.dumps({"type": t.type, "source": t.source, "target": t.target})))
    graph.spark.createDataFrame(rows, "kind string, number int, about string").coalesce(1).write.parquet(f"{path}/manifest")


def load(spark: SparkSession, path: str) -> PropertyGraph:
    graph = PropertyGraph(spark)
    vertices, edges = [], []
    for r in sorted(spark.read.parquet(f"{path}/manifest").collect()):
        about = json.loads(r["about"])
        if r["kind"] == "vertex":
            labels = about["labels"]
            vertices.append(VertexTable(spark.read.parquet(f"{path}/vertices-{r['number']}"), tuple(labels) if labels else None))
        else:
            edges.append(EdgeTable(spark.read.parquet(f"{path}/edges-{r['number']}"), about["type"], tuple(about["source"]), tuple(about["target"])))
    return PropertyGraph(graph.spark, tuple(vertices), tuple(edges))


def from_edge_list(edges: DataFrame, src: str = "src", dst: str = "dst", type: str = "EDGE", label: str = "Node") -> PropertyGraph:
    """A graph of the ids that edges name."""
    e = edges.withColumnsRenamed({src: "src", dst: "dst"})
    if "eid" not in e.columns:
        e = e.withColumn("eid", F.xxhash64(*e.columns))
    ids = e.select(F.explode(F.array(F.col("src").cast("bigint"), F.col("dst").cast("bigint"))).alias("id")).distinct()
    return PropertyGraph(edges.sparkSession).with_vertices(ids, label).with_edges(e, type, label, label)


def to_networkx(graph: PropertyGraph, most_edges: int = 1_000_000):
    """A networkx.MultiDiGraph of a small graph; networkx is optional."""
    import networkx

    if graph.edge_scan().count() > most_edges:
        raise ValueError(f"more than {most_edges} edges")
    out = networkx.MultiDiGraph()
    for r in graph.node_scan(with_labels=True).collect():
        d = r.asDict()
        out.add_node(d.pop("id"), **d)
    for r in graph.edge_scan(properties=None, with_type=True).collect():
        d = r.asDict()
        out.add_edge(d.pop("src"), d.pop("dst"), key=d.pop("eid"), **d)
    return out


def from_networkx(spark: SparkSession, network, label: str = "Node", type: str = "EDGE") -> PropertyGraph:
    """A graph of a networkx graph's nodes (whole numbers or not: ids are given in their order, the name becomes the
    property ``name``) and edges with their attributes. It has been in one process's memory, and so are its rows here.
    """
    number = {n: i for i, n in enumerate(network.nodes())}
    rows = [{"id": i, "name": str(n), **{str(k): v for k, v in a.items()}} for (n, a), i in zip(network.nodes(data=True), number.values(), strict=True)]
    edges = [{"eid": i, "src": number[a], "dst": number[b], **{str(k): v for k, v in d.items()}} for i, (a, b, d) in enumerate(network.edges(data=True))]
    if not network.is_directed():
        edges += [{**e, "eid": len(edges) + i, "src": e["dst"], "dst": e["src"]} for i, e in enumerate(edges) if e["src"] != e["dst"]]
    graph = PropertyGraph(spark).with_vertices(_frame(spark, rows, ("id",)), label)
    return graph.with_edges(_frame(spark, edges, ("eid", "src", "dst")), type, label, label)


def _frame(spark: SparkSession, rows: list[dict], numbers: tuple[str, ...]) -> DataFrame:
    import pandas as pd

    if not rows:
        return spark.createDataFrame([], ", ".join(f"{n} long" for n in numbers))
    names = list(dict.fromkeys(k for r in rows for k in r))
    return spark.createDataFrame(pd.DataFrame([{k: r.get(k) for k in names} for r in rows]))
