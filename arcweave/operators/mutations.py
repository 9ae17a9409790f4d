"""Writes as pure functions: each takes a graph and rows and gives a new graph; the old one stays as it was."""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arcweave.cluster import checkpointed
from arcweave.graph import EdgeTable, PropertyGraph, VertexTable


def next_id(graph: PropertyGraph, kind: str = "node") -> int:
    df, name = (graph.node_scan(properties=()), "id") if kind == "node" else (graph.edge_scan(), "eid")
    top = df.agg(F.max(name)).first()[0]
    return 0 if top is None else top + 1


def _numbered(rows: DataFrame, start: int, name: str) -> DataFrame:
    """Unique ids from ``start`` on, with gaps: no task has to see all rows."""
    return checkpointed(rows.withColumn(name, F.monotonically_increasing_id() + start))


def create_nodes(graph: PropertyGraph, rows: DataFrame, *labels: str) -> PropertyGraph:
    """One node for each row of properties; ids are given unless there is a column ``id``."""
    if "id" not in rows.columns:
        rows = _numbered(rows, next_id(graph), "id")
    return graph.with_vertices(rows, *labels)


def create_edges(graph: PropertyGraph, rows: DataFrame, type: str) -> PropertyGraph:
    """rows: src, dst and properties; ``eid`` is given unless it is there."""
    if "eid" not in rows.columns:
        rows = _numbered(rows, next_id(graph, "edge"), "eid")
    return graph.with_edges(rows, type)


def _holds(t: VertexTable | EdgeTable, only: Collection[str]) -> bool:
    """Whether nodes with all the labels, or edges of one of the types, can be in the table. only: empty if unknown."""
    if isinstance(t, VertexTable):
        return t.labels is None or set(only) <= set(t.labels)
    return not only or t.type is None or t.type.lower() in {x.lower() for x in only}


def delete_nodes(graph: PropertyGraph, ids: DataFrame, detach: bool = True, only: Collection[str] = ()) -> PropertyGraph:
    """ids: a column ``id``. With detach, edges at a deleted node go, too; without, they are left dangling.

    only: labels that all these nodes carry; other tables, and edges that can't end in such a node, aren't read.
    """
    ids = ids.select(F.col("id").alias("_gone")).distinct()
    gone = lambda df, c: df.join(ids, F.col(c) == F.col("_gone"), "left_anti")
    touched = [t for t in graph.vertices if _holds(t, only)]
    vertices = tuple(replace(t, df=gone(t.df, "id")) if t in touched else t for t in graph.vertices)
    edges = []
    for t in graph.edges:
        df = t.df
        for c, labels in (("src", t.source), ("dst", t.target)) if detach else ():
            if any(v.labels is None or set(labels) <= set(v.labels) for v in touched):
                df = gone(df, c)
        edges.append(t if df is t.df else replace(t, df=df))
    return replace(graph, vertices=vertices, edges=tuple(edges))


def delete_edges(graph: PropertyGraph, ids: DataFrame, only: Collection[str] = ()) -> PropertyGraph:
    """ids: a column ``eid``; only: types that they may have."""
    ids = ids.select(F.col("eid").alias("_gone")).distinct()
    gone = lambda t: replace(t, df=t.df.join(ids, F.col("eid") == F.col("_gone"), "left_anti"))
    return replace(graph, edges=tuple(gone(t) if _holds(t, only) else t for t in graph.edges))


def _set(df: DataFrame, key: str, name: str, values: DataFrame) -> DataFrame:
    """values: _id, _value. The last column of that name gives way; a null value removes the property."""
    values = values.groupBy("_id").agg(F.first("_value").alias("_value")).withColumn("_hit", F.lit(True))
    joined = df.join(values, F.col(key) == F.col("_id"), "left")
    old = F.col(f"`{name}`") if name in df.columns else F.lit(None)
    new = F.when(F.col("_hit"), F.col("_value")).otherwise(old)
    return joined.withColumn(name, new).drop("_id", "_value", "_hit")


def set_property(graph: PropertyGraph, values: DataFrame, name: str, kind: str = "node", only: Collection[str] = ()) -> PropertyGraph:
    """values: id (or eid) and value; other nodes keep what they have. only: labels that all of these nodes carry, or
    types that these edges may have."""
    key = "id" if kind == "node" else "eid"
    values = values.select(F.col(key).alias("_id"), F.col("value").alias("_value"))
    changed = lambda t: replace(t, df=_set(t.df, key, name, values)) if _holds(t, only) else t
    if kind == "node":
        return replace(graph, vertices=tuple(map(changed, graph.vertices)))
    return replace(graph, edges=tuple(map(changed, graph.edges)))


def replace_properties(graph: PropertyGraph, ids: DataFrame, properties: dict[str, Column | object], merge: bool = False, kind: str = "node", only: Collection[str] = ()) -> PropertyGraph:
    """Set several properties of the ids; unless merged, all their other properties become null."""
    key = "id" if kind == "node" else "eid"
    names = dict.fromkeys(properties)
    if not merge:
        tables = graph.vertices if kind == "node" else graph.edges
        names |= dict.fromkeys(p for t in tables if _holds(t, only) for p in t.properties)
    for name in names:
        v = properties.get(name)
        graph = set_property(graph, ids.select(key, (v if isinstance(v, Column) else F.lit(v)).alias("value")), name, kind, only)
    return graph


def _with_labels(t: VertexTable) -> DataFrame:
    return t.df if t.labels is None else t.df.withColumn("labels", F.array(*[F.lit(x) for x in t.labels]))


def change_labels(graph: PropertyGraph, ids: DataFrame, labels: tuple[str, ...], add: bool, only: Collection[str] = ()) -> PropertyGraph:
    """Add labels to the nodes of a column ``id``, or take them away. only: labels that all these nodes carry."""
    ids = ids.select(F.col("id").alias("_id")).distinct().withColumn("_hit", F.lit(True))
    these = F.array(*[F.lit(x) for x in labels])
    tables = []
    for t in graph.vertices:
        if not _holds(t, only):
            tables.append(t)
            continue
        df = _with_labels(t).join(ids, F.col("id") == F.col("_id"), "left")
        new = F.array_union("labels", these) if add else F.array_except("labels", these)
        tables.append(VertexTable(df.withColumn("labels", F.when(F.col("_hit"), new).otherwise(F.col("labels"))).drop("_id", "_hit"), None))
    # What edge tables say of their ends may no longer hold.
    edges = graph.edges if add else tuple(replace(t, source=tuple(x for x in t.source if x not in labels), target=tuple(x for x in t.target if x not in labels)) for t in graph.edges)
    return replace(graph, vertices=tuple(tables), edges=edges)


# --- clauses of a query ---


def apply(c, clause) -> PropertyGraph:
    """The graph after a writing clause on the compiler's bindings."""
    from arcweave.plans import tree

    if isinstance(clause, tree.Create):
        return _create(c, clause.paths)
    if isinstance(clause, tree.Merge):
        return _merge(c, clause)
    if isinstance(clause, tree.Delete):
        graph = c.graph
        for v in clause.variables:
            if c.kinds[v] == "edge":
                graph = delete_edges(graph, c.df.select(F.col(f"`{v}`").alias("eid")), c.of[v])
            else:
                graph = delete_nodes(graph, c.df.select(F.col(f"`{v}`").alias("id")), clause.detach, c.of[v])
        return graph
    if isinstance(clause, tree.Set):
        return _set_items(c, clause.items)
    if isinstance(clause, tree.Remove):
        graph = c.graph
        for item in clause.items:
            kind = c.kinds[item[1]]
            ids = c.df.select(F.col(f"`{item[1]}`").alias("id" if kind == "node" else "eid"))
            graph = change_labels(graph, ids, item[2], False, c.of[item[1]]) if item[0] == "labels" else set_property(graph, ids.withColumn("value", F.lit(None)), item[2], kind, c.of[item[1]])
        return graph
    raise TypeError(clause)


def _set_items(c, items) -> PropertyGraph:
    graph = c.graph
    for item in items:
        var = item[1]
        kind = c.kinds[var]
        key = "id" if kind == "node" else "eid"
        ids = F.col(f"`{var}`").alias(key)
        if item[0] == "prop":
            graph = set_property(graph, c.df.select(ids, c.column(item[3]).alias("value")), item[2], kind, c.of[var])
            if f"{var}__{item[2]}" in c.df.columns:
                c.df = c.df.withColumn(f"{var}__{item[2]}", c.column(item[3]))
        elif item[0] == "map":
            values = {k: c.column(v) for k, v in item[2][1].items()}
            rows = c.df.select(ids, *[v.alias(f"_p{i}") for i, v in enumerate(values.values())])
            graph = replace_properties(graph, rows, {k: F.col(f"_p{i}") for i, k in enumerate(values)}, item[3], kind, c.of[var])
        else:
            graph = change_labels(graph, c.df.select(ids), item[2], True, c.of[var])
    return graph


def _create(c, paths) -> PropertyGraph:
    graph = c.graph
    new = [n for p in paths for n in p.nodes if n.var not in c.kinds]
    new = list({n.var: n for n in reversed(new)}.values())[::-1]
    rels = [r for p in paths for r in p.rels]
    rows = c.df if c.df is not None else graph.spark.range(1).select()
    start, start_edge, width = next_id(graph), next_id(graph, "edge"), max(1, len(new))
    row = F.monotonically_increasing_id()
    # Ids are fixed before anything is derived from them.
    rows = rows.withColumn("_row", row)
    rows = checkpointed(rows.select("*", *[(F.col("_row") * width + start + i).alias(n.var) for i, n in enumerate(new)], *[(F.col("_row") * max(1, len(rels)) + start_edge + i).alias(r.var) for i, r in enumerate(rels)]))
    c.df = rows
    for n in new:
        c.kinds[n.var] = "node"
    for n in new:
        graph = graph.with_vertices(rows.select(F.col(f"`{n.var}`").alias("id"), *[c.column(v).alias(k) for k, v in n.props.items()]), *n.labels)
        for k, v in n.props.items():
            c.df = c.df.withColumn(f"{n.var}__{k}", c.column(v))
    for p in paths:
        for a, r, b in zip(p.nodes, p.rels, p.nodes[1:], strict=False):
            x, y = (b, a) if r.direction == "in" else (a, b)
            c.kinds[r.var] = "edge"
            columns = [F.col(f"`{r.var}`").alias("eid"), F.col(f"`{x.var}`").alias("src"), F.col(f"`{y.var}`").alias("dst"), *[c.column(v).alias(k) for k, v in r.props.items()]]
            graph = graph.with_edges(rows.select(*columns), r.types[0] if r.types else "")
    c.df = c.df.drop("_row")
    for n in new:
        for k in c.needs[n.var]:
            if not k.startswith("__") and f"{n.var}__{k}" not in c.df.columns:
                c.df = c.df.withColumn(f"{n.var}__{k}", F.lit(None).cast(graph.node_type(k)) if graph.node_type(k) else F.lit(None))
        if "__labels" in c.needs[n.var]:
            c.df = c.df.withColumn(f"{n.var}____labels", F.array(*[F.lit(x) for x in n.labels]))
    return graph


def _merge(c, clause) -> PropertyGraph:
    """Without anything bound: match the whole path, or create it. With bindings, per row: rows whose path is there
    match, the others create it."""
    from arcweave.plans.compiler import Compiler
    from arcweave.plans.tree import Match

    def other(df, kinds) -> Compiler:
        x = Compiler(c.graph, c.params, c.needs)
        x.df, x.kinds = df, dict(kinds)
        return x

    bound = c.df
    hit = other(bound, c.kinds)
    hit.match(Match([clause.path]))
    hit.df = checkpointed(hit.df)
    if bound is None:
        missing = None if not hit.df.isEmpty() else bound
        create = hit.df.isEmpty()
    else:
        shared = [v for v in c.kinds if c.kinds[v] != "path"]
        on = None
        seen = hit.df.select(*[F.col(f"`{s}`").alias(f"_m_{s}") for s in shared])
        for s in shared:
            e = F.col(f"`{s}`").eqNullSafe(F.col(f"`_m_{s}`"))
            on = e if on is None else on & e
        missing = checkpointed(bound.join(seen, on, "left_anti"))
        create = not missing.isEmpty()
    graph = c.graph
    parts = []
    if not hit.df.isEmpty():
        if clause.on_match:
            graph = hit.graph = _set_items(hit, clause.on_match)
        parts.append(hit)
    if create:
        made = other(missing, c.kinds)
        made.graph = graph
        graph = made.graph = _create(made, [clause.path])
        if clause.on_create:
            graph = _set_items(made, clause.on_create)
        parts.append(made)
    c.df, c.kinds = parts[0].df, parts[0].kinds
    for p in parts[1:]:
        c.df = c.df.unionByName(p.df, allowMissingColumns=True)
    return graph
