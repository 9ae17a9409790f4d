"""Property graphs as declared views over DataFrames: nothing is copied, and a scan reads what a query names."""

from __future__ import annotations

from collections.abc import Collection, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.cluster import checkpointed, partitions_for


@dataclass(frozen=True)
class VertexTable:
    """Rows with ``id`` (BIGINT, unique in the graph) and properties. All carry ``labels``; if ``labels`` is None the
    table has its own column ``labels`` (ARRAY<STRING>)."""

    df: DataFrame
    labels: tuple[str, ...] | None

    @property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in ("id", "labels")}


@dataclass(frozen=True)
class EdgeTable:
    """Rows with ``src``, ``dst``, an ``eid`` unique in the graph, and properties. ``type`` None: a column ``type``.

    source and target name labels that all its ends carry, so that expanding needs no look at the vertex table.
    """

    df: DataFrame
    type: str | None
    source: tuple[str, ...] = ()
    target: tuple[str, ...] = ()

    @property
    def properties(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.df.schema.fields if f.name not in ("eid", "src", "dst", "type")}


def _null(kind: T.DataType | None) -> Column:
    return F.lit(None).cast(kind) if kind is not None else F.lit(None)


@dataclass(frozen=True)
class PropertyGraph:
    spark: SparkSession
    vertices: tuple[VertexTable, ...] = ()
    edges: tuple[EdgeTable, ...] = ()
    constraints: tuple = field(default=())

    # --- building ---

    @staticmethod
    def from_frames(nodes: DataFrame, edges: DataFrame) -> PropertyGraph:
        """nodes(id, labels, ...) and edges([eid,] src, dst, type, ...)."""
        if "eid" not in edges.columns:
            edges = edges.withColumn("eid", F.xxhash64(*edges.columns))
        return PropertyGraph(nodes.sparkSession, (VertexTable(nodes, None),), (EdgeTable(edges, None),))

    def with_vertices(self, df: DataFrame, *labels: str) -> PropertyGraph:
        return replace(self, vertices=(*self.vertices, VertexTable(df, tuple(labels) or None)))

    def with_edges(self, df: DataFrame, type: str | None, source: str | tuple = (), target: str | tuple = ()) -> PropertyGraph:
        pack = lambda x: (x,) if isinstance(x, str) else tuple(x)
        return replace(self, edges=(*self.edges, EdgeTable(df, type, pack(source), pack(target))))

    # --- scans ---

    def node_type(self, name: str) -> T.DataType | None:
        return next((p[name] for t in self.vertices if name in (p := t.properties)), None)

    def edge_type(self, name: str) -> T.DataType | None:
        return next((p[name] for t in self.edges if name in (p := t.properties)), None)

    def node_scan(self, labels: Iterable[str] = (), properties: Iterable[str] | None = None, with_labels: bool = False) -> DataFrame:
        """id, the named properties (None: all; missing ones null) and, if asked for, labels, of nodes that carry all labels."""
        labels = tuple(labels)
        names = list(dict.fromkeys(p for t in self.vertices for p in t.properties)) if properties is None else list(properties)
        parts = []
        for t in self.vertices:
            if t.labels is not None and not set(labels) <= set(t.labels):
                continue
            df = t.df if t.labels is not None else t.df.where(_all(F.array_contains("labels", x) for x in labels)) if labels else t.df
            have = t.properties
            columns = [F.col("id").cast("bigint").alias("id"), *(F.col(f"`{p}`") if p in have else _null(self.node_type(p)).alias(p) for p in names)]
            if with_labels:
                columns.append(F.col("labels") if t.labels is None else F.array(*[F.lit(x) for x in t.labels]).alias("labels"))
            parts.append(df.select(*columns))
        if not parts:
            schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(p, self.node_type(p) or T.NullType()) for p in names)])
            if with_labels:
                schema = schema.add("labels", T.ArrayType(T.StringType()))
            return self.spark.createDataFrame([], schema)
        return _union(parts)

    def edge_scan(self, types: Iterable[str] = (), properties: Iterable[str] | None = (), with_type: bool = False, tables: Collection[EdgeTable] | None = None) -> DataFrame:
        """eid, src, dst, the named properties (None: all) and, if asked for, type; types match whatever their case.
        tables: those to look into, all by default."""
        wanted = {t.lower() for t in types}
        names = list(dict.fromkeys(p for t in self.edges for p in t.properties)) if properties is None else list(properties)
        parts = []
        for t in self.edge_tables(wanted):
            if tables is not None and not any(t is x for x in tables):
                continue
            df = t.df if t.type is not None or not wanted else t.df.where(F.lower("type").isin(*sorted(wanted)))
            have = t.properties
            columns = [F.col("eid").cast("bigint").alias("eid"), F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst")]
            columns += [F.col(f"`{p}`") if p in have else _null(self.edge_type(p)).alias(p) for p in names]
            if with_type:
                columns.append(F.col("type") if t.type is None else F.lit(t.type).alias("type"))
            parts.append(df.select(*columns))
        if not parts:
            fields = [T.StructField(c, T.LongType()) for c in ("eid", "src", "dst")] + [T.StructField(p, self.edge_type(p) or T.NullType()) for p in names]
            return self.spark.createDataFrame([], T.StructType(fields + [T.StructField("type", T.StringType())] * with_type))
        return _union(parts)

    def edge_tables(self, wanted: set[str]) -> list[EdgeTable]:
        return [t for t in self.edges if not wanted or t.type is None or t.type.lower() in wanted]

    def step_from(self, vertices: Collection[VertexTable], types: Iterable[str], direction: str) -> tuple[list[EdgeTable], list[VertexTable]]:
        """The edge tables that a step from nodes of these tables can use, and the tables of the nodes it can reach."""
        can = lambda labels, v: v.labels is None or set(labels) <= set(v.labels)
        used, reached = [], []
        for t in self.edge_tables({x.lower() for x in types}):
            for near, far in ((t.source, t.target), (t.target, t.source)):
                if direction != "both" and (near is t.source) != (direction == "out"):
                    continue
                if any(can(near, v) for v in vertices):
                    used.append(t)
                    reached += [v for v in self.vertices if can(far, v)]
        return used, [v for v in self.vertices if any(v is x for x in reached)]

    def end_labels(self, types: Iterable[str], end: str) -> set[str]:
        """Labels that each end ("source" or "target") of edges of these types is declared to carry."""
        tables = self.edge_tables({t.lower() for t in types})
        return set.intersection(*(set(getattr(t, end)) for t in tables)) if tables else set()

    # --- lookups, statistics and checks ---

    def nodes_by_id(self, ids: list[int]) -> DataFrame:
        return self.node_scan(with_labels=True).where(F.col("id").isin(ids))

    def edges_by_id(self, ids: list[int]) -> DataFrame:
        return self.edge_scan(properties=None, with_type=True).where(F.col("eid").isin(ids))

    def nodes_by_property(self, name: str, value, labels: Iterable[str] = ()) -> DataFrame:
        return self.node_scan(labels).where(F.col(f"`{name}`") == F.lit(value))

    def nodes_in_range(self, name: str, low=None, high=None, include_low: bool = True, include_high: bool = True, labels: Iterable[str] = ()) -> DataFrame:
        df, c = self.node_scan(labels), F.col(f"`{name}`")
        if low is not None:
            df = df.where(c >= F.lit(low) if include_low else c > F.lit(low))
        if high is not None:
            df = df.where(c <= F.lit(high) if include_high else c < F.lit(high))
        return df

    def vector_search(self, label: str, name: str, query, k: int, metric: str = "cosine", where: Column | None = None, **limits) -> DataFrame:
        """id, distance: the k nodes of a label whose vector property is closest; where: a condition on their properties."""
        from arcweave import vectors

        df = self.node_scan((label,))
        return vectors.search(df if where is None else df.where(where), query, k, name, "id", metric, **limits)

    def neighbors(self, ids: list[int], direction: str = "out", types: Iterable[str] = ()) -> DataFrame:
        """id, neighbor, eid."""
        e = oriented(self.edge_scan(types), direction)
        return e.where(F.col("a").isin(ids)).select(F.col("a").alias("id"), F.col("b").alias("neighbor"), "eid")

    def degrees(self, types: Iterable[str] = ()) -> DataFrame:
        """id, out_degree, in_degree, degree of every node, from one pass over the edges."""
        e = self.edge_scan(types)
        ends = e.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
        count = ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
        o, i = (F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in "oi")
        return self.node_scan(properties=()).join(count, "id", "left").select("id", o.alias("out_degree"), i.alias("in_degree"), (o + i).alias("degree"))

    def label_counts(self) -> DataFrame:
        return self.node_scan(properties=(), with_labels=True).select(F.explode("labels").alias("label")).groupBy("label").count()

    def type_counts(self) -> DataFrame:
        return self.edge_scan(with_type=True).groupBy("type").count()

    def info(self) -> dict[str, int]:
        return {"nodes": self.node_scan(properties=()).count(), "edges": self.edge_scan().count(), "vertex_tables": len(self.vertices), "edge_tables": len(self.edges)}

    def schema(self) -> dict[str, dict[str, dict[str, str]]]:
        nodes = {":".join(t.labels or ("*",)): {k: v.simpleString() for k, v in t.properties.items()} for t in self.vertices}
        edges = {t.type or "*": {k: v.simpleString() for k, v in t.properties.items()} for t in self.edges}
        return {"nodes": nodes, "edges": edges}

    def dangling_edges(self) -> DataFrame:
        """Edges with an end that no node has: eid, src, dst.

        Each end is looked up once, and only the ends without a node are joined to the edges. The number of
        partitions grows with the edges, so that a task's share doesn't."""
        ids, e = self.node_scan(properties=()).select("id"), self.edge_scan().select("eid", "src", "dst")
        ends = e.select(F.explode(F.array("src", "dst")).alias("id"))
        n = partitions_for(self.spark, 2 * e.count())
        lost = ends.repartition(n, "id").distinct().join(ids.repartition(n, "id").hint("merge"), "id", "left_anti")
        lost = checkpointed(lost)
        if lost.isEmpty():
            return e.limit(0)
        found = e.join(lost, e.src.eqNullSafe(lost.id), "left_semi").unionByName(e.join(lost, e.dst.eqNullSafe(lost.id), "left_semi"))
        return found.distinct()

    def duplicate_ids(self) -> DataFrame:
        return self.node_scan(properties=()).groupBy("id").count().where("count > 1")

    # --- languages ---

    def cypher(self, text: str, **params) -> DataFrame:
        from arcweave.languages.cypher import execute

        return execute(self, text, params).rows

    gql = cypher

    def execute(self, text: str, **params):
        """Rows and graph after a GQL or Cypher text that may write: a Result(rows, graph)."""
        from arcweave.languages.cypher import execute

        return execute(self, text, params)

    def gremlin(self, text: str) -> DataFrame:
        from arcweave.languages.gremlin import execute

        return execute(self, text).rows

    def graphql(self, text: str, **variables) -> DataFrame:
        from arcweave.languages.graphql import execute

        return execute(self, text, variables).rows


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as steps a -> b: out, in, or both (each edge both ways; a self-loop comes twice)."""
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    out = edges.select(F.col("src").alias("a"), F.col("dst").alias("b"), *rest)
    back = edges.select(F.col("dst").alias("a"), F.col("src").alias("b"), *rest)
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _all(conditions: Iterable[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out
