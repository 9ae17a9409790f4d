"""Algorithm queries with SQL that says the same: on the referral graph of ``queries``, and on a small graph of nations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave.algorithms import centrality, sequential, structure, traversal
from arcweave.graph import PropertyGraph
from arcweave.sources.snapshots import from_edge_list

#: Edges and nodes of the referral graph.
REFERRALS = """
e AS (SELECT o_orderkey AS eid, o_custkey AS src, CAST((o_orderkey * 31 + 7) % 997 + 1 AS BIGINT) AS dst,
             floor(o_totalprice / 1000 + 1) AS w FROM orders),
v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))"""

#: The nations: each refers to a third of its number, every fourth to another one as well.
NATIONS = """
v AS (SELECT CAST(n_nationkey AS BIGINT) AS id FROM nation),
e AS (SELECT id AS eid, id AS src, id // 3 AS dst, CAST((id * 7) % 11 + 1 AS DOUBLE) AS w FROM v WHERE id > 0
      UNION ALL SELECT id + 100, id, (id * 5 + 2) % 25, CAST((id * 3) % 5 + 1 AS DOUBLE) FROM v WHERE id % 4 = 0)"""

#: Undirected, without loops and repeats: a < b, and both ways.
PAIRS = """
p AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst),
u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)"""


def nation_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    third = n.where("id > 0").select(F.col("id").alias("eid"), F.col("id").alias("src"), F.expr("id div 3").alias("dst"), ((F.col("id") * 7) % 11 + 1).cast("double").alias("w"))
    fourth = n.where("id % 4 = 0").select((F.col("id") + 100).alias("eid"), F.col("id").alias("src"), ((F.col("id") * 5 + 2) % 25).alias("dst"), ((F.col("id") * 3) % 5 + 1).cast("double").alias("w"))
    return PropertyGraph(spark).with_vertices(n, "Nation").with_edges(third.unionByName(fourth), "REFERS", "Nation", "Nation")


def tree_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """From each third of a number down to the nation."""
    g = nation_graph(spark, sf_dir)
    e = g.edge_scan().where("eid < 100").select("eid", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return PropertyGraph(spark).with_vertices(g.node_scan(), "Nation").with_edges(e, "REFERS", "Nation", "Nation")


def forward_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Referrals, each from the smaller number to the larger: no cycles."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    other = (F.pmod(F.col("o_orderkey") * 31 + 7, F.lit(997)) + 1).cast("bigint")
    e = o.select(F.col("o_orderkey").alias("eid"), F.least("o_custkey", other).alias("src"), F.greatest("o_custkey", other).alias("dst"))
    return from_edge_list(e.where("src <> dst"))


def region_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """Regions with pipes between all of them."""
    r = spark.read.parquet(f"{sf_dir}/region.parquet").select(F.col("r_regionkey").cast("bigint").alias("id"))
    e = r.select(F.col("id").alias("src")).join(r.select(F.col("id").alias("dst")), F.col("src") != F.col("dst"))
    e = e.select((F.col("src") * 10 + F.col("dst")).alias("eid"), "src", "dst", ((F.col("src") * 3 + F.col("dst") * 5) % 7).cast("double").alias("capacity"), ((F.col("src") + F.col("dst")) % 3).cast("double").alias("cost"))
    return PropertyGraph(spark).with_vertices(r, "Region").with_edges(e, "PIPE", "Region", "Region")


def _h_index_sql(rounds: int = 40) -> str:
    """Core numbers: start with degrees, and let each node have the largest h of which h neighbours have h or more, until
    nothing changes (it has settled long before the last round)."""
    parts = [f"WITH {REFERRALS}, {PAIRS}, h0 AS (SELECT a AS id, count(*) AS h FROM u GROUP BY 1)"]
    for i in range(1, rounds + 1):
        ranked = f"SELECT a, h, row_number() OVER (PARTITION BY a ORDER BY h DESC) AS k FROM u JOIN h{i - 1} ON u.b = h{i - 1}.id"
        parts.append(f"h{i} AS MATERIALIZED (SELECT a AS id, count(*) FILTER (WHERE h >= k) AS h FROM ({ranked}) GROUP BY 1)")
    parts.append(f"cores AS (SELECT v.id, CAST(coalesce(h, 0) AS INTEGER) AS core FROM v LEFT JOIN h{rounds} USING (id))")
    return ", ".join(parts)


def _labels_sql(rounds: int) -> str:
    parts = [f"WITH {REFERRALS}, m AS (SELECT src AS a, dst AS b FROM e WHERE src <> dst UNION ALL SELECT dst, src FROM e WHERE src <> dst), l0 AS (SELECT id, id AS l FROM v)"]
    for i in range(1, rounds + 1):
        votes = f"SELECT a, l, row_number() OVER (PARTITION BY a ORDER BY count(*) DESC, l) AS k FROM m JOIN l{i - 1} ON b = id GROUP BY a, l"
        parts.append(f"l{i} AS MATERIALIZED (SELECT o.id, coalesce(n.l, o.l) AS l FROM l{i - 1} o LEFT JOIN ({votes}) n ON o.id = n.a AND n.k = 1)")
    return ", ".join(parts) + f" SELECT id, l AS community FROM l{rounds}"


_TRIANGLES = f"""WITH {REFERRALS}, {PAIRS},
t AS (SELECT x.a AS x, x.b AS y, y.b AS z FROM p x JOIN p y ON x.b = y.a JOIN p w ON w.a = x.a AND w.b = y.b)"""

_ALL_PAIRS = f"""WITH RECURSIVE {NATIONS},
t AS (SELECT id AS src, id AS dst, 0::DOUBLE AS distance FROM v
      UNION SELECT t.src, e.dst, t.distance + e.w FROM t JOIN e ON t.dst = e.src WHERE t.distance + e.w <= 80)"""

_HOPS = f"""WITH RECURSIVE {NATIONS},
w AS (SELECT id AS s, id AS t, 0 AS d, CAST(1 AS BIGINT) AS n FROM v
      UNION ALL SELECT w.s, e.dst, any_value(w.d) + 1, CAST(sum(w.n) AS BIGINT) FROM w JOIN e ON w.t = e.src WHERE w.d < 10 GROUP BY w.s, e.dst),
h AS (SELECT s, t, min(d) AS d, arg_min(n, d) AS n FROM w GROUP BY 1, 2)"""

_BEST = f"""WITH RECURSIVE {NATIONS},
m AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, min(w) AS w FROM e WHERE src <> dst GROUP BY 1, 2),
s AS (SELECT a, b, w FROM m UNION ALL SELECT b, a, w FROM m),
r AS (SELECT a, b, w, a AS id FROM m
      UNION SELECT r.a, r.b, r.w, s.b FROM r JOIN s ON r.id = s.a
      WHERE (s.w, least(s.a, s.b), greatest(s.a, s.b)) < (r.w, r.a, r.b))
SELECT a AS src, b AS dst, w FROM m WHERE NOT EXISTS (SELECT 1 FROM r WHERE (r.a, r.b) = (m.a, m.b) AND r.id = m.b)"""


def queries(referral_graph: Callable[[SparkSession, str], PropertyGraph]) -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    r, n = referral_graph, nation_graph
    one = lambda s, **values: s.createDataFrame([tuple(values.values())], list(values))

    def layers(s, d):
        found = traversal.bfs_layers(r(s, d), 1)
        return found.select("depth", F.size("nodes").cast("bigint").alias("n"), F.aggregate("nodes", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"), F.array_min("nodes").alias("least"))

    def bellman_ford(s, d):
        found, negative = traversal.bellman_ford(n(s, d), 24, "w")
        return found.select("id", "distance", F.lit(negative).alias("negative"))

    def dfs(s, d):
        return s.createDataFrame(list(enumerate(traversal.dfs(tree_graph(s, d), 0))), "place long, id long")

    def by_third(g):
        return structure.nodes_of(g).select("id", (F.col("id") % 3).alias("community"))

    def min_cost(s, d):
        flow, cost = sequential.min_cost_max_flow(region_graph(s, d), 0, 4, "capacity", "cost")
        return one(s, flow=flow, cost=cost)

    return {
        "algo_bfs_layers": (
            layers,
            f"""WITH RECURSIVE {REFERRALS},
            t AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth WHERE 1 IN (SELECT id FROM v) UNION SELECT dst, depth + 1 FROM t JOIN e ON src = id WHERE depth < 12),
            f AS (SELECT id, min(depth) AS depth FROM t GROUP BY 1)
            SELECT depth, count(*) AS n, CAST(sum(id) AS BIGINT) AS total, min(id) AS least FROM f GROUP BY 1""",
        ),
        "algo_topological_levels": (
            lambda s, d: traversal.topological_levels(forward_graph(s, d)),
            f"""WITH RECURSIVE {REFERRALS},
            f AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst),
            t AS (SELECT DISTINCT id, 0 AS level FROM (SELECT a AS id FROM f UNION ALL SELECT b FROM f) UNION SELECT b, level + 1 FROM t JOIN f ON a = id)
            SELECT id, max(level) AS level FROM t GROUP BY 1""",
        ),
        "algo_all_pairs": (lambda s, d: traversal.floyd_warshall(n(s, d), "w"), _ALL_PAIRS + " SELECT src, dst, min(distance) AS distance FROM t GROUP BY 1, 2"),
        "algo_bellman_ford": (bellman_ford, _ALL_PAIRS + " SELECT dst AS id, min(distance) AS distance, false AS negative FROM t WHERE src = 24 GROUP BY 1"),
        "algo_astar": (
            lambda s, d: one(s, distance=traversal.astar(n(s, d), 24, 0, "w")[0]),
            _ALL_PAIRS + " SELECT min(distance) AS distance FROM t WHERE src = 24 AND dst = 0",
        ),
        "algo_dfs": (
            dfs,
            f"""WITH RECURSIVE {NATIONS},
            t AS (SELECT id, [id] AS path FROM v WHERE id = 0 UNION ALL SELECT v.id, list_append(path, v.id) FROM t JOIN v ON v.id // 3 = t.id AND v.id > 0)
            SELECT row_number() OVER (ORDER BY list_append(path, 1000)) - 1 AS place, id FROM t""",
        ),
        "algo_betweenness": (
            lambda s, d: centrality.betweenness_centrality(n(s, d), normalized=False).select("id", F.round("betweenness", 9).alias("betweenness")),
            _HOPS
            + """, b AS (SELECT x.t AS id, sum(x.n * y.n / CAST(z.n AS DOUBLE)) AS b FROM h x JOIN h y ON x.t = y.s JOIN h z ON z.s = x.s AND z.t = y.t AND z.d = x.d + y.d
                 WHERE x.d > 0 AND y.d > 0 GROUP BY 1)
            SELECT id, round(coalesce(b, 0::DOUBLE), 9) AS betweenness FROM v LEFT JOIN b USING (id)""",
        ),
        "algo_closeness": (
            lambda s, d: centrality.closeness_centrality(r(s, d)).select("id", F.round("closeness", 9).alias("closeness")),
            f"""WITH RECURSIVE {REFERRALS}, s AS (SELECT DISTINCT src, dst FROM e),
            t(s, id, d) USING KEY (s, id) AS (
                SELECT id, id, 0 FROM v
                UNION SELECT t.s, s.dst, t.d + 1 FROM t JOIN s ON t.id = s.src LEFT JOIN recurring.t o ON o.s = t.s AND o.id = s.dst WHERE o.s IS NULL)
            SELECT s AS id, round(CASE WHEN sum(d) > 0 THEN CAST(count(*) - 1 AS DOUBLE) / sum(d) ELSE 0::DOUBLE END, 9) AS closeness FROM t GROUP BY 1""",
        ),
        "algo_closeness_nations": (
            lambda s, d: centrality.closeness_centrality(n(s, d)).select("id", F.round("closeness", 9).alias("closeness")),
            _HOPS + " SELECT s AS id, round(CASE WHEN sum(d) > 0 THEN CAST(count(*) - 1 AS DOUBLE) / sum(d) ELSE 0::DOUBLE END, 9) AS closeness FROM h GROUP BY 1",
        ),
        "algo_closeness_wf": (
            lambda s, d: centrality.closeness_centrality(n(s, d), wf=True).select("id", F.round("closeness", 9).alias("closeness")),
            _HOPS + " SELECT s AS id, round(CASE WHEN sum(d) > 0 THEN CAST(count(*) - 1 AS DOUBLE) / sum(d) * (count(*) - 1) / 24 ELSE 0::DOUBLE END, 9) AS closeness FROM h GROUP BY 1",
        ),
        "algo_degrees_normalized": (
            lambda s, d: centrality.degree_centrality(n(s, d), normalized=True).select("id", F.round("degree", 9).alias("degree")),
            f"WITH {NATIONS} SELECT id, round((SELECT count(*) FROM e WHERE src = id) / 24::DOUBLE + (SELECT count(*) FROM e WHERE dst = id) / 24::DOUBLE, 9) AS degree FROM v",
        ),
        "algo_bridges": (
            lambda s, d: sequential.bridges(n(s, d)),
            f"""WITH RECURSIVE {NATIONS}, {PAIRS},
            t AS (SELECT a AS x, b AS y, a AS id FROM p UNION SELECT x, y, u.b FROM t JOIN u ON id = u.a WHERE (least(u.a, u.b), greatest(u.a, u.b)) <> (x, y))
            SELECT a AS src, b AS dst FROM p WHERE NOT EXISTS (SELECT 1 FROM t WHERE x = a AND y = b AND id = b)""",
        ),
        "algo_articulation_points": (
            lambda s, d: sequential.articulation_points(r(s, d)),
            f"""WITH RECURSIVE {REFERRALS}, {PAIRS},
            t AS (SELECT a AS x, min(b) AS id FROM u GROUP BY 1 UNION SELECT x, b FROM t JOIN u ON id = a WHERE b <> x)
            SELECT DISTINCT u.a AS id FROM u WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.x = u.a AND t.id = u.b)""",
        ),
        "algo_spanning_tree": (lambda s, d: structure.kruskal(n(s, d), "w"), _BEST),
        "algo_prim": (lambda s, d: structure.prim(n(s, d), 0, "w"), _BEST),
        "algo_core_numbers": (lambda s, d: structure.core_numbers(r(s, d)), _h_index_sql() + " SELECT id, core FROM cores"),
        "algo_k_core": (lambda s, d: structure.k_core(r(s, d), 12), _h_index_sql() + " SELECT id FROM cores WHERE core >= 12"),
        "algo_total_triangles": (lambda s, d: one(s, n=structure.total_triangles(r(s, d))), _TRIANGLES + " SELECT count(*) AS n FROM t"),
        "algo_global_clustering": (
            lambda s, d: one(s, c=round(structure.global_clustering(r(s, d)), 9)),
            _TRIANGLES
            + """, c AS (SELECT id, count(*) AS t FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY 1),
            k AS (SELECT a AS id, count(*) AS k FROM u GROUP BY 1)
            SELECT round(avg(CASE WHEN coalesce(k, 0) < 2 THEN 0::DOUBLE ELSE 2::DOUBLE * coalesce(t, 0) / (k * (k - 1)) END), 9) AS c FROM v LEFT JOIN c USING (id) LEFT JOIN k USING (id)""",
        ),
        "algo_label_propagation": (lambda s, d: structure.label_propagation(r(s, d)), None),
        "algo_label_propagation_rounds": (lambda s, d: structure.label_propagation(r(s, d), 3), _labels_sql(3)),
        "algo_louvain": (lambda s, d: sequential.louvain(r(s, d)), None),
        "algo_modularity": (
            lambda s, d: one(s, q=round(structure.modularity(r(s, d), by_third(r(s, d))), 9)),
            f"""WITH {REFERRALS}, l AS (SELECT src % 3 AS x, dst % 3 AS y FROM e WHERE src <> dst), m AS (SELECT count(*) AS m FROM l),
            k AS (SELECT c, count(*) AS k FROM (SELECT x AS c FROM l UNION ALL SELECT y FROM l) GROUP BY 1)
            SELECT round((SELECT count(*) FROM l WHERE x = y) / m::DOUBLE - (SELECT sum(k * k) FROM k) / (4::DOUBLE * m * m), 9) AS q FROM m""",
        ),
        "algo_max_flow": (  # the smallest cut of the 2**5 sides
            lambda s, d: one(s, flow=sequential.max_flow(region_graph(s, d), 0, 4, "capacity")),
            """WITH e AS (SELECT a.r_regionkey AS src, b.r_regionkey AS dst, CAST((a.r_regionkey * 3 + b.r_regionkey * 5) % 7 AS DOUBLE) AS c
                       FROM region a JOIN region b ON a.r_regionkey <> b.r_regionkey),
            cut AS (SELECT side, sum(CASE WHEN (side >> src) & 1 = 1 AND (side >> dst) & 1 = 0 THEN c ELSE 0 END) AS c FROM range(32) t(side), e
                    WHERE side & 1 = 1 AND side & 16 = 0 GROUP BY 1)
            SELECT min(c) AS flow FROM cut""",
        ),
        "algo_min_cost_flow": (min_cost, None),
    }
