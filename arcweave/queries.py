"""The registered queries: each operator on a graph declared over the star-schema tables, with SQL that says the same."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arcweave import queries_algorithms, rdf, vectors
from arcweave.algorithms import centrality, structure, traversal
from arcweave.cluster import new_folder
from arcweave.graph import PropertyGraph
from arcweave.sources import snapshots
from arcweave.sources.snapshots import from_edge_list

_STEP = 1 << 40
_CODES = {"customer": 0, "supplier": 1, "part": 2, "orders": 3, "nation": 4, "region": 5}


_declared: dict[tuple, tuple[SparkSession, object]] = {}


def _once(declare: Callable) -> Callable:
    """A graph is declared once for a session and folder, as a user would; queries then only plan and run."""

    @functools.wraps(declare)
    def of(spark: SparkSession, sf_dir: str):
        key = (spark.sparkContext.applicationId, sf_dir, declare.__name__)
        if key not in _declared or _declared[key][0] is not spark:
            _declared[key] = spark, declare(spark, sf_dir)
        return _declared[key][1]

    return of


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(name: str, column: str):
    return (F.col(column).cast("bigint") + F.lit(_CODES[name] * _STEP)).cast("bigint")


@_once
def tpch_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """(Customer)-[PLACED]->(Order)-[CONTAINS]->(Part), (Order)-[SHIPPED_BY]->(Supplier), (Customer|Supplier)-[LOCATED_IN]->
    (Nation)-[IN_REGION]->(Region); ids are keys with a code for the table."""
    t = lambda name: _table(spark, sf_dir, name)
    g = PropertyGraph(spark)
    for name, label, prefix, key in (
        ("customer", "Customer", "c_", "c_custkey"),
        ("supplier", "Supplier", "s_", "s_suppkey"),
        ("part", "Part", "p_", "p_partkey"),
        ("orders", "Order", "o_", "o_orderkey"),
        ("nation", "Nation", "n_", "n_nationkey"),
        ("region", "Region", "r_", "r_regionkey"),
    ):
        df = t(name)
        props = [F.col(c).alias(c.removeprefix(prefix)) for c in df.columns if c != key]
        g = g.with_vertices(df.select(_id(name, key).alias("id"), F.col(key).cast("bigint").alias("key"), *props), label)
    line = t("lineitem")
    eid = lambda code, c: (F.lit(code) * _STEP + c.cast("bigint")).alias("eid")
    number = lambda code: F.xxhash64(F.lit(code), *line.columns).alias("eid")
    return (
        g.with_edges(t("orders").select(eid(0, F.col("o_orderkey")), _id("customer", "o_custkey").alias("src"), _id("orders", "o_orderkey").alias("dst")), "PLACED", "Customer", "Order")
        .with_edges(
            line.select(number(1), _id("orders", "l_orderkey").alias("src"), _id("part", "l_partkey").alias("dst"), *[F.col(c).alias(c[2:]) for c in line.columns if c not in ("l_orderkey", "l_partkey", "l_suppkey")]),
            "CONTAINS",
            "Order",
            "Part",
        )
        .with_edges(line.select(number(2), _id("orders", "l_orderkey").alias("src"), _id("supplier", "l_suppkey").alias("dst"), F.col("l_quantity").alias("quantity")), "SHIPPED_BY", "Order", "Supplier")
        .with_edges(t("customer").select(eid(3, F.col("c_custkey")), _id("customer", "c_custkey").alias("src"), _id("nation", "c_nationkey").alias("dst")), "LOCATED_IN", "Customer", "Nation")
        .with_edges(t("supplier").select(eid(4, F.col("s_suppkey")), _id("supplier", "s_suppkey").alias("src"), _id("nation", "s_nationkey").alias("dst")), "LOCATED_IN", "Supplier", "Nation")
        .with_edges(t("nation").select(eid(5, F.col("n_nationkey")), _id("nation", "n_nationkey").alias("src"), _id("region", "n_regionkey").alias("dst")), "IN_REGION", "Nation", "Region")
    )


@_once
def referral_graph(spark: SparkSession, sf_dir: str) -> PropertyGraph:
    """A graph without parts: each order refers its customer to another one that its key names."""
    o = _table(spark, sf_dir, "orders")
    e = o.select(F.col("o_orderkey").alias("eid"), F.col("o_custkey").alias("src"), (F.pmod(F.col("o_orderkey") * 31 + 7, F.lit(997)) + 1).cast("bigint").alias("dst"), F.floor(F.col("o_totalprice") / 1000 + 1).cast("double").alias("w"))
    return from_edge_list(e)


#: The same edges, for the SQL of algorithm queries.
_E = "e AS (SELECT o_orderkey AS eid, o_custkey AS src, CAST((o_orderkey * 31 + 7) % 997 + 1 AS BIGINT) AS dst, floor(o_totalprice / 1000 + 1) AS w FROM orders), v AS (SELECT DISTINCT id FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e))"


@_once
def triples(spark: SparkSession, sf_dir: str) -> rdf.TripleStore:
    """nation, region and customer as triples under http://ex/."""
    i = lambda kind, c: rdf.iri_column(F.concat(F.lit(f"http://ex/{kind}/"), F.col(c).cast("string")))
    p = lambda name: rdf.term_column(rdf.iri(f"http://ex/{name}")).alias("p")
    t = lambda name: _table(spark, sf_dir, name)
    lit = rdf.literal_column
    number = rdf.XSD + "double"
    rows = [
        t("region").select(i("region", "r_regionkey").alias("s"), p("name"), lit(F.col("r_name")).alias("o")),
        t("nation").select(i("nation", "n_nationkey").alias("s"), p("name"), lit(F.col("n_name")).alias("o")),
        t("nation").select(i("nation", "n_nationkey").alias("s"), p("region"), i("region", "n_regionkey").alias("o")),
        t("customer").select(i("customer", "c_custkey").alias("s"), p("name"), lit(F.col("c_name")).alias("o")),
        t("customer").select(i("customer", "c_custkey").alias("s"), p("nation"), i("nation", "c_nationkey").alias("o")),
        t("customer").select(i("customer", "c_custkey").alias("s"), p("balance"), lit(F.col("c_acctbal"), number).alias("o")),
        t("customer").where("c_mktsegment = 'BUILDING'").select(i("customer", "c_custkey").alias("s"), p("segment"), lit(F.col("c_mktsegment")).alias("o")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return rdf.TripleStore(out.withColumn("g", F.lit(None).cast("string")))


_CYPHER: dict[str, tuple[str, str]] = {
    "scan_all_nodes": (
        "MATCH (n) RETURN count(*) AS n",
        "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + "
        "(SELECT count(*) FROM nation) + (SELECT count(*) FROM region) AS n",
    ),
    "scan_label": (
        "MATCH (c:Customer) RETURN c.key AS key, c.name AS name, c.acctbal AS acctbal",
        "SELECT c_custkey AS key, c_name AS name, c_acctbal AS acctbal FROM customer",
    ),
    "scan_edges": (
        "MATCH ()-[r]->() RETURN type(r) AS type, count(*) AS n",
        "SELECT 'PLACED' AS type, count(*) AS n FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SHIPPED_BY', "
        "count(*) FROM lineitem UNION ALL SELECT 'LOCATED_IN', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT "
        "'IN_REGION', count(*) FROM nation",
    ),
    "property_lookup": (
        "MATCH (c:Customer {mktsegment: 'BUILDING'}) WHERE c.acctbal > 9000 RETURN c.key AS key",
        "SELECT c_custkey AS key FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 9000",
    ),
    "range_lookup": (
        "MATCH (p:Part) WHERE p.size >= 10 AND p.size <= 12 RETURN p.key AS key, p.size AS size",
        "SELECT p_partkey AS key, p_size AS size FROM part WHERE p_size BETWEEN 10 AND 12",
    ),
    "boolean_operators": (
        "MATCH (p:Part) WHERE (p.size < 5 XOR p.retailprice > 1200) AND NOT p.size = 1 OR p.size = 50 RETURN p.key AS key",
        "SELECT p_partkey AS key FROM part WHERE ((p_size < 5) <> (p_retailprice > 1200)) AND NOT p_size = 1 OR p_size = 50",
    ),
    "null_tests": (
        "MATCH (n) WHERE n.acctbal IS NOT NULL AND n.mktsegment IS NULL RETURN count(*) AS n",
        "SELECT count(*) AS n FROM supplier WHERE s_acctbal IS NOT NULL",
    ),
    "in_list": (
        "MATCH (c:Customer) WHERE c.mktsegment IN ['BUILDING', 'MACHINERY'] RETURN c.key AS key",
        "SELECT c_custkey AS key FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    ),
    "string_predicates": (
        "MATCH (p:Part) WHERE p.type STARTS WITH 'P' OR p.type ENDS WITH 'L' OR p.name CONTAINS 'a' RETURN p.key AS key",
        "SELECT p_partkey AS key FROM part WHERE starts_with(p_type, 'P') OR ends_with(p_type, 'L') OR contains(p_name, 'a')",
    ),
    "regex_and_like": (
        "MATCH (p:Part) WHERE p.brand =~ '[1-3]$' AND p.name LIKE '%ing' RETURN p.key AS key",
        "SELECT p_partkey AS key FROM part WHERE regexp_matches(p_brand, '[1-3]$') AND p_name LIKE '%ing'",
    ),
    "regex_invalid": (
        "MATCH (p:Part) WHERE p.size = 50 RETURN p.brand =~ '(' AS hit, count(*) AS n",
        "SELECT CAST(NULL AS BOOLEAN) AS hit, count(*) AS n FROM part WHERE p_size = 50",
    ),
    "sum_of_nothing": (
        "MATCH (p:Part) WHERE p.size > 999 RETURN sum(p.size) AS s, sum(p.retailprice) AS r, count(*) AS n",
        "SELECT CAST(0 AS BIGINT) AS s, 0::DOUBLE AS r, CAST(0 AS BIGINT) AS n",
    ),
    "case_expression": (
        "MATCH (o:Order) RETURN CASE WHEN o.totalprice > 200000 THEN 'high' WHEN o.totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE "
        "o.orderstatus WHEN 'F' THEN 1 ELSE 0 END AS f, count(*) AS n",
        "SELECT CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'low' END AS band, CASE o_orderstatus WHEN 'F' "
        "THEN 1 ELSE 0 END AS f, count(*) AS n FROM orders GROUP BY 1, 2",
    ),
    "expand": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN c.name AS name, o.key AS okey",
        "SELECT c_name AS name, o_orderkey AS okey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000",
    ),
    "expand_in": (
        "MATCH (n:Nation)<-[:LOCATED_IN]-(s:Supplier) RETURN n.name AS nation, count(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM nation JOIN supplier ON n_nationkey = s_nationkey GROUP BY 1",
    ),
    "expand_both": (
        "MATCH (n:Nation)-[]-(x) RETURN n.name AS nation, count(*) AS n",
        "SELECT n_name AS nation, 1 + (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE "
        "s_nationkey = n_nationkey) AS n FROM nation",
    ),
    "edge_types": (
        "MATCH (o:Order)-[r:CONTAINS|SHIPPED_BY]->(x) RETURN type(r) AS type, sum(r.quantity) AS q",
        "SELECT type, sum(l_quantity) AS q FROM lineitem, (VALUES ('CONTAINS'), ('SHIPPED_BY')) t(type) GROUP BY 1",
    ),
    "edge_properties": (
        "MATCH (o:Order)-[r:CONTAINS {returnflag: 'R'}]->(p:Part) WHERE r.quantity >= 45 RETURN o.key AS okey, p.key AS pkey, r.quantity AS q",
        "SELECT l_orderkey AS okey, l_partkey AS pkey, l_quantity AS q FROM lineitem WHERE l_returnflag = 'R' AND l_quantity >= 45",
    ),
    "chain_of_hops": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation)<-[:LOCATED_IN]-(c:Customer)-[:PLACED]->(o:Order) RETURN r.name AS region, count(*) AS n, "
        "round(sum(o.totalprice) / 1000) AS total",
        "SELECT r_name AS region, count(*) AS n, round(sum(o_totalprice) / 1000) AS total FROM region JOIN nation ON r_regionkey = n_regionkey JOIN "
        "customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    ),
    "shared_variables": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order), (o)-[:SHIPPED_BY]->(s:Supplier), (c)-[:LOCATED_IN]->(n:Nation), (s)-[:LOCATED_IN]->(n) RETURN "
        "n.name AS nation, count(*) AS n",
        "SELECT n_name AS nation, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN "
        "supplier ON l_suppkey = s_suppkey JOIN nation ON n_nationkey = c_nationkey AND n_nationkey = s_nationkey GROUP BY 1",
    ),
    "cross_product": ("MATCH (a:Region), (b:Nation) RETURN a.name AS region, b.name AS nation", "SELECT r_name AS region, n_name AS nation FROM region, nation"),
    "variable_length": (
        "MATCH (c:Customer)-[*1..2]->(x) RETURN labels(x)[0] AS label, count(*) AS n",
        "SELECT label, CAST(n AS BIGINT) AS n FROM (SELECT 'Order' AS label, (SELECT count(*) FROM orders) AS n UNION ALL SELECT 'Nation', (SELECT "
        "count(*) FROM customer) UNION ALL SELECT 'Region', (SELECT count(*) FROM customer) UNION ALL SELECT 'Part', (SELECT count(*) FROM lineitem) "
        "UNION ALL SELECT 'Supplier', (SELECT count(*) FROM lineitem))",
    ),
    "optional_match": (
        "MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 250000 RETURN c.key AS key, count(o) AS n",
        "SELECT c_custkey AS key, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 250000 GROUP BY 1",
    ),
    "exists_subquery": (
        "MATCH (c:Customer) WHERE EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.orderpriority = '1-URGENT' } RETURN c.key AS key",
        "SELECT c_custkey AS key FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')",
    ),
    "not_exists": (
        "MATCH (c:Customer) WHERE NOT EXISTS { (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 } RETURN c.key AS key",
        "SELECT c_custkey AS key FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ),
    "count_subquery": (
        "MATCH (c:Customer) RETURN c.key AS key, COUNT { (c)-[:PLACED]->() } AS n",
        "SELECT c_custkey AS key, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer",
    ),
    "aggregates": (
        "MATCH (c:Customer) RETURN c.mktsegment AS seg, count(*) AS n, count(DISTINCT c.nationkey) AS d, min(c.acctbal) AS lo, max(c.acctbal) AS hi, "
        "round(avg(c.acctbal) * 100) AS av, round(stdev(c.acctbal)) AS sd, round(stdevp(c.acctbal)) AS sp",
        "SELECT c_mktsegment AS seg, count(*) AS n, count(DISTINCT c_nationkey) AS d, min(c_acctbal) AS lo, max(c_acctbal) AS hi, "
        "round(avg(c_acctbal) * 100) AS av, round(stddev_samp(c_acctbal)) AS sd, round(stddev_pop(c_acctbal)) AS sp FROM customer GROUP BY 1",
    ),
    "global_aggregate": (
        "MATCH (p:Part) WHERE p.size > 45 RETURN count(*) AS n, max(p.size) AS hi",
        "SELECT count(*) AS n, max(p_size) AS hi FROM part WHERE p_size > 45",
    ),
    "percentiles": (
        "MATCH (p:Part) RETURN p.brand AS brand, percentile_cont(p.size, 0.5) AS med, percentile_disc(p.size, 0.9) AS p90",
        "SELECT p_brand AS brand, quantile_cont(CAST(p_size AS DOUBLE), 0.5) AS med, list_sort(list(p_size))[CAST(floor(0.9 * (count(*) - 1)) AS "
        "BIGINT) + 1] AS p90 FROM part GROUP BY 1",
    ),
    "collect": (
        "MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS region, size(collect(n.name)) AS k, collect(n.name)[0] AS first, collect(DISTINCT "
        "n.name)[-1] AS last",
        "SELECT r_name AS region, count(*) AS k, min(n_name) AS first, max(n_name) AS last FROM region JOIN nation ON r_regionkey = n_regionkey GROUP "
        "BY 1",
    ),
    "having": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN c.key AS key, count(o) AS n HAVING n > 12",
        "SELECT o_custkey AS key, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING count(*) > 12",
    ),
    "with_pipeline": (
        "MATCH (c:Customer)-[:PLACED]->(o:Order) WITH c, count(o) AS n WHERE n >= 10 MATCH (c)-[:LOCATED_IN]->(x:Nation) RETURN x.name AS nation, "
        "count(*) AS heavy, sum(n) AS orders",
        "SELECT n_name AS nation, count(*) AS heavy, CAST(sum(n) AS BIGINT) AS orders FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 "
        "HAVING count(*) >= 10) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    ),
    "group_by": (
        "MATCH (o:Order) RETURN o.orderstatus AS s, count(*) AS n GROUP BY o.orderstatus, o.orderpriority",
        "SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority",
    ),
    "order_skip_limit": (
        "MATCH (o:Order) RETURN o.key AS key, o.totalprice AS total ORDER BY o.totalprice DESC, o.key SKIP 5 LIMIT 20",
        "SELECT o_orderkey AS key, o_totalprice AS total FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 5",
    ),
    "distinct": (
        "MATCH (o:Order)-[:SHIPPED_BY]->(s:Supplier) RETURN DISTINCT s.key AS skey, o.orderstatus AS st",
        "SELECT DISTINCT l_suppkey AS skey, o_orderstatus AS st FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    ),
    "union_all": (
        "MATCH (c:Customer) WHERE c.acctbal < 0 RETURN c.name AS name UNION ALL MATCH (s:Supplier) WHERE s.acctbal < 0 RETURN s.name AS name",
        "SELECT c_name AS name FROM customer WHERE c_acctbal < 0 UNION ALL SELECT s_name FROM supplier WHERE s_acctbal < 0",
    ),
    "union_distinct": (
        "MATCH (c:Customer) RETURN c.nationkey AS k UNION MATCH (s:Supplier) RETURN s.nationkey AS k",
        "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    ),
    "unwind": ("UNWIND [1, 2, 3] AS x UNWIND [10, 20] AS y RETURN x * y AS p", "SELECT x * y AS p FROM (VALUES (1), (2), (3)) a(x), (VALUES (10), (20)) b(y)"),
    "list_functions": (
        "UNWIND [1, 2, 3, 4] AS x WITH [x, x + 1, x + 2] AS l RETURN head(l) AS h, last(l) AS t, size(l) AS n, reverse(l)[0] AS r, tail(l)[0] AS s, "
        "l[0..2][1] AS u, l[-1] AS e, size([y IN l WHERE y > 3 | y * 2]) AS big",
        "SELECT CAST(x AS INTEGER) AS h, CAST(x + 2 AS INTEGER) AS t, CAST(3 AS BIGINT) AS n, CAST(x + 2 AS INTEGER) AS r, CAST(x + 1 AS INTEGER) AS "
        "s, CAST(x + 1 AS INTEGER) AS u, CAST(x + 2 AS INTEGER) AS e, CAST((x > 3)::INT + (x + 1 > 3)::INT + (x + 2 > 3)::INT AS BIGINT) AS big FROM "
        "range(1, 5) t(x)",
    ),
    "scalar_functions": (
        "MATCH (p:Part) RETURN p.key AS key, toInteger(p.retailprice) AS i, toFloat(p.size) AS f, toString(p.size) AS s, coalesce(p.nothing, p.size) "
        "AS c, size(p.name) AS n, toBoolean('TRUE') AS b, p.size / 3 AS q, p.size % 7 AS m, -p.size AS neg",
        "SELECT p_partkey AS key, CAST(trunc(p_retailprice) AS BIGINT) AS i, CAST(p_size AS DOUBLE) AS f, CAST(p_size AS VARCHAR) AS s, p_size AS c, "
        "CAST(length(p_name) AS BIGINT) AS n, true AS b, CAST(p_size // 3 AS BIGINT) AS q, p_size % 7 AS m, -p_size AS neg FROM part",
    ),
    "more_functions": (
        "MATCH (p:Part) RETURN p.key AS key, p.size ^ 2 AS sq, {a: p.size, b: 1}['a'] AS m, exists(p.name) AS e, id(p) % 1000 AS i, 'x' || p.brand AS c, [p.size, 0][0] AS f",
        "SELECT p_partkey AS key, CAST(p_size AS DOUBLE) ** 2 AS sq, p_size AS m, true AS e, CAST((p_partkey + 2 * 1099511627776) % 1000 AS BIGINT) AS i, 'x' || p_brand AS c, p_size AS f FROM part",
    ),
    "has_label": ("MATCH (n) WHERE n:Nation OR n:Region RETURN n.name AS name", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "factorized_count": (
        "MATCH (n:Nation)<-[:LOCATED_IN]-(c:Customer)-[:PLACED]->(o:Order)-[:CONTAINS]->(p:Part) RETURN n.name AS nation, count(*) AS n, "
        "count(DISTINCT p.brand) AS b",
        "SELECT n_name AS nation, count(*) AS n, count(DISTINCT p_brand) AS b FROM nation JOIN customer ON n_nationkey = c_nationkey JOIN orders ON "
        "c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey GROUP BY 1",
    ),
}

#: On other graphs than the star schema's.
_ELSEWHERE: dict[str, tuple[Callable, str, str]] = {
    "unbounded_paths": (
        queries_algorithms.tree_graph,
        "MATCH (a:Nation)-[:REFERS*]->(b:Nation) RETURN a.name AS a, b.name AS b",
        """WITH RECURSIVE t AS (SELECT n_nationkey AS a, n_nationkey AS b FROM nation UNION ALL SELECT t.a, n_nationkey FROM t JOIN nation ON n_nationkey // 3 = t.b AND n_nationkey > 0)
        SELECT x.n_name AS a, y.n_name AS b FROM t JOIN nation x ON x.n_nationkey = t.a JOIN nation y ON y.n_nationkey = t.b WHERE t.a <> t.b""",
    ),
    "shortest_path": (
        lambda s, d: referral_graph(s, d),
        "MATCH (a) WHERE id(a) = 1 MATCH p = shortestPath((a)-[*1..6]->(b)) RETURN length(p) AS hops, count(*) AS n",
        f"""WITH RECURSIVE {_E}, t AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS d UNION SELECT dst, d + 1 FROM t JOIN e ON src = id WHERE d < 6)
        SELECT CAST(d AS BIGINT) AS hops, count(*) AS n FROM (SELECT id, min(d) AS d FROM t GROUP BY 1) WHERE d > 0 GROUP BY 1""",
    ),
    "all_shortest_paths": (
        lambda s, d: referral_graph(s, d),
        "MATCH (a) WHERE id(a) = 1 MATCH p = allShortestPaths((a)-[*1..6]->(b)) RETURN length(p) AS hops, count(*) AS n",
        f"""WITH RECURSIVE {_E}, t AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS d, CAST(1 AS BIGINT) AS n
             UNION ALL SELECT dst, any_value(d) + 1, CAST(sum(n) AS BIGINT) FROM t JOIN e ON src = id WHERE d < 6 GROUP BY dst)
        SELECT CAST(d AS BIGINT) AS hops, CAST(sum(n) AS BIGINT) AS n FROM (SELECT id, min(d) AS d, arg_min(n, d) AS n FROM t GROUP BY 1) WHERE d > 0 GROUP BY 1""",
    ),
    "walks_counted": (
        lambda s, d: referral_graph(s, d),
        "MATCH (a)-[*2..2]->(b) WHERE id(b) <= 20 RETURN id(b) AS b, count(*) AS n",
        f"WITH {_E} SELECT y.dst AS b, count(*) AS n FROM e x JOIN e y ON x.dst = y.src WHERE y.dst <= 20 GROUP BY 1",
    ),
}

_GREMLIN: dict[str, tuple[str, str]] = {
    "gremlin_values": ("g.V().hasLabel('Nation').values('name')", "SELECT n_name AS value FROM nation"),
    "gremlin_hops": (
        "g.V().hasLabel('Customer').has('acctbal', gt(9000)).out('PLACED').has('totalprice', between(100000, 200000)).values('key')",
        "SELECT o_orderkey AS value FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 9000 AND o_totalprice >= 100000 AND "
        "o_totalprice < 200000",
    ),
    "gremlin_count": ("g.V().hasLabel('Order').outE('CONTAINS').has('quantity', lte(10)).count()", "SELECT count(*) AS value FROM lineitem WHERE l_quantity <= 10"),
    "gremlin_dedup": (
        "g.V().hasLabel('Supplier').out('LOCATED_IN').dedup().values('name')",
        "SELECT DISTINCT n_name AS value FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    ),
    "gremlin_order_limit": (
        "g.V().hasLabel('Part').order().by('key', desc).limit(7).values('key')",
        "SELECT p_partkey AS value FROM part ORDER BY p_partkey DESC LIMIT 7",
    ),
    "gremlin_where": (
        "g.V().hasLabel('Customer').where(out('PLACED').has('orderstatus', 'P')).values('key')",
        "SELECT c_custkey AS value FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
    ),
    "gremlin_group_count": ("g.V().hasLabel('Customer').groupCount().by('mktsegment')", "SELECT c_mktsegment AS key, count(*) AS value FROM customer GROUP BY 1"),
    "gremlin_mean": ("g.V().hasLabel('Part').has('size', within(1, 2, 3)).values('size').mean()", "SELECT avg(p_size) AS value FROM part WHERE p_size IN (1, 2, 3)"),
    "gremlin_max": ("g.V().hasLabel('Part').has('size', within(1, 2, 3)).values('size').max()", "SELECT max(p_size) AS value FROM part WHERE p_size IN (1, 2, 3)"),
    "gremlin_not": (
        "g.V().hasLabel('Customer').not(__.out('PLACED').has('totalprice', gt(400000))).values('key')",
        "SELECT c_custkey AS value FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)",
    ),
}

_GRAPHQL: dict[str, tuple[str, str]] = {
    "graphql_filter": (
        "{ customer(acctbal_gt: 9000, mktsegment: \"BUILDING\") { key name } }",
        "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_acctbal > 9000 AND c_mktsegment = 'BUILDING'",
    ),
    "graphql_nested": ("{ nation { name IN_REGION { name } } }", "SELECT n_name AS name, r_name AS IN_REGION_name FROM nation JOIN region ON n_regionkey = r_regionkey"),
    "graphql_order": (
        "{ part(size_in: [1, 2], orderBy: {key: DESC}, first: 10) { key size } }",
        "SELECT p_partkey AS key, p_size AS size FROM part WHERE p_size IN (1, 2) ORDER BY p_partkey DESC LIMIT 10",
    ),
}

_PREFIX = "PREFIX ex: <http://ex/> "
_SPARQL: dict[str, tuple[str, str]] = {
    "sparql_pattern": (
        "SELECT ?n ?r WHERE { ?x ex:name ?n ; ex:region ?y . ?y ex:name ?r }",
        "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey",
    ),
    "sparql_filter": (
        "SELECT ?n WHERE { ?c ex:name ?n . ?c ex:balance ?b . FILTER(?b > 9000 && STRLEN(?n) > 3) }",
        "SELECT c_name AS n FROM customer WHERE c_acctbal > 9000 AND length(c_name) > 3",
    ),
    "sparql_optional": (
        "SELECT ?n ?s WHERE { ?c ex:name ?n ; ex:nation ?x OPTIONAL { ?c ex:segment ?s } }",
        "SELECT c_name AS n, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment END AS s FROM customer",
    ),
    "sparql_union": (
        "SELECT ?n WHERE { { ?x ex:region ?r . ?x ex:name ?n } UNION { ?x ex:segment ?s . ?x ex:name ?n } }",
        "SELECT n_name AS n FROM nation UNION ALL SELECT c_name FROM customer WHERE c_mktsegment = 'BUILDING'",
    ),
    "sparql_minus": (
        "SELECT ?n WHERE { ?c ex:name ?n ; ex:nation ?x MINUS { ?c ex:segment ?s } }",
        "SELECT c_name AS n FROM customer WHERE c_mktsegment IS DISTINCT FROM 'BUILDING'",
    ),
    "sparql_not_exists": (
        "SELECT ?n WHERE { ?c ex:nation ?x ; ex:name ?n FILTER NOT EXISTS { ?c ex:segment ?s } }",
        "SELECT c_name AS n FROM customer WHERE c_mktsegment <> 'BUILDING'",
    ),
    "sparql_group": (
        "SELECT ?r (COUNT(?c) AS ?k) WHERE { ?c ex:nation ?x . ?x ex:region ?y . ?y ex:name ?r } GROUP BY ?r HAVING (COUNT(?c) > 1)",
        "SELECT r_name AS r, CAST(count(*) AS VARCHAR) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = "
        "r_regionkey GROUP BY 1 HAVING count(*) > 1",
    ),
    "sparql_path": (
        "SELECT ?n ?r WHERE { ?c ex:segment ?s ; ex:name ?n ; ex:nation/ex:region/ex:name ?r }",
        "SELECT c_name AS n, r_name AS r FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE "
        "c_mktsegment = 'BUILDING'",
    ),
    "sparql_strings": (
        "SELECT ?n (STRBEFORE(?n, '#') AS ?a) (STRAFTER(?n, '#') AS ?b) (STRBEFORE(?n, '?') AS ?c) (REPLACE(?n, 'Customer', 'C') AS ?d) "
        "(UCASE(SUBSTR(?n, 2, 3)) AS ?e) (ENCODE_FOR_URI(?n) AS ?f) WHERE { ?c0 ex:nation ?x ; ex:name ?n }",
        "SELECT c_name AS n, split_part(c_name, '#', 1) AS a, split_part(c_name, '#', 2) AS b, '' AS c, replace(c_name, 'Customer', 'C') AS d, "
        "upper(substr(c_name, 2, 3)) AS e, replace(c_name, '#', '%23') AS f FROM customer",
    ),
    "sparql_numbers": (
        "SELECT ?n (FLOOR(ABS(?b)) AS ?a) (CEIL(?b) AS ?c) (FLOOR(?b) AS ?f) (ROUND(?b) AS ?r) (FLOOR(?b * 2 + 1) AS ?t) (FLOOR((?b - 5) / 2) AS ?h) "
        "WHERE { ?c0 ex:balance ?b ; ex:name ?n FILTER(?b = FLOOR(?b) || ABS(?b) > 9000) }",
        "SELECT c_name AS n, CAST(CAST(floor(abs(b)) AS BIGINT) AS VARCHAR) AS a, CAST(CAST(ceil(b) AS BIGINT) AS VARCHAR) AS c, CAST(CAST(floor(b) "
        "AS BIGINT) AS VARCHAR) AS f, CAST(CAST(floor(b + 0.5::DOUBLE) AS BIGINT) AS VARCHAR) AS r, CAST(CAST(floor(b * 2 + 1) AS BIGINT) AS VARCHAR) "
        "AS t, CAST(CAST(floor((b - 5) / 2) AS BIGINT) AS VARCHAR) AS h FROM (SELECT *, c_acctbal AS b FROM customer) WHERE b = floor(b) OR abs(b) > "
        "9000",
    ),
    "sparql_conditions": (
        "SELECT ?n (IF(?b > 5000, 'high', 'low') AS ?k) (COALESCE(?s, 'none') AS ?t) (BOUND(?s) AS ?u) WHERE { ?c ex:name ?n ; ex:balance ?b OPTIONAL "
        "{ ?c ex:segment ?s } }",
        "SELECT c_name AS n, CASE WHEN c_acctbal > 5000 THEN 'high' ELSE 'low' END AS k, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment ELSE "
        "'none' END AS t, CASE WHEN c_mktsegment = 'BUILDING' THEN 'true' ELSE 'false' END AS u FROM customer",
    ),
    "sparql_types": (
        "SELECT ?n (isIRI(?x) AS ?a) (isLITERAL(?n) AS ?b) (isNUMERIC(?b0) AS ?c) (isBLANK(?x) AS ?d) (DATATYPE(?b0) AS ?e) (STR(?x) AS ?f) WHERE { "
        "?c0 ex:nation ?x ; ex:name ?n ; ex:balance ?b0 }",
        "SELECT c_name AS n, 'true' AS a, 'true' AS b, 'true' AS c, 'false' AS d, 'http://www.w3.org/2001/XMLSchema#double' AS e, 'http://ex/nation/' "
        "|| c_nationkey AS f FROM customer",
    ),
    "sparql_predicates": (
        "SELECT ?n WHERE { ?c ex:nation ?x ; ex:name ?n FILTER(REGEX(?n, '[13]$') && STRSTARTS(?n, 'Cust') && (CONTAINS(?n, '99') || STRENDS(?n, "
        "'11')) && ?n NOT IN ('Customer#000000011')) }",
        "SELECT c_name AS n FROM customer WHERE regexp_matches(c_name, '[13]$') AND (contains(c_name, '99') OR ends_with(c_name, '11')) AND c_name <> "
        "'Customer#000000011'",
    ),
    "sparql_hashes": (
        "SELECT ?n (MD5(?n) AS ?a) (SHA256(?n) AS ?b) WHERE { ?x ex:region ?r ; ex:name ?n }",
        "SELECT n_name AS n, md5(n_name) AS a, sha256(n_name) AS b FROM nation",
    ),
    "sparql_dates": (
        "SELECT ?n (YEAR(?t) AS ?a) (MONTH(?t) AS ?b) (DAY(?t) AS ?c) (HOURS(?t) AS ?d) (MINUTES(?t) AS ?e) (SECONDS(?t) AS ?f) (TZ(?t) AS ?g) "
        "(TIMEZONE(?t) AS ?h) WHERE { ?x ex:region ?r ; ex:name ?n BIND('2021-03-04T05:06:07Z' AS ?t) }",
        "SELECT n_name AS n, '2021' AS a, '3' AS b, '4' AS c, '5' AS d, '6' AS e, '7' AS f, 'Z' AS g, 'PT0S' AS h FROM nation",
    ),
    "sparql_terms": (
        "SELECT ?n (STR(IRI(CONCAT('http://ex/n/', ?n))) AS ?a) (DATATYPE(STRDT(?n, ex:t)) AS ?b) (LANG(STRLANG(?n, 'en')) AS ?c) (sameTerm(?n, ?n) "
        "AS ?d) (LANGMATCHES(LANG(STRLANG(?n, 'en-GB')), 'en') AS ?e) WHERE { ?x ex:region ?r ; ex:name ?n }",
        "SELECT n_name AS n, 'http://ex/n/' || n_name AS a, 'http://ex/t' AS b, 'en' AS c, 'true' AS d, 'true' AS e FROM nation",
    ),
    "sparql_aggregates": (
        "SELECT ?x (COUNT(?c) AS ?k) (COUNT(DISTINCT ?s) AS ?d) (FLOOR(MIN(?b)) AS ?lo) (FLOOR(MAX(?b)) AS ?hi) (ROUND(AVG(?b)) AS ?av) "
        "(ROUND(SUM(?b)) AS ?su) WHERE { ?c ex:nation ?x ; ex:balance ?b OPTIONAL { ?c ex:segment ?s } } GROUP BY ?x",
        "SELECT 'http://ex/nation/' || c_nationkey AS x, CAST(count(*) AS VARCHAR) AS k, CAST(count(DISTINCT CASE WHEN c_mktsegment = 'BUILDING' THEN "
        "1 END) AS VARCHAR) AS d, CAST(CAST(floor(min(c_acctbal)) AS BIGINT) AS VARCHAR) AS lo, CAST(CAST(floor(max(c_acctbal)) AS BIGINT) AS "
        "VARCHAR) AS hi, CAST(CAST(floor(avg(c_acctbal) + 0.5) AS BIGINT) AS VARCHAR) AS av, CAST(CAST(floor(sum(c_acctbal) + 0.5) AS BIGINT) AS "
        "VARCHAR) AS su FROM customer GROUP BY c_nationkey",
    ),
    "sparql_group_concat": (
        "SELECT ?r (GROUP_CONCAT(?n ; SEPARATOR = '|') AS ?l) (SAMPLE(?n) AS ?s) WHERE { ?x ex:region ?y ; ex:name ?n . ?y ex:name ?r } GROUP BY ?r",
        "SELECT r_name AS r, string_agg(n_name, '|' ORDER BY n_name) AS l, min(n_name) AS s FROM nation JOIN region ON n_regionkey = r_regionkey "
        "GROUP BY 1",
    ),
    "sparql_unbound": (
        "SELECT ?n ?s WHERE { ?c ex:nation ?x ; ex:name ?n OPTIONAL { ?c ex:segment ?s } VALUES (?x ?s) { (<http://ex/nation/3> UNDEF) (UNDEF "
        "'BUILDING') } }",
        "SELECT c_name AS n, CASE WHEN c_mktsegment = 'BUILDING' THEN c_mktsegment END AS s FROM customer WHERE c_nationkey = 3 UNION ALL SELECT "
        "c_name, 'BUILDING' FROM customer WHERE c_mktsegment = 'BUILDING' OR c_mktsegment <> 'BUILDING'",
    ),
    "sparql_in_order": (
        "SELECT ?n WHERE { ?c ex:nation ?x ; ex:name ?n MINUS { ?c ex:segment ?s } ?x ex:region ?y . ?y ex:name 'ASIA' }",
        "SELECT c_name AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_mktsegment <> "
        "'BUILDING' AND r_name = 'ASIA'",
    ),
    "sparql_subselect": (
        "SELECT ?n ?k WHERE { { SELECT ?x (COUNT(?c) AS ?k) WHERE { ?c ex:nation ?x ; ex:segment ?s } GROUP BY ?x } ?x ex:name ?n }",
        "SELECT n_name AS n, CAST(count(*) AS VARCHAR) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' "
        "GROUP BY 1",
    ),
    "sparql_exists": (
        "SELECT ?n WHERE { ?x ex:region ?r ; ex:name ?n FILTER EXISTS { ?c ex:nation ?x ; ex:balance ?b FILTER(?b > 9900) } }",
        "SELECT n_name AS n FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9900)",
    ),
    "sparql_order_limit": (
        "SELECT ?n WHERE { ?c ex:name ?n ; ex:balance ?b FILTER(?b > 0) } ORDER BY DESC(?b) ?n LIMIT 15 OFFSET 5",
        "SELECT c_name AS n FROM customer WHERE c_acctbal > 0 ORDER BY c_acctbal DESC, c_name LIMIT 15 OFFSET 5",
    ),
    "sparql_closure": (
        "SELECT ?r WHERE { <http://ex/nation/3> ex:region?/ex:name ?r }",
        "SELECT n_name AS r FROM nation WHERE n_nationkey = 3 UNION SELECT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE "
        "n_nationkey = 3",
    ),
    "sparql_bind": (
        "SELECT ?u WHERE { ?x ex:region ?r ; ex:name ?n BIND(CONCAT(LCASE(?n), '-', SUBSTR(?n, 1, 2)) AS ?u) }",
        "SELECT lower(n_name) || '-' || substr(n_name, 1, 2) AS u FROM nation",
    ),
}


def _terms(df: DataFrame) -> DataFrame:
    """The values of term columns."""
    return df.select(*[F.col(c)["value"].alias(c) if "struct" in t else F.col(c) for c, t in df.dtypes])


def _pagerank_sql(rounds: int = 10) -> str:
    steps = [f"WITH {_E}, n AS (SELECT count(*) AS n FROM v), d AS (SELECT src, count(*) AS d FROM e GROUP BY 1), r0 AS (SELECT id, 1.0::DOUBLE / n AS r FROM v, n)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"l{i} AS (SELECT coalesce(sum(r), 0) AS l FROM r{i - 1} WHERE id NOT IN (SELECT src FROM d)), g{i} AS (SELECT dst AS id, sum(r / d) AS g FROM e JOIN d USING (src) JOIN r{i - 1} ON id = src GROUP BY 1), "
            f"r{i} AS (SELECT v.id, 0.15 / n + 0.85 * l / n + 0.85 * coalesce(g, 0) AS r FROM v CROSS JOIN n CROSS JOIN l{i} LEFT JOIN g{i} ON v.id = g{i}.id)"
        )
    return ", ".join(steps) + f" SELECT id, round(r, 10) AS rank FROM r{rounds}"


def _algorithms() -> dict[str, tuple[Callable, str | None]]:
    r = referral_graph
    pairs = "SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM e WHERE src <> dst"
    near = f"p AS ({pairs}), u AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p)"
    reach = f"WITH RECURSIVE {_E}, t AS (SELECT CAST(1 AS BIGINT) AS id, 0 AS depth WHERE 1 IN (SELECT id FROM v) UNION SELECT dst, depth + 1 FROM t JOIN e ON src = id WHERE depth < 12) SELECT id, min(depth) AS depth FROM t GROUP BY 1"
    tri = f"WITH {_E}, {near}, t AS (SELECT x.a AS x, x.b AS y, y.b AS z FROM p x JOIN p y ON x.b = y.a JOIN p w ON w.a = x.a AND w.b = y.b), c AS (SELECT id, count(*) AS t FROM (SELECT x AS id FROM t UNION ALL SELECT y FROM t UNION ALL SELECT z FROM t) GROUP BY 1)"
    return {
        "algo_bfs": (lambda s, d: traversal.bfs(r(s, d), 1), reach),
        "algo_connected_components": (lambda s, d: structure.connected_components(r(s, d)), f"WITH RECURSIVE {_E}, {near}, t AS (SELECT min(id) AS id FROM v UNION SELECT b FROM t JOIN u ON a = id) SELECT v.id, coalesce(m.c, (SELECT min(id) FROM v WHERE id NOT IN (SELECT id FROM t))) AS component FROM v LEFT JOIN (SELECT t.id, (SELECT min(id) FROM v) AS c FROM t) m USING (id)"),
        "algo_strong_components": (lambda s, d: structure.strongly_connected_components(r(s, d)), f"WITH RECURSIVE {_E}, s AS (SELECT DISTINCT src, dst FROM e), f AS (SELECT src AS a, dst AS b FROM s UNION SELECT a, dst FROM f JOIN s ON src = b) SELECT v.id, least(v.id, coalesce(min(f.b), v.id)) AS component FROM v LEFT JOIN f ON f.a = v.id AND EXISTS (SELECT 1 FROM f g WHERE g.a = f.b AND g.b = f.a) GROUP BY v.id"),
        "algo_shortest_paths": (lambda s, d: traversal.dijkstra(r(s, d), 1, "w").select("id", "distance"), f"WITH RECURSIVE {_E}, s AS (SELECT src, dst, min(w) AS w FROM e GROUP BY 1, 2), t AS (SELECT CAST(1 AS BIGINT) AS id, 0.0::DOUBLE AS distance, 0 AS k WHERE 1 IN (SELECT id FROM v) UNION ALL SELECT dst, min(distance + w), any_value(k) + 1 FROM t JOIN s ON src = id WHERE k < 14 GROUP BY dst) SELECT id, min(distance) AS distance FROM t GROUP BY 1"),
        "algo_degrees": (lambda s, d: centrality.degree_centrality(r(s, d)), f"WITH {_E} SELECT id, (SELECT count(*) FROM e WHERE src = id) AS out_degree, (SELECT count(*) FROM e WHERE dst = id) AS in_degree, (SELECT count(*) FROM e WHERE src = id) + (SELECT count(*) FROM e WHERE dst = id) AS degree FROM v"),
        "algo_pagerank": (lambda s, d: centrality.pagerank(r(s, d), max_iterations=10, tolerance=0.0).select("id", F.round("rank", 10).alias("rank")), _pagerank_sql()),
        "algo_triangles": (lambda s, d: structure.triangle_count(r(s, d)), tri + " SELECT v.id, coalesce(t, 0) AS triangles FROM v LEFT JOIN c USING (id)"),
        "algo_clustering": (lambda s, d: structure.clustering(r(s, d)).select("id", F.round("coefficient", 9).alias("coefficient")), tri + ", k AS (SELECT a AS id, count(*) AS k FROM u GROUP BY 1) SELECT v.id, round(CASE WHEN coalesce(k, 0) < 2 THEN 0.0::DOUBLE ELSE 2.0::DOUBLE * coalesce(t, 0) / (k * (k - 1)) END, 9) AS coefficient FROM v LEFT JOIN c USING (id) LEFT JOIN k USING (id)"),
        "algo_spanning_forest": (lambda s, d: structure.spanning_forest(r(s, d), "w"), None),
    }


def _others() -> dict[str, tuple[Callable, str | None]]:
    t = tpch_graph

    def knn(spark, sf_dir):
        df = _table(spark, sf_dir, "embeddings")
        q = [float(x) for x in df.where("vec_id = 0").first()["embedding"]]
        return vectors.search(df, q, 10, key="vec_id", metric="euclidean").select("vec_id", F.round("distance", 6).alias("distance"))

    def batch(spark, sf_dir):
        df = _table(spark, sf_dir, "embeddings")
        q = df.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), "embedding")
        return vectors.batch_search(df, q, 3, key="vec_id", metric="cosine").select("query", "vec_id", "rank")

    def by_metric(metric):
        def run(spark, sf_dir):
            df = _table(spark, sf_dir, "embeddings")
            q = [float(x) for x in df.where("vec_id = 1").first()["embedding"]]
            return vectors.search(df, q, 10, key="vec_id", metric=metric).select("vec_id", F.round("distance", 6).alias("distance"))

        return run

    def joined(spark, sf_dir):
        df = _table(spark, sf_dir, "embeddings")
        left = df.where("label = 1").select("vec_id", "embedding")
        return vectors.vector_join(left, df.where("label = 2"), 2, left_key="vec_id", right_key="vec_id", metric="euclidean").select("vec_id", "match", "rank")

    def in_a_query(spark, sf_dir):
        g = PropertyGraph(spark).with_vertices(_table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "id").withColumn("key", F.col("id")), "Vector")
        text = "MATCH (a:Vector), (b:Vector) WHERE a.key = 0 AND b.key < 50 RETURN b.key AS key, round(euclidean_distance(a.embedding, b.embedding) * 1000) AS e, round(dot_product(a.embedding, b.embedding) * 1000) AS d, round(manhattan_distance(a.embedding, b.embedding) * 1000) AS m"
        return g.cypher(text)

    def merge(spark, sf_dir):
        g = t(spark, sf_dir).execute("MERGE (r:Region {name: 'ATLANTIS'}) ON CREATE SET r.key = 99").graph
        return g.cypher("MATCH (r:Region) RETURN r.name AS name, r.key AS key")

    def created(spark, sf_dir):
        g = t(spark, sf_dir).execute("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (n)-[:NEAR {w: 1}]->(:Port {name: n.name})").graph
        return g.cypher("MATCH (n:Nation)-[e:NEAR]->(p:Port) RETURN n.name AS nation, p.name AS port, e.w AS w")

    def deleted(spark, sf_dir):
        g = t(spark, sf_dir).execute("MATCH (c:Customer) WHERE c.acctbal < 0 DETACH DELETE c").graph
        return g.cypher("MATCH (c:Customer)-[:PLACED]->(o:Order) RETURN count(DISTINCT c) AS customers, count(*) AS orders")

    def updated(spark, sf_dir):
        g = t(spark, sf_dir).execute("MATCH (p:Part) WHERE p.size > 25 SET p.size = p.size + 100, p:Large").graph
        return g.cypher("MATCH (p:Large) RETURN p.key AS key, p.size AS size")

    def sparql_update(spark, sf_dir):
        store = triples(spark, sf_dir).execute(_PREFIX + "DELETE { ?x ex:region ?r } INSERT { ?x ex:within ?r } WHERE { ?x ex:region ?r }").store
        return _terms(store.sparql(_PREFIX + "SELECT ?n ?r WHERE { ?x ex:within ?y ; ex:name ?n . ?y ex:name ?r }"))

    def by_id(spark, sf_dir):
        ids = [_CODES["customer"] * _STEP + k for k in (1, 2, 7)] + [_CODES["nation"] * _STEP + 3]
        return t(spark, sf_dir).nodes_by_id(ids).select(F.col("labels")[0].alias("label"), "key", "name")

    def near(spark, sf_dir):
        base = _CODES["nation"] * _STEP
        found = t(spark, sf_dir).neighbors([base + 1, base + 2], "in", ("LOCATED_IN",))
        return found.groupBy((F.col("id") - base).alias("nation")).agg(F.count(F.lit(1)).alias("n"))

    def wrote(text, read):
        return lambda s, d: t(s, d).execute(text).graph.cypher(read)

    def kept(spark, sf_dir):
        path = new_folder(spark, "graph")
        small = t(spark, sf_dir)
        few = replace(small, vertices=tuple(v for v in small.vertices if "Nation" in v.labels or "Region" in v.labels), edges=tuple(e for e in small.edges if e.type == "IN_REGION"))
        snapshots.save(few, path)
        return snapshots.load(spark, path).cypher("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN n.name AS n, r.name AS r")

    def named(spark, sf_dir):
        insert = "INSERT { GRAPH ex:asia { ?x ex:in ?y } } WHERE { ?x ex:region ?y . ?y ex:name 'ASIA' }; INSERT { GRAPH ex:rest { ?x ex:in ?y } } WHERE { ?x ex:region ?y . ?y ex:name ?r FILTER(?r != 'ASIA') }"
        store = triples(spark, sf_dir).execute(_PREFIX + insert).store
        return _terms(store.sparql(_PREFIX + "SELECT ?g ?n WHERE { GRAPH ?g { ?x ex:in ?y } ?x ex:name ?n }"))

    def constructed(spark, sf_dir):
        return _terms(triples(spark, sf_dir).sparql(_PREFIX + "CONSTRUCT { ?y ex:holds ?x } WHERE { ?x ex:region ?y }"))

    def stored(spark, sf_dir):
        path = new_folder(spark, "triples")
        triples(spark, sf_dir).save(path)
        return _terms(rdf.TripleStore.load(spark, path).sparql(_PREFIX + "SELECT ?n ?r WHERE { ?x ex:region ?y ; ex:name ?n . ?y ex:name ?r }"))

    def over_triples(spark, sf_dir):
        typed = triples(spark, sf_dir).execute(_PREFIX + "INSERT { ?x a ex:Nation } WHERE { ?x ex:region ?y }").store
        return typed.graphql('{ nation { name region(name_ne: "ASIA") { name } } }', "http://ex/")

    squares = "list_sum([(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) ** 2 for z in list_zip(x.embedding, q.embedding)])"
    constant = "sqrt(list_sum([(CAST(x AS DOUBLE) - 0.1::DOUBLE) ** 2 for x in embedding]))"
    absolute = "list_sum([abs(CAST(z[1] AS DOUBLE) - CAST(z[2] AS DOUBLE)) for z in list_zip(x.embedding, q.embedding)])"
    dot = lambda a, b: f"list_sum([CAST(z[1] AS DOUBLE) * CAST(z[2] AS DOUBLE) for z in list_zip({a}.embedding, {b}.embedding)])"
    return {
        "vector_search": (knn, f"SELECT x.vec_id, round(sqrt({squares}), 6) AS distance FROM embeddings x, embeddings q WHERE q.vec_id = 0 ORDER BY sqrt({squares}), x.vec_id LIMIT 10"),
        "vector_batch_search": (batch, f"SELECT query, vec_id, rank FROM (SELECT q.vec_id AS query, x.vec_id, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY 1 - {dot('x', 'q')} / (sqrt({dot('x', 'x')}) * sqrt({dot('q', 'q')})), x.vec_id) AS INTEGER) AS rank FROM embeddings x, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 3"),
        "vector_search_manhattan": (by_metric("manhattan"), f"SELECT x.vec_id, round({absolute}, 6) AS distance FROM embeddings x, embeddings q WHERE q.vec_id = 1 ORDER BY {absolute}, x.vec_id LIMIT 10"),
        "vector_search_dot": (by_metric("dot"), f"SELECT x.vec_id, round(-{dot('x', 'q')}, 6) AS distance FROM embeddings x, embeddings q WHERE q.vec_id = 1 ORDER BY -{dot('x', 'q')}, x.vec_id LIMIT 10"),
        "vector_join": (joined, f"SELECT vec_id, match, rank FROM (SELECT q.vec_id, x.vec_id AS match, CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY {squares}, x.vec_id) AS INTEGER) AS rank FROM embeddings x, embeddings q WHERE q.label = 1 AND x.label = 2) WHERE rank <= 2"),
        "vector_functions": (in_a_query, f"SELECT x.vec_id AS key, round(sqrt({squares}) * 1000) AS e, round({dot('x', 'q')} * 1000) AS d, round({absolute} * 1000) AS m FROM embeddings x, embeddings q WHERE q.vec_id = 0 AND x.vec_id < 50"),
        "mutation_merge": (merge, "SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS key FROM region UNION ALL SELECT 'ATLANTIS', 99"),
        "mutation_create": (created, "SELECT n_name AS nation, n_name AS port, 1 AS w FROM nation"),
        "mutation_delete": (deleted, "SELECT count(DISTINCT c_custkey) AS customers, count(*) AS orders FROM customer JOIN orders ON c_custkey = o_custkey WHERE c_acctbal >= 0"),
        "mutation_set": (updated, "SELECT p_partkey AS key, CAST(p_size + 100 AS INTEGER) AS size FROM part WHERE p_size > 25"),
        "sparql_update": (sparql_update, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
        "mutation_remove": (
            wrote("MATCH (p:Part) WHERE p.size < 10 REMOVE p.brand", "MATCH (p:Part) RETURN p.brand IS NULL AS gone, count(*) AS n"),
            "SELECT p_size < 10 AS gone, count(*) AS n FROM part GROUP BY 1",
        ),
        "mutation_replace": (
            wrote("MATCH (p:Part) WHERE p.size = 50 SET p = {name: 'new', size: 51}", "MATCH (p:Part) WHERE p.size >= 50 RETURN p.name AS name, p.brand AS brand, p.size AS size"),
            "SELECT 'new' AS name, CAST(NULL AS VARCHAR) AS brand, CAST(51 AS INTEGER) AS size FROM part WHERE p_size = 50",
        ),
        "mutation_labels": (
            wrote("MATCH (c:Customer) WHERE c.acctbal > 9000 SET c:Rich REMOVE c:Customer", "MATCH (n) WHERE n:Rich OR n:Customer RETURN labels(n)[0] AS label, count(*) AS n"),
            "SELECT CASE WHEN c_acctbal > 9000 THEN 'Rich' ELSE 'Customer' END AS label, count(*) AS n FROM customer GROUP BY 1",
        ),
        "mutation_delete_edges": (
            wrote("MATCH (:Order)-[r:CONTAINS]->(p:Part) WHERE r.quantity < 25 DELETE r", "MATCH (:Order)-[r:CONTAINS]->(p:Part) RETURN count(*) AS n, sum(r.quantity) AS q"),
            "SELECT count(*) AS n, sum(l_quantity) AS q FROM lineitem WHERE l_quantity >= 25",
        ),
        "gremlin_write": (
            lambda s, d: t(s, d).execute("MATCH (r:Region) SET r.seen = 0").graph.gremlin("g.V().hasLabel('Region').values('seen')"),
            "SELECT 0 AS value FROM region",
        ),
        "graph_nodes_by_id": (
            by_id,
            "SELECT 'Customer' AS label, c_custkey AS key, c_name AS name FROM customer WHERE c_custkey IN (1, 2, 7) "
            "UNION ALL SELECT 'Nation', CAST(n_nationkey AS BIGINT), n_name FROM nation WHERE n_nationkey = 3",
        ),
        "graph_neighbors": (
            near,
            "SELECT nation, count(*) AS n FROM (SELECT CAST(c_nationkey AS BIGINT) AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier) WHERE nation IN (1, 2) GROUP BY 1",
        ),
        "graph_by_property": (
            lambda s, d: t(s, d).nodes_by_property("mktsegment", "BUILDING", ("Customer",)).select("key", "name"),
            "SELECT c_custkey AS key, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING'",
        ),
        "graph_in_range": (
            lambda s, d: t(s, d).nodes_in_range("totalprice", 100000, 120000, include_high=False, labels=("Order",)).select("key"),
            "SELECT o_orderkey AS key FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 120000",
        ),
        "graph_type_counts": (
            lambda s, d: t(s, d).type_counts(),
            "SELECT 'PLACED' AS type, count(*) AS count FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'SHIPPED_BY', count(*) FROM lineitem "
            "UNION ALL SELECT 'LOCATED_IN', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'IN_REGION', count(*) FROM nation",
        ),
        "graph_snapshot": (kept, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
        "sparql_named_graphs": (
            named,
            "SELECT CASE WHEN r_name = 'ASIA' THEN 'http://ex/asia' ELSE 'http://ex/rest' END AS g, n_name AS n FROM nation JOIN region ON n_regionkey = r_regionkey",
        ),
        "sparql_construct": (
            constructed,
            "SELECT 'http://ex/region/' || n_regionkey AS s, 'http://ex/holds' AS p, 'http://ex/nation/' || n_nationkey AS o FROM nation",
        ),
        "sparql_ask": (lambda s, d: triples(s, d).sparql(_PREFIX + "ASK { ?x ex:name 'ASIA' }"), "SELECT count(*) > 0 AS result FROM region WHERE r_name = 'ASIA'"),
        "sparql_stored": (stored, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
        "graphql_over_triples": (
            over_triples,
            "SELECT n_name AS name, r_name AS region_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'",
        ),
        "graph_vector_search": (
            lambda s, d: PropertyGraph(s).with_vertices(_table(s, d, "embeddings").withColumnRenamed("vec_id", "id"), "Vector").vector_search(
                "Vector", "embedding", [0.1] * 64, 5, "euclidean", F.col("label") == 1
            ).select("id", F.round("distance", 6).alias("distance")),
            f"SELECT vec_id AS id, round({constant}, 6) AS distance FROM embeddings WHERE label = 1 ORDER BY {constant}, vec_id LIMIT 5",
        ),
        "graph_label_counts": (lambda s, d: t(s, d).label_counts(), "SELECT 'Customer' AS label, count(*) AS count FROM customer UNION ALL SELECT 'Supplier', count(*) FROM supplier UNION ALL SELECT 'Part', count(*) FROM part UNION ALL SELECT 'Order', count(*) FROM orders UNION ALL SELECT 'Nation', count(*) FROM nation UNION ALL SELECT 'Region', count(*) FROM region"),
        "graph_dangling_edges": (lambda s, d: t(s, d).dangling_edges().agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
        "graph_degrees": (lambda s, d: t(s, d).degrees(("LOCATED_IN",)).where("degree > 0").agg(F.count(F.lit(1)).alias("n"), F.sum("degree").alias("d")), "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation WHERE n_nationkey IN (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)) AS n, CAST(2 * ((SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier)) AS BIGINT) AS d"),
    }


def registry() -> dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]]:
    out: dict[str, tuple[Callable, str | None]] = {}
    for name, (text, sql) in _CYPHER.items():
        out[name] = (lambda s, d, q=text: tpch_graph(s, d).cypher(q)), sql
    for name, (graph, text, sql) in _ELSEWHERE.items():
        out[name] = (lambda s, d, g=graph, q=text: g(s, d).cypher(q)), sql
    for name, (text, sql) in _GREMLIN.items():
        out[name] = (lambda s, d, q=text: tpch_graph(s, d).gremlin(q)), sql
    for name, (text, sql) in _GRAPHQL.items():
        out[name] = (lambda s, d, q=text: tpch_graph(s, d).graphql(q)), sql
    for name, (text, sql) in _SPARQL.items():
        out[name] = (lambda s, d, q=text: _terms(triples(s, d).sparql(_PREFIX + q))), sql
    return out | _algorithms() | queries_algorithms.queries(referral_graph) | _others()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in registry().items() if sql}


def entry(spark: SparkSession, sf_dir: str = "/root/testdata/sf0.001") -> DataFrame:
    return tpch_graph(spark, sf_dir).cypher(_CYPHER["chain_of_hops"][0])


__all__ = ["entry", "oracle_sql", "queries", "referral_graph", "tpch_graph", "triples"]
