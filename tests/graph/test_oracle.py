"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

from arcweave import queries

FOLDER = "/root/testdata/sf0.001"
NAMES = ["scan_edges", "chain_of_hops", "shared_variables", "variable_length", "optional_match", "percentiles", "with_pipeline", "factorized_count", "gremlin_where", "graphql_nested", "sparql_group", "algo_triangles", "mutation_set"]
NAMES += ["walks_counted", "unbounded_paths", "sparql_unbound", "sparql_in_order", "sparql_aggregates", "sparql_named_graphs", "algo_articulation_points", "algo_topological_levels", "algo_core_numbers", "algo_dfs", "mutation_replace", "vector_join"]
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables here")


@pytest.mark.parametrize("name", NAMES)
def test_query_and_sql_agree(spark, name):
    duckdb = pytest.importorskip("duckdb")
    query, sql = queries.registry()[name]
    got = query(spark, FOLDER)
    with duckdb.connect() as c:
        for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "embeddings"):
            c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
        rows = c.sql(sql)
        columns, want = rows.columns, rows.fetchall()
    assert sorted(got.columns) == sorted(columns)
    at = [columns.index(c) for c in got.columns]
    assert sorted(str(tuple(r)) for r in got.collect()) == sorted(str(tuple(r[i] for i in at)) for r in want)


def test_every_query_is_registered_once():
    assert set(queries.oracle_sql()) <= set(queries.queries())
