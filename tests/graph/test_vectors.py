import math
import random

from pyspark.sql import functions as F

from arcweave import vectors
from arcweave.graph import PropertyGraph


def frame(spark, n=60, d=8, seed=1):
    rng = random.Random(seed)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(d)]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, embedding array<double>"), dict(rows)


def test_search_agrees_with_brute_force(spark):
    df, v = frame(spark)
    q = v[3]
    want = {
        "euclidean": lambda a: math.dist(a, q),
        "manhattan": lambda a: sum(abs(x - y) for x, y in zip(a, q, strict=True)),
        "dot": lambda a: -sum(x * y for x, y in zip(a, q, strict=True)),
        "cosine": lambda a: 1 - sum(x * y for x, y in zip(a, q, strict=True)) / math.hypot(*a) / math.hypot(*q),
    }
    for metric, f in want.items():
        best = sorted(v, key=lambda i: (f(v[i]), i))[:5]
        assert [r.id for r in vectors.search(df, q, 5, metric=metric).collect()] == best
    queries = df.where("id < 4").withColumnRenamed("id", "query")
    got = vectors.batch_search(df, queries, 3, metric="euclidean").collect()
    assert all([r.id for r in sorted((r for r in got if r.query == i), key=lambda r: r.rank)] == sorted(v, key=lambda j: (math.dist(v[i], v[j]), j))[:3] for i in range(4))


def test_quantizers(spark):
    df, v = frame(spark)
    s = vectors.ScalarQuantizer.train(df)
    back = {r.id: r.b for r in df.select("id", s.decode(s.encode(F.col("embedding"))).alias("b")).collect()}
    assert all(abs(x - y) < 0.01 for i in v for x, y in zip(v[i], back[i], strict=True))
    assert vectors.rescored_search(df, v[7], 3, s).first()["id"] == 7
    bits = df.select("id", vectors.binary_encode(F.col("embedding"), 8).alias("b"))
    d = bits.join(bits.where("id = 0").select(F.col("b").alias("c")), F.lit(True)).select("id", vectors.hamming_distance(F.col("b"), F.col("c")).alias("h"))
    assert {r.id: r.h for r in d.collect()} == {i: sum((x > 0) != (y > 0) for x, y in zip(v[i], v[0], strict=True)) for i in v}
    p = vectors.ProductQuantizer.train(df, parts=4, centroids=32)
    near = df.select("id", p.distance(p.encode(F.col("embedding")), v[5]).alias("d")).orderBy("d").limit(5).collect()
    assert 5 in {r.id for r in near}


def test_more_queries_than_are_broadcast(spark):
    df, _ = frame(spark)
    queries = df.withColumnRenamed("id", "query")
    rows = lambda **k: sorted((r.query, r.rank, r.id) for r in vectors.batch_search(df, queries, 3, **k).collect())
    assert rows(most_queries=7) == rows() and len(rows()) == 180


def test_many_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50, 3000)] + [(7, [1.0, 2.5]), (8, [9.0, 9.0]), (9, None), (10, [1.0])]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.4]), (3, None)], "query long, embedding array<double>")
    for metric in ("euclidean", "manhattan"):
        got = sorted((r.query, r.rank, r.id) for r in vectors.batch_search(df, q, 2, metric=metric).collect())
        assert got == [(1, 1, 50), (1, 2, 51), (2, 1, 7), (2, 2, 50)]
    assert vectors.batch_search(df.limit(0), q, 2).count() == 0 and vectors.batch_search(df, q.limit(0), 2).count() == 0


def test_vector_join(spark):
    df, v = frame(spark)
    got = vectors.vector_join(df.where("id < 6"), df, 2, metric="euclidean").collect()
    best = lambda i: sorted(v, key=lambda j: (math.dist(v[i], v[j]), j))[:2]
    assert {(r.id, r.rank, r.match) for r in got} == {(i, k + 1, j) for i in range(6) for k, j in enumerate(best(i))}


def test_cells_find_what_brute_force_finds(spark, tmp_path):
    rng = random.Random(5)
    centres = [[rng.uniform(-1, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + rng.gauss(0, 0.25) for x in rng.choice(centres)]) for i in range(4000)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    vectors.CellIndex.build(df, cells=64).save(str(tmp_path / "index"))
    index = vectors.CellIndex.load(spark, str(tmp_path / "index"))
    assert index.table.count() == 4000
    hit = 0
    for i in range(0, 4000, 400):
        best = sorted((j for j, v in rows if v), key=lambda j: math.dist(rows[i][1], rows[j][1]))[:10]
        hit += len(set(best) & {r.id for r in index.search(rows[i][1], 10, probes=12).collect()})
    assert hit >= 90  # a recall of 0.9
    plan = index.search(rows[0][1], 10, probes=4)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [cell" in plan


def test_search_from_a_graph(spark):
    df, v = frame(spark)
    g = PropertyGraph(spark).with_vertices(df.withColumn("even", F.col("id") % 2 == 0), "Point")
    best = sorted((i for i in v if i % 2 == 0), key=lambda i: (math.dist(v[i], v[3]), i))[:4]
    assert [r.id for r in g.vector_search("Point", "embedding", v[3], 4, "euclidean", F.col("even")).collect()] == best
