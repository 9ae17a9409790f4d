"""Nearest neighbours on vector columns: exact, by cells, and scalar, binary and product quantization."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arcweave.cluster import checkpointed
from arcweave.functions.vectors import METRICS, euclidean_distance, l2_norm

BITS = 64


def _constant(vector) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def search(df: DataFrame, query, k: int, column: str = "embedding", key: str = "id", metric: str = "cosine", max_distance: float | None = None, min_similarity: float | None = None) -> DataFrame:
    """key, distance: the k closest vectors, ties by key. One scan, a top-k of each partition, then of those."""
    found = df.select(key, METRICS[metric](F.col(column), _constant(query)).alias("distance")).where("distance is not null")
    if max_distance is not None:
        found = found.where(F.col("distance") <= max_distance)
    if min_similarity is not None:
        found = found.where(1 - F.col("distance") >= min_similarity)
    return found.orderBy("distance", key).limit(k)


#: Queries that go to every executor at once, and vectors that are held against them at once.
QUERIES, ROWS = 20_000, 1024


def _approximate(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances by matrix products, in about."""
    if metric in ("manhattan", "l1"):
        return np.stack([np.abs(x - v).sum(axis=1) for v in q], axis=1)
    dot = x @ q.T
    if metric in ("dot", "dot_product", "inner_product"):
        return -dot
    if metric == "cosine":
        return 1 - dot / np.maximum(np.linalg.norm(x, axis=1)[:, None] * np.linalg.norm(q, axis=1)[None, :], 1e-300)
    return np.sqrt(np.maximum((x**2).sum(axis=1)[:, None] + (q**2).sum(axis=1)[None, :] - 2 * dot, 0))


def _one_by_one(metric: str, x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distances of each row by itself: equal vectors have equal ones."""
    if metric in ("manhattan", "l1"):
        return np.abs(x - q).sum(axis=1)
    dot = (x * q).sum(axis=1)
    if metric in ("dot", "dot_product", "inner_product"):
        return -dot
    if metric == "cosine":
        return 1 - dot / np.maximum(np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()), 1e-300)
    return np.sqrt(((x - q) ** 2).sum(axis=1))


def _nearest(metric: str, k: int, queries):
    """Of each batch of rows (key, vector): the k closest to every query, ties by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, matrix = queries.value
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                v = part.column("_x")
                x = np.array(v.flatten()).astype(float).reshape(len(v), -1)
                place = np.empty(len(x), np.int64)  # of the key, in order
                place[np.array(pc.sort_indices(part.column(0)))] = np.arange(len(x))
                d = _approximate(metric, x, matrix)
                last = np.partition(d, min(k, len(x)) - 1, axis=0)[min(k, len(x)) - 1]
                may = d <= last + 1e-6 * (1 + np.abs(last))
                for j in np.flatnonzero(may.sum(axis=0) > k):  # ties, or nearly
                    i = np.flatnonzero(may[:, j])
                    order = np.lexsort((place[i], _one_by_one(metric, x[i], matrix[j])))
                    may[i[order[k:]], j] = False
                row, query = np.nonzero(may)
                for lo in range(0, len(row), 1 << 14):
                    i, j = pa.array(row[lo : lo + (1 << 14)]), query[lo : lo + (1 << 14)]
                    yield pa.RecordBatch.from_arrays([part.column(0).take(i), v.take(i), pa.array(number[j])], names=[part.schema.names[0], "_x", "_n"])

    return run


def batch_search(df: DataFrame, queries: DataFrame, k: int, column: str = "embedding", key: str = "id", query_key: str = "query", metric: str = "cosine", most_queries: int = QUERIES) -> DataFrame:
    """query, key, rank, distance: for each query (query_key, column) its k closest vectors, ties by key.

    Any number of queries: ``most_queries`` at a time go to every executor and meet the vectors where these are read.
    A batch's k closest by matrix products get their exact distances; a query's best of all batches are merged.
    Null vectors, and those with null components or of another length than the first query's, take no part.
    """
    spark = df.sparkSession
    vector = lambda c: F.when(F.exists(F.col(c), lambda x: x.isNull()), None).otherwise(F.col(c)).cast("array<double>")
    asked = queries.select(F.col(query_key).alias("_q"), vector(column).alias("_v")).where("_v is not null")
    first = asked.first()
    if first is None:
        return _ranked(df.select(key, vector(column).alias("_x")).crossJoin(asked.limit(0)), key, query_key, metric, k)
    size = len(first["_v"])
    asked = checkpointed(asked.where(F.size("_v") == size).withColumn("_n", F.monotonically_increasing_id()))
    rows = df.select(key, vector(column).alias("_x")).where(F.size("_x") == size)
    rounds, found = -(-asked.count() // most_queries), None
    for i in range(rounds):
        some = checkpointed(asked.where(F.pmod(F.xxhash64("_n"), F.lit(rounds)) == i))
        held = some.select("_n", "_v").toArrow()  # about most_queries vectors
        matrix = np.array(held.column("_v").combine_chunks().flatten()).reshape(-1, size)
        shared = spark.sparkContext.broadcast((np.array(held.column("_n")), matrix))
        near = rows.mapInArrow(_nearest(metric, k, shared), f"`{key}` {df.schema[key].dataType.simpleString()}, _x array<double>, _n long")
        best = _ranked(near.join(some, "_n"), key, query_key, metric, k)
        found = best if found is None else found.unionByName(best)
    return found


def _ranked(pairs: DataFrame, key: str, query_key: str, metric: str, k: int) -> DataFrame:
    d = pairs.select(F.col("_q").alias(query_key), key, METRICS[metric](F.col("_x"), F.col("_v")).alias("distance"))
    w = Window.partitionBy(query_key).orderBy("distance", key)
    return d.where("distance is not null").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def vector_join(left: DataFrame, right: DataFrame, k: int, left_column: str = "embedding", right_column: str = "embedding", left_key: str = "id", right_key: str = "id", metric: str = "cosine") -> DataFrame:
    """Each row of ``left`` with the k rows of ``right`` that are closest to it: left_key, right_key (as ``match``), rank, distance."""
    q = left.select(F.col(left_key).alias("_left"), F.col(left_column).alias("_vector"))
    rows = right.select(F.col(right_key).alias("match"), F.col(right_column).alias("_vector"))
    return batch_search(rows, q, k, "_vector", "match", "_left", metric).withColumnRenamed("_left", left_key)


# --- approximate search ---


@dataclass(frozen=True)
class CellIndex:
    """Vectors by the cell of their nearest centroid (an inverted file): a search reads a few cells only.

    table: cell, key and vector, every vector of the input once; saved, it is partitioned by cell.
    """

    table: DataFrame
    centroids: list[list[float]]
    key: str
    column: str

    @staticmethod
    def build(df: DataFrame, cells: int = 256, column: str = "embedding", key: str = "id", sample: int = 50_000, rounds: int = 10, seed: int = 0) -> CellIndex:
        """Centroids by k-means on at most ``sample`` vectors, those with the smallest hash; all vectors are indexed."""
        rows = df.where(F.col(column).isNotNull()).orderBy(F.xxhash64(column)).limit(sample).select(F.col(column).cast("array<double>").alias("v")).toArrow()
        v = rows.column("v").combine_chunks()
        x = np.array(v.flatten()).reshape(len(v), -1)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
        for _ in range(rounds):
            near = _cell(x, c)
            total = np.zeros_like(c)
            np.add.at(total, near, x)
            count = np.bincount(near, minlength=len(c))
            c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
        shared = df.sparkSession.sparkContext.broadcast(c)  # ``cells`` vectors

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    v = batch.column(1)
                    cell = _cell(np.array(v.flatten()).astype(float).reshape(len(v), -1), shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), *batch.columns], names=["cell", *batch.schema.names])

        data = df.where(F.col(column).isNotNull()).select(key, column)
        kind = lambda n: f"`{n}` {df.schema[n].dataType.simpleString()}"
        return CellIndex(data.mapInArrow(assign, f"cell int, {kind(key)}, {kind(column)}"), c.tolist(), key, column)

    def save(self, path: str) -> None:
        self.table.repartition("cell").write.partitionBy("cell").parquet(f"{path}/cells")
        spark = self.table.sparkSession
        spark.createDataFrame([(i, v, self.key, self.column) for i, v in enumerate(self.centroids)], "cell int, v array<double>, key string, column string").coalesce(1).write.parquet(f"{path}/centroids")

    @staticmethod
    def load(spark: SparkSession, path: str) -> CellIndex:
        rows = sorted(spark.read.parquet(f"{path}/centroids").collect())
        return CellIndex(spark.read.parquet(f"{path}/cells"), [list(r["v"]) for r in rows], rows[0]["key"], rows[0]["column"])

    def search(self, query, k: int, probes: int = 16, metric: str = "euclidean") -> DataFrame:
        """key, distance: the k closest of the vectors in the ``probes`` cells nearest to the query."""
        c, q = np.array(self.centroids), np.array([float(x) for x in query])
        if metric == "cosine":
            order = np.argsort(_approximate("cosine", c, q[None])[:, 0], kind="stable")
        else:
            order = np.argsort(((c - q) ** 2).sum(axis=1), kind="stable")
        cells = sorted(order[:probes].tolist())
        return search(self.table.where(F.col("cell").isin(cells)), query, k, self.column, self.key, metric)


def _cell(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    for at in range(0, len(x), 4096):
        part = x[at : at + 4096]
        out[at : at + 4096] = ((c**2).sum(axis=1)[None, :] - 2 * part @ c.T).argmin(axis=1)
    return out


# --- quantization ---


@dataclass(frozen=True)
class ScalarQuantizer:
    """Each dimension to 0..255 between its smallest and largest value."""

    low: list[float]
    high: list[float]

    @staticmethod
    def train(df: DataFrame, column: str = "embedding") -> ScalarQuantizer:
        size = df.select(F.size(column).alias("n")).first()["n"]
        row = df.agg(*[f(F.element_at(column, i + 1)).alias(f"{n}{i}") for i in range(size) for n, f in (("a", F.min), ("b", F.max))]).first()
        return ScalarQuantizer([float(row[f"a{i}"]) for i in range(size)], [float(row[f"b{i}"]) for i in range(size)])

    def encode(self, c: Column) -> Column:
        low, step = _constant(self.low), _constant([max(b - a, 1e-12) / 255 for a, b in zip(self.low, self.high, strict=True)])
        codes = F.zip_with(F.zip_with(c.cast("array<double>"), low, lambda x, a: x - a), step, lambda x, s: F.round(x / s))
        return F.transform(codes, lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(255.0)).cast("smallint"))

    def decode(self, c: Column) -> Column:
        low, step = _constant(self.low), _constant([max(b - a, 1e-12) / 255 for a, b in zip(self.low, self.high, strict=True)])
        return F.zip_with(F.zip_with(c.cast("array<double>"), step, lambda x, s: x * s), low, lambda x, a: x + a)


def binary_encode(c: Column, size: int) -> Column:
    """Sign bits, 64 to a word."""
    bit = lambda i: F.when(F.element_at(c, i + 1) > 0, F.lit(1 << (i % BITS) if i % BITS < 63 else -(1 << 63)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))
    words = []
    for at in range(0, size, BITS):
        word = bit(at)
        for i in range(at + 1, min(at + BITS, size)):
            word = word.bitwiseOR(bit(i))
        words.append(word)
    return F.array(*words)


def hamming_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


@dataclass(frozen=True)
class ProductQuantizer:
    """Sub-vectors to the number of their nearest centroid; distances from a table per query."""

    books: list[list[list[float]]]

    @staticmethod
    def train(df: DataFrame, parts: int = 8, centroids: int = 16, column: str = "embedding", sample: int = 20_000, rounds: int = 15, seed: int = 0) -> ProductQuantizer:
        """k-means on at most ``sample`` vectors, those with the smallest hash."""
        rows = df.orderBy(F.xxhash64(column)).limit(sample).select(F.col(column).cast("array<double>").alias("v")).collect()
        x = np.array([r["v"] for r in rows])
        rng, books = np.random.default_rng(seed), []
        for sub in np.split(x, parts, axis=1):
            c = sub[rng.choice(len(sub), min(centroids, len(sub)), replace=False)]
            for _ in range(rounds):
                near = ((sub[:, None] - c[None]) ** 2).sum(-1).argmin(1)
                c = np.array([sub[near == i].mean(0) if (near == i).any() else c[i] for i in range(len(c))])
            books.append(c.tolist())
        return ProductQuantizer(books)

    def encode(self, c: Column) -> Column:
        width = len(self.books[0][0])
        out = []
        for p, book in enumerate(self.books):
            part = F.slice(c, p * width + 1, width)
            best = F.array_min(F.array(*[F.struct(euclidean_distance(part, _constant(v)).alias("d"), F.lit(i).alias("i")) for i, v in enumerate(book)]))
            out.append(best["i"])
        return F.array(*out)

    def distance(self, codes: Column, query) -> Column:
        """Euclidean, approximately: one lookup per part."""
        width, total = len(self.books[0][0]), F.lit(0.0)
        for p, book in enumerate(self.books):
            q = np.array(query[p * width : (p + 1) * width])
            total = total + F.element_at(_constant([float(((np.array(v) - q) ** 2).sum()) for v in book]), F.element_at(codes, p + 1) + 1)
        return F.sqrt(total)


def rescored_search(df: DataFrame, query, k: int, quantizer: ScalarQuantizer, factor: int = 4, column: str = "embedding", key: str = "id") -> DataFrame:
    """The k closest of the k x factor closest by their quantized vectors."""
    coarse = quantizer.decode(quantizer.encode(F.col(column)))
    first = df.withColumn("_d", euclidean_distance(coarse, _constant(query))).orderBy("_d", key).limit(k * factor)
    return search(first, query, k, column, key, "euclidean")


__all__ = ["CellIndex", "ProductQuantizer", "ScalarQuantizer", "batch_search", "binary_encode", "hamming_distance", "l2_norm", "rescored_search", "search", "vector_join"]
