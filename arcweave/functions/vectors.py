"""Vector expressions over ARRAY<FLOAT|DOUBLE> columns; null where the lengths differ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _fold(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda s, x: s + x)


def _double(a: Column) -> Column:
    return a.cast("array<double>")


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value)


def dot_product(a: Column, b: Column) -> Column:
    return _same(a, b, _fold(F.zip_with(_double(a), _double(b), lambda x, y: x * y)))


def l2_norm(a: Column) -> Column:
    return F.sqrt(_fold(F.transform(_double(a), lambda x: x * x)))


def normalize(a: Column) -> Column:
    n = l2_norm(a)
    return F.when(n > 0, F.transform(_double(a), lambda x: x / n)).otherwise(_double(a))


def cosine_similarity(a: Column, b: Column) -> Column:
    n = l2_norm(a) * l2_norm(b)
    return F.when(n > 0, dot_product(a, b) / n).when(F.size(a) == F.size(b), F.lit(0.0))


def squared_euclidean(a: Column, b: Column) -> Column:
    return _same(a, b, _fold(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y))))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan_distance(a: Column, b: Column) -> Column:
    return _same(a, b, _fold(F.zip_with(_double(a), _double(b), lambda x, y: F.abs(x - y))))


#: Distances, smaller is closer.
METRICS = {
    "cosine": lambda a, b: 1 - cosine_similarity(a, b),
    "euclidean": euclidean_distance,
    "l2": euclidean_distance,
    "dot": lambda a, b: -dot_product(a, b),
    "dot_product": lambda a, b: -dot_product(a, b),
    "inner_product": lambda a, b: -dot_product(a, b),
    "manhattan": manhattan_distance,
    "l1": manhattan_distance,
}
