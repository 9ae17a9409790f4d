"""Scalar and aggregate functions of the query languages by lower-cased name, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcweave.functions import vectors as V


def list_index(x: Column, i: Column) -> Column:
    """0-based, negative from the end; null outside."""
    return F.try_element_at(x, F.when(i < 0, i).otherwise(i + 1).cast("int"))


def _bool(x: Column) -> Column:
    low = F.lower(x.cast("string"))
    return F.when(low == "true", True).when(low == "false", False)


def regex_test(text: Column, pattern: Column, constant: str | None = None) -> Column:
    """Whether a pattern is found in the text; null for a constant that is no pattern."""
    if constant is not None:
        jvm = SparkSession.active().sparkContext._jvm
        try:
            jvm.java.util.regex.Pattern.compile(constant)
        except (Py4JJavaError, IllegalArgumentException):
            return F.lit(None).cast("boolean")
    return F.rlike(text, pattern)


SCALARS: dict[str, Callable[..., Column]] = {
    "coalesce": lambda *a: F.coalesce(*a),
    "exists": lambda x: x.isNotNull(),
    "tostring": lambda x: x.cast("string"),
    "tointeger": lambda x: x.try_cast("bigint"),
    "toint": lambda x: x.try_cast("bigint"),
    "tofloat": lambda x: x.try_cast("double"),
    "toboolean": _bool,
    "tobool": _bool,
    "head": lambda x: F.try_element_at(x, F.lit(1)),
    "last": lambda x: F.try_element_at(x, F.lit(-1)),
    "tail": lambda x: F.slice(x, 2, F.greatest(F.size(x), F.lit(0))),
    "reverse": lambda x: F.reverse(x),
    "range": lambda a, b, *s: F.sequence(a, b, *s),
    "vector": lambda x: x.cast("array<float>"),
    "cosine_similarity": V.cosine_similarity,
    "euclidean_distance": V.euclidean_distance,
    "dot_product": V.dot_product,
    "manhattan_distance": V.manhattan_distance,
    # beyond the reference's closed list
    "abs": F.abs, "ceil": F.ceil, "ceiling": F.ceil, "floor": F.floor, "round": F.round, "sqrt": F.sqrt, "sign": F.signum,
    "upper": F.upper, "toupper": F.upper, "lower": F.lower, "tolower": F.lower, "trim": F.trim, "ltrim": F.ltrim, "rtrim": F.rtrim,
    "replace": lambda s, a, b: F.replace(s, a, b),
    "split": lambda s, d: F.split(s, F.concat(F.lit("\\Q"), d, F.lit("\\E"))),
    "substring": lambda s, i, n=None: F.substring(s, i + 1, n if n is not None else F.char_length(s)),
    "left": lambda s, n: F.left(s, n),
    "right": lambda s, n: F.right(s, n),
    "year": F.year, "month": F.month, "day": F.dayofmonth, "date": F.to_date,
}


def percentile_disc(x: Column, p: Column) -> Column:
    """The element at floor(p (n - 1)) of the sorted values."""
    values = F.array_sort(F.collect_list(x))
    return F.try_element_at(values, (F.floor(p * (F.size(values) - 1)) + 1).cast("int"))


def _collect(x: Column, distinct: bool) -> Column:
    return F.array_sort(F.collect_set(x) if distinct else F.collect_list(x))


AGGREGATES: dict[str, Callable[..., Column]] = {
    "count": lambda x, d: F.count_distinct(x) if d else F.count(x),
    "sum": lambda x, d: F.coalesce(F.sum_distinct(x) if d else F.sum(x), F.lit(0)),
    "avg": lambda x, d: F.sum_distinct(x) / F.count_distinct(x) if d else F.avg(x),
    "mean": lambda x, d: F.sum_distinct(x) / F.count_distinct(x) if d else F.avg(x),
    "min": lambda x, d: F.min(x),
    "max": lambda x, d: F.max(x),
    "collect": _collect,
    "collect_list": _collect,
    "first": lambda x, d: F.first(x, ignorenulls=True),
    "last_value": lambda x, d: F.last(x, ignorenulls=True),  # "last" is the last element of a list
    "stdev": lambda x, d: F.stddev_samp(x),
    "stdevp": lambda x, d: F.stddev_pop(x),
    "percentile_disc": lambda x, p, d: percentile_disc(x, p),
    "percentiledisc": lambda x, p, d: percentile_disc(x, p),
    "percentile_cont": lambda x, p, d: F.percentile(x, p),
    "percentilecont": lambda x, p, d: F.percentile(x, p),
}
