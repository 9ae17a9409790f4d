"""Connected components by contraction, in DataFrame operations throughout."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arcweave.algorithms import compact
from arcweave.cluster import checkpointed


def smallest_member(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """For every BIGINT id that an edge names: ``id`` and ``component``, the smallest id it is connected to.

    Each round hooks every node to its smallest neighbour, shortens the chains of hooks by pointer jumping and puts
    the roots in place of the nodes. A hub costs one joined row an edge, and what is left shrinks by half or more a
    round, so that the number of rounds grows with the logarithm of the input. What is no more than compact.ONE_TASK
    edges is finished in one task. Edges with a null end and self-loops connect nothing; self-loops still name their node.
    """
    named = edges.select(F.col(src).cast("bigint").alias("a"), F.col(dst).cast("bigint").alias("b")).where("a is not null and b is not null")
    named = checkpointed(named.distinct())
    n = named.count()
    if n <= compact.ONE_TASK:
        return checkpointed(compact.in_one_task(named, compact.components, "id long, component long"))
    label = checkpointed(named.select(F.explode(F.array("a", "b")).alias("id")).distinct().withColumn("component", F.col("id")), 2 * n)
    left = checkpointed(named.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), n)
    while left_rows := left.count():
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        if left_rows <= compact.ONE_TASK:
            hook = checkpointed(compact.in_one_task(left, compact.components, "a long, p long"))
        else:
            hook = checkpointed(both.groupBy("a").agg(F.min("b").alias("p")).select("a", F.least("a", "p").alias("p")), 2 * left_rows)
        while left_rows > compact.ONE_TASK:
            up = hook.select(F.col("a").alias("p"), F.col("p").alias("up"))
            jumped = checkpointed(hook.join(up, "p").select("a", F.col("up").alias("p"), (F.col("up") < F.col("p")).alias("moved")), 2 * left_rows)
            hook = jumped.select("a", "p")
            if jumped.where("moved").isEmpty():
                break
        label = checkpointed(
            label.join(hook.select(F.col("a").alias("component"), "p"), "component", "left").select("id", F.coalesce("p", "component").alias("component")), 2 * n
        )
        far = hook.select(F.col("a").alias("b"), F.col("p").alias("q"))
        left = checkpointed(
            left.join(hook, "a").join(far, "b").where("p <> q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct(), left_rows
        )
    return label
