"""What the rest of the package needs to know about the cluster: shared folders, staged tables, placement."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as ``spark.checkpoint.dir`` names it.

    Where it is unset, a local session (tests, notebooks) gets a temporary folder of its own; a cluster is an error,
    since no folder of one machine would do there.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if found:
        if context.getCheckpointDir() is None:
            context.setCheckpointDir(found)
        return found.rstrip("/")
    if not context.master.startswith("local") or context.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    found = "file://" + tempfile.mkdtemp(prefix="arcweave-")
    _delete_at_exit(spark, found)
    context.setCheckpointDir(found)
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)


def new_folder(spark: SparkSession, label: str) -> str:
    """A name in the shared folder that nobody has used; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/arcweave-{label}-{uuid.uuid4().hex}"
    _delete_at_exit(spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_dropped(spark: SparkSession):
    """What is computed inside leaves no shuffle files behind: its result has been written, and nothing reads them again."""
    had = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, had)


_SPLITS = "spark.sql.files.minPartitionNum"


@contextmanager
def read_in_small_tasks(spark: SparkSession):
    """What is computed inside reads files in four tasks a core, if there are as many files: long and short ones even out."""
    had = spark.conf.get(_SPLITS, None)
    spark.conf.set(_SPLITS, 4 * spark.sparkContext.defaultParallelism)
    try:
        yield
    finally:
        if had is None:
            spark.conf.unset(_SPLITS)
        else:
            spark.conf.set(_SPLITS, had)


def staged(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write a table into the shared folder and read it back: the lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    ship(spark)
    path = new_folder(spark, label)
    with _shuffles_dropped(spark):
        df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def append(df: DataFrame, path: str) -> None:
    """Write a table's rows into a folder of the shared one, beside those that are there."""
    with _shuffles_dropped(df.sparkSession):
        df.write.mode("append").option("compression", "zstd").parquet(path)


def discard(*tables: DataFrame) -> None:
    """Remove staged tables that nothing will read again; others are left as they are."""
    for t in tables:
        if path := getattr(t, "_staged_at", None):
            remove(t.sparkSession, path)


#: Rows that a partition of a small table may have before it is written by more tasks.
SMALL_ROWS = 200_000


def checkpointed(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``checkpoint()`` in the shared folder; for small tables inside loops, Spark's cleaner removes the files.

    rows: a bound on the number of rows, if known; few rows are then written by few tasks.
    """
    shared_dir(df.sparkSession)
    if rows is not None and (n := rows // SMALL_ROWS + 1) < shuffle_partitions(df.sparkSession):
        df = df.coalesce(n)
    return df.checkpoint()


#: Rows of ids that a join may broadcast; some tens of bytes each.
BROADCAST_ROWS = 300_000


def join_ids(left: DataFrame, ids: DataFrame, on: list[str], how: str) -> DataFrame:
    """Join to a table of a few id columns: broadcast if its count is below BROADCAST_ROWS, by a shuffle beyond that."""
    small = ids.count() <= BROADCAST_ROWS
    return left.join(F.broadcast(ids) if small else ids.hint("merge"), on, how)


_shipped: set[str] = set()
#: Bytes of a batch that goes to a Python worker, in place of Spark's 64 MB: a worker holds several copies of it.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for an application, where they may not have it installed.

    Sets the size of batches, too, unless the session has one of its own.
    """
    context = spark.sparkContext
    if spark.conf.get(_BATCH, "67108864b") == "67108864b":
        spark.conf.set(_BATCH, BATCH_BYTES)
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="arcweave-ship-")) / "arcweave.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


#: Rows of a few ids that a partition of a large table has.
PARTITION_ROWS = 1_000_000


def partitions_for(spark: SparkSession, rows: int) -> int:
    """A number of partitions that grows with the rows once they are many, so that the memory of a task doesn't."""
    return max(min(shuffle_partitions(spark), rows // 100_000 + 1), rows // PARTITION_ROWS + 1)


def ranged(df: DataFrame, key: str, n: int) -> tuple[DataFrame, int]:
    """Add ``_bucket``: ranges of a BIGINT column in about equal numbers of rows, ascending, nulls first; and how many.

    The borders are found by a range exchange of the column alone and held as at most n longs, on the driver and in a
    broadcast; unlike those of a range exchange they are fixed, so that two uses of the frame agree.
    """
    mins = df.select(key).dropna().repartitionByRange(n, key).groupBy(F.spark_partition_id().alias("part")).agg(F.min(key).alias("least")).collect()
    borders = np.array(sorted(r["least"] for r in mins)[1:], np.int64)
    shared = df.sparkSession.sparkContext.broadcast(borders)

    @F.pandas_udf("int")
    def below(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, ids.to_numpy(np.int64), "right").astype(np.int32))

    return df.withColumn("_bucket", below(F.coalesce(F.col(key), F.lit(-(1 << 63))))), len(borders) + 1
