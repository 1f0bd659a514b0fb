"""The folder that driver and executors share, cutting lineage there, and the size of Arrow batches."""

from __future__ import annotations

import gc
import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of an Arrow batch of whole texts: they bound a worker's memory.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20
#: Bytes of a table's files, columnar and compressed, for which a shuffle of its rows has a partition: they bound a task's memory.
PART_BYTES = 16 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, or that of the session; one of our own only in local mode, where driver and executors are one process."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix=f"loomgraph-{uuid.uuid4().hex[:8]}-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def checkpointed(df: DataFrame) -> DataFrame:
    """The rows as they are now, written where all executors find them."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows as they are now, in compressed columns where all executors find them: a small part of a checkpoint's bytes, but how they were dealt out is lost."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small; smaller settings of the session stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(f"spark.sql.execution.arrow.{key}").rstrip("bB")
        if not (now.isdigit() and 0 < int(now) <= most):
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def parts_of(rows: DataFrame) -> int:
    """The partitions that the files behind rows ask for."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    # other leaves do not know their size
    files = [x for x in map(leaves.apply, range(leaves.size())) if x.getClass().getSimpleName() == "LogicalRelation"]
    return math.ceil(sum(int(str(x.stats().sizeInBytes())) for x in files) / PART_BYTES)


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys to as many partitions as the files behind them ask for; as they are if the session's shuffles have no fewer."""
    parts = parts_of(rows)
    return rows.repartition(parts, *keys) if parts > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows


def at_rest(rows: DataFrame, key: str, write: Callable[[DataFrame], DataFrame] = checkpointed) -> DataFrame:
    """rows dealt by a key and in its order, checkpointed: what meets them by the key in rounds moves, they don't."""
    conf, adaptive = rows.sparkSession.conf, "spark.sql.adaptive.enabled"
    parts = max(parts_of(rows), int(conf.get("spark.sql.shuffle.partitions")))
    was = conf.get(adaptive)
    # an adaptive plan does not say how its rows are dealt, so a checkpoint of it doesn't either
    conf.set(adaptive, "false")
    try:
        return write(rows.repartition(parts, key).sortWithinPartitions(key))
    finally:
        conf.set(adaptive, was)


def swept(df: DataFrame) -> DataFrame:
    """df; the shuffles of rounds before, which nothing refers to any more, may go from the disks now."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return df
