"""Structured Streaming forms of what depends on time (STR-1..5)."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, path: str, schema: str = SCHEMA) -> DataFrame:
    """A file stream of events; ts as a timestamp, which watermarks ask for. The session's zone should be UTC."""
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def rate_windows(events: DataFrame, seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """window_start, n, budget spent in each window (STR-1, STR-5)."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("budget"))
    return g.select(F.unix_timestamp("w.start").alias("window_start"), "n", "budget")


def once_per(events: DataFrame, keys: list[str], ttl: str = "1 hour") -> DataFrame:
    """The first event of each key within a time to live (STR-2); batches need no state for that."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(keys)


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """user_id, start, n of each user's sessions."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    g = timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.unix_timestamp("w.start").alias("start"), "n")


def run_to_table(spark: SparkSession, df: DataFrame, path: str, mode: str = "complete") -> DataFrame:
    """Run a stream over all that is there, into a table; the table read back.

    A batch is written to a folder of its own by its number, or in complete
    mode over what was there, so a batch that runs again doubles nothing.
    """
    names, schema = df.columns, df.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table" if mode == "complete" else f"{path}/table/_batch_no={number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{path}/table").select(*names)


def arrivals(rows: DataFrame, by: str, path: str) -> str:
    """Rows as files in order of arrival (a small whole number), one for each, as a file stream with maxFilesPerTrigger=1 reads them."""
    spark = rows.sparkSession
    rows.repartition(by).write.partitionBy(by).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    found = sorted((int(f.getPath().getName().partition("=")[2]), f.getPath()) for f in fs.listStatus(folder) if f.isDirectory())
    for number, one in found:
        for f in fs.listStatus(one):
            fs.setTimes(f.getPath(), 1_700_000_000_000 + number * 60_000, -1)
    return path


def arriving(spark: SparkSession, path: str, by: str, schema: str = SCHEMA) -> DataFrame:
    """arrivals() as a stream, a file in each batch."""
    source = spark.readStream.schema(f"{schema}, {by} long").option("maxFilesPerTrigger", 1).parquet(path)
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


def counts_in_time(events: DataFrame, seconds: int, late: str) -> DataFrame:
    """window_start, n of the events of each window that came before the watermark had passed its end (STR-5).

    Rows that come later are left out. A batch's rows are judged by the
    watermark that the batch before it worked with.
    """
    g = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.unix_timestamp("w.start").alias("window_start"), "n")


def run_updates(spark: SparkSession, df: DataFrame, path: str, key: str) -> tuple[DataFrame, list[dict]]:
    """Run a stream in update mode; the last row of each key, and the progress of each batch."""
    names, schema = df.columns, df.schema

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/table/_batch_no={number}")

    q = df.writeStream.outputMode("update").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).foreachBatch(put).start()
    q.awaitTermination()
    rows = spark.read.schema(schema).parquet(f"{path}/table")
    last = rows.groupBy(key).agg(F.max_by(F.struct(*names), "_batch_no").alias("_r")).select("_r.*")
    return last, [json.loads(p.json) for p in q.recentProgress]


def late_rows(progress: list[dict]) -> int:
    """Rows, summed up to a row for each group and task, that stateful operators left out as too late."""
    return sum(o.get("numRowsDroppedByWatermark", 0) for p in progress for o in p["stateOperators"])


def budget_ok(seconds: float, limit: int) -> Callable[[float, int], bool]:
    """An exact fixed-window budget for one client: the window starts anew when its time is over (STR-1)."""
    state = {"start": None, "spent": 0}

    def allow(now: float, cost: int) -> bool:
        if state["start"] is None or now - state["start"] >= seconds:
            state.update(start=now, spent=0)
        if state["spent"] + cost > limit:
            return False
        state["spent"] += cost
        return True

    return allow


def memory_advice(samples: DataFrame, key: str, value: str, most: float, watch: float) -> DataFrame:
    """key, peak, advice: collect above most, watch above a lower mark, else fine (STR-4); of a table or a stream."""
    peak = F.max(value)
    return samples.groupBy(key).agg(peak.alias("peak"), F.when(peak > most, "collect").when(peak > watch, "watch").otherwise("fine").alias("advice"))
