"""What a job does while it runs: rows, failures and speed of its stages, and how far a stream is (UDF-4, STR-3)."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


@dataclass(frozen=True)
class Stage:
    """A step of a job; failed says which of its rows count as failures."""

    name: str
    step: Callable[[DataFrame], DataFrame]
    failed: Column | None = None


def run_observed(source: DataFrame, stages: list[Stage], path: str) -> tuple[DataFrame, DataFrame]:
    """(rows, report): the stages' result, written to a folder and read back, and stage, ord, rows, failures, seconds, rows_per_second.

    Counts are observed while the one job runs: nothing is read twice. Stages
    run into each other, so seconds are those of the whole job.
    """
    spark, seen = source.sparkSession, []
    df = source
    for stage in stages:
        one = Observation()
        df = stage.step(df)
        df = df.observe(one, F.count(F.lit(1)).alias("rows"), (F.count_if(stage.failed) if stage.failed is not None else F.count_if(F.lit(False))).alias("failures"))
        seen.append((stage.name, one))
    began = time.time()
    df.write.parquet(path)
    seconds = max(time.time() - began, 1e-9)
    report = [(name, k, one.get["rows"], one.get["failures"], seconds, one.get["rows"] / seconds) for k, (name, one) in enumerate(seen, 1)]
    return spark.read.schema(df.schema).parquet(path), spark.createDataFrame(report, "stage string, ord int, rows long, failures long, seconds double, rows_per_second double")


class _Listener(StreamingQueryListener):
    """The progress of each batch of each query, as it is reported."""

    def __init__(self) -> None:
        self.batches: dict[str, list[dict]] = {}

    def onQueryStarted(self, event) -> None:
        self.batches.setdefault(str(event.runId), [])

    def onQueryProgress(self, event) -> None:
        p = json.loads(event.progress.json)
        self.batches.setdefault(p["runId"], []).append({"batch": p["batchId"], "rows": p["numInputRows"], "seconds": p["batchDuration"] / 1000})

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def follow(start: Callable[[], "StreamingQuery"], spark: SparkSession, patience: float = 30) -> list[dict]:  # noqa: F821
    """batch, rows and seconds of each batch of a query that start() starts, in order, once it has ended."""
    listener = _Listener()
    spark.streams.addListener(listener)
    try:
        q = start()
        q.awaitTermination()
        last, until = max((p.batchId for p in q.recentProgress), default=-1), time.time() + patience
        # reports come on a thread of their own
        while last >= 0 and time.time() < until and not any(b["batch"] == last for b in listener.batches.get(str(q.runId), [])):
            time.sleep(0.05)
        return sorted(listener.batches.get(str(q.runId), []), key=lambda b: b["batch"])
    finally:
        spark.streams.removeListener(listener)


def progress(spark: SparkSession, batches: list[dict], total: int) -> DataFrame:
    """batch, rows, done, share, rows_per_second and eta_seconds after each batch of so many rows in all; no estimate before the first row."""
    out, done, spent = [], 0, 0.0
    for b in batches:
        done, spent = done + b["rows"], spent + b["seconds"]
        eta = spent / done * max(0, total - done) if done else None
        out.append((b["batch"], b["rows"], done, done / total if total else 1.0, done / spent if spent else None, eta))
    return spark.createDataFrame(out, "batch long, rows long, done long, share double, rows_per_second double, eta_seconds double")
