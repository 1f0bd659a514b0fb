"""Budgets and caches over tables and streams against plain folds; running folds; late rows; observed jobs."""

import random

import pytest
from loomgraph.operators import observed
from loomgraph.operators import windows as W
from loomgraph.streaming import events, stateful
from pyspark.sql import functions as F

S = stateful.MICROS
SCHEMA = "client long, key string, id long, at long, cost long, ts timestamp"


def made(r, n, clients):
    """Requests with ties, bursts and one client that makes most of them."""
    rows, at = [], 0
    for k in range(n):
        at += r.choice([0, 0, S // 2, S, 5 * S, 40 * S])
        rows.append((0 if r.random() < 0.7 else r.randrange(clients), r.choice("abcdefgh"), k, at, r.choice([0, 1, 5, 30]), None))
    return rows


def budget(rows, seconds, limit):
    state, out = {}, {}
    for c, _, i, at, cost, _ in sorted(rows, key=lambda x: (x[3], x[2])):
        start, spent = state.get(c, (None, 0))
        if start is None or at - start >= seconds * S:
            start, spent = at, 0
        out[i] = (c, start, max(0, limit - spent), spent >= limit, start + seconds * S - at if spent >= limit else 0)
        state[c] = start, spent + (0 if spent >= limit else cost)
    return out


def cache(rows, seconds, most):
    held, out = {}, {}
    for c, key, i, at, _, _ in sorted(rows, key=lambda x: (x[3], x[2])):
        mine = held.setdefault(c, {})
        if key in mine and at - mine[key] < seconds * S:
            out[i] = c, "hit"
        elif len(mine) < most:
            mine[key] = at
            out[i] = c, "stored"
        else:
            out[i] = c, "refused"
    return out


@pytest.mark.parametrize("n, seconds, limit", [(0, 60, 10), (600, 60, 60), (600, 100_000, 200)])
def test_budget_is_a_fold(spark, n, seconds, limit):
    rows = made(random.Random(n + limit), n, 4)
    got = stateful.budgeted(spark.createDataFrame(rows, SCHEMA).repartition(5), seconds, limit).collect()
    assert {r.id: (r.client, r.window_start, r.tokens_left, r.limited, r.wait) for r in got} == budget(rows, seconds, limit)


@pytest.mark.parametrize("n, seconds, most", [(0, 60, 3), (600, 60, 3), (300, 5, 1)])
def test_cache_is_a_fold(spark, n, seconds, most):
    rows = made(random.Random(n + most), n, 4)
    got = stateful.cached(spark.createDataFrame(rows, SCHEMA).repartition(5), seconds, most).collect()
    assert {r.id: (r.client, r.outcome) for r in got} == cache(rows, seconds, most)


def test_streams_keep_their_state_between_batches(spark, tmp_path):
    """Requests in files of an order; a window and a cache live on from one to the next."""
    rows = made(random.Random(9), 240, 3)
    df = spark.createDataFrame(rows, SCHEMA).select("client", "key", "id", "at", "cost", F.timestamp_micros("at").alias("ts"), F.floor(F.col("id") / 60).alias("arrival"))
    path = events.arrivals(df, "arrival", f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(f"{SCHEMA}, arrival long").option("maxFilesPerTrigger", 1).parquet(path)
    got = events.run_to_table(spark, stateful.budgeted_stream(stream().withWatermark("ts", "1 minute"), 60, 60), f"{tmp_path}/b", "append").collect()
    assert {r.id: (r.client, r.window_start, r.tokens_left, r.limited, r.wait) for r in got} == budget(rows, 60, 60)
    got = events.run_to_table(spark, stateful.cached_stream(stream(), 60, 3), f"{tmp_path}/c", "append").collect()
    assert {r.id: (r.client, r.outcome) for r in got} == cache(rows, 60, 3)


def test_running_folds_of_a_hot_key(spark):
    r = random.Random(4)
    rows = [(r.choice([None, "a", "a", "a", "b"]), k, r.choice([None, r.randrange(100)])) for k in range(500)]
    cut = W.sliced(spark.createDataFrame(rows, "k string, id long, v long"), ["k"], ["id"])
    got = W.running(cut, ["k"], ["id"], {"s": ("sum", F.col("v")), "m": ("max", F.col("v")), "l": ("min", F.col("v"))}, {"s": "all"}).collect()
    assert cut.select("_slice").distinct().count() > 1
    for x in got:
        mine = [v for k, i, v in rows if k == x.k and i <= x.id and v is not None]
        every = [v for k, _, v in rows if k == x.k and v is not None]
        assert (x.s, x.m, x.l, x["all"]) == (sum(mine), max(mine, default=None), min(mine, default=None), sum(every))


def test_late_rows_are_dropped_and_counted(spark, tmp_path):
    """Batches of an hour; rows of the first hour that come with the fourth batch are late, with the second they are not."""
    rows = [(k, 3600 * b + 60 * k, b) for b in range(4) for k in range(5)] + [(90, 10, 3), (91, 20, 3), (92, 30, 1)]
    df = spark.createDataFrame(rows, "event_id long, at long, arrival long").select("event_id", F.timestamp_seconds("at").cast("timestamp_ntz").alias("ts"), F.lit(1).cast("long").alias("user_id"), F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"), "arrival")
    path = events.arrivals(df, "arrival", f"{tmp_path}/in")
    counts, progress = events.run_updates(spark, events.counts_in_time(events.arriving(spark, path, "arrival"), 600, "1 minute"), f"{tmp_path}/out", "window_start")
    assert {r.window_start: r.n for r in counts.collect()} == {0: 6, 3600: 5, 7200: 5, 10800: 5}
    assert events.late_rows(progress) == 1  # both rows are of one window


def test_a_batch_that_runs_again_doubles_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, 0), (2, 1)], "id long, arrival long")
    path = events.arrivals(df, "arrival", f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, arrival long").option("maxFilesPerTrigger", 1).parquet(path).select("id")
    assert events.run_to_table(spark, stream(), f"{tmp_path}/out", "append").count() == 2
    # the state is lost, the table is not: all batches run again
    import shutil

    shutil.rmtree(f"{tmp_path}/out/state")
    assert events.run_to_table(spark, stream(), f"{tmp_path}/out", "append").count() == 2


def test_observed_stages(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame([(k, None if k % 5 == 0 else "x") for k in range(50)], "k long, t string")
    stages = [observed.Stage("read", lambda d: d.mapInArrow(count, d.schema), F.col("t").isNull()), observed.Stage("kept", lambda d: d.where("t IS NOT NULL")), observed.Stage("wide", lambda d: d.select("k", F.explode(F.array(F.lit(1), F.lit(2))).alias("n")))]
    rows, report = observed.run_observed(df, stages, f"{tmp_path}/out")
    assert rows.count() == 80
    assert [(r.stage, r.rows, r.failures) for r in report.orderBy("ord").collect()] == [("read", 50, 10), ("kept", 40, 0), ("wide", 80, 0)]
    assert seen.value == 50  # one pass


def test_progress_estimates(spark):
    p = observed.progress(spark, [{"batch": 0, "rows": 0, "seconds": 1.0}, {"batch": 1, "rows": 10, "seconds": 1.0}, {"batch": 2, "rows": 30, "seconds": 2.0}], 80).collect()
    assert [(r.done, r.share, r.rows_per_second, r.eta_seconds) for r in p] == [(0, 0.0, 0.0, None), (10, 0.125, 5.0, 14.0), (40, 0.5, 10.0, 4.0)]
