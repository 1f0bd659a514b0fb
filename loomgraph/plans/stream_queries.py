"""Queries for caches, budgets, late rows and progress."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import domains
from ..kg import table
from ..operators import observed
from ..streaming import events, stateful
from .registry import query
from .sink_queries import folder
from .text_queries import FOUND, PROSE

DAY = 86_400


def requests(events_table, client: str, key: str = "event_type"):
    """Events as requests of a client: when, for what, and at what cost in tokens."""
    return events_table.selectExpr(f"{client} AS client", f"{key} AS key", "event_id AS id", "unix_micros(cast(ts AS timestamp)) AS at", "cast(floor(value) AS long) AS cost", "cast(ts AS timestamp) AS ts")


def _budget_sql(client: str, seconds: int, limit: int) -> str:
    """A fold of each client's requests in order."""
    length, over = seconds * 1_000_000, f"o.us - f.start >= {seconds * 1_000_000}"
    return f"""WITH RECURSIVE o AS (SELECT {client} AS client, event_id AS id, epoch_us(ts) AS us, CAST(floor(value) AS BIGINT) AS cost, row_number() OVER (PARTITION BY {client} ORDER BY ts, event_id) AS n FROM events),
f(client, id, n, us, start, spent, cost) AS (SELECT client, id, n, us, us, CAST(0 AS BIGINT), cost FROM o WHERE n = 1 UNION ALL
  SELECT o.client, o.id, o.n, o.us, CASE WHEN {over} THEN o.us ELSE f.start END, CASE WHEN {over} THEN 0 ELSE f.spent + CASE WHEN f.spent >= {limit} THEN 0 ELSE f.cost END END, o.cost FROM f JOIN o ON o.client = f.client AND o.n = f.n + 1)
SELECT client, id, start AS window_start, greatest({limit} - spent, 0) AS tokens_left, spent >= {limit} AS limited, CASE WHEN spent >= {limit} THEN start + {length} - us ELSE 0 END AS wait FROM f"""


@query("str1_exact_budget", _budget_sql("user_id", 5 * DAY, 300))
def _(spark, d):
    return stateful.budgeted(requests(table(spark, d, "events"), "user_id"), 5 * DAY, 300)


@query("str1_exact_budget_of_types", _budget_sql("event_type", 6 * 3600, 500))
def _(spark, d):
    """Five clients with a fifth of all requests each: none is counted in one task."""
    return stateful.budgeted(requests(table(spark, d, "events"), "event_type"), 6 * 3600, 500)


@query("str1_streamed_budget", _budget_sql("user_id", 5 * DAY, 300))
def _(spark, d):
    stream = requests(events.stream(spark, f"{d}/events.parquet"), "user_id").withWatermark("ts", "1 hour")
    return events.run_to_table(spark, stateful.budgeted_stream(stream, 5 * DAY, 300), folder(spark), "append")


def _cache_sql(client: str, key: str, seconds: int, most: int) -> str:
    """A fold of each client's requests over the list of what its cache holds."""
    hit = f"len(list_filter(f.held, lambda x: x.k = o.key AND o.us - x.t < {seconds * 1_000_000})) > 0"
    return f"""WITH RECURSIVE o AS (SELECT {client} AS client, {key} AS key, event_id AS id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY {client} ORDER BY ts, event_id) AS n FROM events),
f(client, id, n, held, outcome) AS (SELECT client, id, n, [{{'k': key, 't': us}}], 'stored' FROM o WHERE n = 1 UNION ALL
  SELECT o.client, o.id, o.n, CASE WHEN {hit} OR len(f.held) >= {most} THEN f.held ELSE list_append(list_filter(f.held, lambda x: x.k <> o.key), {{'k': o.key, 't': o.us}}) END,
    CASE WHEN {hit} THEN 'hit' WHEN len(f.held) >= {most} THEN 'refused' ELSE 'stored' END FROM f JOIN o ON o.client = f.client AND o.n = f.n + 1)
SELECT client, id, outcome FROM f"""


@query("str2_ttl_cache", _cache_sql("event_type", "CAST(json_extract(props, '$.k') AS VARCHAR)", DAY, 70))
def _(spark, d):
    """Five caches of 70 answers with a fifth of all requests each."""
    return stateful.cached(requests(table(spark, d, "events"), "event_type", "get_json_object(props, '$.k')"), DAY, 70)


@query("str2_streamed_ttl_cache", _cache_sql("user_id", "event_type", 2 * DAY, 3))
def _(spark, d):
    stream = requests(events.stream(spark, f"{d}/events.parquet"), "user_id")
    return events.run_to_table(spark, stateful.cached_stream(stream, 2 * DAY, 3), folder(spark), "append")


#: Five days a batch; some events come one or two batches later.
ARRIVAL = "cast(floor((unix_timestamp(cast(ts AS timestamp)) - 1704067200) / 432000) AS long) + CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 1 ELSE 0 END"
_ARRIVED = "WITH a AS (SELECT *, CAST(floor((epoch(date_trunc('second', ts)) - 1704067200) / 432000) AS BIGINT) + CASE WHEN event_id % 17 = 0 THEN 2 WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS arrival FROM events)"


def arrivals(spark, d) -> str:
    return events.arrivals(table(spark, d, "events").withColumn("arrival", F.expr(ARRIVAL)), "arrival", f"{folder(spark)}/arrivals")


@query("str5_late_rows", f"""{_ARRIVED}, b AS (SELECT DISTINCT arrival FROM a), w AS (SELECT b.arrival, max(a.ts) - INTERVAL '1 day' AS mark FROM b JOIN (SELECT arrival, dense_rank() OVER (ORDER BY arrival) AS r FROM b) q ON q.arrival = b.arrival JOIN (SELECT a.ts, dense_rank() OVER (ORDER BY a.arrival) AS r FROM a) a ON a.r <= q.r - 2 GROUP BY b.arrival),
x AS (SELECT epoch(time_bucket(INTERVAL '21600 seconds', ts))::BIGINT AS window_start, w.mark IS NOT NULL AND time_bucket(INTERVAL '21600 seconds', ts) + INTERVAL '21600 seconds' <= w.mark AS late FROM a LEFT JOIN w ON w.arrival = a.arrival)
SELECT window_start, count_if(NOT late) AS n, count_if(late) AS late FROM x GROUP BY window_start""")
def _(spark, d):
    """Windows of six hours with the events that came in time and the number of those that came too late."""
    path = arrivals(spark, d)
    counted, _ = events.run_updates(spark, events.counts_in_time(events.arriving(spark, path, "arrival"), 21_600, "1 day"), folder(spark), "window_start")
    every = spark.read.parquet(path).groupBy(F.window(F.col("ts").cast("timestamp"), "21600 seconds").alias("w")).agg(F.count(F.lit(1)).alias("_all"))
    every = every.select(F.unix_timestamp("w.start").alias("window_start"), "_all").join(counted, "window_start", "left")
    n = F.coalesce("n", F.lit(0))
    return every.select("window_start", n.alias("n"), (F.col("_all") - n).alias("late"))


@query("str3_batch_progress", f"{_ARRIVED}, b AS (SELECT arrival, count(*) AS rows FROM a GROUP BY arrival) SELECT row_number() OVER (ORDER BY arrival) - 1 AS batch, rows, CAST(sum(rows) OVER (ORDER BY arrival) AS BIGINT) AS done, round(sum(rows) OVER (ORDER BY arrival) / (SELECT count(*) FROM a), 6) AS share, true AS timed FROM b")
def _(spark, d):
    """A stream's batches as its listener saw them: rows, how far it is, and whether speed and remaining time are known."""
    path, out = arrivals(spark, d), folder(spark)
    start = lambda: events.arriving(spark, path, "arrival").writeStream.format("noop").option("checkpointLocation", out).trigger(availableNow=True).start()
    p = observed.progress(spark, observed.follow(start, spark), spark.read.parquet(path).count()).where("rows > 0")
    return p.select("batch", "rows", "done", F.round("share", 6).alias("share"), ((F.col("rows_per_second") > 0) & (F.col("eta_seconds") >= 0)).alias("timed"))


@query("udf4_observed_stages", f"{FOUND}, w AS (SELECT CASE WHEN coalesce(text, '') = '' THEN 0 ELSE 1 END AS ok FROM documents) SELECT 'texts' AS stage, count(*) AS rows, count_if(ok = 0) AS failures, true AS timed FROM w UNION ALL SELECT 'mentions', count(*), count_if(type = 'NUMBER'), true FROM m UNION ALL SELECT 'names', count(*), 0, true FROM m WHERE type = 'NAME'")
def _(spark, d):
    """One job over all texts; its stages are observed while it runs."""
    from ..operators import extraction

    stages = [
        observed.Stage("texts", lambda x: x.select("doc_id", "text"), F.coalesce("text", F.lit("")) == ""),
        observed.Stage("mentions", lambda x: extraction.mentions(x, "doc_id", PROSE), F.col("type") == "NUMBER"),
        observed.Stage("names", lambda x: x.where("type = 'NAME'")),
    ]
    _, report = observed.run_observed(table(spark, d, "documents"), stages, f"{folder(spark)}/names")
    return report.select("stage", "rows", "failures", (F.col("rows_per_second") >= 0).alias("timed"))


@query("udf4_failing_calls", "SELECT 'calls' AS stage, count(*) AS rows, count_if(coalesce(text, '') = '') AS failures FROM documents")
def _(spark, d):
    """A caller's function of each text: how many calls were made, and how many failed, without a second pass."""
    from .domain_queries import first_words

    calls = observed.Stage("calls", lambda x: domains.extract_with(x, "doc_id", first_words), F.col("error").isNotNull())
    _, report = observed.run_observed(table(spark, d, "documents").select("doc_id", "text"), [calls], f"{folder(spark)}/calls")
    return report.select("stage", "rows", "failures")
