"""Caches with a time to live and token budgets: exact, over tables and over streams (STR-1, STR-2).

Over a table both come down to windows that begin anew at the first request
after their time is over, which pointer jumping finds for all clients at once;
over a stream each client has its state, and rows of a micro-batch are taken in
the order of their time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import windows as W

MICROS = 1_000_000
#: State of arbitrary keys lives in this store.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def budgeted(requests: DataFrame, seconds: int, limit: int) -> DataFrame:
    """client, id, window_start, tokens_left, limited, wait of requests (client, id, at in microseconds, cost) (STR-1).

    A window lasts so many seconds and starts anew at a client's first request
    after its end. tokens_left is what of the limit is there before a request; where
    nothing is left the request is limited: it spends nothing and would wait
    for so many microseconds. Costs are whole numbers, 0 or more; ids differ.
    """
    begins = W.restarts(requests, ["client"], "at", "id", seconds * MICROS).withColumn("_begins", F.lit(True))
    cut = W.sliced(requests.select("client", "id", "at", "cost").join(begins, "id", "left"), ["client"], ["at", "id"])
    spent = W.running(cut, ["client"], ["at", "id"], {"_to": ("sum", F.col("cost"))})
    before = F.col("_to") - F.col("cost")
    start = W.running(spent, ["client"], ["at", "id"], {"_from": ("max", F.when(F.col("_begins"), F.struct(F.col("at").alias("start"), F.col("id").alias("by"), before.alias("spent"))))})
    left = F.greatest(F.lit(0).cast("long"), F.lit(limit) - (before - F.col("_from.spent")))
    out = start.select("client", "id", F.col("_from.start").alias("window_start"), left.alias("tokens_left"), F.col("at"))
    limited = F.col("tokens_left") <= 0
    return out.select("client", "id", "window_start", "tokens_left", limited.alias("limited"), F.when(limited, F.col("window_start") + seconds * MICROS - F.col("at")).otherwise(0).cast("long").alias("wait"))


def cached(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """client, id, outcome of requests (client, key, id, at in microseconds) to a cache for each client (STR-2).

    hit: the key was stored less than so many seconds before. stored: it was
    not, and the cache held fewer than most keys. refused: it was not, and the
    cache was full; nothing is ever evicted, so a full cache stores no key
    again, not even one whose time is over. ids differ.
    """
    life = seconds * MICROS
    moment = F.struct("at", "id")
    firsts = requests.groupBy("client", "key").agg(F.min(moment).alias("_first"))
    ranked = W.placed(firsts.select("client", "key", F.col("_first.at").alias("_at"), F.col("_first.id").alias("_id")), ["client"], ["_at", "_id"], "_rank")
    kept = ranked.where(F.col("_rank") <= most).select(F.col("client").alias("_client"), F.col("key").alias("_key"), F.lit(True).alias("_in"))
    full = ranked.where(F.col("_rank") == most).select(F.col("client").alias("_fc"), F.struct(F.col("_at").alias("at"), F.col("_id").alias("id")).alias("_full"))
    known = requests.join(kept, F.col("client").eqNullSafe(F.col("_client")) & F.col("key").eqNullSafe(F.col("_key")), "left").join(full, F.col("client").eqNullSafe(F.col("_fc")), "left")
    rows = W.checkpointed(known.select("client", "key", "id", "at", F.col("_in").isNotNull().alias("_kept"), (F.col("_full").isNull() | (moment <= F.col("_full"))).alias("_open")))
    stores = W.restarts(rows.where("_kept AND _open"), ["client", "key"], "at", "id", life).withColumn("_stores", F.lit(True))
    cut = W.sliced(rows.where("_kept").join(stores, "id", "left"), ["client", "key"], ["at", "id"])
    last = W.running(cut, ["client", "key"], ["at", "id"], {"_since": ("max", F.when(F.col("_stores"), F.col("at")))})
    outcome = F.when(F.col("_stores"), "stored").when(F.col("at") - F.col("_since") < life, "hit").otherwise("refused")
    return last.select("client", "id", outcome.alias("outcome")).unionByName(rows.where("NOT _kept").select("client", "id", F.lit("refused").alias("outcome")))


class _Budget(StatefulProcessor):
    """Start and spending of a client's window; a timer at its end clears them."""

    def __init__(self, seconds: int, limit: int):
        self.length, self.limit = seconds * MICROS, limit

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", "start long, spent long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        start, spent = self.window.get() or (None, 0)
        began = start
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            if start is None or r["at"] - start >= self.length:
                start, spent = r["at"], 0
            left = max(0, self.limit - spent)
            yield Row(client=key[0], id=r["id"], window_start=start, tokens_left=left, limited=left == 0, wait=start + self.length - r["at"] if left == 0 else 0)
            spent += r["cost"] if left else 0
        self.window.update((start, spent))
        if start != began:
            self.handle.registerTimer(-(-(start + self.length) // 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if (now := self.window.get()) and now[0] + self.length <= expiredTimerInfo.getExpiryTimeInMs() * 1000:
            self.window.clear()
        return iter(())

    def close(self) -> None:
        pass


class _Cache(StatefulProcessor):
    """When each key of a client's cache was stored; at most `most` keys."""

    def __init__(self, seconds: int, most: int):
        self.life, self.most = seconds * MICROS, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "key string", "since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {k[0]: v[0] for k, v in self.entries.iterator()}
        new = {}
        for r in sorted(rows, key=lambda r: (r["at"], r["id"])):
            name = r["key"]
            if name in held and r["at"] - held[name] < self.life:
                outcome = "hit"
            elif len(held) < self.most:
                held[name] = new[name] = r["at"]
                outcome = "stored"
            else:
                outcome = "refused"
            yield Row(client=key[0], id=r["id"], outcome=outcome)
        for name, since in new.items():
            self.entries.updateValue((name,), (since,))

    def close(self) -> None:
        pass


def _with_store(stream: DataFrame) -> None:
    stream.sparkSession.conf.set(*STATE_STORE)


def budgeted_stream(requests: DataFrame, seconds: int, limit: int) -> DataFrame:
    """budgeted() of a stream with a watermark on a timestamp; a micro-batch's rows of a client are ordered in memory, so bound it where the source is read."""
    _with_store(requests)
    return requests.groupBy("client").transformWithState(_Budget(seconds, limit), "client long, id long, window_start long, tokens_left long, limited boolean, wait long", "Append", "EventTime")


def cached_stream(requests: DataFrame, seconds: int, most: int) -> DataFrame:
    """cached() of a stream; a client's state is at most `most` keys. A micro-batch's rows of a client are ordered in memory, so bound it where the source is read."""
    _with_store(requests)
    return requests.groupBy("client").transformWithState(_Cache(seconds, most), "client long, id long, outcome string", "Append", "None")
