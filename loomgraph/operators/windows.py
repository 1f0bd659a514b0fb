"""Ordered operators as windows and folds (WIN-1..11, TOP-1..9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpointed


def ranked(rows: DataFrame, keys: list[str], order: list, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def slices(rows: DataFrame) -> int:
    """Ranges that a table is cut into: as many as the session's shuffles have partitions, so they follow the cluster and the data."""
    return max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def sliced(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """rows with _slice, their range of the whole order by keys; checkpointed, as ranges are drawn anew by each run."""
    cut = rows.repartitionByRange(slices(rows), *keys, *order).withColumn("_slice", F.spark_partition_id())
    return checkpointed(cut)


_FOLDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest), "min": (F.min, F.least)}


def running(cut: DataFrame, keys: list[str], order: list, folds: dict[str, tuple[str, Column]], totals: dict[str, str] | None = None) -> DataFrame:
    """sliced() rows with running sums, maxima or minima (name: (fold, column)) of their key up to each row.

    No key is folded in one task: rows are folded within their range, and what
    the ranges before bring is folded over one row of a key and range. The
    order must be total but for rows that are alike. totals: further columns
    with a fold's value over the whole key, by the name of the fold.
    """
    own = Window.partitionBy(*keys, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = cut.groupBy(*keys, "_slice").agg(*(_FOLDS[f][0](c).alias(f"_t_{n}") for n, (f, c) in folds.items()))
    w = Window.partitionBy(*keys)  # a row for each range of a key
    before = w.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        *(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)),
        F.col("_slice").alias("_s"),
        *(_FOLDS[f][0](f"_t_{n}").over(before).alias(f"_b_{n}") for n, (f, _) in folds.items()),
        *(_FOLDS[folds[n][0]][0](f"_t_{n}").over(w).alias(f"_a_{n}") for n in (totals or {})),
    )
    rows = cut.select("*", *(_FOLDS[f][0](c).over(own).alias(f"_o_{n}") for n, (f, c) in folds.items()))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_slice") == F.col("_s")]
    out = [_FOLDS[f][1](F.col(f"_b_{n}"), F.col(f"_o_{n}")).alias(n) for n, (f, _) in folds.items()]
    return rows.join(parts, same).select(*cut.columns, *out, *(F.col(f"_a_{n}").alias(t) for n, t in (totals or {}).items()))


def placed(rows: DataFrame, keys: list[str], order: list, name: str = "place") -> DataFrame:
    """rows with their place from 1 within each key, in order, and <name>_of, how many there are; no key is numbered in one task."""
    cut = sliced(rows, keys, order)
    one = F.lit(1).cast("long")
    return running(cut, keys, order, {name: ("sum", one)}, {name: f"{name}_of"}).drop("_slice")


def next_row(rows: DataFrame, keys: list[str], at: str, id_: str, ahead: int) -> DataFrame:
    """id, next: for each row the first row of its key, by (at, id), that is at least so far ahead; null if there is none."""
    both = rows.select(*keys, F.col(at).alias("_at"), F.lit(1).alias("_real"), F.col(id_).alias("_id")).unionByName(rows.select(*keys, (F.col(at) + ahead).alias("_at"), F.lit(0).alias("_real"), F.col(id_).alias("_id")))
    order = [F.desc("_at"), F.desc("_real"), F.desc("_id")]
    ahead_of = running(sliced(both, keys, order), keys, order, {"_next": ("min", F.when(F.col("_real") == 1, F.struct("_at", "_id")))})
    return ahead_of.where("_real = 0").select(F.col("_id").alias("id"), F.col("_next._id").alias("next"))


def restarts(rows: DataFrame, keys: list[str], at: str, id_: str, length: int) -> DataFrame:
    """id of the rows that begin a window: the first of each key, and the first at least a length after a window began.

    Each row points to the row that would begin the next window; the pointers
    double with each round (pointer jumping), so a key with a million windows
    takes twenty rounds, over all keys at once.
    """
    pointers = checkpointed(next_row(rows, keys, at, id_, length))
    found = checkpointed(rows.groupBy(*keys).agg(F.min(F.struct(at, id_))[id_].alias("id")).select("id"))
    while True:
        more = found.join(pointers.where("next IS NOT NULL"), "id").select(F.col("next").alias("id"))
        if not more.limit(1).count():
            return found
        after = checkpointed(found.unionByName(more).distinct())
        onward = pointers.select(F.col("id").alias("next"), F.col("next").alias("_next"))
        pointers = checkpointed(pointers.join(onward, "next", "left").select("id", F.col("_next").alias("next")))
        found = after


def top_per(rows: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key (TOP-1, TOP-2); Catalyst limits groups before it shuffles them."""
    return ranked(rows, keys, order, "_rank").where(F.col("_rank") <= n).drop("_rank")


def score_buckets(rows: DataFrame, by: list[str], order: list, buckets: int) -> DataFrame:
    """bucket 1..buckets of equal sizes from the top within each group, whatever its size; what is left over goes (WIN-1)."""
    size = F.greatest(F.lit(1), F.floor(F.col("_r_of") / buckets))
    return placed(rows, by, order, "_r").withColumn("bucket", F.ceil(F.col("_r") / size).cast("int")).where(F.col("bucket") <= buckets).drop("_r", "_r_of")


def small_buckets(rows: DataFrame, by: list[str], order: list, buckets: int) -> DataFrame:
    """score_buckets() for groups that are small, as the triples of one text are: one window, no ranges."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    size = F.greatest(F.lit(1), F.floor(n / buckets))
    return ranked(rows, by, order, "_r").withColumn("bucket", F.ceil(F.col("_r") / size).cast("int")).where(F.col("bucket") <= buckets).drop("_r")


def frequency_buckets(rows: DataFrame, kind: str, buckets: int) -> DataFrame:
    """bucket i holds the rows of the i rarest kinds (WIN-2). Kinds are few: they are counted first."""
    counts = rows.groupBy(kind).agg(F.count(F.lit(1)).alias("_n"))
    place = counts.withColumn("_p", F.row_number().over(Window.orderBy("_n", kind))).where(F.col("_p") <= buckets)
    wide = place.select(kind, F.explode(F.sequence(F.col("_p"), F.lit(buckets))).alias("bucket"))
    return rows.join(wide, kind)


def islands(rows: DataFrame, key: str, at: str, mask: str) -> DataFrame:
    """first, last of each run of marked positions (WIN-5)."""
    on = rows.where(F.col(mask))
    run = F.col(at) - F.row_number().over(Window.partitionBy(key).orderBy(at))
    return on.withColumn("_run", run).groupBy(key, "_run").agg(F.min(at).alias("first"), F.max(at).alias("last")).drop("_run")


def patience(history: DataFrame, key: str, step: str, loss: str, most: int) -> DataFrame:
    """waited: steps since the loss last fell below all before it; stop where that reaches most (WIN-6)."""
    w = Window.partitionBy(key).orderBy(step)
    best = F.min(loss).over(w.rowsBetween(Window.unboundedPreceding, -1))
    better = best.isNull() | (F.col(loss) < best)
    group = history.withColumn("_better", better.cast("int")).withColumn("_group", F.sum("_better").over(w))
    waited = F.row_number().over(Window.partitionBy(key, "_group").orderBy(step)) - 1
    return group.withColumn("waited", waited).withColumn("stop", F.col("waited") >= most).drop("_better", "_group")


def leak_trend(samples: DataFrame, key: str, step: str, value: str, share: float = 0.7) -> DataFrame:
    """leaking: in the last ten of at least ten samples, more than a share of steps grow (WIN-7)."""
    last = ranked(samples, [key], [F.desc(step)], "_r").where("_r <= 10")
    grow = F.col(value) > F.lag(value).over(Window.partitionBy(key).orderBy(step))
    g = last.withColumn("_g", grow)
    return g.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if("_g").alias("grows")).select(key, ((F.col("n") >= 10) & (F.col("grows") / 9.0 > share)).alias("leaking"))


def mean_drop(samples: DataFrame, key: str, step: str, value: str) -> DataFrame:
    """Mean relative fall between samples that fall (WIN-8)."""
    before = F.lag(value).over(Window.partitionBy(key).orderBy(step))
    fall = samples.withColumn("_b", before).where((F.col(value) < F.col("_b")) & (F.col("_b") > 0))
    return fall.groupBy(key).agg(F.round(F.avg((F.col("_b") - F.col(value)) / F.col("_b")), 6).alias("drop"))


def tuned_batch(samples: DataFrame, key: str, step: str, seconds: str, memory: str, size: int, most: float) -> DataFrame:
    """Batch size from the last five times and memory (WIN-9): less if memory is short or times vary, more if there is room."""
    w = Window.partitionBy(key).orderBy(step).rowsBetween(-4, 0)
    s = samples.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(key).orderBy(step))).withColumn("_v", F.stddev_samp(seconds).over(w) / F.avg(seconds).over(w))
    b = F.when(F.col(memory) > 0.9 * most, F.floor(F.lit(size) * 0.8)).when((F.col(memory) < 0.5 * most) & (F.col(seconds) > 0.1), F.floor(F.lit(size) * 1.2)).otherwise(F.lit(size))
    b = F.when(F.col("_v") > 0.3, F.floor(b * 0.9)).otherwise(b)
    return s.withColumn("batch", F.when(F.col("_n") >= 3, F.greatest(F.lit(1), b)).otherwise(F.lit(size)).cast("int")).drop("_n", "_v")


def shuffled(rows: DataFrame, order: list, share: float, batch: int, by: list[str]) -> DataFrame:
    """place in a pseudo-random order within each group, whether in the training share, and batch (TOP-8, TOP-9)."""
    r = placed(rows, by, order)
    return r.withColumn("train", F.col("place") <= F.bround(F.col("place_of") * share)).withColumn("batch", F.floor((F.col("place") - 1) / batch).cast("int")).drop("place_of")


def batches(rows: DataFrame, order: list, size: int) -> DataFrame:
    """rows with place and batch: consecutive batches of a size, in order (TOP-9)."""
    r = placed(rows.withColumn("_all", F.lit(0)), ["_all"], order)
    return r.withColumn("batch", F.floor((F.col("place") - 1) / size).cast("long")).drop("_all", "place_of")


def first_values(rows: DataFrame, key: str, value: str, n: int) -> DataFrame:
    """key, firsts: the n least values of each key, in order (TOP-3); groups are cut to n before they are gathered."""
    some = top_per(rows.select(key, value), [key], [value], n)
    return some.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("firsts"))


def top_indexes(values: Column, n: int) -> Column:
    """The places, from 0, of an array's n largest values, the first of equals first (TOP-4)."""
    pairs = F.transform(values, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs), 1, n), lambda s: s["i"])
