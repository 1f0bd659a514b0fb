"""Training rows: masking and losses (TRN-1..5, MTH-2, MTH-3)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MASK, IGNORE, VOCABULARY = 103, -100, 30522


def draw(*keys: Column, seed: int = 0) -> Column:
    """A number in [0, 1) from integer keys, by arithmetic that SQL engines share."""
    x = F.lit(seed * 7717 + 12345).cast("long")
    for k in keys:
        x = F.pmod(x * 1103 + k.cast("long") * 7919 + 104729, F.lit(1_000_003).cast("long"))
    return F.pmod(x * 48271, F.lit(1_000_003).cast("long")) / F.lit(1_000_003.0)


def masked(tokens: DataFrame, key: str, at: str, token: str, share: float = 0.15, seed: int = 0, valid: Column | None = None) -> DataFrame:
    """key, at, input, label: a share of valid tokens masked: 80 % by MASK, 10 % by another token, 10 % kept (TRN-2, TRN-3).

    At least one token of a text is chosen: those of the smallest draws.
    """
    ok = valid if valid is not None else F.lit(True)
    d = draw(F.col(key), F.col(at), seed=seed)
    w = Window.partitionBy(key)
    t = tokens.withColumn("_ok", ok).withColumn("_d", F.when(F.col("_ok"), d))
    n = F.greatest(F.lit(1), F.bround(F.count("_d").over(w) * share))
    r = F.row_number().over(w.orderBy(F.col("_d").asc_nulls_last(), at))
    t = t.withColumn("_chosen", F.col("_ok") & (r <= n))
    how = draw(F.col(at), F.col(key), seed=seed + 1)
    other = F.floor(draw(F.col(key), F.col(at), seed=seed + 2) * VOCABULARY).cast("long")
    new = F.when(~F.col("_chosen"), F.col(token)).when(how < 0.8, MASK).when(how < 0.9, other).otherwise(F.col(token))
    return t.select(key, at, new.cast("long").alias("input"), F.when(F.col("_chosen"), F.col(token)).otherwise(IGNORE).cast("long").alias("label"))


def decay(distance: Column, kind: str = "exponential", rate: float = 0.6, most: int = 512) -> Column:
    """Attention decay by distance (MTH-2): 0 beyond most; linear and quadratic do not fall below 0."""
    d = F.abs(distance)
    value = {"exponential": F.exp(-rate * d), "linear": F.greatest(F.lit(0.0), 1 - rate * d), "quadratic": F.greatest(F.lit(0.0), 1 - rate * d * d)}[kind]
    return F.when(d > most, 0.0).otherwise(value)


def decay_mask(spark, n: int, kind: str = "exponential", rate: float = 0.6, causal: bool = False, normal: bool = False) -> DataFrame:
    """i, j, v of an n x n mask (MTH-2); n is a model's fixed length."""
    i = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("j"))
    m = i.withColumn("v", decay(F.col("i") - F.col("j"), kind, rate))
    if causal:
        m = m.withColumn("v", F.when(F.col("j") <= F.col("i"), F.col("v")).otherwise(0.0))
    if normal:
        m = m.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("i")))
    return m


def decay_masks(rows: DataFrame, key: str, n: str, kind: str = "exponential", rate: float = 0.6, causal: bool = False, normal: bool = False) -> DataFrame:
    """key, i, j, v: a mask of n x n for each of rows (key, n) (MTH-2); rows of a mask are summed within the row that makes them."""
    to = F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    i = rows.where(F.col(n) > 0).select(key, n, F.explode(to).alias("i"))
    cell = lambda j: F.when(j <= F.col("i"), decay(F.col("i") - j, kind, rate)).otherwise(0.0) if causal else decay(F.col("i") - j, kind, rate)
    m = i.select(key, "i", F.transform(to, cell).alias("_v"))
    total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
    m = m.select(key, "i", "_v", (total if normal else F.lit(1.0)).alias("_s"))
    return m.select(key, "i", "_s", F.posexplode("_v").alias("j", "v")).select(key, "i", "j", (F.col("v") / F.col("_s")).alias("v"))


def joint_loss(mlm: Column, mnm: Column, weight: float = 1.0) -> Column:
    return mlm + weight * mnm


def infer(rows: DataFrame, model: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str) -> DataFrame:
    """Rows through a model that each worker loads once (TRN-5): model() gives a function of Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = model()
        for batch in batches:
            yield fn(batch)

    return rows.mapInArrow(run, schema)
