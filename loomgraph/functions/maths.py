"""Number functions over arrays (MTH-1)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def softmax(x: Column) -> Column:
    """Shares by exponentials; what all elements need is made once, as the variable of an outer lambda."""
    top = F.array(F.struct(x.alias("v"), F.array_max(x).alias("m")))
    e = F.transform(top, lambda s: F.transform(s["v"], lambda v: F.exp(v - s["m"])))
    with_sum = F.transform(e, lambda v: F.struct(v.alias("e"), F.aggregate(v, F.lit(0.0), lambda a, b: a + b).alias("z")))
    return F.transform(with_sum, lambda s: F.transform(s["e"], lambda v: v / s["z"]))[0]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def relu(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def norm(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v))
