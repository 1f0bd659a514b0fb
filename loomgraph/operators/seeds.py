"""Linking entities and choosing seed triples (SEED-1..8, JOIN-16, WIN-3)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import windows
from .lineage import checkpointed


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: str | Column, b: str | Column) -> Column:
    """Cosine of two vectors, 0 if either has no length (MTH-1)."""
    length = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(length == 0, 0.0).otherwise(dot(a, b) / length)


#: Vectors of one side that a task multiplies with those of the other.
LINK_ROWS = 4096


def link(mentions: DataFrame, base: DataFrame, least: float = 0.5, k: int = 10) -> DataFrame:
    """The k most alike knowledge-base vectors of each mention, of at least a cosine (JOIN-16, TOP-1, SEED-1).

    Both sides are dealt to blocks; a task multiplies a block of mentions with
    one of the base and gives k rows a mention, so no pairs are made but those
    that can be among the best. Null vectors and those without length link to
    nothing; vectors meet those of the same dimension. Cosines count to six
    digits, ties go to the smaller id.
    """
    ok = lambda c: c.isNotNull() & F.forall(c, lambda x: x.isNotNull()) & F.exists(c, lambda x: x != 0)
    v = F.col("embedding").cast("array<double>")
    m = mentions.select(F.col("vec_id").cast("long").alias("mention"), v.alias("_v")).where(ok(F.col("_v"))).withColumn("_d", F.size("_v"))
    b = base.select(F.col("vec_id").cast("long").alias("kb_id"), v.alias("_v")).where(ok(F.col("_v"))).withColumn("_d", F.size("_v"))
    n = lambda rows, name: rows.agg(F.greatest(F.lit(1), F.ceil(F.count(F.lit(1)) / LINK_ROWS)).cast("int").alias(name))
    sizes = n(m, "_nm").crossJoin(n(b, "_nb"))  # one row
    deal = lambda rows, id_, own, own_n, other, other_n: rows.crossJoin(F.broadcast(sizes)).select("_d", id_, "_v", F.pmod(F.xxhash64(id_), own_n).cast("int").alias(own), F.explode(F.sequence(F.lit(0), F.col(other_n) - 1)).alias(other))
    m, b = deal(m, "mention", "_x", F.col("_nm"), "_y", "_nb"), deal(b, "kb_id", "_y", F.col("_nb"), "_x", "_nm")

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        out = {"mention": [], "kb_id": [], "score": []}
        if len(left) and len(right):
            a, c = (np.array(x["_v"].tolist(), float) for x in (left, right))
            c, ids = c[np.argsort(right["kb_id"], kind="stable")], np.sort(right["kb_id"].to_numpy())
            a, c = (x / np.sqrt((x * x).sum(1, keepdims=True)) for x in (a, c))
            for at in range(0, len(a), 512):
                score = np.round(a[at : at + 512] @ c.T, 6)
                for i, row in enumerate(score):
                    top = np.lexsort((ids, -row))[:k]
                    top = top[row[top] >= least]
                    out["mention"] += [left["mention"].iloc[at + i]] * len(top)
                    out["kb_id"] += ids[top].tolist()
                    out["score"] += row[top].tolist()
        return pd.DataFrame(out)

    found = m.groupBy("_d", "_x", "_y").cogroup(b.groupBy("_d", "_x", "_y")).applyInPandas(best, "mention long, kb_id long, score double")
    return windows.top_per(found, ["mention"], [F.desc("score"), "kb_id"], k)


def candidates(seed: DataFrame, n: int = 40) -> DataFrame:
    """The n best seed triples of each knowledge-base id (SEED-5, TOP-2)."""
    return windows.top_per(seed, ["head_kb_id"], [F.desc("score"), "head", "relation", "tail"], n)


def select_for_injection(links: DataFrame, seed: DataFrame, key: str, least: float = 0.7, score_buckets: int = 10, relation_buckets: int = 5, most: int = 10) -> DataFrame:
    """Triples to inject into each text: from score buckets, the best of each of the rarest relations (SEED-6, WIN-3).

    links: key, kb_id. seed: head_kb_id, head, relation, tail, score. Per text,
    triples of linked ids of at least a score, once each with their best score,
    go to buckets by score; within a bucket the best triple of each relation is
    a candidate, rare relations first. They are taken in order up to the number
    of linked ids in each bucket and up to most in all.
    """
    # texts with the same links have the same triples: they are chosen once for each set of links
    sets = links.where(F.col(key).isNotNull()).groupBy(key).agg(F.count_if(F.col("kb_id").isNull()).alias("_null"), F.sort_array(F.collect_set("kb_id")).alias("_ids"))
    sets = checkpointed(sets.select(key, "_ids", (F.size("_ids") + F.when(F.col("_null") > 0, 1).otherwise(0)).alias("_linked")))
    own = checkpointed(sets.groupBy("_ids", "_linked").agg(F.min(key).alias("_set")))
    linked = own.select("_set", "_linked", F.explode("_ids").alias("head_kb_id"))
    # once each before the join: what is repeated in the seed must not meet every text
    best = seed.where(F.col("score") >= least).groupBy("head_kb_id", "relation", "tail").agg(F.max("score").alias("score"), F.min("head").alias("head"))
    t = linked.join(best, "head_kb_id")
    t = windows.small_buckets(t, ["_set"], [F.desc("score"), "head_kb_id", "relation", "tail"], score_buckets)
    # all that follows stays where the buckets were made
    kind = Window.partitionBy("_set", "bucket", "relation")
    t = windows.ranked(t.withColumn("_n", F.count(F.lit(1)).over(kind)), ["_set", "bucket", "relation"], [F.desc("score"), "head_kb_id", "tail"], "_first").where(F.col("_first") == 1)
    t = windows.ranked(t, ["_set", "bucket"], ["_n", "relation"], "_place").where((F.col("_place") <= relation_buckets) & (F.col("_place") <= F.greatest(F.col("_linked"), F.lit(1))))
    t = windows.ranked(t, ["_set"], ["bucket", "_place"], "ord").where(F.col("ord") <= most)
    chosen = t.groupBy("_set").agg(F.collect_list(F.struct("ord", "head_kb_id", "head", "relation", "tail", "score")).alias("_t"))
    return sets.join(own, ["_ids", "_linked"]).select(key, "_set").join(chosen, "_set").select(key, F.explode("_t").alias("_t")).select(key, "_t.*")


def chosen_sequences(docs: DataFrame, order: str, ratio: float, entities: DataFrame | None = None) -> DataFrame:
    """Of the first bround(ratio x number) texts in order, those with entities (order column), or all without a table of them (SEED-7)."""
    p = windows.placed(docs.withColumn("_all", F.lit(0)), ["_all"], [order], "_place")
    first = p.where(F.col("_place") <= F.bround(F.col("_place_of") * F.lit(ratio))).select(*docs.columns)
    return first if entities is None else first.join(entities.select(order).distinct(), order, "left_semi")


def injected_valid(text: Column, head: Column, tail: Column) -> Column:
    """Whether a triple's head or tail is in the text, any case (SEED-8)."""
    low = F.lower(text)
    return low.contains(F.lower(head)) | low.contains(F.lower(tail))


def mock_link(names: Column, spread: int = 46) -> Column:
    """A stable stand-in for a linker's score, 0.50 to 0.95 (SEED-2)."""
    return F.lit(0.5) + F.pmod(X.stable_number(names), F.lit(spread)) / 100.0


#: Triples of a tiny stand-in knowledge base (SEED-3).
MOCK_TRIPLES = [
    ("C0011849", "diabetes", "treats", "metformin", 0.85), ("C0011849", "diabetes", "causes", "neuropathy", 0.72), ("C0011849", "diabetes", "associated_with", "obesity", 0.78),
    ("C0025598", "metformin", "treats", "diabetes", 0.82), ("C0025598", "metformin", "affects", "glucose", 0.75),
]
