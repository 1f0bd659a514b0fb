"""Benchmark decontamination by SimHash windows (operator 5), in DataFrame functions only.

A benchmark item of n words is sought in windows of n words. Every window that
shares a shingle with the item lies on one of the diagonals that such a shingle
marks, and a window that shares none has similarity 0; so only windows on
diagonals are fingerprinted. Two exact bounds come first: a text with a window
of the threshold's similarity shares one of the item's rarest shingles that
weigh more than 1 - threshold of it, and shares the threshold of its weight at
all. So a shingle that many items and texts hold costs nothing by itself.
Windows of equal words are fingerprinted once.

A BITS-bit SimHash stands for a window's weighted shingles (five words; an item
of fewer words is one shingle; a shingle that occurs n times is n elements, so
the cosine of two windows is never below their similarity). Windows meet the
items that they may hold in a multi-index: fingerprints within RADIUS bits
agree in one of BLOCKS blocks up to RADIUS // BLOCKS bits, and the items' side
holds all values so near of each block. RADIUS follows from the threshold: a
pair at it lies beyond with a chance of at most LOSS. Candidates within the
radius are verified by their exact weighted-shingle similarity: the weight in
common over the larger of both totals.
"""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import AT, FILE, drop_path, table, with_row_ids, written

WORDS = 5
THRESHOLD = 0.8
BITS, BLOCKS, LOSS = 128, 32, 1e-7
_WIDTH = BITS // BLOCKS


def radius(threshold: float, bits: int = BITS, loss: float = LOSS) -> int:
    """The least radius that fingerprints of windows at the threshold leave with a chance of at most loss.

    A bit differs with the chance angle / pi, the angle at most arccos(threshold).
    """
    p = math.acos(min(1.0, threshold)) / math.pi
    beyond = 1.0
    for r in range(bits + 1):
        beyond -= math.comb(bits, r) * p**r * (1 - p) ** (bits - r)
        if beyond <= loss:
            return r
    return bits


RADIUS = radius(THRESHOLD)


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), "")


def _shingled(df: DataFrame, column: str, k: int, keep: list[str], position: str | None = None) -> DataFrame:
    """keep, (position,) h of each run of k words of an array column.

    Runs are hashed within the row, so that exploded rows hold numbers only.
    """
    names = [f"_w{i}" for i in range(k)]
    parts = [F.col(column), *(F.slice(F.col(column), i + 1, 2**31 - 1 - i) for i in range(1, k))]
    rows = df.withColumns(dict(zip(names, parts))).select(*keep, F.slice(F.arrays_zip(*map(F.col, names)), 1, F.greatest(F.size(column) - (k - 1), F.lit(0))).alias("_z"))
    hashes = F.transform("_z", lambda x: F.xxhash64(*(x[n] for n in names)))
    return rows.select(*keep, F.posexplode(hashes).alias(position, "h") if position else F.explode(hashes).alias("h"))


def sim_hash(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys, low, high: 128 majority votes over the rows (h, count), counted two bits to a sum.

    A shingle of count n votes as n elements with hashes of their own.
    """
    pair = F.lit((1 << 32) + 1)
    each = df.select(*keys, "h", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("_j")).select(*keys, F.xxhash64("h", "_j").alias("_g0"), F.xxhash64("_j", "h").alias("_g1"))
    sums = each.groupBy(*keys).agg(*(F.sum(F.shiftrightunsigned(f"_g{w}", i).bitwiseAND(pair)).alias(f"s{w}_{i}") for w in (0, 1) for i in range(32)), F.count(F.lit(1)).alias("_n"))
    bit = lambda count, at: F.when(count * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), at)).otherwise(F.lit(0).cast("long"))

    def half(w: int) -> Column:
        out = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"s{w}_{i}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"s{w}_{i}", 32)
            out = out.bitwiseOR(bit(low, i)).bitwiseOR(bit(high, i + 32))
        return out

    return sums.select(*keys, half(0).alias("low"), half(1).alias("high"))


def _blocks() -> Column:
    """The values of a fingerprint's blocks."""
    return F.array(*(F.shiftrightunsigned(half, k * _WIDTH).bitwiseAND(F.lit((1 << _WIDTH) - 1)).cast("int") for half in ("low", "high") for k in range(BLOCKS // 2)))


def multi_index(windows: DataFrame, items: DataFrame, may: DataFrame, within: int) -> DataFrame:
    """The pairs (window, item) of may whose fingerprints (low, high) lie within so many bits."""
    near = sorted(sum(1 << b for b in bits) for r in range(within // BLOCKS + 1) for bits in itertools.combinations(range(_WIDTH), min(r, _WIDTH)))
    index = items.select("item", F.col("low").alias("_low"), F.col("high").alias("_high"), F.posexplode(_blocks()).alias("block", "_value"))
    index = index.select("item", "_low", "_high", "block", F.explode(F.transform(F.array(*map(F.lit, dict.fromkeys(near))), lambda x: x.bitwiseXOR(F.col("_value")))).alias("value"))
    probes = may.join(windows, "window").select("window", "item", "low", "high", F.posexplode(_blocks()).alias("block", "value"))
    met = probes.join(index, ["item", "block", "value"])
    apart = F.bit_count(F.col("low").bitwiseXOR(F.col("_low"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("_high")))
    return met.where(apart <= within).select("window", "item").distinct()


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row ids, item_id, similarity, start of each document and benchmark item in it.

    start is the 0-based first word of the most similar window (the first of
    equals), below 0 where the window hangs over the document's start. The row
    ids (with_row_ids) hold however a scan is split. Null and empty texts, and
    items without words, give nothing; repeated documents give repeated
    results, repeated items (null ids among them) one result for each item_id.
    Tables are broadcast only where Spark's own size check allows it.
    """
    made: list[str] = []
    ROW = [FILE, AT]
    rows = with_row_ids(docs, made).select(*ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words"))
    bench = bench.where(F.size("words") > 0).withColumn("n", F.size("words")).withColumn("k", F.least(F.lit(WORDS), "n"))
    bench = written(bench.distinct().withColumn("item", F.monotonically_increasing_id()), "leak-items", made)
    sizes = [r.k for r in bench.select("k").distinct().collect()]  # at most WORDS rows

    marks = None
    for k in sizes:
        own = _shingled(bench.where(F.col("k") == k), "words", k, ["item", "n", "k"], "at")
        marks = own if marks is None else marks.unionByName(own)
    if marks is None:
        for path in made:
            drop_path(docs.sparkSession, path)
        nothing = ", ".join(f"{c} long" for c in ("doc_id", *ROW, "item_id"))
        return docs.sparkSession.createDataFrame([], f"{nothing}, similarity double, start int")
    marks = written(marks, "leak-marks", made)
    known = written(marks.select("h", "k").distinct(), "leak-known", made)
    weights = written(marks.groupBy("item", "n", "k", "h").agg(F.count(F.lit(1)).alias("count")), "leak-weights", made)
    totals = weights.groupBy("item").agg(F.sum("count").alias("all_b"))

    split = rows.select(*ROW, "doc_id", words(F.col("text")).alias("words"))
    hits = None
    for k in sizes:
        own = _shingled(split, "words", k, [*ROW, "doc_id"], "pos").join(known.where(F.col("k") == k).select("h"), "h")
        own = own.withColumn("k", F.lit(k))
        hits = own if hits is None else hits.unionByName(own)
    hits = written(hits, "leak-hits", made)

    # which items a text may hold: it shares one of the item's rarest shingles, and enough of all
    slack = 1 - threshold + 1e-6
    often = hits.groupBy("h", "k").agg(F.count(F.lit(1)).alias("uses"))
    rare = weights.join(often, ["h", "k"], "left").join(totals, "item")
    before = F.sum("count").over(Window.partitionBy("item").orderBy(F.coalesce("uses", F.lit(0)), "h").rowsBetween(Window.unboundedPreceding, -1))
    first = rare.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") <= slack * F.col("all_b")).where("uses IS NOT NULL")
    held = written(hits.select(*ROW, "h", "k").distinct(), "leak-held", made)
    may = held.join(first.select("h", "k", "item"), ["h", "k"]).select(*ROW, "item").distinct()
    common = may.join(weights.select("item", "h", "k", "count"), "item").join(held, [*ROW, "h", "k"]).groupBy(*ROW, "item").agg(F.sum("count").alias("most"))
    may = written(common.join(totals, "item").where(F.col("most") >= (1 - slack) * F.col("all_b")).select(*ROW, "item"), "leak-may", made)

    # the starts that a shingle's places in text and item give, or where these are more than that, all between the first and the last
    spots = hits.join(may.select(*ROW).distinct(), ROW, "left_semi").groupBy(*ROW, "h", "k").agg(F.collect_list("pos").alias("p"))
    at = marks.groupBy("item", "n", "h", "k").agg(F.collect_list("at").alias("a"))
    low, high = F.array_min("p") - F.array_max("a"), F.array_max("p") - F.array_min("a")
    each = F.flatten(F.transform("p", lambda x: F.transform("a", lambda y: x - y)))
    starts = F.when(F.size("p").cast("long") * F.size("a") > high - low, F.sequence(low, high)).otherwise(each)
    places = may.join(at, "item").join(spots, [*ROW, "h", "k"]).select(*ROW, "item", F.explode(starts).alias("start"), "n", "k").distinct()
    places = written(places, "leak-places", made)
    inside_of = lambda words, start, n: F.slice(words, F.greatest(start, F.lit(0)) + 1, F.greatest(n + F.least(start, F.lit(0)), F.lit(0)))
    # the texts with such places are picked by their ids alone, once
    picked = written(places.select(*ROW).distinct(), "leak-rows", made)
    texts = written(rows.join(picked, ROW, "left_semi").select(*ROW, "doc_id", words(F.col("text")).alias("words")), "leak-texts", made)
    of_row = places.select(*ROW, "start", "n", "k").distinct().groupBy(*ROW).agg(F.collect_list(F.struct("start", "n", "k")).alias("places"))
    windows = texts.join(of_row, ROW).select(*ROW, "doc_id", "words", F.explode("places").alias("p")).select(*ROW, "doc_id", "p.start", "p.n", "p.k", inside_of(F.col("words"), F.col("p.start"), F.col("p.n")).alias("words"))
    windows = written(windows.select(*ROW, "doc_id", "start", "n", "k", F.md5(F.concat_ws(" ", F.col("n").cast("string"), "words")).alias("window")), "leak-windows", made)
    # the words of one window of equal ones
    first_of = windows.groupBy("window").agg(F.min(F.struct(*ROW, "start", "n", "k")).alias("w")).select("window", "w.*")
    of_row = first_of.groupBy(*ROW).agg(F.collect_list(F.struct("window", "start", "n", "k")).alias("places"))
    distinct = texts.join(of_row, ROW).select("words", F.explode("places").alias("p")).select("p.window", inside_of(F.col("words"), F.col("p.start"), F.col("p.n")).alias("words"), "p.n", "p.k")
    distinct = written(distinct, "leak-distinct", made)
    inside = None
    for k in sizes:
        own = _shingled(distinct.where(F.col("k") == k), "words", k, ["window"])
        inside = own if inside is None else inside.unionByName(own)
    inside = written(inside.groupBy("window", "h").agg(F.count(F.lit(1)).alias("count")), "leak-inside", made)

    candidates = places.join(windows.select(*ROW, "start", "n", "window"), [*ROW, "start", "n"]).select("window", "item").distinct()
    pairs = multi_index(sim_hash(inside, ["window"]), sim_hash(weights, ["item"]), candidates, radius(threshold))

    theirs = weights.select("item", "h", F.col("count").alias("_b"))
    shared = pairs.join(inside, "window").join(theirs, ["item", "h"]).groupBy("window", "item").agg(F.sum(F.least("count", "_b")).alias("common"))
    found = shared.join(inside.groupBy("window").agg(F.sum("count").alias("all_a")), "window").join(totals, "item")
    found = found.withColumn("similarity", F.round(F.col("common") / F.greatest("all_a", "all_b"), 6)).where(F.col("similarity") >= threshold)
    found = written(found.join(bench.select("item", "item_id"), "item").select("window", "item_id", "similarity"), "leak-found", made)

    matched = windows.select(*ROW, "doc_id", "start", "window").join(found, "window")
    best = matched.groupBy(*ROW, "item_id").agg(F.first("doc_id").alias("doc_id"), F.min(F.struct((-F.col("similarity")).alias("less"), "start")).alias("best"))
    best = written(best.select("doc_id", *ROW, "item_id", (-F.col("best.less")).alias("similarity"), F.col("best.start").alias("start")), "leak-best")
    for path in made:
        drop_path(docs.sparkSession, path)
    return best


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "similarity", "start")


def oracle() -> str:
    """All windows on diagonals, by words instead of fingerprints. For items of five words or more, as the table has."""
    split = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}_]+'), lambda x: x <> '')"
    return f"""
WITH d AS (SELECT doc_id, {split} AS w FROM documents), b AS (SELECT item_id, {split} AS w FROM benchmark),
ds AS (SELECT doc_id, unnest(range(len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) >= 5),
bs AS (SELECT item_id, len(w) AS n, unnest(range(len(w) - 4)) AS spot, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) >= 5),
place AS (SELECT DISTINCT doc_id, item_id, n, pos - spot AS start FROM ds JOIN bs USING (s)),
inside AS (SELECT p.doc_id, item_id, start, s, count(*) AS a FROM place p JOIN ds ON ds.doc_id = p.doc_id AND pos BETWEEN start AND start + n - 5 GROUP BY ALL),
total AS (SELECT doc_id, item_id, start, sum(a) AS all_a FROM inside GROUP BY ALL),
item AS (SELECT item_id, s, count(*) AS b, sum(count(*)) OVER (PARTITION BY item_id) AS all_b FROM bs GROUP BY item_id, s),
common AS (SELECT doc_id, item_id, start, sum(least(a, b)) AS common, any_value(all_b) AS all_b FROM inside JOIN item USING (item_id, s) GROUP BY ALL),
sim AS (SELECT doc_id, item_id, start, round(common::DOUBLE / greatest(all_a, all_b), 6) AS similarity FROM common JOIN total USING (doc_id, item_id, start)),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) AS r FROM sim WHERE similarity >= {THRESHOLD})
SELECT doc_id, item_id, similarity, CAST(start AS INTEGER) AS start FROM best WHERE r = 1"""
