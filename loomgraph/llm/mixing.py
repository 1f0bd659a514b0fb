"""Mixing sources to target weights (operator 11), in DataFrame functions only.

Each source has a budget of words; it takes whole rounds of its documents as
long as they fit, and of the rest of its budget a share of the documents that
hash thresholds cut off. A document's place is a digest of its id, then of its
text, then of its row, 180 bits in all, read twelve at a time. Sizes are summed
by source and by the first twelve bits; the bucket where the running sum passes
the budget is the boundary, those below it are taken whole, and only the
boundary's rows are summed again by the next twelve bits, until it holds one
row. No documents are sorted, and a greater budget takes all that a smaller one
does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.windows import placed
from .shared import AT, FILE, drop_path, table, with_row_ids, written

#: A word of a document.
WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in code-point order, repeating, and how often a document may be taken.
WEIGHTS, MOST = (1, 2, 3), 3
#: Bits of a level of the histograms; of each of the three parts of a place.
LEVEL_BITS, PART_BITS = 12, 60


def _part(text: Column) -> Column:
    """The first 60 bits of a digest of a string."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, PART_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the place (p0, p1, p2) of each row; a null id, text or source has a place and a size like any other."""
    rows = docs.select(
        "doc_id",
        "source",
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        _part(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("p0"),
        _part(F.coalesce("text", F.lit(""))).alias("p1"),
        _part(F.concat_ws(":", FILE, AT)).alias("p2"),
    )
    return rows


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target of a table of (source, source_size).

    All sources share the sum of sizes by weight. Where a share is over
    most x source_size it stops there, and what is left over is shared again
    by weight among the others, until no share is above. The rounds hold two
    numbers on the driver; every round settles one source at least, and in
    practice a few rounds settle all.
    """
    order = placed(sizes.withColumn("_all", F.lit(0)), ["_all"], [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("place") - 1, F.lit(len(weights))) + 1).cast("int"))
    wide = "decimal(38,0)"
    known = order.select("source", "source_size", weight.cast("long").alias("weight"))
    made: list[str] = []
    known = written(known, "mix-sources", made)
    total = known.agg(F.sum(F.col("source_size").cast(wide))).first()[0] or 0
    left, share, full = total, known.agg(F.sum(F.col("weight").cast(wide))).first()[0] or 0, 0

    def above(pool, parts) -> Column:
        return F.col("source_size").cast(wide) * F.lit(most) * F.lit(int(parts)).cast(wide) < F.lit(int(pool)).cast(wide) * F.col("weight")

    over = F.lit(False)
    while share:
        now = above(left, share)
        capped, parts, count = known.agg(
            F.sum(F.when(now, F.col("source_size").cast(wide) * most)), F.sum(F.when(now, F.col("weight").cast(wide))), F.count_if(now)
        ).first()
        over = now
        if count == full:
            break
        full = count
        share_all = known.agg(F.sum(F.col("weight").cast(wide))).first()[0]
        left, share = total - (capped or 0), share_all - (parts or 0)
    pool, parts = F.lit(int(left)).cast(wide), F.lit(int(share))
    even = (pool * F.col("weight")).cast("double") / parts if share else F.lit(0.0)
    target = F.when(over, (F.col("source_size") * most).cast("double")).otherwise(even)
    return written(known.select("source", "source_size", "weight", target.alias("target")), "mix-targets")


def _level(k: int) -> tuple[str, int]:
    """The part of a place that level k reads, and how far its bits are from the right."""
    per = PART_BITS // LEVEL_BITS
    return f"p{k // per}", PART_BITS - LEVEL_BITS * (k % per + 1)


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """source, source_size, target, rounds, and the boundary: e0, e1, e2 with all its lower bits set, the last place that is taken.

    rounds is how often every document is taken. A row beyond them is taken if
    the sizes of its source before it and half its own fit in the rest of the
    budget; sources without such rows have a boundary of -1.
    """
    made: list[str] = []
    levels = 3 * PART_BITS // LEVEL_BITS
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    edge = sources.select("source", "source_size", "target", rounds.alias("rounds"))
    edge = edge.select("*", (F.col("target") - F.col("rounds") * F.col("source_size")).alias("rest"), *(F.lit(-1).cast("long").alias(f"e{i}") for i in range(3)))
    edge = written(edge.withColumn("open", F.col("rest") > 0), "mix-edges", made)
    inside = rows
    for k in range(levels):
        part, shift = _level(k)
        which = f"e{part[1]}"
        at = inside.withColumn("_b", F.shiftright(part, shift).bitwiseAND((1 << LEVEL_BITS) - 1))
        sums = at.groupBy("source", "_b").agg(F.sum("size").alias("_sum"), F.count(F.lit(1)).alias("_n"))  # at most 4096 rows of a source
        run = F.sum("_sum").over(Window.partitionBy("source").orderBy("_b"))
        wanted = edge.where("open").select(F.col("source").alias("_s"), "rest")
        run = sums.withColumn("_run", run).join(wanted, F.col("source").eqNullSafe(F.col("_s")))
        first = run.where(F.col("_run") > F.col("rest")).groupBy("_s").agg(F.min(F.struct("_b", (F.col("_run") - F.col("_sum")).alias("before"), "_sum", "_n")).alias("x"))
        last = k == levels - 1
        # one row, or rows that no bit tells apart: taken if half of them fits
        fits = F.col("x.before") + F.col("x._sum") / 2 <= F.col("rest")
        done = (F.col("x._n") == 1) | F.lit(last)
        high = F.shiftleft(F.col("x._b"), shift)
        low = F.lit((1 << shift) - 1).cast("long")
        base = F.when(F.col(which) < 0, F.lit(0).cast("long")).otherwise(F.col(which))
        ones = F.lit((1 << PART_BITS) - 1).cast("long")
        joined = edge.join(first.withColumnRenamed("_s", "_f"), F.col("source").eqNullSafe(F.col("_f")), "left")
        hit = F.col("open") & F.col("x").isNotNull()
        # none is passed: all of the boundary are taken
        whole = F.col("open") & F.col("x").isNull()
        value = base + high
        new = {which: F.when(hit & done & fits, value + low).when(hit & done, value - 1).when(hit, value).when(whole, F.when(F.col(which) < 0, ones).otherwise(base + F.lit((1 << (shift + LEVEL_BITS)) - 1).cast("long"))).otherwise(F.col(which))}
        for i in range(int(part[1]) + 1, 3):
            new[f"e{i}"] = F.when(whole | (hit & done), ones).otherwise(F.col(f"e{i}"))
        rest = F.when(hit & ~done, F.col("rest") - F.col("x.before")).otherwise(F.col("rest"))
        edge = joined.select("source", "source_size", "target", "rounds", *(new.get(f"e{i}", F.col(f"e{i}")).alias(f"e{i}") for i in range(3)), rest.alias("rest"), (hit & ~done).alias("open"))
        edge = written(edge, "mix-edges", made)
        if not edge.where("open").limit(1).count():
            break
        bounds = edge.where("open").select(F.col("source").alias("_s"), *(F.col(f"e{i}").alias(f"_e{i}") for i in range(3)))
        prefix = [F.col(f"p{i}") == F.col(f"_e{i}") for i in range(int(part[1]))] + [F.shiftright(part, shift) == F.shiftright(f"_{which}", shift)]
        inside = written(inside.join(bounds, [F.col("source").eqNullSafe(F.col("_s")), *prefix]).select(*rows.columns), "mix-boundary", made)
    for path in [p for p in made[:-1] if "/mix-edges" in p or "/mix-boundary" in p]:
        drop_path(rows.sparkSession, path)
    return edge.select("source", "source_size", "target", "rounds", "e0", "e1", "e2")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, repeats for each row of docs (doc_id, text, source).

    taken is size x repeats: the words that the mix takes of a row. A source's
    sum of taken differs from its target by at most half of the size of one
    document. Null and empty texts have size 0; null sources are one source,
    after all others; null ids and repeated rows are rows like others, and
    rows that are alike in all columns are told apart by their place in the
    table; an empty table gives no rows; other columns are left aside.
    """
    made: list[str] = []
    numbered = with_row_ids(docs, made)
    rows = written(sized(numbered), "mix-rows")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    edges = thresholds(rows, targets(sizes, weights, most)).withColumnRenamed("source", "_s")
    for path in made:
        drop_path(docs.sparkSession, path)
    within = (F.col("p0") < F.col("e0")) | ((F.col("p0") == F.col("e0")) & ((F.col("p1") < F.col("e1")) | ((F.col("p1") == F.col("e1")) & (F.col("p2") <= F.col("e2")))))
    repeats = F.col("rounds") + within.cast("long")
    out = rows.join(edges, F.col("source").eqNullSafe(F.col("_s")))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * repeats).alias("taken"), repeats.alias("repeats"))


def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def oracle() -> str:
    """The same by sorting: places in order, and shares from sources ordered by how soon they are full."""
    weight = "CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END"
    place = "md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS p0, md5(coalesce(text, ''))[1:15] AS p1"
    return f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{WORD}')), 0) AS BIGINT) AS size, {place} FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, {weight} AS weight FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
  coalesce(sum({MOST} * source_size) OVER b, 0) AS full_words, coalesce(sum(weight) OVER b, 0) AS full_weight
  FROM w WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, {MOST} * source_size * (weights - full_weight) < (total - full_words) * weight AS is_full FROM o),
p AS (SELECT max(total) - coalesce(sum({MOST} * source_size) FILTER (is_full), 0) AS pool, max(weights) - coalesce(sum(weight) FILTER (is_full), 0) AS parts FROM m),
t AS (SELECT source, source_size, CASE WHEN is_full THEN CAST({MOST} * source_size AS DOUBLE) WHEN parts = 0 THEN 0.0 ELSE CAST(pool * weight AS DOUBLE) / CAST(parts AS DOUBLE) END AS target FROM m, p),
r AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS rounds FROM t),
c AS (SELECT d.*, sum(size) OVER (PARTITION BY source ORDER BY p0, p1 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d)
SELECT c.doc_id, c.size, r.source_size, r.target, CAST(c.size * (r.rounds + CASE WHEN c.run - c.size / 2.0 <= r.target - r.rounds * r.source_size AND r.target > r.rounds * r.source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source"""
