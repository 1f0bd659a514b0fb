"""Shortest paths by doubling, paths from sources, and attention masks by distance over levels (GRF-2, GRF-3, MTH-3)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import at_rest, checkpointed, swept
from .training import decay

#: The most sources whose distance to every node is wanted, unreachable ones too: their table is sent to all executors.
MAX_SOURCES = 10_000


def closure(edges: DataFrame, keys: list[str] | None = None, most: int | None = None) -> DataFrame:
    """keys, src, dst, hops of all shortest directed paths of edges (keys, src, dst) between different nodes, of at most `most` hops (GRF-2).

    Min-plus doubling: a round joins the paths that are known with each other,
    so paths of up to 2^k hops are known after k rounds, whatever the graph's
    width. keys name graphs that have nothing in common.
    """
    keys = keys or []
    edge = edges.where("src <> dst").select(*keys, "src", "dst").distinct().withColumn("hops", F.lit(1).cast("long"))
    known, size = checkpointed(edge), None
    while True:
        then = known.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("_to"), F.col("hops").alias("_more"))
        two = known.join(then, [*keys, "dst"]).where(F.col("src") != F.col("_to")).select(*keys, "src", F.col("_to").alias("dst"), (F.col("hops") + F.col("_more")).alias("hops"))
        if most is not None:
            two = two.where(F.col("hops") <= most)
        known = checkpointed(known.unionByName(two).groupBy(*keys, "src", "dst").agg(F.min("hops").alias("hops")))
        now = known.agg(F.count(F.lit(1)), F.sum("hops")).first()
        if tuple(now) == size:
            return known
        size = tuple(now)


def met(nodes: DataFrame, edges: DataFrame, sources: list) -> tuple[DataFrame, int]:
    """(id, _met of each of nodes, the hops of those that a source does not reach): which of sources are how far, as (block, bits, hops).

    The sources that reach a node are bits of a number for each block of 64 of
    them, so a round has a row for a node and block, not for each source.
    The edges lie dealt by src (lineage.at_rest); only what a round brings moves.
    """
    spark = nodes.sparkSession
    kind = nodes.schema["id"].dataType.simpleString()
    step = edges.select(F.col("src").alias("_at"), F.col("dst").alias("id"))
    first = spark.createDataFrame([(s, k) for k, s in enumerate(sources)], f"id {kind}, n int")
    fresh = first.selectExpr("id", "n div 64 AS block", "shiftleft(1L, n % 64) AS b").groupBy("id", "block").agg(F.bit_or("b").alias("bits"))
    frontier = seen = checkpointed(fresh)
    found, hops = frontier.withColumn("hops", F.lit(0).cast("long")), 0
    while True:
        hops += 1
        new = frontier.withColumnRenamed("id", "_at").join(step, "_at").groupBy("id", "block").agg(F.bit_or("bits").alias("_new"))
        both = seen.join(new, ["id", "block"], "full").selectExpr("id", "block", "coalesce(bits, 0L) AS _old", "coalesce(_new, 0L) AS _new")
        after = swept(checkpointed(both.selectExpr("id", "block", "_old | _new AS bits", "_new & ~_old AS fresh")))
        frontier = after.where("fresh <> 0").select("id", "block", F.col("fresh").alias("bits"))
        if not frontier.limit(1).count():
            break
        found = found.unionByName(frontier.withColumn("hops", F.lit(hops).cast("long")))
        seen = after.drop("fresh")
    own = found.groupBy("id").agg(F.collect_list(F.struct("block", "bits", "hops")).alias("_met"))
    return nodes.select("id").distinct().join(own, "id", "left"), hops


def hops_of(n: str, beyond: int) -> str:
    """The hops from source number n to a row of met(), in SQL."""
    return f"coalesce(get(filter(_met, m -> m.block = {n} div 64 AND shiftright(m.bits, cast({n} % 64 AS int)) & 1L = 1L), 0).hops, {beyond}L)"


def from_sources(nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """src, id, hops of shortest directed paths from each of sources (id) to each of nodes (id), without a bound on their length (GRF-2).

    A round widens the frontiers of all sources by an edge. Nodes that a
    source does not reach are one hop beyond the longest path that was found
    (1 if there are no paths).
    """
    some = sorted(r.id for r in sources.select("id").distinct().limit(MAX_SOURCES + 1).collect())
    if len(some) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    each, hops = met(nodes, at_rest(edges.select("src", "dst").where("src <> dst"), "src"), some)
    numbered = nodes.sparkSession.createDataFrame(list(enumerate(some)), f"n int, src {nodes.schema['id'].dataType.simpleString()}")
    return each.crossJoin(F.broadcast(numbered)).select("src", "id", F.expr(hops_of("n", hops)).alias("hops"))  # at most MAX_SOURCES rows


def symmetric(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys, src, dst: edges in both directions, and a loop at each node that has an edge (GRF-3)."""
    keys = keys or []
    one = edges.select(*keys, "src", "dst")
    back = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"))
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("src"))
    return one.unionByName(back).unionByName(ends.select(*keys, "src", F.col("src").alias("dst"))).distinct()


def level_edges(edges: DataFrame, levels: int, keys: list[str] | None = None) -> DataFrame:
    """keys, level, src, dst: for each level the edges with (src + dst) % levels below it, symmetric and with loops (GRF-3).

    Nodes are numbers from 0; every node that any edge has keeps its loop on all levels.
    """
    keys = keys or []
    level = F.explode(F.sequence(F.lit(1), F.lit(levels))).alias("level")
    wide = edges.select(*keys, "src", "dst", level).where(F.pmod(F.col("src") + F.col("dst"), F.lit(levels)) < F.col("level"))
    loops = edges.select(*keys, F.explode(F.array("src", "dst")).alias("src")).distinct().select(*keys, level, "src", F.col("src").alias("dst"))
    return symmetric(wide, [*keys, "level"]).unionByName(loops.select(*keys, "level", "src", "dst")).distinct()


def hierarchical_mask(edges: DataFrame, levels: int, most: int, keys: list[str] | None = None, rate: float = 0.6) -> DataFrame:
    """keys, src, dst, mean, top: the mean and the greatest of exp(-rate x hops) over the levels' graphs, as shares of a graph's greatest mean (MTH-3).

    A sparse table: pairs that no level connects within so many hops have no
    row; on a level that does not connect them they count 0.
    """
    keys = keys or []
    wide = checkpointed(level_edges(edges, levels, keys))
    paths = closure(wide, [*keys, "level"], most)
    loops = wide.where("src = dst").select(*keys, "level", "src", "dst", F.lit(0).cast("long").alias("hops"))
    each = paths.unionByName(loops).withColumn("_v", decay(F.col("hops"), "exponential", rate, most))
    pairs = checkpointed(each.groupBy(*keys, "src", "dst").agg((F.sum("_v") / levels).alias("mean"), F.max("_v").alias("top")))
    if not keys:
        return pairs.crossJoin(pairs.agg(F.max("mean").alias("_m"))).select("src", "dst", (F.col("mean") / F.col("_m")).alias("mean"), "top")  # one row
    greatest = pairs.groupBy(*keys).agg(F.max("mean").alias("_m"))
    return pairs.join(greatest, keys).select(*keys, "src", "dst", (F.col("mean") / F.col("_m")).alias("mean"), "top")
