"""Components, paths, degrees, layouts and chain graphs (GRF-1..6, VIZ-1..3, TOP-5, ARR-1)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..kg import KG
from . import windows
from .filters import induced, touched
from .lineage import at_rest, checkpointed, dealt, swept


def numbered(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A number for each id (id, n), checkpointed, and the edges among them as numbers (src, dst), each as often as it is there.

    Rounds over numbers shuffle and hold a small part of what ids would.
    """
    ids = checkpointed(nodes.select("id").distinct().withColumn("n", F.monotonically_increasing_id()))
    out = edges.select("src", "dst")
    for end in ("src", "dst"):
        out = dealt(out, end).join(ids.select(F.col("id").alias(end), F.col("n").alias(f"_{end}")), end).drop(end)
    return ids, out.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """id, component of nodes (id) over edges (src, dst), the least id naming it; lone nodes are their own (GRF-1).

    Labels are numbers; they sink along edges and jump to their labels' labels,
    so long paths need few rounds; each round is checkpointed.
    """
    ids, inner = numbered(nodes, edges)
    inner = inner.where("src <> dst")
    both = checkpointed(dealt(inner.unionByName(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "src").distinct())
    labels = checkpointed(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        low = both.join(labels.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("component").alias("low"))
        near = labels.join(low, "id").select("id", F.col("component").alias("old"), F.least("component", "low").alias("component"))
        jump = near.select(F.col("id").alias("component"), F.col("component").alias("further"))
        after = checkpointed(near.join(jump, "component").select("id", "old", F.col("further").alias("component")))
        changed = after.where("old <> component").limit(1).count()
        labels = after.select("id", "component")
        if not changed:
            break
    of = ids.join(labels.withColumnRenamed("id", "n"), "n").select("id", "component")
    names = of.groupBy("component").agg(F.min("id").alias("_name"))
    named = of.join(names, "component").select("id", F.col("_name").alias("component"))
    return nodes.select("id").join(named, "id", "left").withColumn("component", F.coalesce("component", "id"))


def distances(edges: DataFrame, most: int) -> DataFrame:
    """src, dst, hops of directed shortest paths of at most so many edges (GRF-2); frontiers meet what is known by anti join."""
    known = frontier = checkpointed(edges.where("src <> dst").select("src", "dst").distinct().withColumn("hops", F.lit(1)))
    step = edges.select(F.col("src").alias("dst"), F.col("dst").alias("next")).distinct()
    for hops in range(2, most + 1):
        new = frontier.join(step, "dst").select("src", F.col("next").alias("dst")).where("src <> dst").distinct()
        frontier = checkpointed(new.join(known, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hops)))
        if not frontier.limit(1).count():
            break
        known = known.unionByName(frontier)
    return known


def simple_edges(kg: KG) -> DataFrame:
    """Undirected edges (a, b), one for each pair, with its last relation in order (GRF-4)."""
    known = induced(kg, kg.entities).relations
    order = F.struct("relation_type", "head", "tail")
    known = dealt(known.withColumn("a", F.least("head", "tail")).withColumn("b", F.greatest("head", "tail")), "a", "b")
    return known.groupBy("a", "b").agg(F.max_by("relation_type", order).alias("relation_type"), F.count(F.lit(1)).alias("parallel"))


def degrees(kg: KG) -> DataFrame:
    """id, degree, size of each node in the simple graph (GRF-6): 0.1 to 0.25 by degree."""
    ends = simple_edges(kg).where("a <> b").select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    d = kg.entities.select("id").join(ends, "id", "left").na.fill(0, ["degree"])
    most = d.agg(F.max("degree").alias("_most"))  # one row
    return d.crossJoin(most).select("id", "degree", F.round(F.greatest(F.lit(0.05), F.lit(0.1) + 0.15 * F.col("degree") / F.greatest("_most", F.lit(1))), 6).alias("size"))


def simplify(kg: KG, nodes: int, edges: int, least: float = 0.0) -> KG:
    """The nodes of highest confidence, then the relations among them of highest confidence, then what those touch (TOP-5)."""
    kept = kg.entities.where(F.col("confidence") >= least).orderBy(F.desc("confidence"), "ord").limit(nodes)
    relations = induced(KG(kept, kg.relations.where(F.col("confidence") >= least)), kept).relations
    relations = relations.orderBy(F.desc("confidence"), "head", "relation_type", "tail").limit(edges)
    return KG(touched(kept, relations), relations)


def circular(nodes: DataFrame, by: str, order: str) -> DataFrame:
    """x, y on a circle for each group of nodes (VIZ-1)."""
    p = windows.placed(nodes, [by], [order], "_place")
    angle = 2 * math.pi * (F.col("_place") - 1) / F.col("_place_of")
    return p.withColumn("x", F.round(F.cos(angle), 6)).withColumn("y", F.round(F.sin(angle), 6)).drop("_place", "_place_of")


def both_ways(edges: DataFrame) -> DataFrame:
    """src, dst of edges (src, dst) and of their reverse, made in one pass; loops are left out."""
    end = lambda a, b: F.struct(F.col(a).alias("src"), F.col(b).alias("dst"))
    return edges.where("src <> dst").select(F.explode(F.array(end("src", "dst"), end("dst", "src"))).alias("e")).select("e.src", "e.dst")


def rings(edges: DataFrame, centre: str, most: int) -> DataFrame:
    """id, ring: hops from a centre, for shell and hierarchical layouts (VIZ-1); the edges lie dealt by one end, and only the nodes of the rounds move."""
    spark = edges.sparkSession
    both = at_rest(both_ways(edges), "src", checkpointed)
    known = frontier = spark.createDataFrame([(centre, 0)], "id string, ring int")
    for ring in range(1, most + 1):
        new = both.join(frontier.select(F.col("id").alias("src")), "src").select(F.col("dst").alias("id")).distinct()
        frontier = swept(checkpointed(new.join(known, "id", "left_anti").withColumn("ring", F.lit(ring))))
        if not frontier.limit(1).count():
            break
        known = known.unionByName(frontier)
    return known


def median_degree(kg: KG) -> DataFrame:
    """One row: the median number of neighbours of a graph's nodes."""
    return degrees(kg).agg(F.median("degree").alias("_median"))


def bipartite(kg: KG) -> DataFrame:
    """id, side, x, y: nodes of more neighbours than the median to the right, the others to the left, each side in order of ids (VIZ-1)."""
    d = degrees(kg).crossJoin(median_degree(kg)).select("id", (F.col("degree") > F.col("_median")).alias("side"))  # one row
    d = windows.placed(d, ["side"], ["id"], "_place").withColumn("_n", F.col("_place_of"))
    y = F.when(F.col("_n") > 1, 2.0 * (F.col("_place") - 1) / (F.col("_n") - 1) - 1.0).otherwise(0.0)
    return d.select("id", "side", F.when(F.col("side"), 1.0).otherwise(-1.0).alias("x"), F.round(y, 6).alias("y"))


def shells(edges: DataFrame, centre: str, most: int) -> DataFrame:
    """id, ring, x, y: rings around a centre, half a unit apart, each in order of ids (VIZ-1)."""
    r = windows.placed(rings(edges, centre, most), ["ring"], ["id"], "_place")
    angle = 2 * math.pi * (F.col("_place") - 1) / F.col("_place_of")
    return r.select("id", "ring", (F.round(F.cos(angle) * 0.5 * F.col("ring"), 6) + 0).alias("x"), (F.round(F.sin(angle) * 0.5 * F.col("ring"), 6) + 0).alias("y"))


def hierarchical(edges: DataFrame, root: str, most: int) -> DataFrame:
    """id, depth, x, y: levels below a root, half a unit apart, each spread over -1 to 1 in order of ids (VIZ-1)."""
    r = windows.placed(rings(edges, root, most).withColumnRenamed("ring", "depth"), ["depth"], ["id"], "_place")
    x = F.when(F.col("_place_of") > 1, 2.0 * (F.col("_place") - 1) / (F.col("_place_of") - 1) - 1.0).otherwise(0.0)
    return r.select("id", "depth", F.round(x, 6).alias("x"), (F.col("depth") * -0.5 + 0).alias("y"))


#: The most nodes of a graph that forces lay out: all of it is in one task.
SPRING_NODES = 2000


def spring(nodes: DataFrame, edges: DataFrame, by: str, steps: int = 100) -> DataFrame:
    """x, y by forces, for each group's graph in one task (VIZ-1): for graphs small enough to draw.

    A graph of over SPRING_NODES nodes is refused with an error; draw a
    simplified one (simplify) or use another layout.
    """
    import pandas as pd

    def place(left: "pd.DataFrame", right: "pd.DataFrame") -> "pd.DataFrame":
        import numpy as np

        left = left.sort_values("id").reset_index(drop=True)
        n = len(left)
        if n > SPRING_NODES:
            raise ValueError(f"a graph of {n} nodes is too large for forces; at most {SPRING_NODES}")
        at = {k: i for i, k in enumerate(left["id"])}
        angle = 2 * np.pi * np.arange(n) / max(1, n)
        xy = np.stack([np.cos(angle), np.sin(angle)], 1)
        pairs = [(at[a], at[b]) for a, b in zip(right["src"], right["dst"]) if a in at and b in at and a != b]
        k = (1.0 / max(1, n)) ** 0.5
        for s in range(steps):
            d = xy[:, None] - xy[None]
            r = np.maximum(np.sqrt((d**2).sum(-1)), 1e-3)
            force = (d / r[..., None] * (k * k / r)[..., None]).sum(1)
            for i, j in pairs:
                v = xy[i] - xy[j]
                f = v * (np.linalg.norm(v) / k)
                force[i] -= f
                force[j] += f
            length = np.maximum(np.linalg.norm(force, axis=1, keepdims=True), 1e-9)
            xy = xy + force / length * np.minimum(length, 0.1 * (1 - s / steps))
        return pd.DataFrame({by: left[by], "id": left["id"], "x": xy[:, 0].round(6), "y": xy[:, 1].round(6)})

    kind = dict(nodes.dtypes)[by]
    return nodes.select(by, "id").groupBy(by).cogroup(edges.select(by, "src", "dst").groupBy(by)).applyInPandas(place, f"{by} {kind}, id string, x double, y double")


# The chain graph's shape.
ROOTS, LEAVES, PAD = 128, 7, 0


def chain(docs: DataFrame, key: str, tokens: Column) -> DataFrame:
    """key, root_ix, token_id, is_pad of a text's chain: ROOTS roots, filled up with PAD (GRF-5)."""
    # the ids are settled in a row of their own: beside an explode they would be made for each of its rows
    rows = docs.select(key, F.slice(tokens, 1, ROOTS).alias("_ids")).withColumn("_n", F.size("_ids"))
    full = F.concat("_ids", F.array_repeat(F.lit(PAD).cast("long"), ROOTS - F.col("_n")))
    return rows.select(key, "_n", F.posexplode(full).alias("root_ix", "token_id")).select(key, "root_ix", "token_id", (F.col("root_ix") >= F.col("_n")).alias("is_pad"))


def inject(roots: DataFrame, key: str, triples: DataFrame) -> DataFrame:
    """Roots with relation and leaves of the last triple injected at each: (key, root_ix, ord, relation, tail_tokens) (GRF-5)."""
    last = triples.groupBy(key, "root_ix").agg(F.max_by(F.struct("relation", "tail_tokens"), "ord").alias("t"), F.count(F.lit(1)).alias("injections"))
    cut = F.slice(F.col("t.tail_tokens"), 1, LEAVES)
    leaves = F.concat(cut, F.array_repeat(F.lit(PAD).cast("long"), LEAVES - F.size(cut)))
    none = F.array_repeat(F.lit(PAD).cast("long"), LEAVES)
    return roots.join(last, [key, "root_ix"], "left").select(key, "root_ix", "token_id", "is_pad", F.col("t.relation").alias("relation"), F.coalesce(leaves, none).alias("leaves"), F.coalesce("injections", F.lit(0)).alias("injections"))


def sequence(chained: DataFrame, key: str) -> DataFrame:
    """key, ids, mask: the roots, then all leaves, row by row (ARR-1)."""
    rows = F.sort_array(F.collect_list(F.struct("root_ix", "token_id", "is_pad", "leaves", (F.col("injections") > 0).alias("in"))))
    g = chained.groupBy(key).agg(rows.alias("r"))
    ids = F.concat(F.transform("r", lambda x: x["token_id"]), F.flatten(F.transform("r", lambda x: x["leaves"])))
    mask = F.concat(F.transform("r", lambda x: (~x["is_pad"]).cast("int")), F.flatten(F.transform("r", lambda x: F.array_repeat(x["in"].cast("int"), LEAVES))))
    return g.select(key, ids.alias("ids"), mask.alias("mask"))


def chain_edges(spark: SparkSession, roots: int = ROOTS, leaves: int = LEAVES) -> DataFrame:
    """src, dst of a chain graph: each root to the next and to its leaves (GRF-3)."""
    r = spark.range(roots).withColumnRenamed("id", "src")
    down = r.where(F.col("src") < roots - 1).select("src", (F.col("src") + 1).alias("dst"))
    return down.unionByName(r.select("src", F.explode(F.sequence(F.lit(0), F.lit(leaves - 1))).alias("l")).select("src", (roots + F.col("src") * leaves + F.col("l")).cast("long").alias("dst")))


def chain_distances(spark: SparkSession, roots: int = ROOTS, leaves: int = LEAVES) -> DataFrame:
    """src, dst, hops between all nodes of a chain graph, in closed form: the shape is fixed, no search is needed (GRF-2)."""
    n = roots * (1 + leaves)
    node = spark.range(n).select("id", F.when(F.col("id") < roots, F.col("id")).otherwise(F.floor((F.col("id") - roots) / leaves)).alias("root"), (F.col("id") >= roots).cast("long").alias("leaf"))
    a = node.where("leaf = 0").select(F.col("id").alias("src"), F.col("root").alias("r"))
    b = node.select(F.col("id").alias("dst"), F.col("root").alias("q"), "leaf")
    # a fixed table of roots x nodes, the same for every text; built once
    return a.join(b, F.col("q") >= F.col("r")).where("src <> dst").select("src", "dst", (F.col("q") - F.col("r") + F.col("leaf")).alias("hops"))


def chains_edges(rows: DataFrame, key: str, n: str, leaves: int = LEAVES) -> DataFrame:
    """key, src, dst of a chain graph of n roots for each of rows (key, n): each root to the next and to its leaves (GRF-3)."""
    r = rows.where(F.col(n) > 0).select(key, F.col(n).cast("long").alias("_n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(n).cast("long") - 1)).alias("src"))
    below = F.transform(F.sequence(F.lit(0), F.lit(leaves - 1)), lambda leaf: (F.col("_n") + F.col("src") * leaves + leaf).cast("long"))
    after = F.when(F.col("src") + 1 < F.col("_n"), F.array(F.col("src") + 1)).otherwise(F.array().cast("array<long>"))
    return r.select(key, "src", F.explode(F.concat(after, below)).alias("dst"))


def chains_hops(rows: DataFrame, key: str, n: str, leaves: int = LEAVES) -> DataFrame:
    """key, hops, pairs: how many pairs of nodes of a chain graph of n roots are so far apart, for each of rows (key, n) (GRF-2).

    A root reaches the roots after it and their leaves, and its own leaves, so
    the counts come in closed form: no distance is searched.
    """
    size = F.col(n).cast("long")
    h = rows.where(size > 0).select(key, size.alias("_n"), F.explode(F.sequence(F.lit(1).cast("long"), size)).alias("hops"))
    return h.select(key, "hops", ((F.col("_n") - F.col("hops")) + (F.col("_n") - F.col("hops") + 1) * leaves).alias("pairs"))


#: Colours of types in drawings (VIZ-2).
COLOURS = {"REGION": "#1f77b4", "NATION": "#2ca02c"}
OTHER_COLOUR = "#7f7f7f"


def colour(label: Column, colours: dict[str, str] = COLOURS, other: str = OTHER_COLOUR) -> Column:
    """A type's colour, or that of all others (VIZ-2)."""
    table = F.create_map(*(F.lit(x) for p in colours.items() for x in p))
    return F.coalesce(F.element_at(table, label), F.lit(other))
