"""Layouts of whole graphs: springs with forces from a grid, and stress against pivots (VIZ-1)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .graph_algorithms import both_ways
from .lineage import at_rest, checkpointed, dealt, stored
from .paths import hops_of, met

#: Cells to a side of the grid; nodes of a cell that meet their neighbours one by one.
CELLS, NEAR = 32, 64
#: The most pivots: their distances to each other are laid out on the driver.
MAX_PIVOTS = 64
_FORCE = "id string, fx double, fy double"


def start(nodes: DataFrame) -> DataFrame:
    """id, x, y: places in the unit disc that follow from the ids."""
    u = lambda tag: F.pmod(X.stable_number(F.concat(F.lit(tag), F.col("id"))), F.lit(1_000_003)) / 1_000_003.0
    r, angle = F.sqrt(u("r")), 2 * np.pi * u("a")
    return nodes.select("id", (r * F.cos(angle)).alias("x"), (r * F.sin(angle)).alias("y"))


def _cell(x: np.ndarray, low: float, size: float, cells: int) -> np.ndarray:
    return np.clip(((x - low) / size).astype(np.int64), 0, cells - 1)


def repulsion(places: DataFrame, strength: float = 4.0, cells: int = CELLS, near: int = NEAR) -> DataFrame:
    """id, fx, fy: what pushes each of places (id, x, y) from all others, strength over the distance.

    Cells that are not beside a node's own push with their count from their
    mean place, and so do those beside it, and its own, that hold more than
    `near` nodes; the other nodes around push one by one. So a node meets at
    most cells x cells means and 9 x near nodes, whatever the graph. Nodes in
    one place do not push each other.
    """
    box = places.agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    if box[0] is None:
        return places.select("id", F.lit(0.0).alias("fx"), F.lit(0.0).alias("fy"))
    low = (box[0], box[1])
    size = max(box[2] - box[0], box[3] - box[1], 1e-9) / cells
    at = lambda c, k: F.least(F.greatest(F.floor((F.col(c) - low[k]) / size), F.lit(0)), F.lit(cells - 1)).cast("int")
    dealt = checkpointed(places.select("id", "x", "y", at("x", 0).alias("_cx"), at("y", 1).alias("_cy")))
    sums = dealt.groupBy("_cx", "_cy").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    means = [tuple(r) for r in sums.collect()]  # cells x cells rows at most
    cx, cy, n, mx, my = (np.array(c, float) for c in zip(*means))

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, ax, ay = (b.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("x", "y", "_cx", "_cy"))
            fx, fy = np.zeros(len(x)), np.zeros(len(x))
            for i in range(0, len(x), 512):
                s = slice(i, i + 512)
                beside = np.maximum(np.abs(cx - ax[s, None]), np.abs(cy - ay[s, None])) <= 1
                own = (cx == ax[s, None]) & (cy == ay[s, None])
                # of its own crowded cell a node meets the mean of the others
                many = np.where(own, n - 1, n)
                px = np.where(own & (n > 1), (n * mx - x[s, None]) / np.maximum(many, 1), mx)
                py = np.where(own & (n > 1), (n * my - y[s, None]) / np.maximum(many, 1), my)
                dx, dy = x[s, None] - px, y[s, None] - py
                d2 = dx * dx + dy * dy
                w = np.where((~beside | (n > near)) & (d2 > 1e-18), strength * many / np.maximum(d2, 1e-18), 0.0)
                fx[s], fy[s] = (w * dx).sum(1), (w * dy).sum(1)
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fx), pa.array(fy)], names=["id", "fx", "fy"])

    light = sums.where(F.col("n") <= near).select("_cx", "_cy")
    shown = dealt.join(F.broadcast(light), ["_cx", "_cy"])  # cells x cells rows at most
    step = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    seen = dealt.select("id", "x", "y", "_cx", "_cy", F.explode(step).alias("s")).select("id", "x", "y", (F.col("_cx") + F.col("s.a")).alias("_cx"), (F.col("_cy") + F.col("s.b")).alias("_cy"))
    # both tables that the nodes meet are bounded, so no node moves before its forces are summed
    met = seen.join(F.broadcast(light), ["_cx", "_cy"], "left_semi").join(F.broadcast(shown.select("_cx", "_cy", F.col("id").alias("_o"), F.col("x").alias("_x"), F.col("y").alias("_y"))), ["_cx", "_cy"]).where("id <> _o")  # cells x cells x near rows at most
    dx, dy = F.col("x") - F.col("_x"), F.col("y") - F.col("_y")
    d2 = dx * dx + dy * dy
    w = F.when(d2 > 1e-18, F.lit(strength) / d2).otherwise(0.0)
    close = met.groupBy("id").agg(F.sum(w * dx).alias("fx"), F.sum(w * dy).alias("fy"))
    return dealt.select("id", "x", "y", "_cx", "_cy").mapInArrow(far, _FORCE).unionByName(close).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def attraction(places: DataFrame, edges: DataFrame, length: float = 2.0) -> DataFrame:
    """id, fx, fy: what draws the ends of edges (src, dst) together, the square of their distance over a length."""
    a = places.select(F.col("id").alias("src"), F.col("x").alias("_ax"), F.col("y").alias("_ay"))
    b = places.select(F.col("id").alias("dst"), F.col("x").alias("_bx"), F.col("y").alias("_by"))
    e = edges.select("src", "dst").where("src <> dst").join(a, "src").join(b, "dst")
    dx, dy = F.col("_ax") - F.col("_bx"), F.col("_ay") - F.col("_by")
    d = F.sqrt(dx * dx + dy * dy) / length
    pull = e.select("src", "dst", (d * dx).alias("fx"), (d * dy).alias("fy"))
    both = pull.select(F.col("src").alias("id"), (-F.col("fx")).alias("fx"), (-F.col("fy")).alias("fy")).unionByName(pull.select(F.col("dst").alias("id"), "fx", "fy"))
    return both.groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))


def spring(nodes: DataFrame, edges: DataFrame, steps: int = 100, length: float = 2.0, heat: float = 2.0) -> DataFrame:
    """id, x, y of a graph of any size by springs; each step is a round over the tables, checkpointed.

    A node moves along its force, by no more than the heat, which cools by a
    twentieth each step.
    """
    places = checkpointed(start(nodes))
    edges = checkpointed(dealt(edges.select("src", "dst").where("src <> dst"), "src"))  # once, not in each round
    for _ in range(steps):
        force = repulsion(places, length * length).unionByName(attraction(places, edges, length)).groupBy("id").agg(F.sum("fx").alias("fx"), F.sum("fy").alias("fy"))
        size = F.sqrt(F.col("fx") * F.col("fx") + F.col("fy") * F.col("fy"))
        move = F.when(size > 0, F.least(F.lit(heat), size) / size).otherwise(0.0)
        places = checkpointed(places.join(force, "id").select("id", (F.col("x") + F.col("fx") * move).alias("x"), (F.col("y") + F.col("fy") * move).alias("y")))
        heat *= 0.95
    return places


def _majorized(xy: np.ndarray, to: np.ndarray, d: np.ndarray, steps: int) -> np.ndarray:
    """Places xy moved so that their distances to fixed places come near d, weighed by the inverse square of d."""
    w = 1 / np.maximum(d, 1e-9) ** 2 * (d > 0)
    for _ in range(steps):
        gap = xy[:, None] - to[None]
        r = np.maximum(np.sqrt((gap * gap).sum(2)), 1e-9)
        xy = (w[..., None] * (to[None] + gap * (d / r)[..., None])).sum(1) / np.maximum(w.sum(1, keepdims=True), 1e-12)
    return xy


def _scaled(d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of points in the plane by their distances (classical scaling), and what gives others theirs: the mean squares and a matrix."""
    square = d * d
    mean = square.mean(0)
    value, vector = np.linalg.eigh(-0.5 * (square - mean[:, None] - mean[None] + mean.mean()))
    value, vector = np.maximum(value[::-1][:2], 0), vector[:, ::-1][:, :2]
    vector = vector * np.where(vector[np.abs(vector).argmax(0), range(vector.shape[1])] < 0, -1, 1)  # one of the two signs
    root = np.sqrt(value)
    back = vector / np.where(root > 1e-9, root, np.inf)
    two = lambda m: np.pad(m, ((0, 0), (0, 2 - m.shape[1])))
    return two(vector * root), mean, two(back)


def _spread(d: np.ndarray, many: int) -> list[int]:
    """The first and then the farthest from those taken, up to so many."""
    taken, near = [0], d[0].copy()
    while len(taken) < min(many, len(d)):
        near[taken] = -1
        taken.append(int(near.argmax()))
        near = np.minimum(near, d[taken[-1]])
    return taken


def stress(nodes: DataFrame, edges: DataFrame, pivots: int = 16, steps: int = 50) -> DataFrame:
    """id, x, y of a graph of any size: each node's distances to the pivots are as near to its hops as they come.

    Candidates are the nodes of most neighbours and as many that a digest of
    the ids picks, MAX_PIVOTS in all; pivots are the first of them and those
    farthest apart. Edges count both ways. The few pivots are laid out by the
    hops between them, and then every node finds its place among them by
    itself, in one pass. Pivots that a node does not reach are one hop beyond
    the longest way. Nodes of equal hops stand beside each other by their ids.
    """
    if not 2 <= pivots <= MAX_PIVOTS:
        raise ValueError(f"pivots are 2 to {MAX_PIVOTS}")
    both = at_rest(both_ways(edges), "src")
    degree = stored(nodes.select("id").distinct().join(both.groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("n")), "id", "left"))
    first = [r.id for r in degree.orderBy(F.desc_nulls_last("n"), "id").limit(MAX_PIVOTS // 2).collect()]
    some = [r.id for r in degree.select("id").orderBy(X.stable_number(F.col("id")), "id").limit(MAX_PIVOTS // 2).collect()]
    chosen = list(dict.fromkeys(first + some))
    if not chosen:
        return nodes.select("id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    each, beyond = met(nodes, both, chosen)
    number = F.sequence(F.lit(0), F.lit(len(chosen) - 1))
    known = stored(each.withColumn("_n", number).select("id", F.expr(f"transform(_n, k -> cast({hops_of('k', beyond)} AS double))").alias("d")))
    own = {r.id: r.d for r in known.where(F.col("id").isin(chosen)).collect()}
    d = np.array([own[c] for c in chosen])
    d = np.maximum(d, d.T)
    taken = _spread(d, pivots)
    d = d[np.ix_(taken, taken)]
    fixed, mean, back = _scaled(d)
    for _ in range(steps):
        fixed = _majorized(fixed, fixed, d, 1) if len(taken) > 1 else fixed
    places = {chosen[c]: p for c, p in zip(taken, fixed)}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            ids = b.column("id").to_pylist()
            far = b.column("d").flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)[:, taken]
            spread = b.column("a").to_numpy(zero_copy_only=False)
            at = -0.5 * (far * far - mean) @ back + 0.3 * np.stack([np.cos(spread), np.sin(spread)], 1)
            at = _majorized(at, fixed, far, steps)
            for k, i in enumerate(ids):
                if i in places:
                    at[k] = places[i]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(at[:, 0]), pa.array(at[:, 1])], names=["id", "x", "y"])

    apart = 2 * np.pi * F.pmod(X.stable_number(F.col("id")), F.lit(1_000_003)) / 1_000_003.0
    return known.select("id", "d", apart.alias("a")).mapInArrow(place, "id string, x double, y double")
