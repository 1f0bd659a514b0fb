"""Approximate nearest neighbours by learned partitions (operator 7).

A neighbour graph over a bounded sample of distinct vectors is cut into
balanced parts with few edges between them. A small network then learns, for a
vector, in which parts its neighbours lie; it deals all vectors to parts and
routes each query to its most probable parts. A part of more than twice
PART_ROWS vectors is parted again in the same way, by a network of its own that a task of
its own fits, so the number of parts grows with the table and their size does
not. How much probability a query follows is set for each network on a part of
its sample that neither the graph nor the network has seen, so that the levels
together reach RECALL. There candidates are reranked by exact distances on the
original vectors.

Equal vectors are one candidate that holds its smallest ids, as many as any
query can return, and equal queries are searched once, so copies cost nothing.
Parts that no network can divide are cut into blocks of bounded size, all of
which are searched.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_path, small_batches, table, written

#: Distinct vectors that a part is to hold (of twice as many it is parted again), parts of a part, and vectors that one network is fitted on (picked by hash).
PART_ROWS, FAN, FIT_ROWS = 128, 32, 4096
GRAPH, HIDDEN, EPOCHS = 10, 128, 40
RECALL = 0.98
#: Levels of parts; vectors or queries that a task routes or searches, and vectors of a block of an undivided part.
MAX_DEPTH, ROUTE_ROWS, BLOCK = 8, 20_000, 4000
#: The share of a sample that is held back from a network to set how far queries go.
HELD_BACK = 0.2


def _nearest(x: np.ndarray, queries: np.ndarray, k: int, skip_self: bool) -> np.ndarray:
    """Row numbers of the k nearest rows of x for each query row number."""
    sq, out = (x * x).sum(1), []
    for at in range(0, len(queries), 128):
        q = queries[at : at + 128]
        d = sq[None, :] - 2 * x[q] @ x.T
        if skip_self:
            d[np.arange(len(q)), q] = np.inf
        k_ = min(k, d.shape[1] - 1)
        out.append(np.argpartition(d, k_, axis=1)[:, :k_] if k_ else np.zeros((len(q), 0), int))
    return np.concatenate(out) if out else np.zeros((0, 0), int)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, seed: int = 0, slack: float = 1.1) -> np.ndarray:
    """Parts of nearly equal size with few graph edges between them: halving along main axes, then moves that cut fewer edges."""
    n = len(x)
    part = np.zeros(n, int)
    groups, number = [(np.arange(n), parts)], 0
    while groups:
        rows, k = groups.pop()
        if k == 1 or len(rows) < 2:
            part[rows] = number
            number += 1
            continue
        y = x[rows] - x[rows].mean(0)
        axis = np.linalg.eigh(y.T @ y)[1][:, -1]
        left = k // 2
        order = rows[np.argsort(y @ axis, kind="stable")]
        cut = round(len(rows) * left / k)
        groups += [(order[:cut], left), (order[cut:], k - left)]
    number = max(1, number)
    size, most = np.bincount(part, minlength=number), int(np.ceil(slack * n / number))
    rng = np.random.default_rng(seed)
    into = [[] for _ in range(n)]
    for i, row in enumerate(graph):
        for j in row:
            into[j].append(i)
    for _ in range(8):
        moved = 0
        for i in rng.permutation(n):
            near = np.bincount(part[np.concatenate([graph[i], into[i]]).astype(int)], minlength=number) if len(graph[i]) or into[i] else np.zeros(number)
            near = np.where((size < most) | (np.arange(number) == part[i]), near, -1)
            to = int(near.argmax())
            if near[to] > near[part[i]] and size[part[i]] > 1:
                size[part[i]] -= 1
                size[to] += 1
                part[i] = to
                moved += 1
        if moved < n // 200:
            break
    return part


@dataclass
class Router:
    """A network of one hidden layer: vector -> probability of each part.

    Vectors are scaled by a power of two and clipped, so components of any
    size can be routed. A query follows the most probable parts until those
    before have the probability mass.
    """

    unit: float
    mean: np.ndarray
    scale: float
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    mass: float = 1.0

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        h = np.maximum(((_scaled(x, self.unit) - self.mean) / self.scale) @ self.w1 + self.b1, 0)
        z = h @ self.w2 + self.b2
        z = np.exp(z - z.max(1, keepdims=True))
        return z / z.sum(1, keepdims=True)

    def deal(self, x: np.ndarray) -> np.ndarray:
        return self.probabilities(x).argmax(1)

    def ways(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts from the most to the least probable, and the mass before each."""
        p = self.probabilities(x)
        order = np.argsort(-p, axis=1, kind="stable")
        p = np.take_along_axis(p, order, axis=1)
        return order, np.cumsum(p, axis=1) - p

    def route(self, x: np.ndarray) -> list[np.ndarray]:
        order, before = self.ways(x)
        return [o[b <= self.mass] for o, b in zip(order, before)]


def _scaled(x: np.ndarray, unit: float) -> np.ndarray:
    return np.clip(x / unit, -16.0, 16.0)


def fit(x: np.ndarray, parts: int, recall: float = RECALL, seed: int = 0) -> Router:
    """The router from a sample of distinct vectors."""
    rng = np.random.default_rng(seed)
    some = np.abs(x[x != 0])
    unit = 2.0 ** np.clip(np.round(np.log2(np.median(some))), -1000, 1000) if len(some) else 1.0
    whole = _scaled(x, unit)
    order = rng.permutation(len(x))
    held = order[: int(len(x) * HELD_BACK)]
    z = whole[order[len(held) :]]
    n, dim = z.shape
    mean, scale = z.mean(0), float(z.std()) or 1.0
    graph = _nearest(z, np.arange(n), GRAPH, True)
    part = balanced_parts(z, graph, parts, seed)
    parts = int(part.max()) + 1
    target = np.zeros((n, parts))
    np.add.at(target, (np.arange(n), part), 1.0)
    for c in range(graph.shape[1]):
        np.add.at(target, (np.arange(n), part[graph[:, c]]), 1.0)
    target /= target.sum(1, keepdims=True)
    w = [rng.normal(0, (2 / dim) ** 0.5, (dim, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, (1 / HIDDEN) ** 0.5, (HIDDEN, parts)), np.zeros(parts)]
    m, v, step = [np.zeros_like(a) for a in w], [np.zeros_like(a) for a in w], 0
    y = (z - mean) / scale
    for epoch in range(EPOCHS):
        turn = rng.permutation(n)
        for at in range(0, n, 256):
            i = turn[at : at + 256]
            h = np.maximum(y[i] @ w[0] + w[1], 0)
            p = h @ w[2] + w[3]
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            g = (p - target[i]) / len(i)
            gh = (g @ w[2].T) * (h > 0)
            step += 1
            rate = 0.004 * (1 - epoch / EPOCHS) + 0.0002
            for k, grad in enumerate((y[i].T @ gh, gh.sum(0), h.T @ g, g.sum(0))):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.999 * v[k] + 0.001 * grad**2
                w[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    router = Router(unit, mean, scale, *w)
    if len(held) >= 8:
        # neighbours that the network has not seen, of queries that it has not seen: where it deals them is what counts
        near = _nearest(whole, held, GRAPH, True)
        lies = router.deal(x)[near]
        ways, before = router.ways(x[held])
        mass = np.take_along_axis(before, np.argsort(ways, axis=1), axis=1)
        needed = np.sort(np.take_along_axis(mass, lies, axis=1).ravel())
        router.mass = float(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) if len(needed) else 1.0
    return router


def distances(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Euclidean distances of rows of v from q in double precision; those whose squares overflow or vanish by scaled differences."""
    with np.errstate(over="ignore", under="ignore", invalid="ignore"):
        d = v - q
        out = np.sqrt((d * d).sum(1))
        odd = ~np.isfinite(out) | (out < 1e-140)
        if odd.any():
            most = np.abs(d[odd]).max(1, initial=0.0)
            unit = np.where(most > 0, most, 1.0)[:, None]
            out[odd] = most * np.sqrt(((d[odd] / unit) ** 2).sum(1))
    return out


def nearest_rows(v: np.ndarray, q: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row of q the rows of v among which its k nearest lie, by a matrix product; all rows where its rounding could hide them."""
    if len(v) <= k:
        return [np.arange(len(v))] * len(q)
    with np.errstate(over="ignore", invalid="ignore"):
        sq, own = (v * v).sum(1), (q * q).sum(1)
        near = sq[None, :] - 2 * q @ v.T
        limit = np.partition(near, k - 1, axis=1)[:, k - 1] if np.isfinite(near).all() else np.full(len(q), np.inf)
        limit = limit + 1e-13 * (own + 2 * np.sqrt(own * sq.max()) + sq.max())
    return [np.flatnonzero(~(row > most)) for row, most in zip(near, limit)]


def _usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector can take part: finite and not zero."""
    v = F.col("embedding")
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return ok.where(v.isNotNull() & F.col("vec_id").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0))


def _models(todo: DataFrame, big: DataFrame, recall: float) -> DataFrame:
    """node, salts, model of each part that is parted: fitted by a task of its own on a sample that its vectors' hashes pick."""
    share = F.least(F.lit(1.0), 2.0 * FIT_ROWS / F.col("n"))
    picked = todo.join(big, "node").withColumn("_h", F.xxhash64("embedding", F.lit(7))).where((F.col("_h") / F.lit(2.0**64) + 0.5) < share)
    picked = picked.withColumn("_r", F.row_number().over(Window.partitionBy("node").orderBy("_h", "key"))).where(F.col("_r") <= FIT_ROWS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        pdf = pdf.sort_values("_r")
        x = np.array(pdf["embedding"].tolist(), float)
        parts = min(FAN, -(-n // PART_ROWS), len(x) // 8)
        model = pickle.dumps(fit(x, parts, recall)) if parts > 1 else None
        return pd.DataFrame({"node": [pdf["node"].iloc[0]], "salts": [-(-n // ROUTE_ROWS)], "model": [model]})

    return picked.select("node", "n", "_r", "embedding").groupBy("node").applyInPandas(run, "node string, salts int, model binary").where("model IS NOT NULL")


def _parted(rows: DataFrame, models: DataFrame, key: str, all_ways: bool) -> DataFrame:
    """rows of the parts that models part, one level down: in the part that they are dealt to, or as queries in all that they follow."""
    schema = rows.schema
    salted = rows.join(models.select("node", "salts"), "node").withColumn("salt", F.pmod(F.xxhash64(key), F.col("salts")).cast("int")).drop("salts")
    each = models.select("node", "model", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        left = left[schema.names]
        if not len(left) or not len(right):
            return left.iloc[:0]
        router = pickle.loads(right["model"].iloc[0])  # noqa: S301 - written by _models
        x = np.array(left["embedding"].tolist(), float)
        to = router.route(x) if all_ways else router.deal(x)[:, None]
        at = np.repeat(np.arange(len(left)), [len(t) for t in to])
        out = left.iloc[at].copy()
        out["node"] = [f"{node}/{t}" for node, t in zip(out["node"], np.concatenate(list(to)).tolist())]
        return out

    return salted.groupBy("node", "salt").cogroup(each.groupBy("node", "salt")).applyInPandas(run, schema)


def search(vectors: DataFrame, is_query: Column, k: int = 10, report: dict | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: for each row that is_query marks, the k nearest other rows found.

    Nearness is the Euclidean distance in double precision; ties go to smaller
    vec_ids. Rows whose vec_id or vector is null, or whose vector is zero or
    holds null or non-finite components take no part; vectors are compared
    with those of the same dimension; rows of one vec_id and vector are one.
    Other columns are left aside. Without rows there are no results. report
    takes the levels of parts, and the share of all pairs of a distinct query
    and a distinct vector whose distance was looked at.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    made: list[str] = []
    rows = written(_usable(vectors).distinct(), "ann-rows", made)
    root = F.size("embedding").cast("string").alias("node")
    by_id = Window.partitionBy("embedding").orderBy("vec_id")
    least = rows.withColumn("r", F.row_number().over(by_id)).where(F.col("r") <= k + 1)
    groups = least.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    todo = groups = written(groups.withColumn("key", F.monotonically_increasing_id()).select("embedding", "ids", "key", root), "ann-groups", made)
    asked = rows.where(is_query)
    ask = queries = written(asked.select("embedding").distinct().withColumn("query", F.monotonically_increasing_id()).select("embedding", "query", root), "ann-queries", made)

    placed, routed, depth = [], [], 0
    total = groups.count()
    levels = max(1, math.ceil(math.log(max(2, total / (2 * PART_ROWS))) / math.log(FAN)))
    while depth < MAX_DEPTH:
        big = written(todo.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * PART_ROWS), "ann-big", made)
        models = written(_models(todo, big, RECALL ** (1 / levels)), "ann-models", made)
        if not models.limit(1).count():
            break
        done = models.select("node")
        placed.append(todo.join(done, "node", "left_anti"))
        routed.append(ask.join(done, "node", "left_anti"))
        todo = written(_parted(todo, models, "key", False), "ann-todo", made)
        ask = written(_parted(ask, models, "query", True), "ann-ask", made)
        depth += 1
    placed = reduce(DataFrame.unionByName, [*placed, todo])
    routed = reduce(DataFrame.unionByName, [*routed, ask])

    sizes = written(placed.groupBy("node").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")), "ann-sizes", made)
    if report is not None:
        pairs = routed.join(sizes, "node").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        report |= {"levels": depth, "parts": sizes.count(), "vectors": total, "share": pairs / max(1, queries.count() * total)}
    # parts are searched by shards of many: a query gets k + 1 rows of a shard, not of each part in it
    shard = F.pmod(F.xxhash64("node", "block"), max(1, -(-total // ROUTE_ROWS))).cast("int").alias("shard")
    placed = placed.join(sizes, "node").withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).select("embedding", "ids", "node", "block", shard)
    routed = routed.join(sizes, "node").select("query", "node", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")).select("query", "node", "block", shard)
    routed = written(routed.groupBy("query", "shard").agg(F.collect_list(F.struct("node", "block")).alias("to")), "ann-routed", made)
    salts = F.ceil(F.count(F.lit(1)) / ROUTE_ROWS).cast("int").alias("salts")
    salts = written(routed.groupBy("shard").agg(salts), "ann-salts", made)
    routed = routed.join(queries.select("query", "embedding"), "query").join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("query"), F.col("salts")).cast("int")).drop("salts")
    placed = placed.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"query": [], "score": [], "vec_id": []}
        if len(left) and len(right):
            vectors_, number = right["embedding"].tolist(), right["query"].to_numpy()
            asked_by: dict[tuple[str, int], list[int]] = {}
            for i, to in enumerate(right["to"]):
                for x in to:
                    asked_by.setdefault((x["node"], x["block"]), []).append(i)
            best: list[list[tuple[float, int]]] = [[] for _ in number]
            for place, rows_ in left.groupby(["node", "block"], sort=True):
                mine = asked_by.get(place, ())
                if not mine:
                    continue
                v, ids = np.array(rows_["embedding"].tolist(), float), rows_["ids"].tolist()
                for at in range(0, len(mine), 256):
                    q = np.array([vectors_[i] for i in mine[at : at + 256]], float)
                    for i, some in zip(range(len(q)), nearest_rows(v, q, k + 1)):
                        exact, own = distances(v[some], q[i]), mine[at + i]
                        best[own] += [(s, x) for j, s in zip(some, exact.tolist()) for x in ids[j]]
                        if len(best[own]) > 8 * (k + 1):
                            best[own] = sorted(best[own])[: k + 1]
            for i, pairs in enumerate(best):
                pairs = sorted(pairs)[: k + 1]
                out["query"] += [number[i]] * len(pairs)
                out["score"] += [s for s, _ in pairs]
                out["vec_id"] += [x for _, x in pairs]
        return pd.DataFrame(out)

    found = placed.groupBy("shard", "salt").cogroup(routed.groupBy("shard", "salt")).applyInPandas(rank, "query long, score double, vec_id long")
    # they are merged in two steps, so no task holds all of a query's
    top = lambda c: F.slice(F.sort_array(c), 1, k + 1)
    some = found.groupBy("query", F.pmod(F.xxhash64("vec_id"), 16).alias("_s")).agg(top(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    best = some.groupBy("query").agg(top(F.flatten(F.collect_list("near"))).alias("near"))
    best = written(best.join(queries, "query").select("embedding", "near"), "ann-best")
    asked_rows = written(asked, "ann-asked")
    near = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("vec_id")), 1, k)
    each = asked_rows.select("vec_id", "embedding").join(best, "embedding").select(F.col("vec_id").alias("query_id"), F.posexplode(near).alias("at", "x"))
    for path in made:
        drop_path(spark, path)
    return each.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
