"""A graph-attention layer as message passing over an edge table (TRN-5)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import checkpointed, small_batches

#: Parts that a node's incoming edges are dealt to before their sums meet, so that a hub is not one task's work.
PARTS = 16
#: Edges worked on at once where graphs stay in their rows.
SLICE = 1 << 17

Matrix = list[list[float]]


@dataclass(frozen=True)
class Layer:
    """Weights of a layer: rows are outputs. query, key, value and output are hidden x hidden, wide is 4 hidden x hidden, narrow hidden x 4 hidden."""

    heads: int
    query: Matrix
    key: Matrix
    value: Matrix
    output: Matrix
    wide: Matrix
    narrow: Matrix
    epsilon: float = 1e-12

    @property
    def hidden(self) -> int:
        return len(self.query)

    def __post_init__(self) -> None:
        if self.hidden % self.heads:
            raise ValueError("heads must divide the hidden size")


def gelu(x: np.ndarray) -> np.ndarray:
    return 0.5 * x * (1 + np.tanh(math.sqrt(2 / math.pi) * (x + 0.044715 * x * x * x)))


def normed(x: np.ndarray, epsilon: float) -> np.ndarray:
    """Rows less their mean, over their standard deviation."""
    x = x - x.mean(1, keepdims=True)
    return x / (x.std(1, keepdims=True) + epsilon)


def _rows(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A column of vectors of one length as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


_PARTIAL = "dst long, _part long, m array<double>, z array<double>, o array<double>"


def _folded(keys: np.ndarray, m: np.ndarray, z: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, ...]:
    """First place, maximum, sum of exponentials and weighted sums of each run of equal keys, on the scale of the run's maximum."""
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(1)]))
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(keys))))
    top = np.maximum.reduceat(m, first)
    w = np.exp(m - top[run])
    wide = np.repeat(w, o.shape[1] // w.shape[1], axis=1)
    return first, top, np.add.reduceat(z * w, first), np.add.reduceat(o * wide, first)


def _batch(keys: np.ndarray, m: np.ndarray, z: np.ndarray, o: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys[:, 0]), pa.array(keys[:, 1]), _lists(m), _lists(z), _lists(o)], names=["dst", "_part", "m", "z", "o"])


def attended(nodes: DataFrame, edges: DataFrame, layer: Layer, parts: int = PARTS) -> DataFrame:
    """id, x, context: what each of nodes (id long, x array<double>) hears over edges (src, dst), softmax weighted by head.

    An edge carries its source's key and value to its target. What a batch of
    edges holds for a target is folded at once to a maximum, a sum of
    exponentials and weighted sums; those of a target meet by parts, then the
    few parts meet, each time put on one scale. A repeated edge counts again;
    nodes without edges hear zeros.
    """
    hidden, heads = layer.hidden, layer.heads
    size = hidden // heads
    weights = [np.array(w).T for w in (layer.query, layer.key, layer.value)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _rows(b, "x", hidden)
            yield pa.RecordBatch.from_arrays([b.column("id"), *(_lists(x @ w) for w in weights)], names=["id", "q", "k", "v"])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column("dst").to_numpy(zero_copy_only=False), b.column("_part").to_numpy(zero_copy_only=False)], 1)
            order = np.lexsort((keys[:, 1], keys[:, 0]))
            q, k, v = (_rows(b, c, hidden)[order] for c in "qkv")
            s = (q * k).reshape(-1, heads, size).sum(2) / math.sqrt(size)
            keys = keys[order]
            first, m, z, o = _folded(keys, s, np.ones_like(s), v)
            yield _batch(keys[first], m, z, o)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last run, which the next batch may go on with
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column("dst").to_numpy(zero_copy_only=False), b.column("_part").to_numpy(zero_copy_only=False)], 1)
            new = (keys, _rows(b, "m", heads), _rows(b, "z", heads), _rows(b, "o", hidden))
            if held is not None:
                new = tuple(np.concatenate([a, c]) for a, c in zip(held, new))
            first, *sums = _folded(*new)
            keys = new[0][first]
            if len(first) > 1:
                yield _batch(keys[:-1], *(x[:-1] for x in sums))
            held = (keys[-1:], *(x[-1:] for x in sums))
        if held is not None:
            yield _batch(*held)

    known = checkpointed(nodes.select("id", "x").mapInArrow(project, "id long, q array<double>, k array<double>, v array<double>"))
    sent = edges.select("src", "dst").join(known.select(F.col("id").alias("src"), "k", "v"), "src").withColumn("_part", F.pmod(F.xxhash64("src"), F.lit(parts)))
    met = sent.join(known.select(F.col("id").alias("dst"), "q"), "dst").select("dst", "_part", "q", "k", "v")
    some = met.mapInArrow(score, _PARTIAL).repartition("dst", "_part").sortWithinPartitions("dst", "_part").mapInArrow(merge, _PARTIAL)
    whole = some.withColumn("_part", F.lit(0).cast("long")).repartition("dst").sortWithinPartitions("dst").mapInArrow(merge, _PARTIAL)
    over = F.transform("o", lambda y, j: y / F.get("z", F.floor(j / size).cast("int")))
    none = F.array_repeat(F.lit(0.0), hidden)
    return nodes.select("id", "x").join(whole.select(F.col("dst").alias("id"), over.alias("_c")), "id", "left").select("id", "x", F.coalesce("_c", none).alias("context"))


def run_layer(nodes: DataFrame, edges: DataFrame, layer: Layer, parts: int = PARTS) -> DataFrame:
    """id, x of nodes after one layer: attention, output projection, residual, norm, feed-forward with GELU, residual, norm."""
    n, epsilon = layer.hidden, layer.epsilon
    output, wide, narrow = (np.array(w).T for w in (layer.output, layer.wide, layer.narrow))

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = normed(_rows(b, "x", n) + _rows(b, "context", n) @ output, epsilon)
            yield pa.RecordBatch.from_arrays([b.column("id"), _lists(normed(x + gelu(x @ wide) @ narrow, epsilon))], names=["id", "x"])

    return attended(nodes, edges, layer, parts).mapInArrow(forward, "id long, x array<double>")


def run_layer_in_rows(graphs: DataFrame, key: str, layer: Layer) -> DataFrame:
    """key, x of graphs (key, x array<double>, src array<int>, dst array<int>) after one layer, as run_layer() has it, each graph within its row.

    x holds the vectors of a graph's nodes one after the other, src and dst
    the places of its edges' ends. For graphs that a row can hold, as those of
    texts are: nothing is shuffled. Rows are worked on in slices of SLICE edges.
    """
    n, heads, epsilon = layer.hidden, layer.heads, layer.epsilon
    size = n // heads
    query, keys, value, output, wide, narrow = (np.array(w).T for w in (layer.query, layer.key, layer.value, layer.output, layer.wide, layer.narrow))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges = pc.list_value_length(b.column("dst")).to_numpy(zero_copy_only=False)
            start = 0
            while start < b.num_rows:
                stop = max(start + 1, start + int(np.searchsorted(np.cumsum(edges[start:]), SLICE)))
                part = b.slice(start, stop - start)
                x = _rows(part, "x", n)
                nodes = pc.list_value_length(part.column("x")).to_numpy(zero_copy_only=False) // n
                shift = np.repeat(np.cumsum(nodes) - nodes, edges[start:stop])
                src, dst = (part.column(c).flatten().to_numpy(zero_copy_only=False) + shift for c in ("src", "dst"))
                order = np.argsort(dst, kind="stable")
                src, dst = src[order], dst[order]
                context = np.zeros_like(x)
                if len(dst):
                    s = ((x @ query)[dst] * (x @ keys)[src]).reshape(-1, heads, size).sum(2) / math.sqrt(size)
                    first, _, z, o = _folded(dst[:, None], s, np.ones_like(s), (x @ value)[src])
                    context[dst[first]] = o / np.repeat(z, size, axis=1)
                x = normed(x + context @ output, epsilon)
                x = normed(x + gelu(x @ wide) @ narrow, epsilon)
                ends = np.concatenate([[0], np.cumsum(nodes * n)])
                yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x.ravel()))], names=[key, "x"])
                start = stop

    small_batches(graphs.sparkSession)
    schema = T.StructType([T.StructField(key, graphs.schema[key].dataType), T.StructField("x", T.ArrayType(T.DoubleType()))])
    return graphs.select(key, "x", "src", "dst").mapInArrow(run, schema)


def made_weights(rows: int, columns: int, seed: int) -> Matrix:
    """A fixed matrix of small numbers, by a rule that needs no generator: for tests and queries without a trained model."""
    return [[(((i * 31 + j * 17 + seed * 7) % 23) - 11) / 16 for j in range(columns)] for i in range(rows)]


def made_layer(hidden: int = 4, heads: int = 2) -> Layer:
    square = lambda seed: made_weights(hidden, hidden, seed)
    return Layer(heads, square(1), square(2), square(3), square(4), made_weights(4 * hidden, hidden, 5), made_weights(hidden, 4 * hidden, 6))
