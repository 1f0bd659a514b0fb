"""Attention, paths, masks, spans, phrases and vocabularies against plain Python and numpy."""

import math
import random

import numpy as np
import pytest
from loomgraph.functions import text as X
from loomgraph.operators import attention as N
from loomgraph.operators import masking as MK
from loomgraph.operators import paths as P
from loomgraph.operators import phrases
from loomgraph.operators import training as T
from loomgraph.operators import vocabulary as VB
from pyspark.sql import functions as F


def dense_layer(x, edges, layer):
    """The layer over a dense mask; repeated edges count again."""
    n, size = len(x), layer.hidden // layer.heads
    q, k, v = (x @ np.array(w).T for w in (layer.query, layer.key, layer.value))
    out = np.zeros_like(x)
    for i in range(n):
        src = [a for a, b in edges if b == i]
        for h in range(layer.heads):
            s = slice(h * size, (h + 1) * size)
            if src:
                e = k[src][:, s] @ q[i, s] / math.sqrt(size)
                e = np.exp(e - e.max())
                out[i, s] = (e / e.sum()) @ v[src][:, s]
    norm = lambda y: (y - y.mean(1, keepdims=True)) / (y.std(1, keepdims=True) + layer.epsilon)
    one = norm(x + out @ np.array(layer.output).T)
    return norm(one + N.gelu(one @ np.array(layer.wide).T) @ np.array(layer.narrow).T)


@pytest.mark.parametrize("parts, rows", [(1, 10_000), (16, 7)])
def test_attention_layer(spark, parts, rows):
    r = np.random.default_rng(2)
    x = r.normal(0, 3, (80, 8))
    edges = [(a, 0) for a in range(80)] * 2 + [tuple(map(int, e)) for e in r.integers(0, 70, (200, 2))]  # a hub with repeated edges, and lone nodes
    layer = N.made_layer(8, 4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        nodes = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
        got = {z.id: z.x for z in N.run_layer(nodes, spark.createDataFrame(edges, "src long, dst long").repartition(5), layer, parts).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = dense_layer(x, edges, layer)
    assert sorted(got) == list(range(80))
    assert np.abs(np.array([got[i] for i in range(80)]) - want).max() < 1e-9


def test_heads_must_divide():
    with pytest.raises(ValueError):
        N.made_layer(4, 3)


def shortest(n, edges):
    d = np.full((n, n), np.inf)
    for a, b in edges:
        d[a, b] = min(d[a, b], 1)
    np.fill_diagonal(d, 0)
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k : k + 1])
    return d


def test_paths_by_doubling(spark):
    r = random.Random(3)
    graphs = {0: [(k, k + 1) for k in range(40)], 1: [(r.randrange(25), r.randrange(25)) for _ in range(40)] + [(3, 3)], 2: []}
    df = spark.createDataFrame([(g, a, b) for g, e in graphs.items() for a, b in e], "g long, src long, dst long")
    for most in (None, 6):
        want = {(g, a, b, int(d[a, b])) for g, e in graphs.items() for d in [shortest(41, e)] for a in range(41) for b in range(41) if a != b and d[a, b] <= (most or 99)}
        assert {tuple(x) for x in P.closure(df, ["g"], most).select("g", "src", "dst", "hops").collect()} == want


def test_paths_from_sources(spark):
    edges = [(k, k + 1) for k in range(12)] + [(20, 21)]
    nodes = spark.createDataFrame([(k,) for k in range(25)], "id long")
    got = {(x.src, x.id): x.hops for x in P.from_sources(nodes, spark.createDataFrame(edges, "src long, dst long"), nodes.where("id IN (0, 20)")).collect()}
    d = shortest(25, edges)
    assert got == {(s, k): int(d[s, k]) if np.isfinite(d[s, k]) else 13 for s in (0, 20) for k in range(25)}


def test_level_masks(spark):
    edges, levels = [(0, 1), (1, 2), (2, 3), (0, 4), (5, 6)], 3
    got = {(x.src, x.dst): (round(x.mean, 9), round(x.top, 9)) for x in P.hierarchical_mask(spark.createDataFrame(edges, "src long, dst long"), levels, 3).collect()}
    each = []
    for level in range(1, levels + 1):
        some = [(a, b) for a, b in edges if (a + b) % levels < level]
        d = shortest(7, some + [(b, a) for a, b in some])
        each.append(np.where(d <= 3, np.exp(-0.6 * d), 0))
    mean, top = sum(each) / levels, np.maximum.reduce(each)
    want = {(a, b): (round(mean[a, b] / mean.max(), 9), round(top[a, b], 9)) for a in range(7) for b in range(7) if top[a, b] > 0}
    assert got == want


def test_spans_cover_their_share_and_do_not_overlap():
    for key in range(40):
        for n in (0, 1, 2, 7, 50, 5000):
            starts, lengths = MK.spans(key, n, 0.15, 1, 5, seed=2)
            hit = np.zeros(n, int)
            for a, m in zip(starts, lengths):
                hit[a : a + m] += 1
            target = int(np.round(n * 0.15))
            assert (hit <= 1).all() and target <= hit.sum() <= target + 4 and (lengths >= 1).all() and (lengths <= 5).all()
            assert (starts >= 0).all() and (starts + lengths <= n).all()
    starts = np.concatenate([MK.spans(k, 100, 0.15, 3, 3, seed=1)[0] for k in range(400)])
    assert np.histogram(starts, 7, (0, 98))[0].min() > 0.7 * len(starts) / 7  # spread over the text


def test_masked_texts(spark):
    rows = [(1, list(range(1000, 1400))), (2, []), (3, None), (4, [7]), (5, [9] * 20_000)]
    df = spark.createDataFrame(rows, "k long, ids array<long>")
    for by in ("spans", "singles"):
        out = {r.k: r for r in MK.masked_texts(df, "k", "ids", by, seed=4).collect()}
        again = {r.k: r for r in MK.masked_texts(df.repartition(3), "k", "ids", by, seed=4).collect()}
        assert out == again
        for k, ids in rows:
            r, ids = out[k], ids or []
            chosen = {p for a, m in zip(r.starts, r.lengths) for p in range(a, a + m)}
            assert len(r.input) == len(r.label) == len(ids)
            assert all((x == ids[p] if p in chosen else x == T.IGNORE) for p, x in enumerate(r.label))
            assert all(r.input[p] == ids[p] for p in range(len(ids)) if p not in chosen)
        share = sum(x == T.MASK for x in out[5].input) / sum(out[5].lengths)
        assert 0.75 < share < 0.85


def test_contained_names(spark):
    r = random.Random(6)
    texts = [(k, "".join(r.choices("abé 😀b", k=r.choice([0, 1, 3, 40, 400])))) for k in range(40)] + [(40, None), (41, "Iranian")]
    names = ["".join(r.choices("abé 😀b", k=r.randint(1, 7))) for _ in range(150)] + ["Iran", "", None, "nian", "Iranians", "Iran"]
    got = phrases.contained(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "k")
    assert sorted((x.k, x.name) for x in got.collect()) == sorted((k, n) for k, t in texts for n in {n for n in names if n} if t and n in t)
    plan = got._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_vocabulary_round_trip(spark):
    texts = [(2, "the cat the mask"), (1, "a cat <pad>"), (3, ""), (4, None), (5, "new words here")]
    df = spark.createDataFrame(texts, "k long, text string")
    v = VB.build(df, "k", X.words("text"), 10)
    assert {r.token: r.id for r in v.collect()} == {"<pad>": 0, "<unk>": 1, "<cls>": 2, "<sep>": 3, "<mask>": 4, "a": 5, "cat": 6, "pad": 7, "the": 8, "mask": 9}
    ids = VB.encode(df, "k", X.words("text"), v)
    assert {r.k: r.ids for r in ids.collect()} == {1: [5, 6, 7], 2: [8, 6, 8, 9], 3: [], 4: [], 5: [1, 1, 1]}
    assert {r.k: r.ids for r in VB.encode(df, "k", X.words("text"), v, 3, pad=True).collect()} == {1: [5, 6, 7], 2: [8, 6, 8], 3: [0, 0, 0], 4: [0, 0, 0], 5: [1, 1, 1]}
    assert {r.k: r.text for r in VB.decode(ids, "k", v).collect()} == {1: "a cat pad", 2: "the cat the mask", 3: "", 4: "", 5: ""}
    assert {r.k: r.text for r in VB.decode(ids, "k", v, skip_special=False).where("k = 5").collect()} == {5: "<unk> <unk> <unk>"}


def test_masks_and_positions(spark):
    df = spark.createDataFrame([(1, [5, 0, 6]), (2, [0]), (3, [])], "k long, ids array<long>")
    assert sorted((r.k, r.i, r.j) for r in VB.pair_mask(df, "k").collect()) == [(1, 0, 0), (1, 0, 2), (1, 2, 0), (1, 2, 2)]
    one = df.where("k = 1").select(VB.positions(F.col("ids")).alias("p"), VB.token_types(F.col("ids")).alias("t")).first()
    assert (one.p, one.t) == ([0, 1, 2], [0, 0, 0])
    full = {r.k: (r.ids, r["mask"]) for r in VB.batch_padded(df, "k", F.lit(0)).collect()}
    assert full == {1: ([5, 0, 6], [1, 0, 1]), 2: ([0, 0, 0], [0, 0, 0]), 3: ([0, 0, 0], [0, 0, 0])}


@pytest.mark.parametrize("most", [30_522, 0])
def test_names_of_few_and_many_in_small_slices(spark, monkeypatch, most):
    monkeypatch.setattr(phrases, "MOST_NAMES", most)
    monkeypatch.setattr(phrases, "SLICE", 64)
    monkeypatch.setattr(phrases, "OUT", 32)
    r = random.Random(7)
    texts = [(k, "".join(r.choice("abñ 𝛼") for _ in range(r.choice([0, 1, 3, 40, 300])))) for k in range(60)] + [(60, None), (61, "a\0b")]
    names = sorted({"".join(r.choice("abñ 𝛼") for _ in range(r.randint(1, 9))) for _ in range(80)}) + ["", None, "a", "a\0b", "ab", "nowhere"]
    got = phrases.contained(spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(n,) for n in names], "name string"), "k").collect()
    assert sorted((x.k, x.name) for x in got) == sorted({(k, n) for k, t in texts for n in names if t and n and n in t})


def test_texts_are_worked_on_in_slices(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(phrases, "SLICE", 10)
    texts = ["abcd", None, "", "efgh", "ijklmnopqrstuvw", "x", "yz"] * 5
    got = list(phrases._slices(pa.array(texts)))
    assert [t for _, some in got for t in some] == [t or "" for t in texts]
    assert [k for k, _ in got] == [sum(len(s) for _, s in got[:i]) for i in range(len(got))]
    assert all(len(some) == 1 or sum(map(len, some)) <= 20 for _, some in got)


def test_layer_in_rows_equals_the_layer_over_tables(spark, monkeypatch):
    monkeypatch.setattr(N, "SLICE", 50)
    layer, r = N.made_layer(), np.random.default_rng(5)
    graphs = []
    for k, n in enumerate([1, 2, 30, 7, 0, 90]):
        src, dst = (r.integers(0, n, 3 * n).tolist() if n else [] for _ in "ab")
        graphs.append((k, r.normal(0, 1, 4 * n).tolist(), src, dst))
    got = {x.k: x.x for x in N.run_layer_in_rows(spark.createDataFrame(graphs, "k long, x array<double>, src array<int>, dst array<int>"), "k", layer).collect()}
    nodes = [(k * 1000 + i, x[4 * i : 4 * i + 4]) for k, x, _, _ in graphs for i in range(len(x) // 4)]
    edges = [(k * 1000 + a, k * 1000 + b) for k, _, src, dst in graphs for a, b in zip(src, dst)]
    want = {x.id: x.x for x in N.run_layer(spark.createDataFrame(nodes, "id long, x array<double>"), spark.createDataFrame(edges, "src long, dst long"), layer).collect()}
    assert sorted(got) == list(range(6)) and sum(map(len, got.values())) == 4 * len(want)
    for i, x in want.items():
        assert np.allclose(got[i // 1000][4 * (i % 1000) : 4 * (i % 1000) + 4], x, atol=1e-9)


def test_layers_of_texts_shuffle_no_edges(spark):
    from loomgraph.plans import QUERIES

    plan = QUERIES["trn5_node_vectors"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_masks_are_the_same_in_small_slices(spark, monkeypatch):
    rows = [(k, list(range(n)) if n is not None else None) for k, n in enumerate([0, 5, None, 300, 1, 90])]
    df = spark.createDataFrame(rows, "k long, ids array<long>").coalesce(1)
    whole = {by: sorted(MK.masked_texts(df, "k", "ids", by, seed=4).collect()) for by in ("spans", "singles")}
    monkeypatch.setattr(MK, "SLICE", 16)
    assert whole == {by: sorted(MK.masked_texts(df, "k", "ids", by, seed=4).collect()) for by in whole}
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 2000


def test_a_round_has_a_row_for_a_node_and_block_of_sources(spark, monkeypatch):
    ids = [f"n{k}" for k in range(90)]
    r = random.Random(8)
    edges = [(r.choice(ids), r.choice(ids)) for _ in range(140)]
    sizes = []
    real = P.checkpointed
    monkeypatch.setattr(P, "checkpointed", lambda df: (lambda out: (sizes.append(out.count()), out)[1])(real(df)))
    nodes = spark.createDataFrame([(i,) for i in ids], "id string")
    got = {(x.src, x.id): x.hops for x in P.from_sources(nodes, spark.createDataFrame(edges, "src string, dst string"), nodes.where("id <> 'n3'")).collect()}
    want = {}
    for s in (i for i in ids if i != "n3"):
        want[s, s], front, h = 0, {s}, 0
        while front:
            h += 1
            front = {b for a, b in edges if a in front and (s, b) not in want}
            want |= {(s, b): h for b in front}
    beyond = max(want.values()) + 1
    assert got == {(s, i): want.get((s, i), beyond) for s in ids if s != "n3" for i in ids}
    assert max(sizes) <= 2 * len(ids)
