"""Articles through their data source, layouts, similar sets and chain graphs against plain Python."""

import datetime
import itertools
import math
import random

import numpy as np
import pytest
from loomgraph.operators import graph_algorithms as G
from loomgraph.operators import layouts as L
from loomgraph.operators import sets as S
from loomgraph.operators import training as T
from loomgraph.sources import articles as A
from pyspark.sql import functions as F

DAY = datetime.date


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    rows = [(k, f"T{k}", f"the Word {k % 7} é{' Word' * (k % 3)} \"q\" a/b", f"u{k}", DAY(2015 + k % 6, 1 + k % 12, 1 + k % 28)) for k in range(120)]
    rows += [(500, None, None, None, None), (501, "late", "no date, Word", "", None), (502, "x", "tab\there \\ Word", None, DAY(2020, 12, 31))]
    path = f"{tmp_path_factory.mktemp('articles')}/store"
    A.write_store(spark.createDataFrame(rows, A.SCHEMA).repartition(3), path)
    return path, rows


@pytest.mark.parametrize(
    "condition, takes",
    [
        ("abstract LIKE '%Word 3%'", lambda r: r[2] and "Word 3" in r[2]),
        ("published >= DATE'2018-03-05'", lambda r: r[4] and r[4] >= DAY(2018, 3, 5)),
        ("published < DATE'2016-01-01' AND title LIKE '%T1%'", lambda r: r[4] and r[4] < DAY(2016, 1, 1) and r[1] and "T1" in r[1]),
        ("published = DATE'2020-12-31'", lambda r: r[4] == DAY(2020, 12, 31)),
        ("abstract LIKE '%é%' AND url IS NOT NULL", lambda r: r[2] and "é" in r[2] and r[3] is not None),
        ("published IS NULL", lambda r: r[4] is None),
        ("published IS NOT NULL", lambda r: r[4] is not None),
        ("contains(abstract, '\"q\"')", lambda r: r[2] and '"q"' in r[2]),
        ("contains(abstract, 'a/b')", lambda r: r[2] and "a/b" in r[2]),
        ("contains(abstract, '\\t')", lambda r: r[2] and "\t" in r[2]),
        ("article_id % 2 = 0", lambda r: r[0] % 2 == 0),
        ("true", lambda r: True),
    ],
)
def test_filters_of_the_store(spark, store, condition, takes):
    path, rows = store
    got = A.articles(spark, path).where(condition).collect()
    assert sorted(map(tuple, got)) == sorted((r for r in rows if takes(r)), key=lambda r: r[0])


def test_words_and_dates_are_pushed_into_the_scan(spark, store):
    df = A.articles(spark, store[0]).where("contains(abstract, 'Word 3') AND published >= DATE'2019-01-01'")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BatchScan articles" in plan and "Filter " not in plan
    reader = A.ArticleReader(store[0])
    everything = len(reader.partitions())
    reader.dates = [(">=", DAY(2019, 1, 1))]
    assert 0 < len(reader.partitions()) < everything  # files of other years are not opened


def test_search(spark, store):
    path, rows = store
    got = A.search(spark, path, "Word é", 10, "relevance", DAY(2016, 1, 1), DAY(2019, 12, 31)).collect()
    fit = [r for r in rows if r[2] and r[4] and "Word" in r[2] and "é" in r[2] and DAY(2016, 1, 1) <= r[4] <= DAY(2019, 12, 31)]
    want = sorted(((-(r[2].count("Word") + r[2].count("é")), r[0]) for r in fit))[:10]
    assert [(r["rank"], -r.score, r.article_id) for r in got] == [(k, s, i) for k, (s, i) in enumerate(want, 1)]
    latest = A.search(spark, path, "Word", 3, "date").collect()
    assert [r.article_id for r in latest] == [i for _, i in sorted((-(r[4] or DAY.min).toordinal(), r[0]) for r in rows if r[2] and "Word" in r[2])[:3]]
    assert A.search(spark, path, "  ").count() == A.search(spark, path, "nowhere").count() == A.search(spark, path, "Word", first=DAY(2030, 1, 1)).count() == 0
    with pytest.raises(ValueError):
        A.search(spark, path, "x", sort="fame")


def exact(xy, strength):
    d = xy[:, None] - xy[None]
    r2 = (d**2).sum(2)
    w = np.where(r2 > 1e-18, strength / np.maximum(r2, 1e-18), 0)
    return (w[..., None] * d).sum(1)


@pytest.mark.parametrize("shape, near, most", [("disc", 64, 0.02), ("clump", 8, 0.12)])
def test_forces_are_near_exact_ones(spark, shape, near, most):
    """A uniform disc, and one that holds most of its nodes in a few cells, whose nodes meet means only."""
    r = np.random.default_rng(3)
    xy = r.normal(0, 1, (900, 2)) if shape == "disc" else np.concatenate([r.normal(0, 0.05, (600, 2)), r.normal(0, 2, (300, 2))])
    df = spark.createDataFrame([(str(k), float(x), float(y)) for k, (x, y) in enumerate(xy)], "id string, x double, y double")
    got = {z.id: (z.fx, z.fy) for z in L.repulsion(df, 4.0, near=near).collect()}
    force, want = np.array([got[str(k)] for k in range(900)]), exact(xy, 4.0)
    far = slice(0, 900) if shape == "disc" else slice(600, 900)  # within a crowded cell there is no place of its own to keep
    assert np.linalg.norm((force - want)[far]) < most * np.linalg.norm(want[far])


def test_springs_part_nodes_and_draw_neighbours(spark):
    edges = [(f"{g}{k}", f"{g}{(k + 1) % 12}") for g in "ab" for k in range(12)]
    nodes = spark.createDataFrame([(f"{g}{k}",) for g in "ab" for k in range(12)], "id string")
    out = {r.id: (r.x, r.y) for r in L.spring(nodes, spark.createDataFrame(edges, "src string, dst string"), steps=6).collect()}
    gap = lambda a, b: math.dist(out[a], out[b])
    assert len(out) == 24
    assert np.mean([gap(a, b) for a, b in edges]) < 0.8 * np.mean([gap(a, b) for a, b in itertools.combinations(out, 2)])
    assert L.spring(nodes.limit(0), spark.createDataFrame([], "src string, dst string"), steps=1).count() == 0


def test_stress_keeps_hops(spark):
    side = 7
    at = [(x, y) for x in range(side) for y in range(side)]
    edges = [(f"{x},{y}", f"{x + dx},{y + dy}") for x, y in at for dx, dy in ((0, 1), (1, 0)) if x + dx < side and y + dy < side]
    nodes = spark.createDataFrame([(f"{x},{y}",) for x, y in at], "id string")
    df = spark.createDataFrame(edges, "src string, dst string")
    out = {r.id: (r.x, r.y) for r in L.stress(nodes, df, 12, 100).collect()}
    hops = {(a, b): abs(a[0] - b[0]) + abs(a[1] - b[1]) for a, b in itertools.combinations(at, 2)}

    def lost(place):
        return sum((math.dist(place(a), place(b)) - h) ** 2 / h**2 for (a, b), h in hops.items()) / len(hops)

    circle = lambda p: (3 * math.cos(2 * math.pi * at.index(p) / len(at)), 3 * math.sin(2 * math.pi * at.index(p) / len(at)))
    assert lost(lambda p: out[f"{p[0]},{p[1]}"]) < 0.3 * lost(circle)
    assert L.stress(nodes, df, 12, 100).collect() and {r.id: (r.x, r.y) for r in L.stress(nodes.repartition(5), df.repartition(3), 12, 100).collect()} == out
    with pytest.raises(ValueError):
        L.stress(nodes, df, 1)


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8, 1.0])
def test_similar_sets(spark, least):
    r = random.Random(8)
    texts = [(k, "the " + " ".join(r.choices("abcdefgh", k=r.randint(0, 7)))) for k in range(60)] + [(60, ""), (61, None), (62, "The THE the")]
    sets = {k: frozenset((t or "").lower().split()) for k, t in texts}
    first = {}
    for k, s in sets.items():
        first.setdefault(s, k)
    want = {(first[a], first[b]): len(a & b) / len(a | b) for a, b in itertools.combinations([s for s in first if s], 2) if len(a & b) / len(a | b) >= least}
    want = {tuple(sorted(p)): round(j, 9) for p, j in want.items()} | {(first[s], k): 1.0 for k, s in sets.items() if s and first[s] != k}
    got = S.similar_sets(spark.createDataFrame(texts, "id long, text string"), "id", "text", least).collect()
    assert {(x.a, x.b): round(x.jaccard, 9) for x in got} == want and len(got) == len(want)


def test_chain_graphs_of_any_length(spark):
    rows = spark.createDataFrame([(1, 1), (2, 5), (3, 0)], "k long, n int")
    edges, hops = {}, {}
    for x in G.chains_edges(rows, "k", "n", 2).collect():
        edges.setdefault(x.k, set()).add((x.src, x.dst))
    for x in G.chains_hops(rows, "k", "n", 2).collect():
        hops.setdefault(x.k, {})[x.hops] = x.pairs
    for k, n in ((1, 1), (2, 5)):
        assert edges[k] == {(i, i + 1) for i in range(n - 1)} | {(i, n + 2 * i + j) for i in range(n) for j in (0, 1)}
        want = {}
        for a in range(n):
            for b in range(a, n):
                for h in ([b - a] if b > a else []) + [b - a + 1] * 2:
                    want[h] = want.get(h, 0) + 1
        assert hops[k] == want
    assert 3 not in edges and 3 not in hops


def test_decay_masks(spark):
    m = {(x.k, x.i, x.j): x.v for x in T.decay_masks(spark.createDataFrame([(1, 3), (2, 0)], "k long, n long"), "k", "n", causal=True, normal=True).collect()}
    assert len(m) == 9 and m[1, 0, 0] == 1 and m[1, 0, 1] == 0
    assert m[1, 2, 1] == pytest.approx(math.exp(-0.6) / (1 + math.exp(-0.6) + math.exp(-1.2)))
