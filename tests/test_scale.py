"""Ordinals, links, places and layouts that do not gather a key in one task, against plain Python."""

import itertools
import math
import random

import numpy as np
import pytest
from loomgraph.kg import KG
from loomgraph.operators import evaluation as V
from loomgraph.operators import extraction as E
from loomgraph.operators import graph_algorithms as G
from loomgraph.operators import joins as J
from loomgraph.operators import lineage
from loomgraph.operators import seeds as D
from loomgraph.operators import sets as S
from loomgraph.operators import windows as W
from pyspark.sql import functions as F


@pytest.mark.parametrize("n", [0, 1, 5000])
def test_places_of_a_hot_key(spark, n):
    r = random.Random(3)
    rows = [(r.choice("aaaaaaaab") if k % 7 else None, r.random(), k) for k in range(n)]
    df = spark.createDataFrame(rows, "k string, v double, id long")
    got = W.placed(df, ["k"], [F.desc("v"), "id"]).collect()
    want = {}
    for key in {x[0] for x in rows}:
        mine = sorted((x for x in rows if x[0] == key), key=lambda x: (-x[1], x[2]))
        want |= {x[2]: (p + 1, len(mine)) for p, x in enumerate(mine)}
    assert {x.id: (x.place, x.place_of) for x in got} == want


def test_batches_follow_places(spark):
    rows = spark.createDataFrame([(k * 10,) for k in range(70)], "id long")
    got = {r.id: r.batch for r in W.batches(rows, ["id"], 32).collect()}
    assert got == {k * 10: k // 32 for k in range(70)}


def test_first_values_and_top_indexes(spark):
    df = spark.createDataFrame([("a", v) for v in (5, 1, 4, 1)] + [("b", 2)], "k string, v int")
    assert {r.k: r.firsts for r in W.first_values(df, "k", "v", 3).collect()} == {"a": [1, 1, 4], "b": [2]}
    one = spark.range(1).select(W.top_indexes(F.array(F.lit(0.5), F.lit(2.0), F.lit(2.0), F.lit(-1.0)), 3).alias("t")).first()
    assert one.t == [1, 2, 0]


def test_links_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(D, "LINK_ROWS", 40)
    r = np.random.default_rng(1)
    vectors = [(k, r.normal(0, 1, 6).round(1).tolist()) for k in range(300)] + [(300, [0.0] * 6), (301, None), (302, [1.0, None] * 3), (303, [1.0, 2.0]), (304, vectors_0 := [1.0] * 6), (305, vectors_0)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {}
    for x in D.link(df.where("vec_id % 10 = 0"), df.where("vec_id % 10 <> 0"), 0.3, 4).collect():
        got.setdefault(x.mention, []).append((x.score, x.kb_id))
    ok = {k: np.array(v) for k, v in vectors if v and None not in v and any(v)}
    for m in [k for k in ok if k % 10 == 0]:
        all_ = [(round(float(ok[m] @ ok[b] / (np.linalg.norm(ok[m]) * np.linalg.norm(ok[b]))), 6), b) for b in ok if b % 10 and len(ok[b]) == len(ok[m])]
        want = sorted((x for x in all_ if x[0] >= 0.3), key=lambda x: (-x[0], x[1]))[:4]
        assert [b for _, b in sorted(got.get(m, []), key=lambda x: (-x[0], x[1]))] == [b for _, b in want]
    assert 300 not in got and 301 not in got


def test_root_positions(spark):
    texts = [(1, ["hyperglycemia", "and", "glycemia"]), (2, ["x", "ab", "cab"]), (3, [])]
    t = spark.createDataFrame([(k, i, w) for k, ws in texts for i, w in enumerate(ws)], "k long, spot int, token string")
    heads = ["Glycemia", "ab", "b", "", "none", "a"]
    got = {(r.k, r["head"]): r.root for r in J.root_positions(t, spark.createDataFrame([(h,) for h in heads], "head string"), "k").collect()}
    want = {(k, h.lower()): min(i for i, w in enumerate(ws) if h.lower() in w) for k, ws in texts for h in heads if h and any(h.lower() in w for w in ws)}
    assert got == want


def test_jaccard_pairs(spark):
    texts = [(1, "a b c"), (2, "B c d d"), (3, "x"), (4, ""), (5, "a b c ")]
    got = {(r.a, r.b): round(r.jaccard, 6) for r in S.jaccard_pairs(spark.createDataFrame(texts, "id long, text string"), "id", "text").collect()}
    sets = {k: set(t.lower().split()) for k, t in texts}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b]}
    assert got == want


def test_chosen_sequences(spark):
    docs = spark.createDataFrame([(k * 3, "t") for k in range(25)], "id long, text string")
    has = spark.createDataFrame([(0,), (3,), (3,), (60,)], "id long")
    assert sorted(r.id for r in D.chosen_sequences(docs, "id", 0.1).collect()) == [0, 3]  # 2.5 rounds to the even 2
    assert sorted(r.id for r in D.chosen_sequences(docs, "id", 0.5, has).collect()) == [0, 3]


def test_named_relations_need_two_people(spark):
    rows = [(1, "Louis XIV succeeded after Louis XIII."), (2, "louis xiv ruled following louis xiii"), (3, "a king was the father of a king"), (4, None)]
    got = E.named_relations(spark.createDataFrame(rows, "k long, text string"), "k").collect()
    assert sorted((r.k, r["head"], r.relation_type, r.tail) for r in got) == [(1, "Louis XIV", "REIGNED_AFTER", "Louis XIII"), (2, "louis xiv", "REIGNED_AFTER", "louis xiii")]


def star(spark):
    """A hub with four neighbours, one of them with a neighbour of its own."""
    edges = [("h", "a"), ("h", "b"), ("h", "c"), ("h", "d"), ("d", "e")]
    nodes = spark.createDataFrame([(x, x, "T", 1.0, None, i) for i, x in enumerate("habcde")], "id string, text string, label string, confidence double, kb_id string, ord long")
    relations = spark.createDataFrame([(a, "R", b, 1.0, None) for a, b in edges], "head string, relation_type string, tail string, confidence double, provenance string")
    return KG(nodes, relations), spark.createDataFrame(edges, "src string, dst string")


def test_layouts(spark):
    kg, edges = star(spark)
    side = {r.id: (r.side, r.x, r.y) for r in G.bipartite(kg).collect()}
    assert side == {"d": (True, 1.0, -1.0), "h": (True, 1.0, 1.0), "a": (False, -1.0, -1.0), "b": (False, -1.0, round(-1 / 3, 6)), "c": (False, -1.0, round(1 / 3, 6)), "e": (False, -1.0, 1.0)}
    down = {r.id: (r.depth, r.x, r.y) for r in G.hierarchical(edges, "h", 5).collect()}
    assert down["h"] == (0, 0.0, 0.0) and down["e"] == (2, 0.0, -1.0) and [down[x][1] for x in "abcd"] == [-1.0, round(-1 / 3, 6), round(1 / 3, 6), 1.0]
    ring = {r.id: (r.ring, r.x, r.y) for r in G.shells(edges, "h", 5).collect()}
    assert ring["h"] == (0, 0.0, 0.0) and ring["a"] == (1, 0.5, 0.0) and ring["b"] == (1, 0.0, 0.5) and ring["e"] == (2, 1.0, 0.0)
    round_ = {r.id: (r.x, r.y) for r in G.circular(kg.entities.limit(4), "label", "ord").collect()}
    assert sorted(round_.values()) == [(-1.0, 0.0), (0.0, -1.0), (0.0, 1.0), (1.0, 0.0)]


def test_spring_layout(spark, monkeypatch):
    _, edges = star(spark)
    nodes = spark.createDataFrame([(1, x) for x in "habcde"], "g long, id string")
    xy = {r.id: (r.x, r.y) for r in G.spring(nodes, edges.withColumn("g", F.lit(1).cast("long")), "g").collect()}
    gap = lambda a, b: math.dist(xy[a], xy[b])
    assert len(xy) == 6 and all(map(math.isfinite, sum(xy.values(), ())))
    assert max(gap("h", x) for x in "abcd") < max(gap("e", x) for x in "abc")  # what is tied stands closer
    monkeypatch.setattr(G, "SPRING_NODES", 5)
    with pytest.raises(Exception, match="too large for forces"):
        G.spring(nodes, edges.withColumn("g", F.lit(1).cast("long")), "g").collect()


def test_tests_of_significance(spark):
    s = spark.createDataFrame([(x,) for x in (0.5, 0.7, 0.9, 0.6)], "s double")
    r = V.one_sample_t(s, "s", 0.5).first()
    assert (r.n, r.mean, r.statistic) == (4, 0.675, pytest.approx(2.049390, abs=1e-6)) and not r.significant and 0.13 < r.p_value < 0.14
    r = V.one_sample_t(s.limit(0), "s").first()
    assert (r.n, r.statistic, r.p_value, r.significant) == (0, 0.0, 1.0, False)
    v = spark.createDataFrame([("yes",)] * 60 + [("no",)] * 40, "v string")
    r = V.even_split_chi(v, "v").first()
    assert (r.yes, r.others, r.statistic) == (60, 40, 4.0) and r.significant and r.p_value == pytest.approx(0.045500264, abs=1e-8)


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "yarn", "getCheckpointDir": staticmethod(lambda: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        lineage.shared_folder(Session())


def test_rings_make_their_edges_once(spark, monkeypatch):
    written = []
    real = G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: (written.append(df.columns), real(df))[1])
    _, edges = star(spark)
    assert {r.id: r.ring for r in G.rings(edges, "h", 5).collect()} == {"h": 0, "a": 1, "b": 1, "c": 1, "d": 1, "e": 2}
    assert written[0] == ["src", "dst"] and written.count(["src", "dst"]) == 1
