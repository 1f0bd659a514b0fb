"""Operator 7 against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.llm import ann


def brute(rows, k=10):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v) and len(v) == 8}
    out = {}
    ok = sorted(ok)
    m = np.array([v for _, v in ok], float)
    for i, v in ok:
        if i % 20 == 0:
            d = np.sqrt(((m - np.array(v, float)) ** 2).sum(1))
            out[i] = sorted((s, j) for s, (j, _) in zip(d.tolist(), ok) if j != i)[:k]
    return out


@pytest.mark.parametrize("part_rows", [2000, 200, 32])
def test_recall_and_order(spark, monkeypatch, part_rows):
    monkeypatch.setattr(ann, "PART_ROWS", part_rows)
    monkeypatch.setattr(ann, "FAN", 6)
    monkeypatch.setattr(ann, "BLOCK", 100)
    r = np.random.default_rng(3)
    centres = r.normal(0, 4, (12, 8))
    rows = [(k, (centres[k % 12] + r.normal(0, 1, 8)).astype(np.float32).tolist()) for k in range(1500)]
    rows += [(2000 + k, rows[0][1]) for k in range(600)]  # a hot vector, queries among its copies
    bad = [(5000, None), (5020, [0.0] * 8), (5040, [float("nan")] * 8), (5060, [1.0, None] * 4), (5080, [float("inf")] * 8), (5100, [1.0]), (None, rows[1][1]), rows[4], rows[20]]
    frame = spark.createDataFrame([(i, v, 0.5) for i, v in rows + bad], "vec_id long, embedding array<float>, score double")
    got = {}
    report = {}
    for x in ann.search(frame, F.col("vec_id") % 20 == 0, report=report).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.score, x.vec_id, x.rank))
    want = brute(rows)
    assert got.keys() == want.keys()
    hits = 0
    for i, near in got.items():
        assert [x[2] for x in near] == list(range(1, len(near) + 1)) and [x[:2] for x in near] == sorted(x[:2] for x in near)
        hits += len({x[1] for x in near} & {j for _, j in want[i]})
        exact = dict((j, s) for s, j in want[i])
        assert all(abs(s - exact[j]) < 1e-12 for s, j, _ in near if j in exact)
    assert hits / sum(map(len, want.values())) > 0.95
    if part_rows == 2000:
        assert hits == sum(map(len, want.values()))
    else:  # twelve clusters: a query meets few of the vectors
        assert report["levels"] >= 1 and report["parts"] >= 5 and report["share"] < 0.4


def test_few_rows(spark):
    two = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 3.0])], "vec_id long, embedding array<float>")
    q = F.col("vec_id") % 20 == 0
    assert [(x.query_id, x.rank, x.vec_id, x.score) for x in ann.search(two, q).collect()] == [(0, 1, 1, 1.0)]
    assert ann.search(two.limit(1), q).count() == 0
    assert ann.search(two.limit(0), q).count() == 0


def test_parts_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 50)
    monkeypatch.setattr(ann, "FAN", 4)
    r = np.random.default_rng(4)
    seen = []
    for n in (400, 1600):
        centres = r.normal(0, 6, (40, 6))
        rows = [(k, (centres[k % 40] + r.normal(0, 1, 6)).tolist()) for k in range(n)]
        frame, report = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), {}
        got = {}
        for x in ann.search(frame, F.col("vec_id") % 20 == 0, report=report).collect():
            got.setdefault(x.query_id, set()).add(x.vec_id)
        m = np.array([v for _, v in rows])
        hits = [len(got[i] & set(np.argsort(((m - m[i]) ** 2).sum(1))[1:11].tolist())) for i in range(0, n, 20)]
        assert sum(hits) >= 0.9 * 10 * len(hits)
        seen.append(report)
    assert seen[1]["parts"] > 2 * seen[0]["parts"] and seen[1]["levels"] > seen[0]["levels"] and seen[1]["share"] < seen[0]["share"]


def test_huge_and_tiny_components(spark, monkeypatch):
    monkeypatch.setattr(ann, "PART_ROWS", 20)
    r = np.random.default_rng(5)
    rows = [(k, r.normal(0, 1, 4).tolist()) for k in range(300)] + [(400 + k, (r.normal(0, 1, 4) * 1e200).tolist()) for k in range(60)] + [(500 + k, (r.normal(0, 1, 4) * 1e-200).tolist()) for k in range(60)]
    rows += [(600 + k, r.normal(0, 1, 2).tolist()) for k in range(30)]
    got = {}
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for x in ann.search(frame, F.col("vec_id") % 20 == 0).orderBy("rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    hits = total = 0
    for i, q in rows:
        if i % 20:
            continue
        near = sorted((math.dist(v, q) if math.dist(v, q) < 1e300 else math.inf, j) for j, v in rows if j != i and len(v) == len(q))[:10]
        assert len(got[i]) == 10 and all(math.isfinite(s) for _, s in got[i])
        for j, s in got[i]:
            assert s == pytest.approx(math.dist(dict(rows)[j], q), rel=1e-12)
        hits += len({j for _, j in near} & {j for j, _ in got[i]})
        total += 10
    assert hits >= 0.9 * total
