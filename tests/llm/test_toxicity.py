"""Operator 4: the index against brute force, held-out accuracy, odd inputs."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import toxicity


def plain_terms(text):
    out = Counter()
    for w in re.findall(r"\w+", text.lower()):
        out[w] += 1
        for k in range(3, 9):
            if len(w) > k:
                out[w[:k] + "*"] += 1
    return out


def test_terms_are_all_words_and_beginnings():
    r = random.Random(1)
    words = ["".join(r.choices("abcdé_7ß", k=r.randint(1, 12))) for _ in range(80)]
    texts = ["", "!!!", " ".join(r.choices(words, k=300)), ", ".join(r.choices(words, k=40)).upper(), "it's « a »\nb"]
    text, term, count = toxicity.term_counts(texts)
    for k, t in enumerate(texts):
        assert sorted(count[text == k]) == sorted(plain_terms(t).values())
    one = toxicity.term_counts([texts[3].lower()])
    assert (one[1] == term[text == 3]).all() and (one[2] == count[text == 3]).all()
    some = np.unique(term)[::3]
    text_, place, count_ = toxicity.term_counts(texts, some)
    known = np.isin(term, some)
    assert (some[place] == term[known]).all() and (count_ == count[known]).all() and (text_ == text[known]).all()


def example(r, k):
    terms = np.array(sorted(r.sample(range(40), r.randint(0, 9)) + ([40] if k % 3 else [])), np.uint64)
    return terms, np.array([r.randint(1, 4) for _ in terms], np.int64)


@pytest.mark.parametrize("share", [2, 10**6])
def test_block_max_search_is_exact(monkeypatch, share):
    """Against cosines of all entries, with rows for frequent terms and with postings alone."""
    monkeypatch.setattr(toxicity, "BLOCK", 4)
    monkeypatch.setattr(toxicity, "BATCH_RUNS", 60)
    monkeypatch.setattr(toxicity, "ROW_SHARE", share if share == 2 else 1)
    r = random.Random(5)
    index = toxicity.Index([(k, *example(r, k), int(r.random() < 0.3)) for k in range(300)])
    assert (index.rows.shape[1] > 0) == (share == 2)
    n = len(index.votes)
    dense = index.cosines([(np.array([t]), np.ones(1)) for t in range(len(index.terms))])[0][:, :n].T  # the entries' weights
    assert np.allclose(np.linalg.norm(dense, axis=1)[dense.any(1)], 1, atol=1e-6)
    queries = []
    for k in range(300):
        terms, counts = example(r, k)
        queries.append(index.vector(np.searchsorted(index.terms, terms), counts))
    for (at, w), (got, entry) in zip(queries, index.nearest(queries, 7), strict=True):
        query = np.zeros(len(index.terms))
        query[at] = w
        cosine = np.round(dense @ query, 8)
        m, want = 0, []
        for e in sorted(np.flatnonzero(cosine > 0), key=lambda e: (-cosine[e], e)):
            if m >= 7 and cosine[e] < cosine[want[-1]] - 1e-7:
                break
            want.append(e)
            m += index.votes[e].sum()
        assert sorted(entry.tolist()) == sorted(want)
        assert np.allclose(got, cosine[entry], atol=1e-7)


def corpus(spark, n=900):
    r = random.Random(2)
    words = ["".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for k in range(n):
        toxic = int(r.random() < 0.25)
        text = r.choices(words, k=r.randint(20, 200))
        if toxic:
            for _ in range(4):
                text.insert(r.randrange(len(text)), "vilest" + r.choice("xyz"))
        docs.append((k, " ".join(text), "s"))
        if r.random() < 0.8:
            labels.append((k, toxic))
    return docs, labels


def test_held_out_accuracy_and_cases(spark):
    docs, labels = corpus(spark)
    extra = [(None, None, "s"), (10_001, "", "s"), (10_002, "word " * 100_000, "s"), (5, docs[5][1], "s")]
    frame = spark.createDataFrame(docs + extra, "doc_id long, text string, score string")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id long, toxic int")
    index = toxicity.fit(frame, marks)
    got = toxicity.score_column(frame, index).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r.doc_id: r for r in got}
    held = [(by[i].predicted, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(a == b for a, b in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert by[None].score == by[10_001].score < 0.5 and by[10_002].score < 0.5
    assert any(r.evidence for r in got if r.predicted)
    folds = {r.doc_id: r.f for r in frame.select("doc_id", toxicity.fold("doc_id").alias("f")).collect()}
    assert all(f == zlib.crc32(str(i).encode()) % 5 for i, f in folds.items() if i is not None)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    index = toxicity.fit(docs, labels)
    assert toxicity.score_column(docs, index).count() == 0
    score = toxicity.load(index).scores(["some text", ""])[0][0]
    assert score < 0.5 and math.isfinite(score)


def test_repeated_labelled_rows_are_one_example(spark):
    docs = spark.createDataFrame([(k % 4, f"text {k % 4} of some words") for k in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(4)], "doc_id long, toxic int")
    assert toxicity.load(toxicity.fit(docs, labels)).votes.sum() <= 4
