"""Operator 6 against brute force over all pairs."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomgraph.llm import near_dedup, shingles


def plain_shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    if not w:
        return Counter()
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4)))


def plain_similarity(a, b):
    """Probability Jaccard by its definition."""
    a, b = ({k: 1 + math.log(n) for k, n in x.items()} for x in (a, b))
    return sum(1 / sum(max(a.get(j, 0) / a[i], b.get(j, 0) / b[i]) for j in a.keys() | b.keys()) for i in a.keys() & b.keys())


def plain_classes(rows):
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [plain_shingles(t) for _, t in rows]
    words = [tuple(re.findall(r"\w+", (t or "").lower())) or (t or "", "no words") for _, t in rows]
    for i, j in itertools.combinations(range(len(rows)), 2):
        if words[i] == words[j] or plain_similarity(sets[i], sets[j]) >= 0.8:
            parent[top(i)] = top(j)
    least = {}
    for k, (d, _) in enumerate(rows):
        least[top(k)] = min(least.get(top(k), math.inf), math.inf if d is None else d)
    return [None if least[top(k)] == math.inf else least[top(k)] for k in range(len(rows))]


def families(seed=4, n=220):
    r = random.Random(seed)
    vocabulary = ["".join(r.choices("abcdefghé", k=r.randint(1, 6))) for _ in range(400)]
    rows = []
    while len(rows) < n:
        base = r.choices(vocabulary, k=r.choice([3, 6, 60, 150]))
        for _ in range(r.choice([1, 1, 2, 40])):
            words = list(base)
            for _ in range(r.randint(0, 6)):
                words[r.randrange(len(words))] = r.choice(vocabulary)
            rows.append(" ".join(words) if r.random() < 0.8 else ", ".join(words).upper())
    extra = [None, "", "!!!", "???", "!!!", "one two", "One  two!", "x " * 30_000, "x " * 30_001, "line one is here again. " * 40 + "tail a b c d", "line one is here again. " * 40 + "other e f g h"]
    rows = list(enumerate(rows + extra))
    r.shuffle(rows)
    return [*rows, (7, dict(rows)[7]), (None, dict(rows)[9]), (None, "only null ids here")]


def test_shingles_and_similarity():
    r = random.Random(1)
    texts = [t for _, t in families(3, 40)]
    at, h, keys = shingles.shingle_hashes(texts)
    at, h, count = shingles.weighted(at, h)
    sets = [plain_shingles(t) for t in texts]
    for k, s in enumerate(sets):
        assert sorted(count[at == k]) == sorted(s.values())
    for _ in range(300):
        i, j = r.randrange(len(texts)), r.randrange(len(texts))
        got = shingles.probability_jaccard(h[at == i], shingles.weight(count[at == i]), h[at == j], shingles.weight(count[at == j]))
        assert got == pytest.approx(plain_similarity(sets[i], sets[j]))
    sign = shingles.prob_min_hash(at, h, shingles.weight(count), len(texts), 400)
    for i, j in itertools.combinations([k for k, s in enumerate(sets) if s], 2):
        assert abs((sign[i] == sign[j]).mean() - plain_similarity(sets[i], sets[j])) < 0.12


def test_signature_does_not_depend_on_the_batch():
    texts = [t for _, t in families(5, 30)]

    def signs(some):
        at, h, _ = shingles.shingle_hashes(some)
        at, h, c = shingles.weighted(at, h)
        return shingles.prob_min_hash(at, h, shingles.weight(c), len(some), 100)

    assert (signs(texts)[11] == signs([texts[11]])[0]).all()


def test_block_links_equal_brute_force():
    r = np.random.default_rng(2)
    n = 60
    hashes = [np.unique(r.choice(40, 30)).astype(np.uint64) for _ in range(n)]
    weights = [shingles.weight(r.integers(1, 4, len(h))) for h in hashes]
    for sides in (np.zeros(n, int), np.arange(n) % 2):
        keys = [bytes([k]) for k in range(n)]
        links = near_dedup.block_links(keys, keys, sides, hashes, weights, 0.55)
        group = {k: k for k in keys}

        def top(x):
            while group[x] != x:
                x = group[x]
            return x

        for a, b in links:
            assert top(a) != top(b)
            group[top(a)] = top(b)
        for i, j in itertools.combinations(range(n), 2):
            if (sides.any() and sides[i] == sides[j]) or shingles.probability_jaccard(hashes[i], weights[i], hashes[j], weights[j]) < 0.55:
                continue
            assert top(keys[i]) == top(keys[j])


@pytest.mark.parametrize("wide", [0, 100])
def test_classes_equal_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(near_dedup, "BLOCK", 5)
    monkeypatch.setattr(near_dedup, "WIDE", wide)
    rows = families()
    docs = spark.createDataFrame([(d, t, "k", 0) for d, t in rows], "doc_id long, text string, key string, _row int")
    got = near_dedup.classes(docs).collect()
    want = Counter(zip([d for d, _ in rows], plain_classes(rows)))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    kept = [r for r in got if r.keep]
    assert len(kept) == len({(r.class_id, r.doc_id) for r in kept}) == len({c for _, c in want if c is not None}) + 1
    assert all(r.doc_id == r.class_id for r in kept)


def test_wide_families_are_cut_by_rare_shingles(spark):
    """Texts of one template with contents of their own cannot be linked, however many; near copies among them stay together."""
    r = random.Random(7)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    template = [word() for _ in range(60)]
    texts = [" ".join(template + [word() for _ in range(30)]) for _ in range(80)]
    texts += [texts[3] + " one more", texts[9].replace(" ", " x ", 1), "z " + texts[3]]
    at, h, keys = shingles.shingle_hashes(texts)
    at, h, count = shingles.weighted(at, h)
    sets = spark.createDataFrame([(bytearray(keys[k]), h[at == k].view(np.int64).tolist(), count[at == k].tolist()) for k in range(len(texts))], "key binary, hashes array<long>, counts array<int>")
    both = spark.createDataFrame([(bytearray(k), bytearray(k), bytearray(b"f")) for k in keys], "node binary, label binary, family binary")
    got = {}
    for x in near_dedup._closer(both, sets, 0.8, []).collect():
        got.setdefault(bytes(x.family), set()).add(keys.index(bytes(x.node)))
    assert sorted(map(sorted, got.values())) == [[3, 80, 82], [9, 81]]


def test_no_documents(spark):
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
