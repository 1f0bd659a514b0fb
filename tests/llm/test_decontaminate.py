"""Operator 5 against brute force over all windows."""

import random
import re
from collections import Counter

from loomgraph.llm import decontaminate


def counts(words, k):
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(docs, items):
    out = {}
    for row, (_, text) in enumerate(docs):
        w = [x for x in re.split(r"[\W]+", (text or "").lower()) if x]
        for item, t in items:
            v = [x for x in re.split(r"[\W]+", (t or "").lower()) if x]
            if not v:
                continue
            k = min(5, len(v))
            want = counts(v, k)
            for start in range(-len(v), len(w)):
                got = counts(w[max(0, start) : max(0, start + len(v))], k)
                if got and (s := round(sum(min(n, got[x]) for x, n in want.items()) / max(sum(want.values()), sum(got.values())), 6)) >= 0.8:
                    if (row, item) not in out or out[row, item] < (s, -start):
                        out[row, item] = (s, -start)
    return Counter((docs[row][0], item, s, -start) for (row, item), (s, start) in out.items())


def test_against_all_windows(spark):
    r = random.Random(6)
    vocabulary = ["".join(r.choices("abcdeéß", k=r.randint(1, 5))) for _ in range(150)]
    items = [(k, " ".join(r.choices(vocabulary, k=r.choice([1, 3, 5, 20, 40])))) for k in range(12)] + [(90, None), (91, ""), (92, "a b a b a b a b a b a b a b a b a b a b")]
    docs = []
    for k in range(60):
        words = r.choices(vocabulary, k=r.choice([0, 4, 30, 200]))
        if r.random() < 0.6:
            leak = r.choice([t for _, t in items if t]).split(" ")
            for _ in range(r.choice([0, 0, 1])):
                i = r.randrange(len(leak))
                leak[i : i + r.choice([0, 1])] = [r.choice(vocabulary)]
            at = r.randrange(len(words) + 1)
            words[at:at] = leak
        text = " ".join(words)
        docs.append((k, text.upper().replace(" ", ", ") if r.random() < 0.3 else text))
    docs += [(None, items[4][1]), (3, docs[3][1]), (200, None), (201, items[5][1] + " " + "z " * 50_000)]
    frame = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, start int, item_id string")
    table = spark.createDataFrame(items + items[:2], "item_id long, text string")
    got = Counter((x.doc_id, x.item_id, x.similarity, x.start) for x in decontaminate.contaminated(frame, table).collect())
    want = brute([(d, t) for d, t in docs], items)
    assert sum(want.values()) > 20
    assert got == want


def test_windows_at_the_threshold_are_found(spark):
    """Items of 44 words with five words in a row changed: 31 to 32 of 40 shingles stay, so many lie at 0.8 itself."""
    r = random.Random(8)
    items = [(k, " ".join(f"w{r.randrange(10**6)}" for _ in range(44))) for k in range(300)]
    docs = []
    for k, t in items:
        words = t.split(" ")
        words[20:24] = [f"x{r.randrange(10**6)}" for _ in range(4)]
        docs.append((k, " ".join(["before"] * 3 + words + ["after"] * 3)))
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert sorted((x.doc_id, x.item_id, x.similarity, x.start) for x in got) == [(k, k, 0.8, 3) for k in range(300)]


def test_radius_follows_from_the_threshold():
    assert decontaminate.RADIUS == decontaminate.radius(0.8) < 64 < decontaminate.radius(0.1)
    assert decontaminate.radius(1.0) == 0


def test_multi_index_finds_all_within_the_radius(spark):
    r = random.Random(2)
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    item = [(k, r.getrandbits(64), r.getrandbits(64)) for k in range(20)]
    window = []
    for k in range(300):
        _, low, high = r.choice(item)
        for bit in r.sample(range(128), r.choice([0, 20, 50, 55, 57, 58, 59, 60, 64])):
            low, high = (low ^ 1 << bit, high) if bit < 64 else (low, high ^ 1 << bit - 64)
        window.append((str(k), low, high))
    may = [(w[0], i[0]) for w in window for i in item]
    frame = lambda rows, first: spark.createDataFrame([(a, signed(b), signed(c)) for a, b, c in rows], f"{first}, low long, high long")
    for within in (0, 31, 33, decontaminate.RADIUS):
        got = decontaminate.multi_index(frame(window, "window string"), frame(item, "item long"), spark.createDataFrame(may, "window string, item long"), within)
        want = {(w[0], i[0]) for w in window for i in item if (w[1] ^ i[1]).bit_count() + (w[2] ^ i[2]).bit_count() <= within}
        assert sorted(tuple(x) for x in got.collect()) == sorted(want)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated(docs, none).count() == 0
    assert decontaminate.contaminated(docs.limit(0), spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_repetitive_texts_have_no_more_windows_than_words(spark, monkeypatch):
    """A text and an item of one word, and of two by turns: starts grow with the words, not with their product."""
    counts = {}
    old = decontaminate.written

    def count(df, name, keep=None):
        out = old(df, name, keep)
        if name in ("leak-places", "leak-distinct"):
            counts.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(decontaminate, "written", count)
    for n in (300, 1200):
        docs = [(1, "a " * n), (2, "a b " * n), (3, "x y z")]
        items = [(1, "a " * (n // 2)), (2, "a b " * (n // 4))]
        got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {(r.doc_id, r.item_id) for r in got if r.similarity == 1} == {(1, 1), (2, 2)}
    small, large = counts["leak-places"]
    assert large < 6 * small  # 4 if linear, 16 with the product
    assert counts["leak-distinct"][1] < 6 * counts["leak-distinct"][0]
