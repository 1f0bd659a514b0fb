"""Queries over whole tables against brute force, on inputs that cuts of the input would change."""

from itertools import combinations

from loomgraph.operators import rules as R
from loomgraph.plans import QUERIES
from pyspark.sql import functions as F


def folder(spark, path, **tables):
    """A folder of the tables, each given as rows and schema."""
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def long_text(n):
    """n mentions of ten letters or more, the least of them last, two to a sentence."""
    names = [f"{chr(65 + (n - k) % 26)}{'abcdefghij' + chr(97 + k % 26) * (k // 26 + 1)}" for k in range(n)]
    return names, ". ".join(" treats ".join(names[k : k + 2]) for k in range(0, n, 2)) + "."


def test_all_pairs_of_a_text(spark, tmp_path):
    names, text = long_text(40)
    assert len(set(names)) == 40
    d = folder(spark, tmp_path, documents=([(1, text), (2, "Abcdefghijk alone"), (3, "none")], "doc_id long, text string"))
    pairs = list(combinations(names, 2))
    assert rows(QUERIES["join5_cooccurring_pairs"](spark, d)) == [(1, len(pairs), min(f"{a}/{b}" for a, b in pairs))]
    assert rows(QUERIES["ext8_pair_relations"](spark, d)) == [(1, len(pairs), 39)]
    found = QUERIES["ext14_triple_context"](spark, d).select("head", "tail", "context").collect()
    assert {(r["head"], r["tail"]) for r in found} == set(pairs)
    sentences = [s for s in text.rstrip(".").split(". ")]
    for r in found:
        both = [s for s in sentences if r["head"] in s and r["tail"] in s]
        assert r["context"] == " ".join((both or [s for s in sentences if r["head"] in s or r["tail"] in s])[:5])


def test_names_of_all_documents_anywhere_in_a_question(spark, tmp_path):
    docs = [(1, "so Glycemia x1"), (2, "ten " * 120 + "Insulinum"), (97, "Nothingness here")]
    asked = [(1, "hyperglycemias?"), (2, "of insulinum."), (3, "glycemi a"), (4, "")]
    d = folder(spark, tmp_path, documents=(docs, "doc_id long, text string"), benchmark=(asked, "item_id long, text string"))
    names = {w.lower() for _, t in docs for w in t.split(" ") if w.isalpha() and len(w) >= 4}
    held = [i for i, t in asked if any(n in t.lower() for n in names)]
    assert held == [1, 2]
    assert rows(QUERIES["join13_matched_questions"](spark, d)) == [(i,) for i in held]
    assert rows(QUERIES["agg13_question_accuracy"](spark, d)) == [(4, 2, 0.5)]


def test_places_of_all_customers(spark):
    d = "/root/testdata/sf0.001"
    sizes = {r["component"]: r["n"] for r in QUERIES["grf1_components"](spark, d).collect()}
    customers = spark.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("C:"), F.col("c_custkey").cast("string")).alias("id"))
    assert not {r["id"] for r in customers.where("id LIKE '%7'").collect()} & {c for c, n in sizes.items() if n == 1}


def test_jaccard_of_items_that_share_one_word_of_many(spark, tmp_path):
    words = lambda tag, n: " ".join(f"{tag}{k}" for k in range(n))
    rows = [(1, f"the {words('a', 40)}"), (2, f"the {words('b', 40)}"), (2, f"the {words('b', 40)}"), (3, words("c", 5))]
    spark.createDataFrame(rows, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = [(r.a, r.b, r.jaccard) for r in QUERIES["set3_jaccard"](spark, str(tmp_path)).collect()]
    assert got == [(1, 2, round(1 / 81, 6))]


def test_question_answers_equal_brute_force_and_seek_no_relation_by_text(spark, monkeypatch):
    import random
    import re

    from loomgraph.kg import KG
    from loomgraph.operators import evaluation as V
    from loomgraph.operators import phrases

    r = random.Random(2)
    parts = ["red", "redbox", "ring", "steel", "box", "12x", "ara"]
    ents = [(f"{r.choice(['P', 'red', 'S'])}:{k}12x" if k % 4 == 0 else f"P:{k}", " ".join(r.sample(parts, 2)), r.choice(["PART", "ARA", "Ring"])) for k in range(30)]
    rels = sorted({(r.choice(ents)[0], r.choice(["PART_OF", "REDUCES", "boxed"]), r.choice(ents)[0]) for _ in range(150)}) + [("nowhere", "PART_OF", ents[0][0])]
    asked = [(k, " ".join(r.choices([*parts, "educes", "part_of", "no", "unknown", "reda"], k=r.choice([1, 2, 3, 9])))) for k in range(25)] + [(25, ""), (26, None), (27, "zz red")]
    kg = KG(spark.createDataFrame([(i, t, la, 1.0, None, n) for n, (i, t, la) in enumerate(ents)], "id string, text string, label string, confidence double, kb_id string, ord long"), spark.createDataFrame([(*x, 1.0, None) for x in rels], "head string, relation_type string, tail string, confidence double, provenance string"))
    sought = []
    real = phrases.contained
    monkeypatch.setattr(phrases, "contained", lambda texts, *a: (sought.append(texts.count()), real(texts, *a))[1])
    got = {}
    for x in V.question_answers(kg, spark.createDataFrame(asked, "id long, text string"), 7).collect():
        got.setdefault(x.id, []).append((-x.score, x["head"], x.relation_type, x.tail))
    text = {i: f"{t} {la}".lower() for i, t, la in ents}
    for q, words in asked:
        terms = list(dict.fromkeys(w for w in re.split(r"\W+", (words or "").lower()) if len(w) > 2))
        share = lambda s: sum(w in s for w in terms) / len(terms)
        want = sorted((-round(share(text[h]) * 0.4 + share(text[t]) * 0.4 + share(f"{k} {h} {t}".lower()) * 0.2, 6), h, k, t) for h, k, t in rels if h in text) if terms else []
        assert sorted(got.get(q, [])) == [x for x in want if x[0] < -0.1][:7]
    assert sought[0] <= len(ents) * 2 + 3  # names, ids and types, not relations
