"""Steps whose cost grew too fast with their tables: the same results, by what each plan or its rounds do."""

import random
import re

from loomgraph.functions import text as X
from loomgraph.kg import KG
from loomgraph.operators import evaluation as V
from loomgraph.operators import filters as L
from loomgraph.operators import graph_algorithms as G
from loomgraph.operators import layouts as LY
from loomgraph.operators import lineage
from loomgraph.operators import rules as R
from loomgraph.operators import seeds as D
from loomgraph.operators import sets as S
from pyspark.sql import functions as F


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_relation_phrases_are_sought_by_their_stems_first(spark):
    """the types that the patterns alone give, with a plain search before each pattern."""
    r = random.Random(5)
    phrases = [x.replace("?", r.choice(["", "?"])).replace("?", "") for _, p in R.RELATION_PHRASES for x in p.split("|")]
    phrases += [re.sub(r".\?", "", x) for _, p in R.RELATION_PHRASES for x in p.split("|")]
    texts = [f"the {a} {r.choice(['', 'x', 'un' + b])} {b.upper()}{r.choice(['', 'er', '.'])}" for a in phrases for b in r.sample(phrases, 2)] + ["", "nothing", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    plain = F.lit("UNKNOWN_RELATION")
    for kind, p in reversed(R.RELATION_PHRASES):
        plain = F.when(F.lower("t").rlike(R.any_phrase(p)), kind).otherwise(plain)
    got = df.select(R.relation_type(F.col("t")).alias("got"), plain.alias("want"))
    rows = got.collect()
    assert all(x.got == x.want for x in rows) and len({x.got for x in rows}) > 20
    assert "Contains" in plan_of(df.select(R.relation_type(F.col("t"))))


def test_without_a_model_no_prompt_leaves_the_jvm(spark):
    """F16."""
    t = spark.createDataFrame([("a drug", "TREATS", "flu", "a drug treats flu"), ("a", "TREATS", "b", None)], "head string, relation_type string, tail string, context string")
    got = V.model_support(t)
    assert "MapInArrow" not in plan_of(got)
    assert [(r.supported, r["by"]) for r in got.collect()] == [(True, "rule"), (False, "rule")]


def greedy(spans):
    kept = []
    for a, b, t in sorted(spans):
        if not any(k[1] > a and b > k[0] and (min(k[1], b) - max(k[0], a) + 1) / (b - a + 1) > 0.5 for k in kept):
            kept.append((a, b, t))
    return kept


def test_overlaps_look_at_one_stop_only(spark):
    """the choice that a look at all kept spans gives."""
    r = random.Random(2)
    rows = [(k, a, a + r.choice([0, 0, 1, 2, 5, 9, 30]), r.choice("xy")) for k in range(20) for a in (r.randrange(60) for _ in range(40))]
    df = spark.createDataFrame(rows, "k int, start int, stop int, text string")
    got = L.without_overlaps(df, "k")
    assert sorted(map(tuple, got.collect())) == sorted((k, *s) for k in range(20) for s in greedy([x[1:] for x in rows if x[0] == k]))
    assert "exists(" not in plan_of(got)


def test_spans_are_first_occurrences(spark):
    """an earlier place inside a longer match counts; places count code points."""
    df = spark.createDataFrame([("é😀 Die Stadtmauer. Die Stadt",), ("",), (None,)], "t string")
    got = [r.s for r in df.select(X.spans("t", r"\p{Lu}\p{Ll}+(?: \p{L}+){0,2}").alias("s")).collect()]
    assert [tuple(x) for x in got[0]] == [(4, 17, "Die Stadtmauer"), (4, 12, "Die Stadt")] and got[1] == [] and got[2] is None


def test_similar_sets_are_bounded_where_they_meet(spark):
    """short and long sets against brute force; words move only for pairs that the parities let through."""
    r = random.Random(4)
    texts = []
    for k in range(60):
        base = [f"w{r.randrange(900)}" for _ in range(r.choice([1, 3, 20, 700]))]
        texts += [base, [w for w in base if r.random() > 0.15] + ["x"]]
    sets = {k: set(w) for k, w in enumerate(texts)}
    got = S.similar_sets(spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "id long, text string"), "id", "text", 0.7)
    assert "bit_count" in plan_of(got)
    first = {}
    for k, w in sets.items():
        first.setdefault(frozenset(w), k)
    reps = sorted(first.values())
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a in reps for b in reps if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.7 - 1e-9}
    want |= {(first[frozenset(w)], k): 1.0 for k, w in sets.items() if first[frozenset(w)] != k}
    assert {(x.a, x.b): round(x.jaccard, 6) for x in got.collect()} == want and len(want) > 20


def test_partitions_follow_files(spark, monkeypatch, tmp_path):
    """a merge is grouped once, in as many partitions as its files ask for."""
    rows = [(f"a{k}", "R", f"b{k % 7}", 0.5, None) for k in range(50)]
    spark.createDataFrame(rows, "head string, relation_type string, tail string, confidence double, provenance string").coalesce(1).write.parquet(str(tmp_path / "r"))
    e = spark.createDataFrame([("a0", "t", "L", 1.0, None, 0)], "id string, text string, label string, confidence double, kb_id string, ord long")
    r = spark.read.parquet(str(tmp_path / "r"))
    monkeypatch.setattr(lineage, "PART_BYTES", 200)
    one = S.merge([KG(e, r), KG(e, r.where("head <> 'a3'"))], "intersection").relations
    assert one.count() == 49 and "Expand" not in plan_of(one) and "RepartitionByExpression" in plan_of(one)
    assert lineage.dealt(e, "id") is e


def test_rounds_of_components_hold_numbers(spark, monkeypatch):
    """F23, F24, F25, F27."""
    seen = []
    real = G.checkpointed
    monkeypatch.setattr(G, "checkpointed", lambda df: (seen.append(dict(df.dtypes)), real(df))[1])
    nodes = spark.createDataFrame([(x,) for x in "abcdefg"], "id string")
    edges = spark.createDataFrame([("g", "c"), ("c", "f"), ("b", "b"), ("d", "e"), ("d", "zz")], "src string, dst string")
    got = {r.id: r.component for r in G.components(nodes, edges).collect()}
    assert got == {"a": "a", "b": "b", "c": "c", "f": "c", "g": "c", "d": "d", "e": "d"}
    assert seen[0]["id"] == "string" and all(t == "bigint" for x in seen[1:] for t in x.values())


def test_triples_are_chosen_once_for_each_set_of_links(spark, monkeypatch):
    """F26."""
    written = []
    real = D.checkpointed
    monkeypatch.setattr(D, "checkpointed", lambda df: (written.append(real(df)), written[-1])[1])
    seed = spark.createDataFrame([(f"K{k}", f"h{k}", f"r{j % 2}", f"t{j}", 0.7 + j / 100) for k in range(3) for j in range(20)], "head_kb_id string, head string, relation string, tail string, score double")
    links = spark.createDataFrame([(1, "K0"), (1, "K1"), (2, "K1"), (2, "K0"), (2, "K0"), (3, "K2"), (None, "K0"), (4, "none")], "d long, kb_id string")
    rows = D.select_for_injection(links, seed, "d").collect()
    per = {k: sorted(tuple(x)[1:] for x in rows if x.d == k) for k in (1, 2, 3, 4, None)}
    assert per[1] == per[2] and len(per[1]) == 10 and per[3] and not per[4] and not per[None]
    assert written[-1].count() == 3


def test_springs_make_their_edges_once(spark, monkeypatch):
    """F10."""
    seen = []
    real = LY.checkpointed
    monkeypatch.setattr(LY, "checkpointed", lambda df: (seen.append(df.columns), real(df))[1])
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    assert LY.spring(nodes, spark.createDataFrame([("a", "b"), ("b", "c")], "src string, dst string"), steps=2).count() == 4
    assert seen.count(["src", "dst"]) == 1
