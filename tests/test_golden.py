"""Small inputs with known outcomes, and laws that hold for any graph."""

import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomgraph.functions import text as X
from loomgraph.kg import KG
from loomgraph.operators import aggregates as A
from loomgraph.operators import evaluation as V
from loomgraph.operators import extraction as E
from loomgraph.operators import filters as L
from loomgraph.operators import graph_algorithms as G
from loomgraph.operators import joins as J
from loomgraph.operators import rules as R
from loomgraph.operators import sets as S
from loomgraph.operators import training as T
from loomgraph.operators import windows as W
from loomgraph.sources import export, files
from loomgraph.streaming import events


def graph(spark, entities, relations):
    e = spark.createDataFrame([(i, t, k, c, None, n) for n, (i, t, k, c) in enumerate(entities)], "id string, text string, label string, confidence double, kb_id string, ord long")
    r = spark.createDataFrame(relations, "head string, relation_type string, tail string, confidence double, provenance string")
    return KG(e, r)


@pytest.fixture(scope="module")
def cleaning(spark):
    ends = [("e1", "diabetes", "DISEASE", 0.95), ("e2", "metformin", "DRUG", 0.9)]
    return graph(spark, ends, [("e1", "R", "e2", 0.9, "doc1#1"), ("e1", "S", "e2", 0.3, None), ("e2", "T", "e1", 0.6, "#2")])


def test_cleaning(cleaning):
    assert L.clean(cleaning, 0.5).relations.count() == 2
    assert L.clean(cleaning, 0.6).relations.count() == 2
    assert [r.relation_type for r in L.clean(cleaning, 0.0, True).relations.collect()] == ["R"]
    assert L.clean(cleaning, 0.95).entities.count() == 0
    once = L.by_confidence(cleaning, 0.5)
    assert L.by_confidence(once, 0.5).relations.collect() == once.relations.collect()
    with pytest.raises(ValueError):
        L.by_confidence(cleaning, 2)


def test_factuality_counts_repeats(spark):
    k = [("a", "REL", "b", c, None) for c in (0.85, 0.9, 0.95)]
    g = graph(spark, [("a", "a", "X", 1.0), ("b", "b", "X", 1.0)], k)
    row = A.factuality(J.in_reference(g.relations, g.relations.limit(2))).first()
    assert (row.total, row.correct, row.score) == (3, 3, 1.0)
    row = A.factuality(J.in_reference(g.relations, g.relations.limit(0))).first()
    assert (row.correct, row.score) == (0, 0.0)
    assert A.factuality(J.in_reference(g.relations.limit(0), g.relations)).first().score == 0.0


def test_merge(spark, cleaning):
    other = graph(spark, [("e3", "x", "X", 0.5)], [("e3", "R", "e1", 0.4, None)])
    m = S.merge([cleaning, other])
    assert (m.entities.count(), m.relations.count(), m.metadata["source_graphs"]) == (3, 4, 2)
    assert S.merge([cleaning, other], "intersection").relations.count() == 0
    assert S.merge([cleaning, cleaning], "intersection").relations.count() == 3
    w = {r.relation_type: r.confidence for r in S.merge([cleaning, KG(cleaning.entities, cleaning.relations.withColumn("confidence", F.lit(0.1)))], "weighted").relations.collect()}
    assert w["R"] == pytest.approx(0.5)
    with pytest.raises(ValueError):
        S.merge([], "union")


def test_score_buckets(spark):
    rows = spark.createDataFrame([(s, r) for s, r in zip((0.9, 0.7, 0.8, 0.6, 0.5, 0.4), ["treats"] * 3 + ["causes"] * 2 + ["prevents"])], "score double, relation string").withColumn("g", F.lit(0))
    b = {}
    for r in W.score_buckets(rows, ["g"], [F.desc("score")], 3).collect():
        b.setdefault(r.bucket, set()).add(r.score)
    assert b == {1: {0.9, 0.8}, 2: {0.7, 0.6}, 3: {0.5, 0.4}}
    kinds = W.frequency_buckets(rows, "relation", 3).groupBy("bucket").agg(F.count_distinct("relation").alias("n")).orderBy("bucket").collect()
    assert [r.n for r in kinds] == [1, 2, 3]


def test_overlaps_follow_the_order(spark):
    rows = [(1, 1, 10, "a"), (1, 3, 9, "b"), (1, 10, 20, "c"), (1, 15, 30, "d"), (2, 1, 2, "e")]
    got = L.without_overlaps(spark.createDataFrame(rows, "k int, start int, stop int, text string"), "k")
    assert sorted(r.text for r in got.collect()) == ["a", "c", "d", "e"]


def test_violations(spark):
    g = graph(spark, [("a", "a", "X", 1.0), ("a", "b", "X", 1.0), ("", "c", "X", 1.0)], [("a", "R", "a", 1.0, None), ("a", "R", "z", 1.0, None)])
    assert sorted((r.kind, r.id) for r in L.violations(g).collect()) == [("empty id", ""), ("loop", "a"), ("repeated id", "a"), ("unknown end", "z")]


def test_rules(spark):
    one = spark.range(1)
    row = one.select(
        R.entity_type(F.lit("Heart disease")).alias("a"), R.relation_type(F.lit("Metformin treats diabetes")).alias("b"),
        R.name_confidence(F.lit("Louis XIV"), F.lit("PERSON")).alias("c"), R.name_confidence(F.lit("x"), F.lit("CONCEPT")).alias("d"),
        R.validity(F.lit("Drug"), F.lit("treats"), F.lit("Disease")).alias("e"), R.supported(F.lit("A"), F.lit("TREATS"), F.lit("B"), F.lit("a is a drug for b")).alias("f"),
        R.valid_relation(F.lit("some drug"), F.lit("TREATS"), F.lit("a disease")).alias("g"), R.valid_relation(F.lit("x"), F.lit("TREATS"), F.lit("y"), strict=False).alias("h"),
    ).first()
    assert tuple(row)[:2] == ("DISEASE", "TREATS") and row.c == min(1.0, 0.55 + 0.15 + 0.1 + 0.15 + 0.1) and tuple(row)[3:] == (0.35, "yes", True, True, False)
    low, high = R.wilson(F.lit(0.5), F.lit(100.0))
    assert tuple(round(x, 4) for x in one.select(low, high).first()) == (0.4038, 0.5962)
    assert tuple(one.select(*R.wilson(F.lit(0.5), F.lit(0.0))).first()) == (0.0, 0.0)


def test_distributions():
    assert V.t_tail(2.0, 10) == pytest.approx(0.07338803477074039, abs=1e-10)
    assert V.t_tail(0.0, 5) == pytest.approx(1.0)
    assert V.chi_tail(3.841458820694124) == pytest.approx(0.05, abs=1e-9)


def test_two_samples(spark):
    a = spark.createDataFrame([(x,) for x in (1.0, 2.0, 3.0, 4.0)], "s double")
    b = spark.createDataFrame([(x,) for x in (2.0, 3.0, 4.0, 5.0)], "s double")
    r = V.two_sample_t(a, b, "s").first()
    assert (r.difference, r.statistic) == (-1.0, pytest.approx(-1.095445)) and not r.significant


def test_extraction(spark):
    docs = spark.createDataFrame([(1, "John Smith met Mary Jones. John Smith left in 1999."), (2, ""), (3, None)], "doc_id long, text string")
    got = E.mentions(docs, "doc_id", [("NAME", "[A-Z][a-z]+ [A-Z][a-z]+"), ("NUMBER", "[0-9]{4}")]).orderBy("start").collect()
    assert [(r.text, r.type, r.start, r.stop) for r in got] == [("John Smith", "NAME", 1, 10), ("Mary Jones", "NAME", 16, 25), ("1999", "NUMBER", 47, 50)]
    near = E.proximity_relations(docs, E.mentions(docs, "doc_id", [("NAME", "[A-Z][a-z]+ [A-Z][a-z]+")]), "doc_id").collect()
    assert [(r.head, r.relation_type, r.tail) for r in near] == [("John Smith", "RELATED_TO", "Mary Jones")]
    spouse = spark.createDataFrame([(1, "Louis XIV married Maria Theresa of Spain")], "doc_id long, text string")
    assert [(r.head, r.relation_type, r.tail, r.confidence) for r in E.named_relations(spouse, "doc_id").collect()] == [("Louis XIV", "SPOUSE_OF", "Maria Theresa of Spain", 0.95)]


def test_replies(spark):
    one = spark.range(1)
    names = one.select(X.parse_entities(F.lit("Extracted:\n1. Insulin\n- Type_1\nab\n# x\n2 Insulin"))).first()[0]
    assert names == ["Insulin", "Type1"]
    rows = one.select(X.parse_relations(F.lit("A -> treats -> B\nbad\nA -> is made of! -> C->D"))).first()[0]
    assert [tuple(r) for r in rows] == [("A", "IS_MADE_OF", "C->D")]
    assert tuple(one.select(X.provenance(F.lit("docX#2"))).first()[0]) == ("docX", "2")
    assert tuple(one.select(X.provenance(F.lit(None).cast("string"))).first()[0]) == ("", "0")


def test_components_and_paths(spark):
    nodes = spark.createDataFrame([(x,) for x in "abcdefgh"], "id string")
    edges = spark.createDataFrame([("a", "b"), ("c", "b"), ("c", "d"), ("f", "e"), ("g", "zz"), ("h", "h")], "src string, dst string")
    c = {r.id: r.component for r in G.components(nodes, edges).collect()}
    assert c == dict(a="a", b="a", c="a", d="a", e="e", f="e", g="g", h="h")
    line = spark.createDataFrame([(k, k + 1) for k in range(6)], "src long, dst long")
    d = {(r.src, r.dst): r.hops for r in G.distances(line, 4).collect()}
    assert d[0, 4] == 4 and (0, 5) not in d and (1, 0) not in d


def test_chain(spark):
    docs = spark.createDataFrame([(1, [5, 6, 7])], "doc_id long, t array<long>")
    roots = G.chain(docs, "doc_id", F.col("t"))
    into = spark.createDataFrame([(1, 0, 1, "r", [9, 9]), (1, 0, 2, "s", list(range(20, 30)))], "doc_id long, root_ix int, ord int, relation string, tail_tokens array<long>")
    rows = G.inject(roots, "doc_id", into).orderBy("root_ix").collect()
    assert len(rows) == G.ROOTS and rows[0].relation == "s" and rows[0].leaves == list(range(20, 27)) and rows[0].injections == 2 and rows[3].is_pad
    s = G.sequence(G.inject(roots, "doc_id", into), "doc_id").first()
    assert len(s.ids) == len(s["mask"]) == 1024 and s.ids[:4] == [5, 6, 7, 0] and sum(s["mask"]) == 3 + 7


def test_masking_shares(spark):
    t = spark.range(4000).select((F.col("id") % 4).alias("doc"), F.floor(F.col("id") / 4).alias("pos"), (F.col("id") % 97 + 1000).alias("token"))
    m = T.masked(t, "doc", "pos", "token").groupBy("doc").agg(F.count_if(F.col("label") != T.IGNORE).alias("n"), F.count_if(F.col("input") == T.MASK).alias("masked")).collect()
    assert all(r.n == 150 and 100 < r.masked < 140 for r in m)


def test_exports(spark, cleaning, tmp_path):
    for kind in export.FORMATS:
        export.export(cleaning, kind, str(tmp_path / kind))
    lines = [r.value for r in spark.read.text(f"{tmp_path}/json/kind=entity").collect()]
    assert {json.loads(x)["id"] for x in lines} == {"e1", "e2"}
    assert spark.read.csv(f"{tmp_path}/csv/relations", header=True).count() == 3
    assert spark.read.text(f"{tmp_path}/ttl").count() == spark.read.text(f"{tmp_path}/rdf").count() == 5
    with pytest.raises(ValueError):
        export.export(cleaning, "xls", str(tmp_path / "x"))
    odd = graph(spark, [("e", 'a<b>&"c', "X", 1.0)], [])
    assert "a&lt;b&gt;&amp;&quot;c" in export.rdf_rows(odd).first().value


def test_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"icd_code": "E11"}, {"icd_code": null}]')
    (tmp_path / "b.csv").write_text("icd_code\nE10\n")
    assert [files.records(spark, f"{tmp_path}/{n}", "icd_code string").count() for n in ("a.json", "b.csv", "none.csv")] == [2, 1, 0]
    (tmp_path / "c.json").write_text('{"a": {"b": 2}, "x": 1}')
    config = files.load_config(spark, f"{tmp_path}/c.json", {"a": {"b": 1, "c": 3}})
    assert config == {"a": {"b": 2, "c": 3}, "x": 1} and files.nested(config, "a.c") == 3 and files.nested(config, "a.z.q", 0) == 0
    assert files.load_config(spark, f"{tmp_path}/none.json", {"k": 1}) == {"k": 1}
    assert files.api_config(spark, f"{tmp_path}/c.json")["timeout"] == 30
    assert files.model_info(spark, f"{tmp_path}/c.json", "t") is None


def upper_backend():
    def reply(prompts):
        if any("fail" in p for p in prompts):
            raise RuntimeError("no answer")
        return [p.upper() for p in prompts]

    return reply


def test_backends(spark):
    asked = spark.createDataFrame([("hello",)], "prompt string")
    assert tuple(files.complete(asked, upper_backend).first()) == ("hello", "HELLO", None)
    assert files.complete(spark.createDataFrame([("fail",)], "prompt string"), upper_backend).first().error == "no answer"
    assert files.complete(asked).first().error == "no backend"
    doubled = T.infer(spark.range(3), lambda: lambda b: pa.RecordBatch.from_arrays([pa.array([x * 2 for x in b.column("id").to_pylist()], pa.int64())], ["y"]), "y long")
    assert sorted(r.y for r in doubled.collect()) == [0, 2, 4]


def test_budget():
    allow = events.budget_ok(60, 10)
    assert [allow(0, 6), allow(1, 6), allow(2, 4), allow(59, 1), allow(60, 10), allow(61, 1)] == [True, False, True, False, True, False]
