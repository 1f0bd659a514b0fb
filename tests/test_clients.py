"""Text services, article indexes and knowledge bases, through transports of our own."""

import json
import urllib.parse

import pytest
from loomgraph import domains
from loomgraph.operators import evaluation as V
from loomgraph.sources import clients, files
from loomgraph.sources.knowledge import KnowledgeBase
from pyspark.sql import functions as F


def test_request_bodies():
    chat = clients.Service("chat", "http://x/v1", "m", "key", temperature=0.5, max_tokens=9)
    url, headers, body = chat.request("hello")
    assert url == "http://x/v1/chat/completions" and headers["Authorization"] == "Bearer key"
    assert body == {"model": "m", "messages": [{"role": "user", "content": "hello"}], "temperature": 0.5, "max_tokens": 9}
    url, _, body = clients.Service("generate", "http://x", "m").request("hello")
    assert url == "http://x/api/generate" and body["prompt"] == "hello" and body["stream"] is False
    url, _, body = clients.Service("dialogue", "http://x", "m").request("hello")
    assert url == "http://x/api/chat" and body["messages"][0]["content"] == "hello"
    assert chat.reply({"choices": [{"message": {"content": "hi"}}]}) == "hi"
    with pytest.raises(ValueError, match="choices"):
        chat.reply({"choices": []})


@pytest.mark.parametrize("bad", [{"context": 0}, {"context": 9000}, {"threads": 0}, {"temperature": 2.5}, {"max_tokens": 0}, {"max_tokens": 5000}, {"kind": "other"}, {"max_retries": 0}])
def test_settings_out_of_range_are_refused(bad):
    with pytest.raises(ValueError):
        clients.backend(clients.Service(**bad))


def test_retries_wait_longer_each_time():
    waits, seen = [], []

    def transport(url, headers, body, seconds):
        seen.append(json.loads(body)["messages"][0]["content"])
        if len(seen) == 1:
            return 429, "busy"
        if len(seen) == 2:
            raise OSError("gone")
        return 200, json.dumps({"choices": [{"message": {"content": "done"}}]})

    budget = clients.TokenBudget(1000, sleep=waits.append)
    assert clients.asked(clients.Service(max_retries=3), transport, budget, "p") == "done"
    assert waits == [2.0, 4.0] and seen == ["p"] * 3
    with pytest.raises(ConnectionError, match="HTTP 500: no"):
        clients.asked(clients.Service(), lambda *_: (500, "no"), budget, "p")
    with pytest.raises(ConnectionError, match="Rate limit exceeded"):
        clients.asked(clients.Service(max_retries=2), lambda *_: (429, ""), budget, "p")


def test_budget_waits_for_the_next_minute():
    now, waits = [100.0], []

    def sleep(s):
        waits.append(s)
        now[0] += s

    b = clients.TokenBudget(10, clock=lambda: now[0], sleep=sleep)
    b.take("x" * 40)
    now[0] += 20
    b.take("x" * 4)
    assert waits == [40.0] and b.used == 1
    now[0] += 61
    b.take("x" * 400)
    assert waits == [40.0] and b.used == 100


def test_replies_are_remembered_for_a_time():
    now = [0.0]
    r = clients.Replies(2, 10, clock=lambda: now[0])
    for k in "abc":
        r.put(k, k.upper())
    assert [r.get(k) for k in "abc"] == [None, "B", "C"]
    now[0] = 11
    assert r.get("b") is None


def echo(url, headers, body, seconds):
    prompt = json.loads(body)["messages"][0]["content"]
    if "fail" in prompt:
        return 500, "no"
    return 200, json.dumps({"choices": [{"message": {"content": "re: " + prompt}}]})


def test_service_as_a_backend(spark):
    p = spark.createDataFrame([(1, "one"), (2, "two")], "k long, prompt string")
    got = files.complete(p, clients.backend(clients.Service("chat"), echo)).orderBy("k").collect()
    assert [(r.reply, r.error) for r in got] == [("re: one", None), ("re: two", None)]
    got = files.complete(p.where("k = 1").withColumn("prompt", F.lit("fail")), clients.backend(clients.Service("chat"), echo)).collect()
    assert got[0].reply == "" and "HTTP 500" in got[0].error
    assert [r.error for r in files.complete(p).collect()] == ["no backend"] * 2


def index(url, headers, body, seconds):
    part, _, query = url.partition("?")
    q = dict(urllib.parse.parse_qsl(query))
    if part.endswith("esearch.fcgi"):
        if q["term"] == "broken":
            return 503, ""
        return 200, json.dumps({"esearchresult": {"idlist": [] if q["term"] == "none" else ["7", "8"]}})
    assert q["id"] == "7,8"
    return 200, json.dumps({"result": {"7": {"title": "T", "authors": [{"name": "A B"}], "pubdate": "2020", "fulljournalname": "J", "articleids": [{"idtype": "doi", "value": "10/x"}]}}})


def test_articles(spark):
    q = spark.createDataFrame([("found",), ("none",), ("broken",), (None,)], "query string").where("query IS NOT NULL")
    got = clients.search_articles(q, index, base_url="http://x").orderBy("query", "pmid").collect()
    assert [(r.query, r.pmid, r.title, r.authors, r.doi, r.error) for r in got] == [("broken", None, None, None, None, "HTTP 503"), ("found", "7", "T", ["A B"], "10/x", None), ("found", "8", "", [], "", None)]
    assert [r.error for r in clients.search_articles(q.where("query = 'none'")).collect()] == ["no transport"]


def test_article_projection(spark):
    rows = [('{"title": "T", "abstract": "A", "authors": ["x"], "pmid": "1"}',), ('{"abstract": "only"}',), ("{}",)]
    d = spark.createDataFrame(rows, "j string").select(clients.article(F.col("j")).alias("a"))
    got = d.select("a.*", clients.article_text(F.col("a.title"), F.col("a.abstract")).alias("body")).collect()
    assert [r.body for r in got] == ["T A", "only", ""] and got[0].authors == ["x"] and got[2].authors == [] and got[2].journal == ""


def test_knowledge_base(spark):
    c = spark.createDataFrame([("K2", "Aspirin", ["Drug"], {"en": "Aspirin", "de": "Aspirin (Arznei)"}), ("K1", "aspirin", ["Chemical"], {}), ("K3", "Low-dose aspirin", None, None)], "kb_id string, name string, types array<string>, labels map<string,string>")
    r = spark.createDataFrame([("K1", "P19", "K2"), ("K1", "P999", "K3")], "src_kb_id string, relation_name string, dst_kb_id string")
    base = KnowledgeBase(c, r)
    m = spark.createDataFrame([("ASPIRIN",), ("none",)], "text string")
    assert sorted(map(tuple, base.link(m).collect())) == [("ASPIRIN", "K1", ["Chemical"]), ("none", None, [])]
    ids = spark.createDataFrame([("K1",), ("K3",), ("K9",)], "kb_id string")
    assert sorted(map(tuple, base.relations_of(ids).collect())) == [("K1", "P19", "BORN_IN", "K2"), ("K1", "P999", "RELATED_TO", "K3")]
    assert {x.kb_id: x.types for x in base.types_of(ids).collect()} == {"K1": ["Chemical"], "K3": [], "K9": []}
    assert sorted(map(tuple, base.items(ids.union(spark.createDataFrame([("K2",)], "k string")), "de").collect())) == [("K1", "", 2), ("K2", "Aspirin (Arznei)", 0), ("K3", "", 0), ("K9", "", 0)]
    assert [x.kb_id for x in base.search("aspirin").collect()] == ["K1", "K2", "K3"] and base.search("").count() == 0
    none = KnowledgeBase.empty(spark)
    assert none.link(m).where("kb_id IS NULL").count() == 2 and none.search("x").count() == 0


def names(prompts=None):
    def run(prompts):
        if any("broken" in p for p in prompts):
            raise OSError("no model")
        return ["1. Louis XIV\n2. Versailles" for _ in prompts]

    return run


def test_model_entities_fall_back_to_patterns(spark):
    d = domains.GENERAL
    got = d.model_entities(spark.createDataFrame([(1, "At Versailles lived Louis XIV.")], "k long, text string"), "k", names).orderBy("start").collect()
    assert [(r.text, r.type, r.start, r.stop, r.confidence, r.by) for r in got] == [("Versailles", "UNKNOWN", 4, 13, 0.7, "model"), ("Louis XIV", "UNKNOWN", 21, 29, 0.7, "model")]
    got = d.model_entities(spark.createDataFrame([(1, "John Smith is broken")], "k long, text string"), "k", names).collect()
    assert [(r.text, r.type, r.by) for r in got] == [("John Smith", "PERSON", "rule")]
    with pytest.raises(ValueError, match="no prompt"):
        d.prompt("other", F.lit(""))


def verdicts():
    def run(prompts):
        if any("broken" in p for p in prompts):
            raise OSError("no model")
        return [" Yes." if "good" in p else "No!" if "bad" in p else "perhaps" for p in prompts]

    return run


def test_model_verdicts(spark):
    rows = [("alpha", "TREATS", "beta", "good"), ("gamma", "TREATS", "delta", "bad"), ("iota", "TREATS", "kappa", "?")]
    t = spark.createDataFrame(rows, "head string, relation_type string, tail string, context string").coalesce(1)
    assert {r.head: (r.supported, r.by) for r in V.model_support(t, verdicts).collect()} == {"alpha": (True, "model"), "gamma": (False, "model"), "iota": (False, "model")}
    t2 = spark.createDataFrame([("good", "TREATS", "x"), ("bad", "TREATS", "x"), ("y", "TREATS", "x")], "head string, relation_type string, tail string").coalesce(1)
    assert {r["head"]: r["verdict"] for r in V.model_validity(t2, verdicts).collect()} == {"good": "yes", "bad": "no", "y": "maybe"}
    broken = t.withColumn("context", F.lit("broken: alpha is a drug for beta"))
    assert {r.head: (r.supported, r.by) for r in V.model_support(broken, verdicts).collect()} == {"alpha": (True, "rule"), "gamma": (False, "rule"), "iota": (False, "rule")}
    assert {r.verdict for r in V.model_validity(t2.withColumn("head", F.lit("broken")), verdicts).collect()} == {"unknown"}
