"""Row ids hold when a table is split among tasks in another way between two scans."""

import random

import pytest

from loomgraph.llm import decontaminate, near_dedup, shared
from loomgraph.llm.shared import AT, FILE

WAYS = [("8", "1", "64k"), ("3", "4m", "128m"), ("1", "1", "1k")]


def plan(spark, way):
    for key, value in zip(("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"), way):
        spark.conf.set(key, value)


@pytest.fixture
def corpus(spark, tmp_path):
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgh", k=5)) for _ in range(3000)]
    items = [(k, " ".join(r.choices(words, k=30))) for k in range(20)]
    docs = []
    for k in range(1500):
        text = r.choices(words, k=40)
        if k % 3 == 0:
            text += items[k % 20][1].split(" ")
        docs.append((k, " ".join(text)))
    docs += [(2000 + k, docs[k][1] + " more") for k in range(0, 1500, 5)]
    r.shuffle(docs)
    folder = f"{tmp_path}/docs.parquet"
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.option("parquet.block.size", 4096).parquet(folder)
    yield folder, spark.createDataFrame(items, "item_id long, text string")
    for key in ("spark.sql.leafNodeDefaultParallelism", "spark.sql.files.openCostInBytes", "spark.sql.files.maxPartitionBytes"):
        spark.conf.unset(key)


def replan_after(monkeypatch, spark, module, names):
    """After each call of these functions the next scan is split in another way."""
    ways = [0]
    for name in names:
        old = getattr(module, name)

        def call(*args, _old=old, **more):
            out = _old(*args, **more)
            ways[0] += 1
            plan(spark, WAYS[ways[0] % len(WAYS)])
            return out

        monkeypatch.setattr(module, name, call)


def test_filter_rows(spark, corpus):
    docs = spark.read.parquet(corpus[0])
    plan(spark, WAYS[0])
    numbered = shared.with_row_ids(docs, [])
    wanted = shared.written(numbered.where("doc_id % 7 = 0").select(FILE, AT), "wanted")
    n = docs.count()
    for way in WAYS:
        plan(spark, way)
        kept = shared.filter_rows(docs, numbered, wanted, "kept", keep=True)
        left = shared.filter_rows(docs, numbered, wanted, "left", keep=False)
        assert {r.doc_id % 7 for r in kept.collect()} == {0}
        assert kept.count() == wanted.count() and left.count() == n - wanted.count()
        assert kept.columns == docs.columns


def test_near_copies(spark, corpus, monkeypatch):
    docs = spark.read.parquet(corpus[0])
    plan(spark, WAYS[1])
    want = sorted((r.doc_id, r.class_id, r.n_links, r.keep) for r in near_dedup.classes(docs).collect())
    assert sum(not k for *_, k in want) == 300
    replan_after(monkeypatch, spark, near_dedup, ["written", "lookup_table"])
    assert sorted((r.doc_id, r.class_id, r.n_links, r.keep) for r in near_dedup.classes(docs).collect()) == want


def test_leaks(spark, corpus, monkeypatch):
    docs, items = spark.read.parquet(corpus[0]), corpus[1]
    plan(spark, WAYS[1])
    want = sorted((r.doc_id, r.item_id, r.similarity, r.start) for r in decontaminate.contaminated(docs, items).collect())
    assert len(want) == 600
    replan_after(monkeypatch, spark, decontaminate, ["written"])
    assert sorted((r.doc_id, r.item_id, r.similarity, r.start) for r in decontaminate.contaminated(docs, items).collect()) == want


def test_no_folder_of_one_machine_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_root(Session())
