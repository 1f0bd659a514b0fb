"""The pipeline against its stages' plain versions, on a small corpus."""

import hashlib
import random

import numpy as np
import sentencepiece

import corpus_pipeline
from loomgraph.llm import pii, sentencepiece_codec, toxicity

from .test_decontaminate import brute
from .test_near_dedup import plain_classes
from .test_toxicity import corpus


def test_pipeline_equals_plain_version(spark, tmp_path):
    r = random.Random(9)
    docs, labels = corpus(spark, 400)
    docs = [(k, t) for k, t, _ in docs]
    items = [(k, " ".join("".join(r.choices("klmnop", k=4)) for _ in range(30))) for k in range(4)]
    for k in range(0, 400, 9):
        docs.append((1000 + k, docs[k][1] + " extra"))
    for k in range(0, 60, 7):
        docs.append((2000 + k, docs[k][1] + " " + items[k % 4][1] + " mail x@y.org"))
    docs += [(None, None), (3000, ""), (3001, "call +1 (977) 555-9722 or a [at] b [dot] com"), (5, docs[5][1])]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    frame.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    source = spark.read.parquet(f"{tmp_path}/documents.parquet")
    index = toxicity.load(toxicity.fit(source, spark.read.parquet(f"{tmp_path}/labels.parquet")))
    rows = [(x.doc_id, x.text) for x in source.collect()]
    rows = [(i, t) for i, t in rows if index.scores([t or ""])[0][0] < 0.5]
    dropped = len(docs) - len(rows)
    classes, seen, kept = plain_classes(rows), set(), []
    for (i, t), c in sorted(zip(rows, classes), key=lambda x: (x[0][0] is None, x[0][0])):
        if i == c and c not in seen:
            seen.add(c)
            kept.append((i, t))
    near = len(rows) - len(kept)
    leaks = {d for d, _, _, _ in brute(kept, items)}
    rows = [(i, t) for i, t in kept if i not in leaks]
    assert dropped > 50 and near > 10 and len(leaks) > 1
    sp = sentencepiece.SentencePieceProcessor(model_file=sentencepiece_codec.default_model())
    want = []
    for i, t in rows:
        ids = [1, *sp.encode(pii.redact(t or "", pii.find_spans(t or "")[1])), 2]
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    got = [tuple(x) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([], "doc_id long, text string, score string, _x int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == 0, name


def test_other_columns_stay(spark, tmp_path):
    spark.createDataFrame([(k, 0) for k in range(20)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k, f"text number {k} of a small set", f"s{k}", k, f"p{k}", [k]) for k in range(20)] + [(None, None, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, score string, _row int, predicted string, evidence array<int>").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert sorted(map(str, stage(spark, docs, str(tmp_path)).collect())) == sorted(map(str, docs.collect())), name
