"""Queries for windows, top-k, graph algorithms, seeds, training rows, sources, sinks and streams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import maths as M
from ..functions import text as X
from ..kg import SQL, star_kg, table
from ..operators import aggregates as A
from ..operators import graph_algorithms as G
from ..operators import joins as J
from ..operators import layouts as LY
from ..operators import masking as MK
from ..operators import seeds as D
from ..operators import training as T
from ..operators import windows as W
from ..sources import clients, files
from ..sources.knowledge import KnowledgeBase
from .graph_queries import TRIPLES, both, both_sql
from .registry import query
from .text_queries import FOUND, found


def seed(spark, d):
    t = J.triples(star_kg(spark, d)).where("head_kb IS NOT NULL")
    return t.select(F.col("head_kb").alias("head_kb_id"), F.col("head_text").alias("head"), F.col("relation_type").alias("relation"), F.col("tail_text").alias("tail"), F.col("confidence").alias("score"))


SEED = f"{SQL}, seed AS (SELECT head_kb AS head_kb_id, head_text AS head, relation_type AS relation, tail_text AS tail, confidence AS score FROM ({TRIPLES}) WHERE head_kb IS NOT NULL)"


@query("win1_score_buckets", f"{SEED}, r AS (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY score DESC, head, tail) AS r, count(*) OVER (PARTITION BY relation) AS n FROM seed), b AS (SELECT *, CAST(ceil(r / greatest(1, n // 3)) AS INTEGER) AS bucket FROM r) SELECT relation, bucket, count(*) AS n, min(score) AS least, max(score) AS most FROM b WHERE bucket <= 3 GROUP BY ALL")
def _(spark, d):
    b = W.score_buckets(seed(spark, d), ["relation"], [F.desc("score"), "head", "tail"], 3)
    return b.groupBy("relation", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query("win2_relation_frequency_buckets", f"{SEED}, c AS (SELECT relation, count(*) AS n FROM seed GROUP BY relation), p AS (SELECT relation, row_number() OVER (ORDER BY n, relation) AS p FROM c), k AS (SELECT unnest(range(1, 3)) AS bucket) SELECT CAST(bucket AS INTEGER) AS bucket, count(*) AS n, count(DISTINCT s.relation) AS relations FROM seed s JOIN p USING (relation) JOIN k ON p.p <= k.bucket GROUP BY bucket")
def _(spark, d):
    b = W.frequency_buckets(seed(spark, d), "relation", 2)
    return b.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("relation").alias("relations"))


@query("win4_ordinals", f"{SQL} SELECT id, row_number() OVER (PARTITION BY label ORDER BY ord) AS n FROM entities")
def _(spark, d):
    return W.placed(star_kg(spark, d).entities, ["label"], ["ord"], "n").select("id", "n")


@query("win5_span_boundaries", "WITH m AS (SELECT user_id, event_id, value > 20 AS on_ FROM events), o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS spot FROM m), r AS (SELECT user_id, spot, spot - row_number() OVER (PARTITION BY user_id ORDER BY spot) AS run FROM o WHERE on_) SELECT user_id, min(spot) AS first, max(spot) AS last FROM r GROUP BY user_id, run")
def _(spark, d):
    e = W.ranked(table(spark, d, "events"), ["user_id"], ["event_id"], "at").withColumn("on_", F.col("value") > 20)
    return W.islands(e, "user_id", "at", "on_")


@query("win6_patience", "WITH b AS (SELECT user_id, event_id, value, min(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events), g AS (SELECT *, sum(CASE WHEN best IS NULL OR value < best THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM b), w AS (SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id, g ORDER BY event_id) - 1 AS INTEGER) AS waited FROM g) SELECT event_id, waited, waited >= 3 AS stop FROM w")
def _(spark, d):
    return W.patience(table(spark, d, "events"), "user_id", "event_id", "value", 3).select("event_id", "waited", "stop")


@query("win7_leak_trend", "WITH l AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), g AS (SELECT user_id, value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS g FROM l WHERE r <= 10) SELECT user_id, count(*) >= 10 AND count_if(g)/9.0 > 0.5 AS leaking FROM g GROUP BY user_id")
def _(spark, d):
    return W.leak_trend(table(spark, d, "events"), "user_id", "event_id", "value", 0.5)


@query("win8_mean_drop", "WITH l AS (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) SELECT user_id, round(avg((b - value)/b), 6) AS drop FROM l WHERE value < b AND b > 0 GROUP BY user_id".replace(" AS drop", ' AS "drop"'))
def _(spark, d):
    return W.mean_drop(table(spark, d, "events"), "user_id", "event_id", "value")


@query("win9_tuned_batch", "WITH s AS (SELECT user_id, event_id, value, event_id % 100 AS mem, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS n, stddev_samp(value) OVER w / avg(value) OVER w AS v FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), b AS (SELECT *, CASE WHEN mem > 90 THEN 25 WHEN mem < 50 AND value > 0.1 THEN 38 ELSE 32 END AS b FROM s) SELECT event_id, CAST(CASE WHEN n >= 3 THEN CASE WHEN v > 0.3 THEN floor(b * 0.9) ELSE b END ELSE 32 END AS INTEGER) AS batch FROM b")
def _(spark, d):
    e = table(spark, d, "events").withColumn("mem", F.col("event_id") % 100)
    return W.tuned_batch(e, "user_id", "event_id", "value", "mem", 32, 100.0).select("event_id", "batch")


@query("win10_value_curve", "SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS step FROM events")
def _(spark, d):
    return W.ranked(table(spark, d, "events"), ["user_id"], ["event_id"], "step").select("user_id", "event_id", "value", "step")


@query("win11_word_prefixes", f"{SQL}, w AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM entities) SELECT id, unnest(list_transform(range(1, len(w) + 1), lambda n: array_to_string(w[1:n], ' '))) AS prefix FROM w")
def _(spark, d):
    return star_kg(spark, d).entities.select("id", F.explode(J.word_prefixes(F.col("text"))).alias("prefix"))


@query("win3_injection_selection", f"""{SEED}, linked AS (SELECT DISTINCT o_custkey AS doc_id, 'KS' || (o_orderkey % 90) AS head_kb_id FROM orders), many AS (SELECT doc_id, count(*) AS linked FROM linked GROUP BY doc_id), t AS (SELECT doc_id, head_kb_id, relation, tail, max(score) AS score, min(head) AS head FROM linked JOIN seed USING (head_kb_id) WHERE score >= 0.7 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, head_kb_id, relation, tail) AS r, count(*) OVER (PARTITION BY doc_id) AS n FROM t), b AS (SELECT *, ceil(r / greatest(1, n // 10))::INTEGER AS bucket FROM r WHERE ceil(r / greatest(1, n // 10)) <= 10),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket, relation ORDER BY score DESC, head_kb_id, tail) AS first, count(*) OVER (PARTITION BY doc_id, bucket, relation) AS kind FROM b), p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY kind, relation) AS place FROM c WHERE first = 1),
o AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id ORDER BY bucket, place) AS ord FROM p JOIN many USING (doc_id) WHERE place <= 5 AND place <= greatest(linked, 1)) SELECT doc_id, ord::INTEGER AS ord, head_kb_id, head, relation, tail, score FROM o WHERE ord <= 10""")
def _(spark, d):
    links = table(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.concat(F.lit("KS"), (F.col("o_orderkey") % 90).cast("string")).alias("kb_id"))
    return D.select_for_injection(links, seed(spark, d), "doc_id")



LINKS = """WITH e AS (SELECT vec_id, label, embedding FROM embeddings), p AS (SELECT m.vec_id AS mention, b.vec_id AS kb_id, round(list_cosine_similarity(m.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM e m JOIN e b ON m.vec_id % 10 = 0 AND b.vec_id % 10 <> 0), r AS (SELECT *, row_number() OVER (PARTITION BY mention ORDER BY score DESC, kb_id) AS r FROM p WHERE score >= 0.05)"""


@query("join16_nearest_links", f"{LINKS} SELECT mention, kb_id, score FROM r WHERE r <= 5")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return D.link(e.where("vec_id % 10 = 0"), e.where("vec_id % 10 <> 0"), 0.05, 5)


@query("top2_seed_candidates", f"{SEED}, r AS (SELECT *, row_number() OVER (PARTITION BY head_kb_id ORDER BY score DESC, head, relation, tail) AS r FROM seed) SELECT head_kb_id, relation, tail, score FROM r WHERE r <= 4")
def _(spark, d):
    return D.candidates(seed(spark, d), 4).select("head_kb_id", "relation", "tail", "score")


@query("top3_truncated_sequences", "SELECT o_custkey, array_to_string(list_sort(list(o_orderkey))[1:3], ',') AS firsts FROM orders GROUP BY o_custkey")
def _(spark, d):
    firsts = W.first_values(table(spark, d, "orders"), "o_custkey", "o_orderkey", 3)
    return firsts.select("o_custkey", F.array_join(F.transform("firsts", lambda x: x.cast("string")), ",").alias("firsts"))


@query("top4_top_logits", "SELECT vec_id, array_to_string(list_transform(list_sort(list_transform(embedding, lambda x, i: {'v': -x, 'i': i - 1}))[1:3], lambda s: s.i), ',') AS top FROM embeddings")
def _(spark, d):
    top = F.transform(W.top_indexes(F.col("embedding"), 3), lambda i: i.cast("string"))
    return table(spark, d, "embeddings").select("vec_id", F.array_join(top, ",").alias("top"))


@query("top5_simplify_graph", f"{SQL}, e AS (SELECT * FROM entities WHERE confidence >= 0.2 ORDER BY confidence DESC, ord LIMIT 300), r AS (SELECT * FROM relations WHERE confidence >= 0.2 AND head IN (SELECT id FROM e) AND tail IN (SELECT id FROM e) ORDER BY confidence DESC, head, relation_type, tail LIMIT 50) " + both_sql("SELECT * FROM e WHERE id IN (SELECT head FROM r UNION SELECT tail FROM r)", "SELECT * FROM r", ""))
def _(spark, d):
    return both(G.simplify(star_kg(spark, d), 300, 50, 0.2))


@query("top7_entities_by_confidence", f"{SQL}, x AS (SELECT label, text, confidence, row_number() OVER (PARTITION BY label ORDER BY confidence DESC, text) AS rank FROM (SELECT label, text, max(confidence) AS confidence FROM entities GROUP BY ALL)) SELECT * FROM x WHERE rank <= 20")
def _(spark, d):
    one = star_kg(spark, d).entities.groupBy("label", "text").agg(F.max("confidence").alias("confidence"))
    return W.ranked(one, ["label"], [F.desc("confidence"), "text"]).where("rank <= 20")


_PLACE = "(((1103 * 12345 + 7919 * doc_id + 104729) % 1000003) * 48271) % 1000003"


@query("top8_shuffle_split_batch", f"WITH p AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY {_PLACE}, doc_id) AS place, count(*) OVER (PARTITION BY lang) AS n FROM documents) SELECT doc_id, place, place <= round_even(n * 0.8, 0) AS train, CAST((place - 1) // 32 AS INTEGER) AS batch FROM p")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return W.shuffled(docs, [T.draw(F.col("doc_id")), "doc_id"], 0.8, 32, ["lang"]).select("doc_id", "place", "train", "batch")


@query("top9_document_batches", "SELECT doc_id, CAST((row_number() OVER (ORDER BY doc_id) - 1) // 32 AS BIGINT) AS batch FROM documents")
def _(spark, d):
    """Batches follow the place among the documents that are there, whatever their ids."""
    return W.batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 32).select("doc_id", "batch")


ALL_EDGES = "SELECT head AS src, tail AS dst FROM relations"


def all_edges(spark, d):
    return star_kg(spark, d).relations.select(F.col("head").alias("src"), F.col("tail").alias("dst"))


@query("grf1_components", f"{SQL}, e AS ({ALL_EDGES}), b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), w AS (SELECT id, id AS seen FROM entities WHERE id LIKE 'R:%' UNION SELECT w.id, b.dst FROM w JOIN b ON b.src = w.seen), c AS (SELECT seen AS id, min(id) AS r FROM w GROUP BY seen), n AS (SELECT id, coalesce(r, id) AS comp FROM entities LEFT JOIN c USING (id)) SELECT comp_min AS component, count(*) AS n FROM (SELECT id, min(id) OVER (PARTITION BY comp) AS comp_min FROM n) GROUP BY comp_min")
def _(spark, d):
    c = G.components(star_kg(spark, d).entities, all_edges(spark, d))
    return c.groupBy("component").agg(F.count(F.lit(1)).alias("n"))


@query("grf2_shortest_paths", f"{SQL}, e AS ({ALL_EDGES}), two AS (SELECT DISTINCT a.src, b.dst FROM e a JOIN e b ON a.dst = b.src) SELECT hops, count(*) AS n, min(src || dst) AS first FROM (SELECT DISTINCT src, dst, 1 AS hops FROM e UNION ALL SELECT src, dst, 2 FROM two WHERE src <> dst AND (src, dst) NOT IN (SELECT (src, dst) FROM e)) GROUP BY hops")
def _(spark, d):
    return G.distances(all_edges(spark, d), 4).groupBy("hops").agg(F.count(F.lit(1)).alias("n"), F.min(F.concat("src", "dst")).alias("first"))


_ROOTS = "r AS (SELECT doc_id, least(len(w), 128) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents))"


def text_roots(spark, d):
    """doc_id, n: the roots of each text's chain graph that hold a word."""
    return table(spark, d, "documents").select("doc_id", F.least(F.size(X.words("text")), F.lit(G.ROOTS)).alias("n"))


@query("grf2_chain_distances", f"WITH {_ROOTS}, a AS (SELECT doc_id, n, unnest(range(n)) AS i FROM r), b AS (SELECT n - i AS later, count(*) AS docs FROM a GROUP BY 1), h AS (SELECT docs, unnest(range(later)) AS apart FROM b) SELECT hops, sum(pairs)::BIGINT AS n FROM (SELECT apart AS hops, docs AS pairs FROM h WHERE apart > 0 UNION ALL SELECT apart + 1, docs * 7 FROM h) GROUP BY hops")
def _(spark, d):
    """How far apart the nodes of the chain graphs of all texts are."""
    return G.chains_hops(text_roots(spark, d), "doc_id", "n").groupBy("hops").agg(F.sum("pairs").alias("n"))


@query("grf3_chain_edges", f"WITH {_ROOTS}, e AS (SELECT doc_id, n, unnest(range(n)) AS src FROM r), x AS (SELECT doc_id, src, src + 1 AS dst FROM e WHERE src + 1 < n UNION ALL SELECT doc_id, src, n + src * 7 + l FROM e, range(7) t(l)) SELECT doc_id, count(*) AS n, sum(src * 3 + dst)::BIGINT AS total, max(dst) AS last FROM x GROUP BY doc_id")
def _(spark, d):
    """The edges of the chain graphs of all texts."""
    e = G.chains_edges(text_roots(spark, d), "doc_id", "n")
    return e.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("src") * 3 + F.col("dst")).alias("total"), F.max("dst").alias("last"))


@query("grf4_simple_edges", f"{SQL} SELECT least(head, tail) AS a, greatest(head, tail) AS b, max(relation_type) AS relation_type, count(*) AS parallel FROM relations GROUP BY 1, 2")
def _(spark, d):
    return G.simple_edges(star_kg(spark, d))


@query("grf6_degrees", f"{SQL}, p AS (SELECT DISTINCT least(head, tail) AS a, greatest(head, tail) AS b FROM relations WHERE head <> tail), x AS (SELECT a AS id FROM p UNION ALL SELECT b FROM p), g AS (SELECT e.id, count(x.id) AS degree FROM entities e LEFT JOIN x ON x.id = e.id GROUP BY e.id) SELECT id, degree, round(greatest(0.05, 0.1 + 0.15 * degree / greatest(max(degree) OVER (), 1)), 6) AS size FROM g")
def _(spark, d):
    return G.degrees(star_kg(spark, d))


@query("agg5_graph_statistics", f"{SQL}, p AS (SELECT DISTINCT least(head, tail) AS a, greatest(head, tail) AS b FROM relations WHERE head <> tail), n AS (SELECT count(*) AS nodes FROM entities), m AS (SELECT count(*) AS edges FROM p) SELECT nodes, edges, round(2.0 * edges / nodes, 6) AS mean_degree FROM n, m")
def _(spark, d):
    kg = star_kg(spark, d)
    g = G.degrees(kg).agg(F.count(F.lit(1)).alias("nodes"), (F.sum("degree") / 2).cast("long").alias("edges"), F.round(F.avg("degree"), 6).alias("mean_degree"))
    return g


_PARTS = f"p AS (SELECT DISTINCT least(head, tail) AS a, greatest(head, tail) AS b FROM relations WHERE head <> tail), y AS (SELECT a AS src, b AS dst FROM p UNION ALL SELECT b, a FROM p), w AS (SELECT id, id AS seen FROM entities WHERE label = 'REGION' UNION SELECT w.id, y.dst FROM w JOIN y ON y.src = w.seen), c AS (SELECT e.id, e.ord, coalesce(min(w.id), e.id) AS comp FROM entities e LEFT JOIN w ON w.seen = e.id GROUP BY e.id, e.ord)"
_STATISTICS = f"""SELECT 'num_entities' AS statistic, '' AS name, count(*)::DOUBLE AS value FROM entities UNION ALL SELECT 'num_relations', '', count(*) FROM relations UNION ALL SELECT 'entity_types', label, count(*) FROM entities GROUP BY label UNION ALL SELECT 'relation_types', relation_type, count(*) FROM relations GROUP BY relation_type
UNION ALL SELECT 'num_components', '', count(DISTINCT comp) FROM c UNION ALL SELECT 'is_connected', '', CASE WHEN count(DISTINCT comp) = 1 THEN 1 ELSE 0 END FROM c UNION ALL SELECT 'average_degree', '', round((SELECT 2.0::DOUBLE * count(*) FROM p) / (SELECT count(*) FROM entities), 6)"""


@query("agg5_full_statistics", f"{SQL}, {_PARTS} {_STATISTICS}")
def _(spark, d):
    """Counts, histograms of types, components and degree of the whole graph."""
    return A.statistics(star_kg(spark, d)).withColumn("value", F.round("value", 6))


_CONFIDENCES = " UNION ALL ".join(f"SELECT '{k}_confidence_{n}', '', round({f}(confidence), 6) FROM {t}" for k, t in (("entity", "entities"), ("relation", "relations")) for n, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))


@query("agg6_drawing_summary", f"{SQL}, {_PARTS} {_STATISTICS} UNION ALL {_CONFIDENCES}")
def _(spark, d):
    return A.drawing_summary(star_kg(spark, d)).withColumn("value", F.round("value", 6))


@query("agg23_component_clusters", f"{SQL}, {_PARTS}, g AS (SELECT comp, min(ord) AS first, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM c GROUP BY comp) SELECT 'component_' || row_number() OVER (ORDER BY first) AS cluster, n, first_id, last_id FROM g")
def _(spark, d):
    kg = star_kg(spark, d)
    return A.clusters(kg.entities, "connected_components", kg.relations)


@query("viz1_circular_layout", f"{SQL} SELECT id, round(cos(2*pi()*(row_number() OVER (PARTITION BY label ORDER BY ord) - 1) / count(*) OVER (PARTITION BY label)), 6) + 0 AS x, round(sin(2*pi()*(row_number() OVER (PARTITION BY label ORDER BY ord) - 1) / count(*) OVER (PARTITION BY label)), 6) + 0 AS y FROM entities")
def _(spark, d):
    return G.circular(star_kg(spark, d).entities, "label", "ord").select("id", (F.col("x") + 0).alias("x"), (F.col("y") + 0).alias("y"))


#: Hops from a region along all relations, either way; a BFS of distinct (node, hops) pairs.
_BFS = f"{SQL}, e AS ({ALL_EDGES} UNION SELECT tail, head FROM relations), w(id, l) AS (SELECT 'R:1', 0 UNION SELECT e.dst, l + 1 FROM w JOIN e ON e.src = w.id WHERE l < 9), l AS (SELECT id, min(l) AS l FROM w GROUP BY id)"


@query("viz1_rings", f"{_BFS} SELECT l::INTEGER AS ring, count(*) AS n FROM l GROUP BY l")
def _(spark, d):
    return G.rings(all_edges(spark, d), "R:1", 9).groupBy("ring").agg(F.count(F.lit(1)).alias("n"))


@query("viz1_bipartite_layout", f"{SQL}, p AS (SELECT DISTINCT least(head, tail) AS a, greatest(head, tail) AS b FROM relations WHERE head <> tail), x AS (SELECT a AS id FROM p UNION ALL SELECT b FROM p), g AS (SELECT e.id, count(x.id) AS d FROM entities e LEFT JOIN x ON x.id = e.id GROUP BY e.id), s AS (SELECT id, d > (SELECT median(d) FROM g) AS side FROM g), r AS (SELECT *, row_number() OVER (PARTITION BY side ORDER BY id) AS place, count(*) OVER (PARTITION BY side) AS n FROM s) SELECT id, side, CASE WHEN side THEN 1.0 ELSE -1.0 END::DOUBLE AS x, round(CASE WHEN n > 1 THEN 2.0::DOUBLE * (place - 1) / (n - 1) - 1.0 ELSE 0.0 END, 6) AS y FROM r")
def _(spark, d):
    return G.bipartite(star_kg(spark, d))


_LEVELS = f"{_BFS}, r AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY id) AS place, count(*) OVER (PARTITION BY l) AS n FROM l)"


@query("viz1_hierarchical_layout", f"{_LEVELS} SELECT id, l::INTEGER AS depth, round(CASE WHEN n > 1 THEN 2.0::DOUBLE * (place - 1) / (n - 1) - 1.0 ELSE 0.0 END, 6) AS x, (l * -0.5 + 0)::DOUBLE AS y FROM r")
def _(spark, d):
    return G.hierarchical(all_edges(spark, d), "R:1", 9)


@query("viz1_shell_layout", f"{_LEVELS} SELECT id, l::INTEGER AS ring, round(cos(2*pi()*(place - 1)/n) * 0.5 * l, 6) + 0 AS x, round(sin(2*pi()*(place - 1)/n) * 0.5 * l, 6) + 0 AS y FROM r")
def _(spark, d):
    return G.shells(all_edges(spark, d), "R:1", 9)


@query("viz1_spring_layout")
def _(spark, d):
    kg = star_kg(spark, d)
    n = kg.entities.where("label IN ('REGION', 'NATION')").withColumn("g", F.lit(0))
    return G.spring(n, all_edges(spark, d).where("src LIKE 'N:%'").withColumn("g", F.lit(0)), "g")


@query("viz1_spring_whole_graph")
def _(spark, d):
    """A few rounds of springs over the whole graph, whatever its size; tests hold the forces against exact ones."""
    return LY.spring(star_kg(spark, d).entities.select("id"), all_edges(spark, d), steps=3)


@query("viz1_stress_layout")
def _(spark, d):
    """Every node of the whole graph by its hops to sixteen pivots."""
    return LY.stress(star_kg(spark, d).entities.select("id"), all_edges(spark, d))


@query("viz2_type_colours", f"{SQL} SELECT id, CASE label WHEN 'REGION' THEN '#1f77b4' WHEN 'NATION' THEN '#2ca02c' ELSE '#7f7f7f' END AS colour FROM entities")
def _(spark, d):
    return star_kg(spark, d).entities.select("id", G.colour(F.col("label")).alias("colour"))


@query("viz3_recommendations", "SELECT n, CASE WHEN n < 10 THEN 'circular' WHEN n < 50 THEN 'spring' ELSE 'stress' END AS layout, CASE WHEN n > 1000 THEN 'high' WHEN n > 500 THEN 'medium' WHEN n > 100 THEN 'light' ELSE 'none' END AS simplification FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority UNION ALL SELECT count(*) FROM nation UNION ALL SELECT count(*) FROM region)")
def _(spark, d):
    n = F.count(F.lit(1)).alias("n")
    rows = table(spark, d, "orders").groupBy("o_orderpriority").agg(n).select("n").union(table(spark, d, "nation").agg(n)).union(table(spark, d, "region").agg(n))
    layout, simple = A.recommended(F.col("n"))
    return rows.select("n", layout.alias("layout"), simple.alias("simplification"))


@query("seed2_mock_links", f"{SQL} SELECT id, round(0.5::DOUBLE + (('0x' || md5(text)[1:15])::BIGINT % 46) / 100.0::DOUBLE, 6) AS score FROM entities")
def _(spark, d):
    """Scores of the stand-in linker for every name of the graph."""
    return star_kg(spark, d).entities.select("id", F.round(D.mock_link(F.col("text")), 6).alias("score"))


_MENTIONED = "(SELECT count(*) FROM documents WHERE contains(lower(text), t.head))"


def mentioned(spark, d, heads):
    """head, documents: how many texts hold each of heads."""
    from ..operators import phrases

    docs = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return phrases.contained(docs, heads, "doc_id", name="head").groupBy("head").agg(F.count(F.lit(1)).alias("documents"))


@query("seed3_mock_triples", "SELECT t.*, " + _MENTIONED + " AS documents FROM (VALUES " + ", ".join(str(r) for r in D.MOCK_TRIPLES).replace(")", "::DOUBLE)") + ", ('K', 'the', 'is', 'word', 0.5::DOUBLE)) t(head_kb_id, head, relation, tail, score)")
def _(spark, d):
    """The stand-in triples and one more, with the number of texts that hold their heads."""
    t = spark.createDataFrame([*D.MOCK_TRIPLES, ("K", "the", "is", "word", 0.5)], "head_kb_id string, head string, relation string, tail string, score double")
    return t.join(mentioned(spark, d, t.select("head")), "head", "left").select("head_kb_id", "head", "relation", "tail", "score", F.coalesce("documents", F.lit(0)).alias("documents"))


@query("seed7_chosen_sequences", f"{FOUND}, n AS (SELECT round_even(count(*) * 0.2, 0) AS k FROM documents), c AS (SELECT doc_id FROM documents, n QUALIFY row_number() OVER (ORDER BY doc_id) <= k) SELECT doc_id FROM c WHERE doc_id IN (SELECT doc_id FROM m WHERE type = 'TERM')")
def _(spark, d):
    return D.chosen_sequences(table(spark, d, "documents").select("doc_id"), "doc_id", 0.2, found(spark, d).where("type = 'TERM'"))


@query("seed8_injected_valid", f"{SEED} SELECT count(*) AS n, count_if(contains(lower(t), lower(head)) OR contains(lower(t), lower(tail))) AS valid FROM seed, (SELECT 'Shipped from China to EUROPE' AS t)")
def _(spark, d):
    ok = D.injected_valid(F.lit("Shipped from China to EUROPE"), F.col("head"), F.col("tail"))
    return seed(spark, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"))


TOKENS = "SELECT doc_id, unnest(range(least(len(w), 128))) AS spot, unnest(list_transform(w[1:128], lambda x: length(x) * 31 + unicode(x))) AS token FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents)"


def tokens(spark, d):
    w = F.slice(X.words("text"), 1, 128)
    return table(spark, d, "documents").select("doc_id", F.posexplode(F.transform(w, lambda x: (F.length(x) * 31 + F.ascii(x)).cast("long"))).alias("at", "token"))


def _draw(first: str, second: str, seed_: int) -> str:
    start = seed_ * 7717 + 12345
    return f"(((((({start} * 1103 + {first} * 7919 + 104729) % 1000003) * 1103 + {second} * 7919 + 104729) % 1000003) * 48271) % 1000003) / 1000003.0::DOUBLE"


WHOLE = "SELECT doc_id, unnest(range(len(w))) AS spot, unnest(list_transform(w, lambda x: length(x) * 31 + unicode(x))) AS token, len(w) AS n FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents)"


def whole_ids(spark, d):
    """doc_id, ids of every word of each text."""
    ids = F.transform(X.words("text"), lambda x: (F.length(x) * 31 + F.ascii(x)).cast("long"))
    return table(spark, d, "documents").select("doc_id", ids.alias("ids")).where(F.size("ids") > 0)


@query("trn2_masked_tokens", f"WITH t AS ({WHOLE}), c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {_draw('doc_id', 'spot', 0)}, spot) AS r FROM t), m AS (SELECT *, r <= greatest(1, round_even(n * 0.15::DOUBLE, 0)) AS chosen, {_draw('spot', 'doc_id', 1)} AS how, floor({_draw('doc_id', 'spot', 2)} * 30522)::BIGINT AS other FROM c) SELECT doc_id, count_if(chosen) AS chosen, count_if(chosen AND how < 0.8) AS masked, sum(CASE WHEN NOT chosen THEN token WHEN how < 0.8 THEN 103 WHEN how < 0.9 THEN other ELSE token END)::BIGINT AS total FROM m GROUP BY doc_id")
def _(spark, d):
    """Single words of whole texts, masked within the row."""
    m = MK.masked_texts(whole_ids(spark, d), "doc_id", "ids", "singles")
    return m.select("doc_id", F.size("starts").cast("long").alias("chosen"), F.size(F.filter(F.arrays_zip("input", "label"), lambda x: (x["label"] != T.IGNORE) & (x["input"] == T.MASK))).cast("long").alias("masked"), F.aggregate("input", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


_SPANS = f"""WITH t AS ({WHOLE}), n AS (SELECT DISTINCT doc_id, n, CAST(round_even(n * 0.15::DOUBLE, 0) AS BIGINT) AS target FROM t), j AS (SELECT doc_id, n, target, unnest(range(target)) AS j FROM n),
l AS (SELECT *, 1 + CAST(floor({_draw('doc_id', 'j', 5)} * 5) AS BIGINT) AS len FROM j), u AS (SELECT *, sum(len) OVER (PARTITION BY doc_id ORDER BY j) AS upto FROM l), k AS (SELECT doc_id, n, j, len - greatest(0, upto - n) AS len FROM u WHERE upto - len < target AND len - greatest(0, upto - n) > 0),
f AS (SELECT *, n - sum(len) OVER (PARTITION BY doc_id) AS free, sum(len) OVER (PARTITION BY doc_id ORDER BY j) - len AS before FROM k), p AS (SELECT *, CAST(floor({_draw('doc_id', 'j', 6)} * (free + 1)) AS BIGINT) AS place FROM f),
a AS (SELECT doc_id, j, len, before, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS r FROM p), b AS (SELECT doc_id, place, row_number() OVER (PARTITION BY doc_id ORDER BY place) AS r FROM p), s AS (SELECT a.doc_id, a.r, b.place + a.before AS start, a.len FROM a JOIN b USING (doc_id, r)),
x AS (SELECT doc_id, unnest(range(start::BIGINT, (start + len)::BIGINT)) AS spot FROM s), m AS (SELECT t.doc_id, t.spot, t.token, x.spot IS NOT NULL AS chosen, {_draw('t.spot', 't.doc_id', 7)} AS how, floor({_draw('t.doc_id', 't.spot', 8)} * 30522)::BIGINT AS other FROM t LEFT JOIN x ON x.doc_id = t.doc_id AND x.spot = t.spot)"""


@query("trn2_masked_spans", f"{_SPANS}, g AS (SELECT doc_id, string_agg(start || ':' || len, ',' ORDER BY r) AS spans FROM s GROUP BY doc_id) SELECT m.doc_id, md5(coalesce(any_value(g.spans), '')) AS spans, count_if(chosen) AS covered, sum(CASE WHEN NOT chosen THEN token WHEN how < 0.8 THEN 103 WHEN how < 0.9 THEN other ELSE token END)::BIGINT AS total, sum(CASE WHEN chosen THEN token ELSE -100 END)::BIGINT AS labels FROM m LEFT JOIN g ON g.doc_id = m.doc_id GROUP BY m.doc_id")
def _(spark, d):
    """Spans of one to five words of whole texts, masked within the row."""
    m = MK.masked_texts(whole_ids(spark, d), "doc_id", "ids", "spans", seed=5)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    spans = F.array_join(F.transform(F.arrays_zip("starts", "lengths"), lambda x: F.concat(x["starts"].cast("string"), F.lit(":"), x["lengths"].cast("string"))), ",")
    return m.select("doc_id", F.md5(spans).alias("spans"), add("lengths").alias("covered"), add("input").alias("total"), add("label").alias("labels"))


@query("grf5_chain_sequences", f"WITH t AS ({TOKENS}) SELECT doc_id, 1024::BIGINT AS length, sum(token)::BIGINT AS total, count(*) AS roots FROM t GROUP BY doc_id")
def _(spark, d):
    docs = table(spark, d, "documents").where(F.size(X.words("text")) > 0)
    ids = F.transform(X.words("text"), lambda x: (F.length(x) * 31 + F.ascii(x)).cast("long"))
    roots = G.chain(docs, "doc_id", ids)
    none = roots.limit(0).select("doc_id", "root_ix", F.lit(0).alias("ord"), F.lit("").alias("relation"), F.array(F.lit(0).cast("long")).alias("tail_tokens"))
    s = G.sequence(G.inject(roots, "doc_id", none), "doc_id")
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return s.select("doc_id", F.size("ids").cast("long").alias("length"), add("ids").alias("total"), add(F.transform("mask", lambda x: x.cast("long"))).alias("roots"))


@query("agg22_masked_accuracy", "SELECT count(*) AS n, round(avg(CASE WHEN l_partkey % 3 = l_suppkey % 3 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM lineitem WHERE l_linenumber = 1 AND l_suppkey % 5 <> 0")
def _(spark, d):
    li = table(spark, d, "lineitem")
    p = li.select((F.col("l_linenumber") == 1).cast("int").alias("mask"), F.when(F.col("l_suppkey") % 5 == 0, -100).otherwise(F.col("l_suppkey") % 3).alias("label"), (F.col("l_partkey") % 3).alias("pred"))
    return A.masked_accuracy(p)


@query("agg26_cross_entropy", "WITH x AS (SELECT vec_id % 64 AS label, embedding::DOUBLE[] AS z FROM embeddings WHERE vec_id % 7 <> 0) SELECT round(avg(ln(list_sum(list_transform(z, lambda v: exp(v)))) - z[label + 1]), 6) AS loss, count(*) AS n FROM x")
def _(spark, d):
    """The loss over whole vectors as logits; every seventh label is left out."""
    e = table(spark, d, "embeddings").select(F.when(F.col("vec_id") % 7 == 0, -100).otherwise(F.col("vec_id") % 64).alias("label"), F.col("embedding").cast("array<double>").alias("logits"))
    return A.cross_entropy(e)


@query("mth1_softmax", "SELECT vec_id, round(exp(embedding[1]::DOUBLE) / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE))), 6) AS p, round(list_max(list_transform(embedding, lambda v: exp(v::DOUBLE))) / list_sum(list_transform(embedding, lambda v: exp(v::DOUBLE))), 6) AS top, round(list_sum(list_transform(embedding, lambda v: 1/(1+exp(-v::DOUBLE)))), 5) AS s, round(list_sum(list_transform(embedding, lambda v: greatest(v::DOUBLE, 0))), 5) AS r FROM embeddings")
def _(spark, d):
    """Softmax, sigmoid and ramp of whole vectors."""
    e = table(spark, d, "embeddings").withColumn("v", F.col("embedding").cast("array<double>")).withColumn("p", M.softmax(F.col("v")))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return e.select("vec_id", F.round(F.col("p")[0], 6).alias("p"), F.round(F.array_max("p"), 6).alias("top"), F.round(add(F.transform("v", M.sigmoid)), 5).alias("s"), F.round(add(F.transform("v", M.relu)), 5).alias("r"))


_MASKS = "WITH n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), i AS (SELECT conv_id, n, unnest(range(n)) AS i FROM n), m AS (SELECT conv_id, i, j, CASE WHEN j <= i THEN exp(-0.6 * abs(i - j)) ELSE 0 END AS v FROM (SELECT conv_id, i, unnest(range(n)) AS j FROM i))"


def turn_counts(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


@query("mth2_decay_mask", f"{_MASKS} SELECT conv_id, i, round(max(v / s), 9) AS top FROM (SELECT conv_id, i, v, sum(v) OVER (PARTITION BY conv_id, i) AS s FROM m) GROUP BY conv_id, i")
def _(spark, d):
    """Causal masks over the turns of each conversation, their rows summing to one."""
    m = T.decay_masks(turn_counts(spark, d), "conv_id", "n", causal=True, normal=True)
    return m.groupBy("conv_id", "i").agg(F.round(F.max("v"), 9).alias("top"))


@query("agg19_attention_statistics", f"{_MASKS} SELECT count(*) AS n, count_if(v <> 0) AS nonzero, count_if(v = 0) AS zero, round(min(v), 9) AS least, round(max(v), 9) AS most, round(avg(v), 9) AS mean, round(stddev_samp(v), 9) AS std FROM m")
def _(spark, d):
    return A.attention_statistics(T.decay_masks(turn_counts(spark, d), "conv_id", "n", causal=True))


@query("mth3_graph_decay", "WITH RECURSIVE t AS (SELECT conv_id, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations), x AS (SELECT a.conv_id, a.i AS src, b.i AS dst FROM t a JOIN t b ON b.conv_id = a.conv_id AND (b.i = a.i + 1 OR (b.i = a.i + 2 AND b.role = a.role))), w(conv_id, src, dst, hops) AS (SELECT conv_id, src, dst, 1 FROM x UNION SELECT w.conv_id, w.src, x.dst, hops + 1 FROM w JOIN x ON x.conv_id = w.conv_id AND x.src = w.dst), p AS (SELECT conv_id, src, dst, min(hops) AS hops FROM w GROUP BY ALL) SELECT conv_id, src, round(sum(exp(-0.6 * hops)), 6) AS total FROM p GROUP BY conv_id, src")
def _(spark, d):
    """What each turn of a conversation hears of those that it leads to, by the length of the way."""
    from ..operators import paths
    from .model_queries import turn_edges

    hops = paths.closure(turn_edges(spark, d), ["conv_id"])
    return hops.groupBy("conv_id", "src").agg(F.round(F.sum(T.decay(F.col("hops"))), 6).alias("total"))


@query("map1_nested_config", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, coalesce(CAST(json_extract(props, '$.missing') AS INTEGER), -1) AS missing FROM events")
def _(spark, d):
    v = F.parse_json("props")
    return table(spark, d, "events").select("event_id", F.variant_get(v, "$.k", "int").alias("k"), F.coalesce(F.try_variant_get(v, "$.missing", "int"), F.lit(-1)).alias("missing"))


@query("jsn1_request_bodies", "SELECT o_orderkey, '{\"id\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS body, array_to_string(list_filter(['id', 'status', 'note'], lambda x: x NOT IN ('id', 'status')), ',') AS missing FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status")))
    missing = F.array_except(F.array(*map(F.lit, ("id", "status", "note"))), F.json_object_keys(body))
    return o.select("o_orderkey", body.alias("body"), F.array_join(missing, ",").alias("missing"))


@query("dat1_timestamps", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS stamp, 'checkpoint_epoch' || (event_id % 7) || '_step' || event_id AS name FROM events")
def _(spark, d):
    return table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("stamp"), F.format_string("checkpoint_epoch%d_step%d", F.col("event_id") % 7, F.col("event_id")).alias("name"))


@query("str1_rate_windows", "SELECT epoch(time_bucket(INTERVAL '60 seconds', ts))::BIGINT AS window_start, count(*) AS n, round(sum(value), 4) AS budget FROM events GROUP BY 1")
def _(spark, d):
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    g = e.groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("budget"))
    return g.select(F.unix_timestamp("w.start").alias("window_start"), "n", "budget")


@query("str3_running_totals", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY event_id) AS done, max(value) OVER (PARTITION BY user_id ORDER BY event_id) AS peak FROM events")
def _(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, d, "events").select("event_id", F.count(F.lit(1)).over(w).alias("done"), F.max("value").over(w).alias("peak"))


@query("src9_article_projection", "SELECT page_id, concat_ws(' ', nullif(t, ''), nullif(url, '')) AS body FROM (SELECT page_id, url, regexp_extract(html, '<title>([^<]*)</title>', 1) AS t FROM pages)")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", clients.article_text(clients.page_title("html"), F.col("url")).alias("body"))


@query("src11_label_lookup", f"{SQL} SELECT id, CASE WHEN label = 'NATION' THEN upper(text) ELSE '' END AS name FROM entities WHERE label IN ('NATION', 'REGION')")
def _(spark, d):
    e = star_kg(spark, d).entities.where("label IN ('NATION', 'REGION')")
    return places_base(spark, d).items(e.select(F.col("id").alias("kb_id"))).select(F.col("kb_id").alias("id"), F.col("label").alias("name"))


def places_base(spark, d):
    """Nations and regions as a knowledge base: nations have an English label, regions a German one."""
    kg = star_kg(spark, d)
    c = kg.entities.where("label IN ('NATION', 'REGION')")
    labels = F.when(F.col("label") == "NATION", F.create_map(F.lit("en"), F.upper("text"))).otherwise(F.create_map(F.lit("de"), F.col("text")))
    r = kg.relations.where("relation_type = 'PART_OF'").select(F.col("head").alias("src_kb_id"), F.lit("P361").alias("relation_name"), F.col("tail").alias("dst_kb_id"))
    return KnowledgeBase(c.select(F.col("id").alias("kb_id"), F.col("text").alias("name"), F.array("label").alias("types"), labels.alias("labels")), r)


@query("src10_linked_mentions", f"{SQL}, q AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN lower(n_name) ELSE 'nowhere' END AS text FROM supplier JOIN nation ON n_nationkey = s_nationkey) SELECT k, min(id) AS kb_id, CASE WHEN min(id) IS NULL THEN 0 ELSE 1 END AS types FROM q LEFT JOIN (SELECT * FROM entities WHERE label IN ('NATION', 'REGION')) e ON lower(e.text) = q.text GROUP BY k, q.text")
def _(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    q = table(spark, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("k"), F.when(F.col("s_suppkey") % 2 == 0, F.lower("n_name")).otherwise("nowhere").alias("text"))
    return places_base(spark, d).link(q).select("k", "kb_id", F.size("types").alias("types"))


@query("src10_relations_of", f"{SQL} SELECT head AS src_kb_id, 'P361' AS relation_name, tail AS dst_kb_id FROM relations WHERE relation_type = 'PART_OF' AND head IN ('N:1', 'N:2', 'N:24')")
def _(spark, d):
    ids = spark.createDataFrame([("N:1",), ("N:2",), ("N:24",), ("N:24",), ("X",)], "kb_id string")
    return places_base(spark, d).relations_of(ids).select("src_kb_id", "relation_name", "dst_kb_id")


@query("src11_search", f"{SQL} SELECT id AS kb_id, text AS name, round(3.0::DOUBLE / length(text), 6) AS score FROM entities WHERE label IN ('NATION', 'REGION') AND contains(lower(text), 'ina') ORDER BY score DESC, id LIMIT 10")
def _(spark, d):
    return places_base(spark, d).search("INA")


@query("src8_offline_articles", "SELECT n_name AS query, 'no transport' AS error FROM nation")
def _(spark, d):
    """Without a transport every query says so; tests/test_clients.py searches through one."""
    return clients.search_articles(table(spark, d, "nation").select(F.col("n_name").alias("query"))).select("query", "error")


@query("src7_sample_triples", "SELECT t.*, " + _MENTIONED + " AS documents FROM (VALUES ('diabetes', 'C0011849', 'treats', 'metformin', 2, 0.95::DOUBLE), ('metformin', 'C0025598', 'inhibits', 'diabetes', 2, 0.92::DOUBLE)) t(head, head_kb_id, relation, tail, tokens, score)")
def _(spark, d):
    """The sample triples, with the number of texts that hold their heads."""
    t = files.sample_triples(spark).select("head", "head_kb_id", "relation", "tail", F.size("tail_tokens").alias("tokens"), "score")
    return t.join(mentioned(spark, d, t.select("head")), "head", "left").select(*t.columns, F.coalesce("documents", F.lit(0)).alias("documents"))


from . import sink_queries  # noqa: E402,F401
