"""Queries for graph filters, joins, merges and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..kg import KG, SQL, star_kg, table
from ..operators import aggregates as A
from ..operators import filters as L
from ..operators import joins as J
from ..operators import sets as S
from ..operators.lineage import small_batches
from .registry import query

ENT = "id, text, label, confidence"
REL = "head, relation_type, tail, confidence"


def both(kg: KG) -> DataFrame:
    """A graph as one table of its nodes and edges."""
    e = kg.entities.select(F.lit("entity").alias("kind"), F.col("id").alias("a"), F.col("label").alias("type"), F.lit("").alias("b"), "confidence")
    return e.unionByName(kg.relations.select(F.lit("relation").alias("kind"), F.col("head").alias("a"), F.col("relation_type").alias("type"), F.col("tail").alias("b"), "confidence"))


def both_sql(entities: str, relations: str, start: str = SQL) -> str:
    return f"{start} SELECT 'entity' AS kind, id AS a, label AS type, '' AS b, confidence FROM ({entities}) UNION ALL SELECT 'relation', head, relation_type, tail, confidence FROM ({relations})"


@query("src1_kg_triples_source", both_sql("SELECT * FROM entities", "SELECT * FROM relations"))
def _(spark, d):
    return both(star_kg(spark, d))


@query("flt1_filter_by_confidence", both_sql("SELECT * FROM entities WHERE confidence >= 0.8", "SELECT * FROM relations WHERE confidence >= 0.8"))
def _(spark, d):
    return both(L.by_confidence(star_kg(spark, d), 0.8))


@query("flt2_induced_by_type", both_sql("SELECT * FROM entities WHERE label IN ('NATION','SUPPLIER')", "SELECT r.* FROM relations r JOIN entities h ON h.id = r.head AND h.label IN ('NATION','SUPPLIER') JOIN entities t ON t.id = r.tail AND t.label IN ('NATION','SUPPLIER')"))
def _(spark, d):
    return both(L.by_entity_type(star_kg(spark, d), ["NATION", "SUPPLIER"]))


@query("flt3_entities_by_type", both_sql("SELECT * FROM entities WHERE label = 'PART'", "SELECT * FROM relations"))
def _(spark, d):
    return both(L.by_entity_type(star_kg(spark, d), ["PART"], induce=False))


@query("flt4_by_relation_type", both_sql("SELECT * FROM entities WHERE id IN (SELECT head FROM relations WHERE relation_type='SUPPLIES' UNION SELECT tail FROM relations WHERE relation_type='SUPPLIES')", "SELECT * FROM relations WHERE relation_type='SUPPLIES'"))
def _(spark, d):
    return both(L.by_relation_type(star_kg(spark, d), ["SUPPLIES"]))


@query("flt5_filter_knowledge_graph", both_sql("SELECT * FROM entities WHERE confidence >= 0.3 AND label IN ('CUSTOMER','PART')", "SELECT * FROM relations WHERE confidence >= 0.3 AND relation_type IN ('ORDERED','LOCATED_IN') AND head IN (SELECT id FROM entities WHERE confidence >= 0.3 AND label IN ('CUSTOMER','PART')) AND tail IN (SELECT id FROM entities WHERE confidence >= 0.3 AND label IN ('CUSTOMER','PART'))"))
def _(spark, d):
    return both(L.filter_graph(star_kg(spark, d), 0.3, ["CUSTOMER", "PART"], ["ORDERED", "LOCATED_IN"]))


CLEAN = "SELECT * FROM relations WHERE confidence >= 0.5 AND provenance IS NOT NULL"


@query("flt6_clean_kg", both_sql(f"SELECT * FROM entities WHERE id IN (SELECT head FROM ({CLEAN}) UNION SELECT tail FROM ({CLEAN}))", CLEAN))
def _(spark, d):
    return both(L.clean(star_kg(spark, d), 0.5, True))


@query("flt6_clean_contradictions", f"{SQL}, x AS (SELECT head, tail, CASE WHEN confidence < 0.5 THEN 'TREATS' ELSE 'CAUSES' END AS relation_type, confidence FROM relations UNION ALL SELECT head, tail, 'CAUSES', 0.5 FROM relations WHERE relation_type = 'SUPPLIES') SELECT {REL} FROM x a WHERE NOT EXISTS (SELECT 1 FROM x b WHERE a.head = b.head AND a.tail = b.tail AND a.relation_type <> b.relation_type AND (b.confidence > a.confidence OR b.confidence = a.confidence AND b.relation_type < a.relation_type))")
def _(spark, d):
    r = star_kg(spark, d).relations
    x = r.select("head", "tail", F.when(F.col("confidence") < 0.5, "TREATS").otherwise("CAUSES").alias("relation_type"), "confidence")
    x = x.unionByName(r.where("relation_type = 'SUPPLIES'").select("head", "tail", F.lit("CAUSES").alias("relation_type"), F.lit(0.5).alias("confidence")))
    return L.contradictions(x, [("TREATS", "CAUSES")]).select("head", "relation_type", "tail", "confidence")


@query("flt7_create_subgraph", both_sql("SELECT * FROM entities WHERE ord % 10 = 0", "SELECT r.* FROM relations r JOIN entities h ON h.id=r.head AND h.ord % 10=0 JOIN entities t ON t.id=r.tail AND t.ord % 10=0"))
def _(spark, d):
    kg = star_kg(spark, d)
    return both(L.subgraph(kg, kg.entities.where("ord % 10 = 0").select("id")))


@query("flt8_user_filter", both_sql("SELECT * FROM entities WHERE text LIKE '%1%'", "SELECT * FROM relations WHERE head <> tail AND confidence < 0.1"))
def _(spark, d):
    return both(L.apply(star_kg(spark, d), lambda kg: KG(kg.entities.where(F.col("text").contains("1")), kg.relations.where("head <> tail AND confidence < 0.1"))))


TRIPLES = "SELECT r.head, h.text AS head_text, h.label AS head_label, h.kb_id AS head_kb, r.relation_type, r.tail, t.text AS tail_text, t.label AS tail_label, t.kb_id AS tail_kb, r.confidence FROM relations r JOIN entities h ON h.id=r.head JOIN entities t ON t.id=r.tail"
TCOLS = ["head", "head_text", "head_label", "relation_type", "tail", "tail_text", "tail_label", "confidence"]


@query("flt9_triples_by_confidence", f"{SQL} SELECT {', '.join(TCOLS)} FROM ({TRIPLES}) WHERE confidence >= 0.7 AND head <> tail")
def _(spark, d):
    return J.triples(star_kg(spark, d)).where("confidence >= 0.7 AND head <> tail").select(*TCOLS)


@query("flt9_literal_cross_product", f"{SQL}, e AS (SELECT * FROM entities WHERE label IN ('REGION','NATION')), r AS (SELECT * FROM relations WHERE relation_type='PART_OF' AND confidence >= 0.5) SELECT r.head || r.tail AS rel, a.id AS h, b.id AS t FROM e a, r, e b WHERE a.id <> b.id")
def _(spark, d):
    kg = star_kg(spark, d)
    e = kg.entities.where("label IN ('REGION','NATION')")  # 30 rows whatever the scale
    r = kg.relations.where("relation_type = 'PART_OF' AND confidence >= 0.5")
    return r.select(F.concat("head", "tail").alias("rel")).crossJoin(e.select(F.col("id").alias("h"))).crossJoin(e.select(F.col("id").alias("t"))).where("h <> t")


@query("flt10_reply_lines", "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT doc_id, trim(line) AS t FROM l) SELECT doc_id, count(*) AS lines, sum(length(t))::BIGINT AS chars FROM t WHERE t <> '' AND NOT starts_with(t, '#') AND NOT starts_with(t, 'Extracted') AND NOT starts_with(t, 'Entities') GROUP BY doc_id")
def _(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).where(L.line_ok(F.col("line")))
    return lines.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length(F.trim("line"))).alias("chars"))


@query("flt11_validate_graph", f"{SQL}, e AS (SELECT id FROM entities WHERE ord % 50 <> 0 UNION ALL SELECT id FROM entities WHERE label='REGION'), r AS (SELECT * FROM relations UNION ALL SELECT id, 'LOOP', id, 0.0, NULL FROM entities WHERE label='NATION') SELECT 'repeated id' AS kind, id FROM e GROUP BY id HAVING count(*)>1 UNION ALL SELECT 'unknown end', x FROM (SELECT head AS x FROM r UNION SELECT tail FROM r) WHERE x NOT IN (SELECT id FROM e) UNION ALL SELECT 'loop', head FROM r WHERE head=tail")
def _(spark, d):
    kg = star_kg(spark, d)
    e = kg.entities.where("ord % 50 <> 0").unionByName(kg.entities.where("label = 'REGION'"))
    loops = kg.entities.where("label = 'NATION'").select(F.col("id").alias("head"), F.lit("LOOP").alias("relation_type"), F.col("id").alias("tail"), F.lit(0.0).alias("confidence"), F.lit(None).cast("string").alias("provenance"))
    return L.violations(KG(e, kg.relations.unionByName(loops)))


@query("flt12_valid_positions", "SELECT o_orderkey, list_filter(list_transform([o_orderkey % 5, o_custkey % 4, o_orderkey % 7], lambda t, i: CASE WHEN t NOT IN (0,1,2,3) THEN i END), lambda x: x IS NOT NULL) AS p FROM orders".replace("SELECT o_orderkey, list", "SELECT o_orderkey, array_to_string(list").replace(") AS p", "), ',') AS p"))
def _(spark, d):
    o = table(spark, d, "orders")
    tokens = F.array(F.col("o_orderkey") % 5, F.col("o_custkey") % 4, F.col("o_orderkey") % 7)
    return o.select("o_orderkey", F.array_join(F.transform(L.valid_positions(tokens), lambda x: x.cast("string")), ",").alias("p"))


_SPAN = r"\p{Lu}\p{Ll}+(?: \p{L}+){0,2}"


@query("flt13_overlap_dedup", f"""WITH RECURSIVE f AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(text, '{_SPAN}', 0))) AS t, text AS whole FROM documents), a AS (SELECT doc_id, instr(whole, t) AS start, instr(whole, t) + length(t) - 1 AS stop, t FROM f),
b AS (SELECT * FROM a UNION ALL SELECT doc_id, start + 3, stop + 3, t FROM a), o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, t) AS r FROM b),
w AS (SELECT doc_id, 0::BIGINT AS r, []::STRUCT(start BIGINT, stop BIGINT, t VARCHAR)[] AS kept FROM (SELECT DISTINCT doc_id FROM o)
UNION ALL SELECT w.doc_id, o.r, CASE WHEN len(list_filter(kept, lambda k: least(k.stop, o.stop) > greatest(k.start, o.start) AND (least(k.stop, o.stop) - greatest(k.start, o.start) + 1) / (o.stop - o.start + 1) > 0.5)) > 0 THEN kept ELSE list_append(kept, {{'start': o.start, 'stop': o.stop, 't': o.t}}) END FROM w JOIN o ON o.doc_id = w.doc_id AND o.r = w.r + 1)
SELECT doc_id, k.start::INTEGER AS start, k.stop::INTEGER AS stop, k.t AS text FROM (SELECT doc_id, unnest(kept) AS k FROM (SELECT doc_id, max_by(kept, r) AS kept FROM w GROUP BY doc_id))""")
def _(spark, d):
    small_batches(spark)
    docs = table(spark, d, "documents").select("doc_id", F.explode(X.spans("text", r"\p{Lu}\p{Ll}+(?: \p{L}+){0,2}")).alias("s"))
    moved = F.struct((F.col("s.start") + 3).alias("start"), (F.col("s.stop") + 3).alias("stop"), "s.text")
    shifted = docs.select("doc_id", F.explode(F.array("s", moved)).alias("s")).select("doc_id", "s.*")
    return L.without_overlaps(shifted, "doc_id")


@query("join1_triples", f"{SQL} SELECT {', '.join(TCOLS)} FROM ({TRIPLES})")
def _(spark, d):
    return J.triples(star_kg(spark, d)).select(*TCOLS)


@query("join2_endpoint_numbers", f"{SQL}, e AS (SELECT * FROM entities WHERE ord % 4 <> 0) SELECT head, relation_type, tail, coalesce(h.ord + 1, 0) AS head_no, coalesce(t.ord + 1, 0) AS tail_no FROM relations LEFT JOIN e h ON h.id=head LEFT JOIN e t ON t.id=tail")
def _(spark, d):
    kg = star_kg(spark, d)
    return J.resolved(KG(kg.entities.where("ord % 4 <> 0"), kg.relations)).select("head", "relation_type", "tail", "head_no", "tail_no")


@query("join3_triples_from_relations", f"{SQL}, e AS (SELECT * FROM entities WHERE ord % 4 <> 0) SELECT head, h.text AS head_text, relation_type, coalesce(t.text, tail) AS tail_text, r.confidence FROM relations r JOIN e h ON h.id=head LEFT JOIN e t ON t.id=tail")
def _(spark, d):
    kg = star_kg(spark, d)
    return J.triples(KG(kg.entities.where("ord % 4 <> 0"), kg.relations), inner_tail=False).select("head", "head_text", "relation_type", "tail_text", "confidence")


@query("join4_new_tail_entities", f"{SQL}, e AS (SELECT * FROM entities WHERE ord % 4 <> 0), x AS (SELECT DISTINCT t.text FROM relations r JOIN entities t ON t.id = r.tail WHERE t.text NOT IN (SELECT text FROM e)) SELECT 'tail_' || md5(text) AS id, text, 'UNKNOWN' AS label FROM x")
def _(spark, d):
    kg = star_kg(spark, d)
    return J.new_tails(kg.entities.where("ord % 4 <> 0"), J.triples(kg))


@query("join4_segment_provenance", f"{SQL} SELECT head, relation_type, tail, 'doc_1#' || row_number() OVER (PARTITION BY head ORDER BY relation_type, tail) AS segment FROM relations")
def _(spark, d):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("head").orderBy("relation_type", "tail"))
    return star_kg(spark, d).relations.select("head", "relation_type", "tail", F.concat(F.lit("doc_1#"), n.cast("string")).alias("segment"))


@query("join9_seed_semi_join", f"{SQL} SELECT head, relation_type, tail FROM ({TRIPLES}) x WHERE head_kb IN (SELECT kb_id FROM entities WHERE kb_id IS NOT NULL AND confidence > 0.5)")
def _(spark, d):
    kg = star_kg(spark, d)
    seed = J.triples(kg).withColumnRenamed("head_kb", "head_kb_id")
    return J.semi(seed, kg.entities.where("kb_id IS NOT NULL AND confidence > 0.5")).select("head", "relation_type", "tail")


@query("join12_reference_facts", f"{SQL} SELECT head, relation_type, tail, length(head) % 2 = 0 AND right(tail, 1) <> '3' AS correct FROM relations")
def _(spark, d):
    r = star_kg(spark, d).relations
    gold = r.where((F.length("head") % 2 == 0) & ~F.col("tail").endswith("3"))
    return J.in_reference(r, gold).select("head", "relation_type", "tail", "correct")


def document_words(spark, d) -> DataFrame:
    """name: the distinct words of all documents."""
    return table(spark, d, "documents").select(F.explode(F.array_distinct(F.split("text", " "))).alias("name")).distinct()


@query("join13_matched_questions", "WITH q AS (SELECT DISTINCT item_id, lower(text) AS t FROM benchmark), n AS (SELECT DISTINCT lower(w) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '\\p{L}{4,}')) SELECT DISTINCT item_id FROM q JOIN n ON contains(t, n)")
def _(spark, d):
    names = document_words(spark, d).where(F.col("name").rlike(r"^\p{L}{4,}\z"))
    return J.matched_questions(table(spark, d, "benchmark").select("item_id", "text").distinct(), names, "text").select("item_id")


@query("join14_both_ends_linked", f"{SQL} SELECT head, relation_type, tail, head_kb, tail_kb FROM ({TRIPLES}) WHERE head_kb IS NOT NULL AND tail_kb IS NOT NULL")
def _(spark, d):
    return J.both_linked(star_kg(spark, d)).select("head", "relation_type", "tail", "head_kb", "tail_kb")


@query("join18_text_edges", f"{SQL}, f AS (SELECT text, min(ord) AS no FROM entities GROUP BY text) SELECT h.no AS src, t.no AS dst FROM ({TRIPLES}) x JOIN f h ON h.text = head_text JOIN f t ON t.text = tail_text")
def _(spark, d):
    return J.text_edges(star_kg(spark, d))


@query("join20_incident_relations", f"{SQL} SELECT {REL} FROM relations WHERE head='N:3' OR tail='N:3'")
def _(spark, d):
    return J.incident(star_kg(spark, d), "N:3").select("head", "relation_type", "tail", "confidence")


@query("agg1_type_counts", f"{SQL} SELECT 'entity' AS kind, label AS type, count(*) AS n FROM entities GROUP BY label UNION ALL SELECT 'relation', relation_type, count(*) FROM relations GROUP BY relation_type")
def _(spark, d):
    return A.type_counts(star_kg(spark, d))


@query("agg2_average_confidence", f"{SQL}, s AS (SELECT id AS k, confidence FROM entities UNION ALL SELECT head || '-' || tail || '-' || relation_type, confidence FROM relations) SELECT coalesce(round(avg(confidence), 6), 0) AS mean FROM (SELECT k, max(confidence) AS confidence FROM s GROUP BY k)")
def _(spark, d):
    return A.average_confidence(star_kg(spark, d))


@query("agg3_analyze_graph", f"{SQL}, e AS (SELECT count(*) AS entities, round(avg(confidence),6) AS e_avg, min(confidence) AS e_min, max(confidence) AS e_max, round(count(kb_id)/count(*),6) AS coverage FROM entities), r AS (SELECT count(*) AS relations, round(avg(confidence),6) AS r_avg, min(confidence) AS r_min, max(confidence) AS r_max FROM relations) SELECT * FROM e, r")
def _(spark, d):
    return A.analysis(star_kg(spark, d))


@query("agg4_graph_metrics", f"""{SQL}, a AS (SELECT DISTINCT head, tail FROM relations), n AS (SELECT count(*) AS nodes FROM entities), o AS (SELECT id, count(tail) AS d FROM entities LEFT JOIN a ON head=id GROUP BY id), i AS (SELECT id, count(head) AS d FROM entities LEFT JOIN a ON tail=id GROUP BY id)
SELECT nodes, (SELECT count(*) FROM a) AS edges, round((SELECT count(*) FROM relations) / (nodes * (nodes - 1) / 2.0), 12) AS density, (SELECT count(*) FROM a WHERE head=tail) AS loops, (SELECT count(*) FROM a x JOIN a y ON x.head=y.tail AND x.tail=y.head) AS mutual,
(SELECT round(avg(d),6) FROM o) AS avg_out, (SELECT max(d) FROM o) AS max_out, (SELECT round(avg(d),6) FROM i) AS avg_in, (SELECT max(d) FROM i) AS max_in FROM n""")
def _(spark, d):
    return A.graph_metrics(star_kg(spark, d))


@query("agg6_visual_summary", f"{SQL}, e AS (SELECT count(*) AS nodes, round(avg(confidence),6) AS mean, round(stddev_samp(confidence),6) AS std, min(confidence) AS least, max(confidence) AS most FROM entities) SELECT *, CASE WHEN nodes < 10 THEN 'circular' ELSE 'stress' END AS layout, CASE WHEN nodes > 1000 THEN 'high' WHEN nodes > 500 THEN 'medium' WHEN nodes > 100 THEN 'light' ELSE 'none' END AS simplification FROM e")
def _(spark, d):
    return A.visual_summary(star_kg(spark, d).entities)


@query("agg7_domain_metrics", f"{SQL}, t AS (SELECT label, count(*) AS n, count(kb_id) AS linked, count(DISTINCT kb_id) AS kb_ids, round(avg(confidence),6) AS mean FROM entities GROUP BY label) SELECT label, n, linked, kb_ids, mean, round(100.0 * n / sum(n) OVER (), 6) AS percent FROM t")
def _(spark, d):
    return A.domain_metrics(star_kg(spark, d).entities)


@query("agg7_connected_entities", f"{SQL} SELECT label, count(*) AS n FROM entities WHERE id IN (SELECT head FROM relations WHERE confidence > 0.9 UNION SELECT tail FROM relations WHERE confidence > 0.9) GROUP BY label")
def _(spark, d):
    kg = star_kg(spark, d)
    return L.touched(kg.entities, kg.relations.where("confidence > 0.9")).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("agg8_high_confidence_links", f"{SQL} SELECT label, count_if(kb_id IS NOT NULL AND confidence > 0.7) AS high, round(count_if(kb_id IS NOT NULL AND confidence > 0.7) / count(*), 6) AS share FROM entities GROUP BY label")
def _(spark, d):
    high = F.count_if(F.col("kb_id").isNotNull() & (F.col("confidence") > 0.7))
    return star_kg(spark, d).entities.groupBy("label").agg(high.alias("high"), F.round(high / F.count(F.lit(1)), 6).alias("share"))


@query("agg10_factuality", f"{SQL}, x AS (SELECT relation_type, length(head) % 2 = 0 AS ok FROM relations) SELECT relation_type, count(*) AS total, count_if(ok) AS correct, round(count_if(ok)/count(*), 6) AS score FROM x GROUP BY relation_type")
def _(spark, d):
    r = star_kg(spark, d).relations
    return A.factuality(J.in_reference(r, r.where(F.length("head") % 2 == 0)), ["relation_type"])


@query("agg12_code_set_scores", f"{SQL}, k AS (SELECT DISTINCT kb_id AS c FROM entities WHERE kb_id IS NOT NULL AND ord % 2 = 0), b AS (SELECT DISTINCT kb_id AS c FROM entities WHERE kb_id IS NOT NULL AND confidence > 0.4), s AS (SELECT count(*) FILTER (k.c IS NOT NULL AND b.c IS NOT NULL) AS tp, count(*) FILTER (b.c IS NULL) AS fp, count(*) FILTER (k.c IS NULL) AS fn FROM k FULL JOIN b ON k.c=b.c) SELECT tp, fp, fn, round(tp/(tp+fp+1e-8), 6) AS prec, round(tp/(tp+fn+1e-8), 6) AS rec, round((tp+fp)/(tp+fn), 6) AS coverage FROM s")
def _(spark, d):
    e = star_kg(spark, d).entities.where("kb_id IS NOT NULL")
    return A.code_scores(e.where("ord % 2 = 0").select(F.col("kb_id").alias("code")), e.where("confidence > 0.4").select(F.col("kb_id").alias("code")))


@query("agg15_precision_recall", f"{SQL}, x AS (SELECT head, relation_type, tail FROM relations WHERE confidence >= 0.5), g AS (SELECT head, relation_type, tail FROM relations WHERE length(tail) % 2 = 1), p AS (SELECT count(*) AS n, count_if((head, relation_type, tail) IN (SELECT (head, relation_type, tail) FROM g)) AS hit FROM x), q AS (SELECT count(*) AS n, count_if((head, relation_type, tail) IN (SELECT (head, relation_type, tail) FROM x)) AS hit FROM g), s AS (SELECT p.hit/p.n AS pr, q.hit/q.n AS re FROM p, q) SELECT round(pr,6) AS prec, round(re,6) AS rec, round(2*pr*re/(pr+re),6) AS f1 FROM s")
def _(spark, d):
    r = star_kg(spark, d).relations.select("head", "relation_type", "tail", "confidence")
    return A.precision_recall(r.where("confidence >= 0.5"), r.where(F.length("tail") % 2 == 1), ["head", "relation_type", "tail"])


@query("agg16_fact_capture", f"{SQL}, g AS (SELECT head, relation_type, tail FROM relations WHERE length(tail) % 2 = 1) SELECT round(count_if((head, relation_type, tail) IN (SELECT (head, relation_type, tail) FROM relations WHERE confidence >= 0.5))/count(*), 6) AS captured FROM g")
def _(spark, d):
    r = star_kg(spark, d).relations
    return A.capture_rate(r.where("confidence >= 0.5"), r.where(F.length("tail") % 2 == 1), ["head", "relation_type", "tail"])


@query("agg17_confidence_ratio", f"{SQL}, x AS (SELECT confidence, length(head) % 2 = 0 AS ok FROM relations), s AS (SELECT avg(confidence) FILTER (ok) AS c, avg(confidence) FILTER (NOT ok) AS w FROM x) SELECT round(CASE WHEN c IS NULL OR w IS NULL THEN 0.5 ELSE least(1, greatest(0, c/(c+w+1e-10))) END, 6) AS auc FROM s")
def _(spark, d):
    return A.confidence_ratio(star_kg(spark, d).relations.withColumn("correct", F.length("head") % 2 == 0))


@query("agg20_operation_summary", "SELECT event_type AS op, count(*) AS n, round(avg(value),6) AS mean, min(value) AS least, max(value) AS most, round(stddev_samp(value),6) AS std FROM events GROUP BY event_type")
def _(spark, d):
    return A.summary(table(spark, d, "events").withColumnRenamed("event_type", "op"), "op", "value")


@query("agg21_partial_and_final", "SELECT count(*) AS docs, sum(length(text))::BIGINT AS chars FROM documents")
def _(spark, d):
    return A.partial_and_final(table(spark, d, "documents"))


@query("agg23_entity_clusters", f"{SQL} SELECT 'conf_' || (floor(confidence*10)/10) AS cluster, count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM entities GROUP BY 1")
def _(spark, d):
    return A.clusters(star_kg(spark, d).entities, "confidence_bins")


@query("agg24_best_triple_per_id", f"{SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY head_kb ORDER BY confidence DESC, head, relation_type, tail) AS r FROM ({TRIPLES}) WHERE head_kb IS NOT NULL) SELECT head_kb, head, relation_type, tail, confidence FROM x WHERE r = 1 AND confidence >= 0.7")
def _(spark, d):
    return A.best_per(J.triples(star_kg(spark, d)).where("head_kb IS NOT NULL"), ["head_kb"], "confidence", ["head", "relation_type", "tail"], 0.7).select("head_kb", "head", "relation_type", "tail", "confidence")


@query("agg25_max_score_dedup", f"{SQL}, x AS (SELECT head_label, relation_type, tail_text, max(confidence) AS confidence FROM ({TRIPLES}) GROUP BY ALL) SELECT * FROM x")
def _(spark, d):
    return J.triples(star_kg(spark, d)).groupBy("head_label", "relation_type", "tail_text").agg(F.max("confidence").alias("confidence"))


@query("set1_merge_union", f"{SQL}, r AS (SELECT * FROM relations WHERE confidence < 0.3 UNION ALL SELECT * FROM relations WHERE confidence < 0.6) SELECT relation_type, count(*) AS n, round(sum(confidence),6) AS total FROM r GROUP BY relation_type")
def _(spark, d):
    kg = star_kg(spark, d)
    merged = S.merge([L.by_confidence(kg, 0).transform(lambda g: KG(g.entities, g.relations.where(F.col("confidence") < c))) for c in (0.3, 0.6)])
    return merged.relations.groupBy("relation_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("confidence"), 6).alias("total"))


@query("set1_merge_intersection", f"{SQL} SELECT head, relation_type, tail FROM relations WHERE confidence < 0.6 AND confidence >= 0.3")
def _(spark, d):
    kg = star_kg(spark, d)
    return S.merge([KG(kg.entities, kg.relations.where("confidence < 0.6")), KG(kg.entities, kg.relations.where("confidence >= 0.3"))], "intersection").relations.select("head", "relation_type", "tail")


@query("set1_merge_weighted", f"{SQL}, r AS (SELECT * FROM relations UNION ALL SELECT head, relation_type, tail, 1.0, provenance FROM relations WHERE confidence > 0.5) SELECT head, relation_type, tail, round(avg(confidence), 6) AS confidence FROM r GROUP BY ALL")
def _(spark, d):
    kg = star_kg(spark, d)
    sure = kg.relations.where("confidence > 0.5").withColumn("confidence", F.lit(1.0))
    return S.merge([kg, KG(kg.entities, sure)], "weighted").relations.select("head", "relation_type", "tail", F.round("confidence", 6).alias("confidence"))


@query("set2_code_sets", f"{SQL}, a AS (SELECT kb_id AS c FROM entities WHERE ord % 2 = 0 AND kb_id IS NOT NULL), b AS (SELECT kb_id AS c FROM entities WHERE confidence > 0.5 AND kb_id IS NOT NULL) SELECT 'both' AS part, c FROM (SELECT c FROM a INTERSECT SELECT c FROM b) UNION ALL SELECT 'first', c FROM (SELECT c FROM a EXCEPT SELECT c FROM b) UNION ALL SELECT 'any', c FROM (SELECT c FROM a UNION SELECT c FROM b)")
def _(spark, d):
    e = star_kg(spark, d).entities.where("kb_id IS NOT NULL").withColumnRenamed("kb_id", "c")
    return S.code_sets(e.where("ord % 2 = 0").select("c"), e.where("confidence > 0.5").select("c"))


_SETS = "s AS (SELECT list_sort(w) AS w, min(k) AS k, list(DISTINCT k) AS all_k FROM (SELECT {} AS k, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS w FROM {}) WHERE len(w) > 0 GROUP BY 1), p AS (SELECT a.k AS a, b.k AS b, len(list_intersect(a.w, b.w)) / (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w))) AS j FROM s a JOIN s b ON a.k < b.k AND least(len(a.w), len(b.w)) >= greatest(len(a.w), len(b.w)) * {} - 1e-9), c AS (SELECT k AS a, unnest(all_k) AS b FROM s)"
_SIMILAR = "SELECT a, b, round(j, 6) AS jaccard FROM p WHERE j >= {} - 1e-9 UNION ALL SELECT a, b, 1.0::DOUBLE FROM c WHERE a <> b"


@query("set3_jaccard", "SELECT a.item_id AS a, b.item_id AS b, round(len(list_intersect(a.w, b.w)) / greatest(len(list_distinct(list_concat(a.w, b.w))), 1), 6) AS jaccard FROM (SELECT DISTINCT item_id, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS w FROM benchmark) a JOIN (SELECT DISTINCT item_id, list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '\\s+'), lambda x: x <> '')) AS w FROM benchmark) b ON a.item_id < b.item_id AND len(list_intersect(a.w, b.w)) > 0")
def _(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text").distinct()
    return S.jaccard_pairs(b, "item_id", "text").select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("set3_similar_texts", "WITH " + _SETS.format("doc_id", "documents", 0.7) + " " + _SIMILAR.format(0.7))
def _(spark, d):
    """All documents whose word sets agree in seven tenths."""
    return S.similar_sets(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", 0.7).select("a", "b", F.round("jaccard", 6).alias("jaccard"))


@query("set4_remaining_positions", "SELECT o_orderkey, array_to_string(list_filter([1,2,3,4,5], lambda x: x <> o_orderkey % 5 AND x <> o_custkey % 5), ',') AS p FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    left = S.remaining_positions(F.array((F.col("o_orderkey") % 5).cast("int"), (F.col("o_custkey") % 5).cast("int")), 5)
    return o.select("o_orderkey", F.array_join(F.transform(left, lambda x: x.cast("string")), ",").alias("p"))


@query("set5_unique_in_order", "SELECT item_id, array_to_string(list_transform(list_filter(list_transform(w, lambda x, i: {'x': x, 'i': i}), lambda s: list_position(w, s.x) = s.i), lambda s: s.x), ' ') AS words FROM (SELECT DISTINCT item_id, string_split(text, ' ') AS w FROM benchmark)")
def _(spark, d):
    return table(spark, d, "benchmark").select("item_id", "text").distinct().select("item_id", F.array_join(F.array_distinct(F.split("text", " ")), " ").alias("words"))


@query("set6_filter_dedup_triples", f"{SQL}, x AS (SELECT head_text, relation_type, tail_text, confidence, row_number() OVER (PARTITION BY head_text, relation_type, tail_text ORDER BY head, tail) AS r FROM ({TRIPLES}) ), y AS (SELECT *, len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) AS s FROM (SELECT *, list_distinct(string_split(lower(tail_text), ' ')) AS a, ['europe', 'asia', 'africa', 'america'] AS b FROM x WHERE r = 1)) SELECT head_text, relation_type, tail_text, round(confidence * s, 6) AS confidence FROM y WHERE s >= 0.2")
def _(spark, d):
    t = J.triples(star_kg(spark, d))
    return S.filter_and_dedup(t, F.lit("europe asia africa america"), 0.2, ["head", "tail"]).select("head_text", "relation_type", "tail_text", F.round("confidence", 6).alias("confidence"))
