"""Queries for extraction, rules, evaluation and text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..kg import ALL_LINES, SQL, SQL_ALL_LINES, star_kg, table
from ..operators import aggregates as A
from ..operators import evaluation as V
from ..operators import extraction as E
from ..operators import joins as J
from ..operators import rules as R
from .registry import query

#: Patterns that find something in the driver's invented prose, and mean the same to Java's engine and RE2.
PROSE = [("NAME", r"\p{Lu}\p{Ll}{2,}(?: \p{Lu}\p{Ll}+)+"), ("NUMBER", r"[0-9]{2,}(?:\.[0-9]+)*"), ("TERM", r"\p{Lu}\p{Ll}{9,}")]


def _case(rows: list[tuple[str, str]], default: str) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in rows) + f" ELSE {default} END"


def _rx(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern}')"


def prose(spark, d) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def _sql_found() -> str:
    """The oracle's mentions: distinct matches, first pattern first."""
    parts = [f"SELECT doc_id, text AS t, {k} AS p, '{kind}' AS type, unnest(list_distinct(regexp_extract_all(text, '{pattern}', 0))) AS m FROM documents" for k, (kind, pattern) in enumerate(PROSE)]
    return f"WITH f AS ({' UNION ALL '.join(parts)}), g AS (SELECT doc_id, t, m, min_by(type, p) AS type FROM f GROUP BY ALL), m AS (SELECT doc_id, m AS text, type, instr(t, m)::INTEGER AS start, instr(t, m)::INTEGER + length(m)::INTEGER - 1 AS stop FROM g)"


FOUND = _sql_found()
NAME_SQL = """CASE WHEN text = '' THEN 0.0 WHEN type = 'CONCEPT' THEN 0.35 ELSE least(1.0, 0.55::DOUBLE + (CASE WHEN length(text) BETWEEN 3 AND 30 THEN 0.15 WHEN length(text) > 30 AND length(text) <= 60 THEN 0.1 WHEN length(text) > 60 AND length(text) <= 100 THEN 0.05 ELSE 0.0 END)::DOUBLE + (CASE WHEN regexp_matches(text, '^\\p{Lu}') THEN 0.1 ELSE 0.0 END)::DOUBLE) END"""


def found(spark, d) -> DataFrame:
    return E.mentions(prose(spark, d), "doc_id", PROSE)


@query("ext1_generic_entities", f"{FOUND} SELECT doc_id, text, type, start, stop, round({NAME_SQL}, 6) AS confidence FROM m")
def _(spark, d):
    return found(spark, d).select("doc_id", "text", "type", "start", "stop", F.round("confidence", 6).alias("confidence"))


@query("ext1_entity_type_stats", f"{FOUND} SELECT type, count(*) AS n, count(DISTINCT text) AS texts, round(avg({NAME_SQL}), 6) AS mean FROM m GROUP BY type")
def _(spark, d):
    return found(spark, d).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("text").alias("texts"), F.round(F.avg("confidence"), 6).alias("mean"))


@query("ext6_fallback_tokens", "WITH t AS (SELECT doc_id, unnest(list_transform(regexp_split_to_array(text, '\\s+'), lambda t: regexp_replace(t, '[^\\p{L}]', '', 'g'))) AS t FROM documents) SELECT doc_id, count(*) AS n, min(t) AS first, max(t) AS last FROM t WHERE length(t) > 3 AND (regexp_matches(t, '^\\p{Lu}') OR regexp_matches(lower(t), 'tion|heit')) GROUP BY doc_id")
def _(spark, d):
    t = prose(spark, d).select("doc_id", F.explode(E.fallback_tokens(F.col("text"), ["tion", "heit"])).alias("t"))
    return t.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first"), F.max("t").alias("last"))


@query("join5_cooccurring_pairs", f"{FOUND}, o AS (SELECT doc_id, text, start, row_number() OVER (PARTITION BY doc_id ORDER BY start, text) AS ord FROM m WHERE type='TERM') SELECT a.doc_id, count(*) AS pairs, min(a.text || '/' || b.text) AS first FROM o a JOIN o b ON a.doc_id=b.doc_id AND a.ord < b.ord GROUP BY a.doc_id")
def _(spark, d):
    return J.pair_counts(terms(spark, d), "doc_id")


def terms(spark, d) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("doc_id").orderBy("start", "text")
    return found(spark, d).where("type = 'TERM'").withColumn("ord", F.row_number().over(order))


@query("join6_proximity_pairs", f"{FOUND}, o AS (SELECT doc_id, text, start, row_number() OVER (PARTITION BY doc_id ORDER BY start, text) AS ord FROM m WHERE type='TERM') SELECT a.doc_id, a.text AS head, b.text AS tail, CASE WHEN contains(lower(d.text), 'treat') THEN 'TREATS' WHEN contains(lower(d.text), 'cause') THEN 'CAUSES' WHEN contains(lower(d.text), 'prevent') THEN 'PREVENTS' ELSE 'RELATED_TO' END AS relation_type, 0.5::DOUBLE AS confidence FROM o a JOIN o b ON a.doc_id=b.doc_id AND a.ord < b.ord AND abs(a.start - b.start) < 200 JOIN documents d ON d.doc_id = a.doc_id")
def _(spark, d):
    return E.proximity_relations(prose(spark, d), terms(spark, d), "doc_id")


SENT = "list_filter(list_transform(regexp_split_to_array(text, '[.!?]+'), lambda s: trim(replace(s, chr(10), ' '))), lambda s: s <> '')"


@query("ext13_sentences", f"SELECT doc_id, len({SENT}) AS n, list_max(list_transform({SENT}, lambda s: length(s)))::INTEGER AS longest FROM documents")
def _(spark, d):
    return prose(spark, d).select("doc_id", F.size(X.sentences("text")).cast("long").alias("n"), F.array_max(F.transform(X.sentences("text"), F.length)).alias("longest"))


@query("join7_sentence_pairs", f"{FOUND}, o AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY start, text) AS ord FROM m WHERE type='TERM'), s0 AS (SELECT doc_id, {SENT} AS l FROM documents), s AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS no FROM s0), x AS (SELECT s.doc_id, no, o.text, row_number() OVER (PARTITION BY s.doc_id, no ORDER BY ord, o.text) AS r FROM s JOIN o ON o.doc_id=s.doc_id AND contains(s, o.text)), p AS (SELECT doc_id, no, max(CASE WHEN r=1 THEN text END) AS head, max(CASE WHEN r=2 THEN text END) AS tail FROM x WHERE r<=2 GROUP BY ALL) SELECT doc_id, head, tail, min(no)::INTEGER AS sentence_no FROM p WHERE tail IS NOT NULL GROUP BY doc_id, head, tail")
def _(spark, d):
    return J.sentence_pairs(prose(spark, d), terms(spark, d), "doc_id", X.sentences("text"))


_PAIRS = f"""{FOUND}, o AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY start, text) AS ord FROM m WHERE type='TERM'), s0 AS (SELECT doc_id, {SENT} AS l FROM documents), s AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS no FROM s0),
x AS (SELECT s.doc_id, no, o.text, row_number() OVER (PARTITION BY s.doc_id, no ORDER BY ord, o.text) AS r FROM s JOIN o ON o.doc_id=s.doc_id AND contains(s, o.text)), p AS (SELECT doc_id, no, max(CASE WHEN r=1 THEN text END) AS head, max(CASE WHEN r=2 THEN text END) AS tail FROM x WHERE r<=2 GROUP BY ALL),
q AS (SELECT doc_id, head, tail, min(no) AS no FROM p WHERE tail IS NOT NULL GROUP BY ALL), z AS (SELECT q.*, s.s FROM q JOIN s USING (doc_id, no))"""
_KIND = _case([(f"regexp_matches(s, '{p}')", f"'{k}'") for k, p in E.SENTENCE_PATTERNS], "'ASSOCIATED_WITH'")


@query("ext10_sentence_relations", f"{_PAIRS} SELECT doc_id, head, {_KIND} AS relation_type, tail, CASE WHEN {_KIND} = 'ASSOCIATED_WITH' THEN 0.5 ELSE 0.7 END::DOUBLE AS confidence FROM z")
def _(spark, d):
    return E.sentence_relations(prose(spark, d), terms(spark, d), "doc_id")


@query("ext8_pair_relations", f"{FOUND}, o AS (SELECT doc_id, text, start, row_number() OVER (PARTITION BY doc_id ORDER BY start, text) AS ord FROM m WHERE type='TERM'), p AS (SELECT a.doc_id, a.text AS head, b.text AS tail FROM o a JOIN o b ON a.doc_id=b.doc_id AND a.ord < b.ord) SELECT doc_id, count(*) AS n, count(DISTINCT head) AS heads FROM p GROUP BY doc_id")
def _(spark, d):
    r = E.pair_relations(prose(spark, d), terms(spark, d), "doc_id")
    return r.groupBy("doc_id").agg(F.count("relation_type").alias("n"), F.count_distinct("head").alias("heads"))


#: Texts made of the rules' words, by the numbers of orders.
HEADS = ["Alpha drug", "Beta protein", "specific gene", "viral bacteria", "clinical treatment", "x", "Organ tissue", "Delta"]
TAILS = ["heart disease", "liver enzyme", "cell pathway", "Alpha drug", "exact clinical syndrome", "pump", "gland"]
CONTEXTS = ["it treats the patient", "smoking leads to harm", "is related to age", "precise: it blocks growth", "binds to iron", "is a part of the body", "scientific notes", "", "derived from milk", "this suggests more"]


def _pick(values: list[str], column: str) -> tuple[str, str]:
    quoted = ", ".join(f"'{v}'" for v in values)
    return f"element_at(array({quoted}), cast({column} % {len(values)} as int) + 1)", f"[{quoted}][({column} % {len(values)})::INTEGER + 1]"


(_H, _HS), (_T, _TS), (_C, _CS) = _pick(HEADS, "o_orderkey"), _pick(TAILS, "o_custkey"), _pick(CONTEXTS, "(o_orderkey + o_custkey)")
_NEAR = "array_to_string(string_split(coalesce(text, ''), ' ')[{}:{}], ' ')"
RULED = f"WITH t AS (SELECT o_orderkey AS k, {_HS} AS head, {_TS} AS tail, {_CS} AS context FROM orders UNION ALL SELECT -1 - doc_id, {_NEAR.format(1, 3)}, {_NEAR.format(4, 7)}, coalesce(text, '') FROM documents)"


def ruled(spark, d) -> DataFrame:
    """Made triples for each order, of the rules' words, and for each document its first words as ends and its whole text as context."""
    made = table(spark, d, "orders").selectExpr("o_orderkey AS k", f"{_H} AS head", f"{_T} AS tail", f"{_C} AS context")
    near = lambda at, n: f"array_join(slice(split(coalesce(text, ''), ' '), {at}, {n}), ' ')"
    return made.unionByName(table(spark, d, "documents").selectExpr("-1 - doc_id AS k", f"{near(1, 3)} AS head", f"{near(4, 4)} AS tail", "coalesce(text, '') AS context"))


TYPE_SQL = lambda c: _case([(_rx(f"lower({c})", R.any_word(w)), f"'{k}'") for k, w in R.ENTITY_WORDS], "'UNKNOWN'")
REL_SQL = _case([(_rx("lower(context)", R.any_phrase(p)), f"'{k}'") for k, p in R.RELATION_PHRASES], "'UNKNOWN_RELATION'")
VALID_SQL = f"(head <> '' AND tail <> '' AND head <> tail AND {_case([(f'''rel = '{k}' ''', f'({_rx('lower(head)', R.any_word(h))} AND {_rx('lower(tail)', R.any_word(t))})') for k, h, t in R.ENDS if h], 'true')})"


@query("cls1_entity_type", f"{RULED} SELECT k, {TYPE_SQL('head')} AS head_type, {TYPE_SQL('tail')} AS tail_type FROM t")
def _(spark, d):
    return ruled(spark, d).select("k", R.entity_type(F.col("head")).alias("head_type"), R.entity_type(F.col("tail")).alias("tail_type"))


@query("cls2_relation_type", f"{RULED} SELECT k, {REL_SQL} AS rel FROM t")
def _(spark, d):
    return ruled(spark, d).select("k", R.relation_type(F.col("context")).alias("rel"))


@query("cls3_known_type", "SELECT o_orderkey AS k, CASE WHEN upper(trim(x)) IN ('DISEASE', 'DRUG') THEN upper(trim(x)) ELSE 'UNKNOWN' END AS type FROM (SELECT o_orderkey, ['disease ', 'Drug', 'thing'][(o_orderkey % 3)::INTEGER + 1] AS x FROM orders)")
def _(spark, d):
    t = table(spark, d, "orders").selectExpr("o_orderkey AS k", "element_at(array('disease ', 'Drug', 'thing'), cast(o_orderkey % 3 as int) + 1) AS x")
    return t.select("k", R.known_type(F.col("x"), ["DISEASE", "DRUG"], "UNKNOWN").alias("type"))


@query("val1_valid_entity", f"{RULED} SELECT k, length(head) BETWEEN 2 AND 200 AND {_case([(f'''x = '{k}' ''', _rx('lower(head)', R.any_word(w))) for k, w in R.ENTITY_WORDS], 'true')} AS ok FROM (SELECT *, ['DRUG','GENE','UNKNOWN'][(abs(k) % 3)::INTEGER + 1] AS x FROM t)")
def _(spark, d):
    kind = F.expr("element_at(array('DRUG','GENE','UNKNOWN'), cast(abs(k) % 3 as int) + 1)")
    return ruled(spark, d).select("k", R.valid_entity(F.col("head"), kind).alias("ok"))


@query("val2_valid_relation", f"{RULED} SELECT k, {VALID_SQL} AS strict, head <> '' AND tail <> '' AND head <> tail AND rel <> 'UNKNOWN_RELATION' AND ({VALID_SQL} OR (length(head) > 1 AND length(tail) > 1)) AS lenient FROM (SELECT *, {REL_SQL} AS rel FROM t)")
def _(spark, d):
    t = ruled(spark, d).withColumn("rel", R.relation_type(F.col("context")))
    h, r, x = F.col("head"), F.col("rel"), F.col("tail")
    return t.select("k", R.valid_relation(h, r, x).alias("strict"), R.valid_relation(h, r, x, strict=False).alias("lenient"))


_SPEC, _DOM = R.any_word(R.SPECIFIC), R.any_word(R.DOMAIN)


@query("conf1_entity_confidence", f"{RULED}, x AS (SELECT k, head, {TYPE_SQL('head')} AS kind FROM t) SELECT k, round(CASE WHEN length(head) BETWEEN 2 AND 200 THEN least(1.0, 0.5::DOUBLE + (CASE WHEN length(head) BETWEEN 5 AND 50 THEN 0.2 WHEN length(head) BETWEEN 3 AND 100 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN {_rx('lower(head)', _SPEC)} THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN kind <> 'UNKNOWN' AND {_rx('lower(head)', _DOM)} THEN 0.1 ELSE 0 END)::DOUBLE) ELSE 0 END, 6) AS confidence FROM x")
def _(spark, d):
    return ruled(spark, d).select("k", F.round(R.entity_confidence(F.col("head"), R.entity_type(F.col("head"))), 6).alias("confidence"))


@query("conf2_relation_confidence", f"{RULED}, x AS (SELECT *, {REL_SQL} AS rel FROM t) SELECT k, round(CASE WHEN rel = 'UNKNOWN_RELATION' THEN 0.3 WHEN {VALID_SQL} THEN least(1.0, 0.5::DOUBLE + (CASE WHEN context <> '' THEN 0.2 ELSE 0 END)::DOUBLE + (CASE WHEN length(head) BETWEEN 3 AND 50 AND length(tail) BETWEEN 3 AND 50 THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN {_rx('lower(context)', _SPEC)} THEN 0.1 ELSE 0 END)::DOUBLE + (CASE WHEN {_rx('lower(context)', _DOM)} THEN 0.1 ELSE 0 END)::DOUBLE) ELSE 0.0 END, 6) AS confidence FROM x")
def _(spark, d):
    t = ruled(spark, d).withColumn("rel", R.relation_type(F.col("context")))
    return t.select("k", F.round(R.relation_confidence(F.col("head"), F.col("rel"), F.col("tail"), F.col("context")), 6).alias("confidence"))


@query("conf3_linked_confidence", f"{SQL} SELECT id, round(CASE WHEN kb_id IS NOT NULL THEN least(confidence + 0.2, 1.0) ELSE confidence END, 6) AS confidence FROM entities")
def _(spark, d):
    c = F.when(F.col("kb_id").isNotNull(), F.least(F.col("confidence") + 0.2, F.lit(1.0))).otherwise(F.col("confidence"))
    return star_kg(spark, d).entities.select("id", F.round(c, 6).alias("confidence"))


@query("conf4_wilson_interval", f"{SQL}, s AS (SELECT relation_type, count(*) AS n, count_if(confidence > 0.5)/count(*) AS p FROM relations GROUP BY relation_type), z AS (SELECT *, 1.959963984540054 AS z FROM s) SELECT relation_type, round(greatest(0, (p + z*z/(2*n))/(1+z*z/n) - z*sqrt(p*(1-p)/n + z*z/(4*n*n))/(1+z*z/n)), 6) AS low, round(least(1, (p + z*z/(2*n))/(1+z*z/n) + z*sqrt(p*(1-p)/n + z*z/(4*n*n))/(1+z*z/n)), 6) AS high FROM (SELECT relation_type, n::DOUBLE AS n, p, z::DOUBLE AS z FROM z)")
def _(spark, d):
    n = F.count(F.lit(1))
    s = star_kg(spark, d).relations.groupBy("relation_type").agg(n.cast("double").alias("n"), (F.count_if(F.col("confidence") > 0.5) / n).alias("p"))
    low, high = R.wilson(F.col("p"), F.col("n"))
    return s.select("relation_type", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


_VALIDITY = f"CASE WHEN rel = 'TREATS' AND ht = 'DRUG' AND tt = 'DISEASE' THEN 'yes' WHEN rel = 'CAUSES' AND ht = 'DISEASE' AND tt = 'DISEASE' THEN 'yes' WHEN rel = 'ASSOCIATED_WITH' THEN 'maybe' ELSE 'no' END"
_VALIDITY_OF = f"({_VALIDITY})"


@query("conf5_significance", f"{RULED}, v AS (SELECT CASE {_VALIDITY_OF} WHEN 'yes' THEN 1.0 WHEN 'maybe' THEN 0.5 ELSE 0.0 END::DOUBLE AS s FROM (SELECT {REL_SQL} AS rel, {TYPE_SQL('head')} AS ht, {TYPE_SQL('tail')} AS tt FROM t)), m AS (SELECT count(*) AS n, avg(s) AS m, stddev_samp(s) AS d FROM v) SELECT n, round(m, 6) AS mean, round((m - 0.5) / (d / sqrt(n)), 6) AS statistic, round((m - 0.5) / d, 6) AS effect FROM m")
def _(spark, d):
    t = ruled(spark, d)
    scores = t.select(V.verdict_score(R.validity(R.entity_type(F.col("head")), R.relation_type(F.col("context")), R.entity_type(F.col("tail")))).alias("score"))
    return V.one_sample_t(scores, "score", 0.5).select("n", "mean", "statistic", "effect")


@query("val4_ontology", f"{RULED} SELECT k, {_case([(f'''rel = '{k}' ''', ' AND '.join(f'''(list_contains({list(a)}, '*') OR list_has_any(types, {list(a)}))''' for a in v)) for k, v in R.COMPATIBLE.items()], 'false')} AS ok FROM (SELECT *, {REL_SQL} AS rel, [['Disease'], ['Finding', 'Other'], ['Pharmacologic Substance', 'Disease']][(abs(k) % 3)::INTEGER + 1] AS types FROM t)")
def _(spark, d):
    types = F.expr("element_at(array(array('Disease'), array('Finding', 'Other'), array('Pharmacologic Substance', 'Disease')), cast(abs(k) % 3 as int) + 1)")
    return ruled(spark, d).select("k", R.compatible(types, R.relation_type(F.col("context")), types).alias("ok"))


_SUPPORT = _case([(f"rel = '{k}' ", "(" + " OR ".join(f"contains(lower(c), '{w}')" for w in ws) + ")") for k, ws in R.KEYWORDS.items()], "contains(lower(c), lower(rel))")


@query("eval1_triple_support", f"{RULED}, x AS (SELECT k, head, tail, {REL_SQL} AS rel, head || ' ' || context || CASE WHEN k % 2 = 0 THEN ' ' || tail ELSE '' END AS c FROM t) SELECT k, contains(lower(c), lower(head)) AND contains(lower(c), lower(tail)) AND {_SUPPORT} AS ok FROM x")
def _(spark, d):
    t = ruled(spark, d).withColumn("rel", R.relation_type(F.col("context")))
    c = F.concat("head", F.lit(" "), "context", F.when(F.col("k") % 2 == 0, F.concat(F.lit(" "), "tail")).otherwise(""))
    return t.select("k", R.supported(F.col("head"), F.col("rel"), F.col("tail"), c).alias("ok"))


@query("eval3_kb_validity", f"{SQL}, x AS (SELECT r.head, r.relation_type, r.tail, h.kb_id AS hk, t.kb_id AS tk FROM relations r JOIN entities h ON h.id = r.head JOIN entities t ON t.id = r.tail) SELECT relation_type, CASE WHEN hk IS NULL OR tk IS NULL THEN 'unknown' WHEN relation_type IN ('SUPPLIES', 'LOCATED_IN') THEN 'yes' ELSE 'no' END AS verdict, count(*) AS n FROM x GROUP BY ALL")
def _(spark, d):
    return V.kb_validity(J.triples(star_kg(spark, d)), ["SUPPLIES", "LOCATED_IN"]).groupBy("relation_type", "verdict").agg(F.count(F.lit(1)).alias("n"))




@query("eval4_triple_validity", f"{RULED} SELECT k, {_VALIDITY} AS verdict FROM (SELECT k, {REL_SQL} AS rel, {TYPE_SQL('head')} AS ht, {TYPE_SQL('tail')} AS tt FROM t)")
def _(spark, d):
    return ruled(spark, d).select("k", R.validity(R.entity_type(F.col("head")), R.relation_type(F.col("context")), R.entity_type(F.col("tail"))).alias("verdict"))


@query("agg11_validity_score", f"{RULED} SELECT count(*) AS total, count_if(v='yes') AS yes, count_if(v='maybe') AS maybe, count_if(v='no') AS no, round(count_if(v='yes')/count(*), 6) AS score FROM (SELECT {_VALIDITY} AS v FROM (SELECT k, {REL_SQL} AS rel, {TYPE_SQL('head')} AS ht, {TYPE_SQL('tail')} AS tt FROM t))")
def _(spark, d):
    return V.validity_score(ruled(spark, d).select(R.validity(R.entity_type(F.col("head")), R.relation_type(F.col("context")), R.entity_type(F.col("tail"))).alias("verdict")))


@query("agg9_factscore", f"{RULED}, x AS (SELECT k, head, tail, {REL_SQL} AS rel, head || ' ' || context || ' ' || tail AS c FROM t) SELECT rel, count(*) AS total, count_if(contains(lower(c), lower(head)) AND contains(lower(c), lower(tail)) AND {_SUPPORT}) AS supported FROM x GROUP BY rel")
def _(spark, d):
    t = ruled(spark, d).withColumn("rel", R.relation_type(F.col("context"))).withColumn("c", F.concat_ws(" ", "head", "context", "tail"))
    return V.support(t, F.col("head"), F.col("rel"), F.col("tail"), F.col("c"), ["rel"])




@query("join15_graphrag_search", f"""{SQL}, q AS (SELECT ['supplier', 'india', 'located'] AS terms), x AS (SELECT r.head, r.relation_type, r.tail, list_filter(terms, lambda t: contains(lower(h.text || ' ' || h.label), t)) AS a, list_filter(terms, lambda t: contains(lower(e.text || ' ' || e.label), t)) AS b, list_filter(terms, lambda t: contains(lower(r.relation_type || ' ' || r.head || ' ' || r.tail), t)) AS c FROM relations r JOIN entities h ON h.id=r.head JOIN entities e ON e.id=r.tail, q),
s AS (SELECT head, relation_type, tail, round(len(a)/3.0*0.4 + len(b)/3.0*0.4 + len(c)/3.0*0.2, 6) AS score FROM x) SELECT * FROM s WHERE score > 0.1 ORDER BY score DESC, head, relation_type, tail LIMIT 10""")
def _(spark, d):
    return V.local_search(star_kg(spark, d), "supplier in India: is it located?", 10)


#: The ten best triples for terms, as SQL.
def _found_sql(terms: list[str]) -> str:
    quoted = ", ".join(f"'{t}'" for t in terms)
    hits = lambda c: f"len(list_filter([{quoted}], lambda t: contains(lower({c}), t))) / {len(terms)}.0"
    head, tail, link = hits("h.text || ' ' || h.label"), hits("e.text || ' ' || e.label"), hits("r.relation_type || ' ' || r.head || ' ' || r.tail")
    score = f"{head} * 0.4 + {tail} * 0.4 + {link} * 0.2"
    return f"SELECT * FROM (SELECT r.head, r.relation_type, r.tail, round({score}, 6) AS score FROM relations r JOIN entities h ON h.id=r.head JOIN entities e ON e.id=r.tail) WHERE score > 0.1 ORDER BY score DESC, head, relation_type, tail LIMIT 10"


_ANSWER = "SELECT count(*) AS n, CASE WHEN count(*) = 0 THEN 0.0::DOUBLE ELSE round(least(count(*) / 10.0, 1.0) * 0.6 + least(sum(length(head || ' ' || lower(relation_type) || ' ' || tail) + 2) / 100.0, 1.0) * 0.4, 6) END AS score"


@query("conf6_graphrag_score", f"{SQL} {_ANSWER} FROM ({_found_sql(['supplier', 'india', 'located'])})")
def _(spark, d):
    return V.graphrag_score(V.local_search(star_kg(spark, d), "supplier india located", 10), 10)


_TERMS = "list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda t: length(t) > 2))"
_SHARE = "len(list_filter(q.terms, lambda t: contains(lower({}), t))) / len(q.terms)::DOUBLE"


@query("agg18_graphrag_dataset", f"""{SQL_ALL_LINES}, q AS (SELECT id, {_TERMS} AS terms FROM (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT -1, 'supplier india located' UNION ALL SELECT -2 - r_regionkey, 'customers of region ' || r_name FROM region)), a AS (SELECT q.id, r.head, r.relation_type, r.tail, round({_SHARE.format("h.text || ' ' || h.label")} * 0.4 + {_SHARE.format("e.text || ' ' || e.label")} * 0.4 + {_SHARE.format("r.relation_type || ' ' || r.head || ' ' || r.tail")} * 0.2, 6) AS score
FROM q, relations r JOIN entities h ON h.id = r.head JOIN entities e ON e.id = r.tail WHERE len(q.terms) > 0), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, head, relation_type, tail) AS place FROM a WHERE score > 0.1),
s AS (SELECT id, count(*) AS n, sum(length(head || ' ' || lower(relation_type) || ' ' || tail) + 2) AS chars FROM k WHERE place <= 10 GROUP BY id)
SELECT count(*) AS questions, round(avg(coalesce(round(least(n / 10.0, 1.0) * 0.6 + least(chars / 100.0, 1.0) * 0.4, 6), 0)), 6) AS mean FROM q LEFT JOIN s USING (id)""")
def _(spark, d):
    """All benchmark items and a question about each region, answered by one search of the graph, with all lines of orders."""
    from functools import reduce

    items = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    regions = table(spark, d, "region").select((-2 - F.col("r_regionkey")).cast("long").alias("id"), F.concat(F.lit("customers of region "), "r_name").alias("text"))
    one = spark.createDataFrame([(-1, "supplier india located")], "id long, text string")
    return V.graphrag_dataset(star_kg(spark, d, ALL_LINES), reduce(DataFrame.unionByName, [items, one, regions]), 10)


@query("join8_fuzzy_lookup", f"{SQL}, w AS (SELECT id, ord, list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda x: x <> '') AS w FROM entities), i AS (SELECT id, ord, array_to_string(w[1:n], ' ') AS name FROM w, range(1, 9) g(n) WHERE n <= len(w)), b AS (SELECT name, min_by(id, ord) AS id FROM i GROUP BY name), q AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS name FROM part UNION SELECT lower(n_name) FROM nation UNION SELECT substr(lower(n_name), 2, 3) FROM nation UNION SELECT lower(substr(c_name, 10)) FROM customer), e AS (SELECT name, id FROM q JOIN b USING (name)), f AS (SELECT q.name, min_by(x.id, x.ord) AS id FROM q JOIN entities x ON contains(lower(x.text), q.name) WHERE q.name <> '' AND q.name NOT IN (SELECT name FROM b) GROUP BY q.name) SELECT name, id FROM e UNION ALL SELECT name, id FROM f")
def _(spark, d):
    """Names that begin an entity's name, and others that are only within one: later words of parts, middles of nations, ends of customers."""
    nation = table(spark, d, "nation")
    names = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("name")).union(nation.select("n_name")).union(nation.select(F.substring("n_name", 2, 3))).union(table(spark, d, "customer").select(F.expr("substr(c_name, 10)")))
    return J.fuzzy_lookup(names.select(F.lower("name").alias("name")).distinct(), star_kg(spark, d).entities)


@query("join10_token_heads", "WITH w AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM benchmark), s AS (SELECT n_name AS head FROM nation UNION ALL SELECT r_name FROM region) SELECT DISTINCT head FROM s WHERE EXISTS (SELECT 1 FROM w WHERE w <> '' AND contains(lower(head), w))")
def _(spark, d):
    heads = table(spark, d, "nation").select(F.col("n_name").alias("head")).union(table(spark, d, "region").select("r_name"))
    return J.token_heads(table(spark, d, "benchmark"), heads).distinct()


@query("join17_mention_at", f"{FOUND} SELECT m.doc_id, p.point, min_by(m.text, m.start * 1000 + m.stop) AS text FROM m, (VALUES (5), (60), (200)) p(point) WHERE start <= point AND point <= stop AND type = 'NAME' GROUP BY m.doc_id, p.point")
def _(spark, d):
    m = found(spark, d).where("type = 'NAME'")
    points = table(spark, d, "documents").select("doc_id", F.explode(F.array(F.lit(5), F.lit(60), F.lit(200))).alias("point"))
    return J.at_position(m, points, "doc_id")


@query("join19_property_map", "SELECT o_orderkey AS k, " + _case([(f"p = '{k}'", f"'{v}'") for k, v in R.PROPERTIES.items()], "'RELATED_TO'") + " AS rel FROM (SELECT o_orderkey, 'P' || (o_orderkey % 800) AS p FROM orders)")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), R.property_relation(F.concat(F.lit("P"), (F.col("o_orderkey") % 800).cast("string"))).alias("rel"))


#: A sentence of named people for each document, by its id; they stand before its text.
TOLD = ["Louis XIV married Maria Theresa of Spain. Louis XIII was the father of Louis XIV.", "marie antoinette married louis xvi", "Louis XIV succeeded after Louis XIII, and Louis XIV is a parent of Louis XV", "nobody married anybody", "Louis XIV alone"]
_TOLD = ", ".join(f"'{x}'" for x in TOLD)
_NAMED_SQL = " UNION ALL ".join(f"SELECT doc_id, t, '{k}' AS relation_type, unnest(regexp_extract_all(t, '{p}', 1)) AS head, unnest(regexp_extract_all(t, '{p}', 2)) AS tail FROM t" for k, p in E.NAMED_PATTERNS)
_NAME_SQL = "(SELECT count(*) FROM (VALUES " + ", ".join(f"('{n}')" for n in E.NAMED_PEOPLE) + ") v(n) WHERE contains(lower(t), lower(n))) > 1"


@query("ext9_named_relations", f"WITH t AS (SELECT doc_id, [{_TOLD}][(doc_id % 5)::INTEGER + 1] || ' ' || coalesce(text, '') AS t FROM documents), r AS ({_NAMED_SQL}) SELECT doc_id, head, relation_type, tail, 0.95::DOUBLE AS confidence FROM r WHERE {_NAME_SQL}")
def _(spark, d):
    told = f"concat(element_at(array({_TOLD}), cast(doc_id % 5 as int) + 1), ' ', coalesce(text, '')) AS text"
    return E.named_relations(table(spark, d, "documents").selectExpr("doc_id", told), "doc_id")


@query("ext12_tail_names", "SELECT o_orderkey AS k, array_to_string(list_transform([o_orderkey, o_custkey, 7], lambda t: 'entity_' || t), ' ') AS names FROM orders")
def _(spark, d):
    t = table(spark, d, "orders")
    return t.select(F.col("o_orderkey").alias("k"), F.array_join(E.tail_names(F.array("o_orderkey", "o_custkey", F.lit(7).cast("long"))), " ").alias("names"))


_LOW = "list_filter(l, lambda s: contains(lower(s), lower({0})){1})"


@query("ext14_triple_context", f"""{FOUND}, o AS (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY start, text) AS ord FROM m WHERE type='TERM'), s0 AS (SELECT doc_id, {SENT} AS l FROM documents), p AS (SELECT DISTINCT a.doc_id, a.text AS head, b.text AS tail FROM o a JOIN o b ON a.doc_id = b.doc_id AND a.ord < b.ord),
c AS (SELECT p.*, list_filter(l, lambda s: contains(lower(s), lower(head)) AND contains(lower(s), lower(tail))) AS b, list_filter(l, lambda s: contains(lower(s), lower(head)) OR contains(lower(s), lower(tail))) AS e FROM p JOIN s0 USING (doc_id))
SELECT doc_id, head, 'RELATED_TO' AS relation_type, tail, array_to_string((CASE WHEN len(b) > 0 THEN b ELSE e END)[1:5], ' ') AS context FROM c WHERE len(e) > 0""")
def _(spark, d):
    docs = prose(spark, d)
    t = J.pairs(terms(spark, d), "doc_id").select("doc_id", F.col("a_text").alias("head"), F.lit("RELATED_TO").alias("relation_type"), F.col("b_text").alias("tail"))
    return E.triple_context(docs, t, "doc_id")


@query("ext15_seed_expansion", f"{SQL}, kb AS (SELECT 'KS' || s_suppkey AS src, ['P19','P57','P999'][(s_suppkey % 3)::INTEGER + 1] AS rel, 'KN' || s_nationkey AS dst FROM supplier) SELECT text AS head, " + _case([(f"rel = '{k}'", f"'{v}'") for k, v in R.PROPERTIES.items()], "'RELATED_TO'") + " AS relation_type, dst AS tail, 0.7::DOUBLE AS score FROM entities JOIN kb ON src = kb_id")
def _(spark, d):
    kb = table(spark, d, "supplier").selectExpr("concat('KS', s_suppkey) AS src_kb_id", "element_at(array('P19','P57','P999'), cast(s_suppkey % 3 as int) + 1) AS relation_name", "concat('KN', s_nationkey) AS dst_kb_id")
    return E.seed_expansion(star_kg(spark, d).entities, kb)


@query("strf1_normalize", "SELECT doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))) AS norm, length(substr(trim(text), 1, 512)) AS cut FROM documents")
def _(spark, d):
    return prose(spark, d).select("doc_id", F.md5(X.normalize("text")).alias("norm"), F.length(X.preprocess("text")).cast("long").alias("cut"))


@query("strf2_sanitize", "SELECT page_id, md5(substr(regexp_replace(html, '[\\x00-\\x1f\\x7f-\\x9f]', '', 'g'), 1, 1000)) AS clean, CASE WHEN length(url) > 30 THEN substr(url, 1, 27) || '...' ELSE url END AS short, regexp_replace(regexp_replace(regexp_replace(url, '[^A-Za-z0-9_.\\-]', '_', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS file FROM pages")
def _(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(X.sanitize("html")).alias("clean"), X.truncate("url", 30).alias("short"), X.safe_filename("url").alias("file"))


@query("strf3_clean_article", "SELECT doc_id, md5(regexp_replace(regexp_replace(trim(text), '\\s+', ' ', 'g'), '[^\\p{L}\\p{N}_\\s.,;:!?\\-]', '', 'g')) AS clean FROM documents")
def _(spark, d):
    return prose(spark, d).select("doc_id", F.md5(X.clean_article("text")).alias("clean"))


@query("strf4_word_counts", "WITH w AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+')) AS w FROM documents) SELECT doc_id, count(*) AS n, count(DISTINCT w) AS distinct_words FROM w WHERE w <> '' GROUP BY doc_id")
def _(spark, d):
    w = X.words("text")
    return prose(spark, d).where(F.size(w) > 0).select("doc_id", F.size(w).cast("long").alias("n"), F.size(F.array_distinct(w)).cast("long").alias("distinct_words"))


REPLY = "'Entities found:' || chr(10) || '1. ' || c_name || chr(10) || '- ' || c_mktsegment || chr(10) || '# note' || chr(10) || 'ab' || chr(10) || '2 ' || c_name"


@query("strf7_parse_entities", f"WITH l AS (SELECT c_custkey AS k, unnest(list_transform(string_split({REPLY}, chr(10)), lambda t: trim(t))) AS t FROM customer), n AS (SELECT k, trim(regexp_replace(regexp_replace(t, '^\\d+\\.?\\s*', ''), '[-*_]', '', 'g')) AS n FROM l WHERE t <> '' AND NOT starts_with(t,'#') AND NOT starts_with(t,'Extracted') AND NOT starts_with(t,'Entities')) SELECT k, string_agg(DISTINCT n, '|' ORDER BY n) AS names FROM n WHERE length(n) > 2 GROUP BY k")
def _(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("Entities found:\n1. "), "c_name", F.lit("\n- "), "c_mktsegment", F.lit("\n# note\nab\n2 "), "c_name").alias("r"))
    return c.select("k", F.array_join(F.array_sort(X.parse_entities("r")), "|").alias("names"))


@query("strf8_parse_relations", "SELECT c_custkey AS k, c_name AS head, 'LIVES_IN' AS relation, 'x->' || c_mktsegment AS tail FROM customer UNION ALL SELECT c_custkey, 'B', 'HAS', 'y' FROM customer")
def _(spark, d):
    r = F.concat("c_name", F.lit(" -> old -> z\nB -> has! -> y\nno relation\n"), "c_name", F.lit(" -> lives in -> x->"), "c_mktsegment")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), r.alias("r"))
    return c.select("k", F.explode(X.parse_relations("r")).alias("x")).select("k", "x.*")


@query("strf9_prompts", "SELECT item_id, md5('List the entities in this text, one on a line:' || chr(10) || 'types: A, B' || chr(10) || 'Text: ' || text) AS p FROM (SELECT DISTINCT item_id, text FROM benchmark)")
def _(spark, d):
    b = table(spark, d, "benchmark").select("item_id", "text").distinct()
    return b.select("item_id", F.md5(X.prompt("entity_discovery", "text", types=F.lit("A, B"))).alias("p"))


@query("strf10_provenance", f"{SQL} SELECT split_part(coalesce(provenance, ''), '#', 1) AS document_id, CASE WHEN provenance IS NULL THEN '0' ELSE split_part(provenance, '#', 2) END AS segment_id, count(*) AS n FROM relations GROUP BY ALL")
def _(spark, d):
    p = star_kg(spark, d).relations.select(X.provenance("provenance").alias("p"))
    return p.groupBy("p.document_id", "p.segment_id").agg(F.count(F.lit(1)).alias("n"))


@query("strf11_hash_tokens", "SELECT doc_id, count(*) AS n, sum(t)::BIGINT AS total, min(t) AS least FROM (SELECT doc_id, (('0x' || md5(w)[1:15])::BIGINT % 10000) + 10 AS t FROM (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '')) AS w FROM documents)) GROUP BY doc_id")
def _(spark, d):
    """Stable numbers of all words of all texts."""
    w = prose(spark, d).select("doc_id", F.explode(X.words("text")).alias("w"))
    return w.select("doc_id", X.hash_token(F.col("w")).alias("t")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("t").alias("total"), F.min("t").alias("least"))
