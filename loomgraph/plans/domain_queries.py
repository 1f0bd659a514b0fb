"""Queries for domains, vocabularies, training rows and remaining scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import domains
from ..functions import text as X
from ..kg import SQL, star_kg, table
from ..operators import aggregates as A
from ..operators import evaluation as V
from ..operators import extraction as E
from ..operators import graph_algorithms as G
from ..operators import joins as J
from ..operators import rules as R
from ..operators import training as T
from ..operators import vocabulary as VB
from ..operators import windows as W
from ..sources import export
from ..streaming import events
from .graph_queries import TRIPLES, document_words
from .order_queries import SEED, TOKENS, _draw, seed, tokens
from .registry import query
from .text_queries import FOUND, RULED, _rx, found, prose, ruled

#: Every word of every text, with its place from 0.
ALL_TOKENS = "SELECT doc_id, unnest(range(len(w))) AS spot, unnest(w) AS token FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS w FROM documents)"
NOTE = ["Alpha Beta disease with pain", "Metformin treats Diabetes mellitus", "Gamma kinase and Delta gene", "no names here", "Omega virus in Liver tissue"]
_Q = ", ".join(f"'{x}'" for x in NOTE)
NOTES = f"WITH t AS (SELECT o_orderkey AS k, [{_Q}][(o_orderkey % 5)::INTEGER + 1] || '. ' || [{_Q}][(o_custkey % 5)::INTEGER + 1] AS t FROM orders)"


def notes(spark, d):
    pick = lambda c: f"element_at(array({_Q}), cast({c} % 5 as int) + 1)"
    return table(spark, d, "orders").selectExpr("o_orderkey AS k", f"concat({pick('o_orderkey')}, '. ', {pick('o_custkey')}) AS text")


def _clinical_sql() -> str:
    parts = [f"SELECT k, t, {n} AS p, '{kind}' AS type, unnest(list_distinct(regexp_extract_all(t, '{pattern}', 0))) AS m FROM t" for n, (kind, pattern) in enumerate(domains.clinical_patterns())]
    return f"{NOTES}, f AS ({' UNION ALL '.join(parts)}), m AS (SELECT k, m AS text, min_by(type, p) AS type, instr(any_value(t), m)::INTEGER AS start FROM f GROUP BY k, m)"


@query("ext2_clinical_entities", f"{_clinical_sql()} SELECT * FROM m")
def _(spark, d):
    return domains.CLINICAL.entities(notes(spark, d), "k").select("k", "text", "type", "start")


@query("ext3_normalized_names", f"{_clinical_sql()} SELECT k, trim(regexp_replace(regexp_replace(lower(text), '^(the|a|an) ', ''), ' (disease|disorder|syndrome)$', '')) AS name, count(*) AS n FROM m GROUP BY 1, 2")
def _(spark, d):
    return domains.CLINICAL.entities(notes(spark, d), "k").groupBy("k", E.normalized_name(F.col("text")).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query("ext4_gazetteer_entities", f"{SQL}, g AS (SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region), p AS (SELECT p_partkey AS k, p_name || ' from ' || n_name AS t FROM part JOIN nation ON n_nationkey = p_partkey % 25) SELECT k, name AS text, 0.95::DOUBLE AS confidence FROM p JOIN g ON contains(t, name)")
def _(spark, d):
    """Names of a fixed gazetteer in texts made of part and nation names."""
    names = table(spark, d, "nation").select(F.col("n_name").alias("name")).union(table(spark, d, "region").select("r_name"))
    nation = table(spark, d, "nation").select("n_nationkey", "n_name")
    p = table(spark, d, "part").join(F.broadcast(nation), F.col("p_partkey") % 25 == F.col("n_nationkey")).select(F.col("p_partkey").alias("k"), F.concat("p_name", F.lit(" from "), "n_name").alias("text"))
    return E.gazetteer(p, names, "k")


_RUNS = "\\p{Lu}\\p{Ll}+ \\p{Lu}\\p{Ll}+"


@query("ext4_names_of_documents", f"WITH g AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{_RUNS}', 0)) AS name FROM documents UNION SELECT unnest(string_split(p_name, ' ')) FROM part UNION SELECT n_name FROM nation) SELECT doc_id, name AS text, 0.95::DOUBLE AS confidence FROM documents JOIN g ON name <> '' AND contains(text, name)")
def _(spark, d):
    """A gazetteer that grows with the tables: runs of two capitalised words of all texts, words of part names and nations, sought in all texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    runs = docs.select(F.explode(F.regexp_extract_all("text", F.lit(r"\p{Lu}\p{Ll}+ \p{Lu}\p{Ll}+"), F.lit(0))).alias("name"))
    names = runs.union(table(spark, d, "part").select(F.explode(F.split("p_name", " ")))).union(table(spark, d, "nation").select("n_name"))
    return E.gazetteer(docs, names, "doc_id")


@query("ext7_head_entities", f"{_clinical_sql()}, w AS (SELECT k, unnest(list_transform(regexp_split_to_array(t, '\\s+'), lambda x: regexp_replace(x, '[^\\p{{L}}]', '', 'g'))) AS w FROM t WHERE k NOT IN (SELECT k FROM m)), u AS (SELECT k, text FROM m UNION ALL SELECT k, w FROM w WHERE length(w) > 3 AND (regexp_matches(w, '^\\p{{Lu}}') OR regexp_matches(lower(w), 'name'))) SELECT k, count(*) AS n, min(text) AS first FROM u GROUP BY k")
def _(spark, d):
    return domains.head_entities(notes(spark, d), "k", domains.CLINICAL, ["name"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.min("text").alias("first"))


@query("udf3_extraction_hook", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE least(3, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))) END::INTEGER AS n, CASE WHEN coalesce(text, '') = '' THEN 'empty text' END AS error FROM documents")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return domains.extract_with(docs, "doc_id", first_words).select("doc_id", F.size("names").alias("n"), "error")


def first_words(text: str) -> list[str]:
    if not text:
        raise ValueError("empty text")
    return text.split()[:3]


@query("cls4_type_table", f"{_clinical_sql()}, c AS (SELECT type, count(*) AS n FROM m GROUP BY type) SELECT t.type, t.domain, t.category, coalesce(c.n, 0) AS n FROM (VALUES " + ", ".join(f"('{k}', 'clinical', 'clinical')" for k, _ in domains.NAME_ENDS) + ") t(type, domain, category) LEFT JOIN c USING (type)")
def _(spark, d):
    """The domain's types, with the entities of each that its patterns find."""
    found = domains.CLINICAL.entities(notes(spark, d), "k").groupBy("type").agg(F.count(F.lit(1)).alias("n"))
    return domains.CLINICAL.type_table(spark).join(found, "type", "left").select("type", "domain", "category", F.coalesce("n", F.lit(0)).alias("n"))


# What each of the 25 relations asks of its head and its tail, as patterns of whole words.
ASKED = [
    ("TREATS", "drug|medication|medicine|treatment|therapy", "disease|disorder|syndrome|condition|illness"),
    ("CAUSES", "virus|bacteria|gene|mutation|factor|condition", "disease|symptom|disorder|syndrome|condition"),
    ("ASSOCIATED_WITH", ".*", ".*"),
    ("PREVENTS", "vaccine|drug|medication|treatment|prevention", "disease|disorder|syndrome|condition|illness"),
    ("INHIBITS", "drug|medication|protein|enzyme|inhibitor", "protein|enzyme|receptor|pathway|process"),
    ("ACTIVATES", "drug|medication|protein|enzyme|activator", "protein|enzyme|receptor|pathway|process"),
    ("BINDS_TO", "drug|medication|protein|ligand|molecule", "receptor|protein|enzyme|target|binding site"),
    ("INTERACTS_WITH", ".*", ".*"),
    ("REGULATES", "gene|protein|enzyme|hormone|factor", "gene|protein|enzyme|pathway|process"),
    ("EXPRESSES", "gene|genetic|allele|mutation", "protein|enzyme|receptor|hormone"),
    ("LOCATED_IN", "organ|tissue|cell|protein|molecule", "organ|tissue|cell|compartment|location"),
    ("PART_OF", "component|part|element|subunit", "organ|tissue|cell|structure|system"),
    ("DERIVED_FROM", "protein|molecule|compound|product", "gene|protein|precursor|source"),
    ("SYNONYMOUS_WITH", ".*", ".*"),
    ("CONTRAINDICATED_WITH", "drug|medication|medicine|treatment", "disease|disorder|syndrome|condition|illness"),
    ("INDICATES", "symptom|sign|manifestation|marker", "disease|disorder|syndrome|condition|illness"),
    ("MANIFESTS_AS", "disease|disorder|syndrome|condition|illness", "symptom|sign|manifestation|presentation"),
    ("ADMINISTERED_FOR", "drug|medication|medicine|treatment", "disease|disorder|syndrome|condition|illness"),
    ("TARGETS", "drug|medication|medicine|treatment", "protein|enzyme|receptor|pathway|process"),
    ("METABOLIZED_BY", "drug|medication|medicine|compound", "enzyme|protein|cytochrome|metabolizing"),
    ("TRANSPORTED_BY", "molecule|compound|drug|medication", "transporter|protein|carrier|pump"),
    ("SECRETED_BY", "hormone|protein|enzyme|molecule", "gland|organ|tissue|cell|secretory"),
    ("PRODUCED_BY", "protein|hormone|enzyme|molecule", "gene|cell|tissue|organ|producer"),
    ("CONTAINS", "organ|tissue|cell|compartment|structure", "component|part|element|molecule|protein"),
    ("COMPONENT_OF", "component|part|element|subunit|molecule", "organ|tissue|cell|structure|system"),
]
#: Names that hold each word of the validators, and some that only seem to.
END_WORDS = sorted({w for _, h, t in ASKED if h != ".*" for w in f"{h}|{t}".split("|")} | {"web site", "binding", "organs", "éorgan", "drug_x", "partly"})
_WORDS = ", ".join(f"'{w}'" for w in END_WORDS)


def _asks(column: str, words: str) -> str:
    return "true" if words == ".*" else f"regexp_matches(lower({column}), '(?:^|[^\\p{{L}}\\p{{N}}_])(?:{words})(?:$|[^\\p{{L}}\\p{{N}}_])')"


_ASKED = " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) AS n, count_if(head <> '' AND tail <> '' AND head <> tail AND {_asks('head', h)} AND {_asks('tail', t)}) AS valid FROM x" for k, h, t in ASKED)


@query("val3_relation_validators", f"WITH x AS (SELECT 'Alpha ' || [{_WORDS}][(o_orderkey % {len(END_WORDS)})::INTEGER + 1] AS head, [{_WORDS}][(o_custkey % {len(END_WORDS)})::INTEGER + 1] || ' beta' AS tail FROM orders UNION ALL SELECT array_to_string(string_split(coalesce(text, ''), ' ')[1:3], ' '), array_to_string(string_split(coalesce(text, ''), ' ')[4:7], ' ') FROM documents) {_ASKED}")
def _(spark, d):
    """How many pairs of names each of the 25 relations accepts: names of the validators' words, and of the documents' first words."""
    word = lambda c: f"element_at(array({_WORDS}), cast({c} % {len(END_WORDS)} as int) + 1)"
    near = lambda at, n: f"array_join(slice(split(coalesce(text, ''), ' '), {at}, {n}), ' ')"
    names = table(spark, d, "orders").selectExpr(f"concat('Alpha ', {word('o_orderkey')}) AS head", f"concat({word('o_custkey')}, ' beta') AS tail").unionByName(table(spark, d, "documents").selectExpr(f"{near(1, 3)} AS head", f"{near(4, 4)} AS tail"))
    counts = names.agg(F.count(F.lit(1)).alias("n"), *(F.count_if(R.valid_relation(F.col("head"), F.lit(k), F.col("tail"))).alias(k) for k, _, _ in R.ENDS))
    return counts.select("n", F.explode(F.map_from_arrays(F.array(*(F.lit(k) for k, _, _ in R.ENDS)), F.array(*(F.col(k) for k, _, _ in R.ENDS)))).alias("kind", "valid"))


@query("join11_root_position", f"WITH t AS ({ALL_TOKENS}), h AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1))[1:4] AS head FROM part UNION SELECT lower(n_name) FROM nation) SELECT doc_id, head, min(spot)::BIGINT AS root FROM t JOIN h ON contains(token, head) GROUP BY ALL")
def _(spark, d):
    """A triple goes to the first token of the whole text that holds its head."""
    w = table(spark, d, "documents").select("doc_id", F.posexplode(X.words("text")).alias("spot", "token"))
    heads = table(spark, d, "part").select(F.substring(F.lower(F.split("p_name", " ")[0]), 1, 4).alias("head")).union(table(spark, d, "nation").select(F.lower("n_name"))).distinct()
    return J.root_positions(w, heads, "doc_id")


@query("agg13_question_accuracy", "WITH q AS (SELECT DISTINCT item_id, lower(text) AS t FROM benchmark), n AS (SELECT DISTINCT lower(w) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '\\p{L}{6,}')), h AS (SELECT DISTINCT item_id FROM q JOIN n ON contains(t, n)) SELECT count(*) AS questions, count(h.item_id) AS matched, round(count(h.item_id) / count(*), 6) AS accuracy FROM q LEFT JOIN h USING (item_id)")
def _(spark, d):
    names = document_words(spark, d).where(F.col("name").rlike(r"^\p{L}{6,}\z"))
    q = table(spark, d, "benchmark").select("item_id", "text").distinct()
    return V.question_scores(q, names, "text").select("questions", "matched", "accuracy")


@query("agg13_question_kinds", "WITH q AS (SELECT DISTINCT item_id, lower(text) AS t FROM benchmark), n AS (SELECT DISTINCT lower(w) AS n FROM (SELECT unnest(string_split(text, ' ')) AS w FROM documents) WHERE regexp_full_match(w, '\\p{L}{6,}')), a AS (SELECT (SELECT count(DISTINCT item_id) FROM q JOIN n ON contains(t, n)) / (SELECT count(*) FROM q) AS a) SELECT " + ", ".join(f"round(a * {f}::DOUBLE, 6) AS {k}" for k, f in V.QUESTION_FACTORS) + " FROM a")
def _(spark, d):
    names = document_words(spark, d).where(F.col("name").rlike(r"^\p{L}{6,}\z"))
    return V.question_scores(table(spark, d, "benchmark").select("item_id", "text").distinct(), names, "text").select(*(k for k, _ in V.QUESTION_FACTORS))


@query("agg14_combined_benchmark", f"{SQL}, w AS (SELECT DISTINCT item_id, lower(text) AS t FROM benchmark), v AS (SELECT DISTINCT lower(x) AS n FROM (SELECT unnest(string_split(text, ' ')) AS x FROM documents) WHERE regexp_full_match(x, '\\p{{L}}{{6,}}')), a AS (SELECT (SELECT count(DISTINCT item_id) FROM w JOIN v ON contains(t, n)) / (SELECT count(*) FROM w) AS a), k AS (SELECT DISTINCT kb_id AS c FROM entities WHERE kb_id IS NOT NULL AND ord % 2 = 0), b AS (SELECT DISTINCT kb_id AS c FROM entities WHERE kb_id IS NOT NULL AND confidence > 0.4), s AS (SELECT count(*) FILTER (k.c IS NOT NULL AND b.c IS NOT NULL) AS tp, count(*) AS n FROM k FULL JOIN b ON k.c = b.c) SELECT round((round(tp / (n + 1e-8), 6) + (SELECT round(a, 6) FROM a)) / 2, 6) AS accuracy FROM s")
def _(spark, d):
    e = star_kg(spark, d).entities.where("kb_id IS NOT NULL")
    s = A.code_scores(e.where("ord % 2 = 0").select(F.col("kb_id").alias("code")), e.where("confidence > 0.4").select(F.col("kb_id").alias("code")))
    codes = s.select(F.round(F.col("tp") / (F.col("tp") + F.col("fp") + F.col("fn") + 1e-8), 6).alias("accuracy"))
    names = document_words(spark, d).where(F.col("name").rlike(r"^\p{L}{6,}\z"))
    return V.combined_accuracy(codes, V.question_scores(table(spark, d, "benchmark").select("item_id", "text").distinct(), names, "text"))


_VOCABULARY = f"a AS ({ALL_TOKENS}), f AS (SELECT token, row_number() OVER (ORDER BY min(doc_id * 1000000 + spot)) + 4 AS id FROM a GROUP BY token), v AS (SELECT token, id FROM f WHERE id < 30522 UNION ALL SELECT * FROM (VALUES ('<pad>', 0), ('<unk>', 1), ('<cls>', 2), ('<sep>', 3), ('<mask>', 4)) s(token, id))"


def vocabulary(spark, d):
    return VB.build(table(spark, d, "documents"), "doc_id", X.words("text"))


@query("strf5_vocabulary", f"WITH {_VOCABULARY} SELECT token, id FROM v")
def _(spark, d):
    """Special tokens, then words of all texts in order of their first appearance, up to the vocabulary's size."""
    return vocabulary(spark, d)


@query("strf6_masks", "SELECT doc_id, sum(CASE WHEN (length(token) * 31 + unicode(token)) % 7 <> 0 THEN 1 ELSE 0 END)::BIGINT AS ones, count(*) AS n FROM (" + ALL_TOKENS + ") GROUP BY doc_id")
def _(spark, d):
    w = X.words("text")
    ids = F.transform(w, lambda x: (F.length(x) * 31 + F.ascii(x)).cast("long") % 7)
    mask = X.mask_of(ids)
    return table(spark, d, "documents").where(F.size(w) > 0).select("doc_id", F.aggregate(mask, F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"), F.size(mask).cast("long").alias("n"))


@query("strf4_padded_ids", f"WITH {_VOCABULARY}, i AS (SELECT a.doc_id, list(coalesce(v.id, 1) ORDER BY spot) AS ids FROM a LEFT JOIN v ON v.token = a.token WHERE spot < 64 GROUP BY a.doc_id), j AS (SELECT d.doc_id, coalesce(ids, []) AS ids FROM documents d LEFT JOIN i USING (doc_id)) SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(64 - len(ids)), lambda i: 0)), ',') AS ids FROM j")
def _(spark, d):
    """The encoder's row of each text: 64 ids of the built vocabulary."""
    ids = VB.encode(table(spark, d, "documents"), "doc_id", X.words("text"), vocabulary(spark, d), 64, pad=True)
    return ids.select("doc_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query("strf4_round_trip", f"WITH {_VOCABULARY}, e AS (SELECT a.doc_id, count(*) AS n, count_if(v.id IS NULL) AS unknown, string_agg(CASE WHEN v.id > 4 THEN a.token END, ' ' ORDER BY spot) AS text FROM a LEFT JOIN v ON v.token = a.token GROUP BY a.doc_id) SELECT doc_id, coalesce(n, 0) AS n, coalesce(unknown, 0)::BIGINT AS unknown, md5(coalesce(e.text, '')) AS text FROM documents d LEFT JOIN e USING (doc_id)")
def _(spark, d):
    """Whole texts as ids of the built vocabulary and back; unknown words are special and go."""
    words = vocabulary(spark, d)
    ids = VB.encode(table(spark, d, "documents"), "doc_id", X.words("text"), words)
    counts = ids.select("doc_id", F.size("ids").cast("long").alias("n"), F.size(F.filter("ids", lambda x: x == 1)).cast("long").alias("unknown"))
    return counts.join(VB.decode(ids, "doc_id", words), "doc_id").select("doc_id", "n", "unknown", F.md5("text").alias("text"))


@query("strf6_positions", f"SELECT doc_id, count(*) AS n, max(spot)::BIGINT AS last, sum(spot)::BIGINT AS total, 0::BIGINT AS types FROM ({ALL_TOKENS}) GROUP BY doc_id")
def _(spark, d):
    """Positions and token types of each word of whole texts."""
    w = table(spark, d, "documents").select("doc_id", X.words("text").alias("w")).where(F.size("w") > 0)
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x.cast("long"))
    return w.select("doc_id", F.size("w").cast("long").alias("n"), F.array_max(VB.positions(F.col("w"))).cast("long").alias("last"), add(VB.positions(F.col("w"))).alias("total"), add(VB.token_types(F.col("w"))).alias("types"))


@query("strf6_pair_mask", f"WITH a AS ({ALL_TOKENS}), t AS (SELECT doc_id, spot FROM a WHERE spot < 16 AND length(token) % 5 <> 0) SELECT x.doc_id, x.spot::INTEGER AS i, y.spot::INTEGER AS j, 0.0::DOUBLE AS value FROM t x JOIN t y ON y.doc_id = x.doc_id")
def _(spark, d):
    """Pairs of places that may attend to each other, in the encoder's rows of 16 ids; words of 5, 10, ... letters stand for padding."""
    ids = F.transform(F.slice(X.words("text"), 1, 16), lambda x: F.length(x) % 5)
    return VB.pair_mask(table(spark, d, "documents").select("doc_id", ids.alias("ids")), "doc_id")


@query("strf6_batch_masks", f"WITH a AS ({ALL_TOKENS}), n AS (SELECT d.doc_id, count(a.token) AS n FROM documents d LEFT JOIN a USING (doc_id) GROUP BY d.doc_id) SELECT doc_id, doc_id // 32 AS batch, n AS ones, max(n) OVER (PARTITION BY doc_id // 32) AS length FROM n")
def _(spark, d):
    """Whole texts filled up to the longest of their batch of 32 ids."""
    ids = table(spark, d, "documents").select("doc_id", F.transform(X.words("text"), lambda x: F.length(x).cast("long")).alias("ids")).withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))
    full = VB.batch_padded(ids, "doc_id", F.floor(F.col("doc_id") / 32).cast("long"))
    return full.select("doc_id", "batch", F.aggregate("mask", F.lit(0).cast("long"), lambda a, x: a + x).alias("ones"), F.size("ids").cast("long").alias("length"))


@query("seed4_inject_best", f"{SEED}, r AS (SELECT *, row_number() OVER (PARTITION BY head_kb_id ORDER BY score DESC, head, relation, tail) AS r FROM seed) SELECT head_kb_id, relation, tail, score FROM r WHERE r = 1 AND score >= 0.7")
def _(spark, d):
    return A.best_per(seed(spark, d), ["head_kb_id"], "score", ["head", "relation", "tail"], 0.7).select("head_kb_id", "relation", "tail", "score")


@query("trn1_training_rows", f"""WITH t AS ({TOKENS}), l AS (SELECT doc_id, list(token ORDER BY spot) AS w FROM t GROUP BY doc_id), r AS (SELECT doc_id, w, list_transform(range(1, 129), lambda i: coalesce(w[i], 0)) AS roots FROM l),
x AS (SELECT doc_id, list_concat(roots, flatten(list_transform(range(1, 129), lambda i: [CASE WHEN i <= len(w) AND w[i] % 2 = 0 THEN w[i] ELSE 0 END, 0, 0, 0, 0, 0, 0]))) AS ids, list_concat(list_transform(range(1, 129), lambda i: CASE WHEN i <= len(w) THEN 1 ELSE 0 END), flatten(list_transform(range(1, 129), lambda i: list_transform(range(7), lambda j: CASE WHEN i <= len(w) AND w[i] % 2 = 0 THEN 1 ELSE 0 END)))) AS mask FROM r)
SELECT doc_id, len(ids)::INTEGER AS length, md5(array_to_string(ids, ',')) AS ids, md5(array_to_string(mask, ',')) AS mask FROM x""")
def _(spark, d):
    """doc_id, length, digests of ids and mask of chain graphs with a leaf row injected at each root whose token is even."""
    t = tokens(spark, d).withColumnRenamed("at", "root_ix")
    docs = table(spark, d, "documents").where(F.size(X.words("text")) > 0)
    roots = G.chain(docs, "doc_id", F.transform(X.words("text"), lambda x: (F.length(x) * 31 + F.ascii(x)).cast("long")))
    into = t.where("token % 2 = 0").select("doc_id", "root_ix", F.lit(1).alias("ord"), F.lit("r").alias("relation"), F.array("token").alias("tail_tokens"))
    s = G.sequence(G.inject(roots, "doc_id", into), "doc_id")
    digest = lambda c: F.md5(F.array_join(F.transform(c, lambda x: x.cast("string")), ",")).alias(c)
    return s.select("doc_id", F.size("ids").alias("length"), digest("ids"), digest("mask"))


@query("trn3_masked_leaves", f"WITH t AS ({TOKENS}), c AS (SELECT *, count(CASE WHEN token % 2 = 0 THEN 1 END) OVER (PARTITION BY doc_id) AS v, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN token % 2 = 0 THEN {_draw('doc_id', 'spot', 3)} END NULLS LAST, spot) AS r FROM t) SELECT doc_id, count_if(chosen) AS chosen, sum(CASE WHEN chosen THEN token ELSE -100 END)::BIGINT AS labels FROM (SELECT *, token % 2 = 0 AND r <= greatest(1, round_even(v * 0.15::DOUBLE, 0)) AS chosen FROM c) GROUP BY doc_id")
def _(spark, d):
    t = tokens(spark, d).withColumn("at", F.col("at").cast("long"))
    m = T.masked(t, "doc_id", "at", "token", 0.15, seed=3, valid=F.col("token") % 2 == 0)
    return m.groupBy("doc_id").agg(F.count_if(F.col("label") != T.IGNORE).alias("chosen"), F.sum("label").alias("labels"))


@query("trn4_joint_loss", "SELECT event_type, round(avg(value + 0.5 * (event_id % 10)), 6) AS loss FROM events GROUP BY event_type")
def _(spark, d):
    loss = T.joint_loss(F.col("value"), (F.col("event_id") % 10).cast("double"), 0.5)
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.avg(loss), 6).alias("loss"))


@query("str4_memory_advice", "SELECT user_id, max(value) AS peak, CASE WHEN max(value) > 80 THEN 'collect' WHEN max(value) > 50 THEN 'watch' ELSE 'fine' END AS advice FROM events GROUP BY user_id")
def _(spark, d):
    return events.memory_advice(table(spark, d, "events"), "user_id", "value", 80, 50)


@query("snk6_rich_json", f"{SQL}, x AS (SELECT head, relation_type, tail, head_kb, tail_kb FROM ({TRIPLES})) SELECT head, '{{\"relation\":\"' || relation_type || '\",\"tail\":\"' || tail || '\",\"kb\":[\"' || coalesce(head_kb, '') || '\",\"' || coalesce(tail_kb, '') || '\"]}}' AS value FROM x")
def _(spark, d):
    return export.rich_rows(J.triples(star_kg(spark, d)))


@query("snk8_log_rows", "SELECT user_id || ',' || event_type || ',' || event_id AS line FROM events")
def _(spark, d):
    return export.log_rows(table(spark, d, "events"), ["user_id", "event_type", "event_id"])


@query("snk10_drawable_edges", f"{SQL}, p AS (SELECT label, id, row_number() OVER (PARTITION BY label ORDER BY ord) AS place FROM entities) SELECT head, tail, h.place AS head_place, t.place AS tail_place FROM relations JOIN p h ON h.id = head JOIN p t ON t.id = tail")
def _(spark, d):
    kg = star_kg(spark, d)
    p = W.placed(kg.entities, ["label"], ["ord"], "place")
    side = lambda s: p.select(F.col("id").alias(s), F.col("place").alias(f"{s}_place"))
    return kg.relations.join(side("head"), "head").join(side("tail"), "tail").select("head", "tail", "head_place", "tail_place")


@query("udf4_entity_counts_by_document", f"{FOUND} SELECT doc_id, count(*) AS n FROM m GROUP BY doc_id")
def _(spark, d):
    return found(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))


@query("agg_cube_type_by_confidence", f"{SQL} SELECT coalesce(label, 'all') AS label, coalesce(band, -1) AS band, count(*) AS n FROM (SELECT label, CAST(floor(confidence * 4) AS BIGINT) AS band FROM entities) GROUP BY CUBE (label, band)")
def _(spark, d):
    e = star_kg(spark, d).entities.select("label", F.floor(F.col("confidence") * 4).alias("band"))
    return e.cube("label", "band").agg(F.count(F.lit(1)).alias("n")).select(F.coalesce("label", F.lit("all")).alias("label"), F.coalesce("band", F.lit(-1)).cast("long").alias("band"), "n")


@query("src1_text_lengths", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def _(spark, d):
    return prose(spark, d).select("doc_id", F.length("text").cast("long").alias("n"))
