"""Queries for readers, writers, model replies and domains."""

from __future__ import annotations


from pyspark.sql import functions as F

from .. import domains
from ..kg import SQL, star_kg, table
from ..operators import evaluation as V
from ..operators import rules as R
from ..sources import export, files
from .domain_queries import NOTES, notes
from .graph_queries import both, both_sql
from .registry import query
from .sink_queries import folder
from .text_queries import _SUPPORT, REL_SQL, RULED, TYPE_SQL, ruled


@query("src2_json_records", "SELECT 'I' || n_nationkey AS icd_code, n_name AS title FROM nation")
def _(spark, d):
    """The 25 nations as a benchmark file: a JSON array, written and read."""
    path = f"{folder(spark)}/codes.json"
    rows = [{"icd_code": f"I{r.n_nationkey}", "title": r.n_name} for r in table(spark, d, "nation").select("n_nationkey", "n_name").collect()]
    files.write_json(spark, path, rows)
    return files.records(spark, path, "icd_code string, title string")


@query("src3_csv_records", "SELECT item_id::VARCHAR AS question, replace(text, chr(10), ' ') AS answer FROM (SELECT DISTINCT item_id, text FROM benchmark)")
def _(spark, d):
    path = f"{folder(spark)}/questions"
    b = table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("question"), F.translate("text", "\n", " ").alias("answer")).distinct()
    b.write.csv(path, header=True)
    return files.records(spark, path, "question string, answer string")


@query("src4_checkpoint_round_trip", "SELECT c_mktsegment AS model_type, count(*)::INTEGER AS model_params, count(DISTINCT c_nationkey)::INTEGER AS hidden, true AS found FROM customer GROUP BY 1 UNION ALL SELECT 'other', NULL, NULL, false")
def _(spark, d):
    """A checkpoint for each market segment, sized by its customers, is written (SNK-9) and read by its type (SRC-4); another type finds nothing."""
    root = folder(spark)
    sizes = table(spark, d, "customer").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("c_nationkey").alias("hidden")).collect()  # five segments
    for r in sizes:
        files.write_json(spark, f"{root}/{r.c_mktsegment}.json", files.checkpoint_of(r.c_mktsegment, r.n, {"hidden": r.hidden}, "2020-01-01T00:00:00"))
    names = [(r.c_mktsegment, r.c_mktsegment) for r in sizes] + [("other", sizes[0].c_mktsegment)] if sizes else []
    got = [(k, files.model_info(spark, f"{root}/{file}.json", k)) for k, file in names]
    rows = [(k, m["model_params"] if m else None, files.nested(m, "config.hidden") if m else None, m is not None) for k, m in got]
    return spark.createDataFrame(rows, "model_type string, model_params int, hidden int, found boolean")


@query("src5_merged_settings", "SELECT 'model.size' AS path, '64' AS value UNION ALL SELECT 'model.depth', (SELECT max(o_orderkey) FROM orders)::VARCHAR UNION ALL SELECT 'model.kinds', (SELECT count(DISTINCT event_type) FROM events)::VARCHAR UNION ALL SELECT 'none', 'default'")
def _(spark, d):
    """Settings of a file, taken from the tables, over the defaults, nested ones one by one; a path that is not there has the default."""
    path = f"{folder(spark)}/config.json"
    depth = table(spark, d, "orders").agg(F.max("o_orderkey")).first()[0]
    kinds = table(spark, d, "events").agg(F.count_distinct("event_type")).first()[0]
    files.write_json(spark, path, {"model": {"depth": depth, "kinds": kinds}})
    c = files.load_config(spark, path, {"model": {"size": 64, "depth": 2}, "rate": 0.1})
    return spark.createDataFrame([(p, str(files.nested(c, p, "default"))) for p in ("model.size", "model.depth", "model.kinds", "none")], "path string, value string")


@query("src6_service_settings", "SELECT 'base_url' AS key, 'http://' || (SELECT min(p_brand) FROM part) AS value UNION ALL SELECT 'max_retries', (SELECT count(DISTINCT o_orderpriority) FROM orders)::VARCHAR UNION ALL SELECT 'rate_limit', '10000' UNION ALL SELECT 'timeout', '30'")
def _(spark, d):
    """A service's settings, two of them taken from the tables; the others are the defaults."""
    path = f"{folder(spark)}/service.json"
    brand = table(spark, d, "part").agg(F.min("p_brand")).first()[0]
    tries = table(spark, d, "orders").agg(F.count_distinct("o_orderpriority")).first()[0]
    files.write_json(spark, path, {"base_url": f"http://{brand}", "max_retries": tries})
    return spark.createDataFrame(sorted((k, str(v)) for k, v in files.api_config(spark, path).items()), "key string, value string")


@query("snk1_formats", f"{SQL}, n AS (SELECT (SELECT count(*) FROM entities) + (SELECT count(*) FROM relations) AS n) SELECT format, CASE WHEN format = 'xyz' THEN -1 ELSE n END AS lines FROM n, (VALUES ('json'), ('csv'), ('rdf'), ('ttl'), ('xyz')) f(format)")
def _(spark, d):
    """Lines that each format writes; a format that there is not is refused."""
    kg, root, rows = star_kg(spark, d), folder(spark), []
    for f in (*export.FORMATS, "xyz"):
        try:
            export.export(kg, f, f"{root}/{f}")
        except ValueError:
            rows.append(spark.range(1).select(F.lit(f).alias("format"), F.lit(-1).cast("long").alias("lines")))
            continue
        if f == "csv":
            n = [spark.read.csv(f"{root}/{f}/{t}", header=True).agg(F.count(F.lit(1)).alias("lines")) for t in ("entities", "relations")]
            n = n[0].union(n[1]).agg(F.sum("lines").alias("lines"))
        else:
            n = spark.read.text(f"{root}/{f}").agg(F.count(F.lit(1)).alias("lines"))
        rows.append(n.select(F.lit(f).alias("format"), "lines"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


@query("udf1_validated_graph", both_sql("SELECT * FROM entities WHERE length(text) >= 2", "SELECT r.* FROM relations r JOIN entities h ON h.id = r.head AND length(h.text) >= 2 JOIN entities t ON t.id = r.tail AND length(t.text) >= 2 WHERE relation_type = 'LOCATED_IN'"))
def _(spark, d):
    return both(domains.GENERAL.validated(star_kg(spark, d)))


@query("udf1_prompts", "SELECT o_orderkey AS k, md5('List the entities in this text, one on a line.' || chr(10) || 'Types: ' || '" + ", ".join(sorted(k for k, _ in R.GENERAL)) + "' || chr(10) || 'Text: ' || o_orderpriority) AS prompt FROM orders")
def _(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.md5(domains.GENERAL.prompt("entity_discovery", F.col("o_orderpriority"))).alias("prompt"))


def _domain_sql(name: str, patterns) -> str:
    parts = " UNION ALL ".join(f"SELECT k, unnest(list_distinct(regexp_extract_all(t, '{pattern}', 0))) AS m FROM t" for _, pattern in patterns)
    return f"SELECT '{name}' AS name, {'true' if name == 'clinical' else 'false'} AS is_default, count(*) AS n FROM (SELECT DISTINCT k, m FROM ({parts}) WHERE length(m) >= 2)"


@query("udf2_registry", f"{NOTES} {_domain_sql('clinical', domains.clinical_patterns())} UNION ALL {_domain_sql('general', R.GENERAL)}")
def _(spark, d):
    """The domains of a registry by name, the default marked, each asked for the entities of the same texts."""
    r = domains.default_registry()
    r.set_default("clinical")
    rows = [r.get(n).entities(notes(spark, d), "k").agg(F.lit(n).alias("name"), F.lit(r.default() is r.get(n)).alias("is_default"), F.count(F.lit(1)).alias("n")) for n in r.names()]
    return rows[0].unionByName(rows[1])


#: Sentences with names of all kinds that the general patterns know, by the numbers of orders.
NAMED = ["John Smith met Mary Ann Jones in Old City", "In March 12, 2001 Bourbon Dynasty College had 1,200 years", "Grand Palace and Paris Museum on 12/05/1999", "nothing here", "Rome Kingdom, 3 centuries; 42.5"]
_N = ", ".join(f"'{x}'" for x in NAMED)


def _general_sql() -> str:
    parts = [f"SELECT k, t, {n} AS p, '{kind}' AS type, unnest(list_distinct(regexp_extract_all(t, '{pattern}', 0))) AS m FROM t" for n, (kind, pattern) in enumerate(R.GENERAL)]
    return f"WITH t AS (SELECT o_orderkey AS k, [{_N}][(o_orderkey % 5)::INTEGER + 1] || '. ' || [{_N}][(o_custkey % 5)::INTEGER + 1] AS t FROM orders), f AS ({' UNION ALL '.join(parts)}) SELECT k, m AS text, min_by(type, p) AS type, instr(any_value(t), m)::INTEGER AS start FROM f WHERE length(m) >= 2 GROUP BY k, m"


@query("ext1_general_patterns", _general_sql())
def _(spark, d):
    pick = lambda c: f"element_at(array({_N}), cast({c} % 5 as int) + 1)"
    t = table(spark, d, "orders").selectExpr("o_orderkey AS k", f"concat({pick('o_orderkey')}, '. ', {pick('o_custkey')}) AS text")
    return domains.GENERAL.entities(t, "k").select("k", "text", "type", "start")


def name_teller():
    """A stand-in for a model: it names every run of two capitalised words of the text that it is asked about."""
    import re

    def run(prompts: list[str]) -> list[str]:
        return ["Entities:\n" + "\n".join(f"{i + 1}. {m}" for i, m in enumerate(re.findall(r"[A-Z][a-z]+ [A-Z][a-z]+", p.partition("Text: ")[2]))) for p in prompts]

    return run


@query("ext5_model_entities", f"{NOTES}, m AS (SELECT k, t, unnest(list_distinct(regexp_extract_all(t, '[A-Z][a-z]+ [A-Z][a-z]+', 0))) AS head FROM t) SELECT k, head AS text, {TYPE_SQL('head')} AS type, instr(t, head)::INTEGER AS start, 0.7::DOUBLE AS confidence, 'model' AS by FROM m".replace(" AS by FROM", ' AS "by" FROM'))
def _(spark, d):
    return domains.CLINICAL.model_entities(notes(spark, d), "k", name_teller).select("k", "text", "type", "start", "confidence", "by")


def judge():
    """A stand-in for a model: yes where a context says treats, no where it says leads, else something else."""

    def run(prompts: list[str]) -> list[str]:
        return ["Yes, it is." if "treats" in p else "NO" if "leads" in p else "It may be so." for p in prompts]

    return run


def _judged(spark, d):
    t = ruled(spark, d).withColumn("relation_type", R.relation_type(F.col("context")))
    return t.select("k", "head", "relation_type", "tail", F.concat_ws(" ", "head", "context", "tail").alias("context"))


@query("eval2_model_support", f"{RULED} SELECT k, contains(context, 'treats') AS supported, 'model' AS \"by\" FROM t")
def _(spark, d):
    return V.model_support(_judged(spark, d), judge).select("k", "supported", "by")


@query("eval2_rule_fallback", f"{RULED}, x AS (SELECT k, head, tail, {REL_SQL} AS rel, concat_ws(' ', head, context, tail) AS c FROM t) SELECT k, contains(lower(c), lower(head)) AND contains(lower(c), lower(tail)) AND {_SUPPORT} AS supported, 'rule' AS \"by\" FROM x")
def _(spark, d):
    """Without a model the keyword rule decides."""
    return V.model_support(_judged(spark, d)).select("k", "supported", "by")


@query("eval2_model_validity", f"{RULED}, x AS (SELECT k, {REL_SQL} AS rel, head, tail FROM t) SELECT k, CASE WHEN contains(head || rel || tail, 'treats') THEN 'yes' WHEN contains(head || rel || tail, 'leads') THEN 'no' ELSE 'maybe' END AS verdict FROM x")
def _(spark, d):
    return V.model_validity(_judged(spark, d), judge).select("k", "verdict")


@query("conf5_even_split", f"{RULED}, v AS (SELECT contains(context, 'treats') AS y FROM t), n AS (SELECT count_if(y) AS yes, count_if(NOT y) AS others, count(*)::DOUBLE AS n FROM v) SELECT yes, others, round(2 * (yes - n / 2) ** 2 / (n / 2), 6) AS statistic FROM n")
def _(spark, d):
    v = ruled(spark, d).select(F.when(F.col("context").contains("treats"), "yes").otherwise("no").alias("verdict"))
    return V.even_split_chi(v, "verdict").select("yes", "others", "statistic")


_ARTICLES = "a AS (SELECT page_id AS article_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, trim(regexp_replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS abstract, CAST(DATE '2019-06-01' + INTERVAL (page_id * 3 % 2000) DAY AS DATE) AS published FROM pages)"
#: Queries with their bounds and orders.
SEARCHES = [("the", "relevance", None, None), ("and of", "relevance", "2020-02-01", "2022-06-30"), ("der", "date", None, "2021-12-31"), ("xyzzy", "relevance", None, None), ("que la", "date", "2020-01-01", None)]


def _search_sql(k: int, query_: str, sort: str, first: str | None, last: str | None) -> str:
    words = query_.split()
    held = " AND ".join([f"contains(abstract, '{w}')" for w in words] + ([f"published >= DATE '{first}'"] if first else []) + ([f"published <= DATE '{last}'"] if last else []))
    score = " + ".join(f"(length(abstract) - length(replace(abstract, '{w}', ''))) / {len(w)}" for w in words)
    order = "score DESC, article_id" if sort == "relevance" else "published DESC, article_id"
    return f"SELECT * FROM (SELECT {k} AS query, row_number() OVER (ORDER BY {order}) AS rank, article_id, title, published, score FROM (SELECT *, CAST({score} AS BIGINT) AS score FROM a WHERE {held})) WHERE rank <= 50"


@query("src8_article_search", f"WITH {_ARTICLES} " + " UNION ALL ".join(_search_sql(k, *s) for k, s in enumerate(SEARCHES)))
def _(spark, d):
    """All pages as an article store, searched through the data source: words and dates are its own filters."""
    import datetime
    from functools import reduce

    from ..sources import articles

    pages = table(spark, d, "pages")
    body = F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]*>", " "), r"\s+", " "))
    made = pages.select(F.col("page_id").alias("article_id"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), body.alias("abstract"), "url", F.expr("date_add(DATE '2019-06-01', cast(page_id * 3 % 2000 as int))").alias("published"))
    path = f"{folder(spark)}/articles"
    articles.write_store(made, path)
    day = lambda x: datetime.date.fromisoformat(x) if x else None
    found = [articles.search(spark, path, q, 50, sort, day(first), day(last)).select(F.lit(k).alias("query"), "rank", "article_id", "title", "published", "score") for k, (q, sort, first, last) in enumerate(SEARCHES)]
    return reduce(lambda a, b: a.unionByName(b), found)


def stand_in(url: str, headers: dict, body: str | None, seconds: float) -> tuple[int, str]:
    """A transport without a network: the reply tells the length of what was asked and where it went."""
    import json

    asked = json.loads(body)
    prompt = asked["prompt"] if "prompt" in asked else asked["messages"][0]["content"]
    said = f"{url.rpartition('/')[2]} {len(prompt)} {asked['model']}"
    if url.endswith("/completions"):
        return 200, json.dumps({"choices": [{"message": {"content": said}}]})
    return 200, json.dumps({"response": said} if url.endswith("/generate") else {"message": {"content": said}})


def _replies(spark, d, kind: str):
    from ..sources import clients

    service = clients.Service(kind, "http://server", "small", rate_limit=10**15)
    prompts = table(spark, d, "documents").select("doc_id", F.concat(F.lit("Summarise: "), F.coalesce("text", F.lit(""))).alias("prompt"))
    return files.complete(prompts, clients.backend(service, stand_in)).select("doc_id", "reply", "error")


_REPLY = "SELECT doc_id, '{} ' || (11 + length(coalesce(text, ''))) || ' small' AS reply, CAST(NULL AS VARCHAR) AS error FROM documents"


@query("src12_remote_replies", _REPLY.format("completions"))
def _(spark, d):
    """Each whole text asked of a remote service through a transport."""
    return _replies(spark, d, "chat")


@query("src14_server_replies", _REPLY.format("generate"))
def _(spark, d):
    """Each whole text asked of a server of one's own."""
    return _replies(spark, d, "generate")


@query("src14_server_dialogues", _REPLY.format("chat"))
def _(spark, d):
    return _replies(spark, d, "dialogue")
