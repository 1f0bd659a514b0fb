"""Factuality, validity, question and graph search scores (AGG-9..18, EVAL-1..4, CONF-4..6, JOIN-15)."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..kg import KG
from ..sources.files import complete
from . import joins, phrases, rules, windows
from .lineage import checkpointed


def support(rows: DataFrame, head: Column, kind: Column, tail: Column, context: Column, by: list[str]) -> DataFrame:
    """total and supported triples (AGG-9)."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("total"), F.count_if(rules.supported(head, kind, tail, context)).alias("supported"))


def kb_validity(triples: DataFrame, allowed: list[str]) -> DataFrame:
    """verdict: unknown unless both ends are linked, else by the relation (EVAL-3)."""
    verdict = F.when(F.col("head_kb").isNull() | F.col("tail_kb").isNull(), "unknown").when(F.col("relation_type").isin(*allowed), "yes").otherwise("no")
    return triples.withColumn("verdict", verdict)


def validity_score(verdicts: DataFrame) -> DataFrame:
    """total, yes, maybe, no, score (AGG-11); 0 without triples."""
    n, count = F.count(F.lit(1)), lambda v: F.count_if(F.col("verdict") == v)
    return verdicts.agg(n.alias("total"), *(count(v).alias(v) for v in ("yes", "maybe", "no")), F.coalesce(F.round(count("yes") / F.nullif(n, F.lit(0)), 6), F.lit(0.0)).alias("score"))


def support_prompt(head: Column, kind: Column, tail: Column, context: Column) -> Column:
    """What a model is asked about a triple and its context (EVAL-2)."""
    return F.concat(F.lit("Is this relationship supported by the context?\n\nRelationship: "), head, F.lit(" --["), kind, F.lit("]--> "), tail, F.lit("\n\nContext: "), context, F.lit("\n\nAnswer YES or NO only:"))


def validity_prompt(head: Column, kind: Column, tail: Column) -> Column:
    """What a model is asked about a triple alone (EVAL-2)."""
    return F.concat(F.lit("Is this relationship valid: do the types of its ends fit it, does it make sense, does nothing known contradict it?\n\nRelationship: "), head, F.lit(" --["), kind, F.lit("]--> "), tail, F.lit("\n\nAnswer YES, MAYBE or NO with a brief reason:"))


def model_support(triples: DataFrame, backend=None) -> DataFrame:
    """triples (head, relation_type, tail, context, ...) with supported and by (EVAL-2).

    A reply that begins with yes supports the triple, any other does not; where
    the model fails, or there is none, the keyword rule decides (EVAL-1).
    """
    head, kind, tail, context = map(F.col, ("head", "relation_type", "tail", "context"))
    asked = complete(triples.withColumn("prompt", support_prompt(head, kind, tail, context)), backend)
    said = F.startswith(F.lower(F.trim("reply")), F.lit("yes"))
    ok = F.when(F.col("error").isNull(), said).otherwise(F.coalesce(rules.supported(head, kind, tail, context), F.lit(False)))
    return asked.select(*triples.columns, ok.alias("supported"), F.when(F.col("error").isNull(), "model").otherwise("rule").alias("by"))


def model_validity(triples: DataFrame, backend=None) -> DataFrame:
    """triples (head, relation_type, tail, ...) with verdict: yes, no or, for any other reply, maybe; unknown where the model fails (EVAL-2)."""
    asked = complete(triples.withColumn("prompt", validity_prompt(F.col("head"), F.col("relation_type"), F.col("tail"))), backend)
    low = F.lower(F.trim("reply"))
    verdict = F.when(F.col("error").isNotNull(), "unknown").when(F.startswith(low, F.lit("yes")), "yes").when(F.startswith(low, F.lit("no")), "no").otherwise("maybe")
    return asked.select(*triples.columns, verdict.alias("verdict"))


# What question kinds and skills keep of the accuracy (AGG-13).
QUESTION_FACTORS = [("reasoning", 0.8), ("knowledge", 0.9), ("diagnosis", 0.9), ("treatment", 0.85), ("symptoms", 0.95), ("complications", 0.8)]


def question_scores(questions: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """questions, matched, accuracy and what each kind of question keeps of it (AGG-13); zeros without questions."""
    keys = questions.columns
    hit = joins.matched_questions(questions, names, column).select(*keys, F.lit(1).alias("_hit"))
    n = F.count(F.lit(1))
    on = [F.col(f"q.{c}").eqNullSafe(F.col(f"h.{c}")) for c in keys]
    s = questions.alias("q").join(hit.distinct().alias("h"), on, "left").agg(n.alias("questions"), F.count("h._hit").alias("matched"), F.coalesce(F.count("h._hit") / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("_a"))
    return s.select("questions", "matched", F.round("_a", 6).alias("accuracy"), *(F.round(F.col("_a") * f, 6).alias(k) for k, f in QUESTION_FACTORS))


def combined_accuracy(*scores: DataFrame) -> DataFrame:
    """accuracy: the mean of one-row accuracies (AGG-14)."""
    each = reduce(DataFrame.unionByName, [s.select(F.col("accuracy").cast("double").alias("accuracy")) for s in scores])
    return each.agg(F.round(F.avg("accuracy"), 6).alias("accuracy"))


def verdict_score(verdict: Column) -> Column:
    return F.when(verdict == "yes", 1.0).when(verdict == "maybe", 0.5).otherwise(0.0)


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function, by Lentz's continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    f = d
    for m in range(1, 500):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + up / (c if abs(c) > tiny else tiny)
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def t_tail(t: float, df: float) -> float:
    """Two-sided tail probability of Student's t."""
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t)) if df > 0 else 1.0


def chi_tail(x: float) -> float:
    """Upper tail probability of chi-square with one degree of freedom."""
    return math.erfc(math.sqrt(max(0.0, x) / 2))


def _with_p(tests: DataFrame, tail: Callable[[float, float], float], alpha: float) -> DataFrame:
    """One row (statistic, df, ...) with p_value and significant in place of df; nothing runs until it is asked for."""
    names = [c for c in tests.columns if c != "df"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [round(tail(t, df), 9) for t, df in zip(batch.column("statistic").to_pylist(), batch.column("df").to_pylist())]
            batch = batch.select(names).append_column("p_value", pa.array(p, pa.float64()))
            yield batch.append_column("significant", pa.array([x < alpha for x in p], pa.bool_()))

    kept = T.StructType([f for f in tests.schema.fields if f.name != "df"])
    return tests.mapInArrow(run, T.StructType([*kept.fields, T.StructField("p_value", T.DoubleType()), T.StructField("significant", T.BooleanType())]))


def _moments(scores: DataFrame, column: str, tag: str = "") -> DataFrame:
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return scores.agg(F.count(column).alias(f"n{tag}"), zero(F.avg(column)).alias(f"m{tag}"), zero(F.stddev_samp(column)).alias(f"s{tag}"))


def one_sample_t(scores: DataFrame, column: str, against: float = 0.5, alpha: float = 0.05) -> DataFrame:
    """One row: n, mean, statistic, effect, p_value, significant of a t-test against a mean (CONF-5); 0 and 1 where scores do not vary."""
    n, m, s = F.col("n"), F.col("m"), F.col("s")
    t = F.when((n > 1) & (s > 0), (m - against) / (s / F.sqrt(n.cast("double")))).otherwise(0.0)
    effect = F.when(s > 0, (m - against) / s).otherwise(0.0)
    row = _moments(scores, column).select("n", F.round(m, 6).alias("mean"), F.round(t, 6).alias("statistic"), F.round(effect, 6).alias("effect"), F.when((n > 1) & (s > 0), n - 1).otherwise(0).cast("double").alias("df"))
    return _with_p(row, t_tail, alpha)


def two_sample_t(a: DataFrame, b: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """One row: difference, statistic, effect, p_value, significant of a pooled t-test of two sets of scores (CONF-5)."""
    both = _moments(a, column, "1").crossJoin(_moments(b, column, "2"))  # one row each
    n1, n2, s1, s2 = (F.col(c).cast("double") for c in ("n1", "n2", "s1", "s2"))
    df = n1 + n2 - 2
    pooled = F.when(df > 0, F.sqrt(((n1 - 1) * s1 * s1 + (n2 - 1) * s2 * s2) / df)).otherwise(0.0)
    d = F.col("m1") - F.col("m2")
    t = F.when(pooled > 0, d / (pooled * F.sqrt(1 / n1 + 1 / n2))).otherwise(0.0)
    row = both.select(F.round(d, 6).alias("difference"), F.round(t, 6).alias("statistic"), F.round(F.when(pooled > 0, d / pooled).otherwise(0.0), 6).alias("effect"), F.when(pooled > 0, df).otherwise(0.0).alias("df"))
    return _with_p(row, t_tail, alpha)


def even_split_chi(verdicts: DataFrame, column: str, alpha: float = 0.05) -> DataFrame:
    """One row: yes, others, statistic, p_value, significant of a chi-square test of yes against an even split (CONF-5)."""
    yes, n = F.count_if(F.col(column) == "yes"), F.count(F.lit(1))
    row = verdicts.agg(yes.alias("yes"), (n - yes).alias("others"), n.cast("double").alias("_n"))
    statistic = F.when(F.col("_n") > 0, 2 * F.pow(F.col("yes") - F.col("_n") / 2, F.lit(2.0)) / (F.col("_n") / 2)).otherwise(0.0)
    row = row.select("yes", "others", F.round(statistic, 6).alias("statistic"), F.lit(1.0).alias("df"))
    return _with_p(row, lambda x, _: chi_tail(x), alpha)


def query_terms(text: str) -> list[str]:
    import re

    return [t for t in re.split(r"[\s\W]+", text.lower()) if len(t) > 2]


def local_search(kg: KG, text: str, most: int = 10) -> DataFrame:
    """The triples that fit a question best: head, relation_type, tail, score (JOIN-15, TOP-6)."""
    terms = list(dict.fromkeys(query_terms(text)))
    t = joins.triples(kg)
    if not terms:
        return t.select("head", "relation_type", "tail", F.lit(0.0).alias("score")).limit(0)

    def share(*columns: str) -> Column:
        low = F.lower(F.concat_ws(" ", *columns))
        hits = reduce(lambda a, b: a + b, [F.when(low.contains(w), 1).otherwise(0) for w in terms])
        return F.least(hits / F.lit(float(len(terms))), F.lit(1.0))

    score = F.round(share("head_text", "head_label") * 0.4 + share("tail_text", "tail_label") * 0.4 + share("relation_type", "head", "tail") * 0.2, 6)
    return t.select("head", "relation_type", "tail", score.alias("score")).where("score > 0.1").orderBy(F.desc("score"), "head", "relation_type", "tail").limit(most)


def graphrag_score(found: DataFrame, most: int = 10) -> DataFrame:
    """score of an answer made of the triples found (CONF-6): 0.6 for how many, 0.4 for its length."""
    sentence = F.concat_ws(" ", "head", F.lower("relation_type"), "tail")
    s = found.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(sentence) + 2).alias("chars"))
    score = F.least(F.col("n") / F.lit(float(most)), F.lit(1.0)) * 0.6 + F.least(F.col("chars") / 100.0, F.lit(1.0)) * 0.4
    return s.select("n", F.when(F.col("n") == 0, 0.0).otherwise(F.round(score, 6)).alias("score"))


def question_answers(kg: KG, questions: DataFrame, most: int = 10) -> DataFrame:
    """id, head, relation_type, tail, score: the best triples for each of questions (id, text), as local_search finds them for one (AGG-18).

    The terms of all questions are looked up at once in the names, labels and
    ids of entities and in the types of relations, not in relations: a term
    has no blank, so it is in one of a relation's parts if it is in them all
    joined by blanks. What no best name and relation could lift over the least
    score goes before relations meet it (an exact bound).
    """
    words = F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 2))
    asked = checkpointed(questions.select("id", words.alias("_w")).where(F.size("_w") > 0).select("id", F.size("_w").cast("double").alias("_of"), F.explode("_w").alias("name")))
    e = kg.entities.select("id", F.lower(F.concat_ws(" ", "text", "label")).alias("_name"), F.lower("id").alias("_id"))
    kinds = kg.relations.select(F.lower("relation_type").alias("_x")).distinct()
    texts = e.select(F.col("_name").alias("_x")).union(e.select("_id")).union(kinds).distinct()
    held = checkpointed(phrases.contained(texts.select("_x", F.col("_x").alias("text")), asked.select("name"), "_x"))
    # texts that hold the same terms are one row for all that questions ask of them
    own = checkpointed(held.groupBy("_x").agg(F.sort_array(F.collect_list("name")).alias("_own")))
    met = own.select("_own").distinct().select("_own", F.explode("_own").alias("name")).join(asked, "name")
    part = checkpointed(met.groupBy("_own", "id", "_of").agg(F.collect_list("name").alias("_terms")))
    n = F.size("_terms") / F.col("_of")
    in_names, in_ids, in_kinds = (own.join(t.select(F.col(c).alias("_x")).distinct(), "_x", "left_semi") for t, c in ((e, "_name"), (e, "_id"), (kinds, "_x")))
    best = lambda of, name: part.join(of.select("_own").distinct(), "_own", "left_semi").groupBy("id").agg(F.max(n).alias(name))
    most_of = asked.select("id").distinct()
    for of, name in ((in_names, "_mn"), (in_ids, "_mi"), (in_kinds, "_mk")):
        most_of = most_of.join(best(of, name), "id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    most_of = checkpointed(most_of.select("id", zero("_mn").alias("_mn"), zero("_mi").alias("_mi"), zero("_mk").alias("_mk")))
    link = F.least(2 * F.col("_mi") + F.col("_mk"), F.lit(1.0))
    bounded = part.join(most_of, "id").withColumn("_n", n)
    least = 0.1 - 1e-6
    wide = F.collect_list(F.struct("id", "_of", "_n", "_terms"))
    by_name = bounded.where(0.4 * F.col("_n") + 0.4 * F.col("_mn") + 0.2 * link > least).groupBy("_own").agg(wide.alias("_q"))
    by_link = bounded.where(0.8 * F.col("_mn") + 0.2 * F.least(F.col("_n") + 2 * F.col("_mi") + F.col("_mk"), F.lit(1.0)) > least).groupBy("_own").agg(wide.alias("_q"))
    asks = lambda of, by, at, to: of.join(by, "_own").select(F.col("_x").alias(at), F.col("_q").alias(to))
    known = e.join(asks(in_names, by_name, "_name", "_qn"), "_name", "left").join(asks(in_ids, by_link, "_id", "_qi"), "_id", "left").select("id", "_qn", "_qi")
    known = checkpointed(known)
    end = lambda at: known.select(F.col("id").alias(at), F.col("_qn").alias(f"_n_{at}"), F.col("_qi").alias(f"_i_{at}"))
    t = kg.relations.select("head", "relation_type", "tail", F.lower("relation_type").alias("_x")).join(asks(in_kinds, by_link, "_x", "_k"), "_x", "left").join(end("head"), "head").join(end("tail"), "tail")
    none = F.array().cast(part.select(F.array(F.struct("id", "_of", n.alias("_n"), "_terms"))).schema[0].dataType)
    or_none = lambda c: F.coalesce(c, none)
    t = t.select("head", "relation_type", "tail", or_none("_n_head").alias("_h"), or_none("_n_tail").alias("_t"), F.concat(or_none("_k"), or_none("_i_head"), or_none("_i_tail")).alias("_r"))
    t = t.where("size(_h) + size(_t) + size(_r) > 0")
    each = t.withColumn("_q", F.explode(F.array_distinct(F.transform(F.concat("_h", "_t", "_r"), lambda s: F.struct(s["id"].alias("id"), s["_of"].alias("_of"))))))
    of = lambda c: F.filter(c, lambda s: s["id"] == F.col("_q.id"))
    share_of = lambda c: F.coalesce(F.get(of(c), 0)["_n"], F.lit(0.0))
    in_link = F.size(F.array_distinct(F.flatten(F.transform(of("_r"), lambda s: s["_terms"])))) / F.col("_q._of")
    score = F.round(share_of("_h") * 0.4 + share_of("_t") * 0.4 + in_link * 0.2, 6)
    found = each.select(F.col("_q.id").alias("id"), "head", "relation_type", "tail", score.alias("score")).where("score > 0.1")
    return windows.top_per(found, ["id"], [F.desc("score"), "head", "relation_type", "tail"], most)


def question_scores_of(kg: KG, questions: DataFrame, most: int = 10) -> DataFrame:
    """id, n, score of the answer to each of questions (id, text); 0 for one without triples (CONF-6)."""
    sentence = F.concat_ws(" ", "head", F.lower("relation_type"), "tail")
    s = question_answers(kg, questions, most).groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(sentence) + 2).alias("chars"))
    score = F.least(F.col("n") / F.lit(float(most)), F.lit(1.0)) * 0.6 + F.least(F.col("chars") / 100.0, F.lit(1.0)) * 0.4
    return questions.select("id").join(s, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.round(score, 6), F.lit(0.0)).alias("score"))


def graphrag_dataset(kg: KG, questions: DataFrame, most: int = 10) -> DataFrame:
    """questions, mean: how many of (id, text) there are and their mean score, 0 without any (AGG-18)."""
    return question_scores_of(kg, questions, most).agg(F.count(F.lit(1)).alias("questions"), F.coalesce(F.round(F.avg("score"), 6), F.lit(0.0)).alias("mean"))
