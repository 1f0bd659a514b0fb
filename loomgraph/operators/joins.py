"""Joins of graphs, texts and knowledge bases (JOIN-1..20)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..kg import KG
from . import phrases


def triples(kg: KG, inner_tail: bool = True) -> DataFrame:
    """head, head_text, head_label, relation_type, tail, tail_text, tail_label, confidence (JOIN-1).

    Relations whose ends are unknown go. With inner_tail=False only the head
    must be known, and an unknown tail stands for its own text (JOIN-3).
    """
    e = kg.entities
    h = e.select(F.col("id").alias("head"), F.col("text").alias("head_text"), F.col("label").alias("head_label"), F.col("kb_id").alias("head_kb"))
    t = e.select(F.col("id").alias("tail"), F.col("text").alias("tail_text"), F.col("label").alias("tail_label"), F.col("kb_id").alias("tail_kb"))
    out = kg.relations.join(h, "head").join(t, "tail", "inner" if inner_tail else "left")
    return out if inner_tail else out.withColumn("tail_text", F.coalesce("tail_text", "tail"))


def resolved(kg: KG) -> DataFrame:
    """Relations with the numbers of their ends, 0 for unknown ones (JOIN-2)."""
    e = kg.entities.select("id", "ord")
    h, t = e.select(F.col("id").alias("head"), (F.col("ord") + 1).alias("head_no")), e.select(F.col("id").alias("tail"), (F.col("ord") + 1).alias("tail_no"))
    out = kg.relations.join(h, "head", "left").join(t, "tail", "left")
    return out.withColumn("head_no", F.coalesce("head_no", F.lit(0))).withColumn("tail_no", F.coalesce("tail_no", F.lit(0)))


def new_tails(entities: DataFrame, rows: DataFrame) -> DataFrame:
    """Entities to add for tails that no entity's text matches, one for each text (JOIN-4)."""
    unknown = rows.select(F.col("tail_text").alias("text")).where(F.col("text").isNotNull()).distinct()
    unknown = unknown.join(entities.select("text"), "text", "left_anti")
    return unknown.select(F.concat(F.lit("tail_"), F.md5("text")).alias("id"), "text", F.lit("UNKNOWN").alias("label"))


def pairs(mentions: DataFrame, key: str) -> DataFrame:
    """Unordered pairs of a text's mentions, in order (JOIN-5): key, a_ord, a_text, a_start, b_ord, b_text, b_start."""
    side = lambda s: mentions.select(key, *(F.col(c).alias(f"{s}_{c}") for c in ("ord", "text", "start")))
    return side("a").join(side("b"), key).where("a_ord < b_ord")


def pair_counts(mentions: DataFrame, key: str) -> DataFrame:
    """How many pairs a text has and the least of them as a/b (JOIN-5): key, pairs, first.

    Nothing is paired: of all pairs of one mention, that with the least later text is the least.
    """
    later = Window.partitionBy(key).orderBy(F.desc("ord")).rowsBetween(Window.unboundedPreceding, -1)
    each = mentions.withColumn("_b", F.min("text").over(later))
    n = F.count(F.lit(1))
    every = each.groupBy(key).agg((n * (n - 1) / 2).cast("long").alias("pairs"), F.min(F.concat("text", F.lit("/"), "_b")).alias("first"))
    return every.where("pairs > 0")


def near_pairs(mentions: DataFrame, key: str, within: int = 200) -> DataFrame:
    """Pairs whose first occurrences are closer than so many characters (JOIN-6).

    Starts are dealt to bins of that width; a pair lies in one bin or in two
    next to each other, so each side meets two bins instead of the whole text.
    """
    own = mentions.select(key, F.floor(F.col("start") / within).cast("long").alias("bin"), *(F.col(c).alias(f"a_{c}") for c in ("ord", "text", "start")))
    bins = F.explode(F.array(F.col("_b") - 1, F.col("_b"), F.col("_b") + 1)).alias("bin")
    other = mentions.withColumn("_b", F.floor(F.col("start") / within).cast("long")).select(key, bins, *(F.col(c).alias(f"b_{c}") for c in ("ord", "text", "start")))
    return own.join(other, [key, "bin"]).where((F.col("a_ord") < F.col("b_ord")) & (F.abs(F.col("a_start") - F.col("b_start")) < within)).drop("bin")


def sentence_pairs(docs: DataFrame, mentions: DataFrame, key: str, sentences: Column) -> DataFrame:
    """In each sentence, the first two mentions that it contains, each ordered pair once for a text (JOIN-7)."""
    s = docs.select(key, F.posexplode(sentences).alias("sentence_no", "sentence"))
    inside = s.join(mentions.select(key, "ord", "text"), key).where(F.col("sentence").contains(F.col("text")))
    rank = F.row_number().over(Window.partitionBy(key, "sentence_no").orderBy("ord", "text"))
    two = inside.withColumn("r", rank).where("r <= 2").groupBy(key, "sentence_no").agg(F.max(F.when(F.col("r") == 1, F.col("text"))).alias("head"), F.max(F.when(F.col("r") == 2, F.col("text"))).alias("tail"))
    first = F.row_number().over(Window.partitionBy(key, "head", "tail").orderBy("sentence_no"))
    return two.where("tail IS NOT NULL").withColumn("r", first).where("r = 1").drop("r")


def word_prefixes(text: Column) -> Column:
    """All leading runs of words of a lower-cased name (WIN-11)."""
    w = F.filter(F.split(F.lower(text), r"\s+"), lambda x: x != "")
    return F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, 1, i), " "))).otherwise(F.array().cast("array<string>"))


def fuzzy_lookup(names: DataFrame, entities: DataFrame) -> DataFrame:
    """name -> id of the entity one of whose word prefixes the name is; of several, the first in order (JOIN-8).

    A name that is no such prefix goes to the first entity in order whose
    lower-cased name holds it. names are in lower case, empty ones find nothing.
    """
    index = entities.select("id", "ord", F.explode(word_prefixes(F.col("text"))).alias("name"))
    best = index.groupBy("name").agg(F.min_by("id", "ord").alias("id"))
    exact = names.join(best, "name")
    rest = names.join(best.select("name"), "name", "left_anti")
    held = phrases.contained(entities.select("id", F.lower("text").alias("text")), rest, "id").join(entities.select("id", "ord"), "id")
    within = held.groupBy("name").agg(F.min_by("id", "ord").alias("id"))
    return exact.unionByName(rest.join(within, "name").select(exact.columns))


def semi(seed: DataFrame, linked: DataFrame) -> DataFrame:
    """Seed triples whose head is a linked knowledge-base id (JOIN-9)."""
    return seed.join(linked.select(F.col("kb_id").alias("head_kb_id")).distinct(), "head_kb_id", "left_semi")


def token_heads(texts: DataFrame, seed: DataFrame) -> DataFrame:
    """Seed triples with some word of some text in their head (JOIN-10).

    Distinct words of at least one letter meet distinct heads by shared grams of
    up to three letters, so the pairs to test are those that can match.
    """
    words = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}\p{N}_]+")).alias("w")).where("w <> ''").distinct()
    heads = seed.select(F.lower("head").alias("h")).distinct()
    gram = lambda c: F.substring(c, 1, 3)
    all_grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("h")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(3)), lambda n: F.substr(F.col("h"), i, n))))
    at = heads.where("h <> ''").select("h", F.explode(F.array_distinct(all_grams)).alias("g"))
    hit = words.withColumn("g", gram("w")).join(at, "g").where(F.col("h").contains(F.col("w"))).select("h").distinct()
    return seed.join(hit, F.lower("head") == F.col("h"), "left_semi")


def in_reference(relations: DataFrame, reference: DataFrame) -> DataFrame:
    """Relations with correct: whether head, type and tail are in the reference (JOIN-12)."""
    keys = ["head", "relation_type", "tail"]
    return relations.join(reference.select(*keys).distinct().withColumn("_in", F.lit(True)), keys, "left").withColumn("correct", F.coalesce("_in", F.lit(False))).drop("_in")


def matched_questions(questions: DataFrame, names: DataFrame, column: str) -> DataFrame:
    """Questions that hold some entity name anywhere in their text (JOIN-13), any case.

    Distinct names meet the questions by their first letters, up to eight, among
    all runs of that many letters of a question, so the pairs to test are few.
    """
    most = 8
    name = names.select(F.lower("name").alias("n")).where("n <> ''").distinct().withColumn("g", F.substring("n", 1, most))
    q = questions.withColumn("_q", F.lower(column)).where("_q <> ''")
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("_q")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.substr(F.col("_q"), i, n))))
    hit = q.select("*", F.explode(F.array_distinct(grams)).alias("_g")).join(name, (F.col("_g") == F.col("g")) & F.col("_q").contains(F.col("n")), "left_semi")
    return questions.join(hit.select(*questions.columns).distinct(), questions.columns, "left_semi")


def root_positions(tokens: DataFrame, heads: DataFrame, key: str) -> DataFrame:
    """key, head, root: the first token (spot, token) of a text that holds each head (JOIN-11).

    Distinct tokens meet distinct heads by the heads' first letters, up to
    three, among all runs of that many letters of a token, so the pairs to
    test are few; texts come in only then, by equal tokens.
    """
    most = 3
    h = heads.select(F.lower("head").alias("head")).where("head <> ''").distinct().withColumn("_g", F.substring("head", 1, most))
    t = tokens.select("token").where("token <> ''").distinct()
    grams = F.flatten(F.transform(F.sequence(F.lit(1), F.length("token")), lambda i: F.transform(F.sequence(F.lit(1), F.lit(most)), lambda n: F.substr(F.col("token"), i, n))))
    hit = t.select("token", F.explode(F.array_distinct(grams)).alias("_g")).join(h, "_g").where(F.col("token").contains(F.col("head"))).select("token", "head").distinct()
    return tokens.join(hit, "token").groupBy(key, "head").agg(F.min("spot").cast("long").alias("root"))


def both_linked(kg: KG) -> DataFrame:
    """Triples both of whose ends have a knowledge-base id (JOIN-14)."""
    return triples(kg).where("head_kb IS NOT NULL AND tail_kb IS NOT NULL")


def at_position(mentions: DataFrame, points: DataFrame, key: str) -> DataFrame:
    """The first mention that covers each point (JOIN-17): key, point, text."""
    m = mentions.select(key, "start", "stop", "text")
    return points.join(m, key).where("start <= point AND point <= stop").groupBy(key, "point").agg(F.min_by("text", F.struct("start", "stop", "text")).alias("text"))


def text_edges(kg: KG) -> DataFrame:
    """Edges between entities by text, the first entity of a text standing for it (JOIN-18): src, dst."""
    first = kg.entities.groupBy("text").agg(F.min("ord").alias("no"))
    r = triples(kg).select("head_text", "tail_text")
    h, t = first.select(F.col("text").alias("head_text"), F.col("no").alias("src")), first.select(F.col("text").alias("tail_text"), F.col("no").alias("dst"))
    return r.join(h, "head_text").join(t, "tail_text").select("src", "dst")


def incident(kg: KG, entity_id: str) -> DataFrame:
    """Relations that start or end at an entity (JOIN-20)."""
    return kg.relations.where((F.col("head") == entity_id) | (F.col("tail") == entity_id))
