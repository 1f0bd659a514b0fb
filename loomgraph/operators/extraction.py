"""Mentions and relations from texts (EXT-1..15)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import joins, phrases, rules


def found_in(text: Column, patterns: list[tuple[str, str]], least: int = 2) -> Column:
    """An array of (text, type): each distinct match of a text once, under its first pattern, settled within the row."""
    one = lambda kind, pattern: F.transform(
        F.filter(F.array_distinct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), lambda m: F.length(m) >= least), lambda m: F.struct(m.alias("text"), F.lit(kind).alias("type"))
    )
    return F.flatten(F.array(*(one(k, p) for k, p in patterns)))


def mentions(docs: DataFrame, key: str, patterns: list[tuple[str, str]], confidence=rules.name_confidence, least: int = 2) -> DataFrame:
    """key, text, type, start, stop, confidence, ord: each distinct match once, under its first pattern (EXT-1, 2, 4).

    All patterns run in one pass over a text; nothing is shuffled, as a text's
    mentions are settled within its row. start is the first occurrence.
    """
    every = docs.select(key, "text", found_in(F.col("text"), patterns, least).alias("_all"))
    every = every.withColumn("_texts", F.transform("_all", lambda m: m["text"]))
    first = F.filter("_all", lambda m, i: F.array_position("_texts", m["text"]) == i + 1)
    at = every.select(key, "text", F.posexplode(first).alias("ord", "m")).select(key, F.col("text").alias("_t"), (F.col("ord") + 1).alias("ord"), F.col("m.text").alias("text"), F.col("m.type").alias("type"))
    start = F.call_function("locate", F.col("text"), F.col("_t"))
    return at.select(key, "text", "type", start.alias("start"), (start + F.length("text") - 1).alias("stop"), confidence(F.col("text"), F.col("type")).alias("confidence"), "ord")


def fallback_tokens(text: Column, keywords: list[str]) -> Column:
    """Last resort: tokens of letters longer than three that start upper case or hold a keyword (EXT-6)."""
    tokens = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, r"[^\p{L}]", ""))
    hit = lambda t: F.lower(t).rlike("|".join(keywords)) if keywords else F.lit(False)
    return F.filter(tokens, lambda t: (F.length(t) > 3) & (t.rlike(r"^\p{Lu}") | hit(t)))


def contexts(pairs: DataFrame, docs: DataFrame, key: str, margin: int = 50) -> DataFrame:
    """Pairs of mentions with the text around both (EXT-8)."""
    p = pairs.join(docs.select(key, F.col("text").alias("_t")), key)
    begin = F.greatest(F.lit(1), F.least("a_start", "b_start") - margin)
    end = F.least(F.length("_t"), F.greatest(F.col("a_start") + F.length("a_text"), F.col("b_start") + F.length("b_text")) + margin)
    return p.withColumn("context", F.substr(F.col("_t"), begin, end - begin + 1)).drop("_t")


def pair_relations(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """A relation for each pair of a text's mentions, by the context of both (EXT-8)."""
    p = contexts(joins.pairs(found, key), docs, key).withColumn("relation_type", rules.relation_type(F.col("context")))
    score = rules.relation_confidence(F.col("a_text"), F.col("relation_type"), F.col("b_text"), F.col("context"))
    return p.select(key, F.col("a_text").alias("head"), "relation_type", F.col("b_text").alias("tail"), score.alias("confidence"))


def proximity_relations(docs: DataFrame, found: DataFrame, key: str, within: int = 200) -> DataFrame:
    """Pairs close to each other; the relation by keywords of the text (JOIN-6, EXT-11)."""
    low = F.lower("_t")
    kind = F.when(low.contains("treat"), "TREATS").when(low.contains("cause"), "CAUSES").when(low.contains("prevent"), "PREVENTS").otherwise("RELATED_TO")
    p = joins.near_pairs(found, key, within).join(docs.select(key, F.col("text").alias("_t")), key)
    return p.select(key, F.col("a_text").alias("head"), kind.alias("relation_type"), F.col("b_text").alias("tail"), F.lit(0.5).alias("confidence"))


# Patterns of general relations within a sentence, in order.
SENTENCE_PATTERNS = [
    ("IS_OF", r"(?:was|is)\s+(?:the\s+)?\w+\s+of\s+\w+"),
    ("MARRIED_TO", r"\w+\s+married\s+(?:to\s+)?\w+"),
    ("LOCATED_IN", r"(?:was|is)\s+(?:born\s+in|died\s+in)\s+\w+"),
    ("REIGNED", r"(?:reigned\s+(?:from|until)|ruled)\s+\w+"),
    ("PARENT_OF", r"(?:was|is)\s+(?:the\s+)?(?:father|mother|son|daughter|parent)\s+of\s+\w+"),
]


def sentence_relations(docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The first two mentions of a sentence, related by the first pattern that it holds (EXT-10)."""
    p = joins.sentence_pairs(docs, found, key, X.sentences("text"))
    sentence = docs.select(key, F.posexplode(X.sentences("text")).alias("sentence_no", "sentence"))
    p = p.join(sentence, [key, "sentence_no"])
    kind, score = F.lit("ASSOCIATED_WITH"), F.lit(0.5)
    for name, pattern in reversed(SENTENCE_PATTERNS):
        hit = F.col("sentence").rlike(pattern)
        kind, score = F.when(hit, name).otherwise(kind), F.when(hit, 0.7).otherwise(score)
    return p.select(key, "head", kind.alias("relation_type"), "tail", score.alias("confidence"))


# Patterns of relations between named people, with the groups of their ends.
NAMED_PATTERNS = [
    ("SPOUSE_OF", r"(?i)(Louis XIV)\s+married\s+(Maria Theresa of Spain)"),
    ("SPOUSE_OF", r"(?i)(Marie Antoinette)\s+married\s+(Louis XVI)"),
    ("PARENT_OF", r"(?i)(Louis XIV)\s+.*(?:father|parent)\s+of\s+(Louis XV)"),
    ("PARENT_OF", r"(?i)(Louis XIII)\s+.*(?:father|parent)\s+of\s+(Louis XIV)"),
    ("REIGNED_AFTER", r"(?i)(Louis XIV)\s+(?:reigned|succeeded|ruled)\s+(?:after|following)\s+(Louis XIII)"),
]
#: The people that those patterns name.
NAMED_PEOPLE = ["Louis XIV", "Maria Theresa of Spain", "Marie Antoinette", "Louis XVI", "Louis XV", "Louis XIII"]


def named_relations(docs: DataFrame, key: str, patterns: list[tuple[str, str]] = NAMED_PATTERNS) -> DataFrame:
    """Relations whose ends a pattern's two groups capture, confidence 0.95, in texts that name two people at least (EXT-9)."""
    named = lambda n: F.lower("text").contains(n.lower()).cast("int")
    docs = docs.where(sum((named(n) for n in NAMED_PEOPLE), F.lit(0)) > 1)
    rows = [F.struct(F.lit(k).alias("relation_type"), F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("h"), F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("t")) for k, p in patterns]
    each = docs.select(key, F.explode(F.array(*rows)).alias("r")).select(key, "r.relation_type", F.explode(F.arrays_zip("r.h", "r.t")).alias("z"))
    return each.select(key, F.col("z.h").alias("head"), "relation_type", F.col("z.t").alias("tail"), F.lit(0.95).alias("confidence"))


def triple_context(docs: DataFrame, triples: DataFrame, key: str, most: int = 5) -> DataFrame:
    """Sentences with both ends of a triple, else with either, up to most, joined (EXT-14).

    The sentences of an end are sought once, however many triples it is in.
    """
    s = docs.select(key, X.sentences("text").alias("_s"))
    t = triples.select(key, "head", "relation_type", "tail").distinct()
    ends = t.select(key, F.explode(F.array(F.lower("head"), F.lower("tail"))).alias("_w")).distinct()
    low = s.select(key, F.transform("_s", F.lower).alias("_low"))
    hit = ends.join(low, key).select(key, "_w", F.filter(F.transform("_low", lambda x, i: F.when(x.contains(F.col("_w")), i)), lambda i: i.isNotNull()).alias("_at"))
    side = lambda c: hit.select(F.col(key).alias(f"_{c}_key"), F.col("_w").alias(f"_{c}_w"), F.col("_at").alias(f"_{c}_at"))
    for c in ("head", "tail"):
        t = t.join(side(c), (F.col(key) == F.col(f"_{c}_key")) & F.lower(c).eqNullSafe(F.col(f"_{c}_w")))
    both = F.array_intersect("_head_at", "_tail_at")
    at = F.slice(F.when(F.size(both) > 0, both).otherwise(F.sort_array(F.array_union("_head_at", "_tail_at"))), 1, most)
    t = t.select(key, "head", "relation_type", "tail", at.alias("_at")).where(F.size("_at") > 0).join(s, key)
    return t.select(key, "head", "relation_type", "tail", F.array_join(F.transform("_at", lambda i: F.get("_s", i)), " ").alias("context"))


def tail_names(token_ids: Column) -> Column:
    """Names for the first five tokens of a tail (EXT-12)."""
    return F.transform(F.slice(token_ids, 1, 5), lambda t: F.concat(F.lit("entity_"), t.cast("string")))


def seed_expansion(entities: DataFrame, kb_relations: DataFrame) -> DataFrame:
    """Seed triples of linked entities from a knowledge base's relations, score 0.7 (EXT-15)."""
    linked = entities.where("kb_id IS NOT NULL").select("text", F.col("kb_id").alias("src_kb_id"))
    return linked.join(kb_relations, "src_kb_id").select(F.col("text").alias("head"), rules.property_relation(F.col("relation_name")).alias("relation_type"), F.col("dst_kb_id").alias("tail"), F.lit(0.7).alias("score"))


def normalized_name(text: Column) -> Column:
    """A name in lower case without its article and the word for its kind (EXT-3)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), "^(the|a|an) ", ""), " (disease|disorder|syndrome)$", ""))


def gazetteer(docs: DataFrame, names: DataFrame, key: str, confidence: float = 0.95) -> DataFrame:
    """key, text, confidence: the names of a gazetteer (name) of any size that a text holds (EXT-4)."""
    return phrases.contained(docs, names, key).select(key, F.col("name").alias("text"), F.lit(confidence).alias("confidence"))
