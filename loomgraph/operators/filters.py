"""Filters and predicates on graphs (FLT-1..13)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kg import KG


def by_confidence(kg: KG, least: float) -> KG:
    """Entities and, apart from them, relations of at least a confidence; relations may lose an end (FLT-1)."""
    if not 0 <= least <= 1:
        raise ValueError("confidence lies between 0 and 1")
    keep = F.col("confidence") >= least
    return KG(kg.entities.where(keep), kg.relations.where(keep), kg.metadata)


def induced(kg: KG, entities: DataFrame, key: str = "id") -> KG:
    """The subgraph on some of the entities: relations with both ends among their keys."""
    ids = entities.select(F.col(key).alias("_id"))
    relations = kg.relations.join(ids, kg.relations["head"] == ids["_id"], "left_semi")
    ids = entities.select(F.col(key).alias("_id2"))
    return KG(entities, relations.join(ids, relations["tail"] == ids["_id2"], "left_semi"), kg.metadata)


def by_entity_type(kg: KG, types: Sequence[str], induce: bool = True) -> KG:
    """Entities of given types; relations among them (FLT-2), or all relations (FLT-3)."""
    kept = kg.entities.where(F.col("label").isin(*types))
    return induced(kg, kept) if induce else KG(kept, kg.relations, kg.metadata)


def touched(entities: DataFrame, relations: DataFrame) -> DataFrame:
    ends = relations.select(F.explode(F.array("head", "tail")).alias("id")).distinct()
    return entities.join(ends, "id", "left_semi")


def by_relation_type(kg: KG, types: Sequence[str]) -> KG:
    """Relations of given types and the entities that they touch (FLT-4)."""
    kept = kg.relations.where(F.col("relation_type").isin(*types))
    return KG(touched(kg.entities, kept), kept, kg.metadata)


def filter_graph(kg: KG, least: float = 0.0, entity_types: Sequence[str] = (), relation_types: Sequence[str] = (), endpoint_key: str = "id") -> KG:
    """Both filters at once, relations with both ends kept; no types mean all (FLT-5)."""
    entities, relations = kg.entities.where(F.col("confidence") >= least), kg.relations.where(F.col("confidence") >= least)
    if entity_types:
        entities = entities.where(F.col("label").isin(*entity_types))
    if relation_types:
        relations = relations.where(F.col("relation_type").isin(*relation_types))
    return induced(KG(entities, relations, kg.metadata), entities, endpoint_key)


def clean(kg: KG, least: float = 0.5, require_provenance: bool = False) -> KG:
    """Relations of at least a confidence and, if asked for, with provenance; entities that they touch (FLT-6)."""
    kept = kg.relations.where(F.col("confidence") >= least)
    if require_provenance:
        kept = kept.where(F.col("provenance").isNotNull() & (F.split("provenance", "#")[0] != ""))
    return KG(touched(kg.entities, kept), kept, kg.metadata)


def subgraph(kg: KG, ids: DataFrame) -> KG:
    """The subgraph on a list of ids (FLT-7)."""
    return induced(kg, kg.entities.join(ids, "id", "left_semi"))


def apply(kg: KG, fn: Callable[[KG], KG]) -> KG:
    """A caller's filter (FLT-8)."""
    return kg.transform(fn)


def violations(kg: KG) -> DataFrame:
    """kind, id of what breaks a graph: empty and repeated ids, unknown ends, loops (FLT-11)."""
    ids = kg.entities.select("id")
    empty = ids.where(F.coalesce(F.trim("id"), F.lit("")) == "").select(F.lit("empty id").alias("kind"), F.coalesce("id", F.lit("")).alias("id"))
    twice = ids.groupBy("id").count().where("count > 1").select(F.lit("repeated id").alias("kind"), "id")
    ends = kg.relations.select(F.explode(F.array("head", "tail")).alias("id")).distinct()
    unknown = ends.join(ids, "id", "left_anti").select(F.lit("unknown end").alias("kind"), "id")
    loops = kg.relations.where("head = tail").select(F.lit("loop").alias("kind"), F.col("head").alias("id"))
    return empty.unionByName(twice).unionByName(unknown).unionByName(loops)


def contradictions(relations: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Relations without a contradicting one between the same ends; the less confident of two goes (an option of FLT-6)."""
    either = [*pairs, *((b, a) for a, b in pairs)]
    other = F.create_map(*(F.lit(x) for p in either for x in p))
    rival = relations.select(F.col("head").alias("_h"), F.col("tail").alias("_t"), F.col("relation_type").alias("_r"), F.col("confidence").alias("_c"))
    clash = (F.col("head") == F.col("_h")) & (F.col("tail") == F.col("_t")) & (F.element_at(other, F.col("relation_type")) == F.col("_r")) & ((F.col("_c") > F.col("confidence")) | ((F.col("_c") == F.col("confidence")) & (F.col("_r") < F.col("relation_type"))))
    return relations.join(rival, clash, "left_anti")


def line_ok(line: Column) -> Column:
    """Lines of a model's reply that may name an entity (FLT-10)."""
    t = F.trim(line)
    return (t != "") & ~t.startswith("#") & ~t.startswith("Extracted") & ~t.startswith("Entities")


#: Token ids that stand for padding, unknown, start and end of a text.
SPECIAL_IDS = (0, 1, 2, 3)


def valid_positions(tokens: Column) -> Column:
    """1-based positions of tokens that are not special (FLT-12)."""
    at = F.transform(tokens, lambda t, i: F.when(~t.isin(*SPECIAL_IDS), i + 1))
    return F.filter(at, lambda i: i.isNotNull())


def without_overlaps(spans: DataFrame, key: str) -> DataFrame:
    """Mentions of each text in order of their starts, less those of which over half lies in an earlier kept one (FLT-13).

    spans: key, start, stop (inclusive), text. The greedy choice is made by one
    fold over a text's sorted spans; a group is one text's spans. As kept ones
    start no later, that which reaches farthest overlaps most, so the fold looks
    at that one stop and not at all kept ones.
    """
    item = F.struct("start", "stop", "text")
    per = spans.groupBy(key).agg(F.sort_array(F.collect_list(item)).alias("s"))
    start = F.expr("named_struct('kept', cast(array() as array<struct<start:int,stop:int,text:string>>), 'far', cast(null as int))")

    def step(state: Column, x: Column) -> Column:
        share = (F.least(state["far"], x["stop"]) - x["start"] + 1) / (x["stop"] - x["start"] + 1)
        hit = (state["far"] > x["start"]) & (share > 0.5)
        more = F.struct(F.concat(state["kept"], F.array(x)).alias("kept"), F.greatest(state["far"], x["stop"]).alias("far"))
        return F.when(hit, state).otherwise(more)

    return per.select(key, F.explode(F.aggregate("s", start, step, lambda state: state["kept"])).alias("m")).select(key, "m.*")
