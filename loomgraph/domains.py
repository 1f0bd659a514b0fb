"""Domains: what a kind of text has for entities and relations, as columns and tables (UDF-1..4, CLS-4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import text as X
from .kg import KG
from .operators import aggregates, extraction, rules
from .sources.files import complete
from .sources.knowledge import KnowledgeBase

# Words that end the name of an entity of each type.
NAME_ENDS = [
    ("DISEASE", "disease disorder syndrome condition illness pathology"),
    ("DRUG", "drug medication medicine pharmaceutical treatment therapy"),
    ("PROTEIN", "protein enzyme receptor antibody hormone kinase phosphatase transferase"),
    ("GENE", "gene genetic allele mutation variant polymorphism SNP"),
    ("ANATOMY", "organ tissue muscle bone nerve vessel gland organelle membrane nucleus mitochondria"),
    ("SYMPTOM", "symptom sign manifestation complaint pain fever nausea headache"),
    ("PROCEDURE", "procedure surgery operation treatment therapy intervention"),
    ("ORGANISM", "bacteria virus fungus parasite microorganism pathogen organism species"),
    ("CHEMICAL", "chemical compound molecule substance element ion salt acid base"),
    ("CELL_TYPE", "cell tissue line culture strain type kind form variant"),
]
NAMED_TERMS = [("DISEASE", "[Dd]iabetes mellitus"), ("DRUG", "[Mm]etformin")]


def clinical_patterns() -> list[tuple[str, str]]:
    return [(k, rf"[A-Z][a-z]+(?: [A-Z][a-z]+)* (?:{'|'.join(w.split())})") for k, w in NAME_ENDS] + NAMED_TERMS


@dataclass(frozen=True)
class Domain:
    """Patterns and rule columns of a kind of text; nothing here runs row by row."""

    name: str
    patterns: list[tuple[str, str]]
    entity_confidence: Callable[[Column, Column], Column]
    relation_type: Callable[[Column], Column]
    relation_confidence: Callable[[Column, Column, Column, Column], Column]
    types: dict[str, dict[str, str]] = field(default_factory=dict)
    valid_entity: Callable[[Column, Column], Column] = rules.plain_entity
    valid_relation: Callable[[Column, Column, Column], Column] = rules.plain_relation
    entity_type: Callable[[Column], Column] | None = None
    prompts: dict[str, str] = field(default_factory=dict)

    def prompt(self, task: str, text: Column) -> Column:
        """What a model is asked for a task about a text; a task that the domain has no words for is an error."""
        if task not in self.prompts:
            raise ValueError(f"domain {self.name!r} has no prompt for {task!r}")
        return F.concat(F.lit(self.prompts[task] + "\nTypes: " + ", ".join(sorted(self.types)) + "\nText: "), text)

    def validated(self, kg: KG) -> KG:
        """The entities and relations that the domain's rules accept; relations whose ends go, go with them."""
        e = kg.entities.where(self.valid_entity(F.col("text"), F.col("label")))
        ends = e.select("id")
        r = kg.relations.where(self.valid_relation(F.col("head"), F.col("relation_type"), F.col("tail")))
        r = r.join(ends.withColumnRenamed("id", "head"), "head", "left_semi").join(ends.withColumnRenamed("id", "tail"), "tail", "left_semi")
        return KG(e, r.select(*kg.relations.columns), kg.metadata)

    def metrics(self, kg: KG) -> DataFrame:
        """Numbers of a graph by type of entity (AGG-7)."""
        return aggregates.domain_metrics(kg.entities)

    def linked(self, mentions: DataFrame, base: KnowledgeBase) -> DataFrame:
        return base.link(mentions)

    def seed_triples(self, entities: DataFrame, base: KnowledgeBase) -> DataFrame:
        """Seed triples of linked entities from a knowledge base (EXT-15)."""
        return extraction.seed_expansion(entities, base.relations)

    def model_entities(self, docs: DataFrame, key: str, backend=None) -> DataFrame:
        """key, text, type, start, stop, confidence, by: entities that a model names, one in a line of its reply (EXT-5).

        Their confidence is 0.7 and their type the domain's rule; start is the
        first place in the text, 1 for a name that is not in it. Where the
        model fails, or there is none, the domain's own patterns are used.
        """
        asked = complete(docs.select(key, "text", self.prompt("entity_discovery", F.coalesce("text", F.lit(""))).alias("prompt")), backend)
        # one reply of a text decides on one branch: the model is asked once, in the one pass over its replies
        named = F.transform(F.array_distinct(X.parse_entities("reply")), lambda m: F.struct(m.alias("text"), F.lit(None).cast("string").alias("type")))
        own = extraction.found_in(F.coalesce("text", F.lit("")), self.patterns)
        found = asked.select(key, F.col("text").alias("_t"), F.col("error").isNull().alias("_by"), F.when(F.col("error").isNull(), named).otherwise(own).alias("_m"))
        first = F.filter("_m", lambda m, i: F.array_position(F.transform("_m", lambda x: x["text"]), m["text"]) == i + 1)
        found = found.select(key, "_t", "_by", F.explode(first).alias("_m"))
        name = F.col("_m.text")
        at = F.coalesce(F.call_function("locate", name, F.col("_t")), F.lit(0))
        start = F.greatest(at, F.lit(1))
        kind = F.when(F.col("_by"), self.entity_type(name) if self.entity_type else F.lit("UNKNOWN")).otherwise(F.col("_m.type"))
        score = F.when(F.col("_by"), F.lit(0.7)).otherwise(self.entity_confidence(name, F.col("_m.type")))
        return found.select(key, name.alias("text"), kind.alias("type"), start.alias("start"), (start + F.length(name) - 1).alias("stop"), score.alias("confidence"), F.when(F.col("_by"), "model").otherwise("rule").alias("by"))

    def entities(self, docs: DataFrame, key: str) -> DataFrame:
        return extraction.mentions(docs, key, self.patterns, self.entity_confidence)

    def relations(self, docs: DataFrame, found: DataFrame, key: str) -> DataFrame:
        return extraction.pair_relations(docs, found, key)

    def type_table(self, spark: SparkSession) -> DataFrame:
        """type, domain, category of each entity type (CLS-4)."""
        rows = [(k, self.name, v.get("category", "")) for k, v in sorted(self.types.items())]
        return spark.createDataFrame(rows, "type string, domain string, category string")


# What a model is asked for.
_ASK = {"entity_discovery": "List the entities in this text, one on a line.", "relation_matching": "Relate the entities in this text, one relation on a line: A -> RELATION -> B."}
GENERAL = Domain("general", rules.GENERAL, rules.name_confidence, rules.relation_type, rules.relation_confidence, {k: {"category": "name"} for k, _ in rules.GENERAL}, prompts=_ASK)
CLINICAL = Domain("clinical", clinical_patterns(), rules.entity_confidence, rules.relation_type, rules.relation_confidence, {k: {"category": "clinical"} for k, _ in NAME_ENDS}, rules.valid_entity, rules.valid_relation, rules.entity_type, _ASK)


class Registry:
    """Domains by name; the first is the default until another is set (UDF-2)."""

    def __init__(self) -> None:
        self._domains: dict[str, Domain] = {}
        self._default: str | None = None

    def register(self, domain: Domain) -> None:
        self._domains[domain.name] = domain
        self._default = self._default or domain.name

    def get(self, name: str) -> Domain | None:
        return self._domains.get(name)

    def names(self) -> list[str]:
        return sorted(self._domains)

    def set_default(self, name: str) -> None:
        if name not in self._domains:
            raise ValueError(f"no domain {name!r}")
        self._default = name

    def default(self) -> Domain | None:
        return self._domains.get(self._default) if self._default else None


def default_registry() -> Registry:
    r = Registry()
    r.register(GENERAL)
    r.register(CLINICAL)
    return r


def extract_with(docs: DataFrame, key: str, fn: Callable[[str], list[str]]) -> DataFrame:
    """key, names, error: a caller's function of each text; a text that fails has its error (UDF-3).

    The function is the caller's and runs text by text in Python: the one slow
    path of the engine, for what patterns cannot say.
    """
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, errors = [], []
            for text in batch.column("text").to_pylist():
                try:
                    names.append(fn(text or ""))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    names.append([])
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(names, pa.list_(pa.string())), pa.array(errors, pa.string())], [key, "names", "error"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("names", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())])
    return docs.select(key, "text").mapInArrow(run, schema)


def head_entities(docs: DataFrame, key: str, domain: Domain, keywords: list[str]) -> DataFrame:
    """key, text, confidence: the domain's entities; for texts without any, their last-resort tokens at 0.5 (EXT-7)."""
    found = domain.entities(docs, key).select(key, "text", "confidence")
    rest = docs.join(found.select(key).distinct(), key, "left_anti")
    tokens = rest.select(key, F.explode(extraction.fallback_tokens(F.col("text"), keywords)).alias("text"), F.lit(0.5).alias("confidence"))
    return found.unionByName(tokens)
