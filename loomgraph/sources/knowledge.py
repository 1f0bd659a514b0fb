"""A knowledge base as tables: concepts, relations and labels, and what clients ask of it (SRC-10, SRC-11).

concepts: kb_id, name, types (array), and of their own languages labels (map).
relations: src_kb_id, relation_name, dst_kb_id. Names are compared without
case. A base that is not there is empty tables: nothing links, nothing fails.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import rules


@dataclass(frozen=True)
class KnowledgeBase:
    concepts: DataFrame
    relations: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> "KnowledgeBase":
        return KnowledgeBase(spark.createDataFrame([], "kb_id string, name string, types array<string>, labels map<string,string>"), spark.createDataFrame([], "src_kb_id string, relation_name string, dst_kb_id string"))

    def link(self, mentions: DataFrame, column: str = "text") -> DataFrame:
        """mentions with kb_id and types of the concept of their name, null without one; of several, the least id."""
        name = self.concepts.groupBy(F.lower("name").alias("_n")).agg(F.min_by(F.struct("kb_id", "types"), "kb_id").alias("_c"))
        return mentions.join(name, F.lower(column) == F.col("_n"), "left").select(*mentions.columns, F.col("_c.kb_id").alias("kb_id"), F.coalesce("_c.types", F.array().cast("array<string>")).alias("types"))

    def relations_of(self, ids: DataFrame) -> DataFrame:
        """The relations that start at some ids (kb_id), with their kinds for texts."""
        r = self.relations.join(ids.select(F.col("kb_id").alias("src_kb_id")).distinct(), "src_kb_id", "left_semi")
        return r.select("src_kb_id", "relation_name", rules.property_relation(F.col("relation_name")).alias("relation_type"), "dst_kb_id")

    def types_of(self, ids: DataFrame) -> DataFrame:
        """kb_id, types of each id; no types for unknown ones."""
        return ids.select("kb_id").distinct().join(self.concepts.select("kb_id", "types"), "kb_id", "left").select("kb_id", F.coalesce("types", F.array().cast("array<string>")).alias("types"))

    def items(self, ids: DataFrame, language: str = "en") -> DataFrame:
        """kb_id, label in a language (empty if there is none), degree: how many relations start there."""
        degree = self.relations.groupBy(F.col("src_kb_id").alias("kb_id")).agg(F.count(F.lit(1)).alias("degree"))
        c = self.concepts.select("kb_id", F.coalesce(F.element_at("labels", language), F.lit("")).alias("label"))
        return ids.select("kb_id").distinct().join(c, "kb_id", "left").join(degree, "kb_id", "left").select("kb_id", F.coalesce("label", F.lit("")).alias("label"), F.coalesce("degree", F.lit(0).cast("long")).alias("degree"))

    def search(self, text: str, most: int = 10) -> DataFrame:
        """kb_id, name, score: the concepts whose name holds a text, the shortest names first; the score is the share of the name that it is."""
        low = text.lower()
        if not low:
            return self.concepts.limit(0).select("kb_id", "name", F.lit(0.0).alias("score"))
        hit = self.concepts.where(F.lower("name").contains(low))
        return hit.select("kb_id", "name", F.round(F.lit(float(len(low))) / F.length("name"), 6).alias("score")).orderBy(F.desc("score"), "kb_id").limit(most)
