"""The knowledge graph as two DataFrames, and one built from the star schema's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tables of these kinds fit a broadcast whatever the scale: 5 and 25 rows.
FIXED_TABLES = ("region", "nation")


@dataclass(frozen=True)
class KG:
    """entities(id, text, label, confidence, kb_id, ord); relations(head, relation_type, tail, confidence, provenance).

    ord and (relation_type, head, tail) are the total orders that stand for
    list positions. Operators add columns as they need, and pass others on.
    """

    entities: DataFrame
    relations: DataFrame
    metadata: dict = field(default_factory=dict)

    def transform(self, fn: Callable[["KG"], "KG"]) -> "KG":
        return fn(self)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def score_of(key: Column, factor: int, shift: int) -> Column:
    """A deterministic stand-in for an extractor's confidence: two decimals in [0, 1)."""
    return F.round(((key * factor + shift) % 100) / F.lit(100.0), 2)


def _entities(df: DataFrame, prefix: str, label: str, key: str, name: str, rank: int) -> DataFrame:
    k = F.col(key).cast("long")
    return df.select(
        F.concat(F.lit(prefix), k.cast("string")).alias("id"),
        F.col(name).alias("text"),
        F.lit(label).alias("label"),
        score_of(k, 37, 11 * rank).alias("confidence"),
        F.when(k % 3 == 0, F.concat(F.lit("K"), F.lit(prefix[0]), k.cast("string"))).alias("kb_id"),
        (F.lit(rank).cast("long") * 1_000_000_000_000 + k).alias("ord"),
    )


def _relations(df: DataFrame, head: str, hk: str, kind: str, tail: str, tk: str) -> DataFrame:
    h, t = F.col(hk).cast("long"), F.col(tk).cast("long")
    return df.select(
        F.concat(F.lit(head), h.cast("string")).alias("head"),
        F.lit(kind).alias("relation_type"),
        F.concat(F.lit(tail), t.cast("string")).alias("tail"),
        score_of(h * 31 + t * 17, 1, 0).alias("confidence"),
        F.when((h + t) % 7 != 0, F.concat(F.lit("doc"), ((h + t) % 50).cast("string"), F.lit("#"), (t % 9).cast("string"))).alias("provenance"),
    )


def star_kg(spark: SparkSession, sf_dir: str, lines: str = "l_linenumber = 1") -> KG:
    """Places, parties and parts as entities; where they are, what they supply or order, on such lines of an order, as relations."""
    t = {n: table(spark, sf_dir, n) for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    entities = (
        _entities(t["region"], "R:", "REGION", "r_regionkey", "r_name", 0)
        .unionByName(_entities(t["nation"], "N:", "NATION", "n_nationkey", "n_name", 1))
        .unionByName(_entities(t["supplier"], "S:", "SUPPLIER", "s_suppkey", "s_name", 2))
        .unionByName(_entities(t["customer"], "C:", "CUSTOMER", "c_custkey", "c_name", 3))
        .unionByName(_entities(t["part"], "P:", "PART", "p_partkey", "p_name", 4))
    )
    supplies = t["lineitem"].select("l_suppkey", "l_partkey").distinct()
    ordered = t["lineitem"].where(lines).join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey").distinct()
    relations = (
        _relations(t["nation"], "N:", "n_nationkey", "PART_OF", "R:", "n_regionkey")
        .unionByName(_relations(t["supplier"], "S:", "s_suppkey", "LOCATED_IN", "N:", "s_nationkey"))
        .unionByName(_relations(t["customer"], "C:", "c_custkey", "LOCATED_IN", "N:", "c_nationkey"))
        .unionByName(_relations(supplies, "S:", "l_suppkey", "SUPPLIES", "P:", "l_partkey"))
        .unionByName(_relations(ordered, "C:", "o_custkey", "ORDERED", "P:", "l_partkey"))
    )
    return KG(entities, relations)


def _sql_entity(src: str, prefix: str, label: str, key: str, name: str, rank: int) -> str:
    return f"SELECT '{prefix}' || {key} AS id, {name} AS text, '{label}' AS label, round((({key}::BIGINT * 37 + {11 * rank}) % 100)::DOUBLE / 100, 2) AS confidence, CASE WHEN {key} % 3 = 0 THEN 'K{prefix[0]}' || {key} END AS kb_id, {rank} * 1000000000000 + {key}::BIGINT AS ord FROM {src}"


def _sql_relation(src: str, head: str, h: str, kind: str, tail: str, t: str) -> str:
    return f"SELECT '{head}' || {h} AS head, '{kind}' AS relation_type, '{tail}' || {t} AS tail, round((({h}::BIGINT * 31 + {t}::BIGINT * 17) % 100)::DOUBLE / 100, 2) AS confidence, CASE WHEN ({h} + {t}) % 7 <> 0 THEN 'doc' || (({h} + {t}) % 50) || '#' || ({t} % 9) END AS provenance FROM {src}"


#: The same graph for DuckDB: the start of a WITH clause.
SQL = "WITH RECURSIVE entities AS ({}), relations AS ({})".format(
    " UNION ALL ".join(
        _sql_entity(*x)
        for x in (
            ("region", "R:", "REGION", "r_regionkey", "r_name", 0),
            ("nation", "N:", "NATION", "n_nationkey", "n_name", 1),
            ("supplier", "S:", "SUPPLIER", "s_suppkey", "s_name", 2),
            ("customer", "C:", "CUSTOMER", "c_custkey", "c_name", 3),
            ("part", "P:", "PART", "p_partkey", "p_name", 4),
        )
    ),
    " UNION ALL ".join(
        _sql_relation(*x)
        for x in (
            ("nation", "N:", "n_nationkey", "PART_OF", "R:", "n_regionkey"),
            ("supplier", "S:", "s_suppkey", "LOCATED_IN", "N:", "s_nationkey"),
            ("customer", "C:", "c_custkey", "LOCATED_IN", "N:", "c_nationkey"),
            ("(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)", "S:", "l_suppkey", "SUPPLIES", "P:", "l_partkey"),
            ("(SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1)", "C:", "o_custkey", "ORDERED", "P:", "l_partkey"),
        )
    ),
)
#: The graph with what all lines of orders hold, not their first ones only: star_kg(..., ALL_LINES).
ALL_LINES = "true"
SQL_ALL_LINES = SQL.replace(" WHERE l_linenumber = 1", "")
