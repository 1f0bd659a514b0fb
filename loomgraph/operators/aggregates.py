"""Statistics and scores of graphs (AGG-1..26)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kg import KG
from . import graph_algorithms, windows


def type_counts(kg: KG) -> DataFrame:
    e = kg.entities.groupBy(F.col("label").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("entity").alias("kind"), "type", "n")
    return e.unionByName(kg.relations.groupBy(F.col("relation_type").alias("type")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("relation").alias("kind"), "type", "n"))


def average_confidence(kg: KG) -> DataFrame:
    """Mean over distinct keys of entities and relations, 0 without any (AGG-2)."""
    keys = kg.entities.select(F.col("id").alias("k"), "confidence").unionByName(kg.relations.select(F.concat_ws("-", "head", "tail", "relation_type").alias("k"), "confidence"))
    return keys.groupBy("k").agg(F.max("confidence").alias("confidence")).agg(F.coalesce(F.round(F.avg("confidence"), 6), F.lit(0.0)).alias("mean"))


def _spread(p: str) -> list[Column]:
    return [F.round(F.avg("confidence"), 6).alias(f"{p}_avg"), F.min("confidence").alias(f"{p}_min"), F.max("confidence").alias(f"{p}_max")]


def analysis(kg: KG) -> DataFrame:
    n = F.count(F.lit(1))
    e = kg.entities.agg(n.alias("entities"), *_spread("e"), F.round(F.count("kb_id") / n, 6).alias("coverage"))
    return e.crossJoin(kg.relations.agg(n.alias("relations"), *_spread("r")))  # one row each


def graph_metrics(kg: KG) -> DataFrame:
    """Counts, density and degrees of the simple directed graph (AGG-4)."""
    arcs = kg.relations.select("head", "tail").distinct()
    nodes = kg.entities.select("id").distinct()
    ends = arcs.select(F.col("head").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), (F.col("head") == F.col("tail")).cast("int").alias("loop")).unionByName(arcs.select(F.col("tail").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), F.lit(0).alias("loop")))
    degree = nodes.join(ends.groupBy("id").agg(F.sum("o").alias("o"), F.sum("i").alias("i"), F.sum("loop").alias("loop")), "id", "left").na.fill(0)
    back = arcs.join(arcs.select(F.col("tail").alias("head"), F.col("head").alias("tail")), ["head", "tail"], "left_semi").agg(F.count(F.lit(1)).alias("mutual"))
    all_ = degree.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("o"), 6).alias("avg_out"), F.max("o").alias("max_out"), F.round(F.avg("i"), 6).alias("avg_in"), F.max("i").alias("max_in"))
    edges = arcs.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("head") == F.col("tail")).alias("loops"))
    total = kg.relations.agg(F.count(F.lit(1)).alias("_r"))
    out = all_.crossJoin(edges).crossJoin(back).crossJoin(total)  # one row each
    return out.select("nodes", "edges", F.round(F.col("_r") / (F.col("nodes") * (F.col("nodes") - 1) / 2.0), 12).alias("density"), "loops", "mutual", "avg_out", "max_out", "avg_in", "max_in")


def recommended(nodes: Column) -> tuple[Column, Column]:
    """Layout and simplification for a graph of so many nodes, taken as connected below 50 (VIZ-3)."""
    layout = F.when(nodes < 10, "circular").when(nodes < 50, "spring").otherwise("stress")
    return layout, F.when(nodes > 1000, "high").when(nodes > 500, "medium").when(nodes > 100, "light").otherwise("none")


def visual_summary(entities: DataFrame) -> DataFrame:
    s = entities.agg(F.count(F.lit(1)).alias("nodes"), F.round(F.avg("confidence"), 6).alias("mean"), F.round(F.stddev_samp("confidence"), 6).alias("std"), F.min("confidence").alias("least"), F.max("confidence").alias("most"))
    layout, simple = recommended(F.col("nodes"))
    return s.withColumn("layout", layout).withColumn("simplification", simple)


def domain_metrics(entities: DataFrame) -> DataFrame:
    t = entities.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.count("kb_id").alias("linked"), F.count_distinct("kb_id").alias("kb_ids"), F.round(F.avg("confidence"), 6).alias("mean"))
    return t.crossJoin(entities.agg(F.count(F.lit(1)).alias("_all"))).select("label", "n", "linked", "kb_ids", "mean", F.round(F.lit(100.0) * F.col("n") / F.col("_all"), 6).alias("percent"))


def factuality(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """total, correct, score of relations marked correct or not (AGG-10)."""
    n = F.count(F.lit(1))
    return checked.groupBy(*by).agg(n.alias("total"), F.count_if("correct").alias("correct"), F.coalesce(F.round(F.count_if("correct") / F.nullif(n, F.lit(0)), 6), F.lit(0.0)).alias("score"))


def code_scores(found: DataFrame, wanted: DataFrame) -> DataFrame:
    """tp, fp, fn, precision, recall and coverage of two sets of codes (AGG-12)."""
    f, w = found.select("code").distinct().withColumn("f", F.lit(1)), wanted.select("code").distinct().withColumn("w", F.lit(1))
    s = f.join(w, "code", "full_outer").agg(F.count_if(F.col("f").isNotNull() & F.col("w").isNotNull()).alias("tp"), F.count_if(F.col("w").isNull()).alias("fp"), F.count_if(F.col("f").isNull()).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return s.select("tp", "fp", "fn", F.round(tp / (tp + fp + 1e-8), 6).alias("prec"), F.round(tp / (tp + fn + 1e-8), 6).alias("rec"), F.round((tp + fp) / (tp + fn), 6).alias("coverage"))


def capture_rate(found: DataFrame, facts: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the facts that were found; 1 without facts (AGG-16)."""
    hit = facts.join(found.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    return hit.agg(F.coalesce(F.round(F.count("_hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), 6), F.lit(1.0)).alias("captured"))


def precision_recall(found: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """prec over the rows found, rec over the rows wanted, f1 (AGG-15); an empty side counts 1 if both are, else 0."""
    def share(rows: DataFrame, others: DataFrame, name: str) -> DataFrame:
        hit = rows.join(others.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
        return hit.agg(F.count("_hit").alias(f"{name}_hit"), F.count(F.lit(1)).alias(f"{name}_all"))

    s = share(found, wanted, "p").crossJoin(share(wanted, found, "r"))  # one row each
    none = F.when((F.col("p_all") == 0) & (F.col("r_all") == 0), 1.0).otherwise(0.0)
    s = s.select(F.coalesce(F.col("p_hit") / F.nullif("p_all", F.lit(0)), none).alias("p"), F.coalesce(F.col("r_hit") / F.nullif("r_all", F.lit(0)), none).alias("r"))
    return s.select(F.round("p", 6).alias("prec"), F.round("r", 6).alias("rec"), F.coalesce(F.round(2 * F.col("p") * F.col("r") / F.nullif(F.col("p") + F.col("r"), F.lit(0.0)), 6), F.lit(0.0)).alias("f1"))


def confidence_ratio(checked: DataFrame) -> DataFrame:
    """Mean confidence of correct rows against that of both kinds, 0.5 if one kind is missing (AGG-17)."""
    s = checked.agg(F.avg(F.when(F.col("correct"), F.col("confidence"))).alias("c"), F.avg(F.when(~F.col("correct"), F.col("confidence"))).alias("w"))
    ratio = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("c") / (F.col("c") + F.col("w") + 1e-10)))
    return s.select(F.round(F.when(F.col("c").isNull() | F.col("w").isNull(), 0.5).otherwise(ratio), 6).alias("auc"))


def summary(rows: DataFrame, by: str, value: str) -> DataFrame:
    """n, mean, least, most, std of a measure for each operation (AGG-20)."""
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), F.round(F.stddev_samp(value), 6).alias("std"))


def clusters(entities: DataFrame, method: str, relations: DataFrame | None = None) -> DataFrame:
    """Entities grouped by type, by tenths of confidence or by component (AGG-23): cluster, n, first_id, last_id.

    Components, of the graph of relations, are numbered from 1 by their first
    entity in order.
    """
    ends = [F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")]
    if method == "connected_components":
        if relations is None:
            raise ValueError("components need relations")
        found = entities.join(_components(KG(entities, relations)), "id").groupBy("component").agg(F.min("ord").alias("_first"), *ends)
        numbered = windows.placed(found.withColumn("_all", F.lit(0)), ["_all"], ["_first"], "_p")
        return numbered.select(F.concat(F.lit("component_"), F.col("_p").cast("string")).alias("cluster"), "n", "first_id", "last_id")
    if method == "entity_type":
        key = F.col("label")
    elif method == "confidence_bins":
        key = F.concat(F.lit("conf_"), (F.floor(F.col("confidence") * 10) / 10).cast("string"))
    else:
        raise ValueError(f"no clustering by {method!r}")
    return entities.groupBy(key.alias("cluster")).agg(*ends)


def _components(kg: KG) -> DataFrame:
    # components drop loops, repeated edges and unknown ends themselves
    edges = kg.relations.select(F.col("head").alias("src"), F.col("tail").alias("dst"))
    return graph_algorithms.components(kg.entities.select("id"), edges)


def _stat(df: DataFrame, statistic: str, value: Column, name: Column | None = None) -> DataFrame:
    return df.select(F.lit(statistic).alias("statistic"), (name if name is not None else F.lit("")).alias("name"), value.cast("double").alias("value"))


def statistics(kg: KG) -> DataFrame:
    """statistic, name, value of a graph (AGG-5): num_entities, num_relations, entity_types and relation_types by name, num_components, is_connected (0 or 1) and average_degree; the last three only where there are entities."""
    n = F.count(F.lit(1))
    e, r = kg.entities, kg.relations
    nodes = e.agg(n.alias("n"))
    parts = _components(kg).agg(F.count_distinct("component").alias("n")).where("n > 0")
    mean = graph_algorithms.degrees(kg).agg(F.avg("degree").alias("mean")).where("mean IS NOT NULL")
    rows = [
        _stat(nodes, "num_entities", F.col("n")),
        _stat(r.agg(n.alias("n")), "num_relations", F.col("n")),
        _stat(e.groupBy("label").agg(n.alias("n")), "entity_types", F.col("n"), F.col("label")),
        _stat(r.groupBy("relation_type").agg(n.alias("n")), "relation_types", F.col("n"), F.col("relation_type")),
        _stat(parts, "num_components", F.col("n")),
        _stat(parts, "is_connected", (F.col("n") == 1).cast("int")),
        _stat(mean, "average_degree", F.col("mean")),
    ]
    return reduce(DataFrame.unionByName, rows)


def drawing_summary(kg: KG) -> DataFrame:
    """statistics() with mean, std, min and max of the confidence of entities and relations (AGG-6)."""
    out = statistics(kg)
    for kind, rows in (("entity", kg.entities), ("relation", kg.relations)):
        c = rows.agg(F.avg("confidence").alias("mean"), F.stddev_samp("confidence").alias("std"), F.min("confidence").alias("min"), F.max("confidence").alias("max"))
        long = c.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(k).cast("double").alias("v")) for k in ("mean", "std", "min", "max")))).alias("x")).where("x.v IS NOT NULL")
        out = out.unionByName(long.select(F.concat(F.lit(f"{kind}_confidence_"), F.col("x.k")).alias("statistic"), F.lit("").alias("name"), F.col("x.v").alias("value")))
    return out


def best_per(rows: DataFrame, keys: list[str], score: str, order: list[str], least: float | None = None) -> DataFrame:
    """The row of the highest score for each key, the first in order among equals; of at least a score (AGG-24)."""
    others = [c for c in rows.columns if c not in keys]
    rank = F.struct((-F.col(score)).alias("_s"), *order)
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*others), rank).alias("_b")).select(*keys, "_b.*")
    return best if least is None else best.where(F.col(score) >= least)


def attention_statistics(cells: DataFrame) -> DataFrame:
    """Numbers of a mask's cells (i, j, v) (AGG-19)."""
    return cells.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("v") != 0).alias("nonzero"), F.count_if(F.col("v") == 0).alias("zero"), F.round(F.min("v"), 9).alias("least"), F.round(F.max("v"), 9).alias("most"), F.round(F.avg("v"), 9).alias("mean"), F.round(F.stddev_samp("v"), 9).alias("std"))


def masked_accuracy(predictions: DataFrame) -> DataFrame:
    """Share of right predictions at counted positions: mask 1 and a label that is not ignored (AGG-22)."""
    use = (F.col("mask") == 1) & (F.col("label") != -100)
    return predictions.where(use).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.round(F.avg((F.col("pred") == F.col("label")).cast("double")), 6), F.lit(0.0)).alias("accuracy"))


def cross_entropy(rows: DataFrame) -> DataFrame:
    """Mean -ln p(label) over labels that are not ignored; logits is an array (AGG-26)."""
    top = F.array_max("logits")
    z = F.log(F.aggregate("logits", F.lit(0.0), lambda a, x: a + F.exp(x - top))) + top
    loss = z - F.element_at("logits", F.col("label").cast("int") + 1)
    return rows.where("label <> -100").agg(F.round(F.avg(loss), 6).alias("loss"), F.count(F.lit(1)).alias("n"))


def partial_and_final(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs and chars of a collection (AGG-21): each task counts its own, then the counts are added."""
    return docs.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum(F.length(text)), F.lit(0).cast("long")).alias("chars"))
