"""A vocabulary by first appearance, texts as ids and back, masks and positions (STR-F4, STR-F5, STR-F6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from . import windows

# Special tokens, by id.
SPECIAL = ["<pad>", "<unk>", "<cls>", "<sep>", "<mask>"]
#: Entries of a vocabulary, special ones too.
VOCABULARY_SIZE = 30_522


def build(texts: DataFrame, key: str, tokens: Column, size: int = VOCABULARY_SIZE) -> DataFrame:
    """token, id of at most `size` entries: the special tokens, then tokens in order of their first appearance by key and place (STR-F5).

    Tokens without an id are unknown. First appearances are found by an
    aggregate and numbered by ranges of their order, so no task sees all.
    """
    each = texts.select(F.col(key).alias("_k"), F.posexplode(tokens).alias("_at", "token"))
    first = each.groupBy("token").agg(F.min(F.struct("_k", "_at")).alias("_f")).where(~F.col("token").isin(SPECIAL))
    placed = windows.placed(first.select("token", F.col("_f._k").alias("_k"), F.col("_f._at").alias("_at"), F.lit(0).alias("_all")), ["_all"], ["_k", "_at"], "_p")
    found = placed.select("token", (F.col("_p") + len(SPECIAL) - 1).cast("long").alias("id")).where(F.col("id") < size)
    return found.unionByName(texts.sparkSession.createDataFrame(list(zip(SPECIAL, range(len(SPECIAL)))), "token string, id long"))


def encode(texts: DataFrame, key: str, tokens: Column, vocabulary: DataFrame, most: int | None = None, pad: bool = False) -> DataFrame:
    """key, ids of each text: its tokens' ids, unknown ones 1, cut to `most` and, with pad, filled up to it with 0 (STR-F4).

    The vocabulary has a bounded size, so it is sent to all executors. Texts
    without tokens have no ids, or padding only.
    """
    each = texts.select(key, F.posexplode(tokens if most is None else F.slice(tokens, 1, most)).alias("_at", "token"))
    known = each.join(F.broadcast(vocabulary.limit(VOCABULARY_SIZE)), "token", "left")
    ids = known.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("_at", F.coalesce("id", F.lit(1).cast("long")).alias("id"))))["id"].alias("ids"))
    out = texts.select(key).join(ids, key, "left").select(key, F.coalesce("ids", F.array().cast("array<long>")).alias("ids"))
    if pad and most is not None:
        out = out.select(key, F.concat("ids", F.array_repeat(F.lit(0).cast("long"), F.lit(most) - F.size("ids"))).alias("ids"))
    return out


def decode(rows: DataFrame, key: str, vocabulary: DataFrame, skip_special: bool = True) -> DataFrame:
    """key, text of (key, ids): the tokens of the ids, joined by blanks, special ones left out unless wanted; ids that no token has count as unknown (STR-F4)."""
    each = rows.select(key, F.posexplode("ids").alias("_at", "id")).join(F.broadcast(vocabulary.limit(VOCABULARY_SIZE)), "id", "left").withColumn("token", F.coalesce("token", F.lit(SPECIAL[1])))
    if skip_special:
        each = each.where(~F.col("token").isin(SPECIAL))
    said = each.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(F.struct("_at", "token")))["token"], " ").alias("text"))
    return rows.select(key).join(said, key, "left").select(key, F.coalesce("text", F.lit("")).alias("text"))


def positions(ids: Column) -> Column:
    """0, 1, 2, ... for each id (STR-F6)."""
    return F.transform(ids, lambda _, i: i)


def token_types(ids: Column) -> Column:
    """0 for each id (STR-F6)."""
    return F.transform(ids, lambda _: F.lit(0))


def pair_mask(rows: DataFrame, key: str, pad: int = 0) -> DataFrame:
    """key, i, j, value for the pairs of places of (key, ids) that may attend to each other: 0 where neither is padding (STR-F6).

    A sparse table: all other pairs of an encoded text are minus infinity. Its
    rows grow with the square of the encoder's length, so ids are cut to that
    length first.
    """
    at = rows.select(key, F.filter(F.transform("ids", lambda x, i: F.when(x != pad, i)), lambda i: i.isNotNull()).alias("_at"))
    return at.select(key, F.explode("_at").alias("i"), "_at").select(key, "i", F.explode("_at").alias("j"), F.lit(0.0).alias("value"))


def batch_padded(rows: DataFrame, key: str, batch: Column) -> DataFrame:
    """key, batch, ids, mask: (key, ids) filled up to the longest of their batch (STR-F4, STR-F6)."""
    each = rows.select(key, "ids", batch.alias("batch"))
    longest = each.groupBy("batch").agg(F.max(F.size("ids")).alias("_n"))
    full = each.join(longest, "batch").select(key, "batch", F.concat("ids", F.array_repeat(F.lit(0).cast("long"), F.col("_n") - F.size("ids"))).alias("ids"))
    return full.select(key, "batch", "ids", X.mask_of(F.col("ids")).alias("mask"))
