"""Text functions as column expressions (STR-F1..11, WIN-11)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: str | Column) -> Column:
    """Runs of letters, digits and underscores, lower case."""
    return F.array_remove(F.split(F.lower(col(text)), r"[^\p{L}\p{N}_]+"), "")


def sentences(text: str | Column) -> Column:
    """Trimmed pieces between ., ! and ? that are not empty (EXT-13)."""
    return F.filter(F.transform(F.split(col(text), r"[.!?]+"), lambda s: F.trim(F.translate(s, "\n", " "))), lambda s: s != "")


def spans(text: str | Column, pattern: str) -> Column:
    """Distinct matches with the place of their first occurrence: array of start, stop (1-based, inclusive), text."""
    t = col(text)
    found = F.array_distinct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)))
    at = F.arrays_zip(_places(t, found).alias("start"), found.alias("text"))
    return F.transform(at, lambda s: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["text"]) - 1).alias("stop"), s["text"].alias("text")))


@F.arrow_udf(T.ArrayType(T.IntegerType()))
def _places(texts: pa.Array, found: pa.Array) -> pa.Array:
    """Where each of the strings found is first in its text, from 1; a few times faster than locate() for each."""
    return pa.array([None if t is None or f is None else [t.find(m) + 1 for m in f] for t, f in zip(texts.to_pylist(), found.to_pylist())], pa.list_(pa.int32()))


def preprocess(text: str | Column, most: int = 512) -> Column:
    """Trimmed and cut to a length (STR-F1)."""
    return F.substring(F.trim(col(text)), 1, most)


def normalize(text: str | Column) -> Column:
    """Lower case, other than word characters to blanks, blanks as one, trimmed (STR-F1)."""
    plain = F.regexp_replace(F.lower(col(text)), r"[^\p{L}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def sanitize(text: str | Column, most: int = 1000) -> Column:
    """Without control characters, cut to a length (STR-F2)."""
    return F.substring(F.regexp_replace(col(text), r"[\x00-\x1f\x7f-\x9f]", ""), 1, most)


def truncate(text: str | Column, most: int, end: str = "...") -> Column:
    """Cut to a length that counts the end mark (STR-F2)."""
    t = col(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most - len(end)), F.lit(end))).otherwise(t)


def safe_filename(text: str | Column) -> Column:
    """Other than word characters, dots and hyphens as single underscores, none at the ends (STR-F2)."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(col(text), r"[^A-Za-z0-9_.\-]", "_"), r"_+", "_"), r"^_|_$", "")


def clean_article(text: str | Column) -> Column:
    """Blanks as one, only word characters and common stops kept (STR-F3)."""
    return F.regexp_replace(F.regexp_replace(F.trim(col(text)), r"\s+", " "), r"[^\p{L}\p{N}_\s.,;:!?\-]", "")


def padded_ids(tokens: Column, vocabulary: Column, most: int, unknown: int = 1, pad: int = 0) -> Column:
    """Ids of tokens in a map, cut and filled to a length (STR-F4)."""
    ids = F.slice(F.transform(tokens, lambda t: F.coalesce(F.element_at(vocabulary, t), F.lit(unknown))), 1, most)
    return F.concat(ids, F.array_repeat(F.lit(pad), F.greatest(F.lit(0), F.lit(most) - F.size(ids))))


def mask_of(ids: Column, pad: int = 0) -> Column:
    """1 where an id is not padding (STR-F6)."""
    return F.transform(ids, lambda x: (x != pad).cast("int"))


def parse_entities(reply: str | Column) -> Column:
    """Names in the lines of a model's reply (STR-F7)."""
    lines = F.transform(F.split(col(reply), "\n"), lambda t: F.trim(t))
    lines = F.filter(lines, lambda t: (t != "") & ~t.startswith("#") & ~t.startswith("Extracted") & ~t.startswith("Entities"))
    names = F.transform(lines, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, r"^\d+\.?\s*", ""), r"[-*_]", "")))
    return F.array_distinct(F.filter(names, lambda t: F.length(t) > 2))


def parse_relations(reply: str | Column) -> Column:
    """head, relation, tail of lines "A -> REL -> B"; of several with a head, the last (STR-F8)."""
    parts = F.filter(F.transform(F.split(col(reply), "\n"), lambda t: F.split(t, "->")), lambda p: F.size(p) >= 3)
    rows = F.transform(
        parts,
        lambda p: F.struct(
            F.trim(p[0]).alias("head"),
            F.upper(F.regexp_replace(F.trim(F.regexp_replace(p[1], r"[^\p{L}\p{N}_\s]", "")), r"\s+", "_")).alias("relation"),
            F.trim(F.array_join(F.slice(p, 3, F.size(p)), "->")).alias("tail"),
        ),
    )
    heads = F.transform(rows, lambda r: r["head"])
    return F.filter(rows, lambda r, i: ~F.array_contains(F.slice(heads, i + 2, F.size(heads)), r["head"]))


def prompt(task: str, text: str | Column, **more: Column) -> Column:
    """A prompt for entity discovery, relation matching or tail formation (STR-F9)."""
    heads = {
        "entity_discovery": "List the entities in this text, one on a line:",
        "relation_matching": "For the entities given, write relations as head -> RELATION -> tail, one on a line:",
        "tail_formation": "Form the tail entity of this head and relation from the tokens given:",
    }
    if task not in heads:
        raise ValueError(f"no prompt for {task!r}")
    extra = [F.concat(F.lit(f"{k}: "), v) for k, v in more.items()]
    return F.concat_ws("\n", F.lit(heads[task]), *extra, F.concat(F.lit("Text: "), col(text)))


def provenance(value: str | Column) -> Column:
    """document_id and segment_id of "document#segment"; "" and 0 for null (STR-F10)."""
    p = F.split(F.coalesce(col(value), F.lit("")), "#", 2)
    return F.struct(p[0].alias("document_id"), F.coalesce(F.when(F.size(p) > 1, p[1]), F.lit("0")).alias("segment_id"))


def stable_number(word: Column) -> Column:
    """A whole number below 2^60 that follows from a text's MD5: other engines have the same."""
    return F.conv(F.substring(F.md5(word.cast("binary")), 1, 15), 16, 10).cast("long")


def hash_token(word: Column) -> Column:
    """A stable token number of a word (STR-F11): not the number that another system's hash gives."""
    return F.pmod(stable_number(word), F.lit(10000)) + 10
