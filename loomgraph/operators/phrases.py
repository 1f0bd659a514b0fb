"""Names of any number found in texts, through an index of short runs of letters (EXT-4, JOIN-8, AGG-18)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import checkpointed

#: Letters of a run; shorter names are runs themselves.
RUN = 4
#: Names, and letters of them, that are sent to all tasks; more meet the texts in joins.
MOST_NAMES, MOST_LETTERS = 30_522, 1 << 20
#: Letters worked on at once, and runs in a batch: bounds of a worker's memory, but for one longer text.
SLICE, OUT = 1 << 19, 1 << 18
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def _letters(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _hashed(letters: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of n letters, the same wherever the run stands; runs that share one are told apart by an exact look later."""
    h = np.full(max(0, len(letters) - n + 1), n, np.uint64)
    for j in range(n if len(h) else 0):
        h = (h ^ letters[j : len(letters) - n + 1 + j].astype(np.uint64)) * _ODD[j]
        h ^= h >> np.uint64(29)
    return h


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of some rows of a column at a time; nulls as empty texts."""
    sizes = pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False)
    start = 0
    while start < len(sizes):
        stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), SLICE)))
        yield start, [t or "" for t in texts.slice(start, stop - start).to_pylist()]
        start = stop


def _runs(texts: DataFrame, key: str, text: str, sizes: list[int] | None) -> DataFrame:
    """key, _run: the distinct runs of each text as numbers, of the sizes given, or of the least of RUN and its own length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found, many = [], [], 0

            def made() -> pa.RecordBatch:
                rows = np.repeat([k for k, _ in at], [n for _, n in at]).astype(np.int64)
                runs = np.concatenate(found) if found else np.zeros(0, np.uint64)
                return pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(rows)), pa.array(runs.view(np.int64))], names=[key, "_run"])

            for first, some in _slices(batch.column(text)):
                for k, t in enumerate(some, first):
                    letters = _letters(t)
                    for n in sizes if sizes is not None else [min(RUN, len(t))]:
                        found.append(np.unique(_hashed(letters, n)))
                        at.append((k, len(found[-1])))
                        many += len(found[-1])
                    if many > OUT:
                        yield made()
                        at, found, many = [], [], 0
            yield made()

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("_run", T.LongType())])
    return texts.select(key, text).mapInArrow(run, schema)


def _sought(texts: DataFrame, names: list[str], key: str, text: str, name: str) -> DataFrame:
    """contained() for names that every task knows: texts and names meet in the task that reads the texts, and no row moves."""
    own = [np.unique(_hashed(_letters(x), min(RUN, len(x)))) for x in names]
    sizes = sorted({min(RUN, len(x)) for x in names})
    wanted = np.unique(np.concatenate(own))
    first = np.concatenate([[0], np.cumsum([len(x) for x in own])[:-1]])
    of = np.searchsorted(wanted, np.concatenate(own))
    stop = np.append(first[1:], len(of))
    seen = np.zeros(1 << 20, bool)  # by the first bits of a run: passes over most that no name has
    seen[(wanted >> np.uint64(44)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, some in _slices(batch.column(text)):
                letters = _letters("\0".join(some))
                ends = np.cumsum([len(t) + 1 for t in some])
                met = []
                for n in sizes:
                    h = _hashed(letters, n)
                    spot = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
                    r = np.minimum(np.searchsorted(wanted, h[spot]), len(wanted) - 1)
                    ok = wanted[r] == h[spot]
                    met.append(r[ok] * len(some) + np.searchsorted(ends, spot[ok], side="right"))
                pairs = np.unique(np.concatenate(met))
                run_of, text_of = pairs // len(some), pairs % len(some)
                uses = np.bincount(run_of, minlength=len(wanted))
                begin = np.concatenate([[0], np.cumsum(uses)])
                at, found = [], []
                for k in np.flatnonzero(np.minimum.reduceat(uses[of], first)):
                    mine = of[first[k] : stop[k]]
                    rare = mine[uses[mine].argmin()]
                    hits = [t for t in text_of[begin[rare] : begin[rare + 1]] if names[k] in some[t]]
                    at += hits
                    found += [names[k]] * len(hits)
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.array(at, np.int64) + start)), pa.array(found, pa.string())], names=[key, name])

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField(name, T.StringType())])
    return texts.select(key, text).mapInArrow(run, schema)


def contained(texts: DataFrame, names: DataFrame, key: str, text: str = "text", name: str = "name") -> DataFrame:
    """key, name: each name that each text holds, anywhere in it and letter by letter.

    Every run of RUN letters of a name is in each text that holds the name, so
    a name is looked up by that run of its own which fewest texts have, and
    then exactly in the texts that are left. No text meets all names. Up to
    MOST_NAMES names go to the tasks that read the texts; more meet them by an
    equi join of runs. Names shorter than RUN are looked up whole. Null and
    empty names match nothing; repeated names count once; a key stands for one
    text.
    """
    known = checkpointed(names.select(F.col(name).alias("_name"), F.col(name).alias("_own")).where("_name <> ''").distinct())
    many, letters = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("_name")), F.lit(0))).first()
    if 0 < many <= MOST_NAMES and letters <= MOST_LETTERS:
        few = sorted(r[0] for r in known.select("_name").collect())  # MOST_NAMES at most
        return _sought(texts.select(F.col(key), F.col(text).alias("_text")), few, key, "_text", name)
    of_names = _runs(known, "_name", "_own", None)
    sizes = sorted(r[0] for r in known.select(F.least(F.length("_name"), F.lit(RUN)).alias("n")).distinct().collect())  # RUN numbers at most
    docs = texts.select(F.col(key).alias("_key"), F.col(text).alias("_text")).where(F.length("_text") > 0)
    of_texts = _runs(docs, "_key", "_text", sizes).join(of_names.select("_run").distinct(), "_run", "left_semi")
    common = of_texts.groupBy("_run").agg(F.count(F.lit(1)).alias("_df"))
    rarest = of_names.join(common, "_run", "left").groupBy("_name").agg(F.min(F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("_run").alias("run"))).alias("_r"))
    pairs = of_texts.join(rarest.where("_r.df > 0").select("_name", F.col("_r.run").alias("_run")), "_run").select("_key", "_name")
    hit = docs.join(pairs, "_key").where(F.col("_text").contains(F.col("_name")))
    return hit.select(F.col("_key").alias(key), F.col("_name").alias(name))
