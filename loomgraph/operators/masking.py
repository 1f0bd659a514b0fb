"""Masked training rows of whole texts: single tokens or spans (TRN-2)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .lineage import small_batches
from .training import IGNORE, MASK, VOCABULARY

_P = 1_000_003
#: Tokens worked on at once: with small batches, what bounds a worker's memory but for one longer text.
SLICE = 1 << 17


def _lists(rows: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(r) for r in rows])]), pa.int32()), pa.array(np.concatenate(rows), pa.int64()))


def draws(seed: int, *keys: np.ndarray | int) -> np.ndarray:
    """Numbers in [0, 1) from whole-number keys: those of training.draw."""
    x = np.int64(seed * 7717 + 12345)
    for k in keys:
        x = (x * 1103 + np.asarray(k, np.int64) * 7919 + 104_729) % _P
    return (x * 48_271) % _P / float(_P)


def span_lengths(key: int, n: int, share: float, least: int, most: int, seed: int) -> np.ndarray:
    """Lengths of a text's spans, drawn until round(n x share) positions are covered; the last is cut to what the text has left."""
    target = int(np.round(n * share))
    if target <= 0:
        return np.zeros(0, np.int64)
    each = least + np.floor(draws(seed, key, np.arange(target)) * (most - least + 1)).astype(np.int64)
    upto = np.cumsum(each)
    k = int(np.searchsorted(upto, target)) + 1  # the first that covers it is the last
    each = each[:k]
    each[-1] -= max(0, int(upto[k - 1]) - n)
    return each[each > 0]


def spans(key: int, n: int, share: float = 0.15, least: int = 1, most: int = 5, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(starts, lengths) of spans of least..most tokens that do not overlap, packed into n tokens by draws.

    Each span has a place among the positions that no span covers; in order of
    these places they are set one after the other, so none is drawn in vain.
    """
    each = span_lengths(key, n, share, least, most, seed)
    free = n - int(each.sum())
    places = np.floor(draws(seed + 1, key, np.arange(len(each))) * (free + 1)).astype(np.int64)
    return np.sort(places) + np.cumsum(each) - each, each


def singles(key: int, n: int, share: float, seed: int) -> np.ndarray:
    """Places of round(n x share) tokens, one at least, of the smallest draws."""
    many = max(1, int(np.round(n * share)))
    return np.sort(np.argsort(draws(seed, key, np.arange(n)), kind="stable")[:many]) if n else np.zeros(0, np.int64)


def masked_texts(texts: DataFrame, key: str, tokens: str, by: str = "spans", share: float = 0.15, least: int = 1, most: int = 5, seed: int = 0) -> DataFrame:
    """key, starts, lengths, input, label of texts (key, an array of token ids): a share of the tokens masked (TRN-2).

    by "spans" masks runs of least..most tokens, by "singles" single tokens; of
    the chosen 80 % become MASK, 10 % another id, 10 % stay, and labels are
    IGNORE elsewhere. Draws follow from key, place and seed, so a run again
    gives the same. A text is masked within its row, whatever its length;
    null and empty texts have empty arrays.
    """
    kind = texts.schema[key].dataType

    def one(k: int, ids: np.ndarray) -> tuple[np.ndarray, ...]:
        n = len(ids)
        if by == "spans":
            starts, lengths = spans(k, n, share, least, most, seed)
            chosen = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        else:
            starts = chosen = singles(k, n, share, seed)
            lengths = np.ones(len(starts), np.int64)
        label, new = np.full(n, IGNORE, np.int64), ids.copy()
        label[chosen] = ids[chosen]
        how = draws(seed + 1, chosen, k) if by == "singles" else draws(seed + 2, chosen, k)
        other = np.floor(draws(seed + 2, k, chosen) * VOCABULARY).astype(np.int64) if by == "singles" else np.floor(draws(seed + 3, k, chosen) * VOCABULARY).astype(np.int64)
        new[chosen] = np.where(how < 0.8, MASK, np.where(how < 0.9, other, ids[chosen]))
        return starts, lengths, new, label

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = batch.column(key), batch.column(tokens)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            start = 0
            while start < len(sizes):
                stop = max(start + 1, start + int(np.searchsorted(np.cumsum(sizes[start:]), SLICE)))
                mine = keys.slice(start, stop - start)
                ids = lists.slice(start, stop - start).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                ends = np.cumsum(sizes[start:stop])
                out = [one(k or 0, ids[e - n : e]) for k, n, e in zip(mine.to_pylist(), sizes[start:stop], ends)]
                yield pa.RecordBatch.from_arrays([mine, *(_lists([o[c] for o in out]) for c in range(4))], names=[key, "starts", "lengths", "input", "label"])
                start = stop

    small_batches(texts.sparkSession)
    many = T.ArrayType(T.LongType())
    return texts.select(key, tokens).mapInArrow(run, T.StructType([T.StructField(key, kind), *(T.StructField(c, many) for c in ("starts", "lengths", "input", "label"))]))
