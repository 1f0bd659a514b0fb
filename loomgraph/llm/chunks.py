"""Distinct-chunk table: every distinct chunk of text is tokenized once per worker.

Where a tokenizer's tokens start with a space or hold none, the ids of a text
are the ids of its chunks - a space and what follows up to the next - joined by
position. Arrow splits the texts and numbers the distinct chunks; new ones are
encoded together in one call and told apart again by the tokens that start
with the space mark; numpy puts the ids back in place.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Entries of a table before it starts anew: bounds a worker's memory.
MAX_ENTRIES = 1_000_000
_JOINED = 512
#: Stands for the ids of a chunk that must not be encoded apart.
ODD = b"odd"


class ChunkTable:
    """encode(chunks): ids of the text that the chunks make, a space before each.

    starts: for each id, whether its token starts with a space. first: ids of a
    text's first chunk, which no space precedes; None if the tokenizer puts one
    there. odd: chunks in which it is found are not encoded apart.
    """

    def __init__(self, encode: Callable[[list[str]], list[int]], starts: np.ndarray, first: Callable[[str], list[int]] | None, odd: re.Pattern, max_entries: int = MAX_ENTRIES):
        self.encode, self.starts, self.first, self.odd, self.max = encode, starts, first, odd, max_entries
        self.known: dict[str, bytes] = {}
        self.met_odd = False

    def _learn(self, new: list[str]) -> None:
        known, plain = self.known, []
        for chunk in new:
            if self.odd.search(chunk):
                known[chunk], self.met_odd = ODD, True
            elif not chunk:
                known[chunk] = np.asarray(self.encode([chunk]), "<u4").tobytes()
            else:
                plain.append(chunk)
        for at in range(0, len(plain), _JOINED):
            some = plain[at : at + _JOINED]
            ids = np.asarray(self.encode(some), "<u4")
            cut = np.flatnonzero(self.starts[ids])
            if len(cut) != len(some) or cut[0]:
                for chunk in some:
                    known[chunk] = np.asarray(self.encode([chunk]), "<u4").tobytes()
                continue
            raw, ends, begin = ids.tobytes(), [*(cut[1:] * 4).tolist(), len(ids) * 4], 0
            for chunk, end in zip(some, ends):
                known[chunk] = raw[begin:end]
                begin = end

    def encode_all(self, texts: list[str]) -> list[bytes | None]:
        """For each text, its ids as little-endian unsigned 32-bit integers; None for those to encode whole."""
        if len(self.known) > self.max:
            self.known.clear()
        whole = [k for k, t in enumerate(texts) if "  " in t or self.first is None and t[:1] == " "]
        split = pc.split_pattern(pa.array([t if "  " not in t else "" for t in texts], pa.string()), " ")
        offsets = split.offsets.to_numpy()
        flat = split.flatten().dictionary_encode()
        codes, chunks = flat.indices.to_numpy(), flat.dictionary.to_pylist()
        ids = list(map(self.known.get, chunks))
        if new := [k for k, b in enumerate(ids) if b is None]:
            self._learn([chunks[k] for k in new])
            for k in new:
                ids[k] = self.known[chunks[k]]
        odd = [k for k, b in enumerate(ids) if b is ODD] if self.met_odd else []
        for k in odd:
            ids[k] = b""
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin, table = np.cumsum(size) - size, np.frombuffer(b"".join(ids), "<u4")
        size = size[codes]
        if self.first is not None:
            size[offsets[:-1]] = 0  # every text has a first chunk
        ends = np.cumsum(size)
        out = table[np.repeat(begin[codes] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        ends = np.concatenate([[0], ends])[offsets]
        result: list[bytes | None] = [out[a:b].tobytes() for a, b in zip(ends, ends[1:])]
        if self.first is not None:
            result = [np.asarray(self.first(t.partition(" ")[0]), "<u4").tobytes() + b if t else b"" for t, b in zip(texts, result)]
        elif empty := [k for k, t in enumerate(texts) if not t]:
            for k in empty:
                result[k] = b""
        if odd:
            hit = np.isin(codes, odd)
            whole += np.unique(np.searchsorted(offsets, np.flatnonzero(hit), side="right") - 1).tolist()
        for k in whole:
            result[k] = None
        return result
