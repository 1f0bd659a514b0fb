"""Weighted word shingles and their ProbMinHash signatures, whole batches at a time in numpy.

A word is a run of letters, digits and underscores of the lower-cased text. A
shingle is five words in a row; a text of fewer words is one shingle, a text
without words has none. A shingle that occurs n times weighs 1 + ln n.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np

WORDS = 5
_M1, _M2, _P, _Q = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
_INVERSE = np.uint64(pow(int(_P), -1, 1 << 64))
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95, *range(128, 256)]] = True
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        have = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 1 << 16), base, np.uint64)]))
        if n <= 1 << 21:  # tables for one very long text are not kept
            _powers[int(base)] = have
    return have[:n]


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, hash) of each word, in order."""
    parts = []
    for t in texts:
        t = (t or "").lower()
        if not t.isascii():
            t = _OTHER.sub(" ", t)
        parts.append(t.encode("utf-8", "replace"))
    size = np.array([len(p) + 1 for p in parts], np.int64)
    raw = np.frombuffer(b"\n".join([*parts, b""]), np.uint8)
    if not len(raw):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    is_word = _IS_WORD[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], is_word, [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _power(_P, len(raw)), dtype=np.uint64)])
    value = (total[end] - total[begin]) * _power(_INVERSE, len(raw))[begin]
    return np.searchsorted(np.cumsum(size), begin, side="right"), mix(value ^ (end - begin).astype(np.uint64))


def shingle_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(text number, hash) of each shingle, and a key of each text: equal for equal rows of words, or equal texts without words."""
    doc, word = word_hashes(texts)
    count = np.bincount(doc, minlength=len(texts))
    first = np.cumsum(count) - count
    keys = []
    for k, t in enumerate(texts):
        if count[k]:
            keys.append(hashlib.md5(word[first[k] : first[k] + count[k]].tobytes()).digest())
        else:
            keys.append(hashlib.md5(b"no words:" + (t or "").encode("utf-8", "replace")).digest())
    n = len(word) - WORDS + 1
    if n > 0:
        h = np.zeros(n, np.uint64)
        for k in range(WORDS):
            h = (h + word[k : k + n]) * _Q
        keep = doc[:n] == doc[WORDS - 1 :]
        at, h = doc[:n][keep], mix(h[keep])
    else:
        at, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        extra = np.array([int.from_bytes(keys[k][:8], "little") for k in short], np.uint64)
        at, h = np.concatenate([at, short]), np.concatenate([h, extra])
    return at, h, keys


def weighted(at: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, hash, count) of each distinct shingle of each text, by text and hash."""
    order = np.lexsort((h, at))
    at, h = at[order], h[order]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (h[1:] != h[:-1])])) if len(at) else np.zeros(0, np.int64)
    return at[new], h[new], np.diff(np.concatenate([new, [len(at)]]))


def weight(count: np.ndarray) -> np.ndarray:
    return 1.0 + np.log(count)


def prob_min_hash(at: np.ndarray, h: np.ndarray, w: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """ProbMinHash signatures, one row for each text: register values agree with the probability Jaccard similarity.

    Each shingle is a Poisson process of its weight's rate. Every arrival goes
    to a random register, which keeps the shingle of its earliest arrival. A
    shingle ends as soon as its next arrival is later than all of its text's
    registers hold.
    """
    t = np.full(texts * registers, np.inf)
    out = np.zeros(texts * registers, np.uint64)
    time, live, turn = np.zeros(len(h)), np.arange(len(h)), 0
    k = np.uint64(registers)
    while len(live):
        turn += 1
        r = mix(h[live] + np.uint64(turn * int(_P) & 0xFFFFFFFFFFFFFFFF))
        time[live] += -np.log(((r >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)) / w[live]
        if turn > 1:
            limit = t.reshape(texts, registers).max(1)
            live = live[time[live] < limit[at[live]]]
            r = mix(h[live] + np.uint64(turn * int(_P) & 0xFFFFFFFFFFFFFFFF))
        slot = at[live] * registers + (mix(r ^ _Q) % k).astype(np.int64)
        now = time[live]
        np.minimum.at(t, slot, now)
        won = t[slot] == now
        out[slot[won]] = h[live[won]]
    return out.reshape(texts, registers)


def probability_jaccard(ah: np.ndarray, aw: np.ndarray, bh: np.ndarray, bw: np.ndarray) -> float:
    """Exact probability Jaccard similarity of two weighted sets (sorted distinct hashes): sum over shared i of 1 / sum over j of max(a_j / a_i, b_j / b_i)."""
    if not len(ah) or not len(bh):
        return 0.0
    union = np.union1d(ah, bh)
    a, b = np.zeros(len(union)), np.zeros(len(union))
    a[np.searchsorted(union, ah)], b[np.searchsorted(union, bh)] = aw, bw
    both = (a > 0) & (b > 0)
    if not both.any():
        return 0.0
    with np.errstate(divide="ignore"):
        ratio = np.where(a > 0, b / np.where(a > 0, a, 1), np.inf)
    order = np.argsort(ratio, kind="stable")
    left, right = np.concatenate([[0], np.cumsum(a[order])]), np.concatenate([np.cumsum(b[order][::-1])[::-1], [0]])
    cut = np.searchsorted(ratio[order], ratio[both], side="right")
    return float(np.sum(1.0 / (left[cut] / a[both] + right[cut] / b[both])))
