"""Toxicity by nearest labelled examples (operator 4).

Exact TF-IDF cosine over a block-max inverted index of labelled examples. The
terms of a text are all its words and, of longer words, their first 3 to 8
letters; the index holds every term of every example. Unlike in plain TF-IDF, a
term weighs its inverse document frequency times its relevance, the square root
of its log-likelihood ratio between the labels (0 for a term that both labels
use alike): so chance agreement in rare words does not decide who is near, and
no term is left out of a vector or its length. Alike examples stand next to
each other; each term's postings are cut into blocks of examples with the
block's largest weight. Terms that many examples hold have whole rows instead,
with which a batch of queries is multiplied at once: that gives the k-th best
cosine a lower bound and, with the blocks' weights, every block an upper one.
Only blocks whose bound reaches the former are opened. The nearest are then
summed once more in double precision, over weights held in single precision.
Votes of the neighbours (all that tie with the k-th included) weigh their
cosine; a logistic curve fitted on examples that are not in the index turns
them into calibrated scores. The neighbours are the evidence.
"""

from __future__ import annotations

import hashlib
import io
import math
import re
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shingles as S
from .shared import open_read, open_write, release, shared_path, slices, small_batches, table, texts_of

#: The most labelled documents that the model is fitted on (picked by a hash of doc_id).
FIT_ROWS = 3000
#: Examples that vote, examples in a block, runs of postings that a batch of queries may have.
NEIGHBOURS, BLOCK, BATCH_RUNS = 15, 64, 200_000
#: A term that one in so many examples holds has a whole row; rounding that bounds allow for.
ROW_SHARE, SLACK = 16, 1e-5
#: Groups of alike examples that their order follows; votes that the base rate stands for; ridge of the calibration.
GROUPS, PRIOR_WEIGHT, RIDGE = 16, 1.0, 4.0
#: Letters of the beginnings that are terms.
BEGINNINGS = range(3, 9)
#: Scores that a worker remembers, for texts of equal terms.
_REMEMBERED = 50_000
_OTHER = re.compile(r"[^\w\x00-\x7f]+")
_IS_WORD = np.zeros(128, bool)
_IS_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), 95]] = True


def fold(doc_id) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[i], starts[i] + 1 ... of every run, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def term_counts(texts: list[str], vocabulary: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, term, count) of each distinct term of each text, by text and term.

    A term is a 64-bit hash, or its place in a sorted vocabulary of hashes;
    then terms that it does not hold are left out.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64 if vocabulary is None else np.int64), np.zeros(0, np.int64)
    parts = [t.lower() for t in texts]
    parts = [t if t.isascii() else _OTHER.sub(" ", t) for t in parts]
    size = np.array([len(p) + 1 for p in parts], np.int64)
    code = np.frombuffer("\n".join([*parts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(code):
        return none
    edge = np.flatnonzero(np.diff(np.concatenate([[False], (code >= 128) | _IS_WORD[np.minimum(code, 127)], [False]]).astype(np.int8)))
    begin, end = edge[::2], edge[1::2]
    if not len(begin):
        return none
    total = np.concatenate([[np.uint64(0)], np.cumsum((code.astype(np.uint64) + np.uint64(1)) * S._power(S._P, len(code)), dtype=np.uint64)])
    back = S._power(S._INVERSE, len(code))
    length = end - begin
    _, one, word = np.unique(S.mix(((total[end] - total[begin]) * back[begin]) ^ length.astype(np.uint64)), return_index=True, return_inverse=True)
    # the terms of each distinct word: itself, and its beginnings
    b, n = begin[one], length[one]
    terms, owner = [S.mix(((total[b + n] - total[b]) * back[b]) ^ n.astype(np.uint64))], [np.arange(len(one))]
    for k in BEGINNINGS:
        longer = np.flatnonzero(n > k)
        at = b[longer]
        terms.append(S.mix(((total[at + k] - total[at]) * back[at]) ^ np.uint64(k | 1 << 40)))
        owner.append(longer)
    terms, owner = np.concatenate(terms), np.concatenate(owner)
    if vocabulary is None:
        values, number = np.unique(terms, return_inverse=True)
    else:
        number = np.searchsorted(vocabulary, terms)
        known = vocabulary[np.minimum(number, len(vocabulary) - 1)] == terms if len(vocabulary) else np.zeros(len(terms), bool)
        number, owner = number[known], owner[known]
    order = np.argsort(owner, kind="stable")
    number = number[order]
    many = np.bincount(owner, minlength=len(one))
    first = np.cumsum(many) - many
    text = np.searchsorted(np.cumsum(size), begin, side="right")
    key = np.repeat(text.astype(np.uint64), many[word]) << np.uint64(32) | number[_spread(first[word], many[word])].astype(np.uint64)
    key, count = np.unique(key, return_counts=True)
    number = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    return (key >> np.uint64(32)).astype(np.int64), values[number] if vocabulary is None else number, count


def relevance(with_1: np.ndarray, with_0: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Log-likelihood ratio of terms that with_1 of n1 and with_0 of n0 examples hold."""

    def part(k, n):
        k = np.asarray(k, float)
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(k > 0, k * np.log(k / n), 0.0) + np.where(n - k > 0, (n - k) * np.log(1 - k / n), 0.0)

    return np.maximum(0.0, 2 * (part(with_1, n1) + part(with_0, n0) - part(with_1 + with_0, n1 + n0)))


def _digest(terms: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.blake2b(terms.tobytes() + counts.tobytes(), digest_size=16).digest()


class Index:
    """Labelled TF-IDF vectors: equal ones are one entry with counts of both labels."""

    _ARRAYS = ("terms", "weight", "votes", "ids", "entry", "value", "block_begin", "block", "top", "block_at", "row_of", "rows", "settings")

    def __init__(self, examples: list[tuple[int | None, np.ndarray, np.ndarray, int]]):
        """examples: doc_id, sorted distinct terms, their counts, label."""
        label = np.array([e[3] for e in examples], float)
        n1, n0 = float(label.sum()), float(len(label) - label.sum())
        self.base, self.slope, self.shift = n1 / max(1.0, n1 + n0), 1.0, 0.0
        sizes = np.array([len(e[1]) for e in examples], np.int64)
        self.terms, number = np.unique(np.concatenate([e[1] for e in examples]) if examples else np.zeros(0, np.uint64), return_inverse=True)
        number = number.astype(np.int32)
        df, df1 = np.bincount(number, minlength=len(self.terms)), np.bincount(number, np.repeat(label, sizes), minlength=len(self.terms))
        idf = np.log((1 + n1 + n0) / (1 + df)) + 1
        self.weight = idf * np.sqrt(relevance(df1, df - df1, n1, n0)) if n1 and n0 else np.zeros(len(self.terms))
        first = np.cumsum(sizes) - sizes
        groups: dict[bytes, list] = {}
        for k, (doc_id, terms, counts, y) in enumerate(examples):
            g = groups.setdefault(_digest(terms, np.asarray(counts, np.int64)), [k, [0, 0], []])
            g[1][y] += 1
            if doc_id is not None:
                g[2].append(doc_id)
        entries = []
        for k, votes, ids in groups.values():
            mine, value = self.vector(number[first[k] : first[k] + sizes[k]], np.asarray(examples[k][2]))
            entries.append((mine, value.astype(np.float32), votes, (sorted(ids) + [-1] * 3)[:3]))
        del number
        self._build(entries)
        self._build([entries[k] for k in self._alike(entries)])
        self.k = NEIGHBOURS

    def _build(self, entries: list) -> None:
        n, v = len(entries), len(self.terms)
        self.votes = np.array([e[2] for e in entries], float).reshape(-1, 2)
        self.ids = np.array([e[3] for e in entries], np.int64).reshape(-1, 3)
        sizes = np.array([len(e[0]) for e in entries], np.int64)
        term = (np.concatenate([e[0] for e in entries]) if n else np.zeros(0)).astype(np.int32)
        value = (np.concatenate([e[1] for e in entries]) if n else np.zeros(0)).astype(np.float32)
        entry = np.repeat(np.arange(n, dtype=np.int32), sizes)
        # rows of the terms that many entries hold, one column for each
        often = np.bincount(term, minlength=v) > max(1, n // ROW_SHARE)
        self.row_of = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
        self.rows = np.zeros((-(-n // BLOCK) * BLOCK, int(often.sum())), np.float32)
        mine = often[term]
        self.rows[entry[mine], self.row_of[term[mine]]] = value[mine]
        # postings of the others, and the runs of one term in one block with the largest weight of each
        term, entry, value = term[~mine], entry[~mine], value[~mine]
        order = np.argsort(term, kind="stable")
        term, self.entry, self.value = term[order], entry[order], value[order]
        block = self.entry // BLOCK
        new = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (block[1:] != block[:-1])])) if len(term) else np.zeros(0, np.int64)
        self.block, self.block_at = block[new].astype(np.int32), np.concatenate([new, [len(term)]])
        self.top = np.maximum.reduceat(self.value, new) if len(new) else np.zeros(0, np.float32)
        self.block_begin = np.searchsorted(term[new], np.arange(v + 1))
        self._ready()

    def _ready(self) -> None:
        self.size = self.votes.sum(1)
        self.blocks = -(-len(self.votes) // BLOCK)
        self.seen: dict[bytes, tuple[float, list[int]]] = {}

    def _alike(self, entries: list) -> np.ndarray:
        """An order of the entries by the nearest of some of them, so that blocks hold alike ones."""
        n = len(entries)
        if not n:
            return np.zeros(0, np.int64)
        seeds = np.unique(np.linspace(0, n - 1, GROUPS).astype(int))
        of = self.cosines([(entries[k][0], entries[k][1]) for k in seeds])[0][:, :n]
        return np.lexsort((of.max(0), of.argmax(0)))

    def vector(self, terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms (places in the vocabulary) and weights of length 1; nothing if no term has a weight."""
        w = (1 + np.log(counts)) * self.weight[terms]
        some = w > 0
        w = w[some]
        return terms[some], w / math.sqrt(float(w @ w)) if len(w) else w

    def cosines(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cosines of each query (terms, weights) with every entry, those in blocks that cannot hold one of the k nearest left short (k 0: none).

        Also what the postings gave of them, and the queries' weights of the terms with rows.
        """
        m, e = len(queries), len(self.rows)
        weights = np.zeros((m, self.rows.shape[1]), np.float32)
        rare = []
        for i, (terms, w) in enumerate(queries):
            row = self.row_of[terms]
            weights[i, row[row >= 0]] = w[row >= 0]
            rare.append((terms[row < 0], w[row < 0]))
        base = weights @ self.rows.T
        terms, w = np.concatenate([t for t, _ in rare]), np.concatenate([x for _, x in rare])
        many = self.block_begin[terms + 1] - self.block_begin[terms]
        runs = _spread(self.block_begin[terms], many)
        query = np.repeat(np.repeat(np.arange(m, dtype=np.int64), [len(t) for t, _ in rare]), many)
        w, place = np.repeat(w, many), query * self.blocks + self.block[runs]
        if k and e > k:
            bound = base.reshape(m, -1, BLOCK).max(2) + np.bincount(place, w * self.top[runs], minlength=m * self.blocks).reshape(m, -1)
            least = np.partition(base, e - k, axis=1)[:, e - k]
            mine = (bound + SLACK >= least[:, None]).ravel()[place]
            runs, query, w = runs[mine], query[mine], w[mine]
        begin = self.block_at[runs]
        size = self.block_at[runs + 1] - begin
        at = _spread(begin, size)
        posted = np.bincount(np.repeat(query * e, size) + self.entry[at], np.repeat(w, size) * self.value[at], minlength=m * e).reshape(m, e)
        return base + posted, posted, weights

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query the cosines and entries of its nearest entries until they stand for k examples, all ties with the last included; cosines over 0."""
        k, n = k or self.k, len(self.votes)
        runs = np.array([int((self.block_begin[t + 1] - self.block_begin[t]).sum()) for t, _ in queries], np.int64)
        at = 0
        while at < len(queries):
            end = max(at + 1, int(np.searchsorted(np.cumsum(runs[at:]), BATCH_RUNS, side="right")) + at)
            end = min(end, at + 64)
            near, posted, weights = self.cosines(queries[at:end], k)
            near = near[:, :n]
            least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.zeros(len(near))
            for score, own, w, low in zip(near, posted, weights, least):
                entry = np.flatnonzero(score >= max(low - SLACK, 1e-9))
                cosine = np.round(self.rows[entry] @ w.astype(float) + own[entry], 9)
                order = np.lexsort((entry, -cosine))
                order = order[cosine[order] > 0]
                cosine, entry = cosine[order], entry[order]
                have = np.cumsum(self.size[entry])
                if len(have) and have[-1] > k:
                    keep = np.searchsorted(-cosine, -cosine[np.searchsorted(have, k)], side="right")
                    cosine, entry = cosine[:keep], entry[:keep]
                yield cosine, entry
            at = end

    def votes_of(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[float, np.ndarray]]:
        """For each text (terms, counts) the share of label 1 in the votes by cosine, drawn to the base rate, and the entries that vote."""
        if not len(self.votes):
            yield from ((self.base, np.zeros(0, np.int64)) for _ in texts)
            return
        for cosine, entry in self.nearest([self.vector(t, c) for t, c in texts]):
            no, yes = (cosine @ self.votes[entry]).tolist() if len(entry) else (0.0, 0.0)
            yield (yes + PRIOR_WEIGHT * self.base) / (no + yes + PRIOR_WEIGHT), entry

    def calibrate(self, examples: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """Fit the logistic curve over the votes' log-odds (terms, counts, label); a ridge draws it to the votes as they are."""
        if not examples:
            return
        x = np.array([_logit(share) for share, _ in self.votes_of([e[:2] for e in examples])])
        y = np.array([float(label) for *_, label in examples])
        a, w = np.stack([x, np.ones_like(x)], 1), np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
            w = w - np.linalg.solve((a.T * (p * (1 - p))) @ a + RIDGE * np.eye(2), a.T @ (p - y) + RIDGE * (w - np.array([1.0, 0.0])))
        if np.isfinite(w).all() and w[0] > 0:
            self.slope, self.shift = float(w[0]), float(w[1])

    def scores_of(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[float, list[int]]]:
        """The score of each text (terms as places in the vocabulary, counts), and doc_ids of its nearest examples."""
        if len(self.seen) > _REMEMBERED:
            self.seen.clear()
        keys = [_digest(t, c) for t, c in texts]
        new = {key: text for key, text in zip(keys, texts) if key not in self.seen}
        for key, (share, entry) in zip(new, self.votes_of(list(new.values()))):
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * _logit(share) + self.shift))))
            ids = self.ids[entry[:3]].ravel()
            self.seen[key] = p, ids[ids >= 0][:3].tolist()
        return [self.seen[key] for key in keys]

    def scores(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        text, term, count = term_counts(texts, self.terms)
        cut = np.searchsorted(text, np.arange(len(texts) + 1))
        return self.scores_of([(term[a:b], count[a:b]) for a, b in zip(cut, cut[1:])])

    def save(self, path: str) -> None:
        self.settings = np.array([self.base, self.slope, self.shift, self.k])
        held = io.BytesIO()
        np.savez(held, **{name: getattr(self, name) for name in self._ARRAYS})
        with open_write(path) as file:
            file.write(held.getvalue())


def load(path: str) -> Index:
    """The index of a file. A task holds it while it runs: workers live on, and later stages share their memory."""
    index = Index.__new__(Index)
    with open_read(path) as file, np.load(io.BytesIO(file.read())) as held:
        for name in Index._ARRAYS:
            setattr(index, name, held[name])
    base, slope, shift, k = index.settings.tolist()
    index.base, index.slope, index.shift, index.k = base, slope, shift, int(k)
    index._ready()
    return index


def _logit(p: float) -> float:
    p = min(1 - 1e-6, max(1e-6, p))
    return math.log(p / (1 - p))


def built(batches: Iterable[pa.RecordBatch]) -> Index:
    """The index of all examples (doc_id, label, fold, terms, counts): fold 1 calibrates, the others are indexed."""
    rows: list[tuple[int, np.ndarray, np.ndarray, int, int]] = []
    for batch in batches:
        lists = []
        for name, kind in (("terms", np.uint64), ("counts", np.int64)):
            column = batch.column(name)
            flat, cut = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(kind), column.offsets.to_numpy()
            lists.append([flat[x:y] for x, y in zip(cut - cut[0], cut[1:] - cut[0])])
        rows += zip(batch.column("doc_id").to_pylist(), *lists, batch.column("label").to_pylist(), batch.column("fold").to_pylist())
    rows.sort(key=lambda r: r[0])
    index = Index([r[:4] for r in rows if r[4] != 1])
    known = []
    for _, terms, counts, label, f in rows:
        if f == 1 and len(index.terms):
            at = np.minimum(np.searchsorted(index.terms, terms), len(index.terms) - 1)
            have = index.terms[at] == terms
            known.append((at[have], counts[have], label))
    index.calibrate(known)
    return index


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> str:
    """The file of the index, from labelled documents outside fold 0: at most `rows` doc_ids, picked by hash, one text of each (the least).

    Null labels and doc_ids are left out; of several labels for a doc_id the
    highest counts. Fold 1 calibrates, the other folds are indexed. Without
    examples of both labels the score is their base rate (0 without any). One
    task builds the index of the bounded sample and writes it to the shared
    folder under a name of its own attempt; load() reads it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ids = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").where(fold("doc_id") != 0).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("label"))
    picked = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).where("label IN (0, 1)")
    # at most `rows` pairs of numbers
    mine = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").where("text IS NOT NULL")
    mine = mine.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("text").alias("text"), F.max("label").alias("label"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            n = batch.num_rows
            text, term, many = term_counts(texts_of(batch, "text"))
            cut = pa.array(np.searchsorted(text, np.arange(n + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(cut, pa.array(term.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(many.astype(np.int32)))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), *lists], ["doc_id", "label", "terms", "counts"])

    counted = mine.mapInArrow(count, "doc_id long, label int, terms array<long>, counts array<int>").withColumn("fold", fold("doc_id"))
    path = shared_path(spark, "toxicity-index")

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = f"{path}-{uuid.uuid4().hex}"
        built(batches).save(own)
        release()
        yield pa.RecordBatch.from_pydict({"path": [own]})

    done = counted.repartition(1).mapInArrow(build, "path string").collect()
    if not done:  # no partition at all: nothing was labelled
        Index([]).save(path)
    return done[0].path if done else path


def score_column(docs: DataFrame, index: str, prefix: str = "") -> DataFrame:
    """docs with score, predicted and evidence (doc_ids of the nearest examples) after its own columns.

    A null or empty text has the score of a text without any term. Own columns
    of these names, the prefix before them, give way to the results. The score
    depends on the text only. index is the file that fit() gives; each worker
    reads it once.
    """
    small_batches(docs.sparkSession)
    new = tuple(prefix + x for x in ("score", "predicted", "evidence"))
    docs = docs.drop(*new)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in slices(batches, 256):
            model = model or load(index)
            out = model.scores(texts_of(batch, "text"))
            for name, column in zip(new, (pa.array([p for p, _ in out], pa.float64()), pa.array([int(p >= 0.5) for p, _ in out], pa.int32()), pa.array([e for _, e in out], pa.list_(pa.int64())))):
                batch = batch.append_column(name, column)
            yield batch
        del model
        release()

    added = [T.StructField(n, t) for n, t in zip(new, (T.DoubleType(), T.IntegerType(), T.ArrayType(T.LongType())))]
    schema = T.StructType([*docs.schema.fields, *added])
    return docs.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    index = fit(docs, table(spark, sf_dir, "labels"))
    scored = score_column(docs.withColumn("held_out", F.coalesce(fold("doc_id") == 0, F.lit(False))), index)
    return scored.select("doc_id", "held_out", "score", "predicted", "evidence")
