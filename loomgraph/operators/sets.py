"""Merging graphs and sets (SET-1..6)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..kg import KG
from .lineage import dealt, small_batches, stored

KEYS = ["head", "relation_type", "tail"]
#: Parts that the words of sets are dealt to at least, words to a part of more, and counts of words by their hashes.
PARTS, PART_WORDS, COUNTS = 64, 16 << 20, 1 << 20
#: Sets that are dealt out at once.
SLICE = 500


def merge(graphs: list[KG], strategy: str = "union") -> KG:
    """Graphs as one (SET-1).

    union keeps all rows of all graphs. intersection keeps relations (one row
    each) that every graph has; weighted has one row for each relation, with
    the mean of its confidences. Entities of equal ids are one in both.
    """
    if not graphs:
        raise ValueError("no graphs to merge")
    if strategy not in ("union", "intersection", "weighted"):
        raise ValueError(f"no merge by {strategy!r}")
    e = reduce(DataFrame.unionByName, [g.entities for g in graphs])
    r = reduce(DataFrame.unionByName, [g.relations.withColumn("_g", F.lit(k)) for k, g in enumerate(graphs)])
    meta = {"strategy": strategy, "source_graphs": len(graphs)}
    if strategy == "union":
        return KG(e, r.drop("_g"), meta)
    rest = [c for c in r.columns if c not in (*KEYS, "_g", "confidence")]
    # one flag for each graph: distinct counts would group all rows twice
    held = reduce(lambda a, b: a + b, [F.max((F.col("_g") == k).cast("int")) for k in range(len(graphs))])
    one = dealt(r, *KEYS).groupBy(*KEYS).agg(F.avg("confidence").alias("confidence"), *(F.min(c).alias(c) for c in rest), held.alias("_n"))
    if strategy == "intersection":
        one = one.where(F.col("_n") == len(graphs))
    entities = e.groupBy("id").agg(*(F.min_by(c, "ord").alias(c) for c in e.columns if c != "id"))
    return KG(entities, one.drop("_n"), meta)


def code_sets(a: DataFrame, b: DataFrame) -> DataFrame:
    """part, c: codes of both, of the first only, of any (SET-2)."""
    parts = {"both": a.intersect(b), "first": a.subtract(b), "any": a.union(b).distinct()}
    return reduce(DataFrame.unionByName, [x.select(F.lit(k).alias("part"), "c") for k, x in parts.items()])


def token_set(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda x: x != ""))


def jaccard_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """a, b, jaccard of all texts that share a word (SET-3), repeated rows once: the result is as large as their pairs. similar_sets() finds the likest of many."""
    words = rows.select(key, F.explode(token_set(F.col(text))).alias("_w")).distinct()
    size = words.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    side = lambda s: words.select(F.col(key).alias(s), "_w")
    both = side("a").join(side("b"), "_w").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("_both"))
    both = both.join(size.select(F.col(key).alias("a"), F.col("_n").alias("_na")), "a").join(size.select(F.col(key).alias("b"), F.col("_n").alias("_nb")), "b")
    return both.select("a", "b", (F.col("_both") / (F.col("_na") + F.col("_nb") - F.col("_both"))).alias("jaccard"))


def _meeting(least: float):
    """What deals sets out by their rarest words, and what brings together those of a part: exact bounds only."""

    def deal(counts: np.ndarray, parts: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in (b.slice(i, SLICE) for b in batches for i in range(0, b.num_rows, SLICE)):
                s, h = b.column("_s").to_numpy(), b.column("_h").flatten().to_numpy()
                n = b.column("_h").value_lengths().to_numpy().astype(np.int64)
                row = np.repeat(np.arange(len(s)), n)
                # parities: bits of whole sets, as many as words or up to twice that
                bits = np.maximum(64, 1 << np.ceil(np.log2(n)).astype(np.int64))
                at = np.cumsum(bits) - bits
                u = h.view(np.uint64)
                odd = np.packbits((np.bincount(at[row] + ((u >> np.uint64(20)).astype(np.int64) & (bits[row] - 1)), minlength=bits.sum()) & 1).astype(np.uint8), bitorder="little").tobytes()
                parity = pa.array([odd[x // 8 : (x + y) // 8] for x, y in zip(at, bits)], pa.binary())
                # rarest first, by the counts of the words' hashes; equal hashes stay in the words' order
                uses = counts[h & (COUNTS - 1)]
                order = np.lexsort((h, uses, row))
                h, uses, u = h[order], uses[order], u[order]
                rank = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) + 1
                kept = (rank <= (n - np.ceil(n * least - 1e-9).astype(np.int64) + 1)[row]) & (uses > 1)
                row, h, rank, part = row[kept], h[kept], rank[kept], ((u[kept] >> np.uint64(44)) % np.uint64(parts)).astype(np.int64)
                order = np.lexsort((part, row))
                row, h, rank, part = row[order], h[order], rank[order], part[order]
                first = np.flatnonzero(np.diff(row * parts + part, prepend=-1))
                ends = pa.array(np.append(first, len(row)), pa.int32())
                of = row[first]
                columns = [pa.array(part[first], pa.int32()), pa.array(s[of]), pa.array(n[of], pa.int32()), parity.take(pa.array(of)), pa.ListArray.from_arrays(ends, pa.array(h)), pa.ListArray.from_arrays(ends, pa.array(rank, pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["_part", "_s", "_n", "_p", "_t", "_r"])

        return run

    def meet(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        s, n = part.column("_s").to_numpy(), part.column("_n").to_numpy().astype(np.int64)
        flat = lambda c: part.column(c).combine_chunks().flatten().to_numpy()
        t, r = flat("_t"), flat("_r").astype(np.int64)
        row = np.repeat(np.arange(len(s)), part.column("_t").combine_chunks().value_lengths().to_numpy())
        order = np.argsort(t, kind="stable")
        t, r, row = t[order], r[order], row[order]
        parity = part.column("_p").to_pylist()
        size = np.array([len(p) // 8 for p in parity])
        # parities of a size, and those of twice the size folded to it
        folded = {}
        for c in np.unique(size):
            own, wide = np.flatnonzero(size == c), np.flatnonzero(size == 2 * c)
            m = lambda x, w: np.frombuffer(b"".join(parity[k] for k in x), np.uint64).reshape(-1, w)
            two = m(wide, 2 * c)
            place = np.full(len(s), -1)
            place[own], place[wide] = np.arange(len(own)), len(own) + np.arange(len(wide))
            folded[c] = place, np.concatenate([m(own, c), two[:, :c] ^ two[:, c:]])
        del parity

        def alike(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            a, b = row[i], row[j]
            na, nb = n[a], n[b]
            shared = least / (1 + least) * (na + nb) - 1e-6
            ok = (a != b) & (np.minimum(na, nb) >= np.maximum(na, nb) * least - 1e-9)
            ok &= np.minimum(r[i], r[j]) + np.minimum(na - r[i], nb - r[j]) >= shared
            a, b, most = a[ok], b[ok], (na + nb - 2 * shared)[ok]
            c = np.minimum(size[a], size[b])
            good = np.ones(len(a), bool)
            for w in np.unique(c):
                place, m = folded[w]
                x = np.flatnonzero((c == w) & (np.maximum(size[a], size[b]) <= 2 * w))
                for k in range(0, len(x), step := max(1, (8 << 20) // (8 * int(w)))):
                    y = x[k : k + step]
                    good[y] = np.bitwise_count(m[place[a[y]]] ^ m[place[b[y]]]).sum(1, dtype=np.int64) <= most[y]
            a, b = s[a[good]], s[b[good]]
            return np.minimum(a, b), np.maximum(a, b)

        found = [np.zeros((0, 2), np.int64)]
        i, d = np.flatnonzero(t[1:] == t[:-1]), 1
        while len(i):
            for k in range(0, len(i), 1 << 18):
                found.append(np.stack(alike(i[k : k + (1 << 18)], i[k : k + (1 << 18)] + d), 1))
            if sum(map(len, found)) > max(1 << 20, 2 * len(found[0])):
                found = [np.unique(np.concatenate(found), axis=0)]
            d += 1
            i = i[i + d < len(t)]
            i = i[t[i + d] == t[i]]
        pairs = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return deal, meet


def similar_sets(rows: DataFrame, key: str, text: str, least: float = 0.5) -> DataFrame:
    """a, b, jaccard of the pairs of different word sets that are at least so alike, each set under its least key, and of each further key with that of its set (SET-3).

    Sets that are so alike share one of their rarest words: of n words the
    n - ceil(least x n) + 1 that fewest sets have, by counts of the words'
    hashes. Sets meet by these only, so a word that all texts have brings none
    together. The words are dealt to parts, and a set goes to a part once with
    all of its rare words there and as many parities as it has words. Where
    two meet, the place of the shared word and the parities bound what they
    can share (exact bounds), so words move only for the few that may be
    alike. least is over 0.
    """
    if not 0 < least <= 1:
        raise ValueError("a likeness is over 0 and at most 1")
    small_batches(rows.sparkSession)
    # no word has a blank in it
    sets = rows.select(F.col(key).alias("_k"), F.array_join(F.sort_array(token_set(F.col(text))), " ").alias("_w")).where("_w <> ''")
    own = sets.groupBy("_w").agg(F.min("_k").alias("_id"), F.collect_set("_k").alias("_all"))
    own = stored(own.withColumn("_s", F.monotonically_increasing_id()))
    hashed = own.select("_s", F.transform(F.split("_w", " "), lambda x: F.xxhash64(x)).alias("_h"))
    used = hashed.select(F.explode("_h").alias("_h")).groupBy(F.pmod("_h", F.lit(COUNTS)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).toArrow()  # COUNTS rows at most
    counts = np.zeros(COUNTS, np.int64)
    counts[used.column("b").to_numpy()] = used.column("n").to_numpy()
    parts = max(PARTS, int(counts.sum()) // PART_WORDS)
    deal, meet = _meeting(least)
    dealt_ = hashed.mapInArrow(deal(counts, parts), "_part int, _s long, _n int, _p binary, _t array<long>, _r array<int>")
    met = dealt_.groupBy("_part").applyInArrow(meet, "a long, b long").distinct()
    # a long of other parities spares most comparisons of words that have come in vain
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(h, F.lit(64)).cast("int"))
    for s in ("a", "b"):
        met = met.join(own.select(F.col("_s").alias(s), F.col("_w").alias(f"_w{s}"), F.col("_id").alias(f"_id{s}")), s)
    met = met.select(F.least("_ida", "_idb").alias("a"), F.greatest("_ida", "_idb").alias("b"), *(F.split(f"_w{s}", " ").alias(f"_w{s}") for s in "ab")).where("a <> b")
    odd = lambda w: F.aggregate(w, F.lit(0).cast("long"), lambda x, t: x.bitwiseXOR(bit(F.xxhash64(t))))
    all_, both = F.size("_wa") + F.size("_wb"), F.size(F.array_intersect("_wa", "_wb"))
    near = F.bit_count(odd(F.col("_wa")).bitwiseXOR(odd(F.col("_wb")))) <= all_ * (1 - least) / (1 + least) + 1e-6
    alike = met.where(near).select("a", "b", (both / (all_ - both)).alias("jaccard")).where(F.col("jaccard") >= least - 1e-9)
    copies = own.where(F.size("_all") > 1).select(F.col("_id").alias("a"), F.explode("_all").alias("b"), F.lit(1.0).alias("jaccard")).where("a <> b")
    return alike.unionByName(copies)


def jaccard(a: Column, b: Column) -> Column:
    """Tokens in common over tokens in either (SET-3)."""
    x, y = token_set(a), token_set(b)
    return F.size(F.array_intersect(x, y)) / F.greatest(F.size(F.array_union(x, y)), F.lit(1))


def filter_and_dedup(triples: DataFrame, text: Column, least: float, order: list[str]) -> DataFrame:
    """One row for head text, relation and tail text, tails alike enough to a text, confidence times likeness (SET-6)."""
    keys = ["head_text", "relation_type", "tail_text"]
    one = triples.groupBy(*keys).agg(F.min_by("confidence", F.struct(*order)).alias("confidence"))
    s = one.withColumn("_s", jaccard(F.col("tail_text"), text)).where(F.col("_s") >= least)
    return s.withColumn("confidence", F.col("confidence") * F.col("_s")).drop("_s")


def remaining_positions(taken: Column, last: int) -> Column:
    """Positions 1 to last that are not taken, in order (SET-4)."""
    return F.array_except(F.array(*map(F.lit, range(1, last + 1))), taken)
