"""Near-duplicate classes by ProbMinHash (operator 6).

1. Texts with equal rows of words are one node from here on.
2. Each node's weighted shingles give a ProbMinHash signature; BANDS bands of
   ROWS registers are its buckets.
3. In every bucket the node with the most company over all its buckets leads
   (the unedited text of a family, if it is there); the others are candidates
   with their leader only, so a bucket's size costs no more than its members.
4. Candidates are verified by their exact probability Jaccard similarity.
5. Where the members of a family (nodes tied by candidates, verified or not)
   still lie in several classes, a link between two of them may have been
   missed. Those families are compared whole, in blocks of bounded size: all
   nodes outside the family's largest class against all. A family with many
   such nodes is first cut by its rarest shingles into those that can be linked
   at all (an exact bound). Blocks are verified exactly and give only the links
   that join classes.
6. Classes are the connected components of all verified links.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import shingles as S
from .components import components
from .shared import AT, FILE, Lookup, drop_path, lookup_table, slices, small_batches, table, texts_of, with_buckets, with_row_ids, written

BANDS, ROWS = 20, 5
THRESHOLD = 0.8
#: Nodes in a block of a family that is compared whole; blocks outside its largest class beyond which a family is cut first.
BLOCK, WIDE = 256, 8


def _sketches(rows: DataFrame) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 250):
            n = batch.num_rows
            at, h, keys = S.shingle_hashes(texts_of(batch, "text"))
            at, h, count = S.weighted(at, h)
            sign = S.prob_min_hash(at, h, S.weight(count), n, BANDS * ROWS)
            some = np.bincount(at, minlength=n) > 0
            band = np.zeros((n, BANDS), np.uint64)
            for k in range(ROWS):
                band = S.mix(band * np.uint64(31) + sign[:, k::ROWS][:, :BANDS] + np.uint64(k))
            band = band.view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), batch.column(FILE), batch.column(AT), pa.array(keys, pa.binary()), pa.array([b if s else [] for b, s in zip(band, some)], pa.list_(pa.int64()))],
                ["doc_id", FILE, AT, "key", "bands"],
            )

    return rows.mapInArrow(run, f"doc_id long, {FILE} long, {AT} long, key binary, bands array<long>")


def _shingle_rows(rows: DataFrame, wanted: str) -> DataFrame:
    """key, hashes, counts of the rows (row ids, text) that a lookup table (row ids, key) names."""

    def run(batches):
        found = Lookup(wanted)
        for batch in batches:
            for mine, named, at in found.pick(batch):
                if named is None:
                    continue
                keys, mine = named.column("key").combine_chunks().take(at.drop_null()), mine.filter(at.is_valid())
                for part in slices([pa.RecordBatch.from_arrays([keys, mine.column("text")], ["key", "text"])], 250):
                    at_, h, _ = S.shingle_hashes(texts_of(part, "text"))
                    at_, h, count = S.weighted(at_, h)
                    cut = np.searchsorted(at_, np.arange(part.num_rows + 1)).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [part.column("key"), pa.ListArray.from_arrays(cut, pa.array(h.view(np.int64))), pa.ListArray.from_arrays(cut, pa.array(count.astype(np.int32)))],
                        ["key", "hashes", "counts"],
                    )

    return with_buckets(rows.select(FILE, AT, "text")).mapInArrow(run, "key binary, hashes array<long>, counts array<int>")


def _numpy(column) -> list[np.ndarray]:
    flat, cut = column.flatten().to_numpy(), column.offsets.to_numpy()
    cut = cut - cut[0]
    return [flat[a:b] for a, b in zip(cut, cut[1:])]


def _verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """a, b, linked of candidate pairs (a, b)."""
    one = sets.select(F.col("key").alias("a"), F.col("hashes").alias("ah"), F.col("counts").alias("ac"))
    two = sets.select(F.col("key").alias("b"), F.col("hashes").alias("bh"), F.col("counts").alias("bc"))

    def run(batches):
        for batch in slices(batches, 2000):
            ah, ac, bh, bc = (_numpy(batch.column(c)) for c in ("ah", "ac", "bh", "bc"))
            ok = []
            for x, i, y, j in zip(ah, ac, bh, bc):
                wi, wj = S.weight(i), S.weight(j)
                x, y = x.view(np.uint64), y.view(np.uint64)
                ok.append(S.probability_jaccard(x, wi, y, wj) >= threshold - 1e-12)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return pairs.join(one, "a").join(two, "b").select("a", "b", "ah", "ac", "bh", "bc").mapInArrow(run, "a binary, b binary, linked boolean")


def block_links(keys: list[bytes], labels: list[bytes], sides: np.ndarray, hashes: list[np.ndarray], weights: list[np.ndarray], threshold: float) -> list[tuple[bytes, bytes]]:
    """Links of at least threshold between nodes of different labels, one for each two classes that they join.

    sides: nodes of side 0 are compared with those of side 1, and where only
    side 0 is there, with one another. A pair's similarity is at most the
    share of either's weight in shingles of the other; products of matrices
    give these bounds for all pairs, and the pairs that they leave are verified.
    """
    n = len(keys)
    flat = np.concatenate(hashes) if n else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(n), [len(h) for h in hashes])
    _, at, df = np.unique(flat, return_inverse=True, return_counts=True)
    w = np.concatenate(weights)
    total = np.bincount(row, w, n)
    kept = df[at] > 1
    number = np.full(len(df), -1)
    number[df > 1] = np.arange((df > 1).sum())
    row, col, w = row[kept], number[at[kept]], w[kept]
    one, two = np.flatnonzero(sides == 0), np.flatnonzero(sides == 1)
    if not len(two):
        two = one
    mine, theirs = np.zeros((len(one), len(two)), np.float32), np.zeros((len(one), len(two)), np.float32)
    place = np.full((2, n), -1)
    place[0, one], place[1, two] = np.arange(len(one)), np.arange(len(two))
    for begin in range(0, int((df > 1).sum()), 4096):
        mask = (col >= begin) & (col < begin + 4096)
        sets = []
        for side, m in ((0, len(one)), (1, len(two))):
            x = np.zeros((m, 4096), np.float32)
            p = place[side, row[mask]]
            ok = p >= 0
            x[p[ok], col[mask][ok] - begin] = w[mask][ok]
            sets.append(x)
        a, b = sets
        mine += a @ (b > 0).astype(np.float32).T
        theirs += (a > 0).astype(np.float32) @ b.T
    near = (mine >= (threshold - 1e-4) * total[one][:, None]) & (theirs >= (threshold - 1e-4) * total[two][None, :])
    parent = {x: x for x in labels}

    def top(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(near)):
        i, j = one[i], two[j]
        a, b = top(labels[i]), top(labels[j])
        if a != b and S.probability_jaccard(hashes[i], weights[i], hashes[j], weights[j]) >= threshold - 1e-12:
            parent[max(a, b)] = min(a, b)
            out.append((keys[i], keys[j]))
    return out


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row ids, class_id, n_links, keep for each row of docs, near copies of at least the threshold under one class_id.

    class_id is the class's least doc_id (null ids count last); n_links is the
    number of other texts that the row's text was found and verified to be a
    near copy of (leaders and what joins classes, not all pairs of a class);
    keep is true for one row of each class, that of the least doc_id, of equal
    ones the first by row id (with_row_ids: they hold however a scan is split).
    Null texts are as empty ones; texts without words are near copies only if
    they are equal; texts of one to four words only if their words are.
    """
    spark = docs.sparkSession
    small_batches(spark)
    made: list[str] = []
    rows = with_row_ids(docs, made).select(F.col("doc_id").cast("long").alias("doc_id"), "text", FILE, AT)
    members = written(_sketches(rows), "near-members", made)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", FILE, AT)).alias("first")
    nodes = written(members.groupBy("key").agg(first, F.first("bands").alias("bands")), "near-nodes", made)

    each = nodes.select("key", F.posexplode("bands").alias("band", "hash"))
    shared = written(each.groupBy("band", "hash").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "near-buckets", made)
    inside = written(each.join(shared, ["band", "hash"]), "near-inside", made)
    company = written(inside.groupBy("key").agg(F.sum("n").alias("company")), "near-company", made)
    leaders = written(inside.join(company, "key").groupBy("band", "hash").agg(F.max(F.struct("company", "key")).alias("top")).select("band", "hash", F.col("top.key").alias("leader")), "near-leaders", made)
    pairs = inside.join(leaders, ["band", "hash"]).where("key <> leader").select(F.col("key").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = written(pairs, "near-pairs", made)

    wanted = lookup_table(nodes.join(company, "key", "left_semi").select("key", F.col(f"first.{FILE}").alias(FILE), F.col(f"first.{AT}").alias(AT)), "near-wanted", made)
    sets = written(_shingle_rows(rows, wanted), "near-sets", made)
    if (got := sets.count()) != (asked := company.count()):
        raise RuntimeError(f"{asked} texts to compare, {got} read: the table changed between two scans")
    checked = written(_verified(pairs, sets, threshold), "near-checked", made)
    links = checked.where("linked").select("a", "b")
    label = components(links, "near-classes")
    label = written(company.select(F.col("key").alias("node")).join(label, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "near-labels", made)
    family = components(pairs, "near-families").withColumnRenamed("label", "family")
    more = _missed(label, family, sets, threshold, made)
    if more.limit(1).count():  # they tie few classes: those are joined, not all links gone through again
        of = lambda end: label.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label"))
        ties = more.join(of("a"), "a").join(of("b"), "b").select(F.col("a_label").alias("a"), F.col("b_label").alias("b"))
        tied = components(ties, "near-all").select(F.col("node").alias("label"), F.col("label").alias("new"))
        label = written(label.join(tied, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "near-labels", made)
        links = links.unionByName(more)
    degree = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct().groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("n_links"))

    known = label.join(degree, "node", "left").select(F.col("node").alias("key"), "label", "n_links")
    owner = members.select("doc_id", FILE, AT, "key").join(known, "key", "left").select("doc_id", FILE, AT, F.coalesce("label", "key").alias("label"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    owner = written(owner, "near-owner")
    least = written(owner.groupBy("label").agg(first), "near-least")
    mine = (F.col(FILE) == F.col(f"first.{FILE}")) & (F.col(AT) == F.col(f"first.{AT}"))
    out = owner.join(least, "label").select("doc_id", FILE, AT, F.col("first.doc_id").alias("class_id"), "n_links", mine.alias("keep"))
    for path in made:
        drop_path(spark, path)
    return out


def _blocks(both: DataFrame) -> DataFrame:
    """family, main (its largest class), and into how many blocks the members and the others of that class go, for families of several classes."""
    size = both.groupBy("family", "label").agg(F.count(F.lit(1)).alias("n"))
    sizes = size.groupBy("family").agg(F.max(F.struct("n", "label")).alias("main"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    return sizes.select("family", F.col("main.label").alias("main"), F.ceil(F.col("main.n") / BLOCK).cast("int").alias("mains"), F.ceil((F.col("all") - F.col("main.n")) / BLOCK).cast("int").alias("rests"))


def _closer(both: DataFrame, sets: DataFrame, threshold: float, made: list[str]) -> DataFrame:
    """node, label, family: the families cut into those whose members can be linked at all.

    A link's texts share the threshold of either's weight, so, shingles taken
    from the rarest of the family on, the first that they share lies in both
    texts' beginnings of 1 - threshold of their weight. Members that share
    none of these with another class are left out; the others are tied by them.
    """
    weight = lambda c: 1.0 + F.log(c.cast("double"))
    total = F.aggregate("counts", F.lit(0.0), lambda a, c: a + weight(c))
    full = both.join(sets.withColumnRenamed("key", "node"), "node").select("family", "node", "label", total.alias("total"), F.explode(F.arrays_zip("hashes", "counts")).alias("z"))
    each = written(full.select("family", "node", "label", "total", F.col("z.hashes").alias("h"), weight(F.col("z.counts")).alias("w")), "near-each", made)
    held = each.groupBy("family", "h").agg(F.count(F.lit(1)).alias("n"), (F.min("label") != F.max("label")).alias("mixed"))
    before = F.sum("w").over(Window.partitionBy("node").orderBy("n", "h").rowsBetween(Window.unboundedPreceding, -1))
    begin = each.join(held, ["family", "h"]).withColumn("before", F.coalesce(before, F.lit(0.0)))
    begin = written(begin.where(F.col("mixed") & (F.col("before") <= (1 - threshold + 1e-9) * F.col("total"))).select("family", "h", "node"), "near-begin", made)
    hub = begin.groupBy("family", "h").agg(F.min("node").alias("hub"))
    ties = begin.join(hub, ["family", "h"]).where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    return both.select("node", "label").join(components(ties, "near-closer").select("node", F.col("label").alias("family")), "node")


def _missed(label: DataFrame, family: DataFrame, sets: DataFrame, threshold: float, made: list[str]) -> DataFrame:
    """Links between classes of one family that the leaders did not show."""
    both = written(label.join(family, "node"), "near-both", made)
    blocks = written(_blocks(both), "near-blocks", made)
    wide = blocks.where(F.col("rests") > WIDE).select("family")
    if wide.limit(1).count():  # only families of many members outside the largest class are worth another look
        closer = _closer(both.join(wide, "family", "left_semi"), sets, threshold, made)
        both = written(both.join(wide, "family", "left_anti").select("node", "label", "family").unionByName(closer), "near-closer", made)
        blocks = written(_blocks(both), "near-blocks", made)
    placed = both.join(blocks, "family")
    rest = F.col("label") != F.col("main")
    mine = F.pmod(F.xxhash64("node"), F.when(rest, F.col("rests")).otherwise(F.col("mains"))).cast("int")
    # nodes of other classes meet one another (x <= y) and, as side 0, each block of the largest class
    with_rest = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda y: F.struct(F.least("mine", y).alias("x"), F.greatest("mine", y).alias("y"), F.lit(False).alias("m"), F.when(F.col("mine") <= y, 0).otherwise(1).alias("side")))
    with_main = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda y: F.struct(F.col("mine").alias("x"), y.alias("y"), F.lit(True).alias("m"), F.lit(0).alias("side")))
    as_main = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda x: F.struct(x.alias("x"), F.col("mine").alias("y"), F.lit(True).alias("m"), F.lit(1).alias("side")))
    dealt = placed.withColumn("rest", rest).withColumn("mine", mine).withColumn("to", F.when(F.col("rest"), F.concat(with_rest, with_main)).otherwise(as_main))
    dealt = dealt.select("family", "node", "label", F.explode("to").alias("to")).select("family", "node", "label", "to.*")
    full = dealt.join(sets.withColumnRenamed("key", "node"), "node")

    def run(key, batch):
        got = batch.combine_chunks()
        column = lambda c: got.column(c).combine_chunks() if got.column(c).num_chunks != 1 else got.column(c).chunk(0)
        hashes = [h.view(np.uint64) for h in _numpy(column("hashes"))]
        out = block_links(got.column("node").to_pylist(), got.column("label").to_pylist(), got.column("side").to_numpy(), hashes, [S.weight(c) for c in _numpy(column("counts"))], threshold)
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.binary()), "b": pa.array(b, pa.binary())})

    links = full.groupBy("family", "x", "y", "m").applyInArrow(run, "a binary, b binary")
    return written(links, "near-more", made)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
