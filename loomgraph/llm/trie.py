"""Prefix trie of conversations (operator 13): succinct level-order tries by shard, the heavy upper levels apart.

Turns are known by 128 bits of SHA-256 of role and text, prefixes by a chained
digest of 128 bits, which a conversation gets in bands of BAND turns. A prefix
under which more than SHARD turns lie is heavy. A light prefix under a heavy one
is the top of a shard: all that begins so, at most SHARD turns, goes to one
task, which lays the shards of its partition out as one forest in level order -
a LOUDS bitvector, 1 for each child and 0 at a node's end, and an array of
labels - and adds up leaves and bytes from the last level to the first. The
heavy prefixes, of whatever number, are rows of a table: what the tops under
them bring is summed by parent, and subtrees by doubling: after k rounds a node
has the sums of all nodes less than 2^k below it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import drop_path, release, small_batches, sql_crc32, table, written

#: Turns of a prefix that one task may lay out; turns of a band; turns that rebuild() may take from another conversation at most.
SHARD, BAND, HEAD = 1024, 256, 8
#: Conversations that rebuild() groups by id; it takes as many turns from the first as a digest of the id says.
FAMILY = 5
#: Turns in a forest, and bytes of a chunk of ids.
FOREST, CHUNK = 1 << 16, 1 << 16
_NONE = hashlib.sha256().hexdigest()


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def numbered(conversations: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(turns, counts): conv_id, place from 1, label and bytes of each turn; conv_id and its n.

    Rows are cut into ranges of their whole order, so a conversation of any
    size is numbered by many tasks; ranges begin after the rows of their first
    conversation in the ranges before.
    """
    empty = F.lit("")
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.coalesce(F.col("role").cast("string"), empty).alias("role"), F.coalesce("text", empty).alias("text"))
    named = F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text"))
    rows = rows.select("*", F.substring(F.unhex(F.sha2(named, 256)), 1, 16).alias("label"), F.octet_length("text").cast("long").alias("bytes"))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role"]
    ranges = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text").select("conv_id", "label", "bytes")

    def run(batches):
        part, before, place = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            ids = batch.column("conv_id").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            first = np.concatenate([[ids[0] != before], ids[1:] != ids[:-1]])
            at = np.arange(len(ids))
            begin = np.maximum.accumulate(np.where(first, at, 0))
            own = at - begin + 1
            if not first[0]:
                own[begin == 0] += place
            before, place = ids[-1], own[-1]
            yield batch.append_column("part", pa.array(np.full(len(ids), part, "int64"))).append_column("own", pa.array(own.astype("int64")))

    turns = written(ranges.mapInArrow(run, "conv_id long, label binary, bytes long, part long, own long"), "trie-turns", made)
    parts = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = parts.select("conv_id", "part", before.alias("before"))
    placed = turns.join(offsets, ["conv_id", "part"]).select("conv_id", (F.col("own") + F.col("before")).alias("place"), "label", "bytes")
    return placed, parts.groupBy("conv_id").agg(F.sum("n").alias("n"))


def rebuilt(conversations: DataFrame, made: list[str]) -> tuple[DataFrame, DataFrame]:
    """(turns, ids): conv_id, depth, label, bytes of rebuilt conversations; conv_id and n, its turns, of each, turnless ones too.

    Conversation c is the first h turns of conversation c - c % FAMILY, all if
    it has fewer, none if there is none, and its own after the first h;
    h = crc32(c) % 9. Remainders are those of SQL: -3 % 5 is -3.
    """
    turns, counts = numbered(conversations, made)
    counts = written(counts, "trie-counts", made)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD + 1))
    own = counts.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), h.alias("h"), F.col("n").alias("own"))
    of_base = counts.select(F.col("conv_id").alias("base"), F.col("n").alias("_n"))
    ids = own.join(of_base, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("_n", F.lit(0))).alias("k"), "own")
    ids = ids.withColumn("n", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    ids = written(ids, "trie-ids", made)
    firsts = turns.where(F.col("place") <= HEAD).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "label", "bytes"))).alias("head"))
    heads = ids.where("k > 0").join(firsts, "base").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("k").cast("int"))).alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.label", "t.bytes")
    tails = turns.join(ids.where("own > h").select("conv_id", "h", "k"), "conv_id").where("place > h").select("conv_id", (F.col("place") - F.col("h") + F.col("k")).alias("depth"), "label", "bytes")
    return heads.unionByName(tails), ids.select("conv_id", "n")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefix that each band of a conversation starts after, from the digests of the bands before."""
    for batch in batches:
        for c, digests in zip(batch.column("conv_id").to_pylist(), batch.column("digests").to_pylist()):
            at, out = b"", []
            for x in digests:
                out.append(at)
                at = digest(at + x)
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(out), pa.int64()), pa.array(range(len(out)), pa.int64()), pa.array(out, pa.binary())], names=["conv_id", "band", "start"])


def _prefixes(start: bytes, labels: list[bytes], band: int) -> list[bytes]:
    """Digests of the prefixes that end at each of a band's turns; at a full band's end it is that of the next band's start."""
    at, out = start, []
    for label in labels:
        at = digest(at + label)
        out.append(at)
    if len(out) == band:
        out[-1] = digest(start + hashlib.sha256(b"".join(labels)).digest())
    return out


def banded(turns: DataFrame, band: int, made: list[str]) -> DataFrame:
    """conv_id, band, start, labels, bytes, prefixes: the turns of a band of each conversation, in order."""
    t = F.col("t")
    rows = turns.select("conv_id", F.floor((F.col("depth") - 1) / band).cast("long").alias("band"), F.struct("depth", "label", "bytes").alias("t"))
    rows = rows.groupBy("conv_id", "band").agg(F.sort_array(F.collect_list("t")).alias("t")).select("conv_id", "band", t["label"].alias("labels"), t["bytes"].alias("bytes"))
    rows = written(rows, "trie-bands", made)
    kind = "conv_id long, band long, labels array<binary>, bytes array<long>, start binary, prefixes array<binary>"
    longer = rows.where("band = 1").select("conv_id")
    joined = F.unhex(F.sha2(F.unhex(F.array_join(F.transform("labels", lambda x: F.hex(x)), "")), 256))
    digests = rows.join(longer, "conv_id", "left_semi").select("conv_id", F.struct("band", joined.alias("digest")).alias("d")).groupBy("conv_id").agg(F.sort_array(F.collect_list("d"))["digest"].alias("digests"))
    starts = digests.mapInArrow(_chained, "conv_id long, band long, start binary").where("band > 0")
    later = rows.where("band > 0").join(starts, ["conv_id", "band"])
    first = rows.where("band = 0").withColumn("start", F.lit(b""))

    def prefixed(batches):
        for batch in batches:
            out = [_prefixes(start, labels, band) for start, labels in zip(batch.column("start").to_pylist(), batch.column("labels").to_pylist())]
            yield batch.append_column("prefixes", pa.array(out, pa.list_(pa.binary())))

    return written(first.unionByName(later).mapInArrow(prefixed, kind), "trie-prefixes", made)


class Forest:
    """Tries of several shards as one in level order: LOUDS bits and labels, from sequences of label codes.

    Node 0 is over all tops. A node's bits are a 1 for each child and a 0, all
    nodes' one after the other, so the k-th 1 is that of node k, and its
    parent is the number of 0s before it.
    """

    def __init__(self, tops: np.ndarray, begin: np.ndarray, length: np.ndarray, codes: np.ndarray):
        """tops: number of each sequence's shard; begin, length: its stretch of codes."""
        self.levels, degrees, labels, self.at = [1], [], [np.array([-1])], np.full(len(codes), -1)
        many = int(codes.max(initial=0)) + 1
        node, base, depth, live = np.zeros(len(tops), "int64"), 0, 0, np.arange(len(tops))
        while len(live):
            place = begin[live] + depth
            # all of a shard begin alike, so its number tells its top apart
            own = tops[live] if depth == 0 else (node[live] - base) * many + codes[place]
            _, where, which = np.unique(own, return_index=True, return_inverse=True)
            degree = np.zeros(self.levels[-1], "int64")
            np.add.at(degree, node[live][where] - base, 1)
            degrees.append(degree)
            labels.append(codes[place][where])
            base += self.levels[-1]
            node[live] = which + base
            self.at[place] = node[live]
            self.levels.append(len(where))
            depth += 1
            live = live[length[live] > depth]
        degrees.append(np.zeros(self.levels[-1], "int64"))
        degree = np.concatenate(degrees)
        self.labels = np.concatenate(labels)
        self.bits = np.ones(len(degree) + int(degree.sum()), bool)
        self.bits[np.cumsum(degree + 1) - 1] = False

    def parents(self) -> np.ndarray:
        """Each node's parent, -1 for node 0: zeros before its 1."""
        ones = np.flatnonzero(self.bits)
        return np.concatenate([[-1], ones - np.arange(len(ones))])

    def degrees(self) -> np.ndarray:
        return np.diff(np.flatnonzero(~self.bits), prepend=-1) - 1

    def rolled_up(self, values: np.ndarray) -> np.ndarray:
        """Sums of values over each node's subtree, from the last level up."""
        out, parents, end = values.copy(), self.parents(), len(values)
        for size in self.levels[:0:-1]:
            level = slice(end - size, end)
            np.add.at(out, parents[level], out[level])
            end -= size
        return out


_NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_LIGHT = f"{_NODE}, under binary"


def _laid_out(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """The nodes of whole shards: rows of (shard, under, depth, conv_id, labels, bytes, ends), a conversation's bands one after the other."""
    shards, tops, ids, length, under, depths = {}, [], [], [], [], []
    labels, size = [], []
    for r in rows:
        if not (ids and ids[-1] == r["conv_id"]):
            if r["shard"] not in shards:
                shards[r["shard"]] = len(shards)
                under.append(r["under"])
                depths.append(r["depth"])
            tops.append(shards[r["shard"]])
            ids.append(r["conv_id"])
            length.append(0)
        length[-1] += len(r["labels"])
        labels += r["labels"]
        size += r["bytes"]
    tops, ids, length = np.array(tops), np.array(ids, "int64"), np.array(length)
    begin = np.cumsum(length) - length
    codes = pa.array(labels, pa.binary()).dictionary_encode().indices.to_numpy().astype("int64")
    forest = Forest(tops, begin, length, codes)
    n, at = len(forest.labels), forest.at
    owner = np.repeat(ids, length)
    least, members, last = np.full(n, np.iinfo("int64").max), np.zeros(n, "int64"), np.zeros(n, "int64")
    np.minimum.at(least, at, owner)
    np.add.at(members, at, 1)
    last[at] = size
    children, parents = forest.degrees(), forest.parents()
    leaves = forest.rolled_up((children == 0).astype("int64"))
    saved = forest.rolled_up((members - 1) * last)
    top = np.zeros(n, "int64")
    top[at[begin]] = tops
    depth = np.zeros(n, "int64")
    end = 1
    for k, count in enumerate(forest.levels[1:]):
        level = slice(end, end + count)
        if k:
            top[level] = top[parents[level]]
        depth[level] = k
        end += count
    depth += np.array(depths)[top]
    ends: dict[int, list[int]] = {}
    for node, c in sorted(zip(at[begin + length - 1].tolist(), ids.tolist())):
        ends.setdefault(node, []).append(c)
    digests = [_NONE] * n
    for node, found in ends.items():
        digests[node] = hashlib.sha256(",".join(map(str, found)).encode()).hexdigest()
    is_top = parents == 0
    upper = [under[t] if x else None for t, x in zip(top.tolist(), is_top.tolist())]
    parent = pa.array(least[np.maximum(parents, 0)], mask=is_top)
    columns = [pa.array(least), pa.array(depth), parent, pa.array(members), pa.array(children), pa.array(leaves), pa.array(saved), pa.array(digests, pa.string()), pa.array(upper, pa.binary())]
    names = [c.split(" ")[0] for c in _LIGHT.split(", ")]
    yield pa.RecordBatch.from_arrays([c.slice(1) for c in columns], names=names)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of all shards of a partition, in forests of whole shards."""
    held, weight = [], 0
    for batch in batches:
        for row in batch.to_pylist():
            if weight >= FOREST and held[-1]["shard"] != row["shard"]:
                yield from _laid_out(held)
                held, weight = [], 0
            held.append(row)
            weight += len(row["labels"])
    if held:
        yield from _laid_out(held)
    release()


def _chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) as chunks of ids joined by commas."""
    node, ids, size = None, [], 0

    def chunk():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([int(ids[0])], pa.int64()), pa.array([",".join(ids)], pa.string())], names=["node", "first", "ids"])

    for batch in batches:
        for p, c in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
            if ids and (p != node or size > CHUNK):
                yield chunk()
                ids, size = [], 0
            node, c = p, str(c)
            ids.append(c)
            size += len(c) + 1
    if ids:
        yield chunk()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted chunks as one digest for each node."""
    node, state = None, None

    def done():
        return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["node", "ends_sha256"])

    for batch in batches:
        for p, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if state is None or p != node:
                if state is not None:
                    yield done()
                node, state = p, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
    if state is not None:
        yield done()


def _ends(rows: DataFrame) -> DataFrame:
    """node, ends_sha256 of (node, conv_id) rows: tasks join ids of ranges, then a node's chunks are digested in order."""
    chunks = rows.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_chunked, "node binary, first long, ids string")
    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(_digested, "node binary, ends_sha256 string")


def _subtrees(nodes: DataFrame, made: list[str]) -> DataFrame:
    """node, n_leaves, saved_tokens summed over the subtrees of (node, parent, n_leaves, saved_tokens), by doubling."""
    now = written(nodes.select("node", F.col("parent").alias("up"), "n_leaves", "saved_tokens"), "trie-up", made)
    while now.where("up IS NOT NULL").limit(1).count():
        more = now.where("up IS NOT NULL").groupBy(F.col("up").alias("node")).agg(F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
        above = now.select(F.col("node").alias("up"), F.col("up").alias("_up"))
        after = now.join(more, "node", "left").join(above, "up", "left")
        now = written(after.select("node", F.col("_up").alias("up"), (F.col("n_leaves") + F.coalesce("_l", F.lit(0))).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("_s", F.lit(0))).alias("saved_tokens")), "trie-up", made)
    return now.drop("up")


def prefix_trie(turns: DataFrame, ids: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """A row for each distinct prefix of conversations (conv_id, depth, label, bytes) and one for the root.

    ids has conv_id and n, its number of turns, for each conversation, those
    without turns too. conv_id: the smallest member; depth; parent_conv_id;
    n_convs; n_children; n_leaves; saved_tokens, summed over the subtree, of
    each node's (n_convs - 1) x bytes; ends_sha256 of the ids that end there.
    Without conversations there are no rows.
    """
    spark, made = turns.sparkSession, []
    small_batches(spark)
    bands = banded(turns, band, made)
    owned = bands.join(ids, "conv_id")
    steps = owned.select("conv_id", "n", "band", "start", "prefixes", F.posexplode(F.arrays_zip("prefixes", "bytes")).alias("i", "x"))
    before = F.when(F.col("i") == 0, F.col("start")).otherwise(F.get("prefixes", F.col("i") - 1))
    steps = steps.select("conv_id", (F.col("band") * band + F.col("i") + 1).alias("depth"), "n", F.col("x.prefixes").alias("node"), before.alias("parent"), F.col("x.bytes").alias("bytes"))
    nodes = steps.groupBy("node").agg(F.sum(F.col("n") - F.col("depth") + 1).alias("weight"), F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.first("bytes").alias("bytes"))
    heavy = written(nodes.where(F.col("weight") > shard).drop("weight"), "trie-heavy", made)
    cut = steps.select("conv_id", "depth", "node").join(heavy.select("node"), "node", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("m"))
    cut = written(ids.join(cut, "conv_id", "left").select("conv_id", "n", F.coalesce("m", F.lit(0)).alias("m")), "trie-cut", made)
    # the shards: what follows the last heavy prefix of each conversation
    parts = bands.join(cut.where("n > m"), "conv_id").withColumn("_at", F.floor(F.col("m") / band)).where("band >= _at")
    skip = F.when(F.col("band") == F.col("_at"), (F.col("m") % band).cast("int")).otherwise(0)
    here = parts.where("band = _at")
    at = (F.col("m") % band).cast("int")
    named = here.select("conv_id", F.get("prefixes", at).alias("shard"), F.when(at == 0, F.col("start")).otherwise(F.get("prefixes", at - 1)).alias("under"))
    kept = ["conv_id", "band", (F.col("m") + 1).alias("depth"), F.slice("labels", skip + 1, F.size("labels")).alias("labels"), F.slice("bytes", skip + 1, F.size("bytes")).alias("bytes")]
    first = here.select(F.get("prefixes", at).alias("shard"), F.when(at == 0, F.col("start")).otherwise(F.get("prefixes", at - 1)).alias("under"), *kept)
    later = parts.where("band > _at")
    later = later.join(named, "conv_id").select("shard", "under", *kept)
    shards = first.unionByName(later).repartition("shard").sortWithinPartitions("shard", "conv_id", "band")
    light = written(shards.mapInArrow(_shards, _LIGHT), "trie-light")
    # the heavy prefixes and the root
    root = ids.agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(F.lit(b"").alias("node"), "n_convs", "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("bytes"))
    upper = written(heavy.unionByName(root), "trie-upper", made)
    brought = light.where("under IS NOT NULL").select(F.col("under").alias("node"), "n_leaves", "saved_tokens")
    zero = F.lit(0).cast("long")
    brought = brought.unionByName(upper.where("parent IS NOT NULL").select(F.col("parent").alias("node"), zero.alias("n_leaves"), zero.alias("saved_tokens")))
    brought = brought.groupBy("node").agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("_l"), F.sum("saved_tokens").alias("_s"))
    upper = upper.join(brought, "node", "left").fillna(0, ["n_children", "_l", "_s"])
    upper = upper.withColumn("n_leaves", F.col("_l") + (F.col("n_children") == 0).cast("long")).withColumn("saved_tokens", F.col("_s") + (F.col("n_convs") - 1) * F.col("bytes")).drop("_l", "_s")
    upper = written(upper, "trie-upper", made)
    sums = _subtrees(upper, made)
    ended = cut.where("n = m").select("conv_id", "n")
    last = bands.join(ended.where("n > 0"), "conv_id").where(F.col("band") == F.floor((F.col("n") - 1) / band)).select(F.element_at("prefixes", -1).alias("node"), "conv_id")
    ends = _ends(last.unionByName(ended.where("n = 0").select(F.lit(b"").alias("node"), "conv_id")))
    over = upper.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    top = upper.drop("n_leaves", "saved_tokens").join(sums, "node").join(over, "parent", "left").join(ends, "node", "left").fillna(_NONE, ["ends_sha256"])
    columns = [c.split(" ")[0] for c in _NODE.split(", ")]
    top = written(top.select(columns), "trie-top")
    tops = light.where("under IS NOT NULL").drop("parent_conv_id").join(over.withColumnRenamed("parent", "under"), "under").select(columns)
    out = written(light.where("under IS NULL").select(columns).unionByName(tops).unionByName(top), "trie-nodes")
    for path in made:
        drop_path(spark, path)
    return out


def trie_of(conversations: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """prefix_trie() of the rebuilt conversations (rebuilt()) of rows (conv_id, turn, role, text).

    Rows of a conversation stand by turn, nulls first, then by role and text,
    null ones empty; so repeated rows are turns one after the other. Rows
    without conv_id are left out: their conversation has no id to rebuild it
    by. Texts are taken whole; an empty table gives no rows; other columns are
    left aside.
    """
    made: list[str] = []
    small_batches(conversations.sparkSession)
    turns, ids = rebuilt(conversations, made)
    out = prefix_trie(turns, ids, shard, band)
    for path in made:
        drop_path(conversations.sparkSession, path)
    return out


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_of(table(spark, sf_dir, "conversations"))


def oracle() -> str:
    """The same by digests of whole prefixes, each node's ancestors found along its smallest member."""
    return f"""
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % {FAMILY} AS base, {sql_crc32('CAST(conv_id AS VARCHAR)')} % {HEAD + 1} AS h, count(*) AS n FROM o GROUP BY conv_id),
k AS (SELECT c.*, least(c.h, coalesce(b.n, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
t AS (SELECT k.conv_id, o.place AS depth, role, text FROM k JOIN o ON o.conv_id = k.base AND o.place <= k.h
  UNION ALL SELECT k.conv_id, o.place - k.h + k.k, role, text FROM k JOIN o ON o.conv_id = k.conv_id AND o.place > k.h),
l AS (SELECT conv_id, depth, strlen(text) AS bytes, sha256(string_agg(strlen(role) || ':' || strlen(text) || ':' || role || text, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS node FROM t
  UNION ALL SELECT conv_id, 0, 0, '' FROM k),
z AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS n, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS parent FROM l),
g AS (SELECT node, min(conv_id) AS conv_id, min(depth) AS depth, min(bytes) AS bytes, min(parent) AS parent, count(*) AS n_convs, string_agg(CASE WHEN n = depth THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends FROM z GROUP BY node),
x AS (SELECT g.*, coalesce(m.n_children, 0) AS n_children FROM g LEFT JOIN (SELECT parent, count(*) AS n_children FROM g GROUP BY parent) m ON m.parent = g.node),
a AS (SELECT z.node, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved_tokens FROM x JOIN z ON z.conv_id = x.conv_id AND z.depth <= x.depth GROUP BY z.node)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(a.n_leaves AS BIGINT) AS n_leaves, CAST(a.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM x JOIN a ON a.node = x.node LEFT JOIN x p ON p.node = x.parent"""
