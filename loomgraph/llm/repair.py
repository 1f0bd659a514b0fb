"""Conversation structure repair (operator 12): A* on the edit lattice.

A conversation's rows are kept, given another role or deleted, and turns are
inserted, so that their roles read as an optional system turn and pairs of user
and assistant. The lattice has a node for each row and state of that pattern.
Searches are keyed by (cost plus heuristic, audit): the heuristic is the sum,
over the rows to come, of what they cost at least - 2 for each that must be
deleted, and 2 for each truncated one, which is deleted or charged - so it is
consistent, a node is settled when it is first popped, and equal costs are
settled by the ASCII-least audit.

Conversations of up to ROWS rows and BYTES of text are searched whole, in one
task each after one shuffle. Longer ones are cut into blocks of those sizes: a
search for each pair of a block's first and last state gives a 4 x 4 table of
costs, tables are folded from the end, and blocks are searched again, with the
cost of all that follows as their goals' charges. Insertions stand before a row
of their block, or at the end of the conversation, so an audit is cut in one
way only and the blocks' audits, joined, are the whole search's.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import drop_path, release, small_batches, sql_crc32, table, written

#: Rows and bytes of text of a conversation that is searched whole, and of a block of a longer one.
ROWS, BYTES = 1024, 4 << 20
#: White space; what a whole text ends with.
SPACE, STOPS = "\t\n\x0b\x0c\r ", ".!?"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 1, 2, 5, 5
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)

#: States: nothing yet, after a system turn, after a user's, after an assistant's. What a kept role leads to, and a turn that is given its role.
START, SYSTEM, USER, ASSISTANT = range(4)
_KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_GIVEN = (USER, USER, ASSISTANT, USER)
#: Cost of what must still be inserted after the last row.
_CLOSE = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}
_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}

Row = tuple[str, int, int]


def search(rows: list[Row], start: int, ends: dict[int, int], close: bool) -> tuple[int, str, int] | None:
    """(cost, audit, last state) of the cheapest edits from a state, ties to the ASCII-least audit; None if no end can be reached.

    rows: (role's initial, fault, times) - further times of a row are forced
    deletions. ends: charge of each state that may be the last. close: whether
    turns may be inserted after the last row.
    """
    n = len(rows)
    ahead = [0] * (n + 1)
    for k in range(n - 1, -1, -1):
        _, fault, times = rows[k]
        ahead[k] = ahead[k + 1] + DELETE * (times - (fault == FINE))
    heap, settled = [(ahead[0], "", 0, start, 0)], set()
    while heap:
        total, audit, k, state, cost = heapq.heappop(heap)
        if (k, state) in settled:
            continue
        settled.add((k, state))
        if k > n:
            return cost, audit, state - len(_GIVEN)
        push = heapq.heappush
        if k == n:
            if state in ends:
                push(heap, (cost + ends[state], audit, n + 1, state + len(_GIVEN), cost + ends[state]))
            if not close:
                continue
        else:
            initial, fault, times = rows[k]
            more, rest = DELETE * (times - 1), "D" * (times - 1)
            ways = [(DELETE, "D", state)]
            if fault in (FINE, TRUNCATED):
                charge = CUT if fault == TRUNCATED else 0
                if initial in _KEPT[state]:
                    ways.append((KEEP + charge, "K", _KEPT[state][initial]))
                ways.append((REROLE + charge, "R", _GIVEN[state]))
            for price, letter, to in ways:
                if (k + 1, to) not in settled:
                    c = cost + price + more
                    push(heap, (c + ahead[k + 1], audit + letter + rest, k + 1, to, c))
        if (k, _GIVEN[state]) not in settled:
            push(heap, (cost + INSERT + ahead[k], audit + "I", k, _GIVEN[state], cost + INSERT))
    return None


def apply_audit(rows: list[tuple[str, str, int]], audit: str, state: int) -> Iterator[str]:
    """role:text of what the audit leaves of (role, text, times), from a state."""
    letters = iter(audit)

    def until_row() -> Iterator[str]:
        nonlocal state
        for letter in letters:
            if letter != "I":
                return letter
            state = _GIVEN[state]
            yield ("user:", "assistant:")[state == ASSISTANT]

    for role, text, times in rows:
        letter = yield from until_row()
        if letter == "K":
            state = _KEPT[state][role[:1]]
            yield f"{role}:{text}"
        elif letter == "R":
            state = _GIVEN[state]
            yield f"{('user', 'assistant')[state == ASSISTANT]}:{text}"
        for _ in range(times - 1):
            next(letters)
    yield from until_row()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times, blank, truncated: conversations with the faults that crc32(conv_id:turn) % 20 names.

    0 drops a row (times is 0), 1 empties its text, 2 takes its full stops,
    exclamation and question marks, 3 repeats it (times is 2), 4 makes it the
    user's. Nulls in role and text, and in the key, count as one space.
    """

    def name(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), F.lit(" "))

    fault = F.pmod(F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")), F.lit(20))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"), fault.alias("_f"))
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("_f") == 0, 0).when(F.col("_f") == 3, 2).otherwise(1).cast("long").alias("times"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    return rows.select("*", (end == "").alias("blank"), (~end.isin(*STOPS)).alias("truncated"))


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_RESULT = ", ".join(f"{c} long" for c in _COUNTS) + ", audit string, repaired_sha256 string"


def _fault(blank: bool, seen: bool, truncated: bool) -> int:
    return BLANK if blank else DUPLICATE if seen else TRUNCATED if truncated else FINE


def _whole(rows: list[tuple]) -> tuple:
    """The result of one conversation: its rows (turn, role, text, times, blank, truncated) in order."""
    seen: set[tuple[str, str]] = set()
    kinds, found, illegal, before = [], [0] * 4, 0, None
    for _, role, text, times, blank, truncated in rows:
        fault = _fault(blank, (role, text) in seen, truncated)
        seen.add((role, text))
        kinds.append((role[:1], fault, times))
        found[fault] += 1
        found[BLANK if blank else DUPLICATE] += times - 1
        if before is not None:
            illegal += (before, role[:1]) not in _LEGAL
        illegal += times - 1
        before = role[:1]
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    cost, audit, _ = search(kinds, START, {START: 0, ASSISTANT: 0}, True)
    left = "\n".join(apply_audit([(r[1], r[2], r[3]) for r in rows], audit, START))
    return gaps, found[BLANK], found[DUPLICATE], found[TRUNCATED], illegal, cost, audit, hashlib.sha256(left.encode()).hexdigest()


_FIELDS = ["turn", "role", "text", "times", "blank", "truncated"]


def _runs(batches: Iterator[pa.RecordBatch], fields: list[str]) -> Iterator[tuple]:
    """(key, rows) of sorted batches: the consecutive rows of one conv_id."""
    key, rows, any_yet = None, [], False
    for batch in batches:
        for c, *row in zip(batch.column("conv_id").to_pylist(), *(batch.column(f).to_pylist() for f in fields)):
            if any_yet and c != key:
                yield key, rows
                rows = []
            key, any_yet = c, True
            rows.append(tuple(row))
    if any_yet:
        yield key, rows


def _repair_short(rows: DataFrame, id_type: pa.DataType) -> DataFrame:
    """Conversations of bounded size: gathered by one shuffle, searched one after the other."""
    placed = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        out = []

        def batch():
            ids, *columns = zip(*out)
            return pa.RecordBatch.from_arrays([pa.array(ids, id_type), *(pa.array(c, pa.int64()) for c in columns[:6]), *(pa.array(c, pa.string()) for c in columns[6:])], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        for key, found in _runs(batches, _FIELDS):
            out.append((key, *_whole(found)))
            if len(out) == 1000:
                yield batch()
                out.clear()
        if out:
            yield batch()
        release()

    return placed.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_RESULT}")


def _number_blocks(rows: DataFrame, most: int, size: int) -> DataFrame:
    """rows in order, cut into ranges over the tasks, with part, at (place in it) and block."""
    once = rows.groupBy("conv_id", "turn", "role", "text", "blank", "truncated").agg(F.sum("times").alias("times"))
    ranges = once.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64))
    ranges = ranges.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")

    def run(batches):
        part, at, block, held, weight, before = TaskContext.get().partitionId(), 0, -1, 0, 0, object()
        for batch in batches:
            blocks = []
            for key, text in zip(batch.column("conv_id").to_pylist(), batch.column("text")):
                n = text.as_buffer().size
                if key != before or held >= most or weight + n > size:
                    block, held, weight, before = block + 1, 0, 0, key
                held, weight = held + 1, weight + n
                blocks.append(block)
            k = len(blocks)
            places = pa.array(range(at, at + k), pa.int64())
            at += k
            yield batch.append_column("part", pa.array([part] * k, pa.int64())).append_column("at", places).append_column("block", pa.array(blocks, pa.int64()))

    return ranges.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in ranges.schema)}, part long, at long, block long")


def _kinds(group: pd.DataFrame) -> list[Row]:
    group = group.sort_values("at")
    return [(a, _fault(b, not c, d), t) for a, b, c, d, t in zip(group["initial"], group["blank"], group["fresh"], group["truncated"], group["times"])]


def _summary(group: pd.DataFrame) -> pd.DataFrame:
    """Counts of a block, its first and last initial and the costs from each state to each."""
    kinds = _kinds(group)
    found, illegal, before = [0] * 4, 0, None
    blank = group.sort_values("at")["blank"].tolist()
    for (initial, fault, times), empty in zip(kinds, blank):
        found[fault] += 1
        found[BLANK if empty else DUPLICATE] += times - 1
        illegal += times - 1 + (before is not None and (before, initial) not in _LEGAL)
        before = initial
    costs = [r[0] if (r := search(kinds, p, {q: 0}, False)) else -1 for p in range(4) for q in range(4)]
    key = group.iloc[0]
    return pd.DataFrame([[key["part"], key["block"], *found[1:], illegal, kinds[0][0], before, costs]], columns=["part", "block", "blank", "duplicate", "truncated", "illegal", "first", "last", "costs"])


def _fold(blocks: pd.DataFrame) -> pd.DataFrame:
    """charges: for each block of a conversation, what follows costs from each state that it may end in."""
    blocks = blocks.sort_values(["part", "block"])
    after, out = [_CLOSE[q] for q in range(4)], []
    for part, block, costs in list(zip(blocks["part"], blocks["block"], blocks["costs"]))[::-1]:
        out.append((part, block, after, not out))
        after = [min((int(costs[4 * p + q]) + after[q] for q in range(4) if costs[4 * p + q] >= 0), default=-1) for p in range(4)]
    return pd.DataFrame(out, columns=["part", "block", "charges", "final"])


def _searched(group: pd.DataFrame, charged: pd.DataFrame) -> pd.DataFrame:
    """For each first state of a block, its audit under the charges, the state that it ends in and its own cost."""
    kinds, charges, final = _kinds(group), charged.iloc[0]["charges"], bool(charged.iloc[0]["final"])
    ends = {START: 0, ASSISTANT: 0} if final else {q: int(charges[q]) for q in range(4)}
    found = [search(kinds, p, ends, final) for p in range(4)]
    key = group.iloc[0]
    return pd.DataFrame([[key["part"], key["block"], [a for _, a, _ in found], [q for _, _, q in found], [c for c, _, _ in found]]], columns=["part", "block", "audits", "lasts", "totals"])


def _chosen(blocks: pd.DataFrame) -> pd.DataFrame:
    """The state that each block of a conversation starts in, and the cost of the whole at its first."""
    blocks = blocks.sort_values(["part", "block"])
    state, out = START, []
    for part, block, lasts, totals in zip(blocks["part"], blocks["block"], blocks["lasts"], blocks["totals"]):
        out.append((part, block, state, int(totals[state]) if not out else 0))
        state = int(lasts[state])
    return pd.DataFrame(out, columns=["part", "block", "state", "cost"])


def _chunk(rows: pd.DataFrame, chosen: pd.DataFrame) -> pd.DataFrame:
    """What a block's edits leave, joined by line ends; null if nothing."""
    rows, c = rows.sort_values("at"), chosen.iloc[0]
    left = list(apply_audit(list(zip(rows["role"], rows["text"], rows["times"])), c["audit"], int(c["state"])))
    return pd.DataFrame([[c["part"], c["block"], "\n".join(left) if left else None]], columns=["part", "block", "chunk"])


def _repair_long(rows: DataFrame, id_type: pa.DataType, most: int, size: int) -> DataFrame:
    """Conversations of any size, in blocks; only texts' digests and searches' tables meet by conversation, and the chunks of the result, which its digest reads one after the other."""
    made: list[str] = []
    key = ["part", "block"]
    all_rows = written(_number_blocks(rows, most, size), "repair-rows", made)
    firsts = all_rows.groupBy("conv_id", "role", F.sha2("text", 256)).agg(F.min(F.struct("part", "at")).alias("f")).select("f.part", "f.at", F.lit(True).alias("fresh"))
    kinds = all_rows.select("conv_id", "part", "at", "block", "times", "blank", "truncated", F.left("role", F.lit(1)).alias("initial")).join(firsts, ["part", "at"], "left").fillna(False, ["fresh"])
    kinds = written(kinds, "repair-kinds", made)
    summary = kinds.groupBy(*key).applyInPandas(_summary, "part long, block long, blank long, duplicate long, truncated long, illegal long, first string, last string, costs array<long>")
    owners = kinds.select("conv_id", *key).distinct()
    summary = written(summary.join(owners, key), "repair-summary", made)
    charges = summary.groupBy("conv_id").applyInPandas(_fold, "part long, block long, charges array<long>, final boolean")
    audits = kinds.groupBy(*key).cogroup(charges.groupBy(*key)).applyInPandas(_searched, "part long, block long, audits array<string>, lasts array<long>, totals array<long>")
    audits = written(audits.join(owners, key), "repair-audits", made)
    chosen = audits.select("conv_id", *key, "lasts", "totals").groupBy("conv_id").applyInPandas(_chosen, "part long, block long, state long, cost long")
    chosen = written(chosen.join(audits, key).select("conv_id", *key, "state", "cost", F.element_at("audits", (F.col("state") + 1).cast("int")).alias("audit")), "repair-chosen", made)
    chunks = all_rows.select(*key, "at", "role", "text", "times").groupBy(*key).cogroup(chosen.select(*key, "state", "audit").groupBy(*key)).applyInPandas(_chunk, "part long, block long, chunk string")
    turns = all_rows.where("turn IS NOT NULL").select("conv_id", "turn").distinct().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count(F.lit(1))).alias("gaps")).select(F.col("conv_id").alias("_c"), "gaps")
    joined = chosen.join(summary.drop("conv_id"), key).join(chunks, key).join(turns, F.col("conv_id").eqNullSafe(F.col("_c")), "left").fillna(0, ["gaps"]).drop("_c")
    fields = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "first", "last", "chunk"]
    lined = joined.repartition("conv_id").sortWithinPartitions("conv_id", *key)

    def run(batches):
        at, state = object(), None

        def result():
            gaps, blank, duplicate, truncated, illegal, cost, audit, _, digest, _ = state
            columns = [[at], [gaps], [blank], [duplicate], [truncated], [illegal], [cost], ["".join(audit)], [digest.hexdigest()]]
            types = [id_type, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", *_COUNTS, "audit", "repaired_sha256"])

        for batch in batches:
            for c, *row in zip(batch.column("conv_id").to_pylist(), *(batch.column(f).to_pylist() for f in fields)):
                if state is None or c != at:
                    if state is not None:
                        yield result()
                    at, state = c, [row[0], 0, 0, 0, 0, 0, [], None, hashlib.sha256(), False]
                _, blank, duplicate, truncated, illegal, cost, audit, first, last, chunk = row
                for k, x in enumerate((blank, duplicate, truncated, illegal, cost), 1):
                    state[k] += x
                if state[7] is not None:
                    state[4] += (state[7], first) not in _LEGAL
                state[6].append(audit)
                state[7] = last
                if chunk is not None:
                    state[8].update((("\n" if state[9] else "") + chunk).encode())
                    state[9] = True
        if state is not None:
            yield result()

    done = written(lined.mapInArrow(run, f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, {_RESULT}"), "repair-long")
    for path in made:
        drop_path(rows.sparkSession, path)
    return done


def repair(rows: DataFrame, most: int = ROWS, size: int = BYTES) -> DataFrame:
    """conv_id, counts of faults, cost, audit and repaired_sha256 for each conv_id of rows as damaged() returns them.

    Rows of a conversation stand by turn, nulls first, then by role and text.
    Rows with times of 0 are gone, but their conversation stays: without rows
    it has zeros, an empty audit and the digest of an empty text. A null
    conv_id is a conversation like others; rows that are alike in all are
    duplicates of the first; texts are taken whole; an empty table gives no
    rows; other columns are left aside. An audit has a letter for each row
    and each inserted turn, so it is as long as the conversation. For
    conversations of more than most rows or size bytes, one task reads the repaired
    text in chunks to digest it: SHA-256 has no other way.
    """
    spark, made = rows.sparkSession, []
    small_batches(spark)
    rows = rows.select("conv_id", *_FIELDS)
    sizes = rows.groupBy("conv_id").agg(F.sum("times").alias("n"), F.sum(F.octet_length("text")).alias("bytes"))
    sizes = written(sizes, "repair-sizes", made)
    is_long = (F.col("n") > most) | (F.col("bytes") > size)
    long = sizes.where(is_long).select(F.col("conv_id").alias("_long"))
    id_type = to_arrow_type(rows.schema["conv_id"].dataType)
    left = rows.where("times > 0")
    gone = sizes.where("n = 0").select("conv_id", *(F.lit(0).cast("long").alias(c) for c in _COUNTS), F.lit("").alias("audit"), F.lit(hashlib.sha256().hexdigest()).alias("repaired_sha256"))
    if not long.limit(1).count():
        return _repair_short(left, id_type).unionByName(gone)
    same = F.col("conv_id").eqNullSafe(F.col("_long"))
    return _repair_short(left.join(long, same, "left_anti"), id_type).unionByName(_repair_long(left.join(long, same, "left_semi"), id_type, most, size)).unionByName(gone)


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


def _sql_step(ways: list[tuple[str, str, str, str]]) -> str:
    """The best of ways (state, cost, letters, condition) to a state."""
    each = ", ".join(f"{{'c': CASE WHEN {when} THEN {state}.c + {cost} ELSE 1000000000 END, 'a': {state}.a || '{letters}'}}" for state, cost, letters, when in ways)
    return f"list_sort([{each}])[1]"


def oracle() -> str:
    """The same as a fold of rows over the best (cost, audit) of each state."""
    key = "coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')"
    none = "{'c': 1000000000, 'a': ''}"
    usable, charge = "fault IN (0, 3)", "(CASE WHEN fault = 3 THEN 5 ELSE 0 END)"
    insert = [("s2", "0", "", "true"), ("s0", "5", "I", "true"), ("s1", "5", "I", "true"), ("s3", "5", "I", "true")]
    to_user = [("t2", "2", "D", "true")]
    for state in ("t0", "t1", "t3"):
        to_user += [(state, charge, "K", f"{usable} AND initial = 'u'"), (state, f"1 + {charge}", "R", usable)]
    to_assistant = [("t3", "2", "D", "true"), ("t2", charge, "K", f"{usable} AND initial = 'a'"), ("t2", f"1 + {charge}", "R", usable)]
    return f"""
WITH RECURSIVE r0 AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {sql_crc32(key)} % 20 AS f FROM conversations),
r1 AS (SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM r0),
r2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen FROM r1),
r3 AS (SELECT *, role[1:1] AS initial, lag(role[1:1]) OVER (PARTITION BY conv_id ORDER BY i) AS previous, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN seen > 1 THEN 2
  WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 3 ELSE 0 END AS fault FROM r2),
n AS (SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
  count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (previous IS NOT NULL AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM r3 GROUP BY conv_id),
dp(conv_id, i, t0, t1, t2, t3) AS (
  SELECT conv_id, CAST(0 AS BIGINT), {{'c': 0, 'a': ''}}, {none}, {{'c': 5, 'a': 'I'}}, {{'c': 10, 'a': 'II'}} FROM n
  UNION ALL
  SELECT conv_id, i, s0, s1, u2, {_sql_step([("s3", "0", "", "true"), ("u2", "5", "I", "true")])} FROM (
    SELECT *, {_sql_step(insert)} AS u2 FROM (
      SELECT r3.conv_id, r3.i, {{'c': t0.c + 2, 'a': t0.a || 'D'}} AS s0, {_sql_step([("t1", "2", "D", "true"), ("t0", charge, "K", f"{usable} AND initial = 's'")])} AS s1,
        {_sql_step(to_user)} AS s2, {_sql_step(to_assistant)} AS s3
      FROM dp JOIN r3 ON r3.conv_id IS NOT DISTINCT FROM dp.conv_id AND r3.i = dp.i + 1))),
best AS (SELECT n.*, list_sort([t0, t3])[1] AS x FROM n JOIN dp ON dp.conv_id IS NOT DISTINCT FROM n.conv_id AND dp.i = n.n),
letters AS (SELECT conv_id, unnest(range(1, len(x.a) + 1)) AS p, x.a AS a FROM best),
placed AS (SELECT conv_id, p, a[p:p] AS letter, len(replace(a[1:p], 'I', '')) AS i, len(replace(a[1:p], 'D', '')) AS j FROM letters),
made AS (SELECT l.conv_id, l.p, l.letter, l.j, r3.role, r3.text, r3.initial FROM placed l LEFT JOIN r3 ON l.letter <> 'I' AND r3.conv_id IS NOT DISTINCT FROM l.conv_id AND r3.i = l.i WHERE l.letter <> 'D'),
sys AS (SELECT *, coalesce(max(CASE WHEN j = 1 AND letter = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id), 0) AS s FROM made),
said AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS body FROM sys GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(best.x.c, 0) AS BIGINT) AS cost, coalesce(best.x.a, '') AS audit, sha256(coalesce(body, '')) AS repaired_sha256
FROM ids LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN said ON said.conv_id IS NOT DISTINCT FROM ids.conv_id"""
