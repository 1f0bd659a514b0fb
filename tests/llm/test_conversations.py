"""Operators 12 and 13 against brute force and SQL, whole and in pieces."""

import hashlib
import itertools
import random
import zlib

import duckdb
import numpy as np
import pytest

from loomgraph.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"


def odd_rows(r, n, long=0):
    """Conversations with nulls, ties, repeats and empty texts; the first has `long` rows."""
    texts, roles = ["Yes.", "no", "", " \n", "Why?", "Ok. ", "tail", None, "é!\t"], ["system", "user", "assistant", "user", "assistant", None, "", "unknown"]
    rows = []
    for c in range(n):
        many = long if long and c == 0 else r.choice([0, 1, 2, 3, 4, 6])
        for t in range(many):
            rows.append((None if c == 3 else c * 2 - 6, r.choice([t, t, t, None, t // 2]), r.choice(roles), r.choice(texts) if r.random() < 0.7 else f"text {t}."))
    rows += rows[:3]
    return rows


def brute(kinds):
    """Cheapest audit of (initial, fault) rows by trying all, with up to three inserted turns."""
    best = None
    for letters in itertools.product("KRD", repeat=len(kinds)):
        for inserts in range(4):
            for slots in itertools.combinations_with_replacement(range(len(kinds) + 1), inserts):
                audit, cost, state, ok = "", 0, 0, True
                for k in range(len(kinds) + 1):
                    for _ in range(slots.count(k)):
                        state, audit, cost = {0: 2, 1: 2, 2: 3, 3: 2}[state], audit + "I", cost + 5
                    if k == len(kinds):
                        break
                    initial, fault = kinds[k]
                    audit += letters[k]
                    if letters[k] == "D":
                        cost += 2
                        continue
                    if fault in (1, 2):
                        ok = False
                        break
                    cost += 5 * (fault == 3) + (letters[k] == "R")
                    to = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                    if letters[k] == "K":
                        if initial == "s" and state == 0:
                            to = 1
                        elif initial != {2: "u", 3: "a"}[to]:
                            ok = False
                            break
                    state = to
                if ok and state in (0, 3) and (best is None or (cost, audit) < best):
                    best = cost, audit
    return best


def test_search_against_all_audits():
    r = random.Random(5)
    for _ in range(150):
        kinds = [(r.choice("suax"), r.choice([0, 0, 0, 1, 2, 3])) for _ in range(r.randint(0, 4))]
        assert repair.search([(a, b, 1) for a, b in kinds], 0, {0: 0, 3: 0}, True)[:2] == brute(kinds), kinds


def test_times_are_forced_deletions():
    r = random.Random(6)
    for _ in range(200):
        runs = [(r.choice("sua"), r.choice([0, 1, 2, 3]), r.randint(1, 3)) for _ in range(r.randint(0, 6))]
        flat = [x for a, b, n in runs for x in [(a, b, 1)] + [(a, 2, 1)] * (n - 1)]
        assert repair.search(runs, 0, {0: 0, 3: 0}, True) == repair.search(flat, 0, {0: 0, 3: 0}, True)


def in_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return sorted((tuple(x) for x in out.fetchall()), key=str), names


@pytest.mark.parametrize("most, size", [(repair.ROWS, repair.BYTES), (3, repair.BYTES), (2, 20)], ids=["whole", "blocks", "small blocks"])
def test_repair_against_sql(spark, most, size):
    rows = odd_rows(random.Random(7), 60, long=90)
    want, names = in_sql(rows, repair.oracle())
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = sorted((tuple(r) for r in repair.repair(repair.damaged(df), most, size).select(*names).collect()), key=str)
    assert got == want
    assert any(r[1] for r in got) and any(r[6] for r in got)


def test_a_conversation_without_rows_after_damage(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = repair.repair(repair.damaged(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA))).collect()
    assert [tuple(r) for r in got] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(repair.damaged(none)).collect() == []
    assert trie.trie_of(none).collect() == []


def test_other_columns_do_no_harm(spark):
    rows = odd_rows(random.Random(8), 12)
    df = spark.createDataFrame(rows, SCHEMA)
    wide = df.selectExpr("*", "1 AS label", "2 AS n", "3 AS part", "'x' AS blank", "4 AS times", "5 AS depth", "6 AS base")

    def all_of(x):
        return sorted(map(str, x.collect()))

    assert all_of(repair.repair(repair.damaged(df))) == all_of(repair.repair(repair.damaged(wide)))
    assert all_of(trie.trie_of(df)) == all_of(trie.trie_of(wide))


def test_many_copies_of_one_row(spark):
    """A row that makes up most of a conversation is counted before it moves, and deleted in its block."""
    rows = [(1, 0, "user", "Hello.")] * 3000 + [(1, 1, "assistant", "Yes.")]
    want, names = in_sql(rows[:40] + rows[-1:], repair.oracle())
    got = repair.repair(repair.damaged(spark.createDataFrame(rows, SCHEMA))).select(*names).first()
    short = dict(zip(names, want[0]))
    assert got["repaired_sha256"] == short["repaired_sha256"]
    assert got["duplicate"] == short["duplicate"] + 2960 and len(got["audit"]) == len(short["audit"]) + 2960


@pytest.mark.parametrize("shard, band", [(trie.SHARD, trie.BAND), (4, 2), (0, 1)], ids=str)
def test_trie_against_sql(spark, shard, band):
    r = random.Random(9)
    rows = odd_rows(r, 40, long=30)
    # copies of conversations, and many that begin alike
    rows += [(1000 + c, t, "user" if t % 2 == 0 else "assistant", f"turn {t if t < 3 else r.choice([t, -t])}") for c in range(40) for t in range(r.choice([0, 2, 5, 9]))]
    rows += [(5000 + c, t, "user", f"copy {t}") for c in range(12) for t in range(12)]
    want, names = in_sql(rows, trie.oracle())
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted((tuple(x) for x in trie.trie_of(df, shard, band).select(*names).collect()), key=str)
    assert got == want


def test_forest_is_in_level_order():
    """Parents and degrees that the bits give are those of the tree."""
    r = random.Random(10)
    words = sorted({tuple(r.choices(range(3), k=r.randint(1, 5))) for _ in range(40)})
    tops = np.array([w[0] for w in words])
    length = np.array(list(map(len, words)))
    forest = trie.Forest(tops, np.cumsum(length) - length, length, np.array([x for w in words for x in w]))
    prefixes = {w[:k] for w in words for k in range(len(w) + 1)}
    assert len(forest.labels) == len(prefixes) and forest.bits.sum() == len(prefixes) - 1
    parents, paths = forest.parents(), {0: ()}
    assert all(parents[k] < k for k in range(1, len(parents))) and (np.diff(parents) >= 0).all()
    for k in range(1, len(parents)):
        paths[k] = (*paths[parents[k]], int(forest.labels[k]))
    assert set(paths.values()) == prefixes
    assert forest.degrees().tolist() == [sum(p[:-1] == paths[k] and len(p) == len(paths[k]) + 1 for p in prefixes) for k in range(len(paths))]
    assert forest.rolled_up(np.ones(len(paths), "int64")).tolist() == [sum(p[: len(paths[k])] == paths[k] for p in prefixes) for k in range(len(paths))]
