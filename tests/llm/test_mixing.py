"""Operator 11 against sorting, and its promises on skewed and odd tables."""

import random
from collections import Counter, defaultdict

import duckdb
import pytest

from loomgraph.llm import mixing

SCHEMA = "doc_id long, text string, source string"


def in_sql(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    out = con.execute(mixing.oracle())
    names = [d[0] for d in out.description]
    return sorted((tuple(x) for x in out.fetchall()), key=str), names


def mixed(df, names):
    return sorted((tuple(x) for x in mixing.mix(df).select(*names).collect()), key=str)


def text(r, n):
    return r.choice([" ", "\n", "\t \x0b"]).join("w" * r.randint(1, 4) for _ in range(n))


def odd_table(r):
    rows = [(k, text(r, r.choice([0, 1, 5, 50])), f"s{k % 7}") for k in range(300)]
    rows += [(1000 + k, text(r, 400), "big") for k in range(200)]  # far more than its share
    rows += [(None, text(r, 3), None) for _ in range(20)] + [(2000 + k, None, "é") for k in range(5)] + [(3000, "", "only empty")]
    rows += [(7, "same words here", "s1")] * 40 + [(8, text(r, k), "s1") for k in range(1, 20)]  # one id with many rows
    r.shuffle(rows)
    return rows


def test_against_sorting(spark, tmp_path):
    rows = odd_table(random.Random(1))
    want, names = in_sql(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert mixed(df, names) == want
    df.write.parquet(f"{tmp_path}/docs.parquet")
    assert mixed(spark.read.parquet(f"{tmp_path}/docs.parquet"), names) == want  # and by the rows' places in files


def test_promises(spark):
    rows = odd_table(random.Random(2))
    out = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    taken, target, size, largest = Counter(), {}, Counter(), defaultdict(int)
    for r in out:
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        size[r.source] += r.size
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    for s in target:
        assert abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 and target[s] <= 3 * size[s]
    assert sum(target.values()) == pytest.approx(sum(size.values()))


def test_budgets_are_nested(spark):
    """What a smaller weight takes, a greater one takes too."""
    r = random.Random(3)
    df = spark.createDataFrame([(k, text(r, r.randint(1, 30)), "ab"[k % 2]) for k in range(400)], SCHEMA)
    few = {x.doc_id for x in mixing.mix(df, weights=(1, 9)).collect() if x.source == "a" and x.taken}
    more = {x.doc_id for x in mixing.mix(df, weights=(2, 9)).collect() if x.source == "a" and x.taken}
    assert few < more


@pytest.mark.parametrize("rows", [[], [(1, None, None)], [(1, "one two", "a")], [(1, "one two", "a")] * 5, [(1, "x " * 100, "a"), (2, "y", "b"), (3, "z", "c")]], ids=["empty", "null", "one", "copies", "full"])
def test_small_tables(spark, rows):
    want, names = in_sql(rows)
    assert mixed(spark.createDataFrame(rows, SCHEMA), names) == want


def test_other_columns_do_no_harm(spark):
    df = spark.createDataFrame(odd_table(random.Random(4)), SCHEMA)
    _, names = in_sql([])
    assert mixed(df.selectExpr("*", "1 AS size", "2 AS p0", "3 AS target", "4 AS _s", "5 AS weight"), names) == mixed(df, names)


def test_the_plan_has_no_python(spark):
    """Native: neither a Python worker nor a sort of the documents on the main path."""
    df = spark.createDataFrame([(k, "a b c", "s") for k in range(50)], SCHEMA)
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "InPandas" not in plan
