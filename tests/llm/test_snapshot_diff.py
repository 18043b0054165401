"""Snapshot differences against a plain loop and SQL."""

import hashlib
import random
from collections import Counter, defaultdict

import duckdb
import pytest

from papyra.llm import snapshot_diff as P

DDL = "id long, a string, b string, n int, side string, content string, rank int"


def plain_diff(earlier, later, columns=("a", "b", "n")):
    """Rows as (key, {column: value}); for keys that occur once and others."""
    twice = {k for rows in (earlier, later) for k, c in Counter(k for k, _ in rows).items() if c > 1} | {None}
    sha = lambda r: hashlib.sha256("\n".join("~" if r[c] is None else str(r[c]) for c in columns).encode()).hexdigest()
    first, second = {k: r for k, r in earlier if k not in twice}, {k: r for k, r in later if k not in twice}
    out = []
    for k in first.keys() & second.keys():
        changed = [c for c in columns if first[k][c] != second[k][c]]
        out.append((k, k, "update" if changed else "same", ",".join(changed), sha(second[k])))
    old, new = defaultdict(list), defaultdict(list)
    for rows, other, into in ((earlier, second, old), (later, first, new)):
        for k, r in rows:
            if k in twice or k not in other:
                into[tuple(r[c] for c in columns)].append(k)
    for content in old.keys() | new.keys():
        low = lambda k: (k is not None, k or 0)
        a, b = sorted(old[content], key=low), sorted(new[content], key=low, reverse=True)
        digest = sha(dict(zip(columns, content)))
        for i in range(max(len(a), len(b))):
            if i < len(a) and i < len(b):
                out.append((b[i], a[i], "rekey", "", digest))
            elif i < len(a):
                out.append((a[i], a[i], "delete", "", None))
            else:
                out.append((b[i], None, "insert", "", digest))
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(k, r["a"], r["b"], r["n"], "s", "c", 1) for k, r in rows], DDL)


def got(spark, earlier, later):
    found = P.snapshot_diff(frame(spark, earlier), frame(spark, later), "id", ["a", "b", "n"])
    return sorted((tuple(r) for r in found.select("key", "old_key", "op", "changed", "row_sha256").collect()), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_random_snapshots(spark, seed):
    r = random.Random(seed)
    row = lambda: {"a": r.choice([None, "", "~", "x", "x\ny", "w" * 5000]), "b": r.choice([None, "~", "y"]), "n": r.choice([None, 1, 2])}
    earlier = [(k, row()) for k in r.sample(range(-300, 300), 200)]
    later = [(k if r.random() < 0.6 else k + 1000 * r.choice([-1, 1]), v if r.random() < 0.8 else row()) for k, v in earlier if r.random() < 0.9]
    later = list({k: (k, v) for k, v in later}.values())
    later += [(k, row()) for k in range(5000, 5030)]
    assert got(spark, earlier, later) == plain_diff(earlier, later)


def test_a_content_that_most_rows_have(spark):
    """Thousands of equal rows under new keys, more later ones than earlier ones."""
    same = {"a": "copy", "b": None, "n": 1}
    earlier = [(k, same) for k in range(0, 6000, 2)] + [(k, {"a": str(k), "b": "y", "n": 0}) for k in range(1, 2000, 2)]
    later = [(-1 - k, same) for k in range(0, 7000, 2)] + [(k, {"a": str(k), "b": "y", "n": 0}) for k in range(1, 2000, 2)]
    found = got(spark, earlier, later)
    assert found == plain_diff(earlier, later)
    assert Counter(x[2] for x in found) == {"rekey": 3000, "insert": 500, "same": 1000}


def test_repeated_and_null_keys_match_by_content(spark):
    x, y, z = ({"a": v, "b": None, "n": 0} for v in "xyz")
    earlier = [(1, x), (1, x), (1, y), (None, z), (2, y), (3, x)]
    later = [(1, x), (9, x), (None, z), (None, z), (2, x), (3, x)]
    found = got(spark, earlier, later)
    assert found == plain_diff(earlier, later)
    assert Counter(r[2] for r in found) == {"rekey": 3, "update": 1, "same": 1, "delete": 1, "insert": 1}


def test_empty_snapshots(spark):
    rows = [(k, {"a": "x", "b": "y", "n": k}) for k in range(5)]
    assert got(spark, [], []) == []
    assert {x[2] for x in got(spark, rows, [])} == {"delete"} and {x[2] for x in got(spark, [], rows)} == {"insert"}
    assert {x[2] for x in got(spark, rows, rows)} == {"same"}


def test_the_query_equals_its_sql(spark, sf):
    columns = ["key", "old_key", "op", "changed", "row_sha256"]
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    want = con.sql(P.ORACLE_SQL).select(*columns).fetchall()
    found = P.documents_diff(spark.read.parquet(f"{sf}/documents.parquet")).select(*columns).collect()
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, want))
    assert {"same", "update", "rekey", "insert", "delete"} >= {x[2] for x in want} >= {"same", "update", "rekey", "insert"}
