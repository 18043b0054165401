"""Periodic runs against a plain search of every start and period."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from papyra.llm import periodic_runs as P

from .docs import AWKWARD, documents


def plain_runs(words, least_words=6, least_periods=4):
    """All maximal stretches by their smallest period."""
    found, n = {}, len(words)
    for q in range(1, n // least_periods + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least_words, least_periods * q):
                found.setdefault((i, j + q), q)  # smaller periods come first
            i = max(j, i + 1)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def some_texts():
    r = random.Random(5)
    out = []
    for k in range(150):
        n, signs = r.choice([3, 8, 30, 90, 300]), r.choice([1, 2, 3, 30])
        w = [f"w{r.randrange(signs)}" for _ in range(n)]
        for _ in range(r.randrange(4)):
            q, a = r.randint(1, max(1, n // 4)), r.randrange(n)
            e = min(n, a + q * r.randint(3, 7) + r.randrange(3))
            for i in range(a + q, e):
                w[i] = w[i - q]
        out.append(r.choice([" ", "\n", "\t "]).join(w))
    return out


def long_text(n, a, e, q):
    r = random.Random(n)
    w = [f"w{r.randrange(500)}" for _ in range(n)]
    for i in range(a + q, e):
        w[i] = w[i - q]
    return w


def test_runs_and_collapsed_texts_equal_a_plain_search(spark):
    texts = [*AWKWARD, *some_texts()]
    got = {r["doc_id"]: r for r in P.periodic_runs(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        words = words_of(t)
        want = plain_runs(words) if len(words) < 5000 else [(0, len(words), 1)]
        assert [tuple(x) for x in got[i]["runs"]] == want, i
        assert got[i]["n_words"] == len(words) and got[i]["collapsed"] == collapsed(words, want)


@pytest.mark.parametrize("q", [31, 32, 63, 64, 200, 777, 1500])
def test_long_periods_are_found_through_sampled_planes(q):
    for extra in (0, 1, -1):
        w = long_text(7000, 311, 311 + 4 * q + extra, q)
        codes = np.unique(w, return_inverse=True)[1]
        assert P.block_runs(codes, np.array([0, len(w)])) == [plain_runs(w)]


def test_runs_inside_runs_and_at_multiples_of_a_period():
    inner = "a a a a a a b".split() * 9
    w = [*inner, "x", *["c", "d"] * 40, *["c"] * 20]
    codes = np.unique(w, return_inverse=True)[1]
    assert P.block_runs(codes, np.array([0, len(w)])) == [plain_runs(w)]
    assert P.block_runs(codes, np.array([0, len(w)]), least_words=4, least_periods=2) == [plain_runs(w, 4, 2)]


def test_texts_of_a_block_do_not_touch():
    w = "a b a b".split() * 2
    codes = np.unique(w * 3, return_inverse=True)[1]
    assert P.block_runs(codes, np.array([0, 8, 8, 16, 24])) == [[(0, 8, 2)], [], [(0, 8, 2)], [(0, 8, 2)]]


def planted(doc_id, text):
    words, h = words_of(text), zlib.crc32(str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]


def test_digests_of_planted_periods(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r["doc_id"]: r for r in P.run_digests(P.periodic_runs(P.with_planted_periods(docs))).collect()}
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert rows.keys() == texts.keys()
    some = 0
    for i, t in texts.items():
        words = planted(i, t)
        want = plain_runs(words)
        best = min(want, key=lambda x: (-x[1], x[0], x[2])) if want else (None,) * 3
        r, some = rows[i], some + bool(want)
        assert (r["n_runs"], r["start"], r["length"], r["period"]) == (len(want), *best)
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if want else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in want).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(collapsed(words, want).encode()).hexdigest()
    assert some > 10


def test_empty_table_null_ids_and_repeated_rows(spark):
    none = P.run_digests(P.periodic_runs(P.with_planted_periods(documents(spark, []))))
    assert none.count() == 0 and none.columns[:2] == ["doc_id", "n_runs"]
    docs = spark.createDataFrame([(None, "a a a a a a", 1), (3, "b", 2), (3, "b", 2), (None, None, 3)], "doc_id long, text string, runs int")
    got = sorted(P.run_digests(P.periodic_runs(P.with_planted_periods(docs))).select("doc_id", "n_runs", "length").collect(), key=str)
    assert [tuple(r) for r in got] == [(3, 0, None), (3, 0, None), (None, 0, None), (None, 1, 6)]
