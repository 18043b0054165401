import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import near_dedup as nd
from papyra.llm.components import connected

from .docs import AWKWARD, documents


def brute(texts, k, percent=80):
    sets = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets.append({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        c = Counter(j for x in s for j in where[x])
        for j, n in c.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                a, b = sorted((root(i), root(j)))
                up[b] = a
        for x in s:
            where[x].append(i)
    return [(len(s), root(i)) for i, s in enumerate(sets)]


def corpus():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(400)]
    out = list(AWKWARD)
    for _ in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([3, 12, 40, 150]))]
        for _ in range(rng.choice([1, 2, 6])):
            copy = list(base)
            for _ in range(rng.randrange(1 + len(copy) // 12)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            out.append(" ".join(copy))
    base = [rng.choice(words) for _ in range(80)]
    for _ in range(60):  # a chain of copies of copies
        base[rng.randrange(80)] = rng.choice(words)
        out.append(" ".join(base).upper())
    return out


@pytest.mark.parametrize("k,limit", [(2, 1500), (2, 4), (5, 1500)])
def test_classes_match_brute_force(spark, k, limit):
    texts = corpus()
    want = brute(texts, k)
    got = {r.doc_id: r for r in nd.classes_of(documents(spark, texts), k, group_limit=limit).collect()}
    assert len(got) == len(texts)
    for i, (n, part) in enumerate(want):
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, part, i == part), texts[i]


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(1)
    for n in (3, 40, 2000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        b = np.concatenate([a[: n * 3 // 4], rng.integers(0, 2**63, n - n * 3 // 4).astype(np.uint64)])
        s = nd.sketches([np.unique(a), np.unique(b)])
        assert (s != np.uint64(0xFFFFFFFFFFFFFFFF)).all()
        want = len(set(a.tolist()) & set(b.tolist())) / len(set(a.tolist()) | set(b.tolist()))
        assert abs((s[0] == s[1]).mean() - want) < 0.12


def test_sketch_does_not_depend_on_the_batch():
    sets = [np.unique(np.arange(n, dtype=np.uint64) * np.uint64(977)) for n in (1, 2, 9, 700)]
    assert (nd.sketches(sets) == np.concatenate([nd.sketches([s]) for s in sets])).all()


def test_deduplicated_keeps_one_of_each_class_and_all_columns(spark):
    texts = ["a b c d e f g h i j"] * 4 + ["other words in here for sure now", None, None, ""]
    docs = documents(spark, texts)
    kept = nd.deduplicated(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [0, 4, 5, 6, 7]
    twice = docs.union(docs)
    assert sorted(r.doc_id for r in nd.deduplicated(twice).collect()) == [0, 4, 5, 5, 6, 6, 7, 7]


def test_empty_table(spark):
    assert nd.classes_of(documents(spark, [])).count() == 0


def test_large_group_of_two_covered_clusters_that_only_fringe_texts_join(spark):
    """Pivots lie in both clusters and cover all texts, none links with both."""
    by_hash = [r.row for r in spark.range(42).select(F.col("id").alias("row")).orderBy(F.xxhash64("row"), "row").collect()]
    starts = [0, 60] * 20 + [20, 40]  # the pivots, those of the smallest hashes, alternate; the fringe comes last
    rows = [(0, row, len(by_hash), np.arange(t, t + 200, dtype=np.uint64).tobytes()) for row, t in zip(by_hash, starts)]
    sets = spark.createDataFrame(rows, "grp long, row long, members long, s binary")
    assert {(r.node, r.root) for r in connected(nd._large_links(sets, 80, 8)).collect()} == {(row, 0) for row in by_hash}


def test_null_ids_neither_stand_for_a_class_nor_lose_its_links(spark):
    base = [f"w{j}" for j in range(120)]
    copy, near = " ".join(base), " ".join([*base[:-2], "x", "y"])
    rows = [(None, copy), (7, copy), (3, near), (None, "no other has these words"), (None, "no other has these words"), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = [(r.doc_id, r.n_shingles > 0, r.component_id, r.kept) for r in nd.classes_of(docs).collect()]
    want = [(None, True, 3, False), (7, True, 3, False), (3, True, 3, True), (None, True, None, True), (None, True, None, False), (None, False, None, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    kept = [(r.doc_id, r.text) for r in nd.deduplicated(docs).collect()]
    assert sorted(kept, key=str) == sorted([(3, near), (None, "no other has these words"), (None, "")], key=str)
