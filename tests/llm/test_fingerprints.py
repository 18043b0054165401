"""Fingerprints against whole shingle sets and a plain edit."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyra.llm import fingerprints as P
from papyra.llm.near_dedup import shingle_sets

from .docs import AWKWARD, documents


def some_texts(n=80):
    r = random.Random(3)
    words = [f"w{i}" for i in range(3000)]
    return [" ".join(r.choice(words) for _ in range(r.choice([0, 1, 4, 5, 30, 200, 900]))) for _ in range(n)]


def order(rows):
    """By falling doc_id, rows without one last, then by falling text hash."""
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]), reverse=True)


def edited_text(text, following):
    n = len(text)
    return text[: n - n // 2] + following[: n // 2]


def check(spark, docs, parts):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = P.with_edited(docs).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    rows = order([(r[0], r[1], r[2]) for r in docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", F.xxhash64("text")).collect()])
    want = []
    for k, (doc_id, text, _) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        new = edited_text(text, following)
        a, b, c = P.bottom([text, new, following])
        want.append((str(doc_id), len(text), hashlib.sha256(new.encode()).hexdigest(), P.written_out(a), P.written_out(b), P.likeness(a, b), P.likeness(a, c)))
    assert sorted(want) == sorted((str(r["doc_id"]), r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got)


@pytest.mark.parametrize("parts", [1, 2, 8, 40])
def test_every_row_meets_the_next_one(spark, parts):
    check(spark, documents(spark, [*AWKWARD, *some_texts()]), parts)


def test_few_rows_null_ids_and_ids_that_most_rows_have(spark):
    ddl = "doc_id long, text string, bucket int, mark string, h int, at int"
    check(spark, spark.createDataFrame([(7, "only one row here", 0, "", 1, 2)], ddl), 8)
    rows = [(5, t, 0, "", 1, 2) for t in some_texts(60)] + [(None, t, 0, "", 1, 2) for t in some_texts(40)] + [(i, f"text {i} of five and more words", 0, "", 1, 2) for i in range(20)]
    for parts in (3, 16):
        check(spark, spark.createDataFrame(rows, ddl), parts)
    assert P.with_edited(spark.createDataFrame([], ddl)).count() == 0


def test_a_frequent_id_is_dealt_over_several_buckets(spark):
    docs = spark.createDataFrame([(5, f"text number {i} under one id") for i in range(4000)], "doc_id long, text string")
    sizes = P._dealt(docs).where("mark = 0").groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) > 5 and max(r["count"] for r in sizes) < 1000


def test_estimates_follow_whole_sets(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    base = [r.choice(words) for _ in range(3000)]
    for share in (0.0, 0.25, 0.5, 0.9, 1.0):
        other = [w if i < share * len(base) else r.choice(words) for i, w in enumerate(base)]
        a, b = shingle_sets([" ".join(base), " ".join(other)], 5)
        x, y = P.bottom([" ".join(base), " ".join(other)])
        exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(P.likeness(x, y) - exact) < 0.14  # three standard errors of 128 samples
    assert P.likeness(*P.bottom(["a b c d e f", "a b c d e f"])) == 1.0 and P.likeness(*P.bottom(["", None])) == 1.0


def test_column_estimates_equal_the_plain_ones(spark):
    texts = [*some_texts(30), "one two three four five six", "", None]
    found = P.sketched(documents(spark, texts)).collect()
    plain = {i: s for i, s in enumerate(P.bottom(texts))}
    assert all(list(plain[r["doc_id"]]) == r["sketch"] for r in found)
    pairs = spark.createDataFrame([(a["sketch"], b["sketch"]) for a in found for b in found[::3]], "a array<long>, b array<long>")
    got = pairs.select("a", "b", P.resemblance(F.col("a"), F.col("b")).alias("r"), P.containment(F.col("a"), F.col("b")).alias("c"), P.distinct_shingles(F.col("a")).alias("n")).collect()
    for x in got:
        a, b = np.array(x["a"], "i8"), np.array(x["b"], "i8")
        assert abs(x["r"] - P.likeness(a, b)) < 1e-12 and 0 <= x["c"] <= 1
        if len(a) < P.SIZE:
            assert x["n"] == len(a)
        if 0 < len(a) and len(a) + len(b) < P.SIZE:
            assert abs(x["c"] - len(np.intersect1d(a, b)) / len(a)) < 1e-12


def test_sketches_of_parts_merge_to_that_of_the_whole(spark):
    texts = some_texts(60)
    whole = np.unique(np.concatenate([np.concatenate([s >> np.uint64(1) for s in shingle_sets(texts, 5)])]))
    parts = P.sketched(documents(spark, texts)).withColumn("part", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3))
    got = P.merged(parts.withColumn("all", F.lit(1)), ["all"]).collect()
    assert [r["sketch"] for r in got] == [whole[: P.SIZE].astype("i8").tolist()]
    again = P.merged(P.merged(parts, ["part"]).withColumn("all", F.lit(1)), ["all"]).collect()
    assert again == got
    n = P.distinct_shingles(F.col("sketch"))
    assert abs(P.merged(parts.withColumn("all", F.lit(1)), ["all"]).select(n).first()[0] / len(whole) - 1) < 0.3


def test_written_fingerprints_read_back():
    for s in P.bottom(some_texts(5)):
        assert P.read_back(P.written_out(s)).tolist() == s.tolist()
