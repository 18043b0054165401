"""Held-out accuracy, and the defined results of awkward rows."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from papyra.llm import language_model as lm
from papyra.llm import quality_model as qm
from papyra.llm import toxicity as tx

from .docs import AWKWARD, documents


def _auc(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(order))
    rank[order] = np.arange(len(order))
    n1 = int(label.sum())
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / (n1 * (len(label) - n1))


@pytest.mark.parametrize("column,least", [("quality", 0.97), ("toxic", 0.8)])
def test_held_out_accuracy(spark, column, least):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    if column == "quality":
        rows = qm.score_quality(docs, qm.fit_quality(docs, labels)).collect()
    else:
        rows = tx.score_documents(docs, tx.fit_documents(docs, labels)).collect()
    assert len(rows) == docs.count()
    of = {r.doc_id: r[column] for r in labels.collect()}
    held = [r for r in rows if r.doc_id in of and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and all(0 <= r.score <= 1 for r in rows)
    assert _auc(np.array([r.score for r in held]), np.array([of[r.doc_id] for r in held])) > least


def test_scores_of_awkward_texts(spark):
    docs = documents(spark, AWKWARD)
    labels = spark.createDataFrame([(i, i % 2, int(i % 5 == 0)) for i in range(len(AWKWARD))] + [(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for rows in (qm.score_quality(docs, qm.fit_quality(docs, labels)).collect(), tx.score_documents(docs, tx.fit_documents(docs, labels)).collect()):
        assert len(rows) == len(AWKWARD) and all(0 <= r.score <= 1 and not math.isnan(r.score) for r in rows)
    none = labels.limit(0)
    assert qm.score_quality(docs, qm.fit_quality(docs, none)).count() == len(AWKWARD)
    assert tx.score_documents(docs, tx.fit_documents(docs, none)).count() == len(AWKWARD)
    empty = documents(spark, [])
    assert qm.score_quality(empty, qm.fit_quality(empty, none)).count() == tx.score_documents(empty, tx.fit_documents(empty, none)).count() == 0


def test_labels_of_the_held_out_fold_do_not_count(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    from pyspark.sql import functions as F

    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = qm.fit_quality(docs, labels), qm.fit_quality(docs, flipped)
    assert np.allclose(a.means, b.means) and a.shift == pytest.approx(b.shift)


def test_kernel_bears_gaps_and_inserted_characters():
    rng = random.Random(8)
    syllables = ["ba", "ke", "lu", "mo", "ni", "ra", "so", "ti", "vu", "ze"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 5)))
    bad = ["grumbach", "wuxstipf", "dratzig"]
    rows = []
    for i in range(500):
        words = [word() for _ in range(30)]
        if i % 5 == 0:
            words[7], words[19] = rng.choice(bad), rng.choice(bad)
        rows.append((" ".join(words) + ".", int(i % 5 == 0)))
    model = tx.fit_toxic(rows)
    memo = tx.GenerationCache(model.word_values, 1000)
    score = lambda t: float(model.score(tx.document_value(t, memo)))
    clean = max(score(" ".join(word() for _ in range(30))) for _ in range(50))
    for t in ("grumbach", "g-r-u-m-b-a-c-h", "g r u m b a c h", "grumqbach", "drat_zig wuxstipf"):
        assert score(f"kelu {t} moni") > clean, t


def test_word_value_is_the_kernel_expansion():
    """Folded weights give what the landmark kernel itself gives."""
    words = ["kernel", "k.ernel", "nothing", "x" * 60, "ab", ""]
    rng = np.random.default_rng(2)
    weights = rng.normal(size=tx.BUCKETS).astype("f4")

    def plain(w):
        best = -np.inf
        pieces = [w] if len(w) <= tx.PIECE else [w[a : a + tx.PIECE] for a in range(0, len(w) - tx.SPAN, tx.PIECE - tx.SPAN)]
        for p in pieces:
            total = 0.0
            for a, b, x in tx.PATTERNS:
                for i in range(len(p) - b):
                    h = (ord(p[i]) * 0x9E3779B1 + ord(p[i + a]) * 0x85EBCA77 + ord(p[i + b]) * 0xC2B2AE3D) & 0xFFFFFFFF
                    total += x * float(weights[(h ^ (h >> 15)) & (tx.BUCKETS - 1)])
            best = max(best, total)
        return best

    assert np.allclose(tx.fold(words, weights), [plain(w) for w in words])


def test_base_scores_and_counts(spark):
    texts = AWKWARD + ["The cat sat", "the CAT sat again", "a b a b a b"] * 4
    docs = documents(spark, texts)
    rows = {r.doc_id: r for r in lm.score(docs, lm.fit(docs, sent_words=5)).collect()}
    split = lambda t: [*re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower()), b" end"]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, t in enumerate(texts) if not held(i) for w in split(t))
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(texts):
        words, r = split(t), rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words), rel=1e-9)
        assert r.score < 0


def test_words_of_a_context_have_probability_one_together(spark):
    """Over all known words, one unknown word in each shared slot and the end."""
    rng = random.Random(4)
    docs = documents(spark, [" ".join(rng.choices(["a", "b", "cc", "dog", "eel", "fox"], [30, 20, 9, 4, 2, 1], k=40)) for _ in range(60)])
    model = lm.fit(docs, sent_words=4)
    counts = {r.word: r.n for r in model.counts.collect() if r.word != lm.END}
    table = lm.Words(model.top)
    words = sorted(counts)
    rank, cell, previous, skipped = table.of(lm.pa.array([w.decode() for w in words]))
    shared = cell % lm.SLOTS >= lm.SLOTS - lm.SHARED_SLOTS
    assert {w for w, s in zip(words, shared) if not s} == set(model.top.column("word").to_pylist())
    for prev, skip in [(lm.NO_PREVIOUS, lm.NO_SKIPPED), (previous[0], skipped[1]), (previous[3], skipped[0])]:
        p = 0.0
        for w, c, s in zip(words, cell, shared):
            one = model.log_parts(np.array([c]), np.array([prev]), np.array([skip]))[0] - model.log_cells[c]
            p += 10 ** (one + (math.log10(counts[w] + lm.ADDED) if s else 0.0))
        every = [k * lm.SLOTS + j for k in range(lm.CLASSES) for j in range(lm.SLOTS)]
        taken = {c for c, s in zip(cell, shared) if not s}
        for c in every:
            if c % lm.SLOTS >= lm.SLOTS - lm.SHARED_SLOTS:
                p += 10 ** (model.log_parts(np.array([c]), np.array([prev]), np.array([skip]))[0] - model.log_cells[c] + math.log10(lm.ADDED))
            elif c not in taken:  # own slots that no word has
                p += 10 ** model.log_parts(np.array([c]), np.array([prev]), np.array([skip]))[0]
        p += 10 ** model.log_parts(np.array([lm.END_CELL]), np.array([prev]), np.array([skip]))[0]
        assert p == pytest.approx(1, abs=1e-5)


def test_scores_are_sums_over_tokens(spark):
    """Scores against the model's parts, taken word by word."""
    texts = AWKWARD + ["the cat sat on the mat", "the cat ran", "a dog sat"] * 5
    model = lm.fit(documents(spark, texts), sent_words=6)
    counts = {r.word: r.n for r in model.counts.collect()}
    table = lm.Words(model.top)
    rows = {r.doc_id: r for r in lm.score(documents(spark, texts), model).collect()}
    for i, t in enumerate(texts):
        words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        if len(words) > 500:
            continue
        _, cell, previous, skipped = table.of(lm.pa.array([w.decode() for w in words], lm.pa.string()))
        total = 0.0
        for k, c in enumerate([*cell, lm.END_CELL]):
            prev = previous[k - 1] if k > 0 else lm.NO_PREVIOUS
            skip = skipped[k - 2] if k > 1 else lm.NO_SKIPPED
            total += model.log_parts(np.array([c]), np.array([prev]), np.array([skip]))[0] - model.log_cells[c]
            if c < lm.END_CELL and c % lm.SLOTS >= lm.SLOTS - lm.SHARED_SLOTS:
                total += math.log10(counts.get(words[k], 0) + lm.ADDED)
        assert rows[i].score == pytest.approx(total, rel=1e-6)


def test_slot_weights_follow_counts_where_there_are_many():
    bias = np.log(np.full((2, lm.SLOTS), 1 / lm.SLOTS))
    n = np.zeros((2, lm.SLOTS))
    n[0, 3], n[0, 5] = 6000, 2000
    p = np.exp(lm.slot_weights(n, bias))
    assert p.sum(1) == pytest.approx(1) and p[0, 3] == pytest.approx(0.75, abs=0.02) and p[1, 3] == pytest.approx(1 / lm.SLOTS)


def test_model_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in lm.score(docs, lm.fit(docs)).collect() if r.held_out]
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_empty_table_and_no_training_rows(spark):
    empty = documents(spark, [])
    assert lm.score(empty, lm.fit(empty)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 10 == 0)
    docs = spark.createDataFrame([(held, "some words")], "doc_id long, text string")
    (r,) = lm.score(docs, lm.fit(docs)).collect()
    assert (r.n_tokens, r.n_known, r.train_tokens) == (3, 0, 0) and math.isfinite(r.base_score)


def test_kernel_alone_ranks_gapped_insults_above_clean_texts(spark, monkeypatch):
    """Without the patterns that undo marks and drawn-apart letters."""
    monkeypatch.setattr(tx, "words_of", lambda text: [w.strip(".,;:!?\"()") for w in text.lower().split()])
    rng = random.Random(8)
    syllables = ["ba", "ke", "lu", "mo", "ni", "ra", "so", "ti", "vu", "ze"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 5)))
    bad = ["grumbach", "wuxstipf", "dratzig"]
    rows = []
    for i in range(500):
        words = [word() for _ in range(30)]
        if i % 5 == 0:
            words[7], words[19] = rng.choice(bad), rng.choice(bad)
        rows.append((" ".join(words) + ".", int(i % 5 == 0)))
    model = tx.fit_toxic(rows)
    memo = tx.GenerationCache(model.word_values, 1000)
    score = lambda t: float(model.score(tx.document_value(t, memo)))
    clean = max(score(" ".join(word() for _ in range(30))) for _ in range(100))
    gapped = {t: score(f"kelu {t} moni") for t in ("g-r-u-m-b-a-c-h", "g.r.u.m.b.a.c.h", "grumqbach", "grqumbqach", "dr*tzig", "wuxst1pf", "g--rum--bach")}
    assert all(s > clean for s in gapped.values())
    assert gapped["grumqbach"] > 0.5 and gapped["grqumbqach"] > 0.5


def test_quadratic_scores_against_direct_densities():
    """Log-density differences from the covariances themselves, no factors."""
    rng = np.random.default_rng(5)
    k = len(qm.NAMES)
    x = np.vstack([rng.normal(0, 1, (80, k)), rng.normal(0.7, 1.6, (60, k))])
    y = np.r_[np.zeros(80, int), np.ones(60, int)]
    model = qm.fit(x, y)
    pooled = np.cov(x.T, bias=True) + 1e-3 * np.eye(k)
    direct = []
    for c, n in ((0, 80), (1, 60)):
        part = x[y == c]
        cov = n / (n + k) * np.cov(part.T, bias=True) + k / (n + k) * pooled
        cov = (1 - qm.POOLED) * cov + qm.POOLED * pooled
        cov = (1 - qm.DIAGONAL) * cov + qm.DIAGONAL * np.diag(np.diag(cov)) + 1e-6 * np.eye(k)
        away = x - part.mean(0)
        direct.append(math.log((n + 1) / 142) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * np.einsum("ij,jk,ik->i", away, np.linalg.inv(cov), away))
    assert np.allclose(model.difference(x), direct[1] - direct[0])


def test_training_texts_are_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(tx, "TRAINING_BYTES", 400)
    seen = []
    monkeypatch.setattr(tx, "fit_toxic", lambda rows: seen.extend(rows) or tx.ToxicModel(np.zeros(tx.BUCKETS, "f4"), -1.0, 1.0, 0.0))
    docs = documents(spark, ["bad word " * 10] * 40)
    labels = spark.createDataFrame([(i, 0, i % 2) for i in range(40)], "doc_id long, quality int, toxic int")
    tx.fit_documents(docs, labels)
    assert 0 < sum(len(t) for t, _ in seen) <= 400
