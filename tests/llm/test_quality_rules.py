import random
import re
import time

from papyra.llm import quality_rules as q

from .docs import AWKWARD, documents


def brute(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, covered = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for places in seen.values():
        if len(places) > 1:
            for p in places:
                covered.update(range(p, p + 5))
    n = len(words)
    return (n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def test_measures_against_brute_force(spark):
    rng = random.Random(5)
    texts = AWKWARD + ["".join(rng.choice(["a", "b", "c", "dd"]) + rng.choice([" ", " ", "\n", "  ", "\t"]) for _ in range(rng.randrange(80))) for _ in range(200)]
    texts += ["p q r s t u p q r s t", "| a | b |", "same line here\nsame line here\n \nsame line here"]
    got = {r.doc_id: r for r in q.judged(documents(spark, texts)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), repr(t)[:80]
        assert not (r.base_failed and r.kept)


def test_cascade_keeps_the_rows_that_the_verdict_keeps(spark):
    clean = "The quick brown fox jumps over the lazy dog while seven wizards brew strong tea."
    texts = AWKWARD + [clean, clean, clean.upper() + "!!!!!!", " | ".join(clean.split()), "it " * 50]
    docs = documents(spark, texts)
    kept = q.cascade(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in q.judged(docs).collect() if r.kept)
    assert {len(AWKWARD), len(AWKWARD) + 1} <= {r.doc_id for r in kept.collect()}


def test_order_does_not_change_the_verdict(spark):
    docs = documents(spark, AWKWARD)
    rules = q.default_rules()
    a = sorted(r.doc_id for r in q.cascade(docs, rules).collect())
    b = sorted(r.doc_id for r in q.cascade(docs, rules[::-1], sample_rows=1).collect())
    assert a == b


def test_rules_are_ordered_by_rejections_per_cost(spark):
    found = q.order_rules(documents(spark, AWKWARD))
    worth = [share / cost for _, cost, share in found]
    assert worth == sorted(worth, reverse=True)


def test_empty_table(spark):
    empty = documents(spark, [])
    assert q.judged(empty).count() == 0 and q.cascade(empty).count() == 0


def test_plans_name_each_measure_once(spark, sf):
    """A plan in which definitions replace columns grows without bound."""
    began = time.perf_counter()
    docs = spark.read.parquet(sf.replace("0.001", "0.01") + "/documents.parquet")
    for rules in (q.default_rules(), q.default_rules()[::-1]):
        kept = q.cascade(docs, rules)
        plan = kept._jdf.queryExecution().optimizedPlan().toString()
        assert len(plan) < 20_000
        assert 0 < kept.count() < docs.count()
    assert time.perf_counter() - began < 90
