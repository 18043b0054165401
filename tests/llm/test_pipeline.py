import random

import pytest

import corpus_pipeline as cp
from papyra.llm import decontaminate, quality_rules
from papyra.llm.common import materialize

from .docs import AWKWARD
from .test_near_dedup import brute as near_brute
from .test_quality_rules import brute as rules_brute
from .test_suffix_dedup import brute as suffix_brute

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def tables(spark, folder):
    rng = random.Random(9)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(rng.randrange(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."
    item = text(30)
    shared = text(100)
    long = [text(rng.randrange(60, 200)) for _ in range(12)]
    texts = AWKWARD + long + [long[0], long[1] + " tail", text(40) + " " + item + " " + text(30), text(50) + " " + shared + " " + text(50), text(60) + " " + shared + " " + text(70)]
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, DDL).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(0, item), (1, text(20)), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return texts, item, shared


def test_stages_against_brute_force(spark, tmp_path):
    folder = f"file://{tmp_path}"
    texts, item, shared = tables(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    now = dict(enumerate(texts))
    seen = {}
    for name, stage in cp.STAGES:
        docs = materialize(stage(spark, docs, folder), name)
        rows = docs.collect()
        seen[name] = {r.doc_id: r for r in rows}
        assert len(seen[name]) == len(rows)
        if name == cp.STAGES[-1][0]:
            break
        assert docs.columns == columns
        ids = sorted(now)
        if name == "quality_rules":
            kept = set(seen[name])
            assert all(not rules_brute(now[i])[5] for i in kept)
            assert {len(AWKWARD) + i for i in range(12)} <= kept
        elif name == "minhash_near_dedup":
            parts = near_brute([now[i] for i in ids], 5)
            assert set(seen[name]) == {i for k, i in enumerate(ids) if parts[k][1] == k or parts[k][0] == 0}
        elif name == "suffix_array_dedup":
            assert set(seen[name]) == set(ids)
            want = dict(zip(ids, suffix_brute([now[i] for i in ids])))
            for i in ids:
                assert len(seen[name][i].text.encode()) == want[i][0] - want[i][1]
                assert seen[name][i].n_chars == len(seen[name][i].text)
            assert not any(shared in r.text for r in rows)
        else:
            assert set(seen[name]) == {i for i in ids if item not in now[i]}
        now = {r.doc_id: r.text for r in rows}
    assert set(seen["bpe_encode_decode"]) == set(seen["benchmark_decontamination"])
    again = {r.doc_id: r for r in cp.run(spark, folder).collect()}
    assert {i: r.ids_sha256 for i, r in again.items()} == {i: r.ids_sha256 for i, r in seen["bpe_encode_decode"].items()}


def test_items_with_changed_case_and_marks_are_found():
    rng = random.Random(1)
    words = ["".join(rng.choice("bcdfgaeiou") for _ in range(6)) for _ in range(500)]
    items = [(i, " ".join(rng.sample(words, 25)) + ". " + " ".join(rng.sample(words, 6))) for i in range(50)]
    index = decontaminate.ItemIndex(items)
    text = " ".join(rng.choices(words, k=300)) + "\n" + items[7][1].upper().replace(" ", ", ") + "\n" + " ".join(rng.choices(words, k=200))
    assert [h[0] for h in index.hits(text)] == [7]
    assert index.hits(" ".join(rng.choices(words, k=3000))) == []
    assert index.hits(" ".join(items[3][1].split()[:8])) == []  # a part of the question only
    assert index.hits(None) == index.hits("") == [] and decontaminate.ItemIndex([]).hits("x") == []


def test_block_max_wand_finds_what_a_full_scan_finds():
    rng = random.Random(6)
    words = [f"w{i}" for i in range(120)]
    index = decontaminate.ItemIndex([(i, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for i in range(150)])
    for _ in range(200):
        terms = sorted(rng.sample(range(len(index.term)), rng.randrange(1, 60)))
        limit = rng.choice([0.05, 0.2, 0.5])
        score = {}
        for t in terms:
            for i, x in zip(*index.postings[t]):
                score[i] = score.get(i, 0) + x
        assert {i for i, x in score.items() if x >= limit} == {i for i, _ in index.search(terms, limit)}


@pytest.mark.parametrize("shard", [20_000, 1])
def test_contamination_rows(spark, tmp_path, shard):
    texts, item, _ = tables(spark, f"file://{tmp_path}")
    docs, items = (spark.read.parquet(f"file://{tmp_path}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = decontaminate.contamination(docs, items, shard).collect()
    assert [(r.doc_id, r.item_id) for r in rows] == [(i, 0) for i, t in enumerate(texts) if t and item in t]
    assert decontaminate.contamination(docs, items.limit(0)).count() == 0


def test_rows_do_not_depend_on_the_shards_and_equal_a_full_scan(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([4, 12, 30]))) + ". " + " ".join(rng.choices(words, k=3))) for i in range(40)] + [(40, ""), (None, "w1 w2"), (41, None)]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 10, 200]))) + " " + " ".join(t for _, t in rng.sample(items[:40], rng.randrange(3))) + " " + " ".join(rng.choices(words, k=60)) for _ in range(60)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, score string")
    bench = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = {n: sorted(tuple(r) for r in decontaminate.contamination(docs, bench, n).collect()) for n in (20_000, 15, 5)}
    assert got[20_000] == got[15] == got[5]
    index, want = decontaminate.ItemIndex([x for x in items if x[0] is not None and x[1] is not None]), {}
    for d, t in enumerate(texts):
        split, size = decontaminate.words_of(t), index.longest
        for a in range(0, max(1, len(split)), size):  # a window of two blocks at each block's start, and the first block alone
            for part in {(a, a + 2 * size)} | ({(0, size)} if a == 0 else set()):
                window = split[part[0] : part[1]]
                terms = {index.term[w] for w in window if w in index.term}
                score = {}
                for k in terms:
                    for i, x in zip(*index.postings[k]):
                        score[i] = score.get(i, 0) + x
                for i, x in score.items():
                    q, answer = index.sets[i]
                    triples, single = set(zip(window, window[1:], window[2:])), set(window)
                    in_q = (sum(all(w in single for w in y) for y in q) if len(next(iter(q), ())) < 3 else len(q & triples)) / len(q) if q else 1.0
                    if x >= 0.5 and in_q >= 0.6 and len(answer & single) / len(answer) >= 0.6:
                        want[d, index.ids[i]] = max(want.get((d, index.ids[i]), 0), x)
    assert {(r[0], r[1]): round(r[2], 9) for r in got[5]} == {k: round(x, 9) for k, x in want.items()} and len(want) > 30
    kept = {r.doc_id for r in decontaminate.decontaminated(docs, bench, 5).collect()}
    assert kept == set(range(len(texts) + 2)) - {d for d, _ in want}


def test_rule_cascade_is_the_first_stage(spark, tmp_path):
    tables(spark, f"file://{tmp_path}")
    docs = spark.read.parquet(f"file://{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in cp.rules(spark, docs, "").collect()) == sorted(r.doc_id for r in quality_rules.judged(docs).collect() if r.kept)
