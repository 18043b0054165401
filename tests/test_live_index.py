"""An index kept in steps against one built at once; versions; substrings."""

import random

import pytest
from pyspark.sql import functions as F

from papyra.operators import extract, search
from papyra.operators.live_index import LiveIndex
from papyra.operators.substring import GramIndex
from papyra.sources.versions import Conflict, Versions

def fields():
    return {"title": F.col("title"), "abstract": F.col("abstract")}


def made(spark, rows):
    return spark.createDataFrame([(i, t, a, "x", "y") for i, (t, a) in rows.items()], "paper_id string, title string, abstract string, h string, segment string")


def answers(index, query):
    return sorted((r.id, round(r.score, 9)) for r in search.hits(index, query, {"title": 3.0, "abstract": 1.0}).collect())


def test_steps_equal_a_fresh_build(spark, tmp_path):
    r = random.Random(2)
    text = lambda: " ".join(r.choice("aa bb cc dd ee ff gg".split()) for _ in range(r.randrange(6)))
    live, now = LiveIndex(spark, f"file://{tmp_path}/ix", fields()), {}
    for step in range(4):
        new = {f"p{k}": (text(), text()) for k in r.sample(range(30), 10)}
        same = dict(r.sample(sorted(now.items()), min(5, len(now))))
        gone = r.sample(sorted(now), min(4, len(now)))
        upserts = {**same, **new}
        live.apply(made(spark, upserts), spark.createDataFrame([(g,) for g in [*gone, "never"]], "paper_id string"))
        now = {k: v for k, v in now.items() if k not in gone} | upserts
        if step == 2:
            live.compact()
            assert len(live._manifest()["segments"]) == 1
        fresh = search.build_index(made(spark, now), fields())
        for query in ("aa", "aa bb", "cc OR dd NOT ee"):
            assert answers(live.snapshot(), query) == answers(fresh, query)
    assert live._manifest()["total"] == len(now)


def test_a_change_folds_its_texts_once_and_postings_are_made_as_columns(spark, tmp_path, monkeypatch):
    """Postings of odd words equal a plain count, and files are sorted by term."""
    import collections
    import re

    monkeypatch.setattr(search, "TASK_WORDS", 200)
    r = random.Random(11)
    vocabulary = ["Ärger", "ärger", "naïve", "x1", "王", "don't", "A-b", "ſ", "𝔸b", "\u00a0", "--", "", "é", "the", "of"]
    text = lambda n: r.choice([" ", "  ", "\n", ", "]).join(r.choice(vocabulary) for _ in range(n))
    rows = {f"p{k}": (text(r.randrange(9)), r.choice([None, "", text(r.randrange(40))])) for k in range(80)}
    live = LiveIndex(spark, f"file://{tmp_path}/ix", fields())
    live.apply(spark.createDataFrame([(i, t, a) for i, (t, a) in rows.items()], "paper_id string, title string, abstract string"))
    at = f"{live.path}/{live._manifest()['segments'][0]['name']}"
    words = {r_.i: r_.w for r_ in spark.createDataFrame([(f"{k} {n}", t) for k, v in rows.items() for n, t in zip(("title", "abstract"), v)], "i string, t string").selectExpr("i", "regexp_extract_all(translate(lower(coalesce(t, '')), 'äïé', 'aie'), '([\\\\p{L}\\\\p{N}]+)', 1) as w").collect()}
    want = collections.defaultdict(list)
    for i, ws in words.items():
        for place, w in enumerate(ws):
            want[(w, *i.split())].append(place)
    got = spark.read.parquet(f"{at}/postings")
    assert {(x.term, x.id, x.field): (x.tf, list(x.places)) for x in got.collect()} == {k: (len(v), v) for k, v in want.items()}
    assert {x.id: x["size"] for x in spark.read.parquet(f"{at}/records").collect()} == {k: len(words[f"{k} title"]) + len(words[f"{k} abstract"]) for k in rows}
    for file in {x.f for x in got.selectExpr("_metadata.file_path as f").collect()}:
        terms = [x.term.encode() for x in spark.read.parquet(file).collect()]
        assert terms == sorted(terms)
    plan = search.index_of_words(spark.createDataFrame([("a", "b c")], "id string, t string"), ["t"]).dealt(2)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "regexp" not in plan and "Generate" not in plan


def test_what_is_written_goes_with_the_change(spark, tmp_path):
    live = LiveIndex(spark, f"file://{tmp_path}/ix", fields())
    rows = {f"p{k}": (f"title {k}", "words of it") for k in range(200)}
    assert live.apply(made(spark, rows)) == 1
    assert live.apply(made(spark, rows)) == 1  # nothing changed, no version
    rows["p7"], rows["new"] = ("other title", ""), ("one more", "")
    assert live.apply(made(spark, rows)) == 2
    segment = live._manifest()["segments"][-1]
    assert segment["records"] == 2 and spark.read.parquet(f"{live.path}/{segment['name']}/postings").count() == 4
    assert live.history() == [(1, 1, 1, 200, 200), (2, 1, 2, 2, 201)]


def test_readers_keep_their_version_and_layouts_are_rebuilt(spark, tmp_path):
    live = LiveIndex(spark, f"file://{tmp_path}/ix", fields())
    assert answers(live.snapshot(), "aa") == [] and not live.needs_rebuild()
    live.apply(made(spark, {"a": ("aa", ""), "b": ("bb aa", "")}))
    before = live.snapshot()
    first = answers(before, "aa")
    live.apply(made(spark, {"c": ("aa aa", "")}), spark.createDataFrame([("a",)], "paper_id string"))
    assert answers(before, "aa") == answers(live.snapshot(1), "aa") == first != answers(live.snapshot(), "aa")
    newer = LiveIndex(spark, live.path, fields(), schema=2)
    assert newer.needs_rebuild()
    with pytest.raises(RuntimeError):
        newer.apply(made(spark, {"d": ("aa", "")}))
    assert newer.rebuild(made(spark, {"d": ("aa", ""), "e": ("bb", "")})) == 3 and not newer.needs_rebuild()
    assert answers(live.snapshot(2), "aa") and newer.vacuum() == 3
    assert [r.id for r in search.hits(newer.snapshot(), "aa").collect()] == ["d"] and newer.versions.numbers() == [3]


def test_of_two_writers_one_wins(spark, tmp_path):
    table = Versions(spark, f"file://{tmp_path}/t")
    assert table.latest() == (0, None)
    assert table.commit(1, {"a": "ü"}) == 1
    with pytest.raises(Conflict):
        table.commit(1, {"a": 2})
    assert table.latest() == (1, {"a": "ü"}) and table.numbers() == [1]


def test_substrings_equal_a_scan(spark, tmp_path):
    r = random.Random(4)
    texts = ["".join(r.choice("abc é王") for _ in range(r.randrange(14))) for _ in range(150)] + [None, "", "Jane Smithson"]
    rows = spark.createDataFrame([(i, t, str(i % 3) if i % 7 else None, "g") for i, t in enumerate(texts)], "paper_id int, authors string, year_text string, gram string")
    index = extract.author_index(rows)
    index.write(str(tmp_path / "g"))
    stored = GramIndex.read(spark, str(tmp_path / "g"))
    needles = sorted({t[a : a + n].lower() for t in texts if t for a in range(0, len(t), 3) for n in (1, 2, 3, 4, 6)}) + ["zz", "abcabcabc"]
    for needle in [*r.sample(needles, 12), "zzzz", "", "SMITH"]:
        for ix in (index, stored):
            assert sorted(x.id for x in ix.containing(needle).collect()) == [i for i, t in enumerate(texts) if needle and t and needle.lower() in t.lower()]
    asked = spark.createDataFrame([(n, s) for n in needles for s in ("0", "1", "9")], "needle string, scope string")
    got = {(x.needle, x.scope): x.n for x in stored.count_of(asked).collect()}
    assert got == {(n, s): sum(bool(t) and n in t.lower() and i % 7 > 0 and str(i % 3) == s for i, t in enumerate(texts)) for n in needles for s in ("0", "1", "9")}


def test_delete_vectors_are_bits_and_postings_stay_where_they_are(spark, tmp_path):
    r = random.Random(6)
    live = LiveIndex(spark, f"file://{tmp_path}/ix", fields())
    rows = spark.range(9000).selectExpr("concat('p', id) as paper_id", "concat('aa w', id % 7) as title", "'bb' as abstract").repartition(2)
    live.apply(rows)
    now = {f"p{k}" for k in range(9000)}
    for _ in range(2):
        gone = r.sample(sorted(now), 3000)
        live.apply(removed=spark.createDataFrame([(g,) for g in gone], "paper_id string"))
        now -= set(gone)
    assert spark.read.parquet(f"{live.path}/{live._manifest()['deletes'][0]}").count() < 300
    plan = live.snapshot().postings._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
    assert {x.id for x in search.hits(live.snapshot(), "aa").collect()} == now
    live.compact()
    m = live._manifest()
    assert (len(m["segments"]), m["deletes"], m["total"]) == (1, [], 3000)
    assert {x.id for x in search.hits(live.snapshot(), "aa").collect()} == now
    live.apply(rows.where("paper_id = 'p1'").withColumn("title", F.lit("zz")), rows.limit(0))
    assert {x.id for x in search.hits(live.snapshot(), "zz").collect()} == {"p1"}
    assert {x.id for x in search.hits(live.snapshot(), "aa").collect()} == now - {"p1"}
