"""Title joins against all pairs, routing against a loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from papyra.functions.text import dice, title_words
from papyra.operators import curate, metadata
from papyra.operators import similarity as S


def words(title):
    return set(re.sub(r"[^\w\s]", "", (title or "").lower()).split())


def share(a, b):
    x, y = words(a), words(b)
    return 2 * len(x & y) / (len(x) + len(y)) if x and y else 0.0


def titles(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "of", "in"] * 12
    out = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 12))) for _ in range(n)]
    out += [re.sub(r"\w+$", f"x{i}", out[i]) for i in range(0, n, 4)] + [f"on the flow of order {i} in pipes" for i in range(30)]
    return [*out, *out[:10], None, "", "...", "Don't panic", "dont panic!", "deep nets", "Deep-Nets"]


def test_marks_are_dropped_not_split_at(spark):
    row = spark.range(1).select(dice(F.lit("Don't panic"), F.lit("dont panic")).alias("a"), title_words(F.lit("A-b c.d, _e")).alias("b"), dice(F.lit(None).cast("string"), F.lit("x")).alias("c")).first()
    assert (row["a"], row["b"], row["c"]) == (1.0, ["ab", "cd", "_e"], 0.0)


@pytest.mark.parametrize("least", [0.5, 0.65, 0.85, 1.0])
def test_all_pairs(spark, least):
    left, right = titles(1), titles(2)
    a = spark.createDataFrame([(i, t, 0) for i, t in enumerate(left)], "paper_id int, title string, n int")
    b = spark.createDataFrame([(i, t, "x") for i, t in enumerate(right)], "catalogue_id int, title string, ws string")
    got = {(r[0], r[1]): r[2] for r in S.similar_pairs(a, b, least).collect()}
    assert got == {(i, j): share(x, y) for i, x in enumerate(left) for j, y in enumerate(right) if share(x, y) >= least and share(x, y) > 0}


def test_classes_and_their_pairs_say_what_all_pairs_say(spark):
    """Copies are members of a class; their pairs follow and are not written."""
    made = [f"{k:03d}" for k in range(len(titles(1)) + 500)]
    rows = list(zip(made, titles(1) + ["in deep nets"] * 250 + ["Nets, deep in"] * 250))
    got = S.similar_classes(spark.createDataFrame(rows, "paper_id string, title string"), 0.65).collect()
    of = {r.paper_id: r.catalogue_id for r in got if r.kind == "member"}
    alike = {(r.paper_id, r.catalogue_id): r.similarity for r in got if r.kind == "pair"}
    assert all(of[a] == a and of[b] == b and a < b for a, b in alike) and len(got) < 2 * len(rows)
    for i, (a, x) in enumerate(rows):
        assert (a in of) == (share(x, x) > 0)
        for b, y in rows[i:]:
            if share(x, y) >= 0.65:
                assert share(x, y) == (1.0 if of[a] == of[b] else alike[min(of[a], of[b]), max(of[a], of[b])])
            else:
                assert not share(x, x) or not share(y, y) or (of[a] != of[b] and (min(of[a], of[b]), max(of[a], of[b])) not in alike)


def test_all_pairs_within_a_table_of_copies(spark, monkeypatch):
    """The query writes every pair, those of copies too, from blocks of few ids."""
    monkeypatch.setattr(S, "BLOCK_IDS", 7)
    monkeypatch.setattr(S, "TASK_PAIRS", 500)
    texts = titles(5, 60) + ["in deep nets"] * 60 + ["Nets, deep in"] * 30 + ["in deep nets so"] * 20
    made = [f"p{k}" for k in range(len(texts))]  # p10 is before p9
    got = S.pairs_within(spark.createDataFrame(list(zip(made, texts)), "paper_id string, title string"), 0.65, 6).collect()
    want = {(min(a, b), max(a, b)): round(share(x, y), 6) for i, (a, x) in enumerate(zip(made, texts)) for b, y in list(zip(made, texts))[i:] if share(x, y) >= 0.65}
    assert {(r.paper_id, r.catalogue_id): r.similarity for r in got} == want and len(got) == len(want)


@pytest.mark.parametrize("hot", [0, 5, 10_000])
def test_best_matches_with_and_without_hot_words(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT_WORD", hot)
    r = random.Random(hot)
    made = lambda seed: [(i, t, r.choice([None, 2000, 2001, 2010]), r.choice(["", None, "Lee", "lee ", "Roe"])) for i, t in enumerate(titles(seed))]
    local, cat = made(1), made(2)
    name = lambda x: (x or "").strip().lower()
    want = {}
    for i, t, y, n in local:
        for j, u, z, m in cat:
            barred = name(n) and name(m) and name(n) != name(m) and y and z and abs(y - z) > 2
            if share(t, u) >= 0.65 and not barred:
                want[i] = min(want.get(i, (0, 0)), (-share(t, u), j))
    kinds = "int, title string, year int, last_name string"
    got = S.best_matches(spark.createDataFrame(local, "paper_id " + kinds), spark.createDataFrame(cat, "catalogue_id " + kinds), 0.65)
    assert {r["paper_id"]: (-r["similarity"], r["catalogue_id"]) for r in got.collect()} == want


def test_titles_alike_but_for_one_word_cost_no_pair_each(spark, monkeypatch):
    """3,000 against 3,000 titles of one pattern: all pairs are alike, the best
    ones are found from a few candidates."""
    seen, met = [], S._met
    monkeypatch.setattr(S, "_met", lambda *a: seen.append(met(*a)) or seen[-1])
    local = spark.range(3000).select(F.col("id").cast("string").alias("paper_id"), F.concat(F.lit("on the flow of order k"), "id", F.lit(" in pipes and channels with heat")).alias("title"), F.lit(2000).alias("year"), F.lit("").alias("last_name"))
    cat = spark.range(3000).where("id % 3 <> 0").select(F.lpad(F.col("id").cast("string"), 5, "0").alias("catalogue_id"), F.concat(F.lit("on the flow of order k"), "id", F.lit(" in pipes and channels with heat")).alias("title"), F.lit(2001).alias("year"), F.lit("x").alias("last_name"))
    got = {r["paper_id"]: (r["catalogue_id"], r["similarity"]) for r in S.best_matches(local, cat, 0.65).collect()}
    assert got == {str(i): (f"{i:05d}", 1.0) if i % 3 else ("00001", 11 * 2 / 24) for i in range(3000)}
    assert seen[0].count() < 5000


def test_titles_of_common_words_leave_the_join_only_if_they_are_alike(spark, monkeypatch):
    """Titles of 14 out of 70 words, all of them frequent, share prefix words with
    most others; their bit maps tell them apart before a candidate is written."""
    seen, met = [], S._met
    monkeypatch.setattr(S, "_met", lambda pairs, *a: seen.append(pairs.count()) or met(pairs, *a))
    r = random.Random(9)
    made = [" ".join(f"w{w}" for w in r.sample(range(70), 14)) for _ in range(500)]
    made += [t.replace(t.split()[3], "other") for t in made[::5]]
    rows = spark.createDataFrame([(i, i, t, None, "") for i, t in enumerate(made)], "paper_id int, catalogue_id int, title string, year int, last_name string")
    want = {(i, j) for i, x in enumerate(made) for j, y in enumerate(made) if share(x, y) >= 0.85}
    assert {tuple(x)[:2] for x in S.similar_pairs(rows.select("paper_id", "title"), rows.select("catalogue_id", "title")).collect()} == want
    monkeypatch.setattr(S, "HOT_WORD", 5)
    S.best_matches(rows.drop("catalogue_id"), rows.drop("paper_id"), 0.65)
    alike = sum(share(x, y) >= 0.65 for x in made for y in made)
    assert seen[0] < 1.5 * len(want) and seen[1] < 4 * alike, (seen, len(want), alike)


def test_empty_sides(spark):
    none = spark.createDataFrame([], "paper_id int, catalogue_id int, title string, year int, last_name string, doi string, arxiv_id string")
    one = spark.createDataFrame([(1, 1, "a title", 2000, "", "", "")], none.schema)
    assert S.best_matches(none, one, 0.65).count() == S.best_matches(one, none, 0.65).count() == S.similar_pairs(none, one).count() == 0
    assert [tuple(r) for r in metadata.looked_up(one, none).collect()] == [(1, "local_only", None, None)]


# --- routing ------------------------------------------------------------------

DDL = "stem string, scope string, doi string, arxiv_id string, pub_number string, kind string, key string, o int"


def looped(rows, known):
    """The rows one by one: what is taken in gives its keys, the last giver counts."""
    held = {}
    for i, d, a, p in sorted(known):
        for key in (("d", d), ("a", a), ("p", p)):
            if key[1]:
                held[key] = i
    out = {}
    for stem, scope, d, a, p, kind in sorted(rows, key=lambda r: (curate.SCOPES.index(r[1]), r[0])):
        dup = None
        ask = lambda k, v: (k, held[k[0], v]) if v and (k[0], v) in held else None
        if scope == "patent":
            dup = ask("publication_number", p)
            status = ("duplicate", *dup) if dup else ("ok", "", None) if p else ("review", "no_pub_num", None)
        elif scope == "thesis":
            status = ("ok", "", None)
        elif found := ask("arxiv_id", a):
            status = ("duplicate", *found)
        elif d:
            status = ("duplicate", *found) if (found := ask("doi", d)) else ("ok", "", None)
        elif found := ask("publication_number", p):
            status = ("duplicate", *found)
        else:
            status = ("ok", "", None) if p or a or kind in ("thesis", "book", "patent") or scope == "document" else ("review", "no_doi", None)
        out[stem] = status
        if status[0] == "ok":
            held |= {(k, v): stem for k, v in (("d", d), ("a", a), ("p", p)) if v}
    return out


@pytest.mark.parametrize("seed, looped_rows", [(0, 0), (1, 40), (2, 20_000)])
def test_routing_equals_a_loop_on_random_chains(spark, monkeypatch, seed, looped_rows):
    monkeypatch.setattr(curate, "LOOP_ROWS", looped_rows)
    r = random.Random(seed)
    pick = lambda k, n, none: r.choice([None, ""]) if r.random() < none else f"{k}{r.randrange(n)}"
    rows = [(f"s{i:04d}", r.choice(["regular"] * 5 + curate.SCOPES), pick("10.1/d", 60, 0.3), pick("2001.", 50, 0.5), pick("US", 30, 0.6), r.choice(["", None, "book"])) for i in range(300)]
    known = [(f"k{i}", pick("10.1/d", 60, 0.5), pick("2001.", 50, 0.5), pick("US", 30, 0.5)) for i in range(12)]
    got = curate.route(spark.createDataFrame([(*x, "k", 1) for x in rows], DDL), spark.createDataFrame(known, "id string, doi string, arxiv_id string, pub_number string"))
    assert {x["stem"]: (x["status"], x["issue"], x["duplicate_of"]) for x in got.collect()} == looped(rows, known)


def test_only_rows_taken_in_give_their_keys(spark):
    known = spark.createDataFrame([("k", "", "2001.00001", "")], "id string, doi string, arxiv_id string, pub_number string")
    rows = [("a", "regular", "10.1/x", "2001.00001v2", "", ""), ("b", "regular", "10.1/X ", "", "", ""), ("c", "regular", "10.1/x", "", "", ""), ("d", "regular", "n/a", "", "", "")]
    got = {r["stem"]: tuple(r)[2:] for r in curate.route(spark.createDataFrame([(*x, "", 0) for x in rows], DDL), known).collect()}
    assert got == {"a": ("duplicate", "arxiv_id", "k"), "b": ("ok", "", None), "c": ("duplicate", "doi", "b"), "d": ("review", "no_doi", None)}


@pytest.mark.parametrize("looped_rows", [0, 20_000])
def test_a_key_that_most_rows_have(spark, monkeypatch, looped_rows):
    monkeypatch.setattr(curate, "LOOP_ROWS", looped_rows)
    rows = spark.range(4000).select(F.format_string("s%05d", "id").alias("stem"), F.lit("regular").alias("scope"), F.lit("10.1/hot").alias("doi"), F.lit("").alias("arxiv_id"), F.lit(None).cast("string").alias("pub_number"), F.lit("").alias("kind"))
    known = spark.createDataFrame([], "id string, doi string, arxiv_id string, pub_number string")
    got = curate.route(rows, known).groupBy("status", "duplicate_of").count().collect()
    assert sorted(map(tuple, got), key=str) == [("duplicate", "s00000", 3999), ("ok", None, 1)]
    assert curate.route(rows.limit(0), known).count() == 0


def test_free_names_and_imports_equal_a_loop(spark):
    r = random.Random(3)
    there = ["a", "a-3", "a-4", "a-1", "a-02", "b-2", "c-5", "zz", None]
    rows = [(i, r.choice("aaabcd"), r.choice(["", "10.1/x", f"10.1/{r.randrange(30)}"]), r.choice(["", f"2001.{r.randrange(20)}v1"]), "", r.choice(["", "book"])) for i in range(120)]
    known = [("k1", "10.1/3", "2001.4", ""), ("k2", None, "2001.7", None)]
    names, held, want = set(there), {("d", "10.1/3"): "k1", ("a", "2001.4"): "k1", ("a", "2001.7"): "k2"}, {}
    for i, stem, d, a, p, kind in rows:
        a = a.removesuffix("v1")
        if d and ("d", d) in held:
            want[i] = ("duplicate", "doi", held["d", d], None)
        elif a and ("a", a) in held:
            want[i] = ("duplicate", "arxiv_id", held["a", a], None)
        elif not d and not a and kind != "book":
            want[i] = ("needs_review", "no_doi", None, None)
        else:
            name, n = stem, 2
            while name in names:
                name, n = f"{stem}-{n}", n + 1
            names.add(name)
            held |= {k: name for k in (("d", d), ("a", a)) if k[1]}
            want[i] = ("ingested", "", None, name)
    kinds = "nth long, stem string, doi string, arxiv_id string, pub_number string, kind string"
    got = curate.imported(spark.createDataFrame(rows, kinds), spark.createDataFrame(known, "id string, doi string, arxiv_id string, pub_number string"), spark.createDataFrame([(n,) for n in there], "dir_name string"))
    assert {x["nth"]: tuple(x)[1:] for x in got.collect()} == want
