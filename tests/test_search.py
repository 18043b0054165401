import sqlite3

import pytest
from pyspark.sql import functions as F

from papyra.functions import guards
from papyra.operators import search as s

FIELDS = {"title": 10.0, "tags": 8.0, "abstract": 2.0}


def library(spark):
    rows = [("A", "quixotic flows", "x", "plain words here"), ("B", "other things", "y", "quixotic quixotic quixotic quixotic"), ("T", "some more", "quixotic", "nothing"),
            ("M", "über Müller state of art", "", "naïve state_of play"), ("C", "湍流模型", "", "aa bb"), ("D", "aa cc", "", "bb dd"), ("E", "cc", "", "aa"), ("F", "filler one", "", "aa bb cc"), ("G", "filler", "", "")]
    return spark.createDataFrame(rows, "paper_id string, title string, tags string, abstract string")


@pytest.fixture(scope="module")
def index(spark):
    return s.build_index(library(spark), {f: F.col(f) for f in FIELDS})


def fts(query):
    con = sqlite3.connect(":memory:")
    con.execute("create virtual table p using fts5(id unindexed, title, tags, abstract, tokenize='unicode61')")
    from pyspark.sql import SparkSession

    con.executemany("insert into p values (?,?,?,?)", [tuple(r) for r in library(SparkSession.getActiveSession()).collect()])
    return dict(con.execute("select id, -bm25(p, 0, 10, 8, 2) from p where p match ?", (query,)).fetchall())


@pytest.mark.parametrize("query", ["quixotic", "muller", "aa bb", "aa aa", "aa OR dd", "aa NOT bb", "aa bb OR cc", "aa OR bb NOT cc", "aa NOT bb OR dd", "naive", "湍流", "湍流模型", "zz", "filler", "aa AND bb cc"])
def test_scores_equal_the_reference_engine(index, query):
    got = {r.id: r.score for r in s.hits(index, query, FIELDS).collect()}
    want = fts(query)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, abs=1e-9)


def test_underscore_makes_a_phrase(index):
    assert {r.id for r in s.hits(index, "state_of", FIELDS).collect()} == {"M"} == set(fts('"state of"'))
    assert not s.hits(index, "of_state", FIELDS).collect()


def test_title_and_tag_beat_four_abstract_hits(index):
    score = {r.id: r.score for r in s.hits(index, "quixotic", FIELDS).collect()}
    assert score["A"] > score["B"] and score["T"] > score["B"]


def test_syntax_errors():
    for q in ("", "aa OR", "NOT aa", "!!", "AND"):
        with pytest.raises(s.QuerySyntaxError):
            s.parse(q)


def test_stored_index_gives_the_same_answers(spark, index, tmp_path):
    index.write(str(tmp_path / "ix"))
    stored = s.SearchIndex.read(spark, str(tmp_path / "ix"))
    for q in ("quixotic", "aa bb"):
        assert sorted(s.hits(stored, q, FIELDS).collect()) == sorted(s.hits(index, q, FIELDS).collect())


def test_year_ranges():
    assert guards.year_range("2023") == ("2023", "2023")
    assert guards.year_range("2020-") == ("2020", None)
    assert guards.year_range("-2024") == (None, "2024")
    assert guards.year_range("-") == (None, None)
    with pytest.raises(ValueError):
        guards.year_range("20x0")


def test_names_and_config():
    for bad in ("", "../x", ".hidden", "a/b", " x"):
        with pytest.raises(ValueError):
            guards.safe_name(bad)
    assert guards.safe_name("my-silo_2") == "my-silo_2"
    assert guards.merged_config({"a": {"b": 1, "c": 2}}, {"a": {"b": 3}, "d": 4}) == {"a": {"b": 3, "c": 2}, "d": 4}
    assert guards.remote_filter(year="2020-2021", min_citations=5) == "from_publication_date:2020-01-01,to_publication_date:2021-12-31,cited_by_count:>4"


def test_words_of_a_record_are_counted_in_its_row(spark, tmp_path):
    import random
    import re
    from collections import defaultdict

    r = random.Random(5)
    text = lambda n: " ".join(r.choice("aa bb Cc dd éé ff 湍流".split()) for _ in range(n))
    rows = [(f"p{k}", text(r.randrange(40)), None if k % 7 == 0 else text(r.randrange(3))) for k in range(60)]
    index = s.build_index(spark.createDataFrame(rows, "paper_id string, title string, abstract string").repartition(3), {"title": F.col("title"), "abstract": F.col("abstract")})
    want = defaultdict(list)
    for i, *texts in rows:
        for field, words in zip(("title", "abstract"), texts):
            for at, w in enumerate(re.findall(r"\w+", (words or "").lower().replace("é", "e"))):
                want[w, i, field].append(at)
    plan = index.postings._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Aggregate" not in plan  # the exchange of the input
    index.write(str(tmp_path / "ix"))
    stored = s.SearchIndex.read(spark, str(tmp_path / "ix")).postings.collect()
    assert {(x.term, x.id, x.field): x.places for x in stored} == want and len(stored) == len(want)
    assert all(x.tf == len(x.places) for x in stored)
    for file in (tmp_path / "ix" / "postings").glob("*.parquet"):
        terms = [x.term for x in spark.read.parquet(str(file)).collect()]
        assert terms == sorted(terms, key=str.encode)
