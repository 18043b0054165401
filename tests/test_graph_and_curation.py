import pytest
from pyspark.sql import functions as F

from papyra.operators import analytics as a
from papyra.operators import curate as c
from papyra.operators import graph as g
from papyra.operators import maintain as m

YEARS = {"S": 2020, "A": 2021, "B": 2022, "C": 2023, "D": 2024, "W": 2019, "X": 2018, "Y": 2017, "Z": 2016, "ISO": 2025}
CITES = {"S": "WX", "A": "XYS", "B": "XZS", "C": "X", "D": "WX"}


@pytest.fixture(scope="module")
def graph(spark):
    registry = spark.createDataFrame([(k, k, y, f"10.1/{k.lower()}") for k, y in YEARS.items()], "id string, dir_name string, year int, doi string")
    raw = spark.createDataFrame([(s, f"10.1/{t.lower()}") for s, ts in CITES.items() for t in ts], "source_id string, target_doi string")
    return g.resolve_links(raw, registry).cache(), registry


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_snowball_of_one_seed(spark, graph):
    rows = g.ordered_candidates(g.snowball(*graph, ids(spark, "S"))).collect()
    assert [(r.id, r.score) for r in rows] == [("D", 4), ("A", 3), ("B", 3), ("C", 2), ("W", 1), ("X", 1)]
    kinds = {r.id: r.relations for r in rows}
    assert kinds == {"A": "citing+shared", "B": "citing+shared", "C": "shared", "D": "shared", "W": "refs", "X": "refs"}


def test_snowball_of_two_seeds_and_with_a_whitelist(spark, graph):
    rows = {r.id: r for r in g.snowball(*graph, ids(spark, "S", "C")).collect()}
    assert rows["X"].cited_by_seeds == 2 and rows["X"].score == 2 and rows["W"].score == 1 and rows["D"].score == 4 and "C" not in rows
    few = g.ordered_candidates(g.snowball(*graph, ids(spark, "S"), ids(spark, "A", "C", "W"))).collect()
    assert [r.id for r in few] == ["A", "C", "W"]


def test_references_and_shared(spark, graph):
    edges, registry = graph
    assert {r.target_id for r in g.references(edges, registry, ids(spark, "A")).collect()} == {"X", "Y", "S"}
    assert {r.source_id for r in g.citing(edges, registry, ids(spark, "X")).collect()} == set("SABCD")
    assert [(r.target_doi, r.shared) for r in g.shared_references(edges, ids(spark, "S", "D", "C")).orderBy("target_doi").collect()] == [("10.1/w", 2), ("10.1/x", 3)]


def test_reference_entries_of_all_kinds(spark):
    df = spark.createDataFrame([(['{"doi": "10.1/A"}', '{"externalIds": {"DOI": "10.1/b"}}', " 10.1/C ", "", "{}"],)], "r array<string>")
    assert df.select(g.reference_dois(F.col("r")).alias("d")).first().d == ["10.1/a", "10.1/b", "10.1/c"]


def test_hot_keywords_and_reading(spark):
    q = spark.createDataFrame([(1, "Heat transfer in turbulent flow"), (2, "heat transfer via wall motion"), (3, "the heat, and transfer")], "seq int, query string")
    assert [tuple(r) for r in a.hot_keywords(q, 2).collect()] == [("heat", 3), ("transfer", 3)]
    names = ["va", "vb", "vc", "single-a", "single-a", "single-b", "single-b"]
    titles = ["Merged Title"] * 3 + ["Single A", "", "Single B", ""]
    e = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(zip(names, titles))], "seq int, name string, title string")
    assert [tuple(r) for r in a.most_read(e, None, 2).collect()] == [("Merged Title", 3), ("Single A", 2)]
    w = spark.createDataFrame([("2026-03-02T10:00:00+00:00",), ("2026-03-03T10:00:00Z",), ("2026-03-11T00:00:00+00:00",), ("junk",)], "ts string")
    assert sorted(tuple(r) for r in a.weekly_trend(w).collect()) == [("2026-W10", 2), ("2026-W11", 1)]


def test_topics(spark):
    lib = spark.createDataFrame([("Smith", ["force-field", "md"]), ("Wang", ["md", "md"])], "paper_id string, tags array<string>")
    tax = spark.createDataFrame([("force-field", ["FF"]), ("md", [])], "tag string, aliases array<string>")
    got = {r.tag: (r.papers, r.share) for r in c.topic_overview(lib, tax).collect()}
    assert got == {"md": (2, 1.0), "force-field": (1, 0.5)}
    assert {r.raw: r.tag for r in c.resolve_tags(spark.createDataFrame([("ff",), ("Force Field",), ("q",)], "raw string"), tax).collect()} == {"ff": "force-field", "Force Field": "force-field", "q": None}


def test_audit_rules(spark):
    base = {"paper_id": "p", "dir_name": "Smith-2023-T", "title": "Deep learning", "doi": "10.1/x", "paper_type": "journal-article", "abstract": "a", "year_text": "2023", "authors": "S", "journal": "J", "arxiv_id": "", "tags": ["t"], "md_text": "# Deep learning\n" + "word " * 60}
    rows = [base, base | {"paper_id": "q"}, base | {"paper_id": "r", "doi": "", "paper_type": "thesis", "md_text": None, "tags": [], "dir_name": "odd"}, base | {"paper_id": "s", "doi": "10.48550/arXiv.1", "year_text": "2020", "md_text": "# Quantum chemistry"},
            base | {"paper_id": "t", "doi": "", "paper_type": "technical-report", "title": ""}]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{k} {'array<string>' if k == 'tags' else 'string'}" for k in base))
    got = {}
    for r in c.audit(df).collect():
        got.setdefault(r.paper_id, set()).add(r.rule)
    assert got["p"] == got["q"] == {"duplicate_doi"}
    assert got["r"] == {"missing_md", "missing_doi", "untagged", "nonstandard_filename"}
    assert got["s"] == {"arxiv_id_missing", "short_md", "title_mismatch", "filename_year_mismatch"}
    assert got["t"] == {"missing_title"}


def test_index_runs_are_idempotent_and_collect(spark):
    now = spark.createDataFrame([("a", "1"), ("b", "2")], "paper_id string, h string")
    old = spark.createDataFrame([("b", "0"), ("z", "9")], "paper_id string, h string")
    once = m.upserted(now, old)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, m.upserted(now, once).collect())) == [("a", "1"), ("b", "2")]
    assert [r[0] for r in m.stale(now, old).collect()] == ["z"]
    edges = spark.createDataFrame([("a", "x"), ("b", "y")], "source_id string, target_doi string")
    new = spark.createDataFrame([("a", "w")], "source_id string, target_doi string")
    assert sorted(map(tuple, m.replace_edges(edges, new).collect())) == [("a", "w"), ("b", "y")]
    seen = spark.createDataFrame([("b",)], "source_id string")
    assert sorted(map(tuple, m.replace_edges(edges, new, True, seen).collect())) == [("a", "w")]


def test_refetch_takes_records_without_publisher(spark):
    rows = [("full", "d", 3, "1", "P"), ("cites", "d", 0, "1", "P"), ("volume", "d", 3, "", "P"), ("blank", "d", 3, "1", ""), ("null", "d", 3, "1", None), ("no-doi", "", 0, "", "")]
    records = spark.createDataFrame(rows, "paper_id string, doi string, citations long, volume string, publisher string")
    assert {r.paper_id for r in c.needs_refetch(records).collect()} == {"cites", "volume", "blank", "null"}


def test_collection_broadcasts_no_ids(spark):
    from papyra.operators import metadata

    ids = spark.range(100).toDF("id")
    edges = ids.selectExpr("id as source_id", "id + 1 as target_id")
    got = metadata.collected({"citations": (edges, "source_id")}, ids.where("id < 50"))["citations"]
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == [(i, i + 1 if i < 49 else None) for i in range(50)]
