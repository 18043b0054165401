import json
import re

import pytest
from pyspark.sql import functions as F

from papyra.functions import text as t
from papyra.operators import export as e
from papyra.operators import extract as x
from papyra.operators import tooldocs as d
from papyra.sources import catalogue, records
from papyra.streaming import events


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("name,want", [("Jane Smith", "Smith"), ("Smith, Jane", "Smith"), ("Ludwig van Beethoven", "van Beethoven"), ("Smith J", "Smith"), ("王伟", "王"), ("Plato", "Plato")])
def test_last_names(spark, name, want):
    assert one(spark, t.last_name(F.lit(name))) == want


def test_identifiers(spark):
    assert one(spark, t.arxiv_key(F.lit("https://arxiv.org/pdf/2101.00001v3.pdf"))) == "2101.00001"
    assert one(spark, t.arxiv_key(F.lit("arXiv:hep-th/9901001v2"))) == "hep-th/9901001"
    assert one(spark, t.arxiv_key(F.lit("nothing"))) == ""
    assert one(spark, t.clean_doi(F.lit(" https://dx.doi.org/10.1/AbC "))) == "10.1/abc"
    assert one(spark, t.arxiv_of_doi(F.lit("10.48550/arXiv.2101.1"))) == "2101.1"
    assert one(spark, t.normal_tag(F.lit("  Force_ Field -- x-"))) == "force-field-x"
    assert one(spark, t.flipped_name(F.lit("Doe, Jane"))) == "Jane Doe"
    assert one(spark, t.file_stem(F.lit("Smith"), F.lit(2023), F.lit("A <i>big</i> $x$ title"))) == "Smith-2023-A-big-title"
    assert one(spark, t.file_stem(F.lit(""), F.lit(None), F.lit(""))) == "Unknown-XXXX-Untitled"
    assert one(spark, t.dice(F.lit("a b c"), F.lit("b c d"))) == pytest.approx(2 / 3)
    assert one(spark, t.similar_title(F.lit("Deep learning"), F.lit("On deep learning now"))) is True


def test_mentions(spark):
    df = spark.createDataFrame([(1, "Smith (2023) shows. See (Smith, 2023; Wang et al., 2024) and Smith & Doe (2021).")], "doc_id long, text string")
    got = [(r.author, r.year) for r in x.citation_mentions(df).orderBy("nth").collect()]
    assert got == [("Smith", "2023"), ("Smith & Doe", "2021"), ("Wang et al.", "2024")]


def test_front_matter_and_names(spark):
    md = "# Research Paper\n\n# Turbulence in pipes\n\nJane Doe<sup>1</sup>, Wei Wang and John Q. Smith*\n\n## Abstract\nx"
    r = spark.createDataFrame([(md,), (None,)], "m string").select(x.front_matter(F.col("m")).alias("f")).collect()
    assert r[0].f.title == "Turbulence in pipes" and r[0].f.authors == ["Jane Doe", "Wei Wang", "John Q. Smith"]
    assert r[1].f.title == ""
    long = "x" * 70 + "-" + "é" * 60
    assert spark.createDataFrame([(long,)], "m string").select(x.file_name("m").alias("n")).first().n == "x" * 70
    assert spark.createDataFrame([("a &amp; b",)], "m string").select(x.unescaped("m").alias("n")).first().n == "a & b"


def test_extraction(spark):
    md = "# T\nhttps://doi.org/10.5281/zenodo.1 and doi: 10.1000/XYZ.\n(c) 1900 (2018)\nReceived 3 May 2019\nUS1234567B2 arXiv:2101.00001"
    assert one(spark, x.doi_of(F.lit(md))) == "10.1000/XYZ"
    assert one(spark, x.year_of_text(F.lit(md))) == 2019
    assert one(spark, x.patent_of(F.lit(md))) == "US1234567B2"
    assert one(spark, x.arxiv_of_text(F.lit(md))) == "2101.00001"
    assert one(spark, x.clean_abstract(F.lit("short"))) is None
    assert one(spark, x.html_plain(F.lit("<p>a &amp; b</p><script>x</script><ul><li>c</li></ul>"))) == "a & b\nc"


def test_split_by_plan_and_outline(spark):
    v = spark.createDataFrame([("v", "# One\na\n\nb\n# Two\nc")], "volume_id string, md_text string")
    plan = spark.createDataFrame([("v", "One", 1, 4), ("v", "Two", 5, 6)], "volume_id string, title string, start_line int, end_line int")
    assert {r.title: r.md_text for r in x.split_by_plan(v, plan).collect()} == {"One": "# One\na\n\nb", "Two": "# Two\nc"}
    assert [(r.title, r.preview) for r in x.outline(v, "volume_id").orderBy("line").collect()] == [("One", ["a", "b", "# Two", "c"]), ("Two", ["c"])]


def test_custom_style(spark):
    rows = spark.createDataFrame([("p1", "T", ["A B"], "2020", "J", ""), ("p2", "S", ["C D"], "2021", "J", "")], "paper_id string, title string, authors array<string>, year_text string, journal string, doi string")
    e.register_style("tiny", lambda meta, i: f"[{i}] {meta['title']}")
    assert [r.ref for r in e.reference_list(rows, "tiny").orderBy("nth").collect()] == ["[1] S", "[2] T"]
    with pytest.raises(ValueError):
        e.register_style("../x", lambda m, i: "")


def test_record_folders(spark, tmp_path):
    for name, meta in (("Smith-2023-T", {"id": "aaaa", "title": "T", "authors": ["J S"], "year": 2023, "citation_count": {"s2": 12, "crossref": 10}, "references": [{"doi": "10.1/Q"}, "10.1/r"]}), ("Wang", {"title": "W", "year": ""})):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(json.dumps(meta, indent=1))
    (tmp_path / "Bad").mkdir()
    (tmp_path / "Bad" / "meta.json").write_text("{not json")
    (tmp_path / "Wang" / "paper.md").write_text("# W\ntext")
    (tmp_path / "Wang" / "paper_zh.md").write_text("# 王\n正文")
    got = {r.dir_name: r for r in records.records(spark, str(tmp_path)).collect()}
    assert got["Smith-2023-T"].paper_id == "aaaa" and got["Wang"].paper_id == "Wang" and got["Bad"].corrupt and not got["Wang"].corrupt
    assert got["Wang"].year is None and got["Wang"].doi == ""
    from papyra.operators.curate import best_citation
    from papyra.operators.graph import reference_dois

    rows = records.records(spark, str(tmp_path)).where("paper_id = 'aaaa'").select(best_citation(F.col("citation_count")).alias("n"), reference_dois(F.col("references")).alias("r")).first()
    assert rows.n == 12 and rows.r == ["10.1/q", "10.1/r"]
    texts = records.texts(spark, str(tmp_path))
    assert {r.dir_name: r.md_text for r in records.with_text(records.records(spark, str(tmp_path)), texts, "zh").collect()}["Wang"] == "# 王\n正文"
    assert records.layer(records.records(spark, str(tmp_path)), 2).where("paper_id = 'aaaa'").first().abstract == "[No abstract available]"


def test_ris_and_endnote(spark, tmp_path):
    (tmp_path / "a.ris").write_text("TY  - JOUR\nTI  - First\nAU  - Doe, Jane\nAU  - Li, Wei\nPY  - 2020/05\nDO  - https://doi.org/10.1/A\nSP  - 1\nEP  - 9\nER  - \n\nTY  - THES\nTI  - Second\nER  - \n")
    rows = records.ris(spark, str(tmp_path / "a.ris")).orderBy("nth").collect()
    assert [(r.title, r.authors, r.year, r.doi, r.pages, r.paper_type) for r in rows] == [("First", ["Jane Doe", "Wei Li"], 2020, "10.1/a", "1-9", "journal-article"), ("Second", [], None, "", "", "thesis")]
    (tmp_path / "b.xml").write_text('<xml><records><record><ref-type name="Journal Article">17</ref-type><titles><title>X</title><secondary-title>J</secondary-title></titles><contributors><authors><author>Doe, J.</author><author>Roe, R.</author></authors></contributors><dates><year>2019</year></dates><isbn>1234-5678</isbn></record></records></xml>')
    r = records.endnote_xml(spark, str(tmp_path / "b.xml")).first()
    assert (r.title, r.authors, r.year, r.journal, r.issn, r.paper_type) == ("X", ["J. Doe", "R. Roe"], 2019, "J", "1234-5678", "journal-article")


def test_catalogue_pages(spark, tmp_path):
    work = lambda i, kind: {"id": f"W{i}", "doi": f"https://doi.org/10.1/{i}", "title": f"<i>T{i}</i>", "publication_year": 2000 + i, "cited_by_count": i, "type": kind, "authorships": [{"author": {"display_name": "A B"}}], "abstract_inverted_index": {"b": [1], "a": [0, 2]}}
    (tmp_path / "p1.json").write_text(json.dumps({"results": [work(1, "article"), work(2, "book")]}))
    (tmp_path / "p2.json").write_text(json.dumps({"results": [work(3, "article")]}))
    catalogue.register(spark)
    rows = spark.read.format("works_catalogue").load(str(tmp_path)).where("type = 'article' and cited_by_count >= 2").collect()
    assert [(r.openalex_id, r.doi, r.title, r.abstract, r.authors) for r in rows] == [("W3", "10.1/3", "T3", "a b a", ["A B"])]
    waits, answers = [], iter([OSError(), {"results": [1], "meta": {"next_cursor": "n"}}, {"results": []}])

    def fetch(cursor):
        a = next(answers)
        if isinstance(a, OSError):
            raise a
        return a

    assert list(catalogue.fetched(fetch, sleep=waits.append)) == [1] and waits == [4]


def test_chunks_and_pdfs(spark):
    f = spark.createDataFrame([("a", 100, 1 << 20), ("b", 1500, 1 << 20), ("c", 100, 400 << 20)], "key string, pages int, bytes long")
    assert {r.key: (r.chunk_pages, r.chunks) for r in records.chunk_plan(f).collect()} == {"a": (100, 1), "b": (600, 3), "c": (50, 2)}
    p = spark.createDataFrame([("k", "x/main.pdf", 10), ("k", "x/supplement.pdf", 99), ("j", "y/appendix.pdf", 5)], "key string, path string, size int")
    assert {r.key: r.path for r in records.main_pdf(p).collect()} == {"k": "x/main.pdf", "j": "y/appendix.pdf"}


def test_crawl_and_coverage(spark):
    pages = spark.createDataFrame([("a", '<a href="b">b</a>'), ("b", '<a href="c">c</a><a href="zz">z</a>'), ("c", '<a href="a">a</a>')], "url string, html string")
    links = lambda p: x.html_links(p, "url")
    seeds = spark.createDataFrame([("a",)], "url string")
    assert {r.url for r in d.crawl(pages, seeds, links, "", 10).collect()} == {"a", "b", "c", "zz"}
    assert d.crawl(pages, seeds, links, "", 2).count() == 2
    ex = spark.createDataFrame([("t", "1", "p"), ("t", "1", "q")], "tool string, version string, page_name string")
    assert [tuple(r) for r in d.coverage(ex, ex.limit(1)).collect()] == [("t", "1", 2, 1, 1)]


def test_streams(spark, sf, tmp_path):
    spark.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "event_type").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("event_id long, ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in")).select(F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("category"))
    q = events.weekly_counts(events.unique_events(source), None).writeStream.format("memory").queryName("weekly").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("weekly").count() > 0
    q = events.upsert_batches(source, str(tmp_path / "state"), "category", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "state/v=0")).count() == 5


def test_a_shelved_library_is_listed_by_tasks_alone(spark, tmp_path, monkeypatch):
    """Same rows as from a plain folder, without a file listing on the driver."""
    from papyra.sources import sinks

    texts = {f"P{i}": json.dumps({"id": f"p{i}", "title": f" T {i} ", "year": 2000 + i, "tags": ["a"], "citation_count": {"s2": i}, "references": [{"doi": "10.1/Q"}]}) for i in range(40)}
    rows = spark.createDataFrame(list(texts.items()), "dir_name string, record string")
    for shelved in (False, True):
        assert sinks.write_records(rows, f"file://{tmp_path}/{shelved}", shelved=shelved).count() == 40
        at = tmp_path / str(shelved) / (sinks.shelf_of("Bad") if shelved else "") / "Bad"
        at.mkdir(parents=True)
        (at / "meta.json").write_text("{not json")
    plain, shelves = records.records(spark, f"file://{tmp_path}/False"), records.records(spark, f"file://{tmp_path}/True", shelved=True)
    said = lambda df: sorted(re.sub(r"\\n|\s", "", str(r)) for r in df.collect())
    assert said(plain) == said(shelves) and len(said(plain)) == 41
    assert shelves.inputFiles() == []
    empty = tmp_path / "True" / sinks.shelf_of("None") / "None"
    empty.mkdir(parents=True)
    (empty / "meta.json").write_text("")
    assert [r.corrupt for r in shelves.where("dir_name in ('None', 'Bad')").collect()] == [True, True]


def test_signs_of_patterns_lose_no_match(spark):
    import random

    rng = random.Random(17)
    parts = [
        "Annu. Rev. Fluid Mech. 51", "ANNUAL REVIEW of Solids 1988", "annurev 2001", "Cite as: A, 1999", "© 2004", "COPYRIGHT 2010", "(c) 2012", "Available online 3 May 2011", "PUBLISHED online 3 May 1600", "published 3 May 2013", "Received 4 June 2015", "ACCEPTED in 1951",
        "in 1999. 12 (3) 4", "Volume 3, 1977", "VOL. 7 (2031) 1980", "Physics of Fluids", "phys fluid", "Phys. Rev. E", "J. Fluid Mech.", "JOURNAL of Computational Physics", "j comput phys", "Int. J. Multiphase Flow", "Computers & Fluids", "Flow, Turbulence and Combustion", "NATURE Physics",
        "Science Robotics", "https://dx.doi.org/10.1234/Ab.c", "http://DOI.ORG/10.5281/x", "doi： 10.5555/q;", "[DOI: 10.7777/7]", "article's DOI 10.8888/8", "文献DOI：\n10.9999/\n9", "\n10.4321/line\n", "10.17632/a", "arXiv : 2401.00001v2", "ARXIV.org/abs/hep-th/0101001", "arxiv.org/PDF/2001.1234", "İSTANBUL ſ K", "é\n", "",
    ]
    texts = [(i, " ".join(rng.sample(parts, rng.randrange(4))), "") for i in range(600)] + [(1000 + i, p, "") for i, p in enumerate(parts)]
    rows = spark.createDataFrame(texts, "id long, t string, stem string")
    t = F.col("t")
    found = lambda c, p: F.regexp_extract(c, p, 1)
    doi = F.regexp_replace(F.regexp_replace(t, r"(文献DOI\s*[:：]?\s*)\n", "$1"), r"(10\.\d{4,}[./])\n\s*", "$1")
    plain = {
        "doi": (x.doi_of(t), [F.regexp_replace(found(doi, p), r"[.;,]+$", "") for p in x.DOI_PATTERNS], lambda v: v and not v.startswith(tuple(x.DATA_PREFIXES)), ""),
        "year": (x.year_of_text(t), [found(t, p) for p in x.YEAR_PATTERNS], lambda v: v and 1950 <= int(v) <= 2030, None),
        "journal": (x.journal_of_text(t), [F.trim(found(t, p)) for p in x.JOURNAL_PATTERNS], bool, ""),
        "arxiv": (x.arxiv_of_text(t), [found(t, p) for p in x.ARXIV_PATTERNS], bool, ""),
    }
    got = rows.select("t", *[c.alias(n) for n, (c, *_) in plain.items()], *[F.array(*tries).alias(f"{n}_all") for n, (_, tries, *_) in plain.items()]).collect()
    for r in got:
        for n, (_, _, fits, none) in plain.items():
            want = next((v for v in r[f"{n}_all"] if fits(v)), none)
            assert r[n] == (int(want) if n == "year" and want else want), (n, r.t)
    # each pattern but one has a sign, and each was put to the test
    for signs, name in ((x.DOI_SIGNS, "doi"), (x.YEAR_SIGNS, "year"), (x.JOURNAL_SIGNS, "journal"), (x.ARXIV_SIGNS, "arxiv")):
        assert signs.count("") == (name == "year")
        assert all(any(r[f"{name}_all"][k] for r in got) for k in range(len(signs))), name
