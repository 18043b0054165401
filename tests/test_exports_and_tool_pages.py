"""Entries, scores and listings with literal answers."""

from pyspark.sql import functions as F

from papyra.operators import export, library, metadata, tooldocs

RECORD = "paper_id string, title string, authors array<string>, first_author_lastname string, year_text string, journal string, volume string, issue string, pages string, publisher string, issn string, doi string, abstract string, paper_type string"


def test_bibtex_and_ris_entries(spark):
    full = ("a", "On co-op & the 5% of it", ["John Smith", "Jane Doe"], "Smith", "2023", "J. of X_Y", "12", "3", "100-120", "Press & Co", "0022-1120", "10.1/x_y", "All of #1.", "conference-paper")
    bare = ("b", "A b", [], None, None, "", None, "", "17", None, None, None, " ", None)
    rows = spark.createDataFrame([full, bare], RECORD)
    bib = {r.paper_id: r.entry for r in export.bibtex(rows).collect()}
    assert bib["a"] == (
        "@inproceedings{Smith2023Coop,\n  title = {{On co-op \\& the 5\\% of it}},\n  author = {John Smith and Jane Doe},\n  year = {2023},\n  journal = {J. of X\\_Y},\n  volume = {12},\n  number = {3},\n  pages = {100-120},\n"
        "  publisher = {Press \\& Co},\n  issn = {0022-1120},\n  doi = {10.1/x_y},\n  abstract = {{All of \\#1.}},\n}"
    )
    assert bib["b"] == "@article{Unknown,\n  title = {{A b}},\n  pages = {17},\n}"
    ris = {r.paper_id: r.entry for r in export.ris(rows).collect()}
    assert ris["a"].split("\n") == [
        "TY  - CONF", "TI  - On co-op & the 5% of it", "AU  - John Smith", "AU  - Jane Doe", "PY  - 2023", "JO  - J. of X_Y", "VL  - 12", "IS  - 3", "SP  - 100", "EP  - 120", "PB  - Press & Co", "SN  - 0022-1120", "DO  - 10.1/x_y",
        "UR  - https://doi.org/10.1/x_y", "AB  - All of #1.", "ER  -",
    ]
    assert ris["b"] == "TY  - GEN\nTI  - A b\nSP  - 17\nER  -"


PAGES = [
    (1, "gromacs/mdp/pcoupl", "pcoupl", "Pressure coupling algorithm", "|pressure coupling|barostat|", "mdp", "gmx"), (2, "gromacs/mdp/pcoupltype", "pcoupltype", "Kind of pressure coupling", "text", "mdp", "gmx"),
    (3, "gromacs/man/other", "Pressure Coupling", "", "all about the pressure", "manual", "gmx"), (4, "gromacs/man/pressure-coupling", "x", "", "", "manual", "gmx"), (5, "gromacs/man/nothing", "tau p", "", "tau p", "manual", None),
]


def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, page_name string, title string, synopsis string, content string, section string, program string")


def test_scores_of_a_tool_page(spark):
    got = {r.page_id: r.s for r in pages(spark).select("page_id", tooldocs.score_terms(F.lit("gromacs"), F.lit("pressure coupling"), F.array(F.lit("pressure coupling"), F.lit("Tau P"))).alias("s")).collect()}
    # synopsis 90, content 70, words 2 * (12 + 6), section 20, bonus 90; synopsis 90, words 24, section 20, bonus 40; title 120, words 36 + 6; name 110; term: title 80, content 35
    assert got == {1: 90 + 70 + 36 + 20 + 90, 2: 90 + 24 + 20 + 40, 3: 120 + 36 + 6, 4: 110, 5: 80 + 35}


def test_search_of_tool_pages(spark):
    rows = pages(spark)
    index = tooldocs.index_pages(rows)
    got = [(r.page_id, r.tier) for r in tooldocs.tool_search(index, rows, "gromacs", "Pressure-coupling", ["tau p"], 10).collect()]
    assert got == [(1, 1), (2, 3), (3, 0), (5, 4), (4, 2)]
    assert {r.page_id for r in tooldocs.tool_search(index, rows, "gromacs", "pressure coupling", [], 2).collect()} == {3, 1}  # the limit goes by tier
    assert {r.page_id for r in tooldocs.tool_search(index, rows, "gromacs", "pressure coupling", [], section="MDP").collect()} == {1, 2}
    assert tooldocs.tool_search(index, rows, "gromacs", "zzz", []).count() == 0


def test_a_listing_is_filtered_by_the_whole_query(spark):
    entry = '<dt><a href="/abs/2401.{i}">x</a></dt><dd><div class="list-title"><span>Title:</span> {t}</div><div class="list-authors"><a>Ann Bo</a>, <a>Cy Do</a></div></dd>'
    page = spark.createDataFrame([("<dl>" + entry.format(i="00001", t="Flow of heat") + entry.format(i="00002", t="Heat of flow") + "</dl>",)], "html string")
    of = lambda q: [r.arxiv_id for r in library.recent_listing(page, q).collect()]
    assert of("flow of") == ["2401.00001"] and of("heat flow") == [] and of("heat ann bo cy") == ["2401.00001"] and len(of("")) == 2


def test_backfilled_abstracts(spark):
    long, other = "The publisher's account of what was measured, in full.", "Another account of what was measured in the pipes here."
    page = lambda t: f'<meta name="citation_abstract" content="{t}">'
    records = spark.createDataFrame([("new", "", "10.1/a"), ("old", "own words", "10.1/b"), ("same", long, "10.1/C"), ("none", None, ""), ("bad", None, "null"), ("file", " ", "10.1/z"), ("has", "own", "")], "paper_id string, abstract string, doi string")
    texts = spark.createDataFrame([("none", None), ("bad", "# T\nx"), ("file", f"# T\n\n## Abstract\n\n{other}\n\n## 1 Intro"), ("new", f"## Abstract\n\n{other}\n\n# 1 X")], "paper_id string, md_text string")
    web = spark.createDataFrame([("https://doi.org/10.1/a", page(long)), ("10.1/b", page(long)), ("10.1/c", page(long)), ("10.1/z", "<p>nothing</p>")], "doi string, html string")
    got = {r.paper_id: (r.outcome, r.abstract, r.source) for r in metadata.backfilled(records, texts, web).collect()}
    skipped = ("skipped", None, None)
    assert got == {"new": ("filled", long, "page"), "old": ("updated", long, "page"), "same": skipped, "none": skipped, "bad": ("failed", None, None), "file": ("filled", other, "text"), "has": skipped}
    without = {r.paper_id: r.outcome for r in metadata.backfilled(records, texts).collect()}
    assert without == {"new": "filled", "old": "skipped", "same": "skipped", "none": "skipped", "bad": "failed", "file": "filled", "has": "skipped"}
    assert tuple(metadata.backfill_counts(metadata.backfilled(records, texts, web)).first()) == (2, 1, 3, 1)
