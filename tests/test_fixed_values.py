"""Values that are fixed, with their answers written out."""

from pyspark.sql import functions as F

from papyra.operators import analytics, curate, export
from papyra.operators import extract as x
from papyra.operators import metadata as m
from papyra.sources import records


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_dois(spark):
    of = lambda t: one(spark, x.doi_of(F.lit(t)))
    assert of("see https://dx.doi.org/10.1017/jfm.2024.1191.") == "10.1017/jfm.2024.1191"
    assert of("DOI: 10.5281/zenodo.7") == "" and of("text with 10.1000/xyz inside") == ""
    assert of("10.1000/xyz123") == "10.1000/xyz123"
    assert of("doi: 10.1146/\nannurev-fluid") == "10.1146/annurev-fluid"
    assert of("文献DOI：\n10.3969/j.issn.1000") == "10.3969/j.issn.1000"


def test_years_and_journals(spark):
    year = lambda t: one(spark, x.year_of_text(F.lit(t)))
    assert year("Copyright © 2015 ACM") == 2015 and year("Received 3 March 2001; accepted") == 2001
    assert year("Published online 5 May 2019") == 2019 and year("in 1999 we saw") is None and year("© 1066") is None
    assert year("Annu. Rev. 1999") == year("Annual Review of Fluid Mechanics 1999") == 1999
    journal = lambda t: one(spark, x.journal_of_text(F.lit(t)))
    assert journal("J. Fluid Mech. 12") == "J. Fluid Mech." and journal("Nature Communications 3") == "Nature Communications" and journal("A zine") == ""


def test_arxiv_ids_of_texts_and_names(spark):
    of = lambda t, s: one(spark, x.arxiv_of_text(F.lit(t), F.lit(s)))
    assert of("arXiv: 2401.12345v2 [cs]", "x") == "2401.12345" and of("https://arxiv.org/abs/hep-th/9901001", "x") == "hep-th/9901001"
    assert of("none", "0906.2569v2") == "0906.2569" and of("none", "hep-th_9901001") == "hep-th/9901001" and of("none", "paper") == ""


def test_titles_and_authors(spark):
    def of(text):
        f = spark.createDataFrame([(text,)], "m string").select(x.front_matter(F.col("m")).alias("f")).first().f
        return f.title, f.authors

    names = "Wei Wang$^{1}$, B I J L A R D Kees and John Roe*\n\nDepartment of X"
    assert of(f"# 1 Introduction\n# Jane Doe\n# A study of the flow of water in pipes\n{names}") == ("A study of the flow of water in pipes", ["Wei Wang", "BIJLARD Kees", "John Roe"])
    assert of("# Jane Doe\n# By Max Roe\n# A study of the flow of water in pipes\n# 1 Introduction") == ("A study of the flow of water in pipes", ["Jane Doe", "Max Roe"])
    assert of("text") == of(None) == ("", []) and of("# 1 Intro\n# Keywords") == ("Keywords", [])
    assert of("# Abstract\n# Real Title Here") == ("Real Title Here", [])
    assert of("# Jane Doe<sup>1</sup>\n# Turbulence of a kind in a pipe of steel\n\n![x](y)\nReceived 3 May\nA. Lee, B. Roe\n\nC. Not") == ("Turbulence of a kind in a pipe of steel", ["A. Lee", "B. Roe"])
    assert of("# T of it\nA. Lee\nUniversity of Y, lee@y.org\nB. Roe")[1] == ["A. Lee"]


def test_names_of_author_blocks():
    assert x.names_of("王伟，李强、张三") == ["王伟", "李强", "张三"]
    assert x.names_of("Smith; Doe; Wang") == ["Smith", "Doe", "Wang"] and x.names_of("Smith, John and Doe, Jane") == ["Smith", "John", "Doe", "Jane"]
    assert x.names_of("By John Smith (MIT), Sandra Anderson AND Rand Lee") == ["John Smith", "Sandra Anderson", "Rand Lee"]
    assert x.names_of("K E E S A N D J A N de Vries") == ["KEES", "JAN de Vries"] and x.names_of("M. J. Roe") == ["M. J. Roe"]
    assert x.names_of(r"J. $\mathbf{D}^{1}$oe 12, M. $\alpha$Lee\textcircled{R} https://orcid.org/0000-1 m.lee@y.org") == ["J. Doe", "M. Lee"]
    assert x.names_of("John Smith, professor of physics") == ["John Smith, professor of physics"] and x.names_of("") == x.names_of(" *, ; ") == []


def test_file_names(spark):
    of = lambda s: one(spark, m.of_file_name(F.lit(s)))
    got = of("MinerU_markdown_J-Smith-2019-Flow_in_pipes_1234567890")
    assert (got.first_author, got.last_name, got.year, got.title) == ("J Smith", "Smith", 2019, "Flow in pipes")
    assert of("anything").year is None


def test_kinds(spark):
    of = lambda *a: one(spark, m.document_kind(*[F.lit(v) for v in a]))
    assert of("Utility model of a valve", "", "", "") == "patent" and of("T", "", "", "see US10123456B2") == "patent"
    assert of("PhD Thesis", None, None, None) == "thesis" and of("Handbook of X", "", "", "") == "book" and of("T", "Monograph", "", "") == "book" and of("T", "", "", "") == ""


def test_mentions_and_status(spark):
    texts = spark.createDataFrame([(1, "As Smith & Lee (2020) and Wang et al. (2019) show (Doe, 2001; Roe et al., 2002; Doe, 2001)."), (2, None), (3, "")], "doc_id long, text string")
    assert sorted((r.author, r.year) for r in x.citation_mentions(texts).collect()) == [("Doe", "2001"), ("Roe et al.", "2002"), ("Smith & Lee", "2020"), ("Wang et al.", "2019")]
    people = spark.createDataFrame([("a", "2020", "Jane Smithson"), ("b", "2019", "W. Wang"), ("c", "2019", "X. Wang"), ("d", None, None)], "paper_id string, year_text string, authors string")
    got = {r.author: (r.n, r.status) for r in x.citation_status(x.citation_mentions(texts), x.author_index(people)).collect()}
    assert got == {"Smith & Lee": (1, "VERIFIED"), "Wang et al.": (2, "AMBIGUOUS"), "Doe": (0, "NOT_IN_LIBRARY"), "Roe et al.": (0, "NOT_IN_LIBRARY")}


def test_abstracts(spark):
    body = "We measure how water moves through pipes of several widths and lengths."
    of = lambda t: one(spark, x.abstract_of_markdown(F.lit(t)))
    assert of(f"# T\n\n# A B S T R A C T\n\n{body}\n\n# 1 Introduction") == body
    assert of(f"# T\n\nAbstract. {body}\n\n## Methods\nx") == body
    assert of(f"# T\n\n{body} {body}\n\n# 1. Introduction\nx") == f"{body} {body}"
    assert of("# T\nshort") is None


def test_tiers_against_all_pairs(spark):
    local = [("a", "on the flow of water in pipes", "10.1/A", "", 2000), ("b", "heat in channels and pipes of steel", "", "", 2001), ("c", "heat in channels and pipes of steel", "", "", 2009), ("d", "other", "", "2001.00001", 2001), ("e", "nothing alike", "10.1/wrong", "", 2001), ("f", "", "", "", None)]
    cat = [("w", "wholly different", "10.1/wrong", "", 2001), ("x", "On the flow of water in pipes", "10.1/a", "", 2000), ("y", "heat in channels and pipes of steel", "", "", 2001), ("z", "z", "", "2001.00001", 1990)]
    ddl = "string, title string, doi string, arxiv_id string, year int"
    got = {r.paper_id: (r.method, r.catalogue_id) for r in m.looked_up(spark.createDataFrame(local, "paper_id " + ddl), spark.createDataFrame(cat, "catalogue_id " + ddl)).collect()}
    assert got == {"a": ("doi_lookup", "x"), "b": ("title_search", "y"), "c": ("title_search", "y"), "d": ("arxiv_lookup", "z"), "e": ("local_only", None), "f": ("local_only", None)}


def test_tables_of_values(spark):
    assert curate.DOCUMENT_TYPES == ["document", "technical-report", "lecture-notes", "standard", "book-chapter", "manual", "white-paper", "presentation", "meeting-notes"]
    assert {"been", "do", "does", "based"} <= set(analytics.STOP_WORDS) and "how" not in analytics.STOP_WORDS
    assert export.RIS_TYPES["conference-paper"] == "CONF" and export.RIS_TYPES["standard"] == "STAND" and export.BIBTEX_TYPES["book-chapter"] == "inbook"
    assert one(spark, records.endnote_type(F.lit("Web Page"))) == "web-page" and one(spark, records.endnote_type(F.lit("Generic"))) == ""
