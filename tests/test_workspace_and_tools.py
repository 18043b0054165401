import pytest

from papyra.operators import proceedings as p
from papyra.operators import workspace as w
from papyra.sources import tool_pages as tp

from pyspark.sql import functions as F


def test_workspace_life(spark):
    reg = spark.createDataFrame([("a", "A-dir", "10.1/a", ""), ("b", "B-dir", "10.1/b", "")], "id string, dir_name string, doi string, publication_number string")
    members = spark.createDataFrame([("w", "a", "Old", "t0"), ("v", "x", "X", "t0")], "ws string, id string, dir_name string, added_at string")
    refs = spark.createDataFrame([("a",), ("10.1/B",), ("nope",)], "ref string")
    now, missing = w.added(members, "w", refs, reg, "t1")
    assert sorted((r.ws, r.id, r.dir_name) for r in now.collect()) == [("v", "x", "X"), ("w", "a", "Old"), ("w", "b", "B-dir")]
    assert [r.ref for r in missing.collect()] == ["nope"]
    assert sorted((r.ws, r.id) for r in w.removed(now, "w", refs, reg).collect()) == [("v", "x")]
    gone = w.removed(now, "v", spark.createDataFrame([("X",)], "ref string"), reg)
    assert sorted((r.ws, r.id) for r in gone.collect()) == [("w", "a"), ("w", "b")]
    assert [r.dir_name for r in w.shown(now, "w", reg).orderBy("id").collect()] == ["A-dir", "B-dir"]
    assert [r.ws for r in w.names(w.renamed(now, "v", "u")).collect()] == ["u", "w"]
    with pytest.raises(ValueError):
        w.renamed(now, "v", "../x")


VOLUME = "# Proceedings of Things\n\n# Contents\n\nFirst paper 1 A. Author\n\nSecond\npaper 9 B. Writer\n\nAuthor Index 20\n\n# First paper\n\nA. Author\nSome Lab\n\nAbstract. We do\nthis.\n\n## 1 Intro\n"


def test_proceedings(spark):
    df = spark.createDataFrame([(VOLUME,)], "t string")
    r = df.select(p.volume_title(F.col("t"), F.lit("x")).alias("v"), p.contents_titles(F.col("t")).alias("c")).first()
    assert r.v == "Proceedings of Things" and r.c == ["First paper", "Second paper"]
    chunk = VOLUME[VOLUME.index("# First") :]
    f = spark.createDataFrame([(chunk,), (None,), ("# T\n\nJust text",)], "t string").select(p.chunk_front("t").alias("f")).collect()
    assert f[0].f.authors == ["A. Author", "Some Lab"] and f[0].f.abstract == "We do\nthis."
    assert f[1].f.authors == [] and f[2].f.abstract == ""
    papers = spark.createDataFrame([("q", "Discussion of X", [], "", "", "# Discussion of X\nComment by Y\nReporter: Z\n# Junk\nend"), ("r", "T", ["A"], "abs", "10.1/x", "# T\nok")], "paper_id string, title string, authors array<string>, abstract string, doi string, md_text string")
    got = {r.paper_id: r.signals for r in p.signals(papers).collect()}
    assert got == {"q": ["missing_authors", "missing_abstract", "missing_doi", "discussion_title", "comment_label", "reporter_line"], "r": []}
    plan = spark.createDataFrame([("q", "rename", "X", ["junk"]), ("r", "drop", None, None)], "paper_id string, action string, title string, headings array<string>")
    assert [(r.paper_id, r.title, r.md_text) for r in p.cleaned(papers, plan).collect()] == [("q", "X", "# Discussion of X\nComment by Y\nReporter: Z\nend")]
    assert spark.createDataFrame([("a\n\nb\nc",)], "t string").select(p.closing_lines(F.col("t"), 2).alias("c")).first().c == ["b", "c"]


def test_tool_pages(spark):
    rst = '.. index:: fix nvt\n.. index:: fix nvt/gpu\n\nfix nvt command\n===============\n\nSyntax\n""""""\n\n.. code-block:: LAMMPS\n\n   fix ID group-ID nvt\n\nDescription\n"""""""""""\n\nDoes things.\n\nDefault\n"""""""\n\nnone\n'
    r = tp.command_pages(spark.createDataFrame([("fix_nvt", rst)], "stem string, text string")).first()
    assert (r.section, r.page_name, r.title, r.default_val) == ("fix", "lammps/fix_nvt", "fix nvt command", "none")
    assert r.synopsis == "fix ID group-ID nvt | Aliases: fix nvt" and "|fix nvt|" in r.content and "Does things." in r.content
    mdp = "intro\n\n.. mdp:: integrator\n\n   Text :mdp:`dt`.\n\n   .. mdp-value:: md\n\n   .. mdp-value:: sd\n\n.. mdp:: dt\n\n   step\n"
    rows = {r.title: r for r in tp.option_pages(spark.createDataFrame([("mdp-options", mdp)], "stem string, text string")).collect()}
    assert rows["integrator"].synopsis == "MDP parameter | Options: md, sd" and "Option: md" in rows["integrator"].content and "Text dt." in rows["integrator"].content
    assert rows["dt"].synopsis == "MDP parameter"
    text = "input_description -distribution {Q} -package PW -program pw.x {\n namelist CONTROL {\n  var calculation -type CHARACTER {\n   default { 'scf' }\n   options { opt -val 'scf' {} opt -val 'nscf' {} }\n   info { What to @b {do}. }\n  }\n  vargroup -type REAL { var a var b info { both } }\n }\n card K_POINTS { flag { x } }\n}\n"
    got = {r.page_name: r for r in tp.definition_pages(spark.createDataFrame([("INPUT_PW", text)], "stem string, text string")).collect()}
    assert set(got) == {"pw.x/CONTROL/calculation", "pw.x/CONTROL/a", "pw.x/CONTROL/b", "pw.x/card/K_POINTS"}
    c = got["pw.x/CONTROL/calculation"]
    assert c.synopsis == "Type: CHARACTER; Default: 'scf'" and "What to do." in c.content and "Options: scf, nscf" in c.content
