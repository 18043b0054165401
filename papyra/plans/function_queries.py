"""String functions, workspaces, pages and tools, each against its SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import extract as x
from ..operators import tooldocs as d
from ..operators import workspace as w
from .bridge import LIB, lib, registry, table


#: Letters of a document's first line, and five digits of its length: what the
#: inputs below are filled with, and what picks one of them.
_WORD_SQL, _DIGITS_SQL = "substr(regexp_replace(split_part(text, chr(10), 1), '[^A-Za-z]', '', 'g'), 1, 12)", "lpad(CAST(n_chars % 100000 AS VARCHAR), 5, '0')"


def _one_of(*values: str) -> Column:
    word = F.substring(F.regexp_replace(F.get(F.split("text", "\n", 2), F.lit(0)), "[^A-Za-z]", ""), 1, 12)
    digits = F.lpad((F.col("n_chars") % 100_000).cast("string"), 5, "0")
    chosen = F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("n_chars") % len(values) + 1).cast("int"))
    return F.replace(F.replace(chosen, F.lit("{w}"), word), F.lit("{d}"), digits)


def _one_of_sql(*values: str) -> str:
    listed = "([" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + f"])[CAST(n_chars % {len(values)} + 1 AS INT)]"
    return f"replace(replace({listed}, '{{w}}', {_WORD_SQL}), '{{d}}', {_DIGITS_SQL})"


def _of(make) -> object:
    """A query of one column ``value`` made from the documents."""
    return lambda spark, sf_dir: table(spark, sf_dir, "documents").select("doc_id", make().alias("value"))


def _sql(expression: str) -> str:
    return f"SELECT doc_id, {expression} AS value FROM documents"


DOIS = ("https://doi.org/10.5555/AbC{w}", " http://dx.doi.org/10.1/{w} ", "10.48550/arXiv.{d}{w}", "HTTPS://DOI.ORG/10.7/Q{d}")
REFS = ("arXiv:2401.{d}v3", "https://arxiv.org/abs/hep-th/99{d}", "https://arxiv.org/pdf/2001.{d}v2.pdf", "no {w}", " 1234.{d} ")
NAMES = ("Dyke{w}, Milton van", "Jane {w}x", "  Wei{w},  Wang ", "Plato{w}")
DATES = ("3 May 1999", "2020-01-02", "c. 1850 and 2001", "no date {w}", "2{d}")
ENDNOTE = ("Journal Article", "Book Section", "Web Page", "Generic", "Conference Proceedings")
ZOTERO = ("journalArticle", "bookSection", "webpage", "document", "preprint")
CODES = ("en", "EN", "deu", "toolong{w}", "e{d}", "", "{w}")
MARKS = (r"**bold{w}** and *it*", "`code {w}` [text](http://x) tail", "__under{w}__ ![img{d}](a.png)", "plain {w}")


def _first_line() -> Column:
    return F.get(F.split("text", "\n", 2), F.lit(0))


FIRST = "split_part(text, chr(10), 1)"


def _similar(spark, sf_dir):
    rows = lib(spark, sf_dir).where("length(title) > 0")
    other = F.when(F.col("doc_id") % 3 == 0, F.upper("title")).when(F.col("doc_id") % 3 == 1, F.concat("title", F.lit(" and some more"))).otherwise(F.reverse("title"))
    return rows.select("paper_id", t.similar_title(F.col("title"), other).alias("similar"))


def _upper_sql(text: str) -> str:
    """Upper case with Unicode's full mapping ('ß' to 'SS'), as Spark has it;
    ``upper`` of the SQL engine maps one letter to one ('ß' to 'ẞ')."""
    for c in (chr(k) for k in range(0x80, 0xFB20) if not 0xD800 <= k < 0xE000 and len(chr(k).upper()) > 1):
        text = f"replace({text}, '{c}', '{c.upper()}')"
    return f"upper({text})"


# letters are reversed one by one, marks are not kept with their letter
SIMILAR = f"""WITH {LIB}, p AS (SELECT paper_id, lower(trim(title)) AS a, lower(trim(CASE doc_id % 3 WHEN 0 THEN {_upper_sql("title")} WHEN 1 THEN title || ' and some more' ELSE array_to_string(list_reverse(string_split(title, '')), '') END)) AS b FROM lib WHERE length(title) > 0),
s AS (SELECT *, list_distinct(regexp_extract_all(a, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS x, list_distinct(regexp_extract_all(b, '[\\p{{L}}\\p{{M}}\\p{{N}}_]+')) AS y FROM p)
SELECT paper_id, length(a) > 0 AND length(b) > 0 AND (a = b OR contains(a, b) OR contains(b, a) OR len(list_intersect(x, y)) / greatest(len(x), len(y), 1) > 0.8) AS similar FROM s"""


def _members(spark, sf_dir):
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").where(i % 5 == 0).select(F.concat(F.lit("ws"), (i % 3).cast("string")).alias("ws"), i.alias("id"), F.lit("old").alias("dir_name"), F.lit("2024-01-01").alias("added_at"))


def _shown(spark, sf_dir):
    return w.shown(_members(spark, sf_dir), "ws1", registry(spark, sf_dir))


SHOWN = """WITH m AS (SELECT 'ws' || (o_orderkey % 3) AS ws, o_orderkey AS id FROM orders WHERE o_orderkey % 5 = 0), r AS (SELECT o_orderkey AS id, 'D' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS dir_name FROM orders WHERE o_orderkey % 3 <> 0)
SELECT ws, m.id, coalesce(dir_name, 'old') AS dir_name, '2024-01-01' AS added_at FROM m LEFT JOIN r ON r.id = m.id WHERE ws = 'ws1'"""


def _renamed(spark, sf_dir):
    return w.renamed(_members(spark, sf_dir), "ws1", "moved").groupBy("ws").agg(F.count(F.lit(1)).alias("n"))


def _tool_rows(spark, sf_dir):
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(F.element_at(F.array(F.lit("qe"), F.lit("lammps"), F.lit("gromacs")), (i % 3 + 1).cast("int")).alias("tool"), F.concat(F.lit("v"), (i % 4).cast("string")).alias("version"), F.concat(F.lit("page"), i.cast("string")).alias("page_name"))


def _pinned(spark):
    return spark.createDataFrame([("qe", "v1"), ("lammps", "v9")], "tool string, version string")


def _listed(spark, sf_dir):
    expected = _tool_rows(spark, sf_dir).where("tool = 'gromacs'").groupBy("tool", "version").agg((F.count(F.lit(1)) + 2).alias("expected"))
    return d.tool_list(_tool_rows(spark, sf_dir), _pinned(spark), expected)


LISTED = """WITH p AS (SELECT (['qe', 'lammps', 'gromacs'])[CAST(o_orderkey % 3 + 1 AS INT)] AS tool, 'v' || (o_orderkey % 4) AS version FROM orders)
SELECT tool, version, tool = 'qe' AND version = 'v1' AS is_current, count(*) AS page_count, CASE WHEN tool = 'gromacs' THEN count(*) + 2 END AS expected_pages, CASE WHEN tool = 'gromacs' THEN CAST(2 AS BIGINT) END AS failed_pages FROM p GROUP BY 1, 2"""


def _coverage(spark, sf_dir):
    rows = _tool_rows(spark, sf_dir)
    return d.coverage(rows, rows.where("page_name not like '%7'"))


COVERAGE = """WITH p AS (SELECT (['qe', 'lammps', 'gromacs'])[CAST(o_orderkey % 3 + 1 AS INT)] AS tool, 'v' || (o_orderkey % 4) AS version, 'page' || o_orderkey AS page_name FROM orders)
SELECT tool, version, count(*) AS expected, count(*) FILTER (WHERE NOT ends_with(page_name, '7')) AS present, count(*) FILTER (WHERE ends_with(page_name, '7')) AS missing FROM p GROUP BY 1, 2"""


def _main(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(x.html_main(F.col("html"))).alias("digest"))


MAIN = """WITH b AS (SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<main\\b[^>]*>.*?</main>') THEN regexp_extract(html, '(?is)<main\\b[^>]*>(.*?)</main>', 1) WHEN regexp_matches(html, '(?is)<article\\b[^>]*>.*?</article>') THEN regexp_extract(html, '(?is)<article\\b[^>]*>(.*?)</article>', 1)
  WHEN regexp_matches(html, '(?is)<body\\b[^>]*>.*?</body>') THEN regexp_extract(html, '(?is)<body\\b[^>]*>(.*?)</body>', 1) ELSE html END AS b FROM pages)
SELECT page_id, md5(CASE WHEN instr(lower(b), '<h1') > 1 THEN substr(b, instr(lower(b), '<h1')) ELSE b END) AS digest FROM b"""


def _parts() -> Column:
    i = F.col("url")
    return F.concat(F.lit("<main>lead <h2 id='a'>A</h2>one "), i, F.lit(" <h3 id='b'>B</h3>two "), i, F.lit("<h2 id='c'>C</h2>three</main>"))


def _fragment(spark, sf_dir):
    anchor = F.element_at(F.array(F.lit("a"), F.lit("b"), F.lit("c"), F.lit("none")), (F.col("page_id") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", x.anchor_fragment(_parts(), anchor).alias("fragment"))


FRAGMENT = """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '<h2 id=''a''>A</h2>one ' || url || ' <h3 id=''b''>B</h3>two ' || url WHEN 1 THEN '<h3 id=''b''>B</h3>two ' || url WHEN 2 THEN '<h2 id=''c''>C</h2>three'
  ELSE 'lead <h2 id=''a''>A</h2>one ' || url || ' <h3 id=''b''>B</h3>two ' || url || '<h2 id=''c''>C</h2>three' END AS fragment FROM pages"""


def _page_text(spark, sf_dir):
    text = F.concat(F.lit("Top\nsite menu\n\n\n"), F.concat(F.lit("Page "), "doc_id"), F.lit("\nOverview\n  - item\n"), _first_line(), F.lit("\nCopyright 2020 us\nLast updated: now\n\n\n\nend\nSearch results\nrest"))
    title = F.concat(F.lit("Page "), "doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", title.alias("title"), d.cleaned_page(text, title, F.lit("")).alias("text"))
    return rows.select("doc_id", "text", d.page_synopsis(F.col("text"), F.col("title")).alias("synopsis"))


PAGE_TEXT = f"""WITH f AS (SELECT doc_id, trim({FIRST}, ' ' || chr(9) || chr(13)) AS l FROM documents), g AS (SELECT doc_id, CASE WHEN l IN ('Top', 'Bookshelf', 'Toggle navigation', 'Doc', 'Src', 'Search', '< PrevNext >') OR starts_with(l, 'Copyright') OR starts_with(l, 'Last updated:') OR starts_with(l, 'Author(s):') OR starts_with(l, 'This work is licensed under') THEN NULL ELSE l END AS l FROM f)
SELECT doc_id, 'Page ' || doc_id || chr(10) || 'Overview' || chr(10) || '- item' || CASE WHEN l IS NULL THEN '' ELSE chr(10) || l END || CASE WHEN l = '' THEN '' ELSE chr(10) END || chr(10) || 'end' AS text,
  CASE WHEN l IS NULL OR l = '' OR starts_with(l, '-') OR starts_with(l, '/*') OR starts_with(l, '|') OR starts_with(l, '\\') OR l = 'Page ' || doc_id OR l IN ('Overview', 'Usage', 'Further information', 'Input requirements', 'Boundary conditions') THEN 'end' ELSE substr(l, 1, 200) END AS synopsis FROM g"""


def _outline(spark, sf_dir):
    from .metadata_queries import papers

    return x.outline(papers(spark, sf_dir)).where("level = 2 and title like 'Run%'").select("paper_id", "line", F.array_join("preview", "|").alias("preview")).where("preview like '## Running|## Running|%'").select("paper_id", "line")


QUERIES = {
    "doi_clean": (_of(lambda: t.clean_doi(_one_of(*DOIS))), _sql(f"lower(trim(regexp_replace(trim({_one_of_sql(*DOIS)}), '(?i)^https?://(dx\\.)?doi\\.org/', '')))")),
    "arxiv_of_doi": (_of(lambda: t.arxiv_of_doi(_one_of(*DOIS))), _sql(f"regexp_extract(lower({_one_of_sql(*DOIS)}), '^10\\.48550/arxiv\\.(.+)$', 1)")),
    "arxiv_reference": (_of(lambda: t.arxiv_key(_one_of(*REFS))), _sql(_one_of_sql("2401.{d}", "hep-th/99{d}", "2001.{d}", "", "1234.{d}"))),
    "author_flip": (_of(lambda: t.flipped_name(_one_of(*NAMES))), _sql("trim(" + _one_of_sql("Milton van Dyke{w}", "Jane {w}x", "Wang Wei{w}", "Plato{w}") + ")")),
    "year_of_date": (_of(lambda: t.year_of(F.concat(_first_line(), F.lit(" "), _one_of(*DATES)))), _sql(f"regexp_extract({FIRST} || ' ' || {_one_of_sql(*DATES)}, '\\b(1[89]\\d{{2}}|20\\d{{2}})\\b', 1)")),
    "endnote_type": (_of(lambda: _types()[0](_one_of(*ENDNOTE))), _sql(_one_of_sql("journal-article", "book-chapter", "web-page", "", "conference-paper"))),
    "zotero_type": (_of(lambda: _types()[1](_one_of(*ZOTERO))), _sql(_one_of_sql("journal-article", "book-chapter", "webpage", "", "preprint"))),
    "slug": (_of(lambda: t.slug(_first_line())), _sql(f"trim(regexp_replace(lower(trim({FIRST})), '[^a-z0-9]+', '-', 'g'), '-')")),
    "title_key": (_of(lambda: t.title_key(_first_line())), _sql(f"trim(regexp_replace(lower({FIRST}), '\\s+', ' ', 'g'))")),
    "match_key": (_of(lambda: t.match_key(_first_line())), _sql(f"regexp_replace(trim(regexp_replace(lower({FIRST}), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+', '', 'g')")),
    "clean_title": (_of(lambda: t.clean_title(F.concat(_first_line(), F.lit(r" <sub>2</sub> $x^2$ \alpha{beta} (end)")))), _sql(f"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({FIRST} || ' <sub>2</sub> $x^2$ \\alpha{{beta}} (end)', '<[^>]+>', '', 'g'), '\\$[^$]*\\$', '', 'g'), '\\\\[a-zA-Z]+(\\{{([^}}]*)\\}})?', '\\2', 'g'), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s-]', ' ', 'g'), '\\s+', ' ', 'g'))""")),
    "plain_markdown": (_of(lambda: t.plain_markdown(_one_of(*MARKS))), _sql(_one_of_sql("bold{w} and it", "code {w} text tail", "under{w} img{d}", "plain {w}"))),
    "language_code": (_of(lambda: t.is_language_code(_one_of(*CODES))), _sql(f"regexp_matches({_one_of_sql(*CODES)}, '^[a-z]{{2,5}}$')")),
    "tag_split": (_of(lambda: F.array_join(t.split_tags(F.concat("lang", F.lit(" , "), "source", F.lit(",, x "))), "|")), _sql("lang || '|' || source || '|x'")),
    "abstract_clean": (_of(lambda: x.clean_abstract(F.regexp_replace("text", "[!©(\\\\]", ""))), _sql("CASE WHEN length(trim(regexp_replace(regexp_replace(text, '[!©(\\\\]', '', 'g'), '\\s+', ' ', 'g'))) BETWEEN 50 AND 5000 THEN trim(regexp_replace(regexp_replace(text, '[!©(\\\\]', '', 'g'), '\\s+', ' ', 'g')) END")),
    "similar_title": (_similar, SIMILAR),
    "workspace_show": (_shown, SHOWN),
    "workspace_rename": (_renamed, "SELECT CASE o_orderkey % 3 WHEN 1 THEN 'moved' ELSE 'ws' || (o_orderkey % 3) END AS ws, count(*) AS n FROM orders WHERE o_orderkey % 5 = 0 GROUP BY 1"),
    "tool_list": (_listed, LISTED),
    "tool_version_pin": (lambda s, p: d.pinned_pages(_tool_rows(s, p), _pinned(s)), "SELECT (['qe', 'lammps', 'gromacs'])[CAST(o_orderkey % 3 + 1 AS INT)] AS tool, 'v' || (o_orderkey % 4) AS version, 'page' || o_orderkey AS page_name FROM orders WHERE o_orderkey % 3 > 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 4 = 1)"),
    "page_coverage": (_coverage, COVERAGE),
    "html_main": (_main, MAIN),
    "html_anchor_fragment": (_fragment, FRAGMENT),
    "page_text_clean": (_page_text, PAGE_TEXT),
}


def _types():
    from ..sources.records import endnote_type, zotero_type

    return endnote_type, zotero_type
