"""Metadata out of Markdown, kinds of documents, lookup, writes and the review queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as x
from ..operators import metadata as m
from .bridge import LIB, lib, registry, stored_grams, table, title_words_sql

#: Lines that papers have in different forms, by the remainder of their number.
DOI_LINES = ["See https://doi.org/10.5555/{i}.", "DOI: 10.5281/{i}\n[DOI: 10.7777/{i}]", "10.8888/{i}", "no identifier here", "doi：10.9999/{i};", "DOI: 10.1234/\n{i}"]
YEAR_LINES = ["© {y} The authors", "Received 3 May {y}; in revised form", "Phys. Rev. E, Vol. 12, 3 ({y})", "published online 3 March {y}", "Annual Review of Fluid Mechanics {y}", "Copyright 1234. Int. J. Multiphase Flow", "J. Fluid Mech. {y}. 12 (3) 44"]
ARXIV_LINES = ["arXiv:2401.{i5}v2", "https://arxiv.org/abs/hep-th/{i7}", "nothing", "https://arxiv.org/pdf/2001.{i5}"]


def _filled(line: str) -> F.Column:
    i = F.col("doc_id")
    out = F.lit(line)
    for mark, value in (("{i5}", F.lpad((i % 100_000).cast("string"), 5, "0")), ("{i7}", F.lpad(i.cast("string"), 7, "0")), ("{i}", i.cast("string")), ("{y}", (1990 + i % 35).cast("string"))):
        out = F.replace(out, F.lit(mark), value)
    return out


def _filled_sql(line: str) -> str:
    out = "'" + line.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    out = f"({out})"
    for mark, value in (("{i5}", "lpad(CAST(doc_id % 100000 AS VARCHAR), 5, '0')"), ("{i7}", "lpad(CAST(doc_id AS VARCHAR), 7, '0')"), ("{i}", "CAST(doc_id AS VARCHAR)"), ("{y}", "CAST(1990 + doc_id % 35 AS VARCHAR)")):
        out = f"replace({out}, '{mark}', {value})"
    return out


def _one_of(lines: list[str]) -> F.Column:
    return F.element_at(F.array(*[_filled(x) for x in lines]), (F.col("doc_id") % len(lines) + 1).cast("int"))


def _one_of_sql(lines: list[str]) -> str:
    return f"CASE doc_id % {len(lines)} " + " ".join(f"WHEN {k} THEN {_filled_sql(x)}" for k, x in enumerate(lines)) + " END"


def papers(spark, sf_dir):
    """Whole documents as papers in Markdown: front lines, the text, references."""
    i = F.col("doc_id")
    nl = F.lit("\n")
    said = F.concat(F.lit("\n## 1 Introduction\n\nAs Smith ("), (1990 + i % 30).cast("string"), F.lit(") says (Wang et al., "), (1995 + i % 20).cast("string"), F.lit("; Ray & Lee, 2001).\n\n### 1.1 Parts\n\n## Running\n\n## Running\n\n## Running\n\n"))
    names = F.concat(F.lit("Ada X"), F.translate(F.lower(F.col("source")), "0123456789", "abcdefghij"), F.lit(", Carl D. Young<sup>1</sup> and Eve Stone*"))
    rows = lib(spark, sf_dir).select("paper_id", "doc_id", "title", F.col("journal").alias("source"), "year_text").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), names, F.lit("\n\n"), _one_of(DOI_LINES), nl, _one_of(YEAR_LINES), nl, _one_of(ARXIV_LINES), nl, said, F.coalesce("text", F.lit("")), F.lit("\n\n## References\n"))
    return rows.select("paper_id", "doc_id", "title", "source", "year_text", text.alias("md_text"))


MD = f"""{LIB}, md AS (
  SELECT paper_id, doc_id, title, journal AS source, year_text, '# ' || title || chr(10) || chr(10) || 'Ada X' || translate(lower(journal), '0123456789', 'abcdefghij') || ', Carl D. Young<sup>1</sup> and Eve Stone*' || chr(10) || chr(10) || {_one_of_sql(DOI_LINES)} || chr(10) || {_one_of_sql(YEAR_LINES)} || chr(10) || {_one_of_sql(ARXIV_LINES)} || chr(10)
    || chr(10) || '## 1 Introduction' || chr(10) || chr(10) || 'As Smith (' || (1990 + doc_id % 30) || ') says (Wang et al., ' || (1995 + doc_id % 20) || '; Ray & Lee, 2001).' || chr(10) || chr(10) || '### 1.1 Parts' || chr(10) || chr(10)
    || repeat('## Running' || chr(10) || chr(10), 3) || coalesce(text, '') || chr(10) || chr(10) || '## References' || chr(10) AS md_text
  FROM (SELECT lib.*, documents.text FROM lib JOIN documents USING (doc_id)))"""


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _first(text: str, pattern: str) -> str:
    return f"nullif(regexp_extract({text}, {quoted(pattern)}, 1), '')"


def _head(n: int) -> str:
    return f"array_to_string(string_split(md_text, chr(10))[1:{n}], chr(10))"


def _doi_cases() -> str:
    tries = [f"regexp_replace({_first('h', p)}, '[.;,]+$', '')" for p in x.DOI_PATTERNS]
    own = lambda d: " AND ".join(f"NOT starts_with({d}, '{p}')" for p in x.DATA_PREFIXES)
    return "coalesce(" + ", ".join(f"CASE WHEN {own(d)} THEN {d} END" for d in tries) + ", '')"


def _year_cases() -> str:
    tries = [f"TRY_CAST({_first('h60', p)} AS INT)" for p in x.YEAR_PATTERNS]
    return "coalesce(" + ", ".join(f"CASE WHEN {y} BETWEEN 1950 AND 2030 THEN {y} END" for y in tries) + ")"


def _journal_cases() -> str:
    return "coalesce(" + ", ".join(f"trim({_first('h60', p)})" for p in x.JOURNAL_PATTERNS) + ", '')"


#: The head of each paper: 80 lines with split identifiers joined, and 60 lines.
FRONT = f"{MD}, t AS (SELECT *, regexp_replace({_head(80)}, '(10\\.\\d{{4,}}[./])\\n\\s*', '\\1', 'g') AS h, {_head(60)} AS h60 FROM md)"


MENTIONS = f"""{MD}, narr AS (SELECT paper_id, unnest(regexp_extract_all(md_text, {quoted(x.NARRATIVE)}, 1)) AS author, unnest(regexp_extract_all(md_text, {quoted(x.NARRATIVE)}, 2)) AS year FROM md),
grp AS (SELECT paper_id, unnest(regexp_extract_all(md_text, {quoted(x.GROUP)}, 1)) AS g FROM md),
ins AS (SELECT paper_id, unnest(regexp_extract_all(g, {quoted(x.INSIDE)}, 1)) AS author, unnest(regexp_extract_all(g, {quoted(x.INSIDE)}, 2)) AS year FROM grp),
ment AS (SELECT DISTINCT paper_id, regexp_replace(author, '\\s+', ' ', 'g') AS author, year FROM (SELECT * FROM narr UNION ALL SELECT * FROM ins))"""


def _mentions(spark, sf_dir):
    return x.citation_mentions(papers(spark, sf_dir), "paper_id", "md_text").select("paper_id", "author", "year")


def _people(spark, sf_dir):
    who = F.when(F.col("doc_id") % 40 == 0, "Jane Smithson, Wei Wang").when(F.col("doc_id") % 40 == 1, "Wei Wang").otherwise("Ada Other")
    return lib(spark, sf_dir).select("paper_id", "year_text", who.alias("authors"))


def _status(spark, sf_dir):
    return x.citation_status(_mentions(spark, sf_dir), stored_grams(spark, sf_dir, "people", lambda: x.author_index(_people(spark, sf_dir))))


STATUS = f"""WITH {MENTIONS}, asked AS (SELECT DISTINCT author, year, lower(trim(regexp_extract(regexp_replace(author, '\\s+et\\s+al\\.?', '', 'g'), '^(.*?)(?:\\s+(?:and|&|et)\\s+.*)?$', 1))) AS s FROM ment),
people AS (SELECT paper_id, year_text, CASE doc_id % 40 WHEN 0 THEN 'jane smithson, wei wang' WHEN 1 THEN 'wei wang' ELSE 'ada other' END AS who FROM lib),
c AS (SELECT asked.author, asked.year, count(paper_id) AS n FROM asked LEFT JOIN people ON year_text = asked.year AND contains(who, s) GROUP BY 1, 2)
SELECT author, year, n, CASE n WHEN 0 THEN 'NOT_IN_LIBRARY' WHEN 1 THEN 'VERIFIED' ELSE 'AMBIGUOUS' END AS status FROM c"""

HEADS = f"""{MD}, ln AS (SELECT paper_id, unnest(string_split(md_text, chr(10))) AS raw, unnest(range(1, len(string_split(md_text, chr(10))) + 1)) AS line FROM md),
heads AS (SELECT paper_id, CAST(line AS INT) AS line, CAST(length(regexp_extract(raw, '^(#{{1,4}})\\s', 1)) AS INT) AS level, trim(regexp_extract(raw, '^#{{1,4}}\\s+(.*)$', 1)) AS title FROM ln WHERE regexp_matches(raw, '^#{{1,4}}\\s+\\S'))"""

#: Headings of a kind of document each, after the heading of its title.
OUTLINES = [
    ["# Contents"] + [f"# {n}.{m} Part of it . {n}{m}" for n in (1, 2) for m in (1, 2, 3)] + ["# Preface to the second edition", "# Chapter 1 On {t}", "## 1.1 Setup", "# Chapter 2", "### 2.1.4.2 Deep", "# Appendix A"],
    ["# ARTICLE", "# Journal of It", "# 1. Introduction", "# Journal of It", "## 1.1 Aims 2021", "# Unnumbered", "# Journal of It", "# References, notes"],
    ["# 第一章 绪论", "## 1.1流体", "# 目录", "# 参考文献", "# Index"],
    ["# Some words", "# Summary", "# 3 Results.", "# Acknowledgments"],
]


def _outlines(spark, sf_dir):
    i = F.col("doc_id")
    lines = F.element_at(F.array(*[F.lit("\n\ntext\n".join(x)) for x in OUTLINES]), (i % len(OUTLINES) + 1).cast("int"))
    text = F.concat(F.lit("# "), "title", F.lit("\n\n"), F.replace(lines, F.lit("{t}"), F.concat(F.lit("it, "), "journal")), F.lit("\n\n"), F.coalesce("md_text", F.lit("")))
    return lib(spark, sf_dir).select("paper_id", "title", text.alias("md_text"))


SECTIONS = ", ".join(quoted(s) for s in x.KNOWN_SECTIONS)
_LINES = " || chr(10) || chr(10) || 'text' || chr(10) || "
TOC = f"""WITH {LIB}, md AS (SELECT paper_id, lower(trim(title)) AS t, '# ' || title || chr(10) || chr(10) || replace(CASE doc_id % {len(OUTLINES)} {" ".join(f"WHEN {k} THEN {_LINES.join(quoted(v) for v in o)}" for k, o in enumerate(OUTLINES))} END, '{{t}}', 'it, ' || journal)
  || chr(10) || chr(10) || coalesce(md_text, '') AS md_text FROM lib),
ln AS (SELECT paper_id, t, unnest(string_split(md_text, chr(10))) AS raw, unnest(range(1, len(string_split(md_text, chr(10))) + 1)) AS line FROM md),
h AS (SELECT paper_id, t, CAST(line AS INT) AS line, trim(regexp_extract(raw, '^#{{1,4}}\\s+(.*)$', 1)) AS x, lower(trim(regexp_extract(raw, '^#{{1,4}}\\s+(.*)$', 1))) AS low FROM ln WHERE regexp_matches(raw, '^#{{1,4}}\\s+\\S')),
p AS (SELECT *, max(line) OVER (PARTITION BY paper_id) AS last FROM h),
q AS (SELECT *, CASE WHEN count(*) FILTER (WHERE line <= greatest(last * 0.1e0, 500) AND regexp_matches(x, '[.\\s]\\s*\\d{{2,4}}\\s*$')) OVER (PARTITION BY paper_id) >= 5
  THEN max(CASE WHEN line <= greatest(last * 0.1e0, 500) AND regexp_matches(x, '[.\\s]\\s*\\d{{2,4}}\\s*$') THEN line END) OVER (PARTITION BY paper_id) ELSE 0 END AS area,
  regexp_extract(x, '^(\\d+(?:\\.\\d+)*)\\.?(?:\\s|[\\x{{4e00}}-\\x{{9fff}}])', 1) AS num, regexp_extract(x, '(?i)^Chapter\\s+(\\d+)\\b', 1) AS ch, regexp_extract(x, '^第\\s*([一二三四五六七八九十百\\d]+)\\s*章', 1) AS zh FROM p),
s AS (SELECT *, min(CASE WHEN line > area AND (ch <> '' OR zh <> '' OR split_part(num, '.', 1) = '1' OR regexp_replace(trim(split_part(low, ' to ', 1)), 's+$', '') IN ('preface', 'foreword', 'notation', 'symbol', 'acknowledgment', 'acknowledgement')
  OR starts_with(low, 'preface') OR low IN ('摘要', '前言', '序言', '绪论')) THEN line END) OVER (PARTITION BY paper_id) AS st FROM q),
b AS (SELECT *, count(*) OVER (PARTITION BY paper_id, low) AS same, list_distinct(regexp_split_to_array(low, '\\s+')) AS lw, list_distinct(regexp_split_to_array(t, '\\s+')) AS tw FROM s WHERE line >= coalesce(st, CASE WHEN last > area THEN area + 1 END, 0)),
k AS (SELECT * FROM b WHERE same < 3 AND NOT (t <> '' AND (contains(t, low) OR contains(low, t) OR len(list_intersect(lw, tw)) > 0.8e0 * greatest(len(lw), len(tw)))) AND low NOT IN ({", ".join(quoted(w) for w in x.NO_SECTIONS)}))
SELECT paper_id, line, CAST(CASE WHEN ch <> '' OR zh <> '' OR num = '' THEN 1 ELSE least(len(string_split(num, '.')), 3) END AS INT) AS level,
  CASE WHEN ch <> '' THEN CASE WHEN trim(regexp_replace(x, '(?i)^Chapter\\s+(\\d+)\\b', '')) <> '' THEN ch || ' ' || trim(regexp_replace(x, '(?i)^Chapter\\s+(\\d+)\\b', '')) ELSE 'Chapter ' || ch END WHEN zh <> '' THEN x
    WHEN num <> '' THEN regexp_replace(trim(regexp_replace(x, '[.\\s]\\s*\\d{{2,4}}\\s*$', '')), '\\.+$', '') ELSE x END AS title
FROM k WHERE ch <> '' OR zh <> '' OR num <> '' OR trim(split_part(low, ',', 1)) IN ({SECTIONS}) OR starts_with(low, 'appendix') OR x IN ({", ".join(quoted(w) for w in x.KNOWN_CHINESE)})"""


def _kinds(spark, sf_dir):
    i = F.col("doc_id")
    rows = papers(spark, sf_dir)
    title = F.concat(F.element_at(F.array(*[F.lit(w) for w in ("A Utility Model of ", "PhD Thesis on ", "Handbook of ", "专利 ", "", "", "")]), (i % 7 + 1).cast("int")), "title")
    kind = F.when(i % 11 == 0, "Monograph").when(i % 13 == 0, "patent").otherwise("journal-article")
    number = F.when(i % 17 == 0, "US1234567B2").otherwise("")
    text = F.concat("md_text", F.when(i % 19 == 0, F.lit(" see WO2020123456A1")).otherwise(""))
    return rows.select("paper_id", m.document_kind(title, kind, number, text).alias("kind"))


def _any_sql(words: list[str]) -> str:
    return " OR ".join(f"contains(low, {quoted(w)})" for w in words)


KINDS = f"""WITH {MD}, t AS (SELECT paper_id, doc_id, lower((['A Utility Model of ', 'PhD Thesis on ', 'Handbook of ', '专利 ', '', '', ''])[CAST(doc_id % 7 + 1 AS INT)] || title) AS low, md_text || CASE WHEN doc_id % 19 = 0 THEN ' see WO2020123456A1' ELSE '' END AS body FROM md)
SELECT paper_id, CASE WHEN doc_id % 17 = 0 OR (doc_id % 13 = 0 AND doc_id % 11 <> 0) OR {_any_sql(m.PATENT_WORDS)} OR regexp_matches(substr(body, 1, 10000), {quoted(x.PATENT)}) THEN 'patent'
  WHEN {_any_sql(m.THESIS_WORDS)} THEN 'thesis' WHEN doc_id % 11 = 0 OR {_any_sql(m.BOOK_WORDS)} THEN 'book' ELSE '' END AS kind FROM t"""


def _file_names(spark, sf_dir):
    i = F.col("doc_id")
    stem = F.when(i % 3 == 0, F.concat(F.lit("MinerU_markdown_Van-Dyke-"), (1990 + i % 30).cast("string"), F.lit("-On_"), "source", F.lit("_1234567890"))).when(i % 3 == 1, F.concat(F.lit("MinerU_markdown_lee-kim-"), (1990 + i % 30).cast("string"), F.lit("-a-study_of-"), "source", F.lit("_1234567890"))).otherwise(F.concat("source", F.lit("-plain")))
    return table(spark, sf_dir, "documents").select("doc_id", m.of_file_name(stem).alias("n")).select("doc_id", "n.*")


FILE_NAMES = """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'Van Dyke' WHEN 1 THEN 'lee kim' ELSE '' END AS first_author, CASE doc_id % 3 WHEN 0 THEN 'Dyke' WHEN 1 THEN 'kim' ELSE '' END AS last_name,
  CASE WHEN doc_id % 3 < 2 THEN CAST(1990 + doc_id % 30 AS INT) END AS year, CASE doc_id % 3 WHEN 0 THEN 'On ' || replace(source, '_', ' ') WHEN 1 THEN 'a-study of-' || replace(source, '_', ' ') ELSE '' END AS title FROM documents"""


def _records(spark, sf_dir):
    rows = papers(spark, sf_dir).where("trim(title) <> ''")
    return m.records_of_markdown(rows.select(F.col("paper_id").alias("stem"), "md_text")).select("stem", F.array_join("authors", ";").alias("authors"), "first_author", "first_author_lastname", "doi", "year", "journal")


RECORDS = f"""WITH {FRONT} SELECT paper_id AS stem, 'Ada X' || translate(lower(source), '0123456789', 'abcdefghij') || ';Carl D. Young;Eve Stone' AS authors, 'Ada X' || translate(lower(source), '0123456789', 'abcdefghij') AS first_author, 'X' || translate(lower(source), '0123456789', 'abcdefghij') AS first_author_lastname,
  {_doi_cases()} AS doi, {_year_cases()} AS year, {_journal_cases()} AS journal FROM t WHERE trim(title) <> ''"""


def _abstracts(spark, sf_dir):
    """Every second paper has an abstract under a heading, every other after a label."""
    i = F.col("doc_id")
    body = F.concat(F.lit("We study "), F.regexp_replace("title", "[#!$©]", ""), F.lit(" and find that much of it holds under all conditions tried here."))
    text = F.concat(F.lit("# T\n\n"), F.when(i % 2 == 0, F.concat(F.lit("## A b s t r a c t\n\n"), body)).otherwise(F.concat(F.lit("Abstract. "), body)), F.lit("\n\n## 1 Introduction\n\nx"))
    return lib(spark, sf_dir).select("paper_id", x.abstract_of_markdown(text).alias("abstract"))


ABSTRACTS = f"""WITH {LIB}, t AS (SELECT paper_id, trim(regexp_replace('We study ' || regexp_replace(title, '[#!$©]', '', 'g') || ' and find that much of it holds under all conditions tried here.', '\\s+', ' ', 'g')) AS a FROM lib)
SELECT paper_id, CASE WHEN length(a) BETWEEN 50 AND 5000 THEN a END AS abstract FROM t"""


def _documents(spark, sf_dir):
    i = F.col("doc_id")
    rows = papers(spark, sf_dir).select(F.concat(F.lit("a-b_"), "paper_id").alias("stem"), F.when(i % 3 == 0, F.col("title")).otherwise("").alias("title"), F.lit("").alias("abstract"), F.when(i % 4 == 0, "manual").otherwise("").alias("paper_type"), "md_text")
    return m.as_documents(rows).select("stem", F.md5("title").alias("title"), F.md5("abstract").alias("abstract"), "paper_type")


DOCUMENTS = f"""WITH {MD}, t AS (SELECT 'a-b_' || paper_id AS stem, doc_id, title, trim(regexp_extract(md_text, '(?m)^\\s*#\\s+(.*)$', 1)) AS h, array_to_string([w FOR w IN regexp_split_to_array(md_text, '\\s+') IF w <> ''][1:500], ' ') AS a FROM md)
SELECT stem, md5(CASE WHEN doc_id % 3 = 0 AND trim(title) <> '' THEN title WHEN h <> '' THEN h ELSE replace(replace(stem, '-', ' '), '_', ' ') END) AS title, md5(a) AS abstract, CASE WHEN doc_id % 4 = 0 THEN 'manual' ELSE 'document' END AS paper_type FROM t"""


def _tiers(spark, sf_dir):
    """Records of the documents against a catalogue that knows most of them,
    under titles with a word lost, words added, marks dropped, or all alike but
    for one word."""
    i = F.col("doc_id")
    rows = lib(spark, sf_dir).select("paper_id", i, F.col("title").alias("t"), "journal", (2000 + i % 25).cast("int").alias("y"))
    pattern = lambda k: F.concat(F.lit("on the flow of sample "), k.cast("string"), F.lit(" in pipes and channels with heat"))
    title = F.when(i % 4 == 3, pattern(i)).otherwise(F.col("t"))
    local = rows.select(
        "paper_id", title.alias("title"), F.when(i % 3 == 0, F.concat(F.lit("10.1/"), i.cast("string"))).otherwise("").alias("doi"), F.when(i % 9 == 1, F.concat(F.lit("2001."), i.cast("string"))).otherwise("").alias("arxiv_id"),
        F.when(i % 10 != 0, F.col("y")).alias("year"), F.when(i % 7 != 0, F.col("journal")).otherwise("").alias("last_name"),
    )
    edited = F.when(i % 5 == 0, F.concat(title, F.lit(" and more words here"))).when(i % 5 == 1, F.regexp_replace(title, r"^\S+ ", "")).when(i % 5 == 2, F.regexp_replace(title, "[.,']", "")).when(i % 15 == 3, F.lit("wholly different")).otherwise(title)
    catalogue = rows.where(i % 8 != 7).select(
        F.concat(F.lit("c"), F.lpad(i.cast("string"), 9, "0")).alias("catalogue_id"), edited.alias("title"), F.concat(F.lit("https://doi.org/10.1/"), i.cast("string")).alias("doi"), F.concat(F.lit("2001."), i.cast("string")).alias("arxiv_id"),
        F.when(i % 4 == 0, F.col("y") + 3).otherwise(F.col("y")).alias("year"), F.when(i % 6 == 0, F.lit("other")).otherwise(F.upper("journal")).alias("last_name"),
    )
    return m.looked_up(local, catalogue).select("paper_id", "method", "catalogue_id", F.round("similarity", 9).alias("similarity"))


TIERS = f"""WITH {LIB}, r AS (SELECT paper_id, doc_id AS i, journal, CAST(2000 + doc_id % 25 AS INT) AS y, CASE WHEN doc_id % 4 = 3 THEN 'on the flow of sample ' || doc_id || ' in pipes and channels with heat' ELSE title END AS title FROM lib),
l AS (SELECT *, {title_words_sql('title')} AS ws, CASE WHEN i % 10 <> 0 THEN y END AS year, CASE WHEN i % 7 <> 0 THEN lower(trim(journal)) ELSE '' END AS name FROM r),
e AS (SELECT *, CASE WHEN i % 5 = 0 THEN title || ' and more words here' WHEN i % 5 = 1 THEN regexp_replace(title, '^\\S+ ', '') WHEN i % 5 = 2 THEN regexp_replace(title, '[.,'']', '', 'g') WHEN i % 15 = 3 THEN 'wholly different' ELSE title END AS ct FROM r WHERE i % 8 <> 7),
c AS (SELECT 'c' || lpad(CAST(i AS VARCHAR), 9, '0') AS catalogue_id, i AS j, ct, {title_words_sql('ct')} AS cs, CASE WHEN i % 4 = 0 THEN y + 3 ELSE y END AS cy, CASE WHEN i % 6 = 0 THEN 'other' ELSE lower(trim(journal)) END AS cn FROM e),
lw AS (SELECT paper_id, unnest(ws) AS w FROM l), cw AS (SELECT catalogue_id, unnest(cs) AS w FROM c),
shared AS (SELECT paper_id, catalogue_id, count(*) AS k FROM lw JOIN cw USING (w) GROUP BY ALL),
s AS (SELECT l.paper_id, i, j, c.catalogue_id, CASE WHEN trim(title) = '' OR trim(ct) = '' THEN 1 ELSE 0 END AS blank, CASE WHEN len(ws) > 0 AND len(cs) > 0 THEN 2.0e0 * k / (len(ws) + len(cs)) ELSE 0 END AS sim,
  name <> '' AND cn <> '' AND name <> cn AND abs(year - cy) > 2 AS barred FROM shared JOIN l USING (paper_id) JOIN c USING (catalogue_id)),
own AS (SELECT l.paper_id, i, catalogue_id, coalesce(CASE WHEN trim(title) = '' OR trim(ct) = '' THEN 1.0e0 END, (SELECT max(sim) FROM s WHERE s.paper_id = l.paper_id AND s.catalogue_id = c.catalogue_id), 0) AS sim FROM l JOIN c ON i = j),
hits AS (SELECT paper_id, 1 AS tier, 'doi_lookup' AS method, catalogue_id, sim FROM own WHERE i % 3 = 0 AND sim >= 0.65
  UNION ALL SELECT paper_id, 2, 'arxiv_lookup', catalogue_id, sim FROM own WHERE i % 9 = 1
  UNION ALL SELECT paper_id, 3, CASE WHEN sim >= 0.85 THEN 'title_search' ELSE 'title_search_relaxed' END, catalogue_id, sim FROM s WHERE sim >= 0.65 AND barred IS NOT TRUE),
best AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY paper_id ORDER BY tier, sim DESC, catalogue_id) = 1)
SELECT l.paper_id, coalesce(method, 'local_only') AS method, catalogue_id, round(sim, 9) AS similarity FROM l LEFT JOIN best USING (paper_id)"""


def _patents(spark, sf_dir):
    i = F.col("doc_id")
    text = F.concat("md_text", F.when(i % 4 < 2, F.concat(F.lit(" as in cn"), (1_000_000 + i).cast("string"), F.lit("a "))).otherwise(""))
    head = F.concat(F.when(i % 4 < 2, F.concat(F.lit("cn"), (1_000_000 + i).cast("string"), F.lit("A as in \n"))).otherwise(""), text)
    rows = papers(spark, sf_dir).select("paper_id", F.when(i % 5 == 0, "US7654321B2").otherwise("").alias("publication_number"), F.when(i % 3 == 0, "10.1/x").otherwise("").alias("doi"), F.when(i % 7 == 0, "thesis").when(i % 7 == 1, "article").otherwise(F.lit(None)).alias("paper_type"), head.alias("md_text"))
    return m.with_patents(rows).drop("md_text")


PATENTS = f"""WITH {MD}, n AS (SELECT paper_id, doc_id AS i, CASE WHEN doc_id % 5 = 0 THEN 'US7654321B2' WHEN doc_id % 4 < 2 THEN 'CN' || (1000000 + doc_id) || 'A' ELSE upper(regexp_extract(substr(md_text, 1, 10000), {quoted(x.PATENT)}, 1)) END AS n FROM md)
SELECT paper_id, n AS publication_number, CASE WHEN i % 3 = 0 THEN '10.1/x' ELSE '' END AS doi, CASE WHEN n <> '' AND i % 3 > 0 AND i % 7 > 0 THEN 'patent' WHEN i % 7 = 0 THEN 'thesis' WHEN i % 7 = 1 THEN 'article' END AS paper_type FROM n"""


def _updates(spark, sf_dir):
    rows = lib(spark, sf_dir).select("paper_id", "doc_id", "journal", "year_text", "paper_type")
    i = F.col("doc_id")
    new = rows.where(i % 2 == 0).select("paper_id", F.when(i % 3 == 0, F.lit("New J")).otherwise("").alias("journal"), F.when(i % 5 == 0, F.lit("1999")).otherwise(F.col("year_text")).alias("year_text"))
    return m.updated(rows.drop("doc_id"), new, ["journal", "year_text"]).select("paper_id", "journal", "year_text", F.array_join("changed", ",").alias("changed"))


UPDATES = f"""WITH {LIB}, n AS (SELECT paper_id, journal, year_text, CASE WHEN doc_id % 2 = 0 AND doc_id % 3 = 0 THEN 'New J' ELSE journal END AS j, CASE WHEN doc_id % 2 = 0 AND doc_id % 5 = 0 THEN '1999' ELSE year_text END AS y FROM lib)
SELECT paper_id, j AS journal, y AS year_text, array_to_string([c FOR c IN [CASE WHEN j <> journal THEN 'journal' END, CASE WHEN y <> year_text THEN 'year_text' END] IF c IS NOT NULL], ',') AS changed FROM n"""


def _refetched(spark, sf_dir):
    rows = lib(spark, sf_dir)
    i = F.col("doc_id")
    text = lambda x: F.lit(x)
    ids = lambda doi: F.create_map(text("doi"), doi)
    old = rows.select("paper_id", i, "title", "authors", "journal", F.lit("").alias("volume"), F.when(i % 2 == 0, F.create_map(text("crossref"), F.lit(3))).alias("citation_count"), ids(F.col("doi")).alias("ids"), F.array(text("crossref")).alias("api_sources"), F.lit("kept").alias("toc"))
    sources = F.when(i % 3 == 0, F.array().cast("array<string>")).when(i % 3 == 1, F.array(text("arxiv"))).otherwise(F.array(text("crossref"), text("openalex")))
    new = rows.where(i % 6 < 5).select(
        "paper_id", F.when(i % 4 == 0, F.concat("title", text(" (corrected)"))).otherwise("").alias("title"), F.when(i % 5 == 0, F.array(text("New Name"))).alias("authors"), F.lit(None).cast("string").alias("journal"), F.when(i % 7 == 0, "12").alias("volume"),
        F.create_map(text("crossref"), F.lit(9)).alias("citation_count"), F.map_concat(ids(F.col("doi")), F.when(i % 8 == 0, F.create_map(text("doi_url"), text("other"))).otherwise(F.create_map(text("doi_url"), F.concat(text("https://doi.org/"), "doi")))).alias("ids"), sources.alias("api_sources"),
    )
    return m.refetched(old.drop("doc_id"), new).select("paper_id", F.md5("title").alias("title"), F.array_join("authors", ";").alias("authors"), "volume", F.col("citation_count")["crossref"].alias("cited"), F.array_join("api_sources", ";").alias("sources"), F.array_join("changed", ",").alias("changed"))


REFETCHED = f"""WITH {LIB}, r AS (SELECT *, doc_id AS i, doc_id % 6 < 5 AS again FROM lib), s AS (SELECT *, again AND (i % 3 = 2 OR (i % 3 = 1 AND i % 2 = 1)) AS moved FROM r)
SELECT paper_id, md5(CASE WHEN again AND i % 4 = 0 THEN title || ' (corrected)' ELSE title END) AS title, CASE WHEN again AND i % 5 = 0 THEN 'New Name' ELSE array_to_string(authors, ';') END AS authors, CASE WHEN again AND i % 7 = 0 THEN '12' ELSE '' END AS volume,
  CAST(CASE WHEN moved THEN 9 WHEN i % 2 = 0 THEN 3 END AS INT) AS cited, CASE WHEN moved THEN CASE WHEN i % 3 = 1 THEN 'arxiv' ELSE 'crossref;openalex' END ELSE 'crossref' END AS sources,
  array_to_string([x FOR x IN [CASE WHEN again AND i % 4 = 0 THEN 'title' END, CASE WHEN again AND i % 5 = 0 THEN 'authors' END, CASE WHEN moved THEN 'citation_count' END, CASE WHEN again AND (i % 8 = 0 OR doi = '') THEN 'ids' END, CASE WHEN moved THEN 'api_sources' END, CASE WHEN again AND i % 7 = 0 THEN 'volume' END] IF x IS NOT NULL], ',') AS changed FROM s"""


def _collected(spark, sf_dir):
    reg = registry(spark, sf_dir)
    present = reg.where("id % 4 <> 0").select("id")
    edges = reg.select(F.col("id").alias("source_id"), (F.col("id") + 3).alias("target_id"))
    tags = reg.select(F.col("id").alias("paper_id"), F.lit("t").alias("tag"))
    hashes = reg.select(F.col("id").alias("paper_id"), F.md5("doi").alias("hash"))
    got = m.collected({"registry": (reg.select("id"), "id"), "citations": (edges, "source_id"), "paper_tags": (tags, "paper_id"), "papers_hash": (hashes, "paper_id"), "papers": (hashes.select("paper_id"), "paper_id")}, present)
    parts = [t.select(F.lit(n).alias("name"), F.lit(1).alias("one"), F.col("target_id").isNull().cast("int").alias("none") if "target_id" in t.columns else F.lit(0).alias("none")) for n, t in got.items()]
    every = parts[0]
    for p in parts[1:]:
        every = every.union(p)
    return every.groupBy("name").agg(F.sum("one").alias("n"), F.sum("none").alias("dangling"))


COLLECTED = """WITH r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0), p AS (SELECT id FROM r WHERE id % 4 <> 0),
n AS (SELECT count(*) AS n, sum(CASE WHEN (id + 3) NOT IN (SELECT id FROM p) THEN 1 ELSE 0 END) AS d FROM p)
SELECT name, CAST(n AS BIGINT) AS n, CAST(CASE WHEN name = 'citations' THEN d ELSE 0 END AS BIGINT) AS dangling FROM n, (VALUES ('registry'), ('citations'), ('paper_tags'), ('papers_hash'), ('papers')) v(name)"""


def _queue(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").where(i % 3 != 0).select(F.concat(F.lit("s"), i.cast("string")).alias("stem"), F.element_at(F.array(F.lit("no_doi"), F.lit("duplicate"), F.lit("no_pub_num")), (i % 4 % 3 + 1).cast("int")).alias("issue"))


def _resolved(spark, sf_dir):
    i = F.col("doc_id")
    answers = table(spark, sf_dir, "documents").where(i % 2 == 0).select(F.concat(F.lit("s"), i.cast("string")).alias("stem"), F.when(i % 5 == 0, F.concat(F.lit("10.3/"), i.cast("string"))).otherwise("").alias("doi"), F.when(i % 7 == 0, "thesis").otherwise("").alias("kind"))
    taken, left = m.resolved(_queue(spark, sf_dir), answers)
    return taken.select("stem", F.lit("in").alias("state")).union(left.select("stem", F.lit("waits").alias("state")))


def _backfill_rows(spark, sf_dir):
    """Abstracts of the texts' second lines: in the record, on its page, in its file."""
    i = F.col("doc_id")
    body = F.regexp_replace(F.concat(F.lit("A plain account of what was measured, with all of its limits: "), "title"), "[^A-Za-z:, ]", "")
    rows = lib(spark, sf_dir).select("paper_id", i, F.trim(F.regexp_replace(body, r"\s+", " ")).alias("b"))
    records = rows.select("paper_id", F.when(i % 3 == 0, "has one").when(i % 15 == 1, F.col("b")).otherwise(F.lit(None)).alias("abstract"), F.concat(F.lit("10.2/"), i.cast("string")).alias("doi"))
    texts = rows.select("paper_id", F.when(i % 7 == 0, F.lit(None)).when(i % 2 == 0, F.concat(F.lit("# T\n\n## Abstract\n\n"), "b", F.lit("\n\n## 1 Introduction\n"))).otherwise("# T\n").alias("md_text"))
    pages = rows.where(i % 5 < 2).select(F.concat(F.lit("https://doi.org/10.2/"), i.cast("string")).alias("doi"), F.concat(F.lit('<meta name="citation_abstract" content="'), "b", F.when(i % 10 == 0, F.lit(" (page)")).otherwise(""), F.lit('">')).alias("html"))
    return m.backfilled(records, texts, pages)


BACKFILLED = f"""{LIB}, t AS (SELECT paper_id, doc_id AS i, trim(regexp_replace(regexp_replace('A plain account of what was measured, with all of its limits: ' || title, '[^A-Za-z:, ]', '', 'g'), '\\s+', ' ', 'g')) AS b FROM lib),
s AS (SELECT paper_id, CASE WHEN i % 3 = 0 THEN 'has one' WHEN i % 15 = 1 THEN b END AS own, CASE WHEN i % 5 < 2 AND length(b || CASE WHEN i % 10 = 0 THEN ' (page)' ELSE '' END) <= 5000 THEN b || CASE WHEN i % 10 = 0 THEN ' (page)' ELSE '' END END AS p, i % 7 <> 0 AS file, CASE WHEN i % 2 = 0 AND length(b) <= 5000 THEN b END AS t FROM t),
o AS (SELECT paper_id, CASE WHEN p IS NOT NULL AND own IS NULL THEN 'filled' WHEN p IS NOT NULL AND p <> own THEN 'updated' WHEN p IS NOT NULL OR own IS NOT NULL OR NOT file THEN 'skipped' WHEN t IS NOT NULL THEN 'filled' ELSE 'failed' END AS outcome, p, t FROM s)"""
BACKFILL = f"WITH {BACKFILLED} SELECT paper_id, outcome, CASE WHEN outcome IN ('filled', 'updated') THEN coalesce(p, t) END AS abstract, CASE WHEN outcome IN ('filled', 'updated') THEN CASE WHEN p IS NOT NULL THEN 'page' ELSE 'text' END END AS source FROM o"

QUERIES = {
    "markdown_headers": (lambda s, d: x.markdown_headers(papers(s, d)).where("title <> ''"), f"WITH {HEADS} SELECT * FROM heads WHERE title <> ''"),
    "toc_levels": (lambda s, d: x.toc(_outlines(s, d)), TOC),
    "extract_doi": (lambda s, d: papers(s, d).select("paper_id", x.doi_of(F.col("md_text")).alias("doi")), f"WITH {FRONT} SELECT paper_id, {_doi_cases()} AS doi FROM t"),
    "extract_year": (lambda s, d: papers(s, d).select("paper_id", x.year_of_text(F.col("md_text")).alias("year")), f"WITH {FRONT} SELECT paper_id, {_year_cases()} AS year FROM t"),
    "extract_journal": (lambda s, d: papers(s, d).select("paper_id", x.journal_of_text(F.col("md_text")).alias("journal")), f"WITH {FRONT} SELECT paper_id, {_journal_cases()} AS journal FROM t"),
    "extract_arxiv_id": (lambda s, d: papers(s, d).select("paper_id", x.arxiv_of_text(F.col("md_text")).alias("arxiv_id")), f"WITH {FRONT} SELECT paper_id, coalesce({', '.join(_first('h', p) for p in x.ARXIV_PATTERNS)}, '') AS arxiv_id FROM t"),
    "extract_patent_number": (lambda s, d: papers(s, d).select("paper_id", x.patent_of(F.concat("md_text", F.lit(""))).alias("number")), f"WITH {MD} SELECT paper_id, upper(regexp_extract(substr(md_text, 1, 10000), {quoted(x.PATENT)}, 1)) AS number FROM md"),
    "extract_abstract": (_abstracts, ABSTRACTS),
    "record_of_markdown": (_records, RECORDS),
    "record_of_file_name": (_file_names, FILE_NAMES),
    "document_fallback": (_documents, DOCUMENTS),
    "document_kind": (_kinds, KINDS),
    "citation_mentions": (_mentions, f"WITH {MENTIONS} SELECT * FROM ment"),
    "citation_check_status": (_status, STATUS),
    "patent_records": (_patents, PATENTS),
    "merge_write": (_updates, UPDATES),
    "refetch_fields": (_refetched, REFETCHED),
    "abstract_backfill": (_backfill_rows, BACKFILL),
    "abstract_backfill_counts": (lambda s, d: m.backfill_counts(_backfill_rows(s, d)), f"WITH {BACKFILLED} SELECT count(*) FILTER (WHERE outcome = 'filled') AS filled, count(*) FILTER (WHERE outcome = 'updated') AS updated, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS failed FROM o"),
    "pending_summary": (lambda s, d: m.pending_summary(_queue(s, d)), "SELECT (['no_doi', 'duplicate', 'no_pub_num'])[CAST(doc_id % 4 % 3 + 1 AS INT)] AS issue, count(*) AS n FROM documents WHERE doc_id % 3 <> 0 GROUP BY 1"),
    "pending_resolve": (_resolved, "SELECT 's' || doc_id AS stem, CASE WHEN doc_id % 2 = 0 AND (doc_id % 5 = 0 OR doc_id % 7 = 0) THEN 'in' ELSE 'waits' END AS state FROM documents WHERE doc_id % 3 <> 0"),
    "index_collection": (_collected, COLLECTED),
    "lookup_tiers": (_tiers, TIERS),
}
