"""Reference lists and the option matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import export as e
from ..operators import extract as x
from .bridge import LIB, lib


def _some(spark, sf_dir):
    """Records with one to eight authors, and with volumes, pages and the like."""
    rows = lib(spark, sf_dir)
    i = F.col("doc_id")
    pages = F.when(i % 3 == 0, F.concat_ws("-", (i + 1).cast("string"), (i + 9).cast("string"))).when(i % 3 == 1, i.cast("string"))
    rows = rows.withColumns({"volume": (i % 40).cast("string"), "issue": F.when(i % 4 > 0, (i % 12).cast("string")), "pages": pages, "publisher": F.when(i % 2 == 0, "Press & Co_"), "issn": F.when(i % 5 == 0, "0022-1120"), "abstract": F.substring("abstract", 1, 300)})
    names = [F.lit("Carl D. Young"), F.lit("Eve Stone"), F.lit("Finn Hall"), F.lit("Gus P. Q. Reed"), F.lit("Hal Moss"), F.lit("Ida Frost")]
    return rows.withColumn("authors", F.slice(F.concat(F.array(F.lit("Ada Lake"), F.lit("Ben Mill")), F.array(*names)), 1, (F.col("doc_id") % 8 + 1).cast("int"))).withColumn("title", F.concat(F.lit("Study & Test "), F.col("doc_id").cast("string")))


BASE = f"""{LIB}, r AS (SELECT *, 'Study & Test ' || doc_id AS t, doc_id % 8 + 1 AS n, ['Ada Lake', 'Ben Mill', 'Carl D. Young', 'Eve Stone', 'Finn Hall', 'Gus P. Q. Reed', 'Hal Moss', 'Ida Frost'][1:doc_id % 8 + 1] AS au,
  ['Lake A', 'Mill B', 'Young CD', 'Stone E', 'Hall F', 'Reed GPQ', 'Moss H', 'Frost I'][1:doc_id % 8 + 1] AS vau FROM lib),
o AS (SELECT *, CAST(row_number() OVER (ORDER BY coalesce(TRY_CAST(year_text AS INT), 0) DESC, t, paper_id) AS INT) AS nth FROM r)"""

APA_A = "CASE n WHEN 1 THEN 'Lake, A.' WHEN 2 THEN 'Lake, A., & Mill, B.' WHEN 3 THEN 'Lake, A., Mill, B., & Young, C. D.' ELSE 'Lake, A., et al.' END"
CHI_A = "CASE n WHEN 1 THEN 'Lake, Ada' WHEN 2 THEN 'Lake, Ada, and Ben Mill' WHEN 3 THEN 'Lake, Ada, Ben Mill, and Carl D. Young' ELSE 'Lake, Ada, et al.' END"
MLA_A = "CASE n WHEN 1 THEN 'Lake, Ada' WHEN 2 THEN 'Lake, Ada, and Ben Mill' ELSE 'Lake, Ada, et al.' END"
VAN_A = "CASE WHEN n <= 6 THEN array_to_string(vau, ', ') ELSE array_to_string(vau[1:6], ', ') || ', et al' END"


def _list(style):
    return lambda s, d: e.reference_list(_some(s, d), style)


def _opt(c: str, before: str, after: str) -> str:
    return f"CASE WHEN {c} <> '' THEN '{before}' || {c} || '{after}' ELSE '' END"


def _style_sql(parts: str) -> str:
    return f"WITH {BASE} SELECT paper_id, nth, nth || '. ' || {parts} AS ref FROM o"


MORE = """CAST(doc_id % 40 AS VARCHAR) AS vol, CASE WHEN doc_id % 4 > 0 THEN CAST(doc_id % 12 AS VARCHAR) END AS iss, CASE doc_id % 3 WHEN 0 THEN (doc_id + 1) || '-' || (doc_id + 9) WHEN 1 THEN CAST(doc_id AS VARCHAR) END AS pg,
  doc_id % 2 = 0 AS pub, doc_id % 5 = 0 AS has_issn, substr(abstract, 1, 300) AS ab"""

BIB = f"""WITH {BASE}, m AS (SELECT *, {MORE} FROM r)
SELECT paper_id, array_to_string([x FOR x IN ['@' || CASE paper_type WHEN 'journal-article' THEN 'article' WHEN 'review' THEN 'article' WHEN 'thesis' THEN 'phdthesis' WHEN 'conference-paper' THEN 'inproceedings' ELSE 'misc' END || '{{Lake' || year_text || 'Study,',
  '  title = {{{{Study \\& Test ' || doc_id || '}}}},', '  author = {{' || array_to_string(au, ' and ') || '}},', CASE WHEN year_text <> '' THEN '  year = {{' || year_text || '}},' END, '  journal = {{' || journal || '}},',
  '  volume = {{' || vol || '}},', '  number = {{' || iss || '}},', '  pages = {{' || pg || '}},', CASE WHEN pub THEN '  publisher = {{Press \\& Co\\_}},' END, CASE WHEN has_issn THEN '  issn = {{0022-1120}},' END,
  CASE WHEN doi <> '' THEN '  doi = {{' || doi || '}},' END, CASE WHEN trim(ab) <> '' THEN '  abstract = {{{{' || regexp_replace(ab, '([&%#_])', '\\\\\\1', 'g') || '}}}},' END, '}}'] IF x IS NOT NULL], chr(10)) AS entry FROM m"""

RIS = f"""WITH {BASE}, m AS (SELECT *, {MORE} FROM r)
SELECT paper_id, array_to_string([x FOR x IN list_concat(list_concat(['TY  - ' || CASE paper_type WHEN 'journal-article' THEN 'JOUR' WHEN 'review' THEN 'JOUR' WHEN 'thesis' THEN 'THES' WHEN 'conference-paper' THEN 'CONF' ELSE 'GEN' END, 'TI  - ' || t], ['AU  - ' || a FOR a IN au]),
  [CASE WHEN year_text <> '' THEN 'PY  - ' || year_text END, 'JO  - ' || journal, 'VL  - ' || vol, 'IS  - ' || iss, 'SP  - ' || split_part(pg, '-', 1), CASE WHEN contains(pg, '-') THEN 'EP  - ' || split_part(pg, '-', 2) END, CASE WHEN pub THEN 'PB  - Press & Co_' END,
   CASE WHEN has_issn THEN 'SN  - 0022-1120' END, CASE WHEN doi <> '' THEN 'DO  - ' || doi END, CASE WHEN doi <> '' THEN 'UR  - https://doi.org/' || doi END, CASE WHEN trim(ab) <> '' THEN 'AB  - ' || ab END, 'ER  -']) IF x IS NOT NULL], chr(10)) AS entry FROM m"""


def _matrix(spark, sf_dir):
    rows = x.option_matrix(spark, {"parser": ["a", "b"], "ocr": ["on", "off"], "lang": ["en"]}, {"lang": "xx", "pages": "10"})
    return rows.select(F.array_join(F.transform(F.array_sort(F.map_entries("options")), lambda kv: F.concat(kv["key"], F.lit("="), kv["value"])), ";").alias("options"))


def _filtered(spark, sf_dir):
    return e.export_filter(lib(spark, sf_dir), 2003, 2019, "SRC1", "article").select("paper_id")


QUERIES = {
    "export_bibtex": (lambda s, d: e.bibtex(_some(s, d)), BIB),
    "export_ris": (lambda s, d: e.ris(_some(s, d)), RIS),
    "refs_apa": (_list("apa"), _style_sql(f"{APA_A} || ' (' || CASE WHEN year_text <> '' THEN year_text ELSE 'n.d.' END || '). ' || t || '.' || {_opt('journal', ' *', '*.')} || {_opt('doi', ' https://doi.org/', '')}")),
    "refs_vancouver": (_list("vancouver"), _style_sql(f"{VAN_A} || '. ' || t || '.' || {_opt('journal', ' ', '.')} || {_opt('year_text', ' ', '.')} || {_opt('doi', ' doi:', '')}")),
    "refs_chicago": (_list("chicago"), _style_sql(f"{CHI_A} || '. \"' || t || '.\"' || {_opt('journal', ' *', '*')} || {_opt('year_text', ' (', ')')} || '.' || {_opt('doi', ' https://doi.org/', '.')}")),
    "refs_mla": (_list("mla"), _style_sql(f"{MLA_A} || '. \"' || t || '.\"' || {_opt('journal', ' *', '*,')} || {_opt('year_text', ' ', '.')} || {_opt('doi', ' https://doi.org/', '.')}")),
    "export_filter": (_filtered, f"WITH {LIB} SELECT paper_id FROM lib WHERE coalesce(TRY_CAST(year_text AS INT), 0) >= 2003 AND coalesce(TRY_CAST(year_text AS INT), 9999) <= 2019 AND contains(lower(journal), 'src1') AND contains(lower(paper_type), 'article')"),
    "option_matrix": (_matrix, "SELECT 'lang=en;ocr=' || o || ';pages=10;parser=' || p AS options FROM (SELECT unnest(['on', 'off']) AS o), (SELECT unnest(['a', 'b']) AS p)"),
}
