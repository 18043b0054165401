"""Extraction from texts and pages, and tool documentation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.places import shared_folder
from ..operators import extract as x
from ..operators import tooldocs as d
from ..operators.search import SearchIndex
from .bridge import LIB, lib, table, title_words_sql


def _score(spark, sf_dir):
    return x.text_score(table(spark, sf_dir, "conversations").withColumn("id", F.col("conv_id") * 1000 + F.col("turn")), "id", "text").drop("preview")


def _dice(spark, sf_dir):
    rows = lib(spark, sf_dir)
    other = rows.select((F.col("doc_id") + 1).alias("doc_id"), F.col("title").alias("other"))
    return rows.join(other, "doc_id").select("paper_id", F.round(t.dice(F.col("title"), F.col("other")), 6).alias("similarity"))


def _pages(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    html = F.regexp_replace(F.replace("html", F.lit("<h1>"), F.concat(F.lit('<h2 id="h-'), F.col("page_id").cast("string"), F.lit('">'))), "</h1>", "</h2>")
    return p.select("page_id", "url", F.concat(F.lit('<meta name="description" content="About '), "url", F.lit(' and whatever else there is to say of it at length">'), html).alias("html"))


def _links(spark, sf_dir):
    return x.html_links(table(spark, sf_dir, "pages"))


def _headings(spark, sf_dir):
    return x.html_headings(_pages(spark, sf_dir)).select("page_id", "nth", "level", "anchor")


def _meta(spark, sf_dir):
    return _pages(spark, sf_dir).select("page_id", x.abstract_of_html(F.col("html")).alias("abstract"))


def _plain(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.regexp_replace(x.html_plain(F.col("html")), r"\s+", "")).alias("digest"))


PLAIN = r"""SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>', '', 'g'), '(?s)<[^>]+>', '', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', '', 'g')) AS digest FROM pages"""


def _tool_pages(spark, sf_dir):
    rows = lib(spark, sf_dir)
    return rows.select(F.col("doc_id").alias("page_id"), F.lower(F.concat_ws("/", "journal", F.concat(F.lit("page_"), (F.col("doc_id") % 50).cast("string")))).alias("page_name"), "title", F.col("abstract").alias("content"), F.substring("abstract", 1, 200).alias("synopsis"), F.lit("manual").alias("section"), F.col("journal").alias("program"))


#: Where the tool pages' index of a session and data folder is stored.
_stored: dict[tuple[str, str], str] = {}


def _tool_index(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = shared_folder(spark, "tool-index")
        d.index_pages(_tool_pages(spark, sf_dir)).write(_stored[key])
    return SearchIndex.read(spark, _stored[key])


TOOL_TERMS = ["thing ertion", "eran"]


def _tool_search(spark, sf_dir):
    found = d.tool_search(_tool_index(spark, sf_dir), _tool_pages(spark, sf_dir), "qe", "Erth", TOOL_TERMS, 20)
    return found.select("page_id", "tier", "score", F.round("rank", 4).alias("rank"))


TOOL_PAGES = """p AS (SELECT doc_id AS page_id, lower(journal || '/page_' || (doc_id % 50)) AS page_name, lower(title) AS title, lower(abstract) AS content, lower(substr(abstract, 1, 200)) AS synopsis, journal AS program FROM lib)"""


def _points_sql(q: str, terms: list[str]) -> str:
    """The additive score from its definition, but for bonuses."""
    has = lambda c, w: f"contains({c}, '{w}')"
    ends = lambda w, marks: "(" + " OR ".join(f"ends_with(page_name, '/{w.replace(' ', m)}')" for m in marks) + ")"
    parts = [(f"title = '{q}'", 120), (ends(q, " -_"), 110), (has("synopsis", q), 90), (has("content", q), 70)]
    parts += [x for t in terms for x in ((f"title = '{t}'", 80), (ends(t, " -"), 75), (has("synopsis", t), 55), (has("content", t), 35))]
    parts += [x for w in q.split() for x in ((has("title", w), 18), (has("synopsis", w), 12), (has("content", w), 6))]
    return " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in parts)


def _tool_sql() -> str:
    words = ["erth", "thing", "ertion", "eran"]
    n = ", ".join(f"len([x FOR x IN ws IF x = '{w}']) AS n_{w}" for w in words)
    df = ", ".join(f"count(*) FILTER (WHERE n_{w} > 0) AS df_{w}" for w in words)
    part = lambda w: f"(CASE WHEN df_{w} * 2 >= total THEN 1e-6 ELSE ln((total - df_{w} + 0.5) / (df_{w} + 0.5)) END) * n_{w} * 2.2e0 / (n_{w} + 1.2e0 * (0.25e0 + 0.75e0 * len(ws) / mean))"
    both = "n_thing > 0 AND n_ertion > 0"
    return f"""WITH {LIB}, {TOOL_PAGES},
w AS (SELECT *, regexp_extract_all(strip_accents(title || ' ' || page_name || ' ' || synopsis || ' ' || content), '[\\p{{L}}\\p{{N}}]+') AS ws FROM p), c AS (SELECT *, {n} FROM w),
st AS (SELECT CAST(count(*) AS DOUBLE) AS total, avg(len(ws)) AS mean, {df} FROM c),
h AS (SELECT *, {part('erth')} + CASE WHEN {both} THEN {part('thing')} + {part('ertion')} ELSE 0 END + {part('eran')} AS r,
  CASE WHEN title = 'erth' THEN 0 WHEN contains(content, '|erth|') THEN 1 WHEN page_name = 'erth' OR page_name LIKE '%/erth' THEN 2 WHEN contains(synopsis, 'erth') THEN 3 ELSE 4 END AS tier FROM c, st WHERE n_erth > 0 OR ({both}) OR n_eran > 0)
SELECT page_id, CAST(tier AS INT) AS tier, CAST({_points_sql('erth', TOOL_TERMS)} AS INT) AS score, round(r, 4) AS rank FROM h ORDER BY tier, r DESC, page_id LIMIT 20"""


def _rescored(spark, sf_dir):
    """Scores of all pages for a query of two words, and of a tool with bonuses."""
    pages = _tool_pages(spark, sf_dir).withColumns({"section": F.when(F.col("page_id") % 2 == 0, "MDP").otherwise("x"), "program": F.when(F.col("page_id") % 3 == 0, "minimap2")})
    return pages.select(
        "page_id", d.score_terms(F.lit("qe"), F.lit("page 7"), F.array(F.lit("Thing"), F.lit("page 8"))).alias("score"), d.score_terms(F.lit("gromacs"), F.lit("erth"), F.array().cast("array<string>")).alias("gromacs"),
        d.score_terms(F.lit("bioinformatics"), F.lit("long read"), F.array(F.lit("long read"))).alias("reads"),
    )


def _rescored_sql() -> str:
    return f"""WITH {LIB}, {TOOL_PAGES} SELECT page_id, CAST({_points_sql('page 7', ['thing', 'page 8'])} AS INT) AS score, CAST({_points_sql('erth', [])} + CASE WHEN page_id % 2 = 0 THEN 20 ELSE 0 END AS INT) AS gromacs,
  CAST({_points_sql('long read', [])} + CASE WHEN page_id % 3 = 0 THEN 120 ELSE 0 END AS INT) AS reads FROM p"""


def _expanded(spark, sf_dir):
    rules = spark.createDataFrame([("t", "fix", ["constraint", "fix shake"]), ("t", "force", ["pair style"]), ("u", "fix", ["other"])], "tool string, trigger string, expansions array<string>")
    q = table(spark, sf_dir, "documents").select(F.lit("t").alias("tool"), F.element_at(F.array(F.lit("Fix_the force/field"), F.lit("plain  words"), F.lit("prefix")), (F.col("doc_id") % 3 + 1).cast("int")).alias("query")).distinct()
    return d.expand_queries(q, rules).select("tool", "query", F.array_join("terms", "|").alias("terms"))


def _shown(spark, sf_dir):
    wanted = spark.createDataFrame([("src1/page_1",), ("page_7",), ("manual",), ("src3",), ("nothing at all",)], "ref string")
    return d.show(_tool_pages(spark, sf_dir), wanted).select("ref", "page_id", F.col("level").cast("int").alias("level"))


SHOWN = f"""WITH {LIB}, p AS (SELECT doc_id AS page_id, lower(journal || '/page_' || (doc_id % 50)) AS page_name, lower(title) AS title, journal AS program FROM lib),
q AS (SELECT unnest(['src1/page_1', 'page_7', 'manual', 'src3', 'nothing at all']) AS ref),
m AS (SELECT ref, page_id, page_name, CASE WHEN page_name = ref THEN 0 WHEN title = ref THEN 1 WHEN ref = 'manual' THEN 2 WHEN program = ref THEN 3 WHEN ends_with(page_name, '/' || ref) THEN 4 WHEN contains(page_name, ref) THEN 5 WHEN contains(title, ref) THEN 6 WHEN regexp_matches(page_name, replace(ref, ' ', '.*')) THEN 7 END AS level FROM p, q),
k AS (SELECT *, min(level) OVER (PARTITION BY ref) AS least FROM m WHERE level IS NOT NULL)
SELECT ref, page_id, CAST(level AS INT) AS level FROM (SELECT *, row_number() OVER (PARTITION BY ref ORDER BY length(page_name), page_id) AS n FROM k WHERE level = least) WHERE n <= 20"""


def _tags_normal(spark, sf_dir):
    raw = F.concat(F.lit("  "), "lang", F.lit("_ My  "), "source", F.lit(" -"))
    return table(spark, sf_dir, "documents").select("doc_id", t.normal_tag(raw).alias("tag"))


def _keywords(spark, sf_dir):
    return lib(spark, sf_dir).select("paper_id", t.title_keywords(F.col("title")).alias("keywords"))


TITLE_STOPS = ", ".join(f"'{w}'" for w in t.TITLE_STOPS)

QUERIES = {
    "text_score": (_score, r"SELECT conv_id * 1000 + turn AS id, CAST(length(text) AS INT) AS chars, CAST(len(regexp_extract_all(text, '\S+')) AS INT) AS words, CAST(len(string_split(text, chr(10))) AS INT) AS lines, CAST(len([x FOR x IN string_split(text, chr(10)) IF trim(x) <> '']) AS INT) AS non_empty, CAST(len(regexp_extract_all(text, '(?m)^#{1,6}\s')) AS INT) AS headings, CAST(len(regexp_extract_all(text, '!\[')) AS INT) AS images, CAST(len(regexp_extract_all(text, '\$\$')) AS INT) AS formulas, CAST(length(text) - length(replace(text, chr(65533), '')) AS INT) AS replacements FROM conversations"),
    "dice_similarity": (_dice, f"""WITH {LIB}, w AS (SELECT doc_id, paper_id, {title_words_sql('title')} AS ws FROM lib)
SELECT a.paper_id, CASE WHEN len(a.ws) = 0 OR len(b.ws) = 0 THEN 0.0e0 ELSE round(2.0e0 * len(list_intersect(a.ws, b.ws)) / (len(a.ws) + len(b.ws)), 6) END AS similarity FROM w a JOIN w b ON a.doc_id = b.doc_id + 1"""),
    "html_links": (_links, "SELECT page_id, href FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, '<a\\s+[^>]*?href=\"([^\"#][^\"]*)\"', 1))) AS href FROM pages) WHERE NOT regexp_matches(href, '(?i)^(mailto|javascript):')"),
    "html_headings": (_headings, "SELECT page_id, 0::INT AS nth, 2::INT AS level, 'h-' || page_id AS anchor FROM pages WHERE contains(html, '<h1>')"),
    "html_meta_abstract": (_meta, "SELECT page_id, trim(regexp_replace('About ' || url || ' and whatever else there is to say of it at length', '\\s+', ' ', 'g')) AS abstract FROM pages"),
    "html_plain_text": (_plain, PLAIN),
    "doc_search_tiered": (_tool_search, _tool_sql()),
    "doc_rescore": (_rescored, _rescored_sql()),
    "doc_query_expansion": (_expanded, "SELECT DISTINCT 't' AS tool, q AS query, CASE q WHEN 'Fix_the force/field' THEN 'Fix the force field|constraint|fix shake|pair style' WHEN 'plain  words' THEN 'plain words' ELSE 'prefix|constraint|fix shake' END AS terms FROM (SELECT (['Fix_the force/field', 'plain  words', 'prefix'])[CAST(doc_id % 3 + 1 AS INT)] AS q FROM documents)"),
    "doc_show_cascade": (_shown, SHOWN),
    "tag_normalisation": (_tags_normal, "SELECT doc_id, lower(lang) || '-my-' || lower(source) AS tag FROM documents"),
    "title_keywords": (_keywords, f"WITH {LIB}, w AS (SELECT paper_id, regexp_extract_all(lower(title), '[\\p{{L}}\\p{{M}}\\p{{N}}_]+') AS ws FROM lib) SELECT paper_id, array_to_string(list_slice([x FOR x IN ws IF x NOT IN ({TITLE_STOPS})], 1, 8), ' ') AS keywords FROM w"),
}
