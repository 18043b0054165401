"""Keyword search and lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import shared_folder
from ..operators import search as s
from ..operators.live_index import LiveIndex
from ..operators.substring import GramIndex
from .bridge import LIB, lib, registry, stored_grams, table

FIELDS = {"title": 10.0, "abstract": 2.0, "journal": 3.0, "year": 0.5}
#: The query of the checks; both words occur in a minority of the documents.
WORDS = "ertion erth"


def _index(records: DataFrame) -> s.SearchIndex:
    return s.build_index(records, {"title": F.col("title"), "abstract": F.col("abstract"), "journal": F.col("journal"), "year": F.col("year_text")})


#: Where the library's index of a session and data folder is stored.
_stored: dict[tuple[str, str], str] = {}


def library_index(spark: SparkSession, sf_dir: str) -> s.SearchIndex:
    """The stored index of the library, built when a session first asks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        path = shared_folder(spark, "index")
        _index(lib(spark, sf_dir)).write(path)
        _stored[key] = path
    return s.SearchIndex.read(spark, _stored[key])


def _found(rows: DataFrame) -> DataFrame:
    return rows.select("paper_id", F.round("score", 4).alias("score"))


def _search(query: str = WORDS, weights=FIELDS, top_k=20, **filters):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        records = lib(spark, sf_dir)
        return _found(s.search(library_index(spark, sf_dir), records, query, weights, top_k, **filters))

    return run


def _terms(words: list[str]) -> str:
    return ", ".join(f"('{w}')" for w in words)


def _sql(words: list[str], match: str, scored: list[str], weights=FIELDS, where: str = "TRUE", top: str = "ORDER BY score DESC, paper_id LIMIT 20") -> str:
    """BM25 from its definition: match is a predicate over n_<word>."""
    fields = {"title": "title", "abstract": "abstract", "journal": "journal", "year": "year_text"}
    toks = ", ".join(f"regexp_extract_all(strip_accents(lower(coalesce({c}, ''))), '[\\p{{L}}\\p{{N}}]+') AS t_{f}" for f, c in fields.items())
    count = lambda w, f: f"len([x FOR x IN t_{f} IF x = '{w}'])"
    n = ", ".join("(" + " + ".join(count(w, f) for f in fields) + f") AS n_{w}" for w in words)
    tf = ", ".join("(" + " + ".join(f"{weights.get(f, 0.0)}e0 * {count(w, f)}" for f in fields) + f") AS f_{w}" for w in words)
    df = ", ".join(f"count(*) FILTER (WHERE n_{w} > 0) AS df_{w}" for w in words)
    idf = lambda w: f"CASE WHEN df_{w} * 2 >= total THEN 1e-6 ELSE ln((total - df_{w} + 0.5) / (df_{w} + 0.5)) END"
    part = lambda w: f"({idf(w)}) * f_{w} * 2.2e0 / (f_{w} + 1.2e0 * (0.25e0 + 0.75e0 * size / mean))"
    return f"""WITH {LIB}, w AS (SELECT *, {toks} FROM lib),
c AS (SELECT *, {n}, {tf}, len(t_title) + len(t_abstract) + len(t_journal) + len(t_year) AS size FROM w),
st AS (SELECT CAST(count(*) AS DOUBLE) AS total, avg(size) AS mean, {df} FROM c)
SELECT paper_id, round({" + ".join(f"CASE WHEN {w[1]} THEN {part(w[0])} ELSE 0 END" if isinstance(w, tuple) else part(w) for w in scored)}, 4) AS score FROM c, st WHERE ({match}) AND ({where}) {top}"""


AND = "n_ertion > 0 AND n_erth > 0"
W2 = ["ertion", "erth"]


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = lib(spark, sf_dir)
    members = records.where("doc_id % 4 = 1").select("paper_id")
    return _found(s.search(library_index(spark, sf_dir), records, WORDS, FIELDS, within=members))


def _federated(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = lib(spark, sf_dir)
    silo = records.where("doc_id % 2 = 0")
    scopes = {"main": s.search(library_index(spark, sf_dir), records, WORDS, FIELDS, None), "silo": s.search(_index(silo), silo, WORDS, FIELDS, None)}
    return s.federated(scopes, 10).select("scope", "rank", "paper_id", F.round("score", 4).alias("score"))


def _strip(sql: str) -> str:
    return sql.replace("ORDER BY score DESC, paper_id LIMIT 20", "")


def _federated_sql() -> str:
    main = _sql(W2, AND, W2, top="")
    silo = main.replace("w AS (SELECT *,", "w AS (SELECT *,").replace("FROM lib),\nc AS", "FROM lib WHERE doc_id % 2 = 0),\nc AS")
    return f"""SELECT scope, rank, paper_id, score FROM (
  SELECT scope, CAST(row_number() OVER (PARTITION BY scope ORDER BY score DESC, paper_id) AS INT) AS rank, paper_id, score
  FROM (SELECT 'main' AS scope, * FROM ({main}) UNION ALL SELECT 'silo' AS scope, * FROM ({silo}))) WHERE rank <= 10"""


def _author(spark, sf_dir):
    rows = lib(spark, sf_dir).withColumn("authors", F.array_join("authors", ", "))
    index = stored_grams(spark, sf_dir, "authors", lambda: GramIndex.build(rows, "paper_id", F.col("authors")))
    return s.by_author(rows, "xTHE", index=index).select("paper_id", "authors", "year_text")


def _live(spark, sf_dir):
    """An index in steps: old titles of a third of the records, then all as they
    are, then a tenth removed."""
    records = lib(spark, sf_dir)
    i = F.col("doc_id")
    fields = {"title": F.col("title"), "abstract": F.col("abstract"), "journal": F.col("journal"), "year": F.col("year_text")}
    index = LiveIndex(spark, shared_folder(spark, "live-index"), fields)
    index.apply(records.where(i % 2 == 0).withColumn("title", F.when(i % 3 == 0, F.lit("erth ertion as it was")).otherwise(F.col("title"))))
    index.apply(records, records.where(i % 10 == 9).select("paper_id"))
    index.apply(removed=records.where(i % 10 == 9).select("paper_id"))
    return index, records


def _live_search(spark, sf_dir):
    index, records = _live(spark, sf_dir)
    found = _found(s.search(index.snapshot(), records, WORDS, FIELDS))
    index.compact()
    return found.unionByName(_found(s.search(index.snapshot(), records, WORDS, FIELDS)).withColumn("paper_id", F.concat(F.lit("compact "), "paper_id")))


def _live_history(spark, sf_dir):
    """What each version wrote, with one of a new layout at the end."""
    index, records = _live(spark, sf_dir)
    index.compact()
    newer = LiveIndex(spark, index.path, index.fields, schema=index.schema + 1)
    if newer.needs_rebuild():
        newer.rebuild(records)
    return spark.createDataFrame(newer.history(), "version int, layout int, segments int, written long, live long")


def _top_cited(spark, sf_dir):
    rows = lib(spark, sf_dir).withColumn("citation_count", F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.col("citations").cast("string")))
    return s.top_cited(rows.drop("citations")).select("paper_id", "citations")


def _lookup(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    ref = F.when(key % 10 == 0, key.cast("string")).when(key % 10 == 1, F.concat(F.lit("D"), F.lpad(key.cast("string"), 9, "0"))).when(key % 10 == 2, F.concat(F.lit("10.1/"), key.cast("string"))).otherwise("x")
    known = registry(spark, sf_dir).withColumn("id", F.col("id").cast("string"))
    return s.lookup(known, o.select(ref.alias("ref")).distinct())


def _all_tags(spark, sf_dir):
    rows = lib(spark, sf_dir).select("paper_id", F.explode(F.array_distinct("tags")).alias("tag"))
    return s.with_all_tags(rows, ["en", "quality"])


def _in_library(spark, sf_dir):
    records = lib(spark, sf_dir)
    return s.in_library(records.where("doi <> ''").select("paper_id", F.upper("doi").alias("doi")), records.where("doc_id % 3 = 0")).select("paper_id", "in_library")


def _live_sql() -> str:
    one = _sql(W2, AND, W2).replace("FROM lib),\nc AS", "FROM lib WHERE doc_id % 10 <> 9),\nc AS")
    return f"SELECT * FROM ({one}) UNION ALL SELECT 'compact ' || paper_id, score FROM ({one})"


ONES = dict.fromkeys(FIELDS, 1.0)
SILO = {"title": 10.0, "abstract": 2.0}
OR_NOT = "(n_ertion > 0 AND n_erth > 0) OR (n_thing > 0 AND NOT n_eran > 0)"

QUERIES = {
    "search_bm25": (_search(), _sql(W2, AND, W2)),
    "search_single_word": (_search("thing", top_k=50), _sql(["thing"], "n_thing > 0", ["thing"], top="ORDER BY score DESC, paper_id LIMIT 50")),
    "search_frequent_word_floor": (_search("the", top_k=None), _sql(["the"], "n_the > 0", ["the"], top="")),
    "search_year_range": (_search(year="2005-2012"), _sql(W2, AND, W2, where="year_text >= '2005' AND year_text <= '2012'")),
    "search_year_open_start": (_search(year="-2004"), _sql(W2, AND, W2, where="year_text <= '2004'")),
    "search_year_open_end": (_search(year="2015-"), _sql(W2, AND, W2, where="year_text >= '2015'")),
    "search_journal_type_filter": (_search(journal="SRC1", paper_type="article"), _sql(W2, AND, W2, where="journal ILIKE '%src1%' AND paper_type ILIKE '%article%'")),
    "search_tag_and_filter": (_search(tags=["en", "quality"]), _sql(W2, AND, W2, where="list_contains(tags, 'en') AND list_contains(tags, 'quality')")),
    "search_scoped_semi": (_scoped, _sql(W2, AND, W2, where="doc_id % 4 = 1")),
    "search_or_not": (_search("ertion erth OR thing NOT eran", top_k=None), _sql([*W2, "thing", "eran"], OR_NOT, [("ertion", AND), ("erth", AND), ("thing", "n_thing > 0 AND NOT n_eran > 0")], top="")),
    "search_repeated_word": (_search("erth erth ertion"), _sql(W2, AND, ["erth", "erth", "ertion"])),
    "search_silo_weights": (_search(weights=SILO), _sql(W2, AND, W2, SILO)),
    "search_proceedings_equal_weights": (_search(weights=ONES), _sql(W2, AND, W2, ONES)),
    "search_author_like": (_author, f"WITH {LIB} SELECT paper_id, array_to_string(authors, ', ') AS authors, year_text FROM lib WHERE contains(lower(array_to_string(authors, ', ')), 'xthe') ORDER BY year_text DESC, paper_id LIMIT 20"),
    "search_live_index": (_live_search, _live_sql()),
    "live_index_versions": (_live_history, f"""WITH {LIB}, c AS (SELECT count(*) AS n, count(*) FILTER (WHERE doc_id % 2 = 0) AS half, count(*) FILTER (WHERE doc_id % 2 = 1 OR (doc_id % 3 = 0 AND title <> 'erth ertion as it was')) AS changed, count(*) FILTER (WHERE doc_id % 10 = 9) AS gone FROM lib)
SELECT CAST(v AS INT) AS version, CAST(CASE WHEN v = 5 THEN 2 ELSE 1 END AS INT) AS layout, CAST(CASE WHEN v IN (2, 3) THEN 2 ELSE 1 END AS INT) AS segments, CASE v WHEN 1 THEN half WHEN 2 THEN changed WHEN 3 THEN changed WHEN 4 THEN n - gone ELSE n END AS written,
  CASE v WHEN 1 THEN half WHEN 2 THEN n WHEN 5 THEN n ELSE n - gone END AS live FROM c, range(1, 6) r(v)"""),
    "top_cited": (_top_cited, f"WITH {LIB} SELECT paper_id, CAST(citations AS INT) AS citations FROM lib WHERE doc_id % 9 <> 0 ORDER BY citations DESC, paper_id LIMIT 20"),
    "lookup_priority": (_lookup, """WITH r AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 3 <> 0),
q AS (SELECT DISTINCT o_orderkey AS k, CASE o_orderkey % 10 WHEN 0 THEN CAST(o_orderkey AS VARCHAR) WHEN 1 THEN 'D' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') WHEN 2 THEN '10.1/' || o_orderkey ELSE 'x' END AS ref FROM orders)
SELECT DISTINCT ref, CASE WHEN k % 10 < 3 AND id IS NOT NULL THEN CAST(id AS VARCHAR) END AS id, CASE WHEN k % 10 < 3 AND id IS NOT NULL THEN CAST(k % 10 AS INT) END AS level FROM q LEFT JOIN r ON q.k = r.id"""),
    "tags_all_of": (_all_tags, f"WITH {LIB} SELECT paper_id FROM lib WHERE list_contains(tags, 'en') AND list_contains(tags, 'quality')"),
    "federated_search": (_federated, _federated_sql()),
    "in_library_flag": (_in_library, f"WITH {LIB} SELECT paper_id, doi IN (SELECT doi FROM lib WHERE doc_id % 3 = 0 AND doi <> '') AS in_library FROM lib WHERE doi <> ''"),
}
