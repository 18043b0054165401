"""Citation graph and index maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.places import shared_folder
from ..operators import graph as g
from ..operators import maintain as m
from .bridge import GRAPH, LIB, edges, lib, raw_edges, registry

SEEDS = "(1, 2, 4, 5, 7)"


#: Where the resolved edges of a session and data folder are stored.
_stored: dict[tuple[str, str], str] = {}


def resolved(spark, sf_dir):
    """The library's edges, resolved and stored when a session first asks."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = shared_folder(spark, "edges")
        edges(spark, sf_dir).write.parquet(_stored[key])
    return spark.read.parquet(_stored[key])


def _seeds(spark, sf_dir):
    return registry(spark, sf_dir).where(f"id IN {SEEDS}").select("id")


def _references(spark, sf_dir):
    ids = registry(spark, sf_dir).select("id")
    return g.references(edges(spark, sf_dir), registry(spark, sf_dir), ids)


def _references_within(spark, sf_dir):
    r = registry(spark, sf_dir)
    return g.references(edges(spark, sf_dir), r, r.select("id"), r.where("id % 4 = 1").select("id"))


def _cited_by(spark, sf_dir):
    r = registry(spark, sf_dir)
    return g.citing(edges(spark, sf_dir), r, r.select("id")).select("cited", "source_id", "dir_name", "year")


def _shared(spark, sf_dir):
    return g.shared_references(edges(spark, sf_dir), registry(spark, sf_dir).select("id"))


def _snowball(spark, sf_dir):
    return g.ordered_candidates(g.snowball(resolved(spark, sf_dir), registry(spark, sf_dir), _seeds(spark, sf_dir)), 50)


def _snowball_within(spark, sf_dir):
    r = registry(spark, sf_dir)
    return g.snowball(resolved(spark, sf_dir), r, _seeds(spark, sf_dir), r.where("id % 2 = 0"))


def _snowball_sql(where: str, tail: str) -> str:
    return f"""WITH {GRAPH},
s AS (SELECT id AS seed, doi FROM registry WHERE id IN {SEEDS}),
own AS (SELECT e.* FROM edges e JOIN s ON e.source_id = s.seed),
refs AS (SELECT DISTINCT source_id AS seed, target_id AS id FROM own WHERE target_id IS NOT NULL),
cit AS (SELECT DISTINCT s.seed, e.source_id AS id FROM edges e JOIN s ON e.target_id = s.seed OR e.target_doi = s.doi WHERE e.source_id IN (SELECT id FROM registry)),
piv AS (SELECT DISTINCT e.source_id AS id FROM edges e WHERE e.target_id IN (SELECT id FROM refs) AND e.source_id IN (SELECT id FROM registry)),
cand AS (SELECT id FROM refs UNION SELECT id FROM cit UNION SELECT id FROM piv),
k AS (SELECT c.id, (SELECT count(DISTINCT seed) FROM refs WHERE refs.id = c.id) AS cited_by_seeds, (SELECT count(DISTINCT seed) FROM cit WHERE cit.id = c.id) AS cites_seeds,
             (SELECT count(DISTINCT e.target_doi) FROM edges e WHERE e.source_id = c.id AND e.target_doi IN (SELECT target_doi FROM own)) AS shared,
             array_to_string([x FOR x IN [CASE WHEN c.id IN (SELECT id FROM refs) THEN 'refs' END, CASE WHEN c.id IN (SELECT id FROM cit) THEN 'citing' END, CASE WHEN c.id IN (SELECT id FROM piv) THEN 'shared' END] IF x IS NOT NULL], '+') AS relations
      FROM cand c WHERE c.id NOT IN (SELECT seed FROM s))
SELECT k.id, r.dir_name, r.year, relations, shared, cites_seeds, cited_by_seeds, 2 * shared + cites_seeds + cited_by_seeds AS score
FROM k JOIN registry r ON r.id = k.id WHERE {where} {tail}"""


def _state(spark, sf_dir):
    rows = lib(spark, sf_dir).withColumn("h", m.content_hash("title", "journal", "year_text", "citations")).select("paper_id", "doc_id", "h")
    old = rows.where("doc_id % 5 <> 0").withColumn("h", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("h")))
    now = rows.where("doc_id % 9 <> 0")
    return now, old


def _changed(spark, sf_dir):
    return m.changed(*_state(spark, sf_dir)).select("paper_id", "h")


def _stale(spark, sf_dir):
    return m.stale(*_state(spark, sf_dir))


def _upserted(spark, sf_dir):
    now, old = _state(spark, sf_dir)
    return m.upserted(now, old).select("paper_id", "h")


def _appended(spark, sf_dir):
    rows = lib(spark, sf_dir).select(F.col("doi").alias("id"), F.when(F.col("doc_id") % 8 == 0, "").otherwise(F.col("title")).alias("title"), F.col("doc_id").alias("seq")).where("id <> ''")
    return m.appended(rows, rows.where("seq % 6 = 0")).select("id", "title", "seq")


def _unique(spark, sf_dir):
    return m.unique_keys(lib(spark, sf_dir).select("paper_id", "doc_id", "doi"), "doi", "doc_id", True).select("paper_id", "doi")


def _edges_replaced(spark, sf_dir):
    old = raw_edges(spark, sf_dir)
    new = old.where("source_id % 10 = 3 and source_id % 20 <> 3").withColumn("target_doi", F.concat("target_doi", F.lit("x")))
    return m.replace_edges(old, new).groupBy((F.col("source_id") % 20).alias("rest")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.endswith("target_doi", F.lit("x"))).alias("n_new"))


def _abstract(spark, sf_dir):
    words = lib(spark, sf_dir).select("paper_id", F.posexplode(F.split("title", " ")).alias("place", "word"))
    inverted = words.groupBy(F.col("paper_id").alias("id"), "word").agg(F.collect_list("place").alias("positions"))
    return m.rejoined_abstract(inverted)


HASH = "substr(md5(title || chr(10) || journal || chr(10) || year_text || chr(10) || citations), 1, 12)"
STATE = f"""{LIB}, r AS (SELECT paper_id, doc_id, {HASH} AS h FROM lib), now AS (SELECT * FROM r WHERE doc_id % 9 <> 0),
old AS (SELECT paper_id, doc_id, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE h END AS h FROM r WHERE doc_id % 5 <> 0)"""

QUERIES = {
    "references": (_references, f"WITH {GRAPH} SELECT e.source_id, e.target_doi, e.target_id, r.dir_name, r.year FROM edges e LEFT JOIN registry r ON r.id = e.target_id WHERE e.source_id IN (SELECT id FROM registry)"),
    "references_whitelist": (_references_within, f"WITH {GRAPH} SELECT e.source_id, e.target_doi, e.target_id, r.dir_name, r.year FROM edges e LEFT JOIN registry r ON r.id = e.target_id WHERE e.source_id IN (SELECT id FROM registry) AND (e.target_id IS NULL OR e.target_id % 4 = 1)"),
    "cited_by": (_cited_by, f"WITH {GRAPH} SELECT DISTINCT p.cited, p.source_id, s.dir_name, s.year FROM (SELECT c.id AS cited, e.source_id FROM registry c JOIN edges e ON e.target_id = c.id UNION SELECT c.id, e.source_id FROM registry c JOIN edges e ON e.target_doi = c.doi) p JOIN registry s ON s.id = p.source_id"),
    "shared_references": (_shared, f"WITH {GRAPH} SELECT target_doi, count(DISTINCT source_id) AS shared, min(target_id) AS target_id FROM edges WHERE source_id IN (SELECT id FROM registry) GROUP BY 1 HAVING count(DISTINCT source_id) >= 2"),
    "snowball": (_snowball, _snowball_sql("TRUE", "ORDER BY score DESC, shared DESC, dir_name LIMIT 50")),
    "snowball_whitelist": (_snowball_within, _snowball_sql("k.id % 2 = 0", "")),
    "link_resolution": (edges, f"WITH {GRAPH} SELECT source_id, target_doi, target_id FROM edges"),
    "index_changed_rows": (_changed, f"WITH {STATE} SELECT n.paper_id, n.h FROM now n LEFT JOIN old o ON o.paper_id = n.paper_id WHERE o.h IS NULL OR o.h <> n.h"),
    "index_stale_rows": (_stale, f"WITH {STATE} SELECT paper_id FROM old WHERE paper_id NOT IN (SELECT paper_id FROM now)"),
    "index_upsert_state": (_upserted, f"WITH {STATE} SELECT paper_id, h FROM now"),
    "silo_incremental_append": (_appended, f"""WITH {LIB}, r AS (SELECT doi AS id, CASE WHEN doc_id % 8 = 0 THEN '' ELSE title END AS title, doc_id AS seq FROM lib WHERE doi <> '')
SELECT id, title, seq FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS n FROM r WHERE title <> '') WHERE n = 1 AND id NOT IN (SELECT id FROM r WHERE seq % 6 = 0)"""),
    "registry_unique_doi": (_unique, f"WITH {LIB} SELECT paper_id, CASE WHEN doi <> '' AND row_number() OVER (PARTITION BY doi ORDER BY doc_id) > 1 THEN '' ELSE doi END AS doi FROM lib"),
    "edge_replacement": (_edges_replaced, f"WITH {GRAPH} SELECT source_id % 20 AS rest, count(*) AS n, count(*) FILTER (WHERE source_id % 20 = 13) AS n_new FROM edges GROUP BY 1"),
    "abstract_from_inverted_index": (_abstract, f"WITH {LIB} SELECT paper_id AS id, title AS text FROM lib"),
}
