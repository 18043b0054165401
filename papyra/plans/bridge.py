"""Library views over the plain tables, in Spark and in SQL alike.

``lib`` holds records (documents), ``registry`` and ``edges`` a citation graph
(orders and line items), ``log`` an event log (events).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.joins import spread
from ..functions.places import shared_folder
from ..operators.substring import GramIndex

#: Where indexes of a session and data folder are stored.
_stored: dict[tuple[str, str, str], str] = {}


def stored_grams(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], GramIndex]) -> GramIndex:
    """An index of short texts, built and stored when a session first asks."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stored:
        path = shared_folder(spark, f"grams-{name}")
        build().write(path)
        _stored[key] = path
    return GramIndex.read(spark, _stored[key])


TYPES = ["journal-article", "review", "thesis", "conference-paper", "document"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(found) if name in ("documents", "pages") else found


def lib(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    doc = F.col("doc_id")
    first = F.split("text", "\n", 2)
    doi = F.when(doc % 11 == 0, "").otherwise(F.concat(F.lit("10.5555/"), (doc - F.when(doc % 7 == 0, doc % 2).otherwise(0)).cast("string")))
    tags = F.array_compact(F.array(F.col("lang"), F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")))
    word = lambda i: F.initcap(F.regexp_replace(F.coalesce(F.get(F.split(F.get(first, F.lit(0)), " "), F.lit(i)), F.lit("")), "[^A-Za-z]", ""))
    return d.join(labels, "doc_id", "left").select(
        F.concat(F.lit("p"), doc.cast("string")).alias("paper_id"), "doc_id", F.get(first, F.lit(0)).alias("title"), F.coalesce(F.get(first, F.lit(1)), F.lit("")).alias("abstract"),
        F.col("source").alias("journal"), F.when(doc % 17 == 0, "").otherwise((2000 + doc % 25).cast("string")).alias("year_text"),
        F.element_at(F.array(*[F.lit(t) for t in TYPES]), (doc % 5 + 1).cast("int")).alias("paper_type"), doi.alias("doi"), tags.alias("tags"), (F.col("n_chars") % 500).cast("long").alias("citations"),
        F.array(F.concat_ws(" ", F.lit("Ada"), F.concat(F.lit("X"), F.lower(word(0)))), F.concat_ws(" ", F.lit("Ben"), F.concat(F.lit("Y"), F.lower(word(1))))).alias("authors"),
        F.concat_ws("-", F.concat(F.lit("N"), doc.cast("string")), (2000 + doc % 23).cast("string"), F.lit("Title")).alias("dir_name"), F.when(doc % 13 != 0, F.col("text")).alias("md_text"), "n_chars",
    )


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0")
    key = F.col("o_orderkey")
    return o.select(key.alias("id"), F.concat(F.lit("D"), F.lpad(key.cast("string"), 9, "0")).alias("dir_name"), F.when(key % 19 != 0, F.year("o_orderdate")).alias("year"), F.concat(F.lit("10.1/"), key.cast("string")).alias("doi"), F.lit("").alias("publication_number"))


def raw_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source_id"), F.concat(F.lit("10.1/"), F.col("l_partkey").cast("string")).alias("target_doi")).distinct()


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import resolve_links

    return resolve_links(raw_edges(spark, sf_dir), registry(spark, sf_dir))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), "ts", F.col("event_type").alias("category"), F.concat(F.lit("n"), F.get_json_object("props", "$.k")).alias("name"), F.col("user_id").cast("string").alias("session"),
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("T"), (F.get_json_object("props", "$.k").cast("int") % 7).cast("string"))).otherwise("").alias("title"), "value",
    )


def title_words_sql(text: str) -> str:
    return f"list_distinct([w FOR w IN regexp_split_to_array(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', '', 'g'), '[\\s\\p{{Z}}]+') IF w <> ''])"


LIB = """lib AS (
  SELECT 'p' || d.doc_id AS paper_id, d.doc_id, split_part(text, chr(10), 1) AS title,
         CASE WHEN instr(text, chr(10)) > 0 THEN substr(text, instr(text, chr(10)) + 1) ELSE '' END AS abstract, source AS journal,
         CASE WHEN d.doc_id % 17 = 0 THEN '' ELSE CAST(2000 + d.doc_id % 25 AS VARCHAR) END AS year_text,
         (['journal-article', 'review', 'thesis', 'conference-paper', 'document'])[CAST(d.doc_id % 5 + 1 AS INT)] AS paper_type,
         CASE WHEN d.doc_id % 11 = 0 THEN '' ELSE '10.5555/' || (d.doc_id - CASE WHEN d.doc_id % 7 = 0 THEN d.doc_id % 2 ELSE 0 END) END AS doi,
         [x FOR x IN [lang, CASE WHEN quality = 1 THEN 'quality' END, CASE WHEN toxic = 1 THEN 'toxic' END] IF x IS NOT NULL] AS tags,
         CAST(n_chars % 500 AS BIGINT) AS citations,
         ['Ada X' || lower(regexp_replace(split_part(split_part(text, chr(10), 1), ' ', 1), '[^A-Za-z]', '', 'g')), 'Ben Y' || lower(regexp_replace(split_part(split_part(text, chr(10), 1), ' ', 2), '[^A-Za-z]', '', 'g'))] AS authors,
         'N' || d.doc_id || '-' || (2000 + d.doc_id % 23) || '-Title' AS dir_name, CASE WHEN d.doc_id % 13 <> 0 THEN text END AS md_text, n_chars
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

GRAPH = """registry AS (
  SELECT o_orderkey AS id, 'D' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS dir_name, CASE WHEN o_orderkey % 19 <> 0 THEN CAST(year(o_orderdate) AS INT) END AS year, '10.1/' || o_orderkey AS doi
  FROM orders WHERE o_orderkey % 3 <> 0),
edges AS (
  SELECT e.source_id, e.target_doi, r.id AS target_id
  FROM (SELECT DISTINCT l_orderkey AS source_id, '10.1/' || l_partkey AS target_doi FROM lineitem) e LEFT JOIN registry r ON r.doi = e.target_doi)"""

LOG = """log AS (
  SELECT event_id AS seq, ts, event_type AS category, 'n' || json_extract_string(props, '$.k') AS name, CAST(user_id AS VARCHAR) AS session,
         CASE WHEN event_id % 3 = 0 THEN 'T' || (CAST(json_extract_string(props, '$.k') AS INT) % 7) ELSE '' END AS title, value
  FROM events)"""
