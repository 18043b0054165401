"""Upkeep of a library, each operator against its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import library as o
from .bridge import LIB, lib, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang")


def _i():
    return F.col("doc_id")


def _s():
    return _i().cast("string")


def _notes(spark, sf_dir):
    old = F.when(_i() % 3 == 0, F.lit(" \n ")).when(_i() % 3 == 1, F.concat(F.lit("first "), _s(), F.lit("\n\n")))
    return _docs(spark, sf_dir).select("doc_id", o.notes(old).alias("notes"), o.with_note(old, F.lit("more\n")).alias("after"))


NOTES = "SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN 'first ' || doc_id END AS notes, CASE WHEN doc_id % 3 = 1 THEN 'first ' || doc_id || chr(10) || chr(10) || 'more' ELSE 'more' END AS after FROM documents"


def _contents(spark, sf_dir):
    none = "array<struct<line:int,level:int,title:string>>"
    rows = _docs(spark, sf_dir).select(_s().alias("paper_id"), F.when(_i() % 4 == 0, F.array(F.struct(F.lit(1).alias("line"), F.lit(1).alias("level"), F.lit("old").alias("title")))).otherwise(F.array().cast(none)).alias("toc"))
    heads = _docs(spark, sf_dir).where(_i() % 2 == 0).select(_s().alias("paper_id"), F.explode(F.array(F.struct(F.lit(9).alias("line"), F.lit(1).alias("level"), F.lit("B").alias("title")), F.struct(F.lit(3).alias("line"), F.lit(1).alias("level"), F.lit("A").alias("title")))).alias("h")).select("paper_id", "h.*")
    return o.with_contents(rows, heads).select("paper_id", F.coalesce(F.array_join(F.transform("toc", lambda x: x["title"]), ","), F.lit("")).alias("titles"))


def _renames(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(F.lpad(_s(), 8, "0").alias("paper_id"), F.when(_i() % 5 == 0, F.lit("Doe-2001-Flow-of-water")).otherwise("x").alias("dir_name"), F.lit("Doe").alias("last_name"), (2001 + _i() % 5).alias("year"), F.lit("Flow of water").alias("title"))
    return o.renames(rows)


RENAMES = """WITH n AS (SELECT lpad(CAST(doc_id AS VARCHAR), 8, '0') AS paper_id, doc_id, 'Doe-' || (2001 + doc_id % 5) || '-Flow-of-water' AS stem, row_number() OVER (PARTITION BY doc_id % 5 ORDER BY doc_id) AS n FROM documents),
m AS (SELECT paper_id, CASE WHEN doc_id % 5 = 0 THEN 'Doe-2001-Flow-of-water' ELSE 'x' END AS dir_name, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS new_name FROM n) SELECT * FROM m WHERE dir_name <> new_name"""


def _registered(spark, sf_dir):
    rows = _docs(spark, sf_dir).where(_i() % 3 != 0).select(_i().alias("id"), F.lit("old").alias("dir_name"))
    return o.registered(rows, _docs(spark, sf_dir).where(_i() % 2 == 0).select(_i().alias("id"), F.lit("new").alias("dir_name")))


def _parts(spark, sf_dir):
    rows = lambda d, tag: d.select((_i() % 7).alias("volume"), (_i() % 20).alias("page"), F.lit(tag).alias("text"), _i().alias("seq"))
    d = _docs(spark, sf_dir)
    present = d.where(_i() % 7 != 6).select((_i() % 7).alias("volume"))
    old = rows(d, "old").dropDuplicates(["volume", "page"]).withColumn("seq", F.lit(0).cast("long"))
    return o.replaced_parts(old, rows(d.where(_i() % 7 < 2), "new"), ["volume"], "page", "seq", present)


PARTS = """WITH d AS (SELECT doc_id % 7 AS volume, doc_id % 20 AS page, max(doc_id) AS seq FROM documents GROUP BY 1, 2)
SELECT volume, page, CASE WHEN volume < 2 THEN 'new' ELSE 'old' END AS text, CASE WHEN volume < 2 THEN seq ELSE 0 END AS seq FROM d WHERE volume <> 6"""


def _volumes(spark, sf_dir):
    return o.volume_dirs(_docs(spark, sf_dir).select(F.concat(F.lit("root/v"), (_i() % 9).cast("string"), F.when(_i() % 2 == 0, "/meta.json").otherwise("/x.md")).alias("path")))


def _backlog(spark, sf_dir):
    files = _docs(spark, sf_dir).select(F.concat(F.lit("d"), (_i() - _i() % 4).cast("string")).alias("dir_name"), F.when(_i() % 4 == 0, "a.PDF").when(_i() % 12 == 1, "paper.md").when(_i() % 12 == 2, "paper_fr.md").otherwise("notes.md").alias("name"))
    return o.pdf_backlog(files)


BACKLOG = """WITH f AS (SELECT 'd' || (doc_id - doc_id % 4) AS dir_name, doc_id FROM documents)
SELECT DISTINCT dir_name FROM f WHERE doc_id % 4 = 0 AND dir_name NOT IN (SELECT dir_name FROM f WHERE doc_id % 12 IN (1, 2))"""


def _attached(spark, sf_dir):
    rows = _docs(spark, sf_dir).select((_i() - _i() % 3).alias("item"), (_i() % 3).alias("nth"), F.concat(F.lit("f"), _s(), F.lit(".pdf")).alias("path"))
    return o.first_attachment(rows, rows.where(F.col("nth") > 0).select("path"))


def _queue(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(_s().alias("stem"), F.when(_i() % 3 == 0, "ok").otherwise("review").alias("status"), F.when(_i() % 3 == 0, "").otherwise("no_doi").alias("issue"), F.lit("k1").alias("duplicate_of"))
    ok, waits = o.queued(rows)
    return ok.select("stem", F.lit("").alias("marker")).union(waits.select("stem", "marker"))


def _repaired(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(_s().alias("stem"), F.when(_i() % 2 == 0, F.lit("T")).otherwise("").alias("title"), F.lit("").alias("doi"), F.concat(F.lit("2001."), _s()).alias("arxiv_id"))
    given = _docs(spark, sf_dir).where(_i() % 3 == 0).select(_s().alias("stem"), F.lit("Given").alias("title"), F.concat(F.lit("https://doi.org/10.4/"), _s()).alias("doi"), F.lit("").alias("arxiv_id"))
    known = _docs(spark, sf_dir).where(_i() % 5 == 0).select(F.when(_i() % 2 == 0, F.concat(F.lit("10.4/"), _s())).otherwise("").alias("doi"), F.when(_i() % 2 == 1, F.concat(F.lit("2001."), _s())).otherwise("").alias("arxiv_id"))
    return o.repaired(rows, given, known)


REPAIRED = """SELECT CAST(doc_id AS VARCHAR) AS stem, CASE WHEN doc_id % 3 = 0 THEN 'Given' WHEN doc_id % 2 = 0 THEN 'T' ELSE '' END AS title, CASE WHEN doc_id % 3 = 0 THEN 'https://doi.org/10.4/' || doc_id ELSE '' END AS doi, '2001.' || doc_id AS arxiv_id
FROM documents WHERE NOT (doc_id % 3 = 0 AND doc_id % 10 = 0) AND NOT (doc_id % 10 = 5)"""


def _listing(spark, sf_dir):
    pair = F.concat(F.lit('<dt><a href="/abs/2401.'), F.lpad(_s(), 5, "0"), F.lit('">x</a></dt><dd><div class="list-title"><span>Title:</span> Flow  of '), "lang", F.lit('</div><div class="list-authors"><a>Ann Bo</a>, <a>Cy '), _s(), F.lit("</a></div></dd>"))
    return o.recent_listing(_docs(spark, sf_dir).select(F.concat(F.lit("<dl>"), pair, pair, F.lit("</dl>")).alias("html")), "of EN ann")


LISTING = "SELECT n::INT AS nth, '2401.' || lpad(CAST(doc_id AS VARCHAR), 5, '0') AS arxiv_id, 'Flow of ' || lang AS title, 'Ann Bo, Cy ' || doc_id AS authors FROM documents, (VALUES (0), (1)) v(n) WHERE contains(lower('Flow of ' || lang || ' Ann Bo Cy ' || doc_id), 'of en ann')"


def _event(spark, sf_dir):
    rows = _docs(spark, sf_dir).select(_i().alias("rank"), F.concat(F.lit("10.1/"), _s()).alias("doi"))
    return o.search_event(rows, "flow", {"year": "2020"}).select("category", "name", "n", F.array_join("top", ",").alias("top"))


def _tags(spark, sf_dir):
    raw = F.concat(F.lit('["a'), _s(), F.lit('", 7, null, {"b": "no"}, "c d"]'))
    return _docs(spark, sf_dir).select("doc_id", F.array_join(o.string_tags(raw), "|").alias("tags"))


def _taxonomy(spark, sf_dir):
    rows = _docs(spark, sf_dir).groupBy(F.col("lang").alias("tag")).agg(F.collect_set("source").alias("aliases")).withColumn("description", F.concat(F.lit('the "'), "tag", F.lit('"')))
    return o.taxonomy_text(rows)


TAXONOMY = """SELECT lang AS tag, lang || ':' || chr(10) || '  aliases: [' || array_to_string([('"' || s || '"') FOR s IN list_sort(list(DISTINCT source))], ', ') || ']' || chr(10) || '  description: "the \\"' || lang || '\\""' || chr(10) AS yaml FROM documents GROUP BY lang"""


def _steps(spark, sf_dir):
    return o.step_figures(_run(spark, sf_dir))


def _run(spark, sf_dir):
    return _docs(spark, sf_dir).select(F.concat(F.lit("step"), (_i() % 3).cast("string")).alias("step"), F.when(_i() % 5 == 0, "failed").otherwise("ok").alias("status"), F.lit(0.5).alias("seconds"))


def _preset(spark, sf_dir):
    o.STEPS.update(even=lambda d: d.where("doc_id % 2 = 0"), plain=lambda d: d.select("doc_id"))
    o.PRESETS["short"] = ["even", "plain"]
    return o.run_steps(_docs(spark, sf_dir), ["short"])


QUERIES = {
    "notes_append": (_notes, NOTES),
    "toc_write": (_contents, "SELECT CAST(doc_id AS VARCHAR) AS paper_id, CASE WHEN doc_id % 4 = 0 THEN 'old' WHEN doc_id % 2 = 0 THEN 'A,B' ELSE '' END AS titles FROM documents"),
    "rename_all": (_renames, RENAMES),
    "registry_quick_update": (_registered, "SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN 'new' ELSE 'old' END AS dir_name FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 <> 0"),
    "index_part_write": (_parts, PARTS),
    "volume_dirs": (_volumes, "SELECT DISTINCT 'v' || (doc_id % 9) AS volume_dir FROM documents WHERE doc_id % 2 = 0"),
    "pdf_backlog": (_backlog, BACKLOG),
    "first_attachment": (_attached, "SELECT doc_id - doc_id % 3 AS item, arg_min('f' || doc_id || '.pdf', doc_id % 3) AS path FROM documents WHERE doc_id % 3 > 0 GROUP BY 1"),
    "pending_move": (_queue, "SELECT CAST(doc_id AS VARCHAR) AS stem, CASE WHEN doc_id % 3 = 0 THEN '' ELSE '{\"issue\":\"no_doi\",\"duplicate_of\":\"k1\"}' END AS marker FROM documents"),
    "repair": (_repaired, REPAIRED),
    "recent_listing": (_listing, LISTING),
    "search_event": (_event, "SELECT 'search' AS category, 'flow' AS name, (SELECT count(*) FROM documents) AS n, (SELECT string_agg('10.1/' || doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 5)) AS top"),
    "string_tags": (_tags, "SELECT doc_id, 'a' || doc_id || '|c d' AS tags FROM documents"),
    "taxonomy_write": (_taxonomy, TAXONOMY),
    "json_emit": (lambda s, d: o.as_json(lib(s, d).select("paper_id", "journal")), f"WITH {LIB} SELECT '{{\"paper_id\":\"' || paper_id || '\",\"journal\":\"' || journal || '\"}}' AS value FROM lib"),
    "pipeline_figures": (_steps, "SELECT 'step' || (doc_id % 3) AS step, CASE WHEN doc_id % 5 = 0 THEN 'failed' ELSE 'ok' END AS status, count(*) AS n, count(*) * 0.5e0 AS seconds FROM documents GROUP BY 1, 2"),
    "run_summary": (lambda s, d: o.run_summary(_run(s, d)), "SELECT count(*) AS total, count(*) FILTER (WHERE doc_id % 5 <> 0) AS success, count(*) FILTER (WHERE doc_id % 5 = 0) AS failure FROM documents"),
    "step_preset": (_preset, "SELECT doc_id FROM documents WHERE doc_id % 2 = 0"),
}
