"""Upkeep of a library: notes, contents, names, backlogs, queues, run figures."""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import clean_doi, file_stem
from .curate import numbered_stems


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


# --- notes and contents -------------------------------------------------------


def notes(text: Column) -> Column:
    """A notes file's text, null where it is blank."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    return F.when(bare != "", bare)


def with_note(text: Column, note: Column) -> Column:
    """Notes with one more at their end, a blank line between."""
    old = notes(text)
    return F.when(old.isNull(), notes(note)).otherwise(F.concat(old, F.lit("\n\n"), notes(note)))


def with_contents(records: DataFrame, headings: DataFrame, force: bool = False) -> DataFrame:
    """Records with ``toc`` (array of line, level, title) out of ``headings``
    (paper_id, line, level, title); one that has a toc keeps it unless ``force``."""
    made = headings.groupBy("paper_id").agg(F.sort_array(F.collect_list(F.struct("line", "level", "title"))).alias("_toc"))
    own = F.when(F.size("toc") > 0, F.col("toc"))
    return records.join(made, "paper_id", "left").withColumn("toc", F.coalesce("_toc", own) if force else F.coalesce(own, "_toc")).drop("_toc")


# --- names, registry, index parts ---------------------------------------------


def renames(records: DataFrame) -> DataFrame:
    """paper_id, dir_name and new_name of records (with last_name, year, title)
    whose folder is not named after them; names that clash get numbers."""
    named = records.select("paper_id", "dir_name", file_stem(F.col("last_name"), F.col("year"), F.col("title")).alias("stem"))
    found = numbered_stems(named.withColumnRenamed("dir_name", "_old")).withColumnRenamed("dir_name", "new_name")
    return found.where("_old <> new_name").select("paper_id", F.col("_old").alias("dir_name"), "new_name")


def registered(registry: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """Registry rows with those of ``changes`` in place of their own, and new ones."""
    return registry.join(changes.select(key), key, "left_anti").unionByName(changes)


def replaced_parts(index: DataFrame, new: DataFrame, part: list[str], row: str, order: str, present: DataFrame | None = None) -> DataFrame:
    """An index with whole parts (a volume, a tool's version) replaced: parts of
    ``new`` lose their old rows, parts not in ``present`` go, and of new rows
    with one name the last by ``order`` counts."""
    kept = index.join(new.select(*part).distinct(), part, "left_anti")
    if present is not None:
        kept = kept.join(present.select(*part).distinct(), part, "left_semi")
    last = F.row_number().over(Window.partitionBy(*part, row).orderBy(F.desc(order)))
    return kept.unionByName(new.withColumn("_n", last).where("_n = 1").drop("_n"))


def volume_dirs(paths: DataFrame) -> DataFrame:
    """Folders of volumes: those that hold a meta.json directly."""
    return paths.select(F.regexp_extract("path", r"([^/]+)/meta\.json$", 1).alias("volume_dir")).where("volume_dir <> ''").distinct().orderBy("volume_dir")


# --- queues -------------------------------------------------------------------


def pdf_backlog(files: DataFrame) -> DataFrame:
    """Folders (dir_name, name) with a PDF and no text."""
    texts = files.where(F.col("name").rlike(r"^paper.*\.md$")).select("dir_name")
    return files.where(F.lower("name").endswith(".pdf")).select("dir_name").distinct().join(texts, "dir_name", "left_anti")


def first_attachment(attachments: DataFrame, files: DataFrame) -> DataFrame:
    """item and path of the first attached PDF (item, nth, path) that exists."""
    there = attachments.where(F.lower("path").endswith(".pdf")).join(files.select("path").distinct(), "path", "left_semi")
    return there.groupBy("item").agg(F.min_by("path", "nth").alias("path"))


def queued(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that go on, rows that wait with their marker as JSON)."""
    marker = F.to_json(F.struct("issue", "duplicate_of"))
    return routed.where("status = 'ok'"), routed.where("status <> 'ok'").select("stem", "issue", marker.alias("marker"))


def repaired(targets: DataFrame, given: DataFrame, known: DataFrame) -> DataFrame:
    """Targets (stem, title, doi, arxiv_id) with gaps filled from ``given`` (the
    same columns); those whose DOI or arXiv id the library has are refused."""
    rows = targets.join(given.select("stem", *[F.col(c).alias(f"_{c}") for c in ("title", "doi", "arxiv_id")]), "stem", "left")
    filled = lambda c: F.coalesce(F.when(~_blank(F.col(f"_{c}")), F.col(f"_{c}")), F.col(c), F.lit("")).alias(c)
    rows = rows.select("stem", filled("title"), filled("doi"), filled("arxiv_id"))
    dois = known.select(F.nullif(clean_doi(F.col("doi")), F.lit("")).alias("_d"))
    ids = known.select(F.nullif(F.lower("arxiv_id"), F.lit("")).alias("_a"))
    return rows.join(dois, clean_doi(F.col("doi")) == F.col("_d"), "left_anti").join(ids, F.lower("arxiv_id") == F.col("_a"), "left_anti")


# --- listings, events, figures ------------------------------------------------


def recent_listing(pages: DataFrame, query: str = "") -> DataFrame:
    """nth, arxiv_id, title and authors of a listing's dt/dd pairs; only those
    whose title and authors, joined by blanks, contain the whole query."""
    dt = F.regexp_extract_all("html", F.lit(r"(?is)<dt>.*?/abs/([^\"'\s>]+)"), F.lit(1))
    dd = F.regexp_extract_all("html", F.lit(r"(?is)<dd>(.*?)</dd>"), F.lit(1))
    rows = pages.select(F.posexplode(F.arrays_zip(dt.alias("id"), dd.alias("dd"))).alias("nth", "x"))
    plain = lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.regexp_extract("x.dd", p, 1), r"<[^>]+>", ""), r"\s+", " "))
    rows = rows.select("nth", F.col("x.id").alias("arxiv_id"), plain(r"(?is)Title:</span>(.*?)</div>").alias("title"), plain(r"(?is)list-authors[^>]*>(.*?)</div>").alias("authors"))
    names = F.regexp_replace("authors", r"\s*,\s*", " ")
    return rows.where(F.contains(F.lower(F.concat_ws(" ", "title", names)), F.lit(query.lower()))) if query else rows


def search_event(results: DataFrame, query: str, filters: dict[str, str] | None = None) -> DataFrame:
    """One event row of a search: its words, hits, first five DOIs and filters."""
    top = F.slice(F.transform(F.sort_array(F.collect_list(F.struct("rank", "doi"))), lambda x: x["doi"]), 1, 5)
    return results.groupBy().agg(F.count(F.lit(1)).alias("n"), top.alias("top")).select(F.lit("search").alias("category"), F.lit(query).alias("name"), "n", "top", F.lit(str(sorted((filters or {}).items()))).alias("filters"))


def string_tags(raw: Column) -> Column:
    """The texts of a JSON list, other kinds of entries dropped."""
    flat = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"\{[^}]*\}", ""), r"^\s*\[|\]\s*$", "")
    return F.regexp_extract_all(flat, F.lit(r'"((?:[^"\\]|\\.)*)"'), F.lit(1))


def taxonomy_text(taxonomy: DataFrame) -> DataFrame:
    """tag and its block of a sorted YAML file."""
    quoted = lambda c: F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2)
    aliases = F.concat(F.lit("["), F.array_join(F.transform(F.sort_array("aliases"), quoted), ", "), F.lit("]"))
    return taxonomy.select("tag", F.concat("tag", F.lit(":\n  aliases: "), aliases, F.lit("\n  description: "), quoted(F.col("description")), F.lit("\n")).alias("yaml")).orderBy("tag")


def as_json(rows: DataFrame) -> DataFrame:
    return rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("value"))


def step_figures(log: DataFrame) -> DataFrame:
    """Files by step and status with their seconds (step, status, seconds)."""
    return log.groupBy("step", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))


def run_summary(log: DataFrame) -> DataFrame:
    return log.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "ok").alias("success"), F.count_if(F.col("status") != "ok").alias("failure"))


#: Steps by name, and the lists of steps that have names of their own.
STEPS: dict[str, Callable[[DataFrame], DataFrame]] = {}
PRESETS: dict[str, list[str]] = {}


def run_steps(df: DataFrame, names: list[str]) -> DataFrame:
    """Steps, or the steps of presets, one after the other."""
    for name in [s for n in names for s in PRESETS.get(n, [n])]:
        if name not in STEPS:
            raise ValueError(f"no such step: {name!r}")
        df = df.transform(STEPS[name])
    return df


@contextmanager
def timed(events: list[dict], name: str):
    """Adds an event with the seconds of the block, and whether it failed."""
    began, status = time.perf_counter(), "ok"
    try:
        yield
    except Exception:
        status = "error"
        raise
    finally:
        events.append({"category": "step", "name": name, "status": status, "seconds": time.perf_counter() - began})
