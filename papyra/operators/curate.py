"""Quality audit, tags and topics, duplicate routing, merging of sources."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.joins import placed
from ..functions.places import written
from ..functions.text import normal_tag, overlap_ratio

#: Document types without a DOI of their own (fixed values).
DOCUMENT_TYPES = ["document", "technical-report", "lecture-notes", "standard", "book-chapter", "manual", "white-paper", "presentation", "meeting-notes"]
SEVERITY_ORDER = {"error": 0, "warning": 1, "info": 2}
SHORT_TEXT = 200
LEAST_OVERLAP = 0.3


def _empty(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name).cast("string")), F.lit("")) == ""


def audit(records: DataFrame) -> DataFrame:
    """paper_id, severity, rule and message of every rule a record breaks.

    Needs paper_id, dir_name, title, doi, paper_type, abstract, year_text,
    authors, journal, arxiv_id, tags (array), md_text; optional: corrupt,
    unreadable (boolean). A record that could not be parsed has that issue only.
    """
    has = set(records.columns)
    corrupt = F.coalesce(F.col("corrupt"), F.lit(False)) if "corrupt" in has else F.lit(False)
    unreadable = F.coalesce(F.col("unreadable"), F.lit(False)) if "unreadable" in has else F.lit(False)
    named = records.withColumn("_doi", F.lower(F.trim(F.coalesce("doi", F.lit("")))))
    twice = named.where("_doi <> ''").groupBy("_doi").agg(F.count(F.lit(1)).alias("_same")).where("_same > 1")
    rows = named.join(twice, "_doi", "left")
    heading = F.regexp_extract("md_text", r"(?m)^#\s+(.+)$", 1)
    stem = r"^(.+?)-(\d{4})-(.+)$"
    dir_year = F.regexp_extract("dir_name", stem, 2)
    text = F.trim(F.coalesce("md_text", F.lit("")))
    rules = [
        ("missing_md", "error", F.col("md_text").isNull() & ~unreadable),
        ("unreadable_md", "error", unreadable),
        ("missing_title", "error", _empty("title")),
        ("duplicate_doi", "error", F.coalesce(F.col("_same") > 1, F.lit(False))),
        ("missing_doi", "warning", _empty("doi") & ~F.coalesce(F.col("paper_type").isin(DOCUMENT_TYPES), F.lit(False))),
        ("missing_abstract", "warning", _empty("abstract")),
        ("missing_year", "warning", _empty("year_text")),
        ("missing_authors", "warning", _empty("authors")),
        ("missing_journal", "warning", _empty("journal")),
        ("arxiv_id_missing", "warning", F.col("_doi").startswith("10.48550/arxiv.") & _empty("arxiv_id")),
        ("short_md", "warning", F.col("md_text").isNotNull() & (F.length(text) < SHORT_TEXT)),
        ("title_mismatch", "warning", ~_empty("title") & (F.coalesce(heading, F.lit("")) != "") & (overlap_ratio(F.col("title"), heading) < LEAST_OVERLAP)),
        ("filename_year_mismatch", "warning", (dir_year != "") & ~_empty("year_text") & (dir_year != F.col("year_text"))),
        ("untagged", "info", F.coalesce(F.size("tags"), F.lit(0)) <= 0),
        ("nonstandard_filename", "info", ~F.col("dir_name").rlike(stem)),
    ]
    issue = lambda rule, severity: F.struct(F.lit(severity).alias("severity"), F.lit(rule).alias("rule"), F.concat(F.lit(rule), F.lit(": "), F.coalesce("title", F.lit(""))).alias("message"))
    broken = F.array_compact(F.array(*[F.when(~corrupt & F.coalesce(c, F.lit(False)), issue(r, s)) for r, s, c in rules], F.when(corrupt, issue("invalid_json", "error"))))
    return rows.select("paper_id", F.explode(broken).alias("i")).select("paper_id", "i.severity", "i.rule", "i.message")


def severity_counts(issues: DataFrame) -> DataFrame:
    return issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))


def duplicate_doi_groups(records: DataFrame) -> DataFrame:
    """Each member of a shared DOI with the other members."""
    rows = records.where("doi <> ''").select("paper_id", F.lower("doi").alias("doi"))
    groups = rows.groupBy("doi").agg(F.sort_array(F.collect_list("paper_id")).alias("ids")).where(F.size("ids") > 1)
    return groups.select("doi", F.explode("ids").alias("paper_id"), "ids").select("doi", "paper_id", F.array_join(F.array_remove("ids", F.col("paper_id")), ",").alias("others"))


# --- tags ---------------------------------------------------------------------


def resolve_tags(wanted: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """``raw`` with its canonical tag: by lower case first, then normalised."""
    names = taxonomy.select(F.col("tag").alias("canonical"), F.explode(F.concat(F.array("tag"), F.coalesce("aliases", F.array().cast("array<string>")))).alias("name"))
    exact = names.groupBy(F.lower("name").alias("_e")).agg(F.min("canonical").alias("by_name"))
    normal = names.groupBy(normal_tag(F.col("name")).alias("_n")).agg(F.min("canonical").alias("by_form"))
    rows = wanted.join(exact, F.lower(F.trim("raw")) == F.col("_e"), "left").join(normal, normal_tag(F.col("raw")) == F.col("_n"), "left")
    return rows.select("raw", F.coalesce("by_name", "by_form").alias("tag"))


def tag_rows(records: DataFrame) -> DataFrame:
    return records.select("paper_id", F.explode(F.array_distinct("tags")).alias("tag"))


def topic_overview(records: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """Papers and share of every tag in use or in the taxonomy."""
    counts = tag_rows(records).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = records.agg(F.count(F.lit(1)).alias("total"))  # a single row
    rows = taxonomy.select("tag").distinct().join(counts, "tag", "full").join(F.broadcast(total), F.lit(True))
    n = F.coalesce("n", F.lit(0)).cast("long")
    return rows.select("tag", n.alias("papers"), F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(0.0)).alias("share"))


def papers_with_tag(records: DataFrame, tag: str) -> DataFrame:
    return records.where(F.array_contains("tags", tag)).orderBy(F.desc("year_text"), "paper_id")


# --- routing and merging ------------------------------------------------------


SCOPES = ["regular", "thesis", "patent", "document"]
#: Undecided rows that one task may decide in a loop.
LOOP_ROWS = 20_000


def _last_before(asked: DataFrame, given: DataFrame) -> DataFrame:
    """``holder`` of the last row of ``given`` (key, o, holder) before each row
    of ``asked`` (key, o), null without one.

    The high bits of ``o`` (the partition that numbered it) cut a key into
    ranges: a window sees one range of a key, or one row for each range.
    """
    part = F.shiftright("o", 33)
    rows = asked.select("key", "o", F.lit(None).cast("string").alias("holder")).union(given.select("key", "o", "holder")).withColumn("part", part)
    within = Window.partitionBy("key", "part").orderBy("o").rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("key", "part").agg(F.max_by("holder", F.when(F.col("holder").isNotNull(), F.col("o"))).alias("end"))
    earlier = F.last("end", ignorenulls=True).over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    found = rows.withColumn("near", F.last("holder", ignorenulls=True).over(within)).where("holder is null")
    return found.join(ends.select("key", "part", earlier.alias("far")), ["key", "part"]).select("key", "o", F.coalesce("near", "far").alias("holder"))


def _looped(rows: pd.DataFrame) -> pd.DataFrame:
    """``o`` of the rows that are taken in, of rows (o, gives, asks, firsts) one
    by one; firsts: per key asked for, the first row taken in before."""
    held: set[str] = set()
    won = []
    for o, gives, asks, firsts in rows.sort_values("o")[["o", "gives", "asks", "firsts"]].itertuples(index=False):
        if not any(k in held or (f is not None and f == f and f < o) for k, f in zip(asks, firsts)):
            won.append(o)
            held.update(gives)
    return pd.DataFrame({"o": pd.Series(won, dtype="int64")})


def route(candidates: DataFrame, known: DataFrame, doi_first: bool = False) -> DataFrame:
    """status, issue and duplicate_of of every candidate.

    ``candidates``: stem, scope (one of SCOPES, others come last), doi,
    arxiv_id, pub_number, kind; ``known``: id, doi, arxiv_id, pub_number. Rows
    are taken scope by scope, stem by stem (repeated rows: in any order). Only a
    row that is taken in (``ok``) gives its keys to those after it, so what a
    row becomes hangs on what earlier rows with one of its keys became. Rows are
    therefore decided in rounds: one falls as soon as an earlier row that was
    taken in, or a known record, has a key that it is asked for, and is taken
    in when no undecided earlier row has such a key; the last LOOP_ROWS rows
    are decided one by one in a single task. ``duplicate_of`` is the
    last one before it to give the key: a stem, or the largest known id. Of
    several keys the arXiv id is the issue, with ``doi_first`` the DOI.
    """
    spark = candidates.sparkSession
    clean = lambda c: F.lower(F.trim(F.coalesce(c, F.lit(""))))
    doi, scope = clean(F.col("doi")), F.coalesce(F.array_position(F.array(*[F.lit(x) for x in SCOPES]), F.col("scope")), F.lit(0))
    doi = F.when(doi.isin("null", "none", "n/a"), "").otherwise(doi)
    arxiv = lambda c: F.regexp_replace(clean(c), r"v\d+$", "")
    number = lambda c: F.upper(F.trim(F.coalesce(c, F.lit(""))))
    keyed = lambda d, a, p: F.array(F.when(a != "", F.concat(F.lit("arxiv_id:"), a)), F.when(p != "", F.concat(F.lit("publication_number:"), p)), F.when(d != "", F.concat(F.lit("doi:"), d)))
    rows = candidates.select("stem", "scope", F.coalesce("kind", F.lit("")).alias("kind"), doi.alias("d"), arxiv(F.col("arxiv_id")).alias("a"), number(F.col("pub_number")).alias("p"), F.when(scope == 0, 9).otherwise(scope).alias("s"))
    blank, patent, thesis = F.col("d") == "", F.col("scope") == "patent", F.col("scope") == "thesis"
    keys = keyed(F.col("d"), F.col("a"), F.col("p"))
    asked = F.when(thesis, F.slice(keys, 1, 0)).when(patent, F.slice(keys, 2, 1)).when(blank, F.slice(keys, 1, 2)).otherwise(F.array(keys[2], keys[0]) if doi_first else F.array(keys[0], keys[2]))
    free = (F.col("p") != "") | F.col("kind").isin("thesis", "book", "patent") | (F.col("a") != "") | (F.col("scope") == "document")
    review = F.when(patent & (F.col("p") == ""), "no_pub_num").when(~thesis & ~patent & blank & ~free, "no_doi").otherwise("")
    rows = rows.select("stem", "scope", "s", F.array_compact(keys).alias("gives"), F.array_compact(asked).alias("asks"), review.alias("review"))
    rows = written(rows.orderBy("s", "stem").withColumn("o", F.monotonically_increasing_id()), "route")

    held = known.select("id", F.explode(F.array_compact(keyed(F.lower(F.coalesce("doi", F.lit(""))), arxiv(F.col("arxiv_id")), number(F.col("pub_number"))))).alias("key"))
    held = held.groupBy("key").agg(F.max("id").alias("known"))
    first = written(rows.select("o", F.explode("asks").alias("key")).join(held.select("key"), "key").select("o").distinct(), "route-known")
    undecided = rows.join(first, "o", "left_anti").where("review = ''")
    taken = spark.createDataFrame([], "o long")  # those taken in, and so far the smallest of each key
    holders = spark.createDataFrame([], "key string, first long")
    while not undecided.isEmpty():
        if undecided.limit(LOOP_ROWS + 1).count() <= LOOP_ROWS:
            asks = undecided.select("o", "gives", "asks", F.posexplode_outer("asks").alias("n", "key")).join(holders, "key", "left")
            each = asks.groupBy("o").agg(F.first("gives").alias("gives"), F.first("asks").alias("asks"), F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "first"))), lambda x: x["first"]).alias("firsts"))
            taken = written(taken.union(each.withColumn("_all", F.lit("all")).groupBy("_all").applyInPandas(_looped, "o long")), "route-taken")
            break
        gives = undecided.select("o", F.explode("gives").alias("key"))
        open_ = gives.groupBy("key").agg(F.min("o").alias("waits")).join(holders, "key", "full")
        state = undecided.select("o", F.explode_outer("asks").alias("key")).join(open_, "key", "left").groupBy("o").agg(
            F.coalesce(F.max(F.col("first") < F.col("o")), F.lit(False)).alias("falls"), F.coalesce(F.max(F.col("waits") < F.col("o")), F.lit(False)).alias("hangs"))
        state = written(undecided.join(state, "o"), "route-round")
        won = state.where("not falls and not hangs")
        taken = written(taken.union(won.select("o")), "route-taken")
        holders = written(holders.union(won.select(F.explode("gives").alias("key"), F.col("o").alias("first"))).groupBy("key").agg(F.min("first").alias("first")), "route-keys")
        undecided = state.where("not falls and hangs").select(*rows.columns)

    given = rows.join(taken, "o").select(F.explode("gives").alias("key"), "o", F.col("stem").alias("holder"))
    lost = rows.join(taken, "o", "left_anti").select("o", F.posexplode("asks").alias("n", "key"))
    # a key counts whose first giver comes before the row; of a row's keys the first that counts is the issue
    by_key = _last_before(lost, given).join(held, "key", "left").select("key", "o", F.coalesce("holder", "known").alias("holder")).where("holder is not null")
    cause = lost.join(by_key, ["key", "o"]).groupBy("o").agg(F.min(F.struct("n", "key", "holder")).alias("c"))
    out = rows.join(cause, "o", "left").join(taken.withColumn("ok", F.lit(True)), "o", "left")
    status = F.when(F.col("review") == "no_pub_num", "review").when(F.col("c").isNotNull(), "duplicate").when(F.col("review") != "", "review").otherwise("ok")
    issue = F.when(status == "duplicate", F.split(F.col("c.key"), ":")[0]).when(status == "review", F.col("review")).otherwise("")
    return out.select("stem", "scope", status.alias("status"), issue.alias("issue"), F.when(status == "duplicate", F.col("c.holder")).alias("duplicate_of"))


def numbered_stems(rows: DataFrame, stem: str = "stem", by: str = "paper_id", taken: DataFrame | None = None) -> DataFrame:
    """``dir_name``: the stem, or with -2, -3 and so on where it is taken, each
    row the first free name in the order of ``by``. ``taken`` (dir_name): names
    that are there already, which may leave gaps.

    The k-th row of a stem gets the k-th number that is free; with the taken
    ones in order, u1 < u2 < ..., that is k plus how many have ui - i < k.
    """
    found = placed(rows, [stem], [stem, by], "_k")
    if taken is None:
        number = F.col("_k")
    else:
        names = taken.select("dir_name").where("dir_name is not null").distinct()
        suffix = F.regexp_extract("dir_name", r"^.+-([1-9]\d{0,8})$", 1)
        plain = names.select(F.col("dir_name").alias("s"), F.lit(1).alias("u"))
        used = plain.union(names.where(suffix != "").select(F.regexp_replace("dir_name", r"-\d+$", ""), suffix.cast("int")).where(suffix.cast("int") > 1))
        used = used.join(rows.select(F.col(stem).alias("s")).distinct(), "s", "left_semi")
        gaps = used.groupBy("s").agg(F.array_sort(F.collect_set("u")).alias("us")).select(F.col("s").alias(stem), F.transform("us", lambda u, i: u - (i + 1)).alias("_gaps"))
        found = found.join(gaps, stem, "left")
        number = F.col("_k") + F.coalesce(F.size(F.filter("_gaps", lambda g: g < F.col("_k"))), F.lit(0))
    return found.withColumn("dir_name", F.when(number == 1, F.col(stem)).otherwise(F.concat_ws("-", stem, number.cast("string")))).drop("_k", "_gaps")


def imported(records: DataFrame, known: DataFrame, names: DataFrame) -> DataFrame:
    """nth, status, issue, duplicate_of and dir_name of records that are taken
    in one after the other: ``records`` has nth, stem and the columns of
    :func:`route` but scope; ``known`` as there; ``names``: dir_name of what is
    there. A known DOI settles a record before its other keys; what is taken in
    gets the first free folder name of its stem."""
    rows = records.withColumn("_stem", F.col("stem")).withColumn("stem", F.lpad(F.col("nth").cast("string"), 20, "0")).withColumn("scope", F.lit("regular"))
    found = route(rows, known, doi_first=True).select(F.col("stem").cast("long").alias("nth"), "status", "issue", "duplicate_of")
    ok = records.select(F.col("nth").cast("long").alias("nth"), "stem").join(found.where("status = 'ok'").select("nth"), "nth", "left_semi")
    given = numbered_stems(ok, by="nth", taken=names).select("nth", "dir_name")
    holder = records.select(F.lpad(F.col("nth").cast("string"), 20, "0").alias("duplicate_of"), F.col("nth").cast("long").alias("_n")).join(given.withColumnRenamed("nth", "_n"), "_n").select("duplicate_of", F.col("dir_name").alias("_holder"))
    out = found.join(holder, "duplicate_of", "left").join(given, "nth", "left")
    status = F.when(F.col("status") == "ok", "ingested").when(F.col("status") == "review", "needs_review").otherwise(F.col("status"))
    return out.select("nth", status.alias("status"), "issue", F.coalesce("_holder", "duplicate_of").alias("duplicate_of"), "dir_name")


#: Order in which the sources fill a field; the first non-empty one counts.
PRECEDENCE = {
    "title": ("crossref", "semantic", "openalex", "local"), "journal": ("crossref", "semantic", "openalex", "local"), "year": ("crossref", "semantic", "openalex", "local"),
    "paper_type": ("crossref", "semantic", "openalex", "local"), "abstract": ("semantic", "local", "crossref", "openalex"),
}


def merge_sources(sources: dict[str, DataFrame], key: str = "paper_id", fields: dict[str, tuple[str, ...]] = PRECEDENCE) -> DataFrame:
    """One record per key of any source, each field from its first source."""
    joined = None
    for name, df in sources.items():
        part = df.select(key, *[F.col(f).alias(f"{name}__{f}") for f in fields if f in df.columns])
        joined = part if joined is None else joined.join(part, key, "full")
    pick = lambda f: F.coalesce(*[F.nullif(F.trim(F.col(f"{s}__{f}").cast("string")), F.lit("")) for s in fields[f] if f"{s}__{f}" in joined.columns], F.lit(""))
    return joined.select(key, *[pick(f).alias(f) for f in fields])


def best_citation(counts: Column) -> Column:
    """Largest of a map's counts, 0 without any."""
    return F.coalesce(F.array_max(F.map_values(counts)), F.lit(0)).cast("long")


def needs_refetch(records: DataFrame, force: bool = False) -> DataFrame:
    """Records with a DOI that lack citations, volume or publisher; all with ``force``."""
    rows = records.where("doi <> ''")
    missing = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    return rows if force else rows.where((F.coalesce("citations", F.lit(0)) == 0) | missing("volume") | missing("publisher"))
