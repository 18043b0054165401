"""Behaviour over the event log: keywords, reading, trends, windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Words that say nothing about a query (fixed values).
STOP_WORDS = ["a", "an", "the", "of", "in", "on", "at", "to", "for", "with", "by", "and", "or", "is", "are", "was", "were", "be", "been", "have", "has", "do", "does", "this", "that", "it", "its", "from", "as", "via", "using", "based"]
PUNCTUATION = r"""["',.:;!?()\[\]{}]"""


def hot_keywords(queries: DataFrame, top_k: int = 10) -> DataFrame:
    """keyword and n; ties by first appearance. ``queries``: seq, query."""
    words = queries.select("seq", F.posexplode(F.split(F.lower("query"), r"\s+")).alias("place", "raw"))
    words = words.withColumn("keyword", F.regexp_replace("raw", f"^{PUNCTUATION}+|{PUNCTUATION}+$", ""))
    words = words.where((F.length("keyword") > 1) & ~F.col("keyword").isin(STOP_WORDS))
    found = words.groupBy("keyword").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("seq", "place")).alias("first"))
    return found.orderBy(F.desc("n"), "first").limit(top_k).select("keyword", "n")


def most_read(events: DataFrame, library: DataFrame | None = None, top_k: int = 10) -> DataFrame:
    """title and n. A name's title is that of its first event which has one,
    else the library's, else the name; names of one title count together."""
    by_name = events.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min_by("title", F.when(F.col("title") != "", F.col("seq"))).alias("first_title"))
    if library is not None:
        by_name = by_name.join(library.select(F.col("dir_name").alias("name"), F.col("title").alias("lib_title")), "name", "left")
    else:
        by_name = by_name.withColumn("lib_title", F.lit(None).cast("string"))
    title = F.coalesce(F.nullif("first_title", F.lit("")), F.nullif("lib_title", F.lit("")), "name")
    return by_name.groupBy(title.alias("title")).agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "title").limit(top_k)


def iso_week(ts):
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


def weekly_trend(events: DataFrame, column: str = "ts") -> DataFrame:
    """ISO week and number of events; texts that are no timestamp are left out."""
    ts = F.col(column)
    if dict(events.dtypes)[column] == "string":
        ts = F.try_to_timestamp(F.regexp_replace(ts, "Z$", "+00:00"))
    return events.where(ts.isNotNull()).groupBy(iso_week(ts).alias("week")).agg(F.count(F.lit(1)).alias("n"))


def recent_unique(events: DataFrame, limit: int = 10) -> DataFrame:
    """Names in order of their newest event."""
    return events.groupBy("name").agg(F.max("seq").alias("last_seq")).orderBy(F.desc("last_seq")).limit(limit)


def query_events(events: DataFrame, category: str | None = None, since=None, until=None, limit: int = 200) -> DataFrame:
    """Newest first; both bounds are inclusive."""
    if category:
        events = events.where(F.col("category") == category)
    if since is not None:
        events = events.where(F.col("ts") >= F.lit(since).cast(dict(events.dtypes)["ts"]))
    if until is not None:
        events = events.where(F.col("ts") <= F.lit(until).cast(dict(events.dtypes)["ts"]))
    return events.orderBy(F.desc("seq")).limit(limit)


def distinct_names(events: DataFrame) -> DataFrame:
    return events.where("name is not null and name <> ''").select("name").distinct()


def totals(events: DataFrame) -> DataFrame:
    """Calls, tokens and seconds per category, absent numbers as 0."""
    zero = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return events.groupBy("category").agg(F.count(F.lit(1)).alias("calls"), zero("tokens_in").alias("tokens_in"), zero("tokens_out").alias("tokens_out"), zero("duration_s").alias("seconds"))


def workspace_counts(members: DataFrame) -> DataFrame:
    return members.groupBy("ws").agg(F.count("id").alias("n"))


def running_share(events: DataFrame) -> DataFrame:
    """Each event's number in its session."""
    return events.withColumn("nth", F.row_number().over(Window.partitionBy("session").orderBy("seq")))
