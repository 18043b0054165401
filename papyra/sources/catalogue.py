"""A paged works catalogue as a data source, filters pushed to the service.

The request itself is a function of a cursor, so tests read recorded pages and
a deployment passes its own client.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThanOrEqual, InputPartition, SimpleDataSourceStreamReader

from ..functions.guards import remote_filter
from .versions import Versions

SCHEMA = "openalex_id string, doi string, title string, abstract string, authors array<string>, year int, cited_by_count bigint, type string"
TRIES, LONGEST_WAIT = 5, 60


def abstract_of(inverted: dict[str, list[int]] | None) -> str:
    """Text of an inverted index, by place and then word."""
    return " ".join(w for _, w in sorted((p, w) for w, places in (inverted or {}).items() for p in places))


def record_of(work: dict) -> tuple:
    import re

    title = re.sub(r"<[^>]+>", "", work.get("title") or "")
    authors = [a["author"]["display_name"] for a in work.get("authorships") or [] if (a.get("author") or {}).get("display_name")]
    doi = re.sub(r"^https?://(dx\.)?doi\.org/", "", work.get("doi") or "")
    return (work.get("id") or "", doi, title, abstract_of(work.get("abstract_inverted_index")), authors, work.get("publication_year"), work.get("cited_by_count") or 0, work.get("type") or "")


def fetched(fetch: Callable[[str], dict], cursor: str = "*", sleep: Callable[[float], None] = time.sleep) -> Iterator[dict]:
    """Works page by page; a failed request is tried again with growing waits."""
    while cursor:
        for attempt in range(TRIES):
            try:
                page = fetch(cursor)
                break
            except OSError:
                if attempt + 1 == TRIES:
                    raise
                sleep(min(LONGEST_WAIT, 2 ** (attempt + 2)))
        yield from page.get("results") or []
        cursor = (page.get("meta") or {}).get("next_cursor") if page.get("results") else None


class _Part(InputPartition):
    def __init__(self, path: str):
        self.path = path


class CatalogueReader(DataSourceReader):
    """``path``: a folder of recorded pages (one JSON each, by name)."""

    def __init__(self, options: dict):
        self.options = dict(options)
        self.pushed: dict = {}

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("type",):
                self.pushed["kind"] = f.value
            elif isinstance(f, EqualTo) and f.attribute == ("year",):
                self.pushed["year"] = str(f.value)
            elif isinstance(f, GreaterThanOrEqual) and f.attribute == ("cited_by_count",):
                self.pushed["min_citations"] = f.value
            else:
                yield f

    def partitions(self):
        import os

        folder = self.options["path"]
        return [_Part(os.path.join(folder, n)) for n in sorted(os.listdir(folder)) if n.endswith(".json")]

    def request_filter(self) -> str:
        return remote_filter(**self.pushed)

    def _passes(self, row: tuple) -> bool:
        p = self.pushed
        return (p.get("kind") in (None, row[7])) and (p.get("year") in (None, str(row[5]))) and row[6] >= p.get("min_citations", 0)

    def read(self, partition):
        with open(partition.path, encoding="utf-8") as f:
            page = json.load(f)
        for work in page.get("results") or []:
            row = record_of(work)
            if self._passes(row):
                yield row


def recorded_page(path: str, cursor: str) -> dict:
    """The page that a recorded catalogue keeps for a cursor: the one file of
    ``<path>/cursor=<cursor>``, in any store that Arrow reads."""
    from urllib.parse import quote

    from pyarrow import fs

    store, folder = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    name = f"{folder.rstrip('/')}/cursor={quote(cursor, safe='')}"
    for info in sorted(store.get_file_info(fs.FileSelector(name)), key=lambda i: i.path):
        if info.is_file and info.base_name[:1] not in "._":
            with store.open_input_stream(info.path) as f:
                return json.loads(f.read())
    raise OSError(f"no page for cursor {cursor}")


class CatalogueStream(SimpleDataSourceStreamReader):
    """A catalogue as a stream whose offset is the cursor of the next page.

    Paging is sequential by nature: a batch asks for ``pages_per_batch`` pages
    one after the other. Options: path, pages_per_batch, limit (works in all).
    """

    def __init__(self, options: dict):
        self.path, self.pages, self.limit = options["path"], int(options.get("pages_per_batch", 8)), int(options.get("limit", 0))

    def initialOffset(self) -> dict:
        return {"cursor": "*", "taken": 0}

    def _pages(self, start: dict, pages: int | None, end: dict | None):
        """Rows from an offset on, and the offset after them."""
        at, rows = dict(start), []
        while at["cursor"] and (pages is None or pages > 0) and at != end and not (self.limit and at["taken"] >= self.limit):
            page = recorded_page(self.path, at["cursor"])
            found = [record_of(w) for w in page.get("results") or []]
            if self.limit:
                found = found[: self.limit - at["taken"]]
            rows += found
            following = (page.get("meta") or {}).get("next_cursor") if found else None
            at = {"cursor": following or "", "taken": at["taken"] + len(found)}
            pages = None if pages is None else pages - 1
        return rows, at

    def read(self, start: dict):
        rows, after = self._pages(start, self.pages, None)
        return iter(rows), after

    def readBetweenOffsets(self, start: dict, end: dict):
        return iter(self._pages(start, None, end)[0])


class CatalogueSource(DataSource):
    @classmethod
    def name(cls):
        return "works_catalogue"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CatalogueReader(self.options)

    def simpleStreamReader(self, schema):
        return CatalogueStream(self.options)


def register(spark) -> None:
    """Make the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(CatalogueSource)


def _identity() -> F.Column:
    """DOI, else the catalogue's id; null for a work with neither."""
    return F.coalesce(F.nullif(F.lower("doi"), F.lit("")), F.nullif(F.col("openalex_id"), F.lit("")))


def silo(spark: SparkSession, path: str) -> DataFrame:
    """Works of a silo, as its newest complete fetch left them."""
    runs = (Versions(spark, path).latest()[1] or {"runs": []})["runs"]
    if not runs:
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json([f"{path}/{r}" for r in runs], recursiveFileLookup=True)


#: Pages that a batch of a fetch asks for: a batch costs about the same for few
#: works as for many, and this many pages (10,000 works or so) fit in the driver.
PAGES_PER_BATCH = 200


def _new_works(known: DataFrame, fetched_rows: DataFrame, limit: int) -> DataFrame:
    """The works of a run (``_batch``, ``_at``: their order) that neither
    ``known`` nor the run before them has, the first ``limit`` if given."""
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    rows = fetched_rows.withColumn("_key", _identity())
    first = rows.where("_key is not null").groupBy("_key").agg(F.min(F.struct("_batch", "_at", *columns)).alias("w"))
    fresh = first.join(known.select(_identity().alias("_key")).where("_key is not null").distinct(), "_key", "left_anti").select("w.*")
    new = fresh.unionByName(rows.where("_key is null").select("_batch", "_at", *columns))
    return new.orderBy("_batch", "_at").limit(limit) if limit else new


def fetch_into(spark: SparkSession, pages: str, path: str, run: str, limit: int = 0, incremental: bool = False, pages_per_batch: int = PAGES_PER_BATCH, batches: int | None = None) -> int:
    """Fetch a catalogue into a silo; the number of works that the run wrote.

    ``run`` names the fetch: called again with the same name it goes on where
    it was interrupted (after ``batches`` batches, if given), without loss and
    without repeats: a batch that is done again overwrites its own folder. The
    silo shows a run when it is complete: in place of what was there, or with
    ``incremental`` beside it, then without works whose DOI, else id, the silo
    or the run has; these are taken out once, after the last page, so a batch
    costs the same however much was fetched before. ``limit`` bounds the works
    written.
    """
    register(spark)
    versions = Versions(spark, path)
    number, before = versions.latest()
    before = before or {"runs": []}
    folder = f"{path}/{run}"
    if run in before["runs"]:
        return spark.read.schema(SCHEMA).json(folder, recursiveFileLookup=True).count()
    made = spark.readStream.format("works_catalogue").option("path", pages).option("pages_per_batch", pages_per_batch)
    rows = (made.option("limit", limit) if limit and not incremental else made).load()
    taken = f"{path}/_fetch/{run}-works" if incremental else folder

    def write(batch: DataFrame, epoch: int) -> None:
        if incremental:
            batch = batch.withColumn("_batch", F.lit(epoch).cast("long")).withColumn("_at", F.monotonically_increasing_id())
        batch.write.mode("overwrite").json(f"{taken}/batch={epoch}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{path}/_fetch/{run}").start()
    try:
        if batches is None:
            query.processAllAvailable()
        else:
            while query.isActive and (query.lastProgress or {"batchId": -1})["batchId"] < batches - 1:
                time.sleep(0.05)
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    if batches is not None:
        return 0
    if incremental:
        works = spark.read.schema(f"{SCHEMA}, _batch bigint, _at bigint").json(taken, recursiveFileLookup=True)
        _new_works(silo(spark, path), works, limit).drop("_batch", "_at").write.mode("overwrite").json(folder)
    versions.commit(number + 1, {"runs": (before["runs"] if incremental else []) + [run]})
    return spark.read.schema(SCHEMA).json(folder, recursiveFileLookup=True).count()
