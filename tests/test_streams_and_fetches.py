"""Streams that are interrupted, and catalogue fetches."""

import json
import shutil

from pyspark.sql import functions as F

from papyra.sources import catalogue
from papyra.streaming import events


def batches(spark, tmp_path, name, groups):
    """A file stream with a file for each group of (key, ts, seq)."""
    folder = tmp_path / name
    for k, rows in enumerate(groups):
        spark.createDataFrame(rows, "key string, ts string, seq long").select("key", F.to_timestamp("ts").alias("ts"), "seq").coalesce(1).write.parquet(f"{folder}/b{k}")
    return spark.readStream.schema("key string, ts timestamp, seq long").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")


GROUPS = [[("a", "2024-01-01", 1), ("b", "2024-01-05", 2), (None, "2024-01-09", 9)], [("a", "2024-01-03", 3), ("b", "2024-01-02", 4), ("a", "2024-01-03", 5)], [("c", "2024-01-01", 6), ("a", "2024-01-02", 7)]]
WANT = {("a", 5), ("b", 2), ("c", 6)}


def test_upserts_survive_restarts_and_lost_versions(spark, tmp_path):
    source = batches(spark, tmp_path, "in", GROUPS[:2])
    state, check = f"{tmp_path}/state", f"{tmp_path}/cp"
    run = lambda s: events.upsert_batches(s, state, "key", check).trigger(availableNow=True).start().awaitTermination()
    run(source.where("key is not null"))
    before = {(r.key, r.seq) for r in events.newest_state(spark, state).collect()}
    assert {k for k, _ in before} == {"a", "b"} and ("b", 2) in before
    shutil.copytree(f"{state}/v=1", f"{state}/v=0", dirs_exist_ok=True)
    shutil.rmtree(f"{state}/v=1")  # a version is lost: the one before it counts
    batches(spark, tmp_path, "in/more", GROUPS[2:])
    more = spark.readStream.schema(source.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    events.upsert_batches(more.where("key is not null"), state, "key", f"{tmp_path}/cp2").trigger(availableNow=True).start().awaitTermination()
    got = {(r.key, r.ts.day) for r in events.newest_state(spark, state).collect()}
    assert got == {("a", 3), ("b", 5), ("c", 1)}
    assert events.newest_state(spark, f"{tmp_path}/none") is None


def test_newest_rows_keep_their_state_over_restarts(spark, tmp_path):
    events.with_state_store(spark)
    folder = tmp_path / "in"

    def run(groups, k):
        for j, rows in enumerate(groups):
            spark.createDataFrame(rows, "key string, ts string, seq long").select("key", F.to_timestamp("ts").alias("ts"), "seq").coalesce(1).write.parquet(f"{folder}/{k}{j}")
        source = spark.readStream.schema("key string, ts timestamp, seq long").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder))
        found = events.newest_rows(source, "key")
        write = lambda b, e: b.write.mode("overwrite").parquet(f"{tmp_path}/out/{e}")
        q = found.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()

    run(GROUPS[:2], "x")
    run(GROUPS[2:], "y")  # a new query goes on with the state of the first
    rows = spark.read.option("recursiveFileLookup", True).parquet(f"{tmp_path}/out")
    newest = {(r.key, r.s) for r in rows.groupBy("key").agg(F.max_by("seq", F.struct("ts", "seq")).alias("s")).collect()}
    assert newest == WANT
    assert sorted(r.seq for r in rows.collect()) == [1, 2, 5, 6]  # nothing for rows that are older than the newest


def recorded(tmp_path, works, size=3):
    pages = [works[k : k + size] for k in range(0, len(works), size)]
    for k, page in enumerate(pages):
        name = tmp_path / "pages" / ("cursor=" + ("%2A" if k == 0 else f"c{k}"))
        name.mkdir(parents=True)
        (name / "part-0.txt").write_text(json.dumps({"results": page, "meta": {"next_cursor": f"c{k + 1}" if k + 1 < len(pages) else None}}))
    return f"file://{tmp_path}/pages"


def work(k, doi=None):
    return {"id": f"W{k}", "title": f"<b>T</b> {k}", "doi": f"https://doi.org/{doi}" if doi else None, "publication_year": 2000 + k, "type": "article"}


def ids(spark, silo):
    return sorted(r.openalex_id for r in catalogue.silo(spark, silo).collect())


def test_an_interrupted_fetch_goes_on_without_loss_or_repeats(spark, tmp_path):
    pages, silo = recorded(tmp_path, [work(k) for k in range(20)]), f"file://{tmp_path}/silo"
    catalogue.fetch_into(spark, pages, silo, "one", pages_per_batch=2, batches=1)
    assert ids(spark, silo) == []  # not complete, so not shown
    assert catalogue.fetch_into(spark, pages, silo, "one", pages_per_batch=2) == 20
    assert ids(spark, silo) == sorted(f"W{k}" for k in range(20))
    assert catalogue.fetch_into(spark, pages, silo, "one") == 20  # done before
    assert catalogue.fetch_into(spark, pages, silo, "two", limit=7, pages_per_batch=2) == 7
    assert ids(spark, silo) == sorted(f"W{k}" for k in range(7))  # a plain fetch replaces


def test_an_incremental_fetch_adds_what_is_new(spark, tmp_path):
    silo = f"file://{tmp_path}/silo"
    first = recorded(tmp_path / "a", [work(0, "10.1/A"), work(1), work(2, "10.1/c")])
    catalogue.fetch_into(spark, first, silo, "one")
    more = recorded(tmp_path / "b", [work(7, "10.1/a"), work(1, ""), work(3), work(4, "10.1/d"), work(5, "10.1/D"), work(3), work(6)])
    assert catalogue.fetch_into(spark, more, silo, "two", incremental=True, pages_per_batch=1) == 3
    assert ids(spark, silo) == ["W0", "W1", "W2", "W3", "W4", "W6"]
    more = recorded(tmp_path / "c", [work(k) for k in range(10, 20)])
    assert catalogue.fetch_into(spark, more, silo, "three", incremental=True, limit=4, pages_per_batch=1) == 4
    assert len(ids(spark, silo)) == 10


def test_a_batch_of_an_incremental_fetch_reads_nothing_that_was_fetched(spark, tmp_path, monkeypatch):
    """The silo is looked at once, after the last of many batches."""
    silo, looked = f"file://{tmp_path}/silo", []
    monkeypatch.setattr(catalogue, "silo", lambda *a, f=catalogue.silo: looked.append(a) or f(*a))
    first = recorded(tmp_path / "a", [work(k) for k in range(4)])
    catalogue.fetch_into(spark, first, silo, "one")
    more = recorded(tmp_path / "b", [work(k % 9) for k in range(24)])
    catalogue.fetch_into(spark, more, silo, "two", incremental=True, pages_per_batch=1, batches=2)
    assert catalogue.fetch_into(spark, more, silo, "two", incremental=True, pages_per_batch=1) == 5
    assert len(looked) == 1
    assert ids(spark, silo) == [f"W{k}" for k in range(9)]
