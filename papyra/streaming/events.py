"""Streams over the event log (an addition; the log itself is append-only)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor


def weekly_counts(events: DataFrame, late: str | None = "7 days") -> DataFrame:
    """Events per category and week; a week closes ``late`` after its end (None:
    the stream has its watermark already)."""
    marked = events.withWatermark("ts", late) if late else events
    return marked.groupBy(F.window("ts", "7 days", startTime="4 days"), "category").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week_start"), "category", "n")


def unique_events(events: DataFrame, key: str = "seq", late: str = "7 days") -> DataFrame:
    """Events whose key was not seen within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def upsert_batches(stream: DataFrame, state_path: str, key: str, checkpoint: str):
    """A query that keeps the newest row per key: each batch is merged with the
    newest earlier version of the state into a new one, ``<state_path>/v=<epoch>``.
    An epoch that wrote none, or whose version is lost, costs its own rows at
    most; one that is done again overwrites its version. Read with
    :func:`newest_state`."""

    def merge(batch: DataFrame, epoch: int) -> None:
        old = newest_state(batch.sparkSession, state_path, epoch)
        new = batch.groupBy(key).agg(F.max_by(F.struct(*batch.columns), "ts").alias("r")).select("r.*")
        both = new if old is None else old.select(*new.columns).unionByName(new).groupBy(key).agg(F.max_by(F.struct(*new.columns), "ts").alias("r")).select("r.*")
        both.write.mode("overwrite").parquet(f"{state_path}/v={epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).outputMode("append")


def newest_state(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame | None:
    """The newest complete version (below ``before``) that
    :func:`upsert_batches` wrote; None if there is none."""
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{state_path}/{n}/_SUCCESS"))]
    kept = [n for n in done if before is None or n < before]
    return spark.read.parquet(f"{state_path}/v={max(kept)}") if kept else None


class _Newest(StatefulProcessor):
    """The newest (ts, seq) of a key; gives a row whenever it moves on."""

    def __init__(self, ttl_ms: int | None):
        self.ttl = ttl_ms

    def init(self, handle) -> None:
        self.newest = handle.getValueState("newest", "ts timestamp, seq bigint", self.ttl)

    def handleInputRows(self, key, rows, timers):
        best = self.newest.get() if self.newest.exists() else None
        moved = False
        for part in rows:
            for ts, seq in zip(part["ts"], part["seq"]):
                if best is None or (ts, seq) > (best[0], best[1]):
                    best, moved = (ts.to_pydatetime(), int(seq)), True
        if moved:
            self.newest.update(best)
            yield pd.DataFrame({"key": [key[0]], "ts": [best[0]], "seq": [best[1]]})

    def close(self) -> None:
        pass


def newest_rows(stream: DataFrame, key: str, ttl_ms: int | None = None) -> DataFrame:
    """key, ts and seq of a stream's newest row per key, as updates: a row each
    time that a key's newest one changes. State is kept per key in the store of
    the query, survives restarts and, with ``ttl_ms``, is dropped that long after
    a key's last change. Rows with null keys, ts or seq are left out.

    Each task first reduces its rows of a key to one, so a frequent key sends a
    row for each task, not all of its rows. The session needs the RocksDB state
    store (:func:`with_state_store`).
    """
    kinds = {f.name: f.dataType.simpleString() for f in stream.schema}

    def reduced(batches):
        for b in batches:
            yield b.sort_values(["ts", "seq"]).drop_duplicates("key", keep="last")

    rows = stream.select(F.col(key).alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("seq").cast("bigint").alias("seq")).dropna()
    schema = f"key {kinds[key]}, ts timestamp, seq bigint"
    return rows.mapInPandas(reduced, schema).groupBy("key").transformWithStateInPandas(_Newest(ttl_ms), schema, "Update", "ProcessingTime" if ttl_ms else "None")


def with_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
