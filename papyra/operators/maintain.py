"""Incremental index maintenance: change detection, upsert, collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def content_hash(*columns: str):
    return F.substring(F.md5(F.concat_ws("\n", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])), 1, 12)


def changed(records: DataFrame, state: DataFrame, key: str = "paper_id") -> DataFrame:
    """Records whose hash is new or differs. Both have the key and ``h``."""
    old = state.select(key, F.col("h").alias("_old"))
    return records.join(old, key, "left").where(F.col("_old").isNull() | (F.col("_old") != F.col("h"))).drop("_old")


def stale(records: DataFrame, state: DataFrame, key: str = "paper_id") -> DataFrame:
    return state.join(records.select(key), key, "left_anti").select(key)


def upserted(records: DataFrame, state: DataFrame, key: str = "paper_id") -> DataFrame:
    """State after a run: changed rows replaced, stale ones gone."""
    same = state.join(records.select(key), key, "left_semi").join(changed(records, state, key).select(key), key, "left_anti")
    return same.select(*state.columns).unionByName(changed(records, state, key).select(*state.columns))


def appended(new: DataFrame, existing: DataFrame, key: str = "id") -> DataFrame:
    """Rows of a fetch that a silo lacks, one per key (the last one), titled."""
    last = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("seq")))
    rows = new.where("title <> ''").withColumn("_n", last).where("_n = 1").drop("_n")
    return rows.join(existing.select(key), key, "left_anti")


def unique_keys(records: DataFrame, column: str, order: str, keep_row: bool) -> DataFrame:
    """The first row by ``order`` keeps a key; later ones lose it ('' when
    ``keep_row``) or are dropped."""
    blank = F.coalesce(F.col(column), F.lit("")) == ""
    own = F.when(blank, F.concat(F.lit("\0"), F.col(order).cast("string"))).otherwise(F.col(column))  # rows without a key are dealt like others
    n = F.row_number().over(Window.partitionBy(own).orderBy(order))
    rows = records.withColumn("_n", F.when(blank, 1).otherwise(n))
    if keep_row:
        return rows.withColumn(column, F.when(F.col("_n") == 1, F.col(column)).otherwise("")).drop("_n")
    return rows.where("_n = 1").drop("_n")


def replace_edges(old: DataFrame, new: DataFrame, replace_empty: bool = False, seen: DataFrame | None = None) -> DataFrame:
    """Edges of re-read sources replaced; a source that has none any more keeps
    its old edges unless ``replace_empty`` (then ``seen`` names the re-read)."""
    gone = new.select("source_id").distinct()
    if replace_empty and seen is not None:
        gone = gone.union(seen.select("source_id")).distinct()
    return old.join(gone, "source_id", "left_anti").unionByName(new)


def rejoined_abstract(words: DataFrame) -> DataFrame:
    """id and text of inverted indexes: id, word, positions array."""
    placed = words.select("id", "word", F.explode("positions").alias("place"))
    return placed.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("text"))
