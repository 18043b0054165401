"""Join hints behind a check of size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .places import written

#: Rows up to which a side is broadcast.
SMALL_ROWS = 20_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it
    is: the planner then shuffles an equi-join or splits a join by pattern."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files give fewer partitions, as a
    table of one large row group does; otherwise as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once however often the body
    names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) among the rows of their keys.

    One sort deals all rows into ranges; a window sees one range of a key, and
    one row for each range of it, so a key that most rows have is no one task's.
    """
    ordered = written(rows.orderBy(*order).withColumn("_o", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_o", 33)), "placed")
    counts = ordered.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = ordered.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy("_o")))
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    return ranked.join(counts, same).withColumn(name, F.col("_before") + F.col("_in")).select(*rows.columns, name)
