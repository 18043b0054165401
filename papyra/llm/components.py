"""Connected components of a link table, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_table, materialize


def _followed(parents: DataFrame) -> DataFrame:
    """``node`` and ``root`` with every chain of parents followed to its end;
    each turn doubles the steps."""
    while True:
        ahead = parents.select(F.col("node").alias("up"), F.col("root").alias("further"))
        step = materialize(parents.join(ahead, parents["root"] == ahead["up"], "left").select("node", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "cc-parents")
        drop_table(parents)
        parents = step.select("node", "root")
        parents._papyra_path = step._papyra_path
        if step.where("moved").isEmpty():
            return parents


def connected(links: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node reached) of all linked nodes.

    ``links``: a, b (long). A round points every node to its smallest
    neighbour, follows the pointers and contracts the links to those between
    different roots, so links vanish quickly and no row is made twice. Every
    round ends in written tables.
    """
    links = materialize(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-links")
    found = None
    while not links.isEmpty():
        roots = _followed(materialize(links.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")), "cc-parents"))
        low, high = roots.select(F.col("node").alias("n1"), F.col("root").alias("r1")), roots.select(F.col("node").alias("n2"), F.col("root").alias("r2"))
        ends = links.join(low, F.col("a") == F.col("n1"), "left").join(high, F.col("b") == F.col("n2"), "left").select(F.coalesce("r1", "a").alias("p"), F.coalesce("r2", "b").alias("q"))
        after = materialize(ends.where("p <> q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct(), "cc-links")
        drop_table(links)
        links = after
        if found is None:
            found = roots
        else:
            now = roots.select(F.col("node").alias("up"), F.col("root").alias("further"))
            moved = found.join(now, found["root"] == now["up"], "left").select("node", F.coalesce("further", "root").alias("root"))
            found = materialize(moved.union(roots), "cc-roots")
    if found is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return materialize(found.union(found.select(F.col("root").alias("node"), "root").distinct()), "cc-found")
