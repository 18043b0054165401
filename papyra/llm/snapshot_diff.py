"""Difference of two snapshots of a table, rekeyed rows found by their content.

Rows with equal keys pair. What is left pairs by content: the i-th smallest
earlier key of a content with its i-th largest later key. Each content has one
order-statistic tree a side, cut into key ranges: the leaves are the rows of a
content in one narrow range of keys, the nodes above them, and the root, hold
counts by range. The rank of a row is its place in the leaf plus the counts of
the leaves and nodes before it; selecting the i-th later key for the i-th
earlier one is an equi-join on content and rank. No task sees more of a content
than one leaf, and leaves are even shares of all keys, so a content that most
rows have is spread like any other. Only digests are shuffled, no texts.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

#: Children of the root and of a node (leaves: its square) at the least.
FAN = 16
#: Stands for the digest of a null.
ABSENT = bytes(32)


def _digest(column: str, kind: str) -> Column:
    value = F.col(column) if kind in ("string", "binary") else F.col(column).cast("string")
    return F.unhex(F.sha2(value.cast("binary"), 256))


def row_sha256(columns: list[str]) -> Column:
    """Digest of a row as the lines of its columns, nulls as ``~``."""
    return F.sha2(F.concat_ws("\n", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("~")) for c in columns]).cast("binary"), 256)


def _narrow(rows: DataFrame, key: str, columns: list[str], side: int) -> DataFrame:
    """key, side, digests of the columns, of the content and of the row."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    parts = F.array(*[_digest(f"`{c}`", kinds[c]) for c in columns])
    shown = row_sha256(columns) if side else F.lit(None).cast("string")
    found = rows.select(F.col(f"`{key}`").cast("long").alias("key"), F.lit(side).alias("side"), parts.alias("parts"), F.unhex(shown).alias("row"))
    content = F.unhex(F.sha2(F.concat(*[F.coalesce(F.get("parts", F.lit(i)), F.lit(ABSENT)) for i in range(len(columns))]), 256))
    return found.withColumn("content", content)


def _ranked(rows: DataFrame, fan: int) -> DataFrame:
    """``rank`` of every row by key among the rows of its side and content, and
    the ``total`` of those, through trees of counts.

    The split points of the ranges are ``fan * fan - 1`` quantiles of all keys:
    that many numbers go to the driver, whatever the number of rows.
    """
    cuts = rows.agg(F.percentile_approx("key", [i / fan**2 for i in range(1, fan**2)], 20_000)).first()[0]
    cuts = [int(c) for c in cuts or []]
    if cuts:
        upper, lower = F.lit(cuts[fan - 1 :: fan]), F.array(*[F.lit(cuts[fan * j : fan * j + fan - 1]) for j in range(fan)])
        rows = rows.withColumn("node", F.size(F.filter(upper, lambda b: b < F.col("key"))))
        rows = rows.withColumn("leaf", F.size(F.filter(F.get(lower, F.col("node")), lambda b: b < F.col("key"))))
    else:
        rows = rows.withColumns({"node": F.lit(0), "leaf": F.lit(0)})
    tree, path = ["side", "content"], ["side", "content", "node", "leaf"]
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    leaves = rows.groupBy(*path).agg(F.count("*").alias("n"))
    leaves = leaves.withColumns({"in_node": F.coalesce(F.sum("n").over(before([*tree, "node"], "leaf")), F.lit(0))})
    nodes = leaves.groupBy(*tree, "node").agg(F.sum("n").alias("m"))
    nodes = nodes.withColumns({"in_tree": F.coalesce(F.sum("m").over(before(tree, "node")), F.lit(0)), "total": F.sum("m").over(Window.partitionBy(*tree))})
    counts = leaves.join(nodes, [*tree, "node"]).select(*path, (F.col("in_node") + F.col("in_tree")).alias("ahead"), "total")
    place = F.row_number().over(Window.partitionBy(*path).orderBy("key"))
    return rows.withColumn("place", place).join(counts, path).withColumn("rank", F.col("ahead") + F.col("place"))


def snapshot_diff(earlier: DataFrame, later: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``key``, ``old_key``, ``op``, ``changed`` and ``row_sha256``.

    op: ``same`` and ``update`` for equal keys (``changed``: the columns that
    differ, in the order given), ``rekey`` for rows paired by content,
    ``insert`` and ``delete`` for what stays alone. Nulls equal nulls only. A
    key that occurs twice or more in a snapshot, or is null, identifies no row:
    all its rows are matched by content alone, where null keys come before all
    others. Equal rows of one key are interchangeable. Columns beside ``key``
    and ``columns`` are not read; empty snapshots give inserts or deletes only.
    """
    spark = earlier.sparkSession
    fan = max(FAN, math.isqrt(int(spark.conf.get("spark.sql.shuffle.partitions"))))
    both = _narrow(earlier, key, columns, 0).unionByName(_narrow(later, key, columns, 1))
    of = lambda side: F.max(F.when(F.col("side") == side, F.struct("parts", "row", "content")))
    count = lambda side: F.count(F.when(F.col("side") == side, 1))
    keys = materialize(both.groupBy("key").agg(count(0).alias("n0"), count(1).alias("n1"), of(0).alias("old"), of(1).alias("new")), "diff-keys")
    once = F.col("key").isNotNull() & (F.col("n0") <= 1) & (F.col("n1") <= 1)

    differ = F.array_join(F.array_compact(F.array(*[F.when(~F.get("old.parts", F.lit(i)).eqNullSafe(F.get("new.parts", F.lit(i))), c) for i, c in enumerate(columns)])), ",")
    paired = keys.where(once & (F.col("n0") == 1) & (F.col("n1") == 1)).select("key", F.col("key").alias("old_key"), differ.alias("changed"), F.col("new.row").alias("row"))
    paired = paired.select("key", "old_key", F.when(F.col("changed") == "", "same").otherwise("update").alias("op"), "changed", "row")

    side = F.when(F.col("n0") == 1, 0).otherwise(1)
    alone = keys.where(once & (F.col("n0") + F.col("n1") == 1)).withColumn("side", side)
    alone = alone.select("side", "key", F.coalesce("old.content", "new.content").alias("content"), F.col("new.row").alias("row"))
    unclear = keys.where(~once).select(F.col("key").alias("k"))
    if not unclear.isEmpty():
        alone = materialize(alone.unionByName(both.join(unclear, F.col("key").eqNullSafe(F.col("k")), "left_semi").select("side", "key", "content", "row")), "diff-alone")

    ranked = _ranked(alone, fan)
    old = ranked.where("side = 0").select(F.col("content").alias("c0"), F.col("rank").alias("i0"), F.col("key").alias("k0"), F.lit(1).alias("is_old"))
    new = ranked.where("side = 1").select(F.col("content").alias("c1"), (F.col("total") + 1 - F.col("rank")).alias("i1"), F.col("key").alias("k1"), "row", F.lit(1).alias("is_new"))
    met = old.join(new, (F.col("c0") == F.col("c1")) & (F.col("i0") == F.col("i1")), "full")
    op = F.when(F.col("is_old").isNull(), "insert").when(F.col("is_new").isNull(), "delete").otherwise("rekey")
    by_content = met.select(F.when(F.col("is_new").isNull(), F.col("k0")).otherwise(F.col("k1")).alias("key"), F.col("k0").alias("old_key"), op.alias("op"), F.lit("").alias("changed"), "row")
    return paired.unionByName(by_content).withColumn("row", F.lower(F.hex("row"))).withColumnRenamed("row", "row_sha256")


def later_snapshot(docs: DataFrame) -> DataFrame:
    """A later state of ``documents`` by the CRC-32 of the decimal doc_id
    modulo 10: 0 drops the row, 1 appends ``+`` to the text, 2 swaps lang and
    source, 3 changes the key to -1 - key, 4 does so without a source, 5 adds a
    copy under that key. Rows without an id stay."""
    kind = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10, F.lit(9))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").withColumn("kind", kind).where("kind <> 0")
    copy = F.explode(F.when(F.col("kind") == 5, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    d = d.withColumn("copy", copy)
    swapped = F.col("kind") == 2
    return d.select(
        F.when(F.col("kind").isin(3, 4) | F.col("copy"), -1 - F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id"),
        F.when(F.col("kind") == 1, F.concat(F.coalesce("text", F.lit("")), F.lit("+"))).otherwise(F.col("text")).alias("text"),
        F.when(swapped, F.col("source")).otherwise(F.col("lang")).alias("lang"),
        F.when(swapped, F.col("lang")).when(F.col("kind") != 4, F.col("source")).alias("source"),
    )


def documents_diff(docs: DataFrame) -> DataFrame:
    """:func:`snapshot_diff` of ``documents`` and :func:`later_snapshot`."""
    return snapshot_diff(docs, later_snapshot(docs), "doc_id", ["text", "lang", "source"])


#: CRC-32 bit by bit (no such function in SQL), then the same difference.
ORACLE_SQL = """
WITH keyed AS (
  SELECT doc_id AS k, text, lang, source,
         CAST(xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
           lambda c, b: list_reduce(list_concat([xor(c, b)], [CAST(0 AS BIGINT) FOR z IN range(8)]),
             lambda x, z: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)))) % 10 AS INT) AS m
  FROM documents),
later AS (
  SELECT CASE WHEN m IN (3, 4) THEN -1 - k ELSE k END AS k, CASE WHEN m = 1 THEN coalesce(text, '') || '+' ELSE text END AS text,
         CASE WHEN m = 2 THEN source ELSE lang END AS lang, CASE WHEN m = 2 THEN lang WHEN m <> 4 THEN source END AS source
  FROM keyed WHERE m <> 0
  UNION ALL SELECT -1 - k, text, lang, source FROM keyed WHERE m = 5),
sha AS (SELECT *, sha256(coalesce(text, '~') || chr(10) || coalesce(lang, '~') || chr(10) || coalesce(source, '~')) AS row_sha256 FROM later),
pairs AS (
  SELECT n.k AS key, o.k AS old_key,
         concat_ws(',', CASE WHEN o.text IS DISTINCT FROM n.text THEN 'text' END, CASE WHEN o.lang IS DISTINCT FROM n.lang THEN 'lang' END, CASE WHEN o.source IS DISTINCT FROM n.source THEN 'source' END) AS changed, row_sha256
  FROM keyed o JOIN sha n ON o.k = n.k),
o AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY k) AS i FROM keyed WHERE k NOT IN (SELECT k FROM later)),
n AS (SELECT *, row_number() OVER (PARTITION BY text, lang, source ORDER BY k DESC) AS i FROM sha WHERE k NOT IN (SELECT k FROM keyed))
SELECT key, old_key, CASE WHEN changed = '' THEN 'same' ELSE 'update' END AS op, changed, row_sha256 FROM pairs
UNION ALL
SELECT coalesce(n.k, o.k), o.k, CASE WHEN o.k IS NULL THEN 'insert' WHEN n.k IS NULL THEN 'delete' ELSE 'rekey' END, '', n.row_sha256
FROM o FULL JOIN n ON o.i = n.i AND o.text IS NOT DISTINCT FROM n.text AND o.lang IS NOT DISTINCT FROM n.lang AND o.source IS NOT DISTINCT FROM n.source
"""
