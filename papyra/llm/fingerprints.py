"""Fingerprints of documents: the smallest hashes of their shingles.

A sketch has the ``SIZE`` smallest of the distinct 63-bit hashes of a text's
word shingles, ascending. The sketch of a union is made of the sketches of its
parts, so sketches of parts, sources or whole tables merge. The smallest hashes
of a union of two sets are a fair sample of it; the share that both sets hold
estimates their resemblance, and with the estimated sizes their containment.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLOCK_BYTES, arrow_map, blocks, texts
from .near_dedup import shingle_sets

#: Hashes of a sketch and words of a shingle.
SIZE, SHINGLE = 128, 5
#: Rank of an absent doc_id: below all others.
NO_ID = -(1 << 63)


def bottom(batch: pa.Array | list, k: int = SHINGLE, size: int = SIZE) -> list[np.ndarray]:
    """The sketch of each text; a text of fewer than ``k`` words has one
    shingle, one without words has none."""
    return [np.unique(s >> np.uint64(1))[:size].astype("i8") for s in shingle_sets(batch, k)]


def likeness(a: np.ndarray, b: np.ndarray, size: int = SIZE) -> float:
    """Estimated resemblance of two sketched sets; two empty ones are alike."""
    both = np.sort(np.concatenate([a, b]))
    again = both[1:] == both[:-1]
    firsts = np.concatenate([[True], ~again]) if len(both) else np.zeros(0, bool)
    n = min(size, int(firsts.sum()))
    if not n:
        return 1.0
    last = np.flatnonzero(firsts)[n - 1]  # where the n-th distinct hash begins
    return float(again[: last + 1].sum()) / n


def written_out(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype("<i8").tobytes()).decode()


def read_back(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), "<i8")


def sketched(docs: DataFrame, k: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """``doc_id`` and ``sketch`` (array of long) of every row, null texts as
    empty ones; other columns are not read."""

    def work(batches):
        for b in blocks(batches):
            found = bottom(b.column("text"), k, size)
            at = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype("i4")
            flat = np.concatenate(found) if found else np.zeros(0, "i8")
            yield {"doc_id": b.column("doc_id"), "sketch": pa.ListArray.from_arrays(pa.array(at), pa.array(flat))}

    return arrow_map(texts(docs), work, "doc_id bigint, sketch array<bigint>")


def union_sketch(a: Column, b: Column, size: int = SIZE) -> Column:
    return F.slice(F.array_sort(F.array_union(a, b)), 1, size)


def resemblance(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the union's shingles that both sets have."""
    union = union_sketch(a, b, size)
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union))


def distinct_shingles(sketch: Column, size: int = SIZE) -> Column:
    """Number of distinct shingles: exact below ``size``, else estimated by the
    largest hash kept."""
    return F.when(F.size(sketch) < size, F.size(sketch).cast("double")).otherwise((size - 1) * F.lit(float(1 << 63)) / F.element_at(sketch, -1))


def containment(a: Column, b: Column, size: int = SIZE) -> Column:
    """Estimated share of the shingles of ``a`` that ``b`` has; 1 if it has none."""
    shared = resemblance(a, b, size) * distinct_shingles(union_sketch(a, b, size), size)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_shingles(a, size)))


def merged(sketches: DataFrame, by: list[str], size: int = SIZE) -> DataFrame:
    """One sketch per key out of the sketches of its parts.

    Hashes are made distinct before the shuffle and each task keeps the
    smallest ones of a key, so a key that holds most rows costs no task more
    than ``size`` rows from each other task. Null keys form one group.
    """
    hashes = sketches.select(*by, F.explode_outer("sketch").alias("_hash")).distinct()
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("_hash").asc_nulls_last()))
    return hashes.withColumn("_rank", rank).where(F.col("_rank") <= size).groupBy(*by).agg(F.array_sort(F.collect_list("_hash")).alias("sketch"))


def _dealt(docs: DataFrame) -> DataFrame:
    """Texts in buckets of falling doc_id, one bucket a partition, sorted; the
    first row of a bucket also goes, marked, to the bucket before it (that of
    the first one to the last).

    Split points are quantiles of the ids. Rows that share an id lie by the
    hash of their texts, over several buckets where the id spans them; rows
    without an id come last. To the driver goes a row for each bucket.
    """
    spark = docs.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = texts(docs).withColumns({"at": F.coalesce("doc_id", F.lit(NO_ID)), "h": F.xxhash64("text")})
    cuts = rows.agg(F.percentile_approx("at", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    cuts = [int(c) for c in (cuts if n > 1 else [])]
    if cuts:
        bounds = F.lit(cuts)
        low = F.size(F.filter(bounds, lambda b: b < F.col("at")))
        span = F.size(F.filter(bounds, lambda b: b == F.col("at"))) + 1
        rows = rows.withColumns({"low": low, "span": span})
        bucket = F.lit(n - 1) - F.col("low") - F.least(F.floor((F.col("h") / float(1 << 64) + 0.5) * F.col("span")), F.col("span") - 1)
    else:
        bucket = F.lit(0)
    rows = rows.select("doc_id", "text", "at", "h", bucket.cast("int").alias("bucket"))
    heads = sorted((r["bucket"], *r["head"]) for r in rows.groupBy("bucket").agg(F.max(F.struct("at", "h")).alias("head")).collect())
    if not heads:
        return rows.withColumn("mark", F.lit(0)).select("text", "doc_id", "at", "h", "mark")
    head_at, head_h, before = [None] * n, [None] * n, [0] * n
    for k, (b, at, h) in enumerate(heads):
        head_at[b], head_h[b], before[b] = at, h, heads[k - 1][0]
    array = lambda x, kind: F.lit(None).cast(f"array<{kind}>") if all(v is None for v in x) else F.array(*[F.lit(v).cast(kind) for v in x])
    own = F.struct(F.col("bucket").alias("to"), F.lit(0).alias("mark"))
    first = (F.get(array(head_at, "long"), F.col("bucket")) == F.col("at")) & (F.get(array(head_h, "long"), F.col("bucket")) == F.col("h"))
    sent = F.when(first, F.array(own, F.struct(F.get(array(before, "int"), F.col("bucket")).alias("to"), F.lit(1).alias("mark")))).otherwise(F.array(own))
    sent = rows.select("text", "doc_id", "at", "h", F.inline(sent))
    return sent.repartitionById(n, F.col("to")).sortWithinPartitions("mark", F.col("at").desc(), F.col("h").desc())


def with_edited(docs: DataFrame, k: int = SHINGLE, size: int = SIZE) -> DataFrame:
    """Fingerprints of every text and of its edited text.

    The edited text has the last half of the code points (rounded down)
    replaced by as many first ones of the next document by falling doc_id, or
    by all of them if it is shorter; after the last document comes the first.
    Of rows with one doc_id the next is by the hash of the text, rows without
    an id come last, repeated rows give a row each; null texts are empty. A
    table of one row is its own next. Returns doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next and n_distinct (the
    estimated number of shingles).
    """

    def work(batches):
        def done(ids: list, held: list[str]) -> dict:
            """The rows of ``ids``; the last text is only a next one."""
            own = [len(t) for t in held[:-1]]
            edited = [t[: n - n // 2] + f[: n // 2] for t, f, n in zip(held, held[1:], own)]
            plain, other = bottom(held, k, size), bottom(edited, k, size)
            return {
                "doc_id": pa.array(ids, pa.int64()), "n_chars": own, "edited_sha256": [hashlib.sha256(t.encode()).hexdigest() for t in edited],
                "fingerprint": [written_out(s) for s in plain[:-1]], "edited_fingerprint": [written_out(s) for s in other],
                "near_edited": [likeness(a, b, size) for a, b in zip(plain, other)], "near_next": [likeness(a, b, size) for a, b in zip(plain, plain[1:])],
                "n_distinct": [float(len(s)) if len(s) < size else (size - 1) * 2.0**63 / float(s[-1]) for s in plain[:-1]],
            }

        ids, held, bytes_held, last = [], [], 0, False
        for b in batches:
            for i, t, mark in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), b.column("mark").to_pylist()):
                if last:
                    break  # equal heads of the next bucket: one is enough
                held.append(t)
                last = mark == 1
                if len(held) > 1 and (last or bytes_held > BLOCK_BYTES // 2):
                    yield done(ids, held)
                    ids, held, bytes_held = [], held[-1:], 0
                ids.append(i)
                bytes_held += len(t)

    kinds = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_distinct double"
    return arrow_map(_dealt(docs).select("doc_id", "text", "mark"), work, kinds)
