"""Near-duplicate classes by fast similarity sketching, banding and exact checks.

A text's set holds its distinct word shingles. Texts with equal sets form one
class and only one of them goes on. Its sketch has ``COORDS`` coordinates,
filled in rounds: in round i every shingle is hashed into one bin with a value
of i and a fraction, the smallest value stays, and rounds go on until all bins
are filled; from round COORDS on, round i throws every shingle into bin
i - COORDS, so no more than 2 * COORDS rounds are needed. A coordinate agrees
between two sets with the probability of their similarity and the sum over
coordinates is concentrated as if the coordinates were independent.

Bands of coordinates give candidate links (each member of a bucket with the
bucket's smallest, so a bucket of m texts gives m - 1), candidate links give
candidate groups, and each group is resolved on the full sets: every pair that
could still join two of its parts is compared. A group too large for one task
is split into blocks which see a few pivots of the group; all texts outside the
largest part that the pivots' links give are then compared with all blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, blocks, coded_words, drop_table, materialize
from .components import connected

PERCENT = 80
BANDS, ROWS = 64, 8
COORDS = BANDS * ROWS
#: Texts of a candidate group that one task may hold, and pivots of larger ones.
GROUP_LIMIT, PIVOTS = 1500, 8
#: Shingles (8 bytes each) that stand for GROUP_LIMIT texts.
SHINGLE_LIMIT = 6_000_000
#: Bytes of text that are signed at once.
SIGNED_BYTES = 6 << 20

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def shingle_sets(batch: list[str | None] | pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each lower-cased text.

    A text of fewer words gives its whole sequence as one shingle; one without
    words (or null) gives none. Each distinct word of the batch is hashed once.
    """
    import xxhash

    texts = pa.array(batch, pa.string()) if isinstance(batch, list) else batch
    codes, at, words = coded_words(pc.fill_null(texts, ""))
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words.cast(pa.binary()).to_pylist()], np.uint64)[codes] if len(words) else np.zeros(0, np.uint64)
    sizes, none = np.diff(at), np.zeros(0, np.uint64)
    full = np.full(max(0, len(h) - k + 1), k, np.uint64)  # the shingle from each word, some across the end of a text
    for j in range(k):
        full = mix(full * _M1 + h[j : j + len(full)])
    out = []
    for a, n in zip(at.tolist(), sizes.tolist()):
        if n >= k:
            out.append(np.unique(full[a : a + n - k + 1]))
        elif n:
            acc = np.full(1, n, np.uint64)
            for j in range(n):
                acc = mix(acc * _M1 + h[a + j : a + j + 1])
            out.append(acc)
        else:
            out.append(none)
    return out


def set_key(h: np.ndarray) -> tuple[int, int]:
    """128 bits that do not depend on the order of the set."""
    if not len(h):
        return 0, 0
    a, b = mix(h + _M1).sum(dtype=np.uint64), mix(h ^ _M3).sum(dtype=np.uint64)
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def sketches(sets: list[np.ndarray], coords: int = COORDS) -> np.ndarray:
    """One row of ``coords`` values per non-empty set: (round, hash) packed."""
    n = len(sets)
    out = np.full(n * coords, np.uint64(0xFFFFFFFFFFFFFFFF))
    if not n:
        return out.reshape(0, coords)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    x = np.concatenate(sets)
    live = np.ones(n, bool)
    full = np.uint64(0xFFFFFFFFFFFFFFFF)
    for i in range(2 * coords):
        h = mix(x + np.uint64((i + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        bins = ((h >> np.uint64(40)) % np.uint64(coords)).astype("i8") if i < coords else np.full(len(h), i - coords)
        np.minimum.at(out, owner * coords + bins, (np.uint64(i) << np.uint64(40)) | (h & np.uint64((1 << 40) - 1)))
        if i % 4 == 3 or i < 4:
            live = (out.reshape(n, coords) == full).any(1)
            keep = live[owner]
            if not keep.any():
                break
            if keep.sum() < 0.7 * len(keep):
                x, owner = x[keep], owner[keep]
    return out.reshape(n, coords)


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band, the band's number mixed in."""
    n, coords = sketch.shape
    parts = sketch.reshape(n, bands, coords // bands)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64) * _M1, (n, bands)).copy()
    for j in range(parts.shape[2]):
        key = mix(key * _M3 + parts[:, :, j])
    return key.view(np.int64)


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """All columns of ``docs`` but text, with n_shingles, k1, k2 and bands."""
    carried = [c for c in docs.columns if c != "text"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in carried)

    def work(batches):
        for b in blocks(batches, limit=SIGNED_BYTES):
            sets = shingle_sets(b.column("text"), k)
            keys = [set_key(s) for s in sets]
            some = [i for i, s in enumerate(sets) if len(s)]
            bands: list = [[] for _ in sets]
            if some:
                for i, row in zip(some, band_keys(sketches([sets[i] for i in some]))):
                    bands[i] = row
            yield {c: b.column(c) for c in carried} | {"n_shingles": [len(s) for s in sets], "k1": [a for a, _ in keys], "k2": [c for _, c in keys], "bands": bands}

    return arrow_map(docs, work, schema + ", n_shingles long, k1 long, k2 long, bands array<long>")


def similar(inter, a, b, percent: int = PERCENT):
    return 100 * inter >= percent * (a + b - inter)


class Parts:
    """Union-find over the positions of a group."""

    def __init__(self, n: int):
        self.up, self.size, self.n = list(range(n)), [1] * n, n

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            if self.size[i] < self.size[j]:
                i, j = j, i
            self.up[j] = i
            self.size[i] += self.size[j]
            self.n -= 1


class SetGroup:
    """Counts of common elements of one set with all sets of a group."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets], "i8")
        values, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.values, self.mark = values, np.zeros(len(values), "i4")

    def common(self, ids: np.ndarray) -> np.ndarray:
        self.mark[ids] = 1
        got = np.add.reduceat(self.mark[self.flat], self.starts)
        self.mark[ids] = 0
        return got

    def own(self, i: int) -> np.ndarray:
        return self.flat[self.starts[i] : self.starts[i] + self.sizes[i]]

    def links(self, ids: np.ndarray, size: int, percent: int) -> np.ndarray:
        return np.flatnonzero(similar(self.common(ids), size, self.sizes, percent))

    def of_values(self, s: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.values, s)
        at = at[at < len(self.values)]
        return at[np.isin(self.values[at], s, assume_unique=True)]


def resolve(sets: list[np.ndarray], percent: int = PERCENT) -> list[int]:
    """The part of each set, by all links. After a few sets are compared with
    all, only those outside the largest part are: a link between two parts has
    an end outside the largest one."""
    n = len(sets)
    group, parts = SetGroup(sets), Parts(n)
    done = np.zeros(n, bool)

    def compare(i: int) -> None:
        done[i] = True
        for j in group.links(group.own(i), int(group.sizes[i]), percent).tolist():
            parts.join(i, j)

    for i in range(min(n, 3)):
        compare(i)
    while parts.n > 1:
        roots = [parts.root(i) for i in range(n)]
        largest = max(set(roots), key=lambda r: parts.size[r])
        outside = [i for i in range(n) if roots[i] != largest and not done[i]]
        if not outside:
            break
        for i in outside:
            if parts.n > 1 and parts.root(i) != parts.root(largest):
                compare(i)
            # one that has joined the largest part meanwhile needs no look of its own
    return [parts.root(i) for i in range(n)]


def _sets_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """grp, row, members and set (bytes) of the texts whose row ``wanted`` names."""
    joined = docs.select("row", "text").join(wanted, "row").select("grp", "row", "members", "text")

    def work(batches):
        for b in batches:
            sets = shingle_sets(b.column("text"), k)
            yield {c: b.column(c) for c in ("grp", "row", "members")} | {"s": [s.tobytes() for s in sets]}

    return arrow_map(joined, work, "grp long, row long, members long, s binary")


def _resolve_group(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("row").sort_values("row")
        rows = pdf["row"].to_numpy()
        part = np.array(resolve([np.frombuffer(s, np.uint64) for s in pdf["s"]], percent))
        low = pd.Series(rows).groupby(part).transform("min").to_numpy()
        return pd.DataFrame({"a": rows, "b": low})

    return run


def _large_links(sets: DataFrame, percent: int, limit: int) -> DataFrame:
    """Links a, b that leave the parts of large groups as all links would.

    ``sets``: grp, row, members, s of groups with more than ``limit`` texts.
    Blocks of a group are compared with its pivots first. A link between two
    parts of that has an end outside the largest part, so every text outside
    it is compared with every block. A task gives only links that join parts.
    """
    blocks = F.ceil(F.col("members") / limit).cast("int")
    sets = sets.dropDuplicates(["grp", "row"]).withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
    # few rows a group: those with the smallest hashes, picked per block first
    near = Window.partitionBy("grp", "block").orderBy(F.xxhash64("row"), "row")
    over = Window.partitionBy("grp").orderBy(F.xxhash64("row"), "row")
    few = sets.select("grp", "block", "row").withColumn("r", F.row_number().over(near)).where(F.col("r") <= PIVOTS)
    few = few.withColumn("r", F.row_number().over(over)).where(F.col("r") <= PIVOTS).select("grp", "row")
    pivots = sets.join(few, ["grp", "row"]).select("grp", "row", "s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asked = pivots.select("grp", "block", "row", "s", F.lit(True).alias("asks")).union(sets.select("grp", "block", "row", "s", F.lit(False)))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        asks, rest = pdf[pdf["asks"]], pdf[~pdf["asks"]]
        out: list[tuple[int, int]] = []
        if len(rest) and len(asks):
            rows = rest["row"].tolist()
            group = SetGroup([np.frombuffer(s, np.uint64) for s in rest["s"]])
            at = {row: i for i, row in enumerate(rows)}
            for row in asks["row"].tolist():
                at.setdefault(row, len(at))
            parts = Parts(len(at))
            for row, s in zip(asks["row"].tolist(), asks["s"]):
                h = np.frombuffer(s, np.uint64)
                for j in group.links(group.of_values(h), len(h), percent).tolist():
                    if parts.root(at[row]) != parts.root(j):
                        parts.join(at[row], j)
                        out.append((row, rows[j]))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    first = materialize(asked.groupBy("grp", "block").applyInPandas(compare, "a long, b long"), "near-pivots")
    part = sets.select("grp", "row").join(connected(first).select(F.col("node").alias("row"), F.col("root").alias("part")), "row")
    largest = part.groupBy("grp", "part").agg(F.count(F.lit(1)).alias("n")).groupBy("grp").agg(F.max_by("part", F.struct("n", "part")).alias("largest"))
    inside = part.join(largest, "grp").where(F.col("part") == F.col("largest")).select("row")
    left = sets.join(inside, "row", "left_anti").withColumn("ask", F.pmod(F.xxhash64("row", F.lit(7)), F.greatest(F.lit(1), F.col("blocks"))).cast("int"))
    asking = left.select("grp", "row", "s", "ask", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    asks = left.select("grp", "ask").distinct()
    again = asking.select("grp", "block", "ask", "row", "s", F.lit(True).alias("asks")).union(sets.join(asks, "grp").select("grp", "block", "ask", "row", "s", F.lit(False)))
    second = again.groupBy("grp", "block", "ask").applyInPandas(compare, "a long, b long")
    return first.union(second)


def near_classes(docs: DataFrame, k: int = 2, percent: int = PERCENT, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """All columns of ``docs`` but text (doc_id and row, which numbers the
    rows, among them), with n_shingles, component_id (the smallest doc_id
    reachable through links) and kept.

    ``docs`` is a written table, so that a row has its number in every scan.
    Null, empty and wordless texts have no shingle, link with nothing and keep
    their own id. Of rows that share the smallest doc_id of a class, one is
    kept (the first row). Null ids come after all others: component_id is null
    where a class has no other, and its first row is kept. An empty table gives
    an empty result.
    """
    signed = materialize(signatures(docs, k), "near-signed")
    some = signed.where("n_shingles > 0")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first")
    classes = materialize(some.groupBy("k1", "k2").agg(first, F.first("n_shingles").alias("n_shingles")).select("k1", "k2", "n_shingles", F.col("first.doc_id").alias("doc_id"), F.col("first.row").alias("row")), "near-classes")
    # one row of bands per class: the rows that stand for their class
    keys = some.join(classes.select("row"), "row", "left_semi").select("row", F.explode("bands").alias("key"))
    buckets = keys.groupBy("key").agg(F.min("row").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "low")
    links = materialize(keys.join(buckets, "key").where("row <> low").select(F.col("row").alias("a"), F.col("low").alias("b")).distinct(), "near-candidates")
    groups = connected(links)
    # a group's weight in sets that one task may hold, by number and by bytes
    weight = F.greatest(F.lit(1 / group_limit), F.col("n_shingles") / SHINGLE_LIMIT)
    weighed = groups.join(classes.select("row", weight.alias("w")), groups["node"] == F.col("row"))
    sizes = weighed.groupBy("root").agg(F.ceil(F.sum("w") * group_limit - F.lit(1e-6)).cast("long").alias("members"))
    wanted = groups.join(sizes, "root").select(F.col("root").alias("grp"), F.col("node").alias("row"), "members")
    sets = materialize(_sets_of(docs, wanted, k), "near-sets", "lz4")
    true_links = sets.where(F.col("members") <= group_limit).groupBy("grp").applyInPandas(_resolve_group(percent), "a long, b long").where("a <> b")
    if not sets.where(F.col("members") > group_limit).isEmpty():
        true_links = true_links.union(_large_links(sets.where(F.col("members") > group_limit), percent, group_limit))
        parts = connected(true_links)
    else:
        parts = materialize(true_links.select(F.col("a").alias("node"), F.col("b").alias("root")), "near-parts")
    # classes that hang together, with the smallest doc_id among them
    named = classes.join(parts, classes["row"] == parts["node"], "left").select("k1", "k2", F.col("doc_id").alias("least"), F.col("row").alias("first_row"), F.coalesce("root", "row").alias("part"))
    # written, so that the join below meets two plain shuffles and a large part is split among tasks
    least = materialize(named.groupBy("part").agg(F.min(F.struct(F.col("least").isNull().alias("none"), "least", "first_row")).alias("m")).select("part", F.col("m.least").alias("component_id"), F.col("m.first_row").alias("keeper")), "near-least")
    of_class = materialize(named.join(least, "part").select("k1", "k2", "component_id", "keeper"), "near-named")
    out = signed.drop("bands").join(of_class, ["k1", "k2"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    out = out.withColumn("kept", (F.col("n_shingles") == 0) | (F.col("row") == F.col("keeper")))
    for t in (links, sets, groups, parts, least, classes):
        drop_table(t)
    return out.drop("k1", "k2", "keeper")


def classes_of(docs: DataFrame, k: int = 2, percent: int = PERCENT, group_limit: int = GROUP_LIMIT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (doc_id = component_id; of a
    class of null ids alone its first row)."""
    plain = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text"), "near-docs")
    found = near_classes(plain, k, percent, group_limit)
    drop_table(plain)
    own = F.when(F.col("doc_id").isNull(), F.col("kept")).otherwise(F.col("doc_id") == F.col("component_id"))
    return found.select("doc_id", "n_shingles", "component_id", own.alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` but for all near copies save one, all columns kept.

    Rows without words stay. Of a class the row with the smallest doc_id stays.
    Other columns may have any names, for inside they have others.
    """
    columns = docs.columns
    place = {c: f"c{i}" for i, c in enumerate(columns)}
    numbered = materialize(docs.toDF(*place.values()).withColumn("row", F.monotonically_increasing_id()), "near-docs")
    plain = numbered.select("row", F.col(place["doc_id"]).cast("long").alias("doc_id"), F.col(place["text"]).alias("text"))
    gone = near_classes(plain, k, percent).where(~F.col("kept")).select("row")
    return numbered.join(gone, "row", "left_anti").drop("row").toDF(*columns)
