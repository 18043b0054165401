"""Removal of long repeated passages by a distributed merge sort of suffixes.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts
elsewhere. Every such window picks an anchor in itself: the place of the
smallest hash among its ``GRAM``-byte strings. Equal windows pick the same
place, so only suffixes at anchors are sorted (about one in 137 bytes).

1. Anchors whose GRAM-byte string occurs once in the corpus cannot be in a
   repeat; their count by hash drops them without loss.
2. Each task sorts the suffixes at its other anchors (cut where the anchor's
   last window ends, with the bytes before the anchor at hand) into runs, one
   per range of first-GRAM-byte hashes, and writes them front-coded: only what
   differs from the suffix before.
3. The runs of a range are combined by a loser tree that carries common-prefix
   lengths: a comparison starts where the known common prefix ends, and known
   prefixes alone often decide.
4. Neighbours in the merged order with a common prefix of GRAM or more form a
   class. A suffix whose whole window range a neighbour repeats is done; common
   prefixes bound the others' windows, and those left are compared by two
   independent 64-bit hashes.

A GRAM-byte string that very many places share is dealt over several tasks
which resolve what they can; windows still open there meet in an aggregation
by window hash over all of them.

Where words count too, the 64-bit codes of a text's words follow its bytes in
the same search: ``LENGTH`` bytes of codes are ``WORDS`` words, whatever their
length and the blanks between them. Windows across the seam are no matches.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, coded_words, drop_table, materialize
from .near_dedup import mix

LENGTH = 400
GRAM = 128
#: Bytes of a word's code, and words of a repeated passage.
CODE = 8
WORDS = LENGTH // CODE
#: Anchor places that a window chooses from.
CHOICES = LENGTH - GRAM + 1
#: Bytes that one array pass takes; longer texts are cut into overlapping pieces.
PIECE = 4 << 20
#: Bytes of suffixes that a task sorts at once, and that one range should hold.
RUN_BYTES = 24 << 20
RANGE_BYTES = 24 << 20
#: Places of one GRAM-byte string that one task takes.
SHARED_LIMIT = 4000

_PLACE = np.uint64((1 << 24) - 1)
#: Two independent families of hashes: letters' values and odd factors.
_TABLES = [np.random.default_rng(seed).integers(0, 2**64, 256, dtype=np.uint64) for seed in (400, 402)]
_FACTORS = [np.random.default_rng(seed).integers(0, 2**63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for seed in (401, 403)]


def _doubled(data: np.ndarray, widths: tuple[int, ...], family: int = 0) -> list[np.ndarray]:
    """Hashes of all strings of the given power-of-two widths, by place."""
    h, m, level, out = _TABLES[family][data], 1, 0, []
    while True:
        if m in widths:
            out.append(h)
        if m >= widths[-1]:
            return out
        h = h[:-m] * _FACTORS[family][level] + h[m:] if len(h) > m else h[:0]
        h ^= h >> np.uint64(31)
        m, level = 2 * m, level + 1


def anchors(data: bytes | np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first start, last start) of the anchors of a byte string."""
    buf = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    n = len(buf)
    if n < LENGTH:
        return (np.zeros(0, np.int64),) + (np.zeros(0, "i4"),) * 3
    parts = []
    for at in range(0, n - LENGTH + 1, PIECE):
        h, place, first, last = _runs(*_choose(buf[at : at + PIECE + LENGTH - 1]), 0)
        parts.append((h, place + np.int32(at), first + np.int32(at), last + np.int32(at)))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _choose(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(_doubled(buf, (GRAM,))[0])
    low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
    m = 1
    while 2 * m <= CHOICES:
        low = np.minimum(low[:-m], low[m:])
        m *= 2
    rest = CHOICES - m
    if rest:
        low = np.minimum(low[:-rest], low[rest:])
    return h, (low & _PLACE).astype("i4")


def _runs(h: np.ndarray, choice: np.ndarray, base: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    cut = np.flatnonzero(choice[1:] != choice[:-1])
    first = np.concatenate([[0], cut + 1]).astype("i4")
    last = np.concatenate([cut, [len(choice) - 1]]).astype("i4")
    place = choice[first]
    return h[place].view(np.int64), place - np.int32(base), first, last


def batch_anchors(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """:func:`anchors` of many texts, short ones in shared array passes."""
    out: list = [None] * len(texts)
    group: list[int] = []
    size = 0

    def flush() -> None:
        nonlocal group, size
        if group:
            buf = np.frombuffer(b"".join([texts[i] for i in group]), np.uint8)
            h, choice = _choose(buf)
            at = 0
            for i in group:
                n = len(texts[i])
                out[i] = _runs(h, choice[at : at + n - LENGTH + 1], at)
                at += n
        group, size = [], 0

    for i, t in enumerate(texts):
        if len(t) < LENGTH or len(t) > PIECE:
            out[i] = anchors(t)
            continue
        if size + len(t) > PIECE // 4:
            flush()
        group.append(i)
        size += len(t)
    flush()
    return out


def common_prefix(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix, known to be ``start`` at least."""
    end, step = min(len(a), len(b)), 32
    while start < end:
        x, y = a[start : start + step], b[start : start + step]
        if x != y:
            n = min(len(x), len(y))
            gap = int.from_bytes(x[:n], "big") ^ int.from_bytes(y[:n], "big")
            return start + n - (gap.bit_length() + 7) // 8
        start += len(x)
        step *= 2
    return end


# --- front-coded runs ---------------------------------------------------------
# A suffix is (right, left, row, place, first): the bytes from the anchor to the
# end of its last window, those before it back to its first window (reversed),
# and where it is; row -1 stands for places that are already resolved.


def encode_run(suffixes: list[tuple]) -> bytes:
    import zstandard

    n = len(suffixes)
    kept_r, kept_l, parts, size = np.zeros(n, "<u2"), np.zeros(n, "<u2"), [], np.zeros((n, 2), "<u2")
    before, before_l = b"", b""
    for i, (right, left, *_) in enumerate(suffixes):
        k = common_prefix(before, right, 0)
        j = common_prefix(before_l, left, 0)
        kept_r[i], kept_l[i] = k, j
        size[i] = len(right) - k, len(left) - j
        parts += (right[k:], left[j:])
        before, before_l = right, left
    where = np.array([s[2:] for s in suffixes], "<i8").reshape(n, 3)
    return zstandard.ZstdCompressor(level=1).compress(struct.pack("<I", n) + kept_r.tobytes() + kept_l.tobytes() + size.tobytes() + where.tobytes() + b"".join(parts))


def decode_run(blob: bytes) -> Iterator[tuple[bytes, int, bytes, int, int, int]]:
    """(right, its common prefix with the one before, left, row, place, first)."""
    import zstandard

    data = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", data)
    at = 4
    kept_r = np.frombuffer(data, "<u2", n, at).tolist()
    kept_l = np.frombuffer(data, "<u2", n, at + 2 * n).tolist()
    size = np.frombuffer(data, "<u2", 2 * n, at + 4 * n).reshape(n, 2).tolist()
    where = np.frombuffer(data, "<i8", 3 * n, at + 8 * n).reshape(n, 3).tolist()
    at += 32 * n
    right, left = b"", b""
    for k, j, (a, b), (row, place, first) in zip(kept_r, kept_l, size, where):
        right = right[:k] + data[at : at + a]
        at += a
        left = left[:j] + data[at : at + b]
        at += b
        yield right, k, left, row, place, first


def merge_runs(runs: list[Iterator[tuple]]) -> Iterator[tuple]:
    """All suffixes in order, each with its common prefix with the one before.

    A loser tree whose nodes keep the loser and its common prefix with the
    winner that passed: of two prefixes with the last winner the longer one is
    the smaller suffix, and only at equal lengths are bytes compared, from
    there on.
    """
    n = len(runs)
    heads = [next(r, None) for r in runs]
    known = [0] * n  # common prefix with the last suffix given out
    if n == 0:
        return

    def duel(x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then with the winner."""
        a, b = heads[x], heads[y]
        if a is None:
            return y, x
        if b is None:
            return x, y
        if known[x] != known[y]:
            return (x, y) if known[x] > known[y] else (y, x)
        p, q = a[0], b[0]
        k = common_prefix(p, q, known[x])
        first = len(p) <= len(q) if k == min(len(p), len(q)) else p[k] < q[k]
        if first:
            known[y] = k
            return x, y
        known[x] = k
        return y, x

    losers = [0] * n

    def build(node: int) -> int:
        if node >= n:
            return node - n
        win, lose = duel(build(2 * node), build(2 * node + 1))
        losers[node] = lose
        return win

    winner = build(1) if n > 1 else 0
    while (head := heads[winner]) is not None:
        yield (head[0], known[winner], *head[2:])
        heads[winner] = follows = next(runs[winner], None)
        known[winner] = follows[1] if follows is not None else 0
        node = (winner + n) // 2
        while node:
            winner, losers[node] = duel(winner, losers[node])
            node //= 2


# --- windows ------------------------------------------------------------------


def window_hashes(buf: np.ndarray, family: int = 0) -> np.ndarray:
    """Hash of the LENGTH bytes from each place (16 + 128 + 256 of them)."""
    h16, h128, h256 = _doubled(buf, (16, 128, 256), family)
    n, f = len(buf) - LENGTH + 1, _FACTORS[family]
    return mix((h256[:n] * f[14] + h128[256 : 256 + n]) * f[15] + h16[384 : 384 + n])


def _spans(rows: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, last) of runs of consecutive starts; both sorted together."""
    if not len(rows):
        return []
    cut = np.flatnonzero((rows[1:] != rows[:-1]) | (starts[1:] != starts[:-1] + 1))
    a, b = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(rows) - 1]])
    return list(zip(rows[a].tolist(), starts[a].tolist(), starts[b].tolist()))


class Resolver:
    """Takes merged suffixes class by class, gives spans of repeated starts, and
    for shared classes (``open``) the windows that others may still repeat."""

    def __init__(self, shared: bool):
        self.shared = shared
        self.spans: list[tuple[int, int, int]] = []
        self.open: list[tuple[int, int, int, int, int]] = []  # two hashes, count, row, start
        self.waiting: list[tuple] = []
        self.size = 0

    def add_class(self, members: list[tuple]) -> None:
        """members: (right, common prefix with the one before, left, row, place, first)."""
        n = len(members)
        if n == 1 and not self.shared:
            return
        pending = []
        for i, (right, _, left, row, place, first) in enumerate(members):
            if row < 0:
                pending.append((right, left, -1, place, first, 0))
                continue
            best, done = 0, False
            for j, prefix in ((i - 1, members[i][1] if i else 0), (i + 1, members[i + 1][1] if i + 1 < n else 0)):
                if not 0 <= j < n:
                    continue
                best = max(best, prefix)
                other = members[j]
                if prefix >= len(right) and other[2].startswith(left) and (other[3], other[4]) != (row, place):
                    done = True
            if done:
                self.spans.append((row, first, place + len(right) - LENGTH))
                pending.append((right, left, -1, place, first, 0))
            else:
                pending.append((right, left, row, place, first, LENGTH if self.shared else best))
        if self.shared or any(p[2] >= 0 for p in pending):
            self.waiting += pending
            self.size += sum(len(p[0]) + len(p[1]) for p in pending)
            if self.size > PIECE // 4:
                self.flush()

    def flush(self) -> None:
        if not self.waiting:
            return
        waiting, self.waiting, self.size = self.waiting, [], 0
        sizes = np.array([len(p[0]) + len(p[1]) for p in waiting])
        buf = np.frombuffer(b"".join([x for p in waiting for x in (p[1][::-1], p[0])]), np.uint8)
        h, g = window_hashes(buf), window_hashes(buf, 1)
        counts = sizes - LENGTH + 1
        at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        inner = np.arange(int(counts.sum())) - np.repeat(np.concatenate([[0], np.cumsum(counts)[:-1]]), counts)
        where = np.repeat(at, counts) + inner
        h, g = h[where], g[where]
        first = np.array([p[4] for p in waiting])
        start = np.repeat(first, counts) + inner
        row = np.repeat(np.array([p[2] for p in waiting]), counts)
        # the part of a window right of its anchor cannot exceed the common prefix
        right = start + LENGTH - np.repeat(np.array([p[3] for p in waiting]), counts)
        may = (row >= 0) & (right <= np.repeat(np.array([p[5] for p in waiting]), counts))
        order = np.lexsort((g, h))
        hs, gs = h[order], g[order]
        same = (hs[1:] == hs[:-1]) & (gs[1:] == gs[:-1])
        twice = np.zeros(len(h), bool)
        twice[order[1:]] |= same
        twice[order[:-1]] |= same
        got = np.flatnonzero(twice & may)
        got = got[np.lexsort((start[got], row[got]))]
        self.spans += _spans(row[got], start[got])
        if self.shared:
            alone = np.flatnonzero(~twice & (row >= 0))
            self.open += zip(h[alone].view(np.int64).tolist(), g[alone].view(np.int64).tolist(), [1] * len(alone), row[alone].tolist(), start[alone].tolist())
            others = order[(twice | (row < 0))[order]]  # one of each
            others = others[np.concatenate([[True], (h[others][1:] != h[others][:-1]) | (g[others][1:] != g[others][:-1])])[: len(others)]]
            self.open += [(x, y, 2, -1, -1) for x, y in zip(h[others].view(np.int64).tolist(), g[others].view(np.int64).tolist())]


def resolve_runs(blobs: list[bytes], shared: bool) -> Resolver:
    found, members = Resolver(shared), []
    for suffix in merge_runs([decode_run(b) for b in blobs]):
        if members and suffix[1] < GRAM:
            found.add_class(members)
            members = []
        members.append(suffix)
    if members:
        found.add_class(members)
    found.flush()
    return found


# --- words --------------------------------------------------------------------

_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def sequences(texts: Iterable[bytes], words: bool) -> Iterator[bytes]:
    """What is searched for repeats: each text and, if asked, the codes of its
    words behind it, worked out for many texts at once."""
    if not words:
        yield from texts
        return

    def coded(group: list[bytes]) -> list[bytes]:
        places, at, distinct = coded_words(pa.array(group, pa.large_string()), lower=False)
        code = np.array([int.from_bytes(hashlib.blake2b(w.encode(), digest_size=CODE).digest(), "little") for w in distinct.to_pylist()], "<u8")
        row = code[places]
        return [t + row[a:b].tobytes() for t, a, b in zip(group, at[:-1], at[1:])]

    group, size = [], 0
    for t in texts:
        group.append(t)
        size += len(t)
        if size >= PIECE // 4:
            yield from coded(group)
            group, size = [], 0
    if group:
        yield from coded(group)


def _in_text(data: bytes, spans: list[tuple[int, int]], words: bool) -> list[tuple[int, int]]:
    """(first byte, end) in a text of what its spans of repeated starts cover."""
    n = len(data)
    found = [(first, min(last, n - LENGTH) + LENGTH) for first, last in spans if first <= n - LENGTH]
    if words and any(last >= n for _, last in spans):
        at = [m.span() for m in _WORD.finditer(data)]
        for first, last in spans:
            first, last = -(-max(first - n, 0) // CODE), (last - n) // CODE
            if first <= last:
                found.append((at[first][0], at[last + WORDS - 1][1]))
    return found


# --- the distributed job ------------------------------------------------------


def _scan(docs: DataFrame, words: bool = False) -> DataFrame:
    """Packed text, its length and digest, and the anchors of every row."""
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"]
    names = [f.name for f in docs.schema if f.name != "text"]

    def work(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in b.column("text").to_pylist()]
            found = batch_anchors(list(sequences(data, words)))
            yield {n: b.column(n) for n in names} | {
                "__z": [pack(d) for d in data], "__n": [len(d) for d in data], "__sha": [hashlib.sha256(d).hexdigest() for d in data],
                "__h": [f[0] for f in found], "__a": [f[1] for f in found], "__f": [f[2] for f in found], "__l": [f[3] for f in found],
            }

    schema = ", ".join([*carried, "__z binary, __n long, __sha string, __h array<long>, __a array<int>, __f array<int>, __l array<int>"])
    return arrow_map(docs, work, schema).withColumn("__row", F.monotonically_increasing_id())


def _make_runs(candidates: DataFrame, ranges: int, limit: int, words: bool) -> DataFrame:
    """kind 0: (range, run); kind 1: (row, first, last) resolved in the task."""

    def work(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        held: list[tuple] = []
        size = 0

        def flush():
            held.sort()
            runs: dict[int, list[tuple]] = {}
            spans: list[tuple[int, int, int]] = []
            i = 0
            while i < len(held):
                base, right, left = held[i][:3]
                j = i + 1
                while j < len(held) and held[j][:3] == (base, right, left):
                    j += 1
                row, place, first, n = held[i][3:]
                if j - i > 1:
                    spans += [(r, f, p + len(right) - LENGTH) for _, _, _, r, p, f, _ in held[i:j]]
                into = base
                if n > limit:  # shared by many: dealt by row
                    into = -1 - (base * 1009 + row % -(-n // limit)) % (1 << 40)
                runs.setdefault(into, []).append((right, left, row if j - i == 1 else -1, place, first))
                i = j
            m, k = len(runs), len(spans)
            out = {
                "kind": [0] * m + [1] * k, "rng": [*runs.keys(), *[0] * k], "run": [*[encode_run(r) for r in runs.values()], *[None] * k],
                "row": [*[-1] * m, *[s[0] for s in spans]], "first": [*[-1] * m, *[s[1] for s in spans]], "last": [*[-1] * m, *[s[2] for s in spans]],
            }
            held.clear()
            return out

        for b in batches:
            columns = [b.column(c).to_pylist() for c in ("__row", "__h", "__a", "__f", "__l", "chosen")]
            searched = sequences((unpack(z) for z in b.column("__z").to_pylist()), words)
            for row, hs, places, firsts, lasts, chosen, data in zip(*columns, searched):
                for c in chosen:
                    i, n = c["i"], c["n"]
                    place, first, last = places[i], firsts[i], lasts[i]
                    h = hs[i]
                    base = (h & 0xFFFFFFFF) if n > limit else (h >> 20) % ranges
                    right, left = data[place : last + LENGTH], data[first:place][::-1]
                    held.append((base, right, left, row, place, first, n))
                    size += len(right) + len(left) + 200
                if size > RUN_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    return arrow_map(candidates, work, "kind int, rng long, run binary, row long, first int, last int")


def _merge(runs: DataFrame) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        found = resolve_runs(list(pdf["run"]), bool(pdf["rng"].iloc[0] < 0))
        a = pd.DataFrame(found.spans, columns=["row", "first", "last"]).assign(kind=1, h=0, g=0, n=0)
        b = pd.DataFrame(found.open, columns=["h", "g", "n", "row", "first"]).assign(kind=2, last=-1)
        return pd.concat([a, b])[["kind", "row", "first", "last", "h", "g", "n"]]

    return runs.groupBy("rng").applyInPandas(run, "kind int, row long, first int, last int, h long, g long, n int")


def repeated_starts(scanned: DataFrame, limit: int = SHARED_LIMIT, words: bool = False) -> tuple[DataFrame, DataFrame]:
    """(spans: row, first, last of repeated window starts; candidate rows with
    their packed texts)."""
    places = scanned.select("__row", F.posexplode("__h").alias("i", "h"))
    counts = materialize(places.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "suffix-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    ranges = max(1, -(-total * 700 // RANGE_BYTES))
    chosen = places.join(counts, "h").groupBy("__row").agg(F.collect_list(F.struct("i", F.col("n").cast("int").alias("n"))).alias("chosen"))
    candidates = materialize(scanned.select("__row", "__z", "__h", "__a", "__f", "__l").join(chosen, "__row"), "suffix-candidates")
    runs = materialize(_make_runs(candidates, ranges, limit, words), "suffix-runs")
    merged = materialize(_merge(runs.where("kind = 0").select("rng", "run")), "suffix-merged")
    spans = runs.where("kind = 1").select("row", "first", "last").union(merged.where("kind = 1").select("row", "first", "last"))
    left = merged.where("kind = 2")
    again = left.groupBy("h", "g").agg(F.sum("n").alias("m")).where("m > 1")
    late = left.where("row >= 0").join(again, ["h", "g"]).select("row", "first", F.col("first").alias("last"))
    spans = materialize(spans.union(late), "suffix-spans")
    for table in (counts, runs, merged):  # none is read from here on
        drop_table(table)
    return spans, candidates


def _cut(data: bytes, spans: list[tuple[int, int]], words: bool = False) -> tuple[bytes, int, int]:
    """Text without the windows that start in the spans; bytes and runs removed."""
    kept, at, removed, runs, end = [], 0, 0, 0, -1
    for first, stop in sorted(_in_text(data, spans, words)):
        if first > end:
            kept.append(data[at:first])
            runs += 1
            removed += stop - first
        elif stop > end:
            removed += stop - end
        else:
            continue
        at = end = max(end, stop)
    kept.append(data[at:])
    return b"".join(kept), removed, runs


def without_repeats(docs: DataFrame, limit: int = SHARED_LIMIT, digests: bool = False, words: bool = False) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut (bytes as UTF-8; a character cut
    in two is dropped); ``digests`` adds n_bytes, n_removed, n_spans and
    kept_sha256.

    With ``words``, every string of ``WORDS`` words that also starts elsewhere is
    cut too, of whatever length in bytes; the blanks around it stay.

    Null and empty texts have no bytes and stay as they are; a repeated row
    repeats the other's strings, so both lose them. Texts shorter than LENGTH
    bytes lose nothing. Other columns may have any names, for inside they have
    others.
    """
    columns = docs.columns
    cut = _cut_texts(docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(columns)]), limit, words)
    if not digests:
        return cut.drop("__bytes", "__removed", "__runs", "__kept_sha").toDF(*columns)
    return cut.toDF(*columns, "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _cut_texts(docs: DataFrame, limit: int, words: bool) -> DataFrame:
    names = docs.columns
    scanned = materialize(_scan(docs.withColumn("__null", F.col("text").isNull()), words), "suffix-scan", "lz4")
    spans, candidates = repeated_starts(scanned, limit, words)
    of_row = spans.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    hit = candidates.select("__row", "__z").join(of_row, F.col("__row") == F.col("row"))

    def cut(batches):
        import zstandard

        unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
        for b in batches:
            out = [_cut(unpack(z), [(s["first"], s["last"]) for s in spans], words) for z, spans in zip(b.column("__z").to_pylist(), b.column("spans").to_pylist())]
            yield {"at": b.column("__row"), "z": [pack(k) for k, _, _ in out], "removed": [r for _, r, _ in out], "runs": [n for _, _, n in out], "sha": [hashlib.sha256(k).hexdigest() for k, _, _ in out]}

    changed = arrow_map(hit, cut, "at long, z binary, removed long, runs long, sha string")
    whole = scanned.drop("__h", "__a", "__f", "__l").join(changed, F.col("__row") == F.col("at"), "left")
    whole = whole.withColumn("__z", F.coalesce("z", "__z"))
    carried = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema]
    whole = whole.select(*[n for n in names if n != "text"], "__z", "__null", F.col("__n").alias("__bytes"), F.coalesce("removed", F.lit(0).cast("long")).alias("__removed"), F.coalesce("runs", F.lit(0).cast("long")).alias("__runs"), F.coalesce("sha", "__sha").alias("__kept_sha"))

    def text(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            texts = [None if null else unpack(z).decode("utf-8", "ignore") for z, null in zip(b.column("__z").to_pylist(), b.column("__null").to_pylist())]
            yield {n: b.column(n) for n in names if n != "text"} | {"text": texts} | {n: b.column(n) for n in ("__bytes", "__removed", "__runs", "__kept_sha")}

    order = [*names, "__bytes", "__removed", "__runs", "__kept_sha"]
    return arrow_map(whole, text, ", ".join([*carried, "__bytes long, __removed long, __runs long, __kept_sha string"])).select(*order)


def removal(docs: DataFrame, limit: int = SHARED_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    scanned = materialize(_scan(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "suffix-scan", "lz4")
    spans, candidates = repeated_starts(scanned, limit)
    of_row = spans.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    hit = candidates.select("__row", "__z").join(of_row, F.col("__row") == F.col("row"))

    def cut(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor().decompress
        for b in batches:
            out = [_cut(unpack(z), [(s["first"], s["last"]) for s in spans]) for z, spans in zip(b.column("__z").to_pylist(), b.column("spans").to_pylist())]
            yield {"at": b.column("__row"), "removed": [r for _, r, _ in out], "runs": [n for _, _, n in out], "sha": [hashlib.sha256(k).hexdigest() for k, _, _ in out]}

    changed = arrow_map(hit, cut, "at long, removed long, runs long, sha string")
    return scanned.select("doc_id", "__row", "__n", "__sha").join(changed, F.col("__row") == F.col("at"), "left").select(
        "doc_id", F.col("__n").alias("n_bytes"), F.coalesce("removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("runs", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("sha", "__sha").alias("kept_sha256")
    )
