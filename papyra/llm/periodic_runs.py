"""Runs of words that repeat with a period, by bit-parallel lags.

The words of many texts lie one behind the other as a row of word ids, each
text closed by an id of its own that matches nothing. Bit b of all ids is one
big integer, a plane. For a lag q every plane is XORed with itself shifted by q
and the results are ORed: a zero bit says that the words there and q further on
are the same. A run of period q and length n is a maximal stretch of n - q zero
bits; shift-doubling ANDs leave only stretches of the length asked for.

A lag of 32 and more first looks at every s-th word (s: a power of two, at most
a sixteenth of the lag): a stretch that is long enough holds 48 of them in a
row, so a lag without such a row needs no full planes. That makes the work of
all lags near linear in the words, and loses no run.

A stretch whose smallest period is a proper divisor of the lag is a run found
before at that divisor, with the same two ends, and is masked at its multiples.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blocks, texts

#: A run has at least so many words, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that share their planes.
GROUP_WORDS = 1 << 18
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"


class Planes:
    """Bit planes of a row of ids, of every ``step``-th id too."""

    def __init__(self, ids: np.ndarray):
        self.ids, self.bits, self.kept = ids, max(1, int(ids.max()).bit_length()), {}

    def of(self, step: int, bit: int) -> list[int]:
        """For each remainder r the bits of ids r, r + step, r + 2 * step, ..."""
        found = self.kept.get((step, bit))
        if found is None:
            on = np.zeros(-(-len(self.ids) // step) * step, np.uint8)
            on[: len(self.ids)] = (self.ids >> bit) & 1
            rows = np.packbits(on.reshape(-1, step).T, axis=1, bitorder="little")
            found = self.kept[step, bit] = [int.from_bytes(r.tobytes(), "little") for r in rows]
        return found

    def forget(self, step: int) -> None:
        """Drop the planes of a step that no further lag takes."""
        for key in [k for k in self.kept if k[0] == step]:
            del self.kept[key]


def long_stretches(same: int, least: int) -> int:
    """Bit i is set where bits i to i + least - 1 of ``same`` are."""
    have = 1
    while have < least and same:
        more = min(have, least - have)
        same &= same >> more
        have += more
    return same


def _masked(same: int, known: list[tuple[int, int]], lag: int, step: int) -> int:
    """``same`` without the stretches of runs known at a divisor of the lag."""
    for start, end in known:
        a, b = -(-start // step), -(-(end - lag) // step)
        if b > a:
            same &= ~(((1 << (b - a)) - 1) << a)
    return same


def _surviving(planes: Planes, lag: int, step: int, least: int, known: list) -> tuple[int, int]:
    """Equal positions of a lag among every ``step``-th, and where long
    stretches of them begin; planes are added only while there are any."""
    ahead, r = divmod(lag, step)
    same = (1 << -(-(len(planes.ids) - lag) // step)) - 1
    need, left = least // step, 0
    for bit in range(planes.bits):
        row = planes.of(step, bit)
        same &= ~(row[0] ^ (row[r] >> ahead))
        if bit & 1 or bit + 1 == planes.bits:
            left = long_stretches(same, need)
            if left and known:
                same, known = _masked(same, known, lag, step), []
                left = long_stretches(same, need)
            if not left:
                break
    return same, left


def _set_bits(x: int) -> np.ndarray:
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little"))


def runs_of(ids: np.ndarray, longest: int, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs; ``longest``: words of the longest
    text in the row of ids."""
    found: list[tuple[int, int, int]] = []
    if longest < least_words:
        return found
    planes, known, step = Planes(ids), defaultdict(list), 1
    for lag in range(1, longest // least_periods + 1):
        while lag >= 32 * step:
            if step > 1:
                planes.forget(step)
            step *= 2
        least = max(least_words, least_periods * lag) - lag
        masks = known.pop(lag, [])
        left = _surviving(planes, lag, step, least, masks)[1]
        if left and step > 1:
            left = _surviving(planes, lag, 1, least, masks)[1]
        if not left:
            continue
        first, last = _set_bits(left & ~(left << 1)), _set_bits(left & ~(left >> 1))
        for a, b in zip(first.tolist(), last.tolist()):
            n = b - a + least + lag
            found.append((a, n, lag))
            for multiple in range(2 * lag, n // least_periods + 1, lag):
                known[multiple].append((a, a + n))
    return found


def _words(block: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and where each text's words begin (and
    the last one's end)."""
    parts = pc.ascii_split_whitespace(block)
    words, at = parts.flatten(), parts.offsets.to_numpy().astype("i8")
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    return words.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[at - at[0]]


def block_runs(codes: np.ndarray, at: np.ndarray, **limits: int) -> list[list[tuple[int, int, int]]]:
    """The runs of each text, by start and period; texts of like length share
    their planes, so that a lag is worked out once for all of them."""
    sizes, top = np.diff(at), int(codes.max(initial=0)) + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in sizes]

    def take(group: list[int]) -> None:
        n = sizes[group]
        where = np.concatenate([[0], np.cumsum(n + 1)])
        row = np.empty(where[-1], "i8")
        for j, i in enumerate(group):
            row[where[j] : where[j + 1] - 1] = codes[at[i] : at[i + 1]]
            row[where[j + 1] - 1] = top + j
        for start, length, period in runs_of(row, int(n.max()), **limits):
            j = int(np.searchsorted(where, start, "right")) - 1
            out[group[j]].append((start - int(where[j]), length, period))

    group, held = [], 0
    for i in np.argsort(sizes, kind="stable").tolist():
        if held and held + sizes[i] > GROUP_WORDS:
            take(group)
            group, held = [], 0
        group.append(i)
        held += int(sizes[i])
    if group:
        take(group)
    return [sorted(x, key=lambda r: (r[0], r[2])) for x in out]


def periodic_runs(docs: DataFrame, least_words: int = LEAST_WORDS, least_periods: int = LEAST_PERIODS) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and ``collapsed`` of every row.

    A run is a stretch of words with smallest period q and a length of at least
    ``max(least_words, least_periods * q)`` that can't be made longer at either
    end; ``runs`` are sorted by start, then period. ``collapsed`` has the words,
    joined by one space, without those that some run contains after its first q
    words. Rows are independent: repeated rows and null ids give a row each,
    null and blank texts have no words, no runs and an empty ``collapsed``.
    Columns other than doc_id and text are not read.
    """
    limits = {"least_words": least_words, "least_periods": least_periods}

    def work(batches):
        for b in blocks(batches):
            words, at = _words(b.column("text"))
            codes = words.dictionary_encode().indices.to_numpy().astype("i8")
            found, sizes = block_runs(codes, at, **limits), np.diff(at)
            dropped = np.zeros(len(words) + 1, "i8")
            for base, runs in zip(at[:-1].tolist(), found):
                for start, length, period in runs:
                    dropped[base + start + period] += 1
                    dropped[base + start + length] -= 1
            keep = np.cumsum(dropped[:-1]) == 0
            left = np.concatenate([[0], np.cumsum(keep)])[at]
            lists = pa.ListArray.from_arrays(pa.array(left.astype("i4")), words.filter(pa.array(keep)))
            kept = pc.binary_join(lists, " ")
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found]
            yield {"doc_id": b.column("doc_id"), "n_words": pa.array(sizes), "runs": runs, "collapsed": kept}

    return arrow_map(texts(docs), work, f"doc_id bigint, n_words bigint, runs {RUNS}, collapsed string")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """The texts of a tenth of the documents made periodic from a word on.

    With h the CRC-32 of the decimal doc_id, g = h div 10 and n words: if h is
    divisible by ten, each word i from a = g mod n on becomes word a + (i - a)
    mod p, where p = 1 + (n - a) div (3 + g mod 8). Other rows, rows without
    words and rows without an id stay as they are.
    """
    d = texts(docs).withColumn("h", F.crc32(F.col("doc_id").cast("string").cast("binary")))
    d = d.withColumn("words", F.when(F.col("h") % 10 == 0, F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))))
    d = d.withColumn("n", F.size("words").cast("long")).withColumn("g", F.floor(F.col("h") / 10).cast("long"))
    d = d.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    d = d.withColumn("p", F.lit(1) + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8)).cast("long"))
    source = lambda i: F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))
    edited = F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("n") - 1), lambda i: F.get("words", source(i).cast("int"))), " ")
    return d.select("doc_id", F.when(F.col("a").isNotNull(), edited).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) of each row of
    :func:`periodic_runs`, and digests of all runs and of the kept words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))

    def sha(text: Column) -> Column:
        return F.sha2(text.cast("binary"), 256)

    d = found.withColumn("best", best)
    length, start, period = F.col("best.n"), -F.col("best.s"), -F.col("best.q")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"), sha(F.array_join(lines, "")).alias("runs_sha256"), sha(F.col("collapsed")).alias("collapsed_sha256"),
    )
