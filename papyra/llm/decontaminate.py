"""Benchmark decontamination: BM25 over the test items with block-max WAND.

The items form the inverted index, the passages of the training texts are the
queries. Impacts are divided by the score an item gives itself, so a score says
which share of an item a passage carries and one threshold suits all items.
A passage whose rare words cannot bring any item to the threshold, even with all
frequent words of that item, is left out at once (a bound, not a guess); for
the others block-max WAND retrieves every item at or above the threshold. A hit counts when the passage
also holds most of the item's question, as word triples, and of its answer.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, bound_batches

K1, B = 1.2, 0.75
THRESHOLD = 0.5
#: Shares of the question's word triples and of the answer's words to be found.
QUESTION_SHARE, ANSWER_SHARE = 0.6, 0.6
BLOCK = 16
#: Words in most items are left out of the first bound, as long as they make up
#: no more than this share of any item.
FREQUENT_SHARE = 0.3
#: Items of one index, and indexes that one scan of the texts sends to its tasks.
SHARD_ITEMS, SHARDS_A_SCAN = 20_000, 4

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def question_and_answer(text: str) -> tuple[list[str], list[str]]:
    """The answer is the last line or sentence; of an item that is one sentence,
    the last quarter of its words."""
    parts = [p for p in (words_of(x) for x in re.split(r"\n+|(?<=[.?!])\s+", text)) if p]
    words = [w for p in parts for w in p]
    if len(parts) > 1 and len(parts[-1]) < len(words):
        cut = len(words) - len(parts[-1])
    else:
        cut = len(words) - max(1, len(words) // 4)
    return words[:cut], words[cut:]


@dataclass
class Statistics:
    """Of all items: their number, mean and greatest length in words, and in how
    many a word occurs."""

    n: int
    mean: float
    longest: int
    df: dict[str, int]

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Statistics:
        words = [x for x in (words_of(t) for _, t in items) if x]
        sizes = [len(x) for x in words]
        return Statistics(len(sizes), sum(sizes) / max(1, len(sizes)), max(sizes, default=0), Counter(w for x in words for w in set(x)))


class ItemIndex:
    """Inverted index of some items with impacts, block maxima and bounds.

    ``whole``: statistics of all items where these are only a shard of them, so
    that an item has the same scores and windows in a shard of any size.
    """

    def __init__(self, items: list[tuple[int, str]], whole: Statistics | None = None):
        whole = whole or Statistics.of(items)
        self.ids, self.items = [], []
        counted = []
        for item_id, text in items:
            words = words_of(text)
            if words:
                self.ids.append(item_id)
                self.items.append(question_and_answer(text))
                counted.append(Counter(words))
        n = len(self.ids)
        self.longest, mean = whole.longest, whole.mean or 1.0
        df = dict.fromkeys(w for c in counted for w in c)
        idf = {w: math.log(1 + (whole.n - whole.df[w] + 0.5) / (whole.df[w] + 0.5)) for w in df}
        self.term = {w: i for i, w in enumerate(df)}
        lists: list[list[tuple[int, float]]] = [[] for _ in df]
        for i, c in enumerate(counted):
            size = sum(c.values())
            impact = {w: idf[w] * f * (K1 + 1) / (f + K1 * (1 - B + B * size / mean)) for w, f in c.items()}
            whole = sum(impact.values())
            for w, x in impact.items():
                lists[self.term[w]].append((i, x / whole))
        self.postings = [([i for i, _ in p], [x for _, x in p]) for p in lists]
        self.bound = np.array([max(x for _, x in p) for p in lists] + [0.0])
        self.blocks = [[(p[min(k + BLOCK, len(p)) - 1][0], max(x for _, x in p[k : k + BLOCK])) for k in range(0, len(p), BLOCK)] for p in lists]
        spent, self.rare = np.zeros(n), np.ones(len(lists) + 1, bool)
        self.rare[-1] = False
        for t in sorted(range(len(lists)), key=lambda t: (-len(lists[t]), t)):
            ids, impacts = self.postings[t]
            if (spent[ids] + impacts > FREQUENT_SHARE).any():
                break
            spent[ids] += impacts
            self.rare[t] = False
        self.needed = THRESHOLD - spent - 1e-9
        self.sizes = np.array([len(p) for p in lists] + [0])
        self.offsets = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        self.flat_items = np.array([i for p, _ in self.postings for i in p], "i8")
        self.flat_impacts = np.array([x for _, p in self.postings for x in p])
        self.sets = [({tuple(q[k : k + 3]) for k in range(max(1, len(q) - 2))} if q else set(), set(a)) for q, a in self.items]

    def search(self, terms: list[int], threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """Every item whose score for these distinct terms reaches the threshold."""
        at = {t: 0 for t in terms}
        block = {t: 0 for t in terms}
        live = list(terms)
        found = []
        while live:
            live.sort(key=lambda t: self.postings[t][0][at[t]])
            total, pivot = 0.0, -1
            for k, t in enumerate(live):
                total += self.bound[t]
                if total >= threshold - 1e-12:
                    pivot = k
                    break
            if pivot < 0:
                break
            item = self.postings[live[pivot]][0][at[live[pivot]]]
            while pivot + 1 < len(live) and self.postings[live[pivot + 1]][0][at[live[pivot + 1]]] == item:
                pivot += 1
            upper, ends = 0.0, []
            for t in live[: pivot + 1]:
                bs, k = self.blocks[t], block[t]
                while k < len(bs) and bs[k][0] < item:
                    k += 1
                block[t] = k
                if k < len(bs):
                    upper += bs[k][1]
                    ends.append(bs[k][0])
            if upper < threshold - 1e-12:
                # no item up to the nearest block end can reach it
                goal = min([*ends, *(self.postings[t][0][at[t]] - 1 for t in live[pivot + 1 : pivot + 2])], default=item) + 1
                goal = max(goal, item + 1)
            elif self.postings[live[0]][0][at[live[0]]] == item:
                score = sum(self.postings[t][1][at[t]] for t in live[: pivot + 1] if self.postings[t][0][at[t]] == item)
                if score >= threshold - 1e-12:
                    found.append((item, score))
                goal = item + 1
            else:
                goal = item
            kept = []
            for k, t in enumerate(live):
                if k <= pivot:
                    docs, p = self.postings[t][0], at[t]
                    while p < len(docs) and docs[p] < goal:
                        p += 1
                    at[t] = p
                    if p == len(docs):
                        continue
                kept.append(t)
            live = kept
        return found

    def passages(self, terms: np.ndarray, block: np.ndarray) -> set[int]:
        """First blocks of the passages of two blocks that may hold an item.

        ``block`` numbers the blocks of ``longest`` words over a whole batch,
        ascending, with a gap after each text; an item fits into one passage.
        """
        n, t = len(self.ids), len(self.rare)
        at = self.rare[terms]
        key = np.unique(block[at] * t + terms[at])
        owner, term = np.divmod(key, t)
        size = self.sizes[term]
        place = np.repeat(self.offsets[term] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
        pair = np.repeat(owner, size) * n + self.flat_items[place]
        order = np.argsort(pair, kind="stable")
        pair, impact = pair[order], self.flat_impacts[place][order]
        if not len(pair):
            return set()
        first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
        pair, total = pair[first], np.add.reduceat(impact, first)
        nxt = np.minimum(np.searchsorted(pair, pair + n), len(pair) - 1)
        both = total + np.where(pair[nxt] == pair + n, total[nxt], 0.0)
        needed = self.needed[pair % n]
        return set((pair[both >= needed] // n).tolist()) | set((pair[total >= needed] // n - 1).tolist())

    def hits_of(self, batch: list[str | None]) -> list[list[tuple[int, float, float, float, int]]]:
        """For each text (item, score, question share, answer share, first word)
        of its best passage for each item it holds."""
        out: list[list] = [[] for _ in batch]
        if not self.ids:
            return out
        get, none, size = self.term.get, len(self.term), self.longest
        split = [words_of(t) for t in batch]
        terms = [np.fromiter([get(w, none) for w in words], "i8", len(words)) for words in split]
        starts, at = [], 1
        for words in split:
            starts.append(at)
            at += len(words) // size + 2
        block = np.concatenate([s + np.arange(len(x)) // size for s, x in zip(starts, terms)]) if terms else np.zeros(0, "i8")
        may = sorted(self.passages(np.concatenate(terms), block)) if terms else []
        text_of = np.searchsorted(starts, may, "right") - 1
        best: dict[tuple[int, int], tuple] = {}
        for k, i in zip(may, text_of.tolist()):
            if i < 0:
                continue
            a = (k - starts[i]) * size
            part = split[i][max(a, 0) : a + 2 * size]
            for item, score in self.search(sorted(set(terms[i][max(a, 0) : a + 2 * size].tolist()) - {none})):
                triples, single = set(zip(part, part[1:], part[2:])), set(part)
                q, answer = self.sets[item]
                if q and len(next(iter(q))) < 3:
                    in_q = sum(all(w in single for w in x) for x in q) / len(q)
                else:
                    in_q = len(q & triples) / len(q) if q else 1.0
                in_a = len(answer & single) / len(answer)
                if in_q >= QUESTION_SHARE and in_a >= ANSWER_SHARE and score > best.get((i, item), (-1.0,))[0]:
                    best[i, item] = (score, in_q, in_a, max(a, 0))
        for (i, item), rest in best.items():
            out[i].append((self.ids[item], *rest))
        return out

    def hits(self, text: str | None) -> list[tuple[int, float, float, float, int]]:
        return self.hits_of([text])[0]


def indexes(benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> list[ItemIndex]:
    """One index for each ``shard_items`` items; null and wordless items are
    left out, repeated rows count once.

    Statistics are those of all items. Words are counted in Spark; a shard's
    items and the counts of its words come to the driver, one shard at a time.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).distinct()

    def counted(batches):
        for b in batches:
            split = [(i, words_of(t)) for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist())]
            rows = [(i, w, len(words), k == 0) for i, words in split for k, w in enumerate(dict.fromkeys(words))]
            yield dict(zip(("item_id", "word", "size", "first"), map(list, zip(*rows)))) if rows else {"item_id": [], "word": [], "size": [], "first": []}

    shards = max(1, math.ceil(items.count() / shard_items))
    if shards == 1:
        found = sorted((r["item_id"], r["text"]) for r in items.collect())
        return [ItemIndex(found)]
    words = arrow_map(items, counted, "item_id long, word string, size long, first boolean")
    n, mean, longest = words.where("first").agg(F.count("*"), F.avg("size"), F.max("size")).first()
    df = words.groupBy("word").agg(F.count("*").alias("df"))
    shard = F.pmod(F.xxhash64("item_id"), F.lit(shards))
    out = []
    for k in range(shards):
        part = sorted((r["item_id"], r["text"]) for r in items.where(shard == k).collect())
        own = {r["word"]: r["df"] for r in df.join(words.where(shard == k).select("word").distinct(), "word").collect()}
        out.append(ItemIndex(part, Statistics(n, mean, longest, own)))
    return out


def _sent(docs: DataFrame, benchmark: DataFrame, shard_items: int) -> list:
    """The shards in groups of ``SHARDS_A_SCAN``, each a broadcast of a size
    that ``SHARD_ITEMS`` bounds."""
    found = indexes(benchmark, shard_items)
    return [docs.sparkSession.sparkContext.broadcast(found[k : k + SHARDS_A_SCAN]) for k in range(0, len(found), SHARDS_A_SCAN)]


def contamination(docs: DataFrame, benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """One row per document and item it holds: doc_id, item_id, score, the
    shares of question and answer, and the word its passage starts at.

    Null and empty texts hold nothing, an empty benchmark gives no rows,
    repeated rows are reported each; other columns are ignored. The rows do not
    depend on ``shard_items``; a scan of the texts serves ``SHARDS_A_SCAN``
    shards.
    """
    names = ("doc_id", "item_id", "score", "question_share", "answer_share", "first_word")
    found = None
    for sent in _sent(docs, benchmark, shard_items):

        def work(batches, sent=sent):
            for b in batches:
                ids, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
                rows = [(d, *h) for index in sent.value for d, hits in zip(ids, index.hits_of(texts)) for h in hits]
                yield dict(zip(names, map(list, zip(*rows)))) if rows else {k: [] for k in names}

        part = arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, item_id long, score double, question_share double, answer_share double, first_word int")
        found = part if found is None else found.unionByName(part)
    return found


def decontaminated(docs: DataFrame, benchmark: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """The rows of ``docs`` that hold no item, all columns as they are.

    Texts are judged one by one, so nothing is shuffled. Null texts stay.
    """
    bound_batches(docs.sparkSession)
    for sent in _sent(docs, benchmark, shard_items):
        docs = docs.where(~_holds(sent)(F.col("text")))
    return docs


def _holds(sent):
    @F.pandas_udf("boolean")
    def holds(text: pd.Series) -> pd.Series:
        texts = text.tolist()
        out = np.zeros(len(texts), bool)
        for index in sent.value:
            out |= np.array([bool(h) for h in index.hits_of(texts)], bool)
        return pd.Series(out)

    return holds
