"""Toxicity by a subsequence-kernel support vector machine.

Words are compared by the characters they share in order: every three
characters within a span of ``SPAN`` count, weighted ``DECAY`` for each place
of the span, so an insult keeps most of its weight when characters are put
between its letters or letters are drawn apart. Landmark words span the kernel
space (Nyström); a linear machine is trained there on the sentences of
labelled documents. A sentence is as toxic as its most toxic word; of a toxic
document only the sentences that stand out are taken as positive, over a few
rounds. The decision for a word is linear in its subsequences, so the
landmarks fold into one weight per subsequence and scoring needs no landmark.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import GenerationCache, arrow_map, is_training, texts
from .quality_model import training_labels

FOLDS = 5
THRESHOLD = 0.5
#: Labelled rows that the fit may use.
TRAINING_ROWS = 6_000
#: Bytes of text that they may have together.
TRAINING_BYTES = 64 << 20
#: Words of clean documents that a round adds: those that look most toxic.
HARD_WORDS = 2_500
LANDMARKS = 160
ROUNDS = 4
SPAN, DECAY = 6, 0.7
#: A word longer than this is seen in overlapping pieces of this length.
PIECE = 24
BUCKETS = 1 << 18
WORD_MEMO = 250_000

#: Gap patterns: second and third place, with the weight of their span.
PATTERNS = [(a, b, DECAY ** (b + 1)) for b in range(2, SPAN) for a in range(1, b)]
#: Three single characters or more that blanks keep apart are read as a word.
SPACED = re.compile(r"(?<!\S)\S(?:[ \t]\S){2,}(?!\S)")
SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")
#: Marks between letters are gaps of a written word, and dropped.
INNER = re.compile(r"(?<=\w)[^\w\s]+(?=\w)|_")


def words_of(text: str) -> list[str]:
    """Lower-case words, with letters that blanks keep apart put together."""
    if SPACED.search(text):
        text = SPACED.sub(lambda m: re.sub(r"[ \t]", "", m[0]), text)
    words = [w.strip(".,;:!?\"()") for w in text.lower().split()]
    return [w if w.isalnum() else INNER.sub("", w) for w in words]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all pieces (rows, 0 after the end) and each piece's word."""
    owner, pieces = [], []
    for i, w in enumerate(words):
        if len(w) <= PIECE:
            owner.append(i)
            pieces.append(w)
        else:
            for at in range(0, len(w) - SPAN, PIECE - SPAN):
                owner.append(i)
                pieces.append(w[at : at + PIECE])
    flat = np.frombuffer("".join([p.ljust(PIECE, "\0") for p in pieces]).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(pieces), PIECE)
    return flat.astype("i8"), np.array(owner, "i8")


def _slots(codes: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each subsequence of one gap pattern, and whether it is inside."""
    n = PIECE - b
    x, y, z = codes[:, :n], codes[:, a : a + n], codes[:, b:]
    h = (x * 0x9E3779B1 + y * 0x85EBCA77 + z * 0xC2B2AE3D) & 0xFFFFFFFF
    return (h ^ (h >> 15)) & (BUCKETS - 1), z > 0


def fold(words: list[str], weights: np.ndarray) -> np.ndarray:
    """Sum of the weights of each word's subsequences, largest over its pieces."""
    if not words:
        return np.zeros(0)
    codes, owner = _codes(words)
    total = np.zeros(len(codes))
    for a, b, w in PATTERNS:
        slot, inside = _slots(codes, a, b)
        total += w * np.where(inside, weights[slot], 0.0).sum(1)
    out = np.full(len(words), -np.inf)
    np.maximum.at(out, owner, total)
    return out


def subsequences(words: list[str], known: np.ndarray) -> np.ndarray:
    """Dense rows over the buckets that ``known`` numbers (-1: not among them)."""
    codes, owner = _codes(words)
    size = int(known.max()) + 1
    out = np.zeros((len(words), size))
    for a, b, w in PATTERNS:
        slot, inside = _slots(codes, a, b)
        at = np.where(inside, known[slot], -1)
        r, c = np.nonzero(at >= 0)
        out += w * np.bincount(owner[r] * size + at[r, c], minlength=out.size).reshape(out.shape)
    return out


@dataclass
class ToxicModel:
    weights: np.ndarray  # of the buckets, landmarks folded in
    bias: float
    scale: float
    shift: float

    def word_values(self, words: list[str]) -> list[float]:
        return (fold(words, self.weights) + self.bias).tolist()

    def score(self, value):
        return 1.0 / (1.0 + np.exp(-np.clip(self.scale * np.asarray(value) + self.shift, -40, 40)))


#: Value of a text without words.
NO_WORDS = -4.0


def _train_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, c: float = 60.0, steps: int = 25) -> tuple[np.ndarray, float]:
    """Squared-hinge linear machine by Newton steps on the active rows."""
    n, k = x.shape
    one = np.hstack([x, np.ones((n, 1))])
    v, ridge = np.zeros(k + 1), np.r_[np.ones(k), 1e-6]
    active = None
    for _ in range(steps):
        now = y * (one @ v) < 1
        if active is not None and (now == active).all():
            break
        active = now
        a, w = one[active], weight[active] * c
        new = np.linalg.solve(np.diag(ridge) + (a * w[:, None]).T @ a, (a * w[:, None]).T @ y[active])
        v = 0.5 * (v + new) if _ > 8 else new
    return v[:k], float(v[k])


def fit_toxic(rows: list[tuple[str, int]]) -> ToxicModel:
    """From (text, label) of labelled documents; any set gives a model."""
    bags: list[list[list[str]]] = []
    clean: Counter = Counter()
    seen_in: Counter = Counter()
    n_clean = 0
    for text, label in dict.fromkeys(rows):  # copies count once
        if label:
            bag = [[w for w in words_of(s) if w] for s in SENTENCE.split(text)]
            bags.append([s for s in bag if s])
            seen_in.update({w for s in bag for w in s})
        else:
            n_clean += 1
            clean.update({w for w in words_of(text) if w})
    none = ToxicModel(np.zeros(BUCKETS, "f4"), -1.0, 1.0, 0.0)
    if not bags or not n_clean:
        return none
    # how much more often a word is in toxic documents, per document
    n_toxic = len(bags)
    lift = {w: n / n_toxic - 3.0 * clean[w] / n_clean for w, n in seen_in.items() if len(w) > 2}
    strong = sorted(lift, key=lambda w: (-lift[w], w))[: LANDMARKS * 2 // 3]
    usual = [w for w, _ in sorted(clean.items(), key=lambda x: (-x[1], x[0])) if len(w) > 3][: LANDMARKS - len(strong)]
    marks = list(dict.fromkeys([w[:PIECE] for w in strong + usual]))
    if not strong:
        return none
    codes, _ = _codes(marks)
    used = np.unique(np.concatenate([s[i] for s, i in (_slots(codes, a, b) for a, b, _ in PATTERNS)]))
    known = np.full(BUCKETS, -1, "i4")
    known[used] = np.arange(len(used))
    at_marks = subsequences(marks, known)
    norm = np.sqrt(np.maximum((at_marks**2).sum(1), 1e-9))
    at_marks /= norm[:, None]
    values, vectors = np.linalg.eigh(at_marks @ at_marks.T)
    keep = values > 1e-6 * values.max()
    project = at_marks.T @ (vectors[:, keep] / np.sqrt(values[keep]))  # subsequences -> Nyström space

    def features(words: list[str]) -> np.ndarray:
        parts = [subsequences(words[i : i + 2000], known) @ project for i in range(0, len(words), 2000)]
        return np.concatenate(parts) if parts else np.zeros((0, project.shape[1]))

    negative = sorted((w for w in clean if len(w) > 2), key=lambda w: (-clean[w], w))
    own = sorted(w for w in lift if clean[w] < 0.002 * n_clean + 1)
    row_of = {w: i for i, w in enumerate(own)}
    value = np.array([lift[w] for w in own])
    count = np.array([seen_in[w] for w in own])
    # at first: words several toxic documents share and clean ones hardly have
    started = np.flatnonzero((count >= max(3, 0.01 * n_toxic)) & (count / n_toxic > 20 * np.array([clean[w] for w in own]) / n_clean))
    hard = np.arange(min(HARD_WORDS, len(negative)))
    weights = np.zeros(BUCKETS, "f4")
    v, bias = np.zeros(project.shape[1]), 0.0
    for turn in range(ROUNDS):
        chosen: Counter = Counter(dict(zip(started.tolist(), count[started].tolist())) if turn < 2 else {})
        for bag in bags:
            # the sentences that stand out, each by its most toxic word
            tops = [max((row_of[w] for w in s if w in row_of), key=value.__getitem__, default=None) for s in bag]
            tops = [t for t in tops if t is not None]
            if tops:
                most = max(value[t] for t in tops)
                chosen.update(t for t in tops if value[t] == most or (turn and value[t] > 0.5))
        if not chosen:
            return none
        at = np.array(sorted(chosen))
        n = np.sqrt([float(chosen[i]) for i in at])
        stretched = [_stretched(own[i]) for i in at]
        x = np.vstack([features([own[i] for i in at]), features(stretched), features([negative[i] for i in hard])])
        y = np.r_[np.ones(2 * len(at)), -np.ones(len(hard))]
        w = np.r_[n / n.sum(), 0.3 * n / n.sum(), np.full(len(hard), 1.5 / len(hard))] * 400
        v, bias = _train_svm(x, y, w)
        weights[used] = project @ v
        value = fold(own, weights) + bias
        worst = np.argsort(-fold(negative, weights))[:HARD_WORDS]  # the clean words that look most toxic join
        hard = np.union1d(hard, worst)
    del weights
    weights = np.zeros(BUCKETS, "f4")
    weights[used] = project @ v
    model = ToxicModel(weights, bias, 1.0, 0.0)
    memo = GenerationCache(model.word_values, WORD_MEMO)
    d = np.array([document_value(t, memo) for t, _ in rows])
    y = np.array([label for _, label in rows], float)
    a, b = 2.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * d + b, -40, 40)))
        w = p * (1 - p) + 1e-6
        g = np.array([((p - y) * d).sum() + 0.05 * (a - 2), (p - y).sum()])
        h = np.array([[(w * d * d).sum() + 0.05, (w * d).sum()], [(w * d).sum(), w.sum()]])
        step = np.linalg.solve(h, g)
        a, b = a - np.clip(step[0], -2, 2), b - np.clip(step[1], -2, 2)
    model.scale, model.shift = float(max(a, 0.1)), float(b)
    return model


def _stretched(word: str) -> str:
    """The word with a foreign letter in its middle: what the gaps must bear."""
    return f"{word[: len(word) // 2]}x{word[len(word) // 2 :]}"


def document_value(text: str, memo: GenerationCache) -> float:
    found = set(words_of(text))
    found.discard("")
    return combined(list(memo.table(found).values()))


def combined(values: list[float]) -> float:
    """The most toxic word's value, and half of the next one's within limits."""
    if not values:
        return NO_WORDS
    first = max(values)
    values.remove(first)
    return first + 0.5 * min(1.0, max(-1.0, max(values, default=-1.0)))


_memos: dict[int, GenerationCache] = {}


def _memo_of(model: ToxicModel, key: int) -> GenerationCache:
    if key not in _memos:
        _memos.clear()
        _memos[key] = GenerationCache(model.word_values, WORD_MEMO)
    return _memos[key]


def fit_documents(docs: DataFrame, labels: DataFrame, rows: int = TRAINING_ROWS, folds: int = FOLDS) -> ToxicModel:
    """The model of at most ``rows`` labelled documents of at most
    TRAINING_BYTES together, taken in an order of their hashed ids. Labels are
    chosen as in ``training_labels``; null texts train as empty ones, repeated
    rows of ``docs`` each time."""
    chosen = training_labels(labels, "toxic", rows, folds)
    labelled = texts(docs).join(F.broadcast(chosen), "doc_id")
    sizes = labelled.select("doc_id", F.octet_length("text").alias("n")).collect()  # two numbers a row
    fitting, total = [], 0
    for _, doc_id, n in sorted((zlib.crc32(str(r.doc_id).encode()), r.doc_id, r.n) for r in sizes):
        if total + n <= TRAINING_BYTES:
            total += n
            fitting.append((doc_id,))
    if len(fitting) < len(sizes):
        labelled = labelled.join(F.broadcast(docs.sparkSession.createDataFrame(fitting, "doc_id long").distinct()), "doc_id", "left_semi")
    return fit_toxic([(r.text, r.y) for r in labelled.select("text", "y").toLocalIterator()])


def score_documents(docs: DataFrame, model: ToxicModel, folds: int = FOLDS, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted of every text.

    A text is as toxic as its most toxic words. Null and empty texts hold none
    and get the lowest value; repeated rows are scored each.
    """
    sent, key = docs.sparkSession.sparkContext.broadcast(model), hash((model.bias, model.scale, model.shift, float(model.weights.sum())))

    def work(batches):
        memo = _memo_of(sent.value, key)
        for b in batches:
            found = [set(words_of(t)) for t in b.column("text").to_pylist()]
            of = memo.table(set().union(*found) - {""} if found else set())
            s = sent.value.score([combined([of[w] for w in f if w]) for f in found]) if found else np.zeros(0)
            yield {"doc_id": b.column("doc_id"), "score": s, "predicted": (s >= threshold).astype("int32")}

    scored = arrow_map(texts(docs), work, "doc_id long, score double, predicted int")
    held = ~F.coalesce(is_training(F.col("doc_id"), folds), F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")
