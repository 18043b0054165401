"""Language-model scores: a hashed maximum-entropy model over classes of words.

The softmax is factored: the class of a word, then its slot in the class, then
the word in the slot. Classes come from the data: the ``OWN`` most frequent
training words have slots of their own, all others share ``SHARED_SLOTS`` slots
of each class by a hash of the whole word, and have the smoothed share of their
slot that their count gives; the end of a text is a class of its own.

Both softmaxes are maximum-entropy models. The class meets features of the word
before (n-gram), of the one two before (skip) and of both; the slot meets the
class with the word before. A feature names a frequent word itself and any
other by a hash of the whole word. All training tokens reduce without loss to
the counts that the gradients need; gradient updates run distributed over the
contexts. Texts are scored in sparse batches: the contexts of a block, each
distinct word looked up once.
"""

from __future__ import annotations

import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, blocks, coded_words, drop_table, is_training, materialize, texts

FOLDS = 10
#: Added to each count, of the base and of the words of a slot.
ADDED = 0.1
CLASSES, SLOTS, SHARED_SLOTS = 64, 64, 16  # besides the class of the end
OWN = CLASSES * (SLOTS - SHARED_SLOTS)
END_CLASS, END_CELL = CLASSES, CLASSES * SLOTS
#: Values of the context features, how many of them name a frequent word, and
#: the buckets of both together.
PREVIOUS, NAMED_PREVIOUS = 512, 384
SKIPPED, NAMED_SKIPPED = 128, 96
PAIRS = 1024
#: Values for "no word yet".
NO_PREVIOUS, NO_SKIPPED = PREVIOUS, SKIPPED
STEPS, RATE, RIDGE = 30, 0.4, 1e-6
SLOT_STEPS, SLOT_RIDGE = 20, 1.0
#: The most frequent words, at most so many of at most so many bytes, go to
#: every task; the counts of all others reach their texts through a join.
SENT_WORDS, SENT_BYTES = 150_000, 48
#: Bytes of text that are counted or scored at once.
LM_BYTES = 4 << 20
#: The end of a text among the words; no word holds a blank.
END = b" "
#: Counted cells: contexts of the class, each feature by class, then slots by
#: class and word before.
CONTEXTS = (PREVIOUS + 1) * (SKIPPED + 1)
FEATURES = (PREVIOUS + 1, SKIPPED + 1, PAIRS)
SLOT_CONTEXTS = CLASSES * (PREVIOUS + 1)
SLOTS_AT = CONTEXTS + sum(FEATURES) * (CLASSES + 1)
CELLS = SLOTS_AT + SLOT_CONTEXTS * SLOTS


def gather_words(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Partial counts of all training tokens: word (bytes), n."""

    def work(batches):
        for b in blocks(batches, limit=LM_BYTES):
            codes, at, words = coded_words(b.column("text"))
            yield {"word": pa.concat_arrays([words.cast(pa.binary()), pa.array([END], pa.binary())]), "n": np.append(np.bincount(codes, minlength=len(words)), len(at) - 1)}

    return arrow_map(texts(docs).where(is_training(F.col("doc_id"), folds)), work, "word binary, n long")


def frequent(counts: DataFrame, limit: int) -> pa.Table:
    """Words at or above the smallest count that leaves ``limit`` of them at
    most, the most frequent first: a filter, so that tasks send no more than
    what is used, and bounded in bytes by SENT_BYTES a word."""
    short = counts.where((F.length("word") <= SENT_BYTES) & (F.col("word") != F.lit(END)))
    ladder = short.groupBy(F.least("n", F.lit(100_000)).alias("n")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).collect()
    least, words = 1 << 62, 0
    for r in ladder:  # at most 100,000 steps
        words += r["words"]
        if words > limit:
            break
        least = r["n"]
    return short.where(F.col("n") >= least).toArrow().sort_by([("n", "descending"), ("word", "ascending")])


class Words:
    """Cells and context features of words, by rank among the frequent ones
    and by a hash of the whole word for all others."""

    def __init__(self, top: pa.Table):
        self.rank = dict(zip(top.column("word").to_pylist(), range(top.num_rows)))
        self.logs = np.append(np.log10(top.column("n").to_numpy().astype("f8") + ADDED), 0.0)

    def of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """rank (-1: not sent), cell, previous and skipped value of each word."""
        plain, get, crc = words.cast(pa.binary()).to_pylist(), self.rank.get, zlib.crc32
        rank = np.fromiter((get(w, -1) for w in plain), "i8", len(plain))
        h = np.fromiter(map(crc, plain), "i8", len(plain))
        named = lambda limit: (rank >= 0) & (rank < limit)
        shared = h % CLASSES * SLOTS + SLOTS - SHARED_SLOTS + (h >> 6) % SHARED_SLOTS
        cell = np.where(named(OWN), rank % CLASSES * SLOTS + rank // CLASSES, shared)
        previous = np.where(named(NAMED_PREVIOUS), rank, NAMED_PREVIOUS + (h >> 10) % (PREVIOUS - NAMED_PREVIOUS))
        skipped = np.where(named(NAMED_SKIPPED), rank, NAMED_SKIPPED + (h >> 18) % (SKIPPED - NAMED_SKIPPED))
        return rank, cell, previous, skipped


def _sequence(codes: np.ndarray, at: np.ndarray, cell: np.ndarray, previous: np.ndarray, skipped: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cell and both context values of all tokens, ends of texts included, and
    where each text begins."""
    docs = np.arange(len(at) - 1)
    starts, ends = at[:-1] + docs, at[1:] + docs
    total = len(codes) + len(docs)
    word = np.ones(total, bool)
    word[ends] = False
    cells, prev, skip = np.full(total, END_CELL), np.full(total, NO_PREVIOUS), np.full(total, NO_SKIPPED)
    cells[word] = cell[codes]
    p, s = np.zeros(total, "i8"), np.zeros(total, "i8")
    p[word], s[word] = previous[codes], skipped[codes]
    prev[1:], skip[2:] = p[:-1], s[:-2]
    prev[starts], skip[starts] = NO_PREVIOUS, NO_SKIPPED
    skip[starts[ends > starts] + 1] = NO_SKIPPED
    return cells, prev, skip, np.append(starts, total)


def _pair(prev: np.ndarray, skip: np.ndarray) -> np.ndarray:
    return ((prev * 2654435761 + skip * 40503) >> 7) % PAIRS


def gather_contexts(docs: DataFrame, sent, key: str, folds: int = FOLDS) -> DataFrame:
    """Partial counts of all cells over the training texts: cell, n. A task's
    counts are one vector, of which it gives what is not zero."""

    def work(batches):
        words, counts = _words_of(sent, key), np.zeros(CELLS, "i4")
        for b in blocks(batches, limit=LM_BYTES):
            codes, at, found = coded_words(b.column("text"))
            cells, prev, skip, _ = _sequence(codes, at, *words.of(found)[1:])
            cls = cells // SLOTS
            counts[:CONTEXTS] += np.bincount(prev * (SKIPPED + 1) + skip, minlength=CONTEXTS).astype("i4")
            base = CONTEXTS
            for feature, size in zip((prev, skip, _pair(prev, skip)), FEATURES):
                n = size * (CLASSES + 1)
                counts[base : base + n] += np.bincount(feature * (CLASSES + 1) + cls, minlength=n).astype("i4")
                base += n
            inner = cls < CLASSES
            where, n = np.unique((cls[inner] * (PREVIOUS + 1) + prev[inner]) * SLOTS + cells[inner] % SLOTS, return_counts=True)
            counts[SLOTS_AT + where] += n.astype("i4")
        some = np.flatnonzero(counts)
        for a in range(0, len(some), 1 << 20):
            yield {"cell": some[a : a + (1 << 20)].astype("i4"), "n": counts[some[a : a + (1 << 20)]].astype("i8")}

    return arrow_map(texts(docs).where(is_training(F.col("doc_id"), folds)), work, "cell int, n long")


@dataclass
class ClassModel:
    bias: np.ndarray
    previous: np.ndarray
    skipped: np.ndarray
    pairs: np.ndarray

    @staticmethod
    def start(totals: np.ndarray) -> ClassModel:
        p = (totals + 1.0) / (totals.sum() + len(totals))
        return ClassModel(np.log(p), np.zeros((PREVIOUS + 1, CLASSES + 1)), np.zeros((SKIPPED + 1, CLASSES + 1)), np.zeros((PAIRS, CLASSES + 1)))

    def parts(self) -> list[np.ndarray]:
        return [self.bias, self.previous, self.skipped, self.pairs]

    def log_p(self, prev: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of all classes in each context."""
        z = self.bias + self.previous[prev] + self.skipped[skip] + self.pairs[_pair(prev, skip)]
        z -= z.max(1, keepdims=True)
        return z - np.log(np.exp(z).sum(1, keepdims=True))


def expected(model: ClassModel, ctx: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Expected counts of every weight over some contexts, flat."""
    prev, skip = np.divmod(ctx, SKIPPED + 1)
    mass = n[:, None] * np.exp(model.log_p(prev, skip))
    g = [np.zeros_like(p) for p in model.parts()]
    g[0] += mass.sum(0)
    for into, at in zip(g[1:], (prev, skip, _pair(prev, skip))):
        np.add.at(into, at, mass)
    return np.concatenate([x.ravel() for x in g])


def train(contexts: DataFrame, observed: np.ndarray, totals: np.ndarray, steps: int = STEPS) -> ClassModel:
    """Distributed gradient updates. ``contexts``: ctx int, n long.

    ``observed``: how often each class met each feature's values, flat. Every
    update sums the expected counts of the partitions (a vector of fixed size
    each), takes them from the observed ones and moves by an adaptive step.
    """
    model, n = ClassModel.start(totals), max(1.0, float(totals.sum()))
    seen = np.concatenate([totals, observed]) / n
    first, second = np.zeros(len(seen)), np.zeros(len(seen))
    spark = contexts.sparkSession
    for step in range(1, steps + 1):
        sent = spark.sparkContext.broadcast(model)

        def work(batches, sent=sent):
            total = None
            for b in batches:
                if b.num_rows:
                    g = expected(sent.value, b.column("ctx").to_numpy().astype("i8"), b.column("n").to_numpy().astype(float))
                    total = g if total is None else total + g
            if total is not None:
                yield {"g": [total.astype("f4").tobytes()]}

        parts = [np.frombuffer(r["g"], "f4").astype("f8") for r in arrow_map(contexts, work, "g binary").collect()]
        sent.destroy()
        if not parts:
            return model
        flat = np.concatenate([p.ravel() for p in model.parts()])
        g = seen - np.sum(parts, axis=0) / n - RIDGE * flat
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        flat = flat + RATE / np.sqrt(step) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-7)
        at, moved = 0, []
        for p in model.parts():
            moved.append(flat[at : at + p.size].reshape(p.shape))
            at += p.size
        model = ClassModel(*moved)
    return model


def slot_weights(n: np.ndarray, bias: np.ndarray, steps: int = SLOT_STEPS) -> np.ndarray:
    """Log-probabilities of the slots in some contexts: maximum entropy with a
    ridge on what a context adds to the ``bias`` of its class. n, bias: one row
    a context. Gradient updates, each divided by its curvature."""
    w, total = np.zeros_like(bias), n.sum(1, keepdims=True)
    for step in range(steps + 1):
        z = bias + w
        z -= z.max(1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(1, keepdims=True))
        if step < steps:
            p = np.exp(log_p)
            move = (n - total * p - SLOT_RIDGE * w) / (total * p * (1 - p) + SLOT_RIDGE)
            w = w + np.clip(0.8 * move, -1.5, 1.5)
    return log_p


def train_slots(cells: DataFrame, bias: np.ndarray) -> DataFrame:
    """ctx, log_p (a float32 for each slot): every context's updates need that
    context alone, so contexts are trained where they are. ``cells``: ctx,
    slot, n; a context has at most ``SLOTS`` of them."""
    rows = cells.groupBy("ctx").agg(F.collect_list("slot").alias("slots"), F.collect_list("n").alias("ns"))

    def work(batches):
        for b in batches:
            if b.num_rows:
                ctx = b.column("ctx").to_numpy().astype("i8")
                n = np.zeros((len(ctx), SLOTS))
                owner = np.repeat(np.arange(len(ctx)), np.diff(b.column("slots").offsets.to_numpy()))
                n[owner, b.column("slots").flatten().to_numpy()] = b.column("ns").flatten().to_numpy()
                found = slot_weights(n, bias[ctx // (PREVIOUS + 1)])
                yield {"ctx": b.column("ctx"), "log_p": [row.tobytes() for row in found.astype("f4")]}

    return arrow_map(rows, work, "ctx int, log_p binary")


@dataclass
class LanguageModel:
    counts: DataFrame  # word, n: of every training token, materialized
    train_tokens: int
    vocabulary: int
    end_count: int
    top: pa.Table  # the frequent words and their counts, in order
    classes: ClassModel
    slots: np.ndarray  # log-probabilities by class and word before, then slot
    log_cells: np.ndarray  # log10 of what a cell's words share
    key: str

    def log_parts(self, cells: np.ndarray, prev: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """log10 probability of each token's cell in its context."""
        cls = cells // SLOTS
        ctx, inverse = np.unique(prev * (SKIPPED + 1) + skip, return_inverse=True)
        out = np.empty(len(cells))
        order = np.argsort(inverse, kind="stable")
        for a in range(0, len(ctx), 1 << 14):  # so many contexts at once
            rows = self.classes.log_p(*np.divmod(ctx[a : a + (1 << 14)], SKIPPED + 1))
            lo, hi = np.searchsorted(inverse[order], [a, a + (1 << 14)])
            some = order[lo:hi]
            out[some] = rows[inverse[some] - a, cls[some]]
        inner = cls < CLASSES
        out[inner] += self.slots[cls[inner] * (PREVIOUS + 1) + prev[inner], cells[inner] % SLOTS]
        return out / np.log(10)


def fit(docs: DataFrame, folds: int = FOLDS, sent_words: int = SENT_WORDS) -> LanguageModel:
    """The model of all training texts. Null texts hold the end alone; a row
    repeated counts as often as it occurs; a null doc_id is in training. With
    no training text every probability is that of the smoothing."""
    spark = docs.sparkSession
    gathered = materialize(gather_words(docs, folds), "lm-words")
    counts = materialize(gathered.where("n > 0").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    drop_table(gathered)
    top = frequent(counts, sent_words)
    sent = spark.sparkContext.broadcast(top)
    key = uuid.uuid4().hex
    partial = materialize(gather_contexts(docs, sent, key, folds), "lm-contexts")
    cells = materialize(partial.groupBy("cell").agg(F.sum("n").alias("n")), "lm-cells")
    drop_table(partial)
    observed = np.zeros(SLOTS_AT - CONTEXTS)
    got = cells.where((F.col("cell") >= CONTEXTS) & (F.col("cell") < SLOTS_AT)).toPandas()  # at most so many cells
    observed[got["cell"].to_numpy() - CONTEXTS] = got["n"]
    totals = observed[: (PREVIOUS + 1) * (CLASSES + 1)].reshape(PREVIOUS + 1, CLASSES + 1).sum(0)
    # contexts are as many as the features allow at most, so few partitions hold them
    contexts = cells.where(F.col("cell") < CONTEXTS).select(F.col("cell").alias("ctx"), "n").coalesce(8)
    inner = cells.where(F.col("cell") >= SLOTS_AT).select(((F.col("cell") - SLOTS_AT) / SLOTS).cast("int").alias("ctx"), ((F.col("cell") - SLOTS_AT) % SLOTS).alias("slot"), "n")
    in_class = np.zeros((CLASSES, SLOTS))
    for r in inner.groupBy((F.col("ctx") / (PREVIOUS + 1)).cast("int").alias("c"), "slot").agg(F.sum("n").alias("n")).collect():
        in_class[r["c"], r["slot"]] = r["n"]
    bias = np.log((in_class + 0.5) / (in_class + 0.5).sum(1, keepdims=True))
    slots = np.repeat(bias, PREVIOUS + 1, axis=0).astype("f4")
    for r in train_slots(inner, bias).collect():  # a row of fixed size for each context
        slots[r["ctx"]] = np.frombuffer(r["log_p"], "f4")
    model = train(contexts, observed, totals)
    # what the words of a shared slot have together
    own = F.broadcast(spark.createDataFrame(top.slice(0, OWN).select(["word"]).to_pandas(), "word binary"))
    h = F.crc32("word")
    cell = (h % CLASSES * SLOTS + SLOTS - SHARED_SLOTS + F.shiftright(h, 6) % SHARED_SLOTS).cast("int")
    log_cells = np.full(END_CELL + 1, np.log10(ADDED))
    log_cells[:END_CELL].reshape(CLASSES, SLOTS)[:, : SLOTS - SHARED_SLOTS] = 0.0
    for r in counts.where(F.col("word") != F.lit(END)).join(own, "word", "left_anti").groupBy(cell.alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        log_cells[r["c"]] = np.log10(r["n"] + ADDED * (r["v"] + 1))
    log_cells[END_CELL] = 0.0
    size = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"), F.sum(F.when(F.col("word") == F.lit(END), F.col("n"))).alias("e")).first()
    drop_table(cells)
    return LanguageModel(counts, size["n"] or 0, size["v"], size["e"] or 0, top, model, slots, log_cells, key)


_worker: dict[str, object] = {}


def _words_of(sent, key: str) -> Words:
    """One table of frequent words per worker, kept between tasks."""
    if _worker.get("key") != key:
        _worker.update(words=Words(sent.value), key=key)
    return _worker["words"]


def score(docs: DataFrame, lm: LanguageModel, folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score.

    Null and empty texts hold the end alone. With no training text every token
    is unknown and the scores are still defined. Repeated rows are scored each.
    """
    spark = docs.sparkSession
    slim = LanguageModel(None, 0, 0, 0, None, lm.classes, lm.slots, lm.log_cells, lm.key)
    whole = float(np.log10(lm.train_tokens + ADDED * (lm.vocabulary + 1)))
    lm_key = lm.key
    sent, sent_top = spark.sparkContext.broadcast(slim), spark.sparkContext.broadcast(lm.top)

    def work(batches):
        words, model = _words_of(sent_top, lm_key), sent.value
        for b in blocks(batches, limit=LM_BYTES):
            codes, at, found = coded_words(b.column("text"))
            rank, cell, previous, skipped = words.of(found)
            cells, prev, skip, starts = _sequence(codes, at, cell, previous, skipped)
            parts = model.log_parts(cells, prev, skip) - model.log_cells[cells]
            # counts of words in shared slots matter to both scores, of the others to the base alone
            log_word, known = words.logs[rank], rank >= 0
            shared = cell % SLOTS >= SLOTS - SHARED_SLOTS
            owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
            total = lambda x: np.bincount(owner, weights=x[codes], minlength=len(at) - 1)
            rare = ~known[codes]
            pairs, k = np.unique(owner[rare] * (len(found) + 1) + codes[rare], return_counts=True)
            offsets = np.searchsorted(pairs // (len(found) + 1), np.arange(len(at)))
            rest = pa.StructArray.from_arrays([found.cast(pa.binary()).take(pa.array(pairs % (len(found) + 1))), pa.array(k, pa.int64())], ["word", "k"])
            yield {
                "doc_id": b.column("doc_id"),
                "n_tokens": np.diff(at) + 1,
                "n_sent": np.rint(total(known.astype(float))).astype("i8"),
                "log_sent": total(np.where(known, log_word - whole, 0.0)),
                "log_shared": total(np.where(known & shared, log_word, 0.0)),
                "log_model": np.add.reduceat(parts, starts[:-1]) if len(at) > 1 else np.zeros(0),
                "rest": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), rest),
            }

    schema = "doc_id long, n_tokens long, n_sent long, log_sent double, log_shared double, log_model double, rest array<struct<word: binary, k: long>>"
    rows = materialize(arrow_map(texts(docs), work, schema).withColumn("row", F.monotonically_increasing_id()), "lm-rows")
    log_n = F.log10(F.coalesce("n", F.lit(0)) + F.lit(ADDED))
    rest = (
        rows.select("row", F.explode("rest").alias("r")).select("row", "r.word", "r.k")
        .join(lm.counts, "word", "left").groupBy("row")
        .agg(F.sum(F.col("k") * (log_n - F.lit(whole))).alias("base_rest"), F.sum(F.col("k") * log_n).alias("log_rest"), F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("n_rest"))
    )
    log_end = float(np.log10(lm.end_count + ADDED))
    return (
        rows.drop("rest").join(rest, "row", "left")
        .select(
            "doc_id",
            (~F.coalesce(is_training(F.col("doc_id"), folds), F.lit(True))).alias("held_out"),
            "n_tokens",
            (F.col("n_sent") + F.coalesce("n_rest", F.lit(0)) + F.lit(int(lm.end_count > 0))).cast("long").alias("n_known"),
            F.lit(lm.train_tokens).cast("long").alias("train_tokens"),
            (F.col("log_sent") + F.coalesce("base_rest", F.lit(0.0)) + (log_end - whole)).alias("base_score"),
            (F.col("log_shared") + F.coalesce("log_rest", F.lit(0.0)) + F.col("log_model")).alias("score"),
        )
    )
