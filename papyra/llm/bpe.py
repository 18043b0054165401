"""BPE encoding and decoding with a pair occurrence index.

The distinct words of a partition (of a block of it, where it is large) are laid
out as one symbol sequence. An index maps each pair that has a rank to all its
positions; active ranks are taken in ascending order, every listed position
that still holds the pair is merged, and only the lists of the pairs that a
merge creates are updated. A merge product occurs only in pairs of later rank,
so taking each rank once gives the same result as merging word by word.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import arrow_map, blocks, coded, laid_out, public_tokenizer, texts, tokenizer_text

#: Chunks of letters that need no normalization but lower-casing.
SIMPLE = "^[A-Za-zÀ-ÖØ-öø-ÿ]+[.,]?$"
#: Distinct words that one pair index holds (a bound on a task's memory).
INDEX_WORDS = 50_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    letters = {b: chr(b) for b in plain}
    spare = 256
    for b in range(256):
        if b not in letters:
            letters[b] = chr(spare)
            spare += 1
    return [letters[b] for b in range(256)]


class PairIndexBpe:
    """Encoder and decoder for a word-level BPE file of the tokenizers library
    (lower-casing normalizer, isolating split, byte letters, word-end suffix)."""

    def __init__(self, spec: str):
        import regex

        d = json.loads(spec)
        model = d["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        split = next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.names = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        letters = byte_letters()
        self.inner = [self.vocab[c] for c in letters]
        self.final = [self.vocab[c + self.suffix] for c in letters]
        self.rank: dict[int, int] = {}
        self.merge: list[tuple[int, int, int]] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            ia, ib = self.vocab[a], self.vocab[b]
            self.rank.setdefault(ia << 20 | ib, r)
            self.merge.append((ia, ib, self.vocab[a + b]))
        # ranks of the pairs of two bytes' symbols, the second one inside or at the end of a word
        ranked = lambda right: np.array([[self.rank.get(x << 20 | y, -1) for y in right] for x in self.inner], "i4")
        self.first_ranks = np.stack([ranked(self.inner), ranked(self.final)])
        self.inner_of, self.final_of = np.array(self.inner, "i4"), np.array(self.final, "i4")
        self.shown = pa.array([" " + self.names.get(i, "") for i in range(max(self.names) + 1)], pa.string())

    def _merged(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and each word's number of ids, through one
        pair occurrence index over all of them."""
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        sizes = np.fromiter(map(len, coded), "i8", len(coded))
        data = np.frombuffer(b"".join(coded), "u1")
        ends = np.cumsum(sizes)
        final = np.zeros(len(data) + 1, "i1")
        final[ends[sizes > 0] - 1] = 1
        final = final[:-1]
        symbols = np.where(final == 1, self.final_of[data], self.inner_of[data])
        ranks = np.full(len(data), -1, "i4")
        ranks[:-1] = np.where(final[:-1] == 1, -1, self.first_ranks[final[1:], data[:-1], data[1:]])
        place = np.arange(len(data), dtype="i4")
        sym, nxt, prv = symbols.tolist(), np.where(final == 1, -1, place + 1).tolist(), (place - 1).tolist()
        for start in (ends - sizes)[sizes > 0].tolist():
            prv[start] = -1
        # rank of a pair -> all its positions
        at = np.flatnonzero(ranks >= 0)
        at = at[np.argsort(ranks[at], kind="stable")]
        active, cuts = np.unique(ranks[at], return_index=True)
        where = {r: places.tolist() for r, places in zip(active.tolist(), np.split(at, cuts[1:]))} if len(at) else {}
        active = active.tolist()  # ascending, which is a heap
        rank, merge = self.rank.get, self.merge
        while active:
            r = heapq.heappop(active)
            a, b, new = merge[r]
            places = where.pop(r)
            if a == b:
                places.sort()  # overlapping occurrences merge from the left
            key = new << 20
            for i in places:
                if sym[i] != a:
                    continue
                j = nxt[i]
                if j < 0 or sym[j] != b:
                    continue
                sym[i], sym[j] = new, -1
                nxt[i] = k = nxt[j]
                if k >= 0:
                    prv[k] = i
                    if (q := rank(key | sym[k])) is not None:
                        if q in where:
                            where[q].append(i)
                        else:
                            where[q] = [i]
                            heapq.heappush(active, q)
                if (p := prv[i]) >= 0 and (q := rank(sym[p] << 20 | new)) is not None:
                    if q in where:
                        where[q].append(p)
                    else:
                        where[q] = [p]
                        heapq.heappush(active, q)
        left = np.array(sym, "i4")
        real = left >= 0
        before = np.concatenate([[0], np.cumsum(real)])
        return left[real].astype("<u4"), before[ends] - before[ends - sizes]

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Ids of each word."""
        ids, n = self._merged(words)
        return [p.tolist() for p in np.split(ids, np.cumsum(n)[:-1])] if words else []

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and their numbers, an index for each
        ``INDEX_WORDS`` distinct words of the block."""
        parts = [self._merged(words[at : at + INDEX_WORDS]) for at in range(0, len(words), INDEX_WORDS)]
        if not parts:
            return np.zeros(0, "<u4"), np.zeros(0, "i8")
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        return encoded_block(texts, self.special, self.cut, self.words, self.word_ids)

    def decode_block(self, ids: np.ndarray, at: np.ndarray) -> pa.Array:
        """The decoded texts, each with a blank before it if it has an id."""
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(at, pa.int32()), self.shown.take(pa.array(ids))), "")

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.names[i] for i in ids if i in self.names])


def encoded_block(texts: pa.Array, special: dict[str, int], cut, words_of: Callable, ids_of: Callable) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in a row, and where each text's begin.

    White space is dropped, so a text's ids are those of its blank-separated
    chunks; each distinct chunk of the block is normalized and split into words
    once (``words_of``), each distinct word encoded once (``ids_of``: ids of
    all words in a row, number of each). A special token's string is made a
    chunk of its own.
    """
    if special:
        marked = reduce(pc.or_, [pc.match_substring(texts, s) for s in special])
        if pc.any(marked).as_py():
            texts = pc.replace_with_mask(texts, marked, pa.array([cut.sub(r" \1 ", t) for t in texts.filter(marked).to_pylist()], texts.type))
    codes, at, chunks = coded(pc.split_pattern(pc.replace_substring(texts, "\n", " "), " "))
    # letters that lower-case one by one, and a comma or stop after them: split in place
    simple = pc.match_substring_regex(chunks, SIMPLE)
    bodies = pc.utf8_lower(pc.ascii_rtrim(chunks.filter(simple), ".,")).dictionary_encode()
    simple, words = simple.to_numpy(zero_copy_only=False), bodies.dictionary.to_pylist()
    number = dict(zip([*words, ".", ","], range(len(words) + 2)))
    seen = number.setdefault
    n_parts = np.zeros(len(chunks), "i8")
    n_parts[simple] = 1
    marks = {c: simple & pc.ends_with(chunks, c).to_numpy(zero_copy_only=False) for c in ".,"}
    for mark in marks.values():
        n_parts[mark] = 2
    others: list[int] = []  # word numbers of all other chunks, those of special tokens negative
    odd = np.flatnonzero(~simple)
    for i, c in zip(odd.tolist(), chunks.take(pa.array(odd)).to_pylist()):
        if c in special:
            found = [-1 - special[c]]
        else:  # one chunk holds no blank, so it normalizes on its own
            low = c.lower() if c.isascii() else unicodedata.normalize("NFC", c).replace("Σ", "σ").lower()
            found = [seen(w, len(number)) for w in words_of(low)]
        n_parts[i] = len(found)
        others += found
    ends = np.cumsum(n_parts)
    part = np.zeros(ends[-1] if len(ends) else 0, "i8")
    part[(ends - n_parts)[simple]] = bodies.indices.to_numpy()
    for c, mark in marks.items():
        part[ends[mark] - 1] = number[c]
    owner = np.repeat(~simple, n_parts)
    part[owner] = others
    ids, n = ids_of(list(number))
    names = np.unique(-1 - part[part < 0])  # special tokens follow the words
    part[part < 0] = len(number) + np.searchsorted(names, -1 - part[part < 0])
    ids, n = np.concatenate([ids, names.astype("<u4")]), np.concatenate([n, np.ones(len(names), "i8")])
    ids, starts = laid_out(ids, np.concatenate([[0], np.cumsum(n)[:-1]]) if len(n) else n, n, part)
    starts = starts[np.concatenate([[0], ends])]
    ids, starts = laid_out(ids, starts[:-1], np.diff(starts), codes)
    return ids, starts[at]


_loaded: dict[str, PairIndexBpe] = {}


def bpe_of(spec: str) -> PairIndexBpe:
    """One encoder per worker and vocabulary, kept between tasks."""
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = PairIndexBpe(spec)
    return _loaded[key]


def encode_documents(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = True) -> DataFrame:
    """Encode and decode every whole text.

    Returns doc_id, n_tokens and the two digests; ``with_ids`` adds ``ids``
    (array<int>) and ``decoded``. Null and empty texts have no tokens and
    decode to ''. Repeated rows are encoded each. Other columns are ignored.
    The vocabulary file is read on the driver and sent to the executors once.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(tokenizer_text(vocabulary or public_tokenizer("word_bpe_49k.json")))

    def work(batches):
        bpe, sha = bpe_of(sent.value), hashlib.sha256
        for b in blocks(batches):
            ids, at = bpe.encode_block(b.column("text"))
            shown = bpe.decode_block(ids, at)
            data, places = memoryview(ids.tobytes()), (4 * at).tolist()
            plain, offsets = memoryview(shown.buffers()[2] or b""), np.frombuffer(shown.buffers()[1], "i4", len(shown) + 1, 4 * shown.offset).tolist()
            starts = [a + (a < c) for a, c in zip(offsets, offsets[1:])]  # without the blank before the first token
            out = {
                "doc_id": b.column("doc_id"),
                "n_tokens": np.diff(at),
                "ids_sha256": [sha(data[a:c]).hexdigest() for a, c in zip(places, places[1:])],
                "decoded_sha256": [sha(plain[a:c]).hexdigest() for a, c in zip(starts, offsets[1:])],
            }
            if with_ids:
                out["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype("i4")))
                out["decoded"] = pc.utf8_slice_codeunits(shown, 1)
            yield out

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return arrow_map(texts(docs), work, schema + (", ids array<int>, decoded string" if with_ids else ""))
