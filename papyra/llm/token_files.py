"""Token-id files: independent zstandard frames with a trailing seek table.

One file holds the ids of a range of documents in ascending doc_id order:

* data frames: plain zstandard frames of little-endian unsigned 32-bit ids, cut
  every ``FRAME_BYTES`` whatever document they fall in;
* an index frame: a skippable frame with, compressed, the document ids and the
  number of ids of each document (a null document id is 0, and the highest bit
  of its number is set);
* a seek table: a skippable frame in the public seekable layout, with the
  compressed size, the plain size and a checksum (low 32 bits of xxh64 over the
  plain bytes) of each data frame, and a footer of fixed size.

A reader takes the footer, the table and the index, and then decompresses only
the frames that hold the documents it was asked for.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import encoded_block
from .common import arrow_map, blocks, new_folder, public_tokenizer, texts, tokenizer_text

#: Fixed values of the seekable zstandard layout.
SEEK_FRAME_MAGIC = 0x184D2A5E
INDEX_FRAME_MAGIC = 0x184D2A50
SEEK_FOOTER_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80

FRAME_BYTES = 1 << 18
#: Marks a null document id in the index.
NULL_ID = np.uint64(1 << 63)
END_ID = 2
#: Bytes of text that are encoded at once.
FILE_BLOCK_BYTES = 12 << 20
#: Words that go to the library as one text.
JOINED_WORDS = 500


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class TokenFileWriter:
    """Streams documents into one file; memory holds one frame and the index."""

    def __init__(self, stream, level: int = 1):
        import zstandard

        self.out, self.zip = stream, zstandard.ZstdCompressor(level=level)
        self.frames: list[tuple[int, int, int]] = []
        self.pending, self.size = [], 0
        self.ids: list[int | None] = []
        self.counts: list[int] = []

    def add(self, doc_id: int | None, data: bytes) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(data) >> 2)
        self.pending.append(data)
        self.size += len(data)
        if self.size >= FRAME_BYTES:
            whole = b"".join(self.pending)
            full = len(whole) - len(whole) % FRAME_BYTES
            for at in range(0, full, FRAME_BYTES):
                self._frame(whole[at : at + FRAME_BYTES])
            self.pending, self.size = [whole[full:]], len(whole) - full

    def _frame(self, plain: bytes) -> None:
        packed = self.zip.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain), _checksum(plain)))

    def close(self) -> None:
        if self.size:
            self._frame(b"".join(self.pending))
        none = np.array([i is None for i in self.ids], bool)
        counts = np.array(self.counts, "<u8") | np.where(none, NULL_ID, np.uint64(0))
        index = self.zip.compress(np.array([i or 0 for i in self.ids], "<i8").tobytes() + counts.astype("<u8").tobytes())
        self.out.write(struct.pack("<II", INDEX_FRAME_MAGIC, len(index) + 8) + index + struct.pack("<II", len(index) + 8, len(self.ids)))
        table = b"".join(struct.pack("<III", *f) for f in self.frames) + struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEK_FOOTER_MAGIC)
        self.out.write(struct.pack("<II", SEEK_FRAME_MAGIC, len(table)) + table)


class TokenFileReader:
    """Random access by document; only the frames needed are decompressed."""

    def __init__(self, source, size: int):
        """``source``: a seekable file of ``size`` bytes."""
        import zstandard

        self.f, self.unzip, self.frames_read = source, zstandard.ZstdDecompressor(), 0
        self._at: tuple[int, bytes] = (-1, b"")
        n, flag, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEK_FOOTER_MAGIC or flag != CHECKSUM_FLAG:
            raise ValueError("not a token file")
        table_at = size - 9 - 12 * n
        rows = np.frombuffer(self._read(table_at, 12 * n), "<u4").reshape(n, 3).astype("i8")
        self.packed, self.plain, self.sums = rows[:, 0], rows[:, 1], rows[:, 2]
        self.starts = np.concatenate([[0], np.cumsum(self.packed)])
        self.plain_starts = np.concatenate([[0], np.cumsum(self.plain)])
        tail, docs = struct.unpack("<II", self._read(table_at - 16, 8))
        packed = self._read(table_at - 16 - (tail - 8), tail - 8)
        index = self.unzip.decompress(packed, max_output_size=max(1, 16 * docs)) if docs else b""
        self.doc_ids = np.frombuffer(index[: 8 * docs], "<i8")
        counts = np.frombuffer(index[8 * docs :], "<u8")
        self.none = (counts & NULL_ID) != 0
        self.counts = (counts & ~NULL_ID).astype("i8")
        self.offsets = np.concatenate([[0], np.cumsum(self.counts)])

    def _read(self, at: int, n: int) -> bytes:
        self.f.seek(at)
        return self.f.read(n)

    def _frame(self, k: int) -> bytes:
        if self._at[0] != k:
            data = self.unzip.decompress(self._read(int(self.starts[k]), int(self.packed[k])), max_output_size=int(self.plain[k]))
            if _checksum(data) != self.sums[k]:
                raise ValueError(f"frame {k}: checksum differs")
            self.frames_read += 1
            self._at = (k, data)
        return self._at[1]

    def ids_bytes(self, row: int) -> bytes:
        """Ids of the row-th document, little-endian."""
        a, b = 4 * int(self.offsets[row]), 4 * int(self.offsets[row + 1])
        out, k = [], int(np.searchsorted(self.plain_starts, a, "right")) - 1
        while a < b:
            data, base = self._frame(k), int(self.plain_starts[k])
            out.append(data[a - base : b - base])
            a, k = base + len(data), k + 1
        return b"".join(out)

    def document(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of every document with this id, which may be null."""
        found = self.none if doc_id is None else (self.doc_ids == doc_id) & ~self.none
        return [np.frombuffer(self.ids_bytes(int(r)), "<u4") for r in np.flatnonzero(found)]

    def __iter__(self) -> Iterator[tuple[int | None, bytes]]:
        for row, (doc_id, none) in enumerate(zip(self.doc_ids.tolist(), self.none.tolist())):
            yield None if none else doc_id, self.ids_bytes(row)


class LibraryEncoder:
    """Whole texts through the tokenizers library, each distinct word of a
    block once; many words go to the library as one text."""

    def __init__(self, spec: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.tok = Tokenizer.from_str(spec)
        self.tok.no_truncation()
        self.tok.no_padding()
        d = json.loads(spec)
        self.special = {t.content: i for i, t in self.tok.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.words_of = regex.compile(next(p for p in d["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]).findall
        # words reach the library normalized and split
        self.tok.normalizer = None
        self.tok.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = d["model"].get("end_of_word_suffix") or "\0"
        self.ends = np.zeros(self.tok.get_vocab_size() + 1, bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith(suffix)]] = True

    def _library(self, parts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tok.encode_batch_fast(parts, add_special_tokens=False)]

    def word_ids(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row and the number of each. A word's last
        token alone ends a word, so joined words can be told apart after."""
        out, counts = [], []
        for at in range(0, len(words), JOINED_WORDS):
            some = words[at : at + JOINED_WORDS]
            ids = self._library([" ".join(some)])[0]
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(some):
                out.append(ids)
                counts.append(np.diff(ends, prepend=0))
            else:  # one of them normalizes to several words
                each = self._library(some)
                out += each
                counts.append(np.array([len(e) for e in each], "i8"))
        return (np.concatenate(out), np.concatenate(counts)) if out else (np.zeros(0, "<u4"), np.zeros(0, "i8"))

    def encode_block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's begin."""
        return encoded_block(texts, self.special, self.cut, self.words_of, self.word_ids)


_encoders: dict[int, LibraryEncoder] = {}


def encoder_of(spec: str) -> LibraryEncoder:
    key = zlib.crc32(spec.encode())
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = LibraryEncoder(spec)
    return _encoders[key]


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, folder: str | None = None, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts, in ascending doc_id order over the files.

    Rows with one doc_id are ordered by their text; those without come first
    and stay without in the files. Null texts count as empty
    and hold the end id alone. Returns one row per file: part, path, n_docs,
    n_ids and start (ids in all files before it); the files stay in ``folder``
    (the session's shared folder by default). A task writes under a name of its
    own and renames, so a repeated task replaces the same file. An empty table
    gives no files.
    """
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "tokens")
    sent = spark.sparkContext.broadcast(tokenizer_text(vocabulary or public_tokenizer("word_bpe_49k.json")))
    ending = np.array([end_id], "<u4").tobytes()

    def work(batches):
        from pyspark import TaskContext

        encoder, writer, part = encoder_of(sent.value), None, TaskContext.get().partitionId()
        for b in blocks(batches, limit=FILE_BLOCK_BYTES):
            if writer is None and b.num_rows:
                store, base = _open(folder)
                store.create_dir(base, recursive=True)
                name = f"{base}/part-{part:06d}.tok"
                temporary = f"{base}/.part-{part:06d}-{uuid.uuid4().hex}"
                stream = store.open_output_stream(temporary)
                writer = TokenFileWriter(stream)
            ids, at = encoder.encode_block(b.column("text"))
            data, places = ids.tobytes(), (4 * at).tolist()
            for doc_id, a, c in zip(b.column("doc_id").to_pylist(), places, places[1:]):
                writer.add(doc_id, data[a:c] + ending)
        if writer is not None:
            writer.close()
            stream.close()
            store.move(temporary, name)
            yield {"part": [part], "path": [f"{folder}/part-{part:06d}.tok"], "n_docs": [len(writer.ids)], "n_ids": [sum(writer.counts)]}

    ordered = texts(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    # one row per file: the number of files, not of documents, comes to the driver
    done = sorted(map(tuple, arrow_map(ordered, work, "part int, path string, n_docs long, n_ids long").collect()))
    starts, total = [], 0
    for row in done:
        starts.append((*row, total))
        total += row[3]
    return spark.createDataFrame(starts, "part int, path string, n_docs long, n_ids long, start long")


def read_token_files(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (and ids) from the files."""

    def work(batches):
        for b in batches:
            for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
                store, name = _open(path)
                size = store.get_file_info(name).size
                with store.open_input_file(name) as f:
                    reader, at = TokenFileReader(f, size), start
                    rows: dict[str, list] = {"doc_id": [], "start": [], "n_tokens": [], "ids_crc32": [], "ids": []}
                    for doc_id, data in reader:
                        rows["doc_id"].append(doc_id)
                        rows["start"].append(at)
                        rows["n_tokens"].append(len(data) >> 2)
                        rows["ids_crc32"].append(zlib.crc32(data))
                        if with_ids:
                            rows["ids"].append(np.frombuffer(data, "<u4").astype("int64"))
                        at += len(data) >> 2
                        if len(rows["doc_id"]) >= 4096 or (with_ids and at - start > 1 << 20 and len(rows["doc_id"]) >= 64):
                            yield rows
                            rows = {k: [] for k in rows}
                    if rows["doc_id"]:
                        yield rows

    n = max(1, files.count())
    spread = files.repartitionByRange(n, "part")
    return arrow_map(spread, work, "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def read_documents(files: DataFrame, wanted: Iterable[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Ids of a few documents, on the caller, without touching other frames."""
    out: dict[int | None, list[np.ndarray]] = {d: [] for d in wanted}
    for row in files.orderBy("part").collect():
        store, name = _open(row["path"])
        with store.open_input_file(name) as f:
            reader = TokenFileReader(f, store.get_file_info(name).size)
            for d in out:
                out[d] += reader.document(d)
    return out

