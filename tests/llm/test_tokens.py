import hashlib
import random
import struct
import zlib

import pytest

from papyra.llm import bpe, token_files
from papyra.llm.common import public_tokenizer, tokenizer_text

from .docs import AWKWARD, documents


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizer("word_bpe_49k.json"))
    tok.no_padding()
    tok.no_truncation()
    return tok


def corpus():
    rng = random.Random(3)
    ranges = [(32, 127), (160, 592), (880, 1280), (1424, 1530), (0x900, 0x980), (0x4E00, 0x4E40), (0x1F600, 0x1F640), (9, 14), (0x300, 0x330)]
    out = list(AWKWARD)
    for _ in range(300):
        out.append("".join(chr(rng.randrange(*rng.choice(ranges))) if rng.random() < 0.8 else " " for _ in range(rng.randrange(60))))
    return out


def test_encoding_matches_the_library(spark, library):
    texts = corpus()
    got = {r.doc_id: r for r in bpe.encode_documents(documents(spark, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode(t or "", add_special_tokens=False).ids
        decoded = library.decode(ids, skip_special_tokens=False)
        assert got[i].ids == ids, repr(t)
        assert got[i].decoded == decoded
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()


def test_pair_index_equals_word_by_word_merging():
    coder = bpe.PairIndexBpe(tokenizer_text(public_tokenizer("word_bpe_49k.json")))
    words = ["aaaaaaa", "banana", "nationalization", "th", "x", "ththththth", "banana"]

    def plain(w):
        data = w.encode()
        ids = [coder.inner[b] for b in data]
        ids[-1] = coder.final[data[-1]]
        while True:
            ranked = [(coder.rank[a << 20 | b], i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if a << 20 | b in coder.rank]
            if not ranked:
                return ids
            r, i = min(ranked)
            ids[i : i + 2] = [coder.merge[r][2]]

    assert coder.merge_words(words) == [plain(w) for w in words]
    assert coder.merge_words([]) == []


def test_token_files_round_trip(spark, library, tmp_path):
    texts = corpus()
    docs = documents(spark, texts).repartition(5)
    files = token_files.write_token_files(docs, folder=f"file://{tmp_path}")
    got = sorted(token_files.read_token_files(files, with_ids=True).collect())
    start = 0
    for row, (i, t) in zip(got, enumerate(texts), strict=True):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens) == (i, start, len(ids))
        assert row.ids == ids
        assert row.ids_crc32 == zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))
        start += len(ids)
    some = token_files.read_documents(files, [3, 9, 999])
    assert some[3][0].tolist() == got[3].ids and some[9][0].tolist() == got[9].ids and some[999] == []


def test_reader_touches_only_needed_frames(tmp_path):
    path = tmp_path / "x.tok"
    with open(path, "wb") as f:
        w = token_files.TokenFileWriter(f)
        for i in range(200):
            w.add(i, struct.pack("<I", i) * 5000)
        w.close()
    with open(path, "rb") as f:
        r = token_files.TokenFileReader(f, path.stat().st_size)
        assert r.document(150)[0].tolist() == [150] * 5000
        assert r.frames_read <= 2 < len(r.packed)
    data = bytearray(path.read_bytes())
    data[20] ^= 255
    path.write_bytes(data)
    with open(path, "rb") as f, pytest.raises(Exception):
        token_files.TokenFileReader(f, len(data)).document(0)


def test_frames_are_plain_zstandard(tmp_path):
    import zstandard

    path = tmp_path / "x.tok"
    with open(path, "wb") as f:
        w = token_files.TokenFileWriter(f)
        w.add(1, b"\x01\0\0\0" * 10)
        w.close()
    assert zstandard.ZstdDecompressor().decompress(path.read_bytes(), max_output_size=40) == b"\x01\0\0\0" * 10


def test_empty_table(spark):
    empty = documents(spark, [])
    assert bpe.encode_documents(empty).count() == 0
    assert token_files.read_token_files(token_files.write_token_files(empty)).count() == 0


def test_repeated_ids_are_all_written(spark):
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (0, None)], "doc_id long, text string")
    rows = sorted(token_files.read_token_files(token_files.write_token_files(docs)).collect())
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(0, 0, 1), (1, 1, 2), (1, 3, 2), (1, 5, 2)]


def test_null_ids_come_back_null(spark):
    docs = spark.createDataFrame([(0, "b"), (None, "a"), (None, None), (-1, "c")], "doc_id long, text string")
    files = token_files.write_token_files(docs)
    rows = sorted(token_files.read_token_files(files).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.start, r.n_tokens) for r in rows] == [(None, 0, 1), (None, 1, 2), (-1, 3, 2), (0, 5, 2)]
    found = token_files.read_documents(files, [None, 0])
    assert [len(x) for x in found[None]] == [1, 2] and [len(x) for x in found[0]] == [2]
