import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from papyra.llm import suffix_dedup as sd

from .docs import AWKWARD, documents


def brute(texts, length=sd.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone, end = bytearray(len(d)), 0
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                for j in range(max(i, end), i + length):
                    gone[j] = 1
                end = i + length
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest()))
    return out


def corpus():
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(n) for n in (70, 80, 90, 120, 300)]
    out = [t for t in AWKWARD if t is None or len(t) < 3000] + ["ab" * 500, "abc " * 400, "abc " * 300 + "x"]
    for _ in range(40):
        parts = [text(rng.randrange(120))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(len(s) // 3)
            parts += [s[a : len(s) - rng.randrange(len(s) // 3)], text(rng.randrange(60))]
        out.append(" ".join(parts))
    return out + [out[-1], out[-1], text(600)]


@pytest.mark.parametrize("limit", [sd.SHARED_LIMIT, 3])
def test_removal_matches_brute_force(spark, limit):
    texts = corpus()
    got = {r.doc_id: r for r in sd.removal(documents(spark, texts).repartition(7), limit).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute(texts)):
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want, (i, texts[i])


def test_merge_gives_sorted_suffixes_with_their_common_prefixes():
    rng = random.Random(4)
    runs = []
    for n in (0, 1, 5, 40, 40):
        runs.append(sorted((bytes(rng.choice(b"ab") for _ in range(rng.randrange(12))), b"l", 0, i, 0) for i in range(n)))
    merged = list(sd.merge_runs([sd.decode_run(sd.encode_run(r)) for r in runs if r]))
    assert [m[0] for m in merged] == sorted(s[0] for r in runs for s in r)
    for a, b in zip(merged, merged[1:]):
        assert b[1] == sd.common_prefix(a[0], b[0], 0)
    assert list(sd.merge_runs([])) == []


def test_common_prefix():
    for a, b in ((b"", b"x"), (b"abc", b"abc"), (b"abcd", b"abxd"), (b"x" * 300 + b"a", b"x" * 300 + b"b"), (b"q" * 65, b"q" * 64)):
        n = 0
        while n < min(len(a), len(b)) and a[n] == b[n]:
            n += 1
        assert sd.common_prefix(a, b, 0) == n


def test_anchors_do_not_depend_on_what_surrounds_them(monkeypatch):
    rng = np.random.default_rng(7)
    inner = rng.integers(97, 110, 2000).astype(np.uint8).tobytes()
    a = sd.anchors(b"x" * 777 + inner)
    b = sd.anchors(inner + b"y" * 500)
    places = lambda f, off: {int(p) - off for p, s, e in zip(f[1], f[2], f[3]) if s >= off and e <= off + 2000 - sd.LENGTH}
    assert places(a, 777) and places(a, 777) <= {int(p) for p in b[1]}
    whole = sd.anchors(inner * 3)
    monkeypatch.setattr(sd, "PIECE", 1500)
    pieces = sd.anchors(inner * 3)
    assert {(int(p), s) for p, f, e in zip(*pieces[1:]) for s in range(f, e + 1)} == {(int(p), s) for p, f, e in zip(*whole[1:]) for s in range(f, e + 1)}


def test_without_repeats_keeps_columns_and_texts(spark):
    texts = corpus()
    docs = documents(spark, texts)
    out = sd.without_repeats(docs, digests=True)
    assert out.columns[: len(docs.columns)] == docs.columns
    want = brute(texts)
    for r in out.collect():
        assert (r.text is None) == (texts[r.doc_id] is None)
        if want[r.doc_id][1] == 0:
            assert r.text == texts[r.doc_id]
        assert r["kept_sha256"] == want[r.doc_id][3] and r["n_removed"] == want[r.doc_id][1]


def test_empty_table(spark):
    assert sd.removal(documents(spark, [])).count() == 0


def brute_words(texts, n=sd.WORDS):
    """What is left of each text without strings of 400 bytes or 50 words that start twice."""
    data = [(t or "").encode() for t in texts]
    places = [[m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", d)] for d in data]
    bytes_seen = Counter(d[i : i + sd.LENGTH] for d in data for i in range(len(d) - sd.LENGTH + 1))
    windows = [[tuple(d[a:b] for a, b in at[i : i + n]) for i in range(len(at) - n + 1)] for d, at in zip(data, places)]
    seen = Counter(w for ws in windows for w in ws)
    out = []
    for d, at, ws in zip(data, places, windows):
        gone = set()
        for i in range(len(d) - sd.LENGTH + 1):
            if bytes_seen[d[i : i + sd.LENGTH]] > 1:
                gone.update(range(i, i + sd.LENGTH))
        for i, w in enumerate(ws):
            if seen[w] > 1:
                gone.update(range(at[i][0], at[i + n - 1][1]))
        out.append(bytes(x for i, x in enumerate(d) if i not in gone).decode("utf-8", "ignore"))
    return out


@pytest.mark.parametrize("limit", [sd.SHARED_LIMIT, 3])
def test_passages_of_fifty_words_go_also_below_400_bytes(spark, limit):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, short, start = text(55), text(49), text(30)
    assert len(passage.encode()) < sd.LENGTH
    texts = [text(40) + " " + passage + " " + text(40), text(20) + "\n" + passage.replace(" ", "\n ") + "\n" + text(9), text(30) + " " + short + " " + text(30), text(10) + " " + short, "abc " * 60, passage, start + " " + text(80) + " " + short, start + " " + short]
    texts += corpus()
    got = {r.doc_id: r.text for r in sd.without_repeats(documents(spark, texts).repartition(7), limit, words=True).collect()}
    for i, want in enumerate(brute_words(texts)):
        assert (got[i] or "") == want, (i, texts[i])
    assert got[5] == "" and short in got[2] and short in got[3]
    assert not any(passage[20:-20] in (t or "") for t in got.values())
