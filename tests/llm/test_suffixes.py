import hashlib
import random

import numpy as np
import pytest

from tallymart.llm import suffixes

SCHEMA = "doc_id long, text string"


def corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 7)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(40) for _ in range(4)]
    out = {0: None, 1: "", 2: "a" * 500, 3: "ab" * 200, 4: "x" * 99, 5: "x" * 99, 6: text(30) * 3}
    for i in range(10, 60):
        parts = [text(rng.randrange(0, 60))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            at = rng.randrange(len(s) // 2)
            parts += [s[at : at + rng.randrange(60, 200)], text(rng.randrange(0, 20))]
        out[i] = "".join(parts)
    out[70] = out[20]
    out[71] = out[20][:150] + "|" + out[20][150:]
    out[72] = "".join(shared) + text(500)
    return out


@pytest.mark.parametrize("crowd", [4096, 1])
@pytest.mark.parametrize("piece", [1 << 20, 256])
def test_against_all_windows(spark, crowd, piece, monkeypatch):
    texts = corpus()
    monkeypatch.setattr(suffixes, "PIECE", piece)
    docs = spark.createDataFrame(list(texts.items()), SCHEMA).repartition(3)
    got = {}
    for r in suffixes.without_repeats(docs, crowd=crowd).collect():
        got[r.doc_id] = r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.data).hexdigest()
    assert got == suffixes.brute_force({k: (v or "").encode() for k, v in texts.items()})


def test_empty_repeated_and_null_ids(spark):
    assert suffixes.without_repeats(spark.createDataFrame([], SCHEMA)).count() == 0
    text = "".join(chr(97 + i * i % 26) for i in range(30)) * 8
    docs = spark.createDataFrame([(1, text), (1, text), (None, text), (2, text)], SCHEMA)
    got = sorted(((r.doc_id or 9, r.n_removed) for r in suffixes.without_repeats(docs).collect()))
    assert got[0] == got[1] and got[0][1] < 240 and got[2:] == [(2, 240), (9, 240)]


def test_contexts_that_differ_in_any_byte_differ():
    """The hash takes in every byte of a context, wherever it begins."""
    rng = random.Random(9)
    data = np.array([rng.randrange(97, 123) for _ in range(3000)], np.uint8)
    base, up, down = suffixes.powers(3000)
    assert all(int(up[i]) * int(down[i]) % (1 << 64) == 1 for i in range(0, 3001, 97))
    one = suffixes.contexts(data, np.full(3000, 3000), 100, 32)
    for at in rng.sample(range(200, 2800), 40):
        changed = data.copy()
        changed[at] ^= 1
        two = suffixes.contexts(changed, np.full(3000, 3000), 100, 32)
        hashes = lambda c: {int(lo): (int(h), int(n)) for h, lo, n in zip(c[1], c[2], c[4])}
        before, after = hashes(one), hashes(two)
        for lo in before.keys() & after.keys():
            if lo <= at < lo + before[lo][1] + 99 and before[lo][1] == after[lo][1]:
                assert before[lo][0] != after[lo][0]


def test_longest_previous_factors():
    """Against all earlier positions, over all suffixes of texts with few letters."""
    rng = random.Random(3)
    for width in (3, 8):
        text = [rng.randrange(1, 4) for _ in range(300)] + [1] * 40 + [0] * width
        suffixes_ = np.array([text[i : i + width] for i in range(len(text) - width)], np.uint8)
        order = np.lexsort((np.arange(len(suffixes_)), *suffixes_.T[::-1]))
        got = np.empty(len(order), np.int64)
        got[order] = suffixes.longest_previous(suffixes_[order], order, stretch=50)
        shared = lambda a, b: next((k for k in range(width) if a[k] != b[k]), width)
        assert got.tolist() == [max((shared(suffixes_[i], suffixes_[j]) for j in range(i)), default=0) for i in range(len(suffixes_))]


def test_text_ids_and_clashing_columns(spark):
    texts = {"b": "x" * 30 + "abcdefghij" * 20, "a": "abcdefghij" * 15, "c": None}
    docs = spark.createDataFrame([(i, t, 1, 2, "q") for i, t in texts.items()], "doc_id string, text string, doc int, t int, data string")
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in suffixes.without_repeats(docs).collect()}
    want = suffixes.brute_force({k: (v or "").encode() for k, v in texts.items()})
    assert got == {k: v[:3] for k, v in want.items()}
