import math
import zlib
from collections import Counter

import numpy as np

from tallymart.llm import maxent

SCHEMA = "doc_id long, text string"


def sample():
    texts = ["the cat sat on the mat", "The dog sat on the log", None, "", "a b a b a b a b a b", "one two\tthree\x0bfour", "Ünder ünder", "rare" * 3]
    return [(i, texts[i % len(texts)] + f" x{i % 5}" if texts[i % len(texts)] else texts[i % len(texts)]) for i in range(200)]


def test_base_scores_and_counts(spark):
    rows = sample()
    train, held = Counter(), {}
    toks = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    for i, t in rows:
        held[i] = zlib.crc32(str(i).encode()) % 7 == 2
        if not held[i]:
            train.update(toks(t))
    total, v = sum(train.values()), len(train)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for frequent in (5, 1000):
        model, counts = maxent.fit(docs, frequent=frequent, singles=4, shared=4, features=256)
        assert (model.total, model.vocabulary) == (total, v)
        got = {r.doc_id: r for r in maxent.score(docs, model, counts).collect()}
        for i, t in rows:
            r, ts = got[i], toks(t)
            assert r.n_tokens == len(ts) and r.n_known == sum(x in train for x in ts)
            assert math.isclose(r.base_score, sum(math.log10((train[x] + 1) / (total + v + 1)) for x in ts), rel_tol=1e-9)
            assert r.score < 0
        assert sum(r.score for r in got.values()) > sum(r.base_score for r in got.values())


def test_probabilities_sum_to_one(spark):
    """All known tokens and one unknown one a shared class, after the same two tokens."""
    rows = sample()
    model, _ = maxent.fit(spark.createDataFrame(rows, SCHEMA), frequent=1000, singles=4, shared=4, features=256)
    known = {w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 for w in (t or "").encode().lower().split()}
    before = np.array([maxent.digest(w) for w in (b"the", b"cat")] + [0], np.int64)
    f = maxent.features_of(maxent.feature_parts(before, model.features), np.array([1]), np.array([0]), model.features)
    z = model.class_logs(f, model.weights, np.empty((1, model.classes), np.float32))[0].astype(float)
    p = np.exp(z) / np.exp(z).sum()
    kind, often, log_count = model.look_up(np.array([maxent.digest(w) for w in [*known, b"\n"]], np.int64))
    unknown = sum(p[c] / 10 ** model.log_mass[c] for c in range(model.singles, model.classes))
    assert often.all() and math.isclose((p[kind] * 10 ** (log_count - model.log_mass[kind])).sum() + unknown, 1.0, rel_tol=1e-6)


def test_no_training_rows_and_empty(spark):
    held = [i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2][:3]
    docs = spark.createDataFrame([(i, "a b") for i in held], SCHEMA)
    model, counts = maxent.fit(docs)
    rows = maxent.score(docs, model, counts).collect()
    assert all(r.base_score == 0 and r.n_known == 0 and r.n_tokens == 3 and math.isfinite(r.score) for r in rows) and len(rows) == 3
    assert maxent.score(docs.limit(0), model, counts).count() == 0
