import random

import numpy as np
import pytest
import xxhash

from tallymart.llm import common, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(texts):
    """texts: (id, text) -> {id: (fingerprint, component)} with all pairs compared."""
    fps = []
    for _, text in texts:
        words = (text or "").encode().lower().split()
        grams = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
        hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
        fps.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)))
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(texts):
        least[find(i)] = min(least.get(find(i), doc), doc)
    return {doc: (fps[i], least[find(i)]) for i, (doc, _) in enumerate(texts)}


def texts():
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    out = [(0, None), (1, ""), (2, " \n\t"), (3, "Ärger ÄRGER one two"), (4, "one"), (5, "ONE"), (6, "x y z")]
    base = [rng.choice(words) for _ in range(400)]
    for i in range(10, 90):  # near copies of one text
        copy = list(base)
        for _ in range(rng.randrange(3)):
            copy[rng.randrange(400)] = rng.choice(words)
        out.append((i, " ".join(copy)))
    for i in range(100, 200):
        out.append((i, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 60)))))
    out += [(200, out[30][1]), (201, " ".join(words * 300))]
    return out


@pytest.mark.parametrize("dense", [2, 3, 24])
def test_against_all_pairs(spark, dense):
    rows = texts()
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).repartition(3)
    got = {r.doc_id: (r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs, dense=dense).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("radius", [3, 5, 6])
def test_radii_that_would_lose_pairs_are_refused(spark, radius):
    with pytest.raises(ValueError, match="multiples of four"):
        simhash.links(spark.createDataFrame([(0,), (7,)], "fp long"), radius)


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(empty).count() == 0
    twice = spark.createDataFrame([(1, "a b c d e", "x", "y", 1)] * 2 + [(None, "a b c d e", None, None, None)], SCHEMA).withColumnsRenamed({"lang": "fp", "source": "component_id"})
    assert [r.doc_id for r in simhash.keep_one(twice).collect()] == [1, 1]


def test_rows_without_an_id_are_documents_of_their_own(spark):
    """One of those with a text stays, as of any group; before, all of them did. None stays beside one with an id."""
    text, other = "a b c d e f g h", "q r s t u v w x"
    rows = [(None, text, s, 1) for s in ("y", "x", "x", None)] + [(7, other, "z", 1), (None, other, "x", 2), (None, other, "y", 2), (None, None, "n", 3), (None, None, "m", 3), (None, "", "o", 3), (None, "k l m n o p", "p", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").repartition(3)
    first, again = (sorted(map(repr, simhash.keep_one(d).collect())) for d in (docs, docs.repartition(2, "source")))
    got = simhash.keep_one(docs)
    assert first == again and got.columns == docs.columns and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, text), (0, "k l m n o p"), (7, other)]


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(1, i) for i in range(2, 50)] + [(7, 7), (60, 59)]
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(101, 161)} | {i: 1 for i in range(2, 50)} | {60: 59}
    assert got == want


def brute_similar(texts, least=(4, 5), n=5):
    """texts: (id, text) -> {id: smallest id joined by links of five-word shingle sets at the similarity}."""
    sets = []
    for _, text in texts:
        words = (text or "").encode().lower().split()
        sets.append({b" ".join(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))} if words else set())
    root = {doc: doc for doc, _ in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (a, _) in enumerate(texts):
        for j in range(i):
            b, both = texts[j][0], len(sets[i] & sets[j])
            if sets[i] == sets[j] or both * least[1] >= least[0] * (len(sets[i]) + len(sets[j]) - both) > 0:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {doc: find(doc) for doc, _ in texts}


def copies(share, count, rng, size=200):
    """count pairs of texts whose shingle sets have about the similarity."""
    out = []
    for i in range(count):
        base = [f"w{rng.randrange(10**6)}" for _ in range(size)]
        copy, lost = list(base), int((size - 4) * (1 - share) / (1 + share))
        copy[:lost] = [f"v{rng.randrange(10**6)}" for _ in range(lost)]
        out += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(copy))]
    return out


def groups(spark, rows, **k):
    got = simhash.similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), **k).collect()
    least = {}
    for r in got:
        least[r.root] = min(least.get(r.root, r.doc_id), r.doc_id)
    return {r.doc_id: least[r.root] for r in got}


def test_similar_against_all_pairs(spark):
    """Many fingerprints, so that no pair at 0.8 is missed; a group around one text, chains, short, equal and wordless texts."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "one two"), (4, "ONE  two"), (5, "one two three"), (6, "a b c d e"), (7, "a b c d e f")]
    for i in range(10, 70):
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(120)] = f"x{rng.randrange(400)}"
        rows.append((i, " ".join(copy)))
    for i in range(70, 80):  # each a little farther along
        at = 6 * (i - 70)
        rows.append((i, " ".join(f"y{j}" for j in range(at, at + 100))))
    rows += [(80 + i, " ".join(f"z{rng.randrange(50)}" for _ in range(rng.randrange(1, 40)))) for i in range(40)]
    assert groups(spark, rows, longs=40) == brute_similar(rows)


@pytest.mark.parametrize("share, least, most", [(0.8, 0.95, 1), (0.85, 0.98, 1), (0.9, 1, 1), (0.95, 1, 1), (0.77, 0, 0), (0.5, 0, 0)])
def test_recall_by_similarity(spark, share, least, most):
    rows = copies(share, 200, random.Random(9))
    found = sum(got != doc for doc, got in groups(spark, rows).items()) / 200
    assert least <= found <= most, found


def test_similar_of_nothing(spark):
    assert groups(spark, []) == {}


@pytest.mark.parametrize("size", [5, 60, 700])
def test_sketches_differ_by_similarity(size):
    rng = np.random.default_rng(size)
    for shared in (size, size * 8 // 9, size // 2):
        h = rng.integers(0, 1 << 63, 2 * size, np.uint64)
        a, b = h[:size], np.concatenate((h[:shared], h[size : 2 * size - shared]))
        alike = shared / (2 * size - shared)
        differ = int(np.bitwise_count((simhash.sketch(a) ^ simhash.sketch(b)).view(np.uint64)).sum())
        assert abs(differ / 2048 - (1 - alike) / 2) < 0.06, (shared, differ)
        if alike >= 0.8:
            assert differ <= simhash.sketch_limit((4, 5))
    assert simhash.sketch(np.zeros(0, np.uint64)).shape == (simhash.SKETCH,)


@pytest.mark.parametrize("changed, most", [(3, 10), (60, 0)])
def test_few_rows_meet_of_texts_that_are_less_alike(spark, monkeypatch, changed, most):
    """Copies of one text with words changed, at a similarity of about 0.4 to each other, and unrelated texts: each was in dozens of values before."""
    rng, met, gathered = random.Random(17), [], simhash.gathered

    def counted(rows):
        met.append(gathered(rows).count())
        return gathered(rows)

    base = [f"w{rng.randrange(10**6)}" for _ in range(60)]
    rows = []
    for i in range(2000):
        copy = list(base)
        for at in rng.sample(range(60), changed):
            copy[at] = f"v{rng.randrange(10**6)}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(simhash, "gathered", counted)
    got = groups(spark, rows)
    assert met[0] <= most * len(rows), met
    assert changed < 60 or all(got[i] == i for i in got)
