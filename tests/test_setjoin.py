"""The prefix-filtered set-similarity join against all pairs."""

import random

import pytest
from pyspark.sql import functions as F

from tallymart.functions.text import similarity, text_key
from tallymart.operators import setjoin


def names(seed: int, n: int, vocabulary: int) -> list[str]:
    """Names of one to nine words, most words rare and a few in very many names; near copies and percentages among them."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        ws = [f"w{int(vocabulary * rng.random() ** 3)}" for _ in range(rng.randint(1, 9))]
        if rng.random() < 0.3:
            ws.append(f"{rng.choice([3, 5])}%")
        out.append(" ".join(ws))
        if rng.random() < 0.4:
            near = list(ws)
            near[rng.randrange(len(near))] = f"w{rng.randrange(vocabulary)}"
            out.append(" ".join(rng.sample(near, len(near))))
    return out


@pytest.mark.parametrize("at_least", [550, 750, 900])
def test_similar_pairs_equal_all_pairs(spark, at_least):
    df = lambda xs: spark.createDataFrame([(x,) for x in xs], "key string").select(text_key(F.col("key")).alias("key")).distinct()
    left, right = df([*names(1, 90, 300), "", None, "common", "common common"]), df([*names(2, 90, 300), *names(1, 90, 300)[::3], "", None, "common"])
    got = {(r.a, r.b, r.score) for r in setjoin.similar_pairs(left, right, at_least).collect()}
    all_pairs = left.select(F.col("key").alias("a")).crossJoin(right.select(F.col("key").alias("b")))
    want = all_pairs.withColumn("score", setjoin.thousandths(similarity(F.col("a"), F.col("b")))).filter(F.col("score") >= at_least)
    assert got == {(r.a, r.b, r.score) for r in want.collect()} and len(got) > 20


def test_candidates_are_few(spark):
    """Rows that meet are under a tenth of those that share a word, where words are as unevenly frequent as in names."""
    keys = spark.createDataFrame([(x,) for x in names(3, 1200, 3000)], "key string").distinct()
    a, b = setjoin.rare_first(keys, keys)
    x, y = setjoin.prefixes(a, b, "na", "nb", 750), setjoin.prefixes(b, a, "nb", "na", 750)
    on = ["tok", "na", "nb"]
    meet = x.groupBy(on).agg(F.count("*").alias("l")).join(y.groupBy(on).agg(F.count("*").alias("r")), on).agg(F.sum(F.col("l") * F.col("r"))).first()[0]
    words = a.select(F.explode("toks").alias("tok")).groupBy("tok").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    assert meet * 10 < words


def test_best_match_skips_the_own_label(spark):
    entries = spark.createDataFrame(
        [(1, "red hot bolt", "red hot bolt"), (1, "red hot bolt", "Red  hot nut"), (2, "blue ring", "blue ring"), (3, None, None), (4, "red hot bolt", "red hot bolt")], "id long, own string, text string"
    )
    offered = spark.createDataFrame([("red hot bolt",), ("red hot bolts",), ("hot red nut",), ("blue ring",), (None,), ("red hot bolt",)], "label string")
    got = {r.id: (r.other, r.score) for r in setjoin.best_matches(entries, offered, 550).collect()}
    nut = 750 + 1000 * 5 // 11 // 4  # all three words; six of eleven letters differ
    bolts = 1000 * (1 / 4 + 1 / 6) + 250 * 12 / 13  # two words of four; one of thirteen letters
    assert got == {1: ("hot red nut", nut), 4: ("red hot bolts", int(bolts))}
    assert setjoin.best_matches(entries, offered.limit(0), 550).count() == 0 and setjoin.best_matches(entries.limit(0), offered, 550).count() == 0
    with pytest.raises(ValueError):
        setjoin.similar_pairs(offered.select(F.col("label").alias("key")), offered.select(F.col("label").alias("key")), 500)


def test_names_of_few_words_seldom_meet_in_vain(spark):
    """Names of five words out of about a hundred, as a catalogue has: rows that meet are few beside those that share one of the rarest words."""
    rng = random.Random(4)
    word = lambda kind, n: f"{kind}{rng.randrange(n)}"
    keys = {f"{word('a', 8)} {word('b', 8)} {word('c', 25)} {word('d', 6)} {word('e', 50)}" for _ in range(3000)}
    a, b = setjoin.rare_first(*[spark.createDataFrame([(x,) for x in keys], "key string")] * 2)
    x, y = setjoin.prefixes(a, b, "na", "nb", 750), setjoin.prefixes(b, a, "nb", "na", 750)
    count = lambda p, n: p.groupBy("tok", "na", "nb").agg(F.count("*").alias(n))
    meet = count(x, "l").join(count(y, "r"), ["tok", "na", "nb"]).agg(F.sum(F.col("l") * F.col("r"))).first()[0]
    assert meet * 100 < len(keys) ** 2
    assert setjoin.similar_pairs(*[a.select("key")] * 2, 750).rdd.getNumPartitions() > 1


def test_two_best_in_two_rounds_equal_one(spark, monkeypatch):
    df = lambda xs: spark.createDataFrame([(x,) for x in {*xs}], "key string")
    texts, labels = df(names(5, 120, 40)), df(names(6, 120, 40) + names(5, 120, 40)[::4])
    read = lambda: {tuple(r) for r in setjoin.two_best(texts, labels, 550).select("a", "b", "score", "place").collect()}
    two = read()
    monkeypatch.setattr(setjoin, "FIRST", 550)
    assert two == read() and len(two) > 50
