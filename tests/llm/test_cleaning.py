"""Quality rules: base measures against brute force, the rules by hand."""

import random
import re
from collections import Counter

from tallymart.llm import cleaning

TEXTS = "doc_id long, text string"
PROSE = " ".join(f"Sentence {i} has words{i} of its{i} own{i} here." for i in range(20))


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    seen = Counter(windows)
    covered = {i + j for i, w in enumerate(windows) if seen[w] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_base_measures(spark):
    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "a b", "a b c", "a a a a", "x y z x y z", "ü ß 𝄞 # ## |\nü ß 𝄞", "a b c d e f\x0bg\rh\n\n \na b c"]
    texts += [" ".join(rng.choice(["a", "b", "c", "dé", "#", "\n", "e|f"]) for _ in range(rng.randrange(1, 200))) for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(400)}" for _ in range(60_000)), "x" * 300_000, "| " * 50_000, "." * 100_000]
    rows = [(i % 50 if i % 7 else None, t) for i, t in enumerate(texts)] + [(0, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], TEXTS + ", n_words int, h string").repartition(4)
    key = lambda x: (x[0] is None, x)
    got = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in cleaning.measured(df.select("doc_id", "text")).collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1:]))
    assert got == sorted(((d, *brute(t)) for d, t in rows), key=lambda x: (x[0] is None, x[0] or 0, x[1:]))
    out = cleaning.cleaned(df)
    assert out.columns == df.columns and out.count() <= df.count()


def reasons(spark, lines):
    rows = cleaning.measured(spark.createDataFrame([(1, "\n".join(lines))], TEXTS), True).collect()
    return [x.reason for x in rows[0]["_tm_lines"]]


def test_rules_by_line(spark):
    lines = [
        "A plain sentence that ends as it should.", "", "Home | Products | About", "login here", "Home is where the heart is.",
        "Copyright 2020 The Authors.", "All rights reserved.", "$$$ buy*** now### cheap", "STOP!! READING!! THIS!! NOW!! AGAIN!!",
        "THIS WHOLE LINE IS SHOUTED OUT.", "---", "no closing mark here", "Title", "Costs rose by 5% in the U.S. & Canada (source: A|B).", "Ein Satz über Ölpreise und Äpfel.",
    ]
    nav, notice, sign = "navigation", "boilerplate", "punctuation"
    assert reasons(spark, lines) == [None, None, nav, nav, None, notice, notice, sign, sign, sign, sign, sign, None, None, None]


def test_documents_that_lose_too_much_go(spark):
    menu = "\n".join("a | b | c | d | e" for _ in range(3))
    rows = [(1, PROSE), (2, f"{PROSE}\nAll rights reserved."), (3, f"{menu}\n{PROSE}"), (4, "\n".join(f"{x} | {x}a | {x}b | {x}c" for x in range(40))), (5, "too short."), (6, None), (7, "again and again " * 40), (1, PROSE)]
    df = spark.createDataFrame(rows, TEXTS)
    got = {r.doc_id: (r.base_failed, r.kept) for r in cleaning.verdicts(cleaning.measured(df)).collect()}
    assert got == {1: (False, True), 2: (False, True), 3: (False, True), 4: (False, False), 5: (True, False), 6: (True, False), 7: (True, False)}
    kept = sorted((r.doc_id, r.text) for r in cleaning.cleaned(df).collect())
    assert kept == [(1, PROSE), (1, PROSE), (2, PROSE), (3, PROSE)]
    assert cleaning.verdicts(cleaning.measured(df), max_lost=100).filter("kept").count() == 5
    assert cleaning.cleaned(spark.createDataFrame([], TEXTS)).count() == 0
