"""The class matcher on hand-worked cases, and literal places by brute force."""

import random

from pyspark.sql import functions as F

from tallymart.operators import matcher
from tallymart.operators.names import without_flavour

HEBREW, ATTACHED = "א-ת", "בהוכלמש"


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def frame(spark, rows_, schema):
    return spark.createDataFrame(rows_, schema)


def test_places_both_ways(spark):
    """Overlaps, literals inside literals, signs beyond the basic plane, repeats, nulls and empties; the automaton and the join agree."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abא😀 ", k=rng.randint(1, 6))) for _ in range(60)]
    texts = ["".join(rng.choices("abא😀 ", k=rng.randint(0, 40))) for _ in range(60)] + ["a" * 3000]
    t = frame(spark, [(x,) for x in [*texts, texts[0], None]], "text string")
    w = frame(spark, [(x,) for x in [*words, words[0], None, ""]], "literal string")
    want = sorted({(x, y, i + 1) for x in texts for y in words for i in range(len(x)) if x.startswith(y, i)})
    for most in (10_000, 0):
        assert rows(matcher.literal_positions(t, w, most), "text", "literal", "at") == want
    empty = frame(spark, [], "literal string")
    assert rows(matcher.literal_positions(t, empty), "text") == [] == rows(matcher.literal_positions(t.limit(0), w), "text")


def test_whole_matcher(spark):
    """Attached letters, a loanword, ``none`` inside a word, the flavour, guards, specificity."""
    rules = [
        ("cola", "all", "קולה", "קולה"), ("cola", "none", "גומי", "גומי"), ("honey", "all", "דבש", "(^| )דבש"),
        ("bun", "all", "לחמניה", "לחמניה"), ("bun", "none", "בורגר", f"[{HEBREW}]*בורגר"), ("oil", "all", "שמנ", "שמנ"), ("oil", "none", "זית", "זית"),
        ("pickle", "all", "כבוש", "כבוש"), ("pickle", "all", "מלפפונ", "מלפפונ"), ("cucumber", "all", "מלפפונ", "מלפפונ"), ("jam", "all", "תות", "תות"),
        ("berry drink", "any", "תות", "תות"), ("berry drink", "any", "100", "100"), ("cat food", "all", "חתול", "חתול"), ("only none", "none", "קולה", "קולה"),
        ("cheese", "all", "גבינה", "גבינה"), ("white cheese", "all", "גבינה", "גבינה"), ("white cheese", "all", "לבנה", "לבנה"),
    ]
    none = []
    classes = [
        ("pickle", False, "fresh", False, False, none), ("cucumber", False, "fresh", False, False, none), ("jam", False, "processed", False, False, none),
        ("berry drink", True, "any", False, False, none), ("cat food", False, "any", True, False, none), ("cheese", False, "any", False, True, none), ("white cheese", False, "any", False, True, none),
    ]
    words = [("processed", "כבוש"), ("fresh", "טרי"), ("animal", "חתול"), ("vegan", "טבעונ")]
    want = {
        "קולה": {"cola"}, "בקולה קרה": {"cola"}, "גוטוקולה": set(), "ובקולה": set(), "קולה גומי": set(), "קולה אבגומי": {"cola"},
        "ודבש טהור": set(), "דבש": {"honey"}, "לחמניה": {"bun"}, "לחמניה להמבורגר": set(), "שמנ זיתימ": set(), "שמנ קוקוס": {"oil"},
        "מלפפונ": {"cucumber"}, "מלפפונ כבוש": {"pickle"}, "תות": {"jam"}, "תות טרי": {"berry drink"}, "משקה בטעמ תות": {"berry drink"},
        "משקה 100": {"berry drink"}, "קולה לחתול": {"cat food"}, "אוכל לחתול": {"cat food"}, "גבינה לבנה": {"white cheese"}, "גבינה": {"cheese"}, "גבינה טבעונית": set(),
        "קולה טבעונית": {"cola"}, "": set(), None: set(),
    }
    # (^| )X spells out its own start of a word and so takes no attached letter.
    names = frame(spark, [(n,) for n in [*want, "קולה"]], "name string")
    r = frame(spark, [*rules, rules[0]], "concept string, kind string, literal string, pattern string")
    c = frame(spark, classes, "concept string, whole boolean, kind string, animals boolean, vegan_scope boolean, exempt array<string>")
    w = frame(spark, words, "group string, word string")
    for most in (matcher.AUTOMATON_CHARS, 0):
        got = rows(matcher.class_matches(names, r, c, w, without_flavour(F.col("name"), ["בטעמ"]), HEBREW, ATTACHED, most), "name", "concept")
        assert got == sorted((n, k) for n, ks in want.items() for k in ks)
