"""Class rules and imported records on hand-worked cases."""

from pyspark.sql import functions as F

from tallymart.operators import classes, records, rules

HEBREW, ATTACHED = "א-ת", "בהוכלמש"


def rows(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.collect()}


def test_word_starts(spark):
    """A stem stands at a word's start or after one attached letter; not inside a word, nor after two letters."""
    names = ["קולה", "בקולה קרה", "גוטוקולה", "ובקולה", "1.5 קולה", "קולהמון"]
    n = spark.createDataFrame([(x,) for x in names], "name string")
    stems = spark.createDataFrame([("קולה",)], "stem string")
    want = {"קולה", "בקולה קרה", "1.5 קולה", "קולהמון"}
    assert {x for x, _ in rows(classes.stems_in(n, stems, HEBREW, ATTACHED), "name", "stem")} == want
    by_pattern = n.withColumn("p", classes.word_start(F.lit("קולה"), HEBREW, ATTACHED)).filter("name rlike p")
    assert {x for (x,) in rows(by_pattern, "name")} == want
    free = n.withColumn("p", classes.word_start(F.lit("(^| )קולה|[0-9]+"), HEBREW, ATTACHED)).filter("name rlike p")
    assert {x for (x,) in rows(free, "name")} == {"קולה", "1.5 קולה", "קולהמון"}


def test_literals_inside_words(spark):
    names = spark.createDataFrame([("hamburger bun",), ("burger bun",), ("bun",), ("x",)], "name string")
    patterns = spark.createDataFrame([("buns", "all", "bun", "bun"), ("buns", "none", "burger", "[a-z]+burger"), ("short", "any", "x", "^x$")], "concept string, kind string, literal string, pattern string")
    assert rows(rules.rule_matches(names, patterns), "name", "concept") == {("burger bun", "buns"), ("bun", "buns"), ("x", "short")}


def test_guards(spark):
    words = spark.createDataFrame([("processed", "pickled"), ("processed", "frozen"), ("fresh", "raw"), ("animal", "cat"), ("vegan", "vegan")], "group string, word string")
    table = [("veg", "fresh", False, False, [], []), ("pickles", "fresh", False, False, ["pickled"], []), ("meat", "fresh", False, True, [], ["frozen"]), ("jam", "processed", False, False, [], []), ("pet", "any", True, False, [], [])]
    c = spark.createDataFrame(table, "concept string, kind string, animals boolean, vegan_scope boolean, own array<string>, exempt array<string>")
    names = ["plain", "pickled x", "frozen x", "raw x", "raw frozen x", "cat x", "vegan x"]
    every = spark.createDataFrame([(n, k[0]) for n in names for k in table], "name string, concept string")
    got = rows(classes.guarded(every, c, words), "name", "concept")
    want = {
        "plain": {"veg", "pickles", "meat", "jam", "pet"}, "pickled x": {"pickles", "jam", "pet"}, "frozen x": {"meat", "jam", "pet"}, "raw x": {"veg", "pickles", "meat", "pet"},
        "raw frozen x": {"meat", "jam", "pet"}, "cat x": {"pet"}, "vegan x": {"veg", "pickles", "jam", "pet"},
    }
    assert got == {(n, k) for n, ks in want.items() for k in ks}


def test_specific_class_wins_only_where_sure(spark):
    table = [("cheese", "all", "cheese"), ("white", "all", "cheese"), ("white", "all", "white"), ("smoked", "all", "cheese"), ("smoked", "any", "smoked"), ("both", "all", "cheese"), ("both", "all", "smoked"), ("both", "all", "white")]
    r = spark.createDataFrame(table, "concept string, kind string, pattern string")
    hits = [("a", "cheese"), ("a", "white"), ("b", "white"), ("b", "smoked"), ("b", "cheese"), ("c", "cheese"), ("d", "both"), ("d", "white"), ("d", "smoked"), ("d", "cheese")]
    got = rows(classes.specific(spark.createDataFrame(hits, "name string, concept string"), r), "name", "concept")
    assert got == {("a", "white"), ("b", "white"), ("b", "smoked"), ("b", "cheese"), ("c", "cheese"), ("d", "both")}


def test_twins(spark):
    r = spark.createDataFrame([("peas", "all", "pea"), ("peas", "none", "frozen"), ("peas", "none", "soup"), ("tea", "all", "tea")], "concept string, kind string, pattern string")
    got = rows(classes.twins(r, spark.createDataFrame([("peas",)], "concept string"), "frozen"), "concept", "kind", "pattern")
    assert got == {
        ("peas", "all", "pea"), ("peas", "none", "frozen"), ("peas", "none", "soup"), ("tea", "all", "tea"),
        ("peas-frozen", "all", "pea"), ("peas-frozen", "none", "soup"), ("peas-frozen", "all", "frozen"),
    }


def test_clubs(spark):
    promos = spark.createDataFrame([(1, "0 - all", "a"), (1, "(2=app|2=card)", "b"), (1, "3 - x", "c"), (2, "1 - staff", "d"), (1, None, "e")], "chain int, club_text string, promo string")
    profiles = spark.createDataFrame([(1, 2, "app"), (2, 1, None)], "chain int, club_id long, label string")
    labels = spark.createDataFrame([(1, "one"), (2, "two")], "chain int, label string")
    got = rows(records.with_clubs(promos, profiles, labels), "promo", "club_id", "club")
    assert got == {("a", 0, None), ("b", 2, "app"), ("c", 3, "one"), ("e", 0, None)}


def test_sizes_and_brands(spark):
    fields = "nr int, gtin string, value double, unit string, count int, note string, decided boolean, override boolean"
    items = [
        (1, "10000001", 1.5, "kg", None, None, None, None), (2, "10000001", 9.0, "g", 1, None, None, None), (1, "10000002", 5.0, "g", 2, "a CONFLICT", None, None), (1, "10000003", 5.0, "g", 2, "a CONFLICT", True, None),
        (1, "10000004", 7.0, "l", 8, None, None, None), (1, "10000005", 1.0, "unit", 6, "CONFLICT", None, True), (1, "10000006", 3.0, "ml", None, None, None, None), (1, "77", 3.0, "ml", None, None, None, None),
    ]
    size = "struct<value:double,unit:string,count:int>"
    known = spark.createDataFrame([("10000005", (2.0, "g", 1)), ("10000006", (2.0, "g", 1)), ("10000009", (4.0, "g", 1))], f"gtin string, size {size}")
    got = {r.gtin: (r.status, r["size"] and tuple(r["size"])) for r in records.import_sizes(spark.createDataFrame(items, fields), known).collect()}
    assert got == {
        "10000001": ("added", (1500.0, "g", 1)), "10000002": ("skipped", None), "10000003": ("added", (5.0, "g", 2)), "10000004": ("skipped", None),
        "10000005": ("replaced", (1.0, "unit", 6)), "10000006": ("kept", (2.0, "g", 1)), "10000009": ("kept", (4.0, "g", 1)),
    }
    new = [(1, "10000001", " Elit "), (1, "10000002", "unknown"), (1, "10000003", "b" * 31), (1, "10000004", ""), (1, "10000005", "New"), (2, "10000001", "Second"), (1, "x", "A")]
    old = spark.createDataFrame([("10000005", "Old")], "gtin string, brand string")
    merge = lambda replace: {r.gtin: (r.status, r.brand) for r in records.merge_brands(spark.createDataFrame(new, "nr int, gtin string, brand string"), old, "^unknown$", replace=replace).collect()}
    want = {"10000001": ("added", "Elit"), "10000002": ("not-a-brand", None), "10000003": ("not-a-brand", None), "10000004": ("invalid", None), "10000005": ("kept", "Old"), "x": ("invalid", None)}
    assert merge(False) == want
    assert merge(True) == want | {"10000001": ("added", "Second"), "10000005": ("replaced", "New")}


def test_basket_faults_and_provenance(spark):
    fields = "nr int, gtin string, gtins array<string>, qty int, department string, weighed boolean, unit string"
    good = (1, "12345678", None, 1, "D", True, "kg")
    lines = [good, (2, "123456789", None, 1, "D", True, "kg"), (3, "11111111", ["22222222"], 1, "D", True, "kg"), (4, "33333333", ["33333333", "12345678"], 1, "D", True, "kg"), (5, "44444444", None, 0, "D", True, "kg"), (6, "55555555", None, 1, "X", True, "kg"), (7, "66666666", None, 1, "D", False, "kg"), (8, None, None, 1, "D", False, "unit")]
    got = rows(records.basket_faults(spark.createDataFrame(lines, fields), spark.createDataFrame([("D",)], "department string"), {True: "kg", False: "unit"}), "nr", "fault")
    assert got == {(1, "ok"), (2, "code shape"), (3, "main code missing"), (4, "code twice"), (5, "quantity"), (6, "department"), (7, "unit"), (8, "no code")}
    one = spark.createDataFrame([("2", "1", 5), ("2", None, None)], "made string, source string, store int")
    meta = one.select(records.provenance(F.col("made"), F.col("source"), F.col("store"), F.lit(9), F.lit("p")).alias("x")).select("x.*")
    assert rows(meta, "as_of", "store", "portal") == {("1", 5, "p"), ("2", 9, "p")}
