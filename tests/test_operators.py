"""Hand-worked cases and brute force for joins, votes, names, substitutes and feeds."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallymart.operators import audits, joins, names, search, swaps, votes
from tallymart.sources import feeds, files


def one(spark, column, **values):
    """A column over a row of literals."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def brute_vote(vs, tolerance=5, near_tie=15):
    clusters = []
    for value, weight in sorted(vs):
        if clusters and value * 100 <= clusters[-1][0] * (100 + tolerance):
            clusters[-1][1] += weight
        else:
            clusters.append([value, weight])
    ranked = sorted(clusters, key=lambda c: (-c[1], c[0]))
    if not ranked:
        return None
    second = ranked[1][1] if len(ranked) > 1 else 0
    return ranked[0][0] if (ranked[0][1] - second) * 100 > near_tie * sum(c[1] for c in clusters) else None


def test_cluster_vote_against_brute_force(spark):
    r = random.Random(5)
    cases = [(i, [(r.choice([100, 104, 106, 120, 121, 500]), r.randint(1, 9)) for _ in range(r.randint(0, 7))]) for i in range(200)]
    df = spark.createDataFrame(cases, "id int, votes array<struct<value:bigint,weight:bigint>>")
    got = {x.id: x.v for x in df.select("id", votes.cluster_vote(F.col("votes")).alias("v")).collect()}
    assert got == {i: brute_vote(vs) for i, vs in cases}


def test_weighted_vote_ties_take_the_smaller_value(spark):
    rows = spark.createDataFrame([(1, "b", 2), (1, "a", 1), (1, "a", 1), (2, "c", 4)], "k int, v string, w int")
    got = {x.k: (x.v, x.weight, x.share) for x in votes.weighted_vote(rows, "k", "v", F.col("w")).collect()}
    assert got == {1: ("a", 2, 5000), 2: ("c", 4, 10000)}


def test_overlay_takes_explicit_nulls(spark):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, brand string")
    records = spark.createDataFrame([(1, None, True), (2, "x", False)], "id int, brand string, has_brand boolean")
    assert {x.id: x.brand for x in joins.overlay(rows, records, "id", ["brand"]).collect()} == {1: None, 2: "b", 3: "c"}


def test_own_brand(spark):
    rows = spark.createDataFrame([(1, "729001", "milk"), (1, "555", "house milk"), (1, "555", "house dog milk"), (2, "729001", "milk"), (3, "1", None)], "chain int, code string, name string")
    prefixes = spark.createDataFrame([(1, "729"), (1, "72")], "chain int, prefix string")
    words = spark.createDataFrame([(1, "house", "dog")], "chain int, word string, unless string")
    got = joins.own_brand(rows, prefixes, words).groupBy("chain", "own").count().collect()
    assert {(x.chain, x.own): x["count"] for x in got} == {(1, "prefix"): 1, (1, "word"): 1, (1, "no"): 1, (2, "no"): 1, (3, "no"): 1}


def test_blocks_have_one_pair_a_row(spark):
    rows = spark.createDataFrame([(i, "k") for i in range(1, 101)] + [(200, "z")], "gtin long, key string")
    got = joins.block_pairs(rows, "key").collect()
    assert len(got) == 99 and {x.a for x in got} == {1}
    assert joins.block_pairs(rows.limit(0), "key").count() == 0


def test_verdicts_are_on_all_pairs_of_a_block(spark):
    """Codes 2 and 3 are of one brand, the block's first isn't; a pair declared different takes no other with it."""
    rows = spark.createDataFrame([(1, "k", 5, "A", "D"), (2, "k", 5, "B", "D"), (3, "k", 5, "B", "D"), (6, "k", 5, "B", "E"), (7000, "k", 5, "C", "D"), (8, "k", 6, "B", "D")], "gtin long, name string, size int, brand string, department string")
    got = {(x.a, x.b): x.tier for x in votes.alias_tiers(rows).collect()}
    assert got == {(1, 2): "variant", (1, 3): "variant", (1, 6): "variant", (2, 3): "strong", (2, 6): "variant", (3, 6): "variant", **{(i, 7000): "weak" for i in (1, 2, 3, 6)}}
    assert votes.alias_tiers(rows.limit(0)).count() == 0


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="the driver's tables aren't here")
def test_declared_pairs_take_no_others_with_them(spark):
    sf = "/root/testdata/sf0.01"
    blocks = {}
    for x in spark.read.parquet(f"{sf}/part.parquet").collect():
        blocks.setdefault((x.p_name, x.p_size), []).append(x.p_partkey)
    pairs = {(a, b) for codes in blocks.values() for a in codes for b in codes if a < b}
    assert {(x.a, x.b) for x in joins.j16_name_blocks(spark, sf).collect()} == pairs
    assert {(x.a, x.b) for x in joins.j25_blocked_pairs(spark, sf).collect()} == {(a, b) for a, b in pairs if (b - a) % 5}
    assert {(x.a, x.b) for x in votes.g13_decisions(spark, sf).collect()} == pairs


@pytest.mark.parametrize(
    "price, promo, weighed, want",
    [(1000, 1000, False, "bundle"), (1000, 2500, False, "bundle"), (1000, 900, False, "unit"), (1000, 900, True, "kilo"), (1000, 1200, True, None), (1000, 0, False, None)],
)
def test_attached_rule(spark, price, promo, weighed, want):
    assert one(spark, joins.attach_rule(F.lit(price), F.lit(promo), F.lit(weighed))) == want


def test_hebrew_names(spark):
    assert one(spark, names.skeleton(F.col("n")), n="שוקולית") == "שקלת"
    assert one(spark, names.display_name(F.col("n")), n='SALE: **  קפה   "נמס"') == 'קפה "נמס'
    assert one(spark, names.unit_key(F.col("n"), {"גר": "ג", "קג": "ק"}), n='ק"ג') == "ק"
    assert one(spark, names.unit_key(F.col("n"), {}), n=" Kg. ") == "kg"


def test_variants_are_blanked(spark):
    got = one(spark, names.take_out(F.col("n"), ["dark", "dark choco", "choco"]), n="bar dark choco choco")
    assert (got.rest, list(got.found)) == ("bar", ["choco", "dark choco"])
    assert list(one(spark, names.take_out(F.col("n"), []), n="x y").found) == []


def test_attributes_and_flavours(spark):
    words = [("diet", "sugar free", "no sugar", None), ("diet", "sugar", "sugar", "no sugar")]
    assert [(x.key, x.value) for x in one(spark, names.attributes(F.col("n"), words), n="jam no sugar")] == [("diet", "sugar free")]
    assert one(spark, names.without_flavour(F.col("n"), ["taste"]), n="yogurt taste peach 3%") == "yogurt 3%"


def test_unit_sizes(spark):
    rows = spark.createDataFrame([(1, "g", 5, False), (2, "g", 5, False), (1, "g", 5, True), (1, "n", 6, False), (1, "?", 6, False), (1, "g", 30, False)], "chain int, bucket string, quantity long, weighed boolean")
    buckets = spark.createDataFrame([(None, "g", "g", False, 1000), (2, "g", "g", False, 1), (None, "n", None, True, 1)], "chain int, bucket string, unit string, counts boolean, scale long")
    got = sorted((x.chain, x.bucket, x.quantity, x.weighed, x.size, x.pack) for x in names.unit_sizes(rows, buckets).collect())
    assert got == [(1, "?", 6, False, None, None), (1, "g", 5, False, 5000, None), (1, "g", 5, True, None, None), (1, "g", 30, False, None, None), (1, "n", 6, False, None, 6), (2, "g", 5, False, 5, None)]


def test_stems(spark):
    assert list(one(spark, names.stemmed(F.col("k"), ["the"], ["tion", "s"]), k="the nations  as station the")) == ["nation", "as", "sta"]


OFFERED = "chain int, gtin long, concept string, head string, family string, department string, brand string, size int, price_c long, pct int, in_stock boolean"


def test_substitute_reasons_and_tiers(spark):
    base = [("a x", "D", "b", 10, 100, False), ("a x", "D", "b", 30, 100, True), ("a x", "E", "b", 10, 90, True), ("b x", "D", "b", 10, 120, True), ("c y", "D", "b", 10, 1, False)]
    rows = spark.createDataFrame([(1, i, c, c.split()[0], c.split()[1], d, b, s, p, 0, k) for i, (c, d, b, s, p, k) in enumerate(base)], OFFERED)
    reasons = {(x.gtin, x.item): x.reason for x in swaps.swap_pairs(rows, "concept").withColumn("reason", swaps.verdict()).collect()}
    assert reasons == {(0, 1): "size", (0, 2): "department"}
    assert {x.gtin: (x.tier, x.item) for x in swaps.tiered(rows).collect()} == {0: (2, 3), 4: (None, None)}
    assert swaps.tiered(rows.limit(0)).count() == 0


def test_candidates_stay_few_in_a_large_class(spark):
    rows = spark.range(2000).select(
        F.lit(1).alias("chain"), F.col("id").alias("gtin"), F.lit("a x").alias("concept"), F.lit("a").alias("head"), F.lit("x").alias("family"), F.lit("D").alias("department"), F.lit("b").alias("brand"),
        F.lit(10).alias("size"), F.lit(100).cast("long").alias("price_c"), F.lit(0).alias("pct"), (F.col("id") % 2 == 0).alias("in_stock"),
    )
    assert swaps.swap_pairs(rows, "concept").count() == 5 * 1000


def test_reach_against_all_pairs(spark):
    """Every offer of the class is judged, however many cheaper ones are refused before it."""
    r = random.Random(8)
    base = [(1 + i % 2, i, r.choice("ab") + " x", r.choice("DE"), r.choice("uv"), r.randint(1, 40), r.choice([0, 1, 2, 3, r.randint(1, 900), r.randint(50, 70), 1 << r.randint(0, 20)]), r.random() < 0.6) for i in range(500)]
    base += [(3, 1000, "a x", "D", "u", 10, 900, False), *((3, 1001 + i, "a x", "D", "u", 10, 300 - 60 * (i < 7) + i, True) for i in range(9))]
    rows = spark.createDataFrame([(c, g, n, n.split()[0], "x", d, b, s, p, 0, k) for c, g, n, d, b, s, p, k in base], OFFERED)

    def reason(w, c):
        if w[3] != c[3]:
            return "department"
        if c[5] * 4 < w[5] * 3 or c[5] * 3 > w[5] * 4:
            return "size"
        return "price" if c[6] > 3 * w[6] or c[6] * 3 < w[6] else "ok"

    for key, of in (("concept", lambda x: x[2]), ("family", lambda x: "x")):
        want, audit = {}, {}
        for w in base:
            if not w[7]:
                judged = [(reason(w, c), c[6], c[1]) for c in base if c[7] and c[0] == w[0] and of(c) == of(w)]
                ok = sorted((p, g) for k, p, g in judged if k == "ok")
                want[w[:2]] = (*(ok[0] if ok else (None, None)), len(judged), len(ok))
                for k, _, _ in judged:
                    n = audit.setdefault((w[0], k), [0, 0])
                    n[0], n[1] = n[0] + 1, n[1] + (not ok)
        x = swaps.reach(rows, key)
        assert {(y.chain, y.gtin): (y.best and y.best.price_c, y.best and y.best["item"], y.n_all, y.n_ok) for y in x.collect()} == want
        assert {(y.chain, y.reason): [y.n_pairs, y.n_unserved] for y in swaps.refusals(x).collect()} == audit
        assert swaps.swap_pairs(rows, key, None).count() == sum(n for _, _, n, _ in want.values())
    assert [(y.tier, y["item"]) for y in swaps.tiered(rows).filter("gtin = 1000").collect()] == [(1, 1008)]


def test_index_tokens(spark):
    assert list(one(spark, search.index_tokens(F.col("t")), t="See v1.2 of Up-Date, ok.")) == ["see", "v1.2", "v1", "2", "of", "up-date", "up", "date", "ok"]


def test_cosine(spark):
    assert one(spark, search.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(0.5**0.5)
    assert one(spark, search.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None


def test_file_names_of_both_kinds(spark):
    paths = ["/a/PriceFull7290027600007-001-005-202410010300.xml", "Promo7290027600007-1234-202410010300.gz", "/a/readme.txt"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = [tuple(r)[:4] for r in df.select(*[c.alias(k) for k, c in files.file_parts(F.col("p")).items()]).collect()]
    assert got[:2] == [("pricefull", "7290027600007", "001", "005"), ("promo", "7290027600007", None, "1234")] and got[2][0] is None


def test_store_files_and_keyed_config(spark, tmp_path):
    (tmp_path / "s.xml").write_text("<R><Store><StoreId>7</StoreId><City>Haifa</City></Store><Store><StoreId>000</StoreId></Store><Store><StoreId>1234</StoreId></Store><Store/></R>")
    assert sorted((x.store, x.city) for x in feeds.store_files(spark, str(tmp_path)).collect()) == [("007", "Haifa"), ("1234", None)]
    text = spark.createDataFrame([('{"1": {"b": "x"}, "": {"b": "y"}, "2": null}',)], "json string")
    assert {x.id: x.valid for x in feeds.keyed_config(text, "struct<b:string>").collect()} == {"1": True, "": False, "2": False}


def test_changed_files_come_again(spark):
    found = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "file string, digest int")
    known = spark.createDataFrame([("a", 1), ("b", 9)], "file string, digest int")
    assert sorted(x.file for x in feeds.new_files(found, known).collect()) == ["b", "c"]


def test_product_search_and_its_rescue(spark):
    items = spark.createDataFrame([(1, "Red Milk"), (2, "redder milks"), (3, "rid milk 3%"), (4, "bread"), (5, None), (6, ""), (7, "red milk")], "gtin long, name string")
    asked = spark.createDataFrame([("a", "red milk"), ("b", "il"), ("c", "rd mlk"), ("d", "red milk now"), ("e", " ?"), ("f", None), ("g", "r")], "q string, asked string")
    run = lambda **k: {(r.q, r.gtin): r.score for r in audits.search(items, asked, silent="ei", **k).collect()}
    got = run()
    assert {k[1]: v for k, v in got.items() if k[0] == "a"} == {1: 1.0, 7: 1.0, 2: 0.8, 3: 0.9}  # folded, "rid milk" holds "rd mlk" too
    assert {k[1]: v for k, v in got.items() if k[0] == "b"} == {1: 1.0, 2: 1.0, 3: 1.0, 7: 1.0}
    assert {k[1]: v for k, v in got.items() if k[0] == "c"} == {1: 0.9, 7: 0.9, 3: 0.9, 2: 0.75}
    assert got["d", 1] == pytest.approx(0.525)  # 0.7 * (1/3 + 1/4 + 1/6)
    assert {k[1] for k in got if k[0] == "g"} == {1, 2, 3, 4, 7}
    assert not {k[0] for k in got} & {"e", "f"}
    assert ("a", 3) not in run(few=3)  # three hits: nothing to rescue
    with pytest.raises(ValueError, match="in common"):
        run(floor=0.3)
    assert audits.search(items.limit(0), asked).count() == 0
