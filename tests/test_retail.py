"""Hand-worked cases of promotions, pooling, names, files, history, graph and search."""

import datetime as dt

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tallymart.functions import text
from tallymart.operators import catalogue, graph, history, pricing, quality, retrieval
from tallymart.plans import baskets
from tallymart.sources import files

RULE = dict.fromkeys(("min_qty", "total_c", "unit_c", "percent", "amount_c", "free_qty", "max_qty"))


def rule(kind, club=False, **more):
    return (kind, *[(RULE | more)[k] for k in RULE], club)


def totals(spark, lines):
    schema = f"line long, qty long, price_c long, weighed boolean, rules array<{pricing.RULE}>"
    return {r.line: r for r in pricing.line_prices(spark.createDataFrame(lines, schema)).collect()}


def test_best_promotion(spark):
    got = totals(
        spark,
        [
            (1, 5, 1000, False, [rule("multi", min_qty=2, total_c=1500)]),
            (2, 5, 1000, True, [rule("multi", min_qty=2, total_c=1500)]),
            (3, 3, 1000, False, [rule("unit", unit_c=700, max_qty=2)]),
            (4, 4, 1000, False, [rule("second", percent=50)]),
            (5, 3, 1000, False, [rule("bundleFree", min_qty=2, free_qty=1)]),
            (6, 2, 1000, False, [rule("multi", min_qty=3, total_c=1000)]),
            (7, 2, 1000, False, [rule("unit", unit_c=1200)]),
            (8, 2, 1000, False, [rule("percent", percent=10), rule("unit", club=True, unit_c=500)]),
            (9, 2, 1000, False, None),
            (10, 2, 999, False, [rule("percent", percent=10), rule("unit", unit_c=899), rule("discount", min_qty=1, amount_c=100)]),
        ],
    )
    assert {k: r.total_c for k, r in got.items()} == {1: 4000, 2: 5000, 3: 2400, 4: 3000, 5: 2000, 6: 2000, 7: 2000, 8: 1800, 9: 2000, 10: 1798}
    assert got[8].club_c == 1000 and got[9].club_c is None and got[10].rule_no in (0, 1, 2)
    assert all(r.total_c <= r.base_c for r in got.values())


def test_take_more(spark):
    schema = f"cart long, line long, chain int, qty long, price_c long, weighed boolean, rules array<{pricing.RULE}>"
    lines = pricing.line_prices(spark.createDataFrame([(1, 1, 0, 2, 1000, False, [rule("bundleFree", min_qty=2, free_qty=1)]), (1, 2, 0, 1, 1000, False, [])], schema))
    assert [(r.line, r.add) for r in pricing.take_more_hint(lines).collect()] == [(1, 1)]


def test_pooling(spark):
    """Four units, three for two thirds: the dearest stays outside, the shares add up."""
    rows = [(1, 0, 0, 1, 2, 500, 1000, 30), (1, 0, 0, 2, 2, 900, 1800, 30), (2, 0, 0, 1, 1, 500, 500, 30)]
    got = {(r.cart, r.line): r for r in pricing.pooled(spark.createDataFrame(rows, "cart long, chain int, pool int, line long, qty long, price_c long, total_c long, pct int")).collect()}
    assert got[1, 1].pool_c == 2800 - (500 + 500 + 900) * 30 // 100 and got[1, 1].gains
    assert got[1, 1].pooled_c + got[1, 2].pooled_c == got[1, 1].pool_c and got[2, 1].pooled_c == 500 and not got[2, 1].gains


def test_ranking(spark):
    lines = spark.createDataFrame([(1, 0, 500, 500), (1, 1, 300, 300), (1, 2, 900, 900), (1, 0, 500, 500), (1, 2, 900, 900)], "cart long, chain int, base_c long, total_c long")
    sizes = spark.createDataFrame([(1, 2)], "cart long, n_lines long")
    fees = spark.createDataFrame([(0, 2000, 5000, 0, True), (1, None, 5000, 0, True), (2, 0, 5000, 5000, True)], "chain int, fee_c long, free_above_c long, min_order_c long, delivers boolean")
    got = {r.chain: r for r in pricing.compare_baskets(lines, sizes, fees).collect()}
    assert [got[c].place for c in (2, 0, 1)] == [1, 2, 3] and got[0].best and got[2].below_min and got[1].total_c == 300 and got[1].coverage == 5000


def test_text_key_and_similarity(spark):
    rows = [("מַיִם 1.5 ליטר", "מים 1.5 ליטר"), ('שוקולד "פרה" מתוקים', "שוקולד פרה מתוק"), ("Milk 3% fat", "milk 1% FAT"), ("", ""), ("abc", None)]
    got = spark.createDataFrame(rows, "a string, b string").select(text.text_key(F.col("a")).alias("k"), text.similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert got[0].k == "מימ 1.5 ליטר" and got[0].s == 1.0
    assert 0.5 < got[1].s < 1 and got[2].s == pytest.approx(0.6 * (0.5 * 2 / 4 + 0.25 * 2 / 3 + 0.25 * (1 - 1 / 11))) and got[3].s == 0.5 and got[4].s is None


def test_price_files(spark, tmp_path):
    (tmp_path / "PriceFull7290027600007-001-005-202410010300.xml").write_text(
        """<Root><ChainId>7290027600007</ChainId><Items>
<Item><ItemCode>7290000000015</ItemCode><ItemNm>מים</ItemNm><ItemPrice>1,234.50</ItemPrice><bIsWeighted>1</bIsWeighted><PriceUpdateDate>2024-10-01 03:00</PriceUpdateDate></Item>
<Item><ItemCode>2</ItemCode><ItemName>b</ItemName><ItemPrice>0</ItemPrice></Item>
<Item><ItemCode>3</ItemCode><ItemName> </ItemName><ItemPrice>-1</ItemPrice></Item>
<Item><ItemCode>4</ItemCode><ItemName>d</ItemName><ItemPrice>abc</ItemPrice><bIsWeighted>no</bIsWeighted></Item>
</Items></Root>""",
        encoding="utf-8",
    )
    rows = files.price_files(spark, str(tmp_path))
    assert rows.count() == 4
    (r,) = files.drop_unpriced(rows).select("*", *[c.alias(f"f_{k}") for k, c in files.file_parts(F.col("file")).items()]).collect()
    assert (r.code, r.name, float(r.price), r.weighed, r.updated) == ("7290000000015", "מים", 1234.5, True, dt.date(2024, 10, 1))
    assert (r.f_kind, r.f_chain, r.f_sub, r.f_store, r.f_stamp) == ("pricefull", "7290027600007", "001", "005", dt.datetime(2024, 10, 1, 0, 0))
    short = spark.createDataFrame([("x/Promo7290027600007-12-20241001-0300.gz",), ("junk.xml",)], "p string").select(*[c.alias(k) for k, c in files.file_parts(F.col("p")).items()]).collect()
    assert (short[0].kind, short[0].sub, short[0].store) == ("promo", None, "012") and short[1].kind is None


def test_promotion_layouts(spark, tmp_path):
    (tmp_path / "a.xml").write_text(
        """<P><Promotion><PromotionId>1</PromotionId><MinQty>2</MinQty><MAXQTY>6</MAXQTY><DiscountedPrice>15.90</DiscountedPrice><PromotionEndDate>2024-12-31</PromotionEndDate>
<PromotionItems><Item><ItemCode>11</ItemCode><IsGiftItem>0</IsGiftItem></Item><Item><ItemCode>12</ItemCode><IsGiftItem>1</IsGiftItem></Item></PromotionItems></Promotion>
<Promotion><PromotionId>2</PromotionId><ClubID>0</ClubID><AdditionalIsCoupon>1</AdditionalIsCoupon><Groups><Group><PromotionItems>
<PromotionItem><ItemCode>13</ItemCode><RewardType>1</RewardType><MinQty>3</MinQty><DiscountedPrice>10</DiscountedPrice></PromotionItem></PromotionItems></Group></Groups></Promotion>
<Promotion><PromotionId>3</PromotionId></Promotion></P>"""
    )
    got = {(r.promo_id, r.code): r for r in files.promotion_files(spark, str(tmp_path), "MAXQTY").collect()}
    assert float(got["1", "11"].max_qty) == 6
    assert set(got) == {("1", "11"), ("1", "12"), ("2", "13"), ("3", None)}
    assert got["1", "12"].gift and float(got["1", "11"].total) == 15.9 and got["1", "11"].ends == dt.date(2024, 12, 31)
    assert got["2", "13"].coupon and got["2", "13"].club is None and float(got["2", "13"].min_qty) == 3 and got["2", "13"].reward == 1


def test_intervals(spark):
    d = lambda n: dt.date(2024, 1, n)
    days = spark.createDataFrame([(1, 1, d(1), 5), (1, 1, d(2), 5), (1, 1, d(4), 6), (1, 1, d(5), 5), (1, 2, d(3), 7)], "chain int, gtin long, day date, price_c long")
    got = sorted((r.gtin, r.price_c, r.valid_from, r.valid_to) for r in history.intervals(days).collect() if r.valid_to) + [r.gtin for r in history.intervals(days).filter("valid_to IS NULL").orderBy("gtin").collect()]
    assert got == [(1, 5, d(1), d(4)), (1, 6, d(4), d(5)), 1, 2]


def test_resolution_tiers(spark):
    items = spark.createDataFrame([(1, "milk"), (2, "milk"), (3, "tea")], "gtin long, concept string")
    sold = spark.createDataFrame([(0, 1, "milk", 500, True), (0, 7, "milk", 300, True), (0, 8, "milk", 100, False)], "chain int, gtin long, concept string, price_c long, in_stock boolean")
    over = spark.createDataFrame([(0, 1, 7)], "chain int, gtin long, item long")
    got = {r.gtin: (r.item, r.method) for r in catalogue.resolve(items, sold, over).collect()}
    assert got == {1: (7, "manual"), 2: (7, "concept")}


def test_class_cards(spark):
    rows = [("a", f, p) for f, p in enumerate([100, 110, 120, 5000, 20])] + [("b", 1, 5), ("b", 2, 6)]
    got = catalogue.class_cards(spark.createDataFrame(rows, "concept string, family int, price_c long")).collect()
    assert got == [Row(concept="a", median_c=110, n_families=3, n_dropped=2)]


def test_one_bad_pair_queues_the_cluster(spark):
    m = spark.createDataFrame([(1, "k", "d", 100, 2), (2, "k", "d", 110, 2), (3, "k", "d", 500, 2)], "gtin long, key string, department string, price_c long, n_chains long")
    assert {(r.a, r.b): r.verdict for r in quality.pair_verdicts(m).collect()} == {(1, 2): "ok", (1, 3): "price", (2, 3): "price"}


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 40)] + [(5, 5), (3, 2)], "a long, b long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {i: 10 for i in range(11, 41)} | {3: 2}
    assert graph.components(edges.limit(0)).count() == 0


def test_basket_index_imputes(spark):
    lines = spark.createDataFrame([("a", 2), ("b", 1)], "line string, qty int")
    cells = spark.createDataFrame([(0, "a", 10), (1, "a", 21), (0, "b", 5)], "chain int, line string, price_c long")
    chains = spark.createDataFrame([(0,), (1,), (2,)], "chain int")
    got = {r.chain: r for r in baskets.basket_index(lines, cells, chains).collect()}
    assert (got[1].total_c, got[1].found_c, got[1].imputed_c, got[1].ranked) == (47, 42, 5, True) and got[2].total_c == 35 and not got[2].ranked and got[0].total_c == 25


def test_neighbours_and_votes(spark):
    v = spark.createDataFrame([(i, [float(i == j % 4) + 0.01 * i for j in range(4)], i % 2) for i in range(9)], "vec_id long, embedding array<float>, label int")
    small = retrieval.neighbours(v, v.filter("vec_id = 4"), 3, chunk=2)
    whole = retrieval.neighbours(v, v.filter("vec_id = 4"), 3)
    assert sorted(map(tuple, small.collect())) == sorted(map(tuple, whole.collect())) and small.count() == 3
    assert retrieval.label_votes(small).count() == 1


def test_chunks(spark):
    docs = spark.createDataFrame([(1, "\n".join(map(str, range(45)))), (2, ""), (3, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.chunk, r.first_line, r.n_lines) for r in retrieval.chunks(docs).collect()) == [(1, 0, 1, 20), (1, 1, 21, 20), (1, 2, 41, 5), (2, 0, 1, 1)]


def test_resolution_keeps_a_product_in_one_row(spark):
    """A concept's answers meet a product as one array: nothing is grouped by chain and product after that. Repeated products, two
    concepts of one, products without a concept and codes that aren't in the catalogue."""
    items = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "a"), (3, None), (4, "b"), (None, "a")], "gtin long, concept string")
    sold = spark.createDataFrame(
        [(0, 1, "a", 9, True), (0, 8, "a", 7, True), (0, 6, "b", 5, True), (1, 4, "b", 8, False), (1, 3, "c", 4, True), (1, 2, "a", 6, True), (1, 2, "a", 5, True)],
        "chain int, gtin long, concept string, price_c long, in_stock boolean",
    )
    over = spark.createDataFrame([(1, 4, 3), (0, 2, 99), (0, 77, 8)], "chain int, gtin long, item long")
    out = catalogue.resolve(items, sold, over)
    assert "Aggregate [chain" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.chain, -1 if r.gtin is None else r.gtin, r["item"], r.method, r.price_c) for r in out.collect())
    assert got == [
        (0, -1, 8, "concept", 7), (0, 1, 1, "code", 9), (0, 2, 8, "concept", 7), (0, 4, 6, "concept", 5), (0, 77, 8, "manual", 7),
        (1, -1, 2, "concept", 5), (1, 1, 2, "concept", 5), (1, 2, 2, "code", 5), (1, 3, 3, "code", 4), (1, 4, 3, "manual", 4),
    ]
