"""Lines met by their product's cells, dealt by cart once."""

import pathlib
import time

from pyspark.sql import functions as F

from tallymart.operators import pricing
from tallymart.plans import lines as plans
from tallymart.sources import scratch


def test_by_cart_is_the_join_and_groups_without_a_shuffle(spark):
    lines = spark.createDataFrame([(1, 10, 2), (1, 11, 1), (2, 10, 5), (3, 12, 1), (1, 10, 2)], "cart long, gtin long, qty long")
    cells = spark.createDataFrame([(10, 0, 7), (10, 1, None), (11, 1, 3), (13, 0, 9)], "gtin long, chain int, price_c long")
    met = pricing.by_cart(lines, cells, "chain", "price_c")
    rows = lambda df: sorted(map(repr, df.select("cart", "gtin", "qty", "chain", "price_c").collect()))
    assert rows(met) == rows(lines.join(cells, "gtin")) and met.count() == 7
    exchanges = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    assert exchanges(met.groupBy("cart", "chain").agg(F.sum("price_c"))) == exchanges(met)


def test_packed_cells_say_the_same(spark):
    """All states of a cell, prices of zero, under it, and beyond what three bytes hold."""
    prices = [None, 0, 1, -7, 4095, 4096, 524_287, 524_288, 10**12]
    rows = [(i, c, p, there, alt) for i, (p, alt) in enumerate((p, alt) for p in prices for alt in prices) for c, there in enumerate((None, False, True))]
    cells = spark.createDataFrame(rows, "gtin long, chain int, price_c long, in_stock boolean, alt_c long").repartition(3)
    lines = spark.createDataFrame([(g % 5, g, g % 4 + 1) for g in range(len(prices) ** 2 + 2)], "cart long, gtin long, qty long")
    got = plans.cart_cells(lines, cells).select("cart", "gtin", "qty", "chain", "in_stock", "priced", "pays_c").collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((g % 5, g, g % 4 + 1, c, there, p is not None, p if there else alt)) for g, c, p, there, alt in rows)


def test_written_tables_leave_no_shuffle_files(spark):
    """Before, they stayed until the driver happened to collect its garbage."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    files = lambda: {f for d in folders for f in pathlib.Path(d.getPath()).rglob("shuffle_*")}
    was, kept = files(), spark.conf.get(scratch.CLEAN, "false")
    x = scratch.written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "k"))
    assert x.agg(F.sum("count")).first()[0] == 10_000 and spark.conf.get(scratch.CLEAN, "false") == kept
    scratch.written(spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count())
    shuffles, end = lambda: {f.name.split("_")[1] for f in files() - was}, time.time() + 30
    while len(shuffles()) > 1 and time.time() < end:
        time.sleep(0.2)
    assert len(shuffles()) <= 1  # the sum's own
