"""Composite plans over baskets: the reference basket index, hand-offs, saved lists, outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.pricing import COMPARED, comparison, priced_lines
from ..registry import query
from ..sources.market import CART_LINES, OFFERS, PRODUCTS, cart_lines, offers, products


def basket_index(lines: DataFrame, cells: DataFrame, chains: DataFrame, floor: int = 5000) -> DataFrame:
    """lines(line, qty), cells(chain, line, price_c), chains(chain) -> per chain: total_c, found_c, imputed_c, n_found, n_lines, ranked.

    A line that a chain lacks counts with the median (mean of the middle two, rounded down) of the other chains' prices.
    Under ``floor`` ten-thousandths of the lines found, a chain isn't ranked.
    """
    median = cells.groupBy("line").agg(F.floor(F.median("price_c")).alias("median_c"))
    grid = lines.join(median, "line").crossJoin(F.broadcast(chains))  # a basket's lines times the chains, both few
    x = grid.join(cells, ["chain", "line"], "left")
    per = x.groupBy("chain").agg(
        F.sum(F.col("qty") * F.coalesce("price_c", "median_c")).alias("total_c"), F.coalesce(F.sum(F.col("qty") * F.col("price_c")), F.lit(0)).alias("found_c"),
        F.count("price_c").alias("n_found"), F.count("*").alias("n_lines"),
    )
    return per.withColumns({"imputed_c": F.col("total_c") - F.col("found_c"), "ranked": F.col("n_found") * 10000 >= floor * F.col("n_lines")})


INDEX = f"""{OFFERS}, {PRODUCTS}, basket AS (SELECT name AS line, 1 + len(name) % 3 AS qty FROM products GROUP BY name),
cells AS (SELECT chain, name AS line, min(price_c) AS price_c FROM offers JOIN products USING (gtin) WHERE in_stock AND gtin % 3 <> chain % 3 GROUP BY ALL),
med AS (SELECT line, floor(median(price_c))::BIGINT AS median_c FROM cells GROUP BY line), ch AS (SELECT DISTINCT chain FROM offers),
idx AS (SELECT ch.chain, sum(qty * coalesce(price_c, median_c))::BIGINT AS total_c, coalesce(sum(qty * price_c), 0)::BIGINT AS found_c, count(price_c) AS n_found, count(*) AS n_lines
  FROM basket JOIN med USING (line) CROSS JOIN ch LEFT JOIN cells c ON c.chain = ch.chain AND c.line = basket.line GROUP BY ch.chain)"""


def basket_cells(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    items = products(spark, sf_dir)
    lines = items.select(F.col("name").alias("line")).distinct().withColumn("qty", 1 + F.length("line") % 3)
    sold = offers(spark, sf_dir).filter("in_stock AND gtin % 3 <> chain % 3").join(items.select("gtin", F.col("name").alias("line")), "gtin")
    return lines, sold.groupBy("chain", "line").agg(F.min("price_c").alias("price_c"))


@query("b14_reference_basket", f"WITH {INDEX} SELECT chain, total_c, found_c, total_c - found_c AS imputed_c, n_found, n_lines, n_found * 10000 >= 5000 * n_lines AS ranked FROM idx")
def b14_reference_basket(spark, sf_dir):
    """One basket of a unit or more of each concept, at the cheapest product that each chain has in stock."""
    lines, cells = basket_cells(spark, sf_dir)
    return basket_index(lines, cells, offers(spark, sf_dir).select("chain").distinct())


@query(
    "a26_line_spread",
    f"WITH {INDEX} SELECT line, min(price_c) AS min_c, max(price_c) AS max_c, count(*) AS n, CASE WHEN count(*) >= 2 THEN max(price_c) * 100 // min(price_c) END AS spread, coalesce(count(*) >= 2 AND max(price_c) > 3 * min(price_c), false) AS suspect FROM cells GROUP BY line",
)
def a26_line_spread(spark, sf_dir):
    _, cells = basket_cells(spark, sf_dir)
    out = cells.groupBy("line").agg(F.min("price_c").alias("min_c"), F.max("price_c").alias("max_c"), F.count("*").alias("n"))
    spread = F.when(F.col("n") >= 2, F.expr("max_c * 100 div min_c"))
    return out.withColumns({"spread": spread, "suspect": (F.col("n") >= 2) & (F.col("max_c") > 3 * F.col("min_c"))})


@query("w05_cheapest_chain_per_line", f"WITH {INDEX} SELECT line, min((price_c, chain))[2] AS chain, min(price_c) AS price_c FROM cells GROUP BY line")
def w05_cheapest_chain_per_line(spark, sf_dir):
    _, cells = basket_cells(spark, sf_dir)
    return cells.groupBy("line").agg(F.min(F.struct("price_c", "chain")).alias("x")).select("line", "x.chain", "x.price_c")


@query(
    "b17_hand_off",
    f"""WITH {COMPARED}, first AS (SELECT cart, chain FROM ranked WHERE place = 1)
SELECT f.chain, CASE WHEN p.price_c IS NULL THEN 'missing' WHEN NOT p.in_stock THEN 'out of stock' ELSE 'transfer' END AS outcome, count(*) AS n, coalesce(sum(p.qty), 0)::BIGINT AS units
FROM first f JOIN priced p ON p.cart = f.cart AND p.chain = f.chain GROUP BY ALL""",
)
def b17_hand_off(spark, sf_dir):
    """What happens to each line of a cart at its first chain: transferred, missing, out of stock."""
    first = comparison(spark, sf_dir).filter("place = 1").select("cart", "chain")
    asked = cart_lines(spark, sf_dir).join(first, "cart")
    sold = offers(spark, sf_dir).select("chain", "gtin", "in_stock")
    x = asked.join(sold, ["chain", "gtin"], "left")
    outcome = F.when(F.col("in_stock").isNull(), "missing").when(~F.col("in_stock"), "out of stock").otherwise("transfer")
    return x.groupBy("chain", outcome.alias("outcome")).agg(F.count("*").alias("n"), F.sum("qty").alias("units"))


@query(
    "b19_merged_lists",
    f"WITH {CART_LINES} SELECT cart % 1000 AS list, gtin, sum(qty)::BIGINT AS qty, count(*) AS n_merged FROM cart_lines GROUP BY ALL",
)
def b19_merged_lists(spark, sf_dir):
    """Saved lists put together: the quantities of one product add up."""
    return cart_lines(spark, sf_dir).groupBy((F.col("cart") % 1000).alias("list"), "gtin").agg(F.sum("qty").alias("qty"), F.count("*").alias("n_merged"))


@query(
    "a56_line_outcomes",
    f"""WITH {COMPARED}, n AS (SELECT chain, count(*) AS n_sold, count(*) FILTER (in_stock) AS ok FROM priced WHERE price_c IS NOT NULL GROUP BY chain)
SELECT chain, ok, n_sold - ok AS out_of_stock, (SELECT count(*) FROM cart_lines) - n_sold AS missing FROM n""",
)
def a56_line_outcomes(spark, sf_dir):
    """Cart lines by outcome at each chain; the missing ones are counted from the total, not made."""
    per = priced_lines(spark, sf_dir).groupBy("chain").agg(F.count("*").alias("n_sold"), F.count_if("in_stock").alias("ok"))
    total = cart_lines(spark, sf_dir).agg(F.count("*").alias("total"))
    return per.join(F.broadcast(total)).select("chain", "ok", (F.col("n_sold") - F.col("ok")).alias("out_of_stock"), (F.col("total") - F.col("n_sold")).alias("missing"))


@query(
    "p12_clean_lines",
    f"""WITH {CART_LINES}, {PRODUCTS} SELECT l.cart, l.line, l.gtin, l.qty, CASE WHEN p.gtin IS NOT NULL THEN l.gtin + 1 END AS substitute FROM cart_lines l LEFT JOIN products p ON p.gtin = l.gtin + 1 WHERE qty > 0 AND qty <= 40""",
)
def p12_clean_lines(spark, sf_dir):
    """Lines of a sensible quantity; a substitute that no catalogue knows becomes null."""
    lines = cart_lines(spark, sf_dir).filter("qty > 0 AND qty <= 40").withColumn("substitute", F.col("gtin") + 1)
    known = products(spark, sf_dir).select(F.col("gtin").alias("known"))
    return lines.join(known, F.col("substitute") == F.col("known"), "left").select("cart", "line", "gtin", "qty", F.col("known").alias("substitute"))


@query(
    "w08_allocated_discount",
    f"""WITH {OFFERS}, {CART_LINES}, x AS (SELECT l.cart, l.line, gtin, l.qty * p AS base FROM cart_lines l JOIN (SELECT gtin, min(price_c) AS p FROM offers GROUP BY gtin) USING (gtin)),
s AS (SELECT *, sum(base) OVER c AS total, floor(sum(base) OVER c * 0.07::DOUBLE)::BIGINT AS pool, row_number() OVER (PARTITION BY cart ORDER BY line DESC, gtin, base) AS back FROM x WINDOW c AS (PARTITION BY cart)),
d AS (SELECT *, (pool * base // total)::BIGINT AS share FROM s)
SELECT cart, line, base::BIGINT AS base, (CASE WHEN back = 1 THEN pool - (sum(share) OVER (PARTITION BY cart) - share) ELSE share END)::BIGINT AS share FROM d""",
)
def w08_allocated_discount(spark, sf_dir):
    """7 % off a cart dealt to its lines in proportion to their base; the last line takes what rounding leaves."""
    cheapest = offers(spark, sf_dir).groupBy("gtin").agg(F.min("price_c").alias("price_c"))
    x = cart_lines(spark, sf_dir).join(cheapest, "gtin").select("cart", "line", "gtin", (F.col("qty") * F.col("price_c")).alias("base"))
    by = Window.partitionBy("cart")
    x = x.withColumns({"total": F.sum("base").over(by), "back": F.row_number().over(by.orderBy(F.col("line").desc(), "gtin", "base"))})
    x = x.withColumn("pool", F.floor(F.col("total") * F.lit(0.07)).cast("long")).withColumn("share", F.expr("pool * base div total"))
    rest = F.col("pool") - (F.sum("share").over(by) - F.col("share"))
    return x.select("cart", "line", "base", F.when(F.col("back") == 1, rest).otherwise(F.col("share")).alias("share"))
