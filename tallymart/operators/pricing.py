"""Promotions and basket prices: line totals, bundles shared by lines, fees, ranking. All carts at all chains at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.market import CART_LINES, OFFERS, STORES, cart_lines, offers, stores

RULE = "struct<type:string,min_qty:bigint,total_c:bigint,unit_c:bigint,percent:bigint,amount_c:bigint,free_qty:bigint,max_qty:bigint,club:boolean>"


def rule_total(qty: Column, price: Column, rule: Column, weighed: Column) -> Column:
    """What qty units cost under one rule, in cents; null where the rule doesn't apply.

    Units beyond max_qty pay the shelf price; bundles take whole units only and no weighed goods.
    """
    need = F.coalesce(rule["min_qty"], F.lit(1))
    held = F.least(qty, F.coalesce(rule["max_qty"], qty))
    rest = (qty - held) * price
    sets, left = F.floor(held / need), held % need
    pair = F.floor(held / 2)
    total = (
        F.when(rule["type"] == "multi", F.when(~weighed, sets * rule["total_c"] + left * price))
        .when(rule["type"] == "unit", held * rule["unit_c"])
        .when(rule["type"] == "percent", F.floor(held * price * (100 - rule["percent"]) / 100))
        .when(rule["type"] == "discount", held * price - sets * rule["amount_c"])
        .when(rule["type"] == "bundleFree", F.when(~weighed, held * price - F.floor(held / (need + rule["free_qty"])) * rule["free_qty"] * price))
        .when(rule["type"] == "second", F.when(~weighed, held * price - F.floor(pair * price * rule["percent"] / 100)))
    )
    return F.when(qty >= need, total + rest).cast("long")


def line_prices(lines: DataFrame) -> DataFrame:
    """lines(..., qty, price_c, weighed, rules array<RULE>) -> also base_c, total_c, club_c, rule_no.

    The best regular rule counts if it is cheaper than the shelf, the first of equal ones; club rules never enter the
    total but give club_c, null when no better than the total. No rules, null rules: the shelf price.
    """
    qty, price, weighed = F.col("qty"), F.col("price_c"), F.coalesce(F.col("weighed"), F.lit(False))
    base = qty * price
    tried = F.transform(
        F.coalesce(F.col("rules"), F.array().cast(f"array<{RULE}>")),
        lambda r, i: F.struct(rule_total(qty, price, r, weighed).alias("total"), i.alias("no"), F.coalesce(r["club"], F.lit(False)).alias("club")),
    )
    fit = lambda club: F.array_min(F.filter("_tried", lambda x: x["total"].isNotNull() & (x["club"] == F.lit(club)) & (x["total"] < F.col("base_c"))))
    out = lines.withColumns({"base_c": base, "_tried": tried}).withColumns({"_best": fit(False), "_club": fit(True)})
    total = F.coalesce(F.col("_best.total"), F.col("base_c"))
    return out.withColumns(
        {"total_c": total, "rule_no": F.col("_best.no"), "club_c": F.when(F.col("_club.total") < total, F.col("_club.total"))}
    ).drop("_best", "_club", "_tried")


def rules_from_percent(pct: Column, price: Column) -> Column:
    """The promotions that the driver's discounts stand for: up to 4 % a percentage, up to 6 % three for a price, at 7 % two and one free, else a unit price for ten."""
    cut = lambda x: F.floor(x * (100 - pct) / 100)
    none = F.lit(None).cast("long")
    make = lambda kind, need=none, total=none, unit=none, percent=none, free=none, most=none: F.struct(
        F.lit(kind).alias("type"), need.alias("min_qty"), total.alias("total_c"), unit.alias("unit_c"), percent.alias("percent"),
        none.alias("amount_c"), free.alias("free_qty"), most.alias("max_qty"), F.lit(False).alias("club"),
    )
    lit = lambda n: F.lit(n).cast("long")
    rule = (
        F.when(pct <= 4, make("percent", percent=pct.cast("long")))
        .when(pct <= 6, make("multi", need=lit(3), total=cut(price * 3).cast("long")))
        .when(pct == 7, make("bundleFree", need=lit(2), free=lit(1)))
        .otherwise(make("unit", unit=cut(price).cast("long"), most=lit(10)))
    )
    return F.when(pct > 0, F.array(rule)).otherwise(F.array().cast(f"array<{RULE}>"))


PRICED = f"""{OFFERS}, {CART_LINES}, chains AS (SELECT DISTINCT chain FROM offers),
priced AS (SELECT c.chain, l.cart, l.line, l.gtin, l.qty, o.price_c, o.in_stock, o.pct, l.qty * o.price_c AS base_c, least(l.qty * o.price_c,
    CASE WHEN pct = 0 THEN l.qty * price_c WHEN pct <= 4 THEN l.qty * price_c * (100 - pct) // 100
         WHEN pct <= 6 THEN (l.qty // 3) * (price_c * 3 * (100 - pct) // 100) + (l.qty % 3) * price_c WHEN pct = 7 THEN (l.qty - l.qty // 3) * price_c
         ELSE least(l.qty, 10) * (price_c * (100 - pct) // 100) + greatest(l.qty - 10, 0) * price_c END) AS total_c
  FROM cart_lines l CROSS JOIN chains c LEFT JOIN offers o ON o.chain = c.chain AND o.gtin = l.gtin)"""


def priced_lines(spark, sf_dir: str) -> DataFrame:
    """Every cart line at every chain: cart, line, chain, gtin, qty, base_c, total_c (null where the chain lacks it), in_stock.

    Lines are joined to the offers by product, so that only chains that sell one make rows: no cross join. The chains
    that lack a line are counted from the cart's size where they are needed.
    """
    sold = offers(spark, sf_dir).withColumn("rules", rules_from_percent(F.col("pct"), F.col("price_c"))).withColumn("weighed", F.lit(False))
    lines = cart_lines(spark, sf_dir).join(sold.select("chain", "gtin", "price_c", "in_stock", "rules", "weighed"), "gtin")
    return line_prices(lines).drop("rules", "weighed")


@query(
    "b01_line_prices",
    f"WITH {PRICED} SELECT chain, count(*) AS n_lines, sum(base_c)::BIGINT AS base_c, sum(total_c)::BIGINT AS total_c, count(*) FILTER (total_c < base_c) AS n_promo FROM priced WHERE price_c IS NOT NULL GROUP BY chain",
)
def b01_line_prices(spark, sf_dir):
    return priced_lines(spark, sf_dir).groupBy("chain").agg(
        F.count("*").alias("n_lines"), F.sum("base_c").alias("base_c"), F.sum("total_c").alias("total_c"), F.count_if(F.col("total_c") < F.col("base_c")).alias("n_promo")
    )


def compare_baskets(lines: DataFrame, sizes: DataFrame, fees: DataFrame) -> DataFrame:
    """lines(cart, chain, base_c, total_c), sizes(cart, n_lines), fees(chain, fee_c, free_above_c, min_order_c, delivers).

    -> per cart and chain: goods_c, savings_c, n_found, n_missing, coverage, fee_c, below_min, total_c, place, best.
    Ranked by delivery, completeness, coverage, then price; best: complete and above the minimum order first.
    """
    per = lines.groupBy("cart", "chain").agg(
        F.sum("total_c").alias("goods_c"), F.sum(F.col("base_c") - F.col("total_c")).alias("savings_c"), F.count("*").alias("n_found")
    )
    out = per.join(sizes, "cart").join(fees, "chain")
    fee = F.when(F.col("goods_c") >= F.col("free_above_c"), F.lit(0)).otherwise(F.col("fee_c"))
    out = out.select(
        "cart", "chain", "goods_c", "savings_c", "n_found", (F.col("n_lines") - F.col("n_found")).alias("n_missing"),
        F.floor(F.col("n_found") * 10000 / F.col("n_lines")).alias("coverage"), fee.cast("long").alias("fee_c"),
        (F.col("goods_c") < F.col("min_order_c")).alias("below_min"), "delivers",
        (F.col("goods_c") + F.coalesce(fee, F.lit(0))).cast("long").alias("total_c"),
    )
    rank = Window.partitionBy("cart").orderBy(F.col("delivers").desc(), (F.col("n_missing") == 0).desc(), F.col("coverage").desc(), "total_c", "chain")
    best = Window.partitionBy("cart").orderBy(((F.col("n_missing") == 0) & ~F.col("below_min")).desc(), F.col("coverage").desc(), "total_c", "chain")
    return out.withColumns({"place": F.row_number().over(rank), "best": F.row_number().over(best) == 1})


def chain_fees(spark, sf_dir: str) -> DataFrame:
    """A chain delivers if it has a store in a served region; its fee falls with its number of such stores, odd chains' fees are unknown above 12."""
    return stores(spark, sf_dir).groupBy("chain").agg(F.count_if("served").alias("n_served")).select(
        "chain", (F.col("n_served") > 0).alias("delivers"), F.when(F.col("chain") <= 12, F.greatest(F.lit(3000) - F.col("n_served") * 100, F.lit(0))).cast("long").alias("fee_c"),
        F.lit(50_000_00).cast("long").alias("free_above_c"), F.lit(1_000_00).cast("long").alias("min_order_c"),
    )


COMPARED = f"""{PRICED}, {STORES},
fees AS (SELECT chain, count(*) FILTER (served) > 0 AS delivers, CASE WHEN chain <= 12 THEN greatest(3000 - count(*) FILTER (served) * 100, 0) END AS fee_c FROM stores GROUP BY chain),
sizes AS (SELECT cart, count(*) AS n_lines FROM cart_lines GROUP BY cart),
per AS (SELECT cart, chain, sum(total_c) AS goods_c, sum(base_c - total_c) AS savings_c, count(*) AS n_found FROM priced WHERE price_c IS NOT NULL GROUP BY cart, chain),
cmp AS (SELECT cart, chain, goods_c::BIGINT AS goods_c, savings_c::BIGINT AS savings_c, n_found, n_lines - n_found AS n_missing, (n_found * 10000 // n_lines)::BIGINT AS coverage,
    (CASE WHEN goods_c >= 5000000 THEN 0 ELSE fee_c END)::BIGINT AS fee_c, goods_c < 100000 AS below_min, delivers,
    (goods_c + coalesce(CASE WHEN goods_c >= 5000000 THEN 0 ELSE fee_c END, 0))::BIGINT AS total_c FROM per JOIN sizes USING (cart) JOIN fees USING (chain)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cart ORDER BY delivers DESC, n_missing = 0 DESC, coverage DESC, total_c, chain) AS place,
    row_number() OVER (PARTITION BY cart ORDER BY (n_missing = 0 AND NOT below_min) DESC, coverage DESC, total_c, chain) = 1 AS best FROM cmp)"""


def by_cart(lines: DataFrame, cells: DataFrame, *fields: str) -> DataFrame:
    """lines(cart, gtin, ...), cells(gtin, fields) -> the lines with the fields of each of their product's cells, dealt by cart. A line meets its
    product's cells as arrays and is shuffled once with them; rows come of them after that, so that what is grouped by cart, or by cart
    and chain, needs no further shuffle. Arrays are sorted, so that what products have in common (the chains, as first field) compresses."""
    cells = cells.groupBy("gtin").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_cells"))
    packed = cells.select("gtin", *[F.col(f"_cells.{f}").alias(f) for f in fields])
    return lines.join(packed, "gtin").repartition("cart").select(*lines.columns, F.inline(F.arrays_zip(*fields)))


def comparison(spark, sf_dir: str) -> DataFrame:
    lines = cart_lines(spark, sf_dir)
    met = by_cart(lines.select("cart", "gtin", "qty"), offers(spark, sf_dir).select("gtin", "chain", "price_c", "pct"), "chain", "price_c", "pct")
    met = met.withColumns({"rules": rules_from_percent(F.col("pct"), F.col("price_c")), "weighed": F.lit(False)})
    return compare_baskets(line_prices(met), lines.groupBy("cart").agg(F.count("*").alias("n_lines")), chain_fees(spark, sf_dir))


@query("b13_basket_comparison", f"WITH {COMPARED} SELECT * FROM ranked")
def b13_basket_comparison(spark, sf_dir):
    return comparison(spark, sf_dir)


@query("w06_winning_chains", f"WITH {COMPARED} SELECT chain, count(*) FILTER (place = 1) AS n_first, count(*) FILTER (best) AS n_best, count(*) FILTER (n_missing = 0) AS n_complete FROM ranked GROUP BY chain")
def w06_winning_chains(spark, sf_dir):
    return comparison(spark, sf_dir).groupBy("chain").agg(
        F.count_if(F.col("place") == 1).alias("n_first"), F.count_if("best").alias("n_best"), F.count_if(F.col("n_missing") == 0).alias("n_complete")
    )


def take_more_hint(lines: DataFrame, most: int = 3) -> DataFrame:
    """The fewest units (1 to most) that can be added for no more than the line costs; null without.

    Each number of units is a column of its line, priced by line_prices() one after another: no line is repeated, and only hints are shuffled (a cart's
    line may stand in several rows)."""
    keys = [c for c in ("cart", "line", "chain") if c in lines.columns]
    more = lines.select(*keys, F.col("qty").alias("_qty"), F.col("total_c").alias("_total"), "qty", "price_c", "weighed", "rules", F.lit(None).cast("int").alias("add"))
    for i in range(1, most + 1):
        tried = line_prices(more.withColumn("qty", F.col("_qty") + i))
        more = tried.withColumn("add", F.coalesce("add", F.when(F.col("total_c") <= F.col("_total"), i))).select(*more.columns)
    return more.filter("add IS NOT NULL").groupBy(*keys).agg(F.min("add").alias("add"))


@query(
    "b03_take_more",
    f"""WITH {PRICED}, more AS (SELECT chain, cart, line, total_c AS was, pct, price_c, qty + a AS qty, a FROM priced CROSS JOIN range(1, 4) r(a) WHERE price_c IS NOT NULL),
hint AS (SELECT chain, cart, line, min(a) AS add FROM (SELECT *, least(qty * price_c, CASE WHEN pct = 0 THEN qty * price_c WHEN pct <= 4 THEN qty * price_c * (100 - pct) // 100
         WHEN pct <= 6 THEN (qty // 3) * (price_c * 3 * (100 - pct) // 100) + (qty % 3) * price_c WHEN pct = 7 THEN (qty - qty // 3) * price_c
         ELSE least(qty, 10) * (price_c * (100 - pct) // 100) + greatest(qty - 10, 0) * price_c END) AS total_c FROM more) WHERE total_c <= was GROUP BY ALL)
SELECT chain, add::INT AS add, count(*) AS n FROM hint GROUP BY ALL""",
)
def b03_take_more(spark, sf_dir):
    sold = offers(spark, sf_dir).withColumn("rules", rules_from_percent(F.col("pct"), F.col("price_c"))).withColumn("weighed", F.lit(False))
    lines = line_prices(cart_lines(spark, sf_dir).join(sold.select("chain", "gtin", "price_c", "rules", "weighed"), "gtin"))
    return take_more_hint(lines).groupBy("chain", "add").agg(F.count("*").alias("n"))


def pooled(lines: DataFrame, need: int = 3) -> DataFrame:
    """lines(cart, chain, pool, line, qty, price_c, total_c, pct): units of one promotion bought together in a cart.

    Every ``need`` units cost 100 - pct percent; leftovers are the dearest units. Units aren't exploded: with lines in
    order of price, the cumulated quantity says how many of a line fall into bundles. A pool counts if it gains.
    The pool's saving is dealt to its lines by their base; the last line takes what rounding leaves.
    """
    by = Window.partitionBy("cart", "chain", "pool")
    order = by.orderBy("price_c", "line")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    x = lines.withColumns({"upto": F.sum("qty").over(upto), "units": F.sum("qty").over(by), "n_pool": F.count("*").over(by), "base": F.col("qty") * F.col("price_c")})
    x = x.withColumn("inside", F.greatest(F.least(F.col("upto"), F.col("units") - F.col("units") % need) - (F.col("upto") - F.col("qty")), F.lit(0)))
    x = x.withColumn("cost", F.col("inside") * F.col("price_c"))
    x = x.withColumns({"in_bundles": F.sum("cost").over(by), "apart": F.sum("total_c").over(by), "base_all": F.sum("base").over(by), "least_pct": F.min("pct").over(by)})
    x = x.withColumn("pool_c", F.col("base_all") - F.floor(F.col("in_bundles") * F.col("least_pct") / 100))
    x = x.withColumn("share", F.floor(F.col("pool_c") * F.col("base") / F.col("base_all")))
    dealt = F.when(F.row_number().over(order) == F.col("n_pool"), F.col("pool_c") - F.coalesce(F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).otherwise(F.col("share"))
    gains = (F.col("n_pool") > 1) & (F.col("pool_c") < F.col("apart"))
    return x.select("cart", "chain", "pool", "line", "pool_c", "apart", F.when(gains, dealt).otherwise(F.col("total_c")).cast("long").alias("pooled_c"), gains.alias("gains"))


@query(
    "b05_pooled_bundles",
    f"""WITH {PRICED}, p AS (SELECT *, gtin % 5 AS pool, qty * price_c AS base FROM priced WHERE price_c IS NOT NULL AND pct BETWEEN 5 AND 7),
x AS (SELECT *, sum(qty) OVER o AS upto, sum(qty) OVER b AS units, count(*) OVER b AS n_pool, sum(total_c) OVER b AS apart, sum(base) OVER b AS base_all, min(pct) OVER b AS least_pct
  FROM p WINDOW b AS (PARTITION BY cart, chain, pool), o AS (PARTITION BY cart, chain, pool ORDER BY price_c, line ROWS UNBOUNDED PRECEDING)),
y AS (SELECT *, sum(greatest(least(upto, units - units % 3) - (upto - qty), 0) * price_c) OVER (PARTITION BY cart, chain, pool) AS in_bundles FROM x),
z AS (SELECT *, base_all - (in_bundles * least_pct) // 100 AS pool_c FROM y)
SELECT chain, count(*) AS n_lines, count(DISTINCT (cart, pool)) FILTER (n_pool > 1 AND pool_c < apart) AS n_pools, sum(total_c)::BIGINT AS apart_c,
  (sum(total_c) FILTER (NOT (n_pool > 1 AND pool_c < apart)) + coalesce((SELECT sum(pool_c) FROM (SELECT DISTINCT cart, chain, pool, pool_c FROM z q WHERE n_pool > 1 AND pool_c < apart AND q.chain = z.chain)), 0))::BIGINT AS pooled_c
FROM z GROUP BY chain""",
)
def b05_pooled_bundles(spark, sf_dir):
    sold = offers(spark, sf_dir).filter("pct BETWEEN 5 AND 7").withColumn("rules", rules_from_percent(F.col("pct"), F.col("price_c"))).withColumn("weighed", F.lit(False))
    lines = line_prices(cart_lines(spark, sf_dir).join(sold.select("chain", "gtin", "price_c", "rules", "weighed", "pct"), "gtin")).withColumn("pool", F.col("gtin") % 5)
    out = pooled(lines)
    apart = lines.groupBy("chain").agg(F.sum("total_c").alias("apart_c"))
    return out.groupBy("chain").agg(
        F.count("*").alias("n_lines"), F.count_distinct(F.when(F.col("gains"), F.struct("cart", "pool"))).alias("n_pools"), F.sum("pooled_c").alias("pooled_c")
    ).join(apart, "chain")
