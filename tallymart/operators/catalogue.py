"""Unifying products across chains: barcode groups, votes, medians, class cards, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.market import OFFERS, PRICE_ROWS, PRODUCTS, STORES, offers, price_rows, products, stores
from ..sources.scratch import written

def mode_by(rows: DataFrame, keys: list[str], value: str, *ties: Column) -> DataFrame:
    """The most frequent value of each key; ties by the given columns, then by value."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("votes"))
    order = Window.partitionBy(*keys).orderBy(F.col("votes").desc(), *ties, value)
    return counts.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


@query(
    "a01_barcode_groups",
    f"WITH {PRICE_ROWS} SELECT gtin, count(DISTINCT chain) AS n_chains, count(DISTINCT store) AS n_stores, count(*) AS n_rows, min(price_c) AS min_c, max(price_c) AS max_c, count(*) FILTER (in_stock) AS n_in_stock FROM price_rows GROUP BY gtin",
)
def a01_barcode_groups(spark, sf_dir):
    return price_rows(spark, sf_dir).groupBy("gtin").agg(
        F.count_distinct("chain").alias("n_chains"), F.count_distinct("store").alias("n_stores"), F.count("*").alias("n_rows"),
        F.min("price_c").alias("min_c"), F.max("price_c").alias("max_c"), F.count_if("in_stock").alias("n_in_stock"),
    )


@query(
    "a02_upper_median",
    f"WITH {OFFERS} SELECT gtin, quantile_disc(price_c, 0.5 ORDER BY price_c DESC)::BIGINT AS median_c FROM offers WHERE price_c > 0 GROUP BY gtin",
)
def a02_upper_median(spark, sf_dir):
    return offers(spark, sf_dir).filter("price_c > 0").groupBy("gtin").agg(
        F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price_c DESC)").cast("long").alias("median_c")
    )


@query("a03_middle_median", f"WITH {OFFERS} SELECT gtin, median(price_c)::DOUBLE AS median_c FROM offers GROUP BY gtin")
def a03_middle_median(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("gtin").agg(F.median("price_c").alias("median_c"))


@query(
    "a04_mode",
    f"""WITH {PRICE_ROWS}, c AS (SELECT gtin, qty, count(*) AS votes FROM price_rows GROUP BY ALL)
SELECT gtin, qty, votes FROM c QUALIFY row_number() OVER (PARTITION BY gtin ORDER BY votes DESC, len(qty::VARCHAR), qty) = 1""",
)
def a04_mode(spark, sf_dir):
    return mode_by(price_rows(spark, sf_dir), ["gtin"], "qty", F.length(F.col("qty").cast("string")))


@query(
    "a05_first_seen_mode",
    f"""WITH {PRICE_ROWS}, c AS (SELECT gtin, store, count(*) AS votes, min(day) AS seen FROM price_rows GROUP BY ALL)
SELECT gtin, store, votes FROM c QUALIFY row_number() OVER (PARTITION BY gtin ORDER BY votes DESC, seen, store) = 1""",
)
def a05_first_seen_mode(spark, sf_dir):
    counts = price_rows(spark, sf_dir).groupBy("gtin", "store").agg(F.count("*").alias("votes"), F.min("day").alias("seen"))
    order = Window.partitionBy("gtin").orderBy(F.col("votes").desc(), "seen", "store")
    return counts.withColumn("rn", F.row_number().over(order)).filter("rn = 1").select("gtin", "store", "votes")


@query(
    "a07_family_votes",
    f"""WITH {PRICE_ROWS}, {STORES}, v AS (SELECT DISTINCT gtin, nation, pct FROM price_rows JOIN stores USING (store)),
c AS (SELECT gtin, pct, count(*) AS votes FROM v GROUP BY ALL)
SELECT gtin, pct, votes FROM c QUALIFY row_number() OVER (PARTITION BY gtin ORDER BY votes DESC, pct) = 1""",
)
def a07_family_votes(spark, sf_dir):
    """One vote for each family of chains (by nation) and distinct value."""
    family = stores(spark, sf_dir).select("store", "nation")
    votes = price_rows(spark, sf_dir).join(family, "store").select("gtin", "nation", "pct").distinct()
    return mode_by(votes, ["gtin"], "pct")


@query(
    "a11_owner",
    f"""WITH {PRICE_ROWS}, c AS (SELECT gtin % 100 AS prefix, chain, count(*) AS n FROM price_rows WHERE pct >= 8 GROUP BY ALL)
SELECT prefix, chain, n FROM c QUALIFY row_number() OVER (PARTITION BY prefix ORDER BY n DESC, chain) = 1""",
)
def a11_owner(spark, sf_dir):
    counts = price_rows(spark, sf_dir).filter("pct >= 8").groupBy((F.col("gtin") % 100).alias("prefix"), "chain").agg(F.count("*").alias("n"))
    return counts.groupBy("prefix").agg(F.max_by(F.struct("chain", "n"), F.struct("n", -F.col("chain"))).alias("x")).select("prefix", "x.chain", "x.n")


@query(
    "a12_majority_in_stock",
    f"WITH {OFFERS} SELECT gtin, 2 * count(*) FILTER (in_stock) > count(*) AS mostly_in_stock FROM offers GROUP BY gtin",
)
def a12_majority_in_stock(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("gtin").agg((2 * F.count_if("in_stock") > F.count("*")).alias("mostly_in_stock"))


def class_cards(rows: DataFrame, band: int = 3, least: int = 3) -> DataFrame:
    """rows(concept, family, price_c) -> concept, median_c, n_families, n_dropped.

    The cheapest row of each family; a provisional upper median; rows beyond band times it, either way, fall out; the
    median of the rest, if least families are left.
    """
    cheapest = rows.groupBy("concept", "family").agg(F.min("price_c").alias("price_c"))
    median = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price_c DESC)").cast("long")
    first = cheapest.groupBy("concept").agg(median.alias("provisional_c"), F.count("*").alias("n_all"))
    near = cheapest.join(first, "concept").filter((F.col("price_c") <= F.col("provisional_c") * band) & (F.col("price_c") * band >= F.col("provisional_c")))
    out = near.groupBy("concept").agg(median.alias("median_c"), F.count("*").alias("n_families"), (F.max("n_all") - F.count("*")).alias("n_dropped"))
    return out.filter(F.col("n_families") >= least)


@query(
    "a13_class_cards",
    f"""WITH {OFFERS}, {PRODUCTS}, c AS (SELECT name AS concept, chain AS family, min(price_c) AS price_c FROM offers JOIN products USING (gtin) GROUP BY ALL),
f AS (SELECT concept, quantile_disc(price_c, 0.5 ORDER BY price_c DESC) AS p, count(*) AS n_all FROM c GROUP BY concept)
SELECT concept, quantile_disc(price_c, 0.5 ORDER BY price_c DESC)::BIGINT AS median_c, count(*) AS n_families, max(n_all) - count(*) AS n_dropped
FROM c JOIN f USING (concept) WHERE price_c <= 3 * p AND price_c * 3 >= p GROUP BY concept HAVING count(*) >= 3""",
)
def a13_class_cards(spark, sf_dir):
    rows = offers(spark, sf_dir).join(products(spark, sf_dir).select("gtin", "name"), "gtin")
    return class_cards(rows.select(F.col("name").alias("concept"), F.col("chain").alias("family"), "price_c"))


@query(
    "a14_shared_code_clash",
    f"""WITH {PRICE_ROWS}, c AS (SELECT gtin, pct AS class, count(*) AS n FROM price_rows GROUP BY ALL),
t AS (SELECT *, sum(n) OVER (PARTITION BY gtin) AS total, count(*) OVER (PARTITION BY gtin) AS n_classes FROM c)
SELECT gtin, class, n, 2 * n > total AS keeps FROM t WHERE n_classes > 1""",
)
def a14_shared_code_clash(spark, sf_dir):
    """Classes that claim one code: a strict majority keeps it."""
    counts = price_rows(spark, sf_dir).groupBy("gtin", F.col("pct").alias("class")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("gtin")
    out = counts.withColumns({"total": F.sum("n").over(w), "n_classes": F.count("*").over(w)}).filter("n_classes > 1")
    return out.select("gtin", "class", "n", (2 * F.col("n") > F.col("total")).alias("keeps"))


@query(
    "a16_coverage",
    f"""WITH {OFFERS}, {PRODUCTS}, {STORES}, s AS (SELECT chain, bool_or(served) AS served FROM stores GROUP BY chain),
x AS (SELECT * FROM offers JOIN products USING (gtin) JOIN s USING (chain))
SELECT 'all' AS level, 'all' AS key, count(DISTINCT gtin) FILTER (served) AS n_served, count(DISTINCT gtin) AS n_any FROM x
UNION ALL SELECT 'chain', chain::VARCHAR, count(DISTINCT gtin) FILTER (served), count(DISTINCT gtin) FROM x GROUP BY chain
UNION ALL SELECT 'department', department, count(DISTINCT gtin) FILTER (served), count(DISTINCT gtin) FROM x GROUP BY department""",
)
def a16_coverage(spark, sf_dir):
    """Products with a price in a served chain, and in any: overall, by chain, by department. One row a product and chain is enough."""
    served = stores(spark, sf_dir).groupBy("chain").agg(F.max("served").alias("served"))
    x = offers(spark, sf_dir).select("chain", "gtin").join(products(spark, sf_dir).select("gtin", "department"), "gtin").join(served, "chain")
    n = [F.count_distinct(F.when(F.col("served"), F.col("gtin"))).alias("n_served"), F.count_distinct("gtin").alias("n_any")]
    return (
        x.agg(*n).select(F.lit("all").alias("level"), F.lit("all").alias("key"), "n_served", "n_any")
        .unionByName(x.groupBy("chain").agg(*n).select(F.lit("chain").alias("level"), F.col("chain").cast("string").alias("key"), "n_served", "n_any"))
        .unionByName(x.groupBy("department").agg(*n).select(F.lit("department").alias("level"), F.col("department").alias("key"), "n_served", "n_any"))
    )


@query(
    "a19_concept_profile",
    f"""WITH {OFFERS}, {PRODUCTS}, p AS (SELECT name AS concept, count(*) AS n_products, count(*) FILTER (size > 25) AS n_sized, median(base_c)::DOUBLE AS median_c FROM products GROUP BY name),
c AS (SELECT name AS concept, count(DISTINCT chain) AS n_chains FROM offers JOIN products USING (gtin) GROUP BY name)
SELECT p.*, coalesce(n_chains, 0) AS n_chains FROM p LEFT JOIN c USING (concept)""",
)
def a19_concept_profile(spark, sf_dir):
    items = products(spark, sf_dir)
    p = items.groupBy(F.col("name").alias("concept")).agg(F.count("*").alias("n_products"), F.count_if(F.col("size") > 25).alias("n_sized"), F.median("base_c").alias("median_c"))
    c = offers(spark, sf_dir).join(items.select("gtin", F.col("name").alias("concept")), "gtin").groupBy("concept").agg(F.count_distinct("chain").alias("n_chains"))
    return p.join(c, "concept", "left").withColumn("n_chains", F.coalesce("n_chains", F.lit(0).cast("long")))


@query(
    "a20_sellers",
    f"""WITH {OFFERS}, {STORES}, s AS (SELECT chain, bool_or(served) AS served FROM stores GROUP BY chain)
SELECT gtin, count(*) FILTER (served) AS n_served, count(*) FILTER (NOT served) AS n_unserved, string_agg(chain::VARCHAR, ',' ORDER BY chain) AS sellers FROM offers JOIN s USING (chain) GROUP BY gtin""",
)
def a20_sellers(spark, sf_dir):
    served = stores(spark, sf_dir).groupBy("chain").agg(F.max("served").alias("served"))
    return offers(spark, sf_dir).join(served, "chain").groupBy("gtin").agg(
        F.count_if("served").alias("n_served"), F.count_if(~F.col("served")).alias("n_unserved"),
        F.array_join(F.transform(F.array_sort(F.collect_set("chain")), lambda x: x.cast("string")), ",").alias("sellers"),
    )


@query("a22_category_counts", f"WITH {PRODUCTS} SELECT department, count(*) AS n FROM products GROUP BY department")
def a22_category_counts(spark, sf_dir):
    return products(spark, sf_dir).groupBy("department").agg(F.count("*").alias("n"))


@query("a23_price_range", f"WITH {OFFERS} SELECT gtin, min(price_c) AS min_c, max(price_c) AS max_c, count(*) AS sellers FROM offers GROUP BY gtin")
def a23_price_range(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("gtin").agg(F.min("price_c").alias("min_c"), F.max("price_c").alias("max_c"), F.count("*").alias("sellers"))


def resolve(items: DataFrame, sold: DataFrame, overrides: DataFrame) -> DataFrame:
    """items(gtin, concept) at each chain -> chain, gtin, item, method, price_c: override, then code, then cheapest in stock of the concept.

    sold(chain, gtin, concept, price_c, in_stock), overrides(chain, gtin, item). One row for each tier that has an
    answer, the first tier stays; a product and chain without any has no row.

    A product is one row with its chains' answers as an array, and a concept (or, of a product in several, their set) one with its cheapest
    items: what a concept offers at each chain is neither shuffled nor sorted for each product.
    """
    answer = lambda tier, item, price="price_c": F.struct("chain", F.lit(tier).alias("tier"), F.col(item).alias("item"), F.col(price).alias("price_c"))
    by_code = sold.select("gtin", answer(2, "gtin").alias("x"))
    manual = overrides.join(sold.select("chain", F.col("gtin").alias("item"), "price_c"), ["chain", "item"]).select("gtin", answer(1, "item").alias("x"))
    own = by_code.unionByName(manual).groupBy(F.col("gtin").alias("_gtin")).agg(F.collect_list("x").alias("own"))
    wanted = written(items.groupBy("gtin").agg(F.array_sort(F.collect_set("concept")).alias("concepts")))
    cheapest = sold.filter("in_stock AND price_c > 0").groupBy("chain", "concept").agg(F.min(F.struct("price_c", "gtin")).alias("x"))
    of_set = wanted.select("concepts").distinct().select("concepts", F.explode("concepts").alias("concept")).join(cheapest, "concept")
    of_set = of_set.groupBy("concepts", "chain").agg(F.min(F.struct(F.col("x.gtin").alias("item"), "x.price_c")).alias("y"))
    by_class = written(of_set.groupBy("concepts").agg(F.collect_list(answer(3, "y.item", "y.price_c")).alias("others")))
    met = wanted.join(own, F.col("gtin").eqNullSafe(F.col("_gtin")), "full").join(by_class, "concepts", "left")
    known = F.filter("own", lambda x: (x["tier"] == 1) | (F.col("concepts").isNotNull() & F.col("gtin").isNotNull()))
    in_order = F.array_sort(F.concat(*[F.coalesce(c, F.array().cast(met.schema["own"].dataType)) for c in (known, F.col("others"))]))
    first = F.transform(F.array(in_order), lambda xs: F.filter(xs, lambda x, i: (i == 0) | ~x["chain"].eqNullSafe(F.get(xs, i - 1)["chain"])))
    best = met.select(F.coalesce("gtin", "_gtin").alias("gtin"), F.get(first, F.lit(0)).alias("best")).select("gtin", F.inline("best"))
    return best.select("chain", "gtin", "item", F.element_at(F.array(*map(F.lit, ("manual", "code", "concept"))), F.col("tier")).alias("method"), "price_c")


RESOLVED = f"""{OFFERS}, {PRODUCTS}, sold AS (SELECT o.chain, gtin, name AS concept, price_c, in_stock FROM offers o JOIN products USING (gtin)),
overrides AS (SELECT chain, gtin, gtin + 1 AS item FROM offers WHERE gtin % 50 = 7),
tiers AS (SELECT o.chain, o.gtin, o.item, 1 AS tier, s.price_c FROM overrides o JOIN sold s ON s.chain = o.chain AND s.gtin = o.item
  UNION ALL SELECT chain, gtin, gtin, 2, price_c FROM sold
  UNION ALL SELECT c.chain, p.gtin, c.x[2], 3, c.x[1] FROM products p JOIN (SELECT chain, concept, min((price_c, gtin)) AS x FROM sold WHERE in_stock AND price_c > 0 GROUP BY ALL) c ON c.concept = p.name),
resolved AS (SELECT chain, gtin, item, (['manual', 'code', 'concept'])[tier] AS method, price_c FROM tiers QUALIFY row_number() OVER (PARTITION BY chain, gtin ORDER BY tier, item) = 1)"""


def resolved(spark, sf_dir: str) -> DataFrame:
    items = products(spark, sf_dir).select("gtin", F.col("name").alias("concept"))
    sold = written(offers(spark, sf_dir).join(items, "gtin").select("chain", "gtin", "concept", "price_c", "in_stock"))
    overrides = sold.filter("gtin % 50 = 7").select("chain", "gtin", (F.col("gtin") + 1).alias("item"))
    return resolve(items, sold, overrides)


@query("j05_resolution", f"WITH {RESOLVED} SELECT * FROM resolved")
def j05_resolution(spark, sf_dir):
    return resolved(spark, sf_dir)


@query("a24_mapping_coverage", f"WITH {RESOLVED} SELECT chain, count(*) FILTER (method = 'manual') AS manual, count(*) FILTER (method = 'code') AS code, count(*) FILTER (method = 'concept') AS concept FROM resolved GROUP BY chain")
def a24_mapping_coverage(spark, sf_dir):
    out = resolved(spark, sf_dir).groupBy("chain").pivot("method", ["manual", "code", "concept"]).count()
    return out.na.fill(0)


@query(
    "g01_unified_catalogue",
    f"""WITH {OFFERS}, {PRODUCTS}, a AS (SELECT gtin, count(*) AS n_chains, quantile_disc(price_c, 0.5 ORDER BY price_c DESC)::BIGINT AS median_c, bool_or(in_stock) AS in_stock FROM offers WHERE price_c >= 20 GROUP BY gtin)
SELECT gtin, name, department, brand, size, n_chains, median_c, in_stock FROM a JOIN products USING (gtin) WHERE n_chains >= 2""",
)
def g01_unified_catalogue(spark, sf_dir):
    """Products of at least two chains, with the median of their prices; prices under 20 cents aren't plausible."""
    a = offers(spark, sf_dir).filter("price_c >= 20").groupBy("gtin").agg(
        F.count("*").alias("n_chains"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price_c DESC)").cast("long").alias("median_c"), F.max("in_stock").alias("in_stock")
    )
    return a.filter("n_chains >= 2").join(products(spark, sf_dir), "gtin").select("gtin", "name", "department", "brand", "size", "n_chains", "median_c", "in_stock")


@query(
    "o01_catalogue_cap",
    f"""WITH {OFFERS}, a AS (SELECT gtin, count(*) AS n_chains, quantile_disc(price_c, 0.5 ORDER BY price_c DESC)::BIGINT AS median_c FROM offers GROUP BY gtin)
SELECT * FROM a ORDER BY n_chains DESC, median_c, gtin LIMIT 500""",
)
def o01_catalogue_cap(spark, sf_dir):
    a = offers(spark, sf_dir).groupBy("gtin").agg(F.count("*").alias("n_chains"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price_c DESC)").cast("long").alias("median_c"))
    return a.orderBy(F.col("n_chains").desc(), "median_c", "gtin").limit(500)


@query(
    "o07_cheapest_five",
    f"""WITH {OFFERS}, {PRODUCTS} SELECT chain, name AS concept, gtin, price_c, rn::INT AS place FROM (SELECT chain, name, gtin, price_c, row_number() OVER (PARTITION BY chain, name ORDER BY price_c, gtin) AS rn FROM offers JOIN products USING (gtin) WHERE in_stock) WHERE rn <= 5""",
)
def o07_cheapest_five(spark, sf_dir):
    rows = offers(spark, sf_dir).filter("in_stock").join(products(spark, sf_dir).select("gtin", F.col("name").alias("concept")), "gtin")
    w = Window.partitionBy("chain", "concept").orderBy("price_c", "gtin")
    return rows.withColumn("place", F.row_number().over(w)).filter("place <= 5").select("chain", "concept", "gtin", "price_c", "place")


@query(
    "p09_ratio_band",
    f"""WITH {OFFERS}, m AS (SELECT gtin, quantile_disc(price_c, 0.5 ORDER BY price_c DESC) AS base FROM offers WHERE price_c > 0 GROUP BY gtin)
SELECT gtin, count(*) AS n_near, max(greatest(price_c * 1000 // base, base * 1000 // price_c))::BIGINT AS worst FROM offers JOIN m USING (gtin) WHERE price_c > 0 AND price_c <= 3 * base AND price_c * 3 >= base GROUP BY gtin""",
)
def p09_ratio_band(spark, sf_dir):
    """Offers within three times the product's median either way, and the worst ratio among them (in thousandths)."""
    rows = offers(spark, sf_dir).filter("price_c > 0")
    m = rows.groupBy("gtin").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY price_c DESC)").cast("long").alias("base"))
    near = rows.join(m, "gtin").filter("price_c <= 3 * base AND price_c * 3 >= base")
    return near.groupBy("gtin").agg(F.count("*").alias("n_near"), F.max(F.expr("greatest(price_c * 1000 div base, base * 1000 div price_c)")).alias("worst"))


@query("p11_min_sellers", f"WITH {OFFERS} SELECT gtin, count(DISTINCT chain) AS n_chains FROM offers GROUP BY gtin HAVING count(DISTINCT chain) >= 10")
def p11_min_sellers(spark, sf_dir):
    return offers(spark, sf_dir).groupBy("gtin").agg(F.count_distinct("chain").alias("n_chains")).filter("n_chains >= 10")


@query(
    "p17_barcode_valid",
    f"""WITH {PRODUCTS}, c AS (SELECT gtin, lpad(gtin::VARCHAR, 12, '0') AS code FROM products),
s AS (SELECT gtin, code, list_sum(list_transform(range(1, 12), lambda i: substring(code, i::INT, 1)::INT * (CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END))) AS total FROM c)
SELECT gtin, (10 - total % 10) % 10 = substring(code, 12, 1)::INT AS valid FROM s""",
)
def p17_barcode_valid(spark, sf_dir):
    """Whether the last of 12 digits is the GS1 check digit of the others."""
    code = F.lpad(F.col("gtin").cast("string"), 12, "0")
    digits = F.transform(F.sequence(F.lit(1), F.lit(11)), lambda i: F.substr(code, i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 3).otherwise(1))
    total = F.aggregate(digits, F.lit(0), lambda a, x: a + x)
    return products(spark, sf_dir).select("gtin", ((10 - total % 10) % 10 == F.substr(code, F.lit(12), F.lit(1)).cast("int")).alias("valid"))


@query(
    "u01_capped_and_extras",
    f"""WITH {OFFERS}, {PRODUCTS}, a AS (SELECT gtin, count(*) AS n_chains FROM offers GROUP BY gtin),
cap AS (SELECT gtin FROM a ORDER BY n_chains DESC, gtin LIMIT 500), extra AS (SELECT gtin FROM products WHERE brand = 'Brand#1')
SELECT gtin, 'capped' AS why FROM cap UNION ALL SELECT gtin, 'own brand' FROM extra WHERE gtin NOT IN (SELECT gtin FROM cap)""",
)
def u01_capped_and_extras(spark, sf_dir):
    a = offers(spark, sf_dir).groupBy("gtin").agg(F.count("*").alias("n_chains"))
    cap = a.orderBy(F.col("n_chains").desc(), "gtin").limit(500).select("gtin")
    extra = products(spark, sf_dir).filter("brand = 'Brand#1'").select("gtin").join(cap, "gtin", "left_anti")
    return cap.withColumn("why", F.lit("capped")).unionByName(extra.withColumn("why", F.lit("own brand")))
