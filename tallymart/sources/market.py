"""The market tables, read from the star schema: offers, products, stores, carts, price days.

A chain is a supplier key modulo 14, a product a part, a cart an order. Money is whole cents in BIGINT: sums and
comparisons are exact and agree between engines. The SQL beside each table says the same for DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHAINS = 14
CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gtin, name (= concept), head (first word), family (last word), department, brand, size, base_c."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("gtin"), F.col("p_name").alias("name"),
        F.split_part("p_name", F.lit(" "), F.lit(1)).alias("head"), F.split_part("p_name", F.lit(" "), F.lit(-1)).alias("family"),
        F.col("p_type").alias("department"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"),
        F.round(F.col("p_retailprice") * 100).cast("long").alias("base_c"),
    )


PRODUCTS = """products AS (SELECT p_partkey AS gtin, p_name AS name, split_part(p_name, ' ', 1) AS head, split_part(p_name, ' ', -1) AS family,
  p_type AS department, p_brand AS brand, p_size AS size, round(p_retailprice * 100)::BIGINT AS base_c FROM part)"""


def price_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, store, gtin, day, price_c (per unit), pct (discount), qty, in_stock: one row per published price."""
    return table(spark, sf_dir, "lineitem").filter("l_quantity >= 1").select(
        (F.col("l_suppkey") % CHAINS).cast("int").alias("chain"), F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("gtin"),
        F.to_date("l_shipdate").alias("day"), F.expr(f"{CENTS} div CAST(l_quantity AS BIGINT)").alias("price_c"),
        F.round(F.col("l_discount") * 100).cast("int").alias("pct"), F.col("l_quantity").cast("long").alias("qty"),
        (F.col("l_linestatus") == "O").alias("in_stock"),
    )


PRICE_ROWS = f"""price_rows AS (SELECT (l_suppkey % {CHAINS})::INT AS chain, l_suppkey AS store, l_partkey AS gtin, l_shipdate::DATE AS day,
  {CENTS} // l_quantity::BIGINT AS price_c, round(l_discount * 100)::INT AS pct, l_quantity::BIGINT AS qty, l_linestatus = 'O' AS in_stock
  FROM lineitem WHERE l_quantity >= 1)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """chain, gtin, price_c (lowest), pct (best), n, in_stock, first_day, last_day: what each chain sells."""
    return price_rows(spark, sf_dir).groupBy("chain", "gtin").agg(
        F.min("price_c").alias("price_c"), F.max("pct").alias("pct"), F.count("*").alias("n"), F.max("in_stock").alias("in_stock"),
        F.min("day").alias("first_day"), F.max("day").alias("last_day"),
    )


OFFERS = f"""{PRICE_ROWS}, offers AS (SELECT chain, gtin, min(price_c) AS price_c, max(pct) AS pct, count(*) AS n, bool_or(in_stock) AS in_stock,
  min(day) AS first_day, max(day) AS last_day FROM price_rows GROUP BY chain, gtin)"""


def cart_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cart, line, gtin, qty."""
    return table(spark, sf_dir, "lineitem").filter("l_quantity >= 1").select(
        F.col("l_orderkey").alias("cart"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("gtin"), F.col("l_quantity").cast("long").alias("qty")
    )


CART_LINES = """cart_lines AS (SELECT l_orderkey AS cart, l_linenumber AS line, l_partkey AS gtin, l_quantity::BIGINT AS qty FROM lineitem WHERE l_quantity >= 1)"""


def stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """store, chain, nation, region, served (region 0 to 2), balance_c."""
    nation = table(spark, sf_dir, "nation")
    return (
        table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("s_suppkey").alias("store"), (F.col("s_suppkey") % CHAINS).cast("int").alias("chain"), F.col("n_nationkey").alias("nation"),
            F.col("n_name").alias("city"), F.col("n_regionkey").alias("region"), (F.col("n_regionkey") < 3).alias("served"),
        )
    )


STORES = f"""stores AS (SELECT s_suppkey AS store, (s_suppkey % {CHAINS})::INT AS chain, n_nationkey AS nation, n_name AS city, n_regionkey AS region,
  n_regionkey < 3 AS served FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
