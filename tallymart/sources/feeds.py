"""Published feeds as they land: promotion and store files, catalogues, configuration, increments, retention, continuous arrival."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from .files import PER_FILE, file_parts, filled, promotion_files
from .market import OFFERS, PRICE_ROWS, PRODUCTS, STORES, offers, price_rows, products, stores, table
from .scratch import shared_folder


def promo_rows(spark, sf_dir: str) -> DataFrame:
    """promo (chain and discount), chain, gtin, pct, day: the promotions that the given prices stand for."""
    return offers(spark, sf_dir).filter("pct > 0").select(F.concat_ws("-", "chain", "pct").alias("promo"), "chain", "gtin", "pct", "first_day")


@query(
    "s02_flat_promotions",
    f"WITH {OFFERS} SELECT chain || '-' || pct || '-' || gtin AS promo_id, gtin::VARCHAR AS code, pct::BIGINT AS rate, first_day AS starts, gtin % 4 = 0 AS gift FROM offers WHERE pct > 0",
)
def s02_flat_promotions(spark, sf_dir):
    """Promotions written in the flat layout (rule on the promotion, a list of items) and scanned again."""
    item = F.array(F.struct(F.col("gtin").cast("string").alias("ItemCode"), F.when(F.col("gtin") % 4 == 0, "1").otherwise("0").alias("IsGiftItem")))
    out = promo_rows(spark, sf_dir).select(
        F.concat_ws("-", "promo", "gtin").alias("PromotionId"), F.date_format("first_day", "yyyy-MM-dd").alias("PromotionStartDate"), F.col("pct").cast("string").alias("DiscountRate"),
        F.struct(item.alias("Item")).alias("PromotionItems"),
    )
    path = shared_folder(spark)
    out.write.format("xml").option("maxRecordsPerFile", PER_FILE).option("rootTag", "Promotions").option("rowTag", "Promotion").save(path)
    return promotion_files(spark, path).select("promo_id", "code", F.col("rate").cast("long").alias("rate"), "starts", "gift")


@query(
    "s03_grouped_promotions",
    f"WITH {OFFERS} SELECT 'p' || gtin AS promo_id, gtin::VARCHAR AS code, chain::INT AS reward, pct::BIGINT AS rate FROM offers WHERE pct > 0",
)
def s03_grouped_promotions(spark, sf_dir):
    """Promotions in the grouped layout: a promotion holds groups, a group items with their own rule. A product's chains are its items."""
    item = F.struct(F.col("gtin").cast("string").alias("ItemCode"), F.col("chain").cast("string").alias("RewardType"), F.col("pct").cast("string").alias("DiscountRate"))
    per = offers(spark, sf_dir).filter("pct > 0").groupBy("gtin").agg(F.collect_list(item).alias("items"))
    group = F.struct(F.struct(F.col("items").alias("PromotionItem")).alias("PromotionItems"))
    out = per.select(F.concat(F.lit("p"), "gtin").alias("PromotionId"), F.struct(F.array(group).alias("Group")).alias("Groups"))
    path = shared_folder(spark)
    out.write.format("xml").option("maxRecordsPerFile", PER_FILE).option("rootTag", "Promos").option("rowTag", "Promotion").save(path)
    return promotion_files(spark, path).select("promo_id", "code", "reward", F.col("rate").cast("long").alias("rate"))


def store_files(spark: SparkSession, path: str) -> DataFrame:
    """store (three digits at least), name, city, kind, sub; the entry 000 is no store."""
    raw = spark.read.format("xml").option("rowTag", "Store").schema("StoreId string, StoreName string, Address string, City string, StoreType string, SubChainId string").load(path)
    id_ = filled(F.col("StoreId"))
    store = F.when(F.length(id_) < 3, F.lpad(id_, 3, "0")).otherwise(id_)
    rows = raw.select(store.alias("store"), filled(F.col("StoreName")).alias("name"), filled(F.col("City")).alias("city"), F.col("StoreType").try_cast("int").alias("kind"), filled(F.col("SubChainId")).alias("sub"))
    return rows.filter("store IS NOT NULL AND store <> '000'")


@query(
    "s04_store_registry",
    f"WITH {STORES} SELECT CASE WHEN len(store::VARCHAR) < 3 THEN lpad(store::VARCHAR, 3, '0') ELSE store::VARCHAR END AS store, city, (chain % 3)::INT AS kind FROM stores WHERE store <> 0",
)
def s04_store_registry(spark, sf_dir):
    out = stores(spark, sf_dir).select(F.col("store").cast("string").alias("StoreId"), F.col("city").alias("City"), (F.col("chain") % 3).cast("string").alias("StoreType"))
    path = shared_folder(spark)
    out.write.format("xml").option("maxRecordsPerFile", PER_FILE).option("rootTag", "Stores").option("rowTag", "Store").save(path)
    return store_files(spark, path).select("store", "city", "kind")


@query(
    "s05_file_names",
    f"""WITH {PRICE_ROWS}, f AS (SELECT DISTINCT chain, store, day FROM price_rows)
SELECT chain, store, day, 'pricefull' AS kind, lpad((7290000000000 + chain)::VARCHAR, 13, '0') AS chain_code, CASE WHEN store % 2 = 0 THEN '001' END AS sub, CASE WHEN store % 10000 < 1000 THEN lpad((store % 10000)::VARCHAR, 3, '0') ELSE (store % 10000)::VARCHAR END AS store_code,
  timezone('UTC', timezone('Asia/Jerusalem', day + INTERVAL 10 HOUR)) AS stamp FROM f""",
)
def s05_file_names(spark, sf_dir):
    """What a file's name tells; the sub-chain may be missing. The stamp is a wall clock of the shops, given as an instant."""
    f = price_rows(spark, sf_dir).select("chain", "store", "day").distinct()
    sub = F.when(F.col("store") % 2 == 0, "-001").otherwise("")
    number = (F.col("store") % 10000).cast("string")
    number = F.when(F.length(number) < 3, F.lpad(number, 3, "0")).otherwise(number)
    name = F.concat(F.lit("/in/PriceFull"), (F.lit(7290000000000) + F.col("chain")).cast("string"), sub, F.lit("-"), number, F.lit("-"), F.date_format("day", "yyyyMMdd"), F.lit("1000.xml"))
    parts = file_parts(name)
    return f.select(
        "chain", "store", "day", parts["kind"].alias("kind"), parts["chain"].alias("chain_code"), parts["sub"].alias("sub"), parts["store"].alias("store_code"), parts["stamp"].cast("timestamp_ntz").alias("stamp")
    )


@query("s07_json_catalogues", f"WITH {OFFERS} SELECT chain, count(*) AS n, sum(price_c)::BIGINT AS price_c, count(*) FILTER (in_stock) AS n_in_stock FROM offers GROUP BY chain")
def s07_json_catalogues(spark, sf_dir):
    """Catalogue documents with nested items, written and read again. A chain's catalogue is dealt over documents of about 500 items."""
    item = F.struct("gtin", "price_c", "in_stock")
    part = F.floor(F.col("gtin") / 500)
    docs = offers(spark, sf_dir).groupBy("chain", part.alias("part")).agg(F.collect_list(item).alias("items"))
    path = shared_folder(spark)
    docs.write.json(path)
    schema = "chain int, part long, items array<struct<gtin:bigint,price_c:bigint,in_stock:boolean>>"
    rows = spark.read.schema(schema).json(path).select("chain", F.inline("items"))
    return rows.groupBy("chain").agg(F.count("*").alias("n"), F.sum("price_c").alias("price_c"), F.count_if("in_stock").alias("n_in_stock"))


def keyed_config(text: DataFrame, value_type: str) -> DataFrame:
    """text(json): objects keyed by id -> id, value fields; entries with a null value or an empty id are invalid and told apart."""
    rows = text.select(F.explode(F.from_json("json", f"map<string,{value_type}>")).alias("id", "value"))
    return rows.withColumn("valid", (F.trim("id") != "") & F.col("value").isNotNull())


@query(
    "s10_keyed_config",
    f"WITH {PRODUCTS} SELECT CASE WHEN gtin % 50 = 0 THEN '' ELSE gtin::VARCHAR END AS id, CASE WHEN gtin % 30 <> 7 THEN brand END AS brand, gtin % 50 <> 0 AND gtin % 30 <> 7 AS valid FROM products",
)
def s10_keyed_config(spark, sf_dir):
    p = products(spark, sf_dir)
    key = F.when(F.col("gtin") % 50 == 0, "").otherwise(F.col("gtin").cast("string"))
    value = F.when(F.col("gtin") % 30 != 7, F.to_json(F.struct("brand"))).otherwise("null")
    text = p.select(F.concat(F.lit('{"'), key, F.lit('":'), value, F.lit("}")).alias("json"))
    return keyed_config(text, "struct<brand:string>").select("id", F.col("value.brand").alias("brand"), "valid")


@query("s11_series_lines", f"WITH {PRICE_ROWS} SELECT day, count(*) AS n, min(price_c) AS min_c FROM price_rows WHERE NOT (gtin % 10 = 0 OR gtin % 15 = 1) GROUP BY day")
def s11_series_lines(spark, sf_dir):
    """A series as JSON lines; those that can't be parsed, and those without their key, are skipped."""
    path = shared_folder(spark)
    good = F.to_json(F.struct(F.when(F.col("gtin") % 15 != 1, F.date_format("day", "yyyy-MM-dd")).alias("day"), "price_c"))
    price_rows(spark, sf_dir).select(F.when(F.col("gtin") % 10 == 0, '{"day": "1999-').otherwise(good).alias("value")).write.text(path)
    rows = spark.read.schema("day date, price_c long").option("mode", "DROPMALFORMED").json(path).filter("day IS NOT NULL")
    return rows.groupBy("day").agg(F.count("*").alias("n"), F.min("price_c").alias("min_c"))


def new_files(found: DataFrame, ledger: DataFrame) -> DataFrame:
    """found(file, digest) that the ledger doesn't hold with that digest."""
    return found.join(ledger.select("file", "digest"), ["file", "digest"], "left_anti")


@query(
    "s12_incremental_files",
    f"""WITH {PRICE_ROWS}, f AS (SELECT store, day, sum(price_c)::BIGINT AS digest FROM price_rows GROUP BY ALL) SELECT year(day)::INT AS year, count(*) AS n FROM f WHERE NOT (day < DATE '1999-01-01' AND digest % 10 <> 0) GROUP BY ALL""",
)
def s12_incremental_files(spark, sf_dir):
    """Files that an earlier load didn't record, and those whose content has changed since."""
    f = price_rows(spark, sf_dir).groupBy("store", "day").agg(F.sum("price_c").alias("digest")).withColumn("file", F.concat_ws("-", "store", "day"))
    path = shared_folder(spark)
    f.filter("day < DATE '1999-01-01'").select("file", F.when(F.col("digest") % 10 == 0, -1).otherwise(F.col("digest")).alias("digest")).write.parquet(path)
    return new_files(f, spark.read.parquet(path)).groupBy(F.year("day").alias("year")).agg(F.count("*").alias("n"))


@query("s14_chain_catalogues", f"WITH {OFFERS} SELECT chain, count(*) AS n, max(last_day) AS last_day FROM offers WHERE in_stock AND chain >= 7 GROUP BY chain")
def s14_chain_catalogues(spark, sf_dir):
    """A folder a chain; reading the chains from seven on opens their folders only."""
    path = shared_folder(spark)
    offers(spark, sf_dir).write.partitionBy("chain").parquet(path)
    return spark.read.parquet(path).filter("chain >= 7 AND in_stock").groupBy("chain").agg(F.count("*").alias("n"), F.max("last_day").alias("last_day"))


@query("s17_retention", f"WITH {PRICE_ROWS} SELECT year(day)::INT AS year, count(*) AS n FROM price_rows WHERE year(day) >= (SELECT max(year(day)) - 2 FROM price_rows) GROUP BY ALL")
def s17_retention(spark, sf_dir):
    """Raw partitions of the last three years stay; older ones aren't read, so that dropping them costs nothing."""
    path = shared_folder(spark)
    price_rows(spark, sf_dir).select("store", "gtin", "price_c", F.year("day").alias("year")).write.partitionBy("year").parquet(path)
    raw = spark.read.parquet(path)
    newest = raw.agg(F.max("year")).first()[0]
    return raw.filter(F.col("year") >= (newest or 0) - 2).groupBy("year").agg(F.count("*").alias("n"))


@query("s18_vectors", "SELECT label, count(*) AS n, round(sum(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 6) AS squares FROM embeddings GROUP BY label")
def s18_vectors(spark, sf_dir):
    """Vectors as arrays of floats in Parquet, written and read again."""
    path = shared_folder(spark)
    table(spark, sf_dir, "embeddings").write.parquet(path)
    v = spark.read.parquet(path).select("label", F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x * x).alias("s"))
    return v.groupBy("label").agg(F.count("*").alias("n"), F.round(F.sum("s"), 6).alias("squares"))


@query("t01_arriving_files", f"WITH {PRICE_ROWS} SELECT store, count(*) AS n, max(day) AS last_day FROM price_rows GROUP BY store")
def t01_arriving_files(spark, sf_dir):
    """Price files that arrive between two runs of a stream: each is taken once, by the stream's own log, and a second run takes the new ones only."""
    path = shared_folder(spark)
    rows = price_rows(spark, sf_dir).select("store", "day", "price_c")

    def take() -> None:
        s = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 64).parquet(f"{path}/in")
        s.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start().awaitTermination()

    rows.filter("day < DATE '1999-01-01'").write.parquet(f"{path}/in")
    take()
    rows.filter("day >= DATE '1999-01-01'").write.mode("append").parquet(f"{path}/in")
    take()
    return spark.read.schema(rows.schema).parquet(f"{path}/out").groupBy("store").agg(F.count("*").alias("n"), F.max("day").alias("last_day"))
