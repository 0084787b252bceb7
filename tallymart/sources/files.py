"""Published files as tables: XML price, promotion and store files, JSON, CSV, and the sinks that publish a catalogue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import query
from .market import PRICE_ROWS, PRODUCTS, price_rows, products, table
from .scratch import shared_folder

ITEM = (
    "ItemCode string, ItemNm string, ItemName string, ManufacturerName string, UnitQty string, Quantity string, bIsWeighted string, "
    "UnitOfMeasure string, ItemPrice string, UnitOfMeasurePrice string, ItemStatus string, PriceUpdateDate string, PriceUpdateTime string"
)
PROMO_ITEM = "struct<ItemCode:string,RewardType:string,MinQty:string,MaxQty:string,DiscountRate:string,DiscountedPrice:string,bIsWeighted:string>"
PROMOTION = (
    "PromotionId string, PromotionDescription string, PromotionStartDate string, PromotionEndDate string, RewardType string, MinQty string, MaxQty string, "
    "DiscountRate string, DiscountedPrice string, RedemptionLimit string, ClubID string, AdditionalIsCoupon string, "
    "PromotionItems struct<Item:array<struct<ItemCode:string,IsGiftItem:string>>>, "
    f"Groups struct<Group:array<struct<PromotionItems:struct<PromotionItem:array<{PROMO_ITEM}>>>>>"
)

#: Elements of an XML file that is written here: a scan reads such a file in one task, whatever its size.
PER_FILE = 50_000


def number(c: Column) -> Column:
    """A decimal from text such as `1,234.5`; null where it is none."""
    return F.regexp_replace(F.trim(c), "[,\\s]", "").try_cast("decimal(18,4)")


def flag(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("1", "true", "yes"), F.lit(False))


def filled(*cs: Column) -> Column:
    """The first that isn't empty."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in cs])


def file_parts(path: Column) -> dict[str, Column]:
    """kind, chain (13 digits), sub, store, stamp of a file name such as PriceFull7290027600007-001-005-202410010300.xml; a name
    without a sub-chain has its store in second place."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    head = r"^(Price|PriceFull|Promo|PromoFull|Stores|StoresFull)([0-9]{13})-"
    kind = F.lower(F.regexp_extract(name, head, 1))
    three = F.regexp_extract(name, head + r"([0-9]{1,3})-([0-9]{1,4})-([0-9]{8})-?([0-9]{4,6})", 3)
    short = head + r"([0-9]{1,4})-([0-9]{8})-?([0-9]{4,6})"
    long = head + r"([0-9]{1,3})-([0-9]{1,4})-([0-9]{8})-?([0-9]{4,6})"
    pick = lambda i, j: F.when(three != "", F.regexp_extract(name, long, i)).otherwise(F.regexp_extract(name, short, j))
    stamp = F.concat(pick(5, 4), F.rpad(pick(6, 5), 6, "0"))
    return {
        "kind": F.nullif(kind, F.lit("")), "chain": F.nullif(F.regexp_extract(name, head, 2), F.lit("")),
        "sub": F.nullif(three, F.lit("")), "store": F.when(F.length(pick(4, 3)) < 3, F.lpad(F.nullif(pick(4, 3), F.lit("")), 3, "0")).otherwise(pick(4, 3)),
        "stamp": F.to_utc_timestamp(F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")), "Asia/Jerusalem"),
    }


def price_files(spark: SparkSession, path: str, tag: str = "Item") -> DataFrame:
    """code, name, manufacturer, price, unit_price, quantity, unit, weighed, status, updated, file: one row per published price.

    Rows without a positive price are kept with a null price, so that they can be counted; drop_unpriced() takes them away.
    """
    raw = spark.read.format("xml").option("rowTag", tag).schema(ITEM).load(path)
    price = number(F.col("ItemPrice"))
    return raw.select(
        filled(F.col("ItemCode")).alias("code"), filled(F.col("ItemName"), F.col("ItemNm")).alias("name"), filled(F.col("ManufacturerName")).alias("manufacturer"),
        F.when(price > 0, price).alias("price"), number(F.col("UnitOfMeasurePrice")).alias("unit_price"), number(F.col("Quantity")).alias("quantity"),
        filled(F.col("UnitOfMeasure"), F.col("UnitQty")).alias("unit"), flag(F.col("bIsWeighted")).alias("weighed"), F.col("ItemStatus").try_cast("int").alias("status"),
        F.expr("try_to_date(substring(PriceUpdateDate, 1, 10), 'yyyy-MM-dd')").alias("updated"), F.input_file_name().alias("file"),
    )


def drop_unpriced(rows: DataFrame) -> DataFrame:
    return rows.filter("price IS NOT NULL AND code IS NOT NULL")


def promotion_files(spark: SparkSession, path: str, most: str = "MaxQty") -> DataFrame:
    """promo_id, description, starts, ends, code, reward, min_qty, max_qty, rate, total, gift, club, coupon: one row per promotion and item, of either layout.

    most: how the files spell the promotion's greatest quantity; column names differ by case, which a schema can't hold twice.
    """
    raw = spark.read.format("xml").option("rowTag", "Promotion").schema(PROMOTION.replace(" MaxQty string", f" {most} string", 1)).load(path)
    none = F.lit(None).cast("string")
    flat = F.transform(
        F.coalesce("PromotionItems.Item", F.array()),
        lambda x: F.struct(
            x["ItemCode"].alias("code"), F.col("RewardType").alias("reward"), F.col("MinQty").alias("min_qty"), F.col(most).alias("max_qty"),
            F.col("DiscountRate").alias("rate"), F.col("DiscountedPrice").alias("total"), x["IsGiftItem"].alias("gift"),
        ),
    )
    grouped = F.transform(
        F.flatten(F.transform(F.coalesce("Groups.Group", F.array()), lambda g: F.coalesce(g["PromotionItems"]["PromotionItem"], F.array()))),
        lambda x: F.struct(
            x["ItemCode"].alias("code"), x["RewardType"].alias("reward"), x["MinQty"].alias("min_qty"), x["MaxQty"].alias("max_qty"),
            x["DiscountRate"].alias("rate"), x["DiscountedPrice"].alias("total"), none.alias("gift"),
        ),
    )
    rows = raw.select(
        filled(F.col("PromotionId")).alias("promo_id"), filled(F.col("PromotionDescription")).alias("description"),
        F.expr("try_to_date(substring(PromotionStartDate, 1, 10))").alias("starts"), F.expr("try_to_date(substring(PromotionEndDate, 1, 10))").alias("ends"),
        F.nullif(filled(F.col("ClubID")), F.lit("0")).alias("club"), flag(F.col("AdditionalIsCoupon")).alias("coupon"), F.explode_outer(F.concat(flat, grouped)).alias("x"),
    )
    return rows.select(
        "promo_id", "description", "starts", "ends", "club", "coupon", F.col("x.code").alias("code"), F.col("x.reward").try_cast("int").alias("reward"),
        number(F.col("x.min_qty")).alias("min_qty"), number(F.col("x.max_qty")).alias("max_qty"), number(F.col("x.rate")).alias("rate"), number(F.col("x.total")).alias("total"),
        flag(F.col("x.gift")).alias("gift"),
    )


@query(
    "s01_xml_round_trip",
    f"WITH {PRODUCTS} SELECT gtin::VARCHAR AS code, name, brand AS manufacturer, base_c AS price_c, size % 7 = 0 AS weighed FROM products WHERE base_c > 0",
)
def s01_xml_round_trip(spark, sf_dir):
    """The products as a price file that Spark writes, scanned again."""
    out = products(spark, sf_dir).select(
        F.col("gtin").cast("string").alias("ItemCode"), F.col("name").alias("ItemName"), F.col("brand").alias("ManufacturerName"),
        F.format_number(F.col("base_c") / 100, 2).alias("ItemPrice"), F.when(F.col("size") % 7 == 0, "1").otherwise("0").alias("bIsWeighted"),
    )
    path = shared_folder(spark)
    out.write.format("xml").option("maxRecordsPerFile", PER_FILE).option("rootTag", "Items").option("rowTag", "Item").save(path)
    rows = drop_unpriced(price_files(spark, path))
    return rows.select("code", "name", "manufacturer", (F.col("price") * 100).cast("long").alias("price_c"), "weighed")


@query(
    "s13_department_shards",
    f"WITH {PRODUCTS} SELECT department, count(*) AS n, sum(len(name))::BIGINT AS name_chars FROM products GROUP BY department",
)
def s13_department_shards(spark, sf_dir):
    """A folder for each department, and the index of the shards read from them."""
    path = shared_folder(spark)
    p = products(spark, sf_dir)
    p.repartition("department", F.pmod(F.xxhash64("gtin"), F.lit(8))).write.partitionBy("department").parquet(path)
    return spark.read.parquet(path).groupBy("department").agg(F.count("*").alias("n"), F.sum(F.length("name")).alias("name_chars"))


@query(
    "s15_rerun_replaces",
    f"WITH {PRICE_ROWS} SELECT year(day)::INT AS year, count(*) AS n, sum(CASE WHEN year(day) = 1999 THEN 2 * price_c ELSE price_c END)::BIGINT AS total_c FROM price_rows GROUP BY ALL",
)
def s15_rerun_replaces(spark, sf_dir):
    """A time series by year; a rerun of 1999 replaces that partition and nothing else."""
    path = shared_folder(spark)
    rows = price_rows(spark, sf_dir).select("gtin", "price_c", F.year("day").alias("year"))
    rows.write.partitionBy("year").parquet(path)
    again = rows.filter("year = 1999").withColumn("price_c", F.col("price_c") * 2)
    again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"), F.sum("price_c").alias("total_c"))


@query("s08_json_round_trip", "SELECT json_extract_string(props, '$.k')::BIGINT AS k, event_type, count(*) AS n FROM events GROUP BY ALL")
def s08_json_props(spark, sf_dir):
    """JSON text in a column, by a declared schema."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long").alias("p"))
    return e.groupBy(F.col("p.k").alias("k"), "event_type").agg(F.count("*").alias("n"))


@query(
    "s09_csv_round_trip",
    f"WITH {PRICE_ROWS} SELECT store, count(*) AS n, min(day) AS first_day, sum(price_c)::BIGINT AS total_c FROM price_rows GROUP BY store",
)
def s09_csv_round_trip(spark, sf_dir):
    path = shared_folder(spark)
    price_rows(spark, sf_dir).select("store", "gtin", "day", "price_c").write.csv(path, header=True)
    rows = spark.read.schema("store long, gtin long, day date, price_c long").csv(f"{path}/*.csv", header=True)
    return rows.groupBy("store").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.sum("price_c").alias("total_c"))


@query(
    "s16_run_ledger",
    f"""WITH {PRICE_ROWS} SELECT store, max(day) AS last_day, count(DISTINCT day) AS n_files FROM price_rows GROUP BY store""",
)
def s16_run_ledger(spark, sf_dir):
    """A ledger of files per store and day, filled in two loads of which the second overlaps: a file counts once."""
    path = shared_folder(spark)
    files = price_rows(spark, sf_dir).select("store", "day").distinct()
    files.filter("day < DATE '1999-01-01'").write.parquet(path)
    known = spark.read.parquet(path)
    files.filter("day >= DATE '1998-06-01'").join(known, ["store", "day"], "left_anti").write.mode("append").parquet(f"{path}-more")
    both = known.unionByName(spark.read.parquet(f"{path}-more"))
    return both.groupBy("store").agg(F.max("day").alias("last_day"), F.count("*").alias("n_files"))
