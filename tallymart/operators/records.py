"""Records that come in from outside: clubs of promotions, provenance of price lists, sizes and brands from imports, basket configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..registry import query
from ..sources.market import CHAINS, PRICE_ROWS, PRODUCTS, price_rows, products, table
from .joins import first_reason


def club_id(text: Column) -> Column:
    """The first number in a club's text, 0 (all customers) without one."""
    return F.coalesce(F.nullif(F.regexp_extract(text, r"\d+", 0), F.lit("")).cast("long"), F.lit(0).cast("long"))


def with_clubs(promotions: DataFrame, profiles: DataFrame, labels: DataFrame) -> DataFrame:
    """promotions(chain, club_text, ...) -> also club_id, club (label). profiles(chain, club_id, label): a null label drops the promotion.

    labels(chain, label): a chain's name for clubs without a profile. Club 0 is everybody and has no label.
    """
    x = promotions.withColumn("club_id", club_id(F.col("club_text")))
    told = profiles.select("chain", "club_id", F.col("label").alias("_told"), F.lit(True).alias("_known"))
    x = x.join(told, ["chain", "club_id"], "left").join(labels.select("chain", F.col("label").alias("_label")), "chain", "left")
    known = F.coalesce("_known", F.lit(False))
    x = x.filter(~(known & F.col("_told").isNull()))
    return x.withColumn("club", F.when(known, F.col("_told")).when(F.col("club_id") != 0, F.col("_label"))).drop("_told", "_known", "_label")


@query(
    "f13_club_profiles",
    f"""WITH p AS (SELECT (o_custkey % {CHAINS})::INT AS chain, o_orderkey AS promo, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'everybody' ELSE 'club ' || o_orderpriority END AS t FROM orders),
c AS (SELECT chain, promo, coalesce(nullif(regexp_extract(t, '\\d+'), '')::BIGINT, 0) AS club_id FROM p)
SELECT chain, promo, club_id, CASE WHEN club_id = 2 THEN 'new club' WHEN club_id <> 0 THEN 'club of ' || chain END AS club FROM c WHERE NOT (club_id = 1 AND chain % 3 = 0)""",
)
def f13_club_profiles(spark, sf_dir):
    """Promotions with their club's label; clubs for employees (here: club 1 of every third chain) drop theirs."""
    text = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "everybody").otherwise(F.concat(F.lit("club "), "o_orderpriority"))
    promos = table(spark, sf_dir, "orders").select((F.col("o_custkey") % CHAINS).cast("int").alias("chain"), F.col("o_orderkey").alias("promo"), text.alias("club_text"))
    chains = spark.range(CHAINS).select(F.col("id").cast("int").alias("chain"))
    two = chains.select("chain", F.lit(2).cast("long").alias("club_id"), F.lit("new club").alias("label"))
    none = chains.filter("chain % 3 = 0").select("chain", F.lit(1).cast("long").alias("club_id"), F.lit(None).cast("string").alias("label"))
    labels = chains.select("chain", F.concat(F.lit("club of "), "chain").alias("label"))
    return with_clubs(promos, two.unionByName(none), labels).select("chain", "promo", "club_id", "club")


def provenance(generated_at: Column, source_date: Column, store: Column, fallback_store: Column, portal: Column) -> Column:
    """Where a price list comes from: as of its source's date, else of the day it was made; its own store, else the catalogue's."""
    return F.struct(
        generated_at.alias("generated_at"), source_date.alias("source_date"), F.coalesce(source_date, generated_at).alias("as_of"),
        F.coalesce(store, fallback_store).alias("store"), portal.alias("portal"),
    )


@query(
    "f36_provenance",
    f"""WITH {PRICE_ROWS}, l AS (SELECT chain, store, max(day) AS generated_at, max(day) FILTER (in_stock) AS source_date FROM price_rows GROUP BY ALL)
SELECT chain, generated_at, source_date, coalesce(source_date, generated_at) AS as_of, CASE WHEN store % 3 <> 0 THEN store ELSE -chain END AS store, CASE WHEN chain % 2 = 0 THEN 'web' END AS portal FROM l""",
)
def f36_provenance(spark, sf_dir):
    """A price list for each store, with its provenance."""
    lists = price_rows(spark, sf_dir).groupBy("chain", "store").agg(F.max("day").alias("generated_at"), F.max(F.when(F.col("in_stock"), F.col("day"))).alias("source_date"))
    own, other = F.when(F.col("store") % 3 != 0, F.col("store")), -F.col("chain").cast("long")
    meta = provenance(F.col("generated_at"), F.col("source_date"), own, other, F.when(F.col("chain") % 2 == 0, "web"))
    return lists.select("chain", meta.alias("price_list")).select("chain", "price_list.*")


def clean_size(value: Column, unit: Column, count: Column, most: int = 50_000) -> Column:
    """value, unit (g, ml, unit) and count of a size; null if it isn't well-formed: no positive value, another unit, a count under one, or over most in all."""
    large = unit.isin("kg", "l")
    v = F.when(large, value * 1000).otherwise(value)
    u = F.when(unit == "kg", "g").when(unit == "l", "ml").otherwise(unit)
    n = F.coalesce(count, F.lit(1))
    return F.when((v > 0) & u.isin("g", "ml", "unit") & (n >= 1) & (v * n <= most), F.struct(v.alias("value"), u.alias("unit"), n.cast("int").alias("count")))


def import_sizes(items: DataFrame, sizes: DataFrame, most: int = 50_000) -> DataFrame:
    """items(nr, gtin, value, unit, count, note, decided, override) merged into sizes(gtin, size) -> gtin, status, size.

    Of a code's items in order of nr: conflicts that nobody decided and malformed sizes are skipped; the last override replaces what is there, else what is
    there is kept, else the first good item is added. Codes have 8 to 14 digits; others are left out.
    """
    size = clean_size(F.col("value"), F.col("unit"), F.col("count"), most)
    open_ = ~(F.coalesce(F.col("decided"), F.lit(False)) | F.coalesce(F.col("override"), F.lit(False))) & F.coalesce(F.col("note"), F.lit("")).contains("CONFLICT")
    good = items.filter(F.col("gtin").rlike(r"^\d{8,14}$")).withColumn("new", F.when(~open_, size))
    own = good.groupBy("gtin").agg(
        F.max_by("new", F.when(F.col("override") & F.col("new").isNotNull(), F.col("nr"))).alias("forced"),
        F.min_by("new", F.when(F.col("new").isNotNull(), F.col("nr"))).alias("first"),
    )
    x = own.join(sizes.select("gtin", F.col("size").alias("old")), "gtin", "full")
    status = first_reason(
        ("replaced", F.col("forced").isNotNull() & F.col("old").isNotNull()), ("kept", F.col("old").isNotNull()), ("added", F.coalesce("forced", "first").isNotNull()), otherwise="skipped",
    )
    return x.select("gtin", status.alias("status"), F.coalesce("forced", "old", "first").alias("size"))


@query(
    "f37_size_import",
    f"""WITH {PRODUCTS}, i AS (SELECT gtin, '7' || lpad(gtin::VARCHAR, 8, '0') AS code, size, CASE gtin % 6 WHEN 0 THEN 'kg' WHEN 1 THEN 'l' WHEN 2 THEN 'g' WHEN 3 THEN 'ml' WHEN 4 THEN 'unit' ELSE 'box' END AS unit,
  CASE WHEN gtin % 5 > 0 THEN gtin % 5 - 1 END AS n, gtin % 7 = 0 AS conflict, gtin % 21 = 0 AS decided, gtin % 35 = 0 AS override FROM products),
c AS (SELECT *, CASE WHEN unit IN ('kg', 'l') THEN size * 1000 ELSE size END::BIGINT AS v, CASE unit WHEN 'kg' THEN 'g' WHEN 'l' THEN 'ml' ELSE unit END AS u, coalesce(n, 1)::INT AS k FROM i),
g AS (SELECT *, (NOT conflict OR decided OR override) AND v > 0 AND u <> 'box' AND k >= 1 AND v * k <= 50000 AS good, gtin % 4 = 0 AS old FROM c)
SELECT code AS gtin, CASE WHEN good AND override AND old THEN 'replaced' WHEN old THEN 'kept' WHEN good THEN 'added' ELSE 'skipped' END AS status,
  CASE WHEN good AND override THEN v WHEN old THEN 100 + gtin % 10 WHEN good THEN v END AS value, CASE WHEN good AND override THEN u WHEN old THEN 'g' WHEN good THEN u END AS unit,
  CASE WHEN good AND override THEN k WHEN old THEN 1 WHEN good THEN k END::INT AS count FROM g""",
)
def f37_size_import(spark, sf_dir):
    """Sizes of an import cleaned and merged into those known."""
    p = products(spark, sf_dir)
    g, code = F.col("gtin"), F.concat(F.lit("7"), F.lpad(F.col("gtin").cast("string"), 8, "0")).alias("gtin")
    unit = F.element_at(F.array(*[F.lit(u) for u in ("kg", "l", "g", "ml", "unit", "box")]), (g % 6 + 1).cast("int"))
    items = p.select(
        F.lit(0).alias("nr"), F.col("size").cast("long").alias("value"), unit.alias("unit"), F.when(g % 5 > 0, g % 5 - 1).alias("count"), F.when(g % 7 == 0, "CONFLICT: two sizes").alias("note"),
        (g % 21 == 0).alias("decided"), (g % 35 == 0).alias("override"), code,
    )
    known = p.filter("gtin % 4 = 0").select(F.struct((100 + g % 10).alias("value"), F.lit("g").alias("unit"), F.lit(1).alias("count")).alias("size"), code)
    return import_sizes(items, known).select("gtin", "status", "size.value", "size.unit", "size.count")


def merge_brands(records: DataFrame, brands: DataFrame, not_a_brand: str, longest: int = 30, replace: bool = False) -> DataFrame:
    """records(nr, gtin, brand) merged into brands(gtin, brand) -> gtin, status, brand.

    Empty brands and codes without 8 to 14 digits are invalid; texts that match not_a_brand or are too long are refused. Of a code's good
    records the first is added; where a brand is known it is kept, or with replace replaced by the last record.
    """
    b = F.trim(F.coalesce(F.col("brand"), F.lit("")))
    verdict = first_reason(("invalid", (b == "") | ~F.col("gtin").rlike(r"^\d{8,14}$")), ("not-a-brand", b.rlike(not_a_brand) | (F.length(b) > longest)), otherwise="good")
    x = records.select("nr", "gtin", b.alias("new"), verdict.alias("verdict"))
    own = x.groupBy("gtin").agg(
        (F.max_by if replace else F.min_by)("new", F.when(F.col("verdict") == "good", F.col("nr"))).alias("new"), F.min_by("verdict", "nr").alias("verdict")
    )
    both = own.join(brands.select("gtin", F.col("brand").alias("old")), "gtin", "full")
    hit = F.col("new").isNotNull()
    status = F.when(hit & F.col("old").isNull(), "added").when(hit & F.lit(replace), "replaced").when(F.col("old").isNotNull(), "kept").otherwise(F.col("verdict"))
    first = F.coalesce("new", "old") if replace else F.coalesce("old", "new")
    return both.select("gtin", status.alias("status"), first.alias("brand"))


@query(
    "f41_brand_merge",
    f"""WITH {PRODUCTS}, i AS (SELECT gtin, CASE WHEN gtin % 13 = 0 THEN gtin::VARCHAR ELSE '7' || lpad(gtin::VARCHAR, 8, '0') END AS code, trim(CASE gtin % 6 WHEN 0 THEN '' WHEN 1 THEN 'unknown' WHEN 2 THEN brand || repeat('x', gtin % 40) ELSE ' ' || brand END) AS b, gtin % 4 = 0 AS old FROM products),
v AS (SELECT *, CASE WHEN b = '' OR len(code) < 8 THEN 'invalid' WHEN regexp_matches(b, '^(unknown|none)$') OR len(b) > 30 THEN 'not-a-brand' ELSE 'good' END AS verdict FROM i)
SELECT code AS gtin, CASE WHEN verdict = 'good' AND NOT old THEN 'added' WHEN verdict = 'good' THEN 'replaced' WHEN old THEN 'kept' ELSE verdict END AS status, CASE WHEN verdict = 'good' THEN b WHEN old THEN 'old brand' END AS brand FROM v""",
)
def f41_brand_merge(spark, sf_dir):
    """Brand records of an import merged into those known, newer ones replacing them."""
    g = F.col("gtin")
    code = F.when(g % 13 == 0, g.cast("string")).otherwise(F.concat(F.lit("7"), F.lpad(g.cast("string"), 8, "0"))).alias("gtin")
    brand = F.when(g % 6 == 0, "").when(g % 6 == 1, "unknown").when(g % 6 == 2, F.concat("brand", F.repeat(F.lit("x"), (g % 40).cast("int")))).otherwise(F.concat(F.lit(" "), "brand"))
    p = products(spark, sf_dir)
    records = p.select(F.lit(0).alias("nr"), brand.alias("brand"), code)
    return merge_brands(records, p.filter("gtin % 4 = 0").select(F.lit("old brand").alias("brand"), code), "^(unknown|none)$", replace=True)


def basket_faults(lines: DataFrame, departments: DataFrame, units: dict[bool, str]) -> DataFrame:
    """lines(nr, gtin, gtins, qty, department, weighed, unit) of a reference basket -> nr, fault: the first check that a line fails, or ok.

    A line's codes (gtins, else gtin alone) hold its main one, have 8 or 11 to 14 digits and stand in no other line; the quantity is positive, the
    department known, the unit that of weighed or other lines.
    """
    x = lines.withColumn("gtins", F.coalesce("gtins", F.array("gtin")))
    codes = x.select("nr", F.explode("gtins").alias("code"))
    twice = codes.join(codes.groupBy("code").agg(F.min("nr").alias("first"), F.count("*").alias("n")).filter("n > 1"), "code").filter("nr > first").select("nr").distinct()
    x = x.join(twice.withColumn("twice", F.lit(True)), "nr", "left").join(departments.distinct().withColumn("known", F.lit(True)), "department", "left")
    unit = F.when(F.col("weighed"), units[True]).otherwise(units[False])
    fault = first_reason(
        ("no code", F.col("gtin").isNull()), ("main code missing", ~F.array_contains("gtins", F.col("gtin"))),
        ("code shape", F.exists("gtins", lambda g: g.isNull() | ~g.rlike(r"^(\d{8}|\d{11,14})$"))), ("code twice", F.coalesce("twice", F.lit(False))),
        ("quantity", ~F.coalesce(F.col("qty") > 0, F.lit(False))), ("department", F.col("known").isNull()), ("unit", ~F.col("unit").eqNullSafe(unit)),
    )
    return x.select("nr", fault.alias("fault"))


@query(
    "f42_basket_configuration",
    f"""WITH {PRODUCTS}, l AS (SELECT gtin AS nr, CASE WHEN gtin % 23 = 0 THEN gtin::VARCHAR WHEN gtin % 17 = 0 THEN '72900000017' ELSE '729' || lpad(gtin::VARCHAR, 8, '0') END AS code, size % 12 AS qty, department, gtin % 5 = 0 AS weighed, CASE WHEN gtin % 10 = 0 THEN 'kg' ELSE 'unit' END AS unit FROM products),
t AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY nr) AS seen FROM l)
SELECT nr, CASE WHEN NOT regexp_matches(code, '^([0-9]{{8}}|[0-9]{{11,14}})$') THEN 'code shape' WHEN seen > 1 THEN 'code twice' WHEN qty <= 0 THEN 'quantity' WHEN department IN ('PROMO') THEN 'department'
  WHEN unit <> CASE WHEN weighed THEN 'kg' ELSE 'unit' END THEN 'unit' ELSE 'ok' END AS fault FROM t""",
)
def f42_basket_configuration(spark, sf_dir):
    """A reference basket of all products, checked line by line."""
    g = F.col("gtin")
    code = F.when(g % 23 == 0, g.cast("string")).when(g % 17 == 0, "72900000017").otherwise(F.concat(F.lit("729"), F.lpad(g.cast("string"), 8, "0")))
    lines = products(spark, sf_dir).select(
        g.alias("nr"), code.alias("gtin"), F.lit(None).cast("array<string>").alias("gtins"), (F.col("size") % 12).alias("qty"), "department", (g % 5 == 0).alias("weighed"),
        F.when(g % 10 == 0, "kg").otherwise("unit").alias("unit"),
    )
    known = products(spark, sf_dir).select("department").distinct().filter("department <> 'PROMO'")
    return basket_faults(lines, known, {True: "kg", False: "unit"})
