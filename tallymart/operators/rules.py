"""Rule tables over names: pattern matches with a literal prefilter, ordered rules, guards, departments, promotion texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import head_word, text_key
from ..registry import query
from ..sources.market import OFFERS, PRODUCTS, STORES, offers, products, stores, table


def rule_matches(names: DataFrame, patterns: DataFrame) -> DataFrame:
    """names(name), patterns(concept, kind all/any/none, literal, pattern) -> (name, concept) that the concept's patterns take.

    All of `all`, one of `any` where there are such, none of `none`. Each pattern names a literal that its matches hold, anywhere
    in a name and inside words too, so distinct names meet patterns by an equi join on the literal's first three characters
    (shorter literals: on all of them), and the expressions run on what is left.
    """
    lengths = [r[0] for r in patterns.select(F.least(F.length("literal"), F.lit(3))).distinct().collect()]  # three numbers at most
    pieces = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length("name") - n + 1, F.lit(1))), lambda i: F.substring(F.col("name"), i, F.lit(n)))
    keyed = names.select("name").distinct().select("name", F.explode(F.array_distinct(F.concat(*map(pieces, lengths or [1])))).alias("key"))
    found = keyed.join(patterns.withColumn("key", F.substring("literal", 1, 3)), "key").filter(F.contains("name", "literal"))
    hit = found.filter(F.expr("name rlike pattern")).groupBy("name", "concept").agg(
        F.count_if(F.col("kind") == "all").alias("n_all"), F.count_if(F.col("kind") == "any").alias("n_any"), F.count_if(F.col("kind") == "none").alias("n_none")
    )
    need = patterns.groupBy("concept").agg(F.count_if(F.col("kind") == "all").alias("want_all"), F.count_if(F.col("kind") == "any").alias("want_any"))
    return hit.join(need, "concept").filter("n_none = 0 AND n_all = want_all AND (want_any = 0 OR n_any > 0)").select("name", "concept")


PATTERNS = f"""{PRODUCTS}, patterns AS (
  SELECT DISTINCT head || '!' AS concept, 'all' AS kind, head AS literal, '(^| )' || head || '( |$)' AS pattern FROM products
  UNION ALL SELECT DISTINCT head || '!', 'any', family, family || '$' FROM products WHERE size % 2 = 0 AND len(family) <= 5
  UNION ALL SELECT DISTINCT head || '!', 'none', family, family FROM products WHERE len(family) = 4 AND len(head) = 4)"""


def sample_patterns(items: DataFrame) -> DataFrame:
    """A rule table over the products' own words: a head word, one of some last words, none of others."""
    concept = F.concat("head", F.lit("!")).alias("concept")
    one = lambda rows, kind, literal, pattern: rows.select(concept, F.lit(kind).alias("kind"), F.col(literal).alias("literal"), pattern.alias("pattern")).distinct()
    return (
        one(items, "all", "head", F.concat(F.lit("(^| )"), "head", F.lit("( |$)")))
        .unionByName(one(items.filter("size % 2 = 0 AND length(family) <= 5"), "any", "family", F.concat("family", F.lit("$"))))
        .unionByName(one(items.filter("length(family) = 4 AND length(head) = 4"), "none", "family", F.col("family")))
    )


MATCHED = f"""{PATTERNS}, hits AS (SELECT name, concept, count(*) FILTER (kind = 'all') AS n_all, count(*) FILTER (kind = 'any') AS n_any, count(*) FILTER (kind = 'none') AS n_none
  FROM (SELECT DISTINCT name FROM products) n JOIN patterns ON regexp_matches(name, pattern) GROUP BY ALL),
matched AS (SELECT name, h.concept FROM hits h JOIN (SELECT concept, count(*) FILTER (kind = 'all') AS want_all, count(*) FILTER (kind = 'any') AS want_any FROM patterns GROUP BY concept) p USING (concept)
  WHERE n_none = 0 AND n_all = want_all AND (want_any = 0 OR n_any > 0))"""


@query("j13_rule_matches", f"WITH {MATCHED} SELECT * FROM matched")
def j13_rule_matches(spark, sf_dir):
    items = products(spark, sf_dir)
    return rule_matches(items, sample_patterns(items))


@query(
    "a17_no_concept_reason",
    f"WITH {MATCHED}, n AS (SELECT p.name, count(m.concept) AS n FROM (SELECT DISTINCT name FROM products) p LEFT JOIN matched m USING (name) GROUP BY p.name) SELECT CASE n WHEN 0 THEN 'no-match' WHEN 1 THEN 'resolved' ELSE 'tie' END AS reason, count(*) AS n_names FROM n GROUP BY ALL",
)
def a17_no_concept_reason(spark, sf_dir):
    items = products(spark, sf_dir)
    n = items.select("name").distinct().join(rule_matches(items, sample_patterns(items)), "name", "left").groupBy("name").agg(F.count("concept").alias("n"))
    return n.groupBy(F.when(F.col("n") == 0, "no-match").when(F.col("n") == 1, "resolved").otherwise("tie").alias("reason")).agg(F.count("*").alias("n_names"))


@query(
    "a47_exclusion_cost",
    f"WITH {PATTERNS} SELECT concept, pattern, count(n.name) AS n_refused FROM patterns LEFT JOIN (SELECT DISTINCT name FROM products) n ON regexp_matches(n.name, pattern) AND starts_with(n.name, replace(concept, '!', '')) WHERE kind = 'none' GROUP BY ALL",
)
def a47_exclusion_cost(spark, sf_dir):
    """How many names of a class each of its exclusions refuses; idle ones count 0."""
    items = products(spark, sf_dir)
    none = sample_patterns(items).filter("kind = 'none'")
    names = items.select("name", F.concat("head", F.lit("!")).alias("concept")).distinct()
    return none.join(names, "concept", "left").groupBy("concept", "pattern").agg(F.count_if(F.expr("name rlike pattern")).alias("n_refused"))


def first_rule(rows: DataFrame, rules: DataFrame, value: str) -> DataFrame:
    """rows(..., value), rules(place, prefix, department, ignored): the first rule by place whose prefix begins the value.

    Rules are few and of bounded length: they become one chained expression, so that no row is joined with every rule.
    """
    chosen = F.lit(None).cast("string")
    for r in sorted(rules.collect(), key=lambda r: -r.place):
        chosen = F.when(F.col(value).startswith(r.prefix), F.lit(None if r.ignored else r.department).cast("string")).otherwise(chosen)
    return rows.withColumn("department", chosen)


@query(
    "j14_prefix_rules",
    f"""WITH {PRODUCTS} SELECT CASE WHEN starts_with(name, 'small b') THEN 'workshop' WHEN starts_with(name, 'small') THEN NULL WHEN starts_with(name, 'red') THEN 'paint' WHEN starts_with(name, 'r') THEN 'other r' END AS department, count(*) AS n FROM products GROUP BY ALL""",
)
def j14_prefix_rules(spark, sf_dir):
    rules = spark.createDataFrame([(1, "small b", "workshop", False), (2, "small", None, True), (3, "red", "paint", False), (4, "r", "other r", False)], "place int, prefix string, department string, ignored boolean")
    return first_rule(products(spark, sf_dir).select("name"), rules, "name").groupBy("department").agg(F.count("*").alias("n"))


@query(
    "p19_department_contradiction",
    f"""WITH {PRODUCTS}, g(department, word) AS (VALUES ('SMALL', 'widget'), ('ECONOMY', 'ring'), ('LARGE', 'small'), ('PROMO', 'gizmo'))
SELECT gtin, p.department, word FROM products p JOIN g ON g.department = p.department AND list_contains(string_split(name, ' '), word)""",
)
def p19_department_contradiction(spark, sf_dir):
    """Names that hold a guard word of their department."""
    guards = spark.createDataFrame([("SMALL", "widget"), ("ECONOMY", "ring"), ("LARGE", "small"), ("PROMO", "gizmo")], "department string, word string")
    words = products(spark, sf_dir).select("gtin", "department", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    return words.join(guards, ["department", "word"]).select("gtin", "department", "word")


@query("f32_head_words", f"WITH {PRODUCTS} SELECT head, count(*) AS n, count(DISTINCT department) AS n_departments FROM products GROUP BY head")
def f32_head_words(spark, sf_dir):
    p = products(spark, sf_dir).withColumn("word", head_word(text_key(F.col("name"))))
    return p.groupBy(F.col("word").alias("head")).agg(F.count("*").alias("n"), F.count_distinct("department").alias("n_departments"))


@query(
    "a45_unknown_words",
    f"""WITH {PRODUCTS}, {OFFERS}, s AS (SELECT gtin, count(*) AS n_chains FROM offers GROUP BY gtin)
SELECT family AS word, count(*) AS n_products, max(n_chains) AS most_chains, round(count(*) FILTER (brand = 'Brand#1') / count(*)::DOUBLE, 6) AS brand_share FROM products JOIN s USING (gtin) WHERE family NOT IN (SELECT head FROM products) GROUP BY family HAVING count(*) >= 20 AND max(n_chains) >= 6""",
)
def a45_unknown_words(spark, sf_dir):
    """Last words of twenty products or more, sold by six chains or more, that no product begins with."""
    p = products(spark, sf_dir)
    sellers = offers(spark, sf_dir).groupBy("gtin").agg(F.count("*").alias("n_chains"))
    rows = p.join(sellers, "gtin").join(p.select(F.col("head").alias("known")).distinct(), F.col("family") == F.col("known"), "left_anti")
    out = rows.groupBy(F.col("family").alias("word")).agg(
        F.count("*").alias("n_products"), F.max("n_chains").alias("most_chains"), F.round(F.count_if(F.col("brand") == "Brand#1") / F.count("*"), 6).alias("brand_share")
    )
    return out.filter("n_products >= 20 AND most_chains >= 6")


@query(
    "j09_filled_store",
    f"""WITH r AS (SELECT l_suppkey AS store, l_partkey AS code, min(l_extendedprice) AS price FROM lineitem GROUP BY ALL), a AS (SELECT * FROM r WHERE store % 2 = 0), b AS (SELECT * FROM r WHERE store % 2 = 1)
SELECT store, code, price, store AS source_store FROM a UNION ALL SELECT store - 1, code, price, store FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.store = b.store - 1 AND a.code = b.code)""",
)
def j09_filled_store(spark, sf_dir):
    """A store's rows, and those of its second store for codes that it lacks, with the store they come from."""
    r = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("store"), F.col("l_partkey").alias("code")).agg(F.min("l_extendedprice").alias("price"))
    first = r.filter("store % 2 = 0").withColumn("source_store", F.col("store"))
    second = r.filter("store % 2 = 1").withColumn("source_store", F.col("store")).withColumn("store", F.col("store") - 1)
    return first.unionByName(second.join(first.select("store", "code"), ["store", "code"], "left_anti"))


@query(
    "j10_alias_rewrite",
    f"""WITH {OFFERS}, a AS (SELECT DISTINCT gtin AS alias, gtin - 1 AS canonical FROM offers WHERE gtin % 10 = 1)
SELECT o.chain, coalesce(a.canonical, o.gtin) AS gtin, o.price_c FROM offers o LEFT JOIN a ON a.alias = o.gtin WHERE a.alias IS NULL OR NOT EXISTS (SELECT 1 FROM offers x WHERE x.chain = o.chain AND x.gtin = a.canonical)""",
)
def j10_alias_rewrite(spark, sf_dir):
    """Alias codes become their canonical one; a chain that lists both loses the alias row."""
    o = offers(spark, sf_dir).select("chain", "gtin", "price_c")
    alias = o.filter("gtin % 10 = 1").withColumn("canonical", F.col("gtin") - 1)
    kept = alias.join(o.select("chain", F.col("gtin").alias("canonical")), ["chain", "canonical"], "left_anti")
    return o.filter("gtin % 10 <> 1").unionByName(kept.select("chain", F.col("canonical").alias("gtin"), "price_c"))


@query(
    "j21_inherited_field",
    f"""WITH {PRODUCTS}, f AS (SELECT gtin - gtin % 4 AS canonical, CASE WHEN size % 3 = 0 THEN brand END AS value FROM products)
SELECT canonical, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS conflict FROM f GROUP BY canonical""",
)
def j21_inherited_field(spark, sf_dir):
    """A canonical code takes the one value that its aliases decided; several are a conflict without a winner."""
    f = products(spark, sf_dir).select((F.col("gtin") - F.col("gtin") % 4).alias("canonical"), F.when(F.col("size") % 3 == 0, F.col("brand")).alias("value"))
    n = F.count_distinct("value")
    return f.groupBy("canonical").agg(F.when(n == 1, F.min("value")).alias("value"), (n > 1).alias("conflict"))


@query(
    "j22_serving_branch",
    f"""WITH {STORES}, b AS (SELECT chain, city, min(((store % 7) * 100, store)) AS x FROM stores WHERE served GROUP BY ALL), d AS (SELECT chain, min(((store % 7) * 100, store)) AS y FROM stores WHERE served GROUP BY chain)
SELECT c_custkey AS customer, ch.chain, coalesce(x, y)[2] AS store, coalesce(x, y)[1]::INT AS fee_c, x IS NOT NULL AS in_city
FROM customer JOIN nation ON c_nationkey = n_nationkey CROSS JOIN d ch LEFT JOIN b ON b.chain = ch.chain AND b.city = n_name""",
)
def j22_serving_branch(spark, sf_dir):
    """For each customer and chain the branch of the customer's city with the lowest fee, else the chain's cheapest one."""
    s = stores(spark, sf_dir).filter("served").select("chain", "city", F.struct(((F.col("store") % 7) * 100).alias("fee_c"), "store").alias("x"))
    city = s.groupBy("chain", "city").agg(F.min("x").alias("x"))
    default = s.groupBy("chain").agg(F.min("x").alias("y"))
    people = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer"), F.col("n_name").alias("city"))
    grid = people.crossJoin(F.broadcast(default))  # a row for each of the few chains
    out = grid.join(city, ["chain", "city"], "left")
    best = F.coalesce("x", "y")
    return out.select("customer", "chain", best["store"].alias("store"), best["fee_c"].cast("int").alias("fee_c"), F.col("x").isNotNull().alias("in_city"))


def derived_rule(text: Column) -> Column:
    """A promotion rule from its description: `3 for 25`, `2+1`, `second 50%`, `30% off`, else none. Money in cents."""
    many = lambda p, i: F.nullif(F.regexp_extract(text, p, i), F.lit("")).cast("long")
    bundle, free, second, off = r"(\d+) for (\d+)", r"(\d+)\+(\d+)", r"second (\d+)%", r"(\d+)% off"
    make = lambda kind, a, b: F.struct(F.lit(kind).alias("type"), a.alias("min_qty"), b.alias("value"))
    one = F.lit(1).cast("long")
    return (
        F.when(text.rlike(bundle), make("multi", many(bundle, 1), many(bundle, 2) * 100)).when(text.rlike(free), make("bundleFree", many(free, 1), many(free, 2)))
        .when(text.rlike(second), make("second", F.lit(2).cast("long"), many(second, 1))).when(text.rlike(off), make("percent", one, many(off, 1)))
    )


@query(
    "f12_derived_rules",
    r"""WITH t AS (SELECT (l_discount * 100)::INT AS pct, l_linenumber AS n FROM lineitem), d AS (SELECT CASE n % 5 WHEN 0 THEN n || ' for ' || pct WHEN 1 THEN n || '+' || pct WHEN 2 THEN 'second ' || pct || '%' WHEN 3 THEN pct || '% off' ELSE 'new!' END AS text FROM t)
SELECT CASE WHEN regexp_matches(text, '(\d+) for (\d+)') THEN 'multi' WHEN regexp_matches(text, '(\d+)\+(\d+)') THEN 'bundleFree' WHEN regexp_matches(text, 'second (\d+)%') THEN 'second' WHEN regexp_matches(text, '(\d+)% off') THEN 'percent' END AS type,
 CASE WHEN text LIKE '% for %' THEN regexp_extract(text, '(\d+) for', 1)::BIGINT WHEN text LIKE '%+%' THEN regexp_extract(text, '(\d+)\+', 1)::BIGINT WHEN text LIKE 'second%' THEN 2 WHEN text LIKE '%off' THEN 1 END AS min_qty, count(*) AS n FROM d GROUP BY ALL""",
)
def f12_derived_rules(spark, sf_dir):
    pct, n = F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.col("l_linenumber")
    text = F.when(n % 5 == 0, F.concat(n.cast("string"), F.lit(" for "), pct)).when(n % 5 == 1, F.concat(n.cast("string"), F.lit("+"), pct)).when(n % 5 == 2, F.concat(F.lit("second "), pct, F.lit("%"))).when(n % 5 == 3, F.concat(pct, F.lit("% off"))).otherwise("new!")
    rows = table(spark, sf_dir, "lineitem").select(text.alias("text")).groupBy("text").agg(F.count("*").alias("n"))  # rules are derived once a text
    r = rows.select(derived_rule(F.col("text")).alias("r"), "n")
    return r.groupBy("r.type", "r.min_qty").agg(F.sum("n").alias("n"))


@query(
    "a33_own_brand_prefixes",
    f"""WITH {OFFERS}, p AS (SELECT gtin // 100 AS prefix, chain, count(*) AS n FROM offers WHERE pct >= 9 GROUP BY ALL), t AS (SELECT prefix, sum(n) AS total FROM p GROUP BY prefix)
SELECT chain, prefix, n, (n * 100 // total)::BIGINT AS share FROM p JOIN t USING (prefix) QUALIFY row_number() OVER (PARTITION BY chain ORDER BY n DESC, prefix) <= 5""",
)
def a33_own_brand_prefixes(spark, sf_dir):
    """Each chain's five most frequent code prefixes among its marked goods, and its share of the prefix."""
    p = offers(spark, sf_dir).filter("pct >= 9").groupBy(F.floor(F.col("gtin") / 100).alias("prefix"), "chain").agg(F.count("*").alias("n"))
    t = p.groupBy("prefix").agg(F.sum("n").alias("total"))
    w = Window.partitionBy("chain").orderBy(F.col("n").desc(), "prefix")
    out = p.join(t, "prefix").withColumn("rn", F.row_number().over(w)).filter("rn <= 5")
    return out.select("chain", "prefix", "n", F.expr("n * 100 div total").alias("share"))


@query(
    "o06_seeded_sample",
    f"WITH {PRODUCTS} SELECT gtin, md5(gtin::VARCHAR) AS draw FROM products ORDER BY draw, gtin LIMIT 100",
)
def o06_seeded_sample(spark, sf_dir):
    """A hundred products, the same at every run: those with the smallest digests."""
    return products(spark, sf_dir).select("gtin", F.md5(F.col("gtin").cast("string")).alias("draw")).orderBy("draw", "gtin").limit(100)


@query(
    "a65_same_brand",
    f"""WITH {PRODUCTS} SELECT name, count(*) AS n, count(DISTINCT lower(replace(brand, '#', ''))) AS n_brands FROM products GROUP BY name""",
)
def a65_same_brand(spark, sf_dir):
    brand = F.lower(F.regexp_replace("brand", "[^A-Za-z0-9]", ""))
    return products(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"), F.count_distinct(brand).alias("n_brands"))
