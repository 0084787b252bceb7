"""Audits of names, labels and rules, and identity of products: counts, clusters, pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import group_id, similarity
from ..registry import query
from ..sources.market import OFFERS, PRICE_ROWS, PRODUCTS, offers, price_rows, products, table
from ..sources.scratch import written
from .ranges import best_in_range


@query(
    "a32_promo_coverage",
    f"""WITH {PRICE_ROWS}, r AS (SELECT CASE WHEN NOT in_stock AND pct = 0 THEN 'inactive' WHEN pct = 0 THEN 'unparsed' WHEN day < DATE '1996-01-01' THEN 'expired' WHEN day > DATE '2001-01-01' THEN 'future' ELSE 'kept' END AS reason, pct FROM price_rows)
SELECT reason, count(*) AS n, count(*) FILTER (pct BETWEEN 1 AND 4) AS percent, count(*) FILTER (pct BETWEEN 5 AND 7) AS multi, count(*) FILTER (pct >= 8) AS unit FROM r GROUP BY reason""",
)
def a32_promo_coverage(spark, sf_dir):
    """Promotions by the first reason to skip them, and by the rule they hold."""
    reason = (
        F.when(~F.col("in_stock") & (F.col("pct") == 0), "inactive").when(F.col("pct") == 0, "unparsed")
        .when(F.col("day") < "1996-01-01", "expired").when(F.col("day") > "2001-01-01", "future").otherwise("kept")
    )
    rows = price_rows(spark, sf_dir).select(reason.alias("reason"), "pct")
    return rows.groupBy("reason").agg(
        F.count("*").alias("n"), F.count_if(F.col("pct").between(1, 4)).alias("percent"), F.count_if(F.col("pct").between(5, 7)).alias("multi"), F.count_if(F.col("pct") >= 8).alias("unit")
    )


@query(
    "a34_consensus",
    f"""WITH {PRICE_ROWS}, v AS (SELECT gtin, pct, count(DISTINCT chain) AS n FROM price_rows WHERE pct > 0 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY gtin ORDER BY n DESC, pct) AS rn, lead(n) OVER (PARTITION BY gtin ORDER BY n DESC, pct) AS second FROM v)
SELECT gtin, pct, n, CASE WHEN n >= 3 AND n > coalesce(second, 0) THEN 'agree3' WHEN n = 2 AND second IS NULL THEN 'agree2' WHEN n = second THEN 'disagree' WHEN second IS NULL THEN 'one vote' ELSE 'mixed' END AS verdict FROM r WHERE rn = 1""",
)
def a34_consensus(spark, sf_dir):
    votes = price_rows(spark, sf_dir).filter("pct > 0").groupBy("gtin", "pct").agg(F.count_distinct("chain").alias("n"))
    w = Window.partitionBy("gtin").orderBy(F.col("n").desc(), "pct")
    r = votes.withColumns({"rn": F.row_number().over(w), "second": F.lead("n").over(w)}).filter("rn = 1")
    n, second = F.col("n"), F.col("second")
    verdict = (
        F.when((n >= 3) & (n > F.coalesce(second, F.lit(0))), "agree3").when((n == 2) & second.isNull(), "agree2")
        .when(n == second, "disagree").when(second.isNull(), "one vote").otherwise("mixed")
    )
    return r.select("gtin", "pct", "n", verdict.alias("verdict"))


@query(
    "a35_brand_lexicon",
    f"""WITH {PRODUCTS} SELECT brand, word, count(*) AS n_codes, count(DISTINCT department) AS n_departments FROM (SELECT brand, department, unnest(string_split(name, ' ')) AS word FROM products) GROUP BY ALL HAVING count(*) >= 3""",
)
def a35_brand_lexicon(spark, sf_dir):
    words = products(spark, sf_dir).select("brand", "department", F.explode(F.split("name", " ")).alias("word"))
    return words.groupBy("brand", "word").agg(F.count("*").alias("n_codes"), F.count_distinct("department").alias("n_departments")).filter("n_codes >= 3")


@query(
    "a38_attribute_consensus",
    f"""WITH {PRICE_ROWS}, c AS (SELECT gtin, pct, count(*) AS n FROM price_rows GROUP BY ALL),
r AS (SELECT *, row_number() OVER w AS rn, lead(n) OVER w AS second, count(*) OVER (PARTITION BY gtin) AS n_values FROM c WINDOW w AS (PARTITION BY gtin ORDER BY n DESC, pct))
SELECT gtin, CASE WHEN n_values = 1 OR (n >= 2 AND n >= 2 * second) THEN pct END AS value, n_values > 1 AND NOT (n >= 2 AND n >= 2 * second) AS conflict FROM r WHERE rn = 1""",
)
def a38_attribute_consensus(spark, sf_dir):
    """The one value, or that of two votes and twice the runner-up; else a conflict."""
    counts = price_rows(spark, sf_dir).groupBy("gtin", "pct").agg(F.count("*").alias("n"))
    w = Window.partitionBy("gtin").orderBy(F.col("n").desc(), "pct")
    r = counts.withColumns({"rn": F.row_number().over(w), "second": F.lead("n").over(w), "n_values": F.count("*").over(Window.partitionBy("gtin"))}).filter("rn = 1")
    clear = (F.col("n") >= 2) & (F.col("n") >= 2 * F.col("second"))
    return r.select("gtin", F.when((F.col("n_values") == 1) | clear, F.col("pct")).alias("value"), ((F.col("n_values") > 1) & ~clear).alias("conflict"))


@query("a39_set_union", f"WITH {PRICE_ROWS} SELECT gtin, string_agg(DISTINCT pct::VARCHAR, ',' ORDER BY pct::VARCHAR) AS vals FROM price_rows GROUP BY gtin")
def a39_set_union(spark, sf_dir):
    rows = price_rows(spark, sf_dir).select("gtin", F.col("pct").cast("string").alias("pct"))
    return rows.groupBy("gtin").agg(F.array_join(F.array_sort(F.collect_set("pct")), ",").alias("vals"))


WORDS = r"""words AS (SELECT doc_id, source, lang, unnest(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: len(x) >= 3))) AS word FROM documents)"""


def doc_words(spark, sf_dir: str) -> DataFrame:
    """doc_id, source, lang, word: the distinct words of three letters or more."""
    words = F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda x: F.length(x) >= 3))
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", F.explode(words).alias("word"))


@query(
    "a42_kind_tokens",
    f"""WITH {WORDS}, t AS (SELECT lang, count(*) AS total FROM documents GROUP BY lang), c AS (SELECT lang, word, count(*) AS n FROM words GROUP BY ALL)
SELECT lang, word, n FROM c JOIN t USING (lang) WHERE n >= 3 AND n * 10 <= total * 6 QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= 15""",
)
def a42_kind_tokens(spark, sf_dir):
    """Per class the fifteen most frequent words that three to 60 % of its members have."""
    words = doc_words(spark, sf_dir)
    total = table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("total"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n")).join(total, "lang").filter("n >= 3 AND n * 10 <= total * 6")
    w = Window.partitionBy("lang").orderBy(F.col("n").desc(), "word")
    return counts.withColumn("rn", F.row_number().over(w)).filter("rn <= 15").select("lang", "word", "n")


@query(
    "a43_cooccurrence",
    f"""WITH {PRODUCTS}, t AS (SELECT gtin, unnest([head, family, department, brand]) AS tok FROM products)
SELECT a.tok AS a, b.tok AS b, count(*) AS n FROM t a JOIN t b ON a.gtin = b.gtin AND a.tok < b.tok GROUP BY ALL""",
)
def a43_cooccurrence(spark, sf_dir):
    """How often two tokens stand on one product. The pairs come from the product's few tokens, in its row: no self join."""
    toks = F.array_sort(F.array("head", "family", "department", "brand"))
    pairs = F.flatten(F.transform(toks, lambda x: F.transform(F.filter(toks, lambda y: x < y), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    return products(spark, sf_dir).select(F.inline(pairs)).groupBy("a", "b").agg(F.count("*").alias("n"))


@query(
    "a44_head_clusters",
    f"""WITH {PRODUCTS}, {OFFERS}, s AS (SELECT gtin, count(*) AS n_chains FROM offers GROUP BY gtin)
SELECT department, head, count(*) AS n_products, max(coalesce(n_chains, 0)) AS most_chains, count(DISTINCT family) AS n_second FROM products LEFT JOIN s USING (gtin) GROUP BY ALL HAVING count(*) >= 3 OR max(coalesce(n_chains, 0)) >= 2""",
)
def a44_head_clusters(spark, sf_dir):
    sellers = offers(spark, sf_dir).groupBy("gtin").agg(F.count("*").alias("n_chains"))
    rows = products(spark, sf_dir).join(sellers, "gtin", "left").withColumn("n_chains", F.coalesce("n_chains", F.lit(0)))
    out = rows.groupBy("department", "head").agg(F.count("*").alias("n_products"), F.max("n_chains").alias("most_chains"), F.count_distinct("family").alias("n_second"))
    return out.filter("n_products >= 3 OR most_chains >= 2")


@query(
    "a46_dead_rules",
    f"""WITH {PRODUCTS}, rules AS (SELECT DISTINCT head || ' ' || department AS concept, head AS wants, brand AS refuses FROM products WHERE size % 10 = 1)
SELECT concept, wants, refuses, count(*) FILTER (p.brand IS NOT NULL) AS n_wanted, count(*) FILTER (p.brand = refuses) AS n_refused FROM rules LEFT JOIN products p ON p.head = wants AND concept = p.head || ' ' || p.department GROUP BY ALL""",
)
def a46_dead_rules(spark, sf_dir):
    """For each rule (a word wanted, a brand refused) how many products it reaches and how many it turns down: an equi join on the literal."""
    items = products(spark, sf_dir)
    rules = items.filter("size % 10 = 1").select(F.concat_ws(" ", "head", "department").alias("concept"), F.col("head").alias("wants"), F.col("brand").alias("refuses")).distinct()
    reach = items.groupBy("head", "department", "brand").agg(F.count("*").alias("n")).select(F.concat_ws(" ", "head", "department").alias("concept"), "brand", "n")
    return rules.join(reach, "concept", "left").groupBy("concept", "wants", "refuses").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_wanted"), F.coalesce(F.sum(F.when(F.col("brand") == F.col("refuses"), F.col("n"))), F.lit(0)).alias("n_refused")
    )


@query(
    "a50_label_consistency",
    """WITH c AS (SELECT source, quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL)
SELECT source, quality, n, rank() OVER (PARTITION BY source ORDER BY n DESC) AS place, sum(n) OVER (PARTITION BY source)::BIGINT AS total FROM c""",
)
def a50_label_consistency(spark, sf_dir):
    """How the labels of a class divide: majority and minority."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    counts = rows.groupBy("source", "quality").agg(F.count("*").alias("n"))
    by = Window.partitionBy("source")
    return counts.withColumns({"place": F.rank().over(by.orderBy(F.col("n").desc())), "total": F.sum("n").over(by)})


@query("a51_label_drift", "SELECT lang, quality, toxic, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY ALL")
def a51_label_drift(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"))


@query(
    "a53_class_coverage",
    "SELECT source, count(*) AS total, count(l.doc_id) AS labelled, count(*) FILTER (quality = 0) AS low, count(*) FILTER (toxic = 1) AS toxic FROM documents LEFT JOIN labels l USING (doc_id) GROUP BY source",
)
def a53_class_coverage(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").withColumn("has", F.lit(True))
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source").agg(F.count("*").alias("total"), F.count("has").alias("labelled"), F.count_if(F.col("quality") == 0).alias("low"), F.count_if(F.col("toxic") == 1).alias("toxic"))


IDENTITY = f"""{OFFERS}, {PRODUCTS}, members AS (SELECT gtin, name || '|' || size || '|' || brand AS key, department, min(price_c) AS price_c, count(*) AS n_chains FROM offers JOIN products USING (gtin) GROUP BY gtin, key, department)"""


def identity_members(spark, sf_dir: str) -> DataFrame:
    """gtin, key (name, size and brand), department, price_c, n_chains."""
    sold = offers(spark, sf_dir).groupBy("gtin").agg(F.min("price_c").alias("price_c"), F.count("*").alias("n_chains"))
    return sold.join(products(spark, sf_dir), "gtin").select("gtin", F.concat_ws("|", "name", "size", "brand").alias("key"), "department", "price_c", "n_chains")


@query(
    "g08_pair_conditions",
    f"""WITH {IDENTITY} SELECT a.gtin AS a, b.gtin AS b, CASE WHEN a.department <> b.department THEN 'attrs' WHEN greatest(a.price_c, b.price_c) > 3 * least(a.price_c, b.price_c) THEN 'price' WHEN a.n_chains + b.n_chains < 4 THEN 'chains' ELSE 'ok' END AS verdict
FROM members a JOIN members b ON a.key = b.key AND a.gtin < b.gtin""",
)
def g08_pair_conditions(spark, sf_dir):
    """Pairs of codes with one identity key (few codes share one) and the first condition that parts them."""
    return pair_verdicts(identity_members(spark, sf_dir))


def pair_verdicts(members: DataFrame) -> DataFrame:
    a, b = members.alias("a"), members.alias("b")
    pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.gtin") < F.col("b.gtin")))
    verdict = (
        F.when(F.col("a.department") != F.col("b.department"), "attrs")
        .when(F.greatest("a.price_c", "b.price_c") > 3 * F.least("a.price_c", "b.price_c"), "price")
        .when(F.col("a.n_chains") + F.col("b.n_chains") < 4, "chains").otherwise("ok")
    )
    return pairs.select(F.col("a.gtin").alias("a"), F.col("b.gtin").alias("b"), verdict.alias("verdict"))


@query(
    "g09_cliques",
    f"""WITH {IDENTITY}, s AS (SELECT key, count(*) AS n, min(gtin) AS canonical, count(DISTINCT department) = 1 AND max(price_c) <= 3 * min(price_c) AND min(n_chains) + min(n_chains) >= 4 AS maybe FROM members GROUP BY key),
p AS (SELECT a.key, bool_and(a.department = b.department AND greatest(a.price_c, b.price_c) <= 3 * least(a.price_c, b.price_c) AND a.n_chains + b.n_chains >= 4) AS ok FROM members a JOIN members b ON a.key = b.key AND a.gtin < b.gtin GROUP BY a.key)
SELECT key, n, canonical, CASE WHEN ok THEN 'merge' ELSE 'queue' END AS verdict FROM s JOIN p USING (key)""",
)
def g09_cliques(spark, sf_dir):
    """Clusters merge only when every pair passes. No pair is needed for that: extremes of the cluster decide."""
    two_least = F.slice(F.array_sort(F.collect_list("n_chains")), 1, 2)
    s = identity_members(spark, sf_dir).groupBy("key").agg(
        F.count("*").alias("n"), F.min("gtin").alias("canonical"), F.count_distinct("department").alias("n_dep"), F.max("price_c").alias("hi"), F.min("price_c").alias("lo"), two_least.alias("few")
    )
    ok = (F.col("n_dep") == 1) & (F.col("hi") <= 3 * F.col("lo")) & (F.aggregate("few", F.lit(0).cast("long"), lambda a, x: a + x) >= 4)
    return s.filter("n > 1").select("key", "n", "canonical", F.when(ok, "merge").otherwise("queue").alias("verdict"))


@query(
    "f38_group_ids",
    f"WITH {PRODUCTS} SELECT name, size, substring(sha1(string_agg(gtin::VARCHAR, ',' ORDER BY gtin::VARCHAR)), 1, 12) AS group_id, count(*) AS n FROM products GROUP BY name, size",
)
def f38_group_ids(spark, sf_dir):
    members = F.collect_list(F.col("gtin").cast("string"))
    return products(spark, sf_dir).groupBy("name", "size").agg(group_id(members).alias("group_id"), F.count("*").alias("n"))


@query(
    "j04_fuzzy_names",
    f"""WITH {PRODUCTS}, n AS (SELECT DISTINCT name, string_split(name, ' ') AS ws FROM products),
s AS (SELECT a.name, b.name AS other, len(list_intersect(a.ws, b.ws)) AS n_both, len(list_distinct(a.ws || b.ws)) AS either, least(len(a.ws), len(b.ws)) AS fewer,
  1.0::DOUBLE - levenshtein(a.name, b.name)::DOUBLE / greatest(len(a.name), len(b.name)) AS chars FROM n a JOIN n b ON a.name <> b.name AND len(list_intersect(a.ws, b.ws)) > 0),
r AS (SELECT name, other, round(0.5::DOUBLE * n_both / either + 0.25::DOUBLE * n_both / fewer + 0.25::DOUBLE * chars, 6) AS score FROM s)
SELECT name, other, score, row_number() OVER (PARTITION BY name ORDER BY score DESC, other) AS place FROM r WHERE score >= 0.4 QUALIFY place <= 3""",
)
def j04_fuzzy_names(spark, sf_dir):
    """For each name the most similar other names of 0.4 or more, among those that share a word with it: blocked by word."""
    names = products(spark, sf_dir).groupBy("name").agg(F.count("*").alias("n"))
    words = names.select("name", F.explode(F.split("name", " ")).alias("word"))
    pairs = words.alias("a").join(words.alias("b"), (F.col("a.word") == F.col("b.word")) & (F.col("a.name") != F.col("b.name")))
    pairs = pairs.select(F.col("a.name").alias("name"), F.col("b.name").alias("other")).distinct()
    scored = pairs.withColumn("score", F.round(similarity(F.col("name"), F.col("other")), 6)).filter("score >= 0.4")
    w = Window.partitionBy("name").orderBy(F.col("score").desc(), "other")
    return scored.withColumn("place", F.row_number().over(w)).filter("place <= 3")


@query(
    "w14_second_class",
    f"""WITH {PRODUCTS}, c AS (SELECT family, department, count(*) AS n FROM products GROUP BY ALL)
SELECT family, department, n, rank() OVER (PARTITION BY family ORDER BY n DESC) AS place FROM c""",
)
def w14_second_class(spark, sf_dir):
    c = products(spark, sf_dir).groupBy("family", "department").agg(F.count("*").alias("n"))
    return c.withColumn("place", F.rank().over(Window.partitionBy("family").orderBy(F.col("n").desc())))


def substitutes(wanted: DataFrame, sold: DataFrame, most: int = 5) -> DataFrame:
    """wanted(chain, gtin, concept, size, base_c), sold(chain, gtin, concept, size, price_c, department, n) -> the cheapest few compatible products.

    Compatible: the same concept and chain, another product, size within a quarter, price within three times. Ranked by
    size distance, price, code.
    """
    group = ["chain", "concept"]
    first = lambda df, by, n, *order: df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("place") <= n)
    offered = sold.select(*group, "size", "price_c", F.struct("price_c", F.col("gtin").alias("item")).alias("x"), F.lit(1).alias("n"))
    offered = first(offered, [*group, "size", "price_c"], most + 1, "x")
    size, base = F.col("size"), F.col("base_c")
    ends = {"size_from": F.ceil(size * 3 / F.lit(4)), "size_to": F.floor(size * 4 / F.lit(3)), "low": F.ceil(base / F.lit(3)), "past": base * 3 + 1}
    asks = wanted.select(*group, F.struct("chain", "gtin").alias("id"), size.alias("base_size"), *[v.cast("long").alias(c) for c, v in ends.items()])
    # One more than wanted, for the product itself may be sold.
    found = best_in_range(offered, asks, group, most + 1, lambda size, base: abs(size - base)).filter("x.item <> id.gtin")
    found = first(found, ["id"], most, F.abs(size - F.col("base_size")), "x")
    return found.select("id.chain", "id.gtin", "x.item", "x.price_c", "place")


@query(
    "c03_substitutes",
    f"""WITH {OFFERS}, {PRODUCTS}, sold AS (SELECT o.chain, gtin, name AS concept, size, price_c FROM offers o JOIN products USING (gtin) WHERE in_stock),
wanted AS (SELECT o.chain, gtin, name AS concept, size, price_c AS base_c FROM offers o JOIN products USING (gtin) WHERE NOT in_stock)
SELECT w.chain, w.gtin, s.gtin AS item, s.price_c, row_number() OVER (PARTITION BY w.chain, w.gtin ORDER BY abs(s.size - w.size), s.price_c, s.gtin) AS place
FROM wanted w JOIN sold s ON s.chain = w.chain AND s.concept = w.concept AND s.gtin <> w.gtin AND s.size * 4 >= w.size * 3 AND s.size * 3 <= w.size * 4 AND s.price_c <= 3 * base_c AND s.price_c * 3 >= base_c
QUALIFY place <= 5""",
)
def c03_substitutes(spark, sf_dir):
    rows = written(offers(spark, sf_dir).join(products(spark, sf_dir), "gtin").select("chain", "gtin", F.col("name").alias("concept"), "size", "price_c", "in_stock"))
    wanted = rows.filter(~F.col("in_stock")).select("chain", "gtin", "concept", "size", F.col("price_c").alias("base_c"))
    return substitutes(wanted, rows.filter("in_stock"))
