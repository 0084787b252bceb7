"""Weighted votes, cluster verdicts, rule impact and the queues that follow from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from ..sources.market import OFFERS, PRICE_ROWS, PRODUCTS, STORES, offers, price_rows, products, stores, table
from .joins import STOCKED, all_pairs, first_reason, stocked


def weighted_vote(votes: DataFrame, key: str, value: str, weight: Column) -> DataFrame:
    """votes(key, value) -> key, value, weight, share: the value with most weight, the smaller value of equal ones. Votes are added up before they are ranked."""
    sums = votes.groupBy(key, value).agg(F.sum(weight).alias("weight"))
    best = sums.groupBy(key).agg(F.min(F.struct((-F.col("weight")).alias("w"), F.col(value).alias("v"))).alias("x"), F.sum("weight").alias("all"))
    return best.select(key, F.col("x.v").alias(value), (-F.col("x.w")).alias("weight"), F.expr("(-x.w) * 10000 div all").alias("share"))


@query(
    "a09_weighted_vote",
    f"""WITH {PRICE_ROWS}, s AS (SELECT gtin, pct, sum(CASE WHEN in_stock THEN 5 ELSE 1 END) AS weight FROM price_rows GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gtin ORDER BY weight DESC, pct) AS rn, sum(weight) OVER (PARTITION BY gtin) AS total FROM s)
SELECT gtin, pct, weight::BIGINT AS weight, (weight * 10000 // total)::BIGINT AS share FROM r WHERE rn = 1""",
)
def a09_weighted_vote(spark, sf_dir):
    """Marked votes weigh five times the others."""
    return weighted_vote(price_rows(spark, sf_dir), "gtin", "pct", F.when(F.col("in_stock"), 5).otherwise(1))


def cluster_vote(votes: Column, tolerance: int = 5, near_tie: int = 15) -> Column:
    """votes: array of struct(value, weight) of one key, few -> the value of the heaviest cluster, null on a near tie.

    In order of value, a value joins the cluster whose first value it exceeds by ``tolerance`` percent at most. A second cluster
    within ``near_tie`` percent of the weight of all makes the vote abstain. The fold stays in the row: no Python.
    """
    sorted_ = F.array_sort(votes)
    empty = F.array().cast("array<struct<first:bigint,weight:bigint>>")
    def step(acc: Column, v: Column) -> Column:
        last = F.element_at(acc, -1)
        joins = (F.size(acc) > 0) & (v["value"] * 100 <= F.get(acc, F.size(acc) - 1)["first"] * (100 + tolerance))
        grown = F.struct(last["first"].alias("first"), (last["weight"] + v["weight"]).alias("weight"))
        new = F.struct(v["value"].cast("long").alias("first"), v["weight"].cast("long").alias("weight"))
        return F.when(joins, F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(grown))).otherwise(F.concat(acc, F.array(new)))

    def decide(acc: Column) -> Column:
        ranked = F.array_sort(F.transform(acc, lambda c: F.struct((-c["weight"]).alias("w"), c["first"].alias("first"))))
        total = F.aggregate(acc, F.lit(0).cast("long"), lambda t, c: t + c["weight"])
        second = F.coalesce(F.get(ranked, F.lit(1))["w"], F.lit(0).cast("long"))
        clear = (second - F.get(ranked, F.lit(0))["w"]) * 100 > near_tie * total
        return F.when(clear, F.get(ranked, F.lit(0))["first"])

    return F.aggregate(sorted_, empty, step, decide)


@query(
    "a10_cluster_vote",
    f"""WITH RECURSIVE {OFFERS}, v AS (SELECT gtin, price_c AS value, n AS weight, row_number() OVER (PARTITION BY gtin ORDER BY price_c, n) AS i FROM offers),
walk AS (SELECT gtin, i, value AS first, weight FROM v WHERE i = 1 UNION ALL SELECT v.gtin, v.i, CASE WHEN v.value * 100 <= w.first * 105 THEN w.first ELSE v.value END, v.weight FROM walk w JOIN v ON v.gtin = w.gtin AND v.i = w.i + 1),
c AS (SELECT gtin, first, sum(weight) AS weight, count(*) AS n FROM walk GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gtin ORDER BY weight DESC, first) AS place FROM c)
SELECT gtin, sum(n)::INT AS n_votes, CASE WHEN 100 * (max(weight) FILTER (place = 1) - coalesce(max(weight) FILTER (place = 2), 0)) > 15 * sum(weight) THEN max(first) FILTER (place = 1) END AS price_c FROM r GROUP BY gtin""",
)
def a10_cluster_vote(spark, sf_dir):
    """The price that most chains (weighed by their rows) agree on within 5 percent; a product has one vote a chain, 14 at most."""
    votes = offers(spark, sf_dir).groupBy("gtin").agg(F.collect_list(F.struct(F.col("price_c").alias("value"), F.col("n").alias("weight"))).alias("votes"))
    return votes.select("gtin", F.size("votes").alias("n_votes"), cluster_vote(F.col("votes")).alias("price_c"))


@query(
    "a15_card_folding",
    f"""WITH {STOCKED}, b AS (SELECT concept, floor(median(price_c))::BIGINT AS mid FROM stocked GROUP BY concept)
SELECT gtin, bool_and(price_c <= 4 * mid AND 4 * price_c >= mid) AND bool_and(head <> 'new') AS folds, count(*) AS n FROM stocked JOIN b USING (concept) GROUP BY gtin""",
)
def a15_card_folding(spark, sf_dir):
    """A product folds into its class's card if every row of it is in the band and admissible."""
    x = stocked(spark, sf_dir)
    mid = x.groupBy("concept").agg(F.floor(F.median("price_c")).alias("mid"))
    fits = (F.col("price_c") <= 4 * F.col("mid")) & (4 * F.col("price_c") >= F.col("mid")) & (F.col("head") != "new")
    return x.join(mid, "concept").groupBy("gtin").agg(F.bool_and(fits).alias("folds"), F.count("*").alias("n"))


@query("a18_unsized", f"WITH {PRODUCTS} SELECT name, count(*) AS n FROM products WHERE size % 10 = 0 AND name IN (SELECT name FROM products WHERE size % 10 <> 0) GROUP BY name")
def a18_unsized(spark, sf_dir):
    """Products without a size (here: sizes by ten) in classes that have sizes: one pass."""
    per = products(spark, sf_dir).groupBy("name").agg(F.count_if(F.col("size") % 10 == 0).alias("n"), F.count_if(F.col("size") % 10 != 0).alias("sized"))
    return per.filter("n > 0 AND sized > 0").select("name", "n")


@query(
    "a36_noun_screen",
    "WITH w AS (SELECT unnest(string_split(p_name, ' ')) AS word, p_brand FROM part), h AS (SELECT word, count(*) AS n_names, count(DISTINCT p_brand) AS n_brands FROM w GROUP BY word) SELECT word, n_names, n_brands, n_names >= 20 AND n_names >= 3 * n_brands AS noun FROM h",
)
def a36_noun_screen(spark, sf_dir):
    """Words of names that are nouns, no brands: frequent, and three times as often in names as brands use them."""
    w = products(spark, sf_dir).select(F.explode(F.split("name", " ")).alias("word"), "brand").groupBy("word", "brand").agg(F.count("*").alias("n"))
    h = w.groupBy("word").agg(F.sum("n").alias("n_names"), F.count("*").alias("n_brands"))
    return h.withColumn("noun", (F.col("n_names") >= 20) & (F.col("n_names") >= 3 * F.col("n_brands")))


@query(
    "a37_consumer_brand",
    f"""WITH {PRODUCTS}, t AS (SELECT name AS key, unnest(list_distinct([head, lower(department)])) AS token, gtin FROM products), n AS (SELECT name AS key, count(*) AS k FROM products GROUP BY 1), f AS (SELECT key, token FROM t JOIN n USING (key) GROUP BY key, token, k HAVING count(*) = k)
SELECT n.key, CASE count(f.token) WHEN 1 THEN min(f.token) END AS brand, CASE count(f.token) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'ambiguous' END AS outcome FROM n LEFT JOIN f USING (key) GROUP BY n.key""",
)
def a37_consumer_brand(spark, sf_dir):
    """The token that all of a group's names hold; none, or several, are no brand."""
    p = products(spark, sf_dir).select(F.col("name").alias("key"), F.array_distinct(F.array("head", F.lower("department"))).alias("tokens"))
    n = p.groupBy("key").agg(F.count("*").alias("k"))
    held = p.select("key", F.explode("tokens").alias("token")).groupBy("key", "token").agg(F.count("*").alias("m")).join(n, "key")
    x = held.groupBy("key").agg(F.count_if(F.col("m") == F.col("k")).alias("full"), F.min(F.when(F.col("m") == F.col("k"), F.col("token"))).alias("token"))
    return x.select("key", F.when(F.col("full") == 1, F.col("token")).alias("brand"), first_reason(("none", F.col("full") == 0), ("one", F.col("full") == 1), otherwise="ambiguous").alias("outcome"))


@query("a40_code_consensus", f"WITH {PRICE_ROWS}, c AS (SELECT DISTINCT gtin, chain % 3 AS kind, pct FROM price_rows WHERE pct > 0) SELECT gtin, kind::INT AS kind, CASE WHEN count(*) = 1 THEN min(pct) END AS value, count(*) > 1 AS conflict FROM c GROUP BY ALL")
def a40_code_consensus(spark, sf_dir):
    """Per code and kind the one value; several are a conflict."""
    c = price_rows(spark, sf_dir).filter("pct > 0").select("gtin", (F.col("chain") % 3).alias("kind"), "pct").distinct()
    return c.groupBy("gtin", "kind").agg(F.when(F.count("*") == 1, F.min("pct")).alias("value"), (F.count("*") > 1).alias("conflict"))


@query(
    "a49_near_marker",
    r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word, generate_subscripts(regexp_extract_all(lower(text), '[a-z]+'), 1) AS pos FROM documents),
m AS (SELECT doc_id, word, max(CASE WHEN word = 'the' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) IS NOT NULL AS near FROM w)
SELECT doc_id, count(*) AS n, count(*) FILTER (near) AS n_near FROM m WHERE word = 'and' GROUP BY doc_id""",
)
def a49_near_marker(spark, sf_dir):
    """How often a class word follows a marker within three words. One pass over a document's words in its row, no join of positions."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))
    hits = F.filter(F.transform("w", lambda x, i: F.when(x == "and", F.array_contains(F.slice("w", F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), "the"))), lambda x: x.isNotNull())
    d = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).select("doc_id", hits.alias("h")).filter(F.size("h") > 0)
    return d.select("doc_id", F.size("h").cast("long").alias("n"), F.size(F.filter("h", lambda x: x)).cast("long").alias("n_near"))


@query(
    "a54_snapshot_metrics",
    f"""WITH {PRICE_ROWS} SELECT year(day)::INT AS year, count(DISTINCT gtin) AS n_products, count(DISTINCT chain) AS n_chains, count(*) FILTER (in_stock) AS n_in_stock, min(price_c) AS min_c FROM price_rows GROUP BY 1""",
)
def a54_snapshot_metrics(spark, sf_dir):
    """The time line of a catalogue's metrics: one row a year."""
    return price_rows(spark, sf_dir).groupBy(F.year("day").alias("year")).agg(
        F.count_distinct("gtin").alias("n_products"), F.count_distinct("chain").alias("n_chains"), F.count_if("in_stock").alias("n_in_stock"), F.min("price_c").alias("min_c")
    )


@query(
    "a58_rule_impact",
    f"""WITH {PRODUCTS}, m AS (SELECT name, min(size) AS first FROM products GROUP BY name) SELECT name, count(*) AS n, count(*) FILTER (size * 4 >= first * 3 AND size * 3 <= first * 4) AS n_old, count(*) FILTER (size * 10 >= first * 9 AND size * 9 <= first * 10) AS n_new FROM products JOIN m USING (name) GROUP BY name""",
)
def a58_rule_impact(spark, sf_dir):
    """How many products match their class's smallest size under the rule as it is (25 percent) and a stricter one (10)."""
    p = products(spark, sf_dir)
    x = p.join(p.groupBy("name").agg(F.min("size").alias("first")), "name")
    fit = lambda a: (F.col("size") * 100 >= F.col("first") * (100 - a)) & (F.col("first") * 100 >= F.col("size") * (100 - a))
    return x.groupBy("name").agg(F.count("*").alias("n"), F.count_if(fit(25)).alias("n_old"), F.count_if(fit(10)).alias("n_new"))


CLUSTERS = f"""{STOCKED}, one AS (SELECT DISTINCT concept, size, chain, gtin, brand, department FROM stocked), per AS (SELECT concept, size, chain, count(*) AS k FROM one GROUP BY ALL),
cl AS (SELECT concept, size, count(DISTINCT gtin) AS n, count(DISTINCT brand) AS n_brands, count(DISTINCT department) AS n_departments FROM one GROUP BY ALL)"""


def cluster_facts(rows: DataFrame) -> DataFrame:
    """rows as stocked() -> per class and size: products, brands, departments, and the most products that one chain sells of it."""
    one = rows.select("concept", "size", "chain", "gtin", "brand", "department").distinct()
    most = one.groupBy("concept", "size", "chain").agg(F.count("*").alias("k")).groupBy("concept", "size").agg(F.max("k").alias("most"))
    facts = one.groupBy("concept", "size").agg(F.count_distinct("gtin").alias("n"), F.count_distinct("brand").alias("n_brands"), F.count_distinct("department").alias("n_departments"))
    return facts.join(most, ["concept", "size"])


@query(
    "a60_cluster_verdict",
    f"""WITH {CLUSTERS} SELECT concept, size, n, CASE WHEN (SELECT max(k) FROM per WHERE per.concept = cl.concept AND per.size = cl.size) > 1 THEN 'two in a chain' WHEN n_brands > 1 THEN 'brands differ' WHEN n_departments > 1 THEN 'review' ELSE 'same' END AS verdict FROM cl""",
)
def a60_cluster_verdict(spark, sf_dir):
    verdict = first_reason(("two in a chain", F.col("most") > 1), ("brands differ", F.col("n_brands") > 1), ("review", F.col("n_departments") > 1), otherwise="same")
    return cluster_facts(stocked(spark, sf_dir)).select("concept", "size", "n", verdict.alias("verdict"))


@query("a63_vote_tally", f"WITH {STOCKED} SELECT concept, department, count(*) AS votes, count(DISTINCT chain) AS n_chains, count(*) FILTER (in_stock) AS n_marked FROM stocked GROUP BY ALL")
def a63_vote_tally(spark, sf_dir):
    """All votes behind a decision, kept long: what each value got, from how many chains, and how many were marked."""
    return stocked(spark, sf_dir).groupBy("concept", "department").agg(F.count("*").alias("votes"), F.count_distinct("chain").alias("n_chains"), F.count_if("in_stock").alias("n_marked"))


@query(
    "a64_manufacturers",
    f"""WITH {PRICE_ROWS}, m AS (SELECT gtin, store % 5 AS maker, count(*) AS n, min(day) AS first FROM price_rows GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gtin ORDER BY n DESC, first, maker) AS rn FROM m WHERE maker <> 0)
SELECT p.gtin, 'maker ' || maker AS maker, maker IS NOT NULL AS known FROM (SELECT DISTINCT gtin FROM price_rows) p LEFT JOIN (SELECT * FROM r WHERE rn = 1) USING (gtin)""",
)
def a64_manufacturers(spark, sf_dir):
    """The most named maker of a code, the first seen of equal ones; fillers (here: number 0) name none."""
    rows = price_rows(spark, sf_dir).withColumn("maker", F.col("store") % 5)
    m = rows.groupBy("gtin", "maker").agg(F.count("*").alias("n"), F.min("day").alias("first"))
    best = m.groupBy("gtin").agg(F.min(F.when(F.col("maker") != 0, F.struct((-F.col("n")).alias("n"), "first", "maker"))).alias("x"))
    return best.select("gtin", F.concat(F.lit("maker "), F.col("x.maker")).alias("maker"), F.col("x").isNotNull().alias("known"))


@query(
    "a66_conflict_queue",
    f"""WITH {PRICE_ROWS}, v AS (SELECT gtin, pct, count(DISTINCT chain) AS k FROM price_rows GROUP BY ALL) SELECT gtin, string_agg(pct || ':' || k, ',' ORDER BY pct) AS sides FROM v WHERE gtin % 13 <> 0 GROUP BY gtin HAVING count(*) > 1""",
)
def a66_conflict_queue(spark, sf_dir):
    """Codes whose chains publish several values, with the number of chains behind each (values are few); decided codes don't come back."""
    v = price_rows(spark, sf_dir).groupBy("gtin", "pct").agg(F.count_distinct("chain").alias("k"))
    decided = products(spark, sf_dir).filter("gtin % 13 = 0").select("gtin")
    x = v.join(decided, "gtin", "left_anti").groupBy("gtin").agg(F.array_sort(F.collect_list(F.struct("pct", "k"))).alias("s")).filter(F.size("s") > 1)
    return x.select("gtin", F.array_join(F.transform("s", lambda p: F.concat_ws(":", p["pct"].cast("string"), p["k"].cast("string"))), ",").alias("sides"))


@query("g03_band_invariant", f"WITH {STOCKED}, m AS (SELECT gtin, quantile_disc(price_c, 0.5 ORDER BY price_c DESC)::BIGINT AS mid FROM offers GROUP BY gtin) SELECT chain, gtin, price_c, mid FROM stocked JOIN m USING (gtin) WHERE size % 7 = 0 AND NOT (price_c <= 3 * mid AND 3 * price_c >= mid) AND NOT (gtin % 2 = 0)")
def g03_band_invariant(spark, sf_dir):
    """Weighed rows out of the band that no list of dropped rows names."""
    rows = stocked(spark, sf_dir)
    mid = rows.groupBy("gtin").agg(F.expr("CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY price_c DESC) AS BIGINT)").alias("mid"))
    dropped = rows.filter("gtin % 2 = 0").select("chain", "gtin")
    x = rows.filter("size % 7 = 0").join(mid, "gtin").filter("NOT (price_c <= 3 * mid AND 3 * price_c >= mid)")
    return x.join(dropped, ["chain", "gtin"], "left_anti").select("chain", "gtin", "price_c", "mid")


@query(
    "g04_band_margin",
    f"WITH {STOCKED}, m AS (SELECT concept, floor(median(price_c))::BIGINT AS mid FROM stocked GROUP BY 1) SELECT concept, max(greatest(price_c * 1000 // mid, mid * 1000 // price_c)) AS worst, count(*) FILTER (greatest(price_c * 1000 // mid, mid * 1000 // price_c) BETWEEN 2700 AND 3000) AS n_near FROM stocked JOIN m USING (concept) GROUP BY concept",
)
def g04_band_margin(spark, sf_dir):
    """How far from its band's middle the worst row of a card is (thousandths), and how many are near the limit of three."""
    rows = stocked(spark, sf_dir)
    x = rows.join(rows.groupBy("concept").agg(F.floor(F.median("price_c")).alias("mid")), "concept").withColumn("off", F.expr("greatest(price_c * 1000 div mid, mid * 1000 div price_c)"))
    return x.groupBy("concept").agg(F.max("off").alias("worst"), F.count_if(F.col("off").between(2700, 3000)).alias("n_near"))


@query(
    "g06_alias_candidates",
    f"""WITH {PRODUCTS}, b AS (SELECT y.*, x.gtin AS a, x.brand AS a_brand, x.department AS a_department FROM products x JOIN products y ON x.name = y.name AND x.size = y.size AND x.gtin < y.gtin)
SELECT a, gtin AS b, CASE WHEN brand = a_brand AND department = a_department THEN 'strong' WHEN brand = a_brand OR a // 1000 = gtin // 1000 THEN 'variant' ELSE 'weak' END AS tier FROM b""",
)
def g06_alias_candidates(spark, sf_dir):
    return alias_tiers(products(spark, sf_dir).select("gtin", "name", "size", "brand", "department"))


def alias_tiers(p: DataFrame) -> DataFrame:
    """All pairs of codes of a block: alike in all, in brand or code prefix, or in name and size alone."""
    same_brand = F.col("a_brand") == F.col("b_brand")
    tier = first_reason(("strong", same_brand & (F.col("a_department") == F.col("b_department"))), ("variant", same_brand | (F.expr("a div 1000 = b div 1000"))), otherwise="weak")
    return all_pairs(p, "name", "size").select("a", "b", tier.alias("tier"))


@query("g07_identity_keys", f"WITH {PRODUCTS} SELECT gtin, CASE WHEN gtin % 19 <> 0 AND size % 10 <> 0 THEN name || '|' || size || '|' || brand END AS key FROM products")
def g07_identity_keys(spark, sf_dir):
    """Class, size and brand; products without a size and those decided to be none have no key."""
    known = (F.col("gtin") % 19 != 0) & (F.col("size") % 10 != 0)
    return products(spark, sf_dir).select("gtin", F.when(known, F.concat_ws("|", "name", "size", "brand")).alias("key"))


@query(
    "g11_split_clusters",
    f"""WITH {PRODUCTS} SELECT name, size, department, count(*) AS n, min(gtin) AS first FROM products GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8""",
)
def g11_split_clusters(spark, sf_dir):
    """Clusters of one name and size split where departments disagree; those of two to eight members are kept."""
    return products(spark, sf_dir).groupBy("name", "size", "department").agg(F.count("*").alias("n"), F.min("gtin").alias("first")).filter("n BETWEEN 2 AND 8")


@query(
    "g12_review_clusters",
    f"""WITH {CLUSTERS}, o AS (SELECT concept, size, count(*) AS impact FROM stocked GROUP BY ALL) SELECT concept, size, n, impact, row_number() OVER (PARTITION BY n_brands = 1 ORDER BY impact DESC, concept, size) AS place, n_brands = 1 AS one_brand FROM cl JOIN o USING (concept, size) WHERE n > 1""",
)
def g12_review_clusters(spark, sf_dir):
    """Clusters to review: those of one brand and the others, each by the number of offers they touch."""
    rows = stocked(spark, sf_dir)
    x = cluster_facts(rows).join(rows.groupBy("concept", "size").agg(F.count("*").alias("impact")), ["concept", "size"]).filter("n > 1").withColumn("one_brand", F.col("n_brands") == 1)
    w = Window.partitionBy("one_brand").orderBy(F.col("impact").desc(), "concept", "size")
    return x.select("concept", "size", "n", "impact", F.row_number().over(w).alias("place"), "one_brand")


@query(
    "g13_decisions",
    f"""WITH {PRODUCTS}, b AS (SELECT y.*, x.gtin AS a, x.brand AS a_brand FROM products x JOIN products y ON x.name = y.name AND x.size = y.size AND x.gtin < y.gtin),
d AS (SELECT a, gtin AS b, gtin % 3 <> 0 AS same, brand <> a_brand AS two_brands, gtin % 40 = 1 AS aliased FROM b)
SELECT a, b, CASE WHEN aliased THEN 'already an alias' WHEN same AND two_brands THEN 'two brands' WHEN same THEN 'alias' ELSE 'not alias' END AS outcome FROM d""",
)
def g13_decisions(spark, sf_dir):
    """Verdicts on pairs become aliases or non-aliases, unless a guard refuses: a code that is an alias already, or two brands."""
    p = products(spark, sf_dir).select("gtin", "name", "size", "brand")
    verdicts = all_pairs(p, "name", "size").withColumn("same", F.col("b") % 3 != 0)
    known = p.filter("gtin % 40 = 1").select(F.col("gtin").alias("b"), F.lit(True).alias("aliased"))
    x = verdicts.join(known, "b", "left")
    outcome = first_reason(("already an alias", F.col("aliased")), ("two brands", F.col("same") & (F.col("a_brand") != F.col("b_brand"))), ("alias", F.col("same")), otherwise="not alias")
    return x.select("a", "b", outcome.alias("outcome"))


@query(
    "g15_promoted",
    f"""WITH {PRICE_ROWS}, v AS (SELECT gtin, pct, count(DISTINCT chain) AS k FROM price_rows GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY gtin ORDER BY k DESC, pct) AS rn FROM v)
SELECT gtin, pct, k AS n_chains FROM r WHERE rn = 1 AND k >= 3 AND gtin % 7 <> 0 AND gtin % 11 <> 0""",
)
def g15_promoted(spark, sf_dir):
    """Values on which three chains or more agree become records, but for products with an open check or a record."""
    v = price_rows(spark, sf_dir).groupBy("gtin", "pct").agg(F.count_distinct("chain").alias("k"))
    best = v.groupBy("gtin").agg(F.min(F.struct((-F.col("k")).alias("k"), "pct")).alias("x")).select("gtin", "x.pct", (-F.col("x.k")).alias("n_chains")).filter("n_chains >= 3")
    p = products(spark, sf_dir)
    return best.join(p.filter("gtin % 7 = 0").select("gtin"), "gtin", "left_anti").join(p.filter("gtin % 11 = 0").select("gtin"), "gtin", "left_anti")


@query(
    "h04_fetch_status",
    f"""WITH {STORES}, {PRICE_ROWS}, t AS (SELECT chain, max(day) AS ok_day FROM price_rows WHERE in_stock GROUP BY chain), f AS (SELECT chain, min(day) FILTER (NOT in_stock) AS first_failed, max(day) AS seen FROM price_rows GROUP BY chain)
SELECT c.chain, CASE WHEN f.chain IS NULL THEN 'missing' WHEN ok_day >= seen THEN 'ok' ELSE 'failed' END AS status, CASE WHEN NOT coalesce(ok_day >= seen, false) THEN coalesce(ok_day, first_failed) END AS since FROM (SELECT DISTINCT chain FROM stores) c LEFT JOIN f USING (chain) LEFT JOIN t USING (chain)""",
)
def h04_fetch_status(spark, sf_dir):
    """A chain's status: ok as of its newest day, failed since the last success, or missing."""
    f = price_rows(spark, sf_dir).groupBy("chain").agg(
        F.max(F.when(F.col("in_stock"), F.col("day"))).alias("ok_day"), F.min(F.when(~F.col("in_stock"), F.col("day"))).alias("first_failed"), F.max("day").alias("seen")
    )
    x = stores(spark, sf_dir).select("chain").distinct().join(f, "chain", "left")
    ok = F.coalesce(F.col("ok_day") >= F.col("seen"), F.lit(False))
    return x.select("chain", first_reason(("missing", F.col("seen").isNull()), ("ok", ok), otherwise="failed").alias("status"), F.when(~ok, F.coalesce("ok_day", "first_failed")).alias("since"))


@query("h06_moves", f"WITH {PRODUCTS} SELECT department AS was, CASE WHEN family = 'widget' THEN 'LARGE' WHEN head = 'new' THEN 'PROMO' ELSE department END AS now, count(*) AS n FROM products GROUP BY ALL")
def h06_moves(spark, sf_dir):
    """Products classified anew, and how many went from where to where."""
    now = F.when(F.col("family") == "widget", "LARGE").when(F.col("head") == "new", "PROMO").otherwise(F.col("department"))
    return products(spark, sf_dir).groupBy(F.col("department").alias("was"), now.alias("now")).agg(F.count("*").alias("n"))


@query("x02_free_sql", f"WITH {STOCKED} SELECT department, family, count(*) AS n, count(DISTINCT gtin) FILTER (in_stock) AS n_in_stock FROM stocked GROUP BY ALL")
def x02_free_sql(spark, sf_dir):
    """Named views and free SQL over them."""
    stocked(spark, sf_dir).createOrReplaceTempView("tm_stocked")
    return spark.sql("SELECT department, family, count(*) AS n, count(DISTINCT gtin) FILTER (WHERE in_stock) AS n_in_stock FROM tm_stocked GROUP BY department, family")
